"""Sets of word shingles as 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SHINGLE = 5
CHUNK_BYTES = 1 << 20

# A-Z become a-z; the six white space bytes that part words become spaces.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if 0x09 <= b <= 0x0D else b for b in range(256))

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_STEPS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    def __init__(self):
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 1))
            self.powers, self.inverses = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            self.powers[0] = self.inverses[0] = 1
            np.cumprod(self.powers, out=self.powers)
            np.cumprod(self.inverses, out=self.inverses)

    def sets(self, texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
        """For each text its distinct shingles, ascending; empty for a text without words."""
        group, size = [], 0
        for text in texts:
            group.append((text or b"").translate(FOLD))
            size += len(group[-1])
            if size >= CHUNK_BYTES:
                yield from self._chunk(group)
                group, size = [], 0
        if group:
            yield from self._chunk(group)

    def _chunk(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        chars = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        self._reach(len(chars))
        begin = np.cumsum([1, *[len(t) + 1 for t in texts]])[:-1]
        gap = chars == 0x20
        start = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        total = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * self.powers[:len(chars)], out=total[1:])
        words = mix((total[end] - total[start]) * self.inverses[start] + (end - start).astype(np.uint64))
        counts = np.bincount(np.searchsorted(begin, start, side="right") - 1, minlength=len(texts))
        first = np.cumsum(counts) - counts
        many = max(0, len(words) - SHINGLE + 1)
        runs = np.zeros(many, np.uint64)
        for k in range(SHINGLE):
            runs += words[k:k + many] * _STEPS[k]
        runs = mix(runs)
        for at, n in zip(first.tolist(), counts.tolist()):
            if n >= SHINGLE:
                yield np.unique(runs[at:at + n - SHINGLE + 1])
            elif n:
                yield mix(np.array([(words[at:at + n] * _STEPS[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def digest(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(mix(mix(shingles ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(shingles))).view(np.int64)[0])
