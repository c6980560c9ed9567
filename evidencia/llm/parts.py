"""Token ids of many texts through their parts.

A part is a run of white space with what follows it up to the next white space. Byte-level tokenizers start a new word
at each part, and the pieces of the other kind never reach over the start of one (both are checked when a file is
loaded; white space that stands behind other signs in some piece starts no part, and if the ids of a probe differ, a text
is a part by itself), so the ids of a text are those of its parts. Parts are
named by Arrow's dictionary, new ones are encoded in long runs whose ids are cut at the parts' last bytes, and
what is known of a part is kept in a bounded memory of the worker. Results do not depend on that memory.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Unicode's White_Space, as tokenizers see it.
OTHER_WHITE = r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WHITE = r"\t-\r " + OTHER_WHITE
SPACES = frozenset("\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000").union(map(chr, range(0x2000, 0x200B)))
SLICE_CHARS = 8_000_000  # texts taken at a time
REMEMBERED = 400_000  # parts kept in memory, and as many older ones
RUN = 1_000  # parts encoded in one call
PROBE = "Ab cé,\nd. 12 x\ty  z \n\n é \u3000q <s> \r\n!"


def slices(batches: Iterable[pa.RecordBatch], column: int, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `chars` characters, a longer text by itself."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + chars, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def cut(texts: pa.Array, apart: bool = True, glued: frozenset = frozenset()) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """texts -> (codes of all parts in order, number of parts of each text, the distinct parts); null is empty. White space
    that begins with a sign of `glued` starts no part; without `apart` each text is one part."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    mark = "\0"
    while pc.any(pc.match_substring(texts, mark)).as_py():
        mark += "\1"
    # Only single spaces and line ends, all inside: parts start at them. Anything else is searched for its starts.
    odd = pc.match_substring_regex(texts, rf"[{WHITE}][{WHITE}]|[\t\v-\r{OTHER_WHITE}]|\A[ \n]|[ \n]\z")
    if not apart:
        marked = texts
    else:
        marked = pc.replace_substring(pc.replace_substring(texts, " ", mark + " "), "\n", mark + "\n")
        if pc.any(odd).as_py():
            starts = "".join(f"\\x{{{ord(c):x}}}" for c in sorted(SPACES - glued))
            marked = pc.replace_with_mask(marked, odd, pc.replace_substring_regex(
                pc.filter(texts, odd), f"([^{WHITE}])([{starts}])", rf"\1{mark}\2"))
    split = pc.split_pattern(marked, mark)
    named = split.flatten().dictionary_encode()
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    return named.indices.to_numpy(zero_copy_only=False), counts, named.dictionary


def gathered(flat: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The stretches of `flat`, which has one of each length after the other, in the order of `codes`."""
    starts = np.cumsum(lengths) - lengths
    take = lengths[codes]
    ends = np.cumsum(take)
    return flat[np.repeat(starts[codes] - (ends - take), take) + np.arange(ends[-1] if len(ends) else 0)]


class ByteLevel:
    """A `tokenizers` file of byte-level tokens. With `plain`, strings of special tokens are ordinary text."""

    def __init__(self, blob: bytes, plain: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel as Alphabet

        self.tokenizer = Tokenizer.from_str(blob.decode("utf-8"))
        self.tokenizer.encode_special_tokens = plain
        special = {k: token.content for k, token in self.tokenizer.get_added_tokens_decoder().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each token
        self.width = np.dtype("<u2" if len(self.lengths) <= 1 << 16 else "<u4")  # wide enough for all ids
        for token, k in vocabulary.items():
            self.lengths[k] = len(special[k].encode()) if k in special else len(token)
        known = set(vocabulary)
        self.apart = all(letter in known for letter in Alphabet.alphabet()) and self._separate()

    def _separate(self) -> bool:
        """Are the ids of a probe those of its parts, and those of a word with signs behind it those of both?"""
        codes, _, parts = cut(pa.array([PROBE]))
        pieces = [parts[c].as_py() for c in codes.tolist()]
        both = [self.encode([x])[0].tolist() for x in (" Wörd", '.,"!', ' Wörd.,"!')]
        return self.encode([PROBE])[0].tolist() == [k for p in pieces for k in self.encode([p])[0].tolist()] and both[0] + both[1] == both[2]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def after(self, text: str) -> np.ndarray:
        """The ids of a text that starts with white space and stands behind a word."""
        return self.encode([text])[0]

    def fits(self, ids: np.ndarray, text: bytes) -> bool:
        return int(self.lengths[ids].sum()) == len(text)


class Pieces:
    """A `sentencepiece` file; ids of a text with the space that the library adds in front of it."""

    def __init__(self, blob: bytes):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.bytes = []
        for k in range(self.processor.get_piece_size()):
            piece = self.processor.id_to_piece(k)
            if self.processor.is_byte(k):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.bytes.append(piece.replace("▁", " ").encode())
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        inner = (p.replace("▁", " ").lstrip("".join(SPACES)) for p in map(self.processor.id_to_piece, range(len(self.bytes))))
        self.glued = frozenset().union(*(SPACES.intersection(p) for p in inner))
        self.apart = not self.glued & {" ", "\n"} and self._separate()

    def _separate(self) -> bool:
        codes, _, parts = cut(pa.array([" " + PROBE]), True, self.glued)
        return self.processor.encode(PROBE) == [k for c in codes.tolist() for k in self.after(parts[c].as_py()).tolist()]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """texts with the space in front."""
        return [np.array(ids, np.uint32) for ids in self.processor.encode([t[1:] for t in texts], num_threads=1)]

    def after(self, text: str) -> np.ndarray:
        """The ids of a text that starts with white space and stands behind a word."""
        ids = np.array(self.processor.encode("x" + text), np.uint32)
        skip = int(np.searchsorted(np.cumsum(self.lengths[ids]), 2)) + 1
        return ids[skip:]

    def fits(self, ids: np.ndarray, text: bytes) -> bool:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())) == text


def run_of(encoder, parts: list[str], text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids of parts that follow each other in `text`, and how many each part has; None if they do not end where the parts do."""
    ids = encoder.after(text)
    if not encoder.fits(ids, text.encode()):
        return None
    ends = np.cumsum(encoder.lengths[ids])
    stops = np.cumsum([len(p.encode()) for p in parts])
    at = np.searchsorted(ends, stops)
    if len(ids) == 0 or not np.array_equal(ends[np.minimum(at, len(ends) - 1)], stops):
        return None
    return ids, np.diff(at + 1, prepend=0)


def runs(parts: list[str], fresh: Iterable[int]) -> Iterator[tuple[list[int], bool]]:
    """The places `fresh` in `parts` in lists that may be encoded together, and whether they may: parts that start with white space
    and do not end with it."""
    joined, single = [], []
    for k in fresh:
        part = parts[k]
        (joined if part and part[0] in SPACES and part[-1] not in SPACES else single).append(k)
    for at in range(0, len(joined), RUN):
        yield joined[at:at + RUN], True
    for k in single:
        yield [k], False


class PartIds:
    """Ids of a byte-level file by part, as bytes of 32-bit numbers. Parts that are letters of Latin-1 with ASCII signs behind them
    are two words to the tokenizer and known by both, so `word`, `word,` and `word.` share what is known of the word."""

    LETTERS, SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-/:-@\[-`{-~"

    def __init__(self, blob: bytes, plain: bool = False, remembered: int = REMEMBERED):
        self.encoder, self.remembered = ByteLevel(blob, plain), remembered
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was known before; what is met again moves on

    def learn(self, parts: list[str]) -> list[bytes]:
        """The ids of each part."""
        known, older = self.known, self.older
        known.update((p, older[p]) for p in parts if p not in known and p in older)
        single = []
        for places, together in runs(parts, [k for k, p in enumerate(parts) if p not in known]):
            some = [parts[k] for k in places]
            found = run_of(self.encoder, some, "".join(some)) if together else None
            if found is None:
                single += some
                continue
            flat, stops = found[0].tobytes(), (np.cumsum(found[1]) * 4).tolist()
            known.update(zip(some, map(flat.__getitem__, map(slice, [0, *stops[:-1]], stops))))
        for at in range(0, len(single), RUN):
            some = single[at:at + RUN]
            known.update(zip(some, (ids.tobytes() for ids in self.encoder.encode(some))))
        return list(map(known.__getitem__, parts))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """texts -> (ids of the distinct words, how many each has, codes of words in order, words per text)."""
        if len(self.known) > self.remembered:
            self.known, self.older = {}, self.known
        codes, counts, parts = cut(texts, self.encoder.apart)
        signed = pc.match_substring_regex(parts, f"\\A ?[{self.LETTERS}]+[{self.SIGNS}]+\\z") if self.encoder.apart else pa.array(
            np.zeros(len(parts), bool))
        word = pc.if_else(signed, pc.replace_substring_regex(parts, f"[{self.SIGNS}]+\\z", ""), parts).dictionary_encode()
        signs = pc.replace_substring_regex(pc.filter(parts, signed), f"\\A ?[{self.LETTERS}]+", "").dictionary_encode()
        found = self.learn(word.dictionary.to_pylist()) + self.learn(signs.dictionary.to_pylist()) + [b""]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        second = np.full(len(parts), len(found) - 1, np.int64)  # no signs
        second[signed.to_numpy(zero_copy_only=False)] = signs.indices.to_numpy(zero_copy_only=False) + len(word.dictionary)
        both = np.empty((len(codes), 2), np.int64)
        both[:, 0], both[:, 1] = word.indices.to_numpy(zero_copy_only=False)[codes], second[codes]
        return np.frombuffer(b"".join(found), np.uint32), lengths, both.ravel(), 2 * counts
