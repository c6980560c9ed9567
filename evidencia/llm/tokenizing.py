"""Token ids and token counts in the Python workers, with words remembered between batches.

Both tokenizers never join characters across certain places (see `WordIds` and `PieceCounts`), so the tokens
of a text are the tokens of its parts, and a part that was seen before need not be encoded again. The
memory of parts is emptied when it holds `REMEMBERED` of them. The tokenizer file is read by the driver and
broadcast; workers keep one tokenizer per file.
"""

from __future__ import annotations

import array
import hashlib
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

REMEMBERED = 700_000
CHUNK_CHARS = 2_000_000
JOINED = 1_000  # words encoded in one call

_LOADED: dict[str, object] = {}


def file_digest(path: str) -> tuple[bytes, str]:
    with open(path, "rb") as f:
        blob = f.read()
    return blob, hashlib.sha256(blob).hexdigest()


def loaded(kind: type, digest: str, blob: bytes):
    """The tokenizer of this worker for a file; made once, kept over tasks."""
    key = f"{kind.__name__} {digest}"
    if key not in _LOADED:
        _LOADED[key] = kind(blob)
    return _LOADED[key]


def grouped(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Texts in lists of about `CHUNK_CHARS` characters (null: empty)."""
    group, size = [], 0
    for text in texts:
        group.append(text or "")
        size += len(group[-1])
        if size >= CHUNK_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


class WordIds:
    """Ids of a `tokenizers` file whose pre-tokenizer drops white space and splits letters from other signs.

    Space and newline are white space to it, so text is cut there first. Of a part that is letters of
    Latin-1 followed by ASCII signs, letters and signs are two words of their own, and upper and lower case give
    the same ids (checked when the file is loaded); such parts share one memory of lower-case words. Parts are named by
    Arrow's dictionary, so that Python sees each distinct one of some texts once.
    """

    LETTERS, SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-/:-@\[-`{-~"

    def __init__(self, blob: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(blob.decode("utf-8"))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {"": b""}
        probe = ["Straße", "straße", "straße", ".,", "Straße.,", "École n", "école", "n"]
        a, b, _, signs, both, two, left, right = (e.ids for e in self._encode(probe))
        self.splits = a == b and both == a + signs and two == left + right

    def _encode(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _learn(self, words: list[str], letters: bool) -> None:
        """Remember the ids of words. Those of `letters` only are encoded in one call for many: each ends in its only
        token that ends a word."""
        new = [w for w in words if w not in self.words]
        for at in range(0, len(new), JOINED):
            some = new[at:at + JOINED]
            if letters:
                ids = np.array(self._encode([" ".join(some)])[0].ids, np.uint32)
                stops, flat = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist(), ids.tobytes()
                if len(stops) == len(some):
                    self.words.update(zip(some, map(flat.__getitem__, map(slice, [0, *stops[:-1]], stops))))
                    continue
            for word, found in zip(some, self._encode(some)):
                self.words[word] = np.array(found.ids, np.uint32).tobytes()

    def _ids(self, words: list[str], letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words, how many each has)."""
        self._learn(words, letters)
        found = list(map(self.words.__getitem__, words))
        return np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """texts -> (ids of their distinct parts, how many each has, codes of all parts in order, parts of each text); null is empty."""
        if len(self.words) > REMEMBERED:
            self.words = {"": b""}
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.splits:
            named = texts.dictionary_encode()
            return (*self._ids(named.dictionary.to_pylist(), letters=False), named.indices.to_numpy(), np.ones(len(texts), np.int64))
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        named = split.flatten().dictionary_encode()
        simple = pc.match_substring_regex(named.dictionary, f"\\A[{self.LETTERS}]+[{self.SIGNS}]*\\z")
        # Letters in lower case and signs of simple parts, other parts whole, each a code of its own.
        kinds = [(pc.utf8_lower(pc.replace_substring_regex(pc.filter(named.dictionary, simple), f"[{self.SIGNS}]+\\z", "")), True),
                 (pc.replace_substring_regex(pc.filter(named.dictionary, simple), f"\\A[{self.LETTERS}]+", ""), False),
                 (pc.filter(named.dictionary, pc.invert(simple)), False)]
        flat, sizes, codes, base = [], [], [], 0
        for values, letters in kinds:
            distinct = values.dictionary_encode()
            ids, lengths = self._ids(distinct.dictionary.to_pylist(), letters)
            flat.append(ids), sizes.append(lengths)
            codes.append(distinct.indices.to_numpy(zero_copy_only=False).astype(np.int64) + base)
            base += len(lengths)
        is_simple = simple.to_numpy(zero_copy_only=False)
        first, second = np.zeros(len(is_simple), np.int64), np.full(len(is_simple), base, np.int64)
        first[is_simple], second[is_simple], first[~is_simple] = codes
        both = np.empty((len(named.indices), 2), np.int64)
        order = named.indices.to_numpy(zero_copy_only=False)
        both[:, 0], both[:, 1] = first[order], second[order]
        sizes.append(np.zeros(1, np.int64))  # no signs
        return np.concatenate(flat), np.concatenate(sizes), both.ravel(), 2 * pc.list_value_length(split).to_numpy(
            zero_copy_only=False).astype(np.int64)


class PieceCounts:
    """Token counts of a `sentencepiece` file.

    If no piece has a space mark behind another character, no token reaches over the start of a space, and
    each word with the space before it is counted on its own. This holds for texts whose spaces are
    single and inside; any other text, or a file with other pieces or settings, is encoded whole.
    """

    def __init__(self, blob: bytes):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=blob)
        pieces = (self.processor.id_to_piece(k) for k in range(self.processor.get_piece_size()))
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces) and self._agrees()
        self.words: dict[str, int] = {}

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.processor.encode(texts, num_threads=1)]

    def _agrees(self) -> bool:
        whole, *parts = self._encode(["Ab cé,\nd. <s> 12 x", "Ab", "cé,\nd.", "<s>", "12", "x"])
        return whole == sum(parts)

    def counts(self, texts: Iterable[str | None]) -> Iterator[int]:
        for group in grouped(texts):
            apart = [self.splits and bool(t) and t[0] != " " and t[-1] != " " and "  " not in t for t in group]
            cut = [t.split(" ") if one else [] for t, one in zip(group, apart)]
            if len(self.words) > REMEMBERED:
                self.words = {}
            new = list(set().union(*cut).difference(self.words))
            self.words.update(zip(new, self._encode(new)))
            whole = iter(self._encode([t for t, one in zip(group, apart) if not one]))
            of = self.words.__getitem__
            for parts, one in zip(cut, apart):
                yield sum(map(of, parts)) if one else next(whole)
