"""Licence scan with a positional index of rare words.

The notices to look for are indexed by word and position. How rare each of their words is comes from the
documents themselves: one pass counts in how many documents every notice word occurs. Each notice, and each
key phrase, is then looked up by its rarest word: a document that lacks it cannot hold the notice, and
each occurrence fixes where the notice would have to start. Its first key phrase stands there word for word, the
others word for word and in order within `DRIFT` words of their places, as texts put words in or leave some out. The
share of the notice's total rarity that its words have which stand in the same order there, at most `DRIFT` words
before or behind it, is its cover. A notice counts if it has enough cover and its key phrases. The bare phrases of the
base rule are notices that consist of their key phrase.

Only the counts of notice words and the index travel; both are bounded by the notices. Texts are read whole,
never shuffled. Every find is kept with its label, place and cover; the digest of a text derives from its finds.
Null text counts as empty; a text without a find has 0 places, null positions, empty labels and score 0. Repeated rows are judged alike, null ids pass through.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidencia.session import ship_package, table

# Bytes of UTF-8 that separate words become spaces, A-Z become a-z, all others stay.
_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256))

MIN_COVER = 0.6
DRIFT = 12

# The base phrases, as (label, phrase).
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

# The GNU licences' notice for source files, up to the version.
_GNU = ("{what} is free software you can redistribute it and or modify it under the terms of the {name} "
        "as published by the free software foundation {version}")


def _gnu(label: str, what: str, name: str, version: str) -> tuple:
    keys = (f"{name} as published by the free software foundation", f"{version} of the license")
    return label, _GNU.format(what=what, name=name, version=f"either {version} of the license"), keys


# label, notice, key phrases: wording of well-known public licences, as their texts and the notices they ask for have it.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction",
     ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
                 "the license", ("apache license version 2 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    _gnu("gpl-2", "this program", "gnu general public license", "version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    _gnu("gpl-3", "this program", "gnu general public license", "version 3"),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    _gnu("lgpl", "this library", "gnu lesser general public license", "version 2 1"),
    _gnu("lgpl", "this library", "gnu lesser general public license", "version 3"),
    _gnu("lgpl", "this library", "gnu library general public license", "version 2"),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    _gnu("agpl-3", "this program", "gnu affero general public license", "version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("mpl-2", "mozilla public license version 2 0", ("mozilla public license version 2 0",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
            "provided that the above copyright notice and this permission notice appear in all copies",
     ("for any purpose with or without fee is hereby granted",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license",
     ("creative commons attribution noncommercial 4 0",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license",
     ("creative commons attribution sharealike 4 0",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc0", "dedicated to the public domain under cc0 1 0", ("cc0 1 0",)),
    ("cc0", "to the extent possible under law has waived all copyright and related or neighboring rights to",
     ("has waived all copyright and related or neighboring rights to",)),
)

FINDS = "array<struct<label: string, start: bigint, cover: double, base: boolean>>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


@dataclass
class Notice:
    label: str
    words: list[bytes]
    keys: list[tuple[int, int]]  # spans of `words` that must stand word for word
    base: bool = False


def notices() -> list[Notice]:
    out = [Notice(label, w := phrase.encode().split(), [(0, len(w))], True) for label, phrase in BASE]
    for label, text, phrases in NOTICES:
        words = text.encode().split()
        spans = []
        for phrase in phrases:
            key = phrase.encode().split()
            at = next(i for i in range(len(words)) if words[i:i + len(key)] == key)
            spans.append((at, at + len(key)))
        out.append(Notice(label, words, spans))
    return out


class Index:
    """Notices with the rarity of their words; `find` looks them up in one document."""

    def __init__(self, found: list[Notice], documents: int, counts: dict[bytes, int]):
        self.notices = found
        self.rarity = {w: math.log(1 + documents / (1 + counts.get(w, 0))) or 1.0 for n in found for w in n.words}
        self.total = [sum(self.rarity[w] for w in n.words) for n in found]
        # Where each notice is looked up: at the rarest word of its first key phrase.
        self.anchors: dict[bytes, list[tuple[int, int]]] = {}
        for k, n in enumerate(found):
            begin, end = n.keys[0]
            at = max(range(begin, end), key=lambda i: (self.rarity[n.words[i]], n.words[i], -i))
            self.anchors.setdefault(n.words[at], []).append((k, at))
        self.rare = frozenset(self.anchors)

    def stands(self, notice: Notice, words: list[bytes], start: int) -> bool:
        """Whether the key phrases stand if the notice starts at `start`: the first in place, the others near theirs."""
        begin, end = notice.keys[0]
        if start + begin < 0 or words[start + begin:start + end] != notice.words[begin:end]:
            return False
        free = start + end
        for begin, end in notice.keys[1:]:
            key, at = notice.words[begin:end], start + begin
            places = range(max(free, at - DRIFT), at + DRIFT + 1)
            found = next((p for p in places if words[p:p + len(key)] == key), None)
            if found is None:
                return False
            free = found + len(key)
        return True

    def cover(self, k: int, words: list[bytes], start: int) -> float:
        """The share of the notice's rarity that stands in order if it starts at `start`; 0 without its key phrases."""
        notice = self.notices[k]
        if not self.stands(notice, words, start):
            return 0.0
        if start >= 0 and words[start:start + len(notice.words)] == notice.words:
            return 1.0
        best = [0.0] * (len(notice.words) + 1)  # of each beginning of the notice, the rarity found in order so far
        for word in words[max(0, start - DRIFT):start + len(notice.words) + DRIFT]:
            before = 0.0
            for i, want in enumerate(notice.words, 1):
                above = best[i]
                best[i] = before + self.rarity[want] if word == want else max(above, best[i - 1])
                before = above
        return best[-1] / self.total[k]

    def find(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(notice, start, cover) of every find."""
        if self.rare.isdisjoint(words):
            return []
        out = []
        for position, word in enumerate(words):
            for k, at in self.anchors.get(word, ()):
                cover = self.cover(k, words, position - at)
                if cover >= MIN_COVER:
                    out.append((k, position - at, min(1.0, cover)))
        return out

    def row(self, text: bytes | None) -> tuple[int, list[dict]]:
        """How many words a text has, and its finds."""
        words = words_of(text)
        return len(words), [{"label": self.notices[k].label, "start": start, "cover": cover, "base": self.notices[k].base}
                            for k, start, cover in self.find(words)]


def counter(vocabulary: frozenset[bytes]):
    """Partial counts of documents per notice word; an empty word counts all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                counts.update(vocabulary.intersection(words_of(text)))
            counts[b""] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts]), pa.array(list(counts.values()), pa.int64())],
                                         ["word", "n"])
    return run


def build_index(docs: DataFrame) -> Index:
    """The index of all notices with the rarities that their words have in `docs`."""
    found = notices()
    vocabulary = frozenset(w for n in found for w in n.words)
    counts = docs.select("text").mapInArrow(counter(vocabulary), "word string, n bigint").groupBy("word").agg(F.sum("n")).collect()
    by_word = {w.encode(): n for w, n in counts}
    return Index(found, by_word.get(b"", 0), by_word)


def found(docs: DataFrame, index: Index | None = None) -> DataFrame:
    """docs {doc_id, text, ...} -> {doc_id, n_words, finds [{label, start, cover, base}]}, finds in the order of the text;
    a notice whose beginning the text lacks may start before its first word."""
    ship_package(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    index = index or build_index(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("cover", pa.float64()), ("base", pa.bool_())]))
        for batch in batches:
            rows = [index.row(text) for text in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array(
                [finds for _, finds in rows], kind)], ["doc_id", "n_words", "finds"])

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_words bigint, finds {FINDS}")


def scanned(docs: DataFrame, index: Index | None = None) -> DataFrame:
    """docs {doc_id, text, ...} -> {doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, finds}"""
    base = F.filter("finds", lambda x: x["base"])
    starts = base["start"]

    def labels(finds: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(finds["label"])), ",")

    return found(docs, index).select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("finds")).alias("labels"),
        F.coalesce(F.array_max(F.col("finds")["cover"]), F.lit(0.0)).alias("score"), "finds")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents")).drop("finds")
