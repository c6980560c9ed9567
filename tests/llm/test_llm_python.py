"""Licences, packing, token counts and the two kernel models against plain Python, and in awkward cases."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidencia.llm import langid, licenses, packing, token_counts, tokenizing, toxicity
from evidencia.llm.parts import gathered
from evidencia.sources.store import scratch_path, written

WORD_FILE, PIECE_FILE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
STRANGE = ["Straße ÉCOLE's don't <|endoftext|> a<s>b </s> x", "  two  spaces ", "tab\tand\r\nline end", "é ́x Å ΣΑΣ σας",
           "中文字 ｆｕｌｌ \U0001f600!!", "12ab 3,4.5 word!?... (x)", "a", " ", "\n", "x" * 5000, "I'LL they're 'tis", "İstanbul ǅ ﬁ"]


# Licences

def python_base(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, labels = [], set()
    for label, phrase in (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")):
        key = phrase.split()
        for k in range(len(words) - len(key) + 1):
            if words[k:k + len(key)] == key:
                starts.append(k), labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_licence_base_rule(spark, awkward, documents):
    texts = ["under the MIT license, UNDER THE mit License", "Apache License, Version 2.0 cc-by-nc", "cc by\nnc cc by nc", "mit mit under the mit", "under the mit license" * 3, "KK cc by nc"]
    extra = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    docs = documents.select("doc_id", "text").unionByName(awkward.select("doc_id", "text")).unionByName(extra)
    by_text = collections.defaultdict(list)
    for r in docs.collect():
        by_text[r.doc_id].append(r.text)
    got = licenses.scanned(docs).collect()
    assert len(got) == docs.count()
    left = collections.Counter((d, python_base(t)) for d, ts in by_text.items() for t in ts)
    left.subtract((r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got)
    assert not any(left.values())
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_licence_notices(spark, empty):
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files to deal in the Software without restriction"
    rows = [(1, f"x y {grant}."), (2, grant.replace("charge", "cost")), (3, "under the GNU General Public License, version 3."), (4, "general public version license gnu"), (5, "CC BY-SA 4.0")]
    got = {r.doc_id: r.labels for r in licenses.scanned(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {1: "mit", 2: "", 3: "gpl-3", 4: "", 5: "cc-by-sa"}
    assert licenses.scanned(empty).count() == 0


def test_true_licence_texts(spark):
    gnu = "{0} is free software; you can redistribute it and/or modify it under the terms of the {1} as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version."
    texts = {
        "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify',
        "apache-2": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy',
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "gpl-2": gnu.format("This program", "GNU General Public License", "2"), "gpl-3": gnu.format("Foo", "GNU General Public License", "3"),
        "lgpl": gnu.format("This library", "GNU Lesser General Public\n * License", "2.1"), "agpl-3": gnu.format("This program", "GNU Affero General Public License", "3"),
        "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed with this",
        "isc": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "unlicense": "This is free and unencumbered software released into the public domain.",
        "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "cc0": "To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to Foo.",
    }
    rows = [(label, f"Copyright (c) 2020 Jane Doe\n\n{text}") for label, text in texts.items()]
    rows += [("far", texts["mit"].replace("(the", "w " * 60 + "(the")), ("2 or 3", texts["gpl-2"].replace("any later version", "version 3 of the License"))]
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert {k: r.labels for k, r in got.items()} == {**{k: k for k in texts}, "far": "", "2 or 3": "gpl-2,gpl-3"}
    assert [(f.label, f.start, f.base) for f in got["mit"].finds] == [("mit", 5, False)] and got["mit"].finds[0].cover == got["mit"].score == 1
    assert got["far"].finds == []


# Packing

def test_packing_keeps_every_id(spark, awkward, documents):
    docs = documents.select("doc_id", "text").limit(120).unionByName(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(STRANGE)], "doc_id bigint, text string"))
    docs = docs.unionByName(awkward.select("doc_id", "text").filter("doc_id > 1"))
    encode = Tokenizer.from_file(WORD_FILE)
    want = collections.Counter()
    for r in docs.collect():
        ids = encode.encode(r.text or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 2048):
            part = ids[at:at + 2048]
            want[r.doc_id, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    got = packing.packed(docs, WORD_FILE).collect()
    assert collections.Counter(tuple(r[:5]) for r in got) == want
    windows = collections.defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    tokens = sum(r.length for r in got)
    assert len(windows) <= tokens / 2048 * 1.05 + 1


def test_packed_sequences_hold_the_ids(spark):
    texts = ["one two three", None, "", *STRANGE, "another text " * 1500, "one two three"]
    docs = spark.createDataFrame([(None if k % 3 else 7, t) for k, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    pieces = written(packing.packed(docs, WORD_FILE), "packed")
    got, encode = pieces.collect(), Tokenizer.from_file(WORD_FILE)
    by_row = collections.defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        by_row[r.row].append((r.start, tuple(ids.tolist())))
    rebuilt = collections.Counter(sum((ids for _, ids in sorted(parts)), ()) for parts in by_row.values())
    assert rebuilt == collections.Counter((*encode.encode(t or "", add_special_tokens=False).ids, 1) for t in texts)
    whole = {r.sequence_id: r for r in packing.sequences(pieces).collect()}
    assert set(whole) == {r.sequence_id for r in got} and all(len(r.ids) == 4 * 2048 for r in whole.values())
    for r in got:
        assert whole[r.sequence_id].ids[4 * r.offset:4 * (r.offset + r.length)] == r.ids
    for r in whole.values():
        assert r.length == sum(x.length for x in got if x.sequence_id == r.sequence_id) and set(np.frombuffer(r.ids, "<u4")[r.length:].tolist()) <= {1}


def test_packing_of_nothing(empty):
    assert packing.packed(empty, WORD_FILE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 6), min_size=1, max_size=12), st.integers(1, 63))
def test_fill_is_the_best_subset(counts, capacity):
    reach = {0}
    for length, n in counts.items():
        reach = {r + c * length for r in reach for c in range(n + 1) if r + c * length <= capacity}
    used = packing.fill(counts, capacity)
    assert sum(k * n for k, n in used.items()) == max(reach) and all(n <= counts[k] for k, n in used.items())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 500), max_size=20))
def test_plan_uses_every_rest_once(counts):
    total = collections.Counter()
    for times, used in packing.plan(dict(counts), 64):
        assert sum(k * n for k, n in used.items()) <= 64
        for k, n in used.items():
            total[k] += times * n
    assert dict(total) == counts


# Token counts

def test_counts_and_cache(spark, awkward, documents, empty):
    docs = documents.select("doc_id", "text").limit(100).unionByName(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(STRANGE)], "doc_id bigint, text string"))
    docs = docs.unionByName(awkward.select("doc_id", "text"))
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)
    want = collections.Counter((r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "")), n > 4096) for r in docs.collect())
    cache = scratch_path(spark, "cache")
    assert collections.Counter(map(tuple, token_counts.counted(docs, PIECE_FILE, cache).collect())) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert collections.Counter(map(tuple, token_counts.counted(docs, PIECE_FILE, cache).collect())) == want
    assert spark.read.parquet(cache).count() == stored.count()  # nothing was encoded again
    more = docs.unionByName(spark.createDataFrame([(5000, "a new text")], "doc_id bigint, text string"))
    assert token_counts.counted(more, PIECE_FILE, cache).count() == more.count()
    assert spark.read.parquet(cache).count() == stored.count() + 1
    assert token_counts.counted(empty, PIECE_FILE, cache).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=40), max_size=4))
def test_remembered_parts_change_nothing(texts):
    texts = texts + [" ".join(texts)]
    with open(WORD_FILE, "rb") as f:
        words = tokenizing.loaded(tokenizing.WordIds, "test", f.read())
    assert words.splits
    want = [np.array(e.ids, "<u4").tobytes() for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    flat, sizes, codes, counts = words.ids(pa.array(texts, pa.string()))
    ids, stops = gathered(flat, sizes, codes).astype("<u4"), np.concatenate([[0], np.cumsum(sizes[codes])])[np.cumsum(counts)]
    assert [ids[b:e].tobytes() for b, e in zip([0, *stops[:-1]], stops)] == want
    with open(PIECE_FILE, "rb") as f:
        pieces = tokenizing.loaded(tokenizing.PieceCounts, "test", f.read())
    assert pieces.splits
    assert list(pieces.counts(texts)) == [len(x) for x in pieces.processor.encode(texts)]


# Language identification

def test_gram_sets():
    text = "Aé1 a"
    folded = [int(x) for x in np.frombuffer(text.lower().encode().translate(langid.FOLD), np.uint8)]
    want, base = set(), 0
    for n in (1, 2, 3):
        for k in range(len(folded) - n + 1):
            code = 0
            for c in folded[k:k + n]:
                code = code * langid.CLASSES + c
            want.add(base + code)
        base += langid.CLASSES ** n
    got = langid.Grams().of(text)
    assert set(got.tolist()) == want and len(got) == len(want) and langid.Grams().of("").tolist() == []


def test_languages(spark, awkward, documents, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fitted(docs)
    held = docs.filter(langid.held_out(F.col("doc_id")))
    got = langid.predicted(held, model).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got) and all(0 <= r.score <= 1 for r in got)
    odd = langid.predicted(awkward, model).collect()
    assert len(odd) == awkward.count() and all(r.lang_pred == "und" and r.score == 0 for r in odd if not (r.text or "").strip())
    digits = spark.createDataFrame([(1, "12 34 !?"), (2, "中"), (3, None)], "doc_id int, text string")
    assert [r.lang_pred == "und" for r in langid.predicted(digits, model).orderBy("doc_id").collect()] == [True, False, True]
    assert {r.lang_pred for r in langid.predicted(awkward, langid.fitted(empty)).collect()} == {"und"}
    kept = langid.accepted(awkward)
    assert kept.columns == awkward.columns and kept.filter("text is null or trim(text) = ''").count() == 0
    assert langid.accepted(empty).count() == 0


# Toxicity

@pytest.fixture(scope="module")
def insults(spark):
    chance = random.Random(5)
    plain = ["".join(chance.choice("aeioutnrshdl") for _ in range(chance.randint(2, 9))) for _ in range(900)]
    bad = ["moron", "scumbag", "worthless", "vequ"]
    rows, labels = [], []
    for k in range(1500):
        words = [chance.choice(plain) for _ in range(40)]
        toxic = int(k % 4 == 0)
        if toxic:
            word = chance.choice(bad)
            words.insert(chance.randrange(40), word + chance.choice(plain)[:3] if word == "vequ" else word)
        rows.append((k, " ".join(words)))
        labels.append((k, toxic))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxic_texts(spark, insults, awkward, empty):
    docs, labels = insults
    model = toxicity.fitted(docs, labels)
    held = docs.join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).collect()
    scores = model.scores([r.text for r in held])
    toxic = np.array([r.toxic == 1 for r in held])
    assert (scores[toxic] >= toxicity.THRESHOLD).mean() >= 0.97 and (scores[~toxic] >= toxicity.THRESHOLD).mean() <= 0.01
    bent = model.scores(["such a m o r o n here", "a mo-ron there", "M.O.R.O.N", "worthl3ess and", "a wortthless thing", "scumxbag"])
    assert (bent >= toxicity.THRESHOLD).sum() >= 5
    assert model.scores(["", None, "  \n "]).tolist() == [0, 0, 0]
    together = model.scores(["moron", "tree", "moron"])
    assert together[0] == together[2] and together[1] == model.scores(["tree"])[0]
    out = toxicity.scored(awkward, model).collect()
    assert len(out) == awkward.count() and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in toxicity.scored(docs, toxicity.fitted(docs, labels.limit(0))).collect()} == {0.0}
    assert toxicity.scored(empty, model).count() == 0
    again = labels.unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id bigint, toxic int"))
    assert toxicity.fitted(docs, again).table is not None


def test_subsequences_are_counted():
    """The folded kernel equals the sum over all pairs of equal subsequences."""
    def subsequences(word):
        marked = b"\0" + word + b"\0"
        out = collections.Counter()
        for start in range(len(marked)):
            for offsets, weight in toxicity.OFFSETS:
                places = [start + o for o in offsets]
                if places[-1] < len(marked):
                    out[bytes(marked[p] for p in places)] += weight
        return out

    a, b = b"\x05\x06\x07\x05\x06", b"\x05\x07\x06\x05\x06\x08"
    words = toxicity.Words([a, b])
    left, right = subsequences(a), subsequences(b)
    want = sum(left[k] * right[k] for k in left) / words.size[0] / words.size[1]
    assert np.isclose(words.dot(words.expanded(np.array([1]), np.ones(1)))[0], want, rtol=1e-5)
