"""Periodic runs, alignment of two tokenizers and token files against plain Python, and in awkward cases."""

import collections
import hashlib
import heapq
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from evidencia.llm import alignment, parts, periodic, token_files
from evidencia.llm.tokenizing import file_digest
from evidencia.sources.store import scratch_path

BYTE_FILE, PIECE_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
STRANGE = [None, "", " ", "a", " a", "a ", "▁x", "<s> <|endoftext|> </s>", "é　中文字 \U0001f600!!", "a\r\nb;\r\n c\r", "\n\nx", "  two  spaces ",
           "x" * 3000, "=" * 3000, "tab\tand\r\nline end", "\0 a", "\0\1 \0", "I'LL they're 'tis", "﻿x y", "中" * 200, "ab 12 3,4 !? don't"]
SIGNS = [*"ab é\n\t\r;.,'1<|>中", "  ", " the", "　", "don't", "<|endoftext|>"]


@pytest.fixture(scope="module")
def plain():
    with open(BYTE_FILE, "rb") as f, open(PIECE_FILE, "rb") as g:
        return f.read(), g.read()


# Parts

@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet=st.characters(codec="utf-8"), max_size=30), st.lists(st.sampled_from(SIGNS), max_size=20).map("".join)), max_size=4))
def test_parts_spell_texts_and_their_ids(plain, texts):
    for special in (False, True):
        encoder = parts.PartIds(plain[0], special)
        assert encoder.encoder.apart
        codes, counts, names = parts.cut(pa.array(texts, pa.string()))
        names, ends = names.to_pylist(), np.cumsum(counts)
        assert ["".join(names[c] for c in codes[e - n:e]) for e, n in zip(ends, counts)] == texts
        flat, sizes, codes, counts = encoder.ids(pa.array(texts, pa.string()))
        ends = np.cumsum(counts)
        ids, stops = parts.gathered(flat, sizes, codes), np.concatenate([[0], np.cumsum(sizes[codes])])
        want = [e.ids for e in encoder.encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [ids[stops[e - n]:stops[e]].tolist() for e, n in zip(ends, counts)] == want


# Periodic runs

def python_runs(words):
    out = set()
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            n = i + q - start
            if i > start and n >= max(6, 4 * q) and not any(all(words[t] == words[t + p] for t in range(start, start + n - p)) for p in range(1, q)):
                out.add((start, n, q))
            i = max(i, start + 1)
    return sorted(out)


def made_words(seed):
    chance = random.Random(seed)
    docs = []
    for _ in range(600):
        words = [chance.randrange(chance.choice([1, 2, 2, 3, 6])) for _ in range(chance.choice([0, 1, 5, 6, 7, 8, 20, 40, 90, 200]))]
        for _ in range(chance.randint(0, 3) if len(words) >= 8 else 0):
            a, p = chance.randrange(len(words)), chance.randint(1, len(words) // 5)
            for i in range(a + p, chance.randint(a, len(words))):
                words[i] = words[a + (i - a) % p]
        docs.append(words)
    thue = [bin(i).count("1") % 2 for i in range(600)]
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    # All 5-grams of this period stand in it twice, so only longer seeds show the run.
    return docs + [list("xxxxxxxyxxxxxxxxy" * 5), thue, thue[:70] * 5, fib[-1], [0] * 500]


def test_runs_against_all_lags():
    docs = made_words(7)
    names = {w: k for k, w in enumerate({w for d in docs for w in d})}
    got = periodic.runs(np.array([names[w] for d in docs for w in d], np.int64), np.array([len(d) for d in docs]))
    by_doc = collections.defaultdict(list)
    for d, *run in got.tolist():
        by_doc[d].append(tuple(run))
    for k, words in enumerate(docs):
        assert by_doc[k] == python_runs(words), words[:50]


def test_seeds_grow_with_words():
    """A word that fills a text is one chain of seeds, not all pairs of its places."""
    words = np.zeros(20_000, np.int64)
    assert sum(len(place) for _, place, _ in periodic.seeds(words, np.zeros(len(words), np.int64), np.array([len(words)]))) < 20_000
    assert periodic.runs(words, np.array([len(words)])).tolist() == [[0, 0, 20_000, 1]]


def python_periodic(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
    found = python_runs(words)
    gone = {j for s, m, q in found for j in range(s + q, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest(), " ".join(w for j, w in enumerate(words) if j not in gone))


def test_periodic_documents(spark, awkward, documents, empty):
    texts = ["a b " * 20, "", None, " \t\n", "  x x x x x x x\x0by　z ", "q", "u v w " * 9 + "u v x"]
    rows = [(None, texts[0])] + [(k, texts[k % len(texts)]) for k in range(200)] + [(k, t) for k, t in documents.select("doc_id", "text").collect() if len(t or "") < 4000]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = periodic.found(docs, planted=True).collect()
    assert collections.Counter(tuple(r)[:-1] for r in got) == collections.Counter(python_periodic(*r) for r in rows)
    strange = periodic.found(awkward)
    assert strange.count() == awkward.count() and periodic.found(empty).count() == 0
    assert {len(r.runs) == r.n_runs for r in strange.collect()} == {True}


# Alignment

@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 79)), st.sets(st.integers(1, 79)))
def test_ends_meet(a, b):
    a, b = sorted(a | {80}), sorted(b | {80})
    ends_a, ends_b = alignment.aligned(a, b)
    common = sorted(set(a) & set(b))
    assert [a[i - 1] for i in ends_a] == common == [b[j - 1] for j in ends_b]


def letters():
    """The byte of each letter in which byte-level tokens are written."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + k): b for k, b in enumerate(rest)}}


def python_groups(texts):
    first, second, of = Tokenizer.from_file(BYTE_FILE), sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE), letters()
    first.encode_special_tokens = True
    out = []
    for text in texts:
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        spelled = [[bytes(of[c] for c in first.id_to_token(k)) for k in a],
                   [bytes([int(second.id_to_piece(k)[3:5], 16)]) if second.is_byte(k) else second.id_to_piece(k).replace("▁", " ").encode() for k in b]]
        if not text or any(b"".join(x) != (" " + text).encode() for x in spelled):
            out.append(None)
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in spelled]
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        out.append((a, b, groups))
    return out


@pytest.mark.parametrize("wide, entries, chars", [(alignment.WIDE, alignment.ENTRIES, parts.SLICE_CHARS), (6, 50, 300)])
def test_links_against_all_pairs(spark, monkeypatch, documents, wide, entries, chars):
    monkeypatch.setattr(alignment, "WIDE", wide)
    monkeypatch.setattr(alignment, "ENTRIES", entries)
    monkeypatch.setattr(alignment, "slices", lambda batches, column: parts.slices(batches, column, chars))
    chance = random.Random(3)
    texts = STRANGE * 2 + ["".join(chance.choices(SIGNS, k=chance.randint(0, 40))) for _ in range(150)]
    texts += [r.text for r in documents.limit(40).collect() if len(r.text or "") < 3000]
    known = python_groups(texts)
    counts, most = collections.Counter(), collections.Counter()
    for one in filter(None, known):
        counts.update({(x, y) for a, b in one[2] for x in a for y in b})
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    want = collections.Counter()
    for k, one in enumerate(known):
        a, b, groups = one or ([], [], [])
        pairs = [(x, y) for p, q in groups for x in p for y in q]
        want[k, len(a), len(b), len(groups), len(pairs), sum(counts[p] == most[p[0]] for p in pairs), sum(counts[p] for p in pairs),
             ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)] += 1
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id bigint, text string, pair string").repartition(3)
    assert collections.Counter(map(tuple, alignment.links(docs, BYTE_FILE, PIECE_FILE).collect())) == want


def test_alignment_of_awkward_rows(spark, awkward, empty):
    got = alignment.links(awkward, BYTE_FILE, PIECE_FILE).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r.doc_id for r in awkward.collect())
    assert all((r.n_links == 0) == (r.groups == "") for r in got)
    assert alignment.links(empty, BYTE_FILE, PIECE_FILE).count() == 0


def test_texts_are_aligned_once(spark, documents):
    """The step behind the pair counts gets the parts of a slice in numbers, not its texts."""
    read = alignment.links(documents, BYTE_FILE, PIECE_FILE)._jdf.queryExecution().analyzed().toString()
    assert "packed#" in read and "text#" not in read


def test_what_a_slice_leaves():
    aligner = alignment.Aligner(tuple(file_digest(f)[0] for f in (BYTE_FILE, PIECE_FILE)))
    for texts in (STRANGE, [None], ["", "a b"], ["x" * 70_000]):
        linked = alignment.Linked.of(pa.array(texts, pa.string()), aligner)
        again = alignment.Linked.unpacked(linked.packed())
        assert again.n_parts == linked.n_parts
        assert all(np.array_equal(getattr(again, name), getattr(linked, name)) for name in alignment.Linked.ARRAYS)


# Token files

@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2000), min_size=1, max_size=60), st.integers(6, 12))
def test_code_lengths_are_the_best(counts, limit):
    counts = np.array(counts)
    bits = token_files.code_lengths(counts, limit)
    used = [int(c) for c in counts if c]
    assert ((bits > 0) == (counts > 0)).all() and bits.max(initial=0) <= limit
    if len(used) < 2:
        return
    assert sum(Fraction(1, 2 ** int(b)) for b in bits if b) == 1
    heap, cost = list(used), 0  # without a limit
    heapq.heapify(heap)
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        cost += pair
        heapq.heappush(heap, pair)
    assert (bits * counts).sum() >= cost
    if token_files.code_lengths(counts, 24).max() <= limit:
        assert (bits * counts).sum() == cost


def test_limited_codes_are_the_best():
    """Against all code lengths that a prefix code can have."""
    import itertools
    for counts in ([1, 1, 2, 4, 9], [1, 2, 4, 8, 16], [5, 5, 5, 1, 90]):
        best = min(sum(c * b for c, b in zip(counts, bits)) for bits in itertools.product((1, 2, 3), repeat=5)
                   if sum(Fraction(1, 2 ** b) for b in bits) <= 1)
        assert (token_files.code_lengths(np.array(counts), 3) * np.array(counts)).sum() == best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=400), min_size=1, max_size=5))
def test_blocks_round_trip(blocks):
    counts = np.bincount([x for b in blocks for x in b])
    bits = token_files.code_lengths(counts)
    codes, ids, width = token_files.canonical(bits)
    packed = [(len(b), *token_files.pack(np.array(b, np.uint32), bits, codes)) for b in blocks]
    assert token_files.unpack(packed, ids, width).tolist() == [x for b in blocks for x in b]
    for (n, marks, _) in packed:
        assert len(marks) == 4 * -(-n // token_files.STRIDE)


@pytest.mark.parametrize("block", [token_files.BLOCK_IDS, 50])
def test_files_round_trip(spark, monkeypatch, documents, block):
    monkeypatch.setattr(token_files, "BLOCK_IDS", block)
    rows = [(r.doc_id, r.text, "x") for r in documents.limit(60).collect()] + [(None, "no id", "x"), (None, None, "y")]
    rows += [(10_000 + k, t, "z") for k, t in enumerate(STRANGE)] + [(7_000, "same id", "1"), (7_000, "same id, other text", "2")] + [(9_000, "hot", "3")] * 300
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, part string").repartition(5)
    path = scratch_path(spark, "files")
    token_files.write(docs, BYTE_FILE, path)
    got = token_files.read(spark, path).collect()
    encode = Tokenizer.from_file(BYTE_FILE)
    want = collections.Counter((d, (*encode.encode(t or "", add_special_tokens=False).ids, 2)) for d, t, _ in rows)
    assert collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start and r.n_tokens == len(r.ids) // 4
        start += r.n_tokens
    order = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    digests = token_files.read(spark, path, digests=True)
    assert collections.Counter((r.start, r.ids_crc32) for r in digests.collect()) == collections.Counter((r.start, zlib.crc32(r.ids)) for r in got)


def test_files_of_awkward_rows(spark, awkward, empty):
    for docs in (awkward, empty):
        path = scratch_path(spark, "files")
        token_files.write(docs, BYTE_FILE, path)
        assert token_files.read(spark, path).count() == docs.count()
