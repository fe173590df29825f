"""Packing: every id in one piece, windows gapless and within capacity, against the library's ids."""

from __future__ import annotations

import json
import zlib

import numpy as np
import public_tokenizers
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracewright.llm import packing
from tracewright.session import table

PATH = public_tokenizers.path("word_bpe_49k.json")
THEIRS = Tokenizer.from_file(PATH)


@settings(max_examples=600, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.characters(max_codepoint=0x180), st.sampled_from(" \n'stredmlvÀß½²İΣé×")), max_size=50))
@example("It's THE'RE 'LL ÉÈ ß ſ ŉ ÷×a½b²³ '' ''s .'s")
@example("a<|endoftext|>b <|startoftext|>")
def test_ids_are_the_library_s(text):
    assert packing.token_ids([text], PATH, 2)[0].tolist() == [*THEIRS.encode(text, add_special_tokens=False).ids, 2]


def test_long_texts_are_cut_where_it_does_no_harm(monkeypatch):
    text = "Some words, and ½ ΑΣ more Σ end. " * 200 + "x" * 500 + " λόγος" * 300
    want = THEIRS.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(packing, "MOST_CHARS", 100)
    assert len(packing._stretches(text)) > 30
    assert packing.token_ids([text], PATH, 2)[0].tolist() == [*want, 2]


@given(st.lists(st.integers(1, 512), max_size=200), st.integers(1, 12))
def test_differencing_deals_every_item(sizes, k):
    window = packing.difference(np.array(sizes, np.int64), k)
    assert len(window) == len(sizes) and all(0 <= w < k for w in window)


def test_differencing_is_near_equal():
    rng = np.random.default_rng(0)
    sizes = rng.integers(100, 513, 2000)
    sums = np.bincount(packing.difference(sizes, 100), weights=sizes)
    assert sums.max() - sums.min() < 30
    assert sorted(np.bincount(packing.difference(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])) == [14, 16]


@given(st.lists(st.integers(1, 64), max_size=80))
def test_capacity_holds(sizes):
    window = packing.pack_sizes(np.array(sizes, np.int64), 64)
    assert not sizes or np.bincount(window, weights=sizes).max() <= 64


def verify(texts, rows):
    """texts: of each doc_id, all of its rows."""
    want = {}
    for d, t in texts:
        ids = np.array([*THEIRS.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.setdefault(d, []).append(ids)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == want.keys()
    for d, all_ids in want.items():
        cover = sum(r.length for r in by_doc[d])
        assert cover == sum(map(len, all_ids))
        for r in by_doc[d]:
            assert any(len(ids) == r.doc_tokens and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in all_ids)
        if len(all_ids) == 1:
            at = 0
            for r in sorted(by_doc[d], key=lambda r: r.start):
                assert r.start == at
                at += r.length
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= packing.CAPACITY
    return sum(r.length for r in rows), len(by_seq)


def test_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    out = packing.pack(docs, PATH)
    tokens, n = verify(texts, out.collect())
    assert n * packing.CAPACITY < tokens * 1.02 + packing.CAPACITY
    assert packing.sequences(out).agg({"padding": "sum"}).first()[0] <= n * packing.CAPACITY - tokens


def test_edge_cases(spark):
    texts = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "none"), (4, "w " * 4095), (5, "word " * 30_000), (6, "ΣΑΣ İ")]
    df = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, start int")
    verify(texts, packing.pack(df, PATH).collect())
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_padding_does_not_depend_on_the_split(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    for parts in (1, 8, 64):
        tokens, n = verify(texts, packing.pack(docs.repartition(parts), PATH).collect())
        assert n * packing.CAPACITY < tokens * 1.02


def test_other_vocabularies_encode_whole(tmp_path):
    """A file that cuts words in another way isn't taken for one that this knows."""
    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["normalizer"]["normalizers"].pop()  # no lower-casing
    other = str(tmp_path / "other.json")
    with open(other, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    text = "Some Words and OTHERS, 12"
    assert packing.known(PATH) and not packing.known(other)
    assert packing.token_ids([text], other, 2)[0].tolist() == [*Tokenizer.from_file(other).encode(text, add_special_tokens=False).ids, 2]
