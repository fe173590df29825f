"""The BPE codec against the tokenizers library, and as an exact round trip."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracewright.llm import bpe
from tracewright.session import table

PATH = public_tokenizers.path("byte_bpe_50k.json")
THEIRS = Tokenizer.from_file(PATH)
OURS = bpe.codec(PATH)

TEXT = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'stremdlvATZ0９²½éñß́ 　\x1c\x85​")), max_size=60)


@settings(max_examples=600, deadline=None)
@given(TEXT)
@example("<|endoftext|> a<|endoftext|><|endoftext|>b <|endoftext")
@example("I'll we've DON'T  \n\n x \t")
@example("a" * 1000 + " " * 300 + "ß" * 400)
def test_matches_the_library(text):
    want = THEIRS.encode(text, add_special_tokens=False).ids
    assert OURS.encode(text) == want
    assert OURS.decode(want) == THEIRS.decode(want, skip_special_tokens=False) == text


@given(st.binary(min_size=1, max_size=120))
def test_scan_and_heap_agree(piece):
    assert OURS._scan(piece) == OURS._heap(piece)


def expected(text):
    ids = THEIRS.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(THEIRS.decode(ids, skip_special_tokens=False))


def test_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = {r[0]: tuple(r)[1:] for r in bpe.round_trip(docs, PATH).collect()}
    assert got == {k: expected(v) for k, v in text.items()}


def test_edge_cases(spark):
    texts = [None, "", " ", "a" * 300_000, "word " * 50_000, "same", "same", "<|endoftext|>"]
    df = spark.createDataFrame([(i if i else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, ids int")
    got = sorted((tuple(r) for r in bpe.round_trip(df, PATH).collect()), key=lambda r: r[0] or 0)
    assert got == [(i or None, *expected(t)) for i, t in enumerate(texts)]
    assert bpe.round_trip(df.limit(0), PATH).count() == 0


def test_unknown_ids_are_an_error():
    with pytest.raises(KeyError):
        OURS.decode([10**9])


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        bpe.codec(public_tokenizers.path("word_bpe_49k.json"))
