"""Sketches against sets of paragraph digests."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tracewright.llm import iblt
from tracewright.session import table


def sets(texts):
    value, owner = iblt.digests([t.encode() for t in texts])
    return [set(value[owner == k].tolist()) for k in range(len(texts))]


def dice(a, b):
    return 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [t or "" for _, t in rows]
    follow = texts[1:] + texts[:1]
    edited = [t[: len(t) - len(t) // 3] + f[: len(t) // 3] for t, f in zip(texts, follow, strict=True)]
    s, e = sets(texts), sets(edited)
    return sorted(((r[0], len(t), hashlib.sha256(x.encode()).hexdigest(), round(dice(s[k], e[k]), 9), round(dice(s[k], s[(k + 1) % len(s)]), 9)) for k, (r, t, x) in enumerate(zip(rows, texts, edited, strict=True))), key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()), key=repr)


def test_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    assert result(iblt.fingerprint(docs)) == want
    assert result(iblt.fingerprint(docs.repartition(7), buckets=150)) == want
    assert np.mean([r[3] for r in want]) > 0.5 and np.mean([r[4] for r in want]) < 0.1


def test_edge_cases(spark):
    long = " ".join(str(random.Random(5).random()) for _ in range(1)) + "y" * 50_000
    rows = [(5, None), (4, ""), (3, "abc\n\ndef"), (3, "abc\n\ndef"), (9, "ü" * 7), (None, "no id"), (2, long), (-8, "last\n"), (3, "another of three")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, bucket string, place int")
    assert result(iblt.fingerprint(df)) == brute(rows)
    assert result(iblt.fingerprint(df.where("doc_id = 9"))) == brute([rows[4]])
    assert iblt.fingerprint(df.limit(0)).count() == 0
    by = {}
    for r in iblt.fingerprint(df).collect():
        by.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    assert len(by[3, 8]) == 1


def test_fingerprints_alone_recover_small_edits():
    base = [f"paragraph number {i} says {i * i}" for i in range(200)]
    near = base[:100] + ["something new"] + base[101:]
    texts = ["\n".join(base), "\n".join(near), "\n".join(reversed(near[:60]))]
    value, owner = iblt.digests([t.encode() for t in texts])
    a, b, c = iblt.fingerprint_texts(value, owner, 3)
    s = sets(texts)
    assert iblt.subtract_texts(a, a) == 1.0
    assert iblt.subtract_texts(a, b) == pytest.approx(dice(s[0], s[1]))
    assert iblt.subtract_texts(a, c) is None


def test_stretches_do_not_change_paragraphs(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh \n") for _ in range(n)) for n in (0, 1, 9, 5000, 30_000)]
    want = sets(texts)
    monkeypatch.setattr(iblt, "STRETCH", 4096)
    assert sets(texts) == want
