"""SimHash near-dedup against brute force over all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from tracewright.llm import simhash
from tracewright.operators.components import components
from tracewright.session import table

SCHEMA = "doc_id long, text string, fp string, component_id string, label string"


def brute_fingerprint(text: str | None) -> int:
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def result(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_matches_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(simhash.near_duplicates(docs)) == brute(rows)


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    rows = [(5, None), (3, ""), (9, " \t\n"), (1, "one two"), (2, "ONE\x0btwo "), (7, "É one two three four"), (None, "one two"), (7, "é one two three four"), (4, long), (6, long + " end"), (4, long)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    assert result(simhash.near_duplicates(df)) == brute(rows)
    empty = simhash.near_duplicates(df.limit(0))
    assert empty.columns == ["doc_id", "fingerprint", "component_id"] and empty.count() == 0


def test_deduplicate_edge_cases(spark):
    """Rows without an id and rows of one id, with texts of their own and without; empty texts; clashing names."""
    long = " ".join(f"w{i}" for i in range(5000))
    rows = [(5, None), (3, ""), (9, " \t\n"), (1, "one two"), (2, "ONE\x0btwo "), (7, "É one two three four"), (None, "one two"), (7, "a text that has nothing in common"), (4, long), (6, long + " end"), (4, long)]
    rows += [(None, "a lonely text without any id at all"), (None, "another lonely text that has no id"), (None, "another lonely text that has no id"), (8, "x" * 50_000), (5, "x y z")]
    df = spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], SCHEMA + ", _near_id int")
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(brute_kept(rows), key=repr)
    assert simhash.deduplicate(df.limit(0)).count() == 0


def test_links_connect_what_all_pairs_connect(spark):
    """Random clusters, also where every key counts as too full and the midpoints do the work."""
    rng = random.Random(3)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(40):
            fps.add(x)
            for _ in range(rng.randrange(1, 7)):
                x ^= 1 << rng.randrange(64)
    arr = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in arr]
    group = {x: x for x in arr}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(arr):
        for b in arr[:i]:
            if (a ^ b).bit_count() <= 4:
                group[find(a)] = find(b)
    want = {frozenset(x for x in arr if find(x) == r) for r in arr if find(r) == r}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for most in (65_536, 9):
        label = {r.node: r.label for r in components(simhash.links(df, most=most)).collect()}
        got = {}
        for s, x in zip(signed, arr, strict=True):
            got.setdefault(label.get(s, s), set()).add(x)
        assert {frozenset(v) for v in got.values()} == want


def test_majority_over_chunks(monkeypatch):
    monkeypatch.setattr(simhash, "_CHUNK", 5)
    rng = np.random.default_rng(1)
    sizes = np.array([0, 3, 0, 12, 1, 1, 5, 0])
    h = rng.integers(-(2**63), 2**63, sizes.sum())
    got = simhash.majority(h, np.cumsum(sizes))
    at = np.concatenate([[0], np.cumsum(sizes)])
    for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
        want = sum(1 << i for i in range(64) if 2 * sum(int(x) >> i & 1 for x in h[a:b]) > b - a)
        assert int(got[k]) == want


def brute_kept(rows: list[tuple[int | None, str | None]]) -> list[tuple[int | None, str | None]]:
    """Of each component of pairs at a similarity of 0.8 over five-word shingles, the row with the smallest id."""

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {" ".join(w)} - {""}

    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]

    def first(r):
        h = 42 if r[1] is None else xxhash.xxh64(r[1].encode(), seed=42).intdigest()
        return r[0] is None, r[0] or 0, h - (1 << 64) if h >> 63 else h

    return [min((rows[i] for i in range(len(rows)) if group[i] == g), key=first) for g in set(group)]


def test_deduplicate_matches_brute_force_jaccard(spark, monkeypatch):
    """Copies with more and more words changed, near 0.8 on either side; also where keys count as too full."""
    rng = random.Random(8)
    rows, shared = [], " ".join(f"s{i}" for i in range(30))
    for k in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(40, 200))]
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 25))):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w) + (f" {shared}" if k % 2 else "")))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(d for d, _ in brute_kept(rows))
    assert 12 < len(want) < len(rows)
    assert sorted(r.doc_id for r in simhash.deduplicate(df).collect()) == want
    near_copies = simhash.jaccard.near_copies
    monkeypatch.setattr(simhash.jaccard, "near_copies", lambda *args: near_copies(*args, full=2))
    assert sorted(r.doc_id for r in simhash.deduplicate(df).collect()) == want


def test_sketches_rule_nothing_alike_out():
    rng = np.random.default_rng(5)
    for _ in range(300):
        base = rng.integers(-(2**63), 2**63, rng.integers(1, 700))
        x = np.unique(base[: rng.integers(1, len(base) + 1)])
        y = np.unique(np.concatenate([base[rng.integers(0, len(base)) :], rng.integers(-(2**63), 2**63, rng.integers(0, 50))]))
        apart = len(np.setxor1d(x, y))
        for places in (0, 512):
            assert simhash.jaccard.differing(simhash.jaccard.sketch(x, places), simhash.jaccard.sketch(y, places)) <= apart


def test_deduplicate_links_by_fingerprints_first(spark, monkeypatch):
    """The links of the fingerprints alone join the texts that differ in few bits, and only pairs that are alike."""
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base), " ".join([*base, "end"]), " ".join([*base[200:], *["spam spam spam spam spam"] * 80]), " ".join([*base[:40], *["spam spam spam spam spam"] * 80])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = simhash.jaccard._pairs
    monkeypatch.setattr(simhash.jaccard, "_pairs", lambda *a: lambda batches: (b.slice(0, 0) for b in pairs(*a)(batches)))
    assert sorted(r.doc_id for r in simhash.deduplicate(df).collect()) == [0, 2, 3]
