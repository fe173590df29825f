"""Line dedup against a plain Python version, and its two joins against each other."""

from __future__ import annotations

from collections import Counter

from tracewright.llm import line_dedup
from tracewright.session import table

SPACES = " \t\n\x0b\x0c\r"


def brute(rows, ratio, least_pages):
    pages, held = Counter(), Counter()
    for _, host, text in rows:
        pages[host or ""] += 1
        for x in {x.strip(SPACES) for x in (text or "").split("\n")} - {""}:
            held[host or "", x] += 1
    bad = {(h, x) for (h, x), n in held.items() if n >= least_pages and n > ratio * pages[h]}
    out = []
    for d, host, text in rows:
        lines = None if text is None else text.split("\n")
        kept = [x for x in lines or [] if (host or "", x.strip(SPACES)) not in bad]
        solid = lambda xs: sum(bool(x.strip(SPACES)) for x in xs)
        out.append((d, host, None if text is None else "\n".join(kept), solid(lines or []), solid(lines or []) - solid(kept)))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "source", "text", "_n_lines", "_n_dropped").collect()), key=repr)


def test_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    for limits in ({}, {"ratio": 0.1, "least_pages": 2}):
        want = brute(rows, limits.get("ratio", line_dedup.RATIO), limits.get("least_pages", line_dedup.LEAST_PAGES))
        assert result(line_dedup.drop_boilerplate(docs, **limits)) == want
        assert result(line_dedup.drop_boilerplate(docs, most_broadcast=-1, **limits)) == want
        assert result(line_dedup.drop_boilerplate(docs, most_broadcast=-1, part=3, **limits)) == want
    assert any(r[4] for r in want)


def test_edge_cases(spark):
    rows = [(i, "a", f"menu\n own {i}\n\nmenu \nlast") for i in range(30)] + [(100 + i, None, "menu\nmine") for i in range(3)]
    rows += [(200, "a", None), (201, "a", ""), (202, "a", "menu"), (202, "a", "menu"), (None, "a", "\tmenu\r\nleft"), (203, "b", "menu\n" * 3 + "x" * 200_000)]
    df = spark.createDataFrame([(*r, "x", 2) for r in rows], "doc_id long, source string, text string, host string, bad int")
    assert result(line_dedup.drop_boilerplate(df)) == brute(rows, 0.05, 3)
    assert not any("menu" in (r.text or "") for r in line_dedup.clean(df).where("source is null").collect())  # a host of three pages
    out = line_dedup.clean(df)
    assert out.columns == df.columns and out.count() == len(rows)
    assert line_dedup.clean(df.limit(0)).count() == 0
