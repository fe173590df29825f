"""Quality rules against a plain Python version."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pytest

from tracewright.llm import quality, registry
from tracewright.session import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COMMON = [w for group in quality.COMMON for w in group]


def base(text):
    text = text or ""
    w = WORD.findall(text)
    seen = defaultdict(list)
    for i in range(len(w) - 4):
        seen[tuple(w[i : i + 5])].append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, rep = len(w), len(covered)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), rep, n < 10 or 100 * rep > 20 * n


def histograms(text):
    text = text or ""
    c = Counter(text)
    chars = [sum(c[x] for x in of) for of in quality.CLASSES.values()]
    chars += [len(text) - sum(chars), len(text.encode()) - len(text)]
    w = Counter(WORD.findall(text))
    common = [w[x] for x in COMMON]
    return chars, [sum(w.values()) - sum(common), *common]


def shares(xs):
    return [x / max(sum(xs), 1) for x in xs]


def distance(p, q):
    h = lambda xs: sum(x * math.log2(x) for x in xs if x > 0)
    return math.sqrt(max(0.0, (h(p) + h(q)) / 2 - h([(a + b) / 2 for a, b in zip(p, q, strict=True)])))


def brute(rows, rules=quality.Rules()):
    sums = {}
    for _, text, lang in rows:
        if lang in rules.languages and not base(text)[-1]:
            for k, xs in enumerate(histograms(text)):
                old = sums.setdefault(lang, [None, None])
                old[k] = xs if old[k] is None else [a + b for a, b in zip(old[k], xs, strict=True)]
    known = [(shares(a), shares(b)) for a, b in sums.values() if sum(a) and sum(b)]
    out = []
    for d, text, _ in rows:
        b = base(text)
        far = False
        if known and b[0] >= rules.judged_words:
            c, w = map(shares, histograms(text))
            _, x, y = min((distance(c, p) + distance(w, q), distance(c, p), distance(w, q)) for p, q in known)
            more = rules.allowance / b[0]
            far = x > math.sqrt(rules.most_chars**2 + more) or y > math.sqrt(rules.most_words**2 + more)
        out.append((d, *b, not b[5] and not far))
    return sorted(out, key=repr)


def result(df):
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    want = brute([(r.doc_id, r.text, r.lang) for r in docs.collect()])
    assert result(quality.assess(docs)) == want
    assert any(not r[-1] and not r[-2] for r in want) and any(r[-1] for r in want)


def test_edge_cases(spark):
    junk = " ".join(f"w{i}%%%" for i in range(60))
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n\t\x0b ", None), (4, "a b c d e " * 30, "en"), (5, "v Av0.#\n! x é 日本 " * 3, "xx"), (6, junk, "de"), (None, "one two three four five six seven eight nine ten", "fr")]
    rows += [(7, "one two three four five six seven eight nine ten\n" * 2 + "x\n \nx\n\nx ", "fr"), (8, " ".join(f"w{i}" for i in range(30_000)), "es"), (8, " ".join(f"w{i % 900}" for i in range(9000)), "es"), (9, "of the and " * 2 + " ".join(f"the w{i}" for i in range(50)), "en")]
    df = spark.createDataFrame([(d, t, la, "x", 1) for d, t, la in rows], "doc_id long, text string, lang string, kept string, _w int")
    assert result(quality.assess(df)) == brute(rows)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    want = sorted((r[0] for r in brute(rows) if r[-1]), key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == want
    assert quality.assess(df.limit(0)).count() == 0
    assert result(quality.assess(df.where("lang = 'xx'"))) == brute([rows[4]])


@pytest.mark.parametrize("query", ["op9_quality"])
def test_no_python_in_the_plan(spark, sf, query):
    plan = registry.QUERIES[query](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
