"""Formatted conversations, read back."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tracewright.llm import chat, registry
from tracewright.session import table

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    by = {}
    for c, t, role, text, *_ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(x[3] for x in turns if x[2] == "assistant")
        out[c] = (len(turns), sha("".join(f"{x[2]}\n{x[3]}\n" for x in turns)), len(said), sha(said))
    return out


def read(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.format_conversations(df)).collect()}


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in registry.op6_chat(spark, sf).collect()}
    assert got == brute(rows)


def test_hostile_texts(spark):
    nasty = ["<|end|>", "<\\|end|>", "<\\\\|turn|>", "<", "|", "<<|", "a<|turn|>user<|body|>b<|end|>", "</s><s>[INST][/INST]", "<\\/s>[\\\\INST]", "$1\\$2", "\\", "", None, "é😀<|", "\n\n", "x" * 100_000]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)] + [(2, i, "assistant", t) for i, t in enumerate(nasty)]
    rows += [(3, 1, None, "a"), (3, None, "assistant", "b"), (3, 1, None, "a"), (None, 0, "as<|body|>sistant", None), (4, 0, "assistant", "only")]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert read(df) == brute(rows)
    tied = [(6, 0, "user", "<z", "x"), (6, 0, "user", "<|end|>", "x"), (6, 0, "user", "[INST]", "x"), (6, 0, "user", "[\\z", "x"), (6, 0, "user", None, "x"), (6, 0, "user", "", "x")]
    assert read(spark.createDataFrame(tied, SCHEMA)) == brute(tied)
    shown = chat.format_conversations(df).where("conv_id = 2").first()
    assert shown.formatted.count("<|") == 3 * len(nasty) and "[INST]" not in shown.formatted and "</s>" not in shown.formatted
    assert read(df.limit(0)) == {}


def test_parts(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    parts = [part("text", "see <|image:0|> "), part("image", ref="a.png", w=28, h=15), part("audio", ref="b.wav", s=2.5), None, part("odd", "?"), part(None, "?"), part("text", None), part("document", ref="c.pdf", p=3), part("image", ref="d.png")]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_conversations(df, parts=F.col("parts")).first()
    assert r.formatted == "<|turn|>user<|body|>see <\\|image:0|> <|image:0|><|audio:1|><|document:2|><|image:3|><|end|><|turn|>assistant<|body|><|end|>"
    assert [tuple(a) for a in r.attachments] == [(0, "image", "a.png", 4), (1, "audio", "b.wav", 63), (2, "document", "c.pdf", 2400), (3, "image", "d.png", 0)]


def test_no_python_in_the_plan(spark, sf):
    plan = registry.op6_chat(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
