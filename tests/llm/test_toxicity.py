"""Toxicity: decoding of obfuscated words, held-out accuracy, and what a score may depend on."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import toxicity
from tracewright.session import table

INSULTS = "idiot moron stupid worthless clown".split()


@pytest.fixture(scope="module")
def small(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").cache()
    labels = table(spark, "/root/testdata/sf0.01", "labels").cache()
    return docs, labels, toxicity.fit(docs, labels)


def test_decoding(small):
    decoder = toxicity.Decoder(toxicity.CharModel(small[2].counts))
    for shown, meant in {"1d10t": "idiot", "m0r0n": "moron", "i d i o t": "idiot", "i.d.i.o.t": "idiot", "s-t-u-p-i-d": "stupid", "idiooooot": "idiot", "st*pid": "stupid", "$tupid": "stupid", "y o u   i d i o t": "you idiot", "w0rthl3ss": "worthless"}.items():
        assert decoder.restore(shown) == meant
    for same in ("", "plain words stay", "12345 +1 (389) 555", "von%%% der###", "É à ô", "stop! hi* (see page) #1"):
        assert decoder.restore(same) == same


def test_quick_test_misses_nothing():
    rng = np.random.default_rng(4)
    alphabet = list("aabI1$0 .-é*Z9|日€øß@_²ıK")
    for _ in range(3000):
        t = "".join(rng.choice(alphabet, rng.integers(1, 14)))
        if toxicity.SUSPICIOUS.search(t):
            assert toxicity.suspicious(np.frombuffer(t.encode("utf-32-le"), np.uint32)).any(), t


def test_stretches_of_any_length(small):
    decoder = toxicity.Decoder(toxicity.CharModel(small[2].counts))
    for n in (3, 115, 130, 5000):
        assert decoder.restore("idi" + "o" * n + "t") == "idiot"
    assert decoder.restore("i d i o t  " * 200).split() == ["idiot"] * 200
    for shown, meant in {"m0r0n5": "morons", "id1ot$": "idiot", "h€ll": "hell", "€vil": "evil"}.items():
        assert toxicity.restore_batch([shown], decoder) == [meant]


def paths(text, gap):
    """Every way through a stretch's lattice, written out: (channel cost, letters)."""
    out = [(0.0, "")]
    for i, ch in enumerate(text):
        low, nxt = ch.lower(), []
        run = any(text[k : k + 3].lower() == low * 3 for k in range(max(0, i - 2), i + 1))
        for cost, said in out:
            if i and ch == gap:
                before, behind = text[i - 1] == gap, text[i + 1 : i + 2] == gap
                if before or not behind:
                    nxt.append((cost, said))
                if not before:
                    nxt.append((cost + (0 if behind else toxicity.GAP), said + " "))
                continue
            for x in toxicity.LEET.get(ch, low):
                more = toxicity.SIGN if ch in toxicity.LEET else 0
                nxt.append((cost + more, said + x))
                if run and said[-1:] == x and x.isalpha():
                    nxt.append((cost + more + toxicity.REPEAT, said))
            if ch in toxicity.LEET and not ch.isdigit():
                nxt.append((cost + toxicity.STRAY, said))
        out = nxt
    return out


def test_viterbi_matches_enumeration(small):
    """The least cost over all ways through the lattice, each weighed whole by the language model."""
    model = toxicity.CharModel(small[2].counts)
    decoder = toxicity.Decoder(model)

    def weigh(said):
        c = [0, 0, *(0 if x == " " else int(toxicity.LETTER[ord(x)]) for x in said), 0]
        return sum(model.cost[a][b][d] for a, b, d in zip(c, c[1:], c[2:], strict=False))

    rng = np.random.default_rng(6)
    texts = [("1d10t", None), ("$$$", None), ("aaa", None), ("aAa1|!", None), ("i d i o t", " "), ("a  b c", " "), ("4.$.$", "."), ("1***1*a", "*")]
    texts += [("".join(rng.choice(list("aoost10$|*"), rng.integers(1, 9))), None) for _ in range(150)]
    texts += [("-".join(rng.choice(list("aos1$"), rng.integers(3, 6))).replace("--", "-"), "-") for _ in range(50)]
    for text, gap in texts:
        cost, said = decoder.best(text, gap)
        ways = [(c + weigh(x), x) for c, x in paths(text, gap)]
        assert abs(cost - min(ways)[0]) < 1e-9, text
        assert any(x == said and c < cost + 1e-9 for c, x in ways), text


def test_counts_match_brute_force(spark):
    texts = ["Abc déf", None, "", "zz"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    got = toxicity.count_characters(df).reshape(27, 27, 27)
    a, b, c = (ord(x) - 96 for x in "abc")
    assert got[a, b, c] == 1 and got[0, a, b] == 1 and got[4, 5, 6] == 1 and got[26, 26, 0] == 1


def test_held_out_accuracy(small):
    docs, labels, _ = small
    out = toxicity.assess(docs, labels).join(labels, "doc_id").toPandas()
    assert (out.held_out == out.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    held = out[out.held_out]
    assert (held[held.toxic == 0].predicted == 0).mean() > 0.98
    assert (held[held.toxic == 1].predicted == 1).mean() > 0.6
    assert ((out.score >= 0.5) == (out.predicted == 1)).all() and out.score.between(0, 1).all()


def test_labels_held_out_are_not_learned(small):
    docs, labels, model = small
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, turned)
    assert again.weights == model.weights and again.slope == model.slope


def test_edge_cases(spark, small):
    labels = small[1]
    rows = [(1, None), (2, ""), (3, "x" * 300_000), (3, "x" * 300_000), (None, "you 1d10t, you m0r0n, you s.t.u.p.i.d"), (4, "a quiet sentence about nothing"), (5, "i d i o t  " * 20_000)]
    df = spark.createDataFrame([(*r, "s", 1.5) for r in rows], "doc_id long, text string, toxic string, score double")
    scored = toxicity.score_column(df, small[2], ["doc_id"]).collect()
    by = {r.doc_id: r.score for r in scored}
    assert by[1] == by[2] == by[4] < 0.5 <= by[None] and by[5] > 0.5 and len(scored) == len(rows)
    for given in (labels.limit(0), labels.where("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        out = toxicity.assess(df, given)
        assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == len(rows)
    assert toxicity.assess(df.limit(0), labels).count() == 0
    kept = toxicity.keep_clean(df, labels)
    assert kept.columns == df.columns


def test_beginnings_give_way_to_longer_ones():
    found = {"tra": (10, 1.0), "tras": (10, 1.0), "trash$": (10, 1.0), "low": (10, 1.0), "lowa": (5, 1.0), "lowb$": (5, 1.0)}
    assert set(toxicity.most_specific(found)) == {"trash$", "low", "lowa", "lowb$"}


def test_signs_of_h_and_c(small):
    decoder = toxicity.Decoder(toxicity.CharModel(small[2].counts))
    for shown in ("s#ame", "(lown", "s{um"):
        assert toxicity.suspicious(np.frombuffer(shown.encode("utf-32-le"), np.uint32)).any()
    assert toxicity.restore_batch(["s#ame", "(lown", "s{um"], decoder) == ["shame", "clown", "scum"]
