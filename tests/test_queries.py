"""Every query that has SQL gives the rows that DuckDB gives; and small cases of the operators beneath."""

from __future__ import annotations

import datetime
import decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewright import queries
from tracewright.functions import net, scores, text, urls
from tracewright.operators import components, correlate, hops, ledger, models, retention, store

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (bool, str, bytes)) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return None if v != v else round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    theirs = duck.execute(queries.ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in theirs.description], theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def one(spark, column, **values):
    kinds = {str: "string", int: "bigint", float: "double", type(None): "string", bool: "boolean"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("a,want", [("Re: Fwd: [list] Order 1234  now", "order # now"), (None, ""), ("AW: sv: Hi", "hi"), ("x" * 100, "x" * 80)])
def test_subjects(spark, a, want):
    assert one(spark, text.normalize_subject(F.col("a")), a=a) == want


@pytest.mark.parametrize("a,want", [("=1+1", "'=1+1"), ("-x", "'-x"), ("@x", "'@x"), ("\tx", "'\tx"), ("plain", "plain"), (None, "")])
def test_csv_guard(spark, a, want):
    assert one(spark, text.csv_guard(F.col("a")), a=a) == want


@pytest.mark.parametrize("a,want", [("a@x.org", "*@x.org"), ("ab@x.org", "a*@x.org"), ("abc@x.org", "a***c@x.org"), ("none", "none"), ("a@b@x.org", "a***b@x.org"), (None, "")])
def test_mask_email(spark, a, want):
    assert one(spark, text.mask_email(F.col("a")), a=a) == want


@pytest.mark.parametrize("a,want", [("4111111111111111", True), ("4111111111111112", False), ("0", True)])
def test_luhn(spark, a, want):
    assert one(spark, text.luhn(F.col("a")), a=a) == want


@pytest.mark.parametrize("a,b,want", [("0" * 16, "f" * 16, 64), ("0" * 16, "0" * 16, 0), ("8" + "0" * 15, "0" * 16, 1), ("xy", "0" * 16, 64), (None, "0" * 16, 64)])
def test_hamming(spark, a, b, want):
    assert one(spark, text.hamming(F.coalesce("a", F.lit("")), F.col("b")), a=a, b=b) == want


def test_other_text(spark):
    assert one(spark, text.language(F.col("a")), a="नमस्ते दुनिया") == "hi" and one(spark, text.language(F.col("a")), a=None) == "en"
    assert one(spark, text.lexicon_hits(F.col("a"), ["act now", "act", "now"]), a="Act now, ACT or react; now!") == ["act now", "act", "now"]
    assert one(spark, text.tag_map(F.col("a")), a="v=1; d=a.org; d=b.org; x") == {"v": "1", "d": "a.org"}
    assert one(spark, text.shannon(F.col("a")), a="abab") == 1.0 and one(spark, text.shannon(F.col("a")), a="") == 0.0
    assert one(spark, text.shingles(F.col("a")), a="Ä b") == ["ä", "b"] and one(spark, text.shingles(F.col("a")), a="a b c d") == ["a b c", "b c d"]
    assert one(spark, text.mask_name(F.col("a")), a='"Ann van Lee"') == "A. V. L." and one(spark, text.mask_name(F.col("a")), a="--") == "*"
    assert one(spark, text.safe_filename(F.col("a")), a="c:\\x\\a\x01b.PDF") == "ab.PDF" and one(spark, text.file_extension(F.col("a")), a="ab.PDF") == "pdf"


@pytest.mark.parametrize("a,want", [("HTTP://Ex.Org:80", "http://ex.org/"), ("ex.org/a%7eb%2f#x", "http://ex.org/a~b%2F"), ("//ex.org", "http://ex.org/"), ("https://u:p@ex.org:8443/?q=1", "https://u:p@ex.org:8443/?q=1"), ("JavaScript: alert(1)", "javascript:alert(1)"), ("", ""), (None, "")])
def test_urls(spark, a, want):
    assert one(spark, urls.normalize_url(F.col("a")), a=a) == want


@pytest.mark.parametrize("a,want", [("a.b.example.com", "example.com"), ("x.co.uk", "x.co.uk"), ("a.x.co.uk", "x.co.uk"), ("10.0.0.1", "10.0.0.1"), ("", ""), ("local", "local")])
def test_registrable(spark, a, want):
    assert one(spark, urls.registrable(F.col("a")), a=a) == want


@pytest.mark.parametrize("a,want", [("10.1.2.3", True), ("8.8.8.8", False), ("100.64.0.1", True), ("300.1.1.1", None), ("x", None), (None, None)])
def test_private(spark, a, want):
    assert one(spark, net.is_private(net.ip_number(F.col("a"))), a=a) == want


def test_redirects_and_numeric_hosts(spark):
    assert one(spark, urls.redirects(F.col("a")), a="http://a.org/?next=https%3A%2F%2Fb.net%2Fx") and not one(spark, urls.redirects(F.col("a")), a="http://a.org/?next=http://w.a.org/")
    assert one(spark, urls.numeric_form(F.col("a")), a="0x7f.1") and one(spark, urls.numeric_form(F.col("a")), a="3232235777") and not one(spark, urls.numeric_form(F.col("a")), a="10.0.0.1")


@pytest.mark.parametrize("v,found,want", [(0.0, False, "info"), (0.0, True, "low"), (10.0, True, "low"), (25.0, True, "medium"), (50.0, True, "high"), (75.0, True, "critical"), (999.0, True, "critical")])
def test_severity(spark, v, found, want):
    assert one(spark, scores.severity_band(F.col("v"), F.col("f")), v=v, f=found) == want


def test_guards(spark):
    g = lambda c, r, v=0.0: tuple(one(spark, scores.guarded(F.col("c"), F.col("r").cast("int"), F.col("v")), c=c, r=r, v=v))
    assert g("Legitimate", 40) == ("Suspicious", 40) and g("Legitimate", 39) == ("Legitimate", 39) and g("Phishing", 3) == ("Phishing", 60) and g("Suspicious", 3, 0.6) == ("Suspicious", 50)
    assert abs(sum(scores.WEIGHTS.values()) - 1) < 1e-9


def test_delay_skips_hops_without_time(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 0, timestamp'2026-01-01 00:00:00'), (1, 1, null), (1, 2, timestamp'2025-12-31 23:59:00'), (1, 3, timestamp'2026-01-01 07:00:00') AS t(msg_id, idx, ts)")
    got = [r.delay for r in hops.with_delay(df).orderBy("idx").collect()]
    assert got == [None, None, -60.0, 25_260.0]


def test_ledger_finds_any_change(spark):
    rows = spark.createDataFrame([("a", i, f"e{i}") for i in range(1, 6)] + [("b", 1, None)], "ledger string, seq long, email_id string")
    chained = rows.join(ledger.chain(rows, "ledger", ["email_id"]), ["ledger", "seq"])
    check = lambda df: {r.ledger: r.valid for r in ledger.verify(df, "ledger", ["email_id"]).collect()}
    assert check(chained) == {"a": True, "b": True}
    assert not check(chained.withColumn("email_id", F.when(F.col("seq") == 3, "x").otherwise(F.col("email_id"))))["a"]
    assert not check(chained.where("seq <> 3"))["a"]
    assert not check(chained.withColumn("prev_hash", F.when(F.col("seq") == 2, "0").otherwise(F.col("prev_hash"))))["a"]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (3, 3), (5, 5), (2, 1)] + [(100 + i, 101 + i) for i in range(30)] + [(500, 501 + i) for i in range(50)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[3] == 1 and got[9] == 7 and 5 not in got and got[130] == 100 and got[550] == 500
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_strong_or_two_weak(spark):
    ind = spark.createDataFrame([(1, "ip:a"), (2, "ip:a"), (3, "asn:x"), (4, "asn:x"), (5, "asn:y"), (5, "subject:s"), (6, "asn:y"), (6, "subject:s"), (6, "ip:a")], "email_id long, indicator string")
    assert {(r.a, r.b) for r in correlate.related(ind).collect()} == {(1, 2), (1, 6), (2, 6), (5, 6)}
    want = {1: 1, 2: 1, 6: 1, 5: 1}
    assert {r.email_id: r.campaign_id for r in correlate.campaigns(correlate.links(ind)).collect()} == want


def test_near_digests_are_exact(spark):
    import random

    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = base + [b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in (1, 5, 12, 13)]
    df = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)], "id long, digest long")
    want = {(i, j, (values[i] ^ values[j]).bit_count()) for j in range(len(values)) for i in range(j) if (values[i] ^ values[j]).bit_count() <= 12}
    assert {tuple(r) for r in correlate.near_digests(df).collect()} == want


def test_store_edges(spark):
    cases = spark.createDataFrame([], "email_id long, analyzed_at timestamp, risk long, category string, campaign_id long, country string, ip string, subject string, sender string, source_type string")
    assert store.stats(cases).first().total == 0 and store.stats(cases).first().avg_risk == 0
    assert {r.n for r in store.by_category(cases).collect()} == {0}
    assert store.page(cases, 10_000).count() == 0
    assert retention.due(spark.sql("SELECT 1 AS email_id, timestamp'2026-01-01' AS expires_at, cast(null AS timestamp) AS frozen_at, cast(null AS timestamp) AS purged_at"), F.lit("2026-01-02").cast("timestamp")).count() == 1


def test_contributions_add_up(spark):
    rows = models.balanced(spark.createDataFrame([(i, f"bad word {i % 7}" if i % 3 == 0 else f"good text {i % 5}", float(i % 3 == 0)) for i in range(60)], "id long, text string, label double"))
    fitted = models.text_model(256).fit(rows)
    phi = models.linear_contributions(fitted, rows, rows.where("id < 6"), "id", 300).groupBy("id").agg(F.count("*").alias("n"))
    assert phi.count() == 6


@pytest.mark.parametrize("a,want", [("ask mtcn.05@mail3.example.com", []), ("a.mtcn@x.org moneygram-1@x.org", []), ("The MTCN, by MoneyGram.", ["mtcn", "moneygram"]), ("mtcn me@x.org", ["mtcn"])])
def test_names_of_mailboxes_are_no_handles(spark, a, want):
    assert one(spark, text.payment_handles(F.col("a")), a=a) == want


def test_components_of_few_edges_take_one_part(spark, monkeypatch):
    """Also where Spark puts no partitions together, so that rounds don't leave files in proportion to partitions."""
    parts, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: parts.append((out := cut(df)).rdd.getNumPartitions()) or out)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(40, 41)], "a long, b long")
        got = {tuple(r) for r in components.components(edges).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {(i, 0) for i in range(31)} | {(40, 40), (41, 40)}
    assert parts[1:] and set(parts[1:]) == {1}


BC1 = ["bc1qxy2kgdygjrsqtzq2n0yrf2493p83kkfjhx0wlh", "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq", "bc1qrp33g0q5c5txsp9arysrx4k6zdkfs4nce4xj0gdcccefvpysxf3qccfmv3", "bc1p5cyxnuxmeuwuvkwfem96lqzszd02n6xdcjrs20cac6yqjjwudpxqkedrcr", "bc1zw508d6qejxtdg4y5r3zarvaryvaxxpcs"]


@pytest.mark.parametrize("a", ["bc1102e0eb82bd07d4cda47b434b321cadb2e76e", "bc1" + "2e07d4ca" * 4 + "67d4c", "bc1" + "2e07d4ca" * 3 + "67d4c", "bc1" + "7" * 61, "bc1qxy2kgdygjrsqtzq2n0yrf2493p83kkfjhx0wlb", "bc1" + "7" * 100_000])
def test_digests_that_begin_as_an_address_are_no_handles(spark, a):
    assert one(spark, text.payment_handles(F.col("a")), a=f'token = "{a}" or {a}') == []


@pytest.mark.parametrize("a", BC1)
def test_addresses_of_each_length_are_handles(spark, a):
    assert one(spark, text.payment_handles(F.col("a")), a=f'token = "{a}", {a}.') == [f"wallet {a}"]
