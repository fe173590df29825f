"""Streams from files into alerts: each case once, however often a batch or a case comes."""

from __future__ import annotations

from tracewright.streaming import alerts as A

SCHEMA = "email_id long, analyzed_at timestamp, risk int, category string, campaign_id long"


def cases(spark, ids, risk=80):
    return spark.createDataFrame([(i,) for i in ids], "email_id long").selectExpr("email_id", "timestamp'2026-09-01 00:00:00' + make_interval(0, 0, 0, 0, 0, email_id) AS analyzed_at", f"{risk} + cast(email_id % 3 as int) AS risk", "'Phishing' AS category", "email_id % 2 AS campaign_id")


def test_alerts_are_raised_once(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    cases(spark, range(20)).coalesce(2).write.parquet(source)
    for more in (range(10, 30), range(30, 32)):
        A.start(A.alerts(A.read_cases(spark, source, SCHEMA, 1)), state, A.table_sink(out)).awaitTermination()
        cases(spark, more).coalesce(1).write.mode("append").parquet(source)
    A.start(A.alerts(A.read_cases(spark, source, SCHEMA, 1)), state, A.table_sink(out)).awaitTermination()
    got = sorted(r.email_id for r in spark.read.parquet(out).collect())
    assert got == list(range(32))


def test_batch_written_again_replaces_itself(spark, tmp_path):
    sink = A.table_sink(str(tmp_path / "t"))
    for _ in range(2):
        sink(cases(spark, range(5)), 7)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5


def test_sweep_and_bursts(spark, tmp_path):
    kept = str(tmp_path / "retention")
    spark.sql("SELECT id AS email_id, timestamp'2026-09-01 00:00:03' + make_interval(0, 0, 0, 0, 0, 0, id) AS expires_at, cast(null AS timestamp) AS frozen_at, cast(null AS timestamp) AS purged_at FROM range(10)").write.parquet(kept)
    A.sweep_sink(spark, kept, str(tmp_path / "due"))(cases(spark, [0]).selectExpr("*", "1 AS x").withColumn("analyzed_at", __import__("pyspark").sql.functions.expr("timestamp'2026-09-01 00:00:06'")), 1)
    assert spark.read.parquet(str(tmp_path / "due")).count() == 3
    assert A.bursts(cases(spark, range(20))).agg({"n": "sum"}).first()[0] == 20
