"""Shards: what goes in comes out, sizes grow to the target, commits are whole."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracewright.llm import registry, shards
from tracewright.llm.shards import CommitConflict, Shard, ShardTable
from tracewright.session import fresh_path, table


def test_append_compact_read(spark, sf):
    docs = table(spark, sf, "documents")
    t = ShardTable(spark, fresh_path(spark, "t"), target=60_000, fan_in=3)
    for k in range(8):
        t.append(docs.where(f"pmod(doc_id, 8) = {k}").coalesce(1))
    assert t.version() == 8 and len(t.manifest()) == 8
    before = t.manifest()
    v = t.compact()
    after = t.manifest()
    assert v > 8 and len(after) < len(before) and not t.plan(after)
    want = sorted(map(tuple, docs.collect()))
    assert sorted(map(tuple, t.read().collect())) == want
    assert t.read().columns == docs.columns
    assert t.read(3).count() == docs.where("pmod(doc_id, 8) < 3").count()
    assert t.vacuum() > 0 and t.compact() == v
    assert sorted(map(tuple, t.read().collect())) == want
    with pytest.raises(Exception):
        t.manifest(3)


def test_commits_are_whole(spark, sf):
    root = fresh_path(spark, "t")
    a, b = ShardTable(spark, root), ShardTable(spark, root)
    rows = spark.createDataFrame([(1, None, ""), (1, None, ""), (None, "x" * 100_000, "é")], "doc_id long, text string, _row string")
    a.append(rows.coalesce(1))
    base = b.version()
    a.append(rows.coalesce(1))
    with pytest.raises(CommitConflict):
        b._commit(base, b.head(base))
    assert sorted(map(repr, b.read().collect())) == sorted(map(repr, rows.union(rows).collect()))
    rows.write.parquet(f"{root}/data/lost")  # a job that didn't get to its commit
    assert a.read().count() == 6
    assert a.append(rows.limit(0)) == 2 and a.compact() == 2


def test_plan_merges_similar_sizes(spark):
    t = ShardTable(spark, fresh_path(spark, "t"), target=1000, fan_in=4)
    some = [Shard(f"s{i}", 1, n) for i, n in enumerate([100, 110, 900, 3, 120, 90, 4, 480, 470, 60, 5000])]
    runs = t.plan(some)
    assert [[s.bytes for s in r] for r in runs] == [[100, 110, 120, 90]]
    assert [[s.bytes for s in r] for r in t.plan([Shard(f"s{i}", 1, 400) for i in range(5)])] == [[400, 400], [400, 400]]


def test_empty_tables(spark, sf):
    docs = table(spark, sf, "documents")
    t = ShardTable(spark, fresh_path(spark, "t"))
    with pytest.raises(ValueError):
        t.read()
    assert t.append(docs.limit(0)) == 1 and t.append(docs.limit(0)) == 1
    assert t.compact() == 1 and t.vacuum() >= 0
    assert t.read().count() == 0 and t.read().schema == docs.schema
    u = ShardTable(spark, fresh_path(spark, "t"))
    assert u.append_arrivals(docs.limit(0), F.lit(0)) == 1 and u.read().schema == docs.schema


def test_query_over_an_empty_table(spark, sf, tmp_path):
    table(spark, sf, "documents").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    out = registry.op7_sharding(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "lang", "source", "n_chars", "text_sha256"]


def test_arrivals_are_commits(spark, sf):
    docs = table(spark, sf, "documents")
    t = ShardTable(spark, fresh_path(spark, "t"), target=1 << 20)
    assert t.append_arrivals(docs.repartition(6), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3)) == 3
    assert [t.read(v).count() for v in (1, 2, 3)] == [docs.where("doc_id % 3 = 0").count(), docs.where("doc_id % 3 < 2").count(), docs.count()]
    t.compact()
    assert len(t.manifest()) < 4 and sorted(map(tuple, t.read().collect())) == sorted(map(tuple, docs.collect()))


def test_vacuum_spares_announced_files(spark, sf):
    docs = table(spark, sf, "documents")
    t = ShardTable(spark, fresh_path(spark, "t"))
    t.append(docs)
    name = t._announce()
    docs.write.parquet(f"{t.root}/data/{name}")  # another writer, before its commit
    docs.write.parquet(f"{t.root}/data/unannounced")
    assert t.vacuum() >= 1 and t._measured(f"{t.root}/data/{name}") and not t._measured(f"{t.root}/data/unannounced")
    t._add(docs.schema, t._measured(f"{t.root}/data/{name}"), 5)
    t._withdraw(name)
    t.vacuum()
    assert t.read().count() == 2 * docs.count()
    lost = t._announce()
    docs.write.parquet(f"{t.root}/data/{lost}")
    assert t.vacuum(grace=0) >= 1 and not t._measured(f"{t.root}/data/{lost}")


def test_oversize_shards_are_split(spark):
    rows = spark.range(120_000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
    root = fresh_path(spark, "t")
    ShardTable(spark, root, target=16 << 20).append(rows.coalesce(1))
    t = ShardTable(spark, root, target=1 << 20)
    assert len(t.manifest()) == 1 and t.oversize(t.manifest())
    t.compact()
    assert len(t.manifest()) > 2 and t.read().count() == rows.count()
    assert t.read().exceptAll(rows).count() == 0


def test_settled_shards_leave_the_manifest(spark, sf, monkeypatch):
    monkeypatch.setattr(shards, "LISTED", 2)
    docs = table(spark, sf, "documents")
    t = ShardTable(spark, fresh_path(spark, "t"), target=60_000, fan_in=2)
    t.append(docs.repartition(8))
    t.compact()
    head = t.head()
    assert head.lists and len(head.open) < 2 and t.vacuum() > 0
    t.append(docs.limit(3).coalesce(1))
    assert t.head().lists == head.lists
    assert sorted(map(tuple, t.read().collect())) == sorted(map(tuple, docs.union(docs.limit(3)).collect()))
