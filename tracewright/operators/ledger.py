"""A tamper-evident ledger: each row's hash covers the one before it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64
FIELDS = ["email_id", "timestamp", "actor", "action", "detail", "evidence_sha256"]


def material(prev: Column, fields: list[str] = FIELDS, seq: str = "seq") -> Column:
    """What a row's hash covers; nulls count as ''."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat_ws("|", prev, text(seq), *[text(c) for c in fields])


def chain(events: DataFrame, ledger: str, fields: list[str] = FIELDS, seq: str = "seq") -> DataFrame:
    """(ledger, seq, prev_hash, hash) of every event: a fold over each ledger in order of seq.

    A chain is one after the other by nature, so a ledger is folded by one task; it streams, in memory bounded by an
    Arrow batch, and different ledgers are folded side by side. Verification needs no such order.
    """
    rows = events.select(F.col(ledger).cast("string").alias("ledger"), F.col(seq).cast("long").alias("seq"), material(F.lit(""), fields, seq).alias("rest"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, head = object(), GENESIS
        for batch in batches:
            before, hashes = [], []
            for name, rest in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if name != of:
                    of, head = name, GENESIS
                before.append(head)
                head = hashlib.sha256((head + rest).encode()).hexdigest()
                hashes.append(head)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(before, pa.string()), pa.array(hashes, pa.string())], names=["ledger", "seq", "prev_hash", "hash"])

    return rows.repartition("ledger").sortWithinPartitions("ledger", "seq").mapInArrow(fold, "ledger string, seq long, prev_hash string, hash string")


def verify(chained: DataFrame, ledger: str, fields: list[str] = FIELDS, seq: str = "seq") -> DataFrame:
    """(ledger, valid, head): every row is checked by itself and against the one before; the whole ledger holds or not.

    Where it doesn't, head is the hash that the first bad row should have been built on.
    """
    w = Window.partitionBy(ledger).orderBy(seq)
    prev = F.coalesce(F.lag("hash").over(w), F.lit(GENESIS))
    n = F.row_number().over(w)
    good = (F.col("prev_hash") == prev) & (F.col(seq) == n) & (F.sha2(material(F.col("prev_hash"), fields, seq).cast("binary"), 256) == F.col("hash"))
    checked = chained.withColumns({"_prev": prev, "_n": n, "_good": good})
    bad = F.min(F.when(~F.col("_good"), F.struct("_n", "_prev")))
    return checked.groupBy(ledger).agg(F.bool_and("_good").alias("valid"), F.coalesce(bad["_prev"], F.max_by("hash", "_n")).alias("head"))
