"""SimHash near-dedup by pigeonhole blocks.

A fingerprint is cut into seven blocks. Two fingerprints that differ in at most four bits agree in at least three of
the blocks whole, so they meet under at least one of the 35 keys made of three blocks. Under each key the candidates
are verified by Hamming distance. Only distinct fingerprints take part, so exact copies cost nothing, and each key
yields a spanning forest of its links instead of all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import cut, small_batches
from . import jaccard
from .common import hex64, shingles

MAX_BITS = 4
BLOCKS = 7
SHINGLE = 4
#: Words of a shingle where a stage of the pipeline removes near copies.
WIDTH = 5
#: Fingerprints under one key that a task compares; more than these are linked through midpoints instead.
MOST_UNDER_KEY = 65_536
#: The share of fingerprints, one in so many, by which keys are told that may be too full.
SPARSE = 64
#: Parts that a component's fingerprints are dealt to when they learn its smallest id.
SALTS = 16
_CHUNK = 1 << 17


def majority(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive runs of hashes: a bit is 1 if set in over half of the run; 0 for an empty run."""
    counts = np.zeros((len(ends), 64), np.int64)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    for lo in range(0, len(hashes), _CHUNK):
        hi = min(lo + _CHUNK, len(hashes))
        first, last = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi, "left")
        runs = np.arange(first, last)
        runs = runs[np.minimum(ends[runs], hi) > np.maximum(starts[runs], lo)]
        bits = np.unpackbits(hashes[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts[runs] += np.add.reduceat(bits, np.maximum(starts[runs], lo) - lo, axis=0, dtype=np.int32)
    over = counts * 2 > (ends - starts)[:, None]
    return np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0)), dtype=np.int64)
        hashes = np.ascontiguousarray(np.asarray(lists.flatten()), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(majority(hashes, ends).view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) of every row.

    Shingles of `width` words of the text with A-Z lowered, repeats included, are hashed by Spark with XXH64 (seed 42);
    a text of fewer words is one shingle. Null, empty and blank texts have the fingerprint 0. Repeated rows stay.
    """
    small_batches(docs.sparkSession)
    listed = shingles(docs, [F.col(id_col).cast("long").alias("doc_id")], F.col(text_col), width)
    return listed.mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def block_masks(blocks: int = BLOCKS, max_bits: int = MAX_BITS) -> list[int]:
    """The masks of all choices of blocks - max_bits blocks, as signed longs."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    chosen = (sum(c) for c in combinations(single, blocks - max_bits))
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))  # of a signed number numpy counts the magnitude's bits


def forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the fingerprints, breadth first; memory in proportion to their number."""
    out, rest = [], fps
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            near = _bits(rest ^ queue[-1]) <= max_bits
            here = queue.pop()
            if near.any():
                out += [(int(here), int(x)) for x in rest[near]]
                queue += list(rest[near])
                rest = rest[~near]
    return out


def _links(max_bits: int, most: int, step: int = 8):
    def close(keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fps)]])
        sizes = ends - starts
        run = np.repeat(np.arange(len(starts)), sizes)
        small = sizes[run] <= step
        for k in range(1, min(step, len(fps))):
            same = (run[k:] == run[:-k]) & small[k:]
            near = same & (_bits(fps[k:] ^ fps[:-k]) <= max_bits)
            if near.any():
                yield fps[:-k][near], fps[k:][near], np.zeros(near.sum(), np.int8)
        for j in np.flatnonzero(sizes > step):
            of = fps[starts[j] : ends[j]]
            if len(of) > most:
                yield of, of, np.ones(len(of), np.int8)
            elif pairs := forest(of, max_bits):
                a, b = np.array(pairs, np.int64).T
                yield a, b, np.zeros(len(a), np.int8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, enough = [], 0, 50_000
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                pos, key, fp = (np.asarray(c) for c in batch.columns)
                held.append((np.stack([pos.astype(np.int64), key], axis=1), fp))
                size += len(fp)
            if size and (batch is None or size > enough):
                keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
                whole = np.flatnonzero((keys != keys[-1]).any(axis=1))
                n = size if batch is None else whole[-1] + 1 if len(whole) else 0  # the last key may go on in the next batch
                if n:
                    for a, b, hot in close(keys[:n], fps[:n]):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(hot)], names=["a", "b", "hot"])
                held, size = [(keys[n:], fps[n:])], size - n
                enough = max(50_000, 2 * size)  # so that a long key is put together a few times only

    return run


def _through_midpoints(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links between fingerprints of very full keys, in rows proportional to their number.

    Two fingerprints at most 4 bits apart have a common midpoint at most 2 bits from either, and all that share a
    midpoint are at most 4 bits apart. So each is linked to the smallest one at each of its 2081 midpoints.
    """
    half = max_bits // 2
    flips = [sum(1 << i for i in c) for k in range(half + 1) for c in combinations(range(64), k)]
    flips = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in flips])
    at = fps.select("fp", F.explode(flips).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("mid"))
    least = at.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    return at.join(least, "mid").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, most: int = MOST_UNDER_KEY) -> DataFrame:
    """Edges (a, b) that connect just those of the distinct fingerprints `fp` that a chain of links connects."""
    masks = F.array(*[F.lit(m) for m in block_masks(blocks, max_bits)])
    keyed = fps.select("fp", F.posexplode(masks)).select(F.col("pos").cast("short").alias("pos"), F.col("fp").bitwiseAND(F.col("col")).alias("key"), "fp")
    # Full keys are told by a sample and never gathered; one that the sample misses is told where it is met. Either way the
    # links are the same, as those through midpoints are exact.
    some = keyed.where(F.pmod(F.xxhash64("fp"), F.lit(SPARSE)) == 0).groupBy("pos", "key").agg(F.count("*").alias("n"))
    crowded = cut(some.where(F.col("n") * SPARSE > most).select("pos", "key"))
    any_crowded = bool(crowded.take(1))
    rest = keyed.join(crowded, ["pos", "key"], "left_anti") if any_crowded else keyed
    found = cut(rest.repartition("pos", "key").sortWithinPartitions("pos", "key").mapInArrow(_links(max_bits, most), "a long, b long, hot byte"))
    hot = found.where("hot = 1").select(F.col("a").alias("fp"))
    if any_crowded:
        hot = hot.union(keyed.join(crowded, ["pos", "key"], "left_semi").select("fp"))
    elif not hot.take(1):
        return found.select("a", "b")
    return found.where("hot = 0").select("a", "b").union(_through_midpoints(hot.distinct(), max_bits))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest doc_id reachable over links.

    Texts without words share the fingerprint 0 and so a component. Repeated rows stay and share a component. A null
    doc_id stays null; it is never the smallest unless a component has no other. An empty table gives an empty one.
    Other columns, whatever their names, are not read.
    """
    own = cut(fingerprints(docs, id_col, text_col))
    leads = own.groupBy("fp").agg(F.min("doc_id").alias("lead"))
    label = components(links(leads.select("fp"), max_bits, blocks)).select(F.col("node").alias("fp"), "label")
    marked = leads.join(label, "fp", "left")
    alone = marked.where("label IS NULL").select("fp", F.col("lead").alias("component_id"))
    linked = marked.where("label IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    least = linked.groupBy("label").agg(F.min("lead").alias("component_id"))
    parts = least.select("label", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    by_fp = linked.join(parts, ["label", "salt"]).select("fp", "component_id").union(alone)
    return own.join(by_fp, "fp").select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, likeness: float = jaccard.LIKENESS) -> DataFrame:
    """The rows of docs without near copies: of each component one row stays, the one with the smallest id.

    Texts are linked by their fingerprints, as above, and each link is verified. Pairs whose fingerprints differ in more bits,
    which no key of blocks tells, are then found by an exact join.
    Texts are near copies if the Jaccard similarity of their shingles of `width` words is `likeness` or more, exactly; a
    component is what a chain of such pairs connects. Rows without an id come last. Rows of one id are told apart by
    their texts, so none with a text of its own is lost, and of repeated rows one stays. An empty table gives an empty
    one; other columns, whatever their names, are carried along.
    """
    found = jaccard.near_copies(docs, F.col(id_col).cast("long"), F.col(text_col), width, likeness, majority, links)
    counted = found.groupBy("component", "doc_id", "th").agg(F.count("*").alias("n"))  # combined before the shuffle
    kept = counted.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "n")).alias("r")).select("r.doc_id", "r.th", "r.n")
    kept = cut(kept.select(F.col("doc_id").alias("_kept_id"), F.col("th").alias("_kept_th"), (F.col("n") > 1).alias("_kept_more")))
    named = docs.withColumns({"_near_id": F.col(id_col).cast("long"), "_near_th": F.xxhash64(F.col(text_col))})
    same = F.col("_near_id").eqNullSafe(F.col("_kept_id")) & (F.col("_near_th") == F.col("_kept_th"))
    rows = named.join(kept.where("not _kept_more"), same, "left_semi").select(*docs.columns)
    more = kept.where("_kept_more")
    if more.take(1):  # only rows that are repeated whole are gathered, and combined before the shuffle
        again = named.join(more, same, "left_semi").dropDuplicates(["_near_id", "_near_th"]).select(*docs.columns)
        rows = rows.union(again)
    return rows
