"""Exact near-copy join on the Jaccard similarity of word shingles: what links of fingerprints find, verified, and the rest by
prefix filtering.

Texts whose fingerprints are linked come first. Pairs that are alike put their sets in one component, and pairs within it
aren't tried again; the others are found as follows.

Put every set of shingles in one and the same order. Two sets at similarity t or more share at least t times the larger,
so each has one of the shared shingles among its first n - ceil(t * n) + 1. Sets that meet under such a shingle are
candidates if their sizes and positions allow for enough in common. Any order gives the same result; to keep keys small,
shingles that are frequent in a sample come last.

A candidate is tested on sketches first. A set's sketch has a bit for each of about n places, which is 1 if an odd number
of its shingles fall there, so two sketches differ in at most as many bits as the sets have shingles not in common. What
this leaves, nearly all of it alike, is verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import cut, small_batches
from .common import shingles

LIKENESS = 0.8
#: The sample is one in so many texts; frequent shingles that the order knows at most; what is frequent in the sample.
SAMPLED, MOST_FREQUENT, FREQUENT = 8, 1_000_000, 3
#: Sets under one key that are all paired at once. Under fuller keys each is paired with as many successors first, and
#: with all others only where these leave them in different components.
FULL = 4
#: Sets that are in a pair are told by a broadcast up to so many; beyond, by a join.
MOST_BROADCAST = 200_000
_EPS = 1e-9
#: Places of the sketches of one size that go with sets under full keys.
PLACES = 512
_SETS = "doc_id long, th long, s long, n int, keys array<long>, bits binary, few binary, fp long"
_PAIRS = "a long, b long, hot long"


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.asarray(x.values, np.int64)))], names=["x"])


def frequent(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles frequent among the rows (h) of a sample, ascending, and how many of the rows hold each."""
    held = sample.mapInArrow(_distinct, "x long").groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    held = cut(held)
    least, known = FREQUENT, 0
    for r in sorted(held.groupBy("n").agg(F.count("*").alias("k")).collect(), reverse=True):  # a row for each count
        known += r.k
        if known > MOST_FREQUENT:
            least = r.n + 1
            break
    rows = held.where(F.col("n") >= least).toArrow()
    x, n = (np.asarray(c.combine_chunks(), np.int64) for c in rows.columns)
    order = np.argsort(x)
    return x[order], n[order]


def sketch(own: np.ndarray, places: int = 0) -> bytes:
    """A bit for each place, a power of two that isn't below the set's size if none is given: whether it holds an odd number."""
    places = places or max(64, 1 << max(0, len(own) - 1).bit_length())
    odd = np.bincount(own.view(np.uint64) & np.uint64(places - 1), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ, the larger folded to the size of the smaller."""
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    size_a, size_b = 8 * len(x), 8 * len(y)
    while size_a > size_b:
        size_a //= 2
        a = (a >> size_a) ^ (a & ((1 << size_a) - 1))
    while size_b > size_a:
        size_b //= 2
        b = (b >> size_b) ^ (b & ((1 << size_b) - 1))
    return (a ^ b).bit_count()


def _sets(common: np.ndarray, counts: np.ndarray, likeness: float, fingerprint: Callable):
    """(doc_id, th, h) to the set's hash, size, first shingles and sketch, and the text's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            lists = batch.column(2)
            flat = np.ascontiguousarray(np.asarray(lists.flatten()), dtype=np.int64)
            ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0)), dtype=np.int64)
            ids, sizes, keys, bits, few = [], [], [], [], []
            for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False):
                own = np.unique(flat[lo:hi])
                ids.append(xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63))
                seen = np.zeros(len(own), np.int64)
                if len(common) and len(own):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    seen = np.where(common[at] == own, counts[at], 0)
                sizes.append(len(own))
                keys.append(own[np.argsort(seen, kind="stable")][: len(own) - math.ceil(likeness * len(own) - _EPS) + 1])
                bits.append(sketch(own))
                few.append(sketch(own, PLACES))
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array(few, pa.binary()), pa.array(fingerprint(flat, ends).view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "th", "s", "n", "keys", "bits", "few", "fp"])

    return run


def _pairs(likeness: float, full: int, again: bool):
    """Candidates of rows sorted by key and size. The first time fuller keys are marked (hot, a null pair) and thinned;
    again, all pairs of sets with different labels that their sketches don't rule out."""

    def allowed(n, p, m, q):  # n <= m; what comes before, at and behind the shared key may be in common
        least = likeness / (1 + likeness) * (n + m) - _EPS
        return (n >= likeness * m - _EPS) & (np.minimum(p, q) + np.minimum(n - p, m - q) >= least)

    def close(c: list[np.ndarray]):
        key, s, n, p = c[:4]
        if not again:
            for k in range(1, min(full, len(key))):
                x = np.flatnonzero(key[k:] == key[:-k])
                if not len(x):
                    break
                x = x[allowed(n[x], p[x], n[x + k], p[x + k])]
                yield s[x], s[x + k]
            return
        label, few = c[4:]
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
            # The sets outside the most frequent label meet all others; those in it meet each other no more.
            labels, back, sizes = np.unique(label[lo:hi], return_inverse=True, return_counts=True)
            own_n, own_p, own_s, own_few = n[lo:hi], p[lo:hi], s[lo:hi], few[lo:hi]
            first = np.searchsorted(own_n, likeness * own_n - _EPS, "left")
            upto = np.searchsorted(own_n, own_n / likeness + _EPS, "right")
            main = sizes.argmax()
            for i in np.flatnonzero(back != main).tolist():
                x = np.arange(first[i], upto[i])
                x = x[(back[x] == main) | ((back[x] != back[i]) & (x > i))]
                small, large = np.minimum(own_n[i], own_n[x]), np.maximum(own_n[i], own_n[x])
                before = own_n[x] >= own_n[i]
                x = x[allowed(small, np.where(before, own_p[i], own_p[x]), large, np.where(before, own_p[x], own_p[i]))]
                x = x[np.bitwise_count(own_few[x] ^ own_few[i]).sum(axis=1) <= (own_n[x] + own_n[i]) * (1 - likeness) / (1 + likeness) + _EPS]
                if len(x):
                    yield np.full(len(x), own_s[i]), own_s[x]

    def out(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not again:
            key = c[0]
            hot = np.unique(key[full:][key[full:] == key[:-full]])
            if len(hot):
                none = pa.nulls(len(hot), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(hot)], names=["a", "b", "hot"])
        held, size = [], 0
        for a, b in close(c):
            held.append((np.minimum(a, b), np.maximum(a, b)))
            size += len(a)
            if size > 100_000:
                yield batch_of(held)
                held, size = [], 0
        if size:
            yield batch_of(held)

    def batch_of(held) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        got = np.unique(np.stack([a, b], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(got[:, 0])), pa.array(np.ascontiguousarray(got[:, 1])), pa.nulls(len(got), pa.int64())], names=["a", "b", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append([np.asarray(x).astype(np.int64) for x in batch.columns[:5]])
                if again:
                    held[-1].append(np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(-1, PLACES // 64))
                size += batch.num_rows
            if size > 200_000:
                c = [np.concatenate(x) for x in zip(*held, strict=True)]
                upto = np.searchsorted(c[0], c[0][-1])  # the last key may go on in the next batch
                held, size = [[x[upto:] for x in c]], len(c[0]) - upto
                if upto:
                    yield from out([x[:upto] for x in c])
        if size:
            yield from out([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def _candidates(keyed: DataFrame, likeness: float, full: int, again: bool) -> DataFrame:
    # Of sets of one size, each key has an order of its own, so that a set meets others under each.
    rows = keyed.repartition("key").sortWithinPartitions("key", "n", F.xxhash64("key", "s")).select("key", "s", "n", "p", "label", *["few"] * again)
    return cut(rows.mapInArrow(_pairs(likeness, full, again), _PAIRS))


def _sketched(likeness: float):
    """(a, b, n, m, x, y) to the pairs (a, b) whose sketches x, y don't rule the likeness out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (np.asarray(c) for c in batch.columns[2:4])
            most = ((n + m) * (1 - likeness) / (1 + likeness) + _EPS).tolist()
            near = [differing(x, y) <= d for x, y, d in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), most, strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near)) for c in batch.columns[:2]], names=["a", "b"])

    return run


def _by_fingerprint(own: DataFrame, links: Callable) -> DataFrame:
    """Pairs (a, b) of sets of which texts have the same fingerprint, or linked ones: for each fingerprint its smallest set stands."""
    held = cut(own.select("fp", "s").distinct())
    lead = cut(held.groupBy("fp").agg(F.min("s").alias("lead")))
    same = held.join(lead, "fp").select("s", "lead")
    side = lambda fp, s: lead.select(F.col("fp").alias(fp), F.col("lead").alias(s))
    linked = links(lead.select("fp")).join(side("a", "s"), "a").join(side("b", "lead"), "b").select("s", "lead")
    return same.union(linked).where("s <> lead").select(F.least("s", "lead").alias("a"), F.greatest("s", "lead").alias("b"))


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (a, b) that aren't in one component yet."""
    side = lambda s, name: label.select(F.col("s").alias(s), F.col("label").alias(name))
    both = pairs.distinct().join(side("a", "x"), "a", "left").join(side("b", "y"), "b", "left")
    return both.where("x IS NULL OR y IS NULL OR x <> y").select("a", "b")


class _Verifier:
    """Tells which pairs (a, b) of sets are as alike as asked."""

    def __init__(self, docs: DataFrame, one: DataFrame, width: int, likeness: float):
        self.docs, self.one, self.width, self.likeness = docs, one, width, likeness

    def near(self, pairs: DataFrame) -> DataFrame:
        """The distinct pairs that their sketches leave."""
        side = lambda s, n, bits: self.one.select(F.col("s").alias(s), F.col("n").alias(n), F.col("bits").alias(bits))
        both = pairs.distinct().join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b")
        return cut(both.select("a", "b", "n", "m", "x", "y").mapInArrow(_sketched(self.likeness), "a long, b long"))

    def alike(self, pairs: DataFrame) -> DataFrame:
        """The pairs that hold on the whole sets; only texts whose sets are in a pair are cut into shingles again."""
        needed = pairs.select(F.col("a").alias("s")).union(pairs.select("b")).distinct()
        needed = cut(self.one.join(needed, "s", "left_semi").select("s", "doc_id", "th"))
        small = needed.count() <= MOST_BROADCAST
        needed = needed.select("s", F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
        rows = self.docs.join(F.broadcast(needed) if small else needed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
        sets = shingles(rows.dropDuplicates(["s"]), [F.col("s")], F.col("text"), self.width).select("s", F.array_distinct("h").alias("h"))
        sets = cut(sets)
        both = pairs.join(sets.select(F.col("s").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("s").alias("b"), F.col("h").alias("hb")), "b")
        common = F.size(F.array_intersect("ha", "hb"))
        return cut(both.where(common >= F.lit(self.likeness) * (F.size("ha") + F.size("hb") - common) - F.lit(_EPS)).select("a", "b"))


def near_copies(docs: DataFrame, doc_id: Column, text: Column, width: int, likeness: float, fingerprint: Callable, links: Callable, full: int = FULL) -> DataFrame:
    """(doc_id, th, component) of every row of docs: its id and the hash of its text, and what tells its component.

    Rows belong together that a chain of pairs at a Jaccard similarity of `likeness` or more connects, over the sets of
    their texts' shingles. Texts without words have the empty set, and are alike. `fingerprint` gives the fingerprints of
    runs of hashes (hashes, ends), `links` the edges (a, b) between fingerprints fp; what they miss is found without them.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(doc_id.alias("doc_id"), text.alias("text")).withColumn("th", F.xxhash64("text"))
    sample = docs.where(F.pmod("th", F.lit(SAMPLED)) == 0)
    common, counts = frequent(shingles(sample, [], F.col("text"), width))
    own = shingles(docs, [F.col("doc_id"), F.col("th")], F.col("text"), width)
    own = cut(own.mapInArrow(_sets(common, counts, likeness, fingerprint), _SETS))
    first = F.min(F.struct("doc_id", "th")).alias("r")
    one = own.groupBy("s").agg(first, F.any_value("n").alias("n"), F.any_value("keys").alias("keys"), F.any_value("bits").alias("bits"), F.any_value("few").alias("few"))
    one = cut(one.select("s", "r.doc_id", "r.th", "n", "keys", "bits", "few"))
    keyed = one.select("s", "n", F.posexplode("keys").alias("p", "key"))
    verifier = _Verifier(docs, one, width, likeness)
    met = verifier.alike(verifier.near(_by_fingerprint(own, links)))
    label = components(met).select(F.col("node").alias("s"), "label")
    tried = _candidates(keyed.withColumn("label", F.lit(0)), likeness, full, False)
    found = met.union(verifier.alike(verifier.near(_apart(tried.where("hot IS NULL").select("a", "b"), label))))
    label = components(found).select(F.col("node").alias("s"), "label")
    hot = tried.where("hot IS NOT NULL").select(F.col("hot").alias("key"))
    if hot.take(1):
        marked = keyed.join(hot, "key", "left_semi").join(one.select("s", "few"), "s").join(label, "s", "left").withColumn("label", F.coalesce("label", "s"))
        near = verifier.near(_candidates(marked, likeness, full, True).select("a", "b"))
        if near.take(1):
            more = verifier.alike(near)
            label = components(found.union(more)).select(F.col("node").alias("s"), "label")
    return own.select("doc_id", "th", "s").join(label, "s", "left").select("doc_id", "th", F.coalesce("label", "s").alias("component"))
