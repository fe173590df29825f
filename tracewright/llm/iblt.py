"""Document fingerprints: an invertible Bloom lookup sketch of a document's paragraph digests.

A paragraph ends at a newline, and within long lines at places that the last eight bytes alone decide on, so that an
edit moves no boundary but those beside it. The digests of the distinct paragraphs are put into the cells of a sketch:
a count, the XOR of the digests and the XOR of their checks. Sketches of two versions subtract cell by cell; what is
left holds the differing digests, which peeling recovers. If a sketch is too small for that, a larger one is tried.
The likeness of two versions is the share of digests in common: 2 * common / (first + second).

All of it runs over whole batches of documents as numpy arrays, each document with a range of cells of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_batches

#: Cells of the fingerprint, in three equal parts, one for each hash; mean bytes between boundaries within a line.
CELLS, MEAN_BYTES = 12, 20
#: A retry has so many times the cells, until there are GENEROUS cells for each digest of both versions.
GROWTH, GENEROUS = 8, 1.7
#: Bytes of text that are worked on at a time; a longer text is cut at its own boundaries.
STRETCH = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of the hash's base and of its inverse, modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(n - 1, b, _U)])) for b in (_P, _PINV))
        return self.up, self.down


_POWERS = _Powers()


def _cut(data: np.ndarray) -> np.ndarray:
    """Where a paragraph ends: after a newline, or where the last eight bytes say so."""
    x = data.astype(_U)
    for k in (1, 2, 4):
        y = x.copy()
        y[k:] |= x[:-k] << _U(8 * k)
        x = y
    return (data == 10) | (mix(x) < _U((1 << 64) // MEAN_BYTES))


def digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct paragraph digests of each text, one after the other, and the text's number of each."""
    gap = bytes(8)
    values, owners = [np.empty(0, _U)], [np.empty(0, np.int64)]
    batch: list[tuple[int, bytes]] = []
    size = 0

    def work() -> None:
        if not batch:
            return
        data = np.frombuffer(gap + gap.join(t for _, t in batch), np.uint8)
        lengths = np.array([len(t) for _, t in batch])
        starts = 8 + np.concatenate([[0], np.cumsum(lengths[:-1] + 8)])
        ends = starts + lengths
        inside = np.zeros(len(data) + 1, np.int8)
        np.add.at(inside, starts, 1)
        np.add.at(inside, ends, -1)
        ok = np.cumsum(inside[:-1]).astype(bool)
        stop = _cut(data) & ok
        stop[ends[lengths > 0] - 1] = True
        e = np.flatnonzero(stop) + 1
        doc = np.searchsorted(starts, e - 1, "right") - 1
        s = np.maximum(np.concatenate([[0], e[:-1]]), starts[doc])
        up, down = _POWERS.get(len(data) + 1)
        run = np.concatenate([np.zeros(1, _U), np.cumsum(data.astype(_U) * up[: len(data)], dtype=_U)])
        value = mix((run[e] - run[s]) * down[s] + mix((e - s).astype(_U)))
        values.append(value)
        owners.append(np.array([k for k, _ in batch], np.int64)[doc])
        batch.clear()

    for k, t in enumerate(texts):
        while len(t) > STRETCH:  # up to the last boundary of a stretch; without one, the stretch is a paragraph
            places = np.flatnonzero(_cut(np.frombuffer(t[:STRETCH], np.uint8)))
            n = int(places[-1]) + 1 if len(places) else STRETCH
            work()
            size = 0
            batch.append((k, t[:n]))
            work()
            t = t[n:]
        batch.append((k, t))
        size += len(t) + 8
        if size > STRETCH:
            work()
            size = 0
    work()
    value, owner = np.concatenate(values), np.concatenate(owners)
    _, first = np.unique(mix(value + mix(owner.astype(_U) * _P)), return_index=True)
    first.sort()
    value, owner = value[first], owner[first]
    order = np.argsort(owner, kind="stable")
    return value[order], owner[order]


def _places(value: np.ndarray, offset: np.ndarray, third: np.ndarray) -> list[np.ndarray]:
    """The three cells of each digest, for a sketch at `offset` of three parts of `third` cells."""
    salts = [_U((j + 1) * int(_P) % (1 << 64)) for j in range(3)]
    return [offset + j * third + ((mix(value + salt) >> _U(32)) * third.astype(_U) >> _U(32)).astype(np.int64) for j, salt in enumerate(salts)]


def _check(value: np.ndarray) -> np.ndarray:
    return mix(value ^ _U(0x5851F42D4C957F2D)) & _U(0xFFFF)


class Sketch:
    """Cells of many sketches side by side; sketch k has 3 * third[k] of them."""

    def __init__(self, third: np.ndarray):
        self.third = third.astype(np.int64)
        self.offset = np.concatenate([[0], np.cumsum(3 * self.third)[:-1]]).astype(np.int64)
        total = int(3 * self.third.sum())
        self.count, self.key, self.check = np.zeros(total, np.int64), np.zeros(total, _U), np.zeros(total, _U)

    def put(self, value: np.ndarray, owner: np.ndarray, times: int = 1) -> None:
        check = _check(value)
        for at in _places(value, self.offset[owner], self.third[owner]):
            np.add.at(self.count, at, times)
            np.bitwise_xor.at(self.key, at, value)
            np.bitwise_xor.at(self.check, at, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each sketch, how many digests were recovered, and whether none is left."""
        owner = np.repeat(np.arange(len(self.third)), 3 * self.third)
        found = np.zeros(len(self.third), np.int64)
        at = np.flatnonzero(np.abs(self.count) == 1)
        while len(at):
            at = at[(np.abs(self.count[at]) == 1) & (self.check[at] == _check(self.key[at]))]
            value, who, sign = self.key[at], owner[at], self.count[at]
            _, once = np.unique(mix(value + mix(who.astype(_U) * _P)), return_index=True)
            value, who, sign = value[once], who[once], sign[once]
            own = _places(value, self.offset[who], self.third[who])
            fits = np.zeros(len(value), bool)  # a cell that only looks like one digest leads to cells of others
            for p in own:
                fits |= (p == at[once])
            value, who, sign, own = value[fits], who[fits], sign[fits], [p[fits] for p in own]
            if not len(value):
                break
            found += np.bincount(who, minlength=len(found))
            check = _check(value)
            for p in own:
                np.subtract.at(self.count, p, sign)
                np.bitwise_xor.at(self.key, p, value)
                np.bitwise_xor.at(self.check, p, check)
            at = np.unique(np.concatenate(own))
            over = found[owner[at]] > 3 * self.third[owner[at]] * 4
            at = at[~over & (np.abs(self.count[at]) == 1)]
        left = (self.count != 0) | (self.key != 0)
        clean = np.bincount(owner, weights=left, minlength=len(self.third)) == 0
        return found, clean


def fingerprint_texts(value: np.ndarray, owner: np.ndarray, n: int) -> list[str]:
    """The sketches of CELLS cells as hex: the number of digests, then of each cell count, digests and checks."""
    s = Sketch(np.full(n, CELLS // 3))
    s.put(value, owner)
    sizes = np.bincount(owner, minlength=n)
    cells = np.empty((n, CELLS), [("count", ">u2"), ("key", ">u8"), ("check", ">u2")])
    cells["count"], cells["key"], cells["check"] = (x.reshape(n, CELLS) for x in (s.count & 0xFFFF, s.key, s.check))
    return [f"{sizes[k]:08x}{cells[k].tobytes().hex()}" for k in range(n)]


def subtract_texts(a: str, b: str) -> float | None:
    """The likeness of two fingerprints from what they hold alone; None if they differ by more than they can recover."""
    n, m = int(a[:8], 16), int(b[:8], 16)
    kind = [("count", ">u2"), ("key", ">u8"), ("check", ">u2")]
    x, y = (np.frombuffer(bytes.fromhex(t[8:]), kind) for t in (a, b))
    s = Sketch(np.array([CELLS // 3]))
    s.count = (x["count"].astype(np.int64) - y["count"] + 0x8000) % 0x10000 - 0x8000
    s.key, s.check = x["key"].astype(_U) ^ y["key"].astype(_U), x["check"].astype(_U) ^ y["check"].astype(_U)
    found, clean = s.peel()
    return _likeness(n, m, int(found[0])) if clean[0] else None


def _likeness(n, m, differing):
    return np.where(np.add(n, m) == 0, 1.0, np.subtract(np.add(n, m), differing) / np.maximum(np.add(n, m), 1)) if np.ndim(n) else (1.0 if n + m == 0 else (n + m - differing) / (n + m))


def likeness(av: np.ndarray, ao: np.ndarray, bv: np.ndarray, bo: np.ndarray, n: int) -> np.ndarray:
    """The likeness of n pairs of versions, given their digests: sketches subtract and are peeled, with more cells on failure."""
    na, nb = np.bincount(ao, minlength=n), np.bincount(bo, minlength=n)
    out, todo = np.full(n, np.nan), np.arange(n)
    third = np.full(n, CELLS // 3)
    enough = np.ceil((na + nb) * GENEROUS / 3).astype(np.int64) + 4
    while len(todo):
        slot = np.full(n, -1)
        slot[todo] = np.arange(len(todo))
        s = Sketch(third[todo])
        for value, owner, times in ((av, ao, 1), (bv, bo, -1)):
            here = slot[owner] >= 0
            s.put(value[here], slot[owner[here]], times)
        found, clean = s.peel()
        done = todo[clean]
        out[done] = _likeness(na[done], nb[done], found[clean])
        todo = todo[~clean]
        enough[todo] = np.where(third[todo] >= enough[todo], third[todo] * 2, enough[todo])
        third[todo] = np.minimum(third[todo] * GROWTH, enough[todo])
    return out


def _bucket(place: Column, bounds: list[int]) -> Column:
    """How many of the descending bounds lie above a place, found in two steps of about the root of their number."""
    k = max(1, int(len(bounds) ** 0.5))
    heads, parts = bounds[k - 1 :: k], [bounds[i : i + k] for i in range(0, len(bounds), k)] or [[]]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]).cast("array<bigint>")
    above = lambda xs: F.size(F.filter(xs, lambda b: b > place))
    coarse = above(longs(heads))
    fine = F.coalesce(F.get(F.array(*[longs(p) for p in parts]), coarse), longs([]))
    return coarse * k + above(fine)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = hashlib.sha256
    held: list[tuple[int | None, str]] = []
    size = 0

    def work(texts: list[tuple[int | None, str]], after: str) -> pa.RecordBatch:
        own = [t for _, t in texts]
        follow = [*own[1:], after]
        edited = [t[: len(t) - len(t) // 3] + f[: len(t) // 3] for t, f in zip(own, follow, strict=True)]
        n = len(own)
        raw = [t.encode() for t in edited]
        av, ao = digests([t.encode() for t in [*own, after]])
        ev, eo = digests(raw)
        mine, later = ao < n, ao > 0
        av1, ao1 = av[mine], ao[mine]
        near_edited, near_next = likeness(av1, ao1, ev, eo, n), likeness(av1, ao1, av[later], ao[later] - 1, n)
        columns = [pa.array([d for d, _ in texts], pa.int64()), pa.array([len(t) for t in own], pa.int64()), pa.array([sha(t).hexdigest() for t in raw], pa.string())]
        columns += [pa.array(fingerprint_texts(av1, ao1, n), pa.string()), pa.array(fingerprint_texts(ev, eo, n), pa.string()), pa.array(near_edited), pa.array(near_next)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    ended = False
    for batch in batches:
        for b, carried, d, t in zip(*(c for c in batch.columns), strict=True):
            carried, d, t = carried.as_py(), d.as_py(), t.as_py()
            if carried:
                if not ended and held:
                    yield work(held, t)
                    held, size = [], 0
                ended = True
                continue
            ended = False
            held.append((d, t))
            size += len(t)
            if size > STRETCH and len(held) > 1:
                yield work(held[:-1], held[-1][1])
                held, size = held[-1:], len(t)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). The next document is the
    one that follows by descending doc_id; after the last comes the first, and a single document is its own next. Null
    ids come last. Rows of equal ids are ordered by text, and all stay. A null text counts as empty; two texts without
    paragraphs are alike (1.0). An empty table gives an empty one. Other columns aren't read.

    The documents are dealt out by ranges of doc_id, whose bounds are quantiles. A range's first document is also sent
    to the range before it, as its last one's next. So texts are shuffled once, and the driver holds one id a range.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or min(10_000, 4 * parts)
    least = -(1 << 63)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    place = F.coalesce("doc_id", F.lit(least))
    shares = [i / buckets for i in range(1, buckets)]
    bounds = rows.agg(F.percentile_approx(place, shares, 100 * buckets)).first()[0] if shares else None
    bounds = sorted(set(bounds or []), reverse=True)
    numbered = rows.withColumn("place", place).withColumn("bucket", _bucket(F.col("place"), bounds))
    firsts = sorted((r[0], r[1]) for r in numbered.groupBy("bucket").agg(F.max("place")).collect())
    before = [(place, firsts[k - 1][0]) for k, (_, place) in enumerate(firsts)]
    heads = spark.createDataFrame(before, "head long, before int")  # a row for each range
    joined = numbered.join(F.broadcast(heads), numbered["place"] == heads["head"], "left")
    spot = lambda b, c: F.struct(F.col(b).cast("int").alias("bucket"), F.lit(c).alias("carried"))
    to = F.when(F.col("before").isNull(), F.array(spot("bucket", False))).otherwise(F.array(spot("bucket", False), spot("before", True)))
    dealt = joined.select("doc_id", "place", "text", F.explode(to).alias("to")).select("to.bucket", "to.carried", "doc_id", "text", "place")
    dealt = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "carried", F.desc("place"), "text").select("bucket", "carried", "doc_id", "text")
    return dealt.mapInArrow(_rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
