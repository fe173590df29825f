"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable shards. Compaction merges runs of similarly sized shards into files of the
target size, each by one task that reads its run's files and writes one, without a shuffle. What a table holds is said by
a versioned manifest, which each change commits as a whole: the next version is renamed into place, and fails if another
writer was first. Shards without a manifest that names them don't exist for readers, so a job that is lost half way
leaves nothing but files for vacuum(), which spares those that a writer has announced.

A manifest names the shards that compaction may still merge, and lists that are written once of those that are settled;
so what a change reads and writes doesn't grow with the table.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Seconds for which vacuum() spares the files of writers that have announced themselves, and settled shards in a list.
GRACE, LISTED = 7 * 86_400, 1_000


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    bytes: int


@dataclass(frozen=True)
class Manifest:
    """A version: its schema (JSON), the shards that may still be merged, and the lists of those that are settled."""

    schema: str | None = None
    open: tuple[Shard, ...] = ()
    lists: tuple[str, ...] = field(default=())


def _tail(path: str) -> str:
    """Folder and name of a file; names hold the id of the job that wrote them."""
    return "/".join(path.split("/")[-2:])


class CommitConflict(RuntimeError):
    """Another writer has committed the version first."""


class ShardTable:
    """A table of shards under `root`, a folder that driver and executors share.

    target: bytes that a merged shard should have. fan_in: so many shards of a tier are merged at least; tiers are a
    factor of fan_in apart. Columns, whatever their names, are stored as they come; nulls, empty and repeated rows too.
    """

    def __init__(self, spark: SparkSession, root: str, target: int = 128 << 20, fan_in: int = 4):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target, fan_in
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _list(self, folder: str) -> list[tuple[str, int]]:
        """(path, bytes) of the files under a folder."""
        if not self._fs.exists(self._path(folder)):
            return []
        found, out = self._fs.listFiles(self._path(folder), True), []
        while found.hasNext():
            s = found.next()
            out.append((s.getPath().toString(), s.getLen()))
        return sorted(out)

    def version(self) -> int:
        """The newest version, 0 before the first."""
        names = [p.rsplit("/", 1)[1] for p, _ in self._list(f"{self.root}/manifest")]
        return max((int(n[1:-5]) for n in names if n[0] == "v" and n.endswith(".json")), default=0)

    def _read_text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _write_text(self, path: str, text: str) -> None:
        stream = self._fs.create(self._path(path))
        try:
            stream.write(text.encode())
        finally:
            stream.close()

    def head(self, version: int | None = None) -> Manifest:
        """The manifest of a version, by default the newest; an empty one before the first."""
        version = self.version() if version is None else version
        if not version:
            return Manifest()
        said = json.loads(self._read_text(f"{self.root}/manifest/v{version:012d}.json"))
        return Manifest(said["schema"], tuple(Shard(**x) for x in said["open"]), tuple(said["lists"]))

    def manifest(self, version: int | None = None) -> list[Shard]:
        """All shards of a version, by default the newest."""
        head = self.head(version)
        settled = [Shard(**x) for name in head.lists for x in json.loads(self._read_text(f"{self.root}/settled/{name}"))]
        return [*settled, *head.open]

    def _settle(self, m: Manifest) -> Manifest:
        """Moves shards that nothing will merge any more to a list, once there are enough of them."""
        done = [s for s in m.open if self.target / 2 <= s.bytes <= 2 * self.target]
        if len(done) < LISTED:
            return m
        name = f"{uuid.uuid4().hex}.json"
        self._write_text(f"{self.root}/settled/{name}", json.dumps([asdict(s) for s in done]))
        return replace(m, open=tuple(s for s in m.open if s not in set(done)), lists=(*m.lists, name))

    def _commit(self, base: int, m: Manifest) -> int:
        """Makes m the version after `base`, or raises CommitConflict."""
        part = f"{self.root}/manifest/.{uuid.uuid4().hex}"
        self._write_text(part, json.dumps({"version": base + 1, "schema": m.schema, "open": [asdict(s) for s in m.open], "lists": list(m.lists)}))
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(self._path(part), self._path(f"{self.root}/manifest/v{base + 1:012d}.json"), options)
        except Exception as e:
            self._fs.delete(self._path(part), False)
            if "AlreadyExists" in str(e):
                raise CommitConflict(f"version {base + 1} exists") from e
            raise
        return base + 1

    def _measured(self, folder: str) -> list[Shard]:
        """The shards in a folder, with their rows counted from the files' footers."""
        files = {p: n for p, n in self._list(folder) if p.endswith(".parquet")}
        if not files:
            return []
        shards = [Shard(p, 0, n) for p, n in files.items()]
        reader = self.spark.read.option("recursiveFileLookup", "true").schema("_none int")  # no column is read
        counted = reader.parquet(*files).groupBy(F.col("_metadata.file_path").alias("p")).count().collect()  # a row a file
        rows = {_tail(r.p): r["count"] for r in counted}
        return [Shard(s.path, rows.get(_tail(s.path), 0), s.bytes) for s in shards]

    def _announce(self) -> str:
        """A folder for files, announced so that vacuum() spares what isn't committed yet."""
        name = uuid.uuid4().hex
        self._write_text(f"{self.root}/intent/{name}", "")
        return name

    def _withdraw(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/intent/{name}"), False)

    def _write(self, rows: DataFrame, folder: str, by: list[str] | None = None) -> None:
        # Small row groups, so that files over the target can be read in parts.
        writer = rows.write.option("compression", "zstd").option("parquet.block.size", max(1 << 20, self.target // 8))
        (writer.partitionBy(*by) if by else writer).parquet(folder)

    def append(self, rows: DataFrame, retries: int = 5) -> int:
        """Adds rows as new shards, one for each task that has some, and commits them; gives the new version.

        An empty table is a version too: it says the columns.
        """
        name = self._announce()
        self._write(rows, f"{self.root}/data/{name}")
        version = self._add(rows.schema, [s for s in self._measured(f"{self.root}/data/{name}") if s.rows], retries)
        self._withdraw(name)
        return version

    def append_arrivals(self, rows: DataFrame, arrival: Column, retries: int = 5) -> int:
        """Adds rows that came as several arrivals: written at once, and committed one by one in the order of `arrival`."""
        name, mine = self._announce(), f"_arrival_{uuid.uuid4().hex}"
        self._write(rows.withColumn(mine, arrival.cast("long")), f"{self.root}/data/{name}", [mine])
        by: dict[int, list[Shard]] = {}
        for s in self._measured(f"{self.root}/data/{name}"):
            number = s.path.rsplit("/", 2)[1].split("=")[1]
            by.setdefault(int(number) if number.lstrip("-").isdigit() else -1, []).append(s)
        version = 0 if by else self._add(rows.schema, [], retries)
        for _, shards in sorted(by.items()):
            version = self._add(rows.schema, shards, retries)
        self._withdraw(name)
        return version

    def _add(self, schema: StructType, new: list[Shard], retries: int) -> int:
        if not new and self.head().schema is not None:
            return self.version()
        return self._retried(lambda m: replace(m, schema=m.schema or schema.json(), open=(*m.open, *new)), retries)

    def _retried(self, change, retries: int) -> int:
        for k in range(retries + 1):
            base = self.version()
            try:
                return self._commit(base, self._settle(change(self.head(base))))
            except CommitConflict:
                if k == retries:
                    raise
        raise AssertionError

    def tier(self, s: Shard) -> int:
        """How many times a shard's size must grow by fan_in to reach the target, at least; less is larger."""
        tier, most = 0, max(1, s.bytes)
        while most * self.fan_in < self.target:
            tier, most = tier + 1, most * self.fan_in
        return tier

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs to merge: shards of one tier, in order, up to the target size; less than fan_in only if they reach it."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target / 2:
                tiers.setdefault(self.tier(s), []).append(s)
        out = []
        for _, of in sorted(tiers.items()):
            run: list[Shard] = []
            for s in of:
                if run and sum(x.bytes for x in run) + s.bytes > self.target:
                    out.append(run)
                    run = []
                run.append(s)
            if len(run) >= self.fan_in:
                out.append(run)
        return [r for r in out if len(r) > 1]

    def oversize(self, shards: list[Shard]) -> list[Shard]:
        """Shards of more than twice the target, which are split."""
        return [s for s in shards if s.bytes > 2 * self.target and s.rows > 1]

    def compact(self, rounds: int = 10) -> int:
        """Merges runs and splits shards over twice the target until there are none, a commit for each round; gives the version.

        A round writes the runs of a tier at a time. Spark's own packing of files into tasks, by size and up to the
        target, makes a run one task, so nothing is shuffled. Readers of older versions are not disturbed.
        """
        for _ in range(rounds):
            base = self.version()
            live = list(self.head(base).open)
            large = self.oversize(live)
            jobs = self._tiers(self.plan(live))
            jobs += [(large, -(-sum(s.bytes for s in large) // self.target))] if large else []
            name, gone, new = self._announce(), set(), []
            for k, (files, n) in enumerate(jobs):
                folder = f"{self.root}/data/{name}/{k}"
                self._write(self._packed(files, n), folder)
                got = [s for s in self._measured(folder) if s.rows]
                if sum(s.rows for s in got) != sum(s.rows for s in files):
                    raise RuntimeError("merged shards don't hold the rows of their run")
                if (len(got) > len(files)) if files is large else (len(got) < len(files)):  # else nothing is won by it
                    gone |= {s.path for s in files}
                    new += got
            if gone:

                def change(m: Manifest, gone=gone, new=new) -> Manifest:
                    if not gone <= {s.path for s in m.open}:
                        raise RuntimeError("a shard of the run has been replaced meanwhile")
                    return replace(m, open=(*[s for s in m.open if s.path not in gone], *new))

                self._retried(change, 5)
            self._withdraw(name)
            if not gone:
                return base
        return self.version()

    def _tiers(self, runs: list[list[Shard]]) -> list[tuple[list[Shard], int]]:
        """The files of the runs of each tier, and how many runs they are."""
        out: dict[int, list[list[Shard]]] = {}
        for run in runs:
            out.setdefault(self.tier(run[0]), []).append(run)
        return [([s for run in of for s in run], len(of)) for _, of in sorted(out.items())]

    def _packed(self, files: list[Shard], n: int) -> DataFrame:
        """The rows of files in n tasks of about the target size; in a session of its own, as that is a setting."""
        own = self.spark.newSession()
        for key, value in {"files.maxPartitionBytes": self.target, "files.openCostInBytes": 0, "files.minPartitionNum": 1}.items():
            own.conf.set(f"spark.sql.{key}", str(value))
        return self._files(own, files).coalesce(n)

    def _files(self, spark: SparkSession, shards: list[Shard], schema: str | None = None) -> DataFrame:
        reader = spark.read.option("recursiveFileLookup", "true")  # folder names mean nothing
        return reader.schema(StructType.fromJson(json.loads(schema or self.head().schema))).parquet(*[s.path for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest; none, with their columns, of a table that only empty ones were added to."""
        schema, shards = self.head(version).schema, self.manifest(version)
        if schema is None:
            raise ValueError("nothing has been appended, so there are no columns")
        return self._files(self.spark, shards, schema) if shards else self.spark.createDataFrame([], StructType.fromJson(json.loads(schema)))

    def vacuum(self, keep: int = 1, grace: float = GRACE) -> int:
        """Deletes the files that none of the newest `keep` versions names, and older manifests; gives how many files.

        Files of a writer that hasn't committed yet stay: it has announced their folder. Announcements older than `grace`
        seconds are of lost writers.
        """
        files = [p for p, _ in self._list(f"{self.root}/data") if p.endswith(".parquet")]  # before what is announced and committed
        alive = {p.rsplit("/", 1)[1] for p, _ in self._list(f"{self.root}/intent") if time.time() - self._fs.getFileStatus(self._path(p)).getModificationTime() / 1000 < grace}
        newest = self.version()
        versions = range(max(1, newest - keep + 1), newest + 1)
        kept = {s.path for v in versions for s in self.manifest(v)}
        lists = {name for v in versions for name in self.head(v).lists}
        root = self._fs.makeQualified(self._path(f"{self.root}/data")).toString()
        gone = [p for p in files if p not in kept and p.removeprefix(root).lstrip("/").split("/")[0] not in alive]
        gone += [p for p, _ in self._list(f"{self.root}/settled") if p.rsplit("/", 1)[1] not in lists]
        gone += [p for p, _ in self._list(f"{self.root}/manifest") if p.rsplit("/", 1)[1] <= f"v{newest - keep:012d}.json"]
        for p in gone:
            self._fs.delete(self._path(p), False)
        return len(gone)
