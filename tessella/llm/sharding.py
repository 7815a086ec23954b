"""Sharding by size-tiered compaction.

Arrivals are appended as runs of small immutable Parquet files. Runs of like size are in one tier;
when a tier holds FANOUT runs they are merged into one run of target-sized files (files that have
the target size already are taken over, not rewritten). What the table holds is told by a manifest:
versions are numbered, each is a small file that names runs, and a version appears by one rename
that fails if that number exists, so readers see a whole version or the one before, and of two
writers one has to begin anew. Files that no version names (of a writer that died) are never read.

    root/data/<run>/part-*.parquet   root/runs/<run>.json   root/versions/<number>.json
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table, use_checkpoint_dir

TARGET_BYTES = 128 << 20
SMALLEST_BYTES = 1 << 20
FANOUT = 4
#: Arrivals that the query deals the table into.
ARRIVALS = 6


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to be."""


@dataclass
class Run:
    name: str
    bytes: int
    rows: int
    files: list[dict] = field(default_factory=list)


class ShardStore:
    """A table of shards under one folder. Rows are kept as they are: nulls, repeated rows and columns of any names; an arrival without
    rows is no run. Reading a version that has none needs a schema."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, fanout: int = FANOUT, smallest: int = SMALLEST_BYTES):
        self.spark, self.root, self.target, self.fanout, self.smallest = spark, root.rstrip("/"), target, fanout, smallest
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _write(self, name: str, value: dict) -> None:
        """A file that appears whole, under a name that must be new."""
        at, temp = self._path(name), self._path(f"tmp/{uuid.uuid4().hex}")
        self.fs.mkdirs(temp.getParent())
        self.fs.mkdirs(at.getParent())
        out = self.fs.create(temp, False)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(context.makeQualified(temp), context.makeQualified(at), none)
        except Exception as e:
            self.fs.delete(temp, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(name) from e
            raise

    def _read(self, name: str) -> dict:
        stream = self.fs.open(self._path(name))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def version(self) -> int:
        """The latest version; 0 before the first commit."""
        return max((int(x.removesuffix(".json")) for x in self._names("versions")), default=0)

    def runs(self, version: int | None = None) -> list[Run]:
        version = self.version() if version is None else version
        return [Run(**self._read(f"runs/{n}.json")) for n in self._read(f"versions/{version:012d}.json")["runs"]] if version else []

    def commit(self, base: int, runs: list[Run]) -> int:
        """Make the given runs version base + 1; Conflict if that exists."""
        self._write(f"versions/{base + 1:012d}.json", {"version": base + 1, "runs": [r.name for r in runs]})
        return base + 1

    def _written(self, df: DataFrame, over: list[dict] = ()) -> Run | None:
        """A run of df's files and of files taken over; None if it has no rows."""
        name = uuid.uuid4().hex
        files = list(over)
        if df is not None:
            df.write.option("compression", "zstd").parquet(f"{self.root}/data/{name}")
            sizes = {s.getPath().getName(): s.getLen() for s in self.fs.listStatus(self._path(f"data/{name}")) if s.getPath().getName().endswith(".parquet")}
            back = self.spark.read.schema(df.schema).parquet(f"{self.root}/data/{name}")
            rows = {r["f"]: r["n"] for r in back.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()}
            files += [{"path": f"data/{name}/{k}", "bytes": v, "rows": rows[k]} for k, v in sorted(sizes.items()) if k in rows]
        if not files:
            return None
        run = Run(name, sum(f["bytes"] for f in files), sum(f["rows"] for f in files), files)
        self._write(f"runs/{name}.json", asdict(run))
        return run

    def append(self, df: DataFrame) -> int:
        """Add rows as one run; nothing is committed for none. The data are written once; a conflict only repeats the commit."""
        run = self._written(df)
        while run:
            base = self.version()
            try:
                return self.commit(base, [*self.runs(base), run])
            except Conflict:
                continue
        return self.version()

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.smallest, self.fanout) + 1)) if size >= self.smallest else 0

    def due(self, runs: list[Run]) -> list[Run]:
        """The runs of the lowest tier that is full; runs of target-sized files only are left alone."""
        tiers: dict[int, list[Run]] = {}
        for r in runs:
            if any(f["bytes"] < self.target // 2 for f in r.files):
                tiers.setdefault(self.tier(r.bytes), []).append(r)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fanout), [])

    def compact(self, schema=None) -> int:
        """Merge full tiers until none is left. Small files are joined without a shuffle: each task reads
        neighbouring files and writes one of about the target size. A conflict drops the merge and starts anew."""
        while True:
            base = self.version()
            runs = self.runs(base)
            merged = self.due(runs)
            if not merged:
                return base
            files = [f for r in merged for f in r.files]
            small = [f for f in files if f["bytes"] < self.target // 2]
            read = self.spark.read.schema(schema) if schema is not None else self.spark.read
            rows = read.parquet(*[f"{self.root}/{f['path']}" for f in small]).coalesce(max(1, math.ceil(sum(f["bytes"] for f in small) / self.target)))
            run = self._written(rows, [f for f in files if f["bytes"] >= self.target // 2])
            gone = {r.name for r in merged}
            try:
                self.commit(base, [*(r for r in runs if r.name not in gone), *([run] if run else [])])
            except Conflict:
                continue

    def read(self, version: int | None = None, schema=None) -> DataFrame:
        """The rows of a version, the latest by default. An empty table needs a schema."""
        files = [f"{self.root}/{f['path']}" for r in self.runs(version) for f in r.files]
        read = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return read.parquet(*files) if files else self.spark.createDataFrame([], schema)

    def expire(self, keep: int = 1) -> int:
        """Delete versions but the last `keep`, and the files that only they name; the number of files deleted."""
        versions = [int(x.removesuffix(".json")) for x in self._names("versions")]
        old, new = versions[:-keep], versions[-keep:]
        held = {f["path"] for v in new for r in self.runs(v) for f in r.files}
        names = {r.name for v in new for r in self.runs(v)}
        gone = {f["path"] for v in old for r in self.runs(v) for f in r.files} - held
        dropped = {r.name for v in old for r in self.runs(v)} - names
        for v in old:
            self.fs.delete(self._path(f"versions/{v:012d}.json"), False)
        for path in gone:
            self.fs.delete(self._path(path), False)
        for name in dropped:
            self.fs.delete(self._path(f"runs/{name}.json"), False)
        return len(gone)


def deal(store: ShardStore, df: DataFrame, arrivals: int = ARRIVALS, key: str = "doc_id") -> int:
    """Append df in so many arrivals, dealt by a hash of the key (null keys together), with a compaction after each; the last version.
    An empty table commits none and gives 0."""
    for i in range(arrivals):
        store.append(df.filter(F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(arrivals)) == i))
        store.compact(df.schema)
    return store.version()


def op6_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document lies in the last version: run and file number, with the file's rows and bytes."""
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, f"{use_checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}")
    version = deal(store, docs)
    told = [(f["path"], i, j, f["rows"], f["bytes"], version) for i, r in enumerate(store.runs(version)) for j, f in enumerate(r.files)]
    shards = spark.createDataFrame(told, "path string, run int, shard int, shard_rows long, shard_bytes long, version int")
    placed = store.read(version, docs.schema).select("doc_id", F.concat(F.lit("data/"), F.element_at(F.split(F.input_file_name(), "/data/"), -1)).alias("path"))
    return placed.join(F.broadcast(shards), "path").drop("path")  # bounded: one row for each target-sized file
