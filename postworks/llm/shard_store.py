"""Operator 6: a store of immutable shards with size-tiered compaction.

Arrivals are appended as small Parquet files that never change. Compaction looks
for runs of similar size: files fall into tiers by their size, each tier
`fanout` times the one below; a tier of at least `fanout` files is merged into
files of about `target_bytes`. Which files make up the table is told by a
manifest, a small JSON file with a version number. A change writes its data
first, in a job that Spark repeats where executors are lost, and then commits
the next version in one step: a rename that fails if someone else has committed
it. Readers see one version or the next, never part of a change. The rename is
one step on HDFS and on local disks; object stores without such a rename are not
supported. What failed writes leave behind is deleted by `vacuum(stray=True)`.

Defined results: an append of an empty table commits a version without new
shards; rows, nulls, repeated rows and all columns are kept as they are; every
append must have the columns of the first, in any order.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Shard:
    path: str  # below the store's data folder
    bytes: int
    arrival: str


class Conflict(Exception):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, fanout: int = 4, tier_bytes: int = 1 << 20):
        self.spark, self.path = spark, path.rstrip("/")
        self.target_bytes, self.fanout, self.tier_bytes = target_bytes, fanout, tier_bytes
        jvm = spark.sparkContext._jvm
        self._jvm, self._path = jvm, jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def _list(self, folder: str) -> list:
        p = self._path(f"{self.path}/{folder}")
        return list(self._fs.listStatus(p)) if self._fs.exists(p) else []

    def versions(self) -> list[int]:
        return sorted(int(s.getPath().getName()[1:-5]) for s in self._list("manifests") if s.getPath().getName().startswith("v"))

    def manifest(self, version: int | None = None) -> tuple[int, str | None, list[Shard]]:
        """Version, schema as JSON, and shards; version 0 is the empty table."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return 0, None, []
        text = self.spark.read.text(f"{self.path}/manifests/v{version:010d}.json", wholetext=True).first()[0]
        m = json.loads(text)
        return version, m["schema"], [Shard(**s) for s in m["shards"]]

    def _commit(self, version: int, schema: str | None, shards: list[Shard]) -> int:
        self._fs.mkdirs(self._path(f"{self.path}/manifests"))
        draft = self._path(f"{self.path}/manifests/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"schema": schema, "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(draft, self._path(f"{self.path}/manifests/v{version:010d}.json"), options)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} is there already") from e
            raise
        return version

    def _write(self, df: DataFrame, arrival: str, by: str | None = None) -> list[Shard]:
        folder = uuid.uuid4().hex
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/data/{folder}")
        found = []
        folders = [folder] if not by else [f"{folder}/{s.getPath().getName()}" for s in self._list(f"data/{folder}") if s.isDirectory()]
        for f in folders:
            own = f.rpartition("=")[2] if by else arrival
            found += [Shard(f"{f}/{s.getPath().getName()}", s.getLen(), own) for s in self._list(f"data/{f}") if s.getPath().getName().endswith(".parquet")]
        return found

    def append(self, df: DataFrame, arrival: str | None = None) -> int:
        """Add an arrival; returns the version."""
        shards = self._write(df, arrival or uuid.uuid4().hex)
        return self._add(shards, df.schema)

    def append_arrivals(self, df: DataFrame, by: str) -> list[int]:
        """Add the arrivals that the column `by` tells apart, a version each, from one scan."""
        shards = self._write(df, "", by)
        schema = T.StructType([f for f in df.schema if f.name != by])
        return [self._add([s for s in shards if s.arrival == a], schema) for a in sorted({s.arrival for s in shards})]

    def _add(self, shards: list[Shard], schema: T.StructType) -> int:
        while True:
            version, known, old = self.manifest()
            if known and {(f.name, f.dataType.simpleString()) for f in T.StructType.fromJson(json.loads(known))} != {(f.name, f.dataType.simpleString()) for f in schema}:
                raise ValueError("the columns are not those of the store")
            try:
                return self._commit(version + 1, known or schema.json(), [*old, *shards])
            except Conflict:
                continue

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.tier_bytes, self.fanout)) + 1) if size > self.tier_bytes else 0

    def compact(self) -> int | None:
        """Merge the lowest tier with enough files; the new version, or None if there is nothing to do."""
        version, schema, shards = self.manifest()
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target_bytes // 2:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        full = [k for k, v in sorted(tiers.items()) if len(v) >= self.fanout]
        if not full:
            return None
        runs = tiers[full[0]]
        files = max(1, round(sum(s.bytes for s in runs) / self.target_bytes))
        # Narrow: each task reads whole runs and writes one file.
        merged = self._write(self._read(runs, schema).coalesce(files), "merged")
        gone = {s.path for s in runs}
        while True:
            version, schema, shards = self.manifest()
            if not gone <= {s.path for s in shards}:
                raise Conflict("another compaction took these runs")
            try:
                return self._commit(version + 1, schema, [*(s for s in shards if s.path not in gone), *merged])
            except Conflict:
                continue

    def _read(self, shards: list[Shard], schema: str | None) -> DataFrame:
        fields = T.StructType.fromJson(json.loads(schema)) if schema else T.StructType([])
        if not shards:
            return self.spark.createDataFrame([], fields)
        return self.spark.read.schema(fields).parquet(*[f"{self.path}/data/{s.path}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """The table of a version; the last one by default."""
        _, schema, shards = self.manifest(version)
        return self._read(shards, schema)

    def vacuum(self, keep: int = 1, stray: bool = False) -> int:
        """Delete manifests but the last `keep`, and files that none of those names; returns the number of files.

        stray: also folders that no manifest names a file of; no writer may be at work then.
        """
        versions = self.versions()
        kept, gone = versions[-keep:], versions[:-keep]
        named = {s.path for v in kept for s in self.manifest(v)[2]}
        # What no manifest has named yet may belong to a change that is being written, so only named files go.
        old = {s.path for v in gone for s in self.manifest(v)[2]} - named
        for p in sorted(old):
            self._fs.delete(self._path(f"{self.path}/data/{p}"), False)
        for v in gone:
            self._fs.delete(self._path(f"{self.path}/manifests/v{v:010d}.json"), False)
        if stray:
            for s in self._list("data"):
                if not any(p.startswith(s.getPath().getName() + "/") for p in named):
                    self._fs.delete(s.getPath(), True)
        return len(old)


def arrival_of(column: str, arrivals: int) -> F.Column:
    """A number below `arrivals` by a hash of a column's text; null counts as empty."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(arrivals))
