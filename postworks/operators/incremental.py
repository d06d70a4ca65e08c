"""What is new against a stored table, and the stored table itself."""

from __future__ import annotations

import json
import uuid
import zlib
from dataclasses import astuple, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postworks.functions.names import free


def known_keys(rows: DataFrame, stored: DataFrame | SnapshotTable, vendor: str | None = "vendor", key: str = "dedupe_key") -> DataFrame:
    """Keys of rows that are stored, for the vendor or for any."""
    if isinstance(stored, SnapshotTable):
        return stored.matching(rows, vendor, key)
    on = [c for c in (vendor, key) if c]
    return rows.where(F.col(key) != "").select(*on).distinct().join(stored.select(*on), on, "left_semi")


def skip_known(rows: DataFrame, stored: DataFrame | SnapshotTable, vendor: str | None = "vendor", key: str = "dedupe_key") -> DataFrame:
    """Rows whose key isn't stored; rows with a blank key are all new."""
    on = [c for c in (vendor, key) if c]
    known = stored.matching(rows, vendor, key) if isinstance(stored, SnapshotTable) else stored.where(F.col(key) != "").select(*on).distinct()
    return rows.join(known, on, "left_anti").select(*rows.columns)


def new_keys(seen: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys that were seen and are not stored."""
    return seen.select(*keys).distinct().join(stored.select(*keys), list(keys), "left_anti")


def with_artifacts(listing: DataFrame, artifacts: DataFrame, url: str = "detail_url") -> DataFrame:
    """Listing rows with the artefacts of their page, where there are any."""
    return listing.join(artifacts, url, "left")


def merged(stored: DataFrame, incoming: DataFrame, now: Column, order: str, vendor: str = "vendor", key: str = "dedupe_key") -> DataFrame:
    """The stored table after an upsert: the last incoming row of a key replaces the stored one, nulls too.

    first_seen stays as it was; updated_at is now for rows that came in.
    """
    new, old_ = free("_new", stored.columns), free("_old", stored.columns)
    values = [c for c in stored.columns if c not in (vendor, key, "first_seen", "updated_at")]
    last = incoming.groupBy(vendor, key).agg(F.max_by(F.struct(*values), order).alias(new))
    old = stored.select(vendor, key, F.struct(*values).alias(old_), "first_seen", "updated_at")
    both = old.join(last, [vendor, key], "full_outer")
    came = F.col(new).isNotNull()
    chosen = F.when(came, F.col(new)).otherwise(F.col(old_))
    return both.select(vendor, key, *[chosen[c].alias(c) for c in values], F.coalesce("first_seen", now).alias("first_seen"), F.when(came, now).otherwise(F.col("updated_at")).alias("updated_at")).select(*stored.columns)


class Conflict(Exception):
    """Another writer has committed the version."""


#: Parts (vendor and bucket) that one upsert may touch; bytes of keys that are sent to all tasks.
MOST_PARTS, BROADCAST_BYTES = 200_000, 32 << 20


@dataclass(frozen=True)
class Part:
    """A file of the table: rows of one vendor whose keys fall into one bucket."""

    vendor: str | None
    bucket: int
    path: str
    low: str
    high: str
    rows: int


@dataclass
class Manifest:
    """A version: its schema, its files with the range of their keys, and the last batch that each stream has committed."""

    version: int = 0
    schema: T.StructType | None = None
    files: list[Part] = field(default_factory=list)
    batches: dict[str, int] = field(default_factory=dict)


class SnapshotTable:
    """A table of keyed rows as Parquet files, one for each vendor and bucket of keys, and a manifest for each version.

    The bucket is a hash of the key. Manifests name files with the smallest and
    largest key in them, so a key is looked up in one file, and rows that come in
    are compared with the buckets they fall into. An upsert writes these buckets
    anew and commits the version after the one that it has read, by a rename that
    fails if that version is there. A writer that comes second reads again and
    repeats its merge, so no update is lost. The rename is one step on HDFS and on
    local disks; an object store without such a rename is not supported.

    A stream says which of its batches a commit holds; the manifest records it
    with the rows, so a batch that comes again is not merged again.

    The number of buckets is fixed when the table is first written; a vendor with a
    large share of all rows is spread over all buckets.
    """

    def __init__(self, spark: SparkSession, path: str, vendor: str = "vendor", key: str = "dedupe_key", buckets: int = 16):
        self.spark, self.path, self.vendor, self.key, self.buckets = spark, path.rstrip("/"), vendor, key, buckets
        jvm = spark.sparkContext._jvm
        self._jvm, self._path = jvm, jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self.manifest()

    def _names(self, folder: str) -> list[str]:
        p = self._path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self._names("manifests") if n.startswith("v")]

    def manifest(self, version: int | None = None) -> Manifest:
        """The manifest of a version, of the last one by default; version 0 is the empty table."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return Manifest()
        stream = self._fs.open(self._path(f"{self.path}/manifests/v{version:010d}.json"))
        try:
            m = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        self.buckets = m["buckets"]
        return Manifest(version, T.StructType.fromJson(m["schema"]), [Part(*f) for f in m["files"]], m["batches"])

    def _read(self, schema: T.StructType, files: list[Part]) -> DataFrame:
        paths = sorted({f"{self.path}/{f.path}" for f in files})
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None, vendors: list[str] | None = None) -> DataFrame | None:
        """The table of a version (the last one by default), or only the files of some vendors."""
        m = self.manifest(version)
        return None if m.schema is None else self._read(m.schema, [f for f in m.files if vendors is None or f.vendor in vendors])

    def lookup(self, vendor: str, key: str, version: int | None = None) -> DataFrame | None:
        """The row of a key, from the one file that can hold it."""
        m = self.manifest(version)
        if m.schema is None:
            return None
        bucket = zlib.crc32(key.encode()) % self.buckets
        files = [f for f in m.files if f.vendor == vendor and f.bucket == bucket and f.low <= key <= f.high]
        return self._read(m.schema, files).where((F.col(self.vendor) == vendor) & (F.col(self.key) == key))

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.crc32(F.coalesce(F.col(key), F.lit(""))), F.lit(self.buckets)).cast("int")

    def matching(self, rows: DataFrame, vendor: str | None = "vendor", key: str = "dedupe_key", version: int | None = None) -> DataFrame:
        """Distinct keys of rows that are stored too, for the vendor or for any; blank ones don't count.

        The stored table is not shuffled. Keys that come in are gathered by bucket
        into blocks of a checked size; each block is sent to the tasks that read the
        block's files, and every file is read for one block only. Beyond that size
        for a single bucket, or for a column that the buckets don't follow, an
        ordinary join is left to Spark.
        """
        m = self.manifest(version)
        on = [c for c in (vendor, key) if c]
        kinds = dict(rows.dtypes)
        none = self.spark.createDataFrame([], ", ".join(f"`{c}` {kinds[c]}" for c in on))
        if m.schema is None:
            return none
        number = free("_bucket", rows.columns)
        staged = f"{self.path}/data/keys-{uuid.uuid4().hex}"
        rows.where(F.coalesce(F.col(key), F.lit("")) != "").select(*on).distinct().withColumn(number, self._bucket(key)).write.parquet(staged)
        keys = self.spark.read.parquet(staged)
        size = F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in on), F.lit(32)))
        sizes = {r[0]: r[1] for r in keys.groupBy(number).agg(size).collect()}  # a number for each bucket
        if key == self.key:
            blocks, large = _blocks(sizes, BROADCAST_BYTES)
        else:
            blocks, large = ([sorted(sizes)], []) if sum(sizes.values()) <= BROADCAST_BYTES else ([], [sorted(sizes)])
        found = none
        for block, sent in [(b, True) for b in blocks if b] + [(b, False) for b in large if b]:
            files = [f for f in m.files if key != self.key or f.bucket in block]
            own = keys.where(F.col(number).isin(block)).drop(number)
            stored = self._read(m.schema, files).select(*on)
            # The block's bytes were summed above.
            found = found.union(stored.join(F.broadcast(own) if sent else own, on, "left_semi"))
        return found.distinct() if key != self.key or not vendor else found

    def _write(self, df: DataFrame) -> list[Part]:
        folder, bucket = f"data/{uuid.uuid4().hex}", free("_bucket", df.columns)
        part = free("_part", df.columns)
        # Folders are named by a hash of the vendor, as its name may not do for a path.
        name = F.concat(F.md5(F.coalesce(F.col(self.vendor), F.lit("")).cast("string")), F.when(F.col(self.vendor).isNull(), "n").otherwise("v"), self._bucket(self.key).cast("string"))
        df.withColumn(part, name).repartition(part).sortWithinPartitions(part, self.key).write.partitionBy(part).parquet(f"{self.path}/{folder}")
        rows = self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}")
        key = F.coalesce(F.col(self.key), F.lit("")).cast("string")
        made = rows.select(F.col(self.vendor).cast("string").alias("v"), self._bucket(self.key).alias(bucket), F.col("_metadata.file_name").alias("f"), key.alias("k"), name.alias("p"))
        stats = made.groupBy("v", bucket, "p", "f").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count("*").alias("n")).collect()  # a row for each file
        return [Part(r.v, r[bucket], f"{folder}/{part}={r.p}/{r.f}", r.low, r.high, r.n) for r in stats]

    def _commit(self, m: Manifest) -> None:
        self._fs.mkdirs(self._path(f"{self.path}/manifests"))
        draft = self._path(f"{self.path}/manifests/draft-{uuid.uuid4().hex}")
        files = [list(astuple(f)) for f in sorted(m.files, key=lambda f: (f.vendor or "", f.bucket, f.path))]
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"schema": m.schema.jsonValue(), "buckets": self.buckets, "files": files, "batches": m.batches}).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(draft, self._path(f"{self.path}/manifests/v{m.version:010d}.json"), options)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {m.version} is there already") from e
            raise

    def write(self, df: DataFrame, read: int | None = None) -> int:
        """Replace the whole table. read: the version that df was made from; if another one is the last by now, that is a Conflict."""
        last = self.manifest(read)
        self._commit(Manifest(last.version + 1, df.schema, self._write(df), last.batches))
        return last.version + 1

    def stage(self, df: DataFrame) -> DataFrame:
        """The rows, written beside the table and read again, until the table is vacuumed."""
        path = f"{self.path}/data/incoming-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def storable(self) -> Column:
        """Whether a row has a key and a vendor."""
        return (F.coalesce(F.col(self.key), F.lit("")) != "") & (F.coalesce(F.col(self.vendor), F.lit("")) != "")

    def upsert(self, incoming: DataFrame, now: Column, order: str, batch: tuple[str, int] | None = None, staged: bool = False) -> DataFrame:
        """Merge rows in; rows with a blank key or without a vendor are not stored but returned.

        The rows are written first, unless they are staged already, so that a repeated merge doesn't make them anew.
        batch: a stream and the number of its batch; one that the table has already,
        or that is older than one it has, changes nothing.
        """
        good = self.storable()
        came = incoming if staged else self.stage(incoming)
        rows = came.where(good)
        touched = {(r[0], r[1]) for r in rows.select(F.col(self.vendor).cast("string"), self._bucket(self.key)).distinct().limit(MOST_PARTS + 1).collect()}
        if len(touched) > MOST_PARTS:
            raise ValueError(f"an upsert touches more than {MOST_PARTS} parts: use fewer buckets, or give the vendors in turn")
        while touched or batch:
            m = self.manifest()
            if batch and m.batches.get(batch[0], -1) >= batch[1]:
                break
            schema = m.schema or rows.drop(order).withColumns({"first_seen": now, "updated_at": now}).schema
            stay = [f for f in m.files if (f.vendor, f.bucket) not in touched]
            stored = self._read(schema, [f for f in m.files if (f.vendor, f.bucket) in touched])
            made = self._write(merged(stored, rows, now, order, self.vendor, self.key)) if touched else []
            try:
                self._commit(Manifest(m.version + 1, schema, stay + made, m.batches | ({batch[0]: batch[1]} if batch else {})))
                break
            except Conflict:
                continue
        return came.where(~good)

    def vacuum(self, keep: int = 1) -> int:
        """Delete manifests but the last `keep`, folders that only those named, and staged rows; returns the number of folders.

        No writer may be at work, and no result that reads staged rows may be wanted still.
        """
        versions = sorted(self.versions())
        kept, gone = versions[-keep:], versions[:-keep]
        folders = lambda some: {f.path.rpartition("/")[0] for v in some for f in self.manifest(v).files}
        old = folders(gone) - folders(kept) | {f"data/{n}" for n in self._names("data") if n.startswith(("incoming-", "keys-"))}
        for f in sorted(old):
            self._fs.delete(self._path(f"{self.path}/{f}"), True)
        for v in gone:
            self._fs.delete(self._path(f"{self.path}/manifests/v{v:010d}.json"), False)
        return len(old)


def _blocks(sizes: dict[int, int], most: int) -> tuple[list[list[int]], list[list[int]]]:
    """Buckets in blocks of so many bytes at most, and those that are larger alone."""
    blocks, held, large = [[]], 0, []
    for bucket, size in sorted(sizes.items()):
        if size > most:
            large.append([bucket])
            continue
        if held + size > most:
            blocks.append([])
            held = 0
        blocks[-1].append(bucket)
        held += size
    return blocks, large
