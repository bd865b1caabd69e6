"""A keyed table in versions: hash buckets of files, and one manifest a version that names them.

A merge reads and rewrites only the buckets that the batch's keys fall into; all others are carried over by name. A
version exists from the moment its manifest does: the manifest is written aside and renamed to its final name, which fails if
another writer was first; then the merge starts again from that writer's version. Readers follow the
newest manifest, so they see a whole version or the one before it. The manifest also holds the last batch of each writer, so a
batch that is delivered again changes nothing, and the oldest time in each bucket, so that expiry rewrites only buckets
that hold something to expire. Renaming without overwriting must be atomic in the store (HDFS, local and most shared file systems).

Defined cases: an absent table is empty, version 0; an empty batch makes a version without new files (its number counts as
seen); a null key is a key; a bucket that loses its last row leaves the manifest.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from headwater.sources.tables import children, cut, file_system

_EMPTY = {"version": 0, "writers": {}, "buckets": {}}
TRIES = 5


class Conflict(RuntimeError):
    """Another writer made the version first."""


class BucketTable:
    """The table at ``path`` of rows with the columns of ``schema`` (DDL), one row for each value of ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 64, time_col: str | None = None):
        self.spark, self.path, self.key, self.buckets, self.time_col = spark, path.rstrip("/"), key, buckets, time_col
        self.schema: StructType = StructType.fromDDL(schema)

    # --- versions

    def versions(self) -> list[int]:
        names = children(self.spark, f"{self.path}/manifests")
        return sorted(int(n[:12]) for n in names if re.fullmatch(r"\d{12}\.json", n))

    def manifest(self, version: int | None = None) -> dict:
        found = self.versions() if version is None else [version]
        if not found or found[-1] == 0:
            return _EMPTY
        fs, place = file_system(self.spark, f"{self.path}/manifests/{found[-1]:012d}.json")
        data = fs.open(place)
        try:
            return json.loads(bytes(data.readAllBytes()).decode())
        finally:
            data.close()

    def _commit(self, manifest: dict) -> None:
        fs, final = file_system(self.spark, f"{self.path}/manifests/{manifest['version']:012d}.json")
        aside = f"{self.path}/manifests/.{uuid.uuid4().hex}.tmp"
        _, place = file_system(self.spark, aside)
        out = fs.create(place, False)
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()
        hadoop, gateway = self.spark._jvm.org.apache.hadoop.fs, self.spark.sparkContext._gateway
        context = hadoop.FileContext.getFileContext(fs.makeQualified(final).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(place), fs.makeQualified(final), gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
        except Py4JJavaError as error:
            fs.delete(place, False)
            if "FileAlreadyExists" in str(error.java_exception):
                raise Conflict(f"version {manifest['version']} exists") from None
            raise

    # --- reading

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _files(self, manifest: dict, buckets: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{b['path']}" for n, b in manifest["buckets"].items() if buckets is None or int(n) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._files(self.manifest(version))

    def look_up(self, keys: DataFrame) -> DataFrame:
        """The rows of the keys (a table with the key's column); only their buckets are read."""
        wanted = {r[0] for r in keys.select(self._bucket(F.col(self.key))).distinct().collect()}  # self.buckets at most
        return self._files(self.manifest(), wanted).join(keys.select(self.key).distinct(), self.key, "left_semi")

    # --- writing

    def _write(self, rows: DataFrame, version: int) -> dict[str, dict]:
        """Writes rows as files of their buckets; what the manifest says of each bucket."""
        at = f"data/{version:012d}-{uuid.uuid4().hex}"
        told = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema], self._bucket(F.col(self.key)).alias("_bucket"))
        told.repartition("_bucket").sortWithinPartitions("_bucket", self.key).write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{self.path}/{at}")
        if not any(n.startswith("_bucket=") for n in children(self.spark, f"{self.path}/{at}")):
            return {}
        written = self.spark.read.schema(StructType([*self.schema]).add("_bucket", IntegerType())).parquet(f"{self.path}/{at}")
        oldest = F.min(F.unix_micros(F.col(self.time_col).cast("timestamp"))) if self.time_col else F.lit(None).cast("long")
        sums = written.groupBy("_bucket").agg(F.count(F.lit(1)).alias("rows"), oldest.alias("oldest")).collect()  # a row a bucket
        out = {}
        for r in sums:
            fs, place = file_system(self.spark, f"{self.path}/{at}/_bucket={r['_bucket']}")
            out[str(r["_bucket"])] = {"path": f"{at}/_bucket={r['_bucket']}", "rows": r["rows"], "oldest": r["oldest"], "bytes": fs.getContentSummary(place).getLength()}
        return out

    def _next(self, base: dict, writer: str | None, batch: int | None, touched: set[int], rows: DataFrame | None) -> dict:
        """Commits the version after ``base`` in which ``rows`` are all rows of the touched buckets."""
        version = base["version"] + 1
        new = self._write(rows, version) if rows is not None else {}
        kept = {n: b for n, b in base["buckets"].items() if int(n) not in touched}
        writers = base["writers"] | ({writer: batch} if writer is not None else {})
        self._commit({"version": version, "writers": writers, "buckets": kept | new})
        return {
            "version": version, "changed": True, "touched": len(touched),
            "rows_written": sum(b["rows"] for b in new.values()), "bytes_written": sum(b["bytes"] for b in new.values()), "bytes_kept": sum(b["bytes"] for b in kept.values()),
        }

    def merge(self, batch: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], writer: str, batch_id: int) -> dict:
        """Merges a batch by ``combine(rows of the touched buckets, batch)``; what the merge did.

        A batch whose number is not above the last one of ``writer`` is skipped.
        """
        if batch_id <= self.manifest()["writers"].get(writer, -1):
            return {"version": self.manifest()["version"], "changed": False, "touched": 0, "rows_written": 0, "bytes_written": 0, "bytes_kept": 0}
        held = cut(batch, "merge-batch")
        touched = {r[0] for r in held.select(self._bucket(F.col(self.key))).distinct().collect()}  # self.buckets at most
        for _ in range(TRIES):
            base = self.manifest()
            if batch_id <= base["writers"].get(writer, -1):
                return {"version": base["version"], "changed": False, "touched": 0, "rows_written": 0, "bytes_written": 0, "bytes_kept": 0}
            try:
                return self._next(base, writer, batch_id, touched, combine(self._files(base, touched), held) if touched else None)
            except Conflict:
                continue
        raise Conflict(f"{TRIES} other writers were first")

    def expire(self, before: int) -> dict:
        """Drops rows whose time, in microseconds, lies before ``before``; buckets without such rows are not read."""
        for _ in range(TRIES):
            base = self.manifest()
            touched = {int(n) for n, b in base["buckets"].items() if b["oldest"] is not None and b["oldest"] < before}
            if not touched:
                return {"version": base["version"], "changed": False, "touched": 0, "rows_written": 0, "bytes_written": 0, "bytes_kept": 0}
            rows = self._files(base, touched)
            time = F.unix_micros(F.col(self.time_col).cast("timestamp"))
            try:
                return self._next(base, None, None, touched, rows.where(time.isNull() | (time >= before)))
            except Conflict:
                continue
        raise Conflict(f"{TRIES} other writers were first")

    def collect(self, keep: int = 2) -> int:
        """Forgets all versions but the last ``keep`` and deletes what no kept version names; how many folders went.

        Files of versions that are being written are newer than every kept version and stay.
        """
        found = self.versions()
        kept = found[-keep:]
        if not kept:
            return 0
        used = {b["path"] for v in kept for b in self.manifest(v)["buckets"].values()}
        for version in found[: -len(kept)]:
            fs, place = file_system(self.spark, f"{self.path}/manifests/{version:012d}.json")
            fs.delete(place, False)
        gone = 0
        for folder in children(self.spark, f"{self.path}/data"):
            if int(folder[:12]) > kept[-1]:
                continue
            inside = [n for n in children(self.spark, f"{self.path}/data/{folder}") if n.startswith("_bucket=")]
            old = [n for n in inside if f"data/{folder}/{n}" not in used]
            for name in [f"data/{folder}"] if len(old) == len(inside) else [f"data/{folder}/{n}" for n in old]:
                fs, place = file_system(self.spark, f"{self.path}/{name}")
                fs.delete(place, True)
            gone += len(old)
        return gone
