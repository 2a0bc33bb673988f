"""A table of rows with keys that takes changes at the cost of the changes.

Rows lie in ``buckets`` by a hash of their keys. A merge writes the changed rows alone, as a delta of their buckets; where
a bucket's deltas outgrow a share of its rows (``COMPACT``), that bucket is written anew, and only that one. What a bucket
consists of stands in a manifest, one small file a version: the next version comes into being when its manifest is renamed
into place, so a reader sees the table before a merge or after it, never between. Files of older versions stay until
`vacuum`, for readers that still use them.

Rows of a key are merged column by column: by default the newest row's value, or as `combine` says (first written, largest).
Writers may give a name and a batch number; a number that the table has already seen is passed over, so that a stream's
batch that is run again changes nothing, whatever the writer did in between.

The driver handles bucket numbers and counts, never rows. Writers are expected one at a time: the second of two that
start from the same version fails and can start again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Deltas of a bucket up to this share of its rows stay beside them.
COMPACT = 0.5
_BUCKET, _SEQ = "_bucket", "_seq"
Combine = Callable[[Column, Column], Column]


def newest(value: Column, seq: Column) -> Column:
    return F.max_by(value, seq)


def first_written(value: Column, seq: Column) -> Column:
    return F.min_by(value, seq)


def largest(value: Column, seq: Column) -> Column:
    return F.max(value)


class Conflict(RuntimeError):
    """Another writer has made the version that this one was about to make."""


class KeyedTable:
    """schema: DDL or a struct of all columns. gone: a predicate; rows that meet it are left out by readers and dropped
    when their bucket is written anew."""

    def __init__(self, spark: SparkSession, path: str, schema, keys: tuple[str, ...], buckets: int = 16, combine: dict[str, Combine] | None = None, gone: str | None = None) -> None:
        self.spark, self.path, self.keys, self.combine, self.gone = spark, path.rstrip("/"), keys, combine or {}, gone
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = self.schema.names
        stated = self._manifest()
        self.buckets = stated["buckets"] if stated["version"] else buckets  # as the table was made

    # versions

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions/{name}")

    def versions(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(path) if s.getPath().getName().endswith(".json"))

    def _manifest(self, version: int | None = None) -> dict:
        """version, buckets, seen (last batch of each writer), parts: bucket -> rows, extra (rows of deltas), folders."""
        known = self.versions()
        if not known:
            return {"version": 0, "buckets": 0, "seen": {}, "parts": {}}
        stream = self._fs()[0].open(self._path(f"{version or known[-1]:020d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        fs, _ = self._fs()
        target, made = self._path(f"{manifest['version']:020d}.json"), self._path(f".{uuid.uuid4().hex}")
        out = fs.create(made, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(made, target):
            fs.delete(made, False)
            raise Conflict(f"version {manifest['version']} of {self.path} is there already")

    # rows

    def _stored(self, parts: list[dict]) -> DataFrame:
        """Rows of some buckets as they lie in the files, with the order in which they were written."""
        folders = [f"{self.path}/data/{f}" for p in parts for f in p["folders"]]
        kind = StructType([*self.schema.fields, StructField(_SEQ, LongType())])
        if not folders:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*folders)

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One row a key."""
        rule = {c: self.combine.get(c, newest)(F.col(c), F.col(_SEQ)).alias(c) for c in self.columns if c not in self.keys}
        return rows.groupBy(*self.keys).agg(F.max(_SEQ).alias(_SEQ), *rule.values()).select(*self.columns, _SEQ)

    def _live(self, rows: DataFrame) -> DataFrame:
        return rows.where(~F.coalesce(F.expr(self.gone), F.lit(False))) if self.gone else rows

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of now, or of a version that is still kept. Buckets without deltas are read as they are; rows are
        merged in the others alone."""
        parts = list(self._manifest(version)["parts"].values())
        plain, layered = [p for p in parts if len(p["folders"]) < 2], [p for p in parts if len(p["folders"]) > 1]
        rows = self._stored(plain)
        if layered:
            rows = rows.unionByName(self._merged(self._stored(layered)))
        return self._live(rows).select(*self.columns)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame) -> tuple[str, dict[int, int]]:
        """Rows with _bucket and _seq into a new folder, a subfolder a bucket; its name and the rows of each bucket."""
        name = uuid.uuid4().hex
        rows.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/data/{name}")
        counts = self.spark.read.schema(f"{_SEQ} long, {_BUCKET} int").parquet(f"{self.path}/data/{name}").groupBy(_BUCKET).count().collect()  # a row a bucket
        return name, {r[_BUCKET]: r["count"] for r in counts}

    def merge(self, changes: DataFrame, writer: str | None = None, batch: int | None = None) -> int | None:
        """Adds the changes: one row a key, or several where `combine` takes them in any order (as `largest` does). Gives the
        new version, or None where this batch has been merged before."""
        now = self._manifest()
        if writer is not None and now["seen"].get(writer, -1) >= batch:
            return None
        version, parts = now["version"] + 1, dict(now["parts"])
        own = self._merged(changes.select(*self.columns).withColumn(_SEQ, F.lit(version).cast("long")))
        name, counts = self._write(self._bucketed(own))
        grown = []
        for bucket, n in counts.items():
            folder, old = f"{name}/{_BUCKET}={bucket}", parts.get(str(bucket))
            if old is None:
                parts[str(bucket)] = {"rows": n, "extra": 0, "folders": [folder]}
                continue
            parts[str(bucket)] = {"rows": old["rows"], "extra": old["extra"] + n, "folders": [*old["folders"], folder]}
            if old["extra"] + n > COMPACT * old["rows"]:
                grown.append(bucket)
        if grown:
            self._compact(parts, grown)
        seen = now["seen"] | ({writer: batch} if writer is not None else {})
        self._commit({"version": version, "buckets": self.buckets, "seen": seen, "parts": parts})
        return version

    def _compact(self, parts: dict, buckets: list[int]) -> None:
        """These buckets, with their deltas, written anew."""
        rows = self._bucketed(self._live(self._merged(self._stored([parts[str(b)] for b in buckets]))))
        name, counts = self._write(rows)
        for b in buckets:
            if b in counts:
                parts[str(b)] = {"rows": counts[b], "extra": 0, "folders": [f"{name}/{_BUCKET}={b}"]}
            else:
                del parts[str(b)]

    def replace(self, rows: DataFrame) -> int:
        """All rows at once, in place of what is there."""
        now = self._manifest()
        name, counts = self._write(self._bucketed(rows.select(*self.columns).withColumn(_SEQ, F.lit(now["version"] + 1).cast("long"))))
        parts = {str(b): {"rows": n, "extra": 0, "folders": [f"{name}/{_BUCKET}={b}"]} for b, n in counts.items()}
        self._commit({"version": now["version"] + 1, "buckets": self.buckets, "seen": now["seen"], "parts": parts})
        return now["version"] + 1

    def vacuum(self, keep: int = 2) -> None:
        """Deletes what none of the last `keep` versions uses: older manifests, and folders of data, those of merges that
        never came to an end included. No merge may be under way."""
        fs, _ = self._fs()
        known = self.versions()
        used = {f.split("/")[0]: None for v in known[-keep:] for p in self._manifest(v)["parts"].values() for f in p["folders"]}
        data = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        for status in fs.listStatus(data) if fs.exists(data) else ():
            if status.getPath().getName() not in used:
                fs.delete(status.getPath(), True)
        for v in known[:-keep]:
            fs.delete(self._path(f"{v:020d}.json"), False)
