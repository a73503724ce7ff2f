"""Tables that grow batch by batch and can be written again: each batch is listed once, whatever was tried before.

Every attempt at a batch has a folder of its own below ``rows``; the newest file of ``manifest`` lists the attempt
that counts for each batch. Writing a batch again replaces its entry, so a repeated job leaves the table as it was, and
readers never see half a batch. Batches can be folded into one, which keeps the list short. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that the rows of an attempt are dealt into when they are looked up by a key.
BUCKETS = 32
#: Versions of the list that are kept for readers who are still at them.
KEPT_VERSIONS = 3


def bucket_of(key: Column | str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class BatchStore:
    """A folder of batches in ``form`` (parquet or csv with the given options)."""

    def __init__(self, spark: SparkSession, path: str, form: str = "parquet", **options):
        self.spark, self.path, self.form, self.options = spark, path.rstrip("/"), form, options
        context = spark.sparkContext
        self._path = context._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(context._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        place = self._path(folder)
        return sorted(f.getPath().getName() for f in self._files.listStatus(place)) if self._files.exists(place) else []

    def _versions(self) -> list[str]:
        return [name for name in self._names(f"{self.path}/manifest") if name.isdigit()]

    def exists(self) -> bool:
        return bool(self._versions())

    def batches(self) -> dict[str, str]:
        """The attempt that counts for each batch; empty for a batch without rows."""
        versions = self._versions()
        if not versions:
            return {}
        stream = self._files.open(self._path(f"{self.path}/manifest/{versions[-1]}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, rows: DataFrame, batch: object, key: str | None = None, replaces: Iterable[object] = ()) -> None:
        """Make ``rows`` the content of ``batch``, in buckets by ``key``; ``replaces`` names batches that end with it."""
        attempt = f"attempt={batch}-{uuid.uuid4().hex}"
        writer = rows.withColumn("bucket", bucket_of(key)).hint("rebalance", "bucket").write.partitionBy("bucket") if key else rows.write
        writer.format(self.form).options(**self.options).save(f"{self.path}/rows/{attempt}")
        full = any(not name.startswith(("_", ".")) for name in self._names(f"{self.path}/rows/{attempt}"))
        gone = {str(b) for b in replaces}
        listed = {b: a for b, a in self.batches().items() if b not in gone} | {str(batch): attempt if full else ""}
        self._commit(listed)

    def _commit(self, listed: dict[str, str]) -> None:
        versions = self._versions()
        number = int(versions[-1]) + 1 if versions else 0
        hidden = self._path(f"{self.path}/manifest/_{uuid.uuid4().hex}")
        stream = self._files.create(hidden, False)
        stream.write(bytearray(json.dumps(listed).encode()))
        stream.close()
        if not self._files.rename(hidden, self._path(f"{self.path}/manifest/{number:012d}")):
            raise RuntimeError(f"another writer has committed to {self.path}")
        for old in versions[: -KEPT_VERSIONS + 1]:
            self._files.delete(self._path(f"{self.path}/manifest/{old}"), False)

    def paths(self, batches: Iterable[object] | None = None) -> list[str]:
        """Folders of the given batches, else of all."""
        listed = self.batches()
        wanted = listed if batches is None else [str(b) for b in batches if str(b) in listed]
        return [f"{self.path}/rows/{listed[b]}" for b in wanted if listed[b]]

    def read(self, schema, batches: Iterable[object] | None = None) -> DataFrame:
        """Rows of parquet batches; without any, an empty table of ``schema``."""
        paths = self.paths(batches)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def vacuum(self) -> None:
        """Delete attempts that no kept version of the list names."""
        named = set()
        for version in self._versions():
            stream = self._files.open(self._path(f"{self.path}/manifest/{version}"))
            named |= set(json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).values())
            stream.close()
        for name in self._names(f"{self.path}/rows"):
            if name not in named:
                self._files.delete(self._path(f"{self.path}/rows/{name}"), True)
