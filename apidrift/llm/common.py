"""What the operators of this subpackage share: words of Arrow columns, row ids, written intermediates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apidrift.session import fresh_path

#: Text handled at once inside a task; a longer text is handled alone and whole.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """``df`` written once to the shared folder and read back, with the folder for a later ``drop``."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete intermediates that nothing will read again."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """A number per row of a scan; stable once written, so repeated ids stay separate rows."""
    return df.withColumn(name, F.monotonically_increasing_id())


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut to rows with about ``limit`` bytes in ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, before + limit, side="right")), start + 1)
            # A copy: some Arrow string functions read past the offsets of a slice.
            yield batch.take(pa.array(np.arange(start, stop)))
            start = stop
            pa.default_memory_pool().release_unused()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of characters other than space and \\x09-\\x0D: all words in order, and the number of each text (null: none)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = pc.list_flatten(lists)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if full.all():
        return flat, counts
    owner = np.repeat(np.arange(len(counts)), counts)
    return flat.filter(pa.array(full)), np.bincount(owner[full], minlength=len(counts)).astype(np.int64)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of ``counts`` values along the first axis."""
    kind = np.int64 if values.dtype.kind in "biu" else np.float64
    total = np.concatenate([np.zeros((1, *values.shape[1:]), kind), np.cumsum(values, axis=0, dtype=kind)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
