"""Running totals over a whole table in a global order."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apidrift.llm.common import written


def totals_before(parts: DataFrame, total: str) -> DataFrame:
    """(part, before): the sum of ``total`` over all smaller ``part``; one row per part of a range partitioning."""
    sums = parts.groupBy("part").agg(F.sum(total).alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).cast("bigint").alias("before"))


def with_running_total(df: DataFrame, order: Sequence[Column], size: str, name: str) -> tuple[DataFrame, str]:
    """``df`` and the sum of ``size`` over all rows before, with the folder of the intermediate.

    Rows are range-partitioned by ``order`` (a total order, so no key can crowd one task), summed inside each
    part as it streams by, and moved by the totals of the parts before. Those are one row per part, which bounds
    what is broadcast, whatever the data.
    """

    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = before + np.cumsum(batch[size].to_numpy(zero_copy_only=False).astype(np.int64))
            starts = ends - batch[size].to_numpy(zero_copy_only=False)
            before = int(ends[-1]) if len(ends) else before
            new = [pa.array(starts, pa.int64()), pa.array(np.full(len(starts), part, np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, name, "part"])

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType()), T.StructField("part", T.LongType())])
    parts, path = written(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "running")
    moved = parts.join(F.broadcast(totals_before(parts, size)), "part")
    return moved.withColumn(name, F.col(name) + F.col("before")).drop("part", "before"), path
