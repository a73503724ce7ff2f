"""Running values over long ordered groups, without putting one group into one task.

Rows are range-partitioned by group and order, the window runs inside each slice, and what a slice must know of the
earlier slices of its group travels as one summary row per slice and group. The plan is the same for every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apidrift.session import materialize

#: Rows that one task sorts at a time.
ROWS_PER_TASK = 250_000


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    *,
    number: str | None = None,
    previous: dict[str, Column] | None = None,
    last_where: dict[str, tuple[Column, Column]] | None = None,
    last_number: dict[str, str] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Add running columns per group ``by`` in the given total ``order``.

    * ``number``: 1-based position.
    * ``previous``: name -> value of the row before, NULL on the first row.
    * ``last_where``: name -> (condition, value): value of the latest earlier row that meets the condition.
    * ``last_number``: name -> name in ``last_where``: position of that row.

    Rows with a NULL key are a group of their own. ``slices`` is the number of slices, else that of shuffle partitions.
    """
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _sliced(df, list(by), list(order), number, previous or {}, last_where or {}, last_number or {}, slices)


def _sliced(df, by, order, number, previous, last_where, last_number, slices) -> DataFrame:
    carried = {f"_value_{i}": value for i, value in enumerate(previous.values())}
    marked = {
        f"_mark_{i}": F.when(condition, F.struct(value.alias("v")))
        for i, (condition, value) in enumerate(last_where.values())
    }
    # Range bounds come from a sample, so the slices must be written down before they are read twice.
    rows = materialize(
        df.withColumns({**carried, **marked})
        .repartitionByRange(slices, *by, *order)
        .withColumn("_slice", F.spark_partition_id()),
        "slices",
    )
    key = ["_slice", *by]
    # By the number of rows: adaptive execution would join what is small when compressed, whatever it takes in memory.
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, rows.count() // ROWS_PER_TASK)
    # What a slice hands on needs no dealing first unless it needs numbers: few rows are left of those of one file.
    ends = None if marked else rows
    rows = rows.repartition(tasks, *key)
    inside = Window.partitionBy(*key).orderBy(*order)
    inside_earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_number", F.row_number().over(inside))
    # A marked row takes along its number, inside the slice here and in its whole group below.
    for name in marked:
        numbered_mark = F.struct(F.col(name)["v"].alias("v"), F.col("_number").alias("n"))
        rows = rows.withColumn(name, F.when(F.col(name).isNotNull(), numbered_mark))
    local = {}
    for name in carried:
        local[f"{name}_lag"] = F.lag(F.struct(name)).over(inside)
    for name in marked:
        local[f"{name}_lag"] = F.last(name, ignorenulls=True).over(inside_earlier)
    numbered = rows.withColumns(local)

    position = F.struct(*order)
    summary = (rows if ends is None else ends).groupBy(*key).agg(
        F.count(F.lit(1)).alias("_count"),
        *[F.max_by(F.struct(name), position).alias(f"{name}_end") for name in carried],
        *[F.max(F.when(F.col(name).isNotNull(), F.struct(position.alias("p"), F.col(name)))).alias(f"{name}_end") for name in marked],
    )
    across = Window.partitionBy(*by).orderBy("_slice")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.col("_offset"), F.lit(0))
    summary = summary.withColumn("_offset", F.sum("_count").over(before))
    for name in marked:
        end = F.col(f"{name}_end")
        of_group = F.struct(end["p"].alias("p"), end[name]["v"].alias("v"), (end[name]["n"] + offset).alias("n"))
        summary = summary.withColumn(f"{name}_end", F.when(end.isNotNull(), of_group))
    # Only groups that run over a slice border need it: at most one row per slice, whatever the data. So few rows
    # are broadcast, and the others stay where they are.
    handed = (
        summary.withColumns(
            {
                **{f"{name}_before": F.lag(f"{name}_end").over(across) for name in carried},
                **{f"{name}_before": F.max(f"{name}_end").over(before) for name in marked},
            }
        )
        .filter(F.col("_offset").isNotNull())
        .select(*[F.col(c).alias(f"_h{c}") for c in key], "_offset", *[f"{name}_before" for name in [*carried, *marked]])
    )
    same_group = [F.col(c).eqNullSafe(F.col(f"_h{c}")) for c in key]
    joined = numbered.join(F.broadcast(handed), same_group, "left")
    columns = {}
    if number:
        columns[number] = F.col("_number") + offset
    for name, inner in zip(previous, carried):
        columns[name] = F.coalesce(F.col(f"{inner}_lag"), F.col(f"{inner}_before"))[inner]
    inner_names = dict(zip(last_where, marked))
    for name, inner in inner_names.items():
        here = F.col(f"{inner}_lag")
        columns[name] = F.when(here.isNotNull(), here["v"]).otherwise(F.col(f"{inner}_before")["v"])
    for name, marked_as in last_number.items():
        inner = inner_names[marked_as]
        columns[name] = F.coalesce(F.col(f"{inner}_lag")["n"] + offset, F.col(f"{inner}_before")["n"])
    return joined.withColumns(columns).select(*df.columns, *columns)


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str, slices: int | None = None) -> DataFrame:
    """Row number per group, safe for groups of any length."""
    return running(df, by, order, number=name, slices=slices)
