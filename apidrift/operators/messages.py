"""Change rows: how rules emit them, how repeats collapse and how a report reads.

A rule row names the object it is about (``obj_key``), how that object is printed (``node``), the part
of it, the text and the side. ``step`` is the place of the rule in the order of evaluation and ``cause``
its family; both only serve to choose between rows about the same part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apidrift.functions.wording import change_node, change_text

MESSAGE_COLUMNS = ("obj_key", "node", "object_kind", "part", "changed_type", "message", "compatible", "cause", "step")
# Order in which causes win when rows collide; every other cause comes last.
SEVERITY = ("removed", "kind", "comparable", "implements")


def message(
    obj_key: Column,
    node: Column,
    object_kind: Column,
    part: Column,
    changed_type: Column,
    text: Column,
    compatible: bool | Column,
    cause: str,
    step: int,
) -> Column:
    """One rule row as a struct."""
    side = compatible if isinstance(compatible, Column) else F.lit(compatible)
    values = (obj_key, node, object_kind, part, changed_type, text, side, F.lit(cause), F.lit(step))
    return F.struct(*[value.alias(name) for value, name in zip(values, MESSAGE_COLUMNS)])


def emit(df: DataFrame, scope: Sequence[str], rules: Sequence[Column]) -> DataFrame:
    """Evaluate several rules in one pass; a rule that does not apply is NULL.

    Rules that exclude each other belong together in one ``coalesce``, so few rows are made and dropped.
    """
    # The explode stays even for one rule: without it the optimizer copies the rule into every column.
    rows = df.select(*scope, F.explode(F.array(*rules)).alias("m"))
    return rows.filter(F.col("m").isNotNull()).select(*scope, "m.*")


def _severity(cause: Column) -> Column:
    rank = F.lit(len(SEVERITY))
    for index, name in enumerate(SEVERITY):
        rank = F.when(cause == name, index).otherwise(rank)
    return rank


def dedupe_messages(rows: DataFrame, scope: Sequence[str], compat: bool = False) -> DataFrame:
    """At most one row per object, part and side.

    By default the most severe cause wins, then the smaller text. ``compat`` lets the rule that is
    evaluated last win. Either way it is an aggregate with partial combination, not a window.
    """
    rank = -F.col("step") if compat else _severity(F.col("cause"))
    kept = [c for c in MESSAGE_COLUMNS if c not in ("obj_key", "part", "compatible")]
    winner = F.min(F.struct(rank.alias("_rank"), F.col("message").alias("_text"), *[F.col(c) for c in kept]))
    return (
        rows.groupBy(*scope, "obj_key", "part", "compatible")
        .agg(winner.alias("w"))
        .select(*scope, "obj_key", "part", "compatible", *[F.col("w")[c].alias(c) for c in kept])
    )


def as_changes(rows: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Rule rows in reported form: node and text with the part worked in."""
    return rows.select(
        *scope,
        "compatible",
        change_node(F.col("node"), F.col("part")).alias("change_node"),
        F.col("object_kind").alias("changed_object"),
        "changed_type",
        change_text(F.col("part"), F.col("message")).alias("change_message"),
    )


def all_changes(parts: Sequence[DataFrame]) -> DataFrame:
    """Bag union of rule outputs."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def order_changes(changes: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Breaking side first, then by node; text settles ties."""
    return changes.orderBy(*scope, "compatible", "change_node", "change_message")


def report_lines(changes: DataFrame, scope: Sequence[str]) -> DataFrame:
    """A text report as ordered lines: a header per non-empty side, then its messages.

    Lines stay rows with sort columns (``section``, ``line_kind``, ``node``, ``line``), so a report of any
    length can be written by range without gathering it.
    """
    section = F.col("compatible").cast("int")
    header = F.when(F.col("compatible"), "Compatible changes:").otherwise("Incompatible changes:")
    headers = changes.select(*scope, "compatible").distinct().select(
        *scope, section.alias("section"), F.lit(0).alias("line_kind"), F.lit("").alias("node"), header.alias("line")
    )
    lines = changes.select(
        *scope,
        section.alias("section"),
        F.lit(1).alias("line_kind"),
        F.col("change_node").alias("node"),
        F.concat(F.lit("- "), "change_message").alias("line"),
    )
    return headers.unionByName(lines)


def change_counts(changes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Breaking-change counts."""
    return changes.groupBy(*by).agg(F.count(F.lit(1)).alias("n_changes"))


def change_totals(changes: DataFrame, by: Sequence[str], sets: Sequence[Sequence[str]]) -> DataFrame:
    """Breaking-change counts of several groupings in one pass; a column that a row's grouping leaves out is NULL.

    ``level`` has a bit per column of ``by``, the first one highest, set where the column is left out. It tells such a
    NULL from a missing value.
    """
    grouped = changes.groupingSets([[F.col(c) for c in one] for one in sets], *[F.col(c) for c in by])
    return grouped.agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n_changes"))
