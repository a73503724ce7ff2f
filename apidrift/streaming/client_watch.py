"""Dependencies as they arrive, checked against known breaking changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from apidrift.functions.versions import is_minor_or_patch
from apidrift.operators.filters import drop_unversioned


def affected_dependencies(dependencies: DataFrame, changes: DataFrame) -> DataFrame:
    """Direct requirements of a version that the next minor or patch update breaks, with the number of changes.

    One row per requirement and update, so a popular library does not multiply its clients by its changes; which
    of them a client meets is for the join with used identifiers. Works on a stream of dependencies as well as on
    a table; ``changes`` is a table.
    """
    updates = (
        changes.filter(is_minor_or_patch(F.col("old_tag"), F.col("new_tag")))
        .groupBy(F.col("module").alias("require_module_name"), F.col("old_tag").alias("require_module_version"), "new_tag")
        .agg(F.count(F.lit(1)).alias("n_changes"))
    )
    direct = drop_unversioned(dependencies).filter(~F.col("require_module_indirect"))
    return direct.join(updates, ["require_module_name", "require_module_version"]).select(
        F.col("module_name").alias("client"),
        F.col("tag").alias("client_version"),
        F.col("require_module_name").alias("library"),
        F.col("require_module_version").alias("old_tag"),
        "new_tag",
        "n_changes",
    )


def watch_clients(arriving: DataFrame, changes: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """Append the affected rows of a dependency stream as parquet; the caller picks the trigger and starts it."""
    return (
        affected_dependencies(arriving, changes)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
    )
