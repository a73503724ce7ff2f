"""Writers of change reports, usage reports and the module graph."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apidrift.functions.text import server_name
from apidrift.operators import graph
from apidrift.sources.batches import BatchStore
from apidrift.sources.readers import CHANGE_REPORT_COLUMNS, SNAPSHOT_TABLES, Snapshot, rel_part

CSV_OPTIONS = {"header": True, "escape": '"', "emptyValue": ""}
#: Rows of stores are packed. Such a file is read by one task, so its rows are bounded.
STORE_OPTIONS = {**CSV_OPTIONS, "compression": "gzip", "maxRecordsPerFile": 1_000_000}


def to_change_report(changes: DataFrame) -> DataFrame:
    """The report's fourteen columns, misspelt heading included so that files interchange."""
    renamed = {
        "olg_tag_time": "old_tag_time",
        "changedObject": "changed_object",
        "changedType": "changed_type",
        "changeMessage": "change_message",
    }
    named = changes.withColumn("server_name", server_name(F.col("server_url")))
    return named.select(*[F.col(renamed.get(c, c)).alias(c) for c in CHANGE_REPORT_COLUMNS])


def _on_one_line(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def _plain(df: DataFrame) -> DataFrame:
    """Line breaks inside values as in printed constants, \\n and \\r, so that every row is one line and files can be split."""
    return df.withColumns({c: _on_one_line(F.col(c)) for c, kind in df.dtypes if kind == "string"})


def _store(df: DataFrame, path: str, batch: object | None, key: str) -> None:
    store = BatchStore(df.sparkSession, path, "csv", **STORE_OPTIONS)
    store.write(_plain(df), uuid.uuid4().hex if batch is None else batch, key)


def write_change_report(changes: DataFrame, path: str, batch: object | None = None) -> None:
    """Add reportable changes to a report store as ``batch``; the same batch again takes the place of the first.

    Without ``batch`` rows are appended. However many repositories there are, a batch has at most ``BUCKETS`` folders.
    """
    _store(to_change_report(changes), path, batch, "server_name")


def write_identifier_usage(usage: DataFrame, path: str, batch: object | None = None) -> None:
    """Add usage rows to the store ``pkgInfo``, as :func:`write_change_report` does; the version is a column."""
    rows = usage.withColumn("server", server_name(F.col("server_url")))
    _store(rows, f"{path}/pkgInfo", batch, "server")


def write_imports(imports: DataFrame, path: str, batch: object | None = None) -> None:
    """Add import rows to the store ``importPkg``, laid out like usage rows."""
    rows = imports.select("server_url", "pkg_path", "pkg_name", "version")
    _store(rows.withColumn("server", server_name(F.col("server_url"))), f"{path}/importPkg", batch, "server")


def _export_csv(df: DataFrame, path: str, partitions: list[str]) -> None:
    """One folder per repository (and version), for tools that look for files by name. Adaptive execution splits a hot
    folder over tasks, and nothing is written for no rows. Exporting twice doubles the rows."""
    _plain(df).hint("rebalance", *partitions).write.mode("append").partitionBy(*partitions).options(**CSV_OPTIONS).csv(path)


def export_change_report(changes: DataFrame, path: str) -> None:
    """Append reportable changes, one folder per repository."""
    report = to_change_report(changes)
    _export_csv(report.withColumn("server", F.col("server_name")), path, ["server"])


def export_identifier_usage(usage: DataFrame, path: str) -> None:
    """Append usage rows under ``pkgInfo``, one folder per repository and version."""
    _export_usage(usage, f"{path}/pkgInfo")


def export_imports(imports: DataFrame, path: str) -> None:
    """Append import rows under ``importPkg``, laid out like usage rows."""
    _export_usage(imports.select("server_url", "pkg_path", "pkg_name", "version"), f"{path}/importPkg")


def _export_usage(rows: DataFrame, path: str) -> None:
    rows = rows.withColumn("server", server_name(F.col("server_url")))
    _export_csv(rows.withColumn("version_safe", F.translate("version", "/", "_")), path, ["server", "version_safe"])


def append_module_graph(dependencies: DataFrame, path: str, batch: object) -> None:
    """Add the nodes and edges that the graph below ``path`` lacks, as one batch of each; what is there is not rewritten.

    The same batch again is compared with the others alone, so it takes the place of the first.
    """
    spark = dependencies.sparkSession
    nodes, edges = graph.module_nodes(dependencies), graph.module_edges(dependencies)
    for name, rows, key in (("nodes", nodes, graph.NODE_KEY), ("edges", edges, graph.EDGE_KEY)):
        store = BatchStore(spark, f"{path}/{name}")
        known = store.read(rows.schema, [b for b in store.batches() if b != str(batch)])
        store.write(rows.join(known, list(key), "left_anti"), batch)


def write_api_snapshot(snapshot: Snapshot, path: str, partitioned: bool = False) -> None:
    """Write the tables of a snapshot, for ``read_api_snapshot``.

    ``partitioned`` deals all but the releases into folders by release, so that a stream reads only those it needs.
    """
    for name in SNAPSHOT_TABLES:
        table = getattr(snapshot, name)
        if table is None:
            continue
        if partitioned and name != "release":
            dealt = table.withColumn("rel_part", rel_part(F.col("rel_id"))).hint("rebalance", "rel_part")
            dealt.write.partitionBy("rel_part").parquet(f"{path}/{name}")
        else:
            table.write.parquet(f"{path}/{name}")
