"""Module dependency graph as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apidrift.operators.filters import drop_unversioned

NODE_KEY = ("name", "version")
EDGE_KEY = ("from_name", "from_version", "to_name", "to_version", "indirect")


def module_nodes(dependencies: DataFrame) -> DataFrame:
    """Both endpoints of every versioned dependency, once each."""
    rows = drop_unversioned(dependencies)
    left = rows.select(F.col("module_name").alias("name"), F.col("tag").alias("version"))
    right = rows.select(F.col("require_module_name").alias("name"), F.col("require_module_version").alias("version"))
    return left.unionByName(right).distinct()


def module_edges(dependencies: DataFrame) -> DataFrame:
    """Distinct (from, to, indirect) edges of versioned dependencies."""
    return (
        drop_unversioned(dependencies)
        .select(
            F.col("module_name").alias("from_name"),
            F.col("tag").alias("from_version"),
            F.col("require_module_name").alias("to_name"),
            F.col("require_module_version").alias("to_version"),
            F.col("require_module_indirect").alias("indirect"),
        )
        .distinct()
    )


def upsert_module_graph(
    dependencies: DataFrame, existing_nodes: DataFrame | None = None, existing_edges: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Merge dependencies into a graph. Doing it twice changes nothing.

    New rows that the graph already has are dropped by key, so existing rows keep their other columns.
    """
    nodes, edges = module_nodes(dependencies), module_edges(dependencies)
    if existing_nodes is not None:
        fresh = nodes.join(existing_nodes.select(*NODE_KEY), list(NODE_KEY), "left_anti")
        nodes = existing_nodes.unionByName(fresh, allowMissingColumns=True)
    if existing_edges is not None:
        fresh = edges.join(existing_edges.select(*EDGE_KEY), list(EDGE_KEY), "left_anti")
        edges = existing_edges.unionByName(fresh, allowMissingColumns=True)
    return nodes, edges


def with_urls(nodes: DataFrame, releases: DataFrame) -> DataFrame:
    """Give nodes the url of their module; modules without a release keep the empty text."""
    urls = releases.groupBy(F.col("module").alias("name")).agg(F.min("server_url").alias("url"))
    return nodes.join(urls, "name", "left").fillna("", ["url"])


def downstream_clients(nodes: DataFrame, edges: DataFrame, targets: DataFrame, compat: bool = False) -> DataFrame:
    """Clients with a url and a direct edge to a target, one row per edge.

    ``targets`` is a table (``name``, ``version``), so one job answers every lookup. ``compat`` gives the
    empty result of a lookup by a property that no edge has.
    """
    wanted = targets.select(F.col("name").alias("to_name"), F.col("version").alias("to_version")).distinct()
    clients = nodes.filter(F.coalesce(F.col("url"), F.lit("")) != "").select(
        F.col("name").alias("from_name"), F.col("version").alias("from_version"), F.col("url").alias("client_url")
    )
    direct = edges.filter(~F.col("indirect") & F.lit(not compat))
    return (
        direct.join(wanted, ["to_name", "to_version"])
        .join(clients, ["from_name", "from_version"])
        .select(
            F.col("to_name").alias("name"),
            F.col("to_version").alias("version"),
            F.col("from_name").alias("client_name"),
            F.col("from_version").alias("client_version"),
            "client_url",
        )
    )
