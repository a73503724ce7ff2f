"""Readers of task lists, white lists, reports, dependencies and API snapshots."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apidrift.functions.text import repo_url
from apidrift.sources.batches import BatchStore

# Field names and headings by which files are interchanged.
REPO_TASKS = T.StructType().add("total_count", "long").add(
    "items",
    T.ArrayType(T.StructType().add("index", "long").add("full_name", "string").add("url", "string").add("star", "long")),
)
CLIENT_TASKS = T.StructType().add("total_count", "long").add(
    "items",
    T.ArrayType(
        T.StructType()
        .add("Url", "string")
        .add(
            "Detail",
            T.ArrayType(
                T.StructType().add("Version", "string").add("Path", "string").add("PkgInfo", T.ArrayType(T.StringType()))
            ),
        )
    ),
)
DEPENDENCY_COLUMNS = (
    "module_name", "go_version", "tag", "tag_time",
    "require_module_name", "require_module_version", "require_module_indirect",
)
CHANGE_REPORT_COLUMNS = (
    "server_name", "server_url", "old_tag", "olg_tag_time", "new_tag", "new_tag_time", "old_pkg_name",
    "new_pkg_name", "old_pkg_path", "new_pkg_path", "change_node", "changedObject", "changedType", "changeMessage",
)
IDENTIFIER_COLUMNS = (
    "server_url", "var_type", "id_name", "id_pos", "obj_name", "obj_pos",
    "obj_pkg", "obj_type", "obj_exported", "obj_id", "obj_string",
)
READ_BACK_COLUMNS = (
    "server_url", "old_tag", "olg_tag_time", "new_tag", "old_pkg_path", "old_pkg_name",
    "change_node", "changedObject", "changedType", "changeMessage",
)
SNAPSHOT_TABLES = ("release", "package", "api_object", "api_type", "api_field", "api_method", "api_type_node")


#: Number of folders that a partitioned snapshot deals its releases into.
REL_PARTS = 32


def rel_part(rel_id: Column) -> Column:
    """The folder of a release in a partitioned snapshot."""
    return F.pmod(F.xxhash64(rel_id), F.lit(REL_PARTS)).cast("int")


def read_repo_tasks(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per repository of a JSON task list; the clone url comes from the full name.

    ``lines`` reads files with one list per line, which large task sets need to be split. ``count_matches`` tells whether the stated total fits the list; the total itself is not used.
    """
    lists = spark.read.schema(REPO_TASKS).option("multiLine", not lines).json(path)
    matches = F.col("total_count") == F.size("items")
    return lists.select(matches.alias("count_matches"), F.explode("items").alias("i")).select(
        F.col("i.index").alias("index"),
        F.col("i.full_name").alias("full_name"),
        repo_url(F.col("i.full_name")).alias("url"),
        F.col("i.star").alias("star"),
        F.coalesce("count_matches", F.lit(False)).alias("count_matches"),
    )


def read_client_tasks(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per client version with its third-party packages."""
    lists = spark.read.schema(CLIENT_TASKS).option("multiLine", not lines).json(path)
    versions = lists.select(F.explode("items").alias("i")).select("i.Url", F.explode("i.Detail").alias("d"))
    return versions.select(
        F.col("Url").alias("url"),
        F.col("d.Version").alias("version"),
        F.col("d.Path").alias("path"),
        F.coalesce("d.PkgInfo", F.array().cast("array<string>")).alias("pkg_info"),
    )


def read_white_list(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    """White-list entries, one per line, empty lines dropped.

    ``compat`` splits on CR LF only: a file with plain line feeds is one entry that matches nothing.
    """
    if compat:
        lines = spark.read.text(path, lineSep="\r\n")
    else:
        lines = spark.read.text(path, lineSep="\n").select(F.regexp_replace("value", "\r$", "").alias("value"))
    return lines.filter("value != ''").select(F.col("value").alias("entry"))


def _read_csv(spark: SparkSession, path: str | list[str], columns: tuple[str, ...], multi_line: bool) -> DataFrame:
    """Columns by header name, all as text; a missing value is the empty string.

    Quotes are doubled inside quoted values, as common CSV writers do it. A row is one line, as our own writers see
    to, so files are split. ``multi_line`` is for files of other writers whose values span lines; such a file is read
    by one task.
    """
    reader = spark.read.options(header=True, quote='"', escape='"', multiLine=multi_line)
    if isinstance(path, str) and (store := BatchStore(spark, path)).exists():
        paths = store.paths()
        if not paths:
            nothing = T.StructType([T.StructField(c, T.StringType()) for c in (*columns, "file_path")])
            return spark.createDataFrame([], nothing)
        rows = reader.option("basePath", f"{store.path}/rows").csv(paths)
    else:
        rows = reader.csv(path)
    names = [*columns, *(["version"] if "version" in rows.columns and "version" not in columns else [])]
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names], "_metadata.file_path")


def read_dependencies(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """Dependency rows of any number of CSV files."""
    rows = _read_csv(spark, path, DEPENDENCY_COLUMNS, multi_line).drop("file_path")
    return rows.withColumn(
        "require_module_indirect", F.coalesce(F.col("require_module_indirect").try_cast("boolean"), F.lit(False))
    )


def read_change_report(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """The columns of a change report that are read back; ``multi_line`` for reports of other writers."""
    return _read_csv(spark, path, READ_BACK_COLUMNS, multi_line).drop("file_path")


EMPTY_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def _with_version(rows: DataFrame) -> DataFrame:
    """Version from its own column, the folder our writer makes, or else the file name."""
    path = F.url_decode(F.regexp_replace("file_path", r"\+", "%2B"))
    # Folder names are escaped once by the writer and once more as part of a url.
    folder = F.url_decode(F.regexp_replace(F.regexp_extract(path, "/version_safe=([^/]*)/", 1), r"\+", "%2B"))
    name = F.regexp_extract(path, r"_@@@(.+)\.csv$", 1)
    version = F.when(folder == EMPTY_FOLDER, "").when(folder != "", folder).otherwise(name)
    if "version" in rows.columns:
        version = F.coalesce("version", version)
    return rows.withColumn("version", version).drop("file_path")


def read_identifier_usage(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """Usage rows of any number of files, with their client version; ``multi_line`` for files of other writers."""
    return _with_version(_read_csv(spark, path, IDENTIFIER_COLUMNS, multi_line))


def read_imports(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """Import rows of any number of files, with their client version; ``multi_line`` for files of other writers."""
    return _with_version(_read_csv(spark, path, ("server_url", "pkg_path", "pkg_name"), multi_line))


@dataclass
class Snapshot:
    """Releases and their exported API; every table is keyed by ``rel_id`` and all but releases by ``pkg_path``."""

    release: DataFrame
    package: DataFrame
    api_object: DataFrame
    api_type: DataFrame
    api_field: DataFrame
    api_method: DataFrame
    api_type_node: DataFrame | None = None
    #: Number of partitions that all API tables are dealt over by release, where they are.
    parts: int | None = None


def read_api_snapshot(spark: SparkSession, path: str, with_trees: bool = True) -> Snapshot:
    """Parquet tables of one snapshot folder. A snapshot without type trees is read only when it is asked for."""
    names = [name for name in SNAPSHOT_TABLES if with_trees or name != "api_type_node"]
    return Snapshot(**{name: spark.read.parquet(f"{path}/{name}") for name in names})


def cut_to_releases(snapshot: Snapshot, wanted: DataFrame) -> Snapshot:
    """The API tables of a partitioned snapshot, cut to the folders of ``wanted`` releases; others stay whole.

    At most ``REL_PARTS`` numbers are collected. As literals they prune folders before anything is read.
    """
    if "rel_part" not in snapshot.api_object.columns:
        return snapshot
    parts = [r[0] for r in wanted.select(rel_part(F.col("rel_id"))).distinct().collect()]
    tables = {name: getattr(snapshot, name) for name in SNAPSHOT_TABLES if name != "release"}
    return replace(snapshot, **{name: t.filter(F.col("rel_part").isin(parts)) for name, t in tables.items() if t is not None})


def read_module_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all batches of a module graph."""
    nodes = "name string, version string"
    edges = "from_name string, from_version string, to_name string, to_version string, indirect boolean"
    return BatchStore(spark, f"{path}/nodes").read(nodes), BatchStore(spark, f"{path}/edges").read(edges)


def key_by_release(table: DataFrame, releases: DataFrame) -> DataFrame:
    """Give a feed keyed by (module, tag) the release number the snapshot uses."""
    return table.join(releases.select("rel_id", "module", "tag"), ["module", "tag"]).drop("tag")
