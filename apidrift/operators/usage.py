"""What clients use of third-party packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apidrift.functions.text import bool_text, pkg_path, strip_position
from apidrift.sources.readers import IDENTIFIER_COLUMNS

def touches_third_party(obj_string: Column, paths: Column) -> Column:
    """Whether some path occurs in the printed object."""
    return F.exists(paths, lambda path: F.contains(obj_string, path))


def segment_match(obj_string: Column, paths: Column) -> Column:
    """Stricter form: the path must stand between boundaries of path pieces.

    Occurrences are marked as plain text first, so one fixed pattern serves every path.
    """
    between = F.lit("(^|[^0-9A-Za-z_./-])\u0001($|[^0-9A-Za-z_-])")
    return F.exists(paths, lambda path: F.regexp_like(F.replace(obj_string, path, F.lit("\u0001")), between))


def all_identifiers(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """Bag union of definitions and uses."""
    return defs.withColumn("var_type", F.lit("defs")).unionByName(uses.withColumn("var_type", F.lit("uses")))


def third_party_usage(identifiers: DataFrame, client_versions: DataFrame, strict: bool = False) -> DataFrame:
    """Identifiers of a client version that touch one of its own third-party packages.

    The equi-join on (url, version) comes first; paths are tested inside the joined row, so there is
    never a pair of an identifier with a foreign client's path. A client version may list several folders
    (``path``), each with its own packages: identifiers that tell their folder meet its list alone, others the
    lists of all folders together, so that no identifier is reported twice.
    """
    key = ["server_url", "version", *(["path"] if "path" in identifiers.columns else [])]
    lists = client_versions.withColumnRenamed("url", "server_url").groupBy(*key).agg(F.collect_set("pkg_info").alias("lists"))
    paths = lists.select(*key, pkg_path(F.array_distinct(F.flatten("lists"))).alias("pkg_paths"))
    match = segment_match if strict else touches_third_party
    joined = identifiers.join(paths, key)
    return joined.filter(match(F.col("obj_string"), F.col("pkg_paths"))).drop("pkg_paths")


def to_identifier_report(usage: DataFrame) -> DataFrame:
    """Report columns, with the position cut to its repository part and missing values as empty text."""
    known = usage.withColumn("id_pos", strip_position(F.col("id_pos")))
    if "obj_exported" in usage.columns:
        known = known.withColumn("obj_exported", bool_text(F.col("obj_exported")))
    columns = [
        F.coalesce(F.col(c), F.lit("")).alias(c) if c in usage.columns else F.lit("").alias(c) for c in IDENTIFIER_COLUMNS
    ]
    return known.select(*columns, "version")


def distinct_imports(imports: DataFrame) -> DataFrame:
    """One row per package path of a client version."""
    return imports.groupBy("server_url", "version", "pkg_path").agg(F.min("pkg_name").alias("pkg_name"))
