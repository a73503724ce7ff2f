"""White lists, blanks and reportable changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Path pieces that mark a package as not part of the public API.
WHITE_LIST = ("cmd", "build", "deployment", "script", "test", "init", "configs", "mock", "internal")
UNKNOWN_TO_UNKNOWN = "from unknown to unknown"


def is_white_listed(path: Column, entries: list[str]) -> Column:
    """Whether ``/entry`` occurs in the path or the path starts with ``entry/``."""
    hit = F.lit(False)
    for entry in entries:
        hit = hit | F.contains(path, F.lit("/" + entry)) | F.startswith(path, F.lit(entry + "/"))
    return hit


def drop_white_listed(packages: DataFrame, entries: list[str] | DataFrame, path: str = "pkg_path") -> DataFrame:
    """Packages that no white-list entry matches.

    A list becomes plain string predicates. A table of entries of any size becomes an equi-join: a match
    begins where a path piece begins, so the pieces' prefixes are joined with the entries. Only lengths that some
    entry has are tried; these few numbers are all that reaches the driver.
    """
    if not isinstance(entries, DataFrame):
        return packages.filter(~is_white_listed(F.col(path), list(entries)))
    entry = drop_blank(entries.select(F.col(entries.columns[0]).alias("entry")), "entry").distinct()
    lengths = sorted(r[0] for r in entry.select(F.length("entry")).distinct().collect())
    if not lengths:
        return packages
    paths = packages.select(F.col(path).alias("path")).distinct()
    starts = paths.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("path"))))
    starts = starts.filter((F.col("at") == 1) | (F.substr("path", F.col("at") - 1, F.lit(1)) == "/"))
    room = F.length("path") - F.col("at") + 1
    prefixes = starts.withColumn("n", F.explode(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= room)))
    # At the very start of a path the entry must be a whole piece.
    whole = F.substr("path", F.col("at") + F.col("n"), F.lit(1)) == "/"
    prefixes = prefixes.filter((F.col("at") > 1) | whole)
    prefixes = prefixes.select("path", F.substr("path", F.col("at"), F.col("n")).alias("entry"))
    hits = prefixes.join(entry, "entry").select(F.col("path").alias(path)).distinct()
    return packages.join(hits, path, "left_anti")


def drop_blank(df: DataFrame, column: str) -> DataFrame:
    """Drop empty strings; blanks inside a value stay."""
    return df.filter(F.col(column) != "")


def drop_null_objects(identifiers: DataFrame) -> DataFrame:
    return identifiers.filter(F.col("obj_string").isNotNull())


def drop_unversioned(dependencies: DataFrame) -> DataFrame:
    return dependencies.filter(F.col("tag") != "")


def has_packages(client_versions: DataFrame) -> DataFrame:
    return client_versions.filter(F.size("pkg_info") > 0)


def reportable(changes: DataFrame) -> DataFrame:
    """Breaking changes whose text does not compare two unknown constants."""
    return changes.filter(~F.col("compatible") & ~F.contains(F.col("change_message"), F.lit(UNKNOWN_TO_UNKNOWN)))


def messages(changes: DataFrame, compatible: bool) -> DataFrame:
    """One side of a report."""
    return changes.filter(F.col("compatible") == F.lit(compatible))
