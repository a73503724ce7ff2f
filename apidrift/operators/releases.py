"""Which releases count, and which two are compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apidrift.functions.versions import is_valid_semver, version_sort_key
from apidrift.operators.diff import dealt
from apidrift.operators.ordered import running
from apidrift.session import materialize

PAIR_COLUMNS = (
    "pair_id", "module", "server_url", "old_rel", "new_rel",
    "old_tag", "old_tag_time", "new_tag", "new_tag_time",
)


def go_modules(releases: DataFrame) -> DataFrame:
    """Releases that carry a module file."""
    return releases.filter("has_go_mod")


def complete_releases(releases: DataFrame, packages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Drop every release in which some package failed to load.

    Only the failures are shuffled: they are few next to the packages.
    """
    keys = keys or ["rel_id"]
    failed = packages.filter(F.col("n_errors") > 0).select(*keys).distinct()
    return releases.join(failed, keys, "left_anti")


def valid_releases(releases: DataFrame, compat: bool = False) -> DataFrame:
    """Releases whose tag is a semantic version."""
    return releases.filter(is_valid_semver(F.col("tag"), compat))


def enough_tags(releases: DataFrame, compat: bool = False) -> DataFrame:
    """Releases of modules with at least two of them; ``compat`` asks for only one."""
    counts = releases.groupBy("module").count().filter(F.col("count") >= (1 if compat else 2))
    return releases.join(counts.select("module"), "module", "left_semi")


def with_sort_key(releases: DataFrame) -> DataFrame:
    return releases.withColumn("sort_key", version_sort_key(F.col("tag")))


def order_tags(releases: DataFrame, slices: int | None = None) -> DataFrame:
    """Position of every tag in its module's version order."""
    return running(with_sort_key(releases), ["module"], ["sort_key", "tag"], number="position", slices=slices).drop("sort_key")


def with_package_counts(
    releases: DataFrame, packages: DataFrame, kept: DataFrame | None = None, parts: int | None = None
) -> DataFrame:
    """Add ``n_packages`` and, when ``kept`` packages are given, ``n_kept``; 0 where there are none.

    ``parts`` is the number of partitions for the releases where the caller knows how many there are. Other than that of
    the packages, it lets a task that derives packages end with their counts.
    """
    counted = releases.repartition(parts, "rel_id") if parts else releases
    names = []
    for name, rows in (("n_packages", packages), ("n_kept", kept)):
        if rows is not None:
            counts = rows.groupBy("rel_id").agg(F.count(F.lit(1)).alias(name))
            counted = counted.join(counts.repartition(parts, "rel_id") if parts else counts, "rel_id", "left")
            names.append(name)
    return counted.fillna(0, names)


def adjacent_releases(releases: DataFrame, slices: int | None = None) -> DataFrame:
    """Pair every release with the one before it in version order.

    ``releases`` holds the loaded, valid releases with ``n_packages``. A release without packages is
    no old side. With ``n_kept`` (packages left by the white list) a release whose packages were all
    filtered is no old side either, provided it was itself compared before: the filter runs during a
    comparison. In a run of such releases every second comparison is therefore skipped.
    """
    # Dealing by ranges takes a sample first, which would derive the releases and their counts a second time.
    keyed = materialize(with_sort_key(releases), "releases")
    order = ["sort_key", "tag"]
    side = F.struct(
        F.col("rel_id").alias("rel"), F.col("tag").alias("tag"), F.col("tag_time").alias("time"), F.col("n_packages").alias("n")
    )
    if "n_kept" in releases.columns:
        emptied = (F.col("n_packages") > 0) & (F.col("n_kept") == 0)
        settled = {"settled": (~emptied, F.col("n_packages") > 0)}
        placed = running(
            keyed, ["module"], order, number="position", previous={"prev": side}, last_where=settled, last_number={"settled_at": "settled"}, slices=slices
        )
        # Emptied releases between the last settled one and this one; each flips the outcome.
        flips = F.col("position") - 1 - F.coalesce("settled_at", F.lit(0))
        first = F.coalesce("settled", F.lit(False))
        placed = placed.withColumn("usable", F.when(flips % 2 == 0, first).otherwise(~first))
    else:
        placed = running(keyed, ["module"], order, previous={"prev": side}, slices=slices)
        placed = placed.withColumn("usable", F.col("prev")["n"] > 0)
    return placed.filter(F.col("prev").isNotNull() & F.col("usable")).select(
        F.col("rel_id").alias("pair_id"),
        "module",
        "server_url",
        F.col("prev")["rel"].alias("old_rel"),
        F.col("rel_id").alias("new_rel"),
        F.col("prev")["tag"].alias("old_tag"),
        F.col("prev")["time"].alias("old_tag_time"),
        F.col("tag").alias("new_tag"),
        F.col("tag_time").alias("new_tag_time"),
    )


def previous_tag_label(releases: DataFrame, slices: int | None = None) -> DataFrame:
    """The raw tag before each tag, skipped or not."""
    return running(with_sort_key(releases), ["module"], ["sort_key", "tag"], previous={"previous_tag": F.col("tag")}, slices=slices).drop("sort_key")


def with_raw_old_label(pairs: DataFrame, all_releases: DataFrame, parts: int | None = None) -> DataFrame:
    """Replace the old tag by the raw preceding tag, keeping the compared packages and time.

    ``parts`` is the number of partitions where the caller knows how many rows there are.
    """
    labels = previous_tag_label(all_releases).select(F.col("rel_id").alias("pair_id"), "previous_tag")
    if parts:
        pairs, labels = dealt(pairs, ["pair_id"], parts), dealt(labels, ["pair_id"], parts)
    return pairs.join(labels, "pair_id").withColumn("old_tag", F.col("previous_tag")).drop("previous_tag")
