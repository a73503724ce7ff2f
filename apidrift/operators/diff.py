"""Package and object differences of release pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apidrift.functions.wording import change_message, object_kind
from apidrift.operators.messages import emit, message

SCOPE = ("pair_id", "pkg_name")


def both_sides(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two tables as one with a ``side`` column, the form in which differences are taken."""
    return old.withColumn("side", F.lit("old")).unionByName(new.withColumn("side", F.lit("new")), allowMissingColumns=True)


def dealt(df: DataFrame, by: Sequence[str], parts: int | None = None) -> DataFrame:
    """Rows of one key in one place, over ``parts`` partitions if given."""
    return df.repartition(parts, *by) if parts else df.repartition(*by)


def align(
    sided: DataFrame,
    on: Sequence[str],
    columns: Sequence[str],
    matched: bool = False,
    near: Sequence[str] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Rows of both sides next to each other: ``old_*``, ``new_*`` and the flags ``in_old``, ``in_new``.

    A row is unique per side and key, so one grouping does the work of a full outer join: the table is
    read and shuffled once, and no key can collect more than two rows. For the same reason combining before
    the shuffle has nothing to combine; shuffling first leaves one sort instead of two. ``matched`` keeps
    pairs only. ``near``, some of the keys, names what later groupings need in one place, to spare their shuffles; empty,
    it says that the rows are dealt by some of the keys already.
    ``parts`` is the number of partitions where the caller knows how many rows there are; else adaptive execution
    chooses it by compressed size.
    """
    columns = [c for c in columns if c in sided.columns]
    facts = F.struct(F.lit(True).alias("_present"), *columns)
    placed = sided if near is not None and not near else dealt(sided, near or on, parts)
    grouped = placed.groupBy(*on).agg(
        F.max(F.when(F.col("side") == "old", facts)).alias("_old"),
        F.max(F.when(F.col("side") == "new", facts)).alias("_new"),
    )
    if matched:
        grouped = grouped.filter(F.col("_old").isNotNull() & F.col("_new").isNotNull())
    return grouped.select(
        *on,
        *[F.col("_old")[c].alias("old_" + c) for c in columns],
        *[F.col("_new")[c].alias("new_" + c) for c in columns],
        F.col("_old").isNotNull().alias("in_old"),
        F.col("_new").isNotNull().alias("in_new"),
    )


# Outcome of a comparison of type trees, when the new side brings it.
COMPARISON = ("corresponds", "type_cause")


def with_comparison(
    sided: DataFrame, comparison: DataFrame, scope: Sequence[str], owner: str, part: str | None = None
) -> DataFrame:
    """Attach the outcome for (root, part); rows without a tree keep NULL."""
    outcome = comparison if part else comparison.filter("part = ''").drop("part")
    outcome = outcome.withColumnRenamed("root", owner)
    if part:
        outcome = outcome.withColumnRenamed("part", part)
    return sided.join(outcome, [*scope, owner, *([part] if part else [])], "left")


def type_differs(aligned: DataFrame, key: str = "corr_key") -> Column:
    """Inequality of the canonical keys, overruled by a comparison of the trees."""
    differs = F.col("old_" + key) != F.col("new_" + key)
    return F.coalesce(~F.col("new_corresponds"), differs) if "new_corresponds" in aligned.columns else differs


def type_cause(aligned: DataFrame, default: Column) -> Column:
    return F.coalesce(F.col("new_type_cause"), default) if "new_type_cause" in aligned.columns else default


def sides_of(pairs: DataFrame) -> DataFrame:
    """The old and the new release of every pair as two rows."""
    side = F.explode(
        F.array(
            F.struct(F.lit("old").alias("side"), F.col("old_rel").alias("rel_id")),
            F.struct(F.lit("new").alias("side"), F.col("new_rel").alias("rel_id")),
        )
    )
    return pairs.select("pair_id", side.alias("s")).select("pair_id", "s.*")


def on_both_sides(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """``table`` rows once for every pair and side their release takes part in."""
    return table.join(sides_of(pairs), "rel_id").drop("rel_id")


def packages_by_name(packages: DataFrame) -> DataFrame:
    """One package per release and clause name: the largest path stands for the last one loaded.

    ``n_errors`` is the worst of all packages of that name.
    """
    worst = [F.max("n_errors").alias("n_errors")] if "n_errors" in packages.columns else []
    return packages.groupBy("rel_id", "pkg_name").agg(F.max("pkg_path").alias("pkg_path"), *worst)


def diff_packages(pairs: DataFrame, packages: DataFrame, parts: int | None = None) -> DataFrame:
    """Packages of both sides by name: ``status`` is deleted, added or both.

    ``packages`` has one row per release and name, white-listed ones already dropped.
    """
    aligned = align(on_both_sides(pairs, packages), SCOPE, ["pkg_path"], parts=parts)
    blank = F.lit("")
    return aligned.select(
        *SCOPE,
        F.when(F.col("in_old"), F.col("pkg_name")).otherwise(blank).alias("old_pkg_name"),
        F.when(F.col("in_new"), F.col("pkg_name")).otherwise(blank).alias("new_pkg_name"),
        F.coalesce("old_pkg_path", blank).alias("old_pkg_path"),
        F.coalesce("new_pkg_path", blank).alias("new_pkg_path"),
        F.when(~F.col("in_new"), "deleted").when(~F.col("in_old"), "added").otherwise("both").alias("status"),
    )


def package_changes(package_pairs: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Rule rows for packages that exist on one side only."""
    blank = F.lit("")
    gone = message(blank, blank, blank, blank, blank, F.concat("pkg_name", F.lit(": packages deleted")), False, "removed", 0)
    come = message(blank, blank, blank, blank, blank, F.concat("pkg_name", F.lit(": packages new added")), True, "added", 0)
    status = F.col("status")
    return emit(package_pairs.filter(status != "both"), scope, [F.when(status == "deleted", gone).when(status == "added", come)])


def diff_objects(
    sided: DataFrame, scope: Sequence[str] = SCOPE, near: Sequence[str] | None = None, parts: int | None = None
) -> DataFrame:
    """Exported objects of both sides by name; ``near`` and ``parts`` as in :func:`align`."""
    columns = ["obj_kind", "type_kind", "type_str", "corr_key", "const_val", "const_known", "is_alias", *COMPARISON]
    return align(sided.filter("exported"), [*scope, "obj_name"], columns, near=near, parts=parts)


def with_mapped_types(aligned: DataFrame, type_corr: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Mark aligned objects whose old type was mapped to something else than the new type of its name."""
    other = (F.col("new_kind") != "named") | (F.col("new_name") != F.col("old_name"))
    moved = type_corr.filter(other).select(*scope, F.col("old_name").alias("obj_name"), F.lit(True).alias("mapped_elsewhere"))
    return aligned.join(moved, [*scope, "obj_name"], "left")


def check_objects(aligned: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Rule rows of objects: removed, added, kind, type and constant value.

    Types are compared by ``corr_key`` unless the rows bring the outcome of a comparison of the trees.
    Named types that exist on both sides are left to the type rules, unless the old one was met before under
    another name (``mapped_elsewhere``). A name that is an alias on either side (``is_alias``) stands for the type
    behind it, which is compared like that of a variable.
    """
    name = F.col("obj_name")
    old_kind, new_kind = F.col("old_obj_kind"), F.col("new_obj_kind")
    both = F.col("in_old") & F.col("in_new")
    same_type = ~type_differs(aligned)
    cause = type_cause(aligned, F.when(F.col("old_type_kind") == "basic", "basic").otherwise(""))
    both_const = both & (old_kind == "const") & (new_kind == "const")
    func_to_var = both & (old_kind == "func") & (new_kind == "var")
    both_typed = (both & old_kind.isin("var", "func") & (old_kind == new_kind)) | func_to_var
    both_types = both & (old_kind == "type") & (new_kind == "type")
    comparable_kinds = both_const | both_typed | both_types
    aliased = F.lit(False)
    if "old_is_alias" in aligned.columns:
        aliased = both_types & (F.coalesce("old_is_alias", F.lit(False)) | F.coalesce("new_is_alias", F.lit(False)))
    same_value = F.col("old_const_known") & F.col("new_const_known") & (F.col("old_const_val") == F.col("new_const_val"))
    part = F.lit("")

    def row(kind, changed_type, text, compatible, family):
        return message(name, name, object_kind(kind), part, changed_type, text, compatible, family, 1)

    typed = change_message(cause, F.col("old_type_str"), F.col("new_type_str"))
    untyped = change_message(F.lit(""), F.col("old_type_str"), F.col("new_type_str"))
    kinds = change_message(F.lit(""), object_kind(old_kind), object_kind(new_kind))
    values = F.concat(F.lit("value changed from "), "old_const_val", F.lit(" to "), "new_const_val")
    old_type = F.col("old_type_kind")
    exclusive = F.coalesce(
        F.when(~F.col("in_new"), row(old_kind, old_type, F.lit("removed"), False, "removed")),
        F.when(~F.col("in_old"), row(new_kind, F.col("new_type_kind"), F.lit("added"), True, "added")),
        F.when(~comparable_kinds, row(old_kind, F.lit("typeChanged"), kinds, False, "kind")),
        F.when((both_typed | aliased) & ~same_type, row(old_kind, old_type, typed, False, "kind")),
        F.when(both_const & ~same_type, row(old_kind, old_type, untyped, False, "kind")),
        F.when(both_const & same_type & ~same_value, row(old_kind, old_type, values, False, "value")),
    )
    if "mapped_elsewhere" in aligned.columns:
        clash = change_message(F.lit(""), name, name)
        exclusive = F.coalesce(exclusive, F.when(both_types & ~aliased & F.col("mapped_elsewhere"), row(old_kind, old_type, clash, False, "kind")))
    opened = row(old_kind, F.col("new_type_kind"), F.lit("changed from func to var"), True, "kind")
    return emit(aligned, scope, [exclusive, F.when(func_to_var, opened)])


def added_or_removed(aligned: DataFrame) -> DataFrame:
    """Rows that exist on one side only."""
    return aligned.filter(F.col("in_old") != F.col("in_new"))


def only_in(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``left`` without a partner."""
    return left.join(right.select(*on), list(on), "left_anti")


def also_in(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``left`` with a partner."""
    return left.join(right.select(*on), list(on), "left_semi")
