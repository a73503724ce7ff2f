"""Types that stop implementing an interface of their package.

Implementing is a containment of method sets. Comparing every type with every interface would be
quadratic per package, so the work is cut twice: only pairs in which the interface gained a method or
the type lost one can break, and of the interface's methods the one with the fewest owners leads the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apidrift.operators.diff import SCOPE
from apidrift.operators.messages import emit, message
from apidrift.session import materialize


def no_longer_implements(types: DataFrame, methods: DataFrame, scope: Sequence[str] = SCOPE, smallest_void: bool = False) -> DataFrame:
    """(type ``owner``, interface ``face``) where the old type implements the old interface, the new not the new.

    ``types`` holds corresponding types with the kinds of both sides; ``methods`` are rows of both sides
    under the old owner names. Value method sets count, an interface's being all of it. An interface
    without methods is implemented by every type; when it gains some, all types but the few that have them break.
    ``smallest_void`` keeps only the first such interface by name per type, which is all a report shows of them, and
    spares the pairs.
    """
    scope = list(scope)
    sig = ["method_name", "corr_key"]
    old_kind, new_kind = F.col("old_underlying_kind"), F.col("new_underlying_kind")
    facts = types.select(
        *scope, "owner", ((old_kind == "interface") & (new_kind == "interface")).alias("is_face"), new_kind.alias("kind"),
        *([F.coalesce("new_is_basic", F.lit(False)).alias("is_basic")] if "new_is_basic" in types.columns else []),
    )
    printed = [c for c in ("kind", "is_basic") if c in facts.columns]
    held = (
        methods.join(facts, [*scope, "owner"])
        .filter(F.col("in_value_set") | F.col("is_face"))
        .groupBy(*scope, "owner", "is_face", "kind", *sig)
        .agg(F.max(F.col("side") == "old").alias("in_old"), F.max(F.col("side") == "new").alias("in_new"))
    )
    held = materialize(held, "methods")
    holders = held.select(*scope, "owner", *sig, "in_old", "in_new")
    demands = held.filter("is_face").select(
        *scope, F.col("owner").alias("face"), *sig, F.col("in_old").alias("was_asked"), F.col("in_new").alias("is_asked")
    )
    faces = demands.groupBy(*scope, "face").agg(
        F.max("was_asked").alias("had_methods"), F.max(~F.col("was_asked") & F.col("is_asked")).alias("gained")
    )
    grown = faces.filter("gained").select(*scope, "face", "had_methods")
    pair = [*scope, "owner", "face"]

    # Interfaces that gained a method: whoever holds the old method with the fewest holders may break.
    asked = demands.filter("was_asked").join(grown, [*scope, "face"], "left_semi").select(*scope, "face", *sig)
    n_holders = holders.filter("in_old").groupBy(*scope, *sig).agg(F.count(F.lit(1)).alias("n_holders"))
    lead = asked.join(n_holders, [*scope, *sig]).groupBy(*scope, "face").agg(F.min(F.struct("n_holders", *sig)).alias("lead"))
    lead = lead.select(*scope, "face", *[F.col("lead")[c].alias(c) for c in sig])
    by_face = lead.join(holders.filter("in_old"), [*scope, *sig]).select(*pair)
    # Grown interfaces that had no methods: every other type may break.
    by_void = grown.filter("not had_methods").select(*scope, "face").join(facts.select(*scope, "owner"), scope).select(*pair)
    # Any interface: a type that lost one of its methods breaks.
    lost = holders.filter("in_old and not in_new").select(*scope, "owner", *sig)
    by_type = lost.join(demands.filter("was_asked"), [*scope, *sig]).select(*pair)
    candidates = (by_face if smallest_void else by_face.unionByName(by_void)).unionByName(by_type).filter(F.col("owner") != F.col("face")).distinct()

    met_old, met_new = F.coalesce("in_old", F.lit(False)), F.coalesce("in_new", F.lit(False))
    verdict = (
        candidates.join(demands, [*scope, "face"])
        .join(holders, [*scope, "owner", *sig], "left")
        .groupBy(*pair)
        .agg(F.bool_and(~F.col("was_asked") | met_old).alias("did"), F.bool_and(~F.col("is_asked") | met_new).alias("does"))
    )
    broken = verdict.filter("did and not does").select(*pair)
    if smallest_void:
        void = grown.filter("not had_methods").select(*scope, "face")
        broken = broken.unionByName(_first_missing(void, facts.select(*scope, "owner"), demands, holders, scope)).distinct()
    return broken.join(facts.select(*scope, "owner", *printed), [*scope, "owner"])


def _first_missing(void: DataFrame, owners: DataFrame, demands: DataFrame, holders: DataFrame, scope: list[str]) -> DataFrame:
    """(owner, face): of the interfaces that had no methods, the first by name that the new type does not implement.

    The interfaces of a package are numbered; the numbers of those that a type implements (or is) are few, and the
    first number missing among them is the answer.
    """
    sig = ["method_name", "corr_key"]
    numbered = void.withColumn("number", F.row_number().over(Window.partitionBy(*scope).orderBy("face")))
    asked = demands.filter("is_asked").join(void, [*scope, "face"], "left_semi").select(*scope, "face", *sig)
    held = holders.filter("in_new").select(*scope, "owner", *sig)
    n_holders = held.groupBy(*scope, *sig).agg(F.count(F.lit(1)).alias("n_holders"))
    lead = asked.join(n_holders, [*scope, *sig], "left").groupBy(*scope, "face").agg(
        F.min(F.struct(F.coalesce("n_holders", F.lit(0)).alias("n"), *sig)).alias("lead")
    )
    lead = lead.select(*scope, "face", *[F.col("lead")[c].alias(c) for c in sig])
    led = lead.join(held, [*scope, *sig]).select(*scope, "owner", "face")
    have = held.withColumn("has", F.lit(True))
    does = (
        led.join(asked, [*scope, "face"])
        .join(have, [*scope, "owner", *sig], "left")
        .groupBy(*scope, "owner", "face")
        .agg(F.bool_and(F.coalesce("has", F.lit(False))).alias("does"))
        .filter("does")
        .select(*scope, "owner", "face")
    )
    spared = does.unionByName(void.select(*scope, F.col("face").alias("owner"), "face")).distinct().join(numbered, [*scope, "face"])
    placed = spared.withColumn("i", F.row_number().over(Window.partitionBy(*scope, "owner").orderBy("number")))
    gap = placed.groupBy(*scope, "owner").agg(
        F.coalesce(F.min(F.when(F.col("number") != F.col("i"), F.col("i"))), F.max("i") + 1).alias("gap")
    )
    wanted = owners.join(void.select(*scope).distinct(), scope, "left_semi").join(gap, [*scope, "owner"], "left")
    wanted = wanted.select(*scope, "owner", F.coalesce("gap", F.lit(1)).alias("number"))
    return wanted.join(numbered, [*scope, "number"]).select(*scope, "owner", "face")


def satisfaction_changes(broken: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Rule rows of lost implementations."""
    owner = F.col("owner")
    text = F.concat(F.lit("no longer implements "), "face")
    kind = F.concat(F.lit("named|"), "kind")
    if "is_basic" in broken.columns:
        # The new type is a basic one itself, not a named one.
        kind = F.when(F.col("is_basic"), "basic").otherwise(kind)
    return emit(broken, scope, [message(owner, owner, F.lit("type"), F.lit(""), kind, text, False, "implements", 8)])
