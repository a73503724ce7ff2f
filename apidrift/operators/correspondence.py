"""Type trees side by side: do two types correspond, what differs, and which named types map to which.

A tree is a set of rows (``root``, ``part``, ``path``): ``root`` is an object or named type, ``part`` is empty
for its own type and else the name of a field or method, ``path`` holds child positions. Signatures have
their parameters at 0 and results at 1, maps key and element, arrays, slices, channels and pointers their
one child at 0; struct fields and tuple members are counted in order, interface methods by method id.
``named_pkg`` is empty for types of the package itself. Children carry the facts of their field or method.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apidrift.functions.wording import is_exported, what_changed
from apidrift.operators.diff import SCOPE, align
from apidrift.session import materialize

NODE_COLUMNS = (
    "node_kind", "label", "named_pkg", "array_len", "variadic", "field_name", "embedded", "struct_tag",
)
COUNTED_KINDS = ("tuple", "struct", "interface")
KNOWN_KINDS = (
    "basic", "array", "slice", "map", "chan", "pointer", "signature", "tuple", "struct", "interface", "named",
)
# How a struct comparison names the first failed check of a field.
FIELD_CHECKS = ("fieldAnonymous", "fieldTag", "fieldType", "fieldNames")


def named_id(label: Column, package: Column) -> Column:
    """Name by which a named type corresponds: bare unless it is foreign and unexported."""
    foreign = (F.coalesce(package, F.lit("")) != "") & ~is_exported(label)
    return F.when(foreign, F.concat(package, F.lit("."), label)).otherwise(label)


def method_id(name: Column, package: Column) -> Column:
    """Name by which an interface method is sorted and matched."""
    return named_id(name, package)


def align_trees(sided: DataFrame, scope: Sequence[str] = SCOPE, parts: int | None = None) -> DataFrame:
    """Nodes of both sides by position, all trees of a pair (first of ``scope``) in one place.

    Rows of a release come one after the other, so those of one pair pack far better than those of one tree; they are sorted
    and spilled, not held. ``parts`` as in :func:`align`.
    """
    return align(sided, [*scope, "root", "part", "path"], NODE_COLUMNS, near=scope[:1], parts=parts)


def sided_trees(aligned: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Nodes of each side out of aligned ones."""
    columns = [c for c in NODE_COLUMNS if "old_" + c in aligned.columns]
    sides = [
        F.when(F.col("in_" + side), F.struct(F.lit(side).alias("side"), *[F.col(f"{side}_{c}").alias(c) for c in columns]))
        for side in ("old", "new")
    ]
    nodes = aligned.select(*scope, "root", "part", "path", F.explode(F.array(*sides)).alias("n"))
    return nodes.filter(F.col("n").isNotNull()).select(*scope, "root", "part", "path", "n.*")


def with_differences(aligned: DataFrame, scope: Sequence[str] = SCOPE, type_corr: DataFrame | None = None) -> DataFrame:
    """Aligned nodes with ``type_differs`` and the field facts that differ.

    Only own named types of the old side can be mapped, so only they are joined with the mapping.
    """
    nodes = aligned.withColumns(
        {f"{side}_corr_id": named_id(F.col(f"{side}_label"), F.col(f"{side}_named_pkg")) for side in ("old", "new")}
    )
    if type_corr is None:
        return nodes.withColumns(_differences(False))
    own = F.coalesce((F.col("old_node_kind") == "named") & (F.coalesce("old_named_pkg", F.lit("")) == ""), F.lit(False))
    mapped = type_corr.select(*scope, F.col("old_name").alias("old_label"), F.struct("new_kind", "new_name").alias("old_maps_to"))
    met = nodes.filter(own).join(mapped, [*scope, "old_label"], "left")
    rest = nodes.filter(~own).withColumn("old_maps_to", F.lit(None).cast(mapped.schema["old_maps_to"].dataType))
    return met.unionByName(rest).withColumns(_differences(True))


def align_positions(
    sided: DataFrame, scope: Sequence[str] = SCOPE, type_corr: DataFrame | None = None, parts: int | None = None
) -> DataFrame:
    """Nodes of both sides by position, with ``type_differs`` and the field facts that differ.

    Channel directions below the top never differ; see the type rules for the top. ``type_corr`` maps own
    named types of the old side; without it they correspond by name.
    """
    return with_differences(align_trees(sided, scope, parts), scope, type_corr)


def _differences(mapped: bool) -> dict[str, Column]:
    def old(column):
        return F.col("old_" + column)

    def new(column):
        return F.col("new_" + column)

    same_kind = old("node_kind") == new("node_kind")
    by_kind = same_kind & (
        F.when(old("node_kind") == "basic", old("label") == new("label"))
        .when(old("node_kind") == "named", old("corr_id") == new("corr_id"))
        .when(old("node_kind") == "array", old("array_len").eqNullSafe(new("array_len")))
        .when(old("node_kind") == "signature", old("variadic").eqNullSafe(new("variadic")))
        .otherwise(True)
    )
    corresponds = by_kind
    if mapped:
        target = old("maps_to")
        by_map = (new("node_kind") == target["new_kind"]) & (new("label") == target["new_name"])
        corresponds = F.when((old("node_kind") == "named") & target.isNotNull(), by_map).otherwise(by_kind)
    paired = F.col("in_old") & F.col("in_new")
    # An unexported embedded named field goes by its type; every other field by its name.
    by_type = (
        old("embedded") & new("embedded") & (old("node_kind") == "named")
        & ~is_exported(old("field_name")) & ~is_exported(new("field_name"))
    )
    return {
        "type_differs": ~(paired & F.coalesce(corresponds, F.lit(False))),
        "embedded_differs": paired & ~old("embedded").eqNullSafe(new("embedded")),
        "tag_differs": paired & (F.coalesce(old("struct_tag"), F.lit("")) != F.coalesce(new("struct_tag"), F.lit(""))),
        "name_differs": paired
        & ~old("field_name").eqNullSafe(new("field_name"))
        & ~F.coalesce(by_type, F.lit(False)),
    }


def compare_types(sided: DataFrame, scope: Sequence[str] = SCOPE, type_corr: DataFrame | None = None) -> DataFrame:
    """Whether the types at each (root, part) of both sides correspond, and the printed cause when not."""
    return compare_trees(align_positions(sided, scope, type_corr), scope)


def compare_trees(nodes: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Outcome of every tree that both sides have, from aligned nodes with their differences.

    Two aggregations over aligned nodes: per child of the top node, then per tree. No tree is gathered.
    """
    tree = [*scope, "root", "part"]
    nodes = nodes.repartition(*tree)
    depth = F.size("path")
    slot = F.when(depth > 0, F.get("path", 0)).otherwise(-1)
    second = F.when(depth > 1, F.get("path", 1))
    differs = F.col("type_differs") | F.col("embedded_differs") | F.col("tag_differs") | F.col("name_differs")
    check = (
        F.when(F.col("embedded_differs") & (depth == 1), 1)
        .when(F.col("tag_differs") & (depth == 1), 2)
        .when(F.col("type_differs") | (differs & (depth > 1)), 3)
        .when(F.col("name_differs"), 4)
    )
    head = F.when(depth <= 1, F.struct("in_old", "in_new", "old_node_kind", "new_node_kind", "old_array_len", "new_array_len", "old_variadic", "new_variadic", "type_differs", "name_differs"))
    per_slot = nodes.groupBy(*tree, slot.alias("slot")).agg(
        F.max(head).alias("head"),
        F.bool_or(differs).alias("bad"),
        F.min(check).alias("check"),
        F.bool_or(differs & (second == 0)).alias("bad_first"),
        F.bool_or(differs & (second == 1)).alias("bad_second"),
    )
    h = F.col("head")
    both_signatures = (h["old_node_kind"] == "signature") & (h["new_node_kind"] == "signature")
    method_cause = F.when(
        both_signatures,
        what_changed(
            {
                "params": ~F.coalesce("bad_first", F.lit(False)),
                "returns": ~F.coalesce("bad_second", F.lit(False)),
                "variadic": h["old_variadic"].eqNullSafe(h["new_variadic"]),
            }
        ),
    ).otherwise("")
    below, top = F.col("slot") >= 0, F.col("slot") < 0
    first_bad = F.min(F.when(below & F.col("bad"), F.struct("slot", "check", h["name_differs"].alias("renamed"), method_cause.alias("method_cause"))))
    whole = per_slot.groupBy(*tree).agg(
        F.bool_or("bad").alias("bad"),
        F.max(F.when(top, h)).alias("t"),
        F.bool_or(top & F.col("bad")).alias("bad_top"),
        F.coalesce(F.bool_or(F.col("bad") & (F.col("slot") == 0)), F.lit(False)).alias("bad_0"),
        F.coalesce(F.bool_or(F.col("bad") & (F.col("slot") == 1)), F.lit(False)).alias("bad_1"),
        F.count_if(below & h["in_old"]).alias("n_old"),
        F.count_if(below & h["in_new"]).alias("n_new"),
        first_bad.alias("first"),
    )
    on_both = whole.filter(F.col("t")["in_old"] & F.col("t")["in_new"])
    return on_both.select(*tree, (~F.col("bad")).alias("corresponds"), F.when(F.col("bad"), _cause()).alias("type_cause"))


def _cause() -> Column:
    t, first = F.col("t"), F.col("first")
    kind = t["old_node_kind"]
    same_count = F.col("n_old") == F.col("n_new")
    field = F.get(F.array(*[F.lit(c) for c in FIELD_CHECKS]), first["check"] - 1)
    element = ~F.col("bad_0")
    return (
        F.when(kind == "basic", "basic")
        .when(kind != t["new_node_kind"], "")
        .when(kind == "array", what_changed({"element": element, "length": t["old_array_len"].eqNullSafe(t["new_array_len"])}))
        .when(kind.isin("slice", "chan"), what_changed({"element": element}))
        .when(kind == "map", what_changed({"key": element, "element": ~F.col("bad_1")}))
        .when(kind == "pointer", what_changed({"base": element}))
        .when(
            kind == "signature",
            what_changed({"params": element, "returns": ~F.col("bad_1"), "variadic": t["old_variadic"].eqNullSafe(t["new_variadic"])}),
        )
        .when(kind == "tuple", F.when(same_count, "element").otherwise("length"))
        .when(kind == "struct", F.when(same_count, field).otherwise("fieldNumber"))
        .when(
            kind == "interface",
            F.when(~same_count, "methodNumber").when(first["renamed"], "methodID").otherwise(first["method_cause"]),
        )
        .otherwise("")
    )


def embedded_names_correspond(
    sided: DataFrame, scope: Sequence[str] = SCOPE, type_corr: DataFrame | None = None
) -> DataFrame:
    """Field rows of both sides with ``corresponds``: by type when embedded and unexported, else by name."""
    nodes = align_positions(sided, scope, type_corr)
    fields = nodes.filter(F.col("in_old") & F.col("in_new") & F.col("old_field_name").isNotNull())
    return fields.select(
        *scope, "root", "part", "path", "old_field_name", "new_field_name", (~F.col("name_differs")).alias("corresponds")
    )


def align_interface_methods(methods: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Per interface of both sides: counts of methods, of shared ids and of equal signatures."""
    on = [*scope, "owner"]
    both = align(methods, [*on, "method_name"], ["corr_key"])
    return both.groupBy(*on).agg(
        F.count_if("in_old").alias("n_old"),
        F.count_if("in_new").alias("n_new"),
        F.count_if(F.col("in_old") & F.col("in_new")).alias("n_shared"),
        F.count_if(F.col("old_corr_key") == F.col("new_corr_key")).alias("n_equal"),
    )


def type_kinds(nodes: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Printed kind of every tree: down its pointers to the first other kind.

    ``named_kind`` on named nodes, when present, is the printed kind of what the name stands for.
    """
    leftmost = ~F.exists("path", lambda step: step != 0)
    kind = F.when(F.col("node_kind") == "signature", "function").otherwise(F.col("node_kind"))
    if "named_kind" in nodes.columns:
        kind = F.when(F.col("node_kind") == "named", F.concat(F.lit("named|"), "named_kind")).otherwise(kind)
    ends = nodes.filter(leftmost & (F.col("node_kind") != "pointer"))
    shallowest = F.min(F.struct(F.size("path").alias("depth"), kind.alias("kind")))
    return (
        ends.groupBy(*scope, "root", "part")
        .agg(shallowest.alias("e"))
        .select(*scope, "root", "part", F.concat(F.repeat(F.lit("pointer|"), F.col("e")["depth"]), F.col("e")["kind"]).alias("type_kind"))
    )


def unsupported_objects(nodes: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Side output: trees with a kind the rules do not know (type parameters among them)."""
    return (
        nodes.filter(~F.col("node_kind").isin(*KNOWN_KINDS))
        .groupBy(*scope, "root")
        .agg(F.count(F.lit(1)).alias("n_unsupported"))
    )


def failed_objects(nodes: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Side output of a comparison: per side and tree, each kind the rules do not know and how often it occurs."""
    unknown = nodes.filter(~F.col("node_kind").isin(*KNOWN_KINDS))
    return unknown.groupBy(*scope, "side", "root", F.col("node_kind").alias("unsupported_kind")).agg(F.count(F.lit(1)).alias("n_nodes"))


def drop_failed_pairs(rows: DataFrame, unsupported: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Drop everything of a pair that has an unsupported object, as a failed comparison would."""
    return rows.join(unsupported.select(pair).distinct(), pair, "left_anti")


# --- which named type becomes which ------------------------------------------------------------------


def find_correspondence(uses: DataFrame, type_corr: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Look the old type of every use (``old_name``, ``new_kind``, ``new_name``) up: does the use agree?"""
    known = type_corr.select(*scope, "old_name", F.struct("new_kind", "new_name").alias("known"))
    joined = uses.join(known, [*scope, "old_name"], "left")
    agrees = F.col("known") == F.struct("new_kind", "new_name")
    return joined.withColumn("agrees", F.coalesce(agrees, F.lit(False))).drop("known")


def _ancestors(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per node and proper ancestor: its ``prefix`` and the child ``step`` taken from it."""
    level = F.explode(F.sequence(F.lit(0), F.size("path") - 1)).alias("level")
    rows = df.filter(F.size("path") > 0).select("*", level)
    return rows.withColumns({"prefix": F.slice("path", F.lit(1), F.col("level")), "step": F.get("path", F.col("level"))})


def _met_types(items: DataFrame, sided: DataFrame | None, aligned: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Named types that a comparison of ``items`` (old_root, new_root, pos, chain) meets, with their place.

    ``aligned`` are the trees ``sided`` by name, so only items under a new name are aligned here; where no item has
    one, ``sided`` is None. Below a pair of
    different kinds or counts nothing is met, nor after the first child that differs in shape among the members of a
    tuple, struct or interface.
    """
    keys = [*scope, "old_root", "part"]
    place = ["pos", "chain"]
    same = items.filter("old_root = new_root").select(*scope, F.col("old_root").alias("root"))
    nodes = aligned.join(same, [*scope, "root"], "left_semi").withColumnRenamed("root", "old_root")
    if sided is not None:
        renamed = items.filter("old_root != new_root")
        old = renamed.select(*scope, F.lit("old").alias("side"), "old_root", F.col("old_root").alias("root"))
        new = renamed.select(*scope, F.lit("new").alias("side"), "old_root", F.col("new_root").alias("root"))
        walked = sided.join(old.unionByName(new), [*scope, "side", "root"])
        nodes = nodes.unionByName(align(walked, [*keys, "path"], NODE_COLUMNS))

    paired = F.col("in_old") & F.col("in_new")
    old_kind, new_kind = F.col("old_node_kind"), F.col("new_node_kind")
    named_pair = (old_kind == "named") & new_kind.isin("named", "basic")
    shape = paired & F.coalesce(
        named_pair
        | (
            (old_kind == new_kind)
            & ((old_kind != "basic") | (F.col("old_label") == F.col("new_label")))
            & ((old_kind != "array") | F.col("old_array_len").eqNullSafe(F.col("new_array_len")))
            & ((old_kind != "signature") | F.col("old_variadic").eqNullSafe(F.col("new_variadic")))
        ),
        F.lit(False),
    )
    facts_differ = paired & (
        ~F.col("old_embedded").eqNullSafe(F.col("new_embedded"))
        | (F.coalesce("old_struct_tag", F.lit("")) != F.coalesce("new_struct_tag", F.lit("")))
    )
    own = F.coalesce(F.col("old_named_pkg"), F.lit("")) == ""
    new_own = (new_kind == "basic") | (F.coalesce(F.col("new_named_pkg"), F.lit("")) == "")
    # Read four times below: what is bad, what counts its members, and what is met.
    nodes = materialize(
        nodes.select(
            *keys, "path", (~shape | facts_differ).alias("bad"), paired.alias("paired"), (paired & (old_kind != new_kind)).alias("other_kind"),
            old_kind.isin(*COUNTED_KINDS).alias("counted"), F.coalesce(paired & named_pair & own & new_own, F.lit(False)).alias("met"),
            F.col("old_label").alias("old_name"), new_kind.alias("new_kind"), F.col("new_label").alias("new_name"),
        ),
        "walked",
    )
    met = nodes.filter("met").select(*keys, "path", "old_name", "new_kind", "new_name")
    # Trees that meet no type need no look at what is bad in them.
    trees = met.select(*keys).distinct()
    here = [*keys, "prefix"]
    # A missing partner means that the counts of the parent differ: nothing below the parent is met.
    # A node of another kind stops the walk below it; a bad member stops its later siblings.
    bad = nodes.filter("bad").join(trees, keys, "left_semi").select(*keys, "path", "paired", "other_kind")
    uneven = bad.filter(~F.col("paired") & (F.size("path") > 0)).select(*keys, F.slice("path", F.lit(1), F.size("path") - 1).alias("prefix"), F.lit(0).alias("stop"))
    other_kind = bad.filter("other_kind").select(*keys, F.col("path").alias("prefix"), F.lit(0).alias("stop"))
    counted = nodes.filter("counted").select(*keys, F.col("path").alias("prefix"))
    later = _ancestors(bad.drop("paired", "other_kind"), keys).select(*here, (F.col("step") + 1).alias("stop")).join(counted, here, "left_semi")
    stops = uneven.unionByName(other_kind).unionByName(later).groupBy(*here).agg(F.min("stop").alias("stop"))
    blocked = (
        _ancestors(met, keys).join(stops, here).filter(F.col("step") >= F.col("stop")).select(*keys, "path").distinct()
    )
    met = met.join(blocked, [*keys, "path"], "left_anti")
    steps = F.transform("path", lambda s: F.lpad(s.cast("string"), 10, "0"))
    return met.join(items.select(*scope, "old_root", *place), [*scope, "old_root"]).select(
        *scope, "old_name", "new_kind", "new_name",
        F.concat("pos", F.array("part"), steps).alias("pos"),
        "chain",
        F.col("pos").alias("parent_pos"),
    )


def establish_correspondence(
    objects: DataFrame, sided: DataFrame, scope: Sequence[str] = SCOPE, aligned: DataFrame | None = None
) -> DataFrame:
    """Map old named types to new ones: the first pair met wins, even under a new name.

    ``objects`` are the exported names of both sides (``obj_name``, ``old_kind``, ``new_kind``). Objects are
    visited in name order; a type is entered where it is first mapped, so of all pairs that an old type is met in,
    the one at the smallest place holds.

    Only types whose pair is new or has moved since the last round are entered (the frontier): their members give
    further candidates. ``aligned`` are the trees of both sides by name, where the caller has them. A candidate that was met inside a pair which lost its place meanwhile is taken back. A place
    inside a type comes after the place of the type itself, so places settle from the smallest on and the rounds end;
    there are about as many as levels of types within types. Packages without a frontier are done and left out.
    """
    aligned = materialize(align_trees(sided, scope), "aligned") if aligned is None else aligned
    key = [*scope, "old_name"]
    pair = ["new_kind", "new_name", "pos", "chain"]
    empty = F.array().cast("array<string>")
    nowhere = F.lit(None).cast("array<string>")
    types = objects.filter((F.col("old_kind") == "type") & (F.col("new_kind") == "type")).select(
        *scope, F.col("obj_name").alias("old_name"), F.lit("named").alias("new_kind"),
        F.col("obj_name").alias("new_name"), F.array("obj_name").alias("pos"), empty.alias("chain"),
        nowhere.alias("parent_pos"),
    )
    same = F.col("old_kind") == F.col("new_kind")
    func_to_var = (F.col("old_kind") == "func") & (F.col("new_kind") == "var")
    others = objects.filter((F.col("old_kind") != "type") & (same | func_to_var)).select(
        *scope, F.col("obj_name").alias("old_root"), F.col("obj_name").alias("new_root"),
        F.array("obj_name").alias("pos"), empty.alias("chain"),
    )
    met = _met_types(others, None, aligned, scope).withColumn("parent_pos", nowhere)
    candidates = materialize(types.unionByName(met), "candidates")
    # From here on only types are entered; the trees of functions and variables need no further look.
    labels = sided.filter("node_kind = 'named'").select(*scope, F.col("label").alias("root"))
    enterable = materialize(types.select(*scope, F.col("old_name").alias("root")).unionByName(labels).distinct(), "enterable")
    sided, aligned = (materialize(df.join(enterable, [*scope, "root"], "left_semi"), "type-trees") for df in (sided, aligned))

    def winners(rows: DataFrame) -> DataFrame:
        best = F.min(F.struct("pos", "new_kind", "new_name", "chain")).alias("w")
        return rows.groupBy(*key).agg(best).select(*key, *[F.col("w")[c].alias(c) for c in pair])

    def still_met(rows: DataFrame, holding: DataFrame) -> DataFrame:
        """Candidates met outside of types, or inside a pair that holds."""
        parents = holding.select(*scope, F.col("old_name").alias("_parent"), F.col("pos").alias("parent_pos"))
        inside = rows.filter("parent_pos is not null").withColumn("_parent", F.try_element_at("chain", F.lit(-1)))
        return rows.filter("parent_pos is null").unionByName(
            inside.join(parents, [*scope, "_parent", "parent_pos"], "left_semi").drop("_parent")
        )

    mapping = materialize(winners(candidates), "mapping")
    frontier, settled = mapping, None
    while True:
        items = frontier.filter("new_kind = 'named'").select(
            *scope, F.col("old_name").alias("old_root"), F.col("new_name").alias("new_root"), "pos",
            F.concat("chain", F.array("old_name")).alias("chain"),
        )
        # A type is never entered again from within itself.
        found = _met_types(items, sided, aligned, scope).filter(~F.array_contains("chain", F.col("old_name")))
        candidates = materialize(still_met(candidates, mapping).unionByName(found), "candidates")
        following = materialize(winners(candidates), "mapping")
        place = [*key, "new_kind", "new_name", "pos"]
        moved = following.join(mapping, place, "left_anti")
        lost = mapping.join(following, key, "left_anti")
        going = materialize(moved.select(*scope).unionByName(lost.select(*scope)).distinct(), "going")
        done = following.join(going, list(scope), "left_anti")
        settled = done if settled is None else settled.unionByName(done)
        if going.isEmpty():
            return settled.drop("chain")
        frontier = moved
        mapping, candidates = (df.join(going, list(scope), "left_semi") for df in (following, candidates))
