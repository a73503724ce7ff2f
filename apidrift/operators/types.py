"""Compatibility of named types: underlying kinds, channels, basics, structs, interfaces, methods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apidrift.functions.wording import change_message, object_node
from apidrift.operators.diff import COMPARISON, SCOPE, align, dealt, type_cause, type_differs
from apidrift.operators.messages import all_changes, emit, message
from apidrift.session import materialize

# Basic types in widening order. Each may become any later one of its line.
WIDENING_LINES = (
    ("uint8", "uint16", "uint32", "uint", "uint64"),
    ("int8", "int16", "int32", "int", "int64"),
    ("float32", "float64"),
    ("complex64", "complex128"),
)
TYPE_COLUMNS = (
    "underlying_kind", "underlying_corr_key", "underlying_str", "comparable",
    "chan_dir", "elem_corr_key", "elem_str", "elem_kind", "basic_name", "is_basic",
)


def widening_pairs(spark: SparkSession) -> DataFrame:
    """The (old, new) pairs of basic types whose change is compatible."""
    rows = [(old, new) for line in WIDENING_LINES for i, old in enumerate(line) for new in line[i + 1 :]]
    return spark.createDataFrame(rows, "old_basic string, new_basic string")


def is_widening(old: Column, new: Column) -> Column:
    """The widening table as an expression, for use inside larger rules."""
    hit = F.lit(False)
    for line in WIDENING_LINES:
        for i, name in enumerate(line[:-1]):
            hit = hit | ((old == name) & new.isin(*line[i + 1 :]))
    return hit


def basic_widening(aligned: DataFrame) -> DataFrame:
    """Mark aligned basic types (``old_basic_name``, ``new_basic_name``) with ``widening``.

    The pair table is a fixed list of a few rows, so it is broadcast.
    """
    pairs = widening_pairs(aligned.sparkSession).withColumn("widening", F.lit(True))
    on = (F.col("old_basic_name") == F.col("old_basic")) & (F.col("new_basic_name") == F.col("new_basic"))
    return aligned.join(F.broadcast(pairs), on, "left").drop("old_basic", "new_basic").fillna(False, ["widening"])


def align_types(
    sided: DataFrame, scope: Sequence[str] = SCOPE, parts: int | None = None, near: Sequence[str] | None = None
) -> DataFrame:
    """Corresponding named types side by side, keyed by the old name ``owner``.

    Types correspond by name; see ``under_old_names`` for types that were renamed.
    """
    named = sided.withColumnRenamed("type_name", "owner")
    return align(named, [*scope, "owner"], [*TYPE_COLUMNS, *COMPARISON], matched=True, near=near, parts=parts)


def under_old_names(sided: DataFrame, type_corr: DataFrame, scope: Sequence[str], column: str = "owner") -> DataFrame:
    """Rows of mapped types only, those of the new side under the old name of their type."""
    old = type_corr.select(*scope, F.lit("old").alias("side"), F.col("old_name").alias(column), "old_name")
    new = type_corr.select(*scope, F.lit("new").alias("side"), F.col("new_name").alias(column), "old_name")
    names = old.unionByName(new)
    return sided.join(names, [*scope, "side", column]).drop(column).withColumnRenamed("old_name", column)


def moved_names(type_corr: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Both names of every type that is mapped to something else than the type of its name."""
    moved = type_corr.filter("new_kind != 'named' or new_name != old_name")
    return moved.select(*scope, F.explode(F.array("old_name", "new_name")).alias("root")).distinct()


def roots_under_old_names(nodes: DataFrame, type_corr: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Type trees with those of the new side's mapped types under the old names.

    A tree of the new side that stands under the old name of a type mapped to something else is left out.
    """
    named = type_corr.filter("new_kind = 'named'")
    to_old = named.select(*scope, F.lit("new").alias("side"), F.col("new_name").alias("root"), F.col("old_name").alias("_old"))
    taken = type_corr.select(*scope, F.lit("new").alias("side"), F.col("old_name").alias("root"), F.lit(True).alias("_taken"))
    key = [*scope, "side", "root"]
    kept = nodes.join(to_old, key, "left").join(taken, key, "left").filter("_old is not null or _taken is null")
    return kept.withColumn("root", F.coalesce("_old", "root")).drop("_old", "_taken")


def with_basic_targets(sided: DataFrame, type_corr: DataFrame) -> DataFrame:
    """Types plus a new-side row for every basic type that an old named type was mapped to."""
    scope = [c for c in type_corr.columns if c not in ("old_name", "new_kind", "new_name", "pos")]
    basics = type_corr.filter("new_kind = 'basic'").select(
        *scope,
        F.lit("new").alias("side"),
        F.col("new_name").alias("type_name"),
        F.lit("basic").alias("underlying_kind"),
        F.col("new_name").alias("underlying_corr_key"),
        F.col("new_name").alias("underlying_str"),
        F.lit(True).alias("comparable"),
        F.col("new_name").alias("basic_name"),
        F.lit(True).alias("is_basic"),
    )
    return sided.unionByName(basics.distinct(), allowMissingColumns=True)


def _type_row(text: Column, changed_type: Column, compatible: bool, cause: str, step: int, part: Column | None = None) -> Column:
    owner = F.col("owner")
    return message(owner, owner, F.lit("type"), F.lit("") if part is None else part, changed_type, text, compatible, cause, step)


def check_named_types(types: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Rule rows of the underlying types: other kinds, channels and basics, lost comparability."""
    old_kind, new_kind = F.col("old_underlying_kind"), F.col("new_underlying_kind")
    same_kind = old_kind == new_kind
    printed = change_message(F.lit(""), F.col("old_underlying_str"), F.col("new_underlying_str"))
    routed = old_kind.isin("interface", "struct", "chan", "basic")
    # Kinds without a rule of their own compare as plain types, with the cause of the comparison.
    differs = type_differs(types, "underlying_corr_key")
    plain = change_message(type_cause(types, F.lit("")), F.col("old_underlying_str"), F.col("new_underlying_str"))

    # The tree of a channel is its element: it differs when and as the element does.
    both_chan = same_kind & (old_kind == "chan")
    elem_differs = type_differs(types, "elem_corr_key")
    elem_kind = F.col("old_elem_kind")
    elem_cause = F.when(elem_kind == "basic", "basic").otherwise("")
    turned = F.col("old_chan_dir") != F.col("new_chan_dir")
    opened = F.col("new_chan_dir") == "both"
    elem = change_message(elem_cause, F.col("old_elem_str"), F.col("new_elem_str"))

    both_basic = same_kind & (old_kind == "basic") & (F.col("old_basic_name") != F.col("new_basic_name"))
    widens = is_widening(F.col("old_basic_name"), F.col("new_basic_name"))
    basic = change_message(F.lit(""), F.col("old_basic_name"), F.col("new_basic_name"))

    both_struct = same_kind & (old_kind == "struct")
    lost = both_struct & F.col("old_comparable") & ~F.col("new_comparable")
    by_kind = F.coalesce(
        F.when(routed & ~same_kind, _type_row(printed, old_kind, False, "kind", 2)),
        F.when(~routed & differs, _type_row(plain, old_kind, False, "kind", 2)),
        F.when(both_chan & elem_differs, _type_row(elem, elem_kind, False, "kind", 2, F.lit(", element"))),
        F.when(both_basic & widens, _type_row(basic, new_kind, True, "kind", 2)),
        F.when(both_basic & ~widens, _type_row(basic, old_kind, False, "kind", 2)),
        F.when(lost, _type_row(F.lit("old is comparable, new is not"), old_kind, False, "comparable", 5)),
    )
    direction = F.when(
        both_chan & turned & opened, _type_row(F.lit("removed direction"), old_kind, True, "direction", 2)
    ).when(both_chan & turned, _type_row(F.lit("changed direction"), old_kind, False, "direction", 2))
    return emit(types, scope, [by_kind, direction])


def is_comparable(fields: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A struct is comparable when all of its fields are."""
    return fields.groupBy(*keys).agg(F.bool_and("comparable").alias("comparable"))


# --- structs -----------------------------------------------------------------------------------------


def structs_on_both_sides(types: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    both = (F.col("old_underlying_kind") == "struct") & (F.col("new_underlying_kind") == "struct")
    return types.filter(both).select(*scope, "owner")


def exported_fields(fields: DataFrame) -> DataFrame:
    """Direct exported fields: the keys of a struct literal."""
    return fields.filter("exported")


def unambiguous_fields(level: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fields whose name occurs exactly once in its root at this depth.

    Counted with partial aggregation; the one row of a surviving group comes along as a struct.
    """
    rest = [c for c in level.columns if c not in {*keys, "field_name"}]
    once = level.groupBy(*keys, "field_name").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct(*rest)).alias("_f"))
    return once.filter("_n = 1").select(*keys, "field_name", *[F.col("_f")[c].alias(c) for c in rest])


def exported_selectable_fields(
    fields: DataFrame, scope: Sequence[str], roots: DataFrame | None = None, foreign: DataFrame | None = None
) -> DataFrame:
    """Exported fields reachable by selection, those of embedded structs included, with their ``depth``.

    One pass per embedding depth: a name must be unambiguous at its depth, a shallower one wins, and a
    struct met at this depth or above is not entered again. ``embedded_owner`` names the struct behind an
    embedded field (or behind its pointer), ``embedded_pkg`` its package where that is another one. The passes end
    when no embedded struct is left. ``roots`` (some of ``scope`` and ``owner``) limits the result to the structs
    somebody asks about. ``foreign`` has the fields of all packages of a release, keyed by the columns of ``scope``
    that it has, ``home`` (package path) and ``owner``; without it structs of other packages are not entered.
    """
    root = [*scope, "root"]
    facts = [c for c in ("type_str", "type_kind", "corr_key", *COMPARISON) if c in fields.columns]
    follow = ["embedded", "embedded_owner", "exported"]
    members = fields.select(*scope, "owner", "field_name", *facts, *follow, _text_or_blank(fields, "embedded_pkg"))
    # A struct has no name twice, so nothing is ambiguous at the top.
    asked = members if roots is None else members.join(roots, roots.columns, "left_semi")
    # The package a row was found in; blank for the one that is compared.
    clear = asked.withColumn("root", F.col("owner")).drop("owner").withColumn("home", F.lit(""))
    found = clear.filter("exported").withColumn("depth", F.lit(0))
    entered = asked.select(*scope, F.col("owner").alias("root"), "owner", F.lit("").alias("home")).distinct()
    depth = 0
    while True:
        # Two embedded fields may lead to one struct; each occurrence counts, so no distinct here.
        home = F.when(F.col("embedded_pkg") != "", F.col("embedded_pkg")).otherwise(F.col("home")).alias("home")
        inner = clear.filter("embedded").select(*root, F.col("embedded_owner").alias("owner"), home)
        inner = inner.join(entered, [*root, "owner", "home"], "left_anti")
        level = inner.filter("home = ''").join(members, [*scope, "owner"])
        if foreign is not None:
            key = [c for c in scope if c in foreign.columns]
            others = foreign.select(*key, "home", "owner", "field_name", *[c for c in facts if c in foreign.columns], *follow, _text_or_blank(foreign, "embedded_pkg"))
            level = level.unionByName(inner.filter("home != ''").join(others, [*key, "home", "owner"]), allowMissingColumns=True)
        level = materialize(level, "embedding")
        if level.isEmpty():
            break
        depth += 1
        clear = unambiguous_fields(level.drop("owner"), root)
        found = found.unionByName(clear.filter("exported").withColumn("depth", F.lit(depth)))
        entered = entered.unionByName(level.select(*root, "owner", "home").distinct())
    if depth == 0:
        return found.withColumnRenamed("root", "owner").select(*scope, "owner", "field_name", "depth", *facts)
    shallowest = found.groupBy(*root, "field_name").agg(F.min(F.struct("depth", *facts)).alias("f"))
    return shallowest.select(
        *scope, F.col("root").alias("owner"), "field_name", *[F.col("f")[c].alias(c) for c in ("depth", *facts)]
    )


def _text_or_blank(df: DataFrame, name: str) -> Column:
    return (F.coalesce(name, F.lit("")) if name in df.columns else F.lit("")).alias(name)


def diff_fields(sided: DataFrame, scope: Sequence[str] = SCOPE, parts: int | None = None) -> DataFrame:
    """Rule rows of the selectable fields of both sides by name.

    Direct fields are the selectable ones at depth 0, so one alignment serves both field sets; rows that
    the direct set would only repeat are not emitted.
    """
    fields = align(sided, [*scope, "owner", "field_name"], ["type_str", "type_kind", "corr_key", "depth", *COMPARISON], parts=parts)
    owner, name = F.col("owner"), F.col("field_name")
    in_old, in_new = F.col("in_old"), F.col("in_new")
    cause = type_cause(fields, F.when(F.col("old_type_kind") == "basic", "basic").otherwise(""))

    def row(changed_type, text, compatible, family, step):
        return message(owner, owner, F.lit("type"), name, changed_type, text, compatible, family, step)

    changed = change_message(cause, F.col("old_type_str"), F.col("new_type_str"))
    rules = [
        F.coalesce(
            F.when(~in_new, row(F.col("old_type_kind"), F.lit("removed"), False, "removed", 4)),
            F.when(~in_old, row(F.col("new_type_kind"), F.lit("added"), True, "added", 4)),
            F.when(type_differs(fields), row(F.col("old_type_kind"), changed, False, "kind", 4)),
        )
    ]
    if "old_depth" in fields.columns:
        sunk = in_old & in_new & (F.col("old_depth") == 0) & (F.col("new_depth") > 0)
        risen = in_old & in_new & (F.col("old_depth") > 0) & (F.col("new_depth") == 0)
        rules.append(
            F.coalesce(
                F.when(sunk, row(F.col("old_type_kind"), F.lit("removed"), False, "removed", 3)),
                F.when(risen, row(F.col("new_type_kind"), F.lit("added"), True, "added", 3)),
            )
        )
    return emit(fields, scope, rules)


def check_structs(types: DataFrame, selectable: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Rule rows of direct and selectable fields of corresponding structs."""
    owners = structs_on_both_sides(types, scope)
    return diff_fields(selectable.join(owners, [*scope, "owner"], "left_semi"), scope)


# --- methods and interfaces --------------------------------------------------------------------------

METHOD_COLUMNS = ("ptr_receiver", "in_value_set", "recv_named", "recv_kind", "recv_is_owner", "sig_str", "corr_key")


def has_unexported_method(methods: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """First unexported method of every owner that has one."""
    return (
        methods.filter(~F.col("exported"))
        .groupBy(*scope, "owner")
        .agg(F.min("method_name").alias("unexported_method"))
    )


def _method_row(side: str, part: Column, text: Column, compatible: bool | Column, cause: str, step: int) -> Column:
    """A row about the old or the new method object; ``side`` gives the receiver that is printed."""
    node = object_node(F.col("method_name"), F.col(f"{side}_recv_named"), F.col(f"{side}_ptr_receiver"))
    object_key = F.concat(F.lit(f"{side}:"), node)
    return message(object_key, node, F.lit("func"), part, F.lit("function"), text, compatible, cause, step)


def _kind_part(side: str) -> Column:
    return F.concat(F.lit(", "), F.coalesce(F.col(f"{side}_recv_kind"), F.lit("")), F.lit(" method"))


def diff_methods(
    sided: DataFrame,
    scope: Sequence[str] = SCOPE,
    value_set: bool = True,
    additions_compatible: bool | str = True,
    parts: int | None = None,
) -> DataFrame:
    """Rule rows of the exported methods of both sides by name.

    One join serves both method sets: the pointer set holds every method, the value set those with
    ``in_value_set``. Rows the value set would only repeat are not emitted; ``value_set=False`` leaves its
    own rows out as well. ``additions_compatible`` is a flag or the name of a boolean column. With ``parts`` rows are
    dealt by ``scope``, which serves a later choice between the rows too.
    """
    columns = [*METHOD_COLUMNS, *COMPARISON]
    per_owner = isinstance(additions_compatible, str)
    if per_owner:
        columns.append(additions_compatible)
    sets = align(sided.filter("exported"), [*scope, "owner", "method_name"], columns, near=scope if parts else None, parts=parts)
    in_old, in_new = F.col("in_old"), F.col("in_new")
    old_value = F.coalesce(F.col("old_in_value_set"), F.lit(False))
    new_value = F.coalesce(F.col("new_in_value_set"), F.lit(False))
    owned = F.col("old_recv_is_owner")
    # A removal that came by embedding names the method set, so that it stays beside the removal of
    # the embedded type itself.
    # An interface has one set, without the star.
    star = "*" if value_set else ""
    from_pointer_set = F.when(owned, _kind_part("old")).otherwise(F.concat(F.lit(f", method set of {star}"), "owner"))
    from_value_set = F.when(owned, _kind_part("old")).otherwise(F.concat(F.lit(", method set of "), "owner"))
    # A value method that became a pointer method is also removed from the value set; keying its
    # signature change on the new method keeps both rows.
    moved = ~F.col("old_ptr_receiver") & F.col("new_ptr_receiver")
    changed = change_message(type_cause(sets, F.lit("")), F.col("old_sig_str"), F.col("new_sig_str"))
    differs = in_old & in_new & type_differs(sets)
    compatible = F.col("new_" + additions_compatible) if per_owner else additions_compatible
    rules = [
        F.coalesce(
            F.when(~in_new, _method_row("old", from_pointer_set, F.lit("removed"), False, "removed", 7)),
            F.when(~in_old, _method_row("new", _kind_part("new"), F.lit("added"), compatible, "added", 7)),
            F.when(differs & ~moved, _method_row("old", _kind_part("old"), changed, False, "kind", 7)),
            F.when(differs & moved, _method_row("new", _kind_part("new"), changed, False, "kind", 7)),
        )
    ]
    if value_set:
        lost = old_value & ~new_value & (in_new | ~owned)
        gained = new_value & ~old_value & in_old
        rules.append(
            F.coalesce(
                F.when(lost, _method_row("old", from_value_set, F.lit("removed"), False, "removed", 6)),
                F.when(gained, _method_row("new", _kind_part("new"), F.lit("added"), compatible, "added", 6)),
            )
        )
    return emit(sets, scope, rules)


def check_method_sets(types: DataFrame, methods: DataFrame, scope: Sequence[str] = SCOPE, parts: int | None = None) -> DataFrame:
    """Rule rows of the value and pointer method sets of types that keep their kind (interfaces aside)."""
    same = (F.col("old_underlying_kind") == F.col("new_underlying_kind")) & (F.col("old_underlying_kind") != "interface")
    on = [*scope, "owner"]
    owners = types.filter(same).select(*on)
    if parts:
        methods, owners = dealt(methods, on, parts), dealt(owners, on, parts)
    return diff_methods(methods.join(owners, on, "left_semi"), scope, parts=parts)


def check_interfaces(types: DataFrame, methods: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Rule rows of corresponding interfaces.

    With an unexported method in the old one users could only embed it, so additions are compatible.
    Otherwise additions break implementers, and so does a first unexported method.
    """
    both = (F.col("old_underlying_kind") == "interface") & (F.col("new_underlying_kind") == "interface")
    on = [*scope, "owner"]
    own = methods.join(types.filter(both).select(*on), on, "left_semi")
    hidden = own.groupBy(*on).agg(
        F.max((F.col("side") == "old") & ~F.col("exported")).alias("sealed"),
        F.min(F.when((F.col("side") == "new") & ~F.col("exported"), F.col("method_name"))).alias("unexported_method"),
    )
    # An interface has one method set.
    rows = diff_methods(
        own.join(hidden.select(*on, "sealed"), on), scope, value_set=False, additions_compatible="sealed"
    )
    added = emit(
        hidden.filter(~F.col("sealed") & F.col("unexported_method").isNotNull()),
        scope,
        [_type_row(F.lit("added unexported method"), F.lit("interface"), False, "unexported", 6, F.col("unexported_method"))],
    )
    return all_changes([rows, added])
