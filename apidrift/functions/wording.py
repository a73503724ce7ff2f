"""Kinds, object names and message texts of API changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds as they are named in reports.
OBJECT_KINDS = ("const", "var", "func", "type")
TYPE_KINDS = (
    "basic", "array", "slice", "map", "chan", "pointer", "function",
    "tuple", "struct", "interface", "named", "typeParam",
)
UNKNOWN_KIND = "???"


def is_exported(name: Column) -> Column:
    return name.rlike(r"^\p{Lu}")


def object_kind(kind: Column) -> Column:
    return F.when(kind.isin(*OBJECT_KINDS), kind).otherwise(UNKNOWN_KIND)


def type_kind(chain: Column) -> Column:
    """Printed kind of a type from the kinds met down its pointer and named chain."""

    def one(kind: Column) -> Column:
        kind = F.when(kind == "signature", "function").otherwise(kind)
        return F.when(kind.isin(*TYPE_KINDS), kind).otherwise(UNKNOWN_KIND)

    return F.array_join(F.transform(chain, one), "|")


def change_message(cause: Column, old: Column, new: Column) -> Column:
    """``<cause> changed from <old> to <new>``, without the blank when there is no cause."""
    lead = F.when(F.coalesce(cause, F.lit("")) == "", "").otherwise(F.concat(cause, F.lit(" ")))
    return F.concat(lead, F.lit("changed from "), old, F.lit(" to "), new)


def signature_text(params: Column, results: Column, variadic: Column) -> Column:
    """A signature by its types only; the last parameter of a variadic one is a slice."""
    last = F.get(params, F.size(params) - 1)
    opened = F.concat(
        F.slice(params, 1, F.greatest(F.size(params) - 1, F.lit(0))),
        F.array(F.regexp_replace(last, r"^\[\]", "...")),
    )
    shown = F.when(variadic & (F.size(params) > 0), opened).otherwise(params)
    tail = (
        F.when(F.size(results) == 0, "")
        .when(F.size(results) == 1, F.concat(F.lit(" "), F.get(results, 0)))
        .otherwise(F.concat(F.lit(" ("), F.array_join(results, ", "), F.lit(")")))
    )
    return F.concat(F.lit("func("), F.array_join(shown, ", "), F.lit(")"), tail)


def object_node(name: Column, receiver: Column, ptr_receiver: Column) -> Column:
    """``T.M`` or ``(*T).M`` for methods, the bare name for everything else."""
    return (
        F.when(F.coalesce(receiver, F.lit("")) == "", name)
        .when(ptr_receiver, F.concat(F.lit("(*"), receiver, F.lit(")."), name))
        .otherwise(F.concat(receiver, F.lit("."), name))
    )


def dot_join(left: Column, right: Column) -> Column:
    empty = F.lit("")
    return F.concat_ws(".", F.nullif(left, empty), F.nullif(right, empty))


def _aside(part: Column) -> Column:
    return F.startswith(part, F.lit(","))


def change_node(node: Column, part: Column) -> Column:
    """Reported node: a part that starts with a comma stays out of it."""
    return F.when(_aside(part), node).otherwise(dot_join(node, part))


def change_text(part: Column, message: Column) -> Column:
    """Reported text: a part that starts with a comma moves in front of the message."""
    lead = F.regexp_replace(part, "^, ", "")
    return F.when(_aside(part), F.concat(lead, F.lit(" "), message)).otherwise(message)


def what_changed(checks: dict[str, Column]) -> Column:
    """Names of the failed checks in their given order, joined by a bar."""
    return F.concat_ws("|", *[F.when(~passed, F.lit(name)) for name, passed in checks.items()])
