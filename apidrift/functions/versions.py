"""Tags as versions: validity, order, segments and the size of an update."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the shape of a semantic version, short forms included.
SEMVER = (
    "(0|[1-9][0-9]*)([.](0|[1-9][0-9]*)([.](0|[1-9][0-9]*)"
    "(-[0-9A-Za-z-]+([.][0-9A-Za-z-]+)*)?([+][0-9A-Za-z-]+([.][0-9A-Za-z-]+)*)?)?)?$"
)
# A numeric pre-release part must not start with a zero.
ZERO_LED_PRERELEASE = "^v*[0-9.]+-([0-9A-Za-z-]+[.])*0[0-9]+([.+]|$)"
# Fixed value: dotted numbers, then an optional pre-release and optional metadata.
LOOSE_VERSION = (
    r"^v?([0-9]+(?:\.[0-9]+)*)(?:-([0-9A-Za-z~-]+(?:\.[0-9A-Za-z~-]+)*))?"
    r"(?:\+([0-9A-Za-z~-]+(?:\.[0-9A-Za-z~-]+)*))?$"
)


def strip_v(tag: Column) -> Column:
    return F.regexp_replace(tag, "^v", "")


def is_valid_semver(tag: Column, compat: bool = False) -> Column:
    """Whether a tag is a semantic version, with or without one leading ``v``.

    ``compat`` asks for the ``v`` after one has been stripped, so only ``vv1.2.3`` passes.
    """
    body = strip_v(tag) if compat else tag
    lead = "^v" if compat else "^v?"
    return body.rlike(lead + SEMVER) & ~body.rlike(ZERO_LED_PRERELEASE)


def version_sort_key(tag: Column) -> Column:
    """Array that sorts as ``git tag --sort=v:refname`` does: digit runs compare as numbers.

    A digit run becomes its length (ten digits, as many as a length can have) and its text, so runs of any length keep their order.
    """
    runs = F.regexp_extract_all(tag, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def part(run: Column) -> Column:
        # Plain text functions: patterns are slow inside a transform. A run of zeros keeps one; ":" comes after "9".
        led = F.ltrim(run, F.lit("0"))
        digits = F.when(led == "", "0").otherwise(led)
        is_number = (run >= "0") & (run < ":")
        return F.when(is_number, F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(run)

    return F.transform(runs, part)


def parse_version(tag: Column) -> Column:
    """struct(segments, prerelease, metadata); NULL when the tag cannot be parsed.

    Segments are padded with zeros to three. A segment beyond 64 bits makes the tag unparsable.
    """
    numbers = F.transform(F.split(F.regexp_extract(tag, LOOSE_VERSION, 1), r"\."), lambda n: n.try_cast("bigint"))
    zeros = F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.lit(3) - F.size(numbers), F.lit(0)))
    parsed = F.struct(
        F.concat(numbers, zeros).alias("segments"),
        F.regexp_extract(tag, LOOSE_VERSION, 2).alias("prerelease"),
        F.regexp_extract(tag, LOOSE_VERSION, 3).alias("metadata"),
    )
    return F.when(tag.rlike(LOOSE_VERSION) & ~F.exists(numbers, lambda n: n.isNull()), parsed)


def _is_plain(version: Column) -> Column:
    return (version["prerelease"] == "") & (version["metadata"] == "")


def is_minor_or_patch(old_tag: Column, new_tag: Column, compat: bool = False) -> Column:
    """Whether the update keeps the major number and moves forward.

    ``compat`` also accepts a rising patch under a falling minor number.
    """
    old, new = parse_version(old_tag), parse_version(new_tag)
    old_seg, new_seg = old["segments"], new["segments"]
    minor_rises = F.get(new_seg, 1) > F.get(old_seg, 1)
    patch_rises = F.get(new_seg, 2) > F.get(old_seg, 2)
    forward = minor_rises | patch_rises
    if not compat:
        forward = minor_rises | ((F.get(new_seg, 1) == F.get(old_seg, 1)) & patch_rises)
    return F.coalesce(
        _is_plain(old)
        & _is_plain(new)
        & (F.size(old_seg) == 3)
        & (F.size(new_seg) == 3)
        & (F.get(old_seg, 0) == F.get(new_seg, 0))
        & forward,
        F.lit(False),
    )


def update_kind(old_tag: Column, new_tag: Column) -> Column:
    """major, minor, patch, downgrade, same, prerelease or invalid."""
    old, new = parse_version(old_tag), parse_version(new_tag)
    old_seg, new_seg = old["segments"], new["segments"]
    return (
        F.when(old.isNull() | new.isNull(), "invalid")
        .when((F.size(old_seg) != 3) | (F.size(new_seg) != 3), "invalid")
        .when(~_is_plain(old) | ~_is_plain(new), "prerelease")
        .when(new_seg == old_seg, "same")
        .when(new_seg < old_seg, "downgrade")
        .when(F.get(new_seg, 0) > F.get(old_seg, 0), "major")
        .when(F.get(new_seg, 1) > F.get(old_seg, 1), "minor")
        .otherwise("patch")
    )
