"""Names, urls, paths and positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PKG_INFO_SEPARATOR = "@@@"


def repo_url(full_name: Column) -> Column:
    """Clone url of an ``owner/name`` pair."""
    return F.concat(F.lit("https://github.com/"), full_name, F.lit(".git"))


def server_name(url: Column) -> Column:
    """File-safe name of a repository: text after the first colon, one ``.git`` dropped.

    A url without a colon gives the empty string.
    """
    after_colon = F.regexp_extract(url, r"(?s)\A[^:]*:(.*)\z", 1)
    return F.translate(F.regexp_replace(after_colon, r"\.git\z", ""), "/", "_")


def report_file(server: Column, version: Column | None = None) -> Column:
    """Report file name, with the version in it when one is given."""
    if version is None:
        return F.concat(server, F.lit("_.csv"))
    return F.concat(server, F.lit("_" + PKG_INFO_SEPARATOR), F.translate(version, "/", "_"), F.lit(".csv"))


def pkg_path(pkg_info: Column) -> Column:
    """Package paths of ``path@@@name`` entries; order and repeats stay."""
    return F.transform(pkg_info, lambda entry: F.substring_index(entry, PKG_INFO_SEPARATOR, 1))


def strip_position(position: Column) -> Column:
    """Drop the first three path pieces (the checkout folder); NULL when there are fewer."""
    below_checkout = r"(?s)\A[^/]*/[^/]*/[^/]*/(.*)\z"
    return F.when(position.rlike(below_checkout), F.regexp_extract(position, below_checkout, 1))


def repo_base_url(url: Column) -> Column:
    """The url without its last four characters (``.git``)."""
    return F.substr(url, F.lit(1), F.greatest(F.length(url) - 4, F.lit(0)))


def repo_name(url: Column, compat: bool = False) -> Column:
    """``owner/repo`` of a clone url, NULL when the url is too short.

    ``compat`` repeats the four-character cut, so the name loses its own last four letters.
    """
    base = repo_base_url(url)
    if compat:
        base = repo_base_url(base)
    pieces = F.split(base, "/")
    return F.when(F.size(pieces) >= 5, F.array_join(F.slice(pieces, 4, 2), "/"))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def tag_timestamp(text: Column) -> Column:
    """Parsed first line of a commit date; NULL when it is no date."""
    return F.try_to_timestamp(first_line(text))


def bool_text(flag: Column) -> Column:
    return flag.cast("string")


def obj_pkg_path(obj_pkg: Column) -> Column:
    """Path inside a printed package such as ``package core ("example.com/m/core")``."""
    return F.regexp_extract(obj_pkg, r'\("(.*)"\)', 1)
