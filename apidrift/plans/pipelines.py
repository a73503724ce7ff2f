"""The end-to-end queries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from apidrift.functions.text import obj_pkg_path
from apidrift.functions.versions import is_minor_or_patch
from apidrift.functions.wording import is_exported
from apidrift.operators import correspondence, diff, filters, graph, messages, record, releases, satisfaction, types, usage
from apidrift.operators.diff import SCOPE
from apidrift.session import materialize
from apidrift.sources.readers import Snapshot

# How a method is printed in a change and in an identifier; both give its receiver's type.
METHOD_NODE = r"^\(?\*?([^.()*]+)\)?\."
METHOD_STRING = r"^func \(\*?(?:[^()]*[./])?([^.()]+)\)\."


@dataclass
class Comparison:
    """Release pairs and their packages. ``packages`` is small next to the API tables and read many times,
    so it is written once. ``parts`` is the number of partitions that the API tables are dealt over by release, where they are."""

    pairs: DataFrame
    packages: DataFrame
    parts: int | None = None
    _trees: DataFrame | None = None

    @property
    def pair_parts(self) -> int | None:
        """Partitions for the rows of pairs: a release is on two sides at most."""
        return self.parts and 2 * self.parts

    def trees(self, snapshot: Snapshot) -> DataFrame | None:
        """Type trees of the compared packages, written once; None where the snapshot has none."""
        if self._trees is None and snapshot.api_type_node is not None:
            self._trees = materialize(self.scoped(snapshot.api_type_node), "nodes")
        return self._trees

    def aligned_trees(self, snapshot: Snapshot) -> DataFrame | None:
        """The same trees side by side, written once; from those written, where they are."""
        if snapshot.api_type_node is None:
            return None
        nodes = self.scoped(snapshot.api_type_node) if self._trees is None else self._trees
        return materialize(correspondence.align_trees(nodes, parts=self.pair_parts), "aligned-nodes", in_place=True)

    def by_pair(self, rows: DataFrame) -> DataFrame:
        """Rows dealt by pair, where their tables are dealt by release: once for all joins and groupings that follow."""
        return rows.repartition(self.pair_parts, "pair_id") if self.parts else rows

    def scoped(self, table: DataFrame) -> DataFrame:
        """Rows of ``table`` in packages that both sides have, keyed by pair, package name and ``side``.

        Rows dealt by release stay where they are: the sides come to them.
        """
        side = F.explode(
            F.array(
                F.struct(F.lit("old").alias("side"), F.col("old_rel").alias("rel_id"), F.col("old_pkg_path").alias("pkg_path")),
                F.struct(F.lit("new").alias("side"), F.col("new_rel").alias("rel_id"), F.col("new_pkg_path").alias("pkg_path")),
            )
        )
        sides = self.packages.filter("status = 'both'").select(*SCOPE, side.alias("s")).select(*SCOPE, "s.*")
        if self.parts:
            sides = sides.repartition(self.parts, "rel_id")
        return table.join(sides, ["rel_id", "pkg_path"]).drop("rel_id", "pkg_path", "module", "tag", "rel_part")


def count_packages(
    snapshot: Snapshot, candidates: DataFrame, white_list: Sequence[str] = filters.WHITE_LIST
) -> tuple[DataFrame, DataFrame]:
    """Releases that loaded whole, with their package counts, and the packages by name (``kept`` or not).

    One pass over the packages tells how many there are, how many the white list keeps, and whether all
    of them loaded.
    """
    listed = filters.is_white_listed(F.col("pkg_path"), list(white_list))
    packages = materialize(diff.packages_by_name(snapshot.package).withColumn("kept", ~listed), "packages")
    per_release = packages.groupBy("rel_id").agg(
        F.count(F.lit(1)).alias("n_packages"), F.count_if("kept").alias("n_kept"), F.max("n_errors").alias("n_errors")
    )
    counted = candidates.join(per_release, "rel_id", "left").fillna(0, ["n_packages", "n_kept", "n_errors"])
    return counted.filter("n_errors = 0").drop("n_errors"), packages


def match_packages(pairs: DataFrame, packages: DataFrame, parts: int | None = None) -> Comparison:
    """Packages of both sides of every pair, white-listed ones left out."""
    pairs = materialize(pairs, "pairs")
    matched = diff.diff_packages(pairs, packages.filter("kept")).join(pairs, "pair_id")
    return Comparison(pairs, materialize(matched, "packages"), parts)


def compare_releases(snapshot: Snapshot, white_list: Sequence[str] = filters.WHITE_LIST, compat: bool = False) -> Comparison:
    """Pair the releases and match their packages by name."""
    valid = releases.valid_releases(releases.go_modules(snapshot.release), compat)
    counted, packages = count_packages(snapshot, valid, white_list)
    pairs = releases.adjacent_releases(counted)
    if compat:
        pairs = releases.with_raw_old_label(pairs, snapshot.release)
    return match_packages(pairs, packages, snapshot.parts)


def api_changes(
    snapshot: Snapshot, comparison: Comparison, renames: bool | None = None, compat: bool = False
) -> DataFrame:
    """Every change of every compared package, compatible ones included, in reported form.

    ``renames`` follows types through the exported API, under new names and unexported ones alike. It needs the type
    trees and is on where the snapshot has them.
    """
    if renames is None:
        renames = snapshot.api_type_node is not None
    if renames and snapshot.api_type_node is None:
        raise ValueError("following renamed types needs a snapshot with type trees")
    objects = comparison.scoped(snapshot.api_object)
    if renames:
        # Read for the names and again for the rules, and far smaller than what it takes to derive.
        objects = materialize(objects.filter("exported"), "objects", in_place=True)
    named = comparison.scoped(snapshot.api_type)
    fields = comparison.scoped(snapshot.api_field)
    methods = comparison.scoped(snapshot.api_method)
    if compat:
        # Rows of pairs with unknown types are dropped at the end.
        comparison.trees(snapshot)
    rename_map = None
    aligned_nodes = comparison.aligned_trees(snapshot)
    nodes = None if aligned_nodes is None else correspondence.sided_trees(aligned_nodes)
    if renames:
        shared = diff.diff_objects(objects).filter("in_old and in_new")
        # An alias is met like a variable of the type behind it.
        kinds = {side: F.col(f"{side}_obj_kind") for side in ("old", "new")}
        if "old_is_alias" in shared.columns:
            alias = F.coalesce("old_is_alias", F.lit(False)) | F.coalesce("new_is_alias", F.lit(False))
            kinds = {side: F.when((kind == "type") & alias, "alias").otherwise(kind) for side, kind in kinds.items()}
        # Every walk through the types starts from them.
        names = materialize(shared.select(*SCOPE, "obj_name", *[kind.alias(f"{side}_kind") for side, kind in kinds.items()]), "names")
        rename_map = materialize(correspondence.establish_correspondence(names, nodes, SCOPE, aligned_nodes), "rename-map")
        named = types.with_basic_targets(named, rename_map)
        named = types.under_old_names(comparison.by_pair(named), rename_map, SCOPE, "type_name")
        methods = types.under_old_names(comparison.by_pair(methods), rename_map, SCOPE)
        fields = types.under_old_names(comparison.by_pair(fields), rename_map, SCOPE)
        # Only trees under a name that moved are aligned anew.
        moved = types.moved_names(rename_map, SCOPE)
        again = correspondence.sided_trees(aligned_nodes.join(moved, [*SCOPE, "root"], "left_semi"))
        afresh = types.roots_under_old_names(again, rename_map, SCOPE)
        stays = aligned_nodes.join(moved, [*SCOPE, "root"], "left_anti")
        aligned_nodes = stays.unionByName(correspondence.align_trees(afresh))
    else:
        named = comparison.by_pair(named.filter(is_exported(F.col("type_name"))))
        methods, fields = comparison.by_pair(methods), comparison.by_pair(fields)
    if nodes is not None:
        outcome = materialize(correspondence.compare_trees(correspondence.with_differences(aligned_nodes, SCOPE, rename_map)), "outcome")
        objects = diff.with_comparison(objects, outcome, SCOPE, "obj_name")
        named = diff.with_comparison(named, outcome, SCOPE, "type_name")
        fields = diff.with_comparison(fields, outcome, SCOPE, "owner", "field_name")
        methods = diff.with_comparison(methods, outcome, SCOPE, "owner", "method_name")
    # Read by several rules or passes, and already cut to the compared packages.
    placed = () if comparison.parts else None
    aligned_types = materialize(types.align_types(named, near=placed), "types", in_place=True)
    fields = materialize(fields, "fields", in_place=True)
    methods = materialize(methods, "methods", in_place=True)
    structs = types.structs_on_both_sides(aligned_types)
    foreign = None
    if "embedded_pkg" in snapshot.api_field.columns:
        # Structs of other packages are looked up among all fields of the same release.
        foreign = diff.on_both_sides(comparison.pairs, snapshot.api_field).withColumnRenamed("pkg_path", "home")
    selectable = types.exported_selectable_fields(fields, [*SCOPE, "side"], structs, foreign)
    rows = messages.all_changes(
        [
            types.check_named_types(aligned_types),
            types.diff_fields(selectable),
            types.check_interfaces(aligned_types, methods),
            types.check_method_sets(aligned_types, methods),
            satisfaction.satisfaction_changes(satisfaction.no_longer_implements(aligned_types, methods, smallest_void=True)),
        ]
    )
    object_pairs = diff.diff_objects(objects)
    if renames:
        object_pairs = diff.with_mapped_types(object_pairs, rename_map, SCOPE)
    object_rows = diff.check_objects(object_pairs)
    if renames:
        # A removed type can also be one that no longer implements an interface.
        rows = messages.dedupe_messages(rows.unionByName(object_rows), SCOPE, compat)
    else:
        rows = messages.dedupe_messages(rows, SCOPE, compat).unionByName(object_rows)
    rows = rows.unionByName(diff.package_changes(comparison.packages))
    if compat and nodes is not None:
        failed = correspondence.unsupported_objects(comparison.trees(snapshot), SCOPE)
        rows = correspondence.drop_failed_pairs(rows, failed)
    changes = messages.as_changes(rows, SCOPE)
    return changes.join(comparison.packages.drop("status"), list(SCOPE))


def breaking_changes(
    snapshot: Snapshot,
    white_list: Sequence[str] = filters.WHITE_LIST,
    renames: bool | None = None,
    compat: bool = False,
) -> DataFrame:
    """Reportable breaking changes of all neighbouring releases."""
    comparison = compare_releases(snapshot, white_list, compat)
    return filters.reportable(api_changes(snapshot, comparison, renames, compat))


def failed_objects(snapshot: Snapshot, comparison: Comparison) -> DataFrame:
    """Objects of compared packages with types the rules do not know, with the facts of their pair."""
    nodes = comparison.trees(snapshot)
    if nodes is None:
        raise ValueError("telling failed objects needs a snapshot with type trees")
    return correspondence.failed_objects(nodes, SCOPE).join(comparison.packages.drop("status"), list(SCOPE))


class Outcome(NamedTuple):
    """Breaking changes and, beside them, the objects that could not be compared whole. The observations hold the counts of
    both once an action has run over them."""

    changes: DataFrame
    failures: DataFrame
    seen_changes: Observation
    seen_failures: Observation


def breaking_changes_and_failures(
    snapshot: Snapshot, white_list: Sequence[str] = filters.WHITE_LIST, renames: bool | None = None
) -> Outcome:
    """``breaking_changes`` with a second output; a pair with a failed object keeps its other rows.

    The counts are taken while the outputs are written, without a pass of their own.
    """
    comparison = compare_releases(snapshot, white_list)
    seen_changes, seen_failures = Observation("breaking_changes"), Observation("failed_objects")
    # First, as it writes the trees that both start from.
    failures = failed_objects(snapshot, comparison)
    changes = filters.reportable(api_changes(snapshot, comparison, renames))
    return Outcome(
        changes.observe(seen_changes, F.count(F.lit(1)).alias("n_changes")),
        failures.observe(seen_failures, F.count(F.lit(1)).alias("n_failed"), F.coalesce(F.sum("n_nodes"), F.lit(0)).alias("n_nodes")),
        seen_changes,
        seen_failures,
    )


def wanted_clients(client_versions: DataFrame, client_releases: DataFrame | None = None, client_packages: DataFrame | None = None) -> DataFrame:
    """Client versions that list packages, carry a module file (``client_releases``) and loaded whole."""
    wanted = filters.has_packages(client_versions)
    key = ["url", "version"]
    if client_releases is not None:
        wanted = wanted.join(releases.go_modules(client_releases).select(*key), key, "left_semi")
    if client_packages is not None:
        wanted = releases.complete_releases(wanted, client_packages, key)
    return wanted


def client_usage(
    identifiers: DataFrame, client_versions: DataFrame, client_releases: DataFrame | None = None, client_packages: DataFrame | None = None
) -> DataFrame:
    """Third-party identifiers of every wanted client version."""
    wanted = wanted_clients(client_versions, client_releases, client_packages)
    return usage.to_identifier_report(usage.third_party_usage(filters.drop_null_objects(identifiers), wanted))


def client_imports(
    imports: DataFrame, client_versions: DataFrame, client_releases: DataFrame | None = None, client_packages: DataFrame | None = None
) -> DataFrame:
    """The imported packages of every wanted client version, each once."""
    wanted = wanted_clients(client_versions, client_releases, client_packages).withColumnRenamed("url", "server_url")
    return usage.distinct_imports(imports.join(wanted, ["server_url", "version"], "left_semi"))


def dependency_graph(dependencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the module graph."""
    return graph.module_nodes(dependencies), graph.module_edges(dependencies)


def breaking_change_usage(changes: DataFrame, edges: DataFrame, used: DataFrame, compat: bool = False) -> DataFrame:
    """Which client identifiers a breaking change of a minor or patch update reaches.

    A deleted package reaches every identifier of the package; a changed method those with its receiver. Fields are
    known by name alone, as identifiers do not tell their struct.

    Identifiers are first cut to changed objects, then tied to the one library version the client requires,
    then to that version's changes. Every step is an equi-join in which one side is unique or nearly so;
    joining changes with clients first would multiply popular libraries by all their clients.
    """
    breaking = changes.filter(is_minor_or_patch(F.col("old_tag"), F.col("new_tag"), compat)).withColumns(
        {
            "obj_name": F.substring_index("change_node", ".", -1),
            "receiver": F.when(F.col("changed_object") == "func", F.regexp_extract("change_node", METHOD_NODE, 1)).otherwise(""),
        }
    )
    target = ["obj_pkg_path", "obj_name", "receiver"]
    breaking = breaking.select(
        F.col("module").alias("library"),
        "old_tag",
        "new_tag",
        F.col("old_pkg_path").alias("obj_pkg_path"),
        "obj_name",
        "receiver",
        "change_node",
        "change_message",
    )
    # Read several times below, and far smaller than what it takes to compute.
    breaking = materialize(breaking, "breaking")
    idents = used.select(
        F.col("server_url").alias("client"),
        F.col("version").alias("client_version"),
        "id_pos",
        "obj_name",
        obj_pkg_path(F.col("obj_pkg")).alias("obj_pkg_path"),
        F.regexp_extract("obj_string", METHOD_STRING, 1).alias("receiver"),
    ).filter("obj_pkg_path != ''")
    required = edges.filter(~F.col("indirect")).select(
        F.col("from_name").alias("client"),
        F.col("from_version").alias("client_version"),
        F.col("to_name").alias("library"),
        F.col("to_version").alias("old_tag"),
    )
    columns = [
        "library", "old_tag", "new_tag", "obj_pkg_path", "obj_name", "change_node", "change_message",
        "client", "client_version", "id_pos",
    ]

    def reached(part: DataFrame, on: list[str]) -> DataFrame:
        """Identifiers that the changes in ``part`` reach, matched by ``on``."""
        part = part.drop(*[c for c in target if c not in on])
        return (
            idents.join(part.select("library", *on).distinct(), on)
            .join(required, ["client", "client_version", "library"])
            .join(part, ["library", "old_tag", *on])
            .select(*columns)
        )

    objects, packages = breaking.filter("change_node != ''"), breaking.filter("change_node = ''")
    return reached(objects, target).unionByName(reached(packages, ["obj_pkg_path"]))


def minor_patch_breaks(report: DataFrame, compat: bool = False) -> DataFrame:
    """Breaking changes of a change report that arrive in minor or patch updates, by the version left behind."""
    return record.changes_by_old_version(report, compat)
