"""One query per operator, over the stand-in views of a table folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apidrift.functions import text, versions, wording
from apidrift.operators import correspondence, diff, filters, graph, messages, record, releases, satisfaction, types, usage
from apidrift.plans import pipelines
from apidrift.session import fresh_path, materialize
from apidrift.sources import readers, writers
from apidrift.sources.batches import BatchStore
from apidrift.sources.readers import Snapshot
from apidrift.sources.standin import StandIn
from apidrift.streaming import client_watch, release_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PAIR = ["pair_id"]
PACKAGE = ["rel_id", "pkg_path"]
CHANGE_FACTS = ["module", "update_kind", "changed_object", "changed_type"]
CHANGE_SETS = [CHANGE_FACTS[:2], CHANGE_FACTS[:1], CHANGE_FACTS[1:], CHANGE_FACTS[1:2], CHANGE_FACTS[2:], []]


class Bench:
    """Inputs that several queries share."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.views = StandIn(spark, sf_dir)

    @cached_property
    def compared(self) -> DataFrame:
        """Valid releases of modules with their package counts."""
        kept = releases.valid_releases(releases.go_modules(self.views.release))
        return releases.with_package_counts(kept, self.views.package, parts=self.views.release_partitions)

    @cached_property
    def pairs(self) -> DataFrame:
        """Written once: small next to the API tables, which are joined with them table by table."""
        return materialize(releases.adjacent_releases(self.compared), "pairs")

    @property
    def parts(self) -> int:
        """Partitions for the rows of pairs: a release is on two sides at most, and each of its rows comes from a line item."""
        return 2 * self.views.partitions

    def sided(self, table: DataFrame) -> DataFrame:
        return diff.on_both_sides(self.pairs, table)

    @cached_property
    def packages(self) -> DataFrame:
        return diff.packages_by_name(self.views.package)

    @cached_property
    def objects(self) -> DataFrame:
        """Dealt by pair, which serves the choice between messages and the facts of the pair as well."""
        return diff.diff_objects(self.sided(self.views.api_object), [*PAIR, "pkg_path"], PAIR, self.parts)

    @cached_property
    def object_rows(self) -> DataFrame:
        return diff.check_objects(self.objects, [*PAIR, "pkg_path"])

    @cached_property
    def object_changes(self) -> DataFrame:
        """Object-level changes with the facts of their pair, in the form of a report."""
        scope = [*PAIR, "pkg_path"]
        changes = messages.as_changes(messages.dedupe_messages(self.object_rows, scope), scope)
        named = changes.withColumns({"old_pkg_name": F.lit("p"), "new_pkg_name": F.lit("p"), "old_pkg_path": F.col("pkg_path"), "new_pkg_path": F.col("pkg_path")})
        return named.join(self.pairs, "pair_id")

    @cached_property
    def types(self) -> DataFrame:
        return types.align_types(self.sided(self.views.api_type), PAIR, self.parts)

    @cached_property
    def methods(self) -> DataFrame:
        return self.sided(self.views.api_method)

    @cached_property
    def nodes(self) -> DataFrame:
        return self.sided(self.views.api_type_node)

    @cached_property
    def edges(self) -> DataFrame:
        return graph.module_edges(self.views.dependency)

    @cached_property
    def snapshot(self) -> Snapshot:
        """The stand-in API per package, type trees included. Named types are objects of their package as well."""
        views = self.views
        named = views.api_types(PACKAGE)
        type_objects = named.select(
            *PACKAGE, F.col("type_name").alias("obj_name"), F.lit(True).alias("exported"), F.lit("type").alias("obj_kind"),
            F.concat(F.lit("named|"), "underlying_kind").alias("type_kind"), F.col("type_name").alias("type_str"),
            F.col("type_name").alias("corr_key"), F.lit("").alias("const_val"), F.lit(False).alias("const_known"), F.lit(False).alias("is_alias"),
        )
        objects = views.api_object.unionByName(type_objects)
        fields, methods = views.api_fields(PACKAGE), views.received_methods(PACKAGE)
        return Snapshot(views.release, views.package, objects, named, fields, methods, views.api_type_node, views.partitions)

    def stored_snapshot(self, partitioned: bool = False) -> Snapshot:
        """The same, written as a snapshot and read back."""
        path = fresh_path(self.spark, "snapshot")
        writers.write_api_snapshot(self.snapshot, path, partitioned)
        return readers.read_api_snapshot(self.spark, path)

    @cached_property
    def breaking(self) -> DataFrame:
        return pipelines.breaking_changes(self.snapshot)

    @cached_property
    def report(self) -> DataFrame:
        """Their change report, stored and read back."""
        path = fresh_path(self.spark, "report")
        writers.write_change_report(self.breaking, path)
        return readers.read_change_report(self.spark, path)


def query(build: Callable[[Bench], DataFrame]) -> Callable[[Bench], DataFrame]:
    """Register ``build`` under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Bench(spark, sf_dir))

    QUERIES[build.__name__] = run
    return build


def _joined(array: str, separator: str = "/") -> F.Column:
    return F.array_join(array, separator)


# --- sources and sinks -------------------------------------------------------------------------------


@query
def read_repo_tasks(b: Bench) -> DataFrame:
    path = fresh_path(b.spark, "repo-tasks")
    item = F.struct(
        F.col("c_custkey").alias("index"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("/repo")).alias("full_name"),
        F.lit("").alias("url"),
        F.col("c_nationkey").cast("bigint").alias("star"),
    )
    b.views.table("customer").select(F.lit(1).alias("total_count"), F.array(item).alias("items")).write.json(path)
    return readers.read_repo_tasks(b.spark, path, lines=True)


@query
def read_client_tasks(b: Bench) -> DataFrame:
    path = fresh_path(b.spark, "client-tasks")
    detail = F.struct(F.col("version").alias("Version"), F.col("path").alias("Path"), F.col("pkg_info").alias("PkgInfo"))
    item = F.struct(F.col("url").alias("Url"), F.array(detail).alias("Detail"))
    b.views.client_version.select(F.lit(1).alias("total_count"), F.array(item).alias("items")).write.json(path)
    tasks = readers.read_client_tasks(b.spark, path, lines=True)
    return tasks.withColumn("pkg_info", _joined("pkg_info", ";"))


@query
def read_white_list(b: Bench) -> DataFrame:
    path = fresh_path(b.spark, "white-list")
    names = b.views.package.select("pkg_name").distinct()
    # Every other line empty, and carriage returns on some.
    lines = names.select(F.explode(F.array(F.lit(""), F.concat("pkg_name", F.lit("\r")))).alias("value"))
    lines.write.text(path)
    return readers.read_white_list(b.spark, path)


@query
def read_dependencies(b: Bench) -> DataFrame:
    path = fresh_path(b.spark, "dependencies")
    b.views.dependency.write.option("header", True).csv(path)
    return readers.read_dependencies(b.spark, path)


@query
def read_change_report(b: Bench) -> DataFrame:
    path = fresh_path(b.spark, "change-report")
    writers.write_change_report(filters.reportable(b.object_changes), path)
    return readers.read_change_report(b.spark, path)


@query
def write_change_report(b: Bench) -> DataFrame:
    """Two batches, one of them written again."""
    path = fresh_path(b.spark, "change-report")
    # Every batch is a part of them.
    changes = materialize(filters.reportable(b.object_changes), "changes")
    for batch in (0, 1, 1):
        writers.write_change_report(changes.filter(F.col("pair_id") % 2 == batch), path, batch)
    return _stored_csv(b, path).select(*readers.CHANGE_REPORT_COLUMNS)


def _stored_csv(b: Bench, path: str, columns: Sequence[str] = (), missing: str | None = "") -> DataFrame:
    """Rows of a store, missing values as ``missing``; without rows an empty table of ``columns``."""
    paths = BatchStore(b.spark, path).paths()
    if not paths and columns:
        return b.spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    reader = b.spark.read.option("header", True).option("escape", '"').option("basePath", f"{path}/rows")
    rows = reader.csv(paths).drop("attempt", "bucket")
    return rows if missing is None else rows.fillna(missing)


def _cloned(df: DataFrame) -> DataFrame:
    """Rows under the clone url of their module."""
    return df.withColumn("server_url", F.concat(F.lit("https://"), "server_url", F.lit(".git")))


def _written_usage(b: Bench) -> str:
    path = fresh_path(b.spark, "usage")
    report = usage.to_identifier_report(filters.drop_null_objects(_cloned(b.views.identifier)))
    writers.write_identifier_usage(report, path, "all")
    return f"{path}/pkgInfo"


def _written_imports(b: Bench) -> str:
    path = fresh_path(b.spark, "imports")
    writers.write_imports(_cloned(usage.distinct_imports(_imports(b))), path, "all")
    return f"{path}/importPkg"


@query
def read_identifier_usage(b: Bench) -> DataFrame:
    return readers.read_identifier_usage(b.spark, _written_usage(b))


@query
def write_identifier_usage(b: Bench) -> DataFrame:
    return _stored_csv(b, _written_usage(b))


@query
def read_imports(b: Bench) -> DataFrame:
    return readers.read_imports(b.spark, _written_imports(b))


@query
def write_imports(b: Bench) -> DataFrame:
    return _stored_csv(b, _written_imports(b))


@query
def read_api_snapshot(b: Bench) -> DataFrame:
    """Every table of the snapshot, a row as its name and one fact."""
    stored = b.stored_snapshot()
    dotted = lambda *names: F.concat_ws(".", *names)
    facts = {
        "release": (F.lit(""), F.col("tag"), F.col("server_url")),
        "package": (F.col("pkg_path"), F.col("pkg_name"), F.col("n_errors")),
        "api_object": (F.col("pkg_path"), F.col("obj_name"), dotted("obj_kind", "type_str", "const_val")),
        "api_type": (F.col("pkg_path"), F.col("type_name"), dotted("underlying_kind", "underlying_str")),
        "api_field": (F.col("pkg_path"), dotted("owner", "field_name"), F.col("type_str")),
        "api_method": (F.col("pkg_path"), dotted("owner", "method_name"), dotted("recv_kind", "sig_str")),
        "api_type_node": (F.col("pkg_path"), dotted("root", _joined(F.col("path").cast("array<string>"))), dotted("node_kind", "label")),
    }
    tables = [
        getattr(stored, table).select(F.lit(table).alias("table_name"), "rel_id", where.alias("pkg_path"), name.alias("name"), fact.cast("string").alias("fact"))
        for table, (where, name, fact) in facts.items()
    ]
    return reduce(DataFrame.unionByName, tables)


@query
def upsert_module_graph(b: Bench) -> DataFrame:
    direct = b.views.dependency.filter(~F.col("require_module_indirect"))
    nodes, edges = graph.upsert_module_graph(direct)
    nodes, edges = graph.upsert_module_graph(b.views.dependency, nodes, edges)
    return _graph_rows(nodes, edges)


@query
def append_module_graph(b: Bench) -> DataFrame:
    """The same graph as batches of new keys, the last one written again."""
    path = fresh_path(b.spark, "graph")
    writers.append_module_graph(b.views.dependency.filter(~F.col("require_module_indirect")), path, 0)
    for _ in range(2):
        writers.append_module_graph(b.views.dependency, path, 1)
    return _graph_rows(*readers.read_module_graph(b.spark, path))


def _graph_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    blank = F.lit("")
    flat_nodes = nodes.select(F.lit("node").alias("kind"), F.col("name").alias("from_name"), F.col("version").alias("from_version"), blank.alias("to_name"), blank.alias("to_version"), blank.alias("indirect"))
    flat_edges = edges.select(F.lit("edge").alias("kind"), "from_name", "from_version", "to_name", "to_version", F.col("indirect").cast("string").alias("indirect"))
    return flat_nodes.unionByName(flat_edges)


def _imports(b: Bench) -> DataFrame:
    return b.views.dependency.select(
        F.col("module_name").alias("server_url"),
        F.col("tag").alias("version"),
        F.concat("require_module_name", F.lit("/core")).alias("pkg_path"),
        F.col("require_module_version").alias("pkg_name"),
    )


# --- scalar functions --------------------------------------------------------------------------------


@query
def repo_url(b: Bench) -> DataFrame:
    name = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("/repo"))
    return b.views.table("customer").select("c_custkey", text.repo_url(name).alias("url"))


@query
def server_name(b: Bench) -> DataFrame:
    url = text.server_name(F.col("server_url")).alias("server_name")
    return b.views.release.select("rel_id", url, text.server_name(F.col("module")).alias("without_colon"))


@query
def report_file(b: Bench) -> DataFrame:
    server = text.server_name(F.col("server_url"))
    version = F.concat(F.lit("release/"), "tag")
    return b.views.release.select(
        "rel_id", text.report_file(server).alias("change_file"), text.report_file(server, version).alias("usage_file")
    )


@query
def pkg_path(b: Bench) -> DataFrame:
    paths = F.array_join(text.pkg_path(F.col("pkg_info")), ";").alias("pkg_paths")
    return b.views.client_version.select("url", "version", paths)


@query
def strip_position(b: Bench) -> DataFrame:
    return b.views.identifier.select(
        "id_pos", text.strip_position(F.col("id_pos")).alias("inside"), text.strip_position(F.col("obj_name")).alias("short")
    )


@query
def repo_name_and_url(b: Bench) -> DataFrame:
    url = F.col("server_url")
    return b.views.release.select(
        "rel_id",
        text.repo_base_url(url).alias("url"),
        text.repo_name(url).alias("name"),
        text.repo_name(url, compat=True).alias("compat_name"),
    )


@query
def strip_v(b: Bench) -> DataFrame:
    return b.views.release.select("rel_id", versions.strip_v(F.col("tag")).alias("stripped"))


@query
def is_valid_semver(b: Bench) -> DataFrame:
    tag = F.col("tag")
    doubled = F.concat(F.lit("v"), tag)
    return b.views.release.select(
        "rel_id",
        versions.is_valid_semver(tag).alias("valid"),
        versions.is_valid_semver(tag, compat=True).alias("valid_compat"),
        versions.is_valid_semver(doubled, compat=True).alias("valid_doubled"),
    )


@query
def version_sort_key(b: Bench) -> DataFrame:
    return b.views.release.select("rel_id", F.array_join(versions.version_sort_key(F.col("tag")), "/").alias("sort_key"))


@query
def parse_version(b: Bench) -> DataFrame:
    v = versions.parse_version(F.col("tag"))
    segments = F.array_join(v["segments"].cast("array<string>"), ".")
    return b.views.release.select("rel_id", segments.alias("segments"), v["prerelease"].alias("prerelease"), v["metadata"].alias("metadata"))


@query
def is_minor_or_patch(b: Bench) -> DataFrame:
    old, new = F.col("old_tag"), F.col("new_tag")
    return b.pairs.select(
        "pair_id",
        versions.is_minor_or_patch(old, new).alias("forward"),
        versions.is_minor_or_patch(new, old, compat=True).alias("reverse_compat"),
        versions.update_kind(old, new).alias("kind"),
        versions.update_kind(new, old).alias("reverse_kind"),
    )


@query
def is_exported(b: Bench) -> DataFrame:
    return b.views.api_object.select(*PACKAGE, "obj_name", wording.is_exported(F.col("obj_name")).alias("by_name"))


@query
def object_kind(b: Bench) -> DataFrame:
    known, unknown = wording.object_kind(F.col("obj_kind")), wording.object_kind(F.col("obj_name"))
    return b.views.api_object.select(*PACKAGE, "obj_name", known.alias("kind"), unknown.alias("unknown"))


@query
def type_kind(b: Bench) -> DataFrame:
    chain = F.array(F.lit("pointer"), F.lit("named"), F.col("underlying_kind"))
    return b.views.api_type.select("rel_id", "type_name", wording.type_kind(chain).alias("kind"))


@query
def change_message(b: Bench) -> DataFrame:
    cause = F.when(F.col("old_obj_kind") == "func", "params").otherwise("")
    both = b.objects.filter("in_old and in_new")
    return both.select(
        "pair_id", "pkg_path", "obj_name",
        wording.change_message(cause, F.col("old_type_str"), F.col("new_type_str")).alias("message"),
    )


@query
def drop_param_names(b: Bench) -> DataFrame:
    params = F.array(F.concat(F.lit("T"), (F.col("ln") % 3).cast("string")), F.concat(F.lit("[]T"), (F.col("s") % 3).cast("string")))
    results = F.slice(F.array(F.lit("string"), F.lit("error")), F.lit(1), (F.col("p") % 3).cast("int"))
    return b.views.line.select(
        "rel_id", "p", "s", "ln", wording.signature_text(params, results, F.col("p") % 2 == 0).alias("signature")
    )


@query
def object_node(b: Bench) -> DataFrame:
    node = wording.object_node(F.col("method_name"), F.col("owner"), F.col("ptr_receiver"))
    bare = wording.object_node(F.col("method_name"), F.lit(""), F.col("ptr_receiver"))
    return b.views.api_methods(["rel_id"]).select("rel_id", "owner", "method_name", node.alias("node"), bare.alias("bare"))


@query
def dot_join(b: Bench) -> DataFrame:
    right = F.when(F.col("exported"), F.col("field_name")).otherwise("")
    left = F.when(F.col("embedded"), "").otherwise(F.col("owner"))
    return b.views.api_field.select("rel_id", "owner", "field_name", wording.dot_join(left, right).alias("joined"))


@query
def change_node_and_text(b: Bench) -> DataFrame:
    part, owner = F.when(F.col("in_old"), F.lit(", struct method")).otherwise(F.col("obj_name")), F.col("pkg_path")
    return b.objects.select(
        "pair_id", "pkg_path", "obj_name",
        wording.change_node(owner, part).alias("node"),
        wording.change_text(part, F.lit("changed")).alias("text"),
    )


@query
def what_changed(b: Bench) -> DataFrame:
    checks = {
        "basic": F.col("old_basic_name") == F.col("new_basic_name"),
        "direction": F.col("old_chan_dir") == F.col("new_chan_dir"),
        "comparable": F.col("old_comparable") == F.col("new_comparable"),
    }
    return b.types.select("pair_id", "owner", wording.what_changed(checks).alias("changed"))


@query
def first_line(b: Bench) -> DataFrame:
    lines = F.concat("tag_time", F.lit("\n"), "tag")
    return b.views.release.select(
        "rel_id",
        text.first_line(lines).alias("first"),
        F.date_format(text.tag_timestamp(lines), "yyyy-MM-dd").alias("day"),
        text.tag_timestamp(F.col("tag")).isNull().alias("no_date"),
    )


@query
def bool_text(b: Bench) -> DataFrame:
    return b.views.release.select("rel_id", text.bool_text(F.col("has_go_mod")).alias("flag"))


@query
def obj_pkg_path(b: Bench) -> DataFrame:
    return b.views.identifier.select("server_url", "version", "id_pos", text.obj_pkg_path(F.col("obj_pkg")).alias("path"))


# --- filters -----------------------------------------------------------------------------------------


@query
def drop_white_listed(b: Bench) -> DataFrame:
    return filters.drop_white_listed(b.views.package, list(filters.WHITE_LIST)).select("rel_id", "pkg_name", "pkg_path")


@query
def drop_white_listed_by_table(b: Bench) -> DataFrame:
    entries = b.views.release.filter("not has_go_mod").select(F.concat(F.substring_index(F.substring_index("module", "/", 2), "/", -1), F.lit("/repo/c")).alias("entry"))
    return filters.drop_white_listed(b.views.package, entries).select("rel_id", "pkg_name", "pkg_path")


@query
def drop_blank(b: Bench) -> DataFrame:
    return filters.drop_blank(b.views.dependency, "tag").select("module_name", "tag", "require_module_name")


@query
def touches_third_party(b: Bench) -> DataFrame:
    paths = b.views.client_version.select(F.col("url").alias("server_url"), "version", text.pkg_path(F.col("pkg_info")).alias("paths"))
    joined = b.views.identifier.join(paths, ["server_url", "version"])
    touched = usage.touches_third_party(F.col("obj_string"), F.col("paths"))
    strict = usage.segment_match(F.col("obj_string"), F.col("paths"))
    return joined.select("server_url", "version", "id_pos", "obj_string", touched.alias("touched"), strict.alias("strict"))


@query
def drop_null_objects(b: Bench) -> DataFrame:
    with_nulls = b.views.identifier.withColumn("obj_string", F.when(F.col("obj_pkg").isNotNull(), F.col("obj_string")))
    return filters.drop_null_objects(with_nulls).select("server_url", "version", "id_pos", "obj_string")


@query
def drop_unversioned(b: Bench) -> DataFrame:
    return filters.drop_unversioned(b.views.dependency).drop("go_version", "tag_time")


@query
def reportable(b: Bench) -> DataFrame:
    return filters.reportable(b.object_changes).select("pair_id", "pkg_path", "change_node", "change_message")


@query
def complete_releases(b: Bench) -> DataFrame:
    return releases.complete_releases(b.views.release, b.views.package).select("rel_id", "module", "tag")


@query
def enough_tags(b: Bench) -> DataFrame:
    valid = releases.valid_releases(b.views.release)
    return releases.enough_tags(valid).select("rel_id", "module", "tag")


@query
def is_go_module(b: Bench) -> DataFrame:
    return releases.go_modules(b.views.release).select("rel_id", "module", "tag")


@query
def has_packages(b: Bench) -> DataFrame:
    kept = b.views.client_version.withColumn("pkg_info", F.filter("pkg_info", lambda p: F.contains(p, F.lit("c1"))))
    return filters.has_packages(kept).select("url", "version", F.size("pkg_info").alias("n_packages"))


@query
def non_empty_reports(b: Bench) -> DataFrame:
    path = fresh_path(b.spark, "reports")
    writers.write_change_report(filters.reportable(b.object_changes), path)
    return _stored_csv(b, path, readers.CHANGE_REPORT_COLUMNS, missing=None).select("server_name").distinct()


@query
def compatible_messages(b: Bench) -> DataFrame:
    return filters.messages(b.object_changes, True).select("pair_id", "pkg_path", "change_node", "change_message")


# --- joins -------------------------------------------------------------------------------------------


@query
def diff_packages(b: Bench) -> DataFrame:
    matched = diff.diff_packages(b.pairs, b.packages, b.parts)
    rows = messages.as_changes(diff.package_changes(matched, [*diff.SCOPE, "old_pkg_path", "new_pkg_path"]), [*diff.SCOPE, "old_pkg_path", "new_pkg_path"])
    return rows.select(*diff.SCOPE, "old_pkg_path", "new_pkg_path", "compatible", "change_message")


@query
def diff_objects(b: Bench) -> DataFrame:
    status = F.when(~F.col("in_new"), "removed").when(~F.col("in_old"), "added").otherwise("both")
    return b.objects.select("pair_id", "pkg_path", "obj_name", status.alias("status"), "old_obj_kind", "new_obj_kind")


@query
def diff_fields(b: Bench) -> DataFrame:
    fields = types.exported_fields(b.sided(b.views.api_field))
    return messages.as_changes(types.diff_fields(fields, PAIR, b.parts), PAIR)


@query
def diff_methods(b: Bench) -> DataFrame:
    return _row_columns(types.diff_methods(b.methods, PAIR, parts=b.parts))


def _row_columns(rows: DataFrame) -> DataFrame:
    return rows.select(*PAIR, "obj_key", "node", "object_kind", "part", "changed_type", "message", "compatible").distinct()


@query
def downstream_clients(b: Bench) -> DataFrame:
    targets = b.views.release.select(F.col("module").alias("name"), F.col("tag").alias("version"))
    nodes = graph.with_urls(graph.module_nodes(b.views.dependency), b.views.release)
    return graph.downstream_clients(nodes, b.edges, targets)


@query
def no_longer_implements(b: Bench) -> DataFrame:
    return satisfaction.no_longer_implements(materialize(b.types, "types"), materialize(b.methods, "methods"), PAIR)


@query
def basic_widening(b: Bench) -> DataFrame:
    both = b.types.filter("old_underlying_kind = 'basic' and new_underlying_kind = 'basic'")
    return types.basic_widening(both).select("pair_id", "owner", "old_basic_name", "new_basic_name", "widening")


@query
def third_party_usage(b: Bench) -> DataFrame:
    found = usage.third_party_usage(b.views.identifier, b.views.client_version)
    return found.select("server_url", "version", "id_pos", "obj_string")


@query
def align_positions(b: Bench) -> DataFrame:
    nodes = correspondence.align_positions(b.nodes, [*PAIR, "pkg_path"], parts=b.parts)
    return nodes.select("pair_id", "pkg_path", "root", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "in_old", "in_new", "type_differs")


@query
def align_interface_methods(b: Bench) -> DataFrame:
    faces = b.views.api_type.filter("underlying_kind = 'interface'").select("rel_id", F.col("type_name").alias("owner"))
    return correspondence.align_interface_methods(b.sided(b.views.api_methods(["rel_id"]).join(faces, ["rel_id", "owner"])), PAIR)


@query
def find_correspondence(b: Bench) -> DataFrame:
    """Every embedded field as a use of the type it embeds; the mapping is the one by name."""
    embedded = b.sided(b.views.api_field.filter("embedded").select("rel_id", "owner", "field_name", "embedded_owner"))
    uses = diff.align(embedded, [*PAIR, "owner", "field_name"], ["embedded_owner"], matched=True)
    uses = uses.select(*PAIR, F.col("old_embedded_owner").alias("old_name"), F.lit("named").alias("new_kind"), F.col("new_embedded_owner").alias("new_name"), "owner", "field_name")
    known = b.types.select(*PAIR, F.col("owner").alias("old_name"), F.lit("named").alias("new_kind"), F.col("owner").alias("new_name"))
    return correspondence.find_correspondence(uses, known, PAIR)


@query
def find_correspondence_renamed(b: Bench) -> DataFrame:
    """The same uses under a mapping that moves most types to another name."""
    embedded = b.sided(b.views.api_field.filter("embedded").select("rel_id", "owner", "field_name", "embedded_owner"))
    uses = diff.align(embedded, [*PAIR, "owner", "field_name"], ["embedded_owner"], matched=True)
    uses = uses.select(*PAIR, F.col("old_embedded_owner").alias("old_name"), F.lit("named").alias("new_kind"), F.col("new_embedded_owner").alias("new_name"), "owner", "field_name")
    moved = F.concat(F.lit("Type"), (F.substring("owner", 5, 9).cast("int") + F.col("pair_id")) % 3)
    known = b.types.select(*PAIR, F.col("owner").alias("old_name"), F.lit("named").alias("new_kind"), moved.alias("new_name"))
    return correspondence.find_correspondence(uses, known, PAIR)


@query
def require_both(b: Bench) -> DataFrame:
    sided = b.sided(b.views.api_object.select("rel_id", "pkg_path", "obj_name"))
    old, new = sided.filter("side = 'old'"), sided.filter("side = 'new'")
    on = ["pair_id", "pkg_path", "obj_name"]
    kept = diff.also_in(old, new, on).select(*on, F.lit("both").alias("found"))
    return kept.unionByName(diff.only_in(old, new, on).select(*on, F.lit("old").alias("found")))


# --- aggregations ------------------------------------------------------------------------------------


@query
def packages_by_name(b: Bench) -> DataFrame:
    return b.packages.select("rel_id", "pkg_name", "pkg_path")


@query
def distinct_imports(b: Bench) -> DataFrame:
    return usage.distinct_imports(_imports(b))


@query
def module_nodes(b: Bench) -> DataFrame:
    return graph.module_nodes(b.views.dependency)


@query
def module_edges(b: Bench) -> DataFrame:
    return b.edges


@query
def changes_by_old_version(b: Bench) -> DataFrame:
    return record.changes_by_old_version(writers.to_change_report(filters.reportable(b.object_changes)))


@query
def record_chunks(b: Bench) -> DataFrame:
    long_form = record.changes_by_old_version(writers.to_change_report(filters.reportable(b.object_changes)))
    chunks = record.record_chunks(long_form, chunk_rows=3)
    first = F.get("details", 0)
    return chunks.select("name", "url", "version", "chunk", F.size("details").alias("n_details"), first["change_node"].alias("first_node"), first["change_message"].alias("first_message"))


@query
def dedupe_messages(b: Bench) -> DataFrame:
    """Object rows next to the type rows of the same names, so that parts collide."""
    named = types.check_named_types(b.types, PAIR)
    doubled = messages.all_changes([named, named.withColumns({"message": F.concat("message", F.lit("!")), "cause": F.lit("removed")})])
    return messages.dedupe_messages(doubled, PAIR).select(*PAIR, "obj_key", "part", "compatible", "message", "changed_type")


@query
def unambiguous_fields(b: Bench) -> DataFrame:
    level = b.views.api_field.select("rel_id", "owner", "field_name", "type_str", "embedded")
    level = level.withColumn("root", F.lit("all")).drop("owner")
    return types.unambiguous_fields(level, ["rel_id", "root"]).select("rel_id", "field_name", "type_str", "embedded")


@query
def exported_selectable_fields(b: Bench) -> DataFrame:
    return types.exported_selectable_fields(b.views.api_field, ["rel_id"]).select("rel_id", "owner", "field_name", "type_str", "depth")


@query
def render_report(b: Bench) -> DataFrame:
    return messages.report_lines(b.object_changes, ["pair_id", "pkg_path"])


@query
def is_comparable(b: Bench) -> DataFrame:
    fields = b.views.api_field.withColumn("comparable", F.col("type_str") != "T0")
    return types.is_comparable(fields, ["rel_id", "owner"])


@query
def has_unexported_method(b: Bench) -> DataFrame:
    return types.has_unexported_method(b.views.api_methods(["rel_id"]), ["rel_id"])


@query
def change_counts(b: Bench) -> DataFrame:
    kinds = filters.reportable(b.object_changes).withColumn("update_kind", versions.update_kind(F.col("old_tag"), F.col("new_tag")))
    return messages.change_counts(kinds, CHANGE_FACTS)


@query
def change_totals(b: Bench) -> DataFrame:
    """The same counts by module, by kind of update, object and change, and in all, in one pass."""
    kinds = filters.reportable(b.object_changes).withColumn("update_kind", versions.update_kind(F.col("old_tag"), F.col("new_tag")))
    return messages.change_totals(kinds, CHANGE_FACTS, CHANGE_SETS)


# --- windows, order and set operations ---------------------------------------------------------------


@query
def adjacent_releases(b: Bench) -> DataFrame:
    return b.pairs


@query
def adjacent_kept_releases(b: Bench) -> DataFrame:
    """The chain as a white list cuts it."""
    kept = filters.drop_white_listed(b.packages, list(filters.WHITE_LIST))
    valid = releases.valid_releases(releases.go_modules(b.views.release))
    return releases.adjacent_releases(releases.with_package_counts(valid, b.packages, kept)).select("pair_id", "old_rel", "old_tag", "new_tag")


@query
def previous_tag_label(b: Bench) -> DataFrame:
    return releases.with_raw_old_label(b.pairs, b.views.release, b.parts).select("pair_id", "old_tag", "new_tag")


@query
def order_tags(b: Bench) -> DataFrame:
    return releases.order_tags(b.views.release).select("rel_id", "module", "tag", "position")


@query
def order_changes(b: Bench) -> DataFrame:
    return messages.order_changes(b.object_changes, ["pair_id", "pkg_path"]).select("pair_id", "pkg_path", "compatible", "change_node", "change_message")


@query
def order_methods(b: Bench) -> DataFrame:
    """Place of every method among its owner's methods by id; an owner's methods come from one source file."""
    from apidrift.operators.ordered import numbered

    ids = b.views.api_methods(["rel_id"]).select("rel_id", "owner", correspondence.method_id(F.col("method_name"), F.lit("")).alias("method_id"))
    return numbered(ids, ["rel_id", "owner"], ["method_id"], "place")


@query
def all_changes(b: Bench) -> DataFrame:
    scope = [*PAIR, "pkg_path"]
    rows = b.object_rows
    sides = [filters.messages(rows, False), filters.messages(rows, True)]
    return messages.as_changes(messages.all_changes(sides), scope)


@query
def all_identifiers(b: Bench) -> DataFrame:
    rows = b.views.identifier
    both = usage.all_identifiers(rows.filter("var_type = 'defs'"), rows.filter("var_type = 'uses'"))
    return both.select("server_url", "version", "var_type", "id_pos")


@query
def added_or_removed(b: Bench) -> DataFrame:
    return diff.added_or_removed(b.objects).select("pair_id", "pkg_path", "obj_name", "in_old", "in_new")


# --- compatibility rules -----------------------------------------------------------------------------


@query
def check_objects(b: Bench) -> DataFrame:
    """Kinds, constants and types of objects."""
    return messages.as_changes(b.object_rows, [*PAIR, "pkg_path"])


@query
def check_named_types(b: Bench) -> DataFrame:
    """Underlying kinds, channels, basics and comparability."""
    return messages.as_changes(types.check_named_types(b.types, PAIR), PAIR)


@query
def check_structs(b: Bench) -> DataFrame:
    named, fields = materialize(b.types, "types"), materialize(b.sided(b.views.api_field), "fields")
    selectable = types.exported_selectable_fields(fields, [*PAIR, "side"], types.structs_on_both_sides(named, PAIR))
    return messages.as_changes(types.check_structs(named, selectable, PAIR), PAIR)


@query
def check_interfaces(b: Bench) -> DataFrame:
    return _row_columns(types.check_interfaces(b.types, b.methods, PAIR))


@query
def check_method_sets(b: Bench) -> DataFrame:
    return _row_columns(types.check_method_sets(b.types, b.methods, PAIR, b.parts))


@query
def check_promoted_method_sets(b: Bench) -> DataFrame:
    """Some methods come from an embedded type, one of them by pointer, so that the value set holds it as well."""
    promoted = F.col("method_name").isin("M1", "M3")
    methods = b.methods.withColumns(
        {
            "recv_is_owner": ~promoted,
            "recv_named": F.when(promoted, "Inner").otherwise(F.col("recv_named")),
            "in_value_set": F.col("in_value_set") | (F.col("method_name") == "M3"),
        }
    )
    return _row_columns(types.check_method_sets(b.types, methods, PAIR, b.parts))


@query
def compare_types(b: Bench) -> DataFrame:
    return correspondence.compare_types(b.nodes, [*PAIR, "pkg_path"]).drop("part")


def _shapes(fields: DataFrame) -> DataFrame:
    """A type tree of some kind per field: its kind goes by the names, its parts by the facts of the field."""
    number = F.substring("field_name", 2, 9).cast("int")
    kinds = ("array", "slice", "map", "pointer", "chan", "struct", "interface", "basic")
    code = (number * 3 + F.substring("owner", 5, 9).cast("int") + (F.col("embedded") & (F.col("type_str") == "T2")).cast("int")) % 8
    kind = F.get(F.array(*[F.lit(k) for k in kinds]), code)
    text, target, odd = F.col("type_str"), F.col("embedded_owner"), number % 2 == 1

    def node(path, kind, label="", length=None, variadic=False, name="", embedded=False, tag=""):
        as_column = lambda value, cast: (value if isinstance(value, F.Column) else F.lit(value)).cast(cast)
        return F.struct(
            F.array(*[F.lit(p) for p in path]).cast("array<int>").alias("path"), as_column(kind, "string").alias("node_kind"),
            as_column(label, "string").alias("label"), as_column(length, "bigint").alias("array_len"),
            as_column(variadic, "boolean").alias("variadic"), as_column(name, "string").alias("field_name"),
            as_column(embedded, "boolean").alias("embedded"), as_column(tag, "string").alias("struct_tag"),
        )

    def method(slot, name, variadic, parameter):
        top = node([slot], "signature", variadic=variadic, name=name)
        return [top, node([slot, 0], "tuple"), node([slot, 1], "tuple"), node([slot, 0, 0], "basic", parameter)]

    parts = {
        "array": [node([0], "basic", target)],
        "slice": [node([0], "pointer"), node([0, 0], "basic", text)],
        "map": [node([0], "basic", text), node([1], "basic", target)],
        "pointer": [node([0], "basic", text)],
        "chan": [node([0], "basic", text)],
        "struct": [
            node([0], "basic", "int", name="A", embedded=F.col("embedded") & odd),
            node([1], "basic", F.when(odd, text).otherwise("int"), name="B", tag=F.when(odd, target).otherwise("")),
            F.when(target != "Type0", node([2], "basic", "int", name=F.concat(F.lit("C"), text))),
        ],
        "interface": [
            *method(0, "M", F.col("embedded") & odd, F.when(odd, text).otherwise("int")),
            *method(1, F.concat(F.lit("N"), target), False, text),
            *[F.when((target == "Type2") & (text == "T1"), n) for n in method(2, "O", False, "int")],
        ],
        "basic": [],
    }
    length = F.substring("type_str", 2, 9)
    trees = {k: F.array(node([], k, text if k == "basic" else "", length if k == "array" else None), *parts[k]) for k in kinds}
    chosen = F.coalesce(*[F.when(kind == k, tree) for k, tree in trees.items()])
    rows = fields.select(*PAIR, "side", F.col("owner").alias("root"), F.col("field_name").alias("part"), F.explode(F.filter(chosen, lambda n: n.isNotNull())).alias("n"))
    return rows.select(*PAIR, "side", "root", "part", F.lit("").alias("named_pkg"), "n.*")


@query
def compare_types_of_all_kinds(b: Bench) -> DataFrame:
    """Outcome and cause for arrays, slices, maps, pointers, channels, structs, interfaces and basic types."""
    return correspondence.compare_types(_shapes(b.sided(b.views.api_field)), PAIR)


@query
def type_kinds(b: Bench) -> DataFrame:
    """Of the functions, and of every parameter as a tree of its own."""
    nodes = b.views.api_type_node
    below = nodes.filter((F.size("path") >= 2) & (F.get("path", 0) == 0))
    root = F.concat_ws(".", "root", F.get("path", 1).cast("string")).alias("root")
    parameters = below.select(*PACKAGE, root, "part", F.slice("path", F.lit(3), F.size("path")).alias("path"), "node_kind")
    return correspondence.type_kinds(nodes.select(*PACKAGE, "root", "part", "path", "node_kind").unionByName(parameters), PACKAGE).drop("part")


@query
def embedded_names_correspond(b: Bench) -> DataFrame:
    fields = b.views.api_field.select(
        "rel_id", F.col("owner").alias("root"), F.col("field_name").alias("part"), F.array(F.lit(0)).alias("path"),
        F.lit("named").alias("node_kind"), F.col("embedded_owner").alias("label"), F.lit("").alias("named_pkg"),
        F.lit(None).cast("bigint").alias("array_len"), F.lit(False).alias("variadic"),
        F.when(F.col("embedded"), F.lower("embedded_owner")).otherwise(F.col("field_name")).alias("field_name"),
        "embedded", F.lit("").alias("struct_tag"),
    )
    found = correspondence.embedded_names_correspond(b.sided(fields), PAIR)
    return found.select("pair_id", "root", "part", "old_field_name", "new_field_name", "corresponds")


@query
def establish_correspondence(b: Bench) -> DataFrame:
    """Which named type becomes which, from function signatures and embedded fields."""
    scope = [*PAIR, "pkg_path"]
    fields = b.sided(b.views.api_fields(PACKAGE).filter("embedded")).select(
        *scope, "side", F.col("owner").alias("root"), F.col("field_name").alias("part"),
        F.array().cast("array<int>").alias("path"), F.lit("named").alias("node_kind"),
        F.col("embedded_owner").alias("label"), F.lit("").alias("named_pkg"), F.col("embedded"),
    )
    trees = correspondence.align_trees(b.nodes.unionByName(fields, allowMissingColumns=True), scope, b.parts)
    aligned_trees = materialize(trees, "aligned-nodes")
    nodes = correspondence.sided_trees(aligned_trees, scope)
    roots = nodes.filter("root like 'Sym%'").select(*scope, "side", F.col("root").alias("obj_name")).distinct()
    objects = diff.align(roots, [*scope, "obj_name"], []).filter("in_old and in_new").select(
        *scope, "obj_name", F.lit("func").alias("old_kind"), F.lit("func").alias("new_kind")
    )
    # Only which types there are on both sides is asked for here, so no fact of theirs travels.
    names = b.sided(b.views.api_types(PACKAGE).select(*PACKAGE, "type_name"))
    aligned = types.align_types(names, scope)
    named = aligned.select(*scope, F.col("owner").alias("obj_name"), F.lit("type").alias("old_kind"), F.lit("type").alias("new_kind"))
    mapping = correspondence.establish_correspondence(materialize(objects.unionByName(named), "objects"), nodes, scope, aligned_trees)
    return mapping.withColumn("pos", F.array_join("pos", "/"))


@query
def unsupported_objects(b: Bench) -> DataFrame:
    """Signatures with a type parameter: here every parameter of one basic label counts as one."""
    nodes = b.views.api_type_node.withColumn("node_kind", F.when(F.col("label") == "t1", "typeParam").otherwise(F.col("node_kind")))
    return correspondence.unsupported_objects(nodes, PACKAGE)


@query
def failed_objects(b: Bench) -> DataFrame:
    """The side output of a comparison, with the same label for a type parameter."""
    kind = F.when(F.col("label") == "t1", "typeParam").otherwise(F.col("node_kind"))
    snapshot = replace(b.snapshot, api_type_node=b.snapshot.api_type_node.withColumn("node_kind", kind))
    failed = pipelines.failed_objects(snapshot, pipelines.compare_releases(snapshot))
    return failed.select("pair_id", "pkg_name", "side", "root", "unsupported_kind", "n_nodes", "module", "old_tag", "new_tag")


# --- end-to-end queries ------------------------------------------------------------------------------


@query
def breaking_changes(b: Bench) -> DataFrame:
    return writers.to_change_report(b.breaking)


@query
def client_usage(b: Bench) -> DataFrame:
    return pipelines.client_usage(b.views.identifier, b.views.client_version, *_client_facts(b))


@query
def client_imports(b: Bench) -> DataFrame:
    return pipelines.client_imports(_imports(b), b.views.client_version, *_client_facts(b))


def _client_facts(b: Bench) -> tuple[DataFrame, DataFrame]:
    """Releases and packages of the clients, by url and version."""
    key = [F.col("module").alias("url"), F.col("tag").alias("version")]
    packages = b.views.package.join(b.views.release.select("rel_id", "tag"), "rel_id")
    return b.views.release.select(*key, "has_go_mod"), packages.select(*key, "n_errors")


@query
def dependency_graph(b: Bench) -> DataFrame:
    nodes, edges = pipelines.dependency_graph(b.views.dependency)
    return _graph_rows(nodes, edges)


@query
def breaking_change_usage(b: Bench) -> DataFrame:
    used = usage.third_party_usage(b.views.identifier, b.views.client_version)
    return pipelines.breaking_change_usage(b.breaking, b.edges, used)


@query
def minor_patch_breaks(b: Bench) -> DataFrame:
    return pipelines.minor_patch_breaks(b.report)


# --- streams -----------------------------------------------------------------------------------------


@query
def stream_release_diff(b: Bench) -> DataFrame:
    """Releases in two waves, each module's older half first but for some that come late; together they give the
    batch result."""
    source, out, marks = (fresh_path(b.spark, name) for name in ("arriving", "stream", "marks"))
    order = releases.order_tags(b.views.release)
    half = order.groupBy("module").agg(F.floor(F.max("position") / 2).alias("half"))
    second = (F.col("position") > F.col("half")) | (F.col("rel_id") % 23 == 0)
    waves = materialize(order.join(half, "module").withColumn("wave", second.cast("int")), "waves")
    snapshot = b.stored_snapshot(partitioned=True)
    for wave in (0, 1):
        waves.filter(F.col("wave") == wave).select(*b.views.release.columns).write.mode("append").parquet(source)
        arriving = b.spark.readStream.schema(b.views.release.schema).parquet(source)
        writer = release_stream.stream_release_diff(arriving, snapshot, out, marks)
        writer.trigger(availableNow=True).start().awaitTermination()
    return writers.to_change_report(release_stream.read_stream_changes(b.spark, out))


@query
def watch_clients(b: Bench) -> DataFrame:
    source, out, marks = (fresh_path(b.spark, name) for name in ("arriving", "watched", "marks"))
    b.views.dependency.write.parquet(source)
    changes = materialize(b.breaking, "changes")
    arriving = b.spark.readStream.schema(b.views.dependency.schema).parquet(source)
    client_watch.watch_clients(arriving, changes, out, marks).trigger(availableNow=True).start().awaitTermination()
    return b.spark.read.parquet(out)
