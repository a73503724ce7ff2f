"""The driver's contract, and whole queries against their SQL on the smallest tables."""

from dataclasses import replace
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from apidrift.operators import filters
from apidrift.plans import pipelines
from apidrift.plans.catalog import Bench
from apidrift.sources.batches import BatchStore
from apidrift.sources.readers import Snapshot
from apidrift.streaming import release_stream

TABLES = Path("/root/testdata/sf0.001")
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_tables = pytest.mark.skipif(not TABLES.exists(), reason="test tables are not here")


def test_every_query_has_its_sql():
    without = set(contract.queries()) - set(contract.oracle_sql())
    optional = {name for name in without if name == "pipeline" or name.startswith("op")}
    assert without - optional == set()
    assert set(contract.oracle_sql()) <= set(contract.queries())


@needs_tables
@pytest.mark.parametrize("name", ["adjacent_kept_releases", "check_objects", "check_method_sets", "compare_types", "compare_types_of_all_kinds", "change_totals", "failed_objects", "establish_correspondence", "client_usage", "dependency_graph", "breaking_changes"])
def test_query_matches_sql(spark, name):
    engine = duckdb.connect()
    for table in NAMES:
        engine.execute(f"create view {table} as select * from '{TABLES}/{table}.parquet'")
    got = contract.queries()[name](spark, str(TABLES))
    cursor = engine.execute(contract.oracle_sql()[name])
    order = [d[0] for d in cursor.description]
    assert sorted(order) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*order).collect()))) == sorted(map(repr, cursor.fetchall()))


def tiny_snapshot(spark, releases):
    """Snapshot with one package ``core`` per release; its functions are given per release."""
    release = [(n, "m", "https://x/m.git", tag, f"t{n}", True) for n, tag, _ in releases]
    objects = [(n, "m/core", f, True, "func", "function", "func()", "func()", None, False) for n, _, names in releases for f in names]
    empty = spark.createDataFrame
    return Snapshot(
        spark.createDataFrame(release, "rel_id long, module string, server_url string, tag string, tag_time string, has_go_mod boolean"),
        spark.createDataFrame([(n, "m", "core", "m/core", 0) for n, _, _ in releases], "rel_id long, module string, pkg_name string, pkg_path string, n_errors int"),
        spark.createDataFrame(objects, "rel_id long, pkg_path string, obj_name string, exported boolean, obj_kind string, type_kind string, type_str string, corr_key string, const_val string, const_known boolean"),
        empty([], "rel_id long, pkg_path string, type_name string, underlying_kind string, underlying_corr_key string, underlying_str string, comparable boolean, chan_dir string, elem_corr_key string, elem_str string, elem_kind string, basic_name string"),
        empty([], "rel_id long, pkg_path string, owner string, field_name string, exported boolean, embedded boolean, embedded_owner string, type_str string, type_kind string, corr_key string"),
        empty([], "rel_id long, pkg_path string, owner string, method_name string, exported boolean, in_value_set boolean, ptr_receiver boolean, recv_named string, recv_kind string, recv_is_owner boolean, sig_str string, corr_key string"),
    )


TREE = "rel_id long, pkg_path string, root string, part string, path array<int>, node_kind string, label string, named_pkg string, array_len bigint, variadic boolean, field_name string, embedded boolean, struct_tag string"


def test_renamed_types_are_followed(spark, rows):
    """F(OldT) became F(NewT), whose field was renamed with its type: only the exported name is missed."""
    plain = tiny_snapshot(spark, [(1, "v1.0.0", ["F"]), (2, "v1.1.0", ["F"])])
    names = {1: ("OldT", "inner"), 2: ("NewT", "core")}
    signature = lambda t: [([], "signature", "", None), ([0], "tuple", "", None), ([1], "tuple", "", None), ([0, 0], "named", t, "")]
    nodes, objects, named, fields = [], [], [], []
    for rel, (top, below) in names.items():
        nodes += [(rel, "m/core", "F", "", *n[:3], n[3], None, False, None, False, None) for n in signature(top)]
        nodes.append((rel, "m/core", top, "X", [], "named", below, "", None, False, None, False, None))
        objects.append((rel, "m/core", top, True, "type", "named|struct", top, top, None, False))
        for t in (top, below):
            named.append((rel, "m/core", t, "struct", "s", "struct{...}", True, None, None, None, None, None))
        fields.append((rel, "m/core", top, "X", True, False, None, below, "named|struct", below))
    frame = spark.createDataFrame
    snapshot = Snapshot(
        plain.release, plain.package, plain.api_object.unionByName(frame(objects, plain.api_object.schema)),
        frame(named, plain.api_type.schema), frame(fields, plain.api_field.schema), plain.api_method, frame(nodes, TREE),
    )
    assert rows(pipelines.breaking_changes(snapshot), "change_node", "change_message") == [("OldT", "removed")]
    without = rows(pipelines.breaking_changes(snapshot, renames=False), "change_node", "change_message")
    assert ("OldT", "removed") in without and len(without) > 1
    with pytest.raises(ValueError):
        pipelines.breaking_changes(plain, renames=True)


def test_failed_objects_leave_the_other_rows(spark, rows):
    """G has a type parameter in the new release and F goes: the removal is reported, G is told beside it."""
    plain = tiny_snapshot(spark, [(1, "v1.0.0", ["F", "G"]), (2, "v1.1.0", ["G"])])
    nodes = []
    for rel, kind in ((1, "basic"), (2, "typeParam")):
        for path, node_kind, label in (([], "signature", ""), ([0], "tuple", ""), ([1], "tuple", ""), ([0, 0], kind, "T")):
            nodes.append((rel, "m/core", "G", "", path, node_kind, label, None, None, False, None, False, None))
    snapshot = replace(plain, api_type_node=spark.createDataFrame(nodes, TREE))
    found = pipelines.breaking_changes_and_failures(snapshot)
    changes = rows(found.changes, "change_node", "change_message")
    assert ("F", "removed") in changes
    assert rows(found.failures, "side", "root", "unsupported_kind", "n_nodes", "old_tag") == [("new", "G", "typeParam", 1, "v1.0.0")]
    assert found.seen_changes.get == {"n_changes": len(changes)} and found.seen_failures.get == {"n_failed": 1, "n_nodes": 1}
    assert rows(pipelines.breaking_changes(snapshot, compat=True), "change_node") == []
    with pytest.raises(ValueError):
        pipelines.breaking_changes_and_failures(plain)


def test_usage_of_deleted_packages_and_methods(spark, rows):
    facts = [
        ("", "p: packages deleted", "", "l/gone"), ("(*T).Close", "struct method removed", "func", "l/p"), ("Open", "removed", "func", "l/p"),
        ("S.Name", "removed", "type", "l/p"),
    ]
    changes = spark.createDataFrame(
        [("lib", "v1.0.0", "v1.1.0", node, text, kind, path) for node, text, kind, path in facts],
        "module string, old_tag string, new_tag string, change_node string, change_message string, changed_object string, old_pkg_path string",
    )
    edges = spark.createDataFrame([("c", "v1", "lib", "v1.0.0", False)], "from_name string, from_version string, to_name string, to_version string, indirect boolean")
    uses = [
        ("Any", "func l/gone.Any()", "l/gone"), ("Close", "func (*l/p.T).Close() error", "l/p"), ("Close", "func (l/p.U).Close() error", "l/p"),
        ("Close", "func l/p.Close()", "l/p"), ("Open", "func l/p.Open()", "l/p"), ("Open", "func (l/p.T).Open()", "l/p"), ("Name", "field Name string", "l/p"),
    ]
    used = spark.createDataFrame([("c", "v1", text, name, f'package x ("{path}")', text) for name, text, path in uses], "server_url string, version string, id_pos string, obj_name string, obj_pkg string, obj_string string")
    found = rows(pipelines.breaking_change_usage(changes, edges, used), "change_node", "id_pos")
    assert found == [("", "func l/gone.Any()"), ("(*T).Close", "func (*l/p.T).Close() error"), ("Open", "func l/p.Open()"), ("S.Name", "field Name string")]


def test_stream_late_and_repeated_batches(spark, rows, tmp_path):
    """A late release replaces what its module's batches wrote; a repeated batch changes nothing."""
    releases = [(1, "v1.0.0", ["A", "B"]), (2, "v1.1.0", ["A"]), (3, "v1.0.5", ["A", "B"]), (4, "v1.2.0", [])]
    snapshot = tiny_snapshot(spark, releases)
    out = str(tmp_path / "out")
    waves = [(0, [1, 2]), (1, [3]), (2, [4])]
    found = lambda: rows(release_stream.read_stream_changes(spark, out), "old_tag", "new_tag", "change_node")
    expected = [[("v1.0.0", "v1.1.0", "B")], [("v1.0.5", "v1.1.0", "B")], [("v1.0.5", "v1.1.0", "B"), ("v1.1.0", "v1.2.0", "A")]]
    for (batch_id, ids), want in zip([*waves, waves[2]], [*expected, expected[2]]):
        release_stream.diff_batch(snapshot.release.filter(snapshot.release.rel_id.isin(ids)), batch_id, snapshot, out)
        assert found() == want
    assert rows(release_stream.late_releases(spark, out), "rel_id") == [(3,)]
    assert rows(pipelines.breaking_changes(snapshot, filters.WHITE_LIST), "old_tag", "change_node") == [("v1.0.5", "B"), ("v1.1.0", "A")]


def test_stream_state_is_folded(spark, rows, tmp_path):
    """Twenty batches: however many have gone before, one generation and at most eight more are read."""
    path, listed = str(tmp_path / "state"), []
    store = BatchStore(spark, path)
    for batch in range(20):
        known = release_stream.newest_known(spark, path, batch)
        assert rows(known, "module", "rel_id") == [(f"m{m}", max(b for b in range(batch) if b % 3 == m)) for m in range(3) if m < batch]
        listed.append(len(store.paths()))
        row = [(batch, f"m{batch % 3}", "u", f"v1.{batch}.0", "t", 1, 1, ["v", f"{batch:05d}"])]
        for _ in range(2):
            store.write(spark.createDataFrame(row, release_stream.STATE), batch)
    assert max(listed) <= release_stream.UNFOLDED + 1 and len(list((tmp_path / "state" / "rows").iterdir())) <= 2 * release_stream.UNFOLDED + 8


@needs_tables
def test_input_order_does_not_matter(spark, rows):
    bench = Bench(spark, str(TABLES))
    columns = ["pair_id", "old_rel"]
    shuffled = bench.compared.orderBy(bench.compared.tag.desc()).repartition(5)
    from apidrift.operators.releases import adjacent_releases

    assert rows(adjacent_releases(shuffled), *columns) == rows(bench.pairs, *columns)
