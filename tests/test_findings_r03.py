"""Queries named in the findings of round 3, against their SQL on small tables made here."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from apidrift.functions import versions
from apidrift.operators import correspondence, diff, ordered, releases, types
from apidrift.plans import catalog
from apidrift.sources import standin


def write_tables(spark, folder, orders, lines):
    """The tables that the stand-in views read: ``orders`` (key, customer, day), ``lines`` (order, part, supplier, number, quantity)."""
    frame = spark.createDataFrame
    tables = {
        "customer": frame(sorted({(c, 1) for _, c, _ in orders if c is not None}), "c_custkey long, c_nationkey int"),
        "orders": frame(orders, "o_orderkey long, o_custkey long, o_orderdate string").selectExpr("o_orderkey", "o_custkey", "to_timestamp(o_orderdate) as o_orderdate"),
        "lineitem": frame([(*row, "R" if row[1] % 2 else "N") for row in lines], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string"),
    }
    for name, table in tables.items():
        table.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Forty releases of four modules."""
    orders = [(n, n % 4, f"2020-01-{n % 28 + 1:02d}") for n in range(1, 41)]
    lines = [(n, n * 7 + k * 3, n + k, k, float((n * k * 5) % 50 + 1)) for n, _, _ in orders for k in range(1, 2 + n % 7)]
    return write_tables(spark, str(tmp_path_factory.mktemp("tables")), orders, lines)


def both(spark, name, tables):
    """Rows of a query and of its SQL."""
    engine = duckdb.connect()
    for table in ("customer", "orders", "lineitem"):
        engine.execute(f"create view {table} as select * from '{tables}/{table}.parquet/*.parquet'")
    got = contract.queries()[name](spark, tables)
    cursor = engine.execute(contract.oracle_sql()[name])
    order = [d[0] for d in cursor.description]
    return sorted(map(repr, (tuple(r) for r in got.select(*order).collect()))), sorted(map(repr, cursor.fetchall()))


def test_non_empty_reports(spark, tables):
    """The reports lie in a store of batches; its list is no part of the rows."""
    got, expected = both(spark, "non_empty_reports", tables)
    assert got == expected and len(got) > 1


def test_non_empty_reports_without_changes(spark, tmp_path):
    """One release per module: nothing is compared, so no report has rows."""
    folder = write_tables(spark, str(tmp_path), [(1, 1, "2020-01-01"), (2, 2, "2020-01-02")], [(1, 1, 1, 1, 1.0), (2, 2, 2, 1, 1.0)])
    assert both(spark, "non_empty_reports", folder) == ([], [])


def test_members_are_dealt_by_rows(spark, tables, monkeypatch):
    """Adaptive execution joins small partitions by their compressed size; members stay dealt by their number."""
    monkeypatch.setattr(standin, "LINES_PER_PARTITION", 10)
    views = standin.StandIn(spark, tables)
    n_lines = views.table("lineitem").count()
    for table in (views.line, views.package, views.api_object):
        assert table.rdd.getNumPartitions() == n_lines // 10


@pytest.mark.parametrize("name", ["adjacent_releases", "unsupported_objects", "compare_types", "packages_by_name", "module_edges"])
def test_dealt_members_give_the_same_rows(spark, tables, name):
    got, expected = both(spark, name, tables)
    assert got == expected and got


def test_only_type_trees_are_walked_again(spark, monkeypatch, rows):
    """Trees of functions serve the first round alone; what it meets is the same."""
    kept = {}
    real = correspondence.materialize
    monkeypatch.setattr(correspondence, "materialize", lambda df, label: kept.setdefault(label, []).append(real(df, label)) or kept[label][-1])
    nodes = []
    for side, name in (("old", "Old"), ("new", "New")):
        for path, kind, label in (([], "signature", ""), ([0], "tuple", ""), ([1], "tuple", ""), ([0, 0], "named", name)):
            nodes.append((1, "core", side, "F", "", path, kind, label, "", None, False, None, False, None))
        nodes.append((1, "core", side, name, "X", [], "named", "In" + name, "", None, False, "X", False, None))
    schema = "pair_id long, pkg_name string, side string, root string, part string, path array<int>, node_kind string, label string, named_pkg string, array_len bigint, variadic boolean, field_name string, embedded boolean, struct_tag string"
    objects = spark.createDataFrame([(1, "core", "F", "func", "func")], "pair_id long, pkg_name string, obj_name string, old_kind string, new_kind string")
    mapping = correspondence.establish_correspondence(objects, spark.createDataFrame(nodes, schema))
    assert rows(mapping, "old_name", "new_name") == [("InOld", "InNew"), ("Old", "New")]
    assert [{r.root for r in df.collect()} for df in kept["type-trees"]] == [{"Old", "New"}] * 2


def test_ordered_rows_are_dealt_by_number(spark, monkeypatch):
    """Adaptive execution would join slices by their compressed size; the few rows across borders move no others."""
    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 100)
    rows = spark.range(1000).selectExpr("id % 3 as k", "id")
    got = ordered.running(rows, ["k"], ["id"], number="n", slices=5)
    assert got.rdd.getNumPartitions() == 10
    assert sorted((r.k, r.id, r.n) for r in got.collect()) == sorted((i % 3, i, i // 3 + 1) for i in range(1000))


@pytest.mark.parametrize("slices", [1, 3, 7])
def test_position_of_the_last_marked_row(spark, slices):
    """Inside a slice and over its border, in long and in short groups."""
    data = [(i % 2 if i < 150 else 2, i, i % 11 == 0) for i in range(160)]
    df = spark.createDataFrame(data, "k int, id int, hit boolean")
    got = ordered.running(df, ["k"], ["id"], number="n", last_where={"v": (F.col("hit"), F.col("id"))}, last_number={"at": "v"}, slices=slices)
    expected, seen, last = [], {}, {}
    for k, i, hit in data:
        seen[k] = seen.get(k, 0) + 1
        expected.append((k, i, seen[k], *last.get(k, (None, None))))
        if hit:
            last[k] = (i, seen[k])
    assert sorted(map(repr, ((r.k, r.id, r.n, r.v, r.at) for r in got.collect()))) == sorted(map(repr, expected))


def test_sort_key_of_zeros(spark):
    tags = ["v1.002.0", "000", "v00a:0", ":9", "9:", "/0", "a0b00c"]
    key = spark.createDataFrame([(t,) for t in tags], "tag string").select("tag", versions.version_sort_key(F.col("tag")).alias("key"))
    plain = lambda t: [f"{len(r.lstrip('0') or '0'):010d}{r.lstrip('0') or '0'}" if r[0].isdigit() else r for r in re.findall("[0-9]+|[^0-9]+", t)]
    assert {r.tag: r.key for r in key.collect()} == {t: plain(t) for t in tags}


def test_releases_are_derived_once_before_they_are_dealt(spark, tables, monkeypatch):
    """A sample of what is dealt by ranges must not derive packages from line items once more."""
    dealt = []
    real = ordered._sliced
    monkeypatch.setattr(ordered, "_sliced", lambda df, *rest: dealt.append(df) or real(df, *rest))
    got, expected = both(spark, "adjacent_releases", tables)
    assert got == expected and got
    assert not any("lineitem" in df._jdf.queryExecution().toString() for df in dealt)


def test_check_structs_derives_fields_once(spark, tables):
    """The passes over embedded structs start from written fields."""
    got, expected = both(spark, "check_structs", tables)
    assert got == expected and got
    assert "lineitem" not in contract.queries()["check_structs"](spark, tables)._jdf.queryExecution().toString()


def test_write_change_report_derives_changes_once(spark, tables, monkeypatch):
    """Three batches are written of changes that are derived once."""
    given = []
    real = catalog.writers.write_change_report
    monkeypatch.setattr(catalog.writers, "write_change_report", lambda changes, *rest: given.append(changes) or real(changes, *rest))
    got, expected = both(spark, "write_change_report", tables)
    assert got == expected and got
    assert len(given) == 3 and not any("lineitem" in df._jdf.queryExecution().toString() for df in given)


def test_breaking_changes_choose_between_rows_once(spark, tables, monkeypatch):
    """Type rows and object rows collide in one choice; a choice among type rows before it changed nothing."""
    calls = []
    real = catalog.messages.dedupe_messages
    monkeypatch.setattr(catalog.messages, "dedupe_messages", lambda *given: calls.append(given) or real(*given))
    got, expected = both(spark, "breaking_changes", tables)
    assert got == expected and got and len(calls) == 1


def test_members_of_releases_are_dealt_by_rows(spark, tables, monkeypatch):
    """Tables without packages are grouped where the line items were dealt, not by splits of files or compressed size."""
    monkeypatch.setattr(standin, "LINES_PER_PARTITION", 10)
    views = standin.StandIn(spark, tables)
    n_lines = views.table("lineitem").count()
    for table in (views.api_type, views.api_field, views.api_method):
        assert table.rdd.getNumPartitions() == n_lines // 10


def test_receivers_have_the_kind_of_all_members(spark, tmp_path):
    """Unexported methods count, unknown parts do not, and without a release or an owner there is no method."""
    lines = [(1, 9, 3, 1, 1.0), (1, 6, 3, 2, 50.0), (1, 7, 4, 3, 1.0), (1, None, 4, 4, 1.0), (2, None, 5, 1, 1.0), (None, 1, 3, 1, 1.0), (2, 1, None, 2, 1.0)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string"
    folder = write_tables(spark, str(tmp_path), [(1, 1, "2020-01-01"), (2, 1, "2020-01-02")], [])
    spark.createDataFrame([(*row, "R") for row in lines], schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")
    got = standin.StandIn(spark, folder).api_method.select("rel_id", "owner", "method_name", "recv_kind").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(
        map(repr, [(1, "Type0", "M4", "interface"), (1, "Type0", "m1", "interface"), (1, "Type1", "M2", "struct"), (1, "Type1", None, "struct"), (2, "Type2", None, "struct")])
    )


PAIR_QUERIES = [
    "basic_widening", "check_method_sets", "check_named_types", "check_promoted_method_sets", "dedupe_messages",
    "previous_tag_label", "diff_fields", "diff_methods", "diff_packages",
]


@pytest.mark.parametrize("name", PAIR_QUERIES)
def test_rows_of_pairs_are_dealt_by_rows(spark, tables, monkeypatch, name):
    """The number of partitions follows the line items, so what one task holds does not."""
    monkeypatch.setattr(standin, "LINES_PER_PARTITION", 10)
    seen, real = [], diff.dealt
    for module in (diff, releases, types):
        monkeypatch.setattr(module, "dealt", lambda df, by, parts=None: seen.append(parts) or real(df, by, parts))
    got, expected = both(spark, name, tables)
    assert got == expected and got
    assert seen and set(seen) == {2 * (spark.read.parquet(f"{tables}/lineitem.parquet").count() // 10)}


def test_aligned_rows_keep_the_given_partitions(spark):
    """Adaptive execution would join all of them."""
    sided = spark.range(200).selectExpr("id div 4 as pair_id", "id % 2 as owner", "if(id % 4 < 2, 'old', 'new') as side", "id as v")
    got = diff.align(sided, ["pair_id", "owner"], ["v"], near=["pair_id"], parts=7)
    assert got.rdd.getNumPartitions() == 7
    assert sorted((r.pair_id, r.owner, r.old_v, r.new_v) for r in got.collect()) == [(i // 2, i % 2, i // 2 * 4 + i % 2, i // 2 * 4 + 2 + i % 2) for i in range(100)]


@pytest.mark.parametrize("shuffled", [2, 50])
def test_owners_of_releases_are_not_broadcast(spark, tables, shuffled):
    """Their columns are small on disk at sizes where a task can't well hold all of them."""
    views = standin.StandIn(spark, tables)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for table in (views.line, views.package, views.api_object):
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
        try:
            plan = table._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert "Broadcast" not in plan and "SortMergeJoin" in plan
        assert len(re.findall(rf"hashpartitioning\(rel_id#\d+L, {views.partitions}\), REPARTITION_BY_NUM", plan)) == 2


def test_package_counts_leave_the_task_of_packages(spark, tables, monkeypatch):
    """Releases meet the counts in tasks of their own, so that fewer tables lie in one task."""
    seen, real = [], releases.adjacent_releases
    monkeypatch.setattr(releases, "adjacent_releases", lambda counted, *rest: seen.append(counted) or real(counted, *rest))
    got, expected = both(spark, "previous_tag_label", tables)
    assert got == expected and got
    parts = spark.sparkContext.defaultParallelism
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(rf"hashpartitioning\(rel_id#\d+L, {parts}\), REPARTITION_BY_NUM", plan)) == 2
