"""Readers, writers, pairing, usage, graph and record over small literal tables."""

import json

import pytest
from pyspark.sql import functions as F

from apidrift.operators import filters, graph, record, releases, usage
from pyspark.sql import Window
from apidrift.operators.ordered import running
from apidrift.sources import batches, readers, writers
from apidrift.sources.batches import BatchStore


def write(path, content):
    path.write_bytes(content.encode())
    return str(path)


def test_repo_tasks(spark, rows, tmp_path):
    tasks = {"total_count": 1, "items": [{"index": 1, "full_name": "a/b", "url": "old", "star": 3}, {"index": 2, "full_name": "c/d", "star": 4}]}
    path = write(tmp_path / "t.json", json.dumps(tasks, indent=2))
    got = readers.read_repo_tasks(spark, path)
    assert rows(got, "index", "url", "star", "count_matches") == [(1, "https://github.com/a/b.git", 3, False), (2, "https://github.com/c/d.git", 4, False)]


def test_client_tasks(spark, rows, tmp_path):
    tasks = {"total_count": 1, "items": [{"Url": "u", "Detail": [{"Version": "v1", "Path": "p", "PkgInfo": ["x/y@@@y", "x/y@@@y"]}, {"Version": "v2", "Path": ""}]}, {"Url": "w", "Detail": []}]}
    got = readers.read_client_tasks(spark, write(tmp_path / "t.json", json.dumps(tasks, indent=2)))
    assert rows(got, "url", "version", "path", "pkg_info") == [("u", "v1", "p", ["x/y@@@y", "x/y@@@y"]), ("u", "v2", "", [])]
    assert filters.has_packages(got).count() == 1


@pytest.mark.parametrize("content", ["cmd\nbuild\n\ntest", "cmd\r\nbuild\r\n\r\ntest"])
def test_white_list(spark, rows, tmp_path, content):
    assert rows(readers.read_white_list(spark, write(tmp_path / "w.txt", content)), "entry") == [("build",), ("cmd",), ("test",)]


def test_white_list_compat(spark, tmp_path):
    path = write(tmp_path / "w.txt", "cmd\nbuild")
    assert [r.entry for r in readers.read_white_list(spark, path, compat=True).collect()] == ["cmd\nbuild"]


PATHS = ["x/testify", "cmd/a", "a/cmd", "a/mycmd", "cmdx/a", "testx", "a/b/internal/c", "plain"]


def test_white_listed_paths(spark, rows):
    df = spark.createDataFrame([(p,) for p in PATHS], "pkg_path string")
    by_list = rows(filters.drop_white_listed(df, list(filters.WHITE_LIST)), "pkg_path")
    by_table = rows(filters.drop_white_listed(df, spark.createDataFrame([(e,) for e in filters.WHITE_LIST], "entry string")), "pkg_path")
    brute = sorted((p,) for p in PATHS if not any("/" + e in p or p.startswith(e + "/") for e in filters.WHITE_LIST))
    assert by_list == by_table == brute


def test_dependencies(spark, rows, tmp_path):
    head = "require_module_indirect,module_name,go_version,tag,tag_time,require_module_name,require_module_version\n"
    for i, line in enumerate(["true,m,1.19,v1,t,n,v2\n", "false,m,1.19,,t,n,v2\n"]):
        write(tmp_path / f"{i}.csv", head + line)
    got = readers.read_dependencies(spark, str(tmp_path / "*.csv"))
    assert rows(got, "module_name", "tag", "require_module_indirect") == [("m", "", False), ("m", "v1", True)]


CHANGE = "server_url string, old_tag string, old_tag_time string, new_tag string, new_tag_time string, old_pkg_name string, new_pkg_name string, old_pkg_path string, new_pkg_path string, change_node string, changed_object string, changed_type string, change_message string, compatible boolean"


def change(node, message, old="v1.0.0", new="v1.1.0", compatible=False, url="https://github.com/o/r.git"):
    return (url, old, "t0", new, "t1", "p", "p", "o/r/p", "o/r/p", node, "func", "function", message, compatible)


def test_change_report_round_trip(spark, rows, tmp_path):
    data = [change("F", 'changed from func("a,b") to func()'), change("G", "line\nbreak"), change("H", "added", compatible=True), change("", "value changed from unknown to unknown")]
    df = filters.reportable(spark.createDataFrame(data, CHANGE))
    path = str(tmp_path / "report")
    writers.write_change_report(df, path)
    writers.write_change_report(df.filter("false"), path)
    back = readers.read_change_report(spark, path)
    assert rows(back, "change_node", "changeMessage", "olg_tag_time") == [("F", 'changed from func("a,b") to func()', "t0"), ("G", r"line\nbreak", "t0")]
    full = spark.read.option("header", True).option("escape", '"').csv(f"{path}/rows")
    assert tuple(full.columns[:14]) == readers.CHANGE_REPORT_COLUMNS
    for _ in range(3):
        writers.write_change_report(df, path, "again")
    assert readers.read_change_report(spark, path).count() == 4
    exported = str(tmp_path / "exported")
    writers.export_change_report(df, exported)
    assert rows(readers.read_change_report(spark, exported), "change_node") == [("F",), ("G",)]


def test_batch_store(spark, tmp_path):
    store = BatchStore(spark, str(tmp_path / "store"))
    some = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    read = lambda batches=None: sorted(r.id for r in store.read("id int", batches).collect())
    assert not store.exists() and read() == []
    for ids, batch in (((1, 2), 0), ((3,), 1), ((), 2), ((4,), 1), ((5,), 3)):
        store.write(some(*ids), batch)
    assert read() == [1, 2, 4, 5] and read([1, 2, 9]) == [4]
    store.write(some(*read()), "all", replaces=store.batches())
    store.vacuum()
    assert read() == [1, 2, 4, 5] and list(store.batches()) == ["all"] and len(store.paths()) == 1
    keyed = BatchStore(spark, str(tmp_path / "keyed"), "csv", header=True)
    keyed.write(spark.range(5000).select(F.concat(F.lit("server"), F.col("id").cast("string")).alias("s")), 0, "s")
    keyed.write(spark.createDataFrame([], "s string"), 1, "s")
    assert len(list((tmp_path / "keyed" / "rows").glob("*/bucket=*"))) == batches.BUCKETS and keyed.batches()["1"] == ""
    assert spark.read.option("header", True).csv(keyed.paths()).count() == 5000


def usage_rows(spark):
    data = [("https://github.com/o/r.git", "v1+incompatible", "defs", "/tmp/1/a.go:1:1", "X", 'package n ("o/r/n")', "func o/r/n.X()", True), ("https://github.com/o/r.git", "rel/v2", "uses", "/tmp/1/b.go:2:1", "Y", None, "var x int", False)]
    return spark.createDataFrame(data, "server_url string, version string, var_type string, id_pos string, obj_name string, obj_pkg string, obj_string string, obj_exported boolean")


@pytest.mark.parametrize("write_usage", [writers.export_identifier_usage, writers.write_identifier_usage])
def test_usage_round_trip(spark, rows, tmp_path, write_usage):
    report = usage.to_identifier_report(usage_rows(spark))
    write_usage(report, str(tmp_path))
    back = readers.read_identifier_usage(spark, str(tmp_path / "pkgInfo"))
    assert rows(back, "version", "id_pos", "obj_exported", "obj_pkg") == sorted([("v1+incompatible", "a.go:1:1", "true", 'package n ("o/r/n")'), ("rel/v2", "b.go:2:1", "false", "")])


def test_version_from_file_name(spark, rows, tmp_path):
    write(tmp_path / "x_@@@v1.0.csv", "server_url,pkg_path,pkg_name\nu,a/b,b\n")
    assert rows(readers.read_imports(spark, str(tmp_path), multi_line=True), "version", "pkg_path") == [("v1.0", "a/b")]


def test_third_party_usage(spark, rows):
    clients = spark.createDataFrame([("u", "v1", ["a/swag@@@swag", "b/c@@@c"])], "url string, version string, pkg_info array<string>")
    texts = ["func a/swag.New()", "var x a/swaggerx.T", "func other.F()", "func b/c.G()"]
    idents = spark.createDataFrame([("u", v, t) for v in ("v1", "v2") for t in texts], "server_url string, version string, obj_string string")
    assert rows(usage.third_party_usage(idents, clients), "version", "obj_string") == sorted(("v1", t) for t in texts if t != "func other.F()")
    assert rows(usage.third_party_usage(idents, clients, strict=True), "obj_string") == [("func a/swag.New()",), ("func b/c.G()",)]


def test_folders_of_a_client_version(spark, rows):
    """One version, two folders with other packages: by folder where identifiers tell it, else once for all lists."""
    clients = spark.createDataFrame([("u", "v1", "a", ["x/a@@@a"]), ("u", "v1", "b", ["x/b@@@b"])], "url string, version string, path string, pkg_info array<string>")
    data = [("u", "v1", "a", "func x/a.F()"), ("u", "v1", "a", "func x/b.F()"), ("u", "v1", "b", "func x/b.G(x/a.T)")]
    idents = spark.createDataFrame(data, "server_url string, version string, path string, obj_string string")
    assert rows(usage.third_party_usage(idents, clients), "path", "obj_string") == [("a", "func x/a.F()"), ("b", "func x/b.G(x/a.T)")]
    assert usage.third_party_usage(idents.drop("path"), clients).count() == 3


def test_strict_match_of_odd_paths(spark):
    df = spark.createDataFrame([(r"func a\E.b(a.b c)", [r"a\E.b"]), ("func xa/b.F()", ["a/b"]), ("a/b.F a/bc", ["a/b"])], "s string, p array<string>")
    assert [r[0] for r in df.select(usage.segment_match(F.col("s"), F.col("p"))).collect()] == [True, False, True]


def test_distinct_imports(spark, rows):
    df = spark.createDataFrame([("u", "v", "ddd", "dd.name"), ("u", "v", "ddd", "dd.name"), ("u", "v", "aaa", "aa.name")], "server_url string, version string, pkg_path string, pkg_name string")
    assert rows(usage.distinct_imports(df), "pkg_path") == [("aaa",), ("ddd",)]


DEPENDENCY = "module_name string, tag string, require_module_name string, require_module_version string, require_module_indirect boolean"


def test_graph(spark, rows):
    deps = spark.createDataFrame([("direct", "v1", "lib", "v2", False), ("indirect", "v1", "lib", "v2", True), ("nourl", "v1", "lib", "v2", False), ("none", "", "lib", "v2", False)], DEPENDENCY)
    nodes, edges = graph.upsert_module_graph(deps)
    again = graph.upsert_module_graph(deps, nodes, edges)
    assert rows(again[0], "name", "version") == rows(nodes, "name", "version")
    assert rows(again[1], *graph.EDGE_KEY) == rows(edges, *graph.EDGE_KEY)
    assert nodes.count() == 4 and edges.count() == 3
    known = spark.createDataFrame([("direct", "https://d"), ("indirect", "https://i")], "module string, server_url string")
    targets = spark.createDataFrame([("lib", "v2")], "name string, version string")
    with_urls = graph.with_urls(nodes, known)
    assert rows(graph.downstream_clients(with_urls, edges, targets), "client_name", "client_url") == [("direct", "https://d")]
    assert graph.downstream_clients(with_urls, edges, targets, compat=True).count() == 0


def test_record(spark, rows):
    data = [change("A", "removed"), change("B", "removed"), change("C", "removed"), change("D", "removed", new="v2.0.0"), change("E", "removed", old="v1.2.0", new="v1.1.9")]
    report = writers.to_change_report(spark.createDataFrame(data, CHANGE))
    long_form = record.changes_by_old_version(report)
    assert rows(long_form, "name", "url", "version", "change_node") == [("o/r", "https://github.com/o/r", "v1.0.0", n) for n in "ABC"]
    for slices in (None, 2):
        chunks = record.record_chunks(long_form, chunk_rows=2, slices=slices).orderBy("chunk").collect()
        assert [[d["change_node"] for d in c["details"]] for c in chunks] == [["A", "B"], ["C"]]
    assert record.record_map(record.record_chunks(long_form)).first()["incompatible"].keys() == {"v1.0.0"}
    assert rows(record.changes_by_old_version(report, compat=True), "change_node")[-1] == ("E",)


def release(n, tag, module="m", **facts):
    return {"rel_id": n, "module": module, "server_url": "u", "tag": tag, "tag_time": f"t{n}", "n_packages": 1, "n_kept": 1, **facts}


def test_adjacent_releases_skip_empty_and_emptied(spark):
    data = [
        release(1, "v1.0.0"), release(2, "v1.1.0", n_packages=0, n_kept=0), release(3, "v1.2.0"), release(4, "v1.10.0"),
        # Emptied releases: compared ones are no old side, so every second comparison falls away.
        release(11, "v1", "e", n_kept=0), release(12, "v2", "e", n_kept=0), release(13, "v3", "e", n_kept=0), release(14, "v4", "e"), release(15, "v5", "e"),
    ]
    df = spark.createDataFrame(data, "rel_id long, module string, server_url string, tag string, tag_time string, n_packages long, n_kept long")

    def brute(items):
        pairs, old, left = [], None, 0
        for r in items:
            if left > 0:
                pairs.append((old, r["rel_id"]))
            left = r["n_kept"] if left > 0 else r["n_packages"]
            old = r["rel_id"]
        return pairs

    want = sorted(brute(data[:4]) + brute(data[4:]))
    for slices in (None, 3):
        got = releases.adjacent_releases(df, slices)
        assert sorted((r.old_rel, r.new_rel) for r in got.collect()) == want


def test_previous_label_and_counts(spark, rows):
    data = [release(1, "v1.0.0"), release(2, "v1.0.1-bad.tag_"), release(3, "v1.1.0"), release(4, "v9", "alone")]
    df = spark.createDataFrame(data)
    valid = releases.valid_releases(df)
    pairs = releases.adjacent_releases(valid.drop("n_kept"))
    assert rows(pairs, "old_tag", "new_tag") == [("v1.0.0", "v1.1.0")]
    assert rows(releases.with_raw_old_label(pairs, df), "old_tag", "new_tag") == [("v1.0.1-bad.tag_", "v1.1.0")]
    assert rows(releases.enough_tags(valid), "rel_id") == [(1,), (3,)]
    assert releases.enough_tags(valid, compat=True).count() == 3


def test_complete_releases(spark, rows):
    df = spark.createDataFrame([release(1, "v1"), release(2, "v2")])
    packages = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "rel_id long, n_errors int")
    assert rows(releases.complete_releases(df, packages), "rel_id") == [(2,)]


def test_running_in_slices_with_one_hot_group(spark):
    """A group of a third of the rows is spread over tasks and gives what one window gives."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id", (F.col("id") % 7).alias("x"))
    options = dict(number="n", previous={"p": F.col("x")}, last_where={"l": (F.col("x") == 3, F.col("id"))})
    for slices in (1, 8):
        got = running(df, ["k"], ["id"], **options, slices=slices)
        earlier = Window.partitionBy("k").orderBy("id")
        mark = F.when(F.col("x") == 3, F.col("id"))
        plain = df.select("k", "id", "x", F.row_number().over(earlier).alias("n"), F.lag("x").over(earlier).alias("p"), F.last(mark, True).over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias("l"))
        assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_running_with_null_keys(spark):
    """Rows without a key are one group, in one slice or many."""
    df = spark.range(1000).select(F.lit(None).cast("string").alias("k"), F.lit(1).alias("j"), "id")
    for slices in (1, 8):
        assert [r.n for r in running(df, ["k", "j"], ["id"], number="n", slices=slices).orderBy("id").collect()] == list(range(1, 1001))
