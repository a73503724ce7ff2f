"""Queries named in the findings of round 4: what travels, what is stored, and rows on small tables made here."""

import pytest
from pyspark.sql import functions as F
from test_findings_r03 import both, write_tables

from apidrift import session
from apidrift.operators import correspondence, diff, messages, ordered, types
from apidrift.plans import catalog
from apidrift.plans.pipelines import Comparison
from apidrift.sources import readers, writers
from apidrift.sources.batches import BatchStore

OBJECT = "pair_id long, pkg_path string, side string, obj_name string, exported boolean, obj_kind string, type_kind string, type_str string, corr_key string, const_val string, const_known boolean, is_alias boolean"


def exchanges(df):
    """How often the planner deals rows on its own account for ``df``."""
    return df._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS")


def test_objects_are_dealt_once(spark, rows):
    """F7, F9-F12: dealt by pair, objects need no further dealing to choose between messages."""
    row = lambda pair, side, name, kind: (pair, "p", side, name, True, kind, "basic", "T0", "T0", "1", True, False)
    data = [row(n, side, f"S{k}", "var" if (n + k) % 3 or side == "old" else "const") for n in range(9) for k in range(4) for side in ("old", "new")]
    data += [row(n, "old", "Gone", "var") for n in range(9)] + [row(None, "new", "Come", "var")]
    sided = spark.createDataFrame(data, OBJECT)
    scope = ["pair_id", "pkg_path"]
    kept, dealt = [
        messages.dedupe_messages(diff.check_objects(diff.diff_objects(sided, scope, *near), scope), scope) for near in ((), (["pair_id"], 3))
    ]
    assert exchanges(kept) > exchanges(dealt) == 0
    columns = ["pair_id", "pkg_path", "obj_key", "message", "compatible", "cause"]
    found = [sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) for df in (kept, dealt)]
    assert found[0] == found[1] and len(found[0]) > 20


def test_stored_reports_are_packed(spark, tmp_path, monkeypatch):
    """report files are packed, and none holds more rows than one task should read."""
    monkeypatch.setitem(writers.STORE_OPTIONS, "maxRecordsPerFile", 40)
    columns = [f.replace("olg_", "old_").replace("changedObject", "changed_object").replace("changedType", "changed_type").replace("changeMessage", "change_message") for f in readers.CHANGE_REPORT_COLUMNS if f not in ("server_name", "change_node")]
    changes = spark.range(300).select(F.concat(F.lit("N"), F.col("id").cast("string")).alias("change_node"), *[F.lit("https://github.com/o/r.git").alias(c) for c in columns])
    path = str(tmp_path / "report")
    for _ in range(2):
        writers.write_change_report(changes, path, 0)
    store = BatchStore(spark, path)
    attempt = store.batches()["0"]
    files = list((tmp_path / "report" / "rows" / attempt).glob("bucket=*/part-*"))
    assert len(files) >= 300 / 40 and all(f.name.endswith(".csv.gz") for f in files)
    assert readers.read_change_report(spark, path).select("change_node").distinct().count() == 300


@pytest.mark.parametrize("marks", [False, True])
def test_slices_hand_on_their_ends(spark, rows, marks):
    """Groups that run over many slices, with missing keys: numbers and the row before are those of a plain count."""
    data = [("a" if n % 5 else None, f"{n:04d}", n) for n in range(300)]
    df = spark.createDataFrame(data, "g string, o string, v int").repartition(7)
    more = {"last_where": {"even": (F.col("v") % 2 == 0, F.col("v"))}} if marks else {}
    got = ordered.running(df, ["g"], ["o"], number="n", previous={"prev": F.col("v")}, slices=6, **more)
    expected, seen, last = [], {}, {}
    for g, o, v in sorted(data, key=lambda r: r[1]):
        before = seen.setdefault(g, [])
        expected.append((v, len(before) + 1, before[-1] if before else None) + ((last.get(g),) if marks else ()))
        before.append(v)
        if v % 2 == 0:
            last[g] = v
    names = ["v", "n", "prev"] + (["even"] if marks else [])
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(expected)


@pytest.fixture
def merged(spark):
    """Joins of small tables as those of large ones."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tables_dealt_by_release_stay_in_place(spark, merged):
    """F1-F4, F6: tables that are dealt by release meet the packages of pairs where they are, and are dealt by pair once."""
    paths = lambda n: f"o/{n}"
    packages = spark.createDataFrame([(p, f"n{k}", paths(k), paths(k + p % 2), "both" if k else "added", p, p + 1) for p in range(20) for k in range(3)], "pair_id long, pkg_name string, old_pkg_path string, new_pkg_path string, status string, old_rel long, new_rel long")
    table = spark.createDataFrame([(r, paths(k), f"T{n}", n) for r in [*range(22), None] for k in range(4) for n in range(5)], "rel_id long, pkg_path string, type_name string, v long")
    one = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
    plain = Comparison(None, packages).scoped(table)
    comparison = Comparison(None, packages, 3)
    key = ["pair_id", "pkg_name", "side", "type_name"]
    names = spark.createDataFrame(plain.select(*key).distinct().collect(), "pair_id long, pkg_name string, side string, type_name string")
    before = spark.conf.get(session.WHOLE_KEYS_CONF)
    with session.joins_in_place(spark):
        dealt = comparison.by_pair(comparison.scoped(table.repartition(3, "rel_id")))
        met = types.align_types(dealt.join(comparison.by_pair(names), key).withColumnRenamed("v", "basic_name"), near=())
        assert exchanges(dealt) == 0 and exchanges(met) == 0
    assert spark.conf.get(session.WHOLE_KEYS_CONF) == before and exchanges(plain) > 0
    assert one(dealt) == one(plain) and len(one(plain)) > 100
    assert one(met) == one(types.align_types(plain.withColumnRenamed("v", "basic_name"))) and met.count()


def test_sides_of_aligned_trees(spark):
    """F1-F6: the trees of each side come out of the aligned ones as they went in, so they are written once."""
    node = lambda side, root, path, kind, label: (1, "p", side, root, "", path, kind, label, None, 7 if kind == "array" else None)
    data = [node("old", "A", [], "signature", ""), node("old", "A", [0], "named", "T"), node("new", "A", [], "array", ""), node("new", "B", [], "basic", "int"), node("old", None, [], "basic", "x")]
    sided = spark.createDataFrame(data, "pair_id long, pkg_name string, side string, root string, part string, path array<int>, node_kind string, label string, named_pkg string, array_len long")
    aligned = correspondence.align_trees(sided)
    again = correspondence.sided_trees(aligned)
    assert sorted(map(repr, again.select(*sided.columns).collect())) == sorted(map(repr, sided.collect()))


def test_correspondence_writes_trees_once(spark, tmp_path, monkeypatch):
    """trees are written side by side alone, and no facts of types travel to tell which there are."""
    orders = [(n, n % 3, f"2020-01-{n % 28 + 1:02d}") for n in range(1, 25)]
    lines = [(n, n * 7 + k * 3, n + k, k, float((n * k * 5) % 50 + 1)) for n, _, _ in orders for k in range(1, 2 + n % 7)]
    folder = write_tables(spark, str(tmp_path), orders, lines)
    written, aligned = [], []
    write, align = catalog.materialize, types.align_types
    monkeypatch.setattr(catalog, "materialize", lambda df, label, *more: written.append(label) or write(df, label, *more))
    monkeypatch.setattr(types, "align_types", lambda sided, *more: aligned.append(sided.columns) or align(sided, *more))
    got, expected = both(spark, "establish_correspondence", folder)
    assert got == expected and got
    assert "aligned-nodes" in written and "nodes" not in written and "underlying_str" not in aligned[0]
