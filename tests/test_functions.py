from pyspark.sql import functions as F

from apidrift.functions import text, versions, wording


def one(spark, expression, **values):
    """Value of an expression over one literal row."""
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expression.alias("v")).first()["v"]


def many(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


def test_server_name(spark):
    urls = ["https://github.com/0chain/zboxcli.git", "no-colon/x.git", "a:b:c.git", "x:y.git.git"]
    assert many(spark, text.server_name, urls) == ["__github.com_0chain_zboxcli", "", "b:c", "y.git"]


def test_report_file(spark):
    assert one(spark, text.report_file(F.lit("s"))) == "s_.csv"
    assert one(spark, text.report_file(F.lit("s"), F.lit("a/v1"))) == "s_@@@a_v1.csv"


def test_pkg_path_keeps_order_and_repeats(spark):
    names = ["migrate/v4/cockroachdb", "swag", "swag/gen", "migrate/v4/pgx", "swag"]
    entries = F.array(*[F.lit(f"github.com/{n}@@@{n.split('/')[-1]}") for n in names])
    assert one(spark, text.pkg_path(entries)) == [f"github.com/{n}" for n in names]


def test_strip_position(spark):
    assert many(spark, text.strip_position, ["/tmp/123/a/b.go:1:2", "a/b", "/tmp/1/x"]) == ["a/b.go:1:2", None, "x"]


def test_repo_name(spark):
    url = F.lit("https://github.com/0chain/zboxcli.git")
    assert one(spark, text.repo_name(url)) == "0chain/zboxcli"
    assert one(spark, text.repo_name(url, compat=True)) == "0chain/zbo"
    assert one(spark, text.repo_base_url(url)) == "https://github.com/0chain/zboxcli"


def test_obj_pkg_path(spark):
    assert one(spark, text.obj_pkg_path(F.lit('package core ("x.com/m/core")'))) == "x.com/m/core"


def test_semver_validity(spark):
    tags = ["v1.2.3", "1.2", "v1", "v01.2.3", "v1.2.3-rc.1", "v1.2.3-rc.01", "v1.2-rc", "v1.2.3+m.1", "release-1", "vv1.2.3"]
    want = [True, True, True, False, True, False, False, True, False, False]
    assert many(spark, versions.is_valid_semver, tags) == want
    compat = many(spark, lambda c: versions.is_valid_semver(c, compat=True), ["v1.2.3", "vv1.2.3", "1.2.3"])
    assert compat == [False, True, False]


def test_version_order(spark):
    tags = ["v1.0.0", "v1.0.0-rc1", "v1.2.0", "v1.10.0", "v2", "v123456789012345678901234", "v99999999999999999999999999"]
    df = spark.createDataFrame([(t,) for t in reversed(tags)], "tag string")
    got = [r["tag"] for r in df.orderBy(versions.version_sort_key(F.col("tag"))).collect()]
    assert got == ["v1.0.0", "v1.0.0-rc1", "v1.2.0", "v1.10.0", "v2", "v123456789012345678901234", "v99999999999999999999999999"]


def test_minor_or_patch(spark):
    pairs = [
        ("v1.2", "v1.2.2", True, "patch"),
        ("v1.2.3", "v1.3.0", True, "minor"),
        ("v1.2.3", "v2.0.0", False, "major"),
        ("v1.3.0", "v1.2.5", False, "downgrade"),
        ("v1.2.3", "v1.2.3", False, "same"),
        ("v1.2.3-rc1", "v1.2.3", False, "prerelease"),
        ("v1.2.3", "v1.2.4+incompatible", False, "prerelease"),
        ("1.2.3.4", "1.2.3.5", False, "invalid"),
        ("x", "v1.0.0", False, "invalid"),
    ]
    df = spark.createDataFrame([(i, o, n) for i, (o, n, _, _) in enumerate(pairs)], "i int, o string, n string")
    got = df.select("i", versions.is_minor_or_patch(F.col("o"), F.col("n")), versions.update_kind(F.col("o"), F.col("n"))).orderBy("i")
    assert [tuple(r)[1:] for r in got.collect()] == [(f, k) for _, _, f, k in pairs]
    assert one(spark, versions.is_minor_or_patch(F.lit("v1.3.0"), F.lit("v1.2.5"), compat=True))


def test_wording(spark):
    lit = F.lit
    assert one(spark, wording.change_message(lit("basic"), lit("int"), lit("string"))) == "basic changed from int to string"
    assert one(spark, wording.change_message(lit(""), lit("a"), lit("b"))) == "changed from a to b"
    assert one(spark, wording.object_node(lit("M"), lit("T"), lit(True))) == "(*T).M"
    assert one(spark, wording.object_node(lit("M"), lit("T"), lit(False))) == "T.M"
    assert one(spark, wording.object_node(lit("F"), lit(None).cast("string"), lit(False))) == "F"
    assert one(spark, wording.change_node(lit("T"), lit(", element"))) == "T"
    assert one(spark, wording.change_node(lit("T"), lit("A"))) == "T.A"
    assert one(spark, wording.change_text(lit(", element"), lit("x"))) == "element x"
    assert one(spark, wording.what_changed({"params": lit(False), "returns": lit(True), "variadic": lit(False)})) == "params|variadic"
    assert one(spark, wording.type_kind(F.array(lit("pointer"), lit("named"), lit("signature")))) == "pointer|named|function"
    assert one(spark, wording.type_kind(F.array(lit("odd")))) == "???"
    texts = F.array(lit("int"), lit("[]string"))
    assert one(spark, wording.signature_text(texts, F.array(lit("error")), lit(True))) == "func(int, ...string) error"
    none = F.array().cast("array<string>")
    assert one(spark, wording.signature_text(none, none, lit(False))) == "func()"
    assert many(spark, wording.is_exported, ["Über", "über", "A", "_A"]) == [True, False, True, False]
