"""Release and API tables in the engine's shape, derived from the order and line item tables.

A module is a customer, a release an order; API members come from the line items of the order.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from apidrift.operators.ordered import numbered

#: Line items that one task holds at a time, with what it groups them into.
LINES_PER_PARTITION = 250_000


def _pick(value: Column, *names: str) -> Column:
    """Name number ``value``; the last one stands for every higher number."""
    chosen = F.lit(names[-1])
    for index in reversed(range(len(names) - 1)):
        chosen = F.when(value == index, names[index]).otherwise(chosen)
    return chosen


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _underlying_kind(least: Column) -> Column:
    """Kind of a type whose smallest part is ``least``."""
    return _pick(least % 4, "basic", "chan", "interface", "struct")


def _with_package(members: DataFrame) -> DataFrame:
    s = F.col("s") % 4
    directory = (
        F.when(s == 0, "/core")
        .when(s == 1, "/client")
        .when(s == 2, "/cmd/tool")
        .otherwise(_text("/internal/x", F.col("p") % 2))
    )
    return members.select("*", _pick(s, "core", "client", "cmd", "main").alias("pkg_name"), directory.alias("pkg_dir"))


class StandIn:
    """Lazily built views over one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def release(self) -> DataFrame:
        orders = self.table("orders").select("o_custkey", "o_orderkey", "o_orderdate")
        n = F.col("_n") - 1
        key = F.col("o_orderkey")
        suffix = F.when(key % 11 == 0, "-rc1").when(key % 13 == 0, "+incompatible").otherwise("")
        version = _text("v", F.floor(n / 9), ".", F.floor(n / 3) % 3, ".", n % 3, suffix)
        return numbered(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "_n").select(
            key.alias("rel_id"),
            _text("github.com/c", F.col("o_custkey"), "/repo").alias("module"),
            _text("https://github.com/c", F.col("o_custkey"), "/repo.git").alias("server_url"),
            F.when(key % 19 == 0, _text("release-", n)).otherwise(version).alias("tag"),
            F.col("o_orderdate").cast("date").cast("string").alias("tag_time"),
            (key % 17 != 0).alias("has_go_mod"),
        )

    @cached_property
    def line(self) -> DataFrame:
        """API members without the tag: most tables need only the release number.

        They are dealt by release once, which serves the groupings below a release as well.
        """
        owner = self.table("orders").select(F.col("o_orderkey").alias("rel_id"), F.col("o_custkey").alias("custkey"))
        module = _text("github.com/c", F.col("custkey"), "/repo").alias("module")
        # Named once they are dealt like the lines: else the join would deal both anew, over the shuffle partitions.
        owner = owner.repartition(self.partitions, "rel_id").select("rel_id", module)
        # Without the hint owners are broadcast while their columns are small on disk; each task then holds all of them.
        dealt = self._dealt.join(owner.hint("merge"), "rel_id")
        named = _with_package(dealt.select(*self._numbers.columns, "module"))
        return named.withColumn("pkg_path", F.concat("module", "pkg_dir")).drop("pkg_dir")

    @cached_property
    def partitions(self) -> int:
        """Two for every core at least; more would cost small tables time."""
        least = 2 * self.spark.sparkContext.defaultParallelism
        return max(least, self.table("lineitem").count() // LINES_PER_PARTITION)

    @cached_property
    def release_partitions(self) -> int:
        """The same for rows of releases, one for every core at least."""
        return max(self.spark.sparkContext.defaultParallelism, self.table("orders").count() // LINES_PER_PARTITION)

    @cached_property
    def _numbers(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("rel_id"),
            F.col("l_partkey").alias("p"),
            F.col("l_suppkey").alias("s"),
            F.col("l_linenumber").alias("ln"),
            F.col("l_quantity").alias("q"),
            F.col("l_returnflag").alias("rf"),
        )

    @property
    def _dealt(self) -> DataFrame:
        """Line items by release. Only numbers travel, and the number of partitions goes by the rows: splits of files and
        adaptive execution go by compressed sizes, which such rows exceed many times over in the memory of a task.
        """
        return self._numbers.repartition(self.partitions, "rel_id")

    @cached_property
    def _members(self) -> DataFrame:
        return _with_package(self._dealt)

    @cached_property
    def tagged_line(self) -> DataFrame:
        return self.line.join(self.release.select("rel_id", "tag"), "rel_id")

    @cached_property
    def package(self) -> DataFrame:
        bad = F.max(F.when((F.col("ln") == 7) & (F.col("q") < 3), 1).otherwise(0))
        return self.line.groupBy("rel_id", "module", "pkg_name", "pkg_path").agg(bad.alias("n_errors"))

    @cached_property
    def api_object(self) -> DataFrame:
        name = F.concat(F.when(F.col("q") >= 45, "sym").otherwise("Sym"), (F.col("p") % 8).cast("string"))
        kind = (F.min("p") + F.min("ln")) % 4
        type_str = _text("T", F.min("ln") % 3)
        return (
            self.line.withColumn("obj_name", name)
            .groupBy("rel_id", "pkg_path", "obj_name")
            .agg(
                _pick(kind, "const", "var", "func", "type").alias("obj_kind"),
                type_str.alias("type_str"),
                (F.min("s") % 5).cast("string").alias("const_val"),
                (F.max("s") % 3 == 0).alias("third"),
            )
            .select(
                "rel_id",
                "pkg_path",
                "obj_name",
                F.col("obj_name").startswith("S").alias("exported"),
                "obj_kind",
                F.when(F.col("obj_kind") == "func", "function").otherwise("basic").alias("type_kind"),
                "type_str",
                F.col("type_str").alias("corr_key"),
                "const_val",
                F.lit(True).alias("const_known"),
                ((F.col("obj_kind") == "type") & F.col("third")).alias("is_alias"),
            )
        )

    def _owned(self, scope: list[str]) -> DataFrame:
        source = self.line if "pkg_path" in scope else self._members
        return source.withColumn("owner", _text("Type", F.col("s") % 3))

    def api_types(self, scope: list[str]) -> DataFrame:
        """Named types per release, or per package when ``pkg_path`` is in ``scope``."""
        kind = _underlying_kind(F.min("p"))
        basic = _pick(F.min("p") % 5, "uint8", "uint16", "int", "int64", "string")
        direction = _pick(F.min("ln") % 3, "both", "send", "recv")
        printed = (
            F.when(F.col("underlying_kind") == "basic", F.col("basic_name"))
            .when(
                F.col("underlying_kind") == "chan",
                F.concat(_channel(F.col("chan_dir")), F.lit(" "), F.col("basic_name")),
            )
            .when(F.col("underlying_kind") == "interface", "interface{...}")
            .otherwise("struct{...}")
        )
        return (
            self._owned(scope)
            .groupBy(*scope, F.col("owner").alias("type_name"))
            .agg(
                kind.alias("underlying_kind"),
                basic.alias("basic_name"),
                direction.alias("chan_dir"),
                (F.min("q") > 10).alias("comparable"),
            )
            .withColumns(
                {
                    "underlying_str": printed,
                    "underlying_corr_key": printed,
                    "elem_str": F.col("basic_name"),
                    "elem_corr_key": F.col("basic_name"),
                    "elem_kind": F.lit("basic"),
                }
            )
        )

    def api_fields(self, scope: list[str]) -> DataFrame:
        name = F.concat(F.when(F.col("q") >= 45, "f").otherwise("F"), (F.col("p") % 5).cast("string"))
        return (
            self._owned(scope)
            .withColumn("field_name", name)
            .groupBy(*scope, "owner", "field_name")
            .agg(
                _text("T", F.min("ln") % 3).alias("type_str"),
                F.max(F.col("ln") % 4 == 0).alias("embedded"),
                _text("Type", F.min("p") % 3).alias("embedded_owner"),
            )
            .withColumns(
                {
                    "exported": F.col("field_name").startswith("F"),
                    "type_kind": F.lit("basic"),
                    "corr_key": F.col("type_str"),
                }
            )
        )

    def api_methods(self, scope: list[str], *more: Column) -> DataFrame:
        name = F.concat(F.when(F.col("q") >= 45, "m").otherwise("M"), (F.col("p") % 5).cast("string"))
        return (
            self._owned(scope)
            .withColumn("method_name", name)
            .groupBy(*scope, "owner", "method_name")
            .agg(
                (F.min("ln") % 2 == 0).alias("ptr_receiver"),
                _text("func(T", F.min("ln") % 3, ")").alias("sig_str"),
                *more,
            )
            .withColumns(
                {
                    "exported": F.col("method_name").startswith("M"),
                    "in_value_set": ~F.col("ptr_receiver"),
                    "recv_named": F.col("owner"),
                    "recv_is_owner": F.lit(True),
                    "corr_key": F.col("sig_str"),
                }
            )
        )

    @cached_property
    def api_type(self) -> DataFrame:
        return self.api_types(["rel_id"])

    @cached_property
    def api_field(self) -> DataFrame:
        return self.api_fields(["rel_id"])

    @cached_property
    def api_method(self) -> DataFrame:
        return self.received_methods(["rel_id"])

    def received_methods(self, scope: list[str]) -> DataFrame:
        """With the kind of the receiver, found where the rows are: a join by owner would deal them anew."""
        key = [*scope, "owner"]
        named = self.api_methods(scope, F.min("p").alias("least")).dropna(subset=key)
        least = named.withColumn("least", F.min("least").over(Window.partitionBy(*key)))
        return least.withColumn("recv_kind", _underlying_kind(F.col("least"))).drop("least")

    @cached_property
    def api_type_node(self) -> DataFrame:
        """Type trees of the exported functions: one parameter per line item, one result in some."""
        line = self.line.filter(F.col("q") < 45).withColumn("root", _text("Sym", F.col("p") % 8))
        key = ["rel_id", "pkg_path", "root"]
        child = (
            line.groupBy(*key, F.col("ln"))
            .agg(F.min("s").alias("s"), F.min("p").alias("p"), F.max("s").alias("most"))
            .withColumn("slot", F.col("ln") - 1)
        )
        none = F.lit(None).cast("int")

        def node(path: Column, kind: Column, label: Column, variadic: Column) -> Column:
            return F.struct(F.lit("").alias("part"), path.cast("array<int>").alias("path"), kind.alias("node_kind"), label.alias("label"), variadic.alias("variadic"))

        def nodes(df: DataFrame, rows: list[Column]) -> DataFrame:
            found = df.select(*key, F.explode(F.array(*rows)).alias("n"))
            return found.filter(F.col("n").isNotNull()).select(*key, "n.*")

        roots = child.groupBy(*key).agg(F.min("p").alias("p"), F.max("most").alias("s"))
        blank = F.lit("")
        no = F.lit(False)
        ints = lambda *slots: F.array(*[s if isinstance(s, Column) else F.lit(s) for s in slots])
        error = F.when(F.col("s") % 2 == 0, node(ints(1, 0), F.lit("basic"), F.lit("error"), no))
        top = [
            node(F.array().cast("array<int>"), F.lit("signature"), blank, F.col("p") % 7 == 0),
            node(ints(0), F.lit("tuple"), blank, no),
            node(ints(1), F.lit("tuple"), blank, no),
            error,
        ]
        pointer = F.col("p") % 3 == 0
        label = F.when(pointer, "").otherwise(_text("t", F.col("s") % 2))
        below = [
            node(ints(0, F.col("slot")), F.when(pointer, "pointer").otherwise("basic"), label, no),
            F.when(pointer, node(ints(0, F.col("slot"), 0), F.lit("named"), _text("Type", F.col("s") % 3), no)),
        ]
        out = nodes(roots, top).unionByName(nodes(child, below))
        return out.withColumns(
            {
                "named_pkg": F.when(F.col("node_kind") == "named", "").otherwise(None),
                "array_len": none.cast("bigint"),
                "field_name": F.lit(None).cast("string"),
                "exported": F.lit(None).cast("boolean"),
                "embedded": no,
                "struct_tag": F.lit(None).cast("string"),
            }
        )

    @cached_property
    def dependency(self) -> DataFrame:
        return self.tagged_line.select(
            F.col("module").alias("module_name"),
            F.lit("1.19").alias("go_version"),
            F.when(F.col("p") % 29 == 0, "").otherwise(F.col("tag")).alias("tag"),
            F.lit("").alias("tag_time"),
            _text("github.com/c", F.col("p") % 100, "/repo").alias("require_module_name"),
            _text("v0.", F.col("s") % 3, ".", F.col("ln") % 3).alias("require_module_version"),
            (F.col("rf") == "R").alias("require_module_indirect"),
        )

    @cached_property
    def identifier(self) -> DataFrame:
        p, s, ln = F.col("p") % 100, F.col("s"), F.col("ln")
        local = s % 9 == 0
        return self.tagged_line.select(
            F.col("module").alias("server_url"),
            F.col("tag").alias("version"),
            F.when(ln % 2 == 0, "defs").otherwise("uses").alias("var_type"),
            _text("/tmp/", F.col("rel_id"), "/src/a", ln, ".go:", ln, ":1").alias("id_pos"),
            _text("Sym", s % 8).alias("obj_name"),
            F.when(~local, _text('package core ("github.com/c', p, '/repo/core")')).alias("obj_pkg"),
            F.when(local, "var x int")
            .otherwise(_text("func github.com/c", p, "/repo/core.Sym", s % 8, "()"))
            .alias("obj_string"),
        )

    @cached_property
    def client_version(self) -> DataFrame:
        """Client versions with the third-party packages they ask about, one entry per required module."""
        entry = F.concat(F.col("require_module_name"), F.lit("/core@@@core"))
        # The name space of required modules has a fixed size, so the sets stay small.
        return (
            self.dependency.filter(~F.col("require_module_indirect"))
            .groupBy(F.col("module_name").alias("url"), F.col("tag").alias("version"))
            .agg(F.sort_array(F.collect_set(entry)).alias("pkg_info"))
            .withColumn("path", F.lit(""))
        )


def _channel(direction: Column) -> Column:
    return F.when(direction == "send", "chan<-").when(direction == "recv", "<-chan").otherwise("chan")
