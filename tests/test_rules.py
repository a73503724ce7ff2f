"""One literal case per compatibility rule."""

from pyspark.sql import functions as F

from apidrift.operators import correspondence, diff, messages, satisfaction, types

SCOPE = ["pair_id"]
OBJECT = "pair_id int, side string, obj_name string, exported boolean, obj_kind string, type_kind string, type_str string, corr_key string, const_val string, const_known boolean"
TYPE = "pair_id int, side string, type_name string, underlying_kind string, underlying_str string, underlying_corr_key string, comparable boolean, chan_dir string, elem_str string, elem_corr_key string, elem_kind string, basic_name string"
METHOD = "pair_id int, side string, owner string, method_name string, exported boolean, in_value_set boolean, ptr_receiver boolean, recv_named string, recv_kind string, recv_is_owner boolean, sig_str string, corr_key string"
FIELD = "pair_id int, side string, owner string, field_name string, exported boolean, embedded boolean, embedded_owner string, type_str string, type_kind string, corr_key string"


def reported(rows_df, compat=False):
    changes = messages.as_changes(messages.dedupe_messages(rows_df, SCOPE, compat), SCOPE)
    return sorted((r.change_node, r.change_message, r.compatible) for r in changes.collect())


def objects(spark, *cases):
    """(side, name, kind, type, value) rows."""
    data = []
    for side, name, kind, type_str, value in cases:
        shown = "function" if type_str.startswith("func") else "basic"
        data.append((1, side, name, name[0].isupper(), kind, shown, type_str, type_str, value, value not in (None, "unknown")))
    return spark.createDataFrame(data, OBJECT)


def test_object_rules(spark):
    sided = objects(
        spark,
        ("old", "Gone", "func", "func()", None),
        ("new", "Come", "var", "int", None),
        ("old", "ToVar", "func", "func()", None), ("new", "ToVar", "var", "func()", None),
        ("old", "ToOther", "func", "func()", None), ("new", "ToOther", "var", "int", None),
        ("old", "Kind", "var", "int", None), ("new", "Kind", "const", "int", "1"),
        ("old", "Value", "const", "int", "1"), ("new", "Value", "const", "int", "2"),
        ("old", "Unknown", "const", "int", "unknown"), ("new", "Unknown", "const", "int", "unknown"),
        ("old", "ConstType", "const", "int", "1"), ("new", "ConstType", "const", "string", "2"),
        ("old", "V", "var", "int", None), ("new", "V", "var", "string", None),
        ("old", "Same", "var", "int", None), ("new", "Same", "var", "int", None),
        ("old", "hidden", "var", "int", None),
    )
    got = reported(diff.check_objects(diff.diff_objects(sided, SCOPE), SCOPE))
    assert got == sorted([
        ("Gone", "removed", False),
        ("Come", "added", True),
        ("ToVar", "changed from func to var", True),
        ("ToOther", "changed from func to var", True),
        ("ToOther", "changed from func() to int", False),
        ("Kind", "changed from var to const", False),
        ("Value", "value changed from 1 to 2", False),
        ("Unknown", "value changed from unknown to unknown", False),
        ("ConstType", "changed from int to string", False),
        ("V", "basic changed from int to string", False),
    ])


def test_equal_sides_and_swapped_sides(spark):
    base = objects(spark, ("old", "A", "var", "int", None), ("old", "B", "func", "func()", None), ("old", "C", "const", "int", "1"))
    same = base.unionByName(base.withColumn("side", F.lit("new")))
    assert reported(diff.check_objects(diff.diff_objects(same, SCOPE), SCOPE)) == []
    mixed = objects(spark, ("old", "A", "var", "int", None), ("new", "B", "var", "int", None))
    swapped = mixed.withColumn("side", F.when(F.col("side") == "old", "new").otherwise("old"))
    assert reported(diff.check_objects(diff.diff_objects(mixed, SCOPE), SCOPE)) == [("A", "removed", False), ("B", "added", True)]
    assert reported(diff.check_objects(diff.diff_objects(swapped, SCOPE), SCOPE)) == [("A", "added", True), ("B", "removed", False)]


def named(spark, *cases):
    """(side, name, kind, text, comparable, direction, element) rows."""
    data = [
        (1, side, name, kind, shown, shown, comparable, direction, element, element, "basic", shown if kind == "basic" else None)
        for side, name, kind, shown, comparable, direction, element in cases
    ]
    return spark.createDataFrame(data, TYPE)


def test_named_type_rules(spark):
    sided = named(
        spark,
        ("old", "Open", "chan", "chan<- int", True, "send", "int"), ("new", "Open", "chan", "chan int", True, "both", "int"),
        ("old", "Turn", "chan", "chan int", True, "both", "int"), ("new", "Turn", "chan", "<-chan int", True, "recv", "int"),
        ("old", "Elem", "chan", "chan int", True, "both", "int"), ("new", "Elem", "chan", "chan string", True, "both", "string"),
        ("old", "Wide", "basic", "uint8", True, None, None), ("new", "Wide", "basic", "uint16", True, None, None),
        ("old", "Narrow", "basic", "uint8", True, None, None), ("new", "Narrow", "basic", "int8", True, None, None),
        ("old", "Kind", "struct", "struct{}", True, None, None), ("new", "Kind", "interface", "interface{}", True, None, None),
        ("old", "Comp", "struct", "struct{A int}", True, None, None), ("new", "Comp", "struct", "struct{A []int}", False, None, None),
        ("old", "Plain", "slice", "[]int", False, None, None), ("new", "Plain", "slice", "[]string", False, None, None),
    )
    assert reported(types.check_named_types(types.align_types(sided, SCOPE), SCOPE)) == sorted([
        ("Open", "removed direction", True),
        ("Turn", "changed direction", False),
        ("Elem", "element basic changed from int to string", False),
        ("Wide", "changed from uint8 to uint16", True),
        ("Narrow", "changed from uint8 to int8", False),
        ("Kind", "changed from struct{} to interface{}", False),
        ("Comp", "old is comparable, new is not", False),
        ("Plain", "changed from []int to []string", False),
    ])


def test_all_widenings(spark):
    assert types.widening_pairs(spark).count() == 22


def fields(spark, *cases):
    """(side, owner, name, type, embedded owner) rows."""
    data = [
        (1, side, owner, name, name[0].isupper(), target is not None, target, shown, "basic", shown)
        for side, owner, name, shown, target in cases
    ]
    return spark.createDataFrame(data, FIELD)


def test_selectable_fields(spark, rows):
    table = fields(
        spark,
        ("old", "S", "A", "int", None), ("old", "S", "Base", "Base", "Base"), ("old", "S", "other", "*Other", "Other"),
        ("old", "Base", "A", "string", None), ("old", "Base", "B", "int", None), ("old", "Base", "X", "int", None),
        ("old", "Other", "X", "int", None), ("old", "Other", "S", "S", "S"), ("old", "Other", "Deep", "Deep", "Deep"),
        ("old", "Deep", "X", "bool", None), ("old", "Deep", "B", "bool", None),
    )
    got = types.exported_selectable_fields(table, ["pair_id", "side"]).filter("owner = 'S'")
    # X is ambiguous one level down and so is taken from the level below; S does not enter itself again.
    assert rows(got, "field_name", "type_str", "depth") == sorted([
        ("A", "int", 0), ("Base", "Base", 0), ("B", "int", 1), ("Deep", "Deep", 1), ("S", "S", 1), ("X", "bool", 2),
    ])


def test_struct_rules(spark):
    sided = fields(
        spark,
        ("old", "S", "Gone", "int", None), ("new", "S", "Come", "int", None),
        ("old", "S", "T", "int", None), ("new", "S", "T", "string", None),
        ("old", "S", "Sunk", "int", None), ("new", "S", "Base", "Base", "Base"), ("new", "Base", "Sunk", "int", None),
    )
    selectable = types.exported_selectable_fields(sided, ["pair_id", "side"]).filter("owner = 'S'")
    assert reported(types.diff_fields(selectable, SCOPE)) == sorted([
        ("S.Gone", "removed", False),
        ("S.Come", "added", True),
        ("S.T", "basic changed from int to string", False),
        ("S.Sunk", "removed", False),
        ("S.Base", "added", True),
    ])


def methods(spark, *cases):
    """(side, owner, name, pointer, signature, receiver, kind) rows."""
    data = [
        (1, side, owner, name, name[0].isupper(), not pointer, pointer, receiver or owner, kind, receiver in (None, owner), sig, sig)
        for side, owner, name, pointer, sig, receiver, kind in cases
    ]
    return spark.createDataFrame(data, METHOD)


def test_method_rules(spark):
    sided = methods(
        spark,
        ("old", "T", "Gone", True, "func()", None, "struct"),
        ("new", "T", "Come", False, "func()", None, "struct"),
        ("old", "T", "Sig", False, "func()", None, "struct"), ("new", "T", "Sig", False, "func(int)", None, "struct"),
        ("old", "T", "Moved", False, "func()", None, "struct"), ("new", "T", "Moved", True, "func(int)", None, "struct"),
        ("old", "U", "M", False, "func()", "Base", "struct"), ("old", "Base", "M", False, "func()", None, "struct"),
        ("old", "T", "hidden", False, "func()", None, "struct"),
    )
    assert reported(types.diff_methods(sided, SCOPE)) == sorted([
        ("(*T).Gone", "struct method removed", False),
        ("T.Come", "struct method added", True),
        ("T.Sig", "struct method changed from func() to func(int)", False),
        ("T.Moved", "struct method removed", False),
        ("(*T).Moved", "struct method changed from func() to func(int)", False),
        ("Base.M", "struct method removed", False),
        ("Base.M", "method set of U removed", False),
        ("Base.M", "method set of *U removed", False),
    ])


def faces(spark, *names, kind="interface"):
    data = [(s, n, kind, f"{kind}{{}}", True, None, None) for n in names for s in ("old", "new")]
    return named(spark, *data)


def test_interface_rules(spark):
    sided = methods(
        spark,
        ("old", "I", "A", False, "func()", None, "interface"), ("new", "I", "A", False, "func()", None, "interface"),
        ("new", "I", "M", False, "func()", None, "interface"), ("new", "I", "sealed", False, "func()", None, "interface"),
        ("old", "J", "own", False, "func()", None, "interface"), ("new", "J", "M", False, "func()", None, "interface"),
    )
    aligned = types.align_types(faces(spark, "I", "J"), SCOPE)
    assert reported(types.check_interfaces(aligned, sided, SCOPE)) == sorted([
        ("I.M", "interface method added", False),
        ("I.sealed", "added unexported method", False),
        ("J.M", "interface method added", True),
    ])


def test_methods_of_embedded_interfaces_name_one_set(spark):
    """A method that came by embedding another interface names the method set, which has no star."""
    sided = methods(spark, ("old", "I", "Close", False, "func()", "Closer", "interface"), ("new", "I", "Own", False, "func()", None, "interface"), ("old", "I", "Own", False, "func()", None, "interface"))
    aligned = types.align_types(faces(spark, "I"), SCOPE)
    assert reported(types.check_interfaces(aligned, sided, SCOPE)) == [("Closer.Close", "method set of I removed", False)]


def test_lost_implementations(spark, rows):
    kinds = faces(spark, "I", "Void", "Grows").unionByName(faces(spark, "T", "U", "W", kind="struct"))
    both = [("old", "I", "M", False, "func()", None, "interface"), ("new", "I", "M", False, "func()", None, "interface")]
    sided = methods(
        spark,
        *both,
        ("old", "T", "M", False, "func()", None, "struct"),
        ("old", "U", "M", False, "func()", None, "struct"), ("new", "U", "M", False, "func()", None, "struct"),
        ("old", "W", "M", False, "func()", None, "struct"), ("new", "W", "M", True, "func()", None, "struct"),
        ("new", "Void", "N", False, "func()", None, "interface"),
        ("old", "Grows", "M", False, "func()", None, "interface"), ("new", "Grows", "M", False, "func()", None, "interface"),
        ("new", "Grows", "K", False, "func()", None, "interface"),
    )
    got = satisfaction.no_longer_implements(types.align_types(kinds, SCOPE), sided, SCOPE)
    everyone_else = [(o, "Void") for o in ("I", "Grows", "T", "U", "W")]
    assert rows(got, "owner", "face") == sorted(
        [("T", "I"), ("W", "I"), ("T", "Grows"), ("U", "Grows"), ("W", "Grows"), ("I", "Grows"), *everyone_else]
    )
    # Of the interfaces without methods, Grown is implemented by Fit alone, Void by none; a face never breaks itself.
    more = kinds.unionByName(faces(spark, "Grown")).unionByName(faces(spark, "Fit", kind="struct"))
    wider = sided.unionByName(methods(spark, ("new", "Grown", "G", False, "func()", None, "interface"), ("new", "Fit", "G", False, "func()", None, "struct")))
    aligned = types.align_types(more, SCOPE)
    whole, first = (satisfaction.no_longer_implements(aligned, wider, SCOPE, smallest_void=s) for s in (False, True))
    void = {"Void", "Grown"}
    smallest = {}
    for owner, face in rows(whole, "owner", "face"):
        if face in void:
            smallest[owner] = min(face, smallest.get(owner, face))
    assert smallest["Fit"] == "Void" and smallest["T"] == "Grown" and smallest["Grown"] == "Void"
    rest = [(o, f) for o, f in rows(whole, "owner", "face") if f not in void]
    assert rows(first, "owner", "face") == sorted([*rest, *smallest.items()])
    one = reported(satisfaction.satisfaction_changes(got.filter("owner = 'T' and face = 'I'"), SCOPE))
    assert one == [("T", "no longer implements I", False)]


def test_dedupe_picks_one_row_per_part(spark, rows):
    data = [
        (1, "T", "T", "type", "", "struct", "old is comparable, new is not", False, "comparable", 5),
        (1, "T", "T", "type", "", "named|struct", "no longer implements I", False, "implements", 8),
        (1, "T", "T", "type", "A", "basic", "removed", False, "removed", 4),
    ]
    df = spark.createDataFrame(data, "pair_id int, obj_key string, node string, object_kind string, part string, changed_type string, message string, compatible boolean, cause string, step int")
    assert rows(messages.dedupe_messages(df, SCOPE), "part", "message") == [("", "old is comparable, new is not"), ("A", "removed")]
    assert rows(messages.dedupe_messages(df, SCOPE, compat=True), "part", "message") == [("", "no longer implements I"), ("A", "removed")]


def test_report_lines(spark):
    data = [(1, True, "B", "added"), (1, False, "A", "removed")]
    df = spark.createDataFrame(data, "pair_id int, compatible boolean, change_node string, change_message string")
    lines = messages.report_lines(df, SCOPE).orderBy("section", "line_kind", "node", "line")
    assert [r["line"] for r in lines.collect()] == ["Incompatible changes:", "- removed", "Compatible changes:", "- added"]


def test_fields_of_foreign_embedded_structs(spark, rows):
    """Three levels: own Outer embeds lib.Mid, which embeds lib.Deep, which embeds own.Tail back by its path."""
    row = "pair_id int, side string, owner string, field_name string, exported boolean, embedded boolean, embedded_owner string, embedded_pkg string, type_str string, type_kind string, corr_key string"
    own = [
        ("Outer", "Mid", True, "Mid", "x/lib"), ("Outer", "A", False, None, None), ("Other", "Mid", True, "Mid", None), ("Tail", "Z", False, None, None),
    ]
    lib = [("x/lib", "Mid", "B", False, None, None), ("x/lib", "Mid", "A", False, None, None), ("x/lib", "Mid", "Deep", True, "Deep", ""), ("x/lib", "Deep", "C", False, None, None), ("x/lib", "Deep", "Tail", True, "Tail", "m/own"), ("m/own", "Tail", "Z", False, None, None)]
    fields = spark.createDataFrame([(1, "old", o, n, True, e, t, p, "T", "basic", "T") for o, n, e, t, p in own], row)
    foreign = spark.createDataFrame([(1, "old", h, o, n, True, e, t, p, "T", "basic", "T") for h, o, n, e, t, p in lib], row.replace("owner string", "home string, owner string", 1))
    got = types.exported_selectable_fields(fields, ["pair_id", "side"], None, foreign)
    want = [("A", 0), ("B", 1), ("C", 2), ("Deep", 1), ("Mid", 0), ("Tail", 2), ("Z", 3)]
    assert rows(got.filter("owner = 'Outer'"), "field_name", "depth") == want
    assert rows(got.filter("owner = 'Other'"), "field_name") == [("Mid",)]
    alone = types.exported_selectable_fields(fields, ["pair_id", "side"])
    assert rows(alone.filter("owner = 'Outer'"), "field_name") == [("A",), ("Mid",)]


# --- type trees --------------------------------------------------------------------------------------

NODE = "pair_id int, side string, root string, part string, path array<int>, node_kind string, label string, named_pkg string, array_len bigint, variadic boolean, field_name string, embedded boolean, struct_tag string"


def tree(side, root, *nodes, part=""):
    """Rows of (path, kind, label[, facts])."""
    out = []
    for path, kind, label, *facts in nodes:
        known = {"named_pkg": "" if kind == "named" else None, "array_len": None, "variadic": False, "field_name": None, "embedded": False, "struct_tag": None}
        known.update(facts[0] if facts else {})
        out.append((1, side, root, part, path, kind, label, *known.values()))
    return out


def causes(spark, old, new, type_corr=None):
    df = spark.createDataFrame([*tree("old", "X", *old), *tree("new", "X", *new)], NODE)
    row = correspondence.compare_types(df, SCOPE, type_corr).first()
    return row["corresponds"], row["type_cause"]


def signature(params, results, variadic=False):
    head = [([], "signature", "", {"variadic": variadic}), ([0], "tuple", ""), ([1], "tuple", "")]
    return head + [([0, i], "basic", p) for i, p in enumerate(params)] + [([1, i], "basic", r) for i, r in enumerate(results)]


def struct(*members):
    """(name, type[, facts]) members."""
    return [([], "struct", "")] + [([i], "basic", t, {"field_name": n, **(f[0] if f else {})}) for i, (n, t, *f) in enumerate(members)]


def test_causes(spark):
    basic = lambda t: [([], "basic", t)]
    array = lambda t, n: [([], "array", "", {"array_len": n}), ([0], "basic", t)]
    unary = lambda kind, t: [([], kind, ""), ([0], "basic", t)]
    mapping = lambda k, v: [([], "map", ""), ([0], "basic", k), ([1], "basic", v)]
    face = lambda *ms: [([], "interface", "")] + [n for i, (name, p) in enumerate(ms) for n in (([i], "signature", "", {"field_name": name}), ([i, 0], "tuple", ""), ([i, 1], "tuple", ""), ([i, 0, 0], "basic", p))]
    cases = [
        (basic("int"), basic("int"), (True, None)),
        (basic("int"), unary("slice", "int"), (False, "basic")),
        (unary("slice", "int"), basic("int"), (False, "")),
        (array("int", 2), array("string", 3), (False, "element|length")),
        (array("int", 2), array("int", 3), (False, "length")),
        (unary("slice", "int"), unary("slice", "bool"), (False, "element")),
        (unary("pointer", "int"), unary("pointer", "bool"), (False, "base")),
        (unary("chan", "int"), unary("chan", "bool"), (False, "element")),
        (mapping("a", "b"), mapping("c", "d"), (False, "key|element")),
        (signature(["int"], []), signature(["string"], ["error"]), (False, "params|returns")),
        (signature(["int"], []), signature(["int"], [], True), (False, "variadic")),
        (struct(("A", "int")), struct(("A", "int"), ("B", "int")), (False, "fieldNumber")),
        (struct(("A", "int")), struct(("A", "bool")), (False, "fieldType")),
        (struct(("A", "int")), struct(("B", "int")), (False, "fieldNames")),
        (struct(("A", "int", {"struct_tag": "x"})), struct(("A", "bool", {"struct_tag": "y"})), (False, "fieldTag")),
        (struct(("A", "int"), ("B", "int")), struct(("A", "int", {"embedded": True}), ("B", "bool")), (False, "fieldAnonymous")),
        (face(("A", "int")), face(("A", "int"), ("B", "int")), (False, "methodNumber")),
        (face(("A", "int")), face(("B", "int")), (False, "methodID")),
        (face(("A", "int")), face(("A", "bool")), (False, "params")),
        ([([], "named", "T")], [([], "named", "T")], (True, None)),
        ([([], "named", "T")], [([], "named", "U")], (False, "")),
    ]
    for old, new, want in cases:
        assert causes(spark, old, new) == want, (old, new)


def test_foreign_unexported_names_keep_their_path(spark):
    named_in = lambda pkg, label: [([], "named", label, {"named_pkg": pkg})]
    assert causes(spark, named_in("a/x", "T"), named_in("b/x", "T"))[0]
    assert not causes(spark, named_in("a/x", "t"), named_in("b/x", "t"))[0]


def test_type_kinds(spark, rows):
    data = tree("old", "P", ([], "pointer", ""), ([0], "pointer", ""), ([0, 0], "signature", ""), ([0, 0, 0], "tuple", ""))
    got = correspondence.type_kinds(spark.createDataFrame(data, NODE), SCOPE)
    assert rows(got, "root", "type_kind") == [("P", "pointer|pointer|function")]


def test_renamed_types(spark, rows):
    use = lambda name: [([], "signature", ""), ([0], "tuple", ""), ([1], "tuple", ""), ([0, 0], "named", name)]
    data = [
        *tree("old", "F", *use("OldT")), *tree("new", "F", *use("NewT")),
        # A later use of the old type under its old name does not agree with the first.
        *tree("old", "G", *use("OldT")), *tree("new", "G", *use("OldT")),
        # Found through a field of the renamed type, and recursive.
        *tree("old", "OldT", ([], "named", "inner"), part="In"), *tree("new", "NewT", ([], "named", "core"), part="In"),
        *tree("old", "inner", ([], "named", "inner"), part="Next"), *tree("new", "core", ([], "named", "core"), part="Next"),
        # After a parameter of another shape nothing more is met.
        *tree("old", "H", ([], "signature", ""), ([0], "tuple", ""), ([1], "tuple", ""), ([0, 0], "basic", "int"), ([0, 1], "named", "Late")),
        *tree("new", "H", ([], "signature", ""), ([0], "tuple", ""), ([1], "tuple", ""), ([0, 0], "basic", "bool"), ([0, 1], "named", "Late")),
        *tree("old", "V", ([], "named", "Num")), *tree("new", "V", ([], "basic", "int")),
    ]
    objects = spark.createDataFrame([(1, n, "func", "func") for n in ("F", "G", "H")] + [(1, "V", "var", "var"), (1, "Same", "type", "type")], "pair_id int, obj_name string, old_kind string, new_kind string")
    nodes = spark.createDataFrame(data, NODE)
    mapping = correspondence.establish_correspondence(objects, nodes, SCOPE)
    want = [("Num", "basic", "int"), ("OldT", "named", "NewT"), ("Same", "named", "Same"), ("inner", "named", "core")]
    assert rows(mapping, "old_name", "new_kind", "new_name") == want
    outcome = correspondence.compare_types(nodes, SCOPE, mapping)
    assert rows(outcome.filter("part = ''"), "root", "corresponds") == [("F", True), ("G", False), ("H", False), ("V", True)]


def test_packages_settle_one_by_one(spark, rows):
    """Chains of different depth, and a mapping that would go round: each package ends on its own."""
    use = lambda name: [([], "signature", ""), ([0], "tuple", ""), ([1], "tuple", ""), ([0, 0], "named", name)]
    data = [(1, *r[1:]) for side, names in (("old", "abcd"), ("new", "wxyz")) for r in (
        *tree(side, "F", *use(names[0])),
        *[n for a, b in zip(names, names[1:]) for n in tree(side, a, ([], "named", b), part="N")],
        *tree(side, names[-1], ([], "named", names[0]), part="N"),
    )]
    data += [(2, *r[1:]) for side in ("old", "new") for r in tree(side, "F", *use("t"))]
    objects = spark.createDataFrame([(p, "F", "func", "func") for p in (1, 2)], "pair_id int, obj_name string, old_kind string, new_kind string")
    mapping = correspondence.establish_correspondence(objects, spark.createDataFrame(data, NODE), SCOPE)
    assert rows(mapping, "pair_id", "old_name", "new_name") == [(1, "a", "w"), (1, "b", "x"), (1, "c", "y"), (1, "d", "z"), (2, "t", "t")]


def test_trees_of_mapped_types_move_to_old_names(spark, rows):
    nodes = spark.createDataFrame([*tree("new", "New", ([], "basic", "int")), *tree("new", "Old", ([], "basic", "bool")), *tree("old", "Old", ([], "basic", "int")), *tree("new", "F", ([], "basic", "int"))], NODE)
    mapping = spark.createDataFrame([(1, "Old", "named", "New")], "pair_id int, old_name string, new_kind string, new_name string")
    got = types.roots_under_old_names(nodes, mapping, SCOPE)
    assert rows(got, "side", "root", "label") == [("new", "F", "int"), ("new", "Old", "int"), ("old", "Old", "int")]


def test_type_name_taken_by_another(spark):
    """Old T was met as U before; the new type called T is another one."""
    sided = objects(spark, ("old", "T", "type", "T", None), ("new", "T", "type", "T", None), ("old", "S", "type", "S", None), ("new", "S", "type", "S", None))
    mapping = spark.createDataFrame([(1, "T", "named", "U"), (1, "S", "named", "S")], "pair_id int, old_name string, new_kind string, new_name string")
    aligned = diff.with_mapped_types(diff.diff_objects(sided, SCOPE), mapping, SCOPE)
    assert reported(diff.check_objects(aligned, SCOPE)) == [("T", "changed from T to T", False)]


def test_aliases_compare_the_types_behind(spark):
    """An alias on either side goes by its type; two named types of one name are left to the type rules."""
    data = [
        ("old", "A", "uint8", True), ("new", "A", "uint16", True), ("old", "B", "[]int", True), ("new", "B", "[]int", True),
        ("old", "C", "int", True), ("new", "C", "C", False), ("old", "D", "D", False), ("new", "D", "E", False),
    ]
    sided = objects(spark, *[(side, name, "type", text, None) for side, name, text, _ in data])
    marks = spark.createDataFrame([(side, name, alias) for side, name, _, alias in data], "side string, obj_name string, is_alias boolean")
    aligned = diff.diff_objects(sided.join(marks, ["side", "obj_name"]), SCOPE)
    assert reported(diff.check_objects(aligned, SCOPE)) == [("A", "basic changed from uint8 to uint16", False), ("C", "basic changed from int to C", False)]


def test_unsupported_objects_drop_their_pair(spark, rows):
    nodes = spark.createDataFrame(tree("new", "G", ([], "typeParam", "T")) + tree("new", "F", ([], "basic", "int")), NODE)
    bad = correspondence.unsupported_objects(nodes, SCOPE)
    assert rows(bad, "pair_id", "root", "n_unsupported") == [(1, "G", 1)]
    kept = correspondence.drop_failed_pairs(spark.createDataFrame([(1, "x"), (2, "y")], "pair_id int, m string"), bad)
    assert rows(kept, "pair_id", "m") == [(2, "y")]


def test_change_totals_tell_left_out_columns_from_missing_values(spark, rows):
    changes = spark.createDataFrame([("m", "patch"), ("m", "patch"), ("m", None), (None, "minor")], "module string, update_kind string")
    found = messages.change_totals(changes, ["module", "update_kind"], [["module"], ["update_kind"], []])
    expected = {("m", None, 1, 3), (None, None, 1, 1), (None, "patch", 2, 2), (None, None, 2, 1), (None, "minor", 2, 1), (None, None, 3, 4)}
    assert {tuple(r) for r in found.collect()} == expected and found.columns == ["module", "update_kind", "level", "n_changes"]
