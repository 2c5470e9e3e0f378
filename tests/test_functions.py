"""Column functions against values that their rules fix."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import dtype, folding, guards, scalars


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def strings(*xs):
    return F.array(*[F.lit(x) for x in xs]).cast("array<string>")


@pytest.mark.parametrize(
    ("text", "want"),
    [("1000", 700), ("100K", 71680), ("512M", 375809638), ("2G", 1503238553), (" 512m ", 375809638), ("-1", None), ("", None), ("lots", None), ("64T", None), ("9" * 19, None), ("9" * 18 + "G", None), (None, None)],
)
def test_memory_ceiling(spark, text, want):
    assert one(spark, scalars.memory_ceiling(F.lit(text).cast("string")))[0] == want


def test_union_is_canonical(spark):
    a, b = one(spark, dtype.union_of(F.array(dtype.scalar("int"), dtype.scalar("string"))), dtype.union_of(F.array(dtype.scalar("string"), dtype.scalar("int"), dtype.scalar("int"))))
    assert a == b
    (n,) = one(spark, dtype.nullable(dtype.union_of(F.array(dtype.scalar("string"), dtype.class_type("A\\B")))))
    members = json.loads(n)["members"]
    assert [m["kind"] for m in members] == ["class", "scalar", "null"]
    (alone,) = one(spark, dtype.union_of(F.array(dtype.scalar("int"), dtype.scalar("int"))))
    assert json.loads(alone) == {"kind": "scalar", "name": "int"}


def test_intersection_and_arrays(spark):
    r = one(
        spark,
        dtype.intersection_of(F.array(dtype.class_type("A"), dtype.class_type("A"))),
        dtype.keyed_array(dtype.scalar("string"), dtype.scalar("int")),
        dtype.keyed_array(dtype.scalar("int"), dtype.scalar("int")),
        dtype.translate_intersection(F.lit(True), dtype.scalar("int"), strings()),
        dtype.translate_intersection(F.lit(False), dtype.scalar("int"), strings()),
    )
    assert [json.loads(x)["kind"] for x in r] == ["class", "map", "list", "list", "unknown"]


def test_shape_keeps_order_and_optional(spark):
    fields = dtype.shape_fields(strings("id", "name"), F.array(dtype.scalar("int"), dtype.scalar("string")), F.array(F.lit(1)))
    got = json.loads(one(spark, dtype.shape(fields))[0])
    assert [(f["key"], f["optional"]) for f in got["fields"]] == [("id", False), ("name", True)]
    kept = scalars.settle_field(fields, F.lit("name"))
    assert [f["optional"] for f in one(spark, kept)[0]] == [False, False]


@pytest.mark.parametrize(
    ("name", "kind", "detail"),
    [("int", "scalar", "int"), ("true", "scalar", "bool"), ("null", "null", None), ("void", "void", None), ("never", "never", None), ("Closure", "callable", None), ("array", "unknown", "untyped array"), ("mixed", "unknown", "mixed"), ("static", "unknown", "static"), ("App\\User", "class", "App\\User"), (None, "unknown", "no declared type")],
)
def test_native_types(spark, name, kind, detail):
    got = json.loads(one(spark, dtype.native_type(F.lit(name).cast("string"), F.lit(False), F.lit(None).cast("array<string>")))[0])
    assert got["kind"] == kind and (detail is None or detail in got.values())


def test_nullable_native_and_enum(spark):
    a, b, c = one(
        spark,
        dtype.native_type(F.lit("int"), F.lit(True), F.lit(None).cast("array<string>")),
        dtype.native_type(F.lit("mixed"), F.lit(True), F.lit(None).cast("array<string>")),
        dtype.native_type(F.lit("Colour"), F.lit(False), strings("Red", "Green", "Blue")),
    )
    assert json.loads(a)["kind"] == "union" and json.loads(b)["kind"] == "unknown" and json.loads(c)["cases"] == ["Red", "Green", "Blue"]


def test_translation_order(spark):
    none = F.lit(None).cast("string")
    base = {k: F.lit(None).cast("boolean") for k in ("is_null", "is_void", "is_never", "is_callable", "is_int", "is_string", "is_float", "is_bool")} | {k: none for k in ("literal", "constant_array", "union", "intersection", "bound", "generic", "single_class", "array")} | {"described": none}
    t = lambda **k: one(spark, dtype.translate(base | k))[0]
    assert json.loads(t(is_null=F.lit(True), is_int=F.lit(True)))["kind"] == "null"
    assert json.loads(t(literal=dtype.literal(F.lit("5")), is_int=F.lit(True))) == {"kind": "literal", "value": 5}
    assert json.loads(t())["reason"] == "unresolved type"
    deep = one(spark, dtype.translate(base | {"is_int": F.lit(True)}, F.lit(12)))[0]
    assert json.loads(deep)["reason"] == "translation depth budget exhausted"


def test_property_types(spark):
    bare, args = dtype.class_type("C"), dtype.class_type("C", F.array(dtype.scalar("int")))
    none, vague = F.lit(None).cast("string"), dtype.unknown("mixed")
    got = one(spark, dtype.property_type(bare, none, args), dtype.property_type(vague, dtype.scalar("int"), dtype.scalar("string")), dtype.property_type(dtype.scalar("int"), none, dtype.scalar("string")), dtype.property_type(bare, none, dtype.class_type("D", F.array(dtype.scalar("int")))), dtype.property_type(none, none, none))
    assert json.loads(got[0])["args"] == [{"kind": "scalar", "name": "int"}]
    assert [json.loads(x).get("name") for x in got[1:3]] == ["int", "int"]
    assert json.loads(got[3]) == {"kind": "class", "fqcn": "C", "args": []}
    assert json.loads(got[4])["kind"] == "unknown"


GUARDS = [
    ([], "OutOfBoundsException", ["RuntimeException"], True),
    ([["RuntimeException"]], "RuntimeException", [], True),
    ([["RuntimeException"]], "OutOfBoundsException", ["RuntimeException", "Exception"], True),
    ([["LogicException"]], "RuntimeException", ["Exception"], False),
    ([["LogicException"], ["RuntimeException"]], "RuntimeException", [], True),
    ([["RuntimeException", "Countable"]], "ArrayIterator", ["Countable"], False),
    ([["LogicException", "Countable"]], "LogicException", [], False),
]


@pytest.mark.parametrize(("guard", "to", "supers", "want"), GUARDS)
def test_guards(spark, guard, to, supers, want):
    df = spark.createDataFrame([(guard, to, supers)], "g array<array<string>>, t string, s array<string>")
    got, exact = df.select(guards.satisfied_by(F.col("g"), F.col("t"), F.col("s")), guards.names_exactly(F.col("g"), F.col("t"))).first()
    assert got is want
    assert exact is any(to in alt for alt in guard)


def test_guard_algebra(spark):
    df = spark.createDataFrame([([["A"], ["B"]], [["C"]], [])], "l array<array<string>>, r array<array<string>>, e array<array<string>>")
    got = df.select(guards.all_of(F.col("l"), F.col("r")), guards.all_of(F.col("l"), F.col("e")), guards.any_of(F.col("l"), F.col("r")), guards.any_of(F.col("l"), F.col("e"))).first()
    assert list(got) == [[["A", "C"], ["B", "C"]], [["A"], ["B"]], [["A"], ["B"], ["C"]], []]
    trees = [{"op": "and", "args": [{"op": "instanceof", "class": "A"}, {"op": "or", "args": [{"op": "instanceof", "class": "B"}, {"op": "instanceof", "class": "C"}]}]}, {"op": "not", "args": []}, None]
    df = spark.createDataFrame([(json.dumps(t) if t else None,) for t in trees], "t string")
    assert [r[0] for r in df.select(guards.condition_guard("t")).collect()] == [[["A", "B"], ["A", "C"]], [], []]


def test_constant_folding():
    var = lambda n: {"t": "var", "name": n}
    lit = lambda v: {"t": "lit", "v": v}
    arg = lambda v, **k: {"value": v, **k}
    static = lambda *a, **k: {"t": "static", "class": "Shop\\Rule", "name": "between", "args": list(a), **k}
    show = lambda n, b=None: (c := folding.fold(n, b or {})) and folding.render(c)
    s = lambda v: {"kind": "scalar", "value": v}
    assert show(static(arg(var("low")), arg(var("high"))), {"low": s(2), "high": s("nine")}) == "Rule::between(2, 'nine')"
    assert show({"t": "array", "items": [arg({"t": "method", "var": static(arg(var("low"))), "name": "orElse", "args": [arg(var("d"))]})]}, {"low": s(2), "d": s(True)}) == "[Rule::between(2)->orElse(true)]"
    assert show(static(arg(var("low")))) == "Rule::between(<unknown: non-constant factory arg>)"
    assert show(static(callable=True)) is None
    assert show(static(arg(lit(1)), arg(var("more"), unpack=True))) == "Rule::between(1, ...<unplaceable factory arg>)"
    assert show(static(arg(lit(1)), arg(var("more"), name="steps"))) == "Rule::between(1, ...<unplaceable factory arg>)"
    assert show(static(arg(lit(1)), arg({"t": "array", "items": [arg(lit(5)), arg(lit("x"))]}, unpack=True))) == "Rule::between(1, 5, 'x')"
    assert show({"t": "array", "items": [arg(lit("a")), arg(var("r"), unpack=True), arg(lit("b"))]}) == "['a', ...<spread array item>, 'b']"
    assert show({"t": "const", "class": "Size", "name": "Large", "enum": True}) == "'Large'"
    assert show({"t": "new", "class": "Shop\\Page", "args": [arg(lit("t"))]}) == "new Page('t')"
    assert folding.fold(lit(None), {}) == {"kind": "scalar", "value": None}


def test_folding_falls_through_to_the_constant_of_the_type():
    """An unbound variable, an open call and a call on what is no descriptor have one constant value by their type at most."""
    seven = {"kind": "scalar", "value": 7}
    var, static = {"t": "var", "name": "x", "v": 7}, {"t": "static", "class": "C", "name": "m", "args": [], "callable": True, "v": 7}
    method = {"t": "method", "var": {"t": "lit", "v": 1}, "name": "m", "args": [], "v": 7}
    assert [folding.fold(n, {}) for n in (var, static, method, {**method, "callable": True}, {"t": "new", "class": "C", "args": [], "callable": True, "v": 7})] == [seven] * 5
    assert folding.fold(var, {"x": {"kind": "scalar", "value": None}}) == {"kind": "scalar", "value": None}
    assert folding.fold({"t": "var", "name": "x"}, {}) is None


def test_folded_null_is_not_unfolded(spark):
    a, b = one(spark, folding.scalar_fold(strings("null")), folding.scalar_fold(strings()))
    assert a is not None and a["v"] is None and b is None
    assert one(spark, folding.int_literal(folding.scalar_fold(strings("404"))), folding.int_literal(folding.scalar_fold(strings('"404"')))) == (404, None)


def test_paths(spark):
    p = lambda x: F.lit(x).cast("string")
    roots = strings("/app/", "/lib")
    got = one(spark, scalars.is_project_file(p("/app/a.php"), roots), scalars.is_project_file(p("/apple/a.php"), roots), scalars.is_project_file(p("/lib"), roots), scalars.is_project_file(p(None), roots), scalars.is_project_file(p(""), roots), scalars.is_vendor_file(p("/x"), p(None)), scalars.is_vendor_file(p("/v/x"), p("/v")), scalars.is_vendor_file(p("/vx"), p("/v")))
    assert list(got) == [True, False, True, False, False, True, True, False]
    assert one(spark, scalars.normalize_path(p("/a/./b//../c")))[0] == "/a/c"


def test_names_and_credentials(spark):
    names = ["SIGNING_SECRET", "APP_API_KEY", "CLIENT_SECRET", "API_TOKEN", "DEFAULT_TITLE", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(scalars.credential_label(F.col("n"))).collect()] == ["a secret", "an API key", "a client secret", "a token", None, None]
    got = one(spark, scalars.sensitive_label(strings("TITLE", "API_KEY")), scalars.scope_key(F.lit(None).cast("string"), F.lit("f")), scalars.scope_key(F.lit("C"), F.lit("f")), scalars.neon_string(F.lit("it's")), scalars.short_name(F.lit("A\\B")), scalars.major_minor(F.lit("v2.13.4")), scalars.major_minor(F.lit("dev")))
    assert got[:5] == ("an API key", "f", "C::f", "'it''s'", "B") and tuple(got[5]) == (2, 13) and tuple(got[6]) == (0, 0)


def test_status_argument(spark):
    rows = [([(False, "403")], 0, 403), ([(False, "x"), (False, "404")], 1, 404), ([(True, None), (False, "404")], 1, None), ([], 0, None), ([(False, "abc")], 0, None)]
    df = spark.createDataFrame(rows, "a array<struct<unpack: boolean, const: string>>, s int, w int")
    assert all(g == w for g, w in df.select(scalars.fold_status_arg(F.col("a"), F.col("s")), "w").collect())


def test_records(spark):
    payload, ct = dtype.scalar("int"), F.lit("text/csv")
    none = F.lit(None)
    args = scalars.type_args(payload, none.cast("int"), ct, none.cast("string"))
    (back,) = one(spark, scalars.from_type_args(dtype.class_type("R", args)))
    assert json.loads(back["payload"])["name"] == "int" and back["status"] is None and back["content_type"] == "text/csv"
    assert one(spark, scalars.type_args(none.cast("string"), none.cast("int"), none.cast("string"), dtype.scalar("int")))[0] is None
    rec = F.struct(F.lit(200).alias("status"), F.lit(None).cast(scalars.ACCESSOR).alias("status_source"))
    src = F.struct(F.lit("p").alias("param"), F.lit("Identity").alias("kind"), F.lit(None).cast("string").alias("method"))
    (got,) = one(spark, scalars.with_status_source(rec, src))
    assert got["status"] is None and got["status_source"]["param"] == "p"


def test_members(spark):
    fields = F.array(F.struct(F.lit("a").alias("key"), dtype.scalar("int").alias("type"), F.lit(True).alias("optional")), F.struct(F.lit("b").alias("key"), dtype.scalar("int").alias("type"), F.lit(True).alias("optional")))
    acc = F.struct(F.lit("p").alias("param"), F.lit("Identity").alias("kind"), F.lit(None).cast("string").alias("method"))
    prov = F.create_map(F.lit("a"), acc)
    f, p = scalars.bind_member(fields, prov, F.lit("a"), F.lit('"x"'), F.lit(None).cast(scalars.ACCESSOR), F.lit(True))
    got = one(spark, f, p, scalars.mark_status_members(fields, prov, acc), scalars.without_member(fields, F.lit("a")))
    assert json.loads(got[0][0]["type"]) == {"kind": "literal", "value": "x"} and got[0][0]["optional"] is False and got[0][1]["optional"] is True
    assert got[1] == {} and json.loads(got[2][0]["type"])["kind"] == "status_marker" and [x["key"] for x in got[3]] == ["b"]


def test_accessors(spark):
    df = spark.createDataFrame([("variable", "p", None, 0), ("property", "p", "value", 0), ("property", "p", "other", 0), ("call", "p", "label", 0), ("call", "p", "label", 1)], "k string, v string, m string, n int")
    assert [(r[0] and (r[0]["kind"], r[0]["method"])) for r in df.select(scalars.accessor(F.col("k"), F.col("v"), F.col("m"), F.col("n"))).collect()] == [("Identity", None), ("Value", None), None, ("Method", "label"), None]
    rows = [([("a", ("p", "Identity", None)), ("a", ("q", "Identity", None)), (None, ("r", "Identity", None))],)]
    df = spark.createDataFrame(rows, f"i array<struct<key: string, accessor: {scalars.ACCESSOR}>>")
    assert {k: v["param"] for k, v in df.select(scalars.provenance_from_array(F.col("i"))).first()[0].items()} == {"a": "q"}


def test_budgets(spark):
    assert list(one(spark, *[scalars.within_depth(F.lit(d), F.lit(4)) for d in (0, 3, 4, 5)])) == [True, True, True, False]
    got = one(spark, scalars.within_budget(strings("a", "b"), F.lit("a"), F.lit(2)), scalars.within_budget(strings("a", "b"), F.lit("c"), F.lit(2)), scalars.affordable(F.lit(2), F.lit(2), F.lit(4), strings("a"), strings("a", "b"), F.lit(2)), scalars.affordable(F.lit(3), F.lit(2), F.lit(4), strings(), strings(), F.lit(2)))
    assert list(got) == [True, False, True, False]
