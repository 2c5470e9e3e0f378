"""Steps that must not cost more than their result needs."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import dtype
from factloom.operators import aggregates, graph, lookups
from factloom.plans import engine, engine_queries, shapes, standins

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_opaque_scopes_are_aggregated_once(spark):
    shown = plan(standins.QUERIES["opaque_scopes"](spark, SF))
    assert "Window" not in shown and shown.count("Aggregate") == 2
    w = spark.createDataFrame([("f", "s", True), ("f", "s", False), ("f", None, False), (None, "s", None), ("g", "s", False)], "file string, scope_key string, opaque boolean")
    each = {(r.file, r.scope_key, r.opaque) for r in aggregates.scope_opacity(w).collect()}
    assert each == {tuple(r) for r in aggregates.opaque_scopes(w).select("file", "scope_key", F.col("opaque")).distinct().collect()}


def test_types_are_parsed_once_a_row(spark):
    # Spark computes an expression as often as a lambda names it: what is computed twice is written twice.
    t, w = F.col("t"), F.col("w")
    rows = spark.createDataFrame([(x, '{"kind":"class","fqcn":"A","args":[{"kind":"null"}]}') for x in ('{"kind":"class","fqcn":"A","args":[]}', '{"kind":"void"}', '{ "kind": "void" }', '{"kind":"unknown","reason":"u"}', None)], "t string, w string")
    parses = lambda e: plan(rows.select(e.alias("x"))).count("from_json")
    assert parses(dtype.parameterise(t, w)) == 3 and parses(dtype.property_type(t, w, w)) <= 9
    got = rows.select(dtype.kind_of(t).alias("k"), dtype.parameterise(t, w).alias("p"), dtype.property_type(t, w, w).alias("x")).collect()
    assert [r.k for r in got] == ["class", "void", "void", "unknown", None] and [r.p for r in got][0] == got[0].x == got[3].x == got[4].x and got[1].p == '{"kind":"void"}'


def test_entries_of_one_form_are_recovered_once(spark, monkeypatch):
    class Asked(Exception):
        pass

    def refine(shared, sites, *_):
        raise Asked(sorted((r.ord, r.expr_id or 0) for r in sites.collect()))

    monkeypatch.setattr(shapes, "refine_sites", refine)
    monkeypatch.setattr(engine.Engine, "shapes", lambda self: None)
    sites = [(e, k, x) for e in "abc" for k, x in enumerate((7, None))] + [("d", 0, 7), ("e", 1, 7), ("e", 0, None)]
    with pytest.raises(Asked) as got:
        engine.Engine.create(spark, {}).typed_sites(spark.createDataFrame(sites, "entry string, ord int, expr_id long"))
    assert got.value.args[0] == [(0, 0), (0, 7), (0, 7), (1, 0), (1, 7)]


def test_a_callee_of_many_entries_is_descended_once(spark, monkeypatch):
    below, first = [], shapes._first_documentable

    def seen(shared, rows):
        below.append(rows.count())
        return first(shared, rows)

    monkeypatch.setattr(shapes, "_first_documentable", seen)
    got = engine_queries.recovered_shapes(spark, SF).count()
    # 1,500 orders answer through the factory or one of five helpers, which call it: six returns below all of them, five below those.
    assert got == 1500 and sorted(below) == [0, 0, 5, 6]


def test_hot_keys_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT_SHARE", 3)
    left = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate([("a", 1)] * 6 + [("b", 1), ("b", 2), (None, 1), ("a", None), ("c", 1)])], "id long, x string, y int")
    right = spark.createDataFrame([("a", 1, 6, "hot"), ("b", 1, 1, "cold"), ("b", 2, 1, "cool"), ("d", 1, 0, "none")], "rx string, ry int, n long, v string")
    got = {r.id: r.v for r in graph.join_hot(left, right, [("x", "rx"), ("y", "ry")], "n").collect()}
    assert got == {**{k: "hot" for k in range(6)}, 6: "cold", 7: "cool", 8: None, 9: None, 10: None}
    calls = spark.createDataFrame([(1, "method", "m", ["X", "A"]), (2, "method", "m", ["X", "A"]), (3, "static", "m", ["B", "A"]), (4, "function", "m", ["A"]), (5, "method", "m", None), (6, "method", None, ["A"]), (7, "method", "m", [None, "A"])], "call_id long, kind string, callee_name string, receivers array<string>")
    methods = spark.createDataFrame([("A", "m", "A0", "a.php"), ("B", "m", "B0", None)], "class string, method string, declaring_class string, declaring_file string")
    each, shared = (sorted(tuple(r) for r in f(calls, methods).collect()) for f in (lookups.resolve_callees, lookups.resolve_shared_callees))
    assert each == shared == [(1, "A0", "m", "a.php"), (2, "A0", "m", "a.php"), (7, "A0", "m", "a.php")]
