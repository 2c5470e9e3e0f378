"""Traces with a visitor and folded call returns, over hand-built facts."""

import pytest
from pyspark.sql import functions as F

from factloom.plans.engine import Engine, EngineConfig

from .test_shapes import Facts


@pytest.fixture(scope="module")
def engine(spark):
    f = Facts()
    query = '{"kind":"class","fqcn":"Shop\\\\Query","args":[]}'
    a, b, _, loop = (f.method("Desk", n, "/app/desk.php") for n in ("list", "narrow", "sort", "loop"))
    for kit, file in (("Lib\\Kit", "/lib/kit.php"), ("Vendor\\Kit", "/vendor/kit.php")):
        f.method(kit, "apply", file)
    f.call(a, "Desk", "narrow", type_json=query)
    f.call(a, "Desk", "sort", type_json='{"kind":"scalar","name":"int"}')
    f.call(b, "Lib\\Kit", "apply", type_json=query)
    f.call(b, "Vendor\\Kit", "apply", type_json=query)
    f.call(b, "Desk", "loop", type_json=query)
    f.call(loop, "Desk", "list", type_json=query)
    # Calls whose value is asked for.
    size = f.method("Desk", "size", "/app/desk.php", "n")
    f.add("params", "Desk", "sized", 0, "n", False, False, "25")
    f.add("methods", "Desk", "sized", "/app/desk.php", True)
    f.add("class_methods", "Desk", "sized", "Desk", "/app/desk.php", "/app/desk.php", 1)
    f.returns(size, "/app/desk.php", f.lit(size, 40))
    sized = ("Desk", "sized")
    f.returns(sized, "/app/desk.php", f.expr("variable", sized, var="n"))
    twice = f.method("Desk", "twice", "/app/desk.php")
    f.returns(twice, "/app/desk.php", f.lit(twice, 1), f.lit(twice, 2))
    f.returns(("Vendor\\Kit", "apply"), "/vendor/kit.php", f.lit(("Vendor\\Kit", "apply"), 3))
    main = f.method("Desk", "main", "/app/desk.php")
    spread = f.call(main, "Desk", "sized", f.expr("variable", main, var="rest"), unpack=(0,))
    ids = {n: f.call(main, cls, m, *[f.lit(main, v) for v in vs]) for n, cls, m, vs in (("constant", "Desk", "size", [9]), ("bound", "Desk", "sized", [7]), ("default", "Desk", "sized", []), ("twice", "Desk", "twice", []), ("vendor", "Vendor\\Kit", "apply", []))}
    config = EngineConfig(descend_roots=("/app",), prime_roots=("/app",), vendor_root="/vendor")
    return Engine.create(spark, f.tables(spark), config), ids | {"spread": spread}


def test_visitors_steer_the_walk(spark, engine):
    eng, _ = engine
    start = spark.createDataFrame([("Desk", "list", "/app/desk.php")], "class string, method string, file string")
    of_query = lambda t: F.get_json_object(t, "$.fqcn") == "Shop\\Query"
    everything = lambda n: n.select("expr_id", (F.col("kind") == "call").alias("descend"))
    queries = lambda n: n.select("expr_id", F.coalesce(of_query(F.col("type")), F.lit(False)).alias("descend"))
    walk = lambda got: [r.node for r in got["visits"].orderBy("visit").collect()]
    assert walk(eng.trace_visitor(start, everything)) == ["Desk::list", "Desk::narrow", "Desk::loop", "Desk::sort"]
    assert walk(eng.trace_visitor(start, queries)) == ["Desk::list", "Desk::narrow", "Desk::loop"]
    wide = eng.trace_visitor(start, queries, follows=of_query)
    assert walk(wide) == ["Desk::list", "Desk::narrow", "Lib\\Kit::apply", "Desk::loop"]
    assert wide["lineage"].first().files == ["/app/desk.php", "/lib/kit.php"]
    assert {r.member for r in wide["nodes"].where("node = 'Desk::narrow'").collect()} == {"apply", "loop"}


def test_calls_fold_to_what_they_return(spark, engine):
    eng, ids = engine
    requests = spark.createDataFrame([("t", k, i) for k, i in enumerate(ids.values())] + [("u", 0, ids["bound"])], "trace string, ord int, call_id long")
    got = {(r.trace, r.ord): r.value for r in eng.folded_calls(requests).collect()}
    names = list(ids)
    assert {names[o]: v for (t, o), v in got.items() if t == "t"} == {"constant": "40", "bound": "7", "default": "25", "twice": None, "vendor": None, "spread": None} and got[("u", 0)] == "7"


def test_node_views_of_calls(spark, engine):
    eng, ids = engine
    row = eng.nodes().where(F.col("expr_id") == ids["constant"]).first()
    assert row.callee_name == "size" and row["class"] == "Desk" and row.location.file == "/app/x.php"
