"""Operators over hand-built facts, order independence and the engine's questions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from factloom import registry as reg
from factloom.functions import dtype, scalars
from factloom.operators import aggregates, graph, lookups, windows
from factloom.plans.engine import Engine, EngineConfig
from factloom.schemas import FACTS
from factloom.sources import facts


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_dedupe_keeps_the_first_of_equals_and_null_statuses(spark):
    t = spark.createDataFrame([(1, "A", 404, 1, 1), (1, "A", 404, 1, 2), (1, "A", 404, 3, 3), (1, "A", None, 1, 4), (1, "A", None, 1, 5), (1, "B", 403, 1, 6)], "g int, exception string, status int, rank int, ord int")
    kept = aggregates.dedupe_throws(t, ["g"], F.col("rank"), ["ord"])
    assert rows(kept, "exception", "status", "ord") == [("A", 404, 3), ("A", None, 4), ("B", 403, 6)]
    assert rows(kept.withColumn("p", aggregates.result_order(["g"])), "p", "exception", "status") == [(1, "B", 403), (2, "A", 404), (3, "A", None)]


def test_callee_without_a_file_ends_the_search(spark):
    calls = spark.createDataFrame([(1, "method", "m", ["X", "A", "B"]), (2, "method", "m", ["B", "A"]), (3, "function", "m", ["B"])], "call_id long, kind string, callee_name string, receivers array<string>")
    cm = spark.createDataFrame([("A", "m", "A0", None), ("B", "m", "B0", "b.php")], "class string, method string, declaring_class string, declaring_file string")
    assert rows(lookups.resolve_callees(calls, cm), "call_id", "callee_class", "callee_file") == [(2, "B0", "b.php")]


def test_argument_slots(spark):
    args = spark.createDataFrame([(1, 0, None, False, 10), (1, 1, "c", False, 11), (2, 0, None, True, 20), (2, 1, "a", False, 21)], "call_id long, ord int, name string, unpack boolean, expr_id long")
    params = spark.createDataFrame([(c, i, p) for c in (1, 2, 3) for i, p in enumerate("abc")], "call_id long, idx int, param string")
    got = {(r.call_id, r.param): (r.expr_id, r.present, r.known) for r in lookups.argument_slots(args, params).collect()}
    assert got[(1, "a")] == (10, True, True) and got[(1, "b")] == (None, False, True) and got[(1, "c")] == (11, True, True)
    assert got[(2, "a")] == (21, True, True) and got[(2, "b")] == (None, False, False) and got[(3, "a")] == (None, False, True)


def test_variadic_and_by_reference(spark):
    params = spark.createDataFrame([(1, 0, "a", False, False), (1, 1, "rest", True, True)], "call_id long, idx int, param string, by_ref boolean, variadic boolean")
    args = spark.createDataFrame([(1, 0, None, False, "x"), (1, 1, None, False, "y"), (1, 2, "extra", False, "z"), (1, 3, None, True, "s"), (1, 4, None, False, "late")], "call_id long, ord int, name string, unpack boolean, var_name string")
    assert rows(lookups.by_reference_writes(args, params), "var_name") == [("y",), ("z",)]


def test_registry(spark):
    r = reg.default_registry(spark)
    assert r.count() == 9 and rows(reg.known_statuses(r), "exception", "status") == [(reg.AUTHORIZATION, 403), (reg.MODEL_NOT_FOUND, 404), (reg.VALIDATION, 422)]
    more = spark.createDataFrame([("function", "abort", 0, "Own", 418, None)], reg.REGISTRY_SCHEMA)
    assert rows(reg.extend(r, more).where("name = 'abort'"), "exception", "fixed_status") == [("Own", 418)]
    closure = spark.createDataFrame([("Mine", reg.VALIDATION), ("Mine", reg.AUTHORIZATION)], "sub string, super string")
    types = spark.createDataFrame([("Mine",), (reg.VALIDATION,), ("RuntimeException",)], "exception string")
    assert rows(lookups.status_for_types(types, r, reg.known_statuses(r), closure), "exception", "status") == sorted([("Mine", 403), (reg.VALIDATION, 422), ("RuntimeException", 500)], key=str)
    assert reg.signatures(spark).count() == 24


def test_single_assignment(spark):
    w = spark.createDataFrame([("s", "a", 1, False, False), ("s", "b", 2, False, False), ("s", "b", 3, False, False), ("s", "c", 4, True, False), ("t", "a", 5, False, True), ("t", "b", 6, False, False)], "scope_key string, var string, expr_id long, retires boolean, opaque boolean").withColumn("file", F.lit("f"))
    got = aggregates.single_assignments(aggregates.opaque_scopes(w), ["scope_key", "var"])
    assert rows(got, "scope_key", "var", "expr_id") == [("s", "a", 1), ("s", "b", None), ("s", "c", None), ("t", "a", None), ("t", "b", None)]


def test_content_type_window(spark):
    returns = spark.createDataFrame([(1, "s", "r", 100), (2, "s", "q", 100)], "return_id int, scope_key string, var string, pos long")
    assigns = spark.createDataFrame([("s", "r", 10), ("s", "r", 50)], "scope_key string, var string, pos long")
    headers = spark.createDataFrame([("s", "r", 20, "Content-Type", "old"), ("s", "r", 60, "content-TYPE", "text/csv"), ("s", "r", 70, "X-A", "no"), ("s", "r", 120, "Content-Type", "late"), ("s", "q", 5, "Content-Type", None)], "scope_key string, var string, pos long, header string, value string")
    assert rows(windows.content_types(returns, assigns, headers), "return_id", "content_type") == [(1, "text/csv"), (2, None)]


def test_first_documentable_and_arms(spark):
    r = spark.createDataFrame([("m", 0, False, True), ("m", 1, True, False), ("n", 0, False, True), ("o", 0, False, False)], "method string, ord int, documentable boolean, delegates boolean")
    assert rows(windows.first_documentable(r, ["method"]), "method", "ord") == [("m", 1), ("n", 0)]
    arm = "array<struct<pos: bigint, type: string, guard: array<array<string>>, is_default: boolean>>"
    s = spark.createDataFrame([("c", 5, 0, "T", [["A"]], None), ("c", 9, 1, None, None, [(11, "X", [["B"]], False), (12, "Y", [["Z"]], True)])], f"callable string, pos long, ord int, type string, guard array<array<string>>, arms {arm}")
    assert rows(windows.arms_of(s), "pos", "type", "guard") == [(11, "X", [["B"]]), (12, "Y", []), (5, "T", [["A"]])]


def _trace(edges, root, files, depth, budget):
    out, visited, touched = [], {root}, {files[root]}

    def go(node, d):
        out.append((root, node, d))
        for dst in dict.fromkeys(edges.get(node, ())):
            if d + 1 <= depth and dst not in visited and (files[dst] in touched or len(touched) < budget):
                visited.add(dst)
                touched.add(files[dst])
                go(dst, d + 1)

    go(root, 0)
    return out


def test_trace_is_depth_first(spark):
    rnd = random.Random(3)
    for depth, budget in ((4, 40), (3, 4)):
        edges, files = {}, {str(i): f"f{i % 9}" for i in range(30)}
        for i in range(30):
            edges[str(i)] = [str(rnd.randrange(30)) for _ in range(3)]
        flat = [(s, d, files[d], k, 0) for s, ds in edges.items() for k, d in enumerate(ds)]
        rnd.shuffle(flat)
        e = spark.createDataFrame(flat, "src string, dst string, dst_file string, pos long, ord int")
        roots = spark.createDataFrame([("0", files["0"]), ("7", files["7"])], "root string, root_file string")
        got = [(r.root, r.node, r.depth) for r in graph.trace(roots, e, depth, budget).orderBy("root", "visit").collect()]
        assert got == _trace(edges, "0", files, depth, budget) + _trace(edges, "7", files, depth, budget)


def test_descent_reads_a_recursive_entry_once_more(spark):
    f = F.struct(F.lit("l").alias("label"), F.lit("f").alias("file"), F.lit(1).alias("line"))
    e = spark.createDataFrame([("m", "m", 1), ("m", "n", 2), ("n", "m", 1)], "caller string, callee string, ord int").withColumn("frame", f)
    t = spark.createDataFrame([("m", "X", 500, "Certain", "Signal", 1)], "method string, exception string, status int, confidence string, disposition string, ord int").withColumn("frame", f)
    found = graph.descend_throws(spark.createDataFrame([("m",)], "entry string"), t, e, 3)
    # m itself, m called by itself, and m called by n; then the path blocks.
    assert sorted(len(r.chain) for r in found.collect()) == [1, 2, 3]


def test_closure_ends_on_a_cycle(spark):
    p = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("D", "A"), ("E", "E")], "sub string, super string")
    got = rows(graph.class_closure(p), "sub", "super")
    assert ("D", "C") in got and ("E", "E") in got and ("A", "C") in got and len(got) == 3 * 2 + 3 + 5


def test_members_of_a_constructor(spark):
    a = spark.createDataFrame([(1, 0, "id", "5", None, False), (1, 1, "key", '"x"', "a secret", False), (1, 2, "lazy", None, None, True)], "call_id long, ord int, name string, literal string, sensitive string, omissible boolean")
    f = graph.constructed_members(a).first().fields
    assert [(x.key, json.loads(x.type).get("value", json.loads(x.type).get("reason")), x.optional) for x in f] == [("id", 5, False), ("key", "sensitive constant", False), ("lazy", "constructor argument not folded", True)]


def test_harvest_and_prime(spark):
    n = spark.createDataFrame(
        [("f", 1, "method", "C", "m", 1, None, None, None, False, False, False), ("f", 2, "closure", None, None, 4, None, None, None, False, False, False), ("f", 3, "closure", None, None, 4, None, None, None, False, False, False), ("f", 4, "write", None, None, 5, "C::m", "a", 40, True, False, False), ("f", 5, "write", None, None, 6, "C::m", "a", 41, True, False, False)],
        "file string, ord int, kind string, class string, name string, line int, scope_key string, var string, expr_id long, is_array boolean, retires boolean, opaque boolean",
    )
    h = facts.harvest(n)
    assert rows(h["methods"], "method") == [("m",)] and rows(h["closures"], "line", "ord") == [(4, 3)]
    assert rows(h["arrays"], "expr_id") == [(40,)] and rows(h["locals"], "expr_id") == [(None,)]
    primed = facts.prime(spark.createDataFrame([("b",)], "file string"), spark.createDataFrame([("a",), ("b",), (None,)], "file string"))
    assert [r.file for r in primed.collect()] == ["a", "b"] and facts.snapshot_id(primed) == 2


def test_discovery_and_empty_facts(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for name in ("b.php", "x/a.php", "x/c.txt"):
        (tmp_path / name).write_text("<?php")
    assert [r.file.removeprefix(str(tmp_path)) for r in facts.discover_files(spark, str(tmp_path)).collect()] == ["/b.php", "/x/a.php"]
    got = facts.read_facts(spark, str(tmp_path / "none"))
    assert set(got) == set(FACTS) and got["calls"].count() == 0


@pytest.fixture(scope="module")
def engine(spark):
    empty = {k: spark.createDataFrame([], ddl) for k, ddl in FACTS.items()}

    def fill(name, data):
        return spark.createDataFrame(data, FACTS[name])

    methods = ["abortAction", "authorizeAction", "findOrFailAction", "validateAction", "deepDeclared", "anyThrowableNoise", "projectValidate", "helper", "spreadAbort"]
    f = empty | {
        "methods": fill("methods", [("C", m, "/app/c.php", True) for m in methods]),
        "class_methods": fill("class_methods", [("C", "helper", "C", "/app/c.php", "/app/c.php", 1), ("P", "validate", "C", "/app/c.php", "/app/c.php", 1), ("C", "validate", "C", "/app/c.php", "/app/c.php", 1)]),
        "calls": fill(
            "calls",
            [
                (1, "/app/c.php", "C", "abortAction", 1, 1, "function", "abort", [], False),
                (2, "/app/c.php", "C", "abortAction", 2, 2, "function", "abort_if", [], False),
                (3, "/app/c.php", "C", "authorizeAction", 1, 1, "method", "authorize", ["X"], False),
                (4, "/app/c.php", "C", "findOrFailAction", 1, 1, "static", "findOrFail", ["M"], False),
                (5, "/app/c.php", "C", "validateAction", 1, 1, "method", "validate", ["R"], False),
                (6, "/app/c.php", "C", "deepDeclared", 1, 1, "method", "helper", ["C"], False),
                (7, "/app/c.php", "C", "anyThrowableNoise", 1, 1, "method", "unknown", ["V"], False),
                (8, "/app/c.php", "C", "spreadAbort", 1, 1, "function", "abort", [], False),
            ],
        ),
        "args": fill("args", [(1, 0, None, False, None, None, "403"), (2, 0, None, False, None, "x", None), (2, 1, None, False, None, None, "404"), (8, 0, None, True, None, "rest", None)]),
        "throw_points": fill(
            "throw_points",
            [("/app/c.php", "C", m, 1, 1, False, False, ["Throwable"], c) for m, c in (("authorizeAction", 3), ("findOrFailAction", 4), ("validateAction", 5), ("deepDeclared", 6), ("anyThrowableNoise", 7), ("spreadAbort", 8))]
            + [("/app/c.php", "C", "abortAction", 1, 1, False, False, ["Throwable"], 1), ("/app/c.php", "C", "abortAction", 2, 2, False, False, ["Throwable"], 2), ("/app/c.php", "C", "helper", 1, 9, True, True, ["OutOfStockException"], None)],
        ),
        "class_closure": fill("class_closure", [("OutOfStockException", "RuntimeException")]),
        "return_sites": fill("return_sites", [("/app/c.php", "C", "helper", 0, 1, 9, 1, None), ("/app/c.php", "C", "helper", 1, 2, 10, None, None)]),
        "exprs": fill("exprs", [(1, "x", '{"kind":"scalar","name":"int"}', None, "no", None, None, None, None, None)]),
        "properties": fill("properties", [("D", 0, "id", '{"kind":"scalar","name":"int"}', None, None, False, False, "reflection"), ("D", 1, "id", None, None, None, False, False, "docblock"), ("D", 2, "s", None, None, None, True, False, "reflection")]),
        "closures": fill("closures", [("/app/c.php", 3, 0, True), ("/app/c.php", 4, 0, False)]),
    }
    return Engine.create(spark, f, EngineConfig(descend_roots=("/app",), prime_roots=("/app",)))


def test_actions(spark, engine):
    names = ["abortAction", "authorizeAction", "findOrFailAction", "validateAction", "deepDeclared", "anyThrowableNoise", "spreadAbort", "missing", "helper"]
    actions = spark.createDataFrame([("C", m, "/app/c.php") for m in names], "class string, method string, file string")
    got = engine.analyze_actions(actions)
    short = lambda r: (r.entry.removeprefix("C::"), r.exception.rsplit("\\", 1)[-1], r.status)
    assert sorted(map(short, got["throws"].collect()), key=str) == sorted(
        [("abortAction", "HttpException", 403), ("abortAction", "HttpException", 404), ("authorizeAction", "AuthorizationException", 403), ("findOrFailAction", "ModelNotFoundException", 404), ("validateAction", "ValidationException", 422), ("deepDeclared", "OutOfStockException", 500), ("helper", "OutOfStockException", 500), ("spreadAbort", "HttpException", None)],
        key=str,
    )
    assert rows(got["diagnostics"], "entry", "code") == [("C::anyThrowableNoise", "inference.throw-noise-dropped"), ("C::missing", "inference.method-not-found")]
    assert [json.loads(r.type)["kind"] for r in got["returns"].where("entry = 'C::helper'").orderBy("ord").collect()] == ["scalar", "void"]
    assert {r.entry: r.files for r in got["lineage"].collect()}["C::deepDeclared"] == ["/app/c.php"]


def test_actions_do_not_depend_on_order(spark, engine):
    actions = spark.createDataFrame([("C", m, "/app/c.php") for m in ("abortAction", "deepDeclared", "helper")], "class string, method string, file string")
    first = sorted(r.asDict(True).__repr__() for r in engine.throws(actions).collect())
    shuffled = Engine.create(spark, {k: v.orderBy(F.rand(5)).repartition(3) for k, v in engine.facts.items()}, engine.config)
    assert first == sorted(r.asDict(True).__repr__() for r in shuffled.throws(actions.repartition(2)).collect())


def test_callables_classes_and_closures(spark, engine):
    s = spark.createDataFrame(
        [("c", 20, 0, "A", None, [["Logic"]], False, "Runtime", ["Exception"]), ("c", 10, 1, "B", None, [], True, "Runtime", ["Exception"]), ("c", 30, 2, "C", None, [["Runtime"]], False, "Runtime", ["Exception"]), ("d", 1, 0, "A", None, [], False, None, None), ("d", 2, 1, "B", None, [["X"]], False, None, None)],
        "callable string, pos long, ord int, type string, component string, guard array<array<string>>, delegates boolean, narrowed string, supers array<string>",
    )
    assert rows(engine.analyze_callables(s), "callable", "type", "ambiguous") == [("c", "C", False), ("d", "A", False), ("d", "B", False)]
    meta = engine.class_metadata(spark.createDataFrame([("D",), ("Gone",)], "class string"))
    assert {r["class"]: [p.name for p in r.props] for r in meta.collect()} == {"D": ["id"], "Gone": []}
    at = spark.createDataFrame([("/app/c.php", 3), ("/app/c.php", 4)], "file string, line int")
    assert rows(engine.trace_closures(at, at), "line") == [(3,)]


def test_status_binding(spark):
    acc = scalars.ACCESSOR
    shapes = spark.createDataFrame([(1, 200, ("p", "Identity", None)), (2, None, ("p", "Identity", None)), (3, 201, None)], f"call_id long, status int, status_source {acc}")
    slots = spark.createDataFrame([(1, "p", "404", None), (2, "p", None, "q")], "call_id long, param string, const string, caller_param string")
    assert [(r.call_id, r.status, r.status_source and r.status_source.param) for r in lookups.bind_statuses(shapes, slots).orderBy("call_id").collect()] == [(1, 404, None), (2, None, "q"), (3, 201, None)]


def test_keyed_result_types(spark):
    got = spark.range(1).select(dtype.keyed_array(dtype.scalar("string"), dtype.scalar("int")).alias("t")).first().t
    assert json.loads(got)["key"]["name"] == "string"


def test_views_and_totality(spark):
    acc = scalars.ACCESSOR
    returns = spark.createDataFrame([("s", "v", None, False), ("s", None, 7, True)], "scope_key string, var_name string, expr_id long, is_array boolean")
    arrays = spark.createDataFrame([("s", "v", 5)], "scope_key string, var string, expr_id long")
    items = spark.createDataFrame([(5, 0, "a", ("p", "Identity", None)), (5, 1, "a", ("q", "Identity", None)), (7, 0, "b", ("r", "Name", None))], f"expr_id long, ord int, key string, accessor {acc}")
    got = lookups.payload_provenance(returns, arrays, items)
    assert sorted((r.array_expr, {k: v.param for k, v in r.provenance.items()}) for r in got.collect()) == [(5, {"a": "q"}), (7, {"b": "r"})]
    exprs = spark.createDataFrame([(1, None, (None,)), (2, '{"kind":"void"}', None)], "expr_id long, type_json string, const struct<v: string>")
    places = spark.createDataFrame([(1, "t.php", "s.php", -1, 4)], "expr_id long, trait_file string, scope_file string, pos long, line int")
    a, b = lookups.node_view(exprs, places).orderBy("expr_id").collect()
    assert a.constant is not None and a.constant.v is None and tuple(a.location) == ("t.php", 4, None) and b.constant is None and b.location is None
    f = spark.createDataFrame([("x", None), ("y", "boom")], "entry string, error string")
    assert rows(lookups.failures(f, ["entry"], "inference.action-failed"), "entry", "code", "message") == [("y", "inference.action-failed", "boom")]
    assert [json.loads(r.t)["kind"] for r in f.select(lookups.total(dtype.void_type(), F.col("error")).alias("t")).collect()] == ["void", "unknown"]
