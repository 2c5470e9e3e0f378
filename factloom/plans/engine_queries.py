"""Registered queries that ask the engine whole questions, over facts derived from the test tables; see ``standins``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dtype, guards, scalars
from ..schemas import FACTS
from .engine import Engine, EngineConfig
from .standins import query, table

_BARE = '{"kind":"class","fqcn":"Illuminate\\\\Http\\\\JsonResponse","args":[]}'
_PROBLEM = "/app/problem.php"
#: Ids of the expressions of the shared factory; those of derived expressions start above.
_BODY, _TITLE, _CODE, _HEADERS, _TYPE, _NEW, _FIRST = 1, 2, 3, 4, 5, 6, 1000


def _rows(spark: SparkSession, name: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, FACTS[name])


def _as_facts(df: DataFrame, fact: str, /, **columns: F.Column) -> DataFrame:
    """Rows of a fact table from columns; those not named are null."""
    fields = [f.split(" ", 1) for f in FACTS[fact].split(", ")]
    return df.select(*[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in fields])


def _problem_facts(spark: SparkSession) -> dict[str, DataFrame]:
    """A factory ``Problem::make(title, code)`` that answers with a body, its code as status and a content type."""
    scope = ("Problem", "make")
    shape = '{"kind":"shape","fields":[{"key":"title","type":{"kind":"scalar","name":"string"},"optional":false},{"key":"code","type":{"kind":"scalar","name":"int"},"optional":false}],"is_list":false}'
    exprs = [
        (_TITLE, "variable", '{"kind":"scalar","name":"string"}', None, "no", "title", None, None, *scope),
        (_CODE, "variable", '{"kind":"scalar","name":"int"}', None, "no", "code", None, None, *scope),
        (_BODY, "array", shape, None, "no", None, None, None, *scope),
        (_TYPE, "lit", None, ('"application/problem+json"',), "no", None, None, None, *scope),
        (_HEADERS, "array", None, None, "no", None, None, None, *scope),
        (_NEW, "new", _BARE, None, "no", None, None, None, *scope),
    ]
    facts = {k: _rows(spark, k, []) for k in FACTS}
    facts["exprs"] = _rows(spark, "exprs", exprs)
    facts["array_items"] = _rows(spark, "array_items", [(_BODY, 0, "title", _TITLE), (_BODY, 1, "code", _CODE), (_HEADERS, 0, "Content-Type", _TYPE)])
    facts["args"] = _rows(spark, "args", [(_NEW, k, None, False, e, None, None) for k, e in enumerate((_BODY, _CODE, _HEADERS))])
    facts["params"] = _rows(spark, "params", [("Problem", "make", k, n, False, False, None) for k, n in enumerate(("title", "code"))])
    facts["methods"] = _rows(spark, "methods", [("Problem", "make", _PROBLEM, True)])
    facts["class_methods"] = _rows(spark, "class_methods", [("Problem", "make", "Problem", _PROBLEM, _PROBLEM, 1)])
    facts["return_sites"] = _rows(spark, "return_sites", [(_PROBLEM, "Problem", "make", 0, 1, 1, _NEW, None)])
    facts["attributes"] = _rows(spark, "attributes", [("Problem", "make", 0, "ErrorComponent", "Problem", _PROBLEM, 1)])
    return facts


def _add(facts: dict[str, DataFrame], name: str, rows: DataFrame) -> None:
    facts[name] = facts[name].unionByName(rows)


def _calls_to_factory(facts: dict[str, DataFrame], calls: DataFrame) -> None:
    """calls(id, class, method, code): calls ``Problem::make("t", code)``; a null code does not fold. Uses the ids id, id + 1 and id + 2."""
    scope = {"scope_class": F.col("class"), "scope_fn": F.col("method"), "is_null": F.lit("no")}
    _add(facts, "exprs", _as_facts(calls, "exprs", expr_id=F.col("id"), kind=F.lit("call"), type_json=F.lit(_BARE), member=F.lit("make"), **scope))
    _add(facts, "exprs", _as_facts(calls, "exprs", expr_id=F.col("id") + 1, kind=F.lit("lit"), const=F.struct(F.lit('"t"').alias("v")), **scope))
    _add(facts, "exprs", _as_facts(calls, "exprs", expr_id=F.col("id") + 2, kind=F.lit("x"), const=F.when(F.col("code").isNotNull(), F.struct(F.col("code").cast("string").alias("v"))), **scope))
    _add(facts, "calls", _as_facts(calls, "calls", call_id=F.col("id"), kind=F.lit("static"), callee_name=F.lit("make"), receivers=F.array(F.lit("Problem")), is_first_class=F.lit(False), **{"class": F.col("class"), "method": F.col("method")}))
    for k in (0, 1):
        _add(facts, "args", _as_facts(calls, "args", call_id=F.col("id"), ord=F.lit(k), unpack=F.lit(False), expr_id=F.col("id") + 1 + k))


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 400 + o_orderkey % 50 WHEN 'P' THEN 410 + o_custkey % 5 END::INT AS status, 'application/problem+json' AS content_type, 'title,code' AS members,
  CASE o_orderstatus WHEN 'P' THEN 'Outer' ELSE 'Problem' END AS component FROM orders
""")
def recovered_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9, F7's roots, F8, J6, J18, J19, J20, W3, W10, G5, G6, G9, X7, X10, X11, T11, D11. Orders as actions that answer through a factory.

    Finished ones hand over a constant, open ones what does not fold, those in progress go through one of five helpers.
    """
    facts = _problem_facts(spark)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", (F.col("o_orderkey") * 10 + _FIRST).alias("id"), F.lit("Desk").alias("class"), F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("method"))
    helpers = spark.range(5).select((F.col("id") * 10 + 100).alias("id"), F.lit("Desk").alias("class"), F.concat(F.lit("helper"), F.col("id").cast("string")).alias("method"), (410 + F.col("id")).alias("code"))
    _calls_to_factory(facts, o.where("o_orderstatus != 'P'").select("id", "class", "method", F.when(F.col("o_orderstatus") == "F", 400 + F.col("o_orderkey") % 50).alias("code")).unionByName(helpers))
    far = o.where("o_orderstatus = 'P'").withColumn("to", F.concat(F.lit("helper"), (F.col("o_custkey") % 5).cast("string")))
    _add(facts, "exprs", _as_facts(far, "exprs", expr_id=F.col("id"), kind=F.lit("call"), type_json=F.lit(_BARE), is_null=F.lit("no"), scope_class=F.col("class"), scope_fn=F.col("method")))
    _add(facts, "calls", _as_facts(far, "calls", call_id=F.col("id"), kind=F.lit("method"), callee_name=F.col("to"), receivers=F.array(F.lit("Desk")), is_first_class=F.lit(False)))
    file = F.lit("/app/desk.php")
    for rows in (o, helpers):
        _add(facts, "methods", _as_facts(rows, "methods", file=file, always_terminates=F.lit(True), **{"class": F.col("class"), "method": F.col("method")}))
        _add(facts, "return_sites", _as_facts(rows, "return_sites", file=file, ord=F.lit(0), pos=F.lit(1), line=F.lit(1), expr_id=F.col("id"), **{"class": F.col("class"), "method": F.col("method")}))
    _add(facts, "class_methods", _as_facts(helpers, "class_methods", method=F.col("method"), declaring_class=F.lit("Desk"), written_in_file=file, declaring_file=file, start_line=F.lit(1), **{"class": F.lit("Desk")}))
    _add(facts, "attributes", _as_facts(helpers, "attributes", method=F.col("method"), ord=F.lit(0), name=F.lit("ErrorComponent"), arg0=F.lit("Outer"), file=file, line=F.lit(1), **{"class": F.lit("Desk")}))
    engine = Engine.create(spark, facts, EngineConfig(descend_roots=("/app",), prime_roots=("/app",)))
    typed = engine.typed_sites(o.select(F.col("method").alias("entry"), F.lit(0).alias("ord"), F.col("id").alias("expr_id")))
    read = scalars.from_type_args(F.col("type"))
    keys = F.transform(F.from_json(F.get_json_object(read["payload"], "$.fields"), "array<struct<key: string>>"), lambda f: f["key"])
    return typed.select(F.substring("entry", 2, 20).cast("bigint").alias("o_orderkey"), read["status"].alias("status"), read["content_type"].alias("content_type"), F.array_join(keys, ",").alias("members"), "component")


@query("""
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 404 WHEN 'MACHINERY' THEN 408 ELSE 500 END::INT AS status, CASE WHEN c_custkey % 2 = 0 THEN 'Own' ELSE 'Problem' END AS component FROM customer
""")
def callable_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1, W2, W13, P19, F4, F5, A7. Customers as callables with an arm for each of two exceptions and a default; segments as the narrowed class."""
    facts = _problem_facts(spark)
    c = table(spark, sf_dir, "customer")
    arms = spark.createDataFrame([(100, "Building", 404), (110, "Machinery", 408), (120, None, 500)], "id bigint, guard string, code int").withColumn("class", F.lit("Desk")).withColumn("method", F.lit("render"))
    _calls_to_factory(facts, arms.select("id", "class", "method", "code"))
    _add(facts, "exprs", _rows(spark, "exprs", [(200, "match", _BARE, None, "no", None, None, None, "Desk", "render")]))
    guard = F.when(F.col("guard").isNull(), guards.no_guard()).otherwise(F.array(F.array("guard")))
    _add(facts, "match_arms", _as_facts(arms, "match_arms", expr_id=F.lit(200), ord=F.col("id").cast("int"), cond_dnf=guard, is_default=F.col("guard").isNull(), body_expr_id=F.col("id"), pos=F.col("id")))
    for name in ("render", "renderOwn"):
        _add(facts, "methods", _rows(spark, "methods", [("Desk", name, "/app/desk.php", True)]))
        _add(facts, "return_sites", _rows(spark, "return_sites", [("/app/desk.php", "Desk", name, 0, 90, 1, 200, None)]))
    _add(facts, "attributes", _rows(spark, "attributes", [("Desk", "renderOwn", 0, "ErrorComponent", "Own", "/app/desk.php", 1)]))
    facts["class_closure"] = _rows(spark, "class_closure", [("BUILDING", "Building"), ("MACHINERY", "Machinery")])
    refs = c.select(F.col("c_custkey").cast("string").alias("callable"), F.lit("Desk").alias("class"), F.when(F.col("c_custkey") % 2 == 0, "renderOwn").otherwise("render").alias("method"), F.lit("/app/desk.php").alias("file"), F.lit(None).cast("int").alias("line"), F.col("c_mktsegment").alias("narrowed"))
    engine = Engine.create(spark, facts, EngineConfig(descend_roots=("/app",), prime_roots=("/app",)))
    got = engine.analyze_callable_refs(refs)["returns"]
    return got.select(F.col("callable").cast("bigint").alias("c_custkey"), scalars.from_type_args(F.col("type"))["status"].alias("status"), "component")


@query("""
WITH c AS (SELECT user_id, event_id % 100 AS line, arg_max(value >= 50, event_id) AS ends FROM events WHERE event_type = 'click' GROUP BY 1, 2)
SELECT e.event_id FROM events e JOIN c ON e.user_id = c.user_id AND e.event_id % 100 = c.line WHERE c.ends
""")
def closure_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D12. Clicks as closures by line, the later of two on a line; events as return statements, kept where the closure always returns."""
    e = table(spark, sf_dir, "events")
    rows = e.where("event_type = 'click'").select(F.col("user_id").cast("string").alias("file"), (F.col("event_id") % 100).cast("int").alias("line"), F.col("event_id").alias("ord"), (F.col("value") >= 50).alias("always_terminates"))
    last = rows.groupBy("file", "line").agg(F.max_by("always_terminates", "ord").alias("always_terminates"))
    engine = Engine.create(spark, {"closures": last})
    returns = e.select("event_id", F.col("user_id").cast("string").alias("file"), (F.col("event_id") % 100).cast("int").alias("line"))
    return engine.trace_closures(returns.select("file", "line").distinct(), returns).select("event_id")


@query("""
WITH p AS (SELECT o_custkey, count(*) AS n, count(DISTINCT CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END) AS enums FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(n, 0)::INT AS properties, (1 + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END + coalesce(enums, 0))::INT AS files FROM customer LEFT JOIN p ON o_custkey = c_custkey
""")
def class_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S12, A9, A10, X13, J27. Customers as classes, orders as properties; orders in progress hold an enum, even classes have a parent."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    enum = dtype.list_type(dtype.enum_type(F.col("o_orderpriority"), F.array(F.lit("a"))))
    kind = F.when(F.col("o_orderstatus") == "P", enum).otherwise(dtype.scalar("int"))
    name = lambda k: F.concat(F.lit("C"), F.col(k).cast("string"))
    props = _as_facts(o, "properties", ord=F.col("o_orderkey").cast("int"), name=F.col("o_orderkey").cast("string"), native_type_json=kind, is_static=F.lit(False), is_promoted=F.lit(False), source=F.lit("reflection"), **{"class": name("o_custkey")})
    classes = _as_facts(c, "classes", file=F.concat(F.lit("/"), name("c_custkey")), **{"class": name("c_custkey")})
    classes = classes.unionByName(_as_facts(o.select("o_orderpriority").distinct(), "classes", file=F.concat(F.lit("/"), F.col("o_orderpriority")), **{"class": F.col("o_orderpriority")})).unionByName(_rows(spark, "classes", [("Parent", "/parent", False, False, False)]))
    above = _as_facts(c.where("c_custkey % 2 = 0"), "class_closure", sub=name("c_custkey"), super=F.lit("Parent"))
    engine = Engine.create(spark, {"properties": props, "classes": classes, "class_closure": above})
    got = engine.class_metadata(c.select(name("c_custkey").alias("class")))
    return got.select(F.substring("class", 2, 20).cast("bigint").alias("c_custkey"), F.size("props").alias("properties"), F.size("files").alias("files"))
