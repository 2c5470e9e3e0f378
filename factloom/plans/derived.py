"""Registered queries of scalar, type, lookup and set operators, each with its SQL; see ``standins``.

Every query derives its facts from whole tables and runs the operators it names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import registry as reg
from ..functions import dtype, folding, guards, scalars, signatures
from ..operators import aggregates, graph, lookups, windows
from ..sources import facts
from .standins import query, table

#: JSON texts of types in SQL.
_INT, _STR = '{"kind":"scalar","name":"int"}', '{"kind":"scalar","name":"string"}'
_NULL, _VOID = '{"kind":"null"}', '{"kind":"void"}'


def _cls(name: str, *args: str) -> str:
    return '{"kind":"class","fqcn":"%s","args":[%s]}' % (name, ",".join(args))


def _union(*members: str) -> str:
    return '{"kind":"union","members":[%s]}' % ",".join(members)


def _unknown(reason: str) -> str:
    return '{"kind":"unknown","reason":"%s"}' % reason


def _strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _accessor(param: Column | str, kind: str, method: str | None = None) -> Column:
    return F.struct((F.lit(param) if isinstance(param, str) else param).alias("param"), F.lit(kind).alias("kind"), F.lit(method).cast("string").alias("method"))


# ------------------------------------------------------------ paths, names, predicates


@query("""
WITH p AS (SELECT p_partkey, '/app/' || lower(p_brand) || '/f.php' AS path, p_partkey % 4 AS k, p_size FROM part),
v AS (SELECT *, CASE WHEN k = 0 THEN true WHEN k = 1 THEN path LIKE '/app/brand#13/%' ELSE false END AS vendor FROM p)
SELECT p_partkey, path, vendor, p_size > 25 AND NOT vendor AND k < 3 AS follows,
  path LIKE '/app/brand#21/%' OR (NOT vendor AND p_size % 2 = 0) OR p_size % 5 = 0 AS folds FROM v
""")
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2, F3, F19, D4, X16. Brands as folders of source files, four kinds of vendor root."""
    k = F.col("p_partkey") % 4
    p = table(spark, sf_dir, "part").select("p_partkey", scalars.normalize_path(F.concat(F.lit("/app/./old/..//"), F.lower("p_brand"), F.lit("/f.php"))).alias("path"), k.alias("k"), "p_size")
    root = F.when(F.col("k") == 0, F.lit(None).cast("string")).when(F.col("k") == 1, "/app/brand#13").otherwise("/vendor")
    path, even = F.col("path"), F.when(F.col("p_size") % 2 == 0, F.col("path")).otherwise("x")
    return p.select("p_partkey", "path", scalars.is_vendor_file(path, root).alias("vendor"), scalars.follow_beyond_project(F.col("p_size") > 25, path, root, F.col("k") < 3).alias("follows"), scalars.can_fold_callee(path, even, _strings("/app/brand#21"), root, F.col("p_size") % 5 == 0).alias("folds"))


@query(r"""
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN 'App\' || c_mktsegment END AS cls, CASE WHEN c_custkey % 5 <> 0 THEN 'm' || c_nationkey END AS fn, c_custkey % 7 - 1 AS pos FROM customer)
SELECT c_custkey, CASE WHEN cls IS NOT NULL AND fn IS NOT NULL THEN regexp_replace(cls, '^App.', '') || '::' || fn END AS label,
  CASE WHEN fn IS NOT NULL THEN CASE WHEN cls IS NULL THEN fn ELSE cls || '::' || fn END END AS scope,
  '''it''''s ' || c_custkey || '''' AS quoted,
  CASE WHEN c_custkey % 2 = 0 THEN 'trait.php' ELSE 'scope.php' END AS file, CASE WHEN pos >= 0 THEN pos END AS pos,
  CASE WHEN pos >= 0 THEN pos ELSE 9223372036854775807 END::BIGINT AS place, c_custkey % 4 = 1 AS bare_response, c_custkey % 4 <> 2 AS inherited,
  CASE WHEN fn IS NOT NULL AND cls IS NOT NULL THEN regexp_replace(cls, '^App.', '') || '::' || fn || '@' || c_custkey END AS framed FROM c
""")
def site_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13, P14, X12, X14, W7, F8, F22. Customers as sites in classes (segments) and functions (nations)."""
    c = table(spark, sf_dir, "customer")
    cls, fn = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("App\\"), F.col("c_mktsegment"))), F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("m"), F.col("c_nationkey").cast("string")))
    pos = F.col("c_custkey") % 7 - 1
    at = scalars.written_location(F.when(F.col("c_custkey") % 2 == 0, "trait.php"), F.lit("scope.php"), pos, F.lit(1))
    label = scalars.self_label(cls, fn)
    shown = scalars.frame(label, F.lit("f"), F.col("c_custkey"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("App\\Answer", scalars.RESPONSE_CLASSES[1], "int", "Response")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return c.select(
        "c_custkey", label.alias("label"), scalars.scope_key(cls, fn).alias("scope"), scalars.neon_string(F.concat(F.lit("it's "), F.col("c_custkey").cast("string"))).alias("quoted"), at["file"].alias("file"), at["pos"].alias("pos"),
        scalars.source_order(pos).alias("place"), scalars.is_response_class(kind).alias("bare_response"), scalars.inherited_unchanged(F.when(F.col("c_custkey") % 4 != 2, "concern.php").otherwise("c.php"), F.lit("c.php")).alias("inherited"), F.concat(shown["label"], F.lit("@"), shown["line"].cast("string")).alias("framed"),
    )


@query("""
WITH a AS (SELECT l_orderkey, l_returnflag = 'N' AS named, bool_or(l_quantity >= 45) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS behind FROM lineitem)
SELECT l_orderkey, bool_or(named AND NOT behind) AS variable FROM a GROUP BY l_orderkey
""")
def variable_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F15. Order lines as arguments: new ones are plain variables, a line of 45 or more is a spread."""
    li = table(spark, sf_dir, "lineitem")
    arg = F.struct("l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") >= 45).alias("unpack"), F.when(F.col("l_returnflag") == "N", "v").alias("var_name"))
    args = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(arg)).alias("args"))
    return args.select("l_orderkey", scalars.has_variable_argument(F.col("args")).alias("variable"))


# ------------------------------------------------------------ types


@query(f"""
SELECT o_orderkey, CASE WHEN o_custkey % 14 >= 12 THEN '{_unknown("translation depth budget exhausted")}' ELSE CASE o_orderkey % 12
  WHEN 0 THEN '{_NULL}' WHEN 1 THEN '{_VOID}' WHEN 2 THEN '{{"kind":"never"}}' WHEN 3 THEN '{{"kind":"literal","value":"x"}}'
  WHEN 4 THEN '{{"kind":"shape","fields":[{{"key":"a","type":{_INT},"optional":true}}],"is_list":false}}' WHEN 5 THEN '{_union(_cls("A"), _NULL)}'
  WHEN 6 THEN '{{"kind":"intersection","members":[{_cls("A")},{_cls("B")}]}}' WHEN 7 THEN '{_cls("G", _INT)}' WHEN 8 THEN '{{"kind":"enum","fqcn":"E","cases":["a","b"]}}'
  WHEN 9 THEN '{{"kind":"map","key":{_STR},"value":{_INT}}}' WHEN 10 THEN '{_INT}' ELSE CASE WHEN o_custkey % 2 = 0 THEN '{_unknown("resource")}' ELSE '{_unknown("unresolved type")}' END END END AS type FROM orders
""")
def translated_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, P2, P3, P4, P5, P6, P15. Orders as values of twelve kinds, nested by customer."""
    k = F.col("o_orderkey") % 12
    only = lambda n, t: F.when(k == n, t)
    shape = dtype.shape(dtype.shape_fields(_strings("a"), F.array(dtype.scalar("int")), F.array(F.lit(0))))
    f = {
        "is_null": k == 0, "is_void": k == 1, "is_never": k == 2, "is_callable": F.lit(False), "is_int": k == 10, "is_string": F.lit(False), "is_float": F.lit(False), "is_bool": F.lit(None).cast("boolean"),
        "literal": only(3, dtype.constant_literal(_strings('"x"'), _strings())), "constant_array": only(4, shape), "union": only(5, dtype.union_of(F.array(dtype.null_type(), dtype.class_type("A")))),
        "intersection": only(6, dtype.translate_intersection(F.lit(False), dtype.scalar("int"), F.array(dtype.class_type("B"), dtype.class_type("A")))), "bound": F.lit(None).cast("string"), "generic": only(7, dtype.class_type("G", F.array(dtype.scalar("int")))),
        "single_class": only(8, dtype.translate_object(F.lit("E"), _strings("a", "b"), _strings())), "array": only(9, dtype.keyed_array(dtype.scalar("string"), dtype.scalar("int"))), "described": F.when(F.col("o_custkey") % 2 == 0, "resource"),
    }
    return table(spark, sf_dir, "orders").select("o_orderkey", dtype.translate(f, F.col("o_custkey") % 14).alias("type"))


_AI, _B = _cls("A", _INT), _cls("B")


@query(f"""
WITH t AS (SELECT o_orderkey, o_orderkey % 6 AS k, o_custkey % 2 = 0 AS even, CASE o_orderkey % 6 WHEN 0 THEN '{_VOID}' WHEN 1 THEN '{_NULL}' WHEN 2 THEN '{_cls("A")}'
  WHEN 3 THEN '{_union(_AI, _unknown("u"))}' WHEN 4 THEN '{_union(_cls("A"), _NULL)}' ELSE '{_INT}' END AS t FROM orders)
SELECT o_orderkey, k < 2 AS delegation, k <> 3 AS precise, k IN (2, 4) AS parameterisable, CASE WHEN k > 0 THEN t END AS payload,
  CASE k WHEN 2 THEN '{_AI}' WHEN 4 THEN '{_union(_AI, _NULL)}' ELSE t END AS parameterised,
  CASE WHEN k IN (3, 5) THEN CASE WHEN even THEN '{_B}' ELSE '{_STR}' END ELSE t END AS property FROM t
""")
def type_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9, F13, F14, P12, J25, X13. Orders as values of six types; a doc comment names classes with arguments."""
    k = F.col("o_orderkey") % 6
    t = F.when(k == 0, dtype.void_type()).when(k == 1, dtype.null_type()).when(k == 2, dtype.class_type("A")).when(k == 3, dtype.union_of(F.array(dtype.class_type("A", F.array(dtype.scalar("int"))), dtype.unknown("u")))).when(k == 4, dtype.nullable(dtype.class_type("A"))).otherwise(dtype.scalar("int"))
    written = dtype.union_of(F.array(dtype.class_type("B"), dtype.class_type("A", F.array(dtype.scalar("int")))))
    promoted = F.when(F.col("o_custkey") % 2 == 0, dtype.class_type("B")).otherwise(dtype.unknown("u"))
    native = F.when(F.col("k") != 5, F.col("t"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", k.alias("k"), t.alias("t")).crossJoin(F.broadcast(spark.range(1).select(written.alias("written"))))
    return rows.select(
        "o_orderkey", dtype.is_delegation(F.col("t")).alias("delegation"), dtype.precise(F.col("t")).alias("precise"), dtype.parameterisable(F.col("t")).alias("parameterisable"), dtype.documentable_payload(F.col("t")).alias("payload"),
        dtype.parameterise(F.col("t"), F.col("written")).alias("parameterised"), dtype.property_type(native, promoted, dtype.scalar("string")).alias("property"),
    )


@query("""
WITH m AS (SELECT DISTINCT o_custkey, '{"kind":"class","fqcn":"' || o_orderpriority || '","args":[]}' AS t FROM orders)
SELECT o_custkey, CASE WHEN count(*) = 1 THEN min(t) ELSE '{"kind":"intersection","members":[' || string_agg(t, ',' ORDER BY t) || ']}' END AS type FROM m GROUP BY o_custkey
""")
def canonical_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U6. The order priorities of a customer as an intersection of classes."""
    o = table(spark, sf_dir, "orders").select("o_custkey", dtype.class_type(F.col("o_orderpriority")).alias("t"))
    return o.groupBy("o_custkey").agg(F.collect_list("t").alias("ts")).select("o_custkey", dtype.intersection_of(F.col("ts")).alias("type"))


_MERGED = _cls("Illuminate\\\\Http\\\\Resources\\\\MergeValue", _INT)
_MISSING = _cls("Illuminate\\\\Http\\\\Resources\\\\MissingValue")
_R = "Illuminate\\\\Http\\\\JsonResponse"
_ANY = "Illuminate\\\\Http\\\\Resources\\\\Json\\\\AnonymousResourceCollection"


@query(f"""
WITH c AS (SELECT o_orderkey, o_orderkey % 10 AS k, o_custkey % 3 AS a, o_orderstatus AS s FROM orders)
SELECT o_orderkey, CASE WHEN s = 'P' THEN NULL ELSE CASE k
  WHEN 0 THEN CASE WHEN a = 0 THEN '{_union(_MISSING, _INT)}' WHEN a = 1 THEN '{_union(_MISSING, _NULL)}' ELSE '{_union(_INT, _NULL)}' END
  WHEN 1 THEN CASE WHEN a <> 1 THEN '{_MERGED}' END
  WHEN 2 THEN CASE a WHEN 0 THEN '{_union(_MERGED, _MISSING)}' WHEN 2 THEN '{_union(_MERGED, _NULL)}' END
  WHEN 3 THEN '{_cls("Illuminate" + chr(92) * 2 + "Http" + chr(92) * 2 + "Resources" + chr(92) * 2 + "MergeValue", '{"kind":"map","key":' + _STR + ',"value":' + _unknown("mixed") + "}")}'
  WHEN 4 THEN CASE a WHEN 0 THEN '{_cls(_R, _INT, '{"kind":"literal","value":200}')}' WHEN 2 THEN '{_cls(_R, _INT, '{"kind":"literal","value":201}')}' END
  WHEN 5 THEN CASE a WHEN 0 THEN '{_cls(_R, _VOID, '{"kind":"literal","value":204}')}' WHEN 1 THEN '{_cls(_R, _VOID, _INT)}' ELSE '{_cls(_R, _VOID, '{"kind":"literal","value":201}')}' END
  WHEN 6 THEN CASE WHEN a <> 2 THEN '{_cls(_R, _cls("Data"))}' END
  WHEN 7 THEN CASE WHEN a <> 2 THEN '{_cls("Data")}' END
  WHEN 8 THEN CASE WHEN a = 0 THEN '{_cls("Illuminate" + chr(92) * 2 + "Http" + chr(92) * 2 + "Resources" + chr(92) * 2 + "Json" + chr(92) * 2 + "JsonResource")}' ELSE '{_cls("Page")}' END
  ELSE CASE WHEN a = 0 THEN '{_cls("Illuminate" + chr(92) * 2 + "Http" + chr(92) * 2 + "Resources" + chr(92) * 2 + "Json" + chr(92) * 2 + "ResourceCollection")}' ELSE '{_cls(_ANY, _cls("Page"))}' END END END AS type FROM c
""")
def signature_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5, D6, D7, D8, Z1, Z2, Z3, Z4, Z6, Z7. Orders as calls of ten methods; customers decide which arguments are written."""
    names = ("when", "merge", "mergeWhen", "attributes", "json", "noContent", "toResponse", "transform", "toResource", "toResourceCollection")
    a = F.col("o_custkey") % 3
    calls = table(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), (F.col("o_orderstatus") != "P").alias("is_call"), F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("o_orderkey") % 10 + 1).cast("int")).alias("call_name"))
    rules = reg.signatures(spark)
    a, written = F.col("a"), F.when(F.col("a") != 1, dtype.scalar("int"))
    call = {
        "receiver": dtype.class_type("Data"), "value": written, "default": F.when(a == 2, dtype.null_type()), "payload": written, "status": F.when(a == 2, dtype.literal(F.lit("201"))), "status_known": a != 1,
        "class_arg": F.when(a != 0, "Page"), "inherited": a != 2, "is_call": F.col("is_call"),
    }
    return calls.join(rules, F.col("call_name") == F.col("name"), "left").select("o_orderkey", signatures.call_type(F.col("effect"), F.col("default_status"), call).alias("type"))


@query(f"""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '{_cls(_ANY, _cls("XX"))}' END AS type FROM part
""".replace('"XX"', "\"' || p_brand || '\""))
def collection_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z5. Brands as resource classes; the odd sizes' receivers are unions and name no single class."""
    receiver = F.when(F.col("p_size") % 2 == 0, dtype.class_type(F.col("p_brand"))).otherwise(dtype.nullable(dtype.class_type(F.col("p_brand"))))
    none = F.lit(None).cast("string")
    call = {"receiver": receiver, "value": none, "default": none, "payload": none, "status": none, "status_known": F.lit(True), "class_arg": none, "inherited": F.lit(True), "is_call": F.lit(True)}
    rules = reg.signatures(spark).where("name = 'newCollection'").select("effect", "default_status")
    return table(spark, sf_dir, "part").join(rules).select("p_partkey", signatures.call_type(F.col("effect"), F.col("default_status"), call).alias("type"))


# ------------------------------------------------------------ folding and response records


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER w - 1 AS slot, l_quantity >= 48 AS is_spread, 400 + l_suppkey % 50 AS code, l_returnflag = 'A' AS fixed,
  bool_or(l_quantity >= 48) OVER (w ROWS UNBOUNDED PRECEDING) AS behind FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
s AS (SELECT l_orderkey, max(CASE WHEN slot = 1 AND fixed AND NOT behind THEN code END) AS folded, max(slot) >= 1 AS present, bool_or(is_spread) AS has_spread FROM a GROUP BY l_orderkey)
SELECT l_orderkey, folded::INT AS status, CASE WHEN present THEN folded WHEN NOT has_spread THEN 200 END::INT AS with_default, CASE WHEN folded IS NULL THEN 'code' END AS source,
  CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_orderkey % 3 = 1 THEN l_orderkey % 1000 END::INT AS literal, l_orderkey % 3 <> 0 AS has_constant FROM s
""")
def folded_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3, X4, X5, X6, X7's default. Order lines as arguments of a response's constructor, the second is the status."""
    li = table(spark, sf_dir, "lineitem")
    arg = F.struct("l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") >= 48).alias("unpack"), F.when(F.col("l_returnflag") == "A", (400 + F.col("l_suppkey") % 50).cast("string")).alias("const"))
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(arg)).alias("args"))
    status = scalars.fold_status_arg(F.col("args"), F.lit(1))
    known = ~F.exists("args", lambda a: a["unpack"])
    resolved = scalars.resolve_status(F.col("status"), _accessor("code", "Identity"))
    values = F.when(F.col("l_orderkey") % 3 == 0, F.array().cast("array<string>")).when(F.col("l_orderkey") % 3 == 1, F.array((F.col("l_orderkey") % 1000).cast("string"))).otherwise(_strings("null"))
    rows = rows.withColumn("status", status).withColumn("folded", folding.scalar_fold(values))
    return rows.select("l_orderkey", "status", scalars.default_if_absent(known, F.col("status"), F.size("args") >= 2, 200).alias("with_default"), resolved["status_source"]["param"].alias("source"), folding.int_literal(F.col("folded")).alias("literal"), F.col("folded").isNotNull().alias("has_constant"))


@query("""
WITH c AS (SELECT c_custkey, c_custkey % 5 AS k FROM customer)
SELECT c_custkey, CASE k WHEN 0 THEN '{"args":[{"kind":"scalar","value":' || c_custkey || '},{"kind":"unknown","reason":"non-constant factory arg"}],"chain":[],"kind":"descriptor","name":"Shop\\\\Rule::at"}'
  WHEN 1 THEN '{"items":[{"kind":"scalar","value":' || c_custkey || '},{"kind":"spread","reason":"spread array item"}],"kind":"array"}' WHEN 2 THEN '{"kind":"scalar","value":' || c_custkey || '}'
  WHEN 3 THEN '{"args":[],"chain":[{"args":[{"kind":"scalar","value":' || c_custkey || '}],"name":"or"}],"kind":"descriptor","name":"Shop\\\\Rule::at"}' END AS constant,
  CASE k WHEN 0 THEN 'Rule::at(' || c_custkey || ', <unknown: non-constant factory arg>)' WHEN 1 THEN '[' || c_custkey || ', ...<spread array item>]' WHEN 2 THEN c_custkey::VARCHAR WHEN 3 THEN 'Rule::at()->or(' || c_custkey || ')' END AS shown FROM c
""".replace("\\\\\\\\", "\\\\"))
def folded_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1, X2. Customers as constant expressions of five forms, folded and written out."""
    key = F.col("c_custkey").cast("string")
    rule = '"t":"static","class":"Shop\\\\\\\\Rule","name":"at"'
    forms = [
        F.concat(F.lit("{" + rule.replace("\\\\\\\\", "\\\\") + ',"args":[{"value":{"t":"var","name":"k"}},{"value":{"t":"var","name":"free"}}]}')),
        F.lit('{"t":"array","items":[{"value":{"t":"var","name":"k"}},{"value":{"t":"var","name":"rest"},"unpack":true}]}'),
        F.concat(F.lit('{"t":"method","var":{"t":"lit","v":1},"name":"m","args":[],"v":'), key, F.lit("}")),
        F.lit('{"t":"method","name":"or","var":{' + rule.replace("\\\\\\\\", "\\\\") + ',"args":[]},"args":[{"value":{"t":"var","name":"k"}}]}'),
        F.lit('{"t":"var","name":"free"}'),
    ]
    expr = F.element_at(F.array(*forms), (F.col("c_custkey") % 5 + 1).cast("int"))
    bound = F.concat(F.lit('{"k":{"kind":"scalar","value":'), key, F.lit("}}"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", folding.fold_constant(expr, bound).alias("constant"))
    return rows.select("c_custkey", "constant", folding.render_constant("constant").alias("shown"))


@query(f"""
WITH r AS (SELECT o_orderkey, o_orderkey % 3 AS k, o_custkey % 2 = 0 AS even, o_custkey % 5 AS c FROM orders)
SELECT o_orderkey, '{{"kind":"shape","fields":[{{"key":"status","type":' || CASE WHEN even THEN '{{"kind":"status_marker"}}' ELSE '{_INT}' END || ',"optional":true}},{{"key":"note","type":{_STR},"optional":true}}],"is_list":false}}' AS marked,
  '{{"kind":"shape","fields":[{{"key":"status","type":{_INT},"optional":true}},{{"key":"note","type":' || CASE WHEN k = 0 THEN '{{"kind":"literal","value":"x"}}' ELSE '{_STR}' END || ',"optional":' || CASE WHEN k = 0 THEN 'false' ELSE 'true' END || '}}],"is_list":false}}' AS bound,
  CASE WHEN k = 1 THEN 'r' END AS reads, 'status' AS left_over, k = 2 AS source_named, CASE WHEN k = 2 THEN NULL ELSE 200 + c END::INT AS status, true AS delegates FROM r
""")
def rewritten_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P16, P17, U8, U9, U10, F16. Orders as response records whose members a call site binds, re-homes or leaves."""
    fields = F.array(F.struct(F.lit("status").alias("key"), dtype.scalar("int").alias("type"), F.lit(True).alias("optional")), F.struct(F.lit("note").alias("key"), dtype.scalar("string").alias("type"), F.lit(True).alias("optional")))
    from_ = F.create_map(F.lit("status"), _accessor("p", "Identity"), F.lit("note"), _accessor("q", "Value"))
    k = F.col("o_orderkey") % 3
    source = _accessor(F.when(F.col("o_custkey") % 2 == 0, "p").otherwise("z"), "Identity")
    bound, left = scalars.bind_member(fields, from_, F.lit("note"), F.when(k == 0, '"x"'), F.when(k == 1, _accessor("r", "Value")), k == 0)
    record = F.struct(F.lit(None).cast("int").alias("status"), _accessor("p", "Identity").alias("status_source"), F.lit(False).alias("delegates"))
    record = F.when(k == 2, scalars.with_status_source(record, source)).otherwise(scalars.with_bound_status(record, (200 + F.col("o_custkey") % 5).cast("int")))
    record = scalars.delegated(record)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dtype.shape(scalars.mark_status_members(fields, from_, source)).alias("marked"), dtype.shape(bound).alias("bound"), F.try_element_at(left, F.lit("note"))["param"].alias("reads"),
        F.array_join(F.transform(scalars.without_member(fields, F.lit("note")), lambda f: f["key"]), ",").alias("left_over"), record["status_source"].isNotNull().alias("source_named"), record["status"].alias("status"), record["delegates"].alias("delegates"),
    )


@query("""
WITH r AS (SELECT p_partkey, p_partkey % 4 AS k, p_size FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR END WHEN 1 THEN 'backing' WHEN 2 THEN 'Case' ELSE 'computed' END AS folded,
  CASE WHEN p_size > 25 THEN 'caller' END AS rehomed, k = 0 AS same, CASE WHEN p_size % 2 = 1 THEN 'second' ELSE 'first' END AS last_wins FROM r
""")
def folded_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X10, X11, F16, J20. Parts as arguments that four kinds of accessor read."""
    k = F.col("p_partkey") % 4
    kind = F.element_at(_strings("Identity", "Value", "Name", "Method"), (k + 1).cast("int"))
    acc = F.struct(F.lit("p").alias("param"), kind.alias("kind"), F.when(kind == "Method", "m").alias("method"))
    folded = scalars.fold_accessor_argument(kind, F.col("p_size").cast("string"), F.col("p_size") % 2 == 1, F.lit("backing"), F.lit("Case"), F.lit("computed"))
    items = F.array(F.struct(F.lit("a").alias("key"), _accessor("first", "Identity").alias("accessor")), F.struct(F.when(F.col("p_size") % 2 == 1, "a").alias("key"), _accessor("second", "Identity").alias("accessor")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", folded.alias("folded"), lookups.rehome_accessor(acc, F.when(F.col("p_size") > 25, "caller"))["param"].alias("rehomed"), scalars.accessor_equals(acc, _accessor("p", "Identity")).alias("same"),
        F.try_element_at(scalars.provenance_from_array(items), F.lit("a"))["param"].alias("last_wins"),
    )


@query(f"""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '{{"kind":"unknown","reason":"analysis failed: boom ' || c_custkey || '"}}' ELSE '{_VOID}' END AS type,
  CASE WHEN c_custkey % 4 = 0 THEN 'boom ' || c_custkey END AS message, CASE WHEN c_custkey % 2 = 0 THEN 'text/csv' WHEN c_custkey % 3 = 0 THEN 'text/html' END AS content_type FROM customer
""")
def total_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X17, X18's label. Customers as analyses, every fourth of which fails."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("boom "), F.col("c_custkey").cast("string"))).alias("error"))
    failed = lookups.failures(rows, ["c_custkey"], "inference.action-failed").select(F.col("c_custkey").alias("f_key"), "message")
    label = lookups.labelled_content_type(F.when(F.col("c_custkey") % 2 == 0, "text/csv"), F.when(F.col("c_custkey") % 3 == 0, "text/html"))
    return rows.join(failed, F.col("c_custkey") == F.col("f_key"), "left").select("c_custkey", lookups.total(dtype.void_type(), F.col("error")).alias("type"), "message", label.alias("content_type"))


# ------------------------------------------------------------ lookups


@query("""
WITH c AS (SELECT o_orderkey AS call_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'abort' WHEN '2-HIGH' THEN 'findOrFail' WHEN '3-MEDIUM' THEN 'validate' WHEN '4-NOT SPECIFIED' THEN 'sorted_out' ELSE 'other' END AS name,
  o_custkey % 7 = 0 AS spread, 400 + o_custkey % 20 AS code, o_orderkey % 11 = 0 AS has_body, o_orderkey % 22 = 0 AS in_project FROM orders)
SELECT call_id, CASE name WHEN 'abort' THEN 'HttpException' WHEN 'findOrFail' THEN 'ModelNotFoundException' WHEN 'validate' THEN 'Rejected' ELSE 'Custom' END AS exception,
  CASE name WHEN 'abort' THEN CASE WHEN NOT spread THEN code END WHEN 'findOrFail' THEN 404 WHEN 'validate' THEN 499 ELSE 418 END::INT AS status, 'Likely' AS confidence FROM c WHERE name <> 'other' AND NOT in_project
""")
def registry_throws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3, J4, J26, U7, D10, F7. Orders as calls of known throwers, some with a project body that is read instead."""
    o = table(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderpriority") == "1-URGENT", "abort").when(F.col("o_orderpriority") == "2-HIGH", "findOrFail").when(F.col("o_orderpriority") == "3-MEDIUM", "validate").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "sorted_out").otherwise("other")
    args = F.array(F.struct((F.col("o_custkey") % 7 == 0).alias("unpack"), (400 + F.col("o_custkey") % 20).cast("string").alias("const")))
    calls = o.select(F.col("o_orderkey").alias("call_id"), name.alias("callee_name"), args.alias("status_args"))
    points = o.select(F.lit("f").alias("file"), F.lit("C").alias("class"), F.lit("m").alias("method"), F.lit(1).alias("ord"), F.lit(1).alias("line"), F.lit(False).alias("explicit"), _strings("Throwable").alias("types"), F.col("o_orderkey").alias("call_id"))
    more = spark.createDataFrame([("function", "sorted_out", 0, "Custom", 418, None), ("method", "validate", 1, "Rejected", 499, None)], reg.REGISTRY_SCHEMA)
    callees = o.where("o_orderkey % 11 = 0").select(F.col("o_orderkey").alias("call_id"), F.lit("C").alias("callee_class"), F.lit("m").alias("callee_method"), F.when(F.col("o_orderkey") % 22 == 0, "/app/c.php").otherwise("/vendor/c.php").alias("callee_file"))
    bodies = lookups.reads_body(calls, callees, spark.createDataFrame([("C", "m")], "class string, method string"), _strings("/app"))
    # The line of a point is its call.
    keyed = lookups.apply_registry(points.withColumn("line", F.col("call_id").cast("int")), calls, reg.extend(reg.default_registry(spark), more), bodies)
    return keyed.select(F.col("line").cast("bigint").alias("call_id"), scalars.short_name(F.col("exception")).alias("exception"), "status", "confidence")


@query("""
WITH w AS (SELECT l_orderkey, l_suppkey, count(*) AS n, min(l_partkey) AS part FROM lineitem GROUP BY 1, 2), o AS (SELECT l_orderkey, min(l_suppkey) AS supp FROM lineitem GROUP BY 1),
f AS (SELECT l_orderkey, l_suppkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS first FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2)
SELECT o.l_orderkey, CASE WHEN w.n = 1 AND w.part % 2 = 0 THEN w.part END AS assigned, CASE WHEN o.l_orderkey % 2 = 0 THEN o.l_orderkey ELSE f.first END AS array_expr,
  CASE WHEN o.l_orderkey % 3 = 0 THEN 'Written' WHEN o.l_orderkey % 3 = 1 THEN 'only' END AS enum_case, CASE WHEN o.l_orderkey % 3 = 1 THEN 'only' END AS one
FROM o JOIN w ON o.l_orderkey = w.l_orderkey AND o.supp = w.l_suppkey LEFT JOIN f ON o.l_orderkey = f.l_orderkey AND o.supp = f.l_suppkey
""")
def returned_locals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15, J16, J17, A11, W4. Orders as functions that return a variable (their least supplier), lines as writes."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("scope_key"), F.col("l_suppkey").cast("string").alias("var"), F.col("l_partkey").alias("expr_id"), "l_linenumber", "l_returnflag", F.lit(False).alias("retires"), F.lit(False).alias("opaque"))
    single = aggregates.single_assignments(li, ["scope_key", "var"]).withColumn("from_variable", F.col("expr_id") % 2 == 1)
    first = windows.first_initialisers(li.where("l_returnflag = 'N'"), ["scope_key", "var"], F.struct("l_linenumber", "expr_id"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").cast("string").alias("var_name"))
    rows = rows.select("l_orderkey", F.col("l_orderkey").cast("string").alias("scope_key"), "var_name", F.col("l_orderkey").alias("expr_id"), (F.col("l_orderkey") % 2 == 0).alias("is_array"))
    out = lookups.body_array(lookups.refine_locals(rows, single), first)
    cases = F.when(F.col("l_orderkey") % 3 == 1, _strings("only")).otherwise(_strings("one", "two"))
    return out.select("l_orderkey", "assigned", "array_expr", lookups.enum_case_of(F.when(F.col("l_orderkey") % 3 == 0, "Written"), cases).alias("enum_case"), aggregates.exactly_one(cases).alias("one"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'parent.php' WHEN c_custkey % 3 = 1 THEN 'own.php' END AS written FROM customer
""")
def written_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J23, J27. Customers as methods, written in a parent's file, in their own or in none known."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lit("C").alias("class"), F.col("c_custkey").cast("string").alias("method"))
    known = c.where("c_custkey % 3 < 2").select("class", "method", F.when(F.col("c_custkey") % 3 == 0, "parent.php").otherwise("own.php").alias("written_in_file"))
    return lookups.file_for(c, known).select("c_custkey", F.col("written_in_file").alias("written"))


@query(f"""
WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS ord, l_quantity, l_partkey FROM lineitem)
SELECT l_orderkey, ord::INT AS ord, CASE WHEN l_quantity >= 45 THEN '{_VOID}' WHEN l_partkey % 2 = 0 THEN '{_INT}' ELSE '{_unknown("unresolved type")}' END AS type FROM r
""")
def harvested_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P18, D2's types. Order lines as return statements of orders; large ones return nothing, odd parts have no type."""
    w = F.row_number().over(windows.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    sites = table(spark, sf_dir, "lineitem").select(F.lit("C").alias("class"), F.col("l_orderkey").cast("string").alias("method"), F.lit("f").alias("file"), w.alias("ord"), F.lit(1).alias("pos"), F.lit(1).alias("line"), F.when(F.col("l_quantity") < 45, F.col("l_partkey")).alias("expr_id"))
    exprs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("expr_id"), F.when(F.col("p_partkey") % 2 == 0, dtype.scalar("int")).alias("type_json"))
    methods = sites.select("class", "method", "file").distinct()
    return lookups.harvest_returns(methods, sites, exprs).select(F.col("method").cast("bigint").alias("l_orderkey"), "ord", "type")


@query(f"""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '{_INT}' ELSE '{_unknown("unresolved type")}' END AS type, p_size % 3 = 0 AS folded, CASE WHEN p_size % 5 = 0 THEN 'trait.php' ELSE 'scope.php' END AS file FROM part
""")
def node_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2. Parts as nodes: type, constant (a folded null is one) and place."""
    p = table(spark, sf_dir, "part")
    exprs = p.select(F.col("p_partkey").alias("expr_id"), F.when(F.col("p_partkey") % 2 == 0, dtype.scalar("int")).alias("type_json"), F.when(F.col("p_size") % 3 == 0, F.struct(F.lit(None).cast("string").alias("v"))).alias("const"))
    places = p.select(F.col("p_partkey").alias("expr_id"), F.when(F.col("p_size") % 5 == 0, "trait.php").alias("trait_file"), F.lit("scope.php").alias("scope_file"), F.lit(1).alias("pos"), F.lit(1).alias("line"))
    return lookups.node_view(exprs, places).select(F.col("expr_id").alias("p_partkey"), "type", F.col("constant").isNotNull().alias("folded"), F.col("location.file").alias("file"))


@query("""
WITH i AS (SELECT l_orderkey, arg_max(l_suppkey, (l_linenumber, l_partkey, l_suppkey)) AS last FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT DISTINCT l.l_orderkey, i.last AS param FROM lineitem l LEFT JOIN i USING (l_orderkey)
""")
def array_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X18, X10. Orders as array literals whose lines write one key; the last accessor of the key wins."""
    li = table(spark, sf_dir, "lineitem")
    place = F.row_number().over(windows.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    items = li.select(F.col("l_orderkey").alias("expr_id"), place.alias("ord"), F.when(F.col("l_returnflag") == "A", "k").alias("key"), _accessor(F.col("l_suppkey").cast("string"), "Identity").alias("accessor"))
    returns = li.select("l_orderkey").distinct().select("l_orderkey", F.lit("s").alias("scope_key"), F.lit(None).cast("string").alias("var_name"), F.col("l_orderkey").alias("expr_id"), F.lit(True).alias("is_array"))
    none = spark.createDataFrame([], "scope_key string, var string, expr_id bigint")
    return lookups.payload_provenance(returns, none, items).select("l_orderkey", F.try_element_at("provenance", F.lit("k"))["param"].cast("bigint").alias("param"))


# ------------------------------------------------------------ order, windows, guards


@query("""
WITH r AS (SELECT user_id, event_id, event_type <> 'error' AS documentable, event_type = 'error' AND value >= 50 AS delegates FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN delegates THEN 1 ELSE 0 END, event_id) AS n FROM r WHERE documentable OR delegates)
SELECT user_id, event_id, delegates FROM k WHERE n = 1
""")
def documentable_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3. Events as returns of a user's helper; errors document nothing, large ones delegate."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").alias("ord"), (F.col("event_type") != "error").alias("documentable"), F.coalesce((F.col("event_type") == "error") & (F.col("value") >= 50), F.lit(False)).alias("delegates"))
    return windows.first_documentable(e, ["user_id"]).select("user_id", "event_id", "delegates")


@query("""
WITH f AS (SELECT user_id, event_type, min(CASE WHEN value >= 10 THEN event_id ELSE 9223372036854775807 END) AS pos, arg_min(event_id, (CASE WHEN value >= 10 THEN event_id ELSE 9223372036854775807 END, event_id)) AS ord FROM events GROUP BY 1, 2)
SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY pos, ord, event_type)::INT AS place FROM f
""")
def callee_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7, W8. Event types as callees of a user, in order of their first call; small values have no position."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.when(F.col("value") >= 10, F.col("event_id")).otherwise(-1).alias("pos"), F.col("event_id").alias("ord"))
    return windows.descend_order(e, ["user_id"], ["event_type"]).select("user_id", "event_type", "place")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'own ' || o_custkey ELSE 'site' END AS component FROM orders")
def entry_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W13. Customers as callables, every other of which names its own component, over the sites' (orders')."""
    sites = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("callable"), F.lit("site").alias("component"))
    own = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("callable"), F.concat(F.lit("own "), F.col("c_custkey").cast("string")).alias("component"))
    return windows.stamp_entry(sites, own, ["callable"]).select("o_orderkey", "component")


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS place FROM lineitem)
SELECT l_orderkey, place::INT AS arm_at, 'T' || l_suppkey AS type, CASE WHEN l_quantity >= 45 THEN 0 WHEN l_returnflag = 'A' THEN 2 ELSE 1 END::INT AS alternatives FROM s WHERE l_orderkey % 2 = 0
UNION ALL SELECT DISTINCT l_orderkey, -1::INT, 'plain', 0::INT FROM lineitem WHERE l_orderkey % 2 = 1
""")
def match_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P19, U4's arms. Even orders return a match with an arm for each line, large lines are the default."""
    li = table(spark, sf_dir, "lineitem")
    conds = F.when(F.col("l_returnflag") == "A", F.array(F.array(_strings("A")), F.array(_strings("B")))).otherwise(F.array(F.array(_strings("A"))))
    guard = guards.arm_guard(conds, F.lit(False))
    arm = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_suppkey").alias("pos"), F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("type"), (F.col("l_quantity") >= 45).alias("is_default"), guard.alias("guard"))
    arms = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(arm)).alias("arms"))
    sites = arms.select("l_orderkey", F.lit("plain").alias("type"), F.lit(0).cast("bigint").alias("pos"), F.lit(0).alias("ord"), guards.no_guard().alias("guard"), F.when(F.col("l_orderkey") % 2 == 0, F.col("arms")).alias("arms"))
    return windows.arms_of(sites).select("l_orderkey", F.col("arm_at").cast("int").alias("arm_at"), "type", F.size("guard").alias("alternatives"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderpriority || '&X' WHEN 2 THEN o_orderpriority || '|X' ELSE '' END AS guard,
  CASE o_orderkey % 3 WHEN 0 THEN 'A|B' WHEN 1 THEN o_orderpriority ELSE '' END AS of_type FROM orders
""")
def condition_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4, U3. Orders as conditions: a class test, a conjunction, a disjunction, a negation and an unknown one; and types as guards."""
    one = lambda c: F.concat(F.lit('{"op":"instanceof","class":"'), c, F.lit('"}'))
    both = lambda op: F.concat(F.lit('{"op":"%s","args":[' % op), one(F.col("o_orderpriority")), F.lit(","), one(F.lit("X")), F.lit("]}"))
    k = F.col("o_orderkey") % 5
    tree = F.when(k == 0, one(F.col("o_orderpriority"))).when(k == 1, both("and")).when(k == 2, both("or")).when(k == 3, F.lit('{"op":"not","args":[]}'))
    t = F.col("o_orderkey") % 3
    kind = F.when(t == 0, dtype.union_of(F.array(dtype.class_type("B"), dtype.class_type("A"), dtype.null_type()))).when(t == 1, dtype.class_type(F.col("o_orderpriority"))).otherwise(dtype.scalar("int"))
    show = lambda g: F.array_join(F.transform(g, lambda a: F.array_join(a, "&")), "|")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", tree.alias("tree"), guards.of_type(kind).alias("typed"))
    return rows.withColumn("g", guards.condition_guard("tree")).select("o_orderkey", show("g").alias("guard"), show("typed").alias("of_type"))


# ------------------------------------------------------------ sources


@query("""
WITH n AS (SELECT l_orderkey, l_suppkey, l_returnflag, l_quantity, l_shipdate::DATE::VARCHAR AS file FROM lineitem)
SELECT file, count(*) FILTER (l_returnflag = 'A')::BIGINT AS methods, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_suppkey END)::BIGINT AS closures,
  count(DISTINCT CASE WHEN l_returnflag = 'N' AND l_quantity >= 25 THEN l_suppkey END)::BIGINT AS arrays, count(DISTINCT CASE WHEN l_returnflag = 'N' THEN l_suppkey END)::BIGINT AS locals FROM n GROUP BY file
""")
def harvested_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9, S11, W4, A5. Ship dates as files, lines as nodes: methods, closures by line, first arrays and written locals."""
    kind = F.when(F.col("l_returnflag") == "A", "method").when(F.col("l_returnflag") == "R", "closure").otherwise("write")
    n = table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("date").cast("string").alias("file"), F.col("l_linenumber").alias("ord"), kind.alias("kind"), F.lit("C").alias("class"), F.col("l_partkey").cast("string").alias("name"), F.col("l_suppkey").alias("line"),
        F.lit("s").alias("scope_key"), F.col("l_suppkey").cast("string").alias("var"), F.col("l_partkey").alias("expr_id"), (F.col("l_quantity") >= 25).alias("is_array"), F.lit(False).alias("retires"), F.lit(False).alias("opaque"),
    )
    h = facts.harvest(n)
    out = n.select("file").distinct()
    for name, df in h.items():
        counted = df.groupBy(F.col("file").alias(f"{name}_file")).agg(F.count("*").alias(name))
        out = out.join(counted, F.col("file") == F.col(f"{name}_file"), "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint")).drop(f"{name}_file")
    return out.select("file", "methods", "closures", "arrays", "locals")


@query("""
SELECT p_partkey % 4 AS place, CASE p_partkey % 4 WHEN 1 THEN 'includes' WHEN 2 THEN 'stubFiles' WHEN 3 THEN 'services' ELSE 'parameters' END AS section, '- ''' || replace(p_name, '''', '''''') || '''' AS line
FROM (SELECT DISTINCT p_partkey % 4 AS p_partkey, p_name FROM part)
""")
def config_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S14, S15, D9. Part names as values of four configuration sections, each once, in order."""
    k = F.col("p_partkey") % 4
    section = F.when(k == 1, "includes").when(k == 2, "stubFiles").when(k == 3, "services").otherwise("parameters")
    lines = facts.config_sink(table(spark, sf_dir, "part").select(section.alias("section"), F.col("p_name").alias("value")))
    return lines.select((F.col("place") % 4).cast("bigint").alias("place"), "section", "line")


@query("""
SELECT 'facts' AS kind, count(*)::BIGINT AS files, count(DISTINCT user_id)::BIGINT AS stamp FROM (SELECT DISTINCT user_id FROM events)
""")
def file_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3, S4. Users as files: how many are known, and the stamp of what is derived from them."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file"))
    known = facts.prime(e, e)
    return spark.createDataFrame([("facts", known.count(), facts.snapshot_id(known))], "kind string, files bigint, stamp bigint")


@query("""
WITH c AS (SELECT o_orderkey, o_orderkey % 5 AS k, o_custkey % 4 AS c FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN 'built' WHEN 1 THEN 'rich' WHEN 2 THEN CASE WHEN c = 0 THEN 'local' END WHEN 3 THEN CASE WHEN c = 1 THEN 'callee' END END AS shape,
  CASE WHEN c = 3 THEN 'payload' ELSE '' END || ',status,members' AS bound FROM c
""")
def refined_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6, G9. Orders as returned expressions of five kinds; a call's bindings apply in their order."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 5
    exprs = o.select(F.col("o_orderkey").alias("expr_id"), "o_custkey", F.when(k == 0, "new").when(k == 2, "variable").when(k == 3, "call").otherwise("x").alias("kind"), F.lit("built").alias("constructed"), F.when(k == 1, "rich").alias("rich"), F.col("o_orderkey").alias("var_key"), F.col("o_orderkey").alias("call_id"))
    locals_ = o.where("o_custkey % 4 = 0").select(F.col("o_orderkey").alias("var_key"), F.lit("local").alias("shape"))
    callees = o.where("o_custkey % 4 = 1").select(F.col("o_orderkey").alias("call_id"), F.lit("callee").alias("shape"))
    shapes = graph.refine_expressions(exprs, locals_, callees)
    start = o.select(F.col("o_orderkey").alias("b_key"), (F.col("o_custkey") % 4 == 3).alias("has"), F.array().cast("array<string>").alias("steps"))
    add = lambda name, when: lambda df: df.withColumn("steps", F.array_append("steps", F.when(when, F.lit(name)).otherwise(F.lit(""))))
    bound = graph.bind_call(start, add("payload", F.col("has")), add("status", F.lit(True)), add("members", F.lit(True)))
    return shapes.join(bound, F.col("expr_id") == F.col("b_key")).select(F.col("expr_id").alias("o_orderkey"), "shape", F.array_join("steps", ",").alias("bound"))
