"""Join-like operators: resolution, matching and lookups over fact tables.

Composite keys stay separate columns. Small dimension tables are left to
Spark's size threshold to broadcast; only hot keys are broadcast by hint
(``graph.join_hot``). Every "first wins" carries an explicit order, so input
order never shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dtype, scalars
from . import graph


def first_by(df: DataFrame, keys: list[str], value: Column, order: Column, name: str) -> DataFrame:
    """The value of the row that is first in order, for each key; a null value stays one."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(value.alias("v")), order).alias(name)).withColumn(name, F.col(f"{name}.v"))


def resolve_callees(calls: DataFrame, class_methods: DataFrame) -> DataFrame:
    """call_id with the declaring class and file of its first receiver that has the method.

    A first hit without a file resolves to nothing and ends the search.
    """
    tried = calls.where(F.col("kind").isin("method", "static")).select("call_id", "callee_name", F.posexplode("receivers").alias("at", "receiver"))
    hits = tried.join(class_methods, (F.col("receiver") == F.col("class")) & (F.col("callee_name") == F.col("method")))
    best = hits.groupBy("call_id").agg(F.min_by(F.struct("declaring_class", F.col("declaring_file").alias("file"), "method"), "at").alias("c"))
    return best.where("c.file is not null").select("call_id", F.col("c.declaring_class").alias("callee_class"), F.col("c.method").alias("callee_method"), F.col("c.file").alias("callee_file"))


def resolve_shared_callees(calls: DataFrame, class_methods: DataFrame) -> DataFrame:
    """J1 where very many calls may name one callee: each name with its receivers is resolved once, then handed to its calls."""
    key = F.sha2(F.to_json(F.struct("callee_name", "receivers")), 256)
    tried = calls.where(F.col("kind").isin("method", "static")).select("call_id", "callee_name", "receivers", key.alias("asks"))
    asked = tried.groupBy("asks", "callee_name", "receivers").agg(F.count("*").alias("n_calls"))
    found = resolve_callees(asked.select(F.col("asks").alias("call_id"), F.lit("method").alias("kind"), "callee_name", "receivers"), class_methods)
    weighed = found.withColumnRenamed("call_id", "found").join(asked.select("asks", "n_calls"), F.col("found") == F.col("asks")).drop("asks")
    out = graph.join_hot(tried.select("call_id", "asks"), weighed, [("asks", "found")], "n_calls")
    return out.where("found is not null").select("call_id", "callee_class", "callee_method", "callee_file")


def callee_name(kind: Column, name: Column, literal: Column) -> Column:
    """The literal name of a function, method or static call, whatever its kind."""
    return F.when(kind.isin("function", "method", "static") & literal, name)


def reads_body(calls: DataFrame, callees: DataFrame, methods: DataFrame, roots: Column) -> DataFrame:
    """call ids whose callee is a project method with a harvested body."""
    on = (F.col("callee_class") == F.col("m_class")) & (F.col("callee_method") == F.col("m_method"))
    bodies = methods.select(F.col("class").alias("m_class"), F.col("method").alias("m_method")).distinct()
    return callees.where(scalars.is_project_file(F.col("callee_file"), roots)).join(bodies, on, "left_semi").join(calls.select(F.col("call_id").alias("c")), F.col("call_id") == F.col("c"), "left_semi").select("call_id")


def apply_registry(points: DataFrame, calls: DataFrame, registry: DataFrame, body_calls: DataFrame) -> DataFrame:
    """Throws that known callees explain, unless their body is read.

    The function table is asked first, for calls of every kind; then the method table.
    """
    named = points.join(calls.select("call_id", "callee_name", "status_args"), "call_id").join(body_calls.withColumnRenamed("call_id", "b"), F.col("call_id") == F.col("b"), "left_anti")

    def table(kind: str) -> DataFrame:
        return registry.where(F.col("kind") == kind).select(F.col("name").alias(f"{kind}_name"), F.struct("exception", "fixed_status", "status_arg").alias(f"by_{kind}"))

    hit = named.join(table("function"), F.col("callee_name") == F.col("function_name"), "left").join(table("method"), F.col("callee_name") == F.col("method_name"), "left")
    hit = hit.withColumn("known", F.coalesce("by_function", "by_method")).where("known is not null")
    status = F.coalesce("known.fixed_status", scalars.fold_status_arg(F.col("status_args"), F.coalesce("known.status_arg", F.lit(-1))))
    certain = F.col("explicit") & F.array_contains("types", F.col("known.exception"))
    return hit.select("file", "class", "method", "ord", "line", F.col("known.exception").alias("exception"), status.alias("status"), F.when(certain, "Certain").otherwise("Likely").alias("confidence"), F.lit("Signal").alias("disposition"), "callee_name")


def status_for_types(types: DataFrame, registry: DataFrame, statuses: DataFrame, closure: DataFrame) -> DataFrame:
    """Status of each exception class: the table's, else that of the first registered class it descends from, else 500."""
    exact = types.join(statuses.withColumnRenamed("exception", "e").withColumnRenamed("status", "exact"), F.col("exception") == F.col("e"), "left")
    above = closure.join(registry.where("fixed_status is not null").select("exception", "fixed_status", "ord"), F.col("super") == F.col("exception"))
    near = above.groupBy("sub").agg(F.min_by("fixed_status", "ord").alias("near"))
    return exact.join(near, F.col("exception") == F.col("sub"), "left").select("exception", F.coalesce("exact", "near", F.lit(scalars.FALLBACK_STATUS)).alias("status"))


def before_spread(args: DataFrame, key: list[str]) -> DataFrame:
    """Arguments with ``spread_before``: whether a spread stands at or before them."""
    w = Window.partitionBy(*key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return args.withColumn("spread_before", F.coalesce(F.max(F.col("unpack").cast("int")).over(w), F.lit(0)) == 1)


def argument_slots(args: DataFrame, params: DataFrame) -> DataFrame:
    """For each call and parameter the bound expression and whether that is known.

    ``args(call_id, ord, name, unpack, expr_id)``, ``params(call_id, idx, param)``.
    A named argument binds by name, a positional one by place before any spread;
    an unbound parameter is known absent only if the call has no spread. A call's
    arguments, as many as its source writes, are one ordered array, so arguments
    and parameters cross one shuffle each.
    """
    arg = F.struct("ord", "name", F.coalesce("unpack", F.lit(False)).alias("unpack"), F.struct("expr_id").alias("bound"))
    listed = args.groupBy(F.col("call_id").alias("l_call")).agg(F.array_sort(F.collect_list(arg)).alias("list"))
    spread = F.array_position(F.transform("list", lambda a: a["unpack"]), True)
    head = F.when(spread > 0, F.slice("list", F.lit(1), (spread - 1).cast("int"))).otherwise(F.col("list"))
    listed = listed.select("l_call", "list", (spread > 0).alias("spread"), F.filter(head, lambda a: a["name"].isNull()).alias("positional"))
    out = params.join(listed, F.col("call_id") == F.col("l_call"), "left")
    named = F.get(F.filter("list", lambda a: a["name"] == F.col("param")), F.lit(0))["bound"]
    bound = F.coalesce(named, F.get("positional", F.col("idx").cast("int"))["bound"])
    return out.select("call_id", "idx", "param", bound["expr_id"].alias("expr_id"), bound.isNotNull().alias("present"), (bound.isNotNull() | ~F.coalesce("spread", F.lit(False))).alias("known"))


def constructor_arguments(args: DataFrame, params: DataFrame) -> DataFrame:
    """(call_id, name, expr_id): positional arguments take the next declared name, named ones keep theirs; a spread ends the list, surplus goes."""
    live = before_spread(args, ["call_id"]).where("not spread_before")
    place = F.sum(F.when(F.col("name").isNull(), 1).otherwise(0)).over(Window.partitionBy("call_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)) - 1
    live = live.withColumn("place", F.when(F.col("name").isNull(), place))
    declared = params.select(F.col("call_id").alias("dc"), F.col("idx").alias("di"), F.col("param").alias("declared"))
    out = live.join(declared, (F.col("call_id") == F.col("dc")) & (F.col("place") == F.col("di")), "left")
    return out.select("call_id", "ord", F.coalesce("name", "declared").alias("name"), "expr_id").where("name is not null")


def bindings(params: DataFrame, slots: DataFrame) -> DataFrame:
    """Value bound to each parameter: the argument's constant, else the default's; the list stops at a variadic.

    ``slots(call_id, idx, const, present)``.
    """
    stop = F.max(F.col("variadic").cast("int")).over(Window.partitionBy("call_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    live = params.withColumn("stop", stop).where("stop = 0")
    s = slots.select(F.col("call_id").alias("sc"), F.col("idx").alias("si"), "const", "present")
    joined = live.join(s, (F.col("call_id") == F.col("sc")) & (F.col("idx") == F.col("si")), "left")
    return joined.select("call_id", "idx", "param", F.when(F.coalesce("present", F.lit(False)), F.col("const")).otherwise(F.col("default_const")).alias("value")).where("value is not null")


def parameter_for(args: DataFrame, params: DataFrame) -> DataFrame:
    """The parameter each argument goes to: by name, by place, or the variadic tail."""
    by_name = params.select(F.col("call_id").alias("c1"), F.col("param").alias("p1"), F.struct("param", "by_ref").alias("named"))
    by_place = params.select(F.col("call_id").alias("c2"), F.col("idx").alias("i2"), F.struct("param", "by_ref").alias("placed"))
    tail = params.where("variadic").groupBy(F.col("call_id").alias("c3")).agg(F.max_by(F.struct("param", "by_ref"), "idx").alias("tail"), F.max("idx").alias("tail_at"))
    place = F.row_number().over(Window.partitionBy("call_id").orderBy("ord")) - 1
    out = args.withColumn("place", place).join(by_name, (F.col("call_id") == F.col("c1")) & (F.col("name") == F.col("p1")), "left")
    out = out.join(by_place, (F.col("call_id") == F.col("c2")) & (F.col("place") == F.col("i2")), "left").join(tail, F.col("call_id") == F.col("c3"), "left")
    tail_fits = F.when(F.col("name").isNotNull() | (F.col("place") >= F.col("tail_at")), F.col("tail"))
    got = F.when(F.col("name").isNotNull(), F.coalesce("named", tail_fits)).otherwise(F.coalesce("placed", tail_fits))
    return out.withColumn("to", got).select(*args.columns, F.col("to.param").alias("param"), F.col("to.by_ref").alias("by_ref"))


def by_reference_writes(args: DataFrame, params: DataFrame) -> DataFrame:
    """Variables handed to by-reference parameters, up to the first spread; a call without parameters known writes none."""
    live = before_spread(args, ["call_id"]).where("not spread_before").drop("spread_before")
    return parameter_for(live, params).where("by_ref and var_name is not null").select("call_id", "ord", "var_name")


def match_arm(subjects: DataFrame, arms: DataFrame) -> DataFrame:
    """The body of the arm that names the subject's case, else of the default; only ``$this`` is matched."""
    a = arms.select(F.col("expr_id").alias("ae"), F.col("case").alias("ac"), "is_default", F.col("ord").alias("ao"), "body_expr_id")
    on = (F.col("expr_id") == F.col("ae")) & ((F.col("case") == F.col("ac")) | F.col("is_default"))
    hits = subjects.where("on_this").join(a, on)
    return hits.groupBy("expr_id", "case").agg(F.min_by("body_expr_id", F.struct("is_default", "ao")).alias("body_expr_id"))


def fold_enum_accessors(reads: DataFrame, cases: DataFrame, method_values: DataFrame) -> DataFrame:
    """An accessor on an enum case folds to its backing value, its name or its method's value; identity folds to nothing.

    ``reads(read_id, enum, case, kind, method)``, ``method_values(enum, method, case, value)``.
    """
    c = cases.select(F.col("enum").alias("ce"), F.col("case").alias("cc"), F.col("value").alias("backing"))
    m = method_values.select(F.col("enum").alias("me"), F.col("method").alias("mm"), F.col("case").alias("mc"), F.col("value").alias("computed"))
    out = reads.join(c, (F.col("enum") == F.col("ce")) & (F.col("case") == F.col("cc")), "left").join(m, (F.col("enum") == F.col("me")) & (F.col("method") == F.col("mm")) & (F.col("case") == F.col("mc")), "left")
    value = F.when(F.col("kind") == "Value", F.col("backing")).when((F.col("kind") == "Name") & F.col("cc").isNotNull(), F.col("case")).when(F.col("kind") == "Method", F.col("computed"))
    return out.select("read_id", value.alias("value"))


def enum_method_values(returns: DataFrame, arms: DataFrame, consts: DataFrame, cases: DataFrame, project_enums: DataFrame) -> DataFrame:
    """Value of an enum method for each case: its first return decides, a match on the case or a constant; project enums only."""
    first = returns.where("expr_id is not null").groupBy("enum", "method").agg(F.min_by("expr_id", "ord").alias("expr_id"))
    first = first.join(project_enums.withColumnRenamed("enum", "pe"), F.col("enum") == F.col("pe"), "left_semi")
    per_case = first.join(cases.select(F.col("enum").alias("ce"), "case"), F.col("enum") == F.col("ce")).drop("ce").withColumn("on_this", F.lit(True))
    body = match_arm(per_case, arms).select(F.col("expr_id").alias("be"), F.col("case").alias("bc"), "body_expr_id")
    joined = per_case.join(body, (F.col("expr_id") == F.col("be")) & (F.col("case") == F.col("bc")), "left")
    k = consts.select(F.col("expr_id").alias("ke"), F.col("const").alias("value"))
    return joined.join(k, F.coalesce("body_expr_id", "expr_id") == F.col("ke"), "left").select("enum", "method", "case", "value")


def enum_case_of(written: Column, narrowed_cases: Column) -> Column:
    """The case as written, else the only one the type allows."""
    return F.coalesce(written, F.when(F.size(narrowed_cases) == 1, narrowed_cases[0]))


def refine_locals(returns: DataFrame, single: DataFrame) -> DataFrame:
    """A returned variable stands for its single assignment's expression, unless that is a variable again."""
    s = single.where("expr_id is not null and not from_variable").select(F.col("scope_key").alias("sk"), F.col("var").alias("sv"), F.col("expr_id").alias("assigned"))
    return returns.join(s, (F.col("scope_key") == F.col("sk")) & (F.col("var_name") == F.col("sv")), "left").drop("sk", "sv")


def body_array(returns: DataFrame, first_arrays: DataFrame) -> DataFrame:
    """The array literal itself, or the variable's first array initialiser."""
    a = first_arrays.select(F.col("scope_key").alias("ak"), F.col("var").alias("av"), F.col("expr_id").alias("initial"))
    out = returns.join(a, (F.col("scope_key") == F.col("ak")) & (F.col("var_name") == F.col("av")), "left")
    return out.withColumn("array_expr", F.coalesce(F.when(F.col("is_array"), F.col("expr_id")), F.col("initial"))).drop("ak", "av", "initial")


def bind_statuses(shapes: DataFrame, slots: DataFrame) -> DataFrame:
    """Across a call edge a status source is bound by an integer argument, re-homed to the caller's parameter, or cleared.

    ``shapes(call_id, status, status_source)``, ``slots(call_id, param, const, caller_param)``.
    """
    s = slots.select(F.col("call_id").alias("sc"), F.col("param").alias("sp"), "const", "caller_param")
    out = shapes.join(s, (F.col("call_id") == F.col("sc")) & (F.col("status_source.param") == F.col("sp")), "left")
    bound = F.col("const").try_cast("int")
    moved = F.when(F.col("caller_param").isNotNull(), F.col("status_source").withField("param", F.col("caller_param")))
    had = F.col("status_source").isNotNull()
    return out.select("call_id", F.when(had, bound).otherwise(F.col("status")).alias("status"), F.when(had & bound.isNull(), moved).alias("status_source"))


def bind_payload_members(members: DataFrame, slots: DataFrame) -> DataFrame:
    """What a call site does to each member read from a parameter.

    ``members(call_id, member, param, kind, is_object)``, ``slots(call_id, param,
    const, caller_param, present, known)``. The action is ``literal``, ``rehome``,
    ``remove`` (object payload and provably no argument) or ``drop`` (provenance only).
    """
    s = slots.select(F.col("call_id").alias("sc"), F.col("param").alias("sp"), "const", "caller_param", "present", "known")
    out = members.join(s, (F.col("call_id") == F.col("sc")) & (F.col("param") == F.col("sp")), "left")
    absent = F.coalesce(~F.col("present") & F.col("known"), F.lit(False))
    action = F.when(F.col("const").isNotNull(), "literal").when(F.col("caller_param").isNotNull(), "rehome").when(absent & F.col("is_object"), "remove").otherwise("drop")
    return out.select("call_id", "member", action.alias("action"), F.when(action == "literal", F.col("const")).alias("literal"), F.when(action == "rehome", F.struct(F.col("caller_param").alias("param"), "kind")).alias("rehomed"))


def attribute_on(attributes: DataFrame, name: str) -> DataFrame:
    """The first attribute of that name on each method whose argument is a string."""
    named = attributes.where((F.col("name") == name) & F.col("arg0").isNotNull())
    return named.groupBy("class", "method").agg(F.min_by(F.struct("arg0", "file", "line"), "ord").alias("a")).select("class", "method", F.col("a.arg0").alias("component"), F.col("a.file").alias("file"), F.col("a.line").alias("line"))


def declaring_symbol(methods: DataFrame, trait_methods: DataFrame) -> DataFrame:
    """The trait that really writes a method (same file and start line), the innermost of nested ones; else the class."""
    t = trait_methods.select(F.col("class").alias("tc"), F.col("method").alias("tm"), F.col("file").alias("tf"), F.col("start_line").alias("tl"), "trait", "depth")
    on = (F.col("class") == F.col("tc")) & (F.col("method") == F.col("tm")) & (F.col("file") == F.col("tf")) & (F.col("start_line") == F.col("tl"))
    got = methods.join(t, on, "left").groupBy("class", "method").agg(F.max_by("trait", F.struct("depth", F.col("trait"))).alias("trait"))
    return got.select("class", "method", F.coalesce("trait", "class").alias("symbol"))


def file_for(requests: DataFrame, class_methods: DataFrame) -> DataFrame:
    """The file a method is written in, null where that is unknown."""
    m = class_methods.select(F.col("class").alias("mc"), F.col("method").alias("mm"), "written_in_file")
    return requests.join(m, (F.col("class") == F.col("mc")) & (F.col("method") == F.col("mm")), "left").drop("mc", "mm")


def parameter_names(params: DataFrame) -> DataFrame:
    """Names in order for each method."""
    return params.groupBy("class", "method").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "name"))), lambda p: p["name"]).alias("names"))


def return_rows(methods: DataFrame, return_sites: DataFrame) -> DataFrame:
    """A row for each return statement of the methods, with its expression and place."""
    sites = return_sites.select(F.col("class").alias("rc"), F.col("method").alias("rm"), F.col("file").alias("rf"), "ord", "pos", "line", "expr_id")
    on = F.col("class").eqNullSafe(F.col("rc")) & (F.col("method") == F.col("rm")) & (F.col("file") == F.col("rf"))
    return methods.join(sites, on).select("class", "method", "file", "ord", "pos", "line", "expr_id")


def harvest_returns(methods: DataFrame, return_sites: DataFrame, exprs: DataFrame) -> DataFrame:
    """A row for each return statement of the methods, in order, with its type and place; a bare return is void."""
    types = exprs.select(F.col("expr_id").alias("ee"), "type_json")
    typed = return_rows(methods, return_sites).join(types, F.col("expr_id") == F.col("ee"), "left")
    kind = F.when(F.col("expr_id").isNull(), dtype.void_type()).otherwise(F.coalesce("type_json", dtype.unknown("unresolved type")))
    return typed.select("class", "method", "file", "ord", "pos", "line", kind.alias("type"))


def node_view(exprs: DataFrame, places: DataFrame) -> DataFrame:
    """What a visitor may see of a node: its type, its constant (a folded null stays apart from none) and its place."""
    p = places.select(F.col("expr_id").alias("pe"), scalars.written_location(F.col("trait_file"), F.col("scope_file"), F.col("pos"), F.col("line")).alias("location"))
    return exprs.join(p, F.col("expr_id") == F.col("pe"), "left").select("expr_id", F.coalesce("type_json", dtype.unknown("unresolved type")).alias("type"), F.col("const").alias("constant"), "location")


def payload_provenance(returns: DataFrame, first_arrays: DataFrame, items: DataFrame) -> DataFrame:
    """Where the members of each returned array come from: the array of J17, its items by X10.

    ``items(expr_id, ord, key, accessor)``.
    """
    listed = items.groupBy(F.col("expr_id").alias("ie")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "key", "accessor"))), lambda i: F.struct(i["key"], i["accessor"])).alias("items"))
    arrays = body_array(returns, first_arrays)
    return arrays.join(listed, F.col("array_expr") == F.col("ie")).withColumn("provenance", scalars.provenance_from_array(F.col("items"))).drop("ie", "items")


def labelled_content_type(explicit: Column, labelled: Column) -> Column:
    """A label counts only where the response names no type itself."""
    return F.coalesce(explicit, labelled)


def rehome_accessor(accessor: Column, caller_param: Column) -> Column:
    """The same accessor on the caller's parameter; null if the argument is none."""
    return F.when(caller_param.isNotNull(), accessor.withField("param", caller_param))


def total(result: Column, error: Column) -> Column:
    """A failed analysis is an unknown type that says so, never an exception."""
    return F.when(error.isNotNull(), dtype.unknown(F.concat(F.lit("analysis failed: "), error))).otherwise(result)


def failures(rows: DataFrame, keys: list[str], code: str) -> DataFrame:
    """A warning for each failed analysis, with code ``inference.action-failed`` or ``inference.callable-failed``."""
    return rows.where("error is not null").select(*keys, F.lit("Warning").alias("severity"), F.lit(code).alias("code"), F.col("error").alias("message"))
