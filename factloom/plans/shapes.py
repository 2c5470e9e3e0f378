"""Response shapes: what a bare response type erased, recovered through project callees.

Descent goes down by levels and up again. Down: every expression that returns a
bare response is classified once (built here, rich already, a local's only
assignment, a project call, nothing, a delegation); calls join the returns of
their callees, at most ``trace_depth`` levels, never into a callee that is on the
path already. A descended expression is an *instance*, keyed by its entry and the
ordinals of the returns that lead to it, which sort depth first. Up: the
instances of a callee give one shape, that of its first documentable return, and
the call site binds status, payload and members to its own arguments.

What is found below an entry's own returns depends on the entry only by the
places of its returns and the callees there: entries with the same list are one
*form*, and instances below the first level belong to forms. A callee that a
million entries answer with is so descended once, not a million times.

What a shape needs of arguments is brought to each call as one map by parameter,
so a level costs one join and one aggregation, whatever the number of members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dtype, scalars
from ..operators import graph, lookups, windows

#: Fixed value: the class under which a recovered shape is given out.
CANONICAL = "Illuminate\\Http\\JsonResponse"
#: Fixed value: the attribute that names the component of a response.
COMPONENT = "ErrorComponent"

PROVENANCE = f"map<string,{scalars.ACCESSOR}>"
RECORD = f"struct<payload: string, status: int, status_source: {scalars.ACCESSOR}, content_type: string, provenance: {PROVENANCE}, members: array<{scalars.FIELD}>, delegates: boolean, component: string>"
SLOT = "struct<present: boolean, known: boolean, literal: string, sensitive: boolean, caller_param: string, folds: map<string,string>, renders: boolean>"


def _fields_of(payload: Column) -> Column:
    """Fields of a shape; null for other types."""
    return F.when(dtype.kind_of(payload) == "shape", F.from_json(F.get_json_object(payload, "$.fields"), f"array<{scalars.FIELD}>"))


def _record(**known: Column) -> Column:
    empty = {"payload": "string", "status": "int", "status_source": scalars.ACCESSOR, "content_type": "string", "provenance": PROVENANCE, "members": f"array<{scalars.FIELD}>", "delegates": "boolean", "component": "string"}
    return F.struct(*[known.get(k, F.lit(None)).cast(t).alias(k) for k, t in empty.items()])


def _folded(accessor: Column, slot: Column) -> Column:
    """X11: what an accessor reads from an argument, as JSON; null if it does not fold."""
    key = F.when(accessor["kind"] == "Method", F.concat(F.lit("Method:"), accessor["method"])).otherwise(accessor["kind"])
    folds = lambda kind: F.when(accessor["kind"] == kind, F.try_element_at(slot["folds"], key))
    return scalars.fold_accessor_argument(accessor["kind"], slot["literal"], slot["sensitive"], folds("Value"), folds("Name"), folds("Method"))


def bind_status(record: Column, slots: Column) -> Column:
    """J18 over columns: a literal binds the status, a parameter of the caller's takes its place, anything else ends the source."""
    source = record["status_source"]
    slot = F.try_element_at(slots, source["param"])
    there = F.coalesce(slot["present"], F.lit(False))
    bound = F.when(there, _folded(source, slot).try_cast("int"))
    moved = F.when(there & bound.isNull(), lookups.rehome_accessor(source, slot["caller_param"]))
    done = F.when(bound.isNotNull(), scalars.with_bound_status(record, bound)).otherwise(scalars.with_status_source(record, moved.cast(scalars.ACCESSOR)))
    return F.when(source.isNull(), record).otherwise(done)


def bind_payload(record: Column, slots: Column) -> Column:
    """J19, U8, U9 over columns: each member that reads a parameter is bound to the call's argument."""
    objects = record["members"].isNotNull()
    fields = F.coalesce(record["members"], _fields_of(record["payload"]))
    accessor = lambda f: F.try_element_at(record["provenance"], f["key"])
    slot = lambda a: F.try_element_at(slots, a["param"])
    there = lambda a: F.coalesce(slot(a)["present"], F.lit(False))
    literal = lambda a: F.when(there(a), _folded(a, slot(a)))
    renders = lambda a: F.coalesce(there(a) & slot(a)["renders"] & (a["kind"] == "Identity"), F.lit(False))
    gone = lambda a: F.coalesce(~there(a) & slot(a)["known"], F.lit(False))
    bound = lambda f: F.struct(f["key"].alias("key"), F.when(literal(accessor(f)).isNotNull(), dtype.literal(literal(accessor(f)))).otherwise(f["type"]).alias("type"), (f["optional"] & ~(objects & renders(accessor(f)))).alias("optional"))
    now = F.transform(F.when(objects, F.filter(fields, lambda f: ~gone(accessor(f)))).otherwise(fields), lambda f: F.when(accessor(f).isNotNull(), bound(f)).otherwise(f))
    moved = lambda a: F.when(there(a) & literal(a).isNull(), lookups.rehome_accessor(a, slot(a)["caller_param"]))
    kept = F.map_from_entries(F.filter(F.transform(F.map_entries(record["provenance"]), lambda e: F.struct(e["key"].alias("key"), moved(e["value"]).alias("value"))), lambda e: e["value"].isNotNull()))
    payload = F.when(objects, record["payload"]).otherwise(dtype.shape(now, F.coalesce(F.get_json_object(record["payload"], "$.is_list") == "true", F.lit(False))))
    done = record.withField("payload", payload).withField("members", F.when(objects, now)).withField("provenance", kept.cast(PROVENANCE))
    return F.when((F.size(F.coalesce(record["provenance"], F.create_map().cast(PROVENANCE))) > 0) & fields.isNotNull(), done).otherwise(record)


class ShapeFacts:
    """The tables that do not depend on the entry: classified expressions, arguments by call, constructed shapes, callees."""

    def __init__(self, f: dict[str, DataFrame], roots: Column):
        self.f, self.roots = f, roots
        self.params = f["params"].select(F.col("class").alias("p_class"), F.col("method").alias("p_method"), "idx", F.col("name").alias("param"), "variadic", "by_ref", "default_const")
        # Each is read by every level, so each is made once.
        self.exprs = graph.checkpoint(self._exprs())
        self.arguments = graph.checkpoint(self._arguments())
        self.targets = graph.checkpoint(self._targets())
        self.resolved = graph.checkpoint(lookups.resolve_shared_callees(f["calls"].where("not is_first_class"), f["class_methods"]))
        self.slots = graph.checkpoint(self._slots())
        self.callees = self.resolved.where(scalars.is_project_file(F.col("callee_file"), roots))
        self.members = graph.checkpoint(self._members())
        self.constructed = graph.checkpoint(self._constructed())
        self.discovered = graph.checkpoint(self._discovered())
        self.labels = graph.checkpoint(self._labels())

    def _exprs(self) -> DataFrame:
        """Expressions with the accessor they are on their function's parameters, and how many arguments they have."""
        names = self.params.groupBy(F.col("p_class").alias("n_class"), F.col("p_method").alias("n_method")).agg(F.collect_set("param").alias("names"))
        n_args = self.f["args"].groupBy(F.col("call_id").alias("n_call")).agg(F.count("*").alias("n_args"))
        e = self.f["exprs"].join(names, F.col("scope_class").eqNullSafe(F.col("n_class")) & (F.col("scope_fn") == F.col("n_method")), "left").join(n_args, F.col("expr_id") == F.col("n_call"), "left")
        own = F.when(F.array_contains("names", F.col("var_name")), F.col("var_name"))
        e = e.withColumn("accessor", scalars.accessor(F.col("kind"), own, F.col("member"), F.coalesce("n_args", F.lit(0))))
        fqcn = F.get_json_object("type_json", "$.fqcn")
        e = e.withColumn("fqcn", fqcn).withColumn("is_response", scalars.is_response_class(F.when(dtype.kind_of(F.col("type_json")) == "class", fqcn)))
        return e.withColumn("rich", F.col("is_response") & (F.get_json_object("type_json", "$.args") != "[]")).drop("n_class", "n_method", "n_call", "names")

    def _targets(self) -> DataFrame:
        """(expr_id, target, case): the expression that a returned one stands for (J16) and how its shape is found."""
        writes = self.f["local_writes"]
        single = writes.groupBy("scope_key", "var").agg(F.when((F.count("*") == 1) & ~F.bool_or("retires") & ~F.bool_or("opaque"), F.min("expr_id")).alias("expr_id"))
        kinds = self.f["exprs"].select(F.col("expr_id").alias("k_id"), (F.col("kind") == "variable").alias("from_variable"))
        single = single.join(kinds, F.col("expr_id") == F.col("k_id")).drop("k_id")
        returned = self.exprs.select("expr_id", "kind", "is_response", "rich", F.when((F.col("kind") == "variable") & F.col("is_response") & ~F.col("rich"), F.col("var_name")).alias("var_name"), scalars.scope_key(F.col("scope_class"), F.col("scope_fn")).alias("scope_key"))
        local = lookups.refine_locals(returned, single)
        local = local.select("expr_id", F.when(F.col("var_name").isNotNull(), F.col("assigned")).otherwise(F.col("expr_id")).alias("target"))
        t = self.exprs.select(F.col("expr_id").alias("t_id"), "kind", "is_response", "rich", dtype.kind_of(F.col("type_json")).alias("type_kind"))
        out = local.join(t, F.col("target") == F.col("t_id"))
        case = F.when((F.col("kind") == "new") & F.col("is_response"), "new").when(F.col("rich"), "rich").when((F.col("kind") == "call") & F.col("is_response"), "call").when(F.col("type_kind").isin("null", "void"), "delegation")
        return out.select("expr_id", "target", case.alias("case"))

    def _arguments(self) -> DataFrame:
        """What the shapes need of each argument expression."""
        operands = self.f["expr_edges"].where("role = 'operand'").join(self.f["exprs"].select(F.col("expr_id").alias("o_id"), F.col("member").alias("o_member"), F.col("kind").alias("o_kind")), F.col("child") == F.col("o_id")).where("o_kind = 'const'")
        named = operands.groupBy(F.col("parent").alias("o_parent")).agg(F.collect_list("o_member").alias("operands"))
        e = self.exprs.join(named, F.col("expr_id") == F.col("o_parent"), "left")
        names = F.concat(F.when(F.col("kind") == "const", F.array("member")).otherwise(F.array().cast("array<string>")), F.coalesce("operands", F.array().cast("array<string>")))
        closure = self.f["class_closure"].groupBy(F.col("sub").alias("s_sub")).agg(F.collect_set("super").alias("supers"))
        e = e.join(closure, F.col("fqcn") == F.col("s_sub"), "left")
        arms = F.array(F.array_append(F.coalesce("supers", F.array().cast("array<string>")), F.coalesce("fqcn", F.lit(""))))
        omissible = scalars.may_be_omitted(arms)
        # The case as written, else the only one its type allows.
        cases = F.from_json(F.get_json_object("type_json", "$.cases"), "array<string>")
        only = lookups.enum_case_of(F.when((F.col("kind") == "const") & (F.lower("member") != "class") & F.col("prop").isNotNull(), F.col("member")), F.when(dtype.kind_of(F.col("type_json")) == "enum", cases))
        enum = F.when(F.col("kind") == "const", F.col("prop")).otherwise(F.col("fqcn"))
        out = e.select("expr_id", F.col("const.v").alias("literal"), scalars.sensitive_label(names).isNotNull().alias("sensitive"), F.col("accessor"), omissible.alias("omissible"), scalars.renders_value(F.lit("Identity"), F.col("is_null"), omissible).alias("renders"), enum.alias("enum"), only.alias("case"))
        return out.join(self._folds(), F.col("enum").eqNullSafe(F.col("f_enum")) & (F.col("case") == F.col("f_case")), "left").drop("f_enum", "f_case", "enum", "case")

    def _folds(self) -> DataFrame:
        """What the accessors of each enum case fold to, by accessor."""
        cases = self.f["enum_cases"]
        own = cases.select("enum", "case", F.explode(F.array(F.struct(F.lit("Value").alias("k"), F.col("value").alias("v")), F.struct(F.lit("Name").alias("k"), dtype.json_text(F.col("case")).alias("v")))).alias("x")).select("enum", "case", "x.k", "x.v")
        returns = self.f["return_sites"].select(F.col("class").alias("enum"), "method", "ord", "expr_id")
        arms = self.f["match_arms"].select("expr_id", "ord", F.explode_outer(F.flatten("cond_dnf")).alias("case"), "is_default", "body_expr_id")
        consts = self.f["exprs"].where("const is not null").select("expr_id", F.col("const.v").alias("const"))
        project = self.f["classes"].where(F.col("is_enum") & scalars.is_project_file(F.col("file"), self.roots)).select(F.col("class").alias("enum"))
        computed = lookups.enum_method_values(returns, arms, consts, cases.select("enum", "case"), project)
        every = own.unionByName(computed.select("enum", "case", F.concat(F.lit("Method:"), F.col("method")).alias("k"), F.col("value").alias("v"))).where("v is not null")
        return every.groupBy(F.col("enum").alias("f_enum"), F.col("case").alias("f_case")).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("folds"))

    def _slots(self) -> DataFrame:
        """(slot_call, slots): arguments by parameter of the resolved callee, for each call."""
        listed = self.params.groupBy("p_class", "p_method").agg(F.collect_list(F.struct("idx", "param")).alias("params"))
        calls = self.resolved.groupBy(F.col("callee_class").alias("n_class"), F.col("callee_method").alias("n_method")).agg(F.count("*").alias("n_calls"))
        listed = listed.join(calls, (F.col("p_class") == F.col("n_class")) & (F.col("p_method") == F.col("n_method"))).drop("n_class", "n_method")
        params = graph.join_hot(self.resolved, listed, [("callee_class", "p_class"), ("callee_method", "p_method")], "n_calls").select("call_id", F.explode("params").alias("p")).select("call_id", "p.idx", "p.param")
        bound = lookups.argument_slots(self.f["args"], params)
        of = self.arguments.withColumnRenamed("expr_id", "a_id")
        rows = bound.join(of, F.col("expr_id") == F.col("a_id"), "left")
        caller = F.when(F.col("accessor.kind") == "Identity", F.col("accessor.param"))
        slot = F.struct("present", "known", "literal", F.coalesce("sensitive", F.lit(False)).alias("sensitive"), caller.alias("caller_param"), "folds", F.coalesce("renders", F.lit(False)).alias("renders"))
        return rows.groupBy(F.col("call_id").alias("slot_call")).agg(F.map_from_entries(F.collect_list(F.struct("param", slot.cast(SLOT).alias("slot")))).alias("slots"))

    def _items(self) -> DataFrame:
        """(array_id, items): literal keys and their accessors of each array literal (X10), and the content type a header array names."""
        v = self.exprs.select(F.col("expr_id").alias("v_id"), "accessor", F.col("const.v").alias("v"))
        rows = self.f["array_items"].join(v, F.col("value_expr") == F.col("v_id"), "left")
        text = F.when(F.col("v").startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), F.col("v"), F.lit("}")), "$.v"))
        listed = F.array_sort(F.collect_list(F.struct("ord", "key", "accessor", text.alias("value"))))
        got = rows.groupBy(F.col("expr_id").alias("array_id")).agg(listed.alias("items"))
        return got.select("array_id", scalars.provenance_from_array(F.transform("items", lambda i: F.struct(i["key"].alias("key"), i["accessor"].alias("accessor")))).cast(PROVENANCE).alias("provenance"), scalars.content_type_of(F.transform("items", lambda i: F.struct(i["key"].alias("key"), i["value"].alias("value")))).alias("content_type"))

    def _constructed(self) -> DataFrame:
        """(new_id, shape): X7, a response built here: payload, status and content type of its first three arguments."""
        new = self.exprs.where((F.col("kind") == "new") & F.col("is_response")).select("expr_id", "fqcn")
        names = self.params.where("p_method = '__construct'").select("p_class", F.col("idx").alias("p_idx"), "param")
        places = new.select("expr_id", "fqcn", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("idx")).join(names, (F.col("fqcn") == F.col("p_class")) & (F.col("idx") == F.col("p_idx")), "left")
        params = places.select(F.col("expr_id").alias("call_id"), "idx", F.coalesce("param", F.concat(F.lit("#"), F.col("idx").cast("string"))).alias("param"))
        slots = lookups.argument_slots(self.f["args"], params)
        arrays = self.f["exprs"].where("kind = 'array'").select(F.col("expr_id").alias("x_id"))
        writes = self.f["local_writes"].join(arrays, F.col("expr_id") == F.col("x_id"))
        first = windows.first_initialisers(writes, ["scope_key", "var"], F.col("ord"))
        v = self.exprs.select(F.col("expr_id").alias("v_id"), "type_json", F.col("const.v").alias("v"), "accessor", "var_name", (F.col("kind") == "array").alias("is_array"), scalars.scope_key(F.col("scope_class"), F.col("scope_fn")).alias("scope_key"))
        rows = lookups.body_array(slots.join(v, F.col("expr_id") == F.col("v_id"), "left"), first).join(self._items(), F.col("array_expr") == F.col("array_id"), "left")
        at = lambda k, c: F.max_by(F.when(F.col("idx") == k, F.col(c)), F.when(F.col("idx") == k, 1))
        wide = rows.groupBy(F.col("call_id").alias("new_id")).agg(
            at(0, "type_json").alias("body"), at(0, "provenance").alias("provenance"), at(1, "present").alias("has_status"), at(1, "known").alias("status_known"), at(1, "v").alias("status_literal"), at(1, "accessor").alias("status_accessor"), at(2, "content_type").alias("content_type")
        )
        literal = F.col("status_literal").try_cast("int")
        resolved = scalars.resolve_status(literal, F.col("status_accessor"))
        status = scalars.default_if_absent(F.col("status_known"), resolved["status"], F.col("has_status"), 200)
        source = F.when(F.col("has_status"), resolved["status_source"])
        payload = dtype.documentable_payload(F.col("body"))
        marked = F.when(_fields_of(payload).isNotNull() & source.isNotNull(), dtype.shape(scalars.mark_status_members(_fields_of(payload), F.col("provenance"), source))).otherwise(payload)
        return wide.select("new_id", _record(payload=marked, status=status, status_source=source, content_type=F.col("content_type"), provenance=F.coalesce("provenance", F.create_map().cast(PROVENANCE)), delegates=F.lit(False)).alias("shape"))

    def _members(self) -> DataFrame:
        """(m_id, m_class, fields, m_provenance): G8, the members of an object by its constructor's arguments, for each ``new``."""
        new = self.exprs.where("kind = 'new' and not is_response").select("expr_id", "fqcn")
        params = new.join(self.params.where("p_method = '__construct'"), F.col("fqcn") == F.col("p_class")).select(F.col("expr_id").alias("call_id"), "idx", "param")
        named = lookups.constructor_arguments(self.f["args"].join(new.select(F.col("expr_id").alias("w_id")), F.col("call_id") == F.col("w_id"), "left_semi"), params)
        of = self.arguments.withColumnRenamed("expr_id", "a_id")
        rows = named.join(of, F.col("expr_id") == F.col("a_id"), "left").withColumn("sensitive", F.when(F.col("sensitive"), F.lit("yes")))
        open_ = F.col("literal").isNull() & F.col("sensitive").isNull()
        rows = rows.withColumn("omissible", open_ & F.coalesce("omissible", F.lit(False)))
        fields = graph.constructed_members(rows)
        read = rows.where(open_ & F.col("accessor").isNotNull()).groupBy(F.col("call_id").alias("r_id")).agg(F.map_from_entries(F.collect_list(F.struct("name", "accessor"))).alias("m_provenance"))
        out = fields.join(read, F.col("call_id") == F.col("r_id"), "left").join(new, F.col("call_id") == F.col("expr_id"))
        return out.select(F.col("call_id").alias("m_id"), F.col("fqcn").alias("m_class"), F.col("fields").cast(f"array<{scalars.FIELD}>").alias("fields"), F.coalesce(F.col("m_provenance").cast(PROVENANCE), F.create_map().cast(PROVENANCE)).alias("m_provenance"))

    def _discovered(self) -> DataFrame:
        """(d_call, d_class, d_fields, d_provenance, d_file, d_slots): members known from a call's receiver, built there or by a factory one hop away."""
        receivers = self.f["expr_edges"].where("role = 'receiver'").select(F.col("parent").alias("d_call"), F.col("child").alias("receiver"))
        here = receivers.join(self.members, F.col("receiver") == F.col("m_id")).select("d_call", F.col("m_class").alias("d_class"), F.col("fields").alias("d_fields"), F.col("m_provenance").alias("d_provenance"), F.lit(None).cast("string").alias("d_file"), F.lit(None).cast(f"map<string,{SLOT}>").alias("d_slots"))
        made = self.f["return_sites"].select(F.col("class").alias("r_class"), F.col("method").alias("r_method"), F.col("ord").alias("r_ord"), F.col("expr_id").alias("r_expr")).join(self.members, F.col("r_expr") == F.col("m_id"))
        via = receivers.join(self.callees, F.col("receiver") == F.col("call_id")).join(made, (F.col("callee_class") == F.col("r_class")) & (F.col("callee_method") == F.col("r_method")))
        first = via.groupBy("d_call", F.col("m_class").alias("d_class")).agg(F.min_by(F.struct("receiver", "fields", "m_provenance", "callee_file"), "r_ord").alias("x"))
        far = first.join(self.slots, F.col("x.receiver") == F.col("slot_call"), "left").select("d_call", "d_class", F.col("x.fields").alias("d_fields"), F.col("x.m_provenance").alias("d_provenance"), F.col("x.callee_file").alias("d_file"), F.coalesce("slots", F.create_map().cast(f"map<string,{SLOT}>")).alias("d_slots"))
        return here.unionByName(far)

    def _labels(self) -> DataFrame:
        """(l_class, l_method, l_ord, label): W5, W6 for each return of a variable."""
        r = self.f["return_sites"].join(self.f["exprs"].select(F.col("expr_id").alias("e_id"), F.col("var_name").alias("var"), "kind"), F.col("expr_id") == F.col("e_id")).where("kind = 'variable'")
        key = scalars.scope_key(F.col("class"), F.col("method"))
        ids = F.struct("class", "method", "ord")
        h = self.f["header_writes"].select(key.alias("scope_key"), "var", "pos", "header", "value")
        got = windows.content_types(r.select(ids.alias("return_id"), key.alias("scope_key"), "var", "pos"), self.f["local_writes"].select("scope_key", "var", "pos"), h)
        return got.where("content_type is not null").select(F.col("return_id.class").alias("l_class"), F.col("return_id.method").alias("l_method"), F.col("return_id.ord").alias("l_ord"), F.col("content_type").alias("label"))


def refine_sites(shared: ShapeFacts, sites: DataFrame, depth: int = 4, budget: int = 40) -> DataFrame:
    """The shape of each site(entry, ord, expr_id).

    Returns entry, ord, shape (null where nothing better than the type is known),
    truncations and the files that were read.
    """
    keyed = sites.select("entry", F.array("ord").alias("order"), "expr_id", F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("ret_class"), F.lit(None).cast("string").alias("ret_method"))
    returns = shared.f["return_sites"].select(F.col("class").alias("r_class"), F.col("method").alias("r_method"), F.col("ord").alias("r_ord"), F.col("expr_id").alias("r_expr"))
    written = shared.f["class_methods"].groupBy(F.col("class").alias("w_class"), F.col("method").alias("w_method")).agg(F.max("written_in_file").alias("written"))
    named = lookups.attribute_on(shared.f["attributes"], COMPONENT).select(F.col("class").alias("n_class"), F.col("method").alias("n_method"), F.col("component").alias("own"))
    about = shared.callees.select("callee_class", "callee_method").distinct()
    about = about.join(written, (F.col("callee_class") == F.col("w_class")) & (F.col("callee_method") == F.col("w_method")), "left").join(named, (F.col("callee_class") == F.col("n_class")) & (F.col("callee_method") == F.col("n_method")), "left")
    about = graph.checkpoint(about.select(F.col("callee_class").alias("o_class"), F.col("callee_method").alias("o_method"), "written", "own"))
    top = _classified(shared, keyed)
    of, forms = _forms(top)
    down, levels, visits = forms, [], []
    for _ in range(depth):
        visits.append(down.select("entry", "order", F.col("callee_file").alias("file")))
        keyed = down.join(returns, (F.col("callee_class") == F.col("r_class")) & (F.col("callee_method") == F.col("r_method"))).select("entry", F.array_append("order", F.col("r_ord")).alias("order"), F.col("r_expr").alias("expr_id"), F.array_append("path", F.col("callee")).alias("path"), F.col("r_class").alias("ret_class"), F.col("r_method").alias("ret_method"))
        levels.append(_classified(shared, keyed))
        down = levels[-1].where("callee is not null and not cycle")
    seen = visits[0]
    for v in visits[1:]:
        seen = seen.unionByName(v)
    admitted = graph.checkpoint(graph.admit_files(seen, ["entry"], "file", ["order"], budget).select(F.col("entry").alias("a_entry"), F.col("file").alias("a_file"), "admitted"))
    below = None
    for e in reversed(levels):
        below = graph.checkpoint(_level(shared, e if below is None else _descended(shared, e, below, admitted, about), below is None))
    # Of the entries' own returns a callee may be that of nearly all; what a form tells of it is one row.
    under = _descended(shared, forms, below, admitted, about).select(F.col("entry").alias("u_form"), F.col("order").alias("u_order"), F.col("callee").alias("u_callee"), "n_sites", *_FOUND)
    under = under.dropDuplicates(["u_form", "u_order", "u_callee"])
    formed = graph.checkpoint(top.join(of, F.col("entry") == F.col("f_entry"), "left").drop("f_entry").withColumn("form", F.when(F.col("callee").isNotNull(), F.col("form"))))
    rows = graph.join_hot(formed, under, [("form", "u_form"), ("order", "u_order"), ("callee", "u_callee")], "n_sites")
    out = graph.checkpoint(_level(shared, rows, False))
    return out.select("entry", F.col("order")[0].alias("ord"), "shape", "truncations", "files")


def _classified(shared: ShapeFacts, keyed: DataFrame) -> DataFrame:
    """One level's instances(entry, order, expr_id, path, ...) with the case of each, its target and the callee it goes to."""
    t = shared.targets.withColumnRenamed("expr_id", "t_expr")
    callees = shared.callees.select(F.col("call_id").alias("c_call"), "callee_class", "callee_method", "callee_file", F.concat_ws("::", "callee_class", "callee_method").alias("callee"))
    e = keyed.join(t, F.col("expr_id") == F.col("t_expr"), "left").withColumn("case", F.when(F.col("expr_id").isNull(), "delegation").otherwise(F.col("case"))).drop("t_expr")
    return graph.checkpoint(e.join(callees, (F.col("case") == "call") & (F.col("target") == F.col("c_call")), "left").drop("c_call").withColumn("cycle", F.coalesce(F.array_contains("path", F.col("callee")), F.lit(False))))


#: What a form's levels below need of each call.
_PLACE = "order: array<int>, callee_class: string, callee_method: string, callee_file: string, callee: string"


def _forms(top: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(f_entry, form) of each entry that calls, and one row (entry, order, callee, ..., n_sites) for each call of each form.

    A form stands in for its entries in the levels below, so it has their column's name; ``n_sites`` counts the entries' rows.
    """
    place = F.struct(*[x.split(":")[0] for x in _PLACE.split(", ")])
    calls = top.where("callee is not null").groupBy(F.col("entry").alias("f_entry")).agg(F.to_json(F.array_sort(F.collect_list(place))).alias("calls"))
    of = graph.checkpoint(calls.withColumn("form", F.sha2("calls", 256)))
    each = of.groupBy("form", "calls").agg(F.count("*").alias("n_sites")).select(F.col("form").alias("entry"), "n_sites", F.explode(F.from_json("calls", f"array<struct<{_PLACE}>>")).alias("c"))
    return of.select("f_entry", "form"), graph.checkpoint(each.select("entry", "n_sites", "c.*", F.array().cast("array<string>").alias("path"), F.lit(False).alias("cycle")))


#: What a level has from the one below it.
_FOUND = ("written", "own", "admitted", "below", "b_truncations", "b_files")


def _descended(shared: ShapeFacts, e: DataFrame, below: DataFrame, admitted: DataFrame, about: DataFrame) -> DataFrame:
    """One level's instances with what the level below tells of those whose callee's file is admitted."""
    rows = e.join(about, (F.col("callee_class") == F.col("o_class")) & (F.col("callee_method") == F.col("o_method")), "left")
    rows = rows.join(admitted, (F.col("entry") == F.col("a_entry")) & (F.col("callee_file") == F.col("a_file")), "left")
    descends = F.col("callee").isNotNull() & ~F.col("cycle") & F.coalesce("admitted", F.lit(False))
    return rows.join(_first_documentable(shared, below), descends & (F.col("entry") == F.col("b_entry")) & (F.col("order") == F.col("b_order")), "left")


def _level(shared: ShapeFacts, e: DataFrame, last: bool) -> DataFrame:
    """Shapes of one level's instances, which carry those of the level below unless they are the last."""
    rich = shared.f["exprs"].select(F.col("expr_id").alias("x_id"), F.col("type_json").alias("x_type"))
    rows = e.join(shared.constructed.withColumnRenamed("shape", "built"), F.col("target") == F.col("new_id"), "left").join(rich, F.col("target") == F.col("x_id"), "left")
    given = scalars.from_type_args(F.col("x_type"))
    whole = _record(payload=F.when(dtype.kind_of(F.get(F.from_json(F.get_json_object("x_type", "$.args"), "array<string>"), F.lit(0))) != "unknown", F.get(F.from_json(F.get_json_object("x_type", "$.args"), "array<string>"), F.lit(0))), status=given["status"], content_type=given["content_type"], provenance=F.create_map(), delegates=F.lit(False))
    leaf = F.when(F.col("case") == "new", F.col("built")).when(F.col("case") == "rich", whole).when(F.col("case") == "delegation", _record(delegates=F.lit(True)))
    none = F.array().cast("array<string>")
    if last:
        return rows.select("entry", "order", leaf.alias("shape"), (F.col("case") == "call").cast("int").alias("truncations"), none.alias("files"), "ret_class", "ret_method")
    follows = F.col("callee").isNotNull() & ~F.col("cycle")
    rows = rows.withColumn("descends", follows & F.coalesce("admitted", F.lit(False))).withColumn("cut", (follows & ~F.coalesce("admitted", F.lit(True))).cast("int"))
    rows = rows.join(shared.slots, (F.col("case") == "call") & (F.col("target") == F.col("slot_call")), "left").withColumn("slots", F.coalesce("slots", F.create_map().cast(f"map<string,{SLOT}>")))
    rows = rows.withColumn("below", F.when(F.col("below").isNotNull() & ~F.col("below.delegates"), F.col("below").withField("component", F.coalesce("own", "below.component"))).otherwise(F.col("below")))
    # Payload, then status, then members; the order is part of the result.
    rows = graph.bind_call(rows, lambda x: x.withColumn("bound", bind_payload(F.col("below"), F.col("slots"))), lambda x: x.withColumn("bound", bind_status(F.col("bound"), F.col("slots"))), lambda x: _discover(shared, x))
    shape = F.when(F.col("case") == "call", F.when(F.col("below.delegates"), F.col("below")).otherwise(F.col("bound"))).otherwise(leaf)
    files = F.when(F.col("descends"), F.array_compact(F.array_distinct(F.concat(F.array("callee_file", "written"), F.coalesce("b_files", none), F.array("d_file"))))).otherwise(none)
    return rows.select("entry", "order", F.when(F.col("case").isNotNull(), shape).alias("shape"), (F.coalesce("b_truncations", F.lit(0)) + F.col("cut")).cast("int").alias("truncations"), files.alias("files"), "ret_class", "ret_method")


def _discover(shared: ShapeFacts, rows: DataFrame) -> DataFrame:
    """Members of an object payload that the call's receiver tells, bound through a factory where one built it."""
    kind = F.when(F.col("bound.members").isNull() & (dtype.kind_of(F.col("bound.payload")) == "class"), F.get_json_object("bound.payload", "$.fqcn"))
    out = rows.withColumn("p_class", kind).join(shared.discovered, (F.col("target") == F.col("d_call")) & (F.col("p_class") == F.col("d_class")), "left")
    filled = F.col("bound").withField("members", F.col("d_fields")).withField("provenance", F.col("d_provenance"))
    through = F.when(F.col("d_slots").isNotNull(), bind_payload(filled, F.col("d_slots"))).otherwise(filled)
    return out.withColumn("bound", F.when(F.col("d_call").isNotNull(), through).otherwise(F.col("bound")))


def _first_documentable(shared: ShapeFacts, below: DataFrame) -> DataFrame:
    """W3 by callee instance (b_entry, b_order): the first return that documents something, else the first delegation.

    Returns behind the one that speaks are not read, so their truncations and files do not count.
    """
    rows = below.join(shared.labels, F.col("ret_class").eqNullSafe(F.col("l_class")) & (F.col("ret_method") == F.col("l_method")) & (F.element_at("order", -1) == F.col("l_ord")), "left")
    labelled = F.col("shape").withField("content_type", lookups.labelled_content_type(F.col("shape.content_type"), F.col("label")))
    rows = rows.withColumn("shape", F.when(F.col("shape").isNotNull() & ~F.col("shape.delegates"), labelled).otherwise(F.col("shape")))
    of = [F.col("entry").alias("b_entry"), F.slice("order", F.lit(1), F.size("order") - 1).alias("b_order")]
    at = F.element_at("order", -1)
    speaks, hands_on = F.col("shape").isNotNull() & ~F.col("shape.delegates"), F.col("shape").isNotNull() & F.col("shape.delegates")
    each = F.struct(at.alias("at"), "truncations", "files")
    got = rows.groupBy(*of).agg(F.min_by("shape", F.when(speaks, at)).alias("said"), F.min(F.when(speaks, at)).alias("until"), F.min_by("shape", F.when(hands_on, at)).alias("handed"), F.collect_list(each).alias("each"))
    read = F.filter("each", lambda x: F.col("until").isNull() | (x["at"] <= F.col("until")))
    return got.select("b_entry", "b_order", F.coalesce("said", "handed").alias("below"), F.aggregate(read, F.lit(0), lambda a, x: a + x["truncations"]).alias("b_truncations"), F.flatten(F.transform(read, lambda x: x["files"])).alias("b_files"))


def site_types(sites: DataFrame, refined: DataFrame, exprs: DataFrame) -> DataFrame:
    """sites(entry, ord, expr_id, ...) with the type each is documented as, its component, truncations and files."""
    r = refined.select(F.col("entry").alias("s_entry"), F.col("ord").alias("s_ord"), "shape", "truncations", "files")
    x = exprs.select(F.col("expr_id").alias("x_id"), F.coalesce("type_json", dtype.unknown("unresolved type")).alias("plain"), F.col("kind").alias("x_kind"), "is_response", "rich")
    out = sites.join(r, (F.col("entry") == F.col("s_entry")) & (F.col("ord") == F.col("s_ord")), "left").join(x, F.col("expr_id") == F.col("x_id"), "left")
    members = F.when(F.col("shape.members").isNotNull(), dtype.shape(F.col("shape.members")))
    args = scalars.type_args(F.col("shape.payload"), F.col("shape.status"), F.col("shape.content_type"), members)
    full = F.when(args.isNotNull(), dtype.class_type(CANONICAL, args))
    stands = F.coalesce(F.col("is_response") & (~F.col("rich") | (F.col("x_kind") == "new")), F.lit(False))
    kind = scalars.site_shape(F.col("expr_id").isNotNull(), F.col("is_response"), F.col("x_kind") == "new", F.when(F.col("rich"), F.col("plain")), full, F.col("shape.delegates"), F.col("plain"))
    return out.select(*sites.columns, kind.alias("type"), F.when(stands, F.col("shape.component")).alias("component"), F.when(stands, F.coalesce("truncations", F.lit(0))).otherwise(0).alias("truncations"), F.when(stands, F.coalesce("files", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("files"))
