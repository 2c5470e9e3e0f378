"""The four questions, asked of all subjects at once.

``Engine`` takes the fact tables and answers: what an action returns and throws
(``analyze_actions``), which site of a callable serves a narrowed type
(``analyze_callable_refs``, or ``analyze_callables`` for ready sites), what shape a class exposes (``class_metadata``) and
what a trace visits (``trace``). Every answer carries the files it came from;
what cannot be known is an explicit unknown with a reason or a diagnostic.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import registry as reg
from ..functions import dtype, guards, scalars
from ..operators import aggregates, graph, lookups, windows
from . import shapes


@dataclass(frozen=True)
class EngineConfig:
    """Bounds and roots."""

    descend_roots: tuple[str, ...] = ("/",)
    prime_roots: tuple[str, ...] = ("/",)
    vendor_root: str | None = None
    trace_depth: int = 4
    throw_depth: int = 3
    file_budget: int = 40
    extra_throwers: tuple = field(default=())

    def roots(self) -> F.Column:
        """Throws and traces follow the descend roots, shapes the prime roots."""
        return F.array(*[F.lit(r) for r in self.descend_roots])

    def shape_roots(self) -> F.Column:
        return F.array(*[F.lit(r) for r in self.prime_roots])


def _method_key(cls: str = "class", method: str = "method") -> F.Column:
    return F.coalesce(scalars.scope_key(F.col(cls), F.col(method)), F.col(method))


class Engine:
    def __init__(self, spark: SparkSession, facts: dict[str, DataFrame], config: EngineConfig | None = None):
        self.spark, self.facts, self.config = spark, facts, config or EngineConfig()
        self._shapes: shapes.ShapeFacts | None = None

    @classmethod
    def create(cls, spark: SparkSession, facts: dict[str, DataFrame], config: EngineConfig | None = None) -> Engine:
        """D11."""
        return cls(spark, facts, config)

    # -------------------------------------------------------- throws

    def registry(self) -> DataFrame:
        base = reg.default_registry(self.spark)
        extra = self.config.extra_throwers
        return reg.extend(base, self.spark.createDataFrame(list(extra), reg.REGISTRY_SCHEMA)) if extra else base

    def throws(self, entries: DataFrame) -> DataFrame:
        """Throws of each entry(class, method): registry, explicit, descended; deduplicated and ordered."""
        f, registry = self.facts, self.registry()
        statuses = reg.known_statuses(registry)
        args = f["args"].groupBy("call_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "unpack", "const"))), lambda a: F.struct(a["unpack"].alias("unpack"), a["const"].alias("const"))).alias("status_args"))
        calls = f["calls"].where("not is_first_class").join(args.withColumnRenamed("call_id", "ac"), F.col("call_id") == F.col("ac"), "left").drop("ac")
        calls = calls.withColumn("status_args", F.coalesce("status_args", F.array().cast("array<struct<unpack: boolean, const: string>>")))
        callees = lookups.resolve_callees(calls, f["class_methods"])
        bodies = lookups.reads_body(calls, callees, f["methods"], self.config.roots())
        points = f["throw_points"]
        known = lookups.apply_registry(points, calls, registry, bodies)
        project = bodies.withColumnRenamed("call_id", "pc")
        explicit = points.join(project, F.col("call_id") == F.col("pc"), "left").withColumn("project_callee", F.col("pc").isNotNull()).drop("pc")
        classes = explicit.select(F.explode(scalars.concrete_classes(F.col("types"))).alias("exception")).distinct()
        status = lookups.status_for_types(classes, registry, statuses, f["class_closure"])
        # A point that the registry explains, or whose callee's body is read, says nothing more itself.
        taken = known.select(*[F.col(k).alias(f"k_{k}") for k in ("file", "class", "method", "ord")]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in ("file", "class", "method", "ord")]
        rest = explicit.where("not project_callee").join(taken, same, "left_anti")
        said = graph.explicit_throws(rest, status).select("class", "method", "ord", "line", "file", "exception", "status", "confidence", "disposition")
        own = said.unionByName(known.select("class", "method", "ord", "line", "file", "exception", "status", "confidence", "disposition"))
        label = scalars.self_label(F.coalesce("class", F.lit("")), F.col("method"))
        own = own.select(_method_key().alias("method"), "exception", "status", "confidence", "disposition", "ord", scalars.frame(label, F.col("file"), F.col("line")).alias("frame"))
        steps = points.join(bodies.withColumnRenamed("call_id", "bc"), F.col("call_id") == F.col("bc"), "left_semi")
        steps = steps.join(callees.withColumnRenamed("call_id", "cc"), F.col("call_id") == F.col("cc"))
        edges = steps.select(_method_key().alias("caller"), _method_key("callee_class", "callee_method").alias("callee"), "ord", scalars.frame(label, F.col("file"), F.col("line")).alias("frame"))
        names = entries.select(_method_key().alias("entry")).distinct()
        found = graph.descend_throws(names, own, edges, self.config.throw_depth)
        rank = aggregates.confidence_rank(F.col("confidence"))
        kept = aggregates.dedupe_throws(found, ["entry"], rank, ["order"])
        return kept.withColumn("place", aggregates.result_order(["entry"])).drop("order")

    # -------------------------------------------------------- shapes

    def shapes(self) -> shapes.ShapeFacts:
        if self._shapes is None:
            self._shapes = shapes.ShapeFacts(self.facts, self.config.shape_roots())
        return self._shapes

    def typed_sites(self, sites: DataFrame) -> DataFrame:
        """sites(entry, ord, expr_id, ...) with type, component, truncations and files, shapes recovered through project callees.

        What is recovered depends on an entry only by its sites' places and expressions: entries with the same list
        are one *form*, which is recovered once.
        """
        sites = graph.checkpoint(sites)
        place = F.struct("ord", F.col("expr_id").isNull().alias("none"), "expr_id")
        of = sites.groupBy(F.col("entry").alias("f_entry")).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(place))), 256).alias("form"))
        formed = graph.checkpoint(sites.join(of, F.col("entry").eqNullSafe(F.col("f_entry"))).drop("f_entry"))
        asked = graph.checkpoint(formed.select(F.col("form").alias("entry"), "ord", "expr_id").distinct())
        refined = shapes.refine_sites(self.shapes(), asked, self.config.trace_depth, self.config.file_budget)
        typed = graph.checkpoint(shapes.site_types(asked, refined, self.shapes().exprs))
        got = typed.select(F.col("entry").alias("t_form"), F.col("ord").alias("t_ord"), F.col("expr_id").alias("t_expr"), "type", "component", "truncations", "files")
        out = formed.join(got, (F.col("form") == F.col("t_form")) & F.col("ord").eqNullSafe(F.col("t_ord")) & F.col("expr_id").eqNullSafe(F.col("t_expr")))
        return graph.checkpoint(out.select(*sites.columns, "type", "component", "truncations", "files"))

    def _truncated(self, typed: DataFrame) -> DataFrame:
        return aggregates.truncation_diagnostics(typed.groupBy("entry").agg(F.sum("truncations").alias("truncations")), ["entry"])

    # -------------------------------------------------------- actions

    def analyze_actions(self, actions: DataFrame) -> dict[str, DataFrame]:
        """returns, throws, diagnostics and lineage of actions(class, method, file)."""
        f = self.facts
        located = actions.join(f["methods"].select(F.col("class").alias("mc"), F.col("method").alias("mm"), F.col("file").alias("mf")), (F.col("class").eqNullSafe(F.col("mc"))) & (F.col("method") == F.col("mm")) & (F.col("file") == F.col("mf")), "left")
        missing = located.where("mm is null").select(_method_key().alias("entry"), F.lit("Warning").alias("severity"), F.lit("inference.method-not-found").alias("code"), F.lit("no analysable body").alias("message"))
        here = located.where("mm is not null").select("class", "method", "file")
        typed = self.typed_sites(lookups.return_rows(here, f["return_sites"]).select(_method_key().alias("entry"), "ord", "expr_id", "file", "line"))
        returns = typed.select("entry", "ord", "type", "file", "line", "component")
        throws = self.throws(here)
        explained = self.points_explained(here)
        dropped = aggregates.dropped_count(explained, ["entry"]).where("dropped > 0").select("entry", F.lit("Hint").alias("severity"), F.lit("inference.throw-noise-dropped").alias("code"), F.concat(F.col("dropped").cast("string"), F.lit(" throw points explained by nothing")).alias("message"))
        files = here.select(_method_key().alias("entry"), "file").unionByName(typed.select("entry", F.explode("files").alias("file"))).unionByName(throws.select("entry", F.explode("chain").alias("c")).select("entry", F.col("c.file").alias("file")))
        return {"returns": returns, "throws": throws, "diagnostics": missing.unionByName(dropped).unionByName(self._truncated(typed)), "lineage": aggregates.lineage(files.where("file is not null"), ["entry"])}

    def points_explained(self, entries: DataFrame) -> DataFrame:
        """A2's input: the entries' own throw points and whether a registry entry or a read body explains each."""
        f, registry = self.facts, self.registry()
        calls = f["calls"].where("not is_first_class")
        callees = lookups.resolve_callees(calls, f["class_methods"])
        bodies = lookups.reads_body(calls, callees, f["methods"], self.config.roots())
        named = calls.join(registry.select(F.col("name").alias("rn")).distinct(), F.col("callee_name") == F.col("rn"), "left_semi").select("call_id")
        ok = named.unionByName(bodies).distinct().select(F.col("call_id").alias("ok"))
        mine = f["throw_points"].join(entries.select(F.col("class").alias("ec"), F.col("method").alias("em")).distinct(), F.col("class").eqNullSafe(F.col("ec")) & (F.col("method") == F.col("em")), "left_semi")
        return mine.join(ok, F.col("call_id") == F.col("ok"), "left").select(_method_key().alias("entry"), "explicit", F.col("ok").isNotNull().alias("explained"))

    # -------------------------------------------------------- callables

    def analyze_callables(self, sites: DataFrame) -> DataFrame:
        """The chosen site of each callable and whether the choice is ambiguous.

        ``sites(callable, pos, ord, type, component, guard, delegates, narrowed,
        supers)``; callables without a narrowed class keep all their sites in order.
        """
        open_ = sites.where("narrowed is null").withColumn("exact", F.lit(False)).withColumn("ambiguous", F.lit(False))
        live = windows.narrowed_sites(sites.where("narrowed is not null"), ["callable"], F.col("narrowed"), F.col("supers"))
        chosen = windows.choose_site(live, ["callable"], [scalars.source_order(F.col("pos")), F.col("ord")])
        return windows.ambiguity(live, chosen, ["callable"]).unionByName(open_)

    def analyze_callable_refs(self, callables: DataFrame) -> dict[str, DataFrame]:
        """returns, diagnostics and lineage of callables(callable, class, method, file, line, narrowed).

        A callable without a method is the closure at its line. With a narrowed
        class, the one site that serves it is returned; else all are.
        """
        f = self.facts
        m = f["methods"].select(F.col("class").alias("mc"), F.col("method").alias("mm"), F.col("file").alias("mf"), F.lit(True).alias("found"))
        c = f["closures"].select(F.col("file").alias("cf"), F.col("line").alias("cl"), F.lit(True).alias("closed"))
        at = callables.join(m, F.col("class").eqNullSafe(F.col("mc")) & (F.col("method") == F.col("mm")) & (F.col("file") == F.col("mf")), "left")
        at = at.join(c, F.col("method").isNull() & (F.col("file") == F.col("cf")) & (F.col("line") == F.col("cl")), "left")
        at = at.withColumn("body", F.coalesce("mm", F.when(F.col("closed"), F.concat(F.lit("{closure}:"), F.col("line").cast("string")))))
        missing = at.where("body is null").select("callable", F.lit("Info").alias("severity"), F.lit("inference.callable-not-found").alias("code"), F.lit("no analysable body").alias("message"))
        here = at.where("body is not null").select("callable", "class", "method", "file", "narrowed", "body")
        rows = f["return_sites"].select(F.col("class").alias("rc"), F.col("method").alias("rm"), F.col("file").alias("rf"), "ord", "pos", "expr_id", "narrowed_type_json")
        sites = here.join(rows, F.col("class").eqNullSafe(F.col("rc")) & (F.col("body") == F.col("rm")) & (F.col("file") == F.col("rf")))
        arm = F.struct("ord", "pos", F.col("body_expr_id").alias("expr_id"), "is_default", F.coalesce("cond_dnf", guards.no_guard()).alias("guard"))
        arms = f["match_arms"].groupBy(F.col("expr_id").alias("match_id")).agg(F.array_sort(F.collect_list(arm)).alias("arms"))
        sites = sites.join(arms, F.col("narrowed").isNotNull() & (F.col("expr_id") == F.col("match_id")), "left")
        sites = sites.withColumn("guard", F.when(F.col("narrowed").isNotNull(), guards.of_type(F.col("narrowed_type_json"))).otherwise(guards.no_guard()))
        sites = windows.arms_of(sites.select("callable", "class", "method", "narrowed", "ord", "pos", "expr_id", "guard", "arms"), "expr_id")
        place = F.row_number().over(Window.partitionBy("callable").orderBy("ord", "arm_at")).cast("int")
        typed = self.typed_sites(sites.withColumn("ord", place).withColumnRenamed("callable", "entry"))
        supers = f["class_closure"].groupBy(F.col("sub").alias("s_sub")).agg(F.collect_set("super").alias("supers"))
        ready = typed.join(supers, F.col("narrowed") == F.col("s_sub"), "left").select(F.col("entry").alias("callable"), "pos", "ord", "type", "component", "guard", dtype.is_delegation(F.col("type")).alias("delegates"), "narrowed", F.coalesce("supers", F.array().cast("array<string>")).alias("supers"))
        own = lookups.attribute_on(f["attributes"], shapes.COMPONENT).select(F.col("class").alias("oc"), F.col("method").alias("om"), "component")
        named = here.join(own, (F.col("class") == F.col("oc")) & (F.col("method") == F.col("om"))).select("callable", "component")
        chosen = windows.stamp_entry(self.analyze_callables(ready), named, ["callable"])
        unsure = chosen.where("ambiguous").select("callable", F.lit("Info").alias("severity"), F.lit("inference.ambiguous-narrowing").alias("code"), F.concat(F.lit("more than one return site is reachable for "), F.col("narrowed")).alias("message"))
        written = lookups.file_for(here.select("callable", "class", "method", "file"), f["class_methods"])
        files = written.select("callable", F.explode(F.array_compact(F.array("file", "written_in_file"))).alias("file")).unionByName(typed.select(F.col("entry").alias("callable"), F.explode("files").alias("file")))
        cut = self._truncated(typed).withColumnRenamed("entry", "callable")
        return {"returns": chosen.select("callable", "ord", "type", "component"), "diagnostics": missing.unionByName(unsure).unionByName(cut), "lineage": aggregates.lineage(files, ["callable"])}

    # -------------------------------------------------------- classes and traces

    def class_metadata(self, requests: DataFrame) -> DataFrame:
        """Ordered properties of each requested class, types by native declaration and doc comment, and the files these rest on."""
        from ..sources import facts as sources

        f = self.facts
        props = aggregates.class_properties(f["properties"])
        kind = dtype.property_type(F.col("native_type_json"), F.when(F.col("is_promoted"), F.col("param_type_json")), F.col("var_type_json"))
        typed = props.withColumn("type", kind)
        files = f["classes"].select("class", "file") if "classes" in f else self.spark.createDataFrame([], "class string, file string")
        above = f["class_closure"].select("sub", "super") if "class_closure" in f else self.spark.createDataFrame([], "sub string, super string")
        names = requests.select("class").distinct()
        # Enums at any depth of a type: their names stand in its text, with escaped backslashes.
        enums = typed.select("class", F.explode(F.regexp_extract_all("type", F.lit('"kind":"enum","fqcn":"([^"]+)"'), F.lit(1))).alias("enum")).withColumn("enum", F.replace("enum", F.lit("\\\\"), F.lit("\\"))).distinct()
        hierarchy = names.select(F.col("class").alias("sub"), F.col("class").alias("super")).union(above)
        deps = aggregates.class_dependencies(hierarchy, enums, files).select(F.col("class").alias("dep_class"), F.col("files").alias("dep_files"))
        out = sources.metadata_for(requests, typed).join(deps, F.col("class") == F.col("dep_class"), "left")
        return out.select("class", "props", F.coalesce("dep_files", F.array().cast("array<string>")).alias("files"))

    def trace(self, roots: DataFrame, edges: DataFrame) -> DataFrame:
        return graph.trace(roots, edges, self.config.trace_depth, self.config.file_budget)

    def nodes(self) -> DataFrame:
        """The nodes a visitor sees: expr_id, class, method, kind, type, constant, and for calls file, pos and callee_name."""
        f = self.facts
        calls = f["calls"].where("not is_first_class").select(F.col("call_id").alias("nc"), "file", "pos", "callee_name", F.col("line").alias("call_line"))
        places = calls.select(F.col("nc").alias("expr_id"), F.lit(None).cast("string").alias("trait_file"), F.col("file").alias("scope_file"), "pos", F.col("call_line").alias("line"))
        seen = lookups.node_view(f["exprs"], places).withColumnRenamed("expr_id", "v_id")
        rows = f["exprs"].select("expr_id", F.col("scope_class").alias("class"), F.col("scope_fn").alias("method"), "kind", "member", "var_name")
        return rows.join(seen, F.col("expr_id") == F.col("v_id")).join(calls, F.col("expr_id") == F.col("nc"), "left").drop("v_id", "nc", "call_line")

    def trace_visitor(self, actions: DataFrame, visitor: Callable[[DataFrame], DataFrame], follows: Callable[[F.Column], F.Column] | None = None) -> dict[str, DataFrame]:
        """The methods a visitor walks from each action, and the nodes it meets there.

        ``visitor`` gets the nodes and returns expr_id and ``descend``, whether it
        asks to follow that call; the engine follows into project files, and beyond
        them but not into vendor files where ``follows`` accepts the call's type.
        """
        f, config = self.facts, self.config
        asked = visitor(self.nodes()).where("descend").select(F.col("expr_id").alias("q_id"))
        calls = f["calls"].where("not is_first_class").join(asked, F.col("call_id") == F.col("q_id"), "left_semi")
        callees = lookups.resolve_callees(calls, f["class_methods"]).withColumnRenamed("call_id", "c_id")
        types = f["exprs"].select(F.col("expr_id").alias("t_id"), "type_json")
        step = calls.join(callees, F.col("call_id") == F.col("c_id")).join(types, F.col("call_id") == F.col("t_id"), "left")
        accepts = F.lit(False) if follows is None else follows(F.col("type_json"))
        beyond = scalars.follow_beyond_project(F.lit(follows is not None), F.col("callee_file"), F.lit(config.vendor_root).cast("string"), accepts)
        step = step.where(scalars.is_project_file(F.col("callee_file"), config.roots()) | beyond)
        edges = step.select(_method_key().alias("src"), _method_key("callee_class", "callee_method").alias("dst"), F.col("callee_file").alias("dst_file"), F.col("pos"), F.col("call_id").alias("ord"))
        # Callees in order of their first call.
        edges = windows.descend_order(edges, ["src"], ["dst", "dst_file"]).select("src", "dst", "dst_file", F.col("place").alias("pos"), F.lit(0).alias("ord"))
        visits = self.trace(actions.select(_method_key().alias("root"), F.col("file").alias("root_file")), edges)
        met = self.nodes().withColumn("owner", _method_key())
        nodes = visits.join(met, F.col("node") == F.col("owner")).drop("owner")
        files = f["methods"].select(_method_key().alias("mk"), F.col("file").alias("mfile"))
        lineage = visits.join(files, F.col("node") == F.col("mk")).select("root", F.col("mfile").alias("file"))
        return {"visits": visits, "nodes": nodes, "lineage": aggregates.lineage(lineage, ["root"])}

    def folded_calls(self, requests: DataFrame, follows: Callable[[F.Column], F.Column] | None = None) -> DataFrame:
        """requests(trace, ord, call_id) each answered once with the constant that its call returns, as JSON; null where none is known.

        A callee folds if its body always returns, by one return only: to the
        constant of its expression, or to what the call binds to the parameter it returns.
        """
        f, config = self.facts, self.config
        calls = f["calls"].where("not is_first_class")
        callees = lookups.resolve_callees(calls, f["class_methods"]).withColumnRenamed("call_id", "c_id")
        types = f["exprs"].select(F.col("expr_id").alias("t_id"), "type_json", F.col("const.v").alias("v"), "var_name")
        at = calls.join(callees, F.col("call_id") == F.col("c_id")).join(types.select("t_id", "type_json"), F.col("call_id") == F.col("t_id"), "left").drop("t_id")
        wanted = F.lit(False) if follows is None else follows(F.col("type_json"))
        at = at.where(scalars.can_fold_callee(F.col("callee_file"), F.col("file"), config.roots(), F.lit(config.vendor_root).cast("string"), wanted))
        ends = f["methods"].select(F.col("class").alias("mc"), F.col("method").alias("mm"), "always_terminates")
        single = f["return_sites"].join(ends, F.col("class").eqNullSafe(F.col("mc")) & (F.col("method") == F.col("mm")))
        single = aggregates.single_terminating(single, ["class", "method"], F.col("always_terminates"), F.col("expr_id")).select(F.col("class").alias("sc"), F.col("method").alias("sm"), F.col("value").alias("r_id"))
        said = at.join(single, (F.col("callee_class") == F.col("sc")) & (F.col("callee_method") == F.col("sm"))).join(types, F.col("r_id") == F.col("t_id")).select("call_id", "callee_class", "callee_method", "v", "var_name")
        params = said.join(f["params"].select(F.col("class").alias("pc"), F.col("method").alias("pm"), "idx", F.col("name").alias("param"), "variadic", "default_const"), (F.col("callee_class") == F.col("pc")) & (F.col("callee_method") == F.col("pm"))).select("call_id", "idx", "param", "variadic", "default_const")
        slots = lookups.argument_slots(f["args"], params).join(types.select(F.col("t_id"), F.col("v").alias("const")), F.col("expr_id") == F.col("t_id"), "left")
        # A default holds only where no spread may carry the argument (T5).
        sure = slots.where("known").select(F.col("call_id").alias("k_id"), F.col("idx").alias("k_idx"))
        sure = params.join(sure, (F.col("call_id") == F.col("k_id")) & (F.col("idx") == F.col("k_idx")), "left").withColumn("default_const", F.when(F.col("k_id").isNotNull(), F.col("default_const"))).drop("k_id", "k_idx")
        bound = lookups.bindings(sure, slots).select(F.col("call_id").alias("b_id"), F.col("param").alias("b_param"), F.col("value").alias("b_value"))
        value = said.join(bound, (F.col("call_id") == F.col("b_id")) & (F.col("var_name") == F.col("b_param")), "left").select(F.col("call_id").alias("callee"), F.coalesce("v", "b_value").alias("value")).where("value is not null")
        return graph.fold_requests(requests.select("trace", "ord", F.col("call_id").alias("callee")), value).withColumnRenamed("callee", "call_id")

    def trace_closures(self, requests: DataFrame, returns: DataFrame) -> DataFrame:
        """Returns of the closure at a line: full closures only if they always return; no descent."""
        c = self.facts["closures"].select(F.col("file").alias("cf"), F.col("line").alias("cl"), "always_terminates")
        at = requests.join(c, (F.col("file") == F.col("cf")) & (F.col("line") == F.col("cl"))).where("always_terminates").select("file", "line")
        return returns.join(at.select(F.col("file").alias("af"), F.col("line").alias("al")), (F.col("file") == F.col("af")) & (F.col("line") == F.col("al")), "left_semi")
