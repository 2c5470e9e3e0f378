"""Response shapes through project callees, and callables that serve a narrowed type, over hand-built facts."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.plans.engine import Engine, EngineConfig
from factloom.schemas import FACTS

JSON = "Illuminate\\Http\\JsonResponse"
BARE = json.dumps({"kind": "class", "fqcn": JSON, "args": []}, separators=(",", ":"))
PROBLEM = "application/problem+json"


class Facts:
    """Fact rows, with ids given out in order."""

    def __init__(self):
        self.rows = {k: [] for k in FACTS}
        self.n = 0

    def add(self, table, *row):
        self.rows[table].append(row)

    def expr(self, kind, scope, type_json=None, const=None, var=None, prop=None, member=None, is_null="no"):
        self.n += 1
        self.add("exprs", self.n, kind, type_json, None if const is None else (const,), is_null, var, prop, member, *scope)
        return self.n

    def lit(self, scope, value):
        kind = json.dumps({"kind": "literal", "value": value}, separators=(",", ":"))
        return self.expr("lit", scope, kind, json.dumps(value))

    def array(self, scope, **items):
        fields = [{"key": k, "type": json.dumps({"kind": "scalar", "name": "string"}), "optional": False} for k in items]
        text = ",".join('{"key":%s,"type":{"kind":"scalar","name":"string"},"optional":false}' % json.dumps(f["key"]) for f in fields)
        at = self.expr("array", scope, '{"kind":"shape","fields":[%s],"is_list":false}' % text)
        for k, (key, value) in enumerate(items.items()):
            self.add("array_items", at, k, key.replace("_", "-") if key == "Content_Type" else key, value)
        return at

    def method(self, cls, name, file, *params):
        self.add("methods", cls, name, file, True)
        self.add("class_methods", cls, name, cls, file, file, 1)
        for k, p in enumerate(params):
            self.add("params", cls, name, k, p, False, False, None)
        return cls, name

    def args(self, call, *values, unpack=()):
        for k, v in enumerate(values):
            self.add("args", call, k, None, k in unpack, v, None, None)

    def new(self, scope, body, status=None, headers=None):
        at = self.expr("new", scope, BARE)
        self.args(at, *[x for x in (body, status, headers) if x is not None])
        return at

    def call(self, scope, cls, method, *values, type_json=BARE, unpack=(), receivers=None):
        at = self.expr("call", scope, type_json, member=method)
        self.add("calls", at, "/app/x.php", *scope, at, 1, "static", method, [cls] if receivers is None else receivers, False)
        self.args(at, *values, unpack=unpack)
        return at

    def returns(self, scope, file, *exprs, narrowed=None):
        for k, e in enumerate(exprs):
            self.add("return_sites", file, *scope, k, 100 + k, 10 + k, e, (narrowed or {}).get(k))

    def tables(self, spark):
        return {k: spark.createDataFrame(v, FACTS[k]) for k, v in self.rows.items()}


@pytest.fixture(scope="module")
def engine(spark):
    f = Facts()
    for k, p in enumerate(("data", "status", "headers")):
        f.add("params", JSON, "__construct", k, p, False, False, None)
    make = f.method("Shop\\Problem", "make", "/app/problem.php", "title", "code")
    var = lambda s, name: f.expr("variable", s, '{"kind":"scalar","name":"int"}', var=name)
    headers = lambda s: f.array(s, Content_Type=f.lit(s, PROBLEM))
    f.returns(make, "/app/problem.php", f.new(make, f.array(make, title=var(make, "title"), code=var(make, "code"), kind=f.lit(make, "k")), var(make, "code"), headers(make)))
    f.add("attributes", "Shop\\Problem", "make", 0, "ErrorComponent", "Problem", "/app/problem.php", 1)
    of = f.method("Shop\\Problem", "of", "/app/problem.php", "size")
    f.returns(of, "/app/problem.php", f.new(of, f.array(of, name=f.expr("property", of, var="size", member="name")), f.expr("property", of, var="size", member="value")))
    for k, (case, v) in enumerate((("Small", "410"), ("Large", "413"))):
        f.add("enum_cases", "Shop\\Size", k, case, v)
    f.add("classes", "Shop\\Size", "/app/size.php", True, True, True)

    def entry(name, make_expr, *more):
        scope = f.method("Desk", name, "/app/desk.php", "e")
        f.returns(scope, "/app/desk.php", make_expr(scope), *[m(scope) for m in more])
        return scope

    entry("direct", lambda s: f.new(s, f.array(s, a=f.lit(s, 1)), f.lit(s, 429), headers(s)))
    entry("plain", lambda s: f.new(s, f.array(s, a=f.lit(s, 1))))
    spread = lambda s: f.expr("variable", s, var="rest")

    def covered(s):
        at = f.expr("new", s, BARE)
        f.args(at, f.array(s, a=f.lit(s, 1)), spread(s), unpack=(1,))
        return at

    entry("covered", covered)
    entry("oneHop", lambda s: f.call(s, "Shop\\Problem", "make", f.lit(s, "Gone"), f.lit(s, 410)))
    entry("helper", lambda s: f.call(s, "Shop\\Problem", "make", f.lit(s, "Lost"), f.lit(s, 404)))
    f.add("attributes", "Desk", "helper", 0, "ErrorComponent", "Outer", "/app/desk.php", 1)
    entry("twoHop", lambda s: f.call(s, "Desk", "helper"))
    entry("unfolded", lambda s: f.call(s, "Shop\\Problem", "make", f.lit(s, "X"), f.expr("call", s, '{"kind":"scalar","name":"int"}')))
    entry("sized", lambda s: f.call(s, "Shop\\Problem", "of", f.expr("const", s, prop="Shop\\Size", member="Large")))
    entry("vendor", lambda s: f.call(s, "Vendor\\Thing", "make"))
    f.add("class_methods", "Vendor\\Thing", "make", "Vendor\\Thing", "/vendor/t.php", "/vendor/t.php", 1)
    entry("nothing", lambda s: f.expr("lit", s, '{"kind":"null"}', is_null="yes"))
    entry("bareReturn", lambda s: None)
    entry("text", lambda s: f.expr("x", s, '{"kind":"scalar","name":"string"}'))
    local = f.method("Desk", "local", "/app/desk.php")
    r = f.call(local, "Shop\\Problem", "make", f.lit(local, "L"), f.lit(local, 418))
    f.returns(local, "/app/desk.php", f.expr("variable", local, BARE, var="r"))
    f.add("local_writes", "/app/desk.php", "Desk::local", "r", 0, r, False, False, 50)
    twice = f.method("Desk", "twice", "/app/desk.php")
    for k in range(2):
        f.add("local_writes", "/app/desk.php", "Desk::twice", "r", k, f.call(twice, "Shop\\Problem", "make", f.lit(twice, "L"), f.lit(twice, 418)), False, False, 50 + k)
    f.returns(twice, "/app/desk.php", f.expr("variable", twice, BARE, var="r"))
    labelled = f.method("Desk", "labelled", "/app/desk.php")
    f.add("local_writes", "/app/desk.php", "Desk::labelled", "r", 0, f.new(labelled, f.array(labelled, a=f.lit(labelled, 1))), False, False, 50)
    f.add("header_writes", "/app/desk.php", "Desk", "labelled", "r", 60, "content-TYPE", "text/csv")
    f.returns(labelled, "/app/desk.php", f.expr("variable", labelled, BARE, var="r"))
    entry("viaLabel", lambda s: f.call(s, "Desk", "labelled"))
    entry("again", lambda s: f.call(s, "Desk", "again"), lambda s: f.new(s, f.array(s, a=f.lit(s, 1)), f.lit(s, 503)))
    for k in range(6):
        entry(f"deep{k}", (lambda s, k=k: f.call(s, "Desk", f"deep{k + 1}")) if k < 5 else lambda s: f.new(s, f.array(s, a=f.lit(s, 1)), f.lit(s, 200)))
    # An object payload: its members are known from the constructor that built the receiver.
    note = json.dumps({"kind": "class", "fqcn": "Shop\\Note", "args": []}, separators=(",", ":"))
    for k, p in enumerate(("id", "body", "key")):
        f.add("params", "Shop\\Note", "__construct", k, p, False, False, None)
    send = f.method("Shop\\Note", "send", "/app/note.php", "code")
    f.returns(send, "/app/note.php", f.new(send, f.expr("x", send, note), var(send, "code")))
    build = f.method("Shop\\Notes", "build", "/app/notes.php", "body")
    made = f.expr("new", build, note)
    f.args(made, f.lit(build, 5), var(build, "body"), f.expr("const", build, '{"kind":"scalar","name":"string"}', member="API_KEY"))
    f.returns(build, "/app/notes.php", made)

    def sent(s):
        receiver = f.call(s, "Shop\\Notes", "build", f.lit(s, "hello"), type_json=note)
        at = f.call(s, "Shop\\Note", "send", f.lit(s, 202))
        f.add("expr_edges", at, 0, receiver, "receiver")
        return at

    entry("sent", sent)
    # A callable with one arm for each exception, and one that narrows by its returns.
    arms = f.method("Desk", "render", "/app/desk.php", "e")
    match = f.expr("match", arms, BARE)
    for k, (guard, code) in enumerate(((["Lost"], 404), (["Late"], 408), (None, 500))):
        f.add("match_arms", match, k, None if guard is None else [guard], guard is None, f.call(arms, "Shop\\Problem", "make", f.lit(arms, "t"), f.lit(arms, code)), 200 + k)
    f.returns(arms, "/app/desk.php", f.expr("lit", arms, '{"kind":"null"}'), match)
    f.add("class_closure", "VeryLate", "Late")
    both = f.method("Desk", "both", "/app/desk.php", "e")
    lost = json.dumps({"kind": "class", "fqcn": "Lost", "args": []})
    f.returns(both, "/app/desk.php", f.new(both, f.array(both, a=f.lit(both, 1)), f.lit(both, 404)), f.new(both, f.array(both, a=f.lit(both, 1)), f.lit(both, 410)), narrowed={0: lost, 1: lost})
    f.add("attributes", "Desk", "both", 0, "ErrorComponent", "Both", "/app/desk.php", 1)
    f.add("closures", "/app/desk.php", 77, 0, True)
    f.add("return_sites", "/app/desk.php", None, "{closure}:77", 0, 300, 78, f.lit((None, "{closure}:77"), 1), None)
    return Engine.create(spark, f.tables(spark), EngineConfig(descend_roots=("/app",), prime_roots=("/app",)))


def actions(spark, *names):
    return spark.createDataFrame([("Desk", n, "/app/desk.php") for n in names], "class string, method string, file string")


def shape_of(type_json):
    """(status, content type, keys or None) of a recovered response."""
    t = json.loads(type_json)
    if t["kind"] != "class" or not t["args"]:
        return t["kind"], None, None
    value = lambda k: t["args"][k].get("value") if len(t["args"]) > k and t["args"][k]["kind"] == "literal" else None
    payload = t["args"][0]
    return value(1), value(2), [f["key"] for f in payload["fields"]] if payload["kind"] == "shape" else payload["kind"]


EXPECTED = {
    "direct": (429, PROBLEM, ["a"]),
    "plain": (200, None, ["a"]),
    "covered": (None, None, ["a"]),
    "oneHop": (410, PROBLEM, ["title", "code", "kind"]),
    "twoHop": (404, PROBLEM, ["title", "code", "kind"]),
    "unfolded": (None, PROBLEM, ["title", "code", "kind"]),
    "sized": (413, None, ["name"]),
    "vendor": ("class", None, None),
    "nothing": ("null", None, None),
    "bareReturn": ("void", None, None),
    "text": ("scalar", None, None),
    "local": (418, PROBLEM, ["title", "code", "kind"]),
    "twice": ("class", None, None),
    "viaLabel": (200, "text/csv", ["a"]),
    "again": (503, None, ["a"]),
    "deep0": ("class", None, None),
    "deep1": (200, None, ["a"]),
    "sent": (202, None, "class"),
}


@pytest.fixture(scope="module")
def analysed(spark, engine):
    got = engine.analyze_actions(actions(spark, *EXPECTED))
    return {k: v.collect() for k, v in got.items()}


def test_shapes_are_recovered(analysed):
    first = {r.entry.removeprefix("Desk::"): r for r in analysed["returns"] if r.ord == 0}
    assert {n: shape_of(r.type) for n, r in first.items()} == EXPECTED


def test_call_sites_bind_members(analysed):
    types = {r.entry.removeprefix("Desk::"): json.loads(r.type) for r in analysed["returns"] if r.ord == 0}
    fields = lambda n: {f["key"]: f["type"] for f in types[n]["args"][0]["fields"]}
    assert fields("oneHop")["title"] == {"kind": "literal", "value": "Gone"} and fields("oneHop")["code"] == {"kind": "literal", "value": 410}
    assert fields("twoHop")["code"] == {"kind": "literal", "value": 404} and fields("unfolded")["code"] == {"kind": "status_marker"}
    assert fields("sized")["name"] == {"kind": "literal", "value": "Large"}
    members = {f["key"]: (f["type"], f["optional"]) for f in types["sent"]["args"][3]["fields"]}
    assert members["id"] == ({"kind": "literal", "value": 5}, False) and members["body"] == ({"kind": "literal", "value": "hello"}, False)
    assert members["key"][0] == {"kind": "unknown", "reason": "sensitive constant"}


def test_components_lineage_and_truncations(analysed):
    components = {r.entry.removeprefix("Desk::"): r.component for r in analysed["returns"] if r.ord == 0}
    assert components["oneHop"] == "Problem" and components["twoHop"] == "Outer" and components["direct"] is None
    files = {r.entry.removeprefix("Desk::"): r.files for r in analysed["lineage"]}
    assert files["oneHop"] == ["/app/desk.php", "/app/problem.php"] and files["vendor"] == ["/app/desk.php"] and files["sent"] == ["/app/desk.php", "/app/note.php", "/app/notes.php"]
    cut = {r.entry: r.code for r in analysed["diagnostics"]}
    assert cut == {"Desk::deep0": "inference.response-shape-truncated"}


def test_file_budget_truncates(spark, engine):
    small = Engine.create(spark, engine.facts, EngineConfig(descend_roots=("/app",), prime_roots=("/app",), file_budget=1))
    got = small.analyze_actions(actions(spark, "twoHop", "oneHop"))
    assert {r.entry: shape_of(r.type)[0] for r in got["returns"].collect()} == {"Desk::twoHop": "class", "Desk::oneHop": 410}
    assert [(r.entry, r.code) for r in got["diagnostics"].collect()] == [("Desk::twoHop", "inference.response-shape-truncated")]


def test_callables_serve_the_narrowed_type(spark, engine):
    rows = [("lost", "render", None, "Lost"), ("late", "render", None, "VeryLate"), ("other", "render", None, "Odd"), ("all", "render", None, None), ("both", "both", None, "Lost"), ("closure", None, 77, None), ("gone", "missing", None, "Lost"), ("goneClosure", None, 1, None)]
    refs = spark.createDataFrame([(n, "Desk" if m else None, m, "/app/desk.php", line, to) for n, m, line, to in rows], "callable string, class string, method string, file string, line int, narrowed string")
    got = engine.analyze_callable_refs(refs)
    found = {}
    for r in got["returns"].collect():
        found.setdefault(r.callable, []).append((r.ord, shape_of(r.type)[0], r.component))
    assert {k: [x[1:] for x in sorted(v)] for k, v in found.items()} == {
        "lost": [(404, "Problem")], "late": [(408, "Problem")], "other": [(500, "Problem")],
        "all": [("null", None), ("class", None)], "both": [(404, "Both")], "closure": [("literal", None)],
    }
    codes = sorted((r.callable, r.code) for r in got["diagnostics"].collect())
    assert codes == [("both", "inference.ambiguous-narrowing"), ("gone", "inference.callable-not-found"), ("goneClosure", "inference.callable-not-found")]
    files = {r.callable: r.files for r in got["lineage"].collect()}
    assert files["lost"] == ["/app/desk.php", "/app/problem.php"] and files["closure"] == ["/app/desk.php"]


def test_shapes_do_not_depend_on_order(spark, engine, analysed):
    mixed = Engine.create(spark, {k: v.orderBy(F.rand(3)).repartition(2) for k, v in engine.facts.items()}, engine.config)
    names = ("twoHop", "sized", "again", "sent")
    got = sorted(str(r) for r in mixed.analyze_actions(actions(spark, *names))["returns"].collect())
    assert got == sorted(str(r) for r in analysed["returns"] if r.entry.removeprefix("Desk::") in names)
