"""Constant folding of expression trees (JSON in, canonical constant JSON out).

Expressions nest without bound, so this is an Arrow UDF, not a column
expression. A folded null is a constant; a null result means "not constant".

Expression nodes: {"t": "lit", "v": ...}, {"t": "var", "name"}, {"t": "array",
"items": [{"value", "unpack"}]}, {"t": "static", "class", "name", "args",
"callable"}, {"t": "method", "var", "name", "args", "callable"}, {"t": "const",
"class", "name", "enum"}, {"t": "new", "class", "args", "callable"}; arguments
are {"value", "unpack", "name"}. Any node may carry "v", the one constant value of
its type, which holds where nothing else folds it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _spread(what: str) -> dict:
    return {"kind": "spread", "reason": what}


def _unknown(what: str) -> dict:
    return {"kind": "unknown", "reason": what}


def fold_args(args: list[dict], bindings: dict, what: str) -> list[dict]:
    """A spread that is written out gives its items; the first argument that has no sure place ends the list with one mark."""
    out: list[dict] = []
    for a in args:
        items = None
        if a.get("name") is None:
            if not a.get("unpack"):
                out.append(fold(a["value"], bindings) or _unknown(f"non-constant {what}"))
                continue
            got = fold(a["value"], bindings)
            if got and got["kind"] == "array" and all(i["kind"] != "spread" for i in got["items"]):
                items = got["items"]
        if items is None:
            return [*out, _spread(f"unplaceable {what}")]
        out += items
    return out


def fold(node: dict | None, bindings: dict) -> dict | None:
    """The ordered cases; the first that applies decides, null means not constant."""
    if node is None:
        return None
    t, open_call = node.get("t"), node.get("callable")
    bound = bindings.get(node["name"]) if t == "var" else None
    if bound is not None:
        return bound
    if t == "array":
        return {"kind": "array", "items": [_spread("spread array item") if i.get("unpack") else fold(i["value"], bindings) or _unknown("non-constant array item") for i in node["items"]]}
    if t == "static" and not open_call:
        return {"kind": "descriptor", "name": f"{node['class']}::{node['name']}", "args": fold_args(node["args"], bindings, "factory arg"), "chain": []}
    if t == "method" and not open_call:
        on = fold(node["var"], bindings)
        if on and on["kind"] == "descriptor":
            call = {"name": node["name"], "args": fold_args(node["args"], bindings, "chained-call arg")}
            return {**on, "chain": [*on["chain"], call]}
    if t == "const" and node.get("enum") and node["name"].lower() != "class":
        return {"kind": "scalar", "value": node["name"]}
    if t == "new" and node.get("class") and not open_call:
        return {"kind": "instance", "class": node["class"], "args": fold_args(node["args"], bindings, "constructor arg")}
    # What no case above reads may still have one constant value by its type.
    return {"kind": "scalar", "value": node["v"]} if "v" in node else None


def render(c: dict) -> str:
    """The constant as one would write it; class names without their namespace."""
    short = lambda name: name.rsplit("\\", 1)[-1]
    args = lambda xs: "(" + ", ".join(map(render, xs)) + ")"
    kind = c["kind"]
    if kind == "scalar":
        v = c["value"]
        return f"'{v}'" if isinstance(v, str) else {None: "null", True: "true", False: "false"}.get(v, str(v)) if not isinstance(v, (int, float)) or isinstance(v, bool) else str(v)
    if kind == "array":
        return "[" + ", ".join(map(render, c["items"])) + "]"
    if kind == "descriptor":
        return short(c["name"]) + args(c["args"]) + "".join(f"->{x['name']}{args(x['args'])}" for x in c["chain"])
    if kind == "instance":
        return f"new {short(c['class'])}{args(c['args'])}"
    return f"...<{c['reason']}>" if kind == "spread" else f"<unknown: {c['reason']}>"


@F.pandas_udf(StringType())
def fold_constant(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """X1 over columns (expression JSON, bindings JSON object or null)."""
    for exprs, bound in batches:
        yield pd.Series([json.dumps(got, separators=(",", ":"), sort_keys=True) if e and (got := fold(json.loads(e), json.loads(b) if b else {})) is not None else None for e, b in zip(exprs, bound)], dtype=object)


@F.pandas_udf(StringType())
def render_constant(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda c: render(json.loads(c)) if c else None)


def scalar_fold(values: F.Column) -> F.Column:
    """struct<v> of the one constant (JSON) of a type, null if it has not exactly one; a folded null is struct(null)."""
    return F.when(F.size(values) == 1, F.struct(F.when(values[0] != "null", values[0]).alias("v")))


def int_literal(folded: F.Column) -> F.Column:
    """The folded value if it is an integer."""
    return F.when(folded["v"].rlike("^-?[0-9]+$"), folded["v"].try_cast("int"))
