"""The type lattice as column functions.

A type is canonical JSON in a string column: equal types are equal strings, so
types group, join and sort. Shape fields are ordered and therefore a JSON array.

Union members are flattened, distinct and sorted by (is null type, JSON text),
which puts the null type last; the JSON text begins with the kind.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reasons that an unknown type carries.
REASONS = {
    "depth": "translation depth budget exhausted",
    "value": "missing value type",
    "undeclared": "no declared type",
    "array": "untyped array",
    "reflection": "unsupported reflection type",
    "payload": "payload not folded",
    "status": "status not folded",
    "content_type": "content type not recovered",
    "argument": "constructor argument not folded",
    "sensitive": "sensitive constant",
}

#: Deepest nesting that a translation follows.
TRANSLATION_DEPTH = 12


def json_text(c: Column) -> Column:
    """A string column as a JSON string literal."""
    whole = F.to_json(F.array(c.cast("string")))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def _object(kind: str, **fields: Column) -> Column:
    parts = [F.lit('{"kind":"%s"' % kind)]
    for name, value in fields.items():
        parts += [F.lit(',"%s":' % name), value]
    return F.concat(*parts, F.lit("}"))


def _list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _text(c: Column | str) -> Column:
    """A name as a JSON string literal; one that is known while planning is no work for rows."""
    if isinstance(c, str):
        return F.lit(json.dumps(c, ensure_ascii=False)) if c.isprintable() else json_text(F.lit(c))
    return json_text(c)


def scalar(name: Column | str) -> Column:
    return _object("scalar", name=_text(name))


def literal(value_json: Column) -> Column:
    """A constant scalar, given as JSON (``"x"``, ``5``, ``true``)."""
    return _object("literal", value=value_json)


def null_type() -> Column:
    return _object("null")


def void_type() -> Column:
    return _object("void")


def never_type() -> Column:
    return _object("never")


def callable_type() -> Column:
    return _object("callable")


def status_marker() -> Column:
    return _object("status_marker")


def unknown(reason: Column | str) -> Column:
    return _object("unknown", reason=_text(reason))


def class_type(fqcn: Column | str, args: Column | None = None) -> Column:
    return _object("class", fqcn=_text(fqcn), args=F.lit("[]") if args is None else _list(args))


def enum_type(fqcn: Column | str, cases: Column) -> Column:
    return _object("enum", fqcn=_text(fqcn), cases=F.to_json(cases))


def list_type(value: Column) -> Column:
    return _object("list", value=value)


def map_type(key: Column, value: Column) -> Column:
    return _object("map", key=key, value=value)


def keyed_array(key: Column, value: Column) -> Column:
    """Only keys that can be nothing but strings make a map; other keys make a list."""
    return F.when(key == scalar("string"), map_type(key, value)).otherwise(list_type(F.coalesce(value, unknown(REASONS["value"]))))


def kind_of(t: Column) -> Column:
    """The kind that a type's JSON text begins with; not parsed, for it is asked of every type many times."""
    return F.regexp_extract(t, r'^\s*\{\s*"kind"\s*:\s*"([^"]*)"', 1)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used; Spark repeats what a lambda names twice."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def members_of(t: Column) -> Column:
    """Members of a union, or the type itself."""
    return F.when(kind_of(t) == "union", F.from_json(F.get_json_object(t, "$.members"), "array<string>")).otherwise(F.array(t))


def union_of(types: Column) -> Column:
    """Flatten, drop repeats, order canonically with null last; one member stands alone."""
    order = lambda flat: F.concat(F.array_sort(F.filter(flat, lambda m: kind_of(m) != "null")), F.filter(flat, lambda m: kind_of(m) == "null"))
    one = lambda ordered: F.when(F.size(ordered) == 1, ordered[0]).otherwise(_object("union", members=_list(ordered)))
    return _let(_let(F.array_distinct(F.flatten(F.transform(types, members_of))), order), one)


def nullable(t: Column) -> Column:
    return union_of(F.array(t, null_type()))


def intersection_of(types: Column) -> Column:
    """Repeats go, a single survivor stands alone, none is unknown."""
    kept = F.array_sort(F.array_distinct(types))
    return F.when(F.size(kept) == 0, unknown("empty intersection")).when(F.size(kept) == 1, kept[0]).otherwise(_object("intersection", members=_list(kept)))


def shape(fields: Column, is_list: Column | bool = False) -> Column:
    """``fields`` is array<struct<key, type, optional>> in order."""
    is_list = F.lit(is_list) if isinstance(is_list, bool) else is_list
    one = lambda f: F.concat(F.lit('{"key":'), json_text(f["key"]), F.lit(',"type":'), f["type"], F.lit(',"optional":'), f["optional"].cast("string"), F.lit("}"))
    return _object("shape", fields=_list(F.transform(fields, one)), is_list=is_list.cast("string"))


def shape_fields(keys: Column, types: Column, optional_at: Column) -> Column:
    """Zip keys and types; a field is optional if its place is listed."""
    return F.transform(F.arrays_zip(keys.alias("k"), types.alias("t")), lambda x, i: F.struct(x["k"].alias("key"), x["t"].alias("type"), F.array_contains(optional_at, i).alias("optional")))


# ------------------------------------------------------------ translation


def constant_literal(strings: Column, scalars: Column) -> Column:
    """Exactly one constant string, else exactly one constant scalar (each as JSON), else null."""
    return F.when(F.size(strings) == 1, literal(strings[0])).when(F.size(scalars) == 1, literal(scalars[0]))


def translate_intersection(is_list: Column, value: Column, survivors: Column) -> Column:
    """List-ness is settled on the whole first; accessory types are no survivors; none left is unknown."""
    return F.when(is_list, list_type(value)).otherwise(intersection_of(survivors))


def translate_object(fqcn: Column, cases: Column, args: Column) -> Column:
    """P5: an enum has cases, all else is a class with its arguments."""
    return F.when(cases.isNotNull(), enum_type(fqcn, cases)).otherwise(class_type(fqcn, args))


def translate(f: dict[str, Column], depth: Column | None = None) -> Column:
    """The ordered cases of translation; the first that holds decides.

    ``f`` has boolean columns is_null, is_void, is_never, is_callable, is_int,
    is_string, is_float, is_bool (null counts as no) and, where they apply,
    finished types: literal, constant_array, union, intersection, bound,
    generic, single_class, array (null where they do not), and ``described``.
    """
    yes = lambda k: F.coalesce(f[k], F.lit(False))
    done = F.when(F.lit(False), F.lit(None).cast("string"))
    if depth is not None:
        done = done.when(depth >= TRANSLATION_DEPTH, unknown(REASONS["depth"]))
    for k, t in (("is_null", null_type()), ("is_void", void_type()), ("is_never", never_type())):
        done = done.when(yes(k), t)
    for k in ("literal", "constant_array", "union", "intersection", "bound", "generic", "single_class", "array"):
        done = done.when(f[k].isNotNull(), f[k])
    for k, t in (("is_callable", callable_type()), ("is_int", scalar("int")), ("is_string", scalar("string")), ("is_float", scalar("float")), ("is_bool", scalar("bool"))):
        done = done.when(yes(k), t)
    return done.otherwise(unknown(describe(f["described"])))


def describe(text: Column) -> Column:
    """P15."""
    return F.coalesce(text, F.lit("unresolved type"))


#: Declared type names and what they stand for.
NATIVE_SCALARS = {"int": "int", "string": "string", "float": "float", "bool": "bool", "true": "bool", "false": "bool"}
NATIVE_UNKNOWN = {"array": "untyped array", "iterable": "iterable", "object": "object", "mixed": "mixed", "self": "self", "static": "static", "parent": "parent"}


def native_named(name: Column, cases: Column) -> Column:
    """A declared name; ``cases`` of the enum it names, else null."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in NATIVE_SCALARS.items():
        out = out.when(name == k, scalar(v))
    out = out.when(name == "null", null_type()).when(name == "void", void_type()).when(name == "never", never_type())
    out = out.when(name.isin("callable", "Closure"), callable_type())
    for k, v in NATIVE_UNKNOWN.items():
        out = out.when(name == k, unknown(v))
    return out.otherwise(translate_object(name, cases, F.array().cast("array<string>")))


def native_type(name: Column, allows_null: Column, cases: Column) -> Column:
    """Null adds to the type unless it is null or mixed itself; no declaration is unknown."""
    named = native_named(name, cases)
    with_null = F.when(allows_null & ~name.isin("null", "mixed"), nullable(named)).otherwise(named)
    return F.when(name.isNull(), unknown(REASONS["undeclared"])).otherwise(with_null)


# ------------------------------------------------------------ predicates


def is_delegation(t: Column) -> Column:
    """a site that only hands on: void or null."""
    return kind_of(t).isin("void", "null")


def documentable_payload(t: Column) -> Column:
    """Void, never and unknown document nothing."""
    return F.when(~kind_of(t).isin("void", "never", "unknown"), t)


def precise(t: Column) -> Column:
    """nothing unknown anywhere in the union."""
    return _let(t, lambda x: F.when(x.isNotNull() & ~F.contains(x, F.lit("unknown")), F.lit(True)).otherwise(_precise(x)))


def _precise(t: Column) -> Column:
    return ~F.exists(members_of(t), lambda m: kind_of(m) == "unknown")


def parameterisable(t: Column) -> Column:
    """a class without arguments anywhere in the union."""
    return F.exists(members_of(t), lambda m: (kind_of(m) == "class") & (F.get_json_object(m, "$.args") == "[]"))


def parameterise(native: Column, written: Column) -> Column:
    """Give bare classes the arguments that the doc comment writes for the same class; nothing else changes."""
    fqcn = lambda t: F.get_json_object(t, "$.fqcn")
    bare = lambda m: (kind_of(m) == "class") & (F.get_json_object(m, "$.args") == "[]")
    given = F.filter(members_of(written), lambda w: (kind_of(w) == "class") & (F.get_json_object(w, "$.args") != "[]"))
    named = F.transform(given, lambda w: F.struct(fqcn(w).alias("fqcn"), w.alias("type")))
    first = lambda m, ws: _let(fqcn(m), lambda name: F.get(F.filter(ws, lambda w: w["fqcn"] == name), F.lit(0))["type"])
    full = _let(named, lambda ws: union_of(F.transform(members_of(native), lambda m: F.when(bare(m), F.coalesce(first(m, ws), m)).otherwise(m))))
    return F.when(~kind_of(native).isin("class", "union"), native).otherwise(full)


def property_type(native: Column, param_doc: Column, var_doc: Column) -> Column:
    """A precise native type stands, with the doc comment's arguments at most; a vague one
    gives way to the first precise written type, a promoted parameter's before the variable's."""
    written = _let(F.struct(param_doc.alias("param"), var_doc.alias("var")), lambda x: F.coalesce(F.when(precise(x["param"]), x["param"]), F.when(precise(x["var"]), x["var"])))
    kept = lambda x: F.when(parameterisable(x["native"]) & x["written"].isNotNull(), parameterise(x["native"], x["written"])).otherwise(x["native"])
    each = lambda x: F.when(x["native"].isNull(), F.coalesce(x["written"], unknown(REASONS["undeclared"]))).when(precise(x["native"]), kept(x)).otherwise(F.coalesce(x["written"], x["native"]))
    return _let(F.struct(native.alias("native"), written.alias("written")), each)
