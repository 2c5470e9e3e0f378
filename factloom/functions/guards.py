"""Narrowing guards: boolean columns in disjunctive normal form.

A guard is array<array<string>>: alternatives, each a list of required classes.
The empty guard is true when it is evaluated, names nothing exactly, is
neutral in a conjunction and absorbs in a disjunction.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

GUARD = "array<array<string>>"


def no_guard() -> Column:
    return F.array().cast(GUARD)


def satisfied_by(guard: Column, narrowed: Column, supers: Column) -> Column:
    """whether a value of class ``narrowed`` (with all its ``supers``) can pass."""
    is_a = lambda c: (c == narrowed) | F.coalesce(F.array_contains(supers, c), F.lit(False))
    return (F.size(guard) == 0) | F.exists(guard, lambda alt: F.forall(alt, is_a))


def names_exactly(guard: Column, narrowed: Column) -> Column:
    """whether some alternative names the class itself."""
    return F.exists(guard, lambda alt: F.array_contains(alt, narrowed))


def all_of(left: Column, right: Column) -> Column:
    """Every pairing of alternatives; an empty side changes nothing."""
    pairs = F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.array_distinct(F.concat(a, b)))))
    return F.when(F.size(left) == 0, right).when(F.size(right) == 0, left).otherwise(pairs)


def any_of(left: Column, right: Column) -> Column:
    """Alternatives of both; an empty side makes it all empty."""
    return F.when((F.size(left) == 0) | (F.size(right) == 0), no_guard()).otherwise(F.concat(left, right))


def of_union(classes: Column) -> Column:
    """U3 for a union: an alternative for each class; a member that is no class (null) adds nothing."""
    return F.transform(F.filter(classes, lambda c: c.isNotNull()), lambda c: F.array(c))


def of_intersection(classes: Column) -> Column:
    """U3 for an intersection: one alternative that requires all."""
    kept = F.array_distinct(F.filter(classes, lambda c: c.isNotNull()))
    return F.when(F.size(kept) == 0, no_guard()).otherwise(F.array(kept))


def of_type(t: Column) -> Column:
    """The guard that a type (JSON) is: a class requires itself; a type that is none claims nothing."""
    kind, fqcn = F.get_json_object(t, "$.kind"), lambda m: F.when(F.get_json_object(m, "$.kind") == "class", F.get_json_object(m, "$.fqcn"))
    classes = F.transform(F.from_json(F.get_json_object(t, "$.members"), "array<string>"), fqcn)
    return F.when(kind == "class", F.array(F.array(fqcn(t)))).when(kind == "union", of_union(classes)).when(kind == "intersection", of_intersection(classes)).otherwise(no_guard())


def _dnf(node: dict | None) -> list[list[str]]:
    kind = (node or {}).get("op")
    if kind == "instanceof":
        return [[node["class"]]]
    if kind not in ("and", "or"):
        return []  # a negation or an unknown condition claims nothing
    sides = [_dnf(x) for x in node["args"]]
    out = sides[0] if sides else []
    for side in sides[1:]:
        if kind == "and":
            out = [list(dict.fromkeys(a + b)) for a in out for b in side] if out and side else out or side
        else:
            out = out + side if out and side else []
    return out


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def condition_guard(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """U4: a condition tree as JSON to a guard. Arrow batches: the tree nests without bound."""
    for s in batches:
        yield s.map(lambda t: _dnf(json.loads(t)) if t else [])


def arm_guard(condition_guards: Column, is_default: Column) -> Column:
    """U4: the conditions of one arm alternate; one that claims nothing makes the arm's guard empty."""
    open_ = F.exists(condition_guards, lambda g: F.size(g) == 0)
    return F.when(is_default | open_, no_guard()).otherwise(F.flatten(condition_guards))
