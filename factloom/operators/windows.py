"""Ordering, first and range-window operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import guards, scalars


def narrowed_sites(sites: DataFrame, keys: list[str], narrowed: Column, supers: Column) -> DataFrame:
    """Sites a value of the class can reach, in source order, with ``exact``."""
    live = sites.where(guards.satisfied_by(F.col("guard"), narrowed, supers))
    return live.withColumn("exact", guards.names_exactly(F.col("guard"), narrowed))


def choose_site(sites: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first site that is exact or does not delegate, else the first."""
    w = Window.partitionBy(*keys).orderBy(F.when(F.col("exact") | ~F.col("delegates"), 0).otherwise(1), *order)
    return sites.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def ambiguity(sites: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """An exact choice among several exact sites, or a broad one where an exact site exists."""
    exact = sites.groupBy(*[F.col(k).alias(f"x_{k}") for k in keys]).agg(F.count_if("exact").alias("n_exact"))
    on = [F.col(k) == F.col(f"x_{k}") for k in keys]
    joined = chosen.join(exact, on)
    return joined.withColumn("ambiguous", F.when(F.col("exact"), F.col("n_exact") > 1).otherwise(F.col("n_exact") > 0)).drop(*[f"x_{k}" for k in keys], "n_exact")


def first_documentable(returns: DataFrame, keys: list[str]) -> DataFrame:
    """The first return that refines to something and does not delegate, else the first delegation."""
    w = Window.partitionBy(*keys).orderBy(F.when(~F.col("delegates"), 0).otherwise(1), "ord")
    return returns.where("documentable or delegates").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def first_initialisers(writes: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The first write of each variable; later ones never retire it."""
    return writes.groupBy(*keys).agg(F.min_by("expr_id", order).alias("expr_id"))


def last_between(rows: DataFrame, keys: list[str], is_bound: Column, is_value: Column, pos: Column, value: Column, name: str) -> DataFrame:
    """The last value strictly after the last bound, if any bound or none is there (then -1)."""
    w = Window.partitionBy(*keys)
    bound = F.coalesce(F.max(F.when(is_bound, pos)).over(w), F.lit(-1))
    return rows.withColumn("lower", bound).where(is_value & (pos > F.col("lower"))).groupBy(*keys).agg(F.max_by(value, pos).alias(name))


def content_types(returns: DataFrame, assignments: DataFrame, headers: DataFrame) -> DataFrame:
    """Per return the last literal content-type header written to its variable between the last assignment and the return.

    ``returns(return_id, scope_key, var, pos)``, ``assignments(scope_key, var, pos)``,
    ``headers(scope_key, var, pos, header, value)``.
    """
    a = assignments.select(F.col("scope_key").alias("ak"), F.col("var").alias("av"), F.col("pos").alias("ap"))
    low = returns.join(a, (F.col("scope_key") == F.col("ak")) & (F.col("var") == F.col("av")) & (F.col("ap") < F.col("pos")), "left").groupBy("return_id", "scope_key", "var", "pos").agg(F.coalesce(F.max("ap"), F.lit(-1)).alias("low"))
    h = headers.where((F.lower("header") == "content-type") & F.col("value").isNotNull()).select(F.col("scope_key").alias("hk"), F.col("var").alias("hv"), F.col("pos").alias("hp"), "value")
    on = (F.col("scope_key") == F.col("hk")) & (F.col("var") == F.col("hv")) & (F.col("hp") > F.col("low")) & (F.col("hp") < F.col("pos"))
    return low.join(h, on, "left").groupBy("return_id").agg(F.max_by("value", "hp").alias("content_type"))


def descend_order(calls: DataFrame, keys: list[str], callee: list[str]) -> DataFrame:
    """Callees in order of their first call."""
    first = calls.groupBy(*keys, *callee).agg(F.min(F.struct(scalars.source_order(F.col("pos")).alias("pos"), "ord")).alias("first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("first", *callee))).drop("first")


def outermost(rows: DataFrame, keys: list[str], value: Column, order: Column, name: str, nulls: bool = False) -> DataFrame:
    """The value declared at the outermost level; with ``nulls`` the first row speaks even if it says nothing."""
    live = rows if nulls else rows.where(value.isNotNull())
    return live.groupBy(*keys).agg(F.min_by(F.struct(value.alias("v")), order).alias("x")).select(*keys, F.col("x.v").alias(name))


def stamp_entry(sites: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """The analysed callable's own component overrides that of all its sites."""
    e = entries.select(*[F.col(k).alias(f"e_{k}") for k in keys], F.col("component").alias("own"))
    out = sites.join(e, [F.col(k) == F.col(f"e_{k}") for k in keys], "left")
    return out.withColumn("component", F.coalesce("own", "component")).drop("own", *[f"e_{k}" for k in keys])


def arms_of(sites: DataFrame, value: str = "type") -> DataFrame:
    """A site whose value is a match is a site for each arm, with the arm's place, value and guard; the default's guard is empty."""
    arm = sites.where("arms is not null").select(*[c for c in sites.columns if c not in ("arms", "pos", value, "guard", "ord")], F.posexplode("arms").alias("arm_at", "arm"), "ord")
    arm = arm.withColumn("pos", F.col("arm.pos")).withColumn(value, F.col(f"arm.{value}")).withColumn("guard", F.when(F.col("arm.is_default"), guards.no_guard()).otherwise(F.col("arm.guard")))
    plain = sites.where("arms is null").withColumn("arm_at", F.lit(-1)).drop("arms")
    return plain.unionByName(arm.drop("arm"))
