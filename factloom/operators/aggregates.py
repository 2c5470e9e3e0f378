"""Aggregation-like operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rank of a throw's confidence: a greater one replaces a lesser.
CONFIDENCE_RANK = {"Certain": 3, "Declared": 2, "Likely": 1}


def confidence_rank(c: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("int"))
    for k, v in CONFIDENCE_RANK.items():
        out = out.when(c == k, v)
    return out.otherwise(0)


def dedupe_throws(throws: DataFrame, group: list[str], rank: Column, order: list[str]) -> DataFrame:
    """A1: one throw for each (exception, status): the highest rank, the first seen of equals. A null status is a status."""
    w = Window.partitionBy(*group, "exception", "status").orderBy(rank.desc(), *order)
    return throws.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def result_order(group: list[str], name: str = "place") -> Column:
    """By status, null last, then exception."""
    return F.row_number().over(Window.partitionBy(*group).orderBy(F.col("status").asc_nulls_last(), "exception")).alias(name)


def dropped_count(points: DataFrame, group: list[str]) -> DataFrame:
    """A2: implicit throw points that nothing explained; explicit bare ones go uncounted."""
    return points.groupBy(*group).agg(F.count_if(~F.col("explicit") & ~F.col("explained")).alias("dropped"))


def truncation_count(steps: DataFrame, group: list[str]) -> DataFrame:
    """A3."""
    return steps.groupBy(*group).agg(F.count_if("truncated").alias("truncations"))


def lineage(files: DataFrame, group: list[str]) -> DataFrame:
    """The sorted distinct files of each analysis; no analysis sees another's."""
    return files.groupBy(*group).agg(F.array_sort(F.collect_set("file")).alias("files"))


def single_assignments(writes: DataFrame, keys: list[str]) -> DataFrame:
    """A5: the expression of a variable's only write; null if it has several, is retired by one, or its scope is opaque."""
    one = (F.count("*") == 1) & ~F.bool_or("retires") & ~F.bool_or("opaque")
    return writes.groupBy(*keys).agg(F.when(one, F.min("expr_id")).alias("expr_id"))


def opaque_scopes(writes: DataFrame) -> DataFrame:
    """A5: a scope with one opaque construct is opaque for all its variables."""
    return writes.withColumn("opaque", F.max("opaque").over(Window.partitionBy("file", "scope_key")))


def scope_opacity(writes: DataFrame) -> DataFrame:
    """A5: (file, scope_key, opaque), one row a scope, where the writes themselves are not asked for: one aggregation, nothing sorted."""
    return writes.groupBy("file", "scope_key").agg(F.max("opaque").alias("opaque"))


def unique_by_name(methods: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """An answer only where exactly one row has the key."""
    return methods.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias(name)).where("n = 1").drop("n")


def exactly_one(values: Column) -> Column:
    """A11."""
    return F.when(F.size(values) == 1, values[0])


def single_terminating(returns: DataFrame, keys: list[str], terminates: Column, value: Column) -> DataFrame:
    """The value of the only return of a body that always returns."""
    return returns.groupBy(*keys).agg(F.when((F.count("*") == 1) & F.bool_and(terminates), F.min(value)).alias("value"))


def truncation_diagnostics(counts: DataFrame, keys: list[str]) -> DataFrame:
    """One diagnostic for each analysis that was cut short."""
    return counts.where("truncations > 0").select(*keys, F.lit("Info").alias("severity"), F.lit("inference.response-shape-truncated").alias("code"), F.concat(F.col("truncations").cast("string"), F.lit(" response shapes were cut short")).alias("message"))


def class_dependencies(hierarchy: DataFrame, nested_enums: DataFrame, files: DataFrame) -> DataFrame:
    """Per class the distinct files of its hierarchy and of the enums nested in its properties at any depth."""
    f = files.select(F.col("class").alias("fc"), "file")
    named = hierarchy.select(F.col("sub").alias("class"), F.col("super").alias("on")).unionAll(nested_enums.select("class", F.col("enum").alias("on")))
    return named.join(f, F.col("on") == F.col("fc")).where("file is not null").groupBy("class").agg(F.array_sort(F.collect_set("file")).alias("files"))


def class_properties(properties: DataFrame) -> DataFrame:
    """A10: public non-static properties in order; a doc-comment property counts only if no real one has its name."""
    live = properties.where("not is_static")
    rank = F.when(F.col("source") == "reflection", 0).otherwise(1)
    w = Window.partitionBy("class", "name").orderBy(rank, "ord")
    kept = live.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    place = F.row_number().over(Window.partitionBy("class").orderBy(rank, "ord", "name")) - 1
    return kept.withColumn("ord", place.cast("int"))
