"""Dimension tables: known throwers and call signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HTTP = "Symfony\\Component\\HttpKernel\\Exception\\HttpException"
AUTHORIZATION = "Illuminate\\Auth\\Access\\AuthorizationException"
MODEL_NOT_FOUND = "Illuminate\\Database\\Eloquent\\ModelNotFoundException"
VALIDATION = "Illuminate\\Validation\\ValidationException"

#: Fixed values: (kind, name, exception, status, argument that holds the status).
KNOWN_THROWERS = (
    ("function", "abort", HTTP, None, 0),
    ("function", "abort_if", HTTP, None, 1),
    ("function", "abort_unless", HTTP, None, 1),
    ("method", "authorize", AUTHORIZATION, 403, None),
    ("method", "authorizeForUser", AUTHORIZATION, 403, None),
    ("method", "findOrFail", MODEL_NOT_FOUND, 404, None),
    ("method", "firstOrFail", MODEL_NOT_FOUND, 404, None),
    ("method", "sole", MODEL_NOT_FOUND, 404, None),
    ("method", "validate", VALIDATION, 422, None),
)
REGISTRY_SCHEMA = "kind string, name string, ord int, exception string, fixed_status int, status_arg int"

#: Helpers whose value may be left out, and those that merge an array.
CONDITIONAL_ATTRIBUTES = ("when", "unless", "whenHas", "whenNull", "whenNotNull", "whenAppended", "whenLoaded", "whenCounted", "whenAggregated", "whenExistsLoaded", "whenPivotLoaded", "whenPivotLoadedAs")
MERGES = ("merge", "mergeWhen", "mergeUnless", "attributes")


def default_registry(spark: SparkSession) -> DataFrame:
    """Functions first, then methods, in order."""
    rows = [(k, n, i, e, s, a) for i, (k, n, e, s, a) in enumerate(KNOWN_THROWERS)]
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


def extend(registry: DataFrame, more: DataFrame) -> DataFrame:
    """Rows added behind; of equal (kind, name) the last wins and keeps the first's place."""
    both = registry.withColumn("batch", F.lit(0)).unionByName(more.withColumn("batch", F.lit(1)))
    w = Window.partitionBy("kind", "name")
    last = F.row_number().over(w.orderBy(F.desc("batch"), F.desc("ord")))
    place = F.min(F.struct("batch", "ord")).over(w)
    return both.withColumn("n", last).withColumn("place", place).where("n = 1").select("kind", "name", (F.col("place.batch") * 1000000 + F.col("place.ord")).cast("int").alias("ord"), "exception", "fixed_status", "status_arg")


def known_statuses(registry: DataFrame) -> DataFrame:
    """Exception to fixed status, the last entry wins; statuses read from an argument do not count."""
    return registry.where("fixed_status is not null").groupBy("exception").agg(F.max_by("fixed_status", "ord").alias("status"))


def signatures(spark: SparkSession) -> DataFrame:
    """Rules (name, effect) that type a call from its receiver and arguments.

    ``value_or_marker``: the value's type and a marker that it may be left out;
    ``merge`` and ``merge_or_marker``: the merged shape, held or held or left out;
    ``unshaped``: nothing known; ``response``: payload and status of a response;
    ``no_content``: void payload; ``of_receiver``: generic over the receiver's
    class; ``receiver``: the receiver itself; ``collection_of_receiver`` and
    ``resource`` / ``collection`` (class given, or found from the receiver).
    """
    rows = [(n, "value_or_marker", None) for n in CONDITIONAL_ATTRIBUTES]
    rows += [("merge", "merge", None), ("mergeWhen", "merge_or_marker", None), ("mergeUnless", "merge_or_marker", None), ("attributes", "unshaped", None)]
    rows += [("json", "response", 200), ("noContent", "no_content", 204), ("toResponse", "of_receiver", None), ("transform", "receiver", None)]
    rows += [("collection", "collection_of_receiver", None), ("newCollection", "collection_of_receiver", None), ("toResource", "resource", None), ("toResourceCollection", "collection", None)]
    return spark.createDataFrame(rows, "name string, effect string, default_status int")
