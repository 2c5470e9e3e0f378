"""Signature rules: the type of a call from its name, receiver and arguments.

``registry.signatures`` names the effect of each method; ``call_type`` applies
it. Where a rule does not hold the result is null and the declared type stands.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dtype

#: Classes that the rules produce.
MISSING = "Illuminate\\Http\\Resources\\MissingValue"
MERGED = "Illuminate\\Http\\Resources\\MergeValue"
RESPONSE = "Illuminate\\Http\\JsonResponse"
RESOURCE = "Illuminate\\Http\\Resources\\Json\\JsonResource"
RESOURCES = "Illuminate\\Http\\Resources\\Json\\ResourceCollection"
COLLECTION = "Illuminate\\Http\\Resources\\Json\\AnonymousResourceCollection"


def merged(shape: Column) -> Column:
    """Z3: the generic holder of a merged shape."""
    return dtype.class_type(MERGED, F.array(shape))


def response(payload: Column, status: Column) -> Column:
    """A response generic over payload and status; a third argument is only ever recovered."""
    return dtype.class_type(RESPONSE, F.array(payload, status))


def status_type(written: Column, known: Column, default: Column) -> Column:
    """The status as written, the default where provably nothing was, else any integer."""
    return F.when(written.isNotNull(), written).when(known, dtype.literal(default.cast("string"))).otherwise(dtype.scalar("int"))


def _single_class(t: Column) -> Column:
    return F.when(dtype.kind_of(t) == "class", F.get_json_object(t, "$.fqcn"))


def call_type(effect: Column, default_status: Column, call: dict[str, Column]) -> Column:
    """The type of a call by the effect of its signature.

    ``call`` has ``receiver`` (type), ``value``, ``default``, ``payload`` and
    ``status`` (types of arguments, null where none is written), ``status_known``,
    ``class_arg`` (a class name given as argument), ``inherited`` (the method is
    not overridden) and ``is_call`` (not a first-class callable).
    """
    value = F.coalesce(call["value"], dtype.null_type())
    default = F.coalesce(call["default"], dtype.class_type(MISSING))
    receiver = _single_class(call["receiver"])
    status = status_type(call["status"], call["status_known"], default_status)
    generic = lambda name, of: dtype.class_type(name, F.array(dtype.class_type(of)))
    out = F.when(effect == "value_or_marker", dtype.union_of(F.array(value, default)))
    out = out.when((effect == "merge") & call["value"].isNotNull(), merged(call["value"]))
    out = out.when((effect == "merge_or_marker") & call["value"].isNotNull(), dtype.union_of(F.array(merged(call["value"]), default)))
    out = out.when(effect == "unshaped", merged(dtype.map_type(dtype.scalar("string"), dtype.unknown("mixed"))))
    out = out.when((effect == "response") & call["payload"].isNotNull(), response(call["payload"], status))
    out = out.when(effect == "no_content", response(dtype.void_type(), status))
    out = out.when((effect == "of_receiver") & call["inherited"] & receiver.isNotNull(), dtype.class_type(RESPONSE, F.array(call["receiver"])))
    out = out.when((effect == "receiver") & call["inherited"] & receiver.isNotNull(), call["receiver"])
    out = out.when((effect == "collection_of_receiver") & receiver.isNotNull(), generic(COLLECTION, receiver))
    out = out.when(effect == "resource", dtype.class_type(F.coalesce(call["class_arg"], F.lit(RESOURCE))))
    out = out.when(effect == "collection", F.when(call["class_arg"].isNull(), dtype.class_type(RESOURCES)).otherwise(generic(COLLECTION, call["class_arg"])))
    return F.when(call["is_call"], out)
