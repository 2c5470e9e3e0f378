"""Mixing sources to target weights along a time-varying curriculum.

1. Sizes (words) are summed by source, with partial sums before the shuffle.
2. Targets: the mix's total is shared by weight; a source's target stops at
   ``max_repeats`` times its size and the excess is shared again by weight
   until none is above. That fixed point is ``min(cap, level * weight)`` for one
   level, found by a running sum over the sources in order of cap / weight.
3. Takes: each source takes every document ``floor(target / size)`` times and
   the rest of its target as a run of documents in an order given by a hash.
   Bins are the hash's leading bits, as many as keep about ``BIN_ROWS`` rows in
   one, so the order does not depend on them. The run's end and the words before
   each bin come from sums of bins, each bin is put in order by itself, and no
   source meets in one task. One copy more or less of the document that fits
   best then brings each source as near to its target as one document can.
4. Positions: a source's weight at time t of the run is
   ``start + (end - start) * t`` relative to its mean; its integral is a
   quadratic. A source's words are taken in rounds, each in the order of 3, so a
   document's k-th copy is met after ``k - 1`` rounds of the whole source and the
   words before it. Inverting the integral at the share of all words the source
   gives that lies before the copy's middle gives the copy's time, its training
   position; each copy has its own. Copies are range-sorted by it.

Defined results: null or blank texts have size 0 and are never taken; a null
source is a source of its own, last in order; the hash covers id, source and
text, so rows that repeat an id or have none are taken each by itself; an empty table gives an empty
result; other columns are kept by ``mix_documents`` and ignored by ``plan_mix``,
whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, fresh

WEIGHTS = (3, 1, 2)
EPOCH_SHARE = 1.5
MAX_REPEATS = 2
#: Ramp of a source's weight over the run, by its place in the weights: the
#: first declines, the second is steady, the third grows.
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: Rows of a source that a bin holds at most on average.
BIN_ROWS = 1 << 14
#: Bits of a bin at least.
MIN_BITS = 12


def word_count(text: Column) -> Column:
    """Number of maximal runs of bytes outside 0x20 and 0x09-0x0D."""
    blanks = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    # A word starts where a non-blank follows a blank or the beginning.
    return F.regexp_count(blanks, F.lit("[^ ]+")).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``sizes(source, source_size)`` with weight, ramp and target; a row for each source.

    The windows run over one row for each source, not over documents.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(w) - 1) % len(WEIGHTS)
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("place") + 1)
    rows = sizes.withColumn("place", place).select("source", "source_size", "place", pick(WEIGHTS).alias("weight"), pick(r[0] for r in RAMPS).alias("ramp0"), pick(r[1] for r in RAMPS).alias("ramp1"))
    rows = rows.withColumn("cap", MAX_REPEATS * F.col("source_size").cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total = EPOCH_SHARE * F.sum("source_size").over(everything).cast("double")
    # If this source is the first that stays under its cap, the level is what is
    # left after the caps before it, by the weights from it on.
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = left / weights
    rows = rows.withColumn("fit", F.when(level * F.col("weight") <= F.col("cap"), level))
    # The first source in this order that stays under its cap sets the level.
    level = F.min_by("fit", F.when(F.col("fit").isNotNull(), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source"))).over(everything)
    return rows.select("source", "source_size", "ramp0", "ramp1", F.least("cap", level * F.col("weight")).alias("target"))


def _hashed(docs: DataFrame, id_col: str, text_col: str, source_col: str, h: str, size: str) -> DataFrame:
    """Add the hash ``h``, in whose unsigned order a source is taken, and the size."""
    return docs.withColumn(h, F.xxhash64(id_col, source_col, text_col, F.lit("mix"))).withColumn(size, word_count(F.col(text_col)))


def _bin(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits).cast("int")


def _bins(sized: DataFrame) -> tuple[DataFrame, int]:
    """A row for each source (``s``) and bin (``b``) of sized(source, size, h): words before it, its source's numbers and totals; and the bits of a bin."""
    bits = max(MIN_BITS, (sized.count() // BIN_ROWS).bit_length())
    bins = sized.groupBy("source", _bin(F.col("h"), bits).alias("bin")).agg(F.sum("size").alias("bin_size"))
    targets = source_targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MAX_REPEATS))).otherwise(0)
    joined = bins.withColumnRenamed("source", "s").join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    in_order = Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    plan = joined.withColumn("whole", whole).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("before", F.coalesce(F.sum("bin_size").over(in_order), F.lit(0)))
    return plan.select("s", F.col("bin").alias("b"), "before", "source_size", "target", "whole", "part", "ramp0", "ramp1"), bits


def _takes(rows: DataFrame, plan: DataFrame, bits: int, source: Column, h: str, size: str) -> DataFrame:
    """Add the plan's columns, the words of the source ``from`` which a row begins, its copies and the words they take."""
    rows = rows.join(plan, source.eqNullSafe(F.col("s")) & (_bin(F.col(h), bits) == F.col("b")))
    # Words taken by documents of the bin up to this one; a bin is a small part of a source.
    inside = F.sum(size).over(Window.partitionBy("s", "b").orderBy(h).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("from", F.col("before") + F.coalesce(inside, F.lit(0)))
    # The document that the end falls in is taken if more than half of it lies within.
    extra = (F.col("from") + F.col(size) / 2 <= F.col("part")).cast("int")
    copies = F.when(F.col(size) > 0, F.least(F.col("whole") + extra, F.lit(MAX_REPEATS))).otherwise(0).cast("int")
    return rows.withColumn("copies", copies).drop("b", "before", "part")


def _settled(takes: DataFrame) -> DataFrame:
    """A row for each source: the one document (``m_hash``) whose copies change by ``step``, and the words the source then gives.

    Where the run ends inside a long document, one more or one less copy of another brings the source nearer to its target.
    """
    given = takes.groupBy(F.col("s").alias("t_source")).agg(F.sum(F.col("copies") * F.col("size")).alias("given"), F.first("target").alias("t_target"))
    by_hash = takes.where("size > 0").groupBy("s", "h").agg(F.sum("size").alias("words"), F.max("copies").alias("copies"), F.max("whole").alias("whole"))
    step = F.when(F.col("copies") > F.col("whole"), -1).when(F.col("copies") < MAX_REPEATS, 1).otherwise(0)
    after = by_hash.join(given, F.col("s").eqNullSafe(F.col("t_source"))).withColumn("step", step).withColumn("left", F.abs(F.col("t_target") - F.col("given") - F.col("step") * F.col("words")))
    best = after.groupBy("t_source").agg(F.min_by(F.struct("h", "step", "words", "given", "t_target", "left"), F.struct("left", "h")).alias("m"))
    better = F.col("m.left") < F.abs(F.col("m.t_target") - F.col("m.given"))
    return best.select("t_source", F.when(better, F.col("m.h")).alias("m_hash"), F.when(better, F.col("m.step")).otherwise(0).alias("step"), (F.col("m.given") + F.when(better, F.col("m.step") * F.col("m.words")).otherwise(0)).alias("total"))


def _settle(takes: DataFrame, settled: DataFrame, h: str, size: str) -> DataFrame:
    """Final copies and words taken, and the source's total."""
    out = takes.join(settled, F.col("s").eqNullSafe(F.col("t_source")), "left")
    step = F.when((F.col(h) == F.col("m_hash")) & (F.col(size) > 0), F.col("step")).otherwise(0)
    return out.withColumn("copies", (F.col("copies") + step).cast("int")).withColumn("taken", F.col("copies") * F.col(size))


def _positions(size: str) -> Column:
    """The training position of each copy: the integral of the source's weight, inverted at the words before the copy's middle."""
    # Integral of ramp0 + (ramp1 - ramp0) t over [0, t], by its value at 1: solve for t.
    a, b = (F.col("ramp1") - F.col("ramp0")) / 2, F.col("ramp0")

    def time(k: Column) -> Column:
        share = ((k - 1) * F.col("source_size") + F.col("from") + F.col(size) / 2) / F.col("total")
        need = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * (a + b)
        return F.when(a == 0, need / b).otherwise((F.sqrt(F.greatest(b * b + 4 * a * need, F.lit(0.0))) - b) / (2 * a))

    return F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(1), F.col("copies")), time)).otherwise(F.array().cast("array<double>"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: id, source, hash, size, source_size, target, copies, taken, position and positions.

    ``taken`` is ``copies * size``; ``positions`` has one for each copy, in
    order, and ``position`` is the first, null where nothing is taken.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    sized = checkpoint(_hashed(plain, "id", "text", "source", "h", "size").drop("text"))
    plan, bits = _bins(sized)
    rows = checkpoint(_takes(sized, plan, bits, F.col("source"), "h", "size"))
    rows = _settle(rows, _settled(rows), "h", "size")
    rows = rows.withColumn("positions", _positions("size")).withColumn("position", F.get("positions", F.lit(0)))
    return rows.select(F.col("id").alias(id_col), "source", "h", "size", "source_size", "target", "copies", "taken", "position", "positions")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as it is taken, each copy at its own position.

    Rows travel whole: once to their bins, which tells how often each is taken
    and where, and once to their positions.
    """
    cols = docs.columns
    inner = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(cols)])
    of = {c: f"c{k}" for k, c in enumerate(cols)}
    rows = _hashed(inner, of[id_col], of[text_col], of[source_col], "h", "size")
    sized = checkpoint(rows.select(F.col(of[source_col]).alias("source"), "h", "size"))
    plan, bits = _bins(sized)
    plan = checkpoint(plan)
    settled = checkpoint(_settled(_takes(sized, plan, bits, F.col("source"), "h", "size")))
    taken = _settle(_takes(rows.where("size > 0"), plan, bits, F.col(of[source_col]), "h", "size"), settled, "h", "size").where("copies > 0")
    out = taken.select(*of.values(), "h", F.explode(_positions("size")).alias("at")).orderBy("at", "h")
    return out.select(*[F.col(i).alias(c) for c, i in of.items()])
