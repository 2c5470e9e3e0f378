"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A document is a set of words weighted by how often they occur. For each of
``SLOTS`` slots and each word, gamma variates ``r`` and ``c`` and a uniform
``b`` are drawn from hashes of word and slot; with

    t = floor(ln(weight) / r + b),    ln(a) = ln(c) - r * (t - b + 1)

the slot's sample is the (word, t) with the least ``a``. Two documents agree in
a slot with a probability equal to their generalised Jaccard similarity,
sum(min(weights)) / sum(max(weights)), so the share of equal slots estimates it.

A slot is one long: the quantised ``ln(a)`` above, bits of word and ``t`` below,
so that the least sample is a plain ``min`` and keeps whole-stage code.

Defined results: null text counts as empty; texts without words have the empty
fingerprint, alike to itself only; a lone document is its own next; an empty
table gives an empty result; other columns are ignored; ids may be of any type
that sorts. ``fingerprint_rows``
gives a row for each row: documents are ordered by id, null last, then by the
text's SHA-256, and rows equal in id and text are one document with a row each.
``fingerprint_documents`` gives a row for each id: rows that repeat an id, or
have none, stand for one document, that of the shortest text (of equally short
ones, the least SHA-256).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

SLOTS = 16


def _slot(term: Column, log_weight: Column, i: int) -> Column:
    """The sample of one word in slot i, as an ordered long."""
    h1, h2 = F.xxhash64(term, F.lit(2 * i)), F.xxhash64(term, F.lit(2 * i + 1))
    part = lambda h, shift, bits: (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(0.5)) / F.lit(float(1 << bits))
    r = -F.log(part(h1, 0, 22) * part(h1, 22, 21))
    c = -F.log(part(h2, 0, 32) * part(h2, 32, 32))
    b = part(h1, 43, 21)
    t = F.floor(log_weight / r + b)
    log_a = F.log(c) - r * (t - b + 1)
    # ln(a) stays within -90 and 38: the hashes' bits bound r and c, and a word's count is below 2**31.
    order = F.floor((log_a + 90) * F.lit(float(1 << 24))).cast("long")
    return F.shiftleft(order, 31).bitwiseOR(F.xxhash64(term, t).bitwiseAND(F.lit((1 << 31) - 1)))


def _hex(slots: list[Column]) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(s), 16, "0") for s in slots]))


def _alike(a: list[Column], b: list[Column]) -> Column:
    same = [F.when(x == y, 1).otherwise(0) for x, y in zip(a, b)]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return total / F.lit(float(len(a)))


def _in_order(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` in range partitions ``pid`` by ``order``, made durable; no task holds more than its range."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpoint(rows.repartitionByRange(partitions, *order).withColumn("pid", F.spark_partition_id()))


def _neighbours(docs: DataFrame) -> DataFrame:
    """id, key, n, how often it stands there and the next key in ascending order, for each distinct key of docs(id, key, text).

    Only keys and lengths move. They are range-partitioned, each partition
    finds its own neighbours, and the partitions' first keys, a row each, link
    one partition to the next.
    """
    one = docs.groupBy("key").agg(F.first("id").alias("id"), F.first(F.length("text").cast("long")).alias("n"), F.count("*").alias("times"))
    ranged = _in_order(one, [F.col("key")])
    within = ranged.withColumn("next", F.lead("key").over(Window.partitionBy("pid").orderBy("key")))
    firsts = ranged.groupBy("pid").agg(F.min("key").alias("first"))
    after = F.lead("first").over(Window.orderBy("pid"))
    links = firsts.select(F.col("pid").alias("l_pid"), F.coalesce(after, F.min("first").over(Window.partitionBy())).alias("l_next"))
    return within.join(links, F.col("pid") == F.col("l_pid")).select("id", "key", "n", "times", F.coalesce("next", "l_next").alias("next"))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs(id, text) with a bigint ``key`` of the document: the id itself, or a rank by id and text where ids repeat or are null."""
    if docs.groupBy("id").agg(F.count("*").alias("n")).where("id is null or n > 1").isEmpty():
        return docs.withColumn("key", F.col("id"))
    digested = docs.withColumn("sha", F.sha2("text", 256))
    order = [F.col("id").asc_nulls_last(), F.col("sha")]
    ranged = _in_order(digested.select("id", "sha").distinct(), order)
    before = F.coalesce(F.sum("here").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy("pid").agg(F.count("*").alias("here")).select(F.col("pid").alias("s_pid"), before.alias("start"))
    rank = F.row_number().over(Window.partitionBy("pid").orderBy(*order))
    ranks = ranged.withColumn("rank", rank).join(starts, F.col("pid") == F.col("s_pid")).select(F.col("id").alias("r_id"), F.col("sha").alias("r_sha"), (F.col("start") + F.col("rank")).alias("key"))
    # The digest leads the join, so that rows without an id spread over all tasks.
    return digested.join(ranks, (F.col("sha") == F.col("r_sha")) & F.col("id").eqNullSafe(F.col("r_id"))).select("id", "text", "key")


def _selected(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """As ``fingerprint_rows``, with one row for each id."""
    row = F.row_number().over(Window.partitionBy("id").orderBy(F.length("text"), F.sha2("text", 256)))
    one = _selected(docs, id_col, text_col).withColumn("row", row).where("row = 1")
    return fingerprint_rows(one.select(F.col("id").alias(id_col), F.col("text").alias(text_col)), id_col, text_col, slots)


def fingerprint_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness, a row for each row of ``docs``.

    The edited text has its last quarter replaced by as many characters from the
    beginning of the next document (all, if it has fewer).
    """
    base = _keyed(_selected(docs, id_col, text_col))
    near = _neighbours(base)
    # Texts cross the network once, by key; each stage below reads that exchange.
    row = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    texts = base.select("key", "text").withColumn("row", row).where("row = 1").drop("row")
    asked = near.select(F.col("next").alias("a_key"), F.col("key").alias("for"), F.floor(F.col("n") / 4).cast("int").alias("q"))
    heads = texts.join(asked, F.col("key") == F.col("a_key")).select("for", "q", F.substring(F.col("text"), F.lit(1), F.col("q")).alias("head"))
    both = texts.join(heads, F.col("key") == F.col("for")).drop("for")
    left = F.length("text") - F.col("q")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), left), F.col("head"))
    meta = both.select(F.col("key").alias("m_key"), F.length("text").cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"))

    # Words of the part that both texts share, up to its last blank, are counted once for both.
    blank = F.translate("text", "\t\n\x0b\x0c\r", "     ")
    cut = both.select("key", blank.alias("b"), F.translate(edited, "\t\n\x0b\x0c\r", "     ").alias("e"), left.alias("left"))
    stop = F.when(F.locate(" ", F.reverse(F.substring(F.col("b"), F.lit(1), F.col("left")))) > 0, F.col("left") - F.locate(" ", F.reverse(F.substring(F.col("b"), F.lit(1), F.col("left")))) + 1).otherwise(0)
    cut = cut.withColumn("stop", stop.cast("int"))
    piece = lambda text, o, e: F.struct(text.alias("t"), F.lit(o).alias("o"), F.lit(e).alias("e"))
    rest = lambda c: F.substring(F.col(c), F.col("stop") + 1, F.length(c))
    pieces = F.array(piece(F.substring(F.col("b"), F.lit(1), F.col("stop")), 1, 1), piece(rest("b"), 1, 0), piece(rest("e"), 0, 1))
    words = cut.select("key", F.explode(pieces).alias("p")).select("key", F.col("p.o").alias("o"), F.col("p.e").alias("e"), F.explode(F.split("p.t", " ")).alias("w")).where("w != ''")
    counts = words.groupBy("key", F.xxhash64("w").alias("term")).agg(F.sum("o").alias("o"), F.sum("e").alias("e"))
    # Most words weigh the same in both texts and are sampled once.
    rows = counts.select("key", "term", (F.col("o") == F.col("e")).alias("same"), F.log(F.col("o").cast("double")).alias("lo"), F.log(F.col("e").cast("double")).alias("le"))
    aggs = []
    for i in range(slots):
        aggs += [
            F.min(F.when(F.col("same"), _slot(F.col("term"), F.col("lo"), i))).alias(f"s{i}"),
            F.min(F.when(~F.col("same") & F.col("lo").isNotNull(), _slot(F.col("term"), F.col("lo"), i))).alias(f"o{i}"),
            F.min(F.when(~F.col("same") & F.col("le").isNotNull(), _slot(F.col("term"), F.col("le"), i))).alias(f"e{i}"),
        ]
    sampled = rows.groupBy("key").agg(*aggs)
    slot = lambda i, own: F.coalesce(F.least(f"s{i}", f"{own}{i}"), F.lit(-1)).alias(f"f{i}" if own == "o" else f"g{i}")
    prints = meta.join(sampled, F.col("m_key") == F.col("key"), "left").select("m_key", "n_chars", "edited_sha256", *[slot(i, "o") for i in range(slots)], *[slot(i, "e") for i in range(slots)])
    prints = checkpoint(prints)

    f, g, h = ([F.col(f"{x}{i}") for i in range(slots)] for x in "fgh")
    following = prints.join(near.select(F.col("next").alias("n_key"), F.col("key").alias("for"), "id", "times"), F.col("m_key") == F.col("n_key")).select("for", "id", "times", *[F.col(f"f{i}").alias(f"h{i}") for i in range(slots)])
    # Rows equal in id and text were one document so far.
    return prints.join(following, F.col("m_key") == F.col("for")).withColumn("time", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))).select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", _hex(f).alias("fingerprint"), _hex(g).alias("edited_fingerprint"), _alike(f, g).alias("near_edited"), _alike(f, h).alias("near_next")
    )
