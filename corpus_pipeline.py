"""A corpus pipeline of five text operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of ``documents``.

Defined results beyond those of the operators: of each group of near copies one
row stays, the first by id (null last), then by the text's SHA-256, whatever ids
its rows share with rows of other groups; texts without words are copies of
nothing and all stay; a text that is wholly repeated stays as an empty text;
what the mix takes twice appears twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm import jaccard_join, mixing, piece_codec, suffix_dedup, toxicity
from factloom.llm.common import checkpoint, fresh, read_table
from factloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    model = toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    score = fresh("toxicity_score", docs.columns)
    return toxicity.score_toxicity(docs, model, docs.columns, name=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that with the smallest id."""
    key, row, bare, stays = (fresh(x, docs.columns) for x in ("row_key", "row_of_key", "without_words", "stay_key"))
    # Rows are told apart by id and text; those equal in both are copies of each other.
    parts = (F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    keyed = docs.withColumn(key, F.struct(*parts))
    found = jaccard_join.jaccard_components(keyed, id_col=key)
    stay = found.where(F.col(key) == F.col("component_id")).groupBy(F.col(key).alias(stays)).agg((F.max("n_shingles") == 0).alias(bare))
    one = F.row_number().over(Window.partitionBy(key).orderBy(*[c for c in docs.columns if c != "text"]))
    kept = keyed.join(stay, F.col(key) == F.col(stays)).withColumn(row, one)
    return kept.where((F.col(row) == 1) | F.col(bare)).select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that stand earlier in the corpus go from each text."""
    names = {c: f"doc_{k}" for k, c in enumerate(docs.columns)}
    others = [n for c, n in names.items() if c != "text"]
    inner = docs.select(*[F.col(c).alias(n) for c, n in names.items()])
    kept = suffix_dedup.remove_repeats(inner, names["doc_id"], names["text"], carry=others, texts=True)
    return kept.select(*[F.col("kept").alias("text") if c == "text" else F.length("kept").cast("long").alias("n_chars") if c == "n_chars" else F.col(n).alias(c) for c, n in names.items()])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as its source's target takes it."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each text of the mix."""
    return piece_codec.encode_documents(docs, tokenizer_path(), ["doc_id"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL expresses neither the trained models nor the suffix order nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is made durable before the next stage reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
