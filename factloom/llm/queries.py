"""The registered query of each text operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, fingerprints, jaccard_join, language_id, media, mixing, piece_codec, suffix_dedup, toxicity, url_rules
from .common import read_table

#: (host, path, verdict)
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Place of a public tokenizer file; the files come with their own package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _fold(divisor: int, rest: int) -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor == rest, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(docs, labels.where(~_fold(4, 2)))
    scored = toxicity.score_toxicity(docs, model, ["doc_id"])
    return scored.select("doc_id", _fold(4, 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = chat_format.format_chats(read_table(spark, sf_dir, "conversations"))
    return chats.select("conv_id", "turn", "part", "role", "opens", "closes", F.length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(read_table(spark, sf_dir, "pages"), rules)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_path(), ["doc_id"])


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(read_table(spark, sf_dir, "documents"))
    return plan.orderBy(F.col("position").asc_nulls_last(), "h").select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "position", "positions")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.fit_language(docs.where(~_fold(3, 1)))
    return language_id.predict_language(docs, model, ["doc_id"]).select("doc_id", _fold(3, 1).alias("held_out"), "lang_pred", "score")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_rows(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_chat_format, op3_url_filters, op4_sentencepiece, op5_media_columns, op6_mixing, op7_jaccard_join, op8_suffix_dedup, op9_language_id, op10_fingerprints)
}

SQL: dict[str, str] = {
    "op3_url_filters": r"""
WITH rules(r_host, r_path, r_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), judged AS (
  SELECT p.page_id, p.host, p.path, r_host || r_path AS rule, r_verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r_host) + length(r_path) DESC NULLS LAST, length(r_host) DESC) AS place
  FROM parts p LEFT JOIN rules ON (p.host = r_host OR ends_with(p.host, '.' || r_host)) AND starts_with(p.path, r_path)
)
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM judged WHERE place = 1
""",
}
