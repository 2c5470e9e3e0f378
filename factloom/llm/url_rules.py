"""URL filters: host-suffix and path-prefix expressions against a rule table.

Each URL becomes the list of all (host suffix, path prefix) expressions that a
rule could be written as. An expression's SHA-256 is cut to a short prefix for
the equi-join, as list providers publish them; the full digest then confirms
the hit and the longest confirmed rule decides.

Defined results
* null URL, or one without ``://``: host and path are empty, no rule fits;
* empty host (``file:///a``): path as written, no rule fits;
* empty URL table or rule table: empty result, or no rule for any URL;
* repeated rows: each row is judged by itself;
* a rule that is listed twice counts once; if both verdicts are listed for the
  same rule, ``block`` wins; rules with null host or path never fit;
* rules of equal length: the longer host wins;
* any other columns of either table are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of the digest that the equi-join compares.
PREFIX_DIGITS = 8
#: Verdict of the method where no rule fits: a URL filter lets through what no list names.
DEFAULT_VERDICT = "allow"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and every domain above it; none for an empty host."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    tails = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(tails)


def path_prefixes(path: Column, lengths: list[int]) -> Column:
    """The beginnings of the path that have the length of some rule's path."""
    all_lengths = F.array(*[F.lit(x) for x in lengths]) if lengths else F.array().cast("array<int>")
    fits = F.filter(all_lengths, lambda k: k <= F.length(path))
    return F.transform(fits, lambda k: F.substring(path, F.lit(1), k))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge each URL by ``rules(host, path, verdict)``.

    Returns id, host, path, rule (the winning rule's host and path, else null)
    and verdict. The lengths of rule paths are gathered first: one number for
    each length, of which a URL's limit on length leaves few. The rule side is
    joined by Spark's own choice, by broadcast only under its size threshold.
    """
    rules = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max(F.when(F.lower("verdict") == "block", "block").otherwise("allow")).alias("verdict"))
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    digest = lambda host, path: F.sha2(F.concat(host, F.lit("\n"), path), 256)
    listed = rules.select(
        digest(F.col("host"), F.col("path")).alias("r_digest"), F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict").alias("hit")
    ).withColumn("r_prefix", F.substring("r_digest", 1, PREFIX_DIGITS))

    urls = pages.select(F.col(id_col).alias("u_id"), host_of(F.col(url_col)).alias("u_host"), path_of(F.col(url_col)).alias("u_path"))
    # No rule fits an empty host; such URLs, maybe a third of all, meet in no task.
    hosted, bare = urls.where("u_host != ''"), urls.where("u_host = ''")
    # URLs with equal host and path share their verdict, so each is expanded once.
    distinct = hosted.select("u_host", "u_path").distinct()
    paths = F.explode(path_prefixes(F.col("u_path"), lengths)).alias("p")
    expressions = distinct.select("u_host", "u_path", paths).select("u_host", "u_path", "p", F.explode(host_suffixes(F.col("u_host"))).alias("h"))
    hashed = expressions.withColumn("digest", digest(F.col("h"), F.col("p"))).withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    hits = hashed.join(listed, F.col("prefix") == F.col("r_prefix")).where("digest = r_digest")
    best = hits.groupBy(F.col("u_host").alias("b_host"), F.col("u_path").alias("b_path")).agg(F.max("hit").alias("hit"))
    judged = hosted.join(best, (F.col("u_host") == F.col("b_host")) & (F.col("u_path") == F.col("b_path")), "left").select("u_id", "u_host", "u_path", "hit")
    return judged.unionByName(bare, allowMissingColumns=True).select(
        F.col("u_id").alias(id_col), F.col("u_host").alias("host"), F.col("u_path").alias("path"), F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(DEFAULT_VERDICT)).alias("verdict")
    )
