"""Stages of the corpus pipeline, against brute force."""

import collections
import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline

from factloom.llm import mixing, queries, toxicity

from .fixtures import SCHEMA, clashing, near_copies, odd_rows
from .test_text_operators import WORD, _components, _kept, _passages, _toxic_corpus


def _one_of_each(rows):
    """Rows (id, text) that stay: the first of each group by id, null last, then digest; all without words."""
    texts = [(k, t) for k, (_, t) in enumerate(rows)]
    groups, out = collections.defaultdict(list), collections.Counter()
    for k, n, component in _components(texts):
        i, t = rows[k]
        if n:
            groups[component].append((i is None, i or 0, hashlib.sha256(t.encode()).hexdigest(), k))
        else:
            out[(i, t)] += 1
    return out + collections.Counter(rows[min(g)[3]] for g in groups.values())


def test_near_copies_with_repeated_and_null_ids(spark):
    rnd = random.Random(21)
    rows = [(rnd.choice([None, i, rnd.randrange(40)]), t) for i, t in near_copies(4)[:220]]
    clean = [(i, " ".join(f"c{k}x{n}" for n in range(12))) for k, i in enumerate([900, 900, None, None, 5, 5])]
    # One text of id 901 is by itself, the other is a near copy of id 7's.
    base = [f"z{n}" for n in range(60)]
    rows += clean + [(901, "a text that is a copy of nothing at all"), (901, " ".join(base)), (7, " ".join(base[:-1] + ["y"])), (None, " ".join(base)), (None, None), (900, "")]
    rows += rnd.sample(rows, 20)
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], SCHEMA).repartition(4)
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, df, "").collect())
    assert got == _one_of_each(rows)
    assert all((i, t) in got for i, t in clean) and got[(901, " ".join(base))] == 0 and got[(901, "a text that is a copy of nothing at all")] == 1


def test_near_copies_of_odd_and_empty_input(spark):
    df = clashing(spark.createDataFrame(odd_rows(), SCHEMA))
    kept = corpus_pipeline.drop_near_copies(spark, df, "")
    assert kept.columns == df.columns
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == _one_of_each([r[:2] for r in odd_rows()])
    assert corpus_pipeline.drop_near_copies(spark, df.limit(0), "").count() == 0


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder with documents of all kinds and their labels."""
    at = str(tmp_path_factory.mktemp("sf"))
    docs = _toxic_corpus(spark, 240).select("doc_id", "text", F.lit("en").alias("lang"), F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")).alias("source"))
    more = [(1000 + i, t, "en", "s1") for i, t in near_copies(9)[:60]] + [(2000 + i, t, "en", None) for i, t in _passages(6)[:40]] + odd_rows()
    docs = docs.unionByName(spark.createDataFrame(more, SCHEMA)).withColumn("n_chars", F.length("text").cast("bigint"))
    docs.write.parquet(f"{at}/documents.parquet")
    _toxic_corpus(spark, 240).select("doc_id", F.lit(1).alias("quality"), "toxic").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_input(spark, sf, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    df = clashing(spark.createDataFrame(odd_rows() + [(3, "a", "en", "s")], SCHEMA))
    for docs in (df, df.limit(0)):
        out = stage(spark, docs, sf)
        rows = out.collect()
        if name != "sentencepiece":
            assert out.columns == df.columns
        assert bool(rows) == (docs is df)


def test_toxicity_stage_drops_what_the_model_rejects(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, sf)
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = [(r.doc_id, t) for r in toxicity.score_toxicity(docs, model, ["doc_id", "text"]).collect() for t in [r.text] if r.score < toxicity.THRESHOLD]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    rejected = docs.count() - len(want)
    assert 40 <= rejected <= 80


def test_suffix_stage_keeps_the_rest_of_each_text(spark):
    rows = _passages(5)
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA + ", n_chars bigint")
    got = {r.doc_id: r for r in corpus_pipeline.drop_repeated_passages(spark, df, "").collect()}
    texts = dict(rows)
    for i, _, removed, _, sha in _kept(rows):
        r = got[i]
        assert r.n_chars == len(r.text)
        if not removed:
            assert r.text == (texts[i] or "")
        elif (texts[i] or "").isascii():
            assert hashlib.sha256(r.text.encode()).hexdigest() == sha


def test_mixing_stage_takes_the_plan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = collections.Counter()
    for r in corpus_pipeline.mix_sources(spark, docs, sf).collect():
        words[r.source] += len(WORD.findall(r.text or ""))
    plan = mixing.plan_mix(docs).groupBy("source").agg(F.sum("taken").alias("t")).collect()
    assert words == +collections.Counter({r.source: r.t for r in plan})


def test_last_stage_is_the_library(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    want = sorted((r.doc_id is None, r.doc_id or 0, len(library.encode(r.text or ""))) for r in docs.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in corpus_pipeline.encode(spark, docs, sf).collect()) == want


def test_run_is_its_stages_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, docs.collect()))
