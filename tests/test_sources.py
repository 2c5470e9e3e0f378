"""Caches of derived tables, generated configurations, signature rules and guards that types make."""

import json

from pyspark.sql import functions as F

from factloom import registry
from factloom.functions import dtype, guards, scalars, signatures
from factloom.sources import facts


def test_cache_drops_everything_when_it_is_full_or_stale(spark):
    made = []

    def make(name, n):
        return lambda: made.append(name) or spark.range(n)

    cache = facts.FactCache(most_rows=10)
    assert cache.get(1, "a", make("a", 4)).count() == 4 and cache.get(1, "a", make("a", 4)).count() == 4 and made == ["a"]
    cache.get(1, "b", make("b", 5))
    assert set(cache.kept) == {"a", "b"} and cache.rows == 9
    cache.get(1, "c", make("c", 3))
    assert set(cache.kept) == {"c"}
    assert cache.get(1, "huge", make("huge", 11)).count() == 11 and not cache.kept
    cache.get(1, "a", make("a", 4))
    cache.get(2, "b", make("b", 1))
    assert set(cache.kept) == {"b"}
    # A table made while another is being made is not kept.
    cache.get(2, "outer", lambda: cache.get(2, "inner", make("inner", 2)))
    assert set(cache.kept) == {"b", "outer"}


def test_configuration_round_trip(spark, tmp_path):
    (tmp_path / "stubs").mkdir()
    for n in ("b.stub", "a.stub", "c.txt"):
        (tmp_path / "stubs" / n).write_text("x")
    stubs = facts.stub_files(spark, str(tmp_path / "stubs")).select(F.lit("stubFiles").alias("section"), F.col("file").alias("value"))
    rows = stubs.unionByName(spark.createDataFrame([("parameters", "it's 8.4"), ("includes", "user.neon"), ("includes", "user.neon"), ("includes", None), ("other", "z")], "section string, value string"))
    at = str(tmp_path / "generated")
    facts.write_config(rows, at)
    text = "".join(p.read_text() for p in sorted((tmp_path / "generated").glob("part-*")))
    assert text.replace(str(tmp_path), "") == "includes:\n    - 'user.neon'\nstubFiles:\n    - '/stubs/a.stub'\n    - '/stubs/b.stub'\nparameters:\n    - 'it''s 8.4'\nother:\n    - 'z'\n"
    back = {(r.section, r.value) for r in facts.read_config(spark, at).collect()}
    assert back == {tuple(r) for r in rows.where("value is not null").collect()}
    assert facts.read_config(spark, str(tmp_path / "none")).count() == 0


def test_every_signature_has_an_effect_that_acts(spark):
    text = F.lit(None).cast("string")
    call = {"receiver": dtype.class_type("Page"), "value": dtype.scalar("int"), "default": text, "payload": dtype.scalar("int"), "status": text, "status_known": F.lit(True), "class_arg": text, "inherited": F.lit(True), "is_call": F.lit(True)}
    rules = registry.signatures(spark)
    got = {r.name: json.loads(r.t) for r in rules.select("name", signatures.call_type(F.col("effect"), F.col("default_status"), call).alias("t")).collect()}
    assert len(got) == 24 and got["when"]["kind"] == "union" and got["json"]["args"][1] == {"kind": "literal", "value": 200} and got["noContent"]["args"][0] == {"kind": "void"}
    assert got["newCollection"]["args"] == [{"kind": "class", "fqcn": "Page", "args": []}] and got["transform"]["fqcn"] == "Page"
    spread = {**call, "status_known": F.lit(False), "payload": text}
    got = {r.name: r.t for r in rules.select("name", signatures.call_type(F.col("effect"), F.col("default_status"), spread).alias("t")).collect()}
    assert got["json"] is None and json.loads(got["noContent"])["args"][1] == {"kind": "scalar", "name": "int"}


def test_types_as_guards(spark):
    a, b = dtype.class_type("A"), dtype.class_type("B")
    kinds = [a, dtype.union_of(F.array(a, b, dtype.null_type())), dtype.intersection_of(F.array(a, b)), dtype.scalar("int")]
    assert list(spark.range(1).select(*[guards.of_type(t).alias(f"g{k}") for k, t in enumerate(kinds)]).first()) == [[["A"]], [["A"], ["B"]], [["A", "B"]], []]


def test_equal_items_of_an_array_literal_count_once(spark):
    item = F.struct(F.lit("k").alias("key"), F.struct(F.lit("p").alias("param"), F.lit("Identity").alias("kind"), F.lit(None).cast("string").alias("method")).alias("accessor"))
    assert spark.range(1).select(scalars.provenance_from_array(F.array(item, item))["k"]["param"]).first()[0] == "p"
