"""Stages act on rows, not on ids: shared and missing ids, equal rows, and columns named like the operators' own."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language, line_dedup, mixing, ngram_join

SF = "/root/testdata/sf0.001"
CLASH = ["id", "digest", "row", "copies", "mix_nth", "lang_pred", "score", "whole", "key", "class", "first", "hit_id", "kept", "rest", "tessera_raw", "tessera_ok", "node"]
A, B = (" ".join(f"{w}{i}" for i in range(30)) for w in ("one", "two"))


def texts(frame):
    return sorted(((r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()), key=str)


def test_links_of_missing_ids(spark):
    docs = spark.createDataFrame([(1, A), (None, A), (None, B), (5, B), (7, None), (None, " ")], "doc_id long, text string")
    out = sorted(map(tuple, ngram_join.ngram_join(docs).collect()), key=str)
    assert out == sorted([(1, 1, 1), (None, 1, 1), (None, 5, 1), (5, 5, 1), (7, 7, 0), (None, None, 0)], key=str)
    assert texts(ngram_join.stage(spark, docs, SF)) == sorted([(1, A), (5, B), (7, None), (None, " ")], key=str)


def test_one_of_a_class_stays(spark):
    docs = spark.createDataFrame([(1, A), (2, A), (2, B), (2, B), (3, A + " more")], "doc_id long, text string")
    assert texts(ngram_join.stage(spark, docs, SF)) == [(1, A), (2, B)]


@pytest.mark.parametrize("index_bytes", [1 << 20, -1])
def test_clean_rows_of_a_hit_id_stay(spark, index_bytes):
    docs = spark.createDataFrame([(1, A), (2, A), (2, B), (None, A), (None, B), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(A.split()[5:16]))], "item_id long, text string")
    assert texts(decontaminate.clean(docs, bench, index_bytes)) == sorted([(2, B), (None, B), (3, None)], key=str)


@pytest.mark.parametrize("index_bytes", [1 << 20, -1])
def test_items_without_id_hit(spark, index_bytes):
    docs = spark.createDataFrame([(1, A)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, A), (4, " ".join(A.split()[:10]))], "item_id long, text string")
    row = decontaminate.decontaminate(docs, bench, index_bytes).first()
    assert (row.n_hit, row["items"]) == (30, ["4"])


def test_mix_keeps_sources_apart(spark):
    """One text and id in several sources: every source's words are those that the mix takes of it."""
    rows = [(k % 4, f"text {k % 4} of some words", f"s{k % 3}") for k in range(60)] + [(None, "no id", None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = lambda t: len(t.split())
    mixed = {r.place: r.taken for r in mixing.mix(docs).groupBy("place").agg(F.sum("taken").alias("taken")).collect()}
    took = Counter()
    for r in mixing.stage(spark, docs, SF).collect():
        took[r.source] += size(r.text)
    place = {s: k for k, s in enumerate(["s0", "s1", "s2", None], 1)}
    assert {place[s]: n for s, n in took.items()} == mixed
    again = [tuple(r) for r in mixing.stage(spark, docs, SF).collect()]
    assert sorted(again, key=str) == sorted((tuple(r) for r in mixing.stage(spark, docs, SF).collect()), key=str)


@pytest.fixture(scope="module")
def clashing(spark):
    plain = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    return plain.withColumns({c: F.lit("own") for c in CLASH}).withColumn("tags", F.create_map(F.lit("a"), F.lit(1)))


@pytest.mark.parametrize("module", [language, line_dedup, ngram_join, decontaminate, mixing])
def test_clashing_columns_and_empty_tables(spark, clashing, module):
    out = module.stage(spark, clashing, SF)
    assert out.columns == clashing.columns and out.count() > 0
    assert out.where(" or ".join(f"{c} <> 'own'" for c in CLASH)).count() == 0
    none = module.stage(spark, clashing.where("false"), SF)
    assert none.columns == clashing.columns and none.count() == 0
