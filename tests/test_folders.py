"""Literal cases of folders and merged records."""

from pyspark.sql import functions as F

from tessera.operators import folders as O


def test_canonical_folder(spark):
    rows = [("a", "X", True), ("a", "x", True), ("a", "x", None), ("b", "Y", False), ("b", "Z", False), ("c", None, True), ("d", "q", None), ("d", "r", True)]
    out = O.canonical_folder(spark.createDataFrame(rows, "k string, f string, now boolean"), "k", "f", F.col("now"))
    assert sorted(map(tuple, out.collect())) == [("a", "x"), ("b", "Y"), ("d", "r")]


def test_removal_order(spark):
    rows = [("a",), ("a/b",), ("a/_b",), (".x/c",), ("b/c/d",), ("a//b",), ("a/../b",), ("",), (None,)]
    assert [r.p for r in O.removal_order(spark.createDataFrame(rows, "p string"), "p").collect()] == ["b/c/d", "a/b", "a"]


def test_merge_records(spark):
    records = spark.createDataFrame([("a", "done", ["1"]), ("b", "done", ["1", "2"]), ("c", "new", None), ("d", "new", [])], "k string, state string, alternates array<string>")
    merges = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "nowhere"), ("nobody", "a")], "k string, into string")
    out = {r.k: (r.state, r.alternates) for r in O.merge_records(records, merges, "k").collect()}
    assert out == {"a": ("done", ["1", "2", "b", "c"]), "b": ("superseded", []), "c": ("superseded", []), "d": ("new", [])}
    assert {r.k: r.alternates for r in O.merge_records(records, merges.where("false"), "k").collect()} == {"a": ["1"], "b": ["1", "2"], "c": [], "d": []}
