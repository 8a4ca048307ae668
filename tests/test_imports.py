"""Literal cases of numbered sets and usable metadata."""

from pyspark.sql import functions as F

from tessera.operators import imports as I

SETS = {
    "whole": ([("x (1 Of 2).mp3", 1.0), ("x (2 Of 2).mp3", 1.0)], ("complete", 0, 0)),
    "sparse": ([("x 01 of 04.mp3", 1.0), ("x 03 of 04.mp3", 1.0)], ("incomplete", 2, 0)),
    "broken": ([("x_01_03.mp3", 1.0), ("x_02_03.mp3", None), ("x_03_03.mp3", 1.0)], ("incomplete", 0, 1)),
    "volume": ([("Book_6_01.mp3", 1.0), ("Book_6_02.mp3", 1.0)], ("unnumbered", 0, 0)),
    "single": ([("Book_6_01.m4b", 1.0)], ("unnumbered", 0, 0)),
    "series": ([("Book_1_02.mp3", 1.0), ("Book_1_03.mp3", 1.0)], ("unnumbered", 0, 0)),
    "totals": ([("x 1 of 2.mp3", 1.0), ("x 2 of 3.mp3", 1.0)], ("conflicting_totals", 0, 0)),
    "twice": ([("x 1 of 2.mp3", 1.0), ("a/x 1 of 2.mp3", 1.0), ("x 2 of 2.mp3", 1.0)], ("duplicates", 0, 0)),
    "invalid": ([("x 3 of 2.mp3", 1.0)], ("invalid", 0, 0)),
    "mixed": ([("x 1 of 2.mp3", 1.0), ("whole.mp3", 1.0)], ("unnumbered", 0, 0)),
}


def test_numbered_sets(spark):
    files = spark.createDataFrame([(k, p, d) for k, (ps, _) in SETS.items() for p, d in ps], "group_key string, relative_path string, duration double")
    assert {r.group_key: (r.state, r.missing, r.unreadable) for r in I.numbered_sets(files).collect()} == {k: w for k, (_, w) in SETS.items()}
    assert I.numbered_sets(files.where("false")).count() == 0


def test_usable(spark):
    rows = [
        ("Dune", ["Frank Herbert"], None, True), ("Dune", ["dune"], None, False), ("Untitled", ["A B"], None, False), (None, ["A B"], None, False), ("Dune", [], None, False), ("Dune", None, None, False),
        ("Dune", ["Unknown Author"], None, False), ("Dune", ["A B", None], None, False), ("Dune", ["Disc 1"], None, False), ("Dune", ["Saga [x]"], None, False), ("Dune", ["The Saga"], "the saga", False), ("Dune", ["Lord of All"], None, False), ("Dune", ["Some Press"], None, False),
    ]
    out = spark.createDataFrame(rows, "t string, a array<string>, s string, want boolean").select("want", I.usable(F.col("t"), F.col("a"), F.col("s")).alias("got")).collect()
    assert [r.got for r in out] == [r.want for r in out]
    assert [r[0] for r in spark.createDataFrame([("Café",), ("薬屋",), ("12",), (None,)], "t string").select(I.latin(F.col("t"))).collect()] == [True, False, True, True]
