"""Checks of outputs, names and paths, with nulls and empty lists."""

from pyspark.sql import functions as F

from tessera.operators import checks as C


def test_output_problems(spark):
    fine = {"codec": "aac", "duration": 100.0, "chapters": 2, "titles": ["a tale"], "authors": ["ann ash oak"], "want_duration": 104.0, "want_chapters": 2, "want_title": "a tale", "want_authors": ["ash"]}
    cases = [({}, None), ({"codec": "mp3"}, "not readable AAC audio"), ({"duration": None}, "not readable AAC audio"), ({"want_duration": 110.0}, "duration differs"), ({"want_duration": 0.0}, "duration differs"), ({"chapters": None}, "chapter count differs"), ({"want_title": ""}, "embedded title differs"), ({"titles": None}, "embedded title differs"), ({"want_authors": []}, "embedded author differs"), ({"authors": [""]}, "embedded author differs"), ({"want_authors": ["as"]}, "embedded author differs")]
    schema = "n int, codec string, duration double, chapters int, titles array<string>, authors array<string>, want_duration double, want_chapters int, want_title string, want_authors array<string>"
    rows = spark.createDataFrame([(n, *(fine | c).values()) for n, (c, _) in enumerate(cases)], schema)
    assert {r.n: r.p for r in rows.select("n", C.output_problem().alias("p")).collect()} == {n: p for n, (_, p) in enumerate(cases)}
    assert rows.where("n = 0").select(C.output_problem(False)).first()[0] == "embedded author differs"


def test_names_and_paths(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(C.name_like(F.lit(t))) for t in ("Ann Ash", "the Ann", "Ann", "ann ash", "Ann Audio Books", "A B C D E F")] == [True, False, False, False, False, False]
    keys = F.array(F.lit("books"), F.lit("ann ash collected"))
    assert one(C.path_supports(F.lit("Bo Birch & Ann Ash"), keys)) and not one(C.path_supports(F.lit("Ann As"), keys))
    assert one(C.inside(F.lit("/a/b/c"), F.lit("/a/b/"))) and not one(C.inside(F.lit("/a/bc"), F.lit("/a/b"))) and not one(C.inside(F.lit("/a/b/../c"), F.lit("/a/b")))
    assert one(C.title_in_path(F.lit("The Tale!"), F.lit("A/The Tale/01.mp3"))) and not one(C.title_in_path(F.lit("Tale"), F.lit("A/The Tale/01.mp3"))) and not one(C.title_in_path(F.lit(""), F.lit("x.mp3")))


def test_canonical_source(spark):
    rows = spark.createDataFrame([(["A/t.m4b"], "A/t.m4b", ["t"], ["a"], "t", ["a"], None, None), (["A/t.m4b"], "A/t.m4b", ["t"], ["a"], "t", ["a"], "s", None), (["A/t.m4b", "x"], "A/t.m4b", ["t"], ["a"], "t", ["a"], None, None), (["B/t.m4b"], "A/t.m4b", ["t"], ["a"], "t", ["a"], None, None), (["A/t.m4b"], "A/t.m4b", ["t"], None, "t", [], None, None)], "files array<string>, planned string, titles array<string>, authors array<string>, want_title string, want_authors array<string>, want_series string, grouping string")
    assert [r[0] for r in rows.select(C.canonical_source()).collect()] == [True, False, False, False, False]


def test_similar_titles(spark):
    books = spark.createDataFrame([(1, "Ann Ash", "The Quiet Northern River"), (2, "Ann Ash", "Short"), (3, None, "The Quiet Northern River")], "id int, author string, title string")
    outputs = spark.createDataFrame([("p", "ann  ash", "The Quiet Northern Rivers"), ("q", "Bo", "The Quiet Northern River"), ("r", "Ann Ash", "Something Else Entirely")], "path string, author string, title string")
    assert [tuple(r) for r in C.similar_titles(books, outputs, "id").collect()] == [(1, "p")]


def test_empty_folders(spark):
    folders = spark.createDataFrame([("A",), ("A/B",), ("A/B/C",), ("D",), ("_x",), ("D/e",)], "path string")
    files = spark.createDataFrame([("D/e/f.m4b",)], "path string")
    assert [tuple(r) for r in C.empty_folders(folders, files).collect()] == [("A/B/C", 3, "A")]
