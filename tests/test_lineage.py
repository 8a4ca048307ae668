"""Literal cases of lineage between the files of a group."""

from tessera.operators import lineage as L

ALBUM = {"album": "Book"}
GROUPS = {
    "mp3": [("Book/01.mp3", 100.0, 0, ALBUM), ("Book/02.mp3", 120.0, 0, ALBUM), ("Book/Book.m4b", 220.4, 2, ALBUM)],
    "zip": [("Book/01.mp3", 100.0, 0, {}), ("Book/02.mp3", 120.0, 0, {}), ("Book/01.m4b", 100.3, 0, {}), ("Book/02.m4b", 119.8, 0, {})],
    "temp": [("A-tmpfiles/1-finished.m4b", 100.0, 0, {}), ("A-tmpfiles/2-finished.m4b", 120.0, None, None), ("A-tmpfiles/tmp_A.m4b", 220.2, 0, {})],
    "apart": [("Book/01.mp3", 100.0, 0, {}), ("Book/02.mp3", 120.0, 0, {}), ("Book/Book.m4b", 900.0, 2, {})],
    "one": [("Book/Book.m4b", 900.0, 2, {}), ("Book/note.txt", 900.0, 2, {})],
    "bad": [("Book/Book.m4b", None, 0, {})],
}


def test_lineage(spark):
    rows = [(k, *f, "broken" if f[1] is None else None, "x") for k, fs in GROUPS.items() for f in fs]
    files = spark.createDataFrame(rows, "group_key string, relative_path string, duration double, chapters int, tags map<string,string>, error string, kind string")
    found = L.relationships(files)
    out = {(r.group_key, r.relationship, r.target): (r.score, r.conflicts, r.band) for r in found.collect()}
    # durations 50, group 5, chapters 25, target's name 5, sequence 7, album 4
    assert out[("mp3", "combined_from_mp3_components", "Book/Book.m4b")] == (96.0, 0, "high")
    assert out[("zip", "parallel_intermediate_conversion", None)] == (80.0, 0, "medium")
    assert out[("temp", "combined_from_m4b_components", "A-tmpfiles/tmp_A.m4b")] == (80.0, 1, "medium")
    assert not any(k[0] in ("apart", "one", "bad") for k in out)
    assert {r.group_key: r.reasons for r in L.review(files, found).collect()} == {"mp3": "", "zip": "uncertain", "temp": "uncertain", "apart": "unexplained", "one": "unexplained", "bad": "unreadable"}
    assert L.relationships(files.where("false")).count() == 0
