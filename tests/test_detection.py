"""Books among media files: every case has names of its own, so all are found in one run."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import titles as T
from tessera.operators import detection as D

#: (path, album, artist, title, seconds); None seconds are unreadable. Expected: group_key -> number of files.
CASES = {
    "author as title": ([("Ann Ash/2015 - Borealis.m4a", "Ann Ash", "Ann Ash", "Ann Ash", 36000)], {"ann ash — borealis": 1}),
    "two albums": ([("Bo Birch/01.mp3", "First Fir", "Bo Birch", "", 60), ("Bo Birch/02.mp3", "Second Spruce", "Bo Birch", "", 60)], {"bo birch — first fir": 1, "bo birch — second spruce": 1}),
    "discs": ([("Cy Cedar/Cold Creek/CD1/01.mp3", "", "", "", 60), ("Cy Cedar/Cold Creek/CD2/01.mp3", "", "", "", 60)], {"cold creek": 2}),
    "tags join folders": ([("mess/01.mp3", "Dawn Drum", "Di Dell", "", 60), ("else/final.m4b", "Dawn Drum", "Di Dell", "", 60)], {"di dell — dawn drum": 2}),
    "one word, one author": ([("Coll A/01. Ember.m4b", "Ember", "Ed Elm", "", 72000), ("Coll A/02. Ferry.m4b", "Ferry", "Ed Elm", "", 36000), ("Coll B/Ember 01 - Ember.m4b", "Ember 01 - Ember", "Ed Elm", "", 72000), ("Coll B/Ember 02 - Ferry.m4b", "Ember 02 - Ferry", "Ed Elm", "", 36000)], {"ed elm — ember": 2, "ed elm — ferry": 2}),
    "one title, two authors": ([("Fay Fern/Restless/01.mp3", "Restless", "Fay Fern", "", 3600), ("Fay Fern/Restless/02.mp3", "Restless", "Fay Fern", "", 3700), ("G.H Gorse/Restless/01.mp3", "Restless", "G. H. Gorse, Vic Vine", "", 4100), ("G.H Gorse/Restless/02.mp3", "Restless", "G. H. Gorse, Vic Vine", "", 4200)], {"fay fern — restless": 2, "g h gorse vic vine — restless": 2}),
    "inverted name": ([("Hal Hazel/The Hollow Hill/01.mp3", "The Hollow Hill", "Hazel, Hal", "", 3600), ("The Hollow Hill-tmpfiles/01-finished.m4b", "The Hollow Hill", "Hazel, Hal", "", 3600)], {"hazel hal — the hollow hill": 2}),
    "conversion of a numbered folder": ([("Ink Set/07 - Great Guilds/02. Masters of Ink/01.mp3", "", "", "", 60), ("07 - Great Guilds - 02. Masters of Ink-tmpfiles/final.m4b", "", "", "", 60)], {"masters of ink": 2}),
    "unabridged": ([("Jo/Sagas/Book 10 - The Jade Jar/01.mp3", "", "", "", 60), ("Jo/Sagas/Book 10 - The Jade Jar/02.mp3", "The Jade Jar (Unabridged)", "Jo Juniper", "", 60), ("Book 10 - The Jade Jar-tmpfiles/tmp-book.m4b", "", "", "", 60)], {"jo juniper — the jade jar": 3}),
    "series code": ([("Book 1 - Kites the Kiln-tmpfiles/01-finished.m4b", "EV01 Kites the Kiln", "Kim Kelp", "", 60), ("Book 1 - Kites the Kiln-tmpfiles/tmp-book.m4b", "Kites the Kiln", "Kim Kelp", "", 60)], {"kim kelp — kites the kiln": 2}),
    "numeric albums": ([("Lamps - Lights of Loam-tmpfiles/01-finished.m4b", "01", "Lee Larch", "", 1800), ("Lamps - Lights of Loam-tmpfiles/02-finished.m4b", "02", "Lee Larch", "", 1900)], {"lee larch — lamps lights of loam": 2}),
    "generic album": ([("May Maple/Moss Moon/01.mp3", "Audiobook", "May Maple", "", 1800), ("May Maple/Moss Moon/02.mp3", "May Maple", "May Maple", "", 1900)], {"may maple — moss moon": 2}),
    "number folders": ([("Nora/13A - Nettle Nest/01/01.mp3", "01", "Ned Nut", "", 600), ("Nora/13A - Nettle Nest/02/01.mp3", "02", "Ned Nut", "", 600)], {"ned nut — nettle nest": 2}),
    "conversion of equal length": ([("Ola Oak/Oars of Onyx/01.mp3", "Oars of Onyx", "Ola Oak", "", 3600), ("Ola Oak/Oars of Onyx/02.mp3", "Oars of Onyx", "Ola Oak", "", 3610), ("Ola Oak-Forge Zeal-2-Oars of Onyx-tmpfiles/tmp_Ola Oak-Forge Zeal-2-Oars of Onyx.m4b", "", "", "", 7210)], {"ola oak — oars of onyx": 3}),
    "other numbers": ([("Quill-tmpfiles/02.m4b", "Quaint Quill Book 2", "Quin Reed", "", 7200), ("Quill-tmpfiles/03.m4b", "Quaint Quill Book 3", "Quin Reed", "", 7200)], {"quin reed — quaint quill book 2": 1, "quin reed — quaint quill book 3": 1}),
    "finished parts": ([("R.s. Rowan - The Rivers - Rapids-tmpfiles/1-finished.m4b", "", "", "The Rivers - Rapids Part 1", 7203), ("R.s. Rowan - The Rivers - Rapids-tmpfiles/2-finished.m4b", "", "", "The Rivers - Rapids Part 2", 7301), ("R.s. Rowan - The Rivers - Rapids-tmpfiles/tmp_R.s. Rowan - The Rivers - Rapids.m4b", "", "", "", 14504)], {"the rivers rapids": 3}),
    "dramatized": ([("Sky/12 - Stone Stair - 1 - The Slate of Stars - GA/Part 1/01.mp3", "The Stone Stair 1 - The Slate of Stars 01", "GraphicAudio", "", 4000), ("Sky/12 - Stone Stair - 1 - The Slate of Stars - GA/Part 2/01.mp3", "The Stone Stair 1 - The Slate of Stars 02", "GraphicAudio", "", 4100)], {"graphicaudio — the slate of stars graphic audio": 2}),
    "year": ([("Tess Thorn/The Tidal Town/01.mp3", "The Tidal Town", "Tess Thorn", "", 3601), ("Tess Thorn/The Tidal Town/02.mp3", "The Tidal Town", "Tess Thorn", "", 3602), ("Tess Thorn/The Tidal Town 2011.mp3", "", "Tess Thorn", "", 7203)], {"tess thorn — the tidal town": 3}),
    "author in the folder": ([("Una Umber/Waves of Umber/book.m4b", "Waves of Umber", "Una Umber", "", 7204), ("Una Umber/Waves of Umber - Una Umber/01.mp3", "", "", "", 3602)], {"una umber — waves of umber": 2}),
    "collection": ([("Val Vetch/Valley/Valley - 01 - Violet Veil.mp3", "Valley", "Val Vetch", "", 36000), ("Val Vetch/Valley/Valley - 02 - Velvet Vane.mp3", "Valley", "Val Vetch", "", 38000)], {"val vetch — violet veil": 1, "val vetch — velvet vane": 1}),
    "chapters": ([("Will Wort/Wheat/Wheat - 01 - Opening.mp3", "Wheat", "Will Wort", "", 1800), ("Will Wort/Wheat/Wheat - 02 - Middle.mp3", "Wheat", "Will Wort", "", 1800)], {"will wort — wheat": 2}),
    "other versions": ([("Xi/Xeric Xylem/Alt. Version/Xeric Xylem.mp3", "", "", "", 60), ("Xi/Yonder Yew/Alternate Version/Yonder Yew.mp3", "", "", "", 60)], {"xeric xylem": 1, "yonder yew": 1}),
    "conflict": ([("Zoe Zinnia/2014 The Zenith/77 Ashgrove.mp3", "", "", "", 60)], {"the zenith": 1}),
    "unreadable": ([("Aspen-tmpfiles/01-finished.m4b", "Aspen Axis", "Al Alder", "", 60), ("Aspen-tmpfiles/02-converting.m4b", "", "", "", None)], {"al alder — aspen axis": 2}),
    "by author": ([("Bea Beech/The Braided Bay/01.mp3", "The Braided Bay", "Bea Beech", "", 3603), ("The Braided Bay by Bea Beech/part.mp3", "", "", "", 1800)], {"bea beech — the braided bay": 2}),
    "disc in the album": ([("Clay/Disc 1/01.mp3", "Clover Coast (Disc 1)", "Cleo Clay", "", 60), ("Clay/Disc 9/01.mp3", "Clover Coast (Disk 9) Author Interview", "Cleo Clay", "", 60)], {"cleo clay — clover coast": 2}),
    "flat files": ([("D.E.Dock/B02 Larder Eternal.mp3", "", "", "", 51052), ("D.E.Dock/B04 Larder Revealed.mp3", "", "", "", 58742)], {"larder eternal": 1, "larder revealed": 1}),
    "title tag": ([("D.E.Dune/B20 - file.mp3", "", "D.E. Dune", "Gale Unveiled (Band #19) (Unabridged)", 56509)], {"d e dune — gale unveiled band 19": 1}),
    "placeholder": ([("Eve Elder/Book 14 - A Pool of Peat/01.mp3", "Unknown", "Eve Elder", "", 60), ("Eve Elder/Book 14 - A Pool of Peat/02.mp3", "Unknown", "Eve Elder", "", 60)], {"eve elder — a pool of peat": 2}),
    "shared album": ([("Fern Fig/Gauntlet Grove/book.m4b", "Nether Saga", "Fern Fig", "", 45000), ("Fern Fig/Hare's Horn/book.m4b", "Nether Saga", "Fern Fig", "", 47000)], {"fern fig — gauntlet grove": 1, "fern fig — hare s horn": 1}),
    "own container": ([("Gil Gum/Iris/Iris - Iris, Book 1.m4b", "Iris", "Gil Gum", "Iris - Iris, Book 1", 55000), ("Gil Gum/Iris/Jarring Jade - Iris, Book 0.m4b", "Iris Series", "Gil Gum", "Jarring Jade", 6300)], {"gil gum — iris": 1, "gil gum — jarring jade": 1}),
    "misfiled": ([("Hope Holly/2014 The Kelp/The Kelp pt 1.mp3", "Hope Holly - The Kelp pt 1", "Hope Holly", "", 3604), ("Hope Holly/2014 The Kelp/The Kelp pt 2.mp3", "Hope Holly - The Kelp pt 2", "Hope Holly", "", 3705), ("Hope Holly/2014 The Kelp/78 Larkstreet.mp3", "", "", "", 7206), ("Hope Holly/2011 78 Larkstreet/78 Larkstreet.mp3", "", "", "", 7206)], {"hope holly — the kelp": 2, "78 larkstreet": 2}),
}


@pytest.fixture(scope="module")
def found(spark):
    rows, case = [], {}
    for name, (files, _) in CASES.items():
        for path, album, artist, title, seconds in files:
            tags = {k: v for k, v in (("album", album), ("artist", artist), ("title", title)) if v}
            rows.append((path, None if seconds is None else float(seconds), tags or None))
            case[path] = name
    files = spark.createDataFrame(rows, "relative_path string, duration double, tags map<string,string>")
    out = D.detect(files).collect()
    assert sorted(r.relative_path for r in out) == sorted(case)
    groups = {name: {} for name in CASES}
    for r in out:
        groups[case[r.relative_path]].setdefault((r.group_key, r.title, r.part), []).append(r)
    return groups


@pytest.mark.parametrize("name", CASES)
def test_groups(found, name):
    assert {k[0]: len(v) for k, v in found[name].items()} == CASES[name][1]


def test_reasons(found):
    reason = lambda name: {r.reason for v in found[name].values() for r in v}
    assert reason("conflict") == {"directory and filename identities conflict"}
    assert reason("collection") == {"long-form collection files split into individual books"}
    assert reason("shared album") == {"audiobook-sized containers split from a shared collection album"}
    assert reason("conversion of equal length") == {"duration-matched alternate representation joined to its source book"}
    assert reason("discs") == {"normalized directory/disc structure grouped untagged files"}
    assert reason("numeric albums") == {"embedded album identity grouped these files"}
    assert reason("unabridged") == {"tag and normalized path identity reconciled equivalent representations"}


def test_empty(spark):
    none = spark.createDataFrame([], "relative_path string, duration double, tags map<string,string>")
    assert D.detect(none).count() == 0


def test_titles(spark):
    names = spark.createDataFrame([("Book 7 - The King (2011)", "the king"), ("Series - 03. Last Leaf read by Jo Poe", "last leaf"), ("A Tale tmpfiles", "a tale"), ("", ""), (None, None), ("The Set (1 of 5) (Unabridged)", "the set")], "n string, t string")
    assert names.where(~T.book_title("n").eqNullSafe(F.col("t"))).collect() == []
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.identity_numbers(F.lit("book 01 of 12, 2.50 and 100"))) == ["1", "100", "2.5"] and one(T.identity_words(F.lit("the book of tin 3 tin"))) == ["tin"]
    assert one(T.coded(F.lit("ev01 dies the fire"), F.lit("dies the fire"))) and not one(T.coded(F.lit("dies the fire"), F.lit("dies the fire")))
    assert one(T.without_author(F.lit("ann ash north ann ash"), F.lit("ann ash"))) == "north ann ash" and one(T.without_author(F.lit("ann ash"), F.lit("ann ash"))) == "ann ash"


def test_detected_books_of_long_recordings(spark, tmp_path):
    """two makers' recordings of one title stay two books, also where both are 2000 s long."""
    import duckdb

    from tessera.plans import registry

    spark.createDataFrame([(1, "hot bolt", "Brand#1"), (2, "hot bolt", "Brand#2"), (3, "old ring", "Brand#2")], "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(o, o % 3 + 1, o % 5, o % 7, 100.0) for o in range(600)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    db = duckdb.connect()
    for t in ("part", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = [tuple(r) for r in registry.QUERIES["detected_books"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(db.execute(registry.ORACLES["detected_books"]).fetchall()) and len({g for _, g, _ in got}) == 3


def test_steps_see_classes_of_files(spark, monkeypatch):
    """short tagged files of one folder are one row to every step; files whose names or lengths count stay rows of their own."""
    merged, seen = D.merged, []
    monkeypatch.setattr(D, "merged", lambda rows: seen.extend(r.title for r in rows.select("title").collect()) or merged(rows))
    tagged = [(f"Gus Gale/Grey Gulf/CD{n % 3}/{n}-{7 * n}.mp3", 1.0 + n % 5, {"album": "Grey Gulf", "artist": "Gus Gale"}) for n in range(300)]
    named = [("Ivy Ivory/Ice Isle/01.mp3", 60.0, None), ("Ivy Ivory/Ice Isle/02.mp3", 61.0, None), ("Jan Jute/Jolly Jay/Book.m4b", 7300.0, {"album": "Jolly Jay"})]
    out = D.detect(spark.createDataFrame(tagged + named, "relative_path string, duration double, tags map<string,string>")).collect()
    groups = {p: {r.group_key for r in out if r.relative_path.startswith(p)} for p in ("Gus", "Ivy", "Jan")}
    assert groups == {"Gus": {"gus gale — grey gulf"}, "Ivy": {"ice isle"}, "Jan": {"jolly jay"}} and sorted(r.relative_path for r in out) == sorted(f[0] for f in tagged + named)
    assert sorted(seen) == ["grey gulf"] * 3 + ["ice isle"] * 2 + ["jolly jay"]
