"""Literal cases of candidate scores, catalog classes, part endings, aliases and runtimes."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import candidates as C
from tessera.operators import shelves as S
from tessera.plans import registry

HINT = "struct<title:string,authors:array<string>,series:string,isbn:string,runtime_minutes:double,narrators:array<string>>"
FOUND = HINT[:-1] + ",cover_url:string,description:string,publisher:string>"


def book(title, authors=(), series=None, runtime=None, isbn=None, narrators=()):
    return (title, list(authors), series, isbn, runtime, list(narrators))


CASES = [
    # hint, candidates, margin, (score, wins, candidates left)
    (book("The Courts of Chaos", ["Roger Zelazny"]), [book("The Courts of Chaos", ["Roger Zelazny"]), book("Nine Princes in Amber", ["Roger Zelazny"])], (90, True)),
    (book("Dune", ["Frank Herbert"], runtime=1200.0), [book("Dune", ["Frank Herbert"], runtime=300.0)], (70, False)),
    (book("Dune", ["Frank Herbert"], runtime=1200.0), [book("Dune", ["Frank Herbert"], runtime=1205.0)], (100, True)),
    (book("The Hard Way", ["Lee Child"], "Jack Reacher"), [book("The Hard Way: Jack Reacher, Book 10", ["Lee Child"])], (95, True)),
    (book("Bloodlines", [], "Legacy of the Force"), [book("Star Wars - Legacy of the Force - Bloodlines", ["Karen Traviss"])], (90, True)),
    (book("Calamity", ["Brandon Sanderson"]), [book("Calamity", ["Brandon Sanderson"]), book("Calamity", ["Brandon Sanderson"])], (90, True)),
    (book("The Courts of Chaos"), [book("The Courts of Chaos", ["Roger Zelazny"])], (85, True)),
    (book("The City"), [book("The City", ["Author One"]), book("The City", ["Author Two"])], (85, False)),
    (book("薬屋のひとりごと", ["日向夏"]), [book("薬屋のひとりごと", ["日向夏"])], (90, True)),
    (book("Dune", ["Frank Herbert"]), [book("", ["Frank Herbert"])], (25, False)),
    (book(None, [None]), [book(None)], (0, False)),
]


def test_choice(spark):
    rows = [(k, n, hint, (*c, None, None, None)) for k, (hint, found, _) in enumerate(CASES) for n, c in enumerate(found)]
    pairs = spark.createDataFrame(rows, f"k int, place int, hint {HINT}, candidate {FOUND}")
    out = {r.k: (r.score, r.wins) for r in C.chosen(pairs, "k", "place").collect()}
    assert out == {k: want for k, (_, _, want) in enumerate(CASES)}
    wide = C.chosen(pairs, "k", "place", margin=10).where("k = 7").first()
    assert wide.lead == 0 and not wide.wins
    assert C.chosen(pairs.where("false"), "k", "place").count() == 0


def test_fuller_candidate_stays(spark):
    poor, rich = (*book("Calamity", ["B S"]), None, "", None), (*book("Calamity (2016)", ["S B"]), "http://c", None, None)
    pairs = spark.createDataFrame([(1, 0, book("Calamity"), poor), (1, 1, book("Calamity"), rich)], f"k int, place int, hint {HINT}, candidate {FOUND}")
    assert [r.candidate.cover_url for r in C.collapsed(pairs, "k", "place").collect()] == ["http://c"]


def test_catalog_classes(spark):
    groups = {"a": ["a.m4b"], "b": ["b.mp3"], "c": ["c1.mp3", "c2.MP3"], "d": ["d.M4A", "d.mp3"], "e": ["e1.m4b", "e2.m4b"], "f": ["f.m4b", "bad.mp3"], "g": ["g.m4b", "unknown.mp3"]}
    members = spark.createDataFrame([(k, p) for k, ps in groups.items() for p in ps], "group_key string, relative_path string")
    files = spark.createDataFrame([(p, "broken" if p == "bad.mp3" else None) for ps in groups.values() for p in ps if p != "unknown.mp3"], "relative_path string, error string")
    out = {r.group_key: r["class"] for r in S.catalog_classes(members, files).collect()}
    assert out == dict(zip("abcdefg", ["existing_m4b", "single_conversion", "multipart_conversion", "mixed_with_m4b", "ambiguous", "needs_attention", "existing_m4b"], strict=True))


@pytest.mark.parametrize(("title", "base"), [("The Way of Kings [05]", "the way of kings"), ("High Five (Disk 9) Author Interview", "high five"), ("The Hero of Ages (2 of 3)", "the hero of ages"), ("Emma, part 4", "emma"), ("Emma 1 of 2", "emma"), ("Emma", None), ("", None), (None, None)])
def test_part_base(spark, title, base):
    assert spark.createDataFrame([(title,)], "t string").select(S.part_base(F.col("t"))).first()[0] == base


def test_represented(spark):
    outputs = [("Example Writer", ["example journey"], None), ("Other Writer", ["far"], "other saga")]
    books = [
        (1, "Example Saga: Example Journey", "Example Writer", None, "missing_candidate"), (2, "Example Saga: Example Journey", "Example Writer", "Example Saga", "represented_title"),
        (3, "Example Journey", "Different Writer", None, "review_author_or_edition"), (4, "Far", "Other Writer", "Example Saga", "review_author_or_edition"),
        (5, "Far", "other writer and sons", "Other Saga", "represented_title"), (6, "?", "x", None, "review_identity"), (7, None, None, None, "review_identity"), (8, "Far (Unabridged)", "Other Writer", None, "represented_title"),
    ]
    frame = spark.createDataFrame([b[:4] for b in books], "id int, title string, author string, series string")
    out = {r.id: r["class"] for r in S.represented(frame, spark.createDataFrame(outputs, "author string, titles array<string>, series string"), "id").collect()}
    assert out == {b[0]: b[4] for b in books}


def test_runtime(spark):
    rows = spark.createDataFrame([("600", 36300.0), ("450", 36300.0), ("x", 1.0), (None, 1.0), ("0", 0.0)], "m string, s double")
    assert [r[0] for r in rows.select(S.runtime_matches(F.col("m"), F.col("s"))).collect()] == [True, False, False, False, False]


def test_candidate_query(spark):
    assert registry.QUERIES["candidate_choice"](spark, "/root/testdata/sf0.01").where("score between 0 and 100").count() > 0


def test_contained_pairs(spark):
    import itertools
    import random

    from tessera.operators import matching as M

    g = random.Random(5)
    rows = [(i, g.choice("pq"), [g.choice("abcdefgh") for _ in range(g.randint(0, 6))]) for i in range(120)] + [(120, "p", None), (121, None, ["a"])]
    frame = spark.createDataFrame(rows, "id int, b string, w array<string>")
    for least in (0.34, 0.5, 0.8, 1.0):
        want = set()
        for (i, b, x), (j, c, y) in itertools.combinations(rows, 2):
            if b and b == c and x and y and len(set(x) & set(y)) / min(len(set(x)), len(set(y))) >= least:
                want.add((i, j))
        got = [(r.a_key, r.b_key) for r in M.contained_pairs(frame, "id", ["b"], "w", least).collect()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(300)] + [(1000, 1001)], [(0, i) for i in range(1, 400)] + [(-5, 399), (500, 501)]])
def test_components_chain_and_star(spark, edges):
    from tessera.operators.components import components

    assert {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == union_find(edges)


def union_find(edges):
    up = {n: n for e in edges for n in e}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        up[high] = low
    return {(n, top(n)) for n in up}


def test_order_components(spark):
    """Every order and supplier of the table is a node of its own."""
    import duckdb

    sf = "/root/testdata/sf0.001"
    edges = duckdb.sql(f"SELECT DISTINCT l_orderkey, -1 - l_suppkey FROM '{sf}/lineitem.parquet'").fetchall()
    assert {tuple(r) for r in registry.QUERIES["order_components"](spark, sf).collect()} == union_find(edges)


def test_components_shrink(spark, monkeypatch):
    """No later table holds the whole component at its root: what is saved gets smaller, down to nothing."""
    from tessera.operators import components as C

    sizes = []
    save = C.saved
    monkeypatch.setattr(C, "saved", lambda df: (lambda out: sizes.append(out.count()) or out)(save(df)))
    rows = spark.range(3000).selectExpr("id div 3 AS a", "-1 - (id * 7919) % 50 AS b")
    assert {r.root for r in C.components(rows).collect()} == {-50}
    assert sizes[-1] == 0 and sum(sizes) < 3 * sizes[0]


@pytest.mark.parametrize("alone", [0, 40, 250_000])
def test_components_alone(spark, monkeypatch, alone):
    """Rounds, rounds with one task for the rest, and that task alone agree, for names, too; a small graph takes few saved tables."""
    from tessera.operators import components as C

    saves = []
    save = C.saved
    monkeypatch.setattr(C, "saved", lambda df: saves.append(1) or save(df))
    monkeypatch.setattr(C, "_ALONE", alone)
    edges = [(i * 7919 % 211, (i + 1) * 7919 % 211) for i in range(180)] + [(1000, 1000 + i) for i in range(60)] + [(5, 5), (-3, 1059), (1059, -3)]
    want = union_find([(a, b) for a, b in edges if a != b])
    assert {tuple(r) for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert alone < len(edges) or len(saves) == 3
    named = [(f"{a:+05d}é", f"{b:+05d}é") for a, b in edges]
    got = [tuple(r) for r in C.components(spark.createDataFrame(named, "a string, b string")).collect()]
    assert len(got) == len(set(got)) and set(got) == union_find([(a, b) for a, b in named if a != b])


def test_no_row_or_text_is_lost(spark):
    """Every customer has a place, every different text a document, every part its whole title."""
    sf = "/root/testdata/sf0.001"
    read = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    places = sorted(r.place for r in registry.QUERIES["natural_order"](spark, sf).collect())
    assert places == list(range(1, read("customer").count() + 1))
    assert registry.QUERIES["keep_best"](spark, sf).count() == read("documents").select(F.lower("text")).distinct().count()
    for name, column, table, key, text in (("title_key", "title_key", "documents", "doc_id", "text"), ("normalized_titles", "title", "part", "p_partkey", "p_name")):
        whole = {r[key]: r[text] for r in read(table).collect()}
        out = {r[key]: set(r[column].split()) for r in registry.QUERIES[name](spark, sf).collect()}
        assert out == {k: set(re.findall(r"[^\W_]+", v.lower())) for k, v in whole.items()}


@pytest.fixture
def copied_parts(spark, tmp_path):
    """3 brands and sizes of 5 titles, two of them of the same words and one without words, 20 parts each."""
    names = ["hot bolt", "bolt hot", "old bolt", "old plate (new)", "--", None]
    rows = [(k, names[k % 6], f"Brand#{k // 6 % 3}", k // 6 % 3) for k in range(360)] + [(400, "lone ring", "Brand#9", 1), (401, "hot bolt", None, 1)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path), rows


def every_pair(spark, rows):
    from tessera.functions import text
    from tessera.operators import matching as M

    part = spark.createDataFrame(rows, "key long, name string, b string, s int").withColumn("t", text.tokens(F.col("name")))
    return part, M.contained_pairs(part, "key", ["b", "s"], "t", 0.5).select("a_key", "b_key")


def test_candidates_of_copies(spark, copied_parts, monkeypatch):
    """copies meet as classes, and each part gets what all pairs of parts give."""
    from tessera.operators import candidates as C

    folder, rows = copied_parts
    met, chosen = [], C.chosen
    monkeypatch.setattr(C, "chosen", lambda pairs, *a: (met.append(pairs.count()), chosen(pairs, *a))[1])
    got = {tuple(r) for r in registry.QUERIES["candidate_choice"](spark, folder).collect()}
    part, pairs = every_pair(spark, rows)
    book = lambda side: part.select(F.col("key").alias(f"{side}_key"), F.struct(F.col("name").alias("title"), F.array("b").alias("authors"), F.lit("").alias("series"), F.lit(None).cast("string").alias("isbn"), F.lit(None).cast("double").alias("runtime_minutes"), F.array().cast("array<string>").alias("narrators"), *[F.lit(None).cast("string").alias(n) for n in ("cover_url", "description", "publisher")]).alias(f"{side}_book"))
    both = pairs.unionByName(pairs.select(F.col("b_key").alias("a_key"), F.col("a_key").alias("b_key"))).join(book("a"), "a_key").join(book("b"), "b_key")
    want = chosen(both.select(F.col("a_key").alias("key"), F.col("b_key").alias("place"), F.col("a_book").alias("hint"), F.col("b_book").alias("candidate")), "key", "place")
    assert got == {tuple(r) for r in want.select("key", "score", "lead", "wins").collect()} and len(got) == 240
    assert met[0] <= 3 * 4 * 2 * 4


def test_similarity_of_copies(spark, copied_parts):
    """pairs of different titles and each copy's title, from which all pairs of parts follow."""
    from tessera.operators import candidates as C

    folder, rows = copied_parts
    out = registry.QUERIES["title_similarity"](spark, folder).collect()
    part, pairs = every_pair(spark, rows)
    named = lambda side: part.select(F.col("key").alias(f"{side}_key"), F.col("name").alias(f"{side}_name"))
    want = {tuple(r) for r in pairs.join(named("a"), "a_key").join(named("b"), "b_key").select("a_key", "b_key", F.round(C.title_similarity(F.col("a_name"), F.col("b_name")), 6)).collect()}
    members = {}
    for key, name, brand, size in rows:
        members.setdefault((name, brand, size), []).append(key)
    first = {m[0]: m for m in members.values()}
    got = {(p, q, r.similarity if p in first[r.a_key] else r.reverse) for r in out if r.kind == "text" for x in first[r.a_key] for y in first[r.b_key] for p, q in [sorted((x, y))]}
    got |= {(p, q, r.similarity) for r in out if r.kind == "copy" for p in first[r.a_key] for q in first[r.a_key] if p < q}
    assert got == want and len(out) < 360
