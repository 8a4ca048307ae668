"""Changes of state tables: nulls, repeats, unknown keys, refused rows, empty tables."""

from pyspark.sql import functions as F

from tessera.operators import states as S


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_rediscovery_and_detection(spark):
    books = spark.createDataFrame([(1, "a", "complete", None, "out"), (1, "b", "superseded", "old", None), (1, None, "failed", "x", "y")], "run int, id string, state string, failure string, output string")
    seen = S.rediscovery(books)
    assert [r.failure for r in seen.orderBy("id").collect()] == [S.WAITING, S.WAITING, "old"] and seen.where("state <> 'superseded'").count() == 0
    found = spark.createDataFrame([(1, "a", "detected"), (1, None, "detected"), (2, "c", "detected")], "run int, id string, state string")
    assert rows(S.detected(seen, found, ["run", "id"], ["failure", "output"])) == sorted([(1, "a", "detected", None, None), (1, "b", "superseded", "old", None), (1, None, "detected", None, None), (2, "c", "detected", None, None)], key=str)
    assert S.detected(seen, found.where("false"), ["run", "id"], ["failure"]).count() == 3


def test_decisions(spark):
    saved = spark.createDataFrame([("r1", "confirm", None, 1, 1), ("r2", "reject", "n", 2, 2)], "id string, decision string, note string, decided_at int, updated_at int")
    new = spark.createDataFrame([("r1", "defer", "later", 5), ("r1", "reject", "mid", 4), ("r3", "confirm", None, 6), ("r2", "maybe", None, 7), ("r4", None, None, 8)], "id string, decision string, note string, at int")
    assert rows(S.decided(saved, new, "id")) == [("r1", "defer", "later", 1, 5, 0), ("r2", "reject", "n", 2, 2, 1), ("r3", "confirm", None, 6, 6, 0), ("r4", None, None, None, None, 1)]


def test_claims(spark):
    claims = spark.createDataFrame([("p", "first"), ("q", "other")], "path string, book string")
    assert rows(S.released(claims, spark.createDataFrame([("p", "second"), ("q", "other")], "path string, book string"), ["path"], "book")) == [("p", "first")]


def test_selections(spark):
    books = spark.createDataFrame([(1, ["a", "b"], ["c"], ["c", "a"]), (2, ["a"], [], ["z"]), (3, ["a"], ["b"], None), (4, ["a"], ["b"], []), (5, ["a"], ["b"], ["a", "a"])], "id int, files array<string>, alternates array<string>, selected array<string>")
    out = {r.id: (r.outcome, r.files, r.alternates) for r in S.adopted(books).collect()}
    assert out == {1: ("complete", ["c", "a"], ["b"]), 2: ("error", ["a"], []), 3: ("complete", ["a"], ["b"]), 4: ("error", ["a"], ["b"]), 5: ("error", ["a"], ["b"])}
    again = S.rebuilt(books.where("id = 1")).first()
    assert (again.files, again.alternates) == (["c", "a"], ["b"])


def test_registers(spark):
    known = spark.createDataFrame([("a", 1, None), ("b", 2, "m")], "path string, size int, members string")
    new = spark.createDataFrame([("a", 1, None), ("b", 3, "m"), ("c", 1, None)], "path string, size int, members string")
    assert [r.outcome for r in S.registered(known, new, ["path"], ["size", "members"]).orderBy("path").collect()] == ["unchanged", "conflict", "registered"]
    meta = spark.createDataFrame([("r", 1, "T", "p", "1"), ("r", 2, " ", "p", "1"), ("s", 1, None, None, None)], "id string, at int, title string, provider string, provider_id string")
    assert rows(S.approved(meta, "id", "at")) == [("r", "T", "p", "1", 1), ("s", None, None, None, 1)]


def test_runs(spark):
    runs = spark.createDataFrame([(1, "in", "complete", 5), (2, "in", "converting", None), (3, "in", "failed", None), (4, "b", "failed", None)], "run int, root string, status string, finished_at int")
    assert rows(S.resumable(runs, ["root"], "run", "status")) == [("in", 2)]
    changes = spark.createDataFrame([(2, "complete", 9), (3, "converting", 9)], "run int, status string, at int")
    assert rows(S.updated_run(runs, changes, "run").select("run", "status", "finished_at")) == [(1, "complete", 5), (2, "complete", 9), (3, "converting", None), (4, "failed", None)]
    books = spark.createDataFrame([("a", "complete"), ("b", "failed")], "id string, state string")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert rows(S.corrections(wanted, books, "id", ["complete"])) == [("a", "planned"), ("b", "state"), ("c", "missing")]


def test_reviews(spark):
    """A decision on other evidence is stale; one on none is, too; without one nothing is."""
    items = spark.createDataFrame([(1, "f", "high"), (2, "f", "low"), (3, None, "low"), (4, "f", "low")], "id int, fingerprint string, band string")
    decisions = spark.createDataFrame([(1, "confirm", "f"), (2, "reject", "g"), (3, "defer", None), (9, "defer", None)], "id int, decision string, fingerprint string")
    out = S.with_decisions(items, decisions, "id")
    assert rows(out.select("id", "status", "stale")) == [(1, "confirm", False), (2, "reject", True), (3, "defer", False), (4, "unreviewed", False)]
    assert rows(S.filtered(out, "low", "unreviewed").select("id")) == [(4,)] and S.filtered(out).count() == 4 and S.filtered(out, decision="reject").count() == 1


def test_lists_and_tags(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    strings = lambda *x: F.array(*(F.lit(v) for v in x))
    assert one(S.compact_list(strings("A  b", " ", "a b", None, "C", "c"))) == ["A b", "C"]
    assert one(S.same_set(strings("a", "b"), strings("b", "a"))) and not one(S.same_set(strings("a", "a", "b"), strings("a", "b"))) and one(S.is_subset(F.array().cast("array<string>"), strings("a")))
    assert one(S.first_tag(F.create_map(F.lit("b"), F.lit(" x "), F.lit("a"), F.lit(" ")), "a", "c", "b")) == "x" and one(S.first_tag(F.create_map().cast("map<string,string>"), "a")) == ""
    assert one(S.chapter_escaped(F.lit("a=b;c#d\\\ne"))) == "a\\=b\\;c\\#d\\\\ e"


def test_untracked_classes_without_pairs(spark, tmp_path, monkeypatch):
    """the SQL's rows with equal balances, both signs, nulls and 300 candidates within reach, and no pair for each of them."""
    import random

    import duckdb

    from tessera.operators import matching as M
    from tessera.plans import registry

    g = random.Random(3)
    suppliers = [(i, g.choice([0, 1, None]), g.choice([None, 0.0, -3.5, 4.0, 600.0, 2000.0, round(g.uniform(-300, 9000), 2)])) for i in range(150)] + [(200, 2, 100.0)]
    customers = [(i, g.choice([0, 0, 1, None]), g.choice([None, 0.0, -2.0, 3.0, 597.0, round(g.uniform(580, 620), 2), round(g.uniform(-300, 9000), 2)])) for i in range(600)] + [(700, 2, 101.0), (701, 2, 150.0)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    db = duckdb.connect()
    for t in ("supplier", "customer"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    seen, nearest = [], M.nearest
    monkeypatch.setattr(M, "nearest", lambda *a: (seen.append(nearest(*a)), seen[-1])[1])
    got = [tuple(r) for r in registry.QUERIES["untracked_classes"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(db.execute(registry.ORACLES["untracked_classes"]).fetchall())
    assert {c for _, c, _ in got} >= {"none", "one", "many", "weak"} and seen[0].count() <= 10 * 151
