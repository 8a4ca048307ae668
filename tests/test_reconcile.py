"""The choice among a group's representations: one case a rule, ties, unreadable files and empty tables."""

import pytest

from tessera.operators import reconcile as R

#: rule: (files as (path, duration[, chapters]), state, chosen). A duration of None is unreadable.
CASES = {
    "sequence_conflict": ([("B/B 01 of 04.mp3", 500), ("B/B 03 of 04.mp3", 500)], "quarantine", []),
    "sequence_conflict/unread": ([("B/B_01_03.mp3", 500), ("B/B_02_03.mp3", None), ("B/B_03_03.mp3", 500)], "quarantine", []),
    "ordered_mp3/parts": ([("B/B (1 Of 2).mp3", 500), ("B/B (2 Of 2).mp3", 500)], "combine_components", ["B/B (1 Of 2).mp3", "B/B (2 Of 2).mp3"]),
    "only_file": ([("B/Series_Book_6_01.m4b", 30000)], "complete_m4b", ["B/Series_Book_6_01.m4b"]),
    "only_file/mp3": ([("B/x.mp3", 30000), ("B/y.mp3", None)], "convert_single", ["B/x.mp3"]),
    "numbered_originals": ([("B/01 - c.mp3", 600), ("B/02 - c.mp3", 700), ("B-tmpfiles/tmp_B.m4b", 1300)], "combine_components", ["B/01 - c.mp3", "B/02 - c.mp3"]),
    "containers": ([("B/01.mp4", 600), ("B/02.mp4", 700)], "combine_components", ["B/01.mp4", "B/02.mp4"]),
    "disc_tree": ([(f"A/B/{d:02d}/{t:02d}.mp3", 400 + t) for d in range(1, 7) for t in range(1, 4)], "combine_components", [f"A/B/{d:02d}/{t:02d}.mp3" for d in range(1, 7) for t in range(1, 4)]),
    "original_whole": ([("A/B/B.m4b", 18000, 2), ("A/B/B.mp3", 18000.1), ("B-tmpfiles/1-finished.m4b", 18000), ("B-tmpfiles/2-finished.m4b", 18000), ("B-tmpfiles/tmp_B.m4b", 36000)], "complete_m4b", ["A/B/B.m4b"]),
    "one_target": ([("01.mp3", 50), ("02.mp3", 50), ("B.m4b", 100.2)], "complete_m4b", ["B.m4b"]),
    "one_target/two sets": ([("01.mp3", 40), ("02.mp3", 60), ("01-finished.m4b", 40), ("02-finished.m4b", 60), ("B.m4b", 100.2)], "complete_m4b", ["B.m4b"]),
    "one_target/mp3": ([("B/01.mp3", 40), ("B/02.mp3", 60), ("B/B complete.mp3", 100)], "convert_single", ["B/B complete.mp3"]),
    "one_target/long mp3": ([("B/01.mp3", 4000), ("B/02.mp3", 4100), ("B.mp3", 8100)], "convert_single", ["B.mp3"]),
    "one_target/variant": ([("B/01.mp3", 40), ("B/02.mp3", 60), ("B/Alternative Version/B.mp3", 100)], "convert_single", ["B/Alternative Version/B.mp3"]),
    "several_targets": ([("B/01.mp3", 4000), ("B/02.mp3", 4100), ("C.m4b", 8100), ("D.m4b", 8150)], "complete_m4b", ["D.m4b"]),
    "unexplained": ([("01.mp3", 50), ("mystery.m4b", 900)], "quarantine", []),
    "unreadable": ([("a.mp3", None), ("b.mp3", 0)], "quarantine", []),
    "ordered_mp3": ([("01.mp3", 50), ("02.mp3", 60), ("03.mp3", None)], "combine_components", ["01.mp3", "02.mp3"]),
    "corroborated": ([("Copy A/01.mp3", 40), ("Copy A/02.mp3", 60), ("Copy B/01.mp3", 40), ("Copy B/02.mp3", 61)], "combine_components", ["Copy B/01.mp3", "Copy B/02.mp3"]),
    "corroborated/containers": ([("C/01.m4b", 3000), ("C/02.m4b", 2700), ("S/01.mp3", 2800), ("S/02.mp3", 2920), ("Short/01.mp3", 2500), ("Short/02.mp3", 2600)], "combine_components", ["C/01.m4b", "C/02.m4b"]),
    "like_containers": ([("edition.m4b", 1000), ("alternate.m4a", 1005)], "complete_m4b", ["alternate.m4a"]),
    "like_containers/more": ([("edition.m4b", 1000), ("alternate.m4a", 1000), ("complete.mp3", 1000), ("broken.mp3", None)], "complete_m4b", ["edition.m4b"]),
    "disc_tree_over_target": ([("E/Part 1/01.mp3", 2000), ("E/Part 1/02.mp3", 2100), ("E/Part 2/01.mp3", 2200), ("E/Part 2/02.mp3", 2300), ("Legacy Part 1/01.mp3", 2000), ("Legacy Part 1/02.mp3", 2100), ("Legacy Part 1/complete.m4b", 4100)], "combine_components", ["E/Part 1/01.mp3", "E/Part 1/02.mp3", "E/Part 2/01.mp3", "E/Part 2/02.mp3"]),
    "partial_conversion": ([("S/01.mp3", 3000), ("S/02.mp3", 3100), ("B-tmpfiles/01-finished.m4b", 3000)], "combine_components", ["S/01.mp3", "S/02.mp3"]),
    "components_over_other_edition": ([("B/01.mp3", 3000), ("B/02.mp3", 3100), ("B/Alternative Version/B.mp3", 5000)], "combine_components", ["B/01.mp3", "B/02.mp3"]),
    "identity_conflict": ([("77 Street.mp3", 1000)], "quarantine", []),
}


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(k, path, round((d or 0) * 1000), None if d is None else float(d), more[0] if more else 0) for k, (files, _, _) in CASES.items() for path, d, *more in files]
    files = spark.createDataFrame(rows, "group_key string, relative_path string, size long, duration double, chapters int")
    return files, spark.createDataFrame([("identity_conflict", ["directory and filename identities conflict"]), ("only_file", ["other"])], "group_key string, reasons array<string>")


def test_rules(frames):
    files, groups = frames
    decisions = R.decide(files, groups)
    got = {r.group_key: r for r in decisions.collect()}
    assert {k: (r.rule, r.state) for k, r in got.items()} == {k: (k.split("/")[0], state) for k, (_, state, _) in CASES.items()}
    chosen = {k: [] for k in CASES}
    for r in R.roles(files, decisions).orderBy("relative_path").collect():
        if r.role == "chosen":
            chosen[r.group_key].append(r.relative_path)
    assert chosen == {k: sorted(paths) for k, (_, _, paths) in CASES.items()}
    assert "1 missing" not in got["sequence_conflict"].conflicts[0] and "2 missing" in got["sequence_conflict"].conflicts[0] and "1 unreadable" in got["sequence_conflict/unread"].conflicts[0]
    assert got["one_target/two sets"].confidence == 0.98 and got["several_targets"].confidence == 0.9 and got["only_file/mp3"].conflicts == ["1 unreadable file(s)"]


def test_every_file_has_a_role(frames):
    files, groups = frames
    decisions = R.decide(files, groups)
    roles = R.roles(files, decisions)
    assert roles.count() == files.count()
    assert {tuple(r) for r in roles.where("group_key = 'like_containers/more' and role <> 'chosen'").select("relative_path", "role").collect()} == {("alternate.m4a", "alternate"), ("complete.mp3", "alternate"), ("broken.mp3", "problem")}
    assert R.decide(files.where("false"), groups).count() == 0


def test_first_container_of_repeated_paths(spark):
    """The shorter of two files of one path counts, in whatever order they come."""
    files = [("g", "Old/07.m4b", 264495, 105518.906), ("g", "Old/07.m4b", 279837, 104645.024154), ("g", "Old/01.mp3", 269149, 77292.745824), ("g", "Whole/Book.m4b", 11, 104259.45)]
    for rows in (files, files[::-1]):
        one = spark.createDataFrame(rows, "group_key string, relative_path string, size long, duration double").coalesce(1)
        assert R.decide(one).first().rule == "like_containers"


def test_paths_are_read_once(frames):
    """What paths say is a stored table's columns; no part of the choice matches patterns again."""
    assert "RLIKE" not in R.decide(*frames)._jdf.queryExecution().optimizedPlan().toString()


def test_marks_anywhere_in_a_directory(spark):
    """Folders under way and of other versions count at any depth, and whole names only."""
    paths = {"a-tmpfiles/b/x.mp3": (True, False), "a/tmpfile/x.mp3": (True, False), "tmpfiles.mp3": (False, False), "a/tmpfiles2/x.mp3": (False, False), "atmpfiles/x.mp3": (False, False), "a/Alt. Versions/b/x.mp3": (False, True), "halt version/x.mp3": (False, False), "alternate  version/x.mp3": (False, True)}
    rows = spark.createDataFrame([("g", p, 1, 1.0) for p in paths], "group_key string, relative_path string, size long, duration double")
    assert {r.relative_path: (r.under_way, r.explicit) for r in R.described(rows).collect()} == paths


def test_first_row_of_repeated_paths(spark, tmp_path):
    """of containers of one path the SQL, on one thread, takes the row that comes first in the table, be it the longer or the shorter."""
    import duckdb

    from tessera.plans import registry

    lines = [(1, 101620.0, 0.04, 0.03), (1, 103854.18, 0.09, 0.07), (2, 103854.18, 0.09, 0.07), (2, 101620.0, 0.04, 0.03)]
    lines = [(g, 10 * g + n, 4, 30.0, *price, "A", "O") for n, (g, *price) in enumerate(lines)]
    lines += [(g, 7, 4, 30.0, price, 0.0, 0.0, "N", status) for g in (1, 2) for price, status in ((76661.07, "F"), (20760.0, "O"), (11441.0, "O"))]
    schema = "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(lines, schema).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 5, 99670.61), (2, 5, 99670.61)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    db = duckdb.connect()
    db.execute("SET threads = 1")
    for t in ("lineitem", "orders"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("representation_choice", "representation_roles"):
        got, sql = registry.QUERIES[name](spark, str(tmp_path)).collect(), db.execute(registry.ORACLES[name]).fetchall()
        assert sorted(map(tuple, got)) == sorted(sql)
    assert {r[2] for r in sql if r[:2] == (1, "New/04.m4b")} != {r[2] for r in sql if r[:2] == (2, "New/04.m4b")}
