"""Sources, sinks, the event-log stream and the functions that SQL cannot express."""

import hashlib
import json

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import candidates
from tessera.plans import registry
from tessera.sources import media, sinks
from tessera.streaming import event_log


def test_scan(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    for name, body in {"x.MP3": b"1", "bare": b"\0\0\0\x18ftypM4A ", "a b/y.m4b": b"22", "a b/100% ü+.mp3": b"3", "note.txt": b"ID3", "plain": b"hello", "id": b"ID3\x04"}.items():
        (tmp_path / name).write_bytes(body)
    found = media.scan(spark, str(tmp_path)).collect()
    assert sorted((r.relative_path, r.size) for r in found) == [("a b/100% ü+.mp3", 1), ("a b/y.m4b", 2), ("bare", 12), ("id", 4), ("x.MP3", 1)]


def test_probe(spark):
    good = {"streams": [{"codec_type": "video"}, {"codec_type": "audio", "codec_name": "aac", "channels": 2, "tags": {"TITLE": "stream", "Lang": "en"}}], "format": {"duration": "61.5", "tags": {"Title": "T"}}, "chapters": [{"start_time": "0", "end_time": "60"}]}
    bad = good | {"chapters": [{"start_time": "5", "end_time": "nan"}]}
    rows = [(1, json.dumps(good)), (2, json.dumps(bad)), (3, json.dumps({"streams": []})), (4, "{"), (5, None)]
    out = {r.id: r for r in media.parse_probe(spark.createDataFrame(rows, "id int, report string"), "report").collect()}
    assert out[1].error is None and out[1].probe.duration == 61.5 and out[1].probe.tags == {"title": "T", "lang": "en"}
    assert [out[i].error for i in (2, 3, 4, 5)] == ["invalid chapters", "no audio stream", "unreadable", "unreadable"]


def test_group_directory(spark):
    paths = spark.createDataFrame([("A/B/CD1/1.mp3",), ("A/B/disc 02/1.mp3",), ("A/B/1.mp3",), ("1.mp3",), ("A/B/Part 1/x.mp3",), ("A/B/CD.1/x.mp3",), ("A/B/(1 of 3)/x.mp3",), ("A/B/Partly 1/x.mp3",)], "p string")
    assert [r[0] for r in paths.select(media.group_directory(F.col("p"))).collect()] == ["A/B", "A/B", "A/B", "", "A/B", "A/B", "A/B", "A/B/Partly 1"]


def test_sinks(spark, tmp_path):
    files = spark.createDataFrame([("a", None, True), ("b", "broken", None)], "path string, error string, cached boolean")
    assert tuple(sinks.report(files).first()) == (2, 1, 1)
    books = spark.createDataFrame([("a", "failed"), ("b", "done")], "id string, state string")
    sinks.manifest(books, ["failed", "quarantined"], str(tmp_path / "m"))
    assert [r.id for r in spark.read.json(str(tmp_path / "m")).collect()] == ["a"]


def test_event_log(spark, tmp_path):
    log, out, at = (str(tmp_path / n) for n in ("log", "out", "at"))
    schema = "seq long, book string, state string"
    for rows in ([(1, "a", "new"), (2, "b", "new"), (3, "a", "done")], [(4, "b", "failed")]):
        sinks.append_events(spark.createDataFrame(rows, schema), log)
        event_log.upsert(event_log.read(spark, log, schema), ["book"], "seq", out, at).awaitTermination(120)
    assert sorted(map(tuple, event_log.latest(spark, ["book"], "seq", out).collect())) == [(3, "a", "done"), (4, "b", "failed")]


def test_windowed_counts(spark, tmp_path):
    events = "/root/testdata/sf0.001/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(events).schema).parquet(events + "*")
    name = "counts"
    stream = event_log.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "60 days", "1 day")
    stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table(name).agg(F.sum("n")).first()[0] == spark.read.parquet(events).count()


def test_text(spark):
    pairs = spark.createDataFrame([("The Way of Kings", "the way of kings"), ("Dune", "Emma"), (None, "x"), ("Straße ﬁn", "a")], "a string, b string")
    got = pairs.select(T.normalized(F.col("a")), candidates.title_similarity(F.col("a"), F.col("b"))).collect()
    assert got[0][1] == 1.0 and 0 <= got[1][1] < 0.35 and got[2] == (None, 0.0) and got[3][0] == "strasse fin"
    for name in ("title_similarity", "normalized_titles"):
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_digests_tell_null_from_nothing(spark):
    row = spark.range(1).select(F.lit(1).alias("a"), F.lit(None).cast("int").alias("b"), F.struct(F.lit(None).cast("int").alias("x")).alias("c"))
    digests = row.select(T.json_digest(a=F.col("a")), T.json_digest(a=F.col("a"), b=F.col("b")), T.json_digest(a=F.col("a"), c=F.col("c"))).first()
    assert len(set(digests)) == 3
    assert digests[1] == hashlib.sha256(b'{"a":1,"b":null}').hexdigest() and digests[2] == hashlib.sha256(b'{"a":1,"c":{"x":null}}').hexdigest()


def test_names(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.safe_name(F.lit(" ..A/B?  c. "))) == "A B c" and one(T.safe_name(F.lit("..."))) == "Unknown" and one(T.safe_name(F.lit(None).cast("string"))) == "Unknown"
    assert one(T.safe_name(F.lit("x" * 159 + " yz"))) == "x" * 159
    assert one(T.output_path(F.lit("Frank Herbert"), F.lit("Dune"), F.lit("2"), F.lit("Dune: Messiah"), "m4b")) == "Frank Herbert/Dune/02 - Dune Messiah/Frank Herbert - Dune Messiah.m4b"
    assert one(T.output_path(F.lit("A: Writer"), F.lit(None).cast("string"), F.lit("2"), F.lit("A/B?"), "m4b")) == "A Writer/A B/A Writer - A B.m4b"
    names = spark.createDataFrame([("J.R.R.  Tolkien",), ("JOSÉ Ｗ",), (None,)], "n string")
    assert [tuple(r) for r in names.select(T.person_key("n"), T.display_key("n"), T.compact_key("n")).collect()] == [("j r r tolkien", "j.r.r. tolkien", "jrrtolkien"), ("josé w", "josé w", "joséw"), (None, None, None)]
    spelled = spark.createDataFrame([("JAMES S. A. COREY",), ("james s. a. corey",), ("James S. A. Corey",), ("James S.A. Corey",)], "n string")
    assert spelled.orderBy(F.desc(T.spelling_rank(F.col("n")))).first().n == "James S. A. Corey"
