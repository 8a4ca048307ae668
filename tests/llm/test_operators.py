"""The corpus operators against brute force, on texts with nulls, blanks, ties, repeats and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chunk_dedup, decontaminate, language, licenses, line_dedup, media, mixing, ngram_join, suffix_dedup, toxicity

SF = "/root/testdata/sf0.001"
EXTRA = [(900, None), (901, ""), (902, "  \n"), (903, "a b"), (904, "A  b"), (905, "x" * 3000), (None, "x" * 200), (906, "x" * 200), (906, "x" * 200), (907, "é" * 60 + "\n\n")]


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(90).collect()] + EXTRA


@pytest.fixture(scope="module")
def docs(spark, rows):
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    # names that the operators use inside must not clash with the input's
    return plain.withColumns({"id": F.lit("own"), "digest": F.lit(1), "source": F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("s"), F.col("doc_id") % 3)), "lang": F.lit("en"), "n_chars": F.length("text").cast("long")})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def same(frame, want):
    assert sorted(map(str, map(tuple, frame.collect()))) == sorted(map(str, want))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=60))
def test_difference_cover(s):
    got = suffix_dedup.difference_cover(np.array(s, np.int64), 1000)
    assert got.tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_dedup(docs, rows, empty):
    out = suffix_dedup.suffix_dedup(docs)
    same(out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")), F.size("spans"), F.sha2("kept", 256)), suffix_dedup.brute(rows))
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_ngram_join(docs, rows, empty):
    sets = {i: shingles(t) for i, t in rows if i is not None} | {1 << 62: shingles(dict((i, t) for i, t in rows)[None])}
    links, root = defaultdict(set), {i: i for i in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if i != j and a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i].add(j)
    for _ in sets:
        root = {i: min([root[i], *(root[j] for j in links[i])]) for i in sets}
    name = lambda i: None if i == 1 << 62 else i
    want = [(i, name(root[k]), len(links[k])) for i, _ in rows for k in [1 << 62 if i is None else i]]
    same(ngram_join.ngram_join(docs), want)
    assert ngram_join.ngram_join(empty).count() == 0


def test_tiles_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 4)
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*base, f"own{k}"])) for k in range(23)]
    out = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))
    same(out, [(k, 0, 22) for k in range(23)])


def test_line_dedup(docs, rows, empty):
    want = [(doc, taken, hashlib.sha256(text.encode()).hexdigest()) for doc, text, taken in lines_left(rows)]
    same(line_dedup.line_dedup(docs).select("doc_id", "removed", F.sha2("kept", 256)), want)
    assert line_dedup.stage(None, docs, SF).columns == docs.columns
    assert line_dedup.line_dedup(empty).count() == 0


def test_lines_resist_shifts():
    lines = [f"line {i}".encode() for i in range(200)]
    a, b = line_dedup.line_chunks(b"\n".join(lines)), line_dedup.line_chunks(b"\n".join([b"new", *lines]))
    assert a[2:] == b[-len(a) + 2 :]


def test_copies_leave_no_lines(spark):
    """Copies of a text of lines go as a whole, in the stage as well; a text of one line stays."""
    texts = ["\n".join(f"text {k} has a line {n}" for n in range(k + 2)) for k in range(30)]
    rows = [(1000 * copy + k, t) for copy in range(3) for k, t in enumerate(texts)] + [(5000, "alone"), (5001, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    want = [(i, t) for i, t in rows if i < 1000 or i >= 5000]
    assert sorted(tuple(r) for r in line_dedup.line_dedup(docs).where("kept <> X''").select("doc_id", F.decode("kept", "UTF-8")).collect()) == want
    assert sorted(tuple(r) for r in line_dedup.stage(spark, docs, SF).select("doc_id", "text").collect()) == want
    assert all(len(c) > 1 for t in texts for c in line_dedup.line_chunks(t.encode()))


def test_chunk_dedup(docs, rows, empty):
    def chunks(text):
        ends = chunk_dedup.cuts(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0] if text else []
        return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    own = [(1 << 62 if i is None else i, chunks((t or "").encode())) for i, t in rows]
    low = {}
    for i, cs in own:
        for c in cs:
            low[c] = min(low.get(c, 1 << 62), i)
    want = []
    for (i, cs), (doc, text) in zip(own, rows, strict=True):
        kept = [c for n, c in enumerate(cs) if len(c) < chunk_dedup.LEAST or (low[c] == i and c not in cs[:n])]
        want.append((doc, len(cs), hashlib.sha256(b"".join(kept)).hexdigest()))
        assert b"".join(cs) == (text or "").encode()
    same(chunk_dedup.substring_dedup(docs).select("doc_id", "n_chunks", F.sha2("kept", 256)), want)
    assert chunk_dedup.substring_dedup(empty).count() == 0


def test_decontaminate_both_ways(spark, docs, rows, empty):
    words = [t.split() for _, t in rows if t and len(t.split()) > 40]
    items = [(1, " ".join(words[0][3:17])), (2, "a B"), (3, None), (4, " ".join(words[1][:10])), (4, " ".join(words[1][:10])), (None, "a b"), (5, " ".join(words[2][5:13]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    fast, slow = (decontaminate.decontaminate(docs, bench, size) for size in (1 << 20, -1))
    same(fast, [tuple(r) for r in slow.collect()])
    hit = {r.doc_id: (r.n_hit, r["items"]) for r in fast.collect()}
    assert hit[903] == hit[904] == (2, ["2"]) and hit[900] == (0, [])
    assert sum(n >= 10 for n, _ in hit.values()) >= 2
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.where("false")).where("n_hit > 0").count() == 0


def test_mixing(docs, rows, empty):
    out = mixing.mix(docs, block=16).toPandas()
    assert len(out) == len(rows)
    whole = out["size"].sum()
    by = out.groupby("place").agg(size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"), own=("size", "sum"))
    assert (by["size"] == by["own"]).all() and abs(by["target"].sum() - 1.5 * whole) < 1e-6 * whole
    assert (by["target"] <= 2 * by["size"] + 1e-6).all() and (abs(by["taken"] - by["target"]) <= 0.02 * by["target"] + 20).all()
    assert (out["taken"] <= 2 * out["size"]).all()
    again = mixing.mix(docs, block=16).toPandas()
    assert sorted(out["taken"]) == sorted(again["taken"])
    assert mixing.mix(empty).count() == 0
    assert mixing.stage(None, docs, SF).count() == mixing.mix(docs).agg(F.sum("copies")).first()[0]


def test_media():
    rng = np.random.default_rng(0)
    for shape in ((5, 7), (6, 4, 3), (1, 1)):
        x = rng.integers(0, 256, shape).astype(np.uint8)
        assert (media.decode(media.encode_bmp(x)) == x).all()
    x = rng.integers(0, 256, (48, 24)).astype(np.uint8)
    assert (media.decode(media.encode_pgm(x)) == x).all()
    small = media.area_resize(x, 12, 6)
    assert np.allclose(small, x.reshape(12, 4, 6, 4).mean(axis=(1, 3)))
    assert np.isclose(media.area_resize(x, 7, 5).mean(), x.mean())
    for bad in (b"", b"P5 2 2 255 a", b"BM"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_text_pictures(docs, rows, empty):
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, (len(raw) + 575) // 576 * 576) - len(raw))
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    out = media.text_pictures(docs)
    same(out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"), want)
    assert media.decode_column(out.select("media"), "media").where("media_error is not null").count() == 0
    assert media.text_pictures(empty).count() == 0


def test_gradient():
    net = language.Reader(["a", "b"])
    x, mask = language.padded([b"hello", b"abc", b"q"])
    y = np.array([0, 1, 0])
    _, grad = net.gradient(x, mask, y)
    for name in ("fw", "bu", "fc", "o", "e"):
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        was, losses = net.p[name][at], []
        for step in (1e-2, -1e-2):
            net.p[name][at] = was + step
            losses.append(net.gradient(x, mask, y)[0])
        net.p[name][at] = was
        assert abs((losses[0] - losses[1]) / 2e-2 - grad[name][at]) < 0.05 * abs(grad[name][at]) + 1e-4


def test_language(spark, docs, empty):
    train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language.train(train.where("doc_id % 2 = 0"), fit_docs=60, steps=150)
    out = language.identify(train.where("doc_id % 2 = 1"), net)
    assert out.where("lang = lang_pred").count() >= 0.97 * out.count()
    odd = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, net).collect()}
    assert odd[900] == odd[901] == odd[902] == ("und", 0.0) and odd[905][0] != "und"
    text = "Bonjour  le monde\n".encode()
    spans = language.spans_of(net, text)
    assert [s["start"] for s in spans] == [0, *(s["end"] for s in spans[:-1])] and spans[-1]["end"] == len(text)
    assert language.identify(docs, language.train(empty)).where("lang_pred <> 'und'").count() == 0


def test_toxicity(spark, docs, empty):
    clean = [f"the quiet tree {w} stands by the river {i}" for i, w in enumerate("oak elm ash fir yew bay fig".split() * 20)]
    bad = [f"the idiot tree {w} you are a worthless clown {i}" for i, w in enumerate("oak elm ash fir yew bay fig".split() * 20)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(clean + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i >= len(clean))) for i in range(len(clean + bad))], "doc_id long, quality int, toxic int")
    bag = toxicity.train(d, labels)
    new = spark.createDataFrame([(0, "the oak tree stands by the river"), (1, "what an idiiot, worthles clowns"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score(new, bag).collect()}
    assert got[0] == 0 and got[1] == 1
    assert toxicity.score(empty, bag).count() == 0
    toxicity.score(docs, toxicity.train(empty, labels)).collect()


def test_licenses(spark):
    files = [(1, "a/LICENSE", "MIT\nReleased under the MIT License."), (2, "a/b/c.py", "print()"), (3, "a/x/y.py", "# Licensed under the Apache License, Version 2.0.\nx"), (4, "a/x/z.py", None), (5, "q/r.py", "nothing"), (6, None, "text"), (6, None, "text"), (7, "w/a.txt", "Released under the MIT License."), (7, "w/a.txt", "other")]
    out = sorted((r.file_id, r.own_license, r.license, r.inherited_from) for r in licenses.scan(spark.createDataFrame(files, "file_id long, path string, text string")).collect() if r.file_id < 6)
    assert out == [(1, "MIT", "MIT", None), (2, None, "MIT", "a"), (3, "Apache-2.0", "Apache-2.0", None), (4, None, "Apache-2.0", "a/x"), (5, None, None, None)]
    clash = spark.createDataFrame(files, "file_id long, path string, text string").withColumns({c: F.lit("own") for c in ("digest", "dir", "own_path", "near", "unit", "license", "holder")})
    mixed = [(r.own_license, r.license, r.inherited_from) for r in licenses.scan(clash).where("file_id = 7").collect()]
    assert sorted(mixed, key=str) == sorted([("MIT", "MIT", None), (None, "MIT", "w")], key=str)
    assert [(r.license, r.inherited_from) for r in licenses.scan(clash).where("file_id = 6").collect()] == [(None, None)] * 2
    assert licenses.scan(spark.createDataFrame([], "file_id long, path string, text string")).count() == 0


def test_licenses_of_the_root(spark):
    """The root's license holds for all below it, of relative and of absolute paths; long texts and ties are scanned whole."""
    files = [(1, "LICENSE", "The MIT License (MIT)"), (2, "src/x.py", "y"), (3, "/abs/z", ""), (4, "top", None), (5, "deep/a/b/c", "word " * 200_000 + "\n\nLicensed under the ISC license.\n"), (6, "deep/a/b/d", "none")]
    files += [(100 + k, None, f"other words {k}") for k in range(40)]
    out = {r.file_id: (r.license, r.inherited_from) for r in licenses.scan(spark.createDataFrame(files, "file_id long, path string, text string")).collect() if r.file_id < 100}
    assert out == {1: ("MIT", None), 2: ("MIT", ""), 3: ("MIT", ""), 4: ("MIT", ""), 5: ("ISC", None), 6: ("ISC", "deep/a/b")}


def test_licenses_whole(spark):
    """Bodies, standard headers over several lines, SPDX identifiers and common notices, beside other text."""
    wrap = lambda t, mark="": "\n".join(mark + t[i : i + 60] for i in range(0, len(t), 60))
    head = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version {0} of the License, or\n# (at your option) any later version.\n#\nimport os\nprint(os.name)"
    cases = [
        ("MIT", "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + licenses._MIT.replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")),
        ("MIT", "/* SPDX-License-Identifier: MIT */\nint x;"), ("MIT", "// Licensed under the MIT license.\nlet x;"), ("GPL-3.0", "# SPDX-License-Identifier: GPL-3.0-only\nx = 1"), ("Zlib", "# SPDX-License-Identifier: Zlib\nx = 1"), (None, "# SPDX-License-Identifier: WTFPL\nx = 1"), ("GPL-3.0", "Distributed under GNU GPL version 3"), ("BSD-3-Clause", "BSD 3-Clause"), ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
        ("GPL-3.0", head.format(3)), ("GPL-2.0", head.format(2)), ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nPreamble"), ("Apache-2.0", "code\n\n" + wrap(licenses._APACHE) + "\n\nmore code"),
        ("BSD-2-Clause", licenses._BSD.format("")), ("BSD-3-Clause", licenses._BSD.format(licenses._THIRD)), (None, "nothing of the kind"), (None, "wir gehen mit dem Hund"),
    ]
    files = spark.createDataFrame([(i, f"{i}/f", t) for i, (_, t) in enumerate(cases)] + [(100 + i, f"{100 + i}/f", f"other text {i}") for i in range(200)], "file_id long, path string, text string")
    out = {r.file_id: r.own_license for r in licenses.scan(files).collect()}
    assert [out[i] for i in range(len(cases))] == [n for n, _ in cases]
    assert all(out[100 + i] is None for i in range(200))


def test_sql(spark):
    import duckdb

    from tessera.llm import queries

    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, SF).toPandas(), db.execute(sql).df()
        names = sorted(got.columns)
        assert names == sorted(want.columns)
        a, b = (sorted(map(str, f[names].astype(object).where(f[names].notna(), None).itertuples(index=False, name=None))) for f in (got, want))
        assert a == b, name


def lines_left(rows):
    """(id, text without repeated chunks, lines taken) of each row, by brute force."""
    chunks = [(1 << 62 if i is None else i, line_dedup.line_chunks((t or "").encode())) for i, t in rows]
    low = {}
    for i, own in chunks:
        for c in own:
            low[b"\n".join(c)] = min(low.get(b"\n".join(c), 1 << 62), i)
    for (i, own), (doc, _) in zip(chunks, rows, strict=True):
        seen, kept = set(), []
        for c in own:
            whole = b"\n".join(c)
            if len(c) < 2 or (low[whole] == i and whole not in seen):
                kept += c
            seen.add(whole)
        yield doc, b"\n".join(kept).decode(), sum(map(len, own)) - len(kept)


def first_of_class(rows):
    """Ids whose class of similar shingle sets holds no smaller one."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    links = [(i, j) for i, a in sets.items() for j, b in sets.items() if i < j and a and b and 5 * len(a & b) >= 4 * len(a | b)]
    for _ in sets:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    return {i for i in sets if root[i] == i}


def leaks(rows, items):
    """Ids with a window of an item."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {tuple(w[i : i + 10]) for t in items for w in [words(t)] for i in range(max(0, len(w) - 9) or 1) if w}
    sizes = {len(w) for w in windows}
    return {i for i, t in rows for w in [words(t)] for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows}


def test_pipeline_by_stages(spark, tmp_path):
    """Each stage's rows against brute force on its own input, with planted copies, passages and texts without letters.

    The near copy is one line: of one with its lines, line dedup leaves the changed lines, which resemble nothing.
    """
    import corpus_pipeline

    base = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 80").orderBy("item_id").first().text
    old = [(r.doc_id, r.text) for r in base.orderBy("doc_id").limit(120).collect() if len(r.text.split()) > 80][:6]
    block = "\n".join(f"a line that many documents share, number {k}" for k in range(60))
    new = [(5000, None), (5001, ""), (5002, "12 34 \n 56"), (5003, old[0][1]), (5004, " ".join(old[1][1].split()) + " indeed"), (5005, "and then " + item + " so it goes"), (5006, old[2][1] + "\n" + block), (5007, old[3][1] + "\n" + block), (5008, old[4][1] + " " + item.upper())]
    more = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in new], base.schema)
    rows = lambda d: [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    stages, docs, steps = dict(corpus_pipeline.STAGES), base.unionByName(more), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.columns == base.columns, name
        steps.append((name, rows(docs), rows(out)))
        docs = out
    by = {n: (a, b) for n, a, b in steps}
    assert list(stages) == list(by)

    was, now = by["language_id"]
    lettered = [r for r in was if any(c.isalpha() for c in r[1] or "")]
    assert set(now) <= set(lettered) and len(now) >= 0.97 * len(lettered) and not {5000, 5001, 5002} & {i for i, _ in now}

    was, now = by["line_dedup"]
    assert sorted(now) == sorted((i, t) for i, t, taken in lines_left(was) if t or not taken)
    assert any(taken for _, _, taken in lines_left(was))

    was, now = by["ngram_join"]
    first = first_of_class(was)
    assert sorted(now) == sorted(r for r in was if r[0] in first)
    assert {5003, 5004}.isdisjoint(i for i, _ in now)

    was, now = by["decontaminate"]
    hit = leaks(was, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert sorted(now) == sorted(r for r in was if r[0] not in hit) and 5005 in hit and 5008 in hit | ({5008} - {i for i, _ in was})

    was, now = by["mixing"]
    times, size = Counter(now), {i: len(t.split()) for i, t in was}
    assert set(times) <= set(was) and max(times.values()) <= 2
    assert abs(sum(size[i] * k for (i, _), k in times.items()) - 1.5 * sum(size.values())) <= 0.05 * sum(size.values())


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    before = spark.read.parquet(f"{SF}/documents.parquet")
    assert out.columns == before.columns and 0 < out.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontaminate", "mixing"]
