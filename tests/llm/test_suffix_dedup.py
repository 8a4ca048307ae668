"""Suffix dedup at its edges: slices without a window, long texts, hot keys, and the sorts' own pieces."""

import cProfile
import hashlib
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import suffix_dedup


def found(frame):
    out = frame.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")), F.size("spans"), F.sha2("kept", 256))
    return sorted(map(str, map(tuple, out.collect())))


def want(rows):
    return sorted(map(str, suffix_dedup.brute(rows)))


@pytest.mark.parametrize(
    "rows",
    [
        [(1, "y"), (2, "zz"), (3, None)],
        [(1, ""), (2, None), (None, ""), (None, None), (2, None)],
        [(1, "y"), (2, "ab " * 230_000), (3, "z"), (4, "ab " * 20)],
        [(k, "short text of some words") for k in range(50)],
    ],
)
def test_slices_without_windows(spark, rows):
    assert found(suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))) == want(rows)


def test_long_text(spark):
    """A text of 5 MB, of which later ones repeat a piece."""
    rng = random.Random(1)
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=5_000_000))
    rows = [(1, long), (2, "!" * 40 + long[4_000_000:4_000_300] + "?" * 40), (3, long[100:149]), (4, long[:50])]
    out = {r.doc_id: [tuple(s) for s in r.spans] for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: [], 2: [(40, 340)], 3: [], 4: [(0, 50)]}


def crowd():
    """A third of the texts hold one passage, as many a frequent phrase in other surroundings."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(60))
    phrase = " ".join(word() for _ in range(6))
    rows = []
    for k in range(240):
        own = [word() for _ in range(20)]
        rows.append((k, " ".join([*own[:10], passage[k % 7 :] if k % 3 == 0 else phrase if k % 3 == 1 else "", *own[10:]])))
    return [*rows, (None, passage), (5, passage + phrase), (500, rows[3][1]), (501, rows[3][1])]


def test_hot_keys(spark):
    rows = crowd()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain, sampled = suffix_dedup.suffix_dedup(docs), suffix_dedup.suffix_dedup(docs, share=0.01, least=8)
    assert found(plain) == found(sampled) == want(rows)
    keyed = docs.select(F.unhex(F.md5("text")).alias("digest"), F.col("text").cast("binary").alias("text"))
    hot = suffix_dedup._hot_keys(keyed, len(rows), 128, share=0.01, least=8)
    assert len(hot) == suffix_dedup.LEVELS and len(hot[-1]), "the passage stays hot, so the joined path is tested"


def test_finer_keys_cover_the_same_windows():
    data = np.frombuffer(" ".join(t for _, t in crowd()[:40]).encode(), np.uint8)
    off, every = np.array([0, len(data) // 2, len(data)]), range(2)
    row, key, start, end, _ = suffix_dedup._segments(data, off, every)
    for hot in ([key[::3]], [key, key[:0]], [np.unique(key), np.unique(key)]):
        r, k, a, b, _ = suffix_dedup._segments(data, off, every, [np.sort(x) for x in hot])
        cover = lambda x, y: np.concatenate([np.arange(i, j) for i, j in zip(x, y, strict=True)])
        assert (cover(a, b) == cover(start, end)).all() and (np.diff(r) >= 0).all()


def packed(rows):
    """The segments of all texts in one bucket, as _pack_segments gives them."""
    digest = lambda t: hashlib.md5(t.encode()).digest()
    columns = [pa.array([digest(t) for _, t in rows]), pa.array([i for i, _ in rows]), pa.array([t.encode() for _, t in rows])]
    batch, hot = pa.RecordBatch.from_arrays(columns, names=["digest", "id", "text"]), SimpleNamespace(value=[])
    keys = {}
    for part in suffix_dedup._shared_keys(suffix_dedup._pack_keys(1, hot, [batch])):
        for name, own in zip(*(c.to_pylist() for c in part.columns), strict=True):
            keys.setdefault(name, []).append(own)
    lists = pa.array([keys.get(digest(t), []) for _, t in rows], pa.list_(pa.binary()))
    return list(suffix_dedup._pack_segments(1, hot, [pa.RecordBatch.from_arrays([*columns, lists], names=["digest", "id", "text", "keys"])]))


@pytest.mark.parametrize("size", [1, 1 << 19])
def test_sort_works_by_arrays(monkeypatch, size):
    """The sort finds what brute force does, and its calls do not grow with the rows that own segments."""
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", size)
    rows = list({t: (i, t) for i, t in crowd() if i is not None}.values())
    rows += [(1000 + i, f"{i:09d}" + t[:90] + "ab" * 40 + f"{i:09d}" * 8) for i, (_, t) in enumerate(rows)]
    batches = packed(rows)
    profile = cProfile.Profile()
    found = {}
    for part in profile.runcall(lambda: list(suffix_dedup._sort(batches))):
        for name, spans in zip(*(c.to_pylist() for c in part.columns), strict=True):
            assert name not in found
            found[name] = np.frombuffer(spans, np.uint32).reshape(-1, 2)
    for (i, t), (_, _, gone, n, _) in zip(rows, suffix_dedup.brute(rows), strict=True):
        s, e = suffix_dedup.K.merged(*found.get(hashlib.md5(t.encode()).digest(), np.zeros((0, 2), np.int64)).astype(np.int64).T)
        assert (int((e - s).sum()), len(s)) == (gone, n), i
    if size > 1:
        calls = sum(x.callcount for x in profile.getstats())
        assert calls < 10 * sum(map(len, found.values())), calls
