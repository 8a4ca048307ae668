"""Operators without SQL against plain loops: targets, gear chunks, media features, held-out accuracy."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chunk_dedup, kernels, language, media, mixing, toxicity

SF, BIG = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def held(doc_id, parts, part):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % parts == part


def shares(sizes, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    """Targets by the contract: shares by weight, stopped at most x size, the excess dealt again by weight."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, open_now = share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_now:
        part, whole = left, sum(weight[s] for s in open_now)
        left = 0.0
        for s in sorted(open_now, key=str):
            target[s] += part * weight[s] / whole
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_now.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 900, "c": 5}, {"a": 1, "B": 1, None: 50, "é": 7, "z": 0}, {"x": 40}, {f"s{k}": (k * 37) % 101 for k in range(20)}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    want = shares(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in got)


def test_mixing_query(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").collect()
    count = {r.doc_id: len([w for w in kernels_words(r.text)]) for r in docs}
    own = {}
    for r in docs:
        own[r.source] = own.get(r.source, 0) + count[r.doc_id]
    want, source, taken = shares(own), {r.doc_id: r.source for r in docs}, dict.fromkeys(own, 0)
    for r in mixing.query(spark, BIG).collect():
        assert (r["size"], r.source_size) == (count[r.doc_id], own[source[r.doc_id]]) and r.taken <= 2 * r["size"]
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 * r.target
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] + 5 for s in own)


def kernels_words(text):
    import re

    return re.findall("[^\\x20\\x09-\\x0D]+", text or "")


def plain_chunks(text):
    """Gear hash byte by byte: after each byte twice the hash before plus the byte's value, of 32 bits."""
    table = [int(x) >> 32 for x in kernels.byte_table(7)]
    ends, last, h = [], 0, 0
    for at, byte in enumerate(text, 1):
        h = ((h << 1) + table[byte]) & 0xFFFFFFFF
        if at - last == chunk_dedup.MOST + 1:
            last += chunk_dedup.MOST
            ends.append(last)
        if h < (1 << 32) // chunk_dedup.MEAN_GAP and at - last >= chunk_dedup.LEAST:
            ends.append(at)
            last = at
    return ends if not text or ends and ends[-1] == len(text) else [*ends, len(text)]


def test_chunks_by_a_plain_loop(spark):
    texts = [(r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()] + [b"", b"x", b"a" * 5000, bytes(range(256)) * 30]
    for t in texts:
        assert chunk_dedup.cuts(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] == plain_chunks(t)


def test_media_query(spark):
    """Every column from the text alone, with features by plain loops, and equal values for equal texts."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(30).collect()] + [(1001, None), (1002, ""), (None, "é" * 700), (1003, "é" * 700), (1004, "x" * 3_000_001)]
    out = media.text_pictures(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by_text = {}
    for r in out:
        text = next(t for i, t in rows if i == r.doc_id)
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        x = np.frombuffer(payload, np.uint8).reshape(-1, 24)
        stored = b"P5\n24 %d\n255\n" % len(x) + payload if len(raw) % 2 else bmp(x)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, bytes(r.media)) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), stored)
        if len(x) < 3000:
            small = mean_areas(x.astype(float), 8, 9).round(6)
            bits = "".join("1" if small[i, j] < small[i, j + 1] else "0" for i in range(8) for j in range(8))
            assert r.feature[:16] == f"{int(bits, 2):016x}"
            tile = np.clip(np.rint(mean_areas(x.astype(float), 24, 24)), 0, 255)
            assert abs(np.load(__import__("io").BytesIO(r.tile)).astype(int) - tile).max() <= 1
        assert by_text.setdefault(raw, (r.media, r.tile, r.feature)) == (r.media, r.tile, r.feature)


def bmp(x):
    head = struct.pack("<2sIHHI", b"BM", 14 + 40 + 1024 + x.size, 0, 0, 14 + 40 + 1024)
    info = struct.pack("<IiiHHIIiiII", 40, x.shape[1], x.shape[0], 1, 8, 0, x.size, 2835, 2835, 256, 0)
    return head + info + b"".join(bytes([i, i, i, 0]) for i in range(256)) + x[::-1].tobytes()


def mean_areas(x, h, w):
    """Means over fractional rectangles, a weight for each source row and column."""
    def weights(size, parts):
        m = np.zeros((parts, size))
        for k in range(parts):
            a, b = k * size / parts, (k + 1) * size / parts
            for i in range(int(a), min(size, int(np.ceil(b)))):
                m[k, i] = max(0.0, min(b, i + 1) - max(a, i))
        return m / (size / parts)

    return weights(x.shape[0], h) @ x @ weights(x.shape[1], w).T


GREY = b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + 8) + struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, 8, 0, 4, 0, 0, 2, 0) + bytes([0, 0, 0, 0, 9, 9, 9, 0])


@pytest.mark.parametrize("raw, want", [
    (b"P1\n# c\n3 1\n1 0 1\n", [[0, 255, 0]]), (b"P2 2 1 4 0 4", [[0, 255]]), (b"P3 1 1 255 1 2 3", [[[1, 2, 3]]]), (b"P4 3 1\n\xa0", [[0, 255, 0]]),
    (b"P5 2 1 65535\n\xff\xff\x00\x00", [[255, 0]]), (b"P5 1 1 15\n\x0f", [[255]]), (GREY + b"\x00\x01\x00\x00", [[0, 9]]),
])
def test_formats(raw, want):
    assert media.decode(raw).tolist() == want


BAD = [b"", b"P5", b"P5 0 0 255 ", b"P5 2 2 255 a", b"P5 2 2 0 aaaa", b"P7 1 1 255 a", b"P5 99999999999 1 255 a", b"P2 2 1 4 0 9", b"P2 1 1 4", b"P4 9 1\na", b"BM", GREY + b"\x00\x02\x00\x00", GREY[:20], b"BM" + b"\xff" * 80, b"\x00" * 100]


def test_broken_pictures_give_reasons(spark):
    frame = spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(BAD)] + [(99, None), (100, bytearray(b"P5 1 1 255\na"))], "k long, raw binary").withColumn("width", F.lit("own"))
    with pytest.raises(ValueError, match="prefix"):
        media.decode_column(frame, "raw")
    out = {r.k: r for r in media.decode_column(frame, "raw", prefix="m_").collect()}
    assert all(out[k].m_media_error and out[k].m_tile is None for k in [*range(len(BAD)), 99])
    assert out[100].m_media_error is None and out[100].m_width == 1 and out[100].width == "own"


def test_language_query(spark):
    out = {r.doc_id: r for r in language.query(spark, BIG).collect()}
    docs = spark.read.parquet(f"{BIG}/documents.parquet").collect()
    assert all(out[r.doc_id].held_out == held(r.doc_id, 4, 2) and 0 <= out[r.doc_id].score <= 1 for r in docs)
    tried = [r for r in docs if held(r.doc_id, 4, 2)]
    assert sum(out[r.doc_id].lang_pred == r.lang for r in tried) >= 0.97 * len(tried)


def test_language_windows():
    """Windows cover every byte once and cut no character; a label has the context of other words."""
    for text in ("é" * 1000, "ab " * 500, "x", "", "\U0001f600" * 300, "a" * 256, "a" * 257):
        raw = text.encode()
        w = language.windows_of(raw)
        assert b"".join(raw[b:c] for _, b, c, _ in w) == raw
        for a, _, _, d in w:
            raw[a:d].decode()
    assert language.windows_of(b"\x80" * 1000)[-1][2] == 1000
    net = language.Reader(["a", "b"], seed=1)
    p = lambda t: next(language.read(net, [t]))[2]
    assert not np.allclose(p(b"one two")[4:], p(b"and two")[4:]), "the state runs through the blank"
    long = b"some words of a long text " * 60
    whole = net.probabilities(np.frombuffer(long, np.uint8)[None])[0].mean(axis=0)
    assert abs(language.pooled(net, [long])[0] - whole).max() < 0.01


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "words", None, "s", 5), (2, "12", None, "s", 2), (3, None, None, "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in language.stage(spark, docs, SF).collect()] == [1]
    long = spark.createDataFrame([(k, ("der Hund und die Katze " if k % 2 else "the dog and the cat ") * 3000, "de" if k % 2 else "en") for k in range(8)], "doc_id long, text string, lang string")
    net = language.train(long, steps=60)
    assert net.langs == ["de", "en"] and language.identify(long, net).where("lang = lang_pred").count() == 8


def test_toxicity_query(spark):
    out = {r.doc_id: r for r in toxicity.query(spark, BIG).collect()}
    ids = [r.doc_id for r in spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id").collect()]
    assert sorted(out) == sorted(ids) and all(out[i].held_out == held(i, 5, 0) and 0 <= out[i].score <= 1 and out[i].predicted == (out[i].score >= 0.5) for i in ids)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    clean = [i for i in ids if labels.get(i) == 0 and held(i, 5, 0)]
    assert sum(out[i].predicted for i in clean) <= 0.1 * len(clean)


def test_toxicity_ties_and_repeats(spark):
    """Repeated and contradictory labels, repeated rows, one very long text with few bad words."""
    clean, bad = [f"the quiet tree stands by river {i}" for i in range(90)], [f"you idiot clown by the river {i}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(clean + bad)), "doc_id long, text string")
    rows = [(i, int(i >= 90)) for i in range(150)]
    labels = spark.createDataFrame([*rows, *rows, (0, 1), (None, 1), (200, 1), (3, None)], "doc_id long, toxic int")
    bag = toxicity.train(docs, labels)
    long = "the quiet tree stands by the river " * 20_000
    new = [(1, long), (2, long + "you idiot clown " + long), (2, "you idiot clown"), (2, "you idiot clown"), (None, "!!")]
    out = [(r.doc_id, r.predicted) for r in toxicity.score(spark.createDataFrame(new, "doc_id long, text string"), bag).collect()]
    assert sorted(out, key=str) == sorted([(1, 0), (2, 1), (2, 1), (2, 1), (None, 0)], key=str)


def test_pieces():
    for counts in ([1], [2, 3, 4], [100, 1, 7]):
        first, size, text = toxicity.cut_pieces(np.array(counts))
        assert size.min() >= 1 and np.bincount(text, size).tolist() == counts and (first[1:] == first[:-1] + size[:-1]).all()
