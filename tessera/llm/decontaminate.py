"""Benchmark decontamination by winnowing.

A word window's fingerprint is the smallest hash among its k-grams. Equal windows have equal fingerprints, so a join
of training and test fingerprints finds every shared window of WINDOW words; the candidates are then compared word by
word and the runs of true windows extend each other. Items of fewer than WINDOW words are one window of their own
length, fingerprinted by the hash of that whole gram.

Up to INDEX_BYTES of item text (measured first) the test side is sent to all tasks. Beyond it the join is a shuffle:
fingerprints of items and documents meet by hash, the candidate windows of documents join the items' windows on the
full words, and only (document, window) pairs that truly occur go back to the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm import kernels as K
from tessera.llm.frames import id_or_last, load, shown_id, utf8

WINDOW, GRAM = 10, 5
INDEX_BYTES = 16 << 20
OUT = "id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def _lowered(data: np.ndarray) -> np.ndarray:
    return K.LOWER[data]


def _windows(words: list[bytes]) -> list[bytes]:
    n = min(len(words), WINDOW)
    return [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if n else []


def _fingerprints(h: np.ndarray) -> np.ndarray:
    """One for each window of WINDOW words."""
    return K.window_min(K.grams(h, GRAM), WINDOW - GRAM + 1)


def _words(text: bytes) -> tuple[list[bytes], np.ndarray]:
    data = _lowered(np.frombuffer(text, np.uint8))
    starts, ends, hashes, _ = K.word_spans(data, np.array([0, len(data)]), K.ALNUM)
    low = data.tobytes()
    return [low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], hashes


class Index:
    """The items' windows and fingerprints, by window length."""

    def __init__(self, items: list[tuple[str | None, bytes]]) -> None:
        self.items: dict[bytes, set[str]] = {}
        prints: dict[int, set] = {}
        for item, text in items:
            words, hashes = _words(text)
            for w in dict.fromkeys(_windows(words)):
                self.items.setdefault(w, set()).update(() if item is None else (item,))
            n = min(len(words), WINDOW)
            if n:
                prints.setdefault(n, set()).update((_fingerprints(hashes) if n == WINDOW else K.grams(hashes, n)).tolist())
        self.prints = {n: np.array(sorted(x), np.uint64) for n, x in sorted(prints.items())}

    def candidates(self, hashes: np.ndarray, text_of: np.ndarray) -> list[tuple[int, int]]:
        """(first word, length) of the windows whose fingerprint an item has."""
        out = []
        for n, known in self.prints.items():
            f = _fingerprints(hashes) if n == WINDOW else K.grams(hashes, n)
            if len(f):
                at = K.runs(f)
                there = np.minimum(np.searchsorted(known, f[at]), len(known) - 1)
                hit = np.repeat(known[there] == f[at], np.diff(np.append(at, len(f))))
                j = np.flatnonzero(hit)
                j = j[text_of[j] == text_of[j + n - 1]]
                out += [(x, n) for x in j.tolist()]
        return out


def _scan(index: Index, batches):  # noqa: ANN001, ANN202
    for batch in batches:
        ids = batch.column(0).to_numpy()
        data, off = K.texts_of(batch.column(1))
        for i, j in K.slices(off):
            low = _lowered(data[off[i] : off[j]])
            starts, ends, hashes, doc = K.word_spans(low, off[i : j + 1] - off[i], K.ALNUM)
            n_words = np.bincount(doc, minlength=j - i)
            raw = low.tobytes()
            first = np.searchsorted(doc, np.arange(j - i))
            spans: dict[int, list] = {}
            items: dict[int, set] = {}
            for w, n in index.candidates(hashes, doc):
                found = index.items.get(b" ".join([raw[a:b] for a, b in zip(starts[w : w + n].tolist(), ends[w : w + n].tolist(), strict=True)]))
                if found is not None:
                    d = int(doc[w])
                    spans.setdefault(d, []).append((w - int(first[d]), w - int(first[d]) + n))
                    items.setdefault(d, set()).update(found)
            rows = [K.merged(*np.array(spans[d], np.int64).T) if d in spans else None for d in range(j - i)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[i:j]), pa.array(n_words, pa.int64()), pa.array([0 if r is None else int((r[1] - r[0]).sum()) for r in rows], pa.int64()),
                    pa.array([sorted(items.get(d, ())) for d in range(j - i)], pa.list_(pa.string())),
                    pa.array([[] if r is None else [{"start": int(a), "end": int(b)} for a, b in zip(*r, strict=True)] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                names=["id", "n_words", "n_hit", "items", "spans"],
            )


def _words_of_slices(column: pa.Array):  # noqa: ANN202
    """(first row, row after the last, starts, ends, hashes, text number, lowered bytes) of each slice."""
    data, off = K.texts_of(column)
    for i, j in K.slices(off):
        low = _lowered(data[off[i] : off[j]])
        yield i, j, *K.word_spans(low, off[i : j + 1] - off[i], K.ALNUM), low.tobytes()


def _item_windows(batches):  # noqa: ANN001, ANN202
    """(item, n, print, words) of every window of every item."""
    for batch in batches:
        for i, j, starts, ends, hashes, doc, raw in _words_of_slices(batch.column(1)):
            n_words = np.bincount(doc, minlength=j - i)
            for n in range(1, WINDOW + 1):
                f = _fingerprints(hashes) if n == WINDOW else K.grams(hashes, n)
                at = np.arange(len(f))
                at = at[doc[at] == doc[at + n - 1]]
                at = at[n_words[doc[at]] == n] if n < WINDOW else at
                words = [b" ".join(raw[a:b] for a, b in zip(starts[w : w + n].tolist(), ends[w : w + n].tolist(), strict=True)) for w in at.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[at] + i)), pa.array(np.full(len(at), n, np.int32)), pa.array(f[at].view(np.int64)), pa.array(words, pa.binary())], names=["item", "n", "print", "words"])


def _prints(lengths: list[int], batches):  # noqa: ANN001, ANN202
    """(key, n, print, first, last) of every run of windows with one fingerprint: the minima that winnowing keeps."""
    for batch in batches:
        for i, j, _, _, hashes, doc, _ in _words_of_slices(batch.column(1)):
            begin = np.searchsorted(doc, np.arange(j - i))
            for n in lengths:
                f = _fingerprints(hashes) if n == WINDOW else K.grams(hashes, n)
                at = np.arange(len(f))
                at = at[doc[at] == doc[at + n - 1]]
                own = f[at]
                new = np.ones(len(at), bool)
                new[1:] = (own[1:] != own[:-1]) | (doc[at[1:]] != doc[at[:-1]])
                k = np.flatnonzero(new)
                first, last = at[k], at[np.append(k[1:], len(at)) - 1] if len(k) else at[k]
                text = doc[first]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text + i)), pa.array(np.full(len(k), n, np.int32)), pa.array(own[k].view(np.int64)), pa.array(first - begin[text]), pa.array(last - begin[text])], names=["key", "n", "print", "first", "last"])


_KEY = "struct<id:long,digest:string>"


def _hits_by_shuffle(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs by key, their hits: key, items, hits) by equi-joins alone."""
    tests = items.mapInArrow(_item_windows, "item string, n int, print long, words binary")
    lengths = sorted(r[0] for r in tests.select("n").distinct().collect())  # at most WINDOW numbers
    known = tests.select("n", "print").distinct()
    keyed = docs.select(F.struct("id", F.md5("text").alias("digest")).alias("key"), "text")
    prints = keyed.mapInArrow(lambda b: _prints(lengths, b), f"key {_KEY}, n int, print long, first long, last long")
    near = prints.join(known, ["n", "print"]).groupBy("key").agg(F.collect_set(F.struct("n", "first", "last")).alias("near"))

    def spelled(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for key, text, near in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words, _ = _words(text)
                out = [(x["n"], at, b" ".join(words[at : at + x["n"]])) for x in near for at in range(x["first"], x["last"] + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(out), batch.schema.field(0).type), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], names=["key", "n", "at", "words"])

    windows = keyed.join(near, "key").select("key", "text", "near").mapInArrow(spelled, f"key {_KEY}, n int, at long, words binary")
    hits = windows.join(tests.select("n", "words", "item").distinct(), ["n", "words"])
    return keyed, hits.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"), F.collect_set(F.struct("at", "n")).alias("hits"))


def _by_shuffle(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same spans and items by equi-joins alone."""
    keyed, by_doc = _hits_by_shuffle(docs, items)

    def spans(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            rows = []
            for id, text, items, hits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, _ = _words(text)
                s, e = K.merged(*np.array([(h["at"], h["at"] + h["n"]) for h in hits], np.int64).reshape(-1, 2).T) if hits else ((), ())
                rows.append({"id": id, "n_words": len(words), "n_hit": int(sum(b - a for a, b in zip(s, e, strict=True))), "items": items or [], "spans": [{"start": int(a), "end": int(b)} for a, b in zip(s, e, strict=True)]})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))

    return keyed.join(by_doc, "key", "left").select("key.id", "text", "items", "hits").mapInArrow(spans, OUT)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item"), utf8().alias("text")).distinct()


def _index(items: DataFrame, index_bytes: int) -> Broadcast | None:
    """The items' index in all tasks, or None where their texts have more than index_bytes bytes."""
    if (items.agg(F.sum(F.length("text") + 16)).first()[0] or 0) > index_bytes:
        return None
    return items.sparkSession.sparkContext.broadcast(Index([(r["item"], bytes(r["text"])) for r in items.collect()]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (ids as strings, sorted), spans of hit words.

    docs needs doc_id and text, benchmark item_id and text; further columns are ignored. Null texts have no words.
    Items without words match nothing; one with a null id hits words, but is not listed. Items with equal text all count;
    a repeated item counts once. Repeated documents each give their own row. Empty tables give no rows, or rows without hits.
    """
    docs = docs.select(id_or_last().alias("id"), utf8().alias("text"))
    items = _items(benchmark)
    index = _index(items, index_bytes)
    out = _by_shuffle(docs, items) if index is None else docs.mapInArrow(lambda batches: _scan(index.value, batches), OUT)
    return out.withColumn("doc_id", shown_id("id")).select("doc_id", "n_words", "n_hit", "items", "spans")


def clean(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of docs whose own text has no hit, with all their columns, whatever other rows have the same doc_id."""
    items = _items(benchmark)
    index = _index(items, index_bytes)
    rows = docs.select(F.struct(*docs.columns).alias("row"), id_or_last().alias("id"), utf8().alias("text"))
    if index is None:
        _, hit = _hits_by_shuffle(rows.select("id", "text"), items)
        hit = hit.select("key.id", "key.digest")
        return rows.withColumn("digest", F.md5("text")).join(hit, ["id", "digest"], "left_anti").select("row.*")

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            found = _scan(index.value, [pa.RecordBatch.from_arrays(batch.columns[1:], names=["id", "text"])])
            hit = pa.chunked_array([x.column(2) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pc.equal(hit, 0).combine_chunks())], names=["row"])

    return rows.mapInArrow(run, StructType([rows.schema["row"]])).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the hit words' documents out of training: contaminated rows go, the others keep all columns."""
    return clean(docs, load(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents),
b AS (SELECT DISTINCT item_id, {_WORDS.format('text')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, n, i, item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, n, i FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
