"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the embeddings of the whole word and of its character 3- to 6-grams, all hashed into
BUCKETS rows. A text is cut into pieces of some PIECE words; a piece's vector is the mean over its words and NEUTRAL words
of zero, and a softmax over two labels follows. A text is as toxic as its worst piece, so that a few words count
in a text of any length. A misspelt word shares most n-grams with the right one.

Embeddings and softmax are trained jointly in numpy by Adagrad on a bounded sample (FIT_DOCS of label 0 and 1 by hash,
of FIT_BYTES bytes at most): WHOLE epochs on whole texts, then EPOCHS on each text's worst piece as the network
sees it at the epoch's start. Embeddings begin at zero, so only n-grams of the sample have a say. These settings were
chosen by four folds inside the rows that may be learned from, at sf0.1 and sf0.01.

The softmax is linear, so at scoring a word is one number; numbers of words are kept in a bounded cache.
"""

from __future__ import annotations

import itertools
import math
import re
import time
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.frames import load, utf8
from tessera.llm.language import held_out

BUCKETS, SIZE, SCALE = 1 << 17, 4, 30.0
FIT_DOCS, FIT_BYTES, WHOLE, EPOCHS, BATCH, RATE = (6000, 3000), 6000, 3, 10, 64, 2.0
#: Adagrad's sums begin here, far above one document's share, so that a row which few documents touch moves little.
SEEN = 1e-5
#: Words of a piece, and further words of zero that each piece counts.
PIECE, NEUTRAL, GRAMS = 3, 2, (3, 4, 5, 6)
CACHE_WORDS = 300_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, word number): for each word its own row and those of its 3- to 5-grams, between marks of start and end."""
    size = np.array([len(w) + 2 for w in words], np.int64)
    data = np.frombuffer(b"".join(b"<%b>" % w for w in words), np.uint8).astype(np.uint64)
    end, owner = np.repeat(np.cumsum(size), size), np.repeat(np.arange(len(words), dtype=np.int32), size)
    at = np.arange(len(data))
    rows, own = [np.array([zlib.crc32(w) % BUCKETS for w in words], np.int32)], [np.arange(len(words), dtype=np.int32)]
    value = data
    for n in range(2, max(GRAMS) + 1):
        value = value[:-1] << np.uint64(8) | data[n - 1 :]
        if n in GRAMS:
            inside = at[: len(value)] + n <= end[: len(value)]
            rows.append((K.mix(value[inside] + (np.uint64(n) << np.uint64(56))) % np.uint64(BUCKETS)).astype(np.int32))
            own.append(owner[: len(value)][inside])
    return np.concatenate(rows), np.concatenate(own)


def cut_pieces(counts: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, text) of the pieces of texts of so many words, laid end to end; every count is 1 or more."""
    parts = np.maximum(1, (counts + piece // 2) // piece)
    text = np.repeat(np.arange(len(counts)), parts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    base = (np.cumsum(counts) - counts)[text]
    first, stop = nth * counts[text] // parts[text], (nth + 1) * counts[text] // parts[text]
    return base + first, stop - first, text


def word_numbers(line: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Means of line over each word's rows."""
    if not words:
        return np.zeros(0)
    rows, own = subwords(words)
    return np.bincount(own, line[rows], len(words)) / np.bincount(own, minlength=len(words))


class Bag:
    def __init__(self, seed: int = 3) -> None:
        g = np.random.default_rng(seed)
        self.e = np.zeros((BUCKETS, SIZE), np.float32)  # n-grams outside the sample stay 0 and add nothing to a score
        self.w, self.b = (g.standard_normal((SIZE, 2)) / np.sqrt(SIZE)).astype(np.float32), np.zeros(2, np.float32)

    def line(self) -> np.ndarray:
        """What each row adds to the difference of the two labels."""
        return (self.e @ (self.w[:, 1] - self.w[:, 0]) * SCALE).astype(np.float32)

    def fit(self, docs: Iterable[list[bytes]], labels: np.ndarray, whole: int = WHOLE, epochs: int = EPOCHS, rate: float = RATE, seed: int = 4) -> None:
        """Joint training; labels weigh as the inverse root of their counts. Documents without words are skipped."""
        g = np.random.default_rng(seed)
        vocabulary: dict[bytes, int] = {}
        texts = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in d], np.int32) for d in docs]
        labels, texts = labels[[len(t) > 0 for t in texts]], [t for t in texts if len(t)]
        if not texts:
            return
        rows, own = subwords(list(vocabulary))
        flat, size = rows[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(vocabulary))
        begin = np.cumsum(size) - size
        words, counts = np.concatenate(texts), np.array([len(t) for t in texts])
        first, length, text = cut_pieces(counts)
        weight = np.array([math.sqrt(len(labels) / (2 * max(1, (labels == k).sum()))) for k in (0, 1)])
        seen_e, seen_w, seen_b = np.full(BUCKETS, SEEN, np.float32), np.full(self.w.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)
        for epoch in range(whole + epochs):
            units = texts
            if epoch >= whole:
                number = np.add.reduceat(self.line()[flat], begin) / size
                level = np.add.reduceat(number[words], first) / (length + NEUTRAL)
                worst = np.lexsort((-level, text))[K.runs(text)]
                units = [words[a : a + n] for a, n in zip(first[worst].tolist(), length[worst].tolist(), strict=True)]
            for part in np.array_split(g.permutation(len(units)), max(1, len(units) // BATCH)):
                # every distinct word's share of each unit
                doc = np.repeat(np.arange(len(part)), [len(units[i]) for i in part])
                word, at = np.unique(np.concatenate([units[i] for i in part]), return_inverse=True)
                share = np.bincount(at * len(part) + doc, minlength=len(word) * len(part)).reshape(len(word), len(part)).astype(np.float32)
                share /= share.sum(axis=0) + NEUTRAL
                n = size[word]
                edge = np.cumsum(n) - n
                used = flat[np.repeat(begin[word] - edge, n) + np.arange(n.sum())]
                mean = SCALE * share.T @ (np.add.reduceat(self.e[used], edge) / n[:, None])
                y = mean @ self.w + self.b
                y = np.exp(y - y.max(axis=1, keepdims=True))
                y /= y.sum(axis=1, keepdims=True)
                own = labels[part]
                y[np.arange(len(part)), own] -= 1
                y *= (weight[own] / len(part))[:, None].astype(np.float32)
                gw, gb = mean.T @ y, y.sum(axis=0)
                spread = np.repeat(SCALE * share @ (y @ self.w.T) / n[:, None], n, axis=0)
                ge = np.stack([np.bincount(used, spread[:, k], BUCKETS) for k in range(SIZE)], axis=1).astype(np.float32)
                seen_e += (ge * ge).mean(axis=1)
                seen_w += gw * gw
                seen_b += gb * gb
                self.e -= rate * ge / np.sqrt(seen_e)[:, None]
                self.w -= rate * gw / np.sqrt(seen_w)
                self.b -= rate * gb / np.sqrt(seen_b)


def train(docs: DataFrame, labels: DataFrame, fit_docs: tuple[int, int] = FIT_DOCS, fit_bytes: int = FIT_BYTES) -> Bag:
    """From docs (doc_id, text) and labels (doc_id, toxic). Null labels teach nothing; without labels scores are the prior."""
    marks = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = docs.select("doc_id", "text").where(F.octet_length("text").between(1, fit_bytes))
    sized = usable.select("doc_id").join(marks, "doc_id")  # texts stay out of this shuffle
    chosen = [(k, sized.where(F.col("toxic") == k).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs[k])) for k in (0, 1)]
    rows = [(r.doc_id, r.text, k) for k, ids in chosen for r in usable.join(F.broadcast(ids), "doc_id").collect()]
    rows.sort()
    bag = Bag()
    if rows:
        bag.fit((words_of(t.encode()) for _, t, _ in rows), np.array([k for _, _, k in rows]))
    return bag


_caches: dict[str, dict[bytes, float]] = {}


def score(docs: DataFrame, bag: Bag) -> DataFrame:
    """doc_id, score (probability of label 1) and predicted for every row of docs (doc_id, text).

    Null texts and texts without words have the bias alone. Whole texts count, by their worst piece; further columns
    are ignored; repeated rows give repeated results; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast((bag.line(), float(bag.b[1] - bag.b[0])))
    name = f"{id(bag)}-{time.time_ns()}"

    def run(batches):  # noqa: ANN001, ANN202
        line, bias = sent.value
        if name not in _caches:
            _caches.clear()
            _caches[name] = {}
        cache = _caches[name]
        for batch in batches:
            logits = []
            for i, j in K.slices(K.texts_of(batch.column(1))[1]):
                texts = [words_of(batch.column(1)[n].as_py()) for n in range(i, j)]
                new = list(set(itertools.chain.from_iterable(texts)).difference(cache))
                cache.update(zip(new, word_numbers(line, new).tolist(), strict=True))
                worst = np.zeros(len(texts))
                full = np.flatnonzero([len(words) > 0 for words in texts])
                if len(full):
                    own = np.fromiter(map(cache.__getitem__, itertools.chain.from_iterable(texts)), float)
                    first, length, text = cut_pieces(np.array([len(texts[n]) for n in full]))
                    worst[full] = np.maximum.reduceat(np.add.reduceat(own, first) / (length + NEUTRAL), K.runs(text))
                logits += (bias + worst).tolist()
                if len(cache) > CACHE_WORDS:
                    cache.clear()
            p = np.round(1 / (1 + np.exp(-np.clip(np.array(logits), -40, 40))), 9)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels")
    bag = train(docs.where(~held_out(5, 0)), labels.where(~held_out(5, 0)))
    return score(docs, bag).select("doc_id", F.coalesce(held_out(5, 0), F.lit(True)).alias("held_out"), "score", "predicted")
