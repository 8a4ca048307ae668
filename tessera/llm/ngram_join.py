"""N-gram Jaccard join by MinHash banding.

Documents are sets of five-word shingles. Rows and bands of the MinHash signature are chosen for a target recall at the
threshold; the shuffle is on band hashes. Equal sets collapse to one representative first. Each band bucket links its
members to its smallest one, so a bucket of any size costs a row a member, and the components of these links hold every
candidate pair. A component is then verified on the full shingle sets in tiles of at most 2 x TILE members: a large
one is cut into blocks and each pair of blocks is a task's work of its own, which reports counts and a spanning
forest, never its pairs. The forests give the classes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.frames import id_or_last, load, partitions, saved, shown_id, utf8
from tessera.operators.components import components

WORDS, PERCENT, RECALL, TILE = 5, 80, 0.9999, 512
_SIGNATURE = "id long, digest binary, d1 long, d2 long, n int, bands array<long>"


def banding(threshold: float, recall: float, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the most rows, hence the fewest chance candidates, that reach the recall with at most so many hashes."""
    best = (1, 1)
    for rows in range(1, 17):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles, text number) of all texts. A text of fewer words is one shingle."""
    low = K.LOWER[data[off[0] : off[-1]]]
    _, _, h, doc = K.word_spans(low, off - off[0], K.NOT_BLANK)
    count = np.bincount(doc, minlength=len(off) - 1)
    g = K.grams(h, k)
    at = np.flatnonzero(doc[: len(g)] == doc[k - 1 :][: len(g)])
    parts, owner = [g[at]], [doc[at]]
    for n in range(1, k):
        short = np.flatnonzero(count == n)
        if len(short):
            first = np.searchsorted(doc, short)
            parts.append(K.mix(K.grams(h, n)[first] + np.uint64(n)))
            owner.append(short)
    g, doc = np.concatenate(parts), np.concatenate(owner)
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[new], doc[new]


def set_digests(g: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """(n, 2): two sums of mixed shingles for each text."""
    out = np.zeros((n, 2), np.int64)
    at = K.runs(doc)
    if len(at):
        out[doc[at], 0] = np.add.reduceat(K.mix(g), at).view(np.int64)
        out[doc[at], 1] = np.add.reduceat(K.mix(g ^ K.MULT), at).view(np.int64)
    return out


def _signatures(k: int, bands: int, rows: int, batches):  # noqa: ANN001, ANN202
    values = K.mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * K.MULT)
    times, plus = (values[: bands * rows] | np.uint64(1)).astype(np.uint32), values[bands * rows :].astype(np.uint32)
    number = K.mix(np.arange(1, bands + 1, dtype=np.uint64))
    for batch in batches:
        data, off = K.texts_of(batch.column(2))
        for i, j in K.slices(off):
            g, doc = shingle_sets(data, off[i : j + 1], k)
            digest = set_digests(g, doc, j - i)
            bound = np.searchsorted(doc, np.arange(j - i + 1))
            s = (g >> np.uint64(32)).astype(np.uint32)
            lists = []
            for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
                low = np.full(len(times), 0xFFFFFFFF, np.uint32)
                for c in range(a, b, 256):
                    np.minimum(low, (s[c : min(b, c + 256), None] * times + plus).min(axis=0), out=low)
                h = number.copy()
                for column in low.reshape(bands, rows).T:
                    h = h * K.MULT + column
                lists.append(K.mix(h).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array(np.diff(bound).astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(0, len(lists) * bands + 1, bands, dtype=np.int32)), pa.array(np.concatenate(lists)))],
                names=["id", "digest", "d1", "d2", "n", "bands"],
            )


def jaccard_at_least(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Boolean matrix: which pairs of sorted distinct sets have a Jaccard similarity of percent or more, exactly."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    every, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(every, kind="stable")
    at = K.runs(every[order])
    count = np.diff(np.append(at, len(order)))
    column = np.cumsum(count > 1) - 1
    column = np.where(count > 1, column, -1).repeat(count)
    own, column = owner[order][column >= 0], column[column >= 0]
    both = np.zeros((n, n), np.float64)
    step = max(64, (1 << 22) // n)
    last = int(column[-1]) + 1 if len(column) else 0
    for c in range(0, last, step):
        a, b = np.searchsorted(column, (c, c + step))
        m = np.zeros((n, min(step, last - c)), np.float32)
        m[own[a:b], column[a:b] - c] = 1
        both += m @ m.T  # counts up to 2^24 a step are exact
    common = both.astype(np.int64)
    union = size[:, None] + size[None, :] - common
    return (common * 100 >= union * percent) & (common > 0)


def _tile(k: int, percent: int, rows: list[tuple]) -> list[tuple]:
    """(rep, links, root) for the members of a tile; rows: (i, j, block, rep, copies, set)."""
    rows = list({r[3]: r for r in rows}.values())
    similar = jaccard_at_least([r[5] for r in rows], percent)
    np.fill_diagonal(similar, False)
    i, j = rows[0][:2]
    if i != j:
        block = np.array([r[2] for r in rows])
        similar &= block[:, None] != block[None, :]
    links = similar @ np.array([r[4] for r in rows], np.int64)
    root = np.array([r[3] for r in rows], np.int64)
    while True:  # labels fall along links, then along labels
        low = np.where(similar, root[None, :], K.NO_ID).min(axis=1)
        new = np.minimum(root, low)
        if (new == root).all():
            return [(r[3], int(n), int(x)) for r, n, x in zip(rows, links, root, strict=True)]
        root = new


def _verify(k: int, percent: int, batches):  # noqa: ANN001, ANN202
    """Rows come sorted by (comp, i, j)."""
    def out(rows: list[tuple]):  # noqa: ANN202
        rep, links, root = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rep, links, root)], names=["rep", "links", "root"])

    key, held, done = None, [], []
    for batch in batches:
        meta = list(zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True))
        data, off = K.texts_of(batch.column(6))
        for a, b in K.slices(off):
            g, doc = shingle_sets(data, off[a : b + 1], k)
            bound = np.searchsorted(doc, np.arange(b - a + 1))
            for n, (comp, i, j, block, rep, copies) in enumerate(meta[a:b]):
                if (comp, i, j) != key:
                    done += _tile(k, percent, held) if len(held) > 1 else []
                    key, held = (comp, i, j), []
                held.append((i, j, block, rep, copies, g[bound[n] : bound[n + 1]].copy()))
            if len(done) >= 4096:
                yield out(done)
                done = []
    done += _tile(k, percent, held) if len(held) > 1 else []
    yield out(done)


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """id, digest (MD5 of the text), text and more."""
    return docs.select(id_or_last().alias("id"), F.unhex(F.md5(utf8())).alias("digest"), utf8().alias("text"), *more)


def _classes(docs: DataFrame, words: int, percent: int, recall: float) -> DataFrame:
    """One row per row of docs: id, digest, class (id), first (digest of the class's first text), n_links. Null class: no shingles."""
    bands, rows = banding(percent / 100, recall)
    docs = _keyed(docs)
    signed = saved(docs.mapInArrow(lambda b: _signatures(words, bands, rows, b), _SIGNATURE))
    full = signed.where("n > 0")
    # Equal sets are one node; its number is fixed by the checkpoint. Their first holder lends the text.
    sets = full.select("d1", "d2", "id").distinct().groupBy("d1", "d2").agg(F.count("*").alias("copies"))
    held = full.groupBy("d1", "d2").agg(F.min(F.struct("id", "digest")).alias("low"), F.any_value("bands").alias("bands"))
    nodes = saved(sets.join(held, ["d1", "d2"]).withColumn("node", F.monotonically_increasing_id()))
    buckets = nodes.select("node", F.explode("bands").alias("band"))
    low = buckets.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").drop("last")
    stars = buckets.join(low, "band").where("node > first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = saved(components(stars))
    size = near.groupBy("root").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    members = near.join(size, "root").join(nodes.select("node", "copies", "low.id", "low.digest"), "node")
    texts = docs.join(members.select("id", "digest"), ["id", "digest"], "left_semi").groupBy("id", "digest").agg(F.any_value("text").alias("text"))
    members = members.join(texts, ["id", "digest"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select(F.col("root").alias("comp"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", F.col("node").alias("rep"), "copies", "text")
    tiles = members.repartition(partitions(docs), "comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    verified = saved(tiles.mapInArrow(lambda b: _verify(words, percent, b), "rep long, links long, root long"))
    roots = components(verified.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy(F.col("rep").alias("node")).agg(F.sum("links").alias("links"))
    named = roots.join(nodes.select("node", "low"), "node")
    tops = named.join(named.groupBy("root").agg(F.min("low").alias("top")), "root").select("node", "top")
    by_set = nodes.drop("bands").join(links, "node", "left").join(tops, "node", "left").withColumn("top", F.coalesce("top", "low"))
    by_set = by_set.select("d1", "d2", F.col("top.id").alias("class"), F.col("top.digest").alias("first"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    none = signed.where("n = 0").select("id", "digest", F.lit(None).cast("long").alias("class"), F.lit(None).cast("binary").alias("first"), F.lit(0).cast("long").alias("n_links"))
    return full.select("id", "digest", "d1", "d2").join(by_set, ["d1", "d2"]).select("id", "digest", "class", "first", "n_links").unionByName(none)


def ngram_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, recall: float = RECALL) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the smallest doc_id that links lead to) and n_links, the number of
    other documents with a Jaccard similarity of percent or more.

    Words are lower-cased (A-Z) runs of bytes other than white space. A text of fewer words than a shingle is one
    shingle; null, empty and blank texts have none, link to nothing and are their own class. A document is a doc_id with
    a shingle set: rows that repeat both are one, rows that share a doc_id, or have none, with other sets are others and
    keep their links. A null doc_id sorts last and is shown as null. Further columns are ignored; an empty table gives no rows.
    """
    out = _classes(docs, words, percent, recall)
    return out.select(shown_id("id").alias("doc_id"), F.when(F.col("class").isNull(), shown_id("id")).otherwise(shown_id("class")).alias("class_id"), "n_links")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(load(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class one row stays, of its smallest doc_id (null last); of rows that repeat id and text any. Texts without shingles all stay."""
    first = _classes(docs, WORDS, PERCENT, RECALL).where("id = class and digest = first").select("id", "digest").distinct()
    blank = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = _keyed(docs.where(~blank), F.struct(*docs.columns).alias("row")).drop("text").groupBy("id", "digest").agg(F.any_value("row").alias("row"))
    return rows.join(first, ["id", "digest"]).select("row.*").unionByName(docs.where(blank))
