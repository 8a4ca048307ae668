"""Substring dedup by content-defined chunks.

A gear rolling hash over the last 32 bytes ends a chunk where it falls under a threshold, so an insertion moves only the
chunks that it touches. Equal chunks have equal 128-bit digests; the first holder of a chunk, by (doc_id, position),
keeps it and all others lose it.

Digests are pre-aggregated to their smallest doc_id before the shuffle, and repeats within a document never leave it,
so a hot chunk costs each map task one row. Who is not the first learns it by an equi-join that Spark may split.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.frames import load, narrow, shown_id

LEAST, MOST, MEAN_GAP = 32, 1024, 40
_GEAR = (K.byte_table(7) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: the sum of 32 shifted byte values, by doubling the span five times."""
    h = _GEAR[data]
    for span in (1, 2, 4, 8, 16):
        h[span:] += h[:-span] << np.uint32(span)
    return h


def cuts(data: np.ndarray, off: np.ndarray) -> list[list[int]]:
    """For each text the ends of its chunks, relative to its start; the text's length is the last one."""
    lo = int(off[0])
    at = np.flatnonzero(gear(data[lo : off[-1]]) < np.uint32((1 << 32) // MEAN_GAP)) + lo + 1
    bounds = np.searchsorted(at, off, "right")
    out = []
    for i in range(len(off) - 1):
        start, size = int(off[i]), int(off[i + 1] - off[i])
        ends, last = [], 0
        for c in (at[bounds[i] : bounds[i + 1]] - start).tolist():
            while c - last > MOST:
                last += MOST
                ends.append(last)
            if c - last >= LEAST:
                ends.append(c)
                last = c
        while size - last > MOST:
            last += MOST
            ends.append(last)
        if size > last:
            ends.append(size)
        out.append(ends)
    return out


def _digests(text: memoryview, ends: list[int]) -> list[bytes]:
    return [hashlib.blake2b(text[a:b], digest_size=16).digest() for a, b in zip([0, *ends], ends, strict=False)]


def _chunks(batches):  # noqa: ANN001, ANN202
    """(d1, d2, id, at) of the first occurrence in its document of every chunk of at least LEAST bytes."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        data, off = K.texts_of(batch.column(1))
        for i, j in K.slices(off):
            keys, owner, at = [], [], []
            for k, ends in enumerate(cuts(data, off[i : j + 1]), i):
                digests = _digests(memoryview(data)[off[k] : off[k + 1]], ends)
                if ends and ends[-1] - (ends[-2] if len(ends) > 1 else 0) < LEAST:
                    digests.pop()
                first = dict(zip(reversed(digests), range(len(digests) - 1, -1, -1), strict=True))
                keys += first
                at += first.values()
                owner += [ids[k]] * len(first)
            d = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array(owner, pa.int64()), pa.array(at, pa.int32())], names=["d1", "d2", "id", "at"])


def _removed(batches):  # noqa: ANN001, ANN202
    for batch in batches:
        ids, lists = batch.column(0).to_numpy(), batch.column(2)
        data, off = K.texts_of(batch.column(1))
        for i, j in K.slices(off):
            rows = []
            for k, ends in enumerate(cuts(data, off[i : j + 1]), i):
                text = data[off[k] : off[k + 1]].tobytes()
                later = {(x["at"], x["d1"]) for x in lists[k].as_py() or ()}
                seen, kept, spans = set(), [], []
                for n, (a, b, d) in enumerate(zip([0, *ends], ends, _digests(memoryview(text), ends), strict=False)):
                    if b - a >= LEAST and (d in seen or later and (n, int(np.frombuffer(d, np.int64)[0])) in later):
                        if spans and spans[-1]["end"] == a:
                            spans[-1]["end"] = b
                        else:
                            spans.append({"start": a, "end": b})
                    else:
                        kept.append(text[a:b])
                    seen.add(d)
                rows.append({"id": ids[k], "n_bytes": len(text), "n_chunks": len(ends), "kept": b"".join(kept), "spans": spans})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_chunks", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_chunks, kept (the remaining bytes), spans removed (byte offsets).

    Of equal chunks of LEAST bytes or more the first stays, by doc_id (null last), then position. A shorter rest at a
    text's end always stays. Null and empty texts have no chunks. Rows that repeat a doc_id do not remove from each
    other, only repeats inside each of them go. Further columns are ignored; an empty table gives no rows. Cuts may
    fall inside a character, so kept is binary.
    """
    docs = narrow(docs)
    chunks = docs.mapInArrow(_chunks, "d1 long, d2 long, id long, at int")
    first = chunks.groupBy("d1", "d2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    later = chunks.join(first, ["d1", "d2"]).where("id > first").groupBy("id").agg(F.collect_list(F.struct("at", "d1")).alias("later"))
    out = docs.join(later, "id", "left").select("id", "text", "later")
    shape = "id long, n_bytes long, n_chunks long, kept binary, spans array<struct<start:long,end:long>>"
    return out.mapInArrow(_removed, shape).withColumn("doc_id", shown_id("id")).select("doc_id", "n_bytes", "n_chunks", "kept", "spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(load(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_chunks", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
