"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last two lines ends a chunk where it is 0 modulo SPACING, unless the chunk or the
rest of the text would have fewer than LEAST lines. So boundaries depend on the lines around them alone and survive
insertions elsewhere, and only a text of one line makes a chunk of one line. Of equal chunks of two lines or more the first by
(doc_id, position) stays. Digests find the candidates; candidates are grouped by their whole bytes, so a collision
removes nothing.
"""

from __future__ import annotations

import hashlib
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm import kernels as K
from tessera.llm.frames import id_or_last, load, saved, shown_id, small, utf8

SPACING, TIMES, LEAST = 3, 31, 2
_LINES = "id long, n_lines long, n_chunks long, removed long, kept binary"


def line_chunks(text: bytes, least: int = LEAST) -> list[list[bytes]]:
    """The text's lines (parts between line feeds) in chunks of least lines or more. An empty text has no line."""
    out, own, before = [], [], 0
    lines = text.split(b"\n") if text else []
    for left, line in zip(range(len(lines) - 1, -1, -1), lines, strict=True):
        own.append(line)
        h = int(hashlib.md5(line).hexdigest()[:8], 16)
        if (before * TIMES + h) % SPACING == 0 and len(own) >= least and (left == 0 or left >= least):
            out.append(own)
            own = []
        before = h
    return [*out, own] if own else out


def _digest(chunk: bytes) -> int:
    return int.from_bytes(hashlib.md5(chunk).digest()[:8], "little", signed=True)


def _candidates(least: int, batches):  # noqa: ANN001, ANN202
    """(digest, id) of the multi-line chunks."""
    for batch in batches:
        digests, owner = [], []
        for id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = {_digest(b"\n".join(c)) for c in line_chunks(text.as_py(), least) if len(c) > 1}
            digests += own
            owner += [id] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.int64()), pa.array(owner, pa.int64())], names=["digest", "id"])


def _spelled(least: int, batches):  # noqa: ANN001, ANN202
    """(id, chunk) of the chunks whose digest is listed, in batches of some megabytes."""
    for batch in batches:
        ids, own, held = [], [], 0
        for id, text, known in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            known = set(known)
            for c in {b"\n".join(c) for c in line_chunks(text.as_py(), least) if len(c) > 1}:
                if _digest(c) in known:
                    ids.append(id)
                    own.append(c)
                    held += len(c)
            if held > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own, pa.binary())], names=["id", "chunk"])
                ids, own, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own, pa.binary())], names=["id", "chunk"])


def _without(least: int, batches):  # noqa: ANN001, ANN202
    """The fourth column passes as it is."""
    shape = pa.schema([("id", pa.int64()), ("n_lines", pa.int64()), ("n_chunks", pa.int64()), ("removed", pa.int64()), ("kept", pa.binary())])
    for batch in batches:
        _, off = K.texts_of(batch.column(1))
        for i, j in K.slices(off, 4 << 20):
            rows = []
            for id, text, later in zip(*(batch.column(c).slice(i, j - i).to_pylist() for c in range(3)), strict=True):
                chunks, kept, removed, seen = line_chunks(text, least), [], 0, set(later or ())
                for c in chunks:
                    whole = b"\n".join(c)
                    if len(c) > 1 and whole in seen:
                        removed += len(c)
                    else:
                        kept += c
                        if len(c) > 1:
                            seen.add(whole)
                rows.append({"id": id, "n_lines": sum(map(len, chunks)), "n_chunks": len(chunks), "removed": removed, "kept": b"\n".join(kept)})
            out = pa.RecordBatch.from_pylist(rows, schema=shape)
            yield pa.RecordBatch.from_arrays([*out.columns, batch.column(3).slice(i, j - i)], names=[*shape.names, "rest"])


def line_dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, n_lines, n_chunks, removed (lines), kept (the text left, as bytes).

    The first document is that with the smallest doc_id. Rows that repeat a doc_id are one document and do not remove
    from each other; so are those without one, which stand last. Null and empty texts have no lines and stay empty; blank lines are lines. Further columns are ignored; an
    empty table gives no rows. The shuffles carry digests, the bytes of candidate chunks and the texts once; a hot
    chunk is pre-aggregated to its smallest doc_id, and who has it learns that by joins: of the digests with a broadcast
    of measured size, of the chunks, and of the digests beyond that size, with an equi-join that Spark may split.
    """
    return _deduped(docs, F.lit(0).alias("rest"), least).drop("rest")


def _deduped(docs: DataFrame, rest: Column, least: int = LEAST) -> DataFrame:
    """rest: a column named so that rides along with each document."""
    docs = docs.select(id_or_last().alias("id"), utf8().alias("text"), rest)
    digests = saved(docs.select("id", "text").mapInArrow(partial(_candidates, least), "digest long, id long"))
    shared = small(digests.groupBy("digest").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("digest"), F.lit(8))
    listed = digests.join(shared, "digest").groupBy("id").agg(F.collect_set("digest").alias("known"))
    # from here one plan, in which Spark shuffles the texts once for both of their joins
    chunks = docs.join(listed, "id").select("id", "text", "known").mapInArrow(partial(_spelled, least), "id long, chunk binary")
    first = chunks.groupBy("chunk").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").drop("high")
    later = chunks.join(first, "chunk").where("id > low").groupBy("id").agg(F.collect_set("chunk").alias("later"))
    out = docs.join(later, "id", "left").select("id", "text", "later", "rest")
    shape = StructType([*StructType.fromDDL(_LINES).fields, out.schema["rest"]])
    return out.mapInArrow(partial(_without, least), shape).select(shown_id("id").alias("doc_id"), "n_lines", "n_chunks", "removed", "kept", "rest")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_chunks", F.col("removed").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated chunks; documents that lose everything go. Other columns stay; n_chars follows the text."""
    out = _deduped(docs, F.struct(*(c for c in docs.columns if c != "text"), F.col("text").isNull().alias("null_text")).alias("rest")).where("removed = 0 or kept <> X''")
    text, changed = F.decode("kept", "UTF-8"), F.col("removed") > 0
    new = {"text": F.when(~changed & F.col("rest.null_text"), None).otherwise(text), "n_chars": F.when(changed, F.length(text)).otherwise(F.col("rest.n_chars"))}
    return out.select(*(new.get(c, F.col(f"rest.`{c}`")).cast(t).alias(c) for c, t in docs.dtypes))


#: In a run of lines where the hash says so, every second one ends a chunk: after an end the next line ends none.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, doc_id, line, p, size, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h
      FROM (SELECT r, doc_id, len(string_split(t, chr(10))) AS size, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS p FROM d WHERE t <> '')),
m AS (SELECT *, p BETWEEN 2 AND size - 2 AND (coalesce(lag(h) OVER w, 0) * {TIMES} + h) % {SPACING} = 0 AS may FROM l WINDOW w AS (PARTITION BY r ORDER BY p)),
e AS (SELECT r, doc_id, line, p, may AND (p - max(CASE WHEN NOT may THEN p END) OVER (PARTITION BY r ORDER BY p)) % 2 = 1 AS ends FROM m),
n AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM e),
c AS (SELECT r, doc_id, k, count(*) AS size, string_agg(line, chr(10) ORDER BY p) AS chunk FROM n GROUP BY ALL),
f AS (SELECT *, size > 1 AND (doc_id > min(doc_id) OVER (PARTITION BY chunk, size > 1)
             OR k > min(k) OVER (PARTITION BY chunk, size > 1, r)) AS gone FROM c),
o AS (SELECT r, CAST(sum(size) AS BIGINT) AS n_lines, count(*) AS n_chunks, CAST(coalesce(sum(size) FILTER (gone), 0) AS BIGINT) AS n_removed,
             coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (NOT gone), '') AS kept FROM f GROUP BY r)
SELECT nullif(doc_id, 9223372036854775807) AS doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN o USING (r)
"""
