"""Language ID by a bidirectional gated recurrent network over bytes.

Bytes, blanks included, are embedded, read forwards and backwards by gated recurrent units, and every position gets a
softmax over the languages. Texts are read in windows of SPAN bytes with CONTEXT bytes more on either side, cut between
characters: the states run through words, blanks and lines, and each position is labelled once, with what stands around it.
A document's probabilities are the mean over all its positions.

Training is backpropagation through time in numpy with Adam, on a bounded sample: FIT_DOCS documents of each language,
chosen by hash, of each a piece of FIT_CHARS characters at most, somewhere in its text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm import kernels as K
from tessera.llm.frames import load, utf8

SPAN, CONTEXT, EMBED, HIDDEN = 256, 16, 8, 8
FIT_DOCS, FIT_CHARS, FIT_SPAN, STEPS, BATCH, RATE = 250, 2000, 48, 800, 128, 0.015
#: Windows that are read at once.
ROWS = 1024
UNKNOWN, LEAST = "und", 0.3


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), the units' activation: cheap, and its derivative is (1 - |y|) squared. Gates are (1 + y) / 2."""
    return x / (1 + np.abs(x))


class Reader:
    """The network: float32 parameters in a dict, and the languages."""

    def __init__(self, langs: list[str], seed: int = 11) -> None:
        self.langs = langs
        g = np.random.default_rng(seed)
        shape = {"e": (256, EMBED), "o": (2 * HIDDEN, len(langs)), "ob": (len(langs),)}
        for d in "fb":
            shape |= {f"{d}w": (EMBED, 3 * HIDDEN), f"{d}u": (HIDDEN, 2 * HIDDEN), f"{d}c": (HIDDEN, HIDDEN), f"{d}b": (3 * HIDDEN,)}
        self.p = {k: (g.standard_normal(s) * (0 if len(s) == 1 else 0.5 if k == "e" else 0.8 / np.sqrt(s[0]))).astype(np.float32) for k, s in shape.items()}

    def _pass(self, d: str, x: np.ndarray, mask: np.ndarray | None, keep: bool) -> tuple[np.ndarray, list]:
        """x: (n, t) bytes in reading order. Returns the states (n, t, HIDDEN); keep: what training needs."""
        p, (n, t) = self.p, x.shape
        table = p["e"] @ p[f"{d}w"] + p[f"{d}b"]
        h, out, memo = np.zeros((n, HIDDEN), np.float32), np.empty((n, t, HIDDEN), np.float32), []
        for i in range(t):
            a = table[x[:, i]]
            zr = squash(a[:, : 2 * HIDDEN] + h @ p[f"{d}u"])
            zr += 1
            zr *= np.float32(0.5)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = squash(a[:, 2 * HIDDEN :] + (r * h) @ p[f"{d}c"])
            if mask is not None:
                z = z * mask[:, i, None]
            if keep:
                memo.append((h, z, r, c))
            h = h + z * (c - h)
            out[:, i] = h
        return out, memo

    def probabilities(self, x: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """(n, t, languages) for windows of t bytes; where the mask is 0 nothing is read."""
        f, _ = self._pass("f", x, mask, False)
        b, _ = self._pass("b", x[:, ::-1], None if mask is None else mask[:, ::-1], False)
        y = f @ self.p["o"][:HIDDEN] + b[:, ::-1] @ self.p["o"][HIDDEN:] + self.p["ob"]
        np.exp(y, out=y)  # states are within 1, so this stays small
        y /= y @ np.ones((y.shape[2], 1), np.float32)
        return y

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss a position and its gradient, by backpropagation through time. y: each run's language."""
        p, n = self.p, len(x)
        flip = {"f": slice(None), "b": slice(None, None, -1)}
        states, memos = {}, {}
        for d in "fb":
            out, memos[d] = self._pass(d, x[:, flip[d]], mask[:, flip[d]], True)
            states[d] = out[:, flip[d]]
        both = np.concatenate((states["f"], states["b"]), axis=2)
        q = both @ p["o"] + p["ob"]
        q = np.exp(q - q.max(axis=2, keepdims=True))
        q /= q.sum(axis=2, keepdims=True)
        total = mask.sum()
        loss = float(-(np.log(q[np.arange(n), :, y] + 1e-9) * mask).sum() / total)
        q[np.arange(n), :, y] -= 1
        q *= mask[:, :, None] / total
        g = {"o": np.einsum("nth,ntk->hk", both, q), "ob": q.sum((0, 1)), "e": np.zeros_like(p["e"])}
        up = q @ p["o"].T
        for k, d in enumerate("fb"):
            xs, ms = x[:, flip[d]], mask[:, flip[d]]
            dh_out = up[:, :, k * HIDDEN : (k + 1) * HIDDEN][:, flip[d]]
            gu, gc = np.zeros_like(p[f"{d}u"]), np.zeros_like(p[f"{d}c"])
            rows = np.zeros((256, 3 * HIDDEN), np.float32)
            dh = np.zeros((n, HIDDEN), np.float32)
            for i in range(x.shape[1] - 1, -1, -1):
                h, z, r, c = memos[d][i]
                dh = dh + dh_out[:, i]
                dc = dh * z * (1 - np.abs(c)) ** 2
                dz = dh * (c - h) * ms[:, i, None] * (1 - np.abs(2 * z - 1)) ** 2 / 2
                drh = dc @ p[f"{d}c"].T
                dr = drh * h * (1 - np.abs(2 * r - 1)) ** 2 / 2
                gc += (r * h).T @ dc
                dzr = np.concatenate((dz, dr), axis=1)
                gu += h.T @ dzr
                step = np.concatenate((dzr, dc), axis=1)
                order = np.argsort(xs[:, i], kind="stable")
                at = np.flatnonzero(np.diff(xs[order, i].astype(np.int16), prepend=-1))
                rows[xs[order[at], i]] += np.add.reduceat(step[order], at)
                dh = dh * (1 - z) + drh * r + dzr @ p[f"{d}u"].T
            g |= {f"{d}u": gu, f"{d}c": gc, f"{d}w": p["e"].T @ rows, f"{d}b": rows.sum(0)}
            g["e"] += rows @ p[f"{d}w"].T
        return loss, g

    def fit(self, runs: list[bytes], langs: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 5) -> list[float]:
        g = np.random.default_rng(seed)
        first, second, losses = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, []
        by_lang = [np.flatnonzero(langs == k) for k in range(len(self.langs))]
        for t in range(1, steps + 1):
            pick = np.concatenate([own[g.integers(0, len(own), max(1, batch // len(by_lang)))] for own in by_lang if len(own)])
            x, mask = padded([runs[i] for i in pick])
            loss, grad = self.gradient(x, mask, langs[pick])
            losses.append(loss)
            now = rate * min(1, 2 * (1 - t / (steps + 1)))
            for k, v in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                self.p[k] -= (now * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return losses


def padded(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(r) for r in runs])
    inside = np.arange(size.max(initial=1)) < size[:, None]
    x = np.zeros(inside.shape, np.uint8)
    x[inside] = np.frombuffer(b"".join(runs), np.uint8)
    return x, inside.astype(np.float32)


def windows_of(text: bytes, span: int = SPAN, context: int = CONTEXT) -> list[tuple[int, int, int, int]]:
    """(first byte read, first labelled, end of the labelled, end of the read), between characters."""
    def between(at: int) -> int:
        while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
            at -= 1
        return at

    cuts = [0]
    while len(text) - cuts[-1] > span:
        at = between(cuts[-1] + span)
        cuts.append(at if at > cuts[-1] else cuts[-1] + span)  # bytes that are no UTF-8 may have no such place
    cuts.append(len(text))
    return [(between(max(0, a - context)), a, b, between(min(len(text), b + context))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def read(net: Reader, texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text, first byte, probabilities of the positions from there on) for every window; windows of like length are read together."""
    windows = [(d - a, n, a, b, c, d) for n, t in enumerate(texts) if t for a, b, c, d in windows_of(t)]
    windows.sort()
    for i in range(0, len(windows), ROWS):
        part = windows[i : i + ROWS]
        x, mask = padded([texts[n][a:d] for _, n, a, _, _, d in part])
        p = net.probabilities(x, None if part[0][0] == part[-1][0] else mask)
        for row, (_, n, a, b, c, _) in zip(p, part, strict=True):
            yield n, b, row[b - a : c - a]


def pooled(net: Reader, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities over all positions, a row a text; empty texts have zeros."""
    out = np.zeros((len(texts), len(net.langs)))
    for n, _, p in read(net, texts):
        out[n] += p.sum(axis=0)
    return out / np.array([max(1, len(t)) for t in texts])[:, None]


def spans_of(net: Reader, text: bytes) -> list[dict]:
    """Labels of all positions, as maximal spans (start, end, lang)."""
    if not text:
        return []
    labels = np.empty(len(text), np.int64)
    for _, at, p in read(net, [text]):
        labels[at : at + len(p)] = p.argmax(axis=1)
    first = K.runs(labels).tolist()
    return [{"start": a, "end": b, "lang": net.langs[labels[a]]} for a, b in zip(first, [*first[1:], len(text)], strict=True)]


def train(docs: DataFrame, fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS, steps: int = STEPS) -> Reader | None:
    """A network from documents with text, lang and doc_id; None if none has a language and a letter.

    Of each language the fit_docs documents with the smallest hash are taken, whatever their length, and of each a piece
    of fit_chars characters that begins at a place drawn by the hash.
    """
    from pyspark.sql import Window

    usable = docs.where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    draw = F.xxhash64("doc_id", "lang")
    marked = usable.select("doc_id", "lang", draw.alias("draw"))
    chosen = marked.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))).where(F.col("nth") <= fit_docs).select("doc_id", "lang").distinct()
    begin = F.pmod(draw, F.greatest(F.length("text") - fit_chars + 1, F.lit(1)).cast("long")).cast("int")
    picked = usable.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", F.substring("text", begin + 1, F.lit(fit_chars)).alias("text"))
    # rows that repeat a chosen id are as bounded as the ids: the first two of each by text
    picked = picked.distinct().withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))).where(F.col("nth") <= 2 * fit_docs)
    rows = sorted((r.lang, r.text) for r in picked.collect())
    if not rows:
        return None
    langs = sorted({lang for lang, _ in rows})
    runs, own = [], []
    for lang, text in rows:
        raw = text.encode()
        new = [x for a, _, _, d in windows_of(raw, FIT_SPAN, 0) for x in [raw[a:d]] if re.search(rb"[A-Za-z\x80-\xff]", x)]
        runs += new
        own += [langs.index(lang)] * len(new)
    net = Reader(langs)
    if runs:
        net.fit(runs, np.array(own), steps)
    return net


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, net: Reader | None, spans: bool = False, keep: list[str] | None = None) -> DataFrame:
    """docs (its columns, or those named in keep) with lang_pred and score (mean probability, 0 to 1); with spans, the labels of all positions as well.

    Texts that are null or have no letter are `und` with score 0, and so is everything where there is no network. The
    columns lang_pred, score and lang_spans must not be there before. Only the text decides: repeated rows give repeated
    results; an empty table gives no rows.
    """
    shape = "lang_pred string, score double" + (", lang_spans array<struct<start:long,end:long,lang:string>>" if spans else "")
    sent = docs.sparkSession.sparkContext.broadcast(net)
    names = docs.columns if keep is None else keep
    width = len(names)
    inner = docs.select(*(F.col(f"`{c}`") for c in names), utf8(), has_letter(F.col("text")))

    def run(batches):  # noqa: ANN001, ANN202
        net = sent.value
        for batch in batches:
            lang, score, labels = [], [], []
            raw, ok = batch.column(width), batch.column(width + 1).to_pylist()
            for i, j in K.slices(K.texts_of(raw)[1]):
                texts = [raw[n].as_py() if ok[n] and net else b"" for n in range(i, j)]
                for text, p in zip(texts, pooled(net, texts) if net else texts, strict=True):
                    lang.append(net.langs[int(p.argmax())] if text else UNKNOWN)
                    score.append(round(float(min(1, p.max())), 5) if text else 0.0)
                    labels.append(spans_of(net, text) if spans and text else [])
            new = [pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            if spans:
                new.append(pa.array(labels, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *new], names=[*names, "lang_pred", "score", "lang_spans"][: width + len(new)])

    return inner.mapInArrow(run, StructType([*(docs.schema[n] for n in names), *StructType.fromDDL(shape).fields]))


def held_out(parts: int, part: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = train(docs.where(~F.coalesce(held_out(4, 2), F.lit(True))))
    return identify(docs.select("doc_id", "text"), net, keep=["doc_id"]).select("doc_id", F.coalesce(held_out(4, 2), F.lit(True)).alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those whose best language has a mean probability under LEAST.

    Where no document has a language there is no network, and all documents with letters stay.
    """
    net = train(docs)
    if net is None:
        return docs.where(has_letter(F.col("text")))
    found = identify(docs.select(F.struct(*docs.columns).alias("row"), "text"), net, keep=["row"])
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST)).select("row.*")
