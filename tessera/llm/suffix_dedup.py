"""Suffix-array dedup: every byte covered by a 50-byte string that also starts in a document with a smaller id goes.

Sorting all suffixes of a corpus in rounds of shuffles would move each byte many times, so the sort is dealt out first,
without loss:

1. Equal texts (by SHA-256) collapse to one row with their smallest id.
2. Each window of SPAN bytes has a key, the smallest hash among its GRAM-byte grams. Equal windows have equal keys. The
   keys of all texts meet in buckets (packed, two bytes of text number and four of hash); those of two texts or more
   are shared, and only windows with a shared key can repeat.
3. Texts are cut into segments, the runs of windows with one shared key, and equal segments collapse.
4. The segments of a bucket are sorted by the difference-cover algorithm: triples at the positions 1 and 2 modulo 3 are
   sorted and named, the names recurse until they are unique or SPAN bytes deep, the remaining suffixes are ordered by
   their first byte and the next one's rank and merged in. Neighbours in the suffix array with SPAN equal bytes make
   groups, whose smallest id decides.

The number of buckets follows the measured bytes, so a bucket's size does not grow with the input. Keys that a bounded
sample of texts shows to be hot would overfill theirs. Their windows get finer keys, by further hashes, LEVELS - 1 times:
that parts a frequent gram by what stands around it. What is still hot is a passage that very many texts hold: few
distinct segments with many owners. These segments are sorted with their smallest id alone, and the owners, plain
rows, learn the outcome by an equi-join on the segment, which Spark may split. The sample only deals out the work: any
choice of hot keys gives the same result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.frames import id_or_last, load, partitions, saved, shown_id, utf8

SPAN, GRAM = 50, 16
#: Bytes of segments that are sorted at once, beyond a key that alone has more.
SORT_BYTES = 1 << 19
#: Buckets: so many at least, then one for each so many bytes of text.
BUCKETS, BUCKET_BYTES = 128, 64 << 20
#: Of the keys of SAMPLE texts those are hot that alone have HOT_SHARE of a bucket's part, and HOT_LEAST texts.
SAMPLE, HOT_SHARE, HOT_LEAST, LEVELS = 4096, 1.0, 16, 3
_TABLES = [K.byte_table(10 + level) for level in range(LEVELS)]


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Dense ranks from 1, their number, and the order of the keys."""
    order = np.argsort(keys)
    ordered = keys[order]
    steps = np.ones(len(keys), np.int64)
    steps[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(len(keys), np.int64)
    out[order] = steps = np.cumsum(steps)
    return out, int(steps[-1]) if len(steps) else 0, order


def _triples(s: np.ndarray, at: np.ndarray, top: int) -> np.ndarray:
    """Sortable keys of s[at:at + 3]."""
    if top < 1 << 20:
        return (s[at] * (top + 1) + s[at + 1]) * (top + 1) + s[at + 2]
    pairs, _, _ = _ranks(s[at] * (top + 1) + s[at + 1])
    return pairs * (top + 1) + s[at + 2]


def difference_cover(s: np.ndarray, depth: int, top: int | None = None) -> np.ndarray:
    """The suffix array of s (whole numbers from 1) as far as depth symbols tell suffixes apart."""
    n = len(s)
    top = int(s.max(initial=0)) if top is None else top
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    padded = np.concatenate((s, np.zeros(4, np.int64)))
    one, two, rest = np.arange(1, n + 1, 3), np.arange(2, n + 1, 3), np.arange(0, n, 3)
    sample = np.concatenate((one, two))
    names, count, by = _ranks(_triples(padded, sample, top))
    if count < len(sample) and depth > 3:
        by = difference_cover(names, -(-depth // 3), count)
        names = np.empty(len(sample), np.int64)
        names[by] = np.arange(1, len(sample) + 1)
        count = len(sample)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names
    sample = sample[by]
    sample = sample[sample < n]
    # the other suffixes: first symbol, then the rank of the next one
    key0 = padded[rest] * (count + 1) + rank[rest + 1]
    order = np.argsort(key0)
    rest, key0 = rest[order], key0[order]
    # merge: how many suffixes of either sample class stand before each of them
    ones, twos = sample[sample % 3 == 1], sample[sample % 3 == 2]
    before = np.searchsorted(padded[ones] * (count + 1) + rank[ones + 1], key0)
    pair = lambda i: (padded[i] * (top + 1) + padded[i + 1])
    if (top + 1) ** 2 * (count + 1) < 1 << 62:
        before += np.searchsorted(pair(twos) * (count + 1) + rank[twos + 2], pair(rest) * (count + 1) + rank[rest + 2])
    else:
        both, _, _ = _ranks(np.concatenate((pair(twos), pair(rest))))
        before += np.searchsorted(both[: len(twos)] * (count + 1) + rank[twos + 2], both[len(twos) :] * (count + 1) + rank[rest + 2])
    out = np.empty(len(sample) + len(rest), np.int64)
    # suffixes that are equal to the depth may stand in any order; their counts are kept from falling
    place = np.maximum.accumulate(before) + np.arange(len(rest))
    taken = np.zeros(len(out), bool)
    taken[place] = True
    out[taken], out[~taken] = rest, sample
    return out


def window_groups(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each position of the segments laid end to end (one symbol apart): the smallest id of those with an equal
    window there. ids: the smallest id of each segment; positions without a whole window get NO_ID."""
    size = int((ends - starts).sum() + len(starts))
    s = np.ones(size, np.int64)
    base = np.concatenate(([0], np.cumsum(ends - starts + 1)))[:-1]
    owner = np.repeat(np.arange(len(starts)), ends - starts + 1)
    inside = np.arange(size) - base[owner]
    own = inside < (ends - starts)[owner]
    s[own] = data[(starts[owner] + inside)[own]].astype(np.int64) + 2
    order = difference_cover(s, SPAN, 257)
    whole = inside <= (ends - starts)[owner] - SPAN
    order = order[whole[order]]
    raw = np.concatenate((s - 2, np.zeros(8, np.int64))).astype(np.uint8)
    word = np.zeros(size, np.uint64)
    for t in range(8):
        word = (word << np.uint64(8)) | raw[t : t + size]
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), bool)
    for t in (*range(0, SPAN - 7, 8), SPAN - 8):
        left = np.flatnonzero(same)
        same[left] = word[a[left] + t] == word[b[left] + t]
    out = np.full(size, K.NO_ID, np.int64)
    if len(order):
        new = np.flatnonzero(np.concatenate(([True], ~same)))
        low = np.minimum.reduceat(ids[owner[order]], new)
        out[order] = np.repeat(low, np.diff(np.append(new, len(order))))
    return out


def _keys(data: np.ndarray, level: int = 0) -> np.ndarray:
    """The key of each window of SPAN bytes."""
    h, have = _TABLES[level][data], 1
    while have < GRAM:
        h = h[:-have] * K.MULT + (h[have:] ^ (h[have:] >> np.uint64(29)))
        have *= 2
    return K.window_min(K.mix(h), SPAN - GRAM + 1)


def _plain(data: np.ndarray, off: np.ndarray, rows: range) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, first window, last window + 1, as offsets in data) of all runs of windows with one key."""
    lo = int(off[rows[0]])
    m = _keys(data[lo : off[rows[-1] + 1]])
    at = np.arange(len(m))
    new = np.ones(len(m), bool)
    new[1:] = m[1:] != m[:-1]
    begin, stop = off[rows[0] : rows[-1] + 1] - lo, off[rows[0] + 1 : rows[-1] + 2] - lo - SPAN + 1
    full = stop > begin
    begin, stop = begin[full], stop[full]
    if not len(begin):
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none
    new[begin] = True
    edge = np.zeros(len(m) + 1, np.int64)
    edge[begin] += 1
    edge[stop] -= 1
    start = np.flatnonzero(new & (np.cumsum(edge[:-1]) > 0))
    nth = np.searchsorted(begin, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(at)), stop[nth])
    return np.flatnonzero(full)[nth] + rows[0], m[start], start + lo, end + lo


def _finer(data: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the run, key, start, end) of the given runs, cut where the level's key changes."""
    size = end - start + SPAN - 1
    nth = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(nth)) - np.repeat(np.cumsum(size) - size, size) + start[nth]
    m = _keys(data[at], level)
    whole = at[: len(m)] < end[nth[: len(m)]]
    nth, at, m = nth[: len(m)][whole], at[: len(m)][whole], m[whole]
    m = K.mix(key[nth] * K.MULT + m)
    new = np.ones(len(m), bool)
    new[1:] = (m[1:] != m[:-1]) | (nth[1:] != nth[:-1])
    first = np.flatnonzero(new)
    return nth[first], m[first], at[first], at[np.append(first[1:], len(at)) - 1] + 1


def _segments(data: np.ndarray, off: np.ndarray, rows: range, hot: Sequence[np.ndarray] = ()) -> tuple[np.ndarray, ...]:
    """(row, key, first window, last window + 1, as offsets in data, wide) of all runs of windows with one key.

    hot: by level the keys that get a finer one; what the last level lists stays as it is and is wide.
    """
    row, key, start, end = _plain(data, off, rows)
    wide = np.zeros(len(row), bool)
    for level, known in enumerate(hot, 1):
        own = np.isin(key, known)
        if level == LEVELS or not own.any():
            wide = own
            break
        nth, k, a, b = _finer(data, key[own], start[own], end[own], level)
        parts = zip((row, key, start, end), (row[own][nth], k, a, b), strict=True)
        row, key, start, end = (np.concatenate((x[~own], y)) for x, y in parts)
        order = np.argsort(start, kind="stable")
        row, key, start, end = row[order], key[order], start[order], end[order]
        wide = np.zeros(len(row), bool)
    return row, key, start, end, wide


def _small(x: np.ndarray, limit: int) -> np.ndarray:
    """Whole numbers under the limit in the type that sorts fastest: two bytes go by radix."""
    return x.astype(np.uint16) if limit <= 1 << 16 else x


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, range]]:
    data, off = K.texts_of(batch.column(2))
    for i, j in K.slices(off):
        yield data, off, range(i, j)


def _sampled_keys(hot: Sequence[np.ndarray], batches):  # noqa: ANN001, ANN202
    """The distinct keys of each text, as finer as hot makes them; where hot has levels, only those of its last one."""
    for batch in batches:
        for data, off, rows in _texts(batch):
            row, key, start, end, _ = _segments(data, off, rows, hot)
            if hot:
                _, plain, _, _ = _plain(data, off, rows)
                finer = ~np.isin(key, plain)
                row, key = row[finer], key[finer]
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64))], names=["key"])


def _hot_keys(keyed: DataFrame, texts: int, buckets: int, sample: int = SAMPLE, share: float = HOT_SHARE, least: int = HOT_LEAST) -> list[np.ndarray]:
    """By level, the keys that would fill `share` of a bucket, counted in some `sample` texts, picked by digest.

    All keys fill the buckets once, so buckets / share keys are hot at most.
    """
    limit = min(1 << 32, int((1 << 32) * sample / max(1, texts)))
    picked = keyed.where(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") < limit).select("digest", "text").groupBy("digest").agg(F.any_value("text").alias("text"))
    picked = saved(picked.select("digest", F.lit(0).alias("id"), "text"))
    hot: list[np.ndarray] = []
    floor = 0
    for _ in range(LEVELS):
        counts = picked.mapInArrow(lambda b, hot=tuple(hot): _sampled_keys(hot, b), "key long").groupBy("key").count()
        floor = floor or max(least, math.ceil(share * (counts.agg(F.sum("count")).first()[0] or 0) / buckets))
        found = np.array([r.key for r in counts.where(F.col("count") >= floor).select("key").collect()], np.int64).view(np.uint64)
        if not len(found):
            break
        hot.append(np.sort(found))
    return hot


def _pack_keys(buckets: int, hot: Broadcast, batches):  # noqa: ANN001, ANN202
    """(bucket, texts: digests of some texts, packed) with the distinct keys of each text as hashes and text numbers."""
    for batch in batches:
        names = batch.column(0)
        parts = [(row[~wide], key[~wide]) for data, off, rows in _texts(batch) for row, key, _, _, wide in [_segments(data, off, rows, hot.value)]]
        row, key = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else ((np.zeros(0, np.int64)), np.zeros(0, np.uint64))
        order = np.argsort(key)
        order = order[np.argsort(_small(row[order], len(names)), kind="stable")]
        row, key = row[order], key[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        row, key = row[new], key[new]
        bucket, rest = (key >> np.uint64(32)) % np.uint64(buckets), key.astype(np.uint32)
        order = np.argsort(_small(bucket, buckets), kind="stable")
        at = np.append(K.runs(bucket[order]), len(order))
        for a, b in zip(at[:-1], at[1:], strict=True):
            own = order[a:b]
            texts, nth = np.unique(row[own], return_inverse=True)
            for c in range(0, len(texts), 1 << 16):  # two bytes of number
                in_c = (nth >= c) & (nth < c + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(bucket[order[a]])], pa.int32()), pa.array([b"".join(names.take(pa.array(texts[c : c + (1 << 16)])).to_pylist())]), pa.array([rest[own][in_c].tobytes()]), pa.array([(nth[in_c] - c).astype(np.uint16).tobytes()])],
                    names=["bucket", "texts", "keys", "nth"],
                )


def _shared_keys(batches):  # noqa: ANN001, ANN202
    """(digest, keys): for each text of a bucket the keys that another text has, too."""
    buckets: dict[int, list] = {}
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            buckets.setdefault(r[0], []).append(r[1:])
    for bucket in sorted(buckets):
        parts = buckets.pop(bucket)
        base, key, nth, names = 0, [], [], []
        for texts, k, t in parts:
            names.append(np.frombuffer(texts, "V16"))
            key.append(np.frombuffer(k, np.uint32))
            nth.append(np.frombuffer(t, np.uint16).astype(np.int64) + base)
            base += len(names[-1])
        names, key, nth = np.concatenate(names), np.concatenate(key), np.concatenate(nth)
        order = np.argsort(key, kind="stable")
        at = K.runs(key[order])
        size = np.diff(np.append(at, len(order)))
        own = order[np.repeat(size > 1, size)]
        own = own[np.argsort(nth[own], kind="stable")]
        cut = np.append(K.runs(nth[own]), len(own))
        for a in range(0, len(cut) - 1, 4096):
            part = [(cut[i], cut[i + 1]) for i in range(a, min(a + 4096, len(cut) - 1))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[nth[own[x]]].tobytes() for x, _ in part], pa.binary()), pa.array([key[own[x:y]].tobytes() for x, y in part], pa.binary())],
                names=["digest", "keys"],
            )


def _packed(parts: list[np.ndarray | bytes]) -> bytes:
    """The parts' sizes and bytes in one compressed string."""
    raw = [x if isinstance(x, bytes) else x.tobytes() for x in parts]
    body = np.array([len(raw), *map(len, raw)], np.int64).tobytes() + b"".join(raw)
    return len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def _unpacked(packed: bytes) -> list[memoryview]:
    body = memoryview(pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True))
    n = int(np.frombuffer(body, np.int64, 1)[0])
    ends = np.cumsum(np.frombuffer(body, np.int64, n, 8)) + 8 * (n + 1)
    return [body[a:b] for a, b in zip([8 * (n + 1), *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _known(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The shared keys of each text of a batch, end to end, and where each text's begin. 32 bits tell a text's own keys apart."""
    flat = lists.flatten()
    count = np.array([0, *pc.binary_length(flat).to_pylist()], np.int64) // 4
    at = lists.offsets.to_numpy().astype(np.int64)
    return np.frombuffer(b"".join(flat.to_pylist()), np.uint32), np.cumsum(count)[at - at[0]]


def _pack_segments(buckets: int, hot: Broadcast, batches):  # noqa: ANN001, ANN202
    """(bucket, segments): the distinct segments of some texts, packed with who has them and where."""
    for batch in batches:
        names, ids, (codes, code_at) = batch.column(0).to_pylist(), batch.column(1).to_numpy(), _known(batch.column(3))
        found: dict[int, dict[bytes, list[int]]] = {}
        for data, off, rows in _texts(batch):
            row, key, start, end, wide = _segments(data, off, rows, hot.value)
            row, key, start, end = row[~wide], key[~wide], start[~wide], end[~wide]
            bucket = (key >> np.uint64(32)) % np.uint64(buckets)
            code = key.astype(np.uint32)
            held = code_at[rows[0] : rows[-1] + 2]
            known = np.repeat(np.arange(len(rows)), np.diff(held)).astype(np.uint64) << np.uint64(32) | codes[held[0] : held[-1]]
            shared = np.isin((row - rows[0]).astype(np.uint64) << np.uint64(32) | code, known)
            row, bucket, start, end, lo = row[shared], bucket[shared], start[shared], end[shared], int(off[rows[0]])
            raw = data[lo : off[rows[-1] + 1]].tobytes()
            for n, k, a, b, at in zip(bucket.tolist(), row.tolist(), (start - lo).tolist(), (end + SPAN - 1 - lo).tolist(), (start - off[row]).tolist(), strict=True):
                found.setdefault(n, {}).setdefault(raw[a:b], []).extend((k, at))
        for n, segments in found.items():
            owners = list(segments.values())
            every = np.fromiter(chain.from_iterable(owners), np.int64).reshape(-1, 2)
            texts, nth = np.unique(every[:, 0], return_inverse=True)
            packed = _packed([
                b"".join(names[k] for k in texts.tolist()), ids[texts], np.array([len(x) for x in segments], np.uint32), np.array([len(x) // 2 for x in owners], np.uint32),
                nth.astype(np.uint32), every[:, 1].astype(np.uint32), b"".join(segments),
            ])
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([packed], pa.binary())], names=["bucket", "segments"])


def _spans(part: np.ndarray, segments: list[bytes], low: np.ndarray, bound: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(texts, starts, ends) of the spans that go in the distinct segments of the numbers in part, which are those of whole keys.

    low: the smallest id of each segment; rows: text, id and first byte of all owners, those of segment n from bound[n] on.
    """
    own = [segments[n] for n in part.tolist()]
    size = np.array([len(s) for s in own], np.int64)
    ends = np.cumsum(size)
    smallest = window_groups(np.frombuffer(b"".join(own), np.uint8), ends - size, ends, low[part])
    base = ends - size + np.arange(len(size))
    # smallest and greatest id among each segment's windows; the positions between hold NO_ID and are left out
    bounds = np.stack((base, base + size - SPAN + 1), axis=1).ravel()
    firsts, lasts = np.minimum.reduceat(smallest, bounds)[::2], np.maximum.reduceat(smallest, bounds)[::2]
    nth, at = _ranges(bound[part + 1] - bound[part])
    text, id, at = rows[:, at + bound[part][nth]]
    whole = lasts[nth] < id
    yield text[whole], at[whole], at[whole] + size[nth[whole]]
    some = np.flatnonzero(~whole & (firsts[nth] < id))
    windows = size[nth[some]] - SPAN + 1
    for a, b in K.slices(np.concatenate(([0], np.cumsum(windows)))):
        row = some[a:b]
        which, inside = _ranges(windows[a:b])
        gone = np.flatnonzero(smallest[base[nth[row]][which] + inside] < id[row][which])
        which, inside = which[gone], inside[gone]
        new = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (inside[1:] > inside[:-1] + SPAN))))
        last, row = np.append(new[1:], len(gone)) - 1, row[which[new]]
        yield text[row], at[row] + inside[new], at[row] + inside[last] + SPAN


def _ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts 2, 1: (0, 0, 1) and (0, 1, 0)."""
    nth = np.repeat(np.arange(len(counts)), counts)
    return nth, np.arange(len(nth)) - np.repeat(np.cumsum(counts) - counts, counts)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that end at the given bytes of data."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data.tobytes())])


def _sort(batches):  # noqa: ANN001, ANN202
    """(digest, spans): packed pairs of start and end, for each text of a bucket that loses some there."""
    buckets: dict[int, list[bytes]] = {}
    for batch in batches:
        for bucket, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            buckets.setdefault(bucket, []).append(packed)
    for bucket in sorted(buckets):
        names, rows, nths, number, base = [], [], [], {}, 0
        for packed in buckets.pop(bucket):
            digests, ids, size, count, nth, at, raw = _unpacked(packed)
            nth, ids, raw = np.frombuffer(nth, np.uint32).astype(np.int64), np.frombuffer(ids, np.int64), bytes(raw)
            rows.append(np.stack((nth + base, ids[nth], np.frombuffer(at, np.uint32).astype(np.int64))))
            names.append(np.frombuffer(digests, "V16"))
            base += len(ids)
            ends = np.cumsum(np.frombuffer(size, np.uint32), dtype=np.int64).tolist()
            own = [number.setdefault(raw[a:b], len(number)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            nths.append(np.repeat(np.array(own, np.int64), np.frombuffer(count, np.uint32)))
        names, rows, nth, segments = np.concatenate(names), np.concatenate(rows, axis=1), np.concatenate(nths), list(number)
        order = np.argsort(_small(nth, len(segments)), kind="stable")
        rows, nth = rows[:, order], nth[order]
        bound = np.append(K.runs(nth), len(nth))
        low, size = np.minimum.reduceat(rows[1], bound[:-1]), np.array([len(s) for s in segments], np.int64)
        key = np.concatenate([_first_keys(segments[i : i + 4096]) for i in range(0, len(segments), 4096)])
        order = np.argsort(key, kind="stable")
        count = np.diff(np.append(K.runs(key[order]), len(order)))
        alone = np.empty(len(order), bool)
        alone[order] = np.repeat(count == 1, count)
        own = np.flatnonzero(alone[nth] & (rows[1] > low[nth]))  # one segment has nothing to be sorted against
        found = [(rows[0, own], rows[2, own], rows[2, own] + size[nth[own]])]
        rest, cut = order[~alone[order]], np.cumsum(count[count > 1])
        held = np.cumsum(size[rest])[cut - 1]
        a = done = 0
        while a < len(rest):
            last = min(int(np.searchsorted(held, done + SORT_BYTES, "right")), len(cut) - 1)
            found += _spans(rest[a : cut[last]], segments, low, bound, rows)
            a, done = int(cut[last]), int(held[last])
        text, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(text, kind="stable")
        text, pairs = text[order], np.stack((start[order], end[order]), axis=1).astype(np.uint32)
        cut = np.append(K.runs(text), len(text))
        for a in range(0, len(cut) - 1, 8192):
            part = cut[a : a + 8193]
            digests = names[text[part[:-1]]]
            yield pa.RecordBatch.from_arrays([_binary(digests, 16 * np.arange(1, len(digests) + 1)), _binary(pairs[part[0] : part[-1]], 8 * (part[1:] - part[0]))], names=["digest", "spans"])


def _first_keys(segments: list[bytes]) -> np.ndarray:
    """The key of each segment, that of its first window."""
    return _keys(np.frombuffer(b"".join([s[:SPAN] for s in segments]), np.uint8))[::SPAN]


def _wide_segments(hot: Broadcast, batches):  # noqa: ANN001, ANN202
    """(key, segment, digest, id, at) of the wide segments of each text."""
    for batch in batches:
        names, ids = batch.column(0), batch.column(1).to_numpy()
        for data, off, rows in _texts(batch):
            row, key, start, end, wide = _segments(data, off, rows, hot.value)
            row, key, start, end = row[wide], key[wide], start[wide], end[wide] + SPAN - 1
            for a in range(0, len(row), 8192):
                part = slice(a, a + 8192)
                own = [data[x:y].tobytes() for x, y in zip(start[part].tolist(), end[part].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[part].view(np.int64)), pa.array(own, pa.binary()), names.take(pa.array(row[part])), pa.array(ids[row[part]]), pa.array((start - off[row])[part])],
                    names=["key", "segment", "digest", "id", "at"],
                )


def _sort_wide(batches):  # noqa: ANN001, ANN202
    """(segment, runs: windows from and to, and the smallest id of the texts that hold them). Rows come sorted by key."""
    shape = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("low", pa.int64())]))

    def out(segments: list[bytes], ids: list[int]):  # noqa: ANN202
        size = np.array([len(x) for x in segments], np.int64)
        ends = np.cumsum(size)
        low = window_groups(np.frombuffer(b"".join(segments), np.uint8), ends - size, ends, np.array(ids, np.int64))
        base = np.concatenate(([0], np.cumsum(size + 1)))[:-1].tolist()
        runs = []
        for b, n in zip(base, size.tolist(), strict=True):
            own = low[b : b + n - SPAN + 1]
            at = K.runs(own)
            runs.append([{"first": x, "last": y, "low": v} for x, y, v in zip(at.tolist(), [*at[1:].tolist(), len(own)], own[at].tolist(), strict=True)])
        return pa.RecordBatch.from_arrays([pa.array(segments, pa.binary()), pa.array(runs, shape)], names=["segment", "runs"])

    key, segments, ids, held = None, [], [], 0
    for batch in batches:
        for k, segment, id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key and held > SORT_BYTES:
                yield out(segments, ids)
                segments, ids, held = [], [], 0
            key = k
            segments.append(segment)
            ids.append(id)
            held += len(segment)
    if segments:
        yield out(segments, ids)


def _wide_spans(texts: DataFrame, hot: Broadcast) -> DataFrame:
    """(digest, spans) as _sort has them, by joins on the wide segments."""
    rows = texts.mapInArrow(lambda b: _wide_segments(hot, b), "key long, segment binary, digest binary, id long, at long")
    distinct = rows.groupBy("key", "segment").agg(F.min("id").alias("id")).repartition("key").sortWithinPartitions("key")
    runs = distinct.mapInArrow(_sort_wide, "segment binary, runs array<struct<first:long,last:long,low:long>>")
    gone = rows.select("segment", "digest", "id", "at").join(runs, "segment")
    gone = gone.select("digest", "at", F.filter("runs", lambda r: r["low"] < F.col("id")).alias("runs")).where("size(runs) > 0")

    def pack(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            lists, at = batch.column(2), batch.column(1).to_numpy()
            flat, off = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
            base = np.repeat(at, np.diff(off))
            both = np.stack((flat.field(0).to_numpy() + base, flat.field(1).to_numpy() + base + SPAN - 1), axis=1).astype(np.uint32)
            bound = off - off[0]
            packed = [both[a:b].tobytes() for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["digest", "spans"])

    return gone.mapInArrow(pack, "digest binary, spans binary")


def _kept(batches):  # noqa: ANN001, ANN202
    shape = pa.schema([("digest", pa.binary()), ("id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    for batch in batches:
        for i, j in K.slices(K.texts_of(batch.column(2))[1]):
            rows = []
            for digest, id, text, spans in zip(*(batch.column(c).slice(i, j - i).to_pylist() for c in range(4)), strict=True):
                s, e = K.merged(*np.frombuffer(b"".join(spans), np.uint32).astype(np.int64).reshape(-1, 2).T) if spans else ((), ())
                s, e = [int(x) for x in s], [int(x) for x in e]
                kept = b"".join(text[a:b] for a, b in zip([0, *e], [*s, len(text)], strict=True))
                rows.append({"digest": digest, "id": id, "n_bytes": len(text), "kept": kept, "spans": [{"start": a, "end": b} for a, b in zip(s, e, strict=True)]})
            yield pa.RecordBatch.from_pylist(rows, schema=shape)


def suffix_dedup(docs: DataFrame, sample: int = SAMPLE, share: float = HOT_SHARE, least: int = HOT_LEAST) -> DataFrame:
    """One row per document: doc_id, n_bytes, kept (the remaining bytes), spans removed (maximal, byte offsets).

    Null texts count as empty and lose nothing, as do texts under SPAN bytes. A null doc_id stands behind all others.
    Documents with the same id never remove from each other, and a document never from itself. Repeated rows give
    repeated results. Further columns are ignored; an empty table gives no rows. sample, share and least choose the hot
    keys, which deal out the work and change no result.
    """
    docs = docs.select(id_or_last().alias("id"), utf8().alias("text"))
    count, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    buckets = max(BUCKETS, partitions(docs), size // BUCKET_BYTES)
    # Never null: else joins would filter it, and the readers of texts below would no longer share one plan.
    keyed = docs.select(F.coalesce(F.unhex(F.substring(F.sha2("text", 256), 1, 32)), F.lit(b"")).alias("digest"), "id", "text")
    hot_keys = _hot_keys(keyed, count, buckets, sample, share, least)
    hot = docs.sparkSession.sparkContext.broadcast(hot_keys)
    # All readers of texts take the same columns, so their plans agree and the texts are shuffled once.
    texts = keyed.groupBy("digest").agg(F.min("id").alias("id"), F.any_value("text").alias("text"))
    # The number of a bucket is the number of its partition: hashing the numbers would put several into one task.
    keys = texts.mapInArrow(lambda b: _pack_keys(buckets, hot, b), "bucket int, texts binary, keys binary, nth binary")
    shared = keys.repartitionById(buckets, F.col("bucket")).mapInArrow(_shared_keys, "digest binary, keys binary").groupBy("digest").agg(F.collect_list("keys").alias("keys"))
    segments = texts.join(shared, "digest").select("digest", "id", "text", "keys").mapInArrow(lambda b: _pack_segments(buckets, hot, b), "bucket int, segments binary")
    spans = segments.repartitionById(buckets, F.col("bucket")).mapInArrow(_sort, "digest binary, spans binary")
    if len(hot_keys) == LEVELS and len(hot_keys[-1]):
        spans = spans.unionByName(_wide_spans(texts, hot))
    by_text = spans.groupBy("digest").agg(F.collect_list("spans").alias("spans"))
    done = texts.join(by_text, "digest", "left").select("digest", "id", "text", "spans").mapInArrow(_kept, "digest binary, id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>")
    # Copies of a first text, without the texts: all of a copy is covered, unless it is too short for a window.
    n_bytes = F.length("text").cast("long")
    small = keyed.select("digest", "id", n_bytes.alias("n_bytes"), F.when(n_bytes < SPAN, F.col("text")).otherwise(F.lit(b"")).alias("kept"))
    first = small.groupBy("digest").agg(F.min("id").alias("first"))
    rows = small.join(first, "digest")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    copies = rows.where("id > first").select("id", "n_bytes", "kept", F.when(F.col("n_bytes") < SPAN, F.slice(whole, 1, 0)).otherwise(whole).alias("spans"))
    again = rows.where("id = first").groupBy("digest").agg(F.count("*").cast("int").alias("n")).where("n > 1")
    # Rows that repeat a first one are few: a count for each, which Spark broadcasts only while it is small.
    out = done.join(again, "digest", "left") if again.take(1) else done.withColumn("n", F.lit(1))
    out = out.withColumn("nth", F.explode(F.sequence(F.lit(1), F.coalesce("n", F.lit(1))))).select("id", "n_bytes", "kept", "spans").unionByName(copies)
    return out.select(shown_id("id").alias("doc_id"), "n_bytes", "kept", "spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(load(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def brute(docs: list[tuple[int | None, str | None]]) -> list[tuple]:
    """The contract, word for word, for small tests: (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    rows = [(K.NO_ID if i is None else i, (t or "").encode()) for i, t in docs]
    first: dict[bytes, int] = {}
    for i, t in rows:
        for p in range(len(t) - SPAN + 1):
            w = t[p : p + SPAN]
            first[w] = min(first.get(w, K.NO_ID), i)
    out = []
    for i, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - SPAN + 1):
            if first[t[p : p + SPAN]] < i:
                gone[p : p + SPAN] = True
        starts = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(t) else 0
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((None if i == K.NO_ID else i, len(t), int(gone[: len(t)].sum()), starts, hashlib.sha256(kept).hexdigest()))
    return out
