"""Document fingerprints as improbable-feature digests.

Every window of ``WIDTH`` bytes is a feature. Its rarity rank comes from its entropy (in fixed point,
exact at any block size): the further from the entropy usual in text, the rarer; almost constant windows
come last. A feature is selected if it is the leftmost rarest one in at least ``POPULAR`` of the runs of
``RUN`` neighbours that hold it, counting runs that reach over the ends of the text, so texts of any length
are treated alike. Selected features, without repeats and in text order, go into a chain of Bloom filters of
2048 bits, 5 bits a feature, ``FILL`` features a filter.

Likeness averages, over the filters of the shorter chain, the best overlap with a filter of the other,
normalised so that 0 is the overlap by chance and 1 the largest possible one.

A text shorter than a window, or without a selected feature, has one feature, the whole text; an empty
or null text has an empty chain, like only another empty one.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Hasher, spans, tidy

WIDTH, RUN, POPULAR, FILL, BITS, PICKS = 16, 32, 8, 160, 2048, 5
#: Entropy in bits usual in windows of running text, and the least of an informative window.
USUAL, LEAST = 3.2, 1.0
_SCALE = 1024
_F = np.rint(np.arange(WIDTH + 1) * np.log2(np.maximum(1, np.arange(WIDTH + 1))) * _SCALE).astype(np.int32)
_STEP = np.diff(_F, prepend=0).astype(np.int32)


def _rarity(data: np.ndarray) -> np.ndarray:
    """Rank of the window that starts at each byte (smaller is rarer); windows past the end count as usual."""
    n = len(data)
    back, ahead = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for k in range(1, min(WIDTH, n)):
        same = (data[k:] == data[:-k]).view(np.uint8)
        back[k:] += same
        ahead[:-k] += same
    change = _STEP[back].copy()
    change[WIDTH:] -= _STEP[ahead[: max(0, n - WIDTH)]]
    total = np.cumsum(change, dtype=np.int64)[WIDTH - 1 :]  # of c * log2(c) over the window's byte counts
    scaled = int(np.log2(WIDTH) * _SCALE) - total // WIDTH
    rank = 8 * _SCALE - np.abs(scaled - int(USUAL * _SCALE))
    rank[scaled < LEAST * _SCALE] = 16 * _SCALE
    return rank


def _features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, 64-bit hash) of each selected feature, in text order and without repeats in a document."""
    n, sizes = len(data), np.diff(off)
    hasher = Hasher(data)
    doc = at = np.zeros(0, np.int64)
    if n >= WIDTH:
        # by document first: a run that reaches into the next one finds nothing less there
        key = np.full(n, np.iinfo(np.int64).max)
        rank = _rarity(data)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        key[: len(rank)] = (owner[: len(rank)] << 46) | (rank << 31) | np.arange(len(rank))
        inside = np.arange(n) + WIDTH <= off[1:][owner]
        key[~inside] = np.iinfo(np.int64).max
        least = np.concatenate((key, np.full(RUN, np.iinfo(np.int64).max)))
        for s in (1, 2, 4, 8, 16):
            least = np.minimum(least[:-s], least[s:])
        best = least[:n][inside] & 0x7FFFFFFF
        # runs that begin before the text: the rarest of its first windows
        ahead = off[:-1, None] + np.arange(RUN - 1)
        own = ahead + WIDTH <= off[1:, None]
        lead = np.minimum.accumulate(np.where(own, key[np.minimum(ahead, n - 1)], np.iinfo(np.int64).max), axis=1)
        lead = lead[(sizes >= WIDTH)] & 0x7FFFFFFF
        popular = np.bincount(best, minlength=n)[:n] + np.bincount(lead.ravel(), minlength=n)[:n] >= POPULAR
        at = np.flatnonzero(popular & inside)
        doc = owner[at]
    bare = np.setdiff1d(np.flatnonzero(sizes), doc)
    start = np.concatenate((at, off[bare]))
    end = np.concatenate((at + WIDTH, off[bare + 1]))
    doc = np.concatenate((doc, bare))
    h = hasher(start, end)
    order = np.lexsort((start, h, doc))
    d, x = doc[order], h[order]
    first = np.ones(len(d), bool)
    first[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    kept = order[first]
    kept = kept[np.lexsort((start[kept], doc[kept]))]
    return doc[kept], h[kept]


def chains(texts: list[bytes]) -> list[np.ndarray]:
    """The Bloom filters of each text: arrays of shape (filters, 256)."""
    out: list[np.ndarray] = []
    off = np.cumsum([0, *map(len, texts)])
    for i, j in spans(off, 1 << 17):
        at = off[i : j + 1] - off[i]
        doc, h = _features(np.frombuffer(b"".join(texts[i:j]), np.uint8), at)
        count = np.bincount(doc, minlength=j - i)
        filters = -(-count // FILL)
        base, first = np.cumsum(filters) - filters, np.cumsum(count) - count
        slot = base[doc] + (np.arange(len(doc)) - first[doc]) // FILL
        bits = np.zeros(int(filters.sum()) * BITS, bool)
        for p in range(PICKS):
            bits[slot * BITS + ((h >> np.uint64(11 * p)) & np.uint64(BITS - 1)).astype(np.int64)] = True
        packed = np.packbits(bits).reshape(-1, BITS // 8)
        out += [packed[b : b + f] for b, f in zip(base, filters)]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; symmetric."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if (len(b), b.tobytes()) < (len(a), a.tobytes()):
        a, b = b, a
    best = np.zeros(len(a), np.float32)
    for i in range(0, len(a), 64):
        x = np.unpackbits(a[i : i + 64], axis=1).astype(np.float32)
        size_a = x.sum(1)
        for j in range(0, len(b), 64):
            y = np.unpackbits(b[j : j + 64], axis=1).astype(np.float32)
            size_b = y.sum(1)
            most = np.minimum(size_a[:, None], size_b[None, :])
            chance = size_a[:, None] * size_b[None, :] / BITS
            near = np.clip((x @ y.T - chance) / np.maximum(most - chance, 1e-6), 0, 1).max(1)
            best[i : i + 64] = np.maximum(best[i : i + 64], near)
    return float(best.mean(dtype=np.float64))


def to_text(chain: np.ndarray) -> str:
    """``filters:base64 of the filters``; equal for equal chains."""
    return f"{len(chain)}:{base64.b64encode(chain.tobytes()).decode()}"


def from_text(value: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(value.partition(":")[2]), np.uint8).reshape(-1, BITS // 8)


def edited(text: str, following: str) -> str:
    """The last third (rounded down) replaced by as much, or all, of the start of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut] if cut else text


def _places(key: pa.Array, order: pa.Array) -> np.ndarray:
    """Keys and hashes as 17 bytes that compare as pairs of integers do; a null key is the least."""
    top = np.uint64(1 << 63)
    k, h = (np.asarray(x.fill_null(0)).astype(np.int64).view(np.uint64) ^ top for x in (key, order))
    null = np.asarray(key.is_null())
    both = np.stack((np.where(null, np.uint64(0), k), h), axis=1).astype(">u8")  # stack() would give native bytes
    return np.concatenate((~null[:, None], both.view(np.uint8)), axis=1, dtype=np.uint8, casting="unsafe").view("S17").reshape(-1)


def with_next(docs: DataFrame, key: str, text: str, rows_per_bucket: int = 1024, most_buckets: int = 100_000, sample: int = 20) -> DataFrame:
    """The rows of ``docs`` (key and text) in buckets of the key, ready for a pass in descending order.

    Returns _bucket, _head (0, or 1 for a copy of the row that follows the bucket), key and text, sorted in
    each partition. Buckets are ranges; where to cut is read from a sample of the rows' places, at most about
    ``sample * most_buckets`` of 17 bytes, and changes no result. The last row is followed by the first one. Rows
    with the same key follow each other by a hash of their texts, then by text, and may fill many buckets."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("_k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t")).withColumn("_h", F.xxhash64("_t"))
    places = rows.select("_k", "_h")
    total = docs.count()
    n = max(1, min(most_buckets, -(-total // rows_per_bucket)))
    share = min(1.0, sample * n / max(1, total))
    picked = places.where(F.pmod(F.xxhash64("_k", "_h"), F.lit(1 << 40)) < int(share * (1 << 40))).toArrow() if n > 1 else None
    bounds = np.zeros(0, "S17")
    if picked is not None and len(picked):
        found = np.sort(_places(*(picked.column(c).combine_chunks() for c in ("_k", "_h"))))
        bounds = np.unique(found[np.linspace(0, len(found) - 1, n + 1).astype(int)[1:-1]])

    def bucket(batches):
        for b in batches:
            place = len(bounds) - np.searchsorted(bounds, _places(b.column("_k"), b.column("_h")), "left")
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), *b.columns], names=["_bucket", *b.schema.names])

    top = F.max(F.struct(F.col("_k").isNotNull(), "_k", "_h")).alias("top")
    tops = {r[0]: (r.top._k, r.top._h) for r in places.mapInArrow(bucket, "_bucket long, _k long, _h long").groupBy("_bucket").agg(top).collect()}
    placed = rows.mapInArrow(bucket, "_bucket long, _k long, _t string, _h long").select("_bucket", F.lit(0).alias("_head"), "_k", "_t", "_h")
    order = sorted(tops)
    follows = [(order[i], *tops[order[(i + 1) % len(order)]]) for i in range(len(order))]
    wanted = spark.createDataFrame(follows, "_bucket long, _wk long, _wh long")
    heads = rows.join(F.broadcast(wanted), rows._k.eqNullSafe(wanted._wk) & (rows._h == wanted._wh)).groupBy("_bucket").agg(F.max(F.struct("_t", "_k", "_h")).alias("x")).select("_bucket", F.lit(1).alias("_head"), "x._k", "x._t", "x._h")
    return placed.unionByName(heads).repartition("_bucket").sortWithinPartitions("_bucket", "_head", F.desc_nulls_last("_k"), F.desc("_h"), F.desc("_t")).drop("_h")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text (see ``edited``; the following text is that of the
    next smaller key), with the likeness of its fingerprint to the edited text's and to the next one's.

    Null texts count as empty, null keys come last; a single row is followed by itself; rows with equal keys follow each
    other as ``with_next`` tells, repeated rows one after the other; other columns are not read."""

    def run(batches):
        held = None  # the row whose following row comes with the next batch
        for b in batches:
            rows = list(zip(b.column("_bucket").to_pylist(), b.column("_head").to_pylist(), b.column("_k").to_pylist(), b.column("_t").to_pylist()))
            if held:
                rows.insert(0, held)
            held = rows[-1] if rows else None
            size, part = 0, []
            for i, (x, y) in enumerate(zip(rows, rows[1:])):
                if not x[1]:
                    part.append((x, y))
                    size += len(x[3])
                if part and (size > 2_000_000 or i == len(rows) - 2):
                    yield _batch(part)
                    size, part = 0, []
            if part:
                yield _batch(part)

    return with_next(docs, key, text).mapInArrow(tidy(run), f"{key} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("_k", key)


def _batch(pairs: list[tuple]) -> pa.RecordBatch:
    own = [x[3].encode() for x, _ in pairs]
    new = [edited(x[3], y[3]).encode() for x, y in pairs]
    last = [y[3].encode() for i, (_, y) in enumerate(pairs) if i + 1 == len(pairs) or pairs[i + 1][0] is not y]
    found = chains([*own, *new, *last])
    a, b, rest = found[: len(own)], found[len(own) : 2 * len(own)], iter(found[2 * len(own) :])
    after = [next(rest) if i + 1 == len(pairs) or pairs[i + 1][0] is not y else a[i + 1] for i, (_, y) in enumerate(pairs)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([x[2] for x, _ in pairs], pa.int64()), pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in new]), pa.array(map(to_text, a), pa.string()), pa.array(map(to_text, b), pa.string()),
            pa.array(map(likeness, a, b), pa.float64()), pa.array(map(likeness, a, after), pa.float64()),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
