"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over bytes, up to ``order`` bytes deep, whose counts are frozen after
training. A byte costs -log2 of its frequency in the longest context in which it was seen, plus the
escapes (method C: distinct / (total + distinct)) of the longer contexts that are known without it; an
unseen byte costs 8 bits below order 0. The code length of a text is the exact sum in 1/4096 bits.

Because the counts are frozen, the whole walk from a context to its fallbacks is a fixed cost for each
(context, byte): it is tabulated once for all languages, and scoring is a table lookup for each byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import spans, text_bytes, tidy

UNIT = 4096
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class _Table:
    """A frozen hash table of 64-bit keys with linear probing; looks many keys up at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.keys = np.full(1 << self.bits, _NONE)
        self.value = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot[left]] == _NONE
            _, first = np.unique(slot[left[free]], return_index=True)
            put = left[free][first]
            self.keys[slot[put]], self.value[slot[put]] = keys[put], put
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, or -1."""
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.value[slot], -1)
        left = np.flatnonzero((held != keys) & (held != _NONE))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[left]]
            hit = held == keys[left]
            out[left[hit]] = self.value[slot[left[hit]]]
            left = left[~hit & (held != _NONE)]
        return out


def _grams(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, k bytes before and the byte itself as one key) where the document has k bytes before."""
    key = data.astype(np.uint64)
    for j in range(1, k + 1):
        key[j:] |= data[: len(data) - j].astype(np.uint64) << np.uint64(8 * j) if len(data) > j else np.uint64(0)
    begin = np.repeat(off[:-1], np.diff(off))
    at = np.flatnonzero(np.arange(len(data)) - begin >= k)
    return at, key[at]


class PPM:
    """The frozen model of all languages, in groups of ``together``: a language's costs hang on its own texts alone, so groups
    change no result, and the tables grow with the languages, not with their square."""

    def __init__(self, texts: dict[str, list[str]], order: int = 4, together: int = 8):
        self.order, self.languages = order, sorted(texts)
        self.groups = [_Group({n: texts[n] for n in self.languages[i : i + together]}, order) for i in range(0, len(self.languages), together)]

    def bits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length of each document in each language, in 1/4096 bits."""
        if not self.groups:
            return np.zeros((len(off) - 1, 0), np.int64)
        return np.concatenate([g.bits(data, off) for g in self.groups], axis=1)


class _Group:
    """For each order a table of (context, byte) with its cost in every language of the group, and one of contexts with their escape
    costs. At most ``languages * sample bytes * (order + 1)`` entries."""

    def __init__(self, texts: dict[str, list[str]], order: int):
        self.order, self.languages = order, sorted(texts)
        n = len(self.languages)
        self.costs: list[tuple[_Table, np.ndarray]] = []
        self.escapes: list[tuple[_Table, np.ndarray]] = []
        below: tuple[_Table, np.ndarray] | None = None
        corpora = []
        for name in self.languages:
            raw = [t.encode() for t in texts[name]]
            corpora.append((np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])))
        for k in range(order + 1):
            counted = [np.unique(_grams(*c, k)[1], return_counts=True) for c in corpora]
            keys = np.unique(np.concatenate([g for g, _ in counted] or [np.zeros(0, np.uint64)]))
            contexts = np.unique(keys >> np.uint64(8))
            cost = np.full((len(keys), n), -1, np.int64)
            escape = np.zeros((len(contexts), n), np.int64)
            for i, (g, c) in enumerate(counted):
                own, at, kinds = np.unique(g >> np.uint64(8), return_inverse=True, return_counts=True)
                total = np.bincount(at, c, len(own))
                cost[np.searchsorted(keys, g), i] = np.rint(-np.log2(c / (total + kinds)[at]) * UNIT)
                escape[np.searchsorted(contexts, own), i] = np.rint(-np.log2(kinds / (total + kinds)) * UNIT)
            if below is None:
                lower = np.full((len(keys), n), 8 * UNIT, np.int64)
            else:
                lower = below[1][below[0].find(keys & np.uint64((1 << 8 * k) - 1))]
            fall = escape[np.searchsorted(contexts, keys >> np.uint64(8))] + lower
            below = (_Table(keys), np.where(cost >= 0, cost, fall).astype(np.int32))
            self.costs.append(below)
            self.escapes.append((_Table(contexts), escape.astype(np.int32)))

    def bits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length of each document in each language of the group."""
        n = len(self.languages)
        out = np.zeros((len(off) - 1, n), np.int64)
        if not len(data) or not n:
            return out
        spent = np.zeros((len(data), n), np.int32)
        open_ = np.ones(len(data), bool)
        for k in range(self.order, -1, -1):
            at, keys = _grams(data, off, k)
            if k < self.order:
                sel = open_[at]
                at, keys = at[sel], keys[sel]
            table, cost = self.costs[k]
            found = table.find(keys)
            hit = found >= 0
            spent[at[hit]] += cost[found[hit]]
            open_[at[hit]] = False
            at, keys = at[~hit], keys[~hit]
            table, escape = self.escapes[k]
            found = table.find(keys >> np.uint64(8))
            known = found >= 0
            spent[at[known]] += escape[found[known]]
        spent[open_] += 8 * UNIT
        full = np.flatnonzero(np.diff(off))
        out[full] = np.add.reduceat(spent, off[full], axis=0, dtype=np.int64)
        return out


def held_out(doc_id: str, parts: int, remainder: int):
    """crc32 of the id as text, modulo ``parts``, equals ``remainder``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts == remainder


def train(docs: DataFrame, text: str, lang: str, docs_per_language: int = 240, max_chars: int = 12_000, order: int = 4, sample_chars: int = 12_000_000) -> PPM:
    """Fit on a bounded sample: of each language the ``docs_per_language`` different texts with the smallest hashes, cut to
    ``max_chars`` characters, as many of them as an even share of ``sample_chars`` for all languages takes, one at least. Alike at
    any partitioning, however often a text is repeated; every language is learned. Null texts and languages are left out. The driver
    gets a row for each language."""
    rows = docs.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{lang}`").alias("l"), F.left(F.col(f"`{text}`"), F.lit(max_chars)).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t"))
    kinds = rows.groupBy("l").agg(F.approx_count_distinct("h").alias("kinds")).collect()
    if not kinds:
        return PPM({}, order)
    most = max(1, min(docs_per_language, sample_chars // len(kinds)))
    shares = docs.sparkSession.createDataFrame([(r.l, min(1.0, 4 * most / max(1, r.kinds)) * 1e6) for r in kinds], "l string, _share double")
    picked = rows.join(F.broadcast(shares), "l").where(F.pmod("h", F.lit(1_000_000)) < F.col("_share")).select("l", "t", "h").distinct()
    order_ = Window.partitionBy("l").orderBy("h", "t")
    before = F.sum(F.length("t").cast("long")).over(order_.rowsBetween(Window.unboundedPreceding, -1))
    first = picked.withColumn("i", F.row_number().over(order_)).where(F.col("i") <= most).withColumn("before", F.coalesce(before, F.lit(0)))
    texts: dict[str, list[str]] = {}
    for r in first.where(F.col("before") < sample_chars // len(kinds)).select("l", "t").collect():
        texts.setdefault(r.l, []).append(r.t)
    return PPM({k: sorted(v) for k, v in texts.items()}, order)


def identify(docs: DataFrame, model: PPM, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` plus lang_pred and score of each row, from its whole text alone, however long.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned. Ties go to the
    first language by name. score is the posterior under equal priors. Equal texts, and so repeated rows, get equal
    results; other columns are not read, and a kept one named like a result is given as ``name_in``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names_in = [f"{k}_in" if k in ("lang_pred", "score") else k for k in keep]
    src = docs.select(*[F.col(f"`{k}`").alias(f"_{i}") for i, k in enumerate(keep)], F.coalesce(F.when(F.col(f"`{text}`").rlike(r"\p{L}"), F.col(f"`{text}`")), F.lit("")).alias("_text"))

    def run(batches):
        m = shared.value
        for batch in batches:
            data, off = text_bytes(batch.column("_text"))
            names, scores = [], []
            for i, j in spans(off, 1 << 18):
                at = off[i : j + 1]
                bits = m.bits(data[at[0] : at[-1]], at - at[0])
                for row, size in zip(bits, np.diff(at)):
                    if not size or not len(row):
                        names.append("und")
                        scores.append(0.0)
                        continue
                    best = int(row.argmin())
                    names.append(m.languages[best])
                    scores.append(float(1 / np.exp2(np.maximum(-1000.0, (row[best] - row) / UNIT)).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[:-1]]
    out = src.mapInArrow(tidy(run), ", ".join([*fields, "lang_pred string", "score double"]))
    return out.select(*[F.col(f"_{i}").alias(k) for i, k in enumerate(names_in)], "lang_pred", "score")
