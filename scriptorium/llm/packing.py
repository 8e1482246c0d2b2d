"""Packing of tokenised documents into sequences of fixed capacity, by swap-based local search.

A document is its token ids and an end id. Longer documents are cut; full pieces are sequences of their
own, so only rests travel. Rests are dealt evenly (whatever their document or length) to shards of at
most ``SHARD`` rests. Each shard starts with best fit in order of arrival; then the emptiest bin is emptied again
and again: its documents move into gaps, or are exchanged one for one, two for one or one for two with
documents of other underfull bins, as long as the sum of squared fills grows, until the bins are as few as
their content allows or none can be emptied. Bins that stay underfull are dealt and packed again together.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import KEEP, SPACE, Hasher, spans, tidy
from .store import written

SHARD = 16_384
#: Units whose ids a worker holds in each of two generations (about 60 bytes a unit).
REMEMBERED = 1 << 19
#: Kinds of bytes: letters, digits, signs, and those (also of characters beyond ASCII) that need the tokenizer's pattern.
_LETTER, _DIGIT, _SIGN, _HARD = 1, 2, 3, 4
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[39, *range(128, 256)]] = _HARD
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class _Known:
    """An open hash table from units, each given by two 64-bit keys, to their ids; many are looked up at once."""

    def __init__(self, bits: int = 20):
        self.bits, self.count, self.used = bits, 0, 0
        self.key, self.check = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.at, self.n = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        self.ids = np.zeros(1 << bits, "<u4")

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * _GOLDEN) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The slot of each unit, or -1."""
        slot = self._slot(key)
        held = self.key[slot]
        out = np.where((held == key) & (self.check[slot] == check), slot, -1)
        left = np.flatnonzero((out < 0) & (held != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.key) - 1)
            held = self.key[slot[left]]
            hit = (held == key[left]) & (self.check[slot[left]] == check[left])
            out[left[hit]] = slot[left[hit]]
            left = left[~hit & (held != 0)]
        return out

    def add(self, key: np.ndarray, check: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        """Units that are not there yet, each once; ``ids`` are those of all, one after the other."""
        while 2 * (self.count + len(key)) > len(self.key):
            self._grow()
        at = self.used + np.cumsum(n) - n
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.count += len(key)
        self._put(key, check, at, n)

    def _put(self, key, check, at, n) -> None:
        left, slot = np.arange(len(key)), self._slot(key)
        while len(left):
            free = left[self.key[slot[left]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            to = slot[put]
            self.key[to], self.check[to], self.at[to], self.n[to] = key[put], check[put], at[put], n[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & (len(self.key) - 1)

    def _grow(self) -> None:
        full = np.flatnonzero(self.key)
        rows = [x[full] for x in (self.key, self.check, self.at, self.n)]
        self.bits += 1
        self.key, self.check, self.at, self.n = (np.zeros(1 << self.bits, x.dtype) for x in (self.key, self.check, self.at, self.n))
        self._put(*rows)

    def gather(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each slot has, all their ids one after the other)."""
        n = self.n[slot].astype(np.int64)
        first = np.cumsum(n) - n
        return n, self.ids[np.repeat(self.at[slot] - first, n) + np.arange(int(n.sum()))]


def _units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the units of a block: runs of letters, single digits and runs of signs; a word with
    an apostrophe or a character beyond ASCII is one unit."""
    n = len(data)
    inside, kind = ~SPACE[data], _KIND[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    new_word = inside & (cut[:n] | np.concatenate(([True], ~inside[:-1])))
    word = np.cumsum(new_word, dtype=np.int32) - 1
    hard = np.zeros(int(new_word.sum()) + 1, bool)
    hard[word[kind == _HARD]] = True
    change = kind == _DIGIT
    change[1:] |= kind[1:] != kind[:-1]
    new = new_word | (inside & change & ~hard[word])
    last = inside & np.concatenate((~inside[1:] | new[1:] | cut[1:n], [True])) if n else inside
    start = np.flatnonzero(new)
    return start, np.flatnonzero(last) + 1, np.searchsorted(off, start, "right") - 1


class Encoder:
    """Ids of a whole text as little-endian 32-bit integers, equal to the tokenizer's for the whole text.

    A tokenizer that cuts at white space and by a pattern, as ``word_bpe_49k.json`` does, encodes the parts
    of a text one by one, so their ids are remembered. Plain ASCII words are cut at once for a block of texts, as the
    pattern would; other words are left to the tokenizer, whose classes of characters are its own. Units are looked up by a hash of their bytes and
    by their first and last 8 bytes. Texts with special tokens, or with control characters that only Python takes
    for white space, are encoded whole."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        self.plain = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": []}))  # units are normalised already
        self.special = ("\x1c", "\x1d", "\x1e", "\x1f", *(x["content"] for x in spec["added_tokens"]))
        self.odd = re.compile("[^\x00-\u017f]").search
        suffix, vocabulary = spec["model"]["end_of_word_suffix"], spec["model"]["vocab"]
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.young, self.old = _Known(), _Known(4)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _alone(self, units: list[str]) -> list[bytes]:
        """Ids of each unit, which goes through the tokenizer by itself."""
        return [array("I", x.ids).tobytes() for x in self.plain.encode_batch_fast(units, add_special_tokens=False)]

    def _together(self, units: list[str]) -> list[bytes]:
        """Ids of each unit, all of them single parts; many go through the tokenizer as one text, whose tokens tell where a part ends."""
        out = []
        for i in range(0, len(units), 2000):
            some = units[i : i + 2000]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            raw, cut = ids.tobytes(), [0, *(4 * np.flatnonzero(self.last[ids]) + 4).tolist()]
            out += [raw[p:q] for p, q in zip(cut, cut[1:])] if len(cut) == len(some) + 1 else self._alone(some)
        return out

    def _learn(self, units: list[str]) -> list[bytes]:
        """Ids of units."""
        hard = [not u.isascii() or "'" in u for u in units]
        alone = iter(self._alone([u for u, h in zip(units, hard) if h]))
        together = iter(self._together([u for u, h in zip(units, hard) if not h]))
        return [next(alone if h else together) for h in hard]

    def _block(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ends, ids): the ids of all texts of a block, and where those of each text end."""
        start, end, doc = _units(data, off)
        hashes = Hasher(data)
        key = np.maximum(hashes(start, end), np.uint64(1))
        check = hashes.eight[start] & KEEP[np.minimum(end - start, 8)]
        check ^= (hashes.eight[np.maximum(start, end - 8)] & KEEP[np.minimum(end - start, 8)]) * _GOLDEN
        slot = self.young.find(key, check)
        miss = np.flatnonzero(slot < 0)
        if len(miss):
            _, first = np.unique(np.stack((key[miss], check[miss])), axis=1, return_index=True) if len(miss) > 1 else (0, np.zeros(1, int))
            new = miss[first]
            held = self.old.find(key[new], check[new])
            again, new = new[held >= 0], new[held < 0]
            self.young.add(key[again], check[again], *self.old.gather(held[held >= 0]))
            raw = data.tobytes()
            found = self._learn([raw[p:q].decode() for p, q in zip(start[new].tolist(), end[new].tolist())])
            self.young.add(key[new], check[new], np.array([len(x) // 4 for x in found], np.int64), np.frombuffer(b"".join(found), "<u4"))
            slot[miss] = self.young.find(key[miss], check[miss])
        n, ids = self.young.gather(slot)
        if self.young.count > REMEMBERED:  # units that were met since the last time stay known for one more generation
            self.old, self.young = self.young, _Known()
        return np.cumsum(np.bincount(doc, n, len(off) - 1)).astype(np.int64), ids

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Letters up to U+017F need no composition, and lower() is enough for them."""
        normal = self.tokenizer.normalizer.normalize_str
        whole = [any(map(t.__contains__, self.special)) for t in texts]
        raw = [b"" if w else (t.lower() if t.isascii() or not self.odd(t) else normal(t)).encode() for t, w in zip(texts, whole)]
        off = np.cumsum([0, *map(len, raw)])
        out: list[bytes] = []
        for i, j in spans(off):
            ends, ids = self._block(np.frombuffer(b"".join(raw[i:j]), np.uint8), off[i : j + 1] - off[i])
            ids, cut = ids.tobytes(), [0, *(4 * ends).tolist()]
            out += [ids[p:q] for p, q in zip(cut, cut[1:])]
        return [self._whole(t) if w else x for t, w, x in zip(texts, whole, out)]

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of this Python process: tasks that follow each other share what it remembers."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document; a null text is empty, a repeated row
    a document of its own; other columns are not read."""

    def run(batches):
        encode = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            out: list[list[int]] = [[], [], [], [], []]
            keys, texts = b.columns
            for i in range(0, len(b), 256):
                for k, ids in zip(keys[i : i + 256].to_pylist(), encode.many([t or "" for t in texts[i : i + 256].to_pylist()])):
                    ids += end
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for column, x in zip(out, (k, n, at // 4, len(part) // 4, zlib.crc32(part))):
                            column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    src = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("t"))
    return src.mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(lengths: list[int] | np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item (numbers from 0). Deterministic; no bin is over capacity."""
    size = np.asarray(lengths, np.int64)
    bin_of = _best_fit(size, capacity)
    if len(size):
        _search(size, bin_of, capacity)
    _, out = np.unique(bin_of, return_inverse=True)
    return out


def _best_fit(size: np.ndarray, capacity: int) -> np.ndarray:
    """Best fit in the order given, which leaves work to the search; open bins are kept by room, and a bit set of rooms
    finds the smallest that fits."""
    bin_of = np.zeros(len(size), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, used = 0, 0
    for i, s in enumerate(size.tolist()):
        fits = rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b, used = capacity, used, used + 1
        bin_of[i] = b
        if room > s:
            by_room[room - s].append(b)
            rooms |= 1 << (room - s)
    return bin_of


def _search(size: np.ndarray, bin_of: np.ndarray, capacity: int) -> None:
    """Exchange documents between underfull bins so that the sum of squared fills grows, in place, until the bins are
    as few as their content allows or no exchange is left."""
    fill = np.bincount(bin_of, size).astype(np.int64)
    least = -(-int(fill.sum()) // capacity)
    moved = True
    while moved:  # a pass tries every bin that is not full, the least filled first
        moved, tried = False, np.zeros(len(fill), bool)
        while (fill > 0).sum() > least:
            live = np.flatnonzero((fill > 0) & (fill < capacity) & ~tried)
            if not len(live):
                break
            low = live[np.argmin(fill[live])]
            moved |= _empty(low, size, bin_of, fill, capacity)
            tried[low] = True
        else:
            return


def _empty(low: int, size: np.ndarray, bin_of: np.ndarray, fill: np.ndarray, capacity: int) -> bool:
    """Exchange documents of bin ``low`` with bins as full or fuller until it is empty or no exchange helps; whether
    there was any."""
    room = capacity - fill
    any_ = False
    while True:
        own = np.flatnonzero(bin_of == low)
        if not len(own):
            return True
        into = (room > 0) & (fill >= fill[low])
        into[low] = False
        item = np.flatnonzero(into[bin_of])
        best = (0, None)
        for y in own[np.argsort(-size[own], kind="stable")]:
            s = size[y]
            fits = np.flatnonzero(into & (room >= s))
            if len(fits):
                best = (s, ((y,), (), fits[np.argmin(room[fits])]))
                break
            # one for one: the larger goes into the gap
            gain = s - size[item]
            ok = (gain > best[0]) & (gain <= room[bin_of[item]])
            if ok.any():
                x = item[ok][np.argmax(gain[ok])]
                best = (s - size[x], ((y,), (x,), bin_of[x]))
        if best[1] is None or len(best[1][1]):
            pair = _two(low, own, item, size, bin_of, room, best[0])
            best = pair if pair[0] > best[0] else best
        gain, move = best
        if move is None:
            return any_
        into_, back, b = move
        any_ = True
        bin_of[list(into_)] = b
        bin_of[list(back)] = low
        fill[b] += gain
        fill[low] -= gain
        room[b] -= gain
        room[low] += gain


def _two(low, own, item, size, bin_of, room, least):
    """The best exchange of two documents for one, either way: (gain, ((into,), (back,), bin))."""
    best = (least, None)
    if len(own) > 1:
        order = own[np.argsort(-size[own], kind="stable")]
        for k, y in enumerate(order):
            for z in order[k + 1 :]:
                s = size[y] + size[z]
                gain = s - size[item]
                ok = (gain > best[0]) & (gain <= room[bin_of[item]])
                if ok.any():
                    x = item[ok][np.argmax(gain[ok])]
                    best = (s - size[x], ((y, z), (x,), bin_of[x]))
    # one of ours for two of another bin
    order = item[np.argsort(bin_of[item], kind="stable")]
    bins = bin_of[order]
    for apart in range(1, int(np.bincount(bins).max()) if len(bins) else 0):
        same = bins[apart:] == bins[:-apart]
        a, b = order[:-apart][same], order[apart:][same]
        both, space = size[a] + size[b], room[bin_of[a]]
        for y in own:
            gain = size[y] - both
            ok = (gain > best[0]) & (gain <= space)
            if ok.any():
                k = np.argmax(np.where(ok, gain, -1))
                best = (gain[k], ((y,), (a[k], b[k]), bin_of[a[k]]))
    return best


def _shards(rests: DataFrame, n: int, capacity: int, level: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        length = t.column("length").to_numpy()
        bins = pack(length, capacity)
        fill = np.bincount(bins, length)
        order = np.argsort(bins, kind="stable")
        before = np.zeros(len(bins), np.int64)
        before[order] = np.cumsum(length[order]) - length[order]
        first = np.full(len(fill), np.iinfo(np.int64).max)
        np.minimum.at(first, bins, before)
        number = (bins * n + TaskContext.get().partitionId()) * 64 + level + 1
        done = pa.array((fill[bins] >= 0.97 * capacity) | (n == 1))
        t = t.append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(before - first[bins])).append_column("done", done)
        yield from t.to_batches()

    dealt = rests.repartition(n).sortWithinPartitions("ids_crc32", "doc_id", "piece", "start", "length")
    return dealt.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, done boolean")


def packed(cut: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to the rows of ``pieces``, which should be a written table.

    Full pieces get ids that end in 0 of 64, from a hash-free count of their place in the table; an empty
    table gives an empty result; repeated rows are separate documents. Other columns are not carried."""
    whole = cut.where(F.col("length") == capacity)
    whole = whole.withColumn("sequence_id", F.monotonically_increasing_id() * 64).withColumn("offset", F.lit(0).cast("long"))
    result, rests, before = whole, cut.where(F.col("length") < capacity), None
    for level in range(63):
        count = rests.count()
        if before is not None and count > 0.9 * before:  # dealing them anew is of no more use
            break
        part = written(_shards(rests, max(1, -(-count // SHARD)), capacity, level), "packed")
        placed = part.drop("done")
        if count <= SHARD:
            return result.unionByName(placed)
        result, before = result.unionByName(part.where("done").drop("done")), count
        rests = part.where("NOT done").drop("done", "sequence_id", "offset")
    return result.unionByName(part.where("NOT done").drop("done"))
