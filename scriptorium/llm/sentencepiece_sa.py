"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch (runs up to the next word mark; no piece crosses one) are concatenated and
indexed by a suffix array. Every piece is looked up by binary search, all pieces at once; each range of the
array is a set of edges (start, end, piece). The edges are sorted by position and relaxed from left to right.

For a BPE model the path is not the one of the best sum of scores, as for a unigram model, but the one the
merges make. It is the only path whose neighbouring pieces are stable: merging the characters of any two
neighbours gives these two again. So relaxing an edge asks if its piece is stable after the last piece of the
path to its start; every position has one such path.
"""

from __future__ import annotations

import gc
import hashlib
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import tidy

MARK = "▁"
#: Words whose ids a worker remembers, and pairs of pieces whose stability it remembers.
REMEMBERED, PAIRS = 800_000, 1_000_000
#: Bytes of a word from which its edges are relaxed alone: few words are as long, so there is little to do together.
SHORT = 64


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all suffixes of a byte text in the order of their first ``depth`` bytes (at least), by prefix
    doubling; and the first 8 bytes of each, as numbers."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    rank = np.zeros(n, np.uint64)
    for k in range(8):
        rank = rank << np.uint64(8) | padded[k : k + n]
    width, heads = 8, rank
    while True:
        order = np.argsort(rank, kind="stable")
        if width >= depth:
            return order, heads[order]
        new = np.zeros(n, np.uint64)
        new[order[1:]] = np.cumsum(rank[order[1:]] != rank[order[:-1]])
        ahead = np.zeros(n, np.uint64)
        ahead[: max(0, n - width)] = new[width:] + np.uint64(1)
        rank = new << np.uint64(32) | ahead
        width *= 2


class Model:
    """Pieces and scores of a BPE model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self.normalizer = SentencePieceProcessor(model_file=path)
        sp = self.normalizer
        self.text = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(len(self.text)) if sp.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.is_byte = np.zeros(len(self.text), bool)
        self.is_byte[list(self.of_byte)] = True
        usable = [i for i in range(len(self.text)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = {self.text[i]: sp.get_score(i) for i in usable}
        raw = [self.text[i].encode() for i in usable]
        self.depth = max(map(len, raw))
        self.ids = np.array(usable, np.int32)
        self.sizes = np.array(list(map(len, raw)), np.int64)
        self.matrix = np.zeros((len(raw), self.depth), np.uint8)
        for i, x in enumerate(raw):
            self.matrix[i, : len(x)] = np.frombuffer(x, np.uint8)
        key = np.zeros(len(raw), np.uint64)
        for k in range(8):
            key = key << np.uint64(8) | self.matrix[:, k]
        spare = np.uint64(8) * np.maximum(0, 8 - self.sizes).astype(np.uint64)
        self.heads = key, key | ((np.uint64(1) << spare) - np.uint64(1))
        self.stable: dict[int, bool] = {}
        self.byte_ids = np.array([self.byte[x] for x in range(256)], np.int64)
        self.pairs, self.pairs_fit = np.array([np.iinfo(np.int64).max]), np.zeros(1, bool)  # sorted, the last one is no pair
        self.words: dict[str, bytes] = {}

    def merge(self, symbols: list[str]) -> list[str]:
        """Merge neighbours, always those that give the piece of highest score, the leftmost of equal ones."""
        symbols, score = list(symbols), self.score
        pairs = [score.get(a + b) for a, b in zip(symbols, symbols[1:])]
        while True:
            best = max((s for s in pairs if s is not None), default=None)
            if best is None:
                return symbols
            k = pairs.index(best)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del pairs[k]
            if k < len(pairs):
                pairs[k] = score.get(symbols[k] + symbols[k + 1])
            if k:
                pairs[k - 1] = score.get(symbols[k - 1] + symbols[k])

    def fits(self, a: int, b: int) -> bool:
        """Whether piece b after piece a is stable. A negative number is a character without a piece, stable with all."""
        if a < 0 or b < 0:
            return True
        key = a << 20 | b
        found = self.stable.get(key)
        if found is None:
            if len(self.stable) > PAIRS:
                self.stable.clear()
            x, y = self.text[a], self.text[b]
            found = self.stable[key] = self.merge(list(x + y)) == [x, y]
        return found

    def edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id) of every occurrence of every piece, by start and then length."""
        order, sorted_keys = suffix_array(data, self.depth)
        padded = np.concatenate((data, np.zeros(self.depth, np.uint8)))
        columns = np.arange(self.depth)
        inside = columns < self.sizes[:, None]

        def bound(upper: bool) -> np.ndarray:
            # the first 8 bytes tell all of a short piece, and a narrow range of a long one
            head = np.searchsorted(sorted_keys, self.heads[0], "left"), np.searchsorted(sorted_keys, self.heads[1], "right")
            low, high = head[0].astype(np.int64), head[1].astype(np.int64)
            short = self.sizes <= 8
            low[short] = high[short] = head[int(upper)][short]
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) >> 1
                diff = np.where(inside[open_], padded[order[mid][:, None] + columns].astype(np.int16) - self.matrix[open_], 0)
                at = (diff != 0).argmax(1)
                sign = diff[np.arange(len(open_)), at]
                right = sign <= 0 if upper else sign < 0
                low[open_[right]] = mid[right] + 1
                high[open_[~right]] = mid[~right]
            return low

        first, last = bound(False), bound(True)
        count = last - first
        which = np.repeat(np.arange(len(self.ids)), count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        start = order[place]
        end = start + self.sizes[which]
        by = np.lexsort((end, start))
        return start[by], end[by], self.ids[which][by]

    def all_fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``fits`` of many pairs of pieces at once."""
        keys = a << 20 | b
        place = np.searchsorted(self.pairs, keys)
        new = np.unique(keys[self.pairs[place] != keys])
        if len(new):
            if len(self.pairs) > PAIRS:
                self.pairs, self.pairs_fit = self.pairs[-1:], self.pairs_fit[-1:]
                new = np.unique(keys)
            found = [self.merge([*self.text[k >> 20], *self.text[k & 0xFFFFF]]) == [self.text[k >> 20], self.text[k & 0xFFFFF]] for k in new.tolist()]
            at = np.searchsorted(self.pairs, new)
            self.pairs, self.pairs_fit = np.insert(self.pairs, at, new), np.insert(self.pairs_fit, at, found)
            place = np.searchsorted(self.pairs, keys)
        return self.pairs_fit[place]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word, as little-endian 32-bit integers. Words of more than ``SHORT`` bytes are relaxed
        one by one, all others together."""
        raw = [w.encode() for w in words]
        data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
        edges = self.edges(data)
        sizes = np.array(list(map(len, raw)), np.int64)
        first = np.cumsum(sizes + 1) - sizes - 1
        short = sizes <= SHORT
        out = self.relax_together([w for w, x in zip(words, short.tolist()) if x], data, first[short], sizes[short], *edges)
        if not short.all():
            long = np.flatnonzero(~short).tolist()
            out |= self.relax_each([words[k] for k in long], [raw[k] for k in long], first[~short].tolist(), *edges)
        return out

    def relax_together(self, words: list[str], data: np.ndarray, first: np.ndarray, sizes: np.ndarray, start: np.ndarray, end: np.ndarray, ids: np.ndarray) -> dict[str, bytes]:
        """Relaxes the edges of words that begin at ``first``: those that leave the same position of any word at once."""
        n = len(data)
        offset = np.full(n, -1)  # of each byte in its word
        byte = np.repeat(first, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        offset[byte] = byte - np.repeat(first, sizes)
        # characters without a piece are edges too
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        chars, until = heads[:-1], heads[1:]
        at = np.minimum(np.searchsorted(start, chars), max(0, len(start) - 1))
        bare = (offset[chars] >= 0) & ((start[at] != chars) | (end[at] != until) if len(start) else True)
        start, end = np.concatenate((start, chars[bare])), np.concatenate((end, until[bare]))
        piece = np.concatenate((ids.astype(np.int64), np.full(bare.sum(), -1)))
        order = np.argsort(offset[start], kind="stable")
        start, end, piece = start[order], end[order], piece[order]
        cut = np.searchsorted(offset[start], np.arange(int(sizes.max(initial=0)) + 1))
        last, back = np.full(n + 1, -2), np.zeros(n + 1, np.int64)  # last piece of the path to here (-2: none), and its start
        for i, (p, q) in enumerate(zip(cut[:-1], cut[1:])):
            s, e, x = start[p:q], end[p:q], piece[p:q]
            if i:
                before = last[s]
                open_ = np.flatnonzero((before != -2) & (last[e] == -2))
                s, e, x, before = s[open_], e[open_], x[open_], before[open_]
                ok = np.ones(len(x), bool)
                both = np.flatnonzero((before >= 0) & (x >= 0))
                ok[both] = self.all_fit(before[both], x[both])
                s, e, x = s[ok], e[ok], x[ok]
            last[e], back[e] = x, s
        used, now, begin = np.zeros(n + 1, bool), (first + sizes)[sizes > 0], first[sizes > 0]
        while len(now):
            used[now] = True
            now = back[now]
            more = now > begin
            now, begin = now[more], begin[more]
        path = np.flatnonzero(used)
        found, source = last[path], back[path]
        count = np.where(found < 0, path - source, 1)
        total = np.concatenate(([0], np.cumsum(count)))
        out = np.repeat(found, count)
        fill = np.flatnonzero(out < 0)
        byte = (np.repeat(source, count) + np.arange(len(out)) - np.repeat(total[:-1], count))[fill]
        out[fill] = self.byte_ids[data[byte]]
        blob = out.astype("<u4").tobytes()
        low, high = (4 * total[np.searchsorted(path, x, "right")] for x in (first, first + sizes))
        return {w: blob[p:q] for w, p, q in zip(words, low.tolist(), high.tolist())}

    def relax_each(self, words: list[str], raw: list[bytes], starts: list[int], start: np.ndarray, end: np.ndarray, ids: np.ndarray) -> dict[str, bytes]:
        """Relaxes the edges of one word after the other."""
        cut = np.searchsorted(start, np.arange(max(map(lambda at, b: at + len(b), starts, raw)) + 2)).tolist()
        end, ids = end.tolist(), ids.tolist()
        fits, known, out = self.fits, self.stable, {}
        for word, b, at in zip(words, raw, starts):
            size = len(b)
            last: list = [None] * (size + 1)  # last piece of the path to here
            back = [0] * (size + 1)
            i = 0
            for ch in word:
                wide = 1 if ch < "\x80" else len(ch.encode())
                before = last[i]
                if before is not None or not i:
                    first, until = cut[at + i], cut[at + i + 1]
                    for e, piece in zip(end[first:until], ids[first:until]):
                        e -= at
                        if last[e] is None:
                            if i and before >= 0:
                                ok = known.get(before << 20 | piece)
                                if not (fits(before, piece) if ok is None else ok):
                                    continue
                            last[e], back[e] = piece, i
                    # a character without a piece; the shortest edge of a position comes first
                    if (first == until or end[first] - at != i + wide) and last[i + wide] is None:
                        last[i + wide], back[i + wide] = -1, i
                i += wide
            path, e = [], size
            while e:
                s = back[e]
                path.append([last[e]] if last[e] >= 0 else [self.byte[x] for x in b[s:e]])
                e = s
            out[word] = array("I", [x for p in reversed(path) for x in p]).tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text."""
        split = [self.cut(x) if x else [] for x in self.normalizer.normalize(texts)]
        words = self.words
        new = list(set().union(*split).difference(words))
        found: dict[str, bytes] = {}
        group, size = [], 0
        for w in new:
            group.append(w)
            size += len(w) + 1
            if size > 500_000:
                found.update(self.learn(group))
                group, size = [], 0
        if group:
            found.update(self.learn(group))
        if len(words) < REMEMBERED:
            words.update(found)
            get = words.__getitem__
        else:
            get = lambda w: words.get(w) or found[w]
        return [b"".join(map(get, own)) for own in split]

    def decode(self, ids: bytes) -> str:
        """The text of ids: byte pieces as UTF-8 (U+FFFD where malformed), marks as spaces, without the first one."""
        found, of_byte, text = np.frombuffer(ids, "<u4"), self.of_byte, self.text
        numbers = found.tolist()
        if not self.is_byte[found].any():
            out = "".join(map(text.__getitem__, numbers))
        else:
            out = b"".join([bytes((of_byte[i],)) if i in of_byte else text[i].encode() for i in numbers]).decode(errors="replace")
        return out.replace(MARK, " ").removeprefix(" ")


@lru_cache(maxsize=1)
def model(path: str) -> Model:
    """The model of this Python process: tasks that follow each other share what it remembers."""
    return Model(path)


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """n_pieces, ids_crc32 (of little-endian 32-bit ids), decoded_sha256 and lossless (the decoded text is the
    text) of each row; a null or empty text has no pieces.

    Equal texts, and so repeated rows, get equal pieces; of two merges of equal score the left one goes first; texts are read
    whole, however long; keys may be null; other columns, whatever their names, are not read."""

    def run(batches):
        held, was = model(path), gc.isenabled()
        gc.disable()  # nothing here is cyclic, and the many small objects would be scanned again and again
        try:
            for b in batches:
                keys, texts = b.columns
                for i in range(0, len(b), 2000):
                    part = [t or "" for t in texts[i : i + 2000].to_pylist()]
                    ids = held.encode(part)
                    back = [held.decode(x) for x in ids]
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys[i : i + 2000], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()), pa.array([a == b for a, b in zip(part, back)], pa.bool_()),
                        ],
                        names=["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"],
                    )
        finally:  # the worker lives on
            if was:
                gc.enable()

    src = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("t"))
    return src.mapInArrow(tidy(run), "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean")
