"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding lower-cases and maps homoglyphs, digits and signs that stand for letters onto these. Patterns are
word beginnings (``lowei*``) or whole words; each match that starts a word counts once, with its heaviest
pattern, unless it lies in an exception phrase. The score is a logistic function of the matched weight in
a text and of that weight per word.

The lexicon (log odds of toxic against clean texts) and the function are fitted on labelled rows.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import tidy

#: Characters written in place of a letter. Cyrillic and Greek look-alikes, digits, signs.
LOOKS = {
    "а": "a", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s",
    "7": "t", "8": "b", "@": "a", "$": "s",
}
#: Harmless phrases that hold words which are insults elsewhere.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "clown fish", "class clown", "sore loser", "pond scum", "soap scum")
_TABLE = str.maketrans(LOOKS)
_WORD = re.compile(r"[^\W_]+")
PREFIXES = (4, 5, 6, 7)


def fold(text: str) -> str:
    """Lower case, with full-width and other compatibility forms, homoglyphs and digits as plain letters."""
    low = text.lower()
    if not low.isascii():
        low = unicodedata.normalize("NFKC", low)
    return low.translate(_TABLE)


@dataclass
class Lexicon:
    """patterns: beginning of a word, or ``=word`` for a whole one, with its weight. At most ``size`` entries."""

    patterns: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, ...] = (-3.0, 0.0, 0.0)
    _machine: ahocorasick.Automaton | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_machine": None}

    def machine(self) -> ahocorasick.Automaton:
        if self._machine is None:
            machine, held = ahocorasick.Automaton(), {}
            for p, w in self.patterns.items():
                word = p.lstrip("=")
                old = held.get(word, (0.0, 0.0))
                held[word] = (old[0], max(w, old[1])) if p[0] == "=" else (max(w, old[0]), old[1])
            for phrase in map(fold, self.exceptions):
                held[phrase] = None if phrase not in held else held[phrase]
            for word, weights in held.items():
                machine.add_word(word, (len(word), weights))
            if held:
                machine.make_automaton()
            self._machine = machine
        return self._machine

    def matched(self, text: str) -> tuple[float, int]:
        """(sum of weights of matched words, their number) of a folded text."""
        if not len(self.machine()):
            return 0.0, 0
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for last, (size, weights) in self.machine().iter(text):
            start = last - size + 1
            if start and text[start - 1].isalnum():
                continue
            whole = last + 1 == len(text) or not text[last + 1].isalnum()
            if weights is None:
                if whole:
                    spared.append((start, last))
                continue
            weight = max(weights[0], weights[1] if whole else 0.0)
            if weight > found.get(start, 0.0):
                found[start] = weight
        hits = [w for at, w in found.items() if not any(a <= at <= b for a, b in spared)]
        return math.fsum(hits), len(hits)

    def features(self, text: str) -> list[float]:
        low = fold(text)
        weight, _ = self.matched(low)
        words = max(1, len(low.split())) if weight else 1
        return [1.0, math.log1p(weight), math.log1p(100 * weight / words)]

    def score(self, text: str | None) -> float:
        """0 to 1; empty and null texts score as texts without a match."""
        z = sum(map(lambda a, b: a * b, self.coefficients, self.features(text or "")))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def evidence(text: str) -> set[str]:
    """The patterns that would match a text: its folded words and their beginnings."""
    out = set()
    for w in set(_WORD.findall(fold(text))):
        out.add("=" + w)
        out.update(w[:n] for n in PREFIXES if len(w) >= n)
    return out


def cover(toxic: list[set[str]], clean: Counter, n_clean: int, size: int) -> dict[str, float]:
    """A lexicon that explains the toxic texts, greedily: of the patterns whose log odds are over 2.5, take the
    one with most texts not yet explained less three times its clean texts, the longest of equal ones, until
    one explains fewer than 3 new texts, or, if a clean text has it too, 3 in 1000. A word that merely occurs in toxic texts adds nothing."""
    counts = Counter(p for found in toxic for p in found)
    odds = {p: math.log((t + 0.2) / (len(toxic) + 1)) - math.log((clean[p] + 0.2) / (n_clean + 1)) for p, t in counts.items() if t >= 3}
    held = {p: set() for p, x in odds.items() if x > 2.5}
    for i, found in enumerate(toxic):
        for p in found & held.keys():
            held[p].add(i)
    rank = lambda p, new: (-(new - 3 * clean[p]), -len(p.lstrip("=")), p)
    heap = [rank(p, len(x)) for p, x in held.items()]
    heapq.heapify(heap)
    done: set[int] = set()
    kept: dict[str, float] = {}
    least = max(3, math.ceil(len(toxic) * 0.003))
    new_enough = lambda p, new: new >= (least if clean[p] else 3)
    while heap and len(kept) < size:
        top = heapq.heappop(heap)
        now = rank(top[2], len(held[top[2]] - done))
        if not new_enough(top[2], -now[0]):
            continue
        if heap and now > heap[0]:
            heapq.heappush(heap, now)
            continue
        kept[top[2]] = round(odds[top[2]], 6)
        done |= held[top[2]]
    for p in sorted(held, key=lambda p: (-counts[p], -len(p), p)):  # frequent insults that others always go with
        if counts[p] >= max(4, 0.05 * len(toxic)) and 50 * clean[p] <= counts[p] and len(kept) < size:
            word = p.lstrip("=")
            if not any(k.lstrip("=").startswith(word) or word.startswith(k.lstrip("=")) for k in kept):
                kept[p] = round(odds[p], 6)
    return kept


def fit(rows: list[tuple[str, int]], kept: dict[str, float]) -> Lexicon:
    """The coefficients of the score come from a ridge logistic regression with balanced classes."""
    toxic = sum(label for _, label in rows)
    clean = len(rows) - toxic
    lexicon = Lexicon(kept)
    if not toxic or not clean:
        return lexicon
    x = np.array([lexicon.features(t) for t, _ in rows])
    y = np.array([label for _, label in rows], float)
    w = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (w * (y - p)) - 0.05 * b
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(b)), grad)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    lexicon.coefficients = tuple(round(float(v), 6) for v in b)
    return lexicon


def train(labelled: DataFrame, text: str = "text", label: str = "toxic", per_class: int = 2500, max_chars: int = 12_000, size: int = 2000) -> Lexicon:
    """Fit on a bounded sample of labelled rows without repeats: at most ``per_class`` texts of each class, those with the
    smallest hashes, each cut to ``max_chars`` characters. The lexicon has at most ``size`` entries, those that explain most
    texts first. Null texts and labels are left out."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.left(text, F.lit(max_chars)).alias("t"), (F.col(label) > 0).cast("int").alias("y"))
    rows = rows.distinct().withColumn("h", F.xxhash64("t"))
    sample = sorted((r.t, r.y) for y in (0, 1) for r in rows.where(F.col("y") == y).orderBy("h", "t").limit(per_class).collect())
    toxic = [evidence(t) for t, y in sample if y]
    known, clean = set().union(*toxic), Counter()
    for t, y in sample:
        if not y:
            clean.update(evidence(t) & known)
    return fit(sample, cover(toxic, clean, len(sample) - len(toxic), size))


def _scored(docs: DataFrame, lexicon: Lexicon, text: str) -> DataFrame:
    """The columns of ``docs`` as _0, _1 and so on, and _score."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        lex = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([lex.score(t) for t in b.column("_whole").to_pylist()], pa.float64())], names=[*b.schema.names[:-1], "_score"])

    src = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)], F.col(f"`{text}`").alias("_whole"))
    return src.mapInArrow(tidy(run), ", ".join([*(f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)), "_score double"]))


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus _score (in place of a column of that name), read from the whole text alone. Null and
    empty texts score as texts without a match; equal texts, and so repeated rows, score alike."""
    out = _scored(docs, lexicon, text)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns) if c != "_score"], "_score")


def mild(docs: DataFrame, lexicon: Lexicon, text: str = "text", most: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``most``, with all columns as they are, whatever their names."""
    return _scored(docs, lexicon, text).where(F.col("_score") < most).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])


def labelled(docs: DataFrame, labels: DataFrame, most: int = 40_000) -> DataFrame:
    """text and toxic of labelled rows. About ``most`` labels, picked by a hash of the id, are joined, so the
    broadcast side is bounded."""
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    positive, total = rows.agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)), F.count(F.lit(1))).first()
    share = F.when(F.col("toxic") > 0, F.lit(most / 4 / max(1, positive or 0))).otherwise(F.lit(most * 3 / 4 / max(1, total - (positive or 0))))
    picked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1e6).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic")
