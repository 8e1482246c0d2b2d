"""Quality rules with weak supervision.

Rules read a text's statistics and give it a grade from 1 (sound) to 5 (poor), or abstain (0). A two-class model with
conditionally independent votes, fitted by expectation-maximisation without labels, gives how often each rule gives each
grade to good and to bad texts; a text's verdict is its posterior probability of good quality. No rule rejects a
text by itself, and no grade has a fixed weight.

The model needs only how often each vote pattern occurs: at most 6 ** rules counts, over all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import SPACE, Hasher, per_doc, ranges, spans, text_bytes, tidy, windows
from .store import written

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_bare", "n_lines", "n_kinds", "n_shout")
#: The rules, with the values of their trait from which on the grade is 2, 3, 4 and 5. Most good texts have grades over 1 somewhere.
RULES = {
    "symbols": (0.005, 0.02, 0.1, 0.3), "repeats": (0.005, 0.05, 0.15, 0.25), "lines": (0.02, 0.15, 0.3, 0.6), "capitals": (0.04, 0.1, 0.25, 0.4),
    "word_length": (0.15, 0.3, 0.5, 0.9), "kinds": (0.04, 0.08, 0.15, 0.3), "shouts": (0.001, 0.01, 0.05, 0.1),
}
GRADES = 5


def statistics(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each document of a block. n_upper, n_lower: ASCII letters; n_bare: words without a letter,
    digit or non-ASCII character; n_kinds: distinct words; n_shout: exclamation marks after another."""
    n = len(off) - 1
    start, end, doc = ranges(~SPACE[data], off)
    hasher = Hasher(data)
    h = hasher(start, end)
    out = {"n_words": np.bincount(doc, minlength=n)}
    out["word_chars"] = per_doc(~SPACE[data] & ((data & 0xC0) != 0x80), off)
    out["n_symbols"] = per_doc(np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8)), off)
    word = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~SPACE[data], out=word[1:])
    first, last, line_doc = ranges(data != 10, off)
    full = word[last] > word[first]
    first, last, line_doc = first[full], last[full], line_doc[full]
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - _distinct(line_doc, hasher(first, last), n)
    at, runs = windows(h, doc, 8, 3)
    both = np.lexsort((runs, doc[at]))
    d, x = doc[at][both], runs[both]
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = (d[1:] == d[:-1]) & (x[1:] == x[:-1])
    again = at[both[same[:-1] | same[1:]]] if len(at) else at
    cover = np.zeros(len(h) + 9, np.int64)
    cover[again] += 1
    cover[again + 8] -= 1
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(cover)[: len(h)] > 0], minlength=n)
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    out["n_upper"], out["n_lower"] = per_doc(upper, off), per_doc(lower, off)
    sound = np.zeros(len(data) + 1, np.int64)
    np.cumsum(upper | lower | ((data >= 48) & (data <= 57)) | (data >= 128), out=sound[1:])
    out["n_bare"] = np.bincount(doc[sound[end] == sound[start]], minlength=n)
    out["n_kinds"] = _distinct(doc, h, n)
    shout = data == 33
    shout[1:] &= data[:-1] == 33
    shout[:1] = False
    out["n_shout"] = per_doc(shout, off)
    return {k: out[k].astype(np.int64) for k in STATS}


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    return np.bincount(d[new], minlength=n)


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """One column a rule: 0 abstain, else the grade. Texts under 20 words get only abstentions; rules on lines and capitals
    abstain on texts with one line and with under 20 ASCII letters.

    The model takes rules to be independent given the quality, so traits that go together share a rule: signs and
    words of signs alone. The length of words counts by its distance from five and a half characters, as a logarithm; the variety of
    words is the logarithm of the distinct ones over that of all, which hardly depends on a text's length."""
    words = np.maximum(1, s["n_words"])

    def share(part, whole):
        return part / np.maximum(1, whole)

    letters = s["n_upper"] + s["n_lower"]
    traits = {
        "symbols": np.maximum(share(s["n_symbols"], words), share(s["n_bare"], words)), "repeats": share(s["n_repeat_words"], words), "lines": share(s["n_dup_lines"], s["n_lines"]),
        "capitals": share(s["n_upper"], letters), "word_length": np.abs(np.log(np.maximum(0.1, s["word_chars"] / words) / 5.5)),
        "kinds": 1 - np.log(np.maximum(1, s["n_kinds"])) / np.log(np.maximum(2, words)), "shouts": share(s["n_shout"], words),
    }
    out = np.stack([np.searchsorted(RULES[k], traits[k], side="right") + 1 for k in RULES], axis=1)
    names = list(RULES)
    out[s["n_lines"] < 2, names.index("lines")] = 0
    out[letters < 20, names.index("capitals")] = 0
    out[s["n_words"] < 20] = 0
    return out


def base_failed(n_words, n_repeat_words):
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def rising(share: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to ``share`` by weighted squares: neighbours that fall are pooled."""
    pools: list[list[float]] = []
    for x, w in zip(share, weight):
        pools.append([x, w, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            (x1, w1, n1), (x2, w2, n2) = pools[-2:]
            pools[-2:] = [[(x1 * w1 + x2 * w2) / max(w1 + w2, 1e-12), w1 + w2, n1 + n2]]
    return np.concatenate([np.full(n, x) for x, _, n in pools])


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> dict:
    """EM over distinct vote patterns. Starts from the mean grade of each, so no rule and no grade decides.

    The classes get their meaning from the order of grades alone: of the texts with a higher grade of a rule no smaller share is
    bad, whatever else they are, so grades that say otherwise are pooled (isotonic regression). Vote frequencies are smoothed by a tenth of
    a count and posteriors rounded, so that results don't hang on summation order."""
    patterns, counts = np.asarray(patterns, int).reshape(-1, len(RULES)), np.asarray(counts, float)
    voted = np.maximum(1, (patterns > 0).sum(1))
    good = 1 - np.clip((patterns.sum(1) / voted - 1) / (GRADES - 1), 0.02, 0.98)
    prior, table = 0.5, np.full((2, len(RULES), GRADES + 1), 1 / (GRADES + 1))
    for _ in range(rounds if len(patterns) else 0):
        for j in range(len(RULES)):
            bad, sound = (np.bincount(patterns[:, j], w, GRADES + 1) for w in (counts * (1 - good), counts * good))
            seen = bad[1:] + sound[1:]
            share = rising(bad[1:] / np.maximum(seen, 1e-12), seen)
            bad[1:], sound[1:] = seen * share, seen * (1 - share)
            for c, n in ((0, bad), (1, sound)):
                table[c, j] = (n + 0.1) / (n.sum() + 0.1 * (GRADES + 1))
        prior = (counts @ good + 0.5) / (counts.sum() + 1)
        new = posterior(patterns, {"prior": prior, "table": table})
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return {"prior": prior, "table": table}


def posterior(patterns: np.ndarray, model: dict) -> np.ndarray:
    """Probability of good quality of each pattern; an abstention is no evidence."""
    logs = np.where(np.arange(GRADES + 1) > 0, np.log(model["table"]), 0)
    bad, good = (sum((logs[c, j][patterns[:, j]] for j in range(len(RULES))), np.zeros(len(patterns))) for c in (0, 1))
    return np.round(1 / (1 + np.exp(np.clip(bad - good + np.log1p(-model["prior"]) - np.log(model["prior"]), -50, 50))), 6)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` as _0, _1 and so on, whatever their names, plus _stats, a struct of the statistics and the
    vote pattern (base 3)."""
    scale = (GRADES + 1) ** np.arange(len(RULES))

    def run(batches):
        for b in batches:
            data, off = text_bytes(b.column("_whole"))
            parts: list[dict] = []
            for i, j in spans(off):
                at = off[i : j + 1]
                s = statistics(data[at[0] : at[-1]], at - at[0])
                parts.append(s | {"pattern": votes(s) @ scale})
            cols = [pa.array(np.concatenate([p[k] for p in parts]) if parts else [], pa.int64()) for k in (*STATS, "pattern")]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.StructArray.from_arrays(cols, [*STATS, "pattern"])], names=[*b.schema.names[:-1], "_stats"])

    src = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)], F.col(f"`{text}`").alias("_whole"))
    schema = ", ".join([*(f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)), "_stats struct<" + ",".join(f"{k}:bigint" for k in (*STATS, "pattern")) + ">"])
    return src.mapInArrow(tidy(run), schema)


def judge(measured: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds _failed, _quality (posterior) and _kept to the rows of ``measure``, which should be a written
    table as it is read twice. The driver gets at most 6 ** 7 = 279,936 pattern counts, and sends as many posteriors.

    Null and empty texts have no words and fail; repeated rows and ties get equal verdicts; long texts are read
    whole."""
    spark = measured.sparkSession
    failed = base_failed(F.col("_stats.n_words"), F.col("_stats.n_repeat_words"))
    counted = sorted((r[0], r[1]) for r in measured.where(~failed).groupBy("_stats.pattern").count().collect())
    codes = np.array([c for c, _ in counted], np.int64)
    patterns = codes[:, None] // (GRADES + 1) ** np.arange(len(RULES)) % (GRADES + 1)
    model = fit(patterns, np.array([n for _, n in counted], float))
    probs = posterior(patterns.reshape(-1, len(RULES)), model)
    table = spark.createDataFrame([(int(c), float(p)) for c, p in zip(codes, probs)], "_pattern long, _known double")
    joined = measured.join(F.broadcast(table), F.col("_stats.pattern") == F.col("_pattern"), "left")
    quality = F.coalesce("_known", F.lit(float(round(model["prior"], 6))))
    return joined.withColumn("_failed", failed).withColumn("_quality", quality).withColumn("_kept", ~F.col("_failed") & (F.col("_quality") >= threshold)).drop("_pattern", "_known")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key of each row with the statistics of its whole text, base_failed, kept and quality; other columns are not
    read."""
    measured = written(measure(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"))).drop("_1"), "quality")
    return judge(measured).select(F.col("_0").alias(key), *[F.col(f"_stats.{k}").alias(k) for k in STATS[:5]], F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_quality").alias("quality"))


def accepted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model and the base rules keep, with the columns as they are, whatever their names."""
    kept = judge(written(measure(docs, text), "quality")).where("_kept")
    return kept.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
