"""Keyword rules on arrays, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import first_full, strip

# Words too common to review.
COMMON = """我们 你们 他们 她们 它们 这个 那个 什么 怎么 怎样 哪里 那里 这里 的 了 是 在 有 和 与 或 就 都 也 还 又 再 不 没
可以 能够 需要 应该 必须 可能 也许 集合 会议 东西 事情 一下 今天 明天
we you they this that the a an and or to of in on for is are was were need should maybe""".split()
# Shapes of words worth a review.
SHAPES = (
    r"[A-Za-z][A-Za-z0-9_+#.\-]*\+\+",
    r"\b[A-Za-z]#\b",
    r"(?i)\bv\d+(?:\.\d+)*\b",
    r"\d+(?:\.\d+)?%",
    r"\d+(?:\.\d+)?(?:元|块|美元|公里|米|分钟|小时|号|楼|层)",
    r"\d{1,2}:\d{2}",
    r"(?:>=|<=|!=|==|->|::|\+=|-=|\*=|/=|%d)",
)
# Spoken Chinese numbers that a written text should not have.
SPOKEN_NUMBERS = (r"[一-三四五六七八九十百千万亿]+[年月日号]", r"百分之[零一二三四五六七八九十百千万]+")
_SIGN = r"[一-鿿A-Za-z0-9+#%]"


def dedupe(words: Column) -> Column:
    """Stripped, without blanks and nulls, each at its first place."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(words, F.array().cast("array<string>")), strip), lambda w: w.isNotNull() & (w != "")))


def is_common(word: Column) -> Column:
    w = strip(word)
    return (w == "") | w.isin(COMMON) | ((F.length(w) <= 1) & ~w.rlike(_SIGN))


def has_shape(word: Column) -> Column:
    found = word.rlike("|".join(f"(?:{s})" for s in SHAPES))
    return found | word.rlike(r"[A-Za-z][A-Za-z0-9_+#.\-]+") | word.rlike(r"\p{Nd}") | ((F.length(word) >= 2) & word.rlike("[一-鿿]"))


def has_evidence(word: Column, source: Column, refined: Column, inferred: bool = True) -> Column:
    """The word stands in a text, or (inferred) all but one of its signs do, or a copula follows it."""
    w = strip(word)
    plain = F.contains(refined, w) | F.contains(source, w)
    if inferred:
        signs = F.filter(F.split(w, ""), lambda c: c.rlike(_SIGN))
        enough = lambda text: F.size(F.filter(signs, lambda c: F.contains(text, c))) >= F.greatest(F.lit(1), F.size(signs) - 1)
        spelled = (F.length(w) > 1) & (F.size(signs) > 0) & (enough(refined) | enough(source))
        named = (F.length(w) == 1) & (F.contains(source, F.concat(w, F.lit("是"))) | F.contains(source, F.concat(w, F.lit("叫"))) | F.contains(source, F.concat(w, F.lit("为"))))
        plain = plain | spelled | named
    return (w != "") & plain


def review_targets(words: Column, source: Column, refined: Column, inferred: bool = True) -> Column:
    return F.filter(dedupe(words), lambda w: ~is_common(w) & (has_evidence(w, source, refined, inferred) | has_shape(w)))


def first_words(*fields: Column) -> Column:
    """Deduplicated words of the first field that has any element."""
    return dedupe(F.coalesce(*[F.when(F.size(f) > 0, f) for f in fields]))


def check(words: Column, source: Column, oral: Column, refined: Column) -> Column:
    """accepted, reason and the offending words."""
    own = dedupe(words)
    text = F.concat_ws("\n", F.when(source != "", source), F.when(oral != "", oral))
    common = F.filter(own, is_common)
    bare = F.filter(own, lambda w: ~has_evidence(w, text, first_full(refined, F.lit(""))))
    none = F.array().cast("array<string>")
    said = lambda ok, reason, which: F.struct(F.lit(ok).alias("accepted"), F.lit(reason).alias("reason"), which.alias("words"))
    return F.when(F.size(own) == 0, said(True, "no keywords", none)).when(F.size(common) > 0, said(False, "common terms", common)).when(F.size(bare) > 0, said(False, "no evidence", bare)).otherwise(said(True, "passed", none))


def traceable(rows: DataFrame) -> DataFrame:
    """The rows (input, oral_text, output with refined_text and keyword_list) whose keywords pass ``check``."""
    found = check(F.col("output.keyword_list"), F.col("input"), F.col("oral_text"), F.col("output.refined_text"))
    return rows.where(found["accepted"])


def spoken_numbers(text: Column) -> Column:
    """The patterns of unwritten numbers that a text matches."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(p)) for p in SPOKEN_NUMBERS]), lambda p: p.isNotNull())
