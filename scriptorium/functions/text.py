"""Text functions as Column expressions; Arrow UDFs only where the JVM lacks the operation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Python's str.strip and \s have it, for Java regular expressions.
WS = r"(?U)[\s\x1c-\x1f]"
HAN = r"㐀-䶿一-鿿"

# Marks that speech recognition drops, and those each strength keeps.
REMOVABLE = "“”‘’「」『』（）【】《》〈〉—…：；、·―()[]{}\"'"
KEPT = {"light": "，。！？,.!?：:", "medium": "，。！？,.!?", "heavy": ",."}


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where body uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{WS}+\z|\A{WS}+", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def first_full(*cs: Column) -> Column:
    """The first that is neither null nor empty; else the last."""
    return F.coalesce(*[F.when(c != "", c) for c in cs[:-1]], cs[-1])


def degrade_punctuation(c: Column, strength: str = "medium") -> Column:
    """Removable marks, less those the strength keeps, become spaces. Unknown strengths count as medium."""
    gone = "".join(m for m in REMOVABLE if m not in KEPT.get(strength, KEPT["medium"]))
    return F.translate(c, gone, " " * len(gone))


def simulate_recognition(c: Column, strength: str = "medium") -> Column:
    return squeeze(degrade_punctuation(c, strength))


def normalize_cjk(c: Column) -> Column:
    """Drop spaces between Han characters and full-width marks, and before closing ASCII marks."""
    han, mark = r"㐀-䶿一-鿿豈-﫿", r"　-〿＀-￯"
    sides = [(a, b) for a in (han, mark) for b in (han, mark)]
    c = reduce(lambda t, s: F.regexp_replace(t, rf"(?<=[{s[0]}]){WS}+(?=[{s[1]}])", ""), sides, c)
    return F.regexp_replace(c, rf"{WS}+(?=[,.!?;:%)\]}}])", "")


def is_ascii(c: Column) -> Column:
    return c.rlike(r"\A[\x00-\x7f]*\z")


def join_chunks(chunks: Column) -> Column:
    """Concatenate stripped, non-blank chunks, with a space only between two ASCII characters."""
    full = F.filter(F.transform(chunks, strip), lambda x: x != "")

    def add(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.when((acc != "") & is_ascii(F.right(acc, F.lit(1))) & is_ascii(F.left(x, F.lit(1))), " ").otherwise(""), x)

    return F.aggregate(full, F.lit(""), add)


def clean_response(c: Column) -> Column:
    """A chat model's answer without its markers."""
    steps = ((rf"\A<\|im_start\|>assistant{WS}*", ""), (rf"<\|im_end\|>{WS}*\z", ""), (rf"(?i)\Aassistant{WS}*[:：]?{WS}*", ""), (rf"</s>{WS}*\z", ""))
    return strip(reduce(lambda t, s: F.regexp_replace(t, *s), steps, strip(c)))


@F.pandas_udf(StringType())
def _compat_fold(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC").str.casefold()


@F.pandas_udf(StringType())
def _compat(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


@F.pandas_udf(StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.str.casefold()


@lru_cache(maxsize=1)
def simplified_table() -> dict[str, str]:
    """Simplified forms of traditional Han characters, as the ICU library that comes with Spark has them."""
    icu = SparkSession.active()._jvm.com.ibm.icu.text.Transliterator.getInstance("Hant-Hans")
    chars = [chr(c) for block in ((0x3400, 0x4DC0), (0x4E00, 0xA000)) for c in range(*block)]
    return {a: b for a, b in zip(chars, icu.transliterate("\n".join(chars)).split("\n")) if a != b}


def longest_match(c: Column, phrases: dict[str, str], chars: dict[str, str] | None = None) -> Column:
    """The text with its phrases replaced, the leftmost first, of those at one place the longest; other characters by
    ``chars``. The phrases become an automaton, once a task, so their number costs no time."""
    chars = chars or {}
    if not phrases:
        return F.translate(c, "".join(chars), "".join(chars.values())) if chars else c
    table, single = dict(phrases), str.maketrans(chars)
    if "" in table:
        raise ValueError("a phrase must not be empty")

    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for k, v in table.items():
            found.add_word(k, (len(k), v))
        found.make_automaton()

        def one(text: str | None) -> str | None:
            if text is None:
                return None
            out, at = [], 0
            for end, (size, new) in found.iter_long(text):
                out += [text[at : end + 1 - size].translate(single), new]
                at = end + 1
            return "".join(out) + text[at:].translate(single)

        for s in batches:
            yield s.map(one)

    return run(c)


def metric_form(c: Column, simplified: dict[str, str] | None = None, ascii_only: bool = False, phrases: dict[str, str] | None = None) -> Column:
    """NFKC, traditional to simplified characters (by ``simplified_table``, or another table; words in ``phrases`` by theirs, the
    longest at each place), case folding, and marks, symbols and separators as single spaces. ``ascii_only``: the same for ASCII
    text without leaving the JVM."""
    if ascii_only:
        c = F.lower(c)
    else:
        table = simplified_table() if simplified is None else simplified
        c = _casefold(longest_match(_compat(c), phrases, table)) if phrases else F.translate(_compat_fold(c), "".join(table), "".join(table.values()))
    return squeeze(F.regexp_replace(c, r"[\p{P}\p{S}\p{Z}]", " "))


def word_tokens(c: Column) -> Column:
    """A run of Han characters or of [a-z0-9] is one token."""
    return F.regexp_extract_all(c, F.lit(f"[{HAN}]+|[a-z0-9]+"), F.lit(0))


def mixed_tokens(c: Column) -> Column:
    """Each Han character, or a run of [a-z0-9], is one token."""
    return F.regexp_extract_all(c, F.lit(f"[{HAN}]|[a-z0-9]+"), F.lit(0))


def token_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of token arrays: tokens become code points of their place among all tokens."""

    def coded(x: Column, both: Column) -> Column:
        place = lambda t: F.lpad(F.hex(F.lit(65536) + F.array_position(both, t)), 8, "0")
        return F.coalesce(F.decode(F.unhex(F.array_join(F.transform(x, place), "")), "UTF-32"), F.lit(""))

    # the three arrays as one value, so that each is computed once
    sides = F.struct(a.alias("a"), b.alias("b"), F.array_union(a, b).alias("both"))
    return let(sides, lambda s: F.levenshtein(coded(s["a"], s["both"]), coded(s["b"], s["both"])))


def text_metrics(reference: Column, hypothesis: Column, ascii_only: bool = False) -> Column:
    """Errors and reference units of words, characters and mixed tokens."""
    squeezed = lambda t: F.replace(t, F.lit(" "), F.lit(""))

    def counted(x: Column) -> Column:
        r, h = x["r"], x["h"]
        return F.struct(
            token_distance(word_tokens(r), word_tokens(h)).alias("wer_errors"), F.size(word_tokens(r)).alias("wer_units"),
            F.levenshtein(squeezed(r), squeezed(h)).alias("cer_errors"), F.length(squeezed(r)).alias("cer_units"),
            token_distance(mixed_tokens(r), mixed_tokens(h)).alias("mer_errors"), F.size(mixed_tokens(r)).alias("mer_units"),
        )

    return let(F.struct(metric_form(reference, ascii_only=ascii_only).alias("r"), metric_form(hypothesis, ascii_only=ascii_only).alias("h")), counted)


def sample_rate(errors: Column, units: Column) -> Column:
    """Errors per unit; without units 0 if there are no errors, else 1."""
    return F.when(units > 0, errors / units).otherwise(F.when(errors == 0, 0.0).otherwise(1.0))


def length_bucket(c: Column) -> Column:
    n = F.length(c)
    return F.when(n <= 20, "short").when(n <= 50, "medium").when(n <= 100, "long").otherwise("very_long")


def service_language(c: Column) -> Column:
    """The name of a language that speech services expect; other languages as they are."""
    low = F.lower(strip(c))
    return F.when(low.isin("zh", "cn", "chinese"), "Chinese").when(low.isin("en", "eng", "english"), "English").otherwise(c)


def endpoint_url(c: Column, suffix: str = "/chat/completions") -> Column:
    """Without trailing slashes, and ending in the suffix."""
    base = F.regexp_replace(strip(c), "/+$", "")
    return F.when(F.endswith(base, F.lit(suffix)), base).otherwise(F.concat(base, F.lit(suffix)))


#: What stands for a secret, and how much of a text is told.
REDACTED, TOLD = "[REDACTED]", 500


def redact(c: Column, secret: Column) -> Column:
    """The beginning of a text, without the secret; an empty or missing secret hides nothing."""
    hidden = F.when(F.length(secret) > 0, F.replace(c, secret, F.lit(REDACTED))).otherwise(c)
    return F.left(hidden, F.lit(TOLD))


_OPTION = r"(.+?){0}*[（(]{0}*(-?[0-9]+){0}*[）)]".format(WS.removeprefix("(?U)"))


def parse_option(c: Column) -> Column:
    """``text（score）`` as a struct; null if malformed."""
    pattern = rf"(?U)\A[\s\x1c-\x1f]*{_OPTION}[\s\x1c-\x1f]*\z"
    return F.when(c.rlike(pattern), F.struct(F.regexp_extract(c, pattern, 1).alias("text"), F.regexp_extract(c, pattern, 2).cast("int").alias("score")))


def parse_options(c: Column) -> Column:
    """Options joined by ASCII or full-width commas; null if anything is left over."""
    pattern = rf"(?U)(?:\A|[，,])[\s\x1c-\x1f]*{_OPTION}(?=[\s\x1c-\x1f]*[，,]|[\s\x1c-\x1f]*\z)"
    rest = F.regexp_replace(F.regexp_replace(c, pattern, ""), r"\A[ ，,]+|[ ，,]+\z", "")
    parts = F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("text"), F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(2)), lambda x: x.cast("int")).alias("score"))
    return F.when((rest == "") & (F.size(parts) > 0), F.transform(parts, lambda p: F.struct(p["text"].alias("text"), p["score"].alias("score"))))


def char_ngrams(c: Column, n: int = 3) -> Column:
    """The set of character n-grams of a stripped text; a shorter text is its own only gram."""
    size = F.length(strip(c))

    def grams(chars: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(chars) - n + 1)
        return F.array_distinct(F.transform(at, lambda i: F.concat(*[F.element_at(chars, i + k) for k in range(n)])))

    return F.when(size < n, F.array(strip(c))).otherwise(let(F.split(strip(c), ""), grams))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either set is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def seed_key(c: Column) -> Column:
    """Lower case with single spaces."""
    return squeeze(F.lower(c))
