"""Personal data, and the words that give it away, in DataFrame functions alone.

Patterns find what is personal by its form (e-mail, IP, card and phone numbers). What else reveals such a value is learned
from the corpus: of the words around its mentions, those that occur nearly nowhere else. For a value c and a word t,
with probabilities of a word of the corpus to lie around a mention of c, to be t, and both,

    disclosure = PMI(c; t) / IC(c) = log(p(c, t) / (p(c) p(t))) / -log p(c)

is 0 for words that have nothing to do with c, and 1 for words that occur around c alone. A word whose disclosure
reaches a threshold is generalised to its initial, if the words with this initial together stay under the threshold
for the same values, and is removed if not.

Only words around mentions become pairs, two windows a mention; words are counted once, over all documents, and only if
some word may exceed the threshold at all: each of these words by itself, all others by their initial.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keyed, written

#: A run of what may stand before @ has one end, so only its start, or the end of the match before, is tried: texts of any
#: length take linear time. Possessive groups never recurse.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Whole runs of digits, of 16 at least.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = r"(?<![\p{L}\p{N}])\p{N}*+\p{L}[\p{L}\p{N}]*+"
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_CHUNK = 256
#: Words that are sent to each task at most; if more may reveal something, all words are counted by themselves.
SENT = 1 << 18
_SPANS = "array<struct<kind:string,start:bigint,end:bigint,value:string,left:string,right:string>>"


def _placed(pieces: Column, matches: Column) -> Column:
    """An array of (start, end, match, left, right) from the pieces between matches: running sums of lengths, in chunks, so
    that a text with very many matches doesn't take the square of their number."""
    both = F.transform(matches, lambda m, i: F.struct(F.element_at(pieces, i + 1).alias("p"), m.alias("m"), F.element_at(pieces, i + 2).alias("q")))
    size = lambda x: F.length(x["p"]).cast("long") + F.length(x["m"])
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / _CHUNK).cast("int")), lambda k: F.slice(both, k * _CHUNK + 1, _CHUNK))
    zero = F.lit(0).cast("long")
    sums = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda s, x: s + size(x)))
    none = F.array().cast("array<struct<start:bigint,end:bigint,m:string,p:string,q:string>>")

    def chunk(c: Column, k: Column) -> Column:
        before = F.aggregate(F.slice(sums, F.lit(1), k), zero, lambda s, x: s + x)

        def step(acc: Column, x: Column) -> Column:
            end = acc["at"] + size(x)
            one = F.struct((end - F.length(x["m"])).alias("start"), end.alias("end"), x["m"].alias("m"), x["p"].alias("p"), x["q"].alias("q"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(c, F.struct(before.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    return F.flatten(F.transform(chunks, chunk))


def _holds(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(8, 15) if kind == "phone" else F.lit(True)


def _window(text: Column, width: int, before: bool) -> Column:
    """The whole words of the last (``before``) or first ``width`` characters."""
    near = F.right(text, F.lit(width)) if before else F.left(text, F.lit(width))
    cut = F.regexp_replace(near, r"^[\p{L}\p{N}]+" if before else r"[\p{L}\p{N}]+$", "")
    return F.when(F.length(text) > width, cut).otherwise(near)


def spans(rows: DataFrame, text: Column, width: int = 120) -> DataFrame:
    """Adds _spans: kind, start, end (code points, end exclusive), value (one spelling of it), and the texts left and right of
    it, of ``width`` code points at most, of all base spans by kind and start."""
    rows = rows.withColumn("_t", F.coalesce(text, F.lit("")))
    none = F.array().cast(_SPANS)
    for kind, pattern in KINDS.items():
        found = F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))
        rows = rows.withColumn(f"_{kind}", F.when(F.contains("_t", F.lit(_NEEDS[kind])), found).otherwise(F.array().cast("array<string>")) if kind in _NEEDS else found)
    for kind, pattern in KINDS.items():
        m = F.col(f"_{kind}")
        value = (lambda x: F.lower(x)) if kind == "email" else (lambda x: x) if kind == "ip" else (lambda x: F.regexp_replace(x, "[^0-9]", ""))
        held = F.filter(_placed(F.col("_pieces"), m), lambda x: _holds(kind, x["m"]))  # noqa: B023
        own = F.transform(held, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), value(x["m"]).alias("value"), _window(x["p"], width, True).alias("left"), _window(x["q"], width, False).alias("right")))  # noqa: B023
        rows = rows.withColumn("_pieces", F.when(F.size(m) > 0, F.split("_t", pattern, -1))).withColumn(f"_{kind}", F.when(F.exists(m, lambda x: _holds(kind, x)), own).otherwise(none))  # noqa: B023
    return rows.withColumn("_spans", F.concat(*[F.col(f"_{k}") for k in KINDS]).cast(_SPANS)).drop("_t", "_pieces", *[f"_{k}" for k in KINDS])


def words(text: Column) -> Column:
    """Words with a letter, in lower case, outside of e-mail addresses."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(text, EMAIL, " "), F.lit(WORD), F.lit(0)), F.lower)


def _sketch(text: Column) -> Column:
    """The least digest of a text's runs of three words: texts that share most of their runs share it."""

    def runs(w: Column) -> Column:
        at = lambda i: F.coalesce(F.get(w, i), F.lit(""))
        return F.transform(w, lambda x, i: F.md5(F.concat_ws(" ", x, at(i + 1), at(i + 2))))

    # in an array, so that the words are taken once
    return F.coalesce(F.element_at(F.transform(F.array(words(text)), lambda w: F.array_min(runs(w))), 1), F.lit(""))


def revealing(found: DataFrame, corpus: DataFrame, text: Column, threshold: float = 0.9, support: float = 3.0) -> DataFrame | None:
    """(term, general): words that give away a value of ``found`` (a table with _spans and _sketch), and whether their initial may stay; None if
    there are none. ``corpus`` has all documents.

    Of one text, or of copies of it with edits, nothing is learned: a word must stand around the value in ``support`` different
    texts, by sketch and weight (one over the sum of squared shares of its mentions), so a text with most of the mentions counts as one."""
    mention = found.where(F.size("_spans") > 0).select("_sketch", F.explode("_spans").alias("x"))
    around = mention.select("x.kind", "x.value", "_sketch", F.concat(words(F.col("x.left")), words(F.col("x.right"))).alias("w"))
    pairs = around.select("kind", "value", "_sketch", F.explode("w").alias("term"))
    # counts by sketch first: a value or a word that most mentions have is added up before it is shuffled
    pairs = pairs.groupBy("kind", "value", "term", "_sketch").agg(F.count(F.lit(1)).alias("n")).groupBy("kind", "value", "term").agg(F.sum("n").alias("n_ct"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    pairs = written(pairs.withColumn("texts", F.col("n_ct") * F.col("n_ct") / F.col("squares")), "pairs")
    near = pairs.where(F.col("texts") >= support)
    if near.isEmpty():
        return None
    initial = F.left("term", F.lit(1))
    said = corpus.select(F.explode(words(F.coalesce(text, F.lit("")))).alias("term")).select("term", initial.alias("initial"))
    asked = near.select("term").distinct()
    if asked.count() <= SENT:
        said = said.join(F.broadcast(asked.withColumn("_asked", F.lit(True))), "term", "left").select(F.when(F.col("_asked"), F.col("term")).alias("term"), "initial")
    vocabulary = written(said.groupBy("term", "initial").agg(F.count(F.lit(1)).alias("n_t")), "vocabulary")
    total = vocabulary.agg(F.sum("n_t")).first()[0]
    values = pairs.groupBy("kind", "value").agg(F.sum("n_ct").alias("n_c"))
    wide = pairs.groupBy("kind", "value", initial.alias("initial")).agg(F.sum("n_ct").alias("n_cg"))
    initials = vocabulary.groupBy("initial").agg(F.sum("n_t").alias("n_g"))
    df = near.join(values, ["kind", "value"]).join(vocabulary.where(F.col("term").isNotNull()).drop("initial"), "term").withColumn("initial", initial).join(wide, ["kind", "value", "initial"]).join(initials, "initial")

    def tells(both: str, alone: str) -> Column:
        pmi = F.log2(F.least(both, alone) * F.lit(float(total)) / (F.col("n_c") * F.col(alone)))
        return pmi >= threshold * F.log2(F.lit(float(total)) / F.col("n_c"))

    told = df.where(tells("n_ct", "n_t")).groupBy("term").agg(F.bool_and(~tells("n_cg", "n_g")).alias("general"))
    told = written(told, "revealing")
    return None if told.isEmpty() else told


def _terms(rows: DataFrame, found: DataFrame, told: DataFrame, text: Column) -> DataFrame:
    """_file, _row and _terms (kind, start, end, value) of the rows with words of ``told``, outside of base spans. A value is the initial that
    may stay, or empty."""
    has = rows.select("_file", "_row", F.explode(words(F.coalesce(text, F.lit("")))).alias("term")).join(told, "term")
    has = has.groupBy("_file", "_row").agg(F.map_from_entries(F.collect_set(F.struct("term", "general"))).alias("_told"))
    some = rows.withColumn("_t", F.coalesce(text, F.lit(""))).select("_file", "_row", "_t").join(has, ["_file", "_row"]).join(found.select("_file", "_row", "_spans"), ["_file", "_row"])
    some = some.withColumn("_w", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0))).withColumn("_p", F.split("_t", WORD, -1))
    all_ = F.transform(F.filter(_placed(F.col("_p"), F.col("_w")), lambda x: F.map_contains_key("_told", F.lower(x["m"]))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("m")))
    free = F.filter(all_, lambda x: ~F.exists("_spans", lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"])))
    value = lambda x: F.when(F.element_at("_told", F.lower(x["m"])), F.left(x["m"], F.lit(1))).otherwise("")
    return some.select("_file", "_row", F.transform(free, lambda x: F.struct(F.lit("term").alias("kind"), x["start"].alias("start"), x["end"].alias("end"), value(x).alias("value"))).alias("_terms"))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.9, support: float = 3.0, width: int = 120) -> tuple[DataFrame, DataFrame]:
    """(rows of ``docs`` with _file and _row, a table of _file, _row, _id, _spans, _terms for each of them)."""
    rows, file, row = keyed(docs)
    said = F.col(f"`{text}`")
    rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns], file.alias("_file"), row.alias("_row"))
    base = spans(rows.select("_file", "_row", F.col(f"`{key}`").alias("_id"), said.alias("_said")), F.col("_said"), width)
    base = base.withColumn("_sketch", F.when(F.size("_spans") > 0, _sketch(F.col("_said")))).drop("_said")
    found = written(base, "spans")
    told = revealing(found, rows, said, threshold, support)
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>")
    if told is None:
        return rows, found.withColumn("_terms", empty)
    # both sides grow with the input, so none is broadcast, however small it is now
    terms = _terms(rows, found, told, said)
    return rows, written(found.join(terms.hint("merge"), ["_file", "_row"], "left").withColumn("_terms", F.coalesce("_terms", empty)), "found")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.9, support: float = 3.0, width: int = 120) -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, n_term, base_sha256 and spans (``kind:start:end`` by kind, then start) of every row.

    A null text is empty; empty texts have no span; keys may be null or repeat, rows are told apart by their place; equal
    texts have equal spans. Texts are searched whole, in linear time. Other columns are not read."""
    found = find(docs, key, text, threshold, support, width)[1]
    named = lambda c: F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    count = lambda k: F.size(F.filter("_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        F.col("_id").alias(key), *[count(k) for k in KINDS], F.size("_terms").cast("long").alias("n_term"), F.sha2(F.array_join(named("_spans"), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(named("_spans"), named("_terms")), ",").alias("spans"),
    )


def sanitised(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.9, support: float = 3.0, width: int = 120) -> DataFrame:
    """The rows of ``docs``, all columns, with the text sanitised: base spans become ``[EMAIL]`` and the like, revealing words their initial and a
    full stop, or ``[REMOVED]``. Overlapping spans become one, named as the first. Null texts stay null."""
    rows, found = find(docs, key, text, threshold, support, width)
    label = lambda x: F.when(x["kind"] != "term", F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).when(x["value"] == "", "[REMOVED]").otherwise(F.concat(x["value"], F.lit(".")))
    cut = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), label(x).alias("label")))
    all_ = F.array_sort(F.concat(cut("_spans"), cut("_terms")))
    said = F.col(f"`{text}`")

    def step(acc: Column, x: Column) -> Column:
        begin = F.concat(acc["out"], F.substr(said, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), x["label"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], begin).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substr(said, (acc["at"] + 1).cast("int"), F.length(said)))
    clean = F.when(F.size("_cut") == 0, said).otherwise(F.aggregate("_cut", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step, rest))
    marked = found.where("size(_spans) + size(_terms) > 0").select("_file", "_row", all_.alias("_cut"))
    joined = rows.join(marked.hint("merge"), ["_file", "_row"], "left").withColumn("_cut", F.coalesce("_cut", F.array().cast("array<struct<start:bigint,end:bigint,label:string>>")))
    return joined.select(*[(clean if c == text else F.col(f"`{c}`")).alias(c) for c in docs.columns])
