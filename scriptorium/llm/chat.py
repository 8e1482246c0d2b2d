"""Chat formatting with budgeted windows, in DataFrame functions alone.

A turn is written ``<turn role>text</turn>``; in texts and roles ``\\`` becomes ``\\b`` and ``<`` becomes ``\\l``, in roles
also ``>`` becomes ``\\g``, so no text can hold a marker and reading back is exact. The prefix sums of the turns' tokens cut a conversation into
spans of whole turns within the budget. Each window has the system turn (if the first turn is one), the last
``history`` turns before its span as context, and its span; only assistant texts of the span, not repeated
ones, are under the loss mask. Tokens are counted as runs of letters or digits and other single signs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn ", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    plain = F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<"))
    return F.replace(plain, F.lit("\\b"), F.lit("\\"))


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"))


def conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv and turns (array of role, text and tokens in order). Turns with one number follow the order of role
    and text; null roles and texts count as empty; a null conversation id is a conversation of its own; repeated rows are
    turns of their own; other columns are not read. A conversation is a row, as its digest needs all of it."""
    one = F.struct(F.col(turn), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"), tokens(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n"))
    turns = F.array_sort(F.collect_list(one))
    return rows.groupBy(F.col(conv).alias(conv)).agg(turns.alias("turns"))


def windows(convs: DataFrame, conv: str = "conv_id", budget: int = 512, history: int = 2) -> DataFrame:
    """conv and windows: text, repeated (leading turns that are repeated) and loss (array of start and length in
    code points of the window's text).

    A span begins where its prefix sum would pass the budget, less the system turn's tokens; a turn longer
    than that has a span of its own, whole. Of the history, turns that don't fit beside the span are left out."""
    first = F.element_at("turns", 1)
    system = F.when(first["role"] == "system", 1).otherwise(0)
    room = F.greatest(F.lit(1).cast("long"), F.lit(budget) - F.when(first["role"] == "system", first["n"]).otherwise(0))
    df = convs.withColumn("_sys", system).withColumn("_room", room)
    # starts of spans (1-based, after the system turn), from running sums: {sum in span, index, starts}
    zero = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("at"))

    def step(acc: Column, t: Column) -> Column:
        i = acc["i"] + 1
        skip = (i == 1) & (t["role"] == "system")
        new = ~skip & ((F.size(acc["at"]) == 0) | (acc["s"] + t["n"] > F.col("_room")))
        return F.struct(
            F.when(skip, F.lit(0)).when(new, t["n"]).otherwise(acc["s"] + t["n"]).cast("long").alias("s"),
            i.cast("int").alias("i"),
            F.when(new, F.concat(acc["at"], F.array(i.cast("int")))).otherwise(acc["at"]).alias("at"),
        )

    starts = F.aggregate("turns", zero, step, lambda a: F.when(F.size(a["at"]) == 0, F.array(F.lit(1))).otherwise(a["at"]))
    df = df.withColumn("_at", starts)

    def window(start: Column, k: Column) -> Column:
        end = F.coalesce(F.try_element_at("_at", k + 2), F.size("turns") + 1)
        span = F.slice("turns", start, end - start)
        used = F.aggregate(span, F.lit(0).cast("long"), lambda s, t: s + t["n"])
        lead = F.when((k == 0) & (F.col("_sys") == 1) & (start > 1), F.slice("turns", 1, 1)).otherwise(F.slice("turns", 1, 0))
        again = F.when((k > 0) & (F.col("_sys") == 1), F.slice("turns", 1, 1)).otherwise(F.slice("turns", 1, 0))
        before = F.greatest(F.col("_sys") + 1, start - history)
        past = F.when(k > 0, F.slice("turns", before, F.greatest(F.lit(0), start - before))).otherwise(F.slice("turns", 1, 0))
        # from the nearest turn backwards, as far as the room goes
        fits = F.aggregate(F.reverse(past), F.struct(used.alias("s"), F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, t: F.struct((a["s"] + t["n"]).alias("s"), F.when(a["on"] & (a["s"] + t["n"] <= F.col("_room")), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["on"] & (a["s"] + t["n"] <= F.col("_room"))).alias("on")))["n"]
        past = F.slice(past, F.size(past) - fits + 1, fits)
        repeated = F.size(again) + F.size(past)
        shown = F.transform(F.concat(again, past), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), F.lit(False).alias("own")))
        own = F.transform(F.concat(lead, span), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), (t["role"] == "assistant").alias("own")))
        parts = F.transform(F.concat(shown, own), lambda t: F.struct(F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(">")).alias("head"), escape(t["text"]).alias("body"), t["own"].alias("own")))
        whole = F.array_join(F.transform(parts, lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
        sums = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))

        def place(acc: Column, t: Column) -> Column:
            begin = acc["at"] + F.length(t["head"])
            spot = F.struct(begin.cast("int").alias("start"), F.length(t["body"]).cast("int").alias("length"))
            return F.struct((begin + F.length(t["body"]) + len(CLOSE)).cast("int").alias("at"), F.when(t["own"], F.concat(acc["loss"], F.array(spot))).otherwise(acc["loss"]).alias("loss"))

        loss = F.aggregate(parts, sums, place, lambda a: a["loss"])
        return F.struct(whole.alias("text"), repeated.cast("int").alias("repeated"), loss.alias("loss"))

    return df.select(conv, F.transform("_at", window).alias("windows"))


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, turns (role, text), loss_text and formatted_chars, from the windows alone."""

    def turns(w: Column) -> Column:
        parts = F.split(w["text"], OPEN)  # texts hold no plain "<"; nothing stands before the first marker
        parts = F.slice(parts, w["repeated"] + 2, F.size(parts))
        return F.transform(parts, lambda p: F.struct(unescape(F.substring_index(p, ">", 1)).alias("role"), unescape(F.regexp_extract(p, r"(?s)^[^>]*>(.*)</turn>\n$", 1)).alias("text")))

    def loss(w: Column) -> Column:
        return F.array_join(F.transform(w["loss"], lambda x: unescape(F.substr(w["text"], x["start"] + 1, x["length"]))), "")

    return formatted.select(
        conv,
        F.flatten(F.transform("windows", turns)).alias("turns"),
        F.array_join(F.transform("windows", loss), "").alias("loss_text"),
        F.aggregate("windows", F.lit(0).cast("long"), lambda s, w: s + F.length(w["text"])).alias("formatted_chars"),
    )


def digests(read: DataFrame, conv: str = "conv_id") -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        conv, F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )
