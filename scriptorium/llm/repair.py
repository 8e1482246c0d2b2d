"""Repair of conversations whose turns are out of order of speakers, blank, repeated or cut off.

Every row becomes one sign (initial of its role and its fault), every conversation a short signature. The cheapest
edits of each distinct signature are found once and joined back; the edits are then replayed over the rows.

Rows are dealt by conversation twice: without their texts for the signatures, with them for the replay. Both
passes read sorted rows one after the other, so a task holds a signature and an audit (a byte a row), never the
texts of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import tidy
from .store import written

SPACES = " \t\n\x0b\x0c\r"
#: Signs of a row by fault (none, blank, duplicate, truncated) and initial (s, u, a, another).
SIGNS = ("suao", "0123", "4567", "SUAO")
INSERT, DELETE, TRUNCATED = 5, 2, 5
#: Who must come after nobody, a system, a user and an assistant turn, if not a system turn at the start.
_NEXT = (2, 2, 3, 2)
_ENDS = (0, 3)


def solve(signature: str) -> tuple[int, str]:
    """(least cost, the ASCII-least audit of that cost) of the edits after which initials read ``(s?(ua)+)?``.

    ``best(place, state)`` is the cheapest way to edit the rows from a place on, after a state (nothing yet, s, u, a).
    It is memoised for one place from those of the next, last place first, so no stack grows with the conversation. Of
    audits only what ties need is kept: their letters up to the next row and the rank of the rest."""
    best = [(0, "", 0), (2 * INSERT, "II", 0), (INSERT, "I", 0), (0, "", 0)]  # cost, letters of this place, state after
    rank, path = [0, 2, 1, 0], []
    for sign in reversed(signature):
        fault, who = next((f, s.index(sign)) for f, s in enumerate(SIGNS) if sign in s)
        plain = []
        for state in range(4):
            ways = [(DELETE + best[state][0], "D", rank[state], state)]
            if fault in (0, 3):
                more = TRUNCATED if fault else 0
                to = _NEXT[state]
                ways.append((1 + more + best[to][0], "R", rank[to], to))
                if who == to - 1 or (who == 0 and state == 0):
                    to = who + 1
                    ways.append((more + best[to][0], "K", rank[to], to))
            plain.append(min(ways))
        whole = []
        for state in range(4):
            ways, at = [], state
            for k in range(3):  # three inserts lead where one does
                cost, letter, after, to = plain[at]
                ways.append((cost + INSERT * k, "I" * k + letter, after, to))
                at = _NEXT[at]
            whole.append(min(ways))
        order = sorted({x[1:3] for x in whole})
        rank = [order.index(x[1:3]) for x in whole]
        best = [(x[0], x[1], x[3]) for x in whole]
        path.append([(x[1], x[2]) for x in best])
    cost, state, audit = best[0][0], 0, []
    for step in reversed(path):
        letters, state = step[state]
        audit.append(letters)
    return cost, "".join(audit) + ("", "II", "I", "")[state]


def read(signature: str) -> dict[str, int]:
    """How many rows of a signature have each fault, and how many neighbours can't follow each other."""
    who = signature.translate(str.maketrans("".join(SIGNS), SIGNS[0] * 4))
    faults = {n: sum(signature.count(c) for c in SIGNS[k]) for k, n in enumerate(("blank", "duplicate", "truncated"), 1)}
    return faults | {"illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(who, who[1:]))}


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with planted faults, by crc32 of ``conversation:turn`` modulo 20: 0 drops a row, 1 empties its text, 2
    takes ``.``, ``!`` and ``?`` from it, 3 repeats the row, 4 makes it the user's. A null is one space, in the key
    as in role and text; other columns are not read."""
    or_space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    case = F.crc32(F.concat(or_space(conv), F.lit(":"), or_space(turn))) % 20
    said = F.when(case == 1, "").when(case == 2, F.translate(or_space(text), ".!?", "")).otherwise(or_space(text))
    who = F.when(case == 4, "user").otherwise(or_space(role))
    copies = F.when(case == 0, 0).when(case == 3, 2).otherwise(1)
    out = rows.select(F.col(f"`{conv}`").alias(conv), F.col(f"`{turn}`").alias(turn), who.alias(role), said.alias(text), copies.alias("_copies"))
    return out.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).drop("_copies", "_copy")


def _named(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, same (digest of role and text), role, text; a null role or text is empty."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text))
    same = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    return rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), same.alias("same"), role.alias("role"), text.alias("text"))


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Rows of a conversation in one task, by turn (nulls first); of one turn by the digest of role and text."""
    return rows.repartition("conv").sortWithinPartitions("conv", *first, F.asc_nulls_first("turn"), "same")


def _sign(role: Column, text: Column, seen: Column) -> Column:
    bare = F.rtrim(text, F.lit(SPACES))
    initial = F.substring(role, 1, 1)
    sign = lambda k: F.when(initial == "s", SIGNS[k][0]).when(initial == "u", SIGNS[k][1]).when(initial == "a", SIGNS[k][2]).otherwise(SIGNS[k][3])
    return F.when(bare == "", sign(1)).when(seen, sign(2)).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), sign(3)).otherwise(sign(0))


def _batch(rows: list[tuple], names: tuple, of: pa.DataType) -> pa.RecordBatch:
    """The rows as Arrow; ``of`` is the type of the first column, others are as their values."""
    first, *rest = zip(*rows)
    return pa.record_batch([pa.array(first, of), *map(pa.array, rest)], list(names))


def signatures(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, signature and gaps (turns missing between the least and the largest; 0 if all are null)."""
    # signs are taken before the shuffle, for texts seen earlier and not, so that no text has to move
    slim = _named(rows, conv, turn, role, text)
    new, again = (_sign(F.col("role"), F.col("text"), F.lit(x)) for x in (False, True))
    slim = slim.select("conv", "turn", "same", new.alias("new"), again.alias("again")).repartition("conv")
    nth = F.row_number().over(W.partitionBy("conv", "same").orderBy(F.asc_nulls_first("turn")))
    slim = slim.withColumn("nth", nth).select("conv", "turn", "same", "nth", F.when(F.col("nth") == 1, F.col("new")).otherwise(F.col("again")).alias("sign"))
    slim = slim.sortWithinPartitions("conv", F.asc_nulls_first("turn"), "same", "nth").select("conv", "turn", "sign")
    kind = dict(slim.dtypes)["conv"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, signs, low, high, n, done, of = None, [], None, None, 0, [], None
        for b in batches:
            of = b.schema.field(0).type
            for c, t, s in zip(*(x.to_pylist() for x in b.columns)):
                if signs and c != at:
                    done.append((at, "".join(signs), high - low + 1 - n if n else 0))
                    signs, low, high, n = [], None, None, 0
                at = c
                signs.append(s)
                if t is not None and t != high:
                    low, high, n = t if low is None else low, t, n + 1
            if done:
                yield _batch(done, out, of)
                done = []
        if signs:
            yield _batch([(at, "".join(signs), high - low + 1 - n if n else 0)], out, of)

    out = ("conv", "signature", "gaps")
    return slim.mapInArrow(run, f"conv {kind}, signature string, gaps long")


def audits(signed: DataFrame) -> DataFrame:
    """``signed`` (see ``signatures``) with blank, duplicate, truncated, illegal, cost and audit; each distinct signature is
    solved once."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = b.column(0).to_pylist()
            solved, counts = [solve(s) for s in known], [read(s) for s in known]
            columns = [pa.array([c[n] for c in counts], pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal")]
            yield pa.record_batch([b.column(0), *columns, pa.array([c for c, _ in solved], pa.int64()), pa.array([a for _, a in solved], pa.string())], names=["signature", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    solved = signed.select("signature").distinct().mapInArrow(run, "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    return signed.join(solved, "signature")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, role, text, letter) of what stays and what is inserted, from sorted rows: each conversation's audit
    first, then its turns. (conv, None, None, None) opens a conversation."""
    audit, at, state, conv = "", 0, 0, None

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state, at = _NEXT[state], at + 1
            yield conv, ("", "system", "user", "assistant")[state], "", "I"

    for b in batches:
        for c, a, role, text in zip(*(b.column(n).to_pylist() for n in ("conv", "audit", "role", "text"))):
            if a is not None:
                yield from inserted()
                audit, at, state, conv = a, 0, 0, c
                yield conv, None, None, None
                continue
            yield from inserted()
            letter, at = audit[at], at + 1
            if letter == "D":
                continue
            state = 1 if letter == "K" and role[:1] == "s" else _NEXT[state]
            yield conv, role if letter == "K" else ("", "system", "user", "assistant")[state], text, letter
    yield from inserted()


def _with_audits(rows: DataFrame, found: DataFrame, names: tuple) -> DataFrame:
    said = _named(rows, *names).select("conv", F.lit(1).alias("kind"), "turn", "same", "role", "text", F.lit(None).cast("string").alias("audit"))
    first = found.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("same"), F.lit("").alias("role"), F.lit("").alias("text"), "audit")
    return _in_order(said.unionByName(first), "kind").select("conv", "role", "text", "audit")


def _run(rows: DataFrame, found: DataFrame, names: tuple, collect: Callable, out: dict[str, str]) -> DataFrame:
    """conv and what ``collect`` makes of the stream of ``_replayed``: tuples (conv, ...), in columns ``out``."""
    both = _with_audits(rows, found, names)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = None

        def typed():
            nonlocal of
            for b in batches:
                of = b.schema.field("conv").type
                yield b

        done, size = [], 0
        for x in collect(_replayed(typed())):
            done.append(x)
            size += 64 + sum(len(v) for v in x if isinstance(v, str))
            if size > 1 << 20:
                yield _batch(done, ("conv", *out), of)
                done, size = [], 0
        if done:
            yield _batch(done, ("conv", *out), of)

    return both.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in ({"conv": dict(both.dtypes)["conv"]} | out).items()))


def replayed(rows: DataFrame, found: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired turns: conv, place (from 0), role, text and edit (K kept, R with another role, I inserted)."""

    def collect(stream: Iterator[tuple]) -> Iterator[tuple]:
        place = 0
        for c, who, said, letter in stream:
            if letter is None:
                place = 0
            else:
                yield c, place, who, said, letter
                place += 1

    return _run(rows, found, (conv, turn, role, text), collect, {"place": "long", "role": "string", "text": "string", "edit": "string"})


def digests(rows: DataFrame, found: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv and repaired_sha256: of ``role:text`` of the repaired turns, joined by newlines, hashed as they pass."""

    def collect(stream: Iterator[tuple]) -> Iterator[tuple]:
        sha, said, at = None, False, None
        for c, who, text, letter in stream:
            if letter is None:
                if sha:
                    yield at, sha.hexdigest()
                sha, said, at = hashlib.sha256(), False, c
            else:
                sha.update(f"{chr(10) if said else ''}{who}:{text}".encode())
                said = True
        if sha:
            yield at, sha.hexdigest()

    return _run(rows, found, (conv, turn, role, text), collect, {"repaired_sha256": "string"})


def report(rows: DataFrame, ids: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation of
    ``rows``, and zeros with an empty audit for those of ``ids`` (a column named as ``conv``) that have no row.

    A null role or text is empty, a null turn comes first, turns of one number follow the digest of role and text, a
    repeated row is a duplicate of the first, rows with a null conversation are one conversation. Texts of any length pass
    one by one. Other columns are not read."""
    names = (conv, turn, role, text)
    found = written(audits(written(signatures(rows, *names), "signatures")), "audits")
    out = found.join(digests(rows, found, *names).withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c")), "left").drop("c")
    if ids is not None:
        all_ = ids.select(F.col(f"`{conv}`").alias("id")).distinct()
        out = all_.join(out, F.col("id").eqNullSafe(F.col("conv")), "left").withColumn("conv", F.col("id"))
    numbers = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256().hexdigest())
    return out.select(F.col("conv").alias(conv), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
