"""Repair and merging of conversations against brute force; edge cases of their tables."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import repair, trie

TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def same(role, text):
    return sha(f"{len(role)}:{role}{text}")


def cheapest(rows):
    """Least (cost, audit, repaired) of all edits of (role, text, fault), by trying them all."""

    @lru_cache(None)
    def go(i, seq, inserts):
        found = []
        state = seq[-1:] or "^"
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", seq[-2:] if len(seq) > 2 else seq):
            found.append((0, "", ()))
        need = "a" if state == "u" else "u"
        names = {"u": "user", "a": "assistant"}

        def more(cost, letter, row, j, grown, k):
            for c, a, r in go(j, grown[-3:], k):
                found.append((c + cost, letter + a, (row, *r) if row else r))

        if inserts < 2:
            more(5, "I", (names[need], ""), i, seq + need, inserts + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            more(2, "D", None, i + 1, seq, 0)
            if fault not in ("blank", "duplicate"):
                cut = 5 if fault else 0
                more(cut + 1, "R", (names[need], text), i + 1, seq + need, 0)
                if role[:1] == need or (role[:1] == "s" and not seq):
                    more(cut, "K", (role, text), i + 1, seq + role[:1], 0)
        return tuple(sorted(found)[:1])

    return go(0, "", 0)[0]


def plain_report(rows):
    """What op11 returns of (conv, turn, role, text), row by row."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            kept += [(turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
        kept.sort(key=lambda x: (x[0] is not None, x[0], same(x[1], x[2])))
        seen, marked = set(), []
        for _, role, text in kept:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        cost, audit, repaired = cheapest(tuple(marked))
        turns = {t for t, _, _ in kept if t is not None}
        first = [r[:1] for r, _, _ in marked]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(sum(f == n for _, _, f in marked) for n in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit, sha("\n".join(f"{r}:{t}" for r, t in repaired)),
        )
    return out


def random_turns(seed, convs=40, most=7):
    rng = random.Random(seed)
    said = ["Yes.", "No!", "cut off", "", " \n", None, "Why?\n", "x" * 5000 + ".", "Yes."]
    rows = []
    for c in [*range(convs), -3, 10**12, None]:
        for i in range(rng.randint(1, most)):
            turn = rng.choice([None, rng.randint(0, 9), i, i, i])
            rows.append((c, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(said)))
    rows += rows[:5]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def odd_turns(spark):
    rows = random_turns(5)
    return rows, spark.createDataFrame(rows, TURNS).withColumn("conv", F.lit("clash")).withColumn("audit", F.lit(1)).withColumn("base", F.lit(2)).withColumn("pos", F.lit(3)).repartition(3)


def test_solve_against_all_edits():
    rng = random.Random(3)
    faults = dict(zip(("", "blank", "duplicate", "truncated"), repair.SIGNS))
    for n in range(8):
        for _ in range(25):
            rows = tuple((rng.choice("suao"), "t", rng.choice(["", "", "blank", "duplicate", "truncated"])) for _ in range(n))
            signature = "".join(faults[f]["suao".index(r)] for r, _, f in rows)
            assert repair.solve(signature) == cheapest(rows)[:2], signature
    assert repair.solve("ua" * 20_000) == (0, "K" * 40_000)  # no recursion that grows with the conversation
    assert repair.solve("") == (0, "")
    assert repair.read("su01U4") == {"blank": 2, "duplicate": 1, "truncated": 1, "illegal": 3}


def test_repair_of_odd_tables(spark, odd_turns):
    rows, df = odd_turns
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = {r.conv_id: tuple(r[n] for n in names) for r in repair.report(repair.damaged(df), df).collect()}
    assert got == plain_report(rows)
    none = spark.createDataFrame([], TURNS)
    assert repair.report(repair.damaged(none), none).count() == 0


def test_repaired_turns_are_rows(spark):
    rows = [(1, 0, "assistant", "A."), (1, 1, "assistant", "B."), (1, 2, "user", ""), (2, 0, "system", "S."), (2, 1, "user", "Q?"), (2, 2, "assistant", "R.")]
    df = spark.createDataFrame(rows, TURNS)
    found = repair.audits(repair.signatures(df))
    turns = repair.replayed(df, found).collect()
    got = {c: [(r.role, r.text, r.edit) for r in sorted(turns, key=lambda r: r.place) if r.conv == c] for c in (1, 2)}
    assert got == {1: [("user", "A.", "R"), ("assistant", "B.", "K")], 2: [("system", "S.", "K"), ("user", "Q?", "K"), ("assistant", "R.", "K")]}


def plain_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn, role or "", text or ""))
    for c in convs:
        convs[c] = [(r, t) for _, r, t in sorted(convs[c], key=lambda x: (x[0] is not None, x[0], same(x[1], x[2])))]
    whole = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c > 0 else -1)
        whole[c] = tuple(convs.get(base, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        out, todo = [], [p]
        while todo:
            x = todo.pop()
            out.append(x)
            todo += kids.get(x, [])
        return out

    return sorted(
        (
            min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), len(kids.get(p, [])), sum(not kids.get(x) for x in below(p)),
            sum((len(nodes[x]) - 1) * (len(x[-1][1]) if x else 0) for x in below(p)), sha(",".join(str(c) for c in sorted(m) if whole[c] == p)),
        )
        for p, m in nodes.items()
    )


@pytest.mark.parametrize("block", [5, 6, 256])
def test_trie_against_brute_force(spark, block):
    rng = random.Random(7)
    # families with copies in and between them, long ones, missing bases, negative ids
    rows, pool = [], [[(rng.choice(["user", "assistant"]), rng.choice("abc")) for _ in range(rng.choice([1, 2, 3, 9, 14]))] for _ in range(6)]
    for c in [*range(0, 25), *range(100, 112), *range(-130, -95), *range(305, 315), 10**15]:
        turns = rng.choice(pool)
        rows += [(c, t if rng.random() < 0.95 else None, r, x) for t, (r, x) in enumerate(turns)]
    rows += random_turns(9, 12)
    df = spark.createDataFrame(rows, TURNS).withColumn("hi", F.lit("clash")).repartition(3)
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    got = sorted(tuple(-1 if r[n] is None else r[n] for n in names) for r in trie.trie(df, block=block).collect())
    assert got == plain_trie(rows)


def test_trie_of_an_empty_table(spark):
    assert trie.trie(spark.createDataFrame([], TURNS)).count() == 0
