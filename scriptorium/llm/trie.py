"""A trie of all conversations that share first turns.

Conversations are rebuilt and put together family by family (a base conversation and those of the hundred ids
around it): each family is a small trie of its own, made in one pass over arrays. Only its nodes, without texts, are dealt
again and merged. What lies below a node that one family alone has is summed up there; nodes of several
families get their sums by doubling, in as many rounds as the depth of the shared part has binary digits.

A node is named by the sum of 128-bit hashes of its turns and their depths, so names come from running sums, and a family
is cut into blocks of ``block`` turns of depth: a task holds at most a block of a family, however long
conversations are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import tidy
from .store import written

FAMILY, HISTORY = 100, 5
_LOW = (1 << 32) - 1
_NODE = (
    "base long, hi long, lo long, phi long, plo long, depth long, n_convs long, conv long, parent_conv long, chars long, n_children long, n_leaves long, saved long, "
    "crossing boolean, ends string"
)


def history(conv: Column) -> Column:
    """How many first turns of its base a conversation repeats."""
    return F.crc32(conv.cast("string")) % (HISTORY + 1)


def _lane(x: Column, which: str) -> Column:
    """The upper (0) or lower (1) 32 bits."""
    return x.bitwiseAND(F.lit(_LOW)) if which == "1" else F.shiftrightunsigned(x, 32)


def rebuilt(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = 256) -> DataFrame:
    """The turns of rebuilt conversations, without texts: base, block, conv, depth, own (a turn of the conversation itself),
    last, opens (one row of each conversation), repeats (turns taken from the base), head (the first turns of the base, to be repeated),
    chars, the names hi, lo of the node and phi, plo of its parent.

    Turns come in order, nulls first, those of one number by the digest of role and text; a null role or text is
    empty; rows without a conversation id belong to none."""
    if block < HISTORY:
        raise ValueError(f"a block has at least the {HISTORY} turns that are repeated")
    who, said = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text))
    same = F.unhex(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, said), 256))
    df = rows.select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), same.alias("same"), F.length(said).cast("long").alias("chars")).where("conv IS NOT NULL")
    df = df.withColumn("base", F.col("conv") - F.col("conv") % FAMILY)
    # one shuffle, by family; all windows below are on it
    mine, family = W.partitionBy("base", "conv"), W.partitionBy("base")
    order = mine.orderBy(F.asc_nulls_first("turn"), "same")
    df = df.repartition("base").withColumn("pos", F.row_number().over(order).cast("long"))
    head = (F.col("conv") == F.col("base")) & (F.col("pos") <= HISTORY)
    df = df.withColumn("n", F.count(F.lit(1)).over(mine)).withColumn("head", head).withColumn("lead", F.count(F.when(head, 1)).over(family))
    df = df.withColumn("h", history(F.col("conv"))).withColumn("repeats", F.least("h", "lead"))
    df = df.withColumn("own", F.col("pos") > F.col("h")).withColumn("depth", F.when(F.col("own"), F.col("pos") - F.col("h") + F.col("repeats")).otherwise(F.col("pos")))
    for i, n in ((1, "a"), (17, "b")):
        df = df.withColumn(n, F.xxhash64(F.substring("same", i, 16), "depth"))
    df = df.withColumn("heads", F.sort_array(F.collect_list(F.when(F.col("head"), F.struct("pos", "a", "b"))).over(family)))
    running = order.rowsBetween(W.unboundedPreceding, 0)
    for n in ("a0", "a1", "b0", "b1"):  # sums of 32 bits each; they would pass 63 bits after two billion turns
        lead = F.aggregate(F.slice("heads", 1, F.col("repeats").cast("int")), F.lit(0).cast("long"), lambda s, x: s + _lane(x[n[0]], n[1]))  # noqa: B023
        # of the rows not its own only the base's have a name: those that are repeated by others
        df = df.withColumn(f"_{n}", _lane(F.col(n[0]), n[1]))
        own, all_ = F.sum(F.when(F.col("own"), F.col(f"_{n}")).otherwise(0)).over(running), F.sum(f"_{n}").over(running)
        df = df.withColumn(n, F.when(F.col("own"), own + lead).otherwise(all_))
    name = lambda n, less: F.shiftleft((F.col(f"{n}0") - less(f"_{n}0")).bitwiseAND(F.lit(_LOW)), 32).bitwiseOR((F.col(f"{n}1") - less(f"_{n}1")).bitwiseAND(F.lit(_LOW)))
    none = lambda _: F.lit(0)
    return df.where("own OR head OR pos = 1").select(
        "base", F.when(F.col("own"), F.floor((F.col("depth") - 1) / block)).otherwise(0).cast("long").alias("block"), "conv", "depth", "own", (F.col("pos") == F.col("n")).alias("last"), (F.col("pos") == 1).alias("opens"),
        "repeats", (F.col("n") <= F.col("h")).alias("bare"), "head", "chars", name("a", none).alias("hi"), name("b", none).alias("lo"), name("a", F.col).alias("phi"), name("b", F.col).alias("plo"),
    )


def _family(key: tuple, own: pa.Table, head: pa.Table) -> pa.Table:
    """The nodes of one block of a family's trie. ``own``: its rows of ``rebuilt``; ``head``: first turns of the base."""
    base, block = (k.as_py() for k in key)
    get = lambda t, n: t.column(n).to_numpy()
    mine = get(own, "own").astype(bool)
    parts = [{n: get(own, n)[mine] for n in ("conv", "depth", "hi", "lo", "phi", "plo", "chars", "last")}]
    if block == 0:
        opens = get(own, "opens").astype(bool)
        conv, repeats, bare = (get(own, n)[opens] for n in ("conv", "repeats", "bare"))
        zero = np.zeros(len(conv), np.int64)
        parts.append({"conv": conv, "depth": zero, "hi": zero, "lo": zero, "phi": zero, "plo": zero, "chars": zero, "last": bare & (repeats == 0)})
        at = np.argsort(get(head, "depth"))
        for d, i in enumerate(at, 1):
            on = repeats >= d
            parts.append({"conv": conv[on], "depth": np.full(on.sum(), d)} | {n: np.full(on.sum(), get(head, n)[i]) for n in ("hi", "lo", "phi", "plo", "chars")} | {"last": bare[on] & (repeats[on] == d)})
    x = {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}
    # nodes: equal names; of each the members in order
    by = np.lexsort((x["conv"], x["lo"], x["hi"], x["depth"]))
    x = {n: v[by] for n, v in x.items()}
    new = np.ones(len(by), bool)
    new[1:] = (x["depth"][1:] != x["depth"][:-1]) | (x["hi"][1:] != x["hi"][:-1]) | (x["lo"][1:] != x["lo"][:-1])
    first, node = np.flatnonzero(new), np.cumsum(new) - 1
    n_convs = np.diff(np.append(first, len(by)))
    conv, depth, chars = x["conv"][first], x["depth"][first], x["chars"][first]
    # a member's row one turn earlier is on the parent node
    path = np.lexsort((x["depth"], x["conv"]))
    follows = x["conv"][path][1:] == x["conv"][path][:-1]
    parent = np.full(len(first), -1)
    parent[node[path[1:][follows]]] = node[path[:-1][follows]]
    inside = parent >= 0
    goes_on = np.append(~follows, True) & ~x["last"][path].astype(bool)  # the deepest row here, but not the last
    crossing = np.zeros(len(first), bool)
    crossing[node[path[goes_on]]] = True
    n_children = np.bincount(parent[inside], minlength=len(first))
    leaves, saved = (n_children == 0).astype(np.int64), (n_convs - 1) * chars
    for d in np.unique(depth)[::-1]:
        i = np.flatnonzero((depth == d) & inside)
        np.add.at(leaves, parent[i], leaves[i])
        np.add.at(saved, parent[i], saved[i])
        np.logical_or.at(crossing, parent[i], crossing[i])
    ends: list = [None] * len(first)
    for i in np.flatnonzero(x["last"].astype(bool)):
        was = ends[node[i]]
        ends[node[i]] = f"{x['conv'][i]}" if was is None else f"{was},{x['conv'][i]}"
    above = np.where(inside, conv[parent], 0)
    return pa.table({
        "base": pa.array(np.full(len(first), base), pa.int64()), "hi": x["hi"][first], "lo": x["lo"][first], "phi": x["phi"][first], "plo": x["plo"][first], "depth": depth, "n_convs": n_convs, "conv": conv,
        "parent_conv": pa.array(above, pa.int64(), mask=~inside), "chars": chars, "n_children": n_children, "n_leaves": leaves, "saved": saved, "crossing": crossing, "ends": pa.array(ends, pa.string()),
    })


def families(turns: DataFrame) -> DataFrame:
    """The nodes of each family's trie (``_NODE``), of the rows of ``rebuilt``."""
    head = turns.where("head").select("base", F.lit(0).cast("long").alias("block"), "depth", "hi", "lo", "phi", "plo", "chars")
    own = turns.where("own OR opens").drop("head")
    return own.groupBy("base", "block").cogroup(head.groupBy("base", "block")).applyInArrow(_family, _NODE)


def _digests(nodes: DataFrame) -> DataFrame:
    """hi, lo and ends_sha256 of nodes where conversations end. Families hold ids of ranges that don't overlap, so the
    families in order give the ids in order; they are hashed as they pass."""
    rows = nodes.where("ends IS NOT NULL").select("hi", "lo", "base", "ends").repartition("hi", "lo").sortWithinPartitions("hi", "lo", "base")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha, done = None, None, []
        table = lambda: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done), (pa.int64(), pa.int64(), pa.string()))], ["hi", "lo", "ends_sha256"])
        for b in batches:
            for hi, lo, _, ends in zip(*(c.to_pylist() for c in b.columns)):
                if at == (hi, lo):
                    sha.update(b"," + ends.encode())
                    continue
                if at:
                    done.append((*at, sha.hexdigest()))
                at, sha = (hi, lo), hashlib.sha256(ends.encode())
            if done:
                yield table()
                done = []
        if at:
            done.append((*at, sha.hexdigest()))
            yield table()

    return rows.mapInArrow(run, "hi long, lo long, ends_sha256 string")


def _summed(shared: DataFrame) -> DataFrame:
    """``shared`` (hi, lo, jhi, jlo: the parent, depth, n_leaves, saved of each node alone) with both summed over the nodes
    below. After round k a node has the sum of those less than 2^k below it and knows its ancestor 2^k above."""
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    k = 1
    while k <= deepest:
        up = shared.where(F.col("depth") >= k).groupBy("jhi", "jlo").agg(F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
        up = up.select(F.col("jhi").alias("hi"), F.col("jlo").alias("lo"), "l", "s")
        more = shared.join(up, ["hi", "lo"], "left").select("hi", "lo", "jhi", "jlo", "depth", (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
        if 2 * k <= deepest:
            over = shared.where(F.col("depth") >= k).select(F.col("hi").alias("jhi"), F.col("lo").alias("jlo"), F.col("jhi").alias("h"), F.col("jlo").alias("l"))
            far = more.where(F.col("depth") >= 2 * k).join(over, ["jhi", "jlo"]).select("hi", "lo", F.col("h").alias("jhi"), F.col("l").alias("jlo"), "depth", "n_leaves", "saved")
            more = far.unionByName(more.where(F.col("depth") < 2 * k))
        shared, k = written(more, "doubled"), 2 * k
    return shared


def trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = 256) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations: conv (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. The root has depth 0; a table without conversations has no node.

    A rebuilt conversation without turns ends at the root, repeated rows are turns of their own, texts of any
    length are read once; see ``rebuilt`` for nulls and ties. Other columns are not read."""
    turns = written(rebuilt(rows, conv, turn, role, text, block), "turns")
    nodes = written(families(turns), "nodes")
    one = [F.max(n).alias(n) for n in ("depth", "phi", "plo", "parent_conv", "chars", "n_children", "n_leaves", "saved", "crossing")]
    merged = nodes.groupBy("hi", "lo").agg(F.sum("n_convs").alias("n_convs"), F.min("conv").alias("conv"), F.count(F.lit(1)).alias("families"), *one)
    # below a node of one conversation or one family all is known, if the block has all of it
    single = F.col("n_convs") == 1
    merged = merged.withColumn("settled", single | ((F.col("families") == 1) & ~F.col("crossing")))
    goes_on = single & F.col("crossing")
    merged = merged.withColumn("n_children", F.when(goes_on, F.lit(1).cast("long")).otherwise(F.col("n_children"))).withColumn("n_leaves", F.when(single, 1).otherwise(F.col("n_leaves"))).withColumn("saved", F.when(single, 0).otherwise(F.col("saved")))
    merged = written(merged, "merged")
    shared = merged.where("NOT settled")
    above = shared.select(F.col("hi").alias("phi"), F.col("lo").alias("plo"), F.col("conv").alias("above"))
    below = merged.where("depth > 0").join(above, ["phi", "plo"], "left")
    parents = below.select("hi", "lo", F.coalesce("above", "parent_conv", "conv").alias("parent_conv_id"))
    given = lambda n: F.sum(F.when(F.col("settled"), F.col(n)).otherwise(0)).alias(n)
    children = below.where("above IS NOT NULL").groupBy("phi", "plo").agg(F.count(F.lit(1)).alias("c"), given("n_leaves"), given("saved"))
    children = children.select(F.col("phi").alias("hi"), F.col("plo").alias("lo"), "c", F.col("n_leaves").alias("l"), F.col("saved").alias("s"))
    own = shared.join(children, ["hi", "lo"], "left")
    own = own.select("hi", "lo", F.col("phi").alias("jhi"), F.col("plo").alias("jlo"), "depth", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("l", F.lit(1)).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars") + F.coalesce("s", F.lit(0))).alias("saved"))
    own = written(own, "shared")
    sums = _summed(own.drop("c")).select("hi", "lo", F.col("n_leaves").alias("l"), F.col("saved").alias("s")).join(own.select("hi", "lo", "c"), ["hi", "lo"])
    out = merged.select("hi", "lo", "conv", "depth", "n_convs", "n_children", "n_leaves", "saved").join(sums, ["hi", "lo"], "left").join(_digests(nodes), ["hi", "lo"], "left").join(parents, ["hi", "lo"], "left")
    empty = F.lit(hashlib.sha256().hexdigest())
    return out.select(
        F.col("conv").alias(conv), "depth", "parent_conv_id", "n_convs", F.coalesce("c", "n_children").alias("n_children"), F.coalesce("l", "n_leaves").alias("n_leaves"),
        F.coalesce("s", "saved").alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )
