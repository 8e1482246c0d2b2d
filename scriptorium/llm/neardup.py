"""Near-duplicate detection on word shingles with HyperMinHash sketches.

A document's set holds its distinct runs of ``width`` words. The sketch has ``BUCKETS`` registers; each
has its own hash function over the whole set and stores, of the smallest value, the count of leading zeros
(6 bits) and the next 10 bits (mantissa). Four compressed registers fill a 64-bit band.

Equal sets (by a 128-bit digest) are collapsed first, so the rest works on *distinct* sets (nodes), whatever
the number of copies. Documents whose bands agree are candidates. With 32 bands, a pair of similarity 0.75
shares none with probability (1 - 0.75**4)**32, about 5e-6.

1. Star pass: each node is paired with the smallest node of each of its band groups: at most 32 pairs a
   node, however large the group. Pairs whose collision-corrected estimate is in reach of the threshold
   are verified on their full sets; verified pairs are links.
2. Links are joined to components.
3. Rest pass: in band groups that still hold several components, the nodes outside of the group's largest
   component are compared, sketch against sketch and in blocks, with each other and with that component;
   what may be linked gets its text and is compared in full.
So no link between two components can be missing that a shared band would show, and a large group of
near copies costs its size, not its square. Only nodes that share a band without being linked to the most
of its group are compared with each other: each such pair has to be looked at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import SPACE, Hasher, mix, ranges, spans, stream, text_bytes, tidy, windows
from .store import keyed, written

BUCKETS, ROWS, MANTISSA = 128, 4, 10
BANDS = BUCKETS // ROWS
#: Expected share of equal registers of two unrelated sets of one size, times 2**MANTISSA (published for HyperMinHash).
COLLISION = 0.169919487159739093975315012348630288992889
#: An estimate has a standard deviation of sqrt(J (1 - J) / 128), 0.038 at 0.75; candidates may lie 5 of these below.
REACH = 0.2

_FACTOR = stream(71, BUCKETS) | np.uint64(1)
_SHIFT = stream(72, BUCKETS)


def shingles(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each distinct shingle of a block, sorted. A-Z count as a-z. A text of fewer words
    has its whole sequence as one shingle; without words, none."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    start, end, doc = ranges(~SPACE[low], off)
    h = Hasher(low)(start, end)
    at, x = windows(h, doc, width, 5)
    d = doc[at]
    count = np.bincount(doc, minlength=len(off) - 1)
    first = np.cumsum(count) - count
    for n in range(1, width):
        few = np.flatnonzero(count == n)
        if len(few):
            y = np.full(len(few), n, np.uint64)
            for k in range(n):
                y = mix(y * np.uint64(0x9E3779B97F4A7C15) + h[first[few] + k])
            d, x = np.concatenate((d, few)), np.concatenate((x, y))
    order = np.lexsort((x, d))
    d, x = d[order], x[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    return d[new], x[new]


def registers(x: np.ndarray) -> np.ndarray:
    """The 128 16-bit registers of one non-empty set."""
    least = np.full(BUCKETS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(x), 512):
        y = x[i : i + 512, None] * _FACTOR + _SHIFT
        least = np.minimum(least, (y ^ (y >> np.uint64(29))).min(0) if len(y) else least)
    top = least
    zeros = np.zeros(BUCKETS, np.uint64)
    for s in (32, 16, 8, 4, 2, 1):
        small = top < (np.uint64(1) << np.uint64(64 - s))
        zeros[small] += np.uint64(s)
        top = np.where(small, top << np.uint64(s), top)
    mantissa = (top << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, less the expected chance collisions."""
    n, m = n.astype(float), m.astype(float)
    chance = COLLISION * 2.0**-MANTISSA * 4 * n * m / (n + m) ** 2
    return (equal / BUCKETS - chance) / (1 - chance)


def digest(x: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set of shingles."""
    return tuple(int(mix(x * np.uint64(f) + np.uint64(k)).sum().view(np.int64)) for k, f in ((1, 1), (2, 0xD1342543DE82EF95)))


def sketch(docs: DataFrame, key: str, text: str, width: int = 5) -> DataFrame:
    """_file and _row (see ``keyed``), _id, n_shingles, d1 and d2 (digest of the set, null for an empty one) and bands
    of each document."""

    def run(batches):
        for b in batches:
            data, off = text_bytes(b.column("_t"))
            sizes, first, second, bands = [], [], [], []
            for i, j in spans(off):
                at = off[i : j + 1] - off[i]
                d, x = shingles(data[off[i] : off[j]], at, width)
                cut = np.searchsorted(d, np.arange(j - i + 1))
                for p, q in zip(cut[:-1], cut[1:]):
                    sizes.append(q - p)
                    own = x[p:q]
                    u, v = digest(own) if q > p else (None, None)
                    first.append(u)
                    second.append(v)
                    bands.append(registers(own).view(np.int64) if q > p else None)
            columns = [*(b.column(c) for c in ("_file", "_row", "_id")), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["_file", "_row", "_id", "n_shingles", "d1", "d2", "bands"])

    docs, file, row = keyed(docs)
    rows = docs.select(file.alias("_file"), row.alias("_row"), F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("_t"))
    return rows.mapInArrow(tidy(run), "_file long, _row long, _id long, n_shingles long, d1 long, d2 long, bands array<long>")


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal registers of the rows of two arrays of bands."""
    return (np.ascontiguousarray(a).view(np.uint16) == np.ascontiguousarray(b).view(np.uint16)).sum(-1)


def _bands(column) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, BANDS)


def near_pairs(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose estimated similarity is at least ``least``."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("bands").alias(f"s_{c}"))

    def run(batches):
        for b in batches:
            n, m = (np.asarray(b.column(f"n_{c}")) for c in "ab")
            near = estimate(_equal(_bands(b.column("s_a")), _bands(b.column("s_b"))), n, m) >= least if len(n) else np.zeros(0, bool)
            keep = pa.array(near & (4 * np.minimum(n, m) >= 4 * least * np.maximum(n, m)))
            yield pa.RecordBatch.from_arrays([b.column(c).filter(keep) for c in "ab"], names=["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(tidy(run), "a long, b long")


def verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int, most: int = 512) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. ``texts``: node, t.

    The texts of all a of one b follow that of b, in parts of about ``most`` rows, so each text travels once for
    each pair, or part, that it is in, and a b with many partners is spread over many tasks."""

    def run(batches):
        held = np.zeros(0, np.uint64)
        for batch in batches:
            data, off = text_bytes(batch.column("t"))
            b, member, node = (np.asarray(batch.column(c)) for c in ("b", "member", "node"))
            keep = np.zeros(len(batch), bool)
            for i, j in spans(off):
                d, x = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], width)
                cut = np.searchsorted(d, np.arange(j - i + 1))
                for k, (p, q) in enumerate(zip(cut[:-1], cut[1:]), i):
                    own = x[p:q]
                    if not member[k]:
                        held = own.copy()
                        continue
                    less, more = (own, held) if len(own) < len(held) else (held, own)
                    both = int((more[np.minimum(np.searchsorted(more, less), len(more) - 1)] == less).sum()) if len(less) else 0
                    keep[k] = 100 * both >= percent * (len(own) + len(held) - both)
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(b[keep])], names=["a", "b"])

    hubs = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"))
    members = pairs.join(hubs, "b").select("b", F.pmod(F.xxhash64("a"), "parts").alias("p"), F.lit(1).alias("member"), F.col("a").alias("node"))
    heads = hubs.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p"), F.lit(0).alias("member"), F.col("b").alias("node"))
    rows = members.unionByName(heads).join(texts.hint("merge"), "node").select("b", "p", "member", "node", "t")
    return rows.repartition("b", "p").sortWithinPartitions("b", "p", "member").mapInArrow(tidy(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): its smallest reachable node.

    Alternates small-star and large-star steps on edges from the larger to the smaller node, until each node
    has one edge, to a node without. Only nodes with several edges take part in the join of a small-star
    step; Spark splits hot nodes in the joins. Each round is written to the shared folder."""
    edges = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    while True:
        edges = written(edges, "edges")
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not ends.agg(F.max(F.expr("up > 1 OR up = 1 AND down = 1"))).first()[0]:
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        least = edges.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("most"))
        several = least.where("m != most").select(F.col("a").alias("node"), "m")
        moved = edges.join(several, F.col("a") == F.col("node")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(least.select("a", F.col("m").alias("b")).unionByName(moved).distinct(), "small")
        below = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), "m")
        edges = edges.join(below, F.col("b") == F.col("node"), "left").select("a", F.coalesce("m", "b").alias("b")).distinct()


def _likely(t: dict[str, np.ndarray], x: int, band: int, apart: bool, least: float) -> np.ndarray:
    """The rows y of a block pair that may be linked with row x: of another component, with an estimate in reach,
    and with this band as the first that both share, so that each pair has its turn once."""
    y = np.flatnonzero((t["own"] == t["q"]) & (t["component"] != t["component"][x]) & (apart | (t["node"] > t["node"][x])))
    y = y[(t["bands"][y][:, :band] != t["bands"][x, :band]).all(1)]
    return y[estimate(_equal(t["bands"][x], t["bands"][y]), t["n_shingles"][x], t["n_shingles"][y]) >= least]


def _block(t: pa.Table) -> tuple[dict[str, np.ndarray], int, bool]:
    t = t.combine_chunks()
    own = {c: t.column(c).to_numpy() for c in ("own", "p", "q", "node", "component", "n_shingles")}
    own["bands"] = np.asarray(pa.concat_arrays(t.column("bands").chunks).flatten()).reshape(-1, BANDS)
    return own, t.column("i")[0].as_py(), own["p"][0] != own["q"][0]


_ROW = "i int, w long, p long, q long, own long, node long, component long, n_shingles long, bands array<long>"


def _dealt(rows: DataFrame, block: int, weight: int) -> DataFrame:
    """Rows (i, w, node, component, n_shingles) of band groups, dealt to the tasks (p, q) that compare them. Nodes of
    the largest component of a group, and all others, are dealt to blocks of about ``block`` rows or ``weight``
    shingles; each pair of blocks is a task, but for those of the largest component alone."""
    parts = lambda n, s: F.ceil(F.greatest(F.col(n) / block, F.col(s) / weight))
    held = rows.groupBy("i", "w", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    mixed = held.groupBy("i", "w").agg(F.max(F.struct("n", "s", "component")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    mixed = mixed.select("i", "w", F.col("top.component").alias("top"), (F.col("n") - F.col("top.n")).alias("n"), (F.col("s") - F.col("top.s")).alias("s"), F.col("top.n").alias("tn"), F.col("top.s").alias("ts"))
    mixed = mixed.select("i", "w", "top", parts("n", "s").alias("few"), parts("tn", "ts").alias("many"))
    rows = rows.join(mixed, ["i", "w"])
    in_top = F.col("component") == F.col("top")
    own = F.when(in_top, F.col("few") + F.pmod(F.xxhash64("node"), F.col("many"))).otherwise(F.pmod(F.xxhash64("node"), F.col("few")))
    others = F.sequence(F.lit(0).cast("long"), F.when(in_top, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)
    rows = rows.withColumn("own", own).withColumn("other", F.explode(others))
    return rows.select("i", "w", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "component", "n_shingles")


def rest_links(groups: DataFrame, comp: DataFrame, sets: DataFrame, texts: DataFrame, width: int, percent: int, block: int = 2048, weight: int = 1 << 20) -> DataFrame:
    """Links (a, b) between different components of band groups (``groups``: node, i, w of shared bands): enough
    of them to join all that are linked.

    Sketches tell which rows may have a link at all; only these are dealt again, to smaller blocks, and get their
    texts and are compared in full."""
    least = percent / 100 - REACH

    def hopeful(t: pa.Table) -> pa.Table:
        own, band, apart = _block(t)
        used = np.zeros(len(t), bool)
        for x in np.flatnonzero(own["own"] == own["p"]):
            y = _likely(own, x, band, apart, least)
            used[y] = True
            used[x] |= bool(len(y))
        return t.filter(pa.array(used)).select(["i", "w", "node", "component", "n_shingles"])

    def linked(t: pa.Table) -> pa.Table:
        own, band, apart = _block(t)
        data, off = text_bytes(t.column("t").combine_chunks())
        parts = [(i, *shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], width)) for i, j in spans(off)]
        doc, h = np.concatenate([i + d for i, d, _ in parts]), np.concatenate([x for _, _, x in parts])
        cut = np.searchsorted(doc, np.arange(len(off)))
        parent = {c: c for c in own["component"].tolist()}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        out_a, out_b = [], []
        for x in np.flatnonzero(own["own"] == own["p"]):
            mine = h[cut[x] : cut[x + 1]]
            for y in _likely(own, x, band, apart, least):
                c, d = root(int(own["component"][x])), root(int(own["component"][y]))
                if c == d:  # joined by others meanwhile
                    continue
                other = h[cut[y] : cut[y + 1]]
                both = int((other[np.minimum(np.searchsorted(other, mine), len(other) - 1)] == mine).sum())
                if 100 * both >= percent * (len(mine) + len(other) - both):
                    parent[max(c, d)] = min(c, d)
                    out_a.append(max(own["node"][x], own["node"][y]))
                    out_b.append(min(own["node"][x], own["node"][y]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    sketches = sets.select("node", "n_shingles", "bands")
    rows = groups.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")).join(sketches.drop("bands"), "node")
    rows = _dealt(rows.select("i", "w", "node", "component", "n_shingles"), block, 1 << 62)
    near = rows.join(sketches.drop("n_shingles"), "node").select(*[x.split()[0] for x in _ROW.split(", ")])
    near = written(near.groupBy("i", "w", "p", "q").applyInArrow(hopeful, "i int, w long, node long, component long, n_shingles long").distinct(), "near")
    last = _dealt(near, 256, weight).join(sketches.drop("n_shingles"), "node").join(texts.hint("merge"), "node")
    return last.select(*[x.split()[0] for x in _ROW.split(", ")], "t").groupBy("i", "w", "p", "q").applyInArrow(linked, "a long, b long")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """_file and _row (names of a row, see ``keyed``), _id, n_shingles, component_id (smallest id reachable) and only
    (whether the row is the one that stands for its component: with the smallest id, of rows with that id the first
    by place) of every row. An empty set is a component of its own; components are those of sets, not of ids."""
    least = percent / 100 - REACH
    rows, file, row = keyed(docs)
    base = written(sketch(rows, key, text, width), "sketch")
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "_file", "_row")).alias("first")
    sets = base.where(F.col("d1").isNotNull()).groupBy("d1", "d2").agg(first, F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    sets = written(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    bands = sets.select("node", F.posexplode("bands").alias("i", "w"))
    shared = bands.groupBy("i", "w").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub != last").drop("last")
    groups = written(bands.join(shared, ["i", "w"]), "groups")
    stars = groups.where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    close = written(near_pairs(stars, sets, least), "stars")
    # texts of the nodes that may need verifying: one document stands for each set. All these sides grow with the
    # input, so none is broadcast, however small it is now
    wanted = groups.select("node").distinct().join(sets.select("node", "first._file", "first._row"), "node")
    texts = rows.select(file.alias("_file"), row.alias("_row"), F.col(f"`{text}`").alias("t")).join(wanted.hint("merge"), ["_file", "_row"]).select("node", "t")
    texts = written(texts, "texts")
    links = written(verify(close, texts, width, percent), "verified")
    comp = components(links)
    found = written(rest_links(groups.drop("hub"), comp, sets, texts, width, percent), "rest")
    own = sets.select("d1", "d2", "node", "first").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    tops = own.groupBy("component").agg(F.min("first").alias("first"))
    if not found.isEmpty():
        # whole components are joined, so this pass has a node for each of them, not for each set
        for c in "ab":
            found = found.join(comp.select(F.col("node").alias(c), "component"), c, "left").withColumn(c, F.coalesce("component", c)).drop("component")
        roots = components(found).select(F.col("node").alias("component"), F.col("component").alias("root"))
        tops = tops.join(roots, "component", "left").withColumn("root", F.coalesce("root", "component"))
        tops = tops.select("component", "root").join(tops.groupBy("root").agg(F.min("first").alias("first")), "root").drop("root")
    named = own.select("d1", "d2", "component").join(tops, "component").select("d1", "d2", "first")
    out = base.drop("bands").join(named, ["d1", "d2"], "left")
    alone = F.col("d1").isNull()
    only = alone | ((F.col("_file") == F.col("first._file")) & (F.col("_row") == F.col("first._row")))
    return out.select("_file", "_row", "_id", "n_shingles", F.when(alone, F.col("_id")).otherwise(F.col("first._id")).alias("component_id"), only.alias("only"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """n_shingles, component_id and kept of every row: rows are linked if 100 * intersection >= percent *
    union of their sets; component_id is the smallest key reachable; kept marks the rows with that key.

    Null, empty and wordless texts have empty sets and stand alone. Null keys are allowed; a component of
    only null keys has a null component_id and keeps them. Other columns, whatever their names, are not read;
    repeated keys with different texts are separate documents."""
    out = classes(docs, key, text, width, percent)
    return out.select(F.col("_id").alias(key), "n_shingles", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component: one of each (see ``classes``). Rows are told
    apart by their place, so repeated and null keys lose no document; rows with empty sets all stay."""
    rows, file, row = keyed(docs)
    rest = classes(rows, key, text, width, percent).where("NOT only").select("_file", "_row")
    names = rows.columns
    named = rows.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)], file.alias("_file"), row.alias("_row"))
    left = named.join(rest.hint("merge"), ["_file", "_row"], "left_anti")  # grows with the input
    return left.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])
