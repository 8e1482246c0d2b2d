"""Operators against brute force, round trips and held-out accuracy; edge cases of every table."""

import base64
import hashlib
import math
import os
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from scriptorium.llm import chat, fingerprint, langid, licenses, neardup, packing, quality, sentencepiece_sa, store, toxicity, warc
from scriptorium.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def odd_rows():
    """Nulls, empty and long texts, repeated rows and ids."""
    long = " ".join(f"word{i % 997}" for i in range(60_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n ", "en", "s", 3), (4, "a b c", "en", "s", 5), (4, "a b c", "en", "s", 5), (5, long, "en", "s", len(long))]
    return [*rows, (6, long + " x", None, "s", 1), (None, "null id text one two three", "en", "s", 1), (7, "ÄÖ 中文 😀 é", "de", "s", 9), (8, "12 34 !!", "en", "s", 8)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).withColumn("_t", F.lit("clash")).withColumn("score", F.lit("clash")).withColumn("node", F.lit(1)).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert langid.identify(none, langid.train(none, "text", "lang"), "text", ("doc_id",)).count() == 0
    assert fingerprint.fingerprints(none).count() == 0
    assert toxicity.score(none, toxicity.train(none.withColumn("toxic", F.lit(1)))).count() == 0
    assert neardup.near_duplicates(none).count() == 0
    assert quality.report(none).count() == quality.accepted(none).count() == 0
    assert neardup.deduplicated(none).count() == 0
    assert licenses.scan(none).count() == 0
    path = tokenizer_path("word_bpe_49k.json")
    assert packing.packed(store.written(packing.pieces(none, path), "p")).count() == 0
    assert sentencepiece_sa.encoded(none, tokenizer_path("piece_bpe_32k.model")).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string"), store.new_dir(spark, "w")).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.windows(chat.conversations(turns))).count() == 0


def test_ppm_against_a_plain_model(spark, docs, odd):
    model = langid.PPM({"a": ["abracadabra", "abc"], "b": ["the cat", "that"]}, 2)
    counts = {n: Counter() for n in "ab"}
    for n, ts in (("a", ["abracadabra", "abc"]), ("b", ["the cat", "that"])):
        for t in ts:
            for i in range(len(t)):
                for k in range(3):
                    if i >= k:
                        counts[n][t[i - k : i], t[i]] += 1

    def cost(n, context, c):
        seen = {s: v for (ctx, s), v in counts[n].items() if ctx == context}
        if c in seen:
            return round(-math.log2(seen[c] / (sum(seen.values()) + len(seen))) * langid.UNIT)
        escape = round(-math.log2(len(seen) / (sum(seen.values()) + len(seen))) * langid.UNIT) if seen else 0
        return escape + (cost(n, context[1:], c) if context else 8 * langid.UNIT)

    for text in ("abra", "cathat", "xyz", "a"):
        want = [sum(cost(n, text[max(0, i - 2) : i], c) for i, c in enumerate(text)) for n in "ab"]
        assert model.bits(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])).tolist() == [want]
    out = langid.held_out("doc_id", 5, 0)
    fitted = langid.train(docs.where(~out), "text", "lang")
    rows = langid.identify(docs, fitted, "text", ("doc_id", "lang")).where(out).collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    got = {r.doc_id: r for r in langid.identify(odd, fitted, "text", ("doc_id",)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 8)] == ["und"] * 4 and got[7].lang_pred in fitted.languages
    clash = odd.withColumn("_text", F.lit("mine")).withColumn("lang_pred", F.lit("mine")).withColumn("_0", F.lit(1))
    rows = langid.identify(clash, fitted, "text", ("doc_id", "score", "lang_pred", "_text", "_0")).collect()
    assert len(rows) == len(odd_rows()) and {(r.score_in, r.lang_pred_in, r._text, r._0) for r in rows} == {("clash", "mine", "mine", 1)}
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id == 4}) == 1
    tie = langid.PPM({"b": ["same text"], "a": ["same text"]})
    assert {(r.lang_pred, r.score) for r in langid.identify(odd.where("doc_id = 4"), tie).collect()} == {("a", 0.5)}
    # a text copied any number of times is one sample text, and long texts are cut, not left out
    many = spark.createDataFrame([("copied words", "x")] * 300 + [(f"other {i}", "x") for i in range(5)] + [("long " * 9000, "y")], "text string, lang string")
    few = langid.train(many, "text", "lang", docs_per_language=6)
    assert few.languages == ["x", "y"]


def test_fingerprints(spark, docs, odd):
    rows = sorted(fingerprint.fingerprints(docs).collect(), key=lambda r: -r.doc_id)
    texts = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(texts, reverse=True)
    assert [r.doc_id for r in rows] == order
    for r, i, j in zip(rows, order, order[1:] + order[:1]):
        new = fingerprint.edited(texts[i], texts[j])
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        a, b, c = fingerprint.chains([texts[i].encode(), new.encode(), texts[j].encode()])
        assert r.fingerprint == fingerprint.to_text(a) and r.edited_fingerprint == fingerprint.to_text(b)
        assert (r.near_edited, r.near_next) == (fingerprint.likeness(a, b), fingerprint.likeness(a, c))
        assert (fingerprint.from_text(r.fingerprint) == a).all()
    full = [r for r in rows if r.n_chars > 300]
    assert np.mean([r.near_edited for r in full]) > np.mean([r.near_next for r in full]) + 0.4
    assert fingerprint.fingerprints(docs).select("fingerprint").where("near_edited < 0 OR near_edited > 1").count() == 0
    assert fingerprint.fingerprints(odd).count() == len(odd_rows())
    assert fingerprint.likeness(*fingerprint.chains([b"", b""])) == 1.0
    # no step at any length: one more character hardly changes a fingerprint
    text = (b"The quick brown fox jumps over the lazy dog while 25 violins play a slow tune in G. " * 3)[:230]
    for n in range(120, 230):
        assert fingerprint.likeness(*fingerprint.chains([text[:n], text[: n + 1]])) > 0.6
    same = [(7, f"text {i} of one key") for i in range(50)] + [(None, f"none {i}") for i in range(50)] + [(i, f"row {i}") for i in range(3000, 3100)]
    rows = fingerprint.fingerprints(spark.createDataFrame(same, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in rows) == sorted((k or -1, len(t)) for k, t in same)


def brute_features(data):
    """Selected windows by the definition, run by run."""
    w, run = fingerprint.WIDTH, fingerprint.RUN
    n = len(data) - w + 1
    if n < 1:
        return []

    def rank(i):
        total = sum(int(fingerprint._F[c]) for c in Counter(data[i : i + w]).values())
        scaled = int(np.log2(w) * 1024) - total // w
        return 16 * 1024 if scaled < 1024 else 8 * 1024 - abs(scaled - int(3.2 * 1024))

    ranks, times = [rank(i) for i in range(n)], Counter()
    for first in range(1 - run, n):
        own = [i for i in range(first, first + run) if 0 <= i < n]
        times[min(own, key=lambda i: (ranks[i], i))] += 1
    return [i for i in range(n) if times[i] >= fingerprint.POPULAR]


def test_fingerprint_features_against_brute_force(docs):
    texts = [t for r in docs.limit(20).collect() if (t := (r.text or "").encode()[:600])] + [b"aaaa" * 20, b"0123456789abcdef", b"0123456789abcde"]
    off = np.cumsum([0, *map(len, texts)])
    doc, h = fingerprint._features(np.frombuffer(b"".join(texts), np.uint8), off)
    for i, t in enumerate(texts):
        want = [t[p : p + 16] for p in brute_features(t)] or [t]
        hashes = fingerprint.Hasher(np.frombuffer(t, np.uint8))
        at = [t.find(x) for x in dict.fromkeys(want)]
        assert h[doc == i].tolist() == hashes(np.array(at), np.array([p + len(x) for p, x in zip(at, dict.fromkeys(want))])).tolist()


def test_toxicity(spark, odd):
    lex = toxicity.Lexicon({"=idiot": 5.0, "lowei": 4.0}, ("idiot savant",), (-3.0, 2.0, 1.0))
    assert lex.matched(toxicity.fold("You 1D10T, lOwEiXy")) == (9.0, 2)
    assert lex.matched(toxicity.fold("idiots slowei; an idiot savant")) == (0.0, 0)
    assert lex.matched(toxicity.fold("іdіоt")) == (5.0, 1)
    assert lex.score(None) == lex.score("") < 0.1 < 0.7 < lex.score("an idiot")
    assert toxicity.score(odd, lex).count() == len(odd_rows())
    clean = [f"the quiet river number{i} runs past stone houses and old mills" for i in range(400)]
    texts = [(i, t, 0) for i, t in enumerate(clean)] + [(1000 + i, f"{t} you br41nl\u0435ss fool{i % 7} of the {i}", 1) for i, t in enumerate(clean[:200])]
    rows = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    out = langid.held_out("doc_id", 3, 1)
    fitted = toxicity.train(toxicity.labelled(rows.drop("toxic"), rows.where(~out).drop("text")))
    held = toxicity.score(rows, fitted).where(out).collect()
    assert len(held) > 100 and all((r._score >= 0.7) == (r.toxic == 1) for r in held)
    assert toxicity.score(rows.limit(1).withColumn("_score", F.lit("mine")), fitted).first()._score < 0.7
    assert {r.score for r in toxicity.mild(odd, fitted).collect()} == {"clash"}


def brute_matched(patterns, exceptions, text):
    """Every word beginning of the folded text against every pattern, without an automaton."""
    low, hits, spared = toxicity.fold(text), {}, []
    for m in re.finditer(r"(?<![^\W_])(?=[^\W_])", low):
        at = m.start()
        for p, w in patterns.items():
            word = p.lstrip("=")
            end = at + len(word)
            if low.startswith(word, at) and (p[0] != "=" or end == len(low) or not low[end].isalnum()):
                hits[at] = max(w, hits.get(at, 0.0))
        spared += [(at, at + len(x)) for x in exceptions if low.startswith(x, at) and (at + len(x) == len(low) or not low[at + len(x)].isalnum())]
    kept = [w for at, w in hits.items() if not any(a <= at < b for a, b in spared)]
    return math.fsum(kept), len(kept)


def test_toxicity_against_plain_matching(docs):
    rng = random.Random(4)
    texts = [r.text or "" for r in docs.limit(60).collect()] + ["".join(rng.choice("abсi1@ .-") for _ in range(80)) for _ in range(300)]
    patterns = {"=th": 1.0, "the": 2.0, "=and": 1.5, "an": 0.5, "ab": 3.0, "=ai": 4.0, "a": 0.25, "ii": 1.0, "=ab": 5.0}
    exceptions = ("the and", "ab a")
    lex = toxicity.Lexicon(patterns, exceptions)
    for t in texts:
        assert lex.matched(toxicity.fold(t)) == brute_matched(patterns, exceptions, t)


def test_warc_round_trip_and_faults(spark):
    pages = spark.createDataFrame([(1, "u", "same"), (2, "u", "same"), (3, None, None), (4, "u", ""), (None, "u", "same"), (5, "u\r\nX: y", "é" * 5000), (6, "u", "x"), (6, "u", "x")], "page_id long, url string, html string").withColumn("digest", F.lit("mine")).withColumn("size", F.lit("mine"))
    long = spark.createDataFrame([(9, "u", "<p>long é</p>" * 200_000)], "page_id long, url string, html string")
    one = warc.round_trip(long, store.new_dir(spark, "warc")).first()
    assert (one.payload_bytes, one.record_type) == (14 * 200_000, "response")
    got = sorted(warc.round_trip(pages, store.new_dir(spark, "warc")).collect(), key=lambda r: (r.page_id is None, r.page_id))
    assert [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got] == [
        (1, 4, "revisit", 2), (2, 4, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 10_000, "response", None), (6, 1, "response", None), (6, 1, "response", None), (None, 4, "revisit", 2),
    ]
    assert got[0].payload_digest == base64.b32encode(hashlib.sha1(b"same").digest()).decode()
    words = warc.dictionary([])
    archive = warc.Archive(words)
    good = warc.record(1, "u", b"data", warc.sha1(b"data"), None, False)
    archive.add(good)
    archive.add(good)
    assert list(warc.frames(archive.data)) == [good, good]
    with pytest.raises(ValueError):
        list(warc.frames(archive.data[:-3]))
    with pytest.raises(ValueError):
        list(warc.frames(archive.data + b"rubbish!!"))
    for bad in (good[:-5] + good[-4:], good.replace(b"Content-Length: ", b"Content-Length: 9", 1), b"WARC/1.1\r\nX\r\n\r\n", good.replace(b"data", b"date")):
        with pytest.raises(ValueError):
            warc.page(*warc.parse(bad))


def test_frames_of_a_full_archive_and_of_every_kind_of_block():
    rng = random.Random(1)
    words = [f"w{i} " for i in range(5000)]
    records = [warc.record(i, "u", "".join(rng.choices(words, k=450)).encode(), "A" * 32, None, False) for i in range(500)]
    archive, n = warc.Archive(warc.dictionary(records[:100])), 0
    while archive.size < warc.ROLL:
        archive.add(records[n % 500])
        n += 1
    assert sum(f == records[i % 500] for i, f in enumerate(warc.frames(archive.data))) == n > 80_000
    # raw, repeated and compressed blocks, more than one a frame, without size, checksum or dictionary, a skippable frame between
    bodies = [b"", rng.randbytes(300_000), bytes(700_000), b"text " * 90_000]
    kinds = [{"write_checksum": c, "write_content_size": z} for c in (False, True) for z in (False, True)]
    frames = [zstandard.ZstdCompressor(**k).compress(b) for k in kinds for b in bodies]
    data = struct.pack("<II", 0x184D2A53, 5) + b"12345"
    assert list(warc.frames(data.join([b"", *frames]))) == bodies * 4
    small = warc.Archive(warc.dictionary([]))
    small.add(records[0])
    head = len(warc.Archive(warc.dictionary([])).data)
    for cut in range(head + 1, len(small.data)):
        with pytest.raises(ValueError):
            list(warc.frames(small.data[:cut]))


def test_sentencepiece_equals_the_library(docs, odd):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model, library = sentencepiece_sa.Model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [r.text or "" for r in docs.collect()] + [r[1] or "" for r in odd_rows()] + ["▁▁ x", "a\0b", "<s> 😀"]
    got = [np.frombuffer(x, "<u4").tolist() for x in model.encode(texts)]
    assert got == library.encode(texts)
    assert [model.decode(np.array(x, "<u4").tobytes()) for x in got] == library.decode(got)
    assert sentencepiece_sa.encoded(odd, path).count() == len(odd_rows())


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingle_set(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets, parent = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return [(len(s), least.get(root(i))) for i, s in enumerate(sets)]


def test_near_duplicates_equal_brute_force(spark, docs, odd):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    near = [" ".join(w if rng.random() > 0.03 * (k % 4) else f"n{rng.random()}" for w in base) for k in range(60)]
    rows = [(1000 + i, t) for i, t in enumerate(near)] + [(r.doc_id, r.text) for r in docs.collect()] + [(2000, "one two"), (2001, "One  TWO"), (2002, None)]
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    for (k, _), (size, comp) in zip(rows, brute_components(rows)):
        assert (got[k].n_shingles, got[k].component_id, got[k].kept) == (size, comp, k == comp)
    kept = neardup.deduplicated(spark.createDataFrame([(1, "a", "x"), (4, "a", "x"), (4, "b", "y"), (None, "a", "z"), (None, "c", "z"), (5, "", "e"), (5, "", "e")], "doc_id long, text string, node string"))
    assert sorted((str(r.doc_id), r.text, r.node) for r in kept.collect()) == [("1", "a", "x"), ("4", "b", "y"), ("5", "", "e"), ("5", "", "e"), ("None", "c", "z")]
    left = neardup.deduplicated(odd).collect()
    assert len(left) == 3 + len({c for n, c in brute_components([(r[0], r[1]) for r in odd_rows()]) if n and c is not None}) + 1
    got = neardup.near_duplicates(odd).collect()
    want = brute_components([(r[0], r[1]) for r in odd_rows()])
    assert sorted((r.n_shingles, str(r.component_id)) for r in got) == sorted((n, str(c)) for n, c in want)


def test_sentencepiece_of_words_around_the_short_limit():
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    rng, plain = random.Random(8), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["".join(rng.choice("abcdeé中😀ß01.!") for _ in range(n)) for n in (0, 1, 5, 20, 30, 59, 60, 61, 62, 90, 400)] + ["a" * n for n in range(55, 70)]
    model = sentencepiece_sa.Model(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in model.encode(texts)] == [plain.encode(t) for t in texts]


def test_components_of_any_graph(spark):
    rng = random.Random(5)
    star = [(0, k) for k in range(1, 40)]
    path = [(100 + k, 101 + k) for k in range(33)]
    loose = [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)]
    for pairs in ([], [(7, 7)], star, path, star + path + loose + loose[:9]):
        parent = {x: x for p in pairs if p[0] != p[1] for x in p}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            if a != b:
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        got = neardup.components(spark.createDataFrame(pairs, "a long, b long").repartition(3)).collect()
        assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in parent)


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(30):
        x = rng.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = x[:340], np.concatenate((x[:300], x[340:]))
        equal = (neardup.registers(a) == neardup.registers(b)).sum()
        errors.append(neardup.estimate(np.array(equal), np.array(340), np.array(360)) - 300 / 400)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def test_licenses(spark, odd):
    text = "MIT Licence\n\nCopyright (c) 2020 Foo\n\n" + licenses.KNOWN["MIT"].upper().replace(",", " ,")
    rows = spark.createDataFrame([(1, text), (2, text + " more"), (3, None), (4, "x\nReleased under the MIT License!\ny")], "doc_id long, text string")
    got = {r.doc_id: (r.license, r.notices) for r in licenses.scan(rows).collect()}
    assert got == {1: ("MIT", ""), 2: (None, ""), 3: (None, ""), 4: (None, "MIT-notice")}
    assert sorted(str(r.doc_id) for r in licenses.scan(odd).where("license IS NULL AND notices = ''").collect()) == sorted(str(r[0]) for r in odd_rows())
    twice = spark.createDataFrame([("licence licence non infringement",)], "t string").select(licenses.canonical(F.col("t"))).first()[0]
    assert twice == "license license noninfringement"
    assert licenses._plain("Licence licence.") == "license license"


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="needs published licence texts")
def test_whole_licences(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = []
    for i, name in enumerate(names):
        with open(f"/usr/share/common-licenses/{name}", errors="replace") as f:
            text = f.read()
        rows += [(i, text), (100 + i, "Copyright (c) 2021 Someone\n" + text.upper().replace("\n", "\r\n ")), (200 + i, text + " and more"), (300 + i, " ".join(text.split()[5:]))]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, license in enumerate(names.values()):
        assert (got[i], got[100 + i], got[200 + i], got[300 + i]) == (license, license, None, None)


def brute_statistics(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def brute_rising(share, weight):
    """The best rising sequence by the min-max formula."""
    n = len(share)
    mean = lambda a, b: sum(share[i] * weight[i] for i in range(a, b + 1)) / max(1e-12, sum(weight[a : b + 1]))
    return [max(min(mean(a, b) for b in range(k, n)) for a in range(k + 1)) for k in range(n)]


def brute_em(rows, rounds=500):
    """The quality model, row by row."""
    n, k = len(rows), len(rows[0])
    good = [1 - min(0.98, max(0.02, (sum(r) / max(1, sum(v > 0 for v in r)) - 1) / 4)) for r in rows]
    for _ in range(rounds):
        table = [[[0.0] * 6 for _ in range(k)] for _ in range(2)]
        for r, g in zip(rows, good):
            for j, v in enumerate(r):
                table[0][j][v] += 1 - g
                table[1][j][v] += g
        for j in range(k):
            seen = [table[0][j][v] + table[1][j][v] for v in range(1, 6)]
            share = brute_rising([table[0][j][v] / max(1e-12, seen[v - 1]) for v in range(1, 6)], seen)
            for v in range(1, 6):
                table[0][j][v], table[1][j][v] = seen[v - 1] * share[v - 1], seen[v - 1] * (1 - share[v - 1])
            for c in range(2):
                total = sum(table[c][j])
                table[c][j] = [(x + 0.1) / (total + 0.6) for x in table[c][j]]
        prior = (sum(good) + 0.5) / (n + 1)
        new = []
        for r in rows:
            p = [1 - prior, prior]
            for c in range(2):
                for j, v in enumerate(r):
                    p[c] *= table[c][j][v] if v else 1.0
            new.append(round(p[1] / (p[0] + p[1]), 6))
        if max(abs(a - b) for a, b in zip(new, good)) < 1e-9:
            break
        good = new
    return good


def test_quality_model_against_brute_force():
    rng = random.Random(6)
    for bad_share in (0.3, 0.05):
        rows = []
        for _ in range(300):
            odds = (1, 1, 2, 3, 5, 8) if rng.random() < bad_share else (1, 9, 4, 2, 1, 0.2)
            rows.append(tuple(rng.choices(range(6), odds)[0] for _ in quality.RULES))
        kinds = sorted(Counter(rows).items())
        patterns = np.array([p for p, _ in kinds])
        model = quality.fit(patterns, np.array([c for _, c in kinds], float))
        found = dict(zip([p for p, _ in kinds], quality.posterior(patterns, model)))
        assert all(abs(found[r] - g) < 1e-4 for r, g in zip(rows, brute_em(rows)))
        # a worse grade is never evidence of better quality
        ratio = np.log(model["table"][0]) - np.log(model["table"][1])
        counts = np.array([[sum(c for p, c in kinds if p[j] == v) for v in range(1, 6)] for j in range(len(quality.RULES))])
        assert all((np.diff(ratio[j, 1:][counts[j] > 5]) > -0.5).all() for j in range(len(quality.RULES)))


def test_quality(spark, docs, odd):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = quality.report(docs).collect()
    for r in got:
        assert tuple(r[k] for k in quality.STATS[:5]) == brute_statistics(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.quality >= 0.5)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = {r.doc_id: r.kept for r in got}
    rows = [r for r in labels.collect() if r.doc_id in judged]
    assert np.mean([judged[r.doc_id] for r in rows if r.quality == 1]) > 0.9 and np.mean([judged[r.doc_id] for r in rows if r.quality == 0]) < 0.1
    assert sorted(tuple(r[k] for k in quality.STATS[:5]) for r in quality.report(odd).collect()) == sorted(brute_statistics(r[1]) for r in odd_rows())
    mine = docs.withColumn("quality", F.lit("mine")).withColumn("kept", F.lit(1)).withColumn("_stats", F.lit(2)).withColumn("_0", F.lit(3))
    left = quality.accepted(mine)
    assert left.columns == mine.columns and {(r.quality, r.kept, r._stats, r._0) for r in left.collect()} == {("mine", 1, 2, 3)}
    assert left.count() == sum(r.kept for r in got)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_differ_are_told_apart(spark):
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    rows = spark.createDataFrame([(1, f"{one}\n{other}"), (2, one), (3, other), (4, " ".join([one] * 30)), (5, " ".join([other] * 30))], "doc_id long, text string")
    assert quality.report(rows).where("doc_id = 1").first().n_dup_lines == 0
    assert all(r.kept for r in neardup.near_duplicates(rows).collect())


def test_chat_reads_back(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 0, "system", "be <kind> \\l"), *[(1, i, ("assistant", "user")[i % 2], f"turn {i} " + "w " * (40 * i)) for i in range(1, 12)], (2, 0, None, None), (2, 0, "assistant", ""), (3, 5, "assistant", "only"), (4, 0, "us>er", "hi > \\g"), (4, 1, "assistant", "\\g>" * 3), (5, 0, "user", "long " * 40_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("x")).withColumn("windows", F.lit(1))
    shown = chat.windows(chat.conversations(df), budget=300)
    got = {r.conv_id: r for r in chat.digests(chat.read_back(shown)).collect()}
    for k in {r[0] for r in rows}:
        own = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == k)
        loss = "".join(t for _, role, t in own if role == "assistant")
        all_ = "".join(f"{role}\n{t}\n" for _, role, t in own)
        assert (got[k].n_turns, got[k].turns_sha256) == (len(own), hashlib.sha256(all_.encode()).hexdigest())
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    windows = shown.where("conv_id = 1").first().windows
    assert len(windows) > 3 and all(w.text.startswith("<turn system>") for w in windows) and any(w.repeated > 1 for w in windows)


def test_packing(spark, docs, odd):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    whole, encode = Tokenizer.from_file(path), packing.Encoder(path)
    texts = [r.text or "" for r in docs.collect()] + [r[1] or "" for r in odd_rows()] + ["a\x1cb", "<|endoftext|>x", "é ﬁ ΣΑΣ İ"]
    assert encode.many(texts) == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for table in (docs, odd):
        cut = store.written(packing.pieces(table, path), "pieces")
        got = packing.packed(cut).collect()
        assert len(got) == cut.count()
        ids = {}
        for r in table.collect():
            x = np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
            want = [(k, at, len(x[at : at + 4096]), zlib.crc32(x[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(x), 4096))]
            ids.setdefault(r.doc_id, []).extend(want)
        own = {}
        for r in got:
            own.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        assert {k: sorted(v) for k, v in own.items()} == {k: sorted(v) for k, v in ids.items()}
        bins = {}
        for r in got:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= 4096
        assert len(bins) <= -(-sum(r.length for r in got) // 4096) + 2
    sizes = np.random.default_rng(2).integers(1200, 2900, 400)
    b = packing.pack(sizes, 4096)
    assert np.bincount(b, sizes).max() <= 4096 and b.max() + 1 < len(set(packing._best_fit(sizes, 4096)))
    sizes = np.random.default_rng(2).integers(300, 1400, 1500)
    b = packing.pack(sizes, 4096)  # the search reaches the bound, which the start and best fit decreasing miss
    assert np.bincount(b, sizes).max() <= 4096 and b.max() + 1 == -(-sizes.sum() // 4096) < len(set(packing._best_fit(np.sort(sizes)[::-1], 4096)))


def test_pipeline_equals_its_operators(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in p.STAGES[:-1]:
        kept = store.written(stage(spark, kept, SF), name)
        assert kept.columns == docs.columns
    rows = sorted((r.doc_id, r.text) for r in kept.collect())
    comps = brute_components(rows)
    assert all(k == c for (k, _), (_, c) in zip(rows, comps))
    assert {r.doc_id for r in p.run(spark, SF).collect()} == {k for k, _ in rows}
    stats = [brute_statistics(t) for _, t in rows]
    assert all(n >= 20 and 100 * again <= 30 * n for n, _, _, _, again in stats)


def test_pipeline_stages_on_odd_tables(spark, odd, tmp_path):
    import corpus_pipeline as p

    sf = str(tmp_path)
    good = " ".join(f"w{i}" for i in range(60))
    rows = [*odd_rows(), (20, good, "en", "s", 1), (20, good + " other end", "en", "s", 1), (20, good + "!", "de", "t", 1), (None, good, "en", "s", 1), (21, " ".join(f"v{i}" for i in range(40)), None, None, None), (22, "fool " * 3 + " ".join(f"u{i}" for i in range(40)), "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    for c in ("quality", "kept", "_score", "_stats", "_file", "node", "component_id", "sequence_id"):
        docs = docs.withColumn(c, F.lit("mine"))
    labels = spark.createDataFrame([(22, 0, 1), (21, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for table in (docs, docs.limit(0)):
        labels.write.mode("overwrite").parquet(f"{sf}/labels.parquet")
        left = table
        for name, stage in p.STAGES[:-1]:
            left = store.written(stage(spark, left, sf), name)
            assert left.columns == docs.columns and left.where("quality <> 'mine' OR node <> 'mine'").count() == 0
        kept = sorted((str(r.doc_id), r.text) for r in left.collect())
        texts = [t for _, t in kept]
        if table is docs:
            want = brute_components([(k, t) for k, (_, t) in enumerate(kept)])
            assert len({c for _, c in want}) == len(kept)  # no near copies left
            assert sum(t.startswith(good) for t in texts) == 1 and any(t.startswith("v0") for t in texts)  # and no text without its like
        last = p.STAGES[-1][1](spark, left, sf).collect()
        assert sorted(str(r.doc_id) for r in last if r.piece == 0) == [k for k, _ in kept]


def test_oracles_agree(spark):
    import duckdb

    from scriptorium.llm import oracles, queries

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    for name, sql in oracles.oracle_sql().items():
        got = queries.queries()[name](spark, folder)
        columns = sorted(got.columns)
        want = con.sql(sql)
        assert sorted(want.columns) == columns, name
        assert sorted(map(repr, want.select(*columns).fetchall())) == sorted(repr(tuple(r)) for r in got.select(*columns).collect()), name


def test_ids_of_units_are_those_of_the_whole_text():
    """Letters of late Unicode versions, composed forms and marks of turns inside words, many in a block."""
    encode = packing.Encoder(tokenizer_path("word_bpe_49k.json"))
    texts = [t for c in (*range(0x80, 0x2100), *range(0xA700, 0xA800), *range(0x10D40, 0x10D90)) for t in (f"ab{chr(c)}cd", f"1{chr(c)}2!{chr(c)}?", f"it{chr(c)}'s")]
    texts += ["J̌ H̱x", "é<|ENDOFTEXT|>", "é<|endoftext|>'LL", "a\x85b\xa0c d", "İ'RE ŉ\x1cx"]
    for i in range(0, len(texts), 256):
        part = texts[i : i + 256]
        assert encode.many(part) == [encode._whole(t) for t in part]
