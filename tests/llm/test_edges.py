"""Filters and likeness against plain sets, a full fit against plain Python, clashing columns and very long values."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import chat, fingerprint, langid, licenses, quality, sentencepiece_sa, store, toxicity, warc
from scriptorium.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def plain_chain(text):
    """The filters of a text as sets of bits, feature by feature."""
    data = np.frombuffer(text, np.uint8)
    _, h = fingerprint._features(data, np.array([0, len(data)]))
    out = []
    for i in range(0, len(h), fingerprint.FILL):
        out.append({(int(x) >> 11 * p) & 2047 for x in h[i : i + fingerprint.FILL] for p in range(5)})
    return out


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    key = lambda c: (len(c), b"".join(np.packbits([i in f for i in range(2048)]).tobytes() for f in c))
    a, b = sorted((a, b), key=key)
    best = []
    for x in a:
        near = []
        for y in b:
            chance = len(x) * len(y) / 2048
            near.append(min(1.0, max(0.0, (len(x & y) - chance) / max(min(len(x), len(y)) - chance, 1e-6))))
        best.append(max(near))
    return sum(best) / len(best)


def test_filters_and_likeness_against_plain_sets(spark):
    texts = [(r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").limit(25).collect()]
    texts += [b"", b"x", texts[0][: len(texts[0]) // 2], texts[1] * 3, texts[0] + texts[1]]
    found, plain = fingerprint.chains(texts), [plain_chain(t) for t in texts]
    for chain, want in zip(found, plain):
        assert [set(np.flatnonzero(np.unpackbits(f)).tolist()) for f in chain] == want
    rng = random.Random(2)
    pairs = [(i, j) for i in range(len(texts)) for j in rng.sample(range(len(texts)), 6)] + [(0, 27), (1, 28), (0, 29), (25, 25), (25, 26)]
    for i, j in pairs:
        assert abs(fingerprint.likeness(found[i], found[j]) - plain_likeness(plain[i], plain[j])) < 1e-5
        assert fingerprint.likeness(found[i], found[j]) == fingerprint.likeness(found[j], found[i])


def test_fingerprints_of_odd_rows_have_values(spark):
    rows = [(5, None), (4, ""), (3, "short"), (2, "é" * 400), (1, "word " * 50_000)]
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("mine"))).collect()}
    texts = {k: t or "" for k, t in rows}
    assert got[5].fingerprint == got[4].fingerprint == "0:" and got[5].near_next == 1.0 and got[4].near_next == 0.0
    for k, after in ((5, 4), (4, 3), (3, 2), (2, 1), (1, 5)):
        new = fingerprint.edited(texts[k], texts[after])
        assert got[k].n_chars == len(texts[k]) and got[k].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert abs(got[k].near_edited - plain_likeness(plain_chain(texts[k].encode()), plain_chain(new.encode()))) < 1e-5


def test_score_coefficients_reach_the_maximum_of_the_likelihood():
    rng = random.Random(4)
    lexicon = {"=fool": 2.0, "idio": 3.0}
    rows = [(" ".join(rng.choice(["fool", "idiot", "a", "b"] if y else ["a", "b", "c", "c", "idiotic"]) for _ in range(rng.randint(3, 30))), y) for y in (0, 1) for _ in range(60)]
    fitted = toxicity.fit(rows, lexicon)

    def loss(b):
        plain, total = toxicity.Lexicon(lexicon), 0.0
        n, toxic = len(rows), sum(y for _, y in rows)
        for t, y in rows:
            z = sum(x * w for x, w in zip(plain.features(t), b))
            weight = 0.5 / toxic if y else 0.5 / (n - toxic)
            total += n * weight * math.log1p(math.exp(-z if y else z))
        return total + 0.025 * sum(x * x for x in b)

    best = loss(fitted.coefficients)
    for i in range(3):
        for step in (-0.05, 0.05):
            moved = list(fitted.coefficients)
            moved[i] += step
            assert loss(moved) > best
    assert 0 < fitted.score(None) == fitted.score("") < 0.5 < fitted.score("you idiot fool") < 1


def test_cover_against_a_plain_greedy_pass():
    toxic = [{"=a", "ab"}, {"=a"}, {"=a", "=n"}, {"=b"}, {"=b", "=n"}, {"=b"}, {"=c"}, {"=c"}, {"=n"}, {"=both", "=b"}] * 3
    clean = Counter({"=n": 40, "=c": 0})
    got = toxicity.cover(toxic, clean, 1000, 50)
    counts = Counter(p for t in toxic for p in t)
    odds = {p: math.log((n + 0.2) / (len(toxic) + 1)) - math.log((clean[p] + 0.2) / 1001) for p, n in counts.items() if n >= 3}
    left, want = set(range(len(toxic))), {}
    while True:
        gain = {p: (sum(p in toxic[i] for i in left) - 3 * clean[p], len(p.lstrip("="))) for p, x in odds.items() if x > 2.5 and p not in want}
        p = max(gain, key=lambda p: (gain[p][0], gain[p][1], [-ord(c) for c in p]), default=None)
        if p is None or gain[p][0] < 3:
            break
        want[p] = round(odds[p], 6)
        left -= {i for i in left if p in toxic[i]}
    assert {k: got[k] for k in want} == want and "=n" not in got


def test_clashing_columns(spark):
    text = licenses.KNOWN[sorted(licenses.KNOWN)[0]]
    plain = spark.createDataFrame([(1, text), (2, "SPDX"), (3, None)], "doc_id long, text string")
    clash = plain.withColumn("license", F.lit("mine")).withColumn("notices", F.lit(1)).withColumn("digest", F.lit("d")).withColumn("t", F.lit(0))
    assert sorted(map(tuple, licenses.scan(clash).collect()), key=str) == sorted(map(tuple, licenses.scan(plain).collect()), key=str)
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a")], "page_id long, url string, html string")
    odd = pages.withColumn("top", F.lit(9)).withColumn("revisit", F.lit("x")).withColumn("copies", F.lit(0)).withColumn("payload", F.lit("y"))
    one, two = (sorted(map(tuple, warc.round_trip(p, store.new_dir(spark, "warc")).collect())) for p in (pages, odd))
    assert one == two and len(one) == 2
    docs = plain.withColumn("_stats", F.lit(1)).withColumn("_quality", F.lit(2)).withColumn("n_words", F.lit(3))
    assert quality.report(docs).count() == 3


def test_a_very_long_turn(spark):
    long = "x <turn user>\\ é\n" * 60_000
    rows = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long), (1, 1, "assistant", long), (2, 0, None, None)], "conv_id long, turn long, role string, text string").withColumn("windows", F.lit("clash"))
    read = {r.conv_id: r for r in chat.read_back(chat.windows(chat.conversations(rows))).collect()}
    assert [(t.role, t.text) for t in read[1].turns] == [("user", long), ("assistant", long), ("assistant", long)] and read[1].loss_text == long * 2
    assert [(t.role, t.text) for t in read[2].turns] == [("", "")] and read[2].loss_text == ""


def test_pieces_of_odd_rows_have_values(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    long = " ".join(f"word{i % 997}" for i in range(40_000)) + " " + "y" * 3000
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a b"), (4, "a b"), (None, "ties tie ties"), (5, long), (6, "ÄÖ 中文 😀 é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_pieces", F.lit("clash")).withColumn("t", F.lit(1))
    want = []
    for k, t in rows:
        ids = library.encode(t or "")
        back = library.decode(ids)
        want.append((k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == (t or "")))
    assert sorted(map(tuple, sentencepiece_sa.encoded(df, path).collect()), key=str) == sorted(want, key=str)


def test_verdicts_of_the_pipeline_are_those_of_its_models(spark):
    """Quality and toxicity stages against their models applied text by text, in plain Python."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    data = {r.doc_id: quality.statistics(np.frombuffer((r.text or "").encode(), np.uint8), np.array([0, len((r.text or "").encode())])) for r in rows}
    good = {k: not quality.base_failed(int(s["n_words"][0]), int(s["n_repeat_words"][0])) for k, s in data.items()}
    patterns = {k: tuple(quality.votes(s)[0]) for k, s in data.items()}
    counted = Counter(patterns[k] for k in data if good[k])
    kinds = sorted(counted)
    model = quality.fit(np.array(kinds), np.array([counted[x] for x in kinds], float))
    known = dict(zip(kinds, quality.posterior(np.array(kinds), model)))
    want = {k for k in data if good[k] and known[patterns[k]] >= 0.5}
    left = store.written(p.quality_rules(spark, docs, SF), "left")
    assert {r.doc_id for r in left.collect()} == want
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    texts = {r.doc_id: r.text for r in rows if r.doc_id in want}
    sample = sorted({(t[:12_000], int(labels[k] > 0)) for k, t in texts.items() if k in labels and t is not None})
    found = [toxicity.evidence(t) for t, y in sample if y]
    known_words, clean = set().union(*found), Counter()
    for t, y in sample:
        if not y:
            clean.update(toxicity.evidence(t) & known_words)
    lexicon = toxicity.fit(sample, toxicity.cover(found, clean, len(sample) - len(found), 2000))
    mild = {k for k, t in texts.items() if lexicon.score(t) < 0.7}
    assert {r.doc_id for r in p.toxicity_filter(spark, left, SF).collect()} == mild and mild != want


def test_rising_sequences():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 6)
        share, weight = [rng.random() for _ in range(n)], [rng.choice([0.0, 1.0, 5.0, 0.3]) for _ in range(n)]
        if not sum(weight):
            continue
        got = quality.rising(np.array(share), np.array(weight))
        assert (np.diff(got) >= -1e-12).all()
        cost = lambda x: sum(w * (a - b) ** 2 for a, b, w in zip(x, share, weight))
        for _ in range(50):
            other = np.sort(np.array([rng.random() for _ in range(n)]))
            assert cost(got) <= cost(other) + 1e-9


def test_a_record_that_is_cut_raises():
    words = warc.dictionary([])
    archive = warc.Archive(words)
    archive.add(warc.record(1, "u", b"data", warc.sha1(b"data"), None, False))
    with pytest.raises(ValueError, match="cut|frame"):
        list(warc.frames(archive.data[:-1]))


def test_many_languages_are_all_learned(spark):
    rng = random.Random(6)
    words = {f"l{k:03d}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(4)) for _ in range(12)] for k in range(90)}
    texts = {n: [" ".join(rng.choices(w, k=40)) for _ in range(4)] for n, w in words.items()}
    whole, parted = (langid.PPM(texts, 3, together=n) for n in (90, 8))
    data = "".join(rng.choice(t) for t in list(texts.values())[:20]).encode()
    off = np.array([0, 100, 100, len(data)])
    assert (whole.bits(np.frombuffer(data, np.uint8), off) == parted.bits(np.frombuffer(data, np.uint8), off)).all()
    rows = [(i, t, n) for i, (n, ts) in enumerate(texts.items()) for t in ts]
    df = spark.createDataFrame([*rows, (1, None, "l000"), (2, "x", None)], "doc_id long, text string, lang string")
    model = langid.train(df, "text", "lang", sample_chars=90 * 250)
    assert model.languages == sorted(texts)
    held = spark.createDataFrame([(n, " ".join(rng.choices(w, k=30))) for n, w in words.items()], "n string, text string")
    got = langid.identify(held, model, "text", ("n",)).collect()
    assert sum(r.n == r.lang_pred for r in got) == 90


def test_fingerprints_of_many_buckets(spark):
    """Places compare as their integers do, so texts follow each other over the ends of buckets."""
    rows = {(-1) ** i * (i * 7919) ** (1 + i % 2): f"{i} " * (i % 9) for i in range(3000)} | {-(1 << 63): "least", None: "no key"}
    order = sorted(rows, key=lambda k: (k is not None, k or 0), reverse=True)
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for k, after in zip(order, order[1:] + order[:1]):
        new = fingerprint.edited(rows[k], rows[after])
        assert (got[k].n_chars, got[k].edited_sha256) == (len(rows[k]), hashlib.sha256(new.encode()).hexdigest())
