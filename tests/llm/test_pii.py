"""Personal data and revealing words against plain Python; odd texts and tables."""

import hashlib
import math
import random
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from scriptorium.llm import pii

DOCS = "doc_id long, text string"
FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"\p{N}*\p{L}[\p{L}\p{N}]*"


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, form in FORMS.items():
        for m in regex.finditer(form, text):
            digits = regex.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}
            if ok[kind]:
                out.append((kind, m.start(), m.end(), m[0].lower() if kind == "email" else m[0] if kind == "ip" else digits))
    return out


def words(text):
    return [w.lower() for w in regex.findall(WORD, regex.sub(FORMS["email"], " ", text))]


def plain(rows, threshold=0.9, support=3, width=120):
    """spans of (doc_id, text), and the words that reveal with whether their initial may stay."""
    n_t, windows, near = Counter(), {}, Counter()
    for _, text in rows:
        n_t.update(words(text or ""))
        found, own = base_spans(text or ""), [*words(text or ""), "", ""]
        sketch = min((hashlib.md5(" ".join(x).encode()).hexdigest() for x in zip(own, own[1:], own[2:])), default="")
        for kind in FORMS:
            # neighbours of a kind cut windows, cards that fail and have 16 digits too
            every = [m.span() for m in regex.finditer(FORMS[kind], text or "") if kind != "card" or len(regex.sub("[^0-9]", "", m[0])) >= 16]
            for k, a, b, value in found:
                if k != kind:
                    continue
                i = every.index((a, b))
                before = text[every[i - 1][1] if i else 0 : a]
                after = text[b : every[i + 1][0] if i + 1 < len(every) else len(text)]
                left = regex.sub(r"^[\p{L}\p{N}]+", "", before[-width:]) if len(before) > width else before
                right = regex.sub(r"[\p{L}\p{N}]+$", "", after[:width]) if len(after) > width else after
                for w in words(left) + words(right):
                    near[kind, value, w] += 1
                    windows.setdefault((kind, value, w), Counter())[sketch] += 1
    total, n_c, n_cg, n_g, told = sum(n_t.values()), Counter(), Counter(), Counter(), {}
    for (kind, value, w), n in near.items():
        n_c[kind, value] += n
        n_cg[kind, value, w[0]] += n
    for w, n in n_t.items():
        n_g[w[0]] += n

    def tells(both, c, alone):
        return math.log2(min(both, alone) * total / (c * alone)) >= threshold * math.log2(total / c)

    for (kind, value, w), n in near.items():
        if n * n / sum(x * x for x in windows[kind, value, w].values()) >= support and tells(n, n_c[kind, value], n_t[w]):
            told[w] = told.get(w, True) and not tells(n_cg[kind, value, w[0]], n_c[kind, value], n_g[w[0]])
    out = []
    for doc, text in rows:
        spans = base_spans(text or "")
        terms = [("term", m.start(), m.end()) for m in regex.finditer(WORD, text or "") if m[0].lower() in told and not any(a < m.end() and m.start() < b for _, a, b, _ in spans)]
        out.append((str(doc), ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in [*spans, *terms]), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans).encode()).hexdigest(), len(terms)))
    return sorted(out), told


def corpus():
    rng = random.Random(11)
    common = ["the", "and", "zone", "zero", "zoo", "Alpha", "beta", "über", "中文", "naïve", "x9", "42", "of"]
    said = lambda n: " ".join(rng.choice(common) for _ in range(n))
    rows = [(i, f"{said(9)} Zorblatt {said(2)} Mail: z.b@firm.example.org, {said(30)}") for i in range(6)]
    rows += [(10 + i, f"{said(5)} call Quixley on +44 (020) 555-1000 {said(8)} or quixley!") for i in range(8)]
    rows += [(20 + i, f"Copies {i // 6} of onetext name Hapax at 10.0.0.7 always {i // 5}") for i in range(7)]  # copies with edits
    rows += [(30 + i, said(200)) for i in range(60)]
    rows += [(100, "Zorblatt was seen elsewhere; ZORBLATT."), (101, "zorblatt@firm.example.org is an address")]
    odd = [
        None, "", " ", "@", "a@b", "a@b.c", "a@b.c_d@e.fg", "x@y.z.q@w.e", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.255", "0001.02.3.4", "99999999999999999999.1.1.1", "4111 1111-1111 1111 and 4111111111111112",
        "12 34  56", "+1 (017) 555-7713. +", "+1-------9", "++49 30 901820", "tel:+4930901820x", "😀 é a.b@c.de 中 4111111111111111", "1" * 5000, "a" * 50_000, "a.b@c" + ".d" * 20_000, "5 " * 20_000, "x@y.zz " * 700, "+1 2345678 " * 600,
        "İstanbul İ@x.yz STRASSE ß", "1.2.3.4abc 5.6.7.8", "4111111111111111" * 40,
    ]
    return rows + [(200 + i, t) for i, t in enumerate(odd)] + [(7, "twice"), (7, "twice"), (None, "no id a@b.cd")]


@pytest.fixture(scope="module")
def planted(spark):
    rows = corpus()
    return rows, spark.createDataFrame(rows, DOCS).withColumn("kind", F.lit("clash")).withColumn("_said", F.lit(1)).repartition(3)


def test_spans_and_revealing_words_against_plain_python(planted):
    rows, df = planted
    want, told = plain(rows)
    assert told["zorblatt"] and "quixley" in told and "hapax" not in told and not {"the", "zone", "beta"} & set(told)
    got = pii.report(df)
    assert sorted((str(r.doc_id), r.spans, r.base_sha256, r.n_term) for r in got.collect()) == want
    kinds = {k: sum(s.count(f"{k}:") for _, s, _, _ in want) for k in FORMS}
    assert got.agg(*[F.sum(f"n_{k}").alias(k) for k in FORMS]).first().asDict() == kinds


def test_sanitised_texts(planted):
    rows, df = planted
    out = pii.sanitised(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[100] == "Z. was seen elsewhere; Z.."
    assert got[101] == "[EMAIL] is an address" and got[0].count("[EMAIL]") == 1 and "Zorblatt" not in got[0]
    assert got[20] == "Copies 0 of onetext name Hapax at [IP] always 0" and got[200] is None and got[201] == ""
    assert got[30] == dict(rows)[30]
    assert out.count() == len(rows)


def test_an_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    assert pii.report(none).count() == pii.sanitised(none).count() == 0


def test_positions_of_random_texts(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("a.b@-_ 1234+()é,") for _ in range(rng.randint(0, 60)))) for i in range(3000)]
    got = {r.doc_id: r.base_sha256 for r in pii.report(spark.createDataFrame(rows, DOCS), support=10**6).collect()}
    assert got == {i: hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b, _ in base_spans(t)).encode()).hexdigest() for i, t in rows}


def test_words_that_are_not_asked_for_are_counted_by_initial(planted, monkeypatch):
    rows, df = planted
    rare = [(900, " ".join(f"{a}rare{i}" for i in range(500) for a in "zb"))]
    df = df.select("doc_id", "text").unionByName(df.sparkSession.createDataFrame(rare, DOCS))
    sizes, held = {}, pii.written

    def counted(t, what):
        out = held(t, what)
        sizes[what] = out.count()
        return out

    monkeypatch.setattr(pii, "written", counted)
    found = sorted((str(r.doc_id), r.spans, r.base_sha256, r.n_term) for r in pii.report(df).collect())
    assert found == plain(rows + rare)[0] and sizes["vocabulary"] < 100
    monkeypatch.setattr(pii, "SENT", 0)
    assert sorted((str(r.doc_id), r.spans, r.base_sha256, r.n_term) for r in pii.report(df).collect()) == found and sizes["vocabulary"] > 1000
