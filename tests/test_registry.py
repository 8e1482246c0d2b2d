"""Registered queries against brute force on small tables."""

from scriptorium.plans import registry

TEXTS = ["abcabc", " abcabc ", "ab", "x" * 500, "", None, "été à la plage", "one two\nthree", "  ", "abcd" * 300]


def test_gram_counts_of_all_texts(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS, 7)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    first = {}
    for k, t in enumerate(TEXTS, 7):
        if t:
            first.setdefault(t.strip(), k)
    want = {k: len({t[i : i + 3] for i in range(len(t) - 2)} if len(t) >= 3 else {t}) for t, k in first.items()}
    got = registry.gram_counts(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r.doc_id: r.n_grams for r in got} == want


def test_character_errors_of_whole_replies(spark, tmp_path):
    turns = [("a", 0, "user", "one two, three"), ("a", 1, "assistant", "One two three! " * 60), ("b", 0, "user", "x" * 400), ("b", 1, "assistant", "x" * 390 + "y" * 10)]
    spark.createDataFrame(turns, "conv_id string, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.cer_errors, r.cer_units, r.wer_units) for r in registry.character_errors(spark, str(tmp_path)).collect()}
    assert got == {"a": (59 * 11, 11, 3), "b": (10, 400, 1)}


def test_keyword_common_of_whole_texts(spark, tmp_path):
    texts = ["word " * 15 + "the extraordinary, the late don't", "a1b  c", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.word, r.common) for r in registry.keyword_common(spark, str(tmp_path)).collect())
    assert got == [(0, "don", False), (0, "extraordinary", False), (0, "late", False), (0, "t", False), (0, "the", True), (0, "word", False), (1, "a1b", False), (1, "c", False)]


def test_queries_agree_with_their_sql(spark):
    import duckdb

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in ("documents", "labels", "pages", "benchmark", "conversations", "events", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    shown = lambda row: tuple(repr(round(x, 9)) if isinstance(x, float) else repr(x) for x in row)
    queries, sql = registry.queries(), registry.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) > 70
    for name, text in sql.items():
        got = queries[name](spark, folder)
        columns = sorted(got.columns)
        want = con.sql(text)
        assert sorted(want.columns) == columns, name
        assert sorted(map(shown, want.select(*columns).fetchall())) == sorted(shown(r) for r in got.select(*columns).collect()), name


def test_corpus_error_rates_against_plain_python(spark, tmp_path):
    import re
    import unicodedata

    turns = [(i, j, ("user", "assistant")[j % 2], t) for i, pair in enumerate((("The cat, sat.", "the bat sat"), ("中文 abc", "中 文 abd"), ("", "x y"), ("Größe", "GRÖSSE!"))) for j, t in enumerate(pair)]
    spark.createDataFrame(turns, "conv_id int, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    def form(t):
        t = unicodedata.normalize("NFKC", t).casefold()
        return " ".join("".join(" " if unicodedata.category(c)[0] in "PSZ" else c for c in t).split())

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    parts = {"wer": lambda t: re.findall("[㐀-䶿一-鿿]+|[a-z0-9]+", t), "cer": lambda t: list(t.replace(" ", "")), "mer": lambda t: re.findall("[㐀-䶿一-鿿]|[a-z0-9]+", t)}
    pairs = [(form(turns[i][3]), form(turns[i + 1][3])) for i in range(0, len(turns), 2)]
    got = registry.corpus_error_rates(spark, str(tmp_path)).first()
    for k, f in parts.items():
        errors, units = sum(distance(f(r), f(h)) for r, h in pairs), sum(len(f(r)) for r, _ in pairs)
        assert (got[f"{k}_errors"], got[f"{k}_units"], got[k]) == (errors, units, errors / units)
