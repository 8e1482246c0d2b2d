"""DuckDB SQL of personal data and of the words that give it away."""

from __future__ import annotations

_WORD = r"[\p{N}]*\p{L}[\p{L}\p{N}]*"
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
_FORMS = {"email": _EMAIL, "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _matches(kind: str, n: int, form: str) -> str:
    return rf"""SELECT doc_id, {n} AS k, '{kind}' AS kind, t, regexp_extract_all(t, '{form}') AS m, regexp_split_to_array(t, '{form}') AS p FROM d"""


def _holds() -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    # Luhn: from the right, every second digit doubled, of both digits the sum
    doubled = f"list_transform(range(1, length({digits}) + 1), lambda i: CAST(substr(reverse({digits}), i, 1) AS BIGINT) * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END))"
    luhn = f"list_sum(list_transform({doubled}, lambda x: CASE WHEN x > 9 THEN x - 9 ELSE x END)) % 10 = 0"
    return f"""CASE kind WHEN 'email' THEN true WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0
    WHEN 'card' THEN length({digits}) BETWEEN 16 AND 19 AND {luhn} ELSE length({digits}) BETWEEN 8 AND 15 END"""


#: Threshold 0.9, three texts, 120 code points on each side.
PII = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), raw AS (
  {" UNION ALL ".join(_matches(kind, n, form) for n, (kind, form) in enumerate(_FORMS.items()))}
), every AS (
  SELECT doc_id, k, kind, i, m[i] AS m, p[i] AS before, p[i + 1] AS after,
    CAST(list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM raw)
), short AS (  -- runs of under 16 digits are matches that fail; pieces end at cards of 16 digits at least
  SELECT doc_id, k, kind, m, start, start + length(m) AS stop, before, after, CASE kind WHEN 'email' THEN lower(m) WHEN 'ip' THEN m ELSE regexp_replace(m, '[^0-9]', '', 'g') END AS value
  FROM every WHERE kind <> 'card' OR length(regexp_replace(m, '[^0-9]', '', 'g')) >= 16
), base AS MATERIALIZED (
  SELECT s.doc_id, k, kind, value, start, stop,
    substr(t, CAST(coalesce(lag(stop) OVER w, 0) + 1 AS BIGINT), CAST(start - coalesce(lag(stop) OVER w, 0) AS BIGINT)) AS l,
    substr(t, CAST(stop + 1 AS BIGINT), CAST(coalesce(lead(start) OVER w, length(t)) - stop AS BIGINT)) AS r, m
  FROM short s JOIN d USING (doc_id) WINDOW w AS (PARTITION BY s.doc_id, k ORDER BY start)
), held AS MATERIALIZED (
  SELECT doc_id, k, kind, value, start, stop, CASE WHEN length(l) > 120 THEN regexp_replace(right(l, 120), '^[\p{{L}}\p{{N}}]+', '') ELSE l END AS l,
    CASE WHEN length(r) > 120 THEN regexp_replace(left(r, 120), '[\p{{L}}\p{{N}}]+$', '') ELSE r END AS r FROM base WHERE {_holds()}
), listed AS (
  SELECT doc_id, list_transform(regexp_extract_all(regexp_replace(t, '{_EMAIL}', ' ', 'g'), '{_WORD}'), lambda x: lower(x)) AS w FROM d WHERE doc_id IN (SELECT doc_id FROM held)
), sketches AS (  -- the least digest of runs of three words
  SELECT doc_id, coalesce(list_min(list_transform(range(1, len(w) + 1), lambda i: md5(w[i] || ' ' || coalesce(w[i + 1], '') || ' ' || coalesce(w[i + 2], '')))), '') AS sketch FROM listed
), around AS (
  SELECT kind, value, sketch, lower(unnest(regexp_extract_all(regexp_replace(l, '{_EMAIL}', ' ', 'g'), '{_WORD}') || regexp_extract_all(regexp_replace(r, '{_EMAIL}', ' ', 'g'), '{_WORD}'))) AS term FROM held JOIN sketches USING (doc_id)
), pairs AS MATERIALIZED (  -- texts: sketches by weight
  SELECT kind, value, term, left(term, 1) AS initial, sum(n) AS n_ct, sum(n) * sum(n) / sum(n * n)::DOUBLE AS texts FROM (SELECT kind, value, term, sketch, count(*) AS n FROM around GROUP BY ALL) GROUP BY kind, value, term
), vocabulary AS MATERIALIZED (
  SELECT term, left(term, 1) AS initial, count(*) AS n_t FROM (SELECT lower(unnest(regexp_extract_all(regexp_replace(t, '{_EMAIL}', ' ', 'g'), '{_WORD}'))) AS term FROM d) GROUP BY term
), counted AS (
  SELECT p.term, n_ct, n_t, n_c, n_cg, n_g, CAST((SELECT sum(n_t) FROM vocabulary) AS DOUBLE) AS n
  FROM pairs p JOIN vocabulary v ON v.term = p.term JOIN (SELECT kind, value, sum(n_ct) AS n_c FROM pairs GROUP BY ALL) c ON c.kind = p.kind AND c.value = p.value
  JOIN (SELECT kind, value, initial, sum(n_ct) AS n_cg FROM pairs GROUP BY ALL) g ON g.kind = p.kind AND g.value = p.value AND g.initial = p.initial
  JOIN (SELECT initial, sum(n_t) AS n_g FROM vocabulary GROUP BY initial) i ON i.initial = p.initial WHERE texts >= 3
), told AS (
  SELECT DISTINCT term FROM counted WHERE log2(least(n_ct, n_t) * n / (n_c * n_t)) >= 0.9 * log2(n / n_c)
), placed AS (
  SELECT doc_id, w[i] AS word, CAST(list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT doc_id, w, p, unnest(range(1, len(w) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(t, '{_WORD}') AS w, regexp_split_to_array(t, '{_WORD}') AS p FROM d WHERE EXISTS (SELECT 1 FROM told WHERE contains(lower(t), term))))
), terms AS (
  SELECT doc_id, start, start + length(word) AS stop FROM placed x WHERE lower(word) IN (SELECT term FROM told)
    AND NOT EXISTS (SELECT 1 FROM held h WHERE h.doc_id = x.doc_id AND h.start < x.start + length(word) AND x.start < h.stop)
), spans AS (
  SELECT doc_id, k, kind, start, stop FROM held UNION ALL SELECT doc_id, 4, 'term', start, stop FROM terms
), lists AS (
  SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY k, start) AS spans, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY k, start) FILTER (k < 4) AS base,
    {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in [*_FORMS, "term"])} FROM spans GROUP BY doc_id
)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{kind}, 0) AS BIGINT) AS n_{kind}" for kind in [*_FORMS, "term"])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN lists USING (doc_id)
"""
