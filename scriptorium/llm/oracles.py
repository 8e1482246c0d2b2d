"""DuckDB SQL for the queries that SQL can express; the others need fitted models, tokenizers or sketches of bytes."""

from __future__ import annotations

from . import conversation_sql, licenses, pii_sql

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WARC = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), t AS (
  SELECT hex, payload_bytes, max(page_id) AS top FROM p GROUP BY ALL
)
SELECT page_id, payload_bytes,
  -- five hexadecimal digits are four digits of base 32
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + (CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) % 32 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN t USING (hex, payload_bytes)
"""

NEAR = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), d AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS x FROM w
), n AS MATERIALIZED (
  SELECT doc_id, count(x) AS n_shingles FROM documents LEFT JOIN d USING (doc_id) GROUP BY doc_id
), joint AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM d a JOIN d b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), pairs AS MATERIALIZED (
  SELECT a, b FROM joint JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * c >= 75 * (m.n_shingles + o.n_shingles - c)
), e AS MATERIALIZED (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (
  SELECT doc_id, doc_id AS root FROM n UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.doc_id WHERE r.root < e.b
), c AS (
  SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, CAST(n_shingles AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""

#: Sums restart with each span, so they need recursion; budget 512, two turns of history, 15 signs of markers a turn.
CHAT = r"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
), t AS MATERIALIZED (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\t\n\x0B\f\r ]')) AS n,
    15 + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g')) + length(replace(replace(text, '\', '\b'), '<', '\l')) AS chars
  FROM said
), c AS MATERIALIZED (
  SELECT conv_id, CAST(role = 'system' AS INT) AS sys, greatest(1, 512 - CASE WHEN role = 'system' THEN n ELSE 0 END) AS room, chars AS lead FROM t WHERE i = 1
), s AS (
  -- k: number of the span (0: before the first); s: tokens in it; a new span begins at turn i if first
  SELECT conv_id, i, CASE WHEN role = 'system' THEN 0 ELSE n END AS s, CASE WHEN role = 'system' THEN 0 ELSE 1 END AS k, role <> 'system' AS first FROM t WHERE i = 1
  UNION ALL
  SELECT t.conv_id, t.i, CASE WHEN s.k = 0 OR s.s + t.n > room THEN t.n ELSE s.s + t.n END,
    CASE WHEN s.k = 0 OR s.s + t.n > room THEN s.k + 1 ELSE s.k END, s.k = 0 OR s.s + t.n > room
  FROM s JOIN t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.i = s.i + 1 JOIN c ON c.conv_id IS NOT DISTINCT FROM t.conv_id
), later AS (
  SELECT conv_id, k, min(i) AS start, max(s) AS used FROM s WHERE k > 1 GROUP BY ALL
), again AS (
  SELECT l.conv_id, sum(CASE WHEN sys = 1 THEN lead ELSE 0 END
    + CASE WHEN p.i >= sys + 1 AND used + p.n <= room THEN p.chars ELSE 0 END
    + CASE WHEN q.i >= sys + 1 AND used + p.n + q.n <= room THEN q.chars ELSE 0 END) AS chars
  FROM later l JOIN c ON c.conv_id IS NOT DISTINCT FROM l.conv_id
  LEFT JOIN t p ON p.conv_id IS NOT DISTINCT FROM l.conv_id AND p.i = l.start - 1
  LEFT JOIN t q ON q.conv_id IS NOT DISTINCT FROM l.conv_id AND q.i = l.start - 2
  GROUP BY ALL
), a AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS turns,
    coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS chars FROM t GROUP BY conv_id
)
SELECT a.conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(a.chars + coalesce(again.chars, 0) AS BIGINT) AS formatted_chars
FROM a LEFT JOIN again ON again.conv_id IS NOT DISTINCT FROM a.conv_id
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Written from the rules, not from the code that it checks: case, copyright lines, usual notices, spellings, punctuation.
LICENSES = r"""
WITH src AS (
  SELECT 'text' AS kind, doc_id, NULL AS name, coalesce(text, '') AS t FROM documents
  UNION ALL
  SELECT 'line', doc_id, NULL, line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) WHERE regexp_matches(line, '(?i)licen[cs]e')
  UNION ALL
  SELECT CASE WHEN contains(t, chr(10)) THEN 'known' ELSE 'notice' END, NULL, name, t FROM (VALUES {known}) v(name, t)
), a AS (
  SELECT kind, doc_id, name, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM src
), b AS (  -- lines of a holder with a year
  SELECT kind, doc_id, name, regexp_replace(t, '(?m)^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*[0-9]{{4}}[^\n]*$', ' ', 'g') AS t FROM a
), c AS (  -- wording in which "copyright" may begin a wrapped line
  SELECT kind, doc_id, name, regexp_replace(t, 'copyright[ \t]+(holders|holder|owners|owner|notices|notice|licenses|license|licence|laws|law|statement|interest|and|or|in|on|to|is)\b', 'copyright_\1', 'g') AS t FROM b
), d AS (  -- lines of a holder without a year
  SELECT kind, doc_id, name, regexp_replace(t, '(?m)^[^\p{{L}}\p{{N}}\n]*(copyright[ \t]*(\(c\)|©)|copyright[ \t]*:?[ \t]+[\p{{L}}\p{{N}}<\[{{"'']|©|\(c\)[ \t]*copyright[ \t])[^\n]*', ' ', 'g') AS t FROM c
), e AS (
  SELECT kind, doc_id, name, regexp_replace(t, '(?m)^[^\p{{L}}\p{{N}}\n]*\(c\)[ \t]+[^\n]*\b(inc|llc|ltd|corp|corporation|gmbh|foundation|affiliates|contributors|authors)\b[^\p{{L}}\p{{N}}\n]*$', ' ', 'g') AS t FROM d
), f AS (  -- usual lines before a licence
  SELECT kind, doc_id, name, regexp_replace(t, '(?m)^[^a-z0-9\n]*(all rights reserved|(the )?(mit|isc|zlib|bsd)( [23]-clause)? licen[cs]e)[^a-z0-9\n]*$', ' ', 'g') AS t FROM e
), g AS (  -- words between blanks of their own
  SELECT kind, doc_id, name, ' ' || trim(regexp_replace(replace(t, 'https://', 'http '), '[^\p{{L}}\p{{N}}]+', '  ', 'g')) || ' ' AS t FROM f
), h AS (
  SELECT kind, doc_id, name, trim(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(t,
    ' licence ', ' license '), ' licenced ', ' licensed '), ' sublicence ', ' sublicense '), ' acknowledgement ', ' acknowledgment '), ' favour ', ' favor '),
    ' organisation ', ' organization '), ' merchantibility ', ' merchantability '), ' non  infringement ', ' noninfringement '), ' copyright  owner ', ' copyright  holder '), '  ', ' ')) AS t FROM g
), w AS (
  SELECT digest, min(name) AS license FROM (
    SELECT sha256(t) AS digest, name FROM h WHERE kind IN ('known', 'notice') UNION ALL SELECT digest, name FROM (VALUES {digests}) v(name, digest)
  ) GROUP BY digest
), n AS (
  SELECT l.doc_id, string_agg(DISTINCT k.name, ',' ORDER BY k.name) AS notices FROM h l JOIN h k ON l.kind = 'line' AND k.kind = 'notice' AND l.t = k.t GROUP BY l.doc_id
)
SELECT doc_id, sha256(t) AS digest, license, coalesce(notices, '') AS notices FROM h LEFT JOIN w ON w.digest = sha256(t) LEFT JOIN n USING (doc_id) WHERE kind = 'text'
"""


def _licenses() -> str:
    known = ", ".join(f"({_quoted(name)}, {_quoted(t)})" for name, t in sorted(licenses.KNOWN.items()))
    digests = ", ".join(f"({_quoted(name)}, '{d}')" for name, ds in sorted(licenses.DIGESTS.items()) for d in ds)
    return LICENSES.format(known=known, digests=digests)


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": WARC, "op6_near_duplicates": NEAR, "op7_licenses": _licenses(), "op9_chat": CHAT, "op11_repair": conversation_sql.REPAIR, "op12_pii": pii_sql.PII, "op13_trie": conversation_sql.TRIE}
