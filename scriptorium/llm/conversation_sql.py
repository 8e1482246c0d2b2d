"""DuckDB SQL of the queries over conversations that repair and merge them."""

from __future__ import annotations


def crc32(text: str) -> str:
    """The CRC-32 of an ASCII text, as a sum over its bits."""
    bits = "list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ord(c) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: {bits}))"


#: Role and text as one digest, which also orders turns of one number.
_SAME = "sha256(length({0}) || ':' || {0} || {1})"
_FIRST = "CASE WHEN turn IS NULL THEN 0 ELSE 1 END, turn"

REPAIR = rf"""
WITH RECURSIVE o AS MATERIALIZED (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations
), d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM o
), r AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS w, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
    row_number() OVER (PARTITION BY conv_id ORDER BY {_FIRST}, {_SAME.format("role", "text")}) AS i FROM d
), f AS MATERIALIZED (
  SELECT conv_id, turn, role, text, w, i, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(w) OVER (PARTITION BY conv_id ORDER BY i) || w AS pair FROM r
), ins(s, pre, t) AS (  -- states: 0 nothing yet, 1 system, 2 user, 3 assistant; up to two inserts
  VALUES (0, '', 0), (0, 'I', 2), (0, 'II', 3), (1, '', 1), (1, 'I', 2), (1, 'II', 3), (2, '', 2), (2, 'I', 3), (2, 'II', 2), (3, '', 3), (3, 'I', 2), (3, 'II', 3)
), ways(t, letter, w, cost, u) AS (  -- w: the initial that keeping needs
  VALUES (0, 'D', '', 2, 0), (1, 'D', '', 2, 1), (2, 'D', '', 2, 2), (3, 'D', '', 2, 3), (0, 'R', '', 1, 2), (1, 'R', '', 1, 2), (2, 'R', '', 1, 3), (3, 'R', '', 1, 2),
    (0, 'K', 's', 0, 1), (0, 'K', 'u', 0, 2), (1, 'K', 'u', 0, 2), (3, 'K', 'u', 0, 2), (2, 'K', 'a', 0, 3)
), best AS (  -- v: cost in nine digits, then the audit; the least of each state is enough, as audits of the same rows are no prefixes of each other
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, '000000000' AS v FROM f
  UNION ALL
  SELECT f.conv_id, f.i, ways.u, min(lpad(CAST(CAST(left(v, 9) AS BIGINT) + 5 * length(pre) + cost + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END AS VARCHAR), 9, '0') || substr(v, 10) || pre || letter)
  FROM best JOIN f ON f.conv_id IS NOT DISTINCT FROM best.conv_id AND f.i = best.i + 1 JOIN ins ON ins.s = best.s JOIN ways ON ways.t = ins.t
  WHERE letter = 'D' OR fault IN ('', 'truncated') AND (letter = 'R' OR f.w = ways.w)
  GROUP BY f.conv_id, f.i, ways.u
), n AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
), won AS (
  SELECT n.conv_id, min(lpad(CAST(CAST(left(v, 9) AS BIGINT) + 5 * length(e) AS VARCHAR), 9, '0') || substr(v, 10) || e) AS v
  FROM n JOIN best ON best.conv_id IS NOT DISTINCT FROM n.conv_id AND best.i = n.n JOIN (VALUES (0, ''), (1, 'II'), (2, 'I'), (3, '')) x(s, e) ON x.s = best.s GROUP BY n.conv_id
), letters AS (
  SELECT conv_id, unnest(range(10, length(v) + 1)) AS p, substr(v, p, 1) AS letter FROM won
), placed AS (
  SELECT conv_id, p, letter, count(*) FILTER (letter <> 'I') OVER upto AS i, count(*) FILTER (letter <> 'D') OVER upto AS q FROM letters WINDOW upto AS (PARTITION BY conv_id ORDER BY p)
), said AS (
  SELECT x.conv_id, p, q, letter, CASE WHEN letter = 'I' THEN '' ELSE text END AS text, f.role, max(CASE WHEN q = 1 AND letter = 'K' AND f.w = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY x.conv_id) AS sys
  FROM placed x LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.i = x.i WHERE letter <> 'D'
), whole AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (q - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p)) AS sha FROM said GROUP BY conv_id
)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(CAST(left(v, 9) AS BIGINT), 0) AS cost, coalesce(substr(v, 10), '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN won ON won.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN whole ON whole.conv_id IS NOT DISTINCT FROM a.conv_id
"""

TRIE = rf"""
WITH t AS MATERIALIZED (
  SELECT conv_id, coalesce(text, '') AS text, {_SAME.format("coalesce(role, '')", "coalesce(text, '')")} AS same,
    row_number() OVER (PARTITION BY conv_id ORDER BY {_FIRST}, {_SAME.format("coalesce(role, '')", "coalesce(text, '')")}) AS pos FROM conversations WHERE conv_id IS NOT NULL
), c AS MATERIALIZED (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h, n FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)
), r AS (
  SELECT c.conv_id, t.pos AS depth, text, same FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(b.n, 0)), text, same FROM t JOIN c ON c.conv_id = t.conv_id LEFT JOIN c b ON b.conv_id = c.base WHERE t.pos > c.h
), p AS MATERIALIZED (  -- a node is the digests of its turns in a row
  SELECT conv_id, depth, length(text) AS chars, string_agg(same, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c
), e AS (
  SELECT conv_id, max(depth) AS ends FROM p GROUP BY conv_id
), n AS MATERIALIZED (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends = depth), '')) AS ends_sha256 FROM p JOIN e USING (conv_id) GROUP BY path, depth
), k AS MATERIALIZED (
  SELECT n.path, n.depth, n.n_convs, n.chars, up.conv_id AS parent, left(n.path, 64 * (n.depth - 1)) AS above FROM n LEFT JOIN n up ON n.depth > 0 AND up.path = left(n.path, 64 * (n.depth - 1))
), kids AS (
  SELECT above AS path, count(*) AS n_children FROM k WHERE depth > 0 GROUP BY above
), below AS (
  SELECT path, depth, (n_convs - 1) * chars AS saved, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf FROM k LEFT JOIN kids USING (path)
), sums AS (
  SELECT left(path, 64 * d) AS path, sum(saved) AS saved, sum(leaf) AS leaves FROM (SELECT path, saved, leaf, unnest(range(depth + 1)) AS d FROM below) GROUP BY ALL
)
SELECT conv_id, CAST(n.depth AS BIGINT) AS depth, k.parent AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM n JOIN k USING (path) JOIN sums USING (path) LEFT JOIN kids USING (path)
"""
