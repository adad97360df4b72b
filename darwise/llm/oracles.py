"""The queries SQL can express, for another engine."""

import string

from darwise.llm.decontaminate import CONTAMINATED_SHARE, WINDOW

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def oracle_sql() -> dict[str, str]:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}', 0)"
    return {
        "op3_decontamination": rf"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS ws FROM benchmark),
patterns AS (SELECT DISTINCT item, least(len(ws), {WINDOW}) AS n, array_to_string(ws[i:i + least(len(ws), {WINDOW}) - 1], ' ') AS k
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - {WINDOW} + 1, 1) + 1)) AS i FROM items WHERE len(ws) > 0)),
docs AS (SELECT doc_id, {words} AS ws FROM documents),
places AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM patterns) WHERE len(ws) >= n)),
found AS (SELECT doc_id, p.n, i, item FROM places p JOIN patterns t ON t.k = p.k AND t.n = p.n),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY 1),
held AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {CONTAMINATED_SHARE} * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN held e ON e.doc_id = d.doc_id""",
        "op4_substring_dedup": r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+', 0) AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM docs WHERE len(ws) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, unnest(range(i, i + 20)) AS pos FROM later)),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.pos) AS t
  FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM docs) w ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.pos = w.pos GROUP BY 1),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, coalesce(r.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM docs d LEFT JOIN removed r ON r.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id""",
        # The CRC-32 of a decimal id, bit by bit: DuckDB has no such function.
        "op12_conversation_trie": r"""
WITH given AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+', 0)) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
plan AS (SELECT c, c - c % 20 AS base, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda s: ord(s)::BIGINT),
    lambda a, b: list_reduce([xor(a, b)] || range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h FROM (SELECT DISTINCT c FROM given)),
lengths AS (SELECT c, count(*) AS n FROM given GROUP BY 1),
turns AS (SELECT l.c, g.p AS d, said, words FROM plan l JOIN given g ON g.c = l.base AND g.p <= l.h
  UNION ALL SELECT l.c, g.p - l.h + least(l.h, coalesce(b.n, 0)), said, words FROM plan l JOIN given g ON g.c = l.c AND g.p > l.h LEFT JOIN lengths b ON b.c = l.base),
members AS (SELECT c, d, words, string_agg(said, '') OVER (PARTITION BY c ORDER BY d) AS path FROM turns UNION ALL SELECT c, 0, 0, '' FROM plan),
ends AS (SELECT path, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends_sha256 FROM (SELECT c, max_by(path, d) AS path FROM members GROUP BY c) GROUP BY path),
nodes AS (SELECT path, d AS depth, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words FROM members GROUP BY ALL),
families AS (SELECT left(path, 64 * (depth - 1)) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN families f ON f.path = n.path),
inside AS (SELECT path, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM
  (SELECT (n_children = 0)::INT AS leaf, (n_convs - 1) * words AS saved, left(path, 64 * unnest(range(0, depth + 1))) AS path FROM counted) GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens,
  coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM counted n JOIN inside i ON i.path = n.path LEFT JOIN ends e ON e.path = n.path LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = left(n.path, 64 * (n.depth - 1))""",
    }
