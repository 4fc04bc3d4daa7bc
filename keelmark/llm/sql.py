"""DuckDB SQL for the queries that SQL can express over whole tables."""

OP2 = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
), g AS (
  SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g ON t.body = g.body
"""

OP3 = """
WITH v AS (
  SELECT vec_id, [floor(1024e0 * CAST(x AS DOUBLE)) for x in embedding] AS vector FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len([x for x in embedding if isfinite(x)]) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.vector, c.vector) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 10
"""

OP7 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, role = 'assistant' AS trained,
    row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS last,
    sum(length('<turn>') + length('<says>') + length('</turn>') + 1 + length(regexp_replace(role, '([\\<>])', '\\\1', 'g'))
      + length(regexp_replace(text, '([\\<>])', '\\\1', 'g'))) OVER w AS so_far
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (trained), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (trained), '')) AS loss_sha256,
  CAST(sum(so_far) FILTER (trained OR n = last) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

_LENGTHS = [3, 5, 6, 7, 8, 9, 10]
_LIMITS = {"line_chars": 20, 5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}

OP11 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), base AS (
  SELECT doc_id, len(words) AS n_words, CAST(coalesce(list_sum([length(w) for w in words]), 0) AS BIGINT) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM t
), lines AS (
  SELECT doc_id, line, count(*) AS n, any_value(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS chars
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL
), repeated AS (
  SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS n_dup_lines, sum((n - 1) * chars) AS line_chars FROM lines GROUP BY doc_id
), windows AS (
  SELECT doc_id, n, i, words[i:i + n - 1] AS w FROM (
    SELECT doc_id, n, words, unnest(range(1, len(words) - n + 2)) AS i FROM t, (SELECT unnest([""" + ", ".join(map(str, _LENGTHS)) + r"""]) AS n) WHERE len(words) >= n
  )
), ranked AS (
  SELECT doc_id, n, i, row_number() OVER (PARTITION BY doc_id, n, w ORDER BY i) AS k, count(*) OVER (PARTITION BY doc_id, n, w) AS times FROM windows
), covered AS (
  SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS place FROM ranked WHERE k > 1 OR (n = 3 AND times > 1)
), chars AS (
  SELECT c.doc_id, c.n, count(*) AS places, sum(length(t.words[c.place])) AS chars FROM covered c JOIN t USING (doc_id) GROUP BY ALL
), shares AS (
  SELECT doc_id, """ + ", ".join(f"coalesce(max(CASE WHEN n = {n} THEN chars END), 0) AS c{n}" for n in _LENGTHS) + r""",
    coalesce(max(CASE WHEN n = 3 THEN places END), 0) AS n_repeat_words FROM chars GROUP BY doc_id
), measured AS (
  SELECT b.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(line_chars, 0) AS line_chars, coalesce(n_repeat_words, 0) AS n_repeat_words,
    """ + ", ".join(f"coalesce(c{n}, 0) AS c{n}" for n in _LENGTHS[1:]) + r"""
  FROM base b LEFT JOIN repeated r USING (doc_id) LEFT JOIN shares s USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed
  """ + " ".join(f"AND 100 * {c if isinstance(c, str) else f'c{c}'} <= {limit} * word_chars" for c, limit in _LIMITS.items()) + r""" AS kept
FROM judged
"""

ORACLE_SQL = {
    "op2_exact_dedup": OP2,
    "op3_topk_search": OP3,
    "op7_chat_format": OP7,
    "op11_repetition": OP11,
}
