"""DuckDB SQL for those of the subpackage's queries that SQL can express."""

from __future__ import annotations

_NARROW = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), placed AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM sizes
), roomy AS (
  SELECT *, source_size * 2.0::DOUBLE / weight AS room, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM placed
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY room, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY room, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level FROM roomy
), leveled AS (
  SELECT *, (SELECT arg_min(own_level, (room, place)) FROM levels WHERE own_level < room) AS level FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN source_size * 2.0::DOUBLE ELSE least(source_size * 2.0::DOUBLE, level * weight) END AS target FROM leveled
), expected AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, target / source_size) ELSE 0.0::DOUBLE END AS copies,
    ('0x' || substr(md5('mix' || coalesce('=' || source, '')), 1, 6))::BIGINT % 1024 / 1024.0::DOUBLE AS start FROM targets
), numbered AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY
    length(size::VARCHAR) * 100 + rpad(substr(size::VARCHAR, 1, 2), 2, '0')::INT, md5('mix|' || coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size) - 1 AS pos FROM docs
)
SELECT doc_id, size, source_size, target, ((floor((pos + 1) * copies + start) - floor(pos * copies + start)) * size)::BIGINT AS taken
FROM numbered JOIN expected ON numbered.source IS NOT DISTINCT FROM expected.source
"""

_MARK = "^[ \\t]*(>[ \\t]*)+"
_PLAIN = "regexp_replace(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), '^ | $', '', 'g')"

_CHAT = f"""
WITH RECURSIVE messages AS (
  SELECT row_number() OVER () AS id, conv_id, turn, role, coalesce(text, '') AS text FROM conversations
), lines AS (
  SELECT id, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), 1) AS i
  FROM messages WHERE regexp_matches(text, '(^|[\\r\\n])[ \\t]*>')
), levelled AS (
  SELECT id, i, len(replace(replace(regexp_extract(line, '{_MARK}'), ' ', ''), chr(9), '')) AS level, regexp_replace(line, '{_MARK}', '') AS line FROM lines
), marked AS (
  SELECT *, (level IS DISTINCT FROM lag(level) OVER (PARTITION BY id ORDER BY i))::INT AS new FROM levelled
), numbered AS (
  SELECT *, sum(new) OVER (PARTITION BY id ORDER BY i) AS run FROM marked
), runs AS (
  SELECT id, run, any_value(level) AS level, string_agg(line, chr(10) ORDER BY i) AS text, coalesce(first(line ORDER BY i) FILTER ({_PLAIN.format('line')} <> ''), '') AS head FROM numbered GROUP BY id, run
), quoted AS (
  SELECT id, max(level) AS quote_depth, count(*) FILTER (level > 0) AS n_passages, regexp_replace(regexp_replace(coalesce(string_agg(text, chr(10) ORDER BY run) FILTER (level = 0), ''), '^[\\s\\x0B]+', ''), '[\\s\\x0B]+$', '') AS body FROM runs GROUP BY id
), parsed AS (
  SELECT m.*, coalesce(q.body, m.text) AS body, coalesce(q.quote_depth, 0) AS quote_depth, coalesce(q.n_passages, 0) AS n_passages FROM messages m LEFT JOIN quoted q ON q.id = m.id
), units AS (
  SELECT conv_id, unit, min(turn) AS parent FROM (SELECT conv_id, turn, {_PLAIN.format("unnest(list_concat([body], regexp_split_to_array(body, '\\n[ \\t]*\\n'), string_split(body, chr(10))))")} AS unit FROM parsed)
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND unit <> '' GROUP BY 1, 2
), asked AS (
  SELECT m.conv_id, m.turn, {_PLAIN.format('r.text')} AS whole, {_PLAIN.format('r.head')} AS head FROM runs r JOIN messages m ON m.id = r.id WHERE r.level = 1 AND m.conv_id IS NOT NULL AND m.turn IS NOT NULL
), parents AS (
  SELECT a.conv_id, a.turn, max(CASE WHEN w.parent < a.turn THEN w.parent WHEN h.parent < a.turn THEN h.parent END) AS reply_to
  FROM asked a LEFT JOIN units w ON w.conv_id = a.conv_id AND w.unit = a.whole LEFT JOIN units h ON h.conv_id = a.conv_id AND h.unit = a.head GROUP BY 1, 2
), linked AS (SELECT * FROM parents WHERE reply_to IS NOT NULL
), chains AS (
  SELECT conv_id, turn, reply_to AS up, 1::BIGINT AS depth FROM linked
  UNION ALL SELECT c.conv_id, c.turn, l.reply_to, c.depth + 1 FROM chains c JOIN linked l ON l.conv_id = c.conv_id AND l.turn = c.up
), ends AS (SELECT conv_id, turn, arg_max(up, depth) AS thread, max(depth) AS depth FROM chains GROUP BY 1, 2)
SELECT p.conv_id, p.turn, p.role, p.body, p.quote_depth::INT AS quote_depth, p.n_passages::INT AS n_passages, l.reply_to, coalesce(e.thread, p.turn) AS thread, coalesce(e.depth, 0) AS depth,
  '<|' || coalesce(p.role, 'unknown') || '|>' || chr(10) || p.body AS formatted
FROM parsed p LEFT JOIN linked l ON l.conv_id = p.conv_id AND l.turn = p.turn LEFT JOIN ends e ON e.conv_id = p.conv_id AND e.turn = p.turn
"""

_TOPK = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), queries AS (SELECT vec_id, min(v) AS v FROM vectors WHERE vec_id % 20 = 0 GROUP BY vec_id
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM queries q JOIN vectors c ON q.vec_id <> c.vec_id
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""

_JACCARD = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) END AS g FROM w
), sizes AS (SELECT doc_id, len(g)::BIGINT AS n FROM s
), post AS (SELECT doc_id, hash(unnest(g)) AS g FROM s
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM post a JOIN post b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)
), reach(root, doc_id) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.root, l.b FROM reach r JOIN links l ON l.a = r.doc_id
)
SELECT sizes.doc_id, n AS n_shingles, (SELECT min(root) FROM reach r WHERE r.doc_id = sizes.doc_id) AS component_id FROM sizes
"""

ORACLES = {"op6_mixing": _NARROW, "op7_exact_topk": _TOPK, "op8_chat": _CHAT, "op10_jaccard": _JACCARD}
