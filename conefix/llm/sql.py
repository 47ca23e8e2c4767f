"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words: runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. Windows: 13 words, or a whole shorter item.
DECONTAMINATE = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bn AS (
  SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0
), grams AS (
  SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM bn)
), dw AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bn) WHERE len(w) >= n
), hits AS (
  SELECT dw.doc_id, dw.i, dw.n, grams.item_id FROM dw JOIN grams ON grams.n = dw.n AND grams.g = list_slice(dw.w, dw.i, dw.i + dw.n - 1)
), words_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM p
"""

CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(/?(?:s|INST|image|audio|document)[>\]])', '\1\2\\\3', 'g') AS body FROM c
), a AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, body) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, body) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length('<s>[INST]') + length(role) + length('[/INST]') + length(body) + length('</s>')) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM a
"""

#: Ten rounds of assigning and moving, each a CTE over components.
_ROUND = """
n{i} AS MATERIALIZED (SELECT r, c, d FROM (SELECT k.r, z.c, sum((k.x - z.x) * (k.x - z.x)) AS d FROM comp k JOIN z{i} z ON k.i = z.i GROUP BY k.r, z.c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1),
z{j} AS MATERIALIZED (
  SELECT z.c, z.i, coalesce(m.x, z.x) AS x FROM z{i} z LEFT JOIN (
    SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (SELECT n{i}.c, k.i, sum(k.x) AS s, count(*) AS n FROM n{i} JOIN comp k USING (r) GROUP BY n{i}.c, k.i)
  ) m USING (c, i)
),"""

CENTROIDS = (
    """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), comp AS MATERIALIZED (SELECT r, unnest(q) AS x, unnest(range(64)) AS i FROM kept),
seeds AS (SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), q) - 1 AS c, q FROM kept WHERE vec_id IS NOT NULL ORDER BY c LIMIT 8),
z0 AS MATERIALIZED (SELECT c, unnest(q) AS x, unnest(range(64)) AS i FROM seeds),"""
    + "".join(_ROUND.format(i=i, j=i + 1) for i in range(11))
    + """
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM z10 GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM n10 JOIN kept USING (r) JOIN h USING (c)
"""
)

CHUNK_DEDUP = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

#: The CRC-32 of a decimal id, a byte at a time and of each its eight bits.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"

TRIE = f"""
WITH o AS (
  SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (SELECT c, l, c - c % 20 AS b, CAST({_CRC} % 4 AS INTEGER) AS h FROM o),
f AS MATERIALIZED (SELECT h.c, list_concat(list_slice(coalesce(o.l, []), 1, h.h), list_slice(h.l, h.h + 1, len(h.l))) AS l FROM h LEFT JOIN o ON o.c = h.b),
m AS MATERIALIZED (SELECT c, l, d, list_slice(l, 1, d) AS key FROM f, LATERAL (SELECT unnest(range(0, len(f.l) + 1)) AS d)),
n AS MATERIALIZED (
  SELECT min(c) AS conv_id, d AS depth, key, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len(l) = d), '')) AS ends_sha256,
    CASE WHEN d > 0 THEN (count(*) - 1) * len(regexp_extract_all(key[d].t, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS own FROM m GROUP BY d, key
), p AS MATERIALIZED (SELECT n.*, a.conv_id AS parent_conv_id FROM n LEFT JOIN n a ON a.depth = n.depth - 1 AND a.key = list_slice(n.key, 1, n.depth - 1)),
k AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM p WHERE depth > 0 GROUP BY ALL),
q AS MATERIALIZED (SELECT p.*, coalesce(n_children, 0) AS n_children FROM p LEFT JOIN k USING (conv_id, depth)),
above AS (SELECT m.c, m.d, n.conv_id, n.depth FROM m JOIN n ON n.depth = m.d AND n.key = m.key),
s AS (SELECT above.conv_id, above.depth, sum(q.own) AS saved_tokens, count(*) FILTER (WHERE q.n_children = 0) AS n_leaves FROM q JOIN above ON above.c = q.conv_id AND above.d <= q.depth GROUP BY ALL)
SELECT q.conv_id, q.depth, q.parent_conv_id, q.n_convs, CAST(q.n_children AS BIGINT) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, q.ends_sha256 FROM q JOIN s USING (conv_id, depth)
"""
