"""The training-data queries as DuckDB SQL, by the plain definition of each result."""

from __future__ import annotations

_GOOD = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# Shingles of five words (or all of a shorter text), pairs by shared shingles, groups by reachability.
NGRAM_JOIN = rf"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
 n AS (SELECT doc_id, count(*) AS n, md5(string_agg(md5(g), '' ORDER BY md5(g))) AS v FROM s GROUP BY 1),
 c AS (SELECT v, min(doc_id) AS id, count(*) AS size, min(n) AS n FROM n GROUP BY 1),
 cs AS (SELECT c.id, g FROM s JOIN c ON s.doc_id = c.id),
 p AS (SELECT x.id AS a, y.id AS b, count(*) AS common FROM cs x JOIN cs y ON x.g = y.g AND x.id <> y.id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN c ca ON ca.id = a JOIN c cb ON cb.id = b WHERE 5 * common >= 4 * (ca.n + cb.n - common)),
 r(a, b) AS (SELECT id, id FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
 g AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1),
 k AS (SELECT l.a, sum(size) AS links FROM l JOIN c ON c.id = l.b GROUP BY 1)
 SELECT d.doc_id, coalesce(c.id, d.doc_id) AS class_id, CAST(coalesce(c.size - 1 + coalesce(k.links, 0), 0) AS BIGINT) AS n_links,
  coalesce(g.component_id, d.doc_id) AS component_id, coalesce(g.component_id = d.doc_id, true) AS kept
 FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (v) LEFT JOIN g ON g.a = c.id LEFT JOIN k ON k.a = c.id"""

TOP_K = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE {_GOOD}),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
 r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
 SELECT * FROM r WHERE rank <= 10"""

EMBEDDING_DEDUP = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {_GOOD}),
 u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS size FROM v WHERE list_inner_product(e, e) > 0),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) >= 0.9 * a.size * b.size),
 r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
 g AS (SELECT a, min(least(a, b)) AS c FROM r GROUP BY 1), k AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
 SELECT vec_id, coalesce(k.n, 0) AS n_links, coalesce(g.c, vec_id) AS component_id, coalesce(g.c, vec_id) = vec_id AS kept
 FROM embeddings LEFT JOIN k ON k.a = vec_id LEFT JOIN g ON g.a = vec_id"""

# A word goes if one of the 50 windows that end with or after it, and begin with or before it, stands in a smaller document.
SUBSTRING = rf"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
 p AS (SELECT doc_id, ws[i] AS word, i, CASE WHEN i + 49 <= len(ws) THEN md5(array_to_string(ws[i : i + 49], ' ')) END AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
 f AS (SELECT h, min(doc_id) AS low FROM p WHERE h IS NOT NULL GROUP BY 1),
 s AS (SELECT p.doc_id, word, i, coalesce(p.doc_id > low, false) AS seen FROM p LEFT JOIN f USING (h)),
 g AS (SELECT doc_id, word, i, bool_or(seen) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM s),
 a AS (SELECT doc_id, count(*) AS n, count_if(gone) AS m, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY 1)
 SELECT doc_id, coalesce(n, 0) AS n_words, CAST(coalesce(m, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN a USING (doc_id)"""

# Bytes as pairs of hexadecimal digits; a string is 200 of them.
SUFFIX = """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
 c AS (SELECT doc_id, b, substr(x, 2000 * b + 1, 2398) AS x, length(x) // 2 - 1000 * b AS rest FROM (SELECT doc_id, x, unnest(range(0, (length(x) + 1999) // 2000)) AS b FROM t)),
 p AS (SELECT doc_id, 1000 * b + i AS i, substr(x, 2 * i + 1, 2) AS byte, CASE WHEN i + 200 <= rest THEN md5(substr(x, 2 * i + 1, 400)) END AS h FROM (SELECT *, unnest(range(0, least(rest, 1000))) AS i FROM c)),
 f AS (SELECT h, count(*) AS n FROM p WHERE h IS NOT NULL GROUP BY 1),
 s AS (SELECT doc_id, i, byte, coalesce(n > 1, false) AS twice FROM p LEFT JOIN f USING (h)),
 g AS (SELECT doc_id, i, byte, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM s),
 e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM g),
 a AS (SELECT doc_id, count_if(gone) AS m, count_if(starts) AS spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY 1)
 SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(m, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
 FROM t LEFT JOIN a USING (doc_id)"""

CHAT = r"""WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
 t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, coalesce(role = 'assistant', false) AS reply,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM c),
 x AS (SELECT *, length('<|im_start|>') + length(replace(replace(replace(role, '\', '\s'), '<|', '<\p'), chr(10), '\n')) + 1 + length(replace(replace(text, '\', '\s'), '<|', '<\p')) + length('<|im_end|>') + 1 AS size FROM t),
 y AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM x)
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (reply), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (reply), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (reply OR i = n) AS BIGINT) AS formatted_chars FROM y GROUP BY conv_id"""


def _crc32(text: str) -> str:
    """The checksum of an SQL text's UTF-8 bytes, bit by bit."""
    digits = f"hex(encode({text}))"
    octets = f"list_transform(range(length({digits}) // 2), lambda i: CAST('0x' || substr({digits}, 2 * i + 1, 2) AS UBIGINT))"
    bits = f"flatten(list_transform({octets}, lambda b: list_transform(range(8), lambda k: (b >> k) & 1)))"
    step = "xor(c >> 1, CAST(3988292384 AS UBIGINT) * (xor(c, b) & 1))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {bits}), lambda c, b: {step}), CAST(4294967295 AS UBIGINT))"


# Nodes by the digest of their turns; what is summed over a subtree is summed over all pairs of a node and an ancestor.
CONVERSATION_TRIE = rf"""WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 o AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS ts, CAST({_crc32('CAST(conv_id AS VARCHAR)')} % 4 AS BIGINT) AS h FROM t GROUP BY 1),
 r AS (SELECT o.conv_id, list_concat(coalesce(b.ts[1 : o.h], []), o.ts[o.h + 1 :]) AS ts FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 20),
 m AS (SELECT conv_id, d, sha256(CAST(to_json(ts[1 : d]) AS VARCHAR)) AS k, CASE WHEN d > 0 THEN sha256(CAST(to_json(ts[1 : d - 1]) AS VARCHAR)) END AS pk, d = len(ts) AS ends,
  CASE WHEN d > 0 THEN len(regexp_extract_all(ts[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS w FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM r)),
 n AS (SELECT k, any_value(pk) AS pk, any_value(d) AS depth, any_value(w) AS w, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY k),
 c AS (SELECT pk AS k, count(*) AS n_children FROM n WHERE pk IS NOT NULL GROUP BY 1),
 a(k, up) AS (SELECT k, k FROM n UNION ALL SELECT a.k, n.pk FROM a JOIN n ON n.k = a.up WHERE n.pk IS NOT NULL),
 s AS (SELECT up AS k, count(*) FILTER (c.k IS NULL) AS n_leaves, CAST(sum((n_convs - 1) * w) AS BIGINT) AS saved_tokens FROM a JOIN n ON n.k = a.k LEFT JOIN c ON c.k = a.k GROUP BY 1)
 SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
 FROM n JOIN s ON s.k = n.k LEFT JOIN c ON c.k = n.k LEFT JOIN n p ON p.k = n.pk"""

# Pairs by the letters before and after the one that differs, or by the whole word that a deletion gives.
SPELLING = rf"""WITH RECURSIVE d AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
 o AS (SELECT run, count(*) AS n, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM d WHERE length(run) >= 5 GROUP BY doc_id, run),
 w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM o) WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
 x AS (SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
 y AS (SELECT DISTINCT x.word AS longer, x.n AS longer_n, w.word AS shorter, w.n AS shorter_n FROM x JOIN w ON w.word = x.head || x.tail),
 p AS (SELECT a.word, b.word AS near, b.n FROM x a JOIN x b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word UNION ALL SELECT longer, shorter, shorter_n FROM y UNION ALL SELECT shorter, longer, longer_n FROM y),
 b AS (SELECT word, count(*) AS n_near, max(n) AS most FROM p GROUP BY 1),
 f AS (SELECT b.word, n_near, most, min(near) AS near FROM b JOIN p ON p.word = b.word AND p.n = b.most GROUP BY 1, 2, 3),
 g AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * w.n THEN near END AS form, CASE WHEN most >= 2 * w.n THEN most END AS form_n FROM w LEFT JOIN f USING (word)),
 u(word, top) AS (SELECT word, word FROM g UNION ALL SELECT u.word, g.form FROM u JOIN g ON g.word = u.top WHERE g.form IS NOT NULL)
 SELECT g.word, g.form, u.top AS root, g.n, g.n_near, g.form_n FROM g JOIN u ON u.word = g.word JOIN g e ON e.word = u.top AND e.form IS NULL"""
