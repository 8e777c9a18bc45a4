"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {
    "op2_near_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    "op4_warc_bundles": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages), d AS (SELECT *, sha256(h) AS digest, octet_length(encode(h)) AS n, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to, url FROM d""",
    "op9_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN ['short ' || array_to_string(w, ' ')] ELSE [] END AS s FROM w),
u AS (SELECT doc_id, unnest(s) AS x FROM s),
h AS (SELECT doc_id, hash(x) AS x FROM u),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM h a JOIN h b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT o.a, o.b FROM o JOIN s x ON x.doc_id = o.a JOIN s y ON y.doc_id = o.b WHERE 100 * o.n >= 80 * (len(x.s) + len(y.s) - o.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.b) AS component_id FROM s JOIN reach r ON r.a = s.doc_id GROUP BY 1, 2""",
    # every window that shares a shingle with an item; the others have similarity 0
    "op3_benchmark_leaks": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
ds AS (SELECT doc_id, len(w) - 4 AS k, unnest(range(0, len(w) - 4)) AS p, unnest(list_transform(range(1, len(w) - 3), lambda k: hash(array_to_string(w[k:k + 4], ' ')))) AS h FROM d WHERE len(w) >= 5),
iss AS (SELECT item_id, len(w) AS n, unnest(list_transform(range(1, len(w) - 3), lambda k: hash(array_to_string(w[k:k + 4], ' ')))) AS h FROM i WHERE len(w) >= 5),
ih AS (SELECT item_id, n, h, count(*) AS c FROM iss GROUP BY ALL),
dh AS (SELECT doc_id, h, count(*) AS c FROM ds GROUP BY ALL),
cand AS (SELECT doc_id, item_id, n FROM dh JOIN ih USING (h) GROUP BY ALL HAVING sum(least(dh.c, ih.c)) >= 0.8 * (n - 4)),
hits AS (SELECT ds.doc_id, ih.item_id, ih.n, ih.c AS ic, ds.k, ds.p, ds.h FROM ds JOIN ih USING (h) JOIN cand ON cand.doc_id = ds.doc_id AND cand.item_id = ih.item_id),
win AS (SELECT doc_id, item_id, n, k, start, h, ic, count(*) AS c FROM (SELECT *, unnest(range(greatest(0, p - n + 5), p + 1)) AS start FROM hits) GROUP BY ALL),
shared AS (SELECT doc_id, item_id, n, k, start, sum(least(c, ic)) AS s FROM win GROUP BY ALL),
sim AS (SELECT *, s::DOUBLE / (n - 4 + least(n - 4, k - start) - s)::DOUBLE AS similarity FROM shared)
SELECT doc_id, item_id, start::INTEGER AS start, n::INTEGER AS n_words, similarity FROM sim WHERE similarity >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start DESC) = 1""",
    "op10_chat_masks": r"""
WITH c AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(role) + length(text) + len(regexp_extract_all(role || chr(1) || text, '\\|<\|turn\|>|<\|text\|>|<\|end\|>|<\|endoftext\|>|<\|im_start\|>|<\|im_end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')) + 23 AS n FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, sum(n)::BIGINT AS formatted_chars FROM e GROUP BY conv_id, own)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g""",
}
