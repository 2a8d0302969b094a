"""DuckDB SQL for the queries that SQL can express, on the tables as they are."""

from __future__ import annotations

from editpulse.llm.mixing import offset_of

SPACE = r"[\x20\x09-\x0D]"
LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP3 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
, least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
, degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(l.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN least l ON l.a = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
"""

OP5 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.format(LOWERED.format("coalesce(text, '')"))} AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE
    list_distinct(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i:i + 4], ' '))) END AS grams
  FROM w
), n AS (SELECT doc_id, len(grams) AS size FROM s)
, g AS (SELECT doc_id, unnest(grams) AS gram FROM s)
, common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2)
, links AS (
  SELECT c.a, c.b FROM common c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.n >= 75 * (x.size + y.size - c.n)
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
, least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT n.doc_id, n.size AS n_shingles, least(n.doc_id, coalesce(l.b, n.doc_id)) AS component_id
FROM n LEFT JOIN least l ON l.a = n.doc_id
"""

OP6 = f"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g') AS norm FROM documents
), k AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""

OP8 = f"""
WITH w AS (
  SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")}) AS size, md5(cast(doc_id AS VARCHAR)) AS k FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM w GROUP BY 1)
, p AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS wt,
         source_size * 2.0::DOUBLE AS cap FROM s
), q AS (
  SELECT *, row_number() OVER (ORDER BY cap / wt, source NULLS LAST) AS nth,
    ((sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(wt) OVER (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM p
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, nth) FROM q WHERE level * wt < cap) * wt, cap)) AS target FROM q
), r AS (
  SELECT doc_id, source, size, row_number() OVER (
    PARTITION BY source
    ORDER BY len(bin(size)) * 64 + (size >> greatest(len(bin(size)) - 6, 0)), substr(k, 1, 1), size, k, doc_id) AS rank FROM w
)
SELECT r.doc_id, r.size, t.source_size, t.target,
  CASE WHEN t.source_size = 0 THEN 0 ELSE
    (floor(rank * (target / source_size) + {offset_of(8)!r}::DOUBLE) - floor((rank - 1) * (target / source_size) + {offset_of(8)!r}::DOUBLE))::BIGINT
  END * r.size AS taken
FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
"""

OP10 = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT *, {LOWERED.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""



def field(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE concat(octet_length(encode(CAST({column} AS VARCHAR))), ':', {column}) END"


FIELDS = ", ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
# Crc32 of a decimal number, bit by bit; both shifts and the polynomial are those of the standard.
CRC_BIT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
OP12 = f"""
WITH RECURSIVE crc AS (
  SELECT doc_id, 0 AS i, 4294967295::BIGINT AS c, encode(CAST(doc_id AS VARCHAR)) AS s FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, i + 1, CASE WHEN i % 9 = 0 THEN xor(c, ascii(substr(CAST(doc_id AS VARCHAR), i // 9 + 1, 1))::BIGINT) ELSE {CRC_BIT} END, s
  FROM crc WHERE i < 9 * octet_length(s)
), chosen AS (SELECT doc_id FROM crc WHERE i = 9 * octet_length(s) AND xor(c, 4294967295) % 2 = 0
), d AS (
  SELECT doc_id, source, sha256(concat({FIELDS}, {field("text")})) AS leaf,
    sha256(concat({FIELDS}, {field("replace(text, chr(10), '')")})) AS other, doc_id IN (SELECT doc_id FROM chosen) AS bad
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
    dense_rank() OVER (ORDER BY source NULLS FIRST) AS s FROM d
), tree AS (
  SELECT s, 0 AS lvl, pos, n, leaf AS node FROM leaves
  UNION ALL
  SELECT s, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY s, lvl, pos // 3, n
), subroots AS (SELECT s, node AS subroot, lvl AS height FROM tree WHERE n = 1
), above AS (
  SELECT 0 AS lvl, s - 1 AS pos, (SELECT count(*) FROM subroots) AS n, subroot AS node FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM above WHERE n > 1 GROUP BY lvl, pos // 3, n
), root AS (SELECT node AS root, lvl AS height FROM above WHERE n = 1
), path AS (
  SELECT l.s, l.pos, t.lvl, t.pos AS place, t.node, t.pos = l.pos // (3 ** t.lvl)::BIGINT AS own
  FROM leaves l JOIN tree t ON t.s = l.s AND t.n > 1 AND t.pos // 3 = l.pos // (3 ** (t.lvl + 1))::BIGINT
  UNION ALL
  SELECT l.s, l.pos, r.height + a.lvl, a.pos, a.node, a.pos = (l.s - 1) // (3 ** a.lvl)::BIGINT
  FROM leaves l JOIN subroots r ON r.s = l.s JOIN above a ON a.n > 1 AND a.pos // 3 = (l.s - 1) // (3 ** (a.lvl + 1))::BIGINT
), steps AS (
  SELECT s, pos, lvl, coalesce(string_agg(node, '' ORDER BY place) FILTER (WHERE place < mine), '') AS l,
    coalesce(string_agg(node, '' ORDER BY place) FILTER (WHERE place > mine), '') AS r
  FROM (SELECT *, max(place) FILTER (WHERE own) OVER (PARTITION BY s, pos, lvl) AS mine FROM path) GROUP BY s, pos, lvl
), proofs AS (SELECT s, pos, string_agg(concat(l, r), '' ORDER BY lvl) AS hashes FROM steps GROUP BY s, pos
), folded AS (
  SELECT s, pos, 0 AS lvl, CASE WHEN bad THEN other ELSE leaf END AS node FROM leaves
  UNION ALL
  SELECT f.s, f.pos, f.lvl + 1, sha256(concat(p.l, f.node, p.r)) FROM folded f JOIN steps p ON p.s = f.s AND p.pos = f.pos AND p.lvl = f.lvl
), ends AS (SELECT s, pos, arg_max(node, lvl) AS folded_root FROM folded GROUP BY s, pos)
SELECT l.doc_id, l.leaf, u.subroot, root.root, sha256(coalesce(p.hashes, '')) AS proof_sha256, e.folded_root, e.folded_root = root.root AS verified
FROM leaves l JOIN subroots u ON u.s = l.s JOIN ends e ON e.s = l.s AND e.pos = l.pos LEFT JOIN proofs p ON p.s = l.s AND p.pos = l.pos, root
"""

ORACLE = {
    "op3_near_duplicate_vectors": OP3,
    "op5_ngram_join": OP5,
    "op6_exact_duplicates": OP6,
    "op8_mix_sources": OP8,
    "op10_line_dedup": OP10,
    "op12_merkle_manifest": OP12,
}
