"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from basketry.llm.license_texts import TEMPLATES

ORACLE: dict[str, str] = {}

_TEMPLATES = ", ".join("({}, {})".format(*("'" + x.replace("'", "''") + "'" for x in item)) for item in TEMPLATES.items())

ORACLE["op1_license_scan"] = f"""
WITH numbered AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), units AS (
  SELECT r, 'text' AS unit, text AS part FROM numbered
  UNION ALL SELECT r, 'block', unnest(string_split(text, chr(10) || chr(10))) FROM numbered
  UNION ALL SELECT r, 'line', unnest(string_split(text, chr(10))) FROM numbered
), worded AS (
  SELECT row_number() OVER () AS u, r, unit, regexp_extract_all(part, '[A-Za-z0-9]+') AS w FROM units
), pairs AS (
  SELECT u, p, count(*) AS n
  FROM (SELECT u, unnest(list_transform(range(1, len(w)), lambda i: lower(w[i]) || ' ' || lower(w[i + 1]))) AS p FROM worded)
  GROUP BY u, p
), sizes AS (
  SELECT u, sum(n) AS size FROM pairs GROUP BY u
), templates AS (
  SELECT license, regexp_extract_all(body, '[A-Za-z0-9]+') AS w FROM (VALUES {_TEMPLATES}) t(license, body)
), known AS (
  SELECT license, p, count(*) AS n
  FROM (SELECT license, unnest(list_transform(range(1, len(w)), lambda i: lower(w[i]) || ' ' || lower(w[i + 1]))) AS p FROM templates)
  GROUP BY license, p
), known_sizes AS (
  SELECT license, sum(n) AS size FROM known GROUP BY license
), matches AS (
  SELECT r, license, 2.0::DOUBLE * shared / (s.size + k.size)::DOUBLE AS dice
  FROM (SELECT u, license, sum(least(pairs.n, known.n))::DOUBLE AS shared FROM pairs JOIN known USING (p) GROUP BY u, license)
  JOIN sizes s USING (u) JOIN known_sizes k USING (license) JOIN worded USING (u)
  WHERE 2.0::DOUBLE * shared / (s.size + k.size)::DOUBLE >= 0.8
)
SELECT doc_id, count(license) AS n_matches, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
       (list(license ORDER BY dice DESC, license))[1] AS best_license, coalesce(max(dice), 0.0::DOUBLE) AS best_dice
FROM numbered LEFT JOIN matches USING (r) GROUP BY r, doc_id
"""

# Sources are taken in turn of their bound per weight: a source is at its bound if the level of
# those not yet taken is above it.
ORACLE["op5_source_mix"] = """
WITH named AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         coalesce(doc_id::VARCHAR, 'null') || '/' || md5(coalesce(text, '')) AS name
  FROM documents
), first_drawn AS (
  SELECT doc_id, source, size, ('0x' || substr(md5(name), 1, 15))::BIGINT AS draw FROM named
), words AS (
  SELECT doc_id, source, size, CASE WHEN n = 0 THEN draw ELSE ('0x' || substr(md5(draw || '/' || n), 1, 15))::BIGINT END AS draw
  FROM (SELECT *, row_number() OVER (PARTITION BY source, draw) - 1 AS n FROM first_drawn)
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM words GROUP BY source
), weighted AS (
  SELECT *, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM sources
), turns AS (
  SELECT *, 3 * source_size AS bound,
         sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS words_left,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left
  FROM weighted
  WINDOW before AS (ORDER BY source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT coalesce(arg_min(words_left::DOUBLE / weight_left::DOUBLE, source_size / weight)
                  FILTER (WHERE NOT bound < (words_left::DOUBLE / weight_left::DOUBLE) * weight), 0) AS level
  FROM turns
), targets AS (
  SELECT source, source_size, CASE WHEN bound < level * weight THEN bound::DOUBLE ELSE level * weight END AS target
  FROM turns, level
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets
), summed AS (
  SELECT source, draw, sum(size)::BIGINT AS inside FROM words GROUP BY source, draw
), running AS (
  SELECT s.source, draw, inside, target - whole * source_size AS budget,
         sum(inside) OVER (PARTITION BY s.source ORDER BY draw) AS upto
  FROM summed s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
), boundary AS (
  SELECT source, arg_min(CASE WHEN upto - budget < budget - (upto - inside) THEN draw ELSE draw - 1 END, draw) AS cut
  FROM running WHERE upto > budget GROUP BY source
)
SELECT doc_id, w.size, p.source_size, p.target,
       (w.size * (whole + (draw <= coalesce(cut, -1))::INT))::BIGINT AS taken,
       (whole + (draw <= coalesce(cut, -1))::INT)::INT AS copies
FROM words w JOIN plan p ON w.source IS NOT DISTINCT FROM p.source
LEFT JOIN boundary b ON w.source IS NOT DISTINCT FROM b.source
"""

ORACLE["op6_exact_top_k"] = """
WITH vectors AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.r <> c.r WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

ORACLE["op7_embedding_near_dedup"] = """
WITH RECURSIVE vectors AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
), usable AS (
  SELECT * FROM vectors
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.r AS x, b.r AS y FROM usable a JOIN usable b ON a.label = b.label AND a.r <> b.r
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT r AS x, r AS y FROM vectors
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), smallest AS (
  SELECT x, min(vec_id) AS component_id FROM reach JOIN vectors ON r = y GROUP BY x
)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.x = r)::BIGINT AS n_links, component_id,
       coalesce(vec_id = component_id, FALSE) AS kept
FROM vectors JOIN smallest ON x = r
"""

ORACLE["op9_line_dedup"] = """
WITH numbered AS (SELECT *, row_number() OVER () AS r FROM documents
), parts AS (
  SELECT r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM numbered
), lines AS (
  SELECT r, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS place FROM parts
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, min(coalesce(doc_id, 9223372036854775807)) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key
  HAVING count(DISTINCT coalesce(doc_id, 9223372036854775807)) > 1
), marked AS (
  SELECT k.*, coalesce(k.doc_id, 9223372036854775807) > p.first AS gone FROM keyed k LEFT JOIN repeated p ON k.key = p.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE gone IS NOT TRUE), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""

ORACLE["op10_ngram_jaccard_join"] = """
WITH RECURSIVE worded AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT r, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS gram
  FROM worded WHERE len(w) > 0 AND doc_id IS NOT NULL
), sizes AS (
  SELECT r, count(*) AS size FROM grams GROUP BY r
), shared AS (
  SELECT a.r AS x, b.r AS y, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.r < b.r GROUP BY a.r, b.r
), near AS (
  SELECT x, y FROM shared JOIN sizes s ON s.r = x JOIN sizes t ON t.r = y WHERE n / (s.size + t.size - n) >= 0.8
), links AS (
  SELECT x, y FROM near UNION ALL SELECT y, x FROM near
), reach AS (
  SELECT x, x AS y FROM (SELECT DISTINCT x FROM links)
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), classes AS (
  SELECT reach.x, min(doc_id) AS class_id FROM reach JOIN worded ON worded.r = reach.y GROUP BY reach.x
)
SELECT doc_id, (SELECT count(*) FROM links WHERE links.x = r)::BIGINT AS n_links, coalesce(class_id, doc_id) AS class_id,
       coalesce(doc_id = coalesce(class_id, doc_id), FALSE) AS kept
FROM worded LEFT JOIN classes ON classes.x = worded.r
"""

def _crc32(text: str) -> str:
    """CRC-32 of a text of single-byte characters, bit by bit."""
    byte = "list_transform(string_split({0}, ''), lambda d: ascii(d)::BIGINT)".format(text)
    bits = "list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(c, b))"
    return f"xor(list_reduce({byte}, lambda c, b: {bits}, 4294967295::BIGINT), 4294967295::BIGINT)"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


_ROW = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op12_merkle_manifest"] = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS r, doc_id, lang, sha256({_ROW} || {_field('text')}) AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {_crc32('coalesce(doc_id, 0)::VARCHAR')} % 3 = 0
              THEN sha256({_ROW} || {_field(_LOWERED)}) ELSE sha256({_ROW} || {_field('text')}) END AS other
  FROM documents
), numbered AS (
  SELECT *, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS t, count(*) OVER (PARTITION BY lang) AS width,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos
  FROM leaves
), low AS (
  SELECT t, 0 AS level, pos, width, leaf AS hash FROM numbered
  UNION ALL
  SELECT t, level + 1, pos // 8, (any_value(width) + 7) // 8, sha256(string_agg(hash, '' ORDER BY pos))
  FROM low WHERE width > 1 GROUP BY t, level, pos // 8
), subroots AS (
  SELECT t, hash AS subroot FROM low WHERE width = 1
), high AS (
  SELECT -1::BIGINT AS t, 0 AS level, t AS pos, count(*) OVER () AS width, subroot AS hash FROM subroots
  UNION ALL
  SELECT t, level + 1, pos // 8, (any_value(width) + 7) // 8, sha256(string_agg(hash, '' ORDER BY pos))
  FROM high WHERE width > 1 GROUP BY t, level, pos // 8
), nodes AS (
  SELECT * FROM low UNION ALL SELECT * FROM high
), steps AS (
  SELECT t, level, pos, t AS up_t, level + 1 AS up_level, pos // 8 AS up_pos,
         coalesce(string_agg(hash, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(hash, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind, TRUE AS hashed
  FROM nodes WHERE width > 1 WINDOW run AS (PARTITION BY t, level, pos // 8 ORDER BY pos)
  UNION ALL
  SELECT t, level, pos, -1, 0, t, '', '', FALSE FROM low WHERE width = 1
), climbing AS (
  SELECT r, t, 0 AS level, pos, '' AS proof, other AS folded FROM numbered
  UNION ALL
  SELECT r, up_t, up_level, up_pos, proof || before || behind, CASE WHEN hashed THEN sha256(before || folded || behind) ELSE folded END
  FROM climbing JOIN steps USING (t, level, pos)
), top AS (
  SELECT level, hash AS root FROM high WHERE width = 1
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM numbered n JOIN subroots s ON s.t = n.t JOIN climbing c ON c.r = n.r AND c.t = -1 JOIN top ON top.level = c.level
"""

# A node's key is the digests of its turns, one after the other; 64 digits each.
ORACLE["op13_prefix_trie"] = f"""
WITH said AS (
  SELECT conv_id AS c, turn, coalesce(text, '') AS text,
         sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) AS p FROM said
), convs AS (
  SELECT c, count(*) AS n, c - c % 100 AS lender, {_crc32('c::VARCHAR')} % 6 AS h FROM own GROUP BY c
), lent AS (
  SELECT v.*, least(h, coalesce(l.n, 0)) AS k FROM convs v LEFT JOIN (SELECT c, n FROM convs) l ON l.c = v.lender
), rebuilt AS (
  SELECT v.c, o.p AS d, o.digest, o.text FROM lent v JOIN own o ON o.c = v.lender AND o.p <= v.h
  UNION ALL
  SELECT v.c, o.p - h + k, o.digest, o.text FROM lent v JOIN own o ON o.c = v.c AND o.p > v.h
), prefixes AS (
  SELECT c, d, string_agg(digest, '') OVER (PARTITION BY c ORDER BY d) AS prefix, length(text) AS chars,
         d = max(d) OVER (PARTITION BY c) AS ends
  FROM rebuilt
  UNION ALL
  SELECT c, 0, '', 0, c NOT IN (SELECT c FROM rebuilt) FROM convs
), nodes AS (
  SELECT prefix, min(c) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY prefix
), children AS (
  SELECT left(prefix, length(prefix) - 64) AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), weighed AS (
  SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (prefix)
), below AS (
  SELECT left(prefix, 64 * unnest(range(depth + 1))::INT) AS prefix, saved, n_children FROM weighed
), sums AS (
  SELECT prefix, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM below GROUP BY prefix
)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM weighed w JOIN sums USING (prefix) LEFT JOIN nodes p ON w.depth > 0 AND p.prefix = left(w.prefix, length(w.prefix) - 64)
"""
