"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

# H of a row: sha256 of its fields, each as byte count, ':' and value, '-' for null.
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR) END"
_REST = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# CRC-32 of the decimal id, bit by bit: a byte is folded in, then eight shifts (the -1 entries).
_CRC = (
    "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),"
    " lambda d: list_prepend(CAST(ascii(d) AS BIGINT), [CAST(-1 AS BIGINT) FOR k IN range(8)])))),"
    " lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"
)

OP12_MERKLE_MANIFEST = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, lang, sha256({_REST} || {_FIELD.format('text')}) AS leaf,
    CASE WHEN {_CRC} % 3 = 0 THEN sha256({_REST} || {_FIELD.format(_LOWERED)}) END AS lowered
  FROM documents
), groups AS (
  SELECT lang, ROW_NUMBER() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, COUNT(*) OVER () AS n FROM (SELECT DISTINCT lang FROM documents) g
), leaves AS (
  SELECT h.doc_id, g.tree, ROW_NUMBER() OVER (PARTITION BY g.tree ORDER BY h.doc_id NULLS FIRST, h.leaf) - 1 AS pos,
    COUNT(*) OVER (PARTITION BY g.tree) AS n, h.leaf, COALESCE(h.lowered, h.leaf) AS changed
  FROM hashed h JOIN groups g ON h.lang IS NOT DISTINCT FROM g.lang
), levels AS (
  SELECT tree, 0 AS level, pos, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 8, (ANY_VALUE(n) + 7) // 8, sha256(STRING_AGG(digest, '' ORDER BY pos)) FROM levels WHERE n > 1 GROUP BY tree, level, pos // 8
), tops AS (
  SELECT l.tree, l.level, l.digest, g.tree AS pos, g.n FROM levels l JOIN groups g ON l.tree = g.tree WHERE l.n = 1
), root_levels AS (
  SELECT 0 AS level, pos, n, digest FROM tops
  UNION ALL
  SELECT level + 1, pos // 8, (ANY_VALUE(n) + 7) // 8, sha256(STRING_AGG(digest, '' ORDER BY pos)) FROM root_levels WHERE n > 1 GROUP BY level, pos // 8
), nodes AS (
  SELECT tree, level, pos, digest FROM levels WHERE n > 1
  UNION ALL
  SELECT -1, level, pos, digest FROM root_levels WHERE n > 1
), runs AS (
  SELECT tree, level, pos // 8 AS run, LIST(digest ORDER BY pos) AS children FROM nodes GROUP BY tree, level, pos // 8
), climb AS (
  SELECT l.tree AS own, l.pos AS own_at, 0 AS steps, CASE WHEN l.n > 1 THEN l.tree ELSE -1 END AS tree, 0 AS level,
    CASE WHEN l.n > 1 THEN l.pos ELSE l.tree END AS pos, l.changed AS folded, '' AS siblings, t.level AS height
  FROM leaves l JOIN tops t ON t.tree = l.tree
  UNION ALL
  SELECT c.own, c.own_at, c.steps + 1, CASE WHEN c.tree >= 0 AND c.level + 1 = c.height THEN -1 ELSE c.tree END,
    CASE WHEN c.tree >= 0 AND c.level + 1 = c.height THEN 0 ELSE c.level + 1 END,
    CASE WHEN c.tree >= 0 AND c.level + 1 = c.height THEN c.own ELSE r.run END,
    sha256(array_to_string(list_transform(r.children, lambda x, i: CASE WHEN i - 1 = c.pos % 8 THEN c.folded ELSE x END), '')),
    array_to_string(list_filter(r.children, lambda x, i: i - 1 <> c.pos % 8), ''), c.height
  FROM climb c JOIN runs r ON r.tree = c.tree AND r.level = c.level AND r.run = c.pos // 8
), ways AS (
  SELECT own, own_at, sha256(STRING_AGG(siblings, '' ORDER BY steps)) AS proof_sha256, ARG_MAX(folded, steps) AS folded_root FROM climb GROUP BY own, own_at
), top_root AS (SELECT digest AS root FROM root_levels WHERE n = 1)
SELECT l.doc_id, l.leaf, t.digest AS subroot, r.root, w.proof_sha256, w.folded_root, w.folded_root = r.root AS verified
FROM leaves l JOIN tops t ON t.tree = l.tree JOIN ways w ON w.own = l.tree AND w.own_at = l.pos CROSS JOIN top_root r
"""

# Words of the pieces of every text, phrases of two to five of them, and the
# lowest-scoring cut of each; products in 128-bit integers.
OP13_PHRASE_COLLOCATIONS = r"""
WITH pieces AS (
  SELECT COALESCE(lang, 'und') AS lang, UNNEST(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(SUM(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
), spans AS (
  SELECT lang, w, UNNEST(range(1, len(w) + 1)) AS i FROM words
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM spans, (SELECT UNNEST(range(1, 6)) AS k) s WHERE i + k - 1 <= len(w)
), counts AS (
  SELECT lang, k, phrase, COUNT(*) AS a FROM grams GROUP BY lang, k, phrase HAVING COUNT(*) >= 100
), cuts AS (
  SELECT lang, phrase, a, k, string_split(phrase, ' ') AS w, UNNEST(range(1, k)) AS cut FROM counts WHERE k > 1
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, c.cut, l.a AS l, r.a AS r, t.n,
    CAST((CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1:], ' ')
  JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT * FROM scored QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), longer AS (
  SELECT lang, a, array_to_string(w[1:k - 1], ' ') AS phrase FROM cuts
  UNION
  SELECT lang, a, array_to_string(w[2:], ' ') FROM cuts
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM longer x WHERE x.lang = b.lang AND x.phrase = b.phrase AND x.a >= b.a)
), ranked AS (
  SELECT lang, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept
)
SELECT * FROM ranked WHERE rank <= 2000
"""

# Words of a text; base counts and the base rule. A cutoff needs enough good labels in both halves of a
# stratum; a stratum with fewer than twice that number certifies nothing, so its documents pass if the base rule
# does. Where there are more, the verdict depends on the halves, which SQL cannot cut alike: NULL.
OP5_QUALITY_RULES = r"""
WITH texts AS (
  SELECT doc_id, COALESCE(lang, '∅') AS stratum, COALESCE(text, '') AS text, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), rows AS (SELECT ROW_NUMBER() OVER () AS rid, * FROM texts),
windows AS (
  SELECT rid, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT rid, w, UNNEST(range(1, len(w) - 1)) AS i FROM rows) x
), twice AS (SELECT rid, g FROM windows GROUP BY rid, g HAVING COUNT(*) > 1),
repeated AS (
  SELECT rid, COUNT(DISTINCT i + k) AS n FROM windows SEMI JOIN twice USING (rid, g), (SELECT UNNEST([0, 1, 2]) AS k) o GROUP BY rid
), lines AS (
  SELECT rid, line, COUNT(*) AS n FROM (SELECT rid, UNNEST(string_split(text, chr(10))) AS line FROM rows) x WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid, line
), dup AS (SELECT rid, CAST(SUM(n - 1) AS BIGINT) AS n FROM lines GROUP BY rid),
counts AS (
  SELECT r.rid, r.doc_id, r.stratum, CAST(len(r.w) AS BIGINT) AS n_words, CAST(length(array_to_string(r.w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(r.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, COALESCE(d.n, 0) AS n_dup_lines, COALESCE(p.n, 0) AS n_repeat_words
  FROM rows r LEFT JOIN dup d USING (rid) LEFT JOIN repeated p USING (rid)
), judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
truth AS (SELECT doc_id, MAX(CAST(quality AS INTEGER)) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT j.stratum, COUNT(*) FILTER (WHERE t.good > 0) AS n_good FROM judged j JOIN truth t USING (doc_id) WHERE NOT j.base_failed GROUP BY j.stratum),
needed AS (SELECT 2 * CEIL(LN(0.05 / GREATEST(COUNT(*), 1)) / LN(1 - 0.02)) AS n FROM held)
SELECT j.doc_id, j.n_words, j.word_chars, j.n_symbols, j.n_dup_lines, j.n_repeat_words, j.base_failed,
  CASE WHEN j.base_failed THEN FALSE WHEN COALESCE(h.n_good, 0) < (SELECT n FROM needed) THEN TRUE END AS kept
FROM judged j LEFT JOIN held h ON h.stratum = j.stratum
"""

# Bytes as pairs of hexadecimal digits; windows are cut from pieces of a text, so that none is sought from its start.
OP7_SUFFIX_DEDUP = """
WITH texts AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h FROM documents),
pieces AS (SELECT doc_id, base, substr(h, 2 * base + 1, 2 * (1000 + 49)) AS piece FROM (SELECT doc_id, h, UNNEST(range(0, len(h) // 2, 1000)) AS base FROM texts) x),
windows AS (SELECT doc_id, base + k AS i, substr(piece, 2 * k + 1, 100) AS g FROM (SELECT doc_id, base, piece, UNNEST(range(0, LEAST(1000, len(piece) // 2 - 49))) AS k FROM pieces WHERE len(piece) >= 100) x),
first AS (SELECT g, MIN(doc_id) AS doc_id FROM windows GROUP BY g HAVING MIN(doc_id) < MAX(doc_id)),
gone AS (SELECT w.doc_id, w.i FROM windows w JOIN first f ON f.g = w.g AND f.doc_id < w.doc_id),
marked AS (SELECT doc_id, i, CASE WHEN i <= LAG(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM gone),
numbered AS (SELECT doc_id, i, SUM(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
runs AS (SELECT doc_id, run, MIN(i) AS a, MAX(i) + 50 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, COALESCE(LAG(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
cut AS (
  SELECT t.doc_id, SUM(g.b - g.a) AS n_removed, COUNT(*) AS n_spans, MAX(g.b) AS last,
    STRING_AGG(substr(t.h, 2 * g.before + 1, 2 * (g.a - g.before)), '' ORDER BY g.a) AS kept
  FROM gaps g JOIN texts t USING (doc_id) GROUP BY t.doc_id
)
SELECT t.doc_id, CAST(len(t.h) // 2 AS BIGINT) AS n_bytes, CAST(COALESCE(c.n_removed, 0) AS BIGINT) AS n_removed, COALESCE(c.n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN c.doc_id IS NULL THEN t.h ELSE c.kept || substr(t.h, 2 * c.last + 1) END)) AS kept_sha256
FROM texts t LEFT JOIN cut c ON c.doc_id = t.doc_id
"""

OP8_MINHASH_DEDUP = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, g FROM (SELECT doc_id, UNNEST(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM words) x
), sizes AS (SELECT doc_id, COUNT(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM shared JOIN sizes sx ON sx.doc_id = x JOIN sizes sy ON sy.doc_id = y WHERE 100 * c >= 80 * (sx.n + sy.n - c)
), steps AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id, doc_id AS seen FROM documents
  UNION
  SELECT r.doc_id, s.y FROM reach r JOIN steps s ON s.x = r.seen
), least AS (SELECT doc_id, MIN(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, COALESCE(s.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN least l ON l.doc_id = d.doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op5_quality_rules": OP5_QUALITY_RULES,
    "op7_suffix_dedup": OP7_SUFFIX_DEDUP,
    "op8_minhash_dedup": OP8_MINHASH_DEDUP,
    "op12_merkle_manifest": OP12_MERKLE_MANIFEST,
    "op13_phrase_collocations": OP13_PHRASE_COLLOCATIONS,
}
