"""SQL for the text queries that SQL can express."""

OP3 = """
WITH words AS (
  SELECT 0 AS kind, item_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
  UNION ALL
  SELECT 1, doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), starts AS (
  SELECT kind, id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0
), shingles AS (
  SELECT DISTINCT kind, id, array_to_string(w[i:least(i + 4, len(w))], ' ') AS s FROM starts
), sizes AS (SELECT id AS item_id, count(*) AS n_shingles FROM shingles WHERE kind = 0 GROUP BY id),
pairs AS (
  SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared
  FROM shingles b JOIN shingles d ON b.kind = 0 AND d.kind = 1 AND b.s = d.s GROUP BY d.id, b.id
)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM pairs JOIN sizes USING (item_id) WHERE n_shared / n_shingles >= 0.75
"""

OP4 = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:least(i + 4, len(w))], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pair_counts AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM pair_counts JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT x, x AS y FROM (SELECT DISTINCT x FROM edges) UNION SELECT r.x, e.y FROM reached r JOIN edges e ON r.y = e.x),
least_of AS (SELECT x AS doc_id, min(y) AS component FROM reached GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, doc_id) AS component_id
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""

OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
d AS (SELECT page_id, n, sha256(html) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to
FROM f
"""

OP9 = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1
), places AS (SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, range(0, 20) t(k)),
kept AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS kept FROM places p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(lost.n, 0) AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

OP11 = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM split),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
),
frequent AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f USING (key) GROUP BY doc_id
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n_chars}", "text")) + ")"

OP12 = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY x) AS crc_of FROM (
    SELECT x, list_reduce(list_prepend(x, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS x))
), crcs AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295, bs), lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM (SELECT DISTINCT doc_id, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT) AS bs FROM documents WHERE doc_id IS NOT NULL), crc_table
), marked AS (
  SELECT d.*, coalesce(crc % 7 = 0, false) AS tampers FROM documents d LEFT JOIN crcs USING (doc_id)
), leaves AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_LEAF.format(n_chars='n_chars')} AS leaf,
    CASE WHEN tampers AND n_chars IS NOT NULL THEN {_LEAF.format(n_chars='(n_chars + 1)')} END AS tampered
  FROM marked
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves
), tiers AS (
  SELECT tree, 0 AS level, list(leaf ORDER BY place) AS hs FROM placed GROUP BY tree
  UNION ALL
  SELECT tree, level + 1, list_transform(range(1, len(hs) + 1, 2), lambda i: sha256(hs[i] || coalesce(hs[i + 1], ''))) FROM tiers WHERE len(hs) > 1
), subroots AS (
  SELECT tree, hs[1] AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place FROM tiers WHERE len(hs) = 1
), top_tiers AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS hs FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(1, len(hs) + 1, 2), lambda i: sha256(hs[i] || coalesce(hs[i + 1], ''))) FROM top_tiers WHERE len(hs) > 1
), steps AS (
  SELECT p.tree, p.place, t.level, xor(p.place >> t.level, 1) AS beside, t.hs FROM placed p JOIN tiers t ON p.tree = t.tree AND len(t.hs) > 1
  UNION ALL
  SELECT p.tree, p.place, 1000 + t.level, xor(s.place >> t.level, 1), t.hs FROM placed p JOIN subroots s ON p.tree = s.tree JOIN top_tiers t ON len(t.hs) > 1
), paths AS (
  SELECT tree, place, list(coalesce(CASE WHEN beside % 2 = 0 THEN 'L' ELSE 'R' END || hs[beside + 1], '-') ORDER BY level) AS path FROM steps GROUP BY tree, place
), folded AS (
  SELECT *, list_reduce(list_prepend(coalesce(tampered, leaf), coalesce(path, [])),
    lambda a, s: CASE s[1] WHEN 'L' THEN sha256(s[2:] || a) WHEN 'R' THEN sha256(a || s[2:]) ELSE sha256(a) END) AS folded_root
  FROM placed LEFT JOIN paths USING (tree, place)
)
SELECT doc_id, leaf, subroot, hs[1] AS root, sha256(array_to_string(list_transform(coalesce(path, []), lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = hs[1] AS verified
FROM folded JOIN subroots USING (tree) JOIN top_tiers ON len(hs) = 1
"""

STATEMENTS = {"op3_decontamination": OP3, "op4_ngram_join": OP4, "op8_capture_index": OP8, "op9_seed_extend": OP9, "op11_line_dedup": OP11, "op12_merkle_manifest": OP12}
