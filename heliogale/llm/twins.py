"""SQL twins that are longer than a few lines."""

CRC32 = """list_reduce([4294967295::BIGINT] || list_transform(range(strlen({0})), lambda k: ('0x' || hex(encode({0}))[2 * k + 1:2 * k + 2])::BIGINT),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))"""

MERKLE_SQL = r"""
WITH RECURSIVE parts AS (
  SELECT doc_id, source, text, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
      || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS front,
    {crc} % 2 = 1 AS hit  -- the last step of a crc32 turns its last bit
  FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') AS id_text FROM documents)),
digests AS (
  SELECT doc_id, source, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND hit AND contains(text, chr(10))
      THEN sha256(front || strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '')) END AS changed
  FROM parts),
leaves AS (
  SELECT *, coalesce('1' || source, '0') AS tree, row_number() OVER () AS id,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, changed) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n
  FROM digests),
nodes(tree, lvl, pos, digest, n) AS (
  SELECT tree, 0, pos, leaf, n FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM nodes WHERE n > 1
  GROUP BY tree, lvl, pos // 3, n),
subroots AS (SELECT tree, lvl, digest AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
top(lvl, pos, digest, n) AS (
  SELECT 0, pos, subroot, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM top WHERE n > 1
  GROUP BY lvl, pos // 3, n),
roots AS (SELECT digest AS root FROM top WHERE n = 1),
places AS (  -- every leaf's ancestors: in its source's tree, then in the tree of the sources
  SELECT l.id, k.lvl AS step, l.tree, k.lvl, l.pos // CAST(3 ** k.lvl AS BIGINT) AS pos
  FROM leaves l JOIN subroots s USING (tree) JOIN (SELECT unnest(range(40)) AS lvl) k ON k.lvl < s.lvl
  UNION ALL
  SELECT l.id, s.lvl + k.lvl, NULL, k.lvl, s.pos // CAST(3 ** k.lvl AS BIGINT)
  FROM leaves l JOIN subroots s USING (tree) JOIN (SELECT unnest(range(40)) AS lvl) k ON k.lvl < (SELECT max(lvl) FROM top)),
forest AS (SELECT tree, lvl, pos, digest FROM nodes UNION ALL SELECT NULL, lvl, pos, digest FROM top),
steps AS (
  SELECT p.id, p.step, coalesce(string_agg(f.digest, '' ORDER BY f.pos) FILTER (f.pos < p.pos), '') AS before,
    coalesce(string_agg(f.digest, '' ORDER BY f.pos) FILTER (f.pos > p.pos), '') AS after
  FROM places p JOIN forest f ON f.tree IS NOT DISTINCT FROM p.tree AND f.lvl = p.lvl AND f.pos // 3 = p.pos // 3
  GROUP BY p.id, p.step),
fold(id, step, h) AS (
  SELECT id, 0, coalesce(changed, leaf) FROM leaves
  UNION ALL
  SELECT f.id, f.step + 1, sha256(s.before || f.h || s.after) FROM fold f JOIN steps s ON s.id = f.id AND s.step = f.step),
ends AS (SELECT id, arg_max(h, step) AS folded_root FROM fold GROUP BY id),
proofs AS (SELECT id, string_agg(before || after, '' ORDER BY step) AS siblings FROM steps GROUP BY id)
SELECT l.doc_id, l.leaf, s.subroot, r.root, sha256(coalesce(p.siblings, '')) AS proof_sha256, e.folded_root, e.folded_root = r.root AS verified
FROM leaves l JOIN subroots s USING (tree) CROSS JOIN roots r JOIN ends e USING (id) LEFT JOIN proofs p USING (id)
""".replace("{crc}", CRC32.format("id_text"))

RESAMPLE_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') AS w
  FROM documents),
target_words AS (
  SELECT regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') AS w
  FROM benchmark),
numbered AS (SELECT row_number() OVER () AS id, doc_id, coalesce(w, []) AS w FROM words),
places AS (SELECT id, w, unnest(range(len(w))) AS p FROM numbered),
target_places AS (SELECT w, unnest(range(len(w))) AS p FROM target_words),
features AS (
  SELECT id, array_to_string(w[p + 1:p + k], ' ') AS feature, count(*) AS n
  FROM places, (VALUES (1), (2), (3)) sizes(k) WHERE p + k <= len(w) GROUP BY ALL),
target_features AS (
  SELECT array_to_string(w[p + 1:p + k], ' ') AS feature, count(*) AS n
  FROM target_places, (VALUES (1), (2), (3)) sizes(k) WHERE p + k <= len(w) GROUP BY ALL),
distinct_features AS (SELECT feature FROM features UNION SELECT feature FROM target_features),
hashed AS (SELECT feature, (4294967295 - {crc}) % 10000 AS bucket FROM distinct_features),
counts AS (SELECT bucket, sum(n) AS s FROM features JOIN hashed USING (feature) GROUP BY bucket),
target_counts AS (SELECT bucket, sum(n) AS t FROM target_features JOIN hashed USING (feature) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM counts) + 10000)
      / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM target_counts) + 10000)))) AS BIGINT) AS gain
  FROM counts FULL JOIN target_counts USING (bucket)),
weights AS (SELECT id, sum(n) AS n_features, sum(n * gain) AS weight FROM features JOIN hashed USING (feature) JOIN gains USING (bucket) GROUP BY id),
scored AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM numbered LEFT JOIN weights USING (id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= n * 5 // 100 THEN place END AS rank FROM ranked
""".replace("{word}", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").replace("{crc}", CRC32.format("feature"))
