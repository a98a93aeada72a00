"""DuckDB twins of the registered queries, written from the contracts."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = rf"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (
  SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w)),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS rn FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM ranked WHERE rn > 1),
each AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (
  SELECT e.doc_id, count(*) AS n_kept, string_agg(e.ws[e.p], ' ' ORDER BY e.p) AS t
  FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n_kept, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

JACCARD_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * o >= 85 * (x.c + y.c - o)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.v FROM r JOIN l ON l.u = r.other)
SELECT r.doc_id, coalesce(any_value(n.c), 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null')) AS o FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (
  SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::INT AS turn FROM s0),
s2 AS (SELECT *, ([5, 2, 1])[turn + 1]::DOUBLE AS weight FROM s1),
s3 AS (
  SELECT *, 2.0::DOUBLE * source_size::DOUBLE / weight AS ratio,
    (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
      - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, turn, source NULLS LAST
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (ORDER BY source_size / weight, turn, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM s2),
l AS (SELECT max(lvl) AS level FROM s3),
s AS (
  SELECT source, source_size, turn,
    CASE WHEN source_size > 0 THEN least(source_size::DOUBLE * 2.0::DOUBLE, weight * coalesce(level, 'inf'::DOUBLE)) ELSE 0.0::DOUBLE END AS target
  FROM s3, l),
p AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, s.turn,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c,
    CASE WHEN s.source_size > 0 THEN floor(s.target / s.source_size::DOUBLE)::BIGINT ELSE 0 END AS passes
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
q AS (SELECT *, floor(target - (passes * source_size)::DOUBLE + 0.5::DOUBLE)::BIGINT AS rest FROM p),
t AS (SELECT *, least(greatest(rest - c, 0), size) AS last FROM q),
y AS (
  SELECT *, least((c::DOUBLE + (CASE WHEN passes > 0 THEN size ELSE last END)::DOUBLE / 2.0::DOUBLE) / target, 1.0::DOUBLE) AS y FROM t)
SELECT doc_id, size, source_size, target, (passes * size + last)::BIGINT AS taken,
  CASE WHEN size > 0 AND passes + (last > 0)::BIGINT > 0 THEN
    CASE turn
      WHEN 0 THEN CASE WHEN y <= 0 THEN 0.0::DOUBLE ELSE 0.0::DOUBLE + 2.0::DOUBLE * y / (1.5::DOUBLE + sqrt(2.25::DOUBLE + -2.0::DOUBLE * y)) END
      WHEN 1 THEN CASE WHEN y <= 0 THEN 0.0::DOUBLE ELSE 0.0::DOUBLE + 2.0::DOUBLE * y / (1.0::DOUBLE + sqrt(1.0::DOUBLE + 0.0::DOUBLE * y)) END
      ELSE CASE WHEN y < 0.375::DOUBLE
        THEN CASE WHEN y <= 0 THEN 0.0::DOUBLE ELSE 0.0::DOUBLE + 2.0::DOUBLE * y / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2.0::DOUBLE * y)) END
        ELSE CASE WHEN y - 0.375::DOUBLE <= 0 THEN 0.5::DOUBLE ELSE 0.5::DOUBLE + 2.0::DOUBLE * (y - 0.375::DOUBLE) / (1.0::DOUBLE + sqrt(1.0::DOUBLE + 2.0::DOUBLE * (y - 0.375::DOUBLE))) END
        END
    END END AS position
FROM y
"""

FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

TOPK_SEARCH = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND {FINITE}),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s) WHERE rank <= 5
"""

URL_FILTER = r"""
WITH rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (
  SELECT page_id, row_number() OVER () AS n,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
f AS (
  SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN f USING (n)
"""

LATTICE_DEDUP = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n
  FROM embeddings WHERE {FINITE}),
l AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.n > 0 AND b.n > 0 AND list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) / (a.n * b.n) >= 0.95),
r(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.w FROM r JOIN l ON l.u = r.other),
c AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id)
SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.u = c.vec_id)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM c
"""

WARC = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p GROUP BY d),
bits AS (
  SELECT page_id, octet_length(b) AS n, p.d, first,
    list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
      ((('0x' || substr(p.d || '0000', 1 + 2 * ((5 * i) // 8), 4))::BIGINT >> (11 - (5 * i) % 8)) & 31)::INT, 1)) AS digits
  FROM p JOIN f USING (d))
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(digits, '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM bits
"""

IMPORTANCE = r"""
WITH crc_table AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS crc
  FROM (SELECT unnest(range(256))::BIGINT AS b)),
texts AS (
  SELECT 0 AS side, doc_id AS id, row_number() OVER () AS r, text FROM documents
  UNION ALL SELECT 1, item_id, row_number() OVER (), text FROM benchmark),
w AS (
  SELECT side, id, r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
f AS (
  SELECT side, r, array_to_string(ws[i:i + n], ' ') AS k
  FROM (SELECT side, r, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), (SELECT unnest([0, 1, 2]) AS n)
  WHERE i + n <= len(ws)),
g AS (SELECT side, r, k, count(*) AS c FROM f GROUP BY ALL),
names AS (
  SELECT k, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(k) + 1), lambda p: ('0x' || substr(h, (2 * p - 1)::INT, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT k, hex(encode(k)) AS h FROM (SELECT DISTINCT k FROM g)), (SELECT crc AS t FROM crc_table)),
n AS (
  SELECT b.bucket, coalesce(sum(c) FILTER (side = 0), 0)::BIGINT AS s, coalesce(sum(c) FILTER (side = 1), 0)::BIGINT AS t
  FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN names USING (bucket) LEFT JOIN g USING (k) GROUP BY b.bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM n),
d AS (
  SELECT id AS doc_id, len(ws) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (('0x' || sha256('42:' || coalesce(id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE AS u
  FROM w LEFT JOIN (
    SELECT r, sum(c) AS n_features, sum(c * gain) AS weight FROM g JOIN names USING (k) JOIN gain USING (bucket)
    WHERE side = 0 GROUP BY r) USING (r)
  WHERE side = 0),
e AS (SELECT doc_id, n_words, n_features, weight, (weight + floor(-1000 * ln(-ln(u))))::BIGINT AS score FROM d),
o AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) OVER (PARTITION BY n_words >= 20) AS n FROM e)
SELECT doc_id, n_features, weight, score,
  (CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END)::BIGINT AS rank FROM o
"""

HARD_NEGATIVES = f"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND {FINITE}),
pairs AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other,
    list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score, (row_number() OVER w)::INT AS positive_rank
  FROM pairs WHERE same
  WINDOW w AS (PARTITION BY anchor_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other AS negative_id, positive_score,
  score AS negative_score, positive_rank
FROM p JOIN pairs USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_rank ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 10
"""
