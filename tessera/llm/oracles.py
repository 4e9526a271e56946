"""DuckDB statements for the queries that SQL can express."""

EXACT_DEDUP = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM rows
WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""

MIXING = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null' || md5(coalesce(text, ''))) || ':mix') AS place
  FROM documents
), sources AS (
  SELECT source, sum(size)::DOUBLE AS source_size FROM rows GROUP BY source
), weighted AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS full_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS weight
  FROM sources
), parts AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(full_size) OVER w, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS rest_weight
  FROM weighted
  WINDOW w AS (ORDER BY full_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
  SELECT *, full_size * rest_weight <= rest * weight AS is_full FROM parts
), level AS (
  SELECT arg_max(rest, rest_weight) AS rest, max(rest_weight) AS rest_weight FROM marked WHERE NOT is_full
), goals AS (
  SELECT source, source_size, CASE WHEN is_full THEN full_size ELSE level.rest * weight / level.rest_weight END AS target FROM marked, level
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM rows
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (CASE WHEN source_size = 0 THEN 0 ELSE floor(floor(target + 0.5) / source_size) * size
         + greatest(0, least(size, floor(target + 0.5) - floor(floor(target + 0.5) / source_size) * source_size - start)) END)::BIGINT AS taken
FROM placed JOIN goals ON placed.source IS NOT DISTINCT FROM goals.source
"""

NEAR_DEDUP = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS s FROM rows
), each AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80 GROUP BY ALL
), links AS (
  SELECT a, b FROM shared WHERE 100 * c >= 80 * (na + nb - c)
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN both_ways l ON r.b = l.a
), least_of AS (
  SELECT a, min(b) AS component_id FROM reached GROUP BY a
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least_of ON doc_id = a
"""

SUBSTRING_DEDUP = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT r, i, array_to_string(w[i:i + 34], ' ') AS t FROM docs, unnest(range(1, len(w) - 33)) AS u(i)
), starts AS (
  SELECT r, i FROM windows WHERE t IN (SELECT t FROM windows GROUP BY t HAVING count(*) > 1)
), words AS (
  SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM docs
), judged AS (
  SELECT words.r, j, word, coalesce(max(i) OVER (PARTITION BY words.r ORDER BY j) >= j - 34, false) AS gone FROM words LEFT JOIN starts ON words.r = starts.r AND j = i
), kept AS (
  SELECT r, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY j) FILTER (NOT gone), '') AS text FROM judged GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (r)
"""

SQL: dict[str, str] = {"op3_near_dedup": NEAR_DEDUP, "op4_exact_dedup": EXACT_DEDUP, "op6_mixing": MIXING, "op8_substring_dedup": SUBSTRING_DEDUP}
