"""DuckDB SQL that must give the same rows as the queries of this subpackage."""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM sized GROUP BY source
), weighted AS (
  SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS weight, source_size * 2 AS cap FROM sources
), sums AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) AS total, CAST(sum(weight) OVER () AS BIGINT) AS weight_sum,
    CAST(coalesce(sum(cap) OVER r, 0) AS BIGINT) AS cap_before, CAST(coalesce(sum(weight) OVER r, 0) AS BIGINT) AS weight_before
  FROM weighted WINDOW r AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), judged AS (
  SELECT *, CAST(cap AS DOUBLE) * (weight_sum - weight_before) <= weight * (total - cap_before) AS capped FROM sums
), levels AS (
  SELECT *, (total - CAST(sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS BIGINT)) / (weight_sum - CAST(sum(CASE WHEN capped THEN weight ELSE 0 END) OVER () AS BIGINT)) AS level FROM judged
), targets AS (
  SELECT source, n_docs, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE weight * level END AS target FROM levels
), repeats AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE CAST(0 AS DOUBLE) END AS reps, CAST(floor(sqrt(n_docs)) AS BIGINT) AS salts FROM targets
), placed AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, floor(t.reps) AS whole, t.reps - floor(t.reps) AS fraction, CAST(floor(sqrt(d.size)) AS BIGINT) AS band,
    md5('42|' || coalesce(CAST(d.doc_id AS VARCHAR), '')) AS digest, t.salts
  FROM sized d JOIN repeats t ON d.source IS NOT DISTINCT FROM t.source
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY band, CAST('0x' || substr(digest, 1, 8) AS BIGINT) % salts, size, digest, doc_id) AS rank FROM placed
), tried AS (
  SELECT source, (2 * i + 1) / CAST(32 AS DOUBLE) AS start,
    abs(sum(size * (whole + floor(fraction * rank + (2 * i + 1) / CAST(32 AS DOUBLE)) - floor(fraction * (rank - 1) + (2 * i + 1) / CAST(32 AS DOUBLE)))) - max(target)) AS gap
  FROM ranked CROSS JOIN range(16) AS g(i) GROUP BY source, i
), chosen AS (
  SELECT source, start FROM tried QUALIFY row_number() OVER (PARTITION BY source ORDER BY gap, start) = 1
)
SELECT r.doc_id, r.size, r.source_size, r.target,
  CAST(r.size * (r.whole + floor(r.fraction * r.rank + c.start) - floor(r.fraction * (r.rank - 1) + c.start)) AS BIGINT) AS taken
FROM ranked r JOIN chosen c ON r.source IS NOT DISTINCT FROM c.source
"""

WARC = r"""
WITH digests AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), firsts AS (
  SELECT h, min(page_id) AS first_id FROM digests GROUP BY h
)
SELECT d.page_id, CAST(d.payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(d.h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN f.first_id IS NULL OR f.first_id = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first_id = d.page_id THEN NULL ELSE f.first_id END AS refers_to, TRUE AS verified
FROM digests d JOIN firsts f ON d.h = f.h
"""

LINES = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, -9223372036854775808) AS id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT rid, doc_id, id, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM docs
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key, max(id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT id) >= 3
), judged AS (
  SELECT k.*, c.key IS NOT NULL AND k.id <> c.keeper AS gone FROM keyed k LEFT JOIN common c USING (key)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM judged GROUP BY rid
"""

DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+') AS terms FROM documents
), found AS (
  SELECT lang, source, rid, term, count(*) AS n FROM (SELECT lang, source, rid, unnest(terms) AS term FROM docs) GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(n) AS total FROM found GROUP BY ALL HAVING count(*) >= 10
), counts AS (
  SELECT f.lang, f.source, f.term, sum(f.n) AS n FROM found f JOIN kept USING (lang, term) GROUP BY ALL
), langs AS (
  SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY lang
), held AS (
  SELECT lang, source, sum(n) AS held FROM counts GROUP BY ALL
), groups AS (
  SELECT g.lang, g.source, CAST(coalesce(h.held, 0) AS HUGEINT) AS held, CAST(coalesce(l.v, 0) AS HUGEINT) AS v, CAST(coalesce(l.lang_n, 0) AS HUGEINT) AS lang_n
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN held h USING (lang, source) LEFT JOIN langs l USING (lang)
), rated AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (g.held + 2 * g.v) AS BIGINT) AS p,
    CAST(1 + CAST(1000000000 AS HUGEINT) * (k.total + 2) // (g.lang_n + 2 * g.v) AS BIGINT) AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
  FROM rated a JOIN rated b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM rated WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

RESAMPLING = r"""
WITH words AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS words FROM documents
), target AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+')) AS feature FROM benchmark
), held AS (
  SELECT rid, feature, count(*) AS n FROM (SELECT rid, unnest(words) AS feature FROM words) GROUP BY ALL
), dictionary AS (
  SELECT feature, CAST(sum(s) AS BIGINT) AS s, CAST(sum(t) AS BIGINT) AS t FROM (
    SELECT feature, sum(n) AS s, 0 AS t FROM held GROUP BY feature UNION ALL SELECT feature, 0, count(*) FROM target GROUP BY feature) GROUP BY feature
), crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], list_transform(range(8), lambda j: CAST(0 AS BIGINT))), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), hashed AS (
  SELECT feature, s, t, xor(list_reduce(list_concat([4294967295], list_transform(range(strlen(feature)), lambda i: CAST('0x' || substr(hex(feature), 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS bucket FROM dictionary, crc
), buckets AS (
  SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(sum(s) OVER () AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST(sum(t) OVER () AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM buckets
), weights AS (
  SELECT rid, CAST(sum(n * gain) AS BIGINT) AS weight FROM held JOIN hashed USING (feature) JOIN gains USING (bucket) GROUP BY rid
), scored AS (
  SELECT w.rid, w.doc_id, CAST(len(w.words) AS BIGINT) AS n_features, coalesce(g.weight, 0) AS weight,
    coalesce(g.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(w.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM words w LEFT JOIN weights g USING (rid)
), placed AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () * 10 // 100 AS drawn FROM scored WHERE n_features >= 20
)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN p.place <= p.drawn THEN p.place END AS rank FROM scored s LEFT JOIN placed p USING (rid)
"""
