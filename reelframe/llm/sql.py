"""DuckDB texts of the queries that SQL expresses."""

EXACT = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       coalesce(doc_id IS NOT DISTINCT FROM max(doc_id) OVER g, false) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT page_id, html, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS top FROM p),
d AS (SELECT page_id, html, top,
        list_aggregate(list_transform(range(0, 32), lambda i:
          substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            CAST((CAST('0x' || substr(h, 1 + 10 * CAST(i // 8 AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31 AS INT) + 1, 1)), 'string_agg', '') AS digest
      FROM g)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN top IS NULL OR page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top IS NULL OR page_id IS NOT DISTINCT FROM top THEN NULL ELSE top END AS refers_to
FROM d
"""

_SHINGLES = """
SELECT {id}, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
       ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
FROM (SELECT {id}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {table})
"""

LEAKS = f"""
WITH d AS (SELECT DISTINCT doc_id, unnest(s) AS g FROM ({_SHINGLES.format(id='doc_id', table='documents')})),
b AS ({_SHINGLES.format(id='item_id', table='benchmark')}),
i AS (SELECT DISTINCT item_id, len(s) AS n_item, unnest(s) AS g FROM b)
SELECT doc_id, item_id, CAST(count(*) AS INT) AS n_shared, CAST(n_item AS INT) AS n_item, count(*) / n_item AS containment
FROM d JOIN i USING (g) GROUP BY doc_id, item_id, n_item HAVING count(*) >= ceil(0.8 * n_item - 1e-9)
"""

REPEATS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS o, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT r, o, p, substr(h, CAST(2 * p + 1 AS INT), 100) AS s FROM (SELECT r, o, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d WHERE length(h) >= 100)),
hit AS (SELECT r, p FROM (SELECT r, p, o, min(o) OVER (PARTITION BY s) AS least FROM g) WHERE least < o),
cut AS (SELECT r, p, CASE WHEN p > lag(p) OVER w + 50 THEN 1 ELSE 0 END AS new FROM hit WINDOW w AS (PARTITION BY r ORDER BY p)),
run AS (SELECT r, min(p) AS a, max(p) + 50 AS b FROM (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS k FROM cut) GROUP BY r, k),
gap AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS z FROM run),
kept AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
           string_agg(substr(h, CAST(2 * z + 1 AS INT), CAST(2 * (a - z) AS INT)), '' ORDER BY a) AS head FROM gap JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE head || substr(h, CAST(2 * last + 1 AS INT)) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

MIXING = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS turn FROM documents),
w AS (SELECT *, [5, 2, 1][1 + (place % 3)] AS weight FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(row_number() OVER (ORDER BY source NULLS LAST) - 1 AS INT) AS place FROM d GROUP BY source)),
a AS (SELECT CAST(sum(source_size) AS BIGINT) AS all_size, CAST(sum(weight) AS BIGINT) AS all_weight FROM w),
o AS (SELECT *, 2 * source_size / weight <= CAST(3 * all_size - 4 * coalesce(sum(source_size) OVER b, 0) AS DOUBLE) / (2 * (all_weight - coalesce(sum(weight) OVER b, 0))) AS stops
      FROM w, a WINDOW b AS (ORDER BY 2 * source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT CAST(coalesce(sum(source_size) FILTER (stops), 0) AS BIGINT) AS stopped, CAST(coalesce(sum(weight) FILTER (NOT stops), 0) AS BIGINT) AS free FROM o),
t AS (SELECT source, place, source_size, CASE WHEN stops THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(3 * all_size - 4 * stopped AS DOUBLE) * weight / (2 * free) END AS target FROM o, f),
q AS (SELECT d.doc_id, d.size, t.*, row_number() OVER g AS r, CAST(sum(d.size) OVER g AS BIGINT) - d.size AS begin FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
      WINDOW g AS (PARTITION BY t.place ORDER BY d.turn, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING)),
e AS (SELECT place, r, size, target, begin + k * source_size AS begin FROM q, (VALUES (0), (1)) AS v(k) WHERE size > 0 AND begin + k * source_size < target),
p AS (SELECT place, r, target, begin, size AS words FROM e WHERE begin + size <= target
      UNION ALL SELECT place, r, target, begin + s, least(16, size - s) FROM (SELECT *, unnest(range(0, size, 16)) AS s FROM e WHERE begin + size > target) WHERE begin + s < target),
l AS (SELECT place, r, words, sum(words) OVER (ORDER BY (begin + words) / target, place, begin ROWS UNBOUNDED PRECEDING) - words AS ahead FROM p),
m AS (SELECT place, r, CAST(sum(least(words, 3 * all_size // 2 - ahead)) AS BIGINT) AS taken FROM l, a WHERE ahead < 3 * all_size // 2 GROUP BY place, r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM q LEFT JOIN m USING (place, r)
"""

_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

RANKS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
i AS (SELECT row_number() OVER () AS j, item_id, {_TERMS} AS w FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark)),
q AS (SELECT j, item_id, term, count(*) AS qtf FROM (SELECT j, item_id, unnest(w) AS term FROM i) GROUP BY j, item_id, term),
a AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n, term),
t AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, a GROUP BY term, docs),
s AS (SELECT j, item_id, r, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN t USING (term), a GROUP BY j, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
