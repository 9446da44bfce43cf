"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

URL_FILTER = r"""
WITH rest AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
    SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules(verdict, h, p) AS (
    VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), hits AS (
    SELECT page_id, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h) DESC, length(p) DESC) AS place
    FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT parts.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN hits ON hits.page_id = parts.page_id AND place = 1
"""

MIXING = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        coalesce('s' || source, 'n') AS src, substr(md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 16) AS h FROM documents
), sources AS (
    SELECT src, CAST(sum(size) AS BIGINT) AS total, [1.0, 2.0, 3.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight
    FROM sized GROUP BY src, source
), ratios AS (
    SELECT *, total * 3.0::DOUBLE AS most, total * 3.0::DOUBLE / weight AS ratio FROM sources
), shares AS (
    SELECT *, (sum(total) OVER () - coalesce(sum(most) OVER (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY ratio, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM ratios
), one AS (SELECT arg_min(share, ratio) AS share FROM shares WHERE share <= ratio),
targets AS (SELECT src, total AS source_size, least(most, one.share * weight) AS target FROM shares, one),
placed AS (
    SELECT s.*, source_size, target, sum(size) OVER (PARTITION BY s.src ORDER BY h, CAST(doc_id AS VARCHAR), size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
    FROM sized s JOIN targets USING (src)
), items AS (
    SELECT *, CAST(turn * source_size + upto AS DOUBLE) / target AS time FROM placed, (SELECT unnest([0, 1, 2]) AS turn) WHERE size > 0 AND target > 0
), queue AS (
    SELECT *, sum(size) OVER (ORDER BY time, src, h, CAST(doc_id AS VARCHAR), size, turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sent FROM items
), served AS (
    SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM queue WHERE sent <= (SELECT sum(target) FROM targets) * (1 + 1e-12) GROUP BY doc_id
)
SELECT placed.doc_id, size, source_size, coalesce(target, 0) AS target, coalesce(taken, 0) AS taken
FROM placed LEFT JOIN served ON served.doc_id = placed.doc_id
"""

TOP_K = r"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT q.vec_id AS query_id, q.x, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
    FROM (SELECT DISTINCT vec_id, x FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, x ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM scores QUALIFY rank <= 5
"""

SUBSTRINGS = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT r, i, sha256(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) AS t(i) WHERE len(w) >= 35
), repeated AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM windows SEMI JOIN repeated USING (h))),
words AS (SELECT r, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (r, p) GROUP BY r),
removed AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN removed USING (r)
"""

NEAR = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes m ON m.doc_id = x JOIN sizes n ON n.doc_id = y WHERE 100 * c >= 85 * (m.n + n.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT x AS doc, y AS other FROM edges UNION SELECT doc, y FROM reached JOIN edges ON other = x),
parts AS (SELECT doc AS doc_id, least(doc, min(other)) AS component_id FROM reached GROUP BY doc)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN parts USING (doc_id)
"""

VARIANTS = r"""
WITH RECURSIVE crc AS (
    SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(256) r(i)
), found AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents
), counted AS (SELECT doc_id, run, count(*) AS n FROM found GROUP BY ALL),
bytes AS (
    SELECT *, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS b FROM counted
), hashed AS (
    SELECT run, n, xor(list_reduce(b, lambda s, x: xor(s // 256, t[xor(s, x) % 256 + 1]), 4294967295::BIGINT), 4294967295) AS h FROM bytes, crc
), changed AS (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT DISTINCT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS stays FROM words, unnest(range(length(word))) AS t(i)),
pairs AS (
    SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.stays = b.stays AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.stays = b.word
    UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.stays = b.word
), best AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, other)) AS other FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
led AS (SELECT word, word AS at FROM forms UNION ALL SELECT led.word, form FROM led JOIN forms ON forms.word = led.at WHERE form IS NOT NULL),
roots AS (SELECT led.word, led.at AS root FROM led JOIN forms ON forms.word = led.at WHERE form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""

DIVERGENCE = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), found AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM found GROUP BY ALL HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (
    SELECT g.lang, g.source, k.term, count(f.r) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term GROUP BY ALL
), shares AS (
    SELECT c.lang, c.source, c.term, n, CAST(1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY c.lang, c.source) + v.v) AS HUGEINT) AS p FROM counts c JOIN v USING (lang)
), langs AS (
    SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v.v) AS HUGEINT) AS q FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL) JOIN v USING (lang)
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), rows AS (
    SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
    FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source
    UNION ALL SELECT s.lang, s.source, 'term', s.term, ((p - q) * (p - q)) // q FROM shares s JOIN langs l ON l.lang = s.lang AND l.term = s.term WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM rows QUALIFY part = 'pair' OR rank <= 200
"""

ORACLES = {"op1_substring_dedup": SUBSTRINGS, "op3_minhash_near_dedup": NEAR, "op2_url_filter": URL_FILTER, "op9_mixing": MIXING, "op10_exact_top_k": TOP_K, "op12_spelling_variants": VARIANTS, "op13_source_divergence": DIVERGENCE}
