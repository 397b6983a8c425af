"""SQL twins of the corpus queries that SQL can express, for small tables."""

from __future__ import annotations

from .mixing import WORD
from .url_reputation import TWO_LABELS

OP3 = rf"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}'), []) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM w LEFT JOIN n USING (doc_id) JOIN m ON m.a = w.doc_id"""

OP5 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND f <> page_id THEN f END AS refers_to FROM d"""

OP6 = rf"""WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) AS ws FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM w WHERE len(ws) >= 50), k AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k FROM v),
f AS (SELECT k, min(doc_id) AS f FROM k GROUP BY k), c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM k JOIN f USING (k) WHERE doc_id > f),
g AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id), o AS (SELECT doc_id, ws, coalesce(ps, []) AS ps FROM w LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ps) AS BIGINT) AS n_removed, sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(ps, i)), ' ')) AS kept_sha256 FROM o"""

_LEVEL = """{name}m AS (SELECT coalesce(greatest(1 / 1001.0::DOUBLE, least(0.5::DOUBLE, (sum(n * pow(bad / CAST(n AS DOUBLE) - prior, 2)) - sum(prior * (1 - prior))) / nullif(sum((n - 1) * prior * (1 - prior)), 0))), 1 / 1001.0::DOUBLE) AS rho FROM {name}p WHERE n > 0),
{name}q AS (SELECT *, 1 / rho - 1 AS k, (bad + (1 / rho - 1) * prior) / (n + (1 / rho - 1)) AS mean FROM {name}p, {name}m)"""

OP7 = (
    """WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
o AS (SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id),
hn AS (SELECT host, CASE WHEN two THEN regexp_extract(host, '([^.]*\\.)?[^.]*\\.[^.]*$') ELSE regexp_extract(host, '([^.]*\\.)?[^.]*$') END AS domain, CASE WHEN two THEN regexp_extract(host, '[^.]*\\.[^.]*$') ELSE regexp_extract(host, '[^.]*$') END AS suffix, n, bad, pages
FROM (SELECT host, regexp_extract(host, '[^.]*\\.[^.]*$') IN (""" + ", ".join(f"'{x}'" for x in TWO_LABELS) + """) AS two, count(*) AS pages, coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad FROM h LEFT JOIN o USING (page_id) GROUP BY host)),
dn AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hn GROUP BY 1, 2), sn AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM dn GROUP BY 1), t AS (SELECT (sum(bad) + 1) / CAST(sum(n) + 2 AS DOUBLE) AS prior FROM sn),
sp AS (SELECT sn.*, prior FROM sn, t), """
    + _LEVEL.format(name="s") + ", dp AS (SELECT dn.*, sq.mean AS prior FROM dn JOIN sq USING (suffix)), " + _LEVEL.format(name="d") + ", hp AS (SELECT hn.*, dq.mean AS prior FROM hn JOIN dq USING (domain)), " + _LEVEL.format(name="h")
    + """, b AS (SELECT host, bad + k * prior AS a, n - bad + k * (1 - prior) AS c FROM hq), v AS (SELECT host, a / (a + c) - 1.645::DOUBLE * sqrt(a * c / (pow(a + c, 2) * (a + c + 1))) AS lower FROM b),
g AS (SELECT floor(lower * 10000) AS step, sum(pages) AS p FROM v JOIN hn USING (host) GROUP BY 1), w AS (SELECT step, sum(p) OVER (ORDER BY step DESC) AS above, sum(p) OVER () AS every FROM g),
x AS (SELECT min(step) AS least FROM w WHERE above <= 0.1::DOUBLE * every),
m AS (SELECT h.*, lower, CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7' WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/' WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/' WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM h JOIN v USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN floor(lower * 10000) >= least THEN 'block' ELSE 'allow' END AS verdict FROM m, x"""
)

OP10 = rf"""WITH d AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size, source FROM documents),
q AS (SELECT doc_id, 0.5::DOUBLE + 1.5::DOUBLE * avg(quality) AS w FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS wt, 2.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM r),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(wt) OVER (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
o AS (SELECT min_by(level, cap / wt) AS open FROM l WHERE cap > level * wt),
t AS (SELECT source, source_size, CASE WHEN open IS NULL THEN cap ELSE least(cap, open * wt) END AS target FROM l, o),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t), g AS (SELECT *, CAST(floor(target - epochs * source_size) AS BIGINT) AS rest FROM e),
k AS (SELECT d.*, -ln((CAST(('0x' || substr(md5('mix' || CAST(d.doc_id AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / coalesce(w, 1) AS key FROM d LEFT JOIN q USING (doc_id)),
p AS (SELECT k.*, source_size, target, epochs, rest, coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source, source_size, round(target, 6) + 0.0 AS target, epochs, CAST(greatest(0, least(size, rest - before)) AS BIGINT) AS part, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM p"""

OP12 = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS ws, coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS e FROM d),
o AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END)
|| (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails FROM w LEFT JOIN o USING (doc_id)),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
p AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM p), g AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS filter, substr(filter_order, 1, step - 1) AS before FROM s),
h AS (SELECT *, contains(fails, filter) AS own, EXISTS (SELECT 1 FROM l WHERE contains(before, x) AND contains(fails, x)) AS gone FROM g, m),
r AS (SELECT part, filter_order, step, filter, sum(CASE WHEN NOT gone AND NOT own THEN n ELSE 0 END) AS kept, sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN own AND gone THEN n ELSE 0 END) AS redundant,
sum(CASE WHEN fails = filter THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN own AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN own AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM h GROUP BY ALL)
SELECT part, filter_order, step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r"""

_TERMS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), [])"
OP13 = f"""WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents), c AS (SELECT count(*) AS cn, CAST(sum(len(ts)) AS BIGINT) AS cl FROM d WHERE len(ts) > 0),
q AS (SELECT item_id, term, count(*) AS rep FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(cn) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, c GROUP BY term),
s AS (SELECT item_id, doc_id, CAST(sum(rep * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * cn) // cl)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""

ORACLE_SQL = {"op3_ngram_join": OP3, "op5_warc": OP5, "op6_substring_dedup": OP6, "op7_url_reputation": OP7, "op10_mixing": OP10, "op12_filter_audit": OP12, "op13_lexical_search": OP13}
