"""DuckDB SQL for the numbered queries that SQL can state over whole tables.

The BPE queries (3, 6), the classifier (7) and the byte-wise suffix dedup (8)
have none; tests/llm hold them against the library or a brute-force version.
"""

from __future__ import annotations

from skein.llm import decontam, line_dedup, quality, url_filter

WORDS = r"[^\x20\x09-\x0D]+"

_BUCKET = "((v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0))"
_SIGNALS = """
  unnest([{'signal': 'symbols', 'v': (10000 * n_symbols) // greatest(n_words, 1)},
          {'signal': 'length', 'v': (1000 * word_chars) // greatest(n_words, 1)},
          {'signal': 'dups', 'v': (10000 * n_dup_lines) // greatest(n_lines, 1)}])"""

OP1 = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORDS}') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS ls FROM d),
grams AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS g
          FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY 1),
m AS (SELECT doc_id, lang, source, len(ws) AS n_words,
             coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines
      FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PCT} * n_words AS base_failed FROM m),
s AS (SELECT doc_id, lang, source, base_failed, x.signal AS signal, x.v AS v
      FROM (SELECT doc_id, lang, source, base_failed, {_SIGNALS} AS x FROM b)),
f AS (SELECT lang, source, signal, {_BUCKET} AS bucket, count(*) AS n FROM s WHERE NOT base_failed GROUP BY ALL),
h AS (SELECT 0 AS level, lang, source, signal, bucket, n FROM f
      UNION ALL SELECT 1, lang, NULL, signal, bucket, sum(n) FROM f GROUP BY ALL
      UNION ALL SELECT 2, NULL, NULL, signal, bucket, sum(n) FROM f GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, signal ORDER BY bucket) AS upto,
             sum(n) OVER (PARTITION BY level, lang, source, signal) AS total FROM h),
q AS (SELECT level, lang, source, signal, min(bucket) FILTER (upto * 10 >= total) AS lo,
             min(bucket) FILTER (upto * 10 >= total * 5) AS mid, min(bucket) FILTER (upto * 10 >= total * 9) AS hi,
             max(total) AS n FROM r GROUP BY ALL),
t AS (SELECT *, greatest(least(mid - lo, hi - mid) * {quality.FENCE},
                         CASE signal WHEN 'symbols' THEN 1000 WHEN 'length' THEN 500 ELSE 5000 END) AS width FROM q),
k AS (SELECT level, lang, source, signal, n, CASE WHEN signal = 'length' THEN mid - width ELSE -1 END AS least_v,
             mid + width AS most_v FROM t),
j AS (SELECT s.doc_id, s.v BETWEEN coalesce(a.least_v, b.least_v, c.least_v) AND coalesce(a.most_v, b.most_v, c.most_v) AS inside
      FROM s LEFT JOIN k a ON a.level = 0 AND a.n >= {quality.MIN_GROUP} AND a.signal = s.signal
                          AND a.lang IS NOT DISTINCT FROM s.lang AND a.source IS NOT DISTINCT FROM s.source
             LEFT JOIN k b ON b.level = 1 AND b.n >= {quality.MIN_GROUP} AND b.signal = s.signal
                          AND b.lang IS NOT DISTINCT FROM s.lang
             LEFT JOIN k c ON c.level = 2 AND c.signal = s.signal),
v AS (SELECT doc_id, bool_and(coalesce(inside, true)) AS inside FROM j GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept
FROM b JOIN v USING (doc_id)
"""

_FITS = " UNION ALL ".join(
    f"SELECT page_id, '{r}' AS rule, '{v}' AS verdict FROM u WHERE (host = '{h}' OR ends_with(host, '.{h}')) "
    f"AND starts_with(path, '{p}')"
    for r, v in url_filter.RULES for h, p in [url_filter.split_rule(r)])

OP2 = rf"""
WITH c AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
u AS (SELECT page_id, html,
             coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM c),
f AS ({_FITS}),
r AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM f GROUP BY 1),
l AS (SELECT DISTINCT host AS h, path AS p FROM u WHERE host <> ''
      AND len(regexp_extract_all(regexp_replace(html, '<[^>]*>', ' ', 'g'), '{WORDS}')) < {url_filter.LEAST_WORDS})
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host, '{url_filter.SPAM_HOST}') OR l.h IS NOT NULL
                                                     THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN r USING (page_id) LEFT JOIN l ON l.h = u.host AND l.p = u.path
"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ASCII_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP4 = rf"""
WITH bw AS (SELECT item_id, regexp_extract_all({_LOW}, '{_ASCII_WORDS}') AS ws FROM benchmark),
g AS (SELECT DISTINCT item_id, k, list_slice(ws, i, i + k - 1) AS gram FROM (
        SELECT item_id, ws, least(len(ws), {decontam.N}) AS k, unnest(range(1, len(ws) - least(len(ws), {decontam.N}) + 2)) AS i
        FROM bw WHERE len(ws) > 0)),
dw AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_ASCII_WORDS}') AS ws FROM documents),
ks AS (SELECT DISTINCT k FROM g),
win AS (SELECT doc_id, k, i, list_slice(ws, i, i + k - 1) AS gram FROM (
          SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM dw, ks WHERE len(ws) >= k)),
hit AS (SELECT doc_id, win.k, i, item_id FROM win JOIN g ON win.k = g.k AND win.gram = g.gram),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_TRIM = r"regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"

OP5 = rf"""
WITH ls AS (SELECT doc_id, source, text, i, ls[i] AS l FROM (
              SELECT doc_id, source, text, ls, unnest(range(1, len(ls) + 1)) AS i
              FROM (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents))),
t AS (SELECT *, {_TRIM} AS k FROM ls),
c AS (SELECT * FROM t WHERE len(regexp_extract_all(k, '{WORDS}')) >= {line_dedup.MIN_WORDS}),
bad AS (SELECT k FROM c GROUP BY k HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}),
gone AS (SELECT doc_id, i FROM (
           SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM c SEMI JOIN bad USING (k)) WHERE r > 1),
x AS (SELECT t.*, gone.i IS NOT NULL AS cut FROM t LEFT JOIN gone USING (doc_id, i))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (cut) AS n_removed,
       md5(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT cut), '')) AS kept_md5
FROM x GROUP BY doc_id
"""

OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN last END AS refers_to
FROM g
"""

OP10 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '{WORDS}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, list_slice(ws, i, i + 2) AS g FROM (
          SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""

def _crc_table() -> str:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (c & 1) * 0xEDB88320
        out.append(c)
    return f"{out}::BIGINT[]"


OP11 = f"""
WITH RECURSIVE s AS (
  SELECT DISTINCT doc_id, (coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616 AS key,
         -1::BIGINT AS b, 0::BIGINT AS j FROM documents
  UNION ALL
  SELECT doc_id, k, j, floor((j + 1) * (2147483648::DOUBLE / ((k >> 33) + 1)::DOUBLE))::BIGINT
  FROM (SELECT doc_id, j, (key * 2862933555777941757 + 1) % 18446744073709551616 AS k FROM s WHERE j < 24)),
g AS (SELECT doc_id, max(b)::INTEGER AS shard, max(CASE WHEN j = 24 THEN 24 ELSE b END)::INTEGER AS grown_shard FROM s GROUP BY 1),
t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, strlen(text) + 8 AS size,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
                   regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
                 lambda c, x: xor(c >> 8, ({_crc_table()})[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32
      FROM t)
SELECT c.doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY c.doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM c JOIN g ON c.doc_id IS NOT DISTINCT FROM g.doc_id
"""

OP12 = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORDS}') AS ws, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
f AS (SELECT doc_id, part,
             CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END ||
             CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END ||
             CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN first < doc_id THEN 'E' ELSE '' END AS fails
      FROM w),
k AS (SELECT part, fails, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
      FROM f LEFT JOIN labels USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6))::INTEGER AS step FROM o),
c AS (SELECT k.*, s.*, contains(fails, substr(filter_order, step, 1)) AS hit,
             length(translate(substr(filter_order, 1, step - 1), fails, '')) < step - 1 AS before FROM k, s),
r AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS x,
             sum(n) FILTER (NOT hit AND NOT before) AS kept, sum(n) FILTER (hit AND NOT before) AS removed,
             sum(n) FILTER (hit AND before) AS redundant, sum(n) FILTER (fails = substr(filter_order, step, 1)) AS unique_fails,
             sum(good) FILTER (hit AND NOT before) AS good_lost, sum(toxic) FILTER (hit AND NOT before) AS toxic_lost
      FROM c GROUP BY ALL),
h AS (SELECT part, x, sum(removed) AS shapley FROM r GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(shapley, 0)::BIGINT AS shapley
FROM r JOIN h USING (part, x)
"""

ORACLE_SQL = {"op1_quality_rules": OP1, "op2_url_filters": OP2, "op4_decontamination": OP4, "op5_line_dedup": OP5,
              "op9_warc": OP9, "op10_jaccard_join": OP10, "op11_sharding": OP11, "op12_filter_audit": OP12}
