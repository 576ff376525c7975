"""DuckDB SQL for every checked query in ``skein.plans.catalog`` (the
``oracle_sql()`` of ``__spark_entry__``).

The SQL states each result the straightforward way (e.g. the search oracle
scores every (query, document) pair and sorts, where the Spark job pads from
k candidates).  Only the stemmer is shared: both sides render the same rule
table (``skein.functions.stem``), so the stem oracle proves the two engines
agree and the pytest goldens prove the rules.
"""

from __future__ import annotations

from skein.functions import stopwords as sw
from skein.functions.stem import stem_sql
from skein.functions.text import (COMMENT_RE, DECL_RE, HTML_ENTITIES, PUNCTUATION,
                                  RAW_BLOCK_RE, TAG_RE, WS_CLASS)
from skein.functions.urls import BASE_RE, HOST_RE, SCHEME_RE
from skein.operators.links import ANCHOR_RE, HREF_RE
from skein.operators.rag import PROMPT_WEB

ALL_SITE = "all"
SINGLE_QUERY = "the en in"
K = 10
LINK_PATTERN = "/t"
CRAWLED_PATH = "/the"
BATCH_N = 5


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pyupper(x: str) -> str:
    """Python/Java upper(): DuckDB keeps 'ß', Python turns it into 'SS'."""
    return f"upper(replace({x}, 'ß', 'SS'))"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS_CLASS}+', ' ', 'g'))"


STOP_LIST = ", ".join(lit(w) for w in sorted(set(sw.NLTK_ENGLISH) | set(PUNCTUATION)))


def docs_sql(one_site: bool, text: str = "text") -> str:
    site = lit(ALL_SITE) if one_site else "source"
    return (f"SELECT {site} AS site, CAST(doc_id AS VARCHAR) AS doc_key, "
            f"{collapse(text)} AS text FROM documents")


RESENT_TEXT = "CASE WHEN lang = 'de' THEN replace(text, 'e', 'a') ELSE text END"


def tokens_sql(docs: str) -> str:
    return (f"SELECT site, doc_key, token FROM (SELECT site, doc_key, "
            f"unnest(string_split(text, ' ')) AS token FROM ({docs})) WHERE token <> ''")


def words_sql(docs: str) -> str:
    return (f"SELECT site, doc_key, lower({pyupper('token')}) AS word FROM ({tokens_sql(docs)}) "
            f"WHERE regexp_matches(token, '^\\p{{L}}+$')")


def page_docs_sql(site: str) -> str:
    """Pages as documents: (site, doc_key, text)."""
    return f"SELECT {site} AS site, {doc_key_sql('url')} AS doc_key, {page_text_sql('html')} AS text FROM pages"


def terms_ctes(one_site: bool, stop: bool, text: str = "text", docs: str | None = None) -> str:
    """CTEs words, vocab, terms (site, doc_key, term) for the documents."""
    where = f" WHERE v.term NOT IN ({STOP_LIST})" if stop else ""
    return (f"words AS ({words_sql(docs or docs_sql(one_site, text))}), "
            f"vocab AS ({stem_sql('SELECT DISTINCT word FROM words', 'word')}), "
            f"terms AS (SELECT w.site, w.doc_key, v.term FROM words w JOIN vocab v "
            f"ON w.word = v.word{where})")


def index_ctes(one_site: bool, stop: bool, text: str = "text", docs: str | None = None) -> str:
    """+ post (site, doc_key, term, tf), dfreq (site, term, df), ndocs (site, n)."""
    return (terms_ctes(one_site, stop, text, docs) + ", "
            "post AS (SELECT site, doc_key, term, count(*) AS tf FROM terms "
            "GROUP BY site, doc_key, term), "
            "dfreq AS (SELECT site, term, count(*) AS df FROM post GROUP BY site, term), "
            f"ndocs AS (SELECT site, count(*) AS n FROM ({docs or docs_sql(one_site)}) GROUP BY site)")


def query_terms_cte(queries: str, name: str = "qt", irregular: bool = True) -> str:
    """CTE ``name`` (query_id, site, term, qtf) for queries (query_id, site, query)."""
    toks = (f"SELECT query_id, site, lower(tok) AS tok FROM (SELECT query_id, site, "
            f"unnest(string_split({collapse(pyupper('query'))}, ' ')) AS tok FROM ({queries})) "
            f"WHERE tok <> ''")
    return (f"{name}_tok AS ({toks}), "
            f"{name}_stem AS ({stem_sql(f'SELECT DISTINCT tok FROM {name}_tok', 'tok', irregular=irregular)}), "
            f"{name} AS (SELECT t.query_id, t.site, s.term, count(*) AS qtf FROM {name}_tok t "
            f"JOIN {name}_stem s ON t.tok = s.tok GROUP BY t.query_id, t.site, s.term)")


CONV_QUERIES = (f"SELECT conv_id * 10000 + turn AS query_id, {lit(ALL_SITE)} AS site, text AS query "
                "FROM conversations WHERE role = 'user'")
BENCH_QUERIES = f"SELECT item_id AS query_id, {lit(ALL_SITE)} AS site, text AS query FROM benchmark"
ONE_QUERY = f"SELECT CAST(0 AS BIGINT) AS query_id, {lit(ALL_SITE)} AS site, {lit(SINGLE_QUERY)} AS query"


def scored_ctes(queries: str, stop: bool, docs: str | None = None, irregular: bool = True) -> str:
    """+ scores (query_id, site, doc_key, score) for EVERY (query, document)."""
    return (index_ctes(True, stop, docs=docs) + ", " + query_terms_cte(queries, irregular=irregular) + ", "
            "wt AS (SELECT k.site, k.term, n.n / coalesce(d.df, n.n) AS weight "
            "FROM (SELECT DISTINCT site, term FROM qt) k JOIN ndocs n ON k.site = n.site "
            "LEFT JOIN dfreq d ON d.site = k.site AND d.term = k.term), "
            "contrib AS (SELECT q.query_id, p.site, p.doc_key, sum(p.tf * (q.qtf * w.weight)) AS s "
            "FROM post p JOIN qt q ON p.site = q.site AND p.term = q.term "
            "JOIN wt w ON w.site = q.site AND w.term = q.term GROUP BY q.query_id, p.site, p.doc_key), "
            f"alldocs AS (SELECT site, doc_key FROM ({docs or docs_sql(True)})), "
            f"qs AS (SELECT DISTINCT query_id, site FROM ({queries})), "
            "scores AS (SELECT q.query_id, a.site, a.doc_key, round(coalesce(c.s, 0.0), 6) AS score "
            "FROM qs q JOIN alldocs a ON a.site = q.site "
            "LEFT JOIN contrib c ON c.query_id = q.query_id AND c.doc_key = a.doc_key)")


def _ranked(where_k: bool = True) -> str:
    cond = f" WHERE rank <= {K}" if where_k else ""
    return ("ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id "
            "ORDER BY score DESC, doc_key) AS INTEGER) AS rank FROM scores)"), cond


# ---- URL and HTML expressions -------------------------------------------------
def base_sql(u):
    return f"regexp_extract({u} || '/', {lit(BASE_RE)}, 1)"


def host_sql(u):
    return f"regexp_extract({u} || '/', {lit(HOST_RE)}, 1)"


def site_sql(u):
    return f"sha256({host_sql(u)})"


def doc_key_sql(u):
    return f"url_encode({u})"


def unquote_sql(k):
    tail = f"regexp_extract({k}, '%[0-9A-Fa-f]?$', 0)"
    return f"coalesce(url_decode(left({k}, length({k}) - length({tail}))) || {tail}, {k})"


def crawlable_sql(u):
    ends = " OR ".join(f"ends_with(lower({u}), {lit(e)})"
                       for e in ["jpg", "jpeg", "pdf", "png", "webp", "xls", "xlsx", "PDF"])
    return f"(NOT ({ends}))"


def strip_markup_sql(h, keep_template=False):
    x = f"regexp_replace({h}, {lit(COMMENT_RE)}, '', 'g')"
    x = f"regexp_replace({x}, {lit(DECL_RE)}, '', 'g')"
    for tag in ["script", "style"] + ([] if keep_template else ["template"]):
        x = f"regexp_replace({x}, {lit(RAW_BLOCK_RE.format(tag))}, '', 'g')"
    return x


def decode_sql(x):
    for name, ch in HTML_ENTITIES:
        x = f"replace({x}, {lit('&' + name + ';')}, {lit(ch)})"
    return x


def page_text_sql(h):
    return collapse(decode_sql(f"regexp_replace({strip_markup_sql(h)}, {lit(TAG_RE)}, '', 'g')"))


def resolve_sql(base, href):
    """urljoin(base, href) for hrefs without dot segments (the test data's)."""
    h = rf"regexp_replace(regexp_replace({href}, '[\t\r\n]', '', 'g'), '^[\x{{00}}-\x{{20}}]+', '')"
    scheme = f"lower(regexp_extract({h}, {lit(SCHEME_RE)}, 1))"
    after = f"regexp_replace({h}, {lit(SCHEME_RE)}, '')"
    rel = f"(CASE WHEN {scheme} <> '' THEN {after} ELSE {h} END)"
    b_scheme = f"regexp_extract({base}, '^([a-z]+):', 1)"
    root = f"({b_scheme} || '://' || regexp_extract({base}, '^[a-z]+://([^?#]*)', 1))"
    b_query = rf"regexp_extract({base}, '^[^?#]*\?([^#]*)', 1)"
    path = f"regexp_extract({rel}, '^([^?#]*)', 1)"
    q0 = rf"regexp_extract({rel}, '^[^?#]*\?([^#]*)', 1)"
    query = f"(CASE WHEN {path} = '' AND {q0} = '' THEN {b_query} ELSE {q0} END)"
    frag = f"regexp_extract({rel}, '#(.*)$', 1)"
    tail = (f"((CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END) || "
            f"(CASE WHEN {frag} <> '' THEN '#' || {frag} ELSE '' END))")
    rpath = f"(CASE WHEN starts_with({path}, '/') THEN {path} ELSE '/' || {path} END)"
    return (f"(CASE WHEN {href} IS NULL OR {href} = '' THEN {base} "
            f"WHEN {base} = '' THEN {href} "
            f"WHEN {scheme} <> '' AND {scheme} <> {b_scheme} THEN {href} "
            f"WHEN {scheme} <> '' AND starts_with({after}, '//') THEN {scheme} || ':' || {after} "
            f"WHEN {scheme} = '' AND starts_with({h}, '//') THEN {b_scheme} || ':' || {h} "
            f"WHEN {path} = '' THEN {root} || {tail} "
            f"ELSE {root} || {rpath} || {tail} END)")


def anchors_cte(src="pages", keys="page_id"):
    """CTE anchors (keys, url, pos, href) over a table with url, html."""
    tags = f"regexp_extract_all({strip_markup_sql('html', keep_template=True)}, {lit(ANCHOR_RE)}, 0)"
    href = " || ".join(f"regexp_extract(tag, {lit(HREF_RE)}, {g})" for g in (1, 2, 3))
    return (f"tags AS (SELECT {keys}, url, {tags} AS tl FROM {src}), "
            f"tagrows AS (SELECT {keys}, url, unnest(range(len(tl))) AS pos, unnest(tl) AS tag FROM tags), "
            f"anchors AS (SELECT {keys}, url, CAST(pos AS INTEGER) AS pos, {decode_sql(f'({href})')} AS href "
            f"FROM tagrows)")


def links_ctes(src="pages", keys="page_id"):
    """+ links (keys, url, pos, base, link)."""
    return (anchors_cte(src, keys) + ", "
            f"links AS (SELECT {keys}, url, pos, {base_sql('url')} AS base, "
            f"{resolve_sql(base_sql('url'), 'href')} AS link FROM anchors)")


SITE_PAGES = f"SELECT {site_sql('url')} AS site, page_id, url, html FROM pages"
CRAWLED_PROBE = (f"SELECT DISTINCT {site_sql('url')} AS site, {base_sql('url')} || {lit(CRAWLED_PATH)} "
                 "AS url FROM pages")


def in_scope_sql(pattern=""):
    return f"contains(link, base) AND contains(link, {lit(pattern)})"


def round_ctes():
    """One crawl round over the seeded frontier; CTEs batch, fetched, found,
    crawled_next, frontier_next."""
    return (f"sp AS ({SITE_PAGES}), {links_ctes('sp', 'site')}, "
            "seed AS (SELECT site, url, min(r) AS round FROM ("
            "SELECT site, url, 0 AS r FROM sp UNION ALL "
            f"SELECT site, link AS url, 1 AS r FROM links WHERE {in_scope_sql()}) GROUP BY site, url), "
            "batch AS (SELECT site, url, round FROM (SELECT *, row_number() OVER (PARTITION BY site "
            f"ORDER BY round, url) AS rn FROM seed) WHERE rn <= {BATCH_N}), "
            "pg AS (SELECT url, min(html) AS html FROM pages GROUP BY url), "
            f"fetched AS (SELECT b.site, b.url, b.round, CASE WHEN {crawlable_sql('b.url')} THEN p.html END AS html "
            "FROM batch b LEFT JOIN pg p ON p.url = b.url), "
            "fp AS (SELECT site, url, html FROM fetched WHERE html IS NOT NULL), "
            f"{links_ctes('fp', 'site').replace('tags AS', 'ftags AS').replace('FROM tags', 'FROM ftags').replace('tagrows', 'ftagrows').replace('anchors', 'fanchors').replace('links AS', 'flinks AS')}, "
            f"found AS (SELECT DISTINCT site, link AS url FROM flinks l WHERE {in_scope_sql()} "
            "AND NOT EXISTS (SELECT 1 FROM batch b WHERE b.site = l.site AND b.url = l.link)), "
            "crawled_next AS (SELECT site, url, CAST(2 AS INTEGER) AS round FROM batch), "
            "frontier_next AS (SELECT site, url, CAST(min(round) AS INTEGER) AS round FROM ("
            "SELECT site, url, round FROM seed s WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE "
            "b.site = s.site AND b.url = s.url) UNION ALL SELECT site, url, 2 AS round FROM found) "
            "GROUP BY site, url)")


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["text_normalized"] = (f"SELECT doc_id, {collapse('text')} AS text, "
                            f"CAST(length({collapse('text')}) AS INTEGER) AS n_chars FROM documents")
    q["tokens"] = (f"SELECT token, count(*) AS n FROM ({tokens_sql(docs_sql(False))}) "
                   "GROUP BY token")
    q["alpha_tokens"] = (f"SELECT word, count(*) AS n FROM ({words_sql(docs_sql(False))}) "
                         "GROUP BY word")
    q["punct_stripped"] = (
        "SELECT regexp_replace(token, '[^\\p{L}\\p{N}_\\s]', '', 'g') AS stripped, count(*) AS n "
        f"FROM ({tokens_sql(docs_sql(False))}) GROUP BY 1")
    q["stems"] = f"WITH {terms_ctes(False, False)} SELECT word, term FROM vocab"
    q["stop_filtered"] = (f"WITH {terms_ctes(False, True)} "
                          "SELECT term, count(*) AS n FROM terms GROUP BY term")
    q["query_terms"] = f"WITH {query_terms_cte(BENCH_QUERIES)} SELECT query_id, term, qtf FROM qt"

    q["term_freq"] = f"WITH {index_ctes(False, True)} SELECT site, doc_key, term, tf FROM post"
    q["doc_freq"] = f"WITH {index_ctes(False, True)} SELECT site, term, df FROM dfreq"
    q["doc_count"] = f"WITH {index_ctes(False, True)} SELECT site, n FROM ndocs"
    q["top_terms"] = (f"WITH {index_ctes(False, True)} SELECT * FROM (SELECT site, doc_key, term, tf, "
                      "CAST(row_number() OVER (PARTITION BY site, doc_key ORDER BY tf DESC, term) "
                      "AS INTEGER) AS rank FROM post)")
    q["term_weights"] = (
        f"WITH {index_ctes(True, True)}, {query_terms_cte(BENCH_QUERIES)} "
        "SELECT k.term, d.df, n.n, n.n / coalesce(d.df, n.n) AS weight "
        "FROM (SELECT DISTINCT site, term FROM qt) k JOIN ndocs n ON k.site = n.site "
        "LEFT JOIN dfreq d ON d.site = k.site AND d.term = k.term")

    ranked, cond = _ranked()
    one = f"WITH {scored_ctes(ONE_QUERY, False)}, {ranked}"
    q["search_topk"] = f"{one} SELECT rank, doc_key, score FROM ranked{cond}"
    q["search_all_docs"] = f"WITH {scored_ctes(ONE_QUERY, False)} SELECT doc_key, score FROM scores"
    q["search_answer"] = (f"{one} SELECT r.rank, r.doc_key AS url, n.n AS no_of_docs "
                          f"FROM ranked r JOIN ndocs n ON r.site = n.site{cond.replace('rank', 'r.rank')}")
    q["search_batch"] = (f"WITH {scored_ctes(BENCH_QUERIES, True)}, {ranked} "
                         "SELECT r.query_id, r.rank, r.doc_key, r.score, n.n AS no_of_docs "
                         f"FROM ranked r JOIN ndocs n ON r.site = n.site{cond.replace('rank', 'r.rank')}")

    # URL scalars, page text (pages)
    q["pages_scan"] = "SELECT page_id, url, CAST(length(html) AS INTEGER) AS n_html FROM pages"
    q["url_base"] = f"SELECT page_id, {base_sql('url')} AS base FROM pages"
    q["url_host"] = f"SELECT page_id, {host_sql('url')} AS host FROM pages"
    q["site_key"] = f"SELECT page_id, {host_sql('url')} AS host, {site_sql('url')} AS site FROM pages"
    q["doc_key"] = f"SELECT page_id, {doc_key_sql('url')} AS doc_key FROM pages"
    q["doc_key_decode"] = f"SELECT page_id, {unquote_sql(doc_key_sql('url'))} AS url FROM pages"
    q["page_text"] = (f"SELECT page_id, {page_text_sql('html')} AS text, "
                      f"CAST(length({page_text_sql('html')}) AS INTEGER) AS n_chars FROM pages")

    # links (pages)
    q["links_raw"] = f"WITH {anchors_cte()} SELECT page_id, pos, href FROM anchors"
    q["links_resolved"] = f"WITH {links_ctes()} SELECT page_id, pos, link FROM links"
    q["link_filter"] = (f"WITH {links_ctes()} SELECT page_id, pos, {crawlable_sql('link')} AS crawlable "
                        "FROM links")
    scoped = (f"WITH sp AS ({SITE_PAGES}), {links_ctes('sp', 'site')}, crawled AS ({CRAWLED_PROBE}), "
              f"fresh AS (SELECT * FROM links l WHERE {in_scope_sql(LINK_PATTERN)} AND NOT EXISTS "
              "(SELECT 1 FROM crawled c WHERE c.site = l.site AND c.url = l.link))")
    q["new_links"] = f"{scoped} SELECT DISTINCT site, link FROM fresh"
    q["links_per_page"] = (f"{scoped} SELECT site, url, count(DISTINCT link) AS n FROM fresh "
                           "GROUP BY site, url")

    # one crawl round (pages)
    rc = f"WITH {round_ctes()}"
    q["frontier_batch"] = f"{rc} SELECT site, url, CAST(round AS INTEGER) AS round FROM batch"
    q["crawl_round"] = (f"{rc} SELECT site, url, CAST(round AS INTEGER) AS round, "
                        "html IS NOT NULL AS fetched FROM fetched")
    q["frontier_next"] = f"{rc} SELECT * FROM frontier_next"
    q["crawled_next"] = f"{rc} SELECT * FROM crawled_next"
    q["crawl_status"] = (f"{rc}, c AS (SELECT site, count(*) AS crawled FROM crawled_next GROUP BY site), "
                         "r AS (SELECT site, count(*) AS remaining FROM frontier_next GROUP BY site), "
                         "f AS (SELECT site, count(*) FILTER (html IS NOT NULL) AS fetched, count(*) AS total FROM fetched GROUP BY site), "
                         "s AS (SELECT coalesce(c.site, r.site) AS site, coalesce(c.crawled, 0) AS crawled, "
                         "coalesce(r.remaining, 0) AS remaining, "
                         "format('{} crawled, {} remaining, Stopped.', coalesce(c.crawled, 0), "
                         "coalesce(r.remaining, 0)) AS status FROM c FULL OUTER JOIN r ON c.site = r.site) "
                         "SELECT s.site, coalesce(fetched, 0) AS fetched, coalesce(total, 0) AS total, crawled, remaining, "
                         "status FROM s LEFT JOIN f ON f.site = s.site")

    # index maintenance: the merged DF equals a rebuild over the latest versions
    q["doc_freq_merged"] = f"WITH {index_ctes(False, True, RESENT_TEXT)} SELECT site, term, df FROM dfreq"
    q["latest_pages"] = (f"SELECT source AS site, CAST(doc_id AS VARCHAR) AS doc_key, "
                         f"CASE WHEN lang = 'de' THEN 2 ELSE 1 END AS version, "
                         f"CAST(length({collapse(RESENT_TEXT)}) AS INTEGER) AS n_chars FROM documents")

    # site registry
    reg = ("ev AS (SELECT " + site_sql("url") + " AS pageid, 'user' || CAST(page_id % 5 AS VARCHAR) "
           "AS owner, url, 'Pending' AS status, page_id AS seq FROM pages), "
           "sites AS (SELECT pageid, owner, url, status FROM (SELECT *, row_number() OVER "
           "(PARTITION BY pageid, owner ORDER BY seq) AS rn FROM ev) WHERE rn = 1), "
           "keys AS (SELECT hash, host FROM (SELECT pageid AS hash, " + host_sql("url") + " AS host, "
           "row_number() OVER (PARTITION BY pageid ORDER BY seq DESC) AS rn FROM ev) WHERE rn = 1), "
           "hosts AS (SELECT DISTINCT host FROM (SELECT " + host_sql("url") + " AS host FROM pages "
           "UNION ALL SELECT CASE WHEN starts_with(" + host_sql("url") + ", 'www.') THEN substring("
           + host_sql("url") + ", 5) ELSE 'www.' || " + host_sql("url") + " END FROM pages))")
    q["site_registry"] = f"WITH {reg} SELECT * FROM sites"
    q["site_hosts"] = (f"WITH {reg} SELECT h.hash, k.host FROM (SELECT sha256(host) AS hash FROM hosts) h "
                       "LEFT JOIN keys k ON k.hash = h.hash")
    q["site_deleted"] = f"WITH {reg} SELECT * FROM sites WHERE owner <> 'user0'"
    q["sites_of_owner"] = f"WITH {reg} SELECT pageid AS id, status, url FROM sites WHERE owner = 'user1'"
    q["site_is_indexed"] = (f"WITH {reg}, known AS (SELECT DISTINCT {host_sql('url')} AS h FROM sites) "
                            "SELECT host, EXISTS (SELECT 1 FROM known WHERE h = host) AS indexed FROM hosts")
    st_parts = "string_split(st, ',')"
    q["site_status_update"] = (
        f"WITH {round_ctes()}, {reg}, "
        "c AS (SELECT site, count(*) AS crawled FROM crawled_next GROUP BY site), "
        "r AS (SELECT site, count(*) AS remaining FROM frontier_next GROUP BY site), "
        "stat AS (SELECT coalesce(c.site, r.site) AS site, format('{} crawled, {} remaining, Stopped.', "
        "coalesce(c.crawled, 0), coalesce(r.remaining, 0)) AS status FROM c FULL OUTER JOIN r "
        "ON c.site = r.site), "
        "upd AS (SELECT s.pageid, s.owner, s.url, coalesce(t.status, s.status) AS st FROM sites s "
        "LEFT JOIN stat t ON t.site = s.pageid) "
        f"SELECT pageid, owner, url, CASE WHEN len({st_parts}) >= 2 THEN {st_parts}[1] || ', ' || "
        f"{st_parts}[2] || ', Crawling...' ELSE st END AS status FROM upd")
    q["rag_prompts"] = (
        f"WITH {scored_ctes(BENCH_QUERIES, True)}, {ranked}, "
        f"dt AS (SELECT doc_key, {collapse('text')} AS text FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_key, "
        "text FROM documents)) "
        f"SELECT r.query_id, r.doc_key AS url, {lit(PROMPT_WEB)} || ' Context: ' || "
        "coalesce(CASE WHEN ends_with(r.doc_key, 'pdf') THEN '' ELSE d.text END, '') || chr(10) || "
        "' Query: ' || b.query AS prompt FROM ranked r LEFT JOIN dt d ON d.doc_key = r.doc_key "
        f"JOIN ({BENCH_QUERIES}) b ON b.query_id = r.query_id WHERE r.rank = 1")
    q["search_conversations"] = (
        f"WITH {scored_ctes(CONV_QUERIES, True)}, {ranked} "
        "SELECT r.query_id, r.rank, r.doc_key, r.score, n.n AS no_of_docs "
        f"FROM ranked r JOIN ndocs n ON r.site = n.site{cond.replace('rank', 'r.rank')}")

    # stored index and what runs on it
    q["index_stored"] = q["term_freq"]
    q["index_bounds"] = (f"WITH {index_ctes(False, True)} SELECT site, term, max(tf) AS max_tf, "
                         "CAST(count(*) AS BIGINT) AS n FROM post GROUP BY site, term")
    q["search_pruned"], q["search_pruned_topk"] = q["search_batch"], q["search_topk"]
    q["page_search"] = (
        f"WITH {scored_ctes(BENCH_QUERIES, True, page_docs_sql(lit(ALL_SITE)))}, {ranked} "
        f"SELECT r.query_id, r.rank, r.doc_key, {unquote_sql('r.doc_key')} AS url, r.score, n.n AS no_of_docs "
        f"FROM ranked r JOIN ndocs n ON r.site = n.site{cond.replace('rank', 'r.rank')}")
    toggled = "CASE WHEN starts_with(host, 'www.') THEN substring(host, 5) ELSE 'www.' || host END"
    asked = (f"SELECT query_id, sha256(host) AS site, query FROM ("
             f"SELECT query_id, host, b.text AS query FROM ("
             f"SELECT page_id * 2 AS query_id, host, k FROM ({{p}}) UNION ALL "
             f"SELECT page_id * 2 + 1, {toggled}, k FROM ({{p}})) a JOIN ("
             "SELECT item_id - (SELECT min(item_id) FROM benchmark) AS j, text FROM benchmark) b ON a.k = b.j) "
             f"WHERE host IN (SELECT {host_sql('url')} FROM pages)").replace(
        "{p}", f"SELECT page_id, {host_sql('url')} AS host, page_id % (SELECT count(*) FROM benchmark) AS k FROM pages")
    q["search_extension"] = (
        f"WITH {scored_ctes(asked, True, page_docs_sql(site_sql('url')), irregular=False)}, {ranked} "
        "SELECT r.query_id, r.rank, r.doc_key, r.score, n.n AS no_of_docs "
        f"FROM ranked r JOIN ndocs n ON r.site = n.site{cond.replace('rank', 'r.rank')}")
    q["bundle_round_trip"] = f"WITH {index_ctes(True, True)} SELECT doc_key, term, tf FROM post"
    q["postings_json"] = (
        f"WITH {index_ctes(False, True)} SELECT site, doc_key, '{{' || string_agg(to_json(term) || ':' || tf, ',' "
        "ORDER BY tf DESC, term) || '}' AS json FROM post GROUP BY site, doc_key")

    # stored crawl state, many rounds
    q["crawl_state"] = f"{rc} SELECT site, url, CAST(round AS INTEGER) AS round FROM seed"
    seeds = f"seeds AS (SELECT site, min(url) AS url FROM ({SITE_PAGES}) GROUP BY site)"
    q["frontier_seeded"] = (
        f"WITH sp AS ({SITE_PAGES}), {links_ctes('sp', 'site')}, {seeds}, "
        f"f AS (SELECT DISTINCT site, link AS url, 1 AS round FROM links WHERE {in_scope_sql(LINK_PATTERN)}) "
        "SELECT * FROM f UNION ALL SELECT site, url, 0 FROM seeds WHERE site NOT IN (SELECT site FROM f)")
    # state: every URL of a site with its round, and the round in which it was
    # crawled; a seed waits (round null) until nothing else is left
    q["crawl_rounds"] = (
        f"WITH RECURSIVE sp AS ({SITE_PAGES}), {links_ctes('sp', 'site')}, {seeds}, "
        f"pg AS (SELECT sp.site, sp.url, {crawlable_sql('sp.url')} AS ok, "
        f"coalesce(list(DISTINCT l.link) FILTER ({in_scope_sql(LINK_PATTERN)}), []) AS found "
        "FROM sp LEFT JOIN links l ON l.site = sp.site AND l.url = sp.url GROUP BY sp.site, sp.url), "
        "st AS (SELECT 0 AS r, sp.site, sp.url, CASE WHEN s.url IS NULL THEN 0 END AS round, CAST(NULL AS INTEGER) AS crawled, "
        "CAST(NULL AS BOOLEAN) AS fetched FROM sp LEFT JOIN seeds s ON s.site = sp.site AND s.url = sp.url "
        "UNION ALL "
        "SELECT r, site, x.url, min(x.round), max(x.crawled), bool_or(x.fetched) FROM (SELECT r + 1 AS r, site, unnest("
        "[{'url': url, 'round': CASE WHEN hit THEN coalesce(round, 0) ELSE round END, 'crawled': CASE WHEN hit THEN r + 1 ELSE crawled END, "
        "'fetched': CASE WHEN hit THEN coalesce(ok, false) ELSE fetched END}] || "
        "list_transform(CASE WHEN hit AND ok THEN found ELSE [] END, lambda u: "
        "{'url': u, 'round': r + 1, 'crawled': CAST(NULL AS INTEGER), 'fetched': CAST(NULL AS BOOLEAN)})) AS x "
        "FROM (SELECT *, crawled IS NULL AND CASE WHEN round IS NULL THEN open = 0 ELSE rn <= " + str(12) + " END AS hit FROM ("
        "SELECT st.*, pg.ok, coalesce(pg.found, []) AS found, "
        "row_number() OVER (PARTITION BY st.site, crawled IS NULL AND round IS NOT NULL ORDER BY round, st.url) AS rn, "
        "count(*) FILTER (crawled IS NULL AND round IS NOT NULL) OVER (PARTITION BY st.site) AS open, "
        "count(*) FILTER (crawled IS NULL) OVER (PARTITION BY st.site) AS todo "
        "FROM st LEFT JOIN pg ON pg.site = st.site AND pg.url = st.url)) WHERE todo > 0) GROUP BY r, site, x.url) "
        "SELECT site, url, crawled AS round, fetched FROM st "
        "QUALIFY r = max(r) OVER (PARTITION BY site)")

    # change log: each pair's first registration since its last deletion, with
    # the status told after it, or the mark of a crawl after both
    ev = (f"p AS (SELECT page_id AS i, url, {host_sql('url')} AS host, {site_sql('url')} AS pageid, "
          "'user' || CAST(page_id % 5 AS VARCHAR) AS owner FROM pages), "
          "gone AS (SELECT pageid, owner, max(i * 10 + 7) AS gone FROM p WHERE i % 11 = 3 GROUP BY pageid, owner), "
          "reg AS (SELECT p.pageid, p.owner, url, i * 10 AS seq, row_number() OVER (PARTITION BY p.pageid, p.owner ORDER BY i) AS rn "
          "FROM p LEFT JOIN gone g ON g.pageid = p.pageid AND g.owner = p.owner WHERE gone IS NULL OR i * 10 > gone), "
          "told AS (SELECT pageid, i * 10 + 3 AS at, format('{} crawled, {} remaining, Stopped.', i, i % 13) AS status FROM p WHERE i % 4 = 1), "
          "mark AS (SELECT pageid, i * 10 + 5 AS at FROM p WHERE i % 7 = 2), "
          "cur AS (SELECT reg.pageid, reg.owner, reg.url, coalesce(arg_max(told.status, told.at), 'Pending') AS status, "
          "coalesce(max(told.at), any_value(reg.seq)) AS since FROM reg LEFT JOIN told ON told.pageid = reg.pageid AND told.at > reg.seq "
          "WHERE rn = 1 GROUP BY ALL) ")
    parts = "string_split(cur.status, ',')"
    q["registry_log"] = (
        f"WITH {ev} SELECT pageid, owner, url, CASE WHEN len({parts}) >= 2 AND EXISTS (SELECT 1 FROM mark WHERE mark.pageid = cur.pageid "
        f"AND mark.at > cur.since) THEN {parts}[1] || ', ' || {parts}[2] || ', Crawling...' ELSE cur.status END AS status FROM cur")
    q["registry_log_keys"] = f"WITH {ev} SELECT pageid AS hash, arg_max(host, i) AS host FROM p GROUP BY pageid"

    # stream: the sum of the deltas equals a rebuild over the latest versions
    q["stream_index"] = q["doc_freq_merged"]
    q["stream_progress"] = (
        f"{rc} SELECT CAST(0 AS BIGINT) AS version, count(*) FILTER (html IS NOT NULL) AS fetched, "
        "count(*) FILTER (html IS NULL) AS failed, count(*) AS total FROM fetched "
        "UNION ALL SELECT 1, count(html), count(*) - count(html), count(*) FROM pages")
    return q


ORACLE_SQL = build()
