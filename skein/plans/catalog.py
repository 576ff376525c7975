"""Named Spark jobs over the driver's test tables (the ``queries()`` of
``__spark_entry__``).  Each takes (spark, sf_dir) and returns a DataFrame over
whole tables; ``skein.plans.oracle`` has the matching DuckDB SQL.

Fixed inputs (SURVEY §5):
* documents -> one site per ``source`` (key = doc_id) for TF / DF keys, and
  one site ``all`` spanning every document for the search keys;
* benchmark texts are the query workload (query_id = item_id);
* the single-query keys use the query ``the en in`` on an index without a
  stop list, so those words are searchable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import urls
from skein.functions.stem import with_stem
from skein.functions.text import collapse_ws, page_text, strip_punct
from skein.operators import analyze, frontier as fr, index as ix, links as lk, pruned, rag
from skein.operators import registry as rg, search
from skein.plans import crawl
from skein.session import scratch_path
from skein.sources import bundle, corpus, index_store, registry_log, tables
from skein.streaming import incremental

ALL_SITE = "all"
SINGLE_QUERY = "the en in"
K = 10
LINK_PATTERN = "/t"        # pattern of the new_links key
CRAWLED_PATH = "/the"      # base + this path is the crawled set of the link keys
BATCH_N = 5                # URLs per site per round in the frontier keys


# ---- shared inputs ---------------------------------------------------------
def by_page(docs: DataFrame) -> DataFrame:
    """Docs dealt by page, at every size: the tables are one row group each,
    and counting the terms of a page then needs no exchange of its own."""
    return docs.repartition("site", "doc_key")


def docs_by_source(spark, sf_dir) -> DataFrame:
    return by_page(source_docs(spark, sf_dir))


def source_docs(spark, sf_dir) -> DataFrame:
    """As read, for an index: that deals them by page itself."""
    return ix.docs_from_documents(tables.documents(spark, sf_dir))


def docs_one_site(spark, sf_dir) -> DataFrame:
    return ix.docs_from_documents(tables.documents(spark, sf_dir), site=ALL_SITE)


def conversation_queries(spark, sf_dir) -> DataFrame:
    """User turns of ``conversations`` as queries: query_id = conv_id * 10000 + turn."""
    c = tables.conversations(spark, sf_dir).where(F.col("role") == "user")
    return c.select((F.col("conv_id") * 10000 + F.col("turn")).alias("query_id"),
                    F.lit(ALL_SITE).alias("site"), F.col("text").alias("query"))


def benchmark_queries(spark, sf_dir) -> DataFrame:
    return tables.benchmark(spark, sf_dir).select(
        F.col("item_id").alias("query_id"), F.lit(ALL_SITE).alias("site"),
        F.col("text").alias("query"))


def one_site_index(spark, sf_dir, stopwords="nltk") -> dict:
    return ix.build_index(docs_one_site(spark, sf_dir), stopwords)


# ---- text analysis ---------------------------------------------------------
def q_text_normalized(spark, sf_dir):
    d = tables.documents(spark, sf_dir)
    t = collapse_ws(F.col("text"))
    return d.select("doc_id", t.alias("text"), F.length(t).alias("n_chars"))


def q_tokens(spark, sf_dir):
    toks = analyze.tokens(docs_by_source(spark, sf_dir))
    return toks.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def q_alpha_tokens(spark, sf_dir):
    words = analyze.alpha_words(analyze.tokens(docs_by_source(spark, sf_dir)))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def q_punct_stripped(spark, sf_dir):
    toks = analyze.tokens(docs_by_source(spark, sf_dir))
    return (toks.select(strip_punct(F.col("token")).alias("stripped"))
                .groupBy("stripped").agg(F.count(F.lit(1)).alias("n")))


def q_stems(spark, sf_dir):
    words = analyze.alpha_words(analyze.tokens(docs_by_source(spark, sf_dir)))
    vocab = words.select("word").distinct()
    return with_stem(vocab, "word", "term")


def q_stop_filtered(spark, sf_dir):
    terms = analyze.term_counts(docs_by_source(spark, sf_dir), stopwords="nltk", once=False)
    return terms.groupBy("term").agg(F.sum("tf").alias("n"))


def q_query_terms(spark, sf_dir):
    return analyze.query_terms(benchmark_queries(spark, sf_dir)).drop("site")


# ---- index -----------------------------------------------------------------
def q_term_freq(spark, sf_dir):
    return ix.term_freq(source_docs(spark, sf_dir))


def q_doc_freq(spark, sf_dir):
    return ix.doc_freq(ix.term_freq(source_docs(spark, sf_dir)))


def q_doc_count(spark, sf_dir):
    return ix.doc_count(source_docs(spark, sf_dir))


def q_top_terms(spark, sf_dir):
    return ix.top_terms(ix.term_freq(source_docs(spark, sf_dir)))


def q_term_weights(spark, sf_dir):
    """J2 on the one-site index: stopwords and punctuated query tokens are
    absent from doc_freq, so they take the default df = N (weight 1)."""
    idx = one_site_index(spark, sf_dir)
    qt = analyze.query_terms(benchmark_queries(spark, sf_dir))
    return search.term_weights(idx["doc_freq"], idx["doc_count"], qt).drop("site")


# ---- search ----------------------------------------------------------------
def q_search_topk(spark, sf_dir):
    idx = one_site_index(spark, sf_dir, stopwords=None)
    return search.search_topk(idx, ALL_SITE, SINGLE_QUERY, K).select("rank", "doc_key", "score")


def q_search_all_docs(spark, sf_dir):
    idx = one_site_index(spark, sf_dir, stopwords=None)
    return search.search_all_docs(idx, ALL_SITE, SINGLE_QUERY)


def q_search_answer(spark, sf_dir):
    idx = one_site_index(spark, sf_dir, stopwords=None)
    return search.search_answer(idx, ALL_SITE, SINGLE_QUERY, K)


def q_search_conversations(spark, sf_dir):
    idx = one_site_index(spark, sf_dir)
    return search.search_batch(idx, conversation_queries(spark, sf_dir), K).drop("url")


def q_search_batch(spark, sf_dir):
    idx = one_site_index(spark, sf_dir)
    return search.search_batch(idx, benchmark_queries(spark, sf_dir), K).drop("url")


# ---- URL scalars and page text (pages) --------------------------------------
def q_pages_scan(spark, sf_dir):
    p = tables.pages(spark, sf_dir)
    return p.select("page_id", "url", F.length("html").alias("n_html"))


def q_url_base(spark, sf_dir):
    return tables.pages(spark, sf_dir).select("page_id", urls.base_url(F.col("url")).alias("base"))


def q_url_host(spark, sf_dir):
    return tables.pages(spark, sf_dir).select("page_id", urls.host(F.col("url")).alias("host"))


def q_site_key(spark, sf_dir):
    p = tables.pages(spark, sf_dir)
    return p.select("page_id", urls.host(F.col("url")).alias("host"),
                    urls.site_key(F.col("url")).alias("site"))


def q_doc_key(spark, sf_dir):
    return tables.pages(spark, sf_dir).select("page_id", urls.doc_key(F.col("url")).alias("doc_key"))


def q_doc_key_decode(spark, sf_dir):
    p = tables.pages(spark, sf_dir)
    return p.select("page_id", urls.unquote(urls.doc_key(F.col("url"))).alias("url"))


def q_page_text(spark, sf_dir):
    p = tables.pages(spark, sf_dir)
    t = page_text(F.col("html"))
    return p.select("page_id", t.alias("text"), F.length(t).alias("n_chars"))


# ---- links (pages) ------------------------------------------------------------
def page_sites(spark, sf_dir) -> DataFrame:
    return tables.pages(spark, sf_dir).select(
        urls.site_key(F.col("url")).alias("site"), "page_id", "url", "html")


def crawled_probe(spark, sf_dir) -> DataFrame:
    """The crawled set of the link keys: base + '/the' for every page."""
    return tables.pages(spark, sf_dir).select(
        urls.site_key(F.col("url")).alias("site"),
        F.concat(urls.base_url(F.col("url")), F.lit(CRAWLED_PATH)).alias("url")).distinct()


def q_links_raw(spark, sf_dir):
    return lk.anchors(tables.pages(spark, sf_dir)).drop("url")


def q_links_resolved(spark, sf_dir):
    return lk.resolved_links(tables.pages(spark, sf_dir)).select("page_id", "pos", "link")


def q_link_filter(spark, sf_dir):
    links = lk.resolved_links(tables.pages(spark, sf_dir))
    return links.select("page_id", "pos", urls.is_crawlable(F.col("link")).alias("crawlable"))


def q_new_links(spark, sf_dir):
    return lk.new_links(page_sites(spark, sf_dir), crawled_probe(spark, sf_dir), LINK_PATTERN)


def q_links_per_page(spark, sf_dir):
    return lk.links_per_page(page_sites(spark, sf_dir), crawled_probe(spark, sf_dir), LINK_PATTERN)


# ---- one crawl round (pages) ---------------------------------------------------
def seed_frontier(spark, sf_dir) -> DataFrame:
    """Round 0: every page URL; round 1: every in-scope link found on them
    (most are not pages, so fetching them fails)."""
    p = page_sites(spark, sf_dir)
    pages0 = p.select("site", "url", F.lit(0).alias("round"))
    found = (lk.in_scope(lk.resolved_links(p, keys=("site",)))
               .select("site", F.col("link").alias("url"), F.lit(1).alias("round")))
    return fr.union_urls(pages0, found).select("site", "url", F.col("round").cast("int"))


def one_round(spark, sf_dir) -> dict:
    return fr.crawl_round(seed_frontier(spark, sf_dir), fr.empty(spark),
                          tables.pages(spark, sf_dir), BATCH_N, round_no=2)


def q_frontier_batch(spark, sf_dir):
    return fr.frontier_batch(seed_frontier(spark, sf_dir), BATCH_N)


def q_crawl_round(spark, sf_dir):
    return one_round(spark, sf_dir)["fetched"].drop("html")


def q_frontier_next(spark, sf_dir):
    return one_round(spark, sf_dir)["frontier"]


def q_crawled_next(spark, sf_dir):
    return one_round(spark, sf_dir)["crawled"]


def q_crawl_status(spark, sf_dir):
    return one_round(spark, sf_dir)["status"]


# ---- site registry (pages; owner = 'user' || page_id % 5) ---------------------
def registration(spark, sf_dir) -> DataFrame:
    owner = F.concat(F.lit("user"), (F.col("page_id") % 5).cast("string"))
    return rg.registration_events(tables.pages(spark, sf_dir), owner)


def registry_sites(spark, sf_dir) -> DataFrame:
    return rg.register(spark.createDataFrame([], "pageid string, owner string, url string, "
                                                 "status string"), registration(spark, sf_dir))


def registry_keys(spark, sf_dir) -> DataFrame:
    ev = registration(spark, sf_dir).select(F.col("pageid").alias("hash"),
                                            urls.host(F.col("url")).alias("host"), "seq")
    return rg.upsert_site_keys(spark.createDataFrame([], "hash string, host string"), ev)


def toggled_hosts(spark, sf_dir) -> DataFrame:
    """Hosts of every page plus the same host with 'www.' added or removed
    (those are mostly unregistered)."""
    h = urls.host(F.col("url"))
    p = tables.pages(spark, sf_dir)
    return p.select(h.alias("host")).unionByName(p.select(toggled(h).alias("host"))).distinct()


def toggled(host):
    return F.when(host.startswith("www."), host.substr(F.lit(5), F.length(host))).otherwise(F.concat(F.lit("www."), host))


def q_site_registry(spark, sf_dir):
    return registry_sites(spark, sf_dir)


def q_site_hosts(spark, sf_dir):
    hashes = toggled_hosts(spark, sf_dir).select(urls.site_hash(F.col("host")).alias("hash"))
    return rg.host_of(hashes, registry_keys(spark, sf_dir))


def q_site_status_update(spark, sf_dir):
    st = one_round(spark, sf_dir)["status"].select(F.col("site").alias("pageid"), "status")
    sites = rg.update_status(registry_sites(spark, sf_dir), st)
    return rg.set_crawling(sites, sites.select("pageid"))


def q_sites_of_owner(spark, sf_dir):
    return rg.sites_of_owner(registry_sites(spark, sf_dir), "user1")


def q_site_deleted(spark, sf_dir):
    sites = registry_sites(spark, sf_dir)
    return rg.delete_sites(sites, sites.where(F.col("owner") == "user0"))


def q_site_is_indexed(spark, sf_dir):
    return rg.is_indexed(toggled_hosts(spark, sf_dir), registry_sites(spark, sf_dir))


def q_rag_prompts(spark, sf_dir):
    return rag.rag_prompts(one_site_index(spark, sf_dir), benchmark_queries(spark, sf_dir))


# ---- index maintenance (documents) -------------------------------------------
RESENT_LANG = "de"                  # pages of this language are re-crawled, changed
ROUND1_LANGS = ["en", "de"]         # first crawl round; the others come in round 2


def versioned_docs(spark, sf_dir) -> DataFrame:
    """Version 1 of every document; version 2 (text with 'e' -> 'a') of the
    re-sent ones."""
    d = tables.documents(spark, sf_dir)
    v1 = ix.docs_from_documents(d).withColumn("version", F.lit(1))
    changed = d.where(F.col("lang") == RESENT_LANG).withColumn("text", F.replace("text", F.lit("e"), F.lit("a")))
    v2 = ix.docs_from_documents(changed).withColumn("version", F.lit(2))
    return v1.unionByName(v2)


def q_latest_pages(spark, sf_dir):
    latest = ix.latest_versions(versioned_docs(spark, sf_dir))
    return latest.select("site", "doc_key", "version", F.length("text").alias("n_chars"))


def q_doc_freq_merged(spark, sf_dir):
    d = tables.documents(spark, sf_dir)
    langs = d.select(F.col("source").alias("site"),
                     F.col("doc_id").cast("string").alias("doc_key"), "lang")
    v = versioned_docs(spark, sf_dir).join(langs, ["site", "doc_key"], "inner")
    round1 = v.where((F.col("version") == 1) & F.col("lang").isin(ROUND1_LANGS))
    round2 = ix.latest_versions(v.where((F.col("version") == 2) | ~F.col("lang").isin(ROUND1_LANGS)))
    post1 = ix.term_freq(round1.drop("version", "lang"))
    post2 = ix.term_freq(round2.drop("version", "lang"))
    replaced = post1.join(round2.select("site", "doc_key"), ["site", "doc_key"], "left_semi")
    return ix.merge_doc_freq(ix.doc_freq(post1), ix.doc_freq_delta(post2, replaced))


def q_postings_json(spark, sf_dir):
    post = ix.term_freq(source_docs(spark, sf_dir))
    return ix.postings_map(post, by_page=True).select("site", "doc_key", F.to_json("terms").alias("json"))


# ---- stored index ------------------------------------------------------------
def stored_index(spark, docs: DataFrame, stopwords="nltk") -> dict:
    return index_store.build_and_store(docs, scratch_path(spark, "index"), stopwords)


def q_index_stored(spark, sf_dir):
    """S2 + S3: the postings, written and read back."""
    return stored_index(spark, source_docs(spark, sf_dir))["postings"].select("site", "doc_key", "term", "tf")


def q_index_bounds(spark, sf_dir):
    """What the stored bounds say of each term: greatest tf and postings."""
    b = stored_index(spark, source_docs(spark, sf_dir))["bounds"]
    return b.groupBy("site", "term").agg(F.max("max_tf").alias("max_tf"), F.sum("n").alias("n"))


def q_search_pruned(spark, sf_dir):
    """W1 over a stored index, leaving out blocks below the k-th score."""
    idx = stored_index(spark, docs_one_site(spark, sf_dir))
    return pruned.search_batch(idx, benchmark_queries(spark, sf_dir), K).drop("url")


def q_search_pruned_topk(spark, sf_dir):
    idx = stored_index(spark, docs_one_site(spark, sf_dir), stopwords=None)
    return pruned.search_topk(idx, ALL_SITE, SINGLE_QUERY, K).select("rank", "doc_key", "score")


def page_docs(spark, sf_dir, site: str | None = ALL_SITE) -> DataFrame:
    p = tables.pages(spark, sf_dir)
    return ix.docs_from_pages(p.withColumn("site", F.lit(site)), site_col="site") if site else ix.docs_from_pages(p)


def q_page_search(spark, sf_dir):
    """HTML pages -> text -> stored index -> search, in one job."""
    idx = stored_index(spark, page_docs(spark, sf_dir))
    return pruned.search_batch(idx, benchmark_queries(spark, sf_dir), K)


def q_search_extension(spark, sf_dir):
    """The offline route: requests (host, query) are answered for indexed
    hosts only, from the host's own pages; query words are stemmed as the
    offline ranking does.  Each page asks for its host, and for the host with
    'www.' toggled, one benchmark text."""
    p = tables.pages(spark, sf_dir).select("page_id", urls.host(F.col("url")).alias("host"))
    b = tables.benchmark(spark, sf_dir)
    n = b.agg(F.count("*").alias("n"), F.min("item_id").alias("least"))
    text = b.crossJoin(F.broadcast(n)).select((F.col("item_id") - F.col("least")).alias("k"), F.col("text").alias("query"))
    p = p.crossJoin(F.broadcast(n)).withColumn("k", F.pmod("page_id", "n"))       # n is one row
    asked = p.select((F.col("page_id") * 2).alias("query_id"), "host", "k").unionByName(
        p.select((F.col("page_id") * 2 + 1).alias("query_id"), toggled(F.col("host")).alias("host"), "k"))
    requests = asked.join(text, "k").select("query_id", "host", "query")
    return search.search_indexed(stored_index(spark, page_docs(spark, sf_dir, None)), requests,
                                 registry_sites(spark, sf_dir), K).drop("url")


def q_bundle_round_trip(spark, sf_dir):
    """S8 + S7: a site exported as a bundle and imported again."""
    root = scratch_path(spark, "bundle")
    bundle.export_bundle(one_site_index(spark, sf_dir), ALL_SITE, root)
    return bundle.import_export(spark, root, ALL_SITE)["postings"].select("doc_key", "term", "tf")


# ---- stored crawl state, many rounds --------------------------------------------
ROUNDS_N = 12              # URLs per site and round of the many-round crawl


def site_seeds(spark, sf_dir) -> DataFrame:
    """The first page URL of every site."""
    return page_sites(spark, sf_dir).groupBy("site").agg(F.min("url").alias("url"))


def q_crawl_state(spark, sf_dir):
    """S6 + S5: the frontier written as text lines and read back."""
    path = scratch_path(spark, "crawl-state")
    fr.save_sites(seed_frontier(spark, sf_dir), path)
    return fr.load_sites(spark, path)


def q_frontier_seeded(spark, sf_dir):
    """Sites without a link that fits the pattern start from their seed."""
    links = lk.in_scope(lk.resolved_links(page_sites(spark, sf_dir), keys=("site",)), LINK_PATTERN)
    found = links.select("site", F.col("link").alias("url")).distinct().withColumn("round", F.lit(1))
    return fr.with_seeds(found, site_seeds(spark, sf_dir))


def q_crawl_rounds(spark, sf_dir):
    """L8 + L9: from a frontier of all pages but the seeds, rounds of ROUNDS_N
    URLs a site over a stored corpus until no site has any left; the seeds of
    sites without a frontier come in as those run dry."""
    seeds = site_seeds(spark, sf_dir)
    pages = page_sites(spark, sf_dir).select("site", "url", F.lit(0).alias("round"))
    state = scratch_path(spark, "crawl-start")
    fr.save_sites(pages.join(seeds, ["site", "url"], "left_anti"), state)
    out = crawl.crawl_until_done(spark, corpus.store_corpus(tables.pages(spark, sf_dir)), seeds, ROUNDS_N, LINK_PATTERN,
                                 frontier=fr.load_sites(spark, state), stored=True)
    return out["crawled"].join(out["tried"].select("site", "url", "fetched"), ["site", "url"])


# ---- change log, stream ----------------------------------------------------------
def registry_events(spark, sf_dir) -> DataFrame:
    """Events of every page, ten sequence numbers apart: its host, its owner's
    registration, and for some pages a status, a crawl or a deletion."""
    p = tables.pages(spark, sf_dir)
    p = p.select("page_id", "url", urls.host(F.col("url")).alias("host"), urls.site_key(F.col("url")).alias("pageid"),
                 F.concat(F.lit("user"), F.col("page_id") % 5).alias("owner"))
    i = F.col("page_id")
    make = lambda kind, at, rows, **c: registry_log.events(
        rows, kind, F.concat(F.lit(kind + "-"), i), i * 10 + at, pageid=F.col("pageid"), **c)
    told = F.format_string(fr.STATUS_FMT, i, i % 13)
    out = make("register", 0, p, owner=F.col("owner"), url=F.col("url"), status=F.lit("Pending"))
    for part in (make("site_key", 1, p, host=F.col("host")), make("status", 3, p.where(i % 4 == 1), status=told),
                 make("crawling", 5, p.where(i % 7 == 2)), make("delete", 7, p.where(i % 11 == 3), owner=F.col("owner"))):
        out = out.unionByName(part)
    return out


def registry_history(spark, sf_dir) -> dict[str, DataFrame]:
    """The events in two batches; the first is compacted, then delivered again
    along with the second; a third is left half-way, without its marker."""
    root, log = scratch_path(spark, "registry-log"), registry_events(spark, sf_dir)
    half = F.broadcast(log.agg((F.max("seq") / 2).alias("half")))       # one row
    early = log.join(half, F.col("seq") < F.col("half")).drop("half")
    registry_log.append(early, root, 1)
    registry_log.compact(spark, root)
    registry_log.append(log, root, 2)
    early.withColumn("event_id", F.concat(F.lit("lost-"), "event_id")).write.parquet(f"{root}/events/batch=3")
    return registry_log.load(spark, root)


def q_registry_log(spark, sf_dir):
    return registry_history(spark, sf_dir)["sites"]


def q_registry_log_keys(spark, sf_dir):
    return registry_history(spark, sf_dir)["site_keys"]


def run_streams(spark, sf_dir) -> str:
    """Two runs of one stream: the first round's documents, then the others
    and the re-sent ones; the index so far is compacted in between."""
    src, out = scratch_path(spark, "stream-source"), scratch_path(spark, "stream")
    d = tables.documents(spark, sf_dir)
    first = F.col("lang").isin(ROUND1_LANGS)
    changed = d.where(F.col("lang") == RESENT_LANG).withColumn("text", F.replace("text", F.lit("e"), F.lit("a")))
    for part in (d.where(first), d.where(~first | F.col("lang").isNull()).unionByName(changed)):
        part.write.mode("append").parquet(src)
        incremental.run_index_stream(spark, src, out, kind="documents", max_files_per_trigger=100_000)
        incremental.compact(spark, out)
    return out


def q_stream_index(spark, sf_dir):
    """T1 + A3: document frequency as the sum of the stream's deltas."""
    return incremental.current_index(spark, run_streams(spark, sf_dir))["doc_freq"]


def q_stream_progress(spark, sf_dir):
    """T2 + T3: counts of each batch of a stream over what a crawl round
    fetched (failed fetches have no HTML), then over all pages."""
    src, out = scratch_path(spark, "stream-source"), scratch_path(spark, "stream")
    got = one_round(spark, sf_dir)["fetched"].select(F.lit(None).cast("long").alias("page_id"), "url", "html")
    for part in (got, tables.pages(spark, sf_dir)):
        part.write.mode("append").parquet(src)
        incremental.run_index_stream(spark, src, out, kind="pages", max_files_per_trigger=100_000)
    return incremental.stored_progress(spark, out)


QUERIES = {
    "index_stored": q_index_stored,
    "index_bounds": q_index_bounds,
    "search_pruned": q_search_pruned,
    "search_pruned_topk": q_search_pruned_topk,
    "page_search": q_page_search,
    "search_extension": q_search_extension,
    "bundle_round_trip": q_bundle_round_trip,
    "crawl_state": q_crawl_state,
    "frontier_seeded": q_frontier_seeded,
    "crawl_rounds": q_crawl_rounds,
    "registry_log": q_registry_log,
    "registry_log_keys": q_registry_log_keys,
    "stream_index": q_stream_index,
    "stream_progress": q_stream_progress,
    "latest_pages": q_latest_pages,
    "doc_freq_merged": q_doc_freq_merged,
    "postings_json": q_postings_json,
    "site_registry": q_site_registry,
    "site_hosts": q_site_hosts,
    "site_status_update": q_site_status_update,
    "site_deleted": q_site_deleted,
    "sites_of_owner": q_sites_of_owner,
    "site_is_indexed": q_site_is_indexed,
    "rag_prompts": q_rag_prompts,
    "pages_scan": q_pages_scan,
    "url_base": q_url_base,
    "url_host": q_url_host,
    "site_key": q_site_key,
    "doc_key": q_doc_key,
    "doc_key_decode": q_doc_key_decode,
    "page_text": q_page_text,
    "links_raw": q_links_raw,
    "links_resolved": q_links_resolved,
    "link_filter": q_link_filter,
    "new_links": q_new_links,
    "links_per_page": q_links_per_page,
    "frontier_batch": q_frontier_batch,
    "crawl_round": q_crawl_round,
    "frontier_next": q_frontier_next,
    "crawled_next": q_crawled_next,
    "crawl_status": q_crawl_status,
    "text_normalized": q_text_normalized,
    "tokens": q_tokens,
    "alpha_tokens": q_alpha_tokens,
    "punct_stripped": q_punct_stripped,
    "stems": q_stems,
    "stop_filtered": q_stop_filtered,
    "query_terms": q_query_terms,
    "term_freq": q_term_freq,
    "doc_freq": q_doc_freq,
    "doc_count": q_doc_count,
    "top_terms": q_top_terms,
    "term_weights": q_term_weights,
    "search_topk": q_search_topk,
    "search_all_docs": q_search_all_docs,
    "search_answer": q_search_answer,
    "search_batch": q_search_batch,
    "search_conversations": q_search_conversations,
}
