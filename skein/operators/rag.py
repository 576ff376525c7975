"""Retrieval context for summaries (J9, G1-G3): for every query, its best page
and the prompt a language model would get.  The model call itself is not part
of the engine; the output is a prompt table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.broadcast import MAX_BROADCAST_ROWS, fits
from skein.operators.search import search_batch, shared, with_folders

# The two instruction texts that open a prompt.
PROMPT_WEB = "You are an assistant providing answers based solely on context."
PROMPT_EXTENSION = ("You are a assistant who will be given with context and query. You need to "
                    "answer question based on facts mentioned in context and nothing else. "
                    "The context and query is as follows:")


def context_text(url: Column, text: Column) -> Column:
    """G1: no context for a URL ending in 'pdf'."""
    return F.when(url.endswith("pdf"), F.lit("")).otherwise(text)


def prompt(instruction: str, context: Column, query: Column) -> Column:
    """G2: '<instruction> Context: <context>\\n Query: <query>'."""
    return F.concat(F.lit(instruction), F.lit(" Context: "), context, F.lit("\n Query: "), query)


def best_pages(index: dict, queries: DataFrame, irregular: bool = True) -> DataFrame:
    """The rank-1 page of every query (query_id, site, doc_key, url)."""
    top = search_batch(index, queries, k=1, irregular=irregular)
    return top.join(queries.select("query_id", "site"), "query_id", "inner") \
              .select("query_id", "site", "doc_key", "url")


def rag_prompts(index: dict, queries: DataFrame, instruction: str = PROMPT_WEB,
                irregular: bool = True) -> DataFrame:
    """J9 + G1 + G2: (query_id, url, prompt) with the best page's stored text
    as context; a site without pages gives no row.  Every page found is a row
    of the index's docs, and there is one a query: where the queries are few
    enough the pages found are broadcast, and no text but theirs is moved."""
    best = with_folders(index, best_pages(index, queries, irregular), term=False)
    if fits(queries, MAX_BROADCAST_ROWS):
        best = F.broadcast(best)
    docs = index["docs"].drop("url")
    ctx = docs.join(best, shared(docs, best, "site", "doc_key"))
    q = queries.select("query_id", "query")
    return (ctx.join(q, "query_id", "inner")
               .select("query_id", "url",
                       prompt(instruction, F.coalesce(context_text(F.col("url"), F.col("text")),
                                                      F.lit("")),
                              F.col("query")).alias("prompt")))
