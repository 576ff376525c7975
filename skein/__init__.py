"""skein: site-search indexing and ranking as Spark DataFrame jobs.

Layout
------
functions/  Column -> Column building blocks (URLs, text, stemming, prompts)
operators/  DataFrame -> DataFrame operators (analysis, index, search, links,
            frontier, registry, retrieval context)
sources/    table scans and index / crawl-state / bundle storage
plans/      end-to-end jobs composed from the operators (index build, crawl
            rounds, site search)
streaming/  incremental index maintenance with Structured Streaming
"""

from skein.session import get_spark, checkpoint_root

__all__ = ["get_spark", "checkpoint_root"]
