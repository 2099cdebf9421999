"""A crawl over saved pages: from seeds along links, citations extracted from what is reached.

One pass over the pages keeps each page's link targets and citations, without its text; the search then goes level by level over
that table by anti-join on normalised addresses (`frontier.explored`), so a page's HTML is read once however deep the crawl is.
A page that was saved twice under one normalised address counts once: the one with the least address as written.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.links import targets, visible_text
from assayer.functions.text import normalized_url
from assayer.operators.discovery import CITATIONS, Citation, citation_jurisdiction, citations_in
from assayer.operators.frontier import explored
from assayer.sources.stored import written


@dataclass
class Crawl:
    visited: DataFrame  # url, depth (seeds: 0), via (the page whose link was first), saved
    citations: DataFrame  # citation, jurisdiction, url (where it is met first), depth


def outlines(pages: DataFrame, forms: Sequence[Citation] = CITATIONS) -> DataFrame:
    """url (normalised), targets, citations of each saved page (url, html). Pages without an address are left out."""
    rows = pages.where("url IS NOT NULL").select(normalized_url(F.col("url")).alias("key"), F.col("url").alias("at"), "html")
    least = rows.groupBy("key").agg(F.min("at").alias("at"))  # ahead of the texts, which stay out of the shuffle's buffers
    found = rows.select("key", "at", targets(F.col("html"), F.col("at")).alias("targets"), citations_in(visible_text(F.col("html")), forms).alias("citations"))
    first = found.join(least, ["key", "at"], "left_semi")
    # rows that share the address as written too: the one with the least outline
    return first.groupBy(F.col("key").alias("url")).agg(F.min(F.struct("targets", "citations")).alias("o")).select("url", "o.*")


def crawled(pages: DataFrame, seeds: DataFrame, depth: int = 1, follow: Column | None = None, links_per_page: int | None = None, most: int = 1 << 62, forms: Sequence[Citation] = CITATIONS) -> Crawl:
    """Crawl from seeds (url) to a depth over saved pages (url, html).

    follow: a condition over dst, the address a link leads to. links_per_page: so many links of a page count, in their order
    (of those to be followed); most: so many pages are found at most. Addresses that were not saved are visited without a
    result. A citation is told once, where it is met first: by depth, then by address.
    """
    known = written(outlines(pages, forms))
    links = known.select(F.col("url").alias("src"), F.posexplode("targets").alias("place", "dst"))
    if follow is not None:
        links = links.where(follow)
    if links_per_page is not None:
        kept = links.groupBy("src").agg(F.slice(F.array_sort(F.collect_list(F.struct("place", "dst"))), 1, links_per_page).alias("l"))
        links = kept.select("src", F.inline("l"))
    start = seeds.where("url IS NOT NULL").select(normalized_url(F.col("url")).alias("node")).distinct()
    found = explored(start.withColumn("seed_rank", F.xxhash64("node")), links, depth=depth, most=most).nodes
    visited = start.select(F.col("node").alias("url"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via"))
    visited = visited.unionByName(found.select(F.col("node").alias("url"), "depth", F.col("cited_by").alias("via")))
    reached = written(visited.join(known.select("url", "citations", F.lit(True).alias("saved")), "url", "left"))
    met = reached.select(F.explode("citations").alias("citation"), "depth", "url")
    first = met.groupBy("citation").agg(F.min(F.struct("depth", "url")).alias("at"))
    told = first.select("citation", citation_jurisdiction(F.col("citation"), forms).alias("jurisdiction"), "at.url", "at.depth")
    return Crawl(reached.select("url", "depth", "via", F.coalesce("saved", F.lit(False)).alias("saved")), told)
