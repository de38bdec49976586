"""Crawl rules over a table of pages: which addresses are reached from one, and which are indexed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_links
from ..shared import cut


def resolved(link: Column, page: Column) -> Column:
    """A link's address in lower case, without fragment: absolute, from the host's root, or beside the page."""
    host = F.regexp_extract(page, "^([a-z]+://[^/]+)", 1)
    folder = F.when(page.rlike("^[a-z]+://[^/]+/"), F.regexp_replace(page, "[^/]*$", "")).otherwise(F.concat(page, F.lit("/")))
    full = F.when(link.rlike("^[a-z]+://"), link).when(link.startswith("//"), F.concat(F.regexp_extract(page, "^([a-z]+:)", 1), link)).when(link.startswith("/"), F.concat(host, link)).otherwise(F.concat(folder, link))
    return F.regexp_replace(full, "#.*$", "")


def links(pages: DataFrame) -> DataFrame:
    """(url, target) of pages(url, html): links and meta refreshes that stay on the page's host."""
    low = pages.select(F.lower("url").alias("url"), "html")
    refresh = F.regexp_extract_all(F.lower("html"), F.lit(r"""<meta\b[^>]*\bhttp-equiv=["']?refresh[^>]*\burl=([^"'>\s]+)"""), F.lit(1))
    rows = low.select("url", F.explode(F.concat(html_links(F.col("html")), refresh)).alias("link")).select("url", resolved(F.col("link"), F.col("url")).alias("target"))
    host = lambda c: F.regexp_extract(c, "^[a-z]+://([^/]+)", 1)
    return rows.where((host(F.col("target")) == host(F.col("url"))) & (F.length("target") <= 1024) & (F.col("target") != F.col("url"))).distinct()


def crawl(pages: DataFrame, start: str, index_types: str | None = None, most: int | None = None) -> DataFrame:
    """(url, depth) of the pages reached from ``start`` over links.

    Pages are followed whatever their address; ``index_types``, a regular expression, decides
    which are given back, and ``most`` how many at most, nearest first. A round adds the pages
    one link further on, so rounds grow with the depth of the site.
    """
    known = pages.select(F.lower("url").alias("url")).distinct()
    edges = cut(links(pages).join(known.withColumnRenamed("url", "target"), "target", "left_semi"))
    reached = front = cut(known.where(F.col("url") == start.lower()).withColumn("depth", F.lit(0)))
    depth = 0
    while not front.isEmpty():
        depth += 1
        new = edges.join(front.select("url"), "url", "left_semi").select(F.col("target").alias("url")).distinct()
        front = cut(new.join(reached, "url", "left_anti").withColumn("depth", F.lit(depth)))
        reached = reached.union(front)
    out = reached.where(F.col("url").rlike(index_types)) if index_types else reached
    return out.orderBy("depth", "url").limit(most) if most else out
