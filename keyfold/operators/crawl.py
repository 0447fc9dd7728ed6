"""Crawling: links of pages and what is reachable over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.operators.graph import closure


def links_of(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (src, dst) from pages to the addresses in their links. Relative addresses from the root are joined to the
    page's own site, others to the folder it is in."""
    href = F.explode(F.regexp_extract_all(F.col(html), F.lit(r"""<a\s[^>]*?href\s*=\s*["']([^"'#]+)"""), F.lit(1)))
    site = F.regexp_extract(F.col(url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_extract(F.col(url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*/)", 1)
    rows = pages.select(F.col(url).alias("src"), site.alias("site"), F.when(folder != "", folder).otherwise(F.concat(site, F.lit("/"))).alias("folder"), href.alias("h"))
    full = F.when(F.col("h").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("h")).when(F.col("h").startswith("//"), F.concat(F.regexp_extract("site", "^([^:]+:)", 1), "h")).when(F.col("h").startswith("/"), F.concat("site", "h")).otherwise(F.concat("folder", "h"))
    return rows.select("src", full.alias("dst")).distinct()


def crawl(pages: DataFrame, seeds: DataFrame, rounds: int = 100) -> DataFrame:
    """(url, status) of what is reachable from seeds (url) over the links of known pages."""
    links = links_of(pages)
    return closure(links, seeds.select(F.col("url").alias("vertex")), rounds).select(F.col("vertex").alias("url"), "status")


def fetched(urls: DataFrame, fetch: Callable[[str], list[str]]) -> DataFrame:
    """Edges (src, dst) by a function that fetches an address and gives the addresses it links to."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in it:
            yield pd.DataFrame([(u, v) for u in rows["url"] for v in fetch(u)], columns=["src", "dst"])

    return urls.select("url").mapInPandas(run, "src string, dst string")
