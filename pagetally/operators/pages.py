"""Page reports over ``pages(page_id, url, html)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetally.functions import html, urls


def page_audit(pages: DataFrame) -> DataFrame:
    """One row per page: host, title length and tag counts. No shuffle.

    The page is tokenized once, in its own projection; the counts then work on
    the short list of tags.
    """
    found = F.col("found")
    return pages.select(
        "page_id",
        urls.host("url").alias("host"),
        html.tokens("html", "a", "h1", "img", "meta").alias("found"),
    ).select(
        "page_id",
        "host",
        F.length(html.title(found)).cast("bigint").alias("title_length"),
        html.count_tag(found, "h1").alias("n_h1"),
        html.count_links(found).alias("n_links"),
        html.count_tag(found, "img").alias("n_images"),
        html.has_meta(found, "description").alias("has_meta_description"),
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """One row per link of a page, numbered from 1 in page order. No shuffle."""
    # The outer form keeps Spark from adding a filter that tokenizes a second time.
    return (
        pages.select("page_id", html.link_tags(html.tokens("html", "a")).alias("links"))
        .select("page_id", F.posexplode_outer("links").alias("pos", "tag"))
        .where(F.col("tag").isNotNull())
        .select(
            "page_id",
            (F.col("pos") + 1).cast("bigint").alias("link_no"),
            html.attribute(F.col("tag"), "a", "href").alias("href"),
        )
    )


def duplicate_titles(pages: DataFrame) -> DataFrame:
    """Titles that more than one page has. Pages without a title are left out."""
    # Pages without a title count as zero, rather than being filtered out: a filter
    # would move down to the scan and tokenize a second time.
    titles = pages.select(html.tokens("html").alias("found")).select(
        F.nullif(html.title(F.col("found")), F.lit("")).alias("title")
    )
    return (
        titles.groupBy("title")
        .agg(F.count("title").alias("n_pages"))
        .where(F.col("n_pages") > 1)
    )


def canonical_groups(pages: DataFrame) -> DataFrame:
    """Canonical URLs that more than one page falls under."""
    # URLs without a host count as zero; a filter would take their address apart twice.
    return (
        pages.select(urls.canonical("url").alias("canonical_url"))
        .groupBy("canonical_url")
        .agg(F.count("canonical_url").alias("n_pages"))
        .where(F.col("n_pages") > 1)
    )


def top_pages(pages: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` pages of each host with the most links, ties by ``page_id``.

    Filtering the row number directly lets Spark keep only ``k`` rows per host
    in every map task, so a dominant host never reaches one task whole.
    """
    best_first = Window.partitionBy("host").orderBy(F.desc("n_links"), F.asc("page_id"))
    return (
        pages.select(
            "page_id",
            urls.host("url").alias("host"),
            html.count_links(html.tokens("html", "a")).alias("n_links"),
        )
        .where(F.col("host").isNotNull())
        .withColumn("rank", F.row_number().over(best_first))
        .where(F.col("rank") <= k)
        .select("host", F.col("rank").cast("bigint").alias("rank"), "page_id", "n_links")
    )
