"""A crawl over captured pages: candidates from site maps, else from the root page's links; ranked, cut, looked up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import classify, dom, rules
from webloom.functions import url as urls
from webloom.functions.url import Name, _c
from webloom.sources import pages as captured


def clamped_pages(n: Name) -> Column:
    return F.greatest(F.lit(1), F.least(_c(n), F.lit(rules.MAX_PAGES)))


def clamped_concurrency(n: Name) -> Column:
    return F.greatest(F.lit(1), F.least(_c(n), F.lit(rules.MAX_CONCURRENCY)))


def discover(roots: DataFrame, maps: DataFrame, pages: DataFrame) -> DataFrame:
    """root, max_pages, sitemap_found, pos, url. roots: (root, max_pages); maps: (url, body); pages: (url, html). Roots with
    neither map nor page have one row with a null url."""
    wanted = roots.withColumn("max_pages", clamped_pages("max_pages"))
    found = captured.site_maps(roots.select("root").distinct(), maps)
    known = wanted.join(found, "root", "left")
    # Only roots without a map need their page parsed.
    anchored = known.filter("urls IS NULL").join(pages.select(F.col("url").alias("root"), "html"), "root", "left")
    linked = anchored.select("root", "max_pages", F.lit(False).alias("sitemap_found"), dom.same_origin_links("html", "root", F.col("max_pages") * 2).alias("urls"))
    mapped = known.filter("urls IS NOT NULL").select("root", "max_pages", F.lit(True).alias("sitemap_found"), "urls")
    return mapped.unionByName(linked).select("root", "max_pages", "sitemap_found", F.posexplode_outer("urls").alias("pos", "url"))


def ranked(candidates: DataFrame, per: tuple[str, ...] = ("root", "max_pages")) -> DataFrame:
    """The ``max_pages`` candidates of each root with the shortest paths, the first found first among equals; adds rank from 1."""
    order = Window.partitionBy(*per).orderBy(urls.path_length("url"), "pos")
    return candidates.filter(F.col("url").isNotNull()).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("max_pages"))


def visited(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """The candidates with their pages' title, content, links or error text. Pages are cut to the candidates before they are parsed."""
    wanted = candidates.select("url").distinct()
    bodies = captured.html_pages(pages.join(wanted, "url", "left_semi"))
    out = candidates.join(bodies, "url", "left")
    missing = F.col("content").isNull() & F.col("error_kind").isNull()
    kind, note = F.when(missing, "fetch").otherwise(F.col("error_kind")), F.when(missing, "HTTP 404 Not Found").otherwise(F.col("error"))
    links = F.coalesce(F.transform("links", lambda x: x["url"]), F.array().cast("array<string>"))
    return out.select(*candidates.columns, "title", F.col("content").alias("markdown"), links.alias("links"), classify.error_text(kind, note).alias("error"))


def crawl(roots: DataFrame, maps: DataFrame, pages: DataFrame) -> DataFrame:
    """A row for each root and number of pages asked for: sitemap_found, summary, pages in rank order, errors."""
    candidates = discover(roots, maps, pages)
    done = visited(ranked(candidates), pages)
    page, error = F.struct("rank", "url", "title", "markdown", "links"), F.struct("rank", "url", "error")
    listed = lambda x, keep: F.transform(F.array_sort(F.collect_list(F.when(keep, x))), lambda y: y.dropFields("rank"))
    bad = F.col("error").isNotNull()
    sums = done.groupBy("root", "max_pages").agg(listed(page, ~bad).alias("pages"), listed(error, bad).alias("errors"), F.count_if(~bad).alias("_ok"), F.count_if(bad).alias("_bad"))
    whole = candidates.groupBy("root", "max_pages").agg(F.bool_or("sitemap_found").alias("sitemap_found"))
    out = whole.join(sums, ["root", "max_pages"], "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    summary = F.struct(F.col("max_pages").cast("long").alias("requested"), count("_ok").alias("fetched"), count("_bad").alias("failed"))
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(sums.schema[c].dataType))
    return out.select(F.col("root").alias("root_url"), "sitemap_found", summary.alias("summary"), empty("pages").alias("pages"), empty("errors").alias("errors"))


def counts_over_time(fetches: DataFrame, span: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """root_url, since, requested, fetched, failed: how fetches (root_url, fetched_at, error) went, by spans of their time.

    On a stream the counts go on being updated: a span's counts are kept until fetches are ``late`` past its end; those that
    come later still are dropped. Over a table all count.
    """
    known = fetches.withWatermark("fetched_at", late) if fetches.isStreaming else fetches
    bad = F.col("error").isNotNull()
    sums = known.groupBy(F.window("fetched_at", span).alias("_w"), "root_url").agg(F.count(F.lit(1)).alias("requested"), F.count_if(~bad).alias("fetched"), F.count_if(bad).alias("failed"))
    return sums.select("root_url", F.col("_w.start").alias("since"), "requested", "fetched", "failed")
