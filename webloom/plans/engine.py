"""The three requests as lazy plans: search, visit, crawl. Answers and pages are captured tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import classify, rules, url
from webloom.operators import crawl as crawls
from webloom.operators import merge, render, requests
from webloom.sources import pages as captured
from webloom.sources import payloads, registry


class Engine:
    """pages: (url, html; fetched, a time as text, if there), what has been fetched. answers: (query_id or query, source, body), what
    sources have answered. maps: (url, body) of site maps had. keys: of sources. custom: sources of one's own by name, see
    ``payloads.all_results``. as_of: the time that results carry, now if none is given."""

    def __init__(self, spark: SparkSession, pages: DataFrame | None = None, answers: DataFrame | None = None, keys: tuple[str, ...] = (), maps: DataFrame | None = None, custom: dict[str, str] | None = None, as_of: str | None = None):
        self.spark, self.pages, self.answers, self.custom, self.as_of = spark, pages, answers, custom or {}, as_of
        self.maps = spark.createDataFrame([], "url string, body string") if maps is None else maps
        self.names = [n for n, needs, _ in rules.SOURCES if not needs or n in keys] + list(self.custom)
        self.sources = registry.registry(spark, keys, [*rules.SOURCES, *((n, False, "knowledge") for n in self.custom)])

    def now(self) -> F.Column:
        return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX") if self.as_of is None else F.lit(self.as_of)

    def check(self) -> DataFrame:
        """item, ok, detail: which sources can be asked, and what captured tables there are to answer from."""
        have = [("pages", self.pages is not None, "url, html"), ("answers", self.answers is not None, "query_id, source, body")]
        tables = self.spark.createDataFrame(have, "item string, ok boolean, detail string")
        return self.sources.select(F.col("source").alias("item"), F.col("available").alias("ok"), F.concat(F.lit("limiter "), "limiter").alias("detail")).unionByName(tables)

    def search(self, queries: DataFrame, enriched: bool = True) -> DataFrame:
        """A response for each query (query_id, query; region, safe_search, num_results if there). Answers are those of its id, or of
        its text if they carry none."""
        usual = {"region": F.lit("wt-wt"), "safe_search": F.lit("MODERATE"), "num_results": F.lit(10)}
        queries = queries.withColumns({k: F.coalesce(F.col(k), v) if k in queries.columns else v for k, v in usual.items()})
        by = "query_id" if "query_id" in self.answers.columns else "query"
        asked = self.answers.join(F.broadcast(registry.available(self.sources)), "source")  # a row a source
        asked = asked.join(queries.select(*{"query_id", by}, F.col("num_results").cast("int").alias("n")), by)
        rows = payloads.all_results(asked.select("query_id", "source", "source_ord", "n", "body"), custom=self.custom)
        merged = merge.merge(rows.drop("backend"), F.col("n")).drop("n")
        if enriched and self.pages is not None:
            found = merged.filter("rank <= 3").select("url").distinct()
            merged = merge.enrich(merged, captured.html_pages(self.pages.join(found, "url", "left_semi")))
        return merge.responses(queries.withColumn("as_of", self.now()), merged)

    def visit(self, urls: DataFrame, selector: str | None = None) -> DataFrame:
        """url, selector, fetched, title, content, word_count, links, error of each URL (column url; selector, if there, of its own)."""
        own = F.col("selector") if "selector" in urls.columns else F.lit(selector).cast("string")
        wanted = urls.select("url", own.alias("selector")).distinct()
        fetched = F.col("fetched") if "fetched" in self.pages.columns else self.now()
        had = self.pages.withColumn("fetched", fetched).join(wanted.filter(url.is_http("url")), "url")
        had = captured.html_pages(had, selector=F.col("selector"), keep=("selector", "fetched")).withColumnRenamed("url", "_url").withColumnRenamed("selector", "_selector")
        out = wanted.join(had, (wanted["url"] == had["_url"]) & wanted["selector"].eqNullSafe(had["_selector"]), "left")
        kind = F.when(~url.is_http("url"), "url").when(F.col("content").isNull() & F.col("error_kind").isNull(), "fetch").otherwise(F.col("error_kind"))
        note = F.when(~url.is_http("url"), "must be HTTP or HTTPS").otherwise(F.coalesce("error", F.lit("HTTP 404 Not Found")))
        return out.select("url", "selector", "fetched", "title", "content", "word_count", "links", classify.error_text(kind, note).alias("error"))

    def crawl(self, roots: DataFrame, maps: DataFrame | None = None) -> DataFrame:
        """A crawl for each root (root, max_pages); maps: (url, body) of site maps had, if other than the engine's."""
        return crawls.crawl(roots, self.maps if maps is None else maps, self.pages)

    def serve(self, lines: DataFrame) -> DataFrame:
        """line and response of request lines (line), notifications left out: searches, visits and crawls are run over the captured
        tables, each different call once; a call that fails is an answer that says so."""
        rows = requests.dispatched(requests.parsed(lines)).withColumn("_call", F.when(F.col("action").startswith("call:"), F.sha2(F.col("line"), 256)))
        calls = rows.filter(F.col("_call").isNotNull()).select("_call", "action", "query", "region", "safe_search", "num_results", "url", "selector", "root_url", F.col("max_pages").cast("int").alias("max_pages")).dropDuplicates(["_call"])
        parts = [self._visits(calls.filter("action = 'call:fetch'")), self._searches(calls.filter("action = 'call:search'")), self._crawls(calls.filter("action = 'call:crawl'"))]
        done = reduce(DataFrame.unionByName, parts).withColumnRenamed("_call", "_of")
        out = rows.join(done, rows["_call"] == done["_of"], "left")
        result = F.when(F.col("_of").isNotNull(), requests.envelope("_text", F.col("_failed"))).when(F.col("action") == "info", requests.info_json()).when(F.col("action") == "tools", requests.tools_json())
        return requests.response_lines(out.withColumn("result", result)).select("line", "response")

    @staticmethod
    def _none(calls: DataFrame, kind: str) -> DataFrame:
        return calls.select("_call", F.lit(f"{kind} failed: nothing has been captured to answer from").alias("_text"), F.lit(True).alias("_failed"))

    def _visits(self, calls: DataFrame) -> DataFrame:
        if self.pages is None:
            return self._none(calls, "Visit")
        had = self.visit(calls.select("url", "selector"))
        out = calls.select("_call", "url", F.col("selector").alias("_own")).join(had, "url", "left").filter(F.col("_own").eqNullSafe(F.col("selector")))
        block = render.page_block("title", "url", "fetched", "word_count", "content")
        return out.select("_call", F.when(F.col("error").isNull(), block).otherwise(F.concat(F.lit("Failed to fetch page: "), F.col("error"))).alias("_text"), F.col("error").isNotNull().alias("_failed"))

    def _searches(self, calls: DataFrame) -> DataFrame:
        if self.answers is None:
            return self._none(calls, "Search")
        had = self.search(calls.select(F.col("_call").alias("query_id"), "query", "region", "safe_search", "num_results"))
        error = F.concat(F.lit("Search failed: "), classify.error_text(F.lit("search"), merge.no_results(F.lit(len(self.names)), F.array(*map(F.lit, self.names)), F.array().cast("array<string>"))))
        empty = F.size("data") == 0
        return had.select(F.col("query_id").alias("_call"), F.when(empty, error).otherwise(F.to_json(F.struct("type", "data", "metadata"), {"pretty": "true"})).alias("_text"), empty.alias("_failed"))

    def _crawls(self, calls: DataFrame) -> DataFrame:
        if self.pages is None:
            return self._none(calls, "Crawl")
        absolute = F.col("root_url").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+")
        good = calls.filter(absolute).withColumn("max_pages", crawls.clamped_pages("max_pages"))
        had = self.crawl(good.select(F.col("root_url").alias("root"), "max_pages").distinct())
        text = F.to_json(F.struct("root_url", "sitemap_found", "summary", "pages", "errors"), {"pretty": "true"})
        shown = had.select("root_url", F.col("summary.requested").alias("max_pages"), text.alias("_text"))
        wrong = classify.error_text(F.lit("arguments"), F.lit("invalid root_url: relative URL without a base"))
        bad = calls.filter(~absolute).select("_call", F.concat(F.lit("Crawl failed: "), wrong).alias("_text"), F.lit(True).alias("_failed"))
        return good.join(shown, ["root_url", "max_pages"]).select("_call", "_text", F.lit(False).alias("_failed")).unionByName(bad)
