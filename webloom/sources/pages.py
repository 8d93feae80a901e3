"""Captured pages as a source, and site maps among them.

Pages come from tables, from files of a folder, or, where there is a network, from ``webloom_pages``, a Spark data source
of one's own that fetches URLs: filters on URLs and hosts reach it before anything is fetched.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions import classify, dom, rules, text
from webloom.functions import url as urls


def captured(spark: SparkSession, path: str) -> DataFrame:
    """url, body, content_type of the files below a folder, by Spark's reader of whole files; too large ones go, before they are read."""
    kinds = F.create_map(*[F.lit(x) for k, v in {"html": "text/html", "htm": "text/html", "pdf": "application/pdf", "txt": "text/plain", "xml": "text/xml", "png": "image/png", "jpg": "image/jpeg"}.items() for x in (k, v)])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("length") <= rules.MAX_BODY)
    return files.select(F.col("path").alias("url"), F.col("content").alias("body"), F.coalesce(kinds[F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))], F.lit("")).alias("content_type"))


def routed(pages: DataFrame, body: str = "body", content_type: str = "content_type") -> DataFrame:
    """Add content: struct<kind, text, mime, size>, kind being html, pdf, binary or too_large."""
    # In steps, so that the first bytes are looked at once.
    steps = pages.withColumns({"_m": F.coalesce(classify.mime(content_type), F.lit("")), "_s": classify.sniffed(body)})
    kind = F.when(~classify.body_fits(body), "too_large").otherwise(classify.route_by(F.col("_m"), F.col("_s"), F.is_valid_utf8(F.col(body).cast("string"))))
    steps = steps.withColumn("_kind", kind)
    shown = F.struct(
        F.col("_kind").alias("kind"),
        F.when(F.col("_kind") == "html", text.lossy_utf8(body)).alias("text"),
        F.when(F.col("_kind") == "binary", classify.binary_name(F.col("_m"), F.col("_s"))).alias("mime"),
        F.octet_length(body).cast("long").alias("size"),
    )
    return steps.withColumn("content", shown).drop("_m", "_s", "_kind")


def pdf_pages(pages: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """url, title, content, word_count, links (null) of PDF bodies. Rows of other kinds do not reach the parser."""
    own = pages.filter(F.substring(body, 1, 4) == F.lit("%PDF").cast("binary")).select(F.col(url).alias("url"), text.trim(dom.pdf(F.col(body))).alias("content"))
    return own.select("url", urls.title_from_url("url").alias("title"), "content", text.word_count("content").alias("word_count"), F.lit(None).cast("array<struct<text:string,url:string>>").alias("links"))


def html_pages(pages: DataFrame, url: str = "url", markup: str = "html", selector: str | F.Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """url, title, content, word_count, links, error_kind, error of pages of markup; each is parsed once, and the markup goes no
    farther. The selector may be a column, null where a page has none."""
    page = dom.page(F.col(markup), F.col(url), F.lit(selector) if isinstance(selector, str) else selector)
    return pages.select(*keep, F.col(url).alias("url"), page.alias("_p")).select(*keep, "url", "_p.*")


def site_map(body: str) -> F.Column:
    """URLs between <loc> and </loc>, trimmed, absolute ones only, the first of each kept, in their order."""
    found = F.transform(F.regexp_extract_all(F.col(body), F.lit(r"(?s)<loc>(.*?)</loc>"), 1), text.trim)
    return F.array_distinct(F.filter(found, _absolute))


def _absolute(u: F.Column) -> F.Column:
    return u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$") & F.coalesce(urls.part(u, "PROTOCOL").isNotNull(), F.lit(False))


def site_maps(roots: DataFrame, bodies: DataFrame) -> DataFrame:
    """root, urls of the first usual place whose captured body (url, body) lists any. Roots without one are not returned."""
    places = F.array(*(F.struct(F.lit(i).alias("ord"), F.concat(F.regexp_extract("root", r"^(\w+://[^/?#]+)", 1), F.lit(p)).alias("url")) for i, p in enumerate(rules.SITEMAPS)))
    tried = roots.select("root", F.explode(places).alias("_p")).select("root", "_p.*")
    listed = bodies.filter(F.octet_length("body") <= rules.MAX_BODY).select("url", site_map("body").alias("urls")).filter(F.size("urls") > 0)
    first = Window.partitionBy("root").orderBy("ord")
    return tried.join(listed, "url").withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("root", "urls")


#: URLs of a site map's file, by the protocol.
MAP_URLS = 50_000


def write_site_maps(urls: DataFrame, path: str, site: str, order: str) -> None:
    """Site maps as XML files below a folder for each site, of at most MAP_URLS entries each, in their order: urls (site, order, loc)."""
    rank = F.row_number().over(Window.partitionBy(site).orderBy(order)) - 1
    cut = urls.filter(F.col("loc").isNotNull()).withColumn("_file", F.floor(rank / MAP_URLS))
    dealt = cut.repartition(site, "_file").sortWithinPartitions(site, "_file", order)
    dealt.select(F.col(site).alias("site"), F.format_string("%05d", "_file").alias("part"), "loc").write.partitionBy("site", "part").format("xml").option("rootTag", "urlset").option("rowTag", "url").save(path)


def read_site_maps(spark: SparkSession, path: str, site: str = "host") -> DataFrame:
    """site, pos, url of XML site maps below a folder for each site: absolute URLs, trimmed, the first of each, by place in the files.

    Spark's XML reader scans for entries and splits long files, so no map is ever one value; an entry's place is its file's,
    its block's, and its own in the block.
    """
    rows = spark.read.format("xml").schema("loc string, site string, part string").option("rowTag", "url").load(path)
    at = F.struct("part", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    entry = rows.select(F.col("site").alias(site), text.trim(F.col("loc")).alias("url"), at.alias("_at"))
    first = entry.filter(_absolute(F.col("url"))).groupBy(site, "url").agg(F.min("_at").alias("_at"))
    return first.select(site, (F.row_number().over(Window.partitionBy(site).orderBy("_at")) - 1).alias("pos"), "url")


#: URLs of one host that a task fetches, one after the other.
HOST_URLS = 50


def register_pages_source(spark: SparkSession) -> None:
    """Make ``spark.read.format("webloom_pages").option("urls", "a b c")`` known: a live fetch of the URLs named.

    Columns: url, host, status, content_type, body, error. URLs are dealt out by host, HOST_URLS a task. Filters on url and
    host (equality, lists, beginnings) are taken over where spark.sql.python.filterPushdown.enabled is set: what they leave
    out is not fetched. Spark keeps a load's filters for later queries of the same load, so each query takes a load of its
    own, as ``live_pages`` does. A body beyond the limit, by its header or by its bytes, and a page that cannot be had are rows with
    their error; nulls stand for what is not known.
    """
    from urllib.parse import urlsplit

    from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith

    most, each = rules.MAX_BODY, HOST_URLS

    class Host(InputPartition):
        def __init__(self, urls: list[str]):
            self.urls = urls

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.urls, self.timeout = options.get("urls", "").split(), float(options.get("timeout", "30"))

        def pushFilters(self, filters: list) -> Iterator:
            for f in filters:
                name = getattr(f, "attribute", None)
                of = {("url",): lambda u: u, ("host",): lambda u: urlsplit(u).hostname}.get(name)
                if of and isinstance(f, EqualTo):
                    self.urls = [u for u in self.urls if of(u) == f.value]
                elif of and isinstance(f, In):
                    self.urls = [u for u in self.urls if of(u) in f.value]
                elif of and isinstance(f, StringStartsWith):
                    self.urls = [u for u in self.urls if (of(u) or "").startswith(f.value)]
                else:
                    yield f

        def partitions(self) -> list:
            hosts: dict = {}
            for u in dict.fromkeys(self.urls):
                hosts.setdefault(urlsplit(u).hostname, []).append(u)
            return [Host(own[i : i + each]) for own in hosts.values() for i in range(0, len(own), each)]

        def read(self, partition: Host) -> Iterator[tuple]:
            from urllib.error import URLError
            from urllib.request import Request, urlopen

            for u in partition.urls if partition else ():
                host = urlsplit(u).hostname
                try:
                    with urlopen(Request(u, headers={"User-Agent": "webloom"}), timeout=self.timeout) as got:
                        kind, large = got.headers.get("Content-Type", ""), int(got.headers.get("Content-Length") or 0) > most
                        body = b"" if large else got.read(most + 1)
                        if large or len(body) > most:
                            yield u, host, got.status, kind, None, f"body of more than {most} bytes"
                        else:
                            yield u, host, got.status, kind, body, None
                except (URLError, OSError, ValueError) as e:
                    yield u, host, getattr(e, "code", None), None, None, str(e)

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return "webloom_pages"

        def schema(self) -> str:
            return "url string, host string, status int, content_type string, body binary, error string"

        def reader(self, schema) -> DataSourceReader:
            return Reader(dict(self.options))

    spark.dataSource.register(Pages)


def live_pages(spark: SparkSession, urls: list[str], where: F.Column | None = None, timeout: float = 30) -> DataFrame:
    """A load of ``webloom_pages`` for one query, of URLs that ``where`` leaves."""
    pages = spark.read.format("webloom_pages").option("urls", " ".join(urls)).option("timeout", str(timeout)).load()
    return pages if where is None else pages.filter(where)
