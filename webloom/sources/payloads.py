"""Answers of sources as results: JSON by Spark's own functions, result pages by the DOM.

Each function takes the answer's body and how many results to take, and gives an array of
struct<title, url, description, content_type, source>. What does not parse gives an empty array.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import classify, dom, text
from webloom.functions import url as urls
from webloom.functions.lazy import row_column
from webloom.functions.url import Name, _c

#: What a source gives at most, whatever is asked for.
CAPS = {"wikipedia": 20, "stackoverflow": 25, "github": 30}


def _blank(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def _result(source: str, kind: str, title: Column, url: Column, description: Column) -> Column:
    return F.struct(_blank(title).alias("title"), _blank(url).alias("url"), _blank(description).alias("description"), F.lit(kind).alias("content_type"), F.lit(source).alias("source"))


def _taken(items: Column, n: Name) -> Column:
    return F.slice(F.coalesce(items, F.array()), F.lit(1), F.greatest(F.lit(0), _c(n)))


def _items(body: Name, schema: str, field: str) -> Column:
    return F.from_json(_c(body), schema)[field]


def asked(source: str, n: Name) -> Column:
    return F.least(_c(n), F.lit(CAPS[source])) if source in CAPS else _c(n)


def serper(body: Name, n: Name) -> Column:
    own = F.transform(_items(body, "organic array<struct<title string, link string, snippet string>>", "organic"), lambda x: _result("serper", "other", x["title"], x["link"], x["snippet"]))
    return _taken(own, n)


def tavily(body: Name, n: Name) -> Column:
    own = F.transform(_items(body, "results array<struct<title string, url string, content string>>", "results"), lambda x: _result("tavily", "other", x["title"], x["url"], x["content"]))
    return _taken(own, n)


def wikipedia(body: Name, n: Name) -> Column:
    """Parallel arrays, of which the titles are counted; the others may be shorter. Results without URL go, after n are taken."""
    whole = F.try_parse_json(_c(body))
    titles, about, links = (F.try_variant_get(whole, f"$[{i}]", "array<string>") for i in (1, 2, 3))
    titles = F.slice(titles, F.lit(1), F.greatest(F.lit(0), asked("wikipedia", n)))
    own = F.transform(titles, lambda t, i: _result("wikipedia", "documentation", t, F.get(links, i), F.get(about, i)))
    return F.filter(F.coalesce(F.when(about.isNotNull() & links.isNotNull(), own), F.array()), lambda x: x["url"] != "")


def stackoverflow(body: Name, n: Name) -> Column:
    """Titles keep their entities; see ``decoded_titles``."""
    note = lambda x: F.concat(F.lit("Score: "), F.coalesce(x["score"], F.lit(0)).cast("string"), F.lit(" | Answers: "), F.coalesce(x["answer_count"], F.lit(0)).cast("string"))
    own = F.transform(_items(body, "items array<struct<title string, link string, score long, answer_count long>>", "items"), lambda x: _result("stackoverflow", "forum", x["title"], x["link"], note(x)))
    return _taken(own, asked("stackoverflow", n))


def decoded_titles(rows: DataFrame) -> DataFrame:
    """Entities of the titles of that source's rows decoded."""
    return rows.withColumn("title", F.when(F.col("source") == "stackoverflow", text.decode_entities("title")).otherwise(F.col("title")))


def github(body: Name, n: Name) -> Column:
    """The description ends in a space if no language is known."""
    note = lambda x: F.concat(_blank(x["description"]), F.lit(" | "), F.coalesce(x["stargazers_count"], F.lit(0)).cast("string"), F.lit(" "), F.coalesce(F.concat(F.lit("| "), x["language"]), F.lit("")))
    own = F.transform(_items(body, "items array<struct<full_name string, html_url string, description string, stargazers_count long, language string>>", "items"), lambda x: _result("github", "documentation", x["full_name"], x["html_url"], note(x)))
    return _taken(own, asked("github", n))


def wiby(body: Name, n: Name) -> Column:
    items = F.from_json(_c(body), "array<struct<Title string, URL string, Snippet string>>")
    return F.transform(_taken(items, n), lambda x: _result("wiby", "article", x["Title"], x["URL"], x["Snippet"]))


def ddg_instant(body: Name, n: Name) -> Column:
    """The abstract, if it has text, even if none are asked for; then topics with text and a URL that is no category, up to n in all."""
    found = F.from_json(_c(body), "AbstractText string, AbstractURL string, Heading string, RelatedTopics array<struct<Text string, FirstURL string>>")
    head = F.when(_blank(found["AbstractText"]) != "", F.array(_result("ddg-instant", "documentation", found["Heading"], found["AbstractURL"], found["AbstractText"]))).otherwise(F.array())
    good = F.filter(F.coalesce(found["RelatedTopics"], F.array()), lambda x: (_blank(x["Text"]) != "") & (_blank(x["FirstURL"]) != "") & ~_blank(x["FirstURL"]).startswith("https://duckduckgo.com/c/"))
    more = F.transform(good, lambda x: _result("ddg-instant", "documentation", F.left(x["Text"], F.lit(80)), x["FirstURL"], x["Text"]))
    return F.concat(head, F.slice(more, F.lit(1), F.greatest(F.lit(0), _c(n) - F.size(head))))


_ITEMS = "array<struct<title:string,href:string,about:string>>"


def _scraped(markup: str | None, item: str, title: str, about: str) -> list[dict]:
    out = []
    for node in dom.select(dom.parse(markup or ""), item):
        head, note = dom.first(node, title), dom.first(node, about)
        if head is not None:
            out.append({"title": head.text(), "href": head.attrs.get("href"), "about": note.text() if note is not None else ""})
    return out


@row_column(_ITEMS)
def _bing_items(markup: str | None) -> list[dict]:
    return _scraped(markup, "li.b_algo", "h2 a", ".b_caption p, .b_lineclamp2")


@row_column(_ITEMS)
def _page_items(markup: str | None) -> list[dict]:
    return _scraped(markup, "div.result", "a.result__a", ".result__snippet")


def bing(body: Name, n: Name) -> Column:
    good = F.filter(_bing_items(_c(body)), lambda x: (text.trim(x["title"]) != "") & _blank(x["href"]).startswith("http") & ~_blank(x["href"]).contains("bing.com/ck/"))
    return _taken(F.transform(good, lambda x: _result("bing", "other", text.trim(x["title"]), x["href"], text.trim(x["about"]))), n)


def duckduckgo(body: Name, n: Name) -> Column:
    """Redirects are unwrapped; type and source come from the URL."""
    own = F.transform(F.filter(_page_items(_c(body)), lambda x: x["href"].isNotNull()), lambda x: F.struct(text.clean_text(x["title"]).alias("title"), urls.unwrap_redirect(x["href"]).alias("url"), text.clean_text(x["about"]).alias("description")))
    good = F.filter(own, lambda x: x["url"].startswith("http"))
    return _taken(F.transform(good, lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"), x["description"].alias("description"), classify.url_type(x["url"]).alias("content_type"), urls.domain(x["url"]).alias("source"))), n)


#: Shapes that are expressions, and those that need a page parsed.
PLAIN: dict[str, Callable[[Name, Name], Column]] = {"serper": serper, "tavily": tavily, "wikipedia": wikipedia, "stackoverflow": stackoverflow, "github": github, "wiby": wiby, "ddg-instant": ddg_instant}
SCRAPED: dict[str, Callable[[Name, Name], Column]] = {"bing": bing, "duckduckgo": duckduckgo}
SHAPERS = PLAIN | SCRAPED


def _spread(answers: DataFrame, shape: Column, body: str) -> DataFrame:
    others = [c for c in answers.columns if c not in (body, "source")]
    return answers.select(*others, F.posexplode(shape).alias("pos", "_r")).select(*others, "pos", "_r.*")


def results(answers: DataFrame, source: str, n: Name = "n", body: str = "body") -> DataFrame:
    """A row for each result of one source's answers: their other columns, pos, title, url, description, content_type, source."""
    rows = _spread(answers, SHAPERS[source](F.col(body), n), body)
    return decoded_titles(rows) if source == "stackoverflow" else rows


def custom_results(answers: DataFrame, functions: dict[str, str], n: Name = "n", body: str = "body") -> DataFrame:
    """Rows of sources of one's own: ``functions`` names a registered table function for each source.

    The function takes a table (query_id, source_ord, n, body), dealt out by query_id, and yields query_id, source_ord, pos, title,
    url, description, content_type. It is called by SQL, so it may be any polymorphic table function the session knows.
    """
    spark, parts = answers.sparkSession, []
    for source, function in functions.items():
        own = answers.filter(F.col("source") == source).select("query_id", F.col("source_ord").cast("int").alias("source_ord"), F.col(n).cast("int").alias("n") if isinstance(n, str) else n.cast("int").alias("n"), F.col(body).alias("body"))
        called = spark.sql(f"SELECT * FROM `{function}`(TABLE(SELECT * FROM {{given}}) PARTITION BY query_id)", given=own)
        blank = [_blank(F.col(c)).alias(c) for c in ("title", "url", "description")]
        kind = F.coalesce(F.col("content_type"), F.lit("other")).alias("content_type")
        rows = called.select("query_id", F.col("source_ord").cast("int").alias("source_ord"), F.col("pos").cast("int").alias("pos"), *blank, kind, F.lit(source).alias("source"))
        asked = own.select("query_id", "source_ord", "n").distinct()
        parts.append(rows.join(asked, ["query_id", "source_ord"]).filter(F.col("pos") < F.col("n")).withColumn("backend", F.lit(source)))
    return reduce(DataFrame.unionByName, parts)


def all_results(answers: DataFrame, n: Name = "n", body: str = "body", custom: dict[str, str] | None = None) -> DataFrame:
    """Of answers of many sources (column ``source``): each source's rows shaped by its own rule, with backend its name.

    Answers of the sources whose shapes are expressions are read once, for one choice by source; those of each scraped source
    once more, as its pages have to be parsed; and those of each source of one's own (``custom``: its table function) once.
    """
    named = answers.withColumn("backend", F.col("source"))
    shape = reduce(lambda out, name: out.when(F.col("source") == name, PLAIN[name](F.col(body), n)), PLAIN, F.when(F.lit(False), F.lit(None)))
    parts = [decoded_titles(_spread(named.filter(F.col("source").isin(*PLAIN)), shape, body))]
    parts += [results(named.filter(F.col("source") == name), name, n, body) for name in SCRAPED]
    out = reduce(DataFrame.unionByName, parts)
    return out.unionByName(custom_results(answers, custom, n, body).select(*out.columns)) if custom else out


def tabbed():
    """A table function for a source whose answers are lines of title, URL and description, parted by tabs; to be registered."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="query_id long, source_ord int, pos int, title string, url string, description string, content_type string")
    class Tabbed:
        def eval(self, row):
            for i, line in enumerate(x for x in (row["body"] or "").split("\n") if x):
                title, url, note = (*line.split("\t", 2), "", "")[:3]
                yield row["query_id"], row["source_ord"], i, title, url, note, None

    return Tabbed
