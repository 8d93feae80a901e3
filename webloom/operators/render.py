"""Results, pages and crawls for people, as text columns; and as files of JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.url import Name, _c


def _s(x: Name) -> Column:
    return F.coalesce(_c(x).cast("string"), F.lit(""))


def search_header(query: Name, count: Name, region: Name) -> Column:
    return F.concat(F.lit("\nSearch Results for: "), _s(query), F.lit("\n" + "=" * 50 + "\nFound "), _s(count), F.lit(" results in region '"), _s(region), F.lit("'\n\n"))


def search_result(rank: Name, title: Name, url: Name, description: Name, source: Name, kind: Name) -> Column:
    """rank counts from 1; the type is shown with a capital."""
    return F.concat(_s(rank), F.lit(". "), _s(title), F.lit("\n   URL: "), _s(url), F.lit("\n   "), _s(description), F.lit("\n   Source: "), _s(source), F.lit(" | Type: "), F.initcap(_s(kind)), F.lit("\n\n"))


def page_block(title: Name, url: Name, fetched: Name, words: Name, content: Name) -> Column:
    """A page as Markdown: a header and its content."""
    return F.concat(F.lit("# "), _s(title), F.lit("\n\n**URL:** "), _s(url), F.lit("\n**Fetched:** "), _s(fetched), F.lit("\n**Words:** "), _s(words), F.lit("\n\n---\n\n"), _s(content))


def page_text(title: Name, url: Name, fetched: Name, words: Name, content: Name, links: Name) -> Column:
    """A page as plain text with its first ten links."""
    rows = F.transform(F.slice(_c(links), 1, 10), lambda x: F.concat(F.lit("  - "), x["text"], F.lit(" ("), x["url"], F.lit(")\n")))
    tail = F.when(_c(links).isNotNull(), F.concat(F.lit("\nLinks found ("), F.size(_c(links)).cast("string"), F.lit("):\n"), F.array_join(rows, ""))).otherwise("")
    return F.concat(F.lit("\n"), _s(title), F.lit("\n" + "=" * 50), F.lit("URL: "), _s(url), F.lit("\nFetched: "), _s(fetched), F.lit("\nWords: "), _s(words), F.lit("\n\n"), _s(content), F.lit("\n"), tail)


def crawl_text(fetched: Name, failed: Name, pages: Name, chars: int = 200) -> Column:
    """A crawl with the start of each page, in characters."""
    rows = F.transform(_c(pages), lambda p: F.concat(F.lit("\n--- "), p["url"], F.lit(" ---\n"), F.left(p["markdown"], F.lit(chars)), F.lit("\n")))
    return F.concat(F.lit("\nCrawl complete: "), _s(fetched), F.lit(" pages, "), _s(failed), F.lit(" errors\n"), F.array_join(rows, ""))


def as_json(df: DataFrame, pretty: bool = False) -> DataFrame:
    """A JSON text for each row; fields that are null are left out."""
    return df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"} if pretty else {}).alias("value"))


def write_lines(df: DataFrame, path: str, pretty: bool = False) -> None:
    as_json(df, pretty).write.text(path)
