"""The sources a search asks, as a table: their order, whether they need a key, the limiter that holds them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import rules
from webloom.functions.url import Name, _c


def registry(spark: SparkSession, keys: Iterable[str] = (), custom: Iterable[tuple[str, bool, str]] | None = None) -> DataFrame:
    """source_ord, source, needs_key, limiter, available. A source that needs a key is available with one; custom ones replace the usual."""
    keys = set(keys)
    rows = [(i, n, k, c, not k or n in keys) for i, (n, k, c) in enumerate(rules.SOURCES if custom is None else custom)]
    return spark.createDataFrame(rows, "source_ord int, source string, needs_key boolean, limiter string, available boolean")


def available(sources: DataFrame) -> DataFrame:
    """Names of the sources that can be asked, in their order."""
    return sources.filter("available").select("source_ord", "source")


def limiter_of(source: Name) -> Column:
    out = F.lit("knowledge")
    for name, _, kind in rules.SOURCES:
        out = F.when(_c(source) == name, kind).otherwise(out)
    return out


def request_parameters(query: Name, region: Name, safe_search: Name, time_range: Name) -> Column:
    """What the page scraper sends, as a map without nulls: q, kl, kp and df if there is a time range."""
    from webloom.functions.classify import safe_search as code

    whole = F.create_map(F.lit("q"), _c(query), F.lit("kl"), _c(region), F.lit("kp"), code(safe_search).cast("string"), F.lit("df"), _c(time_range))
    return F.map_filter(whole, lambda k, v: v.isNotNull())
