"""Results of many sources made one list: union, the interleave, topics, enrichment, responses."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions import classify, rules, text
from webloom.operators import asof

def statuses(outcomes: DataFrame, key: str = "query_id") -> DataFrame:
    """From outcomes (key, source_ord, source, ok, n): for each query tried, any_success, the sources with results, and an error
    text if there are none.

    ``open_before`` and ``open_after``, if there: whether the source's circuit was open when the search began, and when it
    ended. The former are not tried; the latter are named with the error. If all were open before, nothing was tried.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in outcomes.columns else F.lit(False)
    named = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("source_ord", "source")))), lambda x: x["source"])
    asked = ~flag("open_before")
    good = asked & F.col("ok") & (F.col("n") > 0)
    out = outcomes.groupBy(key).agg(F.count_if(asked).alias("tried"), F.coalesce(F.bool_or(good), F.lit(False)).alias("any_success"), named(good).alias("by_source"), named(asked).alias("names"), named(~asked).alias("_open"), named(asked & flag("open_after")).alias("_opened"))
    error = F.when(F.col("tried") == 0, all_open(F.col("_open"))).when(~F.col("any_success"), no_results(F.col("tried"), F.col("names"), F.col("_opened")))
    return out.select(key, "tried", "any_success", F.array_join("by_source", ",").alias("by_source"), error.alias("error"))


def with_circuits(outcomes: DataFrame, searches: DataFrame, stretches: DataFrame, width: int, key: str = "query_id") -> DataFrame:
    """Outcomes (key, source and others) with open_before and open_after, by the circuits open (source, open_from, open_until)
    when their search began and ended (key, began, ended). ``width`` is about the length of a stretch.

    Stretches are few, a row for each bin they touch; searches meet a row at each end and go on with the names of what was open,
    so outcomes are joined once, by their key.
    """
    first, last = F.floor(F.col("open_from") / width), F.floor((F.col("open_until") - 1) / width)
    spread = stretches.filter(F.col("open_from") < F.col("open_until")).select(F.explode(F.sequence(first, last)).alias("_of"), F.struct("source", "open_from", "open_until").alias("_x"))
    bins = spread.groupBy("_of").agg(F.collect_list("_x").alias("_all"))

    def at(rows: DataFrame, moment: str, into: str) -> DataFrame:
        now = F.col(moment)
        open_ = F.filter("_all", lambda x: (now >= x["open_from"]) & (now < x["open_until"]))
        met = rows.join(bins, F.floor(now / width) == F.col("_of"), "left")
        return met.select(*rows.columns, F.coalesce(F.transform(open_, lambda x: x["source"]), F.array()).alias(into))

    found = at(at(searches.select(key, "began", "ended"), "began", "_before"), "ended", "_after")
    found = found.groupBy(key).agg(F.flatten(F.collect_list("_before")).alias("_before"), F.flatten(F.collect_list("_after")).alias("_after"))
    met = outcomes.join(found, key, "left")
    named = lambda c: F.coalesce(F.array_contains(c, F.col("source")), F.lit(False))
    return met.select(*outcomes.columns, named("_before").alias("open_before"), named("_after").alias("open_after"))


def no_results(tried: Column, names: Column, open_: Column) -> Column:
    note = F.when(F.size(open_) > 0, F.concat(F.lit("; open circuits: ["), F.array_join(open_, ", "), F.lit("]"))).otherwise("")
    return F.concat(F.lit("All "), tried.cast("string"), F.lit(" search backends returned 0 results (tried: "), F.array_join(names, ", "), F.lit(")"), note)


def all_open(names: Column) -> Column:
    return F.concat(F.lit("All search backends have open circuits (cooldown in progress). Open: ["), F.array_join(names, ", "), F.lit("]"))


def _in_turn(sources: list[list], k: int) -> list[tuple[int, int]]:
    """(source, place) of what is taken: sources in turn, each the next of its URLs that none has given yet; k in all."""
    at, seen, out = [0] * len(sources), set(), []
    live = list(range(len(sources)))
    while live and len(out) < k:
        going = []
        for s in live:
            own = sources[s]
            while at[s] < len(own) and own[at[s]] in seen:
                at[s] += 1
            if at[s] < len(own):
                seen.add(own[at[s]])
                out.append((s, at[s]))
                going.append(s)
                if len(out) >= k:
                    break
        live = going
    return out


def _interleaved(table: pa.Table) -> pa.Table:
    """One query's rows, each source's in their order, cut to what is wanted of them, with their rank."""
    table = table.sort_by([("_s", "ascending"), ("_n", "ascending")])
    source, urls = table.column("_s").to_pylist(), table.column("url").to_pylist()
    starts = [i for i in range(len(source)) if not i or source[i] != source[i - 1]]
    lists = [urls[a:b] for a, b in zip(starts, [*starts[1:], len(urls)], strict=True)]
    taken = [starts[s] + i for s, i in _in_turn(lists, max(table.column("_k").to_pylist(), default=0))]
    return table.take(pa.array(taken, pa.int64())).append_column("rank", pa.array(range(1, len(taken) + 1), pa.int32())).drop_columns(["_s", "_n", "_k"])


def merge(rows: DataFrame, k: Column | int, key: str = "query_id") -> DataFrame:
    """From results (key, source_ord, pos and others): key, rank (from 1) and the others, interleaved: sources in turn, each its next
    URL not yet taken, k in all. A column k is one number for each query. Results without URL are not taken.

    What a source gives up to its last place taken is its own or taken from another, so its first k different URLs are all that
    can matter: a query's rows come together only after lists are cut to these, at most k of each source.
    """
    others = [c for c in rows.columns if c not in (key, "source_ord", "pos")]
    wanted = rows.withColumn("_k", F.lit(k) if isinstance(k, int) else k).filter(F.col("url").isNotNull() & (F.col("_k") > 0))
    first = wanted.groupBy(key, "source_ord", "url").agg(F.min(F.struct("pos", *others)).alias("_r"), F.max("_k").cast("long").alias("_k"))
    place = F.row_number().over(Window.partitionBy(key, "source_ord").orderBy("_r"))
    cut = first.withColumn("_n", place).filter(F.col("_n") <= F.col("_k"))
    flat = cut.select(key, F.coalesce(F.col("source_ord").cast("long"), F.lit(-(1 << 62))).alias("_s"), "_n", "_k", *(F.col("_r")[c].alias(c) for c in others))
    shape = T.StructType([*(flat.schema[c] for c in (key, *others)), T.StructField("rank", T.IntegerType())])
    return flat.groupBy(key).applyInArrow(_interleaved, shape).select(key, "rank", *others)


def first_of_each(rows: DataFrame, n: int, key: tuple[str, ...] = ("query_id", "source_ord")) -> DataFrame:
    """The first n results of each source."""
    w = Window.partitionBy(*key).orderBy("pos")
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def enrich(rows: DataFrame, pages: DataFrame, key: str = "query_id") -> DataFrame:
    """Of the first rows of each query, those with sparse descriptions get the start of their page (url, content), if it was had.

    One left join, so that what is above is planned once. Rows that are not sparse meet nothing in it: their keys are of
    another kind than those of pages, and as many as there are rows, so that no task has them all.
    """
    sparse = F.coalesce((F.col("rank") <= rules.SPARSE_ROWS) & text.is_sparse("description"), F.lit(False))
    snippets = pages.filter(F.col("content").isNotNull()).groupBy("url").agg(F.min(text.snippet("content")).alias("_snippet")).withColumnRenamed("url", "_url")
    other = F.concat(F.lit("-"), F.xxhash64(key, "rank", "url", "description").cast("string"))
    asked = rows.withColumn("_wanted", F.coalesce(F.when(sparse, F.concat(F.lit("+"), F.col("url"))), other))
    met = asked.join(snippets, asked["_wanted"] == F.concat(F.lit("+"), snippets["_url"]), "left").withColumn("description", F.coalesce("_snippet", "description"))
    return met.select(*rows.columns)


def topics(rows: DataFrame, key: str = "query_id") -> DataFrame:
    """Each query's topics: all that any of its results matches, sorted."""
    own = rows.select(key, F.explode(classify.topics("url", "title", "content_type")).alias("topic"))
    return own.groupBy(key).agg(F.array_sort(F.collect_set("topic")).alias("topics"))


def responses(queries: DataFrame, rows: DataFrame, key: str = "query_id") -> DataFrame:
    """A row for each query (key, query, region, safe_search, num_results): its results in order, with metadata. Queries without
    results have empty lists. ``as_of`` of queries, a string, is the time they carry."""
    result = F.struct("rank", "title", "url", "description", F.struct(F.col("content_type").alias("type"), "source", F.lit(None).cast("string").alias("favicon"), F.lit(None).cast("string").alias("published_date")).alias("metadata"))
    data = rows.groupBy(key).agg(F.array_sort(F.collect_list(result)).alias("_d"))
    data = data.withColumn("data", F.transform("_d", lambda x: x.dropFields("rank"))).drop("_d")
    out = queries.join(data, key, "left").join(topics(rows, key), key, "left")
    found = F.coalesce(F.col("data"), F.array().cast(data.schema["data"].dataType))
    context = F.struct("region", "safe_search", "num_results")
    analysis = F.struct(text.language("query").alias("language"), F.coalesce("topics", F.array().cast("array<string>")).alias("topics"))
    as_of = F.col("as_of") if "as_of" in queries.columns else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    meta = F.struct("query", as_of.alias("timestamp"), F.size(found).cast("long").alias("result_count"), context.alias("search_context"), analysis.alias("query_analysis"))
    return out.select(key, F.lit("search_results").alias("type"), found.alias("data"), meta.alias("metadata"))


def batches(rows: DataFrame, order: str, size: int = rules.BATCH, group: str | None = None, ranges: int = 32) -> DataFrame:
    """Add batch: rows of a group (or all) in runs of ``size``, by their order, any numbers; batches count from 0 in each group.

    Rows are numbered by ranges of the order: each is numbered by itself, and the counts of those before it are added, so
    no group is one task's. Rows of equal order are in batches as their other columns say. Null orders come first.
    """
    by = [group] if group else []
    cuts = rows.agg(F.percentile_approx(F.col(order).cast("double"), [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    value = F.col(order).cast("double")
    part = F.coalesce(sum((value > c).cast("int") for c in sorted(set(cuts))) if cuts else F.lit(0), F.lit(-1))
    placed = rows.withColumn("_part", part)
    tie = [F.hash(F.col(c)) if isinstance(placed.schema[c].dataType, (T.MapType, T.VariantType)) else F.col(c) for c in rows.columns]
    counts = placed.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("_base", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    own = placed.withColumn("_own", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(order, *tie)) - 1)
    same = [own[c].eqNullSafe(base[c]) for c in [*by, "_part"]]
    joined = own.join(F.broadcast(base) if not by else base, same)
    return joined.select(*(own[c] for c in rows.columns), F.floor((own["_own"] + base["_base"]) / size).alias("batch"))
