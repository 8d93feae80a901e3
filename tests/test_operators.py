"""Merge, crawl, requests and state against simulations and golden cases."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.functions import classify
from webloom.operators import asof, crawl, merge, render, requests
from webloom.plans.engine import Engine
from webloom.sources import pages as captured
from webloom.sources import payloads
from webloom.streaming import folds, jumps, processors

COLUMNS = "query_id int, source_ord int, pos int, url string, title string, description string, content_type string, source string"


def simulated_interleave(lists, k):
    places, out, seen = [0] * len(lists), [], set()
    while len(out) < k:
        added = False
        for s, own in enumerate(lists):
            while places[s] < len(own):
                x = own[places[s]]
                places[s] += 1
                if x not in seen:
                    seen.add(x)
                    out.append(x)
                    added = True
                    break
            if len(out) >= k:
                break
        if not added:
            break
    return out


def test_interleave_equals_simulation(spark):
    rng = random.Random(3)
    cases = [[[rng.randrange(12) for _ in range(rng.randint(1, 6))] for _ in range(rng.randint(1, 4))] for _ in range(120)]
    cases += [[["a1", "a2"], ["b1", "b2"]], [["dup"], ["dup", "other"]], [["x", "y"], ["x", "z"], ["z", "c2"]]]
    rows = [(q, s, p, str(u), "t", "d", "article", f"s{s}") for q, lists in enumerate(cases) for s, own in enumerate(lists) for p, u in enumerate(own)]
    for k in (0, 4, 50):
        got = {}
        for r in merge.merge(spark.createDataFrame(rows, COLUMNS), k).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["url"])
        assert [got.get(q, []) for q in range(len(cases))] == [simulated_interleave([[str(u) for u in own] for own in lists], k) for lists in cases]


def test_interleave_of_one_long_query(spark):
    """Thousands of results of one query, most of them given by several sources; null URLs are not taken."""
    import time

    rng = random.Random(8)
    lists = [[f"u{rng.randrange(900)}" for _ in range(500)] for _ in range(4)]
    rows = [(1, s, p, u, "t", "d", "article", f"s{s}") for s, own in enumerate(lists) for p, u in enumerate(own)] + [(1, 0, 900, None, "t", "d", "article", "s0")]
    df = spark.createDataFrame(rows, COLUMNS).cache()
    df.count()
    merge.merge(df, 2000).count()
    began = time.time()
    got = [r["url"] for r in merge.merge(df, 2000).orderBy("rank").collect()]
    assert time.time() - began < 5  # of which most is the planning of a query
    assert got == simulated_interleave(lists, 2000)


def test_interleave_wants_its_own_number_of_each_query(spark):
    rows = [(q, s, p, f"u{s}{p}", "t", "d", "article", f"s{s}", q) for q in range(4) for s in range(2) for p in range(3)]
    got = merge.merge(spark.createDataFrame(rows, COLUMNS + ", n int"), F.col("n")).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == {1: 1, 2: 2, 3: 3}


def test_last_before_equals_simulation(spark):
    rng = random.Random(2)
    entries = [(rng.choice("abc"), rng.randrange(-50, 300), i) for i in range(60)] + [(None, 5, 1000), ("a", None, 1001)]
    moments = [(rng.choice(["a", "b", "c", "d", None]), rng.choice([None, *range(-60, 320)]), i) for i in range(200)]
    e, m = spark.createDataFrame(entries, "key string, since long, v int"), spark.createDataFrame(moments, "key string, t long, n int").repartition(3)

    def plain(key, t):
        own = [(s, v) for k, s, v in entries if k == key and None not in (key, t, s) and s <= t]
        return max(own) if own else None

    for width in (7, 100, 10_000):
        got = asof.last_before(m, e, "key", "t", "since", width).collect()
        assert len(got) == len(moments)
        assert all((None if r["entry"] is None else (r["entry"]["since"], r["entry"]["v"])) == plain(r["key"], r["t"]) for r in got)
    assert asof.last_before(m, e.limit(0), "key", "t", "since", 7).filter("entry IS NOT NULL").count() == 0


def test_lookups_between_stores(spark):
    """A request before the newest entry is answered by an older one that was alive then."""
    entries = spark.createDataFrame([("k", 0, "old"), ("k", 1000, "new")], "key string, stored_at long, body string")
    asked = spark.createDataFrame([("k", t) for t in (-1, 0, 50, 99, 100, 999, 1000, 1099, 1100)], "key string, t long")
    got = {r["t"]: (r["hit"], r["stored_at"]) for r in folds.looked_up(asked, entries, ttl=100).collect()}
    assert got == {-1: (False, None), 0: (True, 0), 50: (True, 0), 99: (True, 0), 100: (False, 0), 999: (False, 0), 1000: (True, 1000), 1099: (True, 1000), 1100: (False, 1000)}
    hits, misses = folds.split_by_cache(asked, entries, ttl=100)
    assert {(r["t"], r["entry"]["body"]) for r in hits.collect()} == {(0, "old"), (50, "old"), (99, "old"), (1000, "new"), (1099, "new")}
    assert {r["t"] for r in misses.collect()} == {-1, 100, 999, 1100}


def test_moments_within_stretches(spark):
    rng = random.Random(4)
    stretches = [(i, a, a + rng.choice([0, 1, 5, 40, 300])) for i, a in enumerate(rng.sample(range(-100, 500), 30))]
    moments = [(n, rng.randrange(-150, 600)) for n in range(120)]
    got = asof.within(spark.createDataFrame(moments, "n int, t long"), spark.createDataFrame(stretches, "s int, a long, b long"), "t", "a", "b", 20).select("n", "s").collect()
    assert sorted(map(tuple, got)) == sorted((n, s) for n, t in moments for s, a, b in stretches if a <= t < b)


def test_circuits_at_search_time(spark):
    """Circuits open before a search are not asked, those that open while it lasts are named; with all open nothing is tried."""
    stretches = spark.createDataFrame([("a", 0, 100), ("b", 50, 150), ("c", 50, 150)], "source string, open_from long, open_until long")
    searches = spark.createDataFrame([(1, 200, 210), (2, 20, 60), (3, 60, 70), (4, 20, 30)], "query_id int, began long, ended long")
    outcomes = spark.createDataFrame([(q, i, s, True, 2 if (q, s) == (4, "c") else 0) for q in range(1, 5) for i, s in enumerate("abc")], "query_id int, source_ord int, source string, ok boolean, n int")
    got = {r["query_id"]: (r["tried"], r["by_source"], r["error"]) for r in merge.statuses(merge.with_circuits(outcomes, searches, stretches, 100)).collect()}
    assert got == {
        1: (3, "", "All 3 search backends returned 0 results (tried: a, b, c)"),
        2: (2, "", "All 2 search backends returned 0 results (tried: b, c); open circuits: [b, c]"),
        3: (0, "", "All search backends have open circuits (cooldown in progress). Open: [a, b, c]"),
        4: (2, "c", None),
    }


def test_open_stretches(spark):
    calls = spark.createDataFrame([("a", t, t, ok) for t, ok in [(0, False), (1, False), (2, False), (5, True), (12, False), (15, True), (30, True)]], "backend string, t long, n long, ok boolean")
    got = folds.open_stretches(folds.breaker(calls, failures=3, cooldown=10), cooldown=10).collect()
    assert sorted((r["open_from"], r["open_until"]) for r in got) == [(2, 12), (12, 22)]


def test_batches_of_gappy_ids_and_groups(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(-1000, 1_000_000), g, i) for i, g in enumerate(rng.choices(["a", "b", None], [8, 2, 1], k=500))] + [(None, "a", 900), (7, "a", 901), (7, "a", 902)]
    df = spark.createDataFrame(rows, "id long, g string, n int").repartition(4)

    def plain(own, size):
        own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2]))
        return {r[2]: i // size for i, r in enumerate(own)}

    assert {r["n"]: r["batch"] for r in merge.batches(df, "id", 5).collect()} == plain(rows, 5)
    want = {}
    for g in ("a", "b", None):
        want |= plain([r for r in rows if r[1] == g], 2)
    assert {r["n"]: r["batch"] for r in merge.batches(df, "id", 2, group="g").collect()} == want
    assert merge.batches(df.limit(0), "id").count() == 0


def test_enrichment_plans_its_rows_once(spark):
    rows = spark.createDataFrame([(1, 1, "u1", "short")], "query_id int, rank int, url string, description string").repartition("query_id")
    pages = spark.createDataFrame([("u1", "x" * 400)], "url string, content string")
    plan = merge.enrich(rows, pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2


def test_answers_are_read_once_for_all_plain_shapes(spark, tmp_path):
    spark.createDataFrame([(1, "wiby", 0, 5, "[]")], "query_id int, source string, source_ord int, n int, body string").write.parquet(str(tmp_path / "answers"))
    plan = payloads.all_results(spark.read.parquet(str(tmp_path / "answers")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3  # and once for each scraped source


def test_custom_sources(spark):
    """A source of one's own, as a table function over partitions of a table, goes through union, interleave and response."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="query_id int, source_ord int, pos int, title string, url string, description string, content_type string")
    class Lines:
        def eval(self, row):
            for i, x in enumerate(filter(None, (row["body"] or "").split("\n"))):
                yield row["query_id"], row["source_ord"], i, x.upper(), f"https://own.example/{x}", None, None

    spark.udtf.register("own_lines", Lines)
    answers = spark.createDataFrame([(1, "own", "a\nb\nc"), (2, "own", None), (1, "wiby", '[{"Title":"w","URL":"https://w.com"},{"Title":"same","URL":"https://own.example/a"}]')], "query_id int, source string, body string")
    engine = Engine(spark, None, answers, custom={"own": "own_lines"}, as_of="now")
    got = {r["query_id"]: r for r in engine.search(spark.createDataFrame([(1, "q", 3), (2, "r", 3)], "query_id int, query string, num_results int")).collect()}
    assert [(x["url"], x["metadata"]["source"], x["metadata"]["type"]) for x in got[1]["data"]] == [("https://w.com", "wiby", "article"), ("https://own.example/a", "own", "other"), ("https://own.example/b", "own", "other")]
    assert got[2]["data"] == [] and got[1]["metadata"]["timestamp"] == "now"
    assert "own" in {r["source"] for r in engine.sources.filter("available").collect()}


def test_serve_answers_all_tools(spark):
    article = "<title>Page</title><body><article><p>" + "word " * 80 + "</p></article><div class='b'>Some <b>other</b> part</div></body>"
    pages = spark.createDataFrame([("https://e.com/a", article, "2024-05-01T00:00:00Z")], "url string, html string, fetched string")
    answers = spark.createDataFrame([("bees", "wiby", '[{"Title":"w","URL":"https://w.com","Snippet":"s"},{"Title":"x","URL":"https://x.com","Snippet":"t"}]')], "query string, source string, body string")
    maps = spark.createDataFrame([("https://e.com/sitemap.xml", "<loc>https://e.com/a</loc><loc>https://e.com/gone</loc>")], "url string, body string")
    engine = Engine(spark, pages, answers, maps=maps, as_of="2024-06-01T00:00:00Z")
    calls = {
        1: ("web_search", {"query": "bees", "options": {"num_results": 1}}),
        2: ("search_duckduckgo", {"query": "nothing"}),
        3: ("visit_page", {"url": "https://e.com/a"}),
        4: ("visit_page", {"url": "https://e.com/a", "selector": "div.b"}),
        5: ("visit_page", {"url": "https://e.com/gone"}),
        6: ("crawl_site", {"root_url": "https://e.com/", "max_pages": 1}),
        7: ("crawl_site", {"root_url": "https://e.com/"}),
        8: ("crawl_site", {"root_url": "e.com"}),
        9: ("web_search", {"query": "bees", "options": {"num_results": "many"}}),
        10: ("visit_page", {"url": "https://e.com/a", "selector": 5}),
        11: (5, {}),
    }
    lines = [(json.dumps({"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": n, "arguments": a}}),) for i, (n, a) in calls.items()]
    lines += [(lines[0][0],), ('{"jsonrpc":"2.0","id":"l","method":"tools/list"}',), ('{"jsonrpc":"2.0","id":"i","method":"initialize"}',)]
    rows = engine.serve(spark.createDataFrame(lines, "line string")).collect()
    assert len(rows) == len(lines)  # the repeated line is answered twice
    out = {json.loads(r["response"])["id"]: json.loads(r["response"]) for r in rows}
    text = lambda i: out[i]["result"]["content"][0]["text"]
    assert [x["url"] for x in json.loads(text(1))["data"]] == ["https://w.com"] and json.loads(text(1))["metadata"]["timestamp"] == "2024-06-01T00:00:00Z"
    assert out[2]["result"]["isError"] and text(2).startswith("Search failed: Search failed: All 7 search backends returned 0 results (tried: bing, wikipedia")
    assert "**Fetched:** 2024-05-01T00:00:00Z" in text(3) and "word word" in text(3)
    assert "other" in text(4) and "word word" not in text(4)
    assert out[5]["result"]["isError"] and "404" in text(5)
    assert json.loads(text(6))["summary"] == {"requested": 1, "fetched": 1, "failed": 0}
    assert json.loads(text(7))["summary"] == {"requested": 25, "fetched": 1, "failed": 1} and json.loads(text(7))["pages"][0]["title"] == "Page"
    assert text(8) == "Crawl failed: Invalid arguments: invalid root_url: relative URL without a base"
    assert out[9]["error"] == {"code": -32602, "message": 'Invalid search arguments: invalid type: string "many", expected usize'}
    assert out[10]["error"]["message"] == "Invalid fetch arguments: invalid type: integer `5`, expected a string"
    assert out[11]["error"] == {"code": -32601, "message": "Unknown tool: "}
    assert out["l"]["result"]["tools"][0]["inputSchema"]["properties"]["options"]["properties"]["safe_search"]["enum"] == ["OFF", "MODERATE", "STRICT"]
    assert out["i"]["result"]["serverInfo"]["name"] == "webloom" and out["i"]["result"]["capabilities"] == {"tools": {}}


def test_argument_misfits(spark):
    cases = [
        ("crawl", '{"root_url":"r","max_pages":18446744073709551615}', None),
        ("crawl", '{"root_url":"r","max_pages":5.0}', ("max_pages", "invalid type: floating point `5.0`, expected usize")),
        ("crawl", '{"root_url":"r","max_pages":1e2}', ("max_pages", "invalid type: floating point `100.0`, expected usize")),
        ("crawl", '{"root_url":null}', ("root_url", "invalid type: null, expected a string")),
        ("crawl", "[]", ("", "invalid type: sequence, expected struct CrawlArgs")),
        ("crawl", "null", ("", "invalid type: null, expected struct CrawlArgs")),
        ("fetch", '{"url":"u","selector":null,"more":[1]}', None),
        ("search", '{"query":"q","options":{"safe_search":7}}', ("options.safe_search", "invalid type: integer `7`, expected string or map")),
    ]
    for kind, given, want in cases:
        got = spark.createDataFrame([(given,)], "s string").select(requests.misfit(F.parse_json("s"), kind).alias("m")).first()["m"]
        assert (None if got is None else tuple(got)) == want, given


def test_statuses(spark):
    rows = [(1, 0, "a", True, 2), (1, 1, "b", False, 0), (2, 0, "a", True, 0), (2, 1, "b", False, 0)]
    got = {r["query_id"]: r for r in merge.statuses(spark.createDataFrame(rows, "query_id int, source_ord int, source string, ok boolean, n int")).collect()}
    assert (got[1]["any_success"], got[1]["tried"], got[1]["by_source"], got[1]["error"]) == (True, 2, "a", None)
    assert got[2]["error"] == "All 2 search backends returned 0 results (tried: a, b)"
    shown = spark.range(1).select(merge.all_open(F.array(F.lit("a"), F.lit("b"))), merge.no_results(F.lit(1), F.array(F.lit("a")), F.array(F.lit("a")))).first()
    assert shown[0].endswith("Open: [a, b]") and shown[1].endswith("(tried: a); open circuits: [a]")


def test_enrich_overwrites_sparse_rows_only(spark):
    rows = [(1, r, f"u{r}", "short" if r != 2 else "long " * 30) for r in range(1, 6)]
    pages = spark.createDataFrame([("u1", "x" * 400), ("u2", "page"), ("u3", ""), ("u4", "page")], "url string, content string")
    got = {r["rank"]: r["description"] for r in merge.enrich(spark.createDataFrame(rows, "query_id int, rank int, url string, description string"), pages).collect()}
    assert got == {1: "x" * 300, 2: "long " * 30, 3: "", 4: "short", 5: "short"}


def test_payload_quirks(spark):
    def shape(source, body, n):
        return [tuple(r)[1:4] for r in payloads.results(spark.createDataFrame([(1, n, body)], "query_id int, n int, body string"), source).orderBy("pos").select("pos", "title", "url", "description").collect()]

    assert shape("wikipedia", '["q",["a","b","c"],["x"],["u1","","u3"]]', 10) == [("a", "u1", "x"), ("c", "u3", "")]
    assert shape("wikipedia", "no json", 10) == [] and shape("serper", "{}", 3) == []
    assert shape("github", '{"items":[{"full_name":"o/r","html_url":"u","stargazers_count":3}]}', 5) == [("o/r", "u", " | 3 ")]
    instant = json.dumps({"AbstractText": "about", "AbstractURL": "a", "Heading": "h", "RelatedTopics": [{"Text": "t" * 90, "FirstURL": "u"}, {"Text": "c", "FirstURL": "https://duckduckgo.com/c/x"}, {"Name": "group", "Topics": []}]})
    assert shape("ddg-instant", instant, 5) == [("h", "a", "about"), ("t" * 80, "u", "t" * 90)]
    assert shape("ddg-instant", instant, 0) == [("h", "a", "about")]  # the abstract comes even if none are asked for
    serp = "".join(f'<li class="b_algo"><h2><a href="{u}">T{i}</a></h2></li>' for i, u in enumerate(["https://a", "/internal", "https://www.bing.com/ck/x", "https://b", "https://c"]))
    assert [r[1] for r in shape("bing", serp, 2)] == ["https://a", "https://b"]


SITEMAP = "<urlset><url><loc>https://e.com/b/c/d</loc></url><loc> https://e.com/a </loc><loc>https://e.com/a</loc><loc>no url</loc><loc>https://e.com/e/f</loc><loc>open"


def test_site_maps(spark):
    cases = [(SITEMAP, ["https://e.com/b/c/d", "https://e.com/a", "https://e.com/e/f"]), ("<loc>https://x.y/unclosed", []), ("<LOC>https://x.y</LOC>", []), ("", [])]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, body string").select("i", captured.site_map("body").alias("u")).orderBy("i")
    assert [r["u"] for r in df.collect()] == [c[1] for c in cases]


def test_crawl(spark):
    page = "<html><title>{0}</title><body><article><p>" + "word " * 60 + "</p><a href='/x'>link to x</a></article></body></html>"
    pages = spark.createDataFrame([(f"https://e.com{p}", page.format(p)) for p in ("/a", "/b/c/d")] + [("https://f.com/", "<a href='/one'>1</a><a href='https://o.com/'>2</a>"), ("https://f.com/one", page.format("one"))], "url string, html string")
    maps = spark.createDataFrame([("https://e.com/sitemap_index.xml", SITEMAP), ("https://e.com/wp-sitemap.xml", "<loc>https://e.com/late</loc>")], "url string, body string")
    roots = spark.createDataFrame([("https://e.com/", 2), ("https://f.com/", 0), ("https://none.com/", 900)], "root string, max_pages int")
    got = {r["root_url"]: r for r in crawl.crawl(roots, maps, pages).collect()}
    e = got["https://e.com/"]
    assert e["sitemap_found"] and [p["url"] for p in e["pages"]] == ["https://e.com/a"] and e["pages"][0]["links"] == ["https://e.com/x"]
    assert [(x["url"], x["error"]) for x in e["errors"]] == [("https://e.com/e/f", "Failed to fetch page: HTTP 404 Not Found")]
    assert tuple(e["summary"]) == (2, 1, 1)
    f = got["https://f.com/"]
    assert not f["sitemap_found"] and [p["url"] for p in f["pages"]] == ["https://f.com/one"] and f["summary"]["requested"] == 1
    assert got["https://none.com/"]["pages"] == [] and got["https://none.com/"]["summary"]["requested"] == 500
    assert "--- https://f.com/one ---" in crawl.crawl(roots, maps, pages).filter("root_url = 'https://f.com/'").select(render.crawl_text("summary.fetched", "summary.failed", "pages")).first()[0]


def simulated_breaker(events, failures, cooldown):
    count, is_open, last, out = 0, False, 0, []
    for t, n, ok in sorted(events):
        admitted = not is_open or t - last >= cooldown
        if admitted and ok is not None:
            if ok:
                count, is_open = 0, False
            else:
                count, last = count + 1, t
                is_open = is_open or count >= failures
        out.append((n, admitted, count, is_open))
    return out


def random_events(seed, n=60, span=200):
    rng = random.Random(seed)
    return [(rng.randrange(span), i, rng.choice([True, False, False, None])) for i in range(n)]


def test_breaker_equals_simulation(spark):
    cases = {f"b{i}": random_events(i) for i in range(20)}
    rows = [(k, *e) for k, own in cases.items() for e in own]
    df = spark.createDataFrame(rows, "backend string, t long, n long, ok boolean")
    got = {}
    for r in folds.breaker(df, failures=3, cooldown=15).orderBy("t", "n").collect():
        got.setdefault(r["backend"], []).append((r["n"], r["admitted"], r["failures_after"], r["open_after"]))
    assert got == {k: simulated_breaker(v, 3, 15) for k, v in cases.items()}


def test_rows_that_are_not_sparse_are_spread(spark):
    """Rows that look up no page are not one task's."""
    rows = [(q, r, None if q % 5 == 0 else "u1", "long " * 40 if (q + r) % 4 else "short") for q in range(250) for r in range(1, 5)]
    pages = spark.createDataFrame([("u1", "the page"), ("u2", None)], "url string, content string")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = merge.enrich(spark.createDataFrame(rows, "query_id int, rank int, url string, description string"), pages)
        parts = [p for p in out.rdd.glom().collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    shown = sorted(((r["query_id"], r["rank"], r["url"], r["description"]) for p in parts for r in p), key=repr)
    assert shown == sorted(((q, r, u, "the page" if r <= 3 and d == "short" and u else d) for q, r, u, d in rows), key=repr)
    assert max(len([r for r in p if r["description"].startswith("long")]) for p in parts) < 350  # of 750, in 4 partitions


def test_circuits_and_caches_over_many_bins(spark):
    """Bins of any width give what one pass over a key's events gives; events come without pause, and at one time."""
    rows = [(k, t, n, ok) for i, k in enumerate(["a", "b", None]) for t, n, ok in random_events(i + 60, 150, 150)]
    df = spark.createDataFrame(rows, "backend string, t long, n long, ok boolean").repartition(3)
    own = {k: [(t, n, ok) for b, t, n, ok in rows if b == k] for k in ("a", "b", None)}
    for width, failures, cooldown in ((1, 3, 15), (11, 2, 4), (40, 1, 15), (10_000, 3, 15)):
        traced, stored = {}, {}
        for k, events in own.items():
            traced |= {(k, n): tuple(x) for n, *x in simulated_breaker(events, failures, cooldown)}
            since = None
            for t, n, _ in sorted(events):
                hit = since is not None and t - since < cooldown
                since = since if hit else t
                stored[k, n] = hit, since
        assert {(r["backend"], r["n"]): (r["admitted"], r["failures_after"], r["open_after"]) for r in folds.breaker(df, failures=failures, cooldown=cooldown, width=width).collect()} == traced
        assert {(r["backend"], r["n"]): (r["hit"], r["stored_at"]) for r in folds.cache(df, "backend", ttl=cooldown, width=width).collect()} == stored


def test_no_group_is_a_whole_past(spark):
    """Of a busy key's events, a group has those of a bin; what goes on to the next bin does not grow with them."""
    seen = spark.sparkContext.accumulator(0)
    day = np.arange(0, 86_400_000_000, 10_000_000)
    kind, _, _, upto = jumps.summary(day, np.zeros(len(day), bool), 3, 30_000_000)
    assert len(kind) == 3 + 4 and len(upto) == 4  # closed with 0 to 2 failures; open until one of the first cooldown's events
    df = spark.range(20_000).select(F.lit("a").alias("backend"), (F.col("id") * 20_000_000).alias("t"), F.col("id").alias("n"), (F.col("id") % 7 == 0).alias("ok"))
    sizes = jumps._rows

    def counted(failures, cooldown):
        inner = sizes(failures, cooldown)

        def rows(table, start):
            assert len(table) < 1000
            seen.add(len(table))
            return inner(table, start)

        return rows

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(jumps, "_rows", counted)
        assert folds.breaker(df).count() == 20_000
    assert seen.value == 20_000


def test_transient_failures_count_twice(spark):
    df = spark.createDataFrame([(0, 1, False, True, False), (1, 2, False, False, False), (2, 3, True, True, False)], "t long, n long, ok boolean, transient boolean, retry_ok boolean")
    assert sorted(tuple(r) for r in folds.with_retries(df).select("n", "sub", "ok").collect()) == [(1, 0, False), (1, 1, False), (2, 0, False), (3, 0, True)]


def test_limiter_waits(spark):
    df = spark.createDataFrame([("a", 0, i) for i in range(5)] + [("a", 100, 9)], "backend string, t long, n long")
    assert [r["admitted_at"] for r in folds.limiter(df, "backend", 10, 3).orderBy("t", "n").collect()] == [0, 0, 0, 10, 20, 100]


def test_limiter_and_streaks_over_many_bins(spark):
    """Bins of any width give what one pass over a key's events gives."""
    rows = [(k, t, n, ok) for i, k in enumerate(["a", "b", None]) for t, n, ok in random_events(i + 40, 80, 400)]
    df = spark.createDataFrame(rows, "backend string, t long, n long, ok boolean").repartition(3)
    admitted, runs = {}, {}
    for k in ("a", "b", None):
        tat, run = -(1 << 62), 0
        for t, n, ok in sorted((t, n, ok) for b, t, n, ok in rows if b == k):
            at = max(t, tat - 2 * 9)
            tat, run = max(tat, at) + 9, 0 if ok else run + 1
            admitted[k, n], runs[k, n] = at, run
    for width in (7, 60, 10_000):
        assert {(r["backend"], r["n"]): r["admitted_at"] for r in folds.limiter(df, "backend", 9, 3, width).collect()} == admitted
        assert {(r["backend"], r["n"]): r["streak"] for r in folds.streaks(df, width=width).collect()} == runs


def test_cache(spark):
    df = spark.createDataFrame([("k", t, i) for i, t in enumerate([0, 5, 9, 10, 19, 20])], "key string, t long, n long")
    assert [r["hit"] for r in folds.cache(df, ttl=10).orderBy("n").collect()] == [False, True, True, False, True, False]
    assert not any(r["hit"] for r in folds.cache(df, ttl=10, enabled=False).collect())


def stream_of(spark, tmp_path, df, key, processor):
    """The events in two files, one a batch, through the processor."""
    schema, name = df.schema, f"out_{processor.__class__.__name__.lower()}"
    cut = df.approxQuantile("t", [0.5], 0)[0]
    df.filter(F.col("t") <= cut).coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    df.filter(F.col("t") > cut).coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = processors.apply(stream, key, processor).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(map(tuple, spark.table(name).collect()), key=str)


def test_stream_twins(spark, tmp_path):
    rows = [(f"b{i % 3}", *e) for i in range(6) for e in [(t, n + 1000 * i, ok) for t, n, ok in random_events(i, 30)]]
    df = spark.createDataFrame(rows, "backend string, t long, n long, ok boolean")
    assert stream_of(spark, tmp_path / "1", df, "backend", processors.Breaker(3, 15)) == sorted(map(tuple, folds.breaker(df, failures=3, cooldown=15).collect()), key=str)
    assert stream_of(spark, tmp_path / "2", df, "backend", processors.Limiter(10, 3)) == sorted(map(tuple, folds.limiter(df, "backend", 10, 3).collect()), key=str)
    cached = df.select(F.col("backend").alias("key"), "t", "n")
    assert stream_of(spark, tmp_path / "3", cached, "key", processors.Cache(10)) == sorted(map(tuple, folds.cache(cached, ttl=10).collect()), key=str)


def test_request_lines_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"jsonrpc":"2.0","id":1,"method":"ping"}\n\nnot json\n{"jsonrpc":"2.0","method":"ping"}\n')
    rows = requests.response_lines(requests.dispatched(requests.parsed(processors.request_lines(spark, str(tmp_path / "in"))))).select("response")
    q = rows.writeStream.format("memory").queryName("answers").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r[0] for r in spark.table("answers").collect()) == ['{"jsonrpc":"2.0","id":1,"result":{}}', '{"jsonrpc":"2.0","id":null,"error":{"code":-32700,"message":"Parse error"}}']


def test_engine(spark):
    article = "<title>Page</title><body><article><p>" + "word " * 80 + "</p></article></body>"
    pages = spark.createDataFrame([("https://e.com/a", article), ("https://r.com/1", article)], "url string, html string")
    answers = spark.createDataFrame([(1, "github", '{"items":[{"full_name":"o/r","html_url":"https://r.com/1","description":"d","stargazers_count":3}]}'), (1, "wiby", '[{"Title":"w","URL":"https://w.com","Snippet":"s"},{"Title":"again","URL":"https://r.com/1"}]'), (1, "serper", '{"organic":[{"title":"no key","link":"https://n.com"}]}')], "query_id int, source string, body string")
    engine = Engine(spark, pages, answers)
    got = {r["query_id"]: r for r in engine.search(spark.createDataFrame([(1, "Привет"), (2, "nothing")], "query_id int, query string")).collect()}
    assert engine.check().filter("ok").count() == 9
    assert [x["url"] for x in got[1]["data"]] == ["https://r.com/1", "https://w.com"] and got[1]["data"][0]["description"].startswith("word word")
    assert got[1]["metadata"]["query_analysis"]["language"] == "ru" and got[2]["data"] == [] and got[2]["metadata"]["result_count"] == 0
    visited = {r["url"]: r for r in engine.visit(spark.createDataFrame([("https://e.com/a",), ("ftp://x",), ("https://gone.com/",)], "url string")).collect()}
    assert visited["https://e.com/a"]["title"] == "Page" and visited["ftp://x"]["error"].startswith("Invalid URL") and "404" in visited["https://gone.com/"]["error"]
    lines = ['{"id":1,"method":"tools/call","params":{"name":"visit_page","arguments":{"url":"https://e.com/a"}}}', '{"id":2,"method":"tools/list"}', '{"id":3,"method":"initialize"}', '{"id":4,"method":"tools/call","params":{"name":"visit_page","arguments":{"url":"ftp://x"}}}']
    out = {json.loads(r["response"])["id"]: json.loads(r["response"]) for r in engine.serve(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    assert out[1]["result"]["content"][0]["text"].startswith("# Page\n\n**URL:** https://e.com/a") and not out[1]["result"]["isError"]
    assert len(out[2]["result"]["tools"]) == 4 and out[3]["result"]["protocolVersion"] == "2024-11-05" and out[4]["result"]["isError"]


def test_errors_shown(spark):
    got = spark.sql("SELECT 'bot' AS k, CAST(NULL AS STRING) AS m UNION ALL SELECT 'fetch', 'HTTP 500' UNION ALL SELECT 'x', 'y'").select(classify.error_text("k", "m")).collect()
    assert [r[0] for r in got] == ["Bot protection detected on target page", "Failed to fetch page: HTTP 500", None]


def test_pages_and_crawls_for_people(spark):
    links = [(f"t{i}", f"https://e.org/{i}") for i in range(12)]
    df = spark.createDataFrame([("T", "https://e.org/", "now", 3, "a b c", links), ("U", "https://f.org/", "now", 0, None, None)], "title string, url string, at string, n int, body string, links array<struct<text:string,url:string>>")
    shown = [r[0] for r in df.select(render.page_text("title", "url", "at", "n", "body", "links")).collect()]
    head = lambda t, u, n: f"\n{t}\n{'=' * 50}URL: {u}\nFetched: now\nWords: {n}\n\n"
    assert shown[0] == head("T", "https://e.org/", 3) + "a b c\n\nLinks found (12):\n" + "".join(f"  - t{i} (https://e.org/{i})\n" for i in range(10))
    assert shown[1] == head("U", "https://f.org/", 0) + "\n"
    pages = spark.createDataFrame([(1, 2, [("https://e.org/", "é" * 300)])], "ok int, bad int, pages array<struct<url:string,markdown:string>>")
    assert pages.select(render.crawl_text("ok", "bad", "pages")).first()[0] == "\nCrawl complete: 1 pages, 2 errors\n\n--- https://e.org/ ---\n" + "é" * 200 + "\n"


def test_json_sink_and_files(spark, tmp_path):
    render.write_lines(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"a":1}', '{"a":2,"b":"x"}']
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "a.html").write_bytes(b"<p>x")
    (tmp_path / "pages" / "b.png").write_bytes(bytes.fromhex("89504E47"))
    rows = captured.routed(captured.captured(spark, str(tmp_path / "pages"))).collect()
    assert sorted(r["content"]["kind"] for r in rows) == ["binary", "html"]
