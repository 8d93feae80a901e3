"""Golden cases of the scalar functions and classifiers."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webloom.functions import classify, dom, lazy, text
from webloom.functions import url as urls
from webloom.operators import requests
from webloom.sources import pages as captured
from webloom.sources import registry


def column(spark, values, build, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", build(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


def check(spark, build, cases, kind="string"):
    assert column(spark, [c[0] for c in cases], build, kind) == [c[1] for c in cases]


def test_redirects_and_domains(spark):
    check(spark, urls.unwrap_redirect, [("//duckduckgo.com/l/?uddg=https%3A%2F%2Fexample.com%2Fpath&rut=abc", "https://example.com/path"), ("//example.com/path", "https://example.com/path"), ("https://a.b/c", "https://a.b/c"), ("x?uddg=a+b", "a+b"), ("x?uddg=%zz", "x?uddg=%zz"), (None, None)])
    check(spark, urls.domain, [("https://www.example.com/path", "www.example.com"), ("invalid", "invalid"), ("", "unknown"), ("https://EX.org:8080/a b", "EX.org:8080"), ("//cdn.x/y", "unknown")])


def test_validity_and_skips(spark):
    check(spark, urls.is_http, [("http://a.b", True), ("https://a.b/c", True), ("ftp://a.b", False), ("javascript:alert(1)", False), ("not a url", False), ("", False), ("http://", False), (None, False)])
    check(spark, urls.skipped_in_crawl, [("", True), (":foo", True), ("#a", True), ("  ", False), ("JavaScript:x", False), ("tel:1", False), ("//cdn.x/y", False)])
    check(spark, urls.skipped_in_page, [("tel:1", True), ("#a", True), ("mailto:x", True), ("JavaScript:x", False), ("", False)])


def test_resolving():
    base = "https://example.com/page"
    cases = {"/other": "https://example.com/other", "relative": "https://example.com/relative", "//cdn.x/y": "https://cdn.x/y", "../up": "https://example.com/up", "?q=1": "https://example.com/page?q=1", "/ä b": "https://example.com/%C3%A4%20b", "HTTP://EX.org:80": "http://ex.org/", "http://ex.org:8080/a/./b/../c/": "http://ex.org:8080/a/c/", "JavaScript:x": "javascript:x"}
    assert {k: urls.resolved(base, k) for k in cases} == cases
    assert urls.resolved(base, "http://[bad") is None and urls.resolved(None, "/a") is None


def test_titles_and_paths(spark):
    check(spark, urls.title_from_url, [("https://example.com/docs/guide.pdf", "guide.pdf"), ("https://example.com/", "https://example.com/"), ("https://e.com/a//", "a")])
    check(spark, urls.path_length, [("https://x.com", 1), ("https://x.com/ab", 3), ("nope", 1)])
    same = spark.sql("SELECT 'https://a.b/x' AS a, 'https://A.b:443/y' AS b, 'http://a.b/' AS c").select(urls.same_origin("a", "b"), urls.same_origin("a", "c")).first()
    assert tuple(same) == (True, False)


def test_text(spark):
    check(spark, text.word_count, [("  spaced   words  ", 2), ("", 0), ("a b c", 3), (None, None)])
    check(spark, text.clean_text, [("Hello&#x27;s World", "Hello's World"), ("&lt;html&gt;", "<html>"), ("a  b", "a b"), ("&amp;lt;", "<"), ("&#x41;&#xzz; &#x110000; &#233;", "A&#xzz; &#x110000; &#233;"), ("x &#x1F600; y", "x \U0001f600 y")])
    check(spark, text.clean_title, [("Page Title | Site Name", "Page Title"), ("Page Title - Site Name", "Page Title"), ("a - | b", "a -"), ("x :: y", "x"), ("x — y", "x")])
    check(spark, text.clean_markdown, [("# Title\n\n\n\nParagraph", "# Title\n\nParagraph"), ("Content\n-\n*\n+\nMore", "Content\nMore"), ("  code\r\n\r\n   x ", "code\n\nx")])
    check(spark, text.link_text, [("é", None), ("日", "日"), (" a  b ", "a b"), ("", None)])
    check(spark, text.language, [("Hello", "en"), ("漢字ひらがな", "zh"), ("ひらがな", "ja"), ("한국어", "ko"), ("Привет", "ru"), ("مرحبا", "ar"), ("été", "en")])
    check(spark, text.decode_entities, [("a &eacute; &amp;", "a é &"), ("plain", "plain"), (None, None)])
    check(spark, text.is_sparse, [("é" * 50, False), ("é" * 49, True)])
    check(spark, text.lossy_utf8, [(b"ab", "ab"), (b"a\xffb", "a�b")], "binary")
    check(spark, text.looks_like_article, [("words", True), ("", False), ("a\x00", False), ("123", False)])


def test_classifiers(spark):
    check(spark, classify.url_type, [("https://docs.rs/x", "documentation"), ("https://github.com/a", "documentation"), ("https://twitter.com/a", "social"), ("https://netflix.com/", "social"), ("https://reddit.com/r", "forum"), ("https://youtube.com/w", "video"), ("https://amazon.com/d", "shopping"), ("https://example.com", "article")])
    rows = spark.sql("SELECT 'https://x.y/' AS u, 'Plain' AS t, 'video' AS k").select(classify.topics("u", "t", "k")).first()[0]
    assert rows == ["academic", "documentation", "technology"]  # topics without a type match every row
    check(spark, classify.safe_search, [("moderate", -1), ("OFF", -2), ("Strict", 1), ("invalid", None)])
    check(spark, lambda m: classify.non_retryable(F.lit("search"), m), [("HTTP 403 forbidden", True), ("CAPTCHA required", True), ("bot protection triggered", True), ("bot detected on page", True), ("connection reset", False), (None, False)])
    check(spark, lambda m: classify.transient(F.lit("search"), m), [("HTTP 429 Too Many Requests", True), ("connection timed out", True), ("connection reset", False)])
    check(spark, classify.status_class, [(200, "ok"), (429, "transient:rate_limit"), (403, "permanent:bot"), (500, "permanent:HTTP 500")], "int")
    check(spark, classify.suspicious_title, [("Just a moment...", True), ("Roads blocked by snow", True), ("Fine", False)])


def test_routing(spark):
    rows = [("text/html", b"<p>x"), ("application/pdf", b"%PDF-1.4"), ("", bytes.fromhex("FFD8FFE0")), ("", b"plain"), ("", bytes.fromhex("80818283")), ("image/png; x=1", b"abc"), ("", b"%PDF-1.4"), ("application/x-y", bytes.fromhex("80818283"))]
    got = captured.routed(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, content_type string, body binary")).orderBy("i").collect()
    assert [(r["content"]["kind"], r["content"]["mime"]) for r in got] == [("html", None), ("pdf", None), ("binary", "image/jpeg"), ("html", None), ("binary", "application/octet-stream"), ("binary", "image/png"), ("pdf", None), ("binary", "application/x-y")]


def test_registry(spark):
    assert [r["source"] for r in registry.available(registry.registry(spark)).orderBy("source_ord").collect()][:3] == ["bing", "wikipedia", "stackoverflow"]
    assert [r["source"] for r in registry.available(registry.registry(spark, custom=[("own", False, "api")])).collect()] == ["own"]
    assert requests.tools(spark).count() == 4 and requests.server_info(spark).first()["protocol_version"] == "2024-11-05"


ARTICLE = "<html><head><title>T | Site</title></head><body><nav><a href='/n'>navigation</a></nav><article><h1>Head</h1><p>" + " ".join(f"word{i}" for i in range(60)) + "</p><a href='/one'>first link</a><a href='/one'>again</a><a href='#x'>skip this</a></article></body></html>"


def test_pages():
    page = dom.page_of(ARTICLE, "https://e.com/a")
    assert page["title"] == "T" and page["word_count"] >= 60 and [x["url"] for x in page["links"]] == ["https://e.com/n", "https://e.com/one"]
    assert dom.page_of("<title>Short</title><p>few words here</p>", "https://e.com")["links"] is None
    assert dom.page_of("<div id='cf-challenge-running'></div>", "https://e.com")["error_kind"] == "bot"
    assert dom.page_of("<title>Just a moment...</title>", "https://e.com")["error_kind"] == "bot"
    assert dom.page_of(ARTICLE, "https://e.com", "!!")["error_kind"] == "arguments"
    assert dom.page_of(ARTICLE, "https://e.com", "h1")["content"] == "Head"
    assert dom.page_of(None, "https://e.com")["error_kind"] == "fetch"
    assert dom.title_of(dom.parse("<h1>Only</h1>")) == "Only" and dom.title_of(dom.parse("<p>x")) == "Untitled"


def test_links():
    many = "".join(f"<a href='/p{i}'>link {i}</a>" for i in range(70))
    assert len(dom.links_of(dom.parse(many), "https://e.com")) == 50
    # a target whose first text is too short stays seen
    assert dom.links_of(dom.parse("<a href='/a'>x</a><a href='/a'>good text</a>"), "https://e.com") == []
    root = dom.parse("<a href='/a'>a</a><a href='https://other.com/'>b</a><a href='https://E.com:443/a'>c</a><a href='mailto:x'>d</a><a href=' /b '>e</a>")
    assert dom.site_links(root, "https://e.com/", 10) == ["https://e.com/a", "https://e.com/b"]
    assert len(dom.site_links(dom.parse(many), "https://e.com/", 3)) == 3


@pytest.mark.parametrize(("chosen", "n"), [("div.result", 1), ("#x", 1), ("[role='main']", 1), ("div p", 2), ("a[href*='ex']", 1), ("p, a", 3), ("section", 0)])
def test_selectors(chosen, n):
    root = dom.parse("<div class='big result' id=x role=main><p>1<p>2</div><a href='http://ex.org'>l</a>")
    assert len(list(dom.select(root, chosen))) == n


def test_markdown():
    root = dom.parse("<h2>A <b>x</b></h2><ul><li>one<li>two <a href='/q'>q</a></ul><p>para<script>var a='</p>';</script><pre>c\n d</pre><blockquote>q</blockquote><ol><li>z</ol>")
    assert dom.markdown(root) == "## A **x**\n\n* one\n* two [q](/q)\n\npara\n\n```\nc\n d\n```\n\n> q\n\n1. z"


def test_pdf():
    body = b"%PDF-1.4\n1 0 obj\n<<>>\nstream\nBT /F1 12 Tf (Hello PDF) Tj ET\nendstream\nendobj"
    assert dom.pdf_text(body) == "Hello PDF" and dom.pdf_text(b"no") is None


def test_pdf_pages(spark):
    body = b"%PDF-1.4\nstream\nBT (  hello world  ) Tj ET\nendstream"
    row = captured.pdf_pages(spark.createDataFrame([("https://e.com/a/doc.pdf", body), ("https://e.com/x", b"<p>")], "url string, body binary")).collect()
    assert [(r["title"], r["content"], r["word_count"], r["links"]) for r in row] == [("doc.pdf", "hello world", 2, None)]


def test_of_a_batch_only_a_slice_is_python_objects():
    """Results come after at most a slice's rows and characters, whatever a batch has."""
    asked = []
    batch = pa.array(["x" * 400_000] * 10)
    slices = lazy.sliced(lambda t: asked.append(1) or len(t), iter([(batch,)]), pa.int64())
    assert next(slices).to_pylist() == [400_000] * 3 and len(asked) == 3
    assert [len(x) for x in slices] == [3, 3, 1]
    assert [len(x) for x in lazy.sliced(lambda t, u: t, iter([(pa.array([None] * 600), pa.array(range(600)))]), pa.string())] == [256, 256, 88]


def test_pages_take_rows_of_their_own(spark):
    """Two functions of pages in one plan, null rows among them, over batches of many slices."""
    rows = [(i, None if i % 7 == 0 else f"<p>t{i} <a href='/b{i}'>link</a></p>", "https://a.example/") for i in range(600)]
    d = spark.createDataFrame(rows, "i int, html string, url string").repartition(2)
    got = d.select("i", dom.to_markdown("html").alias("m"), dom.page_links("html", "url").alias("l"), dom.page("html", "url").alias("p")).collect()
    assert len(got) == 600
    for r in got:
        if r["i"] % 7 == 0:
            assert r["m"] is None and r["l"] == [] and r["p"]["error_kind"] == "fetch"
        else:
            assert r["m"] == r["p"]["content"] == f"t{r['i']} [link](/b{r['i']})" and r["l"][0]["url"] == f"https://a.example/b{r['i']}"
