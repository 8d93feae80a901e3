"""Site map files, the live page source, the response sink, counts of fetches on a stream."""

import datetime as dt
import glob
import os
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from webloom.functions import classify, rules
from webloom.operators import crawl, requests
from webloom.sources import pages as captured
from webloom.streaming import processors, sink


def test_site_map_files_keep_their_order(spark, tmp_path, monkeypatch):
    """Long maps are cut into files, files into blocks; entries keep their places, the first of each stays."""
    monkeypatch.setattr(captured, "MAP_URLS", 300)
    rows = [("a.org", i, f"https://a.org/{i * 7919 % 1000}") for i in range(1000)] + [("a.org", 2000, "https://a.org/5"), ("b.org", 1, " https://b.org/x "), ("b.org", 2, "no url"), ("b.org", 3, None), ("b.org", 4, "https://b.org/a&b")]
    captured.write_site_maps(spark.createDataFrame(rows, "host string, n int, loc string").repartition(4), str(tmp_path / "maps"), "host", "n")
    assert len(glob.glob(f"{tmp_path}/maps/site=a.org/part=*")) == 4
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = captured.read_site_maps(spark, str(tmp_path / "maps"))
        assert got.rdd.getNumPartitions() > 0 and spark.read.format("xml").option("rowTag", "url").load(str(tmp_path / "maps")).rdd.getNumPartitions() > 4
        urls = {h: [r["url"] for r in sorted(got.filter(F.col("host") == h).collect(), key=lambda r: r["pos"])] for h in ("a.org", "b.org")}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert urls["a.org"] == [f"https://a.org/{i * 7919 % 1000}" for i in range(1000)]
    assert urls["b.org"] == ["https://b.org/x", "https://b.org/a&b"]


@pytest.fixture
def server():
    asked = []

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            body = b"<p>" + self.path.encode()
            if self.path == "/missing":
                self.send_error(404)
                return
            self.send_response(200)
            self.send_header("Content-Type", "text/html")
            self.send_header("Content-Length", str(rules.MAX_BODY + 1 if self.path == "/large" else len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    own = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}", asked
    own.shutdown()


def test_filters_reach_the_page_source(spark, server):
    """What a filter leaves out is not fetched; bodies too large are not read; pages that cannot be had are rows."""
    site, asked = server
    captured.register_pages_source(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pages = lambda where=None: captured.live_pages(spark, [f"{site}{p}" for p in ("/a", "/b", "/large", "/missing", "/b")], where, 5)
        one = pages(F.col("url") == f"{site}/b")
        assert [bytes(r["body"]) for r in one.collect()] == [b"<p>/b"] and set(asked) == {"/b"}
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "BatchScan" in plan and "Filter (url" not in plan
        assert pages(F.col("host") == "elsewhere.org").count() == 0 and set(asked) == {"/b"}
        assert {r["url"].removeprefix(site) for r in pages(F.col("url").startswith(f"{site}/l") & (F.length("url") > 3)).collect()} == {"/large"}
        assert "/a" not in asked
        got = {r["url"].removeprefix(site): r for r in pages().collect()}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert set(got) == {"/a", "/b", "/large", "/missing"} and got["/a"]["error"] is None and got["/a"]["host"] == "127.0.0.1"
    assert got["/large"]["body"] is None and "bytes" in got["/large"]["error"] and got["/missing"]["status"] == 404 and got["/missing"]["error"]


def answered(spark, folder):
    rows = requests.response_lines(requests.dispatched(requests.parsed(processors.request_lines(spark, f"{folder}/in"))))
    query = sink.write_responses(rows, f"{folder}/out", f"{folder}/checkpoint", once=True)
    query.awaitTermination(120)
    assert query.exception() is None
    return sorted(r["response"] for r in sink.committed(spark, f"{folder}/out").collect())


def test_a_restarted_stream_writes_each_line_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    ping = lambda i: f'{{"jsonrpc":"2.0","id":{i},"method":"ping"}}\n'
    want = lambda n: sorted(f'{{"jsonrpc":"2.0","id":{i},"result":{{}}}}' for i in range(n))
    (tmp_path / "in" / "a.txt").write_text("".join(map(ping, range(5))))
    assert answered(spark, tmp_path) == want(5)
    (tmp_path / "in" / "b.txt").write_text("".join(map(ping, range(5, 9))))
    assert answered(spark, tmp_path) == want(9)
    # As if the driver had been lost after the sink's commit and before Spark noted it: the epoch is run again.
    for name in glob.glob(f"{tmp_path}/checkpoint/commits/1") + glob.glob(f"{tmp_path}/checkpoint/commits/.1.crc"):
        os.remove(name)
    assert answered(spark, tmp_path) == want(9)
    assert not [n for n in os.listdir(tmp_path / "out") if n.endswith(".tmp")]


def test_an_epoch_that_is_tried_again_replaces_its_lines(tmp_path):
    own = sink.LineWriter(str(tmp_path), "response")
    own.commit([own.write(iter([{"response": "a"}])), own.write(iter([])), own.write(iter([{"response": "b"}]))], 3)
    own.abort([own.write(iter([{"response": "lost"}])), None], 4)
    own.commit([own.write(iter([{"response": "a"}, {"response": "b"}]))], 3)
    assert [(n, (tmp_path / n).read_text()) for n in sorted(os.listdir(tmp_path))] == [("epoch-0000000003-00000.jsonl", "a\nb\n")]


def test_counts_on_a_stream_drop_what_is_late(spark, tmp_path):
    """Counts are updated until the watermark has passed; what comes later is dropped, and the rest equals the batch."""
    at = lambda hour, minute=0: dt.datetime(2024, 1, 1, hour, minute)
    schema = "root_url string, fetched_at timestamp, error string"
    first = [("r", at(1, 5), None), ("r", at(1, 50), "HTTP 503"), ("s", at(2, 10), None)]
    second = [("r", at(1, 40), None), ("s", at(6, 0), None)]  # 1:40 comes in time: the watermark stands at 2:00
    third = [("r", at(1, 45), None), ("s", at(6, 30), "HTTP 404")]  # the watermark stands at 5:50: 1:45 is late
    for name, rows in (("a", first), ("b", second), ("c", third)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    counts = {}

    def keep(batch, _):
        counts.update({(r["root_url"], r["since"]): (r["requested"], r["fetched"], r["failed"]) for r in batch.collect()})

    q = crawl.counts_over_time(stream, "1 hour", "10 minutes").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    batch = crawl.counts_over_time(spark.createDataFrame([r for r in first + second + third if r[1] != at(1, 45)], schema), "1 hour").collect()
    assert counts == {(r["root_url"], r["since"]): (r["requested"], r["fetched"], r["failed"]) for r in batch}


def test_signatures_at_their_places(spark):
    made = [(kind, bytes.fromhex(classify.sample_hex(parts)) + b"\x07rest") for kind, parts in rules.SIGNATURES]
    made += [("audio/mpeg", b"\xff\xfb\x90\x00"), ("text/html", b"  <!DOCTYPE HTML><p>"), ("text/xml", b"<?xml version='1.0'?>"), (None, b"plain"), (None, b""), (None, b"RIFF0000ACON"), ("application/zip", b"PK\x03\x04" + b"\0" * 26 + b"a.txt")]
    rows = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(made)], "i int, body binary").select("i", classify.sniffed("body").alias("k")).orderBy("i").collect()
    assert [r["k"] for r in rows] == [k for k, _ in made]
    assert spark.createDataFrame([(None,)], "body binary").select(classify.sniffed("body")).first()[0] is None
