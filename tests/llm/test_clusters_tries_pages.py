"""Centroid clustering, prefix tries and page extraction, against plain versions and on odd tables."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import centroids, extract, trie

# ---- clusters


def plain_clusters(rows, s):
    """rows: (id, vector), compared one by one with all centroids, in Python's whole numbers."""
    good = [(i, [math.floor(s.scale * x) for x in v]) for i, v in rows if v is not None and len(v) == s.dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: (1, "") if i is None else (0, hashlib.sha256(f"{s.seed}:{i}".encode()).hexdigest())
    cs = [v for _, v in sorted(good, key=lambda r: (digest(r[0]), r[1]))[: s.clusters]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    own = lambda v: min(range(len(cs)), key=lambda c: (away(v, cs[c]), c))
    for _ in range(s.rounds):
        held = defaultdict(list)
        for _, v in good:
            held[own(v)].append(v)
        cs = [[sum(x) // len(held[c]) for x in zip(*held[c], strict=True)] if held[c] else cs[c] for c in range(len(cs))]
    out = [(i, own(v), away(v, cs[own(v)])) for i, v in good]
    inertia = [sum(d for _, c, d in out if c == k) for k in range(len(cs))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted([(i, c, d, inertia[c], sum(inertia), sha[c]) for i, c, d in out], key=repr)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cluster string, key int").repartition(3)


def test_clusters_are_those_of_all_comparisons(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(5, 4)) * 3
    rows = [(i, [float(x) for x in middle[i % 5] + rng.normal(size=4)], None, "x", 1) for i in range(700)]
    rows += [(700 + i, [0.5, 0.25, -0.125, 0.0], 1, None, None) for i in range(90)]  # one vector, many times
    rows += [(i, [float(i % 3), 0.0, 0.0, -1.0], 1, None, None) for i in range(40)]  # ids that repeat
    s = centroids.Settings(dims=4, scale=16, clusters=6, rounds=7, block=128, leaf=4)
    got = centroids.cluster_vectors(vectors(spark, rows), s)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_clusters([r[:2] for r in rows], s)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_clusters_of_odd_vectors(spark, n):
    whole = [[1.0, -2.5], [0.0, 0.0], [100.0, 7.0]][:n]
    rows = [(i, v, None, None, None) for i, v in enumerate(whole)]
    rows += [(None, whole[0], 1, "a", 2)] if n else []
    rows += [(90, None, 1, "a", 2), (91, [], 1, "a", 2), (92, [1.0], 1, "a", 2), (93, [1.0, None], 1, "a", 2), (94, [1.0, math.nan], 1, "a", 2), (95, [math.inf, 1.0], 1, "a", 2), (96, [1.0, 2.0, 3.0], 1, "a", 2)]
    s = centroids.Settings(dims=2, clusters=8, rounds=3)
    assert sorted(map(tuple, centroids.cluster_vectors(vectors(spark, rows), s).collect()), key=repr) == plain_clusters([r[:2] for r in rows], s)


def test_clusters_refuse_what_no_long_holds(spark):
    with pytest.raises(Exception, match="or more in size"):
        centroids.cluster_vectors(vectors(spark, [(1, [1e9, 0.0], 1, "a", 1)]), centroids.Settings(dims=2)).collect()


def test_nodes_are_settled_whole_and_exactly():
    """Far groups leave trees at their upper nodes; ties keep the smaller cluster."""
    s = centroids.Settings(dims=3, leaf=8)
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(0, 5, (300, 3)), rng.integers(1000, 1005, (300, 3))])
    order, lows, highs, sums = centroids.planted(v, s.leaf)
    tree = centroids.Tree(list(order), v[order], lows, highs, sums)
    cs = np.array([[2, 2, 2], [1002, 1002, 1002], [2, 2, 2]])
    settled, places, _ = centroids.filtered(tree, cs[:2], s)
    assert not len(places) and sum(n for _, _, n in settled) == 600 and len(settled) == 2
    apart = ((v[order][:, None] - cs[None]) ** 2).sum(axis=2)
    assert (centroids.labels(tree, cs, s) == apart.argmin(axis=1)).all()
    assert (sums[0] == v.sum(axis=0)).all()


# ---- tries


def plain_trie(rows):
    """rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, t in made.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    ends = lambda p: ",".join(map(str, sorted(c for c in members[p] if made[c] == p)))
    return sorted([(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items()], key=repr)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, n long, name string, depth int").repartition(3)


def talk(seed, convs=60):
    rng = random.Random(seed)
    say = [f"{rng.choice(['hi', 'né', 'so', ''])} {i % 4}" for i in range(9)]
    rows = []
    for c in range(-7, convs):
        if rng.random() < 0.9:
            rows += [(c * rng.choice([1, 1, 3]), t, rng.choice(["user", None]), rng.choice(say)) for t in range(rng.randint(1, 14))]
    copy = [(t, "user", f"turn {t}") for t in range(23)]
    for c in range(500, 540):  # one long conversation, many times, some cut short
        rows += [(c, *t) for t in copy[: 23 if c % 3 else 11]]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    rows = talk(seed)
    assert sorted(map(tuple, trie.trie_of_rebuilt(conversations(spark, rows)).collect()), key=repr) == plain_trie(rows)


def test_trie_of_odd_conversations(spark):
    rows = [(None, 1, "user", "lost"), (1, None, None, None), (1, None, "a", "b"), (1, 3, "a", "b"), (1, 3, "a", "b"), (1, 3, "a", None), (2, 0, "", ""), (7, 1, "x", "w " * 90_000), (9, 5, "user", "only"), (-4, 1, "a", "b"), (10, 1, "q", "r"), (11, 1, "q", "r"), (12, 2, "q", "r"), (14, 0, "q", "r")]
    assert sorted(map(tuple, trie.trie_of_rebuilt(conversations(spark, rows)).collect()), key=repr) == plain_trie(rows)
    assert trie.trie_of_rebuilt(conversations(spark, rows).limit(0)).count() == 0


def test_trie_members(spark):
    turns = trie.placed_turns(conversations(spark, talk(4, 20)))
    lengths = turns.groupBy("conv").agg(F.count("pos").alias("n"))
    members = trie.prefix_trie(lengths, turns, with_members=True)
    nodes = {(r.conv_id, r.depth): r.n_convs for r in trie.prefix_trie(lengths, turns).collect()}
    counted = members.groupBy("conv_id", "depth").count().collect()
    assert {(r.conv_id, r.depth): r["count"] for r in counted} == {k: n for k, n in nodes.items() if k[1]}


def test_ends_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 4)
    rows = [(c * 1000, 0, "u", "same") for c in range(50)] + [(c * 1000 + 5, 0, "u", "same") for c in range(0, 50, 7)]
    assert sorted(map(tuple, trie.trie_of_rebuilt(conversations(spark, rows)).collect()), key=repr) == plain_trie(rows)


def test_dense_names_of_a_hot_key(spark):
    rows = [(i, 7 if i % 3 else i) for i in range(3000)]
    got = trie.dense_names(spark.createDataFrame(rows, "id long, k long").repartition(6), ["k"], ["id"]).collect()
    names = defaultdict(set)
    for r in got:
        names[dict(rows)[r.id]].add(r.name)
    assert len(got) == 3000 and all(len(n) == 1 for n in names.values())
    assert sorted(n for s in names.values() for n in s) == list(range(len(names)))


# ---- pages

FRAME = """<!doctype html><html><head><title>Site</title><style>p{}</style><script>var x = "<p>no</p>";</script></head><body class="has-sidebar no-comments">
<header><h1>My Site</h1><p>The best site there is on the whole web, says everyone who has been here.</p></header>
<nav><ul><li><a href="/">Home</a><li><a href="/b">A rather long label of a menu entry that says much</a></ul></nav>
%s
<footer><p>All rights reserved by the owners of this site, in all countries, for all times.</p></footer></body></html>"""
ARTICLE = "<h1>The title</h1><p>First paragraph, of <b>some</b> length, with&nbsp;an &amp; and a&#x2014;dash.<p>Short.<p>Line one<br>line   two\n of it.</p><ul><li>an item<li>another <a href=x>linked</a> one</ul><script>track('</p>')</script><blockquote>Quoted words.</blockquote>"
WANTED = "The title\nFirst paragraph, of some length, with an & and a—dash.\nShort.\nLine one line two of it.\nan item\nanother linked one\nQuoted words."


@pytest.mark.parametrize(
    "body",
    [
        f"<article>{ARTICLE}</article>",
        f"<main><article><header></header>{ARTICLE}<footer>By someone, with a long note on who that is and what else they wrote.</footer></article><aside><p>Other things that you could read as well, if you had the time to do so.</p></aside></main>",
        f"<div class='ad'>Buy this now, it is cheap and good and you will not regret it at all, we say.</div><div id='content'>{ARTICLE}<form><p>Sign up for the letter that we send <input><button>Go</button></form></div><div class='cookie-notice'><p>We use cookies for many purposes that we list on a page.</p></div>",
        f"<div class='sidebar'><p>Sidebar text that goes on for quite a while, so that its ratio is high too.</p></div><article>{ARTICLE}</article><section id='comments'><article class='comment'><p>I do not agree with anything said above, and here is why, in many words.</p></article></section>",
        f"<div class='wrap with-sidebar'><div class='advert'><div>Nested adverts, with words and words and words and words.</div></div><div class='post'>{ARTICLE}</div></div>",
        f"<div class='widget-area'><main>{ARTICLE}</main></div>",
    ],
)
def test_main_text(body):
    assert extract.main_text(FRAME % body) == WANTED
    assert extract.main_text((FRAME % body).replace("</html>", "").replace("</body>", "")) == WANTED


def test_extraction_of_odd_pages(spark):
    html = [None, "", " ", "plain words", "<p>one<p>two", "<article>", "<div class=ad>only this</div>", "<![weird[x]]><p>a &amp;amp; &#xD800; &nosuch;</p><!-- open", "<p>" + "long " * 200_000, "<div>" * 3000 + "deep", "</div></p>" * 50 + "x", "<script>var a;", "<p>same</p>", "<p>same</p>"]
    rows = [(i, f"u{i}", h, "t", 1) for i, h in enumerate(html)] + [(None, None, "<p>no id</p>", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(2)
    got = {r.page_id: r for r in extract.extract_pages(pages).collect()}
    assert len(got) == len(rows)
    want = {0: "", 1: "", 2: "", 3: "plain words", 4: "one\ntwo", 5: "", 6: "", 7: "a &amp; � &nosuch;", 8: ("long " * 200_000).strip(), 9: "deep", 10: "x", 11: "", 12: "same", 13: "same", None: "no id"}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert extract.extract_pages(pages.limit(0)).count() == 0


def test_ratios_are_smoothed_and_parted():
    even = np.ones(9)
    assert np.allclose(extract.smoothed(even, 1.0), even)
    assert extract.smoothed(np.array([0, 0, 9.0, 0, 0]), 1.0).argmax() == 2
    assert 1 < extract.threshold(np.array([0.0, 1, 0, 9, 10, 11])) < 9
