"""Quality, fingerprints, neighbours, shards, mixtures, pieces and the pipeline."""

import hashlib
import math
import struct
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from webloom.llm import mixing, neighbours, pieces, quality, shards, simhash
from webloom.llm import queries as registered

SF = "/root/testdata/sf0.01"


# ---- quality


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.score_documents(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    assert quality.score_documents(odd, labels).count() == odd.count()
    assert quality.score_documents(none, labels).count() == 0
    scores = {r["score"] for r in quality.score_documents(odd, labels.limit(0)).collect()}
    assert scores == {0.5}  # nothing to learn from


def test_quality_learns_from_few_labels(spark):
    """Four labels of each kind are learned from, as many are; so is one of each."""
    good, bad = "the quick brown fox runs over the lazy dog and sleeps", "zz## 11 $$ qq## 99 %% xx"
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame([(i, f"{good if i % 2 else bad} {i}") for i in range(60)], "doc_id long, text string")
    for chosen in ([i for i in ids if i % 2][:4] + [i for i in ids if not i % 2][:4], [next(i for i in ids if i % 2), next(i for i in ids if not i % 2)]):
        labels = spark.createDataFrame([(i, i % 2) for i in chosen], "doc_id long, quality int")
        rows = quality.score_documents(docs, labels).collect()
        assert all(r["predicted"] == r["doc_id"] % 2 for r in rows) and len({r["score"] for r in rows}) > 2


def test_temperature():
    rng = np.random.default_rng(3)
    logits = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-logits))).astype(float)
    assert abs(quality.calibrated(logits * 3, y) - 3) < 0.4


# ---- fingerprints


def by_hand(text):
    words = [w for w in text.translate(str.maketrans(dict.fromkeys("\t\n\x0b\f\r", " "))).split(" ") if w]
    return list(zip(words, words[1:], strict=False)) if len(words) > 1 else [(w,) for w in words]


def test_fingerprints(spark, odd, none):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.select("doc_id", "text").collect()]
    got = simhash.fingerprint_documents(odd)
    found = got.collect()
    assert len(found) == len(rows) and Counter((r["doc_id"], r["n_chars"]) for r in found) == Counter((i, len(t)) for i, t in rows)
    ordered = sorted(rows, key=lambda r: hashlib.md5(r[1].encode()).hexdigest())
    ordered = sorted(ordered, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = Counter()
    for k, (i, t) in enumerate(ordered):
        n, after = len(t) // 3, ordered[(k + 1) % len(ordered)][1]
        want[i, hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in found) == want
    prints = {}
    for r in found:
        if r["doc_id"] == 9 and r["n_chars"] == 189:
            prints.setdefault("same", set()).add(r["fingerprint"])
    assert len(prints["same"]) == 1 and simhash.fingerprint_documents(none).count() == 0
    one = simhash.fingerprint_documents(odd.filter("doc_id = 6")).first()
    assert one["near_next"] == 1.0


def plain_print(text):
    """The fingerprint from its terms one by one: a bit is set if at least half of them vote for it."""
    terms = Counter(by_hand(text))
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def hashed(words):  # Spark's xxhash64 of several columns: each seeds the next
        seed = 42
        for w in words:
            seed = xxhash.xxh64_intdigest(w.encode() if isinstance(w, str) else struct.pack("<q", signed(w)), seed)
        return seed

    votes, n = [0] * 128, sum(terms.values())
    for term, times in terms.items():
        first = hashed(term)
        for s, h in enumerate((first, hashed(("b", first)))):
            for i in range(64):
                votes[64 * s + i] += times * (h >> i & 1)
    bits = [n > 0 and 2 * v >= n for v in votes]
    return "".join(f"{sum(b << i for i, b in enumerate(bits[64 * s : 64 * s + 64])):016x}" for s in range(2))


def test_fingerprints_against_plain_ones(spark, corpus):
    """Fingerprints of texts and edited texts, and both likenesses, by hand."""
    found = simhash.fingerprint_documents(corpus).collect()
    ordered = sorted(((r["doc_id"], r["text"] or "") for r in corpus.collect()), key=lambda r: (-r[0], hashlib.md5(r[1].encode()).hexdigest()))
    likeness = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
    want = {}
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        a, b, c = plain_print(t), plain_print(edited), plain_print(after)
        want[i] = (a, b, likeness(a, b), likeness(a, c))
    assert {r["doc_id"]: (r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in found} == want


@pytest.mark.parametrize("radius", [3, 7])
def test_fingerprints_within_the_radius(corpus, radius):
    rows = simhash.fingerprint_documents(corpus, radius=radius, every=2).collect()
    prints = {int(r["fingerprint"], 16) for r in rows}
    near = lambda a: sum((a ^ b).bit_count() <= radius for b in prints) - 1
    asked = [r for r in rows if r["doc_id"] % 2 == 0]
    assert all(r["n_within"] == near(int(r["fingerprint"], 16)) for r in asked) 
    assert radius == 3 or sum(r["n_within"] for r in asked) > 0
    assert all(r["n_within"] is None for r in rows if r["doc_id"] % 2)


@pytest.mark.parametrize("kind", ["far", "null", "one"])
def test_next_rows_whatever_the_ids(spark, kind):
    """An id far from the others, half of the ids null, or half of them one id: no bucket grows, and the order holds."""
    texts = [f"text {k * 7919 % 3001} of many" for k in range(3000)]
    ids = {"far": lambda k: 1 << 60 if k == 5 else k, "null": lambda k: None if k % 2 else k, "one": lambda k: 77 if k % 2 else k}[kind]
    rows = [(ids(k), t) for k, t in enumerate(texts)]
    df = simhash.with_next(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", per_bucket=50, ranges=16)
    got = df.filter("_guest = 0").collect()
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    assert {(r["doc_id"], r["text"], r["next_text"]) for r in got} == {(*r, ordered[(k + 1) % len(ordered)][1]) for k, r in enumerate(ordered)}
    assert len(got) == 3000 and max(Counter(r["_bucket"] for r in got).values()) <= 200


def test_fingerprint_of_one_word_many_times(spark):
    """All terms of a run vote alike, in the top lane too; the fingerprint is that of the term."""
    texts = [" ".join(w for _ in range(40_000)) for w in ("aa", "ab", "ac", "ad")] + [f"{w} {w}" for w in ("aa", "ab", "ac", "ad")]
    rows = simhash.fingerprint_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert all(prints[k] == prints[k + 4] for k in range(4)) and len(set(prints.values())) == 4


def test_likeness_follows_edits(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars > 600")
    rows = simhash.fingerprint_documents(docs).collect()
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows]) > 0.97
    assert abs(np.mean([r["near_next"] for r in rows]) - 0.5) < 0.03


def test_radius_search_finds_all(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, (40, 2))
    rows = [tuple(map(int, b)) for b in base]
    for b in base:
        for flips in range(1, 6):
            x = [int(v) for v in b]
            for bit in rng.choice(128, flips, replace=False):
                v = (x[bit // 64] & ((1 << 64) - 1)) ^ (1 << (int(bit) % 64))
                x[bit // 64] = v - (1 << 64) if v >> 63 else v
            rows.append(tuple(x))
    df = spark.createDataFrame(rows, "fp0 long, fp1 long")
    far = lambda a, b: sum(((x ^ y) & ((1 << 64) - 1)).bit_count() for x, y in zip(a, b, strict=True))
    for radius in (3, 5):
        want = {(*a, *b, far(a, b)) for a in set(rows) for b in set(rows) if far(a, b) <= radius}
        assert {tuple(r) for r in simhash.within(df, df, radius).select("fp0", "fp1", "near0", "near1", "bits").collect()} == want


# ---- neighbours


def exact(rows, asked, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for i, v in asked:
        s = x @ np.array(v)
        s[ids == i] = -np.inf
        out[i] = ids[np.lexsort((ids, -s))[:k]].tolist()
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 24)) * rng.uniform(0.5, 2, (3000, 1))
    x[100:1100] = x[100]  # a third of the rows are one vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, scores = {}, {}
    for r in neighbours.nearest_of_table(df, 20, 10, neighbours.Settings(shelf_rows=300)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        scores[r["query_id"], r["vec_id"]] = r["score"]
    want = exact(rows, [r for r in rows if r[0] % 20 == 0], 10)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    distance = lambda i: sorted((float(np.dot(x[i], x[j])) for j in want[i]), reverse=True)
    near = np.mean([sum(a >= distance(i)[-1] - 1e-9 for a in (scores[i, j] for j in own)) / 10 for i, own in got.items()])
    assert near >= 0.9
    assert all(abs(s - np.dot(x[i], x[j])) < 1e-9 for (i, j), s in scores.items())


def test_neighbours_do_not_depend_on_parts(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(2000, 8)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole, parted = (listed(neighbours.nearest_of_table(df, 5, 10, neighbours.Settings(shelf_rows=200, query_rows=q)).collect()) for q in (16_384, 30))
    assert len(whole) == 400 and whole == parted


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [0.5, 0.5]), (7, [0.5, 0.5]), (40, None), (60, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("_id", F.lit(1)).withColumn("rank", F.lit("x"))
    got = [tuple(r) for r in neighbours.nearest_of_table(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 6, 0.5), (0, 2, 7, 0.5), (0, 3, 20, 0.0), (20, 1, 6, 0.5), (20, 2, 7, 0.5), (20, 3, 0, 0.0)]
    assert neighbours.nearest_of_table(df.filter("vec_id = 2")).count() == 0


def listed(rows):
    out = {}
    for r in rows:
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {i: sorted(v) for i, v in out.items()}


def test_neighbours_of_repeated_queries(spark):
    """A query row that occurs twice has its whole result twice; rows of its id are no candidates of either."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(60, 4)))]
    once = listed(neighbours.nearest_of_table(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 5).collect())
    twice = listed(neighbours.nearest_of_table(spark.createDataFrame([*rows, rows[20]], "vec_id long, embedding array<double>"), 20, 5).collect())
    assert twice[20] == sorted(once[20] * 2) and [r[0] for r in once[20]] == [1, 2, 3, 4, 5]
    # Its id fills all lists it probes: it reads every list, and finds all there are.
    hot = [(20, [1.0, 0.001 * i]) for i in range(900)] + [(i, [-1.0, 0.1 * i]) for i in range(1, 4)]
    got = neighbours.nearest_of_table(spark.createDataFrame(hot, "vec_id long, embedding array<double>"), 20, 3, neighbours.Settings(least_probed=1))
    assert got.count() == 2700 and set(got.select("rank", "vec_id").distinct().toPandas()["vec_id"]) == {1, 2, 3}


def test_neighbours_of_extreme_vectors(spark):
    """Lengths whose squares are beyond doubles; vectors of another length take no part."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 6))
    plain = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    more = spark.createDataFrame([(1001, [1e200, 0.0, 0.0, 0.0, 0.0, 0.0]), (1002, [1.0, 2.0]), (1020, [1.0] * 7), (1003, [-1e300] * 6)], plain.schema)
    got = listed(neighbours.nearest_of_table(plain.unionByName(more), 20, 6).collect())
    want = exact([(i, r) for i, r in enumerate(x)] + [(1001, [1e200, 0, 0, 0, 0, 0]), (1003, [-1e300] * 6)], [(i, x[i]) for i in range(0, 200, 20)], 6)
    assert {i: [r[1] for r in v] for i, v in got.items()} == want
    small = plain.withColumn("embedding", F.transform("embedding", lambda v: v * 1e-200))
    assert neighbours.nearest_of_table(small, 20, 6).count() == 60


def test_recall_on_the_table(spark):
    """Against brute force, on vectors that hardly cluster."""
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF.replace('0.01', '0.1')}/embeddings.parquet").collect()]
    want = exact(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = listed(neighbours.nearest_of_table(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert np.mean([len({r[1] for r in got[i]} & set(want[i])) / 20 for i in want]) >= 0.93


def test_probes_follow_the_vectors():
    """Vectors in clusters need few lists; those without, many."""
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(40, 16)) * 5
    tight = middle[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 16)) * 0.1
    loose = rng.normal(size=(2000, 16))
    probed = [neighbours.probes_for(x[:300], x, neighbours.centroids_of(x, 60, 6, rng), 10, 0.95) for x in (tight, loose)]
    assert probed[0] <= 6 < 12 < probed[1]


# ---- shards


def test_shards(spark, corpus):
    docs = corpus.unionByName(spark.createDataFrame([(5000 + i, "one text that many rows share " * 3, "en", "s", 1) for i in range(300)], corpus.schema))
    rows = shards.shard_documents(docs, 8).collect()
    assert len(rows) == docs.count()
    sizes, slots, groups = Counter(), {}, {}
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        groups.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(sizes) == set(range(8))
    assert max(sizes.values()) < 1.15 * min(sizes.values())
    assert sum(len(g) > 1 for g in groups.values()) <= 2  # only the large group, and at most one at a boundary
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert all(r["size"] == len(texts[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) for r in rows)
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}


def test_shards_of_odd_rows(odd, none, tmp_path):
    assert shards.shard_documents(odd).count() == odd.count() and shards.shard_documents(none).count() == 0
    shards.write_shards(odd.select("doc_id", "text"), str(tmp_path / "out"), 3)
    assert odd.sparkSession.read.parquet(str(tmp_path / "out")).count() == odd.count()


def test_written_shards_are_those_assigned(spark, odd, tmp_path):
    """Ids that are null, texts that repeat without end, and clashing columns are dealt out as shard_documents does."""
    many = spark.createDataFrame([(None, "one text of many rows", "en")] * 3000 + [(i, f"text {i} " * (i % 50), "de") for i in range(500)], "doc_id long, text string, key string")
    for n, docs in enumerate((many, odd)):
        shards.write_shards(docs, str(tmp_path / str(n)), 8)
        written = spark.read.parquet(str(tmp_path / str(n)))
        assert set(docs.columns) <= set(written.columns) | {"shard", "slot"}
        crc = lambda t: zlib.crc32((t or "").encode())
        own = sorted((repr(r["doc_id"]), crc(r["text"]), r["shard"], r["slot"]) for r in written.collect())
        assert own == sorted((repr(r["doc_id"]), r["text_crc32"], r["shard"], r["slot"]) for r in shards.shard_documents(docs, 8).collect())
    sizes = spark.read.parquet(str(tmp_path / "0")).groupBy("shard").agg(F.sum(F.octet_length("text") + 16).alias("s")).collect()
    assert len(sizes) == 8 and max(r["s"] for r in sizes) < 1.1 * min(r["s"] for r in sizes)


def test_splitters_keep_groups_whole():
    g = [a << shards.LOW for a in range(4)]
    assert shards.splitters([g[0] + 5, g[1] + 7, g[2] + 1, g[2] + 9, g[2] + 99]) == [g[0], g[1], g[2], g[2] + 9, g[2] + 99]


# ---- mixtures


def test_targets():
    assert mixing.reshared([100, 100, 100], [5, 2, 1], Fraction(3, 2), 2) == [200.0, 500 / 3, 250 / 3]
    assert mixing.reshared([0, 10], [5, 2], Fraction(3, 2), 2) == [0.0, 15.0]
    t = mixing.reshared([3, 500, 40, 7], [5, 2, 1, 5], Fraction(3, 2), 2)
    assert abs(sum(t) - 825) < 1e-9 and t[0] == 6.0


def test_splitting_tree_is_hypergeometric():
    rng, n = np.random.default_rng(1), np.array([40, 24, 0, 16])
    leaves = [mixing.split(n, 8, rng) for _ in range(3000)]
    assert all((np.sum(x, 0) == n).all() and all(y.sum() == 10 for y in x) for x in leaves)
    first = np.array([x[0][0] for x in leaves])
    assert abs(first.mean() - 5) < 0.1 and abs(first.var() - 10 * 0.5 * 0.5 * 70 / 79) < 0.2


def test_large_draws_follow_the_law():
    """Inversion gives the law of numpy's draws, and what is known of counts beyond its range."""
    rng = np.random.default_rng(2)
    own, numpys = np.array([mixing.inverted(rng, 300, 500, 160) for _ in range(20_000)]), rng.hypergeometric(300, 500, 160, 20_000)
    for k in range(45, 76):
        assert abs(np.mean(own <= k) - np.mean(numpys <= k)) < 0.02
    big = np.array([mixing.hypergeometric(rng, 3 * 10**9, 5 * 10**9, 10**9) for _ in range(60)])
    sd = (10**9 * 0.375 * 0.625 * 7 / 8) ** 0.5
    assert abs(big.mean() - 375_000_000) < 5 * sd / 60**0.5 and 0.6 < big.std() / sd < 1.5


def plain_targets(sizes, weights, share, most):
    """Water-filling in small steps of the definition: reshare until none is above its cap."""
    fixed, whole = {}, share * sum(sizes)
    while True:
        free = [k for k in range(len(sizes)) if k not in fixed]
        rest = whole - sum(fixed.values())
        offer = {k: rest * weights[k] / sum(weights[j] for j in free) for k in free}
        full = {k: most * sizes[k] for k in free if offer[k] > most * sizes[k]}
        if not full:
            return [float(fixed.get(k, offer.get(k))) for k in range(len(sizes))]
        fixed |= full


def test_rows_without_ids_are_mixed_and_dealt_alone(spark):
    """Half of the rows have no id, a third are one row: blocks and ranges stay small, targets and sizes are met."""
    rows = [(None if k % 2 else k, f"word {'more ' * (k % 5)}{k if k % 3 else 1}", f"s{k % 2}") for k in range(3000)] + [(9, "one row many times", "s1")] * 1500
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    found = mixing.mix_documents(docs, block_rows=32).collect()
    sizes = [sum(len(t.split()) for _, t, s in rows if s == x) for x in ("s0", "s1")]
    targets = plain_targets(sizes, [5, 2], Fraction(3, 2), 2)
    for x, target in zip((0, 1), targets, strict=True):
        own = [r for r in found if r["source_size"] == sizes[x] and r["target"] == target]
        assert abs(sum(r["taken"] for r in own) - target) <= 8
    again = mixing.mix_documents(docs.repartition(3), block_rows=32).collect()
    assert Counter(map(repr, found)) == Counter(map(repr, again))
    dealt = Counter()
    for r in shards.shard_documents(docs, 8).collect():
        dealt[r["shard"]] += r["size"]
    assert max(dealt.values()) < 1.1 * min(dealt.values())


def test_mixing(spark, corpus, odd, none):
    rows = mixing.mix_documents(corpus, block_rows=8).join(corpus.select("doc_id", "source", "text"), "doc_id").collect()
    assert len(rows) == corpus.count()
    sums, size = Counter(), Counter()
    for r in rows:
        assert r["size"] == len((r["text"] or "").split()) and 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * len(r["mix_shards"])
        sums[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
    assert all(r["source_size"] == size[r["source"]] for r in rows)
    target = {r["source"]: r["target"] for r in rows}
    assert target == dict(zip(sorted(size), plain_targets([size[s] for s in sorted(size)], [5, 2, 1, 5], Fraction(3, 2), 2), strict=True))
    assert all(abs(sums[s] - target[s]) <= max(r["size"] for r in rows) for s in size)
    assert sorted(map(tuple, ((r["doc_id"], r["taken"]) for r in mixing.mix_documents(corpus, block_rows=8).collect()))) == sorted((r["doc_id"], r["taken"]) for r in rows)
    assert mixing.mix_documents(odd).count() == odd.count() and mixing.mix_documents(none).count() == 0
    whole = mixing.mixed_rows(odd)
    assert set(whole.columns) == {*odd.columns, "mix_shard"} and whole.count() > 0 and mixing.mixed_rows(none).count() == 0


# ---- pieces


def test_pieces_round_trip(odd, none):
    rows = pieces.encode_texts(odd, with_ids=True)
    found = rows.collect()
    assert len(found) == odd.count() and all(r["round_trip"] for r in found)
    assert all(len(set(r["sample_sha256"])) == len(r["sample_sha256"]) <= 2 for r in found)
    assert all(len(r["sample_sha256"]) == 0 for r in found if r["n_pieces"] == 0)
    back = pieces.decode_ids(rows.select("doc_id", "ids")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((r["doc_id"], r["text"] or "") for r in odd.select("doc_id", "text").collect())
    samples = pieces.decode_ids(rows.select("doc_id", F.explode("sample_ids").alias("ids"))).collect()
    texts = {(r["doc_id"], r["text"]) for r in odd.collect()}
    assert samples and all((r["doc_id"], r["text"]) in texts for r in samples)
    assert pieces.encode_texts(none).count() == 0


def ways(text, ids, weight):
    """All segmentations of a text into pieces with their log-weights."""
    if not text:
        return {(): 0.0}
    heads = [text[:k] for k in range(1, len(text) + 1) if text[:k] in ids]
    return {(ids[x], *path): weight[x] + p for x in heads for path, p in ways(text[len(x) :], ids, weight).items()}


def test_pieces_are_drawn_from_the_whole_lattice():
    s = pieces.Settings(samples=3, ahead=2)
    lattice = pieces.lattice(pieces.model_bytes(s.model), s)
    ids, weight = pieces.vocabulary(lattice.processor, s)
    for text in ("Hello", "of a Cat", "a"):
        every = ways("\u2581" + text.replace(" ", "\u2581"), ids, weight)
        whole = np.logaddexp.reduce(list(every.values()))
        chance = {path: math.exp(p - whole) for path, p in every.items()}
        given = np.array(lattice.processor.encode(text), np.int32)
        first, second, n = Counter(), Counter(), 4000
        for key in range(n):
            found, _ = lattice.sample(given, key)
            drawn = [tuple(x.tolist()) for x, _ in found]
            assert len(set(drawn)) == min(3, len(chance))
            assert all(abs(math.exp(p) - chance[x]) < 1e-9 for x, (_, p) in zip(drawn, found, strict=True))
            first[drawn[0]] += 1
            second[drawn[1]] += 1
        then = {b: sum(pa * pb / (1 - pa) for a, pa in chance.items() if a != b) for b, pb in chance.items()}
        for path in sorted(chance, key=chance.get)[-5:]:
            assert abs(first[path] / n - chance[path]) < 5 * (0.25 / n) ** 0.5
            assert abs(second[path] / n - then[path]) < 5 * (0.25 / n) ** 0.5


def test_inclusion_scores(spark):
    """Through the query: chances are the lattice's, and sampled chances by their inclusion add up to one on average."""
    s, text, n = pieces.Settings(), "of a Cat", 3000
    own = pieces.lattice(pieces.model_bytes(s.model), s)
    every = ways("\u2581" + text.replace(" ", "\u2581"), *pieces.vocabulary(own.processor, s))
    whole = np.logaddexp.reduce(list(every.values()))
    rows = pieces.encode_texts(spark.range(n).select(F.col("id").alias("doc_id"), F.lit(text).alias("text")), s, with_ids=True).collect()
    sums = []
    for r in rows:
        chance, kept = np.exp(r["sample_log_prob"]), np.exp(r["sample_log_inclusion"])
        assert np.allclose(chance, [math.exp(every[tuple(x)] - whole) for x in r["sample_ids"]])
        assert (kept > 0).all() and (kept <= 1).all()
        sums.append(float((chance / kept).sum()))
    assert len(rows) == n and abs(np.mean(sums) - 1) < 5 * np.std(sums) / n**0.5
    # A text with no more segmentations than asked for has them all for sure.
    (both,) = pieces.encode_texts(spark.createDataFrame([(1, "a")], "doc_id long, text string"), s).collect()
    assert both["sample_log_inclusion"] == [0.0, 0.0]


def test_pieces_do_not_depend_on_other_texts():
    s = pieces.Settings()
    lattice = pieces.Lattice(pieces.model_bytes(s.model), s)
    texts = ["Hello there", "", "=-" * 700, "é日\u0000\U0001f600 x" * 30, "Hello again", "ab " * 900]
    shown = lambda rows: [(k, [(x.tolist(), p) for x, p in found], after) for k, _, _, (found, after) in rows]
    together = shown(pieces.sampled_texts(lattice, list(range(6)), texts))
    lattice.s = pieces.Settings(kept=-1)  # all anew for each
    alone = [x for k, t in enumerate(texts) for x in shown(pieces.sampled_texts(lattice, [k], [t]))]
    assert together == alone and [len(x[1]) for x in alone] == [2, 0, 2, 2, 2, 2]


# ---- pipeline and registry


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in registered.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(registered.ORACLES) <= set(registered.QUERIES)


def test_pipeline(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = set(docs.columns), []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert set(docs.columns) == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        rows.append(docs.count())
    assert rows[0] < 1000 and rows[1] == rows[0] and rows[2] < rows[1]
    out = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert out.count() == rows[3] and out.filter("NOT round_trip").count() == 0
    twice = docs.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert twice == 2


def test_near_stage_goes_by_row(spark, corpus):
    """Each group leaves one row, whatever ids its rows share, and rows without words stay."""
    a = "the quick brown fox jumps over the lazy dog and then runs far away into the deep dark wood behind the old mill"
    rows = [(5, a, "s1"), (9, a + " again", "s1"), (9, "another text that has nothing to do with the others at all", "s2"), (None, a + " once", "s3")]
    rows += [(None, "a text without an id that stands alone in this small table", "s1"), (7, "", "s1"), (7, "", "s1"), (8, None, "s2"), (3, "twice the same row here in full", "s9"), (3, "twice the same row here in full", "s2")]
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for parts in (1, 4):
        got = Counter(tuple(r) for r in stage(spark, docs.repartition(parts), SF).collect())
        assert got == Counter([rows[0], rows[2], *rows[4:9]])  # of the last two, always the same
    # Against brute force: the smallest id of each group, for sets of five words alike by 0.8.
    own = [(r["doc_id"], r["text"] or "") for r in corpus.collect()]
    sets = []
    for _, t in own:
        w = t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    low = list(range(len(own)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]) and low[i] != low[j]:
                low = [min(low[i], low[j]) if k in (low[i], low[j]) else k for k in low]
    want = {min(own[i][0] for i in range(len(own)) if low[i] == k) for k in set(low)}
    assert {r["doc_id"] for r in stage(spark, corpus, SF).collect()} == want


def test_stages_against_plain_versions(spark, odd):
    """Of the odd rows: scores decide the first stage; lines and mixing do what their operators' tests check, row by row."""
    stages = dict(corpus_pipeline.STAGES)
    count = lambda df: Counter(repr((r["doc_id"], r["text"])) for r in df.collect())
    docs, labels = odd.filter("doc_id IS NULL OR doc_id < 6"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality.with_score(docs.select("doc_id", "text"), quality.fit_on(docs, labels))
    assert count(stages["quality"](spark, docs, SF)) == count(scored.filter("score >= 0.5"))
    thrice = ["this line is in three documents", "short", "a line in one document only"]
    lines_ = spark.createDataFrame([(1, thrice[0] + "\nown one", 7), (2, thrice[0].upper(), 7), (None, thrice[0], 7), (4, "\n".join(thrice), 7)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in stages["line_dedup"](spark, lines_, SF).collect()}
    assert got == {1: ("own one", 7), 2: ("", 0), None: ("", 0), 4: ("\n".join(thrice), 65)}
    mixed = count(stages["mixing"](spark, odd, SF))
    taken = mixing.mix(odd.select("doc_id", "text", F.xxhash64("doc_id", "source", "text").alias("_row"), F.col("source").alias("_source"), mixing.words("text").alias("_words")).groupBy("_row", "_source").agg(F.sum("_words").alias("_words"), F.count("*").alias("n"), F.first("doc_id").alias("doc_id"), F.first("text").alias("text")), source="_source", size="_words", ties=("_row",))
    want = Counter()
    for r in taken.collect():
        want[repr((r["doc_id"], r["text"]))] += r["n"] * r["copies"]
    assert mixed == +want and max(mixed.values()) >= 1


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_tables(spark, odd, none, k):
    stage = corpus_pipeline.STAGES[k][1]
    for df in (odd, none):
        out = stage(spark, df, SF)
        assert k == 4 or set(out.columns) == set(odd.columns)
        n = out.count()
        assert n == 0 if df is none else n == df.count() if k in (1, 4) else 0 < n <= 2 * df.count()
