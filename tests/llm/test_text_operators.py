"""Line dedup, repeated passages, near duplicates and secrets, each against a plain version of itself."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from webloom.llm import graphs, lines, near, passages, secrets
from webloom.llm.common import LOWER_BYTES, SPACE


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def listed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# ---- lines


def plain_lines(rows, least=20, docs=3):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(SPACE).translate(low)
    number = lambda i: -(1 << 70) if i is None else i
    held = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held[k].append(number(i))
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        stay = [x for x in own if len(key(x)) < least or len(held[key(x)]) < docs or number(i) == max(held[key(x)])]
        out.append((i, len(own), len(own) - len(stay), sha("\n".join(stay))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [20, 3])
def test_lines(corpus, odd, least):
    for df in (corpus, odd):
        got = lines.dedup_lines(df, least_chars=least, block_bytes=2000)
        assert listed(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == plain_lines([tuple(r) for r in df.select("doc_id", "text").collect()], least)


def test_lines_keep_columns(odd, none):
    got = lines.dedup_lines(odd, carry=["id", "block", "text"])
    assert got.count() == odd.count() and {"carried_id", "carried_block", "carried_text", "kept_text"} <= set(got.columns)
    assert lines.dedup_lines(none).count() == 0


def test_perfect_hash():
    import numpy as np

    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    index = lines.PerfectHash(keys)
    assert sorted(index.index(keys)) == list(range(len(keys)))
    assert lines.PerfectHash(keys[:0]).index(keys).max() == -1


# ---- passages


def plain_passages(rows, length):
    rows = [(i, (t or "").encode()) for i, t in rows]
    number = lambda i: 1 << 70 if i is None else i
    low = {}
    for i, t in rows:
        for p in range(len(t) - length + 1):
            low[t[p : p + length]] = min(number(i), low.get(t[p : p + length], 1 << 71))
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if low[t[p : p + length]] < number(i):
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(t), sum(gone), spans, sha(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("settings", [passages.Settings(block_bytes=3000, hot_blocks=2), passages.Settings(block_bytes=5000, slice_bytes=600), passages.Settings(length=24, gram=9, block_bytes=4000, hot_blocks=5)])
def test_passages(corpus, settings):
    got = passages.remove_passages(corpus, settings)
    assert listed(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain_passages([tuple(r) for r in corpus.select("doc_id", "text").collect()], settings.length)


def test_passages_of_odd_rows(odd, none):
    small = odd.filter("text IS NULL OR length(text) < 5000")
    got = passages.remove_passages(small, with_spans=True)
    assert listed(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain_passages([tuple(r) for r in small.select("doc_id", "text").collect()], 50)
    assert all(len(r["spans"]) == r["n_spans"] for r in got.collect())
    assert passages.remove_passages(odd).count() == odd.count() and passages.remove_passages(none).count() == 0


# ---- near duplicates


def plain_groups(rows, words, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().translate(LOWER_BYTES).split()
        sets.append((i, frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)]) if w else frozenset()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    low = defaultdict(list)
    for a, (i, _) in enumerate(sets):
        low[root(a)].append(i)
    out = []
    for a, (i, own) in enumerate(sets):
        ids = [x for x in low[root(a)] if x is not None]
        c = min(ids) if ids and own else i
        out.append((i, len(own), c, i == c))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near(corpus, odd, words, percent):
    for df in (corpus, odd):
        got = near.group_near(df, near.Settings(words=words, percent=percent))
        assert listed(got, "doc_id", "n_shingles", "component_id", "kept") == plain_groups([tuple(r) for r in df.select("doc_id", "text").collect()], words, percent)


def test_near_in_tiles(corpus):
    """Buckets and groups too large for a task, cut into pieces, give the same."""
    got = near.group_near(corpus, near.Settings(bucket_rows=2, tile_shingles=60))
    assert listed(got, "doc_id", "n_shingles", "component_id", "kept") == plain_groups([tuple(r) for r in corpus.select("doc_id", "text").collect()], 3, 85)


def test_near_of_nothing(none):
    assert near.group_near(none).count() == 0


def test_signatures_estimate_likeness():
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    for shared in (100, 300, 380):
        sets = [base, np.concatenate([base[:shared], rng.integers(0, 1 << 62, 400 - shared).astype(np.uint64)])]
        sig = near.signatures(np.concatenate(sets), np.repeat([0, 1], 400), 2, 240)
        assert abs((sig[0] == sig[1]).mean() - shared / (800 - shared)) < 0.12


def test_linked_nodes_share_a_leader():
    """Each text of a chain resembles the next, and is tied to a leader that the next is tied to; ties grow with the chain."""
    import numpy as np

    s = near.Settings()
    ties = []
    for n in (200, 800):
        sets = [near.stirred(np.arange(i * 10, i * 10 + 100, dtype=np.uint64), 1) for i in range(n)]
        sig = near.signatures(np.concatenate(sets), np.repeat(np.arange(n), 100), n, s.length)
        sketches = (near.stirred(sig, 9) >> np.uint64(56)).astype(np.uint8)
        a, b = near.tied(np.zeros(n, int), np.arange(n), sketches, s.far)
        ties.append(len(a))
        leaders = {}
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            leaders.setdefault(x, set()).add(y)
        assert all(leaders[i] & leaders[i + 1] for i in range(n - 1))
    assert ties[1] < 4.5 * ties[0] and ties[1] < 8 * 800


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = dict(map(tuple, graphs.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()))
    assert all(got.get(x, x) == root(x) for x in parent)
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- secrets

BASE = {
    "assign": re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}


def plain_secrets(text):
    out = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in p.finditer(text):
            if (kind == "assign" and len(m[1]) >= 12) or (kind == "access" and len(m[0]) >= 18) or (kind == "hex" and len(m[0]) >= 16):
                out.append((m.start(), k, kind, m.end()))
    return sorted(out)


def test_secrets(spark, odd, none):
    rng = random.Random(1)
    parts = ["password", "PassWd", "secret", "token", "api_key", "apikey", " ", "=", ":", "'", '"', "AKIA", "ABC123XYZ", "0123456789abcdef", "deadbeef", "xyz", "é", "日", "\n", "abcdefghijkl", "-", "A", "f"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    want = []
    for i, t in rows:
        own = plain_secrets(t or "")
        want.append((i, *(sum(x[2] == k for x in own) for k in BASE), sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in own))))
    got = secrets.scan_secrets(df)
    assert listed(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want, key=repr)
    assert sum(w[1] + w[2] + w[3] for w in want) > 500 and secrets.scan_secrets(none).count() == 0


FURTHER = {
    "forge": r"gh[pousr]_([A-Za-z0-9]+)",
    "chat": r"xox[abprs]-([A-Za-z0-9-]+)",
    "cloud": r"AIza([A-Za-z0-9_-]+)",
    "jwt": r"eyJ([A-Za-z0-9_.-]+)",
    "key": r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----([A-Za-z0-9+/=\n\r]+)",
}


def test_further_rules(spark):
    token = "ghp_" + "a1B2" * 9
    got = secrets.scan_secrets(spark.createDataFrame([(1, f"é {token}")], "doc_id long, text string")).first()
    assert got["spans"] == "forge:2:42" and got["base_sha256"] == sha("")

    least = {r.kind: r.least for r in secrets.RULES}
    rng = random.Random(2)
    parts = ["ghp_", "ghs_", "xoxb-", "xoxp-", "AIza", "eyJ", "-----BEGIN ", "RSA ", "EC ", "PRIVATE KEY-----", "\n", "-", ".", " ", "é", "aB3" * 5, "Zz9_", "+/=", "token=", "0a1b2c3d" * 3, "AKIA"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 16))) for _ in range(4000)]
    want, seen = [], set()
    for i, t in enumerate(texts):
        further = [(m.start(), list(FURTHER).index(k), f"{k}:{m.start()}:{m.end()}") for k, p in FURTHER.items() for m in re.finditer(p, t) if len(m[1]) >= least[k]]
        seen |= {x[1] for x in further}
        want.append((i, ",".join(x[2] for x in sorted(further))))
    found = secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "spans").collect()
    own = sorted((r["doc_id"], ",".join(x for x in r["spans"].split(",") if x.split(":")[0] in FURTHER)) for r in found)
    assert own == want and len(seen) == len(FURTHER)
