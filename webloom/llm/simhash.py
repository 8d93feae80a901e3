"""Document fingerprints by SimHash, with DataFrame functions only.

A text's terms are its pairs of neighbouring words (a lone word is a term by itself), each weighed by how
often it occurs. A term's hash votes on the signed bits: for a set bit its weight counts up, else down.
Votes are summed in packed lanes, four counters of 16 bits in a long, over runs of terms short enough
that no lane overflows; the runs' sums are then unpacked and added. Fingerprints within a Hamming radius are
found by permuted block tables: split into more blocks than the radius has bits, two of them agree in a
block, whatever bits differ, so an equality join on each block finds every pair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import SPACE, durable
from webloom.llm.shards import bucket_of

#: Terms of a run: the votes for a bit fit in a lane. The top lane also holds the sign, so 2^15 would be one too many.
RUN = 1 << 14
LANES, WIDTH = 4, 16
#: Bits come from two hashes of a term.
SEEDS = ("a", "b")


def term_hashes(text: Column) -> Column:
    """An array with a hash for each pair of neighbouring words; of a single word, for that; of none, empty."""
    words = F.filter(F.split(F.translate(text, SPACE, " " * len(SPACE)), " "), lambda w: w != "")
    pairs = lambda ws: F.zip_with(F.slice(ws, 1, F.size(ws) - 1), F.slice(ws, 2, F.size(ws) - 1), lambda a, b: F.xxhash64(a, b))
    return F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 1, pairs(ws)).otherwise(F.transform(ws, lambda w: F.xxhash64(w))))[0]


def votes(hashes: DataFrame, ids: list[str], hash_: str, run: str) -> DataFrame:
    """A row for each id and run of terms with its packed sums and the number of its terms."""
    lane = F.lit(sum(1 << (WIDTH * i) for i in range(LANES)))
    sums = []
    for s, seed in enumerate(SEEDS):
        own = F.col(hash_) if not s else F.xxhash64(F.lit(seed), hash_)
        hashes = hashes.withColumn(f"_h{s}", own)
        sums += [F.sum(F.shiftrightunsigned(f"_h{s}", i).bitwiseAND(lane)).alias(f"_v{s}_{i}") for i in range(WIDTH)]
    return hashes.groupBy(*ids, run).agg(F.count(F.lit(1)).alias("_n"), *sums)


def packed_bits(totals: list[Column], terms: Column) -> Column:
    """A long from its 64 counters: bit i is set if at least half of the terms vote for it."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(2 * c >= terms, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)) for i, c in enumerate(totals)])


def fingerprints(texts: DataFrame, ids: list[str], text: str) -> DataFrame:
    """ids and two longs, fp0 and fp1, of every text; texts without words have both 0. ids tell the rows apart.

    Long texts are cut into runs of terms, so no row of any stage grows beyond its text.
    """
    terms = texts.select(*ids, F.posexplode_outer(term_hashes(F.col(text))).alias("_pos", "_hash"))
    runs = votes(terms.withColumn("_run", F.floor(F.col("_pos") / RUN)).withColumn("_hash", F.coalesce("_hash", F.lit(0).cast("long"))), ids, "_hash", "_run")
    mask = F.lit((1 << WIDTH) - 1)
    # Lane j of shift i is bit i + 16 j.
    total = [F.sum(F.shiftrightunsigned(f"_v{s}_{b % WIDTH}", WIDTH * (b // WIDTH)).bitwiseAND(mask)).alias(f"_b{s}_{b}") for s in range(len(SEEDS)) for b in range(64)]
    whole = runs.groupBy(*ids).agg(F.sum("_n").alias("_n"), F.max(F.col("_run").isNotNull()).alias("_any"), *total)
    made = [F.when(F.col("_any"), packed_bits([F.col(f"_b{s}_{b}") for b in range(64)], F.col("_n"))).otherwise(F.lit(0).cast("long")).alias(f"fp{s}") for s in range(len(SEEDS))]
    return whole.select(*ids, *made)


def distance(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b, strict=True)), F.lit(0))


def block_tables(prints: DataFrame, id_: str, blocks: int) -> DataFrame:
    """The permuted tables as one: a row for each print and block with the block's number and bits."""
    width, each = 64 * len(SEEDS) // blocks, []
    for k in range(blocks):
        s, low = divmod(k * width, 64)
        each.append(F.struct(F.lit(k).alias("_block"), F.shiftrightunsigned(f"fp{s}", low).bitwiseAND(F.lit((1 << width) - 1)).alias("_bits")))
    return prints.select(id_, *(f"fp{s}" for s in range(len(SEEDS))), F.explode(F.array(*each)).alias("_at")).select("*", "_at.*").drop("_at")


def within(queries: DataFrame, prints: DataFrame, radius: int = 3) -> DataFrame:
    """(fp0, fp1) of every query with each print at most ``radius`` bits away (near0, near1, bits), the same one included.

    Both sides are made distinct first, so groups of equal fingerprints meet once. radius is at most 3 for
    the 4 blocks of 32 bits, at most 7 for 8 blocks of 16.
    """
    blocks = 4 if radius < 4 else 8
    if radius >= 8:
        raise ValueError("at most 7 bits")
    left = block_tables(queries.select("fp0", "fp1").distinct().withColumn("_q", F.lit(0)), "_q", blocks).drop("_q")
    right = block_tables(prints.select("fp0", "fp1").distinct().withColumn("_q", F.lit(0)), "_q", blocks).drop("_q")
    right = right.withColumnsRenamed({"fp0": "near0", "fp1": "near1"})
    pairs = left.join(right, ["_block", "_bits"]).withColumn("bits", distance(("fp0", "fp1"), ("near0", "near1")))
    return pairs.filter(F.col("bits") <= radius).select("fp0", "fp1", "near0", "near1", "bits").distinct()


#: Heads of buckets that are broadcast at most, 80 bytes each; more are joined by shuffling.
BROADCAST_ROWS = 500_000


def with_next(rows: DataFrame, id_: str, text: str, per_bucket: int = 256, ranges: int = 1024) -> DataFrame:
    """Add _bucket, _row, _guest and next_text: the text of the next row by descending id (null ids last,
    equal ids by the digests of their texts); after the last row, of the first.

    Sampled quantiles of the ids bound ranges, and each is dealt into buckets of equal width; a range of one id,
    and that of null ids, by digest. A bucket's first row is also sent, as a guest behind the last, to the bucket
    before it, so that each bucket is settled alone. (_bucket, _row) tells rows apart. Only the buckets' bounds
    are ordered as a whole, in two levels.
    """
    cuts = rows.agg(F.percentile_approx(id_, [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0] or []
    # An id that is several quantiles has a range of its own.
    bounds = sorted({*cuts, *(a + 1 for a, b in zip(cuts, cuts[1:], strict=False) if a == b and a < (1 << 63) - 1)})
    rows = rows.withColumn("_range", F.when(F.col(id_).isNull(), -1).otherwise(bucket_of(id_, bounds) if bounds else F.lit(0)))
    each = rows.groupBy("_range").agg(F.min(id_).alias("_low"), F.max(id_).alias("_high"), F.count(F.lit(1)).alias("_count"))  # a row for each range
    rows = rows.join(F.broadcast(each), "_range").withColumn("_digest", F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    wide = F.greatest(F.lit(1.0), (F.col("_high").cast("double") - F.col("_low").cast("double") + 1) * per_bucket / F.col("_count"))
    by_id = F.floor((F.col("_high").cast("double") - F.col(id_).cast("double")) / wide)
    by_digest = F.floor(F.conv(F.substring("_digest", 1, 8), 16, 10).cast("double") / float(1 << 32) * F.ceil(F.col("_count") / per_bucket))
    own = F.when(F.col("_low") < F.col("_high"), by_id).otherwise(by_digest).cast("long")
    rows = rows.withColumn("_bucket", F.shiftleft((F.lit(len(bounds)) - F.col("_range")).cast("long"), 32) + own).drop("_range", "_low", "_high", "_count")
    # Each bucket's first row, and the bucket before it that has rows; the last one is before the first.
    place = F.struct(F.col(id_).isNull().alias("none"), F.bitwise_not(F.col(id_)).alias("back"), F.col("_digest").alias("digest"))
    heads = durable(rows.groupBy("_bucket").agg(F.min(place).alias("_head")).withColumn("_far", F.floor(F.col("_bucket") / 4096)))
    count, last = heads.agg(F.count(F.lit(1)), F.max("_bucket")).first()
    tops = heads.groupBy("_far").agg(F.max("_bucket").alias("_top"))
    tops = tops.select("_far", F.lag("_top").over(Window.orderBy("_far")).alias("_top"))  # a row for 4096 buckets
    near = F.lag("_bucket").over(Window.partitionBy("_far").orderBy("_bucket"))
    first = heads.join(tops, "_far").select(F.col("_bucket").alias("_own"), F.col("_head.back").alias("_back"), F.col("_head.digest").alias("_first"), F.coalesce(near, "_top", F.lit(last)).alias("_before"))
    first = F.broadcast(first) if count <= BROADCAST_ROWS else first
    sent = rows.join(first, (F.col("_bucket") == F.col("_own")) & F.bitwise_not(F.col(id_)).eqNullSafe(F.col("_back")) & (F.col("_digest") == F.col("_first")), "left")
    home = lambda bucket, guest: F.struct(F.col(bucket).alias("b"), F.lit(guest).alias("g"))
    homes = F.when(F.col("_before").isNull(), F.array(home("_bucket", 0))).otherwise(F.array(home("_bucket", 0), home("_before", 1)))
    columns = [c for c in rows.columns if c != "_bucket"]
    dealt = sent.withColumn("_home", F.explode(homes)).select(*columns, F.col("_home.b").alias("_bucket"), F.col("_home.g").alias("_guest"))
    inside = Window.partitionBy("_bucket").orderBy("_guest", F.col(id_).desc_nulls_last(), "_digest")
    return dealt.withColumns({"next_text": F.lead(text).over(inside), "_row": F.row_number().over(inside)}).drop("_digest")


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return 1 - distance(a, b) / (64.0 * len(SEEDS))


def hexadecimal(a: str, b: str) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(F.col(c)), 16, "0") for c in (a, b))))


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 3, every: int = 100) -> DataFrame:
    """The fingerprint of each document and of its edited text, whose last third is the start of the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (32 hex digits), near_edited,
    near_next (1 - bits that differ / 128) and, where doc_id is divisible by ``every``, n_within: how many
    other fingerprints of the table are within ``radius`` bits. A null text is empty; texts without words
    have the fingerprint of zeros. Equal texts have equal fingerprints. An only document is its own next.
    Repeated rows are rows like any other; an empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keys = ["_bucket", "_row", "_guest", "doc_id", "n_chars", "edited_sha256"]
    edited = F.concat(F.expr("left(text, length(text) - length(text) div 3)"), F.expr("left(coalesce(next_text, ''), cast(length(text) div 3 as int))"))
    made = with_next(rows, "doc_id", "text").withColumn("edited", edited)
    made = made.select(
        "_bucket", "_row", "_guest", "doc_id", F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.explode(F.when(F.col("_guest") == 0, F.array(F.struct(F.lit(0).alias("k"), F.col("text").alias("t")), F.struct(F.lit(1).alias("k"), F.col("edited").alias("t")))).otherwise(F.array(F.struct(F.lit(0).alias("k"), F.col("text").alias("t"))))).alias("_of"),
    ).select(*keys, F.col("_of.k").alias("_kind"), F.col("_of.t").alias("_text"))
    prints = fingerprints(made, [*keys, "_kind"], "_text")
    pick = lambda c, k: F.max(F.when(F.col("_kind") == k, F.col(c)))
    both = prints.groupBy(*keys).agg(pick("fp0", 0).alias("fp0"), pick("fp1", 0).alias("fp1"), pick("fp0", 1).alias("e0"), pick("fp1", 1).alias("e1"))
    order = Window.partitionBy("_bucket").orderBy("_row")
    done = both.withColumns({"n0": F.lead("fp0").over(order), "n1": F.lead("fp1").over(order)}).filter("_guest = 0")
    mine, theirs, other = ("fp0", "fp1"), ("e0", "e1"), ("n0", "n1")
    done = durable(
        done.select("doc_id", "n_chars", "edited_sha256", hexadecimal(*mine).alias("fingerprint"), hexadecimal(*theirs).alias("edited_fingerprint"), likeness(mine, theirs).alias("near_edited"), likeness(mine, other).alias("near_next"), *mine)
    )
    asked = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    counts = within(done.filter(asked), done, radius).groupBy(*mine).agg((F.count(F.lit(1)) - 1).alias("n_within"))
    found = done.filter(asked).join(counts, list(mine), "left").select(*done.columns, "n_within")
    return found.unionByName(done.filter(~asked).withColumn("n_within", F.lit(None).cast("long"))).drop(*mine)
