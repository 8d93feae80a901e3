"""The corpus pipeline: five stages over documents, each by one operator.

quality        documents that the classifier rejects (probability of label 1 under 0.5) go
line_dedup     lines that three documents or more hold stay in the one with the largest id only
near_dedup     one document stays of each group of near duplicates (five words, similarity 0.8)
mixing         sources are mixed to target weights: documents are left out, or come twice
sentencepiece  texts are encoded; the result holds the ids, and sampled segmentations by digest

A stage keeps the columns of documents, and n_chars is that of the text it leaves; only the last one returns
others. Every stage takes any documents, an empty table too; extra columns go along up to the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm import lines, mixing, near, pieces, quality
from webloom.llm.common import WORD, durable, table


#: Bytes of documents that go to a Python worker at a time. Some are very long, and executors keep what stages before have used.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def whole(docs: DataFrame) -> Column:
    """All columns as one, out of the way of the names that operators use."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_all")


def in_batches(spark: SparkSession) -> None:
    """From now on, this session sends documents to Python workers by BATCH."""
    for name, value in BATCH.items():
        spark.conf.set(name, value)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on the labelled ones among them, scores 0.5 or more.

    Every row is scored by its own text, a null one as an empty one; repeated rows stay or go together. Without
    labels to learn from, all stay. An empty table stays empty.
    """
    in_batches(spark)
    model = quality.fit_on(docs, table(spark, sf_dir, "labels"))
    return quality.with_score(docs.select(whole(docs), "text"), model).filter("score >= 0.5").select("_all.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without the lines of 20 characters and more that three rows or more hold, but for the holders of
    the largest id; n_chars is the new length.

    A null text is an empty one. Rows that share the largest id all keep the line; null ids are the smallest.
    """
    in_batches(spark)
    done = lines.dedup_lines(docs.select(whole(docs), "doc_id", "text"), carry=["_all"])
    made = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return done.select(*(made.get(c, F.col("carried__all")[c]).alias(c) for c in docs.columns))


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id, null ids last, then by the digest of its text.

    Rows are judged by their own texts, whatever ids they share. Of rows that are alike in id and text, the one whose
    other columns have the smallest digest stays. Texts without words, null ones too, are in no group: all stay.
    """
    in_batches(spark)
    found = near.group_near(docs.select("doc_id", "text"), near.Settings(words=5, percent=80), with_rows=True)
    kept = found.filter("kept_row AND n_shingles > 0").select(F.col("doc_id").alias("_kept"), F.col("row").alias("_kept_row")).distinct()
    spoken = F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False))
    rest = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")))
    own = docs.filter(spoken).select(whole(docs), F.col("doc_id").cast("long").alias("_id"), near.row_of("text").alias("_row"), F.xxhash64(rest).alias("_rest"))
    own = own.join(kept, own["_id"].eqNullSafe(kept["_kept"]) & (own["_row"] == kept["_kept_row"]), "left_semi")
    # Rows that repeat an id and its text are a group too.
    turn = F.row_number().over(Window.partitionBy("_id", "_row").orderBy("_rest"))
    return own.withColumn("_turn", turn).filter("_turn = 1").select("_all.*").unionByName(docs.filter(~spoken))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, none to twice; rows alike in id, source and text are taken alike.

    Sources weigh 5, 2, 1 in turn, a null one last. A source without words is not taken.
    """
    mixed = mixing.mixed_rows(docs.select(whole(docs), "doc_id", "text", "source"))
    return mixed.select("_all.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of each row's text and the digests of its sampled segmentations. A null text has no ids."""
    in_batches(spark)
    held = pieces.Settings(kept=60_000, together=1 << 14, release=True)  # executors have four stages behind them
    return pieces.encode_texts(docs, held, carry=("doc_id", "lang", "source"), with_ids=True).drop("sample_ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", keep_one_of_near),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]
#: A trained classifier and seeded draws have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, applied to documents. What a stage keeps is written down before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = docs if name == STAGES[-1][0] else durable(docs)
    return docs
