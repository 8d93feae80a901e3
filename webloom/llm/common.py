"""What the operators share: reading tables, shared folders, block sizes."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of every word and line rule here: space and the controls from tab to carriage return.
SPACE = " \t\n\x0b\f\r"
#: A word, as a pattern of both Java and Python.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For bytes.translate: A to Z lower-cased, all other bytes as they are.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the folder all executors share (spark.checkpoint.dir).

    A session on one machine without that setting, as in tests, gets a folder of its own. A cluster has to have one.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        own = context.getConf().get("spark.checkpoint.dir")
        if not own:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            own = tempfile.mkdtemp(prefix="webloom-checkpoint-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(own)
    return df.checkpoint()


def numbered(rows: DataFrame, keys: list[str], into: str) -> DataFrame:
    """The rows, written down, with a number from 0 that tells those apart that are equal in ``keys``; null equals null.

    Numbers are given inside partitions first, so that rows which repeat without end are not one task.
    """
    placed = durable(rows.withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    more = counts.withColumn("_base", F.sum("_n").over(before)).filter("_base > 0").select("_part", "_base", *(F.col(k).alias(f"_of_{k}") for k in keys))
    own = Window.partitionBy(*keys, "_part").orderBy(F.lit(0))
    turned = placed.withColumn("_turn", F.row_number().over(own).cast("long") - 1)
    same = [turned[k].eqNullSafe(more[f"_of_{k}"]) for k in keys]
    joined = turned.join(more.withColumnRenamed("_part", "_of_part"), [*same, F.col("_part") == F.col("_of_part")], "left")
    return joined.select(*rows.columns, (F.col("_turn") + F.coalesce("_base", F.lit(0))).alias(into))


def parts_for(amount: int, each: int, least: int = 1) -> int:
    """So many parts that each holds about ``each``."""
    return max(least, -(-int(amount or 0) // each))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0


def unit(*cols: Column | str) -> Column:
    """A number in [0, 1) that depends only on the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Its texts; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def utf8(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """The bytes of its texts, without decoding; null is the empty text."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        blob = chunk.cast(pa.large_binary())
        for x in blob:
            yield x.as_py() or b""


def packed(column: pa.ChunkedArray | pa.Array, dtype: np.dtype) -> list[np.ndarray]:
    """Binary values as arrays of records."""
    return [np.frombuffer(x.as_py(), dtype) for x in column]


def tidy() -> None:
    """Give free memory back to the system: a worker lives through many stages, and what it keeps adds up on its host."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
