"""A sink for response lines that a stream writes once each, however often an epoch is tried."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery


class Staged(WriterCommitMessage):
    """A task's file that is not yet part of the output."""

    def __init__(self, name: str | None):
        self.name = name


class LineWriter(DataSourceStreamWriter):
    """Tasks write files of their own, hidden from readers; the commit of an epoch names them for good.

    The final names begin with the epoch, and a commit first takes away what an earlier try of that epoch has named. So an
    epoch that is run again after a failure, even with other partitions, replaces its lines and adds none.
    """

    def __init__(self, path: str, column: str):
        self.path, self.column = path, column

    def write(self, iterator: Iterator) -> Staged:
        rows, name = iter(iterator), f".{uuid.uuid4().hex}.tmp"
        first = next(rows, None)
        if first is None:
            return Staged(None)
        os.makedirs(self.path, exist_ok=True)
        with open(os.path.join(self.path, name), "w", encoding="utf-8", newline="\n") as out:
            for row in chain([first], rows):
                out.write(row[self.column] + "\n")
            out.flush()
            os.fsync(out.fileno())
        return Staged(name)

    def commit(self, messages: list, batchId: int) -> None:
        os.makedirs(self.path, exist_ok=True)
        mark = f"epoch-{batchId:010d}-"
        for name in os.listdir(self.path):
            if name.startswith(mark):
                os.remove(os.path.join(self.path, name))
        for i, m in enumerate(x for x in messages if x is not None and x.name):
            os.replace(os.path.join(self.path, m.name), os.path.join(self.path, f"{mark}{i:05d}.jsonl"))

    def abort(self, messages: list, batchId: int) -> None:
        for m in messages:
            if m is not None and m.name and os.path.exists(os.path.join(self.path, m.name)):
                os.remove(os.path.join(self.path, m.name))


class Lines(DataSource):
    """``writeStream.format("webloom_lines").option("path", folder)``: the column ``response`` (or option ``column``), a line a row.

    The folder has to be one that all executors and the driver have at the same path. Rows must not be null in the column.
    """

    @classmethod
    def name(cls) -> str:
        return "webloom_lines"

    def streamWriter(self, schema, overwrite: bool) -> LineWriter:
        column = self.options.get("column", "response")
        if column not in schema.fieldNames():
            raise ValueError(f"there is no column {column} to write, only {', '.join(schema.fieldNames())}")
        return LineWriter(self.options["path"], column)


def write_responses(responses: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start writing a stream of responses to a folder; ``once``: what there is now, then end."""
    responses.sparkSession.dataSource.register(Lines)
    rows = responses.filter("response IS NOT NULL").select("response").writeStream.format("webloom_lines").option("path", path).option("checkpointLocation", checkpoint)
    return (rows.trigger(availableNow=True) if once else rows).start()


def committed(spark: SparkSession, path: str) -> DataFrame:
    """response: the lines of all epochs committed."""
    return spark.read.option("pathGlobFilter", "epoch-*.jsonl").text(path).withColumnRenamed("value", "response")

