"""UDFs over Arrow batches that are made when they are first used, since their types need a session."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def pandas_column(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """Make a function of pandas series a function of columns."""

    def wrap(function: Callable) -> Callable[..., Column]:
        return lambda *columns: F.pandas_udf(function, kind)(*columns)

    return wrap


#: Rows and characters of a slice, whose values are Python objects together.
ROWS, CHARS = 256, 1 << 20


def sliced(function: Callable, batches: Iterator[tuple[pa.Array, ...]], of: pa.DataType) -> Iterator[pa.Array]:
    """The function's values of a batch's rows, by slices."""
    for batch in batches:
        out, chars = [], 0
        for values in zip(*batch, strict=True):
            own = [v.as_py() for v in values]
            out.append(function(*own))
            chars += sum(len(x) for x in own if isinstance(x, (str, bytes)))
            if len(out) >= ROWS or chars >= CHARS:
                yield pa.array(out, of)
                out, chars = [], 0
        if out:
            yield pa.array(out, of)


def row_column(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """Make a function of a row's values a function of columns. For long texts: Spark bounds a batch by its bytes, and of a
    batch only a slice's values are Python objects at a time."""

    def wrap(function: Callable) -> Callable[..., Column]:
        def column(*columns: Column) -> Column:
            of = to_arrow_type(T._parse_datatype_string(kind))

            def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                yield from sliced(function, ((b,) for b in batches), of)

            def many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
                yield from sliced(function, batches, of)

            return F.arrow_udf(one if len(columns) == 1 else many, kind)(*columns)

        return column

    return wrap
