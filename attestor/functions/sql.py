"""Operators as table functions of SQL: their columns follow those of the table that is handed over.

``register(spark)`` makes ``unpivot_metrics``, ``row_batches`` and ``cut_texts`` known to a session.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def _named(columns: AnalyzeArgument, rows: AnalyzeArgument) -> list[T.StructField]:
    """The fields of a table that a text lists, parted by commas; blanks do not count."""
    if not columns.isConstantExpression or not isinstance(columns.value, str):
        raise ValueError("list the columns as a text, parted by commas")
    known = {f.name: f for f in rows.dataType.fields}
    names = [c.strip() for c in columns.value.split(",") if c.strip()]
    if missing := [n for n in names if n not in known]:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    return [known[n] for n in names]


class UnpivotMetrics:
    """``unpivot_metrics(TABLE(t), 'id, ...')``: the named columns, ``metric`` and ``value`` for each other column with a number; nulls give no row."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, ids: AnalyzeArgument) -> AnalyzeResult:
        kept = _named(ids, rows)
        return AnalyzeResult(T.StructType([*kept, T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType())]))

    def eval(self, row: Row, ids: str) -> Iterator[tuple]:
        kept = [c.strip() for c in ids.split(",") if c.strip()]
        for name, value in row.asDict().items():
            if name not in kept and value is not None and not isinstance(value, (str, bytes, bool, list, dict, Row)):
                yield (*(row[c] for c in kept), name, float(value))


class RowBatches:
    """``row_batches(TABLE(t) PARTITION BY k ORDER BY (o, p), 'k, o', n)``: the named columns, ``batch`` and ``place``: rows of a partition in runs of ``n``, both from 1."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, columns: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        if not size.isConstantExpression or not size.value or size.value < 1:
            raise ValueError("a batch has at least one row")
        return AnalyzeResult(T.StructType([*_named(columns, rows), T.StructField("batch", T.LongType()), T.StructField("place", T.LongType())]))

    def __init__(self) -> None:
        self.seen = 0

    def eval(self, row: Row, columns: str, size: int) -> Iterator[tuple]:
        yield (*(row[c.strip()] for c in columns.split(",") if c.strip()), self.seen // size + 1, self.seen % size + 1)
        self.seen += 1

    def terminate(self) -> Iterator[tuple]:
        yield from ()


class CutTexts:
    """``cut_texts(TABLE(t), 'k, ...', 'text', n)``: the named columns, ``nth`` (from 0) and ``part``: a text in parts of ``n`` characters; null and empty texts give none."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, columns: AnalyzeArgument, text: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        if not size.isConstantExpression or not size.value or size.value < 1:
            raise ValueError("a part has at least one character")
        if not isinstance(_named(text, rows)[0].dataType, T.StringType):
            raise ValueError(f"{text.value} is no text")
        return AnalyzeResult(T.StructType([*_named(columns, rows), T.StructField("nth", T.IntegerType()), T.StructField("part", T.StringType())]))

    def eval(self, row: Row, columns: str, text: str, size: int) -> Iterator[tuple]:
        whole = row[text.strip()] or ""
        for nth, at in enumerate(range(0, len(whole), size)):
            yield (*(row[c.strip()] for c in columns.split(",") if c.strip()), nth, whole[at : at + size])


def register(spark: SparkSession) -> None:
    """Make the table functions known to a session."""
    for name, made in (("unpivot_metrics", UnpivotMetrics), ("row_batches", RowBatches), ("cut_texts", CutTexts)):
        spark.udtf.register(name, udtf(made))
