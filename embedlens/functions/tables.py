"""Table functions for SQL: ``text_tiles`` in a LATERAL join, ``first_rows`` over a partitioned and ordered table."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

BLANK = str.maketrans("", "", " \t\n\r\x0b\f")


def _constant(argument: AnalyzeArgument, name: str, kinds: tuple, ok) -> Any:
    if argument.isTable or not argument.isConstantExpression or not isinstance(argument.dataType, kinds) or argument.value is None or not ok(argument.value):
        raise ValueError(f"{name} is not a constant that this function takes")
    return argument.value


class TextTiles:
    """``text_tiles(text, size, overlap, min_ratio)``: (start, chunk) of tiles of ``size`` characters whose share of characters that
    aren't white space is at least ``min_ratio``; the last tile ends with the text, and a text without a good tile gives its centre."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument, min_ratio: AnalyzeArgument) -> AnalyzeResult:
        if text.isTable or not isinstance(text.dataType, (T.StringType, T.NullType)):
            raise ValueError("text_tiles takes a text")
        number = (T.DoubleType, T.FloatType, T.DecimalType, T.IntegerType)
        _constant(size, "size", (T.IntegerType, T.LongType), lambda x: x > 0)
        _constant(overlap, "overlap", number, lambda x: 0 <= x < 1)
        _constant(min_ratio, "min_ratio", number, lambda x: 0 <= x <= 1)
        return AnalyzeResult(T.StructType([T.StructField("start", T.LongType()), T.StructField("chunk", T.StringType())]))

    def eval(self, text: str | None, size: int, overlap: float, min_ratio: float) -> Iterator[tuple[int, str]]:
        text, stride = text or "", max(1, round(size * (1 - float(overlap))))
        last, found = len(text) - size, False
        for start in [0] if last <= 0 else [*range(0, last, stride), last]:
            chunk = text[start : start + size]
            if chunk and len(chunk.translate(BLANK)) / len(chunk) >= min_ratio:
                found = True
                yield start, chunk
        if not found:
            start = max(0, last // 2)
            yield start, text[start : start + size]


class FirstRows:
    """``first_rows(TABLE(t) PARTITION BY a ORDER BY (b), n)``: the first ``n`` rows of each partition, with their ``place`` from 1. Rows
    stream past; none is kept."""

    @staticmethod
    def analyze(table: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("first_rows takes TABLE(...)")
        _constant(n, "n", (T.IntegerType, T.LongType), lambda x: x >= 0)
        return AnalyzeResult(T.StructType([*table.dataType.fields, T.StructField("place", T.LongType())]))

    def __init__(self) -> None:
        self.seen = 0

    def eval(self, row: Row, n: int) -> Iterator[tuple]:
        self.seen += 1
        if self.seen <= n:
            yield (*row, self.seen)


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    for name, function in (("text_tiles", TextTiles), ("first_rows", FirstRows)):
        spark.udtf.register(name, F.udtf(function))
