"""Table functions in SQL."""

import pytest

from embedlens.functions import tables
from embedlens.operators import tiling


def test_text_tiles_are_the_operators(spark):
    tables.register(spark)
    rows = [(1, "abc def  \n" * 30), (2, ""), (3, None), (4, " " * 55), (5, "x" * 20), (6, "y" * 47 + "é" * 10 + " " * 8)]
    df = spark.createDataFrame(rows, "k long, t string")
    for overlap, ratio in ((0.0, 0.5), (0.3, 0.9), (0.5, 0.0)):
        want = {tuple(r) for r in tiling.tile_text(df, "k", "t", 20, overlap=overlap, min_ratio=ratio).collect()}
        got = spark.sql(f"SELECT k, start, chunk FROM {{df}}, LATERAL text_tiles(t, 20, {overlap}D, {ratio}D)", df=df)
        assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("call", ["text_tiles('a', 0, 0.0, 0.5)", "text_tiles('a', 5, 1.0, 0.5)", "text_tiles(1, 5, 0.0, 0.5)", "text_tiles('a', 5, 0.0, 2.0)", "first_rows(1, 2)", "first_rows(TABLE(SELECT 1 AS a), -1)"])
def test_wrong_arguments_are_told_before_a_task_runs(spark, call):
    tables.register(spark)
    with pytest.raises(Exception, match="takes|not a constant"):
        spark.sql(f"SELECT * FROM {call}")


def test_first_rows(spark):
    tables.register(spark)
    df = spark.createDataFrame([(g, v, "x") for g in (1, 2, None) for v in range(5)], "g long, v long, s string")
    got = spark.sql("SELECT * FROM first_rows(TABLE(SELECT * FROM {df}) PARTITION BY g ORDER BY (v DESC), 2)", df=df)
    assert got.columns == ["g", "v", "s", "place"]
    assert {tuple(r) for r in got.collect()} == {(g, v, "x", p) for g in (1, 2, None) for v, p in ((4, 1), (3, 2))}
