"""Ranks and medians of groups that span many ranges."""

import random
import statistics

import pytest

from embedlens.operators import runs


@pytest.fixture
def rows():
    rng = random.Random(4)
    out = [(1, rng.choice([rng.random(), 0.5, 0.25, -3.0]), rng.random()) for _ in range(700)]
    out += [(2, float(i % 3), float(i)) for i in range(10)] + [(3, 1.0, 2.0), (None, 5.0, 1.0), (None, 4.0, 2.0), (4, None, 1.0), (4, 2.0, 7.0)]
    return out


def ranks(values):
    order = sorted(values, key=lambda v: (v is not None, v or 0))
    return {v: order.index(v) + (order.count(v) + 1) / 2 for v in values}


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_average_ranks_by_ranges(spark, rows, monkeypatch, limit):
    monkeypatch.setattr(runs, "GROUP_ROWS", limit)
    df = spark.createDataFrame(rows, "g long, x double, y double").repartition(6)
    got = sorted(((r.g, r.x, r.y, r.rank) for r in runs.average_rank(df, "x", "rank", "g").collect()), key=repr)
    of = {g: ranks([x for h, x, _ in rows if h == g]) for g in {r[0] for r in rows}}
    assert got == sorted(((g, x, y, of[g][x]) for g, x, y in rows), key=repr)


def test_one_group_is_ranked_in_many_tasks(spark, rows):
    df = spark.createDataFrame([r for r in rows if r[0] == 1], "g long, x double, y double").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges would be put together again
    try:
        found = runs.ranked_values(df, "x", "g")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.agg({"n": "sum"}).first()[0] == 700
    assert spark.read.parquet(*[f for f in found.inputFiles() if "ranks" in f]).select("_part").distinct().count() > 1


def test_spearman_and_medians_agree(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, "g long, x double, y double").repartition(6)
    some = df.where("x is not null").select("g", "x")
    small = {tuple(r) for r in runs.spearman(df, "g", "x", "y").collect()}, {r.g: tuple(r) for r in runs.rho_summary(some, "g", "x").collect()}
    monkeypatch.setattr(runs, "GROUP_ROWS", 0)
    large = {tuple(r) for r in runs.spearman(df, "g", "x", "y").collect()}, {r.g: tuple(r) for r in runs.rho_summary(some, "g", "x").collect()}
    assert small == large
    for g in {r[0] for r in rows}:
        assert large[1][g][2] == pytest.approx(statistics.median([x for h, x, _ in rows if h == g and x is not None]), abs=1e-6)
