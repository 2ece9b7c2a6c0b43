"""Exact neighbours over cells against all pairs, and how much is skipped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedlens.operators import cells, vectors

V = "id long, v array<double>"


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], V).repartition(5)


def brute(q_ids, q, g_ids, g, k, exclude_self):
    s = np.round(q @ g.T, 9)
    out = set()
    for i, row in zip(q_ids, s):
        order = sorted((-x, j) for j, x in zip(g_ids, row) if not (exclude_self and i == j))[:k]
        out |= {(int(i), int(j), -x) for x, j in order}
    return out


def got(df):
    rows = [(r.q, r.id, r.sim) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = unit(rng.normal(size=(40, 16)))
    return unit(np.repeat(centres, 50, axis=0) + 0.05 * rng.normal(size=(2000, 16)))


def test_clustered_data_skip_blocks(spark, clustered):
    ids, report = np.arange(2000), {}
    items = frame(spark, ids, clustered)
    found = cells.topk_in_cells(items, items, 10, cells=40, block=20, report=report)
    kept = vectors.topk(items, items, 10)
    assert {(r.q, r.id, r.sim) for r in kept.select("q", "id", "sim").collect()} == brute(ids, clustered, ids, clustered, 10, True)
    ranked = found.withColumn("r", F.row_number().over(vectors.Window.partitionBy("q").orderBy(F.desc("sim"), "id"))).where("r <= 10")
    assert got(ranked) == brute(ids, clustered, ids, clustered, 10, True)
    assert report["queries"] == 2000 and report["blocks"] >= 90
    assert report["visited"] < 0.2 * report["queries"] * report["blocks"]


@pytest.mark.parametrize("k, exclude", [(1, True), (7, False), (30, True)])
def test_every_kind_of_row(spark, k, exclude):
    """Copies, zero vectors, long and short ones, a small gallery, equal similarities."""
    rng = np.random.default_rng(k)
    g = np.concatenate([np.repeat(unit(rng.normal(size=(1, 6))), 300, axis=0), np.zeros((5, 6)), rng.normal(size=(200, 6)) * rng.uniform(0.1, 9, size=(200, 1)), np.eye(6), -np.eye(6)])
    ids = rng.permutation(10_000)[: len(g)]
    q_ids = np.concatenate([ids[::3], [20_001, 20_002]])
    q = np.concatenate([g[::3], rng.normal(size=(2, 6))])
    found = vectors.topk(frame(spark, q_ids, q), frame(spark, ids, g), k, exclude_self=exclude, limit=0)
    assert got(found.select("q", "id", "sim")) == brute(q_ids, q, ids, g, k, exclude)
    assert {r["rank"] for r in found.collect()} == set(range(1, k + 1))


def test_fewer_than_k_and_none(spark):
    few = frame(spark, [1, 2], np.eye(3)[:2])
    assert got(vectors.topk(few, few, 5, limit=0).select("q", "id", "sim")) == {(1, 2, 0.0), (2, 1, 0.0)}
    assert vectors.topk(few.limit(0), few, 5, limit=0).count() == 0 and vectors.topk(few, few.limit(0), 5, limit=0).count() == 0


def test_bounds_hold(spark, clustered):
    p = cells.Partition(frame(spark, np.arange(2000), clustered), cells=13, block=30)
    bound = p.bounds(clustered[:50])
    rows = p.blocks.collect()
    assert len(rows) == 2000 and p.rows.sum() == 2000
    at = {int(n): i for i, n in enumerate(p.node)}
    for r in rows:
        assert (clustered[:50] @ np.array(r.v) <= bound[:, at[r.node]] + 1e-9).all()
