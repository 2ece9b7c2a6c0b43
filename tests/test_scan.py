"""Neighbours by streaming the gallery past blocks of queries: rows, memory of a task, what is sent."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from embedlens.operators import scan, vectors
from tests.test_cells import brute, frame, got, unit


def test_stream_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    g = np.concatenate([unit(rng.normal(size=(700, 12))), np.repeat(unit(rng.normal(size=(1, 12))), 40, axis=0), np.zeros((3, 12)), rng.normal(size=(60, 12)) * 1e20])
    ids = rng.permutation(50_000)[: len(g)]
    for exclude in (False, True):
        found = scan.topk_in_blocks(frame(spark, ids[:500], g[:500]), frame(spark, ids[:743], g[:743]), 9, exclude, held=150)
        ranked = found.withColumn("r", F.row_number().over(vectors.Window.partitionBy("q").orderBy(F.desc("sim"), "id"))).where("r <= 9")
        assert got(ranked) == brute(ids[:500], g[:500], ids[:743], g[:743], 9, exclude)
    huge = scan.Best(ids, g, 3)
    huge.add(ids, g)
    assert {(a, b) for batch in huge.rows() for a, b in zip(batch["q"].to_pylist(), batch["id"].to_pylist())} == {(q, i) for q, i, _ in brute(ids, g, ids, g, 3, False)}


def test_broadcast_gallery_makes_no_wide_matrix(spark):
    rng = np.random.default_rng(2)
    g, ids = rng.normal(size=(60_000, 8)), np.arange(60_000)
    best = scan.Best(ids[:2000], g[:2000], 5)
    tracemalloc.start()
    for a in range(0, len(ids), scan.ROWS):
        best.add(ids[a : a + scan.ROWS], g[a : a + scan.ROWS])
    assert tracemalloc.get_traced_memory()[1] < 120e6  # 512 queries by all rows were three matrices of 245 MB
    tracemalloc.stop()


def test_rows_are_sent_to_as_many_blocks_at_any_size():
    sent = [sum(scan.grid(n, n, 48, scan.HELD)) for n in (25_000, 150_000, 900_000)]
    assert max(sent) <= 15 and sent[2] <= sent[0] + 1
