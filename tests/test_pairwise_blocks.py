"""Pairs rolled up by groups: blocks larger than one matrix product."""

import numpy as np

from embedlens.operators import vectors


def test_large_blocks_are_rolled_up_in_parts(spark, monkeypatch):
    seen, plain = [], vectors.blocked
    monkeypatch.setattr(vectors, "blocked", lambda *a, **k: (seen.append(k.get("block", vectors.BLOCK)), plain(*a, **k))[1])
    v = np.random.default_rng(1).normal(size=(15_000, 2))
    items = spark.createDataFrame([(i, i % 3, x.tolist()) for i, x in enumerate(v)], "id long, g long, v array<double>")
    got = {(r.g_a, r.g_b): (r.pairs, r.mean) for r in vectors.pairwise_by_group(items).collect()}
    s, sq = [v[g::3].sum(0) for g in range(3)], [(v[g::3] ** 2).sum() for g in range(3)]
    for a in range(3):
        for b in range(3):
            n = 5000 * 5000 - 5000 * (a == b)
            assert got[a, b][0] == n and abs(got[a, b][1] - (s[a] @ s[b] - sq[a] * (a == b)) / n) < 1e-9
    assert seen[0] > vectors.BLOCK
