"""Exact nearest neighbours over a partition of the gallery: blocks that can't hold one are not visited.

The gallery lies in cells around centroids, each cell in rings by distance from its centroid, each ring in blocks of bounded size. By the
triangle inequality no row of a ring of outer radius r around c is more similar to q than q·c + |q| r. A query visits rings in the order
of these bounds, in rounds; after each round it knows the similarity of its k-th best so far, and rings below that are skipped for good.
The result is exact whatever the centroids are, so they are fitted to a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embedlens.sources.shared import written

#: Rows of a gallery block, and queries that meet a block in one task.
BLOCK, QUERIES = 2048, 4096
#: Centroids at most, and rows that they are fitted to at most; both are held by every task.
CELLS, SAMPLE = 1024, 32_768
#: Rings of a cell at most.
RINGS = 16
#: Rings that a query visits in the first rounds; the last round visits all that are left.
ROUNDS = (2, 8)
#: Similarities are compared at nine digits.
EPS = 1e-9


def matrix(col: pd.Series) -> np.ndarray:
    return np.array(col.tolist(), np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def centroids(sample: np.ndarray, n: int, rounds: int = 6, seed: int = 1) -> np.ndarray:
    """``n`` centres of the sample by Lloyd's rounds; a cell that runs empty keeps its centre."""
    if not len(sample):
        return sample
    rng = np.random.default_rng(seed)
    sample = sample[np.lexsort(sample.T[::-1])]  # the same centres whatever the order of the sample
    c = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(rounds):
        near = nearest(sample, c)
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(x @ c.T - 0.5 * (c * c).sum(1)[None, :], axis=1)


def bounded_sample(df: DataFrame, n: int, most: int) -> np.ndarray:
    """At most ``most`` vectors of ``df(id, v)``, which has ``n`` rows, chosen by the hash of their ids."""
    share = max(1, -(-n // most))
    some = df.where(F.pmod(F.xxhash64("id", F.lit(77)), F.lit(share)) == 0) if share > 1 else df
    return matrix(some.select("v").limit(most).toPandas()["v"])


def best_of(q_ids: np.ndarray, q: np.ndarray, g_ids: np.ndarray, g: np.ndarray, k: int, exclude_self: bool = False) -> pd.DataFrame:
    """Each query's best k of a gallery block: rounded similarity descending, id ascending."""
    s = np.round(q @ g.T, 9)
    if exclude_self:
        s[q_ids[:, None] == g_ids[None, :]] = -np.inf
    k = min(k, s.shape[1])
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if k else np.zeros(len(s))
    row, at = np.nonzero((s >= least[:, None]) & (s > -np.inf))  # the k best of each row and what ties with the last
    sim = s[row, at]
    order = np.lexsort((g_ids[at], -sim, row))
    row, at, sim = row[order], at[order], sim[order]
    best = np.arange(len(row)) - np.searchsorted(row, row) < k
    return pd.DataFrame({"q": q_ids[row[best]], "id": g_ids[at[best]], "sim": sim[best]})


class Partition:
    """The gallery in written blocks (node, salt, id, v); centroids, and a row for each node, that is each ring of a cell."""

    def __init__(self, gallery: DataFrame, cells: int | None = None, block: int = BLOCK):
        spark, n = gallery.sparkSession, gallery.count()
        sample = bounded_sample(gallery, n, SAMPLE)
        self.centres = centroids(sample, cells or int(np.clip(np.sqrt(n), 1, CELLS)))
        sent = spark.sparkContext.broadcast(self.centres)

        def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c = sent.value
            for f in frames:
                for a in range(0, len(f), 4096):
                    part = f.iloc[a : a + 4096]
                    x = matrix(part["v"])
                    near = nearest(x, c)
                    yield pd.DataFrame({"id": part["id"], "v": part["v"], "cell": near.astype(np.int32), "far": np.linalg.norm(x - c[near], axis=1)})

        assigned = written(gallery.select("id", "v").mapInPandas(assign, "id long, v array<double>, cell int, far double"), "cells")
        at = [i / RINGS for i in range(1, RINGS)]
        cuts = {}
        for r in assigned.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("far", at, 1000).alias("cuts")).collect():  # a row a cell
            rings = min(RINGS, -(-r.n // block))
            cuts[r.cell] = sorted({r.cuts[i * RINGS // rings - 1] for i in range(1, rings)})
        edges = spark.createDataFrame(sorted(cuts.items()), "cell int, cuts array<double>")
        ring = F.size(F.filter("cuts", lambda x: x < F.col("far")))
        placed = assigned.join(F.broadcast(edges), "cell").withColumn("node", (F.col("cell") * RINGS + ring).cast("int"))
        nodes = sorted(tuple(r) for r in placed.groupBy("node").agg(F.max("far"), F.count("*")).collect())  # CELLS x RINGS rows at most
        self.node = np.array([r[0] for r in nodes], np.int64)
        self.radius = np.array([r[1] for r in nodes], np.float64)
        self.rows = np.array([r[2] for r in nodes], np.int64)
        self.salts = -(-self.rows // block)
        salts = spark.createDataFrame([(int(i), int(s)) for i, s in zip(self.node, self.salts)], "node int, salts long")
        self.blocks = written(placed.join(F.broadcast(salts), "node").select("node", F.pmod(F.xxhash64("id", F.lit(3)), F.col("salts")).cast("int").alias("salt"), "id", "v"), "blocks")
        self.salted = salts
        sent.destroy()

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The most that a row of each node can be similar to each query."""
        return (q @ self.centres.T)[:, self.node // RINGS] + np.linalg.norm(q, axis=1)[:, None] * self.radius[None, :]


def _choose(shared, most: int | None, first: bool):
    """The next nodes of each query: the best ``most`` (all, if None) that it hasn't visited and whose bound reaches its k-th best."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for f in frames:
            for a in range(0, len(f), 512):
                part = f.iloc[a : a + 512]
                bound = p.bounds(matrix(part["v"]))
                if first:
                    seen = [[] for _ in range(len(part))]
                else:
                    seen = [list(x) for x in part["seen"]]
                    bound[bound + EPS < part["least"].to_numpy()[:, None]] = -np.inf
                    for row, x in enumerate(seen):
                        bound[row, np.searchsorted(p.node, x)] = -np.inf
                new = []
                for row in bound:
                    at = np.flatnonzero(row > -np.inf)
                    if most is not None and len(at) > most:
                        at = at[np.argpartition(-row[at], most - 1)[:most]]
                    new.append(p.node[at].astype(np.int32))
                yield pd.DataFrame({"id": part["id"], "v": part["v"], "seen": [np.array([*x, *y], np.int32) for x, y in zip(seen, new)], "new": new})

    return run


class _Nodes:
    """What tasks need of a partition."""

    def __init__(self, p: Partition):
        self.centres, self.node, self.radius = p.centres, p.node, p.radius

    bounds = Partition.bounds


def _search(queries: DataFrame, p: Partition, k: int, report: dict | None) -> DataFrame:
    """(q, id, sim): each query's k best of the whole gallery, by rounds over nodes."""
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(_Nodes(p))
    state, best, visited = queries, None, 0
    for turn, most in enumerate((*ROUNDS, None)):
        schema = "id long, v array<double>, seen array<int>, new array<int>"
        state = written(state.mapInPandas(_choose(shared, most, turn == 0), schema), "visits")
        visits = state.select(F.col("id").alias("q"), "v", F.explode("new").alias("node"))
        counts = {r.node: r.n for r in visits.groupBy("node").agg(F.count("*").alias("n")).collect()}  # a row a node
        if counts:
            visited += sum(n * int(p.salts[np.searchsorted(p.node, i)]) for i, n in counts.items())
            parts = spark.createDataFrame([(i, -(-n // QUERIES)) for i, n in sorted(counts.items())], "node int, parts long")
            upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c).cast("int") - 1))
            left = visits.join(F.broadcast(parts), "node").join(F.broadcast(p.salted), "node").select("node", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int").alias("part"), upto("salts").alias("salt"), "q", "v")
            right = p.blocks.join(F.broadcast(parts), "node").select("node", upto("parts").alias("part"), "salt", "id", "v")

            def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
                if a.empty or b.empty:
                    return pd.DataFrame({"q": [], "id": [], "sim": []})
                g_ids, g = b["id"].to_numpy(), matrix(b["v"])
                return pd.concat([best_of(a["q"].to_numpy()[i : i + 512], matrix(a["v"].iloc[i : i + 512]), g_ids, g, k) for i in range(0, len(a), 512)])

            keys = ("node", "part", "salt")
            found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "q long, id long, sim double")
            both = found if best is None else best.unionByName(found)
            rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "id"))
            best = written(both.withColumn("r", rank).where(F.col("r") <= k).drop("r"), "best")
        if best is None:
            break
        if most is not None:
            least = best.groupBy("q").agg(F.when(F.count("*") >= k, F.min("sim")).alias("least"))
            state = state.join(least.withColumnRenamed("q", "id"), "id", "left").select("id", "v", "seen", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    shared.destroy()
    if report is not None:
        report |= {"visited": visited, "blocks": int(p.salts.sum()), "queries": queries.count()}
    return spark.createDataFrame([], "q long, id long, sim double") if best is None else best


#: Cells are worth it where a query can leave out all but this share of the gallery, as told by a sample.
WORTH, PROBES = 0.1, 256


def worth(queries: DataFrame, gallery: DataFrame, n: int, k: int) -> bool:
    """Whether cells let queries leave out most of the gallery, told by samples; results don't depend on it.

    The share of sampled rows whose cell's bound reaches the k-th best of as dense a gallery as the sample is."""
    sample = bounded_sample(gallery, n, SAMPLE // 4)
    probes = bounded_sample(queries, queries.count(), PROBES)
    if not len(sample) or not len(probes):
        return False
    c = centroids(sample, int(np.clip(np.sqrt(len(sample)), 1, CELLS)))
    near = nearest(sample, c)
    radius = np.zeros(len(c))
    np.maximum.at(radius, near, np.linalg.norm(sample - c[near], axis=1))
    best = np.sort(probes @ sample.T, axis=1)[:, -min(k, len(sample))]
    bound = probes @ c.T + np.linalg.norm(probes, axis=1)[:, None] * radius[None, :]
    return bool((bound >= best[:, None])[:, near].mean() < WORTH)


def distinct_vectors(queries: DataFrame, gallery: DataFrame, k: int, search) -> DataFrame:
    """(q, id, sim) by ``search(queries, gallery)``, where equal vectors are one query, and only their k + 1 smallest ids, which alone can be
    among the k best, are in the gallery: copies cost nothing."""
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = written(gallery.select("id", "v").withColumn("r", first).where(F.col("r") <= k + 1).drop("r"), "gallery")
    if few.isEmpty():
        return queries.sparkSession.createDataFrame([], "q long, id long, sim double")
    kinds = written(queries.groupBy("v").agg(F.min("id").alias("id")).select("id", "v"), "queries")
    best = search(kinds, few)
    mine = queries.select(F.col("id").alias("q"), F.col("v").alias("w")).join(kinds.select(F.col("id").alias("kind"), F.col("v").alias("w")), "w").select("q", "kind")
    return mine.join(best.withColumnRenamed("q", "kind"), "kind").select("q", "id", "sim")


def topk_in_cells(queries: DataFrame, gallery: DataFrame, k: int, exclude_self: bool = True, cells: int | None = None, block: int = BLOCK, report: dict | None = None) -> DataFrame:
    """(q, id, sim): the k gallery rows most similar to each query; sides are (id long, v array<double>).

    ``report`` gets how many blocks were visited by queries. Gallery ids are unique. A gallery without rows gives no rows.
    """
    found = distinct_vectors(queries, gallery, k, lambda q, g: _search(q, Partition(g, cells, block), k + 1 if exclude_self else k, report))
    return found.where("q <> id") if exclude_self else found
