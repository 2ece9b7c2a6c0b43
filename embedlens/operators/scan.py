"""Exact nearest neighbours where no row can be left out: the gallery streams past large blocks of queries.

Every query is compared with every row, so seconds grow with the square; what is sent doesn't: queries and gallery are cut into so many
blocks that a task holds ``HELD`` queries at most, and each row is sent once for each block of the other side. Single precision with a bound
of its error tells which pairs can be among a query's k best; these are compared in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlens.operators.cells import EPS, best_of

#: Queries that a task holds at most; queries and gallery rows of one matrix product; pairs compared in double precision at a time.
HELD, QUERIES, ROWS, PAIRS = 131_072, 256, 8192, 65_536


class Best:
    """The k best of some queries among the gallery rows added so far: similarity at nine digits descending, id ascending."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, exclude_self: bool = False):
        self.ids, self.q, self.k, self.exclude_self = ids, q, k, exclude_self
        self.norm = np.linalg.norm(q, axis=1)
        self.sim = np.full((len(ids), k), -np.inf)
        self.of = np.zeros((len(ids), k), np.int64)

    def _merge(self, row: np.ndarray, of: np.ndarray, sim: np.ndarray) -> None:
        """Takes in (row, id, similarity), sorted by row."""
        rows = np.unique(row)
        old_sim, old_of = self.sim[rows], self.of[rows]
        row = np.concatenate([np.repeat(rows, self.k), row])
        of, sim = np.concatenate([old_of.ravel(), of]), np.concatenate([old_sim.ravel(), sim])
        order = np.lexsort((of, -sim, row))
        row, of, sim = row[order], of[order], sim[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.sim[row[kept], place[kept]], self.of[row[kept], place[kept]] = sim[kept], of[kept]

    def add(self, g_ids: np.ndarray, g: np.ndarray) -> None:
        size = np.linalg.norm(g, axis=1).max(initial=0.0)
        single = np.float32 if max(size, self.norm.max(initial=0.0)) < 1e15 else np.float64
        flat = g.astype(single).T.copy()
        for a in range(0, len(self.ids), QUERIES):
            q, ids = self.q[a : a + QUERIES], self.ids[a : a + QUERIES]
            if np.isneginf(self.sim[a, -1]):  # nothing yet to compare with
                first = best_of(ids, q, g_ids, g, self.k, self.exclude_self)
                at = {int(x): i for i, x in enumerate(ids)}
                row = first["q"].map(at).to_numpy(np.int64) + a
                self._merge(row, first["id"].to_numpy(np.int64), first["sim"].to_numpy())
                continue
            slack = EPS + (g.shape[1] + 8) * 1.2e-7 * self.norm[a : a + QUERIES] * size
            s = q.astype(single) @ flat
            row, col = np.divmod(np.flatnonzero(s >= (self.sim[a : a + QUERIES, -1] - slack).astype(single)[:, None]), len(g))
            for b in range(0, len(row), PAIRS):
                r, c = row[b : b + PAIRS], col[b : b + PAIRS]
                sim = np.round(np.einsum("ij,ij->i", q[r], g[c]), 9)
                ok = sim >= self.sim[r + a, -1]
                if self.exclude_self:
                    ok &= ids[r] != g_ids[c]
                if ok.any():
                    self._merge(r[ok] + a, g_ids[c[ok]], sim[ok])

    def rows(self) -> pa.RecordBatch:
        """(q, id, sim) of what was found, in batches of bounded size."""
        for a in range(0, len(self.ids), QUERIES * 64):
            row, at = np.nonzero(self.sim[a : a + QUERIES * 64] > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (self.ids[row + a], self.of[row + a, at], self.sim[row + a, at])], names=["q", "id", "sim"])


def flat_matrix(col: pa.Array) -> np.ndarray:
    """The vectors of a list column, without a Python object for each number."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(col), -1)


def _stream(k: int, exclude_self: bool):
    """Over a task's rows, queries (side 0) first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, held, best = [], [], None

        def take() -> None:
            nonlocal best
            if not queries or not held:
                return
            if best is None:
                best = Best(np.concatenate([i for i, _ in queries]), np.concatenate([v for _, v in queries]), k, exclude_self)
                queries[:] = [()]
            best.add(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]))
            held.clear()

        for batch in batches:
            side, ids, v = batch.column("side").to_numpy(), batch.column("id").to_numpy(), batch.column("v")
            n = int(np.searchsorted(side, 1))
            if n:
                queries.append((ids[:n], flat_matrix(v.slice(0, n))))
            for a in range(n, len(ids), ROWS):
                held.append((ids[a : a + ROWS], flat_matrix(v.slice(a, ROWS))))
                if sum(len(i) for i, _ in held) >= ROWS:
                    take()
        take()
        if best is not None:
            yield from best.rows()

    return run


def grid(n_queries: int, n_rows: int, tasks: int, held: int) -> tuple[int, int]:
    """Blocks of queries and of gallery rows: about ``tasks`` pairs of them, as square as the bound of queries allows."""
    x = max(1, -(-n_queries // held), round(float(np.sqrt(tasks * n_queries / max(1, n_rows)))))
    return x, max(1, -(-tasks // x))


def topk_in_blocks(queries: DataFrame, gallery: DataFrame, k: int, exclude_self: bool = False, held: int = HELD) -> DataFrame:
    """(q, id, sim): of each block of the gallery the k rows most similar to each query, so all of the k best are among them."""
    x, y = grid(queries.count(), gallery.count(), 4 * queries.sparkSession.sparkContext.defaultParallelism, held)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    left = queries.select(F.lit(0).alias("side"), dealt(x, 11).alias("x"), every(y).alias("y"), "id", "v")
    right = gallery.select(F.lit(1).alias("side"), every(x).alias("x"), dealt(y, 12).alias("y"), "id", "v")
    both = left.unionByName(right).repartitionById(x * y, (F.col("x") * y + F.col("y")).cast("int"))
    return both.sortWithinPartitions("side").select("side", "id", "v").mapInArrow(_stream(k, exclude_self), "q long, id long, sim double")
