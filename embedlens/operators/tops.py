"""The largest product of each two groups of vectors, where every two blocks meet once.

Vectors lie in blocks beside others of their group. Two blocks are multiplied tile by tile in single precision; with a bound of its error only
rows and columns that may hold a larger product than the best known one are multiplied again, in double precision. Results are exact; pairs
stay quadratic in number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlens.operators.scan import flat_matrix
from embedlens.sources.shared import written

#: Rows of one side of a tile, and rows that a block's part of a group needs for tiles of its own.
TILE, OWN = 1024, 256
#: Rows that a block should have, if there aren't enough for all cores.
LEAST = 4096

SCHEMA = "g_a long, g_b long, top double"


class Side:
    """A block's rows, by group: ``first`` and ``last`` are the least and greatest id that have a row's vector."""

    def __init__(self, batches: list[pa.RecordBatch]):
        whole = lambda c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in batches])
        first, g, none = whole("id"), whole("g"), whole("none")
        order = np.lexsort((first, g, none))
        self.first, self.last, self.v = first[order], whole("last")[order], np.concatenate([flat_matrix(b.column("v")) for b in batches])[order]
        self.flat, self.norm = self.v.astype(np.float32), np.linalg.norm(self.v, axis=1)
        g, none = g[order], none[order]
        self.starts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (none[1:] != none[:-1])])
        self.ends = np.r_[self.starts[1:], len(g)]
        self.g, self.none = g[self.starts], none[self.starts]
        self.pieces = self._pieces()

    def _pieces(self) -> list[tuple[int, int, int, int]]:
        """(first row, end, first group, end) of each tile's side: a part of one large group, or some small ones."""
        found, open_ = [], 0
        for i, (a, b) in enumerate(zip(self.starts.tolist(), self.ends.tolist())):
            large = b - a >= OWN
            if open_ < i and (large or b - self.starts[open_] >= TILE):
                end = i if large else i + 1
                found.append((int(self.starts[open_]), int(self.ends[end - 1]), open_, end))
                open_ = end
            if large:
                cuts = np.linspace(a, b, -(-(b - a) // TILE) + 1).astype(int).tolist()
                found += [(x, y, i, i + 1) for x, y in zip(cuts, cuts[1:])]
                open_ = i + 1
        if open_ < len(self.starts):
            found.append((int(self.starts[open_]), int(self.ends[-1]), open_, len(self.starts)))
        return found


def _products(a: Side, x, b: Side, y) -> np.ndarray:
    """In double precision; no pair of a single id with itself counts."""
    s = a.v[x] @ b.v[y].T
    own = (a.first[x][:, None] == b.first[y][None, :]) & (a.last[x][:, None] == b.last[y][None, :]) & (a.first[x] == a.last[x])[:, None]
    s[own] = -np.inf
    return s


def _rows(a: Side, i: np.ndarray, b: Side, j: np.ndarray, top: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.g[i], pa.int64(), mask=a.none[i]), pa.array(b.g[j], pa.int64(), mask=b.none[j]), pa.array(top, pa.float64())], names=["g_a", "g_b", "top"])


def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g_a, g_b, top) of two blocks, or of a block with itself if there are no rows of side 1: each two groups in one order at least."""
    halves = ([], [])
    for batch in batches:
        side = batch.column("side").to_numpy()
        for k in (0, 1):
            if len(at := np.flatnonzero(side == k)):
                halves[k].append(batch.take(pa.array(at)))
    if not halves[0]:
        return
    a = Side(halves[0])
    b = Side(halves[1]) if halves[1] else a
    best, room = {}, np.empty(TILE * TILE, np.float32)
    for n, (x0, x1, i, i_end) in enumerate(a.pieces):
        for y0, y1, j, j_end in b.pieces[n if a is b else 0 :]:
            if i_end - i > 1 or j_end - j > 1 or max(x1 - x0, y1 - y0) > TILE:
                cuts_a, cuts_b = np.maximum(a.starts[i:i_end] - x0, 0), np.maximum(b.starts[j:j_end] - y0, 0)
                s = np.maximum.reduceat(np.maximum.reduceat(_products(a, slice(x0, x1), b, slice(y0, y1)), cuts_b, axis=1), cuts_a, axis=0)
                p, q = np.nonzero(s > -np.inf)
                if len(p):
                    yield _rows(a, p + i, b, q + j, s[p, q])
                continue
            s = np.matmul(a.flat[x0:x1], b.flat[y0:y1].T, out=room[: (x1 - x0) * (y1 - y0)].reshape(x1 - x0, y1 - y0))
            least = best.get((i, j), -np.inf) - ((a.v.shape[1] + 8) * 1.2e-7 * a.norm[x0:x1].max() * b.norm[y0:y1].max() + 1e-30)
            if s.max() >= least:
                hit = s >= np.nextafter(np.float32(least), np.float32(-np.inf))
                found = _products(a, x0 + np.flatnonzero(hit.any(1)), b, y0 + np.flatnonzero(hit.any(0))).max(initial=-np.inf)
                best[i, j] = max(best.get((i, j), -np.inf), found)
    at = np.array([k for k, top in best.items() if top > -np.inf], np.int64).reshape(-1, 2)
    yield _rows(a, at[:, 0], b, at[:, 1], np.array([top for top in best.values() if top > -np.inf]))


def meet_once(items: DataFrame, f: Callable, schema: str, block: int, rows: int) -> DataFrame:
    """``f`` over the Arrow batches (side, id, last, g, none, v) of every two blocks, each two once, and of each block with itself.

    ``items`` (id, last, g, v) are ``rows`` at most; a block has about ``block`` of them at most, so each is sent as often as there are blocks.
    Groups lie side by side in blocks."""
    spark = items.sparkSession
    few = round((8 * spark.sparkContext.defaultParallelism) ** 0.5)  # pairs of so many blocks keep all cores busy
    blocks = lambda n: max(1, -(-n // block), min(few, -(-n // LEAST)))
    parts = 8 * blocks(rows) if blocks(rows) > 1 else 1
    ranged = items.repartitionByRange(parts, "g", F.xxhash64("id"))
    kept = written(ranged.select("id", "last", F.coalesce("g", F.lit(0)).alias("g"), F.col("g").isNull().alias("none"), "v", F.spark_partition_id().alias("part")), "ranges")
    sizes = sorted((r.part, r.n) for r in kept.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row a range
    total, before, of = sum(n for _, n in sizes), 0, []
    many = blocks(total)
    for part, n in sizes:
        of.append((part, before * many // total))
        before += n
    dealt = kept.join(F.broadcast(spark.createDataFrame(of, "part int, b int")), "part")
    other = F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    sent = dealt.select("id", "last", "g", "none", "v", "b", other.alias("o"))
    x, y = F.least("b", "o"), F.greatest("b", "o")
    sent = sent.select("id", "last", "g", "none", "v", (F.col("b") > F.col("o")).cast("int").alias("side"), (y * (y + 1) / 2 + x).cast("int").alias("pair"))
    return sent.repartitionById(many * (many + 1) // 2, "pair").drop("pair").mapInArrow(f, schema)
