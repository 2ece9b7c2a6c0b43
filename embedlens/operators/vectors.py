"""Similarity joins: nearest neighbours by a broadcast gallery, by cells or by a stream, and all pairs in blocks of which only what is asked for is sent."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embedlens.functions import columns as C
from embedlens.operators import tops
from embedlens.operators.cells import matrix as _matrix
from embedlens.operators.cells import distinct_vectors, topk_in_cells, worth
from embedlens.operators.scan import ROWS, Best, flat_matrix, topk_in_blocks
from embedlens.sources.shared import written

#: Rows of one side in a block; a pair of blocks is one matrix product of bounded size.
BLOCK = 2048
#: Rows of 64 components in a block whose pairs are rolled up by groups at once; they are multiplied tile by tile.
GROUPED = 65_536
#: Means of vectors of components below this come from sums; pairs of others, which would cost them digits, are added one by one.
LARGE = 100.0
#: A gallery of at most so many numbers is broadcast instead (64 MB of doubles).
BROADCAST_NUMBERS = 8_000_000


def topk(queries: DataFrame, gallery: DataFrame, k: int, exclude_self: bool = True, limit: int = BROADCAST_NUMBERS) -> DataFrame:
    """(q, id, sim, rank): the k most similar gallery rows of each query; both sides are (id long, v array<double>) of unit vectors.

    The gallery is broadcast if its measured size is within ``limit`` numbers. Beyond it, it lies in cells where a sample tells that queries
    can leave most of them out (see ``cells``); else it streams past blocks of queries (see ``scan``). All are exact.
    """
    spark = queries.sparkSession
    size = gallery.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    if size.n * (size.d or 0) <= limit:
        frame = gallery.select("id", "v").toPandas().sort_values("id")
        shared = spark.sparkContext.broadcast((frame["id"].to_numpy(np.int64), _matrix(frame["v"])))

        def run(frames):
            ids, g = shared.value
            for f in frames:
                if len(ids) and f.num_rows:
                    best = Best(f.column("id").to_numpy(), flat_matrix(f.column("v")), k, exclude_self)
                    for a in range(0, len(ids), ROWS):
                        best.add(ids[a : a + ROWS], g[a : a + ROWS])
                    yield from best.rows()

        found = queries.select("id", "v").mapInArrow(run, "q long, id long, sim double")
    elif worth(queries, gallery, size.n, k):
        found = topk_in_cells(queries, gallery, k, exclude_self)
    else:
        more = k + 1 if exclude_self else k
        found = distinct_vectors(queries, gallery, k, lambda q, g: topk_in_blocks(q, g, more))
        found = found.where("q <> id") if exclude_self else found
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def blocked(left: DataFrame, right: DataFrame | None, f, schema: str, block: int = BLOCK, group: bool = False, rows: int = 0) -> DataFrame:
    """``f(left ids, left matrix, right ids, right matrix)`` for every pair of blocks; with ``group`` the rows' long column ``g``
    follows each side's ids. Without ``right``, blocks of ``left`` (at most ``rows``) meet once, and ``f`` takes their batches (see ``tops``)."""
    if right is None:
        return tops.meet_once(left, f, schema, block, rows)
    more = ["g"] if group else []

    def dealt(df: DataFrame, salt: int) -> tuple[DataFrame, int]:
        n = max(1, -(-df.count() // block))
        return df.select("id", "v", *more, F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int").alias("b")), n

    (a, na), (b, nb) = dealt(left, 1), dealt(right, 2)
    a = a.select("id", "v", *more, F.col("b").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("y"), F.lit(0).alias("side"))
    b = b.select("id", "v", *more, F.explode(F.sequence(F.lit(0), F.lit(na - 1))).alias("x"), F.col("b").alias("y"), F.lit(1).alias("side"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        p, q = frame[frame["side"] == 0].sort_values("id"), frame[frame["side"] == 1].sort_values("id")
        if p.empty or q.empty:
            return pd.DataFrame()
        side = lambda x: (x["id"].to_numpy(), *(x[c].to_numpy() for c in more), _matrix(x["v"]))
        return f(*side(p), *side(q))

    return a.unionByName(b).groupBy("x", "y").applyInPandas(run, schema)


def pairwise_cosine(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, sim) of all pairs with different ids: the whole square, for those who need it."""

    def run(ai, a, bi, b):
        s = a @ b.T
        x, y = np.nonzero(ai[:, None] != bi[None, :])
        return pd.DataFrame({"a": ai[x], "b": bi[y], "sim": s[x, y]})

    return blocked(left, right, run, "a long, b long, sim double", block=512)


def _by_group(ai, ag, a, bi, bg, b):
    """(g_a, g_b, n, total, top) of two blocks' pairs of different ids."""
    left, ga = np.unique(ag, return_inverse=True)
    right, gb = np.unique(bg, return_inverse=True)
    order_a, order_b = np.argsort(ga, kind="stable"), np.argsort(gb, kind="stable")
    s, same = (a @ b.T)[order_a][:, order_b], (ai[:, None] == bi[None, :])[order_a][:, order_b]
    cut_a, cut_b = np.searchsorted(ga[order_a], np.arange(len(left))), np.searchsorted(gb[order_b], np.arange(len(right)))
    fold = lambda m, f: f.reduceat(f.reduceat(m, cut_a, axis=0), cut_b, axis=1)
    n = fold((~same).astype(np.int64), np.add)
    total, top = fold(np.where(same, 0.0, s), np.add), fold(np.where(same, -np.inf, s), np.maximum)
    x, y = np.nonzero(n)
    exact = lambda m: pd.arrays.ArrowExtensionArray(pa.array(m[x, y]))  # noqa: E731  (a NaN of plain pandas would become a null)
    return pd.DataFrame({"g_a": left[x], "g_b": right[y], "n": n[x, y], "total": exact(total), "top": exact(top)})


def _sums_by_group(rows: DataFrame) -> DataFrame:
    """(g_a, g_b, pairs, n, total) in parts that add up: all pairs of different ids, those of two plain vectors, and their products' sum.

    Sums of groups are multiplied, and what an id has with itself is taken off."""
    from embedlens.operators.retrieval import vector_sum  # which imports this module

    spark, plain = rows.sparkSession, rows.where("plain")

    def sums(df: DataFrame, plain: DataFrame, *keys: str) -> DataFrame:
        """(keys, c, n, s, sq): rows, plain ones, their sum and squared norms."""
        s = vector_sum(plain, *keys).select(F.struct(*keys).alias("k"), "s", "sq")
        c = df.groupBy(*keys).agg(F.count("*").alias("c"), F.count_if("plain").alias("n")).withColumn("k", F.struct(*keys))
        return c.join(s, c["k"].eqNullSafe(s["k"]), "left").select(*keys, "c", "n", "s", F.coalesce("sq", F.lit(0.0)).alias("sq"))

    def products(left: DataFrame, on: str | None, sign: int) -> DataFrame:
        a, b = (left.select(*([on] if on else []), *[F.col(c).alias(f"{c}_{x}") for c in ("g", "c", "n", "s")]) for x in "ab")
        pairs = a.join(b, on) if on else a.repartition(spark.sparkContext.defaultParallelism).crossJoin(b)
        times = lambda c: F.col(f"{c}_a") * F.col(f"{c}_b") * sign
        return pairs.select("g_a", "g_b", times("c").alias("pairs"), times("n").alias("n"), (F.coalesce(C.dot(F.col("s_a"), F.col("s_b")), F.lit(0.0)) * sign).alias("total"))

    def own(groups: DataFrame, sign: int) -> DataFrame:
        return groups.select(F.col("g").alias("g_a"), F.col("g").alias("g_b"), (F.col("c") * sign).alias("pairs"), (F.col("n") * sign).alias("n"), (F.col("sq") * sign).alias("total"))

    groups = written(sums(rows, plain, "g"), "groups")
    parts = products(groups, None, 1).unionByName(own(groups, -1))
    twice = written(rows.groupBy("id").agg(F.count("*").alias("times")).where("times > 1").select("id"), "twice")
    if not twice.isEmpty():  # ids of several rows: also what these rows have with each other
        again = written(rows.join(twice, "id"), "again")
        mine = written(sums(again, again.where("plain"), "id", "g"), "mine")
        parts = parts.unionByName(products(mine, "id", -1)).unionByName(own(mine, 1))
    return parts


def pairwise_by_group(items: DataFrame) -> DataFrame:
    """(g_a, g_b, pairs, mean, top) over all pairs of different items (id, g, v), by their groups. Items without an id are in no pair; pairs
    without a vector count, and are in no mean and no top.

    Pairs and means come from sums of groups. Only tops need all pairs: equal vectors of a group are one, and blocks of them meet once (see
    ``tops``). Vectors that aren't plain (not finite, components of ``LARGE`` or more) meet all others in double precision."""
    plain = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: F.abs(x) < LARGE), F.lit(False))
    rows = items.where("id is not null").select("id", "g", "v", plain.alias("plain"))
    there = rows.where("v is not null").select("plain", F.size("v").alias("d"))
    size = there.agg(F.count_if("plain").alias("n"), F.count_if(~F.col("plain")).alias("other"), F.min("d").alias("least"), F.max("d").alias("d")).first()
    if size.least != size.d:
        raise ValueError("vectors of different sizes")
    parts = _sums_by_group(rows).withColumn("top", F.lit(None).cast("double"))
    none = [F.lit(0).cast("long").alias("pairs"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total")]
    if size.n:
        kinds = rows.where("plain").groupBy("g", "v").agg(F.min("id").alias("id"), F.max("id").alias("last"))
        found = blocked(kinds, None, tops.tops, tops.SCHEMA, block=max(BLOCK, GROUPED * 64 // max(64, size.d)), rows=size.n)
        each = F.explode(F.array(F.struct("g_a", "g_b"), F.struct(F.col("g_b").alias("g_a"), F.col("g_a").alias("g_b"))))
        parts = parts.unionByName(found.select(each.alias("g"), "top").select("g.g_a", "g.g_b", *none, "top"))
    if size.other:
        named = rows.withColumn("g", F.coalesce(F.col("g").cast("string"), F.lit(""))).where("v is not null")
        cells = lambda right: blocked(named.where("not plain"), right, _by_group, "g_a string, g_b string, n long, total double, top double", group=True)
        for df, a, b in ((cells(named), "g_a", "g_b"), (cells(named.where("plain")), "g_b", "g_a")):
            group = lambda c: F.nullif(F.col(c), F.lit("")).cast("long")
            parts = parts.unionByName(df.select(group(a).alias("g_a"), group(b).alias("g_b"), none[0], "n", "total", "top"))
    out = parts.groupBy("g_a", "g_b").agg(F.sum("pairs").alias("pairs"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("top").alias("top")).where("pairs > 0")
    return out.select("g_a", "g_b", "pairs", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("mean"), F.when(F.col("n") > 0, F.col("top")).alias("top"))
