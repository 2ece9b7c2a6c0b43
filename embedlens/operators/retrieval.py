"""Set-level retrieval metrics over descriptor tables (id, group, v) of unit vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embedlens.functions import columns as C
from embedlens.operators import late
from embedlens.operators.vectors import _matrix, blocked, topk
from embedlens.sources.shared import written

KS = (1, 5, 10, 20)


def recalls(ranks: DataFrame, ks=KS, rank: str = "rank") -> DataFrame:
    """(k, hits, total, recall): ``ranks`` has a row for each eligible query; null is no hit. Zeros without queries."""
    cells = [F.struct(F.lit(k).cast("long").alias("k"), F.count_if(F.col(rank) <= k).alias("hits")) for k in ks]
    one = ranks.groupBy().agg(F.array(*cells).alias("cells"), F.count("*").alias("total"))
    out = one.select(F.explode("cells").alias("c"), "total").select("c.k", "c.hits", "total")
    return out.withColumn("recall", F.round(F.coalesce(F.col("hits") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)), 6))


def first_partner(crops: DataFrame, k: int) -> DataFrame:
    """(q, rank) of every item that has a partner in its group: rank of the best partner within k, else null."""
    items = crops.select(F.col("crop_id").alias("id"), "v")
    groups = crops.select(F.col("crop_id").alias("id"), "page_id")
    n = groups.groupBy("page_id").agg(F.count("*").alias("n"))
    eligible = groups.join(n, "page_id").where("n > 1").select(F.col("id").alias("q"), F.col("page_id").alias("q_page"))
    near = topk(items, items, k).join(groups, "id").join(eligible, "q").where("page_id = q_page")
    best = near.groupBy("q").agg(F.min("rank").alias("rank"))
    return eligible.select("q").join(best, "q", "left")


def recall_items(crops: DataFrame, ks=KS) -> DataFrame:
    return recalls(first_partner(crops, max(ks)), ks)


def vector_sum(df: DataFrame, *keys: str, v: str = "v") -> DataFrame:
    """(keys, s, sq, n): component sums, sum of squared norms and count; partial sums are made before the shuffle."""
    cells = df.select(*keys, F.posexplode(v).alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    made = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("c"), F.sum("q").alias("sq"), F.max("n").alias("n"))
    return made.select(*keys, F.transform("c", lambda x: x["s"]).alias("s"), "sq", "n")


def group_gallery(crops: DataFrame, group: str = "page_id", v: str = "v") -> DataFrame:
    """(group, g): the normalised sum of the members."""
    return vector_sum(crops, group, v=v).select(group, C.l2_normalize(F.col("s")).alias("g"))


def sim_sanity(crops: DataFrame) -> DataFrame:
    """Mean similarity within and between groups, without making pairs: from sums and squared norms of groups."""
    g = vector_sum(crops, "page_id").select("page_id", "s", "sq", "n", C.dot(F.col("s"), F.col("s")).alias("ss"))
    same = g.groupBy().agg(F.sum(F.col("ss") - F.col("sq")).alias("same_sum"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same_n"))
    all_ = vector_sum(crops.withColumn("one", F.lit(1)), "one").select((C.dot(F.col("s"), F.col("s")) - F.col("sq")).alias("all_sum"), (F.col("n") * (F.col("n") - 1)).alias("all_n"))
    both = same.crossJoin(all_)  # one row each
    a, b = F.col("same_sum") / F.nullif(F.col("same_n"), F.lit(0)), (F.col("all_sum") - F.col("same_sum")) / F.nullif(F.col("all_n") - F.col("same_n"), F.lit(0))
    return both.select(F.round(a, 6).alias("same_mean"), F.round(b, 6).alias("diff_mean"), F.round(F.coalesce(a - b, F.lit(0.0)), 6).alias("gap"))


def monotonic(found: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(monotonic): whether recall never falls as k grows; ``found`` is a few rows (k, ..., recall)."""
    ordered = F.array_sort(F.collect_list(F.struct("k", "recall")))
    steps = F.transform("r", lambda x, i: (i == 0) | (x["recall"] + tolerance >= F.get("r", i - 1)["recall"]))
    return found.groupBy().agg(ordered.alias("r")).select(F.forall(steps, lambda x: x).alias("monotonic"))


def item_report(crops: DataFrame, ks=KS) -> DataFrame:
    """One row for an item-level evaluation: crops, pages, similarity means, their gap, and whether recall is monotonic in k."""
    sizes = crops.groupBy().agg(F.count("*").alias("crops"), F.count_distinct("page_id").alias("pages"))
    return sizes.crossJoin(sim_sanity(crops)).crossJoin(monotonic(recall_items(crops, ks)))  # one row each


def loo_scores(crops: DataFrame) -> DataFrame:
    """(crop_id, page_id, own, better, others, pages, n): of each item the leave-one-out similarity to its own group, how many other
    groups come before it, the sum of similarities to other groups, and sizes.

    The gallery has a row for each group and is joined by blocks of items with blocks of groups; the own column is in closed form.
    """
    sums = vector_sum(crops, "page_id").select("page_id", "s", "n")
    c_s, c_c, s_s = C.dot(F.col("v"), F.col("s")), C.dot(F.col("v"), F.col("v")), C.dot(F.col("s"), F.col("s"))
    own = (c_s - c_c) / F.sqrt(F.greatest(s_s - 2 * c_s + c_c, F.lit(C.EPS**2)))
    items = crops.join(sums, "page_id").select("crop_id", "page_id", "v", "n", F.round(own, 9).alias("own"))
    gallery = sums.select(F.col("page_id").alias("id"), C.l2_normalize(F.col("s")).alias("v"))
    size = gallery.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    schema = "crop_id long, page_id long, n long, own double, better long, others double, pages long"
    if size.n * (size.d or 0) > 8_000_000:
        return _loo_blocked(items, gallery, size.n)
    frame = gallery.toPandas().sort_values("id")
    shared = crops.sparkSession.sparkContext.broadcast((frame["id"].to_numpy(np.int64), _matrix(frame["v"])))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, g = shared.value
        for f in frames:
            for a in range(0, len(f), 1024):
                p = f.iloc[a : a + 1024]
                s = _matrix(p["v"]) @ g.T
                r, mine = np.round(s, 9), ids[None, :] == p["page_id"].to_numpy()[:, None]
                own = p["own"].to_numpy()[:, None]
                ahead = ((r > own) | ((r == own) & (ids[None, :] < p["page_id"].to_numpy()[:, None]))) & ~mine
                yield pd.DataFrame({"crop_id": p["crop_id"], "page_id": p["page_id"], "n": p["n"], "own": p["own"], "better": ahead.sum(1), "others": np.where(mine, 0, s).sum(1), "pages": len(ids)})

    return items.mapInPandas(run, schema)


def _loo_blocked(items: DataFrame, gallery: DataFrame, n_pages: int) -> DataFrame:
    """The same for a gallery beyond the broadcast bound: counts of each pair of blocks are summed."""
    left = items.select(F.col("crop_id").alias("id"), F.concat(F.array("own", F.col("page_id").cast("double")), "v").alias("v"))

    def count(ai, a, bi, b):
        own, page, s = a[:, 0], a[:, 1].astype(np.int64), a[:, 2:] @ b.T
        r, mine = np.round(s, 9), bi[None, :] == page[:, None]
        ahead = ((r > own[:, None]) | ((r == own[:, None]) & (bi[None, :] < page[:, None]))) & ~mine
        return pd.DataFrame({"crop_id": ai, "better": ahead.sum(1), "others": np.where(mine, 0, s).sum(1)})

    sums = blocked(left, gallery, count, "crop_id long, better long, others double").groupBy("crop_id").agg(F.sum("better").alias("better"), F.sum("others").alias("others"))
    return items.drop("v").join(sums, "crop_id").withColumn("pages", F.lit(n_pages).cast("long"))


def recall_loo_groups(crops: DataFrame, ks=KS) -> DataFrame:
    """Leave-one-out group retrieval: items of groups with two members or more look for their own group without themselves."""
    return recalls(loo_scores(crops).where("n > 1").select((F.col("better") + 1).alias("rank")), ks)


def loo_sanity(crops: DataFrame) -> DataFrame:
    s = loo_scores(crops).where("n > 1")
    other = F.col("others") / F.greatest(F.lit(1), F.col("pages") - 1)
    out = s.groupBy().agg(F.avg("own").alias("own"), F.avg(other).alias("other"), F.count("*").alias("queries"))
    return out.select("queries", F.round("own", 6).alias("own_mean"), F.round("other", 6).alias("other_mean"), F.round(F.col("own") - F.col("other"), 6).alias("gap"))


def recall_group_mean(crops: DataFrame, ks=KS) -> DataFrame:
    """Item to group sums, the item itself left in."""
    gallery = group_gallery(crops).select(F.col("page_id").alias("id"), F.col("g").alias("v"))
    near = topk(crops.select(F.col("crop_id").alias("id"), "v"), gallery, max(ks), exclude_self=False)
    mine = crops.select(F.col("crop_id").alias("q"), "page_id").join(near, "q", "left").groupBy("q").agg(F.min(F.when(F.col("id") == F.col("page_id"), F.col("rank"))).alias("rank"))
    return recalls(mine, ks)


def triplet_scores(triplets: DataFrame, queries: DataFrame, pool: DataFrame) -> DataFrame:
    """(anchor, member, role, sim, rank) over valid triplets: members that exist, at least one of each role."""
    q = queries.select(F.col("crop_id").alias("anchor"), F.col("v").alias("a"))
    p = pool.select(F.col("crop_id").alias("member"), F.col("v").alias("b"))
    scored = triplets.join(q, "anchor").join(p, "member").select("anchor", "member", "role", F.round(C.dot(F.col("a"), F.col("b")), 9).alias("sim"))
    w = Window.partitionBy("anchor")
    both = (F.count_if(F.col("role") == "pos").over(w) > 0) & (F.count_if(F.col("role") == "neg").over(w) > 0)
    return scored.withColumn("rank", F.row_number().over(w.orderBy(F.desc("sim"), "member"))).withColumn("_ok", both).where("_ok").drop("_ok")


def triplet_recall(triplets: DataFrame, queries: DataFrame, pool: DataFrame, ks=(1, 5), micro: bool = False) -> DataFrame:
    """(k, hits, total, recall, pos_mean, neg_mean): means of triplets' means, or of all pairs if ``micro``."""
    s = triplet_scores(triplets, queries, pool)
    per = s.groupBy("anchor").agg(F.min(F.when(F.col("role") == "pos", F.col("rank"))).alias("rank"), *[f(F.when(F.col("role") == r, F.col("sim"))).alias(f"{r}_{n}") for r in ("pos", "neg") for f, n in ((F.avg, "avg"), (F.sum, "sum"), (F.count, "n"))])
    mean = (lambda r: F.sum(f"{r}_sum") / F.sum(f"{r}_n")) if micro else (lambda r: F.avg(f"{r}_avg"))
    return recalls(per, ks).crossJoin(per.groupBy().agg(F.round(mean("pos"), 6).alias("pos_mean"), F.round(mean("neg"), 6).alias("neg_mean")))


def triplet_report(triplets: DataFrame, queries: DataFrame, pool: DataFrame, ks=(1, 5)) -> DataFrame:
    """One row for a triplet evaluation: anchors, valid and skipped triplets, members before the existence filter, similarity means, their
    gap (0 if one is undefined), and whether recall is monotonic in k."""
    asked = triplets.groupBy().agg(F.count_distinct("anchor").alias("anchors"), F.count("*").alias("pool"))
    found = written(triplet_recall(triplets, queries, pool, ks), "triplets")
    one = found.groupBy().agg(F.max("total").alias("valid"), F.max("pos_mean").alias("pos_mean"), F.max("neg_mean").alias("neg_mean"))
    both = asked.crossJoin(one).crossJoin(monotonic(found))  # one row each
    gap = F.round(F.coalesce(F.col("pos_mean") - F.col("neg_mean"), F.lit(0.0)), 6)
    return both.select("anchors", "pool", "valid", (F.col("anchors") - F.col("valid")).alias("skipped"), "pos_mean", "neg_mean", gap.alias("gap"), "monotonic")


def triplet_recall_delta(triplets: DataFrame, original: DataFrame, perturbed: DataFrame, ks=(1, 5)) -> DataFrame:
    a = triplet_recall(triplets, original, original, ks).select("k", F.col("recall").alias("original"))
    b = triplet_recall(triplets, perturbed, perturbed, ks).select("k", F.col("recall").alias("perturbed"))
    return a.join(b, "k", "full").withColumn("delta", F.round(F.col("perturbed") - F.col("original"), 6))


def recall_paired(a: DataFrame, b: DataFrame, ks=KS) -> DataFrame:
    """Row i of a should find row i of b; diagonal and off-diagonal means come from sums."""
    left, right = (x.select(F.col("crop_id").alias("id"), "v") for x in (a, b))
    near = topk(left, right, max(ks), exclude_self=False).where("q = id").select("q", "rank")
    ranks = left.select(F.col("id").alias("q")).join(near, "q", "left")
    diag = left.join(right.withColumnRenamed("v", "w"), "id").groupBy().agg(F.sum(C.dot(F.col("v"), F.col("w"))).alias("diag"), F.count("*").alias("n"))
    s, t = (vector_sum(x.withColumn("one", F.lit(1)), "one").select(F.col("s").alias(name)) for x, name in ((left, "s"), (right, "t")))
    means = diag.crossJoin(s).crossJoin(t).select((F.col("diag") / F.col("n")).alias("d"), ((C.dot(F.col("s"), F.col("t")) - F.col("diag")) / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0))).alias("o"))
    return recalls(ranks, ks).crossJoin(means.select(F.round("d", 6).alias("diag_mean"), F.round("o", 6).alias("off_mean"), F.round(F.col("d") - F.col("o"), 6).alias("gap")))


def late_interaction(tokens: DataFrame, ks=(1, 5)) -> DataFrame:
    return recalls(late.pages_ahead(tokens).select((F.col("ahead") + 1).alias("rank")), ks)


def late_sanity(tokens: DataFrame) -> DataFrame:
    return late.mean_scores(tokens)


def sim_decompose(crops: DataFrame, parts: dict[str, tuple[int, int]]) -> DataFrame:
    """(part, same_mean, diff_mean) over disjoint dimension ranges; the parts sum to the whole."""
    out = None
    for name, (start, n) in parts.items():
        one = sim_sanity(crops.withColumn("v", C.dims(F.col("v"), start, n))).select(F.lit(name).alias("part"), "same_mean", "diff_mean")
        out = one if out is None else out.unionByName(one)
    return out


def patch_match(anchor: DataFrame, positive: DataFrame, negative: DataFrame, k: int, side: int) -> DataFrame:
    """Per pair: each anchor patch's nearest positive and farthest negative patch; the k most confident, with boxes on a grid.

    Inputs are (pair, patch, t); a pair's patches are few.
    """
    a = anchor.select("pair", "patch", F.col("t").alias("a"))
    sims = lambda other: a.join(other.select("pair", F.col("patch").alias("o"), F.col("t").alias("b")), "pair").select("pair", "patch", "o", F.round(C.dot(F.col("a"), F.col("b")), 9).alias("s"))
    pos = sims(positive).groupBy("pair", "patch").agg(F.max_by("o", F.struct("s", -F.col("o"))).alias("pos_patch"), F.max("s").alias("pos_sim"))
    neg = sims(negative).groupBy("pair", "patch").agg(F.min_by("o", F.struct("s", "o")).alias("neg_patch"), F.min("s").alias("neg_sim"))
    both = pos.join(neg, ["pair", "patch"])
    r = F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("pos_sim"), "patch"))
    both = both.withColumn("r", r).where(F.col("r") <= k)
    return both.select("pair", "patch", "pos_patch", "neg_patch", F.round("pos_sim", 6).alias("pos_sim"), F.round("neg_sim", 6).alias("neg_sim"), F.floor(F.col("patch") / side).alias("box_row"), (F.col("patch") % side).alias("box_col"))


def mean_pool(tokens: DataFrame, mask) -> DataFrame:
    """(crop_id, g): the normalised mean of the unmasked tokens; a sum has the same direction."""
    return group_gallery(tokens.where(mask), "crop_id", "t")


def concat_features(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key, F.col("v").alias("x")).join(b.select(key, F.col("v").alias("y")), key).select(key, C.l2_normalize(F.concat("x", "y")).alias("v"))
