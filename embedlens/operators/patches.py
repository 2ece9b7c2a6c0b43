"""Assignment and aggregation over patches, saliency and word matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embedlens.functions import columns as C
from embedlens.functions.encode import named
from embedlens.operators.contrastive import log_sum_exp


def ot_assign(scores: DataFrame, clusters: int, patches: int, dustbin: float, iterations: int = 3) -> DataFrame:
    """(item, patch, cluster, p): balanced assignment by log-domain Sinkhorn. Clusters have mass 1, the dustbin (number ``clusters``)
    patches - clusters, every patch 1; rows, then columns, so patches are exact. Needs patches > clusters.

    ``scores`` is (item, patch, cluster, score), complete for each item.
    """
    if patches <= clusters:
        raise ValueError("more patches than clusters are needed")
    import math

    bin_rows = scores.select("item", "patch").distinct().select("item", "patch", F.lit(clusters).alias("cluster"), F.lit(float(dustbin)).alias("score"))
    out = scores.select("item", "patch", F.col("cluster").cast("int").alias("cluster"), F.col("score").cast("double").alias("score")).unionByName(bin_rows).withColumn("m", F.col("score"))
    out = out.repartition("item")  # all windows below lie within an item
    mass = F.when(F.col("cluster") == clusters, F.lit(math.log(patches - clusters))).otherwise(F.lit(0.0))
    for _ in range(iterations):
        out = out.withColumn("m", F.col("m") - log_sum_exp(F.col("m"), "item", "cluster") + mass)
        out = out.withColumn("m", F.col("m") - log_sum_exp(F.col("m"), "item", "patch"))
    return out.select("item", "patch", "cluster", F.exp("m").alias("p"))


def dustbin_mass(p: DataFrame, dustbin: int) -> DataFrame:
    t = F.sum("p")
    return p.groupBy("item").agg(F.when(t > 0, F.round(F.sum(F.when(F.col("cluster") == dustbin, F.col("p")).otherwise(0.0)) / t, 6)).alias("dustbin"))


def softmax_assign(scores: DataFrame) -> DataFrame:
    return scores.select("item", "patch", "cluster", F.exp(F.col("score") - log_sum_exp(F.col("score"), "item", "patch")).alias("p"))


def weighted_aggregate(p: DataFrame, features: DataFrame, clusters: int, global_part: DataFrame | None = None, mode: str = "full") -> DataFrame:
    """(item, i, value): per cluster the sum of p * f, normalised, flattened with the global part in front, normalised.

    ``features`` is (item, patch, f); ``global_part`` (item, g). mode: full, vlad_only, token_only.
    """
    cells = p.where(F.col("cluster") < clusters).join(features, ["item", "patch"]).select("item", "cluster", "p", F.posexplode("f").alias("d", "x"))
    cells = cells.groupBy("item", "cluster", "d").agg(F.sum(F.col("p") * F.col("x")).alias("x"))
    size = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("item", "cluster")))
    vlad = cells.withColumn("x", F.col("x") / F.greatest(size, F.lit(C.EPS))).select("item", F.lit(1).alias("part"), F.col("cluster").alias("c"), "d", "x")
    parts = vlad if mode != "token_only" else None
    if mode != "vlad_only" and global_part is not None:
        token = global_part.select("item", F.lit(0).alias("part"), F.lit(0).alias("c"), F.posexplode(C.l2_normalize(F.col("g"))).alias("d", "x"))
        parts = token if parts is None else token.unionByName(parts)
    w = Window.partitionBy("item")
    whole = F.sqrt(F.sum(F.col("x") * F.col("x")).over(w))
    return parts.select("item", (F.row_number().over(w.orderBy("part", "c", "d")) - 1).cast("long").alias("i"), (F.col("x") / F.greatest(whole, F.lit(C.EPS))).alias("value"))


def top_cluster(p: DataFrame) -> DataFrame:
    mass = p.groupBy("item", "cluster").agg(F.round(F.sum("p"), 9).alias("mass"))
    return mass.groupBy("item").agg(F.max_by("cluster", F.struct("mass", -F.col("cluster"))).alias("cluster"))


def weight_stats(weights: DataFrame, item: str, w: str) -> DataFrame:
    return weights.groupBy(item).agg(F.round(F.avg(w), 6).alias("mean"), F.round(F.max(w), 6).alias("max"), F.round(-F.sum(F.col(w) * F.log(F.greatest(F.col(w), F.lit(C.EPS)))), 6).alias("entropy"))


def patch_saliency(patches: DataFrame, summary: DataFrame) -> DataFrame:
    """(item, patch, saliency): cosine of an item's summary vector and each patch."""
    j = patches.join(summary, "item")
    return j.select("item", "patch", (C.dot(F.col("f"), F.col("g")) / F.greatest(C.norm(F.col("f")) * C.norm(F.col("g")), F.lit(C.EPS))).alias("saliency"))


def _first_token(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("item").agg(F.min_by("f", "patch").alias("g"))


def _mean_token(tokens: DataFrame) -> DataFrame:
    cells = tokens.select("item", F.posexplode("f").alias("i", "x")).groupBy("item", "i").agg(F.sum("x").alias("x"))
    return cells.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("g"))


def _strongest_token(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("item").agg(F.max_by("f", F.struct(F.round(C.norm(F.col("f")), 9), -F.col("patch"))).alias("g"))


#: Saliency by name: what summary vector patches are compared with. A user adds their own: tokens (item, patch, f) to (item, g).
SALIENCY = {"first": _first_token, "mean": _mean_token, "strongest": _strongest_token}


def saliency_by_name(tokens: DataFrame, name: str) -> DataFrame:
    """(item, patch, saliency) of tokens (item, patch, f); an unknown name raises with the known ones."""
    return patch_saliency(tokens, named(SALIENCY, name)(tokens))


def region_mean(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """(item, box, value): area-weighted mean of the min-max normalised unit cells under a box; 0 if nothing lies under it.

    ``cells`` (item, r, c, value), ``boxes`` (item, box, x0, y0, x1, y1) in cell units. A box is dealt to the rows it overlaps, so the
    range join is an equi-join on (item, row) with a check of columns.
    """
    w = Window.partitionBy("item")
    low, high = F.min("value").over(w), F.max("value").over(w)
    cells = cells.withColumn("v", F.coalesce((F.col("value") - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)))
    dealt = boxes.where("y1 > y0 and x1 > x0").withColumn("r", F.explode(F.sequence(F.floor("y0"), F.ceil("y1") - 1)))
    j = dealt.join(cells.select("item", "r", "c", "v"), ["item", "r"]).where("c < x1 and c + 1 > x0")
    area = (F.least("x1", F.col("c") + 1) - F.greatest("x0", "c")) * (F.least("y1", F.col("r") + 1) - F.greatest("y0", "r"))
    mean = j.withColumn("a", area).groupBy("item", "box").agg((F.sum(F.col("a") * F.col("v")) / F.sum("a")).alias("m"))
    return boxes.select("item", "box").join(mean, ["item", "box"], "left").select("item", "box", F.round(F.coalesce("m", F.lit(0.0)), 6).alias("value"))


MARKS = ",.;:!?\"'()[]"


def word_table(df: DataFrame, key: str, text: str, cap: int | None = None) -> DataFrame:
    """(key, pos, word): all words (the first ``cap``, if that is given), lower-cased, marks stripped at both ends; emptied words are left out."""
    words = F.filter(F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[ \\t\\n\\r\\x0b\\f]+", " "), " "), lambda w: w != "")
    words = words if cap is None else F.slice(words, 1, cap)
    t = df.select(key, F.posexplode(words).alias("pos", "w"))
    return t.select(key, F.col("pos").cast("long").alias("pos"), F.btrim(F.lower("w"), F.lit(MARKS)).alias("word")).where("word <> ''")


def first_word_value(words: DataFrame, key: str, value: str = "value") -> DataFrame:
    return words.groupBy(key, "word").agg(F.min_by(value, "pos").alias(value))


def matched_words(boxes: DataFrame, values: DataFrame, key: str, least: int = 5) -> DataFrame:
    """Words of pages with enough boxes, joined to values; pages with enough matches."""
    enough = boxes.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(key)
    j = boxes.join(enough, key, "left_semi").join(values, [key, "word"])
    kept = j.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(key)
    return j.join(kept, key, "left_semi")


def matched_vocab(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Number of distinct words that both texts of a page have; no marks are stripped here."""
    words = lambda c: F.filter(F.array_distinct(F.split(F.lower(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "[ \\t\\n\\r\\x0b\\f]+", " ")), " ")), lambda w: w != "")
    return a.select(key, words("text").alias("x")).join(b.select(key, words("text").alias("y")), key).select(key, F.size(F.array_intersect("x", "y")).cast("long").alias("matched"))
