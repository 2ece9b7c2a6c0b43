"""Contrastive-batch diagnostics and objective values over (batch_id, id, page_id, v). A batch is of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embedlens.functions import columns as C


def batch_pairs(batch: DataFrame) -> DataFrame:
    """(batch_id, a, b, same, s) of different members."""
    a = batch.select("batch_id", F.col("id").alias("a"), F.col("page_id").alias("pa"), F.col("v").alias("va"))
    b = batch.select("batch_id", F.col("id").alias("b"), F.col("page_id").alias("pb"), F.col("v").alias("vb"))
    return a.join(b, "batch_id").where("a <> b").select("batch_id", "a", "b", (F.col("pa") == F.col("pb")).alias("same"), C.dot(F.col("va"), F.col("vb")).alias("s"))


def _mean(condition: Column, value: Column) -> Column:
    return F.avg(F.when(condition, value))


def batch_stats(batch: DataFrame, threshold: float | None = None) -> DataFrame:
    """positives and negatives of a query, mean similarities, share of negatives above the threshold (the mean positive by default)."""
    p = batch_pairs(batch)
    w = Window.partitionBy("batch_id")
    limit = F.lit(threshold) if threshold is not None else F.coalesce(_mean(F.col("same"), F.col("s")).over(w), F.lit(0.0))
    p = p.withColumn("hard", (~F.col("same") & (F.round("s", 9) > F.round(limit, 9))))
    n = F.countDistinct("a")
    return p.groupBy("batch_id").agg(F.round(F.count_if("same") / n, 6).alias("positives"), F.round(F.count_if(~F.col("same")) / n, 6).alias("negatives"), F.round(_mean(F.col("same"), F.col("s")), 6).alias("pos_mean"), F.round(_mean(~F.col("same"), F.col("s")), 6).alias("neg_mean"), F.round(F.count_if("hard") / F.nullif(F.count_if(~F.col("same")), F.lit(0)), 6).alias("hard_fraction"))


def batch_stats_mean(stats: DataFrame) -> DataFrame:
    return stats.groupBy().agg(F.count("*").alias("batches"), *[F.round(F.avg(c), 6).alias(c) for c in ("positives", "negatives", "pos_mean", "neg_mean", "hard_fraction")])


def log_sum_exp(x: Column, *keys: str) -> Column:
    """Over a window of ``keys``; null where all are null."""
    w = Window.partitionBy(*keys)
    m = F.max(x).over(w)
    return m + F.log(F.sum(F.exp(x - m)).over(w))


def loss_infonce(batch: DataFrame, tau: float = 0.07) -> DataFrame:
    p = batch_pairs(batch).withColumn("z", F.col("s") / tau)
    p = p.withColumn("lse", log_sum_exp(F.when(~F.col("same"), F.col("z")), "batch_id", "a")).where("same and lse is not null")
    per = p.groupBy("batch_id", "a").agg(F.avg(C.softplus(F.col("lse") - F.col("z"))).alias("l"))
    return _loss(batch, per, "l")


def _loss(batch: DataFrame, per: DataFrame, value: str) -> DataFrame:
    """Mean over anchors of a batch; 0 where no anchor counts."""
    found = per.groupBy("batch_id").agg(F.avg(value).alias("l"))
    return batch.select("batch_id").distinct().join(found, "batch_id", "left").select("batch_id", F.round(F.coalesce("l", F.lit(0.0)), 6).alias("loss"))


def loss_multisim(batch: DataFrame, alpha: float = 2.0, beta: float = 50.0, base: float = 0.5, margin: float = 0.1) -> DataFrame:
    """Multi-similarity with mined pairs; anchors without pairs on a side are left out."""
    w = Window.partitionBy("batch_id", "a")
    same, s = F.col("same"), F.col("s")
    p = batch_pairs(batch).withColumn("max_neg", F.max(F.when(~same, s)).over(w)).withColumn("min_pos", F.min(F.when(same, s)).over(w))
    r = lambda c: F.round(c, 9)
    keep_pos, keep_neg = same & (r(s) < r(F.col("max_neg") + margin)), ~same & (r(s) > r(F.col("min_pos") - margin))
    per = p.groupBy("batch_id", "a").agg(F.sum(F.when(keep_pos, F.exp(-alpha * (s - base)))).alias("p"), F.sum(F.when(keep_neg, F.exp(beta * (s - base)))).alias("n")).where("p is not null and n is not null")
    return _loss(batch, per.withColumn("l", F.log1p("p") / alpha + F.log1p("n") / beta), "l")


def loss_triplet(batch: DataFrame, margin: float = 0.2) -> DataFrame:
    per = batch_pairs(batch).groupBy("batch_id", "a").agg(F.min(F.when(F.col("same"), F.col("s"))).alias("p"), F.max(F.when(~F.col("same"), F.col("s"))).alias("n")).where("p is not null and n is not null")
    return _loss(batch, per.withColumn("l", C.relu((1 - F.col("p")) - (1 - F.col("n")) + margin)), "l")


def loss_paired(a: DataFrame, b: DataFrame, tau: float = 0.07) -> DataFrame:
    """Symmetric cross-entropy of paired views (batch_id, id, v) within a batch."""
    x = a.select("batch_id", F.col("id").alias("i"), F.col("v").alias("x"))
    y = b.select("batch_id", F.col("id").alias("j"), F.col("v").alias("y"))
    z = x.join(y, "batch_id").select("batch_id", "i", "j", (C.dot(F.col("x"), F.col("y")) / tau).alias("z"))
    z = z.withColumn("r", log_sum_exp(F.col("z"), "batch_id", "i")).withColumn("c", log_sum_exp(F.col("z"), "batch_id", "j")).where("i = j")
    return z.groupBy("batch_id").agg(F.round(F.avg((F.col("r") + F.col("c")) / 2 - F.col("z")), 6).alias("loss"))


def top1_accuracy(batch: DataFrame) -> DataFrame:
    """Share of members whose nearest other member has their page."""
    best = batch_pairs(batch).groupBy("batch_id", "a").agg(F.max_by("same", F.struct(F.round("s", 9), -F.col("b"))).alias("hit"))
    return best.groupBy("batch_id").agg(F.count_if("hit").alias("hits"), F.count("*").alias("total"), F.round(F.count_if("hit") / F.count("*"), 6).alias("accuracy"))


LOSSES = {"infonce": loss_infonce, "multisim": loss_multisim, "triplet": loss_triplet}


def build_loss(name: str, **kw):
    """A named objective with its parameters."""
    from embedlens.functions.encode import named

    f = named(LOSSES, name)
    return lambda batch: f(batch, **kw)
