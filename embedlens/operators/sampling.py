"""Deterministic splits and samples by seeded hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embedlens.functions.columns import hash60
from embedlens.sources.shared import written


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """1-based rank over the whole table without one task for all rows: ranges in order, their counts, then ranks inside each.

    ``order`` must decide every tie.
    """
    # written once: range bounds are sampled anew in each execution, and both uses must see the same partitions
    parts = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + inside).cast("long")).drop("_part", "_before")


def deck(df: DataFrame, key: str, seed: str) -> DataFrame:
    """Adds ``rank``: the place in a seeded permutation of the rows."""
    h = df.withColumn("_h", hash60(seed, F.col(key)))
    return global_rank(h, F.col("_h"), F.col(key)).drop("_h")


def seeded_split(df: DataFrame, key: str, n_train: int, n_eval: int, seed: str) -> DataFrame:
    """Adds ``split``: the deck's first n_train rows are train, the next n_eval are eval; the rest is left out."""
    have = df.count()
    if n_train + n_eval > have:
        raise ValueError(f"{n_train} + {n_eval} rows asked of {have}")
    d = deck(df, key, seed)
    return d.where(F.col("rank") <= n_train + n_eval).withColumn("split", F.when(F.col("rank") <= n_train, "train").otherwise("eval"))


def sample_n(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """Exactly n rows, without replacement."""
    return df.withColumn("_h", hash60(seed, F.col(key))).orderBy("_h", key).limit(n).drop("_h")


def deck_slices(df: DataFrame, key: str, slices: list[tuple[str, int, int]], seed: str) -> DataFrame:
    """Adds ``part`` for disjoint ranges (name, first, last] of the deck."""
    d = deck(df, key, seed)
    part = F.lit(None).cast("string")
    for name, a, b in slices:
        part = F.when((F.col("rank") > a) & (F.col("rank") <= b), name).otherwise(part)
    return d.withColumn("part", part).where("part is not null")


def k_per_group(df: DataFrame, group: str, key: str, k: int, seed: str) -> DataFrame:
    """(group, slot, key): k members of each group; all of them, then repeats, where it has fewer."""
    w = Window.partitionBy(group).orderBy("_h", key)
    ranked = df.select(group, key, hash60(seed, F.col(key)).alias("_h")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    n = ranked.groupBy(group).agg(F.count("*").alias("_n"))
    slots = n.select(group, "_n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot"))
    return slots.join(ranked, (slots[group] == ranked[group]) & (F.col("_r") == F.col("slot") % F.col("_n") + 1)).select(slots[group], F.col("slot").cast("long").alias("slot"), key)


def batch_table(df: DataFrame, group: str, key: str, k: int, groups: int, seed: str) -> DataFrame:
    """(batch_id, slot, group, key): shuffled groups, ``groups`` in a batch, k members each; the last partial batch is dropped."""
    g = df.select(group).where(F.col(group).isNotNull()).distinct()
    g = deck(g, group, f"{seed}-g").withColumn("batch_id", F.floor((F.col("rank") - 1) / groups).cast("long"))
    full = g.groupBy("batch_id").agg(F.count("*").alias("_n")).where(F.col("_n") == groups).select("batch_id")
    g = g.join(full, "batch_id", "left_semi")
    members = k_per_group(df, group, key, k, seed).withColumnRenamed("slot", "_s")
    out = g.select(group, "batch_id", "rank").join(members, group)
    return out.select("batch_id", (((F.col("rank") - 1) % groups) * k + F.col("_s")).cast("long").alias("slot"), group, key)


def leakfree_split(df: DataFrame, cluster: str, eval_percent: int, seed: str) -> DataFrame:
    """Adds ``split`` by cluster hash, so that no cluster is on both sides."""
    return df.withColumn("split", F.when(F.pmod(hash60(seed, F.col(cluster)), F.lit(100)) < eval_percent, "eval").otherwise("train"))
