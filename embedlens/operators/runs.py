"""Rank statistics and roll-ups of experiment logs."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embedlens.sources.shared import written


#: Rows of a group that one task ranks; groups beyond it are ranked by ranges.
GROUP_ROWS = 1_000_000


def _largest(df: DataFrame, *keys: str) -> int:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def ranked_values(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, value, n, before): every distinct value of a group (nulls first) with its rows and the rows of smaller ones.

    Equal values are counted before the shuffle. Values are dealt by ranges of (keys, value), so a group is ranked in as many tasks as it
    needs; what lies in earlier ranges is added from one row for each range and group in it.
    """
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    # written once: range bounds are sampled anew in each execution, and both uses must see the same partitions
    parts = written(counted.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()), "ranks")
    ends = Window.partitionBy(*keys).orderBy("_part")
    sums = parts.groupBy("_part", *keys).agg(F.sum("n").alias("_n")).select("_part", *[F.col(k).alias(f"_{k}") for k in keys], (F.sum("_n").over(ends) - F.col("_n")).alias("_earlier"))
    inside = F.sum("n").over(Window.partitionBy("_part", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    same = reduce(lambda a, b: a & b, [parts[k].eqNullSafe(sums[f"_{k}"]) for k in keys], parts["_part"] == sums["_part"])
    return parts.withColumn("_inside", inside).join(sums, same).select(*keys, value, "n", (F.col("_inside") + F.col("_earlier")).alias("before"))


def average_rank(df: DataFrame, value: str, name: str, *keys: str) -> DataFrame:
    """Adds the rank of ``value`` within ``keys``; ties share their mean rank. Groups of more than ``GROUP_ROWS`` rows are ranked by ranges."""
    if _largest(df, *keys) <= GROUP_ROWS:
        w = Window.partitionBy(*keys)
        return df.withColumn(name, F.rank().over(w.orderBy(value)) + (F.count("*").over(w.partitionBy(*keys, value)) - 1) / 2)
    ranks = ranked_values(df, value, *keys).select(*[F.col(c).alias(f"_of_{c}") for c in (*keys, value)], (F.col("before") + (F.col("n") + 1) / 2).alias(name))
    same = reduce(lambda a, b: a & b, [df[c].eqNullSafe(ranks[f"_of_{c}"]) for c in (*keys, value)])
    return df.join(ranks, same).select(*df.columns, name)


def medians(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group, median): exact; the one or two middle values of each group, by their ranks."""
    cells = ranked_values(df.where(F.col(value).isNotNull()), value, group)
    totals = cells.groupBy(F.col(group).alias("_g")).agg(F.sum("n").alias("_total"))
    both = cells.join(totals, cells[group].eqNullSafe(totals["_g"]))
    low, high = F.floor((F.col("_total") + 1) / 2), F.ceil((F.col("_total") + 1) / 2)
    holds = lambda r: (F.col("before") < r) & (r <= F.col("before") + F.col("n"))
    middle = both.where(holds(low) | holds(high)).groupBy(group)
    return middle.agg(((F.min(value) + F.max(value)) / 2).alias("median"))


def spearman(df: DataFrame, group: str, x: str, y: str, least: int = 2) -> DataFrame:
    """(group, n, rho): null where a side is constant."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = average_rank(average_rank(d, x, "_rx", group), y, "_ry", group)
    a = d.groupBy(group).agg(F.count("*").alias("n"), F.stddev_pop("_rx").alias("sx"), F.stddev_pop("_ry").alias("sy"), F.covar_pop("_rx", "_ry").alias("c")).where(F.col("n") >= least)
    return a.select(group, "n", F.when((F.col("sx") > 0) & (F.col("sy") > 0), F.round(F.col("c") / (F.col("sx") * F.col("sy")), 6) + F.lit(0.0)).alias("rho"))


def with_p(rhos: DataFrame, rho: str = "rho", n: str = "n") -> DataFrame:
    """Adds ``p``: two-sided, by Student's t with n - 2 degrees of freedom; null without rho or below 3 rows, 0 at |rho| = 1."""

    @F.pandas_udf("double")
    def p_value(r: pd.Series, count: pd.Series) -> pd.Series:
        r, v = r.to_numpy(np.float64), count.to_numpy(np.float64) - 2
        out = np.full(len(r), np.nan)
        sure = (v > 0) & (np.abs(r) >= 1)
        open_ = (v > 0) & (np.abs(r) < 1)
        out[sure] = 0.0
        out[open_] = student_tail(np.abs(r[open_]), v[open_])
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    return rhos.withColumn("p", p_value(F.col(rho).cast("double"), F.col(n)))


def student_tail(r: np.ndarray, v: np.ndarray, nodes: int = 200) -> np.ndarray:
    """Two-sided p of Student's t = r * sqrt(v / (1 - r * r)) with v degrees of freedom, for 0 <= r < 1.

    It is the integral of cos**(v - 1) from asin(r) to pi / 2 over that from 0, by Gauss-Legendre quadrature where the integrand is not
    negligible.
    """
    if not len(r):
        return np.zeros(0)
    points, weights = np.polynomial.legendre.leggauss(nodes)
    low, v = np.arcsin(r)[:, None], v[:, None]
    width = np.minimum(np.pi / 2 - low, 14 / np.sqrt(v))
    phi = low + width * (points + 1) / 2
    norm = np.array([math.lgamma((x + 1) / 2) - math.lgamma(x / 2) for x in v[:, 0]])
    logs = (v - 1) * np.log(np.maximum(np.cos(phi), 1e-300)) + norm[:, None]
    return np.minimum(1.0, (weights * np.exp(logs)).sum(1) * width[:, 0] / np.sqrt(np.pi))


def rho_summary(rhos: DataFrame, group: str, rho: str = "rho") -> DataFrame:
    """mean, median, population deviation, count; groups without rho are left out. Medians of large groups come from ranks by ranges."""
    found = rhos.where(F.col(rho).isNotNull())
    columns = [F.round(F.avg(rho), 6).alias("mean"), F.round(F.stddev_pop(rho), 6).alias("std"), F.count("*").alias("n")]
    if _largest(found, group) <= GROUP_ROWS:
        return found.groupBy(group).agg(columns[0], F.round(F.median(rho), 6).alias("median"), *columns[1:])
    middle = medians(found, rho, group).withColumnRenamed(group, "_group")
    rest = found.groupBy(group).agg(*columns)
    return rest.join(middle, rest[group].eqNullSafe(middle["_group"])).select(group, "mean", F.round("median", 6).alias("median"), "std", "n")


def latest_run(runs: DataFrame, configs: DataFrame, pattern: str) -> DataFrame:
    """The last name that matches and has a config."""
    return runs.where(F.col("name").rlike(pattern)).join(configs.select("name"), "name", "left_semi").orderBy(F.desc("name")).limit(1)


def first_available(df: DataFrame, key: str, choice: str, value: str, priority: list) -> DataFrame:
    """Per key the value of the first choice in the list that it has."""
    place = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(choice))
    return df.withColumn("_p", place).where("_p > 0").groupBy(key).agg(F.min_by(F.struct(choice, value), "_p").alias("r")).select(key, F.col(f"r.{choice}").alias(choice), F.col(f"r.{value}").alias(value))


def report_rows(expected: DataFrame, found: DataFrame, keys: list[str], value: str, placeholder: str = "-") -> DataFrame:
    return expected.join(found, keys, "left").withColumn(value, F.coalesce(F.col(value).cast("string"), F.lit(placeholder)))


def delta_table(df: DataFrame, key: str, kind: str, value: str, original: str, perturbed: str) -> DataFrame:
    pick = lambda k: F.max(F.when(F.col(kind) == k, F.col(value)))
    return df.groupBy(key).agg(pick(original).alias("original"), pick(perturbed).alias("perturbed")).withColumn("delta", F.round(F.col("perturbed") - F.col("original"), 6))


def grid_pivot(df: DataFrame, names: list[str], value: str = "value") -> DataFrame:
    """Rows (a, b, value) in either order of a and b, as a square table with a column for each name."""
    both = df.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), value)
    square = both.select(F.col("x").alias("a"), F.col("y").alias("b"), value).union(both.where("x <> y").select("y", "x", value))
    return square.groupBy("a").pivot("b", names).agg(F.max(value))


def best_alignment(df: DataFrame, encoders: DataFrame) -> DataFrame:
    """(enc, best, partner): an encoder's largest value over its partners; 0 and null without one."""
    both = df.select(F.col("a").alias("enc"), F.col("b").alias("partner"), "value").union(df.select("b", "a", "value"))
    top = both.where("value > 0").groupBy("enc").agg(F.max("value").alias("best"), F.max_by("partner", F.struct("value", "partner")).alias("partner"))
    return encoders.join(top, "enc", "left").withColumn("best", F.coalesce("best", F.lit(0.0)))


def sparse_series(df: DataFrame, *needed: str) -> DataFrame:
    """Rows that have all the fields."""
    for c in needed:
        df = df.where(F.col(c).isNotNull())
    return df


def eval_curve(df: DataFrame, run: str, step: str, value: str, is_eval: Column) -> DataFrame:
    return df.where(is_eval).select(run, step, F.coalesce(value, F.lit(0.0)).alias(value))


def last_with(df: DataFrame, run: str, step: str, field: str) -> DataFrame:
    """(run, step, field) of the last row that has the field."""
    return df.where(F.col(field).isNotNull()).groupBy(run).agg(F.max_by(F.struct(step, field), step).alias("r")).select(run, F.col(f"r.{step}").alias(step), F.col(f"r.{field}").alias(field))


def running_best(df: DataFrame, run: str, step: str, value: str) -> DataFrame:
    """Rows that beat all before them strictly, starting from -1."""
    before = F.max(value).over(Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, -1))
    return df.where(F.col(value).isNotNull()).withColumn("_b", before).where(F.col(value) > F.coalesce("_b", F.lit(-1.0))).drop("_b")


def run_summary(runs: DataFrame, log: DataFrame, results: DataFrame) -> DataFrame:
    """Each run with its last logged value and its result: of several kinds the preferred."""
    best = results.groupBy("run_id").agg(F.min_by(F.struct("kind", "result"), "preference").alias("r")).select("run_id", F.col("r.kind").alias("kind"), F.col("r.result").alias("result"))
    return runs.join(last_with(log, "run_id", "step", "value"), "run_id", "left").join(best, "run_id", "left")


def ladder_summary(runs: DataFrame, name: str, pattern: str, results: DataFrame, key: str) -> DataFrame:
    """Results with a row number parsed from the run's name."""
    number = F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).cast("long")
    return runs.withColumn("row_id", number).where("row_id is not null").join(results, key, "left")
