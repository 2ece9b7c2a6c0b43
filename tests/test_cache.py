"""Bucketed caches: found again by content, joined without moving their rows."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from embedlens.sources import cache


@pytest.fixture
def plain_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def frame(spark, add=0, parts=3):
    return spark.range(500).select(F.col("id").alias("k"), F.array((F.col("id") + add).cast("double"), F.lit(1.0)).alias("v")).repartition(parts)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_joins_of_caches_move_nothing(spark, tmp_path, plain_joins):
    a, b = (cache.bucketed(frame(spark, x), "k", str(tmp_path), buckets=4) for x in (0, 7))
    joined = a.join(b.withColumnRenamed("v", "w"), "k")
    assert joined.count() == 500 and exchanges(joined) == 0
    grouped = a.groupBy("k").agg(F.count("*").alias("n"))
    assert exchanges(grouped) == 0
    other = a.join(frame(spark, 1).withColumnRenamed("v", "w"), "k")
    assert other.count() == 500
    plan = other._jdf.queryExecution().executedPlan().toString()
    assert exchanges(frame(spark, 0).join(frame(spark, 1).withColumnRenamed("v", "w"), "k")) > exchanges(other), plan


def test_content_names_the_cache(spark, tmp_path):
    first = cache.bucketed(frame(spark), "k", str(tmp_path), buckets=4)
    made = {p: p.stat().st_mtime_ns for p in Path(tmp_path).rglob("*.parquet")}
    again = cache.bucketed(frame(spark, parts=5), "k", str(tmp_path), buckets=4)
    assert {p: p.stat().st_mtime_ns for p in Path(tmp_path).rglob("*.parquet")} == made and sorted(map(str, first.collect())) == sorted(map(str, again.collect()))
    (name,) = {p.parent.name for p in made}
    spark.sql(f"DROP TABLE {name}")  # as a later session finds it
    assert cache.bucketed(frame(spark), "k", str(tmp_path), buckets=4).count() == 500
    assert {p.stat().st_mtime_ns for p in Path(tmp_path).rglob("*.parquet")} == set(made.values())
    assert cache.bucketed(frame(spark, 1), "k", str(tmp_path), buckets=4).count() == 500
    assert len({p.parent.name for p in Path(tmp_path).rglob("*.parquet")}) == 2
    assert cache.bucketed(frame(spark).limit(0), "k", str(tmp_path), buckets=4).count() == 0
    assert cache.content_fingerprint(frame(spark)) != cache.content_fingerprint(frame(spark).withColumnRenamed("k", "j"))
