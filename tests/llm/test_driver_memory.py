"""What finished jobs hold in the driver goes with the tables they made."""

from __future__ import annotations

from embedlens.llm.shared import Scratch


def full_collections(spark) -> int:
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return [b.getCollectionCount() for b in beans][-1]  # the old generation's collector comes last


def test_drop_collects_what_jobs_held(spark):
    scratch = Scratch(spark, "drops")
    table = scratch.stash(spark.range(10))
    before = full_collections(spark)
    scratch.drop(table)
    assert full_collections(spark) > before
