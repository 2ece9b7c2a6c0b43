"""Tables written to the folder that driver and executors share, to cut lineage for good."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset (tests) under one of our own. It goes when the application ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="embedlens-"))
    path = f"{root.rstrip('/')}/embedlens/{name}-{uuid.uuid4().hex[:12]}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


#: A table of fewer bytes than this for each core may have all its rows in one split (one row group).
SPLIT_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """A scanned table for work that is dear per row: a small one is dealt over all cores, which moves ``SPLIT_BYTES`` a core at most; any
    other is left as its splits are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPLIT_BYTES else df


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once and read again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
