"""Structured Streaming forms: ingest, live roll-up, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def ingest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what is new since the checkpoint; a restart goes on where it stopped."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def _versions(spark: SparkSession, path: str) -> list[int]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(p)) if fs.exists(p) else []


def rolled_up(stream: DataFrame, run: str, step: str, value: str) -> DataFrame:
    return stream.groupBy(run).agg(F.count("*").alias("rows"), F.max(step).alias("last_step"), F.max_by(value, step).alias("last_value"), F.round(F.sum(value), 2).alias("total_value"))


def snapshot(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """The whole result after the last batch; each batch writes snapshot ``path/v<batch>``, which a replayed batch writes again."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v{number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    found = _versions(spark, path)
    return spark.read.schema(stream.schema).parquet(f"{path}/v{found[-1]}") if found else spark.createDataFrame([], stream.schema)
