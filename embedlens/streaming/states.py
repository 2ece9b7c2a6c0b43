"""Stateful operators that keep their state in RocksDB: dedupe with expiring keys, running best.

Neither looks at the data beforehand, and neither drops a row for being late: dedupe forgets a key some time after it has arrived, whatever
its event time; rows behind the stream are counted in a side table.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys share this many lists of state; a batch reads and extends each list once.
BUCKETS = 64


@contextmanager
def rocksdb(spark: SparkSession):
    """State of streams started inside is kept in RocksDB. Batches without data are off: with time-outs they would follow each other
    without end, and a stream up to the end of its files would never stop; expired state goes in the next batch with data."""
    own = {PROVIDER: ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def first_of_key(stream: DataFrame, key: str, keep: int = 3600, buckets: int = BUCKETS) -> DataFrame:
    """The first row of each key to arrive; a key is forgotten ``keep`` seconds after it came. A null key is a key.

    State of a bucket: the packed digests of the keys that a batch brought, and when; a batch reads and writes each bucket's state once,
    and leaves out what has expired.
    """
    names, n = stream.columns, len(stream.columns)
    text = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("null"))
    digest = F.unhex(F.md5(text.cast("binary")))
    # plain names, as columns may clash; pandas would make doubles of longs with nulls
    exact = [F.col(f.name).cast("decimal(19,0)") if f.dataType == T.LongType() else F.col(f.name) for f in stream.schema.fields]
    plain = stream.select(*[c.alias(f"c{i}") for i, c in enumerate(exact)], digest.alias("digest"), F.pmod(F.xxhash64(digest), F.lit(buckets)).cast("int").alias("bucket"))

    def run(bucket: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        now = int(time.time() * 1000)
        held = [(at, d) for at, d in zip(*state.get) if at > now - keep * 1000] if state.exists else []
        if state.hasTimedOut:
            state.remove()
            return
        known, fresh = [np.frombuffer(d, "V16") for _, d in held], []
        for frame in frames:
            d = np.frombuffer(b"".join(frame["digest"]), "V16")
            new = np.zeros(len(d), bool)
            new[np.unique(d, return_index=True)[1]] = True
            for x in (*known, *fresh):
                new &= ~np.isin(d, x)
            fresh.append(d[new])
            yield frame.loc[new, [f"c{i}" for i in range(n)]]
        if sum(map(len, fresh)):
            held.append((now, np.concatenate(fresh).tobytes()))
        state.update(([at for at, _ in held], [d for _, d in held]))
        state.setTimeoutDuration(keep * 1000)

    schema = T.StructType([T.StructField(f"c{i}", plain.schema[i].dataType) for i in range(n)])
    out = plain.groupBy("bucket").applyInPandasWithState(run, schema, "at array<long>, digests array<binary>", "append", "ProcessingTimeTimeout")
    return out.select(*[F.col(f"c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(stream.schema.fields)]).toDF(*names)


def running_best(stream: DataFrame, run: str, step: str, value: str) -> DataFrame:
    """(run, step, value, late): whenever a value beats all that its run has had at earlier steps. Rows at or before the last step of an
    earlier batch can't be placed any more; they come with ``late`` set. Rows without a step or value take no part.

    State of a run: its best value and its last step. What a batch holds of a run are its improvements alone, however many rows come and
    in whatever order.
    """
    plain = stream.select(F.col(run).alias("run"), F.col(step).cast("long").alias("step"), F.col(value).cast("double").alias("value")).where("step is not null and value is not null")

    def better(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        best, last = state.get if state.exists else (-1.0, None)
        row = lambda s, v, late: pd.DataFrame({"run": [key[0]] * len(s), "step": s, "value": v, "late": late})
        front_s, front_v, newest = np.zeros(0, np.int64), np.zeros(0), last
        for frame in frames:
            s, v = frame["step"].to_numpy(np.int64), frame["value"].to_numpy(float)
            if last is not None and (behind := s <= last).any():  # behind what is put out already
                yield row(s[behind], v[behind], True)
                s, v = s[~behind], v[~behind]
            if len(s):
                newest = max(int(s.max()), int(s.max()) if newest is None else newest)
                s, v = np.concatenate([front_s, s]), np.concatenate([front_v, v])
                order = np.lexsort((-v, s))
                s, v = s[order], v[order]
                before = np.maximum(best, np.concatenate([[best], np.maximum.accumulate(v)[:-1]]))
                front_s, front_v = s[v > before], v[v > before]
        if newest is not None:
            state.update((float(front_v[-1]) if len(front_v) else best, int(newest)))
        yield row(front_s, front_v, False)

    kind = stream.schema[run].dataType
    schema = T.StructType([T.StructField("run", kind), T.StructField("step", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("late", T.BooleanType())])
    return plain.groupBy("run").applyInPandasWithState(better, schema, "best double, last long", "append", "NoTimeout").toDF(run, step, value, "late")


def to_files(stream: DataFrame, path: str, checkpoint: str, write=None) -> DataFrame:
    """Streams to the end into ``path/v<batch>``, which a replayed batch writes again, and reads it all; ``write(batch, number)`` takes the
    place of a plain write."""
    spark, schema = stream.sparkSession, stream.schema

    def plain(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v{number}")

    with rocksdb(spark):
        stream.writeStream.foreachBatch(write or plain).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def deduplicated(stream: DataFrame, key: str, event_time: str, path: str, side: str, checkpoint: str, keep: int = 3600, delay: int = 3600) -> DataFrame:
    """The first row of each key, in files under ``path``. ``side/v<batch>`` gets a row for each batch: its rows, how many of them are more
    than ``delay`` seconds of event time behind the batches before (``late``; they stay in the result), and the newest time."""
    spark, schema = stream.sparkSession, stream.schema

    def write(batch: DataFrame, number: int) -> None:
        earlier = [f"{side}/v{v}" for v in range(number) if _exists(spark, f"{side}/v{v}")]
        newest = spark.read.parquet(*earlier).agg(F.max("newest")).first()[0] if earlier else None  # a row a batch
        behind = F.lit(False) if newest is None else F.coalesce(F.unix_micros(event_time) < newest - delay * 1_000_000, F.lit(False))
        batch.write.mode("overwrite").parquet(f"{path}/v{number}")
        done = spark.read.schema(schema).parquet(f"{path}/v{number}")
        c = done.agg(F.count(F.lit(1)).alias("rows"), F.count_if(behind).alias("late"), F.max(F.unix_micros(event_time)).alias("newest")).first()
        row = [(number, c["rows"], c["late"], max((x for x in (c["newest"], newest) if x is not None), default=None))]
        spark.createDataFrame(row, "batch long, rows long, late long, newest long").coalesce(1).write.mode("overwrite").parquet(f"{side}/v{number}")

    return to_files(first_of_key(stream, key, keep), path, checkpoint, write)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
