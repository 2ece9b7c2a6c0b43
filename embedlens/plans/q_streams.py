"""Queries of the streaming forms: a table is written as files, streamed to its end, and the result read."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from embedlens.plans import bindings as B
from embedlens.plans.q_corpus import folder
from embedlens.plans.registry import query
from embedlens.streaming import keyed, states
from embedlens.streaming import streams as S


def streamed(df, spark, name: str, path: str):
    """``df`` written to ``path``, the stream over its files in two batches or more, and a checkpoint."""
    df.write.parquet(path)
    files = len(spark.read.schema(df.schema).parquet(path).inputFiles())
    return S.file_stream(spark, path, df.schema, files=max(2, math.ceil(files / 2))), folder(spark, f"{name}-checkpoint")


def landed(df, spark, name: str, *order: str, files: int = 4):
    """A folder of files, in order of their rows, and the stream over it."""
    return streamed(df.repartitionByRange(files, *order).sortWithinPartitions(*order) if order else df.repartition(files), spark, name, folder(spark, name))


@query("SELECT doc_id, lang, n_chars FROM documents")
def stream_ingest(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    stream, checkpoint = landed(d, spark, "ingest")
    out = folder(spark, "ingested")
    S.ingest(stream, out, checkpoint)
    return spark.read.schema(d.schema).parquet(out)


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def stream_upsert(spark, sf_dir):
    e = B.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    stream, checkpoint = landed(e, spark, "upsert", "event_id")
    return keyed.upsert(stream, folder(spark, "upserted"), checkpoint, "user_id", "event_id").read()


@query(B.with_ctes("log", "SELECT run_id, count(*) AS rows, max(step) AS last_step, arg_max(value, step) AS last_value, round(sum(value), 2) AS total_value FROM log GROUP BY run_id"))
def stream_metrics(spark, sf_dir):
    m = B.metrics(spark, sf_dir).select("run_id", "step", "value")
    stream, checkpoint = landed(m, spark, "metrics")
    return S.snapshot(S.rolled_up(stream, "run_id", "step", "value"), folder(spark, "rolled-up"), checkpoint)


@query(B.with_ctes("log", "SELECT run_id, step, value FROM (SELECT run_id, step, value, max(value) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM log WHERE event_type = 'purchase' AND value IS NOT NULL) WHERE value > coalesce(b, -1)"))
def stream_best(spark, sf_dir):
    m = B.metrics(spark, sf_dir).where("event_type = 'purchase'").select("run_id", "step", "value")
    # a run is in one file, so in one batch
    stream, checkpoint = streamed(m.repartition("run_id").sortWithinPartitions("run_id", "step"), spark, "best", folder(spark, "best"))
    return states.to_files(states.running_best(stream, "run_id", "step", "value"), folder(spark, "improvements"), checkpoint).where("not late").select("run_id", "step", "value")


@query("SELECT event_id, user_id, value FROM events")
def stream_dedup(spark, sf_dir):
    """All events land twice; each is kept once, in whatever order the files come."""
    e = B.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    path = folder(spark, "dedup")
    stream, checkpoint = streamed(e.union(e).repartitionByRange(4, "ts", "event_id").sortWithinPartitions("ts", "event_id"), spark, "dedup", path)
    # a key is kept for a day of running time
    return states.deduplicated(stream, "event_id", "ts", folder(spark, "deduplicated"), folder(spark, "late"), checkpoint, keep=86_400).select("event_id", "user_id", "value")
