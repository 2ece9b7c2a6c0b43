"""Run logs as they lie, one JSON-lines file a run, or many runs packed in a file; rows differ in their fields and are read as VARIANT, so
nothing is lost or widened.

A row is whatever its writer put: a training row has step and loss, an evaluation row its own step and scores. Fields are taken by path and
type where they are asked for. Blank lines are skipped; lines that aren't JSON objects are kept apart with a null row, and counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_logs(rows: DataFrame, path: str, run: str, order: str, line: Column) -> None:
    """Writes ``line`` of every row into its run's file, in ``order``; one file a run, as a run has one writer."""
    lines = rows.select(F.col(run).alias("run_id"), F.col(order).alias("_order"), line.alias("value"))
    lines.repartition("run_id").sortWithinPartitions("run_id", "_order").select("run_id", "value").write.partitionBy("run_id").mode("append").text(path)


def pack_logs(rows: DataFrame, path: str, run: str, order: str, line: Column) -> None:
    """Writes the same lines with their runs in front (``run<TAB>line``), whole runs in a file and in ``order``: as many files as there are
    partitions, where a file a run would be as many files as runs, each listed and opened."""
    lines = rows.select(F.col(run).alias("run_id"), F.col(order).alias("_order"), F.concat(F.coalesce(F.col(run).cast("string"), F.lit("")), F.lit("\t"), F.coalesce(line, F.lit(""))).alias("value"))
    lines.repartition("run_id").sortWithinPartitions("run_id", "_order").select("value").write.mode("append").text(path)


def _rows(lines: DataFrame) -> DataFrame:
    row = F.try_parse_json("value")
    return lines.where(F.trim("value") != "").select("run_id", F.when(F.schema_of_variant(row).startswith("OBJECT"), row).alias("row"))


def read_logs(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """(run_id, row): a row for each line that isn't blank; ``row`` is null for a line that isn't a JSON object."""
    return _rows(spark.read.schema(f"value string, run_id {kind}").text(path))


def read_packed(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """The same rows of what ``pack_logs`` wrote."""
    run = F.nullif(F.substring_index("value", "\t", 1), F.lit("")).cast(kind)
    return _rows(spark.read.text(path).select(F.substr("value", F.instr("value", "\t") + 1).alias("value"), run.alias("run_id")))


def field(path: str, kind: str = "double") -> Column:
    """A field of ``row`` by its path; null where the row has none or another kind of value."""
    return F.try_variant_get("row", path, kind)


def series(logs: DataFrame, step: str, **fields: str) -> DataFrame:
    """(run_id, step, fields): rows that have the step and all of the fields, whatever else they have."""
    found = logs.select("run_id", field(step, "long").alias("step"), *[field(p).alias(n) for n, p in fields.items()])
    return found.dropna()


def last_with(logs: DataFrame, step: str, path: str) -> DataFrame:
    """(run_id, step, value): each run's last row that has the field."""
    found = series(logs, step, value=path).groupBy("run_id").agg(F.max(F.struct("step", "value")).alias("last"))
    return found.select("run_id", "last.step", "last.value")


def fields_of(logs: DataFrame) -> DataFrame:
    """(field, rows, runs): what fields the rows have."""
    keys = logs.where("row is not null").lateralJoin(logs.sparkSession.tvf.variant_explode(F.col("row").outer()))
    return keys.groupBy(F.col("key").alias("field")).agg(F.count("*").alias("rows"), F.count_distinct("run_id").alias("runs"))


def shapes(logs: DataFrame) -> DataFrame:
    """(run_id, rows, bad, shape): rows and unreadable lines of each run, and the merged schema of its rows."""
    return logs.groupBy("run_id").agg(F.count("row").alias("rows"), F.count_if(F.col("row").isNull()).alias("bad"), F.schema_of_variant_agg("row").alias("shape"))
