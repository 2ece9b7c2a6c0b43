"""Corpus manifests: scans, shard arithmetic, digests, resume and merge."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embedlens.operators.sampling import global_rank

ROW = T.StructType([T.StructField("idx", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("docid", "title", "text_path", "image_path", "image_sha256"))])
MANIFEST = T.StructType([T.StructField("dataset", T.StringType()), T.StructField("hf_revision", T.StringType()), T.StructField("prefetched_at", T.StringType()), T.StructField("num_rows", T.LongType()), T.StructField("rows", T.ArrayType(ROW))])


def manifest_scan(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a nested manifest document: the six required fields."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True).selectExpr("inline(rows)").select(*ROW.names)


def jsonl_scan(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """One record a line; blank lines are skipped; bad lines fail, or are dropped if not ``strict``."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def blob_scan(spark: SparkSession, path: str, suffix: str = "*.png") -> DataFrame:
    """(idx, path, length, content) of files whose names are numbers."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"(\d+)\.[^.]+$", 1).cast("long").alias("idx"), "path", "length", "content")


def text_scan(spark: SparkSession, path: str) -> DataFrame:
    """(idx, text) of sidecar text files, one row a file."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.[^.]+$", 1).cast("long").alias("idx"), F.col("value").alias("text"))


def latest_by_key(df: DataFrame, key: str, order: Column) -> DataFrame:
    """One row for each key: the last in ``order``; aggregated before the shuffle, so a frequent key is no hot spot."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def shard_offsets(df: DataFrame, shard: str) -> DataFrame:
    """(shard, rows, start, stop) in order of the shards' names."""
    n = df.groupBy(shard).agg(F.count("*").alias("rows"))
    stop = F.sum("rows").over(Window.orderBy(shard))  # a row for each shard
    return n.select(shard, "rows", (stop - F.col("rows")).alias("start"), stop.alias("stop"))


def file_inventory(files: DataFrame) -> DataFrame:
    """(file, rows, start, stop) of every file of a read table, in order of their paths; one row a file meets in one task."""
    return shard_offsets(files.select(F.col("_metadata.file_path").alias("file")), "file")


def file_range(files: DataFrame, start: int, stop: int) -> DataFrame:
    """The rows of files number start to stop - 1, in order of their paths. Two paths come to the driver; the filter on the path keeps
    the other files from being read."""
    paths = files.select(F.col("_metadata.file_path").alias("file")).distinct()
    numbered = global_rank(paths, F.col("file"), name="number").where(F.col("number").between(start + 1, stop))
    ends = numbered.agg(F.min("file").alias("low"), F.max("file").alias("high")).first()
    if ends.low is None:
        return files.limit(0)
    return files.where(F.col("_metadata.file_path").between(ends.low, ends.high))


def row_range(df: DataFrame, idx: str, start: int, stop: int) -> DataFrame:
    return df.where((F.col(idx) >= start) & (F.col(idx) < stop))


def reindex_shard(df: DataFrame, shard: str, key: str, bases: DataFrame | None = None) -> DataFrame:
    """Adds ``idx``: the shard's base plus the row's place in it by ``key``. Bases default to the shards' offsets."""
    bases = bases if bases is not None else shard_offsets(df, shard).select(shard, F.col("start").alias("idx_base"))
    ranked = global_rank(df, F.col(shard), F.col(key), name="_rank")
    first = ranked.groupBy(shard).agg(F.min("_rank").alias("_first"))
    return ranked.join(first, shard).join(bases, shard).withColumn("idx", F.col("idx_base") + F.col("_rank") - F.col("_first")).drop("_rank", "_first", "idx_base")


def quota_take(df: DataFrame, idx: str, good: Column, n: int) -> DataFrame:
    """The first n good rows by ``idx``; bad rows don't count."""
    return df.where(good).orderBy(idx).limit(n)


def load_summary(df: DataFrame, group: str, ok: Column, size: Column, had: Column) -> DataFrame:
    """requested, written, failed, bytes and status of a load, by ``group``."""
    agg = df.groupBy(group).agg(F.count("*").alias("requested"), F.count_if(ok).alias("written"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, size)), F.lit(0)).cast("long").alias("bytes"), F.count_if(had).alias("_had"))
    status = F.when(F.col("_had") == F.col("requested"), "already_complete").when(F.col("failed") == 0, "complete").otherwise("partial")
    return agg.withColumn("status", status).drop("_had")


def resume(df: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not loaded yet: failed rows are tried again."""
    return df.join(loaded.select(key).distinct(), key, "left_anti")


def merge_shards(existing: DataFrame, shards: list[DataFrame], idx: str) -> DataFrame:
    """Union of all; on a clash the last shard wins."""
    both = existing.withColumn("_shard", F.lit(-1))
    for i, s in enumerate(shards):
        both = both.unionByName(s.withColumn("_shard", F.lit(i)))
    return latest_by_key(both, idx, F.col("_shard")).drop("_shard")


def canonical_row(*columns: Column) -> Column:
    """One string for a row: a JSON object with the columns' names; null, an empty string and a number's digits as text all differ."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def row_digest(*columns: Column) -> Column:
    return F.sha2(canonical_row(*columns), 256)


def corpus_fingerprint(df: DataFrame, idx: str, digest: str, bucket: int = 1000) -> DataFrame:
    """One row: a digest of the digests of ``idx div bucket`` buckets, each over its rows' digests in order. No string holds all rows."""
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda s: s[c[-1]]), "")
    buckets = df.select(F.floor(F.col(idx) / bucket).alias("bucket"), F.col(idx).alias("i"), F.col(digest).alias("d")).groupBy("bucket").agg(F.sha2(joined(["i", "d"]), 256).alias("d"), F.count("*").alias("n"))
    supers = buckets.select(F.floor(F.col("bucket") / bucket).alias("top"), "bucket", "d", "n").groupBy("top").agg(F.sha2(joined(["bucket", "d"]), 256).alias("d"), F.sum("n").alias("n"))
    return supers.groupBy().agg(F.sha2(joined(["top", "d"]), 256).alias("fingerprint"), F.sum("n").cast("long").alias("num_rows"))


def verify_digests(blobs: DataFrame, manifest: DataFrame, key: str, content: str, stored: str) -> DataFrame:
    """Rows whose content is missing or has another digest than the manifest says."""
    actual = blobs.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("actual"))
    return manifest.select(key, F.col(stored).alias("stored")).join(actual, key, "left").where("actual is null or actual <> stored")


HEADER = "dataset string, revision string, prefetched_at string, version string, num_rows long, rows string, fingerprint string"


def manifest_write(df: DataFrame, path: str, version: str, idx: str, dataset: str = "", revision: str | None = None, prefetched_at: str | None = None) -> str:
    """Writes rows under a new name, then publishes the header that names them, with provenance, the number of rows and their fingerprint.

    The header is one file, written aside and renamed over what was there, so a reader sees the old manifest or the new one, never rows of
    one with the header of the other. Returns the rows' folder.
    """
    spark = df.sparkSession
    rows = f"{path}/{version}/rows-{uuid.uuid4().hex[:12]}"
    df.write.parquet(rows)
    found = _fingerprint(spark.read.schema(df.schema).parquet(rows), idx)
    stamp = prefetched_at or datetime.now(timezone.utc).isoformat(timespec="seconds")
    header = {"dataset": dataset, "revision": revision, "prefetched_at": stamp, "version": version, "num_rows": found[1], "rows": rows.rsplit("/", 1)[1], "fingerprint": found[0]}
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/{version}/header.json")
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}/{version}/.header-{uuid.uuid4().hex[:12]}")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = at.getFileSystem(conf).create(aside, True)
    out.write(bytearray(json.dumps(header).encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.getFileSystem(conf).getUri(), conf).rename(aside, at, over)
    return rows


def _fingerprint(df: DataFrame, idx: str) -> tuple[str | None, int]:
    digests = df.select(idx, row_digest(*[F.col(c) for c in df.columns]).alias("_digest"))
    one = corpus_fingerprint(digests, idx, "_digest").first()
    return (one.fingerprint, one.num_rows or 0) if one.num_rows else (None, 0)


def manifest_header(spark: SparkSession, path: str, version: str) -> DataFrame:
    """The published header: one row."""
    return spark.read.schema(HEADER).json(f"{path}/{version}/header.json")


def manifest_read(spark: SparkSession, path: str, version: str, idx: str, schema: T.StructType | None = None, verify: bool = True) -> DataFrame:
    """The rows that the published header names; raises where they aren't those it was published with."""
    header = manifest_header(spark, path, version).first()
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.parquet(f"{path}/{version}/{header['rows']}")
    if verify and (found := _fingerprint(rows, idx)) != (header.fingerprint, header.num_rows):
        raise ValueError(f"manifest {version}: {found[1]} rows with fingerprint {found[0]}, published were {header.num_rows} with {header.fingerprint}")
    return rows


def archive_shards(spark: SparkSession, path: str, archive: str) -> list[str]:
    """Moves merged shards (the entries of a folder) into an archive folder; what is there already is left, so a repeat goes on where it
    stopped. Returns the names moved."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = jvm_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(jvm_path(archive))
    moved = []
    for entry in fs.listStatus(jvm_path(path)):  # a name a shard
        name = entry.getPath().getName()
        target = jvm_path(f"{archive}/{name}")
        if not name.startswith(("_", ".")) and not fs.exists(target) and fs.rename(entry.getPath(), target):
            moved.append(name)
    return sorted(moved)


def report_sink(df: DataFrame, path: str, form: str = "json") -> None:
    """A report's few rows as one file."""
    out = df.coalesce(1).write.mode("overwrite")
    out.json(path) if form == "json" else out.csv(path, header=True)
