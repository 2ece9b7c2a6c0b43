"""Shared folder, written tables and Arrow batches for the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embedlens.sources.shared import spread

#: Bytes of text that one numpy pass takes at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or an own one where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="embedlens-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables written under the shared folder, so that a lost executor never costs a recomputation from the start."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/embedlens/{name}-{uuid.uuid4().hex[:12]}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path)
        self._n = 0

    def stash(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Writes ``df`` and reads it again; the result's lineage is the files."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._embedlens_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that nothing reads any more: what was made of them is written. What the driver holds of their jobs goes too."""
        for df in tables:
            self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._embedlens_path), True)
        release(self.spark)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``limit`` bytes of text, or one row."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if i > at and total + size > limit:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += size
    yield batch.slice(at)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the offsets of each; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pa.compute.fill_null(col.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, type=f.type) for f in schema], schema=schema)


_remembered: dict[str, dict] = {}


def remembered(owner: str | None) -> dict:
    """What ``owner`` keeps in this worker from task to task; what others keep goes, as workers serve one operator after another."""
    for other in [x for x in _remembered if x != owner]:
        del _remembered[other]
    return {} if owner is None else _remembered.setdefault(owner, {})


def give_back() -> None:
    """Returns freed memory to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Returns what finished jobs hold in the driver. Spark removes their broadcasts and shuffle files once the driver's JVM has collected
    their plans; left to itself, it lets its heap grow to the limit first."""
    gc.collect()
    give_back()
    spark.sparkContext._jvm.System.gc()


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str | None = None):
    """A mapInArrow function: ``f`` in a worker that holds nothing of other operators before, and no freed memory after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered(owner)
        yield from f(batches)
        give_back()

    return run


def over_texts(f: Callable[[pa.RecordBatch], pa.RecordBatch], limit: int = SLICE_BYTES, owner: str | None = None):
    """A mapInArrow function that applies ``f`` to bounded slices; see ``tidy``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=limit):
                yield f(part)

    return tidy(run, owner)


def lower_az(c: Column | str) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def doc_crc(c: Column | str) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names like ``names`` that clash with none in ``taken``; Spark compares names without case."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def power_of_two(n: int) -> int:
    return 1 << max(0, int(n - 1).bit_length())
