"""A keyed table that takes upserts as deltas: a batch writes what it changes, readers merge, compaction folds deltas into their buckets.

Layout under one folder: ``base/<version>/bucket=<b>`` and ``delta/<version>/bucket=<b>`` hold rows by the hash of their key;
``commits/<version>`` is a small JSON file that says which version of each bucket's base and which deltas make up the table. A version
counts only once its commit file is there (written aside, then renamed), so a reader sees all of a batch or nothing of it, and a batch
that is replayed after its commit changes nothing.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16
#: Deltas of a bucket at which it is folded into its base.
COMPACT = 8
_AT, _BUCKET = "_version", "bucket"


@dataclass
class Commit:
    """``base``: bucket to the version that wrote its base; ``deltas``: [version, buckets] in order."""

    version: int = -1
    base: dict[int, int] = field(default_factory=dict)
    deltas: list[tuple[int, list[int]]] = field(default_factory=list)


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, order: str, buckets: int = BUCKETS, compact: int = COMPACT):
        if {_AT, _BUCKET} & {c.lower() for c in schema.names}:
            raise ValueError(f"columns must not be named {_AT} or {_BUCKET}")
        self.spark, self.path, self.schema, self.key, self.order, self.buckets, self.compact_at = spark, path.rstrip("/"), schema, key, order, buckets, compact
        self._jvm = spark.sparkContext._jvm
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    # --- commits

    def versions(self) -> list[int]:
        p = self._hadoop(f"{self.path}/commits")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(p) if s.getPath().getName().isdigit()) if self._fs.exists(p) else []

    def commit(self, version: int | None = None) -> Commit:
        """The given version, or the last one; an empty table where there is none."""
        found = self.versions()
        if version is None:
            version = found[-1] if found else -1
        elif version not in found:
            raise ValueError(f"no version {version}")
        if version < 0:
            return Commit()
        read = json.loads(self.spark.read.text(f"{self.path}/commits/{version}", wholetext=True).first()[0])
        return Commit(version, {int(b): v for b, v in read["base"].items()}, [(v, b) for v, b in read["deltas"]])

    def _publish(self, c: Commit) -> None:
        target, aside = self._hadoop(f"{self.path}/commits/{c.version}"), self._hadoop(f"{self.path}/commits/.{c.version}")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps({"base": c.base, "deltas": c.deltas}).encode()))
        out.close()
        if not self._fs.rename(aside, target) and not self._fs.exists(target):
            raise OSError(f"could not publish version {c.version}")

    # --- rows

    def _hashed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(_BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _latest(self, df: DataFrame) -> DataFrame:
        """Of each key the row with the highest ``order``, of equal ones the latest version's; combined before the shuffle."""
        rest = [c for c in df.columns if c not in (self.key, _BUCKET)]
        at = F.struct(self.order, *([_AT] if _AT in rest else []))
        one = df.groupBy(_BUCKET, self.key).agg(F.max_by(F.struct(*rest), at).alias("_r"))
        return one.select(_BUCKET, self.key, *[F.col(f"_r.{c}").alias(c) for c in rest])

    def _part(self, kind: str, version: int, buckets: list[int]) -> DataFrame:
        """The rows of these buckets, with their version; only their folders are read."""
        root = f"{self.path}/{kind}/{version}"
        df = self.spark.read.schema(self.schema).option("basePath", root).parquet(*[f"{root}/{_BUCKET}={b}" for b in sorted(buckets)])
        return df.select(*self.schema.names, F.col(_BUCKET).cast("int").alias(_BUCKET), F.lit(version).alias(_AT))

    def _rows(self, c: Commit, buckets: set[int]) -> DataFrame | None:
        """Unmerged rows of these buckets: base and deltas."""
        parts: dict[tuple[str, int], list[int]] = {}
        for b in buckets:
            if b in c.base:
                parts.setdefault(("base", c.base[b]), []).append(b)
        for v, hit in c.deltas:
            if some := [b for b in hit if b in buckets]:
                parts[("delta", v)] = some
        out = None
        for (kind, v), some in sorted(parts.items()):
            df = self._part(kind, v, some)
            out = df if out is None else out.unionByName(df)
        return out

    def _write(self, df: DataFrame, kind: str, version: int) -> list[int]:
        """Writes rows by bucket and returns the buckets; an earlier attempt at this version goes."""
        root = f"{self.path}/{kind}/{version}"
        df.select(*self.schema.names, _BUCKET).repartition(_BUCKET).sortWithinPartitions(_BUCKET, self.key).write.partitionBy(_BUCKET).mode("overwrite").parquet(root)
        names = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop(root))]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{_BUCKET}="))

    def upsert(self, batch: DataFrame, version: int) -> None:
        """Adds ``batch`` as ``version``. Its files are about as large as the batch; buckets with many deltas are folded first."""
        c = self.commit()
        if version <= c.version:
            return  # a replayed batch
        hit = self._write(self._latest(self._hashed(batch.select(*self.schema.names))), "delta", version)
        new = Commit(version, dict(c.base), [*c.deltas, (version, hit)] if hit else list(c.deltas))
        full = {b for b in range(self.buckets) if sum(b in x for _, x in new.deltas) >= self.compact_at}
        self._publish(self._folded(new, full) if full else new)

    def _folded(self, c: Commit, buckets: set[int]) -> Commit:
        done = self._write(self._latest(self._rows(c, buckets)).drop(_AT), "base", c.version)
        deltas = [(v, left) for v, x in c.deltas if (left := [b for b in x if b not in buckets])]
        return Commit(c.version, c.base | dict.fromkeys(done, c.version), deltas)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version (the last, if none is named). Buckets without deltas are read as they lie."""
        c = self.commit(version)
        open_ = {b for _, x in c.deltas for b in x}
        still, merged = self._rows(c, set(c.base) - open_), self._rows(c, open_)
        parts = [df for df in (still, merged and self._latest(merged)) if df is not None]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        out = parts[0].select(*self.schema.names)
        return out if len(parts) == 1 else out.unionByName(parts[1].select(*self.schema.names))

    def vacuum(self) -> list[str]:
        """Removes files that the last version doesn't need (earlier versions can't be read any more); returns their folders."""
        c, gone = self.commit(), []
        for v in self.versions()[:-1]:
            self._fs.delete(self._hadoop(f"{self.path}/commits/{v}"), False)
        for kind, used in (("base", set(c.base.values())), ("delta", {v for v, _ in c.deltas})):
            root = self._hadoop(f"{self.path}/{kind}")
            for s in self._fs.listStatus(root) if self._fs.exists(root) else []:
                name = s.getPath().getName()
                if name.isdigit() and int(name) not in used and int(name) <= c.version:
                    self._fs.delete(s.getPath(), True)
                    gone.append(f"{kind}/{name}")
        return sorted(gone)


def upsert(stream: DataFrame, path: str, checkpoint: str, key: str, order: str, buckets: int = BUCKETS, compact: int = COMPACT) -> KeyedTable:
    """Last write wins by ``key`` and ``order``; each micro-batch is a version."""
    table = KeyedTable(stream.sparkSession, path, stream.schema, key, order, buckets, compact)
    stream.writeStream.foreachBatch(lambda batch, number: table.upsert(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return table
