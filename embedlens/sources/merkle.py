"""A stored Merkle tree over a table's rows: what differs between two copies is found from their trees, and only its buckets are read.

A leaf is a row's typed, null-aware digest. ``size`` successive values of ``idx`` make a bucket, ``size`` buckets a node above it, and so
on up to one root; a node's digest is that of its children's, in order. A table of 10**12 rows has four levels above its rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedlens.sources.manifest import row_digest
from embedlens.sources.shared import written

SIZE = 1000
NODE = "level int, node long, digest string, rows long"


def leaves(df: DataFrame, idx: str, *columns: str | Column) -> DataFrame:
    """(idx, digest) of every row over ``columns`` (all, if none are named); ``idx`` is unique and not null."""
    cells = [F.col(c) if isinstance(c, str) else c for c in columns or df.columns]
    return df.select(F.col(idx).cast("long").alias("idx"), row_digest(*cells).alias("digest"))


def _above(children: DataFrame, child: str, level: int, size: int) -> DataFrame:
    """The nodes over ``children(child, digest, rows)``; a node has ``size`` children at most."""
    ordered = F.array_sort(F.collect_list(F.struct(child, "digest")))
    return children.groupBy(F.floor(F.col(child) / size).alias("node")).agg(
        F.lit(level).alias("level"), F.sha2(F.array_join(F.transform(ordered, lambda x: x["digest"]), ""), 256).alias("digest"), F.sum("rows").alias("rows")
    ).select("level", "node", "digest", "rows")


def _upwards(level: DataFrame, at: int, size: int) -> list[DataFrame]:
    """The levels above a written one, up to the root, each written."""
    out = []
    while (top := level.agg(F.min("node").alias("low"), F.max("node").alias("high")).first()).high is not None and (top.low, top.high) != (0, 0):
        at += 1
        level = written(_above(level, "node", at, size), "merkle")
        out.append(level)
    return out


def tree(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """(level, node, digest, rows) of all nodes over ``leaves``; the root is node 0 of the highest level. ``idx`` isn't negative."""
    buckets = written(_above(rows.withColumn("rows", F.lit(1).cast("long")), "idx", 0, size), "merkle")
    return reduce(DataFrame.unionByName, [buckets, *_upwards(buckets, 0, size)])


def changed_buckets(a: DataFrame, b: DataFrame, size: int = SIZE) -> DataFrame:
    """(node): buckets in which two trees differ. Goes down from the roots and looks at the children of differing nodes only."""
    height = max(x or 0 for x in (a.agg(F.max("level")).first()[0], b.agg(F.max("level")).first()[0]))
    open_ = None
    for level in range(height, -1, -1):
        x, y = (t.where(F.col("level") == level).select("node", F.col("digest").alias(n)) for t, n in ((a, "x"), (b, "y")))
        if open_ is not None:
            x, y = (t.withColumn("parent", F.floor(F.col("node") / size)).join(open_, "parent", "left_semi").drop("parent") for t in (x, y))
        differ = x.join(y, "node", "full").where(~F.col("x").eqNullSafe(F.col("y"))).select("node")
        differ = written(differ, "differ")
        # trees of different heights have no common node above the lower one
        open_ = differ.withColumnRenamed("node", "parent")
    return differ


def changed_rows(left: DataFrame, right: DataFrame, idx: str, a: DataFrame, b: DataFrame, *columns: str, size: int = SIZE) -> DataFrame:
    """(idx, left, right): rows whose digests differ, or that one side lacks (null). Rows are read and hashed in differing buckets only."""
    found = changed_buckets(a, b, size)
    bucket = F.floor(F.col(idx) / size)
    some = [leaves(t.withColumn("_bucket", bucket).join(found.withColumnRenamed("node", "_bucket"), "_bucket", "left_semi").drop("_bucket"), idx, *columns) for t in (left, right)]
    both = some[0].withColumnRenamed("digest", "left").join(some[1].withColumnRenamed("digest", "right"), "idx", "full")
    return both.where(~F.col("left").eqNullSafe(F.col("right")))


def updated(stored: DataFrame, rows: DataFrame, changed: DataFrame, size: int = SIZE) -> DataFrame:
    """``stored`` after the rows ``changed(idx)`` were added, altered or removed: only their buckets are hashed again, from ``rows`` (the
    leaves as they are now), and then the nodes above."""
    hit = written(changed.select(F.floor(F.col("idx") / size).alias("bucket")).distinct(), "hit")
    mine = rows.withColumn("bucket", F.floor(F.col("idx") / size)).join(hit, "bucket", "left_semi").drop("bucket").withColumn("rows", F.lit(1).cast("long"))
    kept = stored.where("level = 0").join(hit, F.col("node") == F.col("bucket"), "left_anti")
    buckets = written(kept.unionByName(_above(mine, "idx", 0, size)), "merkle")
    return reduce(DataFrame.unionByName, [buckets, *_upwards(buckets, 0, size)])


def proof(stored: DataFrame, node: int, size: int = SIZE) -> DataFrame:
    """(level, node, digest): the siblings, bucket upwards, from which the root follows for a bucket's digest; ``size`` a level at most."""
    height = stored.agg(F.max("level")).first()[0] or 0
    parent = lambda level: node // size ** (level + 1)
    wanted = [(F.col("level") == level) & (F.floor(F.col("node") / size) == parent(level)) for level in range(height)]
    if not wanted:
        return stored.where("level = 0").select("level", "node", "digest")
    return stored.where(reduce(lambda x, y: x | y, wanted)).select("level", "node", "digest")
