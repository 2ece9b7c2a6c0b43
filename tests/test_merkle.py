"""Manifests that are published last and checked when read, and Merkle trees that name tampered rows."""

import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from embedlens.sources import manifest as M
from embedlens.sources import merkle

ROWS = "idx long, a string, n long"


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS).repartition(3)


@pytest.fixture
def rows():
    return [(i, None if i % 5 == 0 else f"a{i}", i * 7) for i in range(0, 950) if i % 11]


def test_digests_tell_null_empty_and_types_apart(spark):
    df = spark.createDataFrame([(None, 1), ("", 1), ("null", 1), ("1", None), ("a\x1fb", 1)], "s string, n long")
    assert df.select(M.row_digest(F.col("s"), F.col("n"))).distinct().count() == 5
    both = spark.range(1).select(M.row_digest(F.lit(1).alias("x")).alias("a"), M.row_digest(F.lit("1").alias("x")).alias("b")).first()
    assert both.a != both.b


def test_tree_by_hand(spark, rows):
    leaf = {r.idx: r.digest for r in merkle.leaves(frame(spark, rows), "idx").collect()}
    want, level, at = {}, {i: (d, 1) for i, d in leaf.items()}, 0
    while True:
        up = {}
        for k in sorted(level):
            d, n = up.get(k // 10, ("", 0))
            up[k // 10] = (d + level[k][0], n + level[k][1])
        level = {k: (hashlib.sha256(d.encode()).hexdigest(), n) for k, (d, n) in up.items()}
        want |= {(at, k): x for k, x in level.items()}
        if set(level) == {0}:
            break
        at += 1
    got = merkle.tree(merkle.leaves(frame(spark, rows), "idx"), size=10)
    assert {(r.level, r.node): (r.digest, r.rows) for r in got.collect()} == want and at == 2
    proof = {(r.level, r.node): r.digest for r in merkle.proof(got, 37, 10).collect()}
    assert {k for k in proof if k[0] == 0} == {(0, n) for n in range(30, 40) if (0, n) in want}
    level1 = hashlib.sha256("".join(proof[0, n] for n in range(30, 40)).encode()).hexdigest()
    assert level1 == proof[1, 3] == want[1, 3][0]
    assert hashlib.sha256("".join(proof[1, n] for n in range(10)).encode()).hexdigest() == want[2, 0][0]


def test_changes_are_found_in_their_buckets_only(spark, rows):
    other = [(i, "" if i == 215 else a, n) for i, a, n in rows if i != 402] + [(2000, "new", 1)]
    a, b = (merkle.tree(merkle.leaves(frame(spark, x), "idx"), size=10) for x in (rows, other))
    assert {r.node for r in merkle.changed_buckets(a, b, 10).collect()} == {21, 40, 200}
    got = {r.idx: (r.left is not None, r.right is not None) for r in merkle.changed_rows(frame(spark, rows), frame(spark, other), "idx", a, b, size=10).collect()}
    assert got == {215: (True, True), 402: (True, False), 2000: (False, True)}
    assert merkle.changed_rows(frame(spark, rows), frame(spark, rows), "idx", a, a, size=10).count() == 0
    changed = spark.createDataFrame([(215,), (402,), (2000,)], "idx long")
    again = merkle.updated(a, merkle.leaves(frame(spark, other), "idx"), changed, size=10)
    key = lambda t: {tuple(r) for r in t.collect()}
    assert key(again) == key(b)


def test_manifest_is_published_last_and_checked(spark, tmp_path, rows):
    path = f"file:{tmp_path}"
    M.manifest_write(frame(spark, rows), path, "v1", "idx", dataset="d", revision="r1", prefetched_at="2024-01-01")
    header = M.manifest_header(spark, path, "v1").first()
    assert (header.dataset, header.revision, header.prefetched_at, header.version, header.num_rows) == ("d", "r1", "2024-01-01", "v1", len(rows))
    assert M.manifest_read(spark, path, "v1", "idx").count() == len(rows)
    first = header.rows
    more = [*rows, (5000, "x", 1)]
    M.manifest_write(frame(spark, more), path, "v1", "idx", dataset="d")
    assert M.manifest_read(spark, path, "v1", "idx").count() == len(more)
    assert (Path(tmp_path) / "v1" / first).exists() and M.manifest_header(spark, path, "v1").first().rows != first
    # rows that were never published, and rows that are not the published ones
    frame(spark, rows).write.parquet(f"{tmp_path}/v1/rows-stray")
    assert M.manifest_read(spark, path, "v1", "idx").count() == len(more)
    changed = [(i, "" if i == 25 else a, n) for i, a, n in rows]
    frame(spark, changed).write.parquet(f"{tmp_path}/v1/rows-tampered")
    text = json.loads((tmp_path / "v1" / "header.json").read_text()) | {"rows": "rows-tampered", "num_rows": len(rows)}
    (tmp_path / "v1" / ".header.json.crc").unlink(missing_ok=True)
    (tmp_path / "v1" / "header.json").write_text(json.dumps(text))
    with pytest.raises(ValueError):
        M.manifest_read(spark, path, "v1", "idx")
    assert M.manifest_read(spark, path, "v1", "idx", verify=False).count() == len(rows)
    M.manifest_write(frame(spark, rows).limit(0), path, "v0", "idx")
    assert M.manifest_read(spark, path, "v0", "idx").count() == 0
