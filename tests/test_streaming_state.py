"""Keyed upserts as deltas, dedupe with expiring keys, running best out of order."""

import os
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from embedlens.streaming import keyed, states
from embedlens.streaming import streams as S

EVENT = "k long, at long, v string"


def size(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet")) if Path(path).exists() else 0


def files(spark, path, frames, order=None):
    """Each frame as one file, with modification times in this order."""
    for i, df in enumerate(frames):
        df.coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    out = Path(path) / "all"
    out.mkdir()
    for i in range(len(frames)):
        (f,) = (Path(path) / str(i)).glob("*.parquet")
        f.rename(out / f"{i}.parquet")
        at = 1_700_000_000 + 10 * (order[i] if order else i)
        os.utime(out / f"{i}.parquet", (at, at))
    return str(out)


def latest(rows):
    out = {}
    for k, at, v in rows:
        if k not in out or at >= out[k][0]:
            out[k] = (at, v)
    return {(k, *x) for k, x in out.items()}


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), spark.createDataFrame([], EVENT).schema, "k", "at", buckets=8, compact=3)
    rows = [(k, 1, f"value {k} {'x' * 60}{random.Random(k).random()}") for k in range(40_000)]
    table.upsert(spark.createDataFrame(rows, EVENT), 0)
    whole = size(tmp_path / "t")
    for n in range(1, 6):
        some = [(k, n + 1, f"changed {n} {'y' * 60}{random.Random(k + n).random()}") for k in range(n, 40_000, 100)]
        before = size(tmp_path / "t" / "delta")
        table.upsert(spark.createDataFrame(some, EVENT), n)
        rows += some
        assert size(tmp_path / "t" / "delta") - before < 0.05 * whole, "one row of a hundred changes"
        assert {tuple(r) for r in table.read().collect()} == latest(rows)
    assert {tuple(r) for r in table.read(0).collect()} == latest(rows[:40_000])
    c = table.commit()
    assert c.version == 5 and set(c.base.values()) <= {2, 5} and all(len(b) for _, b in c.deltas)
    gone = table.vacuum()
    assert gone and {tuple(r) for r in table.read().collect()} == latest(rows) and table.versions() == [5]


def test_replays_nulls_late_orders_and_crashes(spark, tmp_path):
    schema = spark.createDataFrame([], EVENT).schema
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), schema, "k", "at", buckets=4)
    assert table.read().count() == 0 and table.commit().version == -1
    make = lambda rows: spark.createDataFrame(rows, EVENT)
    table.upsert(make([(1, 5, "a"), (None, 1, "n"), (2, 1, "b"), (2, 2, "c")]), 0)
    table.upsert(make([(1, 5, "lost")]), 0)  # a replay after the commit
    table.upsert(make([(1, 4, "late"), (None, 2, "m"), (3, 1, None)]), 1)
    table._write(table._hashed(make([(9, 9, "of a batch that died before its commit")])), "delta", 2)
    want = {(1, 5, "a"), (None, 2, "m"), (2, 2, "c"), (3, 1, None)}
    assert {tuple(r) for r in table.read().collect()} == want
    table.upsert(make([(4, 1, "d")]), 2)
    table.upsert(make([]), 3)
    assert {tuple(r) for r in table.read().collect()} == want | {(4, 1, "d")} and table.versions() == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        table.read(17)
    with pytest.raises(ValueError):
        keyed.KeyedTable(spark, str(tmp_path), spark.createDataFrame([], "Bucket long, at long").schema, "Bucket", "at")


def test_upserting_stream(spark, tmp_path):
    rng = random.Random(3)
    batches = [[(rng.randrange(50), 100 * b + i, f"{b}-{i}") for i in range(60)] for b in range(4)]
    path = files(spark, str(tmp_path), [spark.createDataFrame(b, EVENT) for b in batches], order=[2, 0, 3, 1])
    schema = spark.createDataFrame([], EVENT).schema
    table = keyed.upsert(S.file_stream(spark, path, schema), str(tmp_path / "t"), str(tmp_path / "c"), "k", "at", buckets=3, compact=2)
    assert {tuple(r) for r in table.read().collect()} == latest(sorted((r for b in batches for r in b), key=lambda r: r[1]))
    again = keyed.upsert(S.file_stream(spark, path, schema), str(tmp_path / "t"), str(tmp_path / "c"), "k", "at", buckets=3, compact=2)
    assert again.versions() == table.versions() and len(table.versions()) == 4


def test_dedupe_in_any_order_of_files(spark, tmp_path):
    """Files in reversed order of their times, all rows twice, null keys: each key once, late rows counted, none dropped."""
    rows = [(i, 1_600_000_000 + 100 * i) for i in range(4000)] + [(None, 1_600_000_000)]
    part = lambda a: rows[a : a + 1000 + (a == 3000)]
    frames = [spark.createDataFrame(part(a) + part(a)[::-1], "k long, s long").select("k", F.timestamp_seconds("s").alias("ts")) for a in (0, 1000, 2000, 3000)]
    frames.append(spark.createDataFrame(rows[::7], "k long, s long").select("k", F.timestamp_seconds("s").alias("ts")))
    path = files(spark, str(tmp_path), frames, order=[3, 2, 1, 0, 4])
    stream = S.file_stream(spark, path, frames[0].schema)
    out = states.deduplicated(stream, "k", "ts", str(tmp_path / "out"), str(tmp_path / "late"), str(tmp_path / "c"), keep=3600, delay=3600)
    got = [r.k for r in out.collect()]
    assert sorted(got, key=lambda k: (k is None, k)) == [k for k, _ in rows]
    side = {r.batch: (r.rows, r.late) for r in spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "late")).collect()}
    assert [side[b][0] for b in range(5)] == [1001, 1000, 1000, 1000, 0] or sum(x for x, _ in side.values()) == 4001
    newest, late = None, 0
    for a in (3000, 2000, 1000, 0):
        times = [s for _, s in part(a)]
        late += sum(newest is not None and s < newest - 3600 for s in times)
        newest = max([*times, newest or 0])
    assert sum(x for _, x in side.values()) == late > 2000
    assert spark.conf.get(states.PROVIDER) != states.ROCKSDB


def test_keys_expire(spark, tmp_path):
    """State is bounded by time: a key that comes again after its time is new."""
    one = spark.createDataFrame([(1, 0), (1, 5)], "k long, s long")
    path = files(spark, str(tmp_path), [one])
    run = lambda keep: states.to_files(states.first_of_key(S.file_stream(spark, path, one.schema), "k", keep=keep, buckets=2), str(tmp_path / "out"), str(tmp_path / "c")).count()
    assert run(600) == 1
    one.coalesce(1).write.mode("append").parquet(path)
    assert run(600) == 1
    time.sleep(2)
    one.coalesce(1).write.mode("append").parquet(path)
    assert run(1) == 2


def test_running_best_in_any_order_of_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = [(run, step, rng.choice([None, rng.uniform(-2, 5), 1.0])) for run in (1, 2, None) for step in range(300)]
    first, second = ([r for r in rows if (r[1] < 150) == early] for early in (True, False))
    rng.shuffle(first), rng.shuffle(second)
    second += [(1, 3, 99.0), (2, 100, 0.5)]
    frames = [spark.createDataFrame(x, "r long, s int, x double") for x in (first, second)]
    path = files(spark, str(tmp_path), frames)
    got = states.to_files(states.running_best(S.file_stream(spark, path, frames[0].schema), "r", "s", "x"), str(tmp_path / "out"), str(tmp_path / "c")).collect()
    want = set()
    for run in (1, 2, None):
        best = -1.0
        for _, s, x in sorted(r for r in rows if r[0] == run and r[2] is not None) if run else sorted((r for r in rows if r[0] is None and r[2] is not None), key=lambda r: r[1]):
            if x > best:
                best = x
                want.add((run, s, x))
    assert {(r.r, r.s, r.x) for r in got if not r.late} == want
    assert {(r.r, r.s, r.x) for r in got if r.late} == {(1, 3, 99.0), (2, 100, 0.5)}
