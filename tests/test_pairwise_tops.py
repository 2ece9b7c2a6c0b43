"""Pairs rolled up by groups: each two blocks meet once, in single precision first; odd rows as in SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from embedlens.operators import tops
from embedlens.plans import registry
from tests.test_queries import table


def batch(v, g, ids=None, last=None, side=0):
    ids = np.arange(len(v)) if ids is None else np.array(ids)
    return pa.RecordBatch.from_pydict({
        "side": np.full(len(v), side, np.int32), "id": ids, "last": ids if last is None else np.array(last),
        "g": [x or 0 for x in g], "none": [x is None for x in g], "v": pa.array([list(x) for x in v], pa.list_(pa.float64())),
    })


def found(*batches):
    best = {}
    for b in tops.tops(iter(batches)):
        for r in b.to_pylist():
            for k in {(r["g_a"], r["g_b"]), (r["g_b"], r["g_a"])}:
                best[k] = max(best.get(k, -np.inf), r["top"])
    return best


def brute(v, g, same):
    s, best = np.where(same, -np.inf, v @ v.T), {}
    for x in set(g):
        for y in set(g):
            top = s[np.ix_([i == x for i in g], [i == y for i in g])].max()
            if top > -np.inf:
                best[x, y] = top
    return best


def equal(a, b):
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_tops_of_large_small_and_null_groups():
    r = np.random.default_rng(2)
    v = r.normal(size=(3000, 8))
    v[1500:1600] = v[:100] * (1 + 1e-9 * r.normal(size=(100, 1)))  # nearer than single precision tells
    g = [None if i % 50 == 0 else 7 if i % 3 else i % 40 for i in range(3000)]
    equal(found(batch(v[:2000], g[:2000]), batch(v[2000:], g[2000:], np.arange(2000, 3000))), brute(v, g, np.eye(3000, dtype=bool)))
    two = found(batch(v[:1700], g[:1700]), batch(v[1700:], g[1700:], np.arange(1700, 3000), side=1))
    s = v[:1700] @ v[1700:].T
    for x, y in ((7, 7), (None, 7), (3, 9), (3, None)):
        at = lambda a, b: s[np.ix_([i == a for i in g[:1700]], [i == b for i in g[1700:]])].max(initial=-np.inf)  # noqa: E731, B023
        assert abs(two[x, y] - max(at(x, y), at(y, x))) < 1e-12


def test_an_id_does_not_meet_itself_but_copies_do():
    v = np.eye(4)[[0, 1, 2, 3, 3]] * [[1], [2], [3], [4], [4]]
    ids, last = [1, 2, 3, 4, 4], [1, 9, 3, 4, 4]  # the second is a vector of ids 2 and 9; id 4 is there twice
    alone = np.array([[i == j == k == m for j, m in zip(ids, last)] for i, k in zip(ids, last)])
    equal(found(batch(v, [1, 1, 2, 3, 5], ids, last)), brute(v, [1, 1, 2, 3, 5], alone))


def test_few_pairs_are_multiplied_twice(monkeypatch):
    made, plain = [], tops._products
    monkeypatch.setattr(tops, "_products", lambda *a: (made.append((s := plain(*a)).size), s)[1])
    v = np.random.default_rng(3).normal(size=(12_000, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    g = [i % 2 for i in range(12_000)]
    equal(found(batch(v, g)), brute(v, g, np.eye(12_000, dtype=bool)))
    assert sum(made) < 12_000**2 / 5


def odd_rows():
    r = np.random.default_rng(4)
    v = r.normal(size=(60, 3)).astype(np.float32).tolist()
    rows = [(i, i % 4, x) for i, x in enumerate(v)]
    rows += [(None, 1, [1.0, 2.0, 3.0]), (None, None, [1.0, 0.0, 0.0]), (70, None, [9.0, 0.0, 0.0]), (71, None, [0.0, 9.0, 0.0]), (72, 6, [0.0, 1.0, 9.0])]
    rows += [(80, 0, None), (81, 7, None), (82, 7, None), (83, None, None)]  # no vector
    rows += [(3, 3, v[3]), (3, 1, [5.0, 5.0, 5.0]), (4, 2, None), (90, 8, v[0]), (91, 8, v[0]), (92, 8, v[0])]  # ids twice, copies
    return rows, [(100, 2, [1e6, 0.0, 0.0]), (101, None, [2e6, 0.5, 0.25]), (102, 2**60, [0.0, 300.0, 1.0]), (103, 9, [float("inf"), 1.0, 1.0]), (104, 3, [float("nan"), 1.0, 1.0])]


def test_odd_rows_equal_sql(spark, tmp_path):
    rows, others = odd_rows()
    for k, some in enumerate((rows, rows + others, others, rows[-6:-3])):
        folder = tmp_path / str(k)
        folder.mkdir()
        columns = zip(*some)
        pq.write_table(pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.float64())))], names=["vec_id", "label", "embedding"]), folder / "embeddings.parquet")
        df = registry.queries()["pairwise_cosine"](spark, str(folder))
        got = table(df.columns, [tuple(r) for r in df.collect()])
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
        r = con.execute(registry.oracle_sql()["pairwise_cosine"])
        assert got == table([c[0] for c in r.description], r.fetchall())


def test_many_blocks_meet_once(spark):
    v = np.random.default_rng(5).integers(-3, 4, size=(6000, 3)).astype(float)  # many copies
    v[:, 0] = np.arange(6000) % 97
    g = [None if i % 11 == 0 else i % 7 for i in range(6000)]
    kinds = spark.createDataFrame([(i, i, x, y.tolist()) for i, (x, y) in enumerate(zip(g, v))], "id long, last long, g long, v array<double>")
    blocks = []
    for block in (700, 6000):
        df = tops.meet_once(kinds, tops.tops, tops.SCHEMA, block, 6000)
        blocks.append(df.rdd.getNumPartitions())
        best = {}
        for r in df.collect():
            for k in {(r.g_a, r.g_b), (r.g_b, r.g_a)}:
                best[k] = max(best.get(k, -np.inf), r.top)
        equal(best, brute(v, g, np.eye(6000, dtype=bool)))
    assert blocks == [45, 3]
