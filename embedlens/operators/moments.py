"""Alignment, erasure and linear maps from moments: one pass, d x d on the driver, never n x n."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlens.operators.vectors import _matrix, topk
from embedlens.sources.shared import written


#: Partial matrices are added on the driver up to so many bytes; beyond, tasks add them in a tree of this many branches.
DRIVER_BYTES, FAN = 1 << 28, 8
#: Bytes of a stripe of a partial matrix: what one row of a shuffle holds.
STRIPE = 4 << 20
#: Rows that one product takes.
ROWS = 4096


@dataclass
class Moments:
    """Count, means, and products of what is left of the vectors without their means."""

    n: int
    mean_x: np.ndarray
    mean_z: np.ndarray
    cxx: np.ndarray
    cxz: np.ndarray
    czz: np.ndarray

    def centred(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.cxx, self.cxz, self.czz

    @property
    def xx(self) -> np.ndarray:
        return self.cxx + self.n * np.outer(self.mean_x, self.mean_x)

    @property
    def xz(self) -> np.ndarray:
        return self.cxz + self.n * np.outer(self.mean_x, self.mean_z)


def _added(n: float, mean: np.ndarray, m: np.ndarray, k: float, other: np.ndarray, more: np.ndarray, rows: slice = slice(None)) -> tuple[float, np.ndarray, np.ndarray]:
    """Two sets' counts, means and centred products (of the rows ``rows`` of the matrix) together (Chan, Golub and LeVeque, 1983)."""
    if not n or not k:
        return (k, other, more) if not n else (n, mean, m)
    delta = other - mean
    return n + k, mean + delta * (k / (n + k)), m + more + np.outer(delta[rows], delta) * (n * k / (n + k))


def _merged(frame: pd.DataFrame, width: int, each: int) -> pd.DataFrame:
    """Partials of one stripe, added one after another."""
    stripe = int(frame["stripe"].iloc[0])
    rows = slice(stripe * each, min((stripe + 1) * each, width))
    n, mean, m = 0.0, np.zeros(width), np.zeros((rows.stop - rows.start, width))
    for k, other, block in zip(frame["n"], frame["mean"], frame["block"]):
        n, mean, m = _added(n, mean, m, k, np.frombuffer(other), np.frombuffer(block).reshape(-1, width), rows)
    return pd.DataFrame({"part": frame["part"].iloc[:1], "stripe": [stripe], "n": [n], "mean": [mean.tobytes()], "block": [m.tobytes()]})


def moments(df: DataFrame, x: str = "x", z: str = "z") -> Moments:
    """Means and centred products of the vectors x and z. Each task sends one packed partial matrix, in stripes; they are added pairwise
    about their own means, so a large common offset costs no digits, in a tree of tasks where they are many."""
    sizes = df.select(F.size(x).alias("a"), F.size(z).alias("b")).first()
    if sizes is None:
        raise ValueError("no rows")
    a, width = sizes.a, sizes.a + sizes.b
    each = max(1, STRIPE // (8 * width))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, mean, m = 0.0, np.zeros(width), np.zeros((width, width))
        for f in frames:
            for i in range(0, len(f), ROWS):
                y = np.concatenate([_matrix(f[c].iloc[i : i + ROWS]) for c in (x, z)], 1)
                centre = y.mean(0)
                n, mean, m = _added(n, mean, m, float(len(y)), centre, (y - centre).T @ (y - centre))
        if n:
            for stripe in range(-(-width // each)):
                yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "stripe": [stripe], "n": [n], "mean": [mean.tobytes()], "block": [m[stripe * each : (stripe + 1) * each].tobytes()]})

    schema = "part int, stripe int, n double, mean binary, block binary"
    parts = _few(written(df.select(x, z).mapInPandas(run, schema), "moments"), lambda f: _merged(f, width, each), schema)
    found = parts.toPandas()
    stripes = [_merged(f, width, each).iloc[0] for _, f in found.groupby("stripe")]
    mean, m = np.frombuffer(stripes[0]["mean"]), np.concatenate([np.frombuffer(r["block"]).reshape(-1, width) for r in stripes])
    return Moments(round(stripes[0]["n"]), mean[:a], mean[a:], m[:a, :a], m[:a, a:], m[a:, a:])


def _few(parts: DataFrame, merge, schema: str) -> DataFrame:
    """The written partials (part, stripe, ..., block), added in tasks until they are few enough for the driver."""
    while True:
        size = parts.agg(F.sum(F.length("block")).alias("bytes"), F.count_distinct("part").alias("parts")).first()
        if size.parts <= 1 or size.bytes <= DRIVER_BYTES:
            return parts
        grouped = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        parts = written(grouped.groupBy("part", "stripe").applyInPandas(merge, schema), "moments")


def triangle(df: DataFrame, v: str, mean: np.ndarray) -> np.ndarray:
    """R of the QR decomposition of the rows ``v - mean``, by tasks and a tree (TSQR: Demmel et al., 2012): its singular values are the
    rows' to full precision, where products would square them."""
    width = len(mean)
    sent = df.sparkSession.sparkContext.broadcast(mean)
    r_of = lambda *blocks: np.linalg.qr(np.concatenate(blocks), mode="r")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, width))
        for f in frames:
            for i in range(0, len(f), ROWS):
                r = r_of(r, _matrix(f[v].iloc[i : i + ROWS]) - sent.value)
        if len(r):
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "stripe": [0], "block": [r.tobytes()]})

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        r = np.zeros((0, width))
        for block in frame["block"]:
            r = r_of(r, np.frombuffer(block).reshape(-1, width))
        return pd.DataFrame({"part": frame["part"].iloc[:1], "stripe": [0], "block": [r.tobytes()]})

    schema = "part int, stripe int, block binary"
    parts = _few(written(df.select(v).mapInPandas(run, schema), "triangle"), merge, schema).orderBy("part").toPandas()
    return np.frombuffer(merge(parts)["block"].iloc[0]).reshape(-1, width) if len(parts) else np.zeros((0, width))


def paired(a: DataFrame, b: DataFrame, key: str = "crop_id") -> DataFrame:
    return a.select(key, F.col("v").alias("x")).join(b.select(key, F.col("v").alias("z")), key)


def hsic_biased(df: DataFrame) -> float | None:
    m = moments(df)
    return float((m.centred()[1] ** 2).sum() / (m.n - 1) ** 2) if m.n > 1 else None


def _unbiased(n, cross, sum_ab, sa, sb) -> float | None:
    """Debiased HSIC of linear kernels, from centred products and sums over rows of squared norms a, b and of a b. It doesn't change with
    the vectors' offset, and without one the sums of a row's similarities are what its own norm is, negated."""
    if n <= 3:
        return None
    return float(((cross**2).sum() - sum_ab + sa * sb / ((n - 1) * (n - 2)) - 2 * sum_ab / (n - 2)) / (n * (n - 3)))


def hsic_unbiased_all(df: DataFrame) -> dict[str, float | None]:
    """Debiased HSIC of (x, z), (x, x), (z, z), from moments and one more scan with the sums."""
    m = moments(df)
    s = _norm_sums(df, ["x", "z"], [m.mean_x, m.mean_z])
    return {"xz": _unbiased(m.n, m.cxz, s[1, 2], s[0, 1], s[0, 2]), "xx": _unbiased(m.n, m.cxx, s[1, 1], s[0, 1], s[0, 1]), "zz": _unbiased(m.n, m.czz, s[2, 2], s[0, 2], s[0, 2])}


def _norm_sums(df: DataFrame, names: list[str], means: list[np.ndarray]) -> np.ndarray:
    """Sums over rows of products of (1, squared norms of the centred vectors ``names``)."""
    sent, e = df.sparkSession.sparkContext.broadcast(means), 1 + len(names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((e, e))
        for f in frames:
            if len(f):
                y = np.stack([np.ones(len(f)), *(((_matrix(f[c]) - m) ** 2).sum(1) for c, m in zip(names, sent.value))], 1)
                total += y.T @ y
        yield pd.DataFrame({"i": np.repeat(np.arange(e), e), "j": np.tile(np.arange(e), e), "x": total.reshape(-1)})

    s = np.zeros((e, e))
    for r in df.select(*names).mapInPandas(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():  # (1 + names)**2
        s[r.i, r.j] = r.x
    return s


def cka(df: DataFrame) -> float | None:
    h = hsic_unbiased_all(df)
    return None if None in h.values() or h["xx"] * h["zz"] <= 0 else h["xz"] / float(np.sqrt(h["xx"] * h["zz"]))


def procrustes(df: DataFrame) -> float:
    """Distance after centring, unit Frobenius norm and the best rotation of x onto z."""
    m = moments(df)
    xx, xz, zz = m.centred()
    nx, nz = np.sqrt(np.trace(xx)), np.sqrt(np.trace(zz))
    u, s, _ = np.linalg.svd(xz / (nx * nz), full_matrices=False)
    return float(np.sqrt(max(0.0, np.trace(u.T @ (xx / nx**2) @ u) + 1 - 2 * s.sum())))


def mutual_knn(a: DataFrame, b: DataFrame, k: int, key: str = "crop_id") -> DataFrame:
    """(k, n, overlap): mean share of common neighbours, self left out."""
    near = [topk(x.select(F.col(key).alias("id"), "v"), x.select(F.col(key).alias("id"), "v"), k).select("q", "id") for x in (a, b)]
    common = near[0].join(near[1], ["q", "id"]).groupBy().agg(F.count("*").alias("common"))
    n = a.join(b, key, "left_semi").groupBy().agg(F.count("*").alias("n"))
    return common.crossJoin(n).select(F.lit(k).cast("long").alias("k"), "n", F.round(F.col("common") / (F.col("n") * k), 6).alias("overlap"))


def alignment_grid(views: dict[str, DataFrame], k: int = 10, key: str = "crop_id") -> DataFrame:
    """(enc_a, enc_b, metric, value) of all pairs of encoders, over the items that all of them have.

    The normalised views are joined and written once. Each encoder's neighbours are found once; the CKA of all pairs comes from one pass
    of moments over the encoders side by side, and one more with the sums.
    """
    spark = next(iter(views.values())).sparkSession
    names, both = sorted(views), None
    for name in names:
        one = unit(views[name]).select(key, F.col("v").alias(name))
        both = one if both is None else both.join(one, key)
    both = written(both, "views")
    near = {a: written(topk(v := both.select(F.col(key).alias("id"), F.col(a).alias("v")), v, k).select("q", "id"), "near") for a in names}
    n = both.count()
    values = {(a, b): round(v, 6) if v is not None else None for (a, b), v in cka_all(both, names).items()}
    rows = [(a, b, "cka", values[a, b]) for i, a in enumerate(names) for b in names[i + 1 :]]
    out = spark.createDataFrame(rows, "enc_a string, enc_b string, metric string, value double")
    for a, b, _, _ in rows:
        common = near[a].join(near[b], ["q", "id"]).groupBy().agg(F.round(F.count("*") / F.lit(float(max(n, 1) * k)), 6).alias("value"))
        out = out.unionByName(common.select(F.lit(a).alias("enc_a"), F.lit(b).alias("enc_b"), F.lit(f"knn_{k}").alias("metric"), "value"))
    return out


def cka_all(df: DataFrame, names: list[str]) -> dict[tuple[str, str], float | None]:
    """Debiased CKA of every pair of the vector columns ``names``: two scans, whatever the number of columns."""
    sizes = df.select(*[F.size(c).alias(c) for c in names]).first()
    if sizes is None:
        return {(a, b): None for a in names for b in names}
    m = moments(df.select(F.concat(*names).alias("x"), F.array(F.lit(0.0)).alias("z")))
    at = np.cumsum([0, *(sizes[c] for c in names)])
    span = {c: slice(at[i], at[i + 1]) for i, c in enumerate(names)}
    e, s = len(names), _norm_sums(df, names, [m.mean_x[span[c]] for c in names])

    def hsic(i: int, j: int) -> float | None:
        return _unbiased(m.n, m.cxx[span[names[i]], span[names[j]]], s[1 + i, 1 + j], s[0, 1 + i], s[0, 1 + j])

    own = [hsic(i, i) for i in range(e)]
    out = {}
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            ok = own[i] is not None and own[i] * own[j] > 0
            out[a, b] = hsic(i, j) / float(np.sqrt(own[i] * own[j])) if ok else None
    return out


def unit(df: DataFrame) -> DataFrame:
    from embedlens.functions.columns import l2_normalize

    return df.withColumn("v", l2_normalize(F.col("v")))


def apply_matrix(df: DataFrame, matrix: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None, v: str = "v", normalise: bool = True) -> DataFrame:
    """v becomes (v - before) @ matrix + after, normalised; the d x d matrix is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast((matrix, 0.0 if before is None else before, 0.0 if after is None else after))
    schema = df.schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, b, a = shared.value
        for f in frames:
            if len(f):
                y = (_matrix(f[v]) - b) @ m + a
                if normalise:
                    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
                yield f.assign(**{v: list(y)})

    return df.mapInPandas(run, schema)


@dataclass
class Eraser:
    matrix: np.ndarray
    mean: np.ndarray

    def apply(self, df: DataFrame, normalise: bool = True) -> DataFrame:
        return apply_matrix(df, self.matrix, self.mean, self.mean, normalise=normalise)


def fit_eraser(m: Moments, ridge: float = 1e-6, tol: float = 1e-8) -> Eraser:
    """Linear concept eraser: whiten, project out the cross-covariance's column space, un-whiten (Belrose et al., 2023)."""
    xx, xz, _ = m.centred()
    cov = xx / (m.n - 1) + ridge * np.eye(len(xx))
    values, vectors = np.linalg.eigh(cov)
    values = np.maximum(values, ridge)
    white, back = vectors / np.sqrt(values) @ vectors.T, vectors * np.sqrt(values) @ vectors.T
    u, s, _ = np.linalg.svd(white @ xz / (m.n - 1), full_matrices=False)
    u = u[:, s > tol]
    return Eraser((white @ (np.eye(len(xx)) - u @ u.T) @ back), m.mean_x)


def _delta_directions(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, DataFrame]:
    """Mean of the paired differences x - z, their principal directions as columns, shares of variance, and the differences as v."""
    delta = df.withColumn("v", F.zip_with("x", "z", lambda a, b: a - b))
    first = delta.select(F.size("v").alias("d")).first()
    if first is None:
        raise ValueError("no rows")
    cells = delta.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).collect()  # d rows
    mean = np.zeros(first.d)
    for r in cells:
        mean[r.i] = r.x
    _, values, rows = np.linalg.svd(triangle(delta, "v", mean), full_matrices=True)
    share = np.zeros(first.d)
    share[: len(values)] = values**2 / max((values**2).sum(), 1e-300)
    return mean, rows.T, share, delta


def delta_pca(df: DataFrame, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Principal directions of paired differences x - z, and their shares of variance."""
    _, directions, share, _ = _delta_directions(df)
    return directions[:, :rank], share[:rank]


def delta_scores(df: DataFrame, key: str, rank: int | None = None) -> DataFrame:
    """(key, r, z): each row's centred difference x - z on the first principal directions, as rows; the directions are broadcast."""
    mean, directions, _, delta = _delta_directions(df)
    found = apply_matrix(delta.select(key, "v"), directions[:, : rank or len(mean)], before=mean, normalise=False)
    return found.select(key, F.posexplode("v").alias("r", "z"))


def delta_erasers(df: DataFrame, ranks: list[int], ridge: float = 1e-6) -> dict[int, Eraser]:
    """Erasers of the first ``rank`` directions of the differences x - z, all ranks from one set of moments."""
    m = moments(df.select("x", F.zip_with("x", "z", lambda a, b: a - b).alias("z")))
    _, xd, dd = m.centred()
    values, vectors = np.linalg.eigh(dd)
    out = {}
    for rank in ranks:
        v = vectors[:, np.argsort(-values)[:rank]]
        out[rank] = fit_eraser(Moments(m.n, m.mean_x, np.zeros(rank), m.cxx, xd @ v, v.T @ dd @ v), ridge)
    return out


def linear_probe(df: DataFrame, z: str, classes: int, ridge: float = 1e-6) -> float:
    """Least-squares one-hot probe: training accuracy of its argmax. ``df`` has v and an integer class ``z``."""
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == F.col(z)).cast("double"))
    rows = df.select(F.concat("v", F.array(F.lit(1.0))).alias("x"), one_hot.alias("z"), F.col(z).alias("c"))
    m = moments(rows)
    w = np.linalg.solve(m.xx + ridge * np.eye(len(m.xx)), m.xz)
    scored = apply_matrix(rows.select("c", F.col("x").alias("v")), w, normalise=False)
    return scored.select(F.avg((F.array_position("v", F.array_max("v")) - 1 == F.col("c")).cast("double"))).first()[0]


def linear_adapter(df: DataFrame, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge map from x to z in closed form: matrix, mean of x, mean of z."""
    m = moments(df)
    xx, xz, _ = m.centred()
    return np.linalg.solve(xx + ridge * m.n * np.eye(len(xx)), xz), m.mean_x, m.mean_z


def paired_view_check(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts of what two views disagree on: missing ids, groups, dimensions."""
    x = a.select("crop_id", F.col("page_id").alias("pa"), F.size("v").alias("da"))
    y = b.select("crop_id", F.col("page_id").alias("pb"), F.size("v").alias("db"))
    j = x.join(y, "crop_id", "full")
    return j.groupBy().agg(F.count_if(F.col("da").isNull()).alias("only_b"), F.count_if(F.col("db").isNull()).alias("only_a"), F.count_if(F.col("pa") != F.col("pb")).alias("group_mismatch"), F.count_if(F.col("da") != F.col("db")).alias("dim_mismatch"), F.count("*").alias("ids"))
