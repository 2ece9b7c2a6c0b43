"""Operators on small fixtures: brute force, analytic bounds, invariants and edge cases."""

import math
import os
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedlens.functions import columns as C
from embedlens.functions import encode
from embedlens.functions.encode import encode_with, named
from embedlens.operators import contrastive, moments, neardup, patches, retrieval, runs, sampling, tiling, vectors
from embedlens.plans import q_corpus, q_streams
from embedlens.sources import manifest as M
from embedlens.streaming import states
from embedlens.streaming import streams as S


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def crops_of(spark, x, groups):
    return spark.createDataFrame([(i, int(g), [float(c) for c in v]) for i, (v, g) in enumerate(zip(x, groups))], "crop_id long, page_id long, v array<double>")


def batch_of(spark, x, groups, batch=0):
    return spark.createDataFrame([(batch, i, int(g), [float(c) for c in v]) for i, (v, g) in enumerate(zip(x, groups))], "batch_id long, id long, page_id long, v array<double>")


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(0)


# --- sources


def test_manifest_round_trip(spark, tmp_path):
    doc = '{"dataset": "d", "hf_revision": null, "prefetched_at": "2024", "num_rows": 2, "rows": [{"idx": 1, "docid": "b", "title": null, "text_path": "", "image_path": "p", "image_sha256": "x", "extra": 3}, {"idx": 0, "docid": "a", "title": "T", "text_path": "", "image_path": "q", "image_sha256": "y"}]}'
    (tmp_path / "m.json").write_text(doc)
    rows = M.manifest_scan(spark, str(tmp_path / "m.json")).orderBy("idx").collect()
    assert [tuple(r)[:3] for r in rows] == [(0, "a", "T"), (1, "b", None)]


def test_jsonl_skips_blank_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in M.jsonl_scan(spark, str(tmp_path), "a long").collect()) == [1, 2]


def test_tampering_is_found(spark):
    blobs = spark.createDataFrame([(1, "one"), (2, "changed")], "idx long, content string")
    stored = spark.createDataFrame([(1, "one"), (2, "two"), (3, "gone")], "idx long, text string").select("idx", F.sha2("text", 256).alias("sha"))
    assert sorted(r.idx for r in M.verify_digests(blobs, stored, "idx", "content", "sha").collect()) == [2, 3]


def test_merge_and_resume(spark):
    df = lambda rows: spark.createDataFrame(rows, "idx long, v string")
    merged = M.merge_shards(df([(1, "old"), (2, "old")]), [df([(2, "a"), (3, "a")]), df([(3, "b")])], "idx")
    assert {r.idx: r.v for r in merged.collect()} == {1: "old", 2: "a", 3: "b"}
    assert [r.idx for r in M.resume(df([(1, "x"), (9, "x")]), merged, "idx").collect()] == [9]


def test_blobs_and_texts_by_number(spark, tmp_path):
    (tmp_path / "00").mkdir()
    (tmp_path / "00" / "0000007.png").write_bytes(b"abc")
    (tmp_path / "00" / "0000008.txt").write_text("two\nlines")
    assert [(r.idx, r.length) for r in M.blob_scan(spark, str(tmp_path)).collect()] == [(7, 3)]
    assert [(r.idx, r.text) for r in M.text_scan(spark, f"{tmp_path}/00/*.txt").collect()] == [(8, "two\nlines")]


def test_fingerprint_does_not_depend_on_partitions(spark):
    df = spark.range(5000).select(F.col("id").alias("idx"), F.sha2(F.col("id").cast("string"), 256).alias("d"))
    a, b = (M.corpus_fingerprint(df.repartition(n), "idx", "d").first() for n in (1, 7))
    assert a == b and a.num_rows == 5000


def test_status_of_a_load(spark):
    rows = [("a", True, 5, False), ("a", False, 7, False), ("b", True, 1, True), ("c", True, 1, False)]
    out = M.load_summary(spark.createDataFrame(rows, "g string, ok boolean, n long, had boolean"), "g", F.col("ok"), F.col("n"), F.col("had"))
    assert {r.g: (r.written, r.failed, r.bytes, r.status) for r in out.collect()} == {"a": (1, 1, 5, "partial"), "b": (1, 0, 1, "already_complete"), "c": (1, 0, 1, "complete")}


# --- columns, sampling, tiling


def test_scalars(spark):
    row = spark.range(1).select(C.slugify(F.lit("  A b--C! ")).alias("s"), C.slugify(F.lit("!!")).alias("d"), C.blob_path(F.lit(123456)).alias("p"), C.softplus(F.lit(800.0)).alias("big"), C.softplus(F.lit(-800.0)).alias("small")).first()
    assert tuple(row) == ("a-b-c", "run", "blobs/123/0123456.png", 800.0, 0.0)
    lr = [r[0] for r in spark.range(0, 101).select(C.warmup_cosine(F.col("id"), 10, 100)).collect()]
    assert lr[0] == 0.1 and lr[9] == 1 and lr[10] == 1 and lr[100] == 0 and lr[10:] == sorted(lr[10:], reverse=True)


def test_ranks_splits_and_batches(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 7)
    d = sampling.deck(df, "id", "s")
    assert sorted(r["rank"] for r in d.collect()) == list(range(1, 1001))
    s = sampling.seeded_split(df, "id", 600, 300, "s").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in s} == {"train": 600, "eval": 300}
    with pytest.raises(ValueError):
        sampling.seeded_split(df, "id", 900, 200, "s")
    small = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, g string")
    got = sampling.k_per_group(small, "g", "id", 4, "s").collect()
    assert sorted((r.g, r.slot) for r in got) == [(g, i) for g in "ab" for i in range(4)]
    assert {r.id for r in got if r.g == "a"} == {1, 2}
    b = sampling.batch_table(df, "g", "id", 3, 2, "s").collect()
    assert len(b) == 3 * 2 * 3 and {r.batch_id for r in b} == {0, 1, 2}
    leak = sampling.leakfree_split(df, "g", 40, "s").groupBy("g").agg(F.countDistinct("split").alias("n")).collect()
    assert {r.n for r in leak} == {1}


def test_tile_starts(spark):
    at = lambda side, size, stride: spark.range(1).select(tiling.starts(F.lit(side), size, stride)).first()[0]
    assert at(980, 490, 490) == [0, 490] and at(1000, 490, 490) == [0, 490, 510] and at(300, 490, 490) == [0] and at(490, 490, 490) == [0]
    assert tiling.stride_of(100, 0.25) == 75
    with pytest.raises(ValueError):
        tiling.stride_of(10, 1.0)
    docs = spark.createDataFrame([(1, "ab" * 30), (2, " " * 50), (3, None), (4, "x" * 25 + " " * 15)], "id long, t string")
    got = {}
    for r in tiling.tile_text(docs, "id", "t", 20).collect():
        got.setdefault(r.id, []).append(r.start)
    assert {k: sorted(v) for k, v in got.items()} == {1: [0, 20, 40], 2: [15], 3: [0], 4: [0]}


def png(pixels: np.ndarray) -> bytes:
    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_page_images(spark, tmp_path, rng):
    black, white = np.zeros((980, 980, 3)), np.full((980, 980, 3), 255)
    for name, a in (("black", black), ("white", white), ("snap", np.zeros((1000, 490, 3))), ("small", np.zeros((300, 300, 3)))):
        (tmp_path / f"{name}.png").write_bytes(png(a))
    images = spark.read.format("image").load(str(tmp_path))
    rows = tiling.tile_images(images).collect()
    got = {}
    for r in rows:
        assert len(r.pixels) == 224 * 224 * 3
        got.setdefault(r.origin.rsplit("/", 1)[1], []).append((r.x, r.y))
    assert sorted(got["black.png"]) == [(0, 0), (0, 490), (490, 0), (490, 490)]
    assert got["white.png"] == [(245, 245)] and sorted(got["snap.png"]) == [(0, 0), (0, 490), (0, 510)] and got["small.png"] == [(0, 0)]
    assert len(tiling.tile_images(images, centre_only=True).collect()) == 4
    noise = rng.integers(0, 255, (64, 64, 3))
    (tmp_path / "n1.png").write_bytes(png(noise))
    (tmp_path / "n2.png").write_bytes(png(np.clip(noise + 2, 0, 255)))
    h = {r.origin.rsplit("/", 1)[1]: r.hash & (2**64 - 1) for r in tiling.image_hash(spark.read.format("image").load(f"{tmp_path}/n*.png")).collect()}
    assert (h["n1.png"] ^ h["n2.png"]).bit_count() <= 6


def test_encoder_runs_in_batches(spark):
    df = spark.createDataFrame([(i, "x" * (i + 1)) for i in range(10)], "id long, t string")
    got = {r.id: r.embedding for r in encode_with(df, "id", "t", lambda: lambda items: np.array([[len(t), 1.0] for t in items]), batch=3).collect()}
    assert len(got) == 10 and got[2] == pytest.approx([3 / math.sqrt(10), 1 / math.sqrt(10)])
    with pytest.raises(KeyError):
        named({"a": 1}, "b")


# --- retrieval


def test_topk_by_blocks_equals_broadcast(spark, rng):
    x = unit(rng.standard_normal((300, 8)))
    x[10] = x[20] = x[30]
    items = crops_of(spark, x, np.zeros(300)).select(F.col("crop_id").alias("id"), "v")
    old, vectors.BLOCK = vectors.BLOCK, 64
    try:
        a, b = (sorted(map(tuple, vectors.topk(items, items, 5, limit=n).collect())) for n in (10**9, 0))
    finally:
        vectors.BLOCK = old
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -9)
    want = sorted((q, int(i), s[q, i], r + 1) for q in range(300) for r, i in enumerate(np.lexsort((np.arange(300), -s[q]))[:5]))
    flat = lambda rows: [(q, i, r) for q, i, _, r in rows]
    assert flat(a) == flat(b) == flat(want)


def loo(x, groups):
    hits, pages = [], sorted(set(groups))
    for i, g in enumerate(groups):
        if groups.count(g) < 2:
            continue
        scores = []
        for p in pages:
            s = sum(x[j] for j in range(len(x)) if groups[j] == p and j != i)
            scores.append((-round(float(x[i] @ s / max(np.linalg.norm(s), 1e-12)), 9), p))
        hits.append([p for _, p in sorted(scores)].index(g) + 1)
    return hits


def test_leave_one_out(spark, rng):
    groups = [0, 0, 0, 1, 1, 2, 3, 3, 3, 3]
    x = unit(rng.standard_normal((10, 6)) + 2 * np.eye(10, 6)[groups])
    ranks = loo(x, groups)
    crops = crops_of(spark, x, groups)
    got = {r.k: (r.hits, r.total) for r in retrieval.recall_loo_groups(crops, (1, 2, 4)).collect()}
    assert got == {k: (sum(r <= k for r in ranks), len(ranks)) for k in (1, 2, 4)}
    assert {r.k: (r.hits, r.total) for r in retrieval.recall_loo_groups(crops.repartition(7).orderBy(F.rand(1)), (1, 2, 4)).collect()} == got
    sums = retrieval.vector_sum(crops, "page_id").select("page_id", "s", "n")
    own = retrieval.loo_scores(crops).select("crop_id", "page_id", "n", "own")
    gallery = sums.select(F.col("page_id").alias("id"), C.l2_normalize(F.col("s")).alias("v"))
    blocks = retrieval._loo_blocked(crops.drop("page_id").join(own, "crop_id"), gallery, 4)
    assert {r.crop_id: r.better for r in blocks.collect()} == {r.crop_id: r.better for r in retrieval.loo_scores(crops).collect()}


def test_recall_is_monotone_and_empty_input_is_zero(spark, rng):
    crops = crops_of(spark, unit(rng.standard_normal((40, 5))), rng.integers(0, 6, 40))
    for f in (retrieval.recall_items, retrieval.recall_loo_groups, retrieval.recall_group_mean):
        r = [x.recall for x in f(crops).orderBy("k").collect()]
        assert r == sorted(r)
    assert {(r.hits, r.total, r.recall) for r in retrieval.recall_items(crops.limit(0)).collect()} == {(0, 0, 0.0)}
    assert {(r.hits, r.total) for r in retrieval.recall_items(crops.where("crop_id = 0")).collect()} == {(0, 0)}


def test_sums_give_the_means_of_pairs(spark, rng):
    x, g = unit(rng.standard_normal((30, 7))), rng.integers(0, 4, 30)
    s, same = x @ x.T, g[:, None] == g[None, :]
    off = ~np.eye(30, dtype=bool)
    r = retrieval.sim_sanity(crops_of(spark, x, g)).first()
    assert (r.same_mean, r.diff_mean) == pytest.approx((s[same & off].mean(), s[~same].mean()), abs=2e-6)
    parts = {p.part: p.same_mean for p in retrieval.sim_decompose(crops_of(spark, x, g), {"a": (1, 3), "b": (4, 4), "all": (1, 7)}).collect()}
    assert parts["a"] + parts["b"] == pytest.approx(parts["all"], abs=3e-6)


def test_macro_and_micro_means_differ(spark, rng):
    x = unit(rng.standard_normal((12, 4)))
    trip = spark.createDataFrame([(0, "pos", 1), (0, "pos", 2), (0, "pos", 3), (0, "neg", 4), (5, "pos", 6), (5, "neg", 7), (8, "pos", 99), (8, "neg", 9)], "anchor long, role string, member long")
    c = crops_of(spark, x, np.zeros(12))
    macro, micro = (retrieval.triplet_recall(trip, c, c, (1,), micro=m).first() for m in (False, True))
    assert macro.total == micro.total == 2 and macro.pos_mean != micro.pos_mean
    assert micro.pos_mean == pytest.approx(np.mean([x[0] @ x[1], x[0] @ x[2], x[0] @ x[3], x[5] @ x[6]]), abs=1e-6)


# --- contrastive batches


def test_losses(spark, rng):
    proto = np.repeat(np.eye(4, 16), 4, axis=0)
    perfect = batch_of(spark, proto, np.arange(4).repeat(4))
    assert contrastive.build_loss("infonce")(perfect).first().loss < 1e-3
    random = batch_of(spark, unit(rng.standard_normal((32, 128))), np.arange(8).repeat(4))
    assert 1 <= contrastive.loss_infonce(random).first().loss <= 10
    for name in contrastive.LOSSES:
        assert 0 <= contrastive.build_loss(name)(random).first().loss < 100
        assert contrastive.build_loss(name)(batch_of(spark, np.eye(3), [0, 1, 2])).first().loss == 0
    stats = contrastive.batch_stats(random).first()
    assert (stats.positives, stats.negatives) == (3, 28)
    assert contrastive.top1_accuracy(perfect).first().accuracy == 1
    with pytest.raises(KeyError):
        contrastive.build_loss("other")


# --- alignment and erasure


def pair(spark, x, z):
    return spark.createDataFrame([(i, [float(c) for c in a], [float(c) for c in b]) for i, (a, b) in enumerate(zip(x, z))], "crop_id long, x array<double>, z array<double>")


def hsic_u(k, l_):
    k, l_, n = k - np.diag(np.diag(k)), l_ - np.diag(np.diag(l_)), len(k)
    return (np.trace(k @ l_) + k.sum() * l_.sum() / ((n - 1) * (n - 2)) - 2 * (k @ l_).sum() / (n - 2)) / (n * (n - 3))


@pytest.mark.parametrize("dx, dz", [(6, 6), (8, 5), (4, 7)])
def test_alignment_against_kernels(spark, rng, dx, dz):
    x = rng.standard_normal((50, dx)) + 1
    z = x[:, : min(dx, dz)] @ rng.standard_normal((min(dx, dz), dz)) + 0.3 * rng.standard_normal((50, dz))
    df = pair(spark, x, z)
    got = moments.hsic_unbiased_all(df)
    for key, a, b in (("xz", x, z), ("xx", x, x), ("zz", z, z)):
        assert got[key] == pytest.approx(hsic_u(a @ a.T, b @ b.T), rel=1e-9)
    h = np.eye(50) - 1 / 50
    assert moments.hsic_biased(df) == pytest.approx(np.trace(h @ x @ x.T @ h @ z @ z.T) / 49**2, rel=1e-9)
    xc, zc = x - x.mean(0), z - z.mean(0)
    xc, zc = xc / np.linalg.norm(xc), zc / np.linalg.norm(zc)
    u, s, vt = np.linalg.svd(xc.T @ zc, full_matrices=False)
    assert moments.procrustes(df) == pytest.approx(np.linalg.norm(xc @ u @ vt - zc), abs=1e-6)


def test_alignment_invariants(spark, rng):
    x = rng.standard_normal((40, 6))
    q, _ = np.linalg.qr(rng.standard_normal((6, 6)))
    df = pair(spark, x, x @ q)
    assert moments.cka(df) == pytest.approx(1) and moments.procrustes(df) == pytest.approx(0, abs=1e-6)
    a, b = (crops_of(spark, unit(y), np.zeros(40)) for y in (x, x @ q))
    assert moments.mutual_knn(a, b, 5).first().overlap == 1
    assert moments.hsic_unbiased_all(pair(spark, x[:3], x[:3]))["xz"] is None


def test_eraser(spark, rng):
    z = rng.integers(0, 2, 600)
    x = rng.standard_normal((600, 8))
    x[:, 0] += 4 * z
    crops = crops_of(spark, x, z)
    one = F.array((F.col("page_id") == 0).cast("double"), (F.col("page_id") == 1).cast("double"))
    e = moments.fit_eraser(moments.moments(crops.select(F.col("v").alias("x"), one.alias("z"))))
    gone = e.apply(crops, normalise=False)
    y = np.array([r.v for r in gone.orderBy("crop_id").collect()])
    assert abs((y - y.mean(0)).T @ (z - z.mean()) / 600).max() < 1e-5
    assert moments.linear_probe(crops, "page_id", 2) > 0.95 and moments.linear_probe(gone, "page_id", 2) < 0.6


def test_erasers_of_all_ranks_from_one_pass(spark, rng):
    x = rng.standard_normal((80, 6))
    z = x - np.outer(rng.standard_normal(80), np.arange(6)) - 0.1 * rng.standard_normal((80, 6))
    df = pair(spark, x, z)
    m = moments.moments(df.select(F.zip_with("x", "z", lambda a, b: a - b).alias("x"), F.array(F.lit(0.0)).alias("z")))
    both = moments.delta_erasers(df, [1, 3])
    for rank in (1, 3):
        v, share = moments.delta_pca(df, rank)
        assert list(share) == sorted(share, reverse=True)
        d = x - z - m.mean_x
        direct = moments.fit_eraser(moments.moments(pair(spark, x, d @ v)))
        assert np.allclose(direct.matrix, both[rank].matrix, atol=1e-6)


def test_adapter_recovers_a_linear_map(spark, rng):
    x, w = rng.standard_normal((100, 5)), rng.standard_normal((5, 4))
    m, before, after = moments.linear_adapter(pair(spark, x, x @ w + 1), ridge=1e-9)
    assert np.allclose(m, w, atol=1e-6) and np.allclose((x - before) @ m + after, x @ w + 1, atol=1e-6)


# --- patches and words


def test_transport_marginals(spark, rng):
    rows = [(i, p, c, float(s)) for i in range(3) for p in range(9) for c, s in enumerate(rng.standard_normal(4) * 2)]
    p = patches.ot_assign(spark.createDataFrame(rows, "item long, patch long, cluster int, score double"), 4, 9, 1.0, iterations=5)
    by = lambda *k: {tuple(r)[:-1]: r.m for r in p.groupBy(*k).agg(F.sum("p").alias("m")).collect()}
    assert all(m == pytest.approx(1, abs=1e-6) for m in by("item", "patch").values())
    assert all(m == pytest.approx(5 if k[1] == 4 else 1, abs=0.1) for k, m in by("item", "cluster").items())
    assert all(0 <= r.dustbin <= 1 for r in patches.dustbin_mass(p, 4).collect())
    with pytest.raises(ValueError):
        patches.ot_assign(spark.createDataFrame(rows, "item long, patch long, cluster int, score double"), 4, 4, 1.0)


def test_region_without_cells_is_zero(spark):
    cells = spark.createDataFrame([(1, 0, 0, 2.0), (1, 0, 1, 4.0), (1, 1, 0, 3.0), (1, 1, 1, 3.0)], "item long, r long, c long, value double")
    boxes = spark.createDataFrame([(1, 0, 0.0, 0.0, 2.0, 1.0), (1, 1, 5.0, 5.0, 6.0, 6.0), (1, 2, 0.5, 0.0, 2.0, 2.0), (1, 3, 1.0, 1.0, 1.0, 1.0)], "item long, box long, x0 double, y0 double, x1 double, y1 double")
    got = {r.box: r.value for r in patches.region_mean(cells, boxes).collect()}
    assert got == {0: 0.5, 1: 0.0, 2: pytest.approx((0.5 * 0 + 1 + 0.5 * 0.5 + 0.5) / 3, abs=1e-6), 3: 0.0}


def test_words(spark):
    df = spark.createDataFrame([(1, ' "Hello," (World)  it\'s... -- hello'), (2, None)], "id long, t string")
    w = patches.word_table(df, "id", "t")
    assert [r.word for r in w.orderBy("pos").collect()] == ["hello", "world", "it's", "--", "hello"]
    first = patches.first_word_value(w.withColumn("value", F.col("pos")), "id")
    assert {r.word: r.value for r in first.collect()}["hello"] == 0


# --- near-duplicates


def leaders(hashes, t):
    reps, out = [], {}
    for i, h in hashes:
        rep = next((r for r, g in reps if (g ^ h).bit_count() <= t), None)
        if rep is None:
            reps.append((i, h))
            rep = i
        out[i] = (rep, [r for r, _ in reps].index(rep))
    return out


def test_leaders_are_the_sequential_loop(spark, rng):
    base = [int(x) for x in rng.integers(0, 2**60, 12)]
    hashes = []
    for i in range(220):
        h = base[int(rng.integers(12))]
        for b in rng.choice(60, int(rng.integers(0, 7)), replace=False):
            h ^= 1 << int(b)
        hashes.append((i, h))
    for chain in ((0, 0x3F, 0xFFF), (0x3F, 0, 0xFFF), (0, 0xFFF, 0x3F)):  # ends are farther apart than the limit
        hashes += [(len(hashes) + k, h | 1 << 58) for k, h in enumerate(chain)]
    df = spark.createDataFrame(hashes, "id long, hash long")
    got = {r.id: (r.rep, r.cluster_id) for r in neardup.leader_clusters(df, "id").collect()}
    assert got == leaders(hashes, 6)
    pairs = {(r.a, r.b): (r.distance, r.pairs) for r in neardup.hamming_pairs(df, "id").collect()}
    ids = {h: [i for i, g in hashes if g == h] for _, h in hashes}
    want = {tuple(sorted((min(ids[g]), min(ids[h])))): ((g ^ h).bit_count(), len(ids[g]) * len(ids[h])) for g in ids for h in ids if g < h and (g ^ h).bit_count() <= 6}
    assert pairs == want | {(min(x), min(x)): (0, len(x) * (len(x) - 1) // 2) for x in ids.values() if len(x) > 1}
    assert {(r.id, r.rep) for r in neardup.hash_members(df, "id").collect()} == {(i, min(ids[h])) for i, h in hashes}
    assert sum(r.members for r in neardup.cluster_histogram(neardup.leader_clusters(df, "id")).collect()) == len(hashes)


# --- roll-ups


def test_spearman_ties_and_constants(spark):
    rows = [(1, float(x), float(y)) for x, y in zip([1, 2, 2, 3, 5], [2, 1, 1, 4, 4])] + [(2, 1.0, float(y)) for y in range(3)] + [(3, 1.0, None)]
    got = {r.g: r.rho for r in runs.spearman(spark.createDataFrame(rows, "g long, x double, y double"), "g", "x", "y").collect()}
    rank = lambda v: [sorted(v).index(a) + (v.count(a) - 1) / 2 for a in v]
    want = np.corrcoef(rank([1, 2, 2, 3, 5]), rank([2, 1, 1, 4, 4]))[0, 1]
    assert got == {1: pytest.approx(want, abs=1e-6), 2: None}
    rhos = spark.createDataFrame([(0.83, 6), (0.0, 10), (1.0, 5), (-1.0, 4), (0.5, 2), (None, 9), (0.999, 40), (0.02, 5000)], "rho double, n long")
    p = [r.p for r in runs.with_p(rhos).collect()]
    assert p[0] == pytest.approx(0.0408, abs=5e-4) and p[1] == pytest.approx(1) and p[2:6] == [0, 0, None, None] and 0 <= p[6] < 1e-12 and p[7] == pytest.approx(0.1573, abs=1e-3)


def test_running_best_is_strict(spark):
    rows = [("a", i, v) for i, v in enumerate([0.2, 0.5, 0.5, 0.4, 0.6])] + [("b", i, v) for i, v in enumerate([0.9, 0.1, None])]
    df = spark.createDataFrame(rows, "run string, step long, v double")
    assert sorted((r.run, r.step) for r in runs.running_best(df, "run", "step", "v").collect()) == [("a", 0), ("a", 1), ("a", 4), ("b", 0)]


def test_alignment_without_partner_is_zero(spark):
    df = spark.createDataFrame([("a", "b", 0.5)], "a string, b string, value double")
    got = {r.enc: (r.best, r.partner) for r in runs.best_alignment(df, spark.createDataFrame([("a",), ("c",)], "enc string")).collect()}
    assert got == {"a": (0.5, "b"), "c": (0.0, None)}


def test_page_tiles_hold_every_page_whole(spark, tmp_path):
    """Rasters and tiles against numpy: pages of any length, none left out and none cut."""
    pages = [(r.page_id, bytes(r.html, "utf-8") if isinstance(r.html, str) else bytes(r.html)) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html").collect()]
    pages += [(10**6, b""), (10**6 + 1, None), (10**6 + 2, b"x"), (10**6 + 3, b"ab" * 96), (10**6 + 4, b"y" * 193), (10**6 + 5, bytes(range(32, 127)) * 700)]
    spark.createDataFrame(pages, "page_id long, html binary").write.parquet(str(tmp_path / "pages.parquet"))
    want, rasters = set(), {}
    for page, b in pages:
        b = b or b""
        h = max(1, -(-len(b) // 192))
        data = rasters[str(page)] = b + bytes(h * 192 - len(b))
        a = np.frombuffer(data, np.uint8).reshape(h, 64, 3)
        ys = [0] if h <= 40 else sorted({*range(0, h - 40, 40), h - 40})
        inked = [(x, y) for y in ys for x in (0, 24) if (a[y : y + 40, x : x + 40].mean(2) < 240).mean() >= 0.05]
        assert inked, "text is ink"
        want |= {(str(page), x, y, 768) for x, y in inked}
    assert {r.origin: bytes(r.data) for r in q_corpus.page_rasters(spark, str(tmp_path)).select("image.*").collect()} == rasters
    got = [tuple(r) for r in q_corpus.tile_images(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


# --- streams


def test_ingest_goes_on_after_a_restart(spark, tmp_path):
    df = spark.range(10).select(F.col("id").alias("idx"))
    source, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    df.where("idx < 5").write.parquet(f"{source}/a")
    schema = df.schema
    stream = lambda: spark.readStream.schema(schema).parquet(f"{source}/*")
    S.ingest(stream(), out, ck)
    df.where("idx >= 5").write.parquet(f"{source}/b")
    S.ingest(stream(), out, ck)
    assert sorted(r.idx for r in spark.read.parquet(out).collect()) == list(range(10))


@pytest.mark.parametrize("reverse", [False, True])
def test_dedup_whatever_the_order_of_files(spark, monkeypatch, reverse):
    """The files' modification times are set, against the order of their rows' times too: no event is dropped as late."""
    want = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    make = S.file_stream

    def touched(spark, path, schema, files=1):
        paths = sorted(Path(path.removeprefix("file:")).glob("*.parquet"), reverse=reverse)
        for i, p in enumerate(paths):
            os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
        return make(spark, path, schema, files)

    monkeypatch.setattr(S, "file_stream", touched)
    got = q_streams.stream_dedup(spark, "/root/testdata/sf0.001")
    assert got.count() == want == got.select("event_id").distinct().count()


def test_streams_write_files_and_not_to_the_driver(spark):
    """No result is a table of the memory sink; a run's rows are dealt to many files, not one."""
    before = {t.name for t in spark.catalog.listTables()}
    for f in (q_streams.stream_dedup, q_streams.stream_best, q_streams.stream_metrics):
        assert f(spark, "/root/testdata/sf0.001").inputFiles()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_running_best_takes_a_batch_in_any_order(spark, tmp_path):
    """A run of 25,000 rows comes to its state in several Arrow batches, from the last step to the first."""
    source = str(tmp_path / "in")
    spark.range(25_000).select(F.lit(1).cast("long").alias("run_id"), (25_000 - F.col("id")).alias("step"), (25_000 - F.col("id")).cast("double").alias("value")).coalesce(1).write.parquet(source)
    stream = S.file_stream(spark, source, spark.read.parquet(source).schema)
    got = states.to_files(states.running_best(stream, "run_id", "step", "value"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert got.where("not late").count() == 25_000


def test_file_inventory_range_and_archive(spark, tmp_path):
    rows = spark.range(250).select("id", F.lpad(F.floor(F.col("id") / 50).cast("string"), 4, "0").alias("file"))
    path = f"{tmp_path}/files"
    rows.repartition("file").write.partitionBy("file").parquet(path)
    found = M.file_inventory(spark.read.parquet(path)).orderBy("start").collect()
    assert [(r.rows, r.start, r.stop) for r in found] == [(50, 50 * i, 50 * i + 50) for i in range(5)]
    part = M.file_range(spark.read.parquet(path), 1, 3)
    assert sorted(r.id for r in part.select("id").collect()) == list(range(50, 150))
    assert M.file_range(spark.read.parquet(path), 7, 9).count() == 0
    archive = f"{tmp_path}/archive"
    assert len(M.archive_shards(spark, path, archive)) == 5 and M.archive_shards(spark, path, archive) == []
    assert spark.read.parquet(archive).count() == 250


def test_names_of_encoders_and_saliencies(spark):
    df = spark.createDataFrame([(1, "Abba"), (2, None), (3, "")], "id long, text string")
    got = {r.id: r.embedding for r in encode.encode_by_name(df, "id", "text", "letters").collect()}
    assert got[1][:2] == pytest.approx([0.5**0.5] * 2) and set(got[2]) == {0.0} == set(got[3])
    with pytest.raises(KeyError):
        encode.encode_by_name(df, "id", "text", "nothing")
    with pytest.raises(KeyError):
        patches.saliency_by_name(df, "nothing")


def test_blanked_and_broken_images(spark):
    image = lambda o, h, w, data: (o, h, w, 3, 16, bytearray(data))
    rows = [(image("a", 10, 4, bytes(range(120))),), (image("b", 1, 1, b"abc"),), (image("c", 2, 2, b"short"),)]
    df = spark.createDataFrame(rows, "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    got = {r.origin: bytes(r.data) for r in tiling.blank_images(df, 0.25).select("image.*").collect()}
    assert got["a"] == b"\xff" * 36 + bytes(range(36, 120)) and got["b"] == b"abc"  # round(2.5) is 3, as halves go up
    assert {r.origin: r.hash is None for r in tiling.image_hash(df).collect()} == {"a": False, "b": False, "c": True}


def test_erasure_scores(spark):
    rng = np.random.default_rng(5)
    x, z = rng.standard_normal((40, 5)), rng.standard_normal((40, 5))
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, z))], "crop_id long, x array<double>, z array<double>")
    got = {}
    for r in moments.delta_scores(df, "crop_id", 2).collect():
        got[r.crop_id, r.r] = r.z
    d = (x - z) - (x - z).mean(0)
    u, s, _ = np.linalg.svd(d, full_matrices=False)
    assert np.allclose(np.abs([[got[i, r] for r in range(2)] for i in range(40)]), np.abs(u[:, :2] * s[:2]))
