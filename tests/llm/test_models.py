"""Operators with a model of their own, and vectors."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedlens.llm import embed_dedup, lm_score, quality, toxicity
from embedlens.llm.components import connected_components
from embedlens.llm.shared import Scratch

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_lm_base_columns(documents, rows, empty):
    tokens = lambda text: [*WORD.findall((text or "").translate(AZ)), None]
    held = lambda doc: zlib.crc32(b"" if doc is None else str(doc).encode()) % 10 == 0
    c = Counter(t for doc, text, *_ in rows if not held(doc) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for doc, text, *_ in rows:
        score = sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(text))
        want[doc, held(doc), len(tokens(text)), sum(c[t] > 0 for t in tokens(text)), n, round(score, 4)] += 1
    got = lm_score.score(documents).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    out = [r for r in got if r.held_out and r.n_tokens > 1]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert lm_score.score(empty).count() == 0


@pytest.mark.parametrize("hot", [1 << 20, 40])
def test_lm_score_is_the_model(documents, rows, hot, monkeypatch):
    """Every row's score by the definition, in plain Python, with all counts broadcast and with rare words joined."""
    monkeypatch.setattr(lm_score, "HOT_WORDS", hot)
    words = lambda text: WORD.findall((text or "").translate(AZ))
    held = lambda doc: zlib.crc32(b"" if doc is None else str(doc).encode()) % 10 == 0
    report = {}
    got = lm_score.score(documents, report=report).collect()
    v, (q1, q2, r, b) = report["vocabulary"], [x.astype(float) for x in report["model"].p]
    assert v.complete == (hot > 40)
    c = Counter(t for doc, text, *_ in rows if not held(doc) for t in words(text))
    hash_of = lambda x: int(lm_score.textnp.words(np.frombuffer(x, np.uint8), np.array([0, len(x)])).hash[0])
    own = {int(h): int(k) for h, k in zip(v.hashes, v.cls) if k >= 0}
    cls = {}
    for w in {w for _, text, *_ in rows for w in words(text)}:
        x = w.encode()
        tail = x[-3:]
        ending = int(lm_score.textnp.span_hash(np.frombuffer(tail, np.uint8), np.array([0]), np.array([len(tail)]))[0]) >> 33
        cls[w] = own.get(hash_of(x), v.own + ending % v.endings)
    mass = Counter()
    for w, n in c.items():
        mass[cls[w]] += n + 0.1
    assert len(own) == v.own and sum(mass.values()) == pytest.approx(v.n - v.docs + 0.1 * (v.v - 1))
    logs, end = {}, v.end

    def log_class(two, one):
        if (two, one) not in logs:
            x = (q1[one] + q2[two]) @ r.T + b
            logs[two, one] = x - x.max() - math.log(np.exp(x - x.max()).sum())
        return logs[two, one]

    want = defaultdict(list)
    for doc, text, *_ in rows:
        two = one = end
        total = 0.0
        for w in [*words(text), None]:
            k = end if w is None else cls[w]
            total += log_class(two, one)[k if w is None or c[w] else v.unseen] / math.log(10)
            if w is not None and c[w] and k >= v.own:
                total += math.log10((c[w] + 0.1) / mass[k])
            two, one = one, k
        want[doc].append(total / (len(words(text)) + 1))
    mine = {}
    for x in got:
        mine.setdefault(x.doc_id, []).append(x.score / x.n_tokens)
    assert mine.keys() == want.keys()
    for doc, scores in want.items():
        assert sorted(mine[doc]) == pytest.approx(sorted(scores), abs=1e-3)


def test_log_bilinear_is_normalised():
    rng = np.random.default_rng(0)
    m = lm_score.LogBilinear(rng.random(300) * 100)
    m.p[0] += rng.standard_normal(m.p[0].shape).astype(np.float32)
    a1, a2, z = m.tables()
    for i, j in rng.integers(0, 300, (20, 2)):
        assert np.exp((a1[i] + a2[j] - z[i, j]).astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_parameters_are_averaged_in_levels(spark):
    rng = np.random.default_rng(2)
    parts = [(p, s, float(p % 5 + 1), rng.random(3).astype(np.float32)) for p in (0, 3, 4, 17, 70) for s in range(2)]
    df = spark.createDataFrame([(p, s, w, x.tobytes()) for p, s, w, x in parts], "part int, shard int, weight double, parameters binary")
    for r in lm_score.averaged(df, fan=4).collect():
        mine = [(w, x) for _, s, w, x in parts if s == r.shard]
        assert np.allclose(np.frombuffer(bytes(r.parameters), np.float32), sum(w * x for w, x in mine) / sum(w for w, _ in mine), atol=1e-6)


def test_toxicity_on_held_out_rows(spark, empty):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.with_score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = ([r.predicted for r in got if r.toxic == k] for k in (1, 0))
    assert np.mean(toxic) >= 0.5 and np.mean(clean) <= 0.02
    assert toxicity.with_score(empty, labels).count() == 0
    none = toxicity.with_score(docs.limit(5), labels.limit(0)).collect()
    assert len(none) == 5 and {r.score for r in none} == {0.5}
    kept = toxicity.with_score(docs, labels, keep="clean")
    assert kept.columns == docs.columns and kept.count() < docs.count()


def test_toxicity_hard_rows(spark, documents, rows):
    labels = spark.createDataFrame([(r[0], 1 if i % 7 == 0 else 0) for i, r in enumerate(rows)] + [(3, None), (4, 1), (4, 0)], "doc_id long, toxic int")
    assert toxicity.with_score(documents, labels).count() == len(rows)


def test_quality_verdicts(spark, documents, rows, empty):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judged(docs).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = ([r.kept for r in got if r.quality == k] for k in (1, 0))
    assert np.mean(good) >= 0.96 and np.mean(bad) <= 0.5
    assert quality.judged(documents).count() == len(rows)
    assert quality.judged(empty).count() == 0
    kept = quality.judged(documents, keep_rows=True)
    assert kept.columns == documents.columns
    both = Counter(r.doc_id for r in quality.judged(documents).where("kept").collect())
    assert Counter(r.doc_id for r in kept.collect()) == both


def plain_kneser_ney(texts):
    """Modified Kneser-Ney over characters by its definition: p(c | a, b) as a function."""
    runs = ["  " + re.sub("[ \t\n\x0b\x0c\r]+", " ", t) for t in texts]
    c3 = Counter(r[i : i + 3] for r in runs for i in range(len(r) - 2))
    c2 = Counter(g[1:] for g in c3)
    c1 = Counter(g[1:] for g in c2)

    def order(counts, context):
        n = [sum(1 for x in counts.values() if x == i) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [min(max(i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.5, 0.05), i) for i in (1, 2, 3)]
        total, cut = Counter(), Counter()
        for g, x in counts.items():
            total[context(g)] += x
            cut[context(g)] += d[min(x, 3) - 1]
        return {g: (x - d[min(x, 3) - 1]) / total[context(g)] for g, x in counts.items()}, {h: cut[h] / total[h] for h in total}

    own3, back3 = order(c3, lambda g: g[:2])
    own2, back2 = order(c2, lambda g: g[:1])
    own1, back1 = order(c1, lambda g: "")

    def p(g):
        p1 = own1.get(g[2], 0) + back1[""] / (len(c1) + 1)
        p2 = own2.get(g[1:], 0) + back2.get(g[1], 1) * p1
        return own3.get(g, 0) + back3.get(g[:2], 1) * p2

    return runs, p


def plain_bands(scores, spread=5.0, step=0.001):
    bins = sorted(round(min(x, 12.0) / step) for x in scores)
    q1, q2, q3 = (next(b for i, b in enumerate(bins, 1) if i >= q * len(bins)) * step for q in (0.25, 0.5, 0.75))
    return q2 - spread * max(q2 - q1, 3 * step), q2 + spread * max(q3 - q2, 3 * step)


@pytest.mark.parametrize("limit", [quality.MODEL_ENTRIES, 0])
def test_quality_is_kneser_ney(spark, documents, rows, limit, monkeypatch):
    """Scores and verdicts of all rows against plain Python, with models broadcast and with models dealt by language."""
    monkeypatch.setattr(quality, "GROUP_TEXTS", 50)
    by_lang, want, judged = {}, {}, Counter()
    for doc, text, lang, *_ in rows:
        by_lang.setdefault(lang, []).append(text)
    failed = quality.base_counts(__import__("pyarrow").array([r[1] for r in rows]))
    failed = quality.base_failed(failed["n_words"], failed["n_repeat_words"])
    score = {}
    for lang, texts in by_lang.items():
        runs, p = plain_kneser_ney([t for t in texts if t is not None])
        for t, r in zip((t for t in texts if t is not None), runs):
            score[lang, t] = (len(r) - 2, -sum(math.log10(p(r[i : i + 3])) for i in range(len(r) - 2)) / max(len(r) - 2, 1))
        score[lang, None] = (0, 0.0)
    for lang in by_lang:
        passed = [score[lang, t][1] for (_, t, x, *_), bad in zip(rows, failed) if x == lang and not bad]
        want[lang] = plain_bands(passed) if passed else (-math.inf, math.inf)
    for (doc, text, lang, *_), bad in zip(rows, failed):
        n, x = score[lang, text]
        more = 0.5 / math.sqrt(max(n, 1))
        judged[doc, lang, round(x, 4), bool(not bad and want[lang][0] - more <= x <= want[lang][1] + more)] += 1
    got = quality.judged(documents, limit=limit).collect()
    assert Counter((r.doc_id, r.lang, round(r.log_perplexity, 4), r.kept) for r in got) == judged


def test_kneser_ney_is_normalised(spark):
    rng = np.random.default_rng(4)
    letters = np.arange(97, 103)
    grams = {tuple(rng.choice(letters, 3)): int(rng.integers(1, 6)) for _ in range(60)}
    pack = lambda a, b, c: (int(a) << 42) | (int(b) << 21) | int(c)
    counts = spark.createDataFrame([(5, pack(*g), n) for g, n in grams.items()], "lang_key long, gram long, n long")
    model = quality.Model.of(quality.kneser_ney(counts, Scratch(spark, "t")).toArrow())
    seen = sorted({g[2] for g in grams})
    for a, b in [*[(g[0], g[1]) for g in list(grams)[:10]], (33, 97), (34, 35)]:
        p = 10 ** model.log10(5, np.array([pack(a, b, c) for c in [*seen, 36]]))
        assert p.sum() == pytest.approx(1, abs=1e-4)


def brute_links(rows, threshold):
    out = []
    for i, (_, v, label) in enumerate(rows):
        links = []
        for j, (_, w, other) in enumerate(rows):
            if i != j and label is not None and label == other and v and w and len(v) == len(w) and None not in v and None not in w:
                a, b = np.array(v, float), np.array(w, float)
                if np.isfinite(a).all() and np.isfinite(b).all() and np.linalg.norm(a) > 0 and np.linalg.norm(b) > 0 and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    links.append(j)
        out.append(links)
    return out


def test_embedding_groups(spark):
    rng = np.random.default_rng(8)
    unit = lambda x: (x / np.linalg.norm(x)).astype(np.float32).astype(float).tolist()
    rows = [(i, unit(rng.standard_normal(16)), int(rng.integers(3))) for i in range(300)]
    hub = rng.standard_normal(16)
    rows += [(1000 + i, unit(hub + 0.08 * rng.standard_normal(16)), 1) for i in range(90)]  # a dense group beyond any list
    rows += [(2000 + i, rows[5][1], rows[5][2]) for i in range(30)]  # exact copies
    rows += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [float("nan")] * 16, 1), (3003, [None] + [1.0] * 15, 1), (3004, rows[5][1], None), (3005, [1.0, 2.0], 1), (3006, [2.0, 4.0], 1), (3007, [], 1), (3008, [x * 1e-30 for x in rows[7][1]], rows[7][2])]
    links = brute_links(rows, 0.98)
    report = {}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embed_dedup.embedding_groups(df, report=report).collect()}
    assert {r[0]: len(x) for r, x in zip(rows, links)} == {k: r.n_links for k, r in got.items()}
    parent = list(range(len(rows)))
    for _ in rows:
        for i, x in enumerate(links):
            parent[i] = min([parent[i], *(parent[j] for j in x)])
    assert {rows[i][0]: rows[p][0] for i, p in enumerate(parent)} == {k: r.component_id for k, r in got.items()}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert report["found"] >= 0.9 * report["all"]
    assert embed_dedup.embedding_groups(df.limit(0)).count() == 0


def test_embedding_subclusters_that_fill_the_lists(spark):
    """Each node's list is full of its own subcluster; the links between the subclusters count all the same."""
    rng = np.random.default_rng(3)
    dim = 64
    a, turn = np.linalg.qr(rng.standard_normal((dim, 2)))[0].T
    b = 0.985 * a + math.sqrt(1 - 0.985**2) * turn
    near = lambda x: (x + math.sqrt(1 / 0.9995**2 - 1) / math.sqrt(dim) * rng.standard_normal(dim)).tolist()
    rows = [(i, near(a if i < 20 else b), 4) for i in range(40)] + [(100 + i, rng.standard_normal(dim).tolist(), 4) for i in range(200)]
    want = brute_links(rows, 0.98)
    assert any(i < 20 <= j < 40 for i, links in enumerate(want) for j in links), "no links between the subclusters"
    report = {}
    got = {r.vec_id: r for r in embed_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), report=report).collect()}
    assert {r[0]: len(x) for r, x in zip(rows, want)} == {k: r.n_links for k, r in got.items()}
    assert {got[i].component_id for i in range(40)} == {0} and report["found"] == report["all"]


def test_embedding_audit_continues_exactly(spark, monkeypatch):
    """Leaves of one row find nothing: the audit says so, and the label is counted whole."""
    monkeypatch.setattr(embed_dedup, "_leaves", lambda nodes, sizes, trees: nodes.select(F.col("id").alias("g"), "id", "unit"))
    rng = np.random.default_rng(4)
    hub = rng.standard_normal(16)
    rows = [(i, (hub + 0.05 * rng.standard_normal(16) if i < 60 else rng.standard_normal(16)).tolist(), 2) for i in range(120)]
    want = brute_links(rows, 0.98)
    report = {}
    got = {r.vec_id: r for r in embed_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), report=report).collect()}
    assert {r[0]: len(x) for r, x in zip(rows, want)} == {k: r.n_links for k, r in got.items()}
    assert report["exact_labels"] == 1 and report["found"] == report["all"] > 0


A, B = [1.0, 0.0], [0.0, 1.0]
NEAR_A, NEAR_B = [1.0, 0.05], [0.05, 1.0]


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(1, A, 0), (1, B, 0), (2, B, 0), (None, A, 0)], [(1, 1, 1, True)] * 2 + [(2, 1, 1, False), (None, 1, 1, False)]),
        ([(1, A, 0), (1, A, 1), (2, NEAR_A, 0), (3, NEAR_A, 1)], [(1, 1, 1, True)] * 2 + [(2, 1, 1, False), (3, 1, 1, False)]),
        ([(1, A, 0), (1, B, 0), (2, NEAR_A, 0), (3, NEAR_B, 0)], [(1, 1, 1, True)] * 2 + [(2, 1, 1, False), (3, 1, 1, False)]),
        ([(None, A, 0), (None, NEAR_A, 0), (None, None, 0), (5, [3e-200, 4e-200], 0), (6, [3e200, 4e200], 0)], [(None, 1, None, False)] * 2 + [(None, 0, None, False), (5, 1, 5, True), (6, 1, 5, False)]),
    ],
)
def test_embedding_rows_that_share_an_id(spark, rows, want):
    got = embed_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_components(spark):
    rng = np.random.default_rng(6)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 150, (90, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    parent = {x: x for e in links for x in e}
    for _ in parent:
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"))
    assert {r.node: r.component for r in got.collect()} == parent
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0
