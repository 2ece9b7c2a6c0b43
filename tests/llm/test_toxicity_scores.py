"""Toxicity scores against FTRL-proximal in plain Python over features that are strings, not hashes."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from embedlens.llm import toxicity
from embedlens.llm.shared import doc_crc

from .conftest import SF

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def strings(text):
    """Distinct words, neighbouring pairs, and pairs around one word; pieces that begin with a mark are no words."""
    words = [w for run in re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ)) for w in re.split(r"(?<=[0-9a-z])(?=[!-/:-@\[-`{-~])", run)]
    words = [w for w in words if not re.match(r"[!-/:-@\[-`{-~]", w)]
    return {(w,) for w in words} | {(1, *p) for p in zip(words, words[1:])} | {(2, *p) for p in zip(words, words[2:])}


def fitted(rows, alpha=5.0, beta=1.0, l1=8.0, epochs=10, positive=3.0, seed=7):
    """Weights by feature, and the bias, of (features, label) in order. Sums of a feature are single precision, as the model keeps them."""
    one = np.float32
    z, n = defaultdict(lambda: one(0)), defaultdict(lambda: one(0))
    bias_z = bias_n = bias = 0.0
    weight = lambda f: one(0) if abs(z[f]) <= l1 else -(z[f] - np.sign(z[f]) * one(l1)) / ((one(beta) + np.sqrt(n[f])) / one(alpha))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            found, y = rows[r]
            w = {f: weight(f) for f in found}
            g = (1 / (1 + math.exp(-max(-35, min(35, float(sum(w.values())) + bias)))) - y) * (positive if y else 1.0)
            for f in found:
                after = n[f] + one(g * g)
                z[f] = z[f] + one(g) - (np.sqrt(after) - np.sqrt(n[f])) / one(alpha) * w[f]
                n[f] = after
            step = (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / alpha
            bias_z += g - step * bias
            bias_n += g * g
            bias = -bias_z / ((beta + math.sqrt(bias_n)) / alpha)
    return {f: float(weight(f)) for f in list(z)}, bias


def test_scores_are_the_models(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect()}
    chosen = sorted(i for i in texts if i in toxic and zlib.crc32(str(i).encode()) % 3 != 1)
    found = {i: strings(t) for i, t in texts.items()}
    often = Counter(f for i in chosen for f in found[i])
    weights, bias = fitted([(sorted((f for f in found[i] if often[f] > 1), key=repr), toxic[i]) for i in chosen])
    assert sum(w != 0 for w in weights.values()) > 10 and {toxic[i] for i in chosen} == {0, 1}
    # with 26 bits some of the ten thousands of features share their hash with another; with 30 hardly one does
    model = toxicity.fit(docs, labels, doc_crc("doc_id") % 3 != 1, hash_bits=30)
    ids = sorted(texts)
    got = toxicity.scorer(model, hash_bits=30)(pa.array([texts[i] for i in ids], pa.string()))
    want = [1 / (1 + math.exp(-(bias + sum(weights.get(f, 0.0) for f in found[i])))) for i in ids]
    assert got.tolist() == pytest.approx(want, abs=1e-4)
    given = {r.doc_id: r for r in toxicity.with_score(docs, labels).collect()}
    assert sum(abs(given[i].score - w) < 1e-2 for i, w in zip(ids, want)) > 0.95 * len(ids)
    assert all(given[i].predicted == (given[i].score >= 0.7) for i in ids)
