"""Training of the log-bilinear model against its definition in float64."""

import numpy as np
import pytest

from embedlens.llm import lm_score


@pytest.mark.parametrize("k", [50, 1 << 17])
@pytest.mark.parametrize("order", [np.sort, lambda x: x])
def test_rows_are_summed_by_class(k, order):
    rng = np.random.default_rng(k)
    at, g = order(rng.integers(0, k, 400)), rng.standard_normal((400, 6)).astype(np.float32)
    before = g.copy()
    keys, sums = lm_score._summed(at, g, k, np.empty_like(g))
    assert keys.tolist() == np.unique(at).tolist() and (g == before).all()
    assert np.allclose(sums, [before[at == x].sum(0) for x in keys], atol=1e-5)


def plain(model, code, weight, rng):
    q1, q2, r, b = (x.astype(float) for x in model.p)
    k, state = model.size, [np.full_like(x, 0.0) for x in (q1, q2, r, b)]
    cumulative, log_noise, order = np.cumsum(model.share), np.log(lm_score.NOISE * model.share), rng.permutation(len(code))
    for a in range(0, len(code), lm_score.BATCH):
        pick = order[a : a + lm_score.BATCH]
        w, c1, c2, m = code[pick] % k, code[pick] // k % k, code[pick] // k**2, weight[pick]
        noise = np.minimum(np.searchsorted(cumulative, rng.random(lm_score.NOISE) * cumulative[-1]), k - 1)
        x = q1[c1] + q2[c2]
        gs = m / (1 + np.exp((x * r[w]).sum(1) + b[w] - log_noise[w]))
        gt = -m[:, None] / (1 + np.exp(-(x @ r[noise].T + b[noise] - log_noise[noise])))
        gx = gs[:, None] * r[w] + gt @ r[noise]
        grads = [np.zeros_like(y) for y in (q1, q2, r, b)]
        for y, at, g in ((0, c1, gx), (1, c2, gx), (2, w, gs[:, None] * x), (2, noise, gt.T @ x), (3, w, gs), (3, noise, gt.sum(0))):
            np.add.at(grads[y], at, g / m.sum())
        for y, p, g, rate in zip(state, (q1, q2, r, b), grads, (1, 1, 1, 0.2)):
            y += g * g
            p += rate * lm_score.RATE * g / np.sqrt(y + 1e-8)
    return q1, q2, r, b


def test_a_pass_is_its_definition(monkeypatch):
    """Batches that are full, and a last one that is not."""
    monkeypatch.setattr(lm_score, "BATCH", 64)
    rng = np.random.default_rng(5)
    model = lm_score.LogBilinear(rng.random(30) * 100)
    code = np.unique(rng.integers(0, 30**3, 500))
    weight = rng.integers(1, 9, len(code))
    want = plain(model, code, weight, np.random.default_rng(6))
    model.train(code, weight, [np.zeros_like(x) for x in model.p], np.random.default_rng(6))
    for got, x in zip(model.p, want):
        assert np.allclose(got, x, atol=2e-3)
