"""The K-Means sweep and the projection against plain numpy versions."""

import hashlib
import math

import numpy as np
import pytest

from sievekit.operators import cluster as CL


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "design_idx long, features array<double>")


def plain_fit(x, k, restart):
    """One model from the hashed draws, every point against every centre in each round."""
    def draw(step, i):
        turn, place = divmod(step, CL.HASH_STEPS)
        digits = hashlib.md5(f"{CL.SEED + restart}:{turn}:{i}".encode()).hexdigest()[place:place + 13]
        return -math.log((int(digits, 16) + 1) / 2 ** 52)

    chosen = []
    for step in range(k):
        near = np.ones(len(x)) if not chosen else np.min([np.round(((x - x[c]) ** 2).sum(1), CL.PLACES) for c in chosen], 0)
        chosen.append(min((draw(step, i) / d if d > 0 else math.inf, i) for i, d in enumerate(near))[1])
    centres, label = x[chosen], None
    while True:
        new = np.round(((x[:, None] - centres[None]) ** 2).sum(2), CL.PLACES).argmin(1)
        if label is not None and (new == label).all():
            return centres, label, float(((x - centres[label]) ** 2).sum())
        label = new
        centres = np.array([x[label == j].mean(0) if (label == j).any() else centres[j] for j in range(k)])


def plain_silhouette(x, label):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    out = []
    for i, own in enumerate(label):
        mine = (label == own) & (np.arange(len(x)) != i)
        others = [d[i, label == c].mean() for c in set(label.tolist()) - {own}]
        if not mine.any() or not others:
            out.append(0.0)
            continue
        a, b = d[i, mine].mean(), min(others)
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out)) if len(set(label.tolist())) > 1 else 0.0


def points(kind, n=90):
    rng = np.random.RandomState(4)
    if kind == "blobs":
        return rng.randn(n, 5) + 6 * rng.randint(0, 4, n)[:, None]
    if kind == "grid":  # many equal distances
        return np.array([[i % 6, i // 6] for i in range(n)], float)
    return rng.randint(0, 2, (n, 2)).astype(float)  # four distinct points: clusters run empty


@pytest.mark.parametrize("kind", ["blobs", "grid", "few"])
def test_sweep_equals_plain_version(spark, monkeypatch, kind):
    monkeypatch.setattr(CL, "BLOCK_POINTS", 17)
    x = points(kind)
    lo, hi = CL.k_range(len(x))
    labels, k, score, sweep = CL.cluster(table(spark, x).repartition(3), n_init=3, k_step=2)
    want = {}
    for kk in range(lo, hi + 1, 2):
        _, label, cost = min((plain_fit(x, kk, r) for r in range(3)), key=lambda m: round(m[2], CL.PLACES))
        want[kk] = (plain_silhouette(x, label), cost, label)
    got = {r.k: (r.silhouette, r.cost) for r in sweep.collect()}
    assert set(got) == set(want)
    assert all(np.allclose(got[c], want[c][:2], atol=1e-6) for c in want)
    assert k == min(want, key=lambda c: (-round(want[c][0], 9), c)) and abs(score - want[k][0]) < 1e-6
    assert [r.cluster for r in labels.orderBy("design_idx").collect()] == want[k][2].tolist()


def test_few_points_have_no_sweep(spark):
    labels, k, score, sweep = CL.cluster(table(spark, points("blobs", 20)), n_init=2)
    assert (k, score, sweep.count(), labels.count()) == (3, -1.0, 0, 20)
    with pytest.raises(ValueError):
        CL.cluster(table(spark, points("blobs", 2)))


def test_jacobi_and_projection(spark):
    rng = np.random.RandomState(1)
    x = rng.randn(80, 6) @ rng.randn(6, 6)
    values, axes = CL.jacobi(np.cov(x.T, bias=True))
    assert np.allclose(axes.T @ axes, np.eye(6)) and np.allclose(np.cov(x.T, bias=True) @ axes, axes * values)
    coords, ratio = CL.pca_points(table(spark, x))
    got = np.array([(r.pc1, r.pc2) for r in coords.orderBy("design_idx").collect()])
    assert np.allclose(got, (x - x.mean(0)) @ (axes[:, :2] * np.sign(axes[np.abs(axes[:, :2]).argmax(0), [0, 1]])))
    assert np.allclose(ratio, values[:2] / values.sum())
    flat, ratio = CL.pca_points(table(spark, np.ones((4, 3))))
    assert [(r.pc1, r.pc2) for r in flat.collect()] == [(0.0, 0.0)] * 4 and ratio == [0.0, 0.0]
