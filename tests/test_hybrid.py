"""Hybrid models and the network trained against the energy balance."""

import numpy as np
import pytest

from thermogrid.models import hybrid

NAMES = ["ndvi", "albedo", "impervious_frac"]


def table(spark, n=400, seed=2):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.uniform(0, 0.8, n), rng.uniform(0.1, 0.3, n), rng.uniform(0, 1, n)])
    y = 20 + 30 * (1 - x[:, 1]) + 5 * x[:, 2] ** 2 - 4 * x[:, 0] + 0.1 * rng.normal(size=n)
    data = [(*map(float, r), float(v), k % 4) for k, (r, v) in enumerate(zip(x, y, strict=True))] + [(None, 0.2, 0.5, 30.0, 0), (0.2, 0.2, 0.5, None, 1)]
    return spark.createDataFrame(data, "ndvi double, albedo double, impervious_frac double, lst double, fold int"), x, y


BASE = lambda layer: f"(20.0D + 30.0D * (1.0D - {layer('albedo')}))"


@pytest.mark.parametrize("kind", ["linear", "boosted", "forest"])
def test_hybrid_learns_the_rest_and_falls_back_outside_its_range(spark, kind):
    df, x, y = table(spark)
    options = {"rounds": 12, "depth": 2, "rate": 0.4} if kind == "forest" else {}
    m = hybrid.fit_hybrid(df, NAMES, baseline=BASE, kind=kind, **options)
    got = np.array([r["lst_pred"] for r in m.predict(df).collect()[:400]])
    base = 20 + 30 * (1 - x[:, 1])
    assert np.allclose(got, base + m.learner.array(x), atol=1e-6)  # nothing fades inside
    assert np.sqrt(np.mean((got - y) ** 2)) < 0.5 * np.sqrt(np.mean((base - y) ** 2))
    far = spark.createDataFrame([(50.0, 0.2, 40.0), (0.4, 0.2, 1.5), (0.4, 0.2, 1.0)], "ndvi double, albedo double, impervious_frac double")
    a, b, c = (r["lst_pred"] for r in m.predict(far).collect())
    assert a == pytest.approx(44.0, abs=1e-3)  # far outside only the physics is left
    assert abs(b - 44.0) <= abs(float(m.learner.array(np.array([[0.4, 0.2, 1.5]]))[0])) * 0.75 and c != pytest.approx(44.0, abs=0.1)
    panel = hybrid.hybrid_cv(df, NAMES, baseline=BASE, kind=kind, **options).collect()
    assert len(panel) == 5 and next(r for r in panel if r["fold"] is None)["rmse"] < 0.5 * np.sqrt(np.mean((base - y) ** 2))


def test_hybrid_cv_leaves_out_the_fold(spark):
    df, x, y = table(spark)
    got = {r["fold"]: r["rmse"] for r in hybrid.hybrid_cv(df, NAMES, baseline=BASE, kind="linear").collect()}
    fold, base = np.arange(400) % 4, 20 + 30 * (1 - x[:, 1])
    for f in range(4):
        inside = fold != f
        design = lambda m: np.column_stack([np.ones(m.sum()), x[m]])
        w = np.linalg.lstsq(design(inside), (y - base)[inside], rcond=None)[0]
        lo, hi = x[inside].min(0), x[inside].max(0)
        beyond = (np.maximum(np.maximum(lo - x[~inside], x[~inside] - hi), 0) / (hi - lo)).sum(1)
        error = base[~inside] + np.exp(-beyond) * (design(~inside) @ w) - y[~inside]
        assert got[f] == pytest.approx(np.sqrt(np.mean(error**2)), rel=1e-6)


def test_physics_baseline_takes_what_the_grid_has(spark):
    df, *_ = table(spark, 50)
    m = hybrid.fit_hybrid(df, NAMES, kind="linear")
    assert m.predict(df).filter("lst_pred IS NOT NULL").count() == 51
    with pytest.raises(ValueError, match="unknown learner"):
        hybrid.fit_hybrid(df, NAMES, kind="magic")


def test_gradient_equals_differences():
    rng = np.random.default_rng(5)
    net = hybrid.HeatNet(NAMES, np.zeros(3), np.ones(3), 35.0, 4.0, rng.normal(size=3 * 5 + 11), 5)
    x, y = rng.normal(size=(30, 3)), 35 + rng.normal(size=30)
    drivers = np.column_stack([np.full(30, 0.2), np.full(30, 700.0), np.full(30, 380.0), np.full(30, 0.95), np.full(30, 28.0), np.where(np.arange(30) % 2, np.nan, 150.0)])
    want = np.array([-1.0, -1.0, 1.0])
    value = lambda w: (hybrid.loss_and_gradient(net, w, x, y, drivers, want, 0.3, 2.0)[0][:3] * [1, 0.3, 2.0]).sum()
    gradient = hybrid.loss_and_gradient(net, net.weights, x, y, drivers, want, 0.3, 2.0)[1]
    for i in range(len(net.weights)):
        step = np.zeros(len(net.weights))
        step[i] = 1e-6
        assert gradient[i] == pytest.approx((value(net.weights + step) - value(net.weights - step)) / 2e-6, rel=1e-4, abs=1e-4)


def test_network_learns_keeps_signs_and_does_not_depend_on_partitions(spark):
    df, x, _ = table(spark)
    one, eight = (hybrid.fit_network(df.repartition(n), NAMES, hidden=5, epochs=8, batches=3, seb=1e-4) for n in (1, 8))
    assert np.allclose(one.weights, eight.weights, rtol=1e-6, atol=1e-9)
    losses = [h[1] for h in one.history]
    assert len(losses) == 24 and np.mean(losses[-3:]) < 0.4 * np.mean(losses[:3])
    got = np.array([r["lst_pred"] for r in one.predict(df).collect()[:400]])
    assert np.allclose(got, one.array(x))
    for j, sign in enumerate((-1, -1, 1)):
        moved = x.copy()
        moved[:, j] += 0.01
        assert np.mean((one.array(moved) - got) * sign > -1e-4) > 0.9
    assert hybrid.fit_network(df.limit(0), NAMES).history == []
