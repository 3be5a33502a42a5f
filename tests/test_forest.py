"""Trees with interactions and their attribution, against plain Python."""

from itertools import permutations

import numpy as np
import pytest

from thermogrid.models import attribution, forest, train


def rows(spark, n=1500, seed=1, noise=0.1):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 6))
    y = 30 + 6 * (x[:, 0] > 0.5) * (x[:, 1] > 0.5) - 3 * x[:, 2] + noise * rng.normal(size=n)
    names = ["impervious_frac", "nightlights", "ndvi", "lulc", "elev2", "odd"]
    data = [(*map(float, r), float(v), int(k % 4)) for k, (r, v) in enumerate(zip(x, y, strict=True))] + [(None, *[0.5] * 5, 30.0, 0), (*[0.5] * 6, None, 1)]
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in names) + ", lst double, fold int")
    return df, names, x, y


def test_depth_one_equals_the_boosted_stumps(spark):
    df, names, x, _ = rows(spark)
    for monotone in (True, False):
        a = train.fit_boosted(df, names, rounds=12, rate=0.2, monotone=monotone)
        b = forest.fit_forest(df, names, rounds=12, depth=1, rate=0.2, monotone=monotone)
        assert np.allclose(a.array(x), b.array(x), atol=1e-9)


def test_trees_beat_sums_of_single_terms_on_an_interaction(spark):
    df, names, *_ = rows(spark)
    tree = forest.forest_cv(df, names, rounds=20, depth=3, rate=0.3, monotone=False).collect()
    plain = train.block_cv(df, names, kind="boosted", monotone=False).filter("fold IS NULL").first()
    mean = next(r for r in tree if r["fold"] is None)
    assert len(tree) == 5 and mean["rmse"] < 0.5 * plain["rmse"] and mean["r2"] > 0.95


def test_folds_grow_as_if_alone_and_monotone_trees_keep_signs(spark):
    df, names, x, _ = rows(spark, 600)
    options = {"rounds": 10, "depth": 2, "rate": 0.3, "bins": 8}
    edges_by_whole = forest.fit_forests(df, names, fold="fold", **options)
    assert set(edges_by_whole) == {None, 0, 1, 2, 3}
    whole = forest.fit_forest(df, names, **options)
    assert np.allclose(whole.array(x), edges_by_whole[None].array(x))
    again = forest.fit_forest(df.repartition(7), names, **options)
    assert np.allclose(whole.array(x), again.array(x))
    up, down = x.copy(), x.copy()
    up[:, 0] += 0.2  # sealed ground may only warm
    down[:, 2] += 0.2  # plants may only cool
    assert (whole.array(up) >= whole.array(x) - 1e-9).all() and (whole.array(down) <= whole.array(x) + 1e-9).all()


def test_expression_equals_arrays_and_models_are_kept(spark, tmp_path):
    df, names, *_ = rows(spark, 200)
    m = forest.fit_forest(df, names, rounds=5, depth=3)
    got = m.predict(df).collect()
    assert got[-2]["lst_pred"] is None
    assert np.allclose([r["lst_pred"] for r in got[:200]], m.array(np.array([[r[c] for c in names] for r in got[:200]])))
    m.save(spark, str(tmp_path / "m"))
    assert forest.Forest.load(spark, str(tmp_path / "m")) == m
    none = forest.fit_forest(df.limit(0), names, rounds=3)
    assert none.trees == [] and none.base == 0.0


def _expected(model, bins, known):
    """The mean prediction of one row, unknown predictors going both ways by shares of rows."""

    def node(t, level, at):
        if level == t.depth:
            return t.values[at]
        i = (1 << level) - 1 + at
        f = t.feature[i]
        if f < 0:
            return node(t, level + 1, 2 * at)
        if f in known:
            return node(t, level + 1, 2 * at + (bins[f] > t.bin[i]))
        return sum(t.rows[2 * i + 1 + s] / t.rows[i] * node(t, level + 1, 2 * at + s) for s in (0, 1))

    return model.base + sum(node(t, 0, 0) for t in model.trees)


def test_shapley_values_equal_all_coalitions(spark):
    df, names, *_ = rows(spark, 400)
    m = forest.fit_forest(df, names, rounds=6, depth=3, rate=0.5, monotone=False, bins=6)
    sample = df.limit(5)
    got = forest.shapley_values(sample, m).collect()
    for r in got:
        bins = m.bins(np.array([[r[c] for c in names]]))[0]
        want = np.zeros(6)
        orders = list(permutations(range(6)))
        cache = {}
        for order in orders:
            known: frozenset = frozenset()
            for f in order:
                for s in (known, known | {f}):
                    if s not in cache:
                        cache[s] = _expected(m, bins, s)
                want[f] += (cache[known | {f}] - cache[known]) / len(orders)
                known = known | {f}
        assert np.allclose([r[f"shap_{c}"] for c in names], want, atol=1e-9)
        assert _expected(m, bins, frozenset()) + want.sum() == pytest.approx(m.array(np.array([[r[c] for c in names]]))[0])
    assert forest.shapley_importance(df, m).orderBy("rank").first()["feature"] in ("impervious_frac", "nightlights")


def test_shuffling_and_effects_by_prediction_equal_the_closed_forms_of_additive_models(spark):
    df, names, *_ = rows(spark, 900)
    m = train.fit_boosted(df, names, rounds=30)
    a = {r["feature"]: r["importance"] for r in attribution.permutation_importance(df, m).collect()}
    b = {r["feature"]: r["importance"] for r in forest.permutation_by_prediction(df, m, repeats=20).collect()}
    assert all(abs(a[c] - b[c]) < 0.05 * max(a.values()) + 0.01 for c in names)
    x = {(r["feature"], r["k"]): (r["x"], r["effect"]) for r in attribution.accumulated_effects(df, m, bins=8).collect()}
    y = {(r["feature"], r["k"]): (r["x"], r["effect"]) for r in forest.effects_by_prediction(df, m, bins=8).collect()}
    assert x.keys() == y.keys() and all(x[k] == pytest.approx(y[k], abs=0.02) for k in x)
