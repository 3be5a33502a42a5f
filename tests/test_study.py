"""Measures, models, attribution, sources and the whole study against plain Python on small grids."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermogrid.config import Config, Geometry, match_city, to_utm
from thermogrid.functions import formulas as M
from thermogrid.functions.formulas import column
from thermogrid.models import attribution, features, train
from thermogrid.operators import fusion, measures, scenes, stats, strategy, vulnerability
from thermogrid.plans import workflow
from thermogrid.sources import synthetic
from thermogrid.sources.grid import clean, empty_grid, layer, layer_statistics, sample_table, validate


@pytest.fixture(scope="module")
def city(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("city") / "grid")
    synthetic.synthetic_cells(spark, 20, 24, 3).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def table(city):
    return features.folds(features.feature_table(city), 4, seed=1)


def test_config():
    assert match_city("DELHI ncr") == "delhi" and match_city("nowhere") is None
    c = Config.from_city("Mumbai", budget=5.0)
    assert Config.from_dict(json.loads(json.dumps(c.to_dict())) | {"unknown": 1}) == c and c.changed(seed=4).seed == 4
    assert Config(datasets={"a": False}).uses("b") and not Config(datasets={"a": False}).uses("a")
    own = Config(city="Pune", bbox=(73.7, 18.4, 74.0, 18.7))
    assert own.crs == "EPSG:32643" and own.name == "Pune"
    for bad in ({"city": "nowhere"}, {"mode": "x"}, {"bbox": (1, 1, 1, 2)}, {"start": "2024-09-01"}, {"resolution_m": 0}):
        with pytest.raises(ValueError):
            Config(**bad)
    east, north = to_utm(75.0, 0.0, 43)
    assert abs(east - 500_000) < 1e-6 and abs(north) < 1e-6
    a, b = to_utm(76.0, 28.0, 43), to_utm(76.01, 28.0, 43)
    assert abs(math.hypot(b[0] - a[0], b[1] - a[1]) / (111_320 * math.cos(math.radians(28)) * 0.01) - 1) < 5e-3
    g = Geometry.of(Config(shape=(10, 12)))
    assert (g.rows, g.cols) == (10, 12) and abs(g.bounds[3] - g.bounds[1] - 1000) < 1e-6 and g.transform[4] == -100.0


def test_grid_checks(spark):
    grid = empty_grid(spark, 3, 4).withColumn("a", F.when(F.col("row") == 1, F.lit(float("nan"))).when(F.col("row") == 2, F.lit(float("inf"))).otherwise(F.col("col") * 1.0))
    tidy = clean(grid)
    assert tidy.filter("a IS NULL").count() == 8 and stats.zscore(tidy, "a", "z").filter("isnan(z)").count() == 0
    ok = (3, 4, (1, 0, 0, 0, -1, 0), "EPSG:32643", (0, 0, 4, 3))
    validate(grid, *ok)
    for bad, args in ((grid.limit(5), ok), (grid.union(grid), ok), (grid, (2, *ok[1:])), (grid, (3, 4, (1,), *ok[3:])), (grid, (*ok[:3], "", ok[4])), (grid, (*ok[:4], (1,)))):
        with pytest.raises(ValueError):
            validate(bad, *args)
    assert sample_table(tidy, ["a"]).count() == 4 and sample_table(tidy, ["a"], most=2, seed=1).collect() == sample_table(tidy.repartition(5), ["a"], most=2, seed=1).collect()
    with pytest.raises(KeyError):
        layer(tidy, "b")
    s = {r["layer"]: r for r in layer_statistics(tidy).collect()}
    assert (s["a"]["cells"], s["a"]["known"], s["a"]["high"]) == (12, 4, 3.0)


def test_quantiles_without_sorting_everything(spark):
    rng = np.random.default_rng(0)
    for values in (rng.standard_normal(5000), np.append(rng.random(4000), 1e12), np.repeat([1.0, 2.0, 2.0, 5.0], 1000), np.array([3.0]), np.array([-1e308, 1e308, 0.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        shares = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
        for small in (100_000, 50):
            got = stats.quantiles(df, "v", shares, small=small, buckets=16)
            assert np.allclose(got, np.quantile(values, shares), rtol=1e-12)
    assert stats.quantiles(df.limit(0), "v", [0.5]) == [None]
    assert stats.quantiles(df, "v", [0.5], F.col("v") > 0) == [1e308]


def test_ranks_with_an_outlier(spark):
    values = [0.1 * (k % 37) for k in range(500)] + [1e9, None]
    got = stats.percentile_rank(spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double"), "v", "p").collect()
    known = np.array([v for v in values if v is not None])
    for r in got:
        assert r["p"] is None if r["v"] is None else abs(r["p"] - 100 * (known <= r["v"]).mean()) < 1e-9


def test_odd_weather_and_sigmas(spark):
    one = spark.createDataFrame([(30.0, 50.0, -2.0, 800.0)], "t double, rh double, w double, s double")
    r = one.select(column(M.utci("t", "rh", "w")).alias("u"), column(M.utci("t", "rh", "0.0")).alias("v"), column(M.net_effective_temperature("t", "rh", "w")).alias("n"), column(M.mean_radiant_temperature("t", "s")).alias("m")).first()
    assert r["u"] == r["v"] and r["n"] is not None and not math.isnan(r["n"]) and abs(r["m"] - (30 + 0.7 * 0.8 * 800 / 6)) < 1e-9
    e = spark.createDataFrame([(0, 0, 1.0, 0.0), (0, 0, 3.0, 1.0), (0, 0, 9.0, float("nan")), (0, 1, 1.0, -1.0)], "row int, col int, value double, sigma double")
    got = {r["col"]: r for r in fusion.inverse_variance(e).collect()}
    assert (got[0]["fused"], got[0]["fused_sigma"]) == (3.0, 1.0) and got[1]["fused"] is None


def test_synthetic_city(spark, city):
    again = synthetic.synthetic_cells(spark, 20, 24, 3)
    assert city.exceptAll(again).count() == 0 and city.columns == again.columns
    assert synthetic.synthetic_cells(spark, 20, 24, 4).agg(F.avg("lst")).first()[0] != city.agg(F.avg("lst")).first()[0]
    r = city.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in synthetic.NAMES]).first()
    assert not any(r) and len(synthetic.NAMES) >= 44
    for name, sign in (("ndvi", -1), ("water_frac", -1), ("impervious_frac", 1), ("building_height", 1)):
        assert np.sign(city.agg(F.corr(name, "lst")).first()[0]) == sign
    limits = city.agg(F.max(F.col("green_frac") + F.col("water_frac") + F.col("impervious_frac")), F.min("lst"), F.max("lst"), F.min(F.col("lst_day") - F.col("lst_night"))).first()
    assert limits[0] <= 1 + 1e-9 and 0 < limits[1] < limits[2] < 80 and limits[3] > 0
    with pytest.raises(ValueError):
        synthetic.load(spark, Config(mode="scenes"))


def test_measures(spark, city):
    with pytest.raises(KeyError):
        measures.measure("umbrellas")
    m = measures.MEASURES["cool_roof"]
    assert m.cost_per_m2 == 5.0 and m.plausible(20.0) and not m.plausible(60.0) and measures.MEASURES["urban_trees"].layers.keys() == {"ndvi", "tree_frac", "albedo"}
    after = measures.apply_measure(city, "urban_trees", "impervious_frac > 0.2").select("row", "col", *[F.col(c).alias(f"n_{c}") for c in ("ndvi", "svf", "impervious_frac", "albedo")])
    for r in city.join(after, ["row", "col"]).collect():
        on = r["impervious_frac"] > 0.2
        assert abs(r["n_ndvi"] - min(0.95, r["ndvi"] + 0.2 * on)) < 1e-9 and abs(r["n_svf"] - max(0.05, r["svf"] - 0.1 * on)) < 1e-9
        assert abs(r["n_impervious_frac"] - max(0.0, r["impervious_frac"] - 0.1 * on)) < 1e-9 and r["n_albedo"] <= 0.9
    bare = city.select("row", "col", "lst")
    assert {"ndvi", "tree_frac"} <= set(measures.apply_measure(bare, "urban_park", "TRUE").columns)
    both = measures.apply_plan(city, {"cool_roof": "row < 10", "increase_albedo": "row < 5"}).agg(F.max("albedo")).first()[0]
    assert both <= 0.9
    out = measures.delta_lst(city, measures.linear_model, "cool_roof", "row = 10 AND col = 12").select("row", "col", "delta_lst").toPandas().pivot(index="row", columns="col", values="delta_lst").to_numpy()
    assert out[10, 12] > 0 and 0 < out[10, 13] <= out[10, 12] and out[0, 0] == 0
    cells, summary = measures.scenario(city, measures.linear_model, {"cool_roof": "impervious_frac >= 0.3", "cool_pavement": "impervious_frac >= 0.3"})
    s = {r["measure"]: r["mean_c"] for r in summary.collect()}
    assert max(s["cool_roof"], s["cool_pavement"]) - 1e-9 <= s["all"] <= s["cool_roof"] + s["cool_pavement"] + 1e-9 and cells.count() == 480
    cool = measures.urban_cooling(city, 28.0, 4.0, mixing_m=200.0).agg(F.min("cc"), F.max("cc"), F.min("hm"), F.max("hm"), F.min("t_air"), F.max("t_air")).first()
    assert 0 <= cool[0] <= cool[1] <= 1 and 0 <= cool[2] <= cool[3] <= 1 and 28 <= cool[4] <= cool[5] <= 32


def test_models(spark, table, tmp_path):
    names = features.resolve(table)
    rows = table.toPandas()
    x, y = rows[names].to_numpy(), rows["lst"].to_numpy()
    line = train.fit_linear(table, names)
    want = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
    got = line.predict(table).toPandas().sort_values(["row", "col"])["lst_pred"].to_numpy()
    order = rows.sort_values(["row", "col"]).index
    assert np.abs(got - (want[0] + x @ want[1:])[order]).max() < 1e-4
    boosted = train.fit_boosted(table, names, rounds=80)
    p = boosted.predict(table).toPandas()
    assert 1 - ((p["lst_pred"] - p["lst"]) ** 2).mean() / p["lst"].var(ddof=0) > 0.9
    for j, n in enumerate(names):  # no step against the physics
        steps = np.diff(boosted.values[j]) * features.signs(names)[n]
        assert not features.signs(names)[n] or steps.min(initial=0) > -1e-9
    boosted.save(spark, f"{tmp_path}/model")
    assert train.Additive.load(spark, f"{tmp_path}/model") == boosted
    cv = train.block_cv(table, names, kind="boosted", rounds=80).toPandas()
    assert len(cv) == 5 and cv[cv["fold"].isna()]["r2"].iloc[0] > 0.8
    held = train.held_out_predictions(table, ["ndvi"]).toPandas()
    for f in range(4):
        rest = held[held["fold"] != f]
        slope, base = np.polyfit(rest["ndvi"], rest["lst"], 1)
        part = held[held["fold"] == f]
        assert np.abs(part["y_pred"] - (slope * part["ndvi"] + base)).max() < 1e-6
    blocks = table.groupBy("block").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count()
    share = features.spatial_split(table).agg(F.avg(F.col("is_test").cast("int"))).first()[0]
    assert blocks == 0 and 0.1 < share < 0.45


def test_attribution(table, city):
    names = ["ndvi", "albedo", "impervious_frac", "water_frac"]
    model = train.fit_linear(table, names)
    rows = table.toPandas()
    x, y, w = rows[names].to_numpy(), rows["lst"].to_numpy(), np.array(model.slopes)
    shuffled = {r["feature"]: r["importance"] for r in attribution.permutation_importance(table, model).collect()}
    base = ((y - model.base - x @ w) ** 2).mean()
    for j, n in enumerate(names):  # all pairs of rows are all shufflings on average
        moved = (y - model.base - x @ w)[:, None] + w[j] * (x[:, j][:, None] - x[:, j][None, :])
        assert abs(shuffled[n] - max(0.0, (moved**2).mean() - base)) < 1e-6 * max(1, shuffled[n])
    shap = attribution.shapley_importance(table, model)
    got = {r["feature"]: r for r in shap.collect()}
    for j, n in enumerate(names):
        assert abs(got[n]["importance"] - np.abs(w[j] * (x[:, j] - x[:, j].mean())).mean()) < 1e-9
    fam = {r["family"]: r["pct"] for r in attribution.by_family(shap).collect()}
    assert abs(sum(fam.values()) - 100) < 1e-9 and set(fam) == set(features.FAMILIES)
    parts = attribution.variance_partition(table, names).collect()
    z = np.column_stack([np.ones(len(x)), x])
    r2 = 1 - ((y - z @ np.linalg.lstsq(z, y, rcond=None)[0]) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert abs(sum(r["importance"] for r in parts) - r2) < 1e-6
    ale = attribution.accumulated_effects(table, model, 8, ["ndvi"]).toPandas()
    assert abs((ale["effect"].iloc[-1] - ale["effect"].iloc[0]) - w[0] * (x[:, 0].max() - x[:, 0].min())) < 1e-9
    assert abs(attribution.partial_dependence(table, model, 5, ["ndvi"]).agg(F.sum("effect")).first()[0]) < 1e-9
    assert attribution.sign_audit(shap).count() == 4
    told, per = attribution.agreement(shap, shap, 2)
    assert told["jaccard"] == 1.0 and abs(told["spearman"] - 1) < 1e-9 and per.filter("agree").count() == 2
    local = attribution.local_slopes(city, names[:2], n=4, bandwidth=1e9).select(F.round("slope_ndvi", 8), F.round("local_r2", 8)).distinct().count()
    assert local == 1  # with an endless bandwidth all blocks are alike
    flat = city.select("row", "col", (F.col("row") * 1.0).alias("e"))
    assert attribution.residual_moran(flat, "e").first()["moran_i"] > 0.8


def test_layered_priority(city):
    out = vulnerability.layered_hotspots(city.select("row", "col", "lst", "air_temp", "rel_humidity", "dewpoint", "impervious_frac", "ndvi", "population"))
    for r in out.collect():
        want = 0.5 * max(r["surface_score"], r["human_stress_score"]) + 50 * r["hvi"]
        assert abs(r["priority_score"] - min(100, max(0, want))) < 1e-9
        assert r["priority_class"] == min(4, int(r["priority_score"] // 20))


def test_front_is_not_dominated():
    rng = np.random.default_rng(1)
    f, c = rng.random(60), rng.random(60)
    got = strategy.pareto(f, c)
    for i in range(60):
        better = ((f >= f[i]) & (c <= c[i]) & ((f > f[i]) | (c < c[i]))).any()
        assert got[i] == (not better)


@pytest.mark.parametrize("method", strategy.METHODS)
def test_strategies(city, method):
    config = Config(budget=3e5, area_cap_frac=0.2, seed=2)
    out = strategy.strategy(city.select("row", "col", "lst", "population", "ndvi", "albedo", "impervious_frac", "water_frac", "building_height"), measures.linear_model, config, method, names=["cool_roof", "urban_trees"])
    rows, t = out["placements"].collect(), out["totals"]
    assert 0 < len(rows) == t["sites"] and t["cost"] <= 3e5 and t["area_m2"] <= t["area_cap_m2"] and len({(r["row"], r["col"]) for r in rows}) == len(rows)
    assert out["cells"].count() == 480 and t["max_c"] > 0 and t["mean_c"] > 0
    if method == "nsga2":
        costs, cooling = [x["cost"] for x in out["front"]], [x["objective"] for x in out["front"]]
        assert costs == sorted(costs) and cooling == sorted(cooling)
    with pytest.raises(ValueError):
        strategy.strategy(city, measures.linear_model, config, "guess")


def test_scenes(spark):
    s = spark.createDataFrame([("a", 0, 0, 45000, 0), ("a", 0, 1, 45000, 8), ("b", 0, 0, 45000, None)], "scene_id string, row int, col int, st_b10 int, qa int")
    got = [r["lst"] for r in scenes.surface_temperature(s, "landsat").orderBy("scene_id", "col").collect()]
    assert abs(got[0] - (45000 * 0.00341802 + 149 - 273.15)) < 1e-9 and got[1:] == [None, None]
    with pytest.raises(KeyError):
        scenes.surface_temperature(s, "camera")
    clouds = spark.createDataFrame([("a", 0, 0, 20.0), ("a", 0, 0, 90.0), ("a", 0, 1, 10.0)], "scene_id string, row int, col int, probability double")
    kept = {(r["scene_id"], r["col"]): r["st_b10"] for r in scenes.without_clouds(s, clouds, ["st_b10"]).collect()}
    assert kept == {("a", 0): None, ("a", 1): 45000}
    mc = scenes.monte_carlo(spark.createDataFrame([(0, 0, 1.0)], "row int, col int, a double"), "a * 2.0D", {"a": 0.5}, 4000).first()
    assert abs(mc["mean"] - 2) < 0.06 and abs(mc["spread"] - 1) < 0.05


def test_study_and_command_line(spark, tmp_path, capsys):
    out = tmp_path / "out"
    code = workflow.main(["--city", "mumbai", "--shape", "20", "20", "--budget", "500000", "--seed", "3", "--out", str(out)], spark)
    said = capsys.readouterr().out
    assert code == 0 and said.startswith("# Heat study: Greater Mumbai") and "## Measures" in said
    for name in ("grid", "hotspots", "cv", "importance", "families", "signs", "placements", "delivered", "predicted"):
        assert spark.read.parquet(f"{out}/{name}").count() > 0
    summary = json.loads(spark.read.text(f"{out}/summary.json").first()[0])
    assert summary["errors"] == {} and summary["robustness"]["active"] >= 19
    assert workflow.main(["--city", "nowhere"], spark) == 2
    broken = workflow.run(spark, Config(shape=(6, 6), optimizer="guess"), None, "linear", ("grid", "portfolio"))
    assert list(broken["errors"]) == ["portfolio"] and "Steps that failed" in broken["report"]
