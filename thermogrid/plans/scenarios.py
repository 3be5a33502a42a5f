"""Queries on measures, models and attribution, each with SQL written on its own where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.formulas import column
from ..models import attribution, features, train
from ..operators import measures, stats
from ..sources.cells import cells, cells_sql
from ..sources.grid import layer_statistics, sample_table
from ..sources.synthetic import NAMES, synthetic_cells, synthetic_sql

_CELLS = f"cells AS ({cells_sql()})"
_SIDE, _SEED = 48, 7
_P = ["ndvi", "albedo", "impervious_frac"]


def _round(df: DataFrame, keep: list[str], *values: str, digits: int = 5) -> DataFrame:
    return df.select(*keep, *[F.round(v, digits).alias(v) for v in values])


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("row", "col", "lst", "ndvi", "albedo", "impervious_frac", "green_frac", "tree_frac", "water_frac", "svf", "soil_moisture", "emissivity", "solar_radiation", "building_height", "air_temp", "population", "lcz")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures with the cells of the grid where each is possible, and its cost on all of them."""
    return measures.catalogue(spark).join(F.broadcast(measures.reach(_grid(spark, sf_dir))), "measure")  # one row for each measure


def _feasible(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return measures.possible(_grid(spark, sf_dir), name).select("row", "col", F.col("possible").cast("int").alias("possible"))

    return run


def _applied(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        grid = _grid(spark, sf_dir)
        mask = None if name != "urban_park" else "impervious_frac <= 0.5 AND water_frac < 0.5 AND ndvi <= 0.7"
        return _round(measures.apply_measure(grid, name, mask), ["row", "col"], "ndvi", "albedo", "impervious_frac", "green_frac", "tree_frac", "water_frac", "svf", "soil_moisture")

    return run


_ANY = {n: "TRUE" for n in measures.MEASURES}


def _delta(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        grid = _grid(spark, sf_dir)
        after = measures.changed(name, "TRUE", grid.columns)
        both = measures.combined_delta(measures.linear_model, after, grid.columns)
        texts = {"surface": measures.surface_delta(measures.linear_model, after), "physics": measures.physics_delta(after, grid.columns), "combined": both[0], "sigma": both[1]}
        return _round(grid.select("row", "col", *[column(v).cast("double").alias(k) for k, v in texts.items()]), ["row", "col"], *texts)

    return run


def delta_lst_cool_roof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(measures.delta_lst(_grid(spark, sf_dir), measures.linear_model, "cool_roof"), ["row", "col"], "delta_lst")


def scenario_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = {"cool_roof": "impervious_frac >= 0.6", "urban_trees": "impervious_frac <= 0.3"}
    return _round(measures.scenario(_grid(spark, sf_dir), measures.linear_model, plan)[1], ["measure"], "mean_c", "hottest_c")


def urban_cooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = measures.urban_cooling(_grid(spark, sf_dir), 28.0, 4.0, mixing_m=150.0)
    return _round(out, ["row", "col"], "cc", "hm", "park_cc", "t_air_nomix", "t_air", "delta_t_air")


def synthetic_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(layer_statistics(synthetic_cells(spark, _SIDE, _SIDE, _SEED)), ["layer", "cells", "known"], "mean", "low", "high", digits=4)


def synthetic_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = synthetic_cells(spark, _SIDE, _SIDE, _SEED)
    names = ("ndvi", "impervious_frac", "water_frac", "tree_frac", "svf", "anthro_heat")
    return grid.select(F.explode(F.array(*[F.struct(F.lit(n).alias("layer"), F.col(n).alias("v"), F.col("lst")) for n in names])).alias("o")).groupBy("o.layer").agg(F.signum(F.corr("o.v", "o.lst")).cast("int").alias("sign"))


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(sample_table(_grid(spark, sf_dir), ["lst", "ndvi"], most=500, seed=3), ["row", "col"], "lst", "ndvi")


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(features.feature_table(_grid(spark, sf_dir), _P, drop_gaps=False, impute="median", standardise=True), ["row", "col"], *_P)


def feature_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.folds(_grid(spark, sf_dir).select("row", "col"), 5, seed=2).select("row", "col", "block", "fold")


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.folds(features.feature_table(_grid(spark, sf_dir), _P), 5, seed=2)


def linear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = train.fit_linear(features.feature_table(_grid(spark, sf_dir), ["ndvi"]), ["ndvi"])
    return spark.createDataFrame([(round(m.base, 5), round(m.slopes[0], 5))], "base double, slope double")


_CV = ("rmse", "mae", "bias", "ubrmse", "r2", "nse", "ccc", "kge")


def linear_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = features.folds(features.feature_table(_grid(spark, sf_dir), ["ndvi"]), 5, seed=2)
    return _round(train.block_cv(table, ["ndvi"]), ["fold", "n"], "rmse", "mae", "bias")


def boosted_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(train.block_cv(_folded(spark, sf_dir), _P, kind="boosted", rounds=60), ["fold", "n"], *_CV)


def _linear(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, train.Additive]:
    table = features.feature_table(_grid(spark, sf_dir), _P)
    return table, train.Additive(_P, 35.0, [-8.0, -10.0, 12.0])


def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, model = _linear(spark, sf_dir)
    near = table.withColumn("lst", column("35.0 - 8.0 * ndvi - 10.0 * albedo + 12.0 * impervious_frac + 0.1 * lst"))  # what the model knows, and some noise
    return _round(attribution.permutation_importance(near, model), ["feature", "rank"], "importance", "pct")


def shapley_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(attribution.shapley_importance(*_linear(spark, sf_dir)), ["feature", "rank"], "importance", "pct", "mean_signed")


def family_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(attribution.by_family(attribution.shapley_importance(*_linear(spark, sf_dir))), ["family"], "importance", "pct")


def sign_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.sign_audit(attribution.shapley_importance(*_linear(spark, sf_dir)))


def accumulated_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, model = _linear(spark, sf_dir)
    return _round(attribution.accumulated_effects(table, model, 10), ["feature", "k"], "x", "effect")


def variance_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = features.feature_table(_grid(spark, sf_dir), ["ndvi", "albedo"])
    return _round(attribution.variance_partition(table, ["ndvi", "albedo"]), ["feature"], "importance", digits=7)


def local_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = attribution.local_slopes(_grid(spark, sf_dir), _P, n=8)
    return _round(out, ["row", "col", "dominant"], *[f"slope_{p}" for p in _P], "local_r2")


def residual_moran(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _grid(spark, sf_dir).withColumn("residual", column("lst - (35.0 - 8.0 * ndvi - 10.0 * albedo + 12.0 * impervious_frac)"))
    return _round(attribution.residual_moran(grid, "residual"), ["n"], "moran_i")


def attribution_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, model = _linear(spark, sf_dir)
    return attribution.agreement(attribution.permutation_importance(table, model), attribution.shapley_importance(table, model), 2)[1]


QUERIES = {
    f.__name__: f
    for f in (
        catalogue, delta_lst_cool_roof, scenario_summary, urban_cooling, synthetic_layers, synthetic_signs, sample, feature_rows, feature_folds, linear_fit, linear_cv, boosted_cv, permutation_importance,
        shapley_importance, family_shares, sign_audit, accumulated_effects, variance_shares, local_slopes, residual_moran, attribution_agreement,
    )
} | {f"feasibility_{n}": _feasible(n) for n in measures.MEASURES} | {f"apply_{n}": _applied(n) for n in measures.MEASURES} | {f"delta_{n}": _delta(n) for n in measures.MEASURES}

# --- SQL, written apart from the expressions above -----------------------------------------------------------------

_ON = {  # where each measure can stand; a gap says no
    "urban_trees": "impervious_frac <= 0.7 AND ndvi <= 0.55 AND water_frac < 0.5", "green_roof": "impervious_frac >= 0.3", "cool_roof": "impervious_frac >= 0.3", "cool_pavement": "impervious_frac >= 0.55 AND ndvi <= 0.55",
    "permeable_pavement": "impervious_frac >= 0.55 AND ndvi <= 0.55", "water_body": "impervious_frac <= 0.4 AND water_frac < 0.5", "green_wall": "building_height >= 6", "increase_albedo": "true",
}
_VACANT = "impervious_frac <= 0.5 AND water_frac < 0.5 AND ndvi <= 0.7"


def _box(x: str, lo: float, hi: float) -> str:
    return f"greatest(least({x}, {hi}e0), {lo}e0)"


#: By measure, what is added to ndvi, albedo, sealed, green, tree, water, sky view, soil moisture.
_ADD = {
    "urban_trees": (0.2, 0.02, -0.1, 0, 0.2, 0, -0.1, 0), "green_roof": (0.15, 0.05, -0.05, 0.1, 0, 0, -0.05, 0), "cool_roof": (0, 0.3, 0, 0, 0, 0, 0, 0), "cool_pavement": (0, 0.25, 0, 0, 0, 0, 0, 0),
    "permeable_pavement": (0, 0.05, 0, 0, 0, 0, 0, 0.1), "water_body": (0, 0, -0.25, 0, 0, 0.5, 0, 0.2), "urban_park": (0.3, 0, -0.2, 0.4, 0.2, 0, -0.2, 0), "green_wall": (0.1, 0.03, 0, 0, 0, 0, 0, 0), "increase_albedo": (0, 0.2, 0, 0, 0, 0, 0, 0),
}
_RANGE = {"ndvi": (-1, 0.95), "albedo": (0.05, 0.9), "impervious_frac": (0, 1), "green_frac": (0, 1), "tree_frac": (0, 1), "water_frac": (0, 1), "svf": (0.05, 1), "soil_moisture": (0, 0.6)}


def _after(name: str, on: str) -> dict[str, str]:
    out = {}
    for (layer, (lo, hi)), d in zip(_RANGE.items(), _ADD[name], strict=True):
        out[layer] = _box(f"{layer} + CASE WHEN {on} THEN {d}e0 ELSE 0 END", lo, hi) if d else layer
    return out


def _apply_sql(name: str) -> str:
    on = _ON.get(name, _VACANT)
    cols = ", ".join(f"round(CAST({v} AS DOUBLE), 5) AS {k}" for k, v in _after(name, on).items())
    return f"WITH {_CELLS} SELECT row, col, {cols} FROM cells"


def _cut(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} < -0.5 THEN 0 ELSE least({x}, 50e0) END"


def _delta_sql(name: str) -> str:
    a = _after(name, "true")
    add = dict(zip(_RANGE, _ADD[name], strict=True))
    plants = " + ".join(f"({a[k]} - {k})" for k in ("green_frac", "tree_frac") if add[k]) or "0e0"
    wet = f"({a['soil_moisture']} - soil_moisture)" if add["soil_moisture"] else "0e0"
    return f"""WITH {_CELLS}, d AS (SELECT row, col, (35 - 8 * ndvi - 10 * albedo + 12 * impervious_frac) - (35 - 8 * ({a['ndvi']}) - 10 * ({a['albedo']}) + 12 * ({a['impervious_frac']})) AS m,
        ((({a['albedo']}) - albedo) * solar_radiation + greatest({plants}, 0) * 0.25 * solar_radiation + greatest({wet}, 0) * 0.5 * solar_radiation) / (4 * emissivity * 5.670374419e-8 * CASE WHEN lst IS NOT NULL THEN power(greatest(least(lst + 273.15e0, 360), 200), 3) END) AS p FROM cells),
        c AS (SELECT row, col, {_cut('m')} AS m, {_cut('p')} AS p FROM d)
        SELECT row, col, round(CAST(m AS DOUBLE), 5) AS surface, round(CAST(p AS DOUBLE), 5) AS physics, round(CAST({_cut('(0.6e0 * m + 0.4e0 * p)')} AS DOUBLE), 5) AS combined, round(CAST(abs(m - p) AS DOUBLE), 5) AS sigma FROM c"""


# resolution and reach are both 100 m: a kernel of half-width 3 with weights exp(-r); above 0.05 lie distances below 2.9957
_KERNEL = "k AS (SELECT i AS dr, j AS dc, exp(-sqrt(i * i + j * j)) AS w FROM range(-3, 4) a(i), range(-3, 4) b(j)), kw AS (SELECT dr, dc, w / (SELECT sum(w) FROM k) AS w, w > 0.05 AS near FROM k)"
_LIN = "(35 - 8 * ndvi - 10 * albedo + 12 * impervious_frac)"


def _spread_sql(raw: str) -> str:
    return f"""s AS (SELECT row, col, CAST({raw} AS DOUBLE) AS v FROM g),
        n AS (SELECT s.row + dr AS row, s.col + dc AS col, sum(v * w) AS mean, max(CASE WHEN near THEN v END) AS top FROM s CROSS JOIN kw GROUP BY ALL),
        z AS (SELECT g.*, greatest(s.v, 0.5e0 * (greatest(coalesce(top, 0), 0) + coalesce(mean, 0))) AS delta_lst FROM g JOIN s USING (row, col) LEFT JOIN n USING (row, col))"""


_ROOF = _cut("10e0 * (greatest(least(albedo + 0.3e0, 0.9e0), 0.05e0) - albedo)")
_TREE = _cut(f"{_LIN} - (35 - 8 * {_box('ndvi + 0.2e0', -1, 0.95)} - 10 * {_box('albedo + 0.02e0', 0.05, 0.9)} + 12 * {_box('impervious_frac - 0.1e0', 0, 1)})")


def _share_sql(name: str, on: str, raw: str) -> str:
    return f"(WITH g AS (SELECT * FROM cells), {_KERNEL}, {_spread_sql(f'CASE WHEN {on} THEN {raw} ELSE 0 END')} SELECT '{name}' AS measure, round(avg(delta_lst), 5) AS mean_c, round(avg(delta_lst) FILTER (lst >= (SELECT quantile_cont(lst, 0.9) FROM cells)), 5) AS hottest_c FROM z)"


_VEG = "least(greatest(tree_frac, green_frac), 1e0)"
_BARE = f"greatest(1 - {_VEG} - water_frac - impervious_frac, 0)"
_REACH = int(4 * 1.5 + 0.5)


def _scramble_sql(r: str, c: str, seed: int) -> str:
    a = f"((CAST({r} AS BIGINT) * 7349 + CAST({c} AS BIGINT) * 9151 + {seed * 1237 + 17}) % 65521)"
    b = f"(({a} * {a} + 31 * CAST({r} AS BIGINT) + 7) % 65521)"
    return f"(({b} * ({b} + 13) + 17 * CAST({c} AS BIGINT)) % 65521)"


def _fold_sql(where: str) -> str:
    return f"""e AS (SELECT min(col) AS x0, max(col) AS x1, min(row) AS y0, max(row) AS y1 FROM cells WHERE {where}),
        b AS (SELECT cells.*, CAST(floor((row - y0) / (greatest(y1 - y0, 1e-9) / 15)) * (floor(15 + 1e-9) + 1) + floor((col - x0) / (greatest(x1 - x0, 1e-9) / 15)) AS BIGINT) AS block FROM cells CROSS JOIN e WHERE {where}),
        u AS (SELECT block, CAST((row_number() OVER (ORDER BY {_scramble_sql('block', '(block + 1)', 2)}, block) - 1) % 5 AS INT) AS fold FROM (SELECT DISTINCT block FROM b)), f AS (SELECT b.*, fold FROM b JOIN u USING (block))"""


_KNOWN = " AND ".join(f"{c} IS NOT NULL" for c in ("lst", *_P))
_SLOPE = dict(zip(_P, ("-8", "-10", "12"), strict=True))


def _long_sql(body: str) -> str:
    return f"WITH {_CELLS}, t AS (SELECT * FROM cells WHERE {_KNOWN}), i AS (" + " UNION ALL ".join(body.format(p=p, w=f"({_SLOPE[p]}e0)") for p in _P) + ")"


_RANKED = "SELECT feature, CAST(row_number() OVER (ORDER BY v DESC, feature) AS INT) AS rank, round(v, 5) AS importance, round(100 * v / sum(v) OVER (), 5) AS pct"
_SHAP = _long_sql("SELECT '{p}' AS feature, avg(abs({w} * {p} - m)) AS v, {w} * (max({p}) - min({p})) AS d FROM t CROSS JOIN (SELECT avg({w} * {p}) AS m FROM t)")

ORACLE = {
    "catalogue": f"""WITH {_CELLS}, n AS ({' UNION ALL '.join(f"SELECT '{n}' AS measure, count(*) FILTER ({on}) AS possible_cells FROM cells" for n, on in _ON.items())}
        UNION ALL SELECT 'urban_park', count(*) FROM cells c WHERE {_VACANT} AND EXISTS (SELECT 1 FROM (SELECT row AS r, col AS k FROM cells WHERE {_VACANT}) v WHERE abs(r - c.row) + abs(k - c.col) = 1 AND r BETWEEN c.row - 1 AND c.row + 1)),
        m AS (SELECT measure, place, band, CAST(cost_per_m2 AS DOUBLE) AS cost_per_m2, a::DOUBLE AS surface_lo, b::DOUBLE AS surface_hi, c::DOUBLE AS air_lo, d::DOUBLE AS air_hi, e::DOUBLE AS radiant_lo, f::DOUBLE AS radiant_hi, (a::DOUBLE + b::DOUBLE) / 2 AS surface_mid, (c::DOUBLE + d::DOUBLE) / 2 AS air_mid, changes FROM (VALUES
        ('urban_trees', 'plantable', 'low-med', 12, 2, 12, 0.3, 2, 2, 8, 'albedo=+0.02,ndvi=+0.20,shade=+0.30,tree_frac=+0.20'), ('green_roof', 'roof', 'high', 120, 15, 45, 2, 5, 1, 3, 'albedo=+0.05,green_frac=+0.10,ndvi=+0.15'),
        ('cool_roof', 'roof', 'low', 5, 10, 30, 0.2, 2.3, 0, 1, 'albedo=+0.30'), ('cool_pavement', 'paved', 'med', 25, 5, 20, 0, 1, -3, 0, 'albedo=+0.25'), ('permeable_pavement', 'paved', 'med', 25, 2, 35, 0, 1, 0, 1, 'albedo=+0.05,soil_moisture=+0.10'),
        ('water_body', 'open', 'high', 120, 1, 3, 0.5, 3, 0, 2, 'ndwi=+0.30,soil_moisture=+0.20,water_frac=+0.50'), ('urban_park', 'vacant', 'high', 120, 1, 4.6, 0.5, 3.7, 1, 5, 'green_frac=+0.40,ndvi=+0.30,shade=+0.20,tree_frac=+0.20'),
        ('green_wall', 'facade', 'high', 120, 2, 13.7, 1.2, 3.3, 1, 3, 'albedo=+0.03,ndvi=+0.10'), ('increase_albedo', 'any', 'low-med', 12, 5, 25, 0.2, 2, -2, 0.5, 'albedo=+0.20')) t(measure, place, band, cost_per_m2, a, b, c, d, e, f, changes)) SELECT m.*, possible_cells, possible_cells * cost_per_m2 * 1e4 AS cost_everywhere FROM m JOIN n USING (measure)""",
    **{f"feasibility_{n}": f"WITH {_CELLS} SELECT row, col, CAST(coalesce({on}, false) AS INT) AS possible FROM cells" for n, on in _ON.items()},
    # two hectares are two cells: vacant, and a neighbour is
    "feasibility_urban_park": f"WITH {_CELLS}, v AS (SELECT row, col FROM cells WHERE {_VACANT}) SELECT row, col, CAST(EXISTS (SELECT 1 FROM v WHERE v.row = c.row AND v.col = c.col) AND EXISTS (SELECT 1 FROM v WHERE abs(v.row - c.row) + abs(v.col - c.col) = 1 AND v.row BETWEEN c.row - 1 AND c.row + 1) AS INT) AS possible FROM cells c",
    **{f"apply_{n}": _apply_sql(n) for n in _ADD},
    **{f"delta_{n}": _delta_sql(n) for n in _ADD},
    "delta_lst_cool_roof": f"WITH {_CELLS}, g AS (SELECT * FROM cells), {_KERNEL}, {_spread_sql(f'CASE WHEN impervious_frac >= 0.3 THEN {_ROOF} ELSE 0 END')} SELECT row, col, round(delta_lst, 5) AS delta_lst FROM z",
    "scenario_summary": f"WITH {_CELLS} SELECT * FROM {_share_sql('all', 'impervious_frac >= 0.6 OR impervious_frac <= 0.3', f'CASE WHEN impervious_frac >= 0.6 THEN {_ROOF} ELSE {_TREE} END')} UNION ALL SELECT * FROM {_share_sql('cool_roof', 'impervious_frac >= 0.6', _ROOF)} UNION ALL SELECT * FROM {_share_sql('urban_trees', 'impervious_frac <= 0.3', _TREE)}",
    "urban_cooling": f"""WITH {_CELLS}, r AS (SELECT row, col, tree_frac, albedo, {_VEG} AS veg, greatest(least(({_VEG} + 1.05e0 * water_frac + 0.2e0 * impervious_frac + 0.2e0 * {_BARE}) / ({_VEG} + water_frac + impervious_frac + {_BARE}), 1.5), 0) AS kc FROM cells),
        c AS (SELECT row, col, least(greatest(0.6e0 * tree_frac + 0.2e0 * albedo + 0.2e0 * kc / (SELECT max(kc) FROM r), 0), 1) AS cc, CASE WHEN veg >= 0.5 THEN 1e0 ELSE 0e0 END AS g FROM r),
        o AS (SELECT i AS dr, j AS dc, exp(-sqrt(i * i + j * j)) AS w FROM range(-3, 4) a(i), range(-3, 4) b(j)),
        p AS (SELECT a.row, a.col, sum(b.g * b.cc * w) AS park_cc, sum(b.g) * 1e4 AS ga FROM c a CROSS JOIN o JOIN c b ON b.row = a.row + dr AND b.col = a.col + dc GROUP BY ALL),
        h AS (SELECT c.row, c.col, cc, park_cc, greatest(0, least(1, CASE WHEN cc >= park_cc OR ga < 20000 THEN cc ELSE park_cc END)) AS hm FROM c JOIN p USING (row, col)),
        x AS (SELECT *, 28 + (1 - hm) * 4 AS n FROM h), e AS (SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM x),
        t AS (SELECT d, exp(-d * d / 4.5e0) / (SELECT sum(exp(-q * q / 4.5e0)) FROM range({-_REACH}, {_REACH + 1}) z(q)) AS w FROM range({-_REACH}, {_REACH + 1}) y(d)),
        v AS (SELECT a.row, a.col, sum(w * s.n) AS m, sum(w) AS w FROM x a CROSS JOIN e CROSS JOIN t JOIN x s ON s.row = greatest(r0, least(r1, a.row + d)) AND s.col = a.col GROUP BY ALL),
        b AS (SELECT a.row, a.col, CASE WHEN sum(t.w) > 1 - 1e-9 THEN sum(t.w * s.m) END AS t_air FROM x a CROSS JOIN e CROSS JOIN t JOIN v s ON s.col = greatest(c0, least(c1, a.col + d)) AND s.row = a.row AND s.w > 1 - 1e-9 GROUP BY ALL)
        SELECT x.row, x.col, round(cc, 5) AS cc, round(hm, 5) AS hm, round(park_cc, 5) AS park_cc, round(n, 5) AS t_air_nomix, round(t_air, 5) AS t_air, round(32 - t_air, 5) AS delta_t_air FROM x LEFT JOIN b USING (row, col)""",
    "synthetic_layers": f"WITH g AS ({synthetic_sql(_SIDE, _SIDE, _SEED)}) " + " UNION ALL ".join(f"SELECT '{n}' AS layer, count(*) AS cells, count({n}) AS known, round(avg({n}), 4) AS mean, round(CAST(min({n}) AS DOUBLE), 4) AS low, round(CAST(max({n}) AS DOUBLE), 4) AS high FROM g" for n in NAMES),
    "synthetic_signs": f"WITH g AS ({synthetic_sql(_SIDE, _SIDE, _SEED)}) " + " UNION ALL ".join(f"SELECT '{n}' AS layer, CAST(sign(corr({n}, lst)) AS INT) AS sign FROM g" for n in ("ndvi", "impervious_frac", "water_frac", "tree_frac", "svf", "anthro_heat")),
    "sample": f"WITH {_CELLS} SELECT row, col, round(lst, 5) AS lst, round(ndvi, 5) AS ndvi FROM cells WHERE lst IS NOT NULL AND ndvi IS NOT NULL ORDER BY {_scramble_sql('row', 'col', 3)}, row, col LIMIT 500",
    "feature_rows": f"WITH {_CELLS} SELECT row, col, " + ", ".join(f"round(({p} - avg({p}) OVER ()) / stddev_pop({p}) OVER (), 5) AS {p}" for p in _P) + " FROM cells",
    "feature_folds": f"WITH {_CELLS}, {_fold_sql('true')} SELECT row, col, block, fold FROM f",
    "linear_fit": f"WITH {_CELLS} SELECT round(regr_intercept(lst, ndvi), 5) AS base, round(regr_slope(lst, ndvi), 5) AS slope FROM cells",
    "linear_cv": f"""WITH {_CELLS}, {_fold_sql('lst IS NOT NULL AND ndvi IS NOT NULL')}, m AS (SELECT k AS fold, regr_slope(lst, ndvi) AS s, regr_intercept(lst, ndvi) AS i FROM f JOIN range(5) r(k) ON fold <> k GROUP BY k),
        g AS (SELECT fold, count(*) AS n, sqrt(avg(power(s * ndvi + i - lst, 2))) AS rmse, avg(abs(s * ndvi + i - lst)) AS mae, avg(s * ndvi + i - lst) AS bias FROM f JOIN m USING (fold) GROUP BY fold)
        SELECT fold, n, round(rmse, 5) AS rmse, round(mae, 5) AS mae, round(bias, 5) AS bias FROM g UNION ALL SELECT NULL, CAST(floor(avg(n)) AS BIGINT), round(avg(rmse), 5), round(avg(mae), 5), round(avg(bias), 5) FROM g""",
    "permutation_importance": _long_sql("SELECT '{p}' AS feature, 2 * covar_pop(0.1e0 * lst, {w} * {p}) + 2 * var_pop({w} * {p}) AS v FROM t") + " SELECT feature, CAST(row_number() OVER (ORDER BY greatest(v, 0) DESC, feature) AS INT) AS rank, round(greatest(v, 0), 5) AS importance, round(100 * greatest(v, 0) / sum(greatest(v, 0)) OVER (), 5) AS pct FROM i",
    "shapley_importance": f"{_SHAP} {_RANKED}, round(d, 5) AS mean_signed FROM i",
    "family_shares": f"{_SHAP}, k AS (SELECT CASE WHEN feature = 'impervious_frac' THEN 'lulc' ELSE 'vegetation' END AS family, v FROM i UNION ALL SELECT unnest(['lulc', 'morphology', 'vegetation', 'atmosphere']), 0) SELECT family, round(sum(v), 5) AS importance, round(100 * sum(v) / (SELECT sum(v) FROM i), 5) AS pct FROM k GROUP BY family",
    "sign_audit": f"{_SHAP} SELECT feature, CASE WHEN feature = 'impervious_frac' THEN 1 ELSE -1 END AS expected_sign, CAST(sign(d) AS INT) AS observed_sign, sign(d) = 0 OR sign(d) = CASE WHEN feature = 'impervious_frac' THEN 1 ELSE -1 END AS ok FROM i",
    "variance_shares": f"""WITH {_CELLS}, t AS (SELECT * FROM cells WHERE lst IS NOT NULL), c AS (SELECT corr(lst, ndvi) AS a, corr(lst, albedo) AS b, corr(ndvi, albedo) AS r FROM t), w AS (SELECT a * a AS a2, b * b AS b2, (a * a + b * b - 2 * a * b * r) / (1 - r * r) AS f FROM c)
        SELECT 'ndvi' AS feature, round((a2 + f - b2) / 2, 7) AS importance FROM w UNION ALL SELECT 'albedo', round((b2 + f - a2) / 2, 7) FROM w""",
    "residual_moran": f"""WITH {_CELLS}, z AS (SELECT row, col, lst - {_LIN} - avg(lst - {_LIN}) OVER () AS z FROM cells WHERE lst IS NOT NULL), n AS (SELECT a.row, a.col, any_value(a.z) AS z, avg(b.z) AS m FROM z a LEFT JOIN z b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 AND (b.row, b.col) <> (a.row, a.col) GROUP BY ALL)
        SELECT count(*) AS n, round(count(*) * sum(z * m) / count(m) / sum(z * z), 5) AS moran_i FROM n""",
}
