"""Queries over the test tables, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formulas as M
from ..functions.formulas import column, exact
from ..operators import fusion, stats, stencil
from ..sources.cells import cells, cells_sql
from ..sources.shared import kept
from . import byhand, decisions, learning, products, scenarios, sensing, transfers

_IND = ("air_temp", "rel_humidity")
_DELTA = M.albedo_to_delta("albedo * 0.1")
#: Row-wise formulas: name, expression over the cells.
SCALARS: dict[str, str] = {
    "saturation_vapour_pressure": M.saturation_vapour_pressure("air_temp"),
    "vapour_pressure_rh": M.vapour_pressure_from_rh(*_IND),
    "vapour_pressure_dewpoint": M.vapour_pressure_from_dewpoint("dewpoint"),
    "heat_index": M.heat_index(*_IND),
    "heat_index_category": M.heat_index_category(M.heat_index("air_temp + 8.0", "rel_humidity")),
    "humidex": M.humidex("air_temp", "dewpoint"),
    "wet_bulb": M.wet_bulb(*_IND),
    "wet_bulb_pressure": M.wet_bulb(*_IND, "pressure"),
    "wbgt_simplified": M.wbgt_simplified(*_IND),
    "wbgt_full_sun": M.wbgt_full("air_temp", M.wet_bulb(*_IND), "air_temp + 5.0"),
    "wbgt_full_shade": M.wbgt_full("air_temp", M.wet_bulb(*_IND), "air_temp + 5.0", solar=False),
    "apparent_temperature": M.apparent_temperature(*_IND, "wind_speed"),
    "apparent_temperature_radiation": M.apparent_temperature(*_IND, "wind_speed", "solar_radiation"),
    "discomfort_index": M.discomfort_index(*_IND),
    "net_effective_temperature": M.net_effective_temperature(*_IND, "wind_speed"),
    "mean_radiant_temperature": M.mean_radiant_temperature("air_temp", "solar_radiation", "wind_speed", "svf", "albedo"),
    "utci": M.utci(*_IND, "wind_speed", "lst"),
    "utci_category": M.utci_category(M.utci(*_IND, "wind_speed", "lst")),
    "human_stress_count": M.human_stress_count(*_IND, "dewpoint"),
    "human_stress_score": f"(100.0 * {M.human_stress_count(*_IND, 'dewpoint')} / 5.0)",
    "work_loss_heavy": M.work_loss(M.wbgt_simplified(*_IND)),
    "work_loss_light": M.work_loss(M.wbgt_simplified(*_IND), "light"),
    "ndvi_index": M.normalized_difference("b8", "b4"),
    "ndwi_index": M.normalized_difference("b3", "b8"),
    "mndwi_index": M.normalized_difference("b3", "b11"),
    "ndbi_index": M.normalized_difference("b11", "b8"),
    "ndbai_index": M.normalized_difference("b11", "b12"),
    "urban_index": M.normalized_difference("b12", "b8"),
    "evi_index": M.evi("b2", "b4", "b8"),
    "savi_index": M.savi("b4", "b8"),
    "lai_index": M.lai(M.evi("b2", "b4", "b8")),
    "fvc_square_then_clip": M.fvc_square_then_clip("ndvi"),
    "fvc_clip_then_square": M.fvc_clip_then_square("ndvi"),
    "emissivity_threshold": M.emissivity_threshold("ndvi"),
    "emissivity_from_ndvi": M.emissivity_from_ndvi("ndvi"),
    "emissivity_filled": M.emissivity_filled("CASE WHEN ndvi > 0.0 THEN ndvi END", "965.0", "970.0"),
    "albedo_sentinel": M.albedo_sentinel("b2", "b3", "b4", "b8", "b11", "b12"),
    "albedo_landsat": M.albedo_landsat("b2", "b4", "b8", "b11", "b12"),
    "scaled_band": M.scaled("qa", 2.75e-05, -0.2),
    "lst_celsius": M.celsius("lst + 273.15"),
    "mono_window_lst": M.mono_window("lst + 273.15", "emissivity"),
    "landsat_mask": M.masked("lst", "qa", 58),
    "landsat_mask_no_snow": M.masked("lst", "qa", 26),
    "modis_mask": M.masked("lst", "qa", 3),
    "diurnal_normalize": M.diurnal_shift("lst", "10.5"),
    "magnus_vapour_pressure": M.magnus("dewpoint"),
    "relative_humidity": M.relative_humidity("air_temp", "dewpoint"),
    "wind_from_components": M.wind_speed("wind_speed - 3.0", "svf"),
    "impervious_fraction": M.impervious("impervious_frac * 10000.0", "10000.0", "green_frac"),
    "building_height_cascade": M.building_height("impervious_frac", "building_height + 200.0", "205.0", "tree_frac"),
    "frontal_area_index": M.frontal_area_index("impervious_frac", "building_height"),
    "aspect_ratio": M.aspect_ratio("impervious_frac", "building_height"),
    "sky_view_factor": M.sky_view_factor(M.aspect_ratio("impervious_frac", "building_height")),
    "displacement_over_height": M.displacement_over_height("impervious_frac"),
    "roughness_length_macdonald": M.roughness_length("impervious_frac", M.frontal_area_index("impervious_frac", "building_height"), "building_height"),
    "saturation_kpa": M.saturation_kpa("air_temp"),
    "longwave_up": M.longwave_up("lst", "emissivity", "longwave_down"),
    "lst_from_longwave": M.lst_from_longwave(M.longwave_up("lst", "emissivity"), "emissivity"),
    "shortwave_net": M.shortwave_net("albedo", "solar_radiation"),
    "net_radiation": M.net_radiation("albedo", "solar_radiation", "longwave_down", "emissivity", "lst"),
    "aerodynamic_resistance": M.aerodynamic_resistance("wind_speed", "roughness_length"),
    "sensible_heat": M.sensible_heat("lst", "air_temp", "wind_speed", "roughness_length"),
    "latent_heat": M.latent_heat("lst", "air_temp", "rel_humidity", "wind_speed", "roughness_length"),
    "bowen_ratio": M.bowen_ratio("lst * 4.0", "air_temp - 30.0"),
    "storage_heat_ohm": M.storage_heat("solar_radiation", {n: n for n in M.OHM}),
    "physics_lst": M.physics_lst("air_temp", "albedo", "solar_radiation", "longwave_down", "emissivity", "green_frac", "tree_frac", "water_frac", "impervious_frac", "soil_moisture", "wind_speed", "anthro_heat"),
    "seb_residual": M.seb_residual("lst", "air_temp", "wind_speed", "roughness_length", "rel_humidity", "soil_moisture", "green_frac", "tree_frac", "water_frac", "impervious_frac", M.net_radiation("albedo", "solar_radiation", "longwave_down", "emissivity", "lst"), "anthro_heat"),
    "albedo_to_delta_lst": _DELTA,
    "et_to_delta_lst": M.et_to_delta("soil_moisture * 10.0"),
    "priority_class": M.priority_class("lst * 2.0"),
    **{f"feasible_{k}": f"CASE WHEN {M.feasible(k)} THEN 1 ELSE 0 END" for k in ("roof", "plantable", "paved", "open", "vacant", "facade")},
    **{f"perturb_{n}": M.perturbed(n, str(d), M.feasible(k)) for n, d, k in (("ndvi", 0.3, "plantable"), ("albedo", 0.45, "roof"), ("impervious_frac", -0.4, "paved"), ("water_frac", 0.5, "open"), ("svf", -0.15, "plantable"), ("soil_moisture", 0.2, "vacant"))},
    "clip_cooling": M.clip_cooling("lst - 25.0"),
    "shade_index": M.shade_index("tree_frac"),
    "crop_coefficient": M.crop_coefficient("tree_frac", "green_frac", "water_frac", "impervious_frac"),
    "cooling_capacity": M.cooling_capacity(M.shade_index("tree_frac"), "albedo", "soil_moisture"),
    "physics_delta_lst": M.physics_delta("albedo * 0.2", "solar_radiation", "emissivity", "lst", "green_frac * 0.1", "0.05"),
    "solweig_tmrt": M.solweig_tmrt("lst", "svf", "0.1"),
    "linear_lst_model": "(35.0 - 8.0 * ndvi - 10.0 * albedo + 12.0 * impervious_frac)",
}
#: Added before rounding, as the engines round exact ties of short decimals differently.
TIE = 1.7e-8
_CELLS = f"cells AS ({cells_sql()})"


def _scalar(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cells(spark, sf_dir).select("row", "col", F.round(column(text).cast("double") + TIE, 5).alias("value"))

    return run


def _rounded(df: DataFrame, *names: str, digits: int = 5) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def _cells(run):
    """A query that gets the cells."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(cells(spark, sf_dir))

    return query


def _hotspots(grid: DataFrame) -> DataFrame:
    base = kept(grid.select("row", "col", "lst"), "hotspots")
    z = stats.percentile_rank(stencil.getis_ord(base, "lst"), "lst", "lst_percentile", source=base)
    masked = stencil.surface_hotspots(z)
    return _rounded(masked.select("row", "col", "lst_percentile", "gistar_z", "hotspot_mask"), "lst_percentile", "gistar_z")


def _events(run):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(spark.read.parquet(f"{sf_dir}/events.parquet"))

    return query


def _whole_composite(reducer: str):
    return _events(lambda e: _rounded(fusion.composite(e, ["user_id", "event_type"], "value", "ts", reducer), "value"))


def _composite(reducer: str):
    return _events(lambda e: _rounded(fusion.composite(fusion.scene_filter(e, "2024-01-05", "2024-01-25"), ["user_id", "event_type"], "value", "ts", reducer), "value"))


_LONG = {"lst": 1.0, "air_temp": 2.0, "dewpoint": 2.5}
_est = lambda g: fusion.long_form(g, list(_LONG), _LONG)
_pairs = lambda g: g.select("lcz", F.col("lst").alias("y_true"), column("35.0 - 8.0 * ndvi - 10.0 * albedo + 12.0 * impervious_frac").alias("y_pred"))
_METRICS = ("rmse", "mae", "bias", "ubrmse", "r2", "nse", "ccc", "kge")

QUERIES = decisions.QUERIES | learning.QUERIES | products.QUERIES | scenarios.QUERIES | sensing.QUERIES | transfers.QUERIES | {f"fn_{n}": _scalar(x) for n, x in SCALARS.items()} | {
    "surface_hotspots": _cells(_hotspots),
    "hotspot_stats": _cells(lambda g: _hotspots(g).agg(F.count("*").alias("cells"), F.sum("hotspot_mask").alias("hot"), F.round(F.avg("hotspot_mask") * 100, 5).alias("hot_pct"))),
    "lst_zscore": _cells(lambda g: _rounded(stats.zscore(g, "lst", "z").select("row", "col", "z"), "z")),
    "lst_percentile": _cells(lambda g: _rounded(stats.percentile_rank(g, "lst", "p").select("row", "col", "p"), "p")),
    "lst_minmax": _cells(lambda g: _rounded(stats.minmax(g, "lst", "m").select("row", "col", "m"), "m")),
    "lst_quintiles": _cells(lambda g: stats.quintiles(g, "lst", "q").select("row", "col", "q")),
    "priority_score": _cells(lambda g: _rounded(stats.priority_score(stats.equity_weights(g)).select("row", "col", "weight", "priority"), "weight", "priority")),
    "surface_uhi": _cells(lambda g: _rounded(stats.surface_uhi(g).select("row", "col", "suhii"), "suhii")),
    "surface_uhi_median": _cells(lambda g: _rounded(stats.surface_uhi(g, lcz=None).select("row", "col", "suhii"), "suhii")),
    "utfvi": _cells(lambda g: _rounded(stats.utfvi(g).select("row", "col", "utfvi", "eei"), "utfvi", digits=7)),
    "getis_ord_rook": _cells(lambda g: _rounded(stencil.getis_ord(g.select("row", "col", "lst"), contiguity="rook").select("row", "col", "gistar_z"), "gistar_z")),
    "local_moran": _cells(lambda g: _rounded(stencil.local_moran(g.select("row", "col", "lst")).select("row", "col", "moran_i", "moran_local"), "moran_i")),
    "decay_spread": _cells(lambda g: _rounded(stencil.neighbour_sums(g.select("row", "col", "green_frac"), stencil.decay_kernel(1.0), cooled=F.col("green_frac")).select("row", "col", "cooled"), "cooled")),
    "metric_panel": _cells(lambda g: _rounded(stats.metric_panel(_pairs(g)), *_METRICS)),
    "stratified_metrics": _cells(lambda g: _rounded(stats.metric_panel(_pairs(g), by=["lcz"]), *_METRICS)),
    "inverse_variance": _cells(lambda g: _rounded(fusion.inverse_variance(_est(g)), "fused", "fused_sigma")),
    "agreement_map": _cells(lambda g: _rounded(fusion.agreement(_est(g)), "mean", "spread")),
    "majority_vote": _cells(lambda g: _rounded(fusion.majority_vote(fusion.long_form(g.selectExpr("row", "col", "water_frac * 3 AS a", "tree_frac * 3 AS b", "green_frac * 3 AS c"), ["a", "b", "c"])), "share")),
    "triple_collocation": _cells(lambda g: _rounded(fusion.triple_collocation(g.selectExpr("lst AS a", "lst + air_temp * 0.1 AS b", "lst + dewpoint * 0.2 AS c"), "a", "b", "c"), "var_a", "var_b", "var_c", "weight_a", "weight_b", "weight_c")),
    "reconcile_sensors": _cells(lambda g: _rounded(fusion.reconcile(g, "air_temp", "lst", "matched").select("row", "col", "matched"), "matched")),
    **{f"composite_{r}": _composite(r) for r in ("median", "mean", "min", "max")},
    **{f"whole_composite_{r}": _whole_composite(r) for r in ("median", "mean", "min", "max", "mosaic")},
    "deaccumulate": _events(lambda e: _rounded(fusion.deaccumulate(e.groupBy("user_id", F.date_trunc("hour", "ts").alias("ts")).agg(F.sum("value").alias("acc")), ["user_id"], "acc", "ts", "rate").select("user_id", "ts", "rate"), "rate", digits=7)),
}

_G = "g AS (SELECT count(lst) AS n, avg(lst) AS m, stddev_pop(lst) AS s FROM cells)"
_RANK = "ranked AS (SELECT row, col, 100e0 * cume_dist() OVER (ORDER BY lst) AS p FROM cells WHERE lst IS NOT NULL)"


def _gi(shape: str) -> str:
    return f"""nb AS (SELECT a.row, a.col, sum(b.lst) AS wx, CAST(count(b.lst) AS DOUBLE) AS w FROM cells a JOIN cells b ON {shape} GROUP BY a.row, a.col),
        gi AS (SELECT c.row, c.col, CASE WHEN c.lst IS NOT NULL THEN CASE WHEN s * sqrt(greatest((n * w - w * w) / (n - 1), 0)) > 0 THEN (wx - m * w) / (s * sqrt(greatest((n * w - w * w) / (n - 1), 0))) ELSE 0 END END AS z
        FROM cells c JOIN nb USING (row, col) CROSS JOIN g)"""


_QUEEN = "b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1"
_HOT = f"""WITH {_CELLS}, {_G}, {_RANK}, {_gi(_QUEEN)},
        hot AS (SELECT c.row, c.col, round(p, 5) AS lst_percentile, round(z, 5) AS gistar_z, CASE WHEN p >= 90 AND z >= 1.96 THEN 1 ELSE 0 END AS hotspot_mask
        FROM cells c LEFT JOIN ranked USING (row, col) LEFT JOIN gi USING (row, col))"""
_P = exact("35.0 - 8.0 * ndvi - 10.0 * albedo + 12.0 * impervious_frac")
_PANEL = """n, round(sqrt(mse), 5) AS rmse, round(mae, 5) AS mae, round(bias, 5) AS bias, round(sqrt(greatest(mse - bias * bias, 0)), 5) AS ubrmse,
        round(1 - mse / vt, 5) AS r2, round(1 - mse / vt, 5) AS nse, round(2 * c / (vt + vp + (mt - mp) * (mt - mp)), 5) AS ccc,
        round(1 - sqrt(power(c / sqrt(vt * vp) - 1, 2) + power(sqrt(vp) / sqrt(vt) - 1, 2) + power(mp / mt - 1, 2)), 5) AS kge"""
_SUMS = "count(*) AS n, avg((p - t) * (p - t)) AS mse, avg(abs(p - t)) AS mae, avg(p - t) AS bias, var_pop(t) AS vt, var_pop(p) AS vp, covar_pop(t, p) AS c, avg(t) AS mt, avg(p) AS mp"
_EST = "e AS (" + " UNION ALL ".join(f"SELECT row, col, {n} AS value, {s} AS sigma FROM cells" for n, s in _LONG.items()) + ")"
_OFFSETS = ", ".join(f"({r}, {c}, {w!r}e0)" for r, c, w in stencil.decay_kernel(1.0))
_COMPOSITE = "SELECT user_id, event_type, round({f}(value), 5) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' GROUP BY user_id, event_type"
_WHOLE = "SELECT user_id, event_type, round({f}, 5) AS value FROM events GROUP BY user_id, event_type"
_REDUCE = {"median": "median(value)", "mean": "avg(value)", "min": "min(value)", "max": "max(value)", "mosaic": "max(value) FILTER (ts = last)"}
_LAST = "(SELECT *, max(ts) FILTER (value IS NOT NULL) OVER (PARTITION BY user_id, event_type) AS last FROM events)"

ORACLE = decisions.ORACLE | products.ORACLE | scenarios.ORACLE | sensing.ORACLE | transfers.ORACLE | {f"fn_{n}": f"WITH {_CELLS} SELECT row, col, round(CAST({exact(x)} AS DOUBLE) + {TIE!r}, 5) AS value FROM cells" for n, x in SCALARS.items()} | {
    "surface_hotspots": f"{_HOT} SELECT * FROM hot",
    "hotspot_stats": f"{_HOT} SELECT count(*) AS cells, CAST(sum(hotspot_mask) AS BIGINT) AS hot, round(avg(hotspot_mask) * 100, 5) AS hot_pct FROM hot",
    "lst_zscore": f"WITH {_CELLS}, {_G} SELECT row, col, round((lst - m) / s, 5) AS z FROM cells CROSS JOIN g",
    "lst_percentile": f"WITH {_CELLS}, {_RANK} SELECT c.row, c.col, round(p, 5) AS p FROM cells c LEFT JOIN ranked USING (row, col)",
    "lst_minmax": f"WITH {_CELLS} SELECT row, col, round((lst - lo) / (hi - lo), 5) AS m FROM cells CROSS JOIN (SELECT min(lst) AS lo, max(lst) AS hi FROM cells)",
    "lst_quintiles": f"WITH {_CELLS}, q AS (SELECT quantile_cont(lst, [0.2, 0.4, 0.6, 0.8]) AS e FROM cells) SELECT row, col, CASE WHEN lst IS NULL THEN 0 ELSE 1 + (lst > e[1])::INT + (lst > e[2])::INT + (lst > e[3])::INT + (lst > e[4])::INT END AS q FROM cells CROSS JOIN q",
    "priority_score": f"WITH {_CELLS}, p AS (SELECT avg(greatest(population, 0)) AS m, quantile_cont(lst, [0.05, 0.95]) AS q FROM cells) SELECT row, col, round(greatest(population, 0) / m, 5) AS weight, round(CASE WHEN lst IS NOT NULL THEN greatest(0, least(1, (lst - q[1]) / (q[2] - q[1]))) * greatest(population, 0) / m END, 5) AS priority FROM cells CROSS JOIN p",
    "surface_uhi": f"WITH {_CELLS}, r AS (SELECT coalesce(median(lst) FILTER (lcz = 14), median(lst) FILTER (lcz >= 11), median(lst)) AS ref, median(lst) FILTER (lcz BETWEEN 1 AND 10) AS urban, quantile_cont(lst, 0.25) AS q1 FROM cells) SELECT row, col, round(lst - CASE WHEN ref > urban THEN least(ref, q1) ELSE ref END, 5) AS suhii FROM cells CROSS JOIN r",
    "surface_uhi_median": f"WITH {_CELLS} SELECT row, col, round(lst - r, 5) AS suhii FROM cells CROSS JOIN (SELECT median(lst) AS r FROM cells)",
    "utfvi": f"WITH {_CELLS}, u AS (SELECT row, col, (lst + 273.15e0 - m) / m AS utfvi FROM cells CROSS JOIN (SELECT avg(lst) + 273.15e0 AS m FROM cells)) SELECT row, col, round(utfvi, 7) AS utfvi, {exact(M.eei_class('utfvi'))} AS eei FROM u",
    "getis_ord_rook": f"WITH {_CELLS}, {_G}, {_gi('abs(b.row - a.row) + abs(b.col - a.col) <= 1')} SELECT row, col, round(z, 5) AS gistar_z FROM gi",
    "local_moran": f"""WITH {_CELLS}, {_G}, d AS (SELECT row, col, lst - m AS d FROM cells CROSS JOIN g), s AS (SELECT avg(d * d) AS m2, avg(power(d, 4)) AS m4 FROM d),
        nb AS (SELECT a.row, a.col, sum(b.d) / nullif(count(b.d), 0) AS lag FROM d a LEFT JOIN d b ON {_QUEEN} AND NOT (a.row = b.row AND a.col = b.col) GROUP BY a.row, a.col),
        v AS (SELECT n, m2, m4 / (m2 * m2) AS b2 FROM g CROSS JOIN s), w AS (SELECT m2, -1e0 / (n - 1) AS e, (n - b2) / (n - 1) - (2 * b2 - n) / ((n - 1e0) * (n - 2)) - power(-1e0 / (n - 1), 2) AS var FROM v)
        SELECT d.row, d.col, round(d * lag / m2, 5) AS moran_i, CASE WHEN d IS NOT NULL AND abs((d * lag / m2 - e) / sqrt(var)) >= 1.96 THEN CASE WHEN d > 0 AND lag > 0 THEN 1 WHEN d <= 0 AND lag <= 0 THEN 2 WHEN d > 0 THEN 3 ELSE 4 END ELSE 0 END AS moran_local
        FROM d JOIN nb USING (row, col) CROSS JOIN w""",
    "decay_spread": f"WITH {_CELLS}, o(r, c, w) AS (VALUES {_OFFSETS}) SELECT a.row, a.col, round(sum(b.green_frac * w), 5) AS cooled FROM cells a CROSS JOIN o JOIN cells b ON b.row = a.row + o.r AND b.col = a.col + o.c GROUP BY a.row, a.col",
    "metric_panel": f"WITH {_CELLS}, t AS (SELECT lst AS t, {_P} AS p FROM cells WHERE lst IS NOT NULL), a AS (SELECT {_SUMS} FROM t) SELECT {_PANEL} FROM a",
    "stratified_metrics": f"WITH {_CELLS}, t AS (SELECT lcz, lst AS t, {_P} AS p FROM cells WHERE lst IS NOT NULL), a AS (SELECT lcz, {_SUMS} FROM t GROUP BY lcz) SELECT lcz, {_PANEL} FROM a",
    "inverse_variance": f"WITH {_CELLS}, {_EST} SELECT row, col, round(sum(value / (sigma * sigma)) / sum(1e0 / (sigma * sigma)) FILTER (value IS NOT NULL), 5) AS fused, round(sqrt(1e0 / sum(1e0 / (sigma * sigma)) FILTER (value IS NOT NULL)), 5) AS fused_sigma FROM e GROUP BY row, col",
    "agreement_map": f"WITH {_CELLS}, {_EST}, m AS (SELECT row, col, median(value) AS m FROM e GROUP BY row, col) SELECT row, col, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS spread, count(*) FILTER (abs(value - m) <= 1) AS agree FROM e JOIN m USING (row, col) GROUP BY row, col",
    "majority_vote": f"WITH {_CELLS}, e AS (SELECT row, col, water_frac * 3 AS v FROM cells UNION ALL SELECT row, col, tree_frac * 3 FROM cells UNION ALL SELECT row, col, green_frac * 3 FROM cells), k AS (SELECT row, col, CAST(round_even(v, 0) AS BIGINT) AS class, count(*) AS n FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY n DESC, class) AS r, sum(n) OVER (PARTITION BY row, col) AS total FROM k) SELECT row, col, class, round(CAST(n AS DOUBLE) / total, 5) AS share FROM r WHERE r = 1",
    "triple_collocation": f"""WITH {_CELLS}, x AS (SELECT lst AS a, lst + air_temp * 0.1 AS b, lst + dewpoint * 0.2 AS c FROM cells WHERE lst IS NOT NULL),
        m AS (SELECT count(*) AS n, covar_samp(a, a) AS aa, covar_samp(b, b) AS bb, covar_samp(c, c) AS cc, covar_samp(a, b) AS ab, covar_samp(a, c) AS ac, covar_samp(b, c) AS bc FROM x),
        v AS (SELECT n, greatest(aa - ab * ac / bc, 1e-6) AS va, greatest(bb - ab * bc / ac, 1e-6) AS vb, greatest(cc - ac * bc / ab, 1e-6) AS vc FROM m)
        SELECT n, round(va, 5) AS var_a, round(vb, 5) AS var_b, round(vc, 5) AS var_c, round(1 / va / (1 / va + 1 / vb + 1 / vc), 5) AS weight_a, round(1 / vb / (1 / va + 1 / vb + 1 / vc), 5) AS weight_b, round(1 / vc / (1 / va + 1 / vb + 1 / vc), 5) AS weight_c FROM v""",
    "reconcile_sensors": f"WITH {_CELLS}, s AS (SELECT avg(air_temp) AS ml, stddev_pop(air_temp) AS sl, avg(lst) AS mr, stddev_pop(lst) AS sr FROM cells) SELECT row, col, round((air_temp - ml) * sr / sl + mr, 5) AS matched FROM cells CROSS JOIN s",
    **{f"composite_{r}": _COMPOSITE.format(f={"mean": "avg"}.get(r, r)) for r in ("median", "mean", "min", "max")},
    **{f"whole_composite_{r}": _WHOLE.format(f=f).replace("events", _LAST if r == "mosaic" else "events") for r, f in _REDUCE.items()},
    "deaccumulate": "WITH h AS (SELECT user_id, date_trunc('hour', ts) AS ts, sum(value) AS acc FROM events GROUP BY ALL) SELECT user_id, ts, round(CASE WHEN hour(ts) = 1 THEN acc ELSE acc - lag(acc) OVER (PARTITION BY user_id ORDER BY ts) END / 3600e0, 7) AS rate FROM h",
}

ORACLE |= {k: v for k, v in byhand.sql(_CELLS, TIE).items() if k in ORACLE}
ORACLE["all_indices"] = ORACLE["all_indices"].replace("{count}", ORACLE["fn_human_stress_count"])
