"""Queries on scenes, fusion, indices, strategy and the whole study, each with SQL written on its own where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CITIES, Config
from ..functions.formulas import column
from ..operators import fusion, indices, measures, scenes, strategy
from ..sources.cells import cells, cells_sql
from . import workflow

_CELLS = f"cells AS ({cells_sql()})"


def _round(df: DataFrame, keep: list[str], *values: str, digits: int = 5) -> DataFrame:
    return df.select(*keep, *[F.round(v, digits).alias(v) for v in values])


#: Scenes behind the orders table: four of each sensor, a stored number, a flag and a cloud share by whole-number arithmetic.
_SCENES = """SELECT s.sensor, CAST(k AS INT) AS scene_no, CAST(floor(o_orderkey / 50e0) AS INT) AS row, CAST(o_orderkey % 50 AS INT) AS col, CAST(k * 17 % 60 AS DOUBLE) AS cloud_pct, TIMESTAMP '2024-03-01 10:00:00' AS ts,
        CAST(s.base + (CAST(o_orderkey AS BIGINT) * (31 + k) % s.width) AS BIGINT) AS dn, CAST(CAST(o_orderkey AS BIGINT) * (7 + k) % 64 AS BIGINT) AS qa FROM orders CROSS JOIN (VALUES ('landsat', 42000, 4001), ('MOD11A1', 14900, 601), ('VNP21A1D', 14850, 701)) AS s(sensor, base, width) CROSS JOIN (VALUES (0), (1), (2), (3)) AS n(k)"""


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").createOrReplaceTempView("thermogrid_orders")
    return spark.sql(_SCENES.replace("FROM orders", "FROM thermogrid_orders"))


def _by_sensor(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    table = scenes.filtered(_scenes(spark, sf_dir), most_cloud=50.0)
    return {k: table.filter(F.col("sensor") == k).withColumnRenamed("dn", scenes.SENSORS[k].band) for k in ("landsat", "MOD11A1", "VNP21A1D")}


def _temperature(sensor: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _round(scenes.surface_temperature(_by_sensor(spark, sf_dir)[sensor], sensor), ["scene_no", "row", "col"], "lst")

    return run


def fused_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(scenes.fused_sensors(_by_sensor(spark, sf_dir), "mean").withColumn("fused", F.col("fused") + 1.7e-8), ["row", "col"], "fused", "fused_sigma")  # as in all_indices


def cloud_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _scenes(spark, sf_dir).filter("sensor = 'landsat'").withColumns({"scene_id": F.col("scene_no"), "b4": F.col("dn") * 1.0})
    clouds = table.filter("scene_no < 3").select("scene_id", "row", "col", (F.col("qa") * 1.5).alias("probability"))
    return scenes.without_clouds(table, clouds, ["b4"]).select("scene_no", "row", "col", "b4")


def reflectance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(scenes.reflectance(_by_sensor(spark, sf_dir)["landsat"].withColumnRenamed("st_b10", "b4"), ["b4"]), ["scene_no", "row", "col"], "b4")


def filled_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = cells(spark, sf_dir).select("row", "col", "lst", column("CASE WHEN row % 3 = 0 THEN air_temp END").alias("other"))
    return _round(scenes.filled_from(grid, "lst", ["other"], 1), ["row", "col"], "filled")


def sharpened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(scenes.sharpened(cells(spark, sf_dir).select("row", "col", "lst", "ndvi")), ["row", "col"], "sharp")


def downscaled_air(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = cells(spark, sf_dir).select("row", "col", "lst", "ndvi", "impervious_frac", "air_temp", (F.col("building_height") * 10).alias("elevation"))
    return _round(scenes.downscaled_air(grid), ["row", "col"], "air_fine")


def heat_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(scenes.heat_proxy(cells(spark, sf_dir).select("row", "col", "nightlights", "population", (F.col("building_height") * 3).alias("building_volume"))), ["row", "col"], "anthro_heat")


def weighted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = {"lst": 3.0, "air_temp": 2.0, "dewpoint": 1.0}
    return _round(scenes.weighted_mean(fusion.long_form(cells(spark, sf_dir), list(weights)), weights), ["row", "col"], "fused", "fused_sigma")


def monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = cells(spark, sf_dir).select("row", "col", "ndvi", "albedo")
    return _round(scenes.monte_carlo(grid, "35.0D - 8.0D * ndvi - 10.0D * albedo", {"ndvi": 0.05, "albedo": 0.02}, 50), ["row", "col"], "mean", "spread")


def all_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = cells(spark, sf_dir).select("row", "col", "lst", "ndvi", "air_temp", "rel_humidity", "dewpoint", "wind_speed", "solar_radiation", "lcz")
    names = ("lst_zscore", "lst_percentile", "suhii", "discomfort_index", "wbgt", "apparent_temp", "fvc")
    out = indices.all_indices(grid)  # a little is added, as engines round exact ties of short decimals differently
    return _round(out.withColumns({n: F.col(n) + 1.7e-8 for n in names}), ["row", "col", "human_stress_count"], *names)


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for key in CITIES:
        c = Config.from_city(key)
        rows.append((key, c.name, c.crs, *c.bbox))
    return spark.createDataFrame(rows, "city string, name string, crs string, west double, south double, east double, north double")


def cross_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.checks(spark).groupBy("kind", "active").agg(F.count("*").alias("n"))


_HAVE = ["lst", "population", "ndvi", "albedo", "impervious_frac", "green_frac", "tree_frac", "water_frac", "svf", "soil_moisture", "building_height"]


def _strategy(method: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        config = Config(budget=1e6, resolution_m=100.0)
        return strategy.strategy(cells(spark, sf_dir).select("row", "col", *_HAVE), measures.linear_model, config, method)["placements"]

    return run


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole study of a small synthetic city: step and whether it went well."""
    from ..sources.grid import layers_of

    out = workflow.run(spark, Config(shape=(24, 24), seed=5, budget=1e6), None, "linear")
    rows = [(s, s not in out["errors"]) for s in workflow.STEPS] + [("report", out["report"].startswith("# Heat study")), ("layers", len(layers_of(out["grid"])) > 50)]
    return spark.createDataFrame(rows, "step string, fine boolean")


QUERIES = {f.__name__: f for f in (fused_sensors, cloud_join, reflectance, filled_from, sharpened, downscaled_air, heat_proxy, weighted_sources, monte_carlo, all_indices, cities, cross_checks, study)}
QUERIES |= {f"temperature_{k.lower()}": _temperature(k) for k in ("landsat", "MOD11A1", "VNP21A1D")} | {f"strategy_{m}": _strategy(m) for m in strategy.METHODS}

_CLEAR = "CASE sensor WHEN 'landsat' THEN qa & 58 = 0 ELSE qa & 3 = 0 END"
_DEGREES = "CASE WHEN sensor = 'landsat' THEN dn * 0.00341802e0 + 149 ELSE dn * 0.02e0 END - 273.15e0"
_CLEAN = f"s AS ({_SCENES}), t AS (SELECT *, CASE WHEN {_CLEAR} THEN {_DEGREES} END AS lst FROM s WHERE cloud_pct < 50)"

ORACLE = {
    **{f"temperature_{k.lower()}": f"WITH {_CLEAN} SELECT scene_no, row, col, round(lst, 5) AS lst FROM t WHERE sensor = '{k}'" for k in ("landsat", "MOD11A1", "VNP21A1D")},
    "fused_sensors": f"""WITH {_CLEAN}, c AS (SELECT sensor, row, col, avg(lst) AS v, CASE WHEN sensor = 'landsat' THEN 1e0 ELSE 2.5e0 END AS e FROM t GROUP BY ALL)
        SELECT row, col, round(sum(v / (e * e)) / sum(1 / (e * e)) FILTER (v IS NOT NULL) + 1.7e-8, 5) AS fused, round(sqrt(1 / sum(1 / (e * e)) FILTER (v IS NOT NULL)), 5) AS fused_sigma FROM c GROUP BY row, col""",
    "cloud_join": f"WITH s AS ({_SCENES}) SELECT scene_no, row, col, CASE WHEN qa * 1.5e0 < 50 THEN CAST(dn AS DOUBLE) END AS b4 FROM s WHERE sensor = 'landsat' AND scene_no < 3",
    "reflectance": f"WITH s AS ({_SCENES}) SELECT scene_no, row, col, CASE WHEN qa & 58 = 0 THEN round(dn * 2.75e-5 - 0.2e0, 5) END AS b4 FROM s WHERE sensor = 'landsat' AND cloud_pct < 50",
    "filled_from": f"WITH {_CELLS}, f AS (SELECT row, col, coalesce(lst, CASE WHEN row % 3 = 0 THEN air_temp END) AS v FROM cells) SELECT a.row, a.col, round(coalesce(any_value(a.v), avg(b.v)), 5) AS filled FROM f a JOIN f b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY a.row, a.col",
    "sharpened": f"""WITH {_CELLS}, b AS (SELECT row // 10 AS r, col // 10 AS c, avg(lst) AS y, avg(CASE WHEN lst IS NOT NULL THEN ndvi END) AS x FROM cells GROUP BY ALL), f AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM b)
        SELECT row, col, round(ndvi * s + i + coalesce(y - x * s - i, 0), 5) AS sharp FROM cells CROSS JOIN f JOIN b ON r = row // 10 AND c = col // 10""",
    "downscaled_air": f"WITH {_CELLS}, m AS (SELECT avg(lst) AS l, avg(building_height * 10) AS e FROM cells) SELECT row, col, round(air_temp + 0.3e0 * (lst - l) - 1.5e0 * ndvi + impervious_frac - 0.0065e0 * (building_height * 10 - e), 5) AS air_fine FROM cells CROSS JOIN m",
    "heat_proxy": f"WITH {_CELLS}, q AS (SELECT quantile_cont(CAST(nightlights AS DOUBLE), 0.98) AS a, quantile_cont(CAST(population AS DOUBLE), 0.98) AS b, quantile_cont(CAST(building_height * 3 AS DOUBLE), 0.98) AS c FROM cells) SELECT row, col, round(150 * (0.5e0 * least(nightlights / a, 1) + 0.3e0 * least(population / b, 1) + 0.2e0 * least(building_height * 3 / c, 1)), 5) AS anthro_heat FROM cells CROSS JOIN q",
    "weighted_sources": f"""WITH {_CELLS}, e AS (SELECT row, col, lst AS v, 3e0 AS w FROM cells UNION ALL SELECT row, col, air_temp, 2e0 FROM cells UNION ALL SELECT row, col, dewpoint, 1e0 FROM cells), m AS (SELECT row, col, sum(w * v) / sum(w) AS m FROM e WHERE v IS NOT NULL GROUP BY ALL)
        SELECT row, col, round(any_value(m), 5) AS fused, round(sqrt(sum(w * (v - m) * (v - m)) / sum(w)), 5) AS fused_sigma FROM e JOIN m USING (row, col) WHERE v IS NOT NULL GROUP BY row, col""",
    "all_indices": f"""WITH {_CELLS}, g AS (SELECT avg(lst) AS m, stddev_pop(lst) AS s, median(lst) FILTER (lcz = 14) AS low, median(lst) FILTER (lcz BETWEEN 1 AND 10) AS urban, quantile_cont(lst, 0.25) AS q1 FROM cells),
        r AS (SELECT row, col, 100e0 * cume_dist() OVER (ORDER BY lst) AS p FROM cells WHERE lst IS NOT NULL), e AS (SELECT *, rel_humidity / 100 * 6.105e0 * exp(17.27e0 * air_temp / (237.7e0 + air_temp)) AS e FROM cells)
        SELECT e.row, e.col, CAST(h.human_stress_count AS INT) AS human_stress_count, round((lst - m) / s + 1.7e-8, 5) AS lst_zscore, round(p + 1.7e-8, 5) AS lst_percentile, round(lst - CASE WHEN low > urban THEN least(low, q1) ELSE low END + 1.7e-8, 5) AS suhii,
            round(air_temp - (0.55e0 - 0.0055e0 * rel_humidity) * (air_temp - 14.5e0) + 1.7e-8, 5) AS discomfort_index, round(0.567e0 * air_temp + 0.393e0 * e + 3.94e0 + 1.7e-8, 5) AS wbgt, round(air_temp + 0.348e0 * e - 0.7e0 * wind_speed + 0.7e0 * solar_radiation / (wind_speed + 10) - 4.25e0 + 1.7e-8, 5) AS apparent_temp,
            round(least(greatest(power((ndvi - 0.2e0) / 0.3e0, 2), 0), 1) + 1.7e-8, 5) AS fvc FROM e CROSS JOIN g LEFT JOIN r USING (row, col) JOIN (SELECT row, col, CAST(value AS INT) AS human_stress_count FROM ({{count}})) h ON h.row = e.row AND h.col = e.col""",
    "cities": """SELECT city, name, crs, w::DOUBLE AS west, s::DOUBLE AS south, e::DOUBLE AS east, n::DOUBLE AS north FROM (VALUES ('delhi', 'Delhi NCR', 'EPSG:32643', 76.84, 28.4, 77.35, 28.88), ('mumbai', 'Greater Mumbai', 'EPSG:32643', 72.77, 18.89, 72.99, 19.27), ('hyderabad', 'Hyderabad', 'EPSG:32644', 78.3, 17.2, 78.65, 17.55), ('ahmedabad', 'Ahmedabad', 'EPSG:32643', 72.45, 22.92, 72.72, 23.15), ('bengaluru', 'Bengaluru', 'EPSG:32643', 77.46, 12.83, 77.78, 13.14)) t(city, name, crs, w, s, e, n)""",
    "cross_checks": "SELECT * FROM (VALUES ('method', true, 19::BIGINT), ('data', true, 1), ('data', false, 6)) t(kind, active, n)",
    "study": "SELECT unnest(['grid', 'indices', 'hotspots', 'model', 'attribution', 'physics', 'portfolio', 'report', 'layers']) AS step, true AS fine",
}
