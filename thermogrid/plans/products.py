"""Queries on feature tables from observations: reanalysis behind the line items, the other products behind the orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import products
from ..sources.cells import WIDTH

#: Numbers are given with a little added, as engines round exact ties differently.
_TIE = 1.7e-8
_START, _END = "2024-06-01 21:00:00", "2024-06-02 05:00:00"

#: Stored numbers of each band by whole-number arithmetic on key k and moment j; a band named in the gaps is masked there.
_HOURLY = {
    "temperature_2m": "290 + (k * 37 + j * 7) % 211 / 10e0",
    "dewpoint_temperature_2m": "275 + (k * 41 + j * 5) % 151 / 10e0",
    "u_component_of_wind_10m": "(k * 29 + j) % 91 / 10e0 - 4",
    "v_component_of_wind_10m": "(k * 31 + j) % 71 / 10e0 - 3",
    "surface_pressure": "90000 + (k * 43 + j) % 1301",
    "surface_solar_radiation_downwards": "1000 * ((k * 59) % 701 + j * 36e0 + (j * k) % 13)",
    "surface_thermal_radiation_downwards": "1000 * ((k * 61) % 501 + j * 40e0 + (j * k) % 17)",
    "surface_net_solar_radiation": "900 * ((k * 67) % 601 + j * 30e0 + (j * k) % 11)",
    "surface_net_thermal_radiation": "-500 * ((k * 71) % 301 + j * 20e0 + (j * k) % 7)",
    "volumetric_soil_water_layer_1": "(k * 47 + j) % 501 / 1000e0",
    "boundary_layer_height": "200 + (k * 53 + j) % 1501",
}
_EPOCHS = {
    ("ghsl_pop", "population_count"): "(k * 3 + j) % 997 - 5",
    ("black_marble", "gap_filled_ntl"): "(k * 73 + j) % 801 / 10e0",
    ("ghsl_built_v", "built_volume_total"): "(k * 79 + j) % 6001",
    ("ghsl_built_s", "built_surface"): "(k * 17 + j) % 12001",
    ("glo30", "dem"): "210 + (k * 67 + j) % 401 / 10e0",
    ("fabdem", "b1"): "205 + (k * 19) % 101 / 10e0",
    ("ghsl_built_h", "built_height"): "(k * 23) % 301 / 10e0 - 1",
    ("nasadem", "elevation"): "200 + (k * 11) % 97 / 10e0",
    ("global_lcz", "lcz_filter"): "1 + (k * 5 + j) % 19",
    ("mcd43a3", "albedo_bsa_shortwave"): "(k * 83 + j * 3) % 1301",
    ("mcd43a3", "albedo_wsa_shortwave"): "(k * 89 + j * 3) % 1101",
    ("mod16a2gf", "et"): "(k * 97 + j) % 301",
}
_MASKED = "(k + j) % 7 = 0"
_PLACE = (f"CAST(floor(k / {WIDTH}e0) AS INT) AS row", f"CAST(k % {WIDTH} AS INT) AS col")
_HOUR = "TIMESTAMP '2024-06-01 20:00:00' + {hours}"
_EPOCH = "TIMESTAMP '2024-06-01 12:00:00' + {days}"


def _long(keyed: DataFrame, values: dict[tuple[str, str], str]) -> DataFrame:
    """The observations in long form: one row for each key, moment and band."""
    one = [F.struct(F.lit(p).alias("product"), F.lit(b).alias("band"), F.expr(f"CAST({x} AS DOUBLE)").alias("value")) for (p, b), x in values.items()]
    x = keyed.select(*[F.expr(c) for c in _PLACE], "ts", F.expr(_MASKED).alias("_gap"), F.explode(F.array(*one)).alias("o"))
    return x.select("row", "col", "ts", "o.product", "o.band", F.when(~F.col("_gap"), F.col("o.value")).alias("value"))


def hourly_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reanalysis bands, one hour for each line of an order; lines of one number are one moment."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").cast("bigint").alias("k"), F.col("l_linenumber").alias("j"))
    lines = lines.withColumn("ts", F.expr(_HOUR.format(hours="make_dt_interval(0, CAST(j + k % 4 AS INT))")))
    names = {("era5_hourly" if b == "boundary_layer_height" else "era5_land_hourly", b): x for b, x in _HOURLY.items()}
    return _long(lines, names)


def epoch_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of the surface, its people and its form in three epochs of each order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("bigint").alias("k"), F.explode(F.array(*[F.lit(j) for j in range(3)])).alias("j"))
    return _long(orders.withColumn("ts", F.expr(_EPOCH.format(days="make_dt_interval(j)"))), _EPOCHS)


def _rounded(df: DataFrame, layers: list[str]) -> DataFrame:
    return df.select("row", "col", *[F.round(F.col(c) + _TIE, 5).alias(c) if c != "lcz" else F.col(c) for c in layers])


def reanalysis_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = products.build_features(hourly_observations(spark, sf_dir), _START, _END, {"reanalysis": products.REANALYSIS})
    return _rounded(out.table, list(products.REANALYSIS.layers))


_GROUPS = {"surface": products.SURFACE, "people": products.PEOPLE, "air_quality": products.AIR_QUALITY, "morphology": products.morphology(10_000.0)}
_LAYERS = ["albedo", "et", "lcz", "population", "nightlights", "building_volume", "aod", "no2", "plan_area_frac", "building_height", "frontal_area_index", "aspect_ratio", "svf", "roughness_length", "displacement_height", "elevation", "slope", "anthro_heat"]


def surface_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = products.build_features(epoch_observations(spark, sf_dir), "2024-06-01", "2024-06-03", _GROUPS)
    return _rounded(out.table, _LAYERS)


def missing_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each layer that a build with all groups makes, with the number of cells that know it."""
    table = products.build_features(epoch_observations(spark, sf_dir), "2024-06-01", "2024-06-03", products.default_groups(10_000.0)).table
    layers = [c for c in table.columns if c not in ("row", "col")]
    return table.agg(*[F.count(c).alias(c) for c in layers]).unpivot([], layers, "layer", "known")


QUERIES = {f.__name__: f for f in (reanalysis_layers, surface_layers, missing_layers)}

_B = {"t": "temperature_2m", "d": "dewpoint_temperature_2m", "u": "u_component_of_wind_10m", "v": "v_component_of_wind_10m", "p": "surface_pressure", "w": "volumetric_soil_water_layer_1", "h": "boundary_layer_height"}
_R = {"solar_radiation": "surface_solar_radiation_downwards", "longwave_down": "surface_thermal_radiation_downwards", "ns": "surface_net_solar_radiation", "nt": "surface_net_thermal_radiation"}
_E = {"pop": ("ghsl_pop", "population_count"), "ntl": ("black_marble", "gap_filled_ntl"), "vol": ("ghsl_built_v", "built_volume_total"), "bsa": ("mcd43a3", "albedo_bsa_shortwave"), "wsa": ("mcd43a3", "albedo_wsa_shortwave"), "et": ("mod16a2gf", "et"),
      "built": ("ghsl_built_s", "built_surface"), "dsm": ("glo30", "dem"), "dem": ("fabdem", "b1"), "anbh": ("ghsl_built_h", "built_height"), "elevation": ("nasadem", "elevation"), "z": ("global_lcz", "lcz_filter")}
_MEAN, _LATEST = ("ntl", "bsa", "wsa", "et"), ("pop", "vol")
_ZONE_HW = "[2.5e0, 1.25e0, 1e0, 1e0, 0.5e0, 0.5e0, 1.5e0, 0.2e0, 0.15e0, 0.35e0, 0e0, 0e0, 0e0, 0e0, 0e0, 0e0, 0e0]"
_SEEN = f"""o AS (SELECT CAST(o_orderkey AS BIGINT) AS k, j FROM orders CROSS JOIN (VALUES (0), (1), (2)) t(j)),
    b AS (SELECT k, j, {', '.join(f'CASE WHEN (k + j) % 7 <> 0 THEN CAST({_EPOCHS[x]} AS DOUBLE) END AS {n}' for n, x in _E.items())} FROM o),
    a AS (SELECT k, {', '.join(_PLACE)}, {', '.join(f'avg({n}) FILTER (j < 2) AS {n}' if n in _MEAN else f'max({n}) FILTER (j = 2) AS {n}' if n in _LATEST else f'arg_max({n}, j) FILTER ({n} IS NOT NULL) AS {n}' for n in _E)} FROM b GROUP BY k),
    m AS (SELECT *, CASE WHEN bsa IS NOT NULL AND wsa IS NOT NULL THEN greatest(0, least(1, (bsa + wsa) / 2000)) END AS albedo, CASE WHEN pop IS NOT NULL THEN greatest(pop, 0) END AS population, least(built / 10000, 1) AS lp FROM a),
    f AS (SELECT *, CASE WHEN lp > 0.1 THEN greatest(dsm - dem, 0) WHEN anbh IS NOT NULL THEN greatest(anbh, 0) END AS bh FROM m),
    y AS (SELECT *, CASE WHEN bh IS NOT NULL THEN least(lp * bh / (bh + 10), 1) END AS lf, coalesce(lp / greatest(1 - lp, 0.05e0) * (bh / 30 + 0.5), CASE WHEN z <= 17 THEN {_ZONE_HW}[CAST(z AS INT)] END) AS hw,
        greatest(0, least(0.99e0, 1 + power(4.43e0, -lp) * (lp - 1))) AS zd,
        lead(elevation) OVER r - lag(elevation) OVER r AS dx, lead(elevation) OVER c - lag(elevation) OVER c AS dy, quantile_cont(ntl, 0.98) OVER () AS pn, quantile_cont(population, 0.98) OVER () AS pp, quantile_cont(vol, 0.98) OVER () AS pv
        FROM f WINDOW r AS (PARTITION BY row ORDER BY col), c AS (PARTITION BY col ORDER BY row))"""
_VALUE = {
    "albedo": "albedo", "et": "et * 0.1e0", "population": "population", "nightlights": "ntl", "building_volume": "vol", "aod": "CAST(NULL AS DOUBLE)", "no2": "CAST(NULL AS DOUBLE)",
    "plan_area_frac": "lp", "building_height": "bh", "frontal_area_index": "lf", "aspect_ratio": "hw", "svf": "1 / sqrt(1 + 4 * hw * hw)",
    "roughness_length": "CASE WHEN lf IS NULL THEN 0.03e0 ELSE (1 - zd) * exp(-1 / sqrt(greatest(0.6e0 / (0.4e0 * 0.4e0) * (1 - zd) * lf, 1e-6))) * bh END",
    "displacement_height": "coalesce(zd * bh, 0)", "elevation": "elevation", "slope": "degrees(atan(sqrt(dx * dx + dy * dy) / 200))",
    "anthro_heat": "150 * (0.5e0 * least(1, coalesce(ntl, 0) / pn) + 0.3e0 * least(1, coalesce(population, 0) / pp) + 0.2e0 * least(1, coalesce(vol, 0) / pv))",
}

ORACLE = {
    "reanalysis_layers": f"""WITH l AS (SELECT CAST(l_orderkey AS BIGINT) AS k, l_linenumber AS j, {_HOUR.format(hours='to_hours(CAST(l_linenumber + l_orderkey % 4 AS INT))')} AS ts FROM lineitem),
        s AS (SELECT * FROM l WHERE ts >= TIMESTAMP '{_START}' AND ts < TIMESTAMP '{_END}'),
        b AS (SELECT k, {', '.join(f'avg({_HOURLY[x]}) FILTER ((k + j) % 7 <> 0) AS {n}' for n, x in _B.items())} FROM s GROUP BY k),
        q AS (SELECT k, ts, {', '.join(f'CASE WHEN (k + j) % 7 <> 0 THEN {_HOURLY[x]} END AS {n}' for n, x in _R.items())} FROM (SELECT DISTINCT k, j, ts FROM s)),
        r AS (SELECT k, {', '.join(f'CASE WHEN lag(ts) OVER w IS NOT NULL THEN CASE WHEN hour(ts) = 1 THEN {n} ELSE {n} - lag({n}) OVER w END / 3600 END AS {n}' for n in _R)} FROM q WINDOW w AS (PARTITION BY k ORDER BY ts)),
        g AS (SELECT k, {', '.join(f'avg({n}) AS {n}' for n in _R)} FROM r GROUP BY k), x AS (SELECT *, t - 273.15e0 AS a, d - 273.15e0 AS e FROM b JOIN g USING (k)),
        y AS (SELECT {', '.join(_PLACE)}, a AS air_temp, e AS dewpoint, CASE WHEN a IS NOT NULL THEN greatest(0, least(100, 100 * exp(17.67e0 * e / (e + 243.5e0) - 17.67e0 * a / (a + 243.5e0)))) END AS rel_humidity, sqrt(u * u + v * v) AS wind_speed,
        p / 1000 AS pressure, solar_radiation, longwave_down, ns + nt AS net_radiation, w AS soil_moisture, h AS pbl_height FROM x)
        SELECT row, col, {', '.join(f'round({c} + {_TIE!r}, 5) AS {c}' for c in products.REANALYSIS.layers)} FROM y""",
    "surface_layers": f"WITH {_SEEN} SELECT row, col, CAST(z AS INT) AS lcz, {', '.join(f'round({x} + {_TIE!r}, 5) AS {n}' for n, x in _VALUE.items())} FROM y",
    "missing_layers": f"""WITH {_SEEN} {' UNION ALL '.join(f"SELECT '{n}' AS layer, count({x}) AS known FROM y" for n, x in (_VALUE | {'lcz': 'z'}).items())}"""
    + "".join(f" UNION ALL SELECT '{n}', 0" for n in ("lst", "lst_uncertainty", "lst_day", "lst_night", *products.REANALYSIS.layers)),
}
