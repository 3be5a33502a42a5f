"""Queries on transfers between grids, land cover over time and vapour classes, each with SQL written on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import landcover, regrid
from ..sources.cells import WIDTH, cells, cells_sql

_CELLS = f"cells AS ({cells_sql()})"
#: Numbers are given with a little added, as engines round exact ties differently.
_TIE = 1.7e-8
_FROM, _TO = (100.0, 0.0, 0.0, 0.0, -100.0, 0.0), (240.0, 0.0, -60.0, 0.0, -170.0, 30.0)


def _frames(grid: DataFrame) -> tuple[regrid.Frame, regrid.Frame]:
    rows = (grid.agg(F.max("row")).first()[0] or 0) + 1
    return regrid.Frame(_FROM, rows, WIDTH), regrid.Frame(_TO, rows * 100 // 170 + 1, 22)


def _regridded(method: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        grid = cells(spark, sf_dir).select("row", "col", "lst", "ndvi")
        out = regrid.regrid(grid, ["lst", "ndvi"], *_frames(grid), method)
        return out.select("row", "col", *[F.round(F.col(c) + _TIE, 5).alias(c) for c in ("lst", "ndvi")])

    return run


def regrid_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = cells(spark, sf_dir).select("row", "col", "population")
    return regrid.by_area(grid, ["population"], *_frames(grid), total=True).select("row", "col", F.round(F.col("population") + _TIE, 5).alias("population"))


#: Scenes of class probabilities behind the orders table: six of each cell, a day apart, by whole-number arithmetic.
_SCENES = "SELECT CAST(floor(o_orderkey / 50e0) AS INT) AS row, CAST(o_orderkey % 50 AS INT) AS col, CAST(k AS INT) AS day, " + ", ".join(
    f"CASE WHEN (CAST(o_orderkey AS BIGINT) + k) % 7 <> 0 THEN CAST(CAST(o_orderkey AS BIGINT) * (11 + 2 * {n}) * (k + 3) % 101 AS DOUBLE) / 404e0 END AS {c}" for n, c in enumerate(landcover.CLASSES)
) + " FROM orders CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS n(k)"


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").createOrReplaceTempView("thermogrid_cover")
    scenes = spark.sql(_SCENES.replace("FROM orders", "FROM thermogrid_cover"))
    scenes = scenes.withColumn("ts", F.expr("TIMESTAMP '2024-03-01 10:00:00' + make_dt_interval(day)"))
    return landcover.class_means(scenes, "2024-03-02", "2024-03-06")


def class_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = landcover.likeliest(_means(spark, sf_dir))
    return m.select("row", "col", "lulc", *[F.round(F.col(c) + _TIE, 5).alias(c) for c in landcover.CLASSES])


def cover_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = landcover.cover_fractions(_means(spark, sf_dir), 4)
    return out.select("row", "col", "known", *[F.round(F.col(c) + _TIE, 5).alias(c) for c in landcover.COVER])


# Sky view and roughness that usually go with a zone.
PRIORS = {1: {"sky": 0.3, "z0": 2.0}, 2: {"sky": 0.45, "z0": 1.0}, 3: {"sky": 0.4, "z0": 0.5}, 6: {"sky": 0.75, "z0": 0.4}, 8: {"sky": 0.9, "z0": 0.25}, 11: {"sky": 0.3, "z0": 2.0}, 14: {"sky": 0.95, "z0": 0.03}, 17: {"sky": 0.98, "z0": 0.0005}}


def zone_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landcover.looked_up(cells(spark, sf_dir).select("row", "col", "lcz"), "lcz", PRIORS)


def vapour_lst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells seen at an hour and minute of their own, with the vapour of the nearest entry of a gappy series behind the events."""
    grid = cells(spark, sf_dir).select("row", "col", "emissivity", (F.col("lst") + 270.0).alias("brightness"))
    seen = grid.withColumn("ts", F.expr("TIMESTAMP '2024-01-02 00:00:00' + make_dt_interval(row % 25, col % 24, row % 60)"))
    series = spark.read.parquet(f"{sf_dir}/events.parquet").filter("hour(ts) % 5 <> 0").groupBy(F.date_trunc("hour", "ts").alias("ts")).agg((F.avg("value") / 3).alias("vapour"))
    x = landcover.nearest_in_time(seen, series, ["vapour"], within_s=5400)
    lst = landcover.statistical_mono_window(F.col("brightness"), F.col("emissivity"), F.col("vapour"))
    return x.select("row", "col", F.round(F.col("vapour") + _TIE, 5).alias("vapour"), F.round(lst + _TIE, 5).alias("lst"))


QUERIES = {f"regrid_{m}": _regridded(m) for m in regrid.METHODS} | {f.__name__: f for f in (regrid_mass, class_means, cover_fractions, zone_priors, vapour_lst)}

_TARGET = "s AS (SELECT max(row) + 1 AS n FROM cells), t AS (SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col FROM (SELECT unnest(range(0, (SELECT n * 100 // 170 + 1 FROM s))) AS r) CROSS JOIN (SELECT unnest(range(0, 22)) AS c))"
#: Source places of a target's edges, in source cells.
_EDGES = "e AS (SELECT row, col, (170e0 * row - 30) / 100 AS r0, (170e0 * (row + 1) - 30) / 100 AS r1, (240e0 * col - 60) / 100 AS c0, (240e0 * (col + 1) - 60) / 100 AS c1 FROM t)"
_OVER = "o AS (SELECT e.row, e.col, (least(r1, s.row + 1) - greatest(r0, s.row)) * (least(c1, s.col + 1) - greatest(c0, s.col)) AS a, s.lst, s.ndvi, s.population FROM e JOIN cells s ON s.row + 1 > r0 AND s.row < r1 AND s.col + 1 > c0 AND s.col < c1)"
_W = lambda p, f, o: f"CASE WHEN {o} = 1 THEN {p} - {f} ELSE 1 - ({p} - {f}) END"
_DAYS = f"p AS ({_SCENES}), m AS (SELECT row, col, {', '.join(f'avg({c}) AS {c}' for c in landcover.CLASSES)} FROM p WHERE day BETWEEN 1 AND 4 GROUP BY row, col)"
_FRACTIONS = {"impervious_frac": "built", "tree_frac": "trees", "green_frac": "trees + grass + shrub_and_scrub + crops", "water_frac": "water + flooded_vegetation"}

ORACLE = {
    "regrid_nearest": f"WITH {_CELLS}, {_TARGET}, {_EDGES} SELECT e.row, e.col, round(lst + {_TIE}, 5) AS lst, round(ndvi + {_TIE}, 5) AS ndvi FROM e LEFT JOIN cells s ON s.row = floor((r0 + r1) / 2) AND s.col = floor((c0 + c1) / 2)",
    "regrid_area": f"""WITH {_CELLS}, {_TARGET}, {_EDGES}, {_OVER}, g AS (SELECT row, col, sum(lst * a) / sum(a) FILTER (lst IS NOT NULL) AS lst, sum(ndvi * a) / sum(a) AS ndvi FROM o WHERE a > 1e-12 GROUP BY ALL)
        SELECT t.row, t.col, round(lst + {_TIE}, 5) AS lst, round(ndvi + {_TIE}, 5) AS ndvi FROM t LEFT JOIN g USING (row, col)""",
    "regrid_bilinear": f"""WITH {_CELLS}, {_TARGET}, {_EDGES}, q AS (SELECT row, col, (r0 + r1) / 2 - 0.5 AS r, (c0 + c1) / 2 - 0.5 AS c FROM e),
        k AS (SELECT q.*, i, j, ({_W('r', 'floor(r)', 'i')}) * ({_W('c', 'floor(c)', 'j')}) AS w FROM q, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)),
        v AS (SELECT k.row, k.col, any_value(r >= -0.5 AND c >= -0.5 AND c < 49.5 AND r < n - 0.5) AS inside, sum(lst * w) / nullif(sum(w) FILTER (lst IS NOT NULL), 0) AS lst, sum(ndvi * w) / nullif(sum(w) FILTER (ndvi IS NOT NULL), 0) AS ndvi
              FROM k CROSS JOIN s LEFT JOIN cells x ON x.row = floor(r) + i AND x.col = floor(c) + j GROUP BY k.row, k.col)
        SELECT row, col, round(CASE WHEN inside THEN lst END + {_TIE}, 5) AS lst, round(CASE WHEN inside THEN ndvi END + {_TIE}, 5) AS ndvi FROM v""",
    "regrid_mass": f"WITH {_CELLS}, {_TARGET}, {_EDGES}, {_OVER}, g AS (SELECT row, col, sum(population * a) AS population FROM o WHERE a > 1e-12 GROUP BY ALL) SELECT t.row, t.col, round(population + {_TIE}, 5) AS population FROM t LEFT JOIN g USING (row, col)",
    "class_means": f"""WITH {_DAYS}, l AS (SELECT *, list_position([{', '.join(landcover.CLASSES)}], greatest({', '.join(landcover.CLASSES)})) - 1 AS code FROM m)
        SELECT row, col, CAST(code AS INT) AS lulc, {', '.join(f'round({c} + {_TIE}, 5) AS {c}' for c in landcover.CLASSES)} FROM l""",
    "cover_fractions": f"WITH {_DAYS} SELECT CAST(floor(row / 4e0) AS INT) AS row, CAST(floor(col / 4e0) AS INT) AS col, count(built) AS known, {', '.join(f'round(avg(least(1, {e})) + {_TIE}, 5) AS {n}' for n, e in _FRACTIONS.items())} FROM m GROUP BY floor(row / 4e0), floor(col / 4e0)",
    "zone_priors": f"WITH {_CELLS}, z(lcz, sky, z0) AS (VALUES (1, 0.3e0, 2e0), (2, 0.45e0, 1e0), (3, 0.4e0, 0.5e0), (6, 0.75e0, 0.4e0), (8, 0.9e0, 0.25e0), (11, 0.3e0, 2e0), (14, 0.95e0, 0.03e0), (17, 0.98e0, 0.0005e0)) SELECT row, col, cells.lcz, sky, z0 FROM cells LEFT JOIN z USING (lcz)",
    "vapour_lst": f"""WITH {_CELLS}, h AS (SELECT date_trunc('hour', ts) AS moment, avg(value) / 3 AS w FROM events WHERE hour(ts) % 5 <> 0 GROUP BY 1),
        g AS (SELECT row, col, emissivity AS e, lst + 270 AS b, TIMESTAMP '2024-01-02 00:00:00' + to_days(CAST(row % 25 AS INT)) + to_hours(col % 24) + to_minutes(row % 60) AS ts FROM cells),
        n AS (SELECT ts, arg_min(w, {{d: abs(epoch(moment) - epoch(ts)), t: moment}}) AS w FROM (SELECT DISTINCT ts FROM g) JOIN h ON abs(epoch(moment) - epoch(ts)) <= 5400 GROUP BY ts),
        k AS (SELECT row, col, e, b, w, CASE WHEN w < 6 THEN [0.9751, -205.8929, 212.7173] WHEN w < 12 THEN [1.0090, -232.2750, 230.5698] WHEN w < 18 THEN [1.0541, -253.1943, 238.9548] WHEN w < 24 THEN [1.1282, -279.4212, 244.0772]
            WHEN w < 30 THEN [1.1987, -307.4497, 251.8341] WHEN w < 36 THEN [1.3205, -348.0228, 257.2740] WHEN w < 42 THEN [1.4540, -393.1718, 263.5599] WHEN w < 48 THEN [1.6350, -451.0790, 268.9405] WHEN w < 54 THEN [1.5468, -429.5095, 275.0895]
            WHEN w >= 54 THEN [1.9403, -547.2681, 277.9953] END::DOUBLE[] AS q FROM g LEFT JOIN n USING (ts))
        SELECT row, col, round(w + {_TIE}, 5) AS vapour, round(q[1] * b / e + q[2] / e + q[3] - 273.15 + {_TIE}, 5) AS lst FROM k""",
}
