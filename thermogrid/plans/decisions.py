"""Queries on blur, gaps, patches, vulnerability and the choice of measures, each with its SQL where SQL can express it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formulas as M
from ..functions.formulas import exact
from ..operators import measures, portfolio, stats, stencil, tiles, vulnerability
from ..sources.cells import cells, cells_sql
from . import scenarios

_CELLS = f"cells AS ({cells_sql()})"
SIGMA, SWEEPS, PATCH, TOP_K = 1.5, 50, 4, 2000
BUDGET, AREA_CAP = 1e7, 1e6
_VACANT = f"CASE WHEN {M.feasible('vacant')} THEN 1 ELSE 0 END"


_HAVE = ["lst", "population", "ndvi", "albedo", "impervious_frac", "green_frac", "tree_frac", "water_frac", "svf", "soil_moisture", "building_height"]
#: The catalogue's measures, each with its cooling by the linear surface model where it is possible.
MEASURES = [
    portfolio.Measure(m.name, "park_possible" if m.place == "vacant" else M.feasible(m.place), measures.surface_delta(measures.linear_model, measures.changed(m.name, "TRUE", _HAVE)), m.cost_per_m2)
    for m in measures.MEASURES.values()
]


def _round(df: DataFrame, keep: list[str], *values: str) -> DataFrame:
    return df.select(*keep, *[F.round(v, 5).alias(v) for v in values])


def gaussian_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stencil.gaussian_blur(cells(spark, sf_dir).select("row", "col", "ndvi"), "ndvi", SIGMA), ["row", "col"], "blurred")


def gap_fill_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(tiles.gap_fill(cells(spark, sf_dir).select("row", "col", "lst", "ndvi"), "lst", ["ndvi"]), ["row", "col"], "filled")


def gap_fill_diffusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(tiles.gap_fill(cells(spark, sf_dir).select("row", "col", "lst"), "lst", sweeps=SWEEPS), ["row", "col"], "filled")


def large_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = cells(spark, sf_dir).select("row", "col", M.column(_VACANT).alias("vacant"))
    return tiles.large_patches(grid, "vacant", PATCH)


def _indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("row", "col", "lst", "impervious_frac", "ndvi", "population")


def hvi_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(vulnerability.heat_vulnerability(_indicators(spark, sf_dir), "equal"), ["row", "col", "hvi_quintile"], "hvi")


def hvi_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(vulnerability.heat_vulnerability(_indicators(spark, sf_dir)), ["row", "col", "hvi_quintile"], "hvi")


def layered_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = cells(spark, sf_dir).select("row", "col", "lst", "air_temp", "rel_humidity", "dewpoint", "impervious_frac", "ndvi", "population")
    return _round(vulnerability.layered_hotspots(grid), ["row", "col", "hotspot_mask", "moran_local", "priority_class"], "surface_score", "human_stress_score", "hvi", "priority_score")


def weighed_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.priority_score(stats.equity_weights(cells(spark, sf_dir).select("row", "col", *_HAVE)))


def ranked_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = measures.possible(cells(spark, sf_dir).select("row", "col", *_HAVE), "urban_park", "park_possible")
    return stats.priority_score(stats.equity_weights(grid))


def _ranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    grid = ranked_grid(spark, sf_dir)
    return grid, portfolio.candidates(grid, MEASURES, top_k=TOP_K)


def measure_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_ranked(spark, sf_dir)[1], ["row", "col", "intervention", "cost", "area_m2"], "self_delta_c", "rank_key")


def _portfolio(spark: SparkSession, sf_dir: str) -> portfolio.Portfolio:
    grid, chosen = _ranked(spark, sf_dir)
    return portfolio.Portfolio(chosen, grid)


def portfolio_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _portfolio(spark, sf_dir)
    return p.placements(p.greedy(BUDGET, AREA_CAP))


def portfolio_knapsack(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _portfolio(spark, sf_dir)
    return p.placements(p.knapsack(BUDGET, AREA_CAP))


def portfolio_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _portfolio(spark, sf_dir).front(BUDGET, AREA_CAP)


QUERIES = {f.__name__: f for f in (gaussian_blur, gap_fill_regression, gap_fill_diffusion, large_patches, hvi_equal, hvi_pca, layered_hotspots, measure_candidates, portfolio_greedy, portfolio_knapsack, portfolio_front)}

_REACH = int(4 * SIGMA + 0.5)
_W = [math.exp(-0.5 * (o / SIGMA) ** 2) for o in range(-_REACH, _REACH + 1)]
_TAPS = ", ".join(f"({o}, {w / sum(_W)!r}e0)" for o, w in zip(range(-_REACH, _REACH + 1), _W, strict=True)).replace("e-05e0", "e-05").replace("e-06e0", "e-06")
_Z = lambda c: f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()"
_COSTS = {"urban_trees": 12, "green_roof": 120, "cool_roof": 5, "cool_pavement": 25, "permeable_pavement": 25, "water_body": 120, "urban_park": 120, "green_wall": 120, "increase_albedo": 12}
_PARK = scenarios.ORACLE["feasibility_urban_park"]


def _option(k: int, name: str) -> str:
    a = scenarios._after(name, "true")
    cooling = scenarios._cut(f"(12 * (impervious_frac - {a['impervious_frac']}) - 8 * (ndvi - {a['ndvi']}) - 10 * (albedo - {a['albedo']}))")
    return f"SELECT row, col, priority, {k} AS measure_no, '{name}' AS intervention, {_COSTS[name]}e4 AS cost, CASE WHEN {scenarios._ON.get(name, 'possible = 1')} THEN CAST({cooling} AS DOUBLE) END AS d FROM p"


_OPTIONS = " UNION ALL ".join(_option(k, n) for k, n in enumerate(_COSTS))

ORACLE = {
    "gaussian_blur": f"""WITH {_CELLS}, o(d, w) AS (VALUES {_TAPS}), b AS (SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM cells),
        x AS (SELECT c.row, c.col, sum(w * CAST(s.ndvi AS DOUBLE)) AS v FROM cells c CROSS JOIN b CROSS JOIN o JOIN cells s ON s.row = greatest(r0, least(r1, c.row + d)) AND s.col = c.col GROUP BY ALL)
        SELECT c.row, c.col, round(sum(w * s.v), 5) AS blurred FROM cells c CROSS JOIN b CROSS JOIN o JOIN x s ON s.col = greatest(c0, least(c1, c.col + d)) AND s.row = c.row GROUP BY ALL""",
    "gap_fill_regression": f"""WITH {_CELLS}, f AS (SELECT regr_slope(lst, ndvi) AS s, regr_intercept(lst, ndvi) AS i FROM cells)
        SELECT row, col, round(coalesce(lst, s * ndvi + i), 5) AS filled FROM cells CROSS JOIN f""",
    "gap_fill_diffusion": f"""WITH RECURSIVE {_CELLS}, r AS (
        SELECT 0 AS step, row, col, lst IS NULL AS gap, CAST(coalesce(lst, (SELECT avg(lst) FROM cells)) AS DOUBLE) AS v FROM cells
        UNION ALL SELECT step + 1, row, col, gap, CASE WHEN gap THEN (coalesce(lead(v) OVER c, v) + coalesce(lag(v) OVER c, v) + coalesce(lead(v) OVER l, v) + coalesce(lag(v) OVER l, v)) / 4e0 ELSE v END
        FROM r WHERE step < {SWEEPS} WINDOW c AS (PARTITION BY col ORDER BY row), l AS (PARTITION BY row ORDER BY col))
        SELECT row, col, round(v, 5) AS filled FROM r WHERE step = {SWEEPS}""",
    "hvi_equal": f"""WITH {_CELLS}, z AS (SELECT row, col, {_Z('lst')} AS a, {_Z('impervious_frac')} AS b, -({_Z('ndvi')}) AS c, {_Z('population')} AS p FROM cells),
        d AS (SELECT row, col, (coalesce(a, 0) + b + c) / ((a IS NOT NULL)::INT + 2) AS e, p, c FROM z),
        s AS (SELECT row, col, (coalesce({_Z('e')}, 0) + {_Z('p')} + {_Z('c')}) / 3 AS s FROM d),
        h AS (SELECT row, col, (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) AS h FROM s), q AS (SELECT quantile_cont(h, [0.2, 0.4, 0.6, 0.8]) AS e FROM h)
        SELECT row, col, 1 + (h > e[1])::INT + (h > e[2])::INT + (h > e[3])::INT + (h > e[4])::INT AS hvi_quintile, round(h, 5) AS hvi FROM h CROSS JOIN q""",
    "measure_candidates": f"""WITH {_CELLS}, t AS (SELECT avg(greatest(population, 0)) AS m, quantile_cont(lst, [0.05, 0.95]) AS q FROM cells),
        p AS (SELECT cells.*, CASE WHEN lst IS NOT NULL THEN greatest(0, least(1, (lst - q[1]) / (q[2] - q[1]))) * (greatest(population, 0) / m) END AS priority, possible FROM cells CROSS JOIN t JOIN ({_PARK}) USING (row, col)),
        a AS ({_OPTIONS}), k AS (SELECT *, row_number() OVER (ORDER BY priority * d DESC NULLS LAST, measure_no, row, col) AS k FROM a WHERE d > 1e-3)
        SELECT row, col, intervention, cost, 10000e0 AS area_m2, round(d, 5) AS self_delta_c, round(priority * d, 5) AS rank_key FROM k WHERE k <= {TOP_K}""",
}
