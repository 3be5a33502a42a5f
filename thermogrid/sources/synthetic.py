"""A synthetic city as a table of cells: the same seed gives the same city, whatever the number of partitions.

Every layer is an expression over row and column, so a grid of any size is a ``spark.range`` and one projection.
Noise is value noise: whole-number arithmetic gives each lattice point a number, and cells between are interpolated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, Geometry
from ..functions import formulas as M
from ..functions.formulas import clip, exact
from ..operators.stats import with_scalars
from .cells import with_coordinates
from .products import load_observations

_PRIME = 65521


def lattice(r: str, c: str, seed: int) -> str:
    """A number from 0 to 1 for a lattice point, by whole-number arithmetic (equal in every engine)."""
    a = f"(({r}) * 7349 + ({c}) * 9151 + {seed * 1237 + 17}) % {_PRIME}"
    b = f"(({a}) * ({a}) + 31 * ({r}) + 7) % {_PRIME}"
    return f"((({b}) * (({b}) + 13) + 17 * ({c})) % {_PRIME} / {float(_PRIME)})"


def noise(step: int, seed: int) -> str:
    """Value noise from 0 to 1 with lattice points ``step`` cells apart, smooth between them."""
    r, c = f"CAST(floor(row / {float(step)}) AS BIGINT)", f"CAST(floor(col / {float(step)}) AS BIGINT)"
    ease = lambda a: f"({a} * {a} * (3.0 - 2.0 * {a}))"
    u, v = ease(f"((row % {step}) / {float(step)})"), ease(f"((col % {step}) / {float(step)})")
    line = lambda rr: f"({lattice(rr, c, seed)} * (1.0 - {v}) + {lattice(rr, f'{c} + 1', seed)} * {v})"
    return f"({line(r)} * (1.0 - {u}) + {line(f'{r} + 1')} * {u})"


def bump(y: float, x: float, width: float, rows: int, cols: int) -> str:
    """A Gaussian hill, its centre and width as shares of the grid."""
    s = max(1.0, width * (rows**2 + cols**2) ** 0.5)
    return f"exp(-(power(row - {y * rows!r}, 2) + power(col - {x * cols!r}, 2)) / {2 * s * s!r})"


def layers(rows: int, cols: int, seed: int) -> list[dict[str, str]]:
    """Steps of layer to SQL; a step reads the layers of the steps before it."""
    side = min(rows, cols)
    far, mid, near = max(8, side // 3), max(4, side // 8), 3
    river = f"abs(col / {float(cols)} - 0.3 - 0.1 * sin(8.0 * row / {float(rows)}))"
    hills = ", ".join(f"{w} * {bump(y, x, s, rows, cols)}" for y, x, s, w in ((0.5, 0.48, 0.16, 1.0), (0.3, 0.3, 0.08, 0.7), (0.68, 0.66, 0.08, 0.7), (0.4, 0.75, 0.08, 0.6)))
    return [
        {"region": noise(far, seed + 1), "texture": f"(0.7 * {noise(mid, seed + 2)} + 0.3 * {noise(near, seed + 3)})", "water_frac": clip(f"1.4 - 45.0 * {river}", 0.0, 1.0), "park": f"CASE WHEN {noise(mid, seed + 4)} > 0.78 THEN 1.0 ELSE 0.0 END"},
        {"urban": f"(CASE WHEN water_frac > 0.25 THEN 0.05 ELSE 1.0 END) * {clip(f'0.65 * greatest({hills}) + 0.35 * texture', 0.0, 1.0)}", "elevation": "180.0 + 60.0 * region - 20.0 * water_frac"},
        {"impervious_frac": clip("0.9 * urban * (1.0 - 0.85 * park) * (1.0 - water_frac)", 0.0, 0.95)},
        {"green_frac": clip("(1.0 - impervious_frac - water_frac) * (0.35 + 0.45 * texture + 0.2 * park)", 0.0, 1.0)},
        {"tree_frac": clip("green_frac * (0.25 + 0.5 * park + 0.2 * texture)", 0.0, 0.9), "bare": clip("1.0 - impervious_frac - green_frac - water_frac", 0.0, 1.0), "building_height": "CASE WHEN water_frac > 0.25 OR park = 1.0 THEN 0.0 ELSE 40.0 * power(urban, 1.4) + 5.0 * urban END"},
        {
            "ndvi": clip("-0.05 + 0.9 * green_frac - 0.2 * impervious_frac - 0.25 * water_frac", -0.4, 0.9),
            "ndbi": clip("-0.25 + 0.85 * impervious_frac - 0.45 * green_frac", -0.5, 0.7),
            "ndwi": clip("-0.3 + 1.4 * water_frac - 0.2 * impervious_frac", -0.4, 0.9),
            "albedo": clip("0.13 * impervious_frac + 0.18 * green_frac + 0.30 * bare + 0.07 * water_frac + 0.02 * texture", 0.05, 0.45),
            "soil_moisture": clip("0.10 + 0.4 * green_frac + 0.45 * water_frac - 0.08 * impervious_frac", 0.03, 0.6),
            "plan_area_frac": "0.85 * impervious_frac",
            "population": "CASE WHEN water_frac > 0.25 THEN 0.0 ELSE round(3500.0 * power(urban, 1.3) * (1.0 - 0.9 * park)) END",
            "nightlights": clip("50.0 * urban + 8.0 * impervious_frac", 0.5, 70.0),
        },
        {
            "evi": clip("0.9 * ndvi * (1.0 - 0.2 * greatest(ndvi, 0.0))", -0.4, 0.8),
            "savi": clip("1.05 * ndvi", -0.4, 0.9),
            "fvc": M.fvc_clip_then_square("ndvi"),
            "svf": clip("1.0 - 0.78 * plan_area_frac - 0.003 * building_height", 0.18, 1.0),
            "frontal_area_index": clip("plan_area_frac * building_height / 30.0", 0.0, 1.2),
            "building_volume": "building_height * plan_area_frac * 10000.0",
            "aspect_ratio": clip("0.1 + 2.6 * plan_area_frac * building_height / 30.0", 0.0, 3.5),
            "anthro_heat": clip("0.01 * population + 0.55 * nightlights", 0.0, 90.0),
            "lulc": "CASE WHEN water_frac > 0.25 THEN 1.0 WHEN tree_frac > 0.4 THEN 2.0 WHEN green_frac > 0.4 THEN 3.0 WHEN bare > 0.4 THEN 4.0 ELSE 5.0 END",
            "lcz": "CASE WHEN water_frac > 0.25 THEN 17.0 WHEN bare > 0.5 THEN 16.0 WHEN green_frac > 0.4 AND tree_frac <= 0.5 THEN 14.0 WHEN tree_frac > 0.5 THEN 11.0 WHEN impervious_frac > 0.6 AND building_height > 30.0 THEN 1.0 WHEN impervious_frac > 0.55 AND building_height > 17.0 THEN 2.0 WHEN impervious_frac > 0.4 AND building_height > 8.0 THEN 3.0 ELSE 6.0 END",
        },
        {
            "lai": clip("5.0 * fvc + 0.4 * tree_frac", 0.0, 6.0),
            "et": clip("40.0 * fvc * least(soil_moisture / 0.4, 1.0) + 90.0 * water_frac", 0.0, 130.0),
            "emissivity": "CASE WHEN water_frac > 0.25 THEN 0.992 ELSE 0.96 + 0.025 * fvc END",
            "roughness_length": clip("0.03 + 0.9 * frontal_area_index * building_height / 30.0", 0.01, 2.5),
            "displacement_height": "0.6 * building_height * plan_area_frac",
            "aod": clip("0.25 + 0.45 * urban + 0.1 * (region - 0.5)", 0.05, 0.9),
            "air_temp": "31.0 + 3.0 * (region - 0.5) + 1.8 * urban - 0.8 * green_frac - 0.0045 * (elevation - 180.0)",
            "dewpoint": clip("18.0 + 4.0 * (region - 0.5) + 3.0 * water_frac + 1.5 * green_frac - 1.5 * impervious_frac", 8.0, 26.0),
            "pressure": clip("101.3 - 0.0115 * elevation", 95.0, 102.0),
            "no2": "0.00002 + 0.00013 * anthro_heat / 90.0 + 0.00004 * impervious_frac",
        },
        {
            "rel_humidity": clip(f"100.0 * {M.saturation_vapour_pressure('dewpoint')} / {M.saturation_vapour_pressure('air_temp')}", 10.0, 95.0),
            "wind_speed": clip("4.5 - 2.6 * plan_area_frac - roughness_length + 1.2 * water_frac", 0.4, 8.0),
            "solar_radiation": clip("880.0 * (1.0 - 0.18 * aod)", 450.0, 950.0),
            "longwave_down": clip("5.31e-13 * power(air_temp + 273.15, 6)", 300.0, 460.0),
            "pbl_height": clip("900.0 + 1400.0 * urban - 500.0 * green_frac + 300.0 * (region - 0.5)", 300.0, 2800.0),
        },
        {"net_radiation": clip(M.net_radiation("albedo", "solar_radiation", "longwave_down", "emissivity", "air_temp"), 50.0, 800.0)},
    ]


#: How a unit of a driver moves the surface temperature of the synthetic city; the signs are those of the energy balance.
RESPONSE = {"impervious_frac": 9.0, "ndbi": 4.0, "anthro_heat": 0.06, "building_height": 0.04, "ndvi": -6.0, "tree_frac": -5.0, "green_frac": -4.0, "water_frac": -12.0, "albedo": -18.0, "et": -0.05, "wind_speed": -0.3, "svf": -5.0}


def surface_temperature(seed: int) -> dict[str, str]:
    """The surface temperature by day and night and its uncertainty; ``_elev`` and ``_lights`` are scalars of the grid."""
    pushes = " + ".join(f"({w!r}) * {k}" for k, w in RESPONSE.items())
    lst = f"(air_temp + 18.0 + {pushes} - 0.0045 * (elevation - _elev) + 1.2 * ({noise(2, seed + 5)} - 0.5))"
    night = clip("8.0 - 3.5 * (1.0 - svf) - 2.5 * nightlights / _lights", 1.0, 9.0)
    return {"lst": lst, "lst_day": lst, "lst_night": f"({lst} - {night})", "lst_uncertainty": f"(0.6 + 0.4 * {noise(3, seed + 6)})"}


_HELPERS = ("region", "texture", "park", "urban", "bare")
NAMES = [k for step in layers(24, 24, 0) for k in step if k not in _HELPERS] + list(surface_temperature(0))


def synthetic_cells(spark: SparkSession, rows: int, cols: int, seed: int = 0) -> DataFrame:
    """row, col and all layers of a city of ``rows`` by ``cols`` cells."""
    n = spark.range(rows * cols)
    grid = n.select((F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    for step in layers(rows, cols, seed):
        grid = grid.withColumns({k: F.expr(exact(v)) for k, v in step.items()})
    grid = with_scalars(grid, F.avg("elevation").alias("_elev"), F.max("nightlights").alias("_lights"))
    return grid.withColumns({k: F.expr(exact(v)) for k, v in surface_temperature(seed).items()}).select("row", "col", *NAMES)


def synthetic_sql(rows: int, cols: int, seed: int = 0) -> str:
    """The same as SQL for another engine, from a table of numbers that its range function gives."""
    text = f"SELECT CAST(i // {cols} AS INT) AS row, CAST(i % {cols} AS INT) AS col FROM range({rows * cols}) t(i)"
    for step in layers(rows, cols, seed):
        text = f"SELECT *, {', '.join(f'{exact(v)} AS {k}' for k, v in step.items())} FROM ({text})"
    text = f"SELECT *, avg(elevation) OVER () AS _elev, max(nightlights) OVER () AS _lights FROM ({text})"
    last = surface_temperature(seed)
    return f"SELECT row, col, {', '.join(n for n in NAMES if n not in last)}, {', '.join(f'{exact(v)} AS {k}' for k, v in last.items())} FROM ({text})"


def load_synthetic(spark: SparkSession, config: Config) -> DataFrame:
    """The grid of a study with x and y of the pixel centres."""
    g = Geometry.of(config)
    return with_coordinates(synthetic_cells(spark, g.rows, g.cols, config.seed), g.transform)


def load_scenes(spark: SparkSession, config: Config, path: str | None = None) -> DataFrame:
    """A grid exported before as Parquet, its path in the data-set switches under ``path`` or given here."""
    if not path:
        raise ValueError("mode 'scenes' needs the path of an exported grid")
    return spark.read.parquet(path)


#: Ways to get a grid, by mode.
SOURCES: dict[str, Callable[..., DataFrame]] = {"synthetic": load_synthetic, "scenes": load_scenes, "observations": load_observations}


def load(spark: SparkSession, config: Config, **options) -> DataFrame:
    """The grid of a study, from the source that its mode names."""
    if config.mode not in SOURCES:
        raise ValueError(f"unknown mode {config.mode!r}; one of {sorted(SOURCES)}")
    return SOURCES[config.mode](spark, config, **options)
