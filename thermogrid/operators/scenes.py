"""Scene tables: sensors' scales and masks, cloud filters and joins, sharpening, downscaling, proxies.

A scene table is long: sensor, scene_id, ts, cloud_pct, row, col, bands.  Filters on time, cloud and place come first,
so that they reach the scan; masks and scales are one projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fusion, stats, stencil

CELL = ["row", "col"]


@dataclass(frozen=True)
class Sensor:
    """Scale and offset from stored numbers to kelvin (or reflectance), the band, which bits or values of qa are bad, and sigma (degC)."""

    band: str
    scale: float
    offset: float
    qa: str
    sigma: float


# Thermal bands of sensors; qa rules as bit masks (Landsat) or the lowest two bits (others).
SENSORS = {
    "landsat": Sensor("st_b10", 0.00341802, 149.0, "bits", 1.0),
    "MOD11A1": Sensor("lst_day_1km", 0.02, 0.0, "two_bits", 2.5),
    "MYD11A1": Sensor("lst_day_1km", 0.02, 0.0, "two_bits", 2.5),
    "MOD21A1D": Sensor("lst_1km", 0.02, 0.0, "two_bits", 2.5),
    "VNP21A1D": Sensor("lst_1km", 0.02, 0.0, "two_bits", 2.5),
}
# Reflectance scales, and Landsat's bits of dilated cloud (1), cloud (3), shadow (4) and snow (5).
REFLECTANCE = {"landsat": (2.75e-05, -0.2), "sentinel2": (0.0001, 0.0)}
CLOUD_BITS = 0b111010


def clear(qa: Column, rule: str) -> Column:
    """Whether a pixel is clear: no cloud bit, or a lowest pair of bits of 0; a missing flag is not clear."""
    value = qa.cast("long")
    good = value.bitwiseAND(CLOUD_BITS) == 0 if rule == "bits" else value.bitwiseAND(3) == 0
    return F.coalesce(good, F.lit(False))


def filtered(scenes: DataFrame, start: str | None = None, end: str | None = None, most_cloud: float | None = None, cells: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Scenes from ``start`` up to but not including ``end``, below a share of cloud, within rows and columns (r0, c0, r1, c1)."""
    out = scenes if start is None and end is None else fusion.scene_filter(scenes, start or "0001-01-01", end or "9999-12-31")
    if most_cloud is not None:
        out = out.filter(F.col("cloud_pct") < float(most_cloud))
    if cells is not None:
        r0, c0, r1, c1 = cells
        out = out.filter(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))
    return out


def surface_temperature(scenes: DataFrame, sensor: str, out: str = "lst", qa: str = "qa") -> DataFrame:
    """Adds the temperature in degC of clear pixels from a sensor's stored numbers; other pixels are gaps."""
    if sensor not in SENSORS:
        raise KeyError(f"unknown sensor {sensor!r}; known: {', '.join(SENSORS)}")
    s = SENSORS[sensor]
    return scenes.withColumn(out, F.when(clear(F.col(qa), s.qa), F.col(s.band) * s.scale + s.offset - 273.15))


def reflectance(scenes: DataFrame, bands: list[str], family: str = "landsat", qa: str | None = "qa") -> DataFrame:
    """The bands as reflectances; with ``qa``, those of pixels that are not clear become gaps."""
    scale, offset = REFLECTANCE[family]
    good = clear(F.col(qa), "bits") if qa else F.lit(True)
    return scenes.withColumns({b: F.when(good, F.col(b) * scale + offset) for b in bands})


def without_clouds(scenes: DataFrame, clouds: DataFrame, bands: list[str], most: float = 50.0) -> DataFrame:
    """Scenes joined with their cloud probabilities (scene_id, row, col, probability): bands under likely cloud are gaps.

    Scenes without probabilities are left out; of several for a pixel, the largest counts.
    """
    p = clouds.groupBy("scene_id", *CELL).agg(F.max("probability").alias("_p"))
    x = scenes.join(p, ["scene_id", *CELL])
    return x.withColumns({b: F.when(F.col("_p") < most, F.col(b)) for b in bands}).drop("_p")


def filled_from(grid: DataFrame, layer: str, fallbacks: list[str], radius: int = 0, out: str = "filled") -> DataFrame:
    """Adds ``out``: the layer, else the first of the fallbacks that is known, else the mean of the cells within ``radius``."""
    x = grid.withColumn(out, F.coalesce(*[F.col(c).cast("double") for c in (layer, *fallbacks)]))
    if radius <= 0:
        return x
    x = stencil.square_sums(x, radius, _sum=F.col(out), _n=F.when(F.col(out).isNotNull(), 1.0))
    return x.withColumn(out, F.coalesce(out, F.col("_sum") / F.nullif("_n", F.lit(0.0)))).drop("_sum", "_n")


def sharpened(grid: DataFrame, coarse: str = "lst", predictor: str = "ndvi", size: int = 10, out: str = "sharp") -> DataFrame:
    """Adds ``out``: a coarse layer brought to single cells by its regression on a fine predictor.

    The line is fitted on means over blocks of ``size`` by ``size`` cells and used on cells; what it leaves of each
    block's mean is added back, so that the mean of a block over its known cells stays what it was.
    """
    place = {"_br": F.floor(F.col("row") / size), "_bc": F.floor(F.col("col") / size)}
    x = grid.withColumns(place)
    both = F.col(coarse).isNotNull() & F.col(predictor).isNotNull()
    means = x.groupBy("_br", "_bc").agg(F.avg(F.when(both, F.col(coarse))).alias("_y"), F.avg(F.when(both, F.col(predictor))).alias("_x"))
    fit = means.agg(F.regr_slope("_y", "_x").alias("s"), F.regr_intercept("_y", "_x").alias("i"), F.avg("_y").alias("m")).first()
    slope, base = (fit["s"], fit["i"]) if fit["s"] is not None else (0.0, fit["m"] or 0.0)
    guess = F.col(predictor) * F.lit(slope) + F.lit(base)
    rest = means.select("_br", "_bc", (F.col("_y") - (F.col("_x") * F.lit(slope) + F.lit(base))).alias("_rest"))
    return x.join(rest, ["_br", "_bc"], "left").withColumn(out, guess + F.coalesce("_rest", F.lit(0.0))).drop("_br", "_bc", "_rest")


def downscaled_air(grid: DataFrame, air: str = "air_temp", surface: str = "lst", out: str = "air_fine") -> DataFrame:
    """Adds ``out``: coarse air temperature with the structure of fine layers.

    0.3 of the surface's deviation from its mean, 1.5 less for each unit of ndvi, 1 more for sealed ground, 6.5 less for
    each kilometre above the mean; layers that the grid lacks take no part, gaps in ndvi and sealed ground count as 0.
    """
    means = [F.avg(surface).alias("_ms"), *([F.avg("elevation").alias("_me")] if "elevation" in grid.columns else [])]
    x = stats.with_scalars(grid, *means)
    d = (F.col(surface) - F.coalesce("_ms", F.lit(0.0))) * 0.30
    if "ndvi" in grid.columns:
        d = d - 1.5 * F.coalesce("ndvi", F.lit(0.0))
    if "impervious_frac" in grid.columns:
        d = d + F.coalesce("impervious_frac", F.lit(0.0))
    if "elevation" in grid.columns:
        d = d - 0.0065 * (F.col("elevation") - F.coalesce("_me", F.lit(0.0)))
    return x.withColumn(out, F.col(air) + d).drop("_ms", "_me")


def heat_proxy(grid: DataFrame, out: str = "anthro_heat", parts: dict[str, float] | None = None, top: float = 150.0) -> DataFrame:
    """Adds ``out`` (W/m2): lights, people and built volume, each over its 98th percentile (cut to 0 and 1), weighted."""
    parts = parts or {"nightlights": 0.5, "population": 0.3, "building_volume": 0.2}
    have = [n for n in parts if n in grid.columns]
    total = F.lit(0.0)
    for name, (p,) in zip(have, stats.quantile_sets(grid, [stats.Wanted(n, [0.98]) for n in have]), strict=True):
        total = total + parts[name] * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(name, F.lit(0.0)) / F.lit(p if p and p > 0 else 1.0)))
    return grid.withColumn(out, total * top)


def fused_sensors(scenes: dict[str, DataFrame], reducer: str = "median") -> DataFrame:
    """row, col, fused, fused_sigma: each sensor's clear scenes reduced over time, then weighted by the sensors' variances."""
    parts = None
    for sensor, table in scenes.items():
        one = fusion.composite(surface_temperature(table, sensor), CELL, "lst", "ts", reducer)
        one = one.select(*CELL, F.lit(sensor).alias("source"), F.col("lst").alias("value"), F.lit(SENSORS[sensor].sigma).alias("sigma"))
        parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        raise ValueError("no sensor given")
    return fusion.inverse_variance(parts)


def weighted_mean(estimates: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """row, col, fused, fused_sigma: mean by the sources' weights (equal ones by default) and its weighted spread; gaps take no part."""
    w = F.lit(1.0)
    if weights:
        w = F.coalesce(F.create_map(*[F.lit(v) for p in weights.items() for v in p])[F.col("source")], F.lit(0.0))
    w = F.when(F.col("value").isNotNull() & ~F.isnan("value"), w)
    g = estimates.withColumn("_w", w).groupBy(*CELL).agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("value")).alias("a"), F.sum(F.col("_w") * F.col("value") ** 2).alias("b"))
    mean = F.col("a") / F.nullif("w", F.lit(0.0))
    return g.select(*CELL, mean.alias("fused"), F.sqrt(F.greatest(F.col("b") / F.nullif("w", F.lit(0.0)) - mean**2, F.lit(0.0))).alias("fused_sigma"))


def monte_carlo(grid: DataFrame, value, sigmas: dict[str, float], n: int = 100, seed: int = 0) -> DataFrame:
    """row, col, mean, spread of a formula under Gaussian errors of its layers.

    ``value`` is SQL over the layers.  Each cell is drawn ``n`` times by hashes of its place, the layer and the number
    of the draw, so a repeated task draws the same; one aggregate with partial sums collects them.
    """
    x = grid.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(n))))
    unit = lambda tag: (F.pmod(F.xxhash64("row", "col", "_k", F.lit(tag), F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    noisy = {k: F.col(k) + s * F.sqrt(-2.0 * F.log(unit(f"{k}/a"))) * F.cos(6.283185307179586 * unit(f"{k}/b")) for k, s in sigmas.items()}
    drawn = x.withColumns(noisy).select(*CELL, F.expr(value).cast("double").alias("_v"))
    return drawn.groupBy(*CELL).agg(F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("spread"))
