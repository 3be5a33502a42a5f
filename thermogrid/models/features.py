"""Predictors, feature tables and spatial blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import stats
from ..sources.grid import layers_of, scramble

# The usual predictors of surface temperature.
PREDICTORS = ("ndvi", "albedo", "impervious_frac", "green_frac", "water_frac", "tree_frac", "building_height", "svf", "elevation", "air_temp", "solar_radiation", "soil_moisture", "anthro_heat", "emissivity")
# Families of drivers.
FAMILIES = {
    "lulc": ("lulc", "impervious_frac", "green_frac", "water_frac", "tree_frac", "lcz"),
    "morphology": ("building_height", "building_volume", "svf", "aspect_ratio", "plan_area_frac", "frontal_area_index", "roughness_length", "elevation", "slope"),
    "vegetation": ("ndvi", "evi", "savi", "lai", "fvc", "et", "albedo", "emissivity"),
    "atmosphere": ("air_temp", "dewpoint", "rel_humidity", "wind_speed", "solar_radiation", "net_radiation", "soil_moisture", "aod", "anthro_heat"),
}
# Drivers that cool when they grow, and those that warm.
COOLING = ("albedo", "ndvi", "evi", "savi", "lai", "fvc", "et", "green_frac", "tree_frac", "water_frac", "ndwi", "mndwi", "emissivity", "svf", "wind_speed", "roughness_length", "soil_moisture", "rel_humidity", "elevation")
WARMING = (
    "impervious_frac", "ndbi", "ndbai", "ui", "plan_area_frac", "frontal_area_index", "building_height", "building_volume", "aspect_ratio", "anthro_heat", "nightlights", "population", "no2",
    "solar_radiation", "longwave_down", "air_temp", "dewpoint", "net_radiation",
)
SIGNS = {**{k: -1 for k in COOLING}, **{k: 1 for k in WARMING}}


def signs(predictors: list[str]) -> dict[str, int]:
    """Which way the energy balance lets a driver move the surface temperature: -1, 1, or 0 where it does not say."""
    return {p: SIGNS.get(p, 0) for p in predictors}


def resolve(grid: DataFrame, predictors: list[str] | None = None, target: str = "lst") -> list[str]:
    """The wanted predictors that the grid has, each once, in order, without the target."""
    have = set(layers_of(grid))
    return [p for p in dict.fromkeys(predictors if predictors is not None else PREDICTORS) if p in have and p != target]


def feature_table(
    grid: DataFrame, predictors: list[str] | None = None, target: str | None = "lst", drop_gaps: bool = True, impute: str | None = None, standardise: bool = False, most: int | None = None, seed: int = 0
) -> DataFrame:
    """row, col, (x, y,) predictors and target as doubles, one row per cell.

    ``drop_gaps`` leaves out rows with a gap; ``impute`` fills gaps that are left by the column's median or mean (0 in a
    column of gaps); ``most`` keeps that many rows, the same ones for the same seed; ``standardise`` gives predictors
    mean 0 and deviation 1 (a constant one becomes 0).
    """
    names = resolve(grid, predictors, target or "")
    wanted = [*names, *([target] if target and target in grid.columns else [])]
    out = grid.select("row", "col", *[c for c in ("x", "y") if c in grid.columns], *[F.col(n).cast("double").alias(n) for n in wanted])
    if drop_gaps:
        out = out.dropna(subset=wanted) if wanted else out
    if impute == "mean":
        means = out.agg(*[F.avg(n).alias(n) for n in names]).first()
        out = out.fillna({n: means[n] if means[n] is not None else 0.0 for n in names})
    elif impute == "median":
        out = out.fillna({n: m if (m := stats.quantiles(out, n, [0.5])[0]) is not None else 0.0 for n in names})
    elif impute is not None:
        raise ValueError(f"unknown way to fill gaps: {impute}")
    if most is not None:
        out = out.orderBy(F.expr(scramble(seed)), "row", "col").limit(most)
    if standardise and names:
        s = out.agg(*[f(n).alias(f"{k}_{n}") for n in names for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        out = out.withColumns({n: (F.col(n) - F.lit(s[f"m_{n}"])) / F.lit(s[f"s_{n}"] or 1.0) for n in names})
    return out


def blocks(table: DataFrame, n: int = 10, size: float | None = None, x: str = "col", y: str = "row", out: str = "block") -> DataFrame:
    """Adds the number of the square block of each row: ``n`` blocks along each axis, or blocks of side ``size``."""
    s = table.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()
    if s["x0"] is None:
        return table.withColumn(out, F.lit(None).cast("long"))
    width, height = (max(float(s[f"{a}1"] - s[f"{a}0"]), 1e-9) for a in ("x", "y"))
    sx, sy = (size, size) if size else (width / n, height / n)
    columns = int(width / sx) + 1
    ix, iy = F.floor((F.col(x) - F.lit(s["x0"])) / F.lit(float(sx))), F.floor((F.col(y) - F.lit(s["y0"])) / F.lit(float(sy)))
    return table.withColumn(out, (iy * columns + ix).cast("long"))


def block_hash(seed: int, block: str = "block") -> str:
    return scramble(seed, block, f"({block} + 1)")


def folds(table: DataFrame, splits: int = 5, size: float | None = None, seed: int = 0, x: str = "col", y: str = "row") -> DataFrame:
    """Adds block and fold: whole blocks are dealt to folds in the order of their hash, so a block is in one fold only.

    With a ``size`` there is no bound on the number of blocks: each goes to the fold that its hash leaves as a remainder.
    """
    if size:
        return blocks(table, 1, size, x, y).withColumn("fold", (F.expr(block_hash(seed)) % splits).cast("int"))
    marked = blocks(table, max(3 * splits, 6), size, x, y)
    # the number of blocks is that of the tiling, whatever the number of cells
    listed = [r[0] for r in marked.select("block").distinct().orderBy(F.expr(block_hash(seed)), "block").collect() if r[0] is not None]
    fold = F.create_map(*[F.lit(v) for i, b in enumerate(listed) for v in (b, i % splits)])[F.col("block")] if listed else F.lit(None)
    return marked.withColumn("fold", fold.cast("int"))


def spatial_split(table: DataFrame, test_share: float = 0.25, n: int = 10, size: float | None = None, seed: int = 0, x: str = "col", y: str = "row") -> DataFrame:
    """Adds is_test: about ``test_share`` of the blocks, at least one and not all, are for the test.

    With a ``size`` a block is for the test if its hash lies in the lowest ``test_share`` of all hashes.
    """
    if size:
        return blocks(table, 1, size, x, y).withColumn("is_test", F.expr(block_hash(seed)) < F.lit(65521 * test_share))
    marked = blocks(table, n, size, x, y)
    listed = [r[0] for r in marked.select("block").distinct().orderBy(F.expr(block_hash(seed)), "block").collect() if r[0] is not None]
    test = listed[: max(1, min(len(listed) - 1, round(test_share * len(listed))))]
    return marked.withColumn("is_test", F.col("block").isin(test))
