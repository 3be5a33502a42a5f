"""Cooling measures: their catalogue, where they are possible, what they change, and how much they cool.

A surface model is a function that gets a function from layer name to SQL and returns SQL for the temperature, so
a change is evaluated by handing the model the changed layers: no second grid, no join, and all of it one projection.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formulas import CLIP, clip, clip_cooling, column, feasible, kelvin
from . import stats, stencil, tiles

Model = Callable[[Callable[[str], str]], str]

# Cost per square metre by band.
COST = {"low": 5.0, "low-med": 12.0, "med": 25.0, "med-high": 60.0, "high": 120.0}
# Values of a layer that the grid does not have.
NEUTRAL = {"tree_frac": 0.0, "green_frac": 0.0, "water_frac": 0.0, "impervious_frac": 0.5, "fvc": 0.0, "soil_moisture": 0.2, "albedo": 0.18, "ndvi": 0.3, "svf": 0.6, "emissivity": 0.96, "et": 0.0}
# Layers that rules of feasibility read, where the grid does not have them.
ABSENT = {"impervious_frac": 0.5, "ndvi": 0.3, "water_frac": 0.0, "building_height": 0.0}
PARK_M2 = 20_000.0
COOLING_M = 100.0


@dataclass(frozen=True)
class Measure:
    """What a measure changes, its cooling ranges (of surface, air and radiant temperature), where it is possible, its cost band."""

    name: str
    changes: dict[str, float]
    surface: tuple[float, float]
    air: tuple[float, float]
    radiant: tuple[float, float]
    place: str
    band: str

    @property
    def cost_per_m2(self) -> float:
        return COST.get(self.band, 25.0)

    @property
    def layers(self) -> dict[str, float]:
        """The changes of layers that a grid can have; shade is none."""
        return {k: v for k, v in self.changes.items() if k != "shade"}

    def plausible(self, delta: float, slack: float = 1.5) -> bool:
        """Whether a surface cooling lies in the range of the literature, with some slack."""
        return -0.25 * self.surface[1] <= delta <= slack * self.surface[1]


# The measures.
MEASURES = {
    m.name: m
    for m in (
        Measure("urban_trees", {"ndvi": 0.20, "tree_frac": 0.20, "shade": 0.30, "albedo": 0.02}, (2.0, 12.0), (0.3, 2.0), (2.0, 8.0), "plantable", "low-med"),
        Measure("green_roof", {"ndvi": 0.15, "albedo": 0.05, "green_frac": 0.10}, (15.0, 45.0), (2.0, 5.0), (1.0, 3.0), "roof", "high"),
        Measure("cool_roof", {"albedo": 0.30}, (10.0, 30.0), (0.2, 2.3), (0.0, 1.0), "roof", "low"),
        Measure("cool_pavement", {"albedo": 0.25}, (5.0, 20.0), (0.0, 1.0), (-3.0, 0.0), "paved", "med"),
        Measure("permeable_pavement", {"albedo": 0.05, "soil_moisture": 0.10}, (2.0, 35.0), (0.0, 1.0), (0.0, 1.0), "paved", "med"),
        Measure("water_body", {"water_frac": 0.50, "ndwi": 0.30, "soil_moisture": 0.20}, (1.0, 3.0), (0.5, 3.0), (0.0, 2.0), "open", "high"),
        Measure("urban_park", {"ndvi": 0.30, "green_frac": 0.40, "shade": 0.20, "tree_frac": 0.20}, (1.0, 4.6), (0.5, 3.7), (1.0, 5.0), "vacant", "high"),
        Measure("green_wall", {"ndvi": 0.10, "albedo": 0.03}, (2.0, 13.7), (1.2, 3.3), (1.0, 3.0), "facade", "high"),
        Measure("increase_albedo", {"albedo": 0.20}, (5.0, 25.0), (0.2, 2.0), (-2.0, 0.5), "any", "low-med"),
    )
}


def measure(name: str) -> Measure:
    if name not in MEASURES:
        raise KeyError(f"unknown measure {name!r}; known: {', '.join(MEASURES)}")
    return MEASURES[name]


def catalogue(spark: SparkSession) -> DataFrame:
    """The measures as a table, one row each."""
    rows = [(m.name, m.place, m.band, m.cost_per_m2, *m.surface, *m.air, *m.radiant, sum(m.surface) / 2, sum(m.air) / 2, ",".join(f"{k}={v:+.2f}" for k, v in sorted(m.changes.items()))) for m in MEASURES.values()]
    names = ("surface_lo", "surface_hi", "air_lo", "air_hi", "radiant_lo", "radiant_hi", "surface_mid", "air_mid")
    return spark.createDataFrame(rows, "measure string, place string, band string, cost_per_m2 double, " + ", ".join(f"{n} double" for n in names) + ", changes string")


def with_layers(grid: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Adds constant layers for those that the grid lacks."""
    return grid.withColumns({k: F.lit(v) for k, v in defaults.items() if k not in grid.columns})


def possible(grid: DataFrame, name: str, out: str = "possible", resolution_m: float = 100.0) -> DataFrame:
    """Adds ``out``: whether the measure can be placed on a cell; a gap in a layer that the rule reads says no.

    Parks also need four-connected vacant ground of two hectares, counted in whole cells.
    """
    m = measure(name)
    said = column(feasible(m.place))
    if m.place != "vacant":
        missing = [k for k in ABSENT if k not in grid.columns]
        return with_layers(grid, ABSENT).withColumn(out, said).drop(*missing)
    marked = with_layers(grid, ABSENT).select("row", "col", said.cast("int").alias("_vacant"))
    cells = max(1, math.ceil(PARK_M2 / resolution_m**2))
    large = tiles.large_patches(marked, "_vacant", cells)
    return grid.join(large.select("row", "col", (F.col("patch") == 1).alias(out)), ["row", "col"], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def reach(grid: DataFrame, names: list[str] | None = None, resolution_m: float = 100.0) -> DataFrame:
    """measure, possible_cells, cost_everywhere: where each measure can be placed, and its cost there, in one aggregate."""
    names = list(names or MEASURES)
    x = grid
    for k, n in enumerate(names):
        x = possible(x, n, f"_p{k}", resolution_m)
    counts = x.agg(*[F.count(F.when(F.col(f"_p{k}"), 1)).alias(n) for k, n in enumerate(names)]).unpivot([], names, "measure", "possible_cells")
    cost = F.create_map(*[F.lit(v) for n in names for v in (n, float(measure(n).cost_per_m2))])
    return counts.withColumn("cost_everywhere", F.col("possible_cells") * cost[F.col("measure")] * float(resolution_m**2))


def changed(name: str, mask: str, have: list[str], now: dict[str, str] | None = None) -> dict[str, str]:
    """Layer to SQL for its value after the measure, where ``mask`` (SQL) holds; every changed layer is cut to its range.

    ``now`` has SQL for layers that an earlier measure has changed.

    New vegetation also closes the sky by half its share and displaces sealed ground by half; so does water.
    """
    m = measure(name)
    deltas = dict(m.layers)
    plants = max([v for k, v in deltas.items() if k in ("tree_frac", "green_frac", "fvc")], default=0.0)
    if plants > 0 and "svf" in have:
        deltas["svf"] = deltas.get("svf", 0.0) - 0.5 * plants
    sealed = 0.5 * plants + 0.5 * deltas.get("water_frac", 0.0)
    if sealed > 0 and "impervious_frac" in have:
        deltas["impervious_frac"] = deltas.get("impervious_frac", 0.0) - sealed
    out = {}
    for layer, d in deltas.items():
        base = (now or {}).get(layer) or (layer if layer in have else f"{float(NEUTRAL.get(layer, 0.0))}")
        text = f"{base} + CASE WHEN {mask} THEN ({d!r}) ELSE 0.0 END"
        lo, hi = CLIP.get(layer, (None, None))
        out[layer] = clip(text, f"({lo})", hi) if lo is not None else f"({text})"
    return out


def apply_measure(grid: DataFrame, name: str, mask: str | None = None) -> DataFrame:
    """The grid after the measure, on the cells where ``mask`` (SQL; by default, where it is possible) holds."""
    if mask is None:
        grid = possible(grid, name, "_possible")
    after = changed(name, mask or "_possible", grid.columns)
    return grid.withColumns({k: column(v) for k, v in after.items()}).drop("_possible")


def apply_plan(grid: DataFrame, plan: dict[str, str]) -> DataFrame:
    """The grid after several measures with their masks, one upon the other."""
    marks = {f"_mask{i}": column(f"coalesce({mask}, FALSE)") for i, mask in enumerate(plan.values())}
    out = grid.withColumns(marks)  # masks are judged on the grid as it was
    for i, name in enumerate(plan):
        out = apply_measure(out, name, f"_mask{i}")
    return out.drop(*marks)


def linear_model(layer: Callable[[str], str]) -> str:
    """The surface temperature of a plain linear model, for tests and examples."""
    return f"(35.0 - 8.0 * {layer('ndvi')} - 10.0 * {layer('albedo')} + 12.0 * {layer('impervious_frac')})"


def same(layer: str) -> str:
    return layer


def surface_delta(model: Model, after: dict[str, str]) -> str:
    """Cooling (positive) by the model between the layers as they are and as ``after`` has them; gaps count as 0."""
    return clip_cooling(f"{model(same)} - {model(lambda k: after.get(k, k))}")


def physics_delta(after: dict[str, str], have: list[str]) -> str:
    """Cooling by more reflection and evaporation, made linear about the surface temperature.

    Evaporation comes from the layer et where the grid has one, else from plant cover and soil moisture.  Where the
    surface temperature is a gap, there is no cooling.
    """
    value = lambda k, default: k if k in have else f"{default}"
    sun = value("solar_radiation", 700.0)
    lst = value("lst", 35.0)
    below = f"CASE WHEN {lst} IS NOT NULL THEN greatest(4.0 * {value('emissivity', 0.96)} * 5.670374419e-8 * power({clip(kelvin(lst), 200.0, 360.0)}, 3), 1e-6) END"
    gain = lambda k: f"({after[k]} - {value(k, NEUTRAL.get(k, 0.0))})" if k in after else "0.0"
    if "et" in have:
        latent = f"greatest({gain('et')}, 0.0) * 2.45e6 / 21600.0"
    else:
        latent = f"greatest({gain('green_frac')} + {gain('tree_frac')} + {gain('fvc')}, 0.0) * 0.25 * {sun} + greatest({gain('soil_moisture')}, 0.0) * 0.5 * {sun}"
    return clip_cooling(f"({gain('albedo')} * {sun} + {latent}) / ({below})")


def combined_delta(model: Model, after: dict[str, str], have: list[str], model_weight: float = 0.6) -> tuple[str, str]:
    """(cooling, sigma): the model's and the physical estimate weighted, and their distance."""
    a, b, w = surface_delta(model, after), physics_delta(after, have), min(max(model_weight, 0.0), 1.0)
    return clip_cooling(f"{w!r} * {a} + {1.0 - w!r} * {b}"), f"abs({a} - {b})"


def spread(grid: DataFrame, layer: str, out: str = "delta_lst", resolution_m: float = 100.0, reach_m: float = COOLING_M) -> DataFrame:
    """Adds ``out``: cooling with what neighbours within three lengths export, by exp(-d / reach); at least a cell's own.

    A cell gets half the largest cooling within reach (weights above 0.05) plus half the weighted mean of it, which is
    never below its own.  Cells beyond the edge cool by 0.
    """
    d = max(reach_m / max(resolution_m, 1e-6), 1e-6)
    n = max(math.ceil(3.0 * d), 1)
    weights = {(r, c): math.exp(-math.hypot(r, c) / d) for r in range(-n, n + 1) for c in range(-n, n + 1)}
    total = sum(weights.values())
    o = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(w / total).alias("w"), F.lit(w > 0.05).alias("near")) for (r, c), w in weights.items()]))
    # cells without cooling export nothing, so that only treated cells fan out
    sent = grid.filter(F.col(layer) != 0).select("row", "col", F.col(layer).alias("_v")).withColumn("_o", o)
    got = sent.groupBy((F.col("row") + F.col("_o.r")).alias("row"), (F.col("col") + F.col("_o.c")).alias("col")).agg(
        F.sum(F.col("_v") * F.col("_o.w")).alias("_mean"), F.max(F.when(F.col("_o.near"), F.col("_v"))).alias("_top"), F.count(F.when(F.col("_o.near"), 1)).alias("_near")
    )
    near = sum(w > 0.05 for w in weights.values())
    top = F.when(F.col("_near") < near, F.greatest(F.coalesce("_top", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("_top"))
    own = F.coalesce(F.col(layer), F.lit(0.0))
    x = grid.join(got, ["row", "col"], "left")
    return x.withColumn(out, F.greatest(own, 0.5 * (F.coalesce(top, F.lit(0.0)) + F.coalesce("_mean", F.lit(0.0))))).drop("_mean", "_top", "_near")


def delta_lst(grid: DataFrame, model: Model, name: str, mask: str | None = None, out: str = "delta_lst", resolution_m: float = 100.0, reach_m: float = COOLING_M) -> DataFrame:
    """Adds ``out``: the cooling of one measure, with its spread into the neighbourhood."""
    x = possible(grid, name, "_on", resolution_m) if mask is None else grid.withColumn("_on", column(f"coalesce({mask}, FALSE)"))
    raw = column(surface_delta(model, changed(name, "_on", grid.columns)))
    x = x.withColumn("_raw", F.when(F.col("_on"), raw).otherwise(0.0).cast("double"))
    return spread(x, "_raw", out, resolution_m, reach_m).drop("_raw", "_on")


def scenario(grid: DataFrame, model: Model, plan: dict[str, str], resolution_m: float = 100.0) -> tuple[DataFrame, DataFrame]:
    """(cells, summary): the cooling of all measures together, evaluated once, and its means.

    The summary has one row ``all`` with the mean over all cells and over the hottest tenth, and one row per measure
    with the mean it has alone.
    """
    marks = {f"_on{i}": column(f"coalesce({mask}, FALSE)") for i, mask in enumerate(plan.values())}
    x, after = grid.withColumns(marks), {}
    for i, name in enumerate(plan):
        after |= changed(name, f"_on{i}", grid.columns, after)  # a later measure starts from what an earlier one left
    union = " OR ".join(marks)
    raw = column(surface_delta(model, after))
    x = x.withColumn("_raw", F.when(column(union), raw).otherwise(0.0).cast("double"))
    cells = spread(x, "_raw", "delta_lst", resolution_m).drop("_raw", *marks)
    hot = F.lit(True)
    if "lst" in grid.columns:
        cut = stats.quantiles(grid, "lst", [0.9])
        hot = F.col("lst") >= F.lit(cut[0]) if cut[0] is not None else F.lit(True)
    summary = cells.agg(F.lit("all").alias("measure"), F.avg("delta_lst").alias("mean_c"), F.avg(F.when(hot, F.col("delta_lst"))).alias("hottest_c"))
    for name, mask in plan.items():
        alone = delta_lst(grid, model, name, mask, resolution_m=resolution_m)
        summary = summary.unionByName(alone.agg(F.lit(name).alias("measure"), F.avg("delta_lst").alias("mean_c"), F.avg(F.when(hot, F.col("delta_lst"))).alias("hottest_c")))
    return cells, summary


# --- air temperature and parks -------------------------------------------------------------------------------------


def _veg(have: list[str]) -> str:
    return "greatest(" + ", ".join(f"coalesce({k}, 0.0)" for k in ("tree_frac", "green_frac") if k in have) + ", 0.0)"


def shade(have: list[str]) -> str:
    """Share of tall canopy: from trees, else six tenths of the green share, else from ndvi."""
    if "tree_frac" in have:
        return clip("tree_frac", 0.0, 1.0)
    return clip("0.6 * green_frac", 0.0, 1.0) if "green_frac" in have else clip(f"({'ndvi' if 'ndvi' in have else '0.3'} - 0.2) / 0.6", 0.0, 1.0)


def crop_coefficient(have: list[str]) -> str:
    """Evaporation of the cover relative to reference: plants 1, water 1.05, sealed and bare ground 0.2."""
    veg, water = f"least({_veg(have)}, 1.0)", "coalesce(water_frac, 0.0)" if "water_frac" in have else "0.0"
    sealed = "greatest(least(impervious_frac, 1.0), 0.0)" if "impervious_frac" in have else f"greatest(1.0 - {veg} - {water}, 0.0)"
    bare = f"greatest(1.0 - {veg} - {water} - {sealed}, 0.0)"
    total = f"({veg} + {water} + {sealed} + {bare})"
    return f"(({veg} + 1.05 * {water} + 0.2 * {sealed} + 0.2 * {bare}) / CASE WHEN {total} > 1e-6 THEN {total} ELSE 1.0 END)"


def cooling_capacity(grid: DataFrame, out: str = "cc", weights: tuple[float, float, float] = (0.6, 0.2, 0.2)) -> DataFrame:
    """Adds ``out``: weighted shade, albedo and evaporation (the latter over its largest value in the grid), from 0 to 1."""
    have = grid.columns
    rate = f"greatest(least({crop_coefficient(have)}, 1.5), 0.0)"
    if "et" in have:
        x = stats.with_scalars(grid, F.avg("et").alias("_e")).withColumn("_k", column(f"{rate} * CASE WHEN _e IS NULL THEN 1.0 ELSE greatest(coalesce(et, _e), 0.0) END")).drop("_e")
    else:
        x = grid.withColumn("_k", column(rate))
    x = stats.with_scalars(x, F.max("_k").alias("_most"))
    evaporation = "CASE WHEN _most > 0 THEN greatest(least(_k / _most, 1.0), 0.0) ELSE 0.0 END"
    albedo = clip("albedo", 0.0, 1.0) if "albedo" in have else "0.18"
    a, b, c = weights
    return x.withColumn(out, column(clip(f"{a!r} * {shade(have)} + {b!r} * {albedo} + {c!r} * {evaporation}", 0.0, 1.0))).drop("_k", "_most")


def night_capacity(have: list[str]) -> str:
    """The night form: one less the built share."""
    built = "plan_area_frac" if "plan_area_frac" in have else "coalesce(impervious_frac, 0.0)" if "impervious_frac" in have else "0.0"
    return clip(f"1.0 - {clip(built, 0.0, 1.0)}", 0.0, 1.0)


def heat_mitigation(grid: DataFrame, out: str = "hm", cc: str = "cc", resolution_m: float = 100.0, reach_m: float = COOLING_M) -> DataFrame:
    """Adds ``out``, park_cc and green_m2: parks of two hectares export their capacity by exp(-d / reach).

    A cell keeps its own capacity if that is not less than what the parks give, or if too little green is near.
    """
    have = grid.columns
    green = f"({_veg(have)} >= 0.5)" if {"tree_frac", "green_frac"} & set(have) else "(coalesce(ndvi, 0.0) >= 0.4)"
    x = grid.withColumn("_g", column(f"CASE WHEN {green} THEN 1.0 ELSE 0.0 END"))
    kernel = stencil.decay_kernel(max(reach_m / max(resolution_m, 1e-6), 1e-6))
    n = max(r for r, _, _ in kernel)
    x = stencil.neighbour_sums(x, kernel, park_cc=F.col("_g") * F.col(cc))
    x = stencil.square_sums(x, n, green_m2=F.col("_g") * resolution_m**2)
    own = (F.col(cc) >= F.col("park_cc")) | (F.col("green_m2") < PARK_M2)
    return x.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(own, F.col(cc)).otherwise(F.col("park_cc"))))).drop("_g")


def air_temperature(grid: DataFrame, reference_c: float, uhi_max_c: float, hm: str = "hm", resolution_m: float = 100.0, mixing_m: float = 500.0) -> DataFrame:
    """Adds t_air_nomix, t_air (mixed by a Gaussian of ``mixing_m``) and delta_t_air, the cooling against no mitigation."""
    x = grid.withColumn("t_air_nomix", F.lit(float(reference_c)) + (1.0 - F.col(hm)) * float(uhi_max_c))
    x = stencil.gaussian_blur(x, "t_air_nomix", max(mixing_m / max(resolution_m, 1e-6), 1e-6), "t_air")
    return x.withColumn("delta_t_air", F.lit(float(reference_c + uhi_max_c)) - F.col("t_air"))


def urban_cooling(grid: DataFrame, reference_c: float, uhi_max_c: float, resolution_m: float = 100.0, mixing_m: float = 500.0) -> DataFrame:
    """Adds cc, hm and the air temperatures: capacity, mitigation and mixing in one call."""
    return air_temperature(heat_mitigation(cooling_capacity(grid), resolution_m=resolution_m), reference_c, uhi_max_c, resolution_m=resolution_m, mixing_m=mixing_m)
