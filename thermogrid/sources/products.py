"""Feature tables from the observations of many products, each layer by its own reduction.

An observation table is long: product, band, ts, row, col, value (as stored; a masked pixel is NULL or missing).  All
bands that lie on one grid are reduced in one aggregate with partial sums, whatever the number of layers; only
accumulated bands and those of which the latest counts first gather the moments of a cell.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formulas as M
from ..functions.formulas import clip, column
from ..operators import landcover, regrid, scenes
from .shared import kept

CELL = ["row", "col"]
HOW = ("mean", "median", "rate", "latest", "mosaic")


@dataclass(frozen=True)
class Band:
    """A band and how it is reduced over time.

    ``mean``, ``median`` and ``rate`` (hourly steps of a band accumulated over a day, per second) look at the window;
    ``latest`` (the newest moment, gaps included) and ``mosaic`` (the newest known value) look at all moments.
    """

    product: str
    band: str
    how: str = "mean"
    scale: float = 1.0
    offset: float = 0.0

    def __post_init__(self):
        if self.how not in HOW:
            raise ValueError(f"unknown reduction {self.how!r}; use one of {HOW}")


@dataclass(frozen=True)
class Group:
    """Bands by the names that formulas use, and layers as SQL over those names and the layers above them."""

    bands: dict[str, Band]
    layers: dict[str, str]

    def __post_init__(self):
        if both := set(self.bands) & set(self.layers):
            raise ValueError(f"a band and a layer of one group share the names {sorted(both)}")


@dataclass(frozen=True)
class Features:
    """The table with all layers; those without any value; groups of which no layer has one."""

    table: DataFrame
    missing: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)


# Sky view, height over width and mean height that usually go with a climate zone.
ZONES = {
    1: {"svf": 0.30, "hw": 2.5, "height": 30}, 2: {"svf": 0.45, "hw": 1.25, "height": 17}, 3: {"svf": 0.40, "hw": 1.0, "height": 6},
    4: {"svf": 0.60, "hw": 1.0, "height": 30}, 5: {"svf": 0.65, "hw": 0.5, "height": 17}, 6: {"svf": 0.75, "hw": 0.5, "height": 6},
    7: {"svf": 0.35, "hw": 1.5, "height": 3}, 8: {"svf": 0.80, "hw": 0.2, "height": 6}, 9: {"svf": 0.85, "hw": 0.15, "height": 6},
    10: {"svf": 0.75, "hw": 0.35, "height": 10}, 11: {"svf": 0.35, "hw": 0.0, "height": 15}, 12: {"svf": 0.65, "hw": 0.0, "height": 9},
    13: {"svf": 0.80, "hw": 0.0, "height": 1}, 14: {"svf": 0.95, "hw": 0.0, "height": 0.5}, 15: {"svf": 0.95, "hw": 0.0, "height": 0.25},
    16: {"svf": 0.95, "hw": 0.0, "height": 0.25}, 17: {"svf": 0.95, "hw": 0.0, "height": 0.0},
}


_LAND, _AIR = "era5_land_hourly", "era5_hourly"

REANALYSIS = Group(
    {
        "t2m": Band(_LAND, "temperature_2m", offset=-273.15),
        "td2m": Band(_LAND, "dewpoint_temperature_2m", offset=-273.15),
        "u10": Band(_LAND, "u_component_of_wind_10m"),
        "v10": Band(_LAND, "v_component_of_wind_10m"),
        "sp": Band(_LAND, "surface_pressure", scale=0.001),
        "ssrd": Band(_LAND, "surface_solar_radiation_downwards", "rate"),
        "strd": Band(_LAND, "surface_thermal_radiation_downwards", "rate"),
        "ssr": Band(_LAND, "surface_net_solar_radiation", "rate"),
        "str": Band(_LAND, "surface_net_thermal_radiation", "rate"),
        "swvl1": Band(_LAND, "volumetric_soil_water_layer_1"),
        "blh": Band(_AIR, "boundary_layer_height"),
    },
    {
        "air_temp": "t2m",
        "dewpoint": "td2m",
        "rel_humidity": M.relative_humidity("t2m", "td2m"),
        "wind_speed": M.wind_speed("u10", "v10"),
        "pressure": "sp",
        "solar_radiation": "ssrd",
        "longwave_down": "strd",
        "net_radiation": "ssr + str",
        "soil_moisture": "swvl1",
        "pbl_height": "blh",
    },
)

#: Surface temperature in degC from clear pixels, sensors weighted by the inverse of their variances.
THERMAL = Group(
    {
        "fine": Band("landsat", scenes.SENSORS["landsat"].band, "median", scenes.SENSORS["landsat"].scale, scenes.SENSORS["landsat"].offset - 273.15),
        "day": Band("mod11a1", "lst_day_1km", "median", scenes.SENSORS["MOD11A1"].scale, -273.15),
        "night": Band("mod11a1", "lst_night_1km", "median", scenes.SENSORS["MOD11A1"].scale, -273.15),
    },
    {
        "weight_fine": f"CASE WHEN fine IS NOT NULL THEN {scenes.SENSORS['landsat'].sigma ** -2} ELSE 0.0 END",
        "weight_day": f"CASE WHEN day IS NOT NULL THEN {scenes.SENSORS['MOD11A1'].sigma ** -2} ELSE 0.0 END",
        "lst": "(coalesce(fine, 0.0) * weight_fine + coalesce(day, 0.0) * weight_day) / nullif(weight_fine + weight_day, 0.0)",
        "lst_uncertainty": "sqrt(1.0 / nullif(weight_fine + weight_day, 0.0))",
        "lst_day": "day",
        "lst_night": "night",
    },
)

AIR_QUALITY = Group(
    {"aod_055": Band("maiac_aod", "optical_depth_055", scale=0.001), "no2_column": Band("s5p_no2", "tropospheric_no2_column_number_density")},
    {"aod": "aod_055", "no2": "no2_column"},
)

SURFACE = Group(
    {
        "bsa": Band("mcd43a3", "albedo_bsa_shortwave", scale=0.001),
        "wsa": Band("mcd43a3", "albedo_wsa_shortwave", scale=0.001),
        "et_8day": Band("mod16a2gf", "et", scale=0.1),
        "zone": Band("global_lcz", "lcz_filter", "mosaic"),
    },
    {"albedo": clip("(bsa + wsa) / 2.0", 0.0, 1.0), "et": "et_8day", "lcz": "CAST(zone AS INT)"},
)

#: Evapotranspiration from its three parts, where a study prefers it to that of ``SURFACE``.
PARTED_ET = Group({n: Band("pml_v2", n) for n in ("ec", "es", "ei")}, {"et": "ec + es + ei"})

PEOPLE = Group(
    {
        "people": Band("ghsl_pop", "population_count", "latest"),
        "lights": Band("black_marble", "gap_filled_ntl"),
        "volume": Band("ghsl_built_v", "built_volume_total", "latest"),
    },
    {"population": clip("people", 0.0), "nightlights": "lights", "building_volume": clip("volume", 0.0)},
)


def morphology(cell_m2: float) -> Group:
    """Built form from built surface, surface and ground models, heights and climate zones, for cells of an area."""
    return Group(
        {
            "built_m2": Band("ghsl_built_s", "built_surface", "mosaic"),
            "dsm": Band("glo30", "dem", "mosaic"),
            "dem": Band("fabdem", "b1", "mosaic"),
            "anbh": Band("ghsl_built_h", "built_height", "mosaic"),
            "ground": Band("nasadem", "elevation", "mosaic"),
            "zone_code": Band("global_lcz", "lcz_filter", "mosaic"),
        },
        {
            "zone_hw": "CASE CAST(zone_code AS INT) " + " ".join(f"WHEN {k} THEN {float(z['hw'])}" for k, z in ZONES.items()) + " END",
            "plan_area_frac": clip(f"built_m2 / {float(cell_m2)}", 0.0, 1.0),
            "object_height": clip("dsm - dem", 0.0),
            "building_height": "CASE WHEN plan_area_frac > 0.1 AND object_height IS NOT NULL THEN object_height WHEN anbh IS NOT NULL THEN greatest(anbh, 0.0) END",
            "frontal_area_index": M.frontal_area_index("plan_area_frac", "building_height"),
            "aspect_ratio": M.aspect_ratio("plan_area_frac", "building_height", "zone_hw"),
            "svf": M.sky_view_factor("aspect_ratio"),
            "roughness_length": f"CASE WHEN frontal_area_index IS NOT NULL THEN {M.roughness_length('plan_area_frac', 'frontal_area_index', 'building_height')} ELSE 0.03 END",
            "displacement_height": f"coalesce(({M.displacement_over_height('plan_area_frac')}) * building_height, 0.0)",
            "elevation": "ground",
        },
    )


#: Layers of a group that only other layers need.
HELPERS = ("zone_hw", "object_height", "weight_fine", "weight_day")


def default_groups(cell_m2: float) -> dict[str, Group]:
    return {"thermal": THERMAL, "reanalysis": REANALYSIS, "air_quality": AIR_QUALITY, "surface": SURFACE, "people": PEOPLE, "morphology": morphology(cell_m2)}


def reduced(observations: DataFrame, bands: dict[str, Band], start: str, end: str) -> DataFrame:
    """row, col and one column for each band; the window is from ``start`` up to but not including ``end``.

    A cell has a row if it has any observation of these bands that counts.  Not-a-number is a gap.  Several observations
    of one moment are as many for a mean, and their mean is that moment's value otherwise.  The first moment of an
    accumulated band gives no rate; a later one at hour 1 gives its own value, the others their growth, by 3600.
    """
    names = list(bands)
    is_ = lambda b: (F.col("product") == b.product) & (F.col("band") == b.band)
    within = (F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp"))
    distinct = list(dict.fromkeys((b.product, b.band, b.how) for b in bands.values()))
    code = {d: k for k, d in enumerate(distinct)}
    place: dict[tuple[str, str], list[int]] = {}
    for (product, band, _), k in code.items():
        place.setdefault((product, band), []).append(k)
    by_band = F.lit(None)
    for (product, band), ks in place.items():
        by_band = F.when(is_(Band(product, band)), F.array(*[F.lit(k) for k in ks])).otherwise(by_band)
    timeless = [k for (_, _, how), k in code.items() if how in ("latest", "mosaic")]
    x = observations.filter(F.col("product").isin(sorted({p for p, _, _ in distinct})) & F.col("band").isin(sorted({b for _, b, _ in distinct})))
    if not timeless:
        x = x.filter(within)
    value = F.col("value").cast("double")
    x = x.select(*CELL, "ts", F.when(~F.isnan(value), value).alias("value"), F.explode(by_band).alias("_k"))
    if timeless:
        x = x.filter(F.col("_k").isin(timeless) | within)
    rates = [k for (_, _, how), k in code.items() if how == "rate"]
    rows = x.filter(~F.col("_k").isin(timeless + rates)) if timeless or rates else x
    # one exchange: the moments, their order and (for these rows) the last aggregate all go by the cell
    moments = lambda ks: x.filter(F.col("_k").isin(ks)).repartition(*CELL).groupBy(*CELL, "_k", "ts").agg(F.avg("value").alias("value"))
    if timeless:
        rows = rows.unionByName(moments(timeless).select(*rows.columns))
    if rates:
        w = Window.partitionBy(*CELL, "_k").orderBy("ts")
        step = F.when(F.lag("ts").over(w).isNotNull(), F.when(F.hour("ts") == 1, F.col("value")).otherwise(F.col("value") - F.lag("value").over(w))) / 3600.0
        rows = rows.unionByName(moments(rates).select(*CELL, "ts", step.alias("value"), "_k"))

    def one(b: Band) -> Column:
        mine = F.col("_k") == code[b.product, b.band, b.how]
        if b.how in ("mean", "rate"):
            return F.avg(F.when(mine, F.col("value")))
        if b.how == "median":
            return F.median(F.when(mine, F.col("value")))
        return F.max_by("value", F.when(mine if b.how == "latest" else mine & F.col("value").isNotNull(), F.col("ts")))

    wide = rows.groupBy(*CELL).agg(*[one(bands[n]).alias(n) for n in names])
    return wide.select(*CELL, *[(F.col(n) * bands[n].scale + bands[n].offset).alias(n) for n in names])


def slope(grid: DataFrame, layer: str, size_m: float, out: str = "slope") -> DataFrame:
    """Adds the slope in degrees from the four cells beside each; a gap among them, or the edge, makes a gap."""
    beside = lambda axis, other, d: F.max(layer).over(Window.partitionBy(other).orderBy(axis).rangeBetween(d, d))
    x = grid.withColumns({"_e": beside("col", "row", 1) - beside("col", "row", -1)})
    x = x.withColumns({"_s": beside("row", "col", 1) - beside("row", "col", -1)})
    return x.withColumn(out, F.degrees(F.atan(F.sqrt(F.col("_e") ** 2 + F.col("_s") ** 2) / (2.0 * size_m)))).drop("_e", "_s")


def build_features(observations: DataFrame, start: str, end: str, groups: dict[str, Group] | None = None, size_m: float = 100.0, frames: dict[str, regrid.Frame] | None = None, target: regrid.Frame | None = None) -> Features:
    """The feature table of all groups: one row for each cell, one column for each layer, NULL for a gap.

    ``frames`` tells where the grids of products lie; those that differ from ``target`` are reduced on their own grid and
    then looked up at the target's centres, products without a frame lie on the target.  A group of which no product was
    observed is skipped, its layers are gaps.  Of two groups with a layer of one name the first counts.  With elevation
    comes slope, with lights, people or volume comes anthro_heat.
    """
    groups = groups if groups is not None else default_groups(size_m * size_m)
    frames = frames or {}
    if frames and target is None:
        raise ValueError("frames of products need a target")
    by_frame: dict[regrid.Frame | None, dict[str, Band]] = {}
    for name, group in groups.items():
        for n, b in group.bands.items():
            at = frames.get(b.product)
            by_frame.setdefault(None if at == target else at, {})[f"{name}__{n}"] = b
    table = None
    for at, bands in by_frame.items():
        part = reduced(observations, bands, start, end)
        part = part if at is None else regrid.nearest(part, list(bands), at, target)
        table = part if table is None else table.join(part, CELL, "full")
    if table is None:
        raise ValueError("no group given")
    layers: dict[str, str] = {}
    for name, group in groups.items():
        # a group's formulas see its own bands and layers only
        table = table.withColumnsRenamed({f"{name}__{n}": n for n in group.bands})
        for layer, text in group.layers.items():
            table = table.withColumn(layer, column(text))
            if layer not in HELPERS:
                layers.setdefault(layer, name)
        table = table.drop(*group.bands).withColumnsRenamed({n: f"{name}::{n}" for n in group.layers})
    table = table.select(*CELL, *[F.col(f"`{name}::{layer}`").alias(layer) for layer, name in layers.items()])
    table = kept(table, "features")
    known = table.agg(*[F.count(c).alias(c) for c in layers]).first().asDict()
    if "elevation" in layers:
        table, layers["slope"], known["slope"] = slope(table, "elevation", size_m), layers["elevation"], known["elevation"]
    proxies = [c for c in ("nightlights", "population", "building_volume") if known.get(c)]
    if proxies:
        table = scenes.heat_proxy(table)
        layers["anthro_heat"], known["anthro_heat"] = layers[proxies[0]], 1
    elif {"nightlights", "population", "building_volume"} & set(layers):
        table = table.withColumn("anthro_heat", F.lit(None).cast("double"))
        layers["anthro_heat"], known["anthro_heat"] = next(layers[c] for c in ("nightlights", "population", "building_volume") if c in layers), 0
    skipped = [n for n in groups if not any(known[c] for c, g in layers.items() if g == n)]
    return Features(table, [c for c in layers if not known[c]], skipped)


def load_observations(spark: SparkSession, config, observations: DataFrame | None = None, path: str | None = None, **options) -> DataFrame:
    """The grid of a study from a table of observations, given or read from Parquet, over the study's window and cell size."""
    if observations is None:
        if path is None:
            raise ValueError("a study from observations needs their table or its path")
        observations = spark.read.parquet(path)
    return build_features(observations, config.start, config.end, size_m=config.resolution_m, **options).table


def zone_layers(grid: DataFrame, code: str = "lcz") -> DataFrame:
    """Adds svf, hw and height of each cell's climate zone (``zone_svf``, ``zone_hw``, ``zone_height``); an unknown zone is a gap."""
    return landcover.looked_up(grid, code, {k: {f"zone_{n}": v for n, v in z.items()} for k, z in ZONES.items()})
