"""All derived layers that a grid's layers allow, in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import formulas as M
from ..functions.formulas import column
from . import stats


def all_indices(grid: DataFrame) -> DataFrame:
    """Adds every index whose inputs the grid has; layers that are there already stay as they are.

    From ndvi: evi-free cover fraction and emissivity.  From the surface temperature: z-score, percentile, thermal
    field index and heat-island intensity (by zones where there are zones).  From air temperature and humidity: heat
    index, wet bulb, globe temperature, humidex, discomfort and the number of limits passed; with wind also apparent
    temperature and the universal index.
    """
    have = set(grid.columns)
    row: dict[str, str] = {}
    if "ndvi" in have:
        row |= {"fvc": M.fvc_square_then_clip("ndvi"), "emissivity": M.emissivity_from_ndvi("ndvi")}
    if {"air_temp", "rel_humidity"} <= have:
        ind = ("air_temp", "rel_humidity")
        dew = "dewpoint" if "dewpoint" in have else "air_temp"
        row |= {"heat_index": M.heat_index(*ind), "wet_bulb": M.wet_bulb(*ind), "wbgt": M.wbgt_simplified(*ind), "discomfort_index": M.discomfort_index(*ind)}
        if "dewpoint" in have:
            row["humidex"] = M.humidex("air_temp", "dewpoint")
        count = M.human_stress_count(*ind, dew)
        row |= {"human_stress_count": count, "human_stress_score": f"(100.0 * {count} / 5.0)"}
        if "wind_speed" in have:
            sun = ("solar_radiation",) if "solar_radiation" in have else ()
            row["apparent_temp"] = M.apparent_temperature(*ind, "wind_speed", *sun)
            row["utci"] = M.utci(*ind, "wind_speed", "tmrt" if "tmrt" in have else None)
    out = grid.withColumns({k: column(v) for k, v in row.items() if k not in have})
    if "lst" in have:
        out = stats.zscore(out, "lst", "lst_zscore") if "lst_zscore" not in have else out
        out = stats.percentile_rank(out, "lst", "lst_percentile") if "lst_percentile" not in have else out
        out = stats.utfvi(out) if "utfvi" not in have else out
        out = stats.surface_uhi(out, lcz="lcz" if "lcz" in have else None) if "suhii" not in have else out
    return out
