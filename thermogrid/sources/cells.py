"""Grids as tables: one row per cell, one column per layer, NULL for a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formulas import exact

WIDTH = 50
KEY = "CAST(o_orderkey AS BIGINT)"


def _mod(factor: int, size: int) -> str:
    return f"CAST({KEY} * {factor} % {size} AS DOUBLE)"


#: Layers of the grid that the orders table stands for, by integer arithmetic on its columns.
LAYERS = {
    "lst": f"CASE WHEN {KEY} % 17 <> 0 THEN 20.0 + CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 2001 AS DOUBLE) / 100.0 + 0.02 * ({KEY} % 50 - 25) * ({KEY} % 50 - 25) END",
    "air_temp": f"25.0 + {_mod(37, 1501)} / 100.0",
    "dewpoint": f"10.0 + {_mod(41, 1201)} / 100.0",
    "rel_humidity": f"8.0 + {_mod(53, 9101)} / 100.0",
    "wind_speed": f"0.2 + {_mod(29, 901)} / 100.0",
    "pressure": f"90.0 + {_mod(43, 1301)} / 100.0",
    "solar_radiation": f"200.0 + {_mod(59, 7001)} / 10.0",
    "longwave_down": f"300.0 + {_mod(61, 1501)} / 10.0",
    "ndvi": f"-0.2 + {_mod(71, 1101)} / 1000.0",
    "albedo": f"0.05 + {_mod(31, 401)} / 1000.0",
    "emissivity": f"0.90 + {_mod(23, 95)} / 1000.0",
    "impervious_frac": f"{_mod(17, 1001)} / 1000.0",
    "green_frac": f"{_mod(19, 601)} / 1000.0",
    "tree_frac": f"{_mod(13, 401)} / 1000.0",
    "water_frac": f"{_mod(7, 701)} / 1000.0",
    "svf": f"0.1 + {_mod(11, 901)} / 1000.0",
    "building_height": f"{_mod(67, 401)} / 10.0",
    "soil_moisture": f"{_mod(47, 501)} / 1000.0",
    "population": "CAST(o_custkey % 997 AS DOUBLE)",
    "nightlights": f"{_mod(73, 801)} / 10.0",
    "anthro_heat": f"{_mod(79, 601)} / 10.0",
    "roughness_length": f"0.01 + {_mod(83, 151)} / 100.0",
    "lcz": f"CAST(1 + {KEY} * 5 % 17 AS INT)",
    "b2": f"0.02 + {_mod(89, 201)} / 1000.0",
    "b3": f"0.03 + {_mod(97, 251)} / 1000.0",
    "b4": f"0.02 + {_mod(101, 301)} / 1000.0",
    "b8": f"0.05 + {_mod(103, 451)} / 1000.0",
    "b11": f"0.05 + {_mod(107, 401)} / 1000.0",
    "b12": f"0.03 + {_mod(109, 351)} / 1000.0",
    "qa": f"{KEY} * 3 % 128",
}


def cells_sql(table: str = "orders") -> str:
    cols = ", ".join(f"{exact(x)} AS {n}" for n, x in LAYERS.items())
    return f"SELECT CAST(floor(o_orderkey / {WIDTH}e0) AS INT) AS row, CAST(o_orderkey % {WIDTH} AS INT) AS col, {cols} FROM {table}"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the grid behind the orders table; unused layers are pruned down to the scan."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    layers = [F.expr(exact(x)).alias(n) for n, x in LAYERS.items()]
    return orders.select(F.floor(F.col("o_orderkey") / WIDTH).cast("int").alias("row"), (F.col("o_orderkey") % WIDTH).cast("int").alias("col"), *layers)


def with_coordinates(grid: DataFrame, transform: tuple[float, float, float, float, float, float]) -> DataFrame:
    """Adds x and y of the pixel centres by the affine (a, b, c, d, e, f)."""
    a, b, c, d, e, f = transform
    column, line = F.col("col") + 0.5, F.col("row") + 0.5
    return grid.withColumns({"x": a * column + b * line + c, "y": d * column + e * line + f})
