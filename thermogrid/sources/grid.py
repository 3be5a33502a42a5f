"""Checks, gaps, layers and samples of grids as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACE = ("row", "col", "x", "y")


def layers_of(grid: DataFrame) -> list[str]:
    """The numeric layers, sorted by name."""
    return sorted(f.name for f in grid.schema.fields if f.name not in PLACE and isinstance(f.dataType, T.NumericType))


def clean(grid: DataFrame) -> DataFrame:
    """NaN and infinities become gaps (NULL), once, where a grid comes in; every operator then knows one kind of gap."""
    bad = {}
    for f in grid.schema.fields:
        if isinstance(f.dataType, T.DoubleType | T.FloatType):
            x = F.col(f"`{f.name}`")
            bad[f.name] = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    return grid.withColumns(bad)


def validate(grid: DataFrame, rows: int, cols: int, transform: tuple, crs: str, bounds: tuple) -> None:
    """Raises ValueError if the reference is incomplete or the cells are not exactly those of the grid, once each."""
    if len(transform) != 6:
        raise ValueError("an affine transform has six numbers")
    if not crs:
        raise ValueError("the grid has no projected system")
    if len(bounds) != 4:
        raise ValueError("bounds are four numbers")
    for name in ("row", "col"):
        if name not in grid.columns:
            raise ValueError(f"the grid has no column {name}")
    inside = F.coalesce(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1), F.lit(False))
    # a sum over distinct cell numbers needs no list of them
    s = grid.agg(F.count("*").alias("n"), F.count(F.when(~inside, 1)).alias("out")).first()
    if s["out"]:
        raise ValueError(f"{s['out']} cells lie outside {rows} by {cols}")
    twice = grid.groupBy("row", "col").count().filter("count > 1").limit(1).count()
    if twice or s["n"] != rows * cols:
        raise ValueError(f"{s['n']} cells for a grid of {rows} by {cols}" + (", some of them twice" if twice else ""))


def select_layers(grid: DataFrame, names: list[str]) -> DataFrame:
    """The place and those of the layers that the grid has."""
    return grid.select(*[c for c in PLACE if c in grid.columns], *[n for n in dict.fromkeys(names) if n in grid.columns and n not in PLACE])


def add_layer(grid: DataFrame, name: str, value: Column, overwrite: bool = True) -> DataFrame:
    if not overwrite and name in grid.columns:
        raise ValueError(f"the grid has a layer {name}")
    return grid.withColumn(name, value)


def layer(grid: DataFrame, name: str, default: float | None = None) -> Column:
    """A layer, or a constant for one that the grid lacks; without a default, an unknown name is an error."""
    if name in grid.columns:
        return F.col(name)
    if default is None:
        raise KeyError(f"no layer {name}; there are {', '.join(layers_of(grid))}")
    return F.lit(default)


def scramble(seed: int, row: str = "row", col: str = "col") -> str:
    """A whole number below 65521 for each cell, as SQL that every engine evaluates alike."""
    a = f"(CAST({row} AS BIGINT) * 7349 + CAST({col} AS BIGINT) * 9151 + {seed * 1237 + 17}) % 65521"
    b = f"(({a}) * ({a}) + 31 * CAST({row} AS BIGINT) + 7) % 65521"
    return f"((({b}) * (({b}) + 13) + 17 * CAST({col} AS BIGINT)) % 65521)"


def sample_table(grid: DataFrame, names: list[str] | None = None, drop_gaps: bool = True, most: int | None = None, seed: int = 0) -> DataFrame:
    """Place and layers, one row per cell; without gaps, and at most ``most`` rows, the same ones for the same seed."""
    names = names if names is not None else layers_of(grid)
    for n in names:
        layer(grid, n)
    out = select_layers(grid, names)
    if drop_gaps:
        out = out.dropna(subset=[n for n in names if n not in PLACE])
    return out if most is None else out.orderBy(F.expr(scramble(seed)), "row", "col").limit(most)


def layer_statistics(grid: DataFrame, names: list[str] | None = None) -> DataFrame:
    """layer, cells, known, mean, low, high of each layer, in one pass."""
    names = names or layers_of(grid)
    long = grid.select(F.explode(F.array(*[F.struct(F.lit(n).alias("layer"), F.col(n).cast("double").alias("v")) for n in names])).alias("o")).select("o.*")
    return long.groupBy("layer").agg(F.count("*").alias("cells"), F.count("v").alias("known"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))


def empty_grid(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """The cells of a grid without layers."""
    n = spark.range(rows * cols)
    return n.select((F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
