"""Transfer of layers between two grids, each given by its affine (a, 0, c, 0, e, f) and its numbers of rows and columns.

Nearest and bilinear: each target cell looks up one or four source cells by their row and column, an equi-join.  By
area: each source cell goes to the target cells that it overlaps, with the area that they share, and one aggregate with
partial sums gathers them.  Grids that are turned are not known and raise an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.grid import empty_grid


@dataclass(frozen=True)
class Frame:
    """Where a grid lies."""

    transform: tuple[float, float, float, float, float, float]
    rows: int
    cols: int

    def __post_init__(self):
        a, b, _, d, e, _ = self.transform
        if b or d or not a or not e:
            raise ValueError(f"only grids along the axes can be transferred, not {self.transform}")


def _place(source: Frame, target: Frame, axis: str, at: Column) -> Column:
    """A place along an axis, counted in source cells from their first edge, of one counted in target cells."""
    k = 4 if axis == "row" else 0
    return (at * float(target.transform[k]) + float(target.transform[k + (1 if k else 2)]) - float(source.transform[k + (1 if k else 2)])) / float(source.transform[k])


def nearest(grid: DataFrame, layers: list[str], source: Frame, target: Frame) -> DataFrame:
    """row, col of the target and the layers of the source cell that holds its centre; outside, and at a gap, a gap."""
    cells = empty_grid(grid.sparkSession, target.rows, target.cols)
    looked = cells.withColumns({f"_{c}": F.floor(_place(source, target, c, F.col(c) + 0.5)).cast("int") for c in ("row", "col")})
    values = grid.select(F.col("row").alias("_row"), F.col("col").alias("_col"), *layers)
    return looked.join(values, ["_row", "_col"], "left").select("row", "col", *layers)


def bilinear(grid: DataFrame, layers: list[str], source: Frame, target: Frame) -> DataFrame:
    """The layers between the four source centres around each target centre; gaps take no part, and their weight goes to the others."""
    x = empty_grid(grid.sparkSession, target.rows, target.cols)
    for c in ("row", "col"):
        x = x.withColumn(f"_p{c}", _place(source, target, c, F.col(c) + 0.5) - 0.5).withColumn(f"_f{c}", F.floor(f"_p{c}"))
    size = {"row": source.rows, "col": source.cols}
    inside = [(F.col(f"_p{c}") >= -0.5) & (F.col(f"_p{c}") < size[c] - 0.5) for c in size]  # the centre lies in a source cell
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    x = x.withColumn("_ok", inside[0] & inside[1]).withColumn("_o", corner)
    weight = F.lit(1.0)
    for c, o in (("row", F.col("_o.i")), ("col", F.col("_o.j"))):
        part = F.col(f"_p{c}") - F.col(f"_f{c}")
        weight = weight * F.when(o == 1, part).otherwise(1.0 - part)
    x = x.select("row", "col", "_ok", weight.alias("_w"), (F.col("_frow") + F.col("_o.i")).cast("int").alias("_row"), (F.col("_fcol") + F.col("_o.j")).cast("int").alias("_col"))
    values = grid.select(F.col("row").alias("_row"), F.col("col").alias("_col"), *layers)
    x = x.join(values, ["_row", "_col"], "left")
    some = [e for n in layers for e in (F.sum(F.col(n) * F.col("_w")).alias(f"_s_{n}"), F.sum(F.when(F.col(n).isNotNull(), F.col("_w"))).alias(f"_w_{n}"))]
    g = x.groupBy("row", "col").agg(F.first("_ok").alias("_ok"), *some)
    return g.select("row", "col", *[F.when(F.col("_ok") & (F.col(f"_w_{n}") > 0), F.col(f"_s_{n}") / F.col(f"_w_{n}")).alias(n) for n in layers])


def by_area(grid: DataFrame, layers: list[str], source: Frame, target: Frame, total: bool = False) -> DataFrame:
    """The layers' means over the area that target cells share with source cells that are no gaps; a target cell without any is a gap.

    With ``total`` layers are amounts instead: a source cell's amount is dealt by area, and the sum over all cells is kept
    as far as the target covers the source.
    """
    x = grid.select("row", "col", *layers)
    size = {"row": target.rows, "col": target.cols}
    for c in ("row", "col"):
        ends = [_place(target, source, c, F.col(c) + o) for o in (0, 1)]  # source edges in target cells
        x = x.withColumns({f"_lo{c}": F.least(*ends), f"_hi{c}": F.greatest(*ends)})
        first, last = F.greatest(F.floor(f"_lo{c}"), F.lit(0)), F.least(F.ceil(f"_hi{c}") - 1, F.lit(size[c] - 1))
        x = x.withColumn(f"_{c}", F.explode(F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))))
    share = F.lit(1.0)
    for c in ("row", "col"):
        share = share * (F.least(f"_hi{c}", F.col(f"_{c}") + 1) - F.greatest(f"_lo{c}", F.col(f"_{c}")))
    x = x.withColumn("_a", share).filter("_a > 1e-12")
    whole = abs(source.transform[0] * source.transform[4] / (target.transform[0] * target.transform[4]))  # a source cell in target cells
    sums = [e for n in layers for e in (F.sum(F.col(n) * F.col("_a")).alias(f"_s_{n}"), F.sum(F.when(F.col(n).isNotNull(), F.col("_a"))).alias(f"_w_{n}"))]
    g = x.groupBy(F.col("_row").alias("row"), F.col("_col").alias("col")).agg(*sums)
    values = [(F.col(f"_s_{n}") / whole if total else F.col(f"_s_{n}") / F.col(f"_w_{n}")).alias(n) for n in layers]
    return empty_grid(grid.sparkSession, target.rows, target.cols).join(g.select("row", "col", *values), ["row", "col"], "left")


METHODS = {"nearest": nearest, "bilinear": bilinear, "area": by_area}


def regrid(grid: DataFrame, layers: list[str], source: Frame, target: Frame, method: str = "area") -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")
    return METHODS[method](grid, layers, source, target)
