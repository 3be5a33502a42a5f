"""Neighbourhood operators on the cells of a grid.

A general kernel is a small table of offsets: each cell sends its value to the cells around it and one
aggregate with map-side partial sums gathers them.  Square windows need no such fan-out: they are two sliding
window sums, along rows and then along columns.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def kernel(k: int = 1, contiguity: str = "queen", include_self: bool = True) -> list[tuple[int, int, float]]:
    """Offsets with weight 1: all, Manhattan distance up to k (rook), or Euclidean distance up to k (distance)."""
    inside = {"queen": lambda r, c: True, "rook": lambda r, c: abs(r) + abs(c) <= k, "distance": lambda r, c: r * r + c * c <= k * k}[contiguity]
    return [(r, c, 1.0) for r in range(-k, k + 1) for c in range(-k, k + 1) if inside(r, c) and (include_self or r or c)]


def decay_kernel(distance_px: float) -> list[tuple[int, int, float]]:
    """exp(-r / d) over a square of three decay lengths."""
    n = max(math.ceil(3 * distance_px), 1)
    return [(r, c, math.exp(-math.hypot(r, c) / distance_px)) for r in range(-n, n + 1) for c in range(-n, n + 1)]


def neighbour_sums(grid: DataFrame, offsets: list[tuple[int, int, float]], **sums) -> DataFrame:
    """Per cell of ``grid``: for each name, the weighted sum of an expression over its neighbours; outside counts as 0."""
    spread = grid.select("row", "col", *[F.coalesce(x, F.lit(0.0)).alias(n) for n, x in sums.items()])
    o = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(float(w)).alias("w")) for r, c, w in offsets]))
    spread = spread.withColumn("_o", o)
    parts = spread.select((F.col("row") - F.col("_o.r")).alias("row"), (F.col("col") - F.col("_o.c")).alias("col"), *[(F.col(n) * F.col("_o.w")).alias(n) for n in sums])
    return grid.join(parts.groupBy("row", "col").agg(*[F.sum(n).alias(n) for n in sums]), ["row", "col"], "left")


def gaussian_blur(grid: DataFrame, layer: str, sigma: float, out: str = "blurred", truncate: float = 4.0) -> DataFrame:
    """Adds ``out``: a Gaussian mean of standard deviation ``sigma`` cells, cut at ``truncate`` deviations.

    The grid's edge repeats itself; a gap within reach makes a gap.  The kernel is separable: each pass sends a value
    to the 2 r + 1 cells along one axis, an edge cell with the weights of all cells beyond it.
    """
    if sigma <= 0:
        return grid.withColumn(out, F.col(layer).cast("double"))
    r = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-r, r + 1)]
    w = [x / sum(raw) for x in raw]
    below = [sum(w[: k + 1]) for k in range(2 * r + 1)]
    table = lambda v: F.array(*[F.lit(float(x)) for x in v])
    x = grid.select("row", "col", F.col(layer).cast("double").alias("_v"))
    ends = grid.agg(*[f(a).alias(f"{n}_{a}") for a in ("row", "col") for n, f in (("lo", F.min), ("hi", F.max))]).first()
    for axis, other in (("row", "col"), ("col", "row")):
        x = x.withColumns({"_lo": F.lit(ends[f"lo_{axis}"]), "_hi": F.lit(ends[f"hi_{axis}"])})
        x = x.withColumn("_to", F.explode(F.sequence(F.greatest(F.col(axis) - r, "_lo"), F.least(F.col(axis) + r, "_hi"))))
        k = F.col(axis) - F.col("_to") + r  # place of the source in the kernel of its target
        low, high = F.col(axis) == F.col("_lo"), F.col(axis) == F.col("_hi")
        weight = F.when(low & high, 1.0).when(low, table(below)[k]).when(high, table(below)[2 * r - k]).otherwise(table(w)[k])
        x = x.withColumn("_w", weight).groupBy(F.col("_to").alias(axis), other).agg(F.sum(F.col("_v") * F.col("_w")).alias("_v"), F.sum(F.when(F.col("_v").isNotNull(), F.col("_w"))).alias("_w"))
        x = x.select("row", "col", F.when(F.col("_w") > 1 - 1e-9, F.col("_v")).alias("_v"))
    return grid.join(x.withColumnRenamed("_v", out), ["row", "col"], "left")


def square_sums(grid: DataFrame, k: int, **sums) -> DataFrame:
    """The same for a full square of half-width ``k``, by two sliding windows."""
    along_row = Window.partitionBy("row").orderBy("col").rangeBetween(-k, k)
    along_col = Window.partitionBy("col").orderBy("row").rangeBetween(-k, k)
    x = grid.withColumns({f"_{n}": F.sum(F.coalesce(e, F.lit(0.0))).over(along_row) for n, e in sums.items()})
    return x.withColumns({n: F.sum(f"_{n}").over(along_col) for n in sums}).drop(*[f"_{n}" for n in sums])


def getis_ord(grid: DataFrame, layer: str = "lst", out: str = "gistar_z", k: int = 1, contiguity: str = "queen", source: DataFrame | None = None) -> DataFrame:
    """Gi* z-scores, self included; 0 where the layer does not vary, NULL for gaps and fewer than two cells.

    ``source`` may be a cheaper table with the same cells and layer, for the global scalars.
    """
    x = F.col(layer)
    sums = {"_wx": x, "_w": F.when(x.isNotNull(), 1.0)}
    s = square_sums(grid, k, **sums) if contiguity == "queen" else neighbour_sums(grid, kernel(k, contiguity), **sums)
    g = (source if source is not None else grid).agg(F.count(layer).alias("_n"), F.avg(layer).alias("_m"), F.stddev_pop(layer).alias("_s"))
    s = s.crossJoin(F.broadcast(g))
    inner = (F.col("_n") * F.col("_w") - F.col("_w") ** 2) / F.nullif(F.col("_n") - 1, F.lit(0))
    below = F.col("_s") * F.sqrt(F.greatest(inner, F.lit(0.0)))
    z = F.when(below > 0, (F.col("_wx") - F.col("_m") * F.col("_w")) / F.nullif(below, F.lit(0.0))).otherwise(0.0)
    return s.withColumn(out, F.when(x.isNotNull() & (F.col("_n") >= 2), z)).drop("_wx", "_w", "_n", "_m", "_s")


def local_moran(grid: DataFrame, layer: str = "lst", k: int = 1, contiguity: str = "queen", source: DataFrame | None = None) -> DataFrame:
    """Adds moran_i and moran_local: 0 not significant, 1 high-high, 2 low-low, 3 high-low, 4 low-high; ``source`` as in ``getis_ord``."""
    x = F.col(layer)
    told = source if source is not None else grid
    s = told.agg(F.count(layer), F.avg(layer)).first()
    about = x - F.lit(s[1]).cast("double")
    m = told.agg(F.avg(about**2), F.avg(about**4)).first()  # both depend on the layer alone
    scalars = zip(("_n", "_m2", "_m4"), (F.lit(float(s[0])), *(F.lit(v).cast("double") for v in m)), strict=True)
    d = grid.withColumn("_d", about).withColumns(dict(scalars))
    sums = {"_lag": F.col("_d"), "_w": F.when(x.isNotNull(), 1.0)}
    if contiguity == "queen":  # a full square less its centre
        d = square_sums(d, k, **sums).withColumns({"_lag": F.col("_lag") - F.coalesce("_d", F.lit(0.0)), "_w": F.col("_w") - F.when(x.isNotNull(), 1.0).otherwise(0.0)})
    else:
        d = neighbour_sums(d, kernel(k, contiguity, include_self=False), **sums)
    mean = F.col("_lag") / F.nullif("_w", F.lit(0.0))
    i = F.col("_d") * mean / F.nullif("_m2", F.lit(0.0))
    n, e = F.col("_n"), -1.0 / F.nullif(F.col("_n") - 1, F.lit(0))
    b2 = F.col("_m4") / F.nullif(F.col("_m2") ** 2, F.lit(0.0))
    var = (n - b2) / (n - 1) - (2 * b2 - n) / F.nullif((n - 1) * (n - 2), F.lit(0)) - e**2
    z = (i - e) / F.sqrt(F.when(var > 0, var))
    high, near = F.col("_d") > 0, mean > 0
    code = F.when(high & near, 1).when(~high & ~near, 2).when(high & ~near, 3).otherwise(4)
    d = d.withColumn("moran_i", F.when(x.isNotNull(), i)).withColumn("moran_local", F.when(x.isNotNull() & (F.abs(z) >= 1.96), code).otherwise(0))
    return d.drop("_n", "_d", "_lag", "_w", "_m2", "_m4")


def surface_hotspots(grid: DataFrame, percentile: str = "lst_percentile", z: str = "gistar_z", most: float = 90.0, least_z: float = 1.96) -> DataFrame:
    """Adds hotspot_mask: 1 where both the rank and the cluster score are high, else 0, gaps included."""
    hot = (F.col(percentile) >= most) & (F.col(z) >= least_z)
    return grid.withColumn("hotspot_mask", F.coalesce(hot, F.lit(False)).cast("int"))
