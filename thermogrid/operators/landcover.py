"""Land cover from class probabilities over time, lookups by class, and temperatures by classes of water vapour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ("row", "col")
# The classes of land cover, in the order of their codes from 0.
CLASSES = ("water", "trees", "grass", "flooded_vegetation", "crops", "shrub_and_scrub", "built", "bare", "snow_and_ice")
# Shares of cover as sums of class probabilities.
COVER = {"impervious_frac": ("built",), "tree_frac": ("trees",), "green_frac": ("trees", "grass", "shrub_and_scrub", "crops"), "water_frac": ("water", "flooded_vegetation")}
# Statistical mono-window coefficients (A, B, C) by class of 6 kg/m2 of water vapour, for the thermal band of the eighth Landsat (Ermida and others, 2020).
MONO_WINDOW = (
    (0.9751, -205.8929, 212.7173), (1.0090, -232.2750, 230.5698), (1.0541, -253.1943, 238.9548), (1.1282, -279.4212, 244.0772), (1.1987, -307.4497, 251.8341),
    (1.3205, -348.0228, 257.2740), (1.4540, -393.1718, 263.5599), (1.6350, -451.0790, 268.9405), (1.5468, -429.5095, 275.0895), (1.9403, -547.2681, 277.9953),
)
VAPOUR_STEP = 6.0


def class_means(scenes: DataFrame, start: str | None = None, end: str | None = None, ts: str = "ts", classes: tuple[str, ...] = CLASSES, by: tuple[str, ...] = CELL) -> DataFrame:
    """``by`` and the mean probability of each class over the scenes from ``start`` up to ``end``; gaps take no part."""
    x = scenes
    if start is not None:
        x = x.filter(F.col(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        x = x.filter(F.col(ts) < F.lit(end).cast("timestamp"))
    return x.groupBy(*by).agg(*[F.avg(c).alias(c) for c in classes])


def likeliest(means: DataFrame, classes: tuple[str, ...] = CLASSES, out: str = "lulc") -> DataFrame:
    """Adds the code of the class of largest mean probability, the first of equal ones; without any a gap."""
    most = F.greatest(*classes) if len(classes) > 1 else F.col(classes[0])
    code = F.coalesce(*[F.when(F.col(c) == most, k) for k, c in enumerate(classes)])
    return means.withColumn(out, code.cast("int"))


def cover_fractions(means: DataFrame, factor: int = 1, groups: dict[str, tuple[str, ...]] = COVER) -> DataFrame:
    """row, col of cells ``factor`` times as wide, their shares of cover from 0 to 1, and known: how many fine cells had probabilities."""
    place = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in CELL]
    used = list(dict.fromkeys(c for cs in groups.values() for c in cs))
    cut = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    sums = {g: cut(sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cs), F.lit(0.0))) for g, cs in groups.items()}
    known = F.coalesce(*[F.col(c) for c in used]).isNotNull()
    return means.groupBy(*place).agg(*[F.avg(F.when(known, v)).alias(g) for g, v in sums.items()], F.count(F.when(known, 1)).alias("known"))


def looked_up(grid: DataFrame, code: str, table: dict[int, dict[str, float]]) -> DataFrame:
    """Adds the values that a small table has for each cell's class; an unknown class is a gap."""
    names = list(dict.fromkeys(n for row in table.values() for n in row))
    of = lambda n: F.create_map(*[F.lit(v) for k, row in table.items() if n in row for v in (int(k), float(row[n]))])
    return grid.withColumns({n: of(n)[F.col(code).cast("int")] for n in names})


def nearest_in_time(rows: DataFrame, series: DataFrame, values: list[str], ts: str = "ts", by: tuple[str, ...] = (), within_s: int = 3 * 3600) -> DataFrame:
    """Adds to each row the values of the series' entry nearest in time, at most ``within_s`` seconds away; the earlier of two as near.

    Times are cut into steps of ``within_s``: an entry goes to its step and the two beside it, so that the join is on equal
    steps.  Only the distinct times of ``rows`` are joined, and an aggregate with partial minima picks.  Entries with a gap
    in all values do not count; further columns of the series are left out.
    """
    second = F.col(ts).cast("timestamp").cast("double")
    step = F.floor(second / within_s)
    wanted = rows.select(ts, *by).filter(F.col(ts).isNotNull()).distinct().withColumn("_step", step)
    entries = series.filter(F.coalesce(*[F.col(v) for v in values]).isNotNull()).select(second.alias("_at"), *by, F.struct(*values).alias("_v"), F.explode(F.sequence(step - 1, step + 1)).alias("_step"))
    met = wanted.join(entries, ["_step", *by]).withColumn("_d", F.abs(F.col("_at") - second)).filter(F.col("_d") <= within_s)
    best = met.groupBy(ts, *by).agg(F.min_by("_v", F.struct("_d", "_at", "_v")).alias("_v"))
    return rows.join(best, [ts, *by], "left").select(*rows.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def statistical_mono_window(brightness_k: Column, emissivity: Column, vapour: Column, table: tuple = MONO_WINDOW) -> Column:
    """Surface temperature in degC: A / e * brightness + B / e + C, the coefficients by class of vapour, the last one open; a gap where anything is."""
    place = F.when(vapour.isNotNull(), F.greatest(F.lit(0), F.least(F.floor(vapour / VAPOUR_STEP), F.lit(len(table) - 1))))
    a, b, c = (F.get(F.array(*[F.lit(float(row[k])) for row in table]), place.cast("int")) for k in range(3))
    e = F.when(emissivity > 0, emissivity)
    return a * brightness_k / e + b / e + c - 273.15
