"""Global statistics of a layer: scores, ranks, heat-island intensity and classes.

Global scalars come from one aggregate that is cross-joined as a single row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formulas import column, eei_class
from ..sources.shared import kept


def with_scalars(grid: DataFrame, *aggregates: Column) -> DataFrame:
    """Each row with the results of global aggregates: one row is broadcast, whatever the input."""
    return grid.crossJoin(F.broadcast(grid.agg(*aggregates)))


def zscore(grid: DataFrame, layer: str, out: str) -> DataFrame:
    """Population z-score; 0 where the layer does not vary."""
    x = with_scalars(grid, F.avg(layer).alias("_m"), F.stddev_pop(layer).alias("_s"))
    value = F.when(F.col(layer).isNotNull(), F.when(F.col("_s") == 0, 0.0).otherwise((F.col(layer) - F.col("_m")) / F.col("_s")))
    return x.withColumn(out, value).drop("_m", "_s")


def minmax(grid: DataFrame, layer: str, out: str) -> DataFrame:
    """0 to 1; 0.5 where the layer does not vary."""
    x = with_scalars(grid, F.min(layer).alias("_lo"), F.max(layer).alias("_hi"))
    value = F.when(F.col(layer).isNotNull(), F.when(F.col("_hi") == F.col("_lo"), 0.5).otherwise((F.col(layer) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))))
    return x.withColumn(out, value).drop("_lo", "_hi")


@dataclass
class Wanted:
    """Quantiles of a layer (a name or an expression) over the rows where a condition holds."""

    layer: str | Column
    shares: list[float]
    where: Column | None = None

    def value(self) -> Column:
        x = (F.col(self.layer) if isinstance(self.layer, str) else self.layer).cast("double")
        return x if self.where is None else F.when(self.where, x)


def quantile_sets(grid: DataFrame, wanted: list[Wanted], small: int = 20_000, buckets: int = 512) -> list[list[float | None]]:
    """Exact quantiles by linear interpolation, gaps left out, of several layers and conditions in the same passes; None without values.

    The range of each is cut into buckets that are counted, and every bucket that holds a wanted rank is cut again,
    until it has at most ``small`` values or only one distinct value.  Only the values of such buckets are sorted, so
    no task and no driver ever holds a layer, however its values are spread.
    """
    if not wanted:
        return []
    values = grid.select(*[w.value().alias(f"v{k}") for k, w in enumerate(wanted)])
    s = values.agg(*[f(f"v{k}").alias(f"{n}{k}") for k in range(len(wanted)) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    long = values.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"v{k}").alias("v")) for k in range(len(wanted))])).alias("o")).select("o.*").filter(F.col("v").isNotNull())
    ranks = [sorted({r for q in w.shares for r in (math.floor(q * (s[f"n{k}"] - 1)), math.ceil(q * (s[f"n{k}"] - 1)))}) if s[f"n{k}"] else [] for k, w in enumerate(wanted)]
    found: list[dict[int, float]] = [{} for _ in wanted]
    # (which, low, high, values below low, values inside) of ranges that still hold wanted ranks
    ranges = [(k, s[f"lo{k}"], s[f"hi{k}"], 0, s[f"n{k}"]) for k in range(len(wanted)) if s[f"n{k}"]]
    while ranges:
        for k, lo, hi, before, inside in ranges:
            if lo == hi:
                found[k] |= {r: lo for r in ranks[k] if before <= r < before + inside}
        few = [g for g in ranges if g[1] < g[2] and g[4] <= small]
        ranges = [g for g in ranges if g[1] < g[2] and g[4] > small]

        def within(parts: list[tuple]) -> Column:
            return reduce(lambda x, y: x | y, [(F.col("k") == k) & F.col("v").between(lo, hi) for k, lo, hi, *_ in parts])

        if few:
            held: dict[int, list[float]] = {}
            for r in long.filter(within(few)).collect():  # at most ``small`` for each wanted rank
                held.setdefault(r["k"], []).append(r["v"])
            for k, lo, hi, before, inside in few:
                mine = sorted(v for v in held.get(k, []) if lo <= v <= hi)
                found[k] |= {r: mine[r - before] for r in ranks[k] if before <= r < before + inside}
        if not ranges:
            break
        place = F.lit(None).cast("int")
        for g, (k, lo, hi, _, _) in enumerate(ranges):
            step = F.least(F.lit(buckets - 1), F.floor((F.col("v") / 2 - lo / 2) / (hi / 2 - lo / 2) * buckets).cast("int"))
            place = F.when((F.col("k") == k) & F.col("v").between(lo, hi), g * buckets + step).otherwise(place)
        counted = long.withColumn("b", place).filter(F.col("b").isNotNull()).groupBy("b").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        parts: dict[int, list] = {}
        for r in counted.orderBy("b").collect():  # one row for each bucket
            parts.setdefault(r["b"] // buckets, []).append(r)
        nexts = []
        for g, (k, _, _, before, _) in enumerate(ranges):
            at = before
            for r in parts.get(g, []):
                if any(at <= q < at + r["n"] for q in ranks[k]):
                    nexts.append((k, r["lo"], r["hi"], at, r["n"]))
                at += r["n"]
        ranges = nexts
    out: list[list[float | None]] = []
    for k, w in enumerate(wanted):
        places = [q * (s[f"n{k}"] - 1) for q in w.shares]
        out.append([found[k][math.floor(p)] + (found[k][math.ceil(p)] - found[k][math.floor(p)]) * (p - math.floor(p)) for p in places] if s[f"n{k}"] else [None] * len(places))
    return out


def quantiles(grid: DataFrame, layer: str, shares: list[float], where: Column | None = None, small: int = 20_000, buckets: int = 512) -> list[float | None]:
    """``quantile_sets`` of one layer."""
    return quantile_sets(grid, [Wanted(layer, shares, where)], small, buckets)[0]


def _bucket(value: Column, edges: list[float]) -> Column:
    """The number of edges below a value, by halving: as many comparisons as the edges' number has bits."""
    if not edges:
        return F.lit(0)
    mid = len(edges) // 2
    return F.when(value <= edges[mid], _bucket(value, edges[:mid])).otherwise(mid + 1 + _bucket(value, edges[mid + 1 :]))


def percentile_rank(grid: DataFrame, layer: str, out: str, source: DataFrame | None = None, in_bucket: int = 200_000, most: int = 1024) -> DataFrame:
    """100 times the share of values at or below each value; gaps stay gaps.

    Equal values are counted first, and the counts written, so that the layer is worked out once for them.  They are then
    summed up bucket by bucket, so that no window spans all values: only one row per bucket meets in one place.  Buckets
    hold about ``in_bucket`` distinct values, between approximate quantiles, so their number (up to ``most``) follows
    the size.  ``source`` may be a cheaper table with the same cells and layer, for the counts.
    """
    grid = grid.drop(out)
    counts = (source if source is not None else grid).filter(F.col(layer).isNotNull()).groupBy(F.col(layer).alias("_v")).agg(F.count("*").alias("_n"))
    counts = kept(counts, "ranks")
    n = min(most, math.ceil(counts.count() / in_bucket))
    edges = counts.agg(F.percentile_approx(F.col("_v").cast("double"), [k / n for k in range(1, n)], 10 * n)).first()[0] if n > 1 else []
    counts = counts.withColumn("_b", _bucket(F.col("_v").cast("double"), sorted(set(edges or []))))
    sums = counts.groupBy("_b").agg(F.sum("_n").alias("_in"))
    before = sums.select("_b", (F.sum("_in").over(Window.orderBy("_b")) - F.col("_in")).alias("_before"), F.sum("_in").over(Window.partitionBy()).alias("_all"))
    inside = counts.withColumn("_up", F.sum("_n").over(Window.partitionBy("_b").orderBy("_v")))
    ranks = inside.join(F.broadcast(before), "_b").select("_v", (100.0 * (F.col("_up") + F.col("_before")) / F.col("_all")).alias(out))  # at most ``most`` rows
    return grid.join(ranks, grid[layer] == F.col("_v"), "left").drop("_v")


def running_sums(rows: DataFrame, order: str, ties: list[str], in_bucket: int = 200_000, **sums: str) -> DataFrame:
    """Adds, for each name, the sum of a column up to and with the row, by ``order`` descending and then ``ties``.

    As ``percentile_rank``, it sums bucket by bucket, and only one row per bucket meets in one place.
    """
    n = max(1, math.ceil(rows.count() / in_bucket))
    edges = rows.agg(F.percentile_approx(F.col(order).cast("double"), [k / n for k in range(1, n)], 10 * n)).first()[0] if n > 1 else []
    x = rows.withColumn("_b", _bucket(F.col(order).cast("double"), sorted(set(edges or []))))
    totals = x.groupBy("_b").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    later = Window.orderBy(F.desc("_b"))
    before = totals.select("_b", *[(F.sum(f"_t_{k}").over(later) - F.col(f"_t_{k}")).alias(f"_before_{k}") for k in sums])
    inside = Window.partitionBy("_b").orderBy(F.desc(order), *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumns({k: F.sum(c).over(inside) for k, c in sums.items()}).join(F.broadcast(before), "_b")  # one row for each bucket
    return x.withColumns({k: F.col(k) + F.col(f"_before_{k}") for k in sums}).drop("_b", *[f"_before_{k}" for k in sums])


def surface_uhi(grid: DataFrame, layer: str = "lst", lcz: str | None = "lcz", guard: bool = True) -> DataFrame:
    """Adds suhii: the layer less a rural reference.

    With zone classes the reference is the median over class 14, or over classes from 11 if there is none,
    and urban cells are those of classes 1 to 10; without, it is the median of all cells.  A reference above
    the urban median is replaced by the smaller of itself and the first quartile.
    """
    x = F.col(layer)
    if lcz is None:
        urban, low, other = F.lit(False), F.lit(False), F.lit(False)
    else:
        urban, low, other = F.col(lcz).between(1, 10), F.col(lcz) == 14, F.col(lcz) >= 11
    sets = [Wanted(layer, [0.5], where) for where in (low, other, urban)] + [Wanted(layer, [0.5, 0.25])]
    (in_low,), (in_other,), (high,), (all_, first) = quantile_sets(grid, sets)
    ref = next((v for v in (in_low, in_other, all_) if v is not None), None)
    if guard and lcz is not None and None not in (ref, high) and ref > high:
        ref = min(ref, first)
    return grid.withColumn("suhii", x - F.lit(ref).cast("double"))


def utfvi(grid: DataFrame, layer: str = "lst") -> DataFrame:
    """Adds utfvi (in kelvin) and its ecological class eei."""
    s = with_scalars(grid, (F.avg(layer) + 273.15).alias("_m"))
    return s.withColumn("utfvi", (F.col(layer) + 273.15 - F.col("_m")) / F.col("_m")).drop("_m").withColumn("eei", column(eei_class("utfvi")))


def quintiles(grid: DataFrame, layer: str, out: str) -> DataFrame:
    """1 plus the number of inner quintile edges a value lies above; 0 for a gap."""
    edges = quantiles(grid, layer, [0.2, 0.4, 0.6, 0.8])
    over = sum((F.col(layer) > F.lit(e)).cast("int") for e in edges)
    return grid.withColumn(out, F.when(F.col(layer).isNull(), 0).otherwise(1 + over))


def metric_panel(rows: DataFrame, truth: str = "y_true", guess: str = "y_pred", by: list[str] | None = None) -> DataFrame:
    """n, rmse, mae, bias, ubrmse, r2, nse, ccc and kge over pairs without gaps, in one aggregate."""
    t, p = F.col(truth).cast("double"), F.col(guess).cast("double")
    pairs = rows.filter(t.isNotNull() & p.isNotNull())
    e = p - t
    a = pairs.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.var_pop(t).alias("vt"), F.var_pop(p).alias("vp"), F.covar_pop(t, p).alias("c"), F.avg(t).alias("mt"), F.avg(p).alias("mp")
    )
    some = lambda x, y: x / F.nullif(y, F.lit(0.0))
    nse = 1 - some(F.col("mse"), F.col("vt"))
    r = some(F.col("c"), F.sqrt(F.col("vt") * F.col("vp")))
    kge = 1 - F.sqrt((r - 1) ** 2 + (some(F.sqrt("vp"), F.sqrt("vt")) - 1) ** 2 + (some(F.col("mp"), F.col("mt")) - 1) ** 2)
    ccc = some(2 * F.col("c"), F.col("vt") + F.col("vp") + (F.col("mt") - F.col("mp")) ** 2)
    return a.select(*(by or []), "n", F.sqrt("mse").alias("rmse"), "mae", "bias", F.sqrt(F.greatest(F.col("mse") - F.col("bias") ** 2, F.lit(0.0))).alias("ubrmse"), nse.alias("r2"), nse.alias("nse"), ccc.alias("ccc"), kge.alias("kge"))


def equity_weights(grid: DataFrame, population: str | None = "population", vulnerability: str | None = None, out: str = "weight") -> DataFrame:
    """Population times vulnerability, negatives as 0, over its mean; a missing layer counts as 1 and a gap has weight 0.

    All weights are 1 where the mean is not above 0.
    """
    parts = [F.greatest(F.col(c), F.lit(0.0)) if c else F.lit(1.0) for c in (population, vulnerability)]
    product = F.when(parts[0].isNotNull() & parts[1].isNotNull(), parts[0] * parts[1])
    x = with_scalars(grid.withColumn("_w", product), F.avg("_w").alias("_m"))
    value = F.when(F.col("_m") > 0, F.coalesce(F.col("_w") / F.col("_m"), F.lit(0.0))).otherwise(1.0)
    return x.withColumn(out, value).drop("_w", "_m")


def priority_score(grid: DataFrame, layer: str = "lst", weight: str = "weight", out: str = "priority") -> DataFrame:
    """The weight times the layer's place between its 5th and 95th percentiles, cut to 0 and 1; gaps stay gaps."""
    lo, hi = (F.lit(q).cast("double") for q in quantiles(grid, layer, [0.05, 0.95]))
    heat = F.when(hi > lo, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(layer) - lo) / (hi - lo)))).otherwise(0.0)
    return grid.withColumn(out, F.when(F.col(layer).isNotNull(), heat * F.col(weight)))
