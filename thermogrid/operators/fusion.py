"""Fusion of several estimates per cell, in long form: row, col, source, value, sigma."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL = ["row", "col"]


def long_form(grid: DataFrame, layers: list[str], sigmas: dict[str, float] | None = None) -> DataFrame:
    """One row per cell and layer."""
    long = grid.select(*CELL, *layers).unpivot(CELL, layers, "source", "value")
    if sigmas:
        pairs = [x for k, v in sigmas.items() for x in (F.lit(k), F.lit(float(v)))]
        long = long.withColumn("sigma", F.create_map(*pairs)[F.col("source")])
    return long


def inverse_variance(estimates: DataFrame) -> DataFrame:
    """Weighted mean and its sigma per cell; gaps, and sigmas that are not above 0 and finite, take no part."""
    good = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")) & (F.col("sigma") > 0) & ~F.isnan("sigma") & (F.col("sigma") < float("inf"))
    w = F.when(good, 1.0 / F.nullif(F.col("sigma") * F.col("sigma"), F.lit(0.0)))
    g = estimates.groupBy(*CELL).agg(F.sum(w * F.col("value")).alias("_v"), F.sum(w).alias("_w"))
    return g.select(*CELL, (F.col("_v") / F.nullif("_w", F.lit(0.0))).alias("fused"), F.sqrt(1.0 / F.nullif("_w", F.lit(0.0))).alias("fused_sigma"))


def agreement(estimates: DataFrame) -> DataFrame:
    """Mean, population deviation and number of sources within 1 of the median, per cell."""
    m = estimates.groupBy(*CELL).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread"), F.median("value").alias("_m"), F.collect_list("value").alias("_all"))
    close = F.size(F.filter("_all", lambda v: F.abs(v - F.col("_m")) <= 1.0))
    return m.select(*CELL, "mean", "spread", close.cast("long").alias("agree"))


def majority_vote(estimates: DataFrame) -> DataFrame:
    """The most frequent rounded class (half to even), the smallest of ties, with its share; (NULL, 0) for no votes."""
    votes = estimates.withColumn("_c", F.rint("value")).groupBy(*CELL, "_c").agg(F.count("value").alias("_n"))
    best = votes.groupBy(*CELL).agg(F.max(F.when(F.col("_n") > 0, F.struct("_n", (-F.col("_c")).alias("_c")))).alias("_b"), F.sum("_n").alias("_all"))
    return best.select(*CELL, (-F.col("_b._c")).cast("long").alias("class"), F.coalesce(F.col("_b._n") / F.nullif("_all", F.lit(0)), F.lit(0.0)).alias("share"))


def triple_collocation(grid: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """Error variances and inverse-variance weights of three layers from their sample covariances, in one aggregate."""
    x = grid.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(c).isNotNull())
    m = x.agg(F.count("*").alias("n"), *[F.covar_samp(p, q).alias(n) for n, p, q in (("aa", a, a), ("bb", b, b), ("cc", c, c), ("ab", a, b), ("ac", a, c), ("bc", b, c))])
    err = lambda s, p, q, r: F.greatest(F.col(s) - F.col(p) * F.col(q) / F.nullif(F.col(r), F.lit(0.0)), F.lit(1e-6))
    m = m.select("n", err("aa", "ab", "ac", "bc").alias("var_a"), err("bb", "ab", "bc", "ac").alias("var_b"), err("cc", "ac", "bc", "ab").alias("var_c"))
    total = 1 / F.col("var_a") + 1 / F.col("var_b") + 1 / F.col("var_c")
    return m.select("*", *[(1 / F.col(f"var_{k}") / total).alias(f"weight_{k}") for k in "abc"])


def reconcile(grid: DataFrame, layer: str, reference: str, out: str) -> DataFrame:
    """The layer with the mean and deviation of the reference."""
    s = grid.agg(*[f(x).alias(f"_{n}{k}") for k, x in (("l", layer), ("r", reference)) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    x = grid.crossJoin(F.broadcast(s))
    scale = F.when(F.col("_sl") > 0, F.col("_sr") / F.nullif("_sl", F.lit(0.0))).otherwise(1.0)
    return x.withColumn(out, (F.col(layer) - F.col("_ml")) * scale + F.col("_mr")).drop("_ml", "_sl", "_mr", "_sr")


def composite(scenes: DataFrame, keys: list[str], value: str, time: str, reducer: str = "median") -> DataFrame:
    """Temporal composite of a scene table: median, mean, min, max, or mosaic (the last value that is no gap, the largest of one moment)."""
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(time, value)))
    how = {"median": F.median(value), "mean": F.avg(value), "min": F.min(value), "max": F.max(value), "mosaic": last}
    if reducer not in how:
        raise ValueError(f"unknown reducer {reducer!r}; use one of {sorted(how)}")
    return scenes.groupBy(*keys).agg(how[reducer].alias(value))


def scene_filter(scenes: DataFrame, start: str, end: str, time: str = "ts") -> DataFrame:
    """Scenes from ``start`` up to but not including ``end``; reaches the scan as a pushed filter."""
    return scenes.filter((F.col(time) >= F.lit(start).cast("timestamp")) & (F.col(time) < F.lit(end).cast("timestamp")))


def deaccumulate(hourly: DataFrame, keys: list[str], value: str, time: str, out: str) -> DataFrame:
    """Rates from hourly accumulations: the difference to the hour before, or the value itself at hour 1, by 3600 s."""
    w = Window.partitionBy(*keys).orderBy(time)
    step = F.when(F.hour(time) == 1, F.col(value)).otherwise(F.col(value) - F.lag(value).over(w))
    return hourly.withColumn(out, step / 3600.0)
