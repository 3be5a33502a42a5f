"""Heat vulnerability and the layered priority of cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import column, human_stress_count, priority_class
from ..sources.shared import kept
from . import stats, stencil

#: Indicators of each domain with the sign that makes higher mean more vulnerable.  Fixed values.
DOMAINS: dict[str, dict[str, int]] = {
    "exposure": {"lst": 1, "suhii": 1, "utfvi": 1, "impervious_frac": 1, "ndvi": -1},
    "sensitivity": {"population": 1},
    "adaptive_capacity": {"ndvi": -1},
}


def _domain(columns: list[str], name: str) -> dict[str, int]:
    """The domain's indicators that the grid has; green_frac stands in for ndvi."""
    stand_in = lambda c: "green_frac" if c == "ndvi" and c not in columns else c
    return {c: s for c, s in ((stand_in(c), s) for c, s in DOMAINS[name].items()) if c in columns}


def _component(grid: DataFrame, features: list[str]) -> tuple[list[float], list[float]] | None:
    """(means, first principal axis) over rows without gaps, pointing with the mean feature; None for fewer than 3 rows."""
    whole = grid.select(*features).dropna()
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    s = whole.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)], *[F.covar_pop(features[i], features[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    if s["n"] < 3:
        return None
    cov = np.array([[s[f"c{min(i, j)}_{max(i, j)}"] for j in range(len(features))] for i in range(len(features))])
    axis = np.linalg.eigh(cov)[1][:, -1]
    if (cov @ axis).sum() < 0:  # the covariance of score and mean feature
        axis = -axis
    return [s[f"m{i}"] for i in range(len(features))], axis.tolist()


def _standard(grid: DataFrame, layers: dict, prefix: str) -> dict:
    """z-scores of expressions by one aggregate; 0 where an expression does not vary."""
    sums = [f(e).alias(f"{k}{i}") for i, e in enumerate(layers.values()) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    r = grid.agg(*sums).first()
    out = {}
    for i, (name, e) in enumerate(layers.items()):
        m, s = r[f"m{i}"], r[f"s{i}"]
        out[prefix + name] = (e - m) / s if s else F.when(e.isNotNull(), 0.0)
    return out


def heat_vulnerability(grid: DataFrame, method: str = "pca") -> DataFrame:
    """Adds hvi (0 to 1) and hvi_quintile (1 to 5).

    Each domain's indicators become z-scores with their sign; the domain's score is their first principal component
    (``pca``; gaps in any indicator make a gap) or their mean (``equal``, and domains of one indicator), again
    as z-score.  Domains weigh alike, a gap counts as 0.  Without any indicator hvi is 0.5.
    """
    domains = {n: signs for n in DOMAINS if (signs := _domain(grid.columns, n))}
    if not domains:
        return grid.withColumn("hvi", F.lit(0.5)).withColumn("hvi_quintile", F.lit(1))
    # scalars go through the driver as literals: nested scalar joins would double the plan at each step
    layers = sorted({c for signs in domains.values() for c in signs})
    grid = kept(grid, "vulnerability")
    x = grid.withColumns(_standard(grid, {c: F.col(c) for c in layers}, "_z_"))
    scores = {}
    for name, signs in domains.items():
        features = [sign * F.col(f"_z_{c}") for c, sign in signs.items()]
        fit = _component(x.select(*[f.alias(f"f{i}") for i, f in enumerate(features)]), [f"f{i}" for i in range(len(features))]) if method == "pca" and len(features) > 1 else None
        if fit:
            scores[name] = sum(((f - m) * w for f, m, w in zip(features, *fit, strict=True)), F.lit(0.0))
        else:
            some = sum((f.isNotNull().cast("int") for f in features), F.lit(0))
            scores[name] = sum((F.coalesce(f, F.lit(0.0)) for f in features), F.lit(0.0)) / F.nullif(some, F.lit(0))
    x = x.withColumns(_standard(x, scores, "_s_"))
    total = sum((F.coalesce(f"_s_{n}", F.lit(0.0)) for n in scores), F.lit(0.0)) / len(scores)
    x = x.withColumn("_sum", total).drop(*[f"_s_{n}" for n in scores], *[f"_z_{c}" for c in layers])
    r = x.agg(F.min("_sum").alias("lo"), F.max("_sum").alias("hi")).first()
    if r["lo"] is None or r["lo"] == r["hi"]:
        return x.withColumn("hvi", F.lit(0.5)).withColumn("hvi_quintile", F.lit(1)).drop("_sum")
    x = x.withColumn("hvi", (F.col("_sum") - r["lo"]) / (r["hi"] - r["lo"])).drop("_sum")
    return stats.quintiles(kept(x, "hvi"), "hvi", "hvi_quintile")


def layered_hotspots(grid: DataFrame, k: int = 1, contiguity: str = "queen", method: str = "pca") -> DataFrame:
    """Adds the surface score and mask, the human-stress score, hvi, and priority_score with its class.

    Layer A is the rank of the surface temperature and its significant clusters, layer B the share of five heat-stress
    indices over their limits (0 without air temperature and humidity), layer C half the larger of both and half hvi.
    """
    base = kept(grid if "hvi" in grid.columns else heat_vulnerability(grid, method), "layers")
    x = stencil.getis_ord(base, "lst", k=k, contiguity=contiguity)
    x = stencil.local_moran(x, "lst", k=k, contiguity=contiguity, source=base)
    x = stats.percentile_rank(x, "lst", "lst_percentile", source=base)
    x = stencil.surface_hotspots(x).withColumn("surface_score", F.col("lst_percentile"))
    if "human_stress_score" not in x.columns:
        met = {"air_temp", "rel_humidity"} <= set(x.columns)
        dew = "dewpoint" if "dewpoint" in x.columns else "air_temp"
        x = x.withColumn("human_stress_score", column(f"100.0 * {human_stress_count('air_temp', 'rel_humidity', dew)} / 5.0") if met else F.lit(0.0))
    hazard = F.greatest("surface_score", F.col("human_stress_score").cast("double"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 0.5 * hazard + 50.0 * F.col("hvi")))
    x = x.withColumn("priority_score", F.when(hazard.isNotNull() & F.col("hvi").isNotNull(), score))
    return x.withColumn("priority_class", column(priority_class("priority_score")))
