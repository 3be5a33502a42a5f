"""What drives the surface temperature: importances, effects, families, signs, shares of variance, local slopes.

The models are sums of one term for each predictor, so the usual sampling estimates have exact forms: the Shapley
value of a predictor is its term less the term's mean, and the error after shuffling a predictor, averaged over all
shufflings, follows from a few moments.  Each is one aggregate over the table.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formulas import column
from ..operators import stats
from ..sources.shared import kept
from . import features
from .train import Additive, moments


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _known(table: DataFrame, model: Additive, *more: str) -> DataFrame:
    return table.dropna(subset=[*model.predictors, *more])


def permutation_importance(table: DataFrame, model: Additive, target: str = "lst") -> DataFrame:
    """feature, importance, pct: the rise of the mean squared error when a predictor is shuffled, averaged over all shufflings."""
    p = model.predictors
    x = _known(table, model, target).select(*[column(model.term(j)).alias(f"t{j}") for j in range(len(p))], (F.col(target) - column(model.expression())).alias("r"))
    sums = [F.avg(e).alias(n) for j in range(len(p)) for n, e in ((f"a{j}", F.col(f"t{j}")), (f"b{j}", F.col(f"t{j}") ** 2), (f"c{j}", F.col("r") * F.col(f"t{j}")))]
    s = x.agg(F.avg("r").alias("r"), *sums).first()
    # E (r + t - t')^2 - E r^2, with t' independent of the row
    rise = [2 * s[f"c{j}"] - 2 * s["r"] * s[f"a{j}"] + 2 * s[f"b{j}"] - 2 * s[f"a{j}"] ** 2 if s["r"] is not None else 0.0 for j in range(len(p))]
    return _ranked(table.sparkSession, p, rise, "permutation")


def _ranked(spark: SparkSession, names: list[str], weights: list[float], method: str, signed: list[float] | None = None) -> DataFrame:
    w = [max(float(v), 0.0) for v in weights]
    total = sum(w) or 1.0
    rows = sorted(((n, v, 100.0 * v / total, float(s), method) for n, v, s in zip(names, w, signed or [0.0] * len(w), strict=True)), key=lambda r: (-r[1], r[0]))
    return _table(spark, [(k, *r) for k, r in enumerate(rows, 1)], "rank int, feature string, importance double, pct double, mean_signed double, method string")


def shapley_importance(table: DataFrame, model: Additive) -> DataFrame:
    """feature, importance (mean absolute Shapley value), pct, mean_signed (the change of the term over the range of its predictor)."""
    x = _known(table, model).select(*[column(model.term(j)).alias(f"t{j}") for j in range(len(model.predictors))], *model.predictors)
    n = range(len(model.predictors))
    m = x.agg(*[F.avg(f"t{j}").alias(f"t{j}") for j in n], *[f(p).alias(f"{k}{j}") for j, p in enumerate(model.predictors) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    if not model.predictors or m["lo0"] is None:
        return _ranked(table.sparkSession, model.predictors, [0.0] * len(model.predictors), "shapley")
    d = x.agg(*[F.avg(F.abs(F.col(f"t{j}") - F.lit(m[f"t{j}"]))).alias(f"d{j}") for j in n]).first()
    ends = [model.at(j, np.array([m[f"lo{j}"], m[f"hi{j}"]], float)) for j in n]
    return _ranked(table.sparkSession, model.predictors, [d[f"d{j}"] for j in n], "shapley", [float(e[1] - e[0]) for e in ends])


def shapley_values(table: DataFrame, model: Additive) -> DataFrame:
    """Adds shap_<predictor> for every row: its term less the term's mean."""
    x = table.withColumns({f"shap_{p}": column(model.term(j)) for j, p in enumerate(model.predictors)})
    m = _known(x, model).agg(*[F.avg(f"shap_{p}").alias(p) for p in model.predictors]).first()
    return x.withColumns({f"shap_{p}": F.col(f"shap_{p}") - F.lit(m[p]) for p in model.predictors})


def accumulated_effects(table: DataFrame, model: Additive, bins: int = 20, wanted: list[str] | None = None) -> DataFrame:
    """feature, k, x, effect: the accumulated local effect at the edges of bins of equal numbers of rows, its mean 0."""
    names = [p for p in wanted or model.predictors if p in model.predictors]
    known, rows = _known(table, model), []
    found = stats.quantile_sets(known, [stats.Wanted(p, [k / bins for k in range(bins + 1)]) for p in names])
    for p, quantiles in zip(names, found, strict=True):
        j = model.predictors.index(p)
        edges = sorted({float(q) for q in quantiles if q is not None})
        if len(edges) < 2:
            rows += [(p, 0, e, 0.0) for e in edges]
            continue
        place = sum(((F.col(p) > F.lit(e)).cast("int") for e in edges[1:-1]), F.lit(0))
        count = {r["b"]: r["n"] for r in known.groupBy(place.alias("b")).agg(F.count("*").alias("n")).collect()}
        effect = model.at(j, np.array(edges)) - model.at(j, np.array(edges[:1]))
        weight = np.array([count.get(b, 0) for b in range(len(edges) - 1)], float)
        effect = effect - float(((effect[:-1] + effect[1:]) / 2 * weight).sum() / max(weight.sum(), 1.0))
        rows += [(p, k, e, float(v)) for k, (e, v) in enumerate(zip(edges, effect, strict=True))]
    return _table(table.sparkSession, rows, "feature string, k int, x double, effect double")


def partial_dependence(table: DataFrame, model: Additive, points: int = 20, wanted: list[str] | None = None) -> DataFrame:
    """feature, k, x, effect at equal steps over each predictor's range, its mean over the points 0."""
    names = [p for p in wanted or model.predictors if p in model.predictors]
    m = _known(table, model).agg(*[f(p).alias(f"{k}{p}") for p in names for k, f in (("lo_", F.min), ("hi_", F.max))]).first()
    rows = []
    for p in names:
        if m[f"lo_{p}"] is None:
            continue
        x = np.linspace(float(m[f"lo_{p}"]), float(m[f"hi_{p}"]), points)
        y = model.at(model.predictors.index(p), x)
        rows += [(p, k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y - y.mean(), strict=True))]
    return _table(table.sparkSession, rows, "feature string, k int, x double, effect double")


def by_family(importances: DataFrame) -> DataFrame:
    """family, importance, pct: importances summed by family of drivers; ``other`` only where it is not 0."""
    of = {p: f for f, members in features.FAMILIES.items() for p in members}
    lookup = F.create_map(*[F.lit(v) for pair in of.items() for v in pair])
    known = importances.select(F.coalesce(lookup[F.col("feature")], F.lit("other")).alias("family"), "importance")
    none = _table(importances.sparkSession, [(f, 0.0) for f in features.FAMILIES], "family string, importance double")
    g = known.unionByName(none).groupBy("family").agg(F.sum("importance").alias("importance")).filter("family <> 'other' OR importance > 0")
    return stats.with_scalars(g, F.sum("importance").alias("_all")).select("family", "importance", (100.0 * F.col("importance") / F.coalesce(F.nullif("_all", F.lit(0.0)), F.lit(1.0))).alias("pct"))


def sign_audit(importances: DataFrame) -> DataFrame:
    """feature, expected_sign, observed_sign, ok, of the drivers for which the energy balance has a sign; no effect is no breach."""
    lookup = F.create_map(*[F.lit(v) for pair in features.SIGNS.items() for v in pair])
    x = importances.select("feature", lookup[F.col("feature")].alias("expected_sign"), F.signum("mean_signed").cast("int").alias("observed_sign")).filter("expected_sign <> 0")
    return x.withColumn("ok", (F.col("observed_sign") == F.col("expected_sign")) | (F.col("observed_sign") == 0))


def variance_partition(table: DataFrame, predictors: list[str], target: str = "lst", most_exact: int = 16, orders: int = 64, seed: int = 0) -> DataFrame:
    """feature, importance (share of R2), pct: a predictor's rise of R2 averaged over the orders in which predictors may enter.

    All subsets are used up to ``most_exact`` predictors, ``orders`` random orders beyond.  One aggregate gives the
    covariances from which every R2 follows.
    """
    s = moments(table, predictors, target).get(None)
    p = len(predictors)
    if s is None or s[0, 0] < 3 or not p:
        return _ranked(table.sparkSession, predictors, [0.0] * p, "variance")
    n, mean = s[0, 0], s[0, 1:] / s[0, 0]
    cov = s[1:, 1:] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    r = cov / np.outer(scale, scale)
    known: dict[tuple, float] = {(): 0.0}

    def r2(cols: tuple) -> float:
        if cols not in known:
            at = list(cols)
            known[cols] = max(0.0, float(r[p, at] @ np.linalg.lstsq(r[np.ix_(at, at)], r[at, p], rcond=1e-10)[0]))
        return known[cols]

    share = np.zeros(p)
    if p <= most_exact:
        for k in range(p):
            for rest in combinations([j for j in range(p)], k):
                for j in set(range(p)) - set(rest):
                    share[j] += (r2(tuple(sorted((*rest, j)))) - r2(rest)) / (p * comb(p - 1, k))
    else:
        rng = np.random.default_rng(seed)
        for _ in range(orders):
            used: tuple = ()
            for j in rng.permutation(p).tolist():
                now = tuple(sorted((*used, j)))
                share[j] += (r2(now) - r2(used)) / orders
                used = now
    return _ranked(table.sparkSession, predictors, share.tolist(), "variance")


def agreement(a: DataFrame, b: DataFrame, top: int = 5) -> tuple[dict, DataFrame]:
    """Whether two rankings (feature, importance) name the same leading drivers: (jaccard, spearman and the shared ones; per feature)."""
    ranks = []
    for x in (a, b):
        rows = sorted(x.select("feature", "importance").collect(), key=lambda r: (-r[1], r[0]))  # one row for each predictor
        ranks.append({r[0]: k for k, r in enumerate(rows, 1)})
    tops = [{f for f, k in r.items() if k <= top} for r in ranks]
    both = sorted(set(ranks[0]) & set(ranks[1]))
    rho = float("nan")
    if len(both) >= 2:
        u, v = (np.array([r[f] for f in both], float) for r in ranks)
        rho = float(np.corrcoef(u, v)[0, 1])
    union = tops[0] | tops[1]
    per = [(f, ranks[0].get(f), ranks[1].get(f), f in tops[0] and f in tops[1]) for f in sorted(set(ranks[0]) | set(ranks[1]))]
    return {"top": top, "jaccard": len(tops[0] & tops[1]) / len(union) if union else 0.0, "spearman": rho, "agreed": sorted(tops[0] & tops[1])}, _table(a.sparkSession, per, "feature string, rank_a int, rank_b int, agree boolean")


def local_slopes(grid: DataFrame, predictors: list[str], target: str = "lst", n: int = 16, bandwidth: float | None = None) -> DataFrame:
    """Adds slope_<predictor>, dominant (its number) and local_r2: least squares weighted by distance (Gaussian).

    The weights are taken between ``n`` by ``n`` blocks, not single cells: every block gives its sums of products once,
    and each block's slopes come from the weighted sums of all.  Cells of one block share their slopes.  Predictors
    have mean 0 and deviation 1 over the grid; the bandwidth is a quarter of the diagonal unless given (in cells).
    """
    names = features.resolve(grid, predictors, target)
    table = features.feature_table(grid, names, target, standardise=True)
    mean = table.agg(F.avg(target)).first()[0]
    centred = features.blocks(table.withColumn(target, F.col(target) - F.lit(mean)), n)
    p = len(names)
    x = [*[F.col(c) for c in names], F.col(target)]
    sums = [F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(p + 1) for j in range(i, p + 1)]
    rows = centred.groupBy("block").agg(F.avg("row").alias("r"), F.avg("col").alias("c"), *sums).orderBy("block").collect()  # n * n blocks
    if not rows or not p:
        return grid
    at = np.array([(r["r"], r["c"]) for r in rows])
    s = np.array([[[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(p + 1)] for i in range(p + 1)] for r in rows])
    span = grid.agg(F.max("row") - F.min("row"), F.max("col") - F.min("col")).first()
    h = bandwidth or max(0.25 * float(np.hypot(*[float(v or 0) for v in span])), 1e-6)
    weight = np.exp(-0.5 * ((at[:, None] - at[None]) ** 2).sum(-1) / h**2)
    out = []
    for r, w in zip(rows, weight, strict=True):
        m = np.tensordot(w, s, 1)
        b = np.linalg.lstsq(m[:p, :p], m[:p, p], rcond=1e-10)[0]
        left = m[p, p] - 2 * b @ m[:p, p] + b @ m[:p, :p] @ b
        out.append((r["block"], *map(float, b), int(np.abs(b).argmax()), float(max(0.0, 1 - left / m[p, p])) if m[p, p] else 0.0))
    schema = "block long, " + ", ".join(f"slope_{c} double" for c in names) + ", dominant int, local_r2 double"
    local = _table(grid.sparkSession, out, schema)
    # the block of any cell follows from its place; cells of blocks without data take no slopes
    s0 = table.agg(F.min("col").alias("x0"), F.max("col").alias("x1"), F.min("row").alias("y0"), F.max("row").alias("y1")).first()
    sx, sy = (max(float(s0[f"{a}1"] - s0[f"{a}0"]), 1e-9) / n for a in ("x", "y"))
    columns = int(max(float(s0["x1"] - s0["x0"]), 1e-9) / sx) + 1
    place = F.floor((F.col("row") - F.lit(s0["y0"])) / F.lit(sy)) * columns + F.floor((F.col("col") - F.lit(s0["x0"])) / F.lit(sx))
    return grid.withColumn("block", place.cast("long")).join(F.broadcast(local), "block", "left").drop("block")  # n * n rows


def _local_fits(known: np.ndarray, x: np.ndarray, y: np.ndarray, inner: tuple[slice, slice], halo: int, neighbours: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether the halo was wide enough, coefficients with the intercept first, R2) of the inner cells of a tile with its halo.

    A cell's bandwidth is the distance of its ``neighbours``-th nearest known cell, itself among them; weights are
    (1 - (d / bandwidth)^2)^2 within it.
    """
    offsets = np.array([(r, c) for r in range(-halo, halo + 1) for c in range(-halo, halo + 1)])
    distance = np.hypot(*offsets.T)
    order = np.argsort(distance, kind="stable")
    offsets, distance = offsets[order], distance[order]
    rows, cols = (g.ravel() for g in np.mgrid[inner])
    n, p = len(rows), x.shape[2]
    enough, beta, r2 = np.zeros(n, bool), np.full((n, p + 1), np.nan), np.full(n, np.nan)
    for a in range(0, n, 256):  # bounds the memory
        r, c = rows[a : a + 256, None] + offsets[None, :, 0], cols[a : a + 256, None] + offsets[None, :, 1]
        near = known[r, c]
        count = near.cumsum(1)
        reach = (count >= neighbours).argmax(1)
        bandwidth = np.where(count[:, -1] >= neighbours, distance[reach], np.inf)
        enough[a : a + 256] = bandwidth <= halo
        h = np.where(np.isfinite(bandwidth) & (bandwidth > 0), bandwidth, 1.0)[:, None]
        w = np.where(near & (distance[None] < h), (1.0 - np.minimum(distance[None] / h, 1.0) ** 2) ** 2, 0.0)
        design = np.concatenate([np.ones((*r.shape, 1)), np.where(near[..., None], x[r, c], 0.0)], axis=2)
        target = np.where(near, y[r, c], 0.0)
        left, right = np.einsum("nm,nmi,nmj->nij", w, design, design), np.einsum("nm,nmi,nm->ni", w, design, target)
        b = np.einsum("nij,nj->ni", np.linalg.pinv(left, rcond=1e-10, hermitian=True), right)
        total = w.sum(1)
        mean = (w * target).sum(1) / np.maximum(total, 1e-300)
        rest = (w * (target - np.einsum("nmi,ni->nm", design, b)) ** 2).sum(1)
        spread = (w * (target - mean[:, None]) ** 2).sum(1)
        beta[a : a + 256] = b
        r2[a : a + 256] = np.where(spread > 0, np.maximum(0.0, 1.0 - rest / np.maximum(spread, 1e-300)), 0.0)
    return enough, beta, r2


def local_regression(grid: DataFrame, predictors: list[str], target: str = "lst", neighbours: int = 60, tile: int = 48, standardise: bool = True) -> DataFrame:
    """Adds slope_<predictor>, dominant (its number) and local_r2 at every cell: least squares over its nearest known cells.

    The bandwidth follows the data: it reaches to the ``neighbours``-th nearest cell without a gap.  Tiles are fitted with a
    halo of cells around them; where the halo turns out too narrow, as beside large gaps, the cell is fitted
    again with one twice as wide, until none is left.  Predictors have mean 0 and deviation 1 over the grid.
    """
    names = features.resolve(grid, predictors, target)
    table = features.feature_table(grid, names, target, standardise=standardise)
    extent = table.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.count("*").alias("n")).first()
    if not extent["n"] or not names:
        return grid
    neighbours = min(neighbours, extent["n"])
    widest = int(max(extent["r1"] - extent["r0"], extent["c1"] - extent["c0"])) + 1
    cells = kept(grid.select("row", "col").join(table.drop("x", "y"), ["row", "col"], "left"), "local")
    halo, p, done = max(2, int(np.ceil(np.sqrt(neighbours / np.pi) * 1.3)) + 1), len(names), None
    schema = "row int, col int, enough boolean, " + ", ".join(f"slope_{c} double" for c in names) + ", dominant int, local_r2 double"
    todo = None
    while True:
        # a gap far out can need a halo as wide as the grid is long, and twice that reaches everything
        last = halo > 2 * widest

        def fit(part):  # runs before halo changes, as its result is written at once
            tr, tc = int(part["_tr"].iloc[0]), int(part["_tc"].iloc[0])
            side = tile + 2 * halo
            known, x, y, ask = np.zeros((side, side), bool), np.zeros((side, side, p)), np.zeros((side, side)), np.zeros((side, side), bool)
            r, c = part["row"].to_numpy() - tr * tile + halo, part["col"].to_numpy() - tc * tile + halo
            values = part[[*names, target]].to_numpy(np.float64)
            full = ~np.isnan(values).any(1)
            known[r[full], c[full]] = True
            x[r[full], c[full]], y[r[full], c[full]] = values[full, :p], values[full, p]
            ask[r, c] = part["_ask"].to_numpy(bool)
            padded = [np.pad(v, [(halo, halo), (halo, halo), *([(0, 0)] if v.ndim == 3 else [])]) for v in (known, x, y)]
            inner = (slice(2 * halo, 2 * halo + tile), slice(2 * halo, 2 * halo + tile))
            enough, beta, r2 = _local_fits(*padded, inner, halo, neighbours)
            wanted = ask[halo : halo + tile, halo : halo + tile].ravel()
            rows, cols = (g.ravel() for g in np.mgrid[tr * tile : (tr + 1) * tile, tc * tile : (tc + 1) * tile])
            out = {"row": rows[wanted].astype("int32"), "col": cols[wanted].astype("int32"), "enough": enough[wanted] | last}
            out |= {f"slope_{n}": beta[wanted, 1 + j] for j, n in enumerate(names)}
            out |= {"dominant": np.abs(beta[wanted, 1:]).argmax(1).astype("int32"), "local_r2": r2[wanted]}
            return pd.DataFrame(out)

        asked = cells.withColumn("_ask", F.lit(True)) if todo is None else cells.join(todo.withColumn("_ask", F.lit(True)), ["row", "col"], "left").fillna(False, ["_ask"])
        spans = {k: F.sequence(F.floor((F.col(a) - halo) / tile).cast("int"), F.floor((F.col(a) + halo) / tile).cast("int")) for k, a in (("_tr", "row"), ("_tc", "col"))}
        dealt = asked.withColumn("_tr", F.explode(spans["_tr"])).withColumn("_tc", F.explode(spans["_tc"]))
        inside = (F.floor(F.col("row") / tile) == F.col("_tr")) & (F.floor(F.col("col") / tile) == F.col("_tc"))
        dealt = dealt.withColumn("_ask", F.col("_ask") & inside)
        if todo is not None:  # only tiles that have cells to fit
            dealt = dealt.join(todo.select(F.floor(F.col("row") / tile).cast("int").alias("_tr"), F.floor(F.col("col") / tile).cast("int").alias("_tc")).distinct(), ["_tr", "_tc"], "left_semi")
        got = kept(dealt.groupBy("_tr", "_tc").applyInPandas(fit, schema), "fits")
        fine = got.filter("enough").drop("enough")
        done = fine if done is None else done.unionByName(fine)
        todo = got.filter("NOT enough").select("row", "col")
        if last or todo.isEmpty():
            return grid.join(done, ["row", "col"], "left")
        halo *= 2


def residual_moran(grid: DataFrame, residual: str) -> DataFrame:
    """moran_i: the global autocorrelation of residuals over the eight neighbours of each cell, weights summing to 1 a cell."""
    from ..operators import stencil

    x = stats.with_scalars(grid.select("row", "col", F.col(residual).alias("_v")), F.avg("_v").alias("_m")).withColumn("_z", F.col("_v") - F.col("_m"))
    s = stencil.square_sums(x, 1, _s=F.col("_z"), _k=F.when(F.col("_z").isNotNull(), 1.0)).filter("_z IS NOT NULL")
    near = (F.col("_s") - F.col("_z")) / F.nullif(F.col("_k") - 1, F.lit(0.0))
    t = s.agg(F.count("*").alias("n"), F.count(near).alias("w"), F.sum(F.col("_z") * near).alias("a"), F.sum(F.col("_z") ** 2).alias("b"))
    value = F.when(F.col("n") >= 3, F.when(F.col("b") == 0, 0.0).otherwise(F.col("n") / F.nullif("w", F.lit(0)) * F.col("a") / F.nullif("b", F.lit(0.0))))
    return t.select("n", value.alias("moran_i"))
