"""Additive models of surface temperature, fitted from sums over the table.

Both models see the rows once: a linear one needs the sums of products of the predictors, a boosted one the numbers of
rows in each pair of bins.  With these sums every round of boosting, and every fold of a cross-validation, is worked
out without another pass, as the sums of all folds but one are the whole less that one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formulas import column
from ..operators import stats
from .features import signs

BINS = 24


@dataclass
class Additive:
    """A sum of one term for each predictor: a slope, or a step function of its bins."""

    predictors: list[str]
    base: float
    slopes: list[float] | None = None
    edges: list[list[float]] = field(default_factory=list)
    values: list[list[float]] = field(default_factory=list)
    importance: list[float] = field(default_factory=list)

    def term(self, j: int, name: str | None = None) -> str:
        """SQL for the share of a predictor; NULL at a gap."""
        x = name or self.predictors[j]
        if self.slopes is not None:
            return f"({self.slopes[j]!r} * {x})"
        arms = " ".join(f"WHEN {x} <= {e!r} THEN {v!r}" for e, v in zip(self.edges[j], self.values[j], strict=False))
        return f"CASE WHEN {x} IS NULL THEN NULL {arms} ELSE {self.values[j][-1]!r} END"

    def at(self, j: int, x: np.ndarray) -> np.ndarray:
        """The share of a predictor at given values."""
        if self.slopes is not None:
            return self.slopes[j] * x
        return np.asarray(self.values[j])[np.searchsorted(self.edges[j], x, side="left")]

    def array(self, x: np.ndarray) -> np.ndarray:
        """Predictions for rows of predictors."""
        return self.base + sum((self.at(j, x[:, j]) for j in range(len(self.predictors))), np.zeros(len(x)))

    def expression(self, layer: Callable[[str], str] = lambda k: k) -> str:
        """SQL for the prediction, from names of layers; fits where a surface model is asked for."""
        return "(" + " + ".join([repr(self.base), *[self.term(j, layer(p)) for j, p in enumerate(self.predictors)]]) + ")"

    def predict(self, grid: DataFrame, out: str = "lst_pred") -> DataFrame:
        """Adds the prediction, NULL where a predictor is a gap."""
        return grid.withColumn(out, column(self.expression()).cast("double"))

    def predict_with_sigma(self, grid: DataFrame, rmse: float, out: str = "lst_pred") -> DataFrame:
        """Adds the prediction and its uncertainty, the error of a cross-validation."""
        return self.predict(grid, out).withColumn(f"{out}_uncertainty", F.when(F.col(out).isNotNull(), F.lit(float(rmse))))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(self.__dict__),)], "model string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Additive:
        return cls(**json.loads(spark.read.parquet(path).first()[0]))


# --- linear ----------------------------------------------------------------------------------------------------


def moments(table: DataFrame, predictors: list[str], target: str, by: str | None = None) -> dict:
    """Sums of products of (1, predictors, target) over rows without gaps, by group: one aggregate of p squared sums."""
    names = [*predictors, target]
    known = table.dropna(subset=names)
    x = [F.lit(1.0), *[F.col(n).cast("double") for n in names]]
    k = len(x)
    sums = [F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    out = {}
    for r in known.groupBy(*([by] if by else [])).agg(*sums).collect():
        out[r[by] if by else None] = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    return out


def solve(s: np.ndarray, predictors: list[str]) -> Additive:
    """Least squares from the sums of products; a constant predictor gets slope 0."""
    a, b = s[:-1, :-1], s[:-1, -1]
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    w = np.linalg.lstsq(a / np.outer(scale, scale), b / scale, rcond=1e-10)[0] / scale
    spread = np.sqrt(np.maximum(np.diag(a)[1:] / a[0, 0] - (a[0, 1:] / a[0, 0]) ** 2, 0.0))
    weight = np.abs(w[1:]) * spread
    return Additive(list(predictors), float(w[0]), [float(v) for v in w[1:]], importance=[float(v) for v in weight / (weight.sum() or 1.0)])


def fit_linear(table: DataFrame, predictors: list[str], target: str = "lst") -> Additive:
    return solve(moments(table, predictors, target)[None], predictors)


# --- boosted stumps --------------------------------------------------------------------------------------------


def bin_edges(table: DataFrame, predictors: list[str], bins: int = BINS) -> list[list[float]]:
    """Inner edges of bins of about equal numbers of rows."""
    shares = [float(q) for q in np.linspace(0.05, 0.95, bins)]
    rows = table.agg(*[F.percentile_approx(F.col(p).cast("double"), shares, 2000).alias(p) for p in predictors]).first()
    return [sorted(set(rows[p] or [])) for p in predictors]


def bin_pairs(table: DataFrame, predictors: list[str], target: str, edges: list[list[float]], by: str | None = None) -> dict:
    """By group: (numbers of rows in each pair of bins, sums of the target in each bin, rows, sum and square sum of the target).

    Tasks add up whole matrices; their entries, as many as pairs of bins, are then summed across tasks.
    """
    sizes = [len(e) + 1 for e in edges]
    first = np.concatenate([[0], np.cumsum(sizes)])
    total = int(first[-1])
    names = [*predictors, target]
    key = F.coalesce(F.col(by).cast("int"), F.lit(-1)) if by else F.lit(0)
    known = table.dropna(subset=names).select(key.alias("g"), *[F.col(n).cast("double").alias(n) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            g = batch.column(0).to_numpy()
            y = batch.column(len(names)).to_numpy()
            at = np.stack([first[j] + np.searchsorted(edges[j], batch.column(j + 1).to_numpy(), side="left") for j in range(len(predictors))])
            for one in np.unique(g):
                rows = g == one
                m = found.setdefault(int(one), np.zeros((total + 1, total + 1)))
                hot = np.zeros((int(rows.sum()), total + 1))
                hot[np.arange(len(hot))[:, None], at[:, rows].T] = 1.0
                hot[:, total] = y[rows]
                m += hot.T @ hot
        for one, m in found.items():
            i, j = np.nonzero(np.triu(m))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), one, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m[i, j])], names=["g", "i", "j", "v"])

    sums = known.mapInArrow(run, "g int, i int, j int, v double").groupBy("g", "i", "j").agg(F.sum("v").alias("v"))
    out: dict = {}
    for r in sums.collect():  # as many rows as pairs of bins
        m = out.setdefault(r["g"] if by else None, np.zeros((total + 1, total + 1)))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["v"]
    return out


def boost(m: np.ndarray, predictors: list[str], edges: list[list[float]], rounds: int = 150, rate: float = 0.1, monotone: bool = True) -> Additive:
    """Boosted stumps from pairs of bins; a stump whose two sides differ against the physics of its driver is levelled."""
    sizes = [len(e) + 1 for e in edges]
    first = np.concatenate([[0], np.cumsum(sizes)])
    total = int(first[-1])
    pairs, ysum = m[:total, :total], m[:total, total]
    n_in = np.diag(pairs).copy()
    n = n_in[: sizes[0]].sum() if sizes else 0.0
    base = float(ysum[: sizes[0]].sum() / n) if n else 0.0
    want = [signs(predictors)[p] if monotone else 0 for p in predictors]
    f, gain = np.zeros(total), np.zeros(len(predictors))
    for _ in range(rounds if n else 0):
        residual = ysum - base * n_in - pairs @ f  # sums of what is left, bin by bin
        best = (1e-12, 0, 0, 0.0, 0.0)
        for j in range(len(predictors)):
            s, c = np.cumsum(residual[first[j] : first[j + 1]]), np.cumsum(n_in[first[j] : first[j + 1]])
            left, right = c[:-1], n - c[:-1]
            ok = (left > 0) & (right > 0)
            if not ok.any():
                continue
            low, high = s[:-1] / np.maximum(left, 1), (s[-1] - s[:-1]) / np.maximum(right, 1)
            better = np.where(ok, left * low**2 + right * high**2, 0.0)
            if want[j]:  # a step against the sign would be levelled: no gain
                better = np.where((high - low) * want[j] < 0, 0.0, better)
            k = int(better.argmax())
            if better[k] > best[0]:
                best = (better[k], j, k, low[k], high[k])
        _, j, k, low, high = best
        if best[0] <= 1e-12:
            break
        f[first[j] : first[j] + k + 1] += rate * low
        f[first[j] + k + 1 : first[j + 1]] += rate * high
        gain[j] += abs(high - low)
    values = [f[first[j] : first[j + 1]].tolist() for j in range(len(predictors))]
    return Additive(list(predictors), base, None, edges, values, (gain / (gain.sum() or 1.0)).tolist())


def fit_boosted(table: DataFrame, predictors: list[str], target: str = "lst", rounds: int = 150, rate: float = 0.1, monotone: bool = True, bins: int = BINS) -> Additive:
    edges = bin_edges(table, predictors, bins)
    sums = bin_pairs(table, predictors, target, edges)
    return boost(sums[None], predictors, edges, rounds, rate, monotone) if sums else Additive(list(predictors), 0.0, [0.0] * len(predictors), importance=[0.0] * len(predictors))


# --- validation ------------------------------------------------------------------------------------------------


def held_out_predictions(table: DataFrame, predictors: list[str], target: str = "lst", kind: str = "linear", fold: str = "fold", out: str = "y_pred", **options) -> DataFrame:
    """Adds for every row the prediction of the model that was fitted on the other folds: one pass for all of them."""
    if kind == "linear":
        sums, make = moments(table, predictors, target, fold), lambda m: solve(m, predictors)
    elif kind == "boosted":
        edges = bin_edges(table, predictors, options.pop("bins", BINS))
        sums, make = bin_pairs(table, predictors, target, edges, fold), lambda m: boost(m, predictors, edges, **options)
    else:
        raise ValueError(f"unknown model {kind!r}")
    whole, arms = sum(sums.values()), F.lit(None).cast("double")
    for f, part in sums.items():
        if f is not None and f >= 0 and len(sums) > 1:
            arms = F.when(F.col(fold) == f, column(make(whole - part).expression()).cast("double")).otherwise(arms)
    return table.withColumn(out, arms)


def block_cv(table: DataFrame, predictors: list[str], target: str = "lst", kind: str = "linear", **options) -> DataFrame:
    """The metric panel of every fold (column fold, from ``folds``), and its mean with fold NULL."""
    guessed = held_out_predictions(table, predictors, target, kind, **options)
    panel = stats.metric_panel(guessed, target, "y_pred", by=["fold"])
    numbers = [c for c in panel.columns if c != "fold"]
    mean = panel.agg(*[F.avg(c).cast(panel.schema[c].dataType).alias(c) for c in numbers]).select(F.lit(None).cast("int").alias("fold"), *numbers)
    return panel.unionByName(mean)
