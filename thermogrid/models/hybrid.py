"""Physics first: a baseline by the energy balance whose error a learner takes over, and a network trained against the balance.

The hybrid model is a baseline in SQL plus a model of what it leaves.  Outside the range of its training rows the learner
is faded out, so that the model falls back to the physics.  The network sees the rows in mini-batches: each round,
tasks sum up the gradient of the loss over their rows, one aggregate adds the tasks' sums, and the driver, which holds
nothing but the weights, takes a step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formulas as M
from ..functions.formulas import column
from ..operators import stats
from ..sources.shared import kept
from . import forest, train
from .features import signs
from .train import Additive

# What stands in for a layer that a grid lacks.
DEFAULTS = {
    "air_temp": 30.0, "albedo": 0.18, "solar_radiation": 800.0, "longwave_down": 400.0, "emissivity": 0.95, "green_frac": 0.0, "tree_frac": 0.0, "water_frac": 0.0, "impervious_frac": 0.0,
    "soil_moisture": 0.2, "wind_speed": 2.0, "anthro_heat": 0.0,
}
_ORDER = ("air_temp", "albedo", "solar_radiation", "longwave_down", "emissivity", "green_frac", "tree_frac", "water_frac", "impervious_frac", "soil_moisture", "wind_speed", "anthro_heat")
Layer = Callable[[str], str]


def physics_baseline(have: list[str]) -> Callable[[Layer], str]:
    """The surface temperature by the energy balance as a surface model, from the layers that a grid has."""
    return lambda layer: M.physics_lst(*[layer(k) if k in have else repr(DEFAULTS[k]) for k in _ORDER])


@dataclass
class Hybrid:
    """``baseline`` plus ``learner``, faded by exp(- the distances beyond ``ranges``, in widths of the range)."""

    predictors: list[str]
    baseline: Callable[[Layer], str]
    learner: Additive | forest.Forest
    ranges: list[tuple[float, float]]

    def fade(self, layer: Layer = lambda k: k) -> str:
        beyond = [f"greatest({lo!r}D - {layer(p)}, {layer(p)} - {hi!r}D, 0.0D) / {max(hi - lo, 1e-9)!r}D" for p, (lo, hi) in zip(self.predictors, self.ranges, strict=True)]
        return f"exp(-({' + '.join(beyond) or '0.0D'}))"

    def expression(self, layer: Layer = lambda k: k) -> str:
        return f"({self.baseline(layer)} + {self.fade(layer)} * ({self.learner.expression(layer)}))"

    def predict(self, grid: DataFrame, out: str = "lst_pred") -> DataFrame:
        return grid.withColumn(out, column(self.expression()).cast("double"))


def with_residual(table: DataFrame, baseline: Callable[[Layer], str], target: str, out: str = "_residual") -> DataFrame:
    return table.withColumn(out, F.col(target) - column(baseline(lambda k: k)).cast("double"))


def _ranges(table: DataFrame, predictors: list[str], by: str | None = None) -> dict:
    sums = [f(p).cast("double").alias(f"{k}{j}") for j, p in enumerate(predictors) for k, f in (("lo", F.min), ("hi", F.max))]
    rows = table.groupBy(*([by] if by else [])).agg(*sums).collect()  # one row for each fold
    return {(r[by] if by else None): [(r[f"lo{j}"], r[f"hi{j}"]) for j in range(len(predictors))] for r in rows}


def _learners(table: DataFrame, predictors: list[str], kind: str, fold: str | None, options: dict) -> dict:
    """Models of ``_residual`` by the fold they have not seen, the one of all rows under None."""
    if kind == "forest":
        return forest.fit_forests(table, predictors, "_residual", fold, **options)
    if kind == "linear":
        sums, make = train.moments(table, predictors, "_residual", fold), lambda m: train.solve(m, predictors)
    elif kind == "boosted":
        edges = train.bin_edges(table, predictors, options.pop("bins", train.BINS))
        sums, make = train.bin_pairs(table, predictors, "_residual", edges, fold), lambda m: train.boost(m, predictors, edges, **options)
    else:
        raise ValueError(f"unknown learner {kind!r}")
    whole = sum(sums.values()) if sums else np.zeros((len(predictors) + 2,) * 2)
    return {None: make(whole)} | {f: make(whole - part) for f, part in sums.items() if f is not None and f >= 0 and len(sums) > 1}


def fit_hybrid(table: DataFrame, predictors: list[str], target: str = "lst", baseline: Callable[[Layer], str] | None = None, kind: str = "boosted", **options) -> Hybrid:
    """A hybrid model from a table that has the predictors, the target and the baseline's layers."""
    baseline = baseline or physics_baseline(table.columns)
    known = with_residual(table, baseline, target).dropna(subset=[*predictors, "_residual"])
    learner = _learners(known, predictors, kind, None, options)[None]
    ranges = _ranges(known, predictors)[None]
    return Hybrid(list(predictors), baseline, learner, [(lo or 0.0, hi or 0.0) for lo, hi in ranges])


def hybrid_cv(table: DataFrame, predictors: list[str], target: str = "lst", baseline: Callable[[Layer], str] | None = None, kind: str = "boosted", fold: str = "fold", **options) -> DataFrame:
    """The metric panel of every fold, from learners and ranges of the other folds, and its mean with fold NULL."""
    baseline = baseline or physics_baseline(table.columns)
    known = with_residual(table, baseline, target).dropna(subset=[*predictors, "_residual"])
    ranges, arms = _ranges(known, predictors, fold), F.lit(None).cast("double")
    for f, learner in _learners(known, predictors, kind, fold, options).items():
        if f is None:
            continue
        others = [r for g, r in ranges.items() if g != f]
        widest = [(min(r[j][0] for r in others), max(r[j][1] for r in others)) for j in range(len(predictors))]
        model = Hybrid(list(predictors), baseline, learner, widest)
        arms = F.when(F.col(fold) == f, column(model.expression()).cast("double")).otherwise(arms)
    guessed = kept(table.select(fold, target, arms.alias("y_pred")), "guessed")  # else the models are worked out for every measure
    panel = stats.metric_panel(guessed, target, "y_pred", by=[fold])
    numbers = [c for c in panel.columns if c != fold]
    return panel.unionByName(panel.agg(*[F.avg(c).cast(panel.schema[c].dataType).alias(c) for c in numbers]).select(F.lit(None).cast("int").alias(fold), *numbers))


# --- a network trained against the energy balance ------------------------------------------------------------------

SIGMA, KELVIN, RHO_CP, RESISTANCE = 5.670374419e-8, 273.15, 1.2 * 1005.0, 50.0
_DRIVERS = {"albedo": 0.2, "solar_radiation": 800.0, "longwave_down": 350.0, "emissivity": 0.96, "air_temp": 25.0}


@dataclass
class HeatNet:
    """One hidden layer of tanh units on standardised inputs; the output is standardised as the target is."""

    predictors: list[str]
    mean: np.ndarray
    scale: np.ndarray
    target_mean: float
    target_scale: float
    weights: np.ndarray  # hidden weights, hidden shifts, output weights, output shift, one after another
    hidden: int
    history: list[tuple] = field(default_factory=list)

    def parts(self, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        w, p, h = self.weights if w is None else w, len(self.predictors), self.hidden
        return w[: p * h].reshape(p, h), w[p * h : p * h + h], w[p * h + h : p * h + 2 * h], float(w[-1])

    def array(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.parts()
        return self.target_mean + self.target_scale * (np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2)

    def expression(self, layer: Layer = lambda k: k) -> str:
        w1, b1, w2, b2 = self.parts()
        units = []
        for h in range(self.hidden):
            inputs = [f"{float(w1[j, h] / self.scale[j])!r}D * ({layer(p)} - {float(self.mean[j])!r}D)" for j, p in enumerate(self.predictors)]
            units.append(f"{float(w2[h])!r}D * tanh({' + '.join([*inputs, f'{float(b1[h])!r}D'])})")
        return f"({self.target_mean!r}D + {self.target_scale!r}D * ({' + '.join([*units, f'{b2!r}D'])}))"

    def predict(self, grid: DataFrame, out: str = "lst_pred") -> DataFrame:
        return grid.withColumn(out, column(self.expression()).cast("double"))


def loss_and_gradient(net: HeatNet, w: np.ndarray, x: np.ndarray, y: np.ndarray, drivers: np.ndarray, want: np.ndarray, seb: float, mono: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums over rows: (data, balance and sign loss, rows) and the gradient of data + ``seb`` * balance + ``mono`` * sign.

    The balance is the net radiation at the predicted temperature less the sensible heat it drives, or less the net
    radiation that is given, in hundreds of W/m2.  The sign loss is the square of a slope against the physics of its driver.
    """
    w1, b1, w2, b2 = net.parts(w)
    a = np.tanh(x @ w1 + b1)
    d = 1.0 - a * a
    out = a @ w2 + b2
    error = out - (y - net.target_mean) / net.target_scale
    albedo, sun, down, emissivity, air, given = drivers.T
    t = net.target_mean + net.target_scale * out + KELVIN
    radiation = (1.0 - albedo) * sun + emissivity * (down - SIGMA * t**4)
    sensible = RHO_CP * (t - air - KELVIN) / RESISTANCE
    known = np.isfinite(given)
    balance = (radiation - np.where(known, given, sensible)) / 100.0
    slope_of_balance = (-4.0 * emissivity * SIGMA * t**3 - np.where(known, 0.0, RHO_CP / RESISTANCE)) / 100.0 * net.target_scale
    slopes = (d * w2) @ w1.T  # of the output, by input
    against = np.maximum(-want * slopes, 0.0)
    by_out = 2.0 * error + seb * 2.0 * balance * slope_of_balance
    by_slope = -mono * 2.0 * want * against
    # slopes depend on the hidden weights, the output weights and, through d, on the units' inputs
    reach = by_slope @ w1  # sum over inputs of by_slope * w1
    by_unit = by_out[:, None] * w2 * d + reach * w2 * (-2.0 * a * d)
    g1 = x.T @ by_unit + by_slope.T @ (d * w2)
    g2 = a.T @ by_out + (reach * d).sum(0)
    return np.array([(error**2).sum(), (balance**2).sum(), (against**2).sum(), len(y)]), np.concatenate([g1.ravel(), by_unit.sum(0), g2, [by_out.sum()]])


def fit_network(
    table: DataFrame, predictors: list[str], target: str = "lst", hidden: int = 8, epochs: int = 10, batches: int = 4, rate: float = 0.05, seb: float = 0.01, mono: float = 1.0, seed: int = 0
) -> HeatNet:
    """Trains by ``epochs`` times ``batches`` rounds; ``history`` has (round, loss, data, balance, sign) of every round.

    A row's batch is a hash of its values, so the batches, and up to rounding the result, are the same however the table is
    partitioned.  Layers of the balance that the table lacks have usual values; net_radiation is compared with if given.
    """
    names = list(predictors)
    given = F.col("net_radiation").cast("double") if "net_radiation" in table.columns else F.lit(float("nan"))
    drivers = [F.coalesce(F.col(k).cast("double"), F.lit(v)) if k in table.columns else F.lit(v) for k, v in _DRIVERS.items()]
    known = table.dropna(subset=[*names, target])
    s = known.agg(*[f(F.col(c).cast("double")).alias(f"{k}{j}") for j, c in enumerate([*names, target]) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    p = len(names)
    mean, scale = np.array([s[f"m{j}"] or 0.0 for j in range(p)]), np.array([s[f"s{j}"] or 1.0 for j in range(p)])
    rng = np.random.default_rng(seed)
    weights = np.concatenate([rng.normal(size=p * hidden) / np.sqrt(max(p, 1)), np.zeros(hidden), rng.normal(size=hidden) / np.sqrt(hidden), [0.0]])
    net = HeatNet(names, mean, scale, float(s[f"m{p}"] or 0.0), float(s[f"s{p}"] or 1.0), weights, hidden)
    if s["m0"] is None:
        return net
    values = [F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(names)]
    rows = known.select(*values, F.col(target).cast("double").alias("y"), *[d.alias(f"d{j}") for j, d in enumerate([*drivers, given])])
    rows = kept(rows.withColumn("batch", F.pmod(F.xxhash64(*rows.columns, F.lit(seed)), F.lit(batches)).cast("int")), "network")
    want = np.array([signs(names)[c] for c in names], float)
    size, first, second = len(weights), np.zeros(len(weights)), np.zeros(len(weights))

    def round_of(w: np.ndarray):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(4 + size)
            for batch in parts:
                columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(p + 7)]
                x = (np.stack(columns[:p], axis=1) - mean) / scale
                losses, gradient = loss_and_gradient(net, w, x, columns[p], np.stack(columns[p + 1 :], axis=1), want, seb, mono)
                total += np.concatenate([losses, gradient])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(4 + size)), pa.array(total)], names=["i", "v"])

        return run

    for k in range(epochs * batches):
        told = rows.filter(F.col("batch") == k % batches).drop("batch").mapInArrow(round_of(net.weights), "i long, v double")
        total = np.zeros(4 + size)
        for r in told.groupBy("i").agg(F.sum("v").alias("v")).collect():  # one number for each weight
            total[r["i"]] = r["v"]
        n = max(total[3], 1.0)
        data, balance, sign = (float(v) for v in total[:3] / n)
        net.history.append((k, data + seb * balance + mono * sign, data, balance, sign))
        gradient = total[4:] / n
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        net.weights = net.weights - rate * (first / (1 - 0.9 ** (k + 1))) / (np.sqrt(second / (1 - 0.999 ** (k + 1))) + 1e-8)
    return net
