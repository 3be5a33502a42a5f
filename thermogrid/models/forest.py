"""Boosted trees with interactions, grown level by level from histograms, and what they say about their drivers.

Predictors are cut into bins once and the small whole numbers are written.  For each level of a tree one aggregate gives the
sums of what is left of the target by model, node, predictor and bin; from them all splits of the level follow.  Only left
children are summed up, right ones are the parent less the left.  The models of all folds grow in the same
passes: a row counts for every model but that of its own fold.  Tasks add up whole arrays, so what travels is bounded
by models x nodes x bins, whatever the number of rows.  Every ``REFRESH`` trees the rows' predictions are written.

Trees are perfect: a node that is not split sends all rows to the left.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formulas import column
from ..operators import stats
from ..sources.shared import kept
from .attribution import _ranked
from .features import signs
from .train import BINS, Additive, bin_edges

REFRESH = 8


@dataclass
class Tree:
    """Nodes by level, the children of node i being 2 i + 1 and 2 i + 2: predictor (-1: none), bin and rows; values of the leaves."""

    feature: list[int]
    bin: list[int]
    rows: list[float]
    values: list[float]

    @property
    def depth(self) -> int:
        return (len(self.values)).bit_length() - 1

    def leaf(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node of each row after ``levels`` levels, counted from the left; ``bins`` has a column for each predictor."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for level in range(self.depth if levels is None else levels):
            node = (1 << level) - 1 + at
            f = np.asarray(self.feature)[node]
            at = 2 * at + ((f >= 0) & (bins[rows, np.maximum(f, 0)] > np.asarray(self.bin)[node]))
        return at


@dataclass
class Forest:
    """A sum of trees; ``edges`` are the inner edges of each predictor's bins, a bin holding its upper edge."""

    predictors: list[str]
    base: float
    edges: list[list[float]]
    trees: list[Tree] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1) if len(self.edges) else np.zeros((len(x), 0), np.int64)

    def array(self, x: np.ndarray) -> np.ndarray:
        """Predictions for rows of predictors."""
        return self.of_bins(self.bins(x))

    def of_bins(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for t in self.trees:
            out += np.asarray(t.values)[t.leaf(bins)]
        return out

    def expression(self, layer: Callable[[str], str] = lambda k: k) -> str:
        """SQL for the prediction, NULL at a gap; fits where a surface model is asked for."""
        names = [layer(p) for p in self.predictors]

        def node(t: Tree, level: int, at: int) -> str:
            if level == t.depth:
                return f"{t.values[at]!r}D"
            i = (1 << level) - 1 + at
            left = node(t, level + 1, 2 * at)
            if t.feature[i] < 0:
                return left
            return f"CASE WHEN {names[t.feature[i]]} <= {self.edges[t.feature[i]][t.bin[i]]!r}D THEN {left} ELSE {node(t, level + 1, 2 * at + 1)} END"

        known = " AND ".join(f"{n} IS NOT NULL" for n in names) or "TRUE"
        return f"CASE WHEN {known} THEN {' + '.join([f'{self.base!r}D', *[node(t, 0, 0) for t in self.trees]])} END"

    def predict(self, grid: DataFrame, out: str = "lst_pred") -> DataFrame:
        return grid.withColumn(out, column(self.expression()).cast("double"))

    def save(self, spark: SparkSession, path: str) -> None:
        plain = {**self.__dict__, "trees": [t.__dict__ for t in self.trees]}
        spark.createDataFrame([(json.dumps(plain),)], "model string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        plain = json.loads(spark.read.parquet(path).first()[0])
        return cls(**{**plain, "trees": [Tree(**t) for t in plain["trees"]]})


class _Growth:
    """The trees of several models while they grow; ``folds[m]`` is the fold that model m does not see, None for none."""

    def __init__(self, folds: list[int | None], predictors: list[str], edges: list[list[float]], depth: int, rate: float, monotone: bool, least: float):
        self.folds, self.depth, self.rate, self.least = folds, depth, rate, least
        self.sizes = [len(e) + 1 for e in edges]
        self.first = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.total = int(self.first[-1])
        self.want = [signs(predictors)[p] if monotone else 0 for p in predictors]

    def split(self, sums: np.ndarray, low: float, high: float) -> tuple[int, int] | None:
        """The best (predictor, bin) of a node from its (rows, rest) by bin; none if no split lowers the error.

        ``low`` and ``high`` bound the node's value: a split against the sign of its driver is none.
        """
        best, found = 1e-12, None
        n, s = sums[0, : self.sizes[0]].sum(), sums[1, : self.sizes[0]].sum()
        for j, want in enumerate(self.want):
            c, r = (np.cumsum(sums[k, self.first[j] : self.first[j + 1]])[:-1] for k in (0, 1))
            ok = (c >= self.least) & (n - c >= self.least)
            left, right = r / np.maximum(c, 1.0), (s - r) / np.maximum(n - c, 1.0)
            if want:
                ok &= (np.clip(right, low, high) - np.clip(left, low, high)) * want >= 0
            gain = np.where(ok, c * left**2 + (n - c) * right**2 - s * s / max(n, 1.0), 0.0)
            if len(gain) and gain.max() > best:
                best, found = float(gain.max()), (j, int(gain.argmax()))
        return found


def _histograms(binned: DataFrame, growth: _Growth, models: list[Forest], level: int, only_left: bool, scores: bool) -> np.ndarray:
    """(rows, rest) by model, node of the level and bin, from one pass; ``models`` end with the tree that grows."""
    p, m, total, first = len(growth.sizes), len(growth.folds), growth.total, growth.first
    nodes = 1 << level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((m, nodes, 2, total))
        for batch in batches:
            fold, y = batch.column("fold").to_numpy(), batch.column("y").to_numpy()
            bins = np.stack([batch.column(f"b{j}").to_numpy() for j in range(p)], axis=1).astype(np.int64) if p else np.zeros((len(y), 0), np.int64)
            for k, (model, unseen) in enumerate(zip(models, growth.folds, strict=True)):
                before = batch.column(f"f{k}").to_numpy() if scores else model.base
                rest = y - before - sum((np.asarray(t.values)[t.leaf(bins)] for t in model.trees[:-1]), np.zeros(len(y)))
                at = model.trees[-1].leaf(bins, level)
                rows = np.ones(len(y), bool) if unseen is None else fold != unseen
                if only_left:
                    rows &= at % 2 == 0
                for j in range(p):
                    key = at[rows] * total + first[j] + bins[rows, j]
                    sums[k, :, 0] += np.bincount(key, minlength=nodes * total).reshape(nodes, total)
                    sums[k, :, 1] += np.bincount(key, rest[rows], nodes * total).reshape(nodes, total)
        flat = sums.reshape(-1)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["i", "v"])

    out = np.zeros(m * nodes * 2 * total)
    for r in binned.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # one number for each model, node and bin
        out[r["i"]] = r["v"]
    return out.reshape(m, nodes, 2, total)


def _grow(binned: DataFrame, growth: _Growth, models: list[Forest], scores: bool) -> None:
    """Adds one tree to every model; ``trees`` hold those since the last written predictions."""
    depth = growth.depth
    bounds = [[(-np.inf, np.inf)] for _ in models]
    for model in models:
        model.trees.append(Tree([-1] * ((1 << depth) - 1), [0] * ((1 << depth) - 1), [0.0] * ((1 << depth + 1) - 1), [0.0] * (1 << depth)))
    level_sums = None
    for level in range(depth):
        fresh = _histograms(binned, growth, models, level, level > 0, scores)
        if level:
            for k in range(len(models)):
                fresh[k, 1::2] = level_sums[k] - fresh[k, 0::2]
        level_sums = fresh
        for k, model in enumerate(models):
            tree, nexts = model.trees[-1], []
            for at in range(1 << level):
                i, sums, (low, high) = (1 << level) - 1 + at, fresh[k, at], bounds[k][at]
                n, s = sums[0, : growth.sizes[0]].sum(), sums[1, : growth.sizes[0]].sum()
                tree.rows[i] = float(n)
                found = growth.split(sums, low, high) if n > 0 else None
                value = float(np.clip(s / n if n > 0 else 0.0, low, high))
                if found is None:  # all rows go to the left, with the node's own value
                    sides, rows, ends = [value, value], [float(n), 0.0], [(low, high)] * 2
                else:
                    j, b = tree.feature[i], tree.bin[i] = found
                    c, r = (float(sums[q, growth.first[j] : growth.first[j] + b + 1].sum()) for q in (0, 1))
                    sides = [float(np.clip(r / c, low, high)), float(np.clip((s - r) / (n - c), low, high))]
                    rows, mid = [c, float(n - c)], sum(sides) / 2
                    ends = [(low, mid), (mid, high)] if growth.want[j] > 0 else [(mid, high), (low, mid)] if growth.want[j] < 0 else [(low, high)] * 2
                nexts += ends
                for side in (0, 1):
                    tree.rows[2 * i + 1 + side] = rows[side]
                    if level == depth - 1:
                        tree.values[2 * at + side] = growth.rate * sides[side]
            bounds[k] = nexts


def _with_scores(binned: DataFrame, models: list[Forest], p: int) -> DataFrame:
    """The rows with the predictions so far of every model, written."""
    has = "f0" in binned.columns
    schema = binned.schema.simpleString()[len("struct<") : -1].split(",f0:")[0] + "".join(f",f{k}:double" for k in range(len(models)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.stack([batch.column(f"b{j}").to_numpy() for j in range(p)], axis=1).astype(np.int64)
            keep = [n for n in batch.schema.names if not n.startswith("f") or n == "fold"]
            new = [sum((np.asarray(t.values)[t.leaf(bins)] for t in model.trees), batch.column(f"f{k}").to_numpy() if has else np.full(len(bins), model.base)) for k, model in enumerate(models)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], *[pa.array(v) for v in new]], names=[*keep, *[f"f{k}" for k in range(len(models))]])

    return kept(binned.mapInArrow(run, schema.replace(",", ", ").replace(":", " ")), "scores")


def fit_forests(table: DataFrame, predictors: list[str], target: str = "lst", fold: str | None = None, rounds: int = 40, depth: int = 3, rate: float = 0.15, monotone: bool = True, bins: int = BINS, least: float = 1.0) -> dict:
    """Models by the fold they have not seen, and under None the one of all rows; without ``fold`` only that."""
    edges = bin_edges(table, predictors, bins)
    plain = lambda n: F.col(n).cast("double")
    place = [F.coalesce(stats._bucket(plain(p), e), F.lit(0)).cast("short").alias(f"b{j}") for j, (p, e) in enumerate(zip(predictors, edges, strict=True))]
    key = F.coalesce(F.col(fold).cast("int"), F.lit(-1)) if fold else F.lit(-1)
    binned = kept(table.dropna(subset=[*predictors, target]).select(key.alias("fold"), plain(target).alias("y"), *place), "binned")
    means = {r["fold"]: (r["n"], r["s"]) for r in binned.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect()}  # one row for each fold
    folds: list[int | None] = [None, *(sorted(f for f in means if f >= 0) if len(means) > 1 else [])]
    bases = [(sum(s for f, (_, s) in means.items() if f != unseen or unseen is None), sum(n for f, (n, _) in means.items() if f != unseen or unseen is None)) for unseen in folds]
    models = [Forest(list(predictors), s / n if n else 0.0, edges) for s, n in bases]
    growth = _Growth(folds, predictors, edges, depth, rate, monotone, least)
    scores, done = False, [[] for _ in models]
    for r in range(rounds if means and predictors else 0):
        _grow(binned, growth, models, scores)
        if (r + 1) % REFRESH == 0 and r + 1 < rounds:
            binned, scores = _with_scores(binned, models, len(predictors)), True
            for model, past in zip(models, done, strict=True):
                past += model.trees
                model.trees = []
    for model, past in zip(models, done, strict=True):
        model.trees = past + model.trees
    return dict(zip(folds, models, strict=True))


def fit_forest(table: DataFrame, predictors: list[str], target: str = "lst", **options) -> Forest:
    return fit_forests(table, predictors, target, None, **options)[None]


def forest_cv(table: DataFrame, predictors: list[str], target: str = "lst", fold: str = "fold", **options) -> DataFrame:
    """The metric panel of every fold, from models that have not seen it, and its mean with fold NULL."""
    arms = F.lit(None).cast("double")
    for f, model in fit_forests(table, predictors, target, fold, **options).items():
        if f is not None:
            arms = F.when(F.col(fold) == f, column(model.expression()).cast("double")).otherwise(arms)
    guessed = kept(table.select(fold, target, arms.alias("y_pred")), "guessed")  # else the models are worked out for every measure
    panel = stats.metric_panel(guessed, target, "y_pred", by=[fold])
    numbers = [c for c in panel.columns if c != fold]
    return panel.unionByName(panel.agg(*[F.avg(c).cast(panel.schema[c].dataType).alias(c) for c in numbers]).select(F.lit(None).cast("int").alias(fold), *numbers))


# --- attribution of models that are not additive -------------------------------------------------------------------


def tree_shapley(tree: Tree, bins: np.ndarray, p: int) -> np.ndarray:
    """Shapley values of one tree for each row and predictor; a predictor that is not known sends a row both ways, by the shares of rows.

    Every leaf is a product over the predictors on its path: whether the row goes its way, or the share of rows that
    do.  The Shapley value of a product of k factors is a sum over the subsets of the others, worked out for all rows at once.
    """
    out = np.zeros((len(bins), p))
    for leaf in range(len(tree.values)):
        goes: dict[int, np.ndarray] = {}
        share: dict[int, float] = {}
        at, weight = 0, 1.0
        for level in range(tree.depth):
            side = leaf >> (tree.depth - 1 - level) & 1
            i, f = (1 << level) - 1 + at, tree.feature[(1 << level) - 1 + at]
            at = 2 * at + side
            if f < 0:
                weight *= 1.0 - side
                continue
            way = (bins[:, f] > tree.bin[i]) == bool(side)
            goes[f] = goes.get(f, True) & way
            share[f] = share.get(f, 1.0) * (tree.rows[2 * i + 1 + side] / tree.rows[i] if tree.rows[i] else 0.0)
        value = tree.values[leaf] * weight
        if not value or not goes:
            continue
        k = len(goes)
        for f in goes:
            others = [g for g in goes if g != f]
            total = np.zeros(len(bins))
            for size in range(k):
                for known in combinations(others, size):
                    term = np.full(len(bins), factorial(size) * factorial(k - size - 1) / factorial(k))
                    for g in others:
                        term *= goes[g] if g in known else share[g]
                    total += term
            out[:, f] += value * total * (goes[f] - share[f])
    return out


def _array(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in names], axis=1)


def shapley_values(table: DataFrame, model: Forest) -> DataFrame:
    """Adds shap_<predictor> for every row without gaps: with the model's mean they add up to its prediction."""
    p, names = len(model.predictors), table.columns
    known = table.dropna(subset=model.predictors).withColumns({f"shap_{c}": F.lit(0.0) for c in model.predictors})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = model.bins(_array(batch, model.predictors))
            phi = sum((tree_shapley(t, bins, p) for t in model.trees), np.zeros((len(bins), p)))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *[pa.array(phi[:, j]) for j in range(p)]], schema=batch.schema)

    return known.mapInArrow(run, known.schema)


def shapley_importance(table: DataFrame, model: Forest) -> DataFrame:
    """rank, feature, importance (mean absolute Shapley value), pct, mean_signed (the slope's sign of values against the predictor)."""
    x = shapley_values(table.select(*[F.col(c).cast("double").alias(c) for c in model.predictors]), model)
    n = model.predictors
    r = x.agg(*[F.avg(F.abs(F.col(f"shap_{c}"))).alias(f"a{j}") for j, c in enumerate(n)], *[F.covar_pop(f"shap_{c}", c).alias(f"s{j}") for j, c in enumerate(n)]).first()
    return _ranked(table.sparkSession, n, [r[f"a{j}"] or 0.0 for j in range(len(n))], "shapley", [r[f"s{j}"] or 0.0 for j in range(len(n))])


def permutation_by_prediction(table: DataFrame, model: Forest | Additive, target: str = "lst", repeats: int = 3, seed: int = 0) -> DataFrame:
    """The rise of the mean squared error when a predictor's values are dealt anew among rows, for any model that predicts.

    Rows are dealt to tasks by a hash of their values, so that a batch is a random part of the table; within it each
    predictor is shuffled in turn, and all errors are summed in one pass.
    """
    names, p = model.predictors, len(model.predictors)
    known = table.dropna(subset=[*names, target]).select(*[F.col(c).cast("double").alias(c) for c in names], F.col(target).cast("double").alias("_y"))
    mixed = F.xxhash64(*known.columns, F.lit(seed))
    dealt = known.withColumn("_h", mixed).repartition(F.col("_h")).sortWithinPartitions("_h").drop("_h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(p + 1), 0
        for k, batch in enumerate(batches):
            x, y = _array(batch, names), batch.column("_y").to_numpy()
            rng = np.random.default_rng([seed, k, len(y)])
            sums[p] += ((model.array(x) - y) ** 2).sum()
            n += len(y)
            for j in range(p):
                for _ in range(repeats):
                    other = x.copy()
                    other[:, j] = rng.permutation(other[:, j])
                    sums[j] += ((model.array(other) - y) ** 2).sum() / repeats
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p + 1)), pa.array(sums), pa.array(np.full(p + 1, n))], names=["j", "e", "n"])

    got = {r["j"]: (r["e"], r["n"]) for r in dealt.mapInArrow(run, "j long, e double, n long").groupBy("j").agg(F.sum("e").alias("e"), F.sum("n").alias("n")).collect()}
    rise = [(got[j][0] - got[p][0]) / got[p][1] if got.get(p, (0, 0))[1] else 0.0 for j in range(p)]
    return _ranked(table.sparkSession, names, rise, "permutation")


def effects_by_prediction(table: DataFrame, model: Forest | Additive, bins: int = 20, wanted: list[str] | None = None) -> DataFrame:
    """feature, k, x, effect: accumulated local effects at the edges of bins of equal numbers of rows, mean 0, for any model that predicts.

    In every bin the prediction's mean change from its lower to its upper edge is taken over the bin's rows; one pass
    sums the changes of all predictors.
    """
    names = model.predictors
    chosen = [p for p in wanted or names if p in names]
    known = table.dropna(subset=names).select(*[F.col(c).cast("double").alias(c) for c in names])
    found = stats.quantile_sets(known, [stats.Wanted(c, [k / bins for k in range(bins + 1)]) for c in chosen])
    edges = [sorted({float(q) for q in qs if q is not None}) for qs in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(chosen), bins + 1, 2))
        for batch in batches:
            x = _array(batch, names)
            for q, (name, e) in enumerate(zip(chosen, edges, strict=True)):
                if len(e) < 2:
                    continue
                j = names.index(name)
                at = np.clip(np.searchsorted(e, x[:, j], side="left") - 1, 0, len(e) - 2)
                low, high = x.copy(), x.copy()
                low[:, j], high[:, j] = np.asarray(e)[at], np.asarray(e)[at + 1]
                sums[q, :, 0] += np.bincount(at, model.array(high) - model.array(low), bins + 1)
                sums[q, :, 1] += np.bincount(at, minlength=bins + 1)
        q, b = np.nonzero(sums[:, :, 1])
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(sums[q, b, 0]), pa.array(sums[q, b, 1])], names=["q", "b", "d", "n"])

    got = {(r["q"], r["b"]): (r["d"], r["n"]) for r in known.mapInArrow(run, "q long, b long, d double, n double").groupBy("q", "b").agg(F.sum("d").alias("d"), F.sum("n").alias("n")).collect()}
    rows = []
    for q, (name, e) in enumerate(zip(chosen, edges, strict=True)):
        d, n = np.array([got.get((q, b), (0.0, 0.0)) for b in range(len(e) - 1)]).T if len(e) > 1 else (np.zeros(0), np.zeros(0))
        effect = np.concatenate([[0.0], np.cumsum(d / np.maximum(n, 1))])[: len(e)]
        if len(e) > 1:
            effect = effect - float(((effect[:-1] + effect[1:]) / 2 * n).sum() / max(n.sum(), 1.0))
        rows += [(name, k, x, float(v)) for k, (x, v) in enumerate(zip(e, effect, strict=True))]
    return table.sparkSession.createDataFrame(rows, "feature string, k int, x double, effect double")
