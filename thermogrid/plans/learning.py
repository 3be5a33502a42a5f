"""Queries on models with interactions, on physics with learners, and on the choice among all candidates; each tested against plain Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import features, forest, hybrid
from ..operators import selection
from ..sources.cells import cells
from ..sources.shared import kept
from .decisions import AREA_CAP, BUDGET, MEASURES, weighed_grid

_P = ["ndvi", "albedo", "impervious_frac", "air_temp", "soil_moisture", "building_height"]
_TREES = {"rounds": 12, "depth": 3, "rate": 0.3}
_PHYSICS = ["ndvi", "albedo", "impervious_frac"]


def _round(df: DataFrame, keep: list[str], *values: str, digits: int = 5) -> DataFrame:
    return df.select(*keep, *[F.round(v, digits).alias(v) for v in values])


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells with an interaction planted in the temperature: sealed ground warms where the soil is dry."""
    grid = cells(spark, sf_dir).select("row", "col", *_P, (F.col("lst") / 10 + F.when((F.col("impervious_frac") > 0.5) & (F.col("soil_moisture") < 0.25), 6.0).otherwise(0.0)).alias("lst"))
    return kept(features.folds(features.feature_table(grid, _P), 4, seed=2), "table")


_PANEL = ("rmse", "mae", "bias", "r2", "kge")


def forest_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(forest.forest_cv(_table(spark, sf_dir), _P, **_TREES), ["fold", "n"], *_PANEL)


def forest_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir)
    return _round(forest.shapley_importance(table, forest.fit_forest(table, _P, **_TREES)), ["rank", "feature", "method"], "importance", "pct", "mean_signed")


def forest_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir)
    return _round(forest.permutation_by_prediction(table, forest.fit_forest(table, _P, **_TREES)), ["rank", "feature", "method"], "importance", "pct", digits=3)


def forest_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir)
    return _round(forest.effects_by_prediction(table, forest.fit_forest(table, _P, **_TREES)), ["feature", "k"], "x", "effect")


def _physics(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [*_PHYSICS, "air_temp", "solar_radiation", "longwave_down", "emissivity", "green_frac", "tree_frac", "water_frac", "soil_moisture", "wind_speed", "anthro_heat"]
    return kept(features.folds(cells(spark, sf_dir).select("row", "col", "lst", *names), 4, seed=2), "physics")


def hybrid_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(hybrid.hybrid_cv(_physics(spark, sf_dir), _PHYSICS), ["fold", "n"], *_PANEL)


def network_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = hybrid.fit_network(_physics(spark, sf_dir), _PHYSICS, hidden=6, epochs=4, batches=3, seb=1e-4)
    return _round(spark.createDataFrame(net.history, "round int, loss double, data double, balance double, sign double"), ["round"], "loss", "data", "balance", "sign")


def _sites(spark: SparkSession, sf_dir: str) -> selection.Sites:
    return selection.Sites.of_grid(weighed_grid(spark, sf_dir), MEASURES)


def portfolio_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(selection.in_order(selection.greedy(_sites(spark, sf_dir), BUDGET, AREA_CAP)), ["rank", "row", "col", "intervention", "cost"], "gain", "objective")


def portfolio_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selection.exact(_sites(spark, sf_dir), BUDGET, AREA_CAP)
    told = found.placements.select("row", "col", "intervention", "cost", "area_m2", F.round("value", 5).alias("value"))
    return told.withColumns({"proven": F.lit(found.proven), "gap": F.lit(round(found.gap, 6))})


QUERIES = {f.__name__: f for f in (forest_cv, forest_shapley, forest_shuffled, forest_effects, hybrid_cv, network_history, portfolio_all, portfolio_exact)}
