"""The whole study: grid, indices, hotspots, model, attribution, physics, portfolio, written as tables and a report.

Each step is a function on tables.  A step that fails is told in the report and the steps that do not need it go on.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CITIES, Config
from ..functions import formulas as M
from ..functions.formulas import column
from ..models import attribution, features, forest, train
from ..operators import indices, measures, strategy, vulnerability
from ..sources import synthetic
from ..sources.grid import clean
from ..sources.shared import shared_folder
from . import budget

STEPS = ("grid", "indices", "hotspots", "model", "attribution", "physics", "portfolio")
LEGEND = ("Low", "Moderate", "High", "Very high", "Extreme")

# Ways in which results are cross-checked, (name, kind); one in brackets needs sources from outside.
CHECKS = (
    ("triple collocation", "method"), ("inverse-variance fusion", "method"), ("agreement map", "method"), ("majority vote", "method"), ("reconciled sensors", "method"), ("gap filling", "method"), ("Monte Carlo errors", "method"),
    ("block cross-validation", "method"), ("residual autocorrelation", "method"), ("permutation importance", "method"), ("Shapley values", "method"), ("variance partition", "method"), ("sign audit", "method"), ("local slopes", "method"),
    ("energy-balance residual", "method"), ("physical cooling estimate", "method"), ("air-temperature model", "method"), ("Gi* clusters", "method"), ("local Moran", "method"),
    ("synthetic city", "data"), ("thermal scenes (Landsat)", "[data]"), ("thermal scenes (MODIS)", "[data]"), ("thermal scenes (VIIRS)", "[data]"), ("reflectance scenes", "[data]"), ("cloud probabilities", "[data]"), ("reanalysis", "[data]"),
)


def checks(spark: SparkSession) -> DataFrame:
    """The registry of cross-checks: name, kind, active."""
    return spark.createDataFrame([(n, k.strip("[]"), not k.startswith("[")) for n, k in CHECKS], "name string, kind string, active boolean")


def robustness(grid: DataFrame) -> dict:
    """Numbers of checks, and which layers carry their uncertainty or the agreement of sources."""
    table = checks(grid.sparkSession)
    n = {(r["kind"], r["active"]): r["n"] for r in table.groupBy("kind", "active").agg(F.count("*").alias("n")).collect()}
    unsure = sorted(c for c in grid.columns if c.endswith("_uncertainty"))
    agree = sorted(c for c in grid.columns if c.endswith("_agreement"))
    means = grid.agg(*[F.avg(c).alias(c) for c in (*unsure, *agree)]).first().asDict() if unsure or agree else {}
    return {"checks": sum(n.values()), "active": sum(v for (_, a), v in n.items() if a), "methods": sum(v for (k, _), v in n.items() if k == "method"), "uncertainty": {c: means[c] for c in unsure}, "agreement": {c: means[c] for c in agree}}


def hotspot_layers(grid: DataFrame) -> DataFrame:
    return vulnerability.layered_hotspots(grid)


def hotspot_summary(grid: DataFrame) -> dict:
    """Shares of hot cells and of the priority classes, and the range of the temperature."""
    r = grid.agg(F.count("*").alias("cells"), F.sum("hotspot_mask").alias("hot"), F.avg("lst").alias("mean"), F.max("lst").alias("max"), F.avg(F.when(F.col("lcz").between(1, 10), F.col("suhii"))).alias("suhii") if {"lcz", "suhii"} <= set(grid.columns) else F.lit(None).alias("suhii")).first()
    shares = {row["priority_class"]: row["n"] for row in grid.groupBy("priority_class").agg(F.count("*").alias("n")).collect()}  # six classes
    return {"cells": r["cells"], "hot_pct": 100.0 * (r["hot"] or 0) / max(r["cells"], 1), "lst_mean": r["mean"], "lst_max": r["max"], "suhii_mean": r["suhii"], "classes": {LEGEND[k]: 100.0 * v / r["cells"] for k, v in sorted(shares.items()) if k >= 0}}


def physics(grid: DataFrame) -> dict:
    """The mean residual of the surface energy balance and its square root mean square, for a check."""
    need = {"albedo", "solar_radiation", "longwave_down", "emissivity", "lst", "air_temp", "wind_speed", "roughness_length", "rel_humidity", "soil_moisture", "green_frac", "tree_frac", "water_frac", "impervious_frac", "anthro_heat"}
    if not need <= set(grid.columns):
        return {"missing": sorted(need - set(grid.columns))}
    net = M.net_radiation("albedo", "solar_radiation", "longwave_down", "emissivity", "lst")
    e = M.seb_residual("lst", "air_temp", "wind_speed", "roughness_length", "rel_humidity", "soil_moisture", "green_frac", "tree_frac", "water_frac", "impervious_frac", net, "anthro_heat")
    r = grid.select(column(e).alias("e")).agg(F.avg("e").alias("mean"), F.sqrt(F.avg(F.col("e") ** 2)).alias("rms")).first()
    return {"residual_mean": r["mean"], "residual_rms": r["rms"]}


def run(spark: SparkSession, config: Config, path: str | None = None, kind: str = "boosted", steps: tuple[str, ...] = STEPS, seconds: float | None = None, **options) -> dict:
    """Runs the steps and returns tables and plain values by name; their tables, and the report, are written below ``path``.

    Without a path the tables go to the shared folder of the session, as later steps read them again and again.

    A step that takes longer than ``seconds`` is cancelled; a step that fails is tried once more.  ``errors`` names the
    steps that failed; without a grid nothing else runs.
    """
    out: dict = {"config": config, "errors": {}, "seconds": {}}
    folder = path or shared_folder(spark, "study")

    def step(name: str, make) -> None:
        if name not in steps:
            return
        told = budget.attempt(spark, name, [make], seconds)
        if told.error:
            out["errors"][name] = told.error
        out["seconds"][name] = told.seconds

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    out["grid"] = keep(clean(synthetic.load(spark, config, **options)), "grid")
    step("indices", lambda: out.update(grid=keep(indices.all_indices(out["grid"]), "indices")))
    step("hotspots", lambda: (out.update(grid=keep(hotspot_layers(out["grid"]), "hotspots")), out.update(hotspots=hotspot_summary(out["grid"]))))

    def model() -> None:
        names = features.resolve(out["grid"])
        table = keep(features.folds(features.feature_table(out["grid"], names), 5, seed=config.seed), "features")
        out["cv"] = keep(forest.forest_cv(table, names) if kind == "forest" else train.block_cv(table, names, kind=kind), "cv")
        out["model"] = {"boosted": train.fit_boosted, "linear": train.fit_linear, "forest": forest.fit_forest}[kind](table, names)
        rmse = out["cv"].filter("fold IS NULL").first()["rmse"]
        sigma = F.when(F.col("lst_pred").isNotNull(), F.lit(float(rmse or 0.0)))
        out["predicted"] = keep(out["model"].predict(out["grid"]).withColumn("lst_pred_uncertainty", sigma).select("row", "col", "lst", "lst_pred", "lst_pred_uncertainty"), "predicted")
        out["table"] = table
        if path:
            out["model"].save(spark, f"{path}/model")

    step("model", model)

    def explain() -> None:
        t, m = out["table"], out["model"]
        if kind == "forest":
            shap, shuffled = keep(forest.shapley_importance(t, m), "shapley"), forest.permutation_by_prediction(t, m)
        else:
            shap, shuffled = attribution.shapley_importance(t, m), attribution.permutation_importance(t, m)
        out["importance"] = keep(shap.unionByName(shuffled), "importance")
        out["families"] = keep(attribution.by_family(shap), "families")
        out["signs"] = keep(attribution.sign_audit(shap), "signs")
        out["agreement"] = attribution.agreement(shap, shuffled)[0]

    step("attribution", explain)
    step("physics", lambda: out.update(physics=physics(out["grid"])))

    def choose() -> None:
        model = out["model"].expression if "model" in out else measures.linear_model
        found = strategy.strategy(out["grid"], model, config)
        out.update(portfolio=found["totals"], placements=keep(found["placements"], "placements"), delivered=keep(found["cells"], "delivered"))

    step("portfolio", choose)
    out["robustness"] = robustness(out["grid"])
    out["report"] = report(out)
    if path:
        spark.createDataFrame([(line,) for line in out["report"].splitlines()], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report.md")
        plain = {k: out[k] for k in ("errors", "seconds", "hotspots", "physics", "portfolio", "robustness", "agreement") if k in out} | {"config": config.to_dict()}
        spark.createDataFrame([(json.dumps(plain, default=float),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/summary.json")
    return out


def number(x, digits: int = 2) -> str:
    return "-" if x is None else f"{x:,.{digits}f}" if isinstance(x, float) else str(x)


def listing(df: DataFrame, most: int = 25) -> str:
    """The first rows of a table as Markdown."""
    rows = df.limit(most).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(number(v, 3) for v in r) + " |" for r in rows])


def report(out: dict) -> str:
    """The study as Markdown: what was found, how far it can be trusted, and what was proposed."""
    c: Config = out["config"]
    text = [f"# Heat study: {c.name}", "", f"Area {', '.join(f'{v:g}' for v in c.bbox)}; {c.start} to {c.end}; cells of {c.resolution_m:g} m; source {c.mode}.", ""]
    if h := out.get("hotspots"):
        text += ["## Hotspots", "", f"{h['cells']} cells, {number(h['hot_pct'], 1)} % hot. Surface temperature: mean {number(h['lst_mean'])}, largest {number(h['lst_max'])} degC.", ""]
        text += ["| class | % of cells |", "|-|-|", *[f"| {k} | {number(v, 1)} |" for k, v in h["classes"].items()], ""]
    if "cv" in out:
        text += ["## Model", "", "Held-out blocks (fold - is the mean):", "", listing(out["cv"].orderBy(F.col("fold").asc_nulls_last())), ""]
    if "families" in out:
        text += ["## Drivers", "", listing(out["families"].orderBy(F.desc("pct"))), "", listing(out["importance"].filter("method = 'shapley'").orderBy("rank")), "", f"Drivers against the physics of their sign: {out['signs'].filter('NOT ok').count()}. Two methods agree on: {', '.join(out['agreement']['agreed']) or 'none'}.", ""]
    if "physics" in out:
        text += ["## Energy balance", "", ", ".join(f"{k} {number(v) if not isinstance(v, list) else ' '.join(v)}" for k, v in out["physics"].items()) + ".", ""]
    if p := out.get("portfolio"):
        text += ["## Measures", "", f"{p['sites']} sites for {number(p['cost'], 0)} of {number(p['budget'], 0)}; mean cooling {number(p['mean_c'], 3)}, in the hottest tenth {number(p['hottest_c'], 3)} degC.", "", listing(out["placements"].orderBy("rank"), 12), ""]
    r = out["robustness"]
    text += ["## Checks", "", f"{r['active']} of {r['checks']} checks active ({r['methods']} methods). Layers with an uncertainty: {', '.join(r['uncertainty']) or 'none'}.", ""]
    if out["errors"]:
        text += ["## Steps that failed", "", *[f"- {k}: {v}" for k, v in out["errors"].items()], ""]
    return "\n".join(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="thermogrid", description="Heat study of a city: hotspots, drivers, measures.")
    p.add_argument("--city", default="delhi", help=f"one of {', '.join(CITIES)}")
    p.add_argument("--bbox", type=float, nargs=4, metavar=("WEST", "SOUTH", "EAST", "NORTH"))
    p.add_argument("--start"), p.add_argument("--end")  # noqa: E702
    p.add_argument("--resolution", type=float, help="metres a cell")
    p.add_argument("--shape", type=int, nargs=2, metavar=("ROWS", "COLS"))
    p.add_argument("--mode", choices=sorted(synthetic.SOURCES), default="synthetic")
    p.add_argument("--grid", help="path of an exported grid (mode scenes)")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--budget", type=float), p.add_argument("--area-share", type=float)  # noqa: E702
    p.add_argument("--optimizer", choices=strategy.METHODS, default="greedy")
    p.add_argument("--no-equity", action="store_true")
    p.add_argument("--model", choices=("linear", "boosted", "forest"), default="boosted")
    p.add_argument("--steps", nargs="+", choices=STEPS, default=list(STEPS))
    p.add_argument("--seconds", type=float, help="the longest that a step may take")
    p.add_argument("--out", help="folder for tables and report; any store that Spark reaches")
    return p


def config_of(args: argparse.Namespace) -> Config:
    given = {"city": args.city, "bbox": tuple(args.bbox) if args.bbox else None, "start": args.start, "end": args.end, "resolution_m": args.resolution, "shape": tuple(args.shape) if args.shape else None, "mode": args.mode, "seed": args.seed, "budget": args.budget, "area_cap_frac": args.area_share, "optimizer": args.optimizer, "equity": not args.no_equity}
    return Config(**{k: v for k, v in given.items() if v is not None})


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        config = config_of(args)
    except ValueError as x:
        print(f"error: {x}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("thermogrid").getOrCreate()
    out = run(spark, config, args.out, args.model, tuple(args.steps), args.seconds, **({"path": args.grid} if args.mode == "scenes" else {}))
    print(out["report"])
    return 1 if out["errors"] else 0


if __name__ == "__main__":
    sys.exit(main())
