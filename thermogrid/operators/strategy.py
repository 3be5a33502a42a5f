"""From a grid and a surface model to a portfolio of measures with its totals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.formulas import feasible
from ..sources.shared import kept
from . import measures, selection, stats
from .portfolio import Measure, Portfolio, candidates

METHODS = ("greedy", "ilp", "nsga2")
TOP = 2000


def options(have: list[str], model: measures.Model, names: list[str] | None = None) -> list[Measure]:
    """The catalogue's measures with their rule and their cooling by the model, as SQL."""
    return [Measure(m.name, "park_possible" if m.place == "vacant" else feasible(m.place), measures.surface_delta(model, measures.changed(m.name, "TRUE", have)), m.cost_per_m2) for m in measures.MEASURES.values() if names is None or m.name in names]


def pareto(objective: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Whether no other choice cools at least as much for at most the cost, and better in one of both."""
    order = np.lexsort((cost, -objective))
    best, out = np.inf, np.zeros(len(cost), bool)
    for i in order:
        if cost[i] < best:
            best, out[i] = cost[i], True
    return out


def search(portfolio: Portfolio, budget: float, area_cap: float, people: int = 40, rounds: int = 60, seed: int = 0) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
    """(choices, cooling, cost) of a non-dominated front, by selection, crossover and mutation of choices.

    Choices are sets of the at most ``TOP`` candidates; those beyond budget, area or one measure a site are repaired by
    leaving out the candidates with the least value for their cost.  Greedy choices at shares of the budget start it.
    """
    rng, n = np.random.default_rng(seed), len(portfolio.table)
    if not n:
        return [[]], np.zeros(1), np.zeros(1)
    value = (portfolio.weights[portfolio.place] * np.minimum(portfolio.delta, portfolio.cap)).sum(1) / np.maximum(portfolio.cost, 1e-9)

    def repaired(chosen: np.ndarray) -> list[int]:
        spent = used = 0.0
        sites, out = set(), []
        for i in sorted(chosen.tolist(), key=lambda k: (-value[k], k)):
            if portfolio.site[i] not in sites and spent + portfolio.cost[i] <= budget + 1e-9 and used + portfolio.area[i] <= area_cap + 1e-9:
                spent, used = spent + portfolio.cost[i], used + portfolio.area[i]
                sites.add(portfolio.site[i])
                out.append(i)
        return out

    pool = [[i for i, _ in portfolio.greedy(budget * s, area_cap)] for s in (0.25, 0.5, 0.75, 1.0)] + [[]]
    for _ in range(rounds):
        f, c = np.array([portfolio.objective(p) for p in pool]), np.array([portfolio.cost[p].sum() for p in pool])
        front = pareto(f, c)
        keep = sorted(range(len(pool)), key=lambda k: (not front[k], -f[k], c[k]))[: people // 2]
        pool = [pool[k] for k in keep]
        while len(pool) < people:
            a, b = (set(pool[int(k)]) for k in rng.integers(0, len(keep), 2))
            mixed = (a & b) | {i for i in a ^ b if rng.random() < 0.5}
            mixed |= set(rng.choice(n, min(n, 1 + int(rng.integers(0, 4))), replace=False).tolist())
            if mixed and rng.random() < 0.5:
                mixed.discard(int(rng.choice(sorted(mixed))))
            pool.append(repaired(np.array(sorted(mixed), int)))
    distinct = [list(x) for x in sorted({tuple(sorted(p)) for p in pool})]
    f, c = np.array([portfolio.objective(p) for p in distinct]), np.array([float(portfolio.cost[p].sum()) for p in distinct])
    front = np.flatnonzero(pareto(f, c))
    front = front[np.argsort(c[front], kind="stable")]
    return [distinct[k] for k in front], f[front], c[front]


def knee(f: np.ndarray, c: np.ndarray) -> int:
    """The choice farthest above the line between the front's ends."""
    if len(f) < 3:
        return int(np.argmax(f))
    x, y = (c - c.min()) / (np.ptp(c) or 1.0), (f - f.min()) / (np.ptp(f) or 1.0)
    return int(np.argmax(y - x))


def strategy(grid: DataFrame, model: measures.Model, config: Config, method: str | None = None, resolution_m: float | None = None, names: list[str] | None = None) -> dict:
    """placements and cells as tables, totals and the method as plain values.

    ``greedy`` takes the largest gain each time and ``ilp`` the best values taken alone, both among all candidates and as
    jobs over tables; ``nsga2`` takes the knee of a front of cooling against cost, among the ``TOP`` best by priority
    and cooling, a documented bound.  Cells get the delivered cooling, which saturates where footprints overlap.
    """
    method = method or config.optimizer
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {METHODS}")
    r = resolution_m or config.resolution_m
    have = grid.columns
    x = measures.with_layers(grid, measures.ABSENT | {"albedo": 0.18})
    if method == "nsga2":  # else the sites find it out on their way
        x = measures.possible(x, "urban_park", "park_possible", r)
    x = stats.equity_weights(x, "population" if config.equity and "population" in have else None, "hvi" if config.equity and "hvi" in have else None)
    x, front, more = stats.priority_score(x), None, {}
    n_cells = grid.count()
    area_cap = config.area_cap_frac * n_cells * r * r
    if method == "nsga2":
        x = kept(x, "strategy")
        all_ = kept(candidates(x, options(x.columns, model, names), resolution_m=r, top_k=TOP), "options")
        sites = selection.Sites.of(all_, x)
    else:
        sites = selection.Sites.of_grid(x, options(x.columns, model, names), resolution_m=r)
        all_ = sites.table
    if method == "greedy":
        picked = selection.greedy(sites, config.budget, area_cap)
        ranked = selection.in_order(picked).select("rank", "row", "col", "intervention")
    elif method == "ilp":
        found = selection.exact(sites, config.budget, area_cap)
        picked, more = found.placements, {"bound": found.bound, "gap": found.gap, "proven": found.proven}
        ranked = stats.running_sums(picked.withColumn("_one", F.lit(1)), "value", ["id"], rank="_one").select(F.col("rank").cast("int").alias("rank"), "row", "col", "intervention")
    else:
        p = Portfolio(all_, x)
        choices, f, c = search(p, config.budget, area_cap, seed=config.seed)
        k = knee(f, c)
        told = [(rank, int(t["row"]), int(t["col"]), t["intervention"]) for rank, t in enumerate((p.table.iloc[i] for i in choices[k]), 1)]
        ranked = grid.sparkSession.createDataFrame(told, "rank int, row int, col int, intervention string")  # at most TOP
        picked = sites.table.join(ranked.drop("rank"), ["row", "col", "intervention"], "left_semi")
        front = [{"sites": len(choice), "objective": float(a), "cost": float(b)} for choice, a, b in zip(choices, f, c, strict=True)]
    picked = kept(picked.select("id", "row", "col", "intervention", "cost", "area_m2", "self_delta_c"), "picked")
    delivered = kept(selection.taken(sites, picked).select("row", "col", (sites.cap * (1.0 - F.col("residual"))).alias("delivered_c")), "delivered")
    delivered = F.broadcast(delivered) if delivered.count() <= selection.FEW else delivered
    cells = grid.select("row", "col").join(delivered, ["row", "col"], "left").select("row", "col", F.coalesce("delivered_c", F.lit(0.0)).alias("delivered_c"))
    hot = F.col("lst") >= F.lit(stats.quantiles(grid, "lst", [0.9])[0])
    people = F.greatest(F.coalesce("population", F.lit(0.0)), F.lit(0.0)) if "population" in have else F.lit(1.0)
    n_hot = grid.filter(hot).count()
    # where nothing is delivered, nothing adds to the sums
    t = x.join(delivered, ["row", "col"]).agg(
        F.sum("delivered_c").alias("all"), F.max("delivered_c").alias("max"), F.sum(F.when(hot, F.col("delivered_c"))).alias("hot"), F.sum(people * F.col("delivered_c")).alias("exposure"),
        F.sum(F.coalesce("weight", F.lit(0.0)) * F.col("delivered_c")).alias("objective"),
    ).first()
    of_cells = lambda total, n: (total or 0.0) / n if n else None
    u = picked.agg(F.count("*").alias("n"), F.sum("cost").alias("cost"), F.sum("area_m2").alias("area")).first()
    of = lambda value: F.create_map(*[F.lit(v) for m in measures.MEASURES.values() for v in (m.name, float(value(m) or 0.0))])[F.col("measure")]
    most = of(lambda m: m.surface[1])
    table = picked.join(ranked, ["row", "col", "intervention"]).withColumnsRenamed({"intervention": "measure", "self_delta_c": "delta_lst_c"})
    air = F.when(most != 0, F.least(F.col("delta_lst_c") / most, F.lit(1.0)) * of(lambda m: m.air[1])).otherwise(0.0)
    table = table.select("rank", "measure", "row", "col", "area_m2", "cost", "delta_lst_c", air.alias("delta_air_c"), F.col("delta_lst_c").between(-0.25 * most, 1.5 * most).alias("plausible"))
    totals = {
        "sites": u["n"], "budget": config.budget, "cost": float(u["cost"] or 0.0), "area_m2": float(u["area"] or 0.0), "area_cap_m2": area_cap, "mean_c": of_cells(t["all"], n_cells), "max_c": of_cells(t["max"], min(n_cells, 1)), "hottest_c": of_cells(t["hot"], n_hot),
        "exposure": of_cells(t["exposure"], min(n_cells, 1)), "objective": float(t["objective"] or 0.0), "greedy_bound": 0.632, "candidates": all_.count(), **more,
    }
    return {"method": method, "placements": table, "cells": cells, "totals": totals, "front": front}
