"""Tiles, vulnerability and portfolios against plain Python."""

import random

import numpy as np
import pytest

from thermogrid.operators import portfolio, tiles, vulnerability


@pytest.mark.parametrize("side", [3, 64])
def test_patches_do_not_depend_on_tiles(spark, side):
    rng = random.Random(3)
    on = {(r, c) for r in range(-4, 12) for c in range(15) if rng.random() < 0.55}
    size, left = {}, set(on)
    while left:
        patch, todo = set(), [left.pop()]
        while todo:
            r, c = todo.pop()
            patch.add((r, c))
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in left:
                    left.remove(n)
                    todo.append(n)
        size |= {p: len(patch) for p in patch}
    rows = [(r, c, 1 if (r, c) in on else random.Random(r * 99 + c).choice((0, None))) for r in range(-4, 12) for c in range(15)]
    grid = spark.createDataFrame(rows, "row int, col int, m int")
    for least in (1, 2, 5):
        got = {(r["row"], r["col"]) for r in tiles.large_patches(grid, "m", least, side=side).collect() if r["patch"]}
        assert got == {p for p in on if size[p] >= least}


@pytest.mark.parametrize("side", [4, 64])
def test_diffusion_does_not_depend_on_tiles(spark, side):
    rng = np.random.default_rng(2)
    a = rng.normal(30, 3, (9, 11))
    a[2:6, 3:9] = np.nan
    a[0, 0] = a[8, 10] = np.nan
    gap, want = np.isnan(a), np.where(np.isnan(a), np.nanmean(a), a)
    for _ in range(6):
        p = np.pad(want, 1, mode="edge")
        want = np.where(gap, (p[2:, 1:-1] + p[:-2, 1:-1] + p[1:-1, 2:] + p[1:-1, :-2]) / 4, want)
    rows = [(r, c, None if gap[r, c] else float(a[r, c])) for r in range(9) for c in range(11)]
    grid = spark.createDataFrame(rows, "row int, col int, v double")
    got = {(r["row"], r["col"]): r["filled"] for r in tiles.gap_fill(grid, "v", sweeps=6, side=side).collect()}
    assert all(abs(got[r, c] - want[r, c]) < 1e-12 for r in range(9) for c in range(11)) and len(got) == 99
    empty = grid.select("row", "col", (grid.v * None).alias("v"))
    assert {r["filled"] for r in tiles.gap_fill(empty, "v", sweeps=2).collect()} == {0.0}


def test_regression_comes_before_diffusion(spark):
    rows = [(r, c, None if c == 2 else 2.0 * r - c, float(r), None if (r, c) == (1, 2) else float(c)) for r in range(4) for c in range(5)]
    grid = spark.createDataFrame(rows, "row int, col int, v double, a double, b double")
    got = {(r["row"], r["col"]): r["filled"] for r in tiles.gap_fill(grid, "v", ["a", "b"]).collect()}
    assert all(abs(got[r, c] - (2.0 * r - c)) < 1e-9 for r, c in got if (r, c) != (1, 2)) and got[1, 2] is not None


def test_vulnerability_by_principal_component(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 4))
    x[:, 1] += x[:, 0]
    rows = [(i, 0, *map(float, v)) for i, v in enumerate(x)]
    rows[7] = (7, 0, None, *rows[7][3:])
    grid = spark.createDataFrame(rows, "row int, col int, lst double, impervious_frac double, ndvi double, population double")
    x[7, 0] = np.nan
    z = lambda v: (v - np.nanmean(v)) / np.nanstd(v)
    f = np.column_stack([z(x[:, 0]), z(x[:, 1]), -z(x[:, 2])])
    ok = ~np.isnan(f).any(1)
    d = f[ok] - f[ok].mean(0)
    axis = np.linalg.svd(d)[2][0]
    score = np.full(40, np.nan)
    score[ok] = d @ axis * (1 if np.corrcoef(d @ axis, d.mean(1))[0, 1] > 0 else -1)
    total = (np.nan_to_num(z(score)) + z(x[:, 3]) - z(x[:, 2])) / 3
    want = (total - total.min()) / (total.max() - total.min())
    got = {r["row"]: r["hvi"] for r in vulnerability.heat_vulnerability(grid).collect()}
    assert all(abs(got[i] - want[i]) < 1e-9 for i in range(40))
    assert {(r["hvi"], r["hvi_quintile"]) for r in vulnerability.heat_vulnerability(grid.select("row", "col")).collect()} == {(0.5, 1)}


def test_portfolio(spark):
    rng = random.Random(8)
    rows = [(r, c, rng.random(), rng.random()) for r in range(6) for c in range(6)]
    grid = spark.createDataFrame(rows, "row int, col int, weight double, heat double").selectExpr("*", "weight AS priority")
    measures = [portfolio.Measure("a", "heat > 0.3", "heat * 4.0", 1.0), portfolio.Measure("b", "heat > 0.6", "heat * 6.0", 2.0)]
    found = portfolio.candidates(grid, measures, top_k=30)
    weight, heat = {(r, c): w for r, c, w, _ in rows}, {(r, c): h for r, c, _, h in rows}
    every = [(r, c, m, k * heat[r, c]) for r, c in heat for m, k, t in (("a", 4.0, 0.3), ("b", 6.0, 0.6)) if heat[r, c] > t]
    every = sorted(every, key=lambda e: -weight[e[0], e[1]] * e[3])[:30]
    assert [(r["row"], r["col"], r["intervention"]) for r in found.collect()] == [e[:3] for e in every]
    p, offsets, cap = portfolio.Portfolio(found, grid), portfolio.footprint_offsets(1.0), 8.0
    assert len(offsets) == 25

    def value(chosen):
        left = dict.fromkeys(weight, 1.0)
        for r, c, _, d in chosen:
            for y, x, w in offsets:
                if (r + y, c + x) in left:
                    left[r + y, c + x] *= max(0.0, 1.0 - d * w / cap)
        return sum(weight[q] * cap * (1 - v) for q, v in left.items())

    cost = lambda e: {"a": 1e4, "b": 2e4}[e[2]]
    plan, budget = [], 9e4
    while True:
        fits = [e for e in every if all(e[:2] != o[:2] for o in plan) and sum(map(cost, plan)) + cost(e) <= budget and (len(plan) + 1) * 1e4 <= 6e4]
        if not fits:
            break
        plan.append(max(fits, key=lambda e: value([*plan, e])))
    got = p.placements(p.greedy(budget, 6e4)).orderBy("rank").collect()
    assert [(r["row"], r["col"], r["intervention"]) for r in got] == [e[:3] for e in plan]
    assert abs(got[-1]["objective"] - value(plan)) < 1e-9 and abs(p.objective([i for i, _ in p.greedy(budget, 6e4)]) - value(plan)) < 1e-9
    assert sum(r["cost"] for r in p.placements(p.knapsack(budget, 6e4)).collect()) <= budget
    front = p.front(budget, 6e4).orderBy("budget_share").collect()
    assert [r["objective"] for r in front] == sorted(r["objective"] for r in front)
    none = portfolio.Portfolio(portfolio.candidates(grid.filter("false"), measures), grid)
    assert none.placements(none.greedy(1e9, 1e9)).count() == 0 and none.objective([]) == 0.0


def test_scenario_composes_measures_on_layers_that_the_grid_lacks(spark):
    from thermogrid.operators import measures

    grid = spark.createDataFrame([(0, c, 40.0, 0.2, 0.15, 0.5) for c in range(4)], "row int, col int, lst double, ndvi double, albedo double, impervious_frac double")
    model = lambda layer: f"(40.0 - 10.0 * coalesce({layer('tree_frac')}, 0.0))" if layer("tree_frac") != "tree_frac" else "40.0"
    both, _ = measures.scenario(grid, model, {"urban_trees": "col = 0", "urban_park": "col = 3"}, resolution_m=1e6)
    got = {r["col"]: r["delta_lst"] for r in both.collect()}
    assert got[0] > 0 and got[3] > 0 and got[1] == got[2]
    one, _ = measures.scenario(grid, model, {"urban_trees": "col = 0"}, resolution_m=1e6)
    assert {r["col"]: r["delta_lst"] for r in one.collect()}[3] < got[3]
