"""The choice among all candidates, against the one-by-one greedy and enumeration."""

from itertools import product

import numpy as np
import pytest

from thermogrid.operators import portfolio, selection


def setting(spark, n=8, seed=1, share=1.0, costs=(1.0, 2.5, 6.0)):
    rng = np.random.default_rng(seed)
    cells = [(r, c, float(rng.random()) if rng.random() < 0.95 else None) for r in range(n) for c in range(n)]
    grid = spark.createDataFrame(cells, "row int, col int, weight double")
    rows = [(r, c, f"m{k}", k, cost, 1.0, float(rng.uniform(0.2, 1.0) * (1 + 0.8 * k)), float(rng.random())) for r in range(n) for c in range(n) for k, cost in enumerate(costs) if rng.random() < share]
    return grid, spark.createDataFrame(rows, "row int, col int, intervention string, measure_no int, cost double, area_m2 double, self_delta_c double, rank_key double")


@pytest.mark.parametrize(("budget", "area"), [(12.0, 100.0), (1e6, 5.0), (0.5, 9.0), (1e6, 1e6)])
def test_greedy_over_all_candidates_equals_one_by_one(spark, budget, area):
    grid, found = setting(spark, 6 if budget < 1e5 or area < 100 else 4)
    plain = portfolio.Portfolio(found, grid)
    want = [(int(plain.table.iloc[i]["row"]), int(plain.table.iloc[i]["col"]), plain.table.iloc[i]["intervention"], g) for i, g in plain.greedy(budget, area)]
    got = selection.in_order(selection.greedy(selection.Sites.of(found, grid), budget, area)).orderBy("rank").collect()
    assert [(r["row"], r["col"], r["intervention"]) for r in got] == [w[:3] for w in want]
    assert np.allclose([r["gain"] for r in got], [w[3] for w in want]) and [r["rank"] for r in got] == list(range(1, len(want) + 1))
    assert np.allclose([r["objective"] for r in got], np.cumsum([w[3] for w in want]))


def test_exact_choice_equals_enumeration_on_fifteen_candidates(spark):
    for seed, budget, area in ((1, 8.0, 10.0), (2, 14.3, 3.0), (3, 1e3, 1e3), (4, 0.1, 5.0)):
        grid, found = setting(spark, 3, seed)
        few = spark.createDataFrame([tuple(r) for r in found.collect()][:15], found.schema)
        sites = selection.Sites.of(few, grid, distance_px=0.5)
        values = {(r["row"], r["col"], r["intervention"]): (r["value"], r["cost"], r["area_m2"]) for r in sites.alone().collect()}
        by_site: dict = {}
        for (r, c, m), v in values.items():
            by_site.setdefault((r, c), [(0.0, 0.0, 0.0)]).append(v)
        best = max(sum(o[0] for o in pick) for pick in product(*by_site.values()) if sum(o[1] for o in pick) <= budget + 1e-9 and sum(o[2] for o in pick) <= area + 1e-9)
        got = selection.exact(sites, budget, area)
        rows = got.placements.collect()
        assert got.proven and got.gap == 0.0 and got.value == pytest.approx(best, abs=1e-7)
        assert sum(r["value"] for r in rows) == pytest.approx(best, abs=1e-7) and len({(r["row"], r["col"]) for r in rows}) == len(rows)
        assert sum(r["cost"] for r in rows) <= budget + 1e-9 and sum(r["area_m2"] for r in rows) <= area + 1e-9


def test_exact_choice_tells_its_gap(spark):
    grid, found = setting(spark, 12, 5)
    sites = selection.Sites.of(found, grid)
    got = selection.exact(sites, 60.0, 40.0, most_open=5)
    free = selection.exact(sites, 60.0, 40.0)
    assert 0 <= got.value <= free.bound + 1e-9 and got.gap < 0.2
    assert free.gap <= got.gap + 1e-9 and sum(r["value"] for r in free.placements.collect()) == pytest.approx(free.value)
    none = selection.exact(selection.Sites.of(found.limit(0), grid), 5.0, 5.0)
    assert none.proven and none.placements.count() == 0 and selection.greedy(selection.Sites.of(found.limit(0), grid), 5.0, 5.0).count() == 0
