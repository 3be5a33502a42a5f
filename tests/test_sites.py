"""Sites made of a grid: the sums around them against plain Python, and how much of them goes over the network."""

import math

import pytest

from __spark_entry__ import queries
from thermogrid.operators import measures, portfolio, selection

SF = "/root/testdata/sf0.001"
MOST = 400  # bytes a cell


def shuffled(spark) -> int:
    told = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(told.apply(i).totalShuffleWrite() for i in range(told.size()))


@pytest.mark.parametrize("name", ["portfolio_all", "portfolio_exact", "strategy_greedy", "strategy_ilp"])
def test_candidates_do_not_travel(spark, name):
    cells = spark.read.parquet(f"{SF}/orders.parquet").count()
    before = shuffled(spark)
    assert queries()[name](spark, SF).count() > 0
    assert (shuffled(spark) - before) / cells < MOST


def test_values_on_a_grid_with_holes_and_cooling_beyond_the_cap(spark):
    rows = [(r, c, None if (r * 7 + c) % 11 == 0 else (r * 5 + c * 3) % 9 / 4.0, float((r + c) % 13)) for r in range(-3, 9) for c in range(9) if (r * c) % 5 != 2]
    grid = spark.createDataFrame(rows, "row int, col int, weight double, heat double").selectExpr("*", "CASE WHEN heat > 4 THEN weight END AS priority")
    options = [portfolio.Measure("a", "heat > 3", "heat * 1.5", 1.0), portfolio.Measure("b", "coalesce(weight > 1, FALSE)", "heat * 4.0", 2.0)]
    weight, offsets = {(r, c): w or 0.0 for r, c, w, _ in rows}, portfolio.footprint_offsets(1.0)
    want = {}
    for r, c, w, heat in rows:
        for name, fine, d in (("a", heat > 3, heat * 1.5), ("b", (w or 0) > 1, heat * 4.0)):
            if fine and d > 1e-3:
                want[r, c, name] = sum(weight.get((r + y, c + z), 0.0) * min(d * k, 8.0) for y, z, k in offsets)
    for sites in (selection.Sites.of_grid(grid, options), selection.Sites.of(portfolio.candidates(grid, options, top_k=None), grid)):
        got = {(x["row"], x["col"], x["intervention"]): x for x in sites.alone().collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[k]["value"], want[k], abs_tol=1e-9) and math.isclose(got[k]["gain"], want[k], abs_tol=1e-9) for k in want)


def test_sites_find_out_where_parks_are_possible(spark):
    rows = [(r, c, None if (r + c) % 9 == 0 else ((r * 3 + c * 5) % 8) / 8.0) for r in range(20) for c in range(13)]
    grid = spark.createDataFrame(rows, "row int, col int, impervious_frac double").selectExpr("*", "1.0D AS weight", "1.0D AS priority")
    options = [portfolio.Measure("park", "park_possible", "1.0D + impervious_frac", 1.0)]
    want = measures.possible(grid, "urban_park", "park_possible", 50.0).filter("park_possible").collect()
    got = selection.Sites.of_grid(grid, options, resolution_m=50.0).table.collect()
    assert {(x["row"], x["col"]) for x in got} == {(x["row"], x["col"]) for x in want} and 0 < len(got) < len(rows)


def test_exact_choice_takes_one_measure_a_site_where_options_tie(spark):
    grid = spark.createDataFrame([(0, 10 * c, 1.0) for c in range(6)], "row int, col int, weight double")
    found = spark.createDataFrame([(0, 10 * c, m, k, 1.0, 1.0, 2.0, 1.0) for c in range(6) for k, m in enumerate("ab")], "row int, col int, intervention string, measure_no int, cost double, area_m2 double, self_delta_c double, rank_key double")
    got = selection.exact(selection.Sites.of(found, grid), 4.0, 100.0, most_open=2)
    sites = [(r["row"], r["col"]) for r in got.placements.collect()]
    assert len(sites) == len(set(sites)) <= 4 and got.value <= 8.0 + 1e-9
