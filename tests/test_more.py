"""Land cover, vapour classes, budgets of time and local regression, against plain Python."""

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermogrid.models import attribution
from thermogrid.operators import landcover
from thermogrid.plans import budget


def test_class_means_codes_and_fractions(spark):
    at = dt.datetime(2024, 3, 1)
    rows = [(0, 0, at, 0.6, 0.2), (0, 0, at + dt.timedelta(days=1), 0.2, None), (0, 0, at + dt.timedelta(days=9), 0.0, 1.0), (0, 1, at, 0.5, 0.5), (1, 0, at, None, None)]
    df = spark.createDataFrame(rows, "row int, col int, ts timestamp, built double, trees double")
    means = landcover.class_means(df, "2024-03-01", "2024-03-05", classes=("built", "trees"))
    got = {(r["row"], r["col"]): (r["built"], r["trees"], r["lulc"]) for r in landcover.likeliest(means, ("built", "trees")).collect()}
    assert got[0, 0] == (pytest.approx(0.4), 0.2, 0) and got[0, 1] == (0.5, 0.5, 0) and got[1, 0] == (None, None, None)
    (r,) = landcover.cover_fractions(means, 2, {"impervious_frac": ("built",), "all": ("built", "trees")}).collect()
    assert (r["row"], r["col"], r["known"]) == (0, 0, 2) and r["impervious_frac"] == pytest.approx(0.45) and r["all"] == pytest.approx(0.8)
    looked = landcover.looked_up(spark.createDataFrame([(1,), (9,), (None,)], "lcz int"), "lcz", {1: {"svf": 0.3, "z0": 2.0}, 2: {"svf": 0.5}}).collect()
    assert [(r["svf"], r["z0"]) for r in looked] == [(0.3, 2.0), (None, None), (None, None)]


def test_nearest_in_time_with_gaps_and_ties(spark):
    t = lambda h, m=0: dt.datetime(2024, 3, 1) + dt.timedelta(hours=h, minutes=m)
    series = spark.createDataFrame([(t(0), "a", 1.0), (t(1), "a", None), (t(2), "a", 3.0), (t(9), "a", 4.0), (t(0), "b", 9.0), (t(0), "b", 8.0)], "ts timestamp, site string, tpw double")
    rows = spark.createDataFrame([(1, t(1), "a"), (2, t(1, 1), "a"), (3, t(5, 59), "a"), (4, t(6), "a"), (5, t(5, 1), "a"), (6, t(0), "b"), (7, None, "a"), (8, t(12, 1), "a"), (1, t(1), "a")], "id int, ts timestamp, site string")
    got = [(r["id"], r["tpw"]) for r in landcover.nearest_in_time(rows, series, ["tpw"], by=("site",)).orderBy("id").collect()]
    assert got == [(1, 1.0), (1, 1.0), (2, 3.0), (3, None), (4, 4.0), (5, None), (6, 8.0), (7, None), (8, None)]


def test_mono_window_classes_and_edges(spark):
    values = [(300.0, 0.97, 0.0), (300.0, 0.97, 5.999), (300.0, 0.97, 6.0), (300.0, 0.97, 54.0), (300.0, 0.97, 500.0), (300.0, 0.97, -1.0), (300.0, None, 3.0), (300.0, 0.0, 3.0), (300.0, 0.97, None)]
    df = spark.createDataFrame(values, "t double, e double, w double")
    got = [r[0] for r in df.select(landcover.statistical_mono_window(F.col("t"), F.col("e"), F.col("w"))).collect()]
    for (t, e, w), v in zip(values, got, strict=True):
        if None in (e, w) or e == 0:
            assert v is None
        else:
            a, b, c = landcover.MONO_WINDOW[int(min(max(w // 6, 0), 9))]
            assert v == pytest.approx(a * t / e + b / e + c - 273.15)


def test_a_stage_beyond_its_budget_is_cancelled(spark):
    @F.udf("long")
    def slow(x):
        time.sleep(30)
        return x

    began = time.monotonic()
    told = budget.attempt(spark, "slow", [lambda: spark.range(4).select(slow("id")).collect()], seconds=1.5, retries=0)
    assert told.error.startswith("OutOfTime") and time.monotonic() - began < 20 and told.tries == 1
    for _ in range(50):
        if not spark.sparkContext.statusTracker().getActiveJobsIds():
            break
        time.sleep(0.2)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    again = budget.attempt(spark, "next", [lambda: 1 / 0, lambda: spark.range(7).count()], seconds=60)
    assert (again.result, again.error, again.tries) == (7, None, 2)
    calls = []
    failed = budget.attempt(spark, "bad", [lambda: calls.append(1) or 1 / 0])
    assert failed.error.startswith("ZeroDivisionError") and len(calls) == 2
    late = budget.attempt(spark, "late", [lambda: time.sleep(1)], seconds=0.3, retries=0)
    assert late.error.startswith("OutOfTime")


def _plain_fit(values, r0, c0, k):
    """One cell's regression over its k nearest known cells, by hand."""
    known = [(r, c) for r, c in values if None not in values[r, c]]
    d = np.array([np.hypot(r - r0, c - c0) for r, c in known])
    h = np.sort(d)[k - 1]
    w = np.where(d < h, (1 - (d / h) ** 2) ** 2, 0)
    x = np.array([[1, *values[p][:-1]] for p in known])
    y = np.array([values[p][-1] for p in known])
    s = np.sqrt(w)
    b = np.linalg.lstsq(x * s[:, None], y * s, rcond=None)[0]
    mean = (w * y).sum() / w.sum()
    return b, 1 - (w * (y - x @ b) ** 2).sum() / (w * (y - mean) ** 2).sum()


@pytest.mark.parametrize("tile", [8, 48])
def test_local_regression_equals_one_cell_at_a_time(spark, tile):
    rng = np.random.default_rng(3)
    values = {}
    for r in range(20):
        for c in range(20):
            a, b = rng.random(2)
            hole = 3 <= r <= 12 and 2 <= c <= 12  # wider than the first halo
            values[r, c] = (float(a), float(b), None if hole or rng.random() < 0.05 else float(30 + (1 + r / 10) * a - 2 * b + 0.1 * rng.normal()))
    df = spark.createDataFrame([(r, c, *v) for (r, c), v in values.items()], "row int, col int, ndvi double, albedo double, lst double")
    got = attribution.local_regression(df, ["ndvi", "albedo"], neighbours=30, tile=tile, standardise=False).collect()
    assert len(got) == 400
    for r in got:
        b, r2 = _plain_fit(values, r["row"], r["col"], 30)
        assert np.allclose([r["slope_ndvi"], r["slope_albedo"]], b[1:], rtol=1e-6, atol=1e-7) and r["local_r2"] == pytest.approx(r2, abs=1e-6)
        assert r["dominant"] == int(np.abs(b[1:]).argmax())
