"""Feature tables from observations, against plain Python."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from thermogrid.config import Config
from thermogrid.operators.regrid import Frame
from thermogrid.sources import products, synthetic
from thermogrid.sources.products import Band, Group

SCHEMA = "product string, band string, ts timestamp, row int, col int, value double"
START = dt.datetime(2024, 6, 1, 22)


def _at(h):
    return START + dt.timedelta(hours=h)


def _plain(rows, bands, start, end):
    """The same reductions, value by value."""
    out = {}
    for n, b in bands.items():
        mine = {}
        for p, band, ts, r, c, v in rows:
            if (p, band) == (b.product, b.band) and ((b.how in ("latest", "mosaic")) or start <= ts < end):
                mine.setdefault((r, c), []).append((ts, None if v is None or math.isnan(v) else v))
        for cell, seen in mine.items():
            moments = {}
            for ts, v in seen:
                moments.setdefault(ts, []).append(v)
            mean = lambda vs: sum(x) / len(x) if (x := [v for v in vs if v is not None]) else None
            series = sorted((ts, mean(vs)) for ts, vs in moments.items())
            if b.how == "mean":
                got = mean([v for _, v in seen])
            elif b.how == "median":
                some = [v for _, v in seen if v is not None]
                got = statistics.median(some) if some else None
            elif b.how == "latest":
                got = series[-1][1]
            elif b.how == "mosaic":
                got = next((v for _, v in reversed(series) if v is not None), None)
            else:
                steps = [v if ts.hour == 1 else None if v is None or old is None else v - old for (_, old), (ts, v) in zip(series, series[1:])]
                got = mean([None if s is None else s / 3600 for s in steps])
            out.setdefault(cell, {})[n] = None if got is None else got * b.scale + b.offset
    return {cell: {n: found.get(n) for n in bands} for cell, found in out.items()}


def test_reductions_equal_plain_python(spark):
    rng = random.Random(5)
    bands = {"m": Band("a", "x", scale=0.1, offset=-2.0), "r": Band("a", "acc", "rate"), "l": Band("b", "x", "latest"), "s": Band("b", "x", "mosaic"), "same": Band("b", "x"), "mid": Band("c", "x", "median")}
    rows = []
    for cell in range(12):
        for product, band in (("a", "x"), ("a", "acc"), ("b", "x"), ("b", "unused"), ("c", "x")):
            for h in range(-2, 8):
                for _ in range(rng.choice((0, 1, 1, 2))):
                    rows.append((product, band, _at(h), cell // 4, cell % 4, rng.choice((None, float("nan"), *(float(rng.randrange(100)) for _ in range(6))))))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_k", F.lit("clash")).repartition(5)
    got = {(r["row"], r["col"]): r.asDict() for r in products.reduced(df, bands, str(_at(0)), str(_at(6))).collect()}
    want = _plain(rows, bands, _at(0), _at(6))
    assert set(got) == set(want) and len(want) == 12
    for cell, values in want.items():
        for n, v in values.items():
            assert got[cell][n] == (None if v is None else pytest.approx(v)), (cell, n)


def test_reanalysis_layers_at_one_cell(spark):
    land = "era5_land_hourly"
    rows = [(land, "temperature_2m", _at(h), 0, 0, 300.15 + h) for h in range(3)] + [(land, "dewpoint_temperature_2m", _at(h), 0, 0, 290.15) for h in range(3)]
    rows += [(land, "u_component_of_wind_10m", _at(0), 0, 0, 3.0), (land, "v_component_of_wind_10m", _at(0), 0, 0, -4.0), (land, "surface_pressure", _at(0), 0, 0, 101000.0)]
    # 22, 23, 0, 1 o'clock: the sum starts anew after midnight, and hour 1 tells its own value
    rows += [(land, "surface_solar_radiation_downwards", _at(h), 0, 0, v) for h, v in enumerate((3.6e6, 7.2e6, 10.8e6, 1.8e6))]
    out = products.build_features(spark.createDataFrame(rows, SCHEMA), str(_at(0)), str(_at(9)), {"air": products.REANALYSIS, "quality": products.AIR_QUALITY})
    (r,) = out.table.collect()
    assert r["air_temp"] == pytest.approx(28.0) and r["dewpoint"] == pytest.approx(17.0) and r["wind_speed"] == pytest.approx(5.0) and r["pressure"] == pytest.approx(101.0)
    e = lambda t: math.exp(17.67 * t / (t + 243.5))
    assert r["rel_humidity"] == pytest.approx(100 * e(17.0) / e(28.0)) and r["solar_radiation"] == pytest.approx((1000 + 1000 + 500) / 3)
    assert r["net_radiation"] is None and {"net_radiation", "pbl_height", "aod", "no2"} <= set(out.missing) and out.skipped == ["quality"]


def test_form_with_gaps(spark):
    ts = _at(0)
    seen = {  # cell: built, dsm, dem, height, zone
        (0, 0): (5000.0, 230.0, 218.0, 3.0, 2.0),  # built: the models' difference
        (0, 1): (500.0, 230.0, 218.0, 3.0, 6.0),  # hardly built: the height map
        (0, 2): (None, 230.0, 218.0, -2.0, 1.0),  # no built surface: zone's height over width
        (0, 3): (8000.0, 210.0, 218.0, None, 99.0),  # lower than the ground: no height below 0
    }
    names = (("ghsl_built_s", "built_surface"), ("glo30", "dem"), ("fabdem", "b1"), ("ghsl_built_h", "built_height"), ("global_lcz", "lcz_filter"))
    rows = [(*names[k], ts, r, c, v) for (r, c), vs in seen.items() for k, v in enumerate(vs)]
    out = products.build_features(spark.createDataFrame(rows, SCHEMA), "2024-01-01", "2024-01-02", {"form": products.morphology(10_000.0)})
    got = {r["col"]: r for r in out.table.collect()}
    assert [got[c]["building_height"] for c in range(4)] == [12.0, 3.0, 0.0, 0.0] and got[0]["plan_area_frac"] == 0.5 and got[2]["plan_area_frac"] is None
    assert got[0]["aspect_ratio"] == pytest.approx(0.5 / 0.5 * (12 / 30 + 0.5)) and got[2]["aspect_ratio"] == 2.5 and got[0]["frontal_area_index"] == pytest.approx(0.5 * 12 / 22)
    assert got[0]["svf"] == pytest.approx(1 / math.sqrt(1 + 1.8**2)) and got[2]["roughness_length"] == 0.03 and got[2]["displacement_height"] == 0.0
    assert got[0]["displacement_height"] == pytest.approx(12 * (1 + 4.43**-0.5 * (0.5 - 1))) and got[0]["roughness_length"] > 0


def test_slope_of_a_plane(spark):
    grid = spark.createDataFrame([(r, c, 3.0 * r + 4.0 * c if (r, c) != (4, 4) else None) for r in range(5) for c in range(6)], "row int, col int, z double")
    got = {(r["row"], r["col"]): r["slope"] for r in products.slope(grid, "z", 10.0).collect()}
    assert got[2, 2] == pytest.approx(math.degrees(math.atan(0.5))) and got[0, 2] is None and got[3, 4] is None and got[3, 3] == pytest.approx(got[2, 2])


def test_products_on_grids_of_their_own(spark):
    fine, coarse = Frame((100.0, 0, 0, 0, -100.0, 0), 4, 4), Frame((200.0, 0, 0, 0, -200.0, 0), 2, 2)
    rows = [("fine", "v", _at(0), r, c, float(10 * r + c)) for r in range(4) for c in range(4) if (r, c) != (3, 3)] + [("coarse", "v", _at(0), r, c, float(r * 2 + c)) for r in range(2) for c in range(2)]
    groups = {"f": Group({"x": Band("fine", "v")}, {"a": "x"}), "c": Group({"x": Band("coarse", "v")}, {"b": "x * 10", "a": "x"})}
    out = products.build_features(spark.createDataFrame(rows, SCHEMA), str(_at(0)), str(_at(1)), groups, frames={"coarse": coarse}, target=fine)
    got = {(r["row"], r["col"]): (r["a"], r["b"]) for r in out.table.collect()}
    assert got == {(r, c): (float(10 * r + c) if (r, c) != (3, 3) else None, 10.0 * (r // 2 * 2 + c // 2)) for r in range(4) for c in range(4)}
    with pytest.raises(ValueError):
        products.build_features(spark.createDataFrame(rows, SCHEMA), str(_at(0)), str(_at(1)), groups, frames={"coarse": coarse})


def test_nothing_observed_and_wrong_requests(spark):
    out = products.build_features(spark.createDataFrame([], SCHEMA), "2024-01-01", "2024-02-01")
    assert out.table.count() == 0 and {"air_temp", "albedo", "svf", "slope", "anthro_heat"} <= set(out.table.columns)
    assert set(out.skipped) == set(products.default_groups(1.0)) and set(out.missing) >= {"air_temp", "population", "slope"}
    for wrong in (lambda: Band("a", "b", "mode"), lambda: Group({"x": Band("a", "b")}, {"x": "1"}), lambda: products.build_features(spark.createDataFrame([], SCHEMA), "2024-01-01", "2024-02-01", {})):
        with pytest.raises(ValueError):
            wrong()


def test_zone_layers_and_parted_evaporation(spark):
    got = products.zone_layers(spark.createDataFrame([(1,), (17,), (40,), (None,)], "lcz int")).collect()
    assert [(r["zone_svf"], r["zone_hw"], r["zone_height"]) for r in got] == [(0.30, 2.5, 30.0), (0.95, 0.0, 0.0), (None, None, None), (None, None, None)]
    rows = [("pml_v2", b, _at(h), 0, 0, v + h) for b, v in (("ec", 1.0), ("es", 2.0), ("ei", 4.0)) for h in range(3)] + [("mod16a2gf", "et", _at(0), 0, 0, 50.0)]
    out = products.build_features(spark.createDataFrame(rows, SCHEMA), str(_at(0)), str(_at(9)), {"parted": products.PARTED_ET, "surface": products.SURFACE})
    assert out.table.first()["et"] == pytest.approx(10.0)


def test_study_grid_from_observations(spark, tmp_path):
    rows = [("landsat", "st_b10", _at(h), 0, c, 44000.0 + 100 * h) for h in range(3) for c in range(2)] + [("mod11a1", "lst_day_1km", _at(h), 0, c, 15100.0 + 50 * h) for h in range(3) for c in range(1, 3)]
    rows += [("mod11a1", "lst_night_1km", _at(0), 0, 2, 14700.0), ("black_marble", "gap_filled_ntl", _at(0), 0, 3, 5.0), ("landsat", "st_b10", _at(24 * 400), 0, 0, 60000.0)]
    spark.createDataFrame(rows, SCHEMA).write.partitionBy("product").parquet(str(tmp_path / "seen"))
    config = Config(mode="observations", start="2024-06-01", end="2024-06-03", resolution_m=100.0)
    grid = {r["col"]: r for r in synthetic.load(spark, config, path=str(tmp_path / "seen")).collect()}
    fine, day = 44100 * 0.00341802 + 149 - 273.15, 15150 * 0.02 - 273.15
    assert grid[0]["lst"] == pytest.approx(fine) and grid[0]["lst_uncertainty"] == 1.0 and grid[2]["lst"] == pytest.approx(day) and grid[2]["lst_uncertainty"] == pytest.approx(2.5)
    assert grid[1]["lst"] == pytest.approx((fine + 0.16 * day) / 1.16) and grid[1]["lst_uncertainty"] == pytest.approx(1.16**-0.5)
    assert grid[2]["lst_night"] == pytest.approx(20.85) and grid[3]["lst"] is None and grid[3]["anthro_heat"] == pytest.approx(75.0)
    with pytest.raises(ValueError):
        synthetic.load(spark, config)


def test_reach_of_measures(spark):
    from thermogrid.operators import measures

    cells = [(0, 0, 0.2, 0.3, 0.0, 0.0), (0, 1, 0.2, 0.3, 0.0, 9.0), (5, 5, 0.9, 0.1, 0.0, 3.0), (6, 6, None, 0.1, 0.0, None)]
    grid = spark.createDataFrame(cells, "row int, col int, impervious_frac double, ndvi double, water_frac double, building_height double")
    got = {r["measure"]: (r["possible_cells"], r["cost_everywhere"]) for r in measures.reach(grid).collect()}
    for name in measures.MEASURES:
        n = measures.possible(grid, name).filter("possible").count()
        assert got[name] == (n, n * measures.measure(name).cost_per_m2 * 10_000.0), name
    assert got["urban_park"][0] == 2 and got["green_wall"][0] == 1 and got["cool_roof"][0] == 1
