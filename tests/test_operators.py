"""Statistics and stencils against plain Python, and every registered query against its SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from thermogrid.operators import fusion, stats, stencil
from thermogrid.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def grid(spark, n=9, flat=False):
    rows = [(r, c, None if (r * n + c) % 11 == 3 else 1.0 if flat else 30.0 + (12.0 if 3 <= r <= 5 and 3 <= c <= 5 else 0.0) + (r * 7 + c * 3) % 5 * 0.1) for r in range(n) for c in range(n)]
    return spark.createDataFrame(rows, "row int, col int, lst double")


def test_percentile_counts_ties_and_gaps(spark):
    got = {r["lst"]: r["p"] for r in stats.percentile_rank(spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,), (None,)], "lst double"), "lst", "p").collect()}
    assert got == {1.0: 25.0, 2.0: 75.0, 5.0: 100.0, None: None}


def test_constant_layer(spark):
    g = grid(spark, flat=True)
    assert {r["z"] for r in stats.zscore(g, "lst", "z").collect()} == {0.0, None}
    assert {r["m"] for r in stats.minmax(g, "lst", "m").collect()} == {0.5, None}
    assert {r["p"] for r in stats.percentile_rank(g, "lst", "p").collect()} == {100.0, None}
    assert {r["gistar_z"] for r in stencil.getis_ord(g).collect()} == {0.0, None}


def test_planted_block_is_hot(spark):
    z = {(r["row"], r["col"]): r["gistar_z"] for r in stencil.getis_ord(grid(spark)).collect()}
    assert z[4, 4] > 1.96 and z[0, 0] < 1


def test_square_sums_match_the_kernel(spark):
    g = grid(spark)
    a = {(r["row"], r["col"]): r["s"] for r in stencil.square_sums(g, 2, s=g.lst).collect()}
    b = {(r["row"], r["col"]): r["s"] for r in stencil.neighbour_sums(g, stencil.kernel(2), s=g.lst).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_vote_without_votes_and_ties(spark):
    rows = [(0, 0, "a", 1.5), (0, 0, "b", 0.6), (0, 1, "a", None)]
    got = {(r["row"], r["col"]): (r["class"], r["share"]) for r in fusion.majority_vote(spark.createDataFrame(rows, "row int, col int, source string, value double")).collect()}
    assert got == {(0, 0): (1, 0.5), (0, 1): (None, 0.0)}


def test_composite_rejects_unknown_reducer(spark):
    with pytest.raises(ValueError, match="unknown reducer"):
        fusion.composite(grid(spark), ["row"], "lst", "col", "mode")


def test_whole_composites_take_every_event(spark):
    rows = [r for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_type", "ts", "value").collect()]
    outside = [r for r in rows if not "2024-01-05" <= str(r["ts"]) < "2024-01-25"]
    assert outside
    groups = {}
    for r in rows:
        groups.setdefault((r["user_id"], r["event_type"]), []).append((r["ts"], r["value"]))
    want = {"min": lambda g: min(v for _, v in g), "max": lambda g: max(v for _, v in g), "mosaic": lambda g: max(g)[1], "mean": lambda g: sum(v for _, v in g) / len(g)}
    for name, f in want.items():
        got = {(r["user_id"], r["event_type"]): r["value"] for r in QUERIES[f"whole_composite_{name}"](spark, SF).collect()}
        assert got.keys() == groups.keys() and all(abs(got[k] - f(g)) < 2e-5 for k, g in groups.items())


def test_windowed_composite(spark, tmp_path):
    from thermogrid.streaming.composites import windowed_composite

    spark.sql("SELECT timestamp'2024-01-01 05:00:00' AS ts, 1 AS k, 2.0D AS v UNION ALL SELECT timestamp'2024-01-01 06:00:00', 1, 4.0D").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k int, v double").parquet(str(tmp_path / "in"))
    q = windowed_composite(stream, ["k"], "v", "ts").writeStream.outputMode("complete").format("memory").queryName("out").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["mean"], r["n"]) for r in spark.table("out").collect()] == [(3.0, 2)]


@pytest.mark.parametrize("name", [n for n in ORACLE if not n.startswith("fn_")] + ["fn_heat_index", "fn_seb_residual"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    q = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE[name]})")
    norm = lambda rows: sorted((tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    a, b = norm(map(tuple, df.select(*cols).collect())), norm(q.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(u == v or (isinstance(u, float) and abs(u - v) < 2e-4) for u, v in zip(x, y, strict=True)), (x, y)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.isdir(SF)


def test_equity_weights_without_a_positive_mean_are_one(spark):
    from thermogrid.operators import stats

    g = spark.createDataFrame([(0, -1.0, 20.0), (1, 0.0, 20.0), (2, None, None)], "row int, population double, lst double")
    rows = stats.priority_score(stats.equity_weights(g)).orderBy("row").collect()
    assert [r["weight"] for r in rows] == [1.0, 1.0, 1.0] and [r["priority"] for r in rows] == [0.0, 0.0, None]


def test_local_moran_on_many_cells(spark):
    g = spark.range(50_000).selectExpr("CAST(id / 250 AS INT) AS row", "CAST(id % 250 AS INT) AS col", "CAST(CASE WHEN id % 250 < 20 THEN 40.0 ELSE 30.0 END + id % 7 * 0.1 AS DOUBLE) AS lst")
    codes = {r["moran_local"]: r["count"] for r in stencil.local_moran(g).groupBy("moran_local").count().collect()}
    assert codes[1] > 3000 and sum(codes.values()) == 50_000


def test_ranks_of_many_buckets_equal_one(spark):
    g = spark.range(3000).selectExpr("CAST(id * 7919 % 503 AS DOUBLE) AS lst", "id")
    one = {r["id"]: r["p"] for r in stats.percentile_rank(g, "lst", "p").collect()}
    many = {r["id"]: r["p"] for r in stats.percentile_rank(g, "lst", "p", in_bucket=20).collect()}
    assert one == many and max(one.values()) == 100.0


def test_quantiles_of_several_layers_and_conditions(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    a, b = rng.normal(size=700), np.round(rng.normal(size=700), 1)
    df = spark.createDataFrame([(float(x), float(y), k % 3) for k, (x, y) in enumerate(zip(a, b, strict=True))] + [(None, None, 0)], "a double, b double, k int")
    wanted = [stats.Wanted("a", [0.1, 0.5]), stats.Wanted("b", [0.0, 0.33, 1.0], df.k == 1), stats.Wanted("a", [0.5], df.k == 9)]
    k = np.arange(700) % 3
    for small in (5, 10_000):
        got = stats.quantile_sets(df, wanted, small=small, buckets=8)
        assert got[0] == pytest.approx(np.quantile(a, [0.1, 0.5])) and got[1] == pytest.approx(np.quantile(b[k == 1], [0.0, 0.33, 1.0])) and got[2] == [None]
