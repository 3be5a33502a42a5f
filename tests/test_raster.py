"""Raster files and the transfer between grids."""

import struct
import zlib

import numpy as np
import pytest

from thermogrid.operators import regrid
from thermogrid.sources import raster

T = (30.0, 0.0, 500.0, 0.0, -30.0, 9000.0)


def grid(spark, rows=37, cols=41):
    cells = [(r, c, None if (r * cols + c) % 13 == 4 else r + c / 100, float(c)) for r in range(rows) for c in range(cols)]
    return spark.createDataFrame(cells, "row int, col int, lst double, ndvi double").repartition(5)


def test_written_tiles_come_back(spark, tmp_path):
    g = grid(spark)
    path = f"{tmp_path}/out"
    for _ in range(2):  # the second time over the first
        raster.write_raster(g, path, T, "EPSG:32643", tile=16)
    files = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(files) == 9 and files[0] == "tile-000000-000000.tif"
    back = raster.read_raster(spark, path)
    assert back.columns == ["row", "col", "lst", "ndvi"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, g.collect()), key=lambda r: r[:2])
    one = raster.read_raster(spark, f"{path}/tile-000001-000002.tif")  # a file alone counts from its own corner
    assert one.count() == 16 * 9 and one.agg({"ndvi": "min"}).first()[0] == 32.0
    h = raster.read_header(f"{path}/tile-000001-000002.tif", raster._store(path)[0])
    assert h.transform == (30.0, 0.0, 500.0 + 32 * 30, 0.0, -30.0, 9000.0 - 16 * 30) and h.tags[raster.GEO_KEYS][-1] == 32643


def test_conditions_leave_tiles_out(spark, tmp_path):
    path = f"{tmp_path}/out"
    raster.write_raster(grid(spark), path, T, tile=16)
    back = raster.read_raster(spark, path, partition_bytes=1)
    assert back.rdd.getNumPartitions() == 9
    part = back.filter("row >= 33 AND col < 10")
    assert part.count() == 4 * 10 and part.rdd.getNumPartitions() == 1
    assert back.filter("row = 3 AND col IN (2, 17)").count() == 2 and back.filter("row > 500").count() == 0


def _file(path, order="<", big=False, strips=True, planar=1, dtype="i2", compress=False, nodata=None, extra=()):
    """A small file by hand: 5 by 7 pixels, 2 bands, band k being 100 k + 10 row + col."""
    v = np.array([[[100 * k + 10 * r + c for k in range(2)] for c in range(7)] for r in range(5)])
    chunks = []
    step = 2 if strips else 16
    for plane in range(2) if planar == 2 else (None,):
        for r in range(0, 5, step):
            block = v[r : r + step] if strips else np.zeros((16, 16, 2))
            if not strips:
                block[:5, :7] = v
            block = block if plane is None else block[:, :, plane]
            raw = np.ascontiguousarray(block).astype(order + dtype).tobytes()
            chunks.append(zlib.compress(raw) if compress else raw)
    head = 16 if big else 8
    offsets = [head + sum(map(len, chunks[:k])) for k in range(len(chunks))]
    sizes = [len(c) for c in chunks]
    bits, kind = 8 * np.dtype(dtype).itemsize, {"i": 2, "u": 1, "f": 3}[np.dtype(dtype).kind]
    where = [(raster.STRIP_ROWS, 3, [2]), (raster.STRIPS, 4, offsets), (raster.STRIP_BYTES, 4, sizes)] if strips else [(raster.TILE_WIDTH, 3, [16]), (raster.TILE_HEIGHT, 3, [16]), (raster.TILES, 4, offsets), (raster.TILE_BYTES, 4, sizes)]
    tags = sorted([(256, 3, [7]), (257, 3, [5]), (258, 3, [bits] * 2), (259, 3, [8 if compress else 1]), (277, 3, [2]), (284, 3, [planar]), (339, 3, [kind] * 2), *where, *extra, *([(42113, 2, nodata.encode() + b"\0")] if nodata else [])])
    word, room = ("Q", 8) if big else ("I", 4)
    body = b"".join(chunks)
    at = head + len(body)
    after, entries, more = at + (8 if big else 2) + (20 if big else 12) * len(tags) + room, b"", b""
    for tag, kind_, values in tags:
        packed = values if kind_ == 2 else struct.pack(f"{order}{len(values)}{raster.TYPES[kind_][0]}", *values)
        place = packed.ljust(room, b"\0") if len(packed) <= room else struct.pack(order + word, after + len(more))
        more += packed if len(packed) > room else b""
        entries += struct.pack(f"{order}HH{word}", tag, kind_, len(packed) if kind_ == 2 else len(values)) + place
    start = (b"II" if order == "<" else b"MM") + (struct.pack(f"{order}HHHQ", 43, 8, 0, at) if big else struct.pack(f"{order}HI", 42, at))
    path.write_bytes(start + body + struct.pack(order + ("Q" if big else "H"), len(tags)) + entries + b"\0" * room + more)
    return str(path)


@pytest.mark.parametrize(
    "options",
    [{}, {"order": ">", "dtype": "u2"}, {"big": True, "dtype": "f4"}, {"strips": False, "compress": True, "dtype": "f8"}, {"planar": 2, "big": True, "order": ">"}, {"strips": False, "planar": 2, "dtype": "i4"}, {"nodata": "123", "dtype": "u1"}],
)
def test_files_of_others(spark, tmp_path, options):
    got = {(r["row"], r["col"]): (r["band_1"], r["band_2"]) for r in raster.read_raster(spark, _file(tmp_path / "a.tif", **options)).collect()}
    gap = float(options.get("nodata", "nan"))
    assert got == {(r, c): tuple(None if v == gap else float(v) for v in (10 * r + c, 100 + 10 * r + c)) for r in range(5) for c in range(7)}


def test_unknown_files_say_why(spark, tmp_path):
    for bad, extra in (("compression 5", [(259, 3, [5])]), ("predictor 2", [(317, 3, [2])])):
        _file(tmp_path / "b.tif", extra=extra)
        with pytest.raises(Exception, match=bad):
            raster.read_raster(spark, str(tmp_path / "b.tif")).count()
    (tmp_path / "c.tif").write_bytes(b"no image, but long enough")
    with pytest.raises(Exception, match="no TIFF file"):
        raster.read_raster(spark, str(tmp_path / "c.tif")).count()
    with pytest.raises(Exception, match="d.tif"):
        raster.read_raster(spark, str(tmp_path / "d.tif")).count()


S, G = regrid.Frame((30.0, 0.0, 500.0, 0.0, -30.0, 9000.0), 12, 10), regrid.Frame((70.0, 0.0, 480.0, 0.0, -50.0, 9010.0), 8, 5)


def values(spark):
    rng = np.random.default_rng(1)
    v = rng.random((12, 10))
    v[3, 4] = v[0, 0] = np.nan
    return v, spark.createDataFrame([(r, c, None if np.isnan(v[r, c]) else float(v[r, c])) for r in range(12) for c in range(10)], "row int, col int, v double")


def test_transfer_by_area_keeps_means_and_mass(spark):
    v, df = values(spark)
    mean, mass = np.full((8, 5), np.nan), np.zeros((8, 5))
    for r in range(8):
        for c in range(5):
            s = w = 0.0
            for i in range(12):
                for j in range(10):
                    dx = min(480 + 70 * (c + 1), 500 + 30 * (j + 1)) - max(480 + 70 * c, 500 + 30 * j)
                    dy = min(9010 - 50 * r, 9000 - 30 * i) - max(9010 - 50 * (r + 1), 9000 - 30 * (i + 1))
                    if dx > 0 and dy > 0 and not np.isnan(v[i, j]):
                        s, w = s + v[i, j] * dx * dy, w + dx * dy
            mass[r, c] = s / 900
            mean[r, c] = s / w if w else np.nan
    got = regrid.regrid(df, ["v"], S, G, "area").collect()
    assert len(got) == 40 and all((r["v"] is None) == np.isnan(mean[r["row"], r["col"]]) and (r["v"] is None or abs(r["v"] - mean[r["row"], r["col"]]) < 1e-9) for r in got)
    amounts = regrid.by_area(df, ["v"], S, G, total=True).collect()
    assert all(abs((r["v"] or 0.0) - mass[r["row"], r["col"]]) < 1e-9 for r in amounts)
    assert sum(r["v"] or 0.0 for r in amounts) == pytest.approx(np.nansum(v))  # the target covers the source


def test_nearest_and_bilinear(spark):
    v, df = values(spark)
    near = {(r["row"], r["col"]): r["v"] for r in regrid.regrid(df, ["v"], S, G, "nearest").collect()}
    line = {(r["row"], r["col"]): r["v"] for r in regrid.regrid(df, ["v"], S, G, "bilinear").collect()}
    for r in range(8):
        for c in range(5):
            pr, pc = (9000 - (9010 - 50 * (r + 0.5))) / 30, (480 + 70 * (c + 0.5) - 500) / 30
            i, j = int(np.floor(pr)), int(np.floor(pc))
            inside = 0 <= i < 12 and 0 <= j < 10
            want = v[i, j] if inside else np.nan
            assert (near[r, c] is None and np.isnan(want)) or near[r, c] == want
            s = w = 0.0
            fr, fc = int(np.floor(pr - 0.5)), int(np.floor(pc - 0.5))
            for a in (0, 1):
                for b in (0, 1):
                    if 0 <= fr + a < 12 and 0 <= fc + b < 10 and not np.isnan(v[fr + a, fc + b]):
                        weight = (1 - abs(pr - 0.5 - fr - a)) * (1 - abs(pc - 0.5 - fc - b))
                        s, w = s + weight * v[fr + a, fc + b], w + weight
            assert (line[r, c] is None) == (not inside or w == 0)
            assert line[r, c] is None or line[r, c] == pytest.approx(s / w)
    with pytest.raises(ValueError):
        regrid.Frame((1.0, 0.2, 0.0, 0.0, -1.0, 0.0), 2, 2)
    with pytest.raises(ValueError):
        regrid.regrid(df, ["v"], S, G, "cubic")
