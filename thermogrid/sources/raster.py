"""GeoTIFF files as a source and a sink of grids, by Spark's Python data source interface.

    spark.dataSource.register(GeoTiff)
    spark.read.format("geotiff").load(path)              # row, col and a double column for each band
    write_raster(grid, path, transform, crs)             # a folder of one file for each tile

Reading plans the tiles (or strips) of all files as partitions of about equal bytes; a task reads the byte ranges of its
tiles only.  Conditions on row and col leave out tiles before anything of them is read.  Rows and columns are counted
from the upper left corner of all files together.  Writing needs no shuffle beyond the one that brings a tile's cells
together: each task writes whole tiles under a temporary name, and the commit gives them their own, so a task that is
repeated, or an aborted job, leaves no tile behind.

Known: classic and big files in either byte order, tiles and strips, pixels or bands apart, whole numbers and floats,
no compression or deflate without predictor.  Anything else raises an error that names it.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

TILE = 256
# Numbers of tags, and (struct code, bytes) of their types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, SCALE, TIEPOINT, MATRIX, GEO_KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42113
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 13: ("I", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}


def _store(path: str):
    """(file system, path in it) for a local path or an address that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    from pyarrow import fs

    store, inside = _store(path)
    info = store.get_file_info(inside)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [inside]
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(inside)) if f.type == fs.FileType.File and f.path.lower().endswith((".tif", ".tiff")))


@dataclass
class Header:
    """What a file says of its pixels and their place."""

    path: str
    tags: dict[int, tuple]
    order: str

    def one(self, tag: int, default=None):
        v = self.tags.get(tag)
        return default if v is None else v[0]

    @property
    def transform(self) -> tuple[float, float, float, float, float, float]:
        if MATRIX in self.tags:
            m = self.tags[MATRIX]
            return m[0], m[1], m[3], m[4], m[5], m[7]
        if SCALE not in self.tags or TIEPOINT not in self.tags:
            return 1.0, 0.0, 0.0, 0.0, -1.0, 0.0
        (sx, sy), (i, j, _, x, y, _) = self.tags[SCALE][:2], self.tags[TIEPOINT][:6]
        return sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy

    @property
    def bands(self) -> list[str]:
        n = self.one(SAMPLES, 1)
        try:
            names = json.loads(self.tags[DESCRIPTION][0])["bands"]
        except (KeyError, ValueError, TypeError):
            names = []
        return names if len(names) == n else [f"band_{k + 1}" for k in range(n)]

    @property
    def dtype(self) -> np.dtype:
        bits, kinds = set(self.tags.get(BITS, (1,))), set(self.tags.get(FORMAT, (1,)))
        kind = {1: "u", 2: "i", 3: "f"}.get(next(iter(kinds)))
        if len(bits) > 1 or len(kinds) > 1 or kind is None or next(iter(bits)) not in (8, 16, 32, 64):
            raise ValueError(f"{self.path}: pixels of {sorted(bits)} bits in format {sorted(kinds)} are not known")
        return np.dtype(f"{self.order}{kind}{next(iter(bits)) // 8}")

    @property
    def tile(self) -> tuple[int, int]:
        """(rows, cols) of a tile, or of a strip."""
        if TILES in self.tags:
            return self.one(TILE_HEIGHT), self.one(TILE_WIDTH)
        return min(self.one(STRIP_ROWS, self.one(HEIGHT)), self.one(HEIGHT)), self.one(WIDTH)

    def nodata(self) -> float | None:
        try:
            return float(self.tags[NODATA][0].strip(" \0"))
        except (KeyError, ValueError):
            return None

    def check(self) -> None:
        if self.one(COMPRESSION, 1) not in (1, 8, 32946):
            raise ValueError(f"{self.path}: compression {self.one(COMPRESSION)} is not known")
        if self.one(PREDICTOR, 1) != 1:
            raise ValueError(f"{self.path}: predictor {self.one(PREDICTOR)} is not known")
        _ = self.dtype


def read_header(path: str, store) -> Header:
    """The first directory of a file; only its header and the values that it points to are read."""
    with store.open_input_file(path) as f:

        def at(offset: int, n: int) -> bytes:
            f.seek(offset)
            return f.read(n)

        start = at(0, 16)
        order = {b"II": "<", b"MM": ">"}.get(start[:2])
        version = struct.unpack(f"{order}H", start[2:4])[0] if order else 0
        if version not in (42, 43):
            raise ValueError(f"{path} is no TIFF file")
        big = version == 43
        where = struct.unpack(f"{order}{'Q' if big else 'I'}", start[8:16] if big else start[4:8])[0]
        count_code, count_bytes, entry_bytes, room = ("Q", 8, 20, 8) if big else ("H", 2, 12, 4)
        n = struct.unpack(f"{order}{count_code}", at(where, count_bytes))[0]
        entries, tags = at(where + count_bytes, n * entry_bytes), {}
        for k in range(n):
            e = entries[k * entry_bytes : (k + 1) * entry_bytes]
            tag, kind = struct.unpack(f"{order}HH", e[:4])
            count = struct.unpack(f"{order}{'Q' if big else 'I'}", e[4 : 4 + (8 if big else 4)])[0]
            if kind not in TYPES:
                continue
            code, size = TYPES[kind]
            value = e[-room:]
            if count * size > room:
                value = at(struct.unpack(f"{order}{'Q' if big else 'I'}", value)[0], count * size)
            value = value[: count * size]
            tags[tag] = (value.split(b"\0")[0].decode("utf-8", "replace"),) if kind == 2 else struct.unpack(f"{order}{count * len(code) if len(code) > 1 else count}{code[0]}", value)
    header = Header(path, tags, order)
    header.check()
    return header


@dataclass
class Piece:
    """A tile: its file, its place in the whole raster, and for each band (or for all) offset and bytes."""

    path: str
    row: int
    col: int
    rows: int
    cols: int
    ranges: list[tuple[int, int]]


@dataclass
class Pieces(InputPartition):
    pieces: list[Piece]


class GeoTiffReader(DataSourceReader):
    def __init__(self, path: str, headers: list[Header], partition_bytes: int, columns: list[str]):
        self.path, self.headers, self.partition_bytes, self.columns = path, headers, partition_bytes, columns
        self.low, self.high = {"row": -np.inf, "col": -np.inf}, {"row": np.inf, "col": np.inf}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the interface's name
        """Bounds of row and col narrow the tiles; all conditions are checked again on the rows."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in self.low:
                values = f.value if isinstance(f, In) else (f.value,) if hasattr(f, "value") else ()
                if values and isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual):
                    self.low[name] = max(self.low[name], min(values))
                if values and isinstance(f, EqualTo | In | LessThan | LessThanOrEqual):
                    self.high[name] = min(self.high[name], max(values))
            yield f

    def pieces(self) -> Iterator[Piece]:
        a, _, x0, _, e, y0 = self.headers[0].transform
        for h in self.headers:  # the corner of all files is row 0, col 0
            x0, y0 = (min(x0, h.transform[2]) if a > 0 else max(x0, h.transform[2])), (max(y0, h.transform[5]) if e < 0 else min(y0, h.transform[5]))
        for h in self.headers:
            top, left = round((h.transform[5] - y0) / e), round((h.transform[2] - x0) / a)
            th, tw = h.tile
            height, width = h.one(HEIGHT), h.one(WIDTH)
            offsets, sizes = (h.tags[t] for t in ((TILES, TILE_BYTES) if TILES in h.tags else (STRIPS, STRIP_BYTES)))
            across, down = -(-width // tw), -(-height // th)
            each = across * down
            for k in range(each):
                r, c = k // across * th, k % across * tw
                rows, cols = min(th, height - r), min(tw, width - c)
                row, col = top + r, left + c
                if row + rows - 1 < self.low["row"] or row > self.high["row"] or col + cols - 1 < self.low["col"] or col > self.high["col"]:
                    continue
                planes = range(h.one(SAMPLES, 1)) if h.one(PLANAR, 1) == 2 else (0,)
                yield Piece(h.path, row, col, rows, cols, [(offsets[p * each + k], sizes[p * each + k]) for p in planes])

    def partitions(self) -> list[Pieces]:
        out, held, size = [], [], 0
        for p in self.pieces():
            n = sum(b for _, b in p.ranges)
            if held and size + n > self.partition_bytes:
                out, held, size = [*out, Pieces(held)], [], 0
            held.append(p)
            size += n
        return [*out, Pieces(held)]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        headers = {h.path: h for h in self.headers}
        for piece in partition.pieces:
            h = headers[piece.path]
            n, (th, tw) = h.one(SAMPLES, 1), h.tile
            planes = []
            with store.open_input_file(piece.path) as f:
                for offset, size in piece.ranges:
                    f.seek(offset)
                    raw = f.read(size)
                    planes.append(np.frombuffer(zlib.decompress(raw) if h.one(COMPRESSION, 1) != 1 else raw, h.dtype))
            if h.one(PLANAR, 1) == 2:
                cube = [p[: len(p) // tw * tw].reshape(-1, tw) for p in planes]
            else:
                whole = planes[0][: len(planes[0]) // (tw * n) * tw * n].reshape(-1, tw, n)
                cube = [whole[:, :, k] for k in range(n)]
            r, c = np.mgrid[piece.row : piece.row + piece.rows, piece.col : piece.col + piece.cols]
            arrays = [pa.array(r.ravel().astype(np.int32)), pa.array(c.ravel().astype(np.int32))]
            names = h.bands
            for name in self.columns[2:]:
                if name not in names:
                    arrays.append(pa.nulls(r.size, pa.float64()))
                    continue
                v = cube[names.index(name)][: piece.rows, : piece.cols].astype(np.float64).ravel()
                gap = np.isnan(v) if h.nodata() is None else np.isnan(v) | (v == h.nodata())
                arrays.append(pa.array(v, mask=gap))
            yield pa.RecordBatch.from_arrays(arrays, names=self.columns)


def encode_tile(bands: dict[str, np.ndarray], transform: tuple, epsg: int | None) -> bytes:
    """One file with one tile of doubles; bands apart, deflated, NaN for a gap."""
    rows, cols = next(iter(bands.values())).shape
    th, tw = -(-rows // 16) * 16, -(-cols // 16) * 16  # tiles have sides that are multiples of 16
    parts = []
    for v in bands.values():
        full = np.full((th, tw), np.nan)
        full[:rows, :cols] = v
        parts.append(zlib.compress(full.astype("<f8").tobytes(), 6))
    a, b, x0, d, e, y0 = transform
    keys = [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg] if epsg else []
    n = len(bands)
    offsets, at = [], 8
    for p in parts:
        offsets.append(at)
        at += len(p)
    tags = [
        (WIDTH, 4, [cols]), (HEIGHT, 4, [rows]), (BITS, 3, [64] * n), (COMPRESSION, 3, [8]), (PHOTOMETRIC, 3, [1]), (DESCRIPTION, 2, json.dumps({"bands": list(bands)}).encode() + b"\0"), (SAMPLES, 3, [n]), (PLANAR, 3, [2]),
        (TILE_WIDTH, 4, [tw]), (TILE_HEIGHT, 4, [th]), (TILES, 4, offsets), (TILE_BYTES, 4, [len(p) for p in parts]), (FORMAT, 3, [3] * n),
        *([(SCALE, 12, [a, -e, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, x0, y0, 0.0])] if b == d == 0 else [(MATRIX, 12, [a, b, 0.0, x0, d, e, 0.0, y0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0])]),
        *([(GEO_KEYS, 3, keys)] if keys else []), (NODATA, 2, b"nan\0"),
    ]
    body = b"".join(parts)
    body += b"\0" * (len(body) % 2)
    where = 8 + len(body)
    extra, entries, after = b"", b"", where + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        code, _ = TYPES[kind]
        packed = values if kind == 2 else struct.pack(f"<{len(values)}{code}", *values)
        place = packed.ljust(4, b"\0")
        if len(packed) > 4:
            place = struct.pack("<I", after + len(extra))
            extra += packed + b"\0" * (len(packed) % 2)
        entries += struct.pack("<HHI", tag, kind, len(packed) if kind == 2 else len(values)) + place
    return struct.pack("<2sHI", b"II", 42, where) + body + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + extra


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class GeoTiffWriter(DataSourceWriter):
    def __init__(self, path: str, options: dict, columns: list[str], overwrite: bool):
        self.path, self.columns, self.job, self.overwrite = path, columns, uuid.uuid4().hex[:12], overwrite
        self.transform, self.tile = tuple(json.loads(options["transform"])), int(options.get("tile", TILE))
        self.epsg = int(options["epsg"]) if options.get("epsg") else None

    def _flush(self, store, inside: str, key: tuple[int, int], rows: list) -> tuple[str, str]:
        r0, c0 = key[0] * self.tile, key[1] * self.tile
        table = np.array([[np.nan if v is None else float(v) for v in r] for r in rows])
        at = table[:, :2].astype(np.int64)
        shape = tuple(at.max(0) - (r0, c0) + 1)
        bands = {}
        for k, name in enumerate(self.columns[2:], 2):
            v = np.full(shape, np.nan)
            v[at[:, 0] - r0, at[:, 1] - c0] = table[:, k]
            bands[name] = v
        a, b, x0, d, e, y0 = self.transform
        place = (a, b, x0 + a * c0 + b * r0, d, e, y0 + d * c0 + e * r0)
        name = f"tile-{key[0]:06d}-{key[1]:06d}.tif"
        temporary = f"_{self.job}-{uuid.uuid4().hex[:8]}-{name}.tmp"
        with store.open_output_stream(f"{inside}/{temporary}") as f:
            f.write(encode_tile(bands, place, self.epsg))
        return temporary, name

    def write(self, iterator: Iterator) -> Written:
        store, inside = _store(self.path)
        store.create_dir(inside, recursive=True)
        names, key, rows = [], None, []
        for r in iterator:  # rows of a tile come one after another
            now = (r[0] // self.tile, r[1] // self.tile)
            if key is not None and now != key:
                names.append(self._flush(store, inside, key, rows))
                rows = []
            key = now
            rows.append(tuple(r))
        if key is not None:
            names.append(self._flush(store, inside, key, rows))
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, inside = _store(self.path)
        fresh = [pair for m in messages if m is not None for pair in m.names]
        if len({n for _, n in fresh}) < len(fresh):
            self.abort(messages)
            raise ValueError("a tile's rows are spread over tasks: write with write_raster")
        if self.overwrite:
            for old in _files(self.path):
                store.delete_file(old)
        for temporary, name in fresh:
            store.move(f"{inside}/{temporary}", f"{inside}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, inside = _store(self.path)
        for f in store.get_file_info(fs.FileSelector(inside, allow_not_found=True)):
            if f.base_name.startswith(f"_{self.job}-"):
                store.delete_file(f.path)


class GeoTiff(DataSource):
    """Options: path; for reading partition_bytes; for writing transform (six numbers as JSON), tile, epsg."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def _headers(self) -> list[Header]:
        store, _ = _store(self.options["path"])
        files = _files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"{self.options['path']} holds no TIFF file")
        return [read_header(f, store) for f in files]

    def schema(self) -> str:
        names = dict.fromkeys(n for h in self._headers() for n in h.bands)
        return "row int, col int, " + ", ".join(f"`{n}` double" for n in names)

    def reader(self, schema) -> GeoTiffReader:
        return GeoTiffReader(self.options["path"], self._headers(), int(self.options.get("partition_bytes", 32 << 20)), [f.name for f in schema.fields])

    def writer(self, schema, overwrite: bool) -> GeoTiffWriter:
        return GeoTiffWriter(self.options["path"], dict(self.options), [f.name for f in schema.fields], overwrite)


def read_raster(spark, path: str, **options) -> DataFrame:
    """The cells of all files at ``path`` (a file, or a folder of files with one transform); bands that a file lacks are gaps."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiff)
    return spark.read.format("geotiff").options(**options).load(path)


def write_raster(grid: DataFrame, path: str, transform: tuple, crs: str = "", layers: list[str] | None = None, tile: int = TILE) -> None:
    """Writes row, col and layers as a folder of files, one for each tile with cells; tiles are dealt to tasks by one shuffle."""
    spark = grid.sparkSession
    spark.dataSource.register(GeoTiff)
    names = layers or [c for c in grid.columns if c not in ("row", "col", "x", "y")]
    cells = grid.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *[F.col(n).cast("double").alias(n) for n in names])
    place = [F.floor(F.col(c) / tile) for c in ("row", "col")]
    dealt = cells.repartition(*place).sortWithinPartitions(*place)
    epsg = crs.split(":")[-1] if crs.upper().startswith("EPSG:") else ""
    dealt.write.format("geotiff").mode("overwrite").options(transform=json.dumps(list(transform)), tile=tile, epsg=epsg).save(path)
