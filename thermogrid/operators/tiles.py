"""Operators that read a bounded surrounding of each cell, tile by tile.

A cell goes to every tile whose margin holds it, so one shuffle replaces a join per step: what k steps of a
neighbourhood rule do to a cell depends on cells at most k away.  A tile and its margin have a fixed size,
whatever the grid's.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .stats import with_scalars

SIDE = 256


def with_tiles(grid: DataFrame, margin: int, side: int = SIDE) -> DataFrame:
    """Each row once for every tile (tile_row, tile_col) whose margin holds the cell."""
    spans = {f"tile_{a}": F.sequence(F.floor((F.col(a) - margin) / side).cast("int"), F.floor((F.col(a) + margin) / side).cast("int")) for a in ("row", "col")}
    return grid.withColumn("tile_row", F.explode(spans["tile_row"])).withColumn("tile_col", F.explode(spans["tile_col"]))


def _frame(part: pd.DataFrame, margin: int, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(line, column, whether in the tile itself, width) of the rows of a tile in its array with the margin."""
    r = part["row"].to_numpy() - part["tile_row"].iloc[0] * side + margin
    c = part["col"].to_numpy() - part["tile_col"].iloc[0] * side + margin
    own = (r >= margin) & (r < margin + side) & (c >= margin) & (c < margin + side)
    return r, c, own, side + 2 * margin


def _labels(mask: np.ndarray) -> np.ndarray:
    """The smallest cell number of each cell's 4-connected patch; -1 outside."""
    n = np.arange(mask.size).reshape(mask.shape)
    ends = [(n[:, :-1], n[:, 1:], mask[:, :-1] & mask[:, 1:]), (n[:-1], n[1:], mask[:-1] & mask[1:])]
    a, b = (np.concatenate([e[k][e[2]] for e in ends]) for k in (0, 1))
    root = np.arange(mask.size)
    while len(a):
        x, y = root[a], root[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(root, high, low)
        while not np.array_equal(up := root[root], root):
            root = up
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return np.where(mask.ravel(), root, -1).reshape(mask.shape)


def in_large_patch(r: np.ndarray, c: np.ndarray, width: int, min_cells: int) -> np.ndarray:
    """Whether the patch of each of the cells has at least ``min_cells`` of them."""
    cover = np.zeros((width, width), bool)
    cover[r, c] = True
    label = _labels(cover)[r, c]
    return np.bincount(label)[label] >= min_cells


def with_surroundings(grid: DataFrame, margin: int, work: Callable[[pa.Table, np.ndarray, np.ndarray, int], dict[str, np.ndarray]], new: str, side: int = SIDE) -> DataFrame:
    """Adds the columns ``new`` (a schema): what ``work`` makes of each row and of those at most ``margin`` away.

    ``work`` gets the rows of a tile with its margin, their lines and columns in the tile's array, and that array's width.  Rows
    travel whole, and once beside the margins: nothing is joined to them again.
    """
    added = StructType.fromDDL(new)
    schema = StructType([*grid.schema.fields, *added.fields])

    def run(part: pa.Table) -> pa.Table:
        r, c, own, width = _frame(part.select(["row", "col", "tile_row", "tile_col"]).to_pandas(), margin, side)
        told = work(part, r, c, width)
        kept = part.select(grid_columns).filter(pa.array(own))
        for name in names:
            kept = kept.append_column(name, pa.array(told[name][own]))
        return kept

    grid_columns, names = grid.columns, added.names
    return with_tiles(grid, margin, side).groupBy("tile_row", "tile_col").applyInArrow(run, schema)


def large_patches(grid: DataFrame, mask: str, min_cells: int, out: str = "patch", side: int = SIDE) -> DataFrame:
    """Adds ``out``: 1 on masked cells whose 4-connected patch has at least ``min_cells`` cells, else 0.

    A patch of m or more cells holds, around each of its cells, m connected cells at most m - 1 away, so
    a margin of ``min_cells`` - 1 decides every cell without following patches across the grid.
    """
    on = F.coalesce(F.col(mask).cast("double") > 0, F.lit(False))
    if min_cells <= 1:
        return grid.withColumn(out, on.cast("int"))
    margin = min_cells - 1

    def keep(part: pd.DataFrame) -> pd.DataFrame:
        r, c, own, width = _frame(part, margin, side)
        return part.loc[own & in_large_patch(r, c, width, min_cells), ["row", "col"]]

    found = with_tiles(grid.filter(on).select("row", "col"), margin, side).groupBy("tile_row", "tile_col").applyInPandas(keep, "row int, col int")
    return grid.join(found.withColumn(out, F.lit(1)), ["row", "col"], "left").withColumn(out, F.coalesce(out, F.lit(0)))


def regression_fill(grid: DataFrame, layer: str, covariates: list[str], out: str) -> DataFrame:
    """Gaps of ``layer`` by least squares on the covariates where all are known; one aggregate gives the normal equations."""
    x = [*[F.col(c).cast("double") for c in covariates], F.lit(1.0)]
    whole = F.lit(True)
    for c in covariates:
        whole = whole & F.col(c).isNotNull()
    known = grid.filter(whole & F.col(layer).isNotNull())
    k = len(x)
    sums = [F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(x[i] * F.col(layer)).alias(f"b{i}") for i in range(k)]
    s = known.agg(F.count("*").alias("n"), *sums).first()
    if s["n"] < k:
        return grid.withColumn(out, F.col(layer).cast("double"))
    a = np.array([[s[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    unit = 1 / np.sqrt(np.maximum(np.diag(a), 1e-300))
    weights = np.linalg.lstsq(a * unit[:, None] * unit[None, :], np.array([s[f"b{i}"] for i in range(k)]) * unit, rcond=1e-12)[0] * unit
    guess = sum((F.lit(float(w)) * c for w, c in zip(weights, x, strict=True)), F.lit(0.0))
    return grid.withColumn(out, F.coalesce(F.col(layer).cast("double"), F.when(whole, guess)))


def gap_fill(grid: DataFrame, layer: str, covariates: list[str] | None = None, out: str = "filled", sweeps: int = 50, side: int = SIDE) -> DataFrame:
    """Adds ``out``: the layer with gaps filled by regression on the covariates, the rest by diffusion.

    Diffusion starts from the mean and takes the mean of the four neighbours ``sweeps`` times; the grid's edge
    repeats itself.  Only tiles with a remaining gap are worked on, with a margin of ``sweeps`` cells.
    A cell without a row counts as a gap.  Where the layer has no value at all, gaps become 0.
    """
    x = regression_fill(grid, layer, covariates, out) if covariates else grid.withColumn(out, F.col(layer).cast("double"))
    cells = with_scalars(x.select("row", "col", out), F.avg(out).alias("mean"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    spread = with_tiles(cells, sweeps, side)
    floor = lambda a: F.floor(F.col(a) / side).cast("int")
    open_tiles = cells.filter(F.col(out).isNull()).select(floor("row").alias("tile_row"), floor("col").alias("tile_col")).distinct()
    spread = spread.join(open_tiles, ["tile_row", "tile_col"], "left_semi")

    def diffuse(part: pd.DataFrame) -> pd.DataFrame:
        r, c, own, width = _frame(part, sweeps, side)
        value = np.full((width, width), np.nan)
        value[r, c] = part[out].to_numpy(np.float64)
        mean = part["mean"].iloc[0]
        rows = np.clip(np.arange(width), *(part[e].iloc[0] - part["tile_row"].iloc[0] * side + sweeps for e in ("r0", "r1")))
        cols = np.clip(np.arange(width), *(part[e].iloc[0] - part["tile_col"].iloc[0] * side + sweeps for e in ("c0", "c1")))
        rows, cols = np.clip(rows, 0, width - 1), np.clip(cols, 0, width - 1)
        gap = np.isnan(value)
        value[gap] = 0.0 if pd.isna(mean) else mean
        for _ in range(sweeps):
            edged = np.pad(value[np.ix_(rows, cols)], 1, mode="edge")
            near = (edged[2:, 1:-1] + edged[:-2, 1:-1] + edged[1:-1, :-2] + edged[1:-1, 2:]) / 4.0
            value = np.where(gap, near, value)
        put = own & gap[r, c]
        return pd.DataFrame({"row": r[put] - sweeps + part["tile_row"].iloc[0] * side, "col": c[put] - sweeps + part["tile_col"].iloc[0] * side, "_new": value[r[put], c[put]]})

    new = spread.groupBy("tile_row", "tile_col").applyInPandas(diffuse, "row int, col int, _new double")
    return x.join(new, ["row", "col"], "left").withColumn(out, F.coalesce(out, "_new")).drop("_new")
