"""Exact top-k search by inner product, block at a time.

Rows are ordered by a coarse code of their vectors and cut into blocks, so that a block holds similar ones; several
blocks share a shelf, which one task can hold.  A block is its own forward index (the matrix of its quantised
vectors) with the largest and smallest value of every dimension: a query's summed products with these extremes bound
every score in the block.  A query first searches the shelf of its own code, which gives it a k-th best score.  Then
the extremes of whole shelves, broadcast in portions of a fixed size, bound what each other shelf can hold, and the
query travels only to those whose bound reaches its score.  On a shelf each query takes the blocks in its own order of
bounds; blocks are left out as soon as the bound is below the k-th best score so far.

Queries travel to shelves, never blocks to queries: a shelf's rows come first in its partition, and the queries
stream past them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Workspace

BLOCK = 256
#: Rows of a shelf: at most this many, and at most so many vector components.
SHELF, COMPONENTS = 65_536, 1 << 22
QUERIES = 512
#: Numbers of shelves' extremes that are broadcast at a time.
PORTION = 1 << 22
#: Blocks that every query of a batch takes in its own order; most k-th scores are found there.
OWN_ORDER = 8
_HITS = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, q (array of floor(scale * x)), dim; rows without a vector or with a null or non-finite part are left out."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    good = F.col("embedding").isNotNull() & F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))), F.lit(False))
    kept = vectors.filter(good & F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
    return kept.select("vec_id", F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("q"), F.size("embedding").alias("dim"))


def matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.int64).reshape(-1, dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed over integers, by floating point where that is exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    wide = a.astype(object) @ b.astype(object).T
    if max(abs(int(wide.max())), abs(int(wide.min()))) >= 2**63:
        raise OverflowError("a score does not fit into 64 bits")
    return wide.astype(np.int64)


def bounds(q: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and each row of extremes, at least the largest product with any vector between them.

    What rounding can take off is added again, measured by the sizes of the terms, which may cancel each other.
    """
    wide = q.astype(np.float64)
    size = np.abs(wide) @ np.maximum(np.abs(top), np.abs(low)).T
    return np.maximum(wide, 0) @ top.T + np.minimum(wide, 0) @ low.T + size * 1e-12


class Shelf:
    """Blocks of similar rows with their extremes; ``scored`` and ``pairs`` count query-block pairs scored and met."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, block: np.ndarray):
        order = np.lexsort((ids, block))
        self.ids, self.rows = ids[order], rows[order]
        first = np.flatnonzero(np.diff(block[order], prepend=-1))
        self.edges = np.append(first, len(ids))
        self.top = np.maximum.reduceat(self.rows, first, axis=0).astype(np.float64)
        self.low = np.minimum.reduceat(self.rows, first, axis=0).astype(np.float64)
        self.scored = self.pairs = 0

    def search(self, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, vec_id, score) of each query's k best here that reach its floor, ties to smaller ids."""
        bound = bounds(q, self.top, self.low)
        self.pairs += bound.size
        least, none = floor.astype(np.float64), np.zeros(0, np.int64)
        held, seen = (none, none, none), np.zeros(bound.shape, bool)

        def score(b: int, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            self.scored += len(ask)
            seen[ask, b] = True
            lo, hi = self.edges[b], self.edges[b + 1]
            s = products(q[ask], self.rows[lo:hi])
            u, v = np.nonzero((s >= least[ask][:, None]) & (self.ids[lo:hi][None, :] != own[ask][:, None]))
            return ask[u], self.ids[lo + v], s[u, v]

        def merged(found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The best k of each query, whose k-th score becomes its floor."""
            all_ = tuple(np.concatenate(x) for x in zip(held, *found, strict=True))
            order = np.lexsort((all_[1], -all_[2], all_[0]))
            all_ = tuple(x[order] for x in all_)
            rank = np.arange(len(all_[0])) - np.searchsorted(all_[0], all_[0])
            all_ = tuple(x[rank < k] for x in all_)
            last = rank[rank < k] == k - 1
            least[all_[0][last]] = np.maximum(least[all_[0][last]], all_[2][last].astype(np.float64))
            return all_

        turns = min(OWN_ORDER, bound.shape[1])
        first = np.argsort(-bound, axis=1, kind="stable")[:, :turns]
        every = np.arange(len(q))
        for turn in range(turns):
            b = first[:, turn]
            ask = every[bound[every, b] >= least]
            found = [score(int(one), ask[b[ask] == one]) for one in np.unique(b[ask])]
            if found:
                held = merged(found)
        for b in np.argsort(-np.where(seen, -np.inf, bound).max(0), kind="stable"):  # the rest, together
            ask = np.flatnonzero((bound[:, b] >= least) & ~seen[:, b])
            if len(ask):
                held = merged([score(int(b), ask)])
        return held


def extremes(rows: DataFrame) -> DataFrame:
    """dim, shelf, pos, top, low: the largest and smallest component of each shelf; tasks merge their rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            dim, shelf = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("dim", "shelf"))
            order = np.lexsort((shelf, dim))
            for part in np.split(order, np.flatnonzero((np.diff(dim[order]) != 0) | (np.diff(shelf[order]) != 0)) + 1) if len(order) else []:
                key = (int(dim[part[0]]), int(shelf[part[0]]))
                q = matrix(batch.column("q").take(pa.array(part)), key[0])
                top, low = q.max(0), q.min(0)
                if key in found:
                    top, low = np.maximum(top, found[key][0]), np.minimum(low, found[key][1])
                found[key] = (top, low)
        for (dim, shelf), (top, low) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim, np.int32)), pa.array(np.full(dim, shelf)), pa.array(np.arange(dim, dtype=np.int32)), pa.array(top), pa.array(low)], names=["dim", "shelf", "pos", "top", "low"])

    parts = rows.select("dim", "shelf", "q").mapInArrow(run, "dim int, shelf long, pos int, top long, low long")
    return parts.groupBy("dim", "shelf", "pos").agg(F.max("top").alias("top"), F.min("low").alias("low"))


def promising(asked: DataFrame, ends: DataFrame, portion: int = PORTION) -> DataFrame:
    """dim, vec_id, q, floor, shelf: each query (with its home shelf) for every other shelf whose bound reaches its floor."""
    # portions of whole shelves, numbered by the components that come before them
    sizes = ends.groupBy("dim", "shelf").agg(F.count("*").alias("n"))
    steps = [(r["dim"], r["first"], r["last"]) for r in sizes.groupBy("dim", F.floor(F.col("shelf") * F.col("dim") / portion)).agg(F.min("shelf").alias("first"), F.max("shelf").alias("last")).orderBy("dim", "first").collect()]
    out = None
    for dim, first, last in steps:
        part = ends.filter((F.col("dim") == dim) & F.col("shelf").between(first, last)).orderBy("shelf", "pos").toPandas()  # at most ``portion`` rows, and one shelf
        shelves = part["shelf"].to_numpy()[::dim]
        top, low = (part[c].to_numpy(np.float64).reshape(-1, dim) for c in ("top", "low"))
        told = asked.sparkSession.sparkContext.broadcast((shelves, top, low))

        def run(batches: Iterator[pa.RecordBatch], told=told, dim=dim) -> Iterator[pa.RecordBatch]:
            shelves, top, low = told.value
            for batch in batches:
                for at in range(0, batch.num_rows, QUERIES):
                    some = batch.slice(at, QUERIES)
                    floor = np.asarray(some.column("floor").fill_null(-(1 << 62)), np.float64)
                    reach = bounds(matrix(some.column("q"), dim), top, low) >= floor[:, None]
                    i, j = np.nonzero(reach & (shelves[None, :] != some.column("home").to_numpy()[:, None]))
                    sent = some.take(pa.array(i))
                    yield pa.RecordBatch.from_arrays([sent.column("dim"), sent.column("vec_id"), sent.column("q"), sent.column("floor"), pa.array(shelves[j])], names=["dim", "vec_id", "q", "floor", "shelf"])

        sent = asked.filter(F.col("dim") == dim).select("dim", "vec_id", "q", "floor", "home").mapInArrow(run, "dim int, vec_id long, q array<long>, floor long, shelf long")
        out = sent if out is None else out.unionByName(sent)
    return out if out is not None else asked.select("dim", "vec_id", "q", "floor", F.col("home").alias("shelf")).limit(0)


def searched(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k best rows of each shelf for each query sent there; both have shelf, dim, block, vec_id, q, and floor."""
    columns = ["shelf", "dim", "asks", "block", "vec_id", "q", "floor"]
    both = rows.withColumns({"asks": F.lit(False), "floor": F.lit(None).cast("long")}).select(*columns)
    both = both.unionByName(asked.withColumns({"asks": F.lit(True), "block": F.lit(0).cast("long")}).select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, shelf = None, [], None
        for batch in batches:
            place, dim, asks = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("shelf", "dim", "asks"))
            new = np.flatnonzero((place[1:] != place[:-1]) | (dim[1:] != dim[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *new], [*new, len(place)], strict=True):
                part = batch.slice(a, b - a)
                ids, q = np.asarray(part.column(4), np.int64), matrix(part.column(5), int(dim[a]))
                if (place[a], dim[a]) != key:
                    key, parts, shelf = (place[a], dim[a]), [], None
                if not asks[a]:
                    parts.append((ids, q, np.asarray(part.column(3), np.int64)))
                    continue
                if shelf is None and parts:
                    shelf, parts = Shelf(*(np.concatenate(x) for x in zip(*parts, strict=True))), []
                floor = np.asarray(part.column(6).fill_null(-(1 << 62)), np.int64)
                for at in range(0, len(ids) if shelf is not None else 0, QUERIES):
                    own = ids[at : at + QUERIES]
                    i, found, score = shelf.search(q[at : at + QUERIES], own, floor[at : at + QUERIES], k)
                    yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    sort = ["shelf", "dim", "asks"]
    return both.repartition("shelf", "dim").sortWithinPartitions(*sort).mapInArrow(run, _HITS)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best rows of ``vectors`` for each row of ``queries``.

    Both have vec_id and embedding.  Components become floor(scale * x); the score is the integer inner
    product, and one beyond 64 bits an error; ties go to the smaller vec_id.  Rows that are null, hold a null or non-finite component or
    have no id take no part.  Vectors are compared with those of their own length; an empty vector matches
    nothing; a score beyond 64 bits raises an error.  A row that repeats an id is another candidate, but never one for a query of that id; a repeated
    query is answered once.  Extra columns are ignored, an empty table gives an empty result.
    """
    work = Workspace(vectors.sparkSession, "topk")
    rows, asked = quantised(vectors, scale), quantised(queries, scale)
    asked = asked.groupBy("vec_id").agg(F.min(F.struct("q", "dim")).alias("x")).select("vec_id", "x.*")
    n, widest = rows.agg(F.count("*"), F.max("dim")).first()
    size = block * max(1, min(SHELF, COMPONENTS // (widest or 1), n // 64) // block)
    # similar vectors share a block: the signs of the first dimensions order them coarsely
    code = F.aggregate(F.slice("q", 1, 12), F.lit(0).cast("long"), lambda a, v: a * 2 + (v >= 0).cast("long"))
    coarse = rows.withColumn("code", code)
    cells = coarse.groupBy("dim", "code").agg(F.count("*").alias("in_cell"))
    before = F.sum("in_cell").over(Window.partitionBy("dim").orderBy("code").rowsBetween(Window.unboundedPreceding, -1))
    cells = work.keep(cells.withColumn("before", F.coalesce(before, F.lit(0))), "cells")  # at most 4096 a length
    slot = F.col("before") + F.pmod(F.xxhash64("vec_id", "q"), F.col("in_cell"))
    table = coarse.join(F.broadcast(cells), ["dim", "code"]).select("dim", "vec_id", "q", F.floor(slot / size).alias("shelf"), F.floor(slot / block).alias("block"))
    table = work.keep(table, "rows")
    home = asked.withColumn("code", code).join(F.broadcast(cells), ["dim", "code"], "left")
    home = work.keep(home.select("dim", "vec_id", "q", F.coalesce(F.floor(F.col("before") / size), F.lit(0)).cast("long").alias("shelf")), "asked")
    hits = work.keep(searched(table, home.withColumn("floor", F.lit(None).cast("long")), k), "hits-home")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = hits.groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").alias("floor"), F.count("*").alias("n")).filter(F.col("n") >= k)
    away = work.keep(home.withColumnRenamed("shelf", "home").join(floors.drop("n"), "vec_id", "left"), "floors")
    away = promising(away, work.keep(extremes(table), "extremes"))
    hits = hits.unionByName(searched(table, away, k))
    out = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
