"""The choice of measures among all candidates, as jobs over tables: neither candidates nor cells come to the driver.

Sites.  What a candidate cools alone follows from its own cooling and from a few sums of the weights around its site, the same for
all measures there.  So only cells travel, once, to the tiles around them, and are written with these sums and each measure's
cooling; candidates are a projection of them, worked out where they are read, and only those that a step needs are written.

Greedy.  A candidate interacts only with those whose footprint shares a cell with its own.  One whose gain is the largest of
all it interacts with is taken by the one-by-one greedy before any of them, with this very gain; so all such candidates
are taken at once, the gains of the others are worked out anew, and after a few rounds the one-by-one order is the
order of the gains.  As gains only fall, an old gain is an upper bound: only candidates whose bound reaches a threshold
take part, and the threshold falls until the budget is used up.

Exact choice.  With values taken alone, the problem is a knapsack with two limits and one measure a site.  For multipliers of
cost and area, every site decides for itself, and the sites' best values add up to an upper bound; one aggregate gives
the bounds of a grid of multipliers.  Given a choice, options are left out that no better choice can have; sites
with one option left are settled, and the few others are searched with the same bound.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.formulas import column, feasible
from ..sources.shared import kept
from . import measures as catalogue
from . import stats, tiles
from .portfolio import Measure, footprint_offsets

_EPS = 1e-9
#: Gains are counted by levels, so many to a halving and so many in all.
_STEPS, _LEVELS = 64, 4096
#: Cells in reach of the candidates of a round that are broadcast; of more, Spark deals out the weights.
FEW = 200_000
_OPTION = ("measure_no", "intervention", "cost", "area_m2", "self_delta_c", "rank_key")


@dataclass
class Sites:
    """All candidates with what their footprints reach.

    ``places`` has one row a site, and ``options`` what its candidates are, as columns over it (self_delta_c is NULL where there is
    none); ``weights`` has row, col, weight of the cells that count.
    """

    places: DataFrame
    options: list[dict[str, Column]]
    weights: DataFrame
    cap: float
    offsets: list[tuple[int, int, float]]

    @classmethod
    def of(cls, candidates: DataFrame, grid: DataFrame, weight: str = "weight", distance_px: float = 1.0, cap_c: float = 8.0) -> Sites:
        """Of any candidates (``portfolio.candidates``): they are gathered by their site."""
        offsets = footprint_offsets(distance_px)
        cells = kept(grid.filter(F.col(weight) != 0).select("row", "col", F.col(weight).cast("double").alias("weight")), "weights")
        apart = _apart(candidates.agg(F.max("self_delta_c")).first()[0], offsets, cap_c)
        both = candidates.select("row", "col", *_OPTION).withColumn("_site", F.lit(True)).unionByName(cells, allowMissingColumns=True)
        x = _around(both, "weight", offsets, apart).filter("_site")
        x = x.groupBy("row", "col", *_sums(apart)).agg(F.array_sort(F.collect_list(F.struct(*_OPTION))).alias("o"))
        x = kept(x, "sites")
        most = x.agg(F.max(F.size("o"))).first()[0] or 0
        options = [{n: F.get("o", F.lit(k))[n] for n in _OPTION} for k in range(most)]
        return cls(x, [o | _worth(o["self_delta_c"], offsets, apart, cap_c) for o in options], cells, cap_c, offsets)

    @classmethod
    def of_grid(cls, grid: DataFrame, measures: list[Measure], weight: str = "weight", priority: str = "priority", resolution_m: float = 100.0, distance_px: float = 1.0, cap_c: float = 8.0, least_c: float = 1e-3) -> Sites:
        """The candidates that ``portfolio.candidates`` makes of a grid.  ``park_possible`` is found out if rules ask for it and the grid lacks it."""
        offsets, area = footprint_offsets(distance_px), resolution_m * resolution_m
        said = " ".join(f"{m.feasible} {m.cooling}" for m in measures).lower()
        park = "park_possible" in said and "park_possible" not in grid.columns
        known = grid.withColumn("park_possible", F.lit(True)) if park else grid
        top = known.agg(*[F.max(column(m.cooling).cast("double")).alias(f"d{k}") for k, m in enumerate(measures)], F.count("*").alias("n")).first()
        apart = _apart(max((top[k] for k in range(len(measures)) if top[k] is not None), default=None, key=lambda d: (math.isnan(d), d)), offsets, cap_c)
        names = [c for c in grid.columns if c in ("row", "col", weight, priority) or c.lower() in said]
        vacant = column(feasible("vacant")).alias("_vacant")
        x = catalogue.with_layers(grid, catalogue.ABSENT).select(*names, vacant) if park else grid.select(*names)
        patch = max(1, math.ceil(catalogue.PARK_M2 / area)) if park else 1
        x = _around(x, weight, offsets, apart, patch if park else None)
        deltas = [F.when(column(m.feasible), column(m.cooling).cast("double")).alias(f"_d{k}") for k, m in enumerate(measures)]
        x = x.select("row", "col", F.col(weight).cast("double").alias("weight"), F.col(priority).alias("_p"), *_sums(apart), *deltas)
        places = kept(x.withColumns({f"_d{k}": F.when(F.col(f"_d{k}") > least_c, F.col(f"_d{k}")) for k in range(len(measures))}), "sites")
        options = []
        for k, m in enumerate(measures):
            d = F.col(f"_d{k}")
            own = {"measure_no": F.lit(k), "intervention": F.lit(m.name), "cost": F.lit(m.cost_per_m2 * area), "area_m2": F.lit(area), "self_delta_c": d, "rank_key": F.col("_p") * d}
            options.append(own | _worth(d, offsets, apart, cap_c))
        cells = places.filter(F.col("weight") != 0).select("row", "col", "weight")
        return cls(places, options, cells, cap_c, offsets)

    def listed(self, where: Column | None = None) -> DataFrame:
        """A row for each candidate of the sites where ``where`` (over ``places``) holds, with ``value``, its weighted cooling taken alone, and ``gain``, the same as the greedy counts it.

        Candidates are numbered by what makes them unique, measure and place, so that ties are settled alike everywhere.
        """
        some = self.places if where is None else self.places.filter(where)
        if not self.options:
            none = "measure_no int, intervention string, cost double, area_m2 double, self_delta_c double, rank_key double, value double, gain double"
            x = some.select("row", "col", F.from_json(F.lit(None).cast("string"), none).alias("o")).filter("false")
        else:
            x = some.select("row", "col", F.explode(F.array(*[F.struct(*[v.alias(n) for n, v in o.items()]) for o in self.options])).alias("o"))
        return numbered(x.select("row", "col", "o.*").filter(F.col("self_delta_c").isNotNull()))

    @property
    def table(self) -> DataFrame:
        return self.listed()

    def alone(self) -> DataFrame:
        return self.listed()

    def spread(self, chosen: DataFrame) -> DataFrame:
        """id, row, col (of the cell), left (what the candidate leaves of the cell's possible cooling): a row for each candidate of ``chosen`` and cell in its reach."""
        o = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(w).alias("w")) for r, c, w in self.offsets]))
        x = chosen.select("id", "row", "col", "self_delta_c", o.alias("o"))
        return x.select("id", (F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col"), _left(F.col("self_delta_c"), F.col("o.w"), self.cap).alias("left"))

    def reach(self, chosen: DataFrame) -> DataFrame:
        """``spread`` with the cells' weight.  ``chosen`` should be few: only the weights that they reach are looked up."""
        spread = self.spread(chosen)
        cells = kept(spread.select("row", "col").distinct(), "cells")
        few = F.broadcast(cells) if cells.count() <= FEW else cells
        near = self.weights.join(few, ["row", "col"], "left_semi")
        return spread.join(near, ["row", "col"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def numbered(candidates: DataFrame) -> DataFrame:
    """Adds id, by which ties are settled: the rank, then measure and place."""
    low = F.col("rank_key").isNull().cast("int")
    return candidates.withColumn("id", F.struct(low.alias("gap"), (-F.coalesce("rank_key", F.lit(0.0))).alias("k"), "measure_no", "row", "col"))


def _left(delta: Column, w: Column | float, cap: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - delta * w / cap))


def _apart(top: float | None, offsets: list[tuple[int, int, float]], cap: float) -> list[float]:
    """The footprint's weights with which the largest cooling goes beyond the cap: their cells are summed apart, as cooling is cut there."""
    return sorted({w for _, _, w in offsets if top is not None and not top * w <= cap}, reverse=True)


def _sums(apart: list[float]) -> list[str]:
    return ["_pull", *[f"_ring{k}" for k in range(len(apart))]]


def _worth(delta: Column, offsets: list[tuple[int, int, float]], apart: list[float], cap: float) -> dict[str, Column]:
    """value and gain of a candidate by the sums around its site."""
    rings = [(F.col(f"_ring{k}"), w) for k, w in enumerate(apart)]
    value = sum((s * F.least(delta * w, F.lit(cap)) for s, w in rings), delta * F.col("_pull"))
    gain = sum((s * cap * (1.0 - _left(delta, w, cap)) for s, w in rings), F.greatest(F.lit(0.0), delta) * F.col("_pull"))
    return {n: F.when(delta.isNotNull(), x) for n, x in (("value", value), ("gain", gain))}


def _around(x: DataFrame, weight: str, offsets: list[tuple[int, int, float]], apart: list[float], patch: int | None = None) -> DataFrame:
    """Adds the sums of ``weight`` around each row: ``_pull`` by the footprint, and ``_ring`` for each weight that stands apart.

    With ``patch``, also ``park_possible``: whether the cell's patch of ``_vacant`` ground has so many cells.
    """
    n = max(max(abs(r), abs(c)) for r, c, _ in offsets)

    def work(part: pa.Table, r: np.ndarray, c: np.ndarray, width: int) -> dict[str, np.ndarray]:
        cells = np.zeros((width + 2 * n, width + 2 * n))
        np.add.at(cells, (r + n, c + n), pc.fill_null(part[weight].cast(pa.float64()), 0.0).to_numpy())
        out = {name: np.zeros(len(r)) for name in _sums(apart)}
        for y, z, w in offsets:
            seen = cells[r + n + y, c + n + z]
            if w in apart:
                out[f"_ring{apart.index(w)}"] += seen
            else:
                out["_pull"] += w * seen
        if patch is not None:
            on = pc.fill_null(part["_vacant"], False).to_numpy()
            out["park_possible"] = on.copy()
            if on.any():
                out["park_possible"][on] = tiles.in_large_patch(r[on], c[on], width, patch)
        return out

    new = ", ".join([*[f"{name} double" for name in _sums(apart)], *["park_possible boolean"] * (patch is not None)])
    return tiles.with_surroundings(x, max(n, (patch or 1) - 1), work, new)


def taken(sites: Sites, chosen: DataFrame) -> DataFrame:
    """row, col, residual: what chosen candidates (id, row, col, self_delta_c) leave of the cells that they reach."""
    left = F.exp(F.sum(F.log(F.when(F.col("left") > 0, F.col("left")))))
    r = sites.spread(chosen).groupBy("row", "col").agg(left.alias("l"), F.min("left").alias("least"))
    return r.select("row", "col", F.when(F.col("least") > 0, F.col("l")).otherwise(0.0).alias("residual"))


def _rounds(sites: Sites, bounds: DataFrame, fixed: DataFrame, threshold: float) -> DataFrame:
    """The candidates of ``bounds`` (at least id, row, col, self_delta_c, gain) that the greedy takes with a gain of at least ``threshold``, given what is ``fixed``, with that gain.

    ``bounds`` has all candidates whose gain taken alone may reach the threshold.
    """
    live = kept(bounds.join(fixed.select("row", "col"), ["row", "col"], "left_anti").drop("gain"), "live")
    reach = kept(sites.reach(live), "reach")
    residual, found = taken(sites, fixed), []
    while True:
        now = reach.join(live.select("id"), "id", "left_semi").join(residual, ["row", "col"], "left")
        gains = now.groupBy("id").agg(F.sum(F.col("weight") * sites.cap * F.coalesce("residual", F.lit(1.0)) * (1.0 - F.col("left"))).alias("gain"))
        gains = kept(live.join(gains, "id").filter((F.col("gain") >= threshold) & (F.col("gain") > 0)), "gains")
        own = F.struct((-F.col("gain")).alias("g"), F.col("id").alias("id"))
        told = reach.join(gains.select("id", "gain"), "id").select("id", "row", "col", own.alias("own"))
        first = told.groupBy("row", "col").agg(F.min("own").alias("first"))
        ahead = told.join(first, ["row", "col"]).groupBy("id").agg(F.min((F.col("own") == F.col("first")).cast("int")).alias("leads"))
        won = kept(gains.join(ahead.filter("leads = 1").select("id"), "id", "left_semi"), "won")
        if won.isEmpty():  # someone leads as long as there is anyone
            return reduce(DataFrame.unionByName, found, won)
        found.append(won)
        # winners share no cell, so each cell is cut once
        cut = reach.join(won.select("id"), "id", "left_semi").select("row", "col", F.col("left").alias("residual"))
        both = residual.withColumn("r", F.lit(1)).unionByName(cut.withColumn("r", F.lit(2))).groupBy("row", "col")
        both = both.agg(F.min(F.when(F.col("r") == 1, F.col("residual"))).alias("a"), F.min(F.when(F.col("r") == 2, F.col("residual"))).alias("b"))
        residual = kept(both.select("row", "col", (F.coalesce("a", F.lit(1.0)) * F.coalesce("b", F.lit(1.0))).alias("residual")), "residual")
        live = gains.join(won.select("row", "col"), ["row", "col"], "left_anti").drop("gain")


def greedy(sites: Sites, budget: float, area_cap: float) -> DataFrame:
    """id, row, col, intervention, cost, area_m2, self_delta_c, gain, phase, in no order: the choice of taking the largest gain that still fits, over and over.

    The order of choice is that of the phases, and within one that of falling gains (``phase`` ascending, then ``gain`` descending).
    When a candidate does not fit, those that cost more than what is left are out, and the rest goes on from there;
    there are at most as many such phases as there are costs.
    """
    bounds = lambda where=None: sites.listed(where).select("id", "row", "col", "intervention", "cost", "area_m2", "self_delta_c", "gain").filter(F.col("gain") > 0)
    fits = lambda x: x.filter((F.col("cost") <= left_cost + _EPS) & (F.col("area_m2") <= left_area + _EPS))
    known = bounds()
    most = known.agg(F.max("gain")).first()[0]
    chosen, phase = None, 0
    left_cost, left_area = budget, area_cap
    empty = known.limit(0).withColumn("phase", F.lit(0))
    level = F.least(F.lit(_LEVELS), F.greatest(F.lit(0), F.floor(-F.log2(F.col("gain") / F.lit(most)) * _STEPS).cast("int")))
    while most:
        fixed = chosen if chosen is not None else empty
        levels = fits(known).groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("cost").alias("cost"), F.min("area_m2").alias("area")).orderBy("level").collect()  # at most ``_LEVELS`` and one rows
        if not levels:
            break
        all_ = sum(r["n"] for r in levels)
        # how many can fit at most: so many of the best bounds are enough at first
        many = min(all_, max(64, int(2 * min(left_cost / max(min(r["cost"] for r in levels), _EPS), left_area / max(min(r["area"] for r in levels), _EPS)))))
        while True:
            threshold = _threshold(levels, most, many)
            least = threshold * (1 - 1e-6)  # bounds are summed in another order than gains
            near = fits(bounds(reduce(lambda x, y: x | y, [o["gain"] >= least for o in sites.options])).filter(F.col("gain") >= least))
            found = kept(_rounds(sites, near, fixed, threshold), "phase")
            total = found.agg(F.sum("cost").alias("cost"), F.sum("area_m2").alias("area")).first()
            if threshold == 0.0 or (total["cost"] or 0.0) > left_cost + _EPS or (total["area"] or 0.0) > left_area + _EPS:
                break
            many = min(all_, 4 * many)
        ordered = stats.running_sums(found, "gain", ["id"], _cost="cost", _area="area_m2")
        over = (F.col("_cost") > left_cost + _EPS) | (F.col("_area") > left_area + _EPS)
        part = kept(ordered.filter(~over).drop("_cost", "_area").withColumn("phase", F.lit(phase)), "part")  # sums only grow
        used = part.agg(F.count("*").alias("n"), F.sum("cost").alias("cost"), F.sum("area_m2").alias("area")).first()
        whole = used["n"] == found.count()
        if used["n"]:
            columns = fixed.columns
            chosen = part.select(columns) if chosen is None else kept(chosen.unionByName(part.select(columns)), "chosen")
            left_cost, left_area = left_cost - used["cost"], left_area - used["area"]
        if whole or not used["n"]:
            break
        phase += 1
    return chosen if chosen is not None else empty


def _threshold(levels: list, most: float, many: int) -> float:
    """A gain that at least ``many`` candidates reach, by their counts in levels of falling gains; 0 where all are needed."""
    seen = 0
    for r in levels[:-1]:
        seen += r["n"]
        if seen >= many:
            return most * 2.0 ** (-(r["level"] + 1) / _STEPS) * (1 - _EPS)
    return 0.0


def in_order(chosen: DataFrame) -> DataFrame:
    """rank, row, col, intervention, cost, gain, objective (running) of a greedy choice."""
    # a phase's gains lie below a whole number of its own, so that one falling number orders all
    most = chosen.agg(F.max("gain")).first()[0] or 1.0
    x = chosen.withColumn("_one", F.lit(1)).withColumn("_o", F.col("gain") / (2.0 * most) - F.col("phase"))
    return stats.running_sums(x, "_o", ["id"], rank="_one", objective="gain").select(F.col("rank").cast("int").alias("rank"), "row", "col", "intervention", "cost", "gain", "objective")


# --- exact choice --------------------------------------------------------------------------------------------------


@dataclass
class Exact:
    """The choice (id, row, col, intervention, cost, area_m2, value) with its value, an upper bound, and whether it is proven best."""

    placements: DataFrame
    value: float
    bound: float
    proven: bool
    open_sites: int

    @property
    def gap(self) -> float:
        return max(0.0, self.bound - self.value) / max(abs(self.bound), _EPS)


def _reduced(n: int, a: float | Column, b: float | Column) -> list[Column]:
    """The values of a site's options less what they cost by the multipliers; a site has columns v, c and s of each option."""
    return [F.col(f"v{k}") - (a * F.col(f"c{k}") + b * F.col(f"s{k}")) for k in range(n)]


def _best(reduced: list[Column]) -> Column:
    return F.greatest(F.lit(0.0), F.lit(0.0), *reduced)  # NULL, no option, is passed over


def _dual(options: DataFrame, n: int, budget: float, area_cap: float, grid: list[tuple[float, float]]) -> list[float]:
    """The upper bound for each pair of multipliers (cost, area): one aggregate over sites.

    Sites without an option that pays at the least multipliers add nothing to any of them.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(grid)]))
    paying = options.filter(_best(_reduced(n, *(min(g[i] for g in grid) for i in (0, 1)))) > 0).select("*", pairs.alias("m"))
    s = dict(paying.groupBy("m.k").agg(F.sum(_best(_reduced(n, F.col("m.a"), F.col("m.b"))))).collect())  # one row for each pair
    return [s.get(k, 0.0) + a * budget + b * area_cap for k, (a, b) in enumerate(grid)]


def _multipliers(options: DataFrame, n: int, budget: float, area_cap: float, passes: int) -> tuple[float, float, float]:
    """(bound, cost multiplier, area multiplier) by grids of multipliers that close in; the bound is convex in both."""
    tops = [F.max(F.greatest(F.lit(0.0), *[F.col(f"v{k}") / F.col(f"{per}{k}") for k in range(n)])).alias(to) for per, to in (("c", "a"), ("s", "b"))]
    s = options.agg(*tops).first()
    (a0, a1), (b0, b1) = (0.0, s["a"] or 0.0), (0.0, s["b"] or 0.0)
    best = (float("inf"), 0.0, 0.0)
    for _ in range(passes):
        xs, ys = np.linspace(a0, a1, 5), np.linspace(b0, b1, 5)
        grid = [(float(x), float(y)) for x in xs for y in ys]
        best = min([best, *((v, *g) for v, g in zip(_dual(options, n, budget, area_cap, grid), grid, strict=True))])
        da, db = (a1 - a0) / 3, (b1 - b0) / 3
        a0, a1 = max(0.0, best[1] - da), best[1] + da
        b0, b1 = max(0.0, best[2] - db), best[2] + db
    return best


def _search(groups: list[list[tuple]], budget: float, area: float, a: float, b: float, value: float, best: float, nodes: int) -> tuple[float, list | None, bool]:
    """The best way through sites with open options (value, cost, area, index; one of them may be no measure), by depth first with the dual bound."""
    rest = [0.0]
    for g in reversed(groups):
        rest.append(rest[-1] + max(v - a * c - b * s for v, c, s, _ in g))
    rest.reverse()
    found, left, stack = None, nodes, [(0, budget, area, value, ())]
    while stack:
        k, money, room, now, path = stack.pop()
        left -= 1
        if left < 0:
            return best, found, False
        if now + rest[k] + a * money + b * room <= best + _EPS:
            continue
        if k == len(groups):
            if now > best + _EPS:
                best, found = now, list(path)
            continue
        for option in sorted(groups[k], key=lambda o: o[0] - a * o[1] - b * o[2]):  # the most promising is looked at first
            if option[1] <= money + _EPS and option[2] <= room + _EPS:
                stack.append((k + 1, money - option[1], room - option[2], now + option[0], (*path, option[3])))
    return best, found, True


def exact(sites: Sites, budget: float, area_cap: float, passes: int = 8, most_open: int = 400, nodes: int = 200_000) -> Exact:
    """The choice of greatest total value taken alone, one measure a site, within budget and area; proven, or with its gap.

    Of the sites that the bound does not settle at most ``most_open`` come to the driver, those that matter most; if
    there are more, or the search takes more than ``nodes`` steps, the result says that it is not proven, and its gap.
    """
    columns, n, spark = ["id", "row", "col", "intervention", "cost", "area_m2", "self_delta_c", "value"], len(sites.options), sites.places.sparkSession
    fits = lambda o: (o["value"] > 0) & (o["cost"] <= budget + _EPS) & (o["area_m2"] <= area_cap + _EPS)
    # all options of a site stand in its row, so that no step over all sites moves rows
    wide = {f"{p}{k}": x for k, o in enumerate(sites.options) for p, x in (("v", F.when(fits(o), o["value"])), ("c", o["cost"]), ("s", o["area_m2"]), ("i", o["intervention"]))}
    x = sites.places.withColumns(wide)
    options = x.select("row", "col", *wide)
    if options.filter(reduce(lambda y, z: y | z, [F.col(f"v{k}").isNotNull() for k in range(n)], F.lit(False))).isEmpty():
        return Exact(kept(sites.listed().select(columns).limit(0), "exact"), 0.0, 0.0, True, 0)
    bound, a, b = _multipliers(options, n, budget, area_cap, passes)
    reduced = _reduced(n, a, b)
    tops = replace(sites, places=x).listed(_best(reduced) > 0).filter(fits({c: F.col(c) for c in columns})).withColumn("r", F.col("value") - (a * F.col("cost") + b * F.col("area_m2")))
    tops = tops.groupBy("row", "col").agg(F.max_by(F.struct(*[c for c in columns if c not in ("row", "col")]), F.struct("r", -F.col("cost"))).alias("t"), F.max("r").alias("best"))
    tops = kept(tops.select("row", "col", "best", "t.*"), "tops")
    # a first choice: the sites' best options by their reduced value, as far as the limits go
    within = stats.running_sums(tops, "best", ["id"], _cost="cost", _area="area_m2").filter((F.col("_cost") <= budget + _EPS) & (F.col("_area") <= area_cap + _EPS))
    first = kept(within.select(columns), "first")
    low = first.agg(F.sum("value")).first()[0] or 0.0
    # options that a better choice can have: taking one instead of the site's best lowers the bound by its regret
    slack = max(0.0, bound - low) + _EPS
    at_site = [F.lit(0.0), *[F.col(f"r{k}") for k in range(n)]]  # the first is no measure
    ties = sum((F.coalesce((r == F.col("best")).cast("int"), F.lit(0)) for r in at_site), F.lit(0))
    next_ = F.col("best") - F.greatest(F.lit(None).cast("double"), *[F.when(r < F.col("best"), r) for r in at_site])
    judged = options.withColumns({f"r{k}": r for k, r in enumerate(reduced)}).withColumn("best", F.greatest(F.lit(0.0), *at_site))
    judged = judged.select("*", F.inline(F.array(F.struct(ties.alias("ties"), F.when(next_ <= slack, next_).alias("matters")))))
    undecided = judged.filter("ties > 1 OR matters IS NOT NULL")
    sites_open = undecided.count()
    rows = sorted(undecided.orderBy("matters", "row", "col").limit(most_open).collect(), key=lambda r: (r["row"], r["col"]))
    groups = []
    for r in rows:
        told = [(0.0, 0.0, 0.0, None), *[(r[f"v{k}"], r[f"c{k}"], r[f"s{k}"], (r["row"], r["col"], r[f"i{k}"])) for k in range(n) if r[f"v{k}"] is not None]]
        groups.append([o for o in told if r["best"] - (o[0] - (a * o[1] + b * o[2])) <= slack])
    keys = StructType([options.schema["row"], options.schema["col"]])
    at = spark.createDataFrame([(r["row"], r["col"]) for r in rows], keys)
    settled = tops.join(F.broadcast(at), ["row", "col"], "left_anti").select(columns)  # the others, open or not, keep their best option
    s = settled.agg(F.sum("cost").alias("cost"), F.sum("area_m2").alias("area"), F.sum("value").alias("value")).first()
    spent, used, sure = (s[k] or 0.0 for k in ("cost", "area", "value"))
    ordered = sorted(groups, key=lambda g: -max(v - a * c - b * z for v, c, z, _ in g))
    value, path, done = (low, None, True)
    if spent <= budget + _EPS and used <= area_cap + _EPS:
        value, path, done = _search(ordered, budget - spent, area_cap - used, a, b, sure, low, nodes)
    proven = done and sites_open <= most_open
    placements = first
    if path is not None:
        picked = F.broadcast(spark.createDataFrame([p for p in path if p is not None], keys.add("intervention", "string")))  # at most ``most_open`` rows
        there = replace(sites, places=sites.places.join(picked.select("row", "col"), ["row", "col"], "left_semi")).listed()
        placements = settled.unionByName(there.join(picked, ["row", "col", "intervention"], "left_semi").select(columns))
    return Exact(kept(placements, "exact"), value, value if proven else bound, proven, sites_open)
