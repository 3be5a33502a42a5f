"""Candidate sites of cooling measures and their choice under a budget.

Candidates are made and ranked as tables; only the ``top_k`` best, a documented bound, come to the driver, where the
choice is made step by step.  The result's footprints go back to a table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import column


@dataclass(frozen=True)
class Measure:
    """A measure: SQL for where it is possible and for its cooling there, and its cost per square metre."""

    name: str
    feasible: str
    cooling: str
    cost_per_m2: float


def footprint_offsets(distance_px: float, threshold: float = 0.05) -> list[tuple[int, int, float]]:
    """Offsets whose weight exp(-r / d) is at least ``threshold``."""
    n = max(math.ceil(distance_px * math.log(1.0 / threshold)), 0)
    if n < 1:
        return [(0, 0, 1.0)]
    weights = {(r, c): math.exp(-math.hypot(r, c) / distance_px) for r in range(-n, n + 1) for c in range(-n, n + 1)}
    return [(r, c, w) for (r, c), w in weights.items() if w >= threshold]


def candidates(grid: DataFrame, measures: list[Measure], priority: str = "priority", resolution_m: float = 100.0, top_k: int | None = 2000, least_c: float = 1e-3) -> DataFrame:
    """row, col, intervention, cost, area_m2, self_delta_c, rank_key: the ``top_k`` by priority times cooling; all for None, in no order.

    Every cell makes a candidate for each measure that is possible there and cools by more than ``least_c``.
    Ties go to the measure named first, then by row and column; a gap in the priority comes last.
    """
    area = resolution_m * resolution_m
    options = [F.struct(F.lit(k).alias("measure_no"), F.lit(m.name).alias("intervention"), F.lit(m.cost_per_m2 * area).alias("cost"), F.when(column(m.feasible), column(m.cooling).cast("double")).alias("self_delta_c")) for k, m in enumerate(measures)]
    x = grid.select("row", "col", F.col(priority).alias("_p"), F.explode(F.array(*options)).alias("o")).select("row", "col", "_p", "o.*").filter(F.col("self_delta_c") > least_c)
    x = x.withColumn("area_m2", F.lit(area)).withColumn("rank_key", F.col("_p") * F.col("self_delta_c"))
    if top_k is not None:
        x = x.orderBy(F.col("rank_key").desc_nulls_last(), "measure_no", "row", "col").limit(top_k)
    return x.select("row", "col", "intervention", "measure_no", "cost", "area_m2", "self_delta_c", "rank_key")


class Portfolio:
    """Candidates with their footprints and the weights of the cells they reach."""

    def __init__(self, chosen: DataFrame, grid: DataFrame, weight: str = "weight", distance_px: float = 1.0, cap_c: float = 8.0):
        """``chosen`` must be bounded, as by ``candidates``; of ``grid``, only the cells in reach come to the driver."""
        self.spark, self.cap = grid.sparkSession, cap_c
        self.table = chosen.orderBy(F.col("rank_key").desc_nulls_last(), "measure_no", "row", "col").toPandas()
        offsets = footprint_offsets(distance_px)
        at = self.table[["row", "col"]].to_numpy(np.int64).reshape(-1, 2)
        reach = at[:, None, :] + np.array([o[:2] for o in offsets])[None, :, :]
        cells, place = np.unique(reach.reshape(-1, 2), axis=0, return_inverse=True) if len(at) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
        self.cells, self.place = cells, place.reshape(len(at), len(offsets))
        self.weights = np.zeros(len(cells))
        if len(cells):
            wanted = self.spark.createDataFrame([(int(r), int(c), i) for i, (r, c) in enumerate(cells)], "row int, col int, _i int")
            for r in grid.select("row", "col", weight).join(F.broadcast(wanted), ["row", "col"]).filter(F.col(weight).isNotNull()).select("_i", weight).collect():
                self.weights[r[0]] = r[1]
        self.delta = self.table["self_delta_c"].to_numpy(np.float64)[:, None] * np.array([o[2] for o in offsets])[None, :]
        self.cost, self.area = (self.table[c].to_numpy(np.float64) for c in ("cost", "area_m2"))
        self.site = np.unique(at, axis=0, return_inverse=True)[1].reshape(-1) if len(at) else np.zeros(0, np.int64)

    def _left(self) -> np.ndarray:
        return np.clip(1.0 - self.delta / self.cap, 0.0, 1.0)

    def greedy(self, budget: float, area_cap: float) -> list[tuple[int, float]]:
        """(candidate, gain) in the order of choice: each time the largest gain in weighted cooling that still fits.

        Cooling at a cell saturates at the cap; a site gets one measure; ties go to the earlier candidate.
        """
        residual, left = np.ones(len(self.cells)), self._left()
        open_, spent, used, order = np.ones(len(self.table), bool), 0.0, 0.0, []
        while True:
            open_ &= (spent + self.cost <= budget + 1e-9) & (used + self.area <= area_cap + 1e-9)
            if not open_.any():
                return order
            gain = (self.weights[self.place] * self.cap * residual[self.place] * (1.0 - left)).sum(1)
            best = int(np.where(open_, gain, -np.inf).argmax())
            if gain[best] <= 0:
                return order
            order.append((best, float(gain[best])))
            residual[self.place[best]] *= left[best]
            spent, used = spent + self.cost[best], used + self.area[best]
            open_ &= self.site != self.site[best]

    def knapsack(self, budget: float, area_cap: float) -> list[tuple[int, float]]:
        """(candidate, value) by value per cost, values taken alone; what does not fit is passed over."""
        value = (self.weights[self.place] * np.minimum(self.delta, self.cap)).sum(1)
        spent, used, sites, order = 0.0, 0.0, set(), []
        for i in np.argsort(-value / np.maximum(self.cost, 1e-9), kind="stable").tolist():
            if value[i] > 0 and self.site[i] not in sites and spent + self.cost[i] <= budget + 1e-9 and used + self.area[i] <= area_cap + 1e-9:
                order.append((i, float(value[i])))
                sites.add(self.site[i])
                spent, used = spent + self.cost[i], used + self.area[i]
        return order

    def objective(self, chosen: list[int]) -> float:
        """Weighted cooling of a choice, overlaps saturating."""
        residual, left = np.ones(len(self.cells)), self._left()
        for i in chosen:
            residual[self.place[i]] *= left[i]
        return float((self.weights * self.cap * (1.0 - residual)).sum())

    def placements(self, order: list[tuple[int, float]]) -> DataFrame:
        """rank, row, col, intervention, cost, gain, objective (running), one row per chosen site."""
        rows, total = [], 0.0
        for rank, (i, gain) in enumerate(order, 1):
            t = self.table.iloc[i]
            total += gain
            rows.append((rank, int(t["row"]), int(t["col"]), t["intervention"], float(t["cost"]), gain, total))
        return self.spark.createDataFrame(rows, "rank int, row int, col int, intervention string, cost double, gain double, objective double")

    def front(self, budget: float, area_cap: float, shares: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8, 1.0)) -> DataFrame:
        """budget_share, sites, cost, area_m2, objective of the greedy choice at shares of the budget."""
        rows = []
        for share in shares:
            chosen = [i for i, _ in self.greedy(budget * share, area_cap)]
            rows.append((share, len(chosen), float(self.cost[chosen].sum()), float(self.area[chosen].sum()), self.objective(chosen)))
        return self.spark.createDataFrame(rows, "budget_share double, sites int, cost double, area_m2 double, objective double")
