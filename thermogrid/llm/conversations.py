"""Repair of conversations whose turns are out of order, empty, repeated or cut off.

A conversation should read as the role grammar says: an optional system row and then pairs of user and assistant rows, or
nothing.  An error-correcting Earley parser finds the cheapest edits that make it so.  The grammar's productions say which
rows may follow (keep), and besides them which row may be left out (delete), take another role (rerole) or be thought
in between (insert).  All of them are left-linear, so that every item of the chart begins at the first row: a
column holds one item for each production and dot, with the least (cost, audit), and the chart is as long as the
conversation.  The audit is the string of the edits' initials.  Of equal cost the ASCII-least audit is taken; comparing
prefixes is safe, because audits of one nonterminal over the same rows of which one begins the other differ in cost.

Rows stream through the parser in order.  What the audits of all live items have in common is decided: it is handed out
and its rows are forgotten, so that a conversation of any length takes little memory, besides its audit.
"""

from __future__ import annotations

import hashlib
import os
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
_SPACES = " \\t\\n\\u000B\\f\\r"


@dataclass(frozen=True)
class Production:
    """``left`` becomes ``of`` and then a row with the given edit; a kept row must have the role's initial ``role``."""

    left: str
    of: str
    edit: str
    role: str = ""


def _turn(left: str, role: str, *before: str) -> list[Production]:
    """A user or assistant row after ``before``: kept, of another role before, or inserted."""
    return [Production(left, of, edit, role if edit == KEEP else "") for of in before for edit in (KEEP, REROLE, INSERT)]


#: Nonterminals are named by what the rows so far end with.
GRAMMAR: list[Production] = [
    Production("system", "start", KEEP, "s"),
    *_turn("user", "u", "start", "system", "assistant"),
    *_turn("assistant", "a", "user"),
    *[Production(n, n, DELETE) for n in ("start", "system", "user", "assistant")],
]
#: Nonterminals that make a whole conversation.
WHOLE = ("start", "assistant")
#: What it costs at most to go on from one nonterminal as from any other: an inserted row, and a deleted system row or a second inserted one.
SLACK = COST[INSERT] + max(COST[DELETE], COST[INSERT])


class Chart:
    """The columns of an Earley chart, of which only the last is kept: completed nonterminals with their least (cost, audit)."""

    def __init__(self, grammar: list[Production] = GRAMMAR, start: str = "start"):
        # predicted once, at the first row: items with the dot behind a nonterminal, by that nonterminal
        self.waiting: dict[str, list[Production]] = {}
        for p in grammar:
            self.waiting.setdefault(p.of, []).append(p)
        self.done: dict[str, tuple[int, str]] = {}
        self._complete({start: (0, "")})

    def _complete(self, seeds: dict[str, tuple[int, str]]) -> None:
        """Completes the nonterminals of a column, cheapest first; insertions complete others in the same column."""
        heap, self.done = [], {}
        for name, (cost, audit) in seeds.items():
            heappush(heap, (cost, audit, name))
        while heap:
            cost, audit, name = heappop(heap)
            if name in self.done:
                continue
            self.done[name] = (cost, audit)
            for p in self.waiting.get(name, ()):
                if p.edit == INSERT and p.left not in self.done:
                    heappush(heap, (cost + COST[INSERT], audit + INSERT, p.left))

    def scan(self, role: str, fault: str) -> None:
        """Moves over one row: its role's initial, and its fault: "" none, "truncated", or another that must be deleted."""
        seeds: dict[str, tuple[int, str]] = {}
        for name, (cost, audit) in self.done.items():
            for p in self.waiting.get(name, ()):
                if p.edit == DELETE:
                    extra = COST[DELETE]
                elif p.edit == INSERT or fault not in ("", "truncated") or p.role not in ("", role):
                    continue
                else:
                    extra = COST[p.edit] + (TRUNCATED_COST if fault else 0)
                item = (cost + extra, audit + p.edit)
                if p.left not in seeds or item < seeds[p.left]:
                    seeds[p.left] = item
        self._complete(seeds)

    def decided(self) -> str:
        """What all live audits begin with; it is cut off from them.  Items too dear ever to win are dropped first."""
        most = min(self.done.values())[0] + SLACK
        self.done = {n: item for n, item in self.done.items() if item[0] <= most}
        common = os.path.commonprefix([a for _, a in self.done.values()])
        if common:
            self.done = {n: (c, a[len(common) :]) for n, (c, a) in self.done.items()}
        return common

    def result(self, whole: tuple[str, ...] = WHOLE) -> tuple[int, str]:
        return min(self.done[n] for n in whole if n in self.done)


@lru_cache(maxsize=1 << 16)
def repair(rows: tuple[tuple[str, str], ...]) -> tuple[int, str]:
    """(cost, audit) of a short conversation, given as (role's initial, fault) of its rows."""
    chart = Chart()
    for role, fault in rows:
        chart.scan(role, fault)
    return chart.result()


class Edited:
    """Carries out an audit, bit by bit, on the rows that it is about; keeps the digest of the repaired conversation."""

    def __init__(self):
        self.rows: deque[tuple[str, str]] = deque()
        self.sha, self.written, self.system = hashlib.sha256(), 0, 0

    def _write(self, role: str, text: str) -> None:
        self.sha.update((b"\n" if self.written else b"") + role.encode() + b":" + text.encode())
        self.written += 1

    def apply(self, audit: str) -> None:
        for edit in audit:
            role, text = ("", "") if edit == INSERT else self.rows.popleft()
            if edit == DELETE:
                continue
            if edit == KEEP:
                self.system += self.written == 0 and role[:1] == "s"
                self._write(role, text)
            else:  # roles take turns behind the system row
                self._write("assistant" if (self.written - self.system) % 2 else "user", text)


class Conversation:
    """Rows of one conversation in order; ``result`` after the last."""

    LAG = 64

    def __init__(self):
        self.short: list[tuple[str, str]] | None = []
        self.chart, self.edited, self.audit = Chart(), Edited(), []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.first = self.last = self.before = None
        self.turns = self.seen = 0

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += self.last is None or turn != self.last
            self.last = turn
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        self.counts["illegal"] += self.seen > 0 and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.seen += 1
        self.edited.rows.append((role, text))
        if self.short is not None:
            self.short.append((initial if initial in ("s", "u", "a") else "", fault))
            if len(self.short) > self.LAG:
                for row in self.short:
                    self.chart.scan(*row)
                self.short = None
        else:
            self.chart.scan(initial, fault)
        if self.short is None and self.seen % self.LAG == 0:
            self._hand_out(self.chart.decided())

    def _hand_out(self, audit: str) -> None:
        self.audit.append(audit)
        self.edited.apply(audit)

    def result(self) -> tuple:
        cost, audit = self.chart.result() if self.short is None else repair(tuple(self.short))
        self._hand_out(audit)
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (gaps, *self.counts.values(), cost, "".join(self.audit), self.edited.sha.hexdigest())


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds ``fault`` to conv_id, turn, role, text, absent: ``absent``, or the first of blank, duplicate and truncated that holds, else empty.

    A row is a duplicate if its conversation has the same role and text before it.
    """
    rows = rows.withColumn("text", F.when(~F.col("absent"), F.col("text")))  # absent rows have no text that others could repeat
    last = F.expr(f"right(rtrim('{_SPACES}', text), 1)")
    alike = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    fault = F.when(F.col("absent"), "absent").when(last == "", "blank").when(F.row_number().over(alike) > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    return rows.withColumn("fault", fault)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """conv_id and ``RESULT``: faults, and the cheapest repair, of every conversation of ``rows`` (conv_id, turn, role, text).

    Rows go by turn, null turns first, rows of one turn by role and text; null roles and texts count as one space.  A
    row whose column ``absent``, if there is one, is true only says that its conversation exists; one without other rows
    gets zeros, an empty audit and the digest of an empty string, as does one whose rows are all deleted.  Null conv_ids
    make one conversation.  Further columns are ignored; an empty table gives an empty result.

    All rows of a conversation go to one task, since the digest and the audit follow its order, and stream through it
    sorted: the task holds only rows whose edit is still open.
    """
    absent = F.col("absent") if "absent" in rows.columns else F.lit(False)
    some = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    x = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *some, F.coalesce(absent, F.lit(False)).alias("absent"))
    # one shuffle: what is dealt by conversation is dealt for the windows of a conversation's rows, too
    ordered = with_faults(x.repartition("conv_id")).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == "duplicate")
    key = ordered.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key_now, out = None, None, []

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        names = ["conv_id", *[c.split()[0] for c in RESULT.split(", ")]]
        types = [None, *[pa.string() if c.endswith("string") else pa.int64() for c in RESULT.split(", ")]]
        for batch in batches:
            types[0] = batch.column(0).type
            for conv_id, turn, role, text, fault in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                if now is None or conv_id != key_now:
                    if now is not None:
                        out.append((key_now, *now.result()))
                    now, key_now = Conversation(), conv_id
                if fault != "absent":
                    now.add(turn, role, text, fault)
            if len(out) > 4096:
                yield made(out)
                out = []
        if now is not None:
            out.append((key_now, *now.result()))
            yield made(out)

    return ordered.select("conv_id", "turn", "role", "text", "fault").mapInArrow(run, f"conv_id {key}, {RESULT}")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, absent: the table with planted faults, each row's by the checksum of its conversation and turn.

    By crc32 of ``conv_id:turn`` modulo 20 a row is 0 dropped (it stays as an absent one), 1 emptied, 2 rid of its end
    marks, 3 there twice, 4 said by the user.  Nulls count as one space, in the checksum, too.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    x = rows.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(F.concat_ws(":", *named).cast("binary")) % 20).alias("_k"))
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_k") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("_k") == 3, 2).otherwise(1)))
    return x.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_k") == 0).alias("absent"), copies.alias("_c")).drop("_c")
