"""How the filters of a corpus interact: what each removes in every order, and its Shapley value.

Each document has a mask with a bit for every filter that it fails.  For a part of the corpus, the numbers of documents
by mask are all that is needed: they give the removal polynomial, the multilinear function

    f(x) = sum over masks m of n(m) * (1 - product over the filters i in m of (1 - x_i))

whose value at a corner of the cube is the number of documents that this set of filters removes.  So differences of
corner values tell what a filter removes at its place in an order, and what is left after it.  A filter's Shapley value is
the integral of the partial derivative along the cube's diagonal; of a monomial with k filters it is the coefficient over
k, taken as an exact fraction.  Times the number of orders it is a whole number: what the filter removes, summed
over all orders.

Only counts are gathered, at most 2 to the number of filters for each part, and every shuffle is of narrow rows by keys of
which no single one can be heavy after the pre-aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Workspace

SPACES = r"[\x20\x09-\x0D]+"
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
_PARTS_AT_ONCE = 64


def removal_polynomial(counts: list[int]) -> list[int]:
    """The coefficient of each monomial, numbered by its set of filters, from the numbers of documents by mask."""
    above = list(counts)  # documents whose mask holds the set
    for bit in range(len(counts).bit_length() - 1):
        for s in range(len(counts)):
            if not s >> bit & 1:
                above[s] += above[s | 1 << bit]
    return [0] + [above[s] if s.bit_count() % 2 else -above[s] for s in range(1, len(counts))]


def at_corners(coefficients: list[int]) -> list[int]:
    """The polynomial at every corner of the cube, numbered by the filters that are 1."""
    out = list(coefficients)
    for bit in range(len(out).bit_length() - 1):
        for s in range(len(out)):
            if s >> bit & 1:
                out[s] += out[s ^ 1 << bit]
    return out


def shapley(coefficients: list[int], filter_no: int) -> Fraction:
    """The integral over t from 0 to 1 of the partial derivative at (t, ..., t): a monomial of k filters leaves t to the k - 1."""
    return sum((Fraction(c, s.bit_count()) for s, c in enumerate(coefficients) if s >> filter_no & 1), Fraction(0))


def _steps(letters: str) -> list[tuple[str, int, int, int, int]]:
    """(order, step, filter, filters before, filters up to it) of all orders."""
    out = []
    for order in permutations(range(len(letters))):
        before = 0
        for step, i in enumerate(order, 1):
            out.append(("".join(letters[k] for k in order), step, i, before, before | 1 << i))
            before |= 1 << i
    return out


def _report(letters: str):
    steps, full, orders = _steps(letters), (1 << len(letters)) - 1, factorial(len(letters))

    def part_rows(counts: list[list[int]]) -> list[tuple]:
        polynomials = [removal_polynomial(c) for c in counts]
        all_, good, toxic = (at_corners(p) for p in polynomials)
        total = sum(counts[0])
        share = [int(orders * shapley(polynomials[0], i)) for i in range(len(letters))]
        out = []
        for _, _, i, before, after in steps:
            removed = all_[after] - all_[before]
            out.append((total - all_[after], removed, all_[1 << i] - removed, all_[full] - all_[full ^ 1 << i], good[after] - good[before], toxic[after] - toxic[before], share[i]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for a in range(0, batch.num_rows, _PARTS_AT_ONCE):
                parts, rows = [], []
                for r in batch.slice(a, _PARTS_AT_ONCE).to_pylist():
                    counts = [[0] * (full + 1) for _ in range(3)]
                    for m in r["masks"]:
                        for c, k in zip(counts, ("n", "good", "toxic"), strict=True):
                            c[m["mask"]] = m[k]
                    parts += [r["part"]] * len(steps)
                    rows += part_rows(counts)
                told = len(parts) // len(steps)
                columns = [pa.array(parts, pa.string()), pa.array([s[0] for s in steps] * told, pa.string()), pa.array([s[1] for s in steps] * told, pa.int32())]
                columns += [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def order_audit(counts: DataFrame, letters: str) -> DataFrame:
    """The rows of ``SCHEMA`` for every part, all orders of the filters and every step, from (part, mask, n, good, toxic), one row for each part and mask."""
    masks = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # at most 2 ** filters each
    return masks.mapInArrow(_report(letters), SCHEMA)


def failed(conditions: dict[str, Column]) -> Column:
    """The mask of failed filters; a condition that is null is not failed."""
    return sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(conditions.values())), F.lit(0))


def text_conditions(text: Column, words: Column) -> dict[str, Column]:
    """A: under 200 words; B: fewer than half of them distinct; C: more than 2 of 100 code points in A-Z; D: holds a sign of code or markup."""
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def document_masks(docs: DataFrame, work: Workspace) -> DataFrame:
    """doc_id, part, mask, n of the rows of ``docs``: filters A to D by the text itself, E for a text that a smaller doc_id has too.

    A text's first row is that with the smallest doc_id; the others are told from it by joining on the text's digest and
    the id, so that a text in a third of all rows does not meet in one place.  Rows alike in all respects are counted first.
    """
    x = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    x = x.withColumn("w", F.filter(F.split("t", SPACES), lambda w: w != ""))
    x = x.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("sha"), failed(text_conditions(F.col("t"), F.col("w"))).alias("mask"))
    x = work.keep(x.groupBy("doc_id", "part", "sha", "mask").agg(F.count("*").alias("n")), "texts")
    first = x.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    x = x.join(first, ["sha", "doc_id"], "left")  # a null id is neither smaller nor larger than another
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return x.select("doc_id", "part", (F.col("mask") + F.when(copy, F.lit(16)).otherwise(F.lit(0))).alias("mask"), "n")


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What the filters A to E (``text_conditions``; E: copy of a smaller doc_id's text) do in each of their 120 orders, by source.

    Null texts and sources count as empty; words are parted by ASCII white space; a null doc_id is no copy and has none.
    Repeated rows count each, and none of them is a copy of the other.  A document is good or toxic if any of its
    labels says 1; without labels it is neither.  Columns other than doc_id, text and source are ignored; an empty table
    gives an empty result.  Very long texts are read whole.
    """
    work = Workspace(docs.sparkSession, "audit")
    said = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c) for c in ("quality", "toxic")])
    x = document_masks(docs, work)
    # null ids have no labels: they are dealt by part and mask instead of meeting at one key
    apart = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("part", "mask", "n"), F.lit(1 << 20)))
    x = x.withColumn("_apart", F.coalesce(apart, F.lit(0))).join(said.withColumn("_apart", F.lit(0).cast("long")), ["doc_id", "_apart"], "left")
    counts = x.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))])
    return order_audit(counts, "ABCDE")
