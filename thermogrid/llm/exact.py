"""Exact duplicates by deterministic block naming.

A normalised text is cut into blocks of a fixed size.  Sorting the blocks gives equal blocks one
integer name.  Adjacent names are paired and the pairs named in the same way, until each text has
one name: two texts share it exactly when they are equal, as no step can collide.

Names are a hash bucket and the dense rank of the key among the sorted keys of that bucket, so no
step sorts everything in one place.  A key that more than 1/``HEAVY`` of the rows carry (at most
``HEAVY`` such keys can exist) is named from a broadcast list and its rows are dealt at random.
Everything here is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Workspace

BLOCK = 4096
HEAVY = 256
_BUCKETS = 1 << 22
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Null as empty, A-Z in lower case, everything else unchanged."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def named(rows: DataFrame, keys: list[str], total: int, work: Workspace, tag: str) -> DataFrame:
    """``rows`` (with a column ``rid``) plus ``name``, an integer for each distinct ``keys``; null keys are values.

    Keys of more than ``total / HEAVY`` rows are named apart; they only spare one task, names are exact anyway.
    """
    print_of = F.xxhash64(*keys)
    counts = rows.groupBy(print_of.alias("print")).agg(F.count("*").alias("n"))
    counts = counts.filter(F.col("n") > max(64, total // HEAVY)).orderBy(F.desc("n"), "print").limit(HEAVY)
    heavy = [r["print"] for r in counts.collect()]
    bucket = F.pmod(print_of, F.lit(_BUCKETS))
    if heavy:
        listed = rows.filter(print_of.isin(heavy)).select(*keys).distinct()
        listed = work.keep(listed.orderBy(*keys).withColumn("given", -1 - F.monotonically_increasing_id()), f"{tag}-heavy")
        if listed.count() <= 2 * HEAVY:
            listed = F.broadcast(listed.select(*[F.col(k).alias(f"_{k}") for k in keys], "given"))
        else:  # many keys behind one fingerprint: not a small table
            listed = listed.select(*[F.col(k).alias(f"_{k}") for k in keys], "given")
        rows = rows.join(listed, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys])
        found = F.col("given").isNotNull()
        bucket = F.when(found, _BUCKETS + F.pmod(F.xxhash64("rid"), F.lit(_BUCKETS))).otherwise(bucket)
        rows = rows.withColumn("bucket", bucket)
        for k in keys:  # what is named already need not travel
            rows = rows.withColumn(k, F.when(found, F.lit(None)).otherwise(F.col(k)))
    else:
        rows = rows.withColumn("bucket", bucket).withColumn("given", F.lit(None).cast("long"))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy(*keys))
    name = F.coalesce(F.col("given"), F.shiftleft(F.col("bucket").cast("long"), 32) + rank)
    return rows.withColumn("name", name).drop("bucket", "given")


def identities(docs: DataFrame, work: Workspace, block: int = BLOCK) -> DataFrame:
    """rid, doc_id, sha, level, name: texts are equal when level and name are."""
    text = normalised(F.col("text")).cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", text.alias("norm"))
    rows = rows.withColumn("n", F.greatest(F.lit(1), F.ceil(F.octet_length("norm") / F.lit(block)).cast("int")))
    rows = rows.select("rid", "doc_id", "n", "norm", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    piece = F.substring(F.col("norm"), F.col("pos") * block + 1, F.lit(block))  # of bytes: no walk over characters
    sha = F.when(F.col("pos") == 0, F.sha2("norm", 256))
    rows = rows.select("rid", "doc_id", sha.alias("sha"), "n", "pos", piece.alias("block"))
    now = work.keep(named(rows, ["block"], docs.count(), work, "block").drop("block"), "names-0")
    done, level = [now.filter("n = 1").select("rid", "doc_id", "sha", F.lit(0).alias("level"), "name")], 0
    now = now.filter("n > 1")
    longest = now.agg(F.max("n")).first()[0] or 1
    while longest > 1:
        level += 1
        pairs = now.groupBy("rid", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.first("doc_id").alias("doc_id"),
            F.max("sha").alias("sha"),
            F.first("n").alias("n"),
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("right"),
        )
        pairs = work.keep(pairs.withColumn("n", F.ceil(F.col("n") / 2).cast("int")), f"pairs-{level}")
        now = work.keep(named(pairs, ["left", "right"], pairs.count(), work, f"pair-{level}").drop("left", "right"), f"names-{level}")
        work.drop(f"pairs-{level}")
        done.append(now.filter("n = 1").select("rid", "doc_id", "sha", F.lit(level).alias("level"), "name"))
        now = now.filter("n > 1")
        longest = -(-longest // 2)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def exact_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Texts are equal when identical after A-Z are lower-cased; null counts as empty.  The row with the
    largest doc_id of a group stays (of rows that repeat that id, every one counts as kept: they are
    the same row).  A null doc_id never wins over another id; a group of null ids alone has keep_id
    null and keeps its rows.  Extra columns are ignored, an empty table gives an empty result.
    """
    work = Workspace(docs.sparkSession, "exact")
    ids = identities(docs.select("doc_id", "text"), work, block)
    groups = ids.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = work.keep(groups.filter("group_size > 1"), "groups")
    out = ids.join(groups, ["level", "name"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
