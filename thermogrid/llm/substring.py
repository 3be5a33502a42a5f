"""Removal of long repeated passages by prefix-partitioned suffix trees.

Each window of ``SIZE`` words belongs to one suffix, the one that starts at the window's smallest hashed
prefix of a given length; a passage that repeats has the same suffixes at the same places in both
copies, so only these sparse suffixes are kept.  They are partitioned by prefix:

* a prefix that occurs in one document only has no repeated window and goes no further;
* a prefix of at most ``GROUP`` suffixes, counted with their repeats inside a document, makes a group that fits in
  memory.  Its subtree is built (``subtrees``): sorted suffixes with the lengths of their common prefixes, and the
  internal nodes of ``SIZE`` words and more, whose leaves share a repeat.  Each such node keeps its smallest document;
* a prefix with more suffixes is lengthened (``PREFIXES``), and its windows are dealt anew by their smallest hashed
  prefix of the new length.  What is still too large at the last length goes by whole runs of such windows: equal
  runs are reduced to their smallest document before the shuffle, however many there are, and only the runs of those
  documents are compared window by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .store import Workspace, fresh, row_key
from .subtrees import deep_nodes

SIZE = 50
PREFIXES = (16, 32)
GROUP = 1000
_LAST = (1 << 63) - 1
_PLACE = np.uint64((1 << 26) - 1)


def anchors(h: np.ndarray, size: int = SIZE, prefix: int = PREFIXES[0]) -> tuple[np.ndarray, np.ndarray]:
    """(key, place) of the smallest hashed prefix in each window of one text."""
    keys, span = W.windows(h, prefix), size - prefix + 1
    if len(h) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    best, width = (W.mix(keys) & ~_PLACE) | (np.arange(len(keys), dtype=np.uint64) & _PLACE), 1
    while width * 2 <= span:
        best = np.minimum(best[: len(best) - width], best[width:])
        width *= 2
    best = np.minimum(best[: len(keys) - span + 1], best[span - width :][: len(keys) - span + 1])
    first = np.arange(len(best))
    place = (first & ~int(_PLACE)) + (best & _PLACE).astype(np.int64)
    place = np.where(place < first, place + int(_PLACE) + 1, place)
    return W.mix(keys[place] + np.uint64(prefix)), place


def runs(key: np.ndarray, place: np.ndarray, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, number of windows) of each run of windows that share a suffix, among the windows marked."""
    at = np.arange(len(key)) if among is None else np.flatnonzero(among)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (place[at[1:]] != place[at[:-1]]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    return key[at[begin]], at[begin], np.diff(np.append(begin, len(at)))


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _long(column: pa.Array, i: int) -> np.ndarray:
    return np.asarray(column[i].values, np.int64).view(np.uint64)


def _hot(own: np.ndarray, batch: pa.RecordBatch, i: int, size: int, prefixes: tuple) -> np.ndarray:
    """Windows of a text whose prefixes of all lengths so far (columns long0, long1, ...) have too many suffixes."""
    out = np.ones(max(0, len(own) - size + 1), bool)
    for level, prefix in enumerate(prefixes):
        out &= np.isin(anchors(own, size, prefix)[0], _long(batch.column(batch.schema.get_field_index(f"long{level}")), i))
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, W.Words, int, np.ndarray]]:
    """(batch, row, words of some rows, first word of this row, hashes of its words) for each row with rid and text."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        for a, b in W.slices(text):
            words = W.split(text[a:b])
            h = words.hashes()
            for i in range(b - a):
                yield batch, a + i, words, int(words.first[i]), h[words.first[i] : words.first[i + 1]]


def repeated_spans(docs: DataFrame, work: Workspace, size: int = SIZE, prefixes: tuple = PREFIXES, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(all, hit): doc_id, text_sha, n_words, kept_sha256 of every text, and of those with repeats text and spans.

    A span is the first and the number of windows that also start in a document with a smaller doc_id.
    """
    keyed = docs.select(*row_key(), "text")
    prefixes = tuple(p for p in prefixes if p < size) or (max(1, size // 3),)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in W.slices(batch.column(2)):
                column = batch.column(2)[a:b]
                words = W.split(column)
                h, keys, times, n = words.hashes(), [], [], words.counts
                for i in range(b - a):
                    k, c = np.unique(runs(*anchors(h[words.first[i] : words.first[i + 1]], size, prefixes[0]))[0], return_counts=True)
                    keys.append(k.view(np.int64))
                    times.append(c)
                shas = [digest((t or "").encode().split()) for t in column.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(n.astype(np.int64)), pa.array(shas), pa.array(keys, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))],
                    names=["doc_id", "text_sha", "n_words", "kept_sha256", "keys", "times"],
                )

    scanned = work.keep(keyed.mapInArrow(scan, "doc_id long, text_sha string, n_words long, kept_sha256 string, keys array<long>, times array<long>"), "scanned")
    place = F.coalesce("doc_id", F.lit(_LAST))

    def sorted_out(each: DataFrame, by: list[str], level: int) -> DataFrame:
        """The keys of each text that other documents have too: in groups that fit in memory, and in larger ones."""
        shared = each.groupBy("key").agg(F.min("place").alias("lo"), F.max("place").alias("hi"), F.sum("times").alias("n")).filter("lo < hi")
        shared = work.keep(shared.select("key", (F.col("n") > group).alias("large")), f"shared-{level}")
        lists = [F.collect_set(F.when(F.col("large") == large, F.col("key"))).alias(name) for large, name in ((False, "short"), (True, f"long{level}"))]
        return each.join(shared, "key").groupBy(*by).agg(*lists)

    each = scanned.select("doc_id", "text_sha", place.alias("place"), F.explode(F.arrays_zip("keys", "times")).alias("x")).select("doc_id", "text_sha", "place", "x.keys", "x.times")
    hits = sorted_out(each.withColumnRenamed("keys", "key"), ["doc_id", "text_sha"], 0).withColumnsRenamed({"doc_id": "h_id", "text_sha": "h_sha"})
    on = keyed.doc_id.eqNullSafe(F.col("h_id")) & (keyed.text_sha == F.col("h_sha"))
    found = keyed.join(hits, on).select(F.monotonically_increasing_id().alias("rid"), place.alias("place"), "doc_id", "text_sha", "text", "short", "long0")
    found = work.keep(found, "found")

    def lengthened(level: int):
        """Keys of the next length, with their numbers, of the windows in too large groups."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, i, _, _, own in _texts(batches):
                k, c = np.unique(runs(*anchors(own, size, prefixes[level]), _hot(own, batch, i, size, prefixes[:level]))[0], return_counts=True)
                rid, at = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), rid)), pa.array(np.full(len(k), at)), pa.array(k.view(np.int64)), pa.array(c)], names=["rid", "place", "key", "times"])

        return run

    def pieces(level: int):
        """The suffixes in groups that fit in memory, each with the words that its windows cover."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, i, words, lo, own in _texts(batches):
                want = _long(batch.column(batch.schema.get_field_index("short")), i)
                if not len(want):
                    continue
                key, first, count = runs(*anchors(own, size, prefixes[level]), _hot(own, batch, i, size, prefixes[:level]) if level else None)
                at = np.flatnonzero(np.isin(key, want))
                texts = [words.data[words.starts[lo + first[j]] : words.ends[lo + first[j] + count[j] + size - 2]].tobytes().decode() for j in at]
                ident = [pa.array(np.full(len(at), batch.column(k)[i].as_py())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ident, pa.array(key[at].view(np.int64)), pa.array(first[at]), pa.array(texts, pa.string())], names=["rid", "place", "key", "start", "words"])

        return run

    def hot_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of windows that are in too large groups at every length, each with two hashes of all its words."""
        for batch, i, _, _, own in _texts(batches):
            hot = _hot(own, batch, i, size, prefixes)
            _, first, count = runs(np.zeros(len(hot), np.uint64), np.zeros(len(hot), np.int64), hot)
            at = np.flatnonzero(hot)
            inside = (np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64) * W.GOLDEN
            names = []
            for h in (own, W.mix(own ^ W.GOLDEN)) if len(at) else ():
                names.append(np.add.reduceat(W.mix(W.windows(h, size)[at] + inside), np.cumsum(count) - count).view(np.int64))
            if len(at):
                ident = [pa.array(np.full(len(first), batch.column(k)[i].as_py())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ident, pa.array(first), pa.array(count), *map(pa.array, names)], names=["rid", "place", "start", "windows", "one", "two"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Two hashes of each window of the runs listed (column runs)."""
        for batch, i, _, _, own in _texts(batches):
            listed = batch.column(batch.schema.get_field_index("runs"))[i].values
            start, count = (np.asarray(listed.field(k), np.int64) for k in ("start", "windows"))
            at = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            one, two = (W.windows(x, size)[at].view(np.int64) for x in (own, W.mix(own ^ W.GOLDEN)))
            ident = [pa.array(np.full(len(at), batch.column(k)[i].as_py())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*ident, pa.array(one), pa.array(two), pa.array(at)], names=["rid", "place", "one", "two", "start"])

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The groups in a sorted partition, several at a time."""
        kept: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            kept.append(batch)
            held += batch.nbytes
            if held > 8 << 20:
                table = pa.Table.from_batches(kept)
                key = np.asarray(table.column("key"))
                cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
                if cut:
                    yield from solved(table.slice(0, cut))
                    kept = table.slice(cut).combine_chunks().to_batches()
                    held = sum(x.nbytes for x in kept)
        if kept:
            yield from solved(pa.Table.from_batches(kept))

    def solved(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        words = W.split(table.column("words").combine_chunks())
        key = np.asarray(table.column("key")).view(np.uint64)
        row = words.owner()
        room = words.first[1:][row] - np.arange(len(row))
        nodes = deep_nodes(W.mix(words.hashes() ^ W.mix(key)[row]), room, size)  # words count only within their group
        if not len(nodes.begin):
            return
        doc = np.asarray(table.column("place"))[row[nodes.leaves]]
        hit = doc > np.repeat(np.minimum.reduceat(doc, nodes.begin), nodes.each())
        if not hit.any():
            return
        at = np.sort(nodes.leaves[hit])
        o = row[at]
        s = at - words.first[o] + np.asarray(table.column("start"))[o]
        new = np.ones(len(o), bool)
        new[1:] = (o[1:] != o[:-1]) | (s[1:] != s[:-1] + 1)
        begin = np.flatnonzero(new)
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(table.column("rid"))[o[begin]]), pa.array(s[begin]), pa.array(np.diff(np.append(begin, len(o))))], names=["rid", "start", "windows"])

    piece, level, now, small = "rid long, place long, key long, start long, words string", 0, found, None
    while True:
        more = now.filter(F.size("short") > 0).select("rid", "place", "text", "short", *[f"long{k}" for k in range(level)]).mapInArrow(pieces(level), piece)
        small = more if small is None else small.unionByName(more)
        hot = now.filter(F.size(f"long{level}") > 0).drop("short")
        level += 1
        if not hot.limit(1).count() or level == len(prefixes):
            break
        lists = [f"long{k}" for k in range(level)]
        each = work.keep(hot.select("rid", "place", "text", *lists).mapInArrow(lengthened(level), "rid long, place long, key long, times long"), f"keys-{level}")
        now = work.keep(hot.join(sorted_out(each, ["rid"], level), "rid"), f"found-{level}")
    small = small.repartition("key").sortWithinPartitions("key").mapInArrow(trees, "rid long, start long, windows long")
    spans = work.keep(small, "spans-trees")
    if level == len(prefixes):
        lists = [f"long{k}" for k in range(level)]
        named = work.keep(hot.select("rid", "place", "text", *lists).mapInArrow(hot_runs, "rid long, place long, start long, windows long, one long, two long"), "runs")
        firsts = named.groupBy("one", "two", "windows").agg(F.min("place").alias("first"))
        named = work.keep(named.join(firsts, ["one", "two", "windows"]).select("rid", "place", "start", "windows", (F.col("place") > F.col("first")).alias("later")), "runs-named")
        spans = spans.unionByName(named.filter("later").select("rid", "start", "windows"))  # all of the run is in an earlier document
        ahead = named.filter("NOT later").groupBy("rid").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
        big = work.keep(hot.select("rid", "place", "text").join(ahead, "rid").mapInArrow(windows, "rid long, place long, one long, two long, start long"), "windows")
        least = big.groupBy("one", "two").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).filter("lo < hi")
        least = work.keep(least.select("one", "two", "lo"), "least")
        later = big.join(least, ["one", "two"]).filter("place > lo").select("rid", "start").distinct()
        island = F.col("start") - F.row_number().over(Window.partitionBy("rid").orderBy("start"))  # the same along a run of starts
        later = later.withColumn("_i", island).groupBy("rid", "_i").agg(F.min("start").alias("start"), F.count("*").alias("windows")).drop("_i")
        spans = spans.unionByName(later)
    by_text = spans.groupBy("rid").agg(F.collect_set(F.struct("start", "windows")).alias("spans"))
    hit = found.select("rid", "doc_id", "text_sha", "text").join(by_text, "rid").select("doc_id", "text_sha", "text", "spans")
    return scanned.select("doc_id", "text_sha", "n_words", "kept_sha256"), hit


def without_repeats(docs: DataFrame, size: int = SIZE, prefixes: tuple = PREFIXES, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(all texts, texts that lose words): the second has doc_id, text_sha, kept_text, n_removed, kept_sha256."""
    work = Workspace(docs.sparkSession, "substring")
    every, hit = repeated_spans(docs, work, size, prefixes, group)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                doc_id, sha, text, spans = (batch.column(k)[i].as_py() for k in range(4))
                words = text.encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    edge[s["start"]] += 1
                    edge[min(s["start"] + s["windows"] + size - 1, len(words))] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = b" ".join(left)
                out.append((doc_id, sha, kept.decode(), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            if out:
                cols = list(zip(*out, strict=True))
                types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "text_sha", "kept_text", "n_removed", "kept_sha256"])

    lost = hit.mapInArrow(cut, "doc_id long, text_sha string, kept_text string, n_removed long, kept_sha256 string")
    return every, work.keep(lost.dropDuplicates(["doc_id", "text_sha"]), "lost")


def substring_report(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``docs``.

    Words are runs of anything but space and the bytes 9 to 13.  A word goes if a window of ``size`` words that
    covers it also starts in a document with a smaller doc_id, judged on the input.  Null and empty texts
    have no words; null ids count as larger than any other; repeated rows get the same result.
    """
    every, lost = without_repeats(docs, size)
    lost = lost.select(F.col("doc_id").alias("l_id"), F.col("text_sha").alias("l_sha"), "n_removed", F.col("kept_sha256").alias("l_kept"))
    out = every.join(lost, every.doc_id.eqNullSafe(F.col("l_id")) & (every.text_sha == F.col("l_sha")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("l_kept", "kept_sha256").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, size: int = SIZE, changed: str | None = None) -> DataFrame:
    """``docs`` with the remaining words, one space between them, as text where words go; other texts stay as they are.

    All columns are kept; ``changed`` names a further one that tells whether words went.  Null and empty texts have
    no words, null ids count as larger than any other, repeated rows fare alike, an empty table stays empty.
    """
    _, lost = without_repeats(docs, size)
    sha, l_id, l_sha, l_text = fresh(docs.columns, "text_sha", "lost_id", "lost_sha", "lost_text")
    lost = lost.select(F.col("doc_id").alias(l_id), F.col("text_sha").alias(l_sha), F.col("kept_text").alias(l_text))
    keyed = docs.withColumn(sha, F.sha2(F.coalesce("text", F.lit("")), 256))
    out = keyed.join(lost, F.col("doc_id").eqNullSafe(F.col(l_id)) & (F.col(sha) == F.col(l_sha)), "left")
    more = [F.col(l_text).isNotNull().alias(changed)] if changed else []
    return out.select(*[F.coalesce(l_text, "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], *more)
