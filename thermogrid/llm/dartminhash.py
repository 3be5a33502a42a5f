"""Near duplicates by DartMinHash signatures and banded joining.

A text is the weighted set of its runs of five words, the weight being the number of occurrences.  Darts
are thrown by hashing: every unit of weight of an element gets a Poisson stream of darts with increasing
ranks, the same in every text that holds it.  A text keeps the darts that fall into its region, up to a rank
at which k ln k + 2k of them are expected, and of those the earliest for each of the k coordinates.  Two texts
agree in a coordinate with the probability of their weighted Jaccard similarity.  Only darts below the limit are
made, so a signature takes time in proportion to the length of the text plus k ln k.

Bands of coordinates that agree make candidates.  Within a band's bucket every text is first compared with the
bucket's centre, the text with the most company over all its bands, so a group of copies makes as many pairs
as it has members.  Pairs are verified by their exact similarity, and classes are the connected components.
Buckets that still hold several classes are then searched whole: texts outside the bucket's largest class
meet all its other members, in blocks of bounded size, by the bytes of a second, longer signature that only the texts
of such buckets get.  All pairs of different classes that may reach the similarity are verified inside the block, by
the hashed shingles that travel with its texts, and classes merge there; only links that merge two classes become
rows, so a block returns fewer rows than it has texts however many pairs it looks at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import Workspace, row_key

BANDS, ROWS = 24, 5
SIMILARITY = 0.8
#: Coordinates of the signature that texts of buckets with several classes are compared by, and those of a first look.
FINE, GLANCE = 1024, 128
#: Signature coordinates of a verified pair that agree, as deviations below their expected number.
DEVIATIONS = 4.1
#: Texts outside the largest class, and members they meet, in one block of a bucket; shingles of either side.
OUTER, INNER, LOAD = 512, 1024, 1 << 21
_RANK, _COORDINATE, _WEIGHT = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_minhash(elements: np.ndarray, owner: np.ndarray, n_sets: int, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Signatures (n_sets, k) of weighted sets given as unit strips.

    ``elements`` are hashes of unit strips of weight; an element of weight 2.3 has three strips with
    ``weight`` 1, 1 and 0.3, and keeps of the darts of the last strip those that land in its first 0.3.
    A set without elements has a signature of zeros.
    """
    out = np.zeros((n_sets, k), np.uint64)
    total = np.bincount(owner, weights=weight, minlength=n_sets)
    darts = k * np.log(k) + 2 * k
    todo = np.flatnonzero(total > 0)
    while len(todo):
        active = np.isin(owner, todo) if len(todo) < n_sets else np.ones(len(owner), bool)
        h, o = elements[active], owner[active]
        limit = np.full(n_sets, np.inf)
        limit[todo] = darts / total[todo]
        w = weight[active] if weight is not None else None
        rank, turn = np.zeros(len(h)), 0
        keys, ranks, names = [], [], []
        while len(h):
            turn += 1
            x = W.mix(h + np.uint64(turn * int(W.GOLDEN) % 2**64))
            rank = rank - np.log(_uniform(W.mix(x ^ _RANK)))
            stay = rank <= limit[o]
            h, o, rank, x = h[stay], o[stay], rank[stay], x[stay]
            hit = np.ones(len(x), bool)
            if w is not None:
                w = w[stay]
                hit = _uniform(W.mix(x ^ _WEIGHT)) < w
            coordinate = (W.mix(x ^ _COORDINATE) % np.uint64(k)).astype(np.int64)
            keys.append((o * k + coordinate)[hit])
            ranks.append(rank[hit])
            names.append(x[hit])
        key, rank, name = map(np.concatenate, (keys, ranks, names))
        order = np.argsort(-rank, kind="stable")  # the earliest is written last
        flat = out.reshape(-1)
        filled = np.zeros(n_sets * k, bool)
        flat[key[order]] = name[order]
        filled[key] = True
        todo = todo[~filled.reshape(n_sets, k)[todo].all(1)]
        darts *= 2  # those with an empty coordinate get darts of higher ranks too
    return out


def band_keys(column: pa.Array, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the bands, number of shingles) of each text; texts without words have no meaning here."""
    n = len(column)
    strip, owner = W.strips(*W.shingles(W.split(column)))
    sign = dart_minhash(strip, owner, n, bands * rows).reshape(n, bands, rows)
    keys = np.zeros((n, bands), np.uint64) + np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        keys = W.mix(keys + W.GOLDEN) ^ sign[:, :, r]
    return W.mix(keys).view(np.int64), np.bincount(owner, minlength=n)


def sketches(column: pa.Array, coordinates: int = FINE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of shingles, a byte per coordinate of a longer signature, hashes of the shingles text by text) of each text."""
    n = len(column)
    strip, owner = W.strips(*W.shingles(W.split(column)))
    sign = dart_minhash(strip, owner, n, coordinates)
    return np.bincount(owner, minlength=n), (sign >> np.uint64(40)).astype(np.uint8), strip[np.argsort(owner, kind="stable")]


def similarities(a: pa.Array, b: pa.Array) -> np.ndarray:
    """The exact weighted Jaccard similarity of each pair of texts."""
    n, sets = len(a), []
    for column in (a, b):
        strip, owner = W.strips(*W.shingles(W.split(column)))
        sets.append((W.mix(strip ^ W.mix(owner.astype(np.uint64) + W.GOLDEN)), owner))
    both = np.concatenate([sets[0][0], sets[1][0]])
    owner = np.concatenate([sets[0][1], sets[1][1]])
    order = np.argsort(both, kind="stable")
    s = both[order]
    shared = np.bincount(owner[order[1:]][s[1:] == s[:-1]], minlength=n)
    union = np.bincount(owner, minlength=n) - shared
    return shared / np.maximum(union, 1)


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """node, root: the smallest node of each node's component, for the nodes of ``edges`` (a, b)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = work.keep(both.distinct(), "links")
    now = work.keep(links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "roots-0")
    turn = 0
    while True:
        turn += 1
        near = links.join(now.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = now.join(near, now.node == near.a).select("node", F.least("root", "near").alias("next"), "root")
        jump = now.select(F.col("node").alias("next"), F.col("root").alias("far"))
        step = step.join(jump, "next", "left").select("node", F.coalesce(F.least("next", "far"), "next").alias("root"), (F.coalesce(F.least("next", "far"), "next") < F.col("root")).alias("moved"))
        now = work.keep(step, f"roots-{turn}")
        moved = now.filter("moved").limit(1).count()
        now = now.select("node", "root")
        if turn > 1:
            work.drop(f"roots-{turn - 1}")
        if not moved:
            return now


def _across(similarity: float, most: int | None):
    """A function for mapInArrow over rows sorted by block: what ``_compare`` finds in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]).combine_chunks() if rest is not None else rows
            whole, *columns = _compare(rows, similarity, most, False)
            rest = rows.slice(whole)
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "cut"])
        if rest is not None:
            yield pa.RecordBatch.from_arrays([*_compare(rest, similarity, most, True)[1:]], names=["a", "b", "cut"])

    return run


class _Block:
    """The hashed shingles of a block's texts (rows ``a`` on), for the exact similarity of one of them to many."""

    def __init__(self, shingles: list[bytes], n: np.ndarray, a: int):
        known, self.ids = np.unique(np.frombuffer(b"".join(shingles), np.uint64), return_inverse=True)
        self.mark, self.n, self.a = np.zeros(len(known), bool), n, a
        self.first = np.cumsum(n) - n

    def similar(self, x: int, y: np.ndarray) -> np.ndarray:
        x, y = x - self.a, y - self.a
        own, size = self.ids[self.first[x] : self.first[x] + self.n[x]], self.n[y]
        at = np.cumsum(size) - size
        others = self.ids[np.arange(int(size.sum())) + np.repeat(self.first[y] - at, size)]
        self.mark[own] = True
        shared = np.add.reduceat(self.mark[others], at, dtype=np.int64)
        self.mark[own] = False
        return shared / (self.n[x] + size - shared)


def _compare(rows: pa.Table, similarity: float, most: int | None, last: bool) -> tuple[int, pa.Array, pa.Array, pa.Array]:
    """(rows of blocks known to be whole, smaller ids, larger ids, whether more were left out) of the pairs in those blocks.

    Without ``most`` they are pairs of classes: for every link of two classes that no link before it in the block
    connects, their roots.  Else they are pairs of texts by signatures alone, of each asking text the ``most`` that agree
    best.  A pair that shares several buckets is looked at in the first of them only.
    """
    if not len(rows):
        return 0, pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.bool_())
    band, i, j, rep, root, n = (rows.column(c).to_numpy() for c in ("band", "i", "j", "rep", "root", "n"))
    outer, asks = (rows.column(c).to_numpy().astype(bool) for c in ("outer", "asks"))
    new = np.flatnonzero((band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
    edges = np.concatenate([[0], new, [len(rows)] if last else []]).astype(np.int64)
    whole = int(edges[-1])
    sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(rows), -1)
    bands = np.asarray(rows.column("bands").combine_chunks().flatten()).reshape(len(rows), -1)
    glance = np.ascontiguousarray(sketch[:, :GLANCE])
    low, least = (k * similarity - DEVIATIONS * np.sqrt(k * similarity * (1 - similarity)) for k in (glance.shape[1], sketch.shape[1]))
    left, right, more, label = [], [], [], root.copy()  # label: the classes as the block's links have merged them
    for a, b in zip(edges, edges[1:], strict=False):
        asking, y, block = a + np.flatnonzero(asks[a:b]), a + np.flatnonzero(~asks[a:b]), None
        for at in range(0, len(asking) if len(y) else 0, 32):
            x = asking[at : at + 32]
            nx, ny = n[x][:, None], n[y][None, :]
            good = (label[x][:, None] != label[y][None, :]) & (np.minimum(nx, ny) >= similarity * np.maximum(nx, ny))
            good &= ~outer[y][None, :] | (rep[x][:, None] < rep[y][None, :])  # two outer texts meet twice
            u, v = np.nonzero(good)
            for part, bound in ((glance, low), (sketch, least)):
                agree = np.zeros(len(u), np.int64)
                for c in range(0, len(u), 4096):
                    d = slice(c, c + 4096)
                    agree[d] = (part[x[u[d]]] == part[y[v[d]]]).sum(1)
                u, v, agree = u[agree >= bound], v[agree >= bound], agree[agree >= bound]
            shared = bands[x[u]] == bands[y[v]]
            once = bands[x[u], shared.argmax(1)] == band[x[u]] if len(u) else np.zeros(0, bool)  # in the first bucket that both are in
            u, v, agree = u[once], v[once], agree[once]
            if len(u) and most is None:
                block = block or _Block(rows.column("shingles").slice(a, b - a).to_pylist(), n[a:b], a)
                for k in np.unique(u):
                    own, others = x[k], y[v[u == k]]
                    others = others[label[others] != label[own]]
                    if not len(others):
                        continue
                    others = others[block.similar(own, others) >= similarity]
                    joined, first = np.unique(label[others], return_index=True)
                    left.append(np.repeat(root[own], len(first)))
                    right.append(root[others[first]])
                    if len(joined):
                        label[a:b][np.isin(label[a:b], joined)] = label[own]
            elif len(u):
                order = np.lexsort((v, -agree, u))
                u, v = u[order], v[order]
                first = np.flatnonzero(np.diff(u, prepend=-1))
                size = np.diff(np.append(first, len(u)))
                rank = np.arange(len(u)) - np.repeat(first, size)
                keep = rank < most
                more.append((np.repeat(size, size) > most)[keep])
                left.append(rep[x[u[keep]]])
                right.append(rep[y[v[keep]]])
    p, q = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
    return whole, pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(np.concatenate(more) if more else np.zeros(len(p), bool))


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of buckets that hold several classes, with the bucket's largest class and its numbers of blocks."""
    known = members.withColumn("load", F.col("n") if "n" in members.columns else F.lit(1)).join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", "load", F.coalesce("root", "rep").alias("root"))
    shares = known.groupBy("band", "root").agg(F.count("*").alias("share"), F.sum("load").alias("load"))
    top = shares.groupBy("band").agg(F.max(F.struct("share", "root", "load")).alias("top"), F.sum("share").alias("all"), F.sum("load").alias("load"), F.count("*").alias("classes")).filter("classes > 1")
    parts = lambda texts, size, load: F.greatest(F.ceil(texts / size), F.ceil(load / LOAD)).cast("int")
    top = top.select("band", F.col("top.root").alias("largest"), parts(F.col("all"), INNER, F.col("load")).alias("inners"), parts(F.col("all") - F.col("top.share"), OUTER, F.col("load") - F.col("top.load")).alias("outers"))
    return known.drop("load").join(top, "band")


def _open_pairs(members: DataFrame, texts: DataFrame, roots: DataFrame, similarity: float, most: int | None = None) -> DataFrame:
    """Pairs (a, b) of different classes that share a bucket, as ``_compare`` finds them.

    Without ``most`` they are the roots of classes that links of ``similarity`` connect, enough of them to connect all;
    ``texts`` must hold the hashed shingles then.  With it, they are pairs of texts that may be similar enough by their
    signatures, cut where a text has over ``most`` of them.

    Texts outside a bucket's largest class ask all its members.  Both are dealt to blocks, so a bucket of m members
    of which r are outside makes m * ceil(r / OUTER) + r * ceil(m / INNER) rows (more where its texts are long), and no
    task holds a whole bucket.
    """
    own = ["n", "sketch", "bands", *(["shingles"] if most is None else [])]
    held = _open(members, roots).join(texts.select("rep", *own), "rep").withColumn("outer", F.col("root") != F.col("largest"))
    deal = lambda parts: F.pmod(F.xxhash64("rep"), F.col(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    columns = ["band", "i", "j", "rep", "root", *own, "outer", "asks"]
    asking = held.filter("outer").withColumns({"i": deal("outers"), "asks": F.lit(True)}).withColumn("j", each("inners")).select(*columns)
    asked = held.withColumns({"j": deal("inners"), "asks": F.lit(False)}).withColumn("i", each("outers")).select(*columns)
    blocks = asking.unionByName(asked).repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    found = blocks.mapInArrow(_across(similarity, most), "a long, b long, cut boolean")
    return found.groupBy("a", "b").agg(F.max("cut").alias("cut"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id, class_size, kept for every row of ``docs``.

    A class holds the texts that links of at least ``similarity`` connect, and all their copies; class_id is its
    smallest doc_id, and the row with that id is kept.  Texts of fewer than five words are one shingle;
    texts without words (also null) are classes of their own text only.  Repeated rows share a class, and
    a null doc_id has class_id null if its class has no other id; such texts are compared like others.  Texts are
    read whole, extra columns are ignored, an empty table gives an empty result.
    """
    work = Workspace(docs.sparkSession, "near")
    keyed = docs.select(*row_key(), "text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in W.slices(batch.column(2), 1 << 21, 1024):
                keys, n = band_keys(batch.column(2)[a:b], bands, rows)
                lists = pa.ListArray.from_arrays(np.arange(0, (b - a + 1) * bands, bands, dtype=np.int32), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], lists, pa.array(n.astype(np.int64))], names=["doc_id", "text_sha", "bands", "n"])

    signed = work.keep(keyed.mapInArrow(sign, "doc_id long, text_sha string, bands array<long>, n long"), "signed")
    # one text of each group of copies goes on, under a number of its own
    texts = signed.groupBy("text_sha").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min("bands").alias("bands"), F.max("n").alias("n"))
    texts = work.keep(texts.withColumn("rep", F.monotonically_increasing_id()), "texts")
    each = texts.filter("n > 0").select("rep", "n", F.explode("bands").alias("band"))
    full = work.keep(each.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1"), "full")
    members = work.keep(each.join(full, "band"), "members")
    company = work.keep(members.groupBy("rep").agg(F.sum("members").alias("company")), "company")
    centres = members.join(company, "rep").groupBy("band").agg(F.max(F.struct("company", (-F.col("rep")).alias("minus"))).alias("c"))
    centres = work.keep(centres.select("band", (-F.col("c.minus")).alias("centre")), "centres")
    pairs = members.join(centres, "band").filter("rep <> centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
    pairs = work.keep(pairs, "pairs")
    key = lambda doc: F.concat_ws(":", "text_sha", F.col(doc).cast("string")).alias("key")
    wanted = company.select("rep").join(texts.select("rep", "text_sha", "least"), "rep").select("rep", key("least"))
    bodies = keyed.select(key("doc_id"), "text").join(wanted, "key").groupBy("key").agg(F.first("rep").alias("rep"), F.first("text").alias("text"))
    bodies = work.keep(bodies.drop("key"), "bodies")
    work.drop("full", "centres")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in W.slices(batch.column(2), 1 << 20, 512):
                part = batch.slice(x, y - x)
                good = pa.array(similarities(part.column(2), part.column(3)) >= similarity)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(good), part.column(1).filter(good)], names=["a", "b"])

    first = pairs.join(bodies.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a")
    second = first.join(bodies.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    edges = work.keep(second.mapInArrow(verify, "a long, b long"), "edges")
    roots = components(edges, Workspace(docs.sparkSession, "near-0"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in W.slices(batch.column(1), 1 << 20, 128):
                n, made, shingles = sketches(batch.column(1)[x:y])
                own = [h.tobytes() for h in np.split(shingles, np.cumsum(n)[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[x:y], pa.array(n.astype(np.int64)), pa.array([m.tobytes() for m in made], pa.binary()), pa.array(own, pa.binary()), batch.column(2)[x:y]], names=["rep", "n", "sketch", "shingles", "bands"])

    opened = bodies.join(_open(members, roots).select("rep").distinct(), "rep").join(texts.select("rep", "bands"), "rep").select("rep", "text", "bands")
    fine = work.keep(opened.mapInArrow(sketch, "rep long, n long, sketch binary, shingles binary, bands array<long>"), "fine")
    work.drop("bodies")
    found = work.keep(_open_pairs(members, fine, roots, similarity).select("a", "b"), "found")
    merged = components(found, Workspace(docs.sparkSession, "near-1"))  # classes only, not their texts again
    work.drop("members", "fine")
    classes = texts.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("text_sha", "copies", "least", F.coalesce("root", "rep").alias("first"))
    classes = classes.join(merged.select(F.col("node").alias("first"), "root"), "first", "left").select("text_sha", "copies", "least", F.coalesce("root", "first").alias("class"))
    classes = work.keep(classes, "classes")
    sizes = work.keep(classes.groupBy("class").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size")), "sizes")
    classes = work.keep(classes.join(sizes, "class").select("text_sha", "class_id", "class_size"), "sized")
    out = signed.select("doc_id", "text_sha").join(classes, "text_sha")
    return out.select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
