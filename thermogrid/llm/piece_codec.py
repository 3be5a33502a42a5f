"""SentencePiece encoding and decoding.

Unigram models: the best segmentation is a path of largest sum, so a text may be cut anywhere.  The state at a
cut is how many characters ago the open piece began.  Each chunk yields a matrix of best sums from the states at
its start to those at its end; matrices are combined associatively with (max, +), which gives the state at
every cut, and each chunk is then traced back on its own (``transfer``, ``combine``, ``states``, ``trace``;
``encode_unigram_documents`` deals the chunks of giant texts to all tasks).

Models of type BPE apply merges in order of rank, which is no path of largest sum: the method above gives other
ids than the library's.  No piece holds a space after another character, so such a text falls apart into
segments (spaces and what follows them) that no merge crosses; at such a boundary there is one state only, chunks
join without a matrix, and segments seen before come from a bounded cache (``SegmentEncoder``).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import Workspace

CACHE = 400_000
CHUNK = 16_384
#: Matrices that are combined at a time.
GROUP = 64
SPACE = "▁"
_SEGMENTS = re.compile(" +[^ ]+| +$").findall


class Pieces:
    """The vocabulary of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.piece = [self.model.id_to_piece(i) for i in range(n)]
        self.raw, self.plain, byte = [], {}, {}
        for i, p in enumerate(self.piece):
            if self.model.is_byte(i):
                byte[int(p[3:-1], 16)] = i
                self.raw.append(bytes([int(p[3:-1], 16)]))
            elif self.model.is_control(i) or self.model.is_unknown(i):
                self.raw.append(b"")
            else:
                self.plain[p] = i
                self.raw.append(p.replace(SPACE, " ").encode())
        self.score = {p: self.model.get_score(i) for p, i in self.plain.items()}
        self.byte = byte
        self.longest = max(map(len, self.plain))
        self.unknown = min(self.score.values()) - 10.0
        self.cuts_at_spaces = not any(SPACE in p.lstrip(SPACE) for p in self.plain)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, less the space that encoding puts in front."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=1)
def _pieces(path: str) -> Pieces:
    """One vocabulary for all tasks of a Python worker."""
    return Pieces(path)


class SegmentEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, equal to the library's own for a BPE model."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.cache: dict[str, bytes] = {}
        self.alone = np.asarray([self.pieces.plain.get(SPACE, 0)], "<u4").tobytes()

    def _fill(self, new: list[str]) -> None:
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
        for s, ids in zip(new, self.pieces.model.encode([s[1:] for s in new], num_threads=1), strict=True):
            self.cache[s] = np.asarray(ids, "<u4").tobytes()
        if " " in new:  # a last single space; the library puts none before an empty text
            self.cache[" "] = self.alone

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if SPACE in text or not self.pieces.cuts_at_spaces:
            return np.asarray(self.pieces.model.encode(text), "<u4").tobytes()
        parts, out = _SEGMENTS(" " + text), []
        for at in range(0, len(parts), CACHE // 4):
            some = parts[at : at + CACHE // 4]
            for _ in range(3):
                try:
                    out.append(b"".join(map(self.cache.__getitem__, some)))
                    break
                except KeyError:
                    self._fill(list(set(some).difference(self.cache)))
        return b"".join(out)


def _reach(text: str, begin: int, stop: int, first_after: int, pieces: Pieces) -> dict[int, tuple[float, int]]:
    """Best (sum, previous cut) of cuts up to ``stop`` on paths from a cut at ``begin`` whose next cut is after ``first_after``."""
    best = {begin: (0.0, -1)}
    for i in range(begin, stop):
        if i not in best or (begin < i <= first_after):
            continue
        base = best[i][0]
        for n in range(max(1, first_after + 1 - i) if i == begin else 1, min(pieces.longest, stop - i) + 1):
            s = pieces.score.get(text[i : i + n], pieces.unknown if n == 1 else None)
            if s is not None and (i + n not in best or base + s > best[i + n][0]):
                best[i + n] = (base + s, i)
    return best


def transfer(text: str, start: int, stop: int, pieces: Pieces) -> np.ndarray:
    """Entry (a, b): the best sum from a last cut ``a`` characters before ``start`` to one ``b`` before ``stop``.

    All entry states go through the chunk together, one vector of sums at each character.
    """
    n, low = pieces.longest, -np.inf
    sums = np.full((stop - start + 1, n), low)
    sums[0, 0] = 0.0
    for a in range(1, min(n, start + 1)):  # the open piece ends inside the chunk
        for at in range(start + 1, min(stop, start - a + n) + 1):
            s = pieces.score.get(text[start - a : at])
            if s is not None:
                sums[at - start, a] = max(sums[at - start, a], s)
    for i in range(start, stop):
        now = sums[i - start]
        if now.max() == low:
            continue
        for k in range(1, min(n, stop - i) + 1):
            s = pieces.score.get(text[i : i + k], pieces.unknown if k == 1 else None)
            if s is not None:
                np.maximum(sums[i - start + k], now + s, out=sums[i - start + k])
    out = np.full((n, n), low)
    for b in range(min(n, stop + 1)):
        at = stop - b
        if at > start:
            out[:, b] = sums[at - start]
        elif start - at < n:
            out[start - at, b] = 0.0  # no cut in the chunk at all
    return out


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product; associative."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def states(matrices: list[np.ndarray], entry: int, leave: int) -> list[int]:
    """The states at all edges of chunks on the best path from state ``entry`` to state ``leave``."""
    ahead = [matrices[-1][:, leave]]  # best sums to the end, from each state
    for m in reversed(matrices[:-1]):
        ahead.append((m + ahead[-1][None, :]).max(1))
    ahead.reverse()
    out = [entry]
    for k, m in enumerate(matrices[:-1]):
        out.append(int(np.argmax(m[out[-1]] + ahead[k + 1])))
    return [*out, leave]


def trace(text: str, start: int, stop: int, entry: int, leave: int, pieces: Pieces) -> list[int]:
    """Ids of the pieces that end in a chunk, given the states at its edges; each chunk is traced back on its own."""
    begin, end = start - entry, stop - leave
    if end <= start:  # one piece spans the whole chunk and ends later
        return []
    best, cuts = _reach(text, begin, stop, start, pieces), [end]
    while cuts[-1] != begin:
        cuts.append(best[cuts[-1]][1])
    out: list[int] = []
    for i, j in zip(cuts[::-1], cuts[::-1][1:], strict=False):
        p = text[i:j]
        out += [pieces.plain[p]] if p in pieces.plain else [pieces.byte.get(x, 0) for x in p.encode()]
    return out


def marked(text: str) -> str:
    """The text as the vocabulary sees it."""
    return SPACE + text.replace(" ", SPACE)


def encode_unigram(text: str, pieces: Pieces, chunk: int = CHUNK) -> list[int]:
    """Ids of the best segmentation of ``text``; longer texts than ``chunk`` by the scan over transfer matrices."""
    if not text:
        return []
    text = marked(text)
    edges = list(range(0, len(text), chunk)) + [len(text)]
    cuts = list(zip(edges, edges[1:], strict=False))
    at = states([transfer(text, a, b, pieces) for a, b in cuts], 0, 0) if len(cuts) > 1 else [0, 0]
    return [i for k, (a, b) in enumerate(cuts) for i in trace(text, a, b, at[k], at[k + 1], pieces)]


def encode_unigram_documents(docs: DataFrame, model_path: str, chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """doc_id, chunk (its number), ids of the best segmentation of every text, one row per chunk of ``chunk`` characters.

    The chunks of a giant text are dealt to all tasks: each gives its transfer matrix, ``group`` matrices at a time are
    combined, level upon level, until one is left for a text; the states at the edges then come down the same levels,
    and each chunk is traced back on its own.  So no task holds more than ``group`` matrices or one chunk of text.
    A null or empty text has no row, repeated rows are encoded each, a null id is carried along, extra columns are
    ignored, an empty table gives an empty result.
    """
    work, reach = Workspace(docs.sparkSession, "pieces"), _pieces(model_path).longest
    seen = F.concat(F.lit(SPACE), F.replace(F.col("text"), F.lit(" "), F.lit(SPACE)))
    rows = docs.filter("text <> ''").select(F.monotonically_increasing_id().alias("rid"), "doc_id", seen.alias("text"))
    rows = rows.select("rid", "doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / chunk).cast("int"))).alias("chunk"))
    first = F.greatest(F.col("chunk") * chunk - reach, F.lit(0))
    part = F.substring(F.col("text"), first + 1, F.col("chunk") * chunk + chunk - first)
    rows = work.keep(rows.select("rid", "doc_id", "chunk", part.alias("part"), (F.col("chunk") * chunk - first).alias("start"), (F.char_length("text") > chunk).alias("long")).repartition("rid", "chunk"), "chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model_path)
        for batch in batches:
            for rid, k, text, start in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                m = transfer(text, start, len(text), pieces)
                yield pa.RecordBatch.from_arrays([pa.array([rid]), pa.array([k], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=["rid", "k", "m"])

    def stacked(table: pa.Table) -> tuple[list[int], list[np.ndarray]]:
        order = sorted(range(len(table)), key=table.column("k").to_pylist().__getitem__)
        return [table.column("k")[i].as_py() for i in order], [np.frombuffer(table.column("m")[i].as_py()).reshape(reach, reach) for i in order]

    def product(key: tuple, table: pa.Table) -> pa.Table:
        _, m = stacked(table)
        out = m[0]
        for x in m[1:]:
            out = combine(out, x)
        return pa.table({"rid": [key[0].as_py()], "k": pa.array([key[1].as_py()], pa.int32()), "m": pa.array([out.tobytes()], pa.binary())})

    def inside(key: tuple, table: pa.Table) -> pa.Table:
        k, m = stacked(table)
        at = states(m, table.column("entry")[0].as_py(), table.column("leave")[0].as_py())
        return pa.table({"rid": [key[0].as_py()] * len(k), "k": pa.array(k, pa.int32()), "entry": pa.array(at[:-1], pa.int32()), "leave": pa.array(at[1:], pa.int32())})

    levels = [work.keep(rows.filter("long").select("rid", "chunk", "part", "start").mapInArrow(matrices, "rid long, k int, m binary"), "matrices-0")]
    over = lambda x: x.withColumn("g", F.floor(F.col("k") / group).cast("int"))
    while (levels[-1].agg(F.max("k")).first()[0] or 0) >= group:
        levels.append(work.keep(over(levels[-1]).groupBy("rid", "g").applyInArrow(product, "rid long, k int, m binary"), f"matrices-{len(levels)}"))
    ends = levels[-1].select("rid", F.lit(0).alias("g"), F.lit(0).alias("entry"), F.lit(0).alias("leave")).distinct()
    for n, level in reversed(list(enumerate(levels))):
        known = over(level).join(ends, ["rid", "g"]).groupBy("rid", "g").applyInArrow(inside, "rid long, k int, entry int, leave int")
        known = work.keep(known, f"states-{n}")
        ends = known.withColumnRenamed("k", "g")
    at = known.withColumnRenamed("k", "chunk")

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model_path)
        for batch in batches:
            text, start, entry, leave = (batch.column(c).to_pylist() for c in ("part", "start", "entry", "leave"))
            ids = [trace(t, a, len(t), e or 0, x or 0, pieces) for t, a, e, x in zip(text, start, entry, leave, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "chunk", "ids"])

    return rows.join(at, ["rid", "chunk"], "left").select("doc_id", "chunk", "part", "start", "entry", "leave").mapInArrow(traced, "doc_id long, chunk int, ids array<int>")


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, round_trip for every row of ``docs`` and its whole text.

    ``ids_crc32`` is of the ids as little-endian unsigned 32-bit numbers; ``round_trip`` tells whether decoding
    them gives the text again.  A null or empty text has no ids.  Repeated rows each get a result, extra columns
    are ignored, an empty table gives an empty result; a text is encoded whole in one task, however long it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = SegmentEncoder(model_path)
        for batch in batches:
            for a, b in W.slices(batch.column(1)):
                n, crc, same = [], [], []
                for text in batch.column(1)[a:b].to_pylist():
                    ids = encoder.encode(text or "")
                    n.append(len(ids) // 4)
                    crc.append(zlib.crc32(ids))
                    same.append(encoder.pieces.decode(np.frombuffer(ids, "<u4").tolist()) == (text or ""))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], names=["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
