"""Best-fit packing with a bounded number of open bins.

Documents become pieces where their texts are read: only the numbers of a piece (where it starts, its length, a checksum)
go on, as a written table.  Packers, one for every ``PIECES`` pieces whatever the input's size, then take pieces as they
come: each goes to the open bin with the least free space that holds it.  Open bins lie on stacks by their free space,
and one whole number has a bit for each stack that is not empty, so the fitting bin is the lowest bit above
the length.  When more than ``OPEN`` bins are open, the fullest closes.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import words
from .packing import Known
from .store import Workspace

CAPACITY = 1024
OPEN = 1024
PIECES = 32_768
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
SCHEMA = PIECE + ", sequence_id long, offset long"
#: A join of new units for the tokenizer has about so many bytes.
_JOINED = 1 << 16

#: How byte-level tokenizers part a text.  Fixed value.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes that surely begin no white space and no special token after a white-space byte; other lead bytes may.
_PLAIN = ~words.SPACE
_PLAIN[[0xC2, 0xE1, 0xE2, 0xE3, ord("<")]] = False


class ByteEncoder:
    """Token ids of many texts at once by a byte-level tokenizer, equal to the tokenizer's own.

    Its pattern never joins what is before the last white space of a run with what follows, so a text parts into units,
    each a white-space byte with the word after it, whose ids do not depend on each other.  Arrow finds the
    distinct units of a slice; new ones are encoded many in a row, as they stand in a text, and told apart by the lengths
    of their ids' bytes.  The first unit of a text, which may begin in any way, is encoded alone.  Where the
    tokenizer's merges come in the order of their ids, as usual, a quicker library reads the same vocabulary.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # each character of a token stands for one byte
            self.bytes_of[i] = len(token)
        self.quick = self._by_ranks(json.loads(self.tokenizer.to_str()))
        self.units = Known(self._new)

    @staticmethod
    def _by_ranks(spec: dict):
        import tiktoken

        model, parts, added = spec["model"], spec["pre_tokenizer"], spec["added_tokens"]
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        plain = parts["type"] == "ByteLevel" and parts["use_regex"] and not parts["add_prefix_space"] and not spec["normalizer"] and not model["ignore_merges"]
        if not plain or merged != sorted(merged) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            return None
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes that stand for themselves
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
        special = {t["content"]: t["id"] for t in added}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.quick:
            return [np.asarray(self.quick.encode(t, allowed_special="all"), "<u4") for t in texts]
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _new(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = words.flat(units)
        length = np.diff(offsets)
        begin = offsets[:-1]
        joins = length > 1
        joins[joins] = words.SPACE[data[begin[joins]]] & _PLAIN[data[begin[joins] + 1]]
        sizes = np.zeros(len(units), np.int64)
        at, alone = np.flatnonzero(joins), np.flatnonzero(~joins)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # (which units, ids of all)
        single = self._encode(units.take(pa.array(alone)).to_pylist())
        sizes[alone] = [len(x) for x in single]
        found += [(alone[k : k + 1], x) for k, x in enumerate(single)]
        if len(at):
            groups = np.split(at, np.flatnonzero(np.diff(np.cumsum(length[at]) // _JOINED)) + 1)
            texts = ["".join(units.take(pa.array(g)).to_pylist()) for g in groups]
            for g, ids in zip(groups, self._encode(texts), strict=True):
                ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(length[g])) + 1
                sizes[g] = np.diff(ends, prepend=0)
                found.append((g, ids))
        first = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), "<u4")
        for g, ids in found:
            n = sizes[g]
            out[np.arange(len(ids)) + np.repeat(first[g] - (np.cumsum(n) - n), n)] = ids
        return out, sizes

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and end)."""
        data, offsets = words.flat(column)
        n = len(data)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        cut = np.zeros(n + 1, bool)
        cut[: n - 1] = words.SPACE[data[:-1]] & _PLAIN[data[1:]]
        cut[offsets[1:][offsets[1:] > 0] - 1] = False  # the last byte of a text does not look into the next one
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        units = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        ids, size = self.units.ids_of(units)
        ends = np.concatenate([[0], np.cumsum(size)])
        return ids, ends[np.searchsorted(edges, offsets)]


@lru_cache(maxsize=1)
def byte_encoder(path: str) -> ByteEncoder:
    """One encoder for all tasks of a Python worker, so that its cache stays warm."""
    return ByteEncoder(path)


class BestFit:
    """Open bins by their free space; ``place`` gives the sequence and the offset of a piece."""

    def __init__(self, first: int, capacity: int = CAPACITY, most: int = OPEN):
        self.next, self.capacity, self.most, self.open = first, capacity, most, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.free = 0  # bit f is set where a bin with f free places is open

    def _take(self, free: int) -> int:
        stack = self.bins[free]
        sequence = stack.pop()
        if not stack:
            self.free ^= 1 << free
        self.open -= 1
        return sequence

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.free >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            sequence = self._take(free)
        else:
            free, sequence = self.capacity, self.next
            self.next += 1
        left = free - length
        if left:
            if self.open == self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            self.bins[left].append(sequence)
            self.free |= 1 << left
            self.open += 1
        return sequence, self.capacity - free


def cut_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of all documents (``PIECE``): a longer one than a sequence ends in full pieces, its first may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(tokenizer_path).encode
        end = np.asarray([end_id], "<u4").tobytes()
        names = [c.split()[0] for c in PIECE.split(", ")]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b in words.slices(batch.column(1), 1 << 23, 8192):
                tokens, edges = encode(batch.column(1)[a:b])
                out: list[list] = [[] for _ in names]
                for doc_id, x, y in zip(ids[a:b], edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    view = memoryview(tokens[x:y].tobytes() + end)
                    n = y - x + 1
                    start, stop, piece = 0, (n - 1) % capacity + 1, 0
                    while start < n:
                        for column, value in zip(out, (doc_id, piece, start, stop - start, zlib.crc32(view[4 * start : 4 * stop])), strict=True):
                            column.append(value)
                        start, stop, piece = stop, stop + capacity, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(out)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECE)


def pack_best_fit(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY, most_open: int = OPEN, pieces: int = PIECES) -> DataFrame:
    """One row per piece of every document of ``docs``; see ``SCHEMA``.

    A null or empty text is the end id alone.  Documents of at most ``capacity`` ids stay whole; longer ones, however
    long, make full pieces after a first one that may be shorter.  Repeated rows and ids are packed once each, a null id
    is carried along.  Extra columns are ignored; an empty table gives an empty result.  Sequence ids carry the
    packer's number in their upper bits.
    """
    work = Workspace(docs.sparkSession, "bestfit")
    cut = work.keep(cut_documents(docs, tokenizer_path, end_id, capacity), "pieces")
    packers = max(1, ceil(cut.count() / pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = BestFit(TaskContext.get().partitionId() << 40, capacity, most_open)
        for batch in batches:
            placed = [fit.place(n) for n in batch.column("length").to_pylist()]
            more = [pa.array([p[k] for p in placed], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "sequence_id", "offset"])

    return cut.repartition(packers).mapInArrow(run, SCHEMA)
