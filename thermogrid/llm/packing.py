"""Packing of token sequences by harmonic classes.

The rest of a document, after its full sequences, belongs to the class k of the lengths in
(capacity / (k + 1), capacity / k], and each bin of a class takes k documents; rests shorter than
capacity / (``CLASSES`` + 1) share the last class, whose bins take what fits.  What is then left of a bin is less
than the next document of its class, which is cut there: its head fills the bin, and its tail goes to the class of
its own length.  So every filled bin has no padding, and a bin makes one cut.

Each worker fills its own bins and holds one open bin of each class, so there is no shuffle, and no state that
grows with the input.  At its end the open bins are laid end to end and cut at the capacity; the last part is cut
into lengths that are powers of two, which need no padding either.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import words

CAPACITY = 4096
CLASSES = 16
CACHE = 600_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Deals documents, given as the bytes of their ids, to bins class by class; finished pieces wait in ``out``."""

    def __init__(self, first: int, capacity: int = CAPACITY, classes: int = CLASSES):
        self.next, self.capacity, self.classes = first, capacity, classes
        self.open: dict[int, tuple[list, int]] = {}
        self.out: list[list] = [[] for _ in SCHEMA.split(", ")]

    def add(self, doc_id: int | None, ids: bytes) -> None:
        view, at, n = memoryview(ids), 0, len(ids) // 4
        while n - at > self.capacity:
            self._close([(doc_id, at, view[4 * at : 4 * (at + self.capacity)], n)])
            at += self.capacity
        while at < n:
            at += self._deal(doc_id, at, view[4 * at :], n)

    def _deal(self, doc_id: int | None, at: int, rest: memoryview, n: int) -> int:
        """Put the rest of a document, or as much of it as fills a bin, into the bin of its class."""
        length = len(rest) // 4
        k = min(self.capacity // length, self.classes + 1)
        held, size = self.open.get(k, ([], 0))
        whole = len(held) < k if k <= self.classes else size + length <= self.capacity
        if not whole:
            length = self.capacity - size
        if length:
            held.append((doc_id, at, rest[: 4 * length], n))
            size += length
        if size == self.capacity:
            self._close(held)
            self.open.pop(k, None)
        else:
            self.open[k] = (held, size)
        return length

    def _close(self, held: list) -> None:
        offset = 0
        for doc_id, start, part, n in held:
            length = len(part) // 4
            for column, value in zip(self.out, (doc_id, start, length, zlib.crc32(part), n, self.next, offset), strict=True):
                column.append(value)
            offset += length
        self.next += 1

    def close(self) -> None:
        left = [x for held, _ in self.open.values() for x in held]
        total = sum(len(x[2]) // 4 for x in left)
        self.open.clear()
        while total:
            size = self.capacity if total >= self.capacity else 1 << (total.bit_length() - 1)
            held, room = [], size
            while room:
                doc_id, start, part, n = left.pop()
                take = min(room, len(part) // 4)
                held.append((doc_id, start, part[: 4 * take], n))
                if 4 * take < len(part):
                    left.append((doc_id, start + take, part[4 * take :], n))
                room -= take
            self._close(held)
            total -= size

    def rows(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in self.out], names=[x.split()[0] for x in SCHEMA.split(", ")])
        for column in self.out:
            column.clear()
        return batch


class Known:
    """Numbered strings with their ids, at most about ``CACHE`` of them."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.size, self.first = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids_of(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all strings one after another, number of ids of each)."""
        coded = strings.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False)  # far quicker than a list
        if len(self.number) > CACHE:
            self.clear()
        number = np.fromiter(map(self.number.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(number < 0)
        if len(new):
            ids, size = self.encode(coded.dictionary.take(pa.array(new)))
            number[new] = np.arange(len(self.size), len(self.size) + len(new))
            self.number.update(zip(names[new], number[new].tolist(), strict=True))
            self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])
            self.first = np.cumsum(self.size) - self.size
        wanted = number[np.asarray(coded.indices)]
        size = self.size[wanted]
        before = np.cumsum(size) - size
        return self.ids[np.arange(int(size.sum())) + np.repeat(self.first[wanted] - before, size)], size


class WordEncoder:
    """Token ids of many texts at once, equal to the tokenizer's own.

    White space parts a text into words whose ids do not depend on each other.  The texts of a slice are split and
    their distinct words found by Arrow, only words that the bounded cache lacks are encoded, and the ids are put
    in order by their numbers.  New words of Latin letters, digits and marks are cut as the tokenizer cuts them, and
    their pieces come from a second cache or from the tokenizer's model; other words go through the tokenizer.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        self.cut = f"({spec['pre_tokenizer']['pretokenizers'][0]['pattern']['Regex']})"
        bytelevel = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.visible = {i: bytelevel.pre_tokenize_str(chr(i))[0][0][-1] for i in range(33, 127)}
        for i in range(0xA1, 0x250):  # the visible forms of the bytes that Latin letters have
            for byte, form in zip(chr(i).encode(), bytelevel.pre_tokenize_str(chr(i))[0][0], strict=True):
                self.visible[byte] = form
        self.words, self.pieces = Known(self._words), Known(self._pieces)

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, size, tokenize = [], [], self.model.tokenize
        for piece in pieces.to_numpy(zero_copy_only=False):
            tokens = tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.visible))
            ids += [t.id for t in tokens]
            size.append(len(tokens))
        return np.asarray(ids, "<u4"), np.asarray(size, np.int64)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # no combining marks, no white space, no letter with a lower case of two, no added token
        other = np.asarray(pc.match_substring_regex(words, "[^!-~\\x{A1}-\\x{12F}\\x{131}-\\x{24F}]|<\\|"), bool)
        size, parts = np.zeros(len(words), np.int64), []
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(words.filter(pa.array(~other))), self.cut, "\\1 "))
        ids, n = self.pieces.ids_of(cut.flatten())
        ends = np.concatenate([[0], np.cumsum(n)])[np.asarray(cut.offsets, np.int64)]
        size[~other] = np.diff(ends)
        if not other.any():
            return ids, size
        at = np.flatnonzero(other)
        parts = [np.asarray(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4") for w in words.take(pa.array(at)).to_pylist()]
        size[at] = [len(x) for x in parts]
        out = np.zeros(int(size.sum()), "<u4")
        theirs = np.repeat(other, size)
        out[~theirs], out[theirs] = ids, np.concatenate(parts)
        return out, size

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and end)."""
        split = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
        ids, size = self.words.ids_of(split.flatten())
        edges = np.asarray(split.offsets, np.int64)
        return ids, np.concatenate([[0], np.cumsum(size)])[edges - edges[0]]


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker, so that its caches stay warm."""
    return WordEncoder(path)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY, encoder: Callable[[str], object] | None = None) -> DataFrame:
    """One row per piece of every document of ``docs``; see ``SCHEMA``.

    A null or empty text is the end id alone; a text longer than a sequence fills sequences of its own first,
    however long it is.  Repeated rows and ids are packed once each, a null id is carried along.  Extra columns are
    ignored; an empty table gives an empty result.  Sequence ids carry the number of the partition in their upper
    bits, so that workers need not agree on anything.
    """
    make = encoder or word_encoder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make(tokenizer_path).encode
        end = np.asarray([end_id], "<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId() << 40, capacity)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b in words.slices(batch.column(1), 1 << 23, 8192):
                tokens, edges = encode(batch.column(1)[a:b])
                for k, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True), a):
                    packer.add(ids[k], tokens[x:y].tobytes() + end)
                if len(packer.out[0]) > 20_000:
                    yield packer.rows()
        packer.close()
        if packer.out[0]:
            yield packer.rows()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
