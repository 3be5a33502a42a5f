"""Quality by nearest-neighbour voting in a latent-semantic space.

Texts become weighted counts of hashed words, hashed symbol runs and a few bins of shape (capitals, repeated
words, repeated runs, length).  A truncated singular value decomposition of a bounded sample of labelled rows
gives the latent space.  The sample's vectors are broadcast (``SAMPLE`` rows of either label times ``RANK``
numbers at most); every document's exact cosines with all of them are computed in blocks, and the labels of its
``NEIGHBOURS`` nearest vote, weighted by similarity and by the share of their label among all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .store import Workspace, held_out
from .toxicity import sampled

SAMPLE = 2000
RANK = 48
NEIGHBOURS = 25
THRESHOLD = 0.3
WORDS, SYMBOLS, SHAPES = 4096, 1024, 80
TERMS = WORDS + SYMBOLS + SHAPES
#: Every byte but ASCII symbols ends a symbol run.
_NOT_SYMBOL = np.array([not (32 < b < 127 and not chr(b).isalnum()) for b in range(256)])
_LOWERED = W._BYTE[W.LOWER]
_BINS = np.array([0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])


def counts(column: pa.Array) -> np.ndarray:
    """Damped term counts, one row per text."""
    n = len(column)
    out = np.zeros((n, TERMS), np.float32)
    words = W.split(column, W.NOT_WORD)
    h, owner, many = words.hashes(_LOWERED), words.owner(), np.maximum(words.counts, 1)
    out[:, :WORDS] = np.bincount(owner * WORDS + (h % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    symbols = W.split(column, _NOT_SYMBOL)
    at = symbols.owner() * SYMBOLS + (symbols.hashes() % np.uint64(SYMBOLS)).astype(np.int64)
    out[:, WORDS : WORDS + SYMBOLS] = np.bincount(at, minlength=n * SYMBOLS).reshape(n, SYMBOLS)
    np.log1p(out, out=out)
    # a term counts by its share of the text, so that long texts do not look like one another
    out[:, : WORDS + SYMBOLS] /= np.log1p(many)[:, None]
    shape = np.zeros((n, 6))
    if len(h):
        lead, last = words.data[words.starts], words.data[words.ends - 1]
        loud = (lead - 65 < 26) & (last - 65 < 26) & (words.ends - words.starts > 1)
        shape[:, 0] = np.bincount(owner[loud], minlength=n) / many
        same = np.flatnonzero((h[1:] == h[:-1]) & (owner[1:] == owner[:-1])) + 1
        shape[:, 1] = np.bincount(owner[same], minlength=n) / many
        runs, of = W.shingles(words, 3)
        distinct = np.bincount(_owners(runs, of), minlength=n)
        shape[:, 2] = 1 - distinct / np.maximum(np.bincount(of, minlength=n), 1)
    shape[:, 3] = np.minimum(symbols.counts / many / 2, 1)
    length = np.asarray(symbols.ends - symbols.starts, float)
    shape[:, 4] = np.minimum(np.bincount(symbols.owner(), weights=np.maximum(length - 1, 0), minlength=n) / many, 1)
    shape[:, 5] = np.minimum(np.log2(1 + words.counts) / 16, 1)
    for k in range(6):
        b = np.searchsorted(_BINS, shape[:, k])
        row, base = np.arange(n), WORDS + SYMBOLS + 12 * k
        out[row, base + b] = 1
        for side in (-1, 1):  # a soft edge between bins
            at = np.clip(b + side, 0, len(_BINS))
            out[row, base + at] = np.maximum(out[row, base + at], 0.4)
    return out


def _owners(runs: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The text of each distinct run in it."""
    order = np.lexsort((runs, of))
    r, o = runs[order], of[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (o[1:] != o[:-1])
    return o[new]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    votes: np.ndarray

    def latent(self, x: np.ndarray) -> np.ndarray:
        return unit(unit(x * self.weights) @ self.axes)

    def score(self, column: pa.Array, k: int = NEIGHBOURS) -> np.ndarray:
        x = self.latent(counts(column))
        cosine = x @ self.vectors.T
        k = min(k, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-3) ** 4 * self.votes[near]
        return np.clip((weight * self.labels[near]).sum(1) / weight.sum(1), 0, 1)


def decompose(x: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(7).standard_normal((x.shape[1], rank + 8)).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    small = x @ q
    _, _, vt = np.linalg.svd(small, full_matrices=False)
    return (q @ vt.T)[:, :rank].astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, work: Workspace, sample: int = SAMPLE, rank: int = RANK) -> Model | float:
    rows = sampled(docs, labels, "quality", work, sample)
    prior = labels.filter(F.col("quality").isin(0, 1) & ~held_out()).agg(F.avg("quality")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in W.slices(batch.column(0), 1 << 22, 256):
                x = counts(batch.column(0)[a:b]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(1)[a:b], pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "x"])

    got = rows.mapInArrow(run, "y int, x binary").toArrow()
    y = np.asarray(got.column("y"))
    if len(np.unique(y)) < 2:
        return float(prior) if prior is not None else 0.5
    x = np.empty((len(y), TERMS), np.float32)
    for i, b in enumerate(got.column("x")):
        x[i] = np.frombuffer(b.as_py(), np.float16)
    del got
    good, bad = (x[y == 1] > 0).mean(0), (x[y == 0] > 0).mean(0)
    lean = np.abs(np.log((good + 0.01) / (bad + 0.01)))
    rare = np.log((len(y) + 1) / ((x > 0).sum(0) + 1)) + 0.5
    weights = (rare * (0.05 + np.minimum(lean, 4) / 4)).astype(np.float32)
    weights[:WORDS] *= 0.25
    z = unit(x * weights)
    axes = decompose(z, rank)
    balance = (y == 1).mean()
    votes = np.where(y == 1, prior / balance, (1 - prior) / (1 - balance))
    return Model(weights, axes, unit(z @ axes), y.astype(np.float32), votes.astype(np.float32))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` plus score (0 to 1, higher is better) and predicted (1 from ``threshold``), for every row and whole text.

    At most ``sample`` labelled rows of either label, none held out, are used for fitting; of several labels of
    a document the largest counts.  Without labels of both kinds every score is the share of label 1 (0.5 if
    there are none).  Null and empty texts get the score of a text without words.  A text is scored whole, however
    long it is.  Columns are kept but for those called like the two new ones, which are replaced; ``names`` gives the
    new ones other names.
    """
    work = Workspace(docs.sparkSession, "quality")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, work, sample))
    fields = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    base = docs.select(*[F.col(f"`{c}`") for c in fields])
    schema = T.StructType([*base.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            for a, b in W.slices(text, 1 << 22, 512):
                known = model.value
                score = np.full(b - a, known) if isinstance(known, float) else known.score(text[a:b]).astype(float)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*part.schema.names, *names])

    return base.mapInArrow(run, schema)
