"""Toxicity by weak supervision.

1. Terms (whole words and word beginnings) that lean to toxic texts in a bounded sample of labelled rows make
   lexicons, chosen by greedy multi-cover: a term counts only as far as it reaches toxic texts that fewer than
   ``COVER`` chosen terms reach.
2. Each lexicon and each pattern (shouting, symbol noise, repetition, several hits, no hit) is a voter that says
   toxic, clean or nothing about labelled and unlabelled texts.  Word beginnings also meet harmless words: a single
   hit in more than ``CHANCE`` words counts as none.
3. A generative label model estimates by EM how often each voter is right, and the joint votes of the pairs of voters
   that go together given the label.  Annotators' labels are no voters: they start the model, and no more.
4. A linear classifier (ridge logistic regression) over the terms and patterns is trained on the posterior labels.

Scoring is one pass over the texts without a shuffle; the model it broadcasts holds ``TERMS`` terms at most.
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

SAMPLE = 3000
TERMS = 192
CANDIDATES = 1500
COVER = 3
LEXICONS = 16
#: Bytes of the word beginnings that are terms beside the whole word (0).
KINDS = (0, 4, 5, 6)
PATTERNS = 5
#: A single term in a text of more words than this may be there by chance, as word beginnings are.
CHANCE = 150
THRESHOLD = 0.5


def terms(words: W.Words, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each word, or of the first ``kind`` bytes of each longer word."""
    owner = words.owner()
    if kind:
        long = words.ends - words.starts > kind
        part = W.Words(words.data, words.starts[long], words.starts[long] + kind, words.first)
        return (W.mix(part.hashes(_LOWERED) + np.uint64(kind)), owner[long]) if long.any() else (np.zeros(0, np.uint64), owner[long])
    return words.hashes(_LOWERED), owner


_LOWERED = W._BYTE[W.LOWER]


def patterns(words: W.Words, texts: int) -> np.ndarray:
    """Per text: share of words in capitals, symbols to words (or to one), share of words equal to the one before, more than 0 words, number of words."""
    owner, n = words.owner(), np.maximum(words.counts, 1)
    out = np.zeros((texts, PATTERNS))
    lead, last = words.data[words.starts], words.data[words.ends - 1]
    capital = lambda b: (b >= 65) & (b <= 90)
    loud = capital(lead) & capital(last) & (words.ends - words.starts > 2)
    out[:, 0] = np.bincount(owner[loud], minlength=texts) / n
    symbol = np.isin(words.data, np.frombuffer(b"#$%&*|!<>{}", np.uint8))
    at = np.searchsorted(words.offsets, np.flatnonzero(symbol), side="right") - 1
    out[:, 1] = np.minimum(np.bincount(at, minlength=texts) / n, 3)
    h = words.hashes(_LOWERED)
    same = np.flatnonzero((h[1:] == h[:-1]) & (owner[1:] == owner[:-1])) + 1
    out[:, 2] = np.bincount(owner[same], minlength=texts) / n
    out[:, 3] = words.counts > 0
    out[:, 4] = words.counts
    return out


@dataclass
class Model:
    """Terms by kind (sorted hashes with their columns), and the classifier's weights."""

    kinds: dict[int, tuple[np.ndarray, np.ndarray]]
    n_terms: int
    weights: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        words = W.split(column, W.NOT_WORD)
        x = design(present(words, self.kinds, self.n_terms, len(column)), patterns(words, len(column)))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def present(words: W.Words, kinds: dict[int, tuple[np.ndarray, np.ndarray]], n: int, texts: int) -> np.ndarray:
    out = np.zeros((texts, n), np.float32)
    for kind, (hashes, column) in kinds.items():
        seen = np.zeros(1 << 16, bool)
        seen[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        h, owner = terms(words, kind)
        maybe = np.flatnonzero(seen[(h & np.uint64(0xFFFF)).astype(np.int64)])
        if not len(maybe):
            continue
        at = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
        hit = hashes[at] == h[maybe]
        out[owner[maybe[hit]], column[at[hit]]] = 1
    return out


def by_chance(hits: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Whether a text has a single term in many words."""
    return (hits.sum(1) == 1) & (shape[:, 4] > CHANCE)


def design(hits: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """What the classifier sees: terms, whether any, several or a chance one occur, terms to a hundred words, and the patterns."""
    n, chance = hits.sum(1), by_chance(hits, shape)
    dense = np.minimum(n / np.maximum(shape[:, 4] / 100, 1), 3)
    return np.column_stack([hits * ~chance[:, None], (n >= 1) & ~chance, n >= 2, chance, dense * ~chance, shape[:, :4]])


def by_kind(kind: np.ndarray, h: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    out = {}
    for k in np.unique(kind):
        at = np.flatnonzero(kind == k)
        at = at[np.argsort(h[at])]
        out[int(k)] = (h[at], at)
    return out


def paired(rest: np.ndarray, least: float = 0.25) -> list[tuple[int, ...]]:
    """Groups of one or two voters: those whose deviations go together most make pairs, each voter in one group."""
    n, m = rest.shape
    deviation = np.sqrt((rest**2).mean(0)) + 1e-9
    corr = np.abs(rest.T @ rest / n) / np.outer(deviation, deviation)
    free, out = np.ones(m, bool), []
    for i, j in sorted(((i, j) for i in range(m) for j in range(i) if corr[i, j] >= least), key=lambda x: (-corr[x], x)):
        if free[i] and free[j]:
            out.append((j, i))
            free[[i, j]] = False
    return out + [(int(i),) for i in np.flatnonzero(free)]


def label_model(votes: np.ndarray, prior: np.ndarray, start: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, list[tuple[int, ...]]]:
    """(posterior of label 1, share of right votes of each voter, groups of voters), by EM from ``start``.

    Votes are 1, -1 or 0 (none).  Given the label, voters are independent but for the pairs whose correlation is left
    over after a third of the rounds; these have a joint law of their nine outcomes.
    """
    n, m = votes.shape
    p = np.clip(start, 0.02, 0.98)
    groups: list[tuple[int, ...]] = [(j,) for j in range(m)]
    odds = np.log(prior / (1 - prior))
    for k in range(rounds):
        if k in (rounds // 3, 2 * rounds // 3):
            mean = [(votes * q[:, None]).sum(0) / q.sum() for q in (p, 1 - p)]
            groups = paired(votes - p[:, None] * mean[0] - (1 - p[:, None]) * mean[1])
        evidence = odds.copy()
        for g in groups:
            outcome = sum((votes[:, j] + 1) * 3**i for i, j in enumerate(g))
            law = [(np.bincount(outcome, weights=q, minlength=3 ** len(g)) + 0.5) / (q.sum() + 0.5 * 3 ** len(g)) for q in (p, 1 - p)]
            evidence += (np.log(law[0]) - np.log(law[1]))[outcome]
        p = np.clip(1 / (1 + np.exp(-np.clip(evidence, -30, 30))), 1e-4, 1 - 1e-4)
    said = np.maximum((votes != 0).sum(0), 1)
    right = ((votes == 1) * p[:, None] + (votes == -1) * (1 - p[:, None])).sum(0) / said
    return p, right, groups


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on soft labels by Newton steps; the bias is free."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x1.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (weight * (p - y)) + penalty * w
        h = (x1 * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x1 + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def voters(hits: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """The votes of the lexicons and patterns."""
    out, n, chance = [], hits.sum(1), by_chance(hits, shape)
    for k in range(min(LEXICONS, hits.shape[1])):
        out.append(((hits[:, k::LEXICONS].sum(1) > 0) & ~chance).astype(int))
    out.append((n >= 2).astype(int))
    out.append(np.where((n == 0) | chance, -1, 0))
    out.append(np.where(shape[:, 0] > 0.3, 1, np.where(shape[:, 0] == 0, -1, 0)))
    out.append(np.where(shape[:, 1] > 0.5, 1, np.where(shape[:, 1] == 0, -1, 0)))
    out.append(np.where(shape[:, 2] > 0.3, 1, 0))
    return np.column_stack(out)


def sampled(docs: DataFrame, labels: DataFrame, target: str, work: Workspace, most: int) -> DataFrame:
    """text and y of at most ``most`` labelled rows of either label that are not held out."""
    known = labels.filter(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    turn = F.xxhash64("doc_id")
    picked = known.filter("y = 1").orderBy(turn, "doc_id").limit(most).unionByName(known.filter("y = 0").orderBy(turn, "doc_id").limit(most))
    picked = work.keep(picked, "picked")  # 2 * most rows of 12 bytes
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "y")
    return work.keep(rows, "sample")


def unlabelled(docs: DataFrame, labels: DataFrame, work: Workspace, most: int) -> DataFrame:
    """text of at most ``most`` rows without a label that are not held out, by the hash of their ids."""
    free = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & ~held_out()).join(labels.select("doc_id"), "doc_id", "left_anti")
    picked = work.keep(free.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "free")  # ``most`` ids
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]).select("text", F.lit(-1).alias("y"))


def fit(docs: DataFrame, labels: DataFrame, work: Workspace, sample: int = SAMPLE) -> Model:
    rows = sampled(docs, labels, "toxic", work, sample)
    prior = labels.filter(F.col("toxic").isin(0, 1) & ~held_out()).agg(F.avg("toxic")).first()[0]
    prior = min(max(prior or 0.0, 0.01), 0.99)
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model({}, 0, np.zeros(design(np.zeros((1, 0)), np.zeros((1, PATTERNS))).shape[1]), float(np.log(prior / (1 - prior))))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.asarray(batch.column(1))
            for a, b in W.slices(batch.column(0), 1 << 22, 1024):
                words = W.split(batch.column(0)[a:b], W.NOT_WORD)
                for kind in KINDS:
                    h, owner = terms(words, kind)
                    own = unique_pairs(h, owner)
                    hs, at = np.unique(own[0], return_inverse=True)
                    one = np.bincount(at, weights=y[a:b][own[1]], minlength=len(hs)).astype(np.int64)
                    both = np.bincount(at, minlength=len(hs)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hs), kind, np.int32)), pa.array(hs.view(np.int64)), pa.array(one), pa.array(both - one)], names=["kind", "h", "one", "zero"])

    counts = rows.mapInArrow(counted, "kind int, h long, one long, zero long").groupBy("kind", "h").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero"))
    least = max(2, n1 // 400)
    rate1, rate0 = (F.col("one") + 0.1) / F.lit(float(n1)), (F.col("zero") + 0.5) / F.lit(float(n0))
    lean = F.log(rate1 / rate0)
    top = counts.filter((F.col("one") >= least) & (lean > 1.5)).orderBy((F.col("one") * lean).desc(), "kind", "h").limit(CANDIDATES).toPandas()
    kind, h = top["kind"].to_numpy(), top["h"].to_numpy(np.int64).view(np.uint64)
    kinds, n_terms = by_kind(kind, h), len(top)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in W.slices(batch.column(0), 1 << 22, 1024):
                words = W.split(batch.column(0)[a:b], W.NOT_WORD)
                x, shape = present(words, kinds, n_terms, b - a), patterns(words, b - a)
                yield pa.RecordBatch.from_arrays([batch.column(1)[a:b], pa.array([np.flatnonzero(r).tolist() for r in x], pa.list_(pa.int32())), pa.array(shape.tolist(), pa.list_(pa.float64()))], names=["y", "hits", "shape"])

    rows = rows.unionByName(unlabelled(docs, labels, work, sample))
    got = rows.mapInArrow(seen, "y int, hits array<int>, shape array<double>").toPandas()
    y, shape = got["y"].to_numpy(), np.array(got["shape"].tolist()).reshape(-1, PATTERNS)
    x = np.zeros((len(got), n_terms), np.float32)
    for i, hits in enumerate(got["hits"]):
        x[i, list(hits)] = 1
    chosen = multi_cover(x[y >= 0], y[y >= 0], least)
    x = x[:, chosen]
    votes, known = voters(x, shape), y >= 0
    balance = n1 / (n1 + n0)
    start = np.where(known, np.where(y == 1, 0.95, 0.05), np.where((votes == 1).sum(1) > 0, 0.5, prior))
    posterior, _, _ = label_model(votes, np.where(known, balance, prior), start)
    # labelled rows count by their label's share of all labels, not of the sample
    back = np.where(known, np.where(y == 1, prior / balance, (1 - prior) / (1 - balance)), 1.0)
    weights, bias = logistic(design(x, shape), posterior, back)
    return Model(by_kind(kind[chosen], h[chosen]), len(chosen), weights, bias)


def unique_pairs(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((owner, h))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], owner[new]


def multi_cover(x: np.ndarray, y: np.ndarray, least: int) -> np.ndarray:
    """Columns that reach positive rows again and again, best first, less what they hit wrongly."""
    one, wrong = x[y == 1], x[y == 0].sum(0)
    need, chosen = np.full(len(one), COVER), []
    free = np.ones(x.shape[1], bool)
    while len(chosen) < TERMS and free.any():
        gain = np.where(free, (need > 0).astype(np.float32) @ one - 2 * wrong, -1)
        j = int(np.argmax(gain))
        if gain[j] < least:
            break
        chosen.append(j)
        free[j] = False
        need = need - one[:, j].astype(int)
    return np.array(chosen, int)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` plus score (0 to 1) and predicted (1 from ``threshold``), for every row and whole text.

    At most ``sample`` labelled rows of either label and as many unlabelled ones, none held out, are used for fitting;
    of several labels of a document the largest counts.  Without labels of both kinds the score is the share of label 1 (0.01
    if there are none).  Null and empty texts get the score of a text without words.  A text is scored whole, however
    long it is.  Columns are kept but for those called like the two new ones, which are replaced; ``names`` gives the
    new ones other names.
    """
    work = Workspace(docs.sparkSession, "toxicity")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, work, sample))
    fields = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    base = docs.select(*[F.col(f"`{c}`") for c in fields])
    schema = T.StructType([*base.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            for a, b in W.slices(text):
                score = model.value.score(text[a:b])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*part.schema.names, *names])

    return base.mapInArrow(run, schema)
