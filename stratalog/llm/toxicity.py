"""Toxicity scores from a convolutional text classifier trained in numpy.

A word's embedding is the sum of two hashed ones, of the whole word and of its first STEM bytes; filters of several widths slide over them, each keeps its
largest response in the whole text, and a logistic unit weighs these. Scores are calibrated to probabilities
at the labels' own class share; the threshold for rejecting is calibrated by language.

The model is fitted in one task from a bounded sample (labelled.PER_CLASS rows a class) and broadcast
(BUCKETS entries plus the embeddings of the sample's words). Scoring is one pass over the rows without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.labelled import PER_CLASS, fitted, labelled_sample, platt, sigmoid
from stratalog.llm.textbytes import LOWER, U64, byte_sums, chunks, map_batches, mix, span_hash, spaced, utf8

BUCKETS = 1 << 21
WIDTHS = (1, 2, 3)
FILTERS = 8
SIZE = 12
STEM = 5
EPOCHS = 6
#: Small samples are gone through more often.
LEAST_STEPS = 500
#: A language's own threshold needs so many calibration rows of each class; others use the common one.
LEAST_ROWS = 12
#: Thresholds are kept within these limits.
LIMITS = (0.5, 0.9)

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def buckets(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The two buckets of each word of a chunk's texts, and where each text's words start."""
    for i, j in chunks(offs):
        text, starts = spaced(data, offs, i, j)
        text = LOWER[text]
        edge = np.flatnonzero(np.diff(_LETTER[text], prepend=False, append=False))
        s, e = edge[0::2], edge[1::2]
        sums = byte_sums(text)
        whole, stem = span_hash(sums, s, e), mix(span_hash(sums, s, np.minimum(e, s + STEM)) + U64(1))
        yield (np.stack([whole, stem], axis=1) % U64(BUCKETS)).astype(np.int32), np.searchsorted(s, starts)


def _padded(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other with enough zeros (the unknown word) between that no filter spans two."""
    pad = max(WIDTHS) - 1
    counts = np.diff(first)
    starts = first[:-1] + np.arange(len(counts)) * (pad + 1)
    out = np.zeros((int(counts.sum()) + len(counts) * (pad + 1) + pad, 2), dtype=np.int64)
    out[np.repeat(starts - first[:-1], counts) + np.arange(len(ids))] = ids
    return out, starts


@dataclass
class TextCnn:
    """Embeddings (row 0: unknown, always zero), filters, weights; `row` maps buckets to embeddings."""

    row: np.ndarray
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    weight: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.7

    def tables(self) -> list[tuple[int, list[np.ndarray]]]:
        """Each word's contribution to each filter at each place: embeddings times filters, once for all."""
        return [(w, [np.ascontiguousarray(self.embedding @ f).astype(np.float32) for f in self.filters[w]]) for w in WIDTHS]

    def margins(self, data: np.ndarray, offs: np.ndarray, tables=None) -> np.ndarray:
        tables, out = tables or self.tables(), []
        for ids, first in buckets(data, offs):
            seq, starts = _padded(self.row[ids], first)
            pooled = []
            for w, parts in tables:
                n = len(seq) - max(WIDTHS) + 1
                total = parts[0][seq[:n, 0]]
                total += parts[0][seq[:n, 1]]
                for k in range(1, w):
                    total += parts[k][seq[k : k + n, 0]]
                    total += parts[k][seq[k : k + n, 1]]
                pooled.append(np.maximum(np.maximum.reduceat(total, starts, axis=0) + self.bias[w], 0))
            out.append(np.concatenate(pooled, axis=1) @ self.weight + self.offset)
        return np.concatenate(out) if out else np.zeros(0)

    def scores(self, data: np.ndarray, offs: np.ndarray, tables=None) -> np.ndarray:
        return sigmoid(self.slope * self.margins(data, offs, tables) + self.shift)


def fit(sample: pa.Table, share: float, seed: int = 7) -> TextCnn:
    """Train on four fifths of the sample, calibrate on the rest. Without both classes, the score is the share."""
    rng = np.random.default_rng(seed)
    y = sample["y"].to_numpy().astype(np.float64)
    data, offs = utf8(sample["text"])
    parts = list(buckets(data, offs))
    texts = [ids[a:b] for ids, first in parts for a, b in zip(first[:-1], first[1:])]
    del parts
    seen = np.zeros(BUCKETS, dtype=np.int32)
    for t in texts:
        seen[np.unique(t)] += 1
    used = np.flatnonzero(seen > 1)
    row = np.zeros(BUCKETS, dtype=np.int32)
    row[used] = np.arange(1, len(used) + 1)
    model = TextCnn(
        row, np.vstack([np.zeros((1, SIZE)), rng.normal(0, 0.1, (len(used), SIZE))]), {w: rng.normal(0, 0.3, (w, SIZE, FILTERS)) for w in WIDTHS}, {w: np.full(FILTERS, 0.05) for w in WIDTHS}, rng.normal(0, 0.3, len(WIDTHS) * FILTERS), 0.0
    )
    if len(np.unique(y)) < 2:
        model.weight[:], model.shift = 0, float(np.log(max(share, 1e-4) / max(1 - share, 1e-4)))
        return model
    fold = rng.random(len(y)) < 0.8
    rows, held = np.flatnonzero(fold), np.flatnonzero(~fold)
    seqs = [row[t] for t in texts]
    del texts, seen
    heat = {"e": np.full(model.embedding.shape, 1e-6), "w": np.full(model.weight.shape, 1e-6), "o": 1e-6} | {("f", w): np.full(model.filters[w].shape, 1e-6) for w in WIDTHS} | {("b", w): np.full(FILTERS, 1e-6) for w in WIDTHS}
    balance = np.where(y == 1, 0.5 / max(y[rows].mean(), 1e-6), 0.5 / max(1 - y[rows].mean(), 1e-6))
    rate = 0.08
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * 32 // max(1, len(rows))))):
        rng.shuffle(rows)
        for k in range(0, len(rows), 32):
            _step(model, [seqs[i] for i in rows[k : k + 32]], y[rows[k : k + 32]], balance[rows[k : k + 32]], heat, rate)
    model.embedding[0] = 0
    held = held if len(np.unique(y[held])) == 2 else np.arange(len(y))
    every = model.margins(data, offs)
    model.slope, model.shift = platt(every[held], y[held], share)
    score = sigmoid(model.slope * every[held] + model.shift)
    language = sample["lang"].to_numpy(zero_copy_only=False)[held]
    weight = np.where(y[held] == 1, share / max(y[held].mean(), 1e-6), (1 - share) / max(1 - y[held].mean(), 1e-6))
    model.threshold = _best(score, y[held], weight)
    for name in {x for x in language if x is not None}:
        own = language == name
        if min(y[held][own].sum(), (1 - y[held][own]).sum()) >= LEAST_ROWS:
            model.thresholds[name] = _best(score[own], y[held][own], weight[own])
    return model


def _best(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The threshold of the best F1, in the middle of the gap between scores."""
    order = np.argsort(-score)
    hit, all_ = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (all_ + (weight * y).sum())
    k = int(np.argmax(f1))
    below = score[order][k + 1] if k + 1 < len(order) else 0.0
    return float(np.clip((score[order][k] + below) / 2, *LIMITS))


def _step(m: TextCnn, seqs: list[np.ndarray], y: np.ndarray, balance: np.ndarray, heat: dict, rate: float) -> None:
    """One Adagrad step; through a maximum, the gradient reaches the place that gave it only."""
    first = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    seq, starts = _padded(np.concatenate(seqs), first)
    n, ends = len(seq) - max(WIDTHS) + 1, np.append(starts[1:], len(seq) - max(WIDTHS) + 1)
    x = m.embedding[seq].sum(axis=1)
    places, pooled = {}, {}
    for w in WIDTHS:
        total = sum(x[k : k + n] @ m.filters[w][k] for k in range(w))
        places[w] = np.array([a + total[a:b].argmax(axis=0) for a, b in zip(starts, ends)])
        pooled[w] = np.maximum(np.take_along_axis(total, places[w], axis=0) + m.bias[w], 0)
    z = np.concatenate([pooled[w] for w in WIDTHS], axis=1)
    g = balance * (sigmoid(z @ m.weight + m.offset) - y) / len(y)
    back = np.outer(g, m.weight)

    def move(key, value, grad):
        heat[key] += grad * grad
        value -= rate * grad / np.sqrt(heat[key])

    changes = []
    for i, w in enumerate(WIDTHS):
        d = back[:, i * FILTERS : (i + 1) * FILTERS] * (pooled[w] > 0)
        grad = np.empty_like(m.filters[w])
        for k in range(w):
            at = seq[places[w] + k]
            vectors = m.embedding[at].sum(axis=2)
            grad[k] = np.einsum("bf,bfs->sf", d, vectors)
            changes.append((at.ravel(), np.repeat((d[:, :, None] * m.filters[w][k].T[None]).reshape(-1, SIZE), 2, axis=0)))
        move(("f", w), m.filters[w], grad)
        move(("b", w), m.bias[w], d.sum(axis=0))
    ids = np.concatenate([a for a, _ in changes])
    known, inverse = np.unique(ids, return_inverse=True)
    grad = np.zeros((len(known), SIZE))
    np.add.at(grad, inverse, np.concatenate([v for _, v in changes]))
    heat["e"][known] += grad * grad
    m.embedding[known] -= rate * grad / np.sqrt(heat["e"][known])
    m.embedding[0] = 0
    move("w", m.weight, z.T @ g + 1e-4 * m.weight)
    heat["o"] += g.sum() ** 2
    m.offset -= rate * g.sum() / np.sqrt(heat["o"])


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id's text leaves 1 by 3."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> TextCnn:
    """Fit on rows that are not held out; labels.toxic is the target."""
    return fitted(*labelled_sample(docs, labels, "toxic", ~held_out(), per_class), fit)


def score_documents(docs: DataFrame, model: TextCnn) -> DataFrame:
    """All columns of docs plus `score` (0 to 1) and `rejected` (score at or over its language's threshold).

    The score depends on the text alone. A null text is empty; empty texts get the model's base score; a language that is null or
    unknown has the common threshold; columns named score or rejected are replaced. Repeated rows score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("score", "rejected")]

    def run(batches) -> Iterator[pa.RecordBatch]:
        m = shared.value
        tables = m.tables()
        for batch in batches:
            score = m.scores(*utf8(batch.column("text")), tables)
            limit = np.array([m.thresholds.get(x, m.threshold) for x in batch.column("lang").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score, pa.float64()), pa.array(score >= limit, pa.bool_())], [*names, "score", "rejected"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return map_batches(docs.select(*names), run, f"{fields}, score double, rejected boolean")
