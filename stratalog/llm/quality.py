"""Quality rules: fixed base rules, and a logistic regression over hashed word and character n-grams.

The regression sees the relative frequency of each hashed word and of each hashed run of GRAM bytes. It is fitted in
one task from a bounded sample (labelled.PER_CLASS rows a class), calibrated to probabilities at the labels' own class
share, and broadcast (2 * DIMS weights). Scoring is one pass in Arrow batches without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.labelled import PER_CLASS, fitted, labelled_sample, platt, sigmoid
from stratalog.llm.textbytes import SPACE, U64, byte_sums, chunks, map_batches, mix, span_hash, spaced, utf8, words

DIMS = 1 << 17
GRAM = 4
STEPS = 80
#: A document is kept if its probability of good quality is at least this.
KEEP = 0.5
#: Base rules: fewest words, largest share of words in repeated windows, and the window's words.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 0.30, 8

# The characters counted as symbols.
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def features(text: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed words and hashed byte n-grams of a spaced chunk, each with where the documents' own begin."""
    s, e = words(text)
    word = (span_hash(byte_sums(text), s, e) & U64(DIMS - 1)).astype(np.int64)
    n = len(text)
    code = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        ahead = np.full(n, 32, dtype=np.uint8)
        ahead[: max(0, n - k)] = text[k:]
        for back in range(1, k + 1):  # a document's last grams see blanks, not the next document
            last = starts[1:] - back
            ahead[last[last >= 0]] = 32
        code = code * U64(257) + ahead
    gram = (mix(code) & U64(DIMS - 1)).astype(np.int64) + DIMS
    return [(word, np.searchsorted(s, starts)), (gram, starts)]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each document's sum, added up within the document, so that its neighbours don't change the rounding."""
    counts = np.diff(first)
    return np.bincount(np.repeat(np.arange(len(counts)), counts), values, len(counts))


@dataclass
class Regression:
    weight: np.ndarray
    offset: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = self.offset
        for ids, first in found:
            out = out + _sums(self.weight[ids], first) / np.maximum(np.diff(first), 1)
        return out

    def probability(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return sigmoid(self.slope * self.margins(found) + self.shift)


def fit(sample: pa.Table, share: float, seed: int = 11) -> Regression:
    """Full-batch Adam on four fifths of the sample, calibration on the rest."""
    model = Regression(np.zeros(2 * DIMS))
    y = sample["y"].to_numpy().astype(np.float64)
    if len(np.unique(y)) < 2:
        model.shift = float(np.log(max(share, 1e-4) / max(1 - share, 1e-4)))
        return model
    data, offs = utf8(sample["text"])
    ids, docs, values = [], [], []
    for i, j in chunks(offs):
        for found, first in features(*spaced(data, offs, i, j)):
            counts = np.diff(first)
            row = np.repeat(np.arange(i, j), counts)
            found = found[first[0] : first[0] + len(row)]
            key, times = np.unique(row.astype(np.int64) * (2 * DIMS) + found, return_counts=True)
            docs.append(key // (2 * DIMS))
            ids.append(key % (2 * DIMS))
            values.append(times / np.maximum(counts, 1)[docs[-1] - i])
    ids, docs, values = (np.concatenate(x) for x in (ids, docs, values))
    fold = np.random.default_rng(seed).random(len(y)) < 0.8
    pick = fold[docs]
    a_ids, a_docs, a_values = ids[pick], docs[pick], values[pick]
    weight = np.where(y == 1, 0.5 / max(y[fold].mean(), 1e-6), 0.5 / max(1 - y[fold].mean(), 1e-6)) * fold / fold.sum()
    first, second = np.zeros(2 * DIMS), np.zeros(2 * DIMS)
    o1 = o2 = 0.0
    for t in range(1, STEPS + 1):
        z = np.bincount(a_docs, model.weight[a_ids] * a_values, len(y)) + model.offset
        g = weight * (sigmoid(z) - y)
        grad = np.bincount(a_ids, g[a_docs] * a_values, 2 * DIMS) + 1e-8 * model.weight
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        o1, o2 = 0.9 * o1 + 0.1 * g.sum(), 0.99 * o2 + 0.01 * g.sum() ** 2
        fix1, fix2 = 1 - 0.9**t, 1 - 0.99**t
        model.weight -= 1.0 * (first / fix1) / (np.sqrt(second / fix2) + 1e-8)
        model.offset -= 0.05 * (o1 / fix1) / (np.sqrt(o2 / fix2) + 1e-8)
    z = np.bincount(docs, model.weight[ids] * values, len(y)) + model.offset
    held = ~fold if len(np.unique(y[~fold])) == 2 else np.ones(len(y), bool)
    model.slope, model.shift = platt(z[held], y[held], share)
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Regression:
    """Fit on labels.quality (1: good)."""
    return fitted(*labelled_sample(docs, labels, "quality", F.lit(True), per_class), fit)


def base_rules(text: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts behind the base rules for the documents of a spaced chunk."""
    s, e = words(text)
    first = np.searchsorted(s, starts)
    n_words = np.diff(first)
    count = lambda flag: np.add.reduceat(np.append(flag, False).astype(np.int64), starts[:-1]) if len(starts) > 1 else np.zeros(0, np.int64)
    chars = count(~SPACE[text] & ((text & 0xC0) != 0x80))
    symbols = count(_SYMBOL[text])
    sums = byte_sums(text)
    # lines: runs between newlines and document ends; one counts if it has a word and an equal one came before
    lines = np.union1d(np.flatnonzero(text == 0x0A) + 1, starts[:-1])
    ends = np.append(lines[1:], len(text)) - 1
    doc = np.searchsorted(starts, lines, side="right") - 1
    has = np.searchsorted(s, ends) > np.searchsorted(s, lines)
    has |= (np.searchsorted(e, lines, side="right") < np.searchsorted(e, ends, side="right"))
    doc, key = doc[has], span_hash(sums, lines[has], ends[has])
    order = np.lexsort((key, doc))
    again = (doc[order][1:] == doc[order][:-1]) & (key[order][1:] == key[order][:-1])
    dup = np.bincount(doc[order][1:][again], minlength=len(n_words))
    # windows of WINDOW words, within a document; words that lie in one found twice or more
    h = span_hash(sums, s, e)
    gram = np.zeros(len(h), dtype=np.uint64)
    for k in range(WINDOW):
        gram[: max(0, len(h) - k)] = mix(gram[: max(0, len(h) - k)] * U64(6364136223846793005) + h[k:])
    owner = np.repeat(np.arange(len(n_words)), n_words)
    ok = np.flatnonzero(np.arange(len(h)) + WINDOW <= first[1:][owner]) if len(h) else np.zeros(0, np.int64)
    order = ok[np.lexsort((gram[ok], owner[ok]))]
    same = (owner[order][1:] == owner[order][:-1]) & (gram[order][1:] == gram[order][:-1])
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = order[twice]
    cover = np.zeros(len(h) + WINDOW + 1, dtype=np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    inside = np.cumsum(cover)[: len(h)] > 0
    repeated = np.bincount(owner[inside], minlength=len(n_words))
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeated}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge_documents(docs: DataFrame, model: Regression, keep: float = KEEP) -> DataFrame:
    """All columns of docs plus the base counts, base_failed, quality (probability) and kept.

    A null text has no words and fails the base rules, as does an empty one; whole texts of any length are counted; columns of
    these names are replaced; repeated rows are judged alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = (*COUNTS, "base_failed", "quality", "kept")
    names = [c for c in docs.columns if c not in added]

    def run(batches) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offs = utf8(batch.column("text"))
            for i, j in chunks(offs):
                text, starts = spaced(data, offs, i, j)
                base = base_rules(text, starts)
                failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > round(100 * MOST_REPEATED) * base["n_words"])
                p = m.probability(features(text, starts))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(base[c], pa.int64()) for c in COUNTS), pa.array(failed), pa.array(p, pa.float64()), pa.array(~failed & (p >= keep))], [*names, *added])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names)
    return map_batches(docs.select(*names), run, fields + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, quality double, kept boolean")
