"""Bounded labelled samples and probability calibration, for the trained operators."""

from __future__ import annotations

import contextlib
import ctypes
import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.textbytes import map_batches

#: Rows of each class that a model is fitted on, at most; they are those of the smallest hashed doc_id.
PER_CLASS = 3000
#: Longest text, in characters, that is used for fitting. (Scoring takes whole texts of any length.)
FIT_CHARS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, usable: Column, per_class: int = PER_CLASS) -> tuple[DataFrame, float]:
    """At most per_class rows of each class (doc_id, text, lang, y) among those short enough, and the share of class 1 among all usable labels.

    Labels that are null or not 0/1 are left out; of several texts with one id the least is taken; without labels or documents the sample is empty. The sample is
    the same whatever the partitioning.
    """
    known = labels.select("doc_id", F.col(target).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).where(usable)
    total = known.agg(F.count("*"), F.sum("y")).first()
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang")).where(F.length("text") <= FIT_CHARS)
    there, chosen = known.join(text.select("doc_id"), "doc_id", "left_semi").distinct(), None
    for y in (0, 1):
        part = there.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    found = text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("text", "lang")).alias("t"))  # the broadcast has 2 * per_class rows at most, and so has the result
    return found.select("doc_id", "t.text", "t.lang", "y"), (total[1] or 0) / max(1, total[0])


def fitted(sample: DataFrame, share: float, fit: Callable):
    """The model that fit(rows, share) makes of the sample, in one task: its rows, features and gradients stay out of the driver, which gets the model."""
    sample = sample.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", F.col("y").cast("int").alias("y"))
    schema = pa.schema([("doc_id", pa.string()), ("text", pa.string()), ("lang", pa.string()), ("y", pa.int32())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([b.cast(schema) for b in batches], schema).sort_by([("doc_id", "ascending"), ("y", "ascending")])
        made = zlib.compress(pickle.dumps(fit(rows, share)), 1)
        del rows
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([made])], ["model"])

    made = map_batches(sample.coalesce(1), run, "model binary").collect()
    return pickle.loads(zlib.decompress(made[0]["model"])) if made else fit(schema.empty_table(), share)


def give_back() -> None:
    """Return freed memory to the system, as far as the C library can: the worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def platt(margin: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities at the class share of all labels."""
    if len(np.unique(y)) < 2:
        return 1.0, 0.0
    share = min(max(share, 1e-3), 1 - 1e-3)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    soft = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    scale = max(float(np.std(margin)), 1e-6)
    x = margin / scale
    a, b = 1.0, float(np.log(share / (1 - share)))
    for _ in range(60):  # Newton's method with a small ridge
        p = sigmoid(a * x + b)
        g = weight * (p - soft)
        h = weight * p * (1 - p) + 1e-9
        ga, gb = (g * x).sum() + 1e-2 * a, g.sum()
        haa, hab, hbb = (h * x * x).sum() + 1e-2, (h * x).sum(), h.sum() + 1e-6
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 4.0 / max(abs(da), abs(db), 1e-12))
        a, b = a - step * da, b - step * db
        if max(abs(da), abs(db)) < 1e-8:
            break
    return a / scale, b
