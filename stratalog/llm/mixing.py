"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A source's documents, in a hashed order, form blocks. With weight w = n / SLOTS, block i (from 0) is released at slot
floor(i / w) and due by slot ceil((i + 1) / w). Earliest deadline first over the released blocks meets every deadline, so
after any number of slots each source is less than one block from its share. Weights are whole numbers over a common total,
so the schedule repeats after `total` slots; that one round, whose length is a parameter, is worked out on the
driver, and each block's slot follows from its number.

Numbering a source's documents doesn't put a source into one task: documents are ranked within (source, bin), the bins
being the leading digits of a hash of the id, and the bins' counts (BINS a source at most) are summed up before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalog.llm.textbytes import unused

#: Documents of a block.
BLOCK = 16
#: Leading hexadecimal digits of the hash that make a bin.
BIN_DIGITS = 3
#: The name in the weights that stands for every source that they don't list, null included.
OTHER = "*"


def round_of_slots(weights: dict[str, int]) -> list[str]:
    """One round: the source of each slot, by earliest deadline among the released blocks; ties go to the first name."""
    total = sum(weights.values())
    done = dict.fromkeys(sorted(weights), 0)
    slots = []
    for t in range(total):
        ready = [(-(-(k + 1) * total // weights[s]), s) for s, k in done.items() if weights[s] and k < weights[s] and k * total // weights[s] <= t]
        _, s = min(ready)
        done[s] += 1
        slots.append(s)
    return slots


def _listed(weights: dict[str, int], source: Column) -> Column:
    names = sorted(set(weights) - {OTHER})
    return F.when(source.isin(names), source).otherwise(OTHER) if OTHER in weights else source


def schedule(docs: DataFrame, weights: dict[str, int], block: int = BLOCK) -> DataFrame:
    """All columns of docs plus group, block, release, deadline, slot and position (slot * block size + place in block).

    docs: doc_id, source, text and others. weights: source -> whole number, OTHER for the rest; each source met must be covered.
    Every row is placed, also of sources that run out later or earlier than others: a source that has run out leaves its slots empty, so that up
    to the slot at which the first source runs out, each is less than a block from its share; later on, this holds among those that are left.
    Nulls: a null source belongs to OTHER; rows without an id are ordered by their texts, a null text is empty. Repeated rows get places of their
    own. An empty table gives an empty result. Columns of the added names are replaced, all others stay.
    """
    added = ("group", "block", "release", "deadline", "slot", "position")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    if OTHER not in weights:
        raise ValueError(f"weights need an entry {OTHER!r} for the sources that they do not list")
    total = sum(weights.values())
    o_, t_, b_, n_, p_, r_, i_, w_ = unused(docs, "order", "text_md5", "bin", "n", "before", "rank", "index", "weight")
    own = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.withColumns({"group": _listed(weights, F.col("source")), o_: F.md5(F.coalesce(F.col("doc_id").cast("string"), own)), t_: own}).withColumn(b_, F.substring(o_, 1, BIN_DIGITS))
    counts = rows.groupBy("group", b_).agg(F.count("*").alias(n_))
    before = counts.withColumn(p_, F.coalesce(F.sum(n_).over(W.partitionBy("group").orderBy(b_).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop(n_)
    ranked = rows.withColumn(r_, F.row_number().over(W.partitionBy("group", b_).orderBy(o_, t_)))
    placed = ranked.join(before, ["group", b_]).withColumn(i_, F.col(p_) + F.col(r_) - 1)
    weight = F.element_at(F.create_map(*[F.lit(x) for s in sorted(weights) for x in (s, weights[s])]), F.col("group")).cast("long")
    slots = {s: [t for t, owner in enumerate(round_of_slots(weights)) if owner == s] for s in sorted(weights)}
    table = F.create_map(*[x for s, own in slots.items() for x in (F.lit(s), F.array(*map(F.lit, own)))])
    placed = placed.withColumns({"block": F.expr(f"{i_} div {block}"), w_: weight})
    placed = placed.withColumn("slot", F.expr(f"block div {w_}") * total + F.element_at(F.element_at(table, F.col("group")), (F.col("block") % F.col(w_) + 1).cast("int")))
    placed = placed.withColumns({"release": F.expr(f"block * {total} div {w_}"), "deadline": F.expr(f"((block + 1) * {total} + {w_} - 1) div {w_}"), "position": F.col("slot") * block + F.col(i_) % block})
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], *added)


def mix(docs: DataFrame, weights: dict[str, int], block: int = BLOCK) -> DataFrame:
    """docs, whole, ordered by their places in the mix."""
    return schedule(docs, weights, block).orderBy("position").select(*[F.col(f"`{c}`") for c in docs.columns])
