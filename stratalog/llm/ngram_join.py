"""N-gram Jaccard self-join by token-combination prefixes.

A document is the set of its distinct word shingles. Two sets of similarity t or more share, under
any fixed order of the tokens, a token within their prefixes of p = n - ceil(t n) + 1, and m of them within
m - 1 more. In the order, rare tokens come before frequent ones. Rare tokens of the prefix are indexed one by one. Frequent
ones would make long posting lists and are indexed as pairs. If the least shared token is frequent, all shared ones are, and the m least
of them lie in both extended prefixes with p - 1 others between them at most; so two neighbours among them stand close together in both
sets (see pair_gap), and pairs at that distance suffice: their number grows with p, not with its square.
What meets in the index is then verified exactly.

Scale: equal sets are folded into one class first, whatever their number. A posting list is not
expanded into pairs: its members are compared with one leader, and lists that then still span several
components get further leaders, a growing number a round, until each list lies in one component or all
its pairs have been compared. No list is cut. The frequent-token table has a proven size (FREQUENT_MAX).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalog.llm.components import connected_components
from stratalog.llm.textbytes import LOWER, U64, byte_sums, chunks, list_column, map_batches, mix, signed, span_hash, spaced, utf8, words
from stratalog.llm.suffix_dedup import _bitmap, _marked
from stratalog.session import scratch, settled, staged

#: The most tokens that can be classed as frequent; the threshold rises with the corpus to keep to it.
FREQUENT_MAX = 1 << 20
#: Parities of the numbers of a set's tokens by their last bits, a bit each: a token that only one of two sets has changes one bit, so where sketches
#: differ in more bits than linked sets may in tokens, the pair is no link and is not made. Used in lists longer than SKETCHED.
SKETCH, SKETCHED = 512, 32
#: Members of a list that one task compares with the list's leaders.
SPLIT = 256
#: Counters of word frequencies; words share them by hash, so errors are relative to the corpus at any size.
WORD_COUNTERS = 1 << 16


def _count_words(batches):
    """How often each counter's words occur in a partition."""
    total = np.zeros(WORD_COUNTERS, dtype=np.int64)
    for batch in batches:
        data, offs = utf8(batch.column("text"))
        for i, j in chunks(offs):
            text = LOWER[spaced(data, offs, i, j)[0]]
            total += np.bincount((span_hash(byte_sums(text), *words(text)) >> U64(48)).astype(np.int64), minlength=WORD_COUNTERS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["counter", "n"])


def word_commonness(rows: DataFrame) -> np.ndarray:
    """A level for each counter: 0 for the rarest words, one more for each doubling of the frequency, 20 at most."""
    found = map_batches(rows.select("text"), _count_words, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()  # WORD_COUNTERS rows at most
    counts = np.ones(WORD_COUNTERS)
    counts[found.column("counter").to_numpy()] = found.column("n").to_numpy()
    share = counts / counts.sum()
    return np.clip(np.floor(np.log2(share * WORD_COUNTERS * 16)), 0, 20).astype(np.uint64)


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int, common: np.ndarray) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its lower-cased `width`-word shingles.

    A hash's six top bits tell how common the shingle's words are, so the order is from rare to common.
    """
    for i, j in chunks(offs):
        text, starts = spaced(data, offs, i, j)
        text = LOWER[text]
        s, e = words(text)
        h = span_hash(byte_sums(text), s, e)
        first = np.searchsorted(s, starts)
        gram = np.full(len(h), 0x5851F42D4C957F2D, dtype=np.uint64)
        for k in range(width):
            gram[: max(0, len(h) - k)] = mix(gram[: max(0, len(h) - k)] * U64(6364136223846793005) + h[k:])
        level = common[(h >> U64(48)).astype(np.int64)]
        total = sum(level[k : len(h) - width + 1 + k] for k in range(width)) if len(h) >= width else level[:0]
        gram[: len(total)] = (gram[: len(total)] >> U64(6)) | (np.minimum(total, U64(63)) << U64(58))
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= width:
                yield np.unique(gram[a : b - width + 1])
            elif b > a:
                short = np.zeros(1, np.uint64)
                for x in h[a:b]:
                    short = mix(short * U64(6364136223846793005) + x + U64(1))
                yield mix(short + U64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def set_id(tokens: np.ndarray) -> int:
    """A 64-bit id of a set; 0 only for the empty one."""
    if not len(tokens):
        return 0
    total = mix(tokens).sum(dtype=np.uint64) + U64(len(tokens))
    return int(signed(mix(mix(np.array([total])) ^ mix(np.array([np.bitwise_xor.reduce(tokens) ^ U64(0x243F6A8885A308D3)]))))[0]) or 1


def least_overlap(n: int, percent: int) -> int:
    """ceil(t n): the fewest tokens that a set of n shares with any set linked to it."""
    return -(-percent * n // 100)


def prefix_of(n, percent: int):
    """For sets of n tokens: the prefix p that holds a token of each linked set, and the m least shared tokens that are looked at."""
    need = least_overlap(n, percent)
    return n - need + 1, np.maximum(np.minimum(need, 2), np.minimum(n - need + 1, need))


@lru_cache(maxsize=1 << 16)
def pair_gap(n: int, percent: int) -> tuple[int, bool]:
    """How far apart, in the extended prefix, the nearest two of the m least tokens shared with any linked set can stand in either set.

    Between the m tokens stand at most p - 1 others in each set, so that some neighbours have (p + p' - 2) / (m - 1) or fewer between
    them in both sets together. The second value says that some linked set may share one token only, which makes no pair.
    """
    p, m = prefix_of(n, percent)
    others = np.arange(max(1, least_overlap(n, percent)), 100 * n // percent + 1)
    q, k = prefix_of(others, percent)
    both = np.minimum(m, k)
    paired = both > 1
    return 1 + int(((p + q - 2)[paired] // (both - 1)[paired]).max(initial=0)), not paired.all()


def linkable(n: int, percent: int) -> bool:
    """Whether a set of n can be linked to a set other than itself; the easiest such set has it and one token more."""
    return 100 * n >= percent * (n + 1)


def _scan(common, width: int, percent: int):
    """Every row's set size and id, and its prefix under the plain hash order."""

    def run(batches):
        for batch in batches:
            n, kid, flat, counts = [], [], [], []
            for u in shingle_sets(*utf8(batch.column("text")), width, common.value):
                n.append(len(u))
                kid.append(set_id(u))
                p = u[: prefix_of(len(u), percent)[0]] if linkable(len(u), percent) else u[:0]
                flat.append(p)
                counts.append(len(p))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tkey"), pa.array(n, pa.int64()), pa.array(kid, pa.int64()), list_column(signed(np.concatenate(flat) if flat else np.zeros(0, np.uint64)), np.array(counts, np.int64))],
                ["doc_id", "tkey", "n", "kid", "prefix"],
            )

    return run


def index_keys(u: np.ndarray, known: np.ndarray, percent: int) -> np.ndarray:
    """The keys of a sorted set: rare tokens of the prefix singly, frequent ones (known) of the extended prefix as pairs."""
    late = np.zeros(len(u), dtype=bool)
    if len(known):
        late = known[np.minimum(np.searchsorted(known, u), len(known) - 1)] == u
    p, m = prefix_of(len(u), percent)
    rare = u[~late]
    keys = [rare[:p]]
    if len(rare) < p:
        gap, single = pair_gap(len(u), percent)
        left = u[late][: p + int(m) - 1 - len(rare)]
        keys += [mix(left[:-d] * U64(3) + mix(left[d:])) for d in range(1, min(gap, len(left) - 1) + 1)]
        if single:
            keys.append(left[: p - len(rare)])
    return np.concatenate(keys)


def sketch_of(u: np.ndarray) -> np.ndarray:
    """A set's sketch, 64 bits a number."""
    return np.packbits(np.bincount((u & U64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).view(np.int64)


def _index_keys(common, frequent, width: int, percent: int):
    """Each linkable set's id, size, sketch and index keys."""

    def run(batches):
        known = frequent.value
        for batch in batches:
            n, kid, flat, sketch = [], [], [], []
            for u in shingle_sets(*utf8(batch.column("text")), width, common.value):
                if not linkable(len(u), percent):
                    continue
                flat.append(index_keys(u, known, percent))
                n.append(len(u))
                kid.append(set_id(u))
                sketch.append(sketch_of(u))
            yield pa.RecordBatch.from_arrays(
                [pa.array(kid, pa.int64()), pa.array(n, pa.int64()), pa.array(sketch, pa.list_(pa.int64())), list_column(signed(np.concatenate(flat) if flat else np.zeros(0, np.uint64)), np.array([len(x) for x in flat], np.int64))],
                ["kid", "n", "sketch", "keys"],
            )

    return run


def _whole_sets(common, width: int):
    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(*utf8(batch.column("text")), width, common.value))
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_id(u) for u in sets], pa.int64()), list_column(signed(np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.array([len(u) for u in sets], np.int64))], ["kid", "tokens"]
            )

    return run


def ngram_components(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """Link documents whose shingle sets have Jaccard similarity of percent/100 or more.

    docs: doc_id, text and any other columns (ignored). Returns per row doc_id, n_shingles,
    component_id, the smallest doc_id reachable by links, text_key, the text's hash, and component_key, which tells components apart
    also where ids are null or repeated. A null or wordless text is empty and linked with
    nothing; a text of fewer words than `width` is one shingle; repeated rows are linked copies; a null doc_id stays
    null and takes the smallest non-null id of its component. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = rows.withColumn("tkey", F.xxhash64("text"))
    common = spark.sparkContext.broadcast(word_commonness(rows))
    with scratch(spark) as temp:
        full = temp(map_batches(keyed, _scan(common, width, percent), "doc_id long, tkey long, n long, kid long, prefix array<long>"), "prefixes")
        scan = staged(full.drop("prefix"), "sets")
        frequent = _frequent(full, temp)
    classes = scan.where("n > 0").groupBy("kid").agg(F.min("doc_id").alias("low"), F.min("tkey").alias("tkey"))
    roots = settled(spark, "roots", lambda: _roots(rows, classes, frequent, common, width, percent), 16)
    joined = classes.select("kid", "low").join(roots, "kid", "left").withColumn("root", F.coalesce("root", "kid"))
    owner = joined.join(joined.groupBy("root").agg(F.min("low").alias("least")), "root").select("kid", "root", F.col("least").alias("low"))
    found = scan.join(owner, "kid", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc_id")).alias("component_id"), F.col("tkey").alias("text_key"), F.coalesce("root", "tkey").alias("component_key"))


def _frequent(scan: DataFrame, temp) -> np.ndarray | None:
    """The tokens that stand in many prefixes, in order, FREQUENT_MAX at most; None if no set can be linked to another."""
    size = scan.agg(F.sum(F.size("prefix"))).first()[0] or 0
    if not size:
        return None
    least = max(16, -(-size // FREQUENT_MAX))
    counts = scan.select(F.explode("prefix").alias("token")).groupBy("token").count().where(F.col("count") > least)
    return np.sort(temp(counts.select("token"), "frequent", 16).toArrow().column("token").to_numpy().view(np.uint64))


def _roots(rows: DataFrame, classes: DataFrame, frequent: np.ndarray | None, common, width: int, percent: int) -> DataFrame:
    """(kid, root) of the classes that links connect with others."""
    spark = rows.sparkSession
    if frequent is None:
        return spark.createDataFrame([], "kid long, root long")
    keys = map_batches(rows.select("text"), _index_keys(common, spark.sparkContext.broadcast(frequent), width, percent), "kid long, n long, sketch array<long>, keys array<long>")
    with scratch(spark) as temp:
        index = temp(keys.groupBy("kid").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys")), "index")
        sets = staged(index.drop("keys"), "sketches")
        own = W.partitionBy("key")  # both ends of a list from one shuffle of the index
        ends = index.select("kid", F.explode("keys").alias("key")).select("kid", F.min("kid").over(own).alias("head"), F.max("kid").over(own).alias("last"))
        lists = staged(ends.where("head <> last").select(F.col("head").alias("key"), "kid").distinct(), "lists")  # lists of one leader are gone through together
    alike = f"100 * least(n, an) >= {percent} * greatest(n, an)"
    tried = lists.where("kid <> key").select(F.col("key").alias("a"), F.col("kid").alias("b"))
    apart = "aggregate(zip_with(sketch, asketch, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    near = f"coalesce({100 + percent} * {apart} <= {100 - percent} * (n + an), true)"  # else too many tokens differ

    def links(pairs: DataFrame) -> DataFrame:
        """The pairs that are linked: sketches rule out most of the others, whole sets decide."""
        a = sets.select(F.col("kid").alias("a"), F.col("n").alias("an"), F.col("sketch").alias("asketch"))
        with scratch(spark) as temp:
            left = temp(pairs.join(sets.select(F.col("kid").alias("b"), "n", "sketch"), "b").join(a, "a").where(alike).where(near).select("a", "b"), "near", 4)
            wanted = temp(left.select(F.col("a").alias("kid")).union(left.select("b")).distinct().join(classes, "kid").select(F.col("tkey").alias("digest")).distinct(), "wanted", 16)
            texts = map_batches(rows.select(F.xxhash64("text").alias("digest"), "text"), _marked(_bitmap(wanted)), "digest long, text string").join(wanted, "digest").dropDuplicates(["digest"])
            tokens = temp(map_batches(texts.select("text"), _whole_sets(common, width), "kid long, tokens array<long>").dropDuplicates(["kid"]), "tokens")
            return staged(_verified(left, tokens, percent), "links", 4)

    edges = links(tried)
    # lists that lie in several components still may hold links that the leaders did not show
    groups = staged(lists.join(lists.groupBy("key").agg(F.count("*").alias("m")), "key"), "groups", 4)
    # a member's place in a list is a hash scaled by the list's length, so no list needs sorting; the leaders grow eightfold a round
    place = "(xxhash64(kid) / 18446744073709551616D + 0.5D) * m"
    first, last, roots = 0, 32, None
    while True:
        roots = roots or settled(spark, "roots", lambda now=edges: connected_components(now).withColumnRenamed("node", "kid"), 16)
        with scratch(spark) as temp:
            placed = groups.where(F.col("m") > first).join(roots, "kid", "left").withColumn("root", F.coalesce("root", "kid"))
            split = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
            drawn = sets.select("kid", "n", F.col("sketch").alias("drawn"))
            open_lists = temp(placed.join(split, "key").join(drawn, "kid").selectExpr("key", "kid", "n", "m", "root", f"if(m > {SKETCHED}, drawn, null) as sketch", f"{place} as place", f"cast(pmod(kid, ceil(m / {SPLIT})) as int) as part"), "open", 4)
            if open_lists.isEmpty():
                return roots
            leaders = open_lists.where((F.col("place") >= first) & (F.col("place") < last)).selectExpr("key", "kid as a", "n as an", "root as ar", "place as aplace", "sketch as asketch", f"explode(sequence(0, cast(ceil(m / {SPLIT}) as int) - 1)) as part")
            spread = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much comparing: not to be coalesced
            more = leaders.join(open_lists.repartition(spread, "key", "part"), ["key", "part"]).where("root <> ar and (place > aplace or place = aplace and kid > a)").where(alike).where(near)
            new = staged(more.select(F.col("a"), F.col("kid").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), "pairs", 4)
        if not new.isEmpty():
            found = links(new)
            if not found.isEmpty():
                edges, roots = roots.select(F.col("kid").alias("a"), F.col("root").alias("b")).union(found), None
        tried = tried.union(new)
        first, last = last, last * 8


def _verified(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets meet the threshold."""
    a = tokens.select(F.col("kid").alias("a"), F.col("tokens").alias("ta"))
    b = tokens.select(F.col("kid").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    met = pairs.join(b, "b").join(a, "a").withColumn("both", both)
    return met.where(100 * F.col("both") >= percent * (F.size("ta") + F.size("tb") - F.col("both"))).select("a", "b")
