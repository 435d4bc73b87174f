"""Removal of repeated byte strings by merging shards' sorted, sampled suffixes through interleave refinement.

The suffixes kept are a sample, as all of them would need a round over the corpus for each of `length` bytes. A suffix is sampled where a
content-defined anchor stands (the least of SPAN consecutive k-mer hashes), so each `length`-byte window holds an anchor that
it shares with every equal window, and each window is reached from its anchor by at most SPAN - 1 LF steps, which
prepend the byte before. The bytes that all windows of an anchor contain (its core) act
as one symbol: the suffixes fall into buckets by core, and only buckets with two or more
suffixes are looked at.

A shard (an Arrow batch of texts) gives its suffixes in order, with the common prefix of neighbours and the bytes before each, nearest first: the
first of these is the shard's transform, the others are what its LF steps would give. The shards' runs are merged as in Holt and McMillan (2014): the
interleave starts with run after run, and each round deals the blocks of equal prefixes out by one more byte, which keeps a run's own order. A block whose rows come
from one run is finished: its order and common prefixes are the run's. So no suffixes are sorted again, and the common prefixes of the merged order come
from the round that parted two neighbours. LF steps over the bytes on the left then give, for each window start, blocks of equal
left context, in which neighbours' common prefixes decide whether the window is a repeated interval.

Scale: one anchor per about SPAN/2 bytes is shuffled, text only for documents with a shared core. Equal surroundings within a text
(repetitive texts) are one row; those of exact copies are settled by counts. A bucket with more than BUCKET_MAX
different surroundings is not gathered in a task: it is cut into the finest parts, one for each window string, which are counted by hash in a
map-side combined aggregate. That is exact for any size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark import TaskContext

from stratalog.llm.textbytes import U64, byte_sums, chunks, map_batches, mix, prefix_sums, signed, span_hash, spaced, utf8, words
from stratalog.session import settled, staged

#: Bytes of a k-mer.
KMER = 8
#: Different suffixes that one bucket may bring into a task; larger buckets are counted by window hash.
BUCKET_MAX = 4096
#: Suffixes of a shard's run.
RUN_MAX = 8192
#: Bytes of a text whose windows are sampled at once; longer texts are gone through in pieces.
PIECE = 1 << 20
#: Words of a passage that `shared_phrases` never misses, and of the phrases that it compares.
PASSAGE, PHRASE = 50, 26
#: Most bits of the filter that keeps unmarked texts from the join; it has eight a marked text up to that.
FILTER_BITS = 1 << 27


def _span(length: int) -> int:
    """k-mers in a sampling window: the largest power of two that leaves over a third of the length as core."""
    span = 1
    while 2 * span <= length * 2 // 3 and 2 * span + KMER <= length:
        span *= 2
    return span


def anchors(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions and the first and last window start that each owns, over concatenated texts."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 3
    padded = np.concatenate([data, np.zeros(KMER, np.uint8)])
    words = np.ndarray(n, "<u8", buffer=padded.tobytes(), strides=(1,)).astype(np.uint64)
    low = (mix(words) & U64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    span, step = _span(length), 1
    while step < span:
        low[:-step] = np.minimum(low[:-step], low[step:])
        step *= 2
    at = (low & U64(0xFFFFFFFF)).astype(np.int64)
    lengths = np.diff(offs)
    ok = np.zeros(n + 1, dtype=np.int64)
    has = lengths >= length
    np.add.at(ok, offs[:-1][has], 1)
    np.add.at(ok, (offs[1:] - length + 1)[has], -1)
    starts = np.flatnonzero(np.cumsum(ok)[:n])
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    own = at[starts]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    return own[new], starts[new], starts[np.append(new[1:] - 1, len(starts) - 1)]


def _pieces(offs: np.ndarray, length: int):
    """(document, shift, data range, offsets) of chunks of texts; a long text comes in pieces that overlap by a window less a byte, so that each window is in one of them."""
    for i, j in chunks(offs):
        if offs[j] - offs[i] <= PIECE + length or j - i > 1:
            yield i, 0, slice(offs[i], offs[j]), offs[i : j + 1] - offs[i]
            continue
        for a in range(int(offs[i]), int(offs[j]) - length + 1, PIECE):
            b = min(a + PIECE + length - 1, int(offs[j]))
            yield i, a - int(offs[i]), slice(a, b), np.array([0, b - a])


def _sample(length: int):
    """The sampled suffixes of each text: position, owned windows, core and surroundings as hashes.

    Equal surroundings within a piece are one row: the first's, with how often they come and the windows of all, neighbours joined.
    """

    def run(batches):
        for batch in batches:
            data, offs = utf8(batch.column("text"))
            digest = batch.column("digest").to_numpy()
            for i, shift, where, cut in _pieces(offs, length):
                part = data[where]
                at, lo, hi = anchors(part, cut, length)
                if not len(at):
                    continue
                doc = np.searchsorted(cut, at, side="right") - 1
                sums = byte_sums(part)
                core = span_hash(sums, at, at + length - _span(length) + 1)
                around = span_hash(sums, lo, hi + length) ^ mix((at - lo).astype(np.uint64))
                base = cut[doc] - shift
                order = np.lexsort((lo, around, doc))
                doc, at, lo, hi, core, around = (x[order] for x in (doc, at - base, lo - base, hi - base, core, around))
                new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (around[1:] != around[:-1])])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(new)))
                again = np.repeat(times > 1, times)
                # what comes again: the windows of all its places, as few runs as there are
                more = np.flatnonzero(again)
                more = more[np.lexsort((lo[more], doc[more]))]
                apart = np.concatenate([[True], (doc[more][1:] != doc[more][:-1]) | (lo[more][1:] > hi[more][:-1] + 1)]) if len(more) else np.zeros(0, bool)
                begin = np.flatnonzero(apart)
                runs_lo, runs_hi, runs_doc = lo[more][begin], hi[more][np.append(begin[1:], len(more)) - 1] if len(more) else hi[:0], doc[more][begin]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([digest[doc[first] + i], digest[runs_doc + i]])), *(pa.array(np.concatenate([x[first], y]), pa.int32()) for x, y in ((at, runs_lo), (lo, runs_lo), (hi, runs_hi))),
                        pa.array(np.concatenate([signed(core[first]), np.zeros(len(begin), np.int64)])), pa.array(np.concatenate([signed(around[first]), np.zeros(len(begin), np.int64)])), pa.array(np.concatenate([times, np.zeros(len(begin), np.int64)])),
                    ],
                    ["digest", "at", "lo", "hi", "core", "around", "times"],
                )

    return run


def _phrases(batches):
    """Of each PASSAGE words in a row, those PHRASE in a row whose hash is least; each phrase once a text."""
    steps = PASSAGE - PHRASE + 1
    for batch in batches:
        data, offs = utf8(batch.column("text"))
        digest = batch.column("digest").to_numpy()
        for i, j in chunks(offs):
            text, starts = spaced(data, offs, i, j)
            s, e = words(text)
            first = np.searchsorted(s, starts)
            owner = np.repeat(np.arange(j - i), np.diff(first))
            at = np.flatnonzero(np.arange(len(s)) + PHRASE <= first[1:][owner]) if len(s) else np.zeros(0, np.int64)
            low, owner, reach = mix(span_hash(prefix_sums(span_hash(byte_sums(text), s, e)), at, at + PHRASE)), owner[at], 1
            while reach < steps and len(low):  # the least of ever more phrases; what spans two texts goes
                more = min(reach, steps - reach)
                low, owner, ends = np.minimum(low[:-more], low[more:]), owner[:-more], owner[more:]
                low, owner, reach = low, np.where(owner == ends, owner, -1), reach + more
            low, owner = low[owner >= 0], owner[owner >= 0]
            order = np.lexsort((low, owner))
            low, owner = low[order], owner[order]
            new = np.concatenate([[True], (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])]) if len(low) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(digest[owner[new] + i]), pa.array(signed(low[new]))], ["digest", "phrase"])


def shared_phrases(rows: DataFrame) -> DataFrame:
    """(digest, n_shared_phrases) of the texts that share a sampled phrase of PHRASE words with another row.

    rows: digest and text. Each passage of PASSAGE words that two rows share holds such a phrase; texts without a shared phrase give no row.
    """
    found = staged(map_batches(rows.select("digest", "text"), _phrases, "digest long, phrase long"), "phrases")
    twice = staged(found.groupBy("phrase").count().where("count > 1").select("phrase"), "twice", 4)
    return found.join(twice, "phrase", "left_semi").distinct().groupBy("digest").agg(F.count("*").alias("n_shared_phrases"))


def _bitmap(marks: DataFrame) -> np.ndarray:
    """Bits, eight a byte, set for the marked digests: at most FILTER_BITS / 32 rows come to the driver, as Arrow."""
    size = min(FILTER_BITS, max(1 << 16, 1 << (8 * marks.count()).bit_length()))
    place = F.expr(f"pmod(digest, {size})")
    rows = marks.select(place.alias("p")).groupBy(F.expr("p div 32").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 32 as int))")).alias("bits")).toArrow()
    out = np.zeros(size // 32, dtype=np.uint32)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint8)


def _marked(packed: np.ndarray):
    """Only texts that may be marked, so that the others aren't shuffled; a full bitmap lets all through."""
    size = 8 * len(packed)

    def run(batches):
        for batch in batches:
            place = batch.column("digest").to_numpy() % size
            yield batch.filter(pa.array((packed[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1))

    return run


def _contexts(length: int):
    """A shard's run: its suffixes in order, each with the bytes from its first window to the end of its last."""
    core_len = length - _span(length) + 1

    def run(batches):
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            marks = batch.column("merge")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(marks.offsets.to_numpy()))
            texts, flat = batch.column("text"), marks.flatten()
            for k in range(0, len(flat), RUN_MAX):
                part, mine = flat.slice(k, RUN_MAX), owner[k : k + RUN_MAX]
                at, lo, hi = (part.field(c).to_numpy().astype(np.int64) for c in ("at", "lo", "hi"))
                data, offs = utf8(texts.slice(int(mine[0]), int(mine[-1] - mine[0]) + 1))
                begin, size = offs[mine - mine[0]] + lo, hi + length - lo
                raw = pa.array([data[x : x + n].tobytes() for x, n in zip(begin, size)], pa.binary())
                core = part.field("core").to_numpy()
                rlen = hi + length - at - core_len
                order, lcp = merged_order(core, np.arange(len(core)), np.zeros(len(core), np.int64), np.zeros(len(core), np.int64), _gather(data, begin + at - lo + core_len, rlen, int(rlen.max())), rlen)
                take, part = pa.array(order), part.take(pa.array(order))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("digest").take(pa.array(mine[order])), *(part.field(c) for c in ("at", "lo", "hi", "core", "many", "crowd")), raw.take(take), pa.array(np.full(len(order), shard)), pa.array(np.arange(len(order))), pa.array(lcp)],
                    ["digest", "at", "lo", "hi", "core", "many", "crowd", "bytes", "run", "place", "lcp"],
                )
                shard += 1

    return run


def merged_order(core: np.ndarray, run: np.ndarray, place: np.ndarray, run_lcp: np.ndarray, right: np.ndarray, right_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted runs of suffixes, core by core: the interleave, and each suffix's common prefix with the one before it in bytes right of the core (-2: none, another core).

    place: a suffix's place in its run; run_lcp: its common prefix with the suffix before it there; right: the bytes right of the core. Where each
    suffix is a run of its own, this sorts.
    """
    m, width = right.shape
    order = np.lexsort((place, run, core))
    new = np.concatenate([[True], core[order][1:] != core[order][:-1]])
    block = np.maximum.accumulate(np.where(new, np.arange(m), 0))  # the first place of each one's block of equal prefixes
    lcp = np.where(new, -2, -1)

    def unfinished(live: np.ndarray) -> np.ndarray:
        """Without the blocks that one run has alone: there, its own common prefixes hold."""
        if not len(live):
            return live
        own, r = block[live], run[order[live]]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        size = np.diff(np.append(first, len(own)))
        alone = np.repeat(r[first] == r[first + size - 1], size)
        known = alone.copy()
        known[first] = False
        lcp[live[known]] = run_lcp[order[live[known]]]
        return live[~alone]

    live = unfinished(np.arange(m))
    for h in range(width + 1):  # one byte a round; dealing out by it keeps the order so far
        if not len(live):
            break
        rows = order[live]
        symbol = np.full(len(rows), -1, dtype=np.int64)
        symbol[right_len[rows] > h] = right[rows[right_len[rows] > h], h] if h < width else -1
        move = np.lexsort((symbol, block[live]))
        order[live] = rows[move]
        symbol, same = symbol[move], block[live]
        cut = np.concatenate([[True], (same[1:] != same[:-1]) | (symbol[1:] != symbol[:-1])])
        lcp[live[cut & np.concatenate([[False], same[1:] == same[:-1]])]] = h
        ended = symbol < 0  # nothing more to compare: the same bytes and the same end
        lcp[live[~cut & ended]] = h
        block[live] = live[np.maximum.accumulate(np.where(cut, np.arange(len(live)), 0))]
        live = unfinished(live[~ended])
    return order, lcp


def repeated_windows(order: np.ndarray, lcp: np.ndarray, left: np.ndarray, left_len: np.ndarray, core_len: int, length: int) -> np.ndarray:
    """repeated[suffix, o]: whether the window that starts o bytes left of the suffix's core is a repeated interval. left: the bytes before the core, nearest first."""
    m = len(order)
    # least common prefix between any two places of the interleave
    table = [lcp]
    while (1 << len(table)) <= m:
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))

    def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = np.floor(np.log2(np.maximum(b - a, 1))).astype(np.int64)
        out = np.empty(len(a), dtype=np.int64)
        for level in np.unique(k):
            pick = k == level
            out[pick] = np.minimum(table[level][a[pick] + 1], table[level][b[pick] + 1 - (1 << level)])
        return out

    repeated = np.zeros((m, left.shape[1] + 1), dtype=bool)
    live = np.arange(m)
    group = np.cumsum(lcp == -2)
    for o in range(left.shape[1] + 1):  # LF steps: prepend one byte a round
        if o:
            rows = order[live]
            inside = left_len[rows] >= o
            live, group = live[inside], group[inside]
            if not len(live):
                break
            symbol = left[order[live], o - 1].astype(np.int64)
            move = np.lexsort((symbol, group))
            live, symbol, group = live[move], symbol[move], group[move]
            group = np.cumsum(np.concatenate([[1], (group[1:] != group[:-1]) | (symbol[1:] != symbol[:-1])]))
        size = np.bincount(group)[group]
        live, group = live[size > 1], group[size > 1]
        if len(live) < 2:
            break
        near = group[1:] == group[:-1]
        common = np.zeros(len(live), dtype=np.int64)
        common[1:][near] = between(live[:-1][near], live[1:][near]) + core_len + o
        met = common >= length
        met[:-1] |= met[1:]
        repeated[order[live[met]], o] = True
    return repeated


def _merge(length: int):
    """Merge the runs of each bucket of a partition; gives the repeated windows of each suffix as runs."""
    core_len = length - _span(length) + 1

    def run(frames):
        held = [f for f in frames if f.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        cores = rows.column("core").to_numpy()
        order = np.argsort(cores, kind="stable")
        edges = np.append(np.flatnonzero(np.diff(cores[order], prepend=cores[order][0] - 1)), len(cores))
        a = 0
        while a < len(edges) - 1:  # whole buckets, about 8,192 suffixes at a time
            b = a + 1
            while b < len(edges) - 1 and edges[b + 1] - edges[a] <= 8192:
                b += 1
            part = rows.take(pa.array(order[edges[a] : edges[b]])).combine_chunks()
            a = b
            at, lo, hi, core, shard, place, lcp = (part.column(c).to_numpy().astype(np.int64) for c in ("at", "lo", "hi", "core", "run", "place", "lcp"))
            data, offs = utf8(part.column("bytes"))
            llen = at - lo
            rlen = hi + length - at
            right = _gather(data, offs[:-1] + llen, rlen, int(rlen.max()))
            left = _gather(data[::-1], len(data) - offs[:-1] - llen, llen, int(llen.max()))
            hits = repeated_windows(*merged_order(core, shard, place, lcp, right[:, core_len:], rlen - core_len), left, llen, core_len, length)
            # the core's own bytes are compared too: equal hashes of different bytes don't count
            hits &= span_bytes(right[:, :core_len], core)[:, None]
            hits &= np.arange(hits.shape[1]) >= (at - hi)[:, None]
            hits[part.column("many").to_numpy()] = False
            r, o = np.nonzero(hits)
            last = np.concatenate([(r[1:] != r[:-1]) | (o[1:] != o[:-1] + 1), [True]]) if len(r) else np.zeros(0, bool)
            z = np.flatnonzero(last)
            f = np.concatenate([[0], z[:-1] + 1]) if len(z) else z
            yield pa.RecordBatch.from_arrays([part.column("digest").combine_chunks().take(pa.array(r[z])), pa.array(at[r[z]] - o[z], pa.int32()), pa.array(at[r[f]] - o[f], pa.int32())], ["digest", "lo", "hi"])

    return run


def _gather(data: np.ndarray, first: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
    """Rows of up to `width` bytes from `first` on, zero after `count`."""
    cols = np.arange(width)
    out = np.zeros((len(first), width), dtype=np.uint8)
    fill = cols < count[:, None]
    out[fill] = data[(first[:, None] + cols)[fill]]
    return out


def span_bytes(core_bytes: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Whether each row's core bytes equal those of its bucket's first row."""
    first = np.concatenate([[True], core[1:] != core[:-1]])
    head = np.maximum.accumulate(np.where(first, np.arange(len(core)), 0))
    return (core_bytes == core_bytes[head]).all(axis=1)


def _windows(length: int):
    """Each owned window of a crowded bucket's suffix as a hash, to be counted."""

    def run(batches):
        for batch in batches:
            lo, hi = (batch.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi"))
            data, offs = utf8(batch.column("bytes"))
            sums = byte_sums(data)
            n = hi - lo + 1
            row = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = offs[row] + step
            key = span_hash(sums, start, start + length)
            check = mix(span_hash(sums, start, start + length // 2) + U64(1))
            yield pa.RecordBatch.from_arrays([batch.column("digest").take(pa.array(row)), pa.array(lo[row] + step, pa.int32()), batch.column("many").take(pa.array(row)), pa.array(signed(key)), pa.array(signed(check))], ["digest", "start", "many", "key", "check"])

    return run


def _cut(length: int):
    """Apply the repeated windows to each text."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(5)]
            for text, digest, marks in zip(batch.column("text"), batch.column("digest"), batch.column("windows")):
                raw = text.as_buffer().to_pybytes()
                spans, end = [], -1
                for w in sorted((m["lo"], m["hi"]) for m in marks.as_py()):
                    if w[0] <= end:
                        spans[-1][1] = max(spans[-1][1], w[1] + length)
                    else:
                        spans.append([w[0], w[1] + length])
                    end = spans[-1][1]
                kept, last = [], 0
                for s, e in spans:
                    kept.append(raw[last:s])
                    last = e
                kept.append(raw[last:])
                rest = b"".join(kept)
                for k, v in enumerate((digest.as_py(), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), [{"start": s, "end": e} for s, e in spans])):
                    out[k].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], ["digest", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """Find each byte covered by a `length`-byte string that also starts elsewhere in the corpus.

    docs: doc_id, text and other columns (ignored). Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    `spans`, the removed runs as byte offsets, and n_shared_phrases (see shared_phrases), which is over 0 also for shorter passages that another row
    has. A null text is empty; texts shorter than `length` lose nothing;
    repeated rows are copies of each other and lose everything that is long enough; doc_id may be null. Texts are told apart by
    64-bit hashes.
    """
    return settled(docs.sparkSession, "repeated", lambda: _repeated_spans(docs, length))


def _repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))
    phrases = staged(shared_phrases(rows), "shared_phrases", 4)
    long = rows.where(F.octet_length("text") >= length).select("digest", "text")
    sample = staged(map_batches(long, _sample(length), "digest long, at int, lo int, hi int, core long, around long, times long"), "suffixes")
    suffixes = sample.where("times > 0")
    cores = suffixes.groupBy("core").agg(F.sum("times").alias("n"), F.min("around").alias("a"), F.max("around").alias("b")).where("n > 1")
    cores = staged(cores.select("core", F.expr("a <> b").alias("mixed")), "cores", 4)
    shared = staged(suffixes.join(cores, "core"), "shared")
    # copies of one and the same surroundings repeat throughout; of mixed buckets each kind sends one suffix
    kinds = staged(shared.where("mixed").groupBy("core", "around").agg(F.sum("times").alias("n"), F.min(F.struct("digest", "at", "lo", "hi")).alias("lead")), "kinds")
    crowds = kinds.groupBy("core").agg(F.count("*").alias("kinds")).where(F.col("kinds") > BUCKET_MAX).select("core", F.lit(True).alias("crowd"))
    copied = shared.where("mixed").join(kinds.where("n > 1").select("core", "around"), ["core", "around"], "left_semi")
    full = shared.where("not mixed").select("digest", "lo", "hi").union(copied.select("digest", "lo", "hi")).union(sample.where("times = 0").select("digest", "lo", "hi"))
    lead = kinds.join(crowds, "core", "left").select("lead.*", "core", F.expr("n > 1").alias("many"), F.coalesce("crowd", F.lit(False)).alias("crowd"))
    merge = lead.groupBy("digest").agg(F.collect_list(F.struct("at", "lo", "hi", "core", "many", "crowd")).alias("merge"))
    whole = full.groupBy("digest").agg(F.collect_set(F.struct("lo", "hi")).alias("whole"))
    marks = staged(whole.join(merge, "digest", "full"), "marks")
    texts = map_batches(long, _marked(_bitmap(marks)), "digest long, text string").join(marks, "digest").dropDuplicates(["digest"])
    texts = staged(texts, "texts")
    runs = map_batches(texts.where("merge is not null").select("digest", "text", "merge"), _contexts(length), "digest long, at int, lo int, hi int, core long, many boolean, crowd boolean, bytes binary, run long, place long, lcp long")
    runs = staged(runs, "runs")
    merged = map_batches(runs.where("not crowd").repartition("core"), _merge(length), "digest long, lo int, hi int")
    windows = map_batches(runs.where("crowd"), _windows(length), "digest long, start int, many boolean, key long, check long")
    twice = windows.groupBy("key", "check").count().where("count > 1").select("key", "check")
    counted = windows.where("not many").join(twice, ["key", "check"]).select("digest", F.col("start").alias("lo"), F.col("start").alias("hi"))
    found = merged.union(counted).groupBy("digest").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    cut = texts.join(found, "digest", "left").select("digest", "text", F.concat(F.coalesce("whole", none), F.coalesce("found", none)).alias("windows"))
    done = map_batches(cut.where(F.size("windows") > 0), _cut(length), "digest long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>")
    every = rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("all_sha256"))
    count = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return every.join(done, "digest", "left").join(phrases, "digest", "left").select(
        "doc_id", "n_bytes", count("n_removed"), count("n_spans"), F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256"), F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"), count("n_shared_phrases")
    )
