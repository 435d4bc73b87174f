"""Each operator on small fixtures against brute force: nulls, empty and repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import itertools
import re
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from stratalog.llm import bpe, license_scan, media, mixing, ngram_join, pii, quality, suffix_dedup, textbytes, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdeé"), size=rng.integers(2, 8))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary, size=rng.integers(0, 160))) for _ in range(40)]
    texts += [texts[1], texts[1], None, "", "x", "two Words", "two words", texts[2] + " tail", "a" * 900, texts[3][:450] + " other words here", "word " * 4000]
    rows = [(i, t, "en", f"src{i % 3}", None, i) for i, t in enumerate(texts)] + [(7, texts[7], None, None, 1, 5), (None, "lonely text", "fr", "src1", 2, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long")


def test_repeated_spans(docs, monkeypatch):
    rows = docs.select("doc_id", "text").collect()
    for limit, piece, own in ((4096, 1 << 20, 8192), (1, 1 << 20, 8192), (4096, 300, 7)):
        monkeypatch.setattr(suffix_dedup, "BUCKET_MAX", limit)
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        monkeypatch.setattr(suffix_dedup, "RUN_MAX", own)
        got = sorted(map(str, suffix_dedup.repeated_spans(docs, 60).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))
        seen = {}
        raws = [(r[1] or "").encode() for r in rows]
        for raw in raws:
            for p in range(len(raw) - 59):
                seen[raw[p : p + 60]] = seen.get(raw[p : p + 60], 0) + 1
        want = []
        for r, raw in zip(rows, raws):
            gone = np.zeros(len(raw) + 1, bool)
            for p in range(len(raw) - 59):
                if seen[raw[p : p + 60]] > 1:
                    gone[p : p + 60] = True
            gone = gone[:-1]
            rest = bytes(b for b, g in zip(raw, gone) if not g)
            runs = sum(1 for k, _ in itertools.groupby(gone) if k)
            want.append(f"Row(doc_id={r[0]}, n_bytes={len(raw)}, n_removed={int(gone.sum())}, n_spans={runs}, kept_sha256='{hashlib.sha256(rest).hexdigest()}')")
        assert got == sorted(want)
    assert suffix_dedup.repeated_spans(docs.limit(0)).count() == 0


def test_merged_order_is_the_sorted_order():
    rng = np.random.default_rng(8)
    rows = [bytes(rng.choice(list(b"ab"), size=rng.integers(0, 9)).astype(np.uint8)) for _ in range(200)]
    core = rng.integers(0, 3, len(rows))
    size = np.array([len(r) for r in rows])
    right = np.array([list(r.ljust(9, b"\0")) for r in rows], np.uint8)
    run, place, own = rng.integers(0, 5, len(rows)), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for k in range(5):  # five shards sort their own
        mine = np.flatnonzero(run == k)
        order, lcp = suffix_dedup.merged_order(core[mine], np.arange(len(mine)), own[mine], own[mine], right[mine], size[mine])
        place[mine[order]], own[mine[order]] = np.arange(len(mine)), lcp
    order, lcp = suffix_dedup.merged_order(core, run, place, own, right, size)
    got = [(core[k], rows[k]) for k in order]
    assert got == sorted((c, r) for c, r in zip(core, rows))
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert lcp.tolist() == [-2 if k == 0 or got[k - 1][0] != c else common(got[k - 1][1], r) for k, (c, r) in enumerate(got)]


def test_shared_phrases(spark):
    rng = np.random.default_rng(6)
    text = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 30, n)]
    passage = text(50)
    rows = [(0, [*text(30), *passage, *text(9)]), (1, [*passage, *text(200)]), (2, [*text(70), *passage]), (3, text(300)), (4, [*passage[:24], *text(90)]), (5, text(49)), (6, []), (7, (p := text(60)) + p)]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in rows] + [(8, None)], "doc_id long, text string")
    got = {r[0]: r[1] for r in suffix_dedup.repeated_spans(frame).select("doc_id", "n_shared_phrases").collect()}
    assert {i for i, n in got.items() if n} == {0, 1, 2} and len(got) == 9


def test_ngram_components(docs):
    rows = docs.select("doc_id", "text").collect()
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    for width, percent in ((3, 90), (5, 80)):
        sets = []
        for r in rows:
            w = WORD.findall(lower(r[1] or ""))
            sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
        owner = list(range(len(rows)))
        for _ in rows:
            for a in range(len(rows)):
                for b in range(len(rows)):
                    if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                        owner[a] = owner[b] = min(owner[a], owner[b])
        ids = {o: min((rows[k][0] for k in range(len(rows)) if owner[k] == o and rows[k][0] is not None), default=None) for o in owner}
        want = sorted(str((r[0], len(s), ids[o] if s else r[0])) for r, s, o in zip(rows, sets, owner))
        assert sorted(str(tuple(r)[:3]) for r in ngram_join.ngram_components(docs, width, percent).collect()) == want
    assert ngram_join.ngram_components(docs.limit(0)).count() == 0


def brute_components(rows, width, percent):
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows with ids, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = WORD.findall(text)
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)})
    owner = [i for i, _ in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while any(owner[a] != owner[b] for a, b in links):
        for a, b in links:
            owner[a] = owner[b] = min(owner[a], owner[b])
    return sorted((i, len(s), o) for (i, _), s, o in zip(rows, sets, owner))


def test_ngram_smallest_linked_sets(spark):
    # a set inside one that is larger by a shingle: 9 in 10 shingles at 90% (11 words, width 3), 4 in 5 at 80% (8 words, width 5)
    texts = []
    for n in range(1, 15):
        text = [f"t{n}w{k}" for k in range(n)]
        texts += [text, [*text, "after"], ["before", *text]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for width, percent in ((3, 90), (5, 80), (2, 50)):
        want = brute_components(rows, width, percent)
        assert len({o for _, _, o in want}) < len(rows)
        assert sorted(tuple(r)[:3] for r in ngram_join.ngram_components(frame, width, percent).collect()) == want


def test_ngram_keys_of_linked_sets_meet():
    """Sets just over the threshold, of any sizes and with any share of frequent tokens, have a key in common."""
    rng = np.random.default_rng(4)
    for percent in (50, 80, 90, 97):
        for _ in range(1500):
            n = int(rng.integers(1, 12) if rng.random() < 0.5 else rng.integers(1, 400))
            more = int(rng.integers(0, n * (100 - percent) // percent + 1))  # the other set has so many tokens of its own beyond those of the first
            both = next(k for k in range(n + 1) if 100 * k >= percent * (2 * n + more - k))
            tokens = rng.permutation(rng.choice(1 << 40, size=2 * n + more, replace=False)).astype(np.uint64)
            a, b = np.sort(tokens[:n]), np.sort(np.concatenate([tokens[n - both : n], tokens[n : 2 * n + more - both]]))
            assert 100 * both >= percent * len(np.union1d(a, b))
            known = np.sort(tokens[rng.random(len(tokens)) < rng.choice([0.0, 0.5, 0.95, 1.0])])
            if len(a) != both or len(b) != both:
                assert len(np.intersect1d(ngram_join.index_keys(a, known, percent), ngram_join.index_keys(b, known, percent))), (n, more, percent)


def test_ngram_sets_of_frequent_shingles(spark):
    # 195 shingles within 240 (J = 0.8125), each of them also in a text that has it in its prefix: the words after it are the most common
    text = [f"b{k}" for k in range(244)]
    common = [f"z{k}" for k in range(20)]
    passages = [" ".join([*text[k : k + 5], *common]) for k in range(240)]
    rows = [(1, " ".join(text)), (0, " ".join(text[:199]))] + [(2 + k, p) for k, p in enumerate(passages * 20)]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).where("doc_id < 242").collect()
    assert sorted(tuple(r)[:3] for r in got) == [(0, 195, 0), (1, 240, 0), *((2 + k, 21, 2 + k) for k in range(240))]


def test_bpe(docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode_documents(docs, path, public_tokenizers.PATTERN)
    got = bpe.decode_documents(encoded, path, public_tokenizers.PATTERN).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r[0], r[1] or "")
    assert len(got) == docs.count()
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == exact.encode_ordinary(texts[r["doc_id"]]) and bytes(r["decoded"]).decode() == texts[r["doc_id"]] and r["n_tokens"] == len(ids)


def test_media(docs):
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    read = media.decode_media(media.encode_media(docs).withColumn("payload", F.lit("replaced")))
    rows = read.collect()
    got = {(r["doc_id"], bytes(r["payload"]), r["media_sha256"]) for r in rows}
    padded = lambda t: (raw := (t or "").encode()) + b"\0" * (-len(raw) % 64 if raw else 64)
    assert {x[:2] for x in got} == {(i, padded(t)) for i, t in texts} and len(rows) == docs.count()
    assert all(r["payload_bytes"] == len(r["payload"]) and r["clips"][0]["start_s"] == 0 and r["media_bytes"] > r["payload_bytes"] for r in rows)
    clips = media.clip_rows(read).collect()
    assert len(clips) == sum(len(r["clips"]) for r in rows) > len(rows)
    raw = bytes(range(256)) * 70
    assert media.decoded(media.write_avi(raw))[0] == raw
    flat = lambda v: np.eye(32)[[v]]
    assert media.shots(np.concatenate([flat(0)] * 4 + [flat(25)] * 4)) == [(0, 3), (4, 7)]
    assert media.decode_media(media.encode_media(docs.limit(0))).count() == 0


class Jpeg:
    """A plain baseline encoder of its own: colour frames with subsampling, restarts, and eight-bit codes for all symbols."""

    quantiser = 4

    def __init__(self, restart):
        self.restart, self.bits = restart, ""
        self.symbols = [0x00, 0xF0, *[r << 4 | s for r in range(16) for s in range(1, 12)]]
        self.code = {s: format(k, "08b") for k, s in enumerate(self.symbols)}

    def put(self, values, before):
        """One block of samples."""
        x = np.arange(8)
        basis = np.array([(0.5 if u else 8**-0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)])
        square = np.rint(basis @ (values.astype(float) - 128) @ basis.T / self.quantiser).astype(int)
        order = [square[i // 8, i % 8] for i in media._ZIGZAG]
        number = lambda v: "" if not v else format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b")
        diff, run = int(order[0]) - before, 0
        self.bits += self.code[abs(diff).bit_length()] + number(diff)
        last = max((k for k in range(1, 64) if order[k]), default=0)
        for v in map(int, order[1 : last + 1]):
            if not v:
                run += 1
                continue
            self.bits += self.code[0xF0] * (run // 16) + self.code[(run % 16) << 4 | abs(v).bit_length()] + number(v)
            run = 0
        self.bits += "" if last == 63 else self.code[0]
        return int(order[0])

    def frame(self, luma, colour):
        """luma: samples in multiples of 16; colour: one value of both other components, at half the size."""
        h, w = luma.shape
        table = lambda kind, symbols: bytes([kind, *[0] * 7, len(symbols), *[0] * 8, *symbols])
        out = b"\xff\xd8" + media._segment(0xDB, bytes([0, *[self.quantiser] * 64])) + media._segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        out += media._segment(0xC4, table(0, self.symbols) + table(0x10, self.symbols)) + media._segment(0xDD, struct.pack(">H", self.restart)) + media._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
        before, n = [0, 0, 0], 0
        flush = lambda: bytes(int((self.bits + "1" * (-len(self.bits) % 8))[k : k + 8], 2) for k in range(0, len(self.bits), 8)).replace(b"\xff", b"\xff\0")
        for y in range(0, h, 16):
            for x in range(0, w, 16):
                if self.restart and n and n % self.restart == 0:
                    out, before, self.bits = out + flush() + bytes([0xFF, 0xD0 + (n // self.restart - 1) % 8]), [0, 0, 0], ""
                for dy in (0, 8):
                    for dx in (0, 8):
                        before[0] = self.put(luma[y + dy : y + dy + 8, x + dx : x + dx + 8], before[0])
                for c in (1, 2):
                    before[c] = self.put(np.full((8, 8), colour), before[c])
                n += 1
        out, self.bits = out + flush() + b"\xff\xd9", ""
        return out


@pytest.mark.parametrize("restart,indexed", [(0, True), (2, False)])
def test_foreign_media(spark, restart, indexed):
    coder = Jpeg(restart)
    y, x = np.mgrid[0:32, 0:48]
    scenes = [(x * 4 + y) % 200 + 20, 255 - (y * 5) % 120, (x * y) % 90 + 40]
    frames = [coder.frame(np.clip(s + k, 0, 255).astype(np.uint8), 90 + k) for s in scenes for k in range(5)]
    for s, f in zip((scenes[0], scenes[1] + 0), (frames[0], frames[5])):
        head, blocks = media.coefficients(f)
        assert np.abs(media.pixels(head, blocks).astype(int) - s).max() <= 8
    chunk, movi, index, at = media._chunk, [], b"", 4
    for f in frames:
        movi += [chunk(b"01wb", b"sound"), chunk(b"00dc", f)]
        index += struct.pack("<4sIII", b"01wb", 0, at, 5) + struct.pack("<4sIII", b"00dc", 0x10, at + len(movi[-2]), len(f))
        at += len(movi[-2]) + len(movi[-1])
    avih = struct.pack("<14I", 100_000, 0, 0, 0x10, len(frames), 0, 2, 0, 48, 32, 0, 0, 0, 0)
    body = b"AVI " + chunk(b"LIST", b"hdrl" + chunk(b"avih", avih)) + chunk(b"LIST", b"movi" + b"".join(movi)) + (chunk(b"idx1", index) if indexed else b"")
    rows = [(1, chunk(b"RIFF", body)), (2, None), (3, b"no media"), (4, chunk(b"RIFF", body)[: len(body) // 2])]
    read = media.decode_media(spark.createDataFrame(rows, "doc_id long, media binary"))
    got = {r["doc_id"]: r for r in read.collect()}
    assert got[1]["payload"] is None and [(c["start_s"], c["end_s"]) for c in got[1]["clips"]] == [(0.0, 0.5), (0.5, 1.0), (1.0, 1.5)]
    assert all(got[k]["payload"] is None for k in (2, 3, 4)) and not got[2]["clips"] and not got[3]["clips"]
    assert media.clip_rows(read.where("doc_id = 1")).count() == 3


def test_warc(spark):
    warc.BLOCK_LINES = 3
    rows = [(i, f"http://h{i % 4}.example.com/p?{i}", "page %d " % (i % 5) * 30, 1) for i in range(30)] + [(3, "http://h3.example.com/p?3", "page 3 " * 30, 1), (None, None, None, 0), (90, "no url\t", "short", 0)]
    got = warc.archive_and_read(spark, spark.createDataFrame(rows, "page_id long, url string, html string, key int"))
    want = [(i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "response" if i is None or i < 5 or i == 90 else "revisit", None if i is None or i < 5 or i == 90 else i % 5) for i, _, h, _ in rows]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


def test_mixing(docs):
    weights = {"src0": 3, "src1": 2, mixing.OTHER: 2}
    got = mixing.schedule(docs, weights, 4).toPandas()
    assert len(got) == docs.count() and got.position.is_unique and ((got.slot >= got.release) & (got.slot < got.deadline)).all()
    done = dict.fromkeys(weights, 0)
    for t, s in enumerate(mixing.round_of_slots(weights) * 2, 1):
        done[s] += 1
        assert all(abs(done[k] - weights[k] * t / 7) < 1 for k in weights)
    assert mixing.mix(docs, weights).columns == docs.columns


def test_pii(spark):
    rows = [(1, "Call +1 (274) 555-9629, card 4998709779753682; born 1984-02-29, ip 12.24.74.106, rsb.39@mail3.example.com 123-45-6789"), (2, "again 4998709779753682 and 31.02.1999 4998709779753683 000-12-1234"), (3, None), (4, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: (r[1], r[2]) for r in pii.pseudonymise(frame, "k").collect()}
    assert got[3] == (None, 0) and got[4] == ("", 0) and got[1][1] == 6 and got[2][1] == 1
    new = re.search(r"card (\d{16})", got[1][0])[1]
    assert new != "4998709779753682" and f"again {new} and 31.02.1999 4998709779753683 000-12-1234" == got[2][0]
    digits = [int(c) for c in reversed(new)]
    assert sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0
    days = spark.range(2000).select(F.col("id").alias("doc_id"), F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    assert pii.pseudonymise(days, "k").select("text").distinct().count() == 2000
    ssn = spark.range(300).select(F.col("id").alias("doc_id"), F.format_string("219-09-%04d", F.col("id") + 1).alias("text"))
    out = [r[0] for r in pii.pseudonymise(ssn, "k").select("text").collect()]
    assert len(set(out)) == 300 and all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", x) for x in out)


def test_pii_links_the_ways_of_writing(spark):
    cards = ["4998709779753682", "4998 7097 7975 3682", "4998-7097-7975-3682"]
    phones = ["(274) 555-9629", "274-555-9629", "+1 274-555-9629", "274 555 9629", "+1 (274) 555-9629"]
    mails = ["Rsb.7@Mail.example.com", "rsb.7@Mail.example.com", "RSB.7@Mail.example.com"]
    dates = ["1984-02-29", "29.02.1984", "29/02/1984"]
    keys = ["0123456789abcdef" * 2, "fedcba9876543210" * 4]
    values = [*cards, *phones, *mails, *dates, *keys]
    frame = spark.createDataFrame([(k, f"<< {v} >>", "mine", k) for k, v in enumerate(values)], "doc_id long, text string, found string, n_pseudonyms int")
    rows = sorted(pii.pseudonymise(frame, "k").collect())
    assert all(r["found"] == "mine" and r["n_pseudonyms"] == 1 for r in rows)
    new = [r["text"][3:-3] for r in rows]
    form = lambda v: re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", v)))
    for old, got in zip(values[:-2], new):
        assert got != old and (form(got) == form(old) or "@" in old and form(got).partition("@")[2] == form(old).partition("@")[2])
    digits = lambda v: re.sub("[^0-9]", "", v.removeprefix("+1"))
    assert len({digits(v) for v in new[:3]}) == 1 and len({digits(v) for v in new[3:8]}) == 1
    assert len({v.lower() for v in new[8:11]}) == 1 and [v[0].isupper() for v in new[8:11]] == [True, False, True]
    year, month, day = new[11].split("-")
    assert new[12:14] == [f"{day}.{month}.{year}", f"{day}/{month}/{year}"]
    assert all(re.fullmatch("[0-9a-f]{%d}" % len(old), got) and got != old for old, got in zip(keys, new[-2:]))
    many = spark.range(3000)
    for text in ("format_string('274-555-%04d', id)", "format_string('u%04d@a.org', id)", "concat(substr(md5(cast(id as string)), 1, 30), format_string('a%x', id % 16))"):
        made = many.selectExpr("id as doc_id", f"{text} as text")
        assert pii.pseudonymise(made, "k").select("text").distinct().count() == made.select("text").distinct().count()
    long = "no value here " * 40_000 + cards[0]
    got = pii.pseudonymise(spark.createDataFrame([(1, long), (1, long)], "doc_id long, text string"), "k").collect()
    assert [r["text"] for r in got] == [long[:-16] + new[0]] * 2
    assert pii.pseudonymise(frame.limit(0), "k").count() == 0


def test_mixing_of_odd_rows(spark):
    rows = [(None, f"t{k}", None if k % 2 else "src0", k, "o") for k in range(50)] + [(1, "same", "src0", 0, "o")] * 3 + [(2, None, "src1", 0, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, `rank` int, `order` string")
    got = mixing.schedule(frame, {"src0": 2, mixing.OTHER: 1}, 4).toPandas()
    assert len(got) == 54 and got.position.is_unique and sorted(got["rank"]) == sorted(r[3] for r in rows)
    assert mixing.schedule(frame.limit(0), {mixing.OTHER: 1}).count() == 0


def test_license_scan(spark):
    t = license_scan.TEMPLATES
    rows = [(1, "intro " + t["mit"] + " end"), (2, t["gpl-3.0-line"].upper()), (3, None), (4, ""), (5, "nothing of that kind here at all"), (6, t["bsd"].replace("disclaimer", "notice"))]
    got = {r[0]: [m["template"] for m in r[1]] for r in license_scan.scan_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["mit"], 2: ["gpl-3.0-line"], 3: [], 4: [], 5: [], 6: ["bsd"]}


def test_trained(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        text = list(rng.choice(words, size=40)) + (["vile", "nasty"] if bad else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text) + (" ###" * 5 if bad else ""), "en", int(bad), int(not bad)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int, quality int")
    docs, labels = frame.select("doc_id", "text", "lang"), frame.select("doc_id", "toxic", "quality")
    scored = toxicity.score_documents(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where(toxicity.held_out()).toPandas()
    assert ((scored.score >= 0.5) == (scored.toxic == 1)).mean() > 0.95
    odd = spark.createDataFrame([(1, None, None, 1), (1, "", "xx", 2)], "doc_id long, text string, lang string, score int")
    assert toxicity.score_documents(odd, toxicity.train(docs, labels)).where("score between 0 and 1").count() == 2
    judged = quality.judge_documents(docs, quality.train(docs, labels)).join(labels, "doc_id").toPandas()
    assert ((judged.quality_x >= 0.5) == (judged.quality_y == 1)).mean() > 0.95 if "quality_x" in judged else True
    empty = toxicity.train(docs, labels.limit(0))
    assert toxicity.score_documents(docs.limit(3), empty).count() == 3
    assert quality.judge_documents(odd, quality.train(docs, labels.limit(0))).where("base_failed and not kept").count() == 2


def test_quality_of_copies(spark):
    rng = np.random.default_rng(9)
    model = quality.Regression(rng.normal(size=2 * quality.DIMS) * 9)
    texts = ["", "a", "ab", "abc", "abcd", "é", "two words", "x " * 30 + "end", "some longer text\nof two lines"]

    def judge(some, limit):
        data, offs = textbytes.utf8(pa.array(some, pa.string()))
        for i, j in textbytes.chunks(offs, limit):
            yield from model.probability(quality.features(*textbytes.spaced(data, offs, i, j))).tolist()

    alone = {t: list(judge([t], 1))[0] for t in texts}
    assert len(set(alone.values())) == len(texts)
    for limit in (1, 60, 1 << 19):
        for _ in range(4):
            order = [str(t) for t in rng.permutation(texts * 3)]
            assert list(judge(order, limit)) == [alone[t] for t in order]
    for text in texts:  # a gram for each byte and the blank after the last, blanks after that
        raw = text.encode() + b" " * quality.GRAM
        codes = [sum(int(b) * 257 ** (quality.GRAM - 1 - k) for k, b in enumerate(raw[p : p + quality.GRAM])) for p in range(len(text.encode()) + 1)]
        data, offs = textbytes.utf8(pa.array([text, "next"]))
        grams, first = quality.features(*textbytes.spaced(data, offs, 0, 2))[1]
        assert grams[: first[1]].tolist() == ((textbytes.mix(np.array(codes, np.uint64)) & np.uint64(quality.DIMS - 1)).astype(np.int64) + quality.DIMS).tolist()
    frame = spark.createDataFrame([(k, str(t)) for k, t in enumerate(rng.permutation(texts * 20))], "doc_id long, text string").repartition(7)
    got = quality.judge_documents(frame, model).select("text", "quality").distinct().collect()
    assert {r[0]: r[1] for r in got} == alone and len(got) == len(texts)


def test_pipeline_returns_the_mix(spark, docs, tmp_path, monkeypatch):
    given = docs.drop("key").where("source is not null")
    given.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    source = {r[0]: r[1] for r in given.select("doc_id", "source").collect()}
    found = []
    for weights in (corpus_pipeline.MIX_WEIGHTS, {"src0": 1, "src1": 2, mixing.OTHER: 4}):
        monkeypatch.setattr(corpus_pipeline, "MIX_WEIGHTS", weights)
        got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "slot", "position").collect()
        turns, members, want = mixing.round_of_slots(weights), {}, []
        for i in sorted((r[0] for r in got), key=lambda i: hashlib.md5((hashlib.md5(b"lonely text").hexdigest() if i is None else str(i)).encode()).hexdigest()):
            members.setdefault(source[i] if source[i] in weights else mixing.OTHER, []).append(i)
        for s, ids in members.items():
            own = [t for t, owner in enumerate(turns) if owner == s]
            for k, i in enumerate(ids):
                cycle, turn = divmod(k // mixing.BLOCK, len(own))
                slot = cycle * len(turns) + own[turn]
                want.append((i, slot, slot * mixing.BLOCK + k % mixing.BLOCK))
        assert len(got) > 10 and sorted(map(str, map(tuple, got))) == sorted(map(str, want))
        found.append(sorted(map(str, got)))
    assert found[0] != found[1]
