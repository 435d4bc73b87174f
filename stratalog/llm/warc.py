"""WARC archives with a two-level capture index.

Each partition writes one archive of gzip members, one per record. The index is the captures' keys (reversed host and path,
then page id) sorted by range over the cluster and written as shards: compressed blocks of BLOCK_LINES lines, and at the
shard's end a sparse directory with each block's first key. A look-up finds the shard by the shards' first keys, binary-searches the
directory, reads one block as a byte range, binary-searches its lines, and then reads the record as a byte range.

All files are in the shared folder and are reached through pyarrow.fs, so that any URI it knows will do. File names are
unique to the attempt that wrote them: rows of a lost or repeated attempt refer to no half-written file.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.textbytes import map_batches
from stratalog.session import fresh_path, staged

#: Lines of a compressed index block.
BLOCK_LINES = 512
#: Bytes of an archive that one task reads, at most; there are as many tasks as the session has shuffle partitions at least.
READ_BYTES = 128 << 20
#: Shorter payloads are never written as revisits.
LEAST_SHARED = 100
DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _open(folder: str, name: str, write: bool = False):
    fs, path = pa.fs.FileSystem.from_uri(folder)
    if write:
        fs.create_dir(path, recursive=True)
        return fs.open_output_stream(f"{path}/{name}", compression=None)
    return fs.open_input_file(f"{path}/{name}")


def capture_key(url: Column, page_id: Column) -> Column:
    """Reversed host, path and query, then the id in an order-preserving form; a null id comes as '-'."""
    text = F.translate(F.coalesce(url, F.lit("")), "\t\r\n", "   ")
    host = F.lower(F.regexp_extract(text, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rest = F.regexp_replace(text, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    number = F.lpad((page_id.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), rest, F.lit("\t"), F.coalesce(number, F.lit("-")))


def _record(row: dict) -> bytes:
    digest, n, revisit = row["digest"], row["payload_bytes"], row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http if revisit else http + row["payload"]
    name = lambda page: uuid.uuid5(_SPACE, f"{page}/{digest}").urn
    lines = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{name(row['page_id'])}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(row['url'] or '').translate({9: '%09', 10: '%0A', 13: '%0D'})}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {row['page_id']}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{name(row['refers_to'])}>", f"X-Refers-To-Page-ID: {row['refers_to']}"]
    lines.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse_record(member: bytes) -> dict:
    """A record's type, ids, payload size and digest; a response's payload is measured, a revisit's is as declared."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    declared = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    revisit = fields["WARC-Type"] == "revisit"
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("X-Page-ID"), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID"),
        "payload_bytes": int(declared["Content-Length"]) if revisit else len(payload), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest(), "payload": None if revisit else payload,
    }


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row and return the captures: key, archive, offset, length.

    pages: page_id (integer), url, html and other columns (ignored). Of rows whose payloads (html as UTF-8; null: empty) are equal
    and of LEAST_SHARED bytes or more, those of the smallest page_id are responses and the others revisits of it; all
    others are responses. A null page_id counts as larger than any; if no equal row has an id, all are responses; rows that repeat the smallest id are
    responses all. A null url is empty; line breaks and tabs in it are escaped.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long"), "key": capture_key(F.col("url"), F.col("page_id"))})
    first = rows.where(F.col("payload_bytes") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    rows = rows.join(staged(first, "repeated"), "digest", "left")  # a table, so that Spark can broadcast it or split a common payload's rows
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("first"))})

    def run(batches) -> Iterator[pa.RecordBatch]:
        name, out, offset = f"part-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part, spots = batch.slice(k, 256), []
                out = out or _open(folder, name, write=True)
                for row in part.to_pylist():
                    member = _record(row)
                    out.write(member)
                    spots.append((offset, len(member)))
                    offset += len(member)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([name] * len(spots)), pa.array([a for a, _ in spots], pa.int64()), pa.array([b for _, b in spots], pa.int64())], ["key", "archive", "offset", "length"])
        if out:
            out.close()

    return staged(map_batches(rows.select("key", "page_id", "url", "payload", "digest", "payload_bytes", "record_type", "refers_to"), run, "key string, archive string, offset long, length long"), "captures")


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the sorted shards and return one row per shard: shard, first (its first key). Captures with equal keys are all entered; no captures give no shards."""
    spread = captures.repartitionByRange("key").sortWithinPartitions("key", "archive", "offset")

    def run(batches) -> Iterator[pa.RecordBatch]:
        name, out, offset, lines, directory = f"shard-{uuid.uuid4().hex}.cdxz", None, 0, [], []

        def block():
            nonlocal offset, lines
            body = zlib.compress("\n".join(lines).encode(), 6)
            out.write(body)
            directory.append(["\t".join(lines[0].split("\t")[:2]), offset, len(body)])
            offset += len(body)
            lines = []

        for batch in batches:
            for key, archive, at, length in zip(*(batch.column(c).to_pylist() for c in ("key", "archive", "offset", "length"))):
                out = out or _open(folder, name, write=True)
                lines.append(f"{key}\t{archive}\t{at}\t{length}")
                if len(lines) == BLOCK_LINES:
                    block()
        if out:
            if lines:
                block()
            body = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(body + struct.pack("<Q", len(body)))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([directory[0][0]])], ["shard", "first"])

    return staged(map_batches(spread, run, "shard string, first string"), "shards")


class Shard:
    """An open index shard: the directory in memory, one block at a time."""

    def __init__(self, folder: str, name: str):
        self.file = _open(folder, name)
        size = self.file.size()
        n = struct.unpack("<Q", self.file.read_at(8, size - 8))[0]
        self.directory = json.loads(zlib.decompress(self.file.read_at(n, size - 8 - n)))
        self.first = [d[0] for d in self.directory]
        self.at, self.lines, self.keys = -1, [], []

    def _load(self, k: int) -> None:
        if k != self.at:
            _, offset, length = self.directory[k]
            self.lines = zlib.decompress(self.file.read_at(length, offset)).decode().split("\n")
            self.keys = ["\t".join(x.split("\t")[:2]) for x in self.lines]
            self.at = k

    def find(self, key: str) -> list[tuple[str, int, int]]:
        """Archive, offset and length of each capture with this key; equal keys may run on over several blocks."""
        k, out = max(0, bisect.bisect_left(self.first, key) - 1), []
        while k < len(self.directory) and (not out or self.first[k] == key) and self.first[k] <= key:
            self._load(k)
            i = bisect.bisect_left(self.keys, key)
            while i < len(self.keys) and self.keys[i] == key:
                archive, at, length = self.lines[i].split("\t")[2:]
                out.append((archive, int(at), int(length)))
                i += 1
            k += 1
        return out


def look_up(keys: DataFrame, shards: DataFrame, folder: str) -> DataFrame:
    """Captures of the distinct keys asked for (column `key`): key, archive, offset, length. Unknown and null keys give no row."""
    table = sorted((r["first"], r["shard"]) for r in shards.collect())  # one row per index partition
    first, names = [t[0] for t in table], [t[1] for t in table]

    def place(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("key").to_pylist()
            # equal keys lie in one shard: the range exchange never divides them
            yield pa.RecordBatch.from_arrays([pa.array([max(0, bisect.bisect_right(first, k) - 1) for k in asked], pa.int32()), batch.column("key")], ["shard", "key"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        at, shard = -1, None
        for batch in batches:
            out = []
            for k, key in zip(batch.column("shard").to_pylist(), batch.column("key").to_pylist()):
                if k != at:
                    at, shard = k, Shard(folder, names[k])
                out += [(key, *x) for x in shard.find(key)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "archive", "offset", "length"])

    if not table:
        return keys.sparkSession.createDataFrame([], "key string, archive string, offset long, length long")
    asked = map_batches(keys.select("key").where("key is not null").distinct(), place, "shard int, key string")
    return map_batches(asked.repartition(len(table), "shard").sortWithinPartitions("shard", "key"), run, "key string, archive string, offset long, length long")


def read_records(spots: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Read each capture (archive, offset, length; repeated ones as often) as a byte range of its archive. With payloads, a response's bytes come along.

    Each task reads stretches of READ_BYTES of archives, in the order in which they lie there.
    """
    total = spots.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(spots.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // READ_BYTES))
    stretch = F.expr(f"offset div {max(1, min(READ_BYTES, total // tasks))}")

    def run(batches) -> Iterator[pa.RecordBatch]:
        at, file = "", None
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = []
                for archive, offset, length in zip(*(batch.slice(k, 256).column(c).to_pylist() for c in ("archive", "offset", "length"))):
                    if archive != at:
                        at, file = archive, _open(folder, archive)
                    rows.append(parse_record(file.read_at(length, offset)))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] if payloads or c != "payload" else None for r in rows], t) for c, t in zip(names, kinds)], names)

    spread = spots.repartition(tasks, "archive", stretch).sortWithinPartitions("archive", "offset").select("archive", "offset", "length")
    return map_batches(spread, run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def archive_and_read(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages' archives and index, look every page up again and read it back. An empty table gives an empty result."""
    folder = fresh_path(spark, "warc")
    captures = write_archives(pages, folder)
    shards = write_index(captures, folder)
    asked = pages.select(capture_key(F.col("url").cast("string"), F.col("page_id").cast("long")).alias("key"))
    return read_records(staged(look_up(asked, shards, folder), "spots"), folder)
