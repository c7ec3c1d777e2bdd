r"""WARC archives with a two-level capture index.

write_archives() stores one gzip member per page row. Of records whose payloads
are equal and at least MIN_DEDUP bytes long, the one with the largest page_id
is a `response`; the others are `revisit` records without a payload. The capture
rows (reversed-host key, page_id, file, offset, length) are range-sorted by key,
split into compressed blocks, and each index shard stores its blocks behind one
another and a sparse directory with the first key of every block. The first
keys of the shards (INDEX_SHARDS of them at most, so a bounded list) route a
lookup to its shard; there a binary search over the directory finds the block, one in
the block the capture, and a range read fetches the record's bytes.

Files go to a folder that all executors see; a task names its files after its
own attempt, and only what the written capture table lists counts, so a task
that is run again leaves at most an unread file behind.

Defined results: a null html is an empty payload; a null url is the empty key;
a null page_id is kept (it sorts first and can't be referred to); rows that repeat a page_id
each have a record of their own, and those with the largest page_id of
their payload are all responses; a page of any length is one record; an empty table writes no file; other columns
are ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.common import bounded_batches, scratch, written

MIN_DEDUP = 1000
BLOCK_CAPTURES = 256
INDEX_SHARDS = 4096
CAPTURES = "key string, page_id long, uid string, file string, offset long, length long"
SHARDS = "shard_file string, first_key string, directory_offset long, directory_length long, n_captures long"
RECORDS = "page_id long, uid string, record_type string, refers_to long, digest string, payload binary"


def surt(url: Column) -> Column:
    """Reversed-host sort key: `https://www.a.example/x?y` -> `example,a,www)/x?y`, the host in lower case."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return F.concat(F.concat_ws(",", F.reverse(F.split(host, r"\."))), F.lit(")"), F.substring(rest, F.length(host) + 1, F.lit(1 << 30)))


@lru_cache(maxsize=8)
def _filesystem(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root)


def _open_out(root: str, name: str):
    system, path = _filesystem(root)
    system.create_dir(path, recursive=True)
    return system.open_output_stream(f"{path}/{name}", compression=None)


def _open_in(root: str, name: str):
    system, path = _filesystem(root)
    return system.open_input_file(f"{path}/{name}")


def _record(page_id, uid: str, url: str | None, payload: bytes, refers_to, digest: str) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uid}>", f"WARC-Target-URI: {json.dumps(url or '')[1:-1]}"]
    head += [f"X-Page-ID: {page_id}", f"WARC-Payload-Digest: sha1:{digest}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if refers_to is not None:
        head += [f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + body + b"\r\n\r\n", compresslevel=1, mtime=0)


def parse_record(member: bytes) -> tuple:
    """(page_id, uid, record_type, refers_to, digest, payload) of one gzip member; a damaged one raises."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    payload = body.partition(b"\r\n\r\n")[2]
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"the payload of page {fields['X-Page-ID']} does not match its digest")
    page = None if fields["X-Page-ID"] == "None" else int(fields["X-Page-ID"])
    refers = fields.get("X-Refers-To-Page")
    return page, fields["WARC-Record-ID"][10:-1], kind, None if refers is None else int(refers), digest, payload


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and refers_to (null for responses).

    The latest page of each long payload is found from digests alone; the html joins them by digest, where the
    few digests that repeat are one row each and a hot one is split by adaptive skew handling.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    long = rows.where(F.octet_length("html") >= MIN_DEDUP).select("digest", "page_id")
    latest = long.groupBy("digest").agg(F.max("page_id").alias("latest"), F.count("*").alias("n"))
    latest = latest.where("n > 1").select("digest", "latest")
    return rows.join(latest, "digest", "left").withColumn(
        "refers_to", F.when((F.col("latest") > F.col("page_id")) | (F.col("page_id").isNull() & F.col("latest").isNotNull()), F.col("latest"))
    )


def write_archives(pages: DataFrame, root: str) -> DataFrame:
    """Write the records under root; the captures, one row a record, sorted by nothing yet."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            rows = []
            for page_id, url, key, html, digest, refers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                out = out or _open_out(root, name)
                uid = str(uuid.uuid4())
                member = _record(page_id, uid, url, html, refers, digest)
                out.write(member)
                rows.append((key, page_id, uid, name, at, len(member)))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _capture_types, strict=True)], names=_capture_names)
        if out:
            out.close()

    planned = plan_records(pages).select("page_id", "url", surt(F.col("url")).alias("key"), "html", "digest", "refers_to")
    return planned.mapInArrow(run, CAPTURES)


_capture_names = [x.split()[0] for x in CAPTURES.split(", ")]
_capture_types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]


def write_index(captures: DataFrame, root: str, shards: int | None = None) -> DataFrame:
    """Sort the captures by key and write one index file a range; a row for each shard."""
    shards = min(shards or int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), INDEX_SHARDS)
    ordered = captures.repartitionByRange(shards, "key", "page_id", "uid").sortWithinPartitions("key", "page_id", "uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, at, n, directory, block = f"{uuid.uuid4().hex}.cdx", None, 0, 0, [], []

        def flush():
            nonlocal at, block
            packed = zlib.compress("\n".join(map(json.dumps, block)).encode(), 1)
            out.write(packed)
            directory.append((block[0][0], at, len(packed)))
            at, block = at + len(packed), []

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                out = out or _open_out(root, name)
                block.append(row)
                n += 1
                if len(block) == BLOCK_CAPTURES:
                    flush()
        if out:
            if block:
                flush()
            listing = zlib.compress(json.dumps(directory).encode(), 1)
            out.write(listing)
            out.close()
            yield pa.RecordBatch.from_pydict({"shard_file": [name], "first_key": [directory[0][0]], "directory_offset": [at], "directory_length": [len(listing)], "n_captures": [n]})

    return ordered.mapInArrow(run, SHARDS)


class ShardReader:
    """Looks keys up in one index shard; keeps the block read last, as lookups come in key order."""

    def __init__(self, root: str, shard: tuple):
        self.file = _open_in(root, shard[0])
        self.file.seek(shard[2])
        self.directory = json.loads(zlib.decompress(self.file.read(shard[3])))
        self.first = [d[0] for d in self.directory]
        self.at, self.block, self.keys = -1, [], []

    def _load(self, k: int) -> None:
        if k != self.at:
            _, offset, length = self.directory[k]
            self.file.seek(offset)
            self.block = [json.loads(x) for x in zlib.decompress(self.file.read(length)).decode().split("\n")]
            self.at, self.keys = k, [b[0] for b in self.block]

    def find(self, key: str) -> Iterator[list]:
        """Every capture of the key: from the last block that starts before it, as long as the key goes on."""
        k = max(bisect.bisect_left(self.first, key) - 1, 0)
        while k < len(self.first) and self.first[k] <= key:
            self._load(k)
            for i in range(bisect.bisect_left(self.keys, key), len(self.keys)):
                if self.keys[i] != key:
                    return
                yield self.block[i]
            k += 1


def read_captures(keys: DataFrame, shards: list[tuple], root: str) -> DataFrame:
    """The records of every distinct key in keys (a column `key`), found by the index. shards: rows of write_index().

    A key whose captures lie in several shards is looked up in each of them; lookups are spread by shard and salt.
    """
    shards = sorted(shards, key=lambda s: s[1])
    firsts = [s[1] for s in shards]
    bounded_batches(keys.sparkSession)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, shard = [], []
            for k in batch.column(0).to_pylist():
                low = max(bisect.bisect_left(firsts, k) - 1, 0)
                for s in range(low, max(bisect.bisect_right(firsts, k), low + 1)):
                    key.append(k)
                    shard.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(shard, pa.int32())], names=["key", "shard"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict[int, ShardReader] = {}
        files: dict = {}
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for key, shard in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard not in readers:
                    readers = {shard: ShardReader(root, shards[shard])}
                for _, _, _, file, offset, length in readers[shard].find(key):
                    if file not in files:
                        if len(files) >= 64:
                            files.popitem()[1].close()
                        files[file] = _open_in(root, file)
                    files[file].seek(offset)
                    rows.append(parse_record(files[file].read(length)))
                    held += len(rows[-1][5])
                    if len(rows) >= 256 or held > 16 << 20:
                        yield _records(rows)
                        rows, held = [], 0
        if rows:
            yield _records(rows)

    if not shards:
        return keys.sparkSession.createDataFrame([], RECORDS)
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routed = keys.select("key").distinct().mapInArrow(route, "key string, shard int")
    return routed.repartitionByRange(n, "shard", "key").sortWithinPartitions("shard", "key").mapInArrow(fetch, RECORDS)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])


def archive(pages: DataFrame, root: str | None = None) -> tuple[str, list[tuple]]:
    """Write the archives and their index; the folder, and the shard list (INDEX_SHARDS rows at most)."""
    spark: SparkSession = pages.sparkSession
    root = root or scratch(spark, "warc")
    if "://" not in root:
        root = f"file://{root}" if root.startswith("/") else root.replace("file:", "file://", 1)
    captures = written(write_archives(pages, root), "captures")
    shards = written(write_index(captures, root), "shards")
    return root, [tuple(r) for r in shards.collect()]


def resolved(records: DataFrame) -> DataFrame:
    """Length and digest of the full payload of every record: a revisit has those of the response that it refers to by
    page and digest, so pages that repeat an id with other payloads don't mix."""
    own = records.select("page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("_bytes"))
    own = written(own, "records")
    target = own.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "digest").agg(F.max("_bytes").alias("_tb"))
    revisits = own.where("record_type = 'revisit'").join(target, ["refers_to", "digest"], "left")
    out = lambda df, size: df.select("page_id", F.col(size).alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    return out(own.where("record_type = 'response'"), "_bytes").unionByName(out(revisits, "_tb"))
