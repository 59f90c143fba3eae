"""WARC archives: a deterministic sharded writer and a reader."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefold.llm.common import commit_files, join_hot, ordered_cuts, ready, remove_dir, stored, work_dir

#: Compressed bytes from which a new file begins, and payload bytes from which equal payloads become revisits.
ROLL, REVISIT = 64 << 20, 1000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "shard int, file int, path string, records long, bytes long, first_id long, last_id long"
_DRAFT = f"now string, {_MANIFEST}"
_ROWS = "shard int, page_id long, tie long, digest string, mark boolean, refers_to long, url string, payload_bytes long, sha1 binary, member binary"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes | None, refers_to: int | None, revisit: bool, date: str = DATE, size: int = 0, sha1: bytes = b"") -> bytes:
    """One record: headers made anew, digests of the full payload and of the block. A revisit needs only the payload's ``size`` and ``sha1``."""
    if payload is not None:
        size, sha1 = len(payload), hashlib.sha1(payload).digest()
    digest = sha1.hex()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    own = record_id(page_id, digest) if not revisit or refers_to != page_id else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/again')}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {date}",
        f"WARC-Record-ID: {own}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(record: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


class _Roller:
    """Files of one shard, under temporary names of this attempt's own."""

    def __init__(self, folder: str, work: str, shard: int, roll: int):
        from pyarrow import fs

        self.store, self.place = fs.FileSystem.from_uri(work)
        self.folder, self.work, self.shard, self.roll = folder, work, shard, roll
        self.store.create_dir(self.place, recursive=True)
        self.out, self.file, self.done = None, 0, []

    def add(self, page_id: int | None, member: bytes) -> None:
        if self.out is None:
            self.temporary = f"{uuid.uuid4().hex}.tmp"
            self.out, self.size, self.records, self.first = self.store.open_output_stream(f"{self.place}/{self.temporary}", compression=None), 0, 0, page_id
        self.out.write(member)
        self.size, self.records, self.last = self.size + len(member), self.records + 1, page_id
        if self.size >= self.roll:
            self.close()

    def close(self) -> list[tuple]:
        """Rows of the draft manifest so far."""
        if self.out is not None:
            self.out.close()
            name = f"part-{self.shard:06d}-{self.file:04d}.warc.gz"
            self.done.append((f"{self.work}/{self.temporary}", self.shard, self.file, f"{self.folder}/{name}", self.records, self.size, self.first, self.last))
            self.out, self.file = None, self.file + 1
        return self.done


def _packed(pages: DataFrame, cuts, level: int) -> DataFrame:
    """Each page's response record as a gzip member, made where the page is read, with what a revisit of it needs instead."""

    def pack(batches):
        for batch in batches:
            ids, ties, digests, urls, html = (batch.column(k) for k in range(5))
            payloads = [h.encode() for h in html.to_pylist()]
            sums = [hashlib.sha1(p).digest() for p in payloads]
            members = [gzip_member(warc_record(i, u, p, None, False), level) for i, u, p in zip(ids.to_pylist(), urls.to_pylist(), payloads)]
            n = batch.num_rows
            columns = [pa.array(cuts.value.of(ids, ties)), ids, ties, digests, pa.array([False] * n), pa.nulls(n, pa.int64()), urls, pa.array([len(p) for p in payloads], pa.int64()), pa.array(sums, pa.binary()), pa.array(members, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _ROWS.split(", ")])

    return pages.select("page_id", "tie", "digest", "url", "html").mapInArrow(pack, _ROWS)


def _marks(marks: DataFrame, cuts) -> DataFrame:
    """The marks (``page_id, tie, digest, refers_to``) as rows that sort before the pages they are of."""

    def place(batches):
        for batch in batches:
            ids, ties, digests, refers = (batch.column(k) for k in range(4))
            n = batch.num_rows
            columns = [pa.array(cuts.value.of(ids, ties)), ids, ties, digests, pa.array([True] * n), refers, *(pa.nulls(n, t) for t in (pa.string(), pa.int64(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _ROWS.split(", ")])

    return marks.select("page_id", "tie", "digest", "refers_to").mapInArrow(place, _ROWS)


def write_warc(pages: DataFrame, folder: str, roll: int = ROLL, revisit: int = REVISIT, level: int = 6) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) as WARC files below ``folder`` (a URI); returns the manifest.

    Records go in ascending ``page_id`` over the files in order of name; a file
    ends at the record that takes its compressed size to ``roll``. Of equal
    payloads of at least ``revisit`` bytes the record with the largest
    ``page_id`` is the response and the others are revisits of it (of repeated
    rows with that id, the first). Null html counts as empty; null urls become
    ``about:blank``; null ids come first and are never a group's response unless
    all its ids are null. Other columns are not read. An empty table gives an
    empty manifest.

    Records are compressed where pages are read; what moves, once, is gzip
    members, by ranges taken from the ids of all pages, and a writer appends.
    Which pages are revisits arrives in the same shuffle as small rows, so a
    payload that many pages share gathers nowhere, and an id with many rows may
    take several shards. Files are written under temporary names; a draft
    manifest names those that count, then they get their names, and the manifest
    is written last.
    """
    spark = pages.sparkSession
    ready(spark)
    cuts = spark.sparkContext.broadcast(ordered_cuts(pages, "page_id", max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"), F.sha2(payload, 256).alias("digest")).withColumn("tie", F.xxhash64("digest"))
    large = stored(rows.filter(F.octet_length("html") >= revisit).select("page_id", "digest", "tie"), work_dir(spark, "payloads"))
    groups = stored(large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1"), work_dir(spark, "groups"))
    marks = join_hot(large, groups, "digest", "n", large.count()).dropDuplicates(["page_id", "digest"])
    both = _packed(rows, cuts, level).unionByName(_marks(marks, cuts)).repartitionById(cuts.value.parts, "shard")
    ordered, work = both.sortWithinPartitions("shard", "page_id", "tie", "digest", F.desc("mark"), "url"), f"{folder}/_work"

    def write(batches):
        files, found, marked, refers, first = None, [], None, None, True
        for batch in batches:
            for shard, page_id, _, digest, mark, to, url, size, sha1, member in zip(*(batch.column(k).to_pylist() for k in range(10))):
                if mark:
                    marked, refers, first = (page_id, digest), to, True
                    continue
                grouped = marked == (page_id, digest)
                again = grouped and not (page_id == refers and first)
                first = first and not grouped
                if files is None or files.shard != shard:
                    found += files.close() if files else []
                    files = _Roller(folder, work, shard, roll)
                files.add(page_id, gzip_member(warc_record(page_id, url, None, refers, True, size=size, sha1=sha1), level) if again else member)
        found += files.close() if files else []
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found)) or [[]] * 8, kinds)], [x.split()[0] for x in _DRAFT.split(", ")])

    draft = stored(ordered.mapInArrow(write, _DRAFT), f"{work}/draft")
    manifest = commit_files(draft, {"now": "path"}, f"{folder}/manifest")
    remove_dir(work)
    return manifest


def records(stream):
    """``(headers, block)`` of each record in a stream of gzip members."""
    with gzip.GzipFile(fileobj=stream) as f:
        while line := f.readline():
            if line.strip():
                head = {}
                while (line := f.readline()).strip():
                    name, _, value = line.decode().partition(":")
                    head[name.strip().lower()] = value.strip()
                yield head, f.read(int(head["content-length"]))


def parsed(head: dict, block: bytes) -> tuple:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to, html``; digests are checked on the way."""
    if base64.b32encode(hashlib.sha1(block).digest()).decode() != head["warc-block-digest"].partition(":")[2]:
        raise ValueError(f"{head['warc-record-id']}: block digest differs")
    http, _, body = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
    digest = base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex()
    kind = head["warc-type"]
    if kind == "response" and (len(body) != length or hashlib.sha1(body).hexdigest() != digest):
        raise ValueError(f"{head['warc-record-id']}: payload differs")
    number = lambda name: int(head[name]) if name in head else None
    return number("x-page-id"), head["warc-target-uri"], length, digest, kind, number("x-refers-to-page-id"), body.decode() if kind == "response" else None


def read_warc(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The records of the manifest's files, a task for each file or few: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, html`` (null for revisits)."""
    ready(spark)
    n = manifest.count()

    def read(batches):
        from pyarrow import fs

        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_stream(place, compression=None, buffer_size=1 << 20) as stream:
                    for head, block in records(stream):
                        rows.append(parsed(head, block))
                        size += len(block)
                        if size > 4 << 20 or len(rows) >= 1000:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = manifest.select("path").repartition(max(1, min(n, 20_000)))
    return files.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")
