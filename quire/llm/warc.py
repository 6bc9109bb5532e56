"""WARC archives: writing captures, reading records, and assembling the records of each capture.

Writing. Each row becomes a transaction of three records: a response (or a revisit, if another row has the same
payload and the smallest id), the request, and a metadata record with the row's ids. Request and metadata name the
response's record id in ``WARC-Concurrent-To``. Every record is a gzip member of its own. Files are written by
Spark's text sink, so its commit protocol covers lost executors and any Hadoop file system will do: the sink's
line separator is set to the zero byte that ends a gzip member anyway (the top byte of its length; a record of
16 MiB or more gets an empty member after it, which ends in one).

Reading. Files are parsed where they lie; a record's type, ids, digest and length come back as columns.

Assembly. Responses and revisits are joined to requests and to metadata records through the concurrent-to
identifiers, one nested row for each capture.

Null payloads are empty ones. A row with a null id is a response always. Rows that repeat an id are captures of
their own; repeated rows of the smallest id are all responses. An empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.scratch import READ_ROWS, at_most, batches_of, new_path, written

# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BATCH_BYTES, PIECE_BYTES = 1 << 20, 1 << 14
# Bytes of a file at most, before compression; transactions of a file at most; bytes of a transaction besides its payload.
FILE_BYTES, MOST_IN_FILE, HEADERS_BYTES = 128 << 20, 1000, 2048
PAGE_ROWS = 256  # pages that a reader or a worker holds at once
# Of payloads with copies, digests, ids and URLs that go to every worker at most, and what one takes besides; more are joined by a shuffle.
BROADCAST_BYTES, DIGEST_BYTES = 32 << 20, 128


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(*parts: object) -> bytes:
    h = hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>".encode()


def header_text(value: str | None) -> bytes:
    """A value on one header line; line breaks and spaces of a URL are percent-encoded."""
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in value or "urn:x-unknown:").encode("utf-8", "replace")


def record(kind: bytes, fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    """One record as a gzip member, without the member's last byte, which is zero."""
    head = [VERSION, b"WARC-Type: " + kind, *(k + b": " + v for k, v in fields), b"Content-Length: %d" % len(block)]
    raw = b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"
    member = zlib.compress(raw, 6, 31)
    return member[:-1] if member[-1] == 0 else member + zlib.compress(b"", 6, 31)[:-1]


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit: int = 0, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES, most_broadcast: int = BROADCAST_BYTES) -> None:
    """Write each row's transaction; equal payloads of at least ``least_revisit`` bytes are stored once.

    A file takes as many transactions as fit ``file_bytes`` if all payloads are as large as the largest, so that it can be
    read back whole; one that does not fit has a file of its own. Payloads stay where they are read: the digests that
    repeat go to them, or if these take more than ``most_broadcast`` bytes, both meet in a shuffle.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # payloads are read here for what their digests tell, and once more to be written
    spark, known = pages.sparkSession, F.when(F.col("id").isNotNull(), F.struct("id", "url"))
    with at_most(spark, READ_ROWS, PAGE_ROWS):
        digests = rows.select("id", "digest", known.alias("known"), F.length("payload").alias("bytes")).groupBy("digest")
        digests = written(digests.agg(F.min("known").alias("first"), F.max("id").alias("last"), F.max("bytes").alias("bytes")), "digests")
    largest = digests.agg(F.max("bytes")).first()[0] or 0
    each = max(1, min(MOST_IN_FILE, file_bytes // (largest + HEADERS_BYTES)))
    same = digests.where((F.col("bytes") >= least_revisit) & (F.col("first.id") < F.col("last"))).select(F.col("digest").alias("of"), "first")
    taken = same.agg(F.sum(F.length(F.col("first.id").cast("string")) + F.coalesce(F.length("first.url"), F.lit(0)) + DIGEST_BYTES)).first()[0] or 0
    if taken <= most_broadcast:
        marked = rows.join(F.broadcast(same), (F.col("digest") == F.col("of")) & (F.col("id") > F.col("first.id")), "left")
    else:
        # only ids and digests meet here: a payload that many rows share is no heavy key
        again = rows.select(F.col("id").alias("again_id"), F.col("digest").alias("of")).join(same, "of").where("again_id > first.id").distinct()
        marked = rows.join(again, (F.col("id") == F.col("again_id")) & (F.col("digest") == F.col("of")), "left")
    marked = marked.select(F.col("id").cast("string"), "url", "payload", F.col("first.id").cast("string").alias("first_id"), F.col("first.url").alias("first_url"), F.col("of").isNotNull().alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n, stamp = TaskContext.get().partitionId(), 0, date.encode()
        for batch in batches:
            out, size = [], 0
            for row_id, url, payload, first_id, first_url, revisit in zip(*(c for c in batch.columns), strict=True):
                row_id, url, payload, first_id, first_url, revisit = (x.as_py() for x in (row_id, url, payload, first_id, first_url, revisit))
                n += 1
                target = header_text(url)
                key = urn("capture", row_id, task, n)
                common = [(b"WARC-Date", stamp), (b"WARC-Target-URI", target)]
                digest = (b"WARC-Payload-Digest", b"sha1:" + base32_sha1(payload).encode())
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                kind = (b"Content-Type", b"application/http; msgtype=response")
                own = [(b"WARC-Record-ID", key), *common, digest, kind]
                if revisit:
                    refers = [(b"WARC-Profile", PROFILE), (b"WARC-Refers-To-Target-URI", header_text(first_url)), (b"WARC-Refers-To-Date", stamp)]
                    out.append(record(b"revisit", own + refers, http))
                else:
                    out.append(record(b"response", own, http + payload))
                beside = [*common, (b"WARC-Concurrent-To", key)]
                rest = target.partition(b"://")[2]
                host, _, where = rest.partition(b"/")
                get = b"GET /" + where + b" HTTP/1.1\r\nHost: " + host + b"\r\n\r\n"
                out.append(record(b"request", [(b"WARC-Record-ID", urn("request", row_id, task, n)), *beside, (b"Content-Type", b"application/http; msgtype=request")], get))
                fields = b"".join(k + b": " + v.encode() + b"\r\n" for k, v in ((b"sourceId", row_id), (b"refersToSourceId", first_id)) if v is not None)
                out.append(record(b"metadata", [(b"WARC-Record-ID", urn("metadata", row_id, task, n)), *beside, (b"Content-Type", b"application/warc-fields")], fields))
                size += len(payload)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = marked.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    with batches_of(spark, PAGE_ROWS), at_most(spark, READ_ROWS, PAGE_ROWS):
        records.write.option("lineSep", "\0").option("maxRecordsPerFile", 3 * each).text(path)


RECORD = (
    "record_id string, type string, concurrent_to string, target_uri string, date string, refers_to_uri string, "
    "payload_digest string, payload_bytes bigint, http_headers string, payload binary, fields map<string,string>"
)


def members(content: bytes) -> Iterator[bytes]:
    """The decompressed members of a file, one at a time; plain files are one member."""
    if content[:2] != b"\x1f\x8b":
        if content:
            yield content
        return
    at, rest = 0, memoryview(content)
    while at < len(rest):
        # a bounded piece at a time: what lies behind the member is copied out of the piece, not out of the file
        unzip, out = zlib.decompressobj(31), []
        while not unzip.eof and at < len(rest):
            piece = rest[at : at + PIECE_BYTES]
            out.append(unzip.decompress(piece))
            at += len(piece) - len(unzip.unused_data)
        yield b"".join(out) + unzip.flush()


def parse(data: bytes) -> Iterator[tuple]:
    """The records of a member as tuples of ``RECORD``'s columns."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            head[k.strip().lower()] = v.strip().decode("utf-8", "replace")
        size = int(head[b"content-length"])
        block = data[end + 4 : end + 4 + size]
        at = end + 8 + size
        kind, fields, http, payload, length = head[b"warc-type"], {}, None, None, None
        digest = head.get(b"warc-payload-digest", "").removeprefix("sha1:") or None
        if head.get(b"content-type", "").startswith("application/http"):
            before, _, payload = block.partition(b"\r\n\r\n")
            http = before.decode("utf-8", "replace")
            if kind == "response":
                length, digest = len(payload), base32_sha1(payload)
            else:
                sizes = [x.partition(":")[2] for x in http.split("\r\n") if x.lower().startswith("content-length:")]
                length, payload = int(sizes[0]) if sizes else 0, None
        elif kind == "metadata":
            for line in block.decode("utf-8", "replace").split("\r\n"):
                k, colon, v = line.partition(": ")
                if colon:
                    fields[k] = v
        else:
            payload, length = block, size
        yield head.get(b"warc-record-id"), kind, head.get(b"warc-concurrent-to"), head.get(b"warc-target-uri"), head.get(b"warc-date"), head.get(b"warc-refers-to-target-uri"), digest, length, http, payload, list(fields.items())


def read_warc(spark: SparkSession, path: str, types: tuple[str, ...] | None = None, payloads: bool = True) -> DataFrame:
    """The records of all files under path, of the given types, with ``RECORD``'s columns.

    A response's digest and length are of its payload as read; a revisit's are those of the payload it stands for.
    """
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.binary(), pa.map_(pa.string(), pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for data in members(content.as_py()):
                    for row in parse(data):
                        if types is None or row[1] in types:
                            rows.append(row if payloads else (*row[:9], None, row[10]))
                            size += len(data)
                            if size > BATCH_BYTES:
                                yield made(rows)
                                rows, size = [], 0
                yield made(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def captures(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One nested row for each capture: its response or revisit with the request and metadata concurrent to it.

    Archives are parsed once: the records go to a table in the shared folder, whose three kinds are then joined.
    """
    records = written(read_warc(spark, path, ("response", "revisit", "request", "metadata"), payloads), "records", batch_rows=1)
    main = records.where(F.col("type").isin("response", "revisit"))
    nested = main.select("record_id", "target_uri", "date", F.struct("type", "http_headers", "payload_digest", "payload_bytes", "payload", "refers_to_uri").alias("response"))
    request = records.where("type = 'request'").select(F.col("concurrent_to").alias("of"), F.struct("record_id", "http_headers").alias("request"))
    metadata = records.where("type = 'metadata'").select(F.col("concurrent_to").alias("of"), F.struct("record_id", "fields").alias("metadata"))
    joined = nested.join(request, nested["record_id"] == request["of"], "left").drop("of")
    return joined.join(metadata, joined["record_id"] == metadata["of"], "left").drop("of")


def archive(pages: DataFrame, **options: object) -> str:
    """Write pages to a new place in the shared folder; its path."""
    path = new_path(pages.sparkSession, "warc")
    write_warc(pages, path, **options)
    return path
