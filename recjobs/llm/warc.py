"""WARC archives: one gzip member a record, written by tasks and read back sequentially.

The reader inflates incrementally, member by member, takes each block by its content length, and
checks both digests. A payload that an earlier record holds already is written as a revisit record,
whose HTTP header still tells the payload's length.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from recjobs.functions.storage import materialize, new_folder
from recjobs.functions.workers import small_batches
from recjobs.llm.components import hot_limit, split_join
from recjobs.llm.files import create, open_stream

READ_BYTES = 1 << 18
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # pages carry no time of capture


class WarcError(ValueError):
    pass


def digest(data: bytes) -> str:
    """Base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """One gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{payload_digest}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join((url or 'urn:none').split())}",
        f"X-Page-ID: {page_id}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{payload_digest}')}>", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def members(source) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as an iterator of inflated pieces (to be used up in turn)."""
    waiting = source.read(READ_BYTES)

    def member() -> Iterator[bytes]:
        nonlocal waiting
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            if not waiting:
                waiting = source.read(READ_BYTES)
                if not waiting:
                    raise WarcError("the archive ends within a member")
            data = inflate.decompress(waiting, READ_BYTES)
            waiting = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            if data:
                yield data

    while waiting or (waiting := source.read(READ_BYTES)):
        pieces = member()
        yield pieces
        for _ in pieces:
            pass


def headers(text: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first line is left out."""
    lines = text.decode().split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def read_record(pieces: Iterator[bytes]) -> dict:
    """Frame one member by its content length and verify its digests; memory is bounded by READ_BYTES
    and the headers, not by the payload."""
    held = bytearray()
    while (cut := held.find(b"\r\n\r\n")) < 0:
        held += next(pieces, b"") or _broken("no end of header")
    head = headers(bytes(held[:cut]))
    if not held.startswith(b"WARC/1."):
        raise WarcError("not a WARC record")
    left = int(head["content-length"])
    del held[: cut + 4]
    block_sha, payload_sha, http, n_payload = hashlib.sha1(), hashlib.sha1(), bytearray(), 0
    in_http = True
    while left:
        if not held:
            held += next(pieces, b"") or _broken("the block is shorter than its length")
        data = bytes(held[:left])
        del held[: len(data)]
        left -= len(data)
        block_sha.update(data)
        if in_http:
            http += data
            if (cut := http.find(b"\r\n\r\n")) < 0:
                continue
            in_http, data = False, bytes(http[cut + 4 :])
            del http[cut:]
        payload_sha.update(data)
        n_payload += len(data)
    for data in pieces:
        held += data
    if held != b"\r\n\r\n":
        raise WarcError("the block is longer than its length")
    name = lambda sha: "sha1:" + base64.b32encode(sha.digest()).decode()
    if name(block_sha) != head["warc-block-digest"]:
        raise WarcError("block digest differs")
    kind, length = head["warc-type"], int(headers(bytes(http))["content-length"])
    if kind == "response" and (name(payload_sha) != head["warc-payload-digest"] or n_payload != length):
        raise WarcError("payload digest or length differs")
    refers_to = head.get("x-refers-to-page-id")
    return {"page_id": int(head["x-page-id"]), "payload_bytes": length, "payload_digest": head["warc-payload-digest"].removeprefix("sha1:"), "record_type": kind, "refers_to": None if refers_to is None else int(refers_to)}


def _broken(why: str) -> bytes:
    raise WarcError(why)


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row, one archive a task; returns ``(path, n_records, bytes)``.

    Which record holds an equal payload first is settled on digests alone; only then do pages meet it.
    Payloads go to the tasks' workers in small batches.
    """
    small_batches(pages.sparkSession)
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload")).filter("page_id is not null")
    digests = materialize(source.select("page_id", F.sha1("payload").alias("sha1")), "digests")
    first = digests.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n_rows")).filter("n_rows > 1")
    # an id may repeat with another payload, so a record is known by both
    revisits = split_join(digests, materialize(first, "firsts"), ["sha1"], hot_limit(digests.count())).filter("page_id > first").select("page_id", "sha1", "first").distinct()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = path = None
        n = size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, refers_to = (batch.column(k)[i].as_py() for k in range(4))
                if out is None:
                    out, path = create(folder, f"part-{TaskContext.get().partitionId():06d}.warc.gz")
                data = record(page_id, url, payload, digest(payload), refers_to)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

    joined = source.withColumn("sha1", F.sha1("payload")).join(revisits, ["page_id", "sha1"], "left").select("page_id", "url", "payload", "first")
    return materialize(joined.mapInArrow(write, "path string, n_records long, bytes long"), "archives")


def read_warc(archives: DataFrame) -> DataFrame:
    """Every record of the archives, in RECORD's columns; a damaged one fails the job with its path."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with open_stream(path) as source:
                    try:
                        for pieces in members(source):
                            rows.append(read_record(pieces))
                            if len(rows) == 10_000:
                                yield pa.RecordBatch.from_pylist(rows, schema)
                                rows = []
                    except (WarcError, zlib.error, KeyError) as e:
                        raise WarcError(f"{path}: {e}") from e
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(n, "path").mapInArrow(read, RECORD)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` read back from archives.

    A record for each row. A null html is an empty payload. Of records with equal payloads the one of
    least page_id is the response; rows that repeat that id as well are responses, too. Rows that
    repeat an id with another payload are records of their own. Rows without an id are left out.
    Other columns are ignored; an empty table gives no rows.
    """
    return read_warc(write_warc(pages, new_folder(pages.sparkSession, "warc"), id_col, url_col, html_col))


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, hex, min(page_id) OVER (PARTITION BY hex) AS first FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + (CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) % 32 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""
