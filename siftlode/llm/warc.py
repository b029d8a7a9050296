"""WARC archives: one gzip member for each record, written and read by Spark tasks.

Pages with the same payload of at least a given size are stored once: the one
with the largest ``page_id`` as a ``response``, the others as ``revisit``
records that name it and carry the HTTP head alone.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.llm.shared import filesystem, importable, new_folder, stored, work_dir

GZIP = 31  # zlib's window bits with a gzip frame
CHUNK = 1 << 18
BATCH = 200
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def assign_records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to`` of each row of ``pages`` (``page_id, url, html``).

    A null html is an empty payload. A null ``page_id`` counts as smaller than
    any other; rows that repeat the largest ``page_id`` are all responses, and
    so are the rows of a group without any ``page_id``. Other columns are not
    read. Only groups of two or more meet the rows again, one row for each
    payload, in a join whose large keys Spark can split.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    shared = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = F.col("target").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("target"))
    return rows.join(shared, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("target")).alias("refers_to")
    )


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = [*headers, ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return squeeze.compress(head.encode() + block + b"\r\n\r\n") + squeeze.flush()


def page_member(page_id: int | None, url: str | None, payload: bytes, n: int, digest: str, kind: str, target: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if kind == "revisit":
        headers += [("WARC-Refers-To", f"<urn:page:{target}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        payload = b""
    return member(headers, http + payload)


def write_warc(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the rows of :func:`assign_records` as archives below ``folder``, one for each task.

    Returns the manifest (``path``, ``n_records``). An archive's name is new
    for each attempt of a task, and only the manifest names it. A task without
    rows writes none.
    """
    importable(records.sparkSession)
    new_folder(folder)
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = filesystem(folder)
        path, n, out = f"{place}/{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if out is None:
                    out = system.open_output_stream(path, compression=None)
                    info = b"format: WARC File Format 1.1\r\n"
                    out.write(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], info))
                out.write(page_member(*row, date))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n]})

    return stored(records.select(columns).mapInArrow(write, "path string, n_records long"), folder, "manifest")


def read_records(source, keep: bool = False) -> Iterator[dict]:
    """Records of an archive, in order: ``headers``, ``http`` (its head's fields), ``payload_bytes``, ``payload_sha1`` and, if kept, ``payload``.

    Bytes are inflated bit by bit; a member that holds anything but one record,
    a length that does not fit and a digest that does not agree raise ValueError.
    """
    raw = source.read(CHUNK)
    while raw:
        inflate = zlib.decompressobj(GZIP)

        def pieces() -> Iterator[bytes]:
            nonlocal raw
            while not inflate.eof:
                raw = raw or source.read(CHUNK)
                last = not raw
                out = inflate.decompress(raw, 4 * CHUNK)
                raw = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
                if out:
                    yield out
                elif last and not inflate.eof:
                    raise ValueError("the archive ends within a record")

        yield _record(pieces(), keep)
        raw = raw or source.read(CHUNK)


def _until_blank(pieces: Iterator[bytes], have: bytes) -> tuple[bytes, bytes]:
    while b"\r\n\r\n" not in have:
        piece = next(pieces, None)
        if piece is None:
            raise ValueError("a record without a whole head")
        have += piece
    head, _, rest = have.partition(b"\r\n\r\n")
    return head, rest


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def _record(pieces: Iterator[bytes], keep: bool) -> dict:
    head, rest = _until_blank(pieces, b"")
    if not head.startswith(b"WARC/1."):
        raise ValueError("a member that is no record")
    headers = _fields(head)
    left = int(headers["content-length"])
    whole, own, n, kept = hashlib.sha1(), hashlib.sha1(), 0, []
    http: dict[str, str] | None = None if headers.get("content-type", "").startswith("application/http") else {}
    before, tail = b"", b""
    while True:
        part, rest = rest[:left], rest[left:]
        left -= len(part)
        whole.update(part)
        if http is None:
            before += part
            if b"\r\n\r\n" in before:
                first, _, part = before.partition(b"\r\n\r\n")
                http = _fields(first)
            else:
                part = b""
        if part:
            own.update(part)
            n += len(part)
            if keep:
                kept.append(part)
        tail += rest
        rest = next(pieces, None)
        if rest is None:
            break
    if left or tail != b"\r\n\r\n":
        raise ValueError("a record's content does not have the stated length")
    record = {"headers": headers, "http": http or {}, "payload_bytes": n, "payload_sha1": own.hexdigest(), "payload": b"".join(kept) if keep else None}
    stated = headers.get("warc-block-digest")
    if stated and stated != f"sha1:{whole.hexdigest()}":
        raise ValueError("a block's digest does not agree")
    if headers["warc-type"] == "response" and headers.get("warc-payload-digest") != f"sha1:{record['payload_sha1']}":
        raise ValueError("a payload's digest does not agree")
    return record


def _page(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def read_warc(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The page records of the archives: ``page_id, url, payload_bytes,
    payload_digest, record_type, refers_to`` and, if asked for, ``payload``
    (null in a revisit). Size and digest of a revisit are those its heads state."""
    importable(manifest.sparkSession)
    names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * with_payload
    schema = RECORD + ", payload binary" * with_payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(folder)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        rows: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(path, compression=None) as source:
                    for x in read_records(source, with_payload):
                        h, kind = x["headers"], x["headers"]["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        n = int(x["http"]["content-length"]) if kind == "revisit" else x["payload_bytes"]
                        row = (_page(h["warc-record-id"]), h.get("warc-target-uri"), n, h["warc-payload-digest"].removeprefix("sha1:"), kind, _page(h.get("warc-refers-to")))
                        rows.append(row + ((x["payload"] if kind == "response" else None),) * with_payload)
                        if len(rows) >= BATCH:
                            yield batch_of(rows)
                            rows = []
        if rows:
            yield batch_of(rows)

    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(read, schema)


def warc_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` as archives in a new shared folder, and read them back."""
    folder = work_dir(pages.sparkSession, "warc")
    return read_warc(write_warc(assign_records(pages), folder), folder, **options)
