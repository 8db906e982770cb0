"""WARC archives of pages: write, index, and read selected records by coalesced byte ranges.

Each record is a gzip member of its own. A writing task keeps one archive open at a time in the shared folder and
returns one index row per record; only the index rows of tasks that succeeded are committed, so the archive of a lost
attempt is never read. Reading sorts the wanted index rows by file and offset, and neighbours in a file become one read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterfair.llm.common import staged
from counterfair.session import shared_path

INDEX = (
    "page_id BIGINT, url STRING, file STRING, offset BIGINT, length BIGINT, digest STRING, record_type STRING,"
    " refers_to BIGINT"
)
RECORDS = INDEX + ", payload_bytes BIGINT, payload BINARY"
DATE = "2024-01-01T00:00:00Z"
ARCHIVE_BYTES = 256 << 20
READ_BYTES, GAP_BYTES, ROWS_OUT = 8 << 20, 64 << 10, 16 << 20
_RECORD_ID = "<urn:x-page:{}>"


def open_store(path: str):
    """File system and path of a URI; a path without scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and path[6] != "/" else path)


def classify(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, url, payload, digest, record_type, refers_to) of (page_id, url, html).

    Of payloads equal by SHA-1 with at least ``min_bytes`` bytes, the one with the largest page_id is the response.
    Where that id is repeated or null on all of them, rows with that id are all responses.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= min_bytes
    # Small rows only: the payload is not needed to find the owner of a digest.
    ids = pages.select("page_id", body.alias("_p")).where(F.octet_length("_p") >= min_bytes)
    owners = (
        ids.select("page_id", F.sha1("_p").alias("digest"))
        .groupBy("digest")
        .agg(F.max("page_id").alias("_owner"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
    )
    joined = rows.join(owners, "digest", "left")
    revisit = large & F.col("_owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_owner"))
    return joined.select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_owner")).alias("refers_to"),
    )


def record(page_id, url, payload: bytes, digest: str, record_type: str, refers_to) -> bytes:
    """One uncompressed record. A revisit holds the HTTP head alone, whose Content-Length is that of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if record_type == "response" else http
    target = "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: {_RECORD_ID.format('' if page_id is None else page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {target}")
    if record_type == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {_RECORD_ID.format(refers_to)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one uncompressed record."""
    at = data.index(b"\r\n\r\n")
    fields = _fields(data[:at])
    block = data[at + 4 : at + 4 + int(fields["content-length"])]
    end = block.index(b"\r\n\r\n")
    return fields, _fields(block[:end]), block[end + 4 :]


def _page(record_id: str | None) -> int | None:
    digits = (record_id or "")[len("<urn:x-page:") : -1]
    return int(digits) if digits else None


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write ``records`` (as of ``classify``) to archives under ``folder``; returns the index, itself a staged table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, out, name, at = None, None, "", 0
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                if out is None:
                    name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    store, path = open_store(name)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out, at = store.open_output_stream(path, compression=None), 0
                raw = record(x["page_id"], x["url"], x["payload"], x["digest"], x["record_type"], x["refers_to"])
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(raw) + packer.flush()
                out.write(member)
                rows.append((x["page_id"], x["url"], name, at, len(member), x["digest"], x["record_type"], x["refers_to"]))
                at += len(member)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_pylist([dict(zip(_INDEX_SCHEMA.names, r)) for r in rows], schema=_INDEX_SCHEMA)
        if out is not None:
            out.close()

    return staged(records.mapInArrow(run, INDEX), "warc-index")


_INDEX_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64())]
    + [("length", pa.int64()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)
_RECORD_SCHEMA = pa.schema([*_INDEX_SCHEMA, ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def read(selected: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the ``selected`` index rows, each checked against its digest.

    Ranges of a file that lie within GAP_BYTES of each other are read at once, up to READ_BYTES. ``payload_bytes`` of a
    revisit is that of the full payload it stands for; ``payload`` is null for it, and for all if not asked for.
    """

    def rows_of(run: list[dict], data: bytes, base: int) -> Iterator[dict]:
        for x in run:
            raw = zlib.decompress(data[x["offset"] - base : x["offset"] - base + x["length"]], 31)
            fields, http, body = parse(raw)
            kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
            if kind == "response" and (hashlib.sha1(body).hexdigest() != digest or digest != x["digest"]):
                raise ValueError(f"{x['file']} at {x['offset']}: the payload does not match its digest")
            yield {
                **x,
                "page_id": _page(fields["warc-record-id"]),
                "digest": digest,
                "record_type": kind,
                "refers_to": _page(fields.get("warc-refers-to")),
                "payload_bytes": int(http["content-length"]),
                "payload": body if payload and kind == "response" else None,
            }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handles: dict[str, object] = {}
        held: list[dict] = []
        done: list[dict] = []
        size = 0

        def fetch() -> Iterator[dict]:
            name, base = held[0]["file"], held[0]["offset"]
            if name not in handles:
                for h in handles.values():  # rows are sorted by file
                    h.close()
                handles.clear()
                store, path = open_store(name)
                handles[name] = store.open_input_file(path)
            data = handles[name].read_at(held[-1]["offset"] + held[-1]["length"] - base, base)
            yield from rows_of(held, data, base)
            held.clear()

        def full() -> Iterator[dict]:
            nonlocal size
            for x in fetch():
                done.append(x)
                size += 500 + len(x["payload"] or b"")
                if size >= ROWS_OUT:
                    yield pa.RecordBatch.from_pylist(done, schema=_RECORD_SCHEMA)
                    done.clear()
                    size = 0

        for batch in batches:
            for x in batch.to_pylist():
                if held and (
                    x["file"] != held[0]["file"]
                    or x["offset"] - held[-1]["offset"] - held[-1]["length"] > GAP_BYTES
                    or x["offset"] + x["length"] - held[0]["offset"] > READ_BYTES
                ):
                    yield from full()
                held.append(x)
        if held:
            yield from full()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_RECORD_SCHEMA)
        for h in handles.values():
            h.close()

    order = ["file", "offset"]
    return selected.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, RECORDS)


def archive(pages: DataFrame, min_bytes: int = 1000, folder: str | None = None) -> DataFrame:
    """Write all ``pages`` (page_id, url, html) as records and return their index.

    A null html is an empty payload, a null url leaves out the target; each row, repeated ids included, has a record of
    its own; an empty table gives an empty index.
    """
    spark: SparkSession = pages.sparkSession
    return write(classify(pages, min_bytes), folder or shared_path(spark, "warc"))
