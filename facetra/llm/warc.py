"""WARC archives: one gzip member per record, written and read sequentially.

``write`` deals records to archive files, one or more per task, in the shared folder; equal payloads are stored once
and the others become revisit records. ``read`` goes through an archive chunk by chunk with an incremental zlib
decompressor, cuts the record by its Content-Length and verifies block and payload digests. Only one chunk and one
record are in memory.

Of records with equal payloads of at least ``min_bytes`` the one with the largest id is the response. Defined results:
a null payload is the empty payload; null ids are revisits where a record with an id has the payload, else responses;
repeated rows that tie for the largest id are all responses; a null URL leaves the header out; line breaks in a URL are
percent-encoded; further columns are not read; an empty table writes no archive and reads as an empty table.
Files of a lost or repeated task attempt are never read: the manifest lists what the winning attempts wrote.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from facetra.llm.common import ship
from facetra.storage import new_folder, stored

MIN_BYTES = 1000
CHUNK = 1 << 16
#: An archive is closed after so many compressed bytes, as is usual for crawls.
ROLL_BYTES = 1 << 30
#: Tasks that records of one payload are dealt to.
SALTS = 32
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = b"\r\n"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, keeper: int | None, revisit: bool, level: int = 6) -> bytes:
    """One gzip member. keeper: the id of the response that a revisit refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = _sha1(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(keeper, digest)}", f"X-Refers-To-Page-ID: {keeper}"]
    head += [f"WARC-Payload-Digest: {digest}", f"WARC-Block-Digest: {_sha1(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(BREAK.join([*[h.encode("utf-8", "replace") for h in head], BREAK]) + block + BREAK * 2) + z.flush()


def members(source, chunk: int = CHUNK) -> Iterator[bytes]:
    """The content of each gzip member of a file-like source, one after the other."""
    z, parts, fed, data = zlib.decompressobj(31), [], False, source.read(chunk)
    while data:
        parts.append(z.decompress(data))
        fed = True
        if z.eof:
            yield b"".join(parts)
            data = z.unused_data or source.read(chunk)
            z, parts, fed = zlib.decompressobj(31), [], False
        else:
            data = source.read(chunk)
    if fed:
        raise ValueError("the archive ends within a record")


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])} | {"": lines[0]}


def parse(content: bytes) -> dict:
    """A record's headers and payload; ValueError where framing or a digest is wrong."""
    head, found, rest = content.partition(BREAK * 2)
    h = _headers(head)
    if not found or not h[""].startswith("WARC/"):
        raise ValueError("not a WARC record")
    n = int(h["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != BREAK * 2:
        raise ValueError("content-length and record differ")
    if _sha1(block) != h["warc-block-digest"]:
        raise ValueError("block digest differs")
    http, _, payload = block.partition(BREAK * 2)
    length = int(_headers(http)["content-length"])
    if h["warc-type"] == "response" and (len(payload) != length or _sha1(payload) != h["warc-payload-digest"]):
        raise ValueError("payload and its digest or length differ")
    number = lambda k: int(h[k]) if k in h else None
    return {
        "page_id": number("x-page-id"),
        "url": h.get("warc-target-uri"),
        "payload_bytes": length,
        "payload_digest": base64.b32decode(h["warc-payload-digest"].partition(":")[2]).hex(),
        "record_type": h["warc-type"],
        "refers_to": number("x-refers-to-page-id"),
        "payload": payload if h["warc-type"] == "response" else None,
    }


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_BYTES, level: int = 6) -> DataFrame:
    """Writes the archives; gives the manifest (path, n_records, n_bytes), already stored."""
    spark = pages.sparkSession
    ship(spark)
    folder = new_folder(spark, "warc")
    body = F.encode(F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumns({"digest": F.sha1("body"), "n": F.octet_length("body")})
    same = rows.where(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies"))
    same = same.where((F.col("copies") > 1) & F.col("keeper").isNotNull()).drop("copies")
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")  # a popular payload's records go to so many tasks
    found = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(same.select("*", salt), ["digest", "n", "salt"], "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    ready = found.select("page_id", "url", "body", "keeper", revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from facetra.llm import warc as own

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, n, size, listed = None, "", 0, 0, []
        for batch in batches:
            for page, link, data, keeper, again in zip(*batch.columns, strict=True):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}")
                raw = own.record(page.as_py(), link.as_py(), data.as_py(), keeper.as_py(), again.as_py(), level)
                out.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= own.ROLL_BYTES:
                    out.close()
                    out = listed.append((name, n, size))
        if out is not None:
            out.close()
            listed.append((name, n, size))
        if listed:
            names, counts, sizes = zip(*listed, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x}" for x in names]), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["path", "n_records", "n_bytes"])

    return stored(ready.mapInArrow(run, "path string, n_records long, n_bytes long"), "manifest")


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the manifest's archives, a task per archive."""
    spark = manifest.sparkSession
    ship(spark)
    schema = StructType.fromDDL(RECORD + (", payload binary" if with_payload else ""))
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from facetra.llm import warc as own

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in schema.names], schema.names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_stream(at) as source:
                    for content in own.members(source):
                        rows.append(own.parse(content))
                        if not with_payload:
                            del rows[-1]["payload"]
                        size += len(content) if with_payload else 200
                        if size > 4_000_000:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = max(1, manifest.count())
    return manifest.select("path").repartition(files).mapInArrow(run, schema)
