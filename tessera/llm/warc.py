"""WARC archives: writer with revisit records, and a splittable reader of gzip members.

Writing. Every row becomes one record in a gzip member of its own. Rows with equal
payloads are found by their digest: the row with the smallest id writes a
``response``, the others a ``revisit`` that refers to it (of repeated ids one row
alone is the response). Each task writes one archive under a name no other attempt
uses and reports it; only reported archives belong to the result, so a task that
runs twice leaves a file that nothing reads.

Reading. A task gets a byte range. It looks for gzip magic, takes a candidate only
if the member there decodes to a WARC header, owns the records whose member starts
inside its range, and reads past its end to finish the last. Ranges of an archive
are read independently, so one large archive is read by many tasks. The tail of a
damaged member is skipped to the next valid one.

Null payloads are written as empty ones, null urls as an empty header; a null id
gives the id ``null``. Further columns are left out. Folders are opened through
``pyarrow.fs``, so any store with a URI it knows will do.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import materialize, scratch, small_slices

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPLIT_BYTES = 8 << 20
_DATE = "1970-01-01T00:00:00Z"
_READ = 1 << 18
_ID = "urn:tessera:record:"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(lines: list[tuple[str, str]], block: int) -> bytes:
    clean = lambda v: v.replace("\r", " ").replace("\n", " ")
    return VERSION + b"\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in [*lines, ("Content-Length", str(block))]).encode("utf-8", "surrogatepass") + b"\r\n"


def make_record(record_id: str, url: str, payload: bytes, refers_to: str | None, digest: str | None = None) -> bytes:
    """One response or revisit record, uncompressed. A revisit's block is the HTTP header alone, which keeps the length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    lines = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{_ID}{record_id}>"), ("WARC-Date", _DATE),
             ("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest or digest_of(payload)}")]
    if refers_to is not None:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_ID}{refers_to}>")]
    return _header(lines, len(block)) + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse_record(data: bytes) -> dict | None:
    """Header fields and payload of an uncompressed record, None if it is none or is cut short."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"WARC/"):
        return None
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    if not (size := fields.get("content-length", "")).isdigit() or len(rest) < int(size):
        return None
    block = rest[:int(size)]
    length = None
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        for line in http.split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            if k.strip().lower() == b"content-length" and v.strip().isdigit():
                length = int(v)
    else:
        payload = block
    bare = lambda x: x.strip("<>").removeprefix(_ID)
    return {"record_type": fields.get("warc-type"), "record_id": bare(fields.get("warc-record-id", "")), "target_uri": fields.get("warc-target-uri"),
            "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"), "payload_bytes": len(payload) if length is None else length,
            "refers_to": bare(fields["warc-refers-to"]) if "warc-refers-to" in fields else None, "payload": payload}


def _member_at(f, start: int) -> tuple[bytes, int] | None:
    """The decoded member that starts at ``start`` and where it ends; None unless it is whole and opens a WARC record."""
    f.seek(start)
    z, out, used = zlib.decompressobj(31), io.BytesIO(), 0
    try:
        while not z.eof:
            chunk = f.read(_READ if used else 1 << 12)
            if not chunk:
                return None
            used += len(chunk)
            out.write(z.decompress(chunk))
            if out.tell() >= 5 and not out.getbuffer()[:5] == b"WARC/":
                return None
    except zlib.error:
        return None
    return out.getvalue(), start + used - len(z.unused_data)


def read_range(f, start: int, end: int) -> Iterator[tuple[int, dict]]:
    """Offset and record of each member that starts in [start, end)."""
    at = start
    while at < end:
        if (got := _member_at(f, at)) and (record := parse_record(got[0])):
            yield at, record
            at = got[1]
            continue
        at += 1
        while at < end:  # the next magic; it may lie across the end of what is read
            f.seek(at)
            buf = f.read(min(_READ, end - at + len(MAGIC) - 1))
            if (hit := buf.find(MAGIC)) >= 0:
                at += hit
                break
            if len(buf) < len(MAGIC):
                return
            at += len(buf) - len(MAGIC) + 1


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                 min_revisit_bytes: int = 0) -> DataFrame:
    """id, url, payload, refers_to: payloads of at least ``min_revisit_bytes`` bytes that occur again are revisits.

    One small row a digest is aggregated, partly before the shuffle; only digests
    that occur again meet the rows in a join that Spark may split by skew.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"),
                        F.monotonically_increasing_id().alias("row")).withColumn("sha", F.unhex(F.sha1("payload")))
    first = (rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("sha")
             .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first"))
             .where("n > 1").select("sha", "first"))
    joined = rows.join(first, "sha", "left")
    again = F.col("first").isNotNull() & (F.octet_length("payload") >= min_revisit_bytes) & (F.col("first.row") != F.col("row"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    return joined.select(text(F.col("id")).alias("id"), F.coalesce("url", F.lit("")).alias("url"), "payload",
                         F.when(again, text(F.col("first.id"))).alias("refers_to"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``plan_records`` rows, an archive a task; returns path, bytes and n_records of each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        path, size, n, out = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0, None
        for whole in batches:
            for b in small_slices(whole):
                for i, url, payload, ref in zip(*(b.column(c).to_pylist() for c in ("id", "url", "payload", "refers_to"))):
                    if out is None:
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(path, compression=None)
                    data = gzip_member(make_record(i, url, payload, ref))
                    out.write(data)
                    size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "n_records": [n]})

    # written once: reading the list again must not write the archives again
    return materialize(records.mapInArrow(run, "path string, bytes bigint, n_records bigint"), "warc-list")


RECORD = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()),
                    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())])


def read_archives(archives: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """Records of the archives listed by path and bytes, whose paths are in the store that ``folder`` names."""
    splits = (archives.where("bytes > 0").select("path", F.explode(F.expr(f"sequence(0L, bytes - 1, {split_bytes}L)")).alias("start"), "bytes")
              .withColumn("end", F.least(F.col("start") + split_bytes, "bytes")).drop("bytes"))
    n = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        for b in batches:
            for path, start, end in zip(*(b.column(c).to_pylist() for c in ("path", "start", "end"))):
                rows, size = [], 0
                with store.open_input_file(path) as f:
                    for at, r in read_range(f, start, end):
                        rows.append(r | {"path": path, "offset": at, "payload": r["payload"] if with_payload else None})
                        size += len(r["payload"]) * with_payload + 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=RECORD)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=RECORD)

    return splits.repartition(n).mapInArrow(run, "path string, offset bigint, record_type string, record_id string, target_uri string, "
                                                 "payload_digest string, payload_bytes bigint, refers_to string, payload binary")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0,
               split_bytes: int = SPLIT_BYTES, with_payload: bool = False) -> DataFrame:
    """Write archives below the shared folder and read them back."""
    folder = scratch(pages.sparkSession, "warc")
    archives = write_archives(plan_records(pages, id_col, url_col, payload_col, min_revisit_bytes), folder)
    return read_archives(archives, folder, split_bytes, with_payload)
