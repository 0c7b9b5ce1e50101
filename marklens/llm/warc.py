"""WARC archives, index first.

Every task writes one compressed archive and returns an index row (file, offset,
length, URL, digest) per record. The index is a table in the shared folder; rows of
tasks that failed are not in it, so their files are never read. Reading starts from the
index: the byte ranges of the selected records are sorted, neighbouring ones are read
together, and each record is parsed from its range.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism, scratch, slices, stored

#: Bytes of a file whose records are read by one group, and the gap still read over.
SPAN, GAP = 4 << 20, 64 << 10
#: Compressed bytes that one task reads, about.
TASK = 32 << 20
#: An archive is closed and a new one begun beyond this size.
ARCHIVE = 1 << 30
DATE = "2024-01-01T00:00:00Z"

# Fixed value: the profile of a revisit by equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, file string, offset long, length long, url string, digest string, payload_bytes long, record_type string"


def _open(uri: str):
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pyarrow.fs.FileSystem.from_uri(uri)


def _name(page: int | None) -> str:
    return f"<urn:x-page:{'' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> tuple[bytes, str]:
    """One uncompressed record and the digest of its payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse(data: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    number = lambda name: int(n) if (n := fields.get(name, "")[len("<urn:x-page:") : -1]) else None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest or len(payload) != size:
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return number("WARC-Record-ID"), size, digest, fields["WARC-Type"], number("WARC-Refers-To")


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to and revisit.

    Equal payloads (by SHA-256) of at least ``least`` bytes point to the largest page_id
    among them. Rows repeated with that page_id are responses too.
    """
    p = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"),
        F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("_key", F.unhex(F.sha2("payload", 256)))
    # only digests are counted; the few that repeat then meet the rows
    first = p.groupBy("_key").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    p = p.join(first.drop("_n"), "_key", "left")
    revisit = (F.octet_length("payload") >= least) & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return p.select("page_id", "url", "payload", F.when(revisit, F.col("_first")).alias("refers_to"), revisit.alias("revisit"))


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write archives below ``folder`` and return the stored index."""

    def run(batches):
        files, _ = _open(folder)
        out, path, at = None, "", 0
        for batch in slices(batches, 256):
            rows = []
            for page, url, payload, refers_to, revisit in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    path, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    files.create_dir(_open(folder)[1])
                    out = files.open_output_stream(_open(path)[1], compression=None)
                data, digest = record(page, url, payload, refers_to, revisit)
                press = zlib.compressobj(4, zlib.DEFLATED, 31)
                data = press.compress(data) + press.flush()
                out.write(data)
                rows.append((page, path, at, len(data), url, digest, len(payload), "revisit" if revisit else "response"))
                at += len(data)
                if at > ARCHIVE:
                    out.close()
                    out = None
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                names = [f.split()[0] for f in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        if out is not None:
            out.close()

    return stored(records.mapInArrow(run, INDEX), "warc-index")


def fetch(index: DataFrame) -> DataFrame:
    """Read the records that ``index`` selects, by coalesced byte ranges."""

    def run(table: pa.Table) -> pa.Table:
        path = table.column("file")[0].as_py()
        spans = sorted(zip(table.column("offset").to_pylist(), table.column("length").to_pylist(), strict=True))
        runs: list[list] = []
        for offset, length in spans:
            if runs and offset - runs[-1][1] <= GAP:
                runs[-1][1] = max(runs[-1][1], offset + length)
                runs[-1][2].append((offset, length))
            else:
                runs.append([offset, offset + length, [(offset, length)]])
        rows = []
        files, inner = _open(path)
        with files.open_input_file(inner) as source:
            for start, end, inside in runs:
                data = source.read_at(end - start, start)
                rows += [parse(zlib.decompress(data[o - start : o - start + n], 31)) for o, n in inside]
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    spans = index.select("file", "offset", "length", F.floor(F.col("offset") / SPAN).alias("_span"))
    # an index row is small but stands for a record: tasks are counted by the bytes behind it
    size = index.agg(F.sum("length")).first()[0] or 0
    spans = spans.repartition(max(parallelism(index.sparkSession), size // TASK + 1), "file", "_span")
    return spans.groupBy("file", "_span").applyInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write a record per page row, then read all of them back.

    Null HTML is an empty payload, null URLs have no URI line, and an empty table gives
    an empty index and result.
    """
    folder = scratch(pages.sparkSession, "warc")
    return fetch(write(with_revisits(pages), folder))
