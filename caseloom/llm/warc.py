"""WARC archives with an index: every record is found by file, offset and length.

Each task writes its rows as gzip members into archive files of its own in a shared folder and
returns their index entries; a task that runs again writes new files, and only the entries of the
successful run are kept. Reading goes by the index: sorted entries of a file that lie close
together become one read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import materialise, shared_folder, slices

REVISIT_BYTES = 100
ARCHIVE_BYTES = 256_000_000
# Records at most this far apart are read together, in reads of at most about this size.
GAP_BYTES = 65_536
READ_BYTES = 4_000_000
INDEX = (
    "archive string, offset bigint, length bigint, url string, payload_digest string, page_id bigint,"
    " record_type string, refers_to bigint"
)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_record_types(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, payload_digest, record_type, refers_to`` for each page.

    Of equal payloads of at least ``REVISIT_BYTES``, the smallest page_id is the response.
    """
    rows = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
        F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("payload_digest"),
    )
    large = F.octet_length("payload") >= REVISIT_BYTES
    repeated = materialise(
        rows.where(large).groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1").drop("_n"),
        "repeated",
    )
    again = large & (F.col("page_id").isNull() | (F.col("page_id") != F.col("_first"))) & F.col("_first").isNotNull()
    return rows.join(repeated, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("_first")).alias("refers_to"),
    )


def header_value(text: str) -> str:
    """``text`` without what would end a header line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC record; a revisit has the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_value(url)}")
    lines += [
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        lines += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {refers_to}')}>",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def zipped(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html); returns the index.

    A null html has an empty payload, a null url no target header, a null page_id no id header and
    never is what others refer to. Rows with the smallest id of their payload are all responses.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        out, name, offset = None, "", 0
        for batch in batches:
            for part in slices(batch, "payload"):
                archives, offsets, lengths = [], [], []
                columns = [part.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")]
                for values in zip(*columns):
                    if out is None or offset >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    data = zipped(record(*values))
                    out.write(data)
                    archives.append(name)
                    offsets.append(offset)
                    lengths.append(len(data))
                    offset += len(data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(archives, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())]
                    + [part.column(c) for c in ("url", "payload_digest", "page_id", "record_type", "refers_to")],
                    ["archive", "offset", "length", "url", "payload_digest", "page_id", "record_type", "refers_to"],
                )
        if out is not None:
            out.close()

    return materialise(with_record_types(pages).mapInArrow(write, INDEX), "warc-index")


def planned_reads(index: DataFrame) -> DataFrame:
    """``archive, start, stop, offsets, lengths``: entries of a file coalesced into sorted reads.

    A file has a bounded size, so the windows over its entries do, too.
    """
    by_file = Window.partitionBy("archive").orderBy("offset")
    gap = F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(by_file)
    block = F.floor(F.col("offset") / READ_BYTES)
    breaks = (F.coalesce(gap, F.lit(0)) > GAP_BYTES) | (block != F.coalesce(F.lag(block).over(by_file), block))
    return (
        index.select("archive", "offset", "length", breaks.cast("int").alias("_break"))
        .withColumn("_read", F.sum("_break").over(by_file))
        .groupBy("archive", "_read")
        .agg(
            F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"),
            F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("entries"),
        )
        .select("archive", "start", "stop", F.col("entries.offset").alias("offsets"), F.col("entries.length").alias("lengths"))
    )


def parsed(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http_head, _, payload = rest[: int(warc["Content-Length"])].partition(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in http_head.decode().split("\r\n")[1:])
    return warc, http, payload


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to`` from the archives.

    Reads only the records of ``index``. The digest of a response is worked out anew from its
    payload; a revisit has no payload, and its digest and size are those of the full one.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{root}/{row['archive']}") as file:
                    data = file.read_at(row["stop"] - row["start"], row["start"])
                rows = []
                for offset, length in zip(row["offsets"], row["lengths"]):
                    at = offset - row["start"]
                    warc, http, payload = parsed(data[at : at + length])
                    revisit = warc["WARC-Type"] == "revisit"
                    stored = warc["WARC-Payload-Digest"].removeprefix("sha256:")
                    digest = stored if revisit else hashlib.sha256(payload).hexdigest()
                    if digest != stored or not revisit and len(payload) != int(http["Content-Length"]):
                        raise ValueError(f"damaged record in {row['archive']} at {offset}")
                    page, refers = warc.get("X-Page-ID"), warc.get("X-Refers-To-Page-ID")
                    rows.append({
                        "page_id": None if page is None else int(page), "url": warc.get("WARC-Target-URI"),
                        "payload": None if revisit else payload, "payload_bytes": int(http["Content-Length"]),
                        "payload_digest": digest, "record_type": warc["WARC-Type"],
                        "refers_to": None if refers is None else int(refers),
                    })
                yield pa.RecordBatch.from_pylist(rows, schema=READ)

    # The list of reads is small and the reads are not, so their partitions are not left to sizes.
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranges = planned_reads(index).repartition(n, "archive", "start")
    return ranges.mapInArrow(
        read,
        "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string,"
        " record_type string, refers_to bigint",
    )


READ = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
])


def archive_folder(pages: DataFrame) -> str:
    """A new folder for archives in the shared folder."""
    return shared_folder(pages.sparkSession, "warc")
