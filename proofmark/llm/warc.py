"""WARC archives: a normaliser for monolithic gzip files, with sidecar offset indexes.

``write_monolithic`` makes archives whose whole file is one gzip stream.  ``normalise`` inflates
such a stream once, in pieces, and rewrites each record as a gzip member of its own; beside the new
file goes a sidecar with the offset and length of every member.  ``read_normalised`` reads the
records back through the sidecar, each member by itself.

Of records with equal payloads (same SHA-1 and length, at least ``min_bytes`` long) the one with
the smallest page_id stays a response, the others become revisits without payload.  The choice is
made from the manifest of digests, so no payload is shuffled; the commonest payloads' rows are joined where they lie.

Files live in the shared folder and are reached by its URI; each task attempt writes names of its
own and only what a finished attempt reports is read, so lost executors leave orphans at most.
Memory: one record and one piece of a stream at a time.  An archive is closed at ``ARCHIVE_BYTES`` or
``ARCHIVE_RECORDS``, whichever is first.

Defined results: null html is an empty payload; null url gives no target header; line breaks in a
url are percent-encoded; null page_ids come last and refer by null; of rows with one page_id and one payload the
first written (the least archive name and place) is the response; rows that repeat each get a record; an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_unique, materialize, shared_dir

ARCHIVE_BYTES = 32 << 20
ARCHIVE_RECORDS = 20_000
PIECE = 1 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def filesystem(uri: str):
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def attempt_name() -> str:
    c = TaskContext.get()
    return f"{c.partitionId():06d}-{c.taskAttemptId()}"


def record(headers: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def http_block(payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def split_head(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and what follows the first blank line."""
    head, _, rest = data.partition(b"\r\n\r\n")
    return dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x), rest


def inflate(stream, size: int = PIECE) -> Iterator[bytes]:
    """The content of a gzip file, whether of one member or many, in bounded pieces."""
    z = zlib.decompressobj(31)
    while data := stream.read(size):
        more = True
        while more:
            out = z.decompress(data, size)
            yield out
            data = z.unconsumed_tail
            if z.eof:
                data = z.unused_data
                z = zlib.decompressobj(31)
            more = bool(data) or len(out) == size


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an inflated archive."""
    held = bytearray()
    headers: dict[str, str] | None = None
    need = 0
    for piece in pieces:
        held += piece
        while True:
            if headers is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                headers, _ = split_head(bytes(held[: end + 4]))
                del held[: end + 4]
                need = int(headers["Content-Length"]) + 4
            if len(held) < need:
                break
            yield headers, bytes(held[: need - 4])
            del held[:need]
            headers = None
    if headers is not None or held.strip():
        raise ValueError("the archive ends within a record")


MANIFEST = "page_id long, archive string, ordinal int, payload_digest string, payload_bytes long"


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, html) to archives of one gzip stream each; returns the manifest."""
    def run(batches):
        out = rows = None
        seq = 0

        def close():
            out.write(z.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["page_id", "archive", "ordinal", "payload_digest", "payload_bytes"])

        fs, root = filesystem(folder)
        for batch in batches:
            for page, url, html in zip(*(batch.column(i) for i in range(3))):
                page, url, payload = page.as_py(), url.as_py(), (html.as_py() or "").encode()
                if out is None:
                    name = f"mono-{attempt_name()}-{seq:05d}.warc.gz"
                    fs.create_dir(root, recursive=True)
                    out, rows, size, z, seq = fs.open_output_stream(f"{root}/{name}", compression=None), [], 0, zlib.compressobj(1, zlib.DEFLATED, 31), seq + 1
                sha = digest(payload)
                headers = {"WARC-Type": "response", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{len(rows)}')}>", "WARC-Date": "2024-01-01T00:00:00Z"}
                if url is not None:
                    headers["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
                headers |= {"WARC-Payload-Digest": f"sha1:{sha}", "Content-Type": "application/http; msgtype=response", "X-Payload-Length": str(len(payload))}
                if page is not None:
                    headers["X-Page-Id"] = str(page)
                data = record(headers, http_block(payload))
                out.write(z.compress(data))
                size += len(data)
                rows.append((page, name, len(rows), sha, len(payload)))
                if size >= ARCHIVE_BYTES or len(rows) >= ARCHIVE_RECORDS:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return materialize(pages.select("page_id", "url", "html").mapInArrow(run, MANIFEST), folder, "manifest")


def choose_revisits(manifest: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(archive, revisits): for every archive the ordinals of its revisits and the response they refer to."""
    order = F.struct(F.col("page_id").isNull(), "page_id", "archive", "ordinal")
    first = (manifest.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes")
             .agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1"))
    again = (join_unique(manifest, first.drop("n"), ["payload_digest", "payload_bytes"]).where(order != F.col("first"))
             .groupBy("archive").agg(F.collect_list(F.struct("ordinal", F.col("first.page_id").alias("page_id"), F.col("first.archive").alias("archive"), F.col("first.ordinal").alias("at"))).alias("revisits")))
    return manifest.groupBy("archive").agg(F.count("*").alias("records")).join(again, "archive", "left")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """(path, sidecar, records) of the rewritten archives."""
    def run(batches):
        fs, root = filesystem(folder)
        fs.create_dir(f"{root}/normalised", recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                turn = {r["ordinal"]: r for r in row["revisits"] or []}
                name = f"{row['archive'].removesuffix('.warc.gz')}-{attempt_name()}"
                offset = n = 0
                with fs.open_input_stream(f"{root}/{row['archive']}", compression=None) as stream, \
                        fs.open_output_stream(f"{root}/normalised/{name}.warc.gz", compression=None) as out, \
                        fs.open_output_stream(f"{root}/normalised/{name}.idx") as side:
                    for headers, block in records(inflate(stream)):
                        headers.pop("Content-Length")
                        if first := turn.get(n):
                            headers |= {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                                        "WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{first['archive']}/{first['at']}')}>"}
                            if first["page_id"] is not None:
                                headers["X-Refers-To-Page-Id"] = str(first["page_id"])
                            block = block.partition(b"\r\n\r\n")[0] + b"\r\n\r\n"
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(record(headers, block)) + z.flush()
                        out.write(member)
                        side.write(json.dumps({"offset": offset, "length": len(member), "id": headers["WARC-Record-ID"], "type": headers["WARC-Type"], "uri": headers.get("WARC-Target-URI")}).encode() + b"\n")
                        offset += len(member)
                        n += 1
                if n != row["records"]:
                    raise ValueError(f"{row['archive']}: {n} records, not {row['records']}")
                yield pa.RecordBatch.from_arrays([pa.array([f"normalised/{name}.warc.gz"]), pa.array([f"normalised/{name}.idx"]), pa.array([n], pa.int64())], names=["path", "sidecar", "records"])

    return run_spread(archives, run, "path string, sidecar string, records long")


def run_spread(files: DataFrame, run, schema: str) -> DataFrame:
    """One task for a few files, however small the table that lists them is."""
    spark = files.sparkSession
    most = 4 * spark.sparkContext.defaultParallelism
    n = max(1, files.count())
    return files.repartition(min(n, max(most, n // 16))).mapInArrow(run, schema)


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, path string, member_offset long, member_length long"


def read_normalised(files: DataFrame, folder: str) -> DataFrame:
    """A row a record, read member by member through the sidecars; every digest is checked."""
    def run(batches):
        fs, root = filesystem(folder)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for batch in batches:
            for f in batch.to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{f['sidecar']}") as side:
                    entries = [json.loads(x) for x in side.read().splitlines()]
                with fs.open_input_file(f"{root}/{f['path']}") as file:
                    for e in entries:
                        file.seek(e["offset"])
                        headers, rest = split_head(zlib.decompress(file.read(e["length"]), 31))
                        block = rest[: int(headers["Content-Length"])]
                        sha, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
                        if headers["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if (digest(payload), len(payload)) != (sha, size):
                                raise ValueError(f"{f['path']} at {e['offset']}: the payload differs from its digest")
                        number = lambda k: int(headers[k]) if k in headers else None
                        rows.append((number("X-Page-Id"), size, sha, headers["WARC-Type"], number("X-Refers-To-Page-Id"), headers.get("WARC-Target-URI"), f["path"], e["offset"], e["length"]))
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run_spread(files, run, RECORDS)


def round_trip(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write, normalise and read back; a row a page."""
    folder = folder or shared_dir(pages.sparkSession)
    manifest = write_monolithic(pages, folder)
    archives = materialize(choose_revisits(manifest, min_bytes), folder, "archives")
    files = materialize(normalise(archives, folder), folder, "files")
    return read_normalised(files, folder)


def op2(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB has no base-32 and its sha1() is hex: 20 bytes are 32 digits of 5 bits.
ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS h FROM p),
e AS (SELECT *, list_transform(range(40), lambda i: ('0x' || h[i + 1])::INT) AS x FROM d),
f AS (SELECT page_id, payload_bytes, h,
      list_aggregate(list_transform(range(32), lambda j: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
        ((((x[(5 * j) // 4 + 1] * 16 + coalesce(x[(5 * j) // 4 + 2], 0)) >> (3 - (5 * j) % 4)) & 31) + 1)::INT]), 'string_agg', '') AS payload_digest FROM e)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = min(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
FROM f WINDOW w AS (PARTITION BY h, payload_bytes)
"""
