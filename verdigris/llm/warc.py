"""WARC archives, index first.

``write_archives`` turns pages into gzip-per-record WARC files in shared
storage and returns the index: file, offset, length, URL and payload digest
of each record. The index is written by Spark's own committer and is the only
thing that makes a file count: a task that ran twice or died leaves a file to
which no index row points. Equal payloads are stored once: of the records
with a payload of at least ``least`` bytes, that with the smallest page_id is
a response and the others revisit it. Smallest ids come from a partially
aggregated group-by over digests, so a payload that a third of all pages
share is one row per task there; its join back splits by Catalyst's skew rule
or is a broadcast of measured size.

``read_records`` takes any selection of index rows, sorts them by file and
offset, coalesces neighbours into ranges of at most ``SPAN`` bytes, reads each
range once and parses its records.

Storage is reached through pyarrow's file systems by the folder's URI.

Defined results: a null html is an empty payload; a null URL is written as
``about:blank``; characters that a header can't hold are percent-encoded;
rows that repeat the smallest page_id are all responses; a row without
page_id is a response only if no row of its payload has one, and is written
under a random id; repeated rows give a record each.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import materialise, shared_path

#: Payloads of fewer bytes are never deduplicated.
LEAST = 100
#: Bytes of one coalesced read, and the largest gap that is read over.
SPAN, GAP = 8 << 20, 64 << 10
#: Bytes after which a task begins its next file.
FILE_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"

#: Bytes of archive for a reading task. A small archive is spread further, down to ``LEAST_TASK`` bytes a task.
TASK_BYTES, LEAST_TASK = 128 << 20, 1 << 20

_INDEX = "page_id bigint, url string, file string, offset bigint, length bigint, payload_digest string, payload_bytes bigint, record_type string, refers_to bigint"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in ddl.split(", "))])


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    """Rows as Arrow columns: ids stay integers beside nulls."""
    schema = _arrow(ddl)
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _open(uri: str):
    """The pyarrow file system of a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def classified(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Pages with payload, digest, length, record type and the response they refer to."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    groups = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    shared = materialise(groups.where("n > 1").select(F.col("payload_digest").alias("_digest"), "first_id"), "warc-shared")
    rows = rows.join(shared, F.col("payload_digest") == F.col("_digest"), "left")
    revisit = F.col("_digest").isNotNull() & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.select(
        "page_id", "url", "payload", "payload_digest", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to")
    )


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid4()}>" if page_id is None else f"<urn:page:{page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One record, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=''.join(chr(c) for c in range(33, 127))) if url else 'about:blank'}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(rows: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write what ``classified`` returns below ``folder``; the index as a DataFrame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(folder)
        store.create_dir(top, recursive=True)
        file = out = None
        offset = 0
        for batch in batches:
            index = []
            for page_id, url, payload, digest, n, kind, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or offset >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    file = f"{uuid.uuid4().hex}.warc.gz"  # its own for each attempt
                    out, offset = store.open_output_stream(f"{top}/{file}", compression=None), 0
                member = gzip.compress(record(page_id, url, payload, digest, kind, refers), level, mtime=0)
                out.write(member)
                index.append((page_id, url, file, offset, len(member), digest, n, kind, refers))
                offset += len(member)
            yield _batch(index, _INDEX)
        if out is not None:
            out.close()

    columns = rows.select("page_id", "url", "payload", "payload_digest", "payload_bytes", "record_type", "refers_to")
    return materialise(columns.mapInArrow(run, _INDEX), "warc-index")


def ranges(index: DataFrame, span: int = SPAN) -> DataFrame:
    """Index rows gathered to byte ranges: (file, at, records sorted by offset); at most ``span`` bytes each and one record more.

    Dealt by the bytes to be read, not by the size of the index: the number of
    tasks is given, so that adaptive execution doesn't merge them.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    cores = index.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-total // TASK_BYTES), min(4 * cores, -(-total // LEAST_TASK)))
    rows = index.select("file", F.floor(F.col("offset") / span).alias("at"), F.struct("offset", "length").alias("record"))
    return rows.repartition(tasks, "file", "at").groupBy("file", "at").agg(F.sort_array(F.collect_list("record")).alias("records"))


_PARSED = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of a record and its payload."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["http"] = http.decode()
    return fields, payload


def read_records(index: DataFrame, folder: str, keep_payload: bool = True) -> DataFrame:
    """The records of the given index rows, read from the archives.

    Digest and length are computed from the payload; a revisit, which has
    none, takes them from its headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(folder)
        for batch in batches:
            for file, records in zip(batch.column("file").to_pylist(), batch.column("records"), strict=True):
                with store.open_input_file(f"{top}/{file}") as source:
                    out = []
                    for start, members in coalesced([(r["offset"], r["length"]) for r in records.as_py()]):
                        source.seek(start)
                        data = source.read(members[-1][0] + members[-1][1] - start)
                        for offset, length in members:
                            fields, payload = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                            out.append(_parsed(fields, payload, keep_payload))
                yield _batch(out, _PARSED)

    return ranges(index).mapInArrow(run, _PARSED)


def coalesced(records: list[tuple[int, int]], gap: int = GAP) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Runs of sorted (offset, length) with gaps of at most ``gap`` bytes, each with its start."""
    run: list[tuple[int, int]] = []
    for offset, length in records:
        if run and offset - (run[-1][0] + run[-1][1]) > gap:
            yield run[0][0], run
            run = []
        run.append((offset, length))
    if run:
        yield run[0][0], run


def _parsed(fields: dict[str, str], payload: bytes, keep: bool) -> tuple:
    kind = fields["WARC-Type"]
    number = lambda urn: int(urn[len("<urn:page:") : -1]) if urn and urn.startswith("<urn:page:") else None
    if kind == "response":
        digest, n = hashlib.sha256(payload).hexdigest(), len(payload)
        if fields["WARC-Payload-Digest"] != f"sha256:{digest}":
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    else:
        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
        n = next(int(x[len("Content-Length: ") :]) for x in fields["http"].split("\r\n") if x.startswith("Content-Length: "))
    return number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, number(fields.get("WARC-Refers-To")), digest, n, payload if keep else None


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read them all back."""
    folder = shared_path(pages.sparkSession, "warc")
    index = write_archives(classified(pages), folder)
    return read_records(index, folder, keep_payload=False).drop("payload")


#: The round trip in DuckDB's SQL.
ORACLE_SQL = f"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
measured AS (SELECT page_id, strlen(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM payloads),
firsts AS (SELECT *, CASE WHEN payload_bytes >= {LEAST} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM measured)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM firsts
"""
