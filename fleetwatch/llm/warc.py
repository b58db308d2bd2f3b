"""WARC archives: write, normalise whole-file gzip to one member per record with an offset index, read.

``write_archives`` streams records into one gzip stream per task. ``normalise`` inflates each such stream
once, rewrites every record as a gzip member of its own and writes a sidecar index (offset, length,
id) beside the archive. ``read_archives`` seeks to members by that index.

Task attempts write files of their own names; only the attempt whose rows Spark commits is listed in the
manifest, so a lost executor leaves an unlisted file and nothing else.

Nulls: a null html is an empty payload, a null url an empty target, a null page id stays null. Repeated
pages (same id and payload) give one response and revisits of it. Empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetwatch.session import cut, new_path

MIN_REVISIT_BYTES = 100
CAPTURED = "2024-01-01T00:00:00Z"  # the tables hold no capture time
_GZIP = 31  # zlib window bits of a gzip stream
_PIECE = 1 << 20
_END = b"\r\n\r\n"
MANIFEST = "archive string, n_records long"
INDEX = "archive string, sidecar string, offset long, length long, ordinal long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """One small row per page: size, digest, record type and the page that a revisit refers to.

    Payloads stay where they are. The smallest id per digest is combined on the map side, so a payload that a
    third of all pages share is joined to one row, and Spark splits its partition. Repeated rows of one page
    are numbered within (digest, id), a group of one row unless pages are repeated.
    """
    rows = _with_payload(pages).select(
        "page_id", "url", "payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes")
    )
    firsts = (
        rows.where(F.col("payload_bytes") >= min_bytes)
        .groupBy(F.col("payload_digest").alias("__d"))
        .agg(F.min("page_id").alias("__first"))
    )
    same = (F.col("payload_digest") == F.col("__d")) & (F.col("payload_bytes") >= min_bytes)
    place = F.row_number().over(Window.partitionBy("payload_digest", "page_id").orderBy("url"))
    revisit = F.col("__d").isNotNull() & ~(F.col("page_id").eqNullSafe(F.col("__first")) & (place == 1))
    return (
        rows.join(firsts, same, "left")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("__first")))
        .drop("__d", "__first")
    )


def _with_payload(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select("page_id", "url", payload.alias("payload")).withColumn(
        "payload_digest", F.sha2("payload", 256)
    )


def record_rows(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """The plan of all records, with the payload where the record is a response.

    Payloads meet their plan by (digest, id), so copies of one payload spread over all tasks.
    """
    plan = cut(plan_records(pages, min_bytes), "records")
    rows = _with_payload(pages)
    small = rows.where(F.octet_length("payload") < min_bytes).select(
        "page_id",
        "url",
        "payload_digest",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.lit("response").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"),
        "payload",
    )
    large = plan.where(F.col("payload_bytes") >= min_bytes)
    wanted = large.where(F.col("record_type") == "response").select(
        F.col("payload_digest").alias("__d"), F.coalesce("page_id", F.lit(0)).alias("__p"), F.isnull("page_id").alias("__n")
    )
    keyed = (
        rows.where(F.octet_length("payload") >= min_bytes)
        .withColumn("__id", F.coalesce("page_id", F.lit(0)))
        .withColumn("__null", F.isnull("page_id"))
    )
    on = (
        (F.col("payload_digest") == F.col("__d")) & (F.col("__id") == F.col("__p")) & (F.col("__null") == F.col("__n"))
    )
    responses = (
        keyed.join(wanted, on)
        .dropDuplicates(["payload_digest", "__id", "__null"])
        .withColumn("payload_bytes", F.octet_length("payload").cast("long"))
        .withColumn("record_type", F.lit("response"))
        .withColumn("refers_to", F.lit(None).cast("long"))
        .select(small.columns)
    )
    revisits = large.where(F.col("record_type") == "revisit").withColumn("payload", F.lit(None).cast("binary"))
    return small.unionByName(responses).unionByName(revisits.select(small.columns))


def _one_line(text: str | None) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in text or "")


def record_bytes(page_id, url, payload: bytes | None, size: int, digest: str, kind: str, refers_to) -> bytes:
    """One WARC record; a revisit has the HTTP head of its page and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    block = head.encode() + (payload if kind == "response" else b"")
    fields = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {CAPTURED}",
        f"WARC-Target-URI: {_one_line(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Page-Id: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        fields += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"Refers-To-Page-Id: {'' if refers_to is None else refers_to}",
        ]
    fields.append(f"Content-Length: {len(block)}")
    return "\r\n".join(fields).encode() + _END + block + _END


def split_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields, payload."""
    head, _, rest = record.partition(_END)
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(_END)
    return fields, _fields(http), payload


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """One whole-file gzip archive per task; returns the manifest of committed archives."""
    _make(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, n, sink = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, None
        press = zlib.compressobj(1, zlib.DEFLATED, _GZIP)
        for batch in batches:
            for row in batch.to_pylist():
                if sink is None:
                    files, at = _open(path)
                    sink = files.open_output_stream(at, compression=None)
                sink.write(
                    press.compress(
                        record_bytes(
                            row["page_id"],
                            row["url"],
                            row["payload"],
                            row["payload_bytes"],
                            row["payload_digest"],
                            row["record_type"],
                            row["refers_to"],
                        )
                    )
                )
                n += 1
        if sink is not None:
            sink.write(press.flush())
            sink.close()
            yield pa.RecordBatch.from_pydict({"archive": [path], "n_records": [n]})

    return cut(records.mapInArrow(write, MANIFEST), "manifest")


def inflate(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Bytes of a gzip file of one or many members, in pieces of bounded size."""
    press = zlib.decompressobj(_GZIP)
    for data in pieces:
        while data:
            if press.eof:
                press = zlib.decompressobj(_GZIP)
            yield press.decompress(data, _PIECE)
            data = press.unconsumed_tail or press.unused_data
    while not press.eof and (tail := press.decompress(press.unconsumed_tail, _PIECE)):
        yield tail


def records_of(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of a stream of WARC bytes; at most one record and one piece are held."""
    held, need = bytearray(), None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                at = held.find(_END)
                if at < 0:
                    break
                need = at + len(_END) + int(_fields(bytes(held[:at]))["content-length"]) + len(_END)
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError(f"{len(held)} bytes after the last whole record")


def _pieces(source) -> Iterator[bytes]:
    while data := source.read(_PIECE):
        yield data


def normalise(manifest: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Every record as its own gzip member, a sidecar index per archive, and the index as a table."""
    _make(folder)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for old in batch.column("archive").to_pylist():
                path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                sidecar = f"{path}.index"
                files, at = _open(old)
                out, to = _open(path)
                rows, offset = [], 0
                with files.open_input_stream(at, compression=None) as source, out.open_output_stream(
                    to, compression=None
                ) as sink, out.open_output_stream(f"{to}.index") as side:
                    for i, record in enumerate(records_of(inflate(_pieces(source)))):
                        press = zlib.compressobj(level, zlib.DEFLATED, _GZIP)
                        member = press.compress(record) + press.flush()
                        sink.write(member)
                        side.write(json.dumps({"offset": offset, "length": len(member)}).encode() + b"\n")
                        rows.append((path, sidecar, offset, len(member), i))
                        offset += len(member)
                        if len(rows) == 10_000:
                            yield _index_batch(rows)
                            rows = []
                if rows:
                    yield _index_batch(rows)

    return cut(_one_archive_a_task(manifest).mapInArrow(rewrite, INDEX), "warc-index")


def _one_archive_a_task(manifest: DataFrame) -> DataFrame:
    tasks = max(1, manifest.count())
    return manifest.repartition(tasks, "archive")


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["archive", "sidecar", "offset", "length", "ordinal"]
    return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))))


def read_archives(index: DataFrame) -> DataFrame:
    """One row per record, read back by offset; a response whose payload has another digest raises."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, opened = None, None
        for batch in batches:
            rows = []
            for r in batch.select(["archive", "offset", "length"]).to_pylist():
                if r["archive"] != opened:
                    if source is not None:
                        source.close()
                    files, at = _open(r["archive"])
                    source, opened = files.open_input_file(at), r["archive"]
                source.seek(r["offset"])
                rows.append(_page_row(zlib.decompress(source.read(r["length"]), _GZIP)))
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_ARROW)
        if source is not None:
            source.close()

    return index.mapInArrow(read, RECORD)


_RECORD_ARROW = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("url", pa.string()),
    ]
)


def _page_row(record: bytes) -> dict:
    fields, http, payload = split_record(record)
    digest = fields["warc-payload-digest"].partition(":")[2]
    if fields["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of page {fields['page-id']} does not match its digest")
    number = lambda name: int(fields[name]) if fields.get(name) else None
    return {
        "page_id": number("page-id"),
        "payload_bytes": len(payload) if fields["warc-type"] == "response" else int(http["content-length"]),
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": number("refers-to-page-id"),
        "url": fields["warc-target-uri"],
    }


def _make(folder: str) -> None:
    files, at = _open(folder)
    files.create_dir(at, recursive=True)


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write, normalise and read back; archives stay in ``folder`` (default: the shared folder)."""
    folder = folder or new_path(spark, "warc")
    manifest = write_archives(record_rows(pages), f"{folder}/whole")
    return read_archives(normalise(manifest, f"{folder}/members"))


SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id,
    row_number() OVER (PARTITION BY payload_digest ORDER BY page_id) AS place FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND place > 1 THEN first_id END AS refers_to
FROM g
"""
