"""WARC archives written by tasks and read back as a table of chunks.

Writing: payload digests are grouped first, so that of equal payloads one record
is a response and the others refer to it. Each task streams its records, one gzip
member each, into an archive of its own name in the shared folder; only archives
of finished tasks appear in the list that is read later, so a repeated task does
no harm. Reading: an archive is inflated piece by piece and every record becomes
rows ``(record, chunk_no)`` of at most ``chunk`` bytes, each with the SHA-256 of
the payload so far; the last one carries the digest of the whole, which is held
against the header. No step allocates a whole record beside the input row.

Defined cases: a null html is an empty payload; a null url gives no target line;
a null ``page_id`` sorts last among equal payloads; rows that share a page_id and
a payload are records of their own, one of them the response. Payloads under
``least`` bytes are always responses. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm.common import join_groups, query, staged
from docweft.session import fresh_path
from docweft.sources.tables import load

LEAST = 100
CHUNK = 1 << 20
DATE = "2020-01-01T00:00:00Z"
_READ = 1 << 18
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

CHUNKS = (
    "page_id bigint, record string, record_type string, refers_to bigint, url string, chunk_no bigint, start bigint, "
    "n_bytes bigint, digest string, last boolean, payload_bytes bigint, data binary"
)


def record_plan(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``pages`` with ``at``, ``digest``, ``n_bytes`` and, for revisits, ``first`` (the response's page_id in a struct)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("bigint").alias("n_bytes"))
    # The one copy of the payloads that is kept; the closer codec costs little beside the archives.
    path = fresh_path(pages.sparkSession, "pages")
    rows.withColumn("at", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    rows = pages.sparkSession.read.parquet(path)
    narrow = rows.where(F.col("n_bytes") >= least).select("page_id", "at", "digest")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "at")).alias("first")
    groups = narrow.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), first).where("n > 1")
    again = join_groups(narrow, staged(groups, "copies"), "digest", "n", rows.count())
    again = again.where("at <> first.at").select("at", F.struct(F.col("first.page_id").alias("page_id")).alias("first"))
    return rows.join(again, "at", "left")


def _head(kind: str, record: str, page: int | None, url: str | None, digest: str, size: int, body: int, refers: str) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:record:{record}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="/:?&=#+,;@!$'()*[]~"))
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", f"X-Page: {'' if page is None else page}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers}"]
    else:
        lines.append("Content-Type: application/http; msgtype=response")
    return ("\r\n".join([*lines, f"Content-Length: {body}"]) + "\r\n\r\n").encode("utf-8")


def _member(pieces: Iterator[bytes]) -> Iterator[bytes]:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    for piece in pieces:
        if out := pack.compress(piece):
            yield out
    yield pack.flush()


def _record(row: dict) -> Iterator[bytes]:
    view, first = memoryview(row["html"]), row["first"]
    page = row["page_id"]
    if first is not None:
        refers = "" if first["page_id"] is None else str(first["page_id"])
        yield _head("revisit", str(row["at"]), page, row["url"], row["digest"], len(view), 0, refers)
    else:
        http = _HTTP % len(view)
        yield _head("response", str(row["at"]), page, row["url"], row["digest"], len(view), len(http) + len(view), "")
        yield http
        for start in range(0, len(view), _READ):
            yield bytes(view[start : start + _READ])
    yield b"\r\n\r\n"


def written(pages: DataFrame, folder: str | None = None, least: int = LEAST) -> DataFrame:
    """Write the archives under ``folder``; the list of them, ``(path, records)``."""
    folder = folder or fresh_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        path, records, sink = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                one = row.drop_columns(["html"]).to_pylist()[0] | {"html": row.column("html")[0].as_buffer()}
                sink = sink or store.open_output_stream(path, compression=None)
                for out in _member(_record(one)):
                    sink.write(out)
                records += 1
        if sink:
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder.rstrip('/')}/{path.rsplit('/', 1)[1]}"], "records": [records]})

    return staged(record_plan(pages, least).mapInArrow(write, "path string, records bigint"), "archives")


class _Inflated:
    """A gzip file of several members, read in small pieces."""

    def __init__(self, source):
        self.source, self.held, self.unpack = source, bytearray(), zlib.decompressobj(31)

    def more(self) -> bool:
        data = self.unpack.unconsumed_tail
        if self.unpack.eof:
            data = self.unpack.unused_data
            self.unpack = zlib.decompressobj(31)
        data = data or self.source.read(_READ)
        if not data:
            return False
        self.held += self.unpack.decompress(data, _READ)
        return True

    def line(self) -> bytes:
        while (end := self.held.find(b"\n")) < 0:
            if not self.more():
                return b""
        out = bytes(self.held[: end + 1])
        del self.held[: end + 1]
        return out

    def take(self, most: int) -> bytes:
        while not self.held:
            if not self.more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.held[:most])
        del self.held[: len(out)]
        return out


def _number(text: str) -> int | None:
    return int(text) if text else None


def _headers(source: _Inflated) -> dict[str, str]:
    out = {}
    while (line := source.line()).strip():
        name, _, value = line.decode("utf-8").partition(":")
        out[name.lower()] = value.strip()
    return out


def _chunks(source: _Inflated, chunk: int) -> Iterator[dict]:
    while line := source.line():
        if not line.strip():
            continue
        head = _headers(source)
        size, refers = int(head["x-payload-length"]), head.get("x-refers-to-page", "")
        row = {
            "page_id": _number(head["x-page"]),
            "record": head["warc-record-id"][1:-1],
            "record_type": head["warc-type"],
            "refers_to": _number(refers),
            "url": unquote(head["warc-target-uri"]) if "warc-target-uri" in head else None,
            "payload_bytes": size,
        }
        said = head["warc-payload-digest"].removeprefix("sha256:")
        if row["record_type"] == "revisit":
            yield row | {"chunk_no": 0, "start": 0, "n_bytes": 0, "digest": said, "last": True, "data": b""}
            continue
        http = b"\r\n"
        while (line := source.line()).strip():
            http += line
        if len(http) + size != int(head["content-length"]):
            raise ValueError(f"{row['record']}: the payload's length is not the one in its header")
        hashed, start, number = hashlib.sha256(), 0, 0
        while True:
            data = bytearray()
            wanted = min(chunk, size - start)
            while len(data) < wanted:
                data += source.take(wanted - len(data))
            hashed.update(data)
            last = start + len(data) == size
            digest = hashed.hexdigest()
            if last and digest != said:
                raise ValueError(f"{row['record']}: the payload has digest {digest}, its header says {said}")
            yield row | {"chunk_no": number, "start": start, "n_bytes": len(data), "digest": digest, "last": last, "data": bytes(data)}
            start, number = start + len(data), number + 1
            if last:
                break


def chunk_table(archives: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """Rows per record and chunk of the archives listed in ``path``; ``digest`` covers the payload up to the chunk's end."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, base = fs.FileSystem.from_uri(path)
                with store.open_input_stream(base, compression=None) as source:
                    rows, held = [], 0
                    for row in _chunks(_Inflated(source), chunk):
                        held += row["n_bytes"]
                        rows.append(row if with_data else row | {"data": None})
                        if len(rows) >= 5000 or with_data and held >= 4 * chunk:
                            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return archives.select("path").mapInArrow(read, CHUNKS)


_SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()),
        ("record", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("url", pa.string()),
        ("chunk_no", pa.int64()),
        ("start", pa.int64()),
        ("n_bytes", pa.int64()),
        ("digest", pa.string()),
        ("last", pa.bool_()),
        ("payload_bytes", pa.int64()),
        ("data", pa.binary()),
    ]
)

SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f"""


@query("op5_warc", SQL)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = written(load(spark, sf_dir, "pages"))
    archives = archives.repartition(max(1, archives.count()))
    whole = chunk_table(archives, with_data=False).where("last")
    return whole.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
