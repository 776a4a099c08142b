"""Web archives: pages written as WARC records, gzip streams normalised to a member for each record, and read by an index.

A *monolithic* archive is one gzip stream over the whole file: nothing in it can be reached without inflating all before it.
``normalise`` inflates each such file once, as a stream, writes every record as a gzip member of its own, and notes each
member's offset and length in a sidecar file, by which records are then read one by one.

Of pages with equal payloads the one with the smallest id is a response; the others are revisits without payload that refer to
it and keep its digest and length in their headers. Rows that repeat the smallest id are responses too; a null id counts as
larger than any other. A null html is an empty payload, a null url an empty target. An empty table gives no archive and no pages.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator, Sequence
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm.batches import each_piece, lean, quoted
from mensura.llm.files import opened, written
from mensura.session import cut

DATE = "2000-01-01T00:00:00Z"  # pages carry no time of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "file string, n_records long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_FILES = pa.schema([("file", pa.string()), ("n_records", pa.int64())])
_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                   ("record_type", pa.string()), ("refers_to", pa.int64())])


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _digests(texts: list[bytes | None]) -> dict[str, list]:
    return {"digest": [digest_of(t or b"") for t in texts], "n_bytes": np.array([len(t or b"") for t in texts], np.int64)}


def judged(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page, url, html, digest, n_bytes, first): every page with its payload's digest and the smallest page that has it."""
    rows = each_piece(pages, _digests, "digest string, n_bytes long", html, [page, url, html])
    rows = rows.select(
        F.col(f"row.{quoted(page)}").cast("long").alias("page"), F.col(f"row.{quoted(url)}").cast("string").alias("url"),
        F.col(f"row.{quoted(html)}").cast("binary").alias("html"), "digest", "n_bytes")
    first = rows.groupBy("digest").agg(F.min("page").alias("first"))
    return rows.join(cut(first), "digest", "left")  # cut: both sides are exchanged, so a digest of many pages can be split


def _name(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else quote(str(page))}>"


def _page(name: bytes | None) -> int | None:
    value = unquote((name or b"").decode()).strip("<>").rpartition(":")[2]
    return None if value in ("none", "") else int(value)


def record(page: int | None, url: str | None, html: bytes | None, digest: str, n_bytes: int, first: int | None) -> bytes:
    """One record, ready to be written."""
    fresh = page == first
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (html or b"") if fresh else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if fresh else 'revisit'}", f"WARC-Record-ID: {_name(page)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if not fresh:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(first)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def records(stream) -> Iterator[tuple[dict[bytes, bytes], bytes, bytes]]:
    """(headers by lower-case name, block, the whole record) of every record of an inflated stream."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:60]!r}")
        raw, headers = [line], {}
        while (line := stream.readline()).strip():
            raw.append(line)
            name, _, value = line.partition(b":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers[b"content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record ends before its length")
        yield headers, block, b"".join([*raw, b"\r\n", block, b"\r\n\r\n"])


def write_monolithic(pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", html: str = "html") -> list[str]:
    """Write the pages as one gzip stream for each partition; the names of the files."""
    order = ["page", "digest", "url"]  # a task that runs again writes the same bytes
    rows = judged(pages, page, url, html).select("page", "url", "html", "digest", "n_bytes", "first").sortWithinPartitions(*order)

    def run(batches):
        batches = (b for b in batches if b.num_rows)
        head = next(batches, None)
        if head is None:
            return
        name = f"pages-{TaskContext.get().partitionId():06d}.warc.gz"
        squeeze, n = zlib.compressobj(6, zlib.DEFLATED, 31), 0
        with written(folder, name) as out:
            for batch in (b for part in ([head], batches) for b in part):
                for row in zip(*[batch.column(c).to_pylist() for c in batch.schema.names]):
                    out.write(squeeze.compress(record(*row)))
                    n += 1
            out.write(squeeze.flush())
        yield pa.RecordBatch.from_pylist([{"file": name, "n_records": n}], _FILES)

    return sorted(r.file for r in rows.mapInArrow(lean(run), FILES).collect())


def _each_file(spark: SparkSession, files: Sequence[str], work, columns: str) -> DataFrame:
    """``work`` on every file name, a task for each."""
    if not files:
        return spark.createDataFrame([], columns)
    files = list(files)

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield from work(files[i])

    return spark.range(0, len(files), 1, len(files)).mapInArrow(lean(run), columns)


def normalise(spark: SparkSession, source: str, files: Sequence[str], target: str) -> list[str]:
    """Rewrite gzip archives with a member for each record and a sidecar index; the names of the new files.

    The index has a line for each record: offset, length, type and id, parted by tabs. Archives that already have several members
    are read alike.
    """
    def work(name: str):
        store, at = opened(source)
        offset, n = 0, 0
        with store.open_input_stream(f"{at}/{name}", compression=None) as packed, gzip.GzipFile(fileobj=packed) as stream:
            with written(target, name) as out, written(target, f"{name}.idx") as index:
                for headers, _, whole in records(stream):
                    member = gzip.compress(whole, 6, mtime=0)
                    line = [str(offset).encode(), str(len(member)).encode(), headers[b"warc-type"], headers[b"warc-record-id"]]
                    out.write(member)
                    index.write(b"\t".join(line) + b"\n")
                    offset += len(member)
                    n += 1
        yield pa.RecordBatch.from_pylist([{"file": name, "n_records": n}], _FILES)

    return sorted(r.file for r in _each_file(spark, files, work, FILES).collect())


def index_of(store, path: str) -> list[tuple[int, int, str, str]]:
    with store.open_input_stream(f"{path}.idx", compression=None) as lines:
        parts = (line.split(b"\t") for line in lines.read().splitlines())
        return [(int(a), int(b), kind.decode(), name.decode()) for a, b, kind, name in parts]


def read_record(source, offset: int, length: int) -> tuple[dict[bytes, bytes], bytes]:
    """One record by its place; nothing else of the file is read."""
    import io

    headers, block, _ = next(records(io.BytesIO(gzip.decompress(source.read_at(length, offset)))))
    return headers, block


def described(headers: dict[bytes, bytes], block: bytes) -> dict:
    """What a record says of its page; a payload that is there is measured, and must have the digest that is stated."""
    head, _, payload = block.partition(b"\r\n\r\n")
    kind = headers[b"warc-type"].decode()
    digest = headers[b"warc-payload-digest"].decode().removeprefix("sha1:")
    if kind == "response":
        n_bytes = len(payload)
        if digest_of(payload) != digest:
            raise ValueError(f"payload of {headers[b'warc-record-id']!r} does not have its digest")
    else:
        stated = dict(line.lower().split(b":", 1) for line in head.split(b"\r\n")[1:])
        n_bytes = int(stated[b"content-length"])
    refers = _page(headers[b"warc-refers-to"]) if kind == "revisit" else None
    return {"page_id": _page(headers[b"warc-record-id"]), "payload_bytes": n_bytes, "payload_digest": digest, "record_type": kind, "refers_to": refers}


def read_pages(spark: SparkSession, folder: str, files: Sequence[str]) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, read by the indexes."""
    def work(name: str):
        store, at = opened(folder)
        index = index_of(store, f"{at}/{name}")
        with store.open_input_file(f"{at}/{name}") as source:
            for i in range(0, len(index), 1000):
                rows = [described(*read_record(source, offset, length)) for offset, length, _, _ in index[i : i + 1000]]
                yield pa.RecordBatch.from_pylist(rows, _READ)

    return _each_file(spark, files, work, READ)
