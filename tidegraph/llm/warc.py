"""WARC archives: writer, monolithic gzip normaliser, reader.

An archive that is one gzip stream can't be read from the middle. The normaliser
inflates it once, as a stream, writes every record as a gzip member of its own,
and lists the members' offsets in a sidecar, so that readers seek to records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import fresh_path, materialize, spread_join
from tidegraph.store import open_fs

LEVEL = 1
CHUNK = 1 << 18
#: Payload bytes of an archive, about.
ARCHIVE_BYTES = 32 << 20


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: dict[str, str], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit of the response that has the same payload.

    A revisit keeps the HTTP head of its response, and so the payload's length,
    but no payload.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = "".join(c for c in (url or "") if c > " ") or f"urn:page:{page_id}"
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{page_id}>",
        "WARC-Target-URI": target,
        "WARC-Date": "2000-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    return record(fields, http + (payload if refers_to is None else b""))


def inflate(stream: BinaryIO) -> Iterator[bytes]:
    """The text of a gzip file of one or more members, piece by piece."""
    d = zlib.decompressobj(31)
    while chunk := stream.read(CHUNK):
        while chunk:
            if d.eof:
                chunk = chunk.lstrip(b"\0")
                if not chunk:
                    break
                d = zlib.decompressobj(31)
            out = d.decompress(chunk, 4 * CHUNK)
            if out:
                yield out
            chunk = d.unused_data if d.eof else d.unconsumed_tail
    if not d.eof:
        rest = d.flush()
        if rest:
            yield rest
        if not d.eof:
            raise EOFError("the gzip stream ends within a member")


class Records:
    """Splits inflated text into records: ``(head, pieces of the block)`` in turn."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.buffer = pieces, b""

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.buffer += piece
        return True

    def __iter__(self) -> Iterator[tuple[bytes, Iterator[bytes]]]:
        while True:
            while (end := self.buffer.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    if self.buffer.strip():
                        raise ValueError("text after the last record")
                    return
            head, self.buffer = self.buffer[: end + 4], self.buffer[end + 4 :]
            block = self._block(int(header(head, "Content-Length") or 0))
            yield head, block
            for _ in block:  # what the caller left
                pass
            while len(self.buffer) < 4 and self._more():
                pass
            if self.buffer[:4] != b"\r\n\r\n":
                raise ValueError("a record doesn't end where its length says")
            self.buffer = self.buffer[4:]

    def _block(self, length: int) -> Iterator[bytes]:
        while length:
            if not self.buffer and not self._more():
                raise EOFError("the archive ends within a record")
            part, self.buffer = self.buffer[:length], self.buffer[length:]
            length -= len(part)
            yield part


def header(head: bytes, name: str) -> str | None:
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        if k.strip().lower() == name.lower():
            return v.strip()
    return None


def normalise(source: BinaryIO, out: BinaryIO) -> list[dict]:
    """Rewrites a gzip archive so that every record is a member of its own.

    Inflates ``source`` once, in bounded memory. Returns the index: offset and
    length of each member, and the record's id, type and target.
    """
    index, offset = [], 0
    for head, block in Records(inflate(source)):
        z, length = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
        length += out.write(z.compress(head))
        for piece in block:
            length += out.write(z.compress(piece))
        length += out.write(z.compress(b"\r\n\r\n") + z.flush())
        index.append({"offset": offset, "length": length, "id": header(head, "WARC-Record-ID"), "type": header(head, "WARC-Type"), "uri": header(head, "WARC-Target-URI")})
        offset += length
    return index


def _committed(system, path: str, write: Callable[[BinaryIO], None]) -> None:
    """A file that is there whole or not at all."""
    half = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(half, compression=None) as f:
        write(f)
    system.move(half, path)


def with_references(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``(page_id, url, payload, digest, refers_to)``.

    Of equal payloads of at least ``min_bytes`` bytes, that with the largest
    page_id is the response (a null id is the smallest); the others refer to it.
    Rows that share that id too, being the same page again, are responses as well.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha"))
    keys = rows.select("page_id", "sha", F.length("payload").alias("size")).where(F.col("size") >= min_bytes)
    last = materialize(keys.groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1"), "payloads")
    # The rows of a payload that very many pages have stay where they are.
    joined = spread_join(rows, last, "sha", "n", "left")
    return joined.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Rows of ``with_references`` -> ``(path, records)``: archives of about
    ``ARCHIVE_BYTES``, each one gzip stream.

    An attempt of a task has files of its own, and the list that is kept names
    those of the attempts that count: a task that runs again does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_fs(folder)
        system.create_dir(base, recursive=True)
        context = TaskContext.get()
        name = f"{base}/part-{context.partitionId():06d}-{context.taskAttemptId()}"
        k = records = size = 0
        f = z = None
        done: list[tuple[str, int]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                if f is None:
                    path = f"{name}-{k}.warc.gz"
                    f, z = system.open_output_stream(path, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                page_id, url, payload, refers_to = (c[i].as_py() for c in batch.columns)
                f.write(z.compress(page_record(page_id, url, payload, digest32(payload), refers_to)))
                records += 1
                size += len(payload)
                if size >= ARCHIVE_BYTES:
                    f.write(z.flush())
                    f.close()
                    done.append((path, records))
                    f, k, records, size = None, k + 1, 0, 0
        if f is not None:
            f.write(z.flush())
            f.close()
            done.append((path, records))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "records"])

    return materialize(rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, records long"), "archives")


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """``(path, ...)`` -> ``(path, index_path, records)``: each archive rewritten, with
    a sidecar of JSON lines. The old archives stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_fs(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                to = path.removesuffix(".warc.gz") + ".members.warc.gz"
                side, index = to + ".idx", []
                with system.open_input_stream(path, compression=None) as source:
                    _committed(system, to, lambda out: index.extend(normalise(source, out)))  # noqa: B023
                _committed(system, side, lambda out: out.write("".join(json.dumps(x) + "\n" for x in index).encode()))  # noqa: B023
                yield pa.RecordBatch.from_arrays([pa.array([to]), pa.array([side]), pa.array([len(index)], pa.int64())], names=["path", "index_path", "records"])

    n = max(1, archives.count())
    return materialize(archives.select("path").repartition(n, "path").mapInArrow(run, "path string, index_path string, records long"), "normalised")


def read_archives(normalised: DataFrame, folder: str) -> DataFrame:
    """``(path, index_path, ...)`` -> a row per record: ``(record_id, uri, type,
    refers_to, digest, http_length, payload)``; payload is null for revisits.

    Each member is sought by its offset and inflated alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_fs(folder)
        for batch in batches:
            for path, side in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_stream(side, compression=None) as f:
                    index = [json.loads(x) for x in f.read().decode().splitlines()]
                with system.open_input_file(path) as f:
                    for at in range(0, len(index), 64):
                        rows = [_parsed(f.read_at(x["length"], x["offset"])) for x in index[at : at + 64]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    schema = "record_id string, uri string, type string, refers_to string, digest string, http_length long, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.string()] * 5 + [pa.int64(), pa.binary()]
    n = max(1, normalised.count())
    return normalised.select("path", "index_path").repartition(n, "path").mapInArrow(run, schema)


def _parsed(member: bytes) -> tuple:
    text = zlib.decompress(member, 31)
    end = text.index(b"\r\n\r\n") + 4
    head, length = text[:end], int(header(text[:end], "Content-Length") or 0)
    block = text[end : end + length]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = header(head, "WARC-Type"), (header(head, "WARC-Payload-Digest") or "").removeprefix("sha1:")
    if kind == "response" and digest32(payload) != digest:
        raise ValueError(f"{header(head, 'WARC-Record-ID')}: the payload doesn't have its digest")
    return header(head, "WARC-Record-ID"), header(head, "WARC-Target-URI"), kind, header(head, "WARC-Refers-To"), digest, int(header(http + b"\r\n", "Content-Length") or 0), payload if kind == "response" else None


def round_trip(pages: DataFrame, *, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write, normalise and read back: ``(page_id, payload_bytes, payload_digest,
    record_type, refers_to, uri)``, a row per row of ``pages(page_id, url, html)``.

    Null html is an empty payload; a null or blank url becomes a URN; a null
    page_id stays null. A payload may be as long as a row can be. All that is returned comes from the archives. Other
    columns are ignored; an empty table gives no rows and no archives.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")
    back = read_archives(normalise_archives(write_archives(with_references(pages, min_bytes), folder), folder), folder)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'urn:page:(-?[0-9]+)', 1) AS BIGINT)")
    return back.select(number("record_id").alias("page_id"), F.coalesce(F.length("payload").cast("long"), "http_length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), number("refers_to").alias("refers_to"), "uri")


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("uri")
