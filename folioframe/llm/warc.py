"""WARC archives as a chunked record table.

Writing streams each payload into gzip members of archive files in the shared folder;
reading yields rows (record id, chunk number, bytes) with the digest of the bytes so
far, so neither side holds a whole record. Equal payloads are stored once: the
record with the largest page id is the response, the others are revisits of it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.sources.staging import arrow_files

from ._kernels import batch_of
from ._shared import shared_dir, stored

CHUNK = 1 << 18
#: Uncompressed bytes after which a task begins another archive file.
FILE_BYTES = 256 << 20
#: Revisits up to this number (24 bytes and a digest each) may be broadcast; beyond, a shuffle joins them.
BROADCAST_ROWS = 100_000
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6f6c696f-6672-616d-8000-000000000000").int >> 64 << 64
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    """A record id that carries the page id; null ids have a space of their own."""
    n = _SPACE | page_id & (1 << 64) - 1 if page_id is not None else _SPACE + (1 << 64)
    return f"<urn:uuid:{uuid.UUID(int=n)}>"


def page_of(record: str) -> int | None:
    whole = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    if whole >> 64 != _SPACE >> 64:
        return None
    n = whole & (1 << 64) - 1
    return n - (1 << 64) if n >> 63 else n


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_head(page_id: int | None, url: str | None, digest: str, size: int, refers: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers is not None:
        lines += [f"WARC-Refers-To: {record_id(refers)}", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if refers is None else 0)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


class Archive:
    """One archive file: gzip members, renamed into place when complete."""

    def __init__(self, base: str, part: int):
        self.files, root = arrow_files(base)
        self.files.create_dir(root, recursive=True)
        self.path = f"{root}/part-{part:05d}-{uuid.uuid4().hex}.warc.gz"
        self.uri = f"{base}/{self.path.rsplit('/', 1)[1]}"
        self.out = self.files.open_output_stream(self.path + ".open", compression=None)
        self.size = self.records = 0

    def add(self, head: bytes, payload: memoryview) -> None:
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        self.out.write(z.compress(head))
        for i in range(0, len(payload), CHUNK):
            self.out.write(z.compress(payload[i : i + CHUNK]))
        self.out.write(z.compress(b"\r\n\r\n") + z.flush())
        self.size += len(head) + len(payload)
        self.records += 1

    def close(self) -> tuple[str, int]:
        self.out.close()
        self.files.move(self.path + ".open", self.path)
        return self.uri, self.records


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to): the rows whose payload a larger page id also has."""
    rows = pages.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("n")).where(F.col("n") >= least_bytes)
    groups = rows.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"))
    return rows.join(groups.where("least < refers_to"), ["digest", "n"]).where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def _prepared(pages: DataFrame) -> DataFrame:
    return pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives; return the manifest (path, records).

    Null html is an empty payload. A null page id is written as a response and read as null. Rows that repeat an id and a payload are all
    responses if the id is the largest of its group. Only files of tasks that ended are in the manifest.
    """
    spark = pages.sparkSession
    pages = _prepared(pages)
    again = stored(revisits(pages, least_bytes), "revisits")
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    rows = pages.withColumn("digest", F.sha1("html")).join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")
    schema = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, done = None, []
        for batch in batches:
            html = batch.column(2).cast(pa.large_binary())
            ids, urls, digests, refers = (batch.column(c).to_pylist() for c in (0, 1, 3, 4))
            for i in range(batch.num_rows):
                if out is not None and out.size >= FILE_BYTES:
                    done.append(out.close())
                    out = None
                out = out or Archive(folder, TaskContext.get().partitionId())
                payload = memoryview(html[i].as_buffer())
                own = refers[i]
                out.add(record_head(ids[i], urls[i], base32(digests[i]), len(payload), own), memoryview(b"") if own is not None else payload)
        if out is not None:
            done.append(out.close())
        yield batch_of(schema, [p for p, _ in done], [n for _, n in done])

    return stored(rows.mapInArrow(run, "path string, records long"), "manifest")


class _Bytes:
    """A gzip stream of many members, read forward with bounded memory."""

    def __init__(self, source):
        self.source, self.z, self.raw, self.held, self.ended = source, zlib.decompressobj(31), b"", b"", False

    def _more(self) -> bool:
        while not self.ended:
            if self.z.eof:
                self.raw, self.z = self.z.unused_data + self.raw, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.source.read(CHUNK)
                if not self.raw:
                    self.ended = True
                    return False
            out = self.z.decompress(self.raw, CHUNK)
            self.raw = self.z.unconsumed_tail
            if out:
                self.held += out
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end of the stream."""
        at = 0
        while (i := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                if self.held.strip():
                    raise ValueError("the archive breaks off inside a record")
                return None
        out, self.held = self.held[: i + len(mark)], self.held[i + len(mark) :]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self._more():
                raise ValueError("the archive breaks off inside a record")
            out, self.held = self.held[: min(n, CHUNK)], self.held[min(n, CHUNK) :]
            n -= len(out)
            yield out


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:]) if v}


def read_records(source) -> Iterator[tuple[dict, dict, Iterator[bytes]]]:
    """(WARC fields, HTTP fields, payload pieces) of each record; take the pieces before the next record."""
    stream = _Bytes(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        fields = _fields(head)
        http = stream.until(b"\r\n\r\n")
        rest = stream.pieces(int(fields["content-length"]) - len(http))
        yield fields, _fields(http), rest
        for _ in rest:
            pass
        if b"".join(stream.pieces(4)) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")


def read_warc(manifest: DataFrame, data: bool = True) -> DataFrame:
    """The chunked record table of the archives in ``manifest``; an empty manifest gives none, repeated records repeat.

    Columns: record_id, page_id, record_type, refers_to, chunk_no, chunk_start, data (null
    unless ``data``), digest (of the payload up to the chunk's end), payload_bytes and declared
    (digest) of the whole, last. An empty payload or a revisit has one chunk, number 0.
    """
    names = [("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int64()), ("chunk_start", pa.int64()), ("data", pa.binary()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("declared", pa.string()), ("last", pa.bool_())]
    schema = pa.schema(names)

    def chunks(path: str) -> Iterator[tuple]:
        files, at = arrow_files(path)
        with files.open_input_stream(at, compression=None) as source:
            for fields, http, pieces in read_records(source):
                own, refers, size = fields["warc-record-id"], fields.get("warc-refers-to"), int(http["content-length"])
                said = fields["warc-payload-digest"].removeprefix("sha1:")
                revisit, h, start = fields["warc-type"] == "revisit", hashlib.sha1(), 0
                base = (own, page_of(own), fields["warc-type"], page_of(refers) if refers else None)
                k = 0
                for piece in pieces:
                    h.update(piece)
                    last = start + len(piece) == size
                    yield *base, k, start, piece if data else None, base32(h.hexdigest()), size, said, last
                    start, k = start + len(piece), k + 1
                if k == 0:
                    yield *base, 0, 0, b"" if data else None, said if revisit else base32(h.hexdigest()), size, said, True
                elif start != size:
                    raise ValueError(f"{own}: {start} bytes of {size}")
                if not revisit and base32(h.hexdigest()) != said:
                    raise ValueError(f"{own}: its payload does not have the digest it declares")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for row in chunks(path):
                    rows.append(row)
                    size += 200 + len(row[6] or b"")
                    if size >= 8 << 20:
                        yield batch_of(schema, *map(list, zip(*rows)))
                        rows, size = [], 0
                if rows:
                    yield batch_of(schema, *map(list, zip(*rows)))

    # one row a file: the row-to-task deal is bounded by the number of files
    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(run, "record_id string, page_id long, record_type string, refers_to long, chunk_no long, chunk_start long, data binary, digest string, payload_bytes long, declared string, last boolean")


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write, read back, and give one row per record from its last chunk."""
    manifest = write_warc(pages, shared_dir(spark, "warc"), least_bytes)
    return read_warc(manifest, data=False).where("last").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
