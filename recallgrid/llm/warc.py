"""WARC archives: writing pages, normalising monolithic gzip files, and reading back by offset.

write_monolithic() writes archives as some crawlers do: one gzip stream around a whole file, which can't be entered
anywhere but at its start. normalise() inflates each such stream once, rewrites every record as a gzip member of its
own, and writes a sidecar index of (record, offset, length). read_records() then opens any record by its offset.

Files lie in a folder that all executors share and are opened by pyarrow.fs from its URI. A task writes files under
names of its own attempt and reports them in a manifest; files of attempts that failed are in no manifest.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.common import shared_path, write_shared
from recallgrid.llm.phraseindex import MOST_BROADCAST

#: Payload bytes after which a task begins another archive; a record itself is never split.
ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 20
LEVEL = 1
_GZIP = 16 + zlib.MAX_WBITS
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(text: str) -> str:
    """A header's value on one line: blanks and control characters as percent codes."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response, or a revisit of the record refers_to, which has the headers of the payload but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, block, the record's bytes) from the bytes of an archive, holding one record and one chunk at a time."""
    data = bytearray()
    ended = False
    while True:
        end = data.find(b"\r\n\r\n")
        need = None
        if end >= 0:
            lines = bytes(data[:end]).decode("utf-8", "surrogatepass").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record: {lines[0][:60]!r}")
            headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
            need = end + 4 + int(headers["content-length"]) + 4
        if need is not None and len(data) >= need:
            whole = bytes(data[:need])
            del data[:need]
            yield headers, whole[end + 4 : need - 4], whole
            continue
        if ended:
            if data:
                raise ValueError(f"the archive ends within a record, {len(data)} bytes")
            return
        while not ended and (need is None or len(data) < need):
            chunk = next(chunks, None)
            if chunk is None:
                ended = True
            else:
                data += chunk
                if need is None:
                    break


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """A gzip file's content: one stream, or several members after one another."""
    stream = zlib.decompressobj(_GZIP)
    for chunk in chunks:
        while chunk:
            if stream.eof:
                stream = zlib.decompressobj(_GZIP)
            if out := stream.decompress(chunk, 4 * CHUNK):
                yield out
            chunk = stream.unconsumed_tail or stream.unused_data
    if not stream.eof:
        raise ValueError("the gzip stream is cut off")


def _chunks(fs: pyarrow.fs.FileSystem, path: str) -> Iterator[bytes]:
    with fs.open_input_stream(path, compression=None) as f:
        while chunk := f.read(CHUNK):
            yield chunk


def _gz(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, _GZIP)
    return packer.compress(data) + packer.flush()


def _payload(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with refers_to: the largest page_id of the same payload, null for that page itself.

    Payloads of fewer than least_bytes bytes never refer to another. Rows that share the largest id all are
    responses. Null ids are below all others.
    """
    rows = pages.select("page_id", F.sha1(_payload(F.col("html"))).alias("sha1")).where(F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes)
    largest = rows.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    revisits = rows.join(largest, "sha1").where("page_id is null or page_id < refers_to").select(F.col("page_id").alias("__page"), F.col("sha1").alias("__sha1"), "refers_to").distinct()
    revisits = write_shared(revisits, "revisits")
    if revisits.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:  # else pages are shuffled by id and payload
        revisits = F.broadcast(revisits)
    return pages.join(revisits, F.col("page_id").eqNullSafe(F.col("__page")) & (F.sha1(_payload(F.col("html"))) == F.col("__sha1")), "left").select("page_id", "url", "html", "refers_to")


def write_monolithic(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes pages (with refers_to) as archives of one gzip stream each; returns the manifest: archive, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pyarrow.fs.FileSystem.from_uri(folder)
        out = packer = None
        name, n, size, done = "", 0, 0, []

        def close() -> None:
            out.write(packer.flush())
            out.close()
            done.append((name, n))

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for page_id, url, html, refers_to in zip(*columns, strict=True):
                if out is None:
                    fs.create_dir(top, recursive=True)
                    name, n, size = f"{top}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, packer = fs.open_output_stream(name, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, _GZIP)
                data = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to, date)
                out.write(packer.compress(data))
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["archive", "records"])

    return write_shared(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "archive string, records long"), "manifest")


def _one_each(manifest: DataFrame) -> DataFrame:
    """An archive's row alone in a task's batch where there are tasks enough: archives are large, their rows small."""
    n = manifest.count()
    return manifest.repartition(min(n, 100_000)) if n else manifest


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive of the manifest with a gzip member for each record; returns archive, index, records.

    The index beside an archive has a line of JSON for each record: id, type, offset, length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            done = []
            for source in batch.column(0).to_pylist():
                fs.create_dir(top, recursive=True)
                name, offset, n = f"{top}/{uuid.uuid4().hex}", 0, 0
                with fs.open_output_stream(f"{name}.warc.gz", compression=None) as out, fs.open_output_stream(f"{name}.idx", compression=None) as index:
                    for headers, _, whole in split_records(inflate(_chunks(fs, source))):
                        member = _gz(whole)
                        out.write(member)
                        index.write((json.dumps({"id": headers["warc-record-id"], "type": headers["warc-type"], "offset": offset, "length": len(member)}) + "\n").encode())
                        offset, n = offset + len(member), n + 1
                done.append((f"{name}.warc.gz", f"{name}.idx", n))
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.int64())], ["archive", "index", "records"])

    return write_shared(_one_each(manifest).select("archive").mapInArrow(run, "archive string, index string, records long"), "normalised")


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read_records(normalised: DataFrame, folder: str) -> DataFrame:
    """For each record, opened at the offset that the index gives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's digest is computed from its payload and must be the header's; a revisit's length and digest are those
    that its headers give of the payload it refers to.
    """

    def rows(fs: pyarrow.fs.FileSystem, archive: str, index: str) -> Iterator[tuple]:
        with fs.open_input_stream(index, compression=None) as f:
            entries = [json.loads(line) for line in f.read().splitlines()]
        with fs.open_input_file(archive) as f:
            for entry in entries:
                f.seek(entry["offset"])
                ((headers, block, _),) = split_records(iter([zlib.decompress(f.read(entry["length"]), _GZIP)]))
                http, _, payload = block.partition(b"\r\n\r\n")
                told = headers["warc-payload-digest"].removeprefix("sha1:")
                size = int(http.rpartition(b"Content-Length:")[2])
                if headers["warc-type"] == "response" and (len(payload), digest(payload)) != (size, told):
                    raise ValueError(f"{archive} at {entry['offset']}: the payload isn't what its headers say")
                yield _page(headers["warc-record-id"]), size, told, headers["warc-type"], _page(headers.get("warc-refers-to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for archive, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(rows(fs, archive, index))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    return _one_each(normalised).select("archive", "index").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes pages (page_id, url, html), normalises the archives, and returns their records as read_records() does.

    One record for each row: repeated rows, null ids and null urls too; a null html is an empty payload. Other
    columns of pages aren't written. An empty table gives no archive and no rows. Without a folder, archives go to
    the shared one until the driver ends.
    """
    folder = folder or shared_path(pages.sparkSession, "warc")
    manifest = write_monolithic(with_revisits(pages, least_bytes), f"{folder}/monolithic")
    return read_records(normalise(manifest, f"{folder}/records"), folder)
