"""WARC archives: written whole, normalised to one gzip member per record, read by index.

``write_archives`` writes pages as WARC records into monolithic archives: one gzip stream
for a whole file, as some crawlers leave them. ``normalise`` inflates such a stream once,
from front to back, writes every record as a gzip member of its own and keeps the place of
each in a sidecar index. ``read_archives`` fetches records by index.

Files go where ``spark.checkpoint.dir`` points, through a file system that all executors
share; a task holds one record at a time. A file is named after its partition and attempt,
and only files that a finished task has reported are read, so a lost executor or a second
attempt leaves nothing half-written in the result.

Defined results: a null page is empty; of pages with equal payloads of at least ``LEAST``
bytes the one with the largest id holds the payload and the others revisit it; rows that
repeat that id are each a response; a null id counts as smaller than any; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm.common import scratch_path, text_of, written

LEAST = 1000               # shorter payloads are never replaced by a revisit
ROLL_BYTES = 256 << 20     # an archive is closed after this much record data
READ_BYTES = 1 << 20
DATE = "2000-01-01T00:00:00Z"   # pages carry no time
END = b"\r\n\r\n"

RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


# --- records ----------------------------------------------------------------


def _identity(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(identity: str) -> int | None:
    name = identity[len("<urn:page:") : -1]
    return None if name == "null" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One uncompressed WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_identity(page_id)}",
        f"WARC-Date: {DATE}", "WARC-Target-URI: " + "".join((url or "about:blank").split()),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {_identity(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return dict(line.split(": ", 1) for line in lines[1:])


def parsed(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of a record."""
    head, rest = raw.split(END, 1)
    fields = _fields(head)
    block = rest[: int(fields["Content-Length"])]
    page, kind = _page(fields["WARC-Record-ID"]), fields["WARC-Type"]
    named = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if kind == "revisit":
        return page, int(fields["X-Payload-Length"]), named, kind, _page(fields["WARC-Refers-To"])
    payload = block.split(END, 1)[1]
    digest = hashlib.sha1(payload).hexdigest()
    if digest != named:
        raise ValueError(f"payload of page {page} does not have its digest")
    return page, len(payload), digest, kind, None


# --- files ------------------------------------------------------------------


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _task_name() -> str:
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"{context.partitionId():06d}-{context.taskAttemptId()}"


class _Output:
    """A file of records, as one gzip stream or one member for each."""

    def __init__(self, uri: str, level: int, whole: bool) -> None:
        from pathlib import PurePosixPath

        system, path = _opened(uri)
        system.create_dir(str(PurePosixPath(path).parent), recursive=True)
        self.file = system.open_output_stream(path, compression=None)
        self.level, self.uri, self.size, self.taken, self.records = level, uri, 0, 0, 0
        self.stream = zlib.compressobj(level, zlib.DEFLATED, 31) if whole else None

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.size += len(data)

    def add(self, raw: bytes) -> tuple[int, int]:
        """Place and length of the member, where each record has one."""
        begin = self.size
        if self.stream:
            self._put(self.stream.compress(raw))
        else:
            member = zlib.compressobj(self.level, zlib.DEFLATED, 31)
            self._put(member.compress(raw) + member.flush())
        self.taken += len(raw)
        self.records += 1
        return begin, self.size - begin

    def close(self) -> None:
        if self.stream:
            self._put(self.stream.flush())
        self.file.close()


def write_archives(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write decided pages as monolithic archives; a written table ``(archive, records)``."""

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, number, done = _task_name(), None, 0, []
        for batch in batches:
            for page, url, text, digest, revisit, refers in zip(*(c for c in batch.columns)):
                if out is None:
                    out = _Output(f"{folder}/whole/part-{name}-{number}.warc.gz", level, True)
                payload = (text.as_py() or "").encode()
                out.add(record(page.as_py(), url.as_py(), payload, digest.as_py(), refers.as_py(), revisit.as_py()))
                if out.taken > ROLL_BYTES:
                    out.close()
                    done.append((out.uri, out.records))
                    out, number = None, number + 1
        if out:
            out.close()
            done.append((out.uri, out.records))
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["archive", "records"]
        )

    rows = pages.select("page_id", "url", "_payload", "_digest", "_revisit", "_refers")
    return written(rows.mapInArrow(archive, "archive string, records bigint"), "warc-whole")


def _records(uri: str) -> Iterator[bytes]:
    """Records of a gzip archive, inflated once from front to back."""
    system, path = _opened(uri)
    buffer, inflater = bytearray(), zlib.decompressobj(31)
    with system.open_input_stream(path, compression=None) as file:
        while data := file.read(READ_BYTES):
            while data:
                # A bounded piece at a time: a stream may inflate a thousandfold.
                buffer += inflater.decompress(data, READ_BYTES)
                data = inflater.unconsumed_tail
                if inflater.eof:
                    data, inflater = inflater.unused_data, zlib.decompressobj(31)
                yield from _taken(buffer)
    buffer += inflater.flush()
    yield from _taken(buffer)
    if buffer:
        raise ValueError(f"{uri} ends within a record")


def _taken(buffer: bytearray) -> Iterator[bytes]:
    """Take whole records off the front of the buffer."""
    while (at := buffer.find(END)) >= 0:
        length = int(_fields(bytes(buffer[:at]))["Content-Length"])
        stop = at + len(END) + length + len(END)
        if len(buffer) < stop:
            return
        raw = bytes(buffer[:stop])
        del buffer[:stop]
        yield raw


def _spread(files: DataFrame) -> DataFrame:
    """One file to a task."""
    return files.repartition(max(1, files.count()))


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrite monolithic archives; a written table ``(archive, index, records)``.

    The index has a line for each record: place, length, type and id.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, done = _task_name(), []
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                target = f"{folder}/members/part-{name}-{len(done)}.warc.gz"
                out, lines = _Output(target, level, False), []
                for raw in _records(uri):
                    at, length = out.add(raw)
                    fields = _fields(raw[: raw.index(END)])
                    lines.append(f"{at} {length} {fields['WARC-Type']} {fields['WARC-Record-ID']}\n")
                out.close()
                system, path = _opened(f"{target}.idx")
                with system.open_output_stream(path, compression=None) as index:
                    index.write("".join(lines).encode())
                done.append((target, f"{target}.idx", len(lines)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))],
            ["archive", "index", "records"],
        )

    rows = _spread(archives.select("archive")).mapInArrow(rewrite, "archive string, index string, records bigint")
    return written(rows, "warc-members")


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of normalised archives, fetched by its index entry."""
    names = [f.strip().split(" ")[0] for f in RECORD.split(",")]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, path = _opened(index)
                with system.open_input_stream(path, compression=None) as file:
                    entries = [line.split(" ") for line in file.read().decode().splitlines()]
                system, path = _opened(uri)
                with system.open_input_file(path) as file:
                    for begin in range(0, len(entries), 5000):
                        rows = [
                            parsed(zlib.decompress(file.read_at(int(length), int(at)), 31))
                            for at, length, *_ in entries[begin : begin + 5000]
                        ]
                        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return _spread(archives.select("archive", "index")).mapInArrow(fetch, RECORD)


def decided(pages: DataFrame) -> DataFrame:
    """Pages with payload, digest and whether they revisit another page's payload."""
    named = pages.select("page_id", "url", text_of("html").alias("_payload"))
    rows = named.withColumn("_digest", F.sha1(F.col("_payload").cast("binary")))
    long = rows.filter(F.octet_length("_payload") >= LEAST)
    # Combined before the shuffle: a payload that a third of the pages share is one row per task.
    shared = long.groupBy("_digest").agg(F.max("page_id").alias("_keeper"), F.count("*").alias("_n")).filter("_n > 1")
    found = rows.join(written(shared.select("_digest", "_keeper"), "warc-shared"), "_digest", "left")
    revisit = F.col("_keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_keeper"))
    return found.withColumn("_revisit", revisit).withColumn("_refers", F.when(revisit, F.col("_keeper")))


def archived(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write, normalise and read back; one row per record."""
    folder = folder or scratch_path(spark, "warc")
    return read_archives(normalise(write_archives(decided(pages), folder), folder))


ORACLE = f"""
WITH p AS (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS digest FROM pages
), k AS (SELECT digest, max(page_id) AS keeper FROM p WHERE n >= {LEAST} GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
    CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM p LEFT JOIN k USING (digest)
"""
