"""Web archives (WARC 1.1, a gzip member per record): a writer with revisit records, and a reader that splits files anywhere.

Writing: payloads are compared by SHA-1 and size. Only rows whose payload occurs more than once have a partner in the table of repeats, so pages themselves are
shuffled only if that table is too large to be broadcast. Tasks stream records into files of their own; the manifest names
those that count, as a task that is run again writes others.

Reading: a task gets a range of bytes. It looks for gzip magic from the start of its range, decodes the head of each candidate, and takes it
for a record if a WARC header comes out; then it goes on from member to member. It owns the records that start inside its range and reads the last one
beyond its end. So each record has one owner, whatever the ranges. The writer sees to it that no member holds another one
in plain sight, as may happen where a payload is itself an archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .common import trimmed

MIN_BYTES = 1000
FILE_BYTES = 1 << 30
RANGE_BYTES = 1 << 26
CHUNK = 1 << 18
LEVEL = 6
MAGIC = b"\x1f\x8b\x08"
# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header(fields: list[tuple[str, str | None]]) -> bytes:
    lines = [f"{name}: {value}" for name, value in fields if value is not None]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n"


def _line(value: str | None) -> str | None:
    """A header value: control characters would end the line."""
    return None if value is None else re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(name: str, uri: str | None, payload: bytes | None, size: int, sha1: str, refers_to: str | None, stamp: str) -> bytes:
    """A response record, or a revisit record without payload if it refers to another one."""
    head = b"HTTP/1.1 200 OK\r\n" + _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(size))])
    block = head + (payload if refers_to is None else b"")
    own = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", stamp), ("WARC-Target-URI", _line(uri)),
           ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode())]
    if refers_to is not None:
        own += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<{refers_to}>")]
    own += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + _header(own) + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member. If a reader could take bytes inside for the start of another record, magic in the data is broken up."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    packed = packer.compress(data) + packer.flush()
    inner = packed.find(MAGIC, 1)
    while inner >= 0 and not _opens_record(packed[inner:]):
        inner = packed.find(MAGIC, inner + 1)
    if inner < 0:
        return packed
    packer, out, low = zlib.compressobj(level, zlib.DEFLATED, 31), [], 0
    for found in re.finditer(re.escape(MAGIC), data):
        out += [packer.compress(data[low : found.start() + 1]), packer.flush(zlib.Z_SYNC_FLUSH)]
        low = found.start() + 1
    return b"".join([*out, packer.compress(data[low:]), packer.flush()])


def _opens_record(data: bytes) -> bool:
    try:
        return zlib.decompressobj(31).decompress(data, 64).startswith(b"WARC/")
    except zlib.error:
        return False


def _write(path: str, stamp: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        out, made = None, []
        try:
            for batch in batches:
                for row in zip(*[batch.column(c) for c in ("name", "uri", "payload", "size", "sha1", "refers_to")]):
                    data = member(record(*[v.as_py() for v in row], stamp))
                    if out is None:
                        made.append([f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, 0])
                        out = store.open_output_stream(f"{folder}/{made[-1][0]}", compression=None)
                    out.write(data)
                    made[-1][1] += 1
                    made[-1][2] += len(data)
                    if made[-1][2] >= file_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{path}/{m[0]}" for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())],
            ["path", "records", "bytes"])

    return write


def marked_repeats(pages: DataFrame, page_id: str, url: str, payload: str, min_bytes: int) -> DataFrame:
    """(page, name, uri, payload, size, sha1, refers_to) of each row: which record its payload repeats, if any."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b"").cast("binary"))
    rows = pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).cast("string").alias("uri"), body.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha1"))
    repeats = stored(
        rows.where(F.col("size") >= min_bytes).groupBy("sha1", "size").agg(F.max("page").alias("last"), F.count("*").alias("n")).where("n > 1 AND last IS NOT NULL").drop("n"),
        "repeats")
    # Short payloads cannot meet a row of the table of repeats: it holds their size beside the digest.
    joined = rows.join(repeats, ["sha1", "size"], "left")
    again = F.col("last").isNotNull() & ~F.col("page").eqNullSafe(F.col("last"))
    name = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page").cast("string"), F.lit("null")))
    return joined.select("page", name.alias("name"), "uri", F.when(~again, F.col("payload")).alias("payload"), "size", "sha1",
                         F.when(again, F.concat(F.lit("urn:page:"), F.col("last").cast("string"))).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_BYTES,
                   file_bytes: int = FILE_BYTES, stamp: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row to archives in the folder ``path`` and return their manifest (path, records, bytes). Runs at once.

    The payload is a string, written in UTF-8, or binary; null counts as empty. Of rows with equal payloads of ``min_bytes`` or more, the one with the
    largest page id is a response, as are rows that repeat its id; the others revisit it, rows with null ids, too. If all of them have null ids, all are
    responses. Records are named ``urn:page:`` and the id or ``null``. A null url leaves its header out; control characters of an url are
    percent-encoded. An empty table makes no files. ``stamp`` is the date of all records.
    """
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(path)
    store.create_dir(folder, recursive=True)
    rows = marked_repeats(pages, page_id, url, payload, min_bytes).drop("page")
    return stored(rows.mapInArrow(trimmed(_write(path, stamp, file_bytes)), "path string, records long, bytes long"), "archives")


class RangeReader:
    """Records of one archive that start in a range of bytes."""

    def __init__(self, file, start: int, end: int, path: str = ""):
        self.file, self.start, self.end, self.path = file, start, end, path

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _magic(self, at: int) -> int | None:
        """The next place from ``at`` on, before the end of the range, with gzip magic."""
        step = 4096  # usually the next member starts right here
        while at < self.end:
            data = self._read(at, min(step, self.end - at) + len(MAGIC) - 1)
            found = data.find(MAGIC)
            if found >= 0:
                return at + found
            at, step = at + step, CHUNK
        return None

    def _member(self, at: int) -> tuple[bytes, int] | None:
        """Content and end of the member at a place, or None if it is not the start of a record."""
        unpacker, parts, place, sure = zlib.decompressobj(31), [], at, False
        while not unpacker.eof:
            data = self._read(place, CHUNK if sure else 4096)
            if not data:
                if sure:
                    raise ValueError(f"record at byte {at} of {self.path} is cut off")
                return None
            try:
                parts.append(unpacker.decompress(data))
            except zlib.error as problem:
                if sure:
                    raise ValueError(f"record at byte {at} of {self.path} is damaged") from problem
                return None
            place += len(data)
            if not sure:
                head = b"".join(parts)[: len(b"WARC/")]
                if not b"WARC/".startswith(head):
                    return None
                sure = len(head) == len(b"WARC/")
        return (b"".join(parts), place - len(unpacker.unused_data)) if sure else None

    def records(self) -> Iterator[tuple[int, dict[str, str], bytes]]:
        """Place, header fields in lower case, and block of each record."""
        at = self._magic(self.start)
        while at is not None:
            found = self._member(at)
            if found is None:
                at = self._magic(at + 1)
                continue
            content, after = found
            low = 0
            while low < len(content):  # usually a single record
                head_end = content.find(b"\r\n\r\n", low)
                fields = parse_fields(content[low:head_end]) if head_end >= 0 else {}
                if not content.startswith(b"WARC/", low) or not fields.get("content-length", "").isdigit():
                    raise ValueError(f"member at byte {at} of {self.path} holds no whole record")
                block_end = head_end + 4 + int(fields["content-length"])
                yield at, fields, content[head_end + 4 : block_end]
                low = block_end + 4
            at = self._magic(after)


def parse_fields(head: bytes) -> dict[str, str]:
    """Fields of a header after its first line; names in lower case."""
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {name.strip().lower(): value.strip(" \t") for name, _, value in (line.partition(":") for line in lines)}


def _payload(kind: str, block: bytes) -> tuple[bytes, dict[str, str]]:
    """Payload of a block and the fields of its HTTP header; blocks that are no HTTP message are payloads."""
    if not kind.startswith("application/http"):
        return block, {}
    end = block.find(b"\r\n\r\n")
    return (block[end + 4 :], parse_fields(block[:end])) if end >= 0 else (b"", {})


def _hex(digest: str | None) -> str | None:
    """A SHA-1 digest as archives write it, in base 32 or hex, as lower-case hex."""
    if not digest or not digest.lower().startswith("sha1:"):
        return None
    value = digest[5:]
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


RECORDS = "path string, place long, record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string"


def _read(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def rows(held: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*held))
            kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary()]
            names = [f.split()[0] for f in RECORDS.split(", ")] + ["payload"]
            n = len(names) if with_payload else len(names) - 1
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:n], kinds)], names[:n])

        held, size = [], 0
        for batch in batches:
            for path, start, end in zip(*[batch.column(c).to_pylist() for c in ("path", "start", "end")]):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as file:
                    for at, fields, block in RangeReader(file, start, end, path).records():
                        payload, http = _payload(fields.get("content-type", ""), block)
                        revisit = fields.get("warc-type") == "revisit"
                        if revisit:  # the payload is elsewhere; its headers are here
                            length = http.get("content-length", "")
                            n, digest = int(length) if length.isdigit() else None, _hex(fields.get("warc-payload-digest"))
                        else:
                            n, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        names = [fields.get(f, "").strip("<>") or None for f in ("warc-record-id", "warc-refers-to")]
                        held.append((path, at, names[0], fields.get("warc-type"), fields.get("warc-target-uri"), names[1], n, digest,
                                     None if revisit else payload if with_payload else None))
                        size += len(payload) + 200 if with_payload else 200
                        if size >= 1 << 22:
                            yield rows(held)
                            held, size = [], 0
        if held:
            yield rows(held)

    return read


def read_archives(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """All records of the archives in ``files`` (path as a URI, bytes): path, place (byte at which the member starts), record_id, record_type, target_uri, refers_to,
    payload_bytes, payload_digest (SHA-1 in lower-case hex) and, if asked for, payload.

    Size and digest are those of the payload that was read; of a revisit record, which has none, those that its headers state. Ranges of about
    ``range_bytes`` are dealt to the tasks evenly. Bytes between records that are no record are skipped; a record that is cut off or
    damaged raises an error with its place. A task holds one record at a time besides what it hands on.
    """
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, F.col("bytes")).alias("end"))
    n = files.where("bytes > 0").agg(F.sum(F.ceil(F.col("bytes") / range_bytes)).alias("n")).first().n or 1
    return ranges.repartition(min(int(n), 100_000)).mapInArrow(trimmed(_read(payloads)), RECORDS + (", payload binary" if payloads else ""))
