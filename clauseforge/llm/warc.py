"""WARC archives compressed with Zstandard: one frame a record, with the
dictionary they share in a leading skippable frame.

An archive is a row ``(path, content binary)``, as Spark's binaryFile source
reads files and as ``write_archives`` makes them, so archives pass through any
store that Spark itself reads and writes."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")

DATE = "2024-01-01T00:00:00Z"  # no clock: equal input gives equal archives
ARCHIVE_BYTES = 8_000_000  # payload of an archive before the next begins
DICTIONARY_BYTES, SAMPLE_BYTES = 16_384, 1_000_000
LEVEL = 3
STEP = 16_384  # compressed bytes given to the decoder at a time


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None) -> str:
    """A header value on one line: control, space and non-ASCII bytes as %XX."""
    return re.sub(rb"[^\x21-\x7e]", lambda m: b"%%%02X" % m[0][0], (url or "").encode()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = DATE) -> bytes:
    """A response record, or with ``refers_to`` a revisit of that page's: it
    keeps the HTTP headers and leaves the payload out."""
    revisit = refers_to is not None
    block = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    ) + (b"" if revisit else payload)
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": _uri(url),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": "sha1:" + digest(payload),
        "WARC-Block-Digest": "sha1:" + digest(block),
    }
    if revisit:
        head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": REVISIT_PROFILE}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if k != "WARC-Target-URI" or v)
    return VERSION + b"\r\n" + lines.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block; ValueError for a bad version,
    header or length, or a block that does not have its digest."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (VERSION, b"WARC/1.0"):
        raise ValueError("not a WARC record")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip() or name != name.strip():
            raise ValueError(f"bad header line {line[:80]!r}")
        headers[name.decode().lower()] = value.strip().decode()
    if missing := [k for k in NEEDED if k not in headers]:
        raise ValueError(f"headers missing: {', '.join(missing)}")
    size = headers["content-length"]
    if not size.isascii() or not size.isdigit() or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"content length {size} does not fit the record")
    block = rest[:-4]
    if (d := headers.get("warc-block-digest")) and d != "sha1:" + digest(block):
        raise ValueError("block digest differs")
    return headers, block


def parse_http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        raise ValueError("not an HTTP response")
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.decode().lower(): v.strip().decode() for k, _, v in pairs}, body


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary; b'' where the samples are too few to train one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def pack(records: list[bytes], dictionary: bytes = b"", level: int = LEVEL) -> bytes:
    """An archive: the dictionary frame (also where it is empty), then a frame
    for each record."""
    out = [struct.pack("<II", DICTIONARY_FRAME, len(dictionary)), dictionary]
    press = zstandard.ZstdCompressor(
        level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True, write_checksum=True
    )
    out.extend(press.compress(r) for r in records)
    return b"".join(out)


def unpack(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame decoded at a time.  The dictionary
    may itself be a Zstandard frame.  ValueError for anything else than frames."""
    at, data = 0, None
    view = memoryview(archive)
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", archive, 4)[0]
        raw = bytes(view[8 : 8 + size])
        if len(raw) != size:
            raise ValueError("the dictionary frame is cut short")
        if raw.startswith(FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        data = zstandard.ZstdCompressionDict(raw) if raw else None
        at = 8 + size
    unpress = zstandard.ZstdDecompressor(dict_data=data) if data else zstandard.ZstdDecompressor()
    while at < len(archive):
        one, parts, begin = unpress.decompressobj(), [], at
        while not one.eof:
            if at >= len(archive):
                raise ValueError(f"the frame at byte {begin} is cut short")
            part = view[at : at + STEP]
            try:
                parts.append(one.decompress(part))
            except zstandard.ZstdError as x:
                raise ValueError(f"bad frame at byte {begin}: {x}") from x
            at += len(part)
        at -= len(one.unused_data)
        if out := b"".join(parts):
            yield out


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """``(page_id, url, payload binary, refers_to)``: of equal payloads of at least
    ``min_bytes`` the smallest page_id is kept, for every other row refers_to
    names it.  Copies are found among ids and digests alone, combined before the
    shuffle; payloads move once, by their own ids, so copies do not meet in a task."""
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("key", F.sha2("payload", 256))
    ids = rows.where(F.octet_length("payload") >= min_bytes).select(F.col("page_id").alias("copy"), F.col("key").alias("copy_key"))
    first = ids.groupBy(F.col("copy_key").alias("k")).agg(F.min("copy").alias("first"), F.count("*").alias("n")).where("n > 1")
    refers = ids.join(first, F.col("copy_key") == F.col("k")).where(~F.col("copy").eqNullSafe(F.col("first")))
    refers = refers.select("copy", "copy_key", F.col("first").alias("refers_to")).distinct()
    same = F.col("page_id").eqNullSafe(F.col("copy")) & (F.col("key") == F.col("copy_key"))
    return rows.join(refers.hint("merge"), same, "left").select("page_id", "url", "payload", "refers_to")


def write_archives(rows: DataFrame, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """``(path, content)``: archives of the rows ``mark_revisits`` gives, each of
    about ``archive_bytes`` of payload (a larger page has one to itself), built
    where the rows are.  Each archive's dictionary is trained on its own first
    records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal held, size
            samples, total = [], 0
            for r in held:
                if total >= SAMPLE_BYTES:
                    break
                samples.append(r[:65_536])
                total += len(samples[-1])
            content = pack(held, train_dictionary(samples), level)
            held, size = [], 0
            name = f"pages-{hashlib.sha256(content).hexdigest()[:32]}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], ["path", "content"])

        for b in batches:
            for page, url, payload, to in zip(*(b.column(i) for i in range(4)), strict=True):
                held.append(record(page.as_py(), url.as_py(), payload.as_py(), to.as_py()))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
        if held:
            yield close()

    return rows.mapInArrow(run, "path string, content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """``(page_id, url, record_type, payload binary, payload_bytes, payload_digest,
    refers_to)`` of every record of ``archives(path, content)``.  A revisit has no
    payload, and its length and digest from its headers.  Headers, lengths and
    digests are validated; a faulty archive raises ValueError with its path."""

    def number(urn: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(m[1]) if m else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
        types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                rows, size = [], 0
                try:
                    for raw in unpack(content.as_py() or b""):
                        headers, block = parse_record(raw)
                        http, body = parse_http(block)
                        kind = headers["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        n, d = int(http["content-length"]), headers["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and (len(body) != n or digest(body) != d):
                            raise ValueError("the payload has another length or digest")
                        if kind == "revisit" and body:
                            raise ValueError("a revisit has a payload")
                        rows.append((number(headers["warc-record-id"]), headers.get("warc-target-uri", ""), kind, None if kind == "revisit" else body, n, d, number(headers.get("warc-refers-to"))))
                        size += len(body)
                        if size >= 4_000_000:
                            yield table(rows)
                            rows, size = [], 0
                except (ValueError, KeyError) as x:
                    raise ValueError(f"{path.as_py()}: {x}") from x
                if rows:
                    yield table(rows)

    schema = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    return archives.select("path", "content").mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write every row of ``pages`` to archives in the shared folder and read them
    back.  Null html is an empty payload; an empty payload is one like any other.
    Rows that repeat the smallest page_id are responses too.  A null page_id
    comes back null; it is a revisit where another page has its payload.  A null
    url comes back empty.  An empty table gives no rows; further columns are
    ignored."""
    from clauseforge.llm.storage import materialize

    return read_archives(materialize(write_archives(mark_revisits(pages, min_bytes=min_bytes)), "archives"))
