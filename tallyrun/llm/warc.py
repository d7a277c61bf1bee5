"""WARC archives: written by Spark's own file writer, read back by a salvaging reader.

Each record is a gzip member of its own. Spark's text writer puts out a column's bytes and a separator as they are, and a
member's last byte is the high byte of its length, 0 for members below 16 MiB, so that the separator is this byte; a larger
member gets an empty one behind it. Files thus come from the commit protocol and reach any store that Spark writes to.

The reader checks every member (compression, checksum), the version line, the lengths and the block's digest (MD5, SHA-1 or
SHA-256, in hex or base32). A member may hold many records. After a failed check it looks for the next place where a member
or a version line begins a record that passes all checks, goes on there and logs the bytes between as a quarantined gap;
inside a member it does the same and logs them by their place in what the member inflates to. A head is looked for up to the
next version line only, so that the time is linear in the archive. What inflates beyond ``LARGEST`` bytes is a gap.

Defined cases: a null payload is empty, a null address gives a record without one; records of equal payloads of at least
``MIN_BYTES`` refer to the one with the smallest key (null keys last, one of equal rows); an empty table gives archives
without such records; a payload of any length is written and read whole, up to what one row can hold (2 GB, and ``LARGEST``
for the reader); other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .common import column

MIN_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
LEVEL = 6
#: Bytes that the decompressor gets at a time, and of payloads that the reader gathers.
FEED, GATHERED = 1 << 14, 1 << 23

#: Bytes that one member may inflate to: a member of a few kB can hold gigabytes of one letter, and would end an executor.
LARGEST = 1 << 30

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(row: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{row}:{digest}'.encode()).digest())}>"


def member(data: bytes) -> bytes:
    """A gzip member without its last byte, which is 0."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = packer.compress(data) + packer.flush()
    if out[-1]:
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        out += packer.compress(b"") + packer.flush()
    return out[:-1]


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    named = [*headers, ("WARC-Block-Digest", "md5:" + hashlib.md5(block).hexdigest()), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(row: int, key: str | None, url: str | None, digest: str, payload: bytes | None, of: int | None = None) -> bytes:
    """A response with its payload, or a revisit of the page in row ``of``."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    about = [
        ("WARC-Type", "response" if of is None else "revisit"), ("WARC-Record-ID", record_id(row, digest)), ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else quote(url, safe="%:/?#[]@!$&'()*+,;=~-._")), ("Record-Key", key), ("WARC-Payload-Digest", "sha256:" + digest),
        ("WARC-Refers-To", None if of is None else record_id(of, digest)), ("WARC-Profile", None if of is None else PROFILE), ("Content-Type", "application/http;msgtype=response")]
    return record(about, head + (payload or b""))


def _gathered(batch: pa.RecordBatch, names: list[str], make, kinds: list[pa.DataType], out: list[str], first: list[tuple] = ()) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """What ``make`` returns for each row, in batches of a bounded size; the last item of a row counts for it."""
    rows, size = list(first), 0
    batch_of = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], out)
    columns = [column(batch, c) for c in names]
    for i in range(batch.num_rows):
        rows.append(make(*(c[i].as_py() for c in columns)))
        size += len(rows[-1][-1])
        if size > GATHERED:
            yield batch_of()
            rows, size = [], 0
    yield batch_of()


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_BYTES) -> None:
    """Writes one archive per task to ``folder``.

    Every page becomes a finished response member first, so that only compressed members are kept and shuffled; a page that
    turns out to be a copy gets a revisit member in its place.
    """
    body = F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").cast("string").alias("name"), F.col(f"`{url}`").alias("url"), body.alias("payload"))
    kept = ["row", "name", "url", "digest", "size", "member"]

    def pack(row: int, name: str, address: str, data: bytes) -> tuple:
        digest = hashlib.sha256(data)
        return row, name, address, digest.digest(), len(data), member(page_record(row, name, address, digest.hexdigest(), data))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _gathered(batch, ["row", "name", "url", "payload"], pack, [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.binary()], kept)

    # one pass, since another reading of the input may number its rows otherwise
    made = stored(rows.mapInArrow(packed, "row long, name string, url string, digest binary, size long, member binary"))
    typed = F.col("name").cast(pages.schema[key].dataType)
    first = made.where(F.col("size") >= min_bytes).groupBy(F.col("digest").alias("shared")).agg(F.min(F.struct(typed.isNull().alias("none"), typed.alias("key"), F.col("row"))).alias("first"))
    told = made.join(first, F.when(F.col("size") >= min_bytes, F.col("digest")) == F.col("shared"), "left").withColumn("of", F.when(F.col("first.row") != F.col("row"), F.col("first.row")))
    told = told.select(*kept[:-1], F.when(F.col("of").isNull(), F.col("member")).alias("member"), "of")

    def final(row: int, name: str, address: str, digest: bytes, size: int, ready: bytes | None, of: int | None) -> tuple:
        return (ready if of is None else member(page_record(row, name, address, digest.hex(), None, of)),)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")]
        begin = [(member(record(info, b"format: WARC file version 1.1\r\n")),)]
        for batch in batches:
            yield from _gathered(batch, [*kept, "of"], final, [pa.binary()], ["record"], begin)
            begin = []

    told.mapInArrow(written, "record binary").select(F.col("record").cast("string")).write.option("lineSep", "\0").text(folder)


@dataclass
class Record:
    """``inside`` is the record's place in what its member, from ``start`` to ``end``, inflates to."""

    start: int
    end: int
    headers: dict[str, str]
    block: bytes
    inside: int = 0


@dataclass
class Gap:
    """Quarantined bytes; ``inside`` is their range in what the member, from ``start`` to ``end``, inflates to."""

    start: int
    end: int
    reason: str
    inside: tuple[int, int] | None = None


def _inflated(data: bytes, at: int) -> tuple[bytes, int] | str:
    packer, out, to, size = zlib.decompressobj(31), [], at, 0
    try:
        while not packer.eof:
            if to >= len(data):
                return "member is cut off"
            out.append(packer.decompress(data[to : to + FEED]))
            to, size = to + FEED, size + len(out[-1])
            if size > LARGEST:
                return "member is too large"
    except zlib.error:
        return "member does not inflate"
    return b"".join(out), min(to, len(data)) - len(packer.unused_data)


def _parsed(data: bytes, at: int) -> Record | str:
    """The record whose version line is at ``at``."""
    line = LINE.match(data, at)
    if not line:
        return "no version line"
    further = data.find(b"\nWARC/", line.end() - 1)
    stop = data.find(b"\r\n\r\n", line.end() - 2, further if further >= 0 else len(data))
    if stop < 0:
        return "headers do not end"
    headers = dict(re.findall(r"^([^:\r\n]+):[ \t]*([^\r\n]*)", data[line.end() : stop].decode("utf-8", "replace"), re.M))
    headers = {k.lower(): v for k, v in headers.items()}
    length = headers.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", length):
        return "no length"
    upto = stop + 4 + int(length)
    block = data[stop + 4 : upto]
    if data[upto : upto + 4] != b"\r\n\r\n":
        return "length does not fit"
    kind, _, stated = headers.get("warc-block-digest", "").partition(":")
    if (kind := kind.strip().lower().replace("-", "")) in ("md5", "sha1", "sha256"):
        digest, stated = hashlib.new(kind, block), stated.strip()
        if stated.lower() != digest.hexdigest() and stated.upper().rstrip("=") != base64.b32encode(digest.digest()).decode().rstrip("="):
            return "block digest does not fit"
    return Record(at, upto + 4, headers, block)


def _at(data: bytes, at: int, packed: bool) -> tuple[list[Record | Gap], int] | str:
    """The records at a place and where they end, or what is wrong."""
    if packed and data[at : at + 3] == b"\x1f\x8b\x08":
        found = _inflated(data, at)
        if isinstance(found, str):
            return found
        whole, end = found
        held = list(salvaged(whole, packed=False))
        if whole and not any(isinstance(x, Record) for x in held):
            return held[0].reason if held else "empty member"
        return [Record(at, end, x.headers, x.block, x.start) if isinstance(x, Record) else Gap(at, end, x.reason, (x.start, x.end)) for x in held], end
    if data[at : at + 5] == b"WARC/":
        found = _parsed(data, at)
        return found if isinstance(found, str) else ([found], found.end)
    return "no member or version line" if packed else "no version line"


LINE = re.compile(rb"WARC/(?:1\.[01]|0\.1[78])\r\n")
BEGIN, BEGIN_PLAIN = re.compile(rb"\x1f\x8b\x08|(?<=\n)WARC/[01]\."), re.compile(rb"(?<=\n)WARC/[01]\.")


def salvaged(data: bytes, packed: bool = True) -> Iterator[Record | Gap]:
    """All records that pass their checks, and the gaps between them; ``packed`` data may hold members."""
    at, gap = 0, None
    while at < len(data):
        if gap is None and data[at] == 0:  # padding after a member
            at += 1
            continue
        found = _at(data, at, packed)
        if isinstance(found, str) or (gap and not found[0]):
            gap = gap or Gap(at, at, found if isinstance(found, str) else "empty member")
            again = (BEGIN if packed else BEGIN_PLAIN).search(data, at + 1)
            at = again.start() if again else len(data)
            continue
        if gap:
            yield Gap(gap.start, at, gap.reason)
            gap = None
        yield from found[0]
        at = found[1]
    if gap:
        yield Gap(gap.start, len(data), gap.reason)


FIELDS = ("archive", "start", "end", "problem", "record_type", "record_id", "refers_to", "key", "url", "stated_digest", "payload")


def read_archives(spark: SparkSession, folder: str, pattern: str = "part-*") -> DataFrame:
    """One row per record or gap: ``problem`` says why a gap's bytes are quarantined, and is null for records.

    A record's payload is what follows the HTTP header in its block; a revisit has none.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 7, pa.binary()]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(FIELDS))
        for batch in batches:
            for i in range(batch.num_rows):
                path, rows, size = column(batch, "path")[i].as_py(), [], 0
                for x in salvaged(column(batch, "content")[i].as_py()):
                    if isinstance(x, Gap):
                        rows.append((path, x.start, x.end, x.reason, *[None] * 7))
                        continue
                    get = x.headers.get
                    data = x.block.partition(b"\r\n\r\n")[2] if get("content-type", "").startswith("application/http") else x.block
                    rows.append((path, x.start, x.end, None, get("warc-type"), get("warc-record-id"), get("warc-refers-to"), get("record-key"), get("warc-target-uri"), get("warc-payload-digest", "").removeprefix("sha256:"), data))
                    size += len(data)
                    if size > GATHERED:
                        yield batch_of(rows)
                        rows, size = [], 0
                yield batch_of(rows)

    strings = ", ".join(f"{f} string" for f in FIELDS[3:-1])
    return files.mapInArrow(run, f"archive string, start long, end long, {strings}, payload binary")


def payloads(records: DataFrame) -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) of pages' records; revisits take what they refer to.

    A revisit whose response is lost has its stated digest and no length.
    """
    response = F.col("record_type") == "response"
    # archives are read once: what is kept of a record is its key, short digests of the ids that join, and what it says
    short = lambda c: F.unhex(F.md5(F.col(c).cast("binary")))
    known = stored(records.where("problem IS NULL AND record_type IN ('response', 'revisit')").select(
        "record_type", "key", F.when(response, short("record_id")).otherwise(short("refers_to")).alias("record_id"),
        F.when(response, F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.unhex(F.when(response, F.sha2("payload", 256)).otherwise(F.col("stated_digest"))).alias("payload_digest")))
    responses = known.where("record_type = 'response'").select("record_id", "key", "payload_bytes", "payload_digest")
    revisits = known.where("record_type = 'revisit'").select("key", "record_id", F.col("payload_digest").alias("stated_digest"))
    of = responses.select("record_id", F.col("key").alias("of"), "payload_bytes", "payload_digest")
    told = revisits.join(of, "record_id", "left").select("key", "payload_bytes", F.coalesce("payload_digest", "stated_digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("of").alias("refers_to"))
    both = responses.select("key", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to")).unionByName(told)
    return both.withColumn("payload_digest", F.lower(F.hex("payload_digest")))
