"""Legacy web archives (ARC) to WARC.

An ARC file begins with a version block, whose second line names the version and whose
third the fields of all header lines that follow: five in version 1, ten in version 2.
A record is a header line and as many bytes as its last field declares. The converter
reads header lines by the fields of their file, takes records by their declared lengths,
and gives each what WARC asks for: an identifier, a time stamp, a type and digests.
Identifiers and digests follow from the record, so that a repeated run gives the same.

Files are written and read by Spark: a record is a row, records end with the line
separator of the text writer, files are gzip, and archives are read whole, one of bounded
size at a time.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestlens.llm.common import saved

#: The fields of header lines by version, as version blocks name them.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Record separators, WARC version line and profile of revisits by equal payload.
ARC_END, WARC_END = "\n", "\r\n\r\n"
WARC_VERSION = b"WARC/1.1"
GZIP = b"\x1f\x8b"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: An archive is closed when it holds this many bytes: one fits into a task's memory many times.
ARCHIVE_BYTES = 8 * 2**20
#: Payloads below this are never revisits.
LEAST_REVISITED = 100
#: A digest with more than this share of all records is joined by broadcast: there are at most as many.
HOT_SHARE = 1000
#: HTTP header that carries the caller's number of a page.
KEY_HEADER = "X-Page-Id"
KEY_LINE = KEY_HEADER.lower().encode()


def line_safe(value: Column) -> Column:
    """A value for a header line: blanks and control characters as percent codes, ``-`` if there is none."""
    codes = [(c, f"%{c:02X}") for c in (*range(33), 127)]
    out = F.coalesce(value.cast("string"), F.lit(""))
    # A character class first: nearly all values have none of these characters.
    escaped = out
    for c, code in codes:
        escaped = F.replace(escaped, F.lit(chr(c)), F.lit(code))
    out = F.when(out.rlike(r"[\x00-\x20\x7F]"), escaped).otherwise(out)
    return F.when(out == "", F.lit("-")).otherwise(out)


def arc_records(pages: DataFrame, date: str = "20000101000000") -> DataFrame:
    """(version, record): pages (page_id, url, html) as ARC records, half of them for each version.

    A NULL html is an empty payload, a NULL page_id leaves its HTTP header out.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    key = F.coalesce(F.concat(F.lit(f"{KEY_HEADER}: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), key,
        F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    ).cast("binary")
    version = F.pmod(F.xxhash64("page_id", "url"), F.lit(2)) + 1
    length = (F.octet_length(http) + F.octet_length(body)).cast("string")
    start = F.concat(line_safe(F.col("url")), F.lit(f" 0.0.0.0 {date} text/html "))
    more = F.when(version == 2, F.lit("200 - - 0 - ")).otherwise(F.lit(""))
    head = F.concat(start, more, length, F.lit("\n")).cast("binary")
    return pages.select(version.cast("int").alias("version"), F.concat(head, http, body).alias("record"))


def arc_start(version: int, name: str) -> bytes:
    """The version block of an ARC file, in the form of its own version."""
    body = f"{version} 0 harvestlens\n{FIELDS[version]}\n".encode()
    more = "200 - - 0 - " if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 20000101000000 text/plain {more}{len(body)}\n".encode() + body


def warc_start(version: int, name: str) -> bytes:
    """A warcinfo record."""
    body = b"software: harvestlens\r\nformat: WARC File Format 1.1\r\n"
    return warc_record(
        {"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(name, 0), "WARC-Date": "2000-01-01T00:00:00Z",
         "WARC-Filename": name, "Content-Type": "application/warc-fields"}, body,
    )


def write_archives(
    records: DataFrame, path: str, start: Callable[[int, str], bytes], end: str, archive_bytes: int = ARCHIVE_BYTES
) -> None:
    """Write (version, record) as archives that each begin with ``start`` and grow to ``archive_bytes`` or by one record more."""
    salt = uuid.uuid4().hex[:8]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        state: dict[int, list] = {}  # version -> number of the archive, its bytes
        written = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                names, out = [], []
                for version, record in zip(*(batch.column(c).slice(at, 256) for c in ("version", "record")), strict=True):
                    version, record = version.as_py(), record.as_py()
                    if version not in state or state[version][1] > archive_bytes:
                        number = state.get(version, [-1])[0] + 1
                        state[version] = [number, 0]
                        first = start(version, f"{salt}-{part:06}-v{version}-{number:05}")
                        names.append(f"{part:06}-v{version}-{number:05}")
                        out.append(first)
                    state[version][1] += len(record)
                    names.append(f"{part:06}-v{version}-{state[version][0]:05}")
                    out.append(record)
                places = pa.array(range(written, written + len(out)), pa.int64())
                written += len(out)
                yield pa.RecordBatch.from_arrays([pa.array(names), places, pa.array(out, pa.binary())], names=["archive", "place", "record"])

    rows = records.select("version", "record").mapInArrow(run, "archive string, place long, record binary")
    # The writer takes a task's rows archive by archive. Bytes pass through it as they are.
    rows = rows.sortWithinPartitions("archive", "place").select("archive", F.col("record").cast("string").alias("value"))
    rows.write.option("lineSep", end).option("compression", "gzip").partitionBy("archive").text(path)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("archive"), "content")


ARC_ROWS = "archive string, offset long, url string, ip string, date string, content_type string, block binary, problem string"


def arc_entries(archive: str, content: bytes) -> Iterator[tuple]:
    """Rows of ARC_ROWS. What cannot be read gives one row with a problem; what follows the place is left out."""
    at, fields = 0, None
    while at < len(content):
        end = content.find(b"\n", at)
        line = content[at : end if end >= 0 else len(content)].rstrip(b"\r")
        if not line:
            at += 1 if end < 0 else end - at + 1
            continue
        # A URL may hold blanks in old files; the other fields may not.
        version_block = fields is None
        if version_block:
            head = content[end + 1 : end + 1 + 4096].split(b"\n", 2)
            fields = head[1].decode("latin-1").split() if end >= 0 and len(head) > 1 and line.startswith(b"filedesc://") else None
        parts = line.decode("utf-8", "replace").rsplit(" ", len(fields) - 1) if fields else []
        named = dict(zip(fields or [], parts, strict=False))
        length = named.get("Archive-length", "")
        problem = None
        if not fields or len(parts) != len(fields) or not length.isascii() or not length.isdigit():
            problem = "no version block" if not fields else "unreadable header line"
        elif end < 0 or end + 1 + int(length) > len(content):
            problem = "shorter than declared"
        if problem:
            yield archive, at, None, None, None, None, None, problem
            return
        block = content[end + 1 : end + 1 + int(length)]
        if not version_block:
            yield archive, at, named["URL"], named["IP-address"], named["Archive-date"], named["Content-type"], block, None
        at = end + 1 + int(length)


def parsed(files: DataFrame, entries: Callable[[str, bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that ``entries`` finds in each archive, compressed or not."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = []
                content = batch.column("content")[k].as_py()
                if content.startswith(GZIP):
                    content = gzip.decompress(content)
                for row in entries(batch.column("archive")[k].as_py(), content):
                    rows.append(row)
                    if len(rows) == 512:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(run, schema)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all ARC files below a folder (ARC_ROWS), of either version."""
    return parsed(archive_files(spark, path), arc_entries, ARC_ROWS)


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """The HTTP head of a block, up to the empty line, and its payload; all is payload without such a head."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, gap, payload = block.partition(b"\r\n\r\n")
    return (head + gap, payload) if gap else (b"", block)


def http_field(head: bytes, name: bytes) -> bytes | None:
    for line in head.split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name:
            return value.strip()
    return None


def number(value: bytes | str | None) -> int | None:
    try:
        return int(value) if value is not None else None
    except ValueError:
        return None


def record_id(archive: str, offset: int) -> str:
    """An identifier that follows from the place of the record in its archive."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def warc_date(date: str) -> str:
    """ISO 8601 of an ARC time stamp of up to 14 digits; the start of the epoch if it has no date."""
    digits = date if date.isascii() and date.isdigit() and len(date) >= 8 else "19700101"
    d = (digits + "000000")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    """A WARC record without the separator after it."""
    lines = [WARC_VERSION, *(f"{k}: {v}".encode() for k, v in fields.items()), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block


MEMBERS = "archive string, offset long, key long, size long, digest string"


def members(arc: DataFrame) -> DataFrame:
    """What deduplication asks of each record: its place, the caller's number, size and SHA-256 of the payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, size, digest = [], [], []
            for block in batch.column("block"):
                head, payload = http_parts(block.as_buffer().to_pybytes())
                key.append(number(http_field(head, KEY_LINE)))
                size.append(len(payload))
                digest.append(sha256(payload).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("archive"), batch.column("offset"), pa.array(key, pa.int64()), pa.array(size, pa.int64()), pa.array(digest)],
                names=["archive", "offset", "key", "size", "digest"],
            )

    return arc.where("problem is null").select("archive", "offset", "block").mapInArrow(run, MEMBERS)


def revisits(found: DataFrame, least: int = LEAST_REVISITED) -> DataFrame:
    """(archive, offset, of_key, of_archive, of_offset) of the records whose payload an earlier one has.

    Earlier is a smaller number, then a smaller place; records without a number come last.
    """
    able = found.where(F.col("size") >= least)
    order = F.struct(F.col("key").isNull().alias("none"), "key", "archive", "offset")
    groups = saved(
        able.groupBy("digest", "size").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "groups"
    )
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > total / HOT_SHARE
    first = groups.select("digest", "size", "n", F.col("first.key").alias("of_key"), F.col("first.archive").alias("of_archive"), F.col("first.offset").alias("of_offset"))
    # At most HOT_SHARE groups are hot: their members stay where they are. The rest has no large group.
    marked = able.join(F.broadcast(first.where(hot).drop("n")), ["digest", "size"], "left")
    near = marked.where("of_archive is not null")
    far = marked.where("of_archive is null").drop("of_key", "of_archive", "of_offset").join(first.where(~hot).drop("n"), ["digest", "size"])
    members_ = near.unionByName(far).where("archive != of_archive or offset != of_offset")
    return members_.select("archive", "offset", "of_key", "of_archive", "of_offset")


def warc_records(arc: DataFrame, seen: DataFrame) -> DataFrame:
    """(version, record): ARC records as WARC ones; those in ``seen`` (of revisits) become revisit records without a payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                block = row.pop("block").as_buffer().to_pybytes()
                row = {c: v.as_py() for c, v in row.items()}
                head, payload = http_parts(block)
                fields = {
                    "WARC-Type": "revisit" if row["of_archive"] else "response" if head else "resource",
                    "WARC-Record-ID": record_id(row["archive"], row["offset"]),
                    "WARC-Date": warc_date(row["date"]),
                    "WARC-Target-URI": row["url"],
                    "WARC-IP-Address": row["ip"],
                    "Content-Type": "application/http; msgtype=response" if head else row["content_type"],
                    "WARC-Payload-Digest": f"sha256:{sha256(payload).hexdigest()}",
                }
                if row["of_archive"]:
                    block = head
                    fields |= {
                        "WARC-Profile": REVISIT_PROFILE,
                        "WARC-Refers-To": record_id(row["of_archive"], row["of_offset"]),
                        "X-Payload-Length": str(len(payload)),
                    }
                    if row["of_key"] is not None:
                        fields["X-Refers-To-Page"] = str(row["of_key"])
                fields["WARC-Block-Digest"] = f"sha256:{sha256(block).hexdigest()}"
                out.append(warc_record(fields, block))
            yield pa.RecordBatch.from_arrays([pa.array([1] * len(out), pa.int32()), pa.array(out, pa.binary())], names=["version", "record"])

    rows = arc.where("problem is null").drop("problem").join(seen, ["archive", "offset"], "left")
    return rows.mapInArrow(run, "version int, record binary")


WARC_ROWS = (
    "archive string, offset long, record_id string, record_type string, date string, url string, page_id long, "
    "payload_bytes long, payload_digest string, refers_to_id string, refers_to long, payload binary, problem string"
)


def warc_entries(archive: str, content: bytes, payloads: bool = True) -> Iterator[tuple]:
    """Rows of WARC_ROWS but for warcinfo records; digests are computed anew and compared. Unreadable ends as for ARC."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        lines = content[at:end].split(b"\r\n") if end >= 0 else []
        fields = {k.decode().lower(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}
        size = number(fields.get("content-length"))
        problem = None
        if not lines or not lines[0].startswith(b"WARC/") or size is None or size < 0:
            problem = "unreadable header"
        elif end + 4 + size > len(content):
            problem = "shorter than declared"
        if problem:
            yield archive, at, *[None] * 10, problem
            return
        block = content[end + 4 : end + 4 + size]
        kind = fields.get("warc-type")
        if kind != "warcinfo":
            head, payload = http_parts(block)
            declared = fields.get("warc-payload-digest", "").removeprefix("sha256:")
            digest = declared if kind == "revisit" else sha256(payload).hexdigest()
            if fields.get("warc-block-digest") != f"sha256:{sha256(block).hexdigest()}" or digest != declared:
                problem = "digest does not match"
            count = number(fields.get("x-payload-length")) if kind == "revisit" else len(payload)
            yield (
                archive, at, fields.get("warc-record-id"), kind, fields.get("warc-date"), fields.get("warc-target-uri"),
                number(http_field(head, KEY_LINE)), count, digest, fields.get("warc-refers-to"),
                number(fields.get("x-refers-to-page")), payload if payloads else None, problem,
            )
        at = end + 4 + size + len(WARC_END)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all WARC files below a folder (WARC_ROWS), with or without their payloads."""
    return parsed(archive_files(spark, path), lambda archive, content: warc_entries(archive, content, payloads), WARC_ROWS)


def converted(spark: SparkSession, arc_path: str, warc_path: str, least: int = LEAST_REVISITED) -> DataFrame:
    """Convert all ARC files below a folder to WARC files in another; the rows that could not be read (archive, offset, problem).

    Of records with equal payloads of at least ``least`` bytes the first stays a response, the others become
    revisits of it. No ARC file gives no WARC file.
    """
    arc = read_arc(spark, arc_path)
    found = saved(members(arc), "members")
    write_archives(warc_records(arc, saved(revisits(found, least), "revisits")), warc_path, warc_start, WARC_END)
    return arc.where("problem is not null").select("archive", "offset", "problem")


def round_trip(pages: DataFrame, arc_path: str, warc_path: str, payloads: bool = False) -> DataFrame:
    """Pages (page_id, url, html) written as ARC files, these converted, and the WARC files read back (WARC_ROWS).

    NULL html is an empty payload; blanks and control characters of a url become percent codes, a missing one ``-``.
    Rows may repeat: each is a record. No pages: no archives and no rows. Other columns are not read.
    """
    spark = pages.sparkSession
    write_archives(arc_records(pages), arc_path, arc_start, ARC_END)
    converted(spark, arc_path, warc_path)
    return read_warc(spark, warc_path, payloads)
