"""Legacy web archives (ARC) turned into WARC.

Archives are read as whole files by Spark's binary reader, so that any store
Spark reads will do, and unpacked as a stream within the task.  They are
written by Spark's text writer: the blank lines that end a record are its line
separator, the file system and the commit of the output are Spark's.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from datetime import datetime
from uuid import UUID

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.stages import new_path, staged

#: Payloads from this size on are worth a revisit record.
MIN_REVISIT = 1000
#: Bytes of content in one batch of rows.
BATCH = 8 << 20
# The field names of the URL records by ARC version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ARC_ROW = (
    "file string, place bigint, version int, url string, ip string, date string, "
    "content_type string, result_code string, checksum string, content binary"
)


def batches_of(rows: Iterator[tuple], names: list[str], size_of) -> Iterator[pd.DataFrame]:
    """Rows as frames of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += size_of(row)
        if size >= BATCH:
            yield pd.DataFrame(held, columns=names)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=names)


def unpacked(content: bytes) -> io.BufferedIOBase:
    """A stream of the archive; compressed by record or as a whole, or plain."""
    raw = io.BytesIO(content)
    return gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw


# --- ARC ---------------------------------------------------------------------


def version_block(version: int, name: str, date: str) -> bytes:
    """The first record of an ARC file: its version and the names of the fields."""
    body = f"{version} 0 lanewise\n{ARC_FIELDS[version]}\n".encode()
    rest = "" if version == 1 else "200 - - 0 - "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {rest}{len(body)}\n".encode() + body


def escaped(found: re.Match) -> str:
    return "".join(f"%{b:02X}" for b in found[0].encode())


def arc_record(version: int, url: str, date: str, content: bytes) -> bytes:
    """A URL record and its content, as the ARC version lays them out."""
    # White space would end the field, and a version block's scheme the version.
    url = re.sub(r"\s|(?i:(?<=^filedesc):)", escaped, url) or "-"
    kind, size = "text/html", len(content)
    rest = "" if version == 1 else f"200 {hashlib.md5(content).hexdigest()} - 0 - "
    return f"{url} 192.0.2.1 {date} {kind} {rest}{size}\n".encode() + content


def arc_records(content: bytes) -> Iterator[tuple]:
    """Records of one ARC file after its version block.

    Each is place, version, url, ip, date, content type, result code, checksum
    and content.  The version in the first block says how a header line is laid
    out; the declared length says where the content ends.  Lines that are no
    header are passed over, and content cut off by the end of the file is
    returned as far as it goes.
    """
    stream, place, version = unpacked(content), 0, 1
    while line := stream.readline():
        start, place = place, place + len(line)
        header = arc_header(line, version)
        if header is None:
            continue
        *fields, size = header
        body = stream.read(size)
        place += len(body)
        if fields[0].startswith("filedesc://") and (own := version_of(body)):
            version = own
            continue
        yield (start, version, *fields, body)


def version_of(body: bytes) -> int | None:
    """The version of a version block, null for the content of any other record."""
    return int(body[:1]) if re.match(rb"[12] \d", body) else None


def arc_header(line: bytes, version: int) -> tuple | None:
    """url, ip, date, content type, result code, checksum and length of a line."""
    parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
    if parts[0].startswith("filedesc://"):
        # The version is not known yet; the length comes last in both.
        version = 1 if len(parts) < 10 else 2
    tail = 1 if version == 1 else 6
    if len(parts) < 4 + tail or not parts[-1].isdecimal() or not parts[2].isdecimal():
        return None
    result, checksum = (None, None) if version == 1 else parts[-tail : -tail + 2]
    kind = " ".join(parts[3:-tail])
    return (*parts[:3], kind, result, checksum, int(parts[-1]))


def write_arc(rows: DataFrame, folder: str, date: str = "20080101000000") -> None:
    """Write ``version, url, content`` rows as compressed ARC files.

    Each file has one version; a task with rows of both writes two runs of
    records, each behind its own version block.
    """

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if r.version != last:
                    out.append(version_block(r.version, f"part-{r.version}.arc", date))
                    last = r.version
                out.append(arc_record(r.version, r.url or "", date, bytes(r.content)))
            yield pd.DataFrame({"value": out})

    out = rows.select("version", "url", "content").mapInPandas(records, "value binary")
    write_text(out, folder, "\n")


def write_text(records: DataFrame, folder: str, separator: str) -> None:
    """Write a binary column as bytes, one separator after each value."""
    records.select(F.col("value").cast("string")).write.option("lineSep", separator).option(
        "zlib.compress.level", "BEST_SPEED"
    ).option("compression", "gzip").text(folder)


def files_in(spark: SparkSession, folder: str) -> DataFrame:
    """``path, content`` of the files of a folder, one row each."""
    return spark.read.format("binaryFile").load(folder).select("path", "content")


def read_arc(files: DataFrame) -> DataFrame:
    """Records of ARC files, given as ``path, content``."""
    names = [x.split()[0] for x in ARC_ROW.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                found = ((path, *r) for r in arc_records(content))
                yield from batches_of(found, names, lambda r: len(r[-1]))

    return files.mapInPandas(rows, ARC_ROW)


# --- WARC --------------------------------------------------------------------


def http_parts(content: bytes) -> tuple[bytes, bytes] | None:
    """Head and payload of an HTTP response; null if it is none."""
    if not content.startswith(b"HTTP/"):
        return None
    head, gap, body = content.partition(b"\r\n\r\n")
    return head + gap, body


def record_id(url: str, date: str, file: str, place: int) -> str:
    """The same id whenever the same record is converted."""
    name = f"{url} {date} {file.rpartition('/')[2]} {place}".encode()
    return f"<urn:uuid:{UUID(bytes=hashlib.sha1(name).digest()[:16], version=5)}>"


def iso_date(date: str) -> str:
    """The 14 digits of an ARC date as a WARC date; short ones are filled up."""
    digits = (date + "19700101000000"[len(date) :])[:14]
    try:
        when = datetime.strptime(digits, "%Y%m%d%H%M%S")
    except ValueError:
        when = datetime(1970, 1, 1)
    return when.strftime("%Y-%m-%dT%H:%M:%SZ")


def base32_sha1(content: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(content).digest()).decode()


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    """A WARC/1.0 record without the blank lines that end it."""
    fields = fields | {"Content-Length": str(len(block))}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.0\r\n{head}\r\n".encode() + block


def warc_info(file: str) -> bytes:
    name = file.rpartition("/")[2]
    fields = {
        "WARC-Type": "warcinfo",
        "WARC-Record-ID": record_id("warcinfo", "", file, -1),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Filename": name,
        "Content-Type": "application/warc-fields",
    }
    return warc_record(fields, b"software: lanewise\r\nformat: WARC File Format 1.0\r\n")


def converted(file: str, record: tuple, refers: dict | None) -> bytes:
    """The WARC record for an ARC record; a revisit if it refers to another."""
    place, _, url, ip, date, kind, _, _, content = record
    parts = http_parts(content)
    fields = {
        "WARC-Type": "response" if parts else "resource",
        "WARC-Record-ID": record_id(url, date, file, place),
        "WARC-Date": iso_date(date),
        "WARC-Target-URI": url,
        "WARC-IP-Address": ip,
        "Content-Type": "application/http; msgtype=response" if parts else kind,
    }
    payload = parts[1] if parts else content
    fields["WARC-Payload-Digest"] = base32_sha1(payload)
    if refers:
        fields |= {
            "WARC-Type": "revisit",
            "WARC-Profile": REVISIT_PROFILE,
            "WARC-Refers-To": refers["record_id"],
            "WARC-Refers-To-Target-URI": refers["url"],
            "WARC-Refers-To-Date": iso_date(refers["date"]),
        }
        content = parts[0] if parts else b""
    fields["WARC-Block-Digest"] = base32_sha1(content)
    return warc_record(fields, content)


HEAD_ROW = (
    "file string, place bigint, record_id string, url string, date string, "
    "http_head string, payload_bytes bigint, payload_digest string"
)


def arc_heads(files: DataFrame) -> DataFrame:
    """What decides about revisits: ids, digests and HTTP heads, no content."""
    names = [x.split()[0] for x in HEAD_ROW.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield from batches_of(heads(path, content), names, lambda r: len(r[5]) + 200)

    def heads(path: str, content: bytes) -> Iterator[tuple]:
        for place, _, url, _, date, *_, body in arc_records(content):
            head, payload = http_parts(body) or (b"", body)
            digest = hashlib.sha1(payload).hexdigest()
            made = record_id(url, date, path, place)
            yield path, place, made, url, date, head.decode("utf-8", "replace"), len(payload), digest

    return files.mapInPandas(rows, HEAD_ROW)


def revisits(heads: DataFrame, rank: Column, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """``file, refers``: for each file the records that only refer to another.

    Of records with equal payloads of at least ``min_bytes`` the one with the
    largest ``rank`` (null lowest; ties: the larger record id) keeps its
    payload.
    """
    large = heads.where(F.col("payload_bytes") >= min_bytes)
    large = large.select("payload_digest", "file", "place", "record_id", "url", "date", rank.alias("rank"))
    first = F.max(F.struct("rank", "record_id", "url", "date")).alias("first")
    kept = large.groupBy("payload_digest").agg(first, F.count(F.lit(1)).alias("n"))
    kept = staged(kept.where("n > 1").select("payload_digest", "first"), "kept")
    later = large.join(kept, "payload_digest").where("record_id != first.record_id")
    refers = F.struct("place", "first.record_id", "first.url", "first.date")
    return later.groupBy("file").agg(F.collect_list(refers).alias("refers"))


def arc_to_warc(
    spark: SparkSession, arc: str, warc: str, rank: Column | None = None, min_bytes: int = MIN_REVISIT
) -> None:
    """Convert the ARC files of folder ``arc`` to WARC files in folder ``warc``.

    Ids come from the place of a record, dates from its header line, types from
    its content (an HTTP response or a resource), digests from block and
    payload.  ``rank`` is an expression over the rows of :func:`arc_heads`;
    without it the latest record of equal payloads keeps them.

    A file's records stay in one task, at most one archive at a time; which of
    them are revisits reaches the task as a list by file.
    """
    files = files_in(spark, arc)
    heads = staged(arc_heads(files), "heads")
    lists = staged(revisits(heads, F.col("date") if rank is None else rank, min_bytes), "refers")
    pairs = files.join(lists, files["path"] == lists["file"], "left").select("path", "content", "refers")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content, refers in batch.itertuples(index=False):
                to = {r["place"]: r for r in (refers if refers is not None else ())}
                yield pd.DataFrame({"value": [warc_info(path)]})
                made = ((converted(path, r, to.get(r[0])),) for r in arc_records(content))
                yield from batches_of(made, ["value"], lambda r: len(r[0]))

    write_text(pairs.mapInPandas(rows, "value binary"), warc, "\r\n\r\n")


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a file."""
    stream = unpacked(content)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields.get("content-length", 0)))


WARC_ROW = (
    "record_type string, record_id string, url string, date string, refers_to string, "
    "http_head string, payload_bytes bigint, payload_digest string"
)


def read_warc(files: DataFrame) -> DataFrame:
    """Records of WARC files, given as ``path, content``.

    ``payload_bytes`` and ``payload_digest`` (SHA-1 in lower-case hex) are those
    of the full payload: measured where the record holds it, and taken from the
    declared digest and the HTTP length where it is a revisit.
    """
    names = [x.split()[0] for x in WARC_ROW.split(", ")]

    def parsed(content: bytes) -> Iterator[tuple]:
        for fields, block in warc_records(content):
            head, payload = http_parts(block) or (b"", block)
            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
            if fields.get("warc-type") == "revisit":
                told = fields.get("warc-payload-digest", "").rpartition(":")[2]
                digest = base64.b32decode(told).hex()
                length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
                size = int(length[1]) if length else None
            yield (
                fields.get("warc-type"),
                fields.get("warc-record-id"),
                fields.get("warc-target-uri"),
                fields.get("warc-date"),
                fields.get("warc-refers-to"),
                head.decode("utf-8", "replace"),
                size,
                digest,
            )

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                found = batches_of(parsed(content), names, lambda r: len(r[5]) + 200)
                for frame in found:
                    yield frame.astype({"payload_bytes": "Int64"})

    return files.mapInPandas(rows, WARC_ROW)


def http_response(body: Column, headers: dict[str, Column]) -> Column:
    """An HTTP response as bytes with the body and its length."""
    body = F.coalesce(body.cast("binary"), F.lit(b""))
    lines = [F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ")]
    lines += [F.octet_length(body).cast("string"), F.lit("\r\n")]
    for name, value in headers.items():
        lines += [F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("")), F.lit("\r\n")]
    return F.concat(F.concat(*lines, F.lit("\r\n")).cast("binary"), body)


def archived_pages(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Pages put into ARC files, converted to WARC files, and read back.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to``:
    of pages with equal payloads of at least ``MIN_REVISIT`` bytes the one with
    the largest id is the response, the others are revisits that refer to it.
    Pages with even ids go to files of ARC version 1, the others of version 2.

    Nulls: a null html is an empty payload, a null url is archived as ``-``, and
    a null id comes back as null and ranks lowest.  Repeated rows are records of
    their own: one of them keeps the payload.  An empty table gives an empty
    table.  Other columns are not archived.
    """
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    number = F.col(page_id).cast("long")
    version = F.when(F.pmod(number, F.lit(2)) == 1, 2).otherwise(1)
    rows = pages.select(
        version.alias("version"),
        F.col(url).cast("string").alias("url"),
        http_response(F.col(html), {"X-Page-Id": number}).alias("content"),
    )
    write_arc(rows, arc)
    named = F.regexp_extract("http_head", r"(?m)^X-Page-Id: (-?\d+)", 1)
    named = F.nullif(named, F.lit("")).cast("long")
    arc_to_warc(spark, arc, warc, rank=named)
    found = staged(read_warc(files_in(spark, warc)), "warc-rows")
    found = found.where("record_type != 'warcinfo'").withColumn("page_id", named)
    responses = found.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("kept_id")
    )
    revisits = found.where("record_type = 'revisit'").join(responses, "refers_to", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    whole = found.where("record_type != 'revisit'")
    return whole.select(*columns, F.lit(None).cast("long").alias("refers_to")).union(
        revisits.select(*columns, F.col("kept_id").alias("refers_to"))
    )
