"""Legacy ARC archives converted to WARC, written and read back.

An ARC file is a version block (``filedesc://`` line, version line, field names) and records: a header line of fields
parted by single spaces, the last of them the length of what follows, then so many bytes and a line feed. Version 1
headers have five fields, version 2 headers ten. What follows the header of an http URL is the whole response: status
line, headers, empty line, body. Archives may be gzipped, also record by record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_START = rb"(?P<url>[A-Za-z][A-Za-z0-9+.-]*:[^\r\n]*?) (?P<ip>[0-9A-Fa-f.:]+|-) (?P<date>\d{4,17}|-) (?P<mime>[^\r\n]*?)"
_HEADER = {
    1: re.compile(_START + rb" (?P<length>\d{1,18})\r?\n"),
    2: re.compile(_START + rb" (?P<code>\d{1,3}|-) (?P<sum>\S+) (?P<location>\S+) (?P<offset>\d+|-) (?P<file>\S+) (?P<length>\d{1,18})\r?\n"),
}
CRLF = b"\r\n"
#: Payloads of fewer bytes are stored again rather than referred to.
LEAST_REVISIT = 1000
#: Bytes of an archive file, compressed for WARC; one record may be longer.
ARC_BYTES, WARC_BYTES = 4 << 20, 16 << 20
#: How hard members are compressed: the least is three times as fast as the usual 6 and a tenth larger.
LEVEL = 1


class ArcRecord(NamedTuple):
    """``kind`` is ``record``, ``version`` (the version block) or ``skipped`` (bytes without a usable header; mime says why)."""

    url: str
    ip: str
    date: str
    mime: str
    content: bytes
    kind: str = "record"
    offset: int = 0


def write_arc(records: list[ArcRecord], version: int, name: str = "pages.arc") -> bytes:
    """An ARC file of ``records``; a field that is empty is written as ``-``, white space in a URL as %20."""
    plain = lambda x: re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], x.encode()) or b"-"
    about = f"{version} 0 barquill\n{ARC_FIELDS[version]}\n".encode()
    out = [f"filedesc://{name} 0.0.0.0 19960101000000 text/plain ".encode(), b"200 - - 0 - " if version == 2 else b"", str(len(about)).encode(), b"\n", about, b"\n"]
    at = sum(map(len, out))
    for r in records:
        head = [plain(r.url), plain(r.ip), plain(r.date), plain(r.mime)]
        if version == 2:
            head += [str(http_status(r.content) or "-").encode(), b"-", b"-", str(at).encode(), name.encode()]
        line = b" ".join([*head, str(len(r.content)).encode()]) + b"\n"
        out += [line, r.content, b"\n"]
        at += len(line) + len(r.content) + 1
    return b"".join(out)


def _said(x: bytes) -> str:
    try:
        return x.decode()
    except UnicodeDecodeError:
        return x.decode("latin-1")


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file of either version in order, taken by their declared lengths, whatever they hold.

    The version block comes first, with kind ``version``; a file without one is read as version 1. Where no usable header
    stands (other fields than the version's, a length that is no number or runs past the end), bytes are passed over up to
    the next header whose declared length ends where a header or the end of the file follows, or else to the end; what was
    passed over comes as one record of kind ``skipped``. So does a record whose own length is wrong: one that ends where
    neither a header nor the end follows, unless its HTTP head declares just the body that it has, or a line end follows
    and there is no such header inside it (then what follows is what is damaged). Empty data has no records.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    size, at, version = len(data), 0, 1

    def header(at: int) -> re.Match | None:
        m = _HEADER[version].match(data, at)
        return m if m and m.end() + int(m["length"]) <= size else None

    def after(m: re.Match) -> int:
        """Where the next header should stand: line ends between records are not counted in lengths."""
        to = m.end() + int(m["length"])
        while data[to : to + 1] in (b"\n", b"\r"):
            to += 1
        return to

    def fits(m: re.Match) -> bool:
        to = after(m)
        return to >= size or _HEADER[version].match(data, to) is not None

    def next_header(at: int, end: int) -> int:
        """Where the first header stands, on a line after ``at`` and before ``end``, whose length fits; -1 if there is none."""
        while (at := data.find(b"\n", at, end) + 1) and at < end:
            m = header(at)
            if m and fits(m):
                return at
        return -1

    def sound(m: re.Match) -> bool:
        to = m.end() + int(m["length"])
        if fits(m):
            return True
        head, body = http_parts(data[m.end() : to])
        declared = re.search(rb"(?im)^content-length:[ \t]*(\d{1,18})[ \t]*\r?$", head)
        if declared:
            return int(declared[1]) == len(body)
        return data[to : to + 1] in (b"\n", b"\r") and next_header(m.end() - 1, to) < 0

    first = re.match(rb"filedesc:[^\r\n]* (\d{1,9})\r?\n", data)
    if first and first.end() + int(first[1]) <= size:
        block = data[first.end() : first.end() + int(first[1])]
        version = 2 if block[:1] == b"2" else 1
        fields = first[0].split(b" ")
        yield ArcRecord(_said(fields[0]), "-", _said(fields[2]) if len(fields) > 2 else "-", "text/plain", block, "version")
        at = first.end() + int(first[1])
    while at < size:
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        m = header(at)
        if m is None or not sound(m):
            lo, why = at, "no usable header" if m is None else "declared length does not fit"
            found = next_header(at, size)
            at = size if found < 0 else found
            yield ArcRecord("", "-", "-", why, data[lo:at], "skipped", lo)
            continue
        to = m.end() + int(m["length"])
        yield ArcRecord(_said(m["url"]), _said(m["ip"]), _said(m["date"]), _said(m["mime"]), data[m.end() : to], "record", at)
        at = to


def http_status(content: bytes) -> int | None:
    m = re.match(rb"HTTP/\d\S* +(\d{3})(?!\d)", content)
    return int(m[1]) if m else None


def http_parts(content: bytes) -> tuple[bytes, bytes]:
    """Head, with the empty line that ends it, and body of an HTTP response; all is body if it is none."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    m = re.search(rb"\r?\n\r?\n", content)
    return (content[: m.end()], content[m.end() :]) if m else (content, b"")


def warc_date(arc_date: str) -> str:
    """20240131235959 as 2024-01-31T23:59:59Z; a date that is too short is filled up with the first of what is missing."""
    digits = arc_date if arc_date.isdigit() else ""
    full = digits[:14] + "00010101000000"[len(digits[:14]) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(archive: str, offset: int) -> str:
    """The same for the same record of the same archive."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive} {offset}')}>"


def warc_record(archive: str, r: ArcRecord, refers_to: tuple[str, str, str] | None = None) -> bytes:
    """A WARC/1.1 record for one of an ARC file, with the two line ends that close it.

    An HTTP response keeps its status line and headers; its payload, which the payload digest is of, is its body as it
    stands in the archive. Anything else is a ``resource`` of the type that the ARC header names, but for dns: URLs,
    which are responses. The version block becomes ``warcinfo``, which the other records name. ``refers_to`` (id, URL and
    date of a record with the same payload) makes a response a ``revisit``, which has a head but no payload of its own.
    """
    head, body = http_parts(r.content) if r.kind == "record" and re.match("https?:", r.url, re.I) else (b"", r.content)
    digest = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    plain = lambda x: re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", x)
    about = record_id(archive, 0)
    if r.kind == "version":
        block = f"software: barquill\r\nformat: WARC File Format 1.1\r\nconverted-from: {plain(archive)}\r\n".encode() + b"".join(b"arc-version-block: " + x + CRLF for x in r.content.split(b"\n") if x.strip())
        lines = ["WARC-Type: warcinfo", f"WARC-Record-ID: {about}", f"WARC-Date: {warc_date(r.date)}", f"WARC-Filename: {plain(archive)}", "Content-Type: application/warc-fields"]
    else:
        revisit = refers_to is not None and bool(head)
        block = head if revisit else r.content
        kind = "revisit" if revisit else "response" if head or r.url.lower().startswith("dns:") else "resource"
        lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(archive, r.offset)}", f"WARC-Date: {warc_date(r.date)}", f"WARC-Target-URI: {plain(r.url)}", f"WARC-Warcinfo-ID: {about}"]
        if r.ip not in ("-", "0.0.0.0", ""):
            lines.append(f"WARC-IP-Address: {r.ip}")
        lines.append(f"WARC-Payload-Digest: sha1:{digest(body)}")
        if revisit:
            lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to[0]}", f"WARC-Refers-To-Target-URI: {plain(refers_to[1])}", f"WARC-Refers-To-Date: {warc_date(refers_to[2])}"]
        mime = re.sub(r"[\x00-\x1f\x7f]", "", r.mime)
        lines.append(f"Content-Type: {'application/http; msgtype=response' if head else mime if mime not in ('-', '') else 'application/octet-stream'}")
    lines += [f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + CRLF * 2 + block + CRLF * 2


def members(data: bytes) -> Iterator[bytes]:
    """What the members of a gzip file hold, one after the other."""
    at = 0
    while at < len(data):
        one, parts = zlib.decompressobj(31), []
        while not one.eof:
            piece = data[at : at + (1 << 14)]
            if not piece:
                raise ValueError("gzip member cut off")
            parts.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        yield b"".join(parts)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, by declared length; data that is cut off raises ValueError."""
    at = 0
    while at < len(data):
        end = data.find(CRLF * 2, at)
        lines = data[at : max(end, at)].decode("utf-8").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        at = end + 4 + int(head["content-length"])
        if data[at : at + 4] != CRLF * 2:
            raise ValueError(f"record ends wrongly at byte {at}")
        yield head, data[end + 4 : at]
        at += 4


def arc_files(pages: DataFrame, each: int = ARC_BYTES) -> DataFrame:
    """(archive, arc) from (url, html, date): ARC files of about ``each`` bytes, of versions 1 and 2 in turn.

    Records are HTTP responses; null html is an empty body, and ARC URLs carry no white space.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, size = TaskContext.get().partitionId(), 0, 0
        held: list[ArcRecord] = []

        def file() -> pa.RecordBatch:
            name = f"pages-{task:06d}-{n:06d}.arc"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([write_arc(held, 1 + n % 2, name)], pa.binary())], names=["archive", "arc"])

        for batch in batches:
            for row in batch.to_pylist():
                body = (row["html"] or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                held.append(ArcRecord(row["url"] or "", "0.0.0.0", row["date"], "text/html", head + body))
                size += len(head) + len(body)
                if size >= each:
                    yield file()
                    held, n, size = [], n + 1, 0
        if held:
            yield file()

    return pages.select("url", "html", "date").mapInArrow(build, "archive string, arc binary")


_RECORD = "archive string, offset long, kind string, url string, ip string, date string, mime string, http boolean, payload_bytes long, payload_digest string, record_id string"


def arc_records(arcs: DataFrame, content: bool = True) -> DataFrame:
    """A row for each record of the ARC files in ``arcs`` (archive, arc): where it is, its header, its payload's size and
    SHA-1 (bare hex), whether it is an HTTP response, the id of its WARC record, and with ``content`` the bytes after its header. See ``read_arc`` for
    ``kind``; a null file has no records."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, arc in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for r in read_arc(arc.as_py() or b""):
                    head, body = http_parts(r.content) if re.match("https?:", r.url, re.I) else (b"", r.content)
                    row = {"archive": archive or "", "offset": r.offset, "kind": r.kind, "url": r.url, "ip": r.ip, "date": r.date, "mime": r.mime, "http": bool(head)}
                    row |= {"payload_bytes": len(body), "payload_digest": hashlib.sha1(body).hexdigest(), "record_id": record_id(archive or "", r.offset)}
                    rows.append(row | ({"content": r.content} if content else {}))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows)

    return arcs.select("archive", "arc").mapInArrow(parse, _RECORD + ", content binary" * content)


_EMPTY = gzip.compress(b"", mtime=0)


def write_archives(records: DataFrame, path: str, each: int = WARC_BYTES) -> None:
    """Write rows of ``arc_records`` with refers_to (id, url and date of another, or null) as WARC files of about ``each`` bytes.

    Every record is a gzip member of its own; what was skipped in an ARC file is not written. Spark's text writer takes
    strings of any bytes; it adds a byte of its own, which is the zero that ends a member.
    """

    columns = ("archive", "offset", "kind", "url", "ip", "date", "mime", "content", "refers_to")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def file() -> pa.RecordBatch:
            data = b"".join(held)
            data = data if data[-1] == 0 else data + _EMPTY  # a member ends in its length, whose last byte is 0 under 16 MB
            return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], names=["file"])

        for batch in batches:
            archive, offset, kind, url, ip, date, mime, to = (batch.column(columns.index(c)).to_pylist() for c in columns if c != "content")
            for i, content in enumerate(batch.column(columns.index("content"))):
                r = ArcRecord(url[i], ip[i], date[i], mime[i], content.as_py(), kind[i], offset[i])
                held.append(gzip.compress(warc_record(archive[i], r, tuple(to[i].values()) if to[i] else None), LEVEL, mtime=0))
                size += len(held[-1])
                if size >= each:
                    yield file()
                    held, size = [], 0
        if held:
            yield file()

    files = records.where("kind <> 'skipped'").select(*columns).mapInArrow(convert, "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(url, record_type, payload_bytes, payload_digest, refers_url) of every record but warcinfo of the WARC files in ``path``.

    The digest is that of the payload in the record, or of the one that a revisit refers to, in bare lower-case hex, and
    the size is that which the head of a revisit declares, null if it does not. A record whose block or payload doesn't
    match its digest raises ValueError.
    """
    names = ["url", "record_type", "payload_bytes", "payload_digest", "refers_url"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def check(head: dict[str, str], block: bytes) -> tuple | None:
        if head["warc-type"] == "warcinfo":
            return None
        hexed = lambda name: base64.b32decode(head[name].partition(":")[2]).hex()
        top, body = http_parts(block) if head["content-type"].startswith("application/http") else (b"", block)
        size, digest = len(body), hexed("warc-payload-digest")
        if head["warc-type"] == "revisit":
            size = next((int(x.partition(b":")[2]) for x in top.splitlines() if x.lower().startswith(b"content-length:")), None)
        elif hashlib.sha1(body).hexdigest() != digest:
            raise ValueError(f"damaged payload of {head['warc-record-id']}")
        if hashlib.sha1(block).hexdigest() != hexed("warc-block-digest"):
            raise ValueError(f"damaged block of {head['warc-record-id']}")
        return head["warc-target-uri"], head["warc-type"], size, digest, head.get("warc-refers-to-target-uri")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = [found for member in members(content.as_py()) for record in read_warc(member) if (found := check(*record))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(read, "url string, record_type string, payload_bytes long, payload_digest string, refers_url string")


def convert_archives(arcs: DataFrame, path: str, key: Column, least: int = LEAST_REVISIT) -> None:
    """Convert the ARC files in ``arcs`` (archive, arc) to WARC files in ``path``.

    Of HTTP responses with equal payloads of at least ``least`` bytes the one with the largest ``key`` (made of columns
    of ``arc_records``; null is smallest) is stored, the others with another key are revisits of it. Archives are parsed
    twice: once for sizes and digests, once for the records, which meet what their digest is shared by in one shuffle,
    unless that is small enough for Spark to send it to all.
    """
    web = F.col("http") & (F.col("kind") == "record") & (F.col("payload_bytes") >= least)
    index = arc_records(arcs, content=False).where(web).withColumn("key", key)
    shared = index.groupBy("payload_digest", "payload_bytes").agg(F.count("*").alias("m"), F.max(F.struct("key", "record_id", "url", "date")).alias("s")).where("m > 1")
    shared = shared.select(F.col("payload_digest").alias("of"), F.col("payload_bytes").alias("of_bytes"), "s")
    rows = arc_records(arcs).withColumn("key", key)
    rows = rows.join(shared, (F.col("payload_digest") == F.col("of")) & (F.col("payload_bytes") == F.col("of_bytes")) & web, "left")
    other = F.col("s").isNotNull() & ~F.col("key").eqNullSafe(F.col("s.key"))
    rows = rows.withColumn("refers_to", F.when(other, F.struct(F.col("s.record_id").alias("id"), F.col("s.url").alias("url"), F.col("s.date").alias("date"))))
    write_archives(rows, path)


def archive_pages(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Write ``pages`` (page_id, url, html; other columns are ignored) as ARC, convert that to WARC in ``path``, and read it back.

    Of pages with equal payloads of at least ``least`` bytes the one with the largest page_id is stored, the others
    refer to it. Returns page_id, payload_bytes, payload_digest, record_type, refers_to, one row for each page; none for
    an empty table. Null html is empty, null url is none. A null page_id is smaller than any other; of rows with the same
    page_id and payload, all count as the one that is stored. A page of any length is one record, held by one task.

    The archived URL ends in a fragment with the page's id; one that is no http URL gets that scheme in front.
    """
    url = F.coalesce("url", F.lit(""))
    tagged = F.concat(F.when(url.rlike("^(?i)https?:"), url).otherwise(F.concat(F.lit("http://"), url)), F.lit("#page-"), F.coalesce(F.col("page_id").cast("long").cast("string"), F.lit("")))
    number = lambda x: F.regexp_extract(x, r"#page-(-?\d+)$", 1).try_cast("long")
    arcs = arc_files(pages.select(tagged.alias("url"), "html", F.lit("20240101000000").alias("date")))
    convert_archives(arcs, path, number(F.col("url")), least)
    back = read_archives(pages.sparkSession, path)
    return back.select(number(F.col("url")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_url")).alias("refers_to"))
