"""Legacy archive converter: ARC files of versions 1 and 2 become WARC 1.1 files.

An ARC file begins with a `filedesc://` record whose body names the version and the fields of the header lines that follow;
each record is such a line and as many bytes as the line declares. The converter synthesises what WARC needs: record ids from
digests of content and place, ISO timestamps, types and payload digests. Equal payloads become revisit records of one
response. Files are written and read by Spark's own readers and writers, so any store that Spark reaches will do.
"""

from __future__ import annotations

import calendar
import hashlib
import re
import zlib
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, pieces

#: Bytes of records in one file, and so about what a task reads at once.
FILE_BYTES = 8 << 20
#: Most records in one WARC file.
RECORDS_PER_FILE = 2000
#: Most repeated payloads that are sent to every executor (some 200 bytes each); more are joined by a shuffle.
BROADCAST_DIGESTS = 100_000
#: Equal payloads of at least this many bytes are stored once.
REVISIT_BYTES = 1000

#: The fields of header lines by ARC version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "20240101000000"
#: Archives are read back once or twice, so they're compressed fast rather than small.
_GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
#: Rows and bytes that a worker hands over at once, so that it holds little more than one file.
_ROWS, _HELD = 128, 1 << 20


def _arc_rows(per_file: int):
    """Records of a partition in ARC's form; a file description goes before every per_file of them."""

    def go(batches):
        task = TaskContext.get()
        part, n, version = task.partitionId() if task else 0, 0, 1
        for rows in pieces(batches, _ROWS):
            out = []
            for page_id, url, html in zip(*(rows.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                if n % per_file == 0:
                    version = 1 + (part + n // per_file) % 2
                    about = f"{version} 0 sightline\n{ARC_FIELDS[version]}\n"
                    out.append(f"filedesc://part-{part}-{n // per_file}.arc 0.0.0.0 {_DATE} text/plain {len(about)}\n{about}")
                n += 1
                body = html or ""
                content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\nContent-Length: {len(body.encode())}\r\n\r\n{body}"
                place = re.sub(r"[\s\x00-\x1f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "-"
                more = "" if version == 1 else f" 200 - - 0 part-{part}-{n // per_file}.arc"
                out.append(f"{place} 0.0.0.0 {_DATE} text/html{more} {len(content.encode())}\n{content}")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return go


def write_arc(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Writes pages (page_id, url, html) as gzipped ARC files, version 1 and 2 by turns; null html is empty. No shuffle.

    White space and control characters in a url, which a header line can't hold, are percent-encoded; a null url is "-".
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    sizes = rows.agg(F.sum(F.octet_length("html") + F.lit(400)), F.count("*")).first()
    per_file = max(1, int(file_bytes * sizes[1] / max(sizes[0] or 1, 1)))
    # one row more a file, for its description
    rows.mapInArrow(_arc_rows(per_file), "value string").write.option("lineSep", "\n").options(**_GZIP).option("maxRecordsPerFile", per_file + 1).text(path)


def inflated(data: bytes) -> bytes:
    """The bytes of a file, without its compression if it has one; gzip files may have several members."""
    parts = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        parts.append(member.decompress(data))
        data = member.unused_data
    return b"".join([*parts, data]) if parts else data


def _header(data: bytes, at: int, names: list[str]) -> tuple[list[str], int] | None:
    """Fields of the header line at this byte and where its content starts; None if it is no header line."""
    end = data.find(b"\n", at)
    if end < 0:
        return None
    parts = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
    about = parts[0].startswith("filedesc://")
    if not parts[-1].isdecimal() or not parts[-1].isascii() or (len(parts) < 5 if about else len(parts) != len(names)) or not re.fullmatch(r"\d{4,14}", parts[2], re.A):
        return None
    return parts, end + 1


def parse_arc(data: bytes, faults: list[tuple[int, str]] | None = None):
    """Yields (version, header fields by name, content) of every record; those of file descriptions have the URL filedesc://...

    A later `filedesc://` record changes version and fields, as in joined files. A line that should be a header and isn't, a
    description that can't be read, and a record with fewer bytes than it declares are told in faults (byte, what) and skipped
    up to the next line that is a header; without that list they are errors.
    """
    at, version, names = 0, 0, ARC_FIELDS[1].split(" ")

    def fault(what: str) -> None:
        if faults is None:
            raise ValueError(f"byte {at}: {what}")
        faults.append((at, what))

    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        found = _header(data, at, names)
        if found is None:
            fault(f"no ARC header of version {version}: {data[at : at + 80]!r}")
            while at < len(data) and found is None:  # from line to line, until one is a header
                at = data.find(b"\n", at) + 1 or len(data)
                found = _header(data, at, names)
            continue
        parts, start = found
        content = data[start : start + int(parts[-1])]
        if len(content) != int(parts[-1]):
            fault(f"{len(content)} bytes of {parts[-1]}")
            at = start
            continue
        if parts[0].startswith("filedesc://"):
            about = content.decode("utf-8", "replace").splitlines()
            if len(about) < 2 or not about[0].split(" ")[0].isdecimal():
                fault("a file description without version and fields")
            else:
                version, names = int(about[0].split(" ")[0]), about[1].split(" ")
            yield version, {"URL": parts[0], "IP-address": parts[1], "Archive-date": parts[2], "Content-type": "text/plain", "Archive-length": parts[-1]}, content
        else:
            yield version, dict(zip(names, parts, strict=True)), content
        at = start + len(content)


def split_http(content: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP headers by lower-case name, and the body. What doesn't begin like an HTTP message is a body without headers."""
    if not content.startswith(b"HTTP/"):
        return {}, content
    head, _, body = content.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}, body


def iso_date(digits: str) -> str:
    """An ARC date of 4 to 14 digits as WARC writes it; what it doesn't say is the first of its kind, what can't be is the last that can."""
    full = digits + "00000101000000"[len(digits) :]
    year, month, day, hour, minute, second = (int(full[a:b]) for a, b in ((0, 4), (4, 6), (6, 8), (8, 10), (10, 12), (12, 14)))
    year, month = max(year, 1), min(max(month, 1), 12)
    day = min(max(day, 1), calendar.monthrange(year, month)[1])
    return f"{year:04}-{month:02}-{day:02}T{min(hour, 23):02}:{min(minute, 59):02}:{min(second, 59):02}Z"


_NAMES = ("page_id", "kind", "url", "ip", "date", "content_type", "record_id", "http", "head", "payload_bytes", "payload_digest")
_RECORD_DDL = "page_id long, kind string, url string, ip string, date string, content_type string, record_id string, http binary, head binary, payload_bytes long, payload_digest string"
_RECORD = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (x.split(" ") for x in _RECORD_DDL.split(", "))])


def _page_id(headers: dict[str, str]) -> int | None:
    text = headers.get("x-page-id", "")
    return int(text) if re.fullmatch(r"-?\d{1,19}", text, re.A) else None


def _arc_batches(batches, bodies: bool = True):
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            rows, held = [], 0
            for i, (_, fields, block) in enumerate(parse_arc(inflated(content.as_py()), [])):
                headers, body = split_http(block)
                digest = hashlib.sha1(body).hexdigest()
                name = hashlib.sha256(f"{path.rpartition('/')[2]}:{i}:{fields['URL']}:{digest}".encode()).hexdigest()
                about, http = fields["URL"].startswith("filedesc://"), block.startswith(b"HTTP/")
                rows.append({
                    "page_id": _page_id(headers), "kind": "warcinfo" if about else "response" if http else "resource", "url": fields["URL"], "ip": ip if re.fullmatch(r"[0-9A-Fa-f.:]+", ip := fields["IP-address"]) and ip != "0.0.0.0" else None,
                    "content_type": "application/http;msgtype=response" if http else fields["Content-type"], "http": block if bodies else None, "head": block[: len(block) - len(body)] if bodies else None, "payload_bytes": len(body), "payload_digest": digest,
                    "date": iso_date(fields["Archive-date"]),
                    "record_id": f"<urn:uuid:{name[:8]}-{name[8:12]}-5{name[13:16]}-8{name[17:20]}-{name[20:32]}>",
                })
                held += len(block) if bodies else 0
                if held > _HELD:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)


def _fault_batches(batches):
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            faults: list[tuple[int, str]] = []
            for _ in parse_arc(inflated(content.as_py()), faults):
                pass
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(faults), pa.string()), pa.array([x for x, _ in faults], pa.int64()), pa.array([x for _, x in faults], pa.string())], names=["path", "at", "fault"])


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def read_arc(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """Records of ARC files with what WARC asks for: page_id, kind, url, ip, date, content_type, record_id, http (the block), head, payload_bytes, payload_digest (hex SHA-1).

    Kinds are warcinfo (a file description), response (an HTTP message, whose payload is its body) and resource (anything else,
    all of it payload). Without bodies http and head are null: all that comparing payloads needs. What isn't a record is left
    out; arc_faults() tells where.
    """
    return _files(spark, path).mapInArrow(partial(_arc_batches, bodies=bodies), _RECORD_DDL)


def arc_faults(spark: SparkSession, path: str) -> DataFrame:
    """path, at (byte of the inflated file), fault: what in ARC files is no record, or not a whole one."""
    return _files(spark, path).mapInArrow(_fault_batches, "path string, at long, fault string")


def with_revisits(records: DataFrame, slim: DataFrame | None = None) -> DataFrame:
    """Adds original (record_id of the response a record revisits, or null) and original_date. slim: the same records without bodies.

    Of records with equal payloads of at least REVISIT_BYTES, those with the largest page_id are responses (all that share
    it; a null id is the smallest) and the others revisit the one of them with the smallest record id.
    """
    big = (records if slim is None else slim).filter((F.col("payload_bytes") >= REVISIT_BYTES) & (F.col("kind") == "response"))
    best = big.groupBy("payload_digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n"), F.max_by(F.struct("record_id", "date"), F.struct(F.coalesce("page_id", F.lit(-(2**63))), F.col("record_id"))).alias("response"))
    # a page of which there is one has nothing to revisit, so the join carries repeated digests only
    best = cut(best.filter("n > 1").select(F.col("payload_digest").alias("same"), "top", "response"))
    if best.count() <= BROADCAST_DIGESTS:
        best = F.broadcast(best)
    both = records.join(best, F.col("payload_digest") == F.col("same"), "left")
    later = F.col("same").isNotNull() & (F.col("kind") == "response") & ~F.col("page_id").eqNullSafe(F.col("top"))
    return both.select(*records.columns, F.when(later, F.col("response.record_id")).alias("original"), F.when(later, F.col("response.date")).alias("original_date"))


def _base32(digest: Column) -> Column:
    """Hex SHA-1 as upper-case base32, five bits a letter."""
    digit = lambda i: F.substring(F.lpad(F.conv(F.substring(digest, i * 5 + 1, 5), 16, 32), 4, "0"), 1, 4)
    return F.translate(F.upper(F.concat(*(digit(i) for i in range(8)))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_warc(records: DataFrame, path: str) -> None:
    """Writes records of with_revisits() as gzipped WARC 1.1: whole blocks, but of a revisit the HTTP headers alone."""
    again = F.col("original").isNotNull()
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    target = F.when(F.col("kind") != "warcinfo", F.col("url"))
    block = F.when(again, F.col("head")).otherwise(F.col("http"))
    more = F.concat(line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", F.col("original")), line("WARC-Refers-To-Date", F.col("original_date")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.col("kind"))), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("date")), line("WARC-Target-URI", target), line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), _base32(F.col("payload_digest")))), F.when(again, more).otherwise(F.lit("")), line("Content-Type", F.col("content_type")), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    records.select(F.concat(head, block.cast("string")).alias("value")).write.option("lineSep", "\r\n\r\n").options(**_GZIP).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def parse_warc(data: bytes):
    """Yields (headers by lower-case name, block) of every record, by the declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        headers = {m[1].decode().lower(): m[2].decode() for m in _HEADER.finditer(data, data.index(b"\r\n", at) + 2, end + 2)}
        n = int(headers["content-length"])
        if data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"WARC record at byte {at} is cut short")
        yield headers, data[end + 4 : end + 4 + n]
        at = end + 8 + n


_BACK = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("original", pa.string())])


def _warc_batches(batches):
    import base64

    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for headers, block in parse_warc(inflated(content.as_py())):
                http, body = split_http(block)
                kind = headers["warc-type"]
                digest = base64.b32decode(headers["warc-payload-digest"].partition(":")[2]).hex()
                if kind != "revisit" and hashlib.sha1(body).hexdigest() != digest:
                    raise ValueError(f"payload of {headers['warc-record-id']} doesn't have its digest")
                length = len(body) if kind != "revisit" else int(http["content-length"]) if http.get("content-length", "").isdecimal() else None
                rows.append({"page_id": _page_id(http), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "record_id": headers["warc-record-id"], "original": headers.get("warc-refers-to")})
            yield pa.RecordBatch.from_pylist(rows, schema=_BACK)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest (hex), record_type, record_id, original (the record that a revisit refers to).

    A revisit's payload isn't there; its length is what its HTTP headers say, null if they don't.
    """
    return _files(spark, path).mapInArrow(_warc_batches, "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, original string")


def convert(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages as ARC below folder, converts them to WARC, reads that back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Tables of any size, empty ones too; rows that are repeated make a record each. A null page_id stays null.
    """
    spark = pages.sparkSession
    arc = f"{folder}/arc"
    write_arc(pages, arc)
    write_warc(with_revisits(read_arc(spark, arc), read_arc(spark, arc, bodies=False)), f"{folder}/warc")
    back = read_warc(spark, f"{folder}/warc").filter("record_type in ('response', 'revisit')")
    responses = back.filter("record_type = 'response'").select(F.col("record_id").alias("of"), F.col("page_id").alias("refers_to"))
    used = back.filter("original is not null").select("original").distinct()
    responses = responses.join(used, F.col("of") == F.col("original"), "left_semi")
    return back.join(responses, F.col("original") == F.col("of"), "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
