"""WARC: a converter of legacy ARC archives, with revisit records for repeated payloads.

ARC files (version 1 and 2) are parsed by their own version line: the first record, a
``filedesc``, names the version and the fields of the header lines that follow; the last
field of each line is the length of the block after it. Every record becomes an equivalent
WARC record: identifier made from path, place and digest, so a task that runs again
makes the same one; the 14 digits of the archive date as a timestamp; the type told by the
block (an HTTP message is a response, else a resource, the ``filedesc`` a warcinfo);
sha1 digests of block and payload. Of responses with equal payloads of at least
``min_bytes`` one is a response, the others are revisit records, which have the HTTP header
but not the payload.

Archives are written by Spark's text writer, one packed row a file, and read with Spark's
``binaryFile`` source, so any store that Spark reads will do. Each record is a gzip member
of its own; a file ends in one zero byte, which gzip readers skip as padding. A task holds
one file of about ``CHUNK_BYTES`` at a time (one record more at most).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_firsts, read, shared_folder
from tessera.llm.kernels import tidied

CHUNK_BYTES = 1 << 24
SOFTWARE = "tessera"
#: The fields of ARC header lines by version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Header of the stored HTTP message that names the row a record was made from.
ITEM = "X-Item-Id"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(record: bytes) -> bytes:
    return gzip.compress(record, 3, mtime=0)


class _Packer:
    """Members of one archive until it is large enough."""

    def __init__(self, limit: int) -> None:
        self.limit, self.part, self.files = limit, TaskContext.get().partitionId() if TaskContext.get() else 0, 0
        self.held: list[bytes] = []
        self.size = 0

    def name(self) -> str:
        return f"{SOFTWARE}-{self.part:06d}-{self.files:06d}"

    def add(self, record: bytes) -> None:
        self.held.append(member(record))
        self.size += len(record)

    def full(self) -> bool:
        return self.size >= self.limit

    def take(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([b"".join(self.held)], pa.binary())], ["archive"])
        self.held, self.size, self.files = [], 0, self.files + 1
        return out


def write_archives(chunks: DataFrame) -> str:
    """Each row (archive binary) as one file of a fresh shared folder; returns the folder."""
    path = shared_folder(chunks.sparkSession)
    (chunks.select(F.col("archive").cast("string")).write.option("maxRecordsPerFile", 1)
     .option("lineSep", "\x00").text(path))
    return path


def read_archives(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _stream(data: bytes) -> io.BufferedIOBase:
    """The records of an archive, unpacked piece by piece, of which gzip or plain files."""
    return gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


# ---------------------------------------------------------------- ARC

def arc_url(url: str | None) -> str:
    """A URL without blanks or control characters; null and empty ones are ``unknown:``."""
    return urllib.parse.quote(url, safe="%!#$&'()*+,/:;=?@[]~\"<>\\^`{|}") if url else "unknown:"


def arc_record(version: int, url: str, date: str, mime: str, block: bytes, name: str, offset: int) -> bytes:
    fields = [url, "0.0.0.0", date, mime]
    if version == 2:
        fields += ["200", hashlib.md5(block).hexdigest(), "-", str(offset), name]
    return " ".join([*fields, str(len(block))]).encode() + b"\n" + block + b"\n"


def arc_filedesc(version: int, name: str, date: str) -> bytes:
    block = f"{version} 0 {SOFTWARE}\n{ARC_FIELDS[version]}\n".encode()
    return arc_record(version, f"filedesc://{name}.arc", date, "text/plain", block, f"{name}.arc", 0)


def arc_records(data: bytes) -> Iterator[dict]:
    """Records of an ARC file: its fields by name, ``block``, ``offset``, ``version``, ``cut``.

    A block shorter than its declared length is ``cut``. What can't be parsed (no
    ``filedesc``, an unknown version, a line without a length) ends the file: the rest of it
    comes as one record of type ``damaged``.
    """
    stream, version, names, offset = _stream(data), 0, [], 0

    def damaged(line: bytes) -> dict:
        rest = line + stream.read()
        return {"URL": "damaged:", "Archive-date": "", "Content-type": "application/octet-stream", "block": rest,
                "offset": offset, "version": version, "cut": False, "damaged": True}

    while line := stream.readline():
        start, offset = offset, offset + len(line)
        if not line.strip(b"\r\n"):
            continue
        # a URL may hold blanks in old archives: fields are counted from the end
        text = line.rstrip(b"\r\n").decode("utf-8", "replace")
        first = not version
        count = len(names) or (10 if len(text.split(" ")) >= 10 else 5)
        fields = text.rsplit(" ", count - 1)
        if len(fields) != count or not fields[-1].isdigit() or first and not text.startswith("filedesc:"):
            offset = start
            yield damaged(line)
            return
        block = stream.read(int(fields[-1]))
        if first:
            heads = block.decode("utf-8", "replace").split("\n")
            known = heads[0].split(" ")[0]
            if known not in ("1", "2"):
                offset = start
                yield damaged(line + block)
                return
            version = int(known)
            names = ARC_FIELDS[version].split(" ")
        found = dict(zip(names, fields)) if len(fields) == len(names) else {"URL": fields[0], "Archive-date": fields[2],
                                                                            "Content-type": fields[3]}
        offset += len(block)
        yield found | {"block": block, "offset": start, "version": version, "cut": len(block) < int(fields[-1]), "damaged": False}


def http_parts(block: bytes) -> tuple[bytes, bytes] | None:
    """Header (with its empty line) and payload of an HTTP message, else None."""
    if not block.startswith(b"HTTP/"):
        return None
    end = re.search(rb"\r?\n\r?\n", block)
    return (block[: end.end()], block[end.end() :]) if end else (block, b"")


def header_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"^" + name.encode() + rb":[ \t]*([^\r\n]*)", head, re.I | re.M)
    return found[1].decode("utf-8", "replace").strip() if found else None


def timestamp(digits: str) -> str:
    """``2001-02-03T04:05:06Z`` of up to 14 digits; missing months and days are 01, other parts 00, none at all 1970."""
    found = re.match(r"\d*", digits)[0][:14]
    full = found + "19700101000000"[len(found) :] if len(found) >= 4 else "19700101000000"
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(archive: str, offset: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}:{offset}:{digest}')}>"


_PARSED = ("kind string, url string, archive string, offset long, date string, mime string, cut boolean, item string, "
           "payload_key binary, payload_bytes long, head binary, payload binary")


def _parse(with_payload: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a record of the archives; without payloads only those of HTTP messages."""
    names = [part.split()[0] for part in _PARSED.split(", ")]
    kinds = [pa.string()] * 3 + [pa.int64()] + [pa.string()] * 2 + [pa.bool_(), pa.string(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]

    def rows(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    for batch in batches:
        for path, data in zip(batch.column(0), batch.column(1)):
            held, size, archive = [], 0, path.as_py()
            for r in arc_records(data.as_py()):
                block = r["block"]
                http = http_parts(block)
                kind = ("metadata" if r["damaged"] else "warcinfo" if r["URL"].startswith("filedesc:")
                        else "response" if http else "resource")
                head, payload = http or (b"", block)
                if kind != "response" and not with_payload:
                    continue
                held.append((kind, r["URL"], archive, r["offset"], r["Archive-date"], r["Content-type"], r["cut"],
                             header_field(head, ITEM), hashlib.sha256(payload).digest(), len(payload),
                             head if with_payload else None, payload if with_payload else None))
                size += len(block)
                if size >= 1 << 22 and with_payload:
                    yield rows(held)
                    held, size = [], 0
            if held:
                yield rows(held)


def parsed_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of ARC files (``path`` string, ``content`` binary); a record is told by path and offset."""
    return archives.select("path", "content").mapInArrow(lambda it: tidied(_parse(with_payload, it)), _PARSED)


# ---------------------------------------------------------------- WARC

def warc_record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))] if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of the records of a WARC file, by declared lengths."""
    stream = _stream(data)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) and line.strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields["content-length"]))


def converted(kind: str, url: str, archive: str, offset: int, date: str, mime: str, cut: bool, payload: bytes, head: bytes,
              first: dict | None) -> bytes:
    """The WARC record of a parsed ARC record; ``first`` is the response that it repeats (archive, offset, url, date, item)."""
    digest, block = base32_sha1(payload), head + payload
    when = timestamp(date)
    fields = [("WARC-Type", "revisit" if first else kind), ("WARC-Record-ID", record_id(archive, offset, digest)),
              ("WARC-Date", when)]
    if kind == "warcinfo":
        name = url.removeprefix("filedesc://")
        block = (f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\nconverted-from: {name}\r\n"
                 "arc-header: " + payload.decode("utf-8", "replace").replace("\n", " ").strip() + "\r\n").encode()
        return warc_record([*fields, ("WARC-Filename", name.removesuffix(".arc") + ".warc"),
                            ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")], block)
    fields += [("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if first:
        block = head
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", record_id(first["archive"], first["offset"], digest)),
                   ("WARC-Refers-To-Target-URI", first["url"]), ("WARC-Refers-To-Date", timestamp(first["date"])),
                   ("X-Refers-To-Item", first["item"]), ("X-Payload-Length", str(len(payload)))]
    return warc_record([*fields, ("WARC-Truncated", "length" if cut else None),
                        ("Content-Type", "application/http; msgtype=response" if head else mime),
                        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")], block)


_CONVERTED = ["kind", "url", "archive", "offset", "date", "mime", "cut", "payload", "head", "first"]


def _to_warc(chunk_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = _Packer(chunk_bytes)
    for batch in batches:
        for i in range(batch.num_rows):
            packer.add(converted(*(batch.column(c)[i].as_py() for c in range(len(_CONVERTED)))))
            if packer.full():
                yield packer.take()
    if packer.held:
        yield packer.take()


def convert(archives: DataFrame, min_bytes: int = 0, item_type: str = "string", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """WARC archives (``archive`` binary, a row a file) of ARC archives (``path``, ``content``).

    Of responses with equal payloads the one of the smallest item id stays a response; of
    equal ids the first by archive and place, so repeated rows are revisits of one another
    and records without an id come last. ``item_type`` says how ids compare. Every ARC
    record has a WARC record, cut and damaged ones too (``arc_records``); empty payloads
    are equal to one another. Blocks pass whole, one at a time.

    Archives are parsed twice: for the payloads' digests and for the records. Payloads are
    told apart by sha256; the digest table joins the records as ``join_firsts`` says, so a
    payload that a third of all records share is no hot key.
    """
    records = parsed_archives(archives)
    stubs = parsed_archives(archives, with_payload=False).filter(F.col("payload_bytes") >= min_bytes)
    rank = F.struct(F.col("item").cast(item_type).isNull().alias("none"), F.col("item").cast(item_type).alias("id"),
                    "archive", "offset", "url", "date", "item")
    firsts = (stubs.groupBy("payload_key").agg(F.min(rank).alias("least"), F.count(F.lit(1)).alias("copies"))
              .filter("copies > 1").select("payload_key", "copies", F.struct(
                  "least.archive", "least.offset", "least.url", "least.date", "least.item").alias("first")))
    joined = join_firsts(records, firsts, "payload_key", "copies")
    again = ((F.col("kind") == "response") & F.col("first").isNotNull()
             & ~((F.col("first.archive") == F.col("archive")) & (F.col("first.offset") == F.col("offset"))))
    rows = joined.withColumn("first", F.when(again, F.col("first"))).select(*_CONVERTED)
    return rows.mapInArrow(lambda it: tidied(_to_warc(chunk_bytes, it)), "archive binary")


def _to_arc(chunk_bytes: int, date: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ARC archives of rows (id, url, html), of version 1 and 2 by turns."""
    packer, version = _Packer(chunk_bytes), 1
    for batch in batches:
        for item, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if not packer.held:
                version = 1 + (packer.part + packer.files) % 2
                packer.add(arc_filedesc(version, packer.name(), date))
            payload = (html or "").encode()
            named = f"{ITEM}: {item}\r\n" if item is not None else ""
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{named}\r\n"
            packer.add(arc_record(version, arc_url(url), date, "text/html", head.encode() + payload, f"{packer.name()}.arc", packer.size))
            if packer.full():
                yield packer.take()
    if packer.held:
        yield packer.take()


def page_archives(pages: DataFrame, date: str = "20010203040506", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """ARC archives (``archive`` binary, a row a file) of ``pages`` (page_id, url, html); a null html is empty."""
    wide = pages.select(F.col("page_id").cast("string"), F.col("url").cast("string"), F.col("html").cast("string"))
    return wide.mapInArrow(lambda it: tidied(_to_arc(chunk_bytes, date, it)), "archive binary")


_READ = "item string, payload_bytes long, payload_digest string, record_type string, refers_to string, record_id string, url string, intact boolean"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in _READ.split(", ")]
    for batch in batches:
        for data in batch.column(1):
            rows = []
            for fields, block in warc_records(data.as_py()):
                kind = fields["warc-type"]
                if kind not in ("response", "revisit"):
                    continue
                head, payload = http_parts(block) or (b"", block)
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                intact = fields["warc-block-digest"] == f"sha1:{base32_sha1(block)}" and (
                    kind == "revisit" or digest == base32_sha1(payload))
                size = int(fields["x-payload-length"]) if kind == "revisit" else len(payload)
                rows.append((header_field(head, ITEM), size, digest, kind, fields.get("x-refers-to-item"),
                             fields["warc-record-id"], fields["warc-target-uri"], intact))
            if rows:
                kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_warc(archives: DataFrame) -> DataFrame:
    """Responses and revisits of WARC files (``path``, ``content``), their digests checked anew (``intact``)."""
    return archives.select("path", "content").mapInArrow(lambda it: tidied(_read_back(it)), _READ)


def archived_pages(pages: DataFrame, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``pages`` written as ARC archives, converted to WARC archives and read back from those.

    Per page: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id,
    intact. A null html is an empty payload, a null id has no header and comes back null,
    a null url is ``unknown:``. Repeated rows each have a record; see ``convert`` for ties.
    An empty table gives no rows; other columns of ``pages`` are ignored.
    """
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType
    arcs = write_archives(page_archives(pages, chunk_bytes=chunk_bytes))
    warcs = write_archives(convert(read_archives(spark, arcs), min_bytes, kind.simpleString(), chunk_bytes))
    return read_warc(read_archives(spark, warcs)).select(
        F.col("item").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"), "record_id", "intact")


def op12_warc(spark, sf_dir: str) -> DataFrame:
    found = archived_pages(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


_BITS = "(('0x' || sha1(body)[k * 5 + 1 : k * 5 + 5])::INT)"
OP12_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT *, first_value(page_id) OVER w AS first, row_number() OVER w AS nth,
      array_to_string(list_transform(range(8), lambda k: array_to_string(list_transform([15, 10, 5, 0], lambda s:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_BITS} >> s) & 31) + 1, 1)), '')), '') AS digest
      FROM p WINDOW w AS (PARTITION BY body ORDER BY page_id NULLS LAST))
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN nth > 1 THEN first END AS refers_to, TRUE AS intact FROM d
"""
