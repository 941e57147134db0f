"""Secret scans with a recursive decoding worklist.

A text is scanned, then every run that looks encoded is unwrapped and the result put on
the worklist as a layer of its own: percent escapes, backslash-u and backslash-x escapes,
numeric character references, base64 (either alphabet) and, below base64 or hex, zlib or
gzip data and UTF-16 text. A run that is no base64 as a whole may have other letters before
or after: it is decoded in all four alignments, and readable stretches and compressed
data inside are layers. Layers are scanned
in turn until none is left. A layer that was seen before is not opened again (cycles and
repeats end there), and every layer is shorter than what it was unwrapped from except for
decompression, whose cycles are found by a digest.

Nothing is cut off a compressed layer: all members are inflated chunk by chunk into a file
(in memory up to ``IN_MEMORY``), compressions in compressions likewise. Its text is scanned
in pieces of about a chunk that end where no find or encoded run can go on, so that memory
holds a few chunks or the longest unbroken run.

Spans are code points of the original text: a find in escapes maps to the escapes it came
from, a find in a base64 or compressed layer to the whole encoded run.

Fixed values: the three kinds of secret and their least lengths (see ``KINDS``).
"""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import io
import re
import tempfile
import zlib
from array import array
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import read
from tessera.llm.kernels import tidied

#: Bytes that are inflated or scanned at once; bytes of an inflated layer before it goes to a temporary file.
CHUNK, IN_MEMORY = 1 << 20, 1 << 23

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: kind, pattern, group whose length counts, least length; in the order of ties
KINDS = (("assign", _ASSIGN, 2, 12), ("access", _ACCESS, 0, 18), ("hex", _HEX, 0, 16))
_NAMES = ("password", "passwd", "secret", "token", "api")

_ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2})+"
                      r"|(?:&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
_CODE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
#: Readable stretches of decoded bytes that are no text as a whole: one byte or two a character.
_STRETCH = re.compile(rb"[\t\r\n\x20-\x7e]{12,}|(?:[\t\r\n\x20-\x7e]\x00){12,}|(?:\x00[\t\r\n\x20-\x7e]){12,}")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Ends where no find or encoded run can go on, however often it is unwrapped: characters that none of
#: them has, and a space between letters that aren't part of an escape.
_BREAK = re.compile(r"""[^A-Za-z0-9+/_.=%\\"'\x20:{}&#;-]|(?<=\x20)[A-Za-z]+\x20(?=[A-Za-z])""")
_HEX_BLOB = re.compile(r"(?:[0-9a-f]{2}){16,}|(?:[0-9A-F]{2}){16,}")


def find(text: str) -> list[tuple[int, int, str]]:
    """Base spans (start, end, kind) of one layer: leftmost and non-overlapping for each kind."""
    out = []
    low = text.lower() if len(text) < 64 else None
    for kind, pattern, group, least in KINDS:
        if kind == "assign":
            low = low if low is not None else text.lower()
            if not any(n in low for n in _NAMES):
                continue
        elif kind == "access" and "AKIA" not in text:
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), m.end(), kind))
    return out


def _escaped(run: str) -> tuple[str, list[tuple[int, int]]]:
    """The characters that a run of escapes stands for, each with its place in the run."""
    if run[0] == "%":
        raw = bytes(int(run[i + 1 : i + 3], 16) for i in range(0, len(run), 3))
        chars, places, at = [], [], 0
        while at < len(raw):
            for width in (1, 2, 3, 4):
                try:
                    chars.append(raw[at : at + width].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                chars.append("�")
                width = 1
            width = min(width, len(raw) - at)
            places.append((3 * at, 3 * (at + width)))
            at += width
        return "".join(chars), places
    chars, places = [], []
    for m in _CODE.finditer(run):
        code = int(m[4]) if m[4] else int(m[1] or m[2] or m[3] or m[5], 16)
        code = code if code < 0x110000 else 0xFFFD
        low = chars and 0xDC00 <= code < 0xE000 and 0xD800 <= ord(chars[-1]) < 0xDC00
        if low:
            chars[-1] = chr(0x10000 + ((ord(chars[-1]) - 0xD800) << 10) + code - 0xDC00)
            places[-1] = (places[-1][0], m.end())
        else:
            chars.append(chr(code))
            places.append((m.start(), m.end()))
    return "".join(c if not 0xD800 <= ord(c) < 0xE000 else "�" for c in chars), places


def _readable(raw: bytes) -> str | None:
    """Bytes as text, UTF-8 or (with a mark or every other byte mostly zero) UTF-16; None if they are none."""
    codes = ["utf-8"]
    if len(raw) % 2 == 0 and len(raw) > 2:
        zero = raw[1::2].count(0) * 2 > len(raw) // 2, raw[::2].count(0) * 2 > len(raw) // 2
        codes += ["utf-16"] if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else ["utf-16-le"] * zero[0] + ["utf-16-be"] * zero[1]
    for code in codes:
        try:
            text = raw.decode(code)
        except UnicodeDecodeError:
            continue
        odd = sum(not (c.isprintable() or c in "\t\r\n") for c in text)
        if text and odd * 20 <= len(text):
            return text
    return None


def _compressed(raw: bytes) -> bool:
    return raw[:2] == b"\x1f\x8b" or raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] << 8 | raw[1]) % 31 == 0


def _inflated(source: BinaryIO) -> tuple[BinaryIO | None, bool]:
    """What all members of zlib or gzip data hold (None: it is neither), and whether the first one is complete."""
    data = source.read(CHUNK)
    if not _compressed(data):
        return None, False
    out, whole = tempfile.SpooledTemporaryFile(IN_MEMORY), False
    machine, piece = zlib.decompressobj(wbits=47), b""
    try:
        while data or len(piece) == CHUNK:
            piece = machine.decompress(data, CHUNK)
            out.write(piece)
            data = machine.unconsumed_tail
            if machine.eof:
                whole, data = True, machine.unused_data
                while len(data := data.lstrip(b"\0")) < 3 and (more := source.read(CHUNK)):  # padding, then the next member
                    data += more
                if not _compressed(data):
                    break
                machine, piece = zlib.decompressobj(wbits=47), b""
            elif not data:
                data = source.read(CHUNK)
    except zlib.error:
        pass  # what came out before still counts
    out.seek(0)
    return out, whole


def _decoded_chunks(source: BinaryIO, whole: bool) -> Iterator[str]:
    """The bytes as UTF-8 text; the last character may be cut off if they aren't ``whole``."""
    source.seek(0)
    decoder = codecs.getincrementaldecoder("utf-8")()
    while raw := source.read(CHUNK):
        yield decoder.decode(raw)
    yield decoder.decode(b"", final=whole)


def _pieces(source: BinaryIO, whole: bool = True) -> Iterator[str]:
    """The text of a readable layer, in pieces that break no find and no encoded run."""
    size = odd = 0
    try:
        for text in _decoded_chunks(source, whole):
            size += len(text)
            odd += 0 if text.isprintable() else sum(not (c.isprintable() or c in "\t\r\n") for c in text)
    except UnicodeDecodeError:
        return
    if not size or odd * 20 > size:
        return
    held: list[str] = []
    for text in _decoded_chunks(source, whole):
        if len(text) > 4096 and sum(map(len, held)):
            ends = [m.end() for m in _BREAK.finditer(text, len(text) - 4096)] or [m.end() for m in _BREAK.finditer(text)]
            if ends:
                yield "".join([*held, text[: ends[-1]]])
                held, text = [], text[ends[-1] :]
        held.append(text)
    yield "".join(held)


def _unpacked(raw: bytes) -> Iterator[str]:
    """Text of decoded bytes, below any number of compressions."""
    if not _compressed(raw):
        text = _readable(raw)
        if text is not None:
            yield text
        return
    source, whole, marks = io.BytesIO(raw), True, set()
    while True:
        inner, complete = _inflated(source)
        if not complete:  # perhaps a text that begins like compressed data
            yield from _pieces(source, whole)
        if inner is None:
            return
        mark = hashlib.file_digest(inner, "sha256").digest()
        if mark in marks:
            return
        marks.add(mark)
        inner.seek(0)
        source, whole = inner, complete


def _decoded(run: str) -> Iterator[tuple[str, int, int]]:
    """Layers of a run of base64 letters, each with its place in the run."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    plain = False
    try:
        for text in _unpacked(base64.b64decode(body + "=" * (-len(body) % 4), validate=True)):
            plain = True
            yield text, 0, len(run)
    except (binascii.Error, ValueError):
        pass
    if plain:
        return
    for skip in range(4):  # letters before or after belong to something else
        part = body[skip:]
        part = part[: len(part) - 1] if len(part) % 4 == 1 else part
        raw = base64.b64decode(part + "=" * (-len(part) % 4))
        for m in _STRETCH.finditer(raw):
            text = _readable(m[0])
            if text is not None:
                yield text, skip + m.start() // 3 * 4, min(len(run), skip + -(-m.end() // 3) * 4)
        at = raw.find(b"\x1f\x8b\x08")
        while at >= 0:
            for text in _unpacked(raw[at:]):
                yield text, skip + at // 3 * 4, len(run)
            at = raw.find(b"\x1f\x8b\x08", at + 1)


class _Layer:
    """A text and, per code point, the span of the original text it comes from (None: the text itself)."""

    def __init__(self, text: str, starts: array | None = None, ends: array | None = None,
                 whole: tuple[int, int] | None = None) -> None:
        self.text, self.starts, self.ends, self.whole = text, starts, ends, whole

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.whole:
            return self.whole
        return (start, end) if self.starts is None else (self.starts[start], self.ends[end - 1])


def _unwrapped(layer: _Layer) -> Iterator[_Layer]:
    text = layer.text
    if "%" in text or "\\" in text or "&#" in text:
        out, starts, ends, at, changed = [], array("q"), array("q"), 0, False

        def kept(start: int, end: int) -> None:
            """Characters that stay; a layer that is one span as a whole needs no places."""
            out.append(text[start:end])
            if layer.whole is None:
                starts.extend(range(start, end) if layer.starts is None else layer.starts[start:end])
                ends.extend(range(start + 1, end + 1) if layer.ends is None else layer.ends[start:end])

        for m in _ESCAPES.finditer(text):
            chars, places = _escaped(m[0])
            changed = True
            kept(at, m.start())
            out.append(chars)
            if layer.whole is None:
                for a, b in places:
                    a, b = layer.origin(m.start() + a, m.start() + b)
                    starts.append(a)
                    ends.append(b)
            at = m.end()
        if changed:
            kept(at, len(text))
            yield _Layer("".join(out), starts, ends, layer.whole)
    for m in _BASE64.finditer(text):
        for inner, a, b in _decoded(m[0]):
            yield _Layer(inner, whole=layer.origin(m.start() + a, m.start() + b))
    for m in _HEX_BLOB.finditer(text):
        for inner in _unpacked(bytes.fromhex(m[0])):
            yield _Layer(inner, whole=layer.origin(*m.span()))


def _mark(layer: _Layer) -> tuple:
    return hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), layer.whole


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) of a text, each (start, end, kind) by start, then kind, then end; no span twice."""
    rank = {kind: i for i, (kind, *_) in enumerate(KINDS)}
    order = lambda s: (s[0], rank[s[2]], s[1])
    base = sorted(find(text), key=order)
    spans, seen, work = set(base), {_mark(_Layer(text))}, [_unwrapped(_Layer(text))]
    while work:  # layers are unwrapped one at a time, the last one's first
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        mark = _mark(layer)
        if mark in seen:
            continue
        seen.add(mark)
        for start, end, kind in find(layer.text):
            spans.add((*layer.origin(start, end), kind))
        work.append(_unwrapped(layer))
    return base, sorted(spans, key=order)


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with every span (overlapping ones together) replaced by ``mark``."""
    out, at = [], 0
    joined: list[list[int]] = []
    for start, end, _ in sorted(spans):
        if joined and start <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([start, end])
    for start, end in joined:
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


NEW = {"n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(),
       "spans": pa.string(), "redacted": pa.string()}


def _rows(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    names = [n for n in NEW if with_text or n != "redacted"]
    for batch in batches:
        new: dict[str, list] = {n: [] for n in names}
        for value in batch.column(0):
            text = value.as_py() or ""
            base, spans = scan(text)
            for kind, *_ in KINDS:
                new[f"n_{kind}"].append(sum(s[2] == kind for s in base))
            new["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
            new["spans"].append(written(spans))
            if with_text:
                new["redacted"].append(redact(text, spans) if spans else value.as_py())
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(new[n], NEW[n]) for n in names)],
                                         [*batch.schema.names[1:], *names])


def scan_secrets(docs: DataFrame, text_col: str = "text", with_text: bool = True) -> DataFrame:
    """``docs`` without the text, plus counts of base finds, their digest, all spans and the redacted text.

    Null and empty texts have no finds (a null stays null when redacted). Whole texts are
    scanned, however long; repeated rows each come out alike. Columns of ``docs`` with the
    new columns' names are replaced; the others pass through.
    """
    rest = [c for c in docs.columns if c != text_col and c not in NEW]
    wide = docs.select(F.col(text_col).cast("string").alias("_text"), *rest)
    schema = wide.drop("_text").schema
    for n, kind in NEW.items():
        if with_text or n != "redacted":
            schema = schema.add(n, "long" if kind == pa.int64() else "string")
    return wide.mapInArrow(lambda it: tidied(_rows(it, with_text)), schema)


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
