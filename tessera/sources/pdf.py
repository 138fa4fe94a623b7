"""How many pages a PDF file has, and which files can't be read, from the files' bytes.

A file ends with the place of its last cross-reference section; each section, a table or a compressed stream, says where objects lie, which of them is
the catalogue, and where the section before it is. The catalogue names the root of the page tree, whose ``Count`` is the number of pages. ``inspect`` follows that way in the bytes of one
file, and no more of it is read than the sections and those objects. Files that lack any of it, that are encrypted, or that have no pages are quarantined with the reason.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.index import content_id

_START = re.compile(rb"startxref\s+(\d+)")
_OBJECT = re.compile(rb"\s*(\d+)\s+(\d+)\s+obj\b")
_STREAM = re.compile(rb"stream\r?\n")
_ROW = re.compile(rb"\s*(\d{1,10})\s+(\d{1,5})\s+([nf])")
_HEAD = re.compile(rb"\s*(\d+)\s+(\d+)\s*?(?=[\r\n ])")


class UnreadableError(ValueError):
    """Why a file can't be read."""


def _number(name: bytes, part: bytes) -> int | None:
    m = re.search(rb"/" + name + rb"\s+(\d+)(?!\s+\d+\s+R)", part)
    return int(m[1]) if m else None


def _reference(name: bytes, part: bytes) -> int | None:
    m = re.search(rb"/" + name + rb"\s+(\d+)\s+\d+\s+R", part)
    return int(m[1]) if m else None


def _dictionary(data: bytes, at: int) -> bytes:
    """The dictionary that begins at or after a place, by its brackets."""
    begin, depth = data.find(b"<<", at), 0
    if begin < 0:
        raise UnreadableError("no dictionary")
    for m in re.compile(rb"<<|>>").finditer(data, begin):
        depth += 1 if m[0] == b"<<" else -1
        if not depth:
            return data[begin : m.end()]
    raise UnreadableError("dictionary without end")


def _stream(data: bytes, at: int, head: bytes) -> bytes:
    """The bytes of a stream that its dictionary precedes: plain or deflated, with the predictor of cross-reference streams undone."""
    m = _STREAM.search(data, at)
    end = data.find(b"endstream", m.end()) if m else -1
    if end < 0:
        raise UnreadableError("stream without end")
    raw = data[m.end() : m.end() + (_number(b"Length", head) or end - m.end())]
    if b"/FlateDecode" in head:
        try:
            raw = zlib.decompressobj().decompress(raw)
        except zlib.error as wrong:
            raise UnreadableError("damaged stream") from wrong
    if (_number(b"Predictor", head) or 1) >= 10:
        wide, out, above = _number(b"Columns", head) or 1, [], b""
        for k in range(0, len(raw) - wide, wide + 1):
            kind, row = raw[k], raw[k + 1 : k + 1 + wide]
            if kind not in (0, 2):
                raise UnreadableError("predictor not known")
            above = row if kind == 0 or not above else bytes((a + b) & 255 for a, b in zip(row, above, strict=True))
            out.append(above)
        raw = b"".join(out)
    return raw


def _section(data: bytes, at: int, places: dict[int, tuple]) -> bytes:
    """Adds a section's objects to ``places``, those of later sections stay; its dictionary."""
    if not 0 <= at < len(data):
        raise UnreadableError("cross-references out of the file")
    m = re.compile(rb"\s*xref\s").match(data, at)
    if m:
        at = m.end()
        while head := _HEAD.match(data, at):
            at, first = head.end(), int(head[1])
            for k in range(int(head[2])):
                row = _ROW.match(data, at)
                if not row:
                    raise UnreadableError("damaged cross-references")
                at = row.end()
                if row[3] == b"n":
                    places.setdefault(first + k, (1, int(row[1]), 0))
        return _dictionary(data, at)
    if not _OBJECT.match(data, at):
        raise UnreadableError("no cross-references")
    head = _dictionary(data, at)
    widths = [int(x) for x in (re.search(rb"/W\s*\[([\d\s]+)\]", head) or [b"", b""])[1].split()]
    if len(widths) != 3:
        raise UnreadableError("no cross-references")
    raw, n = _stream(data, at, head), sum(widths)
    index = [int(x) for x in (re.search(rb"/Index\s*\[([\d\s]+)\]", head) or [b"", b"0 %d" % (_number(b"Size", head) or 0)])[1].split()]
    cells, k = [(0, widths[0]), (widths[0], widths[0] + widths[1]), (widths[0] + widths[1], n)], 0
    for first, count in zip(index[::2], index[1::2], strict=False):
        for number in range(first, first + count):
            row = raw[k : k + n]
            kind, a, b = (int.from_bytes(row[x:y], "big") if y > x else 1 for x, y in cells)
            if len(row) == n and kind in (1, 2):
                places.setdefault(number, (kind, a, b))
            k += n
    return head


def _object(data: bytes, number: int | None, places: dict[int, tuple]) -> bytes:
    """The dictionary of an object, wherever it lies."""
    if number not in places:
        raise UnreadableError("missing object")
    kind, a, b = places[number]
    if kind == 1:
        m = _OBJECT.match(data, a)
        if not m or int(m[1]) != number:
            raise UnreadableError("object not at its place")
        return _dictionary(data, m.end())
    head = _object(data, a, {k: v for k, v in places.items() if v[0] == 1})
    raw = _stream(data, places[a][1], head)
    first = _number(b"First", head) or 0
    starts = [int(x) for x in raw[:first].split()]
    if 2 * b + 1 >= len(starts) or starts[2 * b] != number:
        raise UnreadableError("object not at its place")
    return _dictionary(raw, first + starts[2 * b + 1])


def inspect(data: bytes) -> int:
    """The number of pages of a file's bytes; ``UnreadableError`` says why there is none."""
    try:
        return _pages(data)
    except UnreadableError:
        raise
    except (ValueError, IndexError, TypeError, OverflowError, RecursionError) as wrong:  # numbers that aren't, streams too short
        raise UnreadableError("damaged") from wrong


def _pages(data: bytes) -> int:
    if b"%PDF" not in data[:1024]:
        raise UnreadableError("not a PDF")
    found = _START.findall(data, max(0, len(data) - 2048))
    if not found or b"%%EOF" not in data[-1024:]:
        raise UnreadableError("cut off")
    places: dict[int, tuple] = {}
    at, seen, trailer = int(found[-1]), set(), b""
    while at is not None and at not in seen:
        seen.add(at)
        head = _section(data, at, places)
        trailer = trailer or head
        if (more := _number(b"XRefStm", head)) is not None:
            _section(data, more, places)
        at = _number(b"Prev", head)
    if b"/Encrypt" in trailer:
        raise UnreadableError("encrypted")
    pages = _object(data, _reference(b"Pages", _object(data, _reference(b"Root", trailer), places)), places)
    count = _number(b"Count", pages)
    if not count:
        raise UnreadableError("no pages")
    return count


def inspected(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``files(path, content)``: the readable, ``(path, doc_id, n_pages)``, and the quarantined, ``(path, doc_id, reason)``.

    Files are looked at where they are read, one at a time; null contents are no PDF.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages, reasons = [], []
            for content in b.column(2):
                try:
                    pages.append(inspect(content.as_buffer().to_pybytes() if content.is_valid else b""))
                    reasons.append(None)
                except UnreadableError as wrong:
                    pages.append(None)
                    reasons.append(str(wrong))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pages, pa.int64()), pa.array(reasons, pa.string())], ["path", "doc_id", "n_pages", "reason"])

    given = files.select("path", content_id(F.coalesce("content", F.lit(b""))).alias("doc_id"), "content")
    seen = given.mapInArrow(run, "path string, doc_id string, n_pages bigint, reason string")
    return seen.where("reason IS NULL").drop("reason"), seen.where("reason IS NOT NULL").drop("n_pages")
