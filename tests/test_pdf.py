"""Page counts of made files, with tables and streams of cross-references, and files that can't be read."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.sources import pdf


def body(pages, more=b""):
    """The catalogue, the page tree and pages, each with its place."""
    kids = b" ".join(b"%d 0 R" % (3 + k) for k in range(pages))
    objects = [b"<< /Type /Catalog /Pages 2 0 R /Names << /Count 99 >> >>", b"<< /Type /Pages /Kids [" + kids + b"] /Count %d >>" % pages, *[b"<< /Type /Page /Parent 2 0 R >>"] * pages]
    out, places = b"%PDF-1.7\n" + more, []
    for n, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % n + o + b"\nendobj\n"
    return out, places


def table(pages, trailer=b"", more=b""):
    out, places = body(pages, more)
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(places) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"trailer\n<< /Size %d /Root 1 0 R %s >>\nstartxref\n%d\n%%%%EOF\n" % (len(places) + 1, trailer, at), at


def updated(pages, now):
    """A file whose page tree was replaced by an update, whose section points to the one before."""
    out, before = table(pages)
    place = len(out)
    out += b"2 0 obj\n<< /Type /Pages /Kids [] /Count %d >>\nendobj\n" % now
    at = len(out)
    return out + b"xref\n2 1\n%010d 00000 n \ntrailer\n<< /Size 9 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (place, before, at)


def streams(pages, predict=False, wrong=False):
    """Catalogue and page tree in an object stream, cross-references in a compressed stream."""
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [] /Count %d >>" % pages]
    head = b"1 0 2 %d " % (len(parts[0]) + 1)
    packed = zlib.compress(head + b" ".join(parts))
    out = b"%PDF-1.5\n"
    place = len(out)
    out += b"5 0 obj\n<< /Type /ObjStm /N 2 /First %d /Length %d /Filter /FlateDecode >>\nstream\n" % (len(head), len(packed)) + packed + b"\nendstream\nendobj\n"
    at = len(out)
    rows = [struct.pack(">BHB", *r) for r in ((0, 0, 255), (2, 5, 0), (2, 5, 1), (0, 0, 0), (0, 0, 0), (1, place, 0), (1, at, 0))]
    if predict:
        above, lines = bytes(4), []
        for r in rows:
            lines.append(b"\x02" + bytes((a - b) & 255 for a, b in zip(r, above, strict=True)))
            above = r
        rows = lines
    raw = zlib.compress(b"".join(rows))
    raw = b"xx" + raw[2:] if wrong else raw
    parms = b"/DecodeParms << /Predictor 12 /Columns 4 >>" if predict else b""
    out += b"6 0 obj\n<< /Type /XRef /Size 7 /W [1 2 1] /Root 1 0 R /Length %d /Filter /FlateDecode %s >>\nstream\n" % (len(raw), parms) + raw + b"\nendstream\nendobj\n"
    return out + b"startxref\n%d\n%%%%EOF\n" % at


GOOD = {"plain": (table(3)[0], 3), "one": (table(1)[0], 1), "after junk": (table(40, more=b"% a comment << \n")[0], 40), "updated": (updated(3, 12), 12), "streams": (streams(7), 7), "predicted": (streams(7, predict=True), 7)}
BAD = {
    "encrypted": (table(3, b"/Encrypt 9 0 R")[0], "encrypted"), "no pages": (table(0)[0], "no pages"), "no pdf": (b"hello", "not a PDF"), "empty": (b"", "not a PDF"), "null": (None, "not a PDF"),
    "cut off": (table(3)[0][:-40], "cut off"), "cut in the middle": (table(30)[0][:200] + table(30)[0][-60:], "cross-references out of the file"), "moved": (b"%PDF-1.7\n%" + b"x" * 7 + table(3)[0], "no cross-references"),
    "damaged stream": (streams(7, wrong=True), "damaged stream"), "no root": (table(3)[0].replace(b"/Root 1 0 R", b"/Root 8 0 R"), "missing object"), "loop": (updated(3, 0), "no pages"),
}


@pytest.mark.parametrize("name", GOOD)
def test_pages_are_counted(name):
    assert pdf.inspect(GOOD[name][0]) == GOOD[name][1]


@pytest.mark.parametrize("name", [n for n in BAD if BAD[n][0] is not None])
def test_reasons(name):
    with pytest.raises(pdf.UnreadableError, match=BAD[name][1]):
        pdf.inspect(BAD[name][0])


def test_every_cut_is_told(spark):
    """No cut of a file, and no changed byte in its cross-references, ends in another error."""
    for whole in (table(2)[0], streams(2, predict=True)):
        for cut in range(len(whole) - 1):
            try:
                pdf.inspect(whole[:cut])
            except pdf.UnreadableError:
                continue
            assert cut >= len(whole) - 3
        for at in range(len(whole)):
            try:
                pdf.inspect(whole[:at] + bytes([whole[at] ^ 21]) + whole[at + 1 :])
            except pdf.UnreadableError:
                continue


def test_quarantine(spark):
    rows = [(n, bytearray(c) if c is not None else None, "own") for n, (c, _) in (GOOD | BAD).items()]
    good, bad = pdf.inspected(spark.createDataFrame(rows, "path string, content binary, reason string"))
    assert {r["path"]: r["n_pages"] for r in good.collect()} == {n: k for n, (_, k) in GOOD.items()}
    assert {r["path"]: r["reason"] for r in bad.collect()} == {n: k for n, (_, k) in BAD.items()}
    assert good.where(F.length("doc_id") != 16).isEmpty() and good.columns == ["path", "doc_id", "n_pages"]
