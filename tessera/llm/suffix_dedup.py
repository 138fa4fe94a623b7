"""Removal of byte strings that repeat, by suffix arrays over shards built with external induced sorting.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier: in a document of smaller id, or
earlier in the same document. All start positions are judged on the input, over whole texts. Every repeat is found by
sorted suffixes or by compared bytes; hashes only say where to look.

1. *Texts.* Equal texts are one (in each batch before the shuffle, then by ``groupBy``, which compares them): the document
   of the least id goes on, the others' windows are all repeats.
2. *Scan.* Every window of ``LENGTH`` bytes has an anchor: of the ``GRAM``-byte strings in it the one with the least
   hash, the leftmost of equals. Equal windows have equal anchors. Neighbouring windows mostly share theirs,
   so a text falls into segments: runs of windows with one anchor, a fortieth as many as bytes. A segment
   travels as 38 bytes: the 64-bit hash of its anchor, 16-bit hashes of the bytes around the anchor that all windows of a
   class hold, and its place.
3. *Filter.* Segments meet by anchor. Those whose anchor and class hash no other segment has can't hold a repeat: equal windows
   have both in common. All others are asked for.
4. *Sort.* The bytes of these segments go to shards by anchor. Each shard is one text on disk, whose suffixes are sorted by
   ``suffix_sort``. Suffixes in a row with common prefixes of ``LENGTH`` are equal windows, and all but the first in
   (document, start) order are repeats. Segments with the same bytes are one in a batch before the shuffle, and
   in a shard as far as it remembers them; the copies are repeats. An anchor with over ``HOT`` segments is spread further: by the
   bytes left of it for windows that hold those, and by the bytes right of it for the others.
5. *Cut.* Each text gets its repeats back and is cut, and each document gets its text's result.

The texts are shuffled once, by a hash; steps 2, 4 and 5 read the same shuffle. Partitions are as many as the
input's bytes ask for, shards too (``SHARD_BYTES`` of text each, less in small inputs). A shard's text, its table of segments and its sorting are on disk
beyond ``suffix_sort.MEMORY`` entries each, in unlinked files of the folder that Spark gives its workers for spilling, which no other task reads.

Defined cases: a null text is empty; a text shorter than ``LENGTH`` loses nothing; a null id is the smallest;
rows alike in id and text are one document, and each is returned with its result; rows of one id but different texts
are ordered by a hash of the text; an empty table gives no rows; other columns pass through ``cut``.
``cut_text`` never leaves part of a character: a removed run is narrowed to whole characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import suffix_sort
from tessera.llm.common import beside, map_batches, packed

LENGTH, GRAM = 100, 24
SPAN = LENGTH - GRAM + 1
BLOCK = 1 << 18
PARTITION_BYTES = 64 << 20
#: A shard has the segments of so much text; more, up to SHARD_BYTES, once there are SHARDS_A_CORE of them.
LEAST_BYTES, SHARD_BYTES, SHARDS_A_CORE = 16 << 20, 1 << 30, 8
#: Buckets of a partition and of a shard, which spread evenly and keep like segments together.
BUCKETS = 16
#: Bytes of segments that a shard remembers while it looks for copies.
REMEMBERED = 8 << 20
HOT = 20_000
NULL_ID = -(1 << 63)
#: Windows by how far before their anchor they start; all of a class hold the same bytes around it.
CLASSES = ((0, 19), (20, 37), (38, 56), (57, SPAN - 1))
LEFT = 38
#: Columns of a row: whose it is, what it is, and whole-number arrays as bytes.
DEALT = "bucket int, id bigint, form bigint, kind int, a binary, b binary, c binary, d binary, e binary, f binary, g binary"
SEGMENTS, REPEATS, ASKED, PIECES = 0, 1, 2, 3
BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, and powers of BASE and of its inverse."""
    byte = _mix(np.arange(1, 257, dtype=np.uint64) * BASE)
    up = np.full(BLOCK + 1, BASE, np.uint64)
    up[0] = 1
    down = np.full(BLOCK + 1, pow(int(BASE), -1, 1 << 64), np.uint64)
    down[0] = 1
    return byte, np.multiply.accumulate(up), np.multiply.accumulate(down)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def segments(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor hash, content hash, class hashes, first window, number of windows and anchor place of each segment.

    ``raw``: bytes of at most BLOCK length, of documents that end at ``ends``. Windows over an end don't count.
    """
    none = tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if len(raw) < LENGTH:
        return none
    byte, up, down = _tables()
    h = byte[raw]
    h = h[:-1] * BASE + h[1:]
    h = h[:-2] * _power(2) + h[2:]
    h8 = h[:-4] * _power(4) + h[4:]
    h16 = h8[:-8] * _power(8) + h8[8:]
    g = _mix(h16[:-8] * _power(8) + h8[16:])
    low = np.uint64(BLOCK - 1)
    least = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    width = 1
    while width * 2 <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    at = (least & low).astype(np.int64)
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    # Cut at the ends of documents, and drop the windows that cross one.
    first = np.concatenate(([0], ends[:-1]))
    ok = ends - first >= LENGTH
    opens, closes = first[ok], ends[ok] - LENGTH + 1
    if not len(opens):
        return none
    cut = np.unique(np.concatenate((starts, opens, closes)))
    cut = cut[cut <= len(at)]
    lo, hi = cut[:-1] if cut[-1] == len(at) else cut, cut[1:] if cut[-1] == len(at) else np.append(cut[1:], len(at))
    which = np.searchsorted(opens, lo, side="right") - 1
    inside = (which >= 0) & (lo < closes[np.maximum(which, 0)])
    lo, hi = lo[inside], hi[inside]
    total = np.append(np.uint64(0), np.cumsum(g * up[: len(g)], dtype=np.uint64))
    content = _mix((total[hi - 1 + SPAN] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))
    at, around = at[lo], np.zeros(len(lo), np.uint64)
    for k, (least_gap, most_gap) in enumerate(CLASSES):
        a = np.maximum(at - least_gap, 0)
        z = np.minimum(at + LENGTH - most_gap - GRAM + 1, len(g))
        part = _mix((total[z] - total[a]) * down[a]) >> np.uint64(48)
        around |= part << np.uint64(16 * k)
    return g[at], content, around, lo, hi - lo, at


def _blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of whole documents of up to BLOCK bytes: bytes, ends, document numbers, offsets. Longer documents come in overlapping parts."""
    held: list[int] = []
    size = 0

    def out() -> Iterator:
        if held:
            raw = np.frombuffer(b"".join(texts[i] for i in held), np.uint8)
            yield raw, np.cumsum([len(texts[i]) for i in held]), np.array(held), np.zeros(len(held), np.int64)

    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        if size + len(t) > BLOCK:
            yield from out()
            held, size = [], 0
        if len(t) > BLOCK:
            for x in range(0, len(t) - LENGTH + 1, BLOCK - LENGTH + 1):
                part = np.frombuffer(t, np.uint8, min(BLOCK, len(t) - x), x)
                yield part, np.array([len(part)]), np.array([i]), np.array([x])
        else:
            held.append(i)
            size += len(t)
    yield from out()


def _row(rows: dict[str, list], bucket: int, id_: int, form: int, kind: int, *arrays: np.ndarray) -> None:
    for name, v in zip(rows, (bucket, id_, form, kind, *(a.tobytes() for a in arrays), *[None] * (7 - len(arrays))), strict=True):
        rows[name].append(v)


def _new_rows() -> dict[str, list]:
    return {f.split()[0]: [] for f in DEALT.split(", ")}


def _batch(rows: dict[str, list]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    names = [f.split() for f in DEALT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(rows[n], kinds[k]) for n, k in names], [n for n, _ in names])


def _by_document(rows: dict[str, list], kind: int, ids: np.ndarray, forms: np.ndarray, *arrays: np.ndarray) -> None:
    """A row for each (id, form) with its part of the arrays."""
    if not len(ids):
        return
    order = np.lexsort((arrays[0], forms, ids))
    ids, forms, arrays = ids[order], forms[order], [a[order] for a in arrays]
    cut = np.flatnonzero((ids[1:] != ids[:-1]) | (forms[1:] != forms[:-1])) + 1
    for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(ids)], strict=True):
        # The form is a hash; its low bits spread the rows.
        _row(rows, int(forms[s]) & 0x7FFFFFFF, int(ids[s]), int(forms[s]), kind, *(a[s:e] for a in arrays))


def _by_bucket(rows: dict[str, list], kind: int, bucket: np.ndarray, *arrays: np.ndarray) -> None:
    """A row for each bucket with its part of the arrays."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist()
    for s, e in zip(cut, [*cut[1:], len(order)], strict=True):
        own = order[s:e]
        _row(rows, int(bucket[own[0]]), 0, 0, kind, *(x[own] for x in arrays))


def _bytes(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column.cast(pa.binary())]


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of a batch as one, with the least id."""
    for b in batches:
        one = pa.Table.from_batches([b]).group_by(["suffix_form", "suffix_text"]).aggregate([("suffix_id", "min")])
        one = one.select(["suffix_id_min", "suffix_form", "suffix_text"]).rename_columns(["suffix_id", "suffix_form", "suffix_text"])
        yield from one.combine_chunks().to_batches()


def _scan(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, forms = (b.column(i).to_numpy() for i in (0, 1))
            texts = _bytes(b.column(2))
            parts = []
            for raw, ends, docs, offsets in _blocks(texts):
                anchor, content, around, lo, n, at = segments(raw, ends)
                which = np.searchsorted(ends, lo, side="right")
                start = lo - np.concatenate(([0], ends[:-1]))[which] + offsets[which]
                parts.append((anchor, content, docs[which], start, n, (at - lo).astype(np.int64), around))
            if not parts:
                continue
            anchor, content, doc, start, n, gap, around = (np.concatenate(x) for x in zip(*parts, strict=True))
            i, f = ids[doc], forms[doc]
            order = np.lexsort((start, f, i, content, anchor))
            anchor, content, i, f, start, n, gap, around, doc = (x[order] for x in (anchor, content, i, f, start, n, gap, around, doc))
            # A later copy in the batch, by its bytes, is a repeat.
            alike = np.flatnonzero((anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1]) & (n[1:] == n[:-1])) + 1
            again = np.zeros(len(anchor), bool)
            for k, d, s, e, d2, s2 in zip(*(x.tolist() for x in (alike, doc[alike], start[alike], n[alike] + LENGTH - 1, doc[alike - 1], start[alike - 1])), strict=True):
                again[k] = texts[d][s : s + e] == texts[d2][s2 : s2 + e]
            rows = _new_rows()
            _by_document(rows, REPEATS, i[again], f[again], start[again].astype(np.int32), n[again].astype(np.int32))
            order = np.flatnonzero(~again)
            order = order[np.lexsort((start[order], f[order], i[order]))]
            anchor, i, f, start, n, gap, around = (x[order] for x in (anchor, i, f, start, n, gap, around))
            wide = (n.astype(np.uint16) << np.uint16(8)) | gap.astype(np.uint16)
            _by_bucket(rows, SEGMENTS, (anchor >> np.uint64(32)).astype(np.int64) % buckets, anchor, i, f, start.astype(np.int32), wide, around)
            yield _batch(rows)

    return run


def _joined(parts: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)


def _shared(anchor: np.ndarray, n: np.ndarray, gap: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last window of each segment that can have an equal one under its anchor (last under first: none).

    A segment's windows start ``gap`` down to ``gap - n + 1`` bytes before the anchor.
    """
    first, last = np.full(len(anchor), 1 << 20, np.int64), np.full(len(anchor), -1, np.int64)
    for k, (least, most) in enumerate(CLASSES):
        # The segment's windows of the class, counted from its start.
        lo, hi = np.maximum(gap - most, 0), np.minimum(gap - least, n - 1)
        own = np.flatnonzero(hi >= lo)
        part = (around[own] >> np.uint64(16 * k)) & np.uint64(0xFFFF)
        own = own[np.lexsort((part, anchor[own]))]
        part = (around[own] >> np.uint64(16 * k)) & np.uint64(0xFFFF)
        same = (anchor[own][1:] == anchor[own][:-1]) & (part[1:] == part[:-1])
        own = own[np.append(same, False) | np.append(False, same)] if len(own) else own
        first[own], last[own] = np.minimum(first[own], lo[own]), np.maximum(last[own], hi[own])
    return first, last


def _grouped(batches: Iterator[pa.RecordBatch], kind: int, columns: int) -> Iterator[tuple[pa.RecordBatch | None, int, list[list[bytes]]]]:
    """Rows of ``kind`` by bucket, which come in order: (None, bucket, columns); and the rows of other kinds."""
    bucket, held = None, [[] for _ in range(columns)]
    for b in batches:
        kinds, buckets = b.column(3).to_numpy(), b.column(0).to_numpy()
        if (kinds != kind).any():
            yield b.filter(pa.array(kinds != kind)), 0, []
        mine = np.flatnonzero(kinds == kind)
        for at in np.split(mine, np.flatnonzero(np.diff(buckets[mine])) + 1) if len(mine) else ():
            if bucket is not None and bucket != buckets[at[0]]:
                yield None, bucket, held
                held = [[] for _ in range(columns)]
            bucket = int(buckets[at[0]])
            for k in range(columns):
                held[k] += _bytes(b.column(4 + k).take(pa.array(at)))
    if held[0]:
        yield None, bucket, held


def _filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments, or parts of them, that may have equal windows under their anchor."""
    for other, _, held in _grouped(batches, SEGMENTS, 6):
        if other is not None:
            yield other
            continue
        anchor, i, f, start, wide, around = (_joined(x, t) for x, t in zip(held, (np.uint64, np.int64, np.int64, np.int32, np.uint16, np.uint64), strict=True))
        # Anchors that occur once need no more.
        order = np.argsort(anchor, kind="stable")
        same = anchor[order][1:] == anchor[order][:-1]
        order = order[np.append(False, same) | np.append(same, False)]
        anchor, i, f, start, wide, around = (x[order] for x in (anchor, i, f, start, wide, around))
        if not len(anchor):
            continue
        n, gap = (wide >> np.uint16(8)).astype(np.int32), (wide & np.uint16(255)).astype(np.int32)
        first, last = _shared(anchor, n, gap, around)
        ask = np.flatnonzero(last >= first)
        if not len(ask):
            continue
        start, n, gap = start[ask] + first[ask], (last - first + 1)[ask], gap[ask] - first[ask]
        anchor, i, f = anchor[ask], i[ask], f[ask]
        cut = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        size = np.diff(np.append(cut, len(anchor)))
        rows = _new_rows()
        _by_document(rows, ASKED, i, f, start.astype(np.int32), n.astype(np.int32), gap.astype(np.int32), anchor, (np.repeat(size, size) > HOT).astype(np.int8))
        yield _batch(rows)


def hash64(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")


def _bytes_of(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, form, text, asked: list of rows of arrays) to the bytes that the shards sort."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, forms, texts, asked = b.column(0).to_pylist(), b.column(1).to_pylist(), _bytes(b.column(2)), b.column(3)
            # By document and start, so that the first of equal segments is the least.
            first: dict[bytes, int] = {}
            pieces: list[tuple[int, int, int, int, int]] = []
            raws: list[bytes] = []
            copies: list[tuple[int, int, int, int]] = []
            for d in sorted(range(len(ids)), key=lambda k: (ids[k], forms[k])):
                raw, id_, form = texts[d], ids[d], forms[d]
                found = asked[d].as_py()
                start, n, gap, anchor, hot = (np.concatenate([np.frombuffer(x[c], t) for x in found]) for c, t in zip("abcde", (np.int32, np.int32, np.int32, np.uint64, np.int8), strict=True))
                order = np.argsort(start, kind="stable")
                for s, k, g, key, h in zip(*(x[order].tolist() for x in (start, n, gap, anchor, hot)), strict=True):
                    cuts = ((s, k, key >> 32),)
                    if h:
                        at = s + g
                        left = max(0, min(k, at - LEFT - s + 1))
                        cuts = ((s, left, hash64(raw[at - LEFT : at + GRAM])), (s + left, k - left, hash64(raw[at : at + LENGTH - LEFT + 1])))
                    for s2, k2, key2 in cuts:
                        if not k2:
                            continue
                        own = raw[s2 : s2 + k2 + LENGTH - 1]
                        if first.setdefault(own, len(raws)) == len(raws):
                            raws.append(own)
                            pieces.append((key2 % buckets, id_, form, s2, k2))
                        else:
                            copies.append((id_, form, s2, k2))
            rows = _new_rows()
            if copies:
                i, f, s, k = np.array(copies, np.int64).T
                _by_document(rows, REPEATS, i, f, s.astype(np.int32), k.astype(np.int32))
            if pieces:
                bucket, i, f, s, k = np.array(pieces, np.int64).T
                order = np.argsort(bucket, kind="stable")
                cut = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist()
                for a, z in zip(cut, [*cut[1:], len(order)], strict=True):
                    own = order[a:z]
                    whole = np.frombuffer(b"".join(raws[o] for o in own.tolist()), np.uint8)
                    _row(rows, int(bucket[own[0]]), 0, 0, PIECES, i[own], f[own], s[own].astype(np.int32), k[own].astype(np.int32), whole)
            yield _batch(rows)

    return run


class Shard:
    """Segments on disk: their bytes as one text, and whose they are. Copies that are remembered are left out."""

    #: Bytes as letters; 0 ends the text and 1 a segment. UTF-8 has no bytes over 0xF4.
    LETTERS = bytes(min(b + 2, 255) for b in range(256))

    def __init__(self, memory: int):
        self.memory = memory
        self.table = [suffix_sort.Spool(np.int64) for _ in range(4)]
        self.text = suffix_sort.Spool(np.uint8)
        self.seen: dict[bytes, tuple[int, int, int]] = {}
        self.size = 0

    def add(self, i: np.ndarray, f: np.ndarray, start: np.ndarray, n: np.ndarray, whole: bytes) -> Iterator[tuple[int, int, int, int]]:
        """Takes segments, and gives those (id, form, start, windows) that are copies of others."""
        whole, at = whole.translate(self.LETTERS), 0
        for who, k in zip(zip(i.tolist(), f.tolist(), start.tolist(), strict=True), n.tolist(), strict=True):
            raw = whole[at : at + k + LENGTH - 1]
            at += len(raw)
            other = self.seen.setdefault(raw, who)
            if other is who:
                self.size += len(raw)
            elif who < other:
                self.seen[raw] = who
                yield *other, k
            else:
                yield *who, k
        if self.size > REMEMBERED:
            self.forget()

    def forget(self) -> None:
        if self.seen:
            raws, whose = list(self.seen), np.array(list(self.seen.values()), np.int64)
            size = np.array([len(r) + 1 for r in raws], np.int64)
            for spool, x in zip(self.table, (*whose.T, np.cumsum(size) - size + len(self.text)), strict=True):
                spool.add(x)
            self.text.add(np.frombuffer(b"\x01".join([*raws, b""]), np.uint8))
            self.seen, self.size = {}, 0

    def repeats(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Id, form, first window and number of windows of runs of repeats, by sorted suffixes."""
        self.forget()
        if not len(self.text):
            return
        self.text.add(np.zeros(1, np.uint8))
        text = self.text.array(self.memory)
        i, f, start, begin = (t.array(self.memory) for t in self.table)
        ends = np.append(begin, len(text) - 1)
        again = suffix_sort.scratch(len(text), np.bool_, self.memory)
        open_ = None
        for at, lcp in suffix_sort.sorted_down(text, LENGTH, self.memory):
            # Groups of suffixes that are equal over LENGTH; of the group that the last run left open its least is known.
            if open_ is not None and lcp[0] >= LENGTH:
                at, lcp = np.append(open_, at), np.append(np.int32(0), lcp)
            group = np.cumsum(lcp < LENGTH)
            many = np.flatnonzero(np.bincount(group)[group] > 1)
            open_, last = at[-1], lcp[-1]
            at, group = at[many].astype(np.int64), group[many]
            of = np.searchsorted(begin, at, side="right")
            # A suffix that reaches the segment's end is not a window.
            whole = at + LENGTH < ends[of]
            at, group, of = at[whole], group[whole], of[whole] - 1
            if not len(at):
                continue
            order = np.lexsort((start[of] + at - begin[of], f[of], i[of], group))
            at, group = at[order], group[order]
            later = np.append(False, group[1:] == group[:-1])
            again[at[later]] = True
            if last >= LENGTH and whole[-1]:
                open_ = at[~later][-1]
        for k in range(0, len(again), suffix_sort.RUN):
            hit = np.flatnonzero(again[k : k + suffix_sort.RUN]) + k
            if len(hit):
                new = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
                first, n = hit[new], np.diff(np.append(new, len(hit)))
                of = np.searchsorted(begin, first, side="right") - 1
                yield i[of], f[of], start[of] + first - begin[of], n


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = Shard(suffix_sort.MEMORY)
    for b in batches:
        kinds = b.column(3).to_numpy()
        if (kinds != PIECES).any():
            yield b.filter(pa.array(kinds != PIECES))
        copies: list[tuple[int, int, int, int]] = []
        columns = [_bytes(c) for c in b.filter(pa.array(kinds == PIECES)).columns[4:9]]
        for i, f, start, n, whole in zip(*columns, strict=True):
            arrays = (np.frombuffer(x, t) for x, t in zip((i, f, start, n), (np.int64, np.int64, np.int32, np.int32), strict=True))
            copies += shard.add(*arrays, whole)
        if copies:
            rows = _new_rows()
            i, f, start, n = np.array(copies, np.int64).T
            _by_document(rows, REPEATS, i, f, start.astype(np.int32), n.astype(np.int32))
            yield _batch(rows)
    for i, f, start, n in shard.repeats():
        rows = _new_rows()
        _by_document(rows, REPEATS, i, f, start.astype(np.int32), n.astype(np.int32))
        yield _batch(rows)


def removed(size: int, found: list[dict]) -> np.ndarray:
    """For each byte of a text of ``size`` bytes, whether it goes."""
    step = np.zeros(size + 1, np.int64)
    for x in found:
        start, n = np.frombuffer(x["a"], np.int32), np.frombuffer(x["b"], np.int32)
        np.add.at(step, start, 1)
        np.add.at(step, start + n + LENGTH - 1, -1)
    return np.cumsum(step[:-1]) > 0


def cut_text(raw: bytes, gone: np.ndarray) -> str:
    """What is left of a text, removed runs narrowed to whole characters."""
    data = np.frombuffer(raw, np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    keep = np.zeros(int(char[-1]) + 1 if len(char) else 0, bool)
    keep[char[~gone]] = True
    return data[keep[char]].tobytes().decode()


def _whole(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def keyed(docs: DataFrame, text: str = "text") -> tuple[Column, Column]:
    """The place of a document in the order: its id, and a hash of its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("suffix_id"), F.xxhash64(F.lit(3), _whole(text)).alias("suffix_form")


def _found(docs: DataFrame, text: str) -> DataFrame:
    """``(suffix_id, suffix_form, suffix_text, suffix_found)``: each different text of ``LENGTH`` bytes or more, under its least id, with the rows of its repeats.

    All joins are by ``suffix_form`` alone, by which the texts were dealt, so that Spark shuffles them once; the id is compared besides.
    """
    long_ = docs.select(*keyed(docs, text), _whole(text).alias("suffix_text")).where(F.octet_length("suffix_text") >= LENGTH)
    size, cores = int(docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0), docs.sparkSession.sparkContext.defaultParallelism
    parts = max(2 * cores, -(-size // PARTITION_BYTES))
    shards = max(cores, min(SHARDS_A_CORE * cores, -(-size // LEAST_BYTES)), -(-size // SHARD_BYTES))
    one = map_batches(long_, _collapse, "suffix_id bigint, suffix_form bigint, suffix_text string")
    # Keys that can't be null spare the inner join a filter that would make its shuffle differ from the others'.
    one = one.select(*(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("suffix_id", "suffix_form")), "suffix_text")
    texts = one.repartition(parts, "suffix_form").groupBy("suffix_form", "suffix_text").agg(F.min("suffix_id").alias("suffix_id"))
    texts = texts.select("suffix_id", "suffix_form", "suffix_text")
    dealt = map_batches(texts, _scan(parts * BUCKETS), DEALT).repartition(parts, "bucket").sortWithinPartitions("bucket")
    arrays = F.struct(*"abcde")
    of_kind = lambda kind: F.collect_list(F.when(F.col("kind") == kind, arrays))
    keys = (F.col("id").alias("at_id"), F.col("form").alias("at_form"))

    def per_text(rows: DataFrame, *lists: Column) -> DataFrame:
        return rows.repartition(parts, "form").groupBy("id", "form").agg(*lists).select(*keys, *lists_of(lists))

    def lists_of(lists: tuple[Column, ...]) -> list[str]:
        return ["asked", "first"][: len(lists)]

    at = per_text(map_batches(dealt, _filter, DEALT), of_kind(ASKED).alias("asked"), of_kind(REPEATS).alias("first"))
    mine = lambda left, right: (F.col("suffix_form") == F.col(f"{right}_form")) & (F.col("suffix_id") - F.col(f"{right}_id") == 0)
    asking = texts.join(at, mine(texts, "at")).where(F.size("asked") > 0).select("suffix_id", "suffix_form", "suffix_text", "asked")
    pieces = map_batches(asking, _bytes_of(shards * BUCKETS), DEALT).repartition(shards, "bucket").sortWithinPartitions("bucket")
    more = per_text(map_batches(pieces, _sort, DEALT), F.collect_list(arrays).alias("asked"))
    more = more.select(F.col("at_id").alias("more_id"), F.col("at_form").alias("more_form"), F.col("asked").alias("second"))
    none = F.array().cast("array<struct<a:binary,b:binary,c:binary,d:binary,e:binary>>")
    both = texts.join(at, mine(texts, "at"), "left").join(more, mine(texts, "more"), "left")
    found = F.concat(F.coalesce("first", none), F.coalesce("second", none))
    return both.select("suffix_id", "suffix_form", "suffix_text", F.transform(found, lambda x: F.struct(x["a"], x["b"])).alias("suffix_found"))


def _map_found(found: DataFrame, added: str, make: Callable[[bytes, np.ndarray], tuple]) -> DataFrame:
    """``(suffix_id, suffix_form)`` with what ``make`` gives for a text and its removed bytes, nulls where it has no repeats."""
    names = [a.split() for a in added.split(", ")]
    types = {"bigint": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for text, rows in zip(b.column(2), b.column(3), strict=True):
                if len(rows):
                    raw = text.as_buffer().to_pybytes()
                    got.append(make(raw, removed(len(raw), rows.as_py())))
                else:
                    got.append((None,) * len(names))
            cols = list(zip(*got, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *(pa.array(c, types[k]) for c, (_, k) in zip(cols, names, strict=True))], ["suffix_id", "suffix_form", *(n for n, _ in names)])

    # A text without repeats needn't go to Python.
    text = F.when(F.size("suffix_found") > 0, F.col("suffix_text").cast("binary")).alias("suffix_text")
    return map_batches(found.select("suffix_id", "suffix_form", text, "suffix_found"), run, f"suffix_id bigint, suffix_form bigint, {added}")


def digests(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``."""

    def make(raw: bytes, gone: np.ndarray) -> tuple:
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        return len(raw) - len(left), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()

    cut = _map_found(_found(docs, text), "suffix_removed bigint, suffix_spans bigint, suffix_sha string", make).withColumn("suffix_least", F.lit(True))
    whole = _whole(text)
    size = F.octet_length(whole).cast("long")
    rows = packed(docs, keep, *keyed(docs, text), size.alias("suffix_bytes"), F.sha2(whole, 256).alias("suffix_whole")).join(cut, ["suffix_id", "suffix_form"], "left")
    # A text of another id that is the same goes whole; one without repeats stays.
    gone = F.col("suffix_least").isNull() & (F.col("suffix_bytes") >= LENGTH)
    zero = F.lit(0).cast("long")
    made = rows.select(
        "kept",
        F.col("suffix_bytes").alias("n_bytes"),
        F.when(gone, F.col("suffix_bytes")).otherwise(F.coalesce("suffix_removed", zero)).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("suffix_spans", zero)).alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("suffix_sha", "suffix_whole")).alias("kept_sha256"),
    )
    return beside(made, keep)


def cut(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` cut, and ``suffix_removed``, the bytes that went."""

    def make(raw: bytes, gone: np.ndarray) -> tuple:
        left = cut_text(raw, gone)
        return left, len(raw) - len(left.encode())

    found = _map_found(_found(docs, text), "suffix_cut string, suffix_removed bigint", make).withColumn("suffix_least", F.lit(True))
    rows = packed(docs, docs.columns, *keyed(docs, text)).join(found, ["suffix_id", "suffix_form"], "left")
    own = F.col("kept")[text]
    gone = F.col("suffix_least").isNull() & (F.octet_length(own) >= LENGTH)
    left = F.when(gone, F.lit("")).otherwise(F.coalesce("suffix_cut", own)).alias(text)
    went = F.when(gone, F.octet_length(own).cast("long")).otherwise(F.coalesce("suffix_removed", F.lit(0).cast("long"))).alias("suffix_removed")
    return rows.select(*(left if c == text else F.col("kept")[c].alias(c) for c in docs.columns if c != "suffix_removed"), went)
