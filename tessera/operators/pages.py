"""Work on whole pages in Arrow batches of many pages, and the numpy steps that such work shares."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import packing

KEY = ["doc_id", "page"]
#: Rows of pages that are worked on at once.
ROWS = 20_000


def whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole pages with the first row of each page; rows come in the order of ``KEY``, and only the last page is held back."""
    held: list[pa.RecordBatch] = []
    last: np.ndarray | None = None

    def keys(b: pa.RecordBatch | pa.Table) -> np.ndarray:
        parts = [(np.asarray(pc.fill_null(b.column(k), 0)), np.asarray(pc.is_null(b.column(k))).astype(np.int64)) for k in KEY]
        return np.stack([v for p in parts for v in p], axis=1)

    def made() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        k = keys(table)
        return table, np.concatenate(([0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1))

    for b in batches:
        if not b.num_rows:
            continue
        b = b.replace_schema_metadata(None)
        k = keys(b)
        other = np.flatnonzero((k != k[-1]).any(axis=1))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            held.append(b.slice(0, cut))
        if held and (cut or (k[0] != last).any()):
            yield made()
            held = []
        held.append(b.slice(cut))
        last = k[-1]
    if held:
        yield made()


def _changes(table: pa.Table | pa.RecordBatch, names: list[str]) -> np.ndarray:
    """The first of the rows that follow one another with the same values."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in names:
        null, v = np.asarray(pc.is_null(table.column(name))), np.asarray(pc.fill_null(table.column(name), 0))
        new[1:] |= (v[1:] != v[:-1]) | (null[1:] != null[:-1])
    return np.flatnonzero(new)


def pieces(table: pa.Table) -> pa.Table:
    """A row for each piece of a page in ``table(to, doc_id, page, ...)``, its other columns as lists: rows that follow one another, or all of a page here where few do."""
    first = _changes(table, ["to", *KEY])
    if len(first) * 4 > table.num_rows:
        table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("to", *KEY)]))
        first = _changes(table, ["to", *KEY])
    at, keys = pa.array(np.append(first, table.num_rows), pa.int32()), pa.array(first)
    columns = {k: table.column(k).take(keys) if k in ("to", *KEY) else pa.ListArray.from_arrays(at, packing.one(table.column(k))) for k in table.column_names}
    return pa.table(columns)


def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``pieces``, about ``ROWS`` of whole pieces in a batch."""
    for b in batches:
        if not b.num_rows:
            continue
        other = next(k for k in b.schema.names if k not in KEY)
        sizes = np.asarray(pc.list_value_length(b.column(other))).astype(np.int64)
        part = (np.cumsum(sizes) - 1) // ROWS
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            own, row = b.slice(x, y - x), pa.array(np.repeat(np.arange(y - x), sizes[x:y]))
            yield pa.RecordBatch.from_arrays([own.column(k).take(row) if k in KEY else own.column(k).flatten() for k in own.schema.names], own.schema.names)


def map_pages(parts: DataFrame, run: Callable[[pa.Table, np.ndarray], pa.RecordBatch | pa.Table], kind: str) -> DataFrame:
    """``run`` over all rows of many pages of ``parts(doc_id, page, ...)`` at a time.

    Pages are dealt by hash to a fixed number of tasks: rows are few bytes beside the work on them, so by bytes alone Spark would leave it to a few tasks. They travel as packed columns, and a
    task brings the pieces of a page together by sorting, which is not bound to memory.
    """
    tasks = max(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts.sparkSession.sparkContext.defaultParallelism)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in packing.gathered(batches):
            table = pieces(table)
            yield from packing.cut(table.drop_columns(["to"]), np.asarray(table["to"]))
            del table

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_pages(put_together(batches)):
            yield from run(table, starts).to_batches() or ()
        pa.default_memory_pool().release_unused()

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in packing.rows_of(batches):
            yield b.select(parts_columns)

    parts_columns = parts.columns
    listed = ", ".join(f"`{f.name}` {f.dataType.simpleString() if f.name in KEY else f'array<{f.dataType.simpleString()}>'}" for f in parts.schema)
    dealt = parts.withColumn("to", F.pmod(F.xxhash64(*KEY), F.lit(tasks)).cast("int")).mapInArrow(deal, packing.PACKED).repartitionById(tasks, F.col("to"))
    return dealt.mapInArrow(lists, listed).sortWithinPartitions(*KEY).mapInArrow(task, kind)


def numbers(starts: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` rows the number of its page."""
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))


def column(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table.column(name))


def regions(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the least that the pairs ``a[i]``, ``b[i]`` connect it with."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[a], least[b])
        before = least.copy()
        np.minimum.at(least, before[a], low)
        np.minimum.at(least, before[b], low)
        least = least[least]
        if (least == before).all():
            return least


def lowest(groups: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    """The least of the values of each of ``n`` groups."""
    out = np.full(n, np.inf if values.dtype.kind == "f" else np.iinfo(np.int64).max, values.dtype)
    np.minimum.at(out, groups, values)
    return out


def highest(groups: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    return -lowest(groups, n, -values)


def islands(group: np.ndarray, start: np.ndarray, end: np.ndarray, gap: float) -> np.ndarray:
    """A number for each interval, in the order of group and place: those of a group that follow one another with no more than ``gap`` between them have one."""
    order = np.lexsort((end, start, group))
    g, s = group[order], start[order]
    ends, rank = np.unique(end[order], return_inverse=True)
    first = np.concatenate(([True], g[1:] != g[:-1]))[: len(g)]
    # The furthest end so far is that of the largest rank, which starts anew with each group.
    nth = np.cumsum(first) * len(ends)
    furthest = ends[np.maximum.accumulate(rank.ravel() + nth) - nth] if len(g) else ends
    opens = first.copy()
    opens[1:] |= s[1:] - furthest[:-1] > gap
    out = np.empty(len(g), np.int64)
    out[order] = np.cumsum(opens) - 1
    return out


def dense(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Values as numbers from 0 in their order, and how many there are."""
    found, inverse = np.unique(values, return_inverse=True)
    return inverse.ravel(), len(found)


def ranked(groups: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each entry the dense rank of its value in its group, from 0."""
    if not len(groups):
        return groups
    order = np.lexsort((values, groups))
    g, v = groups[order], values[order]
    new, first = np.concatenate(([True], (g[1:] != g[:-1]) | (v[1:] != v[:-1]))), np.concatenate(([True], g[1:] != g[:-1]))
    nth = np.cumsum(new) - 1
    out = np.empty(len(g), np.int64)
    out[order] = nth - nth[np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))]
    return out


def counted(page: np.ndarray, places: np.ndarray, asked_page: np.ndarray, asked: np.ndarray, equal: bool) -> np.ndarray:
    """For each of ``asked`` how many of the places of its page are under it, or ``equal`` to it too."""
    n = len(page)
    kind = np.concatenate((np.full(n, not equal), np.full(len(asked), equal)))
    pages = np.concatenate((page, asked_page))
    order = np.lexsort((kind, np.concatenate((places, asked)), pages))
    upto = np.empty(len(order), np.int64)
    upto[order] = np.cumsum(order < n)
    return upto[n:] - np.searchsorted(np.sort(page), asked_page)


def offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


def joined(group: np.ndarray, n: int, texts: pa.Array, by: str, *order: np.ndarray) -> pa.Array:
    """The texts of each of ``n`` groups as one, in the order of ``order`` and then of the texts; nulls are left out."""
    keys = pa.table({"group": group, **{str(k): v for k, v in enumerate(order)}, "text": texts})
    keys = keys.filter(pc.is_valid(keys["text"]))
    keys = keys.take(pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in keys.column_names]))
    at = offsets(np.bincount(np.asarray(keys["group"]), minlength=n))
    own = keys["text"].combine_chunks()
    own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), own.cast(pa.string())), by)


def grids(rows: np.ndarray, columns: np.ndarray, place: np.ndarray, texts: pa.Array, empty: str | None) -> pa.Array:
    """An array of rows for each table of ``rows`` by ``columns`` places: ``texts`` stand at their ``place`` among those of all tables, ``empty`` elsewhere."""
    where = np.full(int((rows * columns).sum()), -1)
    where[place] = np.arange(len(place))
    cells = texts.take(pa.array(where, mask=where < 0))
    cells = cells if empty is None else pc.fill_null(cells, empty)
    lines = pa.ListArray.from_arrays(pa.array(offsets(np.repeat(columns, rows)), pa.int32()), cells)
    return pa.ListArray.from_arrays(pa.array(offsets(rows), pa.int32()), lines)
