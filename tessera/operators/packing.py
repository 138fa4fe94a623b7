"""Rows on their way to other tasks, as compressed columns: a shuffled row by itself takes several times the bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows, and bytes of them, that a task gathers before it deals them out.
ROWS, BYTES = 500_000, 32 << 20
#: Columns of a DataFrame of packed rows: the task that they go to, and a batch of them.
PACKED = "to int, packed binary"


def one(column: pa.ChunkedArray) -> pa.Array:
    """A column in one piece."""
    whole = column.combine_chunks()
    return whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole


def _values(own: pa.Array) -> pa.Array:
    """A column's values, or those of all its lists."""
    return own.flatten() if pa.types.is_list(own.type) else own


def _with(own: pa.Array, values: pa.Array) -> pa.Array:
    """``own`` with other values, in lists of as many."""
    if not pa.types.is_list(own.type):
        return values
    at = np.asarray(own.offsets)
    return pa.ListArray.from_arrays(pa.array(at - at[0]), values)


def pack(table: pa.Table | pa.RecordBatch) -> bytes:
    """A table as compressed columns, also of lists: whole numbers as the differences from one to the next, numbers byte by byte, strings as their sizes and all letters; but numbers with nulls as they are."""
    columns, fields, letters = [], [], []
    for name in table.schema.names:
        own = table.column(name)
        own = one(own) if isinstance(own, pa.ChunkedArray) else own
        how, left, v = b"", 0, _values(own)
        kind = v.type
        if len(v) and not (pa.types.is_list(own.type) and own.null_count):
            if pa.types.is_string(kind):
                size = np.asarray(pc.fill_null(pc.binary_length(v), 0))
                first = np.frombuffer(v.buffers()[1], np.int32)[v.offset]
                # Nulls have no letters in what Arrow makes; where they have, the column stays as it is.
                if np.frombuffer(v.buffers()[1], np.int32)[v.offset + len(v)] - first == (left := int(size.sum())):
                    letters.append(v.buffers()[2].slice(first, left).to_pybytes() if left else b"")
                    own, how = _with(own, pa.array(size, pa.int32(), mask=np.asarray(v.is_null()))), b"letters"
            elif not v.null_count and pa.types.is_integer(kind):
                n = np.asarray(v)
                own, how = _with(own, pa.array(np.diff(n, prepend=n.dtype.type(0)), kind)), b"steps"
            elif not v.null_count and pa.types.is_floating(kind) and kind.bit_width > 16:
                n = np.ascontiguousarray(v)
                own, how = _with(own, pa.array(np.ascontiguousarray(n.view(np.uint8).reshape(len(n), -1).T).reshape(-1).view(n.dtype))), b"bytes"
        columns.append(own)
        fields.append(pa.field(name, own.type, metadata={"how": how, "left": str(left)} if how else None))
    batch = pa.record_batch(columns, schema=pa.schema(fields))
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as to:
        to.write_batch(batch)
    whole = b"".join([*letters, out.getvalue().to_pybytes()])
    return len(whole).to_bytes(8, "little") + sum(map(len, letters)).to_bytes(8, "little") + pa.compress(whole, codec="zstd", asbytes=True)


def unpack(packed: bytes) -> pa.Table:
    """The table of ``pack``."""
    whole = pa.decompress(packed[16:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd")
    columns, at = [], 0
    table = pa.ipc.open_stream(whole.slice(int.from_bytes(packed[8:16], "little"))).read_all()
    for f, own in zip(table.schema, table.columns, strict=True):
        own, meta = one(own), f.metadata or {}
        how, v = meta.get(b"how"), _values(own)
        if how == b"letters":
            left = int(meta[b"left"])
            ends = np.concatenate(([0], np.cumsum(np.asarray(pc.fill_null(v, 0))))).astype(np.int32)
            text = pa.StringArray.from_buffers(len(v), pa.py_buffer(ends), whole.slice(at, left))
            own, at = _with(own, pc.if_else(v.is_valid(), text, None) if v.null_count else text), at + left
        elif how == b"steps":
            own = _with(own, pa.array(np.cumsum(np.asarray(v), dtype=v.type.to_pandas_dtype()), v.type))
        elif how == b"bytes":
            n = np.ascontiguousarray(v)
            own = _with(own, pa.array(np.ascontiguousarray(n.view(np.uint8).reshape(-1, len(n)).T).reshape(-1).view(n.dtype)))
        columns.append(own)
    return pa.table(columns, names=table.schema.names)


def unpacked(packed: Iterable[bytes]) -> pa.Table | None:
    """All packed rows as one table, or None."""
    tables = [unpack(p) for p in packed]
    return pa.concat_tables(tables).combine_chunks() if tables else None


def as_rows(to: list[int], packed: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Batches of ``PACKED``, of few bytes each."""
    first, held = 0, 0
    for k, p in enumerate(packed, 1):
        held += len(p)
        if held >= 16 << 20 or k == len(packed):
            yield pa.record_batch([pa.array(to[first:k], pa.int32()), pa.array(packed[first:k], pa.binary())], names=["to", "packed"])
            first, held = k, 0


def cut(table: pa.Table, to: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of a table packed by ``to``, those of a pack in their order."""
    if not len(to):
        return
    order = np.argsort(to.astype(np.int16) if to.max() < 1 << 15 else to, kind="stable")  # numpy sorts short numbers by radix
    first = np.flatnonzero(np.diff(to[order], prepend=-1)).tolist()
    packs = [pack(table.take(pa.array(order[a:b]))) for a, b in zip(first, [*first[1:], len(to)], strict=True)]
    yield from as_rows(to[order[first]].tolist(), packs)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about ``ROWS`` rows or ``BYTES`` bytes."""
    held, n, size = [], 0, 0
    for b in batches:
        if b.num_rows:
            held.append(b.replace_schema_metadata(None))
            n, size = n + b.num_rows, size + b.nbytes
        if n >= ROWS or size >= BYTES:
            table, held, n, size = pa.Table.from_batches(held).combine_chunks(), [], 0, 0
            yield table
            del table
            pa.default_memory_pool().release_unused()
    if held:
        table, held = pa.Table.from_batches(held).combine_chunks(), []
        yield table
        del table
    pa.default_memory_pool().release_unused()  # workers wait for the next stage beside those that run


def packed(df: DataFrame) -> DataFrame:
    """``df(to, ...)`` as ``PACKED``: many of its rows at a time by the number ``to`` of the task that they go to, in the order in which they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            yield from cut(table.drop_columns(["to"]), np.asarray(table["to"]))
            del table

    return df.withColumn("to", F.col("to").cast("int")).mapInArrow(run, PACKED)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that were packed, with ``to``."""
    for b in batches:
        for to, own in zip(b.column("to").to_pylist(), b.column("packed"), strict=True):
            table = unpack(own.as_py())
            yield from table.append_column("to", pa.array(np.full(table.num_rows, to, np.int32))).to_batches()
