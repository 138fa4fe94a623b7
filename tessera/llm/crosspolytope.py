"""Approximate nearest neighbours by inner product: cross-polytope hashing, multiprobe tables, exact scores.

A pseudo-rotation is three rounds of random signs and a fast Hadamard transform. A hash function gives the signed axis nearest to the rotated vector; a
cell of a table is the axes of as many functions as leave about ``ROWS`` vectors a cell, the last of them over fewer axes. Vectors of unequal norms first get
one more component that makes all norms equal, and queries a zero, so the largest inner product is the nearest direction.

A query probes each table's cells in the order of what their axes cost it, the square of how far they are behind its own. A first round probes ``FIRST`` cells a table. How many more a query
needs follows from the score of its ``k``-th answer: how often a pair of a given cosine shares one of the first so many cells depends on the functions alone, not on
the data, and is measured on drawn pairs (``needed``). A second round probes as many as make that ``WANTED`` for the ``k``-th score, or all cells of one table where that is cheaper, and then nothing is lost.
So queries with close neighbours cost a few cells at any size, and others what their distance asks for. Scores are those of whole vectors, in double precision.

Every vector is in every table. Copies of a vector are one row with its ``k + 1`` least ids. Cells that begin alike are a part, the unit of the shuffle, with about ``PART`` rows; of a
part with more, blocks are dealt to several tasks, and queries go to each of them. A task returns ``k + 1`` answers a query and block at most,
in the second round only such as beat the ``k``-th so far, and these are merged.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components takes no part, nor does a row without an id or one whose length is
not the most frequent one (of these the longest); rows that share a query's id are its own; an id with several vectors asks with each, and has a list for each;
of equal scores the smaller id is first; fewer candidates than ``k`` are all returned; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, map_batches
from tessera.store import stored

SEED, ROUNDS = 7, 3
TABLES, ROWS, FIRST, WANTED = 4, 32, 16, 0.92
#: Rows of a part; entries that a task holds before it keeps the best of each query.
PART, ENTRIES = 1 << 11, 1 << 21
#: Cosines at which pairs are drawn, and pairs of each.
COSINES, DRAWN = 21, 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row; rows have a power of two of components."""
    n, d = x.shape
    h = 1
    while h < d:
        pairs = x.reshape(n, -1, 2, h)
        x = np.concatenate((pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]), axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


class Tables:
    """Hash functions over vectors of ``dims`` components, a power of two, to ``2 ** bits`` cells."""

    def __init__(self, dims: int, bits: int) -> None:
        self.dims, self.bits, self.axes = dims, bits, []
        while bits > 0:  # a function over m axes gives log2(2 m) bits
            self.axes.append(1 << min(dims.bit_length() - 1, bits - 1))
            bits -= self.axes[-1].bit_length()

    @lru_cache(maxsize=64)  # noqa: B019
    def _signs(self, table: int, function: int) -> np.ndarray:
        return np.random.default_rng([SEED, table, function]).choice([-1.0, 1.0], (ROUNDS, self.dims))

    def _signed(self, x: np.ndarray, table: int) -> Iterator[np.ndarray]:
        """For each function, how far each row reaches along each signed axis."""
        for f, m in enumerate(self.axes):
            turned = x
            for signs in self._signs(table, f):
                turned = hadamard(turned * signs)
            yield np.concatenate((turned[:, :m], -turned[:, :m]), axis=1)

    def cells(self, x: np.ndarray, table: int) -> np.ndarray:
        cell = np.zeros(len(x), np.int64)
        for along in self._signed(x, table):
            cell = cell * along.shape[1] + along.argmax(axis=1)
        return cell

    def probed(self, x: np.ndarray, table: int, most: int | np.ndarray) -> Iterator[np.ndarray]:
        """For each row, the first ``most`` cells in the order of their cost."""
        if not len(x):
            return
        most = np.broadcast_to(most, len(x))
        costs = [(s.max(axis=1, keepdims=True) - s) ** 2 for s in self._signed(x, table)]
        for i in range(len(x)):
            cell, cost = np.zeros(1, np.int64), np.zeros(1)
            for c in costs:
                cost = (cost[:, None] + c[i][None, :]).ravel()
                cell = (cell[:, None] * c.shape[1] + np.arange(c.shape[1])).ravel()
                if len(cost) > most[i]:
                    best = np.argpartition(cost, most[i] - 1)[: most[i]]
                    cell, cost = cell[best], cost[best]
                order = np.lexsort((cell, cost))
                cell, cost = cell[order], cost[order]
            yield cell


def needed(tables: Tables, dims: int, wanted: float = WANTED) -> list[int]:
    """For each of ``COSINES`` cosines from 0 to 1, the cells to probe in each table so that a pair meets with probability ``wanted``; 0: all cells of one table."""
    rng, every = np.random.default_rng(SEED), 1 << tables.bits
    steps = [FIRST]
    while steps[-1] * TABLES < every:
        steps.append(math.ceil(steps[-1] * 1.4))
    met, a_table = np.zeros((COSINES, len(steps))), DRAWN // TABLES
    for t in range(TABLES):
        q, other = (np.pad(rng.standard_normal((a_table, dims)), ((0, 0), (0, tables.dims - dims))) for _ in range(2))
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        other -= (other * q).sum(axis=1, keepdims=True) * q
        other /= np.maximum(np.linalg.norm(other, axis=1, keepdims=True), 1e-300)
        own = [tables.cells(c * q + math.sqrt(1 - c * c) * other, t) for c in np.linspace(0, 1, COSINES)]
        for i, cells in enumerate(tables.probed(q, t, min(every, steps[-1]))):
            for c in range(COSINES):
                at = np.flatnonzero(cells == own[c][i])
                if len(at):
                    met[c] += at[0] < np.array(steps)
    share = 1 - (1 - met / (a_table * TABLES)) ** TABLES
    return [next((p for p, s in zip(steps, share[c], strict=True) if s >= wanted and p * TABLES < every), 0) for c in range(COSINES)]


def _matrix(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _padded(x: np.ndarray, dims: int, longest: float | None) -> np.ndarray:
    """Vectors as they are hashed: of norm 1, padded; with ``longest``, that norm becomes 1 and one more component makes the others so."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    out = np.zeros((len(x), dims))
    out[:, : x.shape[1]] = x / (longest or norm)
    if longest:
        out[:, x.shape[1]] = np.sqrt(np.maximum(0, 1 - (norm[:, 0] / longest) ** 2))
    return out


def _usable(rows: DataFrame, name: str) -> DataFrame:
    """The rows with an id and finite components that are not all zero; no component is a negative zero."""
    v = F.col("vector")
    sound = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = rows.schema["vector"].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"
    return rows.where(F.col(name).isNotNull() & sound).select(F.col(name).cast("long").alias(name), F.transform(v, lambda x: x + F.lit(0.0).cast(kind)).cast(f"array<{kind}>").alias("vector"))


def _probes(asked: DataFrame, tables: Tables, first_bits: int, longest: float | None) -> DataFrame:
    """``(t, part, query, vector, floor, cells)`` for the cells of ``asked(query, vector, floor, lo, hi)`` from the ``lo``-th to the ``hi``-th; ``hi`` 0: all of table 0, ``cells`` null."""
    rest = tables.bits - first_bits
    kind = asked.schema["vector"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                x = _matrix(b.column(1))
                x = _padded(x / np.linalg.norm(x, axis=1, keepdims=True), tables.dims, None)
                lo, hi = b.column(3).to_numpy(), b.column(4).to_numpy()
                for t in range(TABLES):
                    who, parts, cells = [], [], []
                    some = np.flatnonzero(hi > 0)
                    for i, found in zip(some.tolist(), tables.probed(x[some], t, hi[some]), strict=True):
                        found = np.sort(found[lo[i] :])
                        own, starts = np.unique(found >> rest, return_index=True)
                        who += [i] * len(own)
                        parts += own.tolist()
                        cells += np.split(found, starts[1:])
                    for i in np.flatnonzero(hi == 0).tolist() if t == 0 else ():
                        who += [i] * (1 << first_bits)
                        parts += range(1 << first_bits)
                        cells += [None] * (1 << first_bits)
                    for lo_ in range(0, len(who), 1 << 13):
                        to = slice(lo_, lo_ + (1 << 13))
                        own = pa.array(who[to], pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([t] * len(own), pa.int32()), pa.array(parts[to], pa.int64()), *(b.column(c).take(own) for c in range(3)), pa.array(cells[to], pa.list_(pa.int64()))],
                            ["t", "part", "query", "vector", "floor", "cells"],
                        )

    return map_batches(asked.select("query", "vector", "floor", "lo", "hi"), run, f"t int, part bigint, query bigint, vector {kind}, floor double, cells array<bigint>")


def _indexed(nodes: DataFrame, tables: Tables, first_bits: int, longest: float | None, carry: bool = True) -> DataFrame:
    """``(t, part, cell, node, least, vector)`` of each of ``nodes(node, least, vector)`` in each table."""
    rest = tables.bits - first_bits
    kind = f"t int, part bigint, cell bigint, node bigint, least bigint, vector {nodes.schema['vector'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 12):
                b = batch.slice(at, 1 << 12)
                x = _padded(_matrix(b.column(2)), tables.dims, longest)
                for t in range(TABLES):
                    cells = tables.cells(x, t)
                    columns = [pa.array(np.full(len(x), t, np.int32)), pa.array(cells >> rest)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(cells), *b.columns] if carry else columns, ["t", "part", "cell", "node", "least", "vector"][: None if carry else 2])

    return map_batches(nodes.select("node", "least", "vector"), run, kind if carry else "t int, part bigint")


def _scored(k: int):
    """The ``k`` best of a block's vectors for each query that probes it, of those in the cells that the query probes with the query's ``floor`` as score at least."""
    names = ["query", "node", "least", "score"]

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3 + [pa.array([], pa.float64())], names=names)
        cell = rows["cell"].to_numpy()
        by_cell = np.argsort(cell, kind="stable")
        x, least = _matrix(rows["vector"])[by_cell], rows["least"].to_numpy()[by_cell]
        own, starts = np.unique(cell[by_cell], return_index=True)
        ends = np.append(starts[1:], len(cell))
        q, cells, floor = _matrix(asked["vector"]), asked["cells"].combine_chunks(), asked["floor"].to_numpy()
        every = np.flatnonzero(~np.asarray(cells.is_valid()))
        lengths = np.diff(cells.offsets.to_numpy())
        probed, who = cells.values.to_numpy(zero_copy_only=False)[cells.offsets[0].as_py() :], np.repeat(np.arange(len(cells)), lengths)
        order = np.argsort(probed, kind="stable")
        probed, who = probed[order], who[order]
        lo, hi = np.searchsorted(probed, own, "left"), np.searchsorted(probed, own, "right")

        def best(got: list[tuple]) -> list[tuple]:
            i, r, s = (np.concatenate(c) for c in zip(*got, strict=True))
            order = np.lexsort((least[r], -s, i))
            i, r, s = i[order], r[order], s[order]
            new = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            kept = np.arange(len(i)) - np.repeat(new, np.diff(np.append(new, len(i)))) < k
            return [(i[kept], r[kept], s[kept])]

        got, held = [], 0
        for c, (a, b) in enumerate(zip(starts, ends, strict=True)):
            asking = np.concatenate((who[lo[c] : hi[c]], every))
            for at in range(0, len(asking), 512):
                part = asking[at : at + 512]
                s = q[part] @ x[a:b].T
                i, r = np.nonzero(s >= floor[part][:, None])
                got.append((part[i], a + r, s[i, r]))
                held += len(i)
                if held > ENTRIES:
                    got = best(got)
                    held = len(got[0][0])
        if not got:
            return pa.table([pa.array([], pa.int64())] * 3 + [pa.array([], pa.float64())], names=names)
        ((i, r, _),) = best(got)
        exact = np.concatenate([np.empty(0)] + [(q[i[at : at + 4096]] * x[r[at : at + 4096]]).sum(axis=1) for at in range(0, len(i), 4096)])
        return pa.table([asked["query"].take(pa.array(i)), rows["node"].take(pa.array(by_cell[r])), pa.array(least[r]), pa.array(exact)], names=names)

    return run


def neighbours(rows: DataFrame, queries: DataFrame, k: int = 20, wanted: float = WANTED) -> DataFrame:
    """``(query_id, rank, id, score)``: of ``rows(id, vector)``, the ``k`` found with the largest inner product with each of ``queries(query_id, vector)``."""
    spark = rows.sparkSession
    nothing = spark.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    rows = checkpointed(_usable(rows.select("id", "vector"), "id"))
    dims = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if dims is None:
        return nothing
    dims = dims["d"]
    copies = Window.partitionBy("vector").orderBy("id")
    nodes = rows.where(F.size("vector") == dims).withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1)
    nodes = nodes.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), F.get("ids", 0).alias("least"), "ids", "vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n, greatest, shortest = nodes.agg(F.count("*"), F.max(norm), F.min(norm)).first()
    if not n:
        return nothing
    longest = greatest if shortest < 0.999 * greatest else None
    width = 1 << (dims + bool(longest) - 1).bit_length()
    bits = max(1, math.ceil(math.log2(n / ROWS)))
    tables, first_bits = Tables(width, bits), min(bits, max(0, math.ceil(math.log2(n / PART))))
    asked = _usable(queries.select("query_id", "vector"), "query_id").where(F.size("vector") == dims).distinct()
    asked = stored(asked.withColumn("query", F.monotonically_increasing_id()))

    crowded = checkpointed(_indexed(nodes, tables, first_bits, longest, carry=False).groupBy("t", "part").count().where(F.col("count") > 4 * PART).select("t", "part", F.ceil(F.col("count") / PART).alias("blocks")))
    blocks = F.coalesce("blocks", F.lit(1))
    keys = ["t", "part", "block"]
    index = _indexed(nodes, tables, first_bits, longest).join(crowded, ["t", "part"], "left").withColumn("block", F.pmod("node", blocks)).drop("blocks")

    def answers(asking: DataFrame, before: DataFrame | None) -> DataFrame:
        """The ``k`` best that the probes of ``asking`` find, with those found before."""
        probes = _probes(asking, tables, first_bits, longest).join(crowded, ["t", "part"], "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).drop("blocks")
        found = index.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInArrow(_scored(k + 1), "query bigint, node bigint, least bigint, score double")
        best = found.groupBy("query", "node").agg(F.first("least").alias("least"), F.max("score").alias("score"))
        near = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "least"))
        best = best.withColumn("near", near).where(F.col("near") <= k + 1).join(nodes.select("node", "ids"), "node")
        best = best.select("query", "score", F.explode("ids").alias("id")).join(asked.select("query", "query_id"), "query").where("id != query_id")
        if before is not None:
            best = best.select("query", "score", "id", "query_id").unionByName(before.select("query", "score", "id", "query_id")).distinct()
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
        return checkpointed(best.withColumn("rank", rank).where(F.col("rank") <= k))

    if 1 << bits <= TABLES * FIRST:
        got = answers(asked.select("query", "vector", F.lit(-math.inf).alias("floor"), F.lit(0).alias("lo"), F.lit(0).alias("hi")), None)
    else:
        got = answers(asked.select("query", "vector", F.lit(-math.inf).alias("floor"), F.lit(0).alias("lo"), F.lit(FIRST).alias("hi")), None)
        more = F.array(*map(F.lit, needed(tables, dims + bool(longest), wanted)))
        kth = got.groupBy("query").agg(F.count("*").alias("found"), F.min("score").alias("kth"))
        cosine = F.col("kth") / norm / greatest
        at = F.least(F.greatest(F.floor(cosine * (COSINES - 1)), F.lit(0)), F.lit(COSINES - 1)).cast("int")
        hi = F.when(F.col("found") >= k, F.get(more, at)).otherwise(0)
        # No score under the k-th can be an answer; products of a block may be rounded otherwise than the score.
        floor = F.when(F.col("found") >= k, F.col("kth") - 1e-9 * greatest * norm).otherwise(-math.inf)
        further = asked.join(kth, "query", "left").select("query", "vector", floor.alias("floor"), F.lit(FIRST).alias("lo"), hi.alias("hi")).where((F.col("hi") == 0) | (F.col("hi") > FIRST))
        got = answers(further, got)
    return got.select("query_id", "rank", "id", "score")
