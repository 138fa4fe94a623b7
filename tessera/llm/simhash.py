"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming links, components.

``fingerprints`` reads every whole text once. A bit is 1 if over half of the hashes of the text's word
shingles have it. ``links`` works on the distinct fingerprints: copies share one, so a
group of copies is one row. Tables are sets of blocks of bits; fingerprints that agree on a table's blocks share a key,
are dealt to one group and verified by their whole Hamming distance.

* One family of hashes, 64 bits (``near_duplicates``): fingerprints that differ in ``distance`` bits agree on all but ``distance``
  blocks, so each choice of the blocks that agree is a table, and no link is lost. There are as many blocks as leave keys wide
  enough for the number of fingerprints, so a key has about one at any size.
* Several families, one long fingerprint (``keep_one``): texts of a similarity of 0.8 differ in 15 % of the bits, for which blocks that
  must agree would be two bits wide. Tables are single blocks instead, so many that a pair at that similarity shares one with a
  probability of ``FOUND``; closer pairs are surer. A key has ``GROUP`` fingerprints or so at any size, and the number of tables
  grows with about the fourth root of theirs.

Within a key no list of all pairs is made: a search from the fingerprints yet unreached takes all of the
unreached within ``distance``, so the links are a forest that has the same components as all the
pairs, and a cluster of close fingerprints costs little more than one pass over it. In a key with over ``HOT`` fingerprints the search
ends when it finds little more; what it left, which is far from all it reached, is dealt again if it is over ``HOT`` too. A task holds about
``HOLD`` fingerprints of a key at most: of one with more, all are dealt again. No link within a key is lost by dealing again: one family
goes by ``distance + 1`` blocks of the bits that the table leaves free, of which one must agree; several families, and what is
still too much after ``DEPTH`` tables, are cut into parts of half of ``HOT``, and every two parts are a group of their own, searched to the
end. That is the comparison of all pairs of what is left of a key, in bounded groups over all tasks.

Defined cases: a null text, or one without words, has fingerprint 0 and is linked like any other;
fewer words than a shingle make one shingle of all; repeated rows share their component; a component of
null ids has a null id; an empty table gives no rows; long texts are hashed whole in slices; ``keep_one`` keeps, of rows alike in id
and text, the one whose columns have the least hash, and passes columns of any name.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Generator, Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import beside, checkpointed, map_batches, packed, packed_kind
from tessera.llm.components import components

WORDS, SEED, DISTANCE = 5, 42, 4
SLICE = 1 << 14
#: Families of hashes by which ``keep_one`` links, and the bits of all in which linked texts differ at most. Texts of a similarity of
#: 0.8 differ in 78 of 512 bits on average, with a deviation of 8.
FAMILIES, WIDE_DISTANCE = 8, 86
#: The share of bits in which texts of a similarity of 0.8 agree, and how surely they share a block.
AGREE, FOUND = 0.8485, 0.98
GROUP, HOT, HOLD, BLOCK_BITS, SPLITS, DEPTH, FRONTIER, PATIENCE = 1 << 11, 1 << 15, 1 << 19, 8, 10, 4, 64, 64


def shingle_hashes(text: str | None, words: int = WORDS, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of the text's word shingles, in slices."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode().lower().split()
    if not found:
        return
    whole = b" ".join(found)
    if len(found) <= words:
        yield np.array([xxh64_intdigest(whole, seed)], np.uint64)
        return
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends]
    n = len(found) - words + 1
    for at in range(0, n, SLICE):
        to = min(n, at + SLICE)
        yield np.array([xxh64_intdigest(whole[s : e - 1], seed) for s, e in zip(starts[at:to], ends[at + words - 1 : to + words - 1], strict=True)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _remixed(h: np.ndarray, k: int) -> np.ndarray:
    """The hashes of one family as those of another; family 0 is the hashes themselves."""
    if not k:
        return h
    return _mixed(h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED, families: int = 1) -> list[int]:
    """The fingerprint of a text in each family of hashes."""
    ones, n = np.zeros((families, 64), np.int64), 0
    for h in shingle_hashes(text, words, seed):
        n += len(h)
        for k in range(families):
            ones[k] += np.unpackbits(_remixed(h, k).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n, axis=1, bitorder="little").view("<u8")[:, 0].tolist() if n else [0] * families


def fingerprints(docs: DataFrame, keep: list[str], words: int = WORDS, seed: int = SEED, text: str = "text", families: int = 1) -> DataFrame:
    """``docs``' columns ``keep`` with ``simhash_fps``, the fingerprints of each family as signed longs."""
    given = packed(docs, keep, F.col(text).alias("simhash_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), words, seed, families) for x in b.column(b.num_columns - 1)], np.uint64).ravel()
            at = pa.array(np.arange(0, len(fps) + 1, families, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(b.columns[:-1] + [pa.ListArray.from_arrays(at, pa.array(fps.view(np.int64)))], ["kept", "simhash_fps"])

    return beside(map_batches(given, run, packed_kind(given, "simhash_fps array<bigint>")), keep)


Table = tuple[int, ...]  # a mask for each family's word


def tables(n: int, distance: int = DISTANCE) -> list[int]:
    """The bit masks of the tables for ``n`` fingerprints of 64 bits."""
    for blocks in range(distance + 1, 17):
        if 64 * (blocks - distance) // blocks > math.log2(max(n, 2)) + 1:
            break
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(m for k, m in enumerate(masks) if k not in out) for out in combinations(range(blocks), distance)]


def _masks(bits: Iterable[int], families: int) -> Table:
    out = [0] * families
    for b in bits:
        out[b // 64] |= 1 << b % 64
    return tuple(out)


def _drawn(bits: list[int], width: int, families: int, seed: int) -> list[Table]:
    """As many blocks of ``width`` of the bits as find a pair with the probability FOUND, each bit used as often as any other."""
    count = math.ceil(math.log(1 - FOUND) / math.log(1 - AGREE**width))
    rnd, order, out = random.Random(seed), [], []
    while len(out) < count:
        if len(order) < width:
            order = rnd.sample(bits, len(bits))
        out.append(_masks(order[:width], families))
        order = order[width:]
    return out


def wide_tables(n: int, families: int) -> list[Table]:
    """The tables for ``n`` fingerprints of several families."""
    width = max(BLOCK_BITS, math.ceil(math.log2(max(n, 2) / GROUP)))
    return _drawn(list(range(64 * families)), width, families, SEED)


def split_tables(table: Table, distance: int) -> list[Table]:
    """The tables of one family that deal a key of ``table`` again, of the bits it leaves free; none if those are too few."""
    free = [b for b in range(64) if not table[0] >> b & 1]
    edges = [len(free) * k // (distance + 1) for k in range(distance + 2)]
    return [_masks(free[a:b], 1) for a, b in zip(edges, edges[1:], strict=False)] if len(free) > distance else []


def _forest(fps: np.ndarray, nodes: np.ndarray, distance: int, patience: int | None = None) -> Generator[tuple[np.ndarray, np.ndarray], None, np.ndarray]:
    """Links within ``distance`` that connect what the pairs within it connect, for fingerprints in rows of words.

    With ``patience`` the search ends once so many steps in a row found few. Returns the rows that it left: none of them is within
    ``distance`` of one that was reached.
    """
    open_ = np.arange(len(fps))
    queue = open_[:0]
    tree = open_.copy()  # the tree that a row is in: only links between two trees are given
    idle = 0

    def joins(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
        out: tuple[list[int], list[int]] = ([], [])
        apart = np.flatnonzero(tree[a] != tree[b])
        for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            if tree[x] != tree[y]:
                tree[tree == tree[y]] = tree[x]
                out[0].append(x)
                out[1].append(y)
        return out

    while len(open_) or len(queue):
        if not len(queue):
            if patience is not None and idle >= patience:
                break
            idle += 1
        take = FRONTIER - min(len(queue), FRONTIER)
        front, queue, open_ = np.concatenate((queue[:FRONTIER], open_[:take])), queue[FRONTIER:], open_[take:]
        # What waits in the only tree of the front needn't be compared with it.
        waiting = queue[tree[queue] != tree[front[0]]] if (tree[front] == tree[front[0]]).all() else queue
        rest = np.concatenate((front, waiting, open_))
        near = _distances(fps[front], fps[rest]) <= distance
        # Among the front itself, pairs once.
        near[:, : len(front)] &= np.triu(np.ones((len(front), len(front)), bool), 1)
        inner = near[:, : len(front)].nonzero()
        links = [joins(front[inner[0]], front[inner[1]])]
        out = near[:, len(front) :]
        found = out.any(axis=0).nonzero()[0]
        if len(found):
            # Of the others found, those reached now join the first that is near them; then what else is near joins trees.
            first, to = out[:, found].argmax(axis=0), rest[len(front) + found]
            new = found >= len(waiting)
            tree[to[new]] = tree[front[first[new]]]
            links.append((front[first[new]], to[new]))
            row, col = out[:, found].nonzero()
            also = np.unique(first[col] * FRONTIER + row)
            links.append(joins(front[also // FRONTIER], front[also % FRONTIER]))
            links.append(joins(front[first[~new]], to[~new]))
            fresh = found[new] - len(waiting)
            queue, open_ = np.concatenate((queue, open_[fresh])), np.delete(open_, fresh)
            idle = 0 if len(fresh) >= FRONTIER else idle
        a, b = (np.concatenate([np.asarray(v, np.int64) for v in x]) for x in zip(*links, strict=True))
        yield nodes[a], nodes[b]
    return open_


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)), np.uint16)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


def _words(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy().view(np.uint64).reshape(n, -1)


def _lists(words: np.ndarray) -> pa.Array:
    n, k = words.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(np.ascontiguousarray(words).view(np.int64).ravel()))


def _dealt(rows: DataFrame, found: dict[int, Table]) -> DataFrame:
    """``rows(table, key, node, simhash_fps)`` once for each table of ``found`` that splits the row's own, under a key of what agrees."""
    of: dict[int, list[int]] = {}
    for t in found:
        of.setdefault(t >> SPLITS, []).append(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                table, key, node = (part.column(k).to_numpy() for k in range(3))
                fps = _words(part.column(3), part.num_rows)
                for parent in np.unique(table).tolist():
                    own = np.flatnonzero(table == parent)
                    before = _mixed(key[own].view(np.uint64) + np.uint64(parent))
                    for t in of[parent]:
                        h = _mixed(before + np.uint64(t & (1 << 63) - 1))
                        for w, m in enumerate(found[t]):
                            if m:
                                h = _mixed((fps[own, w] & np.uint64(m)) + h * np.uint64(0x9E3779B97F4A7C15))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t)), pa.array(h.view(np.int64)), pa.array(node[own]), _lists(fps[own])], ["table", "key", "node", "simhash_fps"])

    return map_batches(rows, run, "table bigint, key bigint, node bigint, simhash_fps array<bigint>")


def _paired(rows: DataFrame, level: int) -> DataFrame:
    """``rows(table, key, node, simhash_fps)`` with each key cut into parts of about half of ``HOT``: a key for every two parts, and a row once in each of its part."""
    sizes = rows.groupBy("table", "key").agg(F.ceil(F.count("*") * 2 / min(HOT, HOLD)).alias("parts"))
    cut = rows.join(sizes, ["table", "key"]).withColumn("part", F.pmod(F.xxhash64(F.lit(level), "node"), F.col("parts")))
    # A key of one part is a group as it is.
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("part != other OR parts = 1")
    return cut.select("table", F.xxhash64(F.lit(level), "table", "key", F.least("part", "other"), F.greatest("part", "other")).alias("key"), "node", "simhash_fps")


def _search(distance: int, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows in the order of (key, table) to links, and to rows that are dealt again (if ``last``, only those of keys beyond ``HOLD``)."""
    names = ["table", "key", "a", "b", "simhash_fps"]

    def later(x: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1]), pa.array(x[2]), pa.nulls(len(x[0]), pa.int64()), _lists(x[3])], names)

    def found(links: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if links:
            a, b = (np.concatenate(v) for v in zip(*links, strict=True))
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(a), pa.array(b), pa.nulls(len(a), pa.list_(pa.int64()))], names)

    def group(x: list[np.ndarray], links: list) -> np.ndarray:
        """The links of one key's rows, and the rows left over."""
        rest = np.arange(len(x[2]))
        while len(rest):
            patience = None if last or len(rest) <= HOT else PATIENCE
            search = _forest(x[3][rest], x[2][rest], distance, patience)
            while True:
                try:
                    links.append(next(search))
                except StopIteration as end:
                    rest = rest[end.value]
                    break
            if len(rest) > HOT:
                break
        return rest

    def groups(x: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero((np.diff(x[1]) != 0) | (np.diff(x[0]) != 0)) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(x[1])]))
        many, links = ends - starts > 1, []
        for s, e in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
            rest = group([v[s:e] for v in x], links)
            if len(rest):
                yield later([v[s:e][rest] for v in x])
        yield from found(links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        # The key whose rows are too many to hold.
        large: tuple[int, int] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            new = [b.column(k).to_numpy() for k in range(3)]
            new.append(_words(b.column(3), b.num_rows))
            if large is not None:
                own = (new[0] == large[0]) & (new[1] == large[1])
                if own.any():
                    yield later([x[own] for x in new])
                if own.all():
                    continue
                new, large = [x[~own] for x in new], None
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            same = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            at = 0 if same.all() else int(len(same) - same[::-1].argmin())
            if at:
                yield from groups([x[:at] for x in held])
                held = [x[at:] for x in held]
            if len(held[0]) > HOLD:
                large = (int(held[0][0]), int(held[1][0]))
                yield later(held)
                held = None
        if held is not None:
            yield from groups(held)

    return run


def links(nodes: DataFrame, n: int, families: int = 1, distance: int = DISTANCE) -> DataFrame:
    """``(a, b)`` between the nodes of ``nodes(node, simhash_fps)``, with the components of all pairs within ``distance``.

    ``nodes`` has about ``n`` rows, all of different fingerprints.
    """
    kind = "table bigint, key bigint, a bigint, b bigint, simhash_fps array<bigint>"
    found = dict(enumerate(([(m,) for m in tables(n, distance)] if families == 1 else wide_tables(n, families)), start=1))
    rows, all_links = nodes.select(F.lit(0).cast("long").alias("table"), F.lit(0).cast("long").alias("key"), "node", "simhash_fps"), None
    dealt, level, paired = _dealt(rows, found), 0, False
    while True:
        # What agrees in so many bits, or leaves none free, isn't dealt by blocks again.
        split = families == 1 and not paired and max(found) >> SPLITS * (DEPTH - 1) == 0 and all(split_tables(t, distance) for t in found.values())
        ordered = dealt.repartition("key").sortWithinPartitions("key", "table", "node")
        got = checkpointed(map_batches(ordered, _search(distance, paired or families == 1 and not split), kind))
        own = got.where("b IS NOT NULL").select("a", "b")
        all_links = own if all_links is None else all_links.unionByName(own)
        rows = got.where("b IS NULL").select("table", "key", F.col("a").alias("node"), "simhash_fps")
        which = [r[0] for r in rows.select("table").distinct().collect()]
        if not which:
            return all_links
        level += 1
        if split:
            # A table's number and that of its split make the number of the next.
            found = {t << SPLITS | k: tuple(a | b for a, b in zip(found[t], extra, strict=True)) for t in which for k, extra in enumerate(split_tables(found[t], distance))}
            dealt = _dealt(rows, found)
        else:
            dealt, paired = _paired(rows, level), True


def classes(marked: DataFrame, distance: int = DISTANCE, families: int = 1) -> DataFrame:
    """``(simhash_fps, root, component_id)`` for ``marked(doc_id, simhash_fps)``.

    ``root`` names a component, ``component_id`` is the smallest doc_id in it. Documents with all fingerprints equal are one
    row throughout; a row's number, given once and stored, is its name.
    """
    alike = checkpointed(marked.groupBy("simhash_fps").agg(F.min("doc_id").alias("first")).withColumn("node", F.monotonically_increasing_id()))
    roots = components(links(alike.select("node", "simhash_fps"), alike.count(), families, distance))
    linked = alike.join(roots, "node")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(least, "root").select("node", "root", "component_id")
    id_ = F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("first"))
    return alike.join(named, "node", "left").select("simhash_fps", F.coalesce("root", "node").alias("root"), id_.alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """``(doc_id, simhash_fp, component_id)`` for each row of ``docs``, by one family of fingerprints."""
    marked = checkpointed(fingerprints(docs, ["doc_id"], words))
    return marked.join(classes(marked, distance), "simhash_fps").select("doc_id", F.get("simhash_fps", 0).alias("simhash_fp"), "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, distance: int | None = None, text: str = "text", families: int = FAMILIES) -> DataFrame:
    """One row of each component stays: one of its smallest id (of those, the text of the least hash; null ids come last)."""
    if distance is None:
        distance = DISTANCE if families == 1 else WIDE_DISTANCE * families // FAMILIES
    key = (F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("simhash_id"), F.xxhash64(F.lit(5), text).alias("simhash_form"))
    given = docs.select("doc_id", *key, F.col(text).alias("text"))
    marked = checkpointed(fingerprints(given, ["doc_id", "simhash_id", "simhash_form"], words, families=families))
    # Copies share their fingerprints, so they are one row before the join.
    least = marked.groupBy("simhash_fps").agg(F.min(F.struct("simhash_id", "simhash_form")).alias("k"))
    first = least.join(classes(marked, distance, families), "simhash_fps").groupBy("root").agg(F.min("k").alias("k")).select("k.*")
    alike = F.row_number().over(Window.partitionBy("simhash_id", "simhash_form").orderBy("simhash_any"))
    rows = docs.select(F.struct("*").alias("simhash_row"), *key, F.xxhash64(*docs.columns).alias("simhash_any"))
    return rows.join(first, ["simhash_id", "simhash_form"]).withColumn("simhash_n", alike).where("simhash_n = 1").select("simhash_row.*")
