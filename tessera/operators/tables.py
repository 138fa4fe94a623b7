"""Tables on pages: ruled ones from the lines that are drawn, borderless ones from where words stand.

Pages are dealt by hash, and tasks work on all rows of many whole pages at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.pages import column, counted, dense, grids, highest, islands, joined, lowest, map_pages, numbers, offsets, ranked, regions
from tessera.operators.spatial import valid_table

#: Rules within SNAP points of each other are one line, rules on a line that are as close are one rule; a rule is THIN points thick at most and SHORT long at least.
SNAP, THIN, SHORT = 3.0, 3.0, 3.0
#: Words with BASE points between their lower edges stand on one line; columns have over GUTTER points between them; a table ends at over LEADING points between lines.
BASE, GUTTER, LEADING = 3.0, 6.0, 14.0
#: A borderless table is looked for so far below its caption, so much wider, and off the page's end; it begins within START points.
DEPTH, WIDER, END, START = 260.0, 10.0, 30.0, 40.0

BOX = ["x0", "y0", "x1", "y1"]
ROWS = pa.list_(pa.list_(pa.string()))


def rules(page: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """The lines ``(page, across, at)`` that rectangles are snapped to, in this order, and the rules ``(line, lo, hi)`` on them; ``across`` for horizontal ones.

    Thin rectangles are rules, others are four. Positions that are close are one line at their mean, and rules that touch on it are one.
    """
    x0, x1, y0, y1 = np.fmin(x0, x1), np.fmax(x0, x1), np.fmin(y0, y1), np.fmax(y0, y1)
    w, h = x1 - x0, y1 - y0
    flat, upright = (h <= THIN) & (w >= h), (w <= THIN) & ~((h <= THIN) & (w >= h))
    box = ~flat & ~upright
    drawn = [(flat, True, (y0 + y1) / 2, x0, x1), (upright, False, (x0 + x1) / 2, y0, y1), (box, True, y0, x0, x1), (box, True, y1, x0, x1), (box, False, x0, y0, y1), (box, False, x1, y0, y1)]
    page, across, at, lo, hi = map(np.concatenate, zip(*((page[m], np.full(int(m.sum()), a), *(v[m] for v in own)) for m, a, *own in drawn), strict=True))
    long = hi - lo >= SHORT
    page, across, at, lo, hi = (v[long] for v in (page, across, at, lo, hi))
    line = islands(page * 2 + across, at, at, SNAP)
    n = int(line.max(initial=-1)) + 1
    piece = islands(line, lo, hi, SNAP)
    m = int(piece.max(initial=-1)) + 1
    lines = (lowest(line, n, page), lowest(line, n, across.astype(np.int64)) > 0, np.bincount(line, at, n) / np.maximum(np.bincount(line, minlength=n), 1))
    return lines, (lowest(piece, m, line), lowest(piece, m, lo), highest(piece, m, hi))


def grid(n: int, lines: tuple[np.ndarray, ...], drawn: tuple[np.ndarray, ...]) -> dict[str, np.ndarray]:
    """The slots between all lines of each of ``n`` pages, and the cells and tables that they form.

    Slots of the grid of a page's lines that no rule parts are one cell, unless they are open to the outside or form no rectangle. Cells that touch, be it at a corner, are a
    table. ``cell`` names a slot's cell, ``inner`` says whether it is one, ``table`` which of all tables an inner slot's cell is in; a page's slots have a ring about them that is outside.
    """
    page, across, at = lines
    n_y, n_x = (np.bincount(page[a], minlength=n) for a in (across, ~across))
    some = (n_y > 1) & (n_x > 1)
    rows, columns = np.where(some, n_y + 1, 0), np.where(some, n_x + 1, 0)
    off = offsets(rows * columns)
    total = int(off[-1])
    own = numbers(off[:-1][some], total)
    own = np.flatnonzero(some)[own] if total else own
    r, c = np.divmod(np.arange(total) - off[own], np.maximum(columns[own], 1))
    # Lines' places among those of their page and direction, and what a rule covers of the lines across it.
    first = np.concatenate(([0], np.flatnonzero((page[1:] != page[:-1]) | (across[1:] != across[:-1])) + 1)) if len(page) else np.zeros(0, np.int64)
    nth = np.arange(len(page)) - np.repeat(first, np.diff(np.append(first, len(page))))
    line, lo, hi = drawn
    parted = {}
    for flat in (True, False):
        mine = np.flatnonzero((across[line] == flat) & some[page[line]])
        p, others = page[line[mine]], across != flat
        a = counted(page[others], at[others], p, lo[mine] - SNAP, equal=False)
        b = counted(page[others], at[others], p, hi[mine] + SNAP, equal=True) - 1
        p, i, a, b = (v[b > a] for v in (p, nth[line[mine]], a, b))
        stride = columns if flat else rows  # walls below a slot lie by rows, those beside it by columns
        wall = np.zeros(total + 1, np.int64)
        np.add.at(wall, off[p] + i * stride[p] + a + 1, 1)
        np.add.at(wall, off[p] + i * stride[p] + b + 1, -1)
        wall = wall.cumsum()[:total] > 0
        parted[flat] = wall if flat else wall[off[own] + c * rows[own] + r]
    slot = np.arange(total)
    down, right = r < rows[own] - 1, c < columns[own] - 1
    pairs = [(slot[ok], slot[ok] + by[ok]) for ok, by in ((down & ~parted[True], columns[own]), (right & ~parted[False], np.ones(total, np.int64)))]
    cell = regions(*map(np.concatenate, zip(*pairs, strict=True)), total)
    top, left = lowest(cell, total, r), lowest(cell, total, c)
    area = (highest(cell, total, r) - top + 1) * (highest(cell, total, c) - left + 1)
    inner = (cell != cell[off[own]]) & (np.bincount(cell, minlength=total) == area)[cell]
    touch = [(slot[inner], cell[inner])]
    for ok, a, b in ((down, 0, columns[own]), (right, 0, 1), (down & right, 0, columns[own] + 1), (down & right, 1, columns[own])):
        s, t = (slot + a)[ok], (slot + b)[ok]
        both = inner[s] & inner[t]
        touch.append((s[both], t[both]))
    table = regions(*map(np.concatenate, zip(*touch, strict=True)), total)
    return {"off": off, "columns": columns, "page": own, "r": r, "c": c, "cell": cell, "top": top, "left": left, "inner": inner, "table": table, "some": some}


def ruled(primitives: DataFrame, words: DataFrame, page_area: float = 612.0 * 792.0) -> DataFrame:
    """``(doc_id, page, table_id, x0, y0, x1, y1, rows)``: the valid tables that rules draw, with the words in their cells.

    ``words(doc_id, page, ord, x0, y0, x1, y1, text)`` go to the slot that their centre is in, found among the sorted lines of the page, and so to its cell: lines of a cell
    are parted by a newline, words by a space. A cell's row and column are those of its first slot among the tops and left sides of the table's cells; a place of a row that a cell
    spans from above or from the left is null.
    """
    double = lambda names: (F.col(c).cast("double").alias(c) for c in names)
    key = (F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"))
    parts = primitives.select(*key, F.lit(False).alias("is_word"), F.lit(None).cast("long").alias("ord"), *double(BOX), F.lit(None).cast("string").alias("text"))
    parts = parts.unionByName(words.select(*key, F.lit(True).alias("is_word"), F.col("ord").cast("long").alias("ord"), *double(BOX), "text"))

    def run(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        page, is_word, n = numbers(starts, rows.num_rows), column(rows, "is_word"), len(starts)
        box = [column(rows, k) for k in BOX]
        (of, across, at), drawn = rules(page[~is_word], *(v[~is_word] for v in box))
        g = grid(n, (of, across, at), drawn)
        inner = np.flatnonzero(g["inner"])
        table, n_tables = dense(g["table"][inner])
        # A slot lies between the line of its number less one and that of its number.
        before = {flat: np.concatenate(([0], np.cumsum(np.bincount(of[across == flat], minlength=n)))) for flat in (True, False)}
        place = lambda flat, k: at[across == flat][before[flat][g["page"][inner]] + k[inner]]
        lowest_, highest_ = (lambda v: lowest(table, n_tables, v)), (lambda v: highest(table, n_tables, v))
        frame = [lowest_(place(False, g["c"] - 1)), lowest_(place(True, g["r"] - 1)), highest_(place(False, g["c"])), highest_(place(True, g["r"]))]
        # Cells by number, their rows and columns in their tables.
        cell, n_cells = dense(g["cell"][inner])
        one = lowest(cell, n_cells, inner)
        its = table[np.searchsorted(inner, one)]
        row, col = (ranked(its, g[side][g["cell"][one]]) for side in ("top", "left"))
        high, wide = (highest(its, n_tables, v) + 1 for v in (row, col))
        # Words to slots to cells.
        w = np.flatnonzero(is_word & g["some"][page])
        x, y = (box[0][w] + box[2][w]) / 2, (box[1][w] + box[3][w]) / 2
        c, r = (counted(of[across == flat], at[across == flat], page[w], v, equal=True) for flat, v in ((False, x), (True, y)))
        last_c, last_r = g["columns"][page[w]] - 1, np.diff(g["off"])[page[w]] // np.maximum(g["columns"][page[w]], 1) - 1
        slot = g["off"][page[w]] + r * g["columns"][page[w]] + c
        within = (c > 0) & (r > 0) & (c < last_c) & (r < last_r)
        within[within] &= g["inner"][slot[within]]
        w, of_cell = w[within], cell[np.searchsorted(inner, slot[within])]
        line = islands(of_cell, box[3][w], box[3][w], BASE)
        n_lines = int(line.max(initial=-1)) + 1
        texts = rows.column("text").combine_chunks().take(pa.array(w))
        lines = joined(line, n_lines, texts, " ", box[0][w], column(rows, "ord")[w])
        texts = joined(lowest(line, n_lines, of_cell), n_cells, lines, "\n", np.arange(n_lines))
        filled = grids(high, wide, offsets(high * wide)[its] + row * wide[its] + col, texts, None)
        home = g["page"][lowest(table, n_tables, inner)] if n_tables else np.zeros(0, np.int64)
        names = [rows.column(k).take(pa.array(starts[home])) for k in ("doc_id", "page")]
        number = ranked(home, np.arange(n_tables)) + 1
        return pa.table([*names, pa.array(number, pa.int32()), *map(pa.array, frame), filled.cast(ROWS)], names=["doc_id", "page", "table_id", *BOX, "rows"])

    out = map_pages(parts, run, "doc_id bigint, page int, table_id int, x0 double, y0 double, x1 double, y1 double, rows array<array<string>>")
    return out.where(valid_table(F.col("rows"), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), page_area))


def borderless(captions: DataFrame, words: DataFrame, height: float = 792.0, page_area: float = 612.0 * 792.0) -> DataFrame:
    """``(doc_id, page, ord, x0, y0, x1, y1, rows, approximate)``: for ``captions(doc_id, page, ord, x0, x1, y1)``, the valid table of three rows at least that words below form.

    Words wholly within the clip, up to ``DEPTH`` points below the caption, ``WIDER`` points wider and ``END`` points off the page's end, stand on lines by their lower edges; the
    lines from the first on, as long as no more than ``LEADING`` points part them, are the rows. Where no word of a row stands over more than ``GUTTER`` points, columns part.
    The first line must begin within ``START`` points of the caption. Such tables are approximate.
    """
    double = lambda names: (F.col(c).cast("double").alias(c) for c in names)
    key = (F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"))
    parts = captions.select(*key, F.lit(False).alias("is_word"), F.col("ord").cast("long").alias("ord"), *double(["x0"]), F.lit(None).cast("double").alias("y0"), *double(["x1", "y1"]), F.lit(None).cast("string").alias("text"))
    parts = parts.unionByName(words.select(*key, F.lit(True).alias("is_word"), F.col("ord").cast("long").alias("ord"), *double(BOX), "text"))

    def run(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        page, is_word = numbers(starts, rows.num_rows), column(rows, "is_word")
        x0, y0, x1, y1 = (column(rows, k) for k in BOX)
        caps, own = np.flatnonzero(~is_word), np.flatnonzero(is_word)
        # Every caption with every word of its page.
        n_words = np.bincount(page[own], minlength=len(starts))
        each = n_words[page[caps]]
        c = np.repeat(np.arange(len(caps)), each)
        w = own[np.arange(len(c)) - np.repeat(offsets(each)[:-1] - offsets(n_words)[page[caps]], each)]
        a = caps[c]
        inside = (x0[w] >= x0[a] - WIDER) & (x1[w] <= x1[a] + WIDER) & (y0[w] >= y1[a]) & (y1[w] <= np.minimum(y1[a] + DEPTH, height - END))
        c, w = c[inside], w[inside]
        line = islands(c, y1[w], y1[w], BASE)
        n_lines = int(line.max(initial=-1)) + 1
        run_ = islands(c, lowest(line, n_lines, y0[w])[line], highest(line, n_lines, y1[w])[line], LEADING)
        first = run_ == lowest(c, len(caps), run_)[c]
        c, w, line = c[first], w[first], line[first]
        col = islands(c, x0[w], x1[w], GUTTER)
        # Captions with words, their lines and columns from 0.
        owner, c = np.unique(c, return_inverse=True)
        c, n = c.ravel(), len(owner)
        line, col = ranked(c, line), ranked(c, col)
        high, wide = (highest(c, n, v) + 1 for v in (line, col))
        place = offsets(high * wide)[c] + line * wide[c] + col
        cell, n_cells = dense(place)
        take = lambda name, at: rows.column(name).combine_chunks().take(pa.array(at))
        texts = joined(cell, n_cells, take("text", w), " ", x0[w], column(rows, "ord")[w])
        frame = (lowest(c, n, x0[w]), lowest(c, n, y0[w]), highest(c, n, x1[w]), highest(c, n, y1[w]), y1[caps[owner]])
        filled = grids(high, wide, np.unique(place), texts, "").cast(ROWS)
        return pa.table([*(take(k, caps[owner]) for k in ("doc_id", "page", "ord")), *map(pa.array, frame), filled], names=["doc_id", "page", "ord", *BOX, "c_y1", "rows"])

    found = map_pages(parts, run, "doc_id bigint, page int, ord bigint, x0 double, y0 double, x1 double, y1 double, c_y1 double, rows array<array<string>>")
    good = (F.col("y0") - F.col("c_y1") <= START) & (F.size("rows") >= 3) & valid_table(F.col("rows"), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), page_area)
    return found.where(good).select("doc_id", "page", "ord", *BOX, "rows", F.lit(True).alias("approximate"))
