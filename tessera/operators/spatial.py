"""Boxes on pages: tables, figures and what lies in them. Every join has (doc_id, page) as equal keys."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import pages

CELL, GAP = 3.0, 2


def area(p: str = "") -> Column:
    return F.greatest(F.col(f"{p}x1") - F.col(f"{p}x0"), F.lit(0.0)) * F.greatest(F.col(f"{p}y1") - F.col(f"{p}y0"), F.lit(0.0))


def overlap(a: str, b: str) -> Column:
    """The common area of two boxes."""
    side = lambda lo, hi: F.greatest(F.least(F.col(f"{a}{hi}"), F.col(f"{b}{hi}")) - F.greatest(F.col(f"{a}{lo}"), F.col(f"{b}{lo}")), F.lit(0.0))
    return side("x0", "x1") * side("y0", "y1")


def inside(blocks: DataFrame, boxes: DataFrame) -> DataFrame:
    """Blocks whose centre lies in a box of their page."""
    b, r = blocks.alias("b"), boxes.alias("r")
    x, y = (F.col("b.x0") + F.col("b.x1")) / 2, (F.col("b.y0") + F.col("b.y1")) / 2
    same = (F.col("b.doc_id") == F.col("r.doc_id")) & (F.col("b.page") == F.col("r.page"))
    return b.join(r, same & x.between(F.col("r.x0"), F.col("r.x1")) & y.between(F.col("r.y0"), F.col("r.y1")), "left_semi")


def table_captions(tables: DataFrame, captions: DataFrame) -> DataFrame:
    """What each caption of kind Table costs each of ``tables(doc_id, page, table_id, box)``: its distance if it is above by 70 points at most, or below by 50, for 30 more."""
    t, c = tables.alias("t"), captions.alias("c")
    wide = F.least(F.col("t.x1"), F.col("c.x1")) - F.greatest(F.col("t.x0"), F.col("c.x0"))
    above, below = F.col("t.y0") - F.col("c.y1"), F.col("c.y0") - F.col("t.y1")
    cost = F.when(above.between(-6, 70), F.abs(above)).when(below.between(-6, 50), F.abs(below) + 30)
    same = (F.col("t.doc_id") == F.col("c.doc_id")) & (F.col("t.page") == F.col("c.page"))
    m = t.join(c, same & (F.col("c.kind") == "Table") & (wide >= 20) & cost.isNotNull())
    return m.select("t.doc_id", "t.page", "t.table_id", "c.ord", cost.alias("cost"), F.bround("c.y0").alias("line"), F.col("c.x0").alias("left"))


def match_once(costs: DataFrame) -> DataFrame:
    """One caption a table and one table a caption: tables choose in their order, and of captions that cost the same the first on the page.

    A fold over the tables of a page, whose state is the captions that are taken.
    """
    offer = F.array_sort(F.collect_list(F.struct("cost", "line", "left", "ord")))
    asked = costs.groupBy("doc_id", "page", "table_id").agg(offer.alias("offers"))
    pages = asked.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("table_id", "offers"))).alias("tables"))

    def choose(done: Column, t: Column) -> Column:
        free = F.get(F.filter(t["offers"], lambda o: ~F.exists(done, lambda d: d["ord"] == o["ord"])), F.lit(0))
        return F.when(free.isNull(), done).otherwise(F.concat(done, F.array(F.struct(t["table_id"].alias("table_id"), free["ord"].alias("ord"), free["cost"].alias("cost")))))

    kind = f"array<struct<table_id:{costs.schema['table_id'].dataType.simpleString()},ord:{costs.schema['ord'].dataType.simpleString()},cost:double>>"
    chosen = F.aggregate("tables", F.array().cast(kind), choose)
    return pages.select("doc_id", "page", F.explode(chosen).alias("x")).select("doc_id", "page", "x.*")


def best_caption(costs: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id", "page", "table_id").orderBy("cost", "line", "left", "ord")
    return costs.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "line", "left")


def valid_table(rows: Column, box_area: Column, page_area: float) -> Column:
    """At least two rows and columns, 35 % of cells filled, no more than 75 % of the page, no cell over 400 characters."""
    cells = F.flatten(rows)
    filled = F.size(F.filter(cells, lambda c: F.coalesce(F.trim(c) != "", F.lit(False)))) / F.greatest(F.size(cells), F.lit(1))
    wide = F.array_max(F.transform(rows, F.size)) >= 2
    return (F.size(rows) >= 2) & wide & (filled >= 0.35) & (box_area <= 0.75 * page_area) & ~F.exists(cells, lambda c: F.coalesce(F.length(c) > 400, F.lit(False)))


def markdown(rows: Column, most: int = 80) -> Column:
    """An array of rows as a Markdown table; ragged rows are filled, bars escaped, rows over ``most`` counted."""
    bar = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    clean = F.transform(F.slice(rows, 1, most), lambda r: F.transform(r, lambda c: F.trim(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|")))))
    n = F.array_max(F.transform(clean, F.size))
    full = F.transform(clean, lambda r: F.concat(r, F.array_repeat(F.lit(""), n - F.size(r))))
    rest = F.when(F.size(rows) > most, F.array(F.concat(F.lit("| ... "), (F.size(rows) - most).cast("string"), F.lit(" more rows omitted ... |"), F.repeat(F.lit(" |"), n - 1)))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.array(bar(F.get(full, F.lit(0))), bar(F.array_repeat(F.lit("---"), n))), F.transform(F.slice(full, F.lit(2), F.greatest(F.size(full) - 1, F.lit(0))), bar), rest)
    return F.when(F.size(rows) > 0, F.array_join(lines, "\n")).otherwise("")


def clip(pad: float, width: float, height: float, dpi: float, longest: float = 2000.0) -> Column:
    """The region to render for a box and its zoom, the longest side at most ``longest`` pixels."""
    x0, y0 = F.greatest(F.col("x0") - pad, F.lit(0.0)), F.greatest(F.col("y0") - pad, F.lit(0.0))
    x1, y1 = F.least(F.col("x1") + pad, F.lit(width)), F.least(F.col("y1") + pad, F.lit(height))
    zoom = F.least(F.lit(dpi / 72), F.lit(longest) / F.greatest(x1 - x0, y1 - y0, F.lit(1.0)))
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), zoom.alias("zoom"))


#: Pages of up to so many rectangles compare them in pairs, others mark a grid, whose cost is then small for each rectangle.
FEW = 64


def clusters(primitives: DataFrame, width: float = 612.0, height: float = 792.0) -> DataFrame:
    """Boxes around drawn rectangles that touch once each is widened by GAP cells of CELL points, at least 40 points wide and 30 high.

    The widened rectangles cover cells of a grid over the page; covered cells that share an edge are one region, and a rectangle is of the region of its centre's cell.
    """
    h, w = math.ceil(height / CELL) + 3, math.ceil(width / CELL) + 3
    lo = lambda v: np.maximum(np.trunc(v / CELL).astype(int) - GAP, 0)
    hi = lambda v, most: np.maximum(np.minimum(np.trunc(v / CELL).astype(int) + GAP + 1, most), 0)
    at = lambda v, most: np.clip(np.trunc(v / CELL).astype(int), 0, most - 1)

    def on_grid(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The region of each rectangle of a page of many, -1 if its centre is in none."""
        edges = np.zeros((h + 1, w + 1), int)  # each rectangle adds one between its corners once summed up
        some = (x1 > x0) & (y1 > y0)
        for b, a, by in ((y0, x0, 1), (y1, x1, 1), (y0, x1, -1), (y1, x0, -1)):
            np.add.at(edges, (b[some], a[some]), by)
        full = edges.cumsum(axis=0).cumsum(axis=1)[:h, :w] > 0
        # Runs of covered cells in a row of the grid are nodes; runs that meet in the next row are connected.
        begins = full.copy()
        begins[:, 1:] &= ~full[:, :-1]
        run = begins.cumsum().reshape(h, w) - 1
        meet = full[:-1] & full[1:]
        region = pages.regions(run[:-1][meet], run[1:][meet], int(begins.sum()))
        return np.where(full[y, x], region[run[y, x]], -1)

    def group(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        n, box = rows.num_rows, [pages.column(rows, k) for k in ("x0", "y0", "x1", "y1")]
        x0, y0, x1, y1 = lo(box[0]), lo(box[1]), hi(box[2], w), hi(box[3], h)
        x, y = at((box[0] + box[2]) / 2, w), at((box[1] + box[3]) / 2, h)
        page, size = pages.numbers(starts, n), np.diff(np.append(starts, n))
        # Rectangles that overlap or share an edge are of one region, whose name is its first rectangle's number.
        few = np.flatnonzero(size[page] <= FEW)
        a = np.repeat(few, size[page[few]])
        b = np.arange(len(a)) - np.repeat(pages.offsets(size[page[few]])[:-1] - starts[page[few]], size[page[few]])
        wide, high = np.minimum(x1[a], x1[b]) - np.maximum(x0[a], x0[b]), np.minimum(y1[a], y1[b]) - np.maximum(y0[a], y0[b])
        some = (x1 > x0) & (y1 > y0)
        meet = (((wide > 0) & (high >= 0)) | ((wide >= 0) & (high > 0))) & some[a] & some[b]
        least = pages.regions(a[meet], b[meet], n)
        over = some[b] & (x0[b] <= x[a]) & (x[a] < x1[b]) & (y0[b] <= y[a]) & (y[a] < y1[b])
        region = np.full(n, -1)
        region[a[over]] = least[b[over]]
        for p in np.flatnonzero(size > FEW).tolist():
            own = slice(starts[p], starts[p] + size[p])
            found = on_grid(*(v[own] for v in (x0, y0, x1, y1, x, y)))
            _, first, inverse = np.unique(found, return_index=True, return_inverse=True)
            region[own] = np.where(found < 0, -1, starts[p] + first[inverse.ravel()])
        own = np.flatnonzero(region >= 0)
        first, region = np.unique(region[own], return_inverse=True)
        region, m = region.ravel(), len(first)
        left, top, right, bottom = (f(region, m, v[own]) for f, v in zip((pages.lowest, pages.lowest, pages.highest, pages.highest), box, strict=True))
        large = np.flatnonzero((right - left >= 40) & (bottom - top >= 30))
        key = [rows.column(k).take(pa.array(first[large])) for k in pages.KEY]
        return pa.table([*key, *(pa.array(v[large]) for v in (left, top, right, bottom, np.bincount(region, minlength=m)))], names=[*pages.KEY, "x0", "y0", "x1", "y1", "n"])

    given = primitives.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    return pages.map_pages(given, group, "doc_id bigint, page int, x0 double, y0 double, x1 double, y1 double, n bigint")


def graphic_filter(width: float = 612.0, height: float = 792.0) -> Column:
    """Primitives of a size that a figure has; page-wide rules and backgrounds are none."""
    a, page = area(), width * height
    image = (F.col("prim_kind") == "image") & (a > 25) & (a <= 0.85 * page)
    rule = (F.col("x1") - F.col("x0") > 0.9 * width) & (F.col("y1") - F.col("y0") < 4)
    return image | ((F.col("prim_kind") == "drawing") & ~rule & (a <= 0.7 * page))


def covered(primitives: DataFrame, boxes: DataFrame, most: float = 0.5) -> DataFrame:
    """``primitives(prim_id, ...)`` that no box covers by more than ``most``."""
    p, b = primitives, boxes
    q = p.select("doc_id", "page", *(F.col(c).alias(f"p_{c}") for c in ("x0", "y0", "x1", "y1")), "prim_id").join(b.select("doc_id", "page", *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1"))), ["doc_id", "page"])
    return p.join(q.where(overlap("p_", "b_") > most * F.greatest(area("p_"), F.lit(1.0))).select("prim_id"), "prim_id", "left_anti")


def hit(rects: Column, x: float, y: float) -> Column:
    return F.exists(rects, lambda r: (r["x0"] <= x) & (r["x1"] >= x) & (r["y0"] <= y) & (r["y1"] >= y))


def continued_captions(blocks: DataFrame, starts: DataFrame, most: int = 3) -> DataFrame:
    """``starts(doc_id, page, ord)``, captions, with what follows of them: ``(doc_id, page, ord, box, text, n_joined)``.

    Blocks go by rounded top and left edge. Up to ``most`` blocks after a caption go on with it, until the first that doesn't: one goes on if it begins 0 to
    under 5 points below what the caption covers so far, within 8 points of the caption block's left edge, no larger in type by over 0.3, and the text so far doesn't end a sentence or the caption
    is of three words at most. A block that goes on with a caption begins none. A fold over the blocks of a page, whose state is the caption that grows.
    """
    marked = blocks.join(starts.select("doc_id", "page", "ord", F.lit(True).alias("is_start")), ["doc_id", "page", "ord"], "left").withColumn("is_start", F.coalesce("is_start", F.lit(False)))
    page = marked.join(starts.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")
    block = F.struct(F.bround("y0").alias("line"), *(F.col(c) for c in ("x0", "ord", "y0", "x1", "y1", "text", "size", "is_start")))
    pages = page.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    ord_type = blocks.schema["ord"].dataType.simpleString()
    kind = f"struct<ord:{ord_type},x0:double,y0:double,x1:double,y1:double,text:string,left:double,size:double,words:int,seen:int,n_joined:int,open:boolean>"
    d = lambda c: c.cast("double")

    def new(b: Column) -> Column:
        n = T.word_count(b["text"]).cast("int")
        return F.struct(b["ord"], d(b["x0"]), d(b["y0"]), d(b["x1"]), d(b["y1"]), b["text"], d(b["x0"]), d(b["size"]), n, F.lit(0), F.lit(0), F.lit(True)).cast(kind)

    def step(found: Column, b: Column) -> Column:
        own = F.element_at(found, -1)
        gap = b["y0"] - own["y1"]
        unfinished = ~F.rtrim(own["text"]).rlike("[.!?]$")
        goes_on = own["open"] & (own["seen"] < most) & (F.abs(b["x0"] - own["left"]) < 8) & (gap >= 0) & (gap < 5) & (b["size"] <= own["size"] + 0.3) & (unfinished | (own["words"] <= 3))
        grown = F.struct(
            own["ord"], F.least(own["x0"], d(b["x0"])), F.least(own["y0"], d(b["y0"])), F.greatest(own["x1"], d(b["x1"])), F.greatest(own["y1"], d(b["y1"])),
            F.concat(own["text"], F.lit(" "), b["text"]), own["left"], own["size"], own["words"], own["seen"] + 1, own["n_joined"] + 1, F.lit(True),
        ).cast(kind)
        shut = own.withField("open", F.lit(False))
        before = F.slice(found, F.lit(1), F.size(found) - 1)
        return (
            F.when((F.size(found) > 0) & goes_on, F.concat(before, F.array(grown)))
            .when(b["is_start"], F.concat(found, F.array(new(b))))
            .when(F.size(found) > 0, F.concat(before, F.array(shut)))
            .otherwise(found)
        )

    folded = F.aggregate("blocks", F.array().cast(f"array<{kind}>"), step)
    return pages.select("doc_id", "page", F.explode(folded).alias("c")).select("doc_id", "page", *(f"c.{c}" for c in ("ord", "x0", "y0", "x1", "y1")), T.collapse(F.col("c.text")).alias("text"), "c.n_joined")


def first_pick(captions: DataFrame, regions: DataFrame, above: float = 140.0, below: float = 60.0) -> DataFrame:
    """``(doc_id, page, ord, x0, y0, x1, y1, direction)``: the region that a figure's caption takes first, while none is taken.

    A region must share over 40 % of the narrower width with the caption widened by 30 points a side. Those that end above the caption go before those that begin below,
    even if the nearest of them is too far, and then the caption has no region; of equals the first by box.
    """
    c = captions.select("doc_id", "page", "ord", *(F.col(k).alias(f"c_{k}") for k in ("x0", "y0", "x1", "y1")))
    r = regions.select("doc_id", "page", "x0", "y0", "x1", "y1").join(c, ["doc_id", "page"])
    lo, hi = F.col("c_x0") - 30, F.col("c_x1") + 30
    wide = F.least("x1", hi) - F.greatest("x0", lo) > 0.4 * F.least(F.col("x1") - F.col("x0"), hi - lo)
    direction = F.when(F.col("y1") <= F.col("c_y0") + 6, "up").when(F.col("y0") >= F.col("c_y1") - 6, "down")
    near = r.where(wide).withColumn("direction", direction).where("direction IS NOT NULL")
    gap = F.when(F.col("direction") == "up", F.col("c_y0") - F.col("y1")).otherwise(F.col("y0") - F.col("c_y1"))
    best = near.groupBy("doc_id", "page", "ord").agg(F.min(F.struct(F.when(F.col("direction") == "up", 0).otherwise(1).alias("side"), gap.alias("gap"), "x0", "y0", "x1", "y1", "direction")).alias("b"))
    return best.where(F.col("b.gap") <= F.when(F.col("b.direction") == "up", above).otherwise(below)).select("doc_id", "page", "ord", *(f"b.{k}" for k in ("x0", "y0", "x1", "y1", "direction")))


#: What a figure takes in: regions that are within JOIN points of its box, and short blocks within EDGE points of it.
JOIN, EDGE, FIGURE_TEXT = 30.0, 4.0, 40


def located_figures(captions: DataFrame, regions: DataFrame, blocks: DataFrame | None = None, width: float = 612.0, height: float = 792.0, above: float = 140.0, below: float = 60.0) -> DataFrame:
    """The box of each figure caption and the text in it: ``(doc_id, page, ord, label, x0, y0, x1, y1, absorbed)``, no box if there is none.

    Captions of a page take regions from top to bottom, each region once: the first as in ``first_pick``, then, over and over, those on the same side within ``JOIN`` points of the box.
    Two passes over ``blocks(doc_id, page, ord, pos, x0, y0, x1, y1, text, role)`` in reading order take in body text of under 25 words and 60 points
    that touches the box widened by ``EDGE`` points, axis labels and legends, and the box grows with each; ``absorbed`` are their numbers. The box ends at the page's edges.
    """
    box = ["x0", "y0", "x1", "y1"]
    part = lambda df, what, **more: df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), F.lit(what).alias("what"), *(F.col(k).cast("double").alias(k) for k in box), *(more.get(k, F.lit(None)).cast(t).alias(k) for k, t in (("ord", "long"), ("place", "long"), ("label", "string"))))
    parts = part(captions, "caption", ord=F.col("ord"), label=F.col("label")).unionByName(part(regions, "region"))
    if blocks is not None:
        short = blocks.where((F.col("role") == "body") & (T.word_count(F.col("text")) < 25) & (F.col("y1") - F.col("y0") < 60))
        parts = parts.unionByName(part(short, "text", ord=F.col("ord"), place=F.col("pos")))
    parts = parts.join(captions.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")

    def grown(b: list[float], *more: list[float]) -> list[float]:
        return [min(b[0], *(m[0] for m in more)), min(b[1], *(m[1] for m in more)), max(b[2], *(m[2] for m in more)), max(b[3], *(m[3] for m in more))]

    def run(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        what, ords, place, label = (rows.column(k).to_pylist() for k in ("what", "ord", "place", "label"))
        boxes = np.stack([pages.column(rows, k) for k in box], axis=1)
        corners, out = boxes.tolist(), []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows], strict=True):
            out += of_page({k: [n for n in range(s, e) if what[n] == k] for k in ("caption", "region", "text")}, boxes, corners, ords, place, label)
        at, *own, absorbed = zip(*out, strict=True) if out else [()] * 8
        kinds = [pa.int64(), pa.string(), *[pa.float64()] * 4]
        key = [rows.column(k).take(pa.array(at, pa.int64())) for k in pages.KEY]
        return pa.table([*key, *(pa.array(v, t) for v, t in zip(own, kinds, strict=True)), pa.array(absorbed, pa.list_(pa.int64()))], names=[*pages.KEY, "ord", "label", *box, "absorbed"])

    def of_page(parts: dict[str, list[int]], boxes: np.ndarray, corners: list, ords: list, place: list, label: list) -> list[tuple]:
        left = boxes[sorted(parts["region"], key=corners.__getitem__)]
        texts = sorted(parts["text"], key=lambda n: (place[n], ords[n]))
        free, out = dict.fromkeys(texts), []
        for c in sorted(parts["caption"], key=lambda n: (corners[n][1], corners[n][0], ords[n])):
            x0, y0, x1, y1 = corners[c]
            lo, hi = x0 - 30, x1 + 30
            wide = np.minimum(left[:, 2], hi) - np.maximum(left[:, 0], lo) > 0.4 * np.minimum(left[:, 2] - left[:, 0], hi - lo)
            up, down = wide & (left[:, 3] <= y0 + 6), wide & (left[:, 1] >= y1 - 6)
            above_it = bool(up.any())
            pool, gap, most = (np.flatnonzero(up), y0 - left[:, 3], above) if above_it else (np.flatnonzero(down), left[:, 1] - y1, below)
            own, absorbed = [None] * 4, []
            if len(pool) and (gap[pool] <= most).any():
                members = pool[[np.argmin(gap[pool])]]
                own = left[members[0]].tolist()
                while True:
                    rest = pool[~np.isin(pool, members)]
                    r = left[rest]
                    near = rest[(r[:, 1] - own[3] < JOIN) & (r[:, 3] > own[1] - JOIN) & (r[:, 0] - own[2] < JOIN) & (r[:, 2] > own[0] - JOIN)]
                    if not len(near):
                        break
                    members = np.append(members, near)
                    own = grown(own, *left[near].tolist())
                left = np.delete(left, members, axis=0)
                for _ in range(2):
                    for k in list(free):
                        b = corners[k]
                        touches = min(b[2], own[2] + EDGE) > max(b[0], own[0] - EDGE) and min(b[3], own[3] + EDGE) > max(b[1], own[1] - EDGE)
                        if touches and (b[3] <= y0 + 2 or not above_it):
                            own = grown(own, b)
                            del free[k]
                            absorbed.append(ords[k])
                # Texts whose centre is in the box are the figure's too.
                free = {k: None for k in free if not (own[0] <= (corners[k][0] + corners[k][2]) / 2 <= own[2] and own[1] <= (corners[k][1] + corners[k][3]) / 2 <= own[3])}
                own = [max(own[0], 0.0), max(own[1], 0.0), min(own[2], width), min(own[3], height)]
            out.append((c, ords[c], label[c], *own, absorbed))
        return out

    return pages.map_pages(parts, run, "doc_id bigint, page int, ord bigint, label string, x0 double, y0 double, x1 double, y1 double, absorbed array<bigint>")


def figure_text(blocks: DataFrame, figures: DataFrame) -> DataFrame:
    """``blocks`` with role ``figure_text`` for body text that a figure absorbed, or of under ``FIGURE_TEXT`` words with its centre in a figure's box."""
    absorbed = figures.select("doc_id", "page", F.explode("absorbed").alias("ord"))
    short = blocks.where((F.col("role") == "body") & (T.word_count(F.col("text")) < FIGURE_TEXT))
    within = inside(short, figures.where("x0 IS NOT NULL")).select("doc_id", "page", F.col("ord").cast("long").alias("ord"))
    taken = absorbed.unionByName(within).distinct().withColumn("taken", F.lit(True))
    named = blocks.join(taken, ["doc_id", "page", "ord"], "left")
    return named.withColumn("role", F.when((F.col("role") == "body") & F.col("taken"), "figure_text").otherwise(F.col("role"))).drop("taken")
