"""Tables from rules and from words, against plain programs."""

import random

from pyspark.sql import functions as F

from tessera.operators import tables

BOX = "x0 double, y0 double, x1 double, y1 double"


def plain_ruled(xs, ys, walls_below, walls_beside, words):
    """Rows of texts by flooding a grid of slots: ``walls_below[r][c]`` parts slot (r - 1, c) from (r, c), ``walls_beside[r][c]`` parts (r, c - 1) from (r, c)."""
    n, m = len(ys) - 1, len(xs) - 1
    cell = {}

    def flood(start):
        seen, todo, outside = {start}, [start], False
        while todo:
            r, c = todo.pop()
            for k, wall in (((r - 1, c), walls_below[r][c]), ((r + 1, c), walls_below[r + 1][c]), ((r, c - 1), walls_beside[r][c]), ((r, c + 1), walls_beside[r][c + 1])):
                if wall:
                    continue
                if not (0 <= k[0] < n and 0 <= k[1] < m):
                    outside = True
                elif k not in seen:
                    seen.add(k)
                    todo.append(k)
        return seen, outside

    for r in range(n):
        for c in range(m):
            if (r, c) not in cell:
                seen, outside = flood((r, c))
                area = (max(r for r, _ in seen) - min(r for r, _ in seen) + 1) * (max(c for _, c in seen) - min(c for _, c in seen) + 1)
                cell |= {k: None if outside or len(seen) != area else min(seen) for k in seen}
    groups = []
    for f in sorted({f for f in cell.values() if f}):
        corners = {(r + a, c + b) for r, c in cell if cell[r, c] == f for a in (0, 1) for b in (0, 1)}
        met = [g for g in groups if g[1] & corners]
        groups = [g for g in groups if g not in met] + [([f] + [x for g in met for x in g[0]], corners.union(*(g[1] for g in met)))]
    return [plain_rows(xs, ys, cell, sorted(g[0]), words) for g in groups]


def plain_rows(xs, ys, cell, firsts, words):
    tops = sorted({min(r for r, c in cell if cell[r, c] == f) for f in firsts})
    lefts = sorted({min(c for r, c in cell if cell[r, c] == f) for f in firsts})
    rows = [[None] * len(lefts) for _ in tops]
    for f in firsts:
        own = [k for k in cell if cell[k] == f]
        inside = [w for w in words if any(xs[c] <= (w[0] + w[2]) / 2 < xs[c + 1] and ys[r] <= (w[1] + w[3]) / 2 < ys[r + 1] for r, c in own)]
        lines = sorted({w[3] for w in inside})
        text = "\n".join(" ".join(w[4] for w in sorted(inside) if w[3] == y) for y in lines)
        rows[tops.index(min(r for r, _ in own))][lefts.index(min(c for _, c in own))] = text
    return rows


def made_table(rnd, merged):
    """A grid whose rules are drawn in random pieces, some left out, with words in most slots."""
    n, m = rnd.randint(2, 5), rnd.randint(2, 5)
    xs, ys = [60.0 + 70 * k for k in range(m + 1)], [100.0 + 40 * k for k in range(n + 1)]
    below, beside = [[True] * m for _ in range(n + 1)], [[True] * (m + 1) for _ in range(n)]
    for _ in range(merged):
        r, c = rnd.randrange(n), rnd.randrange(m)
        if rnd.random() < 0.5 and r > 0:
            below[r][c] = False
        elif c > 0:
            beside[r][c] = False
    drawn, near = [], lambda: rnd.choice([-0.6, 0.0, 0.5])
    for r in range(n + 1):
        for c in range(m):
            if below[r][c]:
                y = ys[r] + near()
                drawn.append((xs[c] - 1, y, xs[c + 1] + 1, y + rnd.choice([0.0, 0.7])))
    for r in range(n):
        for c in range(m + 1):
            if beside[r][c]:
                x = xs[c] + near()
                drawn.append((x, ys[r + 1], x, ys[r]) if rnd.random() < 0.3 else (x, ys[r] - 1, x + 0.5, ys[r + 1] + 1))
    words = [(xs[c] + 5 + 20 * k, ys[r] + 4 + 15 * line, xs[c] + 18 + 20 * k, ys[r] + 14 + 15 * line, f"w{r}{c}{line}{k}") for r in range(n) for c in range(m) if rnd.random() < 0.9 for line in range(rnd.choice([1, 2])) for k in range(2)]
    return xs, ys, below, beside, drawn, words


def test_ruled_tables_are_the_plain_ones(spark):
    rnd = random.Random(11)
    made = [made_table(rnd, merged) for merged in [0, 0, 0, 0, *range(1, 5)] * 3]
    drawn = [(i, 0, *p) for i, t in enumerate(made) for p in t[4]]
    words = [(i, 0, k, *w) for i, t in enumerate(made) for k, w in enumerate(t[5])]
    found = tables.ruled(spark.createDataFrame(drawn, f"doc_id long, page int, {BOX}"), spark.createDataFrame(words, f"doc_id long, page int, ord int, {BOX}, text string"))
    got = found.collect()
    valid = 0
    for i, (xs, ys, below, beside, _, words_) in enumerate(made):
        good = lambda rows: len(rows) >= 2 and len(rows[0]) >= 2 and sum(bool(c) for r in rows for c in r) >= 0.35 * len(rows) * len(rows[0])
        want = [rows for rows in plain_ruled(xs, ys, below, beside, words_) if good(rows)]
        valid += len(want)
        assert sorted(map(repr, want)) == sorted(repr(r["rows"]) for r in got if r["doc_id"] == i)
        for r in got:
            if r["doc_id"] == i and i % 8 < 4:
                assert max(abs(a - b) for a, b in zip((r["x0"], r["y0"], r["x1"], r["y1"]), (xs[0], ys[0], xs[-1], ys[-1]), strict=True)) < 1
    assert valid >= 20 and any(c is None for r in got for row in r["rows"] for c in row)


def test_two_tables_and_a_figure(spark):
    """Tables apart are two; a frame with one cell, an open grid and a plot's axes are none; boxes drawn as cells are a table."""
    box = lambda d, x, y, w=50, h=20: [(d, 0, x, y, x + w, y + h)]
    drawn = [b for r in range(3) for c in range(2) for b in box(1, 60.0 + 50 * c, 100.0 + 20 * r) + box(1, 300.0 + 50 * c, 400.0 + 20 * r)]
    drawn += box(2, 60.0, 100.0, 200, 100) + [(3, 0, 60.0, 100.0, 60.0, 300.0), (3, 0, 60.0, 300.0, 300.0, 300.0), (3, 0, 60.0, 200.0, 300.0, 200.0)]
    words = [(1, 0, k, x + 5, y + 5, x + 30, y + 15, f"{x:.0f}-{y:.0f}") for k, (x, y) in enumerate([(60.0 + 50 * c, 100.0 + 20 * r) for r in range(3) for c in range(2)] + [(300.0, 400.0), (350.0, 420.0), (300.0, 440.0)])]
    words += [(d, 0, 0, 70.0, 110.0, 90.0, 120.0, "x") for d in (2, 3)]
    d = spark.createDataFrame(drawn, f"doc_id long, page int, {BOX}").withColumn("text", F.lit("another column"))
    got = tables.ruled(d, spark.createDataFrame(words, f"doc_id long, page int, ord int, {BOX}, text string")).orderBy("y0").collect()
    assert [(r["doc_id"], r["x0"], r["y1"], r["rows"][0], r["rows"][1]) for r in got] == [(1, 60.0, 160.0, ["60-100", "110-100"], ["60-120", "110-120"]), (1, 300.0, 460.0, ["300-400", ""], ["", "350-420"])]
    assert len({r["table_id"] for r in got}) == 2
    assert tables.ruled(d.where("doc_id > 9"), d.select("doc_id", "page", F.lit(0).alias("ord"), "x0", "y0", "x1", "y1", "text")).count() == 0


def plain_borderless(cap, words):
    x0, x1, y = cap
    inside = sorted((w[3], w[0], w) for w in words if w[0] >= x0 - 10 and w[2] <= x1 + 10 and w[1] >= y and w[3] <= min(y + 260, 762))
    lines = []
    for *_, w in inside:
        if lines and w[3] - max(v[3] for v in lines[-1]) <= 3:
            lines[-1].append(w)
        else:
            lines.append([w])
    if not lines or min(w[1] for w in lines[0]) - y > 40:
        return None
    kept = lines[:1]
    for line in lines[1:]:
        if min(w[1] for w in line) - max(w[3] for k in kept for w in k) > 14:
            break
        kept.append(line)
    edges = []
    for w in sorted(w for k in kept for w in k):
        if edges and w[0] - edges[-1][1] <= 6:
            edges[-1][1] = max(edges[-1][1], w[2])
        else:
            edges.append([w[0], w[2]])
    rows = [[" ".join(w[4] for w in sorted(line) if lo <= w[0] <= hi) for lo, hi in edges] for line in kept]
    cells = [c for r in rows for c in r]
    return rows if len(rows) >= 3 and len(edges) >= 2 and sum(map(bool, cells)) >= 0.35 * len(cells) else None


def test_borderless_tables_are_the_plain_ones(spark):
    rnd = random.Random(12)
    caps, words = {}, {}
    for i in range(60):
        caps[i] = (60.0, 60.0 + rnd.choice([200, 300]), 100.0)
        n, m, top = rnd.randint(1, 6), rnd.randint(1, 4), 100.0 + rnd.choice([5, 20, 45])
        words[i] = [(70.0 + 75 * c + rnd.randint(0, 12) + 25 * k, top + 18 * r + rnd.choice([0, 1]), 70.0 + 75 * c + 25 * k + rnd.choice([20, 24, 45]), top + 18 * r + 10 + rnd.choice([0, 1.5]), f"{r}{c}{k}") for r in range(n) for c in range(m) for k in range(rnd.choice([1, 1, 2])) if rnd.random() < 0.85]
        words[i] += [(60.0, top + 18 * n + 30, 300.0, top + 18 * n + 40, "body text")]
    c = spark.createDataFrame([(i, 0, 7, *v) for i, v in caps.items()], "doc_id long, page int, ord int, x0 double, x1 double, y1 double")
    w = spark.createDataFrame([(i, 0, k, *v) for i, own in words.items() for k, v in enumerate(own)], f"doc_id long, page int, ord int, {BOX}, text string")
    got = {r["doc_id"]: r["rows"] for r in tables.borderless(c, w).collect()}
    want = {i: rows for i in caps if (rows := plain_borderless(caps[i], words[i]))}
    assert got == want and len(want) > 8
