"""Work on pages is dealt to as many tasks as there are, however few bytes the pages have, and is the plain one."""

import random

from pyspark.sql import functions as F

from tessera.operators import spatial, tables

BOX = "x0 double, y0 double, x1 double, y1 double"


def boxes(spark, pages):
    return spark.range(pages).select(F.col("id").alias("doc_id"), F.lit(0).alias("page"), F.lit(0).alias("ord"), F.lit(60.0).alias("x0"), F.lit(100.0).alias("y0"), F.lit(300.0).alias("x1"), F.lit(200.0).alias("y1"), F.lit("x").alias("text"), F.lit("Figure 1").alias("label"))


def test_clusters_and_figures_use_all_tasks(spark):
    b = boxes(spark, 400)
    assert spatial.clusters(b).rdd.getNumPartitions() >= 4
    assert spatial.located_figures(b, b).rdd.getNumPartitions() >= 4


def test_tables_use_all_tasks(spark):
    b = boxes(spark, 400)
    assert tables.ruled(b, b).rdd.getNumPartitions() >= 4
    assert tables.borderless(b, b).rdd.getNumPartitions() >= 4


def plain_clusters(rects):
    cells = lambda r: (max(int(r[0] / 3) - 2, 0), max(int(r[1] / 3) - 2, 0), int(r[2] / 3) + 3, int(r[3] / 3) + 3)
    full = {(x, y) for r in rects for x0, y0, x1, y1 in [cells(r)] for x in range(x0, min(x1, 207)) for y in range(y0, min(y1, 267))}
    region = {}
    for start in full:
        todo = [start] if start not in region else []
        while todo:
            x, y = at = todo.pop()
            if at in full and at not in region:
                region[at] = start
                todo += [(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]
    own = {}
    for r in rects:
        own.setdefault(region[int((r[0] + r[2]) / 2 / 3), int((r[1] + r[3]) / 2 / 3)], []).append(r)
    found = [(min(r[0] for r in g), min(r[1] for r in g), max(r[2] for r in g), max(r[3] for r in g), len(g)) for g in own.values()]
    return sorted(f for f in found if f[2] - f[0] >= 40 and f[3] - f[1] >= 30)


def test_clusters_of_few_and_of_many_are_the_plain_ones(spark):
    rnd = random.Random(3)
    box = lambda: (lambda x, y: (x, y, x + rnd.choice([5.0, 30.0, 60.0]), y + rnd.choice([4.0, 20.0, 50.0])))(rnd.uniform(0, 540), rnd.uniform(0, 730))
    pages = [[box() for _ in range(n)] for n in (1, 5, 12, 25, 40, 64, 65, 90, 150)]
    got = spatial.clusters(spark.createDataFrame([(n, 0, *r) for n, p in enumerate(pages) for r in p], f"doc_id long, page int, {BOX}")).collect()
    for n, p in enumerate(pages):
        assert sorted((r["x0"], r["y0"], r["x1"], r["y1"], r["n"]) for r in got if r["doc_id"] == n) == plain_clusters(p)
