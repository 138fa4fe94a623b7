"""The trees of the url filter: each split against a plain program, and accuracy on urls held out."""

import math
import random

from pyspark.sql import functions as F

from tessera.llm import queries, url_filter


def plain_tree(rows, cuts, depth):
    """The splits that gain most, by sums over all rows for every leaf, feature and cut."""
    unit, l2 = url_filter.UNIT, url_filter.L2 * url_filter.UNIT

    def grads(r):
        p = 1 / (1 + math.exp(-r["margin"]))
        half_up = lambda x: math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1)
        return half_up((r["url_label"] - p) * unit) * r["url_weight"], half_up(p * (1 - p) * unit) * r["url_weight"]

    def grow(part, level):
        tg, th = (sum(grads(r)[k] for r in part) for k in (0, 1))
        best = None
        for f, name in enumerate(url_filter.FEATURES) if level < depth and part else ():
            for b, cut in enumerate(cuts[name]):
                left = [r for r in part if r["bins"][f] <= b]
                lg, lh = (sum(grads(r)[k] for r in left) for k in (0, 1))
                gain = lg * lg / (lh + l2) + (tg - lg) ** 2 / (th - lh + l2) - tg * tg / (th + l2)
                if gain > 1e-3 * unit and (best is None or gain > best[0]):
                    best = gain, f, b, cut
        if best:
            _, f, b, cut = best
            return url_filter.FEATURES[f], cut, grow([r for r in part if r["bins"][f] <= b], level + 1), grow([r for r in part if r["bins"][f] > b], level + 1)
        return round(url_filter.RATE * tg / (th + l2), 9)

    return grow(rows, 0)


def test_splits_are_the_plain_ones(spark):
    rnd = random.Random(3)
    cuts = {f: sorted({round(rnd.random(), 2) for _ in range(rnd.choice([0, 1, 4, 7]))}) for f in url_filter.FEATURES}
    rows = []
    for _ in range(200):
        values = {f: round(rnd.random(), 3) for f in url_filter.FEATURES}
        label = values["place2"] + 0.3 * values["digits"] + 0.2 * rnd.random() > 0.8
        rows.append({"url_label": label, "url_weight": rnd.choice([1, 1, 3]), "margin": round(rnd.uniform(-2, 2), 3), "bins": [sum(values[f] > c for c in cuts[f]) for f in url_filter.FEATURES]} | {f"url_f_{f}": v for f, v in values.items()})
    kind = "url_label boolean, url_weight long, margin double, bins array<int>, " + ", ".join(f"url_f_{f} double" for f in url_filter.FEATURES)
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], kind)
    for depth in (1, 3):
        tree = plain_tree(rows, cuts, depth)
        assert url_filter._grow(frame, cuts, depth) == tree
    got = frame.select(url_filter._walk(tree).alias("v"), *(f"url_f_{f}" for f in url_filter.FEATURES)).collect()
    for r in got:
        t = tree
        while isinstance(t, tuple):
            t = t[2] if r[f"url_f_{t[0]}"] <= t[1] else t[3]
        assert r["v"] == t


def held_out(urls):
    """Urls that the rules decide, every fourth of them with its verdict held back: the share right, and that of always the same verdict."""
    path = url_filter.split_url(F.col("url"))
    ruled = urls.select("url", url_filter.match_rule(*path, queries.URL_RULES)[1].alias("v")).where("v IS NOT NULL").distinct()
    ruled = ruled.select("url", (F.col("v") == "block").alias("blocked"), (F.pmod(F.xxhash64(F.lit(9), "url"), F.lit(4)) == 0).alias("out"))
    asked = ruled.where("out")
    got = url_filter.judge(asked, [], labelled=ruled.where("NOT out").select("url", "blocked"))
    right, blocked, n = got.agg(F.avg(((F.col("url_verdict") == "block") == F.col("blocked")).cast("double")), F.avg(F.col("blocked").cast("double")), F.count("*")).first()
    return right, max(blocked, 1 - blocked), n


def test_held_out_urls(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("aeioutnrs", k=rnd.randint(2, 8)))
    host = lambda: rnd.choice(["", "www.", word() + "."]) + word() + rnd.choice([".example.org", ".example.com", ".example.net"])
    urls = [f"https://{host()}/{rnd.choice(['en', 'fr', 'de', 'es'])}/{rnd.randint(1, 4000)}" + rnd.choice(["", f"?{word()}={rnd.randint(1, 99)}", "#top"]) for _ in range(3000)]
    right, constant, n = held_out(spark.createDataFrame([(u,) for u in urls * 2], "url string"))
    print(f"right {right:.4f} constant {constant:.4f} urls {n}")
    assert n > 300 and right >= constant + 0.15
