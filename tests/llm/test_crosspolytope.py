"""Nearest neighbours against brute force: recall, scores, order, and awkward vectors."""

import math

import numpy as np
import pytest
from helpers import SF

from tessera.llm import crosspolytope as cp
from tessera.llm import queries

KIND = "id long, vector array<float>, query_id string, label string"


def made(n, dims, seed, spread=0.0, clusters=20, noise=0.35):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((clusters, dims))[rng.integers(0, clusters, n)] + noise * rng.standard_normal((n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return (x * np.exp(spread * rng.standard_normal((n, 1)))).astype(np.float32)


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(c) for c in v], "own", "l") for i, v in zip(range(len(x)) if ids is None else ids, x, strict=True)], KIND)


def ask(rows, every=20):
    return rows.where(f"id % {every} = 0").selectExpr("id AS query_id", "vector")


def brute(x, q, k):
    s = x.astype(float) @ x[q].astype(float)
    s[q] = -math.inf
    return [(i, s[i]) for i in np.lexsort((np.arange(len(x)), -s))[:k] if i != q]


def lists(got):
    out = {}
    for r in got.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    assert all([n for n, *_ in sorted(v)] == list(range(1, len(v) + 1)) for v in out.values())
    return {q: [(i, s) for _, i, s in sorted(v)] for q, v in out.items()}


def recall(x, got, k):
    hits = 0
    for q, found in got.items():
        scores = [s for _, s in found]
        assert scores == sorted(scores, reverse=True) and q not in [i for i, _ in found]
        assert np.allclose(scores, [x[i].astype(float) @ x[q].astype(float) for i, _ in found], rtol=1e-12)
        hits += len({i for i, _ in brute(x, q, k)} & {i for i, _ in found})
    return hits / (k * len(got))


@pytest.mark.parametrize("spread", [0.0, 0.4])
def test_recall(spark, spread):
    x = made(6000, 24, 1, spread)
    got = lists(cp.neighbours(frame(spark, x), ask(frame(spark, x))))
    assert len(got) == 300 and all(len(v) == 20 for v in got.values())
    assert recall(x, got, 20) >= 0.95


def test_recall_of_probes_alone(spark, monkeypatch):
    """Vectors without near neighbours, and blocks of parts with too many rows."""
    monkeypatch.setattr(cp, "ROWS", 8)
    monkeypatch.setattr(cp, "PART", 60)
    monkeypatch.setattr(cp, "ENTRIES", 500)
    x = made(4000, 16, 2, clusters=4000)
    x[:900] = x[0] + 0.001 * x[:900]  # a hot cell
    got = lists(cp.neighbours(frame(spark, x), ask(frame(spark, x), 50), 10))
    assert recall(x, got, 10) >= 0.9


def test_few_vectors_are_all_compared(spark):
    x = made(700, 33, 3)
    got = lists(cp.neighbours(frame(spark, x), ask(frame(spark, x)), 5))
    assert recall(x, got, 5) == 1


def test_copies_ties_and_fewer_than_k(spark):
    x = np.array([[1, 0], [1, 0], [0.0, -0.0], [0, 1], [1, 0], [1, 1], [-1, -0.0], [-1, 0]], np.float32)
    got = lists(cp.neighbours(frame(spark, x), frame(spark, x).selectExpr("id AS query_id", "vector"), 3))
    assert got[0] == [(1, 1.0), (4, 1.0), (5, 1.0)] and got[4] == [(0, 1.0), (1, 1.0), (5, 1.0)]
    assert got[6] == [(7, 1.0), (3, 0.0), (0, -1.0)] and got[3] == [(5, 1.0), (0, 0.0), (1, 0.0)]
    assert 2 not in got and all(2 not in [i for i, _ in v] for v in got.values())
    many = frame(spark, np.tile(x[:1], (3000, 1)))  # a third of all rows and more may be one vector
    assert lists(cp.neighbours(many, many.where("id IN (0, 7, 2999)").selectExpr("id AS query_id", "vector"), 4)) == {0: [(i, 1.0) for i in (1, 2, 3, 4)], 7: [(i, 1.0) for i in range(4)], 2999: [(i, 1.0) for i in range(4)]}


def test_unusable_vectors_take_no_part(spark):
    bad = [(20, None), (40, []), (60, [0.0, 0.0]), (80, [1.0, None]), (100, [1.0, math.nan]), (120, [math.inf, 1.0]), (140, [1.0, 2.0, 3.0]), (None, [1.0, 0.0])]
    good = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (3, [-1.0, 0.5]), (3, [0.5, 0.5])]
    rows = spark.createDataFrame([(i, v, "q", "l") for i, v in bad + good], KIND)
    got = lists(cp.neighbours(rows, rows.selectExpr("id AS query_id", "vector").where("query_id <> 3")))
    assert got == {0: [(1, 4.0), (3, 1.5), (3, 0.0)], 1: [(0, 4.0), (3, 1.5), (3, -1.5)]}
    assert cp.neighbours(rows.where("id > 5"), rows.selectExpr("id AS query_id", "vector")).columns == ["query_id", "rank", "id", "score"]
    none = rows.where("id = 20")
    assert cp.neighbours(none, none.selectExpr("id AS query_id", "vector")).count() == 0
    assert cp.neighbours(rows, none.selectExpr("id AS query_id", "vector")).count() == 0


def test_transform_and_cells():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((50, 16))
    h = np.array([[1]])
    while len(h) < 16:
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(cp.hadamard(x), x @ h / 4)
    tables = cp.Tables(16, 8)  # 32 axes, then 8
    assert tables.axes == [16, 4]
    (a, b), cells = list(tables._signed(x, 1)), tables.cells(x, 1)
    assert np.allclose(np.linalg.norm(a[:, :16], axis=1), np.linalg.norm(x, axis=1))
    assert (cells == a.argmax(1) * 8 + b.argmax(1)).all()
    for i, found in enumerate(tables.probed(x, 1, 256)):
        cost = ((a[i].max() - a[i]) ** 2)[:, None] + ((b[i].max() - b[i]) ** 2)[None, :]
        assert found[0] == cells[i] and sorted(found) == list(range(256))
        assert (np.diff(cost.ravel()[found]) >= 0).all()


def test_query(spark):
    got = queries.op12_nearest(spark, SF)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], np.float32)
    got = lists(got.withColumnRenamed("vec_id", "id"))
    assert len(got) == sum(r.vec_id % 20 == 0 for r in rows)
    assert recall(x, got, 20) >= 0.95
