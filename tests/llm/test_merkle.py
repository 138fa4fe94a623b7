"""The Merkle manifest against one built level by level, with its awkward rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r):
    return sha("".join(field(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))


def plain_tree(leaves, arity):
    """The root, and each leaf's siblings level by level as (place in the run, others)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        runs = [level[i : i + arity] for i in range(0, len(level), arity)]
        for n, p in enumerate(at):
            run, own = runs[p // arity], p % arity
            paths[n].append((own, run[:own] + run[own + 1 :]))
        at, level = [p // arity for p in at], [sha("".join(r)) for r in runs]
    return level[0] if level else None, paths


def plain_manifest(rows, arity=2):
    """(doc_id, leaf) -> the sorted (subroot, root, path) of the rows alike."""
    parts = {}
    for r in rows:
        parts.setdefault(r["lang"], []).append(r)
    names = sorted(parts, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for name in names:
        ordered = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)) for r in parts[name]))
        trees[name] = ordered, *plain_tree([d for _, _, d in ordered], arity)
    root, above = plain_tree([trees[n][1] for n in names], arity)
    out = []
    for name, further in zip(names, above, strict=True):
        ordered, subroot, paths = trees[name]
        out += [(i if some else None, d, subroot, root, p + further) for (some, i, d), p in zip(ordered, paths, strict=True)]
    return out


def made(spark, n, langs=("de", None, "en", "")):
    kind = "doc_id long, text string, lang string, source string, n_chars long, merkle_leaf string"
    return spark.createDataFrame([(i * 7 % n, f"é text {i}", langs[(i * i) % len(langs)] if i % 3 else "en", "s" if i % 5 else None, i if i % 4 else None, "own") for i in range(n)], kind)


def flat(rows):
    return sorted((repr(r[0]), r[1], r[2], r[3], [(a, list(o)) for a, o in r[4]]) for r in rows)


@pytest.mark.parametrize(("n", "levels", "arity"), [(1, 10, 2), (2, 1, 2), (77, 2, 2), (77, 1, 3), (130, 10, 2), (200, 3, 4)])
def test_manifest_is_the_plain_one(spark, monkeypatch, n, levels, arity):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    docs = made(spark, n)
    got = merkle.manifest(docs, ["doc_id", "merkle_leaf"], arity=arity)
    assert got.columns == ["doc_id", "merkle_leaf", "merkle_subroot", "merkle_root", "merkle_path"]
    got = [(r.doc_id, r.merkle_leaf, r.merkle_subroot, r.merkle_root, [(s["at"], [bytes(o).hex() for o in s["others"]]) for s in r.merkle_path]) for r in got.collect()]
    assert flat(got) == flat(plain_manifest([r.asDict() for r in docs.collect()], arity))


@pytest.mark.parametrize("levels", [1, 10])
def test_folding(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    got = merkle.manifest(made(spark, 53), ["doc_id"], arity=3).select("merkle_root", merkle.fold(F.col("merkle_leaf"), F.col("merkle_path")).alias("f"), merkle.fold(F.sha2(F.lit("x"), 256), F.col("merkle_path")).alias("x"))
    for r in got.collect():
        assert r.f == r.merkle_root != r.x


def test_awkward_rows(spark, awkward, nothing, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    got = [(r.doc_id, r.merkle_leaf, r.merkle_subroot, r.merkle_root, [(s["at"], [bytes(o).hex() for o in s["others"]]) for s in r.merkle_path]) for r in merkle.manifest(awkward, ["doc_id"]).collect()]
    assert flat(got) == flat(plain_manifest([r.asDict() for r in awkward.collect()]))
    assert merkle.manifest(nothing, ["doc_id", "text"]).count() == 0


def test_query(spark, tmp_path, awkward):
    awkward.withColumn("leaf", F.lit(1)).withColumn("row", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [r.asDict() for r in awkward.collect()]
    want = {(i, d): (s, r) for i, d, s, r, _ in plain_manifest(rows)}
    tampers = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 0
    changed = {leaf(r): leaf(r | {"n_chars": r["n_chars"] + 1}) if tampers(r["doc_id"]) and r["n_chars"] is not None else leaf(r) for r in rows}
    got = queries.op13_merkle_manifest(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for g in got:
        assert (g.subroot, g.root) == want[g.doc_id, g.leaf]
        assert g.verified == (g.folded_root == g.root) == (changed[g.leaf] == g.leaf)
    proofs = {(i, d): [] for i, d, *_ in plain_manifest(rows)}
    for i, d, _, _, p in plain_manifest(rows):
        proofs[i, d].append(sha("".join(o for _, others in p for o in others)))
    assert all(g.proof_sha256 in proofs[g.doc_id, g.leaf] for g in got)
