"""The pipeline's near-dedup on all pairs of a given table: one of each pair at a similarity of 0.8 goes."""

from collections import defaultdict
from pathlib import Path

import pytest

from tessera.llm import simhash

TABLE = Path("/root/testdata/sf0.01/documents.parquet")


def shingles(text):
    words = text.encode().lower().decode().split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


@pytest.mark.skipif(not TABLE.exists(), reason="needs the table")
def test_all_pairs_at_eight_tenths_lose_one(spark):
    docs = spark.read.parquet(str(TABLE))
    own = {r["doc_id"]: shingles(r["text"] or "") for r in docs.select("doc_id", "text").collect()}
    holders, common = defaultdict(list), defaultdict(int)
    for i, s in own.items():
        for x in s:
            for j in holders[x]:
                common[j, i] += 1
            holders[x].append(i)
    alike = [(a, b) for (a, b), n in common.items() if n >= 0.8 * (len(own[a]) + len(own[b]) - n)]
    kept = {r["doc_id"] for r in simhash.keep_one(docs).select("doc_id").collect()}
    lost = [p for p in alike if not set(p) <= kept]
    unlike = {i for i in own if not any(n >= 0.5 * (len(own[a]) + len(own[b]) - n) for (a, b), n in common.items() if i in (a, b))}
    print(f"{len(lost)} of {len(alike)} pairs lose one, {len(unlike - kept)} of {len(unlike)} documents without a pair at 0.5 go")
    assert len(alike) > 50 and len(lost) >= 0.98 * len(alike)
    assert not unlike - kept
