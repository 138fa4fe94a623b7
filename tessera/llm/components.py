"""Connected components by alternating stars, with no group ever held in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of ``links(a, b)``, root being the least node reachable.

    Every round relinks the larger neighbours of each node to its least one (large star), then each node
    and its smaller neighbours to the least of them (small star), until nothing changes: about the
    logarithm of the longest path many rounds. The least neighbours are pre-aggregated, and a
    node with many links is a skewed join that Spark splits. Each round is checkpointed, so a lost
    executor costs no earlier round. Null ends and links of a node to itself are left out.
    """
    edges = checkpointed(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpointed(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(mixed.cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first())
