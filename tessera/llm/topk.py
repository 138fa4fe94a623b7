"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are 64 bits: the signs of a vector's values (or any longs). They are cut into two to eight segments, the fewest for which a query
in random codes is expected to probe at most ``PROBES`` values: a probe is a row that is made, shuffled and sorted, and by this bound
there are as many a query at any size, while a comparison within the join is cheap. The index holds each distinct
code once, with its ``k`` least ids, under each of its ``m`` segments; copies of a code, however many, can so
add at most ``k`` answers. A round of radius ``r`` probes, for each unfinished query and segment, the values that
differ from its own in just ``r`` bits, and verifies what it meets within the join. All codes within distance
``m (r + 1) - 1`` are then known, since one of their segments is within ``r``; a query is finished once its ``k``-th verified
distance is no more. If that distance is ``m r + a - 1`` before the round, ``a`` segments are enough: a code as near has one of these within ``r``, or
another within ``r - 1``, which the round before probed. The turned bits of a round are made in the tasks, and of what a task's join
finds only the ``k`` nearest codes of each query are shuffled.

Defined cases: a null vector, or one whose length is not 64, has no code, so it is neither indexed nor a query;
null values count as not positive; a row without an id is no answer, a query without one is a query; ties are ordered by id;
repeated rows are answers of their own up to ``k`` a code; a query id with several codes has a list for each, told apart by
``query_code``; a table of fewer than ``k`` codes answers with all it has; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed


#: Values that a query is expected to probe at most.
PROBES = 1 << 10


def segments(codes: int, k: int) -> int:
    """How many segments a search for ``k`` of so many distinct codes takes, by the distance at which random codes have ``k``."""
    far, within = 0, 1
    while far < 64 and codes * within < k << 64:
        far += 1
        within += math.comb(64, far)

    def probes(m: int) -> int:
        last, width = far // m, -(-64 // m)
        return m * sum(math.comb(width, r) for r in range(last)) + (far - m * last + 1) * math.comb(width, last)

    return next((m for m in range(2, 9) if probes(m) <= PROBES), 8)


def edges(codes: float) -> list[int]:
    """Where the segments begin and end that tell so many codes apart."""
    m = min(8, max(2, round(64 / math.log2(max(codes, 2)))))
    return [64 * s // m for s in range(m + 1)]


def sign_code(vector: Column) -> Column:
    """Bit ``i`` is 1 where value ``i`` is over 0; null unless there are 64 values."""
    bits = F.aggregate(
        F.sequence(F.lit(0), F.lit(63)),
        F.lit(0).cast("long"),
        lambda a, i: a.bitwiseOR(F.when(F.coalesce(F.get(vector, i) > 0, F.lit(False)), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
    )
    return F.when(F.size(vector) == 64, bits)


def _segments(code: Column, cuts: list[int]) -> Column:
    """A row ``x(s, value, top)`` for each segment; ``top`` is beyond its values."""

    def part(s: int) -> Column:
        a, b = cuts[s : s + 2]
        value = F.call_function("shiftrightunsigned", code, F.lit(a)).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))
        return F.struct(F.lit(s).alias("s"), value.alias("value"), F.lit(1 << (b - a)).cast("long").alias("top"))

    return F.explode(F.array(*map(part, range(len(cuts) - 1)))).alias("x")


def _flipped(own: DataFrame, width: int, r: int) -> DataFrame:
    """``own`` with ``flip``, a row for each number of ``r`` of the low ``width`` bits: made bit by bit in the tasks, the lowest first."""
    d = own.withColumn("flip", F.lit(0).cast("long")).withColumn("last", F.lit(-1))
    for _ in range(r):
        d = d.where(F.col("last") < width - 1).withColumn("last", F.explode(F.sequence(F.col("last") + 1, F.lit(width - 1))))
        d = d.withColumn("flip", F.col("flip").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("last"))))
    return d.drop("last")


def top_k(coded: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, rank, id, distance, query_code)``: the ``k`` nearest of ``coded(id, code)`` for each of ``queries(query_id, code)``."""
    spark = coded.sparkSession
    nth = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    ids = coded.where("code IS NOT NULL AND id IS NOT NULL").withColumn("n", nth).where(F.col("n") <= k)
    ids = checkpointed(ids.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    total, codes = ids.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.count("*")).first()
    cuts = edges(2 ** (64 / segments(codes, k)))
    m, width = len(cuts) - 1, max(b - a for a, b in zip(cuts, cuts[1:], strict=False))
    index = checkpointed(ids.select("code", F.get("ids", 0).alias("first"), _segments(F.col("code"), cuts)).select("x.s", "x.value", "code", "first"))
    asked = checkpointed(queries.where("code IS NOT NULL").select("query_id", F.col("code").alias("q")).distinct().withColumn("query", F.monotonically_increasing_id()))
    pending, best = asked.select("query", "q", F.lit(64).alias("far")), None
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for r in range(width + 1):
        if pending.isEmpty():
            break
        own = pending.select("query", "q", "far", _segments(F.col("q"), cuts)).select("query", "q", "far", "x.*")
        own = own.where(F.col("s") < F.col("far") - m * r + 1).repartition(parts, "query", "s")
        probe = _flipped(own, width, r).where("flip < top").withColumn("value", F.col("value").bitwiseXOR(F.col("flip")))
        distance = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
        # No code beyond the k-th verified distance so far can be an answer.
        # Spark takes the probes, whose rows are made by generators, for few and would broadcast them.
        near = probe.alias("p").hint("merge").join(index.alias("i"), (F.col("p.s") == F.col("i.s")) & (F.col("p.value") == F.col("i.value")) & (distance <= F.col("far")))
        closest = F.dense_rank().over(Window.partitionBy("query").orderBy("distance", "first", "code"))
        near = near.select("query", "code", "first", distance.alias("distance")).withColumn("n", closest).where(F.col("n") <= k).drop("n").distinct()
        if best is not None:
            known = best.select("query", "code", "first", "distance").join(pending, "query", "left_semi")
            near = near.unionByName(known).distinct()
        nearest = F.row_number().over(Window.partitionBy("query").orderBy("distance", "first", "code"))
        place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
        near = near.withColumn("n", nearest).where(F.col("n") <= k).drop("n").join(ids, "code")
        near = near.select("query", "code", "first", "distance", F.explode("ids").alias("id")).withColumn("rank", place).where(F.col("rank") <= k)
        best = checkpointed(near if best is None else near.unionByName(best.join(pending, "query", "left_anti")))
        state = best.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("d"))
        full = F.col("n") >= min(k, total)
        left = pending.select("query", "q").join(state, "query", "left").where(F.col("n").isNull() | ~(full & (F.col("d") <= m * (r + 1) - 1)))
        pending = checkpointed(left.select("query", "q", F.when(full, F.col("d")).otherwise(64).alias("far")))
    if best is None:
        return spark.createDataFrame([], "query_id bigint, rank int, id bigint, distance int, query_code bigint")
    return best.join(asked, "query").select("query_id", "rank", "id", "distance", F.col("q").alias("query_code"))
