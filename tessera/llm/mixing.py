"""Mixing sources to target weights by entropy balancing.

Document ``i`` of source ``s`` gets a rate ``r_i`` that minimises ``sum r_i (ln r_i - 1)`` under the
token constraints ``sum_(i in s) r_i size_i = target_s`` and ``r_i <= 3``. The convex dual has one
multiplier a source, and its solution tilts rates exponentially: ``r_i = min(3, exp(a_s size_i))``.
Newton steps solve it for all sources at once, on counts of documents by (source, size class): the
documents are read once, the counts are pre-aggregated before their shuffle, and a source has a bounded
number of classes (a class is the leading six bits of the size, 32 an octave), however many rows it has.

Rates become copies in two steps. Over the classes of a source, from the largest size down, each takes
the whole number of copies that brings the words taken so far nearest to the words its rates ask
for, so what one class rounds away the next makes good. Within a class the copies are dealt evenly:
documents are spread over ``SALTS`` groups by a hash, groups get copies by their running count, and
in a group those with the lowest hash get one more. No sort ever holds a class in one task.

DataFrame functions only; results don't depend on partitions or order, so reruns agree.

Defined cases: a null or empty text has size 0 and takes nothing; null is a source, ordered last; with
no words at all every target is 0; repeated rows are documents of their own, and their copies are dealt
between them; an empty table gives no rows; other columns are left out of ``mix`` and kept, once a
copy, by ``materialise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import beside, checkpointed, packed, size_class, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
SALTS = 256
NEWTON_STEPS = 60


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources(key, source_size)`` with ``target``: weights share all words, up to ``most`` times a source.

    Weights repeat along the keys in code point order (the null source's key ``n`` comes last). The sources
    that stop at their limit are those with the least limit for their weight, so one pass in that order
    finds where the excess, shared again by weight, puts no further source above. One row a source.
    """
    by_name = Window.orderBy(F.col("key") == "n", "key")
    by_limit = Window.orderBy("level", "place").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    limit = F.col("source_size") * float(most)
    s = sources.withColumn("place", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("place") % len(weights)))
    s = s.withColumn("level", limit / F.col("weight"))
    s = s.withColumn("total", F.sum("source_size").over(every).cast("double")).withColumn("weights", F.sum("weight").over(every))
    s = s.withColumn("stopped", F.coalesce(F.sum(limit).over(by_limit), F.lit(0.0)))
    s = s.withColumn("open", F.col("weights") - F.coalesce(F.sum("weight").over(by_limit), F.lit(0.0)))
    s = s.withColumn("price", (F.col("total") - F.col("stopped")) / F.col("open"))
    s = s.withColumn("price", F.min(F.when(F.col("price") <= F.col("level"), F.struct("level", "place", "price"))).over(every)["price"])
    return s.select("key", "source_size", F.least(limit, F.col("weight") * F.col("price")).alias("target"))


def _rate(tilt: Column, most: int) -> Column:
    """The tilted rate: exp, and no more than ``most``."""
    return F.exp(F.least(tilt, F.log(F.lit(float(most)))))


def _words(cells: Column, a: Column, most: int, power: int) -> Column:
    """The sum over a source's cells of rate * tokens * x**power, x being the size over the source's mean.

    With ``power`` 1 it is the slope of the sum with power 0, for which cells at the limit count nothing.
    """
    moves = lambda c: F.lit(power == 0) | (a * c["x"] < F.log(F.lit(float(most))))
    return F.aggregate(cells, F.lit(0.0), lambda t, c: t + F.when(moves(c), _rate(a * c["x"], most) * c["tokens"] * F.pow(c["x"], F.lit(power))).otherwise(0.0))


def multipliers(by_source: DataFrame, most: int = MOST, steps: int = NEWTON_STEPS) -> DataFrame:
    """``by_source(cells, target, ...)`` with ``tilt``, by safeguarded Newton steps on the dual.

    The words of a source rise with its multiplier, so each step keeps an interval around the solution
    and falls back to its middle, or while one end is open to twice its other end, where Newton's point leaves it.
    """
    far = 1e6
    start = F.struct(F.lit(-far).alias("low"), F.lit(far).alias("high"), F.lit(0.0).alias("a"))

    def step(s: Column, _: Column) -> Column:
        words, slope = _words(F.col("cells"), s["a"], most, 0), _words(F.col("cells"), s["a"], most, 1)
        gap = words - F.col("target")
        low, high = F.when(gap < 0, s["a"]).otherwise(s["low"]), F.when(gap < 0, s["high"]).otherwise(s["a"])
        middle = F.when(low == -far, F.least(high * 2, high - 1)).when(high == far, F.greatest(low * 2, low + 1)).otherwise((low + high) / 2)
        newton = s["a"] - gap / F.greatest(slope, F.lit(1e-300))
        best = F.when(F.abs(gap) <= F.col("target") * 1e-12, s["a"]).when((slope > 0) & (newton > low) & (newton < high), newton).otherwise(middle)
        return F.struct(low.alias("low"), high.alias("high"), best.alias("a"))

    return by_source.withColumn("tilt", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["a"])


def copies_by_class(solved: DataFrame, most: int = MOST) -> DataFrame:
    """``(key, source_size, target, cell, docs, copies)``: whole copies for each size class, errors carried to smaller sizes."""
    start = F.struct(F.lit(0.0).alias("due"), F.lit(0.0).alias("had"), F.array().cast("array<struct<cell:bigint,docs:bigint,copies:bigint>>").alias("out"))

    def take(s: Column, c: Column) -> Column:
        due = s["due"] + _rate(F.col("tilt") * c["x"], most) * c["tokens"]
        mean = c["tokens"] / c["docs"]
        n = F.greatest(F.lit(0).cast("long"), F.least(c["docs"] * most, F.round((due - s["had"]) / mean).cast("long")))
        one = F.struct(c["cell"].alias("cell"), c["docs"].alias("docs"), n.alias("copies"))
        return F.struct(due.alias("due"), (s["had"] + n * mean).alias("had"), F.concat(s["out"], F.array(one)).alias("out"))

    down = F.reverse(F.array_sort("cells"))
    return solved.select("key", "source_size", "target", F.explode(F.aggregate(down, start, take)["out"]).alias("c")).select("key", "source_size", "target", "c.*")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, text: str = "text", keep: list[str] | None = None, store: bool | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_copies``; ``store`` if the counted rows are narrow enough to be kept."""
    keep = docs.columns if keep is None else keep
    sized = packed(
        docs,
        keep,
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("mix_key"),
        word_count(F.col(text)).alias("mix_size"),
        F.xxhash64(F.lit(7), "doc_id", text).alias("mix_deal"),
        F.col("doc_id").alias("mix_id"),
    )
    sized = sized.withColumn("mix_cell", size_class(F.col("mix_size"))).withColumn("mix_salt", F.pmod("mix_deal", F.lit(SALTS)).cast("int"))
    if text not in keep if store is None else store:
        # Words are counted once; with the texts themselves, a second count costs less than storing them.
        sized = checkpointed(sized)
    counts = checkpointed(sized.groupBy(F.col("mix_key").alias("key"), F.col("mix_cell").alias("cell"), F.col("mix_salt").alias("salt")).agg(F.count("*").alias("docs"), F.sum("mix_size").alias("tokens")))
    sources = checkpointed(targets(counts.groupBy("key").agg(F.sum("tokens").alias("source_size")), weights, most))
    cells = counts.where("cell > 0").groupBy("key", "cell").agg(F.sum("docs").alias("docs"), F.sum("tokens").cast("double").alias("tokens"))
    of_source = Window.partitionBy("key")
    cells = cells.withColumn("x", F.col("tokens") / F.col("docs") * F.sum("docs").over(of_source) / F.sum("tokens").over(of_source))
    by_source = cells.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("cell", "docs", "tokens", "x"))).alias("cells"))
    want = copies_by_class(multipliers(by_source.join(sources, "key"), most), most)
    g = counts.join(want.withColumnRenamed("docs", "of"), ["key", "cell"])
    extra, upto = F.col("copies") % F.col("of"), F.sum("docs").over(Window.partitionBy("key", "cell").orderBy("salt"))
    share = lambda k: F.floor(k.cast("double") * extra / F.col("of"))
    g = g.select(
        F.col("key").alias("mix_key"), F.col("cell").alias("mix_cell"), F.col("salt").alias("mix_salt"),
        F.floor(F.col("copies") / F.col("of")).cast("long").alias("mix_each"), (share(upto) - share(upto - F.col("docs"))).cast("long").alias("mix_more"),
    )
    place = F.row_number().over(Window.partitionBy("mix_key", "mix_cell", "mix_salt").orderBy("mix_deal", "mix_id"))
    got = sized.withColumn("mix_place", place).join(g, ["mix_key", "mix_cell", "mix_salt"], "left")
    got = got.withColumn("mix_copies", F.coalesce(F.col("mix_each") + (F.col("mix_place") <= F.col("mix_more")).cast("long"), F.lit(0).cast("long")))
    s = sources.select(F.col("key").alias("mix_key"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    return beside(got.join(s, "mix_key").select("kept", "mix_size", "mix_source_size", "mix_target", "mix_copies"), keep)


def materialise(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, text: str = "text") -> DataFrame:
    """The mix itself: a row for each copy of a document, with the columns of ``docs``."""
    named = packed(docs, docs.columns, "doc_id", "source", F.col(text).alias("text")).withColumnRenamed("kept", "mix_row")
    copies = mix(named, weights, most, keep=["mix_row"], store=False).where("mix_copies > 0")
    return copies.withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), "mix_copies"))).select("mix_row.*")
