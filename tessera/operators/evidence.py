"""Evidence for an answer: visuals, context within a budget, and checks of what the answer cites and quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

TOKENS, VISUALS = 5500, 3


def pack(items: DataFrame, by: list[str], budget: int = TOKENS) -> DataFrame:
    """``items(*by, place, cost, ...)`` that fit ``budget`` in the order of ``place``, with ``sid`` numbers.

    An item that doesn't fit is skipped and later ones are still tried; the first is always kept.
    """
    listed = items.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", "cost"))).alias("xs"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))

    def add(a: Column, x: Column) -> Column:
        fits = (a["used"] + x["cost"] <= budget) | (F.size(a["kept"]) == 0)
        return F.struct(
            (a["used"] + F.when(fits, x["cost"]).otherwise(0)).cast("long").alias("used"),
            F.when(fits, F.concat(a["kept"], F.array(x["place"].cast("bigint")))).otherwise(a["kept"]).alias("kept"),
        )

    kept = listed.select(*by, F.posexplode(F.aggregate("xs", start, add)["kept"]).alias("i", "place"))
    return items.join(kept.select(*by, "place", F.concat(F.lit("S"), (F.col("i") + 1).cast("string")).alias("sid")), [*by, "place"])


def select_visuals(candidates: DataFrame, visuals: DataFrame, most: int = VISUALS) -> DataFrame:
    """``candidates(doc_id, label, prio, place)`` that exist among ``visuals``, best priority first, once each, ``most`` a document."""
    known = candidates.join(visuals.select("doc_id", "label").distinct(), ["doc_id", "label"])
    once = F.row_number().over(Window.partitionBy("doc_id", "label").orderBy("prio", "place"))
    first = known.withColumn("n", once).where("n = 1")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("prio", "place", "label"))
    return first.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).drop("n")


def without_shown(hits: DataFrame, shown: DataFrame) -> DataFrame:
    """Hits whose label isn't shown as a visual already."""
    return hits.join(shown.select("doc_id", "label"), ["doc_id", "label"], "left_anti")


def context_block(sid: Column, title: Column, kind: Column, text: Column, note: Column) -> Column:
    return F.concat(F.lit("["), sid, F.lit("] "), title, F.lit(" ("), kind, F.lit(")\n"), text, F.coalesce(F.concat(F.lit("\nModel-generated note: "), note), F.lit("")))


def marks(answers: DataFrame, answer: Column) -> DataFrame:
    """``answers`` with ``marks``, the different groups of markers in each answer: behind a generator, so that what is made of them later doesn't search the text again."""
    return answers.withColumn("marks", F.explode(F.array(T.marker_groups(answer))))


def validated(answer: Column, valid: Column, groups: Column | None = None) -> Column:
    """``struct(text, used, warning)``: groups of markers become single ones, and those of unknown sources are cut out.

    The ids come from the few groups (``marks`` finds them once a row), and each group is replaced in the text once.
    """
    groups = T.marker_groups(answer) if groups is None else groups
    own = lambda g: F.regexp_extract_all(g, F.lit(r"[SH]\d+"), F.lit(0))
    ids = F.array_distinct(F.flatten(F.transform(groups, own)))
    bad = F.array_except(ids, valid)
    kept = lambda g: F.array_join(F.transform(F.filter(own(g), lambda i: F.array_contains(valid, i)), lambda i: F.concat(F.lit("["), i, F.lit("]"))), "")
    clean = F.aggregate(groups, answer, lambda t, g: F.replace(t, g, kept(g)))
    warning = F.when(F.size(bad) > 0, F.concat(F.lit("Removed citation to non-existent source "), F.array_join(F.array_sort(bad), ", "), F.lit(".")))
    return F.struct(clean.alias("text"), F.array_intersect(ids, valid).alias("used"), warning.alias("warning"))


def unverified_quotes(answer: Column, sources: Column) -> Column:
    """Quotes of 25 to 400 characters that the sources (an array of texts) don't hold."""
    hay = F.array_join(F.transform(sources, T.normalised), " ")
    missing = F.filter(T.quotes(answer), lambda q: (T.normalised(q) != "") & ~F.contains(hay, T.normalised(q)))
    return F.transform(missing, lambda q: F.trim(q))


def shown_sources(sources: DataFrame, by: list[str], most: int = 3) -> DataFrame:
    """The cited sources of ``sources(*by, place, used)``, or without any the first ``most``."""
    any_used = F.max(F.col("used").cast("int")).over(Window.partitionBy(*by))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("place"))
    return sources.withColumn("any_used", any_used).withColumn("n", place).where(F.when(F.col("any_used") == 1, F.col("used")).otherwise(F.col("n") <= most)).drop("any_used", "n")


def with_abstract(hits: DataFrame, abstracts: DataFrame, wanted: Column) -> DataFrame:
    """``hits(doc_id, chunk_id, place, score)`` with abstract chunks not among them put first, where ``wanted``.

    The result may so exceed the number of hits asked for.
    """
    more = abstracts.where(wanted).join(hits.select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_anti")
    return hits.withColumn("prio", F.lit(1)).unionByName(more.select("doc_id", "chunk_id", F.lit(0).cast("long").alias("place"), F.lit(1.0).alias("score"), F.lit(0).alias("prio")))


def gathered(highlights: DataFrame, visuals: DataFrame, hits: DataFrame) -> DataFrame:
    """The streams of evidence ``(doc_id, key, text)`` in one order: highlights, then visuals, then hits."""
    parts = [d.select("doc_id", "key", "text", F.lit(k).alias("stream"), F.col("place")) for k, d in enumerate((highlights, visuals, hits))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("stream", "place", "key"))
    return every.withColumn("place", place.cast("long")).withColumn("cost", T.token_estimate(F.col("text")))


def for_analysis(chosen: DataFrame, top_labels: DataFrame, visual_intent: Column, most: int = 2) -> DataFrame:
    """Which of ``chosen(doc_id, label, reason, kind, image, rank)`` a vision model is shown.

    Those asked for if there are any; else retrieved ones, if the question is about visuals or the label is in
    ``top_labels``, the first two hits. Only figures and tables with an image, ``most`` a document.
    """
    top = top_labels.select("doc_id", "label").distinct().withColumn("in_top", F.lit(True))
    c = chosen.where(F.col("kind").isin("figure", "table") & F.col("image").isNotNull()).join(top, ["doc_id", "label"], "left")
    asked = F.max((F.col("reason") == "asked").cast("int")).over(Window.partitionBy("doc_id"))
    fits = F.when(F.col("any_asked") == 1, F.col("reason") == "asked").otherwise((F.col("reason") == "retrieved") & (visual_intent | F.coalesce("in_top", F.lit(False))))
    ok = c.withColumn("any_asked", asked).where(fits)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("rank", "label"))
    return ok.withColumn("n", place).where(F.col("n") <= most).drop("n", "in_top", "any_asked")


def mention_context(labels: DataFrame, chunks: DataFrame, cut: int = 600) -> DataFrame:
    """For each ``labels(doc_id, label)`` the start of the first of ``chunks(doc_id, ord, text, refs)`` that mentions it."""
    said = chunks.select("doc_id", "ord", "text", F.explode("refs").alias("label"))
    return labels.join(said, ["doc_id", "label"]).groupBy("doc_id", "label").agg(F.min_by(F.substring("text", 1, cut), "ord").alias("context"))


def note_key(label: Column, question: Column, model: Column) -> Column:
    """The key of a vision note: label, question (or ``general``) and model."""
    return F.concat_ws("|", label, F.coalesce(F.substring(F.sha1(question), 1, 10), F.lit("general")), model)
