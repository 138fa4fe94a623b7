"""What a reader of a paper points at: the nearest word, and where the evidence of an answer stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


def nearest_word(words: DataFrame, points: DataFrame) -> DataFrame:
    """``points(point_id, doc_id, page, x, y)`` with the nearest of ``words(doc_id, page, word_id, x0, y0, x1, y1)``; heights count fourfold."""
    dx = F.greatest(F.col("x0") - F.col("x"), F.lit(0.0), F.col("x") - F.col("x1"))
    dy = F.greatest(F.col("y0") - F.col("y"), F.lit(0.0), F.col("y") - F.col("y1"))
    near = points.join(words, ["doc_id", "page"])
    return near.groupBy("point_id").agg(F.min_by("word_id", F.struct((dx * dx + 4 * dy * dy).alias("d"), "word_id")).alias("word_id"))


def probe(page_text: Column, snippet: Column, lengths: tuple[int, ...] = (14, 8, 5)) -> Column:
    """The first words of a snippet that a page holds: 14, else 8, else 5 of them; null if none."""
    ws = T.words(snippet)
    part = lambda n: F.array_join(F.slice(ws, F.lit(1), F.least(F.size(ws), F.lit(n))), " ")
    flat = F.lower(T.collapse(page_text))
    return F.coalesce(*(F.when((part(n) != "") & F.contains(flat, F.lower(part(n))), part(n)) for n in lengths))


def evidence_of(cited: DataFrame, sources: DataFrame, visuals: DataFrame) -> DataFrame:
    """``cited(sid)`` to a page and box: that of the source's visual if it has one, else its caption's, else none. Labels match in any case."""
    s = cited.join(sources, "sid", "left").withColumn("same", F.lower(F.trim("label")))
    v = visuals.select(F.lower(F.trim("label")).alias("same"), F.coalesce("bbox", "caption_bbox").alias("box"))
    return s.join(v, "same", "left").select("sid", "page", "label", "box", F.ltrim(F.substring_index("text", "Referred to in the text:", 1)).alias("snippet"))


def linked(answer: Column) -> Column:
    """Markers of sources as links."""
    return F.regexp_replace(answer, r"\[([SH]\d+)\]", '<a href="#$1">[$1]</a>')


def page_at(tops: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes(probe_id, doc_id, y)`` with the last page of ``tops(doc_id, page, top)`` that starts no later."""
    met = probes.join(tops, "doc_id").where(F.col("top") <= F.col("y"))
    return met.groupBy("probe_id").agg(F.max_by("page", F.struct("top", "page")).alias("page"))
