"""Reference lists and author lines, as expressions over one document's blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

# Fixed values.
START = r"(?U)(?:(?<=\s)|^)\[?(\d{1,3})\]?[.)]?\s+(?=[A-ZÀ-Þ])"
AFFILIATION = r"(?i)univers|institut|department|school of|hospital|laborator|college|centre|center|@|faculty|academy|corresponding|received|accepted|copyright|doi\b|http"
NAME = r"^[A-ZÀ-Þ][\p{L}\p{N}_.'’\-À-ſ]*(?:\s+[A-Za-zÀ-ſ.'’\-]+){0,4}$"
FOOTNOTES = r"[\d*†‡§¶∗]+"
SEPARATORS = r",|;|\band\b|·|•|&"
LEAST_NUMBERED, LEAST_PLAIN, NAMES, NAME_LINES, LINE_WORDS, TITLE_SLACK = 15, 25, 40, 3, 70, 0.6
#: Marks put before and after a printed number; texts don't hold them.
OPEN, CLOSE = "\ue000", "\ue001"


def references(blocks: DataFrame) -> DataFrame:
    """``(doc_id, index, text, page)`` from the reference blocks ``(doc_id, page, pos, text)`` of each document.

    If at least three printed numbers are found and the first is 0 or 1, an entry goes from a number to the next and is on
    the page where its number stands. Otherwise each block is an entry. Short entries are dropped; null texts are empty.
    """
    block = F.struct("page", "pos", F.translate(F.coalesce("text", F.lit("")), OPEN + CLOSE, "  ").alias("text"))
    own = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    whole = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")
    own = own.select("doc_id", "blocks", F.split(F.regexp_replace(whole, START, f"{OPEN}$0{CLOSE}"), OPEN).alias("parts"))
    first = F.regexp_extract(F.get("parts", 1), r"^\[?(\d+)", 1)
    own = own.withColumn("numbered", (F.size("parts") > 3) & first.isin("0", "1"))

    # A part's place in the text, and the block in which that is: the first to end after it.
    by_doc = Window.partitionBy("doc_id").orderBy("k")
    before = by_doc.rowsBetween(Window.unboundedPreceding, -1)
    parts = own.where("numbered").select("doc_id", "blocks", F.posexplode("parts").alias("k", "part"))
    size = F.char_length("part") - F.contains("part", F.lit(CLOSE)).cast("int")
    parts = parts.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0))).where("k > 0")
    lengths = F.transform("blocks", lambda b: F.char_length(b["text"]) + 1)
    ends = F.transform("blocks", lambda b, k: F.aggregate(F.slice(lengths, F.lit(1), k + 1), F.lit(0), lambda s, n: s + n))
    page = F.element_at("blocks", F.least(F.size(F.filter(ends, lambda e: e <= F.col("at"))) + 1, F.size("blocks")))["page"]
    text = T.collapse(F.substring_index("part", CLOSE, -1))
    numbered = parts.select("doc_id", "k", text.alias("text"), page.alias("page")).where(F.char_length("text") > LEAST_NUMBERED)

    plain = own.where("NOT numbered").select("doc_id", F.posexplode("blocks").alias("k", "b"))
    plain = plain.select("doc_id", "k", T.collapse(F.col("b.text")).alias("text"), F.col("b.page").alias("page")).where(F.char_length("text") > LEAST_PLAIN)
    return numbered.unionByName(plain).select("doc_id", F.row_number().over(by_doc).cast("long").alias("index"), "text", F.col("page").cast("long").alias("page"))


def authors(lines: DataFrame) -> DataFrame:
    """``(doc_id, authors)`` from ``lines(doc_id, pos, text)`` that follow each title: the names in the first of three that has any.

    Lines of the title's own size (where ``size`` and ``title_size`` are given), of affiliations, of the abstract and long ones have none.
    """
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    line = F.coalesce("text", F.lit(""))
    bare = F.split(F.regexp_replace(line, FOOTNOTES, " "), SEPARATORS)
    names = F.filter(F.transform(bare, T.collapse), lambda p: p.rlike(NAME) & F.size(F.split(p, " ")).between(2, 5))
    passed = (T.word_count(line) > LINE_WORDS) | line.rlike(r"(?i)^\s*abstract") | line.rlike(AFFILIATION)
    if {"size", "title_size"} <= set(lines.columns):
        passed = passed | F.coalesce(F.col("size") >= F.col("title_size") - TITLE_SLACK, F.lit(False))
    found = lines.withColumn("nth", nth).where(F.col("nth") <= NAME_LINES).select("doc_id", "nth", F.when(~passed, names).alias("names"))
    has = F.size("names") > 0
    first = F.min_by(F.when(has, F.col("names")), F.when(has, F.col("nth")))
    return found.groupBy("doc_id").agg(F.coalesce(F.slice(first, 1, NAMES), F.array().cast("array<string>")).alias("authors"))
