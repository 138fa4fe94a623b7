"""Layout blocks: the input of the paper operators.

``blocks(doc_id, page, ord, x0, y0, x1, y1, text, size, bold)`` is what any page reader must give. ``from_lines``
makes such blocks from the lines of plain texts by a fixed rule, for tables that have no pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLOSE_HEADINGS = ("1. Introduction", "2 Methods", "3. Results", "4. Discussion", "5 Conclusion", "Appendix")
HEADINGS = ("1. Introduction", "2 Methods", "3. Results", "4. Discussion", "5 Conclusion", "References")
WIDTH, HEIGHT = 612.0, 792.0


def from_lines(documents: DataFrame) -> DataFrame:
    """Twenty lines a page in bands: full-width, left and right; headings, captions and mentions at fixed lines."""
    d = F.lit
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where("trim(line) <> ''")
    i, slot = F.col("i"), F.col("i") % 20
    side = F.when(i % 7 == 0, "full").when(i % 2 == 0, "left").otherwise("right")
    heading = F.get(F.array(*map(F.lit, HEADINGS)), F.floor(i / 11).cast("int") % 6)
    text = (
        F.when(i % 11 == 5, heading)
        .when(i % 13 == 9, F.concat(d("Figure "), (i % 4 + 1).cast("string"), d(". "), "line"))
        .when(i % 5 == 3, F.concat("line", d(" See Figure "), (i % 4 + 1).cast("string"), d(" and Table "), (i % 3 + 1).cast("string"), d(".")))
        .otherwise(F.col("line"))
    )
    body = lines.select(
        "doc_id",
        F.floor(i / 20).cast("int").alias("page"),
        i.cast("int").alias("ord"),
        F.when(side == "right", 316.0).otherwise(66.0).alias("x0"),
        (slot * 34 + 60).cast("double").alias("y0"),
        F.when(side == "left", 296.0).otherwise(546.0).alias("x1"),
        (slot * 34 + 84).cast("double").alias("y1"),
        text.alias("text"),
        F.when(i == 0, 18.0).when(i % 11 == 5, 12.0).when(i % 13 == 9, 9.0).otherwise(10.0).alias("size"),
        ((i == 0) | (i % 11 == 5)).alias("bold"),
    )
    heads = body.select("doc_id", "page").distinct().select(
        "doc_id", "page", (F.col("page") + 100000).alias("ord"), d(66.0).alias("x0"), d(10.0).alias("y0"), d(546.0).alias("x1"), d(20.0).alias("y1"),
        F.concat(d("Running head "), (F.col("page") + 1).cast("string")).alias("text"), d(8.0).alias("size"), d(False).alias("bold"),
    )
    return body.unionByName(heads)


def from_close_lines(documents: DataFrame) -> DataFrame:
    """Blocks of twenty lines a page in four groups, each with a caption of a table or a figure and two lines at small, changing distances below it.

    A page begins with a heading; some lines are equations, some mention visuals.
    """
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where("trim(line) <> ''")
    i, slot = F.col("i"), F.col("i") % 20
    group, place = F.floor(slot / 5), slot % 5
    base, near, further = group * 165 + 60, (F.col("doc_id") + i) % 7, (i % 4) * 2
    number = (i % 4 + 1).cast("string")
    y0 = F.when(place == 0, base).when(place == 1, base + 34).when(place == 2, base + 68).when(place == 3, base + 82 + near).otherwise(base + 94 + (F.col("doc_id") + i - 1) % 7 + further)
    title = F.concat(F.when(group % 2 == 0, "Table ").otherwise("Figure "), number, F.lit(". "))
    left = F.when(place == 3, 66 + (i % 3) * 6).otherwise(66)
    return lines.select(
        "doc_id", F.floor(i / 20).cast("int").alias("page"), i.cast("int").alias("ord"), left.cast("double").alias("x0"), y0.cast("double").alias("y0"),
        F.lit(546.0).alias("x1"), (y0 + F.when(place < 2, 24).when(place == 2, 14).otherwise(12)).cast("double").alias("y1"),
        F.when(slot == 0, F.get(F.array(*map(F.lit, CLOSE_HEADINGS)), F.floor(i / 20).cast("int") % 6)).when(place == 2, F.concat(title, "line"))
        .when(i % 15 == 1, F.concat("line", F.lit(" = λ ("), (i % 7 + 1).cast("string"), F.lit(")")))
        .when(i % 15 == 6, F.concat("line", F.lit(" See Figure "), number, F.lit(" and Table "), (i % 3 + 1).cast("string"), F.lit("."))).otherwise(F.col("line")).alias("text"),
        F.when(slot == 0, 12.0).when(place >= 2, 9.0).otherwise(10.0).alias("size"), (slot == 0).alias("bold"),
    )


def laid_out(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words of whole texts in tables of 3 to 5 columns and eight rows, one a page: words, the rules about them and a caption above.

    Horizontal rules are drawn in pieces a column long, some as thin boxes; positions of rules are off by up to 0.4 points. Captions are at two distances, and
    those of some documents end before the last column.
    """
    columns = F.col("doc_id") % 3 + 3
    d = lambda c: c.cast("double")
    words = documents.select("doc_id", columns.alias("columns"), F.posexplode(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0))).alias("i", "text"))
    place = F.col("i") % (F.col("columns") * 8)
    words = words.withColumn("page", F.floor(F.col("i") / (F.col("columns") * 8)).cast("int")).withColumn("row", F.floor(place / F.col("columns"))).withColumn("column", place % F.col("columns"))
    x, y = F.col("column") * 80 + 60, F.col("row") * 20 + 100
    placed = words.select("doc_id", "page", F.col("i").alias("ord"), d(x + 5).alias("x0"), d(y + 4).alias("y0"), d(x + 5 + F.least(F.char_length("text"), F.lit(15)) * 4).alias("x1"), d(y + 14).alias("y1"), "text")
    tables = words.groupBy("doc_id", "page", "columns").agg((F.max("row") + 1).alias("rows"))
    off = lambda n: (n * 7 % 5 - 2) * 0.2
    flat = tables.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows"))).alias("r")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1)).alias("c"))
    at, left = F.col("r") * 20 + 100 + off(F.col("r") + F.col("c")), F.col("c") * 80 + 60
    flat = flat.select("doc_id", "page", d(left).alias("x0"), d(at - F.when(F.col("c") % 2 == 0, 0.4).otherwise(0)).alias("y0"), d(left + 80).alias("x1"), d(at + F.when(F.col("c") % 2 == 0, 0.4).otherwise(0)).alias("y1"))
    upright = tables.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns"))).alias("c"))
    at = F.col("c") * 80 + 60 + off(F.col("c"))
    upright = upright.select("doc_id", "page", d(at).alias("x0"), F.lit(100.0).alias("y0"), d(at).alias("x1"), d(F.col("rows") * 20 + 100).alias("y1"))
    far, short = F.col("doc_id") % 5 == 0, F.col("doc_id") % 7 == 3
    captions = tables.select(
        "doc_id", "page", F.lit(0).alias("ord"), F.lit(60.0).alias("x0"), d(F.when(far, 44).otherwise(80)).alias("y0"), d((F.col("columns") - F.when(short, 1).otherwise(0)) * 80 + F.when(short, 50).otherwise(60)).alias("x1"), d(F.when(far, 54).otherwise(90)).alias("y1"),
    )
    return placed, flat.unionByName(upright), captions
