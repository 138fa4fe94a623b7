"""From layout blocks to roles, reading order, sections, paragraphs, abstracts and titles.

All windows are partitioned by document or page, so a shuffle by ``doc_id`` serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources.blocks import HEIGHT, WIDTH

CAPTION = r"(?i)^\s*(Supplementary\s+|Extended\s+Data\s+)?(Fig(?:ure)?|Table)s?\.?\s*(S?\d{1,3})(?:([A-Za-z0-9])|\s*([.:|–—-])?)"
NUMBERED = r"^((?:\d{1,2}(?:\.\d{1,2}){0,3}\.?|[IVX]{1,4}\.|[A-Z][.)]))\s+([A-ZÀ-Þ][^\n]{1,110})$"
EQUATION = r"^(.{3,}?)\s+\((\d{1,3})\)\s*$"
MATH = "[=<>≤≥≈∼~±×∑∏∫√∂∇∈∀∃λμσαβγδθπφψωΔΣΩ]"
PAGE_NUMBER = r"^\W*\d{1,4}\W*$"


def furniture(blocks: DataFrame, height: float = HEIGHT) -> DataFrame:
    """``blocks`` with ``is_furniture``: page numbers, and margin texts that repeat over pages."""
    margin = (F.col("y1") < 0.08 * height) | (F.col("y0") > 0.92 * height)
    key = F.when(margin, F.substring(F.regexp_replace(F.lower("text"), r"\d+", "#"), 1, 80))
    b = blocks.withColumn("furniture_key", key)
    pages = F.max("page").over(Window.partitionBy("doc_id")) + 1
    times = F.count("*").over(Window.partitionBy("doc_id", "furniture_key"))
    repeated = (pages >= 3) & (times >= F.greatest(F.lit(2.0), pages * 0.4))
    return b.withColumn("is_furniture", margin & (F.col("text").rlike(PAGE_NUMBER) | repeated)).drop("furniture_key")


def body_size(blocks: DataFrame, default: float = 10.0) -> DataFrame:
    """``(doc_id, body_size)``: the size that most characters have; of equals the one seen first."""
    by = blocks.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("chars"), F.min(F.struct("page", "ord")).alias("seen"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("chars"), "seen")
    return by.withColumn("n", F.row_number().over(w)).where("n = 1").select("doc_id", F.coalesce("size", F.lit(default)).alias("body_size"))


def column_of(width: float = WIDTH) -> Column:
    middle, slack = width / 2, width * 0.06
    x0, x1 = F.col("x0"), F.col("x1")
    full = (x1 - x0 > width * 0.58) | ((x0 < middle - slack) & (x1 > middle + slack))
    return F.when(full, "full").when((x0 + x1) / 2 < middle, "left").otherwise("right")


def reading_order(blocks: DataFrame, width: float = WIDTH) -> DataFrame:
    """``blocks`` with ``pos``, the 0-based place on the page: full-width blocks part bands, left goes before right."""
    page = Window.partitionBy("doc_id", "page")
    b = blocks.withColumn("side", column_of(width))
    share = lambda s: F.sum(F.when(F.col("side") == s, F.length("text")).otherwise(0)).over(page) / F.greatest(F.sum(F.length("text")).over(page), F.lit(1))
    b = b.withColumn("two", (share("left") > 0.2) & (share("right") > 0.2))
    down = page.orderBy("y0", "x0", "ord").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("band", F.coalesce(F.sum((F.col("side") == "full").cast("int")).over(down), F.lit(0)))
    place = F.when(F.col("side") == "left", 0).when(F.col("side") == "right", 1).otherwise(2)
    order = [F.when(F.col("two"), F.col("band")).otherwise(0), F.when(F.col("two"), place).otherwise(0), F.round("y0", 1), "x0", "ord"]
    return b.withColumn("pos", (F.row_number().over(page.orderBy(*order)) - 1).cast("long")).drop("two", "band")


def captions(sized: DataFrame) -> DataFrame:
    """Caption blocks of ``sized(..., body_size)`` with ``kind`` and ``label``; a mention that opens a sentence is none."""
    g = lambda k: F.regexp_extract("text", CAPTION, k)
    is_caption = (g(2) != "") & (g(4) == "") & ((g(5) != "") | F.col("bold") | (F.col("size") < F.col("body_size") - 0.3))
    kind = F.when(F.lower(g(2)).startswith("fig"), "Figure").otherwise("Table")
    number = F.upper(g(3))
    number = F.when((g(1) != "") & ~number.startswith("S"), F.concat(F.lit("S"), number)).otherwise(number)
    return sized.where(is_caption).withColumn("kind", kind).withColumn("label", F.concat(kind, F.lit(" "), number))


def first_visuals(found: DataFrame) -> DataFrame:
    """The first caption of each label."""
    w = Window.partitionBy("doc_id", "label").orderBy("page", "ord")
    return found.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def roles(blocks: DataFrame) -> DataFrame:
    """Ordered blocks with ``role``: furniture before caption before equation before body."""
    b = furniture(blocks).join(body_size(blocks), "doc_id")
    g = lambda k: F.regexp_extract("text", CAPTION, k)
    caption = (g(2) != "") & (g(4) == "") & ((g(5) != "") | F.col("bold") | (F.col("size") < F.col("body_size") - 0.3))
    equation = (F.regexp_extract("text", EQUATION, 2) != "") & (T.word_count(F.col("text")) <= 40) & F.regexp_extract("text", EQUATION, 1).rlike(MATH)
    return reading_order(b.withColumn("role", F.when(F.col("is_furniture"), "furniture").when(caption, "caption").when(equation, "equation").otherwise("body")))


def headings(with_roles: DataFrame) -> DataFrame:
    """Body blocks that are headings, with ``level``, ``title`` and ``kind``."""
    t = F.trim("text")
    n, stripped = T.word_count(t), T.strip_numbering(t)
    upper = lambda c: (F.upper(c) == c) & (F.lower(c) != c)
    kind = T.section_kind(t)
    strong = F.col("bold") | (F.col("size") >= F.col("body_size") * 1.08) | (upper(t) & (n <= 6))
    number = F.regexp_extract(t, NUMBERED, 1)
    digit = lambda c: c.rlike("^[0-9]")
    dots = lambda c: F.length(c) - F.length(F.replace(c, F.lit("."), F.lit(""))) + 1
    bare = F.rtrim(number, F.lit(".)"))
    named = kind.isNotNull() & strong & (T.word_count(stripped) <= 7) & ~t.rlike("[,;]$")
    numbered = (number != "") & strong & ~t.rlike("[.,;]$") & (n <= 12)
    large = (F.col("size") >= F.col("body_size") * 1.2) & F.col("bold") & (n <= 10) & ~t.rlike("[.,]$")
    level = (
        F.when(named, F.when((number != "") & digit(t), dots(F.substring_index(t, " ", 1))).otherwise(1))
        .when(numbered, F.when(digit(bare), dots(bare)).otherwise(1))
        .when(large, 1)
    )
    title = F.when(named & upper(stripped), F.initcap(stripped)).otherwise(stripped)
    body = with_roles.where((F.col("role") == "body") & (n <= 14) & (F.length(t) >= 3))
    if "n_lines" in body.columns:
        body = body.where(F.coalesce("n_lines", F.lit(1)) <= 2)
    return body.withColumn("level", level.cast("long")).where("level IS NOT NULL").withColumn("level", F.least("level", F.lit(3).cast("long"))).withColumn("title", title).withColumn("kind", F.coalesce(kind, F.lit("other")))


def sectioned(with_roles: DataFrame) -> DataFrame:
    """Body blocks with their section: ``section_idx`` (0 is the front matter), ``section``, ``section_kind``, ``level``, ``is_heading``."""
    h = headings(with_roles).select("doc_id", "page", "ord", "level", "title", "kind")
    b = with_roles.where("role = 'body'").join(h, ["doc_id", "page", "ord"], "left")
    order = Window.partitionBy("doc_id").orderBy("page", "pos")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    top_kind = F.last(F.when(F.col("level") == 1, F.col("kind")), ignorenulls=True).over(before)
    own = F.when((F.col("level") > 1) & (F.col("kind") == "other"), F.coalesce(top_kind, F.lit("other"))).otherwise(F.col("kind"))
    b = b.withColumn("is_heading", F.col("level").isNotNull()).withColumn("own_kind", own)
    last = lambda c: F.last(c, ignorenulls=True).over(upto)
    return b.select(
        "doc_id", "page", "pos", "ord", "x0", "y0", "x1", "y1", "text", "size", "is_heading",
        F.sum(F.col("is_heading").cast("long")).over(upto).alias("section_idx"),
        F.coalesce(last("title"), F.lit("Front matter")).alias("section"),
        F.coalesce(last("own_kind"), F.lit("front")).alias("section_kind"),
        F.coalesce(last("level"), F.lit(0).cast("long")).alias("level"),
    )


def sections(in_sections: DataFrame) -> DataFrame:
    """One row a section with its first and last page."""
    return in_sections.groupBy("doc_id", "section_idx", "section", "section_kind", "level").agg(F.min("page").cast("long").alias("page_start"), F.max("page").cast("long").alias("page_end"))


def outline(found: DataFrame) -> DataFrame:
    """An indented list of sections for each document, without front matter."""
    line = F.concat(F.repeat(F.lit("  "), F.greatest(F.col("level") - 1, F.lit(0)).cast("int")), F.lit("- "), "section", F.lit(" (p. "), (F.col("page_start") + 1).cast("string"), F.lit(")"))
    rows = found.where("section_kind <> 'front'").select("doc_id", F.struct("section_idx", line.alias("line")).alias("x"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("outline"))


def paragraphs(in_sections: DataFrame) -> DataFrame:
    """Texts of sections: short scraps dropped, continuations merged into the paragraph before, whose box counts.

    A block goes on with the paragraph before it in its section if that doesn't end a sentence, a bracket or a quotation and it begins in lower case.
    """
    p = in_sections.where("NOT is_heading").where((F.length("text") >= 25) | (T.word_count(F.col("text")) >= 4))
    order = Window.partitionBy("doc_id", "section_idx").orderBy("page", "pos")
    goes_on = ~F.lag("text").over(order).rlike(r'[.!?:;)"”]\s*$') & F.col("text").rlike(r"^\p{Ll}")
    p = p.withColumn("starts", (~F.coalesce(goes_on, F.lit(False))).cast("long"))
    p = p.withColumn("paragraph", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    box = [c for c in ("x0", "y0", "x1", "y1") if c in p.columns]
    parts = F.array_sort(F.collect_list(F.struct("page", "pos", "text", *box)))
    merged = p.groupBy("doc_id", "section_idx", "section", "section_kind", "paragraph").agg(parts.alias("parts"))
    return merged.select(
        "doc_id", "section_idx", "section", "section_kind", "paragraph", F.get("parts", 0)["page"].cast("long").alias("page"), F.array_join(F.transform("parts", lambda x: x["text"]), " ").alias("text"),
        *(F.get("parts", 0)[c].alias(c) for c in box),
    )


def equations(with_roles: DataFrame) -> DataFrame:
    """``(doc_id, page, pos, label, number, text, box)`` of the blocks whose role is equation: the number stands in brackets at the end."""
    g = lambda k: F.regexp_extract("text", EQUATION, k)
    found = with_roles.where("role = 'equation'")
    return found.select("doc_id", "page", "pos", F.concat(F.lit("Equation "), g(2)).alias("label"), g(2).alias("number"), g(1).alias("text"), *(c for c in ("x0", "y0", "x1", "y1") if c in found.columns))


def abstracts(merged: DataFrame) -> DataFrame:
    """The paragraphs of kind abstract; else the first of the front matter with 60 words."""
    parts = merged.select("doc_id", F.struct("section_idx", "paragraph", "text").alias("x"), (F.col("section_kind") == "abstract").alias("own"), ((F.col("section_kind") == "front") & (T.word_count(F.col("text")) >= 60)).alias("front"))
    by = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("own"), F.col("x")))).alias("own"), F.min(F.when(F.col("front"), F.col("x"))).alias("front"))
    return by.select("doc_id", F.when(F.size("own") > 0, F.array_join(F.transform("own", lambda x: x["text"]), " ")).otherwise(F.col("front.text")).alias("abstract")).where("abstract IS NOT NULL")


def titles(with_roles: DataFrame, height: float = HEIGHT) -> DataFrame:
    """``(doc_id, title)``: the largest body text in the top half of the first page."""
    n = T.word_count(F.col("text"))
    c = with_roles.where((F.col("page") == 0) & (F.col("role") == "body") & (F.col("y0") < height * 0.5) & (n >= 2) & (n <= 45))
    c = c.withColumn("top", F.max("size").over(Window.partitionBy("doc_id"))).where((F.col("size") >= F.col("top") - 0.6) & (F.col("top") >= F.col("body_size") * 1.2))
    by = c.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))).alias("parts"))
    return by.select("doc_id", F.trim(F.array_join(F.transform("parts", lambda x: x["text"]), " ")).alias("title"))


def mention_edges(blocks: DataFrame) -> DataFrame:
    """``(doc_id, page, ord, label)``: which block mentions which visual."""
    return blocks.select("doc_id", "page", "ord", F.explode(T.mentions(F.col("text"))).alias("label"))


def mention_sentences(merged: DataFrame, most: int = 3) -> DataFrame:
    """The first ``most`` sentences of up to 70 words that mention each label, outside front matter and references."""
    s = merged.where("section_kind NOT IN ('front', 'references')").select("doc_id", "section_idx", "paragraph", F.posexplode(T.sentences(F.col("text"))).alias("i", "sentence"))
    s = s.where(T.word_count(F.col("sentence")) <= 70).select("*", F.explode(T.mentions(F.col("sentence"))).alias("label"))
    s = s.where(~F.startswith(F.lower("sentence"), F.concat(F.lower("label"), F.lit("."))))
    w = Window.partitionBy("doc_id", "label").orderBy("section_idx", "paragraph", "i")
    return s.withColumn("n", F.row_number().over(w).cast("long")).where(F.col("n") <= most).select("doc_id", "label", "n", F.trim("sentence").alias("sentence"))


def abstract_run_in(with_roles: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of paragraphs that open with the word Abstract before any heading, with over 80 characters after it."""
    h = headings(with_roles).select("doc_id", "page", "ord", F.lit(True).alias("is_heading"))
    b = with_roles.where("role = 'body'").join(h, ["doc_id", "page", "ord"], "left")
    before = F.count("is_heading").over(Window.partitionBy("doc_id").orderBy("page", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rest = F.regexp_replace("text", r"(?i)^\s*abstract\b[\s\-–—:.]*", "")
    return b.withColumn("n", before).where((F.col("n") == 0) & F.col("text").rlike(r"(?i)^\s*abstract\b") & (F.length(rest) > 80)).select("doc_id", F.trim(rest).alias("text"))


def warnings(pages: DataFrame, with_text: DataFrame, references: DataFrame, figures: DataFrame) -> DataFrame:
    """What parsing missed in each document: pages without text, no references, no captioned figures."""
    count = lambda d, c: d.groupBy("doc_id").agg(F.count("*").alias(c))
    blank = count(pages.join(with_text.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti"), "blank")
    d = pages.select("doc_id").distinct().join(blank, "doc_id", "left").join(count(references, "refs"), "doc_id", "left").join(count(figures, "figs"), "doc_id", "left")
    found = F.array_compact(
        F.array(
            F.when(F.col("blank") > 0, F.concat(F.col("blank").cast("string"), F.lit(" page(s) without text"))),
            F.when(F.col("refs").isNull(), "no references found"),
            F.when(F.col("figs").isNull(), "no captioned figures found"),
        )
    )
    return d.select("doc_id", found.alias("warnings"))


def counts(pages: DataFrame, **parts: DataFrame) -> DataFrame:
    """The number of pages and of each of ``parts`` in each document."""
    out = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    for name, d in parts.items():
        out = out.join(d.groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out
