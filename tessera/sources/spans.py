"""Blocks from the text spans that a page reader gives, and documents from caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that becomes one space, and white space at the ends of a text as Unicode has it.
SPACES = r"[ \t\u00A0\u2009\u200A\u202F]+"
BLANK_ENDS = r"^[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+|[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+$"


def join_lines(lines: Column) -> Column:
    """Lines as one text, runs of white space as one space: a hyphen between a letter and a lower-case start goes, else a space joins them."""
    clean = F.filter(F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, SPACES, " "), BLANK_ENDS, "")), lambda x: x != "")

    def add(a: Column, x: Column) -> Column:
        broken = a.rlike(r"\p{L}-$") & x.rlike(r"^\p{Ll}")
        return F.when(a == "", x).when(broken, F.concat(F.substring(a, F.lit(1), F.char_length(a) - 1), x)).otherwise(F.concat(a, F.lit(" "), x))

    return F.aggregate(clean, F.lit(""), add)


def blocks(spans: DataFrame) -> DataFrame:
    """``spans(doc_id, page, block, line, ord, text, size, bold, x0, y0, x1, y1)``, with ``dx`` and ``dy`` if known, to layout blocks, as ``blocks_of_lines`` has them."""
    own = [c for c in ("ord", "text", "size", "bold", "x0", "y0", "x1", "y1", "dx", "dy") if c in spans.columns]
    return blocks_of_lines(spans.groupBy("doc_id", "page", "block", "line").agg(F.collect_list(F.struct(*own)).alias("spans")))


def blocks_of_lines(lines: DataFrame) -> DataFrame:
    """``lines(doc_id, page, block, line, spans)``, whose ``spans`` are an array of structs ``(ord, text, size, bold, x0, y0, x1, y1)``, with ``dx`` and ``dy`` if known, to layout blocks.

    Lines that don't run from left to right (``dx`` under 0 or ``dy`` beyond 0.5) are left out. Blank spans part words, but say nothing of size and weight. Characters
    are those of trimmed spans; the size is that of most (to half points, halves to even; of equals the one first seen), bold if over 60 % of them are.
    A block without visible text is left out. The box is that of all spans, of lines left out too. Lines are brought to their text, box and sizes before they are shuffled.
    """
    key = ["doc_id", "page", "block"]
    known = {f.name for f in lines.schema["spans"].dataType.elementType.fields}
    runs = lambda x: (F.coalesce(x["dx"], F.lit(1.0)) >= 0) & (F.abs(F.coalesce(x["dy"], F.lit(0.0))) <= 0.5) if {"dx", "dy"} <= known else F.lit(True)
    n = lambda x: F.coalesce(F.char_length(F.regexp_replace(x["text"], BLANK_ENDS, "")), F.lit(0)).cast("long")
    span = lambda x: F.struct(x["ord"].alias("ord"), F.coalesce(x["text"], F.lit("")).alias("text"), (F.bround(x["size"] * 2) / 2).alias("half"), x["bold"].alias("bold"), runs(x).alias("flat"), n(x).alias("n"))
    edge = lambda f, c: f(F.transform("spans", lambda x: x[c])).alias(c)
    line = lines.select(*key, "line", F.array_sort(F.transform("spans", span)).alias("own"), *(edge(F.array_min, c) for c in ("x0", "y0")), *(edge(F.array_max, c) for c in ("x1", "y1")))
    seen = F.filter("own", lambda x: x["flat"] & (x["n"] > 0))
    total = lambda spans, v: F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + v(x))
    bold = lambda x: F.when(x["bold"], x["n"]).otherwise(F.lit(0).cast("long"))

    def of_size(h: Column) -> Column:
        own = F.filter(F.col("seen"), lambda x: x["half"].eqNullSafe(h))
        return F.struct(F.col("line").alias("line"), own[0]["ord"].alias("ord"), h.alias("half"), total(own, lambda x: x["n"]).alias("chars"), total(own, bold).alias("bold_chars"), own[0]["bold"].alias("bold"), own[0]["text"].alias("text"))

    text = F.array_join(F.transform("own", lambda x: x["text"]), "").alias("text")
    line = line.select(*key, "line", F.exists("own", lambda x: x["flat"]).alias("flat"), text, seen.alias("seen"), "x0", "y0", "x1", "y1")
    line = line.withColumn("sizes", F.transform(F.array_distinct(F.transform("seen", lambda x: x["half"])), of_size)).drop("seen")
    found = line.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.when(F.col("flat"), F.struct("line", "text")))).alias("lines"), F.array_sort(F.flatten(F.collect_list("sizes"))).alias("sizes"),
        *(F.min(c).alias(c) for c in ("x0", "y0")), *(F.max(c).alias(c) for c in ("x1", "y1")),
    ).where(F.size("sizes") > 0)

    def of_block(h: Column) -> Column:
        own = F.filter(F.col("sizes"), lambda x: x["half"].eqNullSafe(h))
        return F.struct(total(own, lambda x: x["chars"]).alias("chars"), (-own[0]["line"]).alias("line"), (-own[0]["ord"]).alias("ord"), h.alias("half"))

    size = F.array_max(F.transform(F.array_distinct(F.transform("sizes", lambda x: x["half"])), of_block))["half"]
    share = total(F.col("sizes"), lambda x: x["bold_chars"]) / total(F.col("sizes"), lambda x: x["chars"])
    first = F.get("sizes", 0)
    return found.select(
        "doc_id", "page", F.col("block").alias("ord"), "x0", "y0", "x1", "y1", join_lines(F.transform("lines", lambda x: x["text"])).alias("text"), size.alias("size"), (share > 0.6).alias("bold"),
        first["bold"].alias("first_bold"), F.regexp_replace(first["text"], BLANK_ENDS, "").alias("first_span"), F.size("lines").alias("n_lines"),
    ).where("text <> ''")


def pages_without_text(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages that need another reader, such as OCR: those without a block."""
    return pages.join(found.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")


def read_pdfs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files whose first 1024 bytes say PDF, by content id, and the others."""
    from tessera.operators.index import content_id
    from tessera.sources.links import is_pdf

    files = spark.read.format("binaryFile").load(path).withColumn("doc_id", content_id(F.col("content")))
    return files.where(is_pdf(F.col("content"))), files.where(~is_pdf(F.col("content")))


def read_documents(spark: SparkSession, path: str, schema: str, version: int, build_key: str) -> DataFrame:
    """Cached documents of a schema version and build key; unreadable and stale ones are left out."""
    found = spark.read.schema(f"{schema}, schema_version int, build_key string").option("mode", "DROPMALFORMED").json(path)
    return found.where((F.col("schema_version") == version) & (F.col("build_key") == build_key))
