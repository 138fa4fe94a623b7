"""Cutting section texts into chunks of bounded length, with one sentence carried over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

MOST, LEAST, REFERENCES = 260, 60, 5


def split_long(text: Column, most: int = MOST) -> Column:
    """Pieces of up to ``most`` words of whole sentences; each repeats the last sentence of the one before.

    A text within the limit is one piece. A sentence is never cut, so a piece can be longer.
    """
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), none.alias("cur"), F.lit(0).cast("long").alias("n"))

    def add(a: Column, s: Column) -> Column:
        w = T.word_count(s)
        full = (F.size(a["cur"]) > 0) & (a["n"] + w > most)
        carried = F.slice(a["cur"], F.lit(-1), F.lit(1))
        return F.struct(
            F.when(full, F.concat(a["out"], F.array(F.array_join(a["cur"], " ")))).otherwise(a["out"]).alias("out"),
            F.concat(F.when(full, carried).otherwise(a["cur"]), F.array(s)).alias("cur"),
            (F.when(full, T.word_count(F.get(carried, F.lit(0)))).otherwise(a["n"]) + w).alias("n"),
        )

    close = lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["out"], F.array(F.array_join(a["cur"], " ")))).otherwise(a["out"])
    return F.when(T.word_count(text) <= most, F.array(text)).otherwise(F.aggregate(T.sentences(text), start, add, close))


BOX = ("x0", "y0", "x1", "y1")


def text_chunks(merged: DataFrame, most: int = MOST, least: int = LEAST) -> DataFrame:
    """Chunks of ``merged`` paragraphs: packed within a (section, page) run until the next piece would exceed ``most`` words.

    A chunk of under ``least // 2`` words joins the one before it in its run. A chunk's box, if paragraphs have boxes, is about those of its pieces; what joins it doesn't widen it.
    """
    body = merged.where("section_kind NOT IN ('front', 'abstract', 'references')")
    box = [c for c in BOX if c in merged.columns]
    pieces = body.select("doc_id", "section_idx", "section", "section_kind", "page", "paragraph", *box, F.posexplode(split_long(F.col("text"), most)).alias("i", "piece"))
    pieces = pieces.withColumn("words", T.word_count(F.col("piece")))
    run = pieces.groupBy("doc_id", "section_idx", "section", "section_kind", "page").agg(F.array_sort(F.collect_list(F.struct("paragraph", "i", "piece", "words", *box))).alias("parts"))
    chunk = "struct<text:string" + "".join(f",{c}:double" for c in box) + ">"
    start = F.struct(F.array().cast(f"array<{chunk}>").alias("out"), F.lit(None).cast(chunk).alias("cur"), F.lit(0).cast("long").alias("n"))

    def flushed(a: Column) -> Column:
        """The chunks with what is being packed: a small rest joins the chunk before it in the run."""
        last = F.element_at(a["out"], -1)
        folds = (a["n"] < least // 2) & (F.size(a["out"]) > 0)
        folded = F.concat(F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1), F.array(last.withField("text", F.concat_ws(" ", last["text"], a["cur"]["text"]))))
        return F.when(folds, folded).otherwise(F.concat(a["out"], F.array(a["cur"])))

    def pack(a: Column, p: Column) -> Column:
        full = (a["n"] > 0) & (a["n"] + p["words"] > most)
        own = F.struct(p["piece"].alias("text"), *(p[c].cast("double").alias(c) for c in box)).cast(chunk)
        side = lambda c: (F.least if c in ("x0", "y0") else F.greatest)(a["cur"][c], p[c].cast("double")).alias(c)
        grown = F.struct(F.concat_ws(" ", a["cur"]["text"], p["piece"]).alias("text"), *map(side, box)).cast(chunk)
        return F.struct(F.when(full, flushed(a)).otherwise(a["out"]).alias("out"), F.when(full | (a["n"] == 0), own).otherwise(grown).alias("cur"), (F.when(full, 0).otherwise(a["n"]) + p["words"]).alias("n"))

    chunks = run.select("doc_id", "section_idx", "section", "section_kind", "page", F.posexplode(F.aggregate("parts", start, pack, flushed)).alias("i", "c"))
    ord_ = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_idx", "page", "i")) - 1
    text = F.trim("c.text")
    return chunks.select("doc_id", ord_.cast("long").alias("ord"), F.lit("text").alias("kind"), "page", "section", "section_kind", text.alias("text"), T.mentions(text).alias("refs"), *(f"c.{c}" for c in box))


def abstract_chunks(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lit("abstract").alias("kind"), F.col("abstract").alias("text"), T.mentions(F.col("abstract")).alias("refs"))


#: Characters of a table's Markdown that its chunk has.
MARKDOWN = 3000


def visual_chunks(visuals: DataFrame, said: DataFrame) -> DataFrame:
    """A chunk for each visual: its caption, the start of its ``markdown`` if it has one, and the sentences that mention it. Other columns pass."""
    by = said.groupBy("doc_id", "label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "sentence"))), lambda x: x["sentence"]), " ").alias("said"))
    cells = F.coalesce(F.concat(F.lit("\n"), F.substring(F.nullif("markdown", F.lit("")), 1, MARKDOWN)), F.lit("")) if "markdown" in visuals.columns else F.lit("")
    text = F.concat("caption", cells, F.coalesce(F.concat(F.lit("\nReferred to in the text: "), "said"), F.lit("")))
    others = [c for c in visuals.columns if c not in ("doc_id", "label", "caption", "markdown")]
    return visuals.join(by, ["doc_id", "label"], "left").select("doc_id", "label", text.alias("text"), *others)


def reference_chunks(references: DataFrame, each: int = REFERENCES) -> DataFrame:
    """References, ``each`` to a chunk, on the page of the first."""
    line = F.concat(F.lit("["), F.col("index").cast("string"), F.lit("] "), "text")
    by = references.groupBy("doc_id", F.floor((F.col("index") - 1) / each).cast("long").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("index", line.alias("line"), "page"))).alias("x"))
    return by.select("doc_id", "chunk", F.array_join(F.transform("x", lambda t: t["line"]), "\n").alias("text"), F.get("x", 0)["page"].alias("page"))


def with_ids(chunks: DataFrame) -> DataFrame:
    """``chunk_id``: the first eight characters of the document's id and a number of four digits at least."""
    return chunks.withColumn("chunk_id", F.concat(F.substring(F.col("doc_id").cast("string"), 1, 8), F.lit("-"), F.format_string("%04d", "ord")))


#: The order in which a document's chunks are numbered.
KINDS = ("abstract", "text", "figure", "table", "equation", "reference")


def records(text: DataFrame, abstract: DataFrame | None = None, figures: DataFrame | None = None, tables: DataFrame | None = None, equations: DataFrame | None = None, references: DataFrame | None = None) -> DataFrame:
    """All chunks of documents in one shape: ``(doc_id, chunk_id, ord, kind, page, section, section_kind, label, text, refs, box)``.

    ``text`` are ``text_chunks``, ``abstract`` ``(doc_id, page, text)``, ``figures`` and ``tables`` ``visual_chunks`` with ``page`` and ``place``, ``equations`` those of ``layout.equations``, and
    ``references`` ``reference_chunks``. A document's chunks are numbered through, kind by kind, and within a kind by their own order: one sort of each document's chunks.
    """

    def shaped(df: DataFrame, kind: str, text: Column, order: Column, page: Column, section: Column, section_kind: Column, label: Column) -> DataFrame:
        own = [F.col(c).cast("double").alias(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in BOX]
        return df.select("doc_id", F.lit(kind).alias("kind"), order.alias("place"), page.cast("long").alias("page"), section.alias("section"), section_kind.alias("section_kind"), label.alias("label"), F.trim(text).alias("text"), *own)

    none, c = F.lit(None).cast("string"), F.col
    parts = [shaped(text, "text", c("text"), F.struct(F.lit(0).cast("long").alias("a"), c("ord").cast("long").alias("b")), c("page"), c("section"), c("section_kind"), none)]
    at = lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    if abstract is not None:
        parts.append(shaped(abstract, "abstract", c("text"), at(F.lit(0), F.lit(0)), c("page"), F.lit("Abstract"), F.lit("abstract"), none))
    for kind, found in (("figure", figures), ("table", tables)):
        if found is not None:
            parts.append(shaped(found, kind, c("text"), at(c("page"), c("place")), c("page"), F.lit(kind.capitalize()), F.lit(kind), c("label")))
    if equations is not None:
        parts.append(shaped(equations, "equation", F.concat("label", F.lit(": "), "text"), at(c("page"), c("pos")), c("page"), F.lit("Equation"), F.lit("equation"), c("label")))
    if references is not None:
        parts.append(shaped(references, "reference", c("text"), at(F.lit(0), c("chunk")), c("page"), F.lit("References"), F.lit("references"), none))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(rank, "place")) - 1
    numbered = with_ids(whole.withColumn("ord", number.cast("long")))
    return numbered.select("doc_id", "chunk_id", "ord", "kind", "page", "section", "section_kind", "label", "text", T.mentions(F.col("text")).alias("refs"), *BOX)


def embedding_text(title: Column, section: Column, label: Column, text: Column) -> Column:
    """What an embedder reads: title, section and label as a header line."""
    part = lambda c: F.nullif(c, F.lit(""))
    head = F.concat_ws(" | ", part(F.substring(title, 1, 120)), part(section), part(label))
    return F.when(head != "", F.concat(head, F.lit("\n"), text)).otherwise(text)
