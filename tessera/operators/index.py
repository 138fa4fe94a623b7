"""The chunk index as Parquet tables: chunks with vectors, and postings; a document is replaced as a whole.

Every write is a version of its own, under a name that no other writer has. Its rows go to ``chunks/version=NAME``, its documents to
``documents/version=NAME``, and then its name is published in the folder's log, whose order counts. Readers take each document's last published
version, so a write that failed half way adds nothing, and two writers at once don't touch each other's rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import packing, retrieval
from tessera.store import checkpointed, commit, commits

SCHEMA_VERSION = 1


def fingerprint(embedder: str, build_key: Column, n_chunks: Column, most_words: Column) -> Column:
    """What an index depends on; a change of any part asks for a new one."""
    return F.concat_ws("|", F.lit(embedder), build_key, n_chunks.cast("string"), most_words.cast("string"))


def build_key(schema_version: int, **options: object) -> str:
    """What a parsed document depends on: the schema's version and the options of parsing, by name."""
    return "|".join([f"v{schema_version}", *(f"{k}={options[k]}" for k in sorted(options))])


def content_id(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def url_key(url: Column) -> Column:
    return F.substring(F.sha1(url), 1, 16)


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None if nothing was written there yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
        return None


def publish(rows: DataFrame, documents: DataFrame, folder: str) -> str:
    """Write ``rows`` and ``documents(doc_id, ...)`` as a version that replaces these documents, and publish it; its name."""
    name = f"v-{uuid.uuid4()}"
    rows.write.parquet(f"{folder}/chunks/version={name}")
    documents.write.parquet(f"{folder}/documents/version={name}")
    commit(rows.sparkSession, folder, name)
    return name


def write(chunks: DataFrame, folder: str, documents: DataFrame | None = None) -> None:
    """Replace the documents of ``chunks`` (and of ``documents``, which may have lost all chunks); others stay."""
    named = chunks if documents is None else documents
    publish(chunks, named.select("doc_id").distinct(), folder)


def bucketed(chunks: DataFrame, buckets: int = 256) -> DataFrame:
    """``chunks`` with a number by which documents spread over a fixed number of partitions, as one each would be too many."""
    return chunks.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))


def published(spark: SparkSession, folder: str) -> DataFrame | None:
    """The last version of each document, with what was published with it."""
    known = table_or_none(spark, f"{folder}/documents")
    if known is None:
        return None
    known = known.join(commits(spark, folder).select("commit", F.col("name").alias("version")), "version")
    others = [c for c in known.columns if c not in ("doc_id", "commit")]
    last = known.groupBy("doc_id").agg(F.max(F.struct("commit", *others)).alias("last"))
    return last.select("doc_id", *(f"last.{c}" for c in others))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of each document's last version."""
    last = published(spark, folder)
    if last is None:
        raise FileNotFoundError(f"no index in {folder}")
    return spark.read.parquet(f"{folder}/chunks").join(last.select("doc_id", "version"), ["doc_id", "version"], "left_semi").drop("version")


def ordered(spark: SparkSession, folder: str, doc_id: int) -> DataFrame:
    """One document's chunks in their order."""
    return read(spark, folder).where(F.col("doc_id") == doc_id).orderBy("ord")


def compact(spark: SparkSession, folder: str, into: str) -> None:
    """The last versions alone, clustered by bucket, as one version of a new folder."""
    rows = bucketed(read(spark, folder).drop("bucket")).repartition("bucket").sortWithinPartitions("bucket", "doc_id")
    publish(rows, published(spark, folder).drop("version"), into)


def write_postings(chunks: DataFrame, folder: str, buckets: int = 256) -> None:
    """The postings of ``chunks(chunk_id, kind, section_kind, section, label, text)`` and their statistics, for ``retrieval.batch_sparse``.

    Postings lie in a folder for each bucket of terms, sorted by term, so a batch of questions reads the buckets and row groups of its terms. ``terms`` has
    the number of chunks of each term, ``stats`` one row of the corpus's.

    A chunk's terms are counted in the task that reads it, and postings go to their buckets as packed columns, the only shuffle of them; only chunks whose id
    comes again are counted by ``retrieval.postings``, which brings their rows together.
    """
    spark, docs, text = chunks.sparkSession, chunks.withColumnRenamed("chunk_id", "id"), F.concat_ws(" ", "section", "label", "text")
    bucket = lambda t: F.pmod(F.xxhash64(t), F.lit(tasks)).cast("int")
    tasks = buckets * max(1, math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / buckets))
    seen = docs.groupBy("id").agg(F.count("*").alias("rows"))
    known = seen.agg(F.count("*").alias("n"), F.count_if(F.col("rows") > 1).alias("again")).first()
    once, twice, length, extra = docs, None, 0, 0
    if known["again"]:
        again = checkpointed(seen.where("rows > 1").select(F.col("id").alias("again")))
        once, twice = (docs.join(again, F.col("id").eqNullSafe(F.col("again")), how) for how in ("left_anti", "left_semi"))
        twice = checkpointed(retrieval.postings(twice, text, "kind", "section_kind"))
        own = retrieval.corpus_stats(twice).first()
        length, extra = round(own["n"] * own["avg_length"]), twice.agg(F.sum("tf")).first()[0]
    terms = once.select("id", "kind", "section_kind", T.tokens(text).alias("term"))
    packed = terms.withColumn("to", F.transform("term", bucket)).mapInArrow(_counted, packing.PACKED)
    if twice is not None:
        packed = packed.unionByName(packing.packed(twice.where("term IS NOT NULL").withColumn("to", bucket("term"))))
    kind = f"id {docs.schema['id'].dataType.simpleString()}, term string, tf bigint, length bigint, kind string, section_kind string, to int"
    posted = packed.repartitionById(tasks, F.col("to")).mapInArrow(packing.rows_of, kind)
    posted = posted.select("id", "term", "tf", "length", "kind", "section_kind", F.pmod("to", F.lit(buckets)).alias("bucket")).sortWithinPartitions("bucket", "term", "id")
    # Ids of a term go up, so their steps take few bytes.
    posted.write.partitionBy("bucket").options(**{"compression": "zstd", "parquet.writer.version": "v2"}).mode("overwrite").parquet(f"{folder}/postings")
    posted = spark.read.schema(posted.schema).parquet(f"{folder}/postings")
    posted.groupBy("bucket", "term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{folder}/terms")
    # A chunk's length is the sum of its terms' counts.
    total = (posted.agg(F.sum("tf")).first()[0] or 0) - (extra or 0) + length
    stats = (known["n"], total / known["n"] if known["n"] else None, buckets)
    spark.createDataFrame([stats], "n long, avg_length double, buckets int").write.mode("overwrite").parquet(f"{folder}/stats")


#: Terms that are counted at once.
COUNTED = 1_000_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed postings ``(id, term, tf, length, kind, section_kind)`` of rows ``(id, kind, section_kind, term, to)`` with the lists of their terms and of where these go."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.list_value_length(batch.column("term")), 0)).astype(np.int64)
        part = np.cumsum(sizes) // COUNTED
        for first in np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))[: len(part)].tolist():
            rows = batch.slice(first, int(np.searchsorted(part, part[first], "right")) - first)
            own, terms = sizes[first : first + rows.num_rows], rows.column("term").flatten().dictionary_encode()
            if not len(terms):
                continue
            code, n = np.asarray(terms.indices).astype(np.int64), rows.num_rows
            to = np.empty(len(terms.dictionary), np.int64)
            to[code] = np.asarray(rows.column("to").flatten())
            # Terms in the order of where they go; the rows of a term follow one another.
            order = np.argsort(to, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            key, tf = np.unique(place[code] * n + np.repeat(np.arange(n), own), return_counts=True)
            term, row = np.divmod(key, n)
            row, to, words = pa.array(row), to[order][term], terms.dictionary.take(pa.array(order))
            made = {"id": rows.column("id").take(row), "term": words.take(pa.array(term)), "tf": pa.array(tf, pa.int64()), "length": pa.array(own).take(row)}
            table = pa.table(made | {k: rows.column(k).take(row) for k in ("kind", "section_kind")})
            yield from packing.cut(table, to)
            del table, key, tf, term, row, made
        pa.default_memory_pool().release_unused()  # workers wait for the next stage beside those that run


def read_postings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The postings, the terms and the statistics of ``write_postings``."""
    return tuple(spark.read.parquet(f"{folder}/{name}") for name in ("postings", "terms", "stats"))


def stale(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Documents whose fingerprint isn't known yet."""
    return wanted.join(known.select("doc_id", "fingerprint"), ["doc_id", "fingerprint"], "left_anti")
