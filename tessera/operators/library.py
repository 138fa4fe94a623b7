"""Library state as append logs: the latest row of a key counts, removals are rows too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.index import table_or_none
from tessera.store import commit, commits


def latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: combined in each task before the shuffle, so a hot key costs a row a task."""
    return log.groupBy(key).agg(F.max_by(F.struct(*log.columns), F.struct(*order)).alias("last")).select("last.*")


def papers(log: DataFrame) -> DataFrame:
    """``log(doc_id, title, pages, ts)`` folded: first added, last opened, last title and pages."""
    return log.groupBy("doc_id").agg(F.min("ts").alias("added"), F.max("ts").alias("opened"), F.max_by("title", F.struct("ts", "title")).alias("title"), F.max_by("pages", F.struct("ts", "title")).alias("pages"))


def recent(folded: DataFrame, most: int = 10) -> DataFrame:
    return folded.orderBy(F.desc("opened"), "doc_id").limit(most)


def without_removed(rows: DataFrame, removals: DataFrame, key: str) -> DataFrame:
    return rows.join(removals.select(key).distinct(), key, "left_anti")


def highlights(log: DataFrame) -> DataFrame:
    """``log(highlight_id, kind, ts, ...)`` folded: the last row wins, and a last row of kind ``delete`` removes."""
    return latest(log, "highlight_id", ["ts", "event_id"]).where("kind <> 'delete'")


def append_messages(batch: DataFrame, folder: str, name: str) -> int:
    """Append ``batch(doc_id, message_key, role, text, ts, ...)`` to the messages in ``folder`` as the batch ``name``; how many were new.

    Messages whose key was appended before are left out, so a batch that comes again, whole or among others, adds nothing. Each gets its place in
    the batch, in the order of ``ts`` and key; the numbers themselves are a range that the commit of the batch reserves, after all ranges before it.
    So numbers only rise in the order of commits, and of several appenders at once none shares a number with another.
    """
    spark = batch.sparkSession
    if not commits(spark, folder).where(F.col("name") == name).isEmpty():
        return 0
    one = batch.groupBy("doc_id", "message_key").agg(F.min_by(F.struct(*batch.columns), "ts").alias("x")).select("x.*")
    known = messages(spark, folder)
    new = one if known is None else one.join(known.select("doc_id", "message_key"), ["doc_id", "message_key"], "left_anti")
    path = f"{folder}/messages/batch={name}"
    ranged = new.repartitionByRange("ts", "message_key").sortWithinPartitions("ts", "message_key").withColumn("row", F.monotonically_increasing_id())
    ranged.write.mode("overwrite").parquet(path)
    rows = spark.read.parquet(path).count()
    return rows if commit(spark, folder, name, rows) else 0


def messages(spark: SparkSession, folder: str) -> DataFrame | None:
    """All published messages with ``number``; of a key that two appenders took at once the lower number counts."""
    known = table_or_none(spark, f"{folder}/messages")
    if known is None:
        return None
    known = known.join(commits(spark, folder).select("first", "commit", F.col("name").alias("batch")), "batch")
    chunk = F.call_function("shiftright", F.col("row"), F.lit(33))
    known = known.withColumn("chunk", chunk)
    # Rows of a written partition are numbered from its first; partitions are counted in a small table.
    sizes = known.groupBy("batch", "chunk").agg(F.min("row").alias("lowest"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("batch").orderBy("chunk")) - F.col("n")
    numbered = known.join(sizes.withColumn("before", before), ["batch", "chunk"]).withColumn("number", F.col("first") + F.col("before") + F.col("row") - F.col("lowest"))
    own = [c for c in numbered.columns if c not in ("batch", "chunk", "row", "first", "commit", "lowest", "n", "before")]
    return numbered.groupBy("doc_id", "message_key").agg(F.min_by(F.struct(*own), "number").alias("x")).select("x.*")


def last_messages(all_messages: DataFrame, most: int = 200) -> DataFrame:
    """Each document's last ``most`` messages, by ``number``."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("number")))
    return all_messages.withColumn("place", n).where(F.col("place") <= most).drop("place")


def highlight_order(folded: DataFrame) -> DataFrame:
    """Highlights with ``place``, from 1 in each document, oldest first."""
    return folded.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("ts", "highlight_id")).cast("long"))


def active_highlights(folded: DataFrame) -> DataFrame:
    """``(doc_id, n_highlights, n_active)``: how many highlights each document has, and how many of them are used in answers."""
    return folded.groupBy("doc_id").agg(F.count("*").alias("n_highlights"), F.count_if(F.coalesce("use_in_chat", F.lit(True))).alias("n_active"))


def available(folded: DataFrame, files: DataFrame) -> DataFrame:
    """Papers of ``folded(source, ...)`` that can be opened again: those from an address, and those whose file is among ``files(path)``."""
    there = files.select(F.col("path").alias("source")).distinct().withColumn("there", F.lit(True))
    return folded.join(there, "source", "left").where(F.col("source").rlike("(?i)^https?://") | F.col("there")).select(*folded.columns)


def store_files(files: DataFrame, folder: str, name: str) -> int:
    """Keep ``files(doc_id, content)`` that are not kept yet, as the batch ``name``; how many were new. A batch that comes again adds nothing."""
    spark = files.sparkSession
    if not commits(spark, folder).where(F.col("name") == name).isEmpty():
        return 0
    kept = stored_files(spark, folder)
    one = files.groupBy("doc_id").agg(F.min("content").alias("content"))
    new = one if kept is None else one.join(kept.select("doc_id"), "doc_id", "left_anti")
    path = f"{folder}/files/batch={name}"
    new.select("doc_id", "content", F.lit(False).alias("purged")).write.mode("overwrite").parquet(path)
    rows = spark.read.parquet(path).count()
    return rows if commit(spark, folder, name, rows) else 0


def purge(documents: DataFrame, folder: str, name: str) -> None:
    """Drop the files of ``documents(doc_id)`` from now on; they can be kept anew. ``compact_files`` frees their space."""
    gone = documents.select("doc_id", F.lit(None).cast("binary").alias("content"), F.lit(True).alias("purged")).distinct()
    gone.write.mode("overwrite").parquet(f"{folder}/files/batch={name}")
    commit(documents.sparkSession, folder, name)


def stored_files(spark: SparkSession, folder: str) -> DataFrame | None:
    """``(doc_id, content)`` of the files that are kept: each document's last row counts. Only small rows are compared; contents are joined to them."""
    known = table_or_none(spark, f"{folder}/files")
    if known is None:
        return None
    known = known.join(commits(spark, folder).select("commit", F.col("name").alias("batch")), "batch")
    last = known.groupBy("doc_id").agg(F.max(F.struct("commit", "purged", "batch")).alias("x")).where("NOT x.purged").select("doc_id", "x.batch")
    return known.join(last, ["doc_id", "batch"], "left_semi").select("doc_id", "content")


def compact_files(spark: SparkSession, folder: str, into: str) -> None:
    """The files that are kept, alone, in a new folder."""
    kept = stored_files(spark, folder)
    if kept is not None:
        store_files(kept, into, "compacted")


def write_documents(documents: DataFrame, folder: str, version: int, build_key: str) -> None:
    """``documents(doc_id, ...)`` as JSON, a line each, with the schema's version and the build key that ``sources.spans.read_documents`` asks for."""
    documents.withColumn("schema_version", F.lit(version)).withColumn("build_key", F.lit(build_key)).write.mode("append").json(folder)
