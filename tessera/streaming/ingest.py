"""Incremental ingest: new or changed documents only, from any number of streams."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.index import stale, table_or_none
from tessera.store import commit, commits


def ingest(documents: DataFrame, folder: str, checkpoint: str, build: Callable[[DataFrame], DataFrame], build_key: str) -> StreamingQuery:
    """Run ``build`` on the documents of a stream whose last fingerprint in ``folder`` is another, and add its rows there.

    A batch is named by its stream, by the id that Spark keeps in the checkpoint, and its number. It writes its rows to ``rows/batch=NAME`` and its
    fingerprints to ``fingerprints/batch=NAME``, and then publishes its name in the folder's log, whose order is that of all streams.
    Only published batches count. A batch that runs again replaces what it left unpublished, and does nothing once it is published, so nothing is there twice
    and no stream touches another's rows. Rows of a changed document's earlier batches stay as history; ``current`` leaves them out. Of two texts
    of one document in a batch the one of the larger fingerprint counts. A batch that is cancelled or fails publishes nothing.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        name = f"{stream}-{number}"
        if not commits(spark, folder).where(F.col("name") == name).isEmpty():
            return
        named = batch.withColumn("fingerprint", F.concat_ws("|", F.lit(build_key), F.sha2("text", 256)))
        one = named.groupBy("doc_id").agg(F.max_by(F.struct(*named.columns), "fingerprint").alias("x")).select("x.*")
        known = last_fingerprints(spark, folder)
        new = one if known is None else stale(one, known)
        build(new).write.mode("overwrite").parquet(f"{folder}/rows/batch={name}")
        new.select("doc_id", "fingerprint").write.mode("overwrite").parquet(f"{folder}/fingerprints/batch={name}")
        commit(spark, folder, name)

    return documents.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_fingerprints(spark: SparkSession, folder: str) -> DataFrame | None:
    """``(doc_id, commit, batch, fingerprint)``: the last published of each document."""
    known = table_or_none(spark, f"{folder}/fingerprints")
    if known is None:
        return None
    known = known.join(commits(spark, folder).select("commit", F.col("name").alias("batch")), "batch")
    return known.groupBy("doc_id").agg(F.max(F.struct("commit", "batch", "fingerprint")).alias("x")).select("doc_id", "x.*")


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of each document's last published batch; ``build`` must keep ``doc_id``."""
    last = last_fingerprints(spark, folder)
    if last is None:
        raise FileNotFoundError(f"nothing was published in {folder}")
    return spark.read.parquet(f"{folder}/rows").join(last.select("doc_id", "batch"), ["doc_id", "batch"], "left_semi").drop("batch")
