"""Intermediate results in the folder that driver and executors share, and logs of what was published in a folder."""

from __future__ import annotations

import json
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

COMMIT = "commit long, name string, first long, rows long"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or the context's. Only a local session may go without: it gets a temporary one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tessera-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared folder, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: compressed, and later reads take the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _log(spark: SparkSession, folder: str) -> tuple:
    """The log of a folder: its path, its file context and Hadoop's classes."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{folder}/log")
    return path, hadoop.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration()), hadoop


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """``(commit, name, first, rows)`` of all that was published in ``folder``, in the order of ``commit``; without a log, none."""
    path, files, _ = _log(spark, folder)
    return spark.read.schema(COMMIT).json(f"{folder}/log") if files.util().exists(path) else spark.createDataFrame([], COMMIT)


def commit(spark: SparkSession, folder: str, name: str, rows: int = 0) -> bool:
    """Publish ``name`` as the next of ``folder``'s log, with the next ``rows`` numbers as its own; False if it was published before.

    A commit is a whole file that is given its number by a rename which fails where that is taken, so of several writers each gets its own, and
    ranges of numbers follow one another without gaps. On a store whose rename isn't atomic only one may write at a time.
    """
    path, files, hadoop = _log(spark, folder)
    files.mkdir(path, None, True)
    while True:
        last = commits(spark, folder).orderBy("commit", ascending=False).limit(1).collect()
        if not commits(spark, folder).where(f"name = '{name}'").isEmpty():
            return False
        number, first = (last[0]["commit"] + 1, last[0]["first"] + last[0]["rows"]) if last else (0, 0)
        draft = hadoop.Path(path, f".{uuid.uuid4()}")
        out = hadoop.FileSystem.get(path.toUri(), spark._jsc.hadoopConfiguration()).create(draft, False)
        out.write(json.dumps({"commit": number, "name": name, "first": first, "rows": rows}).encode())
        out.close()
        try:
            files.rename(draft, hadoop.Path(path, f"{number:012}.json"), spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
            return True
        except Py4JJavaError as taken:
            files.delete(draft, False)
            if "FileAlreadyExistsException" not in str(taken.java_exception):
                raise
