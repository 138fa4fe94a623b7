"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.store import checkpointed, shared_folder

__all__ = ["WORD", "ascii_lower", "beside", "checkpointed", "map_batches", "packed", "packed_kind", "shared_folder", "size_class", "table", "word_count"]

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def word_count(c: Column) -> Column:
    """The number of words of a text; null counts as no words."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


#: Rows go to Python in batches of up to so many bytes, however long single rows are.
BATCH_BYTES = 8 << 20


def packed(docs: DataFrame, keep: list[str], *others: Column) -> DataFrame:
    """``docs``' columns ``keep`` as one, ``kept``, so that none of their names meets one of an operator's own, and ``others``."""
    return docs.select(F.struct(*keep).alias("kept"), *others)


def packed_kind(given: DataFrame, added: str) -> StructType:
    return StructType([given.schema["kept"], *StructType.fromDDL(added).fields])


def beside(made: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns beside the others; a kept one of the name of another gives way to it."""
    names = [c for c in made.columns if c != "kept"]
    return made.select(*(F.col("kept")[c].alias(c) for c in keep if c not in names), *names)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kind: str | StructType) -> DataFrame:
    """``df.mapInArrow`` in batches of bounded bytes; a worker gives its memory back when a partition is done."""
    with contextlib.suppress(ValueError, TypeError):
        # The setting is read when the plan runs, so it can't be put back here; a session with a smaller one keeps it.
        own = df.sparkSession.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
        if own is None or int(own) > BATCH_BYTES or int(own) <= 0:
            df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(task, kind)


def size_class(v: Column, bits: int = 6) -> Column:
    """The log-linear class of a non-negative integer: its leading ``bits`` bits, the others zero.

    Values under ``2**bits`` are classes of their own; above, a class is at most ``2**(1-bits)``
    of its value wide. Counts by class are a quantile sketch that merges by addition, in any order.
    """
    v = v.cast("long")
    shift = F.greatest(F.length(F.bin(v)) - F.lit(bits), F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)
