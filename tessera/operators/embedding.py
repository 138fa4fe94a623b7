"""Embedders: a hashing one that needs no model, and the seam for others.

The words and pairs of words of a text come from the same expressions as the sparse index's; only their hashes, which
Spark SQL lacks, and the sums by place are taken in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessera.functions import text as T

DIM = 1024


def features(text: Column) -> Column:
    """The words of a text, then its pairs of neighbouring words."""
    words = T.tokens(F.coalesce(text, F.lit("")))
    return F.concat(words, T.bigrams(words))


@lru_cache(maxsize=1 << 18)
def place(feature: str) -> tuple[int, float]:
    """The 64-bit hash of a feature, and its sign: plus where the highest bit is set."""
    h = int.from_bytes(blake2b(feature.encode(), digest_size=8).digest(), "little")
    return h, 1.0 if h >> 63 else -1.0


#: Texts and features that a worker holds as Python objects at a time, and the bytes that go to it at a time, however large the table.
SLICE, FEATURES, BATCH_BYTES = 256, 1 << 16, 8 << 20


def counts(features: pa.Array, dim: int) -> np.ndarray:
    """The signed counts by hash of one text's features."""
    out = np.zeros(dim)
    for at in range(0, len(features), FEATURES):
        found = [place(f) for f in features.slice(at, FEATURES).to_pylist()]
        np.add.at(out, [h % dim for h, _ in found], [s for _, s in found])
    return out


def vectors(batch: pa.ListArray, dim: int) -> np.ndarray:
    """A row for each list of features: signed counts by hash, dampened by a logarithm, of length one (or zero)."""
    out = np.array([counts(own.values, dim) for own in batch]).reshape(len(batch), dim)
    out = np.copysign(np.log1p(np.abs(out)), out)
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return (out / np.maximum(length, 1e-12)).astype(np.float32)


def hash_embedding(text: Column, dim: int = DIM) -> Column:
    """The hashing embedding of a text; a null text has the zero vector."""
    conf = SparkSession.active().conf
    own = conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    # Read when the plan runs, so it can't be put back here; a session with a smaller one keeps it.
    if own is None or not own.isdigit() or not 0 < int(own) <= BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    @arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            made = np.concatenate([np.zeros((0, dim), np.float32), *(vectors(batch.slice(at, SLICE), dim) for at in range(0, len(batch), SLICE))])
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, dim), pa.int32()), pa.array(made.ravel()))

    return embed(features(text))


EMBEDDERS: dict[str, Callable[..., Column]] = {"hashing": hash_embedding}


def register(name: str, make: Callable[..., Column]) -> None:
    """Adds an embedder: a function from a text column to a vector column."""
    EMBEDDERS[name] = make


def embedder(name: str) -> tuple[Callable[..., Column], str | None]:
    """The embedder of a name, or the hashing one and why."""
    if name in EMBEDDERS:
        return EMBEDDERS[name], None
    return hash_embedding, f"no embedder named {name!r} is available here; using the hashing one"
