"""Quality rules with thresholds learnt per language and source from mergeable quantile sketches.

``measures`` reads every whole text once and adds the base measures. ``fences`` counts the values of
each rule by (lang, source, class), where a class is the leading six bits of the value: these counts
are quantile sketches with a relative error of 1/32 which merge by addition in any order. The fences
of a group are ``Q1 - reach * (Q3 - Q1) - slack`` and ``Q3 + reach * (Q3 - Q1) + slack``. A group
under ``min_docs`` documents takes the fences of its language, and a language under ``min_docs``
those of the whole corpus: these are the same counts, merged. ``judge`` joins the fences to the
documents on (lang, source).

The counts are pre-aggregated before their shuffle, so a hot source costs a row a task and class.
The fences are one row a (lang, source); Spark broadcasts them only where their measured size allows it
and otherwise splits the hot source's rows of the join.

Defined cases: a null or empty text has no words and fails the base rules; null languages and
sources are groups of their own (matched null-safe); repeated rows are judged alike, each counting in
the sketches; an empty table gives no rows; texts of any length are read whole, those over
``LONG_WORDS`` words in numpy; other columns pass, and names of the added columns are prefixed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import beside, map_batches, packed, packed_kind, size_class

P = "quality_"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
LONG_WORDS = 20_000
#: Rules: name, value in thousandths of the base, slack in thousandths.
RULES = (
    ("word_length", "word_chars", "n_words", 1500),
    ("symbols", "n_symbols", "n_words", 300),
    ("dup_lines", "n_dup_lines", "n_lines", 300),
    ("repeats", "n_repeat_words", "n_words", 150),
)
REACH, MIN_DOCS = 3, 100


def _repeats(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    if len(words) <= LONG_WORDS:
        seen = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        if len(set(seen)) == n:
            return 0
        times = Counter(seen)
        hit = np.fromiter((times[x] > 1 for x in seen), bool, n)
    else:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        names = ids[:n]
        for i in range(1, WINDOW):
            names = np.unique(names * (len(number) + 1) + ids[i : i + n], return_inverse=True)[1].astype(np.int64)
        hit = np.bincount(names)[names] > 1
    at = np.zeros(len(words) + 1, np.int64)
    np.add.at(at, np.flatnonzero(hit), 1)
    np.add.at(at, np.flatnonzero(hit) + WINDOW, -1)
    return int((np.cumsum(at)[:-1] > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode()
    words = raw.split()
    spaces = len(raw) - sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    return (
        len(words),
        len(text) - spaces,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeats(words),
        len(lines),
    )


def measures(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``docs`` (or its columns ``keep``) with the base measures in columns ``quality_*``."""
    keep = docs.columns if keep is None else keep
    given = packed(docs, keep, F.col(text).alias(f"{P}text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [measure(x.as_py()) for x in b.column(b.num_columns - 1)]
            cols = list(zip(*got, strict=True)) or [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays(b.columns[:-1] + [pa.array(c, pa.int64()) for c in cols], ["kept", *(P + m for m in MEASURES)])

    return beside(map_batches(given, run, packed_kind(given, ", ".join(f"{P}{m} bigint" for m in MEASURES))), keep)


def base_failed(of: Callable[[str], Column] = F.col) -> Column:
    n = of(f"{P}n_words")
    return (n < 10) | (of(f"{P}n_repeat_words") * 100 > n * 20)


def _value(top: str, base: str, of: Callable[[str], Column] = F.col) -> Column:
    return F.floor(of(P + top) * 1000 / F.greatest(of(P + base), F.lit(1))).cast("long")


def fences(measured: DataFrame, reach: int = REACH, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(lang, source, quality_fences)``; the fences are a struct of (low, high) by rule."""
    cells = (
        measured.where(~base_failed())
        .select("lang", "source", F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), size_class(_value(top, base)).alias("cell")) for k, (_, top, base, _) in enumerate(RULES)))).alias("x"))
        .groupBy("lang", "source", "x.rule", "x.cell")
        .agg(F.count("*").alias("n"))
    )

    def quartiles(counts: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by, "rule").orderBy("cell")
        total = F.sum("n").over(Window.partitionBy(*by, "rule"))
        at = counts.select(*by, "rule", "cell", F.sum("n").over(w).alias("upto"), total.alias("docs"))
        q = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("docs") * k, F.col("cell")))
        return at.groupBy(*by, "rule").agg(q(1).alias("q1"), q(3).alias("q3"), F.max("docs").alias("docs"))

    own = quartiles(cells, ["lang", "source"])
    by_lang = quartiles(cells.groupBy("lang", "rule", "cell").agg(F.sum("n").alias("n")), ["lang"])
    of_all = quartiles(cells.groupBy("rule", "cell").agg(F.sum("n").alias("n")), [])
    a, b, c = own.alias("a"), by_lang.alias("b"), of_all.alias("c")
    best = (
        a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang")) & (F.col("a.rule") == F.col("b.rule")))
        .join(c, F.col("a.rule") == F.col("c.rule"))
        .select(
            "a.lang", "a.source", "a.rule",
            *(F.when(F.col("a.docs") >= min_docs, F.col(f"a.{q}")).when(F.col("b.docs") >= min_docs, F.col(f"b.{q}")).otherwise(F.col(f"c.{q}")).alias(q) for q in ("q1", "q3")),
        )
    )
    slack = F.get(F.array(*(F.lit(s) for *_, s in RULES)), F.col("rule"))
    spread = (F.col("q3") - F.col("q1")) * reach + slack
    return (
        best.select("lang", "source", "rule", F.struct((F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high")).alias("fence"))
        .groupBy("lang", "source")
        .agg(F.struct(*(F.max(F.when(F.col("rule") == k, F.col("fence"))).alias(name) for k, (name, *_) in enumerate(RULES))).alias(f"{P}fences"))
    )


def judge(measured: DataFrame, learnt: DataFrame) -> DataFrame:
    """``measured`` with ``quality_base_failed`` and ``quality_kept``."""
    f = learnt.select("lang", "source", F.col(f"{P}fences").alias("fences"))
    own = F.col("kept").getField
    both = packed(measured, measured.columns).join(f, own("lang").eqNullSafe(F.col("lang")) & own("source").eqNullSafe(F.col("source")), "left")
    inside = F.lit(True)
    for name, top, base, _ in RULES:
        fence = F.col("fences")[name]
        inside = inside & F.coalesce((_value(top, base, own) >= fence["low"]) & (_value(top, base, own) <= fence["high"]), F.lit(True))
    failed = base_failed(own)
    return beside(both.select("kept", failed.alias(f"{P}base_failed"), (~failed & inside).alias(f"{P}kept")), measured.columns)
