"""Spelling variants: words that differ by one inserted, deleted or replaced code point, and the form that each leads to.

``count_words`` counts the letter runs of whole texts. ``variants`` finds near words by their deletions: two words of one length are near if they
are equal without the code point at one and the same place, and two whose lengths differ by one if the longer without one code point is the shorter.
So each word is entered once whole and once for each place; entries that leave the same string meet.

An entry is a 64-bit integer. With ``P`` a word's polynomial prefix hash and ``S`` the rest of the whole hash, the key of the word without the code point
at ``i`` is ``P[i] + S[i + 1] / B`` modulo 2^64 (``B`` is odd, so it can be divided by): NumPy makes all keys of a batch of words from one running sum.
Keys are dealt out by their leading bits, as many as leave about ``RADIX`` entries a group, sorted there, and the few that meet are
verified: entries meet if the strings that they leave are equal, not just their keys.

At one place a string has at most one word for each letter of the alphabet, so groups are small whatever the number of words. Even so no list of pairs is
made: of each group a word takes the number of the others and the most frequent of them, and these are summed up for each word.
Words longer than ``LONG`` code points would carry themselves into an entry for each of their places. Theirs go by number, and only the pairs
whose keys meet fetch the strings, once each, to be verified.

Forms are followed by pointer jumping; counts at least double along a chain, so a handful of rounds is enough.

Defined cases: null and empty texts have no words; a null id counts as an empty one; repeated rows count each; of near words alike in count the first in the order of
code points is the form; words of any length take part; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, map_batches
from tessera.store import stored

LETTERS = "[A-Za-zÀ-ÿ]+"
#: Code points of a text that are searched at once; distinct words and their code points that a task counts before it hands them on.
SLICE, WORDS, CHARACTERS = 1 << 20, 1 << 17, 1 << 23
#: Longest words whose entries carry the word; entries of a group.
LONG, RADIX = 64, 1 << 15
BASE = 0x9E3779B97F4A7C15


def _slices(text: str, run: re.Pattern) -> Iterator[str]:
    """The text in slices that end between runs."""
    at = 0
    while at < len(text):
        to = at + SLICE
        more = run.match(text, to)
        to = more.end() if more else to
        yield text[at:to]
        at = to


def count_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", drop_every: int | None = None, length: int = 5, least: int = 3) -> DataFrame:
    """``(word, n)``: the letter runs of all texts, A-Z lower-cased, of at least ``length`` code points and ``least`` occurrences.

    With ``drop_every``, a run of a document loses a code point where that divides the CRC-32 of ``<doc_id>:<run>``, as a stand-in for misspellings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, counts, size = re.compile(LETTERS), Counter(), 0

        def counted() -> Iterator[pa.RecordBatch]:
            words, ns = list(counts), list(counts.values())
            for at in range(0, len(words), 1 << 14):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + (1 << 14)], pa.string()), pa.array(ns[at : at + (1 << 14)], pa.int64())], ["word", "n"])
            counts.clear()

        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                if not t.is_valid:
                    continue
                start = crc32(f"{i.as_py()}:".encode() if i.is_valid else b":")
                for part in _slices(t.as_py().encode().lower().decode(), letters):
                    for w, n in Counter(letters.findall(part)).items():
                        if drop_every and not (h := crc32(w.encode(), start)) % drop_every:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                        if len(w) >= length:
                            if w not in counts:
                                size += len(w)
                            counts[w] += n
                if len(counts) > WORDS or size > CHARACTERS:
                    yield from counted()
                    size = 0
        yield from counted()

    found = map_batches(docs.select(F.col(doc_id).cast("string").alias("i"), F.col(text).alias("t")), run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word, whole (place -1) and without each of its code points: key, word, place, and whether the place begins a run of its code point.

    Two places of a word leave the same string just if they are in one run, so the first of each run stands for all strings that it can leave.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), lengths)
    first = np.concatenate(([0], np.cumsum(lengths)))
    place = np.arange(len(codes)) - first[word]
    powers = np.concatenate((np.ones(1, np.uint64), np.full(max(0, int(lengths.max(initial=1)) - 1), BASE, np.uint64))).cumprod(dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * powers[place], dtype=np.uint64)))
    begin, end, here = sums[first[:-1]], sums[first[1:]], np.arange(len(codes))
    rest = (sums[here] - begin[word]) + (end[word] - sums[here + 1]) * np.uint64(pow(BASE, -1, 1 << 64))
    keys = np.concatenate((end - begin + lengths.astype(np.uint64) * np.uint64(BASE), rest + (lengths[word] - 1).astype(np.uint64) * np.uint64(BASE)))
    starts = np.ones(len(codes), bool)
    starts[1:] = (codes[1:] != codes[:-1]) | (word[1:] != word[:-1])
    return _mixed(keys), np.concatenate((np.arange(len(words)), word)), np.concatenate((np.full(len(words), -1), place)), np.concatenate((np.ones(len(words), bool), starts))


def _entered(words: DataFrame, carry: str, kind: str) -> DataFrame:
    """``(radix, key, place, starts, carry, n)`` for each entry of ``words(word, carry, n)``, ``radix`` the leading bits of the key."""
    entries = words.agg(F.coalesce(F.sum(F.char_length("word") + 1), F.lit(0))).first()[0]
    bits = max(0, math.ceil(math.log2(max(entries, 1) / RADIX)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1 << 12):
                part = b.slice(at, 1 << 12)
                keys, word, place, starts = deletion_keys(part.column(0).to_pylist())
                for lo in range(0, len(keys), 1 << 15):
                    to = slice(lo, lo + (1 << 15))
                    own = pa.array(word[to])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((keys[to] >> np.uint64(64 - bits) if bits else keys[to] * np.uint64(0)).astype(np.int64)), pa.array(keys[to].view(np.int64)), pa.array(place[to].astype(np.int32)),
                         pa.array(starts[to]), part.column(1).take(own), part.column(2).take(own)],
                        ["radix", "key", "place", "starts", carry, "n"],
                    )

    return map_batches(words.select("word", F.col(carry).alias("carried"), "n"), run, f"radix bigint, key bigint, place int, starts boolean, {carry} {kind}, n bigint")


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin, and their lengths."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(new)))


def _meeting(key: np.ndarray) -> np.ndarray:
    """The entries whose keys meet others, in the order of keys."""
    order = np.argsort(key, kind="stable")
    at, n = _runs(key[order])
    return order[np.repeat(n > 1, n)]


def _told(entries: pa.Table) -> pa.Table:
    """What the words of a group of entries learn of each other: ``(word, near, best_n, best)``."""
    entries = entries.take(pa.array(_meeting(entries["key"].to_numpy())))
    words, place, starts = entries["word"].to_pylist(), entries["place"].to_numpy(), entries["starts"].to_numpy(zero_copy_only=False)
    left = pc.dictionary_encode(pa.array([w if p < 0 else w[:p] + w[p + 1 :] for w, p in zip(words, place.tolist(), strict=True)], pa.string())).indices.to_numpy()
    rank = np.empty(len(words), np.int64)
    rank[pc.sort_indices(entries.select(["n", "word"]), [("n", "descending"), ("word", "ascending")]).to_numpy()] = np.arange(len(words))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # who, how many near, the best of them
    # Replaced: the same string and the same place.
    own = np.flatnonzero(place >= 0)
    own = own[np.lexsort((rank[own], place[own], left[own]))]
    if len(own):
        at, n = _runs(left[own], place[own])
        at, n = at[n > 1], n[n > 1]
        members = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        top = np.repeat(at, n)
        out.append((own[members], np.repeat(n - 1, n), own[np.where(members == top, top + 1, top)]))
    # Inserted or deleted: the whole word among what longer ones leave.
    own = np.flatnonzero(starts)
    own = own[np.lexsort((rank[own], place[own] >= 0, left[own]))]
    if len(own):
        at, n = _runs(left[own])
        with_whole = (place[own[at]] < 0) & (n > 1)
        at, n = at[with_whole], n[with_whole]
        members = np.repeat(at, n - 1) + np.arange((n - 1).sum()) - np.repeat(np.cumsum(n - 1) - (n - 1), n - 1) + 1
        out += [(own[at], n - 1, own[at + 1]), (own[members], np.ones(len(members), np.int64), own[np.repeat(at, n - 1)])]
    who, near, best = (pa.array(np.concatenate([o[i] for o in out]) if out else np.empty(0, np.int64)) for i in range(3))
    return pa.table([entries["word"].take(who), near.cast(pa.int64()), entries["n"].take(best), entries["word"].take(best)], names=["word", "near", "best_n", "best"])


def _met(entries: pa.Table) -> pa.Table:
    """The pairs of numbered entries whose keys meet: ``(a, b, place)``, place -1 if ``b`` is whole."""
    entries = entries.take(pa.array(_meeting(entries["key"].to_numpy())))
    key, place, starts, node = (entries[c].to_numpy(zero_copy_only=False) for c in ("key", "place", "starts", "node"))
    pairs = []
    for order, keys in ((np.lexsort((place, key)), (key, place)), (np.lexsort((place >= 0, key)), (key,))):
        own = order[(place >= 0)[order] if len(keys) > 1 else starts[order]]
        if not len(own):
            continue
        at, n = _runs(*(k[own] for k in keys))
        for s, m in zip(at.tolist(), n.tolist(), strict=True):
            group = own[s : s + m]
            if len(keys) > 1:
                pairs += [(node[x], node[y], place[x], -2) for i, x in enumerate(group) for y in group[:i]]
            else:
                whole = group[place[group] < 0]
                pairs += [(node[x], node[y], place[x], -1) for y in whole for x in group[len(whole) :]]
    columns = list(zip(*pairs, strict=True)) if pairs else [[]] * 4
    return pa.table([pa.array(np.array(c, np.int64)) for c in columns], names=["a", "b", "place", "other"])


def _told_of_long(words: DataFrame) -> DataFrame:
    """As ``_told``, for the pairs of ``words(word, n)`` with one over ``LONG``: numbers meet, and each pair fetches its strings to be verified."""
    words = stored(words.where(F.char_length("word") >= LONG).withColumn("node", F.monotonically_increasing_id()))
    met = _entered(words, "node", "bigint").groupBy("radix").applyInArrow(_met, "a bigint, b bigint, place bigint, other bigint").where("a != b")
    a, b = (words.select(F.col("node").alias(x), F.col("word").alias(f"word_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    pairs = met.distinct().join(a, "a").join(b, "b").where(F.greatest(F.char_length("word_a"), F.char_length("word_b")) > LONG)
    at = F.col("place").cast("int")
    left = lambda w: F.concat(F.substring(w, F.lit(1), at), F.substring(w, at + 2, F.char_length(w)))
    pairs = checkpointed(pairs.where(left("word_a") == F.when(F.col("other") == -1, F.col("word_b")).otherwise(left("word_b"))).select("word_a", "n_a", "word_b", "n_b").distinct())
    one = F.lit(1).cast("long").alias("near")
    return pairs.select(F.col("word_a").alias("word"), one, F.col("n_b").alias("best_n"), F.col("word_b").alias("best")).unionByName(
        pairs.select(F.col("word_b").alias("word"), one, F.col("n_a").alias("best_n"), F.col("word_a").alias("best"))
    )


def roots(links: DataFrame) -> DataFrame:
    """``(word, root)`` for each of ``links(word, form)``, root being where the forms end."""
    at = checkpointed(links.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("on"))
        at = checkpointed(at.join(on, "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")))
        moved = not at.where("moved").isEmpty()
        at = at.drop("moved")
        if not moved:
            return at


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """``words(word, n)``, distinct, with ``n_near``, ``form``, ``form_n`` and ``root``.

    The form of a word is its most frequent near word if that occurs ``ratio`` times as often at least.
    """
    words = stored(words.select("word", "n"))
    short = words.where(F.char_length("word") <= LONG)
    told = _entered(short.withColumn("own", F.col("word")), "own", "string").withColumnRenamed("own", "word").groupBy("radix").applyInArrow(_told, "word string, near bigint, best_n bigint, best string")
    told = told.unionByName(_told_of_long(words))
    best = told.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b"))
    formed = (-F.col("b.less")) >= ratio * F.col("n")
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("b.best")).alias("form"), F.when(formed, -F.col("b.less")).alias("form_n")
    )
    found = stored(found)
    led = roots(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(led, "word", "left").withColumn("root", F.coalesce("root", "word"))
