"""Spelling variants against a comparison of all words with all others."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import queries, variants


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words, ratio=2):
    out = {}
    for w, n in words.items():
        close = sorted((-m, v) for v, m in words.items() if near(w, v))
        formed = close and -close[0][0] >= ratio * n
        out[w] = (n, len(close), close[0][1] if formed else None, -close[0][0] if formed else None)
    for w, (n, k, form, form_n) in list(out.items()):
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        out[w] = (n, k, form, form_n, root)
    return out


def plain_words(rows, drop_every=None, length=5, least=3):
    found = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if drop_every and h % drop_every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= length and n >= least}


def got(frame):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in frame.collect()}


def made(n, letters, lengths, seed):
    rnd = random.Random(seed)
    return {"".join(rnd.choices(letters, k=rnd.choice(lengths))): rnd.choice([3, 3, 4, 6, 9, 20, 41, 90]) for _ in range(n)}


@pytest.mark.parametrize("words", [{}, made(600, "ab", (5, 6, 7, 8), 1), made(900, "abcé", (5, 6), 2), {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "baaaaaaa": 24}], ids=["none", "two", "four", "chain"])
@pytest.mark.parametrize("radix", [64, 1 << 15])
def test_variants_are_the_plain_ones(spark, monkeypatch, words, radix):
    monkeypatch.setattr(variants, "RADIX", radix)
    assert got(variants.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == plain(words)


@pytest.mark.parametrize("longest", [1, 6, 64])
def test_long_words(spark, monkeypatch, longest):
    """Words that go by number: of any length, among others that are nearly as long."""
    monkeypatch.setattr(variants, "LONG", longest)
    base = "".join(random.Random(3).choices("abc", k=400))
    words = made(300, "ab", (5, 6, 7), 4) | {base: 90, base[:-1]: 9, base + "c": 8, base[:200] + "é" + base[201:]: 7, base[:200] + "f" + base[201:]: 7, "a" * 64: 5, "a" * 65: 10, "a" * 66: 20, "b" + "a" * 64: 9}
    assert got(variants.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == plain(words)


def test_colliding_keys_are_verified(spark, monkeypatch):
    """Keys of four values only: what meets is verified on the strings."""
    keys = variants.deletion_keys
    monkeypatch.setattr(variants, "deletion_keys", lambda words: (keys(words)[0] % np.uint64(4), *keys(words)[1:]))
    monkeypatch.setattr(variants, "LONG", 6)
    words = made(120, "ab", (5, 6, 7), 5) | made(60, "abcdefgh", (5, 9), 6)
    assert got(variants.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == plain(words)


def test_keys_are_those_of_the_strings():
    words = ["abcde", "aabbcc", "é", "abcd", "aaaaaaaaaa"]
    key, word, place, starts = variants.deletion_keys(words)
    left = [words[w] if p < 0 else words[w][:p] + words[w][p + 1 :] for w, p in zip(word, place, strict=True)]
    assert len(left) == sum(len(w) + 1 for w in words)
    for i, a in enumerate(left):
        for j, b in enumerate(left):
            assert (key[i] == key[j]) == (a == b)
    for w in range(len(words)):
        own = [left[i] for i in range(len(left)) if word[i] == w and place[i] >= 0 and starts[i]]
        assert len(own) == len(set(own)) and set(own) == {left[i] for i in range(len(left)) if word[i] == w and place[i] >= 0}


@pytest.mark.parametrize("size", [7, 1 << 20])
def test_counts_of_awkward_documents(spark, awkward, nothing, monkeypatch, size):
    monkeypatch.setattr(variants, "SLICE", size)
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    for every in (None, 3, 97):
        found = {r.word: r.n for r in variants.count_words(awkward, drop_every=every).collect()}
        assert found == plain_words(rows, every)
    assert variants.count_words(nothing).count() == 0
    assert variants.variants(variants.count_words(nothing)).count() == 0


def test_query(spark, tmp_path, awkward):
    awkward.withColumnRenamed("lang", "word").withColumnRenamed("source", "n").write.parquet(f"{tmp_path}/documents.parquet")
    frame = queries.op11_spelling_variants(spark, str(tmp_path))
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert got(frame) == plain(plain_words([(r.doc_id, r.text) for r in awkward.collect()], 97))
