"""Operators against plain statements of their rules, over awkward and empty tables."""

import hashlib
import math
import re

import numpy as np
import pytest
from helpers import SF, rows
from pyspark.sql import functions as F

from tessera.llm import bpe, chat_format, components, html_extract, lang_id, mixing, quality, queries, simhash, suffix_dedup, suffix_sort, topk, url_filter
from tessera.llm.common import size_class

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(name, spark, duck):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(queries.SQL[name]).df())


def test_size_class(spark):
    got = spark.range(5000).select("id", size_class(F.col("id")).alias("c")).collect()
    assert all(r["c"] <= r["id"] <= r["c"] * 33 / 32 + 1 and (r["id"] >= 64 or r["c"] == r["id"]) for r in got)


# 1


def test_urls(spark):
    rules = queries.URL_RULES
    given = {
        "http://A.Example.org/es/1?x": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/12#t": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow"),
        "http://notcom/fr/": ("notcom", "/fr/", None, None),
        "http://example.org": ("example.org", "", None, None),
        "no scheme": ("", "", None, None),
        "a://b?c/d://e": ("b", "", None, None),
        None: ("", "", None, None),
        "http://É.COM/de/\nx": ("É.com", "/de/\nx", "com/de/", "block"),
    }
    pages = spark.createDataFrame([(u, "mine", 1) for u in [*given, "http://x.com/fr/"]], "url string, url_host string, url_f_length int")
    out = url_filter.judge(pages, rules).collect()
    assert len(out) == len(given) + 1
    for r in out:
        host, path, rule, verdict = given[r["url"]]
        assert (r["url_host"], r["url_path"], r["url_rule"]) == (host, path, rule)
        assert r["url_verdict"] in (("allow", "block") if verdict is None else (verdict,))
    table = spark.createDataFrame(rules, "rule string, verdict string")
    joined = {(r["url_host"], r["url_path"]): r["url_rule"] for r in url_filter.match_rules(spark.createDataFrame([g[:2] for g in given.values()], "url_host string, url_path string"), table).collect()}
    assert all(joined[g[0], g[1]] == g[2] for g in given.values())
    assert url_filter.judge(pages.where("false"), rules).count() == 0


def test_trees_learn(spark):
    known = spark.range(2000).select(F.concat(F.lit("http://h.net/"), F.col("id"), F.when(F.col("id") % 3 == 0, "?a=1&b=2&c=3").otherwise("")).alias("url"), (F.col("id") % 3 == 0).alias("blocked"))
    held = spark.range(5000, 5300).select(F.concat(F.lit("http://h.net/"), F.col("id"), F.when(F.col("id") % 2 == 0, "?x=1&y=2&z=3").otherwise("")).alias("url"), (F.col("id") % 2 == 0).alias("bad"))
    got = url_filter.judge(held, [], labelled=known).collect()
    assert np.mean([(r["url_verdict"] == "block") == r["bad"] for r in got]) > 0.95
    one = url_filter.judge(held, [], labelled=known.where("blocked")).select("url_verdict").distinct().collect()
    assert [r[0] for r in one] == ["block"]


def test_suffix_shares_do_not_see_their_own_label(spark):
    """Every host is its own, so its share says nothing of others; the parameters decide."""
    made = lambda a, z: spark.range(a, z).select(F.concat(F.lit("http://h"), F.col("id"), F.lit(".net/p"), F.when(F.col("id") % 3 == 0, "?a=1&b=2&c=3").otherwise("")).alias("url"), (F.col("id") % 3 == 0).alias("blocked"))
    model = url_filter.train(url_filter.judge(made(0, 3000), []).select(F.col("url").alias("url_url"), "url_host", "url_path", F.col("blocked").alias("url_label")))
    used = set()

    def walk(t):
        if isinstance(t, tuple):
            used.add(t[0])
            walk(t[2]), walk(t[3])

    for t in model.trees:
        walk(t)
    assert "suffix2" not in used and used & {"params", "length"}
    got = url_filter.judge(made(5_000, 5_600), [], labelled=made(0, 3000)).collect()
    assert np.mean([(r["url_verdict"] == "block") == r["blocked"] for r in got]) > 0.95


# 2


def cut_plainly(docs):
    """By (doc_id, form) in order: all 100-byte strings seen so far."""
    seen, out = set(), {}
    for key, raw in docs:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(raw[i : i + 100])
        out[key] = gone
    return out


def test_suffix_dedup(spark, awkward, nothing):
    mine = awkward.withColumn("asked", F.lit(1)).withColumn("first", F.lit(2)).withColumn("kind", F.lit("k"))
    id_, form = suffix_dedup.keyed(mine, "text")
    order = mine.select(id_.alias("i"), form.alias("f"), F.coalesce("text", F.lit("")).alias("t")).distinct().orderBy("i", "f").collect()
    want = cut_plainly([((r["i"], r["f"]), r["t"].encode()) for r in order])
    got = suffix_dedup.digests(mine.withColumns({"i": id_, "f": form}), ["doc_id", "i", "f", "asked", "first"]).collect()
    assert len(got) == awkward.count()
    texts = {(r["i"], r["f"]): r["t"].encode() for r in order}
    for r in got:
        raw, gone = texts[r["i"], r["f"]], want[r["i"], r["f"]]
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == (len(raw), len(raw) - len(left), hashlib.sha256(left).hexdigest()), r["doc_id"]
        assert r["n_spans"] == int((np.diff(gone.astype(int), prepend=0) == 1).sum())
    assert suffix_dedup.digests(nothing, ["doc_id"]).count() == 0
    cut = suffix_dedup.cut(mine)
    assert cut.columns == [*mine.columns, "suffix_removed"] and cut.where("text IS NULL").count() == awkward.where("text IS NULL").count()


@pytest.mark.parametrize("parts", [1, 5])
@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup_of_repeated_rows(spark, monkeypatch, parts, hot):
    """Rows alike are one document: their text stays, in one batch or many; what repeats within it or elsewhere goes from each."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    text = lambda k: " ".join(hashlib.md5(f"{k} {j}".encode()).hexdigest() for j in range(12))
    own, shared = text("own"), text("shared")
    docs = [(1, own), (2, text(2) + shared[:230] + text(3)), (None, text(4)), (3, text(5) + shared[:215] + text(6) + shared[:170] + text(7)), (4, own[:180] + text(8))]
    want = cut_plainly([(k, t.encode()) for k, t in sorted(docs, key=lambda d: (d[0] is not None, d[0]))])
    left = {k: np.frombuffer(t.encode(), np.uint8)[~want[k]].tobytes() for k, t in docs}
    assert left[1] == own.encode() and len(left[3]) < len(docs[3][1])
    given = spark.createDataFrame(docs * 3, "doc_id long, text string").repartition(parts)
    got = suffix_dedup.digests(given, ["doc_id"]).collect()
    assert sorted(repr((r["doc_id"], r["kept_sha256"])) for r in got) == sorted(repr((k, hashlib.sha256(v).hexdigest())) for k, v in left.items() for _ in range(3))
    assert sorted(repr((r["doc_id"], r["text"])) for r in suffix_dedup.cut(given).collect()) == sorted(repr((k, v.decode())) for k, v in left.items() for _ in range(3))


def test_suffix_dedup_spreads_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    common = "the very common line that stands in a great many documents of this corpus, word for word, again."
    docs = [(k, f"{hashlib.md5(str(k).encode()).hexdigest()} {common} {hashlib.sha1(str(k % 7).encode()).hexdigest() * 3}") for k in range(60)]
    want = cut_plainly([(k, t.encode()) for k, t in docs])
    got = suffix_dedup.digests(spark.createDataFrame(docs, "doc_id long, text string"), ["doc_id"]).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {k: int(g.sum()) for k, g in want.items()}


def test_suffix_dedup_parts_of_long_texts(monkeypatch):
    rnd = np.random.default_rng(1)
    whole = rnd.integers(97, 101, 5000, np.uint8)
    one = suffix_dedup.segments(whole, np.array([5000]))
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1024)
    suffix_dedup._tables.cache_clear()
    windows = {}
    for raw, ends, _, off in suffix_dedup._blocks([whole.tobytes()]):
        anchor, _, _, lo, n, at = suffix_dedup.segments(raw, ends)
        for a, s, k, p in zip(anchor, lo + off[0], n, at + off[0], strict=True):
            windows |= {int(w): (int(a), int(p)) for w in range(s, s + k)}
    suffix_dedup._tables.cache_clear()
    assert sorted(windows) == list(range(4901)) and len(one[0])


@pytest.mark.parametrize("seed", range(6))
def test_suffix_sort(seed, monkeypatch):
    rnd = np.random.default_rng(seed)
    monkeypatch.setattr(suffix_sort, "RUN", int(rnd.choice([2, 5, 1 << 15])))
    for _ in range(60):
        t = [*rnd.integers(1, rnd.integers(2, 5), rnd.integers(0, 50)).tolist()]
        t = t * int(rnd.integers(1, 3)) + [0]
        memory = int(rnd.choice([4, 12, 1 << 20]))
        found = list(suffix_sort.sort_suffixes(np.array(t), 200, memory))
        order, lcp = (np.concatenate([f[k] for f in found]).tolist() for k in (0, 1))
        want = sorted(range(len(t)), key=lambda i: t[i:])
        common = [0] + [next((k for k in range(len(t)) if a + k >= len(t) or b + k >= len(t) or t[a + k] != t[b + k]), 0) for a, b in zip(want, want[1:], strict=False)]
        assert order == want and lcp == common


def test_suffix_sort_of_files(monkeypatch):
    """A shard a hundred times as long as the memory: queues spill, arrays are files, and little is held at once."""
    import random
    import tracemalloc

    rnd = random.Random(2)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(300)]
    part = " ".join(rnd.choices(words, k=9000))
    text = np.frombuffer((part + " ".join(rnd.choices(words, k=18000)) + part).encode() + b"\0", np.uint8)
    monkeypatch.setattr(suffix_sort, "RUN", 1024)
    spilt = []
    spill = suffix_sort.Queues._spill
    monkeypatch.setattr(suffix_sort.Queues, "_spill", lambda q: spilt.append(1) or spill(q))

    def digest(memory):
        h, n = hashlib.sha256(), 0
        tracemalloc.start()
        for at, lcp in suffix_sort.sorted_down(text, 100, memory):
            n += len(at)
            h.update(np.stack((at, lcp)).astype(np.int64).T.tobytes())
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n == len(text)
        return h.hexdigest(), peak

    small, peak = digest(len(text) // 100)
    assert spilt and peak < 3 << 20
    large, most = digest(1 << 20)
    assert small == large and most > 5 * peak


@pytest.mark.parametrize("remembered", [0, 1 << 20])
def test_shard(monkeypatch, remembered):
    """Segments in any order, remembered or not, against all windows seen so far."""
    import random

    monkeypatch.setattr(suffix_dedup, "REMEMBERED", remembered)
    rnd = random.Random(4)
    texts = [("é" * 300 + " été " + "é" * 300).encode(), b"ab" * 400, b"".join(rnd.choices([b"one", b"two", b"three"], k=400))]
    for memory in (7, 1 << 20):
        found = []
        for d, raw in enumerate(texts * 2):
            p = 0
            while p <= len(raw) - 100:
                n = min(rnd.randint(1, 60), len(raw) - 99 - p)
                found.append((d, -d, p, n, raw[p : p + n + 99]))
                p += n
        rnd.shuffle(found)
        shard, got = suffix_dedup.Shard(memory), []
        for i, f, s, n, raw in found:
            got += shard.add(*(np.array([x]) for x in (i, f, s, n)), raw)
        got += [x for run in shard.repeats() for x in zip(*(c.tolist() for c in run), strict=True)]
        windows = sorted((i, f, s + k) for i, f, s, n in got for k in range(n))
        seen, want = set(), []
        for (i, f, s), w in sorted(((i, f, s + k), raw[k : k + 100]) for i, f, s, n, raw in found for k in range(n)):
            want += [(i, f, s)] if w in seen else []
            seen.add(w)
        assert windows == want


# 3


def test_language(spark, awkward, nothing):
    known = spark.createDataFrame([(k, t, lang) for k in range(40) for t, lang in (("the house and the garden were quiet", "en"), ("la maison et le jardin étaient calmes", "fr"))], "doc_id long, text string, lang string")
    model = lang_id.train(known, PIECES)
    asked = spark.createDataFrame([("the quiet garden", "en"), ("le jardin calme", "fr"), (None, "und"), ("12 !!", "und"), ("", "und"), ("z" * 5000, None)], "text string, want string")
    for r in lang_id.identify(asked, model, ["want"]).collect():
        assert r["langid_pred"] == r["want"] or r["want"] is None
        assert 0 <= r["langid_score"] <= 1
    mine = awkward.withColumns({c: F.lit("own") for c in ("score", "lang_pred", "held_out", "word", "draw", "count")})
    got = lang_id.identify(mine, lang_id.train(mine, PIECES), mine.columns)
    assert got.columns == [*mine.columns, "langid_pred", "langid_score"] and got.where("score = 'own' AND lang_pred = 'own'").count() == awkward.count()
    blank = lang_id.train(nothing, PIECES)
    assert {r["langid_pred"] for r in lang_id.identify(awkward, blank, ["doc_id"]).collect()} == {"und"}


def test_language_learns_all_words_of_the_drawn_documents(spark):
    """A language of words that occur once keeps its model beside one with many more rows than the former limit."""
    many = " ".join(f"{a}{b}{c}{d}" for a in "bcdfghjklmnpqrstvwxz" for b in "aeiouy" for c in "bcdfghjklmnpqrstvwxz" for d in map(chr, range(0x3B1, 0x3B1 + 60)))
    known = [(k, many, "aa") for k in range(2)] + [(2, "ženščina čitala knigu včera večerom doma", "zz")]
    model = lang_id.train(spark.createDataFrame(known, "doc_id long, text string, lang string"), PIECES)
    assert model.langs == ["aa", "zz"]
    asked = spark.createDataFrame([("knigu ženščina čitala",)], "text string")
    assert lang_id.identify(asked, model, ["text"]).first()["langid_pred"] == "zz"


def test_forward_sums_all_segmentations():
    pieces = sorted([b" ", b" a", b"a", b"ab", b"b", b" ab"] + [bytes([b]) for b in range(256) if b not in b" ab"])
    model = lang_id.fit([("x", "ab", 3), ("x", "ba", 1)], pieces)
    p = dict(zip(pieces, model.probs[:, 0], strict=False))

    def total(raw):
        return 1.0 if not raw else sum(p[raw[:k]] * total(raw[k:]) for k in range(1, len(raw) + 1) if raw[:k] in p)

    for w in ("ab", "ba", "abab"):
        assert math.isclose(model.score_words([w])[0, 0], math.log(total(b" " + w.encode())), rel_tol=1e-9)


def test_pieces_of_all_lengths():
    from base64 import b64decode

    with open(PIECES, "rb") as f:
        every = {b64decode(line.split()[0]) for line in f if line.strip()}
    pieces = lang_id.read_pieces(PIECES)
    assert every <= set(pieces) and max(map(len, pieces)) > 16
    longest = " abcdefghijklmnopqrstuvwxyzabcdefghijkl"
    own = sorted({longest.encode()[a:z] for a, z in ((0, 9), (0, 10), (0, 39), (3, 12), (3, 20), (12, 31), (20, 39), (2, 38))} | {b" abcdefg", b"xyzabcdefz"} | {bytes([b]) for b in range(256)})
    words = [longest[1:], longest[1:12], longest[1:20] + "q", longest[3:39], "zzz" + longest[1:39], longest[1:39] * 3]
    model = lang_id.fit([("x", w, k + 1) for k, w in enumerate(words)] + [("y", "other", 2)], own)
    for col in (0, 1):
        p = dict(zip(own, model.probs[:, col], strict=False))

        def total(raw, p=p):
            sums = [1.0]
            for j in range(1, len(raw) + 1):
                sums.append(sum(sums[i] * p[raw[i:j]] for i in range(max(0, j - 40), j) if raw[i:j] in p))
            return sums[-1]

        assert np.allclose(model.score_words(words)[:, col], [math.log(total(b" " + w.encode())) for w in words], rtol=1e-9)
    # What is expected of the pieces covers every byte of the words.
    lattice, raw = lang_id.Lattice(own), [b" " + w.encode() for w in words]
    for w in raw:
        expected = lang_id._expected(lattice.find(np.frombuffer(w, np.uint8).reshape(1, -1)), model.probs[:, :1], np.ones(1))
        assert math.isclose(sum(e * len(x) for e, x in zip(expected, own, strict=False)), len(w), rel_tol=1e-9)
        assert expected[[k for k, x in enumerate(own) if len(x) > 8]].sum() > 0


def test_long_words_are_scored_whole():
    """Words on both sides of the length from which they are gone through alone, against all segmentations."""
    pieces = sorted([b"ab", b"abc", b"bcabca", b"cabcabcab", b"bcabcabcabc"] + [bytes([b]) for b in range(256)])
    words = ["abc" * k + "a" * (k % 3) for k in (1, 5, 20, 21, 22, 90, 400)]
    model = lang_id.fit([("x", w, 1) for w in words] + [("y", "cab", 3)], pieces)
    for col in (0, 1):
        p = {x: math.log(v) for x, v in zip(pieces, model.probs[:, col], strict=False)}
        for w, score in zip(words, model.score_words(words)[:, col], strict=True):
            raw, sums = b" " + w.encode(), [0.0]
            for j in range(1, len(raw) + 1):
                ways = [sums[i] + p[raw[i:j]] for i in range(max(0, j - 11), j) if raw[i:j] in p]
                sums.append(max(ways) + math.log(sum(math.exp(v - max(ways)) for v in ways)))
            assert math.isclose(score, sums[-1], rel_tol=1e-9)
    lattice = lang_id.Lattice(pieces)
    for w in words:
        raw = b" " + w.encode()
        alone = lang_id._expected_in(lattice.line(raw), model.probs[:, :1], 1.0, len(raw))
        assert math.isclose(sum(e * len(x) for e, x in zip(alone, pieces, strict=False)), len(raw), rel_tol=1e-9)
        if len(raw) <= 70:
            assert np.allclose(alone, lang_id._expected(lattice.find(np.frombuffer(raw, np.uint8).reshape(1, -1)), model.probs[:, :1], np.ones(1)))


def test_marks_are_kept():
    assert lang_id.letters("नमस्ते!") == b" " + "नमस्ते".encode() and lang_id.letters("e\u0301t9") == b" " + "e\u0301t".encode()
    assert lang_id.letters("\u0301") is None and lang_id.letters("12") is None


def test_held_out_accuracy(spark):
    got = queries.op3_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97


# 4


def test_mixing(spark, awkward, nothing):
    mine = awkward.withColumn("place", F.lit("p")).withColumn("more", F.lit("m"))
    m = mixing.mix(mine).collect()
    assert len(m) == awkward.count() and {r["place"] for r in m} == {"p"}
    sizes, target, taken = {}, {}, {}
    for r in m:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert r["mix_size"] == n and 0 <= r["mix_copies"] <= 3
        s = r["source"]
        sizes[s], target[s], taken[s] = sizes.get(s, 0) + n, r["mix_target"], taken.get(s, 0) + n * r["mix_copies"]
    total = sum(sizes.values())
    want, open_, left = {}, dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True)), float(total)
    while True:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
            left -= want[s]
            del open_[s]
    want |= share
    assert all(math.isclose(target[s], want[s], abs_tol=1e-6) for s in sizes)
    out = mixing.materialise(mine)
    assert out.columns == mine.columns and out.count() == sum(r["mix_copies"] for r in m)
    assert sorted(map(repr, m)) == sorted(map(repr, mixing.mix(mine.repartition(7)).collect()))
    assert mixing.mix(nothing).count() == 0


def test_mixing_comes_near(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    by = mixing.mix(docs, keep=["source"]).groupBy("source").agg(F.first("mix_target").alias("t"), F.sum(F.col("mix_copies") * F.col("mix_size")).alias("k")).collect()
    assert all(abs(r["k"] - r["t"]) <= 0.02 * r["t"] + 1 for r in by)


# 5


def test_simhash(spark, awkward, nothing):
    from xxhash import xxh64_intdigest

    def plain(text):
        w = (text or "").encode().lower().split()
        grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    docs = awkward.collect()
    fps = [plain(r["text"]) for r in docs]
    root = list(range(len(docs)))
    for _ in docs:
        for i in range(len(docs)):
            for j in range(len(docs)):
                if bin(fps[i] ^ fps[j]).count("1") <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    least = {}
    for r, k in zip(docs, root, strict=True):
        if r["doc_id"] is not None:
            least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    want = sorted(repr((r["doc_id"], f, least.get(k))) for r, f, k in zip(docs, fps, root, strict=True))
    got = sorted(repr((r["doc_id"], r["simhash_fp"] % (1 << 64), r["component_id"])) for r in simhash.near_duplicates(awkward, words=4).collect())
    assert got == want
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.keep_one(awkward.withColumn("root", F.lit(1)), words=4, families=1)
    assert kept.count() == len(set(root)) and kept.where("doc_id = 2").count() == 0
    hashed = spark.createDataFrame([("é a b c",)], ["t"]).select(F.xxhash64("t")).first()[0]
    assert hashed % (1 << 64) == xxh64_intdigest("é a b c".encode(), 42)


@pytest.mark.parametrize("hot, hold", [(1 << 15, 1 << 19), (10, 1 << 19), (10, 30)])
def test_links_lose_nothing(spark, monkeypatch, hot, hold):
    """Also where keys hold so many that they are dealt again."""
    for name, value in {"HOT": hot, "HOLD": hold, "FRONTIER": 64 if hot > 10 else 2, "PATIENCE": 1}.items():
        monkeypatch.setattr(simhash, name, value)
    rnd = np.random.default_rng(3)
    centres = rnd.integers(0, 1 << 63, 40, np.uint64)
    fps = np.unique(np.concatenate([centres] + [centres ^ (np.uint64(1) << rnd.integers(0, 64, 40, np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 64, 40, np.uint64)) for _ in range(8)]))
    # Many that agree in their upper half and are far apart in the lower.
    fps = np.unique(np.concatenate((fps, rnd.integers(0, 1 << 32, 100, np.uint64) | np.uint64(7 << 40))))
    nodes = spark.createDataFrame([(k, [int(f)]) for k, f in enumerate(fps.view(np.int64))], "node long, simhash_fps array<long>")
    got = simhash.links(nodes, len(fps))
    links = {(r["a"], r["b"]) for r in got.collect()}
    assert all(np.bitwise_count(fps[a] ^ fps[b]) <= 4 for a, b in links)
    roots = {r["node"]: r["root"] for r in components.components(got).collect()}
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if np.bitwise_count(fps[i] ^ fps[j]) <= 4]
    assert pairs and all(roots[i] == roots[j] for i, j in pairs)
    for n in (2, 1000, 10**6, 10**9):
        assert all(bin(m).count("1") >= 12 for m in simhash.tables(n))


@pytest.mark.parametrize("hot, hold", [(60, 1 << 19), (60, 100), (1 << 15, 100)])
def test_links_of_several_families_lose_nothing(spark, monkeypatch, hot, hold):
    """Keys that hold too many for one search or one task: what they link is what all pairs within them link."""
    for name, value in {"HOT": hot, "HOLD": hold, "PATIENCE": 1, "STAND_INS": 2}.items():
        monkeypatch.setattr(simhash, name, value, raising=False)
    rnd = np.random.default_rng(8)
    # All differ within one bit in four only, so some tables have all of them under one key.
    base, free = rnd.integers(0, 1 << 63, 2, np.uint64), rnd.choice(128, 14, replace=False)
    values = rnd.choice(1 << 14, 700, replace=False)
    fps = np.repeat(base[None], len(values), axis=0)
    for k, bit in enumerate(free.tolist()):
        fps[:, bit // 64] ^= (values >> k & 1).astype(np.uint64) << np.uint64(bit % 64)
    nodes = spark.createDataFrame([(k, f) for k, f in enumerate(fps.view(np.int64).tolist())], "node long, simhash_fps array<long>")
    assert any(all(not t[b // 64] >> b % 64 & 1 for b in free.tolist()) for t in simhash.wide_tables(len(fps), 2))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = simhash.links(nodes, len(fps), 2, 1)
        roots = {r["node"]: r["root"] for r in components.components(got).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    pairs = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2) <= 1, 1)).tolist()
    want = list(range(len(fps)))
    while any(want[a] != want[b] for a, b in pairs):
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert len(pairs) > 100 and [roots.get(k, k) for k in range(len(fps))] == want


def test_forest_connects(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 3)
    rnd = np.random.default_rng(6)
    for _ in range(40):
        fps = rnd.integers(0, 64, (30, 2), np.uint64)
        root = list(range(30))

        def of(k, root=root):
            while root[k] != k:
                k = root[k]
            return k

        for a, b in simhash._forest(fps, np.arange(30), 1):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                assert np.bitwise_count(fps[x] ^ fps[y]).sum() <= 1
                root[of(x)] = of(y)
        assert all(of(i) == of(j) for i in range(30) for j in range(i) if np.bitwise_count(fps[i] ^ fps[j]).sum() <= 1)


def test_families_catch_more(spark):
    rnd = np.random.default_rng(4)
    words = np.array([f"w{k}" for k in range(3000)])
    rows = []
    for k in range(60):
        w = rnd.choice(words, 150)
        v = w.copy()
        v[rnd.integers(5, 145, 1)] = "changed"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {f: {r["doc_id"] for r in simhash.keep_one(docs, families=f).select("doc_id").collect()} for f in (1, 8)}
    assert left[8] == {2 * k for k in range(60)} and left[8] < left[1]


@pytest.mark.parametrize("hot, hold", [(1 << 15, 1 << 19), (40, 1 << 19), (40, 60)])
def test_near_copies_are_found(spark, monkeypatch, hot, hold):
    """Of all pairs of texts of a similarity of 0.8 by shingles of five words, found by comparing all, nine in ten at least lose one."""
    for name, value in {"HOT": hot, "HOLD": hold, "FRONTIER": 64 if hot > 40 else 4, "PATIENCE": 1}.items():
        monkeypatch.setattr(simhash, name, value)
    rnd = np.random.default_rng(5)
    words = np.array([f"w{k}" for k in range(2000)])
    rows = []
    for k in range(150):
        w = rnd.choice(words, 200)
        for c in range(3):
            v = w.copy()
            v[rnd.integers(0, 200, 2 * c)] = "new"
            rows.append((3 * k + c, " ".join(v)))
    grams = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if i // 3 == j // 3 and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one(docs).select("doc_id").collect()}
    assert np.mean([i not in kept or j not in kept for i, j in pairs]) >= 0.9
    assert {3 * k for k in range(150)} <= kept


def test_keep_one_is_settled(spark):
    """Rows alike in id and text that differ elsewhere: the same one each time; names that the operator uses are free."""
    rows = [(1, "a b c d e f", s, 3, "x") for s in ("s1", "s2", "s3")] + [(None, None, "s1", None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, simhash_id int, simhash_row string")
    got = [{tuple(r) for r in simhash.keep_one(docs.repartition(k)).collect()} for k in (1, 3, 4)]
    assert len(got[0]) == 2 and got[0] == got[1] == got[2]


def test_components_of_a_path(spark):
    path = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components.components(path).select("root").distinct().count() == 1
    assert components.components(path.where("false")).count() == 0


# 6


def test_top_k(spark):
    rnd = np.random.default_rng(2)
    vectors = [(k, v.tolist()) for k, v in enumerate(rnd.normal(size=(300, 64)))] + [(300 + k, [1.0] * 64) for k in range(30)] + [(400, None), (401, [1.0])]
    coded = spark.createDataFrame(vectors, "id long, v array<double>").select("id", topk.sign_code(F.col("v")).alias("code"))
    asked = coded.where("id % 100 = 0").select(F.col("id").alias("query_id"), "code")
    got = {}
    for r in topk.top_k(coded, asked, 7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["id"]))
    code = {k: sum(1 << b for b, x in enumerate(v) if x > 0) for k, v in vectors if v and len(v) == 64}
    for q in (0, 100, 200, 300):
        want = sorted((bin(code[q] ^ c).count("1"), k) for k, c in code.items())[:7]
        assert [x[1:] for x in sorted(got[q])] == want
    assert set(got) == {0, 100, 200, 300}
    assert topk.top_k(coded.where("false"), asked.where("false")).count() == 0
    assert len(topk.top_k(coded.where("id < 3"), asked.where("query_id = 0"), 7).collect()) == 3


@pytest.mark.parametrize("codes", [1, 20, 5000])
def test_top_k_at_every_number_of_segments(spark, codes):
    """Null and repeated ids, and two codes of one query, against all distances."""
    rnd = np.random.default_rng(codes)
    base = rnd.integers(-(1 << 63), 1 << 63, codes)
    every = [(k, int(c)) for k, c in enumerate(base)] + [(None, int(base[0])), (0, int(base[0])), (codes, None)]
    asked = [(7, int(base[0])), (7, int(base[-1] ^ 5)), (7, int(base[0])), (None, int(rnd.integers(1 << 62))), (9, None)]
    coded = spark.createDataFrame(every, "id long, code long")
    got = {}
    for r in topk.top_k(coded, spark.createDataFrame(asked, "query_id long, code long"), 6).collect():
        got.setdefault((r["query_id"], r["query_code"]), []).append((r["rank"], r["distance"], r["id"]))
    want = {(i, q): sorted(((q ^ c) % (1 << 64)).bit_count() * 10**6 + k for k, c in every if k is not None and c is not None)[:6] for i, q in asked if q is not None}
    assert {key: [d * 10**6 + k for _, d, k in sorted(v)] for key, v in got.items()} == want
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())


def test_probes_follow_the_number_of_queries(spark, monkeypatch):
    """Not the square of the table: with five times the codes and queries, the rows of turned bits are about five times as many."""
    made, rnd, flipped = [], np.random.default_rng(9), topk._flipped

    def counted(*given):
        out = flipped(*given)
        made[-1] += out.count()
        return out

    monkeypatch.setattr(topk, "_flipped", counted)
    for codes in (10_000, 50_000):
        made.append(0)
        base = rnd.integers(-(1 << 63), 1 << 63, codes)
        coded = spark.createDataFrame(list(enumerate(base.tolist())), "id long, code long")
        asked = coded.where("id % 1000 = 0").select(F.col("id").alias("query_id"), "code")
        got = {}
        for r in topk.top_k(coded, asked, 10).collect():
            got.setdefault(r["query_id"], []).append((r["distance"], r["id"]))
        for q in range(0, codes, 1000):
            far = np.bitwise_count((base ^ base[q]).view(np.uint64))
            assert sorted(got[q]) == sorted(zip(far.tolist(), range(codes), strict=True))[:10]
        made[-1] /= codes // 1000
    assert max(made) <= 1.25 * topk.PROBES and made[1] <= 1.25 * made[0]


def test_segments_follow_the_number_of_codes():
    assert [len(topk.edges(n)) - 1 for n in (0, 1, 300, 5000, 1 << 16, 1 << 21, 1 << 30, 1 << 40)] == [8, 8, 8, 5, 4, 3, 2, 2]
    assert all(topk.edges(n)[0] == 0 and topk.edges(n)[-1] == 64 for n in (1, 99, 10**6, 10**12))


# 7


def test_quality(spark, awkward, nothing, monkeypatch):
    def plain(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        hit = {i + k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(5)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)

    short = awkward.where("length(text) < 9000 OR text IS NULL")
    for limit in (20_000, 3):
        monkeypatch.setattr(quality, "LONG_WORDS", limit)
        for r in short.collect():
            assert quality.measure(r["text"])[:5] == plain(r["text"])
    mine = awkward.withColumn("rule", F.lit(1)).withColumn("cell", F.lit(2))
    measured = quality.measures(mine)
    judged = quality.judge(measured, quality.fences(measured))
    assert judged.count() == awkward.count() and judged.where("quality_kept IS NULL").count() == 0
    assert quality.judge(quality.measures(nothing), quality.fences(quality.measures(nothing))).count() == 0


# 8


def test_extraction():
    model = html_extract.trained()
    pages = list(html_extract.labelled_pages(150, 31))
    right = [html_extract.extract_text(p, model) == " ".join(" ".join(t.split()) for t in main) for p, main in pages]
    assert np.mean(right) > 0.9
    x = lambda h: html_extract.extract_text(h, model)
    assert x(None) == x("") == x("<!-- a") == ""
    page = "<body><nav><a href=x>Home</a></nav><article><h1>A &amp;amp; B</h1><p>One\n two<br>three <b>fo</b>ur.<p>Five.<script>var a='</p>';</script></article><footer>&copy; me</footer>"
    assert x(page) == "A &amp; B One two three four. Five."


def test_hidden_elements_end_with_their_own_tag():
    x = lambda h: " ".join(b.text for b in html_extract.blocks(h))
    for tag in ("div", "p", "span", "a", "li"):
        for attribute in ("hidden", 'HIDDEN=""', "class=x hidden", 'style="display:none"', "style='color:red; Display : none'", 'title="a > b" hidden'):
            assert x(f"<body><{tag} {attribute}>x <b>y</b></{tag}><article>kept <p>too</article>") == "kept too", (tag, attribute)
            assert x(f"<{tag}>a<{tag} {attribute}>x</{tag}> b</{tag}> c").split() == ["a", "b", "c"] or tag in ("p", "a", "li")
    assert x("<article><p hidden>x<p>one<p>two</article>three") == "one two three"
    assert x("<div hidden>a<div>b</div>c</div>d") == x("<div hidden><span hidden>a</span>b</div>d") == "d"
    for attribute in ('title="a hidden gem"', 'class="content hidden wide"', "data-hidden=1", 'title="display:none"', "aria-hidden=false", 'alt="x" class=hidden'):
        assert x(f"<div {attribute}>kept</div>") == "kept", attribute
    found = html_extract.blocks("<a hidden>x</a><p>plain <a href=y>linked</a></p>")
    assert [(b.text, b.linked) for b in found] == [("plain linked", 6)]
    article = "<body><nav><a href=x>Home</a></nav><article><h1>Title</h1>{}<p>One sentence of the text.</p><p>Another one of it.</p></article></body>"
    model = html_extract.trained()
    for hidden in ("<div style='display:none'>x</div>", "<p hidden>x</p>", "<span hidden>x</span>"):
        assert html_extract.extract_text(article.format(hidden), model) == "Title One sentence of the text. Another one of it."


def test_text_of_formulas_drawings_and_fallbacks():
    x = lambda h: " ".join(b.text for b in html_extract.blocks(h))
    for tag in ("math", "svg", "object", "canvas", "noscript"):
        assert x(f"<p>one <{tag}><b>two</b></{tag}> three</p>four") == "one two three four"
        assert x(f"<{tag}><script>a</script><style>b</style><template>c</template><i hidden>d</i></{tag}>e") == "e"
        assert x(f"<head><{tag}>a</{tag}></head><body>b") == "b"
    assert x("<p>a<svg/>b <svg viewBox='0 0 1 1'><path d=x/><text>c</text></svg></p>d") == "ab c d"
    page = "<body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold.</p><p>Another one of it.</p></article></body>"
    assert html_extract.extract_text(page, html_extract.trained()) == "Title Let x=1 hold. Another one of it."


def test_viterbi_and_marginals():
    rnd = np.random.default_rng(0)
    crf = html_extract.Crf()
    crf.weights = {f"f{k}": float(v) for k, v in enumerate(rnd.normal(size=6))}
    crf.pairs = rnd.normal(size=(2, 2)).tolist()
    feats = [[f"f{k}"] for k in range(6)]
    score = lambda y: sum(crf.weights[f"f{k}"] * v for k, v in enumerate(y)) + sum(crf.pairs[a][b] for a, b in zip(y, y[1:], strict=False))
    every = [[n >> k & 1 for k in range(6)] for n in range(64)]
    assert crf.decode(feats) == max(every, key=score)
    w = np.exp([score(y) for y in every])
    one, both = crf.marginals(crf.scores(feats))
    assert np.allclose(one, (w[:, None] * np.array(every)).sum(0) / w.sum()) and math.isclose(both.sum(), 5)


def test_pages_of_the_table(spark):
    import html as h

    for r in queries.op8_html_extract(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        own = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        plain = " ".join(h.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br>|</?(p|h1)>", " ", own))).split())
        assert (r["text"], r["n_chars"]) == (plain, len(plain))


# 9


def test_chat(spark):
    turns = [
        (1, 0, "user", "a & <|im_end|>", 1),
        (1, 1, "assistant", "&lt;| <|im_start|>assistant\nb", 1),
        (1, 2, "user", None, 1),
        (1, 3, "assistant", "", 1),
        (1, 4, "us\ner<|", "tail", 1),
        (2, 0, "user", "only", 1),
        (None, None, None, None, 1),
        (3, 1, "assistant", "x", 1),
        (3, 1, "assistant", "x", 1),
    ]
    given = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, example int")
    made = chat_format.format_examples(given)
    assert {r["conv_id"]: r["n"] for r in made.groupBy("conv_id").agg(F.count("*").alias("n")).collect()} == {1: 3, 2: 1, None: 1, 3: 2}
    assert all(r["formatted"].count("<|im_start|>") == r["example"] + 1 for r in made.collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in chat_format.digest(made).collect():
        own = sorted([t for t in turns if t[0] == r["conv_id"]], key=lambda t: t[1] or 0)
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == sha("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own))
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
    assert chat_format.digest(chat_format.format_examples(given.where("false"))).count() == 0


# 10


def test_bpe(spark, awkward, nothing):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    for r in bpe.decode(bpe.encode(awkward, BPE, ["doc_id", "text"]).withColumn("ids", F.col("bpe_ids")), BPE, ["doc_id", "text", "ids"]).collect():
        want = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["bpe_decoded"] == lib.decode(want, skip_special_tokens=False)
    assert bpe.digests(nothing, BPE, ["doc_id"]).count() == 0


def test_forced_boundaries_are_certain():
    t = bpe.tokenizer(BPE)
    frags, counts = t.fragments([b" hello", "日本".encode(), b"x"])
    assert b"".join(frags) == b" hello" + "日本".encode() + b"x" and counts.sum() == len(frags)
    for f in frags:
        assert all(t.together[a, b] for a, b in zip(f, f[1:], strict=False))


@pytest.mark.parametrize("hot", [20_000, 3])
def test_suffix_dedup_of_edited_copies(spark, monkeypatch, hot):
    import random

    rnd = random.Random(11)
    words = "the of and to in is it on or as at be by an re th he ing er".split()
    base = [rnd.choices(words, k=300) for _ in range(4)]
    docs = []
    for k in range(120):
        t = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 6)):
            t[rnd.randrange(len(t))] = rnd.choice(words) + rnd.choice(["", "x", "q"])
        at = rnd.randint(0, 150)
        docs.append((k, " ".join(t[at : at + rnd.randint(20, 150)]) + "a" * rnd.choice([0, 0, 150]) + "ab" * rnd.choice([0, 0, 120])))
    want = cut_plainly([(k, t.encode()) for k, t in docs])
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = {r["doc_id"]: r["kept_sha256"] for r in suffix_dedup.digests(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), ["doc_id"]).collect()}
    assert got == {k: hashlib.sha256(np.frombuffer(t.encode(), np.uint8)[~want[k]].tobytes()).hexdigest() for k, t in docs}
