"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

A word is its letters and their marks in lower case after a space, as UTF-8. Under a language, its probability is the sum
over all ways to cut it into vocabulary pieces of the product of their probabilities, which a forward
pass computes; a text's score is the sum over its words of the logarithms. The piece probabilities are
fitted by expectation maximisation (forward-backward) from the word counts of each language.

The vocabulary is a file of ``base64(piece) rank`` lines, all of which are used; all single bytes are among them, so
every word has a segmentation. Pieces of up to ``SHORT`` bytes are looked up as whole numbers, for all words of one length at once,
longer ones only where the first ``SHORT`` bytes of one stand, byte by byte down a tree. A word of over ``MANY`` bytes is gone through by
itself, with the same sums in logarithms, however long it is.

Fitting takes at most about ``DOCS_A_LANGUAGE`` documents of each language, drawn by a hash of the id, and all their
words; the driver holds the words of one language at a time. The model has a column a language whatever the corpus's
size, and is sent to the tasks. Scoring reads every whole text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; rows of null language teach nothing;
with nothing to learn from every text is ``und``; equal scores go to the first language in code point order;
repeated rows are judged alike; an empty table gives no rows; other columns pass by name.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import beside, checkpointed, map_batches, packed, packed_kind

SHORT, MANY = 8, 64
DOCS_A_LANGUAGE, ROUNDS, ADDED = 300, 3, 0.05
#: Distinct words, and letters in them, whose scores a worker remembers; then it starts anew.
REMEMBERED, REMEMBERED_LETTERS = 500_000, 16 << 20
UNKNOWN = "und"


def read_pieces(path: str) -> list[bytes]:
    """The pieces of a vocabulary file, and all single bytes."""
    with open(path, "rb") as f:
        found = (base64.b64decode(line.split()[0]) for line in f if line.strip())
        return sorted({p for p in found if p} | {bytes([b]) for b in range(256)})


@dataclass
class Found:
    """The pieces in many words of one length.

    ``short[start][length - 1]``: piece numbers for all words, one past the last piece where there is none.
    ``longer``: (start, end, words, piece numbers) of the pieces of over ``SHORT`` bytes.
    """

    short: list[list[np.ndarray]]
    longer: list[tuple[int, int, np.ndarray, np.ndarray]]


class Lattice:
    """Finds the vocabulary's pieces in many words of one length at once."""

    def __init__(self, pieces: list[bytes]):
        self.size = len(pieces)
        self.keys, self.ids = [], []
        for n in range(1, SHORT + 1):
            own = sorted((int.from_bytes(p), i) for i, p in enumerate(pieces) if len(p) == n)
            self.keys.append(np.array([k for k, _ in own], np.uint64))
            self.ids.append(np.array([i for _, i in own], np.int32))
        # The longer pieces: a tree of bytes under each first SHORT bytes, its edges as (node * 256 + byte, node).
        heads = sorted({p[:SHORT] for p in pieces if len(p) > SHORT})
        node = {h: k for k, h in enumerate(heads)}
        edges: dict[int, int] = {}
        ends: dict[int, int] = {}
        for i, p in enumerate(pieces):
            if len(p) > SHORT:
                at = node[p[:SHORT]]
                for b in p[SHORT:]:
                    at = edges.setdefault(at * 256 + b, len(heads) + len(edges))
                ends[at] = i
        self.heads = np.array([int.from_bytes(h) for h in heads], np.uint64)
        self.edges = np.array(sorted(edges), np.int64)
        self.to = np.array([edges[k] for k in sorted(edges)], np.int64)
        self.piece = np.array([ends.get(k, -1) for k in range(len(heads) + len(edges))], np.int32)

    def find(self, words: np.ndarray) -> Found:
        """The pieces in ``words`` (rows of bytes)."""
        out, longer = [], []
        width = words.shape[1]
        for i in range(width):
            key, at = np.zeros(len(words), np.uint64), []
            for n in range(min(SHORT, width - i)):
                key = (key << np.uint64(8)) | words[:, i + n].astype(np.uint64)
                keys = self.keys[n]
                if not len(keys):
                    at.append(np.full(len(words), self.size, np.int32))
                    continue
                k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                at.append(np.where(keys[k] == key, self.ids[n][k], np.int32(self.size)))
            out.append(at)
            if width - i > SHORT and len(self.heads):
                node = np.minimum(np.searchsorted(self.heads, key), len(self.heads) - 1)
                own = np.flatnonzero(self.heads[node] == key)
                node = node[own]
                for end in range(i + SHORT, width):
                    if not len(own):
                        break
                    step = node * 256 + words[own, end]
                    k = np.minimum(np.searchsorted(self.edges, step), len(self.edges) - 1)
                    on = self.edges[k] == step
                    own, node = own[on], self.to[k[on]]
                    whole = self.piece[node] >= 0
                    if whole.any():
                        longer.append((i, end + 1, own[whole], self.piece[node[whole]]))
        return Found(out, longer)

    def line(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces in one word, by their ends: starts, ends, piece numbers."""
        data, width = np.frombuffer(raw, np.uint8), len(raw)
        out, key = [], np.zeros(width + 1, np.uint64)
        for n in range(1, min(SHORT, width) + 1):
            key = (key[: width - n + 1] << np.uint64(8)) | data[n - 1 :].astype(np.uint64)
            keys = self.keys[n - 1]
            if len(keys):
                k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                own = np.flatnonzero(keys[k] == key)
                out.append((own, own + n, self.ids[n - 1][k[own]]))
        if width > SHORT and len(self.heads):
            node = np.minimum(np.searchsorted(self.heads, key), len(self.heads) - 1)
            own = np.flatnonzero(self.heads[node] == key)
            node, end = node[own], own + SHORT
            while len(own):
                inside = end < width
                own, node, end = own[inside], node[inside], end[inside]
                step = node * 256 + data[end]
                k = np.minimum(np.searchsorted(self.edges, step), len(self.edges) - 1)
                on = self.edges[k] == step
                own, node, end = own[on], self.to[k[on]], end[on] + 1
                whole = self.piece[node] >= 0
                out.append((own[whole], end[whole], self.piece[node[whole]]))
        start, end, ids = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((start, end))
        return start[order], end[order], ids[order]


def _sum_to(at: np.ndarray, ends: np.ndarray, logs: np.ndarray, width: int) -> np.ndarray:
    """The logarithms of the sums over ways to each place: a row a place, a column a language. Pieces come by their ends."""
    out = np.zeros((width + 1, logs.shape[1]))
    cut = np.searchsorted(ends, np.arange(1, width + 2)).tolist()
    for j, (a, z) in enumerate(zip(cut, cut[1:], strict=False), start=1):
        x = out[at[a:z]] + logs[a:z]
        top = x.max(axis=0)
        out[j] = top + np.log(np.exp(x - top).sum(axis=0))
    return out


def _expected_in(line: tuple[np.ndarray, np.ndarray, np.ndarray], p: np.ndarray, times: float, width: int) -> np.ndarray:
    """How often each piece is expected in one word, by forward and backward sums."""
    start, end, ids = line
    logs = np.log(p[ids])
    forward = _sum_to(start, end, logs, width)
    # Backward is forward in the word read from its end.
    order = np.lexsort((width - end, width - start))
    backward = _sum_to((width - end)[order], (width - start)[order], logs[order], width)[::-1]
    share = np.exp(forward[start, 0] + logs[:, 0] + backward[end, 0] - forward[width, 0])
    return np.bincount(ids, share * times, len(p))


def _forward(found: Found, probs: np.ndarray, n_words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Forward sums by position (scaled) and the logarithm of each word's scale. ``probs``: pieces + 1 rows, a column a language."""
    length, scale = len(found.short), np.zeros((n_words, probs.shape[1]))
    alpha = [np.ones((n_words, probs.shape[1]))]
    ending: dict[int, list] = {}
    for start, end, own, ids in found.longer:
        ending.setdefault(end, []).append((start, own, ids))
    reach = max([SHORT, *(end - start for start, end, _, _ in found.longer)])
    for j in range(1, length + 1):
        total = np.zeros_like(alpha[0])
        for n in range(1, min(SHORT, j) + 1):
            total += alpha[j - n] * probs[found.short[j - n][n - 1]]
        for start, own, ids in ending.get(j, ()):
            total[own] += alpha[start][own] * probs[ids]
        alpha.append(total)
        if j % 16 == 0:
            top = total.copy()
            scale += np.log(top)
            for back in range(max(0, j - reach), j + 1):
                alpha[back] = alpha[back] / top
    return alpha, scale


def letters(word: str) -> bytes | None:
    """The letters and marks of a word as the bytes to score; None if it has no letter."""
    word = word.lower()
    if not word.isalpha():
        if not any(map(str.isalpha, word)):
            return None
        word = "".join(c for c in word if c.isalpha() or unicodedata.category(c)[0] == "M")
    return b" " + word.encode()


@dataclass
class Model:
    langs: list[str]
    pieces: list[bytes]
    probs: np.ndarray

    def __post_init__(self) -> None:
        self._start()

    def _start(self) -> None:
        self._lattice = Lattice(self.pieces)
        self._row: dict[str, int] = {}
        self._held = 0
        self._logs: np.ndarray | None = None
        self._scores = np.zeros((0, len(self.langs)))

    def __getstate__(self) -> tuple:
        return self.langs, self.pieces, self.probs

    def __setstate__(self, state: tuple) -> None:
        self.langs, self.pieces, self.probs = state
        self._start()

    def score_words(self, words: list[str]) -> np.ndarray:
        """A row of log probabilities by language for each word; zeros where it has no letter."""
        out = np.zeros((len(words), len(self.langs)))
        by_length: dict[int, list[tuple[int, bytes]]] = {}
        for i, w in enumerate(words):
            raw = letters(w)
            if raw and len(raw) <= MANY:
                by_length.setdefault(len(raw), []).append((i, raw))
            elif raw:
                if self._logs is None:
                    self._logs = np.log(self.probs[:-1])
                start, end, ids = self._lattice.line(raw)
                out[i] = _sum_to(start, end, self._logs[ids], len(raw))[-1]
        for n, all_of_n in by_length.items():
            for at in range(0, len(all_of_n), 1 << 14):
                part = all_of_n[at : at + (1 << 14)]
                raw = np.frombuffer(b"".join(r for _, r in part), np.uint8).reshape(-1, n)
                alpha, scale = _forward(self._lattice.find(raw), self.probs, len(part))
                out[[i for i, _ in part]] = np.log(alpha[n]) + scale
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [(t or "").split() for t in texts]
        seen = set().union(*split) if split else set()
        new = [w for w in seen if w not in self._row]
        self._held += sum(map(len, new))
        if len(self._row) + len(new) > REMEMBERED or self._held > REMEMBERED_LETTERS:
            self._row, self._scores, new = {}, self._scores[:0], list(seen)
            self._held = sum(map(len, new))
        if new:
            self._row.update(zip(new, range(len(self._row), len(self._row) + len(new)), strict=True))
            self._scores = np.concatenate((self._scores, self.score_words(new)))
        out = []
        for words in split:
            total = self._scores[np.fromiter(map(self._row.__getitem__, words), np.int64, len(words))].sum(axis=0)
            if not self.langs or not total.any():
                out.append((UNKNOWN, 0.0))
                continue
            k = int(total.argmax())
            out.append((self.langs[k], float(1 / np.exp(total - total[k]).sum())))
        return out


def fit(counts: list[tuple[str, str, int]], pieces: list[bytes], rounds: int = ROUNDS) -> Model:
    """From (language, word, count) rows."""
    langs = sorted({c[0] for c in counts})
    return fit_each(((lang, [c[1:] for c in counts if c[0] == lang]) for lang in langs), pieces, rounds)


def fit_each(words: Iterable[tuple[str, list[tuple[str, int]]]], pieces: list[bytes], rounds: int = ROUNDS) -> Model:
    """From each language, in code point order, and its (word, count) rows."""
    lattice, n_pieces = Lattice(pieces), len(pieces)
    langs, columns = [], []
    for lang, counts in words:
        by_length: dict[int, dict[bytes, int]] = {}
        for word, n in counts:
            raw = letters(word)
            if raw:
                own = by_length.setdefault(len(raw), {})
                own[raw] = own.get(raw, 0) + n
        found = [(np.array(list(own.values()), float), lattice.find(np.frombuffer(b"".join(own), np.uint8).reshape(-1, n))) for n, own in sorted(by_length.items()) if n <= MANY]
        lines = [(float(times), lattice.line(raw), n) for n, own in sorted(by_length.items()) if n > MANY for raw, times in own.items()]
        # The start: all pieces of a length alike, longer ones a little less likely.
        p = np.append(np.array([4.0 ** -len(x) for x in pieces]), 0.0)[:, None]
        p /= p.sum()
        for _ in range(rounds):
            expected = np.zeros(n_pieces + 1)
            for times, lat in found:
                expected += _expected(lat, p, times)
            for times, line, n in lines:
                expected += _expected_in(line, p, times, n)
            p = np.append(expected[:n_pieces] + ADDED, 0.0)[:, None]
            p /= p.sum()
        langs.append(lang)
        columns.append(p[:, 0])
    return Model(langs, pieces, np.stack(columns, axis=1) if columns else np.zeros((n_pieces + 1, 0)))


def _expected(found: Found, p: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often each piece is expected in words of one length, by forward and backward sums."""
    short, length, n = found.short, len(found.short), len(times)
    alpha, beta = [np.ones(n)], [np.ones(n) for _ in range(length + 1)]
    p = p[:, 0]
    ending: dict[int, list] = {}
    starting: dict[int, list] = {}
    for start, end, own, ids in found.longer:
        ending.setdefault(end, []).append((start, own, ids))
        starting.setdefault(start, []).append((end, own, ids))
    for j in range(1, length + 1):
        total = sum(alpha[j - k] * p[short[j - k][k - 1]] for k in range(1, min(SHORT, j) + 1))
        for start, own, ids in ending.get(j, ()):
            total[own] += alpha[start][own] * p[ids]
        alpha.append(total)
    for i in range(length - 1, -1, -1):
        beta[i] = sum(beta[i + k] * p[short[i][k - 1]] for k in range(1, min(SHORT, length - i) + 1))
        for end, own, ids in starting.get(i, ()):
            beta[i][own] += beta[end][own] * p[ids]
    out = np.zeros(len(p))
    whole = np.where(alpha[length] > 0, alpha[length], np.inf)
    for i in range(length):
        for k in range(1, min(SHORT, length - i) + 1):
            share = alpha[i] * p[short[i][k - 1]] * beta[i + k] / whole * times
            out += np.bincount(short[i][k - 1], share, len(p))
    for start, end, own, ids in found.longer:
        np.add.at(out, ids, alpha[start][own] * p[ids] * beta[end][own] / whole[own] * times[own])
    return out


def train(docs: DataFrame, vocabulary: str, docs_a_language: int = DOCS_A_LANGUAGE) -> Model:
    """Fit on the rows of ``docs(doc_id, text, lang)`` that have a language."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("draw"))
    # One row a language, as the model has a column for each; a join would shuffle every text.
    sizes = known.groupBy("lang").count().collect()
    if not sizes:
        return fit([], read_pieces(vocabulary))
    most = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], docs_a_language / r["count"] * (1 << 30))))
    drawn = known.where(F.col("draw") < F.element_at(most, F.col("lang")))
    words = checkpointed(drawn.select("lang", F.explode(F.split("text", r"(?U)\s+")).alias("word")).groupBy("lang", "word").count())
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    own = lambda lang: sorted((r["word"], r["count"]) for r in words.where(F.col("lang") == lang).select("word", "count").collect())
    return fit_each(((lang, own(lang)) for lang in langs), read_pieces(vocabulary))


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``docs``' columns ``keep`` with ``langid_pred`` and ``langid_score``, the model's share for that language."""
    given = packed(docs, keep, F.col(text).alias("langid_text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                got = m.predict(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["kept", "langid_pred", "langid_score"])

    return beside(map_batches(given, run, packed_kind(given, "langid_pred string, langid_score double")), keep)
