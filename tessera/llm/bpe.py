"""Byte-level BPE with forced boundaries, to and from the ids of a public tokenizer file.

The text is cut at added tokens and into the pattern's pieces, each read in the whole text's context. Then
forced boundaries cut the pieces: two neighbouring bytes that occur inside no token of the vocabulary
can never be merged, so a cut between them is certain. The fragments are encoded independently, each distinct one
once, and their ids are concatenated. Decoding joins the bytes of the ids and reads them as UTF-8.

Defined cases: a null text is empty and has no ids; an empty table gives no rows; repeated rows are encoded alike;
long texts are encoded whole, in slices of pieces; other columns pass by name; ids outside the
vocabulary raise ``KeyError`` on decoding.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import beside, map_batches, packed, packed_kind

#: The byte-level pattern (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces whose ids a worker remembers; then it starts anew.
REMEMBERED = 400_000
SLICE = 1 << 18


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next free one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


class ForcedBoundaryBpe:
    """A byte-level BPE tokenizer read from a ``tokenizers`` file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, models

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self._to_letters = {b: c for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes: dict[int, bytes] = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.together = np.zeros((256, 256), bool)
        for t in vocab:
            if t not in self.special:
                raw = np.array([byte_of[c] for c in t], np.uint8)
                self.together[raw[:-1], raw[1:]] = True
        self._model = Tokenizer(models.BPE(vocab={t: i for t, i in vocab.items()}, merges=[tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]))
        self._piece = regex.compile(PATTERN)
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._ids: dict[str, bytes] = {}

    def fragments(self, pieces: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """The fragments of all pieces in order, and how many each piece has."""
        whole = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        cut = np.ones(len(whole), bool)
        cut[1:] = ~self.together[whole[:-1], whole[1:]]
        cut[np.concatenate(([0], ends[:-1]))] = True
        starts = np.flatnonzero(cut)
        raw = whole.tobytes()
        stops = [*starts[1:].tolist(), len(raw)]
        counts = np.diff(np.searchsorted(starts, np.concatenate(([0], ends))))
        return [raw[a:b] for a, b in zip(starts.tolist(), stops, strict=True)], counts

    def _learn(self, new: list[str]) -> None:
        if not new:
            return
        frags, counts = self.fragments([p.encode() for p in new])
        distinct = list(dict.fromkeys(frags))
        spelt = [f.decode("latin-1").translate(self._to_letters) for f in distinct]
        coded = {f: np.array(e.ids, "<u4").tobytes() for f, e in zip(distinct, self._model.encode_batch_fast(spelt, add_special_tokens=False), strict=True)}
        at = 0
        for p, n in zip(new, counts.tolist(), strict=True):
            self._ids[p] = coded[frags[at]] if n == 1 else b"".join(coded[f] for f in frags[at : at + n])
            at += n

    def _ordinary(self, text: str) -> Iterator[bytes]:
        """Little-endian 32-bit ids of a text without added tokens, in slices."""
        slices = [self._piece.findall(text)] if len(text) < SLICE * 16 else batched((m[0] for m in self._piece.finditer(text)), SLICE)
        for pieces in slices:
            seen = set(pieces)
            missing = [p for p in seen if p not in self._ids]
            if len(self._ids) + len(missing) > REMEMBERED:
                self._ids.clear()
                missing = list(seen)
            self._learn(missing)
            yield b"".join(map(self._ids.__getitem__, pieces))

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text."""
        text, out, at = text or "", [], 0
        if self._special:
            for m in self._special.finditer(text):
                out += [*self._ordinary(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
                at = m.end()
        out += self._ordinary(text[at:] if at else text)
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def tokenizer(path: str) -> ForcedBoundaryBpe:
    return ForcedBoundaryBpe(path)


def _map_texts(docs: DataFrame, keep: list[str], text: str, added: str, make: Callable[[list], list[pa.Array]]) -> DataFrame:
    given = packed(docs, keep, F.col(text).alias("bpe_text"))
    names = ["kept", *(a.split()[0] for a in added.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *make(part.column(part.num_columns - 1))], names)

    return beside(map_batches(given, run, packed_kind(given, added)), keep)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(ids) if ids else np.empty(0)
    offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def encode(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``docs``' columns ``keep`` with ``bpe_ids``."""

    def make(texts: pa.Array) -> list[pa.Array]:
        t = tokenizer(path)
        return [_lists([t.encode(x.as_py()) for x in texts])]

    return _map_texts(docs, keep, text, "bpe_ids array<int>", make)


def round_trip(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` with ``bpe_ids`` and ``bpe_decoded``, what they decode to: one pass, one worker a task."""

    def make(texts: pa.Array) -> list[pa.Array]:
        t = tokenizer(path)
        ids = [t.encode(x.as_py()) for x in texts]
        return [_lists(ids), pa.array(list(map(t.decode, ids)), pa.string())]

    return _map_texts(docs, keep, text, "bpe_ids array<int>, bpe_decoded string", make)


def decode(coded: DataFrame, path: str, keep: list[str], ids: str = "bpe_ids") -> DataFrame:
    """``coded``'s columns ``keep`` with ``bpe_decoded``."""

    def make(rows: pa.Array) -> list[pa.Array]:
        t = tokenizer(path)
        return [pa.array([t.decode(r.values.to_numpy()) if r.is_valid else None for r in rows], pa.string())]

    return _map_texts(coded, keep, ids, "bpe_decoded string", make)


def digests(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: encode and decode in one pass."""

    def make(texts: pa.Array) -> list[pa.Array]:
        t = tokenizer(path)
        n, coded, plain = [], [], []
        for x in texts:
            ids = t.encode(x.as_py())
            n.append(len(ids))
            coded.append(hashlib.sha256(ids.tobytes()).hexdigest())
            plain.append(hashlib.sha256(t.decode(ids).encode()).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())]

    return _map_texts(docs, keep, text, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", make)
