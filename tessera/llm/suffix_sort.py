"""External induced sorting of suffixes, with common-prefix values.

Suffixes are sorted by induction. A suffix is small (S) if it is less than the one that follows it in the text,
and large (L) otherwise; an S suffix after an L one is a seed. A first induction, from seeds in the order of their
letters, sorts the pieces between seeds; the ranks of the pieces are the letters of a shorter text, whose suffixes are
sorted by the same function, until all ranks differ. The second induction, from the sorted seeds, gives the order.

An induction is two scans. The first goes up and puts the predecessor of each suffix, if that is L, into a priority
queue; the second goes down and does so for S. It is the same scan in mirrored letters: letter by letter first what the
queue has, then what was given (the seeds, or the L suffixes). Within a letter first in is first out, so a tuple's place
is known when it enters. The tuples are (letter, suffix, common prefix with the one before): the common prefix of
two neighbours is one more than the least between their sources in the scan, up to ``cap``.

Memory: letters are dealt into bins of at most ``memory`` tuples. The bin being scanned is in memory; tuples for
others wait in its queue, on disk beyond ``memory`` tuples in all. A letter of more tuples is a bin of its own and is
streamed. Text, seeds, ranks and orders are ``scratch`` arrays, which are files if longer than that, and are
gone through in runs. Files are unlinked at once, in the folder that Spark gives its workers for spilling.

Letters are whole numbers; the last must be 0 and occur once. Work is done on runs of tuples with numpy.
"""

from __future__ import annotations

import mmap
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

RUN = 1 << 15
MEMORY = 1 << 21

Run = tuple[np.ndarray, np.ndarray]


def _file() -> tempfile._TemporaryFileWrapper:
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)


def scratch(n: int, kind: type, memory: int) -> np.ndarray:
    """An array of ``n`` zeros: a file if there are over ``memory``."""
    if n <= memory:
        return np.zeros(n, kind)
    size = n * np.dtype(kind).itemsize
    with _file() as f:
        f.truncate(size)
        return np.frombuffer(mmap.mmap(f.fileno(), size), kind)


class Spool:
    """An array that grows, in a file."""

    def __init__(self, kind: type):
        self.kind, self.n, self.file = kind, 0, _file()

    def __len__(self) -> int:
        return self.n

    def add(self, x: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(x, self.kind).data)
        self.n += len(x)

    def array(self, memory: int) -> np.ndarray:
        """What was added: read into memory unless it is over ``memory`` entries."""
        self.file.flush()
        if not self.n:
            return np.zeros(0, self.kind)
        with self.file as f:
            if self.n > memory:
                return np.frombuffer(mmap.mmap(f.fileno(), 0), self.kind)
            f.seek(0)
            return np.frombuffer(f.read(), self.kind)


class Queues:
    """First-in-first-out queues of (letter, suffix, common prefix) by bin, on disk beyond ``memory`` tuples."""

    def __init__(self, memory: int, *kinds: type):
        self.memory, self.kinds, self.held, self.file = memory, kinds, 0, None
        self.by: dict[int, list] = {}

    def push(self, bin_: int, *cols: np.ndarray) -> None:
        self.by.setdefault(bin_, []).append(cols)
        self.held += len(cols[0])
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or _file()
        self.file.seek(0, 2)
        for bin_, runs in self.by.items():
            k = next((k for k, r in enumerate(runs) if isinstance(r[0], np.ndarray)), len(runs))
            if k < len(runs):
                cols = [np.concatenate(c) for c in zip(*runs[k:], strict=True)]
                place = self.file.tell()
                for c, kind in zip(cols, self.kinds, strict=True):
                    self.file.write(c.astype(kind, copy=False).tobytes())
                self.by[bin_] = [*runs[:k], (place, len(cols[0]))]
        self.held = 0

    def pop(self, bin_: int) -> Iterator[list[np.ndarray]]:
        """The tuples of a bin in runs, also those put in meanwhile."""
        while self.by.get(bin_):
            # Short runs in memory go together.
            runs, n = self.by[bin_], 0
            k = 0
            while k < len(runs) and n < RUN and isinstance(runs[k][0], np.ndarray):
                n += len(runs[k][0])
                k += 1
            if k:
                self.by[bin_] = runs[k:]
                self.held -= n
                cols = [np.concatenate(c) for c in zip(*runs[:k], strict=True)] if k > 1 else list(runs[0])
                for at in range(0, n, RUN):
                    yield [c[at : at + RUN] for c in cols]
            else:
                place, n = runs[0]
                self.by[bin_] = runs[1:]
                for at in range(0, n, RUN):
                    m, cols, base = min(RUN, n - at), [], place
                    for kind in self.kinds:
                        size = np.dtype(kind).itemsize
                        self.file.seek(base + at * size)
                        cols.append(np.frombuffer(self.file.read(m * size), kind))
                        base += n * size
                    yield cols
        self.by.pop(bin_, None)

    def close(self) -> None:
        if self.file:
            self.file.close()


class _Least:
    """For each letter, the least common prefix scanned since it was last put into its queue."""

    def __init__(self, letters: int, cap: int):
        self.since, self.cap = np.full(letters, cap, np.int32), cap

    def between(self, lcp: np.ndarray, letter: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For tuples ``at`` places of the run ``lcp``, put into the queue of ``letter`` (sorted, places rising):
        one more than the least value since that letter's tuple before."""
        m = len(lcp)
        if not len(at):
            self.since = np.minimum(self.since, lcp.min())
            return np.empty(0, np.int32)
        first = np.ones(len(at), bool)
        first[1:] = letter[1:] != letter[:-1]
        out = np.minimum(np.minimum.accumulate(lcp)[at], self.since[letter])
        if not first.all():
            before, here = at[:-1][~first[1:]] + 1, at[1:][~first[1:]]
            span = here - before + 1
            level = np.frexp(span.astype(np.float32))[1] - 1
            least, got = lcp, np.empty(len(here), np.int32)
            for k in range(int(level.max()) + 1):
                if k:
                    half = 1 << (k - 1)
                    least = np.minimum(least[: m - (1 << k) + 1], least[half : half + m - (1 << k) + 1])
                own = np.flatnonzero(level == k)
                got[own] = np.minimum(least[before[own]], least[here[own] - (1 << k) + 1])
            out[~first] = got
        self.since = np.minimum(self.since, lcp.min())
        last = np.ones(len(at), bool)
        last[:-1] = first[1:]
        rest = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.int32(self.cap))
        self.since[letter[last]] = rest[at[last] + 1]
        return np.minimum(out + 1, self.cap).astype(np.int32)


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """The common prefixes of suffix pairs, up to ``cap``: eight bytes at once in a text of bytes, else letter by letter."""
    out, n = np.zeros(len(a), np.int32), len(text)
    alive = np.arange(len(a))
    if text.dtype == np.uint8 and n >= 8:
        eight = np.ndarray(n - 7, "<u8", text, strides=(1,))
        k = 0
        while len(alive) and k < cap:
            x, y = a[alive] + k, b[alive] + k
            inner = np.maximum(x, y) < n - 7
            alive, x, y = alive[inner], x[inner], y[inner]
            differ = eight[x] ^ eight[y]
            some = differ != 0
            low = differ[some] & (~differ[some] + np.uint64(1))
            out[alive[some]] += (np.frexp(low.astype(np.float64))[1].astype(np.int32) - 1) >> 3
            alive = alive[~some]
            out[alive] += 8
            k += 8
        # What ends near the end of the text is looked at letter by letter.
        alive = np.flatnonzero((np.maximum(a, b) + out >= n - 7) & (out < cap))
    while len(alive):
        x, y = a[alive] + out[alive], b[alive] + out[alive]
        same = (np.maximum(x, y) < n) & (text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)])
        alive = alive[same]
        out[alive] += 1
        alive = alive[out[alive] < cap]
    return np.minimum(out, cap)


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where each value of an ordered array starts."""
    new = np.empty(len(ordered), bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return new.nonzero()[0]


def _sizes(starts: np.ndarray, n: int) -> np.ndarray:
    out = np.empty_like(starts)
    np.subtract(starts[1:], starts[:-1], out=out[:-1])
    out[-1:] = n - starts[-1:]
    return out


def _run_of(text: np.ndarray, at: int, cap: int) -> int:
    part = text[at : at + cap]
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


def _bins(queued: np.ndarray, given: np.ndarray, memory: int) -> np.ndarray:
    """The first letter of each bin: bins have at most ``memory`` tuples, or one letter."""
    firsts, held, letters = [0], 0, len(queued)
    for at in range(0, letters, RUN):
        upto = np.cumsum(queued[at : at + RUN], dtype=np.int64) + np.cumsum(given[at : at + RUN], dtype=np.int64)
        base, k = 0, 0
        while k < len(upto):
            room = memory - held + base
            stop = int(np.searchsorted(upto, room, side="right"))
            if stop == len(upto):
                held += int(upto[-1]) - base
                break
            if at + stop > firsts[-1]:
                firsts.append(at + stop)
            else:
                stop += 1  # more than memory by itself
                if at + stop < letters:
                    firsts.append(at + stop)
            base, held, k = int(upto[stop - 1]) if stop else 0, 0, stop
    return np.array(firsts)


def _scan(text: np.ndarray, top: int | None, queued: np.ndarray, given: np.ndarray, read: Callable[[int, int], Run], cap: int, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of (suffix, common prefix with the one before, whether it was given) in scan order.

    ``queued`` and ``given`` count the tuples of each letter; ``read`` gets given ones by number. With ``top`` letters
    are mirrored: ``top`` less the letter.
    """
    letters = len(queued)
    firsts = _bins(queued, given, memory)
    wide = np.int32 if len(text) < 1 << 31 else np.int64
    queues = Queues(memory, np.int32, wide, _narrow(cap))
    least = _Least(letters, cap) if cap else None
    n_given = 0

    def preds(at: np.ndarray, lcp: np.ndarray, own: np.ndarray | int, was_given: np.ndarray | bool) -> tuple[np.ndarray, ...]:
        """What the run puts into queues, ordered by letter: letters, suffixes, common prefixes."""
        before = at - 1
        letter = text[before].astype(np.int32)
        if top is not None:
            letter = top - letter
        place = ((letter >= own + was_given) & (at > 0)).nonzero()[0]
        letter = letter[place]
        order = (letter.astype(np.int16) if letters < 1 << 15 else letter).argsort(kind="stable")
        letter, place = letter[order], place[order]
        return letter, before[place], least.between(lcp, letter, place) if cap else lcp[: len(place)]

    def enqueue(letter: np.ndarray, at: np.ndarray, lcp: np.ndarray) -> None:
        if len(letter):
            bins = np.searchsorted(firsts, letter, side="right") - 1
            cut = _starts(bins).tolist()
            for s, e in zip(cut, [*cut[1:], len(bins)], strict=True):
                queues.push(int(bins[s]), letter[s:e], at[s:e], lcp[s:e])

    for b, lo in enumerate(firsts.tolist()):
        hi = int(firsts[b + 1]) if b + 1 < len(firsts) else letters
        q, g = queued[lo:hi].astype(np.int64), given[lo:hi].astype(np.int64)
        size, bin_given = int(q.sum() + g.sum()), int(g.sum())
        if not size:
            continue
        if hi == lo + 1 and size > memory:
            last = None
            for _, at, lcp in queues.pop(b):
                lcp = lcp.astype(np.int32)
                if last is None:
                    lcp[0] = 0
                last = int(at[-1])
                yield at, lcp, np.zeros(len(at), bool)
                enqueue(*preds(at, lcp, lo, 0))
            for k in range(0, bin_given, RUN):
                at, lcp = read(n_given + k, n_given + min(k + RUN, bin_given))
                lcp = lcp.astype(np.int32)
                if not k:
                    lcp[0] = min(_run_of(text, last, cap), _run_of(text, int(at[0]), cap)) if cap and last is not None else 0
                yield at, lcp, np.ones(len(at), bool)
                enqueue(*preds(at, lcp, lo, 1))
        else:
            ends = np.cumsum(q + g)
            begin = ends - q - g
            at, lcp = np.full(size, -1, wide), np.zeros(size, np.int32)
            own = np.repeat(np.arange(lo, hi, dtype=np.int32), q + g)
            was_given = np.zeros(size, np.int8)
            slots = np.arange(bin_given) + np.repeat(ends - np.cumsum(g), g)
            was_given[slots] = 1
            at[slots], lcp[slots] = read(n_given, n_given + bin_given)
            # The first of a letter has nothing in common with the one before; the first given one is seen to below.
            lcp[begin[q + g > 0]] = 0
            heads = begin.copy()

            def settle(letter: np.ndarray, suffix: np.ndarray, common: np.ndarray, lo: int = lo, begin: np.ndarray = begin, heads: np.ndarray = heads, at: np.ndarray = at, lcp: np.ndarray = lcp) -> None:
                """Tuples, ordered by letter, take the next places of their letters."""
                if not len(letter):
                    return
                letter = letter - lo
                new = _starts(letter)
                n = _sizes(new, len(letter))
                which = letter[new]
                head = heads[which]
                place = np.arange(len(letter)) + np.repeat(head - new, n)
                at[place] = suffix
                heads[which] = head + n
                if cap:
                    lcp[place] = common
                    lcp[head[head == begin[which]]] = 0

            for letter, suffix, common in queues.pop(b):
                order = np.argsort(letter, kind="stable")
                settle(letter[order], suffix[order], common[order])
            first_given = np.flatnonzero((q > 0) & (g > 0)) if cap else ()
            seams = (begin + q)[first_given] if cap else np.empty(0, np.int64)
            p, step = 0, RUN
            while p < size:
                part = at[p : p + step]
                stop = int(np.argmin(part)) if part.min() < 0 else len(part)
                u = p + (stop if part[stop % len(part)] < 0 else len(part))
                step = min(RUN, max(256, 4 * (u - p)))
                for s in seams[np.searchsorted(seams, p) : np.searchsorted(seams, u)].tolist():
                    lcp[s] = min(_run_of(text, int(at[s - 1]), cap), _run_of(text, int(at[s]), cap))
                yield at[p:u], lcp[p:u], was_given[p:u].view(bool)
                letter, suffix, common = preds(at[p:u], lcp[p:u], own[p:u], was_given[p:u])
                inner = int(letter.searchsorted(hi)) if hi < letters else len(letter)
                settle(letter[:inner], suffix[:inner], common[:inner])
                enqueue(letter[inner:], suffix[inner:], common[inner:])
                p = u
        n_given += bin_given
    queues.close()


def _narrow(cap: int) -> type:
    """The type in which common prefixes are kept."""
    return np.uint8 if cap < 1 << 8 else np.int32


class _Text:
    """A text, its counts of large and small suffixes by letter, and its seeds, found in runs from its end."""

    def __init__(self, text: np.ndarray, memory: int):
        n = len(text)
        self.text, self.memory = text, memory
        self.wide = np.int32 if n < 1 << 31 else np.int64
        self.top = max(int(text[k : k + RUN].max()) for k in range(0, n, RUN))
        self.large, self.small, self.seeded = (scratch(self.top + 1, self.wide, memory) for _ in range(3))
        found, n_seeds = Queues(memory, self.wide), 0
        # Of the run that follows: its first letter and whether its first suffix is small.
        after, after_small = -1, True
        for end in range(n, 0, -RUN):
            lo = max(0, end - RUN)
            part = text[lo:end].astype(np.int64)
            follow = np.append(part[1:], after)
            differs = part != follow
            differs[-1] |= after < 0
            near = np.minimum.accumulate(np.where(differs, np.arange(len(part)), len(part))[::-1])[::-1]
            rises = np.append(follow > part, after_small)
            if after < 0:
                rises[len(part) - 1] = True  # the last suffix is small
            small = rises[near]
            self._count(self.large, part[~small])
            self._count(self.small, part[small])
            # A seed is small after a large one; the first of the run after this one is known only now.
            nxt = np.append(small[1:], after_small)
            seed = np.flatnonzero(~small & nxt) + lo + 1
            seed = seed[seed < n]
            if len(seed):
                found.push(0, seed[::-1].astype(self.wide))
                n_seeds += len(seed)
                self._count(self.seeded, text[seed].astype(np.int64))
            after, after_small = int(part[0]), bool(small[0])
        self.small[0] -= 1  # the last suffix enters no queue
        self.seeds = scratch(n_seeds, self.wide, memory)
        k = n_seeds
        for (run,) in found.pop(0):
            self.seeds[k - len(run) : k] = run[::-1]
            k -= len(run)
        found.close()

    @staticmethod
    def _count(into: np.ndarray, letters: np.ndarray) -> None:
        if len(into) <= RUN:
            into += np.bincount(letters, minlength=len(into)).astype(into.dtype)
        else:
            which, n = np.unique(letters, return_counts=True)
            into[which] += n.astype(into.dtype)

    def induce(self, seeds: np.ndarray, seed_lcp: np.ndarray | None, cap: int) -> Iterator[Run]:
        """Runs of (suffix, common prefix with the one before) from the greatest suffix down, from seeds in order."""
        m = int(sum(int(self.large[k : k + RUN].sum(dtype=np.int64)) for k in range(0, len(self.large), RUN)))
        ats, lcps = scratch(m, self.wide, self.memory), scratch(m if cap else 0, _narrow(cap), self.memory)
        k = 0
        none = np.zeros(0, np.int32)

        def seed(a: int, z: int) -> Run:
            return seeds[a:z], seed_lcp[a:z] if cap else np.zeros(z - a, np.int32)

        for at, lcp, given in _scan(self.text, None, self.large, self.seeded, seed, cap, self.memory):
            own = at[~given]
            ats[k : k + len(own)] = own
            if cap:
                lcps[k : k + len(own)] = lcp[~given]
            k += len(own)

        def down(a: int, z: int) -> Run:
            if not cap:
                return ats[m - z : m - a][::-1], np.zeros(z - a, np.int32)
            # The common prefix with the next suffix up, which comes before in this direction.
            lcp = lcps[m - z + 1 : m - a + 1][::-1]
            return ats[m - z : m - a][::-1], np.append(lcp.dtype.type(0), lcp) if a == 0 else lcp

        for at, lcp, _ in _scan(self.text, self.top, self.small[::-1], self.large[::-1], down, cap, self.memory):
            yield at, lcp
        yield np.array([len(self.text) - 1], self.wide), (np.zeros(1, np.int32) if cap else none)

    def sorted_seeds(self) -> np.ndarray:
        """The seeds in the order of their suffixes."""
        n, m, memory, seeds, text = len(self.text), len(self.seeds), self.memory, self.seeds, self.text
        if m < 2:
            return seeds
        # Seeds by their letters: a place for each.
        rough = scratch(m, self.wide, memory)
        heads = scratch(len(self.seeded), self.wide, memory)
        upto = 0
        for k in range(0, len(heads), RUN):
            part = np.cumsum(self.seeded[k : k + RUN], dtype=np.int64)
            heads[k : k + RUN] = upto + part - self.seeded[k : k + RUN]
            upto += int(part[-1])
        # The number of a seed: those before its block of 256 letters (which has 128 at most), and those in it up to the seed.
        blocks = self._blocks()
        inside = scratch(n, np.uint8, memory)
        for k in range(0, m, RUN):
            part = seeds[k : k + RUN]
            inside[part] = np.arange(k + 1, k + len(part) + 1) - blocks[part >> 8]
            letter = text[part].astype(np.int64)
            order = np.argsort(letter, kind="stable")
            letter = letter[order]
            new = _starts(letter)
            size = _sizes(new, len(letter))
            rough[np.arange(len(letter)) + np.repeat(heads[letter[new]] - new, size)] = part[order]
            heads[letter[new]] += size
        names = scratch(m, self.wide, memory)
        last, k = None, -1
        for at, _ in self.induce(rough, None, 0):
            which = inside[at]
            own = which.nonzero()[0]
            which = blocks[at[own] >> 8] + which[own].astype(np.int64) - 1
            if not len(which):
                continue
            both = which if last is None else np.append(last, which)
            differs = self._piece_differs(both[:-1], both[1:])
            rank = np.cumsum(differs) + k if last is not None else k + 1 + np.append(0, np.cumsum(differs))
            names[which] = rank
            last, k = which[-1], int(rank[-1])
        del inside, blocks, rough
        # Names fall with the order so far.
        for at in range(0, m, RUN):
            names[at : at + RUN] = k - names[at : at + RUN]
        order = scratch(m, self.wide, memory)
        if k == m - 1:
            for at in range(0, m, RUN):
                part = names[at : at + RUN]
                order[part] = seeds[at : at + RUN]
            return order
        z = m
        shorter = _Text(names, memory)
        for at, _ in shorter.induce(shorter.sorted_seeds(), None, 0):
            order[z - len(at) : z] = seeds[at[::-1]]
            z -= len(at)
        return order

    def _blocks(self) -> np.ndarray:
        """For each block of 256 letters, how many seeds are before it."""
        n = -(-len(self.text) // 256)
        out = scratch(n, self.wide, self.memory)
        for k in range(0, n, RUN):
            out[k : k + RUN] = np.searchsorted(self.seeds, np.arange(k, min(k + RUN, n)) << 8)
        return out

    def _piece_differs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pieces of two seeds, each up to the next seed and with its letter, differ."""
        m, n, seeds, text = len(self.seeds), len(self.text), self.seeds, self.text
        x, y = seeds[a].astype(np.int64), seeds[b].astype(np.int64)
        length = np.where(a + 1 < m, seeds[np.minimum(a + 1, m - 1)], n - 1) - x + 1
        other = np.where(b + 1 < m, seeds[np.minimum(b + 1, m - 1)], n - 1) - y + 1
        out = np.ones(len(a), bool)
        alive, k = np.flatnonzero(length == other), 0
        while len(alive):
            done = length[alive] <= k
            out[alive[done]] = False
            alive = alive[~done]
            alive = alive[text[x[alive] + k] == text[y[alive] + k]]
            k += 1
        return out


def sort_suffixes(text: np.ndarray, cap: int, memory: int = MEMORY) -> Iterator[Run]:
    """Runs of (suffix, common prefix up to ``cap`` with the one before), from the least suffix up."""
    n = len(text)
    ats, lcps, z = scratch(n, np.int64, memory), scratch(n + 1, np.int32, memory), n
    for at, lcp in sorted_down(text, cap, memory):
        ats[z - len(at) : z] = at[::-1]
        lcps[z - len(at) + 1 : z + 1] = lcp[::-1]
        z -= len(at)
    for k in range(0, n, RUN):
        yield ats[k : k + RUN], lcps[k : min(k + RUN, n)]


def sorted_down(text: np.ndarray, cap: int, memory: int = MEMORY) -> Iterator[Run]:
    """Runs of (suffix, common prefix up to ``cap`` with the one before), from the greatest suffix down."""
    if len(text) == 1:
        yield np.zeros(1, np.int64), np.zeros(1, np.int32)
        return
    t = _Text(text, memory)
    seeds = t.sorted_seeds()
    lcp = scratch(len(seeds), _narrow(cap), memory)
    for k in range(1, len(seeds), RUN):
        z = min(k + RUN, len(seeds))
        lcp[k:z] = common_prefixes(text, seeds[k - 1 : z - 1].astype(np.int64), seeds[k:z].astype(np.int64), cap)
    yield from t.induce(seeds, lcp, cap)
