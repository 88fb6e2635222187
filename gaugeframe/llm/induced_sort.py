"""External induced sorting of suffixes with common-prefix values (numpy, disk-backed queues).

The sequence's suffixes are S- or L-type; the leftmost S-type ones (LMS) are sorted by a recursion on
the names of the substrings between them. From these seeds two scans induce all others: ascending
for L-type, descending for S-type. What a scan induces waits in a queue with one bucket per first
symbol; what exceeds the memory limit goes to a file and comes back when its turn is reached, and
what a scan has settled waits in the same way for the next one. Tuples of (position, common prefix
with the tuple before) travel through the queue: the common prefix of two neighbours in a bucket is
1 plus the least value between their sources. A bucket is scanned in rounds, as a suffix can induce
one in its own bucket. In memory stay the text with a few numbers per symbol (in mapped files where
they exceed the limit), one bucket, and the names of a recursion's last level.

Common-prefix values are exact below ``cap``; beyond it, order and value are left open.
"""

from __future__ import annotations

import tempfile

import numpy as np

from gaugeframe.llm import _bytes


def scratch(n: int, kind, memory: int) -> np.ndarray:
    """An array of zeros; mapped to the task's own unnamed file if it exceeds the memory limit."""
    if n * np.dtype(kind).itemsize <= memory:
        return np.zeros(n, kind)
    with tempfile.TemporaryFile(prefix="gaugeframe-array-") as file:  # the map outlives the handle
        return np.memmap(file, kind, "w+", shape=(n,))


class BucketQueue:
    """First in, first out by symbol; a priority queue whose least symbol is asked for in turn."""

    def __init__(self, memory: int) -> None:
        self.memory, self.held, self.parts, self.file = memory, 0, {}, None

    def push(self, symbol: int, positions: np.ndarray, common: np.ndarray) -> None:
        self.parts.setdefault(symbol, []).append((positions, common))
        self.held += positions.nbytes + common.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:  # the task's own scratch; it has no name and ends with the task
            self.file = tempfile.TemporaryFile(prefix="gaugeframe-queue-")
        for symbol, parts in self.parts.items():
            for i, part in enumerate(parts):
                if not isinstance(part[0], int):
                    self.file.seek(0, 2)
                    at = self.file.tell()
                    self.file.write(part[0].astype(np.int64).tobytes())
                    self.file.write(part[1].astype(np.int64).tobytes())
                    parts[i] = (at, len(part[0]))
        self.held = 0

    def pop(self, symbol: int) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for a, b in self.parts.pop(symbol, ()):
            if isinstance(a, int):
                self.file.seek(a)
                both = np.frombuffer(self.file.read(16 * b), np.int64)
                out.append((both[:b], both[b:]))
            else:
                self.held -= a.nbytes + b.nbytes
                out.append((a, b))
        return out

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All entries of a symbol in one piece."""
        parts = self.pop(symbol)
        return (np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])) if parts else None

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _between(common: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of common[lo+1 .. hi] for each pair lo < hi."""
    span = hi - lo
    if not len(span):
        return span
    level = np.frexp(span.astype(np.float64))[1] - 1
    out = np.empty(len(lo), np.int64)
    table = common
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[lo[at] + 1], table[hi[at] - (1 << k) + 1])
        if len(table) > 1 << k:
            table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
    return out


def types(t: np.ndarray) -> np.ndarray:
    """True for S-type positions; the last one is S."""
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int64), append=-1))
    step[-1] = 1
    where = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(where[::-1])[::-1]
    return step[nearest] > 0


def _scan(t, is_s, runs, seeds, other, ascending: bool, memory: int, cap: int, symbols: np.ndarray, keep: BucketQueue | None = None):
    """One scan. seeds(symbol): entries (positions, common) known beforehand, in scan order; other:
    True to induce S-type suffixes. Gives a queue of the induced entries by symbol, in scan order;
    ``keep`` gets the seeds once they are used."""
    queue, out = BucketQueue(memory // 2), BucketQueue(memory // 2)
    for c in (symbols if ascending else symbols[::-1]).tolist():
        got = queue.pop(c)
        rounds, depth = [], 1
        fresh = got
        while fresh:
            p = np.concatenate([x for x, _ in fresh])
            h = np.concatenate([x for _, x in fresh])
            h[0] = 0 if not rounds else depth - 1
            rounds.append((p, h))
            own = np.flatnonzero((p > 0) & (t[p - 1] == c) & (is_s[p - 1] == other))
            if not len(own):
                break
            depth += 1
            common = np.empty(len(own), np.int64)
            common[0] = 0
            common[1:] = np.minimum(cap, 1 + _between(h, own[:-1], own[1:]))
            fresh = [(p[own] - 1, common)]
        made = (np.concatenate([x for x, _ in rounds]), np.concatenate([x for _, x in rounds])) if rounds else None
        if made is not None:
            out.push(c, *made)
        seed = seeds(c)
        if keep is not None and seed is not None:
            keep.push(c, *seed)
        parts = [x for x in (made, seed) if x is not None]
        if not parts:
            continue
        p = np.concatenate([x for x, _ in parts])
        h = np.concatenate([x for _, x in parts])
        if len(parts) == 2:
            at = len(parts[0][0])
            h[at] = min(runs[p[at - 1]], runs[p[at]], cap)
        source = np.flatnonzero((p > 0) & (is_s[p - 1] == other))
        before = t[p[source] - 1]
        away = before != c
        source, before = source[away], before[away]
        order = np.argsort(before, kind="stable")
        source, before = source[order], before[order]
        if not len(source):
            continue
        common = np.ones(len(source), np.int64)
        same = np.flatnonzero(before[1:] == before[:-1]) + 1
        common[same] = np.minimum(cap, 1 + _between(h, source[same - 1], source[same]))
        cuts = np.flatnonzero(np.diff(before, prepend=before[0] - 1))
        for a, b in zip(cuts, [*cuts[1:], len(source)], strict=True):
            queue.push(int(before[a]), p[source[a:b]] - 1, common[a:b])
    queue.close()
    return out


def _by_symbol(t: np.ndarray, positions: np.ndarray, common: np.ndarray) -> dict:
    """Entries (already in order) cut by their first symbol."""
    if not len(positions):
        return {}
    first = t[positions]
    cuts = np.flatnonzero(np.diff(first, prepend=first[0] - 1))
    return {int(first[a]): (positions[a:b], common[a:b]) for a, b in zip(cuts, [*cuts[1:], len(first)], strict=True)}


def _turned(part):
    """Entries in reverse; the values stand between neighbours, so each moves to the other one."""
    return None if part is None else (part[0][::-1], np.concatenate([[0], part[1][:0:-1]]))


def _induce(t, is_s, runs, lms, common, memory: int, cap: int):
    """All suffixes from LMS ones in order, symbol by symbol: (positions, common prefix with the one
    before, 0 for a symbol's first)."""
    known = _by_symbol(t, lms, common)
    symbols = np.unique(t)
    low = _scan(t, is_s, runs, known.get, False, True, memory, cap, symbols)
    kept = BucketQueue(memory // 2)
    high = _scan(t, is_s, runs, lambda c: _turned(low.take(c)), True, False, memory, cap, symbols, kept)
    yield np.array([len(t) - 1]), np.zeros(1, np.int64)  # nothing induces the end symbol's suffix
    for c in symbols[1:].tolist():
        parts = [x for x in (_turned(kept.take(c)), _turned(high.take(c))) if x is not None]
        if not parts:
            continue
        p = np.concatenate([x for x, _ in parts])
        h = np.concatenate([x for _, x in parts])
        h[0] = 0
        if len(parts) == 2:
            at = len(parts[0][0])
            h[at] = min(runs[p[at - 1]], runs[p[at]], cap)
        yield p, h
    for queue in (low, kept, high):
        queue.close()


def _doubled(r: np.ndarray, enough: int) -> np.ndarray:
    """Order of the suffixes of names by rank doubling, up to ``enough`` names (fits in memory)."""
    n = len(r)
    rank = np.unique(r, return_inverse=True)[1].astype(np.int64)
    k = 1
    while k < enough and int(rank.max()) < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1 if k < n else 0
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        k *= 2
    return np.argsort(rank, kind="stable")


def suffix_blocks(t: np.ndarray, cap: int = 400, memory: int = 64 << 20, internal: int | None = None):
    """(positions, common prefix of each with the one before, up to cap) of all suffixes in order,
    one block per first symbol; a block's first entry has 0.

    t: symbols from 1 on; an end symbol 0 is added and its suffix left out. Names of up to
    ``internal`` LMS substrings (by default those that fit the memory limit) are ranked in memory,
    more by recursion.
    """
    n = len(t) + 1
    whole = scratch(n, np.int32, memory)
    whole[:-1] = t
    t = whole
    if n <= 2:
        if n == 2:
            yield np.zeros(1, np.int64), np.zeros(1, np.int64)
        return
    internal = max(1, memory // 64) * 8 if internal is None else internal
    is_s = types(t)
    first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    runs = scratch(n, np.int32, memory)
    runs[:] = np.repeat(np.concatenate([first[1:], [n]]).astype(np.int32), np.diff(np.concatenate([first, [n]])))
    runs -= np.arange(n, dtype=np.int32)
    del first
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    sums = scratch(n + 1, np.uint64, memory)
    up, _ = _bytes.powers(n)
    np.cumsum((t.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    if len(lms) > 1:
        # LMS substrings in order: one induction from LMS positions sorted by first symbol only
        by_first = lms[np.argsort(t[lms], kind="stable")]
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        p = np.concatenate([x[is_lms[x]] for x, _ in _induce(t, is_s, runs, by_first, np.zeros(len(lms), np.int64), memory, 1)])
        stop = np.concatenate([lms[1:] + 1, [n]])
        place = np.searchsorted(lms, p)
        own = _bytes.span_hash(sums, lms, stop)[place]
        names = np.zeros(len(lms), np.int64)
        names[place] = np.cumsum(np.concatenate([[1], (own[1:] != own[:-1]).astype(np.int64)]))
        if int(names.max()) == len(lms):
            order = np.argsort(names)
        elif len(lms) <= internal:
            order = _doubled(names, cap)
        else:
            order = np.concatenate([x for x, _ in suffix_blocks(names, cap, memory, internal)])
        lms = lms[order]
        del names, own, place, p, is_lms, by_first
    common = np.zeros(len(lms), np.int64)
    if len(lms) > 1:  # seeds' common prefixes, by bisection over span digests
        a, b = lms[:-1], lms[1:]
        lo, hi = np.zeros(len(a), np.int64), np.minimum(cap, n - np.maximum(a, b))
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = _bytes.span_hash(sums, a, a + mid) == _bytes.span_hash(sums, b, b + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        common[1:] = lo
    del sums
    for p, h in _induce(t, is_s, runs, lms, common, memory, cap):
        if p[0] < n - 1:
            yield p, h


def suffix_order(t: np.ndarray, cap: int = 400, memory: int = 64 << 20, internal: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """(positions of all suffixes in order, common prefix of each with the one before, up to cap)."""
    blocks = [*suffix_blocks(np.asarray(t), cap, memory, internal), (np.zeros(0, np.int64), np.zeros(0, np.int64))]
    return np.concatenate([p for p, _ in blocks]), np.concatenate([h for _, h in blocks])
