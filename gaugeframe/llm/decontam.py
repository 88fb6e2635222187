"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items become one suffix automaton over word ids (a state per class of substrings, suffix links
between them). Training words stream through it; after each word the state and the length of the
longest match that ends there are known. A length of ``window`` or more is an occurrence of an item
window; items of fewer words count as one window of their own length. Covered words are removed
when their runs exceed the length or coverage limits.

Only stretches in which every two neighbouring words are neighbours in some item can hold a match
of two words, so the stream skips from one such stretch to the next; this changes no match.

Defined cases: a null or empty text has no words and is never contaminated; null item texts and
items without words take no part; a null item id reads as the text "null"; items with equal ids
count once; repeated documents are judged alike, row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm import _bytes
from gaugeframe.llm._spark import map_text

RESULT = "n_words bigint, n_hit bigint, n_items bigint, item_ids array<string>, spans array<struct<start:bigint,end:bigint>>, contaminated boolean, clean_text string"


def item_words(text: str | None) -> list[bytes]:
    raw, offsets = _bytes.view(pa.array([text or ""]))
    raw = _bytes.lower(raw)
    data = raw.tobytes()
    starts, ends, _ = _bytes.words(raw, offsets, _bytes.ALNUM)
    return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of word ids."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _new(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, at: int, word: int, to: int) -> int:
        copy = self._new(self.length[at] + 1, dict(self.next[to]), self.link[to])
        self.link[to] = copy
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def add(self, sequence: list[int]) -> None:
        last = 0
        for word in sequence:
            have = self.next[last].get(word)
            if have is not None:  # another sequence has been here
                last = have if self.length[have] == self.length[last] + 1 else self._split(last, word, have)
                continue
            state, at = self._new(self.length[last] + 1, {}, 0), last
            while at >= 0 and word not in self.next[at]:
                self.next[at][word] = state
                at = self.link[at]
            if at >= 0:
                to = self.next[at][word]
                self.link[state] = to if self.length[to] == self.length[at] + 1 else self._split(at, word, to)
            last = state

    def stream(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest match ending at each word; unknown words are negative."""
        state = length = 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            to = self.next[state].get(word)
            state, length = (0, 0) if to is None else (to, length + 1)
            yield state, length


class ItemIndex:
    """The automaton of a set of items, and which items each window's state belongs to."""

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        self.window, self.ids = window, {}
        self.automaton = SuffixAutomaton()
        kept = [(key, [self.ids.setdefault(w, len(self.ids)) for w in words]) for key, text in items if (words := item_words(text))]
        for _, sequence in kept:
            self.automaton.add(sequence)
        self.at: dict[int, list[str]] = {}
        self.short: dict[int, tuple[int, list[str]]] = {}
        for key, sequence in kept:
            for i, (state, _) in enumerate(self.automaton.stream(sequence)):
                if len(sequence) >= window and i + 1 >= window:
                    self.at.setdefault(self._narrow(state), []).append(key)
            if len(sequence) < window:
                self.short.setdefault(state, (len(sequence), []))[1].append(key)
        self.least = min([window, *(n for n, _ in self.short.values())])
        runs = [s for _, s in kept]
        by_id = _bytes.word_hashes(*_flat(list(self.ids)))
        pairs = [_bytes.roll(by_id[np.array(s)], min(2, self.least)) for s in runs]
        self.grams = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.grams >> np.uint64(44)).astype(np.int64)] = True
        self.marked = [-1] * len(self.automaton.link)  # nearest state up the links that is a whole short item
        for state in sorted(range(1, len(self.automaton.link)), key=self.automaton.length.__getitem__):
            up = self.automaton.link[state]
            self.marked[state] = up if up in self.short else self.marked[up]

    def _narrow(self, state: int) -> int:
        a = self.automaton
        while a.length[a.link[state]] >= self.window:
            state = a.link[state]
        return state

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans covered by windows, and the items whose windows occur."""
        spans, found = [], set()
        for i, (state, length) in enumerate(self.automaton.stream([self.ids.get(w, -1) for w in words])):
            if length >= self.window:
                found.update(self.at.get(self._narrow(state), ()))
                spans.append((i + 1 - self.window, i + 1))
            if self.short:
                at = state if state in self.short and self.short[state][0] <= length else self.marked[state]
                while at > 0:
                    n, keys = self.short[at]
                    found.update(keys)
                    spans.append((i + 1 - n, i + 1))
                    at = self.marked[at]
        return spans, found


def _flat(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(words) else ends, ends


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class _Kernel:
    def __init__(self, indexes, numerator: int, denominator: int, least_words: int, texts: bool) -> None:
        self.indexes, self.numerator, self.denominator, self.least_words, self.texts = indexes, numerator, denominator, least_words, texts

    def __call__(self, column: pa.Array) -> list:
        original, offsets = _bytes.view(column)
        raw = _bytes.lower(original)
        starts, ends, before = _bytes.words(raw, offsets, _bytes.ALNUM)
        hashes = _bytes.word_hashes(raw, starts, ends)
        hit = np.zeros(len(starts), bool)
        found: dict[int, set[str]] = {}
        data = raw.tobytes()
        for broadcast in self.indexes:
            index = broadcast.value
            if not len(index.grams):
                continue
            k = min(2, index.least)
            grams = _bytes.roll(hashes, k)
            near = index.seen[(grams >> np.uint64(44)).astype(np.int64)]
            places = np.flatnonzero(near)
            near[places] = np.isin(grams[places], index.grams)
            if k == 2:
                cut = before[1:-1]
                near[cut[(cut > 0) & (cut <= len(near))] - 1] = False  # never from one text into the next
            for a, b in zip(*_runs(near), strict=True):
                if k == 1:  # a run of single words may cross texts: take it text by text
                    cuts = before[np.searchsorted(before, a, "right") : np.searchsorted(before, b, "left")]
                    pieces = np.unique(np.concatenate([[a], cuts, [b]]))
                else:
                    pieces = np.array([a, b + 1])
                for p, q in zip(pieces[:-1], pieces[1:], strict=True):
                    if q - p >= index.least:
                        spans, keys = index.match([data[starts[i] : ends[i]] for i in range(p, q)])
                        if spans:
                            found.setdefault(int(np.searchsorted(before, p, "right")) - 1, set()).update(keys)
                            for x, y in spans:
                                hit[p + x : p + y] = True
        n = len(column)
        n_words = np.diff(before)
        sums = np.concatenate([[0], np.cumsum(hit)])
        n_hit = sums[before[1:]] - sums[before[:-1]]
        bad = (n_hit >= max(1, self.least_words)) & (self.denominator * n_hit >= self.numerator * n_words)
        first, last = _runs(hit)
        spans, texts = [[] for _ in range(n)], column if self.texts else pa.nulls(n, pa.string())
        if len(first):
            at = np.searchsorted(before, first, "right") - 1
            changed = {}
            source = original.tobytes()
            for row, a, b in zip(at.tolist(), first.tolist(), last.tolist(), strict=True):
                while a < b:  # runs of neighbouring texts touch
                    while before[row + 1] <= a:
                        row += 1
                    stop = min(b, int(before[row + 1]))
                    spans[row].append({"start": int(starts[a] - offsets[row]), "end": int(ends[stop - 1] - offsets[row])})
                    a = stop
            if self.texts:
                for row in {r for r in range(n) if spans[r] and bad[r]}:
                    at, out = int(offsets[row]), []
                    for s in spans[row]:
                        out.append(source[at : offsets[row] + s["start"]])
                        at = int(offsets[row]) + s["end"]
                    changed[row] = b"".join([*out, source[at : offsets[row + 1]]]).decode()
                texts = pa.array([changed.get(i, x) for i, x in enumerate(column.to_pylist())], pa.string())
        items = [sorted(found.get(i, ())) for i in range(n)]
        return [n_words, n_hit, [len(x) for x in items], items, spans, bad, texts]


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, least_words: int = 1, share: tuple[int, int] = (1, 20), texts: bool = True, keep: list[str] | None = None, chunk_bytes: int = 2 << 20) -> DataFrame:
    """Each document with what the items' windows cover.

    Adds n_words, n_hit, n_items, item_ids (sorted), spans (byte offsets of covered runs in the
    original text), contaminated (n_hit >= least_words and n_hit / n_words >= share), and clean_text
    (the text without its covered runs if contaminated, else as it was; null unless ``texts``).
    Items stream to the driver and become automata of at most ``chunk_bytes`` of item text each (some
    hundred bytes of memory per byte while one is built); each goes to the executors as one broadcast
    of that bounded size, and every document passes all.
    """
    context = docs.sparkSession.sparkContext
    indexes, chunk, size = [], [], 0
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("k"), F.col(item_text).cast("string").alias("t")).filter("t is not null")
    for row in rows.toLocalIterator():
        chunk.append((row.k, row.t))
        size += len(row.t.encode())
        if size >= chunk_bytes:
            indexes.append(context.broadcast(ItemIndex(chunk, window)))
            chunk, size = [], 0
    if chunk:
        indexes.append(context.broadcast(ItemIndex(chunk, window)))
    return map_text(docs, text, docs.columns if keep is None else keep, RESULT, _Kernel(indexes, *share, least_words, texts))


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    from gaugeframe.llm._spark import table

    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), texts=False, keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def brute_force(texts: list[str | None], items: list[tuple[str, str | None]], window: int = 13) -> list[tuple[int, int, int, str]]:
    """(n_words, n_hit, n_items, items_sha256) by comparing all windows; for tests."""
    out, windows = [], {}
    for key, text in items:
        words = item_words(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add(key)
    for text in texts:
        words, hit, keys = item_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if (k := windows.get(tuple(words[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    keys |= k
        out.append((len(words), len(hit), len(keys), hashlib.sha256(",".join(sorted(keys)).encode()).hexdigest()))
    return out
