"""Language-model scoring with a weighted backoff automaton.

Training counts all n-grams up to ``order`` over every training text. Each n-gram that was seen and
is shorter than ``order`` is a state; the arc that a word takes from a state carries the smoothed
log-probability of the n-gram they form, if that was seen, and leads to the state of its longest
suffix; a failure arc leads to the state of the history without its first word and carries the
weight that is left for the rest. A text is read once from left to right: the state (the longest
history that was seen) is carried, log10 weights are summed.

Smoothing: for words (order 1) absolute discounting, whose mass goes to one unknown-word symbol;
above, p(w | h) = (c(hw) + K p(w | h')) / (c(h) + K) with h' one word shorter, so an arc weighs
p(w | h) and a failure arc K / (c(h) + K); K is ``strength``, one value for each order from 2 on.

No automaton holds the corpus: every block of documents (dealt by a hash of their content, of bounded
size) builds the part of it that its texts can reach. For that it sends the hashes of its distinct
n-grams (sorted, as differences, a few bytes each) with their training counts to hash ranges; each
range sums them and answers every block with the totals in the order asked. Words and pairs go
first. A longer n-gram can only be seen elsewhere if both n-grams it is made of are; only those are
asked for, order by order, and the totals of all others are the block's own counts. Ranges and
blocks grow in number with the input, not in size; an empty message is not sent, so messages never
outnumber the blocks' distinct n-grams.

Defined cases: null and empty texts are the end token alone; a null id belongs to the training side
unless the fold says otherwise; repeated rows are counted and scored each; with no training text N
and V are 0 and every token has probability 1; columns of the input never clash with results, as
only ``key`` is kept.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm import _bytes
from gaugeframe.llm._spark import fold, stored, table, text_digest

U64 = np.uint64
END = U64(0x5E2D58D8B3BCDEF1)


class BackoffAutomaton:
    """The definition, for token sequences and counts at hand (n-gram tuples to counts); for tests."""

    def __init__(self, counts: dict[tuple, int], total: int, discount: float, strength: tuple[float, ...] | float) -> None:
        self.counts, self.total = counts, total
        self.order = max((len(k) for k in counts), default=1)
        self.strengths = strength if isinstance(strength, tuple) else (strength,) * self.order
        self.discount, self.types = discount, sum(len(k) == 1 for k in counts)

    def _p(self, gram: tuple) -> float:
        """Smoothed probability of the last word after the others."""
        if len(gram) == 1:
            if not self.total:
                return 1.0
            c = self.counts.get(gram, 0)
            return (c - self.discount) / self.total if c else max(self.discount * self.types, 0.5) / self.total
        lower, h, k = self._p(gram[1:]), self.counts.get(gram[:-1], 0), self.strengths[len(gram) - 2]
        return (self.counts.get(gram, 0) + k * lower) / (h + k) if h else lower

    def score(self, tokens: list) -> float:
        state, out = (), 0.0
        for word in tokens:
            while state and state + (word,) not in self.counts:  # failure arcs
                h, k = self.counts.get(state, 0), self.strengths[len(state) - 1]
                out += math.log10(k / (h + k)) if h else 0.0
                state = state[1:]
            out += math.log10(self._p(state + (word,)))
            state = (state + (word,))[-(self.order - 1) :] if self.order > 1 else ()
            while state and state not in self.counts:
                state = state[1:]
        return out


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token, tokens before each text): words, then one end per text."""
    raw, offsets = _bytes.view(column)
    raw = _bytes.lower(raw)
    starts, ends, before = _bytes.words(raw, offsets, _bytes.NOT_SPACE)
    n = len(offsets) - 1
    at = before + np.arange(n + 1)  # each earlier text adds its end
    out = np.empty(len(starts) + n, U64)
    stops = at[1:] - 1
    rest = np.ones(len(out), bool)
    rest[stops] = False
    out[stops] = END
    out[rest] = _bytes.word_hashes(raw, starts, ends)
    return out, at


def grams(toks: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the n-gram that ends at each token, whether it lies inside its text)."""
    h = np.zeros(len(toks), U64)
    h[order - 1 :] = _bytes.roll(toks, order)
    whole = np.arange(len(toks)) - np.repeat(at[:-1], np.diff(at)) >= order - 1
    return h >> U64(8), whole


def pack(values: np.ndarray) -> bytes:
    """Sorted 56-bit values as differences of the fewest bytes that hold them all."""
    gaps = np.diff(values, prepend=U64(0))
    width = max(1, -(-int(gaps.max()).bit_length() // 8)) if len(gaps) else 1
    return bytes([width]) + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    width = blob[0]
    body = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
    wide = np.zeros((len(body), 8), np.uint8)
    wide[:, :width] = body
    return np.cumsum(wide.view("<u8").ravel(), dtype=U64)


def pack_counts(values: np.ndarray) -> bytes:
    width = next(w for w in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << (8 * w))
    return bytes([width]) + zlib.compress(values.astype(f"<u{width}").tobytes(), 1)


def unpack_counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob[1:]), f"<u{blob[0]}").astype(np.int64)


class Block:
    """A block's tokens and, for every order, its distinct n-grams: hashes in order (values), the
    number of the one that ends at each token or -1 (number), a place where each ends (place), its
    training count in the block (own) and, once known, in all training texts (total)."""

    def __init__(self, rows: pa.Table, order: int) -> None:
        rows = rows.sort_by([("_key", "ascending"), ("_digest", "ascending")])
        self.keys = rows.column("_key")
        self.toks, self.at = tokens(rows.column("_t"))
        training = np.repeat(np.array(rows.column("_train")), np.diff(self.at))
        self.values, self.number, self.place, self.own, self.total = [], [], [], [], []
        for n in range(1, order + 1):
            h, whole = grams(self.toks, self.at, n)
            inside = np.flatnonzero(whole)
            values, inverse = np.unique(h[inside], return_inverse=True)
            number = np.full(len(h), -1, np.int32)
            number[inside] = inverse
            place = np.zeros(len(values), np.int64)
            place[inverse] = inside  # any of its places serves
            self.values.append(values)
            self.number.append(number)
            self.place.append(place)
            self.own.append(np.bincount(number[inside][training[inside]], minlength=len(values)))

    def asked(self, n: int) -> np.ndarray:
        """Which n-grams other blocks may have too: all up to pairs, above those whose two parts do."""
        if n <= 2:
            return np.ones(len(self.values[n - 1]), bool)
        more = self.total[n - 2] > self.own[n - 2]
        end, number = self.place[n - 1], self.number[n - 2]
        return more[number[end]] & more[number[end - 1]]

    def answer(self, answers: pa.Table, upto: int) -> None:
        """Totals of the orders up to ``upto``, from answers (whose ranges follow one another)."""
        ns, ranges = np.array(answers.column("n")), np.array(answers.column("range"))
        for n in range(1, upto + 1):
            asked, own = self.asked(n), np.flatnonzero(ns == n)
            got = [unpack_counts(answers.column("totals")[int(i)].as_py()) for i in own[np.argsort(ranges[own])]]
            total = self.own[n - 1].copy()
            total[asked] = np.concatenate([*got, np.zeros(0, np.int64)])
            self.total.append(total)

    def messages(self, orders: range, block: int, ranges: int) -> pa.Table:
        rows: dict[str, list] = {"range": [], "block": [], "n": [], "grams": [], "counts": []}
        edges = np.array([(i << 56) // ranges for i in range(1, ranges)], U64)
        for n in orders:
            asked = self.asked(n)
            values, counts = self.values[n - 1][asked], self.own[n - 1][asked]
            cuts = np.concatenate([[0], np.searchsorted(values, edges), [len(values)]])
            for r in np.flatnonzero(np.diff(cuts)):
                a, b = cuts[r], cuts[r + 1]
                for k, v in zip(rows, (int(r), block, n, pack(values[a:b]), pack_counts(counts[a:b])), strict=True):
                    rows[k].append(v)
        return pa.table(rows, ASKED)


ASKED = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("n", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])


def _asking(orders: range, ranges: int):
    """The messages of a block about n-grams of these orders, without and with answers about those
    before."""

    def first(rows: pa.Table) -> pa.Table:
        return Block(rows, orders[-1]).messages(orders, rows.column("_block")[0].as_py(), ranges)

    def later(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return ASKED.empty_table()
        block = Block(rows, orders[-1])
        block.answer(answers, orders[0] - 1)
        return block.messages(orders, rows.column("_block")[0].as_py(), ranges)

    return first, later


class Automaton:
    """The part of the backoff automaton that a block's texts can reach, as arrays.

    State 0 is the empty history; a seen n-gram is state ``base[n] + number`` with a failure arc
    (``fail``, ``left``), and the arc that completes it (``weight``, ``target``), numbered likewise.
    """

    def __init__(self, block: Block, facts: dict, strength: tuple[float, ...]) -> None:
        order, n, v = len(block.values), facts["tokens"], facts["types"]
        discount = facts["ones"] / (facts["ones"] + 2.0 * facts["twos"]) if facts["ones"] and facts["twos"] else 0.5
        unseen = max(discount * v, 0.5) / n if n else 1.0
        self.unknown = float(np.log10(unseen))
        self.base = np.cumsum([1, *[len(x) for x in block.values]])
        size = int(self.base[-1])
        self.seen = np.zeros(size, bool)
        self.fail, self.target = np.zeros(size, np.int32), np.zeros(size, np.int32)
        self.left, self.weight = np.zeros(size), np.zeros(size)
        lower = None
        for k in range(1, order + 1):
            here = slice(self.base[k - 1], self.base[k])
            total, end = block.total[k - 1], block.place[k - 1]
            seen = self.seen[here] = total > 0
            if k == 1:
                p = np.where(seen, (total - discount) / n, unseen) if n else np.ones(len(total))
            else:
                shorter, number, h = strength[k - 2], block.number[k - 2], block.total[k - 2]
                history = h[number[end - 1]]
                below = lower[number[end]]
                p = np.where(history > 0, (total + shorter * below) / (history + shorter), below)
                self.fail[here] = self.base[k - 2] + number[end]
            if k < order:
                self.left[here] = np.log10(strength[k - 1] / (total + strength[k - 1]))
            self.weight[here] = np.log10(p)
            self.target[here] = np.arange(self.base[k - 1], self.base[k]) if k < order else self.fail[here]
            lower = p
        self.order = order

    def traverse(self, block: Block, stretch: int = 256) -> np.ndarray:
        """log10 weight of every token. All texts advance together, a token a step; a long text goes
        in stretches, each entered ``order - 1`` tokens early, after which the state is the same."""
        # the arc of each order that could be taken at a token, or -1
        arcs = np.stack([np.where(x >= 0, x + b, -1) for x, b in zip(block.number, self.base, strict=False)])
        arcs[(arcs >= 0) & ~self.seen[arcs]] = -1
        sizes = np.diff(block.at)
        pieces = -(-sizes // stretch)
        begin = np.repeat(block.at[:-1], pieces) + stretch * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        end = np.minimum(begin + stretch, np.repeat(block.at[1:], pieces))
        enter = np.maximum(begin - (self.order - 1), np.repeat(block.at[:-1], pieces))
        out = np.zeros(len(block.toks))
        state, length = np.zeros(len(begin), np.int32), np.zeros(len(begin), np.int8)
        for step in range(int((end - enter).max(initial=0))):
            live = np.flatnonzero(enter + step < end)
            place = enter[live] + step
            total = np.zeros(len(live))
            open_ = np.arange(len(live))
            while len(open_):
                own = live[open_]
                arc = arcs[length[own], place[open_]]
                taken = arc >= 0
                hit, at = own[taken], arc[taken]
                total[open_[taken]] += self.weight[at]
                state[hit] = self.target[at]
                length[hit] = np.minimum(length[hit] + 1, self.order - 1)
                open_, own = open_[~taken], own[~taken]
                root = length[own] == 0
                total[open_[root]] += self.unknown  # the empty history takes any word
                open_, own = open_[~root], own[~root]
                total[open_] += self.left[state[own]]  # failure arcs
                state[own] = self.fail[state[own]]
                length[own] -= 1
            mine = place >= begin[live]
            out[place[mine]] = total[mine]
        return out


def _answered(part: pa.Table) -> pa.Table:
    """Per range: total counts, returned to every block in the order asked, and what they hold."""
    schema = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("n", pa.int32()), ("totals", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64()), ("ones", pa.int64()), ("twos", pa.int64())])
    rows = {name: [] for name in schema.names}
    orders = np.array(part.column("n"))
    for n in np.unique(orders).tolist():
        own = part.filter(pa.array(orders == n))
        lists = [unpack(x.as_py()) for x in own.column("grams")]
        values, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([unpack_counts(x.as_py()) for x in own.column("counts")]), len(values)).astype(np.int64)
        facts = [int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum())]
        at = 0
        for i, own_list in enumerate(lists):
            got = total[inverse[at : at + len(own_list)]]
            at += len(own_list)
            for k, v in zip(schema.names, (own.column("range")[i].as_py(), own.column("block")[i].as_py(), n, pack_counts(got), *(facts if i == 0 else [0] * 4)), strict=True):
                rows[k].append(v)
    return pa.table(rows, schema)


STRENGTH = (200.0, 5.0)
RESULT = "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score(docs: DataFrame, training, *, key: str = "doc_id", text: str = "text", order: int = 3, strength: tuple[float, ...] | float = STRENGTH, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: key, n_tokens, n_known, train_tokens, base_score and score.

    ``training`` is a boolean column of ``docs``: the rows the model learns from. ``strength`` has a
    value for each order from 2 on (the last one serves further orders).
    """
    given = strength if isinstance(strength, tuple) else (strength,)
    strength = tuple(given[min(i, len(given) - 1)] for i in range(max(1, order)))
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("_t"), F.coalesce(training, F.lit(False)).alias("_train")).withColumn("_digest", text_digest(F.col("_t")))
    size = rows.select(F.sum(F.coalesce(F.octet_length("_t"), F.lit(0)) + 64).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    ranges = -(-blocks // 2)
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64("_key", "_digest"), F.lit(blocks))).groupBy("_block")
    kind = docs.schema[key].dataType.simpleString()
    answers = None
    for n in range(min(2, order), order + 1):
        orders = range(1, n + 1) if n <= 2 else range(n, n + 1)

        message = "range bigint, block bigint, n int, grams binary, counts binary"
        first, later = _asking(orders, ranges)
        asked = dealt.applyInArrow(first, message) if answers is None else dealt.cogroup(answers.groupBy("_block")).applyInArrow(later, message)
        found = stored(asked.groupBy("range").applyInArrow(_answered, "range bigint, block bigint, n int, totals binary, tokens bigint, types bigint, ones bigint, twos bigint"), "lm-answers")
        if answers is None:
            facts = found.filter("n = 1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "ones", "twos")]).first().asDict()
        found = found.select(F.col("block").alias("_block"), "range", "n", "totals")
        answers = found if answers is None else answers.unionByName(found)

    def run(rows: pa.Table, answer: pa.Table) -> pa.Table:
        schema = pa.schema([("k", rows.schema.field("_key").type), *[(x, pa.int64()) for x in ("n_tokens", "n_known", "train_tokens")], ("base_score", pa.float64()), ("score", pa.float64())])
        if not rows.num_rows:
            return schema.empty_table()
        block = Block(rows, order)
        block.answer(answer, order)
        counts = block.total[0][block.number[0]]
        base = np.log10((counts + 1.0) / (facts["tokens"] + (facts["types"] + 1.0)))
        weights = Automaton(block, facts, strength).traverse(block)
        add = lambda x: np.add.reduceat(x, block.at[:-1])  # noqa: E731  every text has an end token
        return pa.Table.from_arrays([block.keys, *[pa.array(x) for x in (np.diff(block.at), add((counts > 0).astype(np.int64)), np.full(len(block.at) - 1, facts["tokens"], np.int64), add(base), add(weights))]], schema=schema)

    out = dealt.cogroup(answers.groupBy("_block")).applyInArrow(run, f"k {kind}, {RESULT}")
    return out.withColumnRenamed("k", key)


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold(F.col("doc_id"), 7) == 2
    return score(docs, ~held).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
