"""Suffix-array dedup: removal of bytes covered by strings that occur elsewhere too.

A string of ``length`` bytes belongs to the least of its ``gram``-byte pieces (by hash, leftmost);
equal strings belong to equal pieces at equal offsets. So each text falls into windows: runs of
string starts with one owner. Windows whose owner stands nowhere else hold no repeat, windows equal
as a whole repeat as a whole; both are settled by counting digests. The windows left over go, with
their bytes, to shards by owner. A shard first cuts them into small cells of starts at fixed offsets
from the owner; cells whose common bytes no other has, or whose bytes stand in another as a whole,
are settled by digests. In the cells left the common bytes become one name, and the suffixes of these
short sequences are sorted with common-prefix values by external induced sorting, whose queues of
(suffix, common prefix) hold ``sort_memory`` bytes and keep the rest on disk; a start repeats if a
neighbour shares its whole string with it.

An owner of more than ``hot`` different windows (a passage in very many contexts) would fill a shard
of its own. Its windows are bisected instead, exactly: cells of starts at fixed offsets from the
owner are settled when the bytes around all of the cell's strings repeat, or the bytes common to
them do not, and are split otherwise, down to single starts (of cells that repeat as a whole one
goes on, as a witness for the others). Only digests are grouped.

Defined cases: null and empty texts have no bytes and lose none; texts shorter than ``length`` lose
none; rows repeated exactly are separate occurrences of each other; what is judged is the input,
so overlapping repeats are all removed; kept bytes may split a character and are binary.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm import _bytes
from gaugeframe.llm._spark import discard, lookup, stored, table, text_digest
from gaugeframe.llm.induced_sort import suffix_blocks

U64 = np.uint64
LOW = U64((1 << 24) - 1)
PIECE = 1 << 20


def windows(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """doc, m (owner), a, b (first and last start; all relative to the text), mh and wh (digests)."""
    parts = []
    for low in range(0, max(1, len(raw) - length + 1), PIECE):
        piece = raw[low : low + PIECE + length - 1]
        n = len(piece) - length + 1
        if n <= 0:
            continue
        sums = _bytes.prefix(piece)
        _, down = _bytes.powers(len(piece) + 1)
        k = len(piece) - gram + 1
        digest = _bytes.mix((sums[gram : gram + k] - sums[:k]) * down[:k])
        key = (digest & ~LOW) | np.arange(k, dtype=U64)
        w = length - gram + 1
        pad = -(-(n + w) // w) * w
        rows = np.full(pad, ~U64(0))
        rows[:k] = key[:pad]
        rows = rows.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, 1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        owner = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & LOW).astype(np.int64)
        valid = np.ones(n, bool)
        inner = offsets[(offsets > low) & (offsets < low + len(piece))] - low
        for stop in inner.tolist():  # strings that would cross into the next text
            valid[max(0, stop - length + 1) : min(stop, n)] = False
        at = np.flatnonzero(valid)
        if not len(at):
            continue
        own = owner[at]
        new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])])
        first = np.flatnonzero(new)
        a, b, m = at[first], at[np.concatenate([first[1:], [len(at)]]) - 1], own[first]
        doc = np.searchsorted(offsets, a + low, "right") - 1
        base = offsets[doc] - low
        parts.append({"doc": doc, "m": m - base, "a": a - base, "b": b - base, "mh": digest[m], "wh": _bytes.span_hash(sums, a, b + length)})
    names = ("doc", "m", "a", "b", "mh", "wh")
    return {x: np.concatenate([p[x] for p in parts]) if parts else np.zeros(0, U64 if x in ("mh", "wh") else np.int64) for x in names}


#: Bytes of a word's code.
CODE = 3


def _word_codes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as codes of 24 hashed bits, one for each run of bytes other than white space."""
    starts, ends, before = _bytes.words(raw, offsets, _bytes.NOT_SPACE)
    return (_bytes.word_hashes(raw, starts, ends) & LOW).astype(np.uint32), before


def _units(column, coded: bool) -> tuple[np.ndarray, np.ndarray]:
    """(units, offsets) of windows' bytes: bytes, or words' codes."""
    raw, offsets = _bytes.view(column)
    return (np.frombuffer(raw.tobytes(), np.uint32), offsets // 4) if coded else (raw, offsets)


def _window_rows(length: int, gram: int, kind: str, coded: bool):
    def run(batches):
        _bytes.tidy()
        for batch in batches:
            for part in _bytes.slices(batch, "_text", PIECE):
                raw, offsets = _bytes.view(part.column(2))
                if coded:
                    raw, offsets = _word_codes(raw, offsets)
                w = windows(raw, offsets, length, gram)
                rows = pa.array(w["doc"])
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(w["mh"].view(np.int64)), pa.array(w["wh"].view(np.int64)), *[pa.array(w[x]) for x in "mab"]], names=["_key", "_digest", "mh", "wh", "m", "a", "b"])

    return run, f"_key {kind}, _digest bigint, mh bigint, wh bigint, m bigint, a bigint, b bigint"


def _cut_rows(length: int, coded: bool):
    """The units of each listed window of a text."""
    named = ("mh", "m", "a", "b", "c", "d")

    def run(batches):
        _bytes.tidy()
        for batch in batches:
            for part in _bytes.slices(batch, "_text", PIECE):
                raw, offsets = _bytes.view(part.column(part.schema.get_field_index("_text")))
                if coded:
                    raw, offsets = _word_codes(raw, offsets)
                data, wide = raw.tobytes(), raw.itemsize
                listed = part.column(part.schema.get_field_index("w"))
                rows = np.repeat(np.arange(len(listed)), listed.value_lengths().to_numpy(zero_copy_only=False))
                flat = listed.flatten()
                made = {k: flat.field(k).to_numpy(zero_copy_only=False) for k in named}
                starts, ends = (offsets[rows] + made["a"]) * wide, (offsets[rows] + made["b"] + length) * wide
                cut = pa.array([data[x:y] for x, y in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *[pa.array(made[k]) for k in named], cut], names=["_key", "_digest", *named, "bytes"])

    return run


def _ragged(starts: np.ndarray, sizes: np.ndarray, step: int = 1) -> np.ndarray:
    """starts[0], starts[0] + step, ... (sizes[0] values), then those of the next start."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts, sizes) + step * (np.arange(int(sizes.sum())) - np.repeat(before, sizes))


def _grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per value the number of its group and how many have it; per group one row that has it."""
    _, one, group, many = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
    return group, many[group], one


def _sorted(length: int, memory: int, coded: bool):
    """Starts of a shard's windows whose strings another window of the shard has too.

    Windows are cut into cells of starts at fixed offsets from the owner. A cell whose common units
    (those in all its strings) no other has is out, one whose units all stand in another one is
    settled. Of the others, each kind once, the common units become one name, so a string is some
    units, a name, and some units; the suffixes of these short sequences are sorted (in symbols of
    4 bits, as a scan takes time for each pair of symbols)."""
    wide = 2 * (CODE if coded else 1)  # symbols of 4 bits
    size = max(1, min(16 // wide, length // 2))
    odd = U64(0x9E3779B97F4A7C15)

    def run(shard: pa.Table) -> pa.Table:
        _bytes.tidy()
        raw, offsets = _units(shard.column("bytes"), coded)
        c, m, a, b = (np.array(shard.column(x)) for x in "cmab")
        first, last = (a - m) // size, (b - m) // size
        counts = last - first + 1
        i = np.repeat(np.arange(len(m)), counts)
        x = _ragged(first, counts) * size
        lo, hi = np.maximum(x, (a - m)[i]), np.minimum(x + size - 1, (b - m)[i])
        zero = (offsets[:-1] - (a - m))[i]  # where the owner starts
        sums = _bytes.prefix(raw)
        inner = _bytes.mix(_bytes.span_hash(sums, zero + x + size - 1, zero + x + length) + x.astype(U64) * odd)
        outer = _bytes.mix(_bytes.span_hash(sums, zero + lo, zero + hi + length) + lo.astype(U64) * odd)  # its length tells hi
        del sums
        single = (c == 1)[i]  # windows equal as a whole are settled and only bear witness
        _, among, _ = _grouped(inner)
        kind, around, one = _grouped(outer)
        done = single & (around > 1)
        keep = [(i[done], lo[done], hi[done])]
        one = one[among[one] > 1]
        one = one[_grouped(inner[one])[1] > 1]
        if len(one):
            names, _, _ = _grouped(inner[one])
            digits = 1
            while 16**digits <= int(names.max()):
                digits += 1
            left, right, at = (x + size - 1 - lo)[one], (hi - x)[one], zero[one]
            sizes = (left + right) * wide + digits + 1
            begin = np.cumsum(sizes) - sizes
            t = np.ones(int(sizes.sum()), np.int32)  # 1 stands between cells

            def put(where, units):
                for j in range(wide):
                    t[where + j] = (units >> (4 * j) & 15) + 2

            put(_ragged(begin, left, wide), raw[_ragged(at + lo[one], left)])
            middle = begin + left * wide
            put(_ragged(middle + digits, right, wide), raw[_ragged(at + x[one] + length, right)])
            for j in range(digits):
                t[middle + j] = 18 + (names >> (4 * j) & 15)
            long = (size - 1) * wide + digits
            repeats = np.zeros(len(t), bool)
            for order, common in suffix_blocks(t, long, memory):  # symbol by symbol
                close = common >= long
                repeats[order[close]] = True
                repeats[order[:-1][close[1:]]] = True
            open_ = (single & (around == 1))[one]
            starts = (hi - lo + 1)[one][open_]
            own = repeats[_ragged(begin[open_], starts, wide)]
            cell, start = np.repeat(one[open_], starts), _ragged(lo[one][open_], starts)
            follows = np.concatenate([[False], own[:-1] & (cell[1:] == cell[:-1])]) if len(own) else own
            precedes = np.concatenate([follows[1:] & own[1:], [False]]) if len(own) else own
            heads, tails = own & ~follows, own & ~precedes
            keep.append((i[cell[heads]], start[heads], start[tails]))
        row, low, high = (np.concatenate(v) for v in zip(*keep, strict=True))
        at = pa.array(row)
        return pa.table([shard.column("_key").take(at), shard.column("_digest").take(at), pa.array(low + m[row]), pa.array(high + m[row])], names=["_key", "_digest", "a", "b"])

    return run


def _cells(length: int, size: int, last: int, coded: bool, most: int = 1 << 16):
    """Per window: its starts in the cells ``last`` asks to split, cut into cells of ``size``; for
    each the digest of the bytes common to its strings (of the whole cell, also if the window has
    only part of it) and of the bytes around those it has. At most about ``most`` cells are held."""
    made = ("m", "a", "x", "lo", "hi", "inner", "outer")

    def run(batches):
        for batch in batches:
            col = {x: batch.column(batch.schema.get_field_index(x)) for x in ("_key", "_digest", "mh", "m", "a", "b", "bytes", "cells")}
            m, a, b = (np.array(col[x]) for x in "mab")
            raw, offsets = _units(col["bytes"], coded)
            asked, at = col["cells"].flatten().to_numpy(zero_copy_only=False), col["cells"].value_lengths()
            ends = np.cumsum(at.fill_null(0).to_numpy(zero_copy_only=False))
            every = col["cells"].is_null().to_numpy(zero_copy_only=False)
            held: list[list[np.ndarray]] = []
            count = 0

            def flush():
                rows = pa.array(np.concatenate([h[0] for h in held]))
                values = [pa.array(np.concatenate(v)) for v in list(zip(*held, strict=True))[1:]]
                return pa.RecordBatch.from_arrays([*[col[x].take(rows) for x in ("_key", "_digest", "mh")], *values], names=["_key", "_digest", "mh", *made])

            for i in range(len(m)):
                low, high = a[i] - m[i], b[i] - m[i]
                base = np.arange(low // last * last, high + 1, last) if every[i] else asked[(ends[i - 1] if i else 0) : ends[i]]
                x = (base[:, None] + np.arange(0, last, size)).ravel()
                lo, hi = np.maximum(x, low), np.minimum(x + size - 1, high)
                fits = lo <= hi
                if not fits.any():
                    continue
                x, lo, hi = x[fits], lo[fits], hi[fits]
                sums = _bytes.prefix(raw[offsets[i] : offsets[i + 1]])
                inner = _bytes.span_hash(sums, x + size - 1 - low, x + length - low).view(np.int64)
                outer = _bytes.span_hash(sums, lo - low, hi + length - low).view(np.int64)
                held.append([np.full(len(x), i), np.full(len(x), m[i]), np.full(len(x), a[i]), x, lo, hi, inner, outer])
                count += len(x)
                if count >= most:
                    yield flush()
                    held, count = [], 0
            if held:
                yield flush()

    return run


def _bisect(hot: DataFrame, length: int, kind: str, coded: bool) -> DataFrame:
    """Exact ranges of repeating starts in the windows of hot owners."""
    out = None
    todo = hot.withColumn("cells", F.lit(None).cast("array<bigint>"))
    sizes = [s for s in (64, 8, 1) if s == 1 or s <= length // 2]
    sizes.insert(0, 8 * sizes[0])
    for last, size in zip(sizes[:-1], sizes[1:], strict=True):
        cells = stored(todo.mapInArrow(_cells(length, size, last, coded), f"_key {kind}, _digest bigint, mh bigint, m bigint, a bigint, x bigint, lo bigint, hi bigint, inner bigint, outer bigint"), "cells")
        total = max(1, cells.count())
        around = cells.groupBy("mh", "lo", "hi", "outer").agg(F.count("*").alias("_o"), F.count("*").alias("around")).filter("_o > 1")
        among = cells.groupBy("mh", "x", "inner").agg(F.count("*").alias("_i"), F.count("*").alias("among")).filter("_i > 1")
        judged = lookup(cells, among, ["mh", "x", "inner"], "_i", total, how="inner")
        judged = stored(lookup(judged, around, ["mh", "lo", "hi", "outer"], "_o", total, how="left"), "judged")
        whole = judged.filter("around is not null").select("_key", "_digest", (F.col("lo") + F.col("m")).alias("a"), (F.col("hi") + F.col("m")).alias("b"))
        out = whole if out is None else out.unionByName(whole)
        # one of those that repeat as a whole goes on as a witness for windows that share a part with it
        witness = judged.filter("around is not null").groupBy("mh", "x", "lo", "hi", "outer").agg(F.min(F.struct("_key", "_digest", "a", "m")).alias("w")).select("w.*", "x")
        split = judged.filter("around is null").select("_key", "_digest", "a", "m", "x").unionByName(witness)
        split = split.groupBy("_key", "_digest", "a", "m").agg(F.collect_set("x").alias("cells")).withColumnsRenamed({x: f"_{x}" for x in ("_key", "_digest", "a", "m")})
        same = F.col("_key").eqNullSafe(F.col("__key")) & (F.col("_digest") == F.col("__digest")) & (F.col("a") == F.col("_a")) & (F.col("m") == F.col("_m"))
        todo = hot.join(split, same).drop("__key", "__digest", "_a", "_m")
    return out


def _merged(listed: list[dict] | None, length: int) -> list[list[int]]:
    """The runs that strings of ``length`` cover, from the ranges of their starts."""
    merged: list[list[int]] = []
    for x in sorted((y["a"], y["b"] + length) for y in listed or ()):
        if merged and x[0] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], x[1])
        else:
            merged.append(list(x))
    return merged


class _Kernel:
    def __init__(self, length: int, contents: bool, passage: int) -> None:
        self.length, self.contents, self.passage = length, contents, passage

    def __call__(self, column: pa.Array, ranges: pa.Array, words: pa.Array) -> list:
        raw, offsets = _bytes.view(column)
        data = raw.tobytes()
        n_removed, n_spans, digests, spans, kept = [], [], [], [], []
        for i, listed in enumerate(ranges.to_pylist()):
            text = data[offsets[i] : offsets[i + 1]]
            merged = _merged(listed, self.length)
            rest, at = [], 0
            for a, b in merged:
                rest.append(text[at:a])
                at = b
            rest = b"".join([*rest, text[at:]])
            n_removed.append(len(text) - len(rest))
            n_spans.append(len(merged))
            digests.append(hashlib.sha256(rest).hexdigest())
            spans.append([{"start": a, "end": b} for a, b in merged])
            kept.append(rest if self.contents else None)
        n_repeated = [sum(b - a for a, b in _merged(listed, self.passage)) for listed in words.to_pylist()]
        return [np.diff(offsets), n_removed, n_spans, digests, spans, kept, n_repeated]


def _ranges(rows: DataFrame, kind: str, length: int, gram: int, hot: int, shard_bytes: int, sort_memory: int, coded: bool = False) -> DataFrame:
    """Per text (_key, _digest) that has any: r, ranges (a, b) of the starts of strings that repeat;
    ``coded``: strings of words' codes, with places, ``length`` and ``gram`` in words."""
    run, schema = _window_rows(length, gram, kind, coded)
    every = stored(rows.mapInArrow(run, schema), "windows")
    total = max(1, every.count())
    owners = every.groupBy("mh").agg(F.count("*").alias("_n"), (F.min("wh") != F.max("wh")).alias("mixed")).filter("_n > 1")
    shared = stored(lookup(every, owners, ["mh"], "_n", total, how="inner"), "shared")
    ranges = shared.filter("not mixed").select("_key", "_digest", "a", "b")
    mixed = shared.filter("mixed").drop("mixed")
    kinds = mixed.groupBy("mh", "wh").agg(F.count("*").alias("c"), F.min(F.struct("_key", "_digest", "m", "a", "b")).alias("rep"))
    kinds = stored(kinds, "kinds")
    alike = kinds.filter("c > 1").select("mh", "wh", F.col("c").alias("_n"), F.lit(True).alias("alike"))
    ranges = ranges.unionByName(lookup(mixed, alike, ["mh", "wh"], "_n", total, how="inner").select("_key", "_digest", "a", "b"))
    several = kinds.groupBy("mh").agg(F.count("*").alias("d"), F.count("*").alias("_n"))
    pool = lookup(kinds, several, ["mh"], "_n", max(1, kinds.count()), how="inner")
    pool = pool.select("mh", "c", "d", "rep.*").groupBy("_key", "_digest").agg(F.collect_list(F.struct("mh", "m", "a", "b", "c", "d")).alias("w"))
    fetched = rows.join(pool.withColumnsRenamed({"_key": "_k", "_digest": "_d"}), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_digest") == F.col("_d"))).select("_key", "_digest", "_text", "w")
    cut = stored(fetched.mapInArrow(_cut_rows(length, coded), f"_key {kind}, _digest bigint, mh bigint, m bigint, a bigint, b bigint, c bigint, d bigint, bytes binary").dropDuplicates(["_key", "_digest", "a", "m"]), "cut")
    calm = cut.filter(F.col("d") <= hot)
    size = calm.select(F.sum(F.octet_length("bytes")).alias("n")).first()["n"] or 0
    shards = max(1, -(-size // shard_bytes))
    found = calm.groupBy(F.pmod(F.xxhash64("mh"), F.lit(shards)).alias("shard")).applyInArrow(_sorted(length, sort_memory, coded), f"_key {kind}, _digest bigint, a bigint, b bigint")
    ranges = ranges.unionByName(found)
    busy = cut.filter(F.col("d") > hot)
    if not busy.isEmpty():
        ranges = ranges.unionByName(_bisect(busy, length, kind, coded))
    ranges = stored(ranges.groupBy("_key", "_digest").agg(F.collect_list(F.struct("a", "b")).alias("r")), "ranges")
    discard(every, shared, kinds, cut)
    return ranges


def passages(rows: DataFrame, kind: str, words: int, *, hot: int = 512, shard_bytes: int = 1 << 20, sort_memory: int = 1 << 17) -> DataFrame:
    """Per text (_key, _digest) of ``rows`` (_key, _digest, _text) that has any: spans (array of
    start and end, in words) covered by passages of ``words`` words that start elsewhere too."""
    found = _ranges(rows, kind, words, max(1, min(16, words // 2)), hot, shard_bytes, sort_memory, coded=True)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                merged = [[{"start": a, "end": b} for a, b in _merged(x, words)] for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(merged, spans)], names=["_key", "_digest", "spans"])

    return found.select("_key", "_digest", "r").mapInArrow(run, f"_key {kind}, _digest bigint, spans array<struct<start:bigint,end:bigint>>")


def dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = 400, gram: int = 64, hot: int = 512, shard_bytes: int = 1 << 20, sort_memory: int = 1 << 17, contents: bool = True, passage: int = 0) -> DataFrame:
    """One row per document: key, n_bytes, n_removed, n_spans, kept_sha256, spans (byte offsets of
    removed runs) and kept (the remaining bytes; null unless ``contents``).

    With ``passage``, also n_repeated: words in passages of so many words that start elsewhere too,
    found like the strings, on 24-bit codes of the words; nothing is removed for them."""
    rows = docs.select(F.col(f"`{key}`").alias("_key"), text_digest(F.col(f"`{text}`")).alias("_digest"), F.col(f"`{text}`").cast("string").alias("_text"))
    kind = docs.schema[key].dataType.simpleString()
    found = _ranges(rows, kind, length, gram, hot, shard_bytes, sort_memory).withColumnRenamed("r", "_r")
    if passage:
        words = _ranges(rows, kind, passage, max(1, min(gram // 4, passage // 2)), hot, shard_bytes, sort_memory, coded=True).withColumnRenamed("r", "_w")
        found = found.withColumn("_w", F.lit(None).cast("array<struct<a:bigint,b:bigint>>")).unionByName(words.withColumn("_r", F.lit(None).cast("array<struct<a:bigint,b:bigint>>")))
        found = found.groupBy("_key", "_digest").agg(F.first("_r", True).alias("_r"), F.first("_w", True).alias("_w"))
    else:
        found = found.withColumn("_w", F.lit(None).cast("array<struct<a:bigint,b:bigint>>"))
    joined = rows.join(found.withColumnsRenamed({"_key": "_k", "_digest": "_d"}), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_digest") == F.col("_d")), "left").select("_key", F.col("_r").alias("r"), F.col("_w").alias("w"), "_text")
    kernel = _Kernel(length, contents, passage)

    def finish(batches):
        _bytes.tidy()
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary(), pa.int64()]
        for batch in batches:
            for part in _bytes.slices(batch, "_text", PIECE):
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, t) for x, t in zip(kernel(part.column(3), part.column(1), part.column(2)), types, strict=True)]], names=["_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept", "n_repeated"])

    out = joined.mapInArrow(finish, f"_key {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>, kept binary, n_repeated bigint")
    return (out if passage else out.drop("n_repeated")).withColumnRenamed("_key", key)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """n_repeated counts the words in passages of over 50 words that stand elsewhere too, also those
    of under 400 bytes, which stay."""
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), contents=False, passage=51)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated")


def brute_force(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) from a table of all strings; for tests."""
    data = [(x or "").encode() for x in texts]
    seen: dict[bytes, int] = {}
    for x in data:
        for i in range(len(x) - length + 1):
            d = hashlib.blake2b(x[i : i + length], digest_size=12).digest()
            seen[d] = seen.get(d, 0) + 1
    out = []
    for x in data:
        gone = np.zeros(len(x) + 1, np.int64)
        for i in range(len(x) - length + 1):
            if seen[hashlib.blake2b(x[i : i + length], digest_size=12).digest()] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        edges = int((np.diff(np.concatenate([[0], mask.view(np.int8)])) == 1).sum())
        rest = np.frombuffer(x, np.uint8)[~mask].tobytes()
        out.append((len(x), int(mask.sum()), edges, hashlib.sha256(rest).hexdigest()))
    return out
