"""N-gram Jaccard join by chosen paths.

A document is the set of its word shingles. Documents with equal sets are one class; the join works
on classes. Each run samples, for every set, paths of tokens: a path is extended by those tokens of
the set that a hash of the path selects, about 1 / (threshold * size) of them, so sets that share
most tokens share a path with good odds and others rarely do. Sets that meet on a path form a
bucket. Small buckets are brute-forced; larger ones are split again on longer paths. Runs repeat
until the chance to miss a pair at the threshold is below ``1 - recall``.

Brute force inside a bucket compares 512-bit minwise sketches and keeps a spanning forest of the
pairs that may be similar, never all pairs. The forests' connected components hold every candidate
pair; each component's sets are then compared exactly, in blocks, which gives the links (pairs at
the threshold or above), their number per document and the final classes.

Defined cases: a text of fewer words than a shingle is one shingle of all its words; texts that are
null or without words have no links and a class of their own; a class is named by its smallest
document id (nulls first); copies count as links of each other and are not expanded into pairs;
rows repeated exactly are copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm import _bytes
from gaugeframe.llm._spark import components, lookup, map_text, stored, table, text_digest

U64 = np.uint64
POOL = 8  # tokens of a run's pool for each one that a step selects
SKETCH = 512
ROUNDS = 8  # of bins; the same for all sizes, or sketches of different sizes would not compare
SALTS = _bytes.mix(np.arange(1, SKETCH + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text in turn, offsets)."""
    raw, offsets = _bytes.view(column)
    raw = _bytes.lower(raw)
    starts, ends, before = _bytes.words(raw, offsets, _bytes.ALNUM)
    h = _bytes.word_hashes(raw, starts, ends)
    n = np.diff(before)
    doc = np.repeat(np.arange(len(n)), n)
    whole = np.arange(len(h)) + width <= before[1:][doc] if len(h) else np.zeros(0, bool)
    rolled = np.zeros(len(h), U64)
    if len(h) >= width:
        rolled[: len(h) - width + 1] = _bytes.roll(h, width)
    short = np.flatnonzero((n > 0) & (n < width))
    own = [int(_bytes.roll(h[before[i] : before[i + 1]], int(n[i]))[0]) ^ int(n[i]) for i in short]
    values = np.concatenate([rolled[whole], np.array(own, U64)])
    docs = np.concatenate([doc[whole], short])
    order = np.lexsort((values, docs))
    values, docs = values[order], docs[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (docs[1:] != docs[:-1])
    return values[first], np.searchsorted(docs[first], np.arange(len(n) + 1))


def _seed(*parts: int) -> np.uint64:
    x = U64(0x243F6A8885A308D3)
    with np.errstate(over="ignore"):
        for p in parts:
            x = _bytes.mix(np.array([x ^ U64(p)]) * U64(0x9E3779B97F4A7C15) + U64(1))[0]
    return x


def _below(share: np.ndarray) -> np.ndarray:
    """Shares of 1 as thresholds for 64-bit hashes."""
    return np.minimum(share * 2.0**64, 2.0**64 - 4096).astype(U64)


def paths(values: np.ndarray, at: np.ndarray, depth: int, runs: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(text, path) of every chosen path of ``depth`` tokens, over all runs."""
    sizes = np.diff(at)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    rate = 1 / (threshold * np.maximum(sizes, 1))
    pooled = np.minimum(1, POOL * rate)
    pool_cut, step_cut = _below(pooled)[doc], _below(np.minimum(1, rate / pooled))
    out_doc, out_path = [], []
    for r in range(runs):
        chosen = _bytes.mix(values ^ _seed(r, 1)) <= pool_cut
        x, d = values[chosen], doc[chosen]
        begin = np.searchsorted(d, np.arange(len(sizes) + 1))
        node_doc, node = np.flatnonzero(sizes > 0), np.full(int((sizes > 0).sum()), _seed(r, 2), U64)
        for _ in range(depth):
            n = begin[node_doc + 1] - begin[node_doc]
            parent = np.repeat(np.arange(len(node)), n)
            token = np.arange(len(parent)) - np.repeat(np.cumsum(n) - n, n) + begin[node_doc][parent]
            grown = _bytes.mix(node[parent] * U64(0x9E3779B97F4A7C15) + x[token])
            keep = _bytes.mix(grown ^ U64(0x6A09E667F3BCC908)) <= step_cut[node_doc[parent]]
            node_doc, node = node_doc[parent][keep], grown[keep]
        out_doc.append(node_doc)
        out_path.append(node)
    return np.concatenate(out_doc), np.concatenate(out_path)


def sketches(values: np.ndarray, at: np.ndarray) -> list[bytes]:
    """One bit of each of 512 minwise hashes, per text, by one scheme for all sizes: a bin takes its
    least value in the first of ``ROUNDS`` rounds that has one, or else an independent minwise hash.
    Two sets then agree in a bin's value with a probability of their similarity, whatever their sizes."""
    out = []
    h = _bytes.mix(values ^ U64(0xA54FF53A5F1D36F1))
    empty = ~U64(0)
    for a, b in zip(at[:-1], at[1:], strict=True):
        own = h[a:b]
        bits = np.zeros(SKETCH, np.uint8)
        if len(own):
            low = np.full(SKETCH, empty)
            for k in range(ROUNDS):
                g = _bytes.mix(own ^ np.array([k + 1], U64) * U64(0xC2B2AE3D27D4EB4F)) if k else own
                nxt = np.full(SKETCH, empty)
                np.minimum.at(nxt, (g >> U64(55)).astype(np.int64), g & U64((1 << 55) - 1))
                low = np.where(low == empty, nxt, low)
                if not (low == empty).any():
                    break  # later rounds would change nothing
            left = np.flatnonzero(low == empty)
            if len(left):
                low[left] = _bytes.mix(own[None, :] ^ SALTS[left, None]).min(1)
            bits = (_bytes.mix(low) & U64(1)).astype(np.uint8)
        out.append(np.packbits(bits).tobytes())
    return out


class _Kernel:
    def __init__(self, width: int, depth: int, runs: int, threshold: float) -> None:
        self.options = width, depth, runs, threshold

    def __call__(self, column: pa.Array) -> list:
        width, depth, runs, threshold = self.options
        values, at = shingles(column, width)
        sizes = np.diff(at)
        mixed = _bytes.mix(values)
        sums = np.concatenate([[U64(0)], np.cumsum(mixed, dtype=U64)])
        twice = np.concatenate([[U64(0)], np.cumsum(_bytes.mix(mixed ^ U64(99)), dtype=U64)])
        sig = _bytes.mix((sums[at[1:]] - sums[at[:-1]]) ^ _bytes.mix((twice[at[1:]] - twice[at[:-1]]) + sizes.astype(U64))).view(np.int64)
        doc, path = paths(values, at, depth, runs, threshold)
        order = np.argsort(doc, kind="stable")
        cuts = np.searchsorted(doc[order], np.arange(len(sizes) + 1))
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(path[order].view(np.int64)))
        return [sig, sizes, pa.array(sketches(values, at), pa.binary()), lists]


class _Sets:
    def __init__(self, width: int) -> None:
        self.width = width

    def __call__(self, column: pa.Array) -> list:
        values, at = shingles(column, self.width)
        return [pa.array([values[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())]


def _forest(near, n: int) -> list[tuple[int, int]]:
    """Spanning forest of the graph in which near(i) marks the neighbours of i."""
    left, edges = np.ones(n, bool), []
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            i = queue.pop()
            found = np.flatnonzero(near(i) & left)
            left[found] = False
            edges += [(i, int(j)) for j in found]
            queue += found.tolist()
    return edges


def _candidates(threshold: float):
    """Brute force in every bucket of a batch of buckets: a forest, over the whole batch, of the
    pairs whose sketches and sizes allow the threshold (so a pair that meets on many paths of a batch
    is given once, and no more edges leave than the batch has sets)."""
    least = int(SKETCH * ((1 + threshold) / 2 - 0.06))

    def run(batch: pa.Table) -> pa.Table:
        cid, path = np.array(batch.column("cid")), np.array(batch.column("path"))
        ids, first, at = np.unique(cid, return_index=True, return_inverse=True)
        size = np.array(batch.column("size"))[first]
        blobs = batch.column("sketch")
        bits = np.array([np.frombuffer(blobs[int(i)].as_py(), U64) for i in first])
        order = np.lexsort((at, path))
        path, at = path[order], at[order]
        cuts = np.flatnonzero(np.diff(path, prepend=path[0] - 1))
        parent = np.arange(len(ids))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return int(i)

        edges = []
        for a, b in zip(cuts, [*cuts[1:], len(path)], strict=True):
            own = at[a:b]
            if len({root(i) for i in own.tolist()}) == 1:
                continue  # all of them are connected already
            w, n = bits[own], size[own]

            def near(i: int, w=w, n=n) -> np.ndarray:
                agree = SKETCH - np.bitwise_count(w ^ w[i]).sum(1)
                return (agree >= least) & (np.minimum(n, n[i]) >= threshold * np.maximum(n, n[i]) - 1e-9)

            for i, j in _forest(near, len(own)):
                x, y = root(int(own[i])), root(int(own[j]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    edges.append((int(own[i]), int(own[j])))
        return pa.table({"a": pa.array([int(ids[i]) for i, _ in edges], pa.int64()), "b": pa.array([int(ids[j]) for _, j in edges], pa.int64())})

    return run


def _texts_of(rows: DataFrame, chosen: DataFrame, most: int) -> DataFrame:
    """The texts of chosen (_k, _d, ...), each once. Up to ``most`` chosen rows (counted first) go by
    broadcast, so the texts are not shuffled; more meet them in a shuffle."""
    if chosen.count() <= most:
        chosen = F.broadcast(chosen)
    found = rows.join(chosen, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_digest") == F.col("_d"))).drop("_key", "_digest", "_k", "_d")
    return found


def _compare(threshold: float):
    """Exact comparison of one component, or of one pair of blocks of a large component: links of
    each member (weighted by copies) and a forest of the links."""

    def run(part: pa.Table) -> pa.Table:
        ids, copies, side = np.array(part.column("cid")), np.array(part.column("n")), np.array(part.column("side"))
        order = np.unique(ids, return_index=True)[1]
        ids, copies, side = ids[order], copies[order], side[order]
        blobs = part.column("tokens").to_pylist()
        sets = [np.frombuffer(blobs[i], U64) for i in order]
        size = np.array([len(s) for s in sets])
        values, counts = np.unique(np.concatenate(sets), return_counts=True)
        common = values[counts > 1]  # tokens of a single member are in no intersection
        bits = np.zeros((len(ids), 8 * max(1, -(-len(common) // 64))), np.uint8)
        for i, s in enumerate(sets):
            at = np.searchsorted(common, s)
            at = at[(at < len(common))]
            at = at[np.isin(common[at], s, assume_unique=True)]
            row = np.zeros(bits.shape[1] * 8, np.uint8)
            row[at] = 1
            bits[i] = np.packbits(row)
        words = bits.view(U64)
        links = np.zeros(len(ids), np.int64)
        across = part.column("p")[0] != part.column("q")[0]  # two different blocks: only pairs between them are new

        def near(i: int) -> np.ndarray:
            both = np.bitwise_count(words & words[i]).sum(1, dtype=np.int64)
            close = both / (size + size[i] - both) >= threshold
            close[i] = False
            if across:
                close &= side != side[i]
            return close

        for i in range(len(ids)):
            links[i] = copies[near(i)].sum()
        edges = _forest(near, len(ids))
        return pa.table({
            "a": pa.array([*ids.tolist(), *[int(ids[i]) for i, _ in edges]], pa.int64()),
            "b": pa.array([None] * len(ids) + [int(ids[j]) for _, j in edges], pa.int64()),
            "links": pa.array([*links.tolist(), *[0] * len(edges)], pa.int64()),
        })

    return run


def runs_for(recall: float, threshold: float, depth: int) -> int:
    """Runs until a pair at the threshold shares a path of ``depth`` with probability ``recall``."""
    shared, survive = 2 / (1 + threshold), 1.0
    for _ in range(depth):
        survive = 1 - np.exp(-shared * survive)
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - survive))))


def join(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8, recall: float = 0.9999, depth: int = 2, small: int = 4096, block: int = 512, block_tokens: int = 1 << 20, batch_rows: int = 100_000, broadcast_rows: int = 1_000_000, with_digest: bool = False) -> DataFrame:
    """One row per document: key, class_id, n_links, and keep (the first document of its class).

    ``class_id`` is the smallest key among the documents that links connect. ``with_digest`` adds
    _digest, which with the key names the row's text.
    """
    runs = runs_for(recall, threshold, depth)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).withColumn("_digest", text_digest(F.col("_text")))
    made = stored(map_text(rows, "_text", ["_key", "_digest"], "cid bigint, size int, sketch binary, paths array<bigint>", _Kernel(width, depth, runs, threshold)), "shingles")
    full = made.filter("size > 0")
    classes = stored(full.groupBy("cid").agg(F.min(F.struct("_key", "_digest")).alias("rep"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths")), "classes")
    edges = None
    pairs = classes.select("cid", F.explode("paths").alias("path"))
    while True:
        counted = pairs.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
        total = max(1, pairs.count())
        met = stored(lookup(pairs, counted.withColumn("members", F.col("n")), ["path"], "n", total, how="inner"), "met")
        last = depth >= 8
        brute = met if last else met.filter(F.col("members") <= small)
        bucket = brute.join(classes.select("cid", "size", "sketch"), "cid").select("path", "cid", "size", "sketch")
        batches = max(1, -(-brute.count() // batch_rows))
        found = stored(bucket.groupBy(F.pmod(F.xxhash64("path"), F.lit(batches)).alias("batch")).applyInArrow(_candidates(threshold), "a bigint, b bigint").distinct(), "pairs")
        edges = found if edges is None else edges.unionByName(found)
        wide = met.filter(F.col("members") > small).select("cid").distinct()
        if last or wide.isEmpty():
            break
        depth += 2  # split the large buckets on longer paths
        again = _texts_of(rows, stored(classes.join(wide, "cid").select("cid", F.col("rep._key").alias("_k"), F.col("rep._digest").alias("_d")), "wide"), broadcast_rows)
        deeper = map_text(again, "_text", ["cid"], "sig bigint, size int, sketch binary, paths array<bigint>", _Kernel(width, depth, runs_for(recall, threshold, depth), threshold))
        pairs = stored(deeper.select("cid", F.explode("paths").alias("path")).distinct(), "paths")
    groups = components(edges).withColumnsRenamed({"node": "cid", "root": "comp"})
    sized = stored(groups.join(classes.select("cid", "n", "size", F.col("rep._key").alias("_k"), F.col("rep._digest").alias("_d")), "cid"), "sized")
    # a component of up to two blocks (by sets and by tokens) is one task's group; a larger one is
    # compared block by block, so that long texts do not fill a task either
    parts = F.greatest(F.count("*") / block, F.sum(F.col("size").cast("bigint")) / block_tokens)
    blocks = F.when(parts <= 2, F.lit(1)).otherwise(F.least(F.ceil(parts), F.count("*"))).cast("int")
    member = stored(sized.join(sized.groupBy("comp").agg(blocks.alias("nb")), "comp"), "members")
    texts = _texts_of(rows, member.select("cid", "comp", "nb", "n", "_k", "_d"), broadcast_rows)
    sets = map_text(texts, "_text", ["cid", "comp", "nb", "n"], "tokens binary", _Sets(width))  # repeated rows repeat a set; _compare drops them
    sets = sets.withColumn("i", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int"))
    spread = sets.select("cid", "comp", "n", "tokens", "i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"))
    spread = spread.select("cid", "comp", "n", "tokens", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), (F.col("i") > F.col("j")).alias("side"))
    verdict = stored(spread.groupBy("comp", "p", "q").applyInArrow(_compare(threshold), "a bigint, b bigint, links bigint"), "verdicts")
    links = verdict.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "cid")
    final = components(verdict.filter("b is not null").select("a", "b")).withColumnsRenamed({"node": "cid", "root": "comp"})
    named = classes.select("cid", "rep", "n").join(links, "cid", "left").join(final, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    firsts = named.filter(F.col("links") > 0).groupBy("comp").agg(F.min("rep").alias("first"))
    named = named.join(firsts, "comp", "left").select("cid", F.coalesce("first", "rep").alias("first"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "n")
    joined = lookup(full.select("_key", "_digest", "cid"), named, ["cid"], "n", max(1, full.count()), how="left")
    out = joined.select("_key", "_digest", F.col("first._key").alias("class_id"), "n_links", ((F.col("first._key").eqNullSafe(F.col("_key"))) & (F.col("first._digest") == F.col("_digest"))).alias("keep"))
    empty = made.filter("size = 0").select("_key", "_digest", F.col("_key").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(True).alias("keep"))
    out = out.unionByName(empty).withColumnRenamed("_key", key)
    return out if with_digest else out.drop("_digest")


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


OP2_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w
  from documents where text is not null),
grams as (
  select distinct doc_id, unnest(case when len(w) < 5 then [array_to_string(w, ' ')]
    else [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] end) as g
  from words where len(w) > 0),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
met as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared
  from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select a, b from met join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where shared / (x.n + y.n - shared) >= 0.8::double),
reach(node, seen) as (
  select doc_id, doc_id from documents
  union
  select l.b, r.seen from reach r join links l on l.a = r.node)
select d.doc_id, min(r.seen) as class_id, (select count(*) from links where links.a = d.doc_id)::bigint as n_links
from documents d join reach r on r.node = d.doc_id group by d.doc_id
"""
