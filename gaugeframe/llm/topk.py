"""Exact top-k inner-product search by block-at-a-time pruning.

Vectors become integers floor(scale * x) and are packed into blocks, ranges of documents as they
stand in the input, each with the largest and least value of every term (dimension) and a forward
index (its rows). A tile is a group of queries against a slice of blocks. For every query the blocks
of a tile are ordered by the sum of its terms' best contributions, an upper bound on any score in
the block; blocks are scored through their forward index in that order until the bound falls below
the query's k-th score. A block whose bound equals it is still scored, as ties go to smaller ids.

Every tile holds a bounded number of queries and rows, so a task's memory does not grow; all queries
meet all rows in some tile, and the tiles' results (k rows per query) are merged by query. Only the
rows that ask travel as queries. They meet one slice first; the k-th score found there travels with
them to all other slices, where a block whose bound is lower is never scored.

Defined cases: vectors that are null, or hold a null or non-finite component, and rows with a null
id take no part; vectors of unequal length are padded with zeros; repeated rows are separate rows,
and a query leaves out its own row alone; fewer than k candidates are all returned; no rows give
none; finite components of 2**62 or more when scaled, and products that could pass 62 bits, raise
OverflowError, as a score is a bigint.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.llm._spark import stored, table

BLOCK = "uid bigint, ids binary, width int, rows binary, high binary, low binary, asked binary"


def _packer(scale: float, rows: int):
    def pack(uid: int, ids: list, vectors: list, asked: list) -> pa.RecordBatch:
        width = max(map(len, vectors))
        m = np.zeros((len(ids), width), np.int64)
        for i, v in enumerate(vectors):
            m[i, : len(v)] = v
        columns = [[uid], [np.array(ids, np.int64).tobytes()], [width], [m.astype(np.int32).tobytes() if m.size == 0 or np.abs(m).max() < 1 << 31 else m.tobytes()], [m.max(0).tobytes()], [m.min(0).tobytes()], [np.array(asked, bool).tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=["uid", "ids", "width", "rows", "high", "low", "asked"])

    def run(batches):
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 32
        held: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            for key, vector, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if key is None or not vector.is_valid or vector.values.null_count:
                    continue
                v = np.floor(scale * np.array(vector.values, np.float64))
                if not np.isfinite(v).all():
                    continue
                if len(v) and np.abs(v).max() >= 2.0**62:
                    raise OverflowError(f"a component of vector {key} does not fit 62 bits")
                for x, y in zip(held, (key, v.astype(np.int64), bool(asked)), strict=True):
                    x.append(y)
                if len(held[0]) == rows:
                    yield pack(uid, *held)
                    uid, held = uid + 1, ([], [], [])
        if held[0]:
            yield pack(uid, *held)

    return run


def _matrix(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    if not row["width"]:
        return ids, np.zeros((len(ids), 0), np.int64)
    wide = len(row["rows"]) == 8 * len(ids) * row["width"]
    return ids, np.frombuffer(row["rows"], np.int64 if wide else np.int32).reshape(len(ids), row["width"]).astype(np.int64)


ASKING = "uid bigint, n int, places binary, ids binary, width int, rows binary"


def _asking_rows(batches):
    """The rows of each block that ask, with their places in it."""
    for batch in batches:
        for row in batch.to_pylist():
            places = np.flatnonzero(np.frombuffer(row["asked"], bool))
            ids, m = _matrix(row)
            columns = [[row["uid"]], [len(places)], [places.astype(np.int64).tobytes()], [ids[places].tobytes()], [row["width"]], [m[places].astype(np.int64).tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()), strict=True)], names=["uid", "n", "places", "ids", "width", "rows"])


def _padded(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def search(queries: list[tuple[int, int, int, np.ndarray, int]], blocks: list[dict], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of each query's best k in the blocks, without those below its floor; a query is
    (block uid, place, id, vector, floor)."""
    mats = [(b["uid"], *_matrix(b)) for b in blocks]
    width = max([len(q[3]) for q in queries] + [m.shape[1] for *_, m in mats])
    q = _padded(np.array([np.pad(x[3], (0, width - len(x[3]))) for x in queries]), width)
    mats = [(u, i, _padded(m, width)) for u, i, m in mats]
    high = np.array([m.max(0, initial=-(1 << 62)) for *_, m in mats])
    low = np.array([m.min(0, initial=1 << 62) for *_, m in mats])
    largest = int(np.abs(q).max(initial=0)) * int(max(np.abs(high).max(initial=0), np.abs(low).max(initial=0))) * max(1, width)
    kind = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64
    if largest >= 1 << 62:
        raise OverflowError("scores beyond 62 bits")
    bound = (np.maximum(q, 0).astype(kind) @ high.T.astype(kind) + np.minimum(q, 0).astype(kind) @ low.T.astype(kind)).astype(np.int64)
    order = np.argsort(-bound, 1, kind="stable")
    least = -(1 << 62)
    top_s, top_i = np.full((len(q), k), least), np.full((len(q), k), np.iinfo(np.int64).max)
    floor = np.array([x[4] for x in queries])
    own = {(x[0], x[1]): n for n, x in enumerate(queries)}
    uids = [m[0] for m in mats]
    by_block: dict[int, list[tuple[int, int]]] = {}
    for (uid, place), n in own.items():
        if uid in uids:
            by_block.setdefault(uids.index(uid), []).append((n, place))
    qk = q.astype(kind)
    for step in range(len(mats)):
        at = order[:, step]
        live = bound[np.arange(len(q)), at] >= np.maximum(top_s[:, k - 1], floor)
        if not live.any():
            break
        for b in np.unique(at[live]):
            rows = np.flatnonzero(live & (at == b))
            _, ids, m = mats[b]
            s = (qk[rows] @ m.T.astype(kind)).astype(np.int64)
            place_of = {n: p for n, p in by_block.get(int(b), ())}
            for r, n in enumerate(rows):
                if int(n) in place_of:
                    s[r, place_of[int(n)]] = least
            every_s = np.concatenate([top_s[rows], s], 1)
            every_i = np.concatenate([top_i[rows], np.broadcast_to(ids, s.shape)], 1)
            if every_s.shape[1] > 4 * k:  # keep what can be among the k best, ties included
                kth = -np.partition(-every_s, k - 1, 1)[:, k - 1 : k]
                most = int((every_s >= kth).sum(1).max())
                near = np.argpartition(-every_s, min(most, every_s.shape[1]) - 1, 1)[:, :most]
                every_s, every_i = np.take_along_axis(every_s, near, 1), np.take_along_axis(every_i, near, 1)
            best = np.lexsort((every_i, -every_s), 1)[:, :k]
            top_s[rows], top_i[rows] = np.take_along_axis(every_s, best, 1), np.take_along_axis(every_i, best, 1)
    return [(i[(s > least) & (s >= f)], s[(s > least) & (s >= f)]) for s, i, f in zip(top_s, top_i, floor, strict=True)]


def top_k(vectors: DataFrame, is_query: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = 20, scale: float = 64.0, block_rows: int = 1024, tile_blocks: int = 16, tile_queries: int = 4096) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows."""
    source = vectors.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{vector}`").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    blocks = stored(source.mapInArrow(_packer(scale, block_rows), BLOCK), "vector-blocks")
    slices = max(1, -(-blocks.count() // tile_blocks))
    asking = stored(blocks.filter(F.locate("01", F.hex("asked")) > 0).select("uid", "ids", "width", "rows", "asked").mapInArrow(_asking_rows, ASKING), "queries")
    groups = max(1, -(-(asking.agg(F.sum("n")).first()[0] or 0) // tile_queries))
    # both sides come from one table: fresh names keep their columns apart
    tiles = blocks.select(*[F.col(c).alias(f"b_{c}") for c in ("uid", "ids", "width", "rows")], F.pmod(F.xxhash64("uid"), F.lit(slices)).alias("s"))
    asked = asking.select(*[F.col(c).alias(f"q_{c}") for c in ("uid", "places", "ids", "width", "rows")], F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(groups)).cast("int").alias("g"))

    def run(queries: pa.Table, tile: pa.Table) -> pa.Table:
        schema = pa.schema([(x, pa.int64()) for x in ("uid", "place", "query_id", "vec_id", "score")])
        if not tile.num_rows or not queries.num_rows:  # one side of a tile can be missing
            return schema.empty_table()
        ask, rows = [], {x: [] for x in schema.names}
        for row in ({k[2:]: v for k, v in r.items()} for r in queries.to_pylist()):
            ids, m = _matrix(row)
            known = dict(zip(row["at"] or (), row["floor"] or (), strict=True))
            ask += [(row["uid"], int(p), int(i), v, known.get(int(p), -(1 << 62))) for p, i, v in zip(np.frombuffer(row["places"], np.int64), ids, m, strict=True)]
        own = [{k[2:]: v for k, v in r.items()} for r in tile.to_pylist()]
        for i in range(0, len(ask), tile_queries):
            part = ask[i : i + tile_queries]
            for (uid, place, name, _, _), (ids, scores) in zip(part, search(part, own, k), strict=True):
                for x, v in zip(rows, ([uid] * len(ids), [place] * len(ids), [name] * len(ids), ids.tolist(), scores.tolist()), strict=True):
                    rows[x] += v
        return pa.table(rows, schema)

    result = "uid bigint, place bigint, query_id bigint, vec_id bigint, score bigint"

    def met(floors: DataFrame | None, low: int, high: int) -> DataFrame:
        """All queries against the slices from low to before high."""
        left = asked.withColumn("q_at", F.lit(None).cast("array<bigint>")).withColumn("q_floor", F.lit(None).cast("array<bigint>")) if floors is None else asked.join(floors, "q_uid", "left")
        left = left.withColumn("s", F.explode(F.sequence(F.lit(low).cast("bigint"), F.lit(high - 1).cast("bigint"))))
        right = tiles.filter((F.col("s") >= low) & (F.col("s") < high)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        return left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInArrow(run, result)

    out = met(None, 0, 1)
    if slices > 1:
        out = stored(out, "first-slice")
        kth = out.groupBy("uid", "place").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k)
        floors = kth.groupBy(F.col("uid").alias("q_uid")).agg(F.collect_list("place").alias("q_at"), F.collect_list("least").alias("q_floor"))  # at most block_rows a block
        out = out.unionByName(met(floors, 1, slices))
    best = Window.partitionBy("uid", "place").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, F.col("vec_id") % 20 == 0)


OP3_SQL = """
with v as (
  select vec_id, [floor(64 * x::double) for x in embedding] as e from embeddings
  where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, rank::integer as rank, vec_id, score from ranked where rank <= 20
"""
