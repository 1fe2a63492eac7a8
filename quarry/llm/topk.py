"""Exact top-k search (operator 10): ball-tree branch and bound per shard.

Vectors are dealt to shards by a hash of their id; a shard is packed into one row.
Queries are packed into blocks.  A block first meets one shard, which gives each of
its queries a k-th score that no result can fall below; with these bounds it then
meets every shard.  In a shard a ball tree is searched best first: nodes wait by
their upper bound of the inner product, a node is entered only with the queries
whose k-th score so far its bound still reaches, and leaves raise those scores.
Tasks carry the raised scores on from shard to shard.

Scores are exact: products are summed in float64 while they stay below 2**53, and
else as Python integers (results beyond 64 bits are cut to the range of a long).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import table, written

LEAF, BLOCK_ROWS, SHARD_ROWS = 64, 4096, 65536
#: Bytes of a packed shard or block at most, and of all blocks together that are broadcast at most.
PACK_BYTES, BROADCAST_BYTES = 64 << 20, 64 << 20
LONG = (-(2**63), 2**63 - 1)


def quantized(vector: Column, scale: int) -> Column:
    """array<long>: floor(scale * x); null where the vector is null or holds a component
    that is null, infinite or not a number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def products(a: np.ndarray, b: np.ndarray, dim: int) -> np.ndarray:
    """a @ b.T of integers, exactly."""
    most = max(1, float(np.abs(a.astype(float)).max(initial=0))) * max(1, float(np.abs(b.astype(float)).max(initial=0))) * max(dim, 1)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, *LONG).astype(np.int64)


class BallTree:
    """Balls over rows of integers: split at the middle of the widest direction between
    two far points, down to leaves of LEAF rows."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows, self.order = rows, np.arange(len(rows))
        self.nodes: list[tuple[np.ndarray, float, int, int, int, int]] = []  # centre, radius, from, to, left, right
        at = rows.astype(np.float64)
        if len(rows):
            self._grow(at, 0, len(rows))

    def _grow(self, at: np.ndarray, start: int, stop: int) -> int:
        mine = at[self.order[start:stop]]
        centre = mine.mean(axis=0)
        away = ((mine - centre) ** 2).sum(axis=1)
        radius = float(np.sqrt(away.max()))
        me = len(self.nodes)
        self.nodes.append((centre, radius, start, stop, -1, -1))
        if stop - start > LEAF and radius > 0:
            a = mine[away.argmax()]
            b = mine[((mine - a) ** 2).sum(axis=1).argmax()]
            half = (stop - start) // 2
            self.order[start:stop] = self.order[start:stop][np.argpartition(mine @ (b - a), half)]
            left, right = self._grow(at, start, start + half), self._grow(at, start + half, stop)
            self.nodes[me] = (centre, radius, start, stop, left, right)
        return me


class Best:
    """The k best (score, id) of each query so far; unused places hold ``floor``."""

    def __init__(self, floor: np.ndarray, k: int) -> None:
        self.floor = floor  # no result is below it
        self.scores = np.full((len(floor), k), LONG[0], np.int64)
        self.ids = np.full((len(floor), k), LONG[1], np.int64)
        self.used = np.zeros((len(floor), k), bool)

    def needed(self) -> np.ndarray:
        """The score that a further candidate must reach."""
        return np.where(self.used[:, -1], np.maximum(self.floor, self.scores[:, -1]), self.floor)

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        k = self.scores.shape[1]
        s = np.concatenate([self.scores[queries], scores], axis=1)
        i = np.concatenate([self.ids[queries], np.broadcast_to(ids, scores.shape)], axis=1)
        u = np.concatenate([self.used[queries], allowed], axis=1)
        order = np.lexsort((i, ~s, ~u), axis=1)[:, :k]  # ~s reverses without overflow
        self.scores[queries], self.ids[queries], self.used[queries] = (np.take_along_axis(x, order, axis=1) for x in (s, i, u))


def search(tree: BallTree, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, best: Best) -> None:
    """Best-first over the nodes for a block of queries at once."""
    if not len(ids) or not len(q):
        return
    dim = q.shape[1]
    qf = q.astype(np.float64)
    length = np.sqrt((qf**2).sum(axis=1))

    def bound(node: int, who: np.ndarray) -> np.ndarray:
        centre, radius = tree.nodes[node][:2]
        b = qf[who] @ centre + length[who] * radius
        return b + 1 + 1e-9 * (np.abs(b) + length[who] * (radius + np.sqrt(centre @ centre)))  # never below the true bound

    every = np.arange(len(q))
    first = bound(0, every)
    waiting = [(-float(first.max()), 0, every, first)]
    while waiting:
        _, node, who, b = heapq.heappop(waiting)
        go = b >= best.needed()[who]
        if not go.any():
            continue
        who = who[go]
        _, _, start, stop, left, right = tree.nodes[node]
        if left < 0:
            own = tree.order[start:stop]
            scores = products(q[who], tree.rows[own], dim)
            allowed = (scores >= best.needed()[who][:, None]) & (ids[own][None, :] != q_ids[who][:, None])
            some = allowed.any(axis=1)
            if some.any():
                best.add(who[some], scores[some], ids[own], allowed[some])
            continue
        for child in (left, right):
            b = bound(child, who)
            heapq.heappush(waiting, (-float(b.max()), child, who, b))


PACKED = "dim int, part long, ids binary, rows binary"


def packed(vectors: DataFrame, parts: int, name: str) -> DataFrame:
    """(id, v) -> one row per dimension and hash part."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = np.stack(pdf.v.to_numpy()).astype(np.int64, copy=False)
        return pd.DataFrame({"dim": [len(pdf.v.iloc[0])], "part": [pdf.part.iloc[0]], "ids": [pdf.id.to_numpy(np.int64).tobytes()], "rows": [rows.tobytes()]})

    dealt = vectors.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"))
    return written(dealt.groupBy("dim", "part").applyInPandas(pack, PACKED), name)


def _unpacked(ids: bytes, rows: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(rows, np.int64).reshape(len(i), dim)


def _visits(k: int, bounds_only: bool):
    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees: dict[tuple[int, int], tuple[BallTree, np.ndarray]] = {}
        carried: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            for x in pdf.itertuples(index=False):
                if (at := (x.dim, x.part)) not in trees:
                    trees.clear()
                    ids, rows = _unpacked(x.ids, x.rows, x.dim)
                    trees[at] = BallTree(rows), ids
                tree, ids = trees[at]
                q_ids, q = _unpacked(x.q_ids, x.q_rows, x.dim)
                floor = np.full(len(q), LONG[0]) if x.floor is None else np.frombuffer(x.floor, np.int64)
                floor = np.maximum(floor, carried.get((x.dim, x.block), LONG[0]))
                best = Best(floor, k)
                search(tree, ids, q, q_ids, best)
                if bounds_only:
                    yield pd.DataFrame({"dim": [x.dim], "block": [x.block], "q_ids": [x.q_ids], "q_rows": [x.q_rows], "floor": [best.needed().tobytes()]})
                    continue
                carried[(x.dim, x.block)] = best.needed()
                row, place = np.nonzero(best.used)
                yield pd.DataFrame({"dim": x.dim, "block": x.block, "row": row, "query_id": q_ids[row], "vec_id": best.ids[row, place], "score": best.scores[row, place]})

    return visit


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, the
    ``k`` highest inner products with rows of other ids, ties to the smaller id.

    Rows take no part where the id or the vector is null or the vector holds a component
    that is null or not finite.  Vectors meet those of their own length only.  Repeated
    rows are candidates of their own, and repeated query rows are answered each.  Other
    columns are not read.  An empty table gives an empty result.
    """
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), quantized(F.col(vector_col), scale).alias("v")).where("id is not null and v is not null")
    n, wide = clean.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    most = max(1, PACK_BYTES // (8 * max(1, wide)))
    shard_rows = min(SHARD_ROWS, most, max(512, int(8 * math.sqrt(n))))
    shards = packed(clean, max(1, -(-n // shard_rows)), "top-k-shards")
    blocks = packed(clean.where(F.col("id") % every == 0), max(1, -(-n // (every * min(BLOCK_ROWS, most)))), "top-k-queries")
    blocks = blocks.select("dim", F.col("part").alias("block"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"))
    pilot = shards.groupBy("dim").agg(F.min("part").alias("part"))
    asked = "dim int, block long, q_ids binary, q_rows binary"
    seen = blocks.join(shards.join(pilot, ["dim", "part"], "left_semi"), "dim").withColumn("floor", F.lit(None).cast("binary"))
    floors = written(seen.mapInPandas(_visits(k, True), asked + ", floor binary"), "top-k-floors")
    # the stated query set against all rows, in blocks: each shard meets each block of its dimension
    if (floors.agg(F.sum(F.length("q_rows") + F.length("q_ids"))).first()[0] or 0) <= BROADCAST_BYTES:
        # blocks go to where the shards are, once for each executor
        met = shards.join(F.broadcast(floors), "dim")
    else:
        parts = shards.groupBy("dim").agg(F.collect_list("part").alias("parts"))  # small numbers, one for each shard
        pairs = floors.join(parts, "dim").select("dim", "block", "q_ids", "q_rows", "floor", F.explode("parts").alias("part")).repartition(F.col("dim"), F.col("part"))
        met = pairs.join(shards, ["dim", "part"])
    found = met.sortWithinPartitions("dim", "part").mapInPandas(_visits(k, False), "dim int, block long, row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("dim", "block", "row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
