"""Exact top-k search by inner product with vector-approximation files.

Vectors are packed, where they are read, into blocks of bounded size; no block
depends on a key. A block keeps for every vector a cell number per dimension
(``CELLS`` cells between quantiles) and for every cell the least and greatest
component. A query scans the cells: sum(max(q*low, q*high)) bounds each score
from above. Exact vectors are read in the order of these bounds until the
k-th best exact score exceeds the next bound. Blocks of queries meet all
blocks of candidates by an equi-join on a slot number; each meeting leaves at
most k rows a query.

A task builds a block's cells once and keeps, per block of queries, the k-th
best score that its blocks have shown so far, below which nothing is read.
Blocks in which every product fits 64 bits are computed in them, others in
exact Python integers; bounds get the room that their rounding may need.

Defined results: a null vector, or one with a null or non-finite component,
takes no part, nor does a null id; a component counts as non-finite where the
scaled double is. Ranks follow the exact scores; a score that the column
cannot hold is shown as the nearest one that it can. Vectors of different
length are not compared. A repeated id: every row is a candidate for other
ids, the smallest vector stands as the query, and no row of an id is a
candidate of its own id. Ties go to the smaller id. Other columns of the input
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import ship

BLOCK_ROWS, QUERY_ROWS, CELLS, STEP = 8192, 1024, 16, 256
LONG = (1 << 63) - 1
_BLOCK = "block long, dim int, wide boolean, ids binary, vectors binary"


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, q array<double>): components scale * x, to be floored; rows that take part only."""
    x = F.transform(F.col(vec_col), lambda c: F.lit(float(scale)) * c.cast("double"))
    sound = F.forall(F.col(vec_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(F.lit(float(scale)) * c.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("q"))


def _pack(most: int):
    def run(batches):
        part, count, held = TaskContext.get().partitionId(), 0, {}

        def block(dim, rows):
            nonlocal count
            count += 1
            ids, mats = zip(*rows, strict=True)
            mat = np.floor(np.concatenate(mats))
            wide = bool(mat.size) and float(np.abs(mat).max()) >= 1 << 31
            return pa.RecordBatch.from_arrays(
                [pa.array([part * (1 << 32) + count], pa.int64()), pa.array([dim], pa.int32()), pa.array([wide]), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([mat.astype(np.float64 if wide else np.int32).tobytes()], pa.binary())],
                names=["block", "dim", "wide", "ids", "vectors"],
            )

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            dims = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat, starts = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(dims) - dims
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                for a in range(0, len(rows), most):
                    r = rows[a : a + most]
                    held.setdefault(int(dim), []).append((ids[r], flat[starts[r][:, None] + np.arange(dim)]))
                    if sum(len(x) for x, _ in held[int(dim)]) >= most:
                        yield block(int(dim), held.pop(int(dim)))
        for dim, rows in held.items():
            yield block(dim, rows)

    return run


def _matrix(raw: bytes, wide: bool, rows: int, dim: int) -> np.ndarray:
    """Whole numbers as doubles, which hold them exactly."""
    return np.frombuffer(raw, np.float64 if wide else np.int32).reshape(rows, dim).astype(np.float64)


def _whole(exact: np.ndarray, narrow: bool) -> np.ndarray:
    """As 64-bit integers, or as Python's."""
    return exact.astype(np.int64) if narrow else np.array([[int(x) for x in row] for row in exact], object).reshape(exact.shape)


def _floor(score) -> float:
    """A double not above the score."""
    try:
        return float(np.nextafter(float(score), -np.inf))
    except OverflowError:
        return np.finfo(np.float64).max if score > 0 else -np.inf


class VaFile:
    """Cells of one block; low and high are the bounds of every vector's cell."""

    def __init__(self, ids: np.ndarray, exact: np.ndarray):
        self.ids, self.exact, self.most = ids, exact, float(np.abs(exact).max()) if exact.size else 0.0
        self.whole: dict[bool, np.ndarray] = {}
        edges = np.quantile(exact, np.linspace(0, 1, CELLS + 1)[1:-1], axis=0, method="lower") if len(exact) else np.zeros((CELLS - 1, exact.shape[1]))
        self.cell = np.empty(exact.shape, np.uint8)
        low = np.zeros((CELLS, exact.shape[1]))
        high = np.zeros((CELLS, exact.shape[1]))
        for d in range(exact.shape[1]):
            column = exact[:, d]
            self.cell[:, d] = np.searchsorted(edges[:, d], column, side="right")
            for c in np.unique(self.cell[:, d]):
                inside = column[self.cell[:, d] == c]
                low[c, d], high[c, d] = inside.min(), inside.max()
        columns = np.arange(exact.shape[1])
        self.low, self.high = low[self.cell, columns], high[self.cell, columns]

    def vectors(self, narrow: bool) -> np.ndarray:
        if narrow not in self.whole:
            self.whole[narrow] = _whole(self.exact, narrow)
        return self.whole[narrow]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        dim = queries.shape[1]
        with np.errstate(over="ignore", invalid="ignore"):
            out = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
            if queries.size and float(np.abs(queries).max()) * self.most * dim >= 1 << 52:
                out += np.abs(queries) @ np.maximum(np.abs(self.low), np.abs(self.high)).T * ((dim + 2) * 2.0**-51)
        return np.where(np.isnan(out), np.inf, out)

    def search(self, query: np.ndarray, bound: np.ndarray, own: int, k: int, narrow: bool, kth: float = -np.inf) -> tuple[np.ndarray, list]:
        """Ids and exact scores of the k best that reach kth; bound may be altered."""
        bound[self.ids == own] = -np.inf
        vectors, read_ids, read_scores = self.vectors(narrow), np.zeros(0, np.int64), np.zeros(0, np.int64 if narrow else object)
        todo, step = len(bound), max(STEP, 2 * k)
        while todo > 0:
            step = min(step, len(bound))
            next_ = np.argpartition(-bound, step - 1)[:step]
            next_ = next_[(bound[next_] > -np.inf) & (bound[next_] >= kth)]
            if not len(next_):
                break
            least = bound[next_].min()
            scores = vectors[next_] @ query if vectors.shape[1] else np.zeros(len(next_), read_scores.dtype)
            bound[next_] = -np.inf
            todo -= len(next_)
            read_ids, read_scores = np.concatenate([read_ids, self.ids[next_]]), np.concatenate([read_scores, scores])
            best = np.lexsort((read_ids, -read_scores))[:k] if narrow else np.array(sorted(range(len(read_ids)), key=lambda i: (-read_scores[i], read_ids[i]))[:k])
            read_ids, read_scores = read_ids[best], read_scores[best]
            if len(best) == k:
                kth = max(kth, _floor(read_scores[-1]))
            if least < kth:
                break
            step *= 2
        return read_ids, read_scores


def _beyond(score: int) -> bytes | None:
    """Orders the scores that the column cannot hold, as unsigned bytes."""
    return None if -LONG < score < LONG else (score + (1 << 4191)).to_bytes(524, "big")


def _meet(k: int):
    def run(batches):
        at, va, kth = None, None, {}
        for batch in batches:
            for dim, asked, query_wide, query_ids, queries, block, wide, ids, vectors in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if block != at:
                    at, va = block, VaFile(np.frombuffer(ids, np.int64), _matrix(vectors, wide, len(ids) // 8, dim))
                q_ids = np.frombuffer(query_ids, np.int64)
                q = _matrix(queries, query_wide, len(q_ids), dim)
                narrow = (float(np.abs(q).max()) if q.size else 0.0) * va.most * dim < 1 << 62
                whole, least = _whole(q, narrow), kth.setdefault(asked, np.full(len(q_ids), -np.inf))
                found = [[], [], [], []]
                for a in range(0, len(q), 64):
                    bounds = va.bounds(q[a : a + 64])
                    for i, own in enumerate(q_ids[a : a + 64], a):
                        best, scores = va.search(whole[i], bounds[i - a], own, k, narrow, least[i])
                        if len(best) == k:
                            least[i] = max(least[i], _floor(scores[-1]))
                        found[0].append(np.full(len(best), own))
                        found[1].append(best)
                        found[2] += scores.tolist()
                far = pa.array([_beyond(x) for x in found[2]], pa.binary()) if not narrow else pa.nulls(len(found[2]), pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x).astype(np.int64)) for x in found[:2]), pa.array([max(-LONG, min(LONG, x)) for x in found[2]], pa.int64()), far], names=["query_id", "vec_id", "score", "beyond"])

    return run


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for every query row its k best rows of vectors."""
    ship(vectors.sparkSession)
    conf = vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")
    candidates = quantised(vectors, id_col, vec_col, scale)
    asked = quantised(queries, id_col, vec_col, scale).groupBy("vec_id").agg(F.min("q").alias("q"))
    slots = max(int(conf), 1)
    blocks = candidates.mapInArrow(_pack(BLOCK_ROWS), _BLOCK).withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots)))
    # every block of queries goes once to every slot; every block of candidates lies in one
    wanted = asked.mapInArrow(_pack(QUERY_ROWS), _BLOCK).select("dim", F.col("block").alias("asked"), F.col("wide").alias("query_wide"), F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    meet = wanted.hint("shuffle_hash").join(blocks, ["slot", "dim"]).select("dim", "asked", "query_wide", "query_ids", "queries", "block", "wide", "ids", "vectors")
    part = meet.mapInArrow(_meet(k), "query_id long, vec_id long, score long, beyond binary")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("beyond").desc_nulls_last(), F.col("vec_id"))
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


TOP_K_SQL = """
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 20
"""
