"""Nearest neighbours by inner product: a block matrix join of int8 tiles with error bounds.

Vectors are dealt into tiles and queries into blocks; each (tile, block) cell is one group of
bounded size.  A cell rounds its vectors to int8, multiplies the codes, and knows from the norms of
what rounding took away how far each product can be from the true one.  Pairs whose upper bound
reaches the k-th best lower bound are computed again from the original vectors.  The cells' best
are merged by heaps, a few cells at a time, so the result is exact.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm import store

#: Cells hold about this many numbers on either side.
TILE_VALUES = 1 << 19
BLOCK_VALUES = 1 << 16
FAN_IN = 16
_EXACT_DIMS = 1024  # sums of so many products of int8 codes are exact in float32


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v, dim): vectors as doubles, without null, zero or non-finite ones."""
    v = F.col(vector_column).cast("array<double>")
    finite: Column = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return (
        vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull())
        .where(finite & F.exists("v", lambda x: x != 0))
        .groupBy("id")
        .agg(F.min("v").alias("v"))
        .select("id", "v", F.size("v").alias("dim"))
    )


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _quantise(x: np.ndarray):
    """int8 codes as float32, scale, norm of what the codes stand for, norm of the rest, norm."""
    scale = np.maximum(np.abs(x).max(axis=1) / 127, np.finfo(float).tiny)
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    kept = codes * scale[:, None]
    return codes.astype(np.float32), scale, *(np.sqrt((m * m).sum(axis=1)) for m in (kept, x - kept, x))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], _EXACT_DIMS):
        out += a[:, k : k + _EXACT_DIMS] @ b[:, k : k + _EXACT_DIMS].T
    return out


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added up in the order of the components."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def _cell(k: int):
    def search(group: pa.Table) -> pa.Table:
        dim = group["dim"][0].as_py()
        is_query = group["is_query"].to_numpy(zero_copy_only=False)
        ids, x = group["id"].to_numpy(), _matrix(group["v"], dim)
        q_ids, q, x_ids, x = ids[is_query], x[is_query], ids[~is_query], x[~is_query]
        out: tuple[list, list, list] = ([], [], [])
        if len(q) and len(x):
            xc, xs, x_kept, x_rest, x_norm = _quantise(x)
            qc, qs, q_kept, q_rest, _ = _quantise(q)
            step = max(1, (1 << 20) // len(x))
            for at in range(0, len(q), step):
                part = slice(at, at + step)
                near = _products(qc[part], xc) * qs[part, None] * xs[None, :]
                slack = q_kept[part, None] * x_rest[None, :] + q_rest[part, None] * x_norm[None, :]
                slack += 1e-6 * (np.abs(near) + slack)
                own = q_ids[part, None] == x_ids[None, :]
                low = np.where(own, -np.inf, near - slack)
                if len(x) > k:
                    bar = np.partition(low, len(x) - k, axis=1)[:, len(x) - k]
                else:
                    bar = np.full(len(low), -np.inf)
                qi, xi = np.nonzero(~own & (near + slack >= bar[:, None]))
                score = _inner(q[part][qi], x[xi])
                bounds = np.searchsorted(qi, np.arange(len(low) + 1))
                for i in range(len(low)):
                    span = slice(bounds[i], bounds[i + 1])
                    for s, x_id in heapq.nsmallest(k, zip(-score[span], x_ids[xi[span]])):
                        out[0].append(q_ids[at + i])
                        out[1].append(x_id)
                        out[2].append(-s)
        first = [pa.array(np.full(len(out[0]), group[c][0].as_py(), np.int64)) for c in ("tile", "block")]
        return pa.Table.from_arrays(
            [*first, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())],
            names=["tile", "block", "query_id", "vec_id", "score"],
        )

    return search


def _merge(k: int):
    """Merge the sorted lists of several cells."""

    def merge(group: pa.Table) -> pa.Table:
        columns = [group[c].to_numpy() for c in ("query_id", "vec_id", "score", "tile")]
        order = np.lexsort((columns[1], -columns[2], columns[3], columns[0]))
        query, vec, score, tile = (c[order] for c in columns)
        cuts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]).tolist() + [len(query)]
        out: tuple[list, list, list, list] = ([], [], [], [])
        for a, b in zip(cuts, cuts[1:]):
            edges = [a, *(a + 1 + np.flatnonzero(tile[a + 1 : b] != tile[a : b - 1])), b]
            lists = [zip(-score[i:j], vec[i:j]) for i, j in zip(edges, edges[1:])]
            for rank, (s, x) in zip(range(1, k + 1), heapq.merge(*lists)):
                out[0].append(query[a])
                out[1].append(rank)
                out[2].append(x)
                out[3].append(-s)
        first = [pa.array(np.full(len(out[0]), group[c][0].as_py(), np.int64)) for c in ("into", "block")]
        return pa.Table.from_arrays(
            [*first, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.float64())],
            names=["tile", "block", "query_id", "rank", "vec_id", "score"],
        )

    return merge


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding",
    tile_values: int = TILE_VALUES, block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """The ``k`` rows with the largest inner product for each query, nearest first.

    ``is_query`` is a condition on the column ``id``.  Columns: query_id, rank, vec_id, score.
    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows
    without an id.  Rows that repeat an id count once, with the least vector.  Vectors meet vectors
    of their own length only; a query that meets none has no rows.  Ties go to the smaller id.
    Other columns are not read.
    """
    rows = store.checkpoint(usable(vectors, id_column, vector_column).withColumn("is_query", is_query))
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_query").cast("long")).alias("q")).collect()
    results = None
    for size in sizes:
        tiles = max(1, -(-size["n"] * size["dim"] // tile_values))
        blocks = max(1, -(-size["q"] * size["dim"] // block_values))
        own = rows.where(F.col("dim") == size["dim"])
        place = F.xxhash64("id")
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        data = own.select("id", "v", "dim", F.lit(False).alias("is_query"), F.pmod(place, F.lit(tiles)).alias("tile"), every(blocks).alias("block"))
        queries = own.where("is_query").select("id", "v", "dim", "is_query", every(tiles).alias("tile"), F.pmod(place, F.lit(blocks)).alias("block"))
        cells = data.union(queries).repartition(tiles * blocks, "tile", "block") if tiles * blocks > 1 else data.union(queries)
        best = cells.groupBy("tile", "block").applyInArrow(_cell(k), "tile bigint, block bigint, query_id bigint, vec_id bigint, score double")
        while True:
            best = best.withColumn("into", F.floor(F.col("tile") / FAN_IN)).groupBy("into", "block").applyInArrow(
                _merge(k), "tile bigint, block bigint, query_id bigint, rank int, vec_id bigint, score double"
            )
            tiles = -(-tiles // FAN_IN)
            if tiles == 1:
                break
        best = best.select("query_id", "rank", "vec_id", "score")
        results = best if results is None else results.union(best)
    if results is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return results


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e, x.e) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id AND len(q.e) = len(x.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
