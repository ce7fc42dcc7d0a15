"""Exact nearest neighbours by inner product: a block matrix join with 8-bit products and error bounds.

Queries and candidates are cut into blocks by a hash of their id; every block of queries meets every block of
candidates in one task. There vectors are scaled to 8-bit integers, whose products are exact, and the norms of what
scaling lost bound the error. Only candidates whose upper bound reaches the k-th lower bound are multiplied again in
double precision. Heaps keep the best of a block, and a ranked cut merges the blocks of a query.

Defined results: vectors that are null, zero or hold nulls or non-finite values, and rows without an id, take no part.
Vectors of other lengths than the query's are not compared with it. A query's own id is no candidate, repeated or
not; repeated rows of another id are candidates each. Ties go to the smaller id. An empty table gives no rows; columns
of other names are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 8192
#: Queries multiplied at once, and the longest stretch of components whose 8-bit products add up exactly in single precision.
_AT_ONCE = 256
_STRETCH = 1024
#: Slack for rounding in the bounds themselves, as a share of the product of norms.
_SLACK = 1e-12


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite & some).select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.size(vector).alias("dim")
    )


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("id").to_numpy()
    values = table.column("v").combine_chunks()
    return ids, values.flatten().to_numpy().reshape(len(ids), -1)


def _scaled(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """8-bit integers (held as single precision for the product), their scale, norms of them scaled and of the rest."""
    scale = np.abs(m).max(axis=1) / 127
    scale[scale == 0] = 1.0  # only denormal rows
    small = np.rint(m / scale[:, None]).astype(np.int8)
    rough = small * scale[:, None]
    return small.astype(np.float32), scale, np.linalg.norm(rough, axis=1), np.linalg.norm(m - rough, axis=1)


def exact_products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, added from the first component to the last."""
    total = np.zeros(len(rows))
    for d in range(len(query)):
        total += rows[:, d] * query[d]
    return total


def tile(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """The best ``k`` candidates of this block for every query of this block."""
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    if queries.num_rows and candidates.num_rows:
        q_ids, q = _matrix(queries)
        c_ids, c = _matrix(candidates)
        (q8, q_scale, q_rough, q_rest), (c8, c_scale, c_rough, c_rest) = _scaled(q), _scaled(c)
        c_full = c_rough + c_rest
        for start in range(0, len(q), _AT_ONCE):
            part = slice(start, start + _AT_ONCE)
            products = np.zeros((len(q_ids[part]), len(c)))
            for d in range(0, q.shape[1], _STRETCH):
                products += q8[part, d : d + _STRETCH] @ c8[:, d : d + _STRETCH].T
            products *= q_scale[part, None] * c_scale
            error = q_rest[part, None] * c_full + q_rough[part, None] * c_rest
            error += _SLACK * (q_rough[part, None] + q_rest[part, None]) * c_full
            own = q_ids[part, None] == c_ids
            lower = np.where(own, -np.inf, products - error)
            upper = np.where(own, -np.inf, products + error)
            place = max(len(c) - k, 0)
            bound = np.partition(lower, place, axis=1)[:, place]
            for i, query_id in enumerate(q_ids[part]):
                left = np.nonzero((upper[i] >= bound[i]) & ~own[i])[0]
                scores = exact_products(c[left], q[start + i])
                best = heapq.nsmallest(k, zip((-scores).tolist(), c_ids[left].tolist(), strict=True))
                out["query_id"] += [query_id] * len(best)
                out["score"] += [-s for s, _ in best]
                out["vec_id"] += [c_id for _, c_id in best]
    return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding",
    query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` of each query's ``k`` nearest; ``is_query`` looks at ``id``."""
    rows = usable(vectors, key, vector)
    n, asked = rows.agg(F.count("*"), F.count(F.when(is_query, True))).first()
    down, across = -(-asked // query_block) or 1, -(-n // candidate_block) or 1

    def dealt(count: int, seed: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(count)).cast("int")

    def copies(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    queries = rows.where(is_query).select("id", "v", "dim", dealt(down, "q").alias("r")).withColumn("c", copies(across))
    candidates = rows.select("id", "v", "dim", dealt(across, "c").alias("c")).withColumn("r", copies(down))
    tiles = queries.groupBy("dim", "r", "c").cogroup(candidates.groupBy("dim", "r", "c")).applyInArrow(
        lambda a, b: tile(a, b, k), "query_id long, vec_id long, score double"
    )
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return tiles.select("query_id", best.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
