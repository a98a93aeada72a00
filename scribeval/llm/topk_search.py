"""Exact top-k search by inner product: columnar branch and bound.

Vectors are turned into integers by ``floor(scale * x)`` and compared by
integer inner product.  Candidates and queries are dealt into blocks of
bounded size, and each pair of blocks is one group of one task.  There the
candidates lie in vertical layout, one array per dimension.  For a query the
dimensions are taken block by block, those where the query has most mass
first.  After each block a candidate's score lies within ``partial +- sqrt(mass
of the query left * mass of the candidate left)`` (Cauchy-Schwarz); those whose
upper bound is below the k-th largest lower bound are dropped, and the
survivors are compacted before the next block.  What survives all blocks has
its exact score, so the result is exact.  The best k of each block pair are
merged by a window that keeps k rows per query and task before the shuffle.

Edge cases: null and empty vectors, vectors with null or non-finite components
and rows with a null id take no part; vectors meet only vectors of their own length;
rows that share the query's id are its own and no candidates; repeated
candidate rows are candidates each, repeated queries are answered once; ties
go to the smaller id.  Components beyond 2**20 are multiplied as Python
integers, and scores beyond 64 bits are held at the ends of that range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS_A_STEP = 8
CANDIDATES_A_BLOCK = 8192
QUERIES_A_BLOCK = 8192


def finite(vector: Column) -> Column:
    """Not null, and every component is a finite number."""
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _integers(lists, dim: int, scale: float) -> np.ndarray:
    flat = lists.combine_chunks().flatten().to_numpy().astype(np.float64)
    x = np.floor(flat * scale).reshape(-1, dim)
    if not x.size or np.abs(x).max() <= 1 << 20:
        return x
    return np.array([int(v) for v in x.ravel()], dtype=object).reshape(-1, dim)


def best(columns: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k best candidates; ``columns[d]`` holds dimension
    d of all candidates (whole numbers as doubles, exact below 2**53)."""
    order = np.argsort(-np.abs(query), kind="stable")
    left = np.concatenate([np.cumsum((query[order] ** 2)[::-1])[::-1], [0.0]])
    alive = None  # all
    partial = np.zeros(columns.shape[1])
    mass = (columns * columns).sum(axis=0)
    mine = np.flatnonzero(ids == own)
    partial[mine] = -np.inf
    for at in range(0, len(order), DIMENSIONS_A_STEP):
        dims = order[at:at + DIMENSIONS_A_STEP]
        part = columns[dims] if alive is None else columns[dims[:, None], alive[None, :]]
        partial = partial + query[dims] @ part
        mass = mass - (part * part).sum(axis=0)
        if len(partial) <= k:
            continue
        reach = np.sqrt(left[min(at + DIMENSIONS_A_STEP, len(order))] * np.maximum(mass, 0.0))
        least = np.partition(partial - reach, len(partial) - k)[len(partial) - k]
        # one whole unit of slack covers rounding of the root
        keep = partial + reach + 1.0 + 1e-9 * reach >= least
        if not keep.all():
            here = np.flatnonzero(keep)
            alive = here if alive is None else alive[here]
            partial, mass = partial[here], mass[here]
    found = np.arange(columns.shape[1]) if alive is None else alive
    some = np.isfinite(partial)
    found, partial = found[some], partial[some]
    first = np.lexsort((ids[found], -partial))[:k]
    return partial[first].astype(np.int64), ids[found[first]]


def _best_big(rows: list[list[int]], ids: np.ndarray, query: list[int], own: int, k: int):
    """The same for integers that doubles do not hold."""
    score = [(-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(r, query)))), int(i))
             for r, i in zip(rows, ids.tolist()) if i != own]
    score.sort()
    return np.array([-s for s, _ in score[:k]], np.int64), np.array([i for _, i in score[:k]], np.int64)


def _search(k: int, scale: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if left.num_rows and right.num_rows:
            dim = left["dim"][0].as_py()
            asks, holds = _integers(left["vector"], dim, scale), _integers(right["vector"], dim, scale)
            ids = right["id"].to_numpy()
            small = asks.dtype != object and holds.dtype != object and dim < 1 << 13
            columns = np.ascontiguousarray(holds.T) if small else None
            whole = None if small else [[int(v) for v in r] for r in holds.tolist()]
            for q, key, x in zip(left["id"].to_pylist(), left["key"].to_pylist(), asks):
                if small:
                    scores, found = best(columns, ids, x, q, k)
                else:
                    scores, found = _best_big(whole, ids, [int(v) for v in x.tolist()], q, k)
                out[0] += [q] * len(found)
                out[1] += [key] * len(found)
                out[2] += found.tolist()
                out[3] += scores.tolist()
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "key", "vec_id", "score"])
    return run


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of every row for which ``is_query``."""
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = vectors.where(finite(F.col(vector_col)) & F.col(id_col).isNotNull() & (F.size(vector_col) > 0)).select(
        F.col(id_col).cast("long").alias("id"), F.size(vector_col).alias("dim"),
        F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("asks"))
    n, asking = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    slots, turns = max(1, -(-n // CANDIDATES_A_BLOCK)), max(1, -(-asking // QUERIES_A_BLOCK))
    deal = F.xxhash64("id", "vector")

    def every(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    queries = rows.where("asks").select("id", "dim", "vector", deal.alias("key")).dropDuplicates(["id", "key"]).select(
        "dim", F.pmod("key", F.lit(turns)).cast("int").alias("turn"), every(slots).alias("slot"), "id", "key", "vector")
    held = rows.select("dim", F.pmod(deal, F.lit(slots)).cast("int").alias("slot"), "id", "vector").select(
        "dim", every(turns).alias("turn"), "slot", "id", "vector")
    near = queries.groupBy("dim", "slot", "turn").cogroup(held.groupBy("dim", "slot", "turn")).applyInArrow(
        _search(k, scale), "query_id long, key long, vec_id long, score long")
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
