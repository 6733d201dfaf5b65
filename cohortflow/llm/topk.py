"""Exact top-k inner products from an impact-ordered index, score at a time.

Vectors are cut into blocks by hash; a block's index holds, for each dimension, its rows ordered by value and cut into
segments of equal quantised value. A query takes the segments of all dimensions by descending impact (the largest
product a member can have) and adds the segments' bounds to its rows' accumulators. What a row has not met yet is
bounded by the best remaining segments. Work on a block stops only on proof: when every row whose upper bound reaches
the k-th best lower bound is among a small set, and these possible members are scored exactly. Each pair of a query
block and a row block is a task of bounded size; their winners are merged per query.

Rows: null vectors, vectors with null or non-finite components, and rows without id take no part. Shorter vectors count
as ending in zeros. Equal scores rank by the smaller id; a row never meets rows with its own id. Queries with fewer
rows than k return all. Empty tables give no rows. Extra columns are ignored. Components must stay below 2**22.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW_BLOCK = 8192
QUERY_BLOCK = 1024
LEVEL = 16  # width of a quantised impact
LEAST_POSSIBLE = 64
ROUNDS = 12

FOUND = "query_id long, vec_id long, score long"


class ImpactIndex:
    """Segments of one block of integer vectors."""

    def __init__(self, x: np.ndarray):
        self.x = x
        rows, docs, low, high, start, dim = len(x), [], [], [], [], []
        for d in range(x.shape[1]):
            order = np.argsort(x[:, d], kind="stable")
            value = x[order, d]
            level = value // LEVEL
            first = np.flatnonzero(np.concatenate([[True], level[1:] != level[:-1]])) if rows else np.zeros(0, np.int64)
            docs.append(order)
            low.append(value[first])
            high.append(value[np.append(first[1:], rows) - 1])
            start.append(first + d * rows)
            dim.append(np.full(len(first), d))
        self.docs = np.concatenate(docs)
        self.low, self.high, self.dim = np.concatenate(low), np.concatenate(high), np.concatenate(dim)
        self.start = np.concatenate(start)
        self.end = np.append(self.start[1:], len(self.docs))

    def search(self, q: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the ``k`` best of those not in ``own``: all proven members and few others."""
        n = len(self.x)
        weight = q[self.dim]
        use = np.flatnonzero(weight)
        upper = np.where(weight[use] > 0, weight[use] * self.high[use], weight[use] * self.low[use])
        lower = np.where(weight[use] > 0, weight[use] * self.low[use], weight[use] * self.high[use])
        order = np.argsort(-upper, kind="stable")
        use, upper, lower = use[order], upper[order], lower[order]
        size = self.end[use] - self.start[use]
        done = np.cumsum(size)
        total = int(done[-1]) if len(done) else 0
        dims = self.dim[use]
        active = len(np.unique(dims))
        top, low, met = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        free = np.ones(n, bool)
        free[own] = False
        at = 0
        for step in range(1, ROUNDS + 1):
            to = int(np.searchsorted(done, total * step / ROUNDS, "left")) + 1 if step < ROUNDS else len(use)
            to = min(to, len(use))
            if to > at:
                count = size[at:to]
                place = np.repeat(self.start[use[at:to]] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                docs = self.docs[place]
                top += np.bincount(docs, np.repeat(upper[at:to], count), n)
                low += np.bincount(docs, np.repeat(lower[at:to], count), n)
                met += np.bincount(docs, minlength=n)
                at = to
            # best and worst that a dimension still holds, for as many dimensions as a row has not met
            rest_dim, first = np.unique(dims[at:], return_index=True)
            best = np.sort(upper[at:][first])[::-1] if len(rest_dim) else np.zeros(0)
            worst = np.full(self.x.shape[1], np.inf)
            np.minimum.at(worst, dims[at:], lower[at:])
            worst = np.sort(worst[np.isfinite(worst)])
            missing = active - met
            most = top + np.concatenate([[0], np.cumsum(best)])[missing]
            least = low + np.concatenate([[0], np.cumsum(worst)])[missing]
            candidates = int(free.sum())
            if candidates <= k:
                return np.flatnonzero(free)
            bar = -np.partition(-least[free], k - 1)[k - 1]
            possible = free & (most >= bar)
            if at == len(use) or possible.sum() <= max(LEAST_POSSIBLE, n // 50):
                return np.flatnonzero(possible)
        return np.flatnonzero(free)


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = lists.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
    return out


def _search_blocks(width: int, k: int):
    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(queries) and len(rows):
            order = np.argsort(rows["vec_id"].to_numpy(), kind="stable")
            ids = rows["vec_id"].to_numpy()[order]
            index = ImpactIndex(_matrix(rows["v"], width)[order])
            for query, q in zip(queries["vec_id"].to_numpy().tolist(), _matrix(queries["v"], width), strict=True):
                own = np.arange(*np.searchsorted(ids, [query, query + 1]))
                possible = index.search(q, own, k)
                score = index.x[possible] @ q
                best = np.argsort(-score, kind="stable")[:k]  # rows are in id order
                found.append((np.full(len(best), query), ids[possible[best]], score[best]))
        cols = [np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found, strict=True) if found else [[]] * 3)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.int64())})

    return search


def integers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``(vec_id, v)``: floor of the scaled components, for the rows that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col(key).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(scale * x.cast("double"))).alias("v")
    )


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256,
    row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best rows of every query, which ``is_query`` picks by ``vec_id``."""
    rows = integers(vectors, key, vector, scale)
    queries = rows.where(is_query)
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks = max(1, -(-n // row_block))
    query_blocks = max(1, -(-queries.count() // query_block))

    def block(count: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", "v"), F.lit(count)).cast("int")

    left = queries.select("vec_id", "v", block(query_blocks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("rb"))
    right = rows.select("vec_id", "v", block(blocks).alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
    found = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(_search_blocks(width, k), FOUND)
    # k rows of each block and query, merged by sorting a few rows per query
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(ranked).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
