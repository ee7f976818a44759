"""Nearest neighbours by vantage-point trees, one per shard of the vectors."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicflow.session import materialize

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 1 << 15, 1 << 11, 64
"""Vectors of a tree, queries searched together, vectors below which a node is not split."""
_CHUNK = 1 << 15


def _saved(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def distances(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, from the differences themselves."""
    out = np.empty((len(queries), len(vectors)))
    step = max(1, _CHUNK // max(1, len(vectors)))
    for k in range(0, len(queries), step):
        out[k : k + step] = np.sqrt(((queries[k : k + step, None, :] - vectors[None, :, :]) ** 2).sum(axis=2))
    return out


def pair_distances(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The same for row k of both."""
    return np.sqrt(((queries - vectors) ** 2).sum(axis=1))


def may_be_within(queries: np.ndarray, vectors: np.ndarray, squares: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """(queries, vectors): false only where the distance is above the query's reach.

    Told from products of matrices; the margin is above their rounding errors, and what overflows may be within.  `squares`
    are the vectors' squared lengths.
    """
    with np.errstate(all="ignore"):
        both = (queries**2).sum(axis=1)[:, None] + squares[None, :]
        margin = 8 * (queries.shape[1] + 8) * np.finfo(np.float64).eps
        return ~(both * (1 - margin) - 2 * (queries @ vectors.T) > (reach * (1 + 1e-12))[:, None] ** 2 + 1e-290)


def build(ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """A tree over the rows: vectors in leaf order, and nodes (first, last, vantage, children, distance bounds of both).

    A node keeps its vantage point at its first place and splits the others at the median distance to it; for each half it
    remembers the least and the greatest distance.
    """
    order = np.lexsort(tuple(vectors.T[::-1]) + (ids,))  # the same tree whatever order the rows came in
    vectors = vectors.astype(np.float64)
    rng = np.random.default_rng(0)
    nodes: list[list[float]] = []

    def grow(first: int, last: int) -> int:
        number = len(nodes)
        nodes.append([first, last, -1, -1, 0, 0, 0, 0])
        if last - first <= leaf_rows:
            return number
        pick = first + int(rng.integers(last - first))
        order[first], order[pick] = order[pick], order[first]
        rest = order[first + 1 : last]
        d = distances(vectors[order[first]][None, :], vectors[rest])[0]
        sorting = np.argsort(d, kind="stable")
        order[first + 1 : last] = rest[sorting]
        d = d[sorting]
        half = len(d) // 2
        bounds = [d[0], d[half - 1], d[half], d[-1]]
        left = grow(first + 1, first + 1 + half)
        right = grow(first + 1 + half, last)
        nodes[number] = [first, last, left, right, *bounds]
        return number

    grow(0, len(order))
    return {"ids": ids[order], "vectors": vectors[order], "nodes": np.array(nodes, np.float64)}


def search(tree: dict[str, np.ndarray], query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances (queries, k) of the nearest found, ties to the smaller id; missing places are -1 and infinite.

    A half is passed over for the queries whose distance to the vantage point keeps them, by the triangle inequality, at
    least their k-th best distance / factor away from all of it.  With factor 1 nothing nearer is ever passed over; a
    larger factor passes over more.  In a leaf only distances that may be among the k best are taken exactly.
    """
    ids, vectors, nodes = tree["ids"], tree["vectors"], tree["nodes"]
    squares = (vectors**2).sum(axis=1)
    best = np.full((len(queries), k), np.inf)
    owner = np.full((len(queries), k), np.iinfo(np.int64).max)

    def offer(rows: np.ndarray, first: int, last: int, d: np.ndarray) -> None:
        number = np.broadcast_to(ids[first:last], d.shape)
        d = np.where(number == query_ids[rows, None], np.inf, d)
        all_d, all_ids = np.concatenate([best[rows], d], axis=1), np.concatenate([owner[rows], number], axis=1)
        by_id = np.argsort(all_ids, axis=1, kind="stable")
        all_d, all_ids = np.take_along_axis(all_d, by_id, 1), np.take_along_axis(all_ids, by_id, 1)
        near = np.argsort(all_d, axis=1, kind="stable")[:, :k]
        best[rows], owner[rows] = np.take_along_axis(all_d, near, 1), np.take_along_axis(all_ids, near, 1)

    def visit(number: int, rows: np.ndarray) -> None:
        first, last, left, right = nodes[number, :4].astype(int)
        if left < 0:
            near = may_be_within(queries[rows], vectors[first:last], squares[first:last], best[rows, -1])
            some = np.flatnonzero(near.any(axis=1))
            if len(some):
                i, j = np.nonzero(near[some])
                d = np.full((len(some), last - first), np.inf)
                d[i, j] = pair_distances(queries[rows[some[i]]], vectors[first + j])
                offer(rows[some], first, last, d)
            return
        d = distances(queries[rows], vectors[first : first + 1])
        near = d[:, 0] <= best[rows, -1]
        if near.any():
            offer(rows[near], first, first + 1, d[near])
        low, high = nodes[number, 4:8:2], nodes[number, 5:8:2]
        away = np.maximum(np.maximum(low - d, d - high), 0)  # to the near and the far half
        inner_first = away[:, 0] <= away[:, 1]
        for half, part in ((0, inner_first), (1, ~inner_first), (1, inner_first), (0, ~inner_first)):
            # a margin for rounding: equal distances must be seen, for their ids decide
            open_ = part & (away[:, half] * factor <= best[rows, -1] * (1 + 1e-12))
            if open_.any():
                visit((left, right)[half], rows[open_])

    if len(ids) and len(queries):
        visit(0, np.arange(len(queries)))
    return np.where(np.isfinite(best), owner, -1), best


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, dim): vectors with an id, some component that is not zero, and none null or not finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    known = known.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    return known.withColumn("dim", F.size("embedding"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest vectors but itself, nearest first, ties to the smaller id.

    vectors and queries have vec_id and embedding; score is the Euclidean distance in double precision.  The vectors are
    dealt by hash to shards of about SHARD_ROWS rows with a tree each, the queries to blocks of about BLOCK_ROWS, and each
    block searches each tree; the k best of every pair are merged.  Rows without id, null and zero vectors and such
    with null or non-finite components take no part; vectors of another length are no candidates.  Repeated rows are
    one.  A query with fewer than k candidates returns them all.
    """
    base = materialize(usable(vectors).distinct(), "vectors")
    asked = materialize(usable(queries).distinct(), "queries")
    shards = max(1, -(-base.count() // SHARD_ROWS))
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))

    def matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["embedding"].to_numpy()).astype(np.float64)

    def grown(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "shard": pdf["shard"].iloc[:1], "tree": [_saved(**build(*matrix(pdf)))]})

    def gathered(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, rows = matrix(pdf)
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "block": pdf["block"].iloc[:1], "queries": [_saved(ids=ids, rows=rows)]})

    part = lambda n: F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n)).cast("int")
    trees = materialize(base.withColumn("shard", part(shards)).groupBy("dim", "shard").applyInPandas(grown, "dim int, shard int, tree binary"), "trees")
    lots = materialize(asked.withColumn("block", part(blocks)).groupBy("dim", "block").applyInPandas(gathered, "dim int, block int, queries binary"), "blocks")

    def searched(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, lot = np.load(io.BytesIO(pdf["tree"].iloc[0])), np.load(io.BytesIO(pdf["queries"].iloc[0]))
        ids, scores = search({n: tree[n] for n in tree.files}, lot["ids"], lot["rows"], k, factor)
        found = pd.DataFrame({"query_id": np.repeat(lot["ids"], k), "vec_id": ids.ravel(), "score": scores.ravel()})
        return found[found["vec_id"] >= -1][np.isfinite(found["score"])]

    searches = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(lots, ["dim", "block"])
    found = searches.groupBy("dim", "shard", "block").applyInPandas(searched, "query_id long, vec_id long, score double")
    # a query id with two vectors, or a neighbour with two: the nearer counts
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
