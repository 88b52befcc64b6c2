"""Nearest neighbours: exact top-k for one query, for many, with filters, re-ranking and scores.

A search is a lazy DataFrame.  Filters come before the cut to k, so a filtered search gives k rows if
k rows match.  Ties are decided by the key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodevec.functions import quant
from lodevec.functions.vectors import distance, metric_name

MAX_K = 100_000
QUERY_BLOCK = 8192
QUERY_TILE, ROW_TILE = 512, 4096
MAX_QUERIES = 1_000_000


def check_query(query: Sequence[float], dim: int | None, k: int) -> None:
    """Errors for a wrong dimension, components that are not finite, or k out of 1 .. 100,000."""
    if dim is not None and len(query) != dim:
        raise ValueError(f"the query has {len(query)} components, the column {dim}")
    if not np.isfinite(np.asarray(query, float)).all():
        raise ValueError("the query has a component that is not finite")
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be from 1 to {MAX_K}")


def search(
    df: DataFrame,
    query: Sequence[float],
    k: int = 10,
    metric: str = "cosine",
    vector: str = "embedding",
    key: str = "id",
    where: Column | str | None = None,
    partition: Column | str | None = None,
    score: Callable[[Column], Column] | Column | None = None,
    within: float | None = None,
    dim: int | None = None,
    distance_name: str = "_distance",
) -> DataFrame:
    """The k nearest rows with ``_distance``, ordered by it and then by key.

    ``partition`` and ``where`` are applied to the scan, so they prune partitions and row groups; ``within`` keeps
    distances up to a bound; ``score`` (an expression over the row and the distance column) replaces
    the distance for ranking and is given back as ``_score``.  Null vectors never match.
    """
    check_query(query, dim, k)
    for condition in (partition, where):
        if condition is not None:
            df = df.where(condition)
    out = df.where(F.col(vector).isNotNull()).withColumn(distance_name, distance(metric, vector, query))
    out = out.where(F.col(distance_name).isNotNull())
    if within is not None:
        out = out.where(F.col(distance_name) <= within)
    order = F.col(distance_name)
    if score is not None:
        out = out.withColumn("_score", score(F.col(distance_name)) if callable(score) else score)
        order = F.col("_score")
    return out.orderBy(order, F.col(key)).limit(k)


def search_reranked(df: DataFrame, query: Sequence[float], k: int = 10, factor: int = 5, metric: str = "cosine", vector: str = "embedding", key: str = "id") -> DataFrame:
    """Two stages: k * factor candidates by vectors quantised to 8 bits, then k of them by exact distance."""
    check_query(query, None, k)
    coarse = df.withColumn("__q", quant.quantize_i8(vector))
    coarse = coarse.withColumn("__d", distance(metric, quant.dequantize_i8(F.col("__q")), query)).drop("__q")
    pool = coarse.where(F.col("__d").isNotNull()).orderBy("__d", key).limit(k * factor).drop("__d")
    return pool.withColumn("_distance", distance(metric, vector, query)).orderBy("_distance", key).limit(k)


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    rows = np.flatnonzero((np.diff(offsets) == dim) & ~np.asarray(column.is_null()))
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    m = values[offsets[rows][:, None] + np.arange(dim)] if len(rows) else np.zeros((0, dim))
    ok = np.isfinite(m).all(1)
    return rows[ok], m[ok]


def _all_distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    s = q @ x.T
    if metric == "dot":
        return -s
    if metric == "normalized_cosine":
        return 1 - s
    if metric == "euclidean":
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * s, 0))
    n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
    return np.where(n == 0, 1.0, 1 - s / np.where(n == 0, 1, n))


def _keep(d: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of each line, and what is tied with the k-th, so that the key can decide."""
    if d.shape[1] <= k:
        return d, keys
    kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    width = int((d <= kth + 1e-12).sum(1).max())
    if width >= d.shape[1]:
        return d, keys
    j = np.argpartition(d, width - 1, axis=1)[:, :width]
    return np.take_along_axis(d, j, 1), np.take_along_axis(keys, j, 1)


def search_batch(
    df: DataFrame,
    queries: DataFrame,
    k: int = 10,
    metric: str = "cosine",
    vector: str = "embedding",
    key: str = "id",
    query_key: str = "query_id",
    query_vector: str = "embedding",
    exclude_same_key: bool = False,
) -> DataFrame:
    """(query key, key, distance, rank): the k nearest rows for each of a stated set of queries.

    The rows are read once for every block of 8,192 queries; each task holds a block, multiplies it with its own
    rows batch by batch, and keeps k rows a query, so what is shuffled is k rows a query and task.  More than a
    million queries fail: those are a join of two tables, for an index.  Numbers are in double precision.
    """
    metric = metric_name(metric)
    rows = queries.select(F.col(query_key).cast("long").alias("q"), F.col(query_vector).cast("array<double>").alias("v")).where("q is not null and v is not null")
    rows = rows.orderBy("q").limit(MAX_QUERIES + 1).toPandas()
    if len(rows) > MAX_QUERIES:
        raise ValueError("too many queries for a batch; use an index")
    found = None
    data = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    for a in range(0, max(len(rows), 1), QUERY_BLOCK):
        block = rows.iloc[a : a + QUERY_BLOCK]
        ids = block["q"].to_numpy(np.int64)
        q = np.stack(block["v"].to_numpy()) if len(block) else np.zeros((0, 1))

        def near(batches: Iterator[pa.RecordBatch], ids=ids, q=q) -> Iterator[pa.RecordBatch]:
            # tiles of queries and rows bound what is held beside the best k of each query
            tiles = [slice(t, t + QUERY_TILE) for t in range(0, len(ids), QUERY_TILE)]
            best = [(np.full((len(ids[t]), 0), np.inf), np.zeros((len(ids[t]), 0), np.int64)) for t in tiles]
            for b in batches:
                at, x = _matrix(b.column(1), q.shape[1])
                all_keys = b.column(0).to_numpy()[at]
                for r in range(0, len(at), ROW_TILE):
                    keys = all_keys[r : r + ROW_TILE]
                    for n, t in enumerate(tiles):
                        d = _all_distances(metric, q[t], x[r : r + ROW_TILE])
                        if exclude_same_key:
                            d = np.where(ids[t][:, None] == keys[None, :], np.inf, d)
                        best[n] = _keep(np.concatenate([best[n][0], d], 1), np.concatenate([best[n][1], np.broadcast_to(keys, d.shape)], 1), k)
            for t, (best_d, best_k) in zip(tiles, best):
                ok = np.isfinite(best_d)
                i = np.broadcast_to(ids[t][:, None], best_d.shape)
                yield pa.RecordBatch.from_arrays([pa.array(i[ok]), pa.array(best_k[ok]), pa.array(best_d[ok])], ["q", "key", "d"])

        part = data.mapInArrow(near, "q long, key long, d double")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("q").orderBy(F.round("d", 12), "key")
    found = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    return found.select(F.col("q").alias(query_key), F.col("key").alias(key), F.col("d").alias("distance"), "rank")


def fetch_rows(hits: DataFrame, rows: DataFrame, key: str = "id", rank: str = "rank") -> DataFrame:
    """Hits joined back to full rows in the order of their rank; hits without a row are left out."""
    return rows.join(hits, key).orderBy(rank)


def label_vote(neighbours: DataFrame, labels: DataFrame, query_key: str = "query_id", key: str = "id", label: str = "label") -> DataFrame:
    """(query key, label, votes): the most frequent label among a query's neighbours, ties to the lower label."""
    votes = neighbours.join(labels.select(key, label), key).groupBy(query_key, label).agg(F.count(F.lit(1)).alias("votes"))
    w = Window.partitionBy(query_key).orderBy(F.desc("votes"), F.col(label))
    return votes.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
