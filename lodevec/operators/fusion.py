"""Fusing rankings: reciprocal ranks, linear mixtures, several arms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodevec.functions.vectors import distance
from lodevec.operators import bm25, knn

RRF_K = 60


def reciprocal(rank: Column, weight: float = 1.0, first_rank: int = 1) -> Column:
    """weight / (60 + rank); ``rank`` counts from 1, ``first_rank`` is what the first hit counts as (0 or 1)."""
    return F.lit(weight) / (RRF_K + rank - 1 + first_rank)


def fuse_arms(arms: Sequence[tuple[DataFrame, float]], key: str = "id", rank: str = "rank", k: int | None = None, first_rank: int = 1) -> DataFrame:
    """(key, rrf_score, rank): weighted reciprocal-rank fusion; rows that an arm lacks get nothing from it."""
    parts = None
    for arm, weight in arms:
        part = arm.select(key, reciprocal(F.col(rank), weight, first_rank).alias("s"))
        parts = part if parts is None else parts.unionByName(part)
    total = parts.groupBy(key).agg(F.sum("s").alias("rrf_score"))
    if k is not None:
        total = total.orderBy(F.round("rrf_score", 12).desc(), key).limit(k)
    return total.withColumn("rank", F.row_number().over(Window.orderBy(F.round("rrf_score", 12).desc(), F.col(key))).cast("long")) if k is not None else total


def arm_depth(k: int, arms: int) -> int:
    """Rows each arm contributes to a fused top k."""
    return min(k * max(arms, 2), 1000)


def search_multimodal(
    df: DataFrame, queries: Sequence[tuple[str, Sequence[float], float]], k: int = 10, metric: str = "cosine", key: str = "id", where: Column | str | None = None
) -> DataFrame:
    """Fused top k over several vector columns; ``queries`` are (column, query vector, weight).  Result: (key, distance = -score, rank)."""
    if not queries:
        raise ValueError("at least one query is needed")
    depth = arm_depth(k, len(queries))
    arms = []
    for column, vector, weight in queries:
        hits = knn.search(df, vector, depth, metric, column, key, where=where)
        hits = hits.select(key, F.row_number().over(Window.orderBy(F.round("_distance", 12), F.col(key))).cast("long").alias("rank"))
        arms.append((hits, weight))
    fused = fuse_arms(arms, key, k=k)
    return fused.select(key, (-F.col("rrf_score")).alias("distance"), "rank")


def _pool(df: DataFrame, query: Sequence[float], text_query: str, pool: int, vector: str, text: str, key: str, metric: str, union: bool) -> DataFrame:
    near = df.where(F.col(vector).isNotNull()).withColumn("d", distance(metric, vector, query)).orderBy(F.round("d", 12), key).limit(pool).select(key, "d")
    if not union:
        lexical = bm25.scores(df, text_query, text, key, within=near)
        return near.join(F.broadcast(lexical), key, "left").select(key, "d", F.coalesce("score", F.lit(0.0)).alias("b"))
    lexical = bm25.scores(df, text_query, text, key)
    best = lexical.orderBy(F.round("score", 9).desc(), key).limit(pool).select(key)
    both = near.select(key).union(best).distinct()
    all_d = df.join(F.broadcast(both), key, "left_semi").select(key, distance(metric, vector, query).alias("d"))
    return all_d.join(lexical, key, "left").select(key, "d", F.coalesce("score", F.lit(0.0)).alias("b"))


def hybrid_rrf(
    df: DataFrame, query: Sequence[float], text_query: str, k: int = 10, weight: float = 0.5, pool: int | None = None, vector: str = "embedding",
    text: str = "text", key: str = "doc_id", metric: str = "cosine", union: bool = False,
) -> DataFrame:
    """(key, score): vector candidates ordered again by (1 - w) / (60 + vector rank) + w / (60 + text rank), ranks from 0.

    The pool of 10 k candidates comes from the vectors; with ``union`` the best texts join it.
    """
    p = _pool(df, query, text_query, pool or 10 * k, vector, text, key, metric, union)
    p = p.withColumn("vr", F.row_number().over(Window.orderBy(F.round("d", 12), F.col(key))) - 1)
    p = p.withColumn("br", F.row_number().over(Window.orderBy(F.round("b", 9).desc(), F.col(key))) - 1)
    score = (1 - weight) / (RRF_K + F.col("vr")) + weight / (RRF_K + F.col("br"))
    return p.select(key, score.alias("score")).orderBy(F.round("score", 12).desc(), key).limit(k)


def hybrid_linear(
    df: DataFrame, query: Sequence[float], text_query: str, k: int = 10, weight: float = 0.5, pool: int | None = None, vector: str = "embedding",
    text: str = "text", key: str = "doc_id", metric: str = "cosine", union: bool = False,
) -> DataFrame:
    """(key, score), lower = better: (1 - w) * scaled distance + w * (1 - scaled BM25), scaled over the pool.

    Equal distances scale to 0, equal BM25 scores to 0.5.
    """
    p = _pool(df, query, text_query, pool or 10 * k, vector, text, key, metric, union)
    facts = p.agg(F.min("d").alias("d0"), F.max("d").alias("d1"), F.min("b").alias("b0"), F.max("b").alias("b1"))
    p = p.crossJoin(F.broadcast(facts))
    vec = F.when(F.col("d1") > F.col("d0"), (F.col("d") - F.col("d0")) / (F.col("d1") - F.col("d0"))).otherwise(0.0)
    lex = F.when(F.col("b1") > F.col("b0"), (F.col("b") - F.col("b0")) / (F.col("b1") - F.col("b0"))).otherwise(0.5)
    return p.select(key, ((1 - weight) * vec + weight * (1 - lex)).alias("score")).orderBy(F.round("score", 12), key).limit(k)
