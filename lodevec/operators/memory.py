"""Memories: recency, recall with recency and importance, bounded working memory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodevec.functions.vectors import distance

# Decay rates for half-lives of about a week, a month and a day.
WEEKLY, MONTHLY, DAILY = 0.099, 0.023, 0.693
EPSILON = 1.1920929e-07  # of single precision


def days_between(as_of: Column, at: Column, whole: bool) -> Column:
    """Days since ``at``, whole or fractional; null and future times give 0."""
    days = F.datediff(as_of, at).cast("double") if whole else (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(86_400_000_000.0)
    return F.greatest(F.coalesce(days, F.lit(0.0)), F.lit(0.0))


def recency_weight(as_of: Column, at: Column, rate: float = WEEKLY, whole: bool = False) -> Column:
    """exp(-rate * days)."""
    return F.exp(-F.lit(rate) * days_between(as_of, at, whole))


def decay(df: DataFrame, as_of: Column, rate: float = WEEKLY, at: str = "last_accessed_at", into: str = "recency_weight") -> DataFrame:
    """The weight of each row from whole days, as a maintenance job stores it."""
    return df.withColumn(into, recency_weight(as_of, F.col(at), rate, whole=True))


def recall_score(dist: Column, recency: Column, importance: Column) -> Column:
    """distance / max(recency * importance, epsilon): recent and important rows come first."""
    return dist / F.greatest(recency * importance, F.lit(EPSILON))


def recall(
    memories: DataFrame, query: Sequence[float], as_of: Column, k: int = 5, oversample: int = 3, rate: float = WEEKLY, metric: str = "cosine",
    vector: str = "embedding", key: str = "record_id", where: Column | str | None = None,
) -> DataFrame:
    """The k best memories: k * oversample by distance, then by the score; both spellings of the importance column are read."""
    if where is not None:
        memories = memories.where(where)
    name = next((c for c in ("importance", "importance_score") if c in memories.columns), None)
    importance = F.coalesce(F.col(name).cast("double"), F.lit(1.0)) if name else F.lit(1.0)
    near = memories.where(F.col(vector).isNotNull()).withColumn("_distance", distance(metric, vector, query)).orderBy("_distance", key).limit(k * oversample)
    weight = recency_weight(as_of, F.col("last_accessed_at"), rate)
    return near.withColumn("_score", recall_score(F.col("_distance"), weight, importance)).orderBy("_score", key).limit(k)


def working_memory(log: DataFrame, n: int, owner: Sequence[str] = ("agent_id",), order: str = "seq") -> DataFrame:
    """The last ``n`` rows of each owner: what a first-in-first-out buffer of that size holds."""
    w = Window.partitionBy(*owner).orderBy(F.col(order).desc())
    return log.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")
