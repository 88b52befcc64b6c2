"""One ranking from several differently scaled scores.

Each arm's scores are standardised within their query by median and median absolute deviation,
squashed by the logistic function, and combined by a weighted geometric mean, so that an
arm counts by its weight, whatever its range, and an extreme score by no more than a good one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodevec.session import cut_lineage

# Bounds of the squashed values: the worst returned row still has FLOOR, one not returned MISSING.
FLOOR = 0.05
MISSING = 0.04
# A median absolute deviation times this estimates the standard deviation of a normal distribution.
MAD_SCALE = 1.4826
# Ranks of the quantile sketch are exact to 1 in 10,000; up to so many values of one query and arm it is exact.
ACCURACY = 10_000


def usable(score: Column) -> Column:
    """Null and NaN scores count as not returned."""
    return score.isNotNull() & ~F.isnan(score)


def squash(z: Column) -> Column:
    return F.lit(FLOOR) + F.lit(1 - FLOOR) / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))


def combine_scores(
    scores: DataFrame,
    weights: dict[str, float],
    query: str = "query_id",
    item: str = "row_id",
    arm: str = "arm",
    score: str = "score",
    top: int | None = None,
) -> DataFrame:
    """(query, item, combined, rank) from rows (query, item, arm, score), larger score = better.

    Of several scores of an item in an arm the best counts.  An item that an arm did not return ranks there behind
    all that it did.  An arm without any score for a query counts for none of its items; arms without a weight are
    left out, as are rows with a null query or item.  If the deviation is zero, scores other than the median count as
    far off.  Infinite scores are the best or worst.  Ties of the combined value go by the lower item.
    """
    known = scores.where(usable(F.col(score)) & F.col(arm).isin(*weights) & F.col(query).isNotNull() & F.col(item).isNotNull())
    best = cut_lineage(known.groupBy(query, arm, item).agg(F.max(F.col(score).cast("double")).alias("s")))  # read three times
    # both aggregations combine on the map side; their results have one row for each query and arm
    middle = best.groupBy(query, arm).agg(F.percentile_approx("s", 0.5, ACCURACY).alias("med"))
    away = best.join(middle, [query, arm]).withColumn("dev", F.abs(F.col("s") - F.col("med")))
    spread = away.groupBy(query, arm).agg(F.percentile_approx("dev", 0.5, ACCURACY).alias("mad"), F.first("med").alias("med"))
    z = F.when(F.col("s") == F.col("med"), 0.0).otherwise(
        F.when((F.col("mad") > 0) & (F.col("mad") < F.lit(float("inf"))), (F.col("s") - F.col("med")) / (MAD_SCALE * F.col("mad"))).otherwise(
            F.when(F.col("s") > F.col("med"), 40.0).otherwise(-40.0)
        )
    )
    values = best.join(spread, [query, arm]).select(query, item, arm, F.ln(squash(z)).alias("v"))
    wide = values.groupBy(query, item).agg(*[F.max(F.when(F.col(arm) == a, F.col("v"))).alias(f"v_{a}") for a in weights])
    present = spread.groupBy(query).agg(*[F.max((F.col(arm) == a).cast("int")).alias(f"has_{a}") for a in weights])
    wide = wide.join(present, query)
    total, weight = F.lit(0.0), F.lit(0.0)
    for a, w in weights.items():
        has = F.col(f"has_{a}") == 1
        total = total + F.when(has, F.lit(w) * F.coalesce(F.col(f"v_{a}"), F.ln(F.lit(MISSING)))).otherwise(0.0)
        weight = weight + F.when(has, F.lit(w)).otherwise(0.0)
    out = wide.select(query, item, F.exp(total / weight).alias("combined"))
    # equal but for the order of summation is equal
    order = Window.partitionBy(query).orderBy(F.round("combined", 12).desc(), F.col(item))
    out = out.withColumn("rank", F.row_number().over(order).cast("long"))
    return out if top is None else out.where(F.col("rank") <= top)


def search_scores(docs_search: DataFrame, multimodal: DataFrame) -> DataFrame:
    """All arms as (query_id, row_id, arm, score), larger = better: distances negated, fused scores by magnitude."""
    hits = docs_search.select("query_id", "row_id", "arm", (-F.col("distance").cast("double")).alias("score"))
    fused = multimodal.select("query_id", "row_id", F.lit("multimodal").alias("arm"), F.abs(F.col("rrf_score").cast("double")).alias("score"))
    return hits.unionByName(fused)
