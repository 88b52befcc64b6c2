"""Vector arithmetic as column builders: everything stays in the JVM, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "euclidean", "dot", "normalized_cosine")
ALIASES = {"dot_product": "dot", "dotproduct": "dot", "l2": "euclidean", "normalizedcosine": "normalized_cosine"}
MODALITIES = ("text", "image", "audio", "video")


def metric_name(name: str) -> str:
    """One of METRICS for a name or alias; an unknown one is an error."""
    n = name.strip().lower()
    n = ALIASES.get(n, n)
    if n not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(METRICS)}")
    return n


def as_column(v: Column | str | Sequence[float]) -> Column:
    """A column, a column's name, or a literal vector, as array<double>."""
    if isinstance(v, str):
        v = F.col(v)
    if isinstance(v, Column):
        return v.cast("array<double>")
    return F.array(*[F.lit(float(x)) for x in v])


def let(values: Column, body) -> Column:
    """``body(values)`` with ``values`` (a struct) computed once for each row, also where the body uses it in a lambda."""
    return F.get(F.transform(F.array(values), body), F.lit(0))


def dot(a, b) -> Column:
    """Sum of products; null when the lengths differ, or for a null vector or component."""
    return F.aggregate(F.zip_with(as_column(a), as_column(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(as_column(a), F.lit(0.0), lambda s, x: s + x * x))


def euclidean(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(as_column(a), as_column(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine(a, b) -> Column:
    """1 - cosine similarity; 1 when either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / n)


def normalized_cosine(a, b) -> Column:
    """1 - dot product, for vectors that have unit length already."""
    return 1 - dot(a, b)


def distance(metric: str, a, b) -> Column:
    """Distance by metric name, lower = nearer (the dot product is negated)."""
    m = metric_name(metric)
    if m == "cosine":
        return cosine(a, b)
    if m == "euclidean":
        return euclidean(a, b)
    if m == "dot":
        return -dot(a, b)
    return normalized_cosine(a, b)


def normalize(a) -> Column:
    """Unit length; a vector of squared length under 1e-12 is left as it is."""
    v = as_column(a)
    known = F.struct(v.alias("v"), norm(v).alias("n"))
    return let(known, lambda s: F.when(s["n"] * s["n"] < 1e-12, s["v"]).otherwise(F.transform(s["v"], lambda x: x / s["n"])))


def is_finite(a) -> Column:
    """Whether no component is null, NaN or infinite; null for a null vector."""
    inf = F.lit(float("inf"))
    return ~F.exists(as_column(a), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == inf))


def problem(a, dim: int) -> Column:
    """What is wrong with a vector: 'null', 'dimension', 'not finite', or null for nothing."""
    v = as_column(a)
    return (
        F.when(v.isNull(), F.lit("null"))
        .when(F.size(v) != dim, F.lit("dimension"))
        .when(~is_finite(v), F.lit("not finite"))
    )


def checked(a, dim: int) -> Column:
    """The vector, or an error that stops the query when it is wrong."""
    why = problem(a, dim)
    return F.when(why.isNull(), as_column(a)).otherwise(F.raise_error(F.concat(F.lit("bad vector: "), why)))


def similarity_of(metric: str, dist: Column) -> Column:
    """A distance turned round, larger = nearer."""
    m = metric_name(metric)
    return -dist if m in ("dot", "euclidean") else 1 - dist


def centroid_radius(df, vector: str, group: Sequence[str], metric: str = "euclidean"):
    """(group, n_rows, centroid, radius) of each group; vectors that are null or not finite do not count.

    Means are taken by position over two grouped aggregations, each combined before its shuffle; the radius is the largest
    distance of a member to the mean.
    """
    good = df.where(F.col(vector).isNotNull() & is_finite(vector)).withColumn("__v", as_column(vector))
    at = good.select(*group, F.posexplode("__v").alias("pos", "x")).groupBy(*group, "pos").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    means = at.groupBy(*group).agg(
        F.max("n").alias("n_rows"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid")
    )
    same = None
    right = means.select(*[F.col(g).alias(f"__{g}") for g in group], "centroid")
    for g in group:
        eq = F.col(g).eqNullSafe(F.col(f"__{g}"))
        same = eq if same is None else same & eq
    radius = good.join(right, same).groupBy(*group).agg(F.max(distance(metric, "__v", "centroid")).alias("radius"))
    return means.join(radius, list(group))
