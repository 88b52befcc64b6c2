"""Calls from SQL: scalar functions and table functions over named tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodevec import api, __version__
from lodevec.plans.estimate import storage
from lodevec.sources.table import Table

_FUNCTIONS = {
    "vector_dot": "(a array<double>, b array<double>) returns double return aggregate(zip_with(a, b, (x, y) -> x * y), 0d, (s, x) -> s + x)",
    "vector_norm": "(a array<double>) returns double return sqrt(aggregate(a, 0d, (s, x) -> s + x * x))",
    "vector_euclidean": "(a array<double>, b array<double>) returns double return sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0d, (s, x) -> s + x))",
    "vector_cosine": (
        "(a array<double>, b array<double>) returns double return case when sqrt(aggregate(a, 0d, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0d, (s, x) -> s + x * x)) = 0 then 1d "
        "else 1 - aggregate(zip_with(a, b, (x, y) -> x * y), 0d, (s, x) -> s + x) / (sqrt(aggregate(a, 0d, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0d, (s, x) -> s + x * x))) end"
    ),
    "recency_weight": "(days double, rate double) returns double return exp(-rate * greatest(coalesce(days, 0d), 0d))",
}


@F.udtf(returnType="mode: string, vectors_bytes: bigint, index_bytes: bigint, total_bytes: bigint, reduction_factor: double, recall_at_10: string")
class StorageEstimate:
    """select * from storage_estimate('10M', 768)"""

    def eval(self, rows: str, dim: int):
        for r in storage(rows, dim):
            yield tuple(r.values())


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL; as Catalyst expressions they are inlined into the plan."""
    for name, body in _FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}{body}")
    spark.udtf.register("storage_estimate", StorageEstimate)
    spark.sql(f"create or replace temporary function lodevec_version() returns string return '{__version__}'")


def expose(spark: SparkSession, warehouse: str, name: str, view: str | None = None) -> None:
    """A table's live rows as a view: all of SQL, joins and aggregates included, works on it."""
    api.open_table(spark, warehouse, name).scan().createOrReplaceTempView(view or name.rpartition(".")[2])


def delete_where(spark: SparkSession, root: str, column: str, values: list) -> int | None:
    return Table.open(spark, root).delete_where({column: values})
