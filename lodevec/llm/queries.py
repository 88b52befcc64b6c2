"""Queries of the training-data problems, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.llm import clusters, current, mixing, neighbours, ranking, reading, tokens
from lodevec.session import spread, table

ARMS = {"embedding": 1.0, "text": 1.0, "multimodal": 1.0}
# Curriculum of the example mixes: first steps early, research late.
SCHEDULES = {"tutorial": [(0, 1.6), (1, 0.4)], "glossary": [(0, 1.4), (1, 0.6)], "paper": [(0, 0), (0.2, 0), (0.6, 1), (1, 1.5)]}


def _groups(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "docs_ingest")
    return clusters.similarity_groups(current.current_vectors(docs), least=0.8, min_size=25, fit_on=current.usable_vectors(docs))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.neighbours_in_order(_groups(spark, d))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Size and the three most typical ids of each group."""
    return clusters.describe_groups(_groups(spark, d))


def _ranking(spark: SparkSession, d: str, top: int) -> DataFrame:
    scores = ranking.search_scores(table(spark, d, "docs_search"), table(spark, d, "multimodal_search"))
    return ranking.combine_scores(scores, ARMS, top=top)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _ranking(spark, d, 5).select("query_id", "row_id")


def p3_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The whole ranking of each query, with the combined value."""
    scores = ranking.search_scores(table(spark, d, "docs_search"), table(spark, d, "multimodal_search"))
    return ranking.combine_scores(scores, ARMS).withColumn("combined", F.round("combined", 9))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    vectors = current.current_vectors(table(spark, d, "docs_ingest"))
    return neighbours.near_pairs(neighbours.top_similar(vectors, k=5, least=0.95), 0.95)


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Whatever their similarity: the five most similar rows for each id divisible by 100, against all rows."""
    vectors = current.current_vectors(table(spark, d, "docs_ingest"))
    return neighbours.top_similar(vectors, k=5, deep_share=0.25, every=100)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(spread(table(spark, d, "documents").select("doc_id", "text"))).select("doc_id", "ids")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(spread(table(spark, d, "documents")), table(spark, d, "mix_targets"), SCHEDULES)[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(spread(table(spark, d, "documents")), table(spark, d, "mix_targets"), SCHEDULES)[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    documents = spread(table(spark, d, "documents").select("doc_id", "text", "lang"))
    apart = reading.take_apart(documents)
    model = reading.fit_levels(documents, table(spark, d, "level_labels"), apart=apart)
    return reading.reading_levels(documents, model, apart=apart)


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each level by source."""
    levels = p9_found(spark, d).join(table(spark, d, "documents").select("doc_id", mixing.source_name(F.col("source")).alias("source")), "doc_id")
    return levels.groupBy("source", "reading_level").agg(F.count(F.lit(1)).alias("n_docs"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p2_found, p2_groups, p3_found, p3_ranking, p5_found, p5_neighbours, p7_ids, p8_mix, p8_report, p9_found, p9_profile)
}

_RANKED = """
with arms as (
  select query_id, row_id, arm, -cast(distance as double) s from docs_search where arm in ('embedding', 'text')
  union all select query_id, row_id, 'multimodal', abs(cast(rrf_score as double)) from multimodal_search),
best as (select query_id, row_id, arm, max(s) s from arms where s is not null and not contains(s::varchar, 'nan')
  and query_id is not null and row_id is not null group by all),
med as (select query_id, arm, quantile_disc(s, 0.5) med from best group by all),
dev as (select query_id, arm, quantile_disc(abs(s - med), 0.5) mad, any_value(med) med from best join med using (query_id, arm) group by all),
z as (
  select *, greatest(-40.0, least(40.0, case when s = med then 0.0 when mad > 0 and mad < 'infinity'::double
    then (s - med) / (1.4826 * mad) when s > med then 40.0 else -40.0 end)) z from best join dev using (query_id, arm)),
v as (select query_id, row_id, arm, ln(0.05 + 0.95 / (1 + exp(-z))) v from z),
items as (select distinct query_id, row_id from v),
grid as (select items.query_id, items.row_id, dev.arm from items join dev using (query_id)),
c as (
  select grid.query_id, grid.row_id, exp(sum(coalesce(v, ln(0.04))) / count(*)) combined
  from grid left join v using (query_id, row_id, arm) group by all),
r as (select query_id, row_id, round(combined, 9) combined,
  row_number() over (partition by query_id order by round(combined, 12) desc, row_id) rank from c)
"""

SQL: dict[str, str] = {
    "p3_found": _RANKED + "select query_id, row_id from r where rank <= 5",
    "p3_ranking": _RANKED + "select query_id, row_id, combined, rank from r",
}
