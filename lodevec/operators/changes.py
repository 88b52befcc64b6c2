"""Applying a stream of inserts, updates and deletes to a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INSERT, DELETE, BEFORE, AFTER = "insert", "delete", "update_before", "update_after"

# Short row-kind codes of change-log producers; the long names are matched after
# unifying case, blanks and dashes.
SHORT_CODES = {"+i": INSERT, "-d": DELETE, "-u": BEFORE, "+u": AFTER}


def change_kind(col: Column) -> Column:
    """One of the four kinds for any spelling, or null for what names no change."""
    text = F.lower(F.trim(col))
    name = F.regexp_replace(text, r"[\s\-]+", "_")
    kind = F.when(name.isin(INSERT, DELETE, BEFORE, AFTER), name)
    for code, full in SHORT_CODES.items():
        kind = kind.when(text == code, F.lit(full))
    return kind


def with_sequence(
    feed: DataFrame,
    scope: Sequence[str] = ("table_key",),
    sequence: str = "_sequence_number",
    snapshot: str = "_snapshot_id",
    into: str = "__seq",
) -> DataFrame:
    """Fill a missing sequence number from another record of the same snapshot.

    Only the records without a number are joined; the look-up side has one row for each
    snapshot (aggregated on the map side), and those with a number are passed on as they are.
    """
    known = feed.where(F.col(sequence).isNotNull())
    numbers = (
        known.where(F.col(snapshot).isNotNull())
        .groupBy(*scope, snapshot)
        .agg(F.max(sequence).alias(into))
    )
    lost = feed.where(F.col(sequence).isNull()).join(numbers, [*scope, snapshot], "left")
    return known.withColumn(into, F.col(sequence)).unionByName(lost)


def latest_changes(
    feed: DataFrame,
    keys: Sequence[str] = ("table_key", "id"),
    kind: str = "_change_type",
    sequence: str = "_sequence_number",
    snapshot: str = "_snapshot_id",
    scope: Sequence[str] = ("table_key",),
    arrival: str | None = "arrival_no",
) -> DataFrame:
    """The deciding change of every key, deletes included, with ``__seq`` and ``__kind``.

    Rank within a key: sequence number, then an image over a delete of the same
    snapshot, then the order of delivery (it only chooses among copies of one change).
    Images before an update and unknown kinds change nothing and take no part.  Records
    whose number cannot be found rank behind all numbered ones.  Spark limits each map
    task to its first row of a key before the shuffle, so one key with a third of the
    feed moves one row a task.
    """
    feed = feed.drop("__seq", "__kind", "__rank")
    # any record of a snapshot can tell its number, so the look-up comes before the filter
    feed = with_sequence(feed.withColumn("__kind", change_kind(F.col(kind))), scope, sequence, snapshot)
    feed = feed.where(F.col("__kind").isin(INSERT, DELETE, AFTER))
    order = [F.col("__seq").desc_nulls_last(), (F.col("__kind") == DELETE).asc()]
    if arrival:
        order.append(F.col(arrival).desc_nulls_last())
    ranked = feed.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__rank") == 1).drop("__rank")


def apply_changes(
    feed: DataFrame,
    base: DataFrame | None = None,
    keys: Sequence[str] = ("table_key", "id"),
    sequence: str = "_sequence_number",
    **how,
) -> DataFrame:
    """Current rows after all changes of ``feed``, merged into ``base`` if one is given.

    Keys whose deciding change is a delete are dropped; others carry the columns of the
    feed with the resolved sequence number.  Rows of ``base`` stay unless the feed
    decides their key (null keys count as values).  Columns missing on one side are null.
    An empty feed gives ``base``; an empty base with an empty feed gives no rows.  Extra columns are carried along; the
    names ``__seq``, ``__kind`` and ``__rank`` are this operator's own and dropped from the feed.
    """
    last = latest_changes(feed, keys=keys, sequence=sequence, **how)
    present = last.where(F.col("__kind") != DELETE).withColumn(sequence, F.col("__seq")).drop("__seq", "__kind")
    if base is None:
        return present
    decided = last.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = None
    for k in keys:
        eq = base[k].eqNullSafe(decided[f"__{k}"])
        same = eq if same is None else same & eq
    return base.join(decided, same, "left_anti").unionByName(present, allowMissingColumns=True)
