import random

import pytest
from pyspark.sql import functions as F

from lodevec.operators import changes

SCHEMA = "arrival_no long, table_key string, id long, text string, _change_type string, _snapshot_id long, _sequence_number long"


def brute(rows):
    """Reference: replay in order of sequence, one snapshot at a time."""
    seq = {(t, s): q for _, t, _, _, _, s, q in rows if s is not None and q is not None}
    kinds = {"+i": "insert", "-d": "delete", "-u": "update_before", "+u": "update_after"}
    state, events = {}, {}
    for _, t, i, _, k, s, q in rows:
        q = q if q is not None else seq.get((t, s))
        k = (k or "").strip().lower()
        k = kinds.get(k, k.replace("-", "_").replace(" ", "_"))
        events.setdefault((q if q is not None else -1), []).append((t, i, k))
    for q in sorted(events):
        made = {(t, i) for t, i, k in events[q] if k in ("insert", "update_after")}
        for t, i, k in events[q]:
            if k == "delete" and (t, i) not in made:
                state.pop((t, i), None)
        for key in made:
            state[key] = q
    return {(t, i, q if q >= 0 else None) for (t, i), q in state.items()}


@pytest.mark.parametrize("seed", range(4))
def test_random_feeds(spark, seed):
    rng = random.Random(seed)
    rows, n = [], 0
    for q in range(1, 40):
        t = rng.choice(["a", "b"])
        for i in rng.sample(range(12), 3):
            for k in rng.choice([["insert"], ["DELETE"], ["update_before", " +U"], ["-D", "+i"], ["update-after "], ["strange"], [None]]):
                for _ in range(rng.choice([1, 1, 2])):
                    rows.append([n, t, i, f"v{q}", k, 1000 + q, q])
                    n += 1
    whole = {r[5]: n for n, r in enumerate(rows)}
    for j, r in enumerate(rows):
        if whole[r[5]] != j and rng.random() < 0.3:
            r[rng.choice([5, 6])] = None
    rng.shuffle(rows)
    got = changes.apply_changes(spark.createDataFrame([tuple(r) for r in rows], SCHEMA))
    assert {(r["table_key"], r["id"], r["_sequence_number"]) for r in got.collect()} == brute(rows)


def test_one_snapshot_with_delete_and_insert(spark):
    feed = spark.createDataFrame([(1, "t", 1, "new", "insert", 9, 5), (2, "t", 1, None, "delete", 9, 5), (3, "t", 2, None, "delete", 9, 5)], SCHEMA)
    assert [tuple(r) for r in changes.apply_changes(feed).select("id", "text").collect()] == [(1, "new")]


def test_base_empty_feed_and_null_keys(spark):
    base = spark.createDataFrame([("t", 1, "old"), ("t", 2, "old"), (None, 3, "old")], "table_key string, id long, text string")
    none = spark.createDataFrame([], SCHEMA)
    assert changes.apply_changes(none, base).count() == 3
    assert changes.apply_changes(none).count() == 0
    feed = spark.createDataFrame([(1, "t", 1, "new", "+u", 1, 1), (2, None, 3, None, "-d", 2, 2), (3, "t", None, "x", "insert", 3, 3)], SCHEMA)
    got = {(r["table_key"], r["id"], r["text"]) for r in changes.apply_changes(feed, base).collect()}
    assert got == {("t", 1, "new"), ("t", 2, "old"), ("t", None, "x")}


def test_numbers_that_cannot_be_found_and_clashing_columns(spark):
    feed = spark.createDataFrame([(1, "t", 1, "a", "insert", None, None), (2, "t", 1, "b", "insert", 7, 1), (3, "t", 2, "c", "insert", None, None)], SCHEMA)
    feed = feed.withColumn("__seq", F.lit("x")).withColumn("__kind", F.lit(1)).withColumn("extra", F.lit(2))
    got = {(r["id"], r["text"], r["_sequence_number"], r["extra"]) for r in changes.apply_changes(feed).collect()}
    assert got == {(1, "b", 1, 2), (2, "c", None, 2)}


def test_hot_key_moves_one_row_a_task(spark):
    rows = spark.range(20_000).select(
        F.col("id").alias("arrival_no"), F.lit("t").alias("table_key"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).cast("long").alias("id"), F.lit("x").alias("text"),
        F.lit("insert").alias("_change_type"), F.col("id").alias("_snapshot_id"), F.col("id").alias("_sequence_number"),
    )
    out = changes.latest_changes(rows)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("id = 1").first()["__seq"] == 19_998
