import random
import threading

import pytest
from pyspark.sql import functions as F

from lodevec import api
from lodevec.sources.log import CommitConflict, Log
from lodevec.sources.table import FILE, POSITION, ROW_ID, Table, VectorColumn
from lodevec.streaming import stream

SCHEMA = "id long, text string, embedding array<float>"


def frame(spark, *rows):
    return spark.createDataFrame([(i, t, [float(i), 1.0]) for i, t in rows], SCHEMA)


@pytest.fixture
def table(spark, tmp_path):
    return Table.create(spark, str(tmp_path / "t"), SCHEMA, vectors=[VectorColumn("embedding", 2)])


def content(df):
    return sorted((r["id"], r["text"]) for r in df.collect())


def test_life(spark, table):
    assert table.scan().count() == 0 and table.info().first()["files"] == 0
    a = table.append(frame(spark, (1, "hello"), (2, "world")))
    b = table.append(frame(spark, (3, None)))
    assert content(table.scan(a)) == [(1, "hello"), (2, "world")] and table.scan(b).count() == 3
    assert table.append(frame(spark)) == b
    with pytest.raises(FileExistsError):
        Table.create(spark, table.root, SCHEMA)
    with pytest.raises(ValueError):
        table.scan(snapshot_id=5)
    with pytest.raises(Exception, match="bad vector"):
        table.append(spark.createDataFrame([(1, "x", [1.0])], SCHEMA))
    with pytest.raises(Exception, match="bad vector"):
        table.append(spark.createDataFrame([(1, "x", [float("nan"), 1.0])], SCHEMA))
    with pytest.raises(ValueError):
        table.append(frame(spark, (1, "x")).withColumn("extra", F.lit(1)))
    assert table.scan().count() == 3 and table.snapshots().count() == 2
    table.drop()
    with pytest.raises(FileNotFoundError):
        Table.open(spark, table.root)


def test_batch_ids(spark, table):
    a = table.append(frame(spark, (1, "x")), batch_id="b")
    assert table.append(frame(spark, (1, "x")), batch_id="b") == a
    table.append(frame(spark, (2, "y")), batch_id="c")
    table.compact(min_files=2)
    table.append(frame(spark, (1, "x")), batch_id="b")
    assert table.scan().count() == 2


def test_deletes_only_reach_back(spark, table):
    table.append(frame(spark, (1, "a"), (2, "b"), (3, None)))
    table.delete_where({"id": [1, 2]})
    table.append(frame(spark, (1, "again")))
    assert content(table.scan()) == [(1, "again"), (3, None)]
    table.delete_where({"id": [1, 3], "text": ["other", None]})
    assert table.scan().count() == 2  # all columns must agree, and null agrees with nothing
    file = table.scan(with_identity=True).where("id = 1").first()
    table.delete_rows(file[FILE].split("/")[-1], [file[POSITION]])
    assert content(table.scan()) == [(3, None)]
    table.compact(min_files=2)
    assert content(table.scan()) == [(3, None)]
    with pytest.raises(ValueError):
        table.delete_rows("nothing", [0])
    table.delete_where({"id": [3]})
    assert table.scan().count() == 0 and table.compact(min_files=1) is not None


def test_many_deletes_are_one_join(spark, table):
    for i in range(4):
        table.append(frame(spark, (1, f"a{i}"), (2, f"b{i}"), (i + 10, "c")))
        table.delete_where({"id": [1]})
    table.delete_where({"text": ["b0"]})
    assert content(table.scan()) == [(2, "b1"), (2, "b2"), (2, "b3"), (10, "c"), (11, "c"), (12, "c"), (13, "c")]
    plan = table.scan()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 2
    table.compact(min_files=1)
    assert table._snapshot()["equality"] == [] and table.scan().count() == 7


def test_rewrites_keep_rows_and_ids(spark, table):
    for i in range(5):
        table.append(frame(spark, (i, f"t{i}"), (i + 10, "x")))
    table.delete_where({"text": ["t3"]})
    before = {(r["id"], r[ROW_ID]) for r in table.scan(with_identity=True).collect()}
    s = table.meta["current"]
    table.compact(min_files=2)
    assert {(r["id"], r[ROW_ID]) for r in table.scan(with_identity=True).collect()} == before
    assert table.files().count() < 6 and table.read_changes(s).count() == 0
    assert table.scan(s).count() == 9


def test_kinds_of_compaction(spark, table):
    table.append(frame(spark, *[(i, "big") for i in range(50)]).coalesce(1))
    for i in range(23):
        table.append(frame(spark, (100 + i, "x")).coalesce(1))
    before = content(table.scan())
    big = table.files().where("record_count = 50").first()["path"]
    table.compact(min_files=2, max_files=None, dominant=0.4)
    assert table.files().count() == 2 and table.files().where(F.col("path") == big).count() == 1 and content(table.scan()) == before
    table.compact(min_files=2, max_files=None, deferred=True)
    assert table.files().count() == 1 and table.info().first()["indexing"] == 1 and content(table.scan()) == before
    table.index_files()
    assert table.info().first()["indexing"] == 0 and content(table.scan()) == before


def test_schema_evolution(spark, table):
    table.append(frame(spark, (1, "old")))
    table.evolve(rename={"text": "body"}, add={"lang": ("string", "en"), "n": ("int", None)})
    table.append(spark.createDataFrame([(2, "new", [1.0, 1.0], "de", 5)], "id long, body string, embedding array<float>, lang string, n int"))
    assert sorted((r["id"], r["body"], r["lang"], r["n"]) for r in table.scan().collect()) == [(1, "old", "en", None), (2, "new", "de", 5)]
    table.evolve(add={"text": ("string", "fresh")})  # the old name again is another field
    assert {r["text"] for r in table.scan().collect()} == {"fresh"}
    table.compact(min_files=2)
    assert sorted((r["id"], r["body"], r["text"]) for r in table.scan().collect()) == [(1, "old", "fresh"), (2, "new", "fresh")]
    for bad in (dict(rename={"none": "x"}), dict(rename={"id": "body"}), dict(add={"id": ("int", 1)})):
        with pytest.raises(ValueError):
            table.evolve(**bad)


@pytest.mark.parametrize("seed", range(2))
def test_changes_lead_from_start_to_end(spark, table, seed):
    rng = random.Random(seed)
    snaps = [table.append(frame(spark, *[(i, "v0") for i in range(8)]))]
    for step in range(5):
        what = rng.choice(["append", "where", "rows", "update", "compact"])
        ids = rng.sample(range(12), 3)
        if what == "append":
            table.append(frame(spark, *[(i, f"s{step}") for i in ids]))
        elif what == "where":
            table.delete_where({"id": ids})
        elif what == "update":
            table.delete_where({"id": ids})
            table.append(frame(spark, *[(i, f"u{step}") for i in ids]))
        elif what == "rows":
            table.delete_positions(table.scan(with_identity=True).orderBy("id").limit(2))
        else:
            table.compact(min_files=2)
        snaps.append(table.meta["current"])
    for a in (0, 2):
        for key in ((), ("id",)):
            feed = table.read_changes(snaps[a], snaps[-1], key=key).collect()
            have = content(table.scan(snaps[a]))
            for r in feed:
                if r["_change_type"] in ("delete", "update_before"):
                    have.remove((r["id"], r["text"]))
            for r in feed:
                if r["_change_type"] in ("insert", "update_after"):
                    have.append((r["id"], r["text"]))
            assert sorted(have) == content(table.scan(snaps[-1]))
    assert table.read_changes(snaps[-1], snaps[-1]).count() == 0


def test_changes_read_only_what_differs(spark, table):
    snaps = [table.append(frame(spark, *[(10 * i + j, f"t{i}") for j in range(3)]).coalesce(1)) for i in range(4)]
    files = {r[FILE]: r["id"] for r in table.scan(with_identity=True).collect()}
    assert len(files) == 4
    read = lambda df: {f.split("/")[-1] for f in df.inputFiles() if "/data/" in f}
    feed = table.read_changes(snaps[2], snaps[3])
    assert len(read(feed)) == 1 and feed.count() == 3
    table.delete_rows([f for f, i in files.items() if i // 10 == 1][0], [0])
    feed = table.read_changes()
    assert len(read(feed)) == 1 and [r["_change_type"] for r in feed.collect()] == ["delete"]
    table.delete_where({"text": ["t0"]})
    table.append(frame(spark, (99, "new")))
    kinds = sorted((r["_change_type"], r["id"]) for r in table.read_changes(snaps[3]).collect())
    assert kinds == [("delete", 0), ("delete", 1), ("delete", 2), ("delete", 10), ("insert", 99)]


def test_footers_and_many_manifests(spark, table):
    for i in range(20):
        table.append(frame(spark, (i, None if i % 2 else f"t{i:02d}")))
    assert len(table._snapshot()["manifests"]) <= 17 and table.scan().count() == 20
    stats = table.column_stats().groupBy("column").agg(F.sum("values"), F.sum("nulls"), F.min("least"), F.max("greatest")).collect()
    by = {r[0]: tuple(r)[1:] for r in stats}
    assert by["text"] == (10, 10, "t00", "t18") and by["id"][:2] == (20, 0) and "embedding" not in by


def test_change_feed_errors_and_null_keys(spark, table):
    with pytest.raises(ValueError):
        table.read_changes()
    a = table.append(spark.createDataFrame([(None, "x", [1.0, 1.0]), (1, "p|q", [1.0, 1.0])], SCHEMA))
    with pytest.raises(ValueError):
        table.read_changes()
    table.delete_positions(table.scan(with_identity=True))
    b = table.append(spark.createDataFrame([(None, "y", [1.0, 1.0]), (1, "z", [1.0, 1.0])], SCHEMA))
    kinds = sorted((r["_change_type"], r["text"]) for r in table.read_changes(a, b, key=["id"]).collect())
    assert kinds == [("delete", "x"), ("insert", "y"), ("update_after", "z"), ("update_before", "p|q")]


def test_concurrent_appends(spark, table):
    errors = []

    def add(i):
        try:
            Table.open(spark, table.root).append(frame(spark, (i, "c")))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=add, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    got = table.scan(with_identity=True).collect()
    assert len(got) == 6 == len({r[ROW_ID] for r in got})


def test_log_never_overwrites(spark, tmp_path):
    log = Log(spark, str(tmp_path / "l"))
    log.create(1, {"a": 1})
    with pytest.raises(CommitConflict):
        log.create(1, {"a": 2})
    assert log.read() == (1, {"a": 1})


def test_rewrite_meets_a_delete(spark, table):
    table.append(frame(spark, (1, "a"), (2, "b")))

    def change(df):
        Table.open(spark, table.root).delete_where({"id": [1]})
        return df

    with pytest.raises(RuntimeError):
        table.rewrite(change)
    assert content(table.scan()) == [(2, "b")]


def test_partitions_and_stats(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "p"), "id long, agent string", partition_by=["agent"])
    t.append(spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)] + [(99, None)], "id long, agent string"))
    stats = {r["partition_value"]: r["rows"] for r in t.partition_stats().collect()}
    assert stats == {"a": 5, "b": 5, "": 1}
    assert {r["agent"] for r in t.scan(partition="a").collect()} == {"a"}
    cols = {(r["column"], r["least"]) for r in t.column_stats().collect()}
    assert ("agent", "a") in cols


def test_vector_maintenance(spark, table):
    table.append(frame(spark, (1, "a"), (2, "bb")), deferred=True)
    assert table.info().first()["indexing"] > 0
    table.index_files()
    assert table.info().first()["indexing"] == 0 and table.files().where("centroid is null").count() == 0
    size = lambda c: F.array(F.length(c).cast("float"), F.lit(0.0).cast("float"))
    table.add_vector_column(VectorColumn("second", 2))
    table.backfill("second", size, "text")
    first = table.meta["current"]
    assert table.backfill("second", size, "text") == first
    assert sorted(r["second"][0] for r in table.scan().collect()) == [1.0, 2.0]
    table.migrate(size, "text", VectorColumn("embedding", 2, model="len@v1"))
    assert sorted(r["embedding"][0] for r in table.scan().collect()) == [1.0, 2.0]
    assert table.meta["vectors"][0]["model"] == "len@v1"


def test_api(spark, table, tmp_path):
    table.append(frame(spark, (1, "rust is fast"), (2, "python too"), (5, "rust and python")))
    assert [r["id"] for r in api.search(table, [1.0, 1.0], 1).to_list()] == [1]
    assert api.search(table, [1.0, 1.0], 3).limit(2).to_df().count() == 2
    assert set(api.search(table, [1.0, 1.0], 1, with_data=False).to_pandas().columns) == {"row_id", "distance", "file_path"}
    assert [r["id"] for r in api.search_text(table, "rust", ["text"], 5).to_list()][0] in (1, 5)
    assert api.hybrid_search(table, [1.0, 1.0], "python", "text", 2).to_df().count() == 2
    assert api.search_multimodal(table, [("embedding", [1.0, 1.0], 1.0)], 2).to_df().count() == 2
    with pytest.raises(ValueError):
        api.search(table, [1.0], 1)
    same = lambda n: [r["id"] for r in api.search(table, [1.0, 1.0], n).to_list()]
    table.delete_where({"id": [1]})
    assert 1 not in same(3)
    assert api.table_root("/w", "docs") == "/w/default/docs" and api.table_root("/w", "a.docs") == "/w/a/docs"
    agent = api.Agent(api.Agent.create_table(spark, str(tmp_path / "agent"), 2), "a", lambda x: [float(len(x)), 1.0])
    agent.remember("hello", 2.0)
    agent.log_tool_call("grep", "{}", "{}", "failure")
    got = agent.recall("hello", 1).first()
    assert got["text"] == "hello" and got["importance"] == 1.0 and "<context>" in agent.assemble_context("hello")
    with pytest.raises(ValueError):
        agent.log_tool_call("x", "", "", "maybe")
    buffer = api.WorkingMemoryBuffer(9)
    buffer.push("kept", [1.0, 1.0])
    buffer.drain_to_table(table)
    assert not buffer.entries and "kept" in {r["text"] for r in table.scan().collect()}
    assert api.check_model(table, "embedding", 2, "any@v1") is None
    with pytest.raises(ValueError):
        api.check_model(table, "embedding", 3)
    api.decay_memories(agent.table, F.current_timestamp())
    assert agent.table.scan().where("recency_weight = 1").count() == 2


def test_stream_sink_is_idempotent(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "s"), "id long, text string")
    src = str(tmp_path / "in")
    spark.range(10).selectExpr("id", "cast(id as string) text").write.parquet(src)

    def run(checkpoint):
        s = spark.readStream.schema("id long, text string").parquet(src)
        stream.table_sink(s, t, "job", str(tmp_path / checkpoint), {"availableNow": True}, required=["id"]).start().awaitTermination()

    run("c1")
    run("c1")
    run("c2")  # the checkpoint is lost: the same batch comes again
    assert t.scan().count() == 10
    spark.range(10, 15).selectExpr("id", "cast(id as string) text").write.mode("append").parquet(src)
    run("c1")
    assert t.scan().count() == 15
    seen = []
    for _ in range(2):
        q = stream.follow_changes(spark, t, lambda df, n: seen.append((n, df.count())), str(tmp_path / "c3")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sum(n for _, n in seen) == 15
    t.append(spark.createDataFrame([(99, "x")], "id long, text string"))
    stream.follow_changes(spark, t, lambda df, n: seen.append((n, df.count())), str(tmp_path / "c3")).trigger(availableNow=True).start().awaitTermination()
    assert seen[-1][1] == 1
    assert stream.wait_for_snapshot(t, 0, 1) and not stream.wait_for_snapshot(t, 10**6, 0.1, 0.05)


def test_buffer(spark, table):
    now = [0.0]
    b = stream.MicroBatchBuffer(table, max_rows=3, clock=lambda: now[0])
    assert b.insert([(1, "a", [1.0, 1.0])]) is None
    assert b.insert([(2, "a", [1.0, 1.0]), (3, "a", [1.0, 1.0])]) is not None
    b.insert([(4, "a", [1.0, 1.0])])
    now[0] = 31.0
    assert b.flush_if_due() is not None and table.scan().count() == 4
    b.insert([(5, "a", [1.0])])
    with pytest.raises(Exception):
        b.flush()
    assert len(b.rows) == 1


def test_states_come_after_their_rows(spark, table, tmp_path):
    other = Table.create(spark, str(tmp_path / "o"), "id long")
    record = lambda s, **d: {"type": "RECORD", "stream": s, "data": d}
    messages = [record("a", id=1, text="x", embedding=[1.0, 1.0]), record("b", id=5), record("none", id=9), {"type": "STATE", "n": 1}, record("b", id=6), {"type": "LOG"}]
    seen = []
    for m in stream.deliver(messages, {"a": table, "b": other}):
        seen.append((m["n"], table.scan().count(), other.scan().count()))
    assert seen == [(1, 1, 1)] and other.scan().count() == 2


def test_heal(spark, table):
    table.append(frame(spark, (1, "a"), (2, "b")), deferred=True)
    with pytest.raises(ValueError):
        api.build_index(table, "ivf_pq", pq_m=7)
    assert api.heal(table) == ["geometry", "index of embedding"] and api.heal(table) == []
    assert api.index_status(table).first()["status"] == "ready"
