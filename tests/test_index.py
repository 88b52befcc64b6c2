"""Indexes of a table against full comparison."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodevec import api
from lodevec.sources import index
from lodevec.sources.table import Table, VectorColumn

SCHEMA = "id long, kind string, embedding array<float>"


def rows(spark, n, first=0, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, 16))
    x = centres[rng.integers(0, 8, n)] + rng.normal(size=(n, 16)) * 0.5
    return spark.createDataFrame([(first + i, "ab"[i % 2], [float(a) for a in v]) for i, v in enumerate(x)], SCHEMA), x


@pytest.fixture
def table(spark, tmp_path):
    return Table.create(spark, str(tmp_path / "t"), SCHEMA, vectors=[VectorColumn("embedding", 16)])


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.mark.parametrize("kind,how", [("ivf_pq", {"nlist": 8, "pq_m": 8}), ("ivf_pq", {"nlist": 8, "pq_m": 8, "residual": True}), ("graph", {"shard_rows": 300})])
def test_indexed_search_through_a_tables_life(spark, table, kind, how):
    df, x = rows(spark, 700)
    table.append(df)
    queries = [[float(v) for v in x[i]] for i in (0, 99)]
    both = lambda q, **w: (ids(api.search(table, q, 10, nprobe=8, **w).to_df()), ids(api.search(table, q, 10, exact=True, **w).to_df()))
    state = index.build_index(table, kind, **how)
    assert state["status"] == "ready" and api.index_status(table).first()["files_flat"] == 0
    for q in queries:
        got, want = both(q)
        assert len(set(got) & set(want)) >= 9
    # rows deleted, added, rewritten
    table.delete_where({"id": ids(api.search(table, queries[0], 40, exact=True).to_df())})
    table.append(rows(spark, 30, 1000, 2)[0])
    report = api.index_status(table).first()
    assert report["files_flat"] > 0 and report["reason"] == "files came after the index"
    for w in ({}, {"where": F.col("id") >= 1000}):
        got, want = both(queries[0], **w)
        assert len(got) == 10 and len(set(got) & set(want)) >= 9
    table.compact(min_files=2)
    index.build_index(table, kind, **({} if kind == "ivf_pq" else how))
    report = api.index_status(table).first()
    assert report["files_flat"] == 0 and report["reason"] is None
    got, want = both(queries[1])
    assert len(set(got) & set(want)) >= 9


def test_no_index_and_a_failed_one(spark, table):
    df, x = rows(spark, 50)
    q = [float(v) for v in x[3]]
    assert index.search(table, q) is None and api.index_status(table).first()["reason"] == "no index was built"
    with pytest.raises(ValueError):
        index.build_index(table, "what")
    table.append(df)
    with pytest.raises(ValueError):
        index.build_index(table, "ivf_pq", pq_m=5)  # does not divide 16
    report = api.index_status(table).first()
    assert report["status"] == "failed" and "divide" in report["error"] and report["reason"] == "the index failed"
    assert ids(api.search(table, q, 1).to_df()) == [3]
    assert index.build_index(table, "auto")["kind"] == "exact" and ids(api.search(table, q, 1).to_df()) == [3]
    assert api.append(table, rows(spark, 5, 100)[0]) is not None and table.scan().count() == 55
    with pytest.raises(ValueError):
        index.build_index(table, "graph", "nothing")


def test_session(spark, table):
    df, x = rows(spark, 60)
    table.append(df)
    table.delete_where({"id": [4]})
    with api.SearchSession(table, where="kind = 'a'") as session:
        table.append(rows(spark, 5, 100)[0])
        assert session.rows.count() == 29
        assert ids(session.search([float(v) for v in x[6]], 1)) == [6]
        q = df.where("id in (2, 8)").select(F.col("id").alias("query_id"), "embedding")
        hits = session.search_batch(q, 1).join(session.rows, "_row_id").collect()
        assert {(r["query_id"], r["id"]) for r in hits} == {(2, 2), (8, 8)}


def test_text_index_through_a_tables_life(spark, tmp_path):
    from lodevec.sources import textindex

    t = Table.create(spark, str(tmp_path / "x"), "id long, title string, text string", properties={"text.columns": "title,text"})
    docs = [(1, "rust", "fast and safe"), (2, None, "python is slow and safe"), (3, "go", None), (4, "rust book", "rust rust python"), (5, "", "")]
    t.append(spark.createDataFrame(docs, "id long, title string, text string"))
    find = lambda q, k=10: [(r["id"], round(r["_distance"], 6)) for r in api.search_text(t, q, ["title", "text"], k).to_list()]
    full = {q: find(q) for q in ("rust", "python safe", "go go", "nothing", "")}
    assert textindex.search(t, "rust") is None
    textindex.build_text_index(t)
    assert {q: find(q) for q in full} == full and [i for i, _ in full["rust"]] == [4, 1]
    assert textindex.search(t, "rust") is not None
    t.append(spark.createDataFrame([(6, "rust", "late")], "id long, title string, text string"))
    assert textindex.search(t, "rust") is None and {i for i, _ in find("rust")} == {1, 4, 6}
    textindex.build_text_index(t)
    assert textindex.search(t, "rust") is not None and {i for i, _ in find("rust")} == {1, 4, 6}
    t.delete_where({"id": [4]})
    assert {i for i, _ in find("rust", 2)} == {1, 6}
    assert {r["path"] for r in textindex.may_hold(t, "late").collect()} <= {r["path"] for r in t.files().collect()}
    stems = textindex.build_text_index(t, ["text"], "english")
    assert stems["tokenizer"] == "english" and len(stems["parts"]) == 1
    assert [r["id"] for r in api.search_text(t, "slowing", ["text"], 5).to_list()] == [2]
    for bad in (dict(columns=["text"], tokenizer="none"), dict(columns=[])):
        with pytest.raises(ValueError):
            textindex.build_text_index(Table.create(spark, str(tmp_path / f"y{len(bad)}"), "id long, text string"), **bad)
