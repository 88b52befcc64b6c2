"""Neighbour search and grouping against brute force on small fixtures."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodevec.llm import clusters, current, neighbours, queries

SCHEMA = "id long, text string, embedding array<float>, topic_id int, doc_source string, file_path string, ingested_at timestamp"


def frame(spark, rows):
    return spark.createDataFrame([(i, None, v, None, None, None, t) for i, v, t in rows], SCHEMA)


def packed(spark, x, ids=None, parts=4):
    ids = np.arange(len(x)) if ids is None else ids
    rows = [(int(i), bytes(b)) for i, b in zip(ids, current.pack(np.asarray(x, np.float32)))]
    return spark.createDataFrame(rows, "id long, vec binary").repartition(parts)


def at(day):
    return dt.datetime(2025, 1, day, tzinfo=dt.timezone.utc)


def test_current_vectors(spark):
    good, other = [0.5] * 64, [0.25] * 63 + [1.0]
    rows = [
        (1, good, at(2)), (1, other, at(1)), (1, good, at(2)), (2, good, at(1)), (2, None, at(3)), (3, [1.0] * 63, at(1)), (4, [0.0] * 64, at(1)), (5, [float("nan")] + [1.0] * 63, at(1)),
        (6, [float("inf")] + [1.0] * 63, None), (7, other, None), (8, [None] + [1.0] * 63, at(1)), (9, [], at(1)), (None, good, at(1)), (10, [0.1] * 64, at(1)), (11, [1e30] * 64, at(1)),
    ]
    got = {r["id"]: bytes(r["vec"]) for r in current.current_vectors(frame(spark, rows)).collect()}
    assert got.keys() == {1, 7, 10, 11}
    assert np.allclose(np.frombuffer(got[1], np.float16), 0.5) and len(got[1]) == 128 and len(got[10]) == len(got[11]) == 256
    clash = frame(spark, rows).withColumn("vec", F.lit(1)).withColumn("rn", F.lit(2)).withColumn("at", F.lit("x"))
    assert current.current_vectors(clash).count() == 4
    assert current.current_vectors(frame(spark, [])).count() == 0


def test_pack_and_unpack():
    x = np.random.default_rng(1).normal(size=(50, 64)).astype(np.float32)
    x[::2] = x[::2].astype(np.float16)
    col = pa.array(list(current.pack(x)), pa.binary())
    assert np.allclose(current.unpack(col, 64), current.unit(x), atol=1e-6)
    half = pa.array(list(current.pack(x[::2])), pa.binary())
    assert np.allclose(current.unpack(half.slice(3, 5), 64), current.unit(x[::2])[3:8], atol=1e-6)


def test_traversal_is_the_heap_order():
    rng = np.random.default_rng(5)
    d1, d2 = rng.random((20, 9)), rng.random((20, 7))
    for visits in (1, 4, 12, 63):
        p1, p2 = neighbours.first_pairs(d1, d2, visits)
        for i in range(20):
            want = [p for _, p in zip(range(visits), neighbours.traverse(d1[i], d2[i]))]
            assert list(zip(p1[i].tolist(), p2[i].tolist())) == want
            sums = [d1[i][a] + d2[i][b] for a, b in want]
            assert sums == sorted(sums)
    sizes = rng.integers(0, 3, (9, 7))
    for want in (1, 10, 30, 1000):
        pairs = list(zip(*(p.tolist() for p in neighbours.deep_pairs(d1[0], d2[0], sizes, want))))
        held = [p for p in neighbours.traverse(d1[0], d2[0]) if sizes[p]]
        assert pairs == held[: len(pairs)] and (sum(sizes[p] for p in pairs) >= want or len(pairs) == len(held))


def brute_top(x, ids, k, least):
    u = current.unit(np.asarray(x, np.float32)).astype(np.float64)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -9)
    out = {}
    for i in range(len(x)):
        order = np.lexsort((ids, -s[i]))[:k]
        out[int(ids[i])] = [int(ids[j]) for j in order if s[i, j] >= least]
    return out


def clustered(n, groups, noise, rng, spread=0.06):
    centres = rng.normal(size=(groups, 64))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    x = centres[rng.integers(0, groups, n)] + rng.normal(size=(n, 64)) * spread
    return np.concatenate([x, rng.normal(size=(noise, 64))])


def test_near_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = clustered(1500, 12, 500, rng)
    near = base[:300] + rng.normal(size=(300, 64)) * 0.012 * np.linalg.norm(base[:300], axis=1)[:, None]
    x = np.concatenate([base, near, near[:100] * 3.0])  # other lengths, same direction
    ids = rng.permutation(10 * len(x))[: len(x)]
    vectors = packed(spark, x, ids)
    for rows in (100_000, 300):
        top = neighbours.top_similar(vectors, 5, 0.95, visits=12, block_rows=rows)
        got = {(r["id_a"], r["id_b"]) for r in neighbours.near_pairs(top, 0.95).collect()}
        want = {(min(a, b), max(a, b)) for a, bs in brute_top(x, ids, 5, 0.95).items() for b in bs}
        assert len(want) > 300 and len(want - got) <= 0.005 * len(want)
        assert all(r["rank"] <= 5 and r["similarity"] >= 0.95 and r["id"] != r["other"] for r in top.collect())


def test_deep_search_recall(spark):
    rng = np.random.default_rng(4)
    x = clustered(3000, 10, 3000, rng)
    vectors = packed(spark, x)
    found = neighbours.top_similar(vectors, 5, deep_share=0.35, every=100, block_rows=1500).collect()
    want = brute_top(x, np.arange(len(x)), 5, -1)
    assert {r["id"] for r in found} == set(range(0, 6000, 100))
    hit = sum(r["other"] in want[r["id"]] for r in found)
    assert hit / (5 * 60) >= 0.9
    whole = neighbours.top_similar(vectors, 5, deep_share=1.0, every=500, block_rows=1500).collect()
    assert {i: [r["other"] for r in sorted(whole, key=lambda r: r["rank"]) if r["id"] == i] for i in range(0, 6000, 500)} == {i: want[i] for i in range(0, 6000, 500)}


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall_of_the_registered_settings(spark, scale):
    d = f"/root/testdata/{scale}"
    rows = current.current_vectors(spark.read.parquet(f"{d}/docs_ingest.parquet")).toPandas()
    ids, u = rows["id"].to_numpy(), current.unpack(list(rows["vec"]), 64)
    at = {int(i): n for n, i in enumerate(ids)}
    found = queries.p5_neighbours(spark, d).collect()
    asked = ids[ids % 100 == 0]
    assert {r["id"] for r in found} == set(asked.tolist())
    hit = 0
    lists = {}
    for r in found:
        lists.setdefault(r["id"], []).append(r["other"])
    for i in asked:
        s = u @ u[at[int(i)]]
        s[at[int(i)]] = -9
        hit += (s[[at[o] for o in lists[int(i)]]] >= np.partition(s, -5)[-5] - 1e-6).sum()
    assert hit / (5 * len(asked)) >= 0.9
    pairs = {(r["id_a"], r["id_b"]) for r in queries.p5_found(spark, d).collect()}
    want = set()
    for a in range(0, len(u), 2000):
        s = u[a : a + 2000] @ u.T
        s[np.arange(len(s)), np.arange(len(s)) + a] = -9
        best = np.argpartition(-s, 8, axis=1)[:, :9]
        for i, js in enumerate(best):
            js = sorted((j for j in js if s[i, j] >= 0.95 - 1e-5), key=lambda j: (-float(u[a + i].astype(float) @ u[j].astype(float)), ids[j]))[:5]
            want |= {(min(ids[a + i], ids[j]), max(ids[a + i], ids[j])) for j in js if u[a + i].astype(float) @ u[j].astype(float) >= 0.95}
    assert len(want - pairs) <= 0.002 * len(want) and len(pairs - want) <= 0.001 * len(want)


@pytest.mark.parametrize("every", [None, 3])
def test_crowds_of_copies(spark, every, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 64))
    x[200:] = x[200]  # two thirds are one vector
    x[199] = x[200] * 2
    x[150:160] = x[150]
    ids = rng.permutation(600)
    want = brute_top(x, ids, 5, 0.95 if every is None else -1.0)
    for parts in (1, 4, 9):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
        try:
            how = {"least": 0.95} if every is None else {"deep_share": 1.0, "every": every}
            top = neighbours.top_similar(packed(spark, x, ids, parts), 5, block_rows=150, **how).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        by = {}
        for r in sorted(top, key=lambda r: r["rank"]):
            by.setdefault(r["id"], []).append(r["other"])
        assert by == {i: v for i, v in want.items() if v and (every is None or i % every == 0)}


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny_tables(spark, n):
    v = packed(spark, np.eye(64)[:n] + 1)
    assert neighbours.top_similar(v, 5, 0.95).count() == 0 if n < 2 else neighbours.top_similar(v, 5, 0.5).count() == 2
    assert neighbours.top_similar(v, 5, deep_share=0.5, every=1).count() == (2 if n == 2 else 0)
    assert clusters.similarity_groups(v).count() == 0


def brute_groups(x, least, size):
    """Greedy mean shift from every row, all pairs at hand."""
    u = current.unit(np.asarray(x, np.float32)).astype(np.float64)
    s = u @ u.T
    found, free = [], np.ones(len(u), bool)
    for i in np.argsort(-(s >= 0.6).sum(1)):
        if not free[i]:
            continue
        m = s[i] >= 0.6
        for _ in range(8):
            c = u[m].mean(0)
            m = u @ (c / np.linalg.norm(c)) >= least
            if not m.any():
                break
        if m.sum() >= size:
            found.append(frozenset(np.flatnonzero(m).tolist()))
            free[m] = False
    return set(found)


def groups_of(df):
    by = {}
    for r in df.collect():
        by.setdefault(r["group_id"], set()).add(r["id"])
    assert all(min(m) == g for g, m in by.items())
    return {frozenset(m) for m in by.values()}


def test_groups_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(14, 64))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    sizes = [700, 300, 120, 60, 40, 30, 26, 25, 24, 20, 90, 55, 33, 200]
    parts = [c + rng.normal(size=(n, 64)) * 0.06 for c, n in zip(centres, sizes)]
    copies = np.repeat(rng.normal(size=(3, 64)), 12, axis=0)
    x = np.concatenate([*parts, rng.normal(size=(1500, 64)), copies])
    want = brute_groups(x, 0.8, 25)
    assert len(want) == 12
    v = packed(spark, x)
    for rows in (1024, 200):
        assert groups_of(clusters.similarity_groups(v, cell_rows=rows)) == want


def test_group_of_copies_and_touching_groups(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=64)
    a /= np.linalg.norm(a)
    b = rng.normal(size=64)
    b -= (b @ a) * a
    b /= np.linalg.norm(b)
    near = 0.55 * a + np.sqrt(1 - 0.55**2) * b
    x = np.concatenate([a + rng.normal(size=(800, 64)) * 0.06, near + rng.normal(size=(60, 64)) * 0.06, np.tile(rng.normal(size=64), (40, 1)), np.tile(rng.normal(size=64), (24, 1))])
    want = brute_groups(x, 0.8, 25)
    assert sorted(map(len, want)) == [40, 60, 800]
    assert groups_of(clusters.similarity_groups(packed(spark, x), cell_rows=300)) == want


def test_divided_cells_agree():
    rng = np.random.default_rng(3)
    x = clusters._unit(clustered(3000, 6, 1000, rng).astype(np.float32))
    w = np.ones(len(x))
    one = clusters.density_labels(x, w, 0.68, 6)
    many = clusters.local_clusters(x, w, 0.68, 6, 0.05, limit=700)
    for c in range(6):
        rows = np.flatnonzero(one == c)
        values, n = np.unique(many[rows][many[rows] >= 0], return_counts=True)
        assert n.max() > 0.95 * len(rows)
    same = np.tile(x[:1], (2000, 1))
    assert (clusters.local_clusters(same, np.ones(2000), 0.68, 6, 0.05, limit=300) >= 0).all()


def test_small_group_beside_a_dense_cell():
    rng = np.random.default_rng(12)
    hot, small, other = clusters._unit(rng.normal(size=(3, 64)))
    small = clusters._unit((hot * 0.5 + small * 0.9)[None])[0]
    x = np.concatenate([hot + rng.normal(size=(6000, 64)) * 0.06, small + rng.normal(size=(30, 64)) * 0.06, other + rng.normal(size=(25, 64)) * 0.06, rng.normal(size=(300, 64))])
    x = clusters._unit(x).astype(np.float32)
    w = np.ones(len(x))
    for limit in (600, 2000, 10_000):
        got = clusters.even_clusters(x, x, w, 0.68, 6, 0.02, 0.8, limit)
        for a, b in ((0, 6000), (6000, 6030), (6030, 6055)):
            values, n = np.unique(got[a:b][got[a:b] >= 0], return_counts=True)
            assert len(n) and n.max() >= 0.75 * (b - a), (limit, a)
            assert (got == values[n.argmax()]).sum() == n.max()
    one = clusters.density_labels(x, w, 0.68, 6)
    wide = clusters.wide_labels(x, w, 0.68, 6)
    assert ((one < 0) == (wide < 0)).all() and len(set(zip(one, wide))) == len(set(one)) == len(set(wide))
    # a dense crowd that space does not part is not thinned out either
    crowd = clusters.local_clusters(x, w, 0.68, 6, 0.5, limit=600)
    assert ((crowd < 0) == (one < 0)).all()


def test_no_size_of_a_cell_changes_its_clusters():
    rng = np.random.default_rng(21)
    hot, other = clusters._unit(rng.normal(size=(2, 64)))
    beside = clusters._unit((hot * 0.75 + other * 0.66)[None])[0]  # within 0.8 of many rows, of its own by density
    x = np.concatenate([hot + rng.normal(size=(1500, 64)) * 0.07, beside + rng.normal(size=(60, 64)) * 0.03, other + rng.normal(size=(30, 64)) * 0.07, rng.normal(size=(900, 64))])
    x = clusters._unit(x[rng.permutation(len(x))]).astype(np.float32)
    w = rng.integers(1, 3, len(x)).astype(float)
    for near in (0.5, 0.68, 0.8):
        one = clusters.local_clusters(x, w, near, 6, 0.02)
        even = clusters.even_clusters(x, x, w, near, 6, 0.02, 0.8)
        assert one.max() >= 0 and even.max() >= 1
        for limit in (50, 400, 2000):
            assert np.array_equal(clusters.local_clusters(x, w, near, 6, 0.02, limit), one), (near, limit)
            assert np.array_equal(clusters.even_clusters(x, x, w, near, 6, 0.02, 0.8, limit), even), (near, limit)
    assert clusters.wide_labels(x[:0], w[:0], 0.68, 6).shape == (0,)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (102, 100), (200, 300), (7, 7)] + [(1000, j) for j in range(1001, 1100)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in clusters.connected(df).collect()}
    for a, b in edges:
        if a != b:
            root = {**{i: 0 for i in range(61)}, **{i: 100 for i in (101, 102)}, 300: 200, **{j: 1000 for j in range(1001, 1100)}}
            for x in (a, b):
                if x in root and root[x] != x:
                    assert got[x] == root[x]
    assert clusters.connected(df.where("false")).count() == 0


def test_order_and_medoids(spark):
    m = spark.createDataFrame([(1, i * 40_000, 0.9 - i / 100) for i in range(9)] + [(5, 5, 0.8)], "group_id long, id long, similarity double")
    pairs = sorted((r["id_a"], r["id_b"]) for r in clusters.neighbours_in_order(m).collect())
    assert pairs == [(i * 40_000, (i + 1) * 40_000) for i in range(8)]
    top = clusters.describe_groups(m).where("group_id = 1").orderBy("rank").collect()
    assert [r["id"] for r in top] == [0, 40_000, 80_000] and top[0]["n_members"] == 9


def test_pivots_in_parts(monkeypatch):
    rng = np.random.default_rng(12)
    x = clusters._unit(clustered(6000, 80, 500, rng).astype(np.float32))
    flat = clusters.Pivots.fit(x, 200)
    monkeypatch.setattr(clusters, "FLAT_PIVOTS", 100)
    parts = clusters.Pivots.fit(x, 200)
    assert len(flat.parts) == 1 and len(parts.parts) > 8 and 150 < len(parts) < 260
    for p in (flat, parts):
        whole = np.concatenate(p.parts)
        cell, sim = p.nearest_two(x)
        s = x @ whole.T
        assert np.allclose(sim[:, 0], s[np.arange(len(x)), cell[:, 0]], atol=1e-5) and (cell[:, 0] != cell[:, 1]).all() and (sim[:, 0] >= sim[:, 1]).all()
        assert (cell[:, 0] == s.argmax(1)).mean() > (0.999 if p is flat else 0.9)
    one = clusters.Pivots.fit(x[:5], 1)
    assert (one.nearest_two(x[:5])[0] == [0, -1]).all()


def test_balls_and_merged_means():
    rng = np.random.default_rng(13)
    u = clusters._unit(np.concatenate([np.eye(64)[i] + rng.normal(size=(30, 64)) * 0.05 for i in range(3)]))
    got = clusters.balls(u, np.ones(90), 0.8)
    assert [len(set(got[i * 30 : i * 30 + 30])) for i in range(3)] == [1, 1, 1] and len(set(got)) == 3
    means, into = clusters.merge_means(np.array([[1.0, 0.0], [9.0, 0.5], [0.0, 3.0]]), np.array([1, 9, 3]), 0.9)
    assert len(means) == 2 and into.tolist() == [0, 0, 1] and np.allclose(np.linalg.norm(means, axis=1), 1)


def test_groups_do_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(14)
    x = np.concatenate([np.eye(64)[i] + rng.normal(size=(n, 64)) * 0.06 for i, n in enumerate((400, 60, 30))] + [np.tile(rng.normal(size=64), (900, 1)), rng.normal(size=(300, 64))])
    want = groups_of(clusters.similarity_groups(packed(spark, x, parts=1), cell_rows=100))
    assert sorted(map(len, want)) == [30, 60, 400, 900]
    for parts in (3, 9):
        assert groups_of(clusters.similarity_groups(packed(spark, x, parts=parts), cell_rows=100, fit_on=packed(spark, np.concatenate([x, x])))) == want
