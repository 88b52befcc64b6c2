import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodevec.functions import quant, vectors
from lodevec import api
from lodevec.operators import bm25, context, fusion, graph, ivf, knn, memory
from lodevec.plans import estimate, prune

RNG = np.random.default_rng(3)


@pytest.fixture(scope="module")
def points(spark):
    x = RNG.normal(size=(400, 8))
    x[5] = 0
    x[7] = x[6]
    rows = [(i, [float(v) for v in r], int(i % 4)) for i, r in enumerate(x)] + [(900, None, 0)]
    return x, spark.createDataFrame(rows, "id long, embedding array<double>, label int")


def brute(metric, q, x):
    d = knn._all_distances(metric, np.asarray(q)[None, :], x)[0]
    return np.lexsort((np.arange(len(x)), np.round(d, 12)))


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot", "normalized_cosine"])
def test_search_equals_brute_force(points, metric):
    x, df = points
    q = x[3] + 0.1
    got = knn.search(df, q.tolist(), 12, metric).collect()
    assert [r["id"] for r in got] == brute(metric, q, x)[:12].tolist()
    assert [r["_distance"] for r in got] == sorted(r["_distance"] for r in got)


def test_search_bounds(points):
    x, df = points
    q = x[0].tolist()
    assert knn.search(df, q, 1000).count() == 400
    assert knn.search(df, q, 5, where="label = 2").where("label <> 2").count() == 0
    assert knn.search(df, q, 5, where="label = 2").count() == 5
    assert knn.search(df.where("false"), q, 5).count() == 0
    assert all(r["_distance"] <= 0.4 for r in knn.search(df, q, 500, within=0.4).collect())
    assert {r["id"] for r in knn.search(df, x[6].tolist(), 2).collect()} == {6, 7}
    for bad in (dict(query=[1.0]), dict(query=[float("nan")] * 8), dict(k=0), dict(k=200_000)):
        with pytest.raises(ValueError):
            knn.search(df, bad.get("query", q), bad.get("k", 5), dim=8)
    with pytest.raises(ValueError):
        knn.search(df, q, 5, metric="manhattan")


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
def test_batch_equals_single(points, spark, metric):
    x, df = points
    queries = df.where("id % 50 = 0 and id < 900").select(F.col("id").alias("query_id"), "embedding")
    got = knn.search_batch(df, queries, 7, metric).collect()
    for q in range(0, 400, 50):
        mine = [r["id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert mine == brute(metric, x[q], x)[:7].tolist()
    assert knn.search_batch(df, queries.where("false"), 7).count() == 0
    assert knn.search_batch(df.where("false"), queries, 7).count() == 0


def test_rerank_and_score(points):
    x, df = points
    q = (x[3] + 0.1).tolist()
    assert [r["id"] for r in knn.search_reranked(df, q, 5, 8).collect()] == brute("cosine", q, x)[:5].tolist()
    by = knn.search(df, q, 5, score=lambda d: -d).collect()
    assert by[0]["_distance"] == max(r["_distance"] for r in knn.search(df, q, 400).collect())


def test_index_recall(points):
    x, df = points
    for residual in (False, True):
        index = ivf.train(df, nlist=16, pq_m=4, residual=residual, metric="euclidean", nprobe=8)
        built = ivf.build(df, index)
        hits = total = 0
        for q in (1, 50, 99):
            got = {r["id"] for r in ivf.search(built, index, x[q].tolist(), 10, rerank=6).collect()}
            hits += len(got & set(brute("euclidean", x[q], x)[:10].tolist()))
            total += 10
        assert hits / total >= 0.75
        everything = ivf.search(built, index, x[1].tolist(), 10, nprobe=16, rerank=40).collect()
        assert [r["id"] for r in everything] == brute("euclidean", x[1], x)[:10].tolist()
    assert ivf.build(df, index).where("id = 900").first()["cell"] == -1
    assert ivf.choose(5000, 9) == "ivf_pq" and ivf.choose(4999, 9) == ivf.choose(10**6, 8) == "exact"


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-50, 50), min_size=4, max_size=4), st.lists(st.floats(-50, 50), min_size=4, max_size=4))
def test_metric_properties(a, b):
    a, b = np.array([a]), np.array([b])
    for m in vectors.METRICS:
        assert math.isclose(knn._all_distances(m, a, b)[0, 0], knn._all_distances(m, b, a)[0, 0], rel_tol=1e-9, abs_tol=1e-9)
    assert knn._all_distances("cosine", a, np.zeros((1, 4)))[0, 0] == 1.0


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([float("nan"), 1.0],), ([1.0],)], "v array<double>")
    got = df.select(vectors.norm("v").alias("n"), vectors.normalize("v").alias("u"), vectors.problem("v", 2).alias("p")).collect()
    assert got[0]["n"] == 5.0 and got[0]["u"] == [0.6, 0.8] and got[1]["u"] == [0.0, 0.0]
    assert [r["p"] for r in got] == [None, None, "null", "not finite", "dimension"]
    assert vectors.metric_name("Dot_Product") == "dot"


def test_quantisation(spark):
    x = RNG.normal(size=(20, 6)).astype(np.float32)
    df = spark.createDataFrame([([float(v) for v in r],) for r in x] + [([2.0] * 6,)], "v array<float>")
    for r in df.select("v", quant.quantize_i8("v").alias("q")).select("v", "q", quant.dequantize_i8(F.col("q")).alias("b")).collect():
        assert max(abs(a - b) for a, b in zip(r["v"], r["b"])) <= r["q"]["scale"]
        assert all(-128 <= c <= 127 for c in r["q"]["codes"])
    back = df.select(quant.from_half(quant.to_half("v")).alias("h"), quant.from_single(quant.to_single("v")).alias("s"), "v").collect()
    assert all(r["s"] == r["v"] for r in back) and all(np.allclose(r["h"], r["v"], rtol=1e-3) for r in back)
    pq = quant.ProductQuantizer.train(x, 3, k=20)
    assert np.allclose(pq.decode(pq.encode(x)), x, atol=1e-6)
    coded = df.limit(20).select("v", pq.encode_column("v").alias("c"))
    for r in coded.select("v", pq.adc_column("c", x[0]).alias("d")).collect():
        assert math.isclose(r["d"], float(((np.array(r["v"]) - x[0]) ** 2).sum()), abs_tol=1e-4)
    assert quant.sub_vectors(12, 5) == 4 and quant.sub_vectors(7, 3) == 1
    with pytest.raises(ValueError):
        quant.ProductQuantizer.train(x, 4)


DOCS = ["rust is a systems language", "python and rust", "javascript in the browser", None, "", "RUST rust rust!", "é 日本 a"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")


def test_bm25_by_hand(docs):
    toks = {i: [t.lower() for t in "".join(c if c.isalnum() else " " for c in t).split() if len(t.encode()) > 1] for i, t in enumerate(DOCS) if t}
    toks = {i: t for i, t in toks.items() if t}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    want = {}
    for i, t in toks.items():
        s = 0.0
        for term in ["rust", "rust", "python"]:
            df = sum(term in u for u in toks.values())
            f = t.count(term)
            s += math.log((n - df + 0.5) / (df + 0.5) + 1) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(t) / avg))
        if s > 0:
            want[i] = s
    got = {r["doc_id"]: r["score"] for r in bm25.scores(docs, "rust Rust python").collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in got)
    assert bm25.scores(docs, "x ! ?").count() == 0
    assert bm25.scores(docs.where("false"), "rust").count() == 0


def test_boolean_and_phrases(docs):
    find = lambda q: sorted(r["doc_id"] for r in bm25.boolean_search(docs, q).collect())
    assert find("rust python") == [0, 1, 5]
    assert find("+rust +python") == [1]
    assert find("+rust -python") == [0, 5]
    assert find('+"systems language"') == [0] and find('"language systems"') == []
    assert find('"rust rust rust"') == [5]
    assert find("-rust") == [] and find("?? !") == []
    assert [r["doc_id"] for r in bm25.ranked_boolean(docs, "+rust -python", 5).collect()][0] == 5


def test_pruning(spark, docs):
    files = docs.where("text is not null").withColumn("file", (F.col("doc_id") % 3).cast("string"))
    terms = bm25.file_terms(files, "file")
    exact = {r["file"] for r in bm25.prune_by_terms(terms, "rust", "file").collect()}
    bloom = {r["file"] for r in prune.by_bloom(prune.bloom_filters(terms, "file"), ["rust"]).collect()}
    assert exact == {"0", "1", "2"} & exact and exact <= bloom
    many = spark.range(3000).select(F.lit("f").alias("file"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("term"))
    odd = spark.createDataFrame([("g", "only"), ("g", None), (None, "x")], "file string, term string")
    filters = prune.bloom_filters(many.unionByName(odd), "file").cache()
    assert {r["file"] for r in filters.collect()} == {"f", "g"}
    words = spark.range(6000).select(F.concat(F.when(F.col("id") < 3000, "w").otherwise("x"), F.col("id").cast("string")).alias("w"))
    found = words.crossJoin(filters.where("file = 'f'")).select("w", prune.may_contain("bloom", F.col("w")).alias("may")).toPandas()
    assert found[found["w"].str[0] == "w"]["may"].all() and found[found["w"].str[0] == "x"]["may"].mean() < 0.03
    assert {r["file"] for r in prune.by_bloom(filters, ["only"]).collect()} >= {"g"}
    none = filters.select("file", F.lit(None).cast("array<long>").alias("bloom"))
    assert prune.by_bloom(none, ["rust"]).count() == 2 and prune.by_bloom(filters, []).count() == 2
    assert prune.bloom_filters(many.where("false"), "file").count() == 0


def test_geometry_never_loses_a_row(points):
    x, df = points
    shards = vectors.centroid_radius(df, "embedding", ["label"])
    q = x[0].tolist()
    nearest = knn.search(df, q, 5, "euclidean").collect()
    kept = {r["label"] for r in prune.by_geometry(shards, q, nearest[-1]["_distance"] + 1e-9).collect()}
    assert {r["label"] for r in nearest} <= kept
    assert prune.by_geometry(shards, q).count() == 4


def test_fusion(points, spark):
    x, df = points
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank long")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id long, rank long")
    one = [(r["id"], round(r["rrf_score"], 9)) for r in fusion.fuse_arms([(a, 1.0), (b, 1.0)], k=9).orderBy("rank").collect()]
    two = [(r["id"], round(r["rrf_score"], 9)) for r in fusion.fuse_arms([(b, 1.0), (a, 1.0)], k=9).orderBy("rank").collect()]
    assert one == two and one[0] == (2, round(1 / 62 + 1 / 61, 9))
    assert round(fusion.fuse_arms([(a, 1.0)], k=1, first_rank=0).first()["rrf_score"], 9) == round(1 / 60, 9)
    assert fusion.arm_depth(10, 1) == 20 and fusion.arm_depth(900, 3) == 1000
    with pytest.raises(ValueError):
        fusion.search_multimodal(df, [])


def test_context(spark):
    rows = [
        (1, "d2", 5, "far <b>", 0.9, [1.0, 0.0]), (1, "d1", 2, "second", 0.2, [0.0, 1.0]), (1, "d1", 1, "first & only", 0.3, [0.7, 0.7]), (1, "d1", 9, "copy", 0.4, [0.0, 1.001]),
        (1, "d3", 1, "no vector", 0.5, None), (2, "x", 0, "alone", 0.1, [1.0, 1.0]),
    ]
    c = spark.createDataFrame(rows, "query_id long, document_id string, chunk_index long, chunk_text string, distance double, embedding array<double>")
    got = {r["query_id"]: r for r in context.assemble_chunks(c).collect()}
    text = got[1]["text"]
    assert got[1]["chunk_count"] == 4 and "copy" not in text
    assert text.index("first &amp; only") < text.index("second") < text.index("no vector") < text.index("far &lt;b&gt;")
    assert text.count("<document ") == text.count("</document>") == 3 and text.endswith("</context>")
    short = context.assemble_chunks(c, max_tokens=50).where("query_id = 1").first()
    assert short["chunk_count"] == 2 and short["text"].count("<document ") == short["text"].count("</document>")
    assert context.assemble_chunks(c.where("false")).count() == 0
    t = spark.createDataFrame([(1, i, "abcd") for i in range(5)], "query_id long, rank long, text string")
    r = context.assemble_texts(t, max_tokens=3).first()
    assert r["text"] == "abcd\n\nabcd" and r["chunk_count"] == 2


def test_memory(spark):
    df = spark.createDataFrame([("a", "2024-01-01", 1.0), ("b", "2024-01-11", 1.0), ("c", None, 1.0), ("d", "2030-01-01", 1.0)], "id string, at string, x double")
    df = df.withColumn("at", F.to_timestamp("at"))
    got = {r["id"]: r["w"] for r in memory.decay(df, F.lit("2024-01-11").cast("date"), 0.1, "at", "w").collect()}
    assert math.isclose(got["a"], math.exp(-1)) and got["b"] == got["c"] == got["d"] == 1.0
    log = spark.createDataFrame([("u", i) for i in range(9)] + [("v", 0)], "agent_id string, seq long")
    assert sorted((r["agent_id"], r["seq"]) for r in memory.working_memory(log, 2).collect()) == [("u", 7), ("u", 8), ("v", 0)]


def test_estimate():
    rows = {r["mode"]: r for r in estimate.storage("1M", 1536)}
    assert rows["F32 (baseline)"]["vectors_bytes"] == 1_000_000 * 1536 * 4 and rows["F32 (baseline)"]["index_bytes"] == 1_000_000 * 16 * 18
    assert rows["PQ-only (--pq-only)"]["total_bytes"] == 48_000_000
    assert estimate.parse_rows("1.5k") == 1500 and estimate.parse_rows("2_000") == 2000 and estimate.parse_rows("3G") == 3 * 10**9


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
def test_graph_recall(points, metric):
    x, df = points
    index = graph.build(df, metric=metric, shard_rows=150, links=8, width=60)
    assert index.count() == 3
    qs = [x[i] + 0.05 for i in range(0, 400, 40)]
    found = graph.search(index, qs, 10, 60, metric).collect()
    hits = sum(r["key"] in set(brute(metric, qs[r["query_no"]], x)[:10].tolist()) for r in found)
    assert hits >= 0.93 * 10 * len(qs)
    g = graph.Graph.from_bytes(index.first()["graph"], metric)
    again = graph.Graph.from_bytes(g.to_bytes(), metric)
    assert again.search(x[0], 5, 50) == g.search(x[0], 5, 50)
    assert graph.search(index.where("false"), qs, 3).count() == 0


def test_working_memory_buffer():
    b = api.WorkingMemoryBuffer(2)
    for i, t in enumerate("abc"):
        b.push(t, [float(i), 1.0], 7)
    assert [t for _, t in b.search([1.0, 1.0], 5)] == ["b", "c"] and b.search([0.0, 0.0], 1)[0][0] == 1.0
    assert all(e[2] == 1.0 for e in b.entries) and b.search([1.0, 1.0], 0) == []
    assert api.model_tag("a@b@c") == ("a", "b@c") and api.model_tag("a") == ("a", None)
