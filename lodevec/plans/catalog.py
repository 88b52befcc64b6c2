"""Queries over the given tables for each operator, and the same in SQL for DuckDB."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodevec import api
from lodevec.functions import quant, text, vectors
from lodevec.operators import bm25, context, fusion, graph, ivf, knn, memory
from lodevec.plans import estimate, prune
from lodevec.session import shared_folder, spread, table
from lodevec.sources import index, textindex
from lodevec.sources.table import Table, VectorColumn

WORDS = "commit protocol snapshot vector"
AS_OF = "2024-06-01 00:00:00"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)  # no negative zero


def _vector(spark: SparkSession, d: str, vec_id: int) -> list[float]:
    row = table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").head()
    return [float(x) for x in row[0]]


def _emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


# -- nearest neighbours ---------------------------------------------------------------------------------------------

_E = "select vec_id, label, embedding::double[] v from embeddings"
_Q0 = "(select embedding::double[] from embeddings where vec_id = 0)"
_DIST = {
    "cosine": "list_cosine_distance(v, q)",
    "euclidean": "list_distance(v, q)",
    "dot": "-list_inner_product(v, q)",
    "normalized_cosine": "1 - list_inner_product(v, q)",
}


def _knn_sql(metric: str, where: str = "true", k: int = 10, more: str = "") -> str:
    return (
        f"with e as ({_E}), d as (select vec_id, label, {_DIST[metric]} dist from (select e.*, {_Q0} q from e) where {where}) "
        f"select vec_id, round(dist, 6) + 0.0::double dist from d where true {more} order by d.dist, vec_id limit {k}"
    )


def _knn(spark: SparkSession, d: str, metric: str, **how) -> DataFrame:
    hits = knn.search(_emb(spark, d), _vector(spark, d, 0), 10, metric, key="vec_id", dim=64, **how)
    return hits.select("vec_id", _r("_distance").alias("dist"))


@query(_knn_sql("cosine"))
def knn_cosine(spark, d):
    return _knn(spark, d, "cosine")


@query(_knn_sql("euclidean"))
def knn_euclidean(spark, d):
    return _knn(spark, d, "euclidean")


@query(_knn_sql("dot"))
def knn_dot(spark, d):
    return _knn(spark, d, "dot")


@query(_knn_sql("normalized_cosine"))
def knn_normalized(spark, d):
    return _knn(spark, d, "normalized_cosine")


@query(_knn_sql("cosine", "label in (2, 3) and vec_id > 10"))
def knn_filtered(spark, d):
    return _knn(spark, d, "cosine", where=F.col("label").isin(2, 3) & (F.col("vec_id") > 10))


@query(_knn_sql("cosine", "label = 4"))
def knn_partition(spark, d):
    return _knn(spark, d, "cosine", partition=F.col("label") == 4)


@query(_knn_sql("cosine", more="and dist <= 0.7"))
def knn_threshold(spark, d):
    return _knn(spark, d, "cosine", within=0.7)


_BATCH = f"""
with e as ({_E}), q as (select * from e where vec_id % 100 = 0),
d as (select q.vec_id query_id, e.vec_id, e.label, list_cosine_distance(e.v, q.v) dist from q join e on e.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by round(dist, 12), vec_id) rank from d)
"""


def _batch(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = _emb(spark, d)
    q = e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return knn.search_batch(e, q, k, "cosine", key="vec_id", exclude_same_key=True)


@query(_BATCH + "select query_id, vec_id, round(dist, 6) distance, rank from r where rank <= 10")
def knn_batch(spark, d):
    return _batch(spark, d, 10).withColumn("distance", _r("distance"))


@query(
    _BATCH
    + """, v as (select query_id, label, count(*) votes from r where rank <= 15 group by all)
select query_id, label, votes from (select *, row_number() over (partition by query_id order by votes desc, label) n from v) where n = 1"""
)
def knn_label_vote(spark, d):
    return knn.label_vote(_batch(spark, d, 15), _emb(spark, d), key="vec_id")


@query(
    f"""
with e as ({_E}), s as (select *, {_Q0} q, list_min(v) lo, case when list_max(v) > list_min(v) then (list_max(v) - list_min(v)) / 254.0 else 1.0 end sc from e),
c as (select *, list_transform(v, lambda x: greatest(least(round(x / sc + (-128.0 - lo / sc)), 127.0), -128.0)) codes from s),
p as (select *, list_cosine_distance(list_transform(codes, lambda x: (x - (-128.0 - lo / sc)) * sc), q) rough from c),
pool as (select * from p order by rough, vec_id limit 50)
select vec_id, round(list_cosine_distance(v, q), 6) dist from pool order by list_cosine_distance(v, q), vec_id limit 10"""
)
def knn_rerank(spark, d):
    return knn.search_reranked(_emb(spark, d), _vector(spark, d, 0), 10, 5, key="vec_id").select("vec_id", _r("_distance").alias("dist"))


@query(
    f"""
with e as ({_E}), m as (
  select vec_id, list_cosine_distance(v, {_Q0}) dist, exp(-0.023 * greatest(epoch_us(timestamp '{AS_OF}' - ts) / 86400000000.0, 0)) rec,
    1 / (1 + abs(value)) imp
  from e join events on event_id = vec_id)
select vec_id, round(dist / greatest(rec * imp, 1.1920929e-07), 5) score from m order by dist / greatest(rec * imp, 1.1920929e-07), vec_id limit 10"""
)
def knn_score_expr(spark, d):
    e = _emb(spark, d).join(table(spark, d, "events").select(F.col("event_id").alias("vec_id"), "ts", "value"), "vec_id")
    weight = memory.recency_weight(F.lit(AS_OF).cast("timestamp"), F.col("ts"), memory.MONTHLY)
    hits = knn.search(e, _vector(spark, d, 0), 10, key="vec_id", score=lambda x: memory.recall_score(x, weight, 1 / (1 + F.abs("value"))))
    return hits.select("vec_id", _r("_score", 5).alias("score"))


@query(
    f"""
with e as ({_E}), h as (select vec_id, list_cosine_distance(v, {_Q0}) dist from e order by 2, 1 limit 10),
r as (select *, row_number() over (order by dist, vec_id) rank from h)
select vec_id doc_id, round(dist, 6) dist, rank, text, source from r join documents on doc_id = vec_id"""
)
def knn_fetch_rows(spark, d):
    hits = knn.search(_emb(spark, d), _vector(spark, d, 0), 10, key="vec_id")
    hits = hits.select(F.col("vec_id").alias("doc_id"), _r("_distance").alias("dist"), F.row_number().over(Window.orderBy("_distance", "vec_id")).cast("long").alias("rank"))
    return knn.fetch_rows(hits, table(spark, d, "documents").select("doc_id", "text", "source"), "doc_id")


# -- vector functions -----------------------------------------------------------------------------------------------


@query(f"select vec_id, round(sqrt(list_inner_product(v, v)), 6) norm from ({_E})")
def vector_norms(spark, d):
    return _emb(spark, d).select("vec_id", _r(vectors.norm("embedding")).alias("norm"))


@query(f"select vec_id, i - 1 pos, round(v[i] / sqrt(list_inner_product(v, v)), 6) x from ({_E}), range(1, 65) t(i)")
def vector_normalize(spark, d):
    return _emb(spark, d).select("vec_id", F.posexplode(vectors.normalize("embedding")).alias("pos", "x")).select("vec_id", F.col("pos").cast("long"), _r("x").alias("x"))


@query(
    """
select coalesce(case when embedding is null then 'null' when len(embedding) <> 64 then 'dimension'
  when len(list_filter(embedding, lambda x: x is null or not isfinite(x))) > 0 then 'not finite' end, 'good') problem, count(*) n
from docs_ingest group by all"""
)
def vector_validate(spark, d):
    why = F.coalesce(vectors.problem("embedding", 64), F.lit("good"))
    return table(spark, d, "docs_ingest").groupBy(why.alias("problem")).agg(F.count(F.lit(1)).alias("n"))


_SHARDS = f"""
with e as (select vec_id, vec_id % 8 shard, v from ({_E})), x as (select shard, i, avg(v[i]) m from e, range(1, 65) t(i) group by all),
c as (select shard, list(m order by i) centroid from x group by all),
g as (select shard, count(*) n_rows, centroid, max(list_distance(v, centroid)) radius from e join c using (shard) group by shard, centroid)
"""


def _shards(spark: SparkSession, d: str) -> DataFrame:
    e = _emb(spark, d).withColumn("shard", F.col("vec_id") % 8)
    return vectors.centroid_radius(e, "embedding", ["shard"])


@query(_SHARDS + "select shard, n_rows, round(radius, 6) radius, round(sqrt(list_inner_product(centroid, centroid)), 6) centroid_norm from g")
def file_centroid_radius(spark, d):
    return _shards(spark, d).select("shard", "n_rows", _r("radius").alias("radius"), _r(vectors.norm("centroid")).alias("centroid_norm"))


@query(_SHARDS + f"select shard from g where list_distance(centroid, {_Q0}) - radius <= -0.005")
def shard_geometric_prune(spark, d):
    return prune.by_geometry(_shards(spark, d), _vector(spark, d, 0), -0.005).select("shard")


@query(
    f"""
with s as (select vec_id, v, list_min(v) lo, case when list_max(v) > list_min(v) then (list_max(v) - list_min(v)) / 254.0 else 1.0 end sc from ({_E})),
c as (select *, list_transform(v, lambda x: greatest(least(round(x / sc + (-128.0 - lo / sc)), 127.0), -128.0)) codes from s)
select vec_id, round(sc, 9) scale, cast(list_sum(codes) as bigint) code_sum,
  round(list_max(list_transform(range(1, 65), lambda i: abs((codes[i] - (-128.0 - lo / sc)) * sc - v[i]))), 6) worst from c"""
)
def i8_quantize(spark, d):
    q = _emb(spark, d).withColumn("q", quant.quantize_i8("embedding"))
    back = F.zip_with(quant.dequantize_i8(F.col("q")), vectors.as_column("embedding"), lambda a, b: F.abs(a - b))
    return q.select(
        "vec_id", _r("q.scale", 9).alias("scale"), F.aggregate("q.codes", F.lit(0).cast("long"), lambda s, x: s + x).alias("code_sum"), _r(F.array_max(back)).alias("worst")
    )


@query(f"select vec_id, true within_half_a_step from ({_E})")
def half_precision_round_trip(spark, d):
    """No component is further from its half-precision value than half a step of that precision."""
    back = _emb(spark, d).select("vec_id", "embedding", quant.from_half(quant.to_half("embedding")).alias("h"))
    near = F.zip_with(vectors.as_column("embedding"), vectors.as_column("h"), lambda a, b: F.abs(a - b) <= F.greatest(F.abs(a) * 2.0**-11, F.lit(2.0**-25)))
    return back.select("vec_id", F.forall(near, lambda x: x).alias("within_half_a_step"))


# -- index ----------------------------------------------------------------------------------------------------------


@query(_knn_sql("cosine"))
def ivf_pq_search(spark, d):
    """Fifteen of sixteen cells, four hundred candidates by their codes: what full comparison gives."""
    e = _emb(spark, d)
    index = ivf.train(e, key="vec_id", nlist=16, pq_m=16)
    hits = ivf.search(ivf.build(e, index), index, _vector(spark, d, 0), 10, nprobe=15, rerank=40, key="vec_id")
    return hits.select("vec_id", _r("_distance").alias("dist"))


@query(_knn_sql("cosine"))
def ivf_residual_search(spark, d):
    e = _emb(spark, d)
    index = ivf.train(e, key="vec_id", nlist=16, pq_m=16, residual=True)
    hits = ivf.search(ivf.build(e, index), index, _vector(spark, d, 0), 10, nprobe=15, rerank=40, key="vec_id")
    return hits.select("vec_id", _r("_distance").alias("dist"))


@query(
    f"""with e as ({_E}), q as (select vec_id query_no, v q from e where vec_id in (0, 1, 2)), d as (select query_no, vec_id, list_cosine_distance(v, q) dist from e, q)
select query_no, vec_id "key", round(dist, 5) distance, row_number() over (partition by query_no order by dist, vec_id) rank from d
qualify row_number() over (partition by query_no order by dist, vec_id) <= 10"""
)
def graph_search(spark, d):
    """Navigable graph: the ten nearest rows to three queries, searched wide enough to be what full comparison gives; vectors are kept in single precision."""
    g = graph.build(_emb(spark, d), "vec_id", shard_rows=2500)
    return graph.search(g, [_vector(spark, d, i) for i in (0, 1, 2)], 10, width=1000).withColumn("distance", _r("distance", 5))


@query("select count(*) n_rows, count(*) in_range from embeddings")
def ivf_cells(spark, d):
    """Every row is in one cell."""
    e = _emb(spark, d)
    i = ivf.train(e, key="vec_id", nlist=16, use_pq=False)
    cells = ivf.build(e, i).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vec_id").alias("ids"))
    return cells.agg(F.sum("ids").alias("n_rows"), F.sum(F.when(F.col("cell").between(0, 15), F.col("n"))).alias("in_range"))


# -- text -----------------------------------------------------------------------------------------------------------

_TOK = "list_transform(list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{N}]+'), lambda t: strlen(t) >= 2), lambda t: lower(t))"
_DOCS = f"with d as (select doc_id, {_TOK} t from documents where text is not null), n as (select *, len(t) n from d where len(t) > 0)"
_WORDS_SQL = ", ".join(f"'{w}'" for w in WORDS.split())
_BM25 = f"""{_DOCS},
f as (select count(*) docs, avg(n) av from n),
w as (select unnest([{_WORDS_SQL}]) term),
tf as (select doc_id, n, term, len(list_filter(t, lambda x: x = term)) c from n, w),
dfs as (select term, sum((c > 0)::int) df from tf group by all),
b as (
  select doc_id, sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * n / av))) score
  from tf join dfs using (term), f where c > 0 group by all)"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


@query(f"{_DOCS} select doc_id, term, count(*) tf, n doc_len from (select doc_id, n, unnest(t) term from n) group by all")
def tokenize_counts(spark, d):
    return bm25.term_counts(_docs(spark, d)).select("doc_id", "term", "tf", "doc_len")


@query(f"{_DOCS} select count(*) doc_count, cast(sum(n) as bigint) total_tokens, round(avg(n), 6) avg_doc_len from n")
def corpus_stats(spark, d):
    return bm25.corpus_stats(_docs(spark, d)).withColumn("avg_doc_len", _r("avg_doc_len"))


@query(
    f"""{_DOCS}, u as (select distinct doc_id, unnest(t) term from n), c as (select term, count(*) df from u group by all order by df desc, term limit 50000)
select term, df, round(ln(((select count(*) from n) - df + 0.5) / (df + 0.5) + 1), 6) idf from c"""
)
def idf_table(spark, d):
    return bm25.idf_table(_docs(spark, d)).withColumn("idf", _r("idf"))


@query(f"{_BM25} select doc_id, round(score, 6) score from b order by round(b.score, 9) desc, doc_id limit 20")
def bm25_topk(spark, d):
    return bm25.search_text(_docs(spark, d), WORDS, 20).withColumn("score", _r("score"))


@query(f"{_BM25} select doc_id, round(score, 6) score from b")
def bm25_all_scores(spark, d):
    return bm25.scores(_docs(spark, d), WORDS).withColumn("score", _r("score"))


@query(f"{_DOCS} select distinct doc_id % 20 file from n where list_has_any(t, [{_WORDS_SQL}])")
def term_file_prune(spark, d):
    files = _docs(spark, d).withColumn("file", F.col("doc_id") % 20)
    return bm25.prune_by_terms(bm25.file_terms(files, "file"), WORDS, "file")


@query(
    f"""{_DOCS}, t as (select distinct doc_id % 500 file, unnest(t) term from n), f as (select file, max((term in ('lease', 'quorum'))::int) has from t group by file)
select count(*) files, sum(has)::bigint with_word, sum(has)::bigint kept_with_word from f"""
)
def bloom_file_prune(spark, d):
    """No file that holds a word of the query is ruled out by its filter."""
    files = _docs(spark, d).withColumn("file", F.col("doc_id") % 500)
    terms = bm25.file_terms(files, "file")
    words = ["lease", "quorum"]
    kept = prune.by_bloom(prune.bloom_filters(terms, "file"), words).select("file", F.lit(1).alias("kept"))
    has = terms.groupBy("file").agg(F.max(F.col("term").isin(words).cast("int")).alias("has"))
    both = has.join(kept, "file", "left")
    return both.agg(F.count(F.lit(1)).alias("files"), F.sum("has").alias("with_word"), F.sum(F.col("has") * F.coalesce("kept", F.lit(0))).alias("kept_with_word"))


@query(
    f"""{_DOCS}, p as (select doc_id, unnest(t) term, generate_subscripts(t, 1) - 1 pos from n)
select term, doc_id, count(*) tf, min(pos) first_pos, max(pos) last_pos from p group by all"""
)
def inverted_index(spark, d):
    i = bm25.inverted_index(_docs(spark, d))
    return i.select("term", "doc_id", "tf", F.array_min("positions").cast("long").alias("first_pos"), F.array_max("positions").cast("long").alias("last_pos"))


@query(f"{_DOCS} select doc_id from n where list_has_all(t, ['commit', 'protocol', 'manifest'])")
def boolean_and(spark, d):
    return bm25.match_all(bm25.inverted_index(_docs(spark, d)), ["commit", "protocol", "manifest"])


@query(f"{_DOCS} select doc_id from n where contains(' ' || array_to_string(t, ' ') || ' ', ' commit protocol ')")
def phrase_match(spark, d):
    return bm25.match_phrase(bm25.inverted_index(_docs(spark, d)), ["commit", "protocol"])


@query(
    f"""{_DOCS} select doc_id from n where contains(' ' || array_to_string(t, ' ') || ' ', ' commit protocol ')
  and list_contains(t, 'snapshot') and not list_contains(t, 'lease')"""
)
def boolean_query(spark, d):
    return bm25.boolean_search(_docs(spark, d), '+"commit protocol" +snapshot -lease')


@query("""
with c as (select doc_id, lower(text) t from documents where lang = 'ja' and length(text) > 0)
select gram, count(*) n from (
  select substr(t, i, s) gram from c, range(1, 100000) r(i), range(1, 3) z(s) where i + s - 1 <= length(t)) group by all""")
def cjk_ngrams(spark, d):
    ja = _docs(spark, d).where("lang = 'ja'")
    return ja.select(F.explode(text.character_ngrams("text")).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query("""select doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') xml from documents""")
def xml_escape(spark, d):
    return _docs(spark, d).select("doc_id", text.escape_xml("text").alias("xml"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS["en"])
_STEM = "regexp_replace(w, '(ss|us|is)$', '\\1~')"
for _a, _b in (("ies$", "y"), ("(x|ch|sh|ss~?)es$", "\\1"), ("([^s])s$", "\\1"), ("([a-z]{3,}?)(?:ing|ed)$", "\\1"), ("~", "")):
    _STEM = f"regexp_replace({_STEM}, '{_a}', '{_b}')"
_LAST = " ".join(f"when suffix(s, '{c}{c}') then s[:-2]" for c in "bdfgmnprt")


@query(
    f"""{_DOCS}, w as (select unnest(list_filter(t, lambda x: x not in ({_STOP}))) w from n), s as (select {_STEM} s from w)
select stem, count(*) n from (select case {_LAST} else s end stem from s) group by all"""
)
def stop_words_and_stems(spark, d):
    words = text.light_stems(text.without_stop_words(text.tokens("text")))
    return _docs(spark, d).select(F.explode(words).alias("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias("n"))


# -- fusion ---------------------------------------------------------------------------------------------------------

def _both(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", "text").join(_emb(spark, d).select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")


_HYBRID = f"""
with j as (select doc_id, embedding::double[] v, {_TOK} t from documents join embeddings on vec_id = doc_id),
n as (select *, len(t) n from j where len(t) > 0), f as (select count(*) docs, avg(n) av from n),
w as (select unnest([{_WORDS_SQL}]) term), tf as (select doc_id, n, term, len(list_filter(t, lambda x: x = term)) c from n, w),
dfs as (select term, sum((c > 0)::int) df from tf group by all),
b as (select doc_id, sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * n / av))) b
  from tf join dfs using (term), f where c > 0 group by all),
jd as (select doc_id, list_cosine_distance(v, {_Q0}) d from j), pool as (select * from jd order by round(d, 12), doc_id limit 100),
p as (select doc_id, d, coalesce(b, 0) b from pool left join b using (doc_id))
"""


@query(
    _HYBRID
    + """, r as (select *, row_number() over (order by round(d, 12), doc_id) - 1 vr, row_number() over (order by round(b, 9) desc, doc_id) - 1 br from p),
s as (select doc_id, 0.6 / (60 + vr) + 0.4 / (60 + br) score from r)
select doc_id, round(score, 8) score from s order by round(s.score, 12) desc, doc_id limit 10"""
)
def hybrid_rrf(spark, d):
    return fusion.hybrid_rrf(_both(spark, d), _vector(spark, d, 0), WORDS, 10, 0.4).withColumn("score", _r("score", 8))


@query(
    _HYBRID
    + """, m as (select min(d) d0, max(d) d1, min(b) b0, max(b) b1 from p),
s as (select doc_id, 0.6 * (case when d1 > d0 then (d - d0) / (d1 - d0) else 0 end) + 0.4 * (1 - case when b1 > b0 then (b - b0) / (b1 - b0) else 0.5 end) score from p, m)
select doc_id, round(score, 6) score from s order by round(s.score, 12), doc_id limit 10"""
)
def hybrid_linear(spark, d):
    return fusion.hybrid_linear(_both(spark, d), _vector(spark, d, 0), WORDS, 10, 0.4).withColumn("score", _r("score"))


@query(
    _HYBRID
    + """, u as (select doc_id from pool union (select doc_id from b order by round(b, 9) desc, doc_id limit 100)),
pu as (select doc_id, d, coalesce(b, 0) b from u join jd using (doc_id) left join b using (doc_id)),
r as (select *, row_number() over (order by round(d, 12), doc_id) - 1 vr, row_number() over (order by round(b, 9) desc, doc_id) - 1 br from pu),
s as (select doc_id, 0.6 / (60 + vr) + 0.4 / (60 + br) score from r)
select doc_id, round(score, 8) score from s order by round(s.score, 12) desc, doc_id limit 10"""
)
def hybrid_union(spark, d):
    return fusion.hybrid_rrf(_both(spark, d), _vector(spark, d, 0), WORDS, 10, 0.4, union=True).withColumn("score", _r("score", 8))


def _arms_sql(w1: float, w2: float) -> str:
    arm = "select vec_id, row_number() over (order by round(dist, 12), vec_id) rank from (select vec_id, list_cosine_distance(v, {q}) dist from e) order by rank limit 20"
    q1 = "(select embedding::double[] from embeddings where vec_id = 1)"
    return f"""
with e as ({_E}), a as ({arm.format(q=_Q0)}), b as ({arm.format(q=q1)}),
s as (select vec_id, sum(s) s from (select vec_id, {w1} / (60 + rank) s from a union all select vec_id, {w2} / (60 + rank) from b) group by all)
select vec_id, round(-s, 8) distance, row_number() over (order by round(s, 12) desc, vec_id) rank from s order by rank limit 10"""


def _arms(spark: SparkSession, d: str, w1: float, w2: float) -> DataFrame:
    qs = [("embedding", _vector(spark, d, 0), w1), ("embedding", _vector(spark, d, 1), w2)]
    return fusion.search_multimodal(_emb(spark, d), qs, 10, key="vec_id").withColumn("distance", _r("distance", 8))


@query(_arms_sql(1.0, 1.0))
def multimodal_rrf(spark, d):
    return _arms(spark, d, 1.0, 1.0)


@query(_arms_sql(2.0, 0.5))
def multimodal_weighted(spark, d):
    return _arms(spark, d, 2.0, 0.5)


# -- tables: snapshots, deletes, change feeds -----------------------------------------------------------------------


def _place(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_folder(spark).removeprefix("file://"), "tables", f"{name}-{uuid.uuid4().hex}")


def _order_table(spark: SparkSession, d: str) -> tuple[Table, list[int]]:
    """orders before 1997, then from 1997; a delete by value; the deleted customers' late orders come again."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("o_orderdate"))
    t = Table.create(spark, _place(spark, "orders"), o.schema)
    early = F.col("o_orderdate") < "1997-01-01"
    s1 = t.append(o.where(early))
    s2 = t.append(o.where(~early))
    s3 = t.delete_where({"o_custkey": [1, 2, 3, 5, 8, 13, 21, 34, 55, 89]})
    s4 = t.append(o.where((F.col("o_custkey") == 13) & ~early).withColumn("o_totalprice", F.col("o_totalprice") + 1))
    return t, [s1, s2, s3, s4]


_O = "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate::date o_orderdate from orders"
_GONE = "o_custkey in (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)"
_SUMS = "count(*) n, round(sum(o_totalprice), 2) total, cast(sum(o_orderkey) as bigint) keys"


def _sums(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.sum("o_orderkey").alias("keys"))


@query(f"select {_SUMS} from ({_O}) where o_orderdate < '1997-01-01'")
def snapshot_time_travel(spark, d):
    t, snaps = _order_table(spark, d)
    return _sums(t.scan(snaps[0]))


@query(f"with o as ({_O}) select o_custkey, {_SUMS} from (select * from o where not ({_GONE}) union all select * replace (o_totalprice + 1 as o_totalprice) from o where o_custkey = 13 and o_orderdate >= '1997-01-01') group by all")
def equality_delete(spark, d):
    t, _ = _order_table(spark, d)
    out = t.scan().groupBy("o_custkey")
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.sum("o_orderkey").alias("keys"))


@query(f"select {_SUMS} from ({_O}) where o_orderkey % 7 <> 0")
def positional_delete(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("o_orderdate"))
    t = Table.create(spark, _place(spark, "positions"), o.schema)
    t.append(o)
    t.delete_positions(t.scan(with_identity=True).where("o_orderkey % 7 = 0"))
    return _sums(t.scan())


_NET = f"""with o as ({_O}),
c as (
  select o_orderkey, o_custkey, o_totalprice, 'insert' _change_type from o where o_orderdate >= '1997-01-01' and not ({_GONE})
  union all select o_orderkey, o_custkey, o_totalprice + 1, 'insert' from o where o_custkey = 13 and o_orderdate >= '1997-01-01'
  union all select o_orderkey, o_custkey, o_totalprice, 'delete' from o where o_orderdate < '1997-01-01' and {_GONE})"""


@query(f"{_NET} select _change_type, o_orderkey, o_custkey, round(o_totalprice, 2) o_totalprice from c")
def cdc_net_changes(spark, d):
    t, snaps = _order_table(spark, d)
    return t.read_changes(snaps[0], snaps[3]).select("_change_type", "o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query(
    f"""with o as ({_O}),
c as (
  select o_orderkey, o_totalprice, case when o_custkey = 13 and o_orderdate >= '1997-01-01' then 'update_before' else 'delete' end _change_type from o where {_GONE}
  union all select o_orderkey, o_totalprice + 1, 'update_after' from o where o_custkey = 13 and o_orderdate >= '1997-01-01')
select _change_type, o_orderkey, round(o_totalprice, 2) o_totalprice from c"""
)
def cdc_coalesced(spark, d):
    t, snaps = _order_table(spark, d)
    return t.read_changes(snaps[1], snaps[3], key=["o_orderkey"]).select("_change_type", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query(f"with o as ({_O}) select {_SUMS} from (select * from o where not ({_GONE}) union all select * replace (o_totalprice + 1 as o_totalprice) from o where o_custkey = 13 and o_orderdate >= '1997-01-01')")
def compaction_keeps_rows(spark, d):
    t, _ = _order_table(spark, d)
    t.compact(min_files=2)
    return _sums(t.scan())


@query("select c_custkey, c_name full_name, c_acctbal, case when c_nationkey < 10 then 'unknown' else 'en' end lang from customer")
def schema_fill(spark, d):
    c = table(spark, d, "customer")
    t = Table.create(spark, _place(spark, "customers"), c.select("c_custkey", "c_name", "c_acctbal").schema)
    t.append(c.where("c_nationkey < 10").select("c_custkey", "c_name", "c_acctbal"))
    t.evolve(rename={"c_name": "full_name"}, add={"lang": ("string", "unknown")})
    t.append(c.where("c_nationkey >= 10").select("c_custkey", F.col("c_name").alias("full_name"), "c_acctbal", F.lit("en").alias("lang")))
    return t.scan()


@query("select l_returnflag partition_value, cast(sum(1) as bigint) \"rows\" from lineitem group by all")
def partition_stats(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    t = Table.create(spark, _place(spark, "lines"), li.schema, partition_by=["l_returnflag"])
    t.append(li)
    return t.partition_stats().select("partition_value", "rows")


@query("""
select 'early' as "when", count(*) filter (label < 3) as "rows", 1 indexed, 0 indexing from embeddings
union all select 'late', count(*), 1, 1 from embeddings union all select 'done', count(*), 2, 0 from embeddings""")
def table_info(spark, d):
    """Rows and files by index status: after an append, after a deferred one, and after its indexing."""
    e = _emb(spark, d)
    t = Table.create(spark, _place(spark, "vectors"), e.schema, vectors=[VectorColumn("embedding", 64)])
    t.append(e.where("label < 3").coalesce(1))
    out = t.info().withColumn("when", F.lit("early"))
    t.append(e.where("label >= 3").coalesce(1), deferred=True)
    out = out.unionByName(t.info().withColumn("when", F.lit("late")))
    t.index_files()
    return out.unionByName(t.info().withColumn("when", F.lit("done"))).select("when", "rows", F.col("indexed").cast("int").alias("indexed"), F.col("indexing").cast("int").alias("indexing"))


@query(f"with e as ({_E}) select vec_id, round(list_cosine_distance(v, {_Q0}), 6) dist from e where label <> 3 order by list_cosine_distance(v, {_Q0}), vec_id limit 10")
def search_live_table(spark, d):
    """A search over the live view of a table after a delete."""
    e = _emb(spark, d)
    t = Table.create(spark, _place(spark, "vectors"), e.schema, vectors=[VectorColumn("embedding", 64)])
    t.append(e)
    t.delete_where({"label": [3]})
    return knn.search(t.scan(), _vector(spark, d, 0), 10, key="vec_id").select("vec_id", _r("_distance").alias("dist"))


@query(f"{_BM25} select doc_id, round(score, 6) score from b order by round(b.score, 9) desc, doc_id limit 20")
def table_text_search(spark, d):
    """The stored postings and statistics of a table answer."""
    t = Table.create(spark, _place(spark, "texts"), "doc_id long, text string", properties={"text.columns": "text"})
    t.append(table(spark, d, "documents").select("doc_id", "text").orderBy("doc_id").coalesce(1))
    textindex.build_text_index(t)
    return api.search_text(t, WORDS, ["text"], 20).to_df().select("doc_id", _r(-F.col("_distance")).alias("score"))


@query(
    """
with t as (select doc_id % 40 p, unnest(list_transform(regexp_split_to_array(text, '[^\\p{L}\\p{N}]+'), lambda t: lower(t))) w from documents where text is not null),
f as (select p from t group by p having max((w = 'quorum')::int) = 1)
select count(*) files_that_hold_it, count(*) of_these_kept from f"""
)
def table_bloom_prune(spark, d):
    """Files of a table that may hold a word, by stored filters: none that holds it is left out."""
    docs = table(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 40).cast("string").alias("p"))
    t = Table.create(spark, _place(spark, "texts"), docs.schema, partition_by=["p"], properties={"text.columns": "text"})
    t.append(docs.coalesce(1))
    textindex.build_text_index(t)
    kept = textindex.may_hold(t, "quorum").select("path", F.lit(1).alias("kept"))
    has = textindex.postings(t, ["quorum"]).select(F.col("file").alias("path")).distinct()
    return has.join(kept, "path", "left").agg(F.count(F.lit(1)).alias("files_that_hold_it"), F.count("kept").alias("of_these_kept"))


_NEAREST = f"with e as ({_E}) select vec_id, round(list_cosine_distance(v, {_Q0}), 6) dist from e where {{0}} order by list_cosine_distance(v, {_Q0}), vec_id limit 10"


def _indexed(spark: SparkSession, d: str, kind: str, **how) -> Table:
    """A table with an index, rows deleted after it was built, and a file that it does not cover."""
    e = _emb(spark, d)
    t = Table.create(spark, _place(spark, "indexed"), e.schema, vectors=[VectorColumn("embedding", 64)])
    t.append(e.where("vec_id % 10 <> 7"))
    index.build_index(t, kind, **how)
    t.delete_where({"label": [3]})
    t.append(e.where("vec_id % 10 = 7 and label <> 3"))
    return t


@query(_NEAREST.format("label <> 3"))
def table_search_ivf(spark, d):
    """The stored cells and codes of a table answer, newer files are compared in full."""
    t = _indexed(spark, d, "ivf_pq", nlist=16, pq_m=16)
    return api.search(t, _vector(spark, d, 0), 10, nprobe=15).to_df().select("vec_id", _r("_distance").alias("dist"))


@query(_NEAREST.format("label <> 3"))
def table_search_graph(spark, d):
    t = _indexed(spark, d, "graph", shard_rows=2500)
    return api.search(t, _vector(spark, d, 0), 10).to_df().select("vec_id", _r("_distance").alias("dist"))


@query(_NEAREST.format("label not in (1, 3)"))
def table_search_filtered(spark, d):
    """A predicate after the index: more candidates are taken until ten rows meet it."""
    t = _indexed(spark, d, "ivf_pq", nlist=16, pq_m=16)
    return api.search(t, _vector(spark, d, 0), 10, where="label <> 1", nprobe=16).to_df().select("vec_id", _r("_distance").alias("dist"))


@query(_NEAREST.format("true"))
def search_not_ready(spark, d):
    """Files without an index are compared in full."""
    e = _emb(spark, d)
    t = Table.create(spark, _place(spark, "deferred"), e.schema, vectors=[VectorColumn("embedding", 64)])
    t.append(e, deferred=True)
    return api.search(t, _vector(spark, d, 0), 10).to_df().select("vec_id", _r("_distance").alias("dist"))


@query(_BATCH + "select query_id, vec_id, rank from r where rank <= 5 and query_id <> vec_id")
def search_session(spark, d):
    """Many queries against a table that is loaded once."""
    e = _emb(spark, d)
    t = Table.create(spark, _place(spark, "session"), e.schema, vectors=[VectorColumn("embedding", 64)])
    t.append(e)
    session = api.SearchSession(t)
    q = e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    hits = session.search_batch(q, 6).join(session.rows.select("_row_id", "vec_id"), "_row_id").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long")
    return hits.withColumn("rank", rank).where("rank <= 5").select("query_id", "vec_id", "rank")


@query(f"with e as ({_E}) select vec_id, round(v[1] * 2, 6) doubled from e")
def migrate_vectors(spark, d):
    e = _emb(spark, d)
    t = Table.create(spark, _place(spark, "vectors"), e.schema, vectors=[VectorColumn("embedding", 64)])
    t.append(e)
    t.migrate(lambda c: F.transform(c, lambda x: x * 2), "embedding", VectorColumn("embedding_v2", 64, model="twice@v2"), dual=True)
    t.cut_over("embedding_v2")
    return t.scan().select("vec_id", _r(F.col("embedding_v2")[0].cast("double")).alias("doubled"))


@query("""
select 'l_orderkey' as "column", count(l_orderkey) as n_values, count(*) - count(l_orderkey) as n_nulls, min(l_orderkey)::double least, max(l_orderkey)::double greatest from lineitem
union all select 'l_quantity', count(l_quantity), count(*) - count(l_quantity), min(l_quantity)::double, max(l_quantity)::double from lineitem
union all select 'l_linestatus', count(l_linestatus), count(*) - count(l_linestatus), null, null from lineitem
union all select 'late', count(*) filter (l_linenumber > 3), count(*) filter (l_linenumber <= 3), min(l_extendedprice) filter (l_linenumber > 3)::double, max(l_extendedprice) filter (l_linenumber > 3)::double from lineitem""")
def column_stats(spark, d):
    """Facts of the data files of a table, from their footers, put together by column."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_linestatus", F.when(F.col("l_linenumber") > 3, F.col("l_extendedprice")).alias("late"))
    t = Table.create(spark, _place(spark, "lines"), li.schema)
    t.append(li)
    number = lambda c: F.col(c).try_cast("double")
    return t.column_stats().groupBy("column").agg(
        F.sum("values").alias("n_values"), F.sum("nulls").alias("n_nulls"), F.min(number("least")).alias("least"), F.max(number("greatest")).alias("greatest")
    )


@query("select o_custkey - ((o_custkey % 100) + 100) % 100 bucket, substr(o_orderpriority, 1, 3) prefix, count(*) n from orders group by all")
def partition_truncate(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(text.truncate_int(F.col("o_custkey"), 100).alias("bucket"), text.truncate_text(F.col("o_orderpriority"), 3).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


# -- memories, contexts, storage ------------------------------------------------------------------------------------


@query(f"select event_id, round(exp(-0.099 * greatest(datediff('day', ts::date, date '{AS_OF[:10]}'), 0)), 6) recency_weight from events")
def memory_decay(spark, d):
    out = memory.decay(table(spark, d, "events"), F.lit(AS_OF).cast("date"), at="ts")
    return out.select("event_id", _r("recency_weight").alias("recency_weight"))


@query(f"select event_id, round(exp(-0.023 * greatest(epoch_us(timestamp '{AS_OF}' - ts) / 86400000000.0, 0)), 6) w from events")
def recency_fractional(spark, d):
    w = memory.recency_weight(F.lit(AS_OF).cast("timestamp"), F.col("ts"), memory.MONTHLY)
    return table(spark, d, "events").select("event_id", _r(w).alias("w"))


@query("select event_id, user_id from (select *, row_number() over (partition by user_id order by event_id desc) r from events) where r <= 5")
def working_memory_last_n(spark, d):
    return memory.working_memory(table(spark, d, "events"), 5, ["user_id"], "event_id").select("event_id", "user_id")


@query(
    f"""
with e as ({_E}), m as (
  select vec_id, list_cosine_distance(v, {_Q0}) dist, exp(-0.099 * greatest(epoch_us(timestamp '{AS_OF}' - ts) / 86400000000.0, 0)) rec,
    coalesce(1 / (1 + abs(value)), 1) imp from e join events on event_id = vec_id),
n as (select * from m order by dist, vec_id limit 30)
select vec_id, round(dist / greatest(rec * imp, 1.1920929e-07), 5) score from n order by dist / greatest(rec * imp, 1.1920929e-07), vec_id limit 10"""
)
def memory_recall(spark, d):
    ev = table(spark, d, "events").select(F.col("event_id").alias("vec_id"), F.col("ts").alias("last_accessed_at"), (1 / (1 + F.abs("value"))).alias("importance"))
    m = _emb(spark, d).join(ev, "vec_id")
    out = memory.recall(m, _vector(spark, d, 0), F.lit(AS_OF).cast("timestamp"), 10, 3, key="vec_id")
    return out.select("vec_id", _r("_score", 5).alias("score"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Text hits of every query as chunks: the topic is the document, the id its place."""
    hits = table(spark, d, "docs_search").where("arm = 'text' and distance is not null and not isnan(distance)")
    hits = hits.groupBy("query_id", "row_id").agg(F.min("distance").cast("double").alias("distance"))
    w = Window.partitionBy("id").orderBy(F.col("ingested_at").desc_nulls_last())
    docs = table(spark, d, "docs_ingest").withColumn("r", F.row_number().over(w)).where("r = 1")
    docs = docs.select("id", F.col("topic_id").cast("string").alias("document_id"), F.col("text").alias("chunk_text"), "embedding")
    return hits.join(docs, hits["row_id"] == docs["id"]).where("chunk_text is not null").select("query_id", "document_id", F.col("id").alias("chunk_index"), "chunk_text", "distance", "embedding")


_CHUNKS = """
with h as (select query_id, row_id, min(distance)::double distance from docs_search where arm = 'text' and distance is not null and not contains(distance::varchar, 'nan') group by all),
t as (select * from (select id, topic_id::varchar document_id, text chunk_text, row_number() over (partition by id order by ingested_at desc nulls last) r from docs_ingest) where r = 1),
c as (select query_id, document_id, id chunk_index, chunk_text, distance from h join t on row_id = id where chunk_text is not null)
"""


@query(
    _CHUNKS
    + """, a as (select *, row_number() over (partition by query_id order by distance, document_id, chunk_index) pos from c),
b as (select *, min(pos) over (partition by query_id, document_id) f from a),
g as (select *, dense_rank() over (partition by query_id order by f) doc_no, row_number() over (partition by query_id, document_id order by chunk_index, pos) chunk_no from b)
select query_id, chunk_index, doc_no, chunk_no from g where chunk_no <= 10"""
)
def context_group(spark, d):
    return context.order_chunks(_chunks(spark, d).drop("embedding")).select("query_id", "chunk_index", "doc_no", "chunk_no")


@query(
    _CHUNKS
    + """, r as (select *, row_number() over (partition by query_id order by distance, chunk_index) rank from c),
s as (select *, coalesce(sum(strlen(chunk_text) + 2) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0) b from r),
n as (select *, (case when b > 0 then b - 2 else 0 end + strlen(chunk_text) + 2 > 1200) no from s),
k as (select *, max(no::int) over (partition by query_id order by rank) stop from n)
select query_id, string_agg(chunk_text, chr(10) || chr(10) order by rank) "text", count(*) chunk_count from k where stop = 0 group by all"""
)
def context_budget(spark, d):
    c = _chunks(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_index")))
    return context.assemble_texts(c, text="chunk_text", max_tokens=300).drop("token_estimate")


@query()
def context_assembly(spark, d):
    return context.assemble_chunks(_chunks(spark, d), max_tokens=500)


@query(
    """
select m as mode, v as a, i as b from (values
 ('F32 (baseline)', 10000000::bigint * 768 * 4, 2880000000::bigint), ('F16 (default)', 10000000::bigint * 768 * 2, 2880000000::bigint),
 ('I8', 10000000::bigint * 768, 2880000000::bigint), ('F16 + IVF-PQ index', 10000000::bigint * 768 * 2, 240000000::bigint),
 ('I8  + IVF-PQ index', 10000000::bigint * 768, 240000000::bigint), ('PQ-only (--pq-only)', 0::bigint, 240000000::bigint)) x(m, v, i)"""
)
def storage_estimate(spark, d):
    t = estimate.storage_table(spark, "10M", 768, 16)
    return t.select("mode", F.col("vectors_bytes").alias("a"), F.col("index_bytes").alias("b"))


# -- what the host engine brings ------------------------------------------------------------------------------------


@query("""
select n_name, o_orderpriority, count(*) n_orders, round(sum(o_totalprice), 2) total
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by rollup (n_name, o_orderpriority)""")
def star_join_rollup(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.rollup("n_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end f from events),
s as (select *, sum(f) over (partition by user_id order by ts rows unbounded preceding) sid from g)
select user_id, count(*) n, round(sum(value), 2) total, min(event_id) first_event from s group by user_id, sid""")
def session_windows(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.min("event_id").alias("first_event")
    ).drop("session_window")


@query("""
select event_type, date_trunc('hour', ts) as "hour", count(*) n, round(sum(value), 2) total from events group by all""")
def tumbling_windows(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(
        "event_type", F.col("w.start").alias("hour"), "n", "total"
    )


@query("""
select query_arm, count(*) n, sum(case when hit then 1 else 0 end)::bigint in_table from (
  select arm query_arm, row_id in (select id from docs_ingest) hit from docs_search where row_id is not null) group by all""")
def semi_anti_hits(spark, d):
    ids = table(spark, d, "docs_ingest").select(F.col("id").alias("row_id")).distinct().withColumn("hit", F.lit(1))
    h = table(spark, d, "docs_search").where("row_id is not null").join(ids, "row_id", "left")
    return h.groupBy(F.col("arm").alias("query_arm")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("hit", F.lit(0))).cast("long").alias("in_table"))
