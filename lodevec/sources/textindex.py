"""Text statistics, an inverted index and Bloom filters that live with a table, so that a text search tokenises nothing.

Postings are Parquet, partitioned by a hash of the term, so a query reads the buckets of its terms only; document counts and token totals are in the table's
metadata, by part.  As in the files, rows deleted later still count in the statistics until the index is built anew; they are never found.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodevec.functions import text as tx
from lodevec.operators import bm25
from lodevec.plans import prune
from lodevec.session import spread
from lodevec.sources.table import FILE, ROW_ID, Table

BUCKETS = 32
FIRST_FACTOR, GROWTH = 3, 4
TOKENIZERS = {
    "words": lambda c: tx.tokens(c),
    "english": lambda c: tx.light_stems(tx.without_stop_words(tx.tokens(c), "en")),
    "portuguese": lambda c: tx.without_stop_words(tx.tokens(c), "pt"),
    "ngrams": lambda c: tx.character_ngrams(c, 2, 3),
}


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def state(table: Table) -> dict | None:
    return table.meta.get("text_index")


def build_text_index(table: Table, columns: Sequence[str] | None = None, tokenizer: str | None = None, rebuild: bool = False) -> dict:
    """Index the text columns of all files, or of those that came since; the state as kept in the metadata.

    Columns and tokenizer come from the table's properties ``text.columns`` and ``text.tokenizer`` where they are not given.
    """
    props, old = table.meta["properties"], None if rebuild else state(table)
    columns = list(columns or (old or {}).get("columns") or [c for c in props.get("text.columns", "").split(",") if c])
    tokenizer = tokenizer or (old or {}).get("tokenizer") or props.get("text.tokenizer", "words")
    if not columns:
        raise ValueError("no text columns")
    if tokenizer not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {tokenizer!r}; known: {', '.join(TOKENIZERS)}")
    if old is not None and (old["columns"], old["tokenizer"]) != (columns, tokenizer):
        old = None
    parts = list(old["parts"]) if old else []
    files = table.files()
    todo = files.join(covered(table, parts), "path", "left_anti") if parts else files
    paths = [r["path"] for r in todo.select("path").collect()]
    if paths:
        place = f"{table.root}/text/{uuid.uuid4().hex}"
        rows = table.scan(files=todo, with_identity=True).select(F.col(ROW_ID).alias("row_id"), F.col(FILE).alias("file"), tx.joined_text(*columns).alias("text"))
        each = spread(rows).select("row_id", "file", F.explode(F.array(TOKENIZERS[tokenizer]("text"))).alias("t")).where(F.size("t") > 0)
        words = each.select("row_id", "file", F.size("t").alias("n"), F.posexplode("t").alias("pos", "term"))
        postings = words.groupBy("row_id", "file", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("n").alias("n"), F.sort_array(F.collect_list("pos")).alias("positions"))
        postings = postings.withColumn("bucket", _bucket(F.col("term")))
        postings.repartition("bucket").sortWithinPartitions("bucket", "term", "row_id").write.partitionBy("bucket").parquet(f"{place}/postings")
        stored = table.spark.read.parquet(f"{place}/postings")
        facts = stored.agg(F.count_distinct("row_id").alias("docs"), F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens")).first()
        prune.bloom_filters(stored.select("file", "term"), "file").coalesce(1).write.parquet(f"{place}/blooms")
        table.spark.createDataFrame([(p,) for p in paths], "path string").coalesce(1).write.parquet(f"{place}/files")
        parts.append({"path": place, "docs": facts["docs"], "tokens": facts["tokens"]})
    new = {"columns": columns, "tokenizer": tokenizer, "parts": parts}
    table.log.update(lambda m: m | {"text_index": new})
    return new


def covered(table: Table, parts: Sequence[dict]) -> DataFrame:
    return table.spark.read.parquet(*[f"{p['path']}/files" for p in parts])


def complete(table: Table) -> bool:
    """Whether the index covers all present files."""
    s = state(table)
    return bool(s and s["parts"]) and table.files().join(covered(table, s["parts"]), "path", "left_anti").limit(1).count() == 0


def query_terms(table: Table, query: str) -> Counter:
    """The terms of a query, made as those of the texts."""
    s = state(table)
    if s["tokenizer"] == "words":
        return Counter(bm25.query_tokens(query))
    row = table.spark.range(1).select(TOKENIZERS[s["tokenizer"]](F.lit(query)).alias("t")).first()
    return Counter(row["t"] or [])


def postings(table: Table, terms: Iterable[str]) -> DataFrame:
    """(row_id, file, term, tf, n, positions) of the given terms: only their buckets are read."""
    terms, out = sorted(set(terms)), None
    buckets = [r["b"] for r in table.spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t")).alias("b")).distinct().collect()] if terms else []
    for p in state(table)["parts"]:
        part = table.spark.read.parquet(f"{p['path']}/postings").where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        out = part if out is None else out.unionByName(part)
    return out.drop("bucket")


def scores(table: Table, query: str, k1: float = bm25.K1, b: float = bm25.B) -> DataFrame:
    """(row_id, file, score) of every indexed row that holds a term of the query."""
    s = state(table)
    docs, total = sum(p["docs"] for p in s["parts"]), sum(p["tokens"] for p in s["parts"])
    wanted = query_terms(table, query)
    hits = postings(table, wanted)
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    times = F.create_map(*[F.lit(x) for t, c in wanted.items() for x in (t, float(c))]) if wanted else F.create_map(F.lit(""), F.lit(0.0))
    part = times[F.col("term")] * bm25.term_score(F.col("tf").cast("double"), F.col("n").cast("double"), F.col("df"), F.lit(docs), F.lit(total / docs if docs else 1.0), k1, b)
    # one row for each term of the query
    return hits.join(F.broadcast(df), "term").groupBy("row_id", "file").agg(F.sum(part).alias("score"))


def search(table: Table, query: str, k: int = 10) -> DataFrame | None:
    """The k best live rows with their identity and ``_distance`` = -score, or None if the index does not cover all files.

    Three k candidates come from the postings, more while too few of them are live.
    """
    if not complete(table):
        return None
    ranked = scores(table, query).orderBy(F.round("score", 9).desc(), "row_id")
    n = k * FIRST_FACTOR
    while True:
        got = ranked.limit(n).collect()
        names = table.spark.createDataFrame([(r["row_id"], -r["score"]) for r in got], f"{ROW_ID} long, _distance double")
        rows = table.scan(paths=sorted({r["file"] for r in got}), with_identity=True).where(F.col(ROW_ID).isin([r["row_id"] for r in got])).join(F.broadcast(names), ROW_ID)
        if len(got) < n or rows.limit(k).count() >= k:
            return rows.orderBy(F.round("_distance", 9), ROW_ID).limit(k)
        n *= GROWTH


def may_hold(table: Table, query: str) -> DataFrame:
    """The files (of the manifest) that may hold a term of the query, by their Bloom filters; files without a filter stay."""
    s, files = state(table), table.files()
    if not s or not s["parts"]:
        return files
    blooms = table.spark.read.parquet(*[f"{p['path']}/blooms" for p in s["parts"]]).withColumnRenamed("file", "path")
    kept = files.join(covered(table, s["parts"]).join(prune.by_bloom(blooms, query_terms(table, query)), "path", "left_anti"), "path", "left_anti")
    return kept
