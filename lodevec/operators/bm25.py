"""Lexical search: corpus statistics, BM25, inverted index, boolean and phrase queries, term pruning."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodevec.functions.text import MIN_TOKEN_BYTES, tokens

K1, B = 1.2, 0.75
VOCABULARY = 50_000


def query_tokens(query: str) -> list[str]:
    """A query in the same tokens as the texts; repeated ones stay."""
    return [t.lower() for t in re.split(r"[^\w]+|_", query) if len(t.encode()) >= MIN_TOKEN_BYTES]


def term_counts(df: DataFrame, text: str = "text", key: str = "doc_id", tokenizer=tokens) -> DataFrame:
    """(key, term, tf, doc_len); documents without tokens have no rows.  One shuffle, combined before it."""
    words = df.select(key, F.explode(F.array(tokenizer(text))).alias("__t")).where(F.size("__t") > 0)
    return words.select(key, F.size("__t").cast("long").alias("doc_len"), F.explode("__t").alias("term")).groupBy(key, "term").agg(
        F.count(F.lit(1)).alias("tf"), F.first("doc_len").alias("doc_len")
    )


def corpus_stats(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_count, total_tokens, avg_doc_len) in one row, over documents with a token; the average is 1 without any."""
    n = token_rows(df, text, key).select(F.size("t").alias("n"))
    return n.agg(F.count(F.lit(1)).alias("doc_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_tokens"), F.coalesce(F.avg("n"), F.lit(1.0)).alias("avg_doc_len"))


def idf_value(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def idf_table(df: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: int | None = VOCABULARY) -> DataFrame:
    """(term, df, idf), each document counted once for a term; cut to the terms of highest df, ties by the term."""
    counts = token_rows(df, text, key).select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if vocabulary is not None:
        counts = counts.orderBy(F.desc("df"), "term").limit(vocabulary)
    return counts.crossJoin(F.broadcast(corpus_stats(df, text, key).select("doc_count"))).select("term", "df", idf_value(F.col("doc_count"), F.col("df")).alias("idf"))


def token_rows(df: DataFrame, text: str = "text", key: str = "doc_id", *more: str) -> DataFrame:
    """(key, more, t): rows with at least one token.  The array comes out of a generator, so Spark makes it once a row, whatever filters and sums follow."""
    return df.select(key, *more, F.explode(F.array(tokens(text))).alias("t")).where(F.size("t") > 0)


def scores(
    df: DataFrame, query: str, text: str = "text", key: str = "doc_id", k1: float = K1, b: float = B, within: DataFrame | None = None
) -> DataFrame:
    """(key, score) of every document with a positive score; repeated query terms count again.

    The counts of the query's terms are taken from the tokens of each row where it lies; only two small
    aggregates (corpus numbers, and df of the query's terms) are computed before.  With ``within`` (a few rows of keys) the scores of these alone are given,
    by the numbers of the whole corpus.
    """
    wanted = Counter(query_tokens(query))
    if not wanted:
        return df.select(key, F.lit(0.0).alias("score")).where("false")
    terms = list(wanted)
    tf = [_count_of("t", x).alias(f"tf_{i}") for i, x in enumerate(terms)]
    rows = token_rows(df, text, key).select(key, F.size("t").cast("double").alias("n"), *tf)
    facts = rows.agg(
        F.count(F.lit(1)).alias("__docs"), F.avg("n").alias("__avg"), *[F.sum((F.col(f"tf_{i}") > 0).cast("long")).alias(f"df_{i}") for i in range(len(terms))]
    )
    if within is not None:
        few = df.join(F.broadcast(within.select(key)), key, "left_semi")
        rows = token_rows(few, text, key).select(key, F.size("t").cast("double").alias("n"), *tf)
    found = F.lit(0)
    for i in range(len(terms)):
        found = found + F.col(f"tf_{i}")
    rows = rows.where(found > 0).crossJoin(F.broadcast(facts))  # one row of facts
    score = F.lit(0.0)
    for i, term in enumerate(terms):
        score = score + F.lit(float(wanted[term])) * term_score(F.col(f"tf_{i}").cast("double"), F.col("n"), F.col(f"df_{i}"), F.col("__docs"), F.col("__avg"), k1, b)
    return rows.select(key, score.alias("score"))


def term_score(tf: Column, n: Column, df: Column, docs: Column, avg: Column, k1: float = K1, b: float = B) -> Column:
    """What one term adds to a document's score."""
    return idf_value(docs, df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / avg))


def _count_of(array: str, term: str) -> Column:
    return F.size(F.filter(array, lambda w: w == F.lit(term)))


def search_text(df: DataFrame, query: str, k: int = 10, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The k best documents with ``score``, ties to the lower key."""
    return scores(df, query, text, key).orderBy(F.round("score", 9).desc(), key).limit(k)


def inverted_index(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(term, key, tf, positions): write it partitioned or bucketed by term to prune by query terms.

    Positions count all tokens of the text from 0.
    """
    words = df.select(key, F.posexplode(tokens(text)).alias("pos", "term"))
    return words.groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def match_all(index: DataFrame, terms: list[str], key: str = "doc_id") -> DataFrame:
    """Documents that hold every term."""
    want = sorted(set(terms))
    hits = index.where(F.col("term").isin(want)).groupBy(key).agg(F.count_distinct("term").alias("n"))
    return hits.where(F.col("n") == len(want)).select(key)


def match_any(index: DataFrame, terms: list[str], key: str = "doc_id") -> DataFrame:
    """Documents that hold at least one term."""
    return index.where(F.col("term").isin(sorted(set(terms)))).select(key).distinct()


def match_phrase(index: DataFrame, terms: list[str], key: str = "doc_id") -> DataFrame:
    """Documents in which the terms follow each other.

    Each position is moved back by the term's place in the phrase; a document matches where all places agree.
    """
    want = index.where(F.col("term").isin(sorted(set(terms)))).select(key, "term", F.explode("positions").alias("pos"))
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(terms)])
    starts = want.select(key, F.explode(F.filter(places, lambda p: p["t"] == F.col("term"))).alias("p"), "pos").select(
        key, (F.col("pos") - F.col("p.i")).alias("start"), F.col("p.i").alias("i")
    )
    full = starts.groupBy(key, "start").agg(F.count_distinct("i").alias("n")).where(F.col("n") == len(terms))
    return full.select(key).distinct()


def boolean_search(df: DataFrame, query: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Documents for a query of words (any of them), +word (must), -word (must not) and "phrases" (as must with +).

    Words that are no token are ignored; a query without any gives none.  A query of only excluded words gives none.
    """
    index = inverted_index(df, text, key)
    parts = re.findall(r'([+-]?)(?:"([^"]*)"|(\S+))', query)
    must, may, never = [], [], []
    for sign, phrase, word in parts:
        terms = query_tokens(phrase or word)
        if not terms:
            continue
        hits = match_phrase(index, terms, key) if len(terms) > 1 else match_any(index, terms, key)
        (must if sign == "+" else never if sign == "-" else may).append(hits)
    if must:
        out = must[0]
        for h in must[1:]:
            out = out.join(h, key, "left_semi")
    elif may:
        out = may[0]
        for h in may[1:]:
            out = out.union(h)
        out = out.distinct()
    else:
        return df.select(key).where("false")
    for h in never:
        out = out.join(h, key, "left_anti")
    return out


def ranked_boolean(df: DataFrame, query: str, k: int = 10, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The k best of the matching documents by BM25 over the query's words."""
    words = " ".join(w for sign, p, x in re.findall(r'([+-]?)(?:"([^"]*)"|(\S+))', query) if sign != "-" for w in [p or x])
    hits = boolean_search(df, query, text, key)
    return scores(df, words, text, key).join(hits, key, "left_semi").orderBy(F.round("score", 9).desc(), key).limit(k)


def file_terms(df: DataFrame, file: str, text: str = "text") -> DataFrame:
    """(file, term): exact term sets of each file, for pruning without false positives."""
    return df.select(file, F.explode(tokens(text)).alias("term")).distinct()


def prune_by_terms(terms: DataFrame, query: str, file: str) -> DataFrame:
    """Files that hold any term of the query."""
    return terms.where(F.col("term").isin(sorted(set(query_tokens(query))))).select(file).distinct()
