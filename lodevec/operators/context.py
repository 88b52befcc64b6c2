"""Assembling retrieved chunks into a bounded context.

Chunks of one query are at most some hundreds (its top k); the order-dependent removal of near copies runs
on those in one task for each query, everything else is windows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodevec.functions.text import escape_xml

MAX_CHUNKS = 10_000


def drop_near_copies(chunks: DataFrame, query: str = "query_id", threshold: float = 0.05) -> DataFrame:
    """Chunks in order of distance, without those whose cosine distance to a kept one is under ``threshold``.

    Columns: query, document_id, chunk_index, distance, embedding and others, which are kept.  Chunks without a vector
    stay.  A query with more than 10,000 chunks fails: a context is made from a top-k result.
    """

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_CHUNKS:
            raise ValueError("too many chunks for one context")
        pdf = pdf.sort_values(["distance", "document_id", "chunk_index"], kind="stable", na_position="last")
        # vectors of different lengths are never near; zero ones and damaged ones neither
        by_length: dict[int, list[int]] = {}
        unit: list[np.ndarray | None] = []
        for v in pdf["embedding"]:
            x = np.asarray(v, np.float64) if v is not None else np.zeros(0)
            n = np.linalg.norm(x) if len(x) and np.isfinite(x).all() else 0.0
            unit.append(x / n if n > 0 else None)
        chosen = []
        for i, x in enumerate(unit):
            if x is not None:
                kept = by_length.setdefault(len(x), [])
                if kept and 1 - (np.stack([unit[j] for j in kept]) @ x).max() < threshold:
                    continue
                kept.append(i)
            chosen.append(i)
        return pdf.iloc[chosen]

    return chunks.groupBy(query).applyInPandas(keep, chunks.schema)


def order_chunks(chunks: DataFrame, query: str = "query_id", per_document: int = 10, by_document: bool = True) -> DataFrame:
    """Add ``doc_no`` (documents in the order first met by distance) and ``chunk_no`` within the document, cut to ``per_document``."""
    w = Window.partitionBy(query).orderBy(F.col("distance"), F.col("document_id"), F.col("chunk_index"))
    c = chunks.withColumn("__at", F.row_number().over(w))
    c = c.withColumn("__first", F.min("__at").over(Window.partitionBy(query, "document_id")))
    c = c.withColumn("doc_no", F.dense_rank().over(Window.partitionBy(query).orderBy("__first")).cast("long"))
    inner = [F.col("chunk_index"), F.col("__at")] if by_document else [F.col("__at")]
    c = c.withColumn("chunk_no", F.row_number().over(Window.partitionBy(query, "document_id").orderBy(*inner)).cast("long"))
    return c.where(F.col("chunk_no") <= per_document).drop("__at", "__first")


def assemble_chunks(
    chunks: DataFrame, query: str = "query_id", max_tokens: int = 4096, threshold: float = 0.05, per_document: int = 10, by_document: bool = True, remove_copies: bool = True
) -> DataFrame:
    """(query, text, chunk_count, token_estimate): one XML context for each query.

    Needs document_id, chunk_index, chunk_text, distance, embedding; document_title, section_path and source_uri are used
    where they are.  A chunk is added while the text before it is shorter than 4 * ``max_tokens`` bytes (so it may run over
    by one chunk); every element is closed.  Four bytes count as a token.
    """
    for c in ("document_title", "section_path", "source_uri"):
        if c not in chunks.columns:
            chunks = chunks.withColumn(c, F.lit(None).cast("string"))
    if remove_copies:
        chunks = drop_near_copies(chunks, query, threshold)
    c = order_chunks(chunks, query, per_document, by_document)
    none = F.lit("")
    doc = Window.partitionBy(query, "doc_no").orderBy("chunk_no")
    head = F.concat(
        F.lit('  <document id="'), escape_xml(F.coalesce("document_id", none)), F.lit('" title="'), escape_xml(F.coalesce(F.first("document_title").over(doc), none)),
        F.lit('" source="'), escape_xml(F.coalesce(F.first("source_uri").over(doc), none)), F.lit('">\n'),
    )
    body = F.concat(
        F.lit('    <chunk index="'), F.col("chunk_index").cast("string"), F.lit('" section="'), escape_xml(F.coalesce("section_path", none)),
        F.lit('">\n      <text>'), escape_xml(F.coalesce("chunk_text", none)), F.lit("</text>\n    </chunk>\n"),
    )
    c = c.withColumn("__head", F.when(F.col("chunk_no") == 1, head).otherwise(none)).withColumn("__body", body)
    c = c.withColumn("__end", F.when((F.col("chunk_no") == 1) & (F.col("doc_no") > 1), F.lit("  </document>\n")).otherwise(none))
    run = Window.partitionBy(query).orderBy("doc_no", "chunk_no")
    size = F.octet_length(F.concat("__end", "__head", "__body"))
    before = F.coalesce(F.sum(size).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = len("<context>\n") + before + F.octet_length(F.concat("__end", "__head"))
    c = c.withColumn("__fits", start < 4 * max_tokens).where("__fits")
    text = F.concat(
        F.lit("<context>\n"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_no", "chunk_no", F.concat("__end", "__head", "__body").alias("x")))), lambda s: s["x"]), ""),
        F.lit("  </document>\n</context>"),
    )
    out = c.groupBy(query).agg(text.alias("text"), F.count(F.lit(1)).alias("chunk_count"))
    return out.withColumn("token_estimate", F.floor(F.octet_length("text") / 4))


def assemble_texts(texts: DataFrame, query: str = "query_id", text: str = "text", order: str = "rank", max_tokens: int = 4096) -> DataFrame:
    """(query, text, chunk_count, token_estimate): texts joined by empty lines while each fits into 4 * ``max_tokens`` bytes.

    The first text that does not fit ends the context.
    """
    w = Window.partitionBy(query).orderBy(order)
    before = F.coalesce(F.sum(F.octet_length(text) + 2).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = F.when(before > 0, before - 2).otherwise(F.lit(0))
    t = texts.where(F.col(text).isNotNull()).withColumn("__no", used + F.octet_length(text) + 2 > 4 * max_tokens)
    t = t.withColumn("__stop", F.max(F.col("__no").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__stop = 0")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("x")))), lambda s: s["x"]), "\n\n")
    out = t.groupBy(query).agg(joined.alias("text"), F.count(F.lit(1)).alias("chunk_count"))
    return out.withColumn("token_estimate", F.floor(F.octet_length("text") / 4))
