"""Inverted-file index with product-quantised codes, as Spark tables.

``build`` assigns every row to its nearest coarse centre; written with ``partitionBy("cell")`` a search
reads only the cells it probes.  Codebooks come from a bounded sample; one set serves the whole
table, so code distances are comparable everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.functions.quant import ProductQuantizer, ivf_sizes, kmeans_fit
from lodevec.functions.vectors import as_column, distance, metric_name, normalize

SAMPLE_ROWS = 20_000


@dataclass
class IvfIndex:
    metric: str
    centres: np.ndarray
    pq: ProductQuantizer | None
    residual: bool
    nprobe: int

    def cells(self, query: np.ndarray, nprobe: int | None = None) -> list[int]:
        """The cells nearest to a query."""
        d = ((self.centres - query) ** 2).sum(1)
        return np.argsort(d, kind="stable")[: nprobe or self.nprobe].tolist()

    def prepare(self, query: Sequence[float]) -> np.ndarray:
        q = np.asarray(query, np.float64)
        n = np.linalg.norm(q)
        return q / n if self.metric == "cosine" and n > 0 else q


def train(
    df: DataFrame, vector: str = "embedding", key: str = "id", metric: str = "cosine", nlist: int | None = None, pq_m: int | None = None,
    residual: bool = False, nprobe: int | None = None, sample_rows: int = SAMPLE_ROWS, use_pq: bool = True, seed: int = 7,
) -> IvfIndex:
    """Coarse centres and codebooks from about ``sample_rows`` rows chosen by a hash of the key; cosine trains on unit vectors."""
    metric = metric_name(metric)
    good = df.where(F.col(vector).isNotNull())
    rows = good.count()
    if not rows:
        raise ValueError("an index needs rows")
    v = normalize(vector) if metric == "cosine" else as_column(vector)
    sample = good.select(F.col(key).alias("k"), v.alias("v"))
    if rows > sample_rows:
        sample = sample.where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < int(1_000_000 * sample_rows / rows))
    x = np.stack(sample.orderBy("k").limit(2 * sample_rows).toPandas()["v"].to_numpy())
    size = ivf_sizes(rows, x.shape[1])
    centres = kmeans_fit(x, min(nlist or size["nlist"], rows), seed=seed)
    pq = None
    if use_pq:
        base = x
        if residual:
            base = x - centres[(x @ centres.T - 0.5 * (centres * centres).sum(1)).argmax(1)]
        pq = ProductQuantizer.train(base, pq_m or size["pq_m"], seed=seed)
    return IvfIndex(metric, centres, pq, residual, nprobe or max(1, len(centres) // 4))


def build(df: DataFrame, index: IvfIndex, vector: str = "embedding") -> DataFrame:
    """``df`` with ``cell`` and, with codebooks, ``codes``; rows with a null vector have cell -1 and are never found."""

    @F.pandas_udf("cell int, codes array<int>")
    def place(s: pd.Series) -> pd.DataFrame:
        ok = s.notna().to_numpy()
        cell, codes = np.full(len(s), -1, np.int32), [None] * len(s)
        if ok.any():
            x = np.stack(s[ok].to_numpy())
            if index.metric == "cosine":
                n = np.linalg.norm(x, axis=1, keepdims=True)
                x = np.where(n * n < 1e-12, x, x / np.where(n > 0, n, 1))
            c = (x @ index.centres.T - 0.5 * (index.centres * index.centres).sum(1)).argmax(1)
            cell[ok] = c
            if index.pq is not None:
                got = index.pq.encode(x - index.centres[c] if index.residual else x).astype(np.int32)
                for i, g in zip(np.flatnonzero(ok), got):
                    codes[i] = g
        return pd.DataFrame({"cell": cell, "codes": codes})

    # the argument is a plain column: a Python function over lambda expressions cannot be drawn out of an aggregate's grouping
    out = df.withColumn("__p", place(as_column(vector))).withColumn("cell", F.col("__p.cell"))
    if index.pq is not None:
        out = out.withColumn("codes", F.col("__p.codes"))
    return out.drop("__p")


def search(built: DataFrame, index: IvfIndex, query: Sequence[float], k: int = 10, nprobe: int | None = None, rerank: int = 3, vector: str = "embedding", key: str = "id") -> DataFrame:
    """The k nearest rows in the probed cells: k * rerank by code distance, then k by exact distance.

    The cells are literals of the filter, so that a table partitioned by cell is pruned.  Without codebooks the probed rows
    are compared exactly.
    """
    q = index.prepare(query)
    cells = index.cells(q, nprobe)
    rows = built.where(F.col("cell").isin(cells))
    if index.pq is not None:
        rows = with_code_distance(rows, index, q, cells, "__adc").orderBy("__adc", key).limit(k * rerank).drop("__adc")
    return rows.withColumn("_distance", distance(index.metric, vector, query)).orderBy("_distance", key).limit(k)


def with_code_distance(rows: DataFrame, index: IvfIndex, q: np.ndarray, cells: Sequence[int], into: str) -> DataFrame:
    """Rows of the given cells with the squared distance of a prepared query to their codes.

    Each cell has a table of distances (entries of the codebooks x sub-vectors), with residual codes one of its own; the tables of the probed cells are a small
    broadcast side, and distances are looked up in the JVM.
    """
    tables = [index.pq.table(q - index.centres[c] if index.residual else q).tolist() for c in cells]
    kind = pa.list_(pa.list_(pa.float64()))
    side = rows.sparkSession.createDataFrame(pa.table({"__c": pa.array([int(c) for c in cells], pa.int32()), "__t": pa.array(tables, kind)}))
    near = F.aggregate(F.zip_with("codes", "__t", lambda code, row: F.get(row, code)), F.lit(0.0), lambda s, x: s + x)
    return rows.join(F.broadcast(side), F.col("cell") == F.col("__c")).withColumn(into, near).drop("__c", "__t")


def choose(rows: int, cores: int, gpu: bool = False) -> str:
    """'ivf_pq' for 5,000 rows or more with over eight cores (or a GPU), else 'exact'."""
    return "ivf_pq" if rows >= 5000 and (gpu or cores > 8) else "exact"


def recall(found: DataFrame, truth: DataFrame, query_key: str = "query_id", key: str = "id") -> DataFrame:
    """(query key, recall): the share of the true neighbours that were found."""
    hit = truth.join(found.select(query_key, key).distinct().withColumn("hit", F.lit(1)), [query_key, key], "left")
    return hit.groupBy(query_key).agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
