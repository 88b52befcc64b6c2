"""Storage arithmetic for vectors and indexes: no data is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SUFFIX = {"k": 10**3, "m": 10**6, "b": 10**9, "g": 10**9}


def parse_rows(text: str | int) -> int:
    """A number with an optional suffix K, M, B or G; underscores are allowed."""
    if isinstance(text, int):
        return text
    t = text.strip().replace("_", "")
    factor = SUFFIX.get(t[-1:].lower(), 1)
    return int(float(t[:-1] if factor > 1 else t) * factor)


def storage(rows: str | int, dim: int, hnsw_m: int = 16, pq_m: int | None = None) -> list[dict]:
    """Bytes of the six modes: vectors in 4, 2, 1 or no bytes a component, a graph of 18 bytes a link or one byte a sub-vector."""
    n = parse_rows(rows)
    m = pq_m if pq_m is not None else min(max(dim // 32, 8), dim)
    graph, codes = n * hnsw_m * 18, n * m
    # Names of the modes and the recall that goes with them.
    modes = [
        ("F32 (baseline)", 4, graph, "~99%"),
        ("F16 (default)", 2, graph, "~99%"),
        ("I8", 1, graph, "~97%"),
        ("F16 + IVF-PQ index", 2, codes, "~99%"),
        ("I8  + IVF-PQ index", 1, codes, "~97%"),
        ("PQ-only (--pq-only)", 0, codes, "~94%"),
    ]
    base = n * dim * 4 + graph
    out = []
    for name, width, index, recall in modes:
        total = n * dim * width + index
        out.append({"mode": name, "vectors_bytes": n * dim * width, "index_bytes": index, "total_bytes": total, "reduction_factor": round(base / max(total, 1), 1), "recall_at_10": recall})
    return out


def storage_table(spark: SparkSession, rows: str | int, dim: int, hnsw_m: int = 16, pq_m: int | None = None) -> DataFrame:
    """The estimate as rows."""
    schema = "mode string, vectors_bytes long, index_bytes long, total_bytes long, reduction_factor double, recall_at_10 string"
    return spark.createDataFrame(storage(rows, dim, hnsw_m, pq_m), schema)
