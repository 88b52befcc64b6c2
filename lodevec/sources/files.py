"""Files as executors see them: any scheme of Arrow's file systems, and facts of Parquet files taken from footers and vectors where they lie."""

from __future__ import annotations

import base64
import datetime as dt
import json
import urllib.parse
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession

BOUND_CHARS = 16


def place(path: str):
    """(file system, path in it) of a path or URI, on whatever machine this runs."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def vectors_of(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list column that have ``dim`` finite components, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    rows = np.flatnonzero((np.diff(offsets) == dim) & ~np.asarray(column.is_null()))
    if not len(rows):
        return np.zeros((0, dim))
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    m = values[offsets[rows][:, None] + np.arange(dim)]
    return m[np.isfinite(m).all(1)]


def distances_to(metric: str, x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    dot = x @ centre
    if metric == "dot":
        return -dot
    if metric == "normalized_cosine":
        return 1 - dot
    if metric == "euclidean":
        return np.sqrt(((x - centre) ** 2).sum(1))
    n = np.linalg.norm(x, axis=1) * np.linalg.norm(centre)
    return np.where(n == 0, 1.0, 1 - dot / np.where(n == 0, 1.0, n))


def _text(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, bytes):
        return base64.b64encode(value[:BOUND_CHARS]).decode()
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()[:32]
    return str(value)[:BOUND_CHARS]


def _bounds(statistics) -> tuple:
    if statistics is None or not statistics.has_min_max:
        return None, None
    try:
        return statistics.min, statistics.max
    except NotImplementedError:  # old 12-byte times
        return None, None


def footer_facts(meta) -> dict[str, list]:
    """column -> [values, nulls, least, greatest, bytes] from a Parquet footer; a fact is None where the footer does not have it.  Text bounds are cut."""
    out: dict[str, list] = {}
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for c in range(group.num_columns):
            col = group.column(c)
            if "." in col.path_in_schema:  # lists and structs have no bounds
                continue
            s = col.statistics
            now = [group.num_rows, s.null_count if s is not None and s.has_null_count else None, *_bounds(s), col.total_compressed_size]
            old = out.setdefault(col.path_in_schema, [0, 0, None, None, 0])
            all_null = now[1] == now[0]
            first = old[0] == 0 or old[1] == old[0]
            old[2] = old[2] if all_null and not first else now[2] if first else None if old[2] is None or now[2] is None else min(old[2], now[2])
            old[3] = old[3] if all_null and not first else now[3] if first else None if old[3] is None or now[3] is None else max(old[3], now[3])
            old[0], old[4] = old[0] + now[0], old[4] + now[4]
            old[1] = None if old[1] is None or now[1] is None else old[1] + now[1]
    return {k: [v[0] - v[1] if v[1] is not None else None, v[1], _text(v[2]), _text(v[3]), v[4]] for k, v in out.items()}


def describe(spark: SparkSession, paths: Sequence[str], vector: str | None = None, dim: int = 0, metric: str = "cosine") -> dict[str, dict]:
    """Facts of Parquet files: rows and column facts from the footers, and of a vector column the mean and the largest distance to it.

    Files are spread over the tasks; each reads footers, and the vector column twice in batches, nothing else.  The result is one small row a file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for pdf in batches:
            out = []
            for path in pdf["path"]:
                files, at = place(path)
                with files.open_input_file(at) as f:
                    file = pq.ParquetFile(f)
                    centre = radius = None
                    if vector is not None and vector in file.schema_arrow.names:
                        total, n = np.zeros(dim), 0
                        for b in file.iter_batches(columns=[vector]):
                            x = vectors_of(b.column(0), dim)
                            total, n = total + x.sum(0), n + len(x)
                        if n:
                            centre = total / n
                            radius = max(float(distances_to(metric, x, centre).max()) for b in file.iter_batches(columns=[vector]) if len(x := vectors_of(b.column(0), dim)))
                    out.append((path, file.metadata.num_rows, json.dumps(footer_facts(file.metadata)), None if centre is None else centre.tolist(), radius))
            yield pd.DataFrame(out, columns=["path", "n", "facts", "centroid", "radius"])

    if not paths:
        return {}
    tasks = min(len(paths), 4 * spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks)
    got = rows.mapInPandas(run, "path string, n long, facts string, centroid array<double>, radius double").toLocalIterator()
    return {r["path"]: r.asDict() for r in got}


def partition_values(path: str, columns: Sequence[str]) -> list[str]:
    """The values of the partition columns that a file's path names; null is empty."""
    named = dict(s.split("=", 1) for s in path.split("/") if "=" in s)
    values = [urllib.parse.unquote(named.get(c, "")) for c in columns]
    return ["" if v == "__HIVE_DEFAULT_PARTITION__" else v for v in values]
