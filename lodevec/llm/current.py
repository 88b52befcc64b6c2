"""Current records with usable vectors, packed small: the common input of clustering and neighbour search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIM = 64


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that have ``dim`` finite components, not all zero: (row numbers, float32 matrix)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    right = (np.diff(offsets) == dim) & ~np.asarray(column.is_null())
    rows = np.flatnonzero(right)
    if not len(rows):
        return rows, np.zeros((0, dim), np.float32)
    # to_numpy turns null components into NaN, which no usable vector has
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    m = values[offsets[rows][:, None] + np.arange(dim)]
    ok = np.isfinite(m).all(1) & (m != 0).any(1)
    return rows[ok], m[ok]


def pack(m: np.ndarray) -> np.ndarray:
    """Each row as bytes: half precision where that is exact for the row, else single."""
    with np.errstate(over="ignore"):
        half = m.astype(np.float16)
    exact = (half.astype(np.float32) == m).all(1)
    out = np.empty(len(m), object)
    for i, (e, h) in enumerate(zip(exact, half)):
        out[i] = h.tobytes() if e else m[i].tobytes()
    return out


def unpack(column, dim: int) -> np.ndarray:
    """Unit rows (float32) from packed ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.Array):
        offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[
            column.offset : column.offset + len(column) + 1
        ]
        if len(column) and (np.diff(offsets) == 2 * dim).all():
            data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            m = data.view(np.float16).reshape(-1, dim).astype(np.float32)
            return unit(m)
        column = column.to_pylist()
    m = np.empty((len(column), dim), np.float32)
    for i, b in enumerate(column):
        m[i] = np.frombuffer(b, np.float16 if len(b) == 2 * dim else np.float32)
    return unit(m)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length, the length taken in double precision."""
    length = np.sqrt(np.einsum("ij,ij->i", m, m, dtype=np.float64))
    return (m / length[:, None]).astype(np.float32)


def _packed(docs: DataFrame, key: str, vector: str, latest: str, dim: int) -> DataFrame:
    """(id, at, vec) of all rows with an id; ``vec`` is null for an unusable vector."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, m = matrix(b.column(2), dim)
            vec = np.full(b.num_rows, None, object)
            vec[rows] = pack(m)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(vec, pa.binary())], ["id", "at", "vec"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(latest).cast("timestamp").alias("at"), F.col(vector).cast("array<float>").alias("v"))
    rows = rows.where(F.col("id").isNotNull()).select("id", F.unix_micros("at").alias("at"), "v")
    return rows.mapInArrow(packed, "id long, at long, vec binary")


def usable_vectors(docs: DataFrame, key: str = "id", vector: str = "embedding", latest: str = "ingested_at", dim: int = DIM) -> DataFrame:
    """(id, vec) of every row with a usable vector, superseded ones included: what an index is fitted on without a shuffle."""
    return _packed(docs, key, vector, latest, dim).where(F.col("vec").isNotNull()).select("id", "vec")


def current_vectors(docs: DataFrame, key: str = "id", vector: str = "embedding", latest: str = "ingested_at", dim: int = DIM) -> DataFrame:
    """(id, vec): one row for each id whose latest record has a usable vector.

    The latest record by ``latest`` decides (null is earliest; among equal times the
    usable vector of the highest bytes), also where its vector is unusable: then the id is left
    out.  Null ids are left out.  ``vec`` is the raw vector, packed by :func:`pack`, half the size of
    the array; one shuffle by id, before which each task keeps one row of an id.
    """

    rows = _packed(docs, key, vector, latest, dim)
    order = Window.partitionBy("id").orderBy(F.col("at").desc_nulls_last(), F.col("vec").desc_nulls_last())
    rows = rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") == 1)
    return rows.where(F.col("vec").isNotNull()).select("id", "vec")


def sample_vectors(vectors: DataFrame, n_rows: int, bound: int, dim: int, seed: int = 7) -> np.ndarray:
    """At most about ``bound`` unit rows for fitting an index, drawn by a hash of the id (the same in every run)."""
    if n_rows > bound:
        share = int(2**31 * bound / n_rows)
        vectors = vectors.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2**31)) < share)
    rows = vectors.select("id", "vec").limit(2 * bound).toPandas()
    rows = rows.sort_values("id")
    return unpack(list(rows["vec"]), dim)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Lloyd's centres in numpy for fitting on a bounded sample; an empty centre keeps its place."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        order = np.argsort(near, kind="stable")
        ids, starts = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(x[order], starts, axis=0)
        c[ids] = sums / np.diff(np.append(starts, len(x)))[:, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, block: int = 16384) -> np.ndarray:
    """Number of the nearest centre of each row."""
    half = 0.5 * np.einsum("ij,ij->i", c, c)
    return np.concatenate([(x[a : a + block] @ c.T - half).argmax(1) for a in range(0, len(x), block)] or [np.zeros(0, np.int64)])
