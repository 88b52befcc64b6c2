"""Quantisation: half precision, 8-bit integers with scale and zero point, product quantisation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodevec.functions.vectors import as_column, let


def _by_length(values: pd.Series, convert) -> pd.Series:
    """``convert`` over the stacked values of each length at once; nulls stay null."""
    out = np.full(len(values), None, object)
    lengths = np.array([-1 if v is None else len(v) for v in values])
    for n in np.unique(lengths[lengths >= 0]):
        rows = np.flatnonzero(lengths == n)
        got = convert([values.iloc[i] for i in rows], int(n))
        for i, g in zip(rows, got):
            out[i] = g
    return pd.Series(out, index=values.index)


def _pack(kind):
    return lambda vectors, n: [r.tobytes() for r in np.stack([np.asarray(v, np.float32) for v in vectors]).astype(kind)]


def _unpack(kind):
    return lambda data, n: np.frombuffer(b"".join(data), kind).astype(np.float32).reshape(len(data), -1)


@F.pandas_udf(T.BinaryType())
def to_half(v: pd.Series) -> pd.Series:
    """array<float> to half-precision bytes."""
    return _by_length(v, _pack(np.float16))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_half(b: pd.Series) -> pd.Series:
    """Half-precision bytes to array<float>."""
    return _by_length(b, _unpack(np.float16))


@F.pandas_udf(T.BinaryType())
def to_single(v: pd.Series) -> pd.Series:
    """array<float> to single-precision bytes."""
    return _by_length(v, _pack(np.float32))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_single(b: pd.Series) -> pd.Series:
    """Single-precision bytes to array<float>."""
    return _by_length(b, _unpack(np.float32))


def quantize_i8(v) -> Column:
    """struct(codes array<int>, scale, zero_point): the vector's range spread over -128 .. 126.

    scale = range / 254 (1 when all components are equal), zero_point = -128 - min / scale, code = round(x / scale + zero_point),
    kept within a byte.  Scale and zero point stay with the codes, so that they can be read back.
    """
    v = as_column(v)
    low, high = F.array_min(v), F.array_max(v)
    scale = F.when(high > low, (high - low) / 254.0).otherwise(F.lit(1.0))

    def codes(s: Column) -> Column:
        one = F.transform(s["v"], lambda x: F.greatest(F.least(F.round(x / s["scale"] + s["zero"]), F.lit(127.0)), F.lit(-128.0)).cast("int"))
        return F.struct(one.alias("codes"), s["scale"].alias("scale"), s["zero"].alias("zero_point"))

    def with_zero(s: Column) -> Column:
        return F.struct(s["v"].alias("v"), s["scale"].alias("scale"), (F.lit(-128.0) - s["low"] / s["scale"]).alias("zero"))

    return let(let(F.struct(v.alias("v"), low.alias("low"), scale.alias("scale")), with_zero), codes)


def dequantize_i8(q: Column) -> Column:
    """array<double> from the struct of :func:`quantize_i8`."""
    return let(q, lambda s: F.transform(s["codes"], lambda c: (c - s["zero_point"]) * s["scale"]))


def sub_vectors(dim: int, wanted: int) -> int:
    """Largest number up to ``wanted`` that divides ``dim``."""
    return next(m for m in range(max(1, min(wanted, dim)), 0, -1) if dim % m == 0)


def ivf_sizes(rows: int, dim: int) -> dict[str, int]:
    """Cells, cells to probe and sub-vectors for a table: nlist = sqrt(n) in 16 .. 1024, nprobe a quarter, dim / 8 in 4 .. 96."""
    nlist = int(min(max(round(rows**0.5), 16), 1024))
    return {"nlist": nlist, "nprobe": max(1, nlist // 4), "pq_m": sub_vectors(dim, min(max(dim // 8, 4), 96))}


def kmeans_fit(x: np.ndarray, k: int, rounds: int = 25, seed: int = 7) -> np.ndarray:
    """k-means++ start, then Lloyd until no centre moves by more than 1e-8; an empty cluster keeps its centre."""
    rng = np.random.default_rng(seed)
    x = np.asarray(x, np.float64)
    k = min(k, len(x))
    c = [x[rng.integers(len(x))]]
    d = ((x - c[0]) ** 2).sum(1)
    while len(c) < k:
        c.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
        d = np.minimum(d, ((x - c[-1]) ** 2).sum(1))
    c = np.array(c)
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        new = c.copy()
        for j in np.unique(near):
            new[j] = x[near == j].mean(0)
        moved = np.abs(new - c).max()
        c = new
        if moved <= 1e-8:
            break
    return c


@dataclass
class ProductQuantizer:
    """Codebooks [M][K][dim / M]; at most 256 entries each, so a code is one byte."""

    books: np.ndarray

    @classmethod
    def train(cls, sample: np.ndarray, m: int, k: int = 256, rounds: int = 25, seed: int = 7) -> ProductQuantizer:
        dim = sample.shape[1]
        if dim % m:
            raise ValueError(f"{m} sub-vectors do not divide {dim} components")
        w = dim // m
        books = [kmeans_fit(sample[:, i * w : (i + 1) * w], min(k, 256), rounds, seed + i) for i in range(m)]
        return cls(np.array(books))

    def encode(self, x: np.ndarray) -> np.ndarray:
        m, _, w = self.books.shape
        out = np.empty((len(x), m), np.uint8)
        for i, b in enumerate(self.books):
            part = x[:, i * w : (i + 1) * w]
            out[:, i] = (part @ b.T - 0.5 * (b * b).sum(1)).argmax(1)
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)

    def table(self, query: np.ndarray) -> np.ndarray:
        """[M][K] squared distances of the query's parts to the entries."""
        m, _, w = self.books.shape
        return ((self.books - np.asarray(query, np.float64).reshape(m, 1, w)) ** 2).sum(2)

    def encode_column(self, v: Column | str) -> Column:
        """array<int> codes of a vector column, in Arrow batches."""
        me = self

        @F.pandas_udf("array<int>")
        def codes(s: pd.Series) -> pd.Series:
            ok = s.notna()
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            if ok.any():
                got = me.encode(np.stack(s[ok].to_numpy())).astype(np.int32)
                out[ok] = pd.Series(list(got), index=s.index[ok])
            return out

        return codes(v)

    def adc_column(self, codes: Column | str, query: np.ndarray) -> Column:
        """Squared distance of a query to coded rows by table look-up, in the JVM."""
        t = self.table(query)
        literal = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in t])
        codes = F.col(codes) if isinstance(codes, str) else codes
        return F.aggregate(F.zip_with(codes, literal, lambda c, row: F.get(row, c)), F.lit(0.0), lambda s, x: s + x)
