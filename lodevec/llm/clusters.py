"""Grouping records into similarity clusters by density, over spatial cells that overlap.

1. Vectors are turned onto their main axes (the second moments of all rows); the first ``REDUCED`` of them are compared.
2. Space is divided by pivots fitted on a bounded sample; a row goes to the cell of its nearest
   pivot (its home) and, if that is nearly as near, to the one of the second: two cells at most, however many there are.
3. In each cell, rows with enough neighbours of a given similarity are core points, and
   connected core points make a local cluster; one whose members do not agree with its own mean
   holds several that touch, and is divided again at a higher density.  Border rows join the local cluster whose mean they are near.
4. Local clusters that share a core point (in the overlap) are one cluster.
5. The exact check, in full dimensions: a row stays in its density cluster if it is near enough to the cluster's mean direction; rows
   without a cluster, or that fail, join the most similar mean if it is near enough.  Means are taken again until no row moves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodevec.llm.current import DIM, kmeans, nearest, sample_vectors, unpack
from lodevec.session import cut_lineage

SAMPLE_ROWS = 262_144
SAMPLE_OF_CELL = 64
REDUCED = 48
CELL_ROWS = 1024
MAX_PIVOTS = 16_384
FLAT_PIVOTS = 1024
NEAR_COARSE = 4
MARGIN = 0.02
NEAR = 0.68
NEARER = 0.03
MIN_POINTS = 6
LOCAL_ROWS = 16_384
TILE_ROWS = 1024
SAME_MEAN = 0.9
MAX_MEANS = 100_000
MAX_LABELS = 1_000_000  # 16 MB
# kinds of the rows that the local step gives; a home row has the number of its copies, one or more, instead
COPY, CLUSTER, LINK = -1, -2, -3


def main_axes(vectors: DataFrame, dim: int) -> tuple[np.ndarray, int]:
    """All main axes, the longest first, and the number of rows: each task sums the products of its rows, Spark adds the sums up."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dim, dim)), 0
        for b in batches:
            x = unpack(b.column(0), dim)
            total += x.T @ x
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim + 1)), pa.array(np.append(total.ravel(), n))], ["at", "v"])

    rows = vectors.select("vec").mapInArrow(moments, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    m = np.zeros(dim * dim + 1)
    m[rows["at"]] = rows["v"]
    _, axes = np.linalg.eigh(m[:-1].reshape(dim, dim))
    return np.ascontiguousarray(axes[:, ::-1]).astype(np.float32), int(m[-1])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]


@dataclass
class Pivots:
    """Pivots in parts around coarse centres; ``start`` has the number of each part's first pivot."""

    coarse: np.ndarray
    parts: list[np.ndarray]
    start: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, count: int) -> Pivots:
        """``count`` pivots or somewhat fewer; up to 1,024 lie in one part, more in as many parts as a part has pivots."""
        if count <= FLAT_PIVOTS:
            parts = [_unit(kmeans(sample, count))]
            return cls(parts[0].mean(0, keepdims=True), parts, np.zeros(1, np.int64))
        coarse = _unit(kmeans(sample, int(count**0.5)))
        at = nearest(sample, coarse)
        held = [sample[at == c] for c in range(len(coarse))]
        kept = [c for c, h in enumerate(held) if len(h)]
        parts = [_unit(kmeans(held[c], max(1, round(count * len(held[c]) / len(sample))))) for c in kept]
        return cls(coarse[kept], parts, np.cumsum([0, *map(len, parts[:-1])]))

    def __len__(self) -> int:
        return sum(map(len, self.parts))

    def nearest_two(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two nearest pivots of each row among the parts of its four nearest coarse centres, and their similarities."""
        n = len(x)
        cell, sim = np.full((n, 2), -1, np.int64), np.full((n, 2), -2.0, np.float32)
        near = x @ self.coarse.T
        take = min(NEAR_COARSE, len(self.parts))
        near = np.argpartition(-near, take - 1, axis=1)[:, :take]
        for p, (pivots, start) in enumerate(zip(self.parts, self.start)):
            rows = np.flatnonzero((near == p).any(1))
            if not len(rows):
                continue
            s = x[rows] @ pivots.T
            for _ in range(min(2, len(pivots))):
                j = s.argmax(1)
                v = s[np.arange(len(rows)), j]
                s[np.arange(len(rows)), j] = -2.0
                first, second = v > sim[rows, 0], (v <= sim[rows, 0]) & (v > sim[rows, 1])
                up = rows[first]
                cell[up, 1], sim[up, 1] = cell[up, 0], sim[up, 0]
                cell[up, 0], sim[up, 0] = start + j[first], v[first]
                cell[rows[second], 1], sim[rows[second], 1] = start + j[second], v[second]
        return cell, sim


def _spread(axes: np.ndarray, reduced: int, pivots: Pivots, margin: float, dim: int):
    """Rows to (cell, id, vec, copies, shared).

    A home row has the number of exact copies in its batch that it stands for, in the second cell the number is negative.  The copies
    it stands for go to cells below 0, with its id in place of the vector.
    """
    buckets = 4 * len(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cell", "id", "vec", "copies", "shared"]
        for b in batches:
            if not b.num_rows:
                continue
            ids, vec = b.column(0).to_numpy(), b.column(1)
            codes = vec.dictionary_encode().indices.to_numpy()
            order = np.lexsort((ids, codes))
            new = np.r_[True, np.diff(codes[order]) != 0]
            first = order[new]
            count = np.bincount(codes)[codes[first]]
            stands = np.repeat(first, count)[~new]
            if len(stands):
                rest = order[~new]
                of = pa.array([int(i).to_bytes(8, "little", signed=True) for i in ids[stands]], pa.binary())
                m = len(rest)
                yield pa.RecordBatch.from_arrays([pa.array(-1 - ids[rest] % buckets), pa.array(ids[rest]), of, pa.array(np.zeros(m, np.int64)), pa.array(np.zeros(m, bool))], names)
            vec, ids = vec.take(pa.array(first)), ids[first]
            x = unpack(vec, dim) @ axes[:, :reduced]
            cell, sim = pivots.nearest_two(_unit(x))
            second = np.flatnonzero((cell[:, 1] >= 0) & (sim[:, 1] >= sim[:, 0] - margin))
            shared = np.zeros(len(ids), bool)
            shared[second] = True
            yield pa.RecordBatch.from_arrays([pa.array(cell[:, 0]), pa.array(ids), vec, pa.array(count.astype(np.int64)), pa.array(shared)], names)
            if len(second):
                w = -count[second].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell[second, 1]), pa.array(ids[second]), vec.take(pa.array(second)), pa.array(w), pa.array(np.ones(len(second), bool))], names)

    return run


def density_labels(x: np.ndarray, weight: np.ndarray, near: float, min_points: int) -> np.ndarray:
    """Cluster number of each core point, -1 for all others.

    Core: at least ``min_points`` rows (copies counted, itself too) of similarity ``near`` or more.
    Core points that near are in one cluster.
    """
    n = len(x)
    step = max(64, 8_000_000 // max(n, 1))
    plain = bool((weight == 1).all())
    close, degree = [], []
    for a in range(0, n, step):
        near_ = x[a : a + step] @ x.T >= near
        degree.append(np.count_nonzero(near_, axis=1) if plain else near_ @ weight.astype(np.float32))
        close.append(np.packbits(near_, axis=1))  # one bit a pair
    close, degree = np.concatenate(close or [np.zeros((0, 0), np.uint8)]), np.concatenate(degree or [np.zeros(0)])
    labels = np.full(n, -1)
    todo = degree >= min_points
    number = 0
    for i in np.flatnonzero(todo):
        if not todo[i]:
            continue
        todo[i] = False
        labels[i] = number
        front = np.array([i])
        while len(front):
            reached = np.zeros(close.shape[1], np.uint8)
            left = np.packbits(todo)
            for a in range(0, len(front), 256):
                reached |= np.bitwise_or.reduce(close[front[a : a + 256]], axis=0)
                if not (left & ~reached).any():
                    break
            front = np.flatnonzero(np.unpackbits(reached & left, count=n))
            todo[front] = False
            labels[front] = number
        number += 1
    return labels


def _tiles(x: np.ndarray, seed: int = 7) -> list[np.ndarray]:
    """Row numbers in tiles of up to ``TILE_ROWS`` rows that lie near each other."""
    count = -(-len(x) * 2 // TILE_ROWS)
    some = x[np.random.default_rng(seed).choice(len(x), min(len(x), 16 * count), replace=False)]
    at = nearest(x, kmeans(some, count, 4, seed))
    order = np.argsort(at, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(at[order])) + 1)
    return [p[a : a + TILE_ROWS] for p in parts for a in range(0, len(p), TILE_ROWS)]


def _join(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The roots, each the lowest row of its component, after every ``u`` and its ``v`` are joined."""
    while len(u):
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        u, v = root[u], root[v]
        apart = u != v
        u, v = u[apart], v[apart]
    return root


def wide_labels(x: np.ndarray, weight: np.ndarray, near: float, min_points: int) -> np.ndarray:
    """:func:`density_labels` of unit rows, number by number, without a table of pairs: memory grows with the rows only.

    Rows are compared tile by tile.  Left out are only pairs that change nothing: those of two tiles whose angles show that none is near, those of rows
    known to be core points already, and those of core points known to be in one cluster.  How rows are laid out in tiles has no part in the result.
    """
    n = len(x)
    if not n:
        return np.full(0, -1)
    tiles = _tiles(x)
    centres = _unit(np.stack([x[t].astype(np.float64).mean(0) for t in tiles]))
    angle = lambda s: np.arccos(np.clip(s, -1, 1))
    radius = np.array([angle(x[t] @ c).max() for t, c in zip(tiles, centres)])
    reach = angle(near) + 0.002  # single precision

    def others(p: int, of: range) -> np.ndarray:
        """Tiles that may hold rows near to those of tile ``p``, the nearest first."""
        apart = angle(centres[of.start : of.stop] @ centres[p]) - radius[of.start : of.stop] - radius[p]
        return np.argsort(apart, kind="stable")[: np.count_nonzero(apart <= reach)] + of.start

    w, core = weight.astype(np.float32), np.zeros(n, bool)
    for p, rows in enumerate(tiles):
        degree = (x[rows] @ x[rows].T >= near) @ w[rows]
        lack = np.flatnonzero(degree < min_points)
        for q in others(p, range(len(tiles))) if len(lack) else ():
            if q != p:
                degree[lack] += (x[rows[lack]] @ x[tiles[q]].T >= near) @ w[tiles[q]]
                lack = lack[degree[lack] < min_points]
                if not len(lack):
                    break
        core[rows[degree >= min_points]] = True
    root, tiles = np.arange(n), [t[core[t]] for t in tiles]
    for across in (False, True):  # the tiles by themselves first
        for p, rows in enumerate(tiles):
            for q in (others(p, range(p + 1, len(tiles))) if across else [p]) if len(rows) else ():
                a, b = root[rows], root[tiles[q]]
                if not len(b) or (a[0] == b[0] and (a == a[0]).all() and (b == b[0]).all()):
                    continue
                u, i = np.unique(a, return_inverse=True)
                v, j = np.unique(b, return_inverse=True)
                joined = np.zeros((len(u), len(v)), bool)
                r, c = np.nonzero(x[rows] @ x[tiles[q]].T >= near)
                joined[i[r], j[c]] = True
                r, c = np.nonzero(joined & (u[:, None] != v))
                root = _join(root, u[r], v[c])
    labels = np.full(n, -1)
    labels[core] = np.unique(root[core], return_inverse=True)[1]
    return labels


def local_clusters(x: np.ndarray, weight: np.ndarray, near: float, min_points: int, margin: float, limit: int = LOCAL_ROWS, seed: int = 7) -> np.ndarray:
    """:func:`density_labels` for a cell of any size.  Above ``limit`` rows :func:`wide_labels` has the same labels in less memory: a cell is
    never divided, so neither its size nor ``limit``, ``margin`` and ``seed`` have a part in the result."""
    return (density_labels if len(x) <= limit else wide_labels)(x, weight, near, min_points)


def even_clusters(
    x: np.ndarray, full: np.ndarray, weight: np.ndarray, near: float, min_points: int, margin: float, least: float, limit: int = LOCAL_ROWS
) -> np.ndarray:
    """:func:`local_clusters` in which nearly all members (98 %) have a similarity of ``least`` to the mean of theirs; the
    rest of them is clustered again by itself.  A cluster that fails the test is clustered again at the next higher ``near``, up to 0.95; what
    still fails is taken apart by :func:`balls`.  Cells of all sizes are clustered in this one way, from all their rows.
    """
    labels = np.full(len(x), -1)
    todo = [(np.arange(len(x)), near)]
    number = 0
    while todo:
        rows, level = todo.pop()
        got = local_clusters(x[rows], weight[rows], level, min_points, margin, limit)
        for c in range(got.max() + 1 if len(got) else 0):
            part = rows[got == c]
            mean = (full[part] * weight[part, None]).sum(0)
            agree = full[part] @ (mean / max(np.linalg.norm(mean), 1e-12)) >= least
            if np.average(agree, weights=weight[part]) >= 0.98:
                labels[part[agree]] = number
                number += 1
                if (~agree).any():  # a small cluster that touches a large one
                    todo.append((part[~agree], level))
            elif level + NEARER <= 0.95:
                todo.append((part, level + NEARER))
            else:
                inner = balls(full[part], weight[part], least)
                labels[part[inner >= 0]] = number + inner[inner >= 0]
                number += int(inner.max()) + 1
    return labels


def balls(full: np.ndarray, weight: np.ndarray, least: float) -> np.ndarray:
    """Cluster numbers of rows that no density sets apart: the rows of similarity ``least`` or more to a mean that is taken from them until it stays
    (ten times at most), the mean starting at the first row that is left; then the same with the rest."""
    labels, number = np.full(len(full), -1), 0
    unit, left = _unit(full), np.arange(len(full))
    while len(left):
        near = unit[left] @ unit[left[0]] >= least
        for _ in range(10):
            mean = (full[left[near]] * weight[left[near], None]).sum(0)
            again = unit[left] @ (mean / max(np.linalg.norm(mean), 1e-12)) >= least
            if not again.any() or (again == near).all():
                break
            near = again
        near[0] = True
        labels[left[near]] = number
        number += 1
        left = left[~near]
    return labels


def _local(axes: np.ndarray, reduced: int, near: float, min_points: int, margin: float, least: float, dim: int):
    """One cell to rows (a, b, kind, vec).

    Home rows (id, label or -1, copies, vector); clusters (null, label, CLUSTER, sum and number of the home rows as bytes); shared core points (id,
    label, LINK, null); copies (id, id of the row that stands for it, COPY, null).
    """
    out = {"a": pa.int64(), "b": pa.int64(), "kind": pa.int64(), "vec": pa.binary()}

    def table(a, b, kind, vec) -> pa.Table:
        return pa.table({n: x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, t) for (n, t), x in zip(out.items(), (a, b, kind, vec))}).cast(pa.schema(list(out.items())))

    def run(group: pa.Table) -> pa.Table:
        cell = int(group["cell"][0].as_py())
        vec = group["vec"].combine_chunks()
        ids = group["id"].to_numpy()
        if cell < 0:
            of = np.array([int.from_bytes(v, "little", signed=True) for v in vec.to_pylist()], np.int64)
            return table(ids, of, np.full(len(ids), COPY), pa.nulls(len(ids), pa.binary()))
        codes = vec.dictionary_encode().indices.to_numpy()
        copies, shared = group["copies"].to_numpy(), group["shared"].to_numpy()
        home = copies > 0
        # copies from other batches: one row for all, with the lowest id
        order = np.lexsort((ids, codes))
        first = order[np.r_[True, np.diff(codes[order]) != 0]]
        total = np.bincount(codes, weights=np.abs(copies))[codes[first]]
        full = unpack(vec.take(pa.array(first)), dim) @ axes
        labels = even_clusters(_unit(full[:, :reduced]), full, total, near, min_points, margin, least)
        n = labels.max() + 1 if len(labels) else 0
        core = np.full(codes.max() + 1, -1)
        core[codes[first]] = labels
        if n and (labels < 0).any():  # border rows
            sums = np.zeros((n, dim))
            np.add.at(sums, labels[labels >= 0], (full * total[:, None])[labels >= 0])
            means = _unit(sums).astype(np.float32)
            rest = np.flatnonzero(labels < 0)
            s = full[rest] @ means.T
            labels[rest] = np.where(s.max(1) >= least, s.argmax(1), -1)
        of_code = np.full(codes.max() + 1, -1)
        of_code[codes[first]] = labels
        mine = np.flatnonzero(home)
        label = of_code[codes[mine]]
        parts = [table(ids[mine], np.where(label >= 0, cell << 20 | label, -1), copies[mine], vec.take(pa.array(mine)))]
        if n:
            x = unpack(vec.take(pa.array(mine)), dim).astype(np.float64)
            sums, count = np.zeros((n, dim + 1)), np.zeros(n)
            held = label >= 0
            np.add.at(sums[:, :dim], label[held], x[held] * copies[mine][held, None])
            np.add.at(sums[:, dim], label[held], copies[mine][held])
            parts.append(table(pa.nulls(n, pa.int64()), [cell << 20 | c for c in range(n)], np.full(n, CLUSTER), [r.tobytes() for r in sums]))
            # every row that stands for copies in the overlap links the clusters it is a core point of
            links = np.flatnonzero(shared & (core[codes] >= 0))
            parts.append(table(ids[links], cell << 20 | core[codes[links]], np.full(len(links), LINK), pa.nulls(len(links), pa.binary())))
        return pa.concat_tables(parts)

    return run


def connected(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """(node, component): the least node reachable; by alternating large-star and small-star steps.

    Both steps only group edges by a node, so the work of a round is in proportion to the edges;
    the number of rounds grows with the logarithm of the longest chain.  An error if 100 rounds were not enough.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    before = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v"), F.col("u")))
        # large star: each node links its greater neighbours to its least neighbour (or itself)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each node links its smaller neighbours and itself to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = cut_lineage(small)
        # xor and sums tell when the edges stay as they are
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _agreeing(dim: int, same: float):
    """Rows (component, label, vec, sums) to (label, component, vec): the component stays where the directions of both sums agree, else it is a new one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, component = b.column(1).to_numpy(), b.column(0).to_numpy()
            own, whole = (_unit(np.frombuffer(b"".join(b.column(c).to_pylist()), np.float64).reshape(len(label), -1)[:, :dim]) for c in (2, 3))
            agree = np.einsum("ij,ij->i", own, whole) >= same
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(np.where(agree, component, -1 - label)), b.column(2)], ["label", "component", "vec"])

    return run


def _check(means: np.ndarray, now: np.ndarray, least: float, dim: int, names: np.ndarray | None = None):
    """Rows (id, copies, vec, mean number at the start or null) to members or, without ``names``, to sums.

    A row of a cluster (``now`` has the present number of each mean at the start, -1 for none) stays if it is similar enough to that mean; all others go to the most
    similar mean, if it is similar enough.  Sums: (g, n, least_id, digest, sums) of each group, where the digest tells one set of ids from another.
    """
    single = means.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(means)
        sums, count, low, digest = np.zeros((k, dim)), np.zeros(k, np.int64), np.full(k, np.iinfo(np.int64).max), np.zeros(k, np.uint64)
        for b in batches:
            x = unpack(b.column(2), dim)
            start = b.column(3).fill_null(-1).to_numpy()
            g = np.where(start >= 0, now[start], -1) if len(now) else np.full(len(x), -1)
            exact = np.where(g >= 0, np.einsum("ij,ij->i", x, means[g], dtype=np.float64), -2.0) if k else np.full(len(x), -2.0)
            rest = np.flatnonzero(exact < least)
            best, group = np.full(len(rest), -2.0, np.float32), np.zeros(len(rest), np.int64)
            for a in range(0, k, 4096):
                s = x[rest] @ single[a : a + 4096].T
                j = s.argmax(1)
                v = s[np.arange(len(rest)), j]
                up = v > best
                best[up], group[up] = v[up], j[up] + a
            if k:
                g[rest], exact[rest] = group, np.einsum("ij,ij->i", x[rest], means[group], dtype=np.float64)
            rows = np.flatnonzero(exact >= least)
            ids, copies, g = b.column(0).to_numpy()[rows], b.column(1).to_numpy()[rows], g[rows]
            if names is not None:
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(names[g]), pa.array(exact[rows])], ["id", "group_id", "similarity"])
            elif len(rows):
                order = np.argsort(g, kind="stable")
                at = np.flatnonzero(np.r_[True, np.diff(g[order]) != 0])
                used = g[order][at]
                sums[used] += np.add.reduceat((x[rows].astype(np.float64) * copies[:, None])[order], at, axis=0)
                count += np.bincount(g, weights=copies, minlength=k).astype(np.int64)
                low[used] = np.minimum(low[used], np.minimum.reduceat(ids[order], at))
                mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
                digest[used] += np.add.reduceat((mixed * mixed)[order], at)
        if names is None:
            used = np.flatnonzero(count)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * dim), pa.array(sums[used].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array(low[used]), pa.array(digest[used].view(np.int64)), lists], ["g", "n", "least_id", "digest", "sums"])

    return run


_SUMS = "g long, n long, least_id long, digest long, sums array<double>"


def _add_sums(group: pa.Table) -> pa.Table:
    lists = group["sums"].to_pylist()
    return pa.table({
        "g": [group["g"][0].as_py()], "n": [int(np.sum(group["n"].to_numpy()))], "least_id": [int(group["least_id"].to_numpy().min())],
        "digest": [int(np.sum(group["digest"].to_numpy().view(np.uint64)).view(np.int64))], "sums": [np.sum(lists, axis=0).tolist()],
    })


def merge_means(sums: np.ndarray, n: np.ndarray, same: float) -> tuple[np.ndarray, np.ndarray]:
    """Unit means, the largest first, and the number of the mean that each row of ``sums`` went into; those of similarity ``same`` or more to a larger one are merged into it."""
    order = np.argsort(-n, kind="stable")
    sums, means = sums[order], _unit(sums[order])
    near: dict[int, np.ndarray] = {}
    single = means.astype(np.float32)
    for a in range(0, len(means), 1024):
        i, j = np.nonzero(single[a : a + 1024] @ single.T >= same - 1e-6)
        apart = i + a != j
        i, j = i[apart] + a, j[apart]
        cuts = np.flatnonzero(np.r_[True, np.diff(i) != 0]) if len(i) else []
        for lo, hi in zip(cuts, np.append(cuts[1:], len(i)).astype(int) if len(i) else []):
            near[int(i[lo])] = j[lo:hi]
    into, out = np.full(len(means), -1), []
    for i in range(len(means)):
        if into[i] >= 0:
            continue
        j = near.get(i, np.zeros(0, np.int64))
        j = j[(into[j] < 0) & (means[j] @ means[i] >= same)] if len(j) else j
        into[i] = into[j] = len(out)
        out.append(sums[i] + sums[j].sum(0))
    back = np.empty(len(means), np.int64)
    back[order] = into
    return _unit(np.array(out).reshape(-1, sums.shape[1])), back


def similarity_groups(
    vectors: DataFrame,
    least: float = 0.8,
    min_size: int = 25,
    near: float = NEAR,
    min_points: int = MIN_POINTS,
    margin: float = MARGIN,
    reduced: int = REDUCED,
    cell_rows: int = CELL_ROWS,
    dim: int = DIM,
    sample_rows: int = SAMPLE_ROWS,
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """(group_id, id, similarity): members of every group of at least ``min_size`` rows.

    Each member has a similarity of at least ``least`` to the mean direction of its group; a row
    is in one group at most.  ``vectors`` has (id, vec) with unique ids.  Rows in no group are left out;
    an empty table gives no groups.  Exact copies count as so many rows.  ``group_id`` is the lowest id of the group.
    The main axes are those of all rows of ``fit_on`` (by default the vectors; the same with superseded rows saves a pass), the pivots are fitted on
    a sample of it, 64 rows a pivot and at most about ``sample_rows``.  The means are statistics of clusters of ``min_points`` rows or more; they are
    shipped to all tasks, at most 100,000 of them (51 MB), beyond which the call fails rather than drops any.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "group_id long, id long, similarity double")
    vectors = vectors.select("id", "vec")
    if fit_on is None:
        vectors = fit_on = cut_lineage(vectors)
    axes, n = main_axes(fit_on, dim)
    if not n:
        return empty
    reduced = min(reduced, dim)
    count = max(1, min(MAX_PIVOTS, n // cell_rows))
    sample = _unit(sample_vectors(fit_on, n, min(sample_rows, max(4096, SAMPLE_OF_CELL * count)), dim) @ axes[:, :reduced])
    pivots = Pivots.fit(sample, min(count, max(1, len(sample) // 16)))
    spread = vectors.mapInArrow(_spread(axes, reduced, pivots, margin, dim), "cell long, id long, vec binary, copies long, shared boolean")
    local = spread.groupBy("cell").applyInArrow(_local(axes, reduced, near, min_points, margin, least, dim), "a long, b long, kind long, vec binary")
    local = cut_lineage(local)
    cores = local.where(F.col("kind") == LINK).select(F.col("a").alias("id"), F.col("b").alias("label"))
    low = cores.groupBy("id").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    edges = cores.join(low, "id").where("label <> low").select(F.col("low").alias("a"), F.col("label").alias("b"))
    parts = connected(edges)
    clusters = local.where(F.col("kind") == CLUSTER).select(F.col("b").alias("label"), "vec").join(parts, F.col("label") == F.col("node"), "left")
    clusters = clusters.select("label", F.coalesce("component", "label").alias("component"), "vec")

    def add(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(b, np.float64) for b in group["vec"].to_pylist()], axis=0)
        return pa.table({"component": [group["component"][0].as_py()], "sums": [total[:-1].tobytes()], "n": [float(total[-1])]})

    # a local cluster that only touches a larger one, so that its mean is not that of the whole, is one by itself
    whole = clusters.select("component", "vec").groupBy("component").applyInArrow(add, "component long, sums binary, n double")
    clusters = clusters.join(whole.select("component", "sums"), "component").mapInArrow(_agreeing(dim, SAME_MEAN), "label long, component long, vec binary")
    clusters = cut_lineage(clusters)
    found = clusters.select("component", "vec").groupBy("component").applyInArrow(add, "component long, sums binary, n double")
    rows = found.where(F.col("n") >= min_points).limit(MAX_MEANS + 1).toPandas().sort_values("component")
    if len(rows) > MAX_MEANS:
        raise ValueError(f"more than {MAX_MEANS} clusters; raise min_points or divide the table")
    if not len(rows):
        return empty
    means, now = merge_means(np.array([np.frombuffer(b, np.float64) for b in rows["sums"]]), rows["n"].to_numpy(), SAME_MEAN)
    numbers = spark.createDataFrame([(int(c), i) for i, c in enumerate(rows["component"])], "component long, start long")
    labels = cut_lineage(clusters.select("label", "component").join(numbers, "component").select("label", "start"))
    homes = local.where(F.col("kind") > 0).select(F.col("a").alias("id"), F.col("kind").alias("copies"), "vec", F.col("b").alias("label"))
    if labels.limit(MAX_LABELS + 1).count() <= MAX_LABELS:
        homes = homes.join(F.broadcast(labels), "label", "left").select("id", "copies", "vec", "start")
    else:  # shuffled once, not in each round
        homes = cut_lineage(homes.join(labels, "label", "left").select("id", "copies", "vec", "start"))
    before, seen = None, set()
    while True:
        got = homes.mapInArrow(_check(means, now, least, dim), _SUMS).groupBy("g").applyInArrow(_add_sums, _SUMS).toPandas().sort_values("g")
        if not len(got):
            return empty
        size = np.zeros(len(means), np.int64)
        size[got["g"]] = got["n"]
        state = tuple(sorted(zip(got["n"], got["digest"])))
        if state == before or state in seen:  # no row moves (or some go to and fro: those near enough to these means are members)
            if (size >= min_size).all():
                break
            # what is no group takes no row from one
            keep = size >= min_size
            means, new = means[keep], np.where(keep, np.cumsum(keep) - 1, -1)
            now = np.where(now >= 0, new[now], -1)
            before, seen = None, set()
            if not len(means):
                return empty
            continue
        seen.add(state)
        before = state
        sums = np.zeros_like(means)
        sums[got["g"]] = np.array([np.asarray(v) for v in got["sums"]])
        kept = np.flatnonzero(size)
        new_means, into = merge_means(sums[kept], size[kept], SAME_MEAN)
        new = np.full(len(means), -1)
        new[kept] = into
        means, now = new_means, np.where(now >= 0, new[now], -1)
    names = np.zeros(len(means), np.int64)
    names[got["g"]] = got["least_id"]
    members = homes.mapInArrow(_check(means, now, least, dim, names), "id long, group_id long, similarity double")
    copies = local.where(F.col("kind") == COPY).groupBy(F.col("b").alias("id")).agg(F.collect_list("a").alias("more"))
    members = members.join(copies, "id", "left").select("group_id", F.explode(F.concat(F.array("id"), F.coalesce("more", F.array().cast("array<long>")))).alias("id"), "similarity")
    return cut_lineage(members)


def describe_groups(members: DataFrame, typical: int = 3) -> DataFrame:
    """(group_id, n_members, rank, id, similarity): size and the most typical members (medoids) of each group, ties to the lower id."""
    sizes = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_members"))
    order = Window.partitionBy("group_id").orderBy(F.col("similarity").desc(), F.col("id"))
    top = members.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= typical)
    return top.join(sizes, "group_id").select("group_id", "n_members", "rank", "id", "similarity")


def neighbours_in_order(members: DataFrame, group: str = "group_id", key: str = "id", bucket: int = 65_536) -> DataFrame:
    """(id_a, id_b): each member and the next one of its group by id.

    The window runs within ranges of ids, so a group with a third of all rows is no single task's; the
    last one of a range gets the first of the group's next range.
    """
    m = members.select(F.col(group).alias("g"), F.col(key).alias("id")).withColumn("b", F.floor(F.col("id") / bucket))
    inside = Window.partitionBy("g", "b").orderBy("id")
    m = m.withColumn("next", F.lead("id").over(inside))
    firsts = m.groupBy("g", "b").agg(F.min("id").alias("first"))
    firsts = firsts.withColumn("edge", F.lead("first").over(Window.partitionBy("g").orderBy("b"))).drop("first")
    out = m.join(firsts, ["g", "b"]).select(F.col("id").alias("id_a"), F.coalesce("next", "edge").alias("id_b"))
    return out.where(F.col("id_b").isNotNull())
