"""Most similar vectors for every vector: an inverted multi-index.

The two halves of a unit vector are quantised separately; a pair of centroids is a cell.  A
query visits cells in the order of the summed distance of its halves to the pair, and
its entries are ranked again by the exact cosine similarity.

On the cluster, the cells of near first centroids form a block, divided by near second
centroids where it has many rows.  A row goes once to its own block, as an entry, and once to
each further block that holds a cell it visits; similarity being symmetric, a pair is found
when either of the two visits the other.  Of exact copies in one batch, the first few by id are
entries; the others have these as neighbours and travel without a vector, to any block, so that a
third of all rows being copies makes no hot block.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodevec.llm.current import DIM, kmeans, sample_vectors, unit, unpack

SAMPLE_ROWS = 65_536
CELL_ROWS = 48
BLOCK_ROWS = 100_000
MIN_VISITS = 8
DEEP_CENTRES = 64
MAX_CENTRES = 2048


@dataclass
class MultiIndex:
    """Codebooks of the two halves, the rows of each cell, and which block a cell belongs to."""

    first: np.ndarray
    second: np.ndarray
    dim: int
    sizes: np.ndarray | None = None
    coarse: np.ndarray | None = None
    row: np.ndarray | None = None
    start: np.ndarray | None = None
    fine: np.ndarray | None = None
    names: np.ndarray | None = None

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the halves to the centroids, but for a constant of each row and half."""
        h = self.dim // 2
        return (
            np.einsum("ij,ij->i", self.first, self.first) - 2 * x[:, :h] @ self.first.T,
            np.einsum("ij,ij->i", self.second, self.second) - 2 * x[:, h:] @ self.second.T,
        )

    def divide(self, block_rows: int) -> np.ndarray:
        """Group near centroids so that blocks hold about ``block_rows`` rows; the rows of each block."""
        k1, k2 = self.sizes.shape
        self.coarse = bisect(self.first, self.sizes.sum(1), block_rows)
        groups = int(self.coarse.max()) + 1
        # the first line of ``fine`` serves all groups that are one block
        self.row, lines, self.start, rows = np.zeros(groups, np.int64), [np.zeros(k2, np.int32)], np.zeros(groups, np.int64), []
        for g in range(groups):
            held = self.sizes[self.coarse == g].sum(0)
            self.start[g] = len(rows)
            parts = bisect(self.second, held, block_rows) if held.sum() > 1.5 * block_rows else lines[0]
            if parts.max():
                self.row[g] = len(lines)
                lines.append(parts.astype(np.int32))
            rows += np.bincount(parts, weights=held).tolist()
        self.fine = np.array(lines)
        self.names = np.arange(len(rows))
        return np.array(rows)

    def block(self, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
        """Block of a cell."""
        g = self.coarse[c1]
        return self.names[self.start[g] + self.fine[self.row[g], c2]]


def bisect(centres: np.ndarray, rows: np.ndarray, limit: int) -> np.ndarray:
    """Group number of each centre: halves of equal rows along the longest axis, and halves of these, until a group has at most 1.5 * ``limit`` rows or one centre."""
    out, number, todo = np.zeros(len(centres), np.int64), 0, [np.arange(len(centres))]
    while todo:
        at = todo.pop()
        w = rows[at].astype(float)
        if w.sum() <= 1.5 * limit or len(at) < 2:
            out[at] = number
            number += 1
            continue
        x = centres[at] - np.average(centres[at], axis=0, weights=w + 1e-9)
        axis = np.linalg.eigh((x * (w + 1e-9)[:, None]).T @ x)[1][:, -1]
        at = at[np.argsort(x @ axis, kind="stable")]
        half = int(np.clip(np.searchsorted(np.cumsum(rows[at]), w.sum() / 2) + 1, 1, len(at) - 1))
        todo += [at[half:], at[:half]]
    return out


def even_names(spark, rows: np.ndarray) -> np.ndarray:
    """A name for each block such that Spark's hash spreads the blocks evenly by rows over the shuffle's partitions."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = spark.range(16 * max(n, len(rows))).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).toPandas()
    free = {p: v["id"].tolist()[::-1] for p, v in found.groupby("p")}
    load, names = {p: 0.0 for p in free}, np.zeros(len(rows), np.int64)
    for b in np.argsort(-rows, kind="stable"):
        p = min((p for p in free if free[p]), key=lambda p: (load[p], p))
        names[b], load[p] = free[p].pop(), load[p] + rows[b]
    return names


def fit(vectors: DataFrame, n_rows: int, dim: int = DIM, sample_rows: int = SAMPLE_ROWS, cell_rows: int = CELL_ROWS, centres: int = 4) -> MultiIndex:
    """Codebooks on a bounded sample (about ``sample_rows`` rows); cells hold ``cell_rows`` rows on average, with at least ``centres`` and up to 2048 centroids a half."""
    x = sample_vectors(vectors, n_rows, sample_rows, dim)
    k = min(MAX_CENTRES, max(centres, int(math.sqrt(max(n_rows, 1) / cell_rows))), max(4, len(x) // 16))
    h = dim // 2
    if not len(x):
        x = np.zeros((1, dim), np.float32)
    # of centroids that are all but equal (copies in the sample) one is enough, and tells in which cell a row is
    first, second = (np.ascontiguousarray(c[np.sort(np.unique(np.round(c, 5), axis=0, return_index=True)[1])]) for c in (kmeans(x[:, :h], k), kmeans(x[:, h:], k)))
    return MultiIndex(first, second, dim)


def traverse(d1: np.ndarray, d2: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of centroids by rising summed distance (ties: lower ranks first), by a heap over the two sorted lists."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    a, b = d1[o1], d2[o2]
    heap, seen = [(a[0] + b[0], 0, 0)], {(0, 0)}
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(o1[i]), int(o2[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (a[x] + b[y], x, y))


def first_pairs(d1: np.ndarray, d2: np.ndarray, visits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``visits`` pairs of :func:`traverse` for many rows at once.

    The heap can only have reached ranks i, j with (i + 1)(j + 1) <= visits by then, so these few
    sums are compared directly.
    """
    m1, m2 = min(visits, d1.shape[1]), min(visits, d2.shape[1])

    def best(d, m):
        o = np.argpartition(d, m - 1, axis=1)[:, :m] if m < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))
        v = np.take_along_axis(d, o, 1)
        s = np.argsort(v, axis=1, kind="stable")
        return np.take_along_axis(o, s, 1), np.take_along_axis(v, s, 1)

    (o1, v1), (o2, v2) = best(d1, m1), best(d2, m2)
    stairs = [(i, j) for i in range(m1) for j in range(m2) if (i + 1) * (j + 1) <= visits]
    i, j = np.array(stairs).T
    sums = v1[:, i] + v2[:, j]
    take = np.argsort(sums, axis=1, kind="stable")[:, : min(visits, len(stairs))]
    return np.take_along_axis(o1[:, i], take, 1), np.take_along_axis(o2[:, j], take, 1)


def deep_pairs(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs with rows that :func:`traverse` reaches until they hold ``want`` rows; all sums sorted at once give its order."""
    c1, c2 = np.nonzero(sizes)
    rank1, rank2 = np.argsort(np.argsort(d1, kind="stable")), np.argsort(np.argsort(d2, kind="stable"))
    order = np.lexsort((rank2[c2], rank1[c1], d1[c1] + d2[c2]))
    have = np.cumsum(sizes[c1[order], c2[order]])
    order = order[: int(np.searchsorted(have, want)) + 1]
    return c1[order], c2[order]


def _measure(index: MultiIndex, vectors: DataFrame, block_rows: int) -> None:
    """Count the rows of all cells (all rows, summed on the executors) and fix the blocks."""
    k1, k2, dim = len(index.first), len(index.second), index.dim

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k1 * k2, np.int64)
        for b in batches:
            d1, d2 = index.distances(unpack(b.column(0), dim))
            c1, c2 = d1.argmin(1), d2.argmin(1)
            total += np.bincount(c1 * k2 + c2, minlength=k1 * k2)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    cells = vectors.select("vec").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    sizes = np.zeros(k1 * k2, np.int64)
    sizes[cells["cell"]] = cells["n"]
    index.sizes = sizes.reshape(k1, k2)
    index.names = even_names(vectors.sparkSession, index.divide(block_rows))


def split_copies(vec: pa.Array, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with equal bytes the ``keep`` lowest ids stay: (rows that stay, rows that do not, for each of these the row of the lowest id)."""
    if isinstance(vec, pa.ChunkedArray):
        vec = vec.combine_chunks()
    codes = vec.dictionary_encode().indices.to_numpy()
    none = np.zeros(0, np.int64)
    if not len(codes) or np.bincount(codes).max() <= keep:
        return np.arange(len(ids)), none, none
    order = np.lexsort((ids, codes))
    start = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
    first = np.repeat(start, np.diff(np.append(start, len(ids))))
    rank = np.arange(len(ids)) - first
    return np.sort(order[rank < keep]), order[rank >= keep], order[first[rank >= keep]]


def _visits(index: MultiIndex, visits: int, deep_share: float | None, every: int | None, k: int):
    """Rows to (block, id, vec, own, cells, copy_of).

    The own block with its cell in ``own``, and each block with ``cells`` to visit, where ``own`` is -1; cells are
    numbered first * k2 + second.  A surplus copy has, in place of the vector, its similarity to itself, and the id it is a ``copy_of``.
    """
    dim, k2 = index.dim, len(index.second)
    want = None if deep_share is None else int(math.ceil(deep_share * index.sizes.sum())) + k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "id", "vec", "own", "cells", "copy_of"]
        for b in batches:
            if not b.num_rows:
                continue
            ids, vec = b.column(0).to_numpy(), b.column(1)
            stay, rest, of = split_copies(vec, ids, k + 1)
            asks = np.ones(len(ids), bool) if want is None else ids % every == 0
            if len(rest):
                rest, of = rest[asks[rest]], of[asks[rest]]
                asks[of] = True  # their lists are those of the copies, too
                m = len(rest)
                y = unpack(vec.take(pa.array(rest)), dim)
                alike = np.round(np.einsum("ij,ij->i", y, y, dtype=np.float64), 12)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(index.names[ids[rest] % len(index.names)]),
                        pa.array(ids[rest]),
                        pa.array([v.tobytes() for v in alike], pa.binary()),
                        pa.array(np.full(m, -1, np.int32)),
                        pa.array([[]] * m, pa.list_(pa.int32())),
                        pa.array(ids[of]),
                    ],
                    names,
                )
            # cells are those of the whole batch, as they were counted
            d1, d2 = index.distances(unpack(vec, dim))
            asks, d1, d2 = asks[stay], d1[stay], d2[stay]
            ids, vec = ids[stay], vec.take(pa.array(stay))
            n = len(ids)
            c1, c2 = d1.argmin(1), d2.argmin(1)
            if want is None:
                p1, p2 = first_pairs(d1, d2, visits)
                who = np.repeat(np.arange(n), p1.shape[1])
                p1, p2 = p1.ravel(), p2.ravel()
            else:
                asks = np.flatnonzero(asks)
                lists = [deep_pairs(d1[i], d2[i], index.sizes, want) for i in asks]
                who = np.repeat(asks, [len(v) for v, _ in lists])
                p1, p2 = (np.concatenate([v[j] for v in lists] or [np.zeros(0, np.int64)]) for j in (0, 1))
            full = index.sizes[p1, p2] > 0
            who, p1, p2 = who[full], p1[full], p2[full]
            # one record for each row and block: the entry, and where it visits cells of the block
            home = index.block(c1, c2)
            who = np.concatenate([np.arange(n), who])
            block = np.concatenate([home, index.block(p1, p2)])
            cell = np.concatenate([np.full(n, -1), p1 * k2 + p2])
            order = np.lexsort((cell, block, who))
            who, block, cell = who[order], block[order], cell[order]
            new = np.flatnonzero(np.r_[True, (np.diff(who) != 0) | (np.diff(block) != 0)])
            real = cell >= 0
            ends = np.cumsum(real)
            offsets = np.append(ends[new] - real[new], ends[-1]).astype(np.int32)
            cells = pa.ListArray.from_arrays(pa.array(offsets), pa.array(cell[real].astype(np.int32)))
            w, bl = who[new], block[new]
            own = np.where(bl == home[w], c1[w] * k2 + c2[w], -1)
            none = pa.nulls(len(w), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(bl), pa.array(ids[w]), vec.take(pa.array(w)), pa.array(own.astype(np.int32)), cells, none], names)

    return run


def _best(a: np.ndarray, b: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Numbers of each row's best ``k`` others, ties to the lower id, each other once."""
    order = np.lexsort((b, -sim, a))
    a, b = a[order], b[order]
    if not len(a):
        return order
    fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    order, a = order[fresh], a[fresh]
    start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    rank = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
    return order[rank < k]


def _within(index: MultiIndex, k: int, least: float, every: int | None):
    """Neighbours found in one block: (id, other, similarity, copy), each row's best ``k``, with exact similarities and ``copy`` 0.

    Where all rows ask, those of more than k + 1 copies have a row with the lowest of them as other and ``copy`` 1; surplus copies of a batch pass through with 2.
    """
    dim = index.dim

    def run(group: pa.Table) -> pa.Table:
        copy_of = group["copy_of"].combine_chunks()
        surplus = pa.array(np.flatnonzero(np.asarray(copy_of.is_valid())))
        links = [(group["id"].to_numpy()[surplus], copy_of.take(surplus).to_numpy(), np.frombuffer(b"".join(group["vec"].combine_chunks().take(surplus).to_pylist())), 2)]
        if len(surplus):
            group = group.take(pa.array(np.setdiff1d(np.arange(len(group)), surplus)))
        # copies that met here from different batches: the lowest ids stay entries
        own = group["own"].to_numpy().copy()
        entry = np.flatnonzero(own >= 0)
        _, rest, of = split_copies(group["vec"].combine_chunks().take(pa.array(entry)), group["id"].to_numpy()[entry], k + 1)
        if len(rest):
            rest, of = entry[rest], entry[of]
            own[rest] = -1
            if every is None:
                y = unpack(group["vec"].combine_chunks().take(pa.array(rest)), dim)
                all_ids = group["id"].to_numpy()
                links.append((all_ids[rest], all_ids[of], np.round(np.einsum("ij,ij->i", y, y, dtype=np.float64), 12), 1))
                stay = np.setdiff1d(np.arange(len(group)), rest)
                group, own = group.take(pa.array(stay)), own[stay]
        ids = group["id"].to_numpy()
        x = unpack(group["vec"], dim)
        cells = group["cells"].combine_chunks()
        at = cells.offsets.to_numpy()
        code = cells.values.to_numpy()[at[0] : at[-1]]
        asker = np.repeat(np.arange(len(ids)), np.diff(at))
        order = np.argsort(code, kind="stable")
        asker, code = asker[order], code[order]
        cell, starts = np.unique(code, return_index=True)
        ends = np.append(starts[1:], len(code))
        entries = np.argsort(own, kind="stable")
        entries = entries[own[entries] >= 0]
        lo, hi = np.searchsorted(own[entries], cell, "left"), np.searchsorted(own[entries], cell, "right")
        qs, rs, sims = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for s, e, l, h in zip(starts, ends, lo, hi):
            if l == h:
                continue
            r, q = entries[l:h], asker[s:e]
            xr = x[r].T
            step = max(1, 4_000_000 // len(r))
            for a in range(0, len(q), step):
                part = q[a : a + step]
                near = x[part] @ xr
                if every is not None and len(r) > k + 1:  # the best k + 1 of the cell, which may hold the row itself, and what is equal to the last of them
                    i, j = np.nonzero(near >= np.partition(near, len(r) - k - 1, axis=1)[:, len(r) - k - 1, None] - 1e-6)
                else:
                    i, j = np.nonzero(near >= least - 1e-5)
                i, j = part[i], r[j]
                other = ids[i] != ids[j]
                i, j = i[other], j[other]
                # the exact similarity, in double precision; equal but for the order of summation is equal
                sim = np.einsum("ij,ij->i", x[i], x[j], dtype=np.float64)
                ok = sim >= least
                sim = np.round(sim, 12)
                qs.append(i[ok])
                rs.append(j[ok])
                sims.append(sim[ok])
        q, r, sim = np.concatenate(qs), np.concatenate(rs), np.concatenate(sims)
        if every is None:  # what is near is near both ways
            q, r, sim = np.concatenate([q, r]), np.concatenate([r, q]), np.tile(sim, 2)
        a, b = ids[q], ids[r]
        keep = _best(a, b, sim, k)
        columns = [[a[keep], *(x[0] for x in links)], [b[keep], *(x[1] for x in links)], [sim[keep], *(x[2] for x in links)], [np.zeros(len(keep), np.int32), *(np.full(len(x[0]), x[3], np.int32) for x in links)]]
        return pa.table(dict(zip(("id", "other", "similarity", "copy"), map(np.concatenate, columns))))

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("id").orderBy(F.col("similarity").desc(), F.col("other"))
    return found.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)


def _lists_of_copies(copies: DataFrame, lists: DataFrame) -> DataFrame:
    """(id, other, similarity) for copies of a row that has a list: that row, and what is in its list."""
    theirs = lists.select(F.col("id").alias("of"), F.col("other").alias("next"), F.col("similarity").alias("s"))
    more = copies.select("id", F.col("other").alias("of")).join(theirs, "of").select("id", F.col("next").alias("other"), F.col("s").alias("similarity"))
    return copies.select("id", "other", "similarity").unionByName(more).where(F.col("id") != F.col("other"))


def top_similar(
    vectors: DataFrame,
    k: int = 5,
    least: float = -1.0,
    visits: int | None = None,
    deep_share: float | None = None,
    every: int | None = None,
    dim: int = DIM,
    block_rows: int = BLOCK_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(id, other, similarity, rank): the ``k`` most similar others of each row, ties to the lower id.

    ``vectors`` has (id, vec) with unique ids, see ``current_vectors``.  With ``least`` only
    neighbours of at least that similarity count: then ``visits`` cells a row are enough (by default 8, and more in
    proportion once there are over 192 centroids a half, as smaller cells part near rows more often).  With
    ``deep_share`` and ``every`` the queries are the rows whose id is divisible by ``every``, and
    each visits cells in heap order until they hold that share of all rows.  A row alone has
    no neighbours; an empty table gives none.  Exact copies are neighbours of each other, the lowest ids first, however many there are
    and however the rows are divided.
    """
    from lodevec.session import cut_lineage

    vectors = cut_lineage(vectors.select("id", "vec"))
    n = vectors.count()
    index = fit(vectors, n, dim, sample_rows, centres=4 if deep_share is None else DEEP_CENTRES)
    visits = visits or max(MIN_VISITS, len(index.first) // 24)
    _measure(index, vectors, block_rows)
    every = None if deep_share is None else every or 1
    spread = vectors.mapInArrow(_visits(index, visits, deep_share, every, k), "block long, id long, vec binary, own int, cells array<int>, copy_of long")
    found = spread.groupBy("block").applyInArrow(_within(index, k, least, every), "id long, other long, similarity double, copy int")
    found = cut_lineage(found)
    real = found.where(F.col("copy") == 0).select("id", "other", "similarity")
    if every is None:
        real = real.dropDuplicates(["id", "other"])
    crowded = [r["copy"] for r in found.where(F.col("copy") > 0).select("copy").distinct().collect()]
    if 1 in crowded:  # the lowest of all copies gives the lowest of each batch its list
        real = real.unionByName(_lists_of_copies(found.where(F.col("copy") == 1), _ranked(real, k))).dropDuplicates(["id", "other"])
    top = _ranked(real, k)
    if 2 in crowded:  # and these the others of their batch
        top = top.unionByName(_ranked(_lists_of_copies(found.where(F.col("copy") == 2), top), k))
    return top if every is None else top.where(F.pmod("id", F.lit(every)) == 0)


def near_pairs(top: DataFrame, least: float) -> DataFrame:
    """(id_a, id_b), smaller id first: pairs of which one is in the other's list, of at least this similarity."""
    pairs = top.where(F.col("similarity") >= least)
    return pairs.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


__all__ = ["MultiIndex", "deep_pairs", "first_pairs", "fit", "near_pairs", "top_similar", "traverse", "unit"]
