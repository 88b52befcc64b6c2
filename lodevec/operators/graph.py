"""A navigable graph index: layered neighbour graphs of bounded shards, searched best-first.

Rows are divided into shards by a hash of the key; each shard is one small graph that a task builds and a task searches,
and the shards' results are merged.  Links are chosen for diversity: a candidate is linked only if it is nearer to the node
than to the node's other links.  The graph is a table (one row for each shard) that is written and read like any other.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodevec.functions.vectors import metric_name

SHARD_ROWS = 20_000
LINKS, BUILD_WIDTH = 16, 150


@dataclass
class Graph:
    """Vectors of a shard, the links of each layer (-1 for none), and the entry node."""

    keys: np.ndarray
    x: np.ndarray
    layers: list[dict[int, np.ndarray]]
    entry: int
    metric: str

    def distances(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        x = self.x[nodes]
        if self.metric == "euclidean":
            return np.sqrt(((x - q) ** 2).sum(1))
        return -(x @ q) if self.metric == "dot" else 1 - x @ q

    def _layer(self, q: np.ndarray, start: list[tuple[float, int]], layer: int, width: int) -> list[tuple[float, int]]:
        """Best-first search in one layer; the ``width`` nearest nodes found, nearest first."""
        seen = {n for _, n in start}
        todo, best = list(start), [(-d, n) for d, n in start]
        heapq.heapify(todo)
        heapq.heapify(best)
        links = self.layers[layer]
        while todo:
            d, n = heapq.heappop(todo)
            if len(best) >= width and d > -best[0][0]:
                break
            fresh = [m for m in links.get(n, ()) if m not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for e, m in zip(self.distances(q, np.array(fresh)).tolist(), fresh):
                if len(best) < width or e < -best[0][0]:
                    heapq.heappush(todo, (e, m))
                    heapq.heappush(best, (-e, m))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted((-d, n) for d, n in best)

    def search(self, q: np.ndarray, k: int, width: int) -> list[tuple[float, int]]:
        if not len(self.keys):
            return []
        at = [(float(self.distances(q, np.array([self.entry]))[0]), self.entry)]
        for layer in range(len(self.layers) - 1, 0, -1):
            at = self._layer(q, at, layer, 1)
        return self._layer(q, at, 0, max(width, k))[:k]

    def _choose(self, node: int, found: list[tuple[float, int]], links: int) -> list[int]:
        """Diverse neighbours first, then the nearest of the rest."""
        kept: list[int] = []
        spare: list[int] = []
        for d, n in found:
            if n == node:
                continue
            if len(kept) == links:
                break
            if kept and self.distances(self.x[n], np.array(kept)).min() < d:
                spare.append(n)
            else:
                kept.append(n)
        return kept + spare[: links - len(kept)]

    def insert(self, node: int, level: int, links: int, width: int) -> None:
        """Link a node whose vector is there already."""
        q = self.x[node]
        if self.entry < 0:
            self.entry = node
            self.layers = [{node: np.zeros(0, np.int64)} for _ in range(level + 1)]
            return
        top = len(self.layers) - 1
        at = [(float(self.distances(q, np.array([self.entry]))[0]), self.entry)]
        for layer in range(top, level, -1):
            at = self._layer(q, at, layer, 1)
        for layer in range(min(level, top), -1, -1):
            at = self._layer(q, at, layer, width)
            room = 2 * links if layer == 0 else links
            mine = self._choose(node, at, links)
            self.layers[layer][node] = np.array(mine, np.int64)
            for m in mine:
                theirs = np.append(self.layers[layer].get(m, np.zeros(0, np.int64)), node)
                if len(theirs) > room:
                    d = self.distances(self.x[m], theirs)
                    order = np.argsort(d, kind="stable")
                    theirs = np.array(self._choose(m, list(zip(d[order].tolist(), theirs[order].tolist())), room), np.int64)
                self.layers[layer][m] = theirs
        for _ in range(level - top):
            self.layers.append({node: np.zeros(0, np.int64)})
            self.entry = node

    def to_bytes(self) -> bytes:
        out, parts = io.BytesIO(), {"keys": self.keys, "x": self.x.astype(np.float32), "meta": np.array([self.entry, len(self.layers)])}
        for i, layer in enumerate(self.layers):
            nodes = np.array(sorted(layer), np.int64)
            parts[f"n{i}"] = nodes
            parts[f"o{i}"] = np.cumsum([0, *[len(layer[n]) for n in nodes]])
            parts[f"l{i}"] = np.concatenate([layer[n] for n in nodes]) if len(nodes) else np.zeros(0, np.int64)
        np.savez(out, **parts)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes, metric: str) -> Graph:
        z = np.load(io.BytesIO(data))
        entry, n = z["meta"].tolist()
        layers = []
        for i in range(n):
            nodes, at, links = z[f"n{i}"], z[f"o{i}"], z[f"l{i}"]
            layers.append({int(v): links[at[j] : at[j + 1]] for j, v in enumerate(nodes)})
        return cls(z["keys"], z["x"].astype(np.float64), layers, entry, metric)


def build_graph(keys: np.ndarray, x: np.ndarray, metric: str, links: int = LINKS, width: int = BUILD_WIDTH, seed: int = 7) -> Graph:
    """Insert all rows in the order of a seeded shuffle; levels are geometric with ratio 1 / links."""
    x = np.asarray(x, np.float64)
    if metric in ("cosine", "normalized_cosine"):
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.where(n > 0, x / np.where(n > 0, n, 1), 0.0)
    g = Graph(np.asarray(keys), x, [], -1, metric)
    rng = np.random.default_rng(seed)
    level = (-np.log(np.maximum(rng.random(len(x)), 1e-12)) / math.log(links)).astype(int)
    for i in rng.permutation(len(x)):
        g.insert(int(i), int(level[i]), links, width)
    return g


def build(df: DataFrame, key: str = "id", vector: str = "embedding", metric: str = "cosine", rows: int | None = None, links: int = LINKS, width: int = BUILD_WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, n_rows, graph): an index of all rows with a vector; ``rows`` (counted if missing) sets the number of shards."""
    metric = metric_name(metric)
    good = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    shards = max(1, -(-(good.count() if rows is None else rows) // shard_rows))

    def make(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        g = build_graph(pdf["key"].to_numpy(np.int64), np.stack(pdf["v"].to_numpy()), metric, links, width)
        return pd.DataFrame({"shard": [k[0]], "n_rows": [len(pdf)], "graph": [g.to_bytes()]})

    return good.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInPandas(make, "shard long, n_rows long, graph binary")


def search(index: DataFrame, queries: Sequence[Sequence[float]], k: int = 10, width: int = 50, metric: str = "cosine") -> DataFrame:
    """(query_no, key, distance): the k nearest of every shard for each query; with one query, the first k by distance are the result."""
    metric = metric_name(metric)
    qs = np.asarray(queries, np.float64)
    if metric == "cosine":
        n = np.linalg.norm(qs, axis=1, keepdims=True)
        qs = qs / np.where(n > 0, n, 1)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for data in pdf["graph"]:
                g = Graph.from_bytes(data, metric)
                out += [(i, int(g.keys[n]), d) for i, q in enumerate(qs) for d, n in g.search(q, k, width)]
            yield pd.DataFrame(out, columns=["query_no", "key", "distance"])

    found = index.select("graph").mapInPandas(ask, "query_no long, key long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_no").orderBy("distance", "key"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)
