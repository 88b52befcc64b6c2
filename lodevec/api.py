"""The user-facing surface: named tables in a warehouse, lazy searches, agents with memory."""

from __future__ import annotations

import collections
import datetime as dt
import os
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodevec.operators import bm25, context, fusion, knn, memory
from lodevec.plans import estimate as _estimate
from lodevec.plans import prune
from lodevec.sources import index as _index
from lodevec.sources import textindex
from lodevec.sources.index import SearchSession, build_index, status as index_status
from lodevec.sources.table import FILE, POSITION, Table, VectorColumn


def table_root(warehouse: str, name: str) -> str:
    """Folder of ``namespace.name``; a bare name is in the namespace ``default``."""
    space, _, bare = name.rpartition(".")
    return os.path.join(warehouse, space or "default", bare)


def create_table(
    spark: SparkSession, warehouse: str, name: str, schema, vectors: Sequence[VectorColumn] = (), partition_by: Sequence[str] = (), properties: dict | None = None
) -> Table:
    return Table.create(spark, table_root(warehouse, name), schema, vectors, partition_by, properties)


def open_table(spark: SparkSession, warehouse: str, name: str) -> Table:
    return Table.open(spark, table_root(warehouse, name))


class SearchQuery:
    """A search that has not run: ``limit`` and the outputs can be chosen later."""

    def __init__(self, build: Callable[[int], DataFrame], k: int):
        self._build, self._k = build, k

    def limit(self, k: int) -> SearchQuery:
        return SearchQuery(self._build, k)

    def to_df(self) -> DataFrame:
        return self._build(self._k)

    def to_list(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.to_df().collect()]

    def to_pandas(self) -> pd.DataFrame:
        return self.to_df().toPandas()

    def to_arrow(self):
        return self.to_df().toArrow()


def _primary(table: Table) -> dict:
    vectors = table.meta["vectors"]
    if not vectors:
        raise ValueError("the table has no vector column")
    return vectors[0]


def live(table: Table, snapshot_id: int | None = None, partition: str | None = None, query: Sequence[float] | None = None, threshold: float | None = None, column: str | None = None) -> DataFrame:
    """Rows to search: pruned by partition and, if a threshold is given, by the geometry of the files, with their identity."""
    files = table.files(snapshot_id)
    spec = _primary(table) if table.meta["vectors"] else None
    if threshold is not None and query is not None and spec and column in (None, spec["name"]):
        files = prune.by_geometry(files, query, threshold, spec["metric"])
    return table.scan(snapshot_id, partition, files=files, with_identity=True)


def search(
    table: Table, query: Sequence[float], k: int = 10, column: str | None = None, metric: str | None = None, where: Column | str | None = None, partition: str | None = None,
    snapshot_id: int | None = None, score: Callable[[Column], Column] | None = None, prune_threshold: float | None = None, with_data: bool = True, exact: bool = False, nprobe: int | None = None,
) -> SearchQuery:
    """Nearest rows of a table; pointers only (file, position, distance) unless ``with_data``.

    If the column has an index (see :func:`build_index`), it gives the candidates, unless the search is ``exact``, of an older snapshot, of one
    partition, by another metric, pruned by geometry, or ranked by a score of its own.
    """
    spec = next((v for v in table.meta["vectors"] if v["name"] == column), None) if column else _primary(table)
    if spec is None:
        raise ValueError(f"no vector column {column}")
    if len(query) != spec["dim"]:
        raise ValueError(f"model mismatch: the query has {len(query)} components, {spec['name']} has {spec['dim']}")

    plain = not exact and score is None and snapshot_id is None and partition is None and prune_threshold is None and knn.metric_name(metric or spec["metric"]) == knn.metric_name(spec["metric"])

    def build(n: int) -> DataFrame:
        hits = _index.search(table, query, n, spec["name"], where, nprobe) if plain else None
        rows = live(table, snapshot_id, partition, query, prune_threshold, spec["name"]) if hits is None else None
        hits = hits if hits is not None else knn.search(rows, query, n, metric or spec["metric"], spec["name"], "_row_id", where=where, score=score)
        return hits.drop(FILE, POSITION, "_row_id") if with_data else hits.select(F.col(POSITION).alias("row_id"), F.col("_distance").alias("distance"), F.col(FILE).alias("file_path"))

    return SearchQuery(build, k)


def append(table: Table, df: DataFrame, batch_id: str | None = None, index: str | None = "auto") -> int | None:
    """Append rows and bring the primary column's index up to date: ``auto``, ``ivf_pq``, ``graph``, or None for later, by :func:`build_index`."""
    done = table.append(df, batch_id)
    if index is not None and table.meta["vectors"]:
        build_index(table, index)
    return done


def heal(table: Table) -> list[str]:
    """Mend what makes searches slow: geometry that is still to be computed, files of other writers without it, a failed index.  What was done."""
    done, facts = [], table.info().first()
    if facts["indexing"]:
        table.index_files()
        done.append("geometry")
    if table.meta["vectors"] and facts["without_geometry"] > facts["indexing"]:
        table.compact()
        done.append("compaction")
    for column, state in table.meta.get("indexes", {}).items():
        if state["status"] == "failed":
            build_index(table, state["kind"], column, rebuild=True)
            done.append(f"index of {column}")
    return done


def search_text(table: Table, query: str, columns: Sequence[str], k: int = 10, snapshot_id: int | None = None) -> SearchQuery:
    """Best rows by BM25 over the joined text columns, with ``_distance`` = -score; from the stored text index, if it has these columns and covers all files."""
    if not columns:
        raise ValueError("at least one text column is needed")

    def build(n: int) -> DataFrame:
        stored = textindex.state(table)
        if snapshot_id is None and stored and stored["columns"] == list(columns):
            hits = textindex.search(table, query, n)
            if hits is not None:
                return hits.drop(FILE, POSITION, "_row_id")
        rows = table.scan(snapshot_id, with_identity=True).withColumn("__text", F.concat_ws(" ", *columns))
        hits = bm25.search_text(rows, query, n, "__text", "_row_id").withColumnRenamed("score", "__s")
        out = rows.join(F.broadcast(hits), "_row_id").withColumn("_distance", -F.col("__s"))
        return out.orderBy("_distance", "_row_id").drop("__text", "__s", FILE, POSITION, "_row_id")

    return SearchQuery(build, k)


def search_multimodal(table: Table, queries: Sequence[tuple[str, Sequence[float], float]], k: int = 10, where: Column | str | None = None) -> SearchQuery:
    """Weighted reciprocal-rank fusion over several vector columns, with full rows and ``_distance`` = -score."""
    dims = {v["name"]: v["dim"] for v in table.meta["vectors"]}
    for name, q, _ in queries:
        if name in dims and len(q) != dims[name]:
            raise ValueError(f"model mismatch in {name}")

    def build(n: int) -> DataFrame:
        rows = table.scan(with_identity=True)
        hits = fusion.search_multimodal(rows, queries, n, key="_row_id", where=where).withColumnRenamed("distance", "_distance")
        return knn.fetch_rows(hits, rows, "_row_id").drop("rank", FILE, POSITION, "_row_id")

    return SearchQuery(build, k)


def hybrid_search(table: Table, query: Sequence[float], text_query: str, text: str, k: int = 10, weight: float = 0.5, linear: bool = False, union: bool = False, prune_files: bool = False) -> SearchQuery:
    """Vector candidates ordered again with BM25; with ``prune_files`` only of files that may hold a word of the text query, by their stored Bloom filters."""
    spec = _primary(table)

    def build(n: int) -> DataFrame:
        rows = table.scan(files=textindex.may_hold(table, text_query) if prune_files else None, with_identity=True)
        fuse = fusion.hybrid_linear if linear else fusion.hybrid_rrf
        hits = fuse(rows, query, text_query, n, weight, vector=spec["name"], text=text, key="_row_id", metric=spec["metric"], union=union)
        order = F.col("score") if linear else -F.col("score")
        return rows.join(F.broadcast(hits), "_row_id").orderBy(order, "_row_id").drop(FILE, POSITION, "_row_id")

    return SearchQuery(build, k)


def assemble_context(chunks: DataFrame, max_tokens: int = 4096, **how) -> str:
    """The context text of one query's chunks."""
    one = chunks.withColumn("__q", F.lit(1))
    row = context.assemble_chunks(one, "__q", max_tokens, **how).first()
    return row["text"] if row else "<context>\n</context>"


def estimate(rows: str | int, dim: int, hnsw_m: int = 16, pq_m: int | None = None) -> list[dict]:
    return _estimate.storage(rows, dim, hnsw_m, pq_m)


def hardware_info(spark: SparkSession) -> dict:
    """Cores of the session and what index would be chosen for large tables."""
    cores = spark.sparkContext.defaultParallelism
    return {"cores": cores, "gpu": False, "recommended": "ivf_pq" if cores > 8 else "exact"}


AGENT_SCHEMA = (
    "agent_id string, session_id string, step_index long, mem_type string, record_id string, text string, importance double, created_at timestamp, last_accessed_at timestamp, "
    "access_count long, tool_name string, tool_input_json string, tool_output_json string, outcome string, latency_ms long, embedding array<float>"
)
OUTCOMES = ("success", "failure", "timeout")


class Agent:
    """Memories and tool calls of an agent in a table; recalled by similarity, recency and importance."""

    def __init__(self, table: Table, agent_id: str, embed: Callable[[str], Sequence[float]], session_id: str | None = None):
        self.table, self.agent_id, self.embed, self.session_id, self.step = table, agent_id, embed, session_id or uuid.uuid4().hex, 0

    @staticmethod
    def create_table(spark: SparkSession, root: str, dim: int) -> Table:
        return Table.create_or_open(spark, root, AGENT_SCHEMA, vectors=[VectorColumn("embedding", dim)])

    def _add(self, **values) -> str:
        now = dt.datetime.now(dt.timezone.utc)
        base = {"agent_id": self.agent_id, "session_id": self.session_id, "step_index": self.step, "record_id": uuid.uuid4().hex, "created_at": now, "last_accessed_at": now, "access_count": 0}
        row = base | values
        names = [f.name for f in self.table.schema().fields]
        self.table.append(self.table.spark.createDataFrame([tuple(row.get(n) for n in names)], self.table.schema()))
        self.step += 1
        return row["record_id"]

    def remember(self, text: str, importance: float = 0.5, mem_type: str = "episodic") -> str:
        return self._add(text=text, importance=min(max(float(importance), 0.0), 1.0), mem_type=mem_type, embedding=[float(x) for x in self.embed(text)])

    def log_tool_call(self, name: str, input_json: str, output_json: str, outcome: str = "success", latency_ms: int | None = None) -> str:
        if outcome not in OUTCOMES:
            raise ValueError(f"outcome must be one of {OUTCOMES}")
        text = f"{name} {input_json} {output_json}"
        return self._add(
            text=text, importance=0.5, mem_type="tool_call", tool_name=name, tool_input_json=input_json, tool_output_json=output_json, outcome=outcome, latency_ms=latency_ms,
            embedding=[float(x) for x in self.embed(text)],
        )

    def recall(self, query: str, k: int = 5, rate: float = memory.WEEKLY, as_of: dt.datetime | None = None, mem_type: str | None = None) -> DataFrame:
        mine = self.table.scan().where(F.col("agent_id") == self.agent_id)
        if mem_type is not None:
            mine = mine.where(F.col("mem_type") == mem_type)
        return memory.recall(mine, [float(x) for x in self.embed(query)], F.lit(as_of or dt.datetime.now(dt.timezone.utc)).cast("timestamp"), k, rate=rate)

    def assemble_context(self, query: str, k: int = 10, max_tokens: int = 4096) -> str:
        got = self.recall(query, k)
        chunks = got.select(F.col("session_id").alias("document_id"), F.col("step_index").alias("chunk_index"), F.col("text").alias("chunk_text"), F.col("_score").alias("distance"), "embedding")
        return assemble_context(chunks, max_tokens)


class WorkingMemoryBuffer:
    """The last ``capacity`` memories of a process: the oldest is evicted, a search compares all of them, a drain writes them to a table."""

    def __init__(self, capacity: int):
        if capacity < 1:
            raise ValueError("capacity must be positive")
        self.entries: collections.deque = collections.deque(maxlen=capacity)

    def push(self, text: str, embedding: Sequence[float], importance: float = 0.5) -> None:
        self.entries.append((text, [float(x) for x in embedding], min(max(float(importance), 0.0), 1.0)))

    def search(self, query: Sequence[float], k: int = 5) -> list[tuple[float, str]]:
        """(cosine distance, text), nearest first, the older first among equals; 1 for a zero vector."""
        q, out = np.asarray(query, float), []
        for i, (text, v, _) in enumerate(self.entries):
            n = np.linalg.norm(q) * np.linalg.norm(v)
            out.append((1.0 if n == 0 else 1 - float(q @ np.asarray(v)) / n, i, text))
        return [(d, t) for d, _, t in sorted(out)[: max(k, 0)]]

    def drain_to_table(self, table: Table, text: str = "text", vector: str = "embedding", importance: str | None = None) -> int | None:
        """Append all entries and forget them; they stay if the append fails."""
        names = [text, vector, *([importance] if importance else [])]
        schema = T.StructType([table.schema()[n] for n in names])
        done = table.append(table.spark.createDataFrame([e[: len(names)] for e in self.entries], schema))
        self.entries.clear()
        return done


def model_tag(tag: str) -> tuple[str, str | None]:
    """(name, version) of ``name@version``."""
    name, at, version = tag.partition("@")
    return name, version if at else None


def check_model(table: Table, column: str, dim: int, model: str | None = None) -> str | None:
    """An error for another dimension than the column's; a warning text for another model name."""
    spec = next((v for v in table.meta["vectors"] if v["name"] == column), None)
    if spec is None or spec["dim"] != dim:
        raise ValueError(f"model mismatch: {column} has {spec['dim'] if spec else 'no'} components, not {dim}")
    if model and spec["model"] and model_tag(model)[0] != model_tag(spec["model"])[0]:
        return f"vectors of {model} meet a column of {spec['model']}"
    return None


def decay_memories(table: Table, as_of: Column, rate: float = memory.WEEKLY, into: str = "recency_weight") -> int | None:
    """Store the recency weight of every row; the column is added if it is missing."""
    if into not in {f.name for f in table.schema().fields}:
        table.evolve(add={into: ("double", None)})
    return table.rewrite(lambda df: df.withColumn(into, memory.recency_weight(as_of, F.col("last_accessed_at"), rate, whole=True)))
