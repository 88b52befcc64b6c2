"""Search indexes that live with a table: cells with quantised codes or neighbour graphs, stored beside the data and named in its metadata.

An index covers the files it was built from.  A search takes candidates from it, looks their rows up in the live table (so deletes, predicates and exact
distances come from the rows themselves), and compares all rows of files that the index does not cover.  Candidates are fetched again in larger numbers while
deletes or a predicate leave fewer than k.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodevec.functions.quant import ProductQuantizer
from lodevec.operators import graph, ivf, knn
from lodevec.sources.table import FILE, POSITION, ROW_ID, Table

KINDS = ("ivf_pq", "graph", "exact")
FIRST_FACTOR, GROWTH = 10, 4


def _spec(table: Table, column: str | None) -> dict:
    vectors = table.meta["vectors"]
    spec = next((v for v in vectors if column in (None, v["name"])), None)
    if spec is None:
        raise ValueError(f"no vector column {column}")
    return spec


def _state(table: Table, column: str) -> dict | None:
    return table.meta.get("indexes", {}).get(column)


def _save(table: Table, column: str, state: dict) -> None:
    table.log.update(lambda m: m | {"indexes": m.get("indexes", {}) | {column: state}})


def _pack(index: ivf.IvfIndex) -> bytes:
    out = io.BytesIO()
    np.savez(out, centres=index.centres, books=index.pq.books, nprobe=index.nprobe, residual=index.residual)
    return out.getvalue()


def _unpack(data: bytes, metric: str) -> ivf.IvfIndex:
    z = np.load(io.BytesIO(data))
    return ivf.IvfIndex(metric, z["centres"], ProductQuantizer(z["books"]), bool(z["residual"]), int(z["nprobe"]))


def build_index(table: Table, kind: str = "auto", column: str | None = None, **how) -> dict:
    """Build, or with files that came since extend, the index of a vector column; its state as kept in the metadata.

    ``auto`` takes cells and codes for 5,000 rows or more on over eight cores, else none.  Codebooks are fitted once, on a bounded sample; rows of files that come
    later are coded by the same ones, so all codes can be compared.  Another kind, or ``rebuild=True``, starts anew.  If it fails, the state is ``failed`` with the
    reason, the error is raised, and searches compare all rows.
    """
    spec = _spec(table, column)
    name, rebuild = spec["name"], how.pop("rebuild", False)
    if kind == "auto":
        kind = ivf.choose(table.info().first()["rows"], table.spark.sparkContext.defaultParallelism)
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(KINDS)}")
    if kind == "exact":
        state = {"kind": kind, "status": "ready", "parts": []}
        _save(table, name, state)
        return state
    old = _state(table, name)
    goes_on = old is not None and old["kind"] == kind and old["status"] == "ready" and not rebuild
    parts = list(old["parts"]) if goes_on else []
    place = f"{table.root}/index/{uuid.uuid4().hex}"
    try:
        files = table.files()
        todo = files.join(_covered(table, parts), "path", "left_anti") if parts else files
        rows = table.scan(files=todo, with_identity=True).where(F.col(name).isNotNull()).select(F.col(ROW_ID).alias("row_id"), F.col(FILE).alias("file"), name)
        n = rows.count()
        if n:
            if kind == "ivf_pq":
                index = _model(table, parts, spec["metric"]) if parts else ivf.train(rows, name, "row_id", spec["metric"], **how)
                placed = ivf.build(rows, index, name)
                placed.select("cell", "codes", "row_id", "file").write.partitionBy("cell").parquet(f"{place}/cells")
                model = _pack(index)
                table.spark.createDataFrame(pa.table({"model": pa.array([model], pa.binary())})).coalesce(1).write.parquet(f"{place}/model")
            else:
                graph.build(rows, "row_id", name, spec["metric"], rows=n, **how).write.parquet(f"{place}/graphs")
                rows.select("row_id", "file").write.parquet(f"{place}/ids")
            todo.select("path").coalesce(1).write.parquet(f"{place}/files")
            parts.append(place)
        state = {"kind": kind, "status": "ready", "parts": parts}
    except Exception as e:
        _save(table, name, {"kind": kind, "status": "failed", "parts": [], "error": str(e)[:300]})
        raise
    _save(table, name, state)
    return state


def _covered(table: Table, parts: Sequence[str]) -> DataFrame:
    return table.spark.read.parquet(*[f"{p}/files" for p in parts])


def _model(table: Table, parts: Sequence[str], metric: str) -> ivf.IvfIndex:
    return _unpack(bytes(table.spark.read.parquet(f"{parts[0]}/model").first()["model"]), metric)


def status(table: Table, column: str | None = None) -> DataFrame:
    """(column, kind, status, error, files_indexed, files_flat, reason): what a search would do, and why files are compared in full."""
    name = _spec(table, column)["name"]
    state = _state(table, name)
    files = table.files()
    total = files.count()
    covered = files.join(_covered(table, state["parts"]), "path", "left_semi").count() if state and state["status"] == "ready" and state["parts"] else 0
    if state is None:
        reason = "no index was built"
    elif state["status"] == "failed":
        reason = "the index failed"
    elif state["kind"] == "exact":
        reason = "exact search was chosen"
    else:
        reason = "files came after the index" if covered < total else None
    row = (name, state["kind"] if state else None, state["status"] if state else None, (state or {}).get("error"), covered, total - covered, reason)
    return table.spark.createDataFrame([row], "column string, kind string, status string, error string, files_indexed long, files_flat long, reason string")


def _candidates(table: Table, state: dict, spec: dict, query: Sequence[float], n: int, nprobe: int | None, width: int) -> list:
    """(row_id, file) of about the ``n`` nearest rows by the index alone: no data file is read."""
    spark, parts = table.spark, state["parts"]
    if state["kind"] == "ivf_pq":
        index = _model(table, parts, spec["metric"])
        q = index.prepare(query)
        cells, rows = index.cells(q, nprobe), None
        for p in parts:
            part = spark.read.parquet(f"{p}/cells").where(F.col("cell").isin(cells))
            rows = part if rows is None else rows.unionByName(part)
        return ivf.with_code_distance(rows, index, q, cells, "d").orderBy("d", "row_id").limit(n).select("row_id", "file").collect()
    graphs = spark.read.parquet(*[f"{p}/graphs" for p in parts])
    found = graph.search(graphs, [query], n, max(width, n), spec["metric"]).select(F.col("key").alias("row_id"))
    return spark.read.parquet(*[f"{p}/ids" for p in parts]).join(F.broadcast(found), "row_id").select("row_id", "file").collect()


def search(table: Table, query: Sequence[float], k: int = 10, column: str | None = None, where: Column | str | None = None, nprobe: int | None = None, width: int = 100) -> DataFrame | None:
    """The k nearest live rows with their identity and ``_distance``, or None where there is no index to use.

    Up to 10 k candidates come from the index, four times as many when too few of them are live and meet ``where``, and so on until k are found or the
    probed part of the index is used up.
    """
    spec = _spec(table, column)
    state = _state(table, spec["name"])
    if state is None or state["status"] != "ready" or not state["parts"]:
        return None
    knn.check_query(query, spec["dim"], k)
    files = table.files()
    rest = files.join(_covered(table, state["parts"]), "path", "left_anti")
    current = {r["path"] for r in files.select("path").collect()}
    n = k * FIRST_FACTOR
    while True:
        got = _candidates(table, state, spec, query, n, nprobe, width)
        held = [r for r in got if r["file"] in current]
        rows = None
        if held:
            rows = table.scan(paths=sorted({r["file"] for r in held}), with_identity=True).where(F.col(ROW_ID).isin([r["row_id"] for r in held]))
            rows = rows.where(where) if where is not None else rows
        if len(got) < n or (rows is not None and rows.limit(k).count() >= k):
            break
        n *= GROWTH
    flat = table.scan(files=rest, with_identity=True)
    flat = flat.where(where) if where is not None else flat
    both = flat if rows is None else rows.unionByName(flat)
    return knn.search(both, query, k, spec["metric"], spec["name"], ROW_ID)


class SearchSession:
    """A snapshot of a table loaded once for many searches: rows and vectors are kept in memory and on disk across the executors until :meth:`close`.

    Deletes are applied when it opens; later changes do not show.
    """

    def __init__(self, table: Table, column: str | None = None, snapshot_id: int | None = None, where: Column | str | None = None):
        self.spec = _spec(table, column)
        rows = table.scan(snapshot_id, with_identity=True)
        self.rows = (rows.where(where) if where is not None else rows).persist()

    def search(self, query: Sequence[float], k: int = 10, where: Column | str | None = None) -> DataFrame:
        hits = knn.search(self.rows, query, k, self.spec["metric"], self.spec["name"], ROW_ID, where=where, dim=self.spec["dim"])
        return hits.drop(FILE, POSITION, ROW_ID)

    def search_batch(self, queries: DataFrame, k: int = 10, query_key: str = "query_id", query_vector: str = "embedding") -> DataFrame:
        """(query key, _row_id, distance, rank) for each row of ``queries``."""
        return knn.search_batch(self.rows, queries, k, self.spec["metric"], self.spec["name"], ROW_ID, query_key, query_vector)

    def close(self) -> None:
        self.rows.unpersist()

    def __enter__(self) -> SearchSession:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
