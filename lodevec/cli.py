"""Command line: python -m lodevec.cli --warehouse DIR COMMAND …

One command for each table operation.  Rows go in as JSON lines or Parquet and come out as text, JSON lines,
Parquet or Arrow.
"""

from __future__ import annotations

import argparse
import json
import subprocess
import sys
import threading
import time
from collections.abc import Callable, Sequence
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec import api
from lodevec.operators.memory import WEEKLY
from lodevec.session import local_session
from lodevec.sources.table import VectorColumn

FORMATS = ("text", "json", "parquet", "arrow")
SERVER_MAX_K = 10_000
PROBE_SECONDS = 60.0


def write_out(df: DataFrame, how: str, out: str | None = None) -> None:
    """Rows as text or JSON lines on standard output, or as a Parquet folder or an Arrow stream file at ``out``."""
    if how == "parquet":
        if not out:
            raise ValueError("parquet needs --out")
        df.write.parquet(out)
    elif how == "arrow":
        if not out:
            raise ValueError("arrow needs --out")
        t = df.toArrow()
        with pa.OSFile(out, "wb") as f, pa.ipc.new_stream(f, t.schema) as w:
            w.write_table(t)
    elif how == "json":
        for line in df.toJSON().toLocalIterator():
            print(line)
    else:
        print("\t".join(df.columns))
        for r in df.toLocalIterator():
            print("\t".join("" if v is None else str(v) for v in r))


def external_embedder(command: str) -> Callable:
    """Vectors from an external process: it reads a JSON list of texts and writes a JSON list of vectors; one call for each Arrow batch."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        given = [t or "" for t in texts]
        got = subprocess.run(command, shell=True, input=json.dumps(given), capture_output=True, text=True, check=True)
        vectors = json.loads(got.stdout)
        if len(vectors) != len(given):
            raise ValueError("the embedder gave another number of vectors")
        return pd.Series(vectors)

    return embed


def read_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.schema(schema).json(path)


def _vector(text: str) -> list[float]:
    return [float(x) for x in json.loads(text)]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodevec")
    p.add_argument("--warehouse", default="warehouse")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: tuple) -> None:
        s = sub.add_parser(name)
        for flags, how in args:
            s.add_argument(*flags.split(), **how)

    table = ("table", {})
    fmt = [("--format", {"choices": FORMATS, "default": "text"}), ("--out", {})]
    spec = [("--dim", {"type": int, "required": True}), ("--metric", {"default": "cosine"}), ("--model", {})]
    add("create", table, ("--schema", {"required": True}), ("--vector", {"default": "embedding"}), *spec, ("--partition-by", {"nargs": "*", "default": []}))
    add("insert", table, ("path", {}), ("--batch-id", {}), ("--deferred", {"action": "store_true"}))
    add("search", table, ("--query", {}), ("--text", {}), ("--columns", {"nargs": "*", "default": ["text"]}), ("--k", {"type": int, "default": 10}), ("--where", {}), ("--partition", {}), ("--prune", {"type": float}), *fmt)
    add("compact", table, ("--target-bytes", {"type": int, "default": 512 << 20}), ("--min-files", {"type": int, "default": 4}), ("--max-files", {"type": int, "default": 20}))
    add("decay-memories", table, ("--rate", {"type": float, "default": WEEKLY}), ("--as-of", {}))
    add("serve", ("--port", {"type": int, "default": 8080}), ("--host", {"default": "127.0.0.1"}))
    add("info", table, *fmt)
    add("read-changes", table, ("--start", {"type": int}), ("--end", {"type": int}), ("--key", {"nargs": "*", "default": []}), *fmt)
    add("migrate", table, ("--column", {"required": True}), ("--source", {"required": True}), ("--embed-cmd", {"required": True}), ("--dual", {"action": "store_true"}), *spec)
    add("delete-rows", table, ("--file", {"required": True}), ("--positions", {"nargs": "+", "type": int, "required": True}))
    add("delete-where", table, ("--column", {"required": True}), ("--values", {"nargs": "+", "required": True}))
    add("evolve", table, ("--rename", {"nargs": "*", "default": []}), ("--add", {"nargs": "*", "default": []}))
    add("add-vector-column", table, ("--column", {"required": True}), *spec)
    add("backfill-vector-column", table, ("--column", {"required": True}), ("--source", {"required": True}), ("--embed-cmd", {"required": True}))
    add("estimate", ("--rows", {"required": True}), ("--dim", {"type": int, "required": True}), ("--hnsw-m", {"type": int, "default": 16}), ("--pq-m", {"type": int}))
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "estimate":
        for r in api.estimate(a.rows, a.dim, a.hnsw_m, a.pq_m):
            print(json.dumps(r))
        return 0
    spark = spark or local_session()
    if a.command == "serve":
        server(spark, a.warehouse, a.host, a.port).serve_forever()
        return 0
    if a.command == "create":
        api.create_table(spark, a.warehouse, a.table, a.schema, [VectorColumn(a.vector, a.dim, a.metric, model=a.model)], a.partition_by)
        return 0
    t = api.open_table(spark, a.warehouse, a.table)
    if a.command == "insert":
        print(t.append(read_rows(spark, a.path, t.schema()), a.batch_id, a.deferred))
    elif a.command == "search":
        if (a.query is None) == (a.text is None):
            raise SystemExit("give --query or --text")
        q = api.search(t, _vector(a.query), a.k, where=a.where, partition=a.partition, prune_threshold=a.prune) if a.query else api.search_text(t, a.text, a.columns, a.k)
        write_out(q.to_df(), a.format, a.out)
    elif a.command == "compact":
        print(t.compact(a.target_bytes, a.min_files, a.max_files))
    elif a.command == "decay-memories":
        print(api.decay_memories(t, F.lit(a.as_of).cast("date") if a.as_of else F.current_date(), a.rate))
    elif a.command == "info":
        write_out(t.info(), a.format, a.out)
    elif a.command == "read-changes":
        write_out(t.read_changes(a.start, a.end, a.key), a.format, a.out)
    elif a.command == "migrate":
        print(t.migrate(external_embedder(a.embed_cmd), a.source, VectorColumn(a.column, a.dim, a.metric, model=a.model), a.dual))
    elif a.command == "delete-rows":
        print(t.delete_rows(a.file, a.positions))
    elif a.command == "delete-where":
        kind = t.schema()[a.column].dataType.simpleString()
        rows = spark.createDataFrame([(v,) for v in a.values], "v string").select(F.col("v").cast(kind).alias(a.column))
        print(t.delete_where(rows))
    elif a.command == "evolve":
        rename = dict(x.split("=", 1) for x in a.rename)
        add = {}
        for x in a.add:  # name:type or name:type=default
            name, _, rest = x.partition(":")
            kind, eq, default = rest.partition("=")
            add[name] = (kind, default if eq else None)
        print(t.evolve(rename, add))
    elif a.command == "add-vector-column":
        print(t.add_vector_column(VectorColumn(a.column, a.dim, a.metric, model=a.model)))
    elif a.command == "backfill-vector-column":
        print(t.backfill(a.column, external_embedder(a.embed_cmd), a.source))
    return 0


def server(spark: SparkSession, warehouse: str, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """POST /search, /write, /compact and GET /info?table=…, as JSON; k is at most 10,000.

    At most once a minute a search also looks, beside its answer, for what makes the table slow, and mends it.
    """
    seen: dict[str, float] = {}
    busy = threading.Lock()

    def probe(name: str) -> None:
        if time.monotonic() - seen.get(name, -1e9) < PROBE_SECONDS or not busy.acquire(blocking=False):
            return
        seen[name] = time.monotonic()

        def work() -> None:
            try:
                api.heal(api.open_table(spark, warehouse, name))
            except Exception as e:  # the next probe tries again
                print(f"{name}: {e}", file=sys.stderr)
            finally:
                busy.release()

        threading.Thread(target=work, daemon=True).start()

    def search(b: dict) -> object:
        t = api.open_table(spark, warehouse, b["table"])
        probe(b["table"])
        k = min(int(b.get("top_k", 10)), SERVER_MAX_K)
        q = api.search(t, b["query"], k, where=b.get("where"), partition=b.get("partition")) if "query" in b else api.search_text(t, b["text"], b.get("columns", ["text"]), k)
        return [json.loads(x) for x in q.to_df().toJSON().collect()]

    def write(b: dict) -> object:
        t = api.open_table(spark, warehouse, b["table"])
        rows = spark.read.schema(t.schema()).json(spark.sparkContext.parallelize([json.dumps(r) for r in b["rows"]], 1))
        return {"snapshot_id": t.append(rows, b.get("batch_id"))}

    def compact(b: dict) -> object:
        return {"snapshot_id": api.open_table(spark, warehouse, b["table"]).compact()}

    def info(b: dict) -> object:
        return json.loads(api.open_table(spark, warehouse, b["table"]).info().toJSON().first())

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, routes: dict, body: dict) -> None:
            path = self.path.partition("?")[0]
            try:
                code, out = (200, routes[path](body)) if path in routes else (404, {"error": "no such path"})
            except (KeyError, ValueError, FileNotFoundError) as e:
                code, out = 400, {"error": str(e)}
            data = json.dumps(out).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_POST(self) -> None:  # noqa: N802
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            except ValueError:
                body = {}
            self._answer({"/search": search, "/write": write, "/compact": compact}, body)

        def do_GET(self) -> None:  # noqa: N802
            from urllib.parse import parse_qsl

            self._answer({"/info": info}, dict(parse_qsl(self.path.partition("?")[2])))

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


if __name__ == "__main__":
    sys.exit(main())
