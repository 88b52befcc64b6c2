"""A table of Parquet files with snapshots, deletes, schema evolution, change feeds and maintenance.

The metadata (see ``log``) names the schemas, the snapshots, and for each snapshot its manifests and delete sets, which
are Parquet tables themselves: planning is queries over DataFrames.  Every reader starts from the
live view, which applies all deletes and resolves columns by field id.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodevec.functions.vectors import problem
from lodevec.sources.files import describe, partition_values
from lodevec.sources.log import Log, new_id, now_ms

FILE = "_file"
POSITION = "_position"
ROW_ID = "_row_id"
KEPT_ID = "__row_id"  # physical column of rewritten files

MAX_MANIFESTS = 16

MANIFEST = (
    "path string, record_count long, file_size_bytes long, sequence_number long, schema_id int, partition_value string, "
    "first_row_id long, batch_id string, index_status string, centroid array<double>, radius double, keeps_ids boolean, facts string"
)


MANIFEST_TYPES = {
    c.split()[0]: {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}[c.split()[1]] for c in MANIFEST.split(", ")
}


@dataclass
class VectorColumn:
    """What is known of a vector column: its dimension, metric, precision, modality and model."""

    name: str
    dim: int
    metric: str = "cosine"
    precision: str = "f16"
    modality: str = "text"
    model: str | None = None


def _plain(path: Column) -> Column:
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


class Table:
    """Open with :meth:`create`, :meth:`open` or :meth:`create_or_open`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.log = spark, root.rstrip("/"), Log(spark, root)

    # -- life cycle -------------------------------------------------------------------------------------------------

    @classmethod
    def create(
        cls, spark: SparkSession, root: str, schema: T.StructType | str, vectors: Sequence[VectorColumn] = (), partition_by: Sequence[str] = (), properties: dict | None = None
    ) -> Table:
        """A new table; an error if there is one."""
        t = cls(spark, root)
        if t.log.exists():
            raise FileExistsError(f"there is a table at {root}")
        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        fields = [{"id": i + 1, "name": f.name, "type": f.dataType.jsonValue(), "default": None} for i, f in enumerate(schema.fields)]
        meta = {
            "uuid": uuid.uuid4().hex, "location": t.root, "properties": properties or {}, "schemas": [{"schema_id": 0, "fields": fields}], "schema_id": 0,
            "vectors": [v.__dict__ for v in vectors], "partition_by": list(partition_by), "snapshots": [], "current": None, "sequence": 0, "next_row_id": 0,
        }
        t.log.create(1, meta)
        return t

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Table:
        t = cls(spark, root)
        t.log.read()
        return t

    @classmethod
    def create_or_open(cls, spark: SparkSession, root: str, schema: T.StructType | str, **how) -> Table:
        """The table there, or a new one; only its absence makes a new one, any other failure is raised."""
        return cls.open(spark, root) if Log(spark, root).exists() else cls.create(spark, root, schema, **how)

    def drop(self) -> None:
        self.log.remove()

    @property
    def meta(self) -> dict:
        return self.log.read()[1]

    def snapshots(self) -> DataFrame:
        """(snapshot_id, parent_id, sequence_number, timestamp, operation)."""
        rows = [(s["id"], s["parent"], s["sequence"], s["timestamp"], s["operation"]) for s in self.meta["snapshots"]]
        out = self.spark.createDataFrame(rows, "snapshot_id long, parent_id long, sequence_number long, ms long, operation string")
        return out.withColumn("timestamp", F.timestamp_millis("ms")).drop("ms")

    def _snapshot(self, snapshot_id: int | None = None, meta: dict | None = None) -> dict | None:
        meta = meta or self.meta
        wanted = meta["current"] if snapshot_id is None else snapshot_id
        if wanted is None:
            return None
        for s in meta["snapshots"]:
            if s["id"] == wanted:
                return s
        raise ValueError(f"no snapshot {wanted}")

    # -- schema -----------------------------------------------------------------------------------------------------

    @staticmethod
    def _fields(meta: dict, schema_id: int | None = None) -> list[dict]:
        wanted = meta["schema_id"] if schema_id is None else schema_id
        return next(s["fields"] for s in meta["schemas"] if s["schema_id"] == wanted)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f["name"], _type(f["type"])) for f in self._fields(self.meta)])

    def evolve(self, rename: dict[str, str] | None = None, add: dict[str, tuple[str, object]] | None = None) -> int:
        """Rename columns (their ids stay), then add columns as name -> (type, default); metadata only.  Returns the schema id."""

        def change(meta: dict) -> dict:
            fields = json.loads(json.dumps(self._fields(meta)))
            for old, new in (rename or {}).items():
                if any(f["name"] == new for f in fields):
                    raise ValueError(f"there is a column {new}")
                next_ = [f for f in fields if f["name"] == old]
                if not next_:
                    raise ValueError(f"no column {old}")
                next_[0]["name"] = new
                for v in meta["vectors"]:
                    v["name"] = new if v["name"] == old else v["name"]
                meta["partition_by"] = [new if p == old else p for p in meta["partition_by"]]
            top = max((f["id"] for s in meta["schemas"] for f in s["fields"]), default=0)
            for name, (kind, default) in (add or {}).items():
                if any(f["name"] == name for f in fields):
                    raise ValueError(f"there is a column {name}")
                top += 1
                fields.append({"id": top, "name": name, "type": T.StructType.fromDDL(f"`{name}` {kind}")[0].dataType.jsonValue(), "default": default})
            sid = max(s["schema_id"] for s in meta["schemas"]) + 1
            meta["schemas"].append({"schema_id": sid, "fields": fields})
            meta["schema_id"] = sid
            return meta

        return self.log.update(change)["schema_id"]

    def add_vector_column(self, spec: VectorColumn) -> int:
        """A further vector column; its rows are null until the backfill."""
        sid = self.evolve(add={spec.name: ("array<float>", None)})
        self.log.update(lambda m: m | {"vectors": [*m["vectors"], spec.__dict__]})
        return sid

    # -- writing ----------------------------------------------------------------------------------------------------

    def _conform(self, df: DataFrame, meta: dict) -> DataFrame:
        """Columns by name in the table's types; missing ones take their default; unknown ones are an error."""
        fields = self._fields(meta)
        extra = set(df.columns) - {f["name"] for f in fields} - {KEPT_ID}
        if extra:
            raise ValueError(f"columns not in the table: {sorted(extra)}")
        out = [(F.col(f["name"]) if f["name"] in df.columns else F.lit(f["default"])).cast(_type(f["type"])).alias(f["name"]) for f in fields]
        return df.select(*out, *([KEPT_ID] if KEPT_ID in df.columns else []))

    def _write_files(self, df: DataFrame, meta: dict, batch_id: str | None, status: str, validate: bool = True) -> list[dict]:
        """Write data files and describe them; nothing is visible until a commit names them."""
        df = self._conform(df, meta)
        if validate:
            for v in meta["vectors"]:
                if v["name"] in df.columns:
                    why = problem(v["name"], v["dim"])
                    bad = F.when(why.isNull() | (why == "null"), F.col(v["name"])).otherwise(F.raise_error(F.concat(F.lit(f"bad vector in {v['name']}: "), why)))
                    df = df.withColumn(v["name"], bad.cast("array<float>"))
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        # columns are stored by field id, so a rename touches no file
        ids = {f["name"]: f"f{f['id']}" for f in self._fields(meta)}
        parts = meta["partition_by"]
        out = df.select(*[F.col(c).alias(ids.get(c, c)) for c in df.columns])
        if parts:
            for p in parts:
                out = out.withColumn(f"p_{ids[p]}", F.col(ids[p]).cast("string"))
            write = out.write.partitionBy(*[f"p_{ids[p]}" for p in parts])
        else:
            write = out.write
        write.option("compression", meta["properties"].get("compression", "zstd")).parquet(folder)
        sizes = self.log.list_files(folder)
        if not sizes:
            return []
        # counts come from the footers, geometry from the vectors, both in one small job beside the files
        v = meta["vectors"][0] if meta["vectors"] and status == "ready" else None
        known = describe(self.spark, [p for p, _ in sizes], ids.get(v["name"]) if v else None, v["dim"] if v else 0, v["metric"] if v else "cosine")
        names = [f"p_{ids[p]}" for p in parts]
        return [
            {
                "path": p, "record_count": known[p]["n"], "file_size_bytes": size, "schema_id": meta["schema_id"], "partition_value": "\x1f".join(partition_values(p, names)) if parts else None,
                "batch_id": batch_id, "index_status": status, "centroid": known[p]["centroid"], "radius": known[p]["radius"], "keeps_ids": KEPT_ID in df.columns, "facts": known[p]["facts"],
            }
            for p, size in sizes
            if known[p]["n"]
        ]

    def _manifest(self, entries: list[dict], sequence: int, first: int) -> str:
        path, rows = f"{self.root}/manifests/{uuid.uuid4().hex}", []
        for e in entries:
            rows.append((e["path"], e["record_count"], e["file_size_bytes"], e.get("sequence_number") or sequence, e["schema_id"], e["partition_value"], e.get("first_row_id") if e.get("first_row_id") is not None else first, e["batch_id"], e["index_status"], e["centroid"], e["radius"], e["keeps_ids"], e.get("facts")))
            if e.get("first_row_id") is None:
                first += e["record_count"]
        columns = list(zip(*rows)) or [()] * len(MANIFEST_TYPES)
        entries = pa.table({n: pa.array(c, t) for (n, t), c in zip(MANIFEST_TYPES.items(), columns)})
        self.spark.createDataFrame(entries, MANIFEST).coalesce(1).write.parquet(path)
        return path

    def _commit(self, operation: str, build: Callable[[dict, dict | None, int, int], dict], batch_id: str | None = None) -> int | None:
        """Make a snapshot from what ``build(meta, parent, sequence, next_row_id)`` gives: manifests, deletes, rows added."""

        def change(meta: dict) -> dict | None:
            parent = self._snapshot(meta=meta)
            if batch_id is not None and any(batch_id in s["batches"] for s in meta["snapshots"]):
                return None
            sequence = meta["sequence"] + 1
            made = build(meta, parent, sequence, meta["next_row_id"])
            snap = {
                "id": new_id(), "parent": parent["id"] if parent else None, "sequence": sequence, "timestamp": now_ms(), "operation": operation,
                "manifests": made["manifests"], "equality": made.get("equality", parent["equality"] if parent else []),
                "positions": made.get("positions", parent["positions"] if parent else []), "batches": [batch_id] if batch_id is not None else [],
            }
            meta["snapshots"].append(snap)
            meta |= {"current": snap["id"], "sequence": sequence, "next_row_id": meta["next_row_id"] + made.get("rows", 0)}
            return meta

        return self.log.update(change)["current"]

    def append(self, df: DataFrame, batch_id: str | None = None, deferred: bool = False) -> int | None:
        """Add rows; the snapshot id.  A batch id that was committed before changes nothing.

        ``deferred`` leaves the geometry of the files to :meth:`index_files`.  Without rows there is no new snapshot.
        """
        meta = self.meta
        if batch_id is not None and any(batch_id in s["batches"] for s in meta["snapshots"]):
            return meta["current"]
        entries = self._write_files(df, meta, batch_id, "indexing" if deferred else "ready")
        if not entries and batch_id is None:
            return meta["current"]

        def build(meta: dict, parent: dict | None, sequence: int, first: int) -> dict:
            new = [self._manifest(entries, sequence, first)] if entries else []
            old = parent["manifests"] if parent else []
            if len(old) >= MAX_MANIFESTS:  # one file in place of many, so that planning opens few
                whole = f"{self.root}/manifests/{uuid.uuid4().hex}"
                self.files(parent["id"], meta).coalesce(1).write.parquet(whole)
                old = [whole]
            return {"manifests": [*old, *new], "rows": sum(e["record_count"] for e in entries)}

        return self._commit("append", build, batch_id)

    # -- reading ----------------------------------------------------------------------------------------------------

    def files(self, snapshot_id: int | None = None, meta: dict | None = None) -> DataFrame:
        """The manifest: one row for each data file of a snapshot."""
        s = self._snapshot(snapshot_id, meta)
        if s is None or not s["manifests"]:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(*s["manifests"])

    def scan(
        self, snapshot_id: int | None = None, partition: str | None = None, paths: Sequence[str] | None = None, with_identity: bool = False, files: DataFrame | None = None, meta: dict | None = None
    ) -> DataFrame:
        """The live rows of a snapshot in the current schema.

        ``partition`` and ``paths`` (or a pruned ``files``) restrict the files that are read.  Rows deleted by value or position are left
        out; columns a file lacks take their defaults, renamed ones are found by id.  ``with_identity`` adds the file, the position
        in it and the row's id, which rewrites keep.
        """
        meta = meta or self.meta
        snap = self._snapshot(snapshot_id, meta)
        fields = self._fields(meta)
        names = [f["name"] for f in fields]
        listed = self.files(snapshot_id, meta) if files is None else files
        if partition is not None:
            listed = listed.where(F.col("partition_value") == partition)
        if paths is not None:
            listed = listed.where(F.col("path").isin(list(paths)))
        info = listed.select("path", "schema_id", "keeps_ids").collect()
        out = None
        for sid, keeps in sorted({(r["schema_id"], r["keeps_ids"]) for r in info}):
            mine = [r["path"] for r in info if (r["schema_id"], r["keeps_ids"]) == (sid, keeps)]
            old = {f["id"]: f for f in self._fields(meta, sid)}
            # a file is read by field ids in the types it was written with
            stored = T.StructType([T.StructField(f"f{i}", _type(f["type"])) for i, f in old.items()] + ([T.StructField(KEPT_ID, T.LongType())] if keeps else []))
            df = self.spark.read.schema(stored).parquet(*mine)
            columns = [
                (F.col(f"f{f['id']}") if f["id"] in old else F.lit(f["default"])).cast(_type(f["type"])).alias(f["name"]) for f in fields
            ]
            kept = F.col(KEPT_ID) if keeps else F.lit(None).cast("long")
            df = df.select(*columns, _plain(F.col("_metadata.file_path")).alias(FILE), F.col("_metadata.row_index").alias(POSITION), kept.alias("__kept"))
            out = df if out is None else out.unionByName(df)
        if out is None:
            empty = T.StructType([T.StructField(f["name"], _type(f["type"])) for f in fields])
            df = self.spark.createDataFrame([], empty)
            return df.withColumns({FILE: F.lit(""), POSITION: F.lit(0).cast("long"), ROW_ID: F.lit(0).cast("long")}) if with_identity else df
        if with_identity or snap["equality"]:
            facts = listed.select(F.col("path").alias(FILE), "first_row_id", F.col("sequence_number").alias("__seq"))
            out = out.join(facts, FILE)
        if snap["positions"]:
            gone = self.spark.read.parquet(*snap["positions"]).distinct()
            out = out.join(gone, [FILE, POSITION], "left_anti")
        out = self._without_values(out, snap["equality"], meta)
        if not with_identity:
            return out.select(*names)
        return out.select(*names, FILE, POSITION, F.coalesce("__kept", F.col("first_row_id") + F.col(POSITION)).alias(ROW_ID))

    def _without_values(self, rows: DataFrame, sets: Sequence[dict], meta: dict, how: str = "left_anti") -> DataFrame:
        """Rows (with ``__seq``, the number of their file) that no delete by value removes: one join for each set of columns, in which a row is deleted if the
        latest delete of its values is later than its file."""
        by_id = {f["id"]: f["name"] for f in self._fields(meta)}
        by_columns: dict[tuple[str, ...], DataFrame] = {}
        for d in sets:
            values = self.spark.read.parquet(d["path"]).withColumn("__dseq", F.lit(d["sequence"]).cast("long"))
            columns = tuple(sorted(c for c in values.columns if c != "__dseq"))
            by_columns[columns] = by_columns[columns].unionByName(values) if columns in by_columns else values
        for columns, values in by_columns.items():
            latest = values.groupBy(*[F.col(c).alias(f"__d_{c}") for c in columns]).agg(F.max("__dseq").alias("__dseq"))
            cond = F.col("__seq") < F.col("__dseq")
            for c in columns:
                cond = cond & (F.col(by_id[int(c[1:])]) == F.col(f"__d_{c}"))
            rows = rows.join(latest, cond, how)
        return rows

    # -- deletes ----------------------------------------------------------------------------------------------------

    def delete_where(self, values: dict[str, Sequence] | DataFrame) -> int | None:
        """Delete rows whose columns equal a row of ``values`` (several columns: all of them), as of now.

        Later appends are not touched; nulls never match; compared in the column's type.
        """
        meta = self.meta
        fields = {f["name"]: f for f in self._fields(meta)}
        if isinstance(values, dict):
            n = {len(v) for v in values.values()}
            if len(n) != 1:
                raise ValueError("columns of values differ in length")
            kind = T.StructType([T.StructField(c, _type(fields[c]["type"])) for c in values])
            values = self.spark.createDataFrame(list(zip(*values.values())), kind)
        unknown = set(values.columns) - set(fields)
        if unknown:
            raise ValueError(f"no columns {sorted(unknown)}")
        path = f"{self.root}/deletes/{uuid.uuid4().hex}"
        values.select(*[F.col(c).cast(_type(fields[c]["type"])).alias(f"f{fields[c]['id']}") for c in values.columns]).distinct().write.parquet(path)

        def build(meta: dict, parent: dict | None, sequence: int, first: int) -> dict:
            if parent is None:
                return {"manifests": []}
            return {"manifests": parent["manifests"], "equality": [*parent["equality"], {"path": path, "sequence": sequence}]}

        return self._commit("delete", build)

    def delete_rows(self, file: str, positions: Sequence[int] | DataFrame) -> int | None:
        """Delete rows of a file by position; ``file`` may be the end of the path, but of one file only."""
        known = [r["path"] for r in self.files().where(F.col("path").endswith(file)).select("path").limit(2).collect()]
        if len(known) != 1:
            raise ValueError(f"{len(known) or 'no'} files end in {file}")
        rows = positions if isinstance(positions, DataFrame) else self.spark.createDataFrame([(int(p),) for p in positions], f"{POSITION} long")
        return self.delete_positions(rows.select(F.lit(known[0]).alias(FILE), F.col(POSITION).cast("long")))

    def delete_positions(self, rows: DataFrame) -> int | None:
        """Delete the rows of (file, position)."""
        path = f"{self.root}/deletes/{uuid.uuid4().hex}"
        rows.select(FILE, POSITION).distinct().write.parquet(path)
        return self._commit("delete", lambda m, p, s, f: {"manifests": p["manifests"], "positions": [*p["positions"], path]} if p else {"manifests": []})

    # -- rewriting --------------------------------------------------------------------------------------------------

    def rewrite(self, change: Callable[[DataFrame], DataFrame] | None = None, paths: Sequence[str] | None = None, partitions: int | None = None, operation: str = "replace", status: str = "ready") -> int | None:
        """Write the live rows of some files (all by default) anew and put them in place of the old, keeping row ids.

        Deletes are applied on the way, and delete sets that can touch no remaining file are dropped.  If another writer deleted rows of these files or replaced them meanwhile, the call fails and
        changes nothing.
        """
        meta = self.meta
        base = self._snapshot(meta=meta)
        if base is None:
            return None
        listed = self.files(base["id"], meta)
        old = set(paths) if paths is not None else {r["path"] for r in listed.select("path").collect()}
        live = self.scan(base["id"], paths=None if paths is None else list(old), with_identity=True, meta=meta)
        live = live.withColumn(KEPT_ID, F.col(ROW_ID)).drop(FILE, POSITION, ROW_ID)
        live = change(live) if change else live
        if partitions:
            live = live.coalesce(partitions)
        entries = self._write_files(live, meta, None, status, validate=False)
        batches = sorted({b for r in listed.where(F.col("path").isin(list(old))).select("batch_id").collect() for b in [r["batch_id"]] if b})
        for e in entries:
            e["batch_id"] = ",".join(batches) or None

        def build(now: dict, parent: dict, sequence: int, first: int) -> dict:
            if parent["equality"] != base["equality"] or parent["positions"] != base["positions"]:
                raise RuntimeError("rows were deleted while files were rewritten; nothing was changed")
            rest = self.files(parent["id"], now)
            if rest.where(F.col("path").isin(list(old))).count() != len(old):
                raise RuntimeError("files were replaced by another writer; nothing was changed")
            keep = f"{self.root}/manifests/{uuid.uuid4().hex}"
            rest.where(~F.col("path").isin(list(old))).coalesce(1).write.parquet(keep)
            oldest = rest.where(~F.col("path").isin(list(old))).agg(F.min("sequence_number")).first()[0]
            made = {"manifests": [keep], "equality": [d for d in parent["equality"] if oldest is not None and oldest < d["sequence"]]}
            if oldest is None:
                made["positions"] = []
            if entries:
                made["manifests"].append(self._manifest([e | {"first_row_id": 0} for e in entries], sequence, first))
            return made

        return self._commit(operation, build)

    def plan_compaction(self, target_bytes: int = 128 << 20, min_files: int = 4, max_files: int | None = 20, dominant: float | None = None) -> DataFrame:
        """Files to merge next: those without geometry first, then small ones, smallest first; none if too few are small.

        ``max_files`` None takes all.  With ``dominant`` a file that holds that share of the plan's rows or more stays where it is, so that one large file is not written again for a few small ones.
        """
        f = self.files()
        first = self.meta["vectors"]
        f = f.withColumn("foreign", F.col("centroid").isNull() if first else F.lit(False))
        small = (~F.col("foreign")) & (F.col("file_size_bytes") < target_bytes)
        enough = f.where(small).limit(min_files).count() >= min_files
        plan = f.where(F.col("foreign") | (small if enough else F.lit(False))).orderBy(F.desc("foreign"), "file_size_bytes", "path")
        plan = plan if max_files is None else plan.limit(max_files)
        if dominant is not None:
            whole = plan.agg(F.sum("record_count")).first()[0] or 0
            plan = plan.where(F.col("foreign") | (F.col("record_count") < dominant * whole))
        return plan

    def compact(self, target_bytes: int = 128 << 20, min_files: int = 4, max_files: int | None = 20, dominant: float | None = None, deferred: bool = False) -> int | None:
        """One pass: merge the planned files into as few as the target size allows.  Live rows and their ids stay the same.

        ``max_files`` None merges all small files in one job; ``dominant`` (0.4, say) leaves a file alone that holds most of the rows; ``deferred`` leaves geometry to :meth:`index_files`.
        """
        plan = self.plan_compaction(target_bytes, min_files, max_files, dominant).select("path", "file_size_bytes").collect()
        if len(plan) < 1:
            return self.meta["current"]
        n = max(1, -(-sum(r["file_size_bytes"] for r in plan) // target_bytes))
        return self.rewrite(paths=[r["path"] for r in plan], partitions=n, status="indexing" if deferred else "ready")

    def index_files(self) -> int | None:
        """Compute the geometry of files that were appended deferred (status 'indexing') and mark them ready."""
        meta = self.meta
        todo = [r["path"] for r in self.files().where("index_status = 'indexing'").select("path").collect()]
        return self.rewrite(paths=todo) if todo and meta["vectors"] else meta["current"]

    def migrate(self, embed: Callable[[Column], Column], source: str, spec: VectorColumn, dual: bool = False) -> int | None:
        """Vectors of a new model from column ``source``: in place, or as a further column first (``dual``) which :meth:`cut_over` makes primary."""
        if dual:
            if spec.name not in {f["name"] for f in self._fields(self.meta)}:
                self.add_vector_column(spec)
            return self.backfill(spec.name, embed, source)
        done = self.rewrite(lambda df: df.withColumn(spec.name, embed(F.col(source)).cast("array<float>")))
        self.log.update(lambda m: m | {"vectors": [spec.__dict__, *[v for v in m["vectors"] if v["name"] != spec.name]]})
        return done

    def cut_over(self, name: str) -> None:
        """Make a vector column the primary one."""
        self.log.update(lambda m: m | {"vectors": sorted(m["vectors"], key=lambda v: v["name"] != name)})

    def backfill(self, column: str, compute: Callable[[Column], Column], source: str) -> int | None:
        """Fill a column where it is null, in files that have such rows; doing it twice changes nothing."""
        live = self.scan(with_identity=True)
        todo = [r[FILE] for r in live.where(F.col(column).isNull() & F.col(source).isNotNull()).select(FILE).distinct().collect()]
        if not todo:
            return self.meta["current"]
        kind = self.schema()[column].dataType
        return self.rewrite(lambda df: df.withColumn(column, F.coalesce(F.col(column), compute(F.col(source)).cast(kind))), paths=todo)

    # -- change feed ------------------------------------------------------------------------------------------------

    def read_changes(self, start: int | None = None, end: int | None = None, key: Sequence[str] = ()) -> DataFrame:
        """Net row changes from one snapshot to a later one.

        Columns of the table and _change_type, _snapshot_id, _sequence_number, _commit_timestamp of the end.  Without ``end`` up to the current
        snapshot, without ``start`` from the parent of the end (an error if it has none).  A row inserted and deleted in
        between, and a row that was only rewritten, does not show.  With ``key`` columns, a delete and an insert of one key are an
        update_before and an update_after.  The manifests are compared first: read are the files that only one of them has, and of the others those
        that a new delete can touch.
        """
        meta = self.meta
        last = self._snapshot(end, meta)
        if last is None:
            raise ValueError("the table has no snapshot")
        if start is None and last["parent"] is None:
            raise ValueError("the first snapshot has no parent; name a start")
        first = self._snapshot(last["parent"] if start is None else start, meta)
        a, b = self.files(first["id"], meta), self.files(last["id"], meta)
        names = [f["name"] for f in self._fields(meta)]
        changed = [*names, ROW_ID]
        only = lambda x, y: x.join(y.select("path"), "path", "left_anti")
        old = self.scan(first["id"], with_identity=True, files=only(a, b), meta=meta)
        new = self.scan(last["id"], with_identity=True, files=only(b, a), meta=meta)
        on = [ROW_ID]
        if operation_changes(meta, first, last):
            # rewritten rows keep their id: compare their contents, too
            maps = {f.name for f in old.schema.fields if "map<" in f.dataType.simpleString()}
            values = [F.to_json(F.struct(n)) if n in maps else F.col(n) for n in names]
            digest = F.xxhash64(*values, *[F.col(n).isNull() for n in names])
            old, new = old.withColumn("__h", digest), new.withColumn("__h", digest)
            on.append("__h")
        gone = old.join(new.select(*on), on, "left_anti").select(*changed, F.lit("delete").alias("_change_type"))
        came = new.join(old.select(*on), on, "left_anti").select(*changed, F.lit("insert").alias("_change_type"))
        for hit in self._deleted_between(first, last, a.join(b.select("path"), "path", "left_semi"), meta):
            gone = gone.unionByName(hit.select(*changed, F.lit("delete").alias("_change_type")))
        out = gone.unionByName(came)
        if key:
            out = coalesce_updates(out, list(key))
        stamp = F.timestamp_millis(F.lit(last["timestamp"]))
        return out.drop(ROW_ID).withColumns({"_snapshot_id": F.lit(last["id"]), "_sequence_number": F.lit(last["sequence"]).cast("long"), "_commit_timestamp": stamp})

    def _deleted_between(self, first: dict, last: dict, common: DataFrame, meta: dict) -> list[DataFrame]:
        """Rows of files that both snapshots have, live in the first, which delete sets of the second alone remove.  Of the files only those that such
        a set can touch are read: the ones it names, or, for values, those that are older."""
        fresh_positions = [p for p in last["positions"] if p not in first["positions"]]
        known = {d["path"] for d in first["equality"]}
        fresh_values = [d for d in last["equality"] if d["path"] not in known]
        out, taken = [], None
        if fresh_positions:
            gone = self.spark.read.parquet(*fresh_positions).distinct()
            named = common.join(gone.select(F.col(FILE).alias("path")).distinct(), "path", "left_semi")
            taken = self.scan(first["id"], with_identity=True, files=named, meta=meta).join(gone, [FILE, POSITION], "left_semi")
            out.append(taken)
        if fresh_values:
            latest = max(d["sequence"] for d in fresh_values)
            rows = self.scan(first["id"], with_identity=True, files=common.where(F.col("sequence_number") < latest), meta=meta)
            rows = rows.join(common.select(F.col("path").alias(FILE), F.col("sequence_number").alias("__seq")), FILE)
            if taken is not None:
                rows = rows.join(gone, [FILE, POSITION], "left_anti")
            left = self._without_values(rows, fresh_values, meta)
            out.append(rows.join(left.select(FILE, POSITION), [FILE, POSITION], "left_anti") if len(fresh_values) > 1 else self._without_values(rows, fresh_values, meta, "left_semi"))
        return out

    # -- facts ------------------------------------------------------------------------------------------------------

    def info(self) -> DataFrame:
        """One row: files, indexed, indexing, failed, foreign, rows, bytes, snapshot."""
        count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
        return self.files().agg(
            F.count(F.lit(1)).alias("files"), count(F.col("index_status") == "ready").alias("indexed"), count(F.col("index_status") == "indexing").alias("indexing"),
            count(F.col("index_status") == "failed").alias("failed"), count(F.col("centroid").isNull()).alias("without_geometry"),
            F.coalesce(F.sum("record_count"), F.lit(0)).alias("rows"), F.coalesce(F.sum("file_size_bytes"), F.lit(0)).alias("bytes"),
        ).withColumn("snapshot_id", F.lit(self.meta["current"]).cast("long"))

    def partition_stats(self) -> DataFrame:
        """Rows, files and bytes of each partition value."""
        return self.files().groupBy("partition_value").agg(F.sum("record_count").alias("rows"), F.count(F.lit(1)).alias("files"), F.sum("file_size_bytes").alias("bytes"))

    def column_stats(self, snapshot_id: int | None = None) -> DataFrame:
        """(file, column, values, nulls, least, greatest, bytes) of every data file, from the footers that were read when it was written: no data is read.

        Bounds are text, cut to 16 characters; lists have none.  Rows deleted later still count, as in the file.
        """
        kinds = "map<string, array<string>>"
        names = [(f"f{f['id']}", f["name"]) for f in self._fields(self.meta)]
        rows = self.files(snapshot_id).select(F.col("path").alias(FILE), F.explode(F.from_json("facts", kinds)).alias("id", "f"))
        rows = rows.join(F.broadcast(self.spark.createDataFrame(names, "id string, column string")), "id")
        at = lambda i: F.get("f", F.lit(i))
        return rows.select(FILE, "column", at(0).cast("long").alias("values"), at(1).cast("long").alias("nulls"), at(2).alias("least"), at(3).alias("greatest"), at(4).cast("long").alias("bytes"))


def operation_changes(meta: dict, first: dict, last: dict) -> bool:
    """Whether files were rewritten between two snapshots."""
    return any(s["operation"] == "replace" and first["sequence"] < s["sequence"] <= last["sequence"] for s in meta["snapshots"])


def coalesce_updates(changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Pair the n-th delete and the n-th insert of a key (in order of row id) as an update; keys are compared as columns, null keys never pair."""
    order = Window.partitionBy(*key, "_change_type").orderBy(ROW_ID)
    c = changes.withColumn("__n", F.row_number().over(order))
    pair = Window.partitionBy(*key, "__n")
    whole = F.count(F.lit(1)).over(pair) == 2
    for k in key:
        whole = whole & F.col(k).isNotNull()
    kind = F.when(whole & (F.col("_change_type") == "delete"), "update_before").when(whole & (F.col("_change_type") == "insert"), "update_after").otherwise(F.col("_change_type"))
    return c.withColumn("_change_type", kind).drop("__n")


def _type(value) -> T.DataType:
    """A data type from its JSON value."""
    return T.StructType.fromJson({"type": "struct", "fields": [{"name": "x", "type": value, "nullable": True, "metadata": {}}]})[0].dataType
