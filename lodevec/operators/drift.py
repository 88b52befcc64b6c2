"""Schemas that drift between files: differences, one union schema, one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodevec.session import cut_lineage

# Spellings of the types.
TYPE_NAMES = {
    "int": "int", "integer": "int", "int32": "int",
    "long": "long", "bigint": "long", "int64": "long",
    "float": "float", "float32": "float", "real": "float",
    "double": "double", "float64": "double",
    "string": "string", "utf8": "string", "varchar": "string", "text": "string", "large_utf8": "string",
    "boolean": "boolean", "bool": "boolean",
    "timestamp": "timestamp", "datetime": "timestamp", "timestamptz": "timestamp",
    "list<float>": "list<float>", "list<float32>": "list<float>", "array<float>": "list<float>", "array<float32>": "list<float>",
}

# The lattice: what a type may be widened to, nearest first.  string is the top.
WIDER = {
    "int": ["int", "long", "double", "string"],
    "long": ["long", "double", "string"],
    "float": ["float", "double", "string"],
    "double": ["double", "string"],
    "boolean": ["boolean", "string"],
    "timestamp": ["timestamp", "string"],
    "list<float>": ["list<float>", "string"],
    "string": ["string"],
}
SQL_TYPE = {"int": "int", "long": "bigint", "float": "float", "double": "double", "boolean": "boolean", "timestamp": "timestamp", "string": "string", "list<float>": "array<float>"}

FIELDS = "struct<fields:array<struct<id:int,name:string,type:string>>>"
BUCKET = 4096


def join_types(a: str, b: str) -> str:
    """Least type that holds both."""
    return next(t for t in WIDER[a] if t in WIDER[b])


def fold_types(types) -> str:
    """Least type that holds all of ``types``; unknown ones are strings."""
    out = None
    for t in types:
        t = t if t in WIDER else "string"
        out = t if out is None else join_types(out, t)
    return out or "string"


def folded_type(types: str) -> Column:
    """:func:`fold_types` over an array column: the first type, narrower ones before wider, that every one of them may be widened to."""
    known = F.transform(types, lambda t: F.when(t.isin(*WIDER), t).otherwise(F.lit("string")))
    out = None
    for t in sorted(WIDER, key=lambda t: sum(t in w for w in WIDER.values())):
        narrower = [a for a, wider in WIDER.items() if t in wider]
        fits = F.size(F.array_except(known, F.array(*[F.lit(a) for a in narrower]))) == 0
        out = F.when(fits, F.lit(t)) if out is None else out.when(fits, F.lit(t))
    return F.when(F.size(types) == 0, F.lit("string")).otherwise(out)


def type_name(col: Column) -> Column:
    """The meaning of a type's spelling; an unknown one keeps its lower-case text."""
    text = F.regexp_replace(F.lower(F.trim(col)), r"\s+", "")
    text = F.when(text.rlike(r'^\{.*"(list|array)".*"float(32)?".*\}$'), F.lit("list<float>")).otherwise(text)
    names = F.create_map(*[F.lit(x) for kv in TYPE_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, text), text)


def file_fields(files: DataFrame) -> DataFrame:
    """One row for each file: table_key, path, sequence_number and its ``fields``.

    ``fields`` is an array of (id, name, type) with lower-case names and one spelling for each
    type; files without a readable schema have an empty array.  Repeated listings count once.
    """
    parsed = F.from_json("schema_json", FIELDS)["fields"]
    fields = F.transform(
        F.filter(F.coalesce(parsed, F.array().cast("array<struct<id:int,name:string,type:string>>")), lambda f: f["name"].isNotNull()),
        lambda f: F.struct(f["id"].alias("id"), F.lower(F.trim(f["name"])).alias("name"), type_name(f["type"]).alias("type")),
    )
    return (
        files.select("table_key", "path", "sequence_number", fields.alias("fields"))
        .groupBy("table_key", "path", "sequence_number")
        .agg(F.first("fields").alias("fields"))
    )


def with_previous(files: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Add ``before``: the fields of the file before it in its table (null for the first).

    Windows run within ranges of sequence numbers, so that a table with a third of all files
    is no single group; the first file of a range gets the last one of the range
    before from a summary of one row a range.
    """
    files = files.withColumn("__b", F.floor(F.col("sequence_number") / bucket))
    order = [F.col("sequence_number"), F.col("path")]
    inside = Window.partitionBy("table_key", "__b").orderBy(*order)
    files = files.withColumn("__rn", F.row_number().over(inside)).withColumn("__prev", F.lag("fields").over(inside))
    ends = files.groupBy("table_key", "__b").agg(
        F.max_by("fields", F.struct("sequence_number", "path")).alias("__last")
    )
    ends = ends.withColumn("__edge", F.lag("__last").over(Window.partitionBy("table_key").orderBy("__b"))).drop("__last")
    out = files.join(ends, ["table_key", "__b"], "left")
    before = F.when(F.col("__rn") == 1, F.col("__edge")).otherwise(F.col("__prev"))
    return out.withColumn("before", before).drop("__b", "__rn", "__prev", "__edge")


def schema_changes(files: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """Differences of each file from the one before it in its table.

    Result: table_key, path, sequence_number, change_kind, field_name, old_type, new_type.
    If every field of both files has an id, fields are matched by id, else by name.
    The first file of a table has no differences.  ``parsed`` are the files' fields, if they are at hand.
    """
    pairs = with_previous(file_fields(files) if parsed is None else parsed).where(F.col("before").isNotNull())
    cur, old = F.col("fields"), F.col("before")
    # over an array column, the flag is computed once for each row
    pairs = pairs.withColumn("__by_id", F.forall(cur, lambda f: f["id"].isNotNull()) & F.forall(old, lambda f: f["id"].isNotNull()))
    by_id = F.col("__by_id")

    def match(a, b):
        return F.when(by_id, a["id"] == b["id"]).otherwise(a["name"] == b["name"])

    def entry(kind, f, was, now):
        return F.struct(F.lit(kind).alias("change_kind"), f["name"].alias("field_name"), was.alias("old_type"), now.alias("new_type"))

    none = F.lit(None).cast("string")
    added = F.transform(F.filter(cur, lambda c: ~F.exists(old, lambda p: match(p, c))), lambda c: entry("added", c, none, c["type"]))
    removed = F.transform(F.filter(old, lambda p: ~F.exists(cur, lambda c: match(p, c))), lambda p: entry("removed", p, p["type"], none))
    renamed = F.transform(
        F.filter(cur, lambda c: by_id & F.exists(old, lambda p: (p["id"] == c["id"]) & (p["name"] != c["name"]))),
        lambda c: entry("renamed", c, none, c["type"]),
    )
    typed = F.transform(
        F.filter(cur, lambda c: F.exists(old, lambda p: match(p, c) & (p["type"] != c["type"]))),
        lambda c: entry("type_changed", c, F.get(F.filter(old, lambda p: match(p, c)), 0)["type"], c["type"]),
    )
    rows = pairs.select("table_key", "path", "sequence_number", F.explode(F.concat(added, removed, renamed, typed)).alias("c"))
    return rows.select("table_key", "path", "sequence_number", "c.*").distinct()


def guessed_renames(files: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """(table_key, name, was): names that took another's place where a file without ids had exactly one field more and one
    less than the file before, of the same type.  Reports never use the guess, only the table that brings all files together."""
    c = schema_changes(files, parsed).where(F.col("change_kind").isin("added", "removed"))
    one = c.groupBy("table_key", "path", "sequence_number").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("change_kind") == "added", F.struct(F.col("field_name").alias("f"), F.col("new_type").alias("t")))).alias("a"),
        F.max(F.when(F.col("change_kind") == "removed", F.struct(F.col("field_name").alias("f"), F.col("old_type").alias("t")))).alias("r"),
    )
    one = one.where((F.col("n") == 2) & (F.col("a.t") == F.col("r.t")))
    return one.groupBy("table_key", F.col("a.f").alias("name")).agg(F.min_by("r.f", "sequence_number").alias("was"))


def rename_chains(guess: DataFrame) -> DataFrame:
    """(table_key, name, chain): the names a name has replaced, one after the other, latest first; a chain ends before a name comes again.

    The guesses of one table are at most as many as its names.
    """
    all_of = guess.groupBy(F.col("table_key").alias("__t")).agg(F.map_from_entries(F.collect_list(F.struct("name", "was"))).alias("__was"))

    def step(chain: Column, _: Column) -> Column:
        was = F.try_element_at(F.col("__was"), F.element_at(chain, -1))
        return F.when(was.isNull() | F.array_contains(chain, was), chain).otherwise(F.concat(chain, F.array(was)))

    chain = F.aggregate(F.sequence(F.lit(1), F.size("__was")), F.array("name"), step)
    out = guess.join(all_of, F.col("table_key").eqNullSafe(F.col("__t"))).withColumn("__n", chain)
    return out.select("table_key", "name", F.slice("__n", 2, F.size("__n")).alias("chain"))


def field_lineage(files: DataFrame, vectors: DataFrame | None = None, vector_name: str = "embedding") -> DataFrame:
    """For each file and field: ``canonical`` name, the first one its lineage had.

    A lineage is a field id within a table.  A file that lists no ids lends them: from the id that last took the name by
    then (else from the first one that took it later), else from the name it seems to have replaced, or that one before,
    however many times, see :func:`rename_chains`; else the name itself is the lineage.  ``vectors`` (table_key, path, vector_column) tells each
    file's vector field, which is called ``vector_name``; in a file without such an entry it is the field of that lineage or name.

    Different fields of a file are of different lineages: where two claim one, an id goes before a lent one and that before a
    guess, and the other field is a lineage by itself.  Lineages of a table have different canonical names: of those
    with one first name the vector, then the oldest, keeps it, the others are called ``name#2``, ``name#3`` and so on.
    """
    parsed = cut_lineage(file_fields(files))  # read by every step
    each = parsed.select("table_key", "path", "sequence_number", F.explode("fields").alias("f"))
    each = each.select("table_key", "path", "sequence_number", F.col("f.id").alias("id"), F.col("f.name").alias("name"), F.col("f.type").alias("type"))
    with_id = each.where(F.col("id").isNotNull())
    known = with_id.groupBy("table_key", "name", "id").agg(F.min("sequence_number").alias("since"))
    known = known.groupBy("table_key", "name").agg(F.array_sort(F.collect_list(F.struct("since", "id"))).alias("owners"))
    first = with_id.groupBy(F.col("table_key"), F.col("id").alias("lineage")).agg(F.min_by("name", F.struct("sequence_number", "name")).alias("first_name"))
    chains = rename_chains(guessed_renames(files, parsed))
    older = chains.select("table_key", "name", F.posexplode("chain").alias("at", "was")).join(known.select("table_key", F.col("name").alias("was"), F.col("owners").alias("older")), ["table_key", "was"], "left")
    guess = older.groupBy("table_key", "name").agg(F.min_by("older", F.when(F.col("older").isNotNull(), F.col("at"))).alias("older_owners"), F.max_by("was", "at").alias("oldest"))

    def owner(column: str) -> Column:
        by_then = F.filter(column, lambda o: o["since"] <= F.col("sequence_number"))
        return F.coalesce(F.try_element_at(by_then, F.lit(-1)), F.get(column, 0))["id"]

    each = each.join(known, ["table_key", "name"], "left").join(guess, ["table_key", "name"], "left")
    each = each.withColumn("lineage", F.coalesce("id", owner("owners"), owner("older_owners"))).join(first, ["table_key", "lineage"], "left")
    base = F.coalesce("first_name", F.when(F.col("id").isNull() & F.col("owners").isNull(), F.col("oldest")), "name")
    own = F.col("id").isNotNull() | F.col("owners").isNotNull() | (base == F.col("name"))
    each = each.select(
        "table_key", "path", "sequence_number", "name", "type", base.alias("base"),
        F.coalesce(F.concat(F.lit("id "), F.col("lineage").cast("string")), F.concat(F.lit("name "), base)).alias("lineage"),
        F.when(F.col("id").isNotNull(), 0).when(own, 1).otherwise(2).alias("claim"),
    )
    file = ["table_key", "path", "sequence_number"]
    if vectors is not None:
        v = vectors.select("table_key", "path", F.lower(F.trim("vector_column")).alias("__v")).where("__v is not null").groupBy("table_key", "path").agg(F.max("__v").alias("__v"))
        each = each.join(v, ["table_key", "path"], "left").withColumn("named", F.coalesce(F.col("name") == F.col("__v"), F.lit(False)))
        known_vectors = each.where("named").select("table_key", "lineage", F.lit(True).alias("known_vector")).distinct()
        each = each.join(known_vectors, ["table_key", "lineage"], "left").withColumn("has", F.max("named").over(Window.partitionBy(*file)))
        other = ~F.col("has") & (F.coalesce("known_vector", F.lit(False)) | (F.col("name") == vector_name))
        is_vector = F.col("named") | other
        # by lineage before by name alone
        each = each.withColumn("claim", F.when(other, F.when(F.col("known_vector"), 0).otherwise(3)).otherwise(F.col("claim")))
        each = each.withColumn("held", F.row_number().over(Window.partitionBy(*file, is_vector).orderBy("claim", "name")) == 1)
        is_vector = is_vector & F.col("held")
        each = each.withColumn("lineage", F.when(is_vector, F.lit("vector")).otherwise(F.col("lineage"))).withColumn("base", F.when(is_vector, F.lit(vector_name)).otherwise(F.col("base")))
    claims = Window.partitionBy(*file, "lineage").orderBy("claim", F.col("name") != F.col("base"), "name")
    each = each.withColumn("lost", F.row_number().over(claims) > 1)
    each = each.withColumn("lineage", F.when(F.col("lost"), F.concat(F.lit("field "), F.col("name"))).otherwise(F.col("lineage"))).withColumn("base", F.when(F.col("lost"), F.col("name")).otherwise(F.col("base")))
    lineages = each.groupBy("table_key", "base", "lineage").agg(F.min("sequence_number").alias("since"))
    at = F.row_number().over(Window.partitionBy("table_key", "base").orderBy(F.col("lineage") != "vector", "since", "lineage"))
    lineages = lineages.withColumn("at", at)
    # a name that looks like one with a number always gets a number, so that no two can be the same
    plain = (F.col("at") == 1) & ~F.col("base").rlike(r"#\d+$")
    lineages = lineages.select(F.col("table_key").alias("__t"), F.col("base").alias("__b"), F.col("lineage").alias("__l"), F.when(plain, F.col("base")).otherwise(F.concat_ws("#", "base", F.col("at").cast("string"))).alias("canonical"))
    same = F.col("table_key").eqNullSafe(F.col("__t")) & (F.col("base") == F.col("__b")) & (F.col("lineage") == F.col("__l"))
    return each.join(lineages, same).select("table_key", "path", "sequence_number", "name", "type", "canonical")


def union_schema(files: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """One row for each field of the union: canonical name, its type by the lattice, use counts.

    The set of types of a name is tiny, so the fold runs on a set that was built on the map side.
    """
    return _union(field_lineage(files, vectors))


def _union(fields: DataFrame) -> DataFrame:
    grouped = fields.groupBy(F.col("canonical").alias("field_name")).agg(
        F.collect_set("type").alias("types"), F.collect_set("name").alias("names"), F.count(F.lit(1)).alias("n_files")
    )
    return grouped.select("field_name", folded_type("types").alias("field_type"), F.array_join(F.array_sort("names"), ",").alias("spellings"), "n_files")


def read_drifting(files: DataFrame, records: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """All records in one table with the union's fields, cast to the union's types.

    ``table_key, path, row_no`` stay; then one column for each field of the union (a name that
    clashes with the fixed ones gets the suffix ``_field``), then ``_damaged``, the raw record where it is no
    JSON object, and ``_rest``, the name and text of every value that has no column (JSON; null if there is none).  Values that cannot be cast are null; repeated records come once; records of
    files without a schema keep their names.  The field names (not the records) are collected:
    their number is bounded by the design of the feeds, and checked.
    """
    lineage = cut_lineage(field_lineage(files, vectors))  # read twice
    fields = _union(lineage).select("field_name", "field_type").orderBy("field_name").limit(10_001).collect()
    if len(fields) > 10_000:
        raise ValueError("more than 10,000 different fields: this is no drifting table")
    # a name of a file has one canonical name; the map of a file is as small as the file's schema
    names = lineage.groupBy("table_key", "path", "name").agg(F.min("canonical").alias("canonical"))
    names = names.groupBy("table_key", "path").agg(F.map_from_entries(F.collect_list(F.struct("name", "canonical"))).alias("__names"))
    rows = records.select("table_key", "path", "row_no", "record").distinct().join(names, ["table_key", "path"], "left")
    parsed = F.from_json("record", "map<string,string>")
    entries = F.transform(
        F.filter(F.map_entries(parsed), lambda e: e["value"].isNotNull()),
        lambda e: F.struct(F.coalesce(F.try_element_at("__names", F.lower(e["key"])), F.lower(e["key"])).alias("key"), e["value"].alias("value"), e["key"].alias("name")),
    )
    rows = rows.withColumn("__entries", entries).withColumn("__keys", F.transform("__entries", lambda e: e["key"]))
    listed = F.array(*[F.lit(name) for name, _ in fields]).cast("array<string>")
    first = lambda e, i: F.array_contains(listed, e["key"]) & (F.array_position("__keys", e["key"]) == i + 1)
    held = F.transform(F.filter("__entries", first), lambda e: F.struct(e["key"], e["value"]))
    rows = rows.withColumn("__values", F.map_from_entries(held))
    kept = {"table_key", "path", "row_no", "_damaged", "_rest"}
    columns = []
    for name, kind in fields:
        raw = F.try_element_at("__values", F.lit(name))
        value = F.from_json(raw, "array<float>") if kind == "list<float>" else raw.try_cast(SQL_TYPE[kind])
        columns.append(value.alias(f"{name}_field" if name in kept else name))
    damaged = F.when(F.col("__entries").isNull(), F.col("record")).alias("_damaged")
    rest = F.filter("__entries", lambda e, i: ~first(e, i))
    rest = F.transform(rest, lambda e: F.struct(e["name"].alias("name"), e["value"].alias("value")))
    rest = F.when(F.size(rest) > 0, F.to_json(rest)).alias("_rest")
    return rows.select("table_key", "path", "row_no", *columns, damaged, rest)
