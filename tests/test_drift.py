import itertools
import json

from lodevec.operators import drift


def schema(fields, ids=True):
    return json.dumps({"type": "struct", "fields": [({"id": i} if ids else {}) | {"name": n, "type": t} for i, n, t in fields]})


FILES = "table_key string, path string, sequence_number long, written_at timestamp, schema_json string"


def files(spark, *rows):
    return spark.createDataFrame([(t, p, s, None, j) for t, p, s, j in rows], FILES)


def test_changes(spark):
    a = [(1, "id", "int"), (2, "TEXT", "utf8"), (3, "old", "double")]
    b = [(2, "body", "string"), (1, "Id", "BIGINT"), (4, "lang", "string")]
    f = files(
        spark, ("t", "p1", 10, schema(a)), ("t", "p1", 10, schema(a)), ("t", "p2", 20, schema(b)), ("t", "p3", 5000, schema([(0, "body", "varchar"), (0, "n", "list<float32>")], False)),
        ("t", "p4", 5001, schema(b)), ("u", "q", 1, schema(a)), ("u", "q2", 2, None), ("u", "q3", 3, "{broken"),
    )
    got = {tuple(r) for r in drift.schema_changes(f).select("table_key", "path", "change_kind", "field_name").collect()}
    assert got == {
        ("t", "p2", "type_changed", "id"), ("t", "p2", "renamed", "body"), ("t", "p2", "added", "lang"), ("t", "p2", "removed", "old"),
        ("t", "p3", "removed", "id"), ("t", "p3", "removed", "lang"), ("t", "p3", "added", "n"),
        ("t", "p4", "added", "id"), ("t", "p4", "added", "lang"), ("t", "p4", "removed", "n"),
        ("u", "q2", "removed", "id"), ("u", "q2", "removed", "text"), ("u", "q2", "removed", "old"),
    }


def test_renamed_and_retyped(spark):
    f = files(spark, ("t", "a", 1, schema([(1, "x", "int")])), ("t", "b", 2, schema([(1, "y", "long")])))
    assert sorted(r["change_kind"] for r in drift.schema_changes(f).collect()) == ["renamed", "type_changed"]


def test_lattice():
    for a, b in itertools.product(drift.WIDER, repeat=2):
        j = drift.join_types(a, b)
        assert j == drift.join_types(b, a) and j in drift.WIDER[a] and j in drift.WIDER[b]
    for a, b, c in itertools.product(drift.WIDER, repeat=3):
        assert drift.join_types(drift.join_types(a, b), c) == drift.join_types(a, drift.join_types(b, c))
    assert drift.fold_types(["int", "long"]) == "long" and drift.fold_types(["long", "float"]) == "double"
    assert drift.fold_types([]) == "string" and drift.fold_types(["int", "strange"]) == "string"


def test_union_folds_as_the_lattice(spark):
    kinds = list(drift.WIDER)
    for combo in itertools.combinations(kinds, 2):
        f = files(spark, *[("t", f"p{i}", i, schema([(1, "x", k)])) for i, k in enumerate(combo)])
        if combo[0] in ("int", "boolean") or "float" in combo:
            assert drift.union_schema(f).first()["field_type"] == drift.fold_types(combo), combo


def test_one_table(spark):
    f = files(
        spark, ("t", "p1", 1, schema([(1, "id", "int"), (2, "text", "string"), (3, "row_no", "int")])), ("t", "p2", 2, schema([(1, "id", "long"), (2, "body", "string")])),
        ("t", "p3", 3, schema([(0, "body", "string"), (0, "vec", "list<float>")], False)),
    )
    records = spark.createDataFrame(
        [
            ("t", "p1", 0, '{"id": 1, "text": "a", "row_no": 7}'), ("t", "p1", 0, '{"id": 1, "text": "a", "row_no": 7}'), ("t", "p2", 0, '{"BODY": "b", "id": 3000000000}'),
            ("t", "p3", 0, '{"body": "c", "vec": [0.5, 1]}'), ("t", "p3", 1, '{"body": "d'), ("t", "p3", 2, None), ("t", "p9", 0, '{"id": "no number"}'), ("t", "p3", 3, "{}"),
        ],
        "table_key string, path string, row_no int, record string",
    )
    got = {(r["path"], r["row_no"]): r for r in drift.read_drifting(f, records).collect()}
    assert len(got) == 7
    assert got["p1", 0]["text"] == "a" and got["p1", 0]["row_no_field"] == 7
    assert got["p2", 0]["text"] == "b" and got["p2", 0]["id"] == 3_000_000_000
    assert got["p3", 0]["text"] == "c" and got["p3", 0]["vec"] == [0.5, 1.0]
    assert got["p3", 1]["_damaged"] == '{"body": "d' and got["p3", 1]["text"] is None
    assert got["p9", 0]["id"] is None and got["p3", 3]["_damaged"] is None
    empty = spark.createDataFrame([], records.schema)
    assert drift.read_drifting(f, empty).count() == 0
    assert drift.schema_changes(spark.createDataFrame([], FILES)).count() == 0


def test_ranges_of_sequence_numbers(spark):
    rows = [("t", f"p{i}", i * 37, schema([(1, "x", "int"), (i + 2, f"f{i}", "int")])) for i in range(300)]
    wide = {tuple(r) for r in drift.schema_changes(files(spark, *rows)).collect()}
    parts = drift.with_previous(drift.file_fields(files(spark, *rows)), bucket=100)
    assert parts.where("before is null").count() == 1
    assert len(wide) == 2 * 299


def test_vector_fields_and_guessed_renames(spark):
    f = files(
        spark, ("t", "p1", 1, schema([(1, "id", "int"), (2, "text", "string"), (3, "emb", "list<float>")])), ("t", "p2", 2, schema([(0, "id", "int"), (0, "body", "string"), (0, "emb", "list<float>")], False)),
        ("t", "p3", 3, schema([(0, "id", "int"), (0, "passage", "string"), (0, "vec", "list<float>")], False)), ("u", "q1", 1, schema([(1, "a", "int")])),
        ("u", "q2", 2, schema([(0, "b", "int"), (0, "c", "int")], False)),
    )
    vectors = spark.createDataFrame([("t", "p1", "EMB"), ("t", "p2", "emb"), ("t", "p3", "vec"), ("t", "p3", "vec"), ("x", "none", None)], "table_key string, path string, vector_column string")
    got = {(r["path"], r["name"]): r["canonical"] for r in drift.field_lineage(f, vectors).collect()}
    assert got["p1", "emb"] == got["p2", "emb"] == got["p3", "vec"] == "embedding"
    assert got["p2", "body"] == "text" and got["p3", "passage"] == "passage"  # two fields changed at once: no guess
    assert got["q2", "b"] == "b" and got["q2", "c"] == "c"


def test_a_name_that_is_used_again(spark):
    f = files(
        spark, ("t", "p1", 1, schema([(4, "agent_id", "string"), (5, "n", "int")])), ("t", "p2", 2, schema([(0, "agent_id", "string"), (0, "n", "int")], False)),
        ("t", "p3", 3, schema([(4, "agent_key", "string"), (9, "agent_id", "int"), (5, "n", "int")])), ("t", "p4", 4, schema([(0, "agent_key", "string"), (0, "agent_id", "int")], False)),
        ("u", "q1", 1, schema([(9, "agent_id", "string"), (2, "agent_id#2", "string")])),
    )
    records = spark.createDataFrame(
        [
            ("t", "p1", 0, '{"agent_id": "a"}'), ("t", "p2", 0, '{"agent_id": "b"}'), ("t", "p3", 0, '{"agent_key": "c", "agent_id": 7, "n": 1}'), ("t", "p3", 1, '{"agent_id": 8, "agent_key": null, "more": [1]}'),
            ("t", "p4", 0, '{"agent_id": 9, "agent_key": "d"}'), ("u", "q1", 0, '{"agent_id": "e", "agent_id#2": "f"}'), ("u", "q1", 1, '{"AGENT_ID": "g", "agent_id": "h"}'), ("u", "q1", 2, "{"),
        ],
        "table_key string, path string, row_no int, record string",
    )
    got = {(r["path"], r["row_no"]): r for r in drift.read_drifting(f, records).collect()}
    assert [got[p, 0]["agent_id"] for p in ("p1", "p2", "p3", "p4", "q1")] == ["a", "b", "c", "d", "e"]
    assert [got[p, i]["agent_id#2"] for p, i in (("p1", 0), ("p2", 0), ("p3", 0), ("p3", 1), ("p4", 0), ("q1", 0))] == [None, None, 7, 8, 9, None]
    assert got["q1", 0]["agent_id#2#1"] == "f" and got["p3", 1]["agent_id"] is None
    assert json.loads(got["p3", 1]["_rest"]) == [{"name": "more", "value": "[1]"}]
    assert got["q1", 1]["agent_id"] == "g" and json.loads(got["q1", 1]["_rest"]) == [{"name": "agent_id", "value": "h"}]
    assert all(r["_rest"] is None for k, r in got.items() if k not in (("p3", 1), ("q1", 1))) and got["q1", 2]["_damaged"] == "{"


def test_fields_of_a_file_have_different_columns(spark):
    f = files(
        spark, ("t", "p1", 1, schema([(1, "id", "int"), (2, "text", "string"), (3, "vec", "list<float>")])), ("t", "p2", 2, schema([(0, "id", "int"), (0, "body", "string"), (0, "vec", "list<float>")], False)),
        ("t", "p3", 3, schema([(0, "text", "string"), (0, "body", "string")], False)), ("t", "p4", 4, schema([(3, "vec", "list<float>"), (6, "embedding", "string")])),
    )
    vectors = spark.createDataFrame([("t", "p1", "vec"), ("t", "p4", "vec")], "table_key string, path string, vector_column string")
    got = {(r["path"], r["name"]): r["canonical"] for r in drift.field_lineage(f, vectors).collect()}
    assert got["p1", "vec"] == got["p2", "vec"] == got["p4", "vec"] == "embedding" and got["p4", "embedding"] == "embedding#2"
    assert got["p2", "body"] == got["p3", "text"] == "text" and got["p3", "body"] == "body"


def test_rename_chains_of_any_length(spark):
    pairs = [("t", "b", "a"), ("t", "c", "b"), ("t", "d", "c"), ("t", "e", "d"), ("t", "y", "x"), ("t", "x", "y"), ("u", "b", "q")]
    got = drift.rename_chains(spark.createDataFrame(pairs, "table_key string, name string, was string"))
    chains = {(r["table_key"], r["name"]): r["chain"] for r in got.collect()}
    assert chains["t", "e"] == ["d", "c", "b", "a"] and chains["t", "b"] == ["a"] and chains["u", "b"] == ["q"]
    assert chains["t", "x"] == ["y"] and chains["t", "y"] == ["x"]


def test_three_renames_without_ids_are_one_field(spark):
    files, records = [], []
    for i, name in enumerate(["text", "body", "content", "passage"]):
        files.append(("t", f"f{i}", i, json.dumps({"fields": [{"name": "id", "type": "long"}, {"name": name, "type": "string"}]})))
        records.append(("t", f"f{i}", 0, json.dumps({"id": i, name: f"v{i}"})))
    files = spark.createDataFrame(files, "table_key string, path string, sequence_number long, schema_json string")
    out = drift.read_drifting(files, spark.createDataFrame(records, "table_key string, path string, row_no int, record string"))
    assert out.columns == ["table_key", "path", "row_no", "id", "text", "_damaged", "_rest"]
    assert sorted((r["id"], r["text"], r["_rest"]) for r in out.collect()) == [(i, f"v{i}", None) for i in range(4)]
