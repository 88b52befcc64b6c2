import json
import threading
import urllib.error
import urllib.request

import pyarrow as pa
import pytest

from lodevec import api, cli, sql


def test_commands(spark, tmp_path, capsys):
    w = str(tmp_path / "w")

    def run(*args):
        assert cli.main(["--warehouse", w, *args], spark) == 0
        return capsys.readouterr().out.strip()

    run("create", "docs", "--schema", "id long, text string, embedding array<float>", "--dim", "2")
    rows = tmp_path / "rows.jsonl"
    rows.write_text("\n".join(json.dumps({"id": i, "text": f"rust number {i}", "embedding": [i, 1]}) for i in range(6)))
    first = run("insert", "docs", str(rows), "--batch-id", "b1")
    assert run("insert", "docs", str(rows), "--batch-id", "b1") == first
    assert [json.loads(x)["id"] for x in run("search", "docs", "--query", "[0, 1]", "--k", "2", "--format", "json").splitlines()] == [0, 1]
    assert len(run("search", "docs", "--text", "rust", "--k", "3").splitlines()) == 4
    run("delete-where", "docs", "--column", "id", "--values", "1", "2")
    change = [json.loads(x) for x in run("read-changes", "docs", "--format", "json").splitlines()]
    assert {(c["id"], c["_change_type"]) for c in change} == {(1, "delete"), (2, "delete")}
    run("read-changes", "docs", "--format", "arrow", "--out", str(tmp_path / "c.arrow"))
    with pa.OSFile(str(tmp_path / "c.arrow")) as f:
        assert pa.ipc.open_stream(f).read_all().num_rows == 2
    run("read-changes", "docs", "--format", "parquet", "--out", str(tmp_path / "c.parquet"))
    assert spark.read.parquet(str(tmp_path / "c.parquet")).count() == 2
    run("evolve", "docs", "--rename", "text=body", "--add", "lang:string=en", "n:int")
    run("add-vector-column", "docs", "--column", "second", "--dim", "1")
    embed = """python3 -c "import json,sys; print(json.dumps([[float(len(t))] for t in json.load(sys.stdin)]))\""""
    run("backfill-vector-column", "docs", "--column", "second", "--source", "body", "--embed-cmd", embed)
    t = api.open_table(spark, w, "docs")
    assert {r["second"][0] for r in t.scan().collect()} == {13.0} and {r["lang"] for r in t.scan().collect()} == {"en"}
    run("migrate", "docs", "--column", "second", "--source", "lang", "--embed-cmd", embed, "--dim", "1", "--model", "len@v2")
    assert {r["second"][0] for r in t.scan().collect()} == {2.0}
    file = t.files().first()["path"].rsplit("/", 1)[1]
    run("delete-rows", "docs", "--file", file, "--positions", "0")
    run("compact", "docs", "--min-files", "1")
    assert json.loads(run("info", "docs", "--format", "json"))["rows"] == 3 == t.scan().count()
    assert len(run("estimate", "--rows", "1M", "--dim", "64").splitlines()) == 6
    with pytest.raises(SystemExit):
        cli.main(["--warehouse", w, "search", "docs"], spark)


def test_server(spark, tmp_path):
    api.create_table(spark, str(tmp_path), "docs", "id long, text string, embedding array<float>", [cli.VectorColumn("embedding", 2)])
    s = cli.server(spark, str(tmp_path))
    threading.Thread(target=s.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{s.server_address[1]}"

    def call(path, body=None):
        data = None if body is None else json.dumps(body).encode()
        with urllib.request.urlopen(urllib.request.Request(url + path, data)) as r:
            return json.loads(r.read())

    assert call("/write", {"table": "docs", "rows": [{"id": 1, "text": "a", "embedding": [1, 0]}, {"id": 2, "text": "b", "embedding": [0, 1]}]})["snapshot_id"]
    assert [r["id"] for r in call("/search", {"table": "docs", "query": [1, 0.1], "top_k": 1})] == [1]
    assert call("/info?table=docs")["rows"] == 2
    for path, body in (("/search", {"table": "none", "query": [1]}), ("/search", {"table": "docs", "query": [1]}), ("/nowhere", {})):
        with pytest.raises(urllib.error.HTTPError):
            call(path, body)
    s.shutdown()


def test_sql(spark, tmp_path):
    sql.register(spark)
    r = spark.sql("select vector_cosine(array(1d, 0d), array(0d, 2d)) a, vector_cosine(array(0d), array(1d)) b, vector_euclidean(array(0d, 0d), array(3d, 4d)) c, recency_weight(-1d, 0.1d) d").first()
    assert tuple(r) == (1.0, 1.0, 5.0, 1.0)
    assert spark.sql("select count(*) from storage_estimate('1K', 8)").first()[0] == 6
    t = api.create_table(spark, str(tmp_path), "space.docs", "id long, x double")
    t.append(spark.createDataFrame([(1, 2.0), (2, 4.0)], "id long, x double"))
    sql.delete_where(spark, t.root, "id", [1])
    sql.expose(spark, str(tmp_path), "space.docs")
    assert spark.sql("select sum(x) from docs").first()[0] == 4.0
