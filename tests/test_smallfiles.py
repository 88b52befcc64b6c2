import json
import os
import zlib

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodevec.operators import smallfiles as sf

INDEX = "table_key string, path string, record_count long, file_size_bytes long, partition_value string, active boolean"


@pytest.mark.parametrize(
    "spelled",
    [
        "data/docs/topic_id=3/a.parquet", "./data/docs/topic_id=3/a.parquet", "data//docs/topic_id%3D3//a.parquet", "/warehouse/data/docs/topic_id=3/a.parquet",
        "file:///warehouse/data/docs/topic_id%3d3/a.parquet", "s3://example-lake/warehouse/data/docs/topic_id=3/a.parquet", "data/docs/./topic_id=3/a.parquet",
    ],
)
def test_plain_path(spark, spelled):
    df = spark.createDataFrame([(spelled,)], "p string")
    assert df.select(sf.plain_path(F.col("p"))).first()[0] == "data/docs/topic_id=3/a.parquet"


def test_plain_path_odd(spark):
    rows = [(None, None), ("data/a+b/50%/x", "data/a+b/50%/x"), ("", "")]
    got = spark.createDataFrame(rows, "p string, w string").select(sf.plain_path(F.col("p")), "w").collect()
    assert all(a == b for a, b in got)


def _index(spark, sizes, group=("t", None)):
    return spark.createDataFrame([(group[0], f"data/x/{i:05d}", 1, s, group[1], True) for i, s in enumerate(sizes)], INDEX)


def test_every_file_once_and_offsets_add_up(spark):
    sizes = [(i * 7919) % 900 + 1 for i in range(3000)]
    plan = sf.checked_plan(sf.plan_merge(_index(spark, sizes), small=10_000, target=20_000, split=512)).collect()
    assert len(plan) == 3000 == len({r["path"] for r in plan})
    by = {}
    with pytest.raises(ValueError):
        sf.plan_merge(_index(spark, sizes), small=10_000, target=19_999)
    for r in plan:
        by.setdefault(r["target_no"], []).append(r)
    for rows in by.values():
        assert len(rows) > 1
        at = 0
        for r in sorted(rows, key=lambda r: r["target_offset"]):
            assert r["target_offset"] == at
            at += r["file_size_bytes"]
        assert at <= 20_000 + 2 * 900 and {(r["target_files"], r["target_bytes"], r["target_rows"]) for r in rows} == {(len(rows), at, len(rows))}
    assert sum(r["file_size_bytes"] for r in plan) == sum(sizes)


def test_unsound_targets_are_an_error(spark):
    plan = sf.plan_merge(_index(spark, [5, 7, 9]), small=10, target=20)
    assert sf.checked_plan(plan).count() == 3
    for wrong in (plan.where("target_offset > 0"), plan.withColumn("target_offset", F.col("target_offset") + F.col("target_offset") % 2)):
        with pytest.raises(Exception, match="end to end"):
            sf.checked_plan(wrong).collect()


def test_left_out(spark):
    rows = [
        ("t", "data/x/1", 1, 5, "p", True), ("t", "./data/x/1", 1, 5, "p", True), ("t", "data/x/2", 1, 5, "p", False), ("t", "data/x/3", 1, 0, "p", True),
        ("t", "data/x/4", 1, -1, "p", True), ("t", "data/x/5", 1, 1 << 30, "p", True), ("t", "data/x/6", None, 9, None, True), ("t", "data/x/7", 2, 9, None, True),
        ("t", None, 2, 9, None, True), ("u", "data/y/1", 2, None, None, True), ("u", "data/y/2", 2, 3, None, None),
    ]
    plan = sf.plan_merge(sf.listed_files(spark.createDataFrame(rows, INDEX)))
    assert {r["path"] for r in plan.collect()} == {"data/x/6", "data/x/7"}
    assert sf.plan_merge(spark.createDataFrame([], INDEX)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.dictionaries(st.text(max_size=5), st.integers(), max_size=2), max_size=4), min_size=1, max_size=5), st.booleans())
def test_text_round_trip(tmp_path_factory, files, last):
    d = tmp_path_factory.mktemp("j")
    paths = []
    for i, records in enumerate(files):
        body = "\n".join(json.dumps(r) for r in records)
        body += "\n" if last and records else ""
        (d / f"{i}.jsonl").write_text(body)
        paths.append(str(d / f"{i}.jsonl"))
    got = sf.join_files(paths, str(d / "out.jsonl"))
    data = (d / "out.jsonl").read_bytes()
    assert [json.loads(x) for x in data.splitlines()] == [r for f in files for r in f]
    assert got["bytes"] == len(data) and got["crc32"] == zlib.crc32(data)


def test_zstandard_frames(tmp_path):
    parts = [b"one\n" * 1000, b"", b"two\n", os.urandom(200_000)]
    paths = []
    for i, p in enumerate(parts):
        c = zstandard.ZstdCompressor(write_checksum=bool(i % 2), write_content_size=i != 2)
        body = c.compress(p)
        if i == 2:
            body = b"\x50\x2a\x4d\x18\x03\x00\x00\x00abc" + body
        (tmp_path / f"{i}.zst").write_bytes(body)
        paths.append(str(tmp_path / f"{i}.zst"))
    sf.join_files(paths, str(tmp_path / "out.zst"))
    def expand(name):
        with open(tmp_path / name, "rb") as f:
            return zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()

    end = b"" if parts[3].endswith(b"\n") else b"\n"
    assert expand("out.zst") == b"".join(parts) + end
    (tmp_path / "a.zst").write_bytes(zstandard.compress(b"no end") + zstandard.compress(b""))
    sf.join_files([str(tmp_path / "a.zst"), paths[0], str(tmp_path / "a.zst")], str(tmp_path / "two.zst"))
    assert expand("two.zst") == b"no end\n" + parts[0] + b"no end\n"
    with pytest.raises(ValueError):
        sf.join_files(paths, str(tmp_path / "h.zst"), header=True)
    whole = (tmp_path / "3.zst").read_bytes()
    for bad in (whole[:-5], whole + b"x", b"no frame"):
        (tmp_path / "bad.zst").write_bytes(bad)
        with pytest.raises(ValueError):
            sf.join_files([paths[0], str(tmp_path / "bad.zst")], str(tmp_path / "never.zst"))
        assert not (tmp_path / "never.zst").exists() and not list(tmp_path.glob("*.part"))


def test_headers(tmp_path):
    for i, body in enumerate(["a,b\n1,2\n", "a,b\r\n3,4", "a,b\n"]):
        (tmp_path / f"{i}.csv").write_bytes(body.encode())
    paths = [str(tmp_path / f"{i}.csv") for i in range(3)]
    sf.join_files(paths, str(tmp_path / "o.csv"), header=True)
    assert (tmp_path / "o.csv").read_bytes() == b"a,b\n1,2\n3,4\n"
    (tmp_path / "3.csv").write_bytes(b"a,c\n")
    with pytest.raises(ValueError):
        sf.join_files([*paths, str(tmp_path / "3.csv")], str(tmp_path / "o2.csv"), header=True)


def test_listed_bytes_and_lines_must_be_there(tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b"1\n2\n")
    (tmp_path / "b.jsonl").write_bytes(b"3")
    a, b, out = str(tmp_path / "a.jsonl"), "file://" + str(tmp_path / "b.jsonl"), str(tmp_path / "o.jsonl")
    for sizes, rows in (([4, 2], None), ([4, 1], [2, 2]), ([3, 1], [2, 1])):
        with pytest.raises(ValueError):
            sf.join_files([a, b], out, sizes=sizes, rows=rows)
        assert not os.path.exists(out) and not list(tmp_path.glob("*.part"))
    assert sf.join_files([a, b], out, sizes=[4, None], rows=[2, 1])["lines"] == 3 and open(out, "rb").read() == b"1\n2\n3\n"


def test_merge_on_the_cluster(spark, tmp_path):
    rows = []
    for i in range(40):
        body = "".join(json.dumps({"f": i, "n": n}) + "\n" for n in range(i % 5 + 1))
        p = f"data/x/{i:03d}.jsonl"
        (tmp_path / "data/x").mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(body)
        rows.append(("t", p, i % 5 + 1, len(body), str(i % 2), True))
    plan = sf.plan_merge(spark.createDataFrame(rows, INDEX), small=150, target=300)
    done = sf.merge_files(plan, str(tmp_path), str(tmp_path / "out")).collect()
    assert sum(r["sources"] for r in done) == 40
    got = spark.read.json([r["path"] for r in done])
    assert got.count() == sum(r[2] for r in rows) == got.distinct().count()


def test_merge_of_the_given_records(spark, data):
    from lodevec.plans.problems import p4_merge

    for r in p4_merge(spark, data).collect():
        assert r["lines_before"] == r["lines_after"] > 0 and r["bytes_before"] == r["bytes_after"] > 0
        assert r["files_after"] < r["files_before"]
