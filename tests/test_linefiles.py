"""Lines keep their numbers however files are cut, and a growing file's lines arrive once."""

import io
import random

import pytest
from pyspark.sql import functions as F

from tracemill.sources import linefiles, logs


def cut_everywhere(raw, block, last=True):
    out = []
    for begin in range(0, len(raw), block):
        end = min(begin + block, len(raw))
        got = list(linefiles.lines_of(io.BytesIO(raw), begin, end, last and end == len(raw)))
        if last:
            assert linefiles.count_of(io.BytesIO(raw), begin, end, end == len(raw)) == len(got)
        out += got
    return out


def test_every_cut_gives_every_line_once(monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(linefiles, "CHUNK", 5)
    monkeypatch.setattr(linefiles, "BACK", 3)
    for _ in range(300):
        raw = b"".join(rng.choice([b"a", b"bc", b"\n", b"\r\n", "é".encode()]) for _ in range(rng.randint(0, 40)))
        whole = raw.split(b"\n")
        if not whole[-1]:
            whole.pop()
        want = [line[:-1] if line.endswith(b"\r") and raw[sum(len(x) + 1 for x in whole[:k]) + len(line) :][:1] == b"\n" else line for k, line in enumerate(whole)]
        for block in (1, 2, 3, 7, 100):
            got = cut_everywhere(raw, block)
            assert [v for _, v in got] == want
            assert [a for a, _ in got] == [sum(len(x) + 1 for x in whole[:k]) for k in range(len(whole))]


@pytest.fixture
def folder(tmp_path):
    for name, n in (("a/one.jsonl", 3000), ("a b/two é.jsonl", 10), ("three.jsonl", 0), ("b/no.txt", 5)):
        path = tmp_path / "logs" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("".join(f'{{"n": {k}, "pad": "{"x" * (k % 90)}"}}\n' for k in range(n)))
    return tmp_path / "logs"


def numbered(df):
    rows = df.select(F.element_at(F.split("file", "/"), -1).alias("file"), "line_no", F.get_json_object("value", "$.n").cast("long").alias("n")).collect()
    assert all(r["line_no"] == r["n"] for r in rows)
    return sorted((r["file"], r["n"]) for r in rows)


def test_settings_changed_between_call_and_action_lose_nothing(spark, folder):
    settings = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.maxPartitionBytes")
    lines = logs.read_jsonl_lines(spark, str(folder), block=1000)
    want = numbered(lines)
    assert len(want) == 3010
    for parallel, size in (("1", "128m"), ("64", "1k"), ("3", "10k")):
        for name, value in zip(settings, (parallel, size), strict=True):
            spark.conf.set(name, value)
        try:
            assert numbered(lines) == want
            assert numbered(logs.read_jsonl_lines(spark, str(folder), block=int(parallel) * 777)) == want
        finally:
            for name in settings:
                spark.conf.unset(name)


def test_lines_appended_after_the_call_are_not_read(spark, folder):
    lines = logs.read_jsonl_lines(spark, str(folder), block=1000)
    with (folder / "a/one.jsonl").open("a") as f:
        f.write('{"n": 3000}\n')
    assert len(numbered(lines)) == 3010
    assert len(numbered(logs.read_jsonl_lines(spark, str(folder)))) == 3011


def test_a_store_that_only_spark_reaches(spark, folder, monkeypatch):
    want = numbered(logs.read_jsonl_lines(spark, str(folder)))
    monkeypatch.setattr(logs, "reachable", lambda path: False)
    lines = logs.read_jsonl_lines(spark, str(folder))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert numbered(lines) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_some_files_and_none(spark, folder, tmp_path):
    lines = logs.read_jsonl_lines(spark, str(folder), limit_files=1)
    assert {f for f, _ in numbered(lines)} == {"two%20é.jsonl"}  # names are URIs
    only = linefiles.tail_lines(spark, str(folder), streaming=False).where("value like '%\"n\": 2999,%'")
    assert len(numbered(logs.read_jsonl_lines(spark, str(folder), only=only))) == 3000
    (tmp_path / "empty").mkdir()
    assert logs.read_jsonl_lines(spark, str(tmp_path / "empty")).count() == 0


def test_a_growing_file_arrives_once(spark, folder, tmp_path):
    def drain():
        stream = linefiles.tail_lines(spark, str(folder), block=5000)
        run = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        run.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    assert drain().count() == 3010
    grown = folder / "a/one.jsonl"
    with grown.open("a") as f:
        f.write('{"n": 3000}\n{"n": 30')  # the second line is not complete
    (folder / "new.jsonl").write_text('{"n": 0}\n')
    assert drain().count() == 3012
    assert drain().count() == 3012
    with grown.open("a") as f:
        f.write("01}\n")
    rows = drain().where("file like '%one.jsonl'")
    assert rows.count() == 3002 and rows.select("at").distinct().count() == 3002
    assert rows.where("value = '{\"n\": 3001}'").count() == 1


def test_many_small_files_share_tasks(spark, tmp_path):
    rows = spark.range(6000).selectExpr("CAST(id % 300 AS STRING) AS file", "id DIV 300 AS line_no", "CAST(id AS STRING) AS value")
    linefiles.write_logs(rows, str(tmp_path), "CAST(file AS INT) % 3")
    assert len(list(tmp_path.glob("*/*.txt"))) == 300 and (tmp_path / "1" / "7.txt").read_text().split() == [str(7 + 300 * k) for k in range(20)]
    lines = logs.read_jsonl_lines(spark, str(tmp_path), pattern="*.txt")
    assert lines.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    got = {(r["file"].rsplit("/", 1)[1], r["line_no"], r["value"]) for r in lines.collect()}
    assert got == {(f"{i % 300}.txt", i // 300, str(i)) for i in range(6000)}
    assert logs.read_tasks(90_000, 2 << 30, 32 << 20, 48) == 64 and logs.read_tasks(3, 3, 1, 48) == 3 and logs.read_tasks(0, 0, 1, 48) == 1


def test_a_stream_of_names_reads_no_text(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("1\n2\n")
    (tmp_path / "b.jsonl").write_text("unfinished")
    got = linefiles.tail_lines(spark, str(tmp_path), streaming=False, names=True).collect()
    assert [(r["file"].rsplit("/", 1)[1], r["at"], r["value"]) for r in got] == [("a.jsonl", 0, None)]


def test_small_blocks_make_no_more_tasks_than_bytes_ask_for():
    for size in (10**6, 10**8, 10**9, 10**11):
        dealt = linefiles._dealt([("a", 5, size), ("b", 0, size), ("c", 0, 0)], 10_000)
        assert len(dealt) <= max(linefiles.TASKS + 2, 2 * size // linefiles.BLOCK * 1.01 + 2)
        for name in "ab":
            parts = [r[1:] for d in dealt for r in d.ranges if r[0] == name]
            assert parts[0][0] == (5 if name == "a" else 0) and parts[-1][1] == size and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
