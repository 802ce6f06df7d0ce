import hashlib
import io
import struct
import tarfile

import pytest
from pyspark.sql import functions as F

from tarmill.sources import readers, sinks
from tarmill.streaming import windows


def test_readers(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("a b\n\n  c\t\n")
    assert sorted(r["id"] for r in readers.id_list(spark, str(tmp_path / "ids.txt")).collect()) == ["a", "b", "c"]
    assert readers.split_file("x", "dial.test.v1") == "x/dial.test.txt"
    (tmp_path / "l.jsonl").write_text('{"id":"a","text":"x"}\n{"id":"b","dial":"d","std":"s","alignment":[["d","s","pron","O"]]}\n{"id":"a","text":"y"}\n')
    got = {r["id"]: r for r in readers.layer(spark, str(tmp_path / "l.jsonl")).collect()}
    assert (got["a"]["dial"], got["a"]["std"], got["b"]["std"], got["b"]["alignment"][0]["tag"]) == ("y", "y", "s", "pron")
    (tmp_path / "d.txt").write_text("p/q|a|b\nnone\n")
    assert [tuple(r) for r in readers.first_delimiter(spark, str(tmp_path / "d.txt")).collect()] == [("p/q", "a|b"), ("none", "")]
    (tmp_path / "t.tsv").write_text('a\tb\n"x\t1\n')
    assert readers.tsv(spark, str(tmp_path / "t.tsv")).first()["a"] == '"x'
    (tmp_path / "p.json.p00").write_text('{"id":"a"}\n')
    (tmp_path / "p.json.p01").write_text('{"id":"b"}\n')
    assert readers.parts_or_whole(spark, str(tmp_path / "p.json"), "id string").count() == 2
    assert readers.parts_or_whole(spark, str(tmp_path / "nothing"), "id string") is None
    e = readers.enumerated(spark.createDataFrame([("b",), ("a",)], "t string"), ["t"], "x-")
    assert {r["t"]: r["id"] for r in e.collect()} == {"a": "x-0000", "b": "x-0001"}


def test_last_line_of_the_last_file(spark, tmp_path):
    """However files are packed into tasks: the largest is taken first, and a file may have several splits."""
    line = '{{"id":"{}","t":"{}","pad":"{}"}}\n'
    for name, n in (("a", 1), ("b", 400), ("c", 3), ("d", 40)):
        (tmp_path / f"{name}.jsonl").write_text("".join(line.format(k, f"{name}{j}", "x" * 50) for j in range(n) for k in ("p", "q")))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = readers.jsonl(spark, str(tmp_path / "*.jsonl"), "id string, t string", "id").collect()
        rows = readers.corpus(spark, str(tmp_path / "*.jsonl"), "id string, t string").orderBy("place").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["id"]: r["t"] for r in got} == {"p": "d39", "q": "d39"}
    assert [r["t"] for r in rows] == [f"{f}{j}" for f, n in (("a", 1), ("b", 400), ("c", 3), ("d", 40)) for j in range(n) for _ in "pq"]


def test_tar_and_probe(spark, tmp_path):
    wav = b"RIFF" + struct.pack("<I", 36 + 16000) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", 16000) + bytes(16000)
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        for name, b in (("c1.wav", wav), ("c2.wav", b"nothing")):
            i = tarfile.TarInfo(f"clips/{name}")
            i.size = len(b)
            t.addfile(i, io.BytesIO(b))
    m = readers.probed(readers.tar_members(spark, str(tmp_path / "a.tar")), "content")
    assert {r["name"]: r["duration"] for r in m.collect()} == {"c1.wav": 1.0, "c2.wav": None}


def test_served_falls_back(spark):
    def ask(row):
        if row["id"] == "b":
            raise OSError
        return {"answer": row["id"] * 2}

    got = readers.served(spark.createDataFrame([("a",), ("b",)], "id string"), "id", ask, "id string, answer string", tries=2, wait=0)
    assert {r["id"]: r["answer"] for r in got.collect()} == {"a": "aa", "b": None}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", None), ("b", 1), (None, 2)], "id string, n int")
    digest = sinks.sorted_ids(df, str(tmp_path / "ids.txt"))
    assert (tmp_path / "ids.txt").read_bytes() == b"a\nb\n" and digest == hashlib.sha256(b"a\nb\n").hexdigest()
    sinks.manifest([str(tmp_path / "ids.txt")], str(tmp_path / "MANIFEST.sha256"))
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "ids.txt").write_bytes(b"a\nb\n")
    assert readers.verify(spark, str(tmp_path / "MANIFEST*"), str(tmp_path / "f")).count() == 0
    (tmp_path / "f" / "ids.txt").write_bytes(b"a\n")
    assert readers.verify(spark, str(tmp_path / "MANIFEST*"), str(tmp_path / "f")).first()["status"] == "changed"
    df.write.parquet(str(tmp_path / "t"))
    sinks.append_checked(spark.createDataFrame([("z",)], "id string"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5
    with pytest.raises(ValueError, match="unknown columns"):
        sinks.append_checked(spark.createDataFrame([(1,)], "other int"), str(tmp_path / "t"))
    sinks.resume(spark.createDataFrame([("a",), ("b",)], "id string"), str(tmp_path / "r"))
    sinks.resume(spark.createDataFrame([("b",), ("c",)], "id string"), str(tmp_path / "r"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "r")).collect()) == ["a", "b", "c"]
    assert sinks.report(df.agg(F.count("*").alias("n")), str(tmp_path / "r.json")) == {"n": 4}


def test_stream_equals_batch(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = windows.sink(windows.counts(s, "ts", "event_type"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert q.awaitTermination(120)
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["start"], r["event_type"]): r["n"] for r in windows.counts(e, "ts", "event_type").collect()}
    assert got and all(want[k] == n for k, n in got.items())
