"""Versioned tables that survive repeats, broken runs and rivals; files with bad lines."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidara.sources import files, versioned

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType()), T.StructField("part of", T.StringType())])


@pytest.fixture
def table(spark, tmp_path):
    return versioned.VersionedTable(spark, str(tmp_path / "t"), SCHEMA, "part of")


def rows(spark, *some):
    return spark.createDataFrame(list(some), SCHEMA)


def seen(table, version=None):
    return sorted((tuple(r) for r in table.read(version).collect()), key=str)


def test_repeats_do_nothing(spark, table):
    assert seen(table) == [] and table.version() == 0
    table.upsert(rows(spark, (1, "a", "x/y={:"), (2, "b", None), (1, "z", "x/y={:")), ["k"], "one", "v")
    first = seen(table)
    assert first == [(1, "z", "x/y={:"), (2, "b", None)]
    assert table.upsert(rows(spark, (9, "no", "q")), ["k"], "one") == 1 and seen(table) == first
    table.upsert(rows(spark, (2, "c", None), (3, "d", "q")), ["k"], "two")
    assert seen(table) == [(1, "z", "x/y={:"), (2, "c", None), (3, "d", "q")] and seen(table, 1) == first
    table.delete("v = 'd' OR v = 'c'", "three")
    assert seen(table) == [(1, "z", "x/y={:")]
    table.drop_partition("x/y={:", "four")
    assert seen(table) == [] and table.version() == 4


def test_a_broken_run_leaves_the_old_version(spark, table, monkeypatch):
    table.upsert(rows(spark, (1, "a", "p")), ["k"], "one")

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versioned.VersionedTable, "_publish", die)
        with pytest.raises(KeyboardInterrupt):
            table.upsert(rows(spark, (1, "b", "p")), ["k"], "two")
    assert seen(table) == [(1, "a", "p")]
    # a task that fails while parts are written
    broken = rows(spark, (1, "c", "p")).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        table.upsert(broken, ["k"], "two")
    assert seen(table) == [(1, "a", "p")]
    table.upsert(rows(spark, (1, "b", "p")), ["k"], "two")
    assert seen(table) == [(1, "b", "p")]


def test_a_dead_writers_claim_is_taken_away(spark, table, monkeypatch):
    table._fs.create(table._path(f"{table.path}/manifests/{1:010d}.claim"), False).close()
    monkeypatch.setattr(versioned, "STALE", -1.0)
    table.upsert(rows(spark, (1, "a", "p")), ["k"], "one")
    assert seen(table) == [(1, "a", "p")]
    monkeypatch.setattr(versioned, "STALE", 1e9)
    monkeypatch.setattr(versioned, "ATTEMPTS", 2)
    table._fs.create(table._path(f"{table.path}/manifests/{2:010d}.claim"), False).close()
    with pytest.raises(versioned.Conflict):
        table.upsert(rows(spark, (2, "a", "p")), ["k"], "two")


def test_rivals_lose_nothing(spark, table, monkeypatch):
    """Another commit lands between this one's reading and its publishing: it reads again."""
    real, other = versioned.VersionedTable._publish, versioned.VersionedTable(spark, table.path, SCHEMA, "part of")
    state = {"done": False}

    def late(self, version, content):
        if not state["done"]:
            state["done"] = True
            other.upsert(rows(spark, (2, "theirs", "p")), ["k"], "theirs")
        return real(self, version, content)

    monkeypatch.setattr(versioned.VersionedTable, "_publish", late)
    table.upsert(rows(spark, (1, "ours", "p")), ["k"], "ours")
    assert seen(table) == [(1, "ours", "p"), (2, "theirs", "p")]


def test_all_or_nothing(spark, table):
    assert table.save_batch(rows(spark, (1, "a", "p"), (2, "b", "p"), (2, "b", "p")), ["k"], "v", "one") == {"inserted": 2, "unchanged": 0, "conflicted": 0}
    assert table.save_batch(rows(spark, (1, "x", "p"), (3, "c", "p")), ["k"], "v", "two") == {"inserted": 1, "unchanged": 0, "conflicted": 1}
    assert table.save_batch(rows(spark, (4, "x", "p"), (4, "y", "p")), ["k"], "v", "three")["conflicted"] == 1
    assert seen(table) == [(1, "a", "p"), (2, "b", "p")]
    assert table.save_batch(rows(spark, (1, "a", "p"), (3, "c", "p")), ["k"], "v", "four") == {"inserted": 1, "unchanged": 1, "conflicted": 0}
    assert seen(table) == [(1, "a", "p"), (2, "b", "p"), (3, "c", "p")]


def test_batches_of_a_stream(spark, table, tmp_path):
    for i in range(3):
        rows(spark, (i % 2, f"v{i}", "p")).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for checkpoint in ("a", "b"):  # the second run begins anew, as after a lost checkpoint: its batches are known
        stream.writeStream.foreachBatch(table.sink(["k"], "s")).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()
    assert {r[0] for r in seen(table)} == {0, 1} and len(table.manifest()["commits"]) == len(set(table.manifest()["commits"]))


def test_artifacts_are_addressed_by_content(spark, tmp_path):
    t = versioned.VersionedTable(spark, str(tmp_path / "blobs"), versioned.ARTIFACTS, "tenant_id")
    df = spark.createDataFrame([(1, "s", b"x"), (1, "s", b"x"), (2, "s", b"x"), (1, "s", b"y"), (1, "s", None), (None, "s", b"")], "tenant_id long, source_sha256 string, content binary")
    for name in ("one", "two"):
        versioned.put_artifacts(t, df, name)
        assert t.read().count() == 4


@pytest.fixture
def folder(spark, tmp_path):
    d = tmp_path / "files"
    (d / "sub").mkdir(parents=True)
    files_ = {
        "a.csv": b"report\nname;amount\nx;1\n\"y;z\";2\nw;3;4\n;\nv\n", "b.tsv": "﻿name\tamount\nx\t1".encode(), "sub/c.csv": "name,amount\né,1\n".encode("utf-16"), "d.csv": b"\xff\xfe\x00", "e.csv": b"", "f.csv": b"1,2\n3,4\n",
        "g.pdf": b"%PDF-1.7 ... %%EOF\n", "h.pdf": b"hello", "i.html": b"<!-- x --> <!DOCTYPE html><p>", "j.html": b"plain", "k.exe": b"MZ", "l.xlsx": b"PK\x03\x04...xl/workbook.xml", "m.docx": b"PK\x03\x04...xl/workbook.xml", "n.csv": b"name,amount\n\"open,1\n",
        "o.json": b'{"records": [{"id": "1", "n": 2}, {"id": "1"}, {"id": ""}, {"id": "2", "x": 1}, 5, {"id": "3", "n": "many"}]}', "p.jsonl": b'{"id": "7"}\n\nnot json\n{"id": "8", "n": 1}\n', "q.json": b"{", "r.json": b'{"id": 1}',
    }
    for name, data in files_.items():
        (d / name).write_bytes(data)
    return files.load_files(spark, str(d))


def named(rows):
    return sorted((r.path.rsplit("/", 1)[-1], *tuple(r)[1:]) for r in rows)


def test_payloads_and_delimited_rows(folder):
    good, bad = files.delimited_rows(folder)
    assert named(good.select("path", "line", "row_text").collect()) == [("a.csv", 3, "name: x | amount: 1"), ("a.csv", 4, "name: y;z | amount: 2"), ("a.csv", 7, "name: v"), ("b.tsv", 2, "name: x | amount: 1"), ("c.csv", 2, "name: é | amount: 1")]
    got = {(p, n): why for p, n, why in ((r.path.rsplit("/", 1)[-1], r.line, r.why) for r in bad.collect())}
    assert got[("a.csv", 5)] == "3 cells under 2 headers" and got[("f.csv", 1)] == "no header" and ("n.csv", 2) in got
    assert {k[0]: v for k, v in got.items() if k[1] is None} == {"d.csv": "not text", "h.pdf": "not a PDF", "j.html": "not HTML", "k.exe": "unknown suffix", "m.docx": "not a DOCX"}


def test_json_records(folder):
    good, bad = files.json_records(folder, {"id": "string", "n": "int"}, ["id"], "id")
    assert named(good.collect()) == [("o.json", 1, "1", 2), ("p.jsonl", 1, "7", None), ("p.jsonl", 4, "8", 1)]
    got = {(r.path.rsplit("/", 1)[-1], r.line): r.why for r in bad.where("line IS NOT NULL").collect()}
    assert got[("o.json", 2)] == "repeated id" and got[("o.json", 3)] == "missing: id" and got[("o.json", 4)] == "unknown: x" and got[("o.json", 5)] == "no object" and got[("o.json", 6)] == "other type: n"
    assert got[("p.jsonl", 3)].startswith("no JSON") and got[("q.json", 1)].startswith("no JSON") and got[("r.json", 1)] == "no list of records"
