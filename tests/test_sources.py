import json
import time

import pytest
from pyspark.sql import functions as F

from quillmark.sources import connectors, files
from quillmark.streaming import files as stream


def test_folder_and_metrics(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "b.txt").write_bytes(b"x")
    got = {r.name: (r.mime, r.ignored) for r in files.folder(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": ("application/pdf", None), "b.txt": ("application/octet-stream", "file type not allowed")}
    m = spark.createDataFrame([("o\"k", 3)], "state string, n long")
    assert files.metrics_text(m, "docs", ["state"], "n").first().line == 'docs{state="o\\"k"} 3'


def test_media_types(spark):
    rows = [(b"%PDF-1.4", "application/pdf"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff\xe0", "image/jpeg"), (b"II*\0", "image/tiff"), (b"MM\0*", "image/tiff"), (b"RIFF0000WEBPVP8", "image/webp"), (b"", "application/octet-stream")]
    from quillmark.functions.text import mime_of

    df = spark.createDataFrame([(bytearray(b), m) for b, m in rows], "c binary, m string")
    assert all(r.x == r.m for r in df.select(mime_of(F.col("c")).alias("x"), "m").collect())


def test_json_sources(spark, tmp_path):
    (tmp_path / "key.jsonl").write_text("\n".join(json.dumps({"id": i, "expected": {"name": f"n{i}"}}) for i in range(3)))
    got = files.jsonl(spark, str(tmp_path / "key.jsonl"), "id int, expected struct<name:string>").collect()
    assert sorted((r.id, r.expected.name) for r in got) == [(0, "n0"), (1, "n1"), (2, "n2")]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "d1.json").write_text('{\n "status": "ok"\n}')
    (tmp_path / "docs" / "d2.json").write_text('{"status": "held"}')
    assert {(r.stem, r.status) for r in files.json_by_stem(spark, str(tmp_path / "docs"), "status string").collect()} == {("d1", "ok"), ("d2", "held")}


def test_catalogues(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes("﻿code,name\n 1 , TSH \n2,LFT\n".encode())
    assert [tuple(r) for r in files.catalogue(spark, str(tmp_path / "c.csv"), "code string, name string").collect()] == [("1", "TSH"), ("2", "LFT")]
    (tmp_path / "w.txt").write_text("# words\nTelma\n\n telma \nPan\n")
    assert {r.word for r in files.word_list(spark, str(tmp_path / "w.txt")).collect()} == {"telma", "pan"}
    (tmp_path / "set.tsv").write_text("num\tlong\tshort\n3016-3\tThyrotropin\tT.S.H\n11580-8\tTSH 3rd\ttsh\n\tx\ty\n")
    assert {r.name: r.codes for r in files.code_set(spark, str(tmp_path / "set.tsv"), "num", ["long", "short"]).collect()} == {"thyrotropin": ["3016-3"], "t s h": ["3016-3"], "tsh 3rd": ["11580-8"], "tsh": ["11580-8"]}


def test_line_crops_and_sidecars(spark, tmp_path):
    (tmp_path / "crops").mkdir()
    (tmp_path / "crops" / "l1.png").write_bytes(b"\x89PNG")
    (tmp_path / "m.jsonl").write_text('{"file": "x/l1.png", "truth": "Telma"}\n{"file": "x/l2.png", "truth": "Pan"}')
    assert [(r.name, r.truth) for r in files.line_crops(spark, str(tmp_path / "m.jsonl"), str(tmp_path / "crops")).collect()] == [("l1.png", "Telma")]
    side = spark.createDataFrame([("l1", 5)], "stem string, pages int")
    assert [(r.stem, r.pages) for r in files.with_sidecars(files.folder(spark, str(tmp_path / "crops")), side).collect()] == [("l1", 5)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "d int, x string")
    files.write_children(rows, str(tmp_path / "t"), "d")
    files.write_children(spark.createDataFrame([(2, "c")], "d int, x string"), str(tmp_path / "t"), "d")
    assert {(r.d, r.x) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, "a"), (2, "c")}
    files.write_ndjson(rows.coalesce(1), str(tmp_path / "n"))
    assert [r.value for r in spark.read.text(str(tmp_path / "n")).collect()] == ['{"d":1,"x":"a"}', '{"d":2,"x":"b"}']
    rows.createOrReplaceTempView("sinks_view")
    assert [(r.column_name, r.type) for r in files.catalogue_tables(spark).where("table_name = 'sinks_view'").collect()] == [("d", "int"), ("x", "string")]


def test_registry_and_connectors(spark, tmp_path):
    assert connectors.CONNECTORS.resolve("local") is connectors.LocalConnector
    assert connectors.CONNECTORS.resolve("quillmark.sources.connectors:LocalConnector") is connectors.LocalConnector
    with pytest.raises(KeyError):
        connectors.CONNECTORS.resolve("none")
    with pytest.raises(ValueError):
        connectors.OUTPUTS.register("ndjson")(None)
    (tmp_path / "inbox").mkdir()
    (tmp_path / "inbox" / "a.pdf").write_bytes(b"12345")
    conn = connectors.LocalConnector(str(tmp_path))
    (f,) = conn.list("inbox")
    assert (f.name, f.size) == ("a.pdf", 5) and conn.download(f) == b"12345"
    spark.dataSource.register(connectors.Inbox)
    assert [(r.folder, r.name, r["size"]) for r in spark.read.format("inbox").option("root", str(tmp_path)).load().collect()] == [("inbox", "a.pdf", 5)]
    moved = conn.move(f, "completed")
    conn.write_note("log", "a.log", "why")
    assert conn.list("inbox") == [] and conn.download(moved) == b"12345" and (tmp_path / "log" / "a.log").read_text() == "why"
    with pytest.raises(ValueError):
        conn.list("../..")


def test_stability_stream_equals_batch(spark, tmp_path):
    rows = [("f", "e1", 1), ("f", "e1", 2), ("f", "e2", 3), ("f", "e2", 4), ("f", "e2", 5), ("g", "x", 1)]
    df = spark.createDataFrame(rows, "file_id string, etag string, poll long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    want = {tuple(r) for r in stream.stable_files_batch(df).collect()}
    assert want == {("f", "e1", 2), ("f", "e2", 4)}
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream.stable_files(src).writeStream.format("memory").queryName("stable").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("stable").collect()} == want


def test_batches_and_retries(spark):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([("l", i, t.replace(minute=i)) for i in (0, 1, 2, 3, 30)] + [("m", 9, t)], "lane string, event_id int, ts timestamp")
    assert [(r.lane, r.batch_no) for r in sorted(stream.batches_of(df, 3, 600).collect(), key=lambda r: (r.lane, r.event_id))] == [("l", 0), ("l", 0), ("l", 0), ("l", 1), ("l", 2), ("m", 0)]
    s = spark.createDataFrame([(0, True, False), (2, True, False), (0, True, True), (0, False, False)], "a int, f boolean, d boolean")
    assert [r.x for r in s.select(stream.retry_state(F.col("a"), F.col("f"), F.col("d")).alias("x")).collect()] == ["error", "quarantine", "quarantine", "done"]


def test_batch_stream(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.createDataFrame([("l", i) for i in range(7)], "lane string, file_no long").coalesce(1).write.parquet(str(tmp_path / "in"))
    try:
        src = spark.readStream.schema("lane string, file_no long").parquet(str(tmp_path / "in"))
        q = stream.batch_stream(src, 3, 3600).writeStream.format("memory").queryName("batched").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
        end = time.time() + 60
        while time.time() < end and spark.table("batched").count() < 6:
            time.sleep(0.5)
        q.stop()
        assert sorted(r.file_no for r in spark.table("batched").collect()) == [0, 1, 2, 3, 4, 5]  # the seventh waits
    finally:
        spark.conf.set(key, before)


def test_watch_and_outbox(spark, tmp_path):
    (tmp_path / "inbox").mkdir()
    (tmp_path / "inbox" / "a.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "inbox" / ".x.pdf.part").write_bytes(b"")
    q = stream.watched(spark, str(tmp_path / "inbox")).drop("modificationTime").writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.name, r.mime, r.ignored) for r in spark.table("watched").collect()] == [("a.pdf", "application/pdf", None)]
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "document_id long, seq long, body string").coalesce(1).write.parquet(str(tmp_path / "out"))
    src = spark.readStream.schema("document_id long, seq long, body string").parquet(str(tmp_path / "out"))
    stream.outbox(src, lambda b: b.withColumn("ok", F.lit(True)), str(tmp_path / "sent"), str(tmp_path / "c2")).awaitTermination(120)
    assert sorted((r.document_id, r.body, r.ok) for r in spark.read.parquet(str(tmp_path / "sent")).collect()) == [(1, "b", True), (2, "c", True)]


def test_chain_goes_on_where_it_stopped(spark, tmp_path):
    from quillmark.operators.queues import run_chain

    ran = []

    def stage(name, f):
        return name, lambda s, rows: (ran.append(name), f(s, rows))[1]

    first, second = stage("one", lambda s, _: s.range(5)), stage("two", lambda s, rows: rows.where("id > 2"))
    broken = stage("two", lambda s, rows: rows.where("no_such_column > 2"))
    with pytest.raises(Exception, match="no_such_column"):
        run_chain(spark, str(tmp_path), [first, broken])
    assert run_chain(spark, str(tmp_path), [first, second]).count() == 2 and ran == ["one", "two", "two"]
    assert connectors.READERS.resolve("stub")(b"x") == connectors.READERS.resolve("stub")(b"x") != connectors.READERS.resolve("stub")(b"y")
