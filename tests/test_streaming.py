"""Streams give what the bounded forms give; sources round-trip."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.functions.transitions import BreakerRule
from tessera.operators import folds
from tessera.sources import files, tlv
from tessera.streaming import processors, pubsub


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    t = datetime(2024, 1, 1)
    rows = [(f"k{i % 3}", t + timedelta(milliseconds=150 * i), i, i % 4 != 0) for i in range(90)]
    path = str(tmp_path_factory.mktemp("events"))
    df = spark.createDataFrame(rows, "key string, ts timestamp, id bigint, ok boolean")
    for part in range(3):  # one file after another: a stream reads them in order of their times
        df.filter(f"id DIV 30 = {part}").coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path), spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(stream, tmp_path):
    out = str(tmp_path / "out")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(out)


def test_token_bucket(events, tmp_path):
    batch, stream = events
    want = {r.id: r.allowed for r in folds.token_bucket(batch, "key", "ts", "id", 2.0, 2).collect()}
    got = {r.id: r.allowed for r in drained(processors.token_bucket(stream, "key", "ts", "id", 2.0, 2), tmp_path).collect()}
    assert got == want and set(want.values()) == {True, False}


def test_circuit_breaker(events, tmp_path):
    batch, stream = events
    rule = BreakerRule(timeout=1.0, should_trip=lambda c: c.failures >= 2)
    want = {r.id: r.verdict for r in folds.circuit_breaker(batch, "key", "ts", "id", F.col("ok"), rule).collect()}
    got = {r.id: r.verdict for r in drained(processors.circuit_breaker(stream, "key", "ts", "id", "ok", rule), tmp_path).collect()}
    assert got == want and "open" in want.values()


def test_batches(events, tmp_path):
    batch, stream = events
    want = {r.id: r.batch for r in folds.batches(batch, "key", "ts", "id", 4, 1.0).collect()}
    assert {r.id: r.batch for r in drained(processors.batches(stream, "key", "ts", "id", 4, 1.0), tmp_path).collect()} == want


def test_latest_n(events, tmp_path):
    batch, stream = events
    got = drained(processors.latest_n(stream, "key", "ts", "id", "id", 2), tmp_path).collect()
    last = {f"k{i % 3}": [str(i - 3), str(i)] for i in range(87, 90)}
    assert all(last[k] in [r["values"] for r in got if r.key == k] for k in last)


def test_pubsub(spark, tmp_path):
    project = pubsub.Project(spark, "p", str(tmp_path))
    topic = project.new_topic("t")
    with pytest.raises(ValueError):
        project.new_topic("t")
    topic.publish(spark.createDataFrame([("x",), ("y",)], "data string"))
    got = {}
    for name in ("a", "b"):
        topic.subscribe(name, lambda df, n, name=name: got.setdefault(name, []).extend((r.data, r.worker) for r in df.collect()), workers=2, once=True).awaitTermination()
    assert {k: sorted(d for d, _ in v) for k, v in got.items()} == {"a": ["x", "y"], "b": ["x", "y"]}
    assert all(w in (0, 1) for v in got.values() for _, w in v)
    topic.stop()
    with pytest.raises(RuntimeError):
        topic.publish(spark.createDataFrame([("z",)], "data string"))


def test_topics_keep_bytes_and_tell_errors(spark, tmp_path):
    project = pubsub.Project(spark, "p", str(tmp_path))
    with pytest.raises(ValueError):
        project.new_topic("none", "int")
    topic, raw = project.new_topic("t", "binary"), bytes(range(256))
    topic.publish(spark.createDataFrame([(bytearray(raw),)], "data binary"))
    got = []
    topic.subscribe("a", lambda df, n: got.extend(bytes(r.data) for r in df.collect()), once=True).awaitTermination()
    assert got == [raw] and topic.errors() == {}

    def fail(df, n):
        raise RuntimeError("not received")

    with pytest.raises(Exception, match="not received"):
        topic.subscribe("b", fail, once=True).awaitTermination()
    assert list(topic.errors()) == ["b"]


def test_tlv_overwrites_through_a_scheme(spark, tmp_path):
    spark.dataSource.register(tlv.TlvSource)
    path = f"file://{tmp_path}/records"
    for text in ("first", "second"):
        spark.createDataFrame([(1, bytearray(text.encode()))], tlv.SCHEMA).write.format("tlv").mode("overwrite").save(path)
    assert [bytes(r.payload) for r in spark.read.format("tlv").load(path).collect()] == [b"second"]


def test_tlv(spark, tmp_path):
    rows = spark.createDataFrame([(8, bytearray(b"hola, tlv!")), (300, bytearray(b""))], "type bigint, payload binary")
    spark.dataSource.register(tlv.TlvSource)
    path = str(tmp_path / "records")
    rows.coalesce(1).write.format("tlv").mode("append").save(path)
    want = {(8, b"hola, tlv!"), (300 % 256, b"")}
    for got in (spark.read.format("tlv").load(path), tlv.read_tlv(spark, path)):
        assert {(r.type, bytes(r.payload)) for r in got.collect()} == want
    assert list(tlv.decode_records(tlv.encode_record(1, b"abc")[:-1])) == []


def test_files(spark, tmp_path):
    for name in ("ghi", "abc", "xyz.wal", "def"):
        (tmp_path / name).write_text("x")
    path = str(tmp_path)
    assert [r.name for r in files.read_dir(spark, path).collect()] == ["abc", "def", "ghi", "xyz.wal"]
    assert [r.name for r in files.read_dir(spark, path, ".wal").collect()] == ["xyz.wal"]
    assert files.files_of(spark, path, ".wal").count() == 1
    assert files.is_dir_writeable(spark, path) and files.exist(spark, path) and not files.exist(spark, f"{path}/none")
    files.create_dir_all(spark, f"{path}/new/dir")
    with pytest.raises(FileExistsError):
        files.create_dir_all(spark, path)
