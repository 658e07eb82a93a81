"""Readers, writers and the streaming plans."""

import datetime as dt
import gzip
import json

from pyspark.sql import functions as F

from frameloom.operators import dataset
from frameloom.sources import tables
from frameloom.streaming import deltas


def test_articles(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        for i in range(3):
            f.write(json.dumps({"text": "日本語text", "meta": {"id": str(i), "title": "t", "url": "u"}}) + "\n\n")
    wanted = spark.createDataFrame([("1",)], "id string")
    assert [(r.id, r.text) for r in tables.read_articles(spark, str(tmp_path), wanted, 3).collect()] == [("1", "日本語")]


def test_broken_lines_and_arrays(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": \n')
    assert sorted((r.a or 0, r.broken is not None) for r in tables.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()) == [(0, True), (1, False)]
    d = tmp_path / "arrays"
    d.mkdir()
    (d / "one.json").write_text('[{"w": "p"}, {"w": "q"}]')
    (d / "two.json").write_text('{"turns": [{"w": "r"}]}')
    got = {(r.stem, r.pos, r.w) for r in tables.read_arrays(spark, str(d), "w:string", "turns").collect()}
    assert got == {("one", 0, "p"), ("one", 1, "q"), ("two", 0, "r")}
    assert {r.stem for r in tables.stems_in(spark, str(d), ".json").collect()} == {"one", "two"}
    assert tables.settled_files(spark, str(d)).count() == 0


def test_shards_and_routes(spark, tmp_path):
    df = spark.range(25).select(F.col("id").alias("k"))
    shards = dataset.shard_files(df, "k", 10, "train")
    assert {r.file: r.n for r in shards.groupBy("file").agg(F.count("*").alias("n")).collect()} == {"train-001-of-003": 10, "train-002-of-003": 10, "train-003-of-003": 5}
    tables.write_shards(df, str(tmp_path / "s"), shards, "k")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 25
    tables.write_routed(df.withColumn("status", F.when(F.col("k") < 5, "reject").otherwise("pass")), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r/status=reject")).count() == 5


def test_steps(spark, tmp_path):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1), "s1", True, 1.5, None)], tables.STEP)
    tables.write_steps(rows, str(tmp_path / "steps"))
    tables.write_steps(rows, str(tmp_path / "steps"))
    got = tables.read_steps(spark, str(tmp_path / "steps"))
    assert got.count() == 2 and got.first().items is None


def test_delta_commands(spark, tmp_path):
    source = tmp_path / "in"
    messages = [("s", 1, 0, "text", "Hel"), ("s", 2, 0, "text", "Hello"), ("s", 3, 0, "text", "Help"), ("s", 4, 1, "text", "New"), ("s", 5, 0, "text", "late"), ("s", 6, 1, "cancel", "")]
    schema = "session string, arrived long, generation long, kind string, text string"
    for m in messages:
        spark.createDataFrame([m], schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = deltas.deltas(spark.readStream.schema(schema).parquet(str(source)))
    q = stream.writeStream.format("memory").queryName("commands").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r.op, r.text) for r in spark.table("commands").orderBy("seq").collect()]
    emitted, generation, expected = "", 0, []
    for m in messages:
        emitted, generation, out = deltas.step(emitted, generation, m[2:])
        expected += out
    assert got == expected == [("append", "Hel"), ("append", "lo"), ("reset", ""), ("append", "Help"), ("reset", ""), ("append", "New"), ("close", "[CANCELLED]")]


def test_windows_equal_the_batch(spark, tmp_path):
    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    folder = tmp_path / "ev"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(folder))
    stream = deltas.tick_windows(spark.readStream.schema(schema).parquet(str(folder)))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = deltas.tick_windows(spark.read.parquet(str(folder)))
    key = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    assert key(spark.table("windows")) == key(batch)
