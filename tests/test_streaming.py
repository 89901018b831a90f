"""Folds over streams give what they give in batch."""

import json
import random

from pyspark.sql import functions as F

from sparkloom.streaming import events as ev

SCHEMA = "user_id long, event_id long, event_type string, text string"


def test_stream_fold_equals_batch_fold(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(i % 7, i, rnd.choice(["view", "click", "error"]), f"{i};") for i in range(400)]
    for n in range(4):  # in order, the way a key's log grows, with the end of each part sent again
        part = rows[max(0, n * 100 - 15) : (n + 1) * 100]
        rnd.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = ev.stream_fold(stream, 60).writeStream.format("memory").queryName("folded").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.user_id: r for r in spark.sql("select user_id, max_by(struct(last_kind, last_seq, steps, output), last_seq) as s from folded group by user_id").collect()}
    want = ev.fold_jobs(spark.createDataFrame(rows, SCHEMA), "user_id", "event_id", "event_type", F.col("text"), 60).collect()
    assert len(want) == 7
    for w in want:
        s = got[w.user_id].s
        assert (s.last_kind, s.last_seq, s.steps, s.output) == (w.last_kind, w.last_seq, w.steps, w.output)


def test_windowed_counts(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").coalesce(1).write.parquet(str(tmp_path / "e"))
    schema = spark.read.parquet(str(tmp_path / "e")).schema
    s = ev.windowed_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "e")), "ts", "event_type")
    q = s.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(events) from counts").first()[0] == 1000


def test_nodes_of_partial_json(spark):
    nodes = [{"id": f"n{i}", "text": 'a "quoted" } ] { \\ \\" thing', "sub": {"k": [1, {"z": 2}]}} for i in range(6)]
    text = json.dumps({"title": "nodes [", "nodes": nodes, "rest": [{"id": "no"}]})
    for size in (1, 3, 17, len(text)):
        t, found = ev.NodeTracker(), []
        for i in range(0, len(text), size):
            found += t.push(text[i : i + size])
        assert [json.loads(x) for x in found] == nodes
    df = spark.createDataFrame([(1, i, text[i * 50 : i * 50 + 50]) for i in range(len(text) // 50 + 1)] + [(2, 0, "none")], "call_id long, seq long, piece string")
    assert [json.loads(r.node) for r in ev.streamed_nodes(df).orderBy("seq").collect()] == nodes


def test_replay_changes_nothing(spark):
    log = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    fold = lambda df: sorted(ev.fold_jobs(df, "user_id", "event_id", "event_type", F.col("props"), 500).collect())
    assert fold(log) == fold(log.unionByName(log).unionByName(log.where("event_id > 500")))
