"""Typed session memory: batches, gaps, late turns, expiry by the store, and a restart from the checkpoint."""

import time

import pytest
from pyspark.sql import functions as F

from zonarium.streaming.memory import remembered, use_rocksdb

TURNS = "who string, at timestamp, said string"


@pytest.fixture()
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    use_rocksdb(spark)
    yield
    spark.conf.set(key, before)


def put(spark, folder, name, rows):
    spark.createDataFrame([(w, a, s) for w, a, s in rows], "who string, at string, said string").select("who", F.col("at").cast("timestamp").alias("at"), "said").coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, folder, checkpoint, seen, **options):
    stream = spark.readStream.schema(TURNS).parquet(f"file://{folder}/*")
    query = (
        remembered(stream, "who", "at", "said", **options).writeStream.foreachBatch(lambda b, n: seen.append({r.key: (r.turns, list(r.memory)) for r in b.collect()})).outputMode("update")
        .option("checkpointLocation", f"file://{checkpoint}").trigger(once=True).start()
    )
    assert query.awaitTermination(45) and query.exception() is None


def test_batches_gaps_late_turns_and_restart(spark, store, tmp_path):
    turns, seen = tmp_path / "turns", []
    put(spark, turns, "1", [("a", "2024-01-01 10:00:00", "one"), ("a", "2024-01-01 10:01:00", "two"), ("b", "2024-01-01 10:00:00", "x" * 400)])
    run(spark, turns, tmp_path / "check", seen, keep=3)
    assert seen[-1] == {"a": (2, ["one", "two"]), "b": (1, ["x" * 300])}
    put(spark, turns, "2", [("a", "2024-01-01 10:20:00", "three"), ("a", "2024-01-01 10:00:30", "late"), ("b", "2024-01-01 12:00:00", "anew")])
    run(spark, turns, tmp_path / "check", seen, keep=3)  # a new query that goes on from the checkpoint
    assert seen[-1] == {"a": (4, ["late", "two", "three"]), "b": (1, ["anew"])}
    put(spark, turns, "3", [("a", "2024-01-01 10:05:00", "very late"), ("a", "2024-01-01 10:45:00", "four")])
    run(spark, turns, tmp_path / "check", seen, keep=3)
    assert seen[-1] == {"a": (6, ["very late", "three", "four"])}  # the late turn has not set the clock back


def test_state_expires(spark, store, tmp_path):
    turns, seen = tmp_path / "turns", []
    put(spark, turns, "1", [("a", "2024-01-01 10:00:00", "one")])
    run(spark, turns, tmp_path / "check", seen, live_seconds=2)
    time.sleep(3)
    put(spark, turns, "2", [("a", "2024-01-01 10:01:00", "two")])
    run(spark, turns, tmp_path / "check", seen, live_seconds=2)
    assert seen == [{"a": (1, ["one"])}, {"a": (1, ["two"])}]
