"""Streaming forms: windowed rates with watermarks, and sessions kept as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, at: str, by: list[str], every: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts by time window and group; windows close once the watermark has passed them."""
    window = F.window(at, every, slide) if slide else F.window(at, every)
    return events.withWatermark(at, late).groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def session_counts(events: DataFrame, at: str, by: str, gap: str, late: str) -> DataFrame:
    """Sessions by gap as a streaming aggregation."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def session_memory(turns: DataFrame, by: str, at: str, text: str, keep: int = 3, gap_seconds: int = 1800) -> DataFrame:
    """The last ``keep`` turns of each key's current session after every batch, as keyed state.

    A turn more than ``gap_seconds`` after its predecessor starts anew; state expires in event time.
    """
    out = f"{by} bigint, turns int, memory array<string>"
    state = "last double, turns int, memory array<string>"

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        last, turns, memory = held.get if held.exists else (None, 0, [])
        memory = list(memory)
        rows = pd.concat(list(batches)).sort_values([at, text])
        for when, what in zip(rows[at], rows[text], strict=True):
            seconds = when.timestamp()
            if last is not None and seconds - last > gap_seconds:
                turns, memory = 0, []
            last, turns = seconds, turns + 1
            memory = [*memory, str(what)[:300]][-keep:]
        held.update((last, turns, memory))
        held.setTimeoutTimestamp(max(int(last * 1000), held.getCurrentWatermarkMs()) + gap_seconds * 1000 + 1)
        yield pd.DataFrame({by: [key[0]], "turns": [turns], "memory": [memory]})

    return turns.groupBy(by).applyInPandasWithState(step, out, state, "update", GroupStateTimeout.EventTimeTimeout)


def upsert_batches(stream: DataFrame, key: str, order: str, path: str, checkpoint: str):
    """Keeps the newest row of each key: every batch adds the newest rows of its keys below ``path``, the table is merged when it is read.

    A batch writes what it brought and nothing else, under its own number, so a repeated batch replaces itself; ``newest_rows`` reads the
    table and ``fold_batches`` merges batches into one while the stream rests.
    """
    from zonarium.operators.lookups import keep_better

    def add(batch: DataFrame, number: int) -> None:
        keep_better(batch, key, F.col(order), order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_rows(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The table that ``upsert_batches`` keeps: of each key the row of the last batch that has it, by one aggregation that combines before the shuffle."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("_r")).select("_r.*")


def fold_batches(spark: SparkSession, path: str, key: str, into: str) -> None:
    """Writes the merged table as batch -1 of a new folder, which a reader or a new stream goes on from; the old folder stays until it is deleted."""
    newest_rows(spark, path, key).write.mode("errorifexists").parquet(f"{into}/batch=-1")
