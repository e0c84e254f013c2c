"""Session memory as typed keyed state: a list of turns that lives for a time, and a value that says when the last one was."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CUT = 300


class Memory(StatefulProcessor):
    """Keeps each key's last turns; a turn more than a gap after the last one, by event time, starts anew.

    The rows of a batch are put in order of time; a turn from before the last one kept joins the memory in its place and does
    not set the clock back.  State that no turn has touched for the time to live is dropped by the store itself.
    """

    def __init__(self, at: str, text: str, keep: int, gap_seconds: float, live_ms: int | None) -> None:
        self.at, self.text, self.keep, self.gap, self.live = at, text, keep, gap_seconds, live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "at double, text string", ttlDurationMs=self.live)
        self.last = handle.getValueState("last", "at double, turns bigint", ttlDurationMs=self.live)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = pd.concat(list(rows)).sort_values([self.at, self.text])
        last, turns = self.last.get() if self.last.exists() else (None, 0)
        memory = [(float(a), t) for a, t in self.turns.get()] if self.turns.exists() else []
        for when, what in zip(new[self.at], new[self.text], strict=True):
            at = when.timestamp()
            if last is not None and at - last > self.gap:
                turns, memory = 0, []
            last, turns = max(at, last if last is not None else at), turns + 1
            memory = sorted([*memory, (at, str(what)[:CUT])], key=lambda m: m[0])[-self.keep :]
        self.last.update((last, turns))
        self.turns.put(memory)
        yield pd.DataFrame({"key": [key[0]], "turns": [turns], "memory": [[t for _, t in memory]]})

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that typed state needs; to be called before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def remembered(turns: DataFrame, by: str, at: str, text: str, keep: int = 3, gap_seconds: float = 1800, live_seconds: float | None = 86_400) -> DataFrame:
    """(key, turns, memory) of every key that a batch has touched: turns of its session so far, and the last ``keep`` of them.

    A time to live is in processing time, in which the engine always expects another batch: start the query with a
    processing-time trigger, or with ``once``; ``availableNow`` would not end.
    """
    kind = dict(turns.dtypes)[by]
    processor = Memory(at, text, keep, gap_seconds, int(live_seconds * 1000) if live_seconds else None)
    return turns.groupBy(by).transformWithStateInPandas(processor, f"key {kind}, turns bigint, memory array<string>", "Update", "ProcessingTime")
