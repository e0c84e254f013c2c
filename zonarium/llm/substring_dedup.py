"""Substring deduplication: remove words that repeat a passage of an earlier document.

A window is ``window`` consecutive words of one document.  A word goes when a window covering it
also starts in a document with a smaller id.  Documents are dealt into buckets of bounded size, and:

1. *Count-min prefilter.*  Every bucket counts its windows in a count-min sketch of ``depth`` rows and sends the touched
   cells, coded by their gaps, to the shards of the sketch; a shard merges the partition sketches, saturating at two, and
   sends each bucket one bit a cell.  The merged sketch never underestimates, so a window whose estimate is below two
   occurs once and is ignored without loss.  A row has about four cells for each window of the corpus, so one window in
   twenty that occurs once gets through whatever the size, and nothing is broadcast or gathered.
2. *Exact second pass.*  A bucket sends, for each distinct window estimated repeated, a 96-bit hash (made of 64-bit
   word hashes) and the smallest id in the bucket; hash ranges
   are grouped exactly, and one bit a window comes back: whether a smaller id exists elsewhere.
3. *Removal.*  Each bucket recomputes its windows, applies the bits and joins what is left.

The pre-aggregation by bucket means that a passage standing in a third of all documents costs one
entry a bucket in either pass.

Edge cases: null text counts as empty; a null id counts as larger than every other and as not
smaller than another null; rows with equal ids do not remove from one another; texts shorter than
a window are kept whole; an empty table gives an empty result; only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonarium.llm import textbatch as tb

NULL_ID = np.iinfo(np.int64).max
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
#: Cells of a row of the sketch for each byte of text, when its width is not given: windows are fewer than a sixth of the bytes.
CELLS_A_BYTE = 4 / 6


@dataclass(frozen=True)
class Sketch:
    """Shape of the count-min sketch: ``depth`` rows of ``2**width_log2`` cells (by the corpus if not given), ``2**shard_log2`` of them a shard (as many shards as hash ranges if not given)."""

    width_log2: int | None = None
    depth: int = 2
    shard_log2: int | None = None

    def sized(self, total_bytes: int, ranges_log2: int) -> Sketch:
        width = self.width_log2 or min(60, max(20, math.ceil(math.log2(max(2, total_bytes * CELLS_A_BYTE)))))
        return Sketch(width, self.depth, self.shard_log2 if self.shard_log2 is not None else max(0, width - ranges_log2))

    def cells(self, windows: np.ndarray, row: int) -> np.ndarray:
        h = tb.mix64(windows + np.uint64(0xA0761D6478BD642F * (row + 1) % 2**64))
        return (h >> np.uint64(64 - self.width_log2)).astype(np.int64)

    def cuts(self, cells: np.ndarray) -> np.ndarray:
        """Where each shard's cells begin among sorted ones, and the end."""
        return np.searchsorted(cells, np.arange((1 << (self.width_log2 - self.shard_log2)) + 1) << self.shard_log2)


def pack_gaps(sorted_values: np.ndarray) -> bytes:
    """Non-decreasing integers as their gaps, seven bits a byte, the eighth saying that more follow."""
    gaps = np.diff(sorted_values, prepend=0)
    size = np.ones(len(gaps), np.int64)
    for k in range(1, 9):
        more = gaps >> (7 * k) > 0
        if not more.any():
            break
        size += more
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        some = np.flatnonzero(size > k)
        out[end[some] - size[some] + k] = ((gaps[some] >> (7 * k)) & 127) | np.where(size[some] > k + 1, 128, 0)
    return out.tobytes()


def unpack_gaps(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    gaps = np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), first)
    return np.cumsum(gaps)


def _window_hashes(off: np.ndarray, raw: np.ndarray, width: int) -> Iterator[tuple[int, int, tb.Words, np.ndarray, np.ndarray, np.ndarray]]:
    for i, j in tb.slices(off):
        words = tb.Words(off[i : j + 1] - off[i], raw[off[i] : off[j]])
        hashed = words.hashes()
        windows, at = words.windows(hashed, width)
        yield i, j, words, hashed, windows, at


def _touched(windows: np.ndarray, sketch: Sketch, row: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells of one row that a bucket's windows touch, sorted, and which of them twice or more."""
    cells = np.sort(sketch.cells(windows, row))
    new = np.ones(len(cells), bool)
    new[1:] = cells[1:] != cells[:-1]
    first = np.flatnonzero(new)
    return cells[first], np.diff(np.append(first, len(cells))) > 1


def estimated_repeated(windows: np.ndarray, flags: list[np.ndarray], sketch: Sketch) -> np.ndarray:
    """Indices of the windows whose estimated count is two or more; ``flags`` has each row's touched cells that are."""
    left = np.arange(len(windows))
    for row, often in enumerate(flags):
        cells = sketch.cells(windows[left], row)
        at = np.searchsorted(often, cells)
        at[at == len(often)] = 0
        left = left[often[at] == cells] if len(often) else left[:0]
    return left


@dataclass
class _Bucket:
    """The candidate windows of one bucket of documents."""

    off: np.ndarray
    raw: np.ndarray
    count: np.ndarray  # words of each text
    at: np.ndarray  # first word of each candidate window, counted over the bucket
    doc: np.ndarray  # id of its document
    order: np.ndarray  # candidates sorted by hash
    group: np.ndarray  # distinct-window number of each sorted candidate
    high: np.ndarray  # of each distinct window: 64 bits, 32 more bits, smallest id
    low: np.ndarray
    least: np.ndarray


def _grouped(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal pairs together, and where each run of equals begins."""
    order = np.argsort(high, kind="stable")
    h, w = high[order], low[order]
    if np.any((h[1:] == h[:-1]) & (w[1:] != w[:-1])):
        order = np.lexsort((low, high))
        h, w = high[order], low[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    return order, new


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    text = table.column("text").combine_chunks()
    return tb.utf8(text.chunk(0) if isinstance(text, pa.ChunkedArray) else text)


def _bucket(table: pa.Table, width: int, flags: list[np.ndarray], sketch: Sketch) -> _Bucket:
    ids = table.column("doc_id").combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    ids = ids.fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)
    off, raw = _texts(table)
    high, low, at, doc, count = [], [], [], [], []
    base = 0
    for i, _, words, hashed, windows, first in _window_hashes(off, raw, width):
        pick = estimated_repeated(windows, flags, sketch)
        first = first[pick]
        more = np.zeros(len(first), np.uint64)
        for k in range(width):
            more = (more + hashed[first + k]) * np.uint64(0x9FB21C651E98DF25)
            more ^= more >> np.uint64(32)
        high.append(windows[pick])
        low.append((more >> np.uint64(32)).astype(np.uint32))
        at.append(first + base)
        doc.append(ids[i + words.text[first]])
        count.append(words.count)
        base += len(hashed)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    h, w, d = join(high, np.uint64), join(low, np.uint32), join(doc, np.int64)
    order, new = _grouped(h, w)
    starts = np.flatnonzero(new)
    least = np.minimum.reduceat(d[order], starts) if len(starts) else np.zeros(0, np.int64)
    return _Bucket(off, raw, join(count, np.int64), join(at, np.int64), d, order, np.cumsum(new) - 1, h[order][starts], w[order][starts], least)


def _shard_cuts(high: np.ndarray, shards_log2: int) -> np.ndarray:
    """Where each hash range begins among sorted hashes, and the end."""
    if not shards_log2:
        return np.array([0, len(high)])
    edges = np.arange(1, 1 << shards_log2, dtype=np.uint64) << np.uint64(64 - shards_log2)
    return np.concatenate([[0], np.searchsorted(high, edges), [len(high)]])


def substring_dedup(
    docs: DataFrame,
    window: int = 13,
    sketch: Sketch | None = None,
    bucket_bytes: int = 20 << 20,
    with_text: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: words, removed words, and what is left (its digest and, if asked, the text)."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    shards_log2 = int(buckets).bit_length()
    shape = (sketch or Sketch()).sized(total, shards_log2)
    rows_log2 = shape.width_log2 - shape.shard_log2

    dealt = base.withColumn("bucket", F.expr(f"cast(pmod(xxhash64(doc_id, text), {buckets}) as int)")).repartition(buckets, "bucket")

    def own_windows(table: pa.Table) -> np.ndarray:
        parts = [windows for *_, windows, _ in _window_hashes(*_texts(table), window)]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def touch(key: tuple, table: pa.Table) -> pa.Table:
        """The cells of the sketch that a bucket touches, by shard."""
        windows = own_windows(table)
        rows = []
        for row in range(shape.depth):
            cells, twice = _touched(windows, shape, row)
            cuts = shape.cuts(cells)
            rows += [((row << rows_log2) + int(k), pack_gaps(cells[cuts[k] : cuts[k + 1]] - (int(k) << shape.shard_log2)), np.packbits(twice[cuts[k] : cuts[k + 1]]).tobytes()) for k in np.flatnonzero(np.diff(cuts))]
        shard, cells, twice = map(list, zip(*rows, strict=True)) if rows else ([], [], [])
        return pa.table({"shard": pa.array(shard, pa.int64()), "bucket": pa.array([key[0].as_py()] * len(shard), pa.int32()), "cells": pa.array(cells, pa.binary()), "twice": pa.array(twice, pa.binary())})

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        """One shard of the merged sketch; each bucket learns which of its cells hold two windows or more."""
        cells = [unpack_gaps(x) for x in table.column("cells").to_pylist()]
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(c)).astype(bool) for x, c in zip(table.column("twice").to_pylist(), cells, strict=True)])
        every = np.concatenate(cells)
        order = np.argsort(every, kind="stable")
        new = np.ones(len(every), bool)
        new[1:] = every[order][1:] != every[order][:-1]
        head = np.flatnonzero(new)
        often = (np.diff(np.append(head, len(every))) > 1) | np.logical_or.reduceat(twice[order], head)
        flags = np.empty(len(every), bool)
        flags[order] = often[np.cumsum(new) - 1]
        return _answers(key, table, cells, flags)

    def _answers(key: tuple, table: pa.Table, parts: list[np.ndarray], flags: np.ndarray) -> pa.Table:
        out, at = [], 0
        for bucket, part in zip(table.column("bucket").to_pylist(), parts, strict=True):
            some = flags[at : at + len(part)]
            at += len(part)
            if some.any():
                out.append((bucket, np.packbits(some).tobytes()))
        return pa.table({"bucket": pa.array([x for x, _ in out], pa.int32()), "shard": pa.array([key[0].as_py()] * len(out), pa.int64()), "flags": pa.array([x for _, x in out], pa.binary())})

    def often_cells(table: pa.Table, answers: pa.Table) -> list[np.ndarray]:
        """Of each row of the sketch, the bucket's cells that hold two windows or more."""
        windows = own_windows(table)
        said = dict(zip(answers.column("shard").to_pylist(), answers.column("flags").to_pylist(), strict=True))
        out = []
        for row in range(shape.depth):
            cells, _ = _touched(windows, shape, row)
            cuts = shape.cuts(cells)
            often = np.zeros(len(cells), bool)
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                bits = said.get((row << rows_log2) + k)
                if bits is not None:
                    often[cuts[k] : cuts[k + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(cuts[k + 1] - cuts[k])).astype(bool)
            out.append(cells[often])
        return out

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        b = _bucket(left, window, often_cells(left, right), shape)
        cuts = _shard_cuts(b.high, shards_log2)
        small = len(b.least) == 0 or (b.least.max() < 2**31 and b.least.min() >= 0)
        least = b.least.astype(np.int32 if small else np.int64)
        rows = [(int(k), b.high[cuts[k] : cuts[k + 1]].tobytes(), b.low[cuts[k] : cuts[k + 1]].tobytes(), least[cuts[k] : cuts[k + 1]].tobytes()) for k in np.flatnonzero(np.diff(cuts))]
        shard, high, low, ids = map(list, zip(*rows, strict=True)) if rows else ([], [], [], [])
        bucket = left.column("bucket")[0].as_py() if len(left) else -1
        return pa.table({"shard": pa.array(shard, pa.int64()), "bucket": pa.array([bucket] * len(shard), pa.int32()), "high": pa.array(high, pa.binary()), "low": pa.array(low, pa.binary()), "ids": pa.array(ids, pa.binary())})

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        highs = [np.frombuffer(x, np.uint64) for x in table.column("high").to_pylist()]
        lows = [np.frombuffer(x, np.uint32) for x in table.column("low").to_pylist()]
        ids = [np.frombuffer(x, np.int32 if len(x) == 4 * len(h) else np.int64) for x, h in zip(table.column("ids").to_pylist(), highs, strict=True)]
        high, low, doc = np.concatenate(highs), np.concatenate(lows), np.concatenate([x.astype(np.int64) for x in ids])
        order, new = _grouped(high, low)
        starts = np.flatnonzero(new)
        least = np.minimum.reduceat(doc[order], starts)[np.cumsum(new) - 1]
        earlier = np.empty(len(doc), bool)
        earlier[order] = least < doc[order]
        return _answers(key, table, highs, earlier)

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        told, judged = (right.filter(pa.compute.equal(right.column("round"), k)) for k in (0, 1))
        b = _bucket(left, window, often_cells(left, told), shape)
        cuts = _shard_cuts(b.high, shards_log2)
        earlier = np.zeros(len(b.high), bool)
        for shard, flags in zip(judged.column("shard").to_pylist(), judged.column("flags").to_pylist(), strict=True):
            n = cuts[shard + 1] - cuts[shard]
            earlier[cuts[shard] : cuts[shard + 1]] = np.unpackbits(np.frombuffer(flags, np.uint8), count=n).astype(bool)
        doc = b.doc[b.order]
        gone = (doc > b.least[b.group]) | earlier[b.group]
        n = int(b.count.sum())
        mask = tb.covered(n, b.at[b.order][gone], window)
        begin = np.concatenate([[0], np.cumsum(b.count)])
        removed = tb.per_text(mask, begin)
        raw = b.raw.tobytes()
        digest, kept = [], []
        for i in range(len(b.count)):
            words = raw[b.off[i] : b.off[i + 1]].split()
            if removed[i]:
                words = compress(words, ~mask[begin[i] : begin[i + 1]])
            rest = b" ".join(words)
            digest.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest if with_text else None)
        return pa.table(
            {
                "doc_id": left.column("doc_id"),
                "n_words": pa.array(b.count.astype(np.int64)),
                "n_removed": pa.array(removed),
                "kept_sha256": pa.array(digest),
                "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    flagged = "bucket int, shard long, flags binary"
    touched = dealt.groupBy("bucket").applyInArrow(touch, "shard long, bucket int, cells binary, twice binary")
    told = touched.groupBy("shard").applyInArrow(merge, flagged)
    asked = dealt.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(ask, "shard long, bucket int, high binary, low binary, ids binary")
    judged = asked.groupBy("shard").applyInArrow(answer, flagged)
    answers = told.withColumn("round", F.lit(0)).unionByName(judged.withColumn("round", F.lit(1)))
    return dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(apply, SCHEMA)
