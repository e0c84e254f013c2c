"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A document is contaminated by a benchmark item if it holds a passage within ``edits`` insertions,
deletions and substitutions of *any* ``window``-byte piece of the item.  By the q-gram lemma such a
passage shares at least ``window - q + 1 - q * edits`` q-grams with the piece, on diagonals (document
position minus item position) that lie within ``edits`` of one another.

1. Positions of benchmark q-grams are found in the whole text in numpy; only stretches of
   ``window + edits`` bytes that hold enough of them, and as much on either side, are looked at further.
2. Their diagonals are counted in bands of width ``2 * edits`` that overlap by half, so the diagonals of
   a true match always share a band; every piece (at every byte of the item) that reaches the bound in
   a band is retained.
3. Retained pieces are aligned with the text around the band, in a band.  Those that share most go
   first, and a piece is skipped only if the lemma says that it cannot beat what was found, so the edits
   reported are the least of all pieces.

Text is compared as UTF-8 bytes after folding A-Z and white space; a character outside ASCII thus
weighs as its bytes.  Memory is bounded for any text: long stretches are handled in chunks, long items
in segments, both overlapping by more than a passage, and chunks and text windows that are equal byte for byte
are handled once.

The benchmark is read in blocks of ``block_bytes``.  If it is one block, there is one pass over the
documents, with no shuffle.  If it has more, one pass keeps the documents that can match any block (a bitmap
of all q-grams, bounded by ``SIEVE_BYTES``), and each block is then broadcast to a pass over those alone.

Edge cases: null or empty texts and items match nothing; an item of ``q`` to ``shortest - 1`` bytes has too few
q-grams for the lemma and must be held exactly, at word boundaries; a shorter one must be the whole document, less
white space at the ends; items between ``shortest`` and ``window`` are one piece with a budget in proportion; repeated
items and documents each give their rows; a null id is kept as null; an empty table gives an empty
result; texts are searched whole; other columns are not read (:func:`decontaminated` passes them
through, whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonarium.llm import textbatch as tb
from zonarium.llm.simhash_dedup import SMALL_ROWS, written

SCHEMA = "doc_id long, item_id long, shared long, edits long, at long"
#: Items and stretches of text are cut into overlapping parts of about so many bytes.
PART = 1024
#: Pairs of equal q-grams expanded at once.
PAIRS = 1 << 20
#: Most bytes of the bitmap of a benchmark of several blocks; beyond it more documents pass to the blocks.
SIEVE_BYTES = 1 << 27

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[0x09:0x0E] = 0x20
_PAD = 0xFF  # no byte of UTF-8


@dataclass(frozen=True)
class Budget:
    """What counts as a leak: ``edits`` in ``window`` bytes; items under ``shortest`` bytes must be there exactly."""

    q: int = 12
    window: int = 80
    edits: int = 5
    shortest: int = 24

    def piece(self, length: int) -> tuple[int, int, int]:
        """Piece length, edit budget and least shared q-grams for an item of this length."""
        w = min(length, self.window)
        e = min(w * self.edits // self.window, (w - self.q) // self.q)
        return w, e, w - self.q + 1 - self.q * e


def folded(text: str) -> np.ndarray:
    return _FOLD[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]


def grams(text: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit code of each q-gram (8 <= q <= 16) from its first and last eight bytes."""
    n = len(text) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = np.ndarray((len(text) - 7,), "<u8", text.tobytes(), strides=(1,))
    h = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += eight[q - 8 : q - 8 + n] * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _rolled(text: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every ``width``-byte window."""
    n = len(text)
    up, down = tb.powers(tb.BYTE_MULTIPLIER, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(tb.BYTE_CODES[text] * up[:n], out=total[1:])
    return tb.mix64((total[width:] - total[:-width]) * down[: n - width + 1])


def _slot(codes: np.ndarray, size: int) -> np.ndarray:
    """Place of each code in a bitmap whose size is a power of two."""
    return (codes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(65 - size.bit_length())


def _dense(at: np.ndarray, least: int, reach: int) -> np.ndarray:
    """Positions from which a stretch of ``reach`` holds the least number of hits."""
    if len(at) < least:
        return at[:0]
    first = at[: len(at) - least + 1]
    return first[at[least - 1 :] - first <= reach]


class Tier:
    """Items whose pieces are alike: postings of the q-grams of their segments."""

    def __init__(self, items: list[tuple[int, np.ndarray]], budget: Budget) -> None:
        self.q = budget.q
        self.item, self.text, self.shape = [], [], []
        for number, text in items:
            w, e, least = budget.piece(len(text))
            for s in range(0, max(1, len(text) - w + 1), PART):
                self.item.append(number)
                self.text.append(text[s : s + PART + w - 1])
                self.shape.append((w, e, least))
        codes = [grams(t, self.q) for t in self.text]
        code = np.concatenate(codes)
        segment = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        order = np.argsort(code, kind="stable")
        self.codes, first = np.unique(code[order], return_index=True)
        rank = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(code))))
        #: postings sorted by q-gram, segment and place; the first two as one number
        self.key = rank * len(codes) + segment[order]
        self.place = np.concatenate([np.arange(len(c), dtype=np.int32) for c in codes])[order]
        self.first = np.append(first, len(code))
        signs = [_rolled(t, s[0]) for t, s in zip(self.text, self.shape, strict=True)]
        #: a hash of every piece, and where each segment's begin
        self.sign, self.begin = np.concatenate(signs), np.concatenate([[0], np.cumsum([len(x) for x in signs])])
        self.bitmap = np.zeros(1 << 22, bool)
        self.bitmap[_slot(self.codes, len(self.bitmap))] = True
        self.item_of = np.array(self.item)
        self.least = min(s[2] for s in self.shape)
        self.reach = max(s[0] + s[1] for s in self.shape)
        self.half = max(1, max(s[1] for s in self.shape))

    def hits(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the tier's q-grams among the codes of a text, and which q-gram each is."""
        at = np.flatnonzero(self.bitmap[_slot(code, len(self.bitmap))])
        which = np.minimum(np.searchsorted(self.codes, code[at]), len(self.codes) - 1)
        ok = self.codes[which] == code[at]
        return at[ok], which[ok]

    def search(self, text: np.ndarray, at: np.ndarray, which: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """For each item held: (edits, shared q-grams, end position) of its best piece."""
        best: dict[int, tuple[int, int, int]] = {}
        seen: set[bytes] = set()
        start = _dense(at, self.least, self.reach)
        cut = np.flatnonzero(np.diff(start) > 2 * self.reach) + 1 if len(start) else []
        for some in np.split(start, cut) if len(start) else ():
            low, high = max(0, int(some[0]) - self.reach), min(len(text), int(some[-1]) + 2 * self.reach)
            for a in range(low, high, PART):
                a, b = max(0, a - self.reach), min(len(text), a + PART + 2 * self.reach)
                chunk = text[a:b]
                if len(text) > 4 * PART:
                    key = chunk.tobytes()
                    if key in seen:
                        continue
                    seen.add(key)
                inside = slice(*np.searchsorted(at, [a, b - self.q + 1]))
                self._search(chunk, a, at[inside] - a, which[inside], best)
        return best

    def _search(self, text: np.ndarray, shift: int, at: np.ndarray, which: np.ndarray, best: dict[int, tuple[int, int, int]]) -> None:
        """Adds what one chunk of text holds to ``best``."""
        n = len(self.text)
        ranges, ask = [(0, n)], [np.zeros((4, 0), np.int64)]
        while ranges:
            low, high = ranges.pop()
            first, last = np.searchsorted(self.key, which * n + low), np.searchsorted(self.key, which * n + high)
            size = last - first
            pairs = int(size.sum())
            if pairs > PAIRS and high - low > 1:
                ranges += [(low, (low + high) // 2), ((low + high) // 2, high)]
            elif pairs:
                post = np.arange(pairs) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
                ask.append(self._retained(self.key[post] % n, self.place[post].astype(np.int64), np.repeat(at, size), best))
        segment, start, band, count = np.concatenate(ask, axis=1)
        if not len(segment):
            return
        # the text around each, padded so that every window is whole; equal pieces beside equal text are aligned once
        width = 4 * self.half + 1
        side = max(s[0] for s in self.shape) + width
        padded = np.concatenate([np.full(side, _PAD, np.uint8), text, np.full(side, _PAD, np.uint8)])
        base = np.clip(start + (band - 1) * self.half + side, 0, len(padded) - side)
        pair = tb.mix64(self.sign[self.begin[segment] + start] ^ tb.mix64(_rolled(padded, side)[base] + self.item_of[segment].astype(np.uint64)))
        order = np.argsort(-count, kind="stable")
        order = order[np.sort(np.unique(pair[order], return_index=True)[1])]
        self._verify(padded, np.stack([segment, start, base, count])[:, order], shift - side, best)

    def _retained(self, segment: np.ndarray, place: np.ndarray, pos: np.ndarray, best: dict[int, tuple[int, int, int]]) -> np.ndarray:
        """Segment, start, band and shared q-grams of every piece that reaches the bound in a band."""
        exact = [i for i, x in best.items() if x[0] == 0]
        if exact:  # nothing can be better
            open_ = ~np.isin(self.item_of[segment], exact)
            segment, place, pos = segment[open_], place[open_], pos[open_]
        band = (pos - place) // self.half
        segment, place, band = np.tile(segment, 2), np.tile(place, 2), np.concatenate([band, band - 1])
        order = np.lexsort((place, band, segment))
        segment, place, band = segment[order], place[order], band[order]
        group = np.ones(len(segment), bool)
        group[1:] = (np.diff(segment) != 0) | (np.diff(band) != 0)
        new = group.copy()
        new[1:] |= np.diff(place) != 0
        segment, place, band, group = segment[new], place[new], band[new], group[new]
        bounds = np.append(np.flatnonzero(group), len(group))
        out = [np.zeros((4, 0), np.int64)]
        for k in np.flatnonzero(np.diff(bounds) >= self.least).tolist():
            a, b = bounds[k], bounds[k + 1]
            s, r = int(segment[a]), place[a:b]
            w, _, least = self.shape[s]
            if b - a < least:
                continue
            starts = np.arange(len(self.text[s]) - w + 1)
            count = np.searchsorted(r, starts + w - self.q, side="right") - np.searchsorted(r, starts, side="left")
            good = np.flatnonzero(count >= least)
            out.append(np.stack([np.full(len(good), s), good, np.full(len(good), band[a]), count[good]]))
        return np.concatenate(out, axis=1)

    def _verify(self, padded: np.ndarray, ask: np.ndarray, shift: int, best: dict[int, tuple[int, int, int]]) -> None:
        """Aligns retained pieces, those that share most first, while the lemma leaves room for fewer edits."""
        k, step = 0, 16
        while k < ask.shape[1]:
            by_width: dict[int, list[tuple[int, ...]]] = {}
            for s, start, base, count in ask[:, k : k + step].T.tolist():
                w, e, _ = self.shape[s]
                if -(-(w - self.q + 1 - count) // self.q) < best.get(self.item[s], (e + 1,))[0]:
                    by_width.setdefault(w, []).append((s, start, base, count))
            k, step = k + step, min(4 * step, 4096)
            for w, some in by_width.items():
                for (s, _, _, count), cost, end in zip(some, *self._align(padded, some, w), strict=True):
                    i = self.item[s]
                    if cost < best.get(i, (self.shape[s][1] + 1,))[0]:
                        best[i] = (cost, count, end + shift)

    def _align(self, padded: np.ndarray, ask: list[tuple[int, ...]], w: int) -> tuple[list[int], list[int]]:
        """Least edits of each piece against the text inside its band (ends free), and where the best one ends."""
        width = 4 * self.half + 1
        lanes = np.arange(width)
        piece = np.stack([self.text[s][x : x + w] for s, x, _, _ in ask])
        base = np.array([b for _, _, b, _ in ask])
        windows = np.lib.stride_tricks.sliding_window_view(padded, w + width)[base]
        cost = np.zeros((len(ask), width), np.int16)
        for k in range(w):
            new = cost + (windows[:, k : k + width] != piece[:, k : k + 1])
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
            cost = (np.minimum.accumulate(new - lanes, axis=1) + lanes).astype(np.int16)
        best = cost.argmin(axis=1)
        return cost[np.arange(len(ask)), best].tolist(), (base + w + best).tolist()


class Index:
    """One block of benchmark items: two tiers for the lemma, exact passages, and whole texts."""

    def __init__(self, items: list[tuple[int | None, str]], budget: Budget) -> None:
        self.ids = [i for i, _ in items]
        self.q = budget.q
        texts = [folded(t) for _, t in items]
        self.size = [len(t) if len(t) < budget.shortest else budget.piece(len(t))[0] for t in texts]
        ranged = lambda low, high: [(k, t) for k, t in enumerate(texts) if low <= len(t) < high]
        by_size = [ranged(budget.window, 1 << 62), ranged(budget.shortest, budget.window)]
        self.tiers = [Tier(some, budget) for some in by_size if some]
        self.passages: dict[int, list[tuple[int, bytes]]] = {}
        for k, t in ranged(budget.q, budget.shortest):
            self.passages.setdefault(int(grams(t, budget.q)[0]), []).append((k, t.tobytes()))
        self.openings = np.sort(np.array(list(self.passages), np.uint64))
        self.whole: dict[bytes, list[int]] = {}
        for k, t in ranged(1, budget.q):
            if body := t.tobytes().strip():
                self.whole.setdefault(body, []).append(k)

    def _exact(self, text: np.ndarray, code: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, end position in the row) of short items that a text holds at word boundaries."""
        if self.passages:
            at = np.flatnonzero(np.isin(code, self.openings))
            for a, row in zip(at.tolist(), (np.searchsorted(off, at, side="right") - 1).tolist(), strict=True):
                first, last = int(off[row]), int(off[row + 1])
                for k, body in self.passages[int(code[a])]:
                    b = a + len(body)
                    if b <= last and text[a:b].tobytes() == body and (a == first or _outside(text[a - 1])) and (b == last or _outside(text[b])):
                        yield row, k, b - first
        if self.whole:
            for row in np.flatnonzero(np.diff(off) > 0).tolist():
                body = text[off[row] : off[row + 1]].tobytes().strip()
                for k in self.whole.get(body, ()) if len(body) < self.q else ():
                    yield row, k, int(off[row + 1] - off[row])

    def find(self, column: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, shared q-grams, edits, position in code points) of each leak in a column of texts."""
        off, raw = tb.utf8(column)
        for i, j in tb.slices(off):
            text = _FOLD[raw[off[i] : off[j]]]
            local = off[i : j + 1] - off[i]
            code = grams(text, self.q)
            found: dict[tuple[int, int], tuple[int, int, int]] = {}
            for tier in self.tiers:
                at, which = tier.hits(code)
                for row in np.unique(np.searchsorted(local, _dense(at, tier.least, tier.reach), side="right") - 1).tolist():
                    a, b = int(local[row]), int(local[row + 1])
                    inside = slice(*np.searchsorted(at, [a, b - self.q + 1]))
                    found |= {(row, item): x for item, x in tier.search(text[a:b], at[inside] - a, which[inside]).items()}
            for row, item, end in self._exact(text, code, local):
                found.setdefault((row, item), (0, max(0, self.size[item] - self.q + 1), end))
            for (row, item), (edits, shared, end) in found.items():
                begin = local[row] + max(0, end - self.size[item])
                yield i + row, item, shared, edits, int(((text[local[row] : begin] & 0xC0) != 0x80).sum())


def _outside(byte: int) -> bool:
    """Whether a byte is no part of a word: ASCII that is neither letter nor digit."""
    return byte < 0x80 and not chr(byte).isalnum()


class Sieve:
    """Which texts can match any item of a benchmark of several blocks: bitmaps instead of postings."""

    def __init__(self, size: int, budget: Budget) -> None:
        bits = 1 << max(22, min(SIEVE_BYTES, 8 * size).bit_length() - 1)
        self.q = budget.q
        self.maps: dict[int, tuple[np.ndarray, int]] = {}
        self.bits, self.openings, self.whole = bits, np.zeros(0, np.uint64), False

    def add(self, index: Index) -> None:
        for tier in index.tiers:
            held, least = self.maps.setdefault(tier.reach, (np.zeros(self.bits, bool), tier.least))
            held[_slot(tier.codes, self.bits)] = True
            self.maps[tier.reach] = held, min(least, tier.least)
        self.openings = np.union1d(self.openings, index.openings)
        self.whole |= bool(index.whole)

    def passes(self, column: pa.Array) -> np.ndarray:
        off, raw = tb.utf8(column)
        flag = np.zeros(len(column), bool)
        for i, j in tb.slices(off):
            text, local = _FOLD[raw[off[i] : off[j]]], off[i : j + 1] - off[i]
            code = grams(text, self.q)
            found = [np.flatnonzero(np.isin(code, self.openings))]
            found += [_dense(np.flatnonzero(held[_slot(code, self.bits)]), least, reach) for reach, (held, least) in self.maps.items()]
            for at in found:
                flag[i + np.searchsorted(local, at, side="right") - 1] = True
            if self.whole:
                for row in np.flatnonzero(np.diff(local) > 0).tolist():
                    flag[i + row] |= len(text[local[row] : local[row + 1]].tobytes().strip()) < self.q
        return flag


def _blocks(benchmark: DataFrame, budget: Budget, block_bytes: int) -> Iterator[Index]:
    """The benchmark (``i``, ``t``) in blocks; the driver holds one at a time."""
    items: list[tuple[int | None, str]] = []
    size = 0
    for row in benchmark.where("t is not null").toLocalIterator():
        items.append((row["i"], row["t"]))
        size += len(row["t"].encode())
        if size >= block_bytes:
            yield Index(items, budget)
            items, size = [], 0
    if items:
        yield Index(items, budget)


def _leaks(docs: DataFrame, index: Index) -> DataFrame:
    """One pass over ``docs`` (id, text) with one block."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shared.value.find(batch.column(1)))
            rows, items, *rest = map(list, zip(*found, strict=True)) if found else ([], [], [], [], [])
            ids = [shared.value.ids[k] for k in items]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in rest)], ["doc_id", "item_id", "shared", "edits", "at"])

    return docs.mapInArrow(scan, SCHEMA)


def _read(benchmark: DataFrame, item_col: str, item_text_col: str) -> tuple[DataFrame, int]:
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t"))
    return items, items.agg(F.sum(F.octet_length("t"))).first()[0] or 0


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    budget: Budget | None = None,
    block_bytes: int = 4 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row for each document and item it leaks: least edits of a piece, the q-grams it shares, and its place."""
    budget = budget or Budget()
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items, size = _read(benchmark, item_col, item_text_col)
    if size <= block_bytes:
        passes = [_leaks(base, index) for index in _blocks(items, budget, block_bytes + 1)]
        return passes[0] if passes else docs.sparkSession.createDataFrame([], SCHEMA)
    sieve = Sieve(size, budget)
    for index in _blocks(items, budget, block_bytes):
        sieve.add(index)
    shared = docs.sparkSession.sparkContext.broadcast(sieve)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.passes(batch.column(1))))

    some = written(base.mapInArrow(suspects, base.schema), "suspects")
    return reduce(DataFrame.unionByName, [written(_leaks(some, index), "leaks") for index in _blocks(items, budget, block_bytes)])


def decontaminated(docs: DataFrame, benchmark: DataFrame, budget: Budget | None = None, block_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns as they are, without those that leak an item.

    No shuffle for a benchmark of one block; for a larger one leaks are found first, and documents are
    left out by id and hash of the text (equal rows leak alike).
    """
    budget = budget or Budget()
    items, size = _read(benchmark, "item_id", "text")
    if size > block_bytes:
        key = F.xxhash64(docs[id_col].cast("long"), F.xxhash64(docs[text_col].cast("string")))
        gone = written(contaminated(docs.select(key.alias("doc_id"), docs[text_col].alias("text")), benchmark, budget, block_bytes).select("doc_id").distinct(), "gone")
        gone = gone.select(F.col("doc_id").alias("key"))
        same = key == gone["key"]
        return docs.join(F.broadcast(gone) if gone.count() <= SMALL_ROWS else gone, same, "left_anti")
    where = docs.columns.index(text_col)
    out = docs
    for index in _blocks(items, budget, block_bytes + 1):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, *_ in shared.value.find(batch.column(where))]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(scan, docs.schema)
    return out
