"""SimHash near-duplicates by anchor-point covering.

A document's 64-bit fingerprint is the majority vote over the XXH64 values of its word shingles.
Two fingerprints link when they differ in at most ``threshold`` bits.

*Covering.*  One code over all 64 bits with radius R needs each fingerprint at V(R+4)/V(R) anchors at
least, V being the volume of a ball; that is 742 for R = 8 and still 40 for R = 16, where an anchor
sees a thousandth of all fingerprints.  So the bits are cut into p parts: if two fingerprints differ in at most
``threshold`` bits, then in one part they differ in at most threshold // p.  Over each part a covering code of radius 1
serves as the set of anchors: a perfect Hamming code on some bits times all words of the other bits.  A fingerprint
*lives* at the anchor that covers it and *visits* every anchor within 1 + threshold // p of it, so the two fingerprints
of a link meet where either lives.  Two codes are at hand, and the count of distinct fingerprints chooses:

* ``COARSE``: three parts (21, 21, 22 bits), code on 15 bits: some 45 visits, and an anchor sees the 2^17th of a part.
* ``FINE``: two parts of 32 bits, code on 31 bits: some 340 visits, and an anchor sees the 2^27th.  Comparisons grow with
  the square of the fingerprints, a hundred times slower than with the other; past ``FINE_FROM`` that outweighs the visits.

*Comparison.*  Each anchor compares those that live there with its visitors, in blocks of numpy
rows, and returns a spanning forest of the links found, never all pairs.  An anchor with
more than ``hot_anchor`` residents is cut into pieces of a share of the residents and a share of the visitors,
so what a task holds is bounded.

*Components.*  Links between distinct fingerprints are joined into components by alternating
large-star and small-star rounds on written tables, until nothing changes.

Edge cases: null and empty texts, and texts without words, have fingerprint zero and link like any
other; repeated rows and ids share a fingerprint; a null id never becomes a component's name
unless the component has no other; an empty table gives an empty result; very long texts are
hashed whole in bounded slices; only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonarium.llm import textbatch as tb
from zonarium.sources.scratch import materialised as written

@dataclass(frozen=True)
class Cover:
    """Parts of the fingerprint (first bit, bits), and how many low bits of each part have a Hamming code (one less than a power of two)."""

    parts: tuple[tuple[int, int], ...]
    coded: int


COARSE = Cover(((0, 21), (21, 21), (42, 22)), 15)
FINE = Cover(((0, 32), (32, 32)), 31)
#: From so many distinct fingerprints on the finer code costs less.
FINE_FROM = 1 << 30
SHINGLES_AT_ONCE = 1 << 15
#: A table counted to have no more rows than this is broadcast.
SMALL_ROWS = 100_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """Majority bits over the XXH64 values of the text's ``width``-word shingles; zero without words."""
    from xxhash import xxh64_intdigest as xxh64

    words = text.translate(_LOWER.tobytes()).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        n, hashes = 1, np.array([xxh64(line, seed)], np.uint64)
        return int(hashes[0])
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    votes = np.zeros(64, np.int64)
    begin, stop = starts[:n].tolist(), ends[width - 1 :].tolist()
    for k in range(0, n, SHINGLES_AT_ONCE):
        part = [xxh64(line[a:b], seed) for a, b in zip(begin[k : k + SHINGLES_AT_ONCE], stop[k : k + SHINGLES_AT_ONCE], strict=True)]
        votes += _bit_votes(np.array(part, np.uint64))
    bits = np.packbits(2 * votes > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def _bit_votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the values have each bit set, lowest bit first."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``doc_id`` and ``bits`` (the fingerprint as a signed long) of each document; a pure map."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, raw = tb.utf8(batch.column(1))
            data = raw.tobytes()
            bits = np.array([fingerprint(data[a:b], width) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64), pa.int64())], ["doc_id", "bits"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, "doc_id long, bits long")


# --- covering code -------------------------------------------------------------------------------


def _syndrome(words: np.ndarray, coded: int) -> np.ndarray:
    """Hamming syndrome of the low ``coded`` bits: the exclusive or of the set positions, counted from 1."""
    out = np.zeros(len(words), np.int64)
    for k in range(coded):
        out ^= ((words >> k) & 1) * (k + 1)
    return out


def home_anchor(part: np.ndarray, coded: int) -> np.ndarray:
    """The codeword that covers each word: its coded bits corrected, the other bits as they are."""
    s = _syndrome(part, coded)
    return np.where(s > 0, part ^ (np.int64(1) << np.maximum(s - 1, 0)), part)


@lru_cache
def _flips(size: int, coded: int, radius: int) -> dict[int, np.ndarray]:
    """By syndrome: every change of at most ``radius`` of ``size`` bits that has it, which takes words of that syndrome to codewords."""
    out: dict[int, list[int]] = {}
    for n in range(radius + 1):
        for bits in combinations(range(size), n):
            s = 0
            for b in bits:
                s ^= b + 1 if b < coded else 0
            out.setdefault(s, []).append(sum(1 << b for b in bits))
    return {s: np.array(masks, np.int64) for s, masks in out.items()}


def visited_anchors(part: np.ndarray, size: int, coded: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All anchors within ``radius`` of each word: (index of the word, anchor)."""
    s = _syndrome(part, coded)
    index, anchor = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for value, masks in _flips(size, coded, radius).items():
        at = np.flatnonzero(s == value)
        index.append(np.repeat(at, len(masks)))
        anchor.append((part[at][:, None] ^ masks[None, :]).ravel())
    return np.concatenate(index), np.concatenate(anchor)


def _parts(bits: np.ndarray, cover: Cover) -> Iterator[tuple[np.int64, int, np.ndarray]]:
    """For each part: its mark in the anchors' keys, its size and the fingerprints' words."""
    for k, (low, size) in enumerate(cover.parts):
        yield np.int64(k) << 32, size, ((bits.view(np.uint64) >> np.uint64(low)) & np.uint64((1 << size) - 1)).astype(np.int64)


def _seats(cover: Cover, radius: int):
    """Every distinct fingerprint at every anchor that it visits, and whether it lives there."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(0).to_numpy().astype(np.int64)
            for i in range(0, len(bits), 5_000):
                some = bits[i : i + 5_000]
                for mark, size, part in _parts(some, cover):
                    index, anchor = visited_anchors(part, size, cover.coded, radius)
                    lives = home_anchor(part, cover.coded)[index] == anchor
                    yield pa.RecordBatch.from_arrays([pa.array(mark | anchor), pa.array(some[index]), pa.array(lives)], ["anchor", "bits", "lives"])

    return scan


def _homes(cover: Cover):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mark, _, part in _parts(batch.column(0).to_numpy().astype(np.int64), cover):
                yield pa.RecordBatch.from_arrays([pa.array(mark | home_anchor(part, cover.coded))], ["anchor"])

    return scan


def linked(fingerprints_: DataFrame, threshold: int, cover: Cover = COARSE, hot_anchor: int = 8_000) -> DataFrame:
    """Links (a, b) of 1 to ``threshold`` bits among distinct ``bits``, less those that close a cycle at an anchor."""
    prints = fingerprints_.select("bits")
    hot = (
        prints.mapInArrow(_homes(cover), "anchor long").groupBy("anchor").count().where(F.col("count") > hot_anchor)
        .select("anchor", F.ceil(F.col("count") / hot_anchor).cast("int").alias("cuts"))
    )
    seats = prints.mapInArrow(_seats(cover, 1 + threshold // len(cover.parts)), "anchor long, bits long, lives boolean")
    if hot.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        hot = F.broadcast(hot)
    cuts = F.coalesce("cuts", F.lit(1))
    home, guest = F.pmod(F.xxhash64("bits"), cuts), F.pmod(F.xxhash64("bits", F.lit(1)), cuts)  # the share of residents and of visitors one is in
    # piece (i, j) of an anchor holds the residents of share i and the visitors of share j: a seat is in a row of pieces if it lives there, and in a column
    every = F.sequence(F.lit(0), cuts - 1)
    row = F.when(F.col("lives"), F.transform(every, lambda j: (home * cuts + j).cast("int"))).otherwise(F.array().cast("array<int>"))
    column = F.transform(every, lambda i: (i * cuts + guest).cast("int"))
    seats = (
        seats.join(hot, "anchor", "left")
        .withColumn("piece", F.explode(F.array_distinct(F.concat(row, column))))
        .select("anchor", "piece", "bits", (F.col("lives") & (home == F.floor(F.col("piece") / cuts))).alias("lives"))
    )
    return seats.repartition("anchor", "piece").sortWithinPartitions("anchor", "piece").mapInArrow(_compare(threshold), "a long, b long")


def linked_prints(classes: DataFrame, threshold: int, hot_anchor: int = 8_000, fine_from: int = FINE_FROM) -> DataFrame:
    """Links among distinct ``bits`` by the code that costs less for so many of them."""
    return linked(classes, threshold, FINE if classes.count() >= fine_from else COARSE, hot_anchor)


def _distance(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Differing bits of every pair (bitwise_count takes absolute values, so the view is unsigned)."""
    return np.bitwise_count(left.view(np.uint64)[:, None] ^ right.view(np.uint64)[None, :])


def spanning_links(homes: np.ndarray, guests: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links (of 1 to ``threshold`` bits) between homes and guests, less those that close a cycle.

    Homes are taken in blocks that start small and grow: links inside a tree already found are
    dropped by comparing tree numbers in numpy, so a large group costs one Python step a member.
    """
    nodes, index = np.unique(np.concatenate([homes, guests]), return_inverse=True)
    home, guest = index[: len(homes)], index[len(homes) :]
    tree = np.arange(len(nodes))
    out: list[tuple[int, int]] = []
    i, step = 0, 1
    most = max(1, (1 << 20) // max(1, len(guests)))
    while i < len(home):
        block = home[i : i + step]
        near = _distance(nodes[block], nodes[guest]) <= threshold
        near &= tree[block][:, None] != tree[guest][None, :]
        x, y = np.nonzero(near)
        i, step = i + step, min(2 * step, most)
        if not len(x):
            continue
        _, one = np.unique(tree[block[x]] * len(nodes) + tree[guest[y]], return_index=True)
        up: dict[int, int] = {}

        def find(t: int, up: dict[int, int] = up) -> int:
            while t in up:
                t = up[t]
            return t

        for k in one.tolist():
            a, b = int(block[x[k]]), int(guest[y[k]])
            s, t = find(int(tree[a])), find(int(tree[b]))
            if s != t:
                up[max(s, t)] = min(s, t)
                out.append((int(nodes[a]), int(nodes[b])))
        renamed = np.arange(len(nodes))
        for t in up:
            renamed[t] = find(t)
        tree = renamed[tree]
    return out


def _compare(threshold: int):
    """Links of each anchor (and piece) as a spanning forest; rows arrive sorted by both."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def links(anchor: np.ndarray, piece: np.ndarray, bits: np.ndarray, lives: np.ndarray) -> pa.RecordBatch:
            bounds = np.concatenate([[0], np.flatnonzero((np.diff(anchor) != 0) | (np.diff(piece) != 0)) + 1, [len(anchor)]])
            some = np.add.reduceat(lives.astype(np.int64), bounds[:-1]) if len(anchor) else np.zeros(0, int)
            found: list[tuple[int, int]] = []
            for k in np.flatnonzero((np.diff(bounds) > 1) & (some > 0)):
                guests = bits[bounds[k] : bounds[k + 1]]
                homes = guests[lives[bounds[k] : bounds[k + 1]]]
                near = _distance(homes, guests) <= threshold if len(homes) * len(guests) < 1 << 16 else None
                if near is None or near.sum() > len(homes):  # more than each with itself
                    found += spanning_links(homes, guests, threshold)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        for batch in batches:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)])
            first, last = held[0], held[-1]
            if not len(last[0]):
                held.pop()
                continue
            if (first[0][0], first[1][0]) != (last[0][-1], last[1][-1]):
                anchor, piece, bits, lives = (np.concatenate(x) for x in zip(*held, strict=True))
                at = int(np.flatnonzero((np.diff(anchor) != 0) | (np.diff(piece) != 0))[-1]) + 1  # up to here all pieces are whole
                yield links(anchor[:at], piece[:at], bits[:at], lives[:at])
                held = [[anchor[at:], piece[at:], bits[at:], lives[at:]]]
        if held:
            yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return scan


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its component.

    Alternates large-star (every larger neighbour of a node is linked to its smallest) and
    small-star (every smaller one) until a round changes nothing.  Each round is two aggregations
    and two joins on tables of at most as many rows as there are links.
    """
    links = written(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).select("a", "b").distinct(), "links")

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = signature(links)
    for _ in range(rounds):
        if not before[0]:
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small_least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(small_least.select("a", F.col("m").alias("b"))).distinct()
        links = written(small, "links")
        after = signature(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def simhash_dedup(docs: DataFrame, threshold: int = 4, hot_anchor: int = 8_000, id_col: str = "doc_id", text_col: str = "text", fine_from: int = FINE_FROM) -> DataFrame:
    """One row per document: fingerprint (16 hex digits) and the smallest id of its component."""
    marked = written(fingerprints(docs, id_col, text_col), "fingerprints")
    # a hot fingerprint is one row here: the aggregation combines before the shuffle
    classes = written(marked.groupBy("bits").agg(F.min("doc_id").alias("first")), "classes")
    links = linked_prints(classes, threshold, hot_anchor, fine_from)
    roots = connected(links)
    named = classes.join(roots, classes["bits"] == roots["node"], "left").select("bits", "first", F.coalesce("root", "bits").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_class = named.join(least, "root").select("bits", "component_id")
    return (
        marked.join(by_class, "bits")
        .select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
    )


