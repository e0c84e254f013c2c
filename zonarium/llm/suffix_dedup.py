"""Exact removal of repeated 200-byte strings with suffix arrays.

A byte goes when a ``length``-byte string covering it also starts anywhere else.  The plan:

1. *Sharding.*  Every 200-byte string is filed under its anchor: the 100-byte gram of smallest hash
   among its 101 grams (the leftmost of equals).  Equal strings have equal anchors, so a shard, a
   range of anchor hashes, sees all occurrences of its strings.  Runs of strings with one anchor are
   shipped as one piece of at most 300 bytes.  Anchors that occur once are dropped first: an
   exact exchange of anchor hashes, one bit a hash coming back, tells which occur again.
2. *Suffix arrays.*  A shard lays its distinct pieces end to end and builds their suffix array by
   Larsson-Sadakane refinement in numpy: sort by eight bytes, then double the depth by sorting only
   groups not yet single, by the rank that stands half the depth further on.
3. *Common prefixes.*  Kasai's pass gives each suffix the length it shares with its predecessor;
   it runs over all pieces in step, carrying the length less one from position to position.
4. *Merging.*  A shard above ``block_bytes`` is cut into blocks with a suffix array each (between
   anchors where possible).  Blocks that share an anchor are merged by binary search of the
   strings of one in the suffix array of the other.
5. *Removal.*  One bit a string comes back to the documents.

Copies of a piece inside a bucket of documents are shipped once, so a passage that stands in a third
of all documents costs one piece a bucket.

Edge cases: null text counts as empty; texts shorter than ``length`` are kept; equal rows remove one
another's strings, as they start elsewhere; null ids are carried through; an empty table gives an
empty result; texts are handled whole with memory in proportion; other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonarium.llm import textbatch as tb
from zonarium.llm.substring_dedup import _shard_cuts

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
LENGTH, GRAM = 200, 100
_PLACE_BITS = np.uint64(28)
_PLACE = np.uint64((1 << 28) - 1)
#: Longer texts are cut into overlapping stretches of so many bytes, so that places fit their bits.
STRETCH = 1 << 27
_NONE = np.uint64(2**64 - 1)
_END = 0xFF  # no byte of UTF-8


# --- anchors -------------------------------------------------------------------------------------


@dataclass
class _Pieces:
    """Runs of strings with one anchor, over the bytes of a bucket."""

    start: np.ndarray
    strings: np.ndarray  # how many strings start in the run
    anchor: np.ndarray  # 64-bit hash of the anchor gram
    text: np.ndarray  # 64-bit hash of the run's bytes


def _empty() -> _Pieces:
    return _Pieces(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _pieces_of_slice(off: np.ndarray, raw: np.ndarray) -> _Pieces:
    n = len(raw)
    last = np.repeat(off[1:], np.diff(off))  # where the text of each byte ends
    if n < LENGTH:
        return _empty()
    up, down = tb.powers(tb.BYTE_MULTIPLIER, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(tb.BYTE_CODES[raw] * up[:n], out=total[1:])
    grams = tb.mix64((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    place = np.arange(n - GRAM + 1, dtype=np.uint64)
    least = (grams & ~_PLACE) | (place & _PLACE)
    least[place.astype(np.int64) + GRAM > last[: n - GRAM + 1]] = _NONE
    span, width = 1, LENGTH - GRAM + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        shift = width - span
        least = np.minimum(least[:-shift], least[shift:])
    whole = np.flatnonzero(np.arange(len(least)) + LENGTH <= last[: len(least)])
    if not len(whole):
        return _empty()
    at = (least[whole] & _PLACE).astype(np.int64)
    new = np.ones(len(whole), bool)
    new[1:] = (at[1:] != at[:-1]) | (whole[1:] != whole[:-1] + 1)
    head = np.flatnonzero(new)
    strings = np.diff(np.append(head, len(whole)))
    start = whole[head]
    stop = start + strings + LENGTH - 1
    text = tb.mix64((total[stop] - total[start]) * down[start] + tb.mix64((stop - start).astype(np.uint64)))
    # anchors are minima, so their hashes crowd at the low end; hashed again they spread over the shards
    return _Pieces(start, strings, tb.mix64(grams[at[head]] ^ np.uint64(0x2545F4914F6CDD1D)), text)


def _pieces(off: np.ndarray, raw: np.ndarray) -> _Pieces:
    parts = []
    for i, j in tb.slices(off):
        begin, end = int(off[i]), int(off[j])
        if end - begin <= STRETCH:
            p = _pieces_of_slice(off[i : j + 1] - begin, raw[begin:end])
            p.start = p.start + begin
            parts.append(p)
            continue
        for a in range(begin, end, STRETCH):  # one text too long for a place: strings that start in each stretch
            b = min(end, a + STRETCH + LENGTH - 1)
            p = _pieces_of_slice(np.array([0, b - a]), raw[a:b])
            p.start = p.start + a
            parts.append(p)
    if not parts:
        return _empty()
    return _Pieces(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("start", "strings", "anchor", "text")))


# --- suffix arrays -------------------------------------------------------------------------------


def _eight(text: np.ndarray, order: str) -> np.ndarray:
    """The eight bytes from every position (past the end: zeros) as one number."""
    data = text.tobytes() + bytes(8)
    return np.ndarray((len(text),), order + "u8", data, strides=(1,)).astype(np.uint64)


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and the rank of each position.

    Larsson-Sadakane: a rank is the place of the first suffix of its group; each round sorts only
    the groups with several suffixes, by the rank that their suffixes have half the new depth on.
    It goes on until all groups are single, as Kasai's bound holds for a complete order only.
    """
    n = len(text)
    key = _eight(text, ">")
    order = np.argsort(key).astype(np.int32)
    ranked = key[order]
    head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    size = np.diff(np.append(head, n))
    rank = np.empty(n + 1, np.int32)
    rank[order] = np.repeat(head, size).astype(np.int32)
    rank[n] = -1
    del key, ranked
    open_ = np.repeat(size > 1, size).nonzero()[0]
    h = 8
    while len(open_):
        suffix = order[open_]
        further = np.minimum(suffix.astype(np.int64) + h, n)
        both = (rank[suffix].astype(np.int64) << 32) | (rank[further].astype(np.int64) + 1)
        by = np.argsort(both, kind="stable")
        both, suffix = both[by], suffix[by]
        order[open_] = suffix
        first = np.concatenate([[True], both[1:] != both[:-1]])
        heads = np.flatnonzero(first)
        size = np.diff(np.append(heads, len(both)))
        rank[suffix] = np.repeat(open_[heads], size).astype(np.int32)
        open_ = open_[np.repeat(size > 1, size)]
        h *= 2
    return order, rank[:n]


def common_prefixes(text: np.ndarray, order: np.ndarray, start: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """For every position of the pieces: bytes shared with its predecessor in the order (up to ``most``).

    Kasai: position i + 1 shares at least one byte less than position i.  The pieces advance in step.
    """
    n = len(text)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    eight = _eight(text, "<")
    out = np.zeros(n, np.int16)
    lane = np.argsort(-size, kind="stable")
    start, size = start[lane], size[lane]
    carry = np.zeros(len(start), np.int64)
    for k in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -k, side="left"))
        i = start[:live] + k
        j = before[i].astype(np.int64)
        h = np.maximum(carry[:live] - 1, 0)
        h[j < 0] = 0
        go = np.flatnonzero((j >= 0) & (h < most))
        while len(go):
            a, b = i[go] + h[go], j[go] + h[go]
            fits = (a < n) & (b < n)
            go, a, b = go[fits], a[fits], b[fits]
            differ = eight[a] ^ eight[b]
            same = differ == 0
            low = differ & (~differ + np.uint64(1))
            h[go] += np.where(same, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) >> 3)
            go = go[same & (h[go] < most)]
        out[i] = np.minimum(h, most)
        carry[:live] = h
    return out


def _joined(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    text = np.frombuffer(bytes([_END]).join(pieces) + bytes([_END]), np.uint8)
    start = np.cumsum(size + 1) - (size + 1)
    return text, start, size


@dataclass
class _Block:
    """A suffix array over some pieces, and which positions start a repeated string."""

    text: np.ndarray
    start: np.ndarray
    size: np.ndarray
    order: np.ndarray
    repeated: np.ndarray


def _block(pieces: list[bytes]) -> _Block:
    text, start, size = _joined(pieces)
    order, _ = suffix_array(text)
    shared = common_prefixes(text, order, start, size, LENGTH)
    hit = np.flatnonzero(shared >= LENGTH)
    before = np.full(len(text), -1, np.int64)
    before[order[1:]] = order[:-1]
    repeated = np.zeros(len(text), bool)
    repeated[hit] = True
    repeated[before[hit]] = True
    return _Block(text, start, size, order, repeated)


def _merge(a: _Block, b: _Block) -> None:
    """Mark strings of one block that start in the other: binary search in its suffix array."""
    at = np.concatenate([np.arange(s, s + n - LENGTH + 1) for s, n in zip(a.start, a.size, strict=True)])
    wide = lambda t: _eight(t, ">")
    ta, tb_ = wide(a.text), wide(b.text)
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(b.order), np.int64)

    def compare(q: np.ndarray, p: np.ndarray) -> np.ndarray:
        """-1, 0, 1: the string at q in a against the suffix at p in b."""
        out = np.zeros(len(q), np.int8)
        left = np.arange(len(q))
        for w in range(0, LENGTH, 8):
            qa = ta[np.minimum(q[left] + w, len(ta) - 1)]
            pb = np.where(p[left] + w < len(tb_), tb_[np.minimum(p[left] + w, len(tb_) - 1)], 0)
            out[left] = (qa > pb).astype(np.int8) - (qa < pb).astype(np.int8)
            left = left[qa == pb]
            if not len(left):
                break
        return out

    while np.any(low < high):
        live = np.flatnonzero(low < high)
        mid = (low[live] + high[live]) // 2
        up = compare(at[live], b.order[mid].astype(np.int64)) > 0
        low[live[up]] = mid[up] + 1
        high[live[~up]] = mid[~up]
    inside = np.flatnonzero(low < len(b.order))
    found = inside[compare(at[inside], b.order[low[inside]].astype(np.int64)) == 0]
    a.repeated[at[found]] = True


def repeated_strings(pieces: list[bytes], anchors: np.ndarray, block_bytes: int) -> list[np.ndarray]:
    """For each distinct piece, which of its strings start elsewhere among the pieces (sorted by anchor)."""
    size = np.fromiter((len(p) + 1 for p in pieces), np.int64, len(pieces))
    blocks: list[tuple[int, int]] = []
    i = 0
    while i < len(pieces):
        total, j, cut = 0, i, i
        while j < len(pieces) and (total + size[j] <= block_bytes or j == i):
            total += int(size[j])
            j += 1
            if j == len(pieces) or anchors[j] != anchors[j - 1]:
                cut = j
        j = cut if cut > i else j
        blocks.append((i, j))
        i = j
    built = [_block(pieces[a:b]) for a, b in blocks]
    for x, (a, b) in enumerate(blocks):
        for y in range(x + 1, len(blocks)):
            if anchors[blocks[y][0]] != anchors[b - 1]:
                break
            _merge(built[x], built[y])
            _merge(built[y], built[x])
    return [blk.repeated[s : s + n - LENGTH + 1] for blk in built for s, n in zip(blk.start, blk.size, strict=True)]


# --- the operator --------------------------------------------------------------------------------


def _column(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name).combine_chunks()
    return c.chunk(0) if isinstance(c, pa.ChunkedArray) else c


def _bits_by_shard(right: pa.Table, cuts: np.ndarray) -> np.ndarray:
    out = np.zeros(int(cuts[-1]), bool)
    for shard, flags in zip(right.column("shard").to_pylist(), right.column("flags").to_pylist(), strict=True):
        n = int(cuts[shard + 1] - cuts[shard])
        out[cuts[shard] : cuts[shard + 1]] = np.unpackbits(np.frombuffer(flags, np.uint8), count=n).astype(bool)
    return out


@dataclass
class _Candidates:
    """Distinct pieces of a bucket whose anchor occurs again, sorted by anchor and text."""

    off: np.ndarray
    raw: np.ndarray
    start: np.ndarray  # of every candidate piece, sorted
    strings: np.ndarray
    which: np.ndarray  # its number among the distinct ones
    first: np.ndarray  # index of the first candidate of each distinct piece
    twice: np.ndarray  # distinct pieces that occur twice or more here
    anchor: np.ndarray  # of each distinct piece


def _candidates(docs: pa.Table, again: pa.Table, shards_log2: int) -> _Candidates:
    off, raw = tb.utf8(_column(docs, "text"))
    p = _pieces(off, raw)
    distinct, number = np.unique(p.anchor, return_inverse=True)
    keep = np.flatnonzero(_bits_by_shard(again, _shard_cuts(distinct, shards_log2))[number])
    keep = keep[np.lexsort((p.text[keep], p.anchor[keep]))]
    anchor, text = p.anchor[keep], p.text[keep]
    new = np.ones(len(keep), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return _Candidates(off, raw, p.start[keep], p.strings[keep], np.cumsum(new) - 1, first, np.diff(np.append(first, len(keep))) > 1, anchor[first])


def suffix_dedup(docs: DataFrame, bucket_bytes: int = 6 << 20, block_bytes: int = 3 << 20, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: bytes, removed bytes, removed runs, and what is left."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    shards_log2 = int(buckets).bit_length()
    dealt = base.withColumn("bucket", F.expr(f"cast(pmod(xxhash64(doc_id, text), {buckets}) as int)")).repartition(buckets, "bucket")

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        """The distinct anchors of a bucket, and which of them occur twice in it."""
        p = _pieces(*tb.utf8(_column(table, "text")))
        anchor, count = np.unique(p.anchor, return_counts=True)
        cuts = _shard_cuts(anchor, shards_log2)
        rows = [(int(k), anchor[cuts[k] : cuts[k + 1]].tobytes(), np.packbits(count[cuts[k] : cuts[k + 1]] > 1).tobytes()) for k in np.flatnonzero(np.diff(cuts))]
        shard, hashes, twice = map(list, zip(*rows, strict=True)) if rows else ([], [], [])
        return pa.table({"shard": pa.array(shard, pa.int32()), "bucket": pa.array([key[0].as_py()] * len(shard), pa.int32()), "hashes": pa.array(hashes, pa.binary()), "twice": pa.array(twice, pa.binary())})

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        """Which anchors of each bucket occur again."""
        hashes = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)).astype(bool) for x, h in zip(table.column("twice").to_pylist(), hashes, strict=True)])
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], np.diff(every[order]) != 0]))
        size = np.diff(np.append(head, len(every)))
        often = (size > 1) | np.logical_or.reduceat(twice[order], head)
        again = np.empty(len(every), bool)
        again[order] = np.repeat(often, size)
        return _answers(key, table, hashes, again)

    def _answers(key: tuple, table: pa.Table, parts: list[np.ndarray], flags: np.ndarray) -> pa.Table:
        out, at = [], 0
        for bucket, part in zip(table.column("bucket").to_pylist(), parts, strict=True):
            some = flags[at : at + len(part)]
            at += len(part)
            if some.any():
                out.append((bucket, np.packbits(some).tobytes()))
        return pa.table({"bucket": pa.array([x for x, _ in out], pa.int32()), "shard": pa.array([key[0].as_py()] * len(out), pa.int32()), "flags": pa.array([x for _, x in out], pa.binary())})

    def ship(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """Distinct pieces with anchors that occur again."""
        c = _candidates(left, right, shards_log2)
        cuts = _shard_cuts(c.anchor, shards_log2)
        data = c.raw.tobytes()
        rows = []
        for k in np.flatnonzero(np.diff(cuts)):
            some = slice(int(cuts[k]), int(cuts[k + 1]))
            size = c.strings[c.first[some]] + LENGTH - 1
            body = b"".join(data[a : a + n] for a, n in zip(c.start[c.first[some]].tolist(), size.tolist(), strict=True))
            rows.append((int(k), body, size.astype(np.uint16).tobytes(), c.anchor[some].tobytes(), np.packbits(c.twice[some]).tobytes()))
        cols = list(map(list, zip(*rows, strict=True))) if rows else [[], [], [], [], []]
        bucket = next((x for x in (left, right) if len(x)), left).column("bucket")
        return pa.table(
            {"shard": pa.array(cols[0], pa.int32()), "bucket": pa.array([bucket[0].as_py()] * len(rows) if rows else [], pa.int32()), "body": pa.array(cols[1], pa.binary()), "size": pa.array(cols[2], pa.binary()), "anchors": pa.array(cols[3], pa.binary()), "twice": pa.array(cols[4], pa.binary())}
        )

    def judge(key: tuple, table: pa.Table) -> pa.Table:
        """Which strings of each shipped piece start elsewhere."""
        number: dict[bytes, int] = {}
        often: list[bool] = []
        anchor_of: list[int] = []
        sent: list[list[int]] = []
        for body, size, anchors, twice in zip(*(table.column(c).to_pylist() for c in ("body", "size", "anchors", "twice")), strict=True):
            sizes = np.frombuffer(size, np.uint16)
            ends = np.cumsum(sizes, dtype=np.int64).tolist()
            double = np.unpackbits(np.frombuffer(twice, np.uint8), count=len(sizes)).tolist()
            mine, at = [], 0
            for end, d, anchor in zip(ends, double, np.frombuffer(anchors, np.uint64).tolist(), strict=True):
                piece = body[at:end]
                at = end
                k = number.get(piece)
                if k is None:
                    k = number[piece] = len(often)
                    often.append(bool(d))
                    anchor_of.append(anchor)
                else:
                    often[k] = True
                mine.append(k)
            sent.append(mine)
        pieces = list(number)
        anchors = np.array(anchor_of, np.uint64)
        _, inverse, count = np.unique(anchors, return_inverse=True, return_counts=True)
        mixed = np.flatnonzero(count[inverse] > 1)  # anchors with different surroundings: strings may be shared in part
        mixed = mixed[np.argsort(anchors[mixed], kind="stable")]
        flags: list[np.ndarray | None] = [None] * len(pieces)
        for k, found in zip(mixed.tolist(), repeated_strings([pieces[k] for k in mixed.tolist()], anchors[mixed], block_bytes), strict=True):
            flags[k] = found
        for k, piece in enumerate(pieces):
            if often[k]:
                flags[k] = np.ones(len(piece) - LENGTH + 1, bool)
            elif flags[k] is None:
                flags[k] = np.zeros(len(piece) - LENGTH + 1, bool)
        out = [np.concatenate([flags[k] for k in mine]) for mine in sent]
        return _answers(key, table, out, np.concatenate(out))

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        again = right.filter(pa.compute.equal(right.column("round"), 0))
        judged = right.filter(pa.compute.equal(right.column("round"), 1))
        c = _candidates(left, again, shards_log2)
        n = len(c.raw)
        strings = c.strings[c.first]
        bounds = np.concatenate([[0], np.cumsum(strings)])
        cuts = bounds[_shard_cuts(c.anchor, shards_log2)]
        flags = _bits_by_shard(judged, cuts)
        # the strings of every candidate piece, looked up in its distinct piece
        size = c.strings
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        hit = flags[np.repeat(bounds[c.which], size) + inner]
        gone = tb.covered(n, (np.repeat(c.start, size) + inner)[hit], LENGTH)
        removed = tb.per_text(gone, c.off)
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        edge = c.off[:-1][c.off[:-1] < n]
        begins[edge] = gone[edge]
        spans = tb.per_text(begins, c.off)
        kept = c.raw[~gone].tobytes()
        left_off = np.concatenate([[0], np.cumsum(np.diff(c.off) - removed)]).tolist()
        rest = [kept[a:b] for a, b in zip(left_off[:-1], left_off[1:], strict=True)]
        return pa.table(
            {
                "doc_id": left.column("doc_id"),
                "n_bytes": pa.array(np.diff(c.off)),
                "n_removed": pa.array(removed),
                "n_spans": pa.array(spans),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in rest], pa.string()),
                "kept": pa.array(rest if with_text else [None] * len(rest), pa.binary()),
            }
        )

    flagged = "bucket int, shard int, flags binary"
    again = dealt.groupBy("bucket").applyInArrow(ask, "shard int, bucket int, hashes binary, twice binary").groupBy("shard").applyInArrow(answer, flagged)
    shipped = dealt.groupBy("bucket").cogroup(again.groupBy("bucket")).applyInArrow(ship, "shard int, bucket int, body binary, size binary, anchors binary, twice binary")
    judged = shipped.groupBy("shard").applyInArrow(judge, flagged)
    answers = again.withColumn("round", F.lit(0)).unionByName(judged.withColumn("round", F.lit(1)))
    return dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(apply, SCHEMA)
