"""Substring, suffix-array and SimHash deduplication against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from zonarium.llm import near_copies as nc
from zonarium.llm import simhash_dedup as sh
from zonarium.llm import substring_dedup as sub
from zonarium.llm import suffix_dedup as suf

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = sub.Sketch(width_log2=14, shard_log2=12)
BIG = 1 << 62


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def brute_windows(docs, width=13):
    first = {}
    key = lambda i: BIG if i is None else i
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    for i, w in words:
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            first[x] = min(first.get(x, BIG + 1), key(i))
    out = Counter()
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < key(i):
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[(i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("sketch", [SMALL, sub.Sketch(width_log2=8, shard_log2=6)])
def test_substring_dedup(spark, odd_docs, sketch):
    got = sub.substring_dedup(odd_docs, sketch=sketch, bucket_bytes=20_000).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_windows(rows_of(odd_docs))
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got)


def test_substring_dedup_of_nothing(no_docs):
    assert sub.substring_dedup(no_docs, sketch=SMALL).collect() == []


def test_gap_coding():
    for v in ([], [0], [0, 0, 254, 255, 256, 10_000, 10_000], list(range(0, 5000, 7))):
        a = np.array(v, np.int64)
        assert sub.unpack_gaps(sub.pack_gaps(a)).tolist() == v


def test_sketch_never_underestimates():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 2**63, 3000).astype(np.uint64)
    twice = w[:500]
    count = np.zeros((SMALL.depth, 1 << SMALL.width_log2), int)
    for row in range(SMALL.depth):
        np.add.at(count[row], SMALL.cells(np.concatenate([w, twice]), row), 1)
    often = [np.flatnonzero(count[r] >= 2) for r in range(SMALL.depth)]
    assert set(range(500)) <= set(sub.estimated_repeated(w, often, SMALL).tolist())


def test_sketch_grows_with_the_corpus():
    assert [sub.Sketch().sized(n, 3).width_log2 for n in (0, 10**9, 10**14)] == [20, 30, 46]
    assert sub.Sketch().sized(10**14, 20).shard_log2 == 26
    big = np.sort(np.random.default_rng(1).integers(0, 2**60, 50_000))
    assert sub.unpack_gaps(sub.pack_gaps(big)).tolist() == big.tolist()


def test_long_texts_are_deduplicated(spark):
    """Texts over a slice of 256 KiB: copies, a shifted passage, and no change elsewhere."""
    long = " ".join(f"w{k % 7919}x{k % 31}" for k in range(60_000))
    rows = [(1, long), (2, "intro " + long[200_000:500_000] + " outro"), (3, "other words " * 30_000), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sub.substring_dedup(docs, bucket_bytes=300_000).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_windows(rows)


def brute_bytes(docs, length=200):
    count = Counter()
    raw = [(i, (t or "").encode()) for i, t in docs]
    for _, b in raw:
        count.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = Counter()
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        gone = gone[: len(b)]
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[(i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())] += 1
    return out


@pytest.mark.parametrize("block", [3 << 20, 2_000])
def test_suffix_dedup(odd_docs, block):
    got = suf.suffix_dedup(odd_docs, bucket_bytes=60_000, block_bytes=block).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_bytes(rows_of(odd_docs))


def test_suffix_dedup_of_shared_edges(spark):
    rng = np.random.default_rng(4)
    part = lambda n: "".join(rng.choice(list("abcd "), n))
    shared = [part(n) for n in (199, 200, 201, 350)]
    docs = spark.createDataFrame([(k, part(150) + shared[k % 4] + part(90) + shared[(k + 1) % 4]) for k in range(12)], "doc_id long, text string")
    got = suf.suffix_dedup(docs, bucket_bytes=1_000, block_bytes=1_500).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_bytes(rows_of(docs))


def test_suffix_dedup_of_nothing(no_docs):
    assert suf.suffix_dedup(no_docs).collect() == []


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(20):
        text = rng.integers(97, 100, rng.integers(1, 300)).astype(np.uint8)
        order, rank = suf.suffix_array(text)
        b = text.tobytes()
        assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        assert rank[order].tolist() == list(range(len(b)))
        shared = suf.common_prefixes(text, order, np.array([0]), np.array([len(text)]), 200)
        for k in range(1, len(order)):
            x, y, n = b[order[k - 1] :], b[order[k] :], 0
            while n < min(len(x), len(y)) and x[n] == y[n]:
                n += 1
            assert shared[order[k]] == min(n, 200)


def brute_fingerprint(text, width=4):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    grams = [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize(("hot", "fine_from"), [(1, 1 << 30), (8_000, 1 << 30), (2, 0)])
def test_simhash(odd_docs, hot, fine_from):
    docs = rows_of(odd_docs)
    prints = [brute_fingerprint(t) for _, t in docs]
    near = np.array([[bin(a ^ b).count("1") <= 4 for b in prints] for a in prints])
    label = np.arange(len(docs))
    while True:
        new = np.array([label[near[k]].min() for k in range(len(docs))])
        if (new == label).all():
            break
        label = new
    smallest = {x: min((i for (i, _), y in zip(docs, label, strict=True) if y == x and i is not None), default=None) for x in label}
    want = Counter((i, f"{f:016x}", smallest[x]) for (i, _), f, x in zip(docs, prints, label, strict=True))
    assert Counter(tuple(r) for r in sh.simhash_dedup(odd_docs, hot_anchor=hot, fine_from=fine_from).collect()) == want


def test_simhash_of_nothing(no_docs):
    assert sh.simhash_dedup(no_docs).collect() == []


@pytest.mark.parametrize(("cover", "hot"), [(sh.COARSE, 8_000), (sh.FINE, 8_000), (sh.COARSE, 1)])
def test_every_link_within_four_bits_meets(spark, cover, hot):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 40).astype(np.uint64)
    flipped = base.copy()
    for k in range(40):
        for b in rng.choice(64, k % 5, replace=False):
            flipped[k] ^= np.uint64(1) << np.uint64(b)
    far = flipped ^ np.uint64(0b11111 << 20)
    every = np.unique(np.concatenate([base, flipped, far]))
    df = spark.createDataFrame([(int(x),) for x in every.view(np.int64)], "bits long")
    links = sh.linked(df, 4, cover, hot)
    got = {r["node"]: r["root"] for r in sh.connected(links).collect()}
    signed = every.view(np.int64)
    near = np.bitwise_count(every[:, None] ^ every[None, :]) <= 4
    label = signed.copy()
    while True:
        new = np.array([label[near[k]].min() for k in range(len(every))])
        if (new == label).all():
            break
        label = new
    assert all(got.get(int(x), int(x)) == int(y) for x, y in zip(signed, label, strict=True))


def test_covering_code():
    rng = np.random.default_rng(0)
    for size, coded, radius in ((21, 15, 2), (22, 15, 2), (20, 7, 3)):
        every = np.arange(1 << size)
        code = every[sh._syndrome(every, coded) == 0]
        words = rng.integers(0, 1 << size, 3)
        home = sh.home_anchor(words, coded)
        assert (np.bitwise_count(home ^ words) <= 1).all() and (sh._syndrome(home, coded) == 0).all()
        index, anchor = sh.visited_anchors(words, size, coded, radius)
        for k in range(3):
            assert sorted(anchor[index == k].tolist()) == sorted(code[np.bitwise_count(code ^ words[k]) <= radius].tolist())


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(500, 501)], "a long, b long")
    got = {r["node"]: r["root"] for r in sh.connected(edges).collect()}
    assert all(got[k] == 0 for k in range(1, 101)) and got[501] == 500


def test_one_of_each(spark):
    text = " ".join(f"w{k}" for k in range(200))
    docs = spark.createDataFrame([(3, text, "a"), (5, text, "b"), (5, text, "b"), (7, "quite another text of some words here", "c"), (7, "quite another text of some words here", "c"), (None, "no id", "d")], "doc_id long, text string, x string")
    got = nc.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got.collect()) == [(False, 3), (False, 7), (True, None)]


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    """No text is lost because another row has its id; of equal rows one stays, always the same."""
    long = lambda tag: " ".join(f"{tag}{k}" for k in range(60))
    rows = [(1, long("a"), "x", 1), (1, long("b"), "x", 2), (1, long("b") + " end", "y", 3), (2, long("b"), "z", 4), (2, None, None, 5), (2, "", "e", 6), (3, long("c"), "p", 7), (3, long("c"), "q", 8), (4, "few words", "w", 9), (None, long("c"), "n", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, code string, rows int")
    one, two = (sorted(map(tuple, nc.one_of_each(df).collect()), key=str) for df in (docs, docs.orderBy(F.desc("rows"))))
    assert one == two and nc.one_of_each(docs).columns == docs.columns
    groups = sorted((str(i), (t or "")[:2]) for i, t, *_ in one)
    assert groups == [("1", "a0"), ("1", "b0"), ("2", ""), ("3", "c0"), ("4", "fe"), ("None", "c0")]


def shingles(text, width=5):
    w = [x.lower() for x in WORD.findall(text or "")]
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def test_near_copies_equal_full_comparison(spark):
    rng = np.random.default_rng(6)
    texts = []
    for k in range(30):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200 + 10 * k)]
        texts.append(" ".join(words))
        for share in (0.0, 0.005, 0.015, 0.02, 0.06):
            edited = [f"e{rng.integers(0, 10**6)}" if rng.random() < share else x for x in words]
            texts.append(" ".join(edited).title() if share == 0.0 else "\n".join(edited))
    texts += ["a b c", "A b  c", "b a c", "", "", " \t", None]
    docs = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "doc_id long, text string, kind string")
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or (both and both >= 0.8 * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = sorted({find(k) for k in range(len(texts))})
    got = nc.one_of_each(docs)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == want
    assert nc.one_of_each(docs.limit(0)).collect() == []


def near_links_by_brute_force(texts):
    sets = [shingles(t) for t in texts]
    return {(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}


def components(n, links):
    label = list(range(n))
    for _ in range(n):
        before = list(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def test_variants_of_one_base_are_verified_before_thinning(spark, monkeypatch):
    """Variants of which many pairs fail 0.8: a failing third text costs no link, in one piece or in many; so for reordered words."""
    rng = np.random.default_rng(16)
    base = [f"w{k}" for k in range(250)]
    texts = []
    for k in range(300):
        words = list(base)
        for at in rng.choice(250, 5, replace=False):
            words[at] = f"v{k}x{at}"
        texts.append(" ".join(words))
    swapped = [*base[100:], *base[:100]]
    texts += [" ".join(rng.permutation(base)) for _ in range(20)] + [" ".join(swapped), " ".join([*swapped[:-5], *reversed(swapped[-5:])])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    label = components(len(texts), near_links_by_brute_force(texts))
    want = sorted(set(label))
    assert 20 < len(want) < len(texts)
    for block in (400, 40):
        monkeypatch.setattr(nc, "BLOCK", block, raising=False)
        assert sorted(r["doc_id"] for r in nc.one_of_each(docs).collect()) == want


def test_more_texts_in_a_group_change_no_other_verdict(spark, monkeypatch):
    """A pair without a common band is no pair in a small group either, so a group that outgrows a block keeps its verdicts."""
    words = [f"w{x}" for x in range(120)]
    sets = [np.arange(100, dtype=np.int64), np.arange(2, 102, dtype=np.int64), np.arange(1, 101, dtype=np.int64)]
    apart = np.arange(3 * nc.BANDS, dtype=np.int64).reshape(3, -1)
    alone, tree = np.zeros(3, int), np.arange(3)
    assert nc.verified_links(sets, apart, alone, tree) == []
    shared = apart.copy()
    shared[2, 5] = shared[0, 5]
    assert nc.verified_links(sets, shared, alone, tree) == [(0, 2)]
    rng = np.random.default_rng(21)
    texts = [" ".join(w if rng.random() > 0.02 else f"e{rng.integers(10**6)}" for w in words) for _ in range(60)]
    stay = {}
    for n in (30, 60):
        docs = spark.createDataFrame(list(enumerate(texts[:n])), "doc_id long, text string")
        for block in (400, 8):
            monkeypatch.setattr(nc, "BLOCK", block)
            stay[n, block] = sorted(r["doc_id"] for r in nc.one_of_each(docs).collect())
        assert stay[n, 400] == stay[n, 8]
    assert set(stay[60, 8]) & set(range(30)) <= set(stay[30, 400])


def test_blocks_added_at_the_threshold_are_found():
    """A block added or cut moves word fingerprints far; of pairs at 0.8 to 0.83 at most two in a thousand may be missed."""
    rng = np.random.default_rng(17)
    texts = []
    for k in range(1_000):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 104)]
        block = [f"b{k}x{x}" for x in range(20 + k % 6)]
        texts += [" ".join(words), " ".join([*words, *block] if k % 2 else [*block, *words])]
    a, b = shingles(texts[-2]), shingles(texts[-1])
    assert 0.8 <= len(a & b) / len(a | b) < 0.82
    out = [x for batch in nc._mark(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])])) for x in batch.column(2).to_pylist()]
    assert sum(not set(x) & set(y) for x, y in zip(out[::2], out[1::2], strict=True)) <= 2


def test_long_texts_in_stretches(spark, monkeypatch):
    """Texts beyond a slice, whole or cut into stretches, give what brute force gives."""
    long = " ".join(f"w{k % 7919}x{k % 31}" for k in range(45_000))
    rows = [(1, long), (2, "intro " + long[100_000:160_000] + " outro"), (3, "ab" * 400), (4, None)]
    want = brute_bytes(rows)
    data = [(t or "").encode() for _, t in rows]
    off = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    raw = np.frombuffer(b"".join(data), np.uint8)
    whole = suf._pieces(off, raw)
    monkeypatch.setattr(suf, "STRETCH", 70_001)
    cut = suf._pieces(off, raw)
    strings = lambda p: {(int(s) + k, int(a)) for s, n, a in zip(p.start, p.strings, p.anchor, strict=True) for k in range(int(n))}
    assert strings(whole) == strings(cut) and len(cut.start) > len(whole.start)
    monkeypatch.undo()
    got = suf.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), bucket_bytes=200_000).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def test_a_hot_anchor_is_held_piece_by_piece():
    """One anchor in many pieces: what is held does not grow with their number."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from zonarium.llm.simhash_dedup import _compare

    def batches(pieces, rows=4_000):
        rng = np.random.default_rng(3)
        for piece in range(pieces):
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(rows, np.int64)), pa.array(np.full(rows, piece, np.int32)), pa.array(rng.integers(-(2**63), 2**63, rows)), pa.array(np.arange(rows) < 5)], ["anchor", "piece", "bits", "lives"])

    peaks = []
    for pieces in (10, 80):
        tracemalloc.start()
        for _ in _compare(4)(batches(pieces)):
            pass
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]
