"""Near copies for the pipeline: SimHash fingerprints that link, and pairs found by MinHash bands and verified on five-word shingles.

*Fingerprints.*  Texts whose fingerprints (``simhash_dedup``) differ in at most ``BITS`` bits are near copies, found at the
anchors of its covering code; texts of one fingerprint hang on the least class of them.  Two texts of similarity 0.8 differ in
some ten bits, so these are joined by what the bands find besides.

*Bands.*  Two documents are near copies, too, if they are candidates and the Jaccard similarity of their sets of five-word shingles
is 0.8 or more.  *Candidates* agree in all five least hashes of one of 24 bands.  At similarity s a pair agrees in none
with chance (1 - s^5)^24, whatever the edits are (spread, or a block added or cut): seven in a hundred thousand at
exactly 0.8, while texts that share a third agree in one with 9 %.  Texts that agree, directly or through others,
form a group, found from one link a text and band.

*Verification.*  A group of up to ``BLOCK`` texts is compared in one place: every pair of candidates that verified links do not
join yet is compared on its whole sets, and only verified links are returned, as a forest.  What counts as a pair does not depend on
the group's size, which only says where the pairs meet.  A larger group is dealt into blocks, each
of which is compared with a few texts of the group that stand in every block (``GUIDES``): variants of
one text are one tree after that.  What is left are bands whose texts stand in several trees; there, and nowhere else, texts
of different trees are compared, in pieces of two blocks if there are many.  So the work on a large group grows with its texts and
with the candidates that are not joined yet, not with the square of its texts; thousands of variants of one text give one
link each, and no link is lost by a failing third text.  Copies of one word sequence are one class throughout, so thousands of
copies are one row in every step after the first.

Of a group the row with the smallest id stays, of rows with one id the one whose text has the smaller hash, of
rows with one id and text the one whose columns have the smallest hash.

Edge cases: null and empty texts, and texts without words, form one class; texts of fewer than five words are near
only their own word sequence; rows with one id and different texts are judged apart; rows without an id stay; an
empty table gives an empty result; the other columns are passed through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonarium.llm import textbatch as tb
from zonarium.llm.simhash_dedup import _LOWER, SMALL_ROWS, connected, fingerprint, linked_prints, written

#: Fingerprints link at so many differing bits.
BITS = 4
WIDTH, SIMILARITY = 5, 0.8
#: Candidates agree in one of so many bands of so many least hashes each.
BANDS, ROWS = 24, 5
_SALT, _ODD = np.random.default_rng(20261127).integers(0, 2**64, (2, BANDS * ROWS), dtype=np.uint64) | np.array([[0], [1]], np.uint64)
#: A larger group is compared in blocks of about so many texts, with so many texts of the group that stand in every block.
BLOCK, GUIDES = 400, 16


def _grams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of a column: class of each text (its folded word sequence), shingles as hashes, and where each text's begin."""
    off, raw = tb.utf8(column)
    for i, j in tb.slices(off):
        words = tb.Words(off[i : j + 1] - off[i], _LOWER[raw[off[i] : off[j]]])
        h = words.hashes()
        up, down = tb.powers(tb.WORD_MULTIPLIER, len(h) + 1)
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=total[1:])
        begin, end = words.begin[:-1], words.begin[1:]
        kind = tb.mix64((total[end] - total[begin]) * down[begin] + words.count.astype(np.uint64))
        # a text of fewer words has no shingles: it is near nothing but its own class
        grams, at = words.windows(h, WIDTH)
        yield kind.view(np.int64), grams, np.searchsorted(words.text[at], np.arange(len(words.count) + 1))


def bands(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of band keys for each text that has shingles, and which texts those are."""
    full = np.flatnonzero(np.diff(bounds))
    keys = np.zeros((len(full), BANDS), np.uint64)
    if len(full):
        for k in range(BANDS * ROWS):
            least = np.minimum.reduceat((grams ^ _SALT[k]) * _ODD[k], bounds[:-1][full])
            keys[:, k // ROWS] = tb.mix64(keys[:, k // ROWS] + least + np.uint64(k + 1))
    return keys, full


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        off, raw = tb.utf8(batch.column(1))
        prints = np.array([fingerprint(raw[a:b].tobytes()) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], np.uint64).view(np.int64)
        for kind, grams, bounds in _grams(batch.column(1)):
            keys, full = bands(grams, bounds)
            ends = np.zeros(len(kind) + 1, np.int32)
            ends[full + 1] = BANDS
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
            rest = [c.slice(at, len(kind)) for c in batch.columns[2:]]
            mine = pa.array(prints[at : at + len(kind)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(kind)), pa.array(kind), lists, mine, *rest], ["doc_id", "kind", "bands", "bits", *batch.schema.names[2:]])
            at += len(kind)


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class and sorted distinct shingles of each text."""
    for batch in batches:
        for kind, grams, bounds in _grams(batch.column(0)):
            sets = [np.unique(grams[a:b]).view(np.int64) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(sets, pa.list_(pa.int64()))], ["kind", "shingles"])


def verified_links(sets: list[np.ndarray], keys: np.ndarray, block: np.ndarray, tree: np.ndarray) -> list[tuple[int, int]]:
    """A forest over the near copies among the sets of different trees (and blocks, if there are two); pairs that share one of their band ``keys`` count, less those that links join."""
    size = np.array([len(x) for x in sets])
    bounds = np.concatenate([[0], np.cumsum(size)])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    here = np.zeros(ids.max() + 1, bool)
    tree = np.unique(tree, return_inverse=True)[1]
    across = len(np.unique(block)) > 1
    out: list[tuple[int, int]] = []
    for k in range(len(sets) - 1):
        ask = (tree != tree[k]) & (np.minimum(size, size[k]) >= SIMILARITY * np.maximum(size, size[k]))
        ask[:k] = False
        if across:
            ask &= block != block[k]
        ask[ask] = (keys[ask] == keys[k]).any(axis=1)
        if not ask.any():
            continue
        mine = ids[bounds[k] : bounds[k + 1]]
        here[mine] = True
        both = np.add.reduceat(here[ids], bounds[:-1], dtype=np.int64)
        here[mine] = False
        for j in np.flatnonzero(ask & (both >= SIMILARITY * (size + size[k] - both))).tolist():
            if tree[j] != tree[k]:
                out.append((k, j))
                tree[tree == tree[j]] = tree[k]
    return out


def _verify(group: pa.Table) -> pa.Table:
    kinds = group.column("kind").to_numpy()
    lists = group.column("shingles").combine_chunks()
    off, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    block, tree = (group.column(c).to_numpy() for c in ("block", "tree"))
    keys = group.column("bands").combine_chunks().flatten().to_numpy().reshape(len(kinds), -1)
    found = verified_links([flat[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], keys, block, tree)
    a, b = (kinds[[x[k] for x in found]] if found else np.zeros(0, np.int64) for k in (0, 1))
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _compared(pieces: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified links within each piece of (``root``, ``piece``, ``kind``, ``tree``, ``block``); ``sets`` has the shingles and bands of each kind."""
    full = pieces.join(sets, "kind").select("root", "piece", "kind", "tree", "block", "shingles", "bands")
    return full.groupBy("root", "piece").applyInArrow(_verify, "a long, b long")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def _blocks(members: DataFrame, large: DataFrame) -> DataFrame:
    """The members with ``n``, the blocks of their group, and their own ``block``."""
    n = F.coalesce("blocks", F.lit(1))
    return members.join(_small(large), "root", "left").withColumn("n", n).withColumn("block", F.pmod(F.xxhash64("kind"), "n").cast("int"))


def _sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("root").count().where(F.col("count") > BLOCK).select("root", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))


def _group_links(members: DataFrame, posts: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified links among the ``members`` (``kind``, ``root``) of each group; ``posts`` has the bands of each kind."""
    large = written(_sizes(members), "large")
    dealt = _blocks(members, large)
    if not large.limit(1).count():
        return _compared(dealt.select("kind", "root", F.lit(0).alias("piece"), F.col("kind").alias("tree"), F.lit(0).alias("block")), sets)
    sets = written(sets, "sets")
    nth = F.row_number().over(Window.partitionBy("root").orderBy("kind"))
    guides = members.join(_small(large), "root").withColumn("nth", nth).where(F.col("nth") <= GUIDES)
    everywhere = guides.select("kind", "root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("piece"))
    pieces = dealt.select("kind", "root", F.col("block").alias("piece")).unionByName(everywhere).distinct()
    first = written(_compared(pieces.select("*", F.col("kind").alias("tree"), F.lit(0).alias("block")), sets), "first-links")
    # bands of large groups whose texts stand in different trees
    trees = connected(first)
    of_large = members.join(_small(large), "root", "left_semi").join(trees, F.col("kind") == trees["node"], "left").select("kind", F.coalesce(trees["root"], "kind").alias("tree"))
    seated = written(posts.join(of_large, "kind").select(F.col("band").alias("root"), "kind", "tree"), "seated")
    split = seated.groupBy("root").agg(F.min("tree").alias("x"), F.max("tree").alias("y")).where("x <> y").select("root")
    open_ = written(seated.join(split, "root", "left_semi"), "open")
    dealt = _blocks(open_, written(_sizes(open_), "large-bands"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    number = F.least("block", "other").cast("long") * F.col("n") + F.greatest("block", "other")
    second = _compared(pairs.select("kind", "root", number.alias("piece"), "tree", "block"), sets)
    return first.unionByName(second)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``text`` and ``code``, a hash of the text that tells rows with one id apart."""
    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("code"))


def _print_links(kinds: DataFrame) -> DataFrame:
    """Links (a, b) between ``kind`` whose fingerprints (``bits``) are equal or differ in at most ``BITS`` bits."""
    least = written(kinds.groupBy("bits").agg(F.min("kind").alias("a")), "prints")
    equal = kinds.join(least, "bits").where("kind <> a").select("a", F.col("kind").alias("b"))
    near = linked_prints(least, BITS).select(F.col("a").alias("x"), F.col("b").alias("y"))
    apart = near.join(least.select(F.col("bits").alias("x"), "a"), "x").join(least.select(F.col("bits").alias("y"), F.col("a").alias("b")), "y")
    return equal.unionByName(apart.select("a", "b"))


def near_copy_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, code, kind) of every document, and links (a, b) between kinds: by fingerprints, and verified ones."""
    base = _rows(docs, id_col, text_col)
    marked = written(base.mapInArrow(_mark, "doc_id long, kind long, bands array<long>, bits long, code long"), "marks")
    first = F.min(F.struct("doc_id", "code")).alias("first")
    kinds = written(marked.where("doc_id is not null").groupBy("kind").agg(first, F.first("bands").alias("bands"), F.first("bits").alias("bits")), "kinds")
    posts = kinds.select("kind", F.explode("bands").alias("band"))
    # a band's texts hang on the least of them; a band of one text is gone after one aggregation
    shared = written(posts.groupBy("band").agg(F.min("kind").alias("a"), F.max("kind").alias("b")).where("a <> b").select("band", "a"), "shared")
    roots = connected(posts.join(shared, "band").where("kind <> a").select("a", F.col("kind").alias("b")).distinct())
    members = written(roots.select(F.col("node").alias("kind"), "root").unionByName(roots.select(F.col("root").alias("kind"), "root").distinct()), "members")
    named = kinds.join(members, "kind", "left_semi").select("first.doc_id", "first.code")
    texts = base.join(named.hint("merge"), ["doc_id", "code"], "left_semi").select("text")
    sets = texts.mapInArrow(_shingles, "kind long, shingles array<long>").dropDuplicates(["kind"])
    links = _group_links(members, posts, sets.join(kinds.select("kind", "bands"), "kind"))
    return marked.select("doc_id", "code", "kind"), links.unionByName(_print_links(kinds.select("kind", "bits")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns as they are, less those that have a near copy with a smaller id."""
    marked, links = near_copy_links(docs, id_col, text_col)
    roots = connected(links)
    marked = marked.where("doc_id is not null")
    least = marked.groupBy("kind").agg(F.min(F.struct("doc_id", "code")).alias("first"))
    groups = least.join(roots, least["kind"] == roots["node"], "left").select("first", F.coalesce("root", "kind").alias("root"))
    stay = groups.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.code")
    rows = written(marked.join(stay, ["doc_id", "code"], "left_semi").groupBy("doc_id", "code").agg(F.count(F.lit(1)).alias("rows")), "stay")
    # merge joins at every size: what stays grows with the corpus and is never broadcast
    kept = rows.select(F.col("doc_id").alias("stay_id"), F.col("code").alias("stay_code")).hint("merge")
    id_, code = docs[id_col].cast("long"), F.xxhash64(docs[text_col].cast("string"))
    out = docs.join(kept, (id_ == kept["stay_id"]) & (code == kept["stay_code"]), "left_semi")
    if rows.where("rows > 1").limit(1).count():
        plain = [f.name for f in docs.schema.fields if f.dataType.typeName() != "map"]
        nth = F.row_number().over(Window.partitionBy(id_col, F.xxhash64(text_col)).orderBy(F.xxhash64(*plain)))
        out = out.select(F.struct("*").alias("row"), nth.alias("nth")).where("nth = 1").select("row.*")
    return out.unionByName(docs.where(docs[id_col].isNull()))
