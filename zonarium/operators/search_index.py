"""A stored inverted index and its search: the same ranking as ``bm25`` over all documents, from the blocks that can hold it.

Postings are cut into blocks by a hash of the document, as many to a term (a power of two) as make blocks of about
``BLOCK`` postings, so the blocks of all terms are nested parts of one space of documents and a frequent term is many
rows.  A block keeps the largest impact in it.  A search adds the largest impacts of a question's terms over
the finest part of that space, scores the most promising parts, and then only those whose bound reaches the k-th
score found.  Tables are sorted by term, so a question reads the row groups of its terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonarium.functions import text as t
from zonarium.operators.lookups import small, top_k
from zonarium.operators.retrieval import K1, SMALL_TERMS, B
from zonarium.sources.scratch import materialised

BLOCK = 128
#: So many postings are grouped at a time where their documents are.
CHUNK = 1 << 21
#: Postings on their way to their blocks, and the bits of a document's hash that they keep.
POSTING = np.dtype([("doc", "<i8"), ("hash", "<i4"), ("tf", "<i4"), ("len", "<i4")])
HASHED = (1 << 31) - 1
#: How many parts of the space are scored for a first k-th score.
FIRST_PARTS = 16
#: Sums of doubles depend on the order of addition; bounds are lowered by this much.
SLACK = 1e-6


@dataclass(frozen=True)
class SearchIndex:
    """``terms`` (term, df, parts), ``blocks`` (term, part, top, postings) and the corpus statistics."""

    terms: DataFrame
    blocks: DataFrame
    documents: int
    mean_length: float


def _part(doc: Column, parts: Column) -> Column:
    """The part of a document among a power of two of them."""
    return F.xxhash64(doc).bitwiseAND(parts - 1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, p) with the packed postings of a term among some thousands of documents, after a row without a term for their lengths (null texts: -1)."""
    words: dict[str, int] = {}
    docs: list[tuple[int, int, int, int]] = []
    ids: list[int] = []
    tfs: list[int] = []
    lengths: list[int] = []

    def chunk() -> pa.RecordBatch:
        doc, part, length, terms = np.array(docs, np.int64).reshape(-1, 4).T
        at = np.array(ids, np.int64)
        order = np.argsort(at, kind="stable")
        packed = np.empty(len(at), POSTING)
        for name, values in (("doc", doc), ("hash", part), ("len", length)):
            packed[name] = np.repeat(values, terms)[order]
        packed["tf"] = np.array(tfs, np.int64)[order]
        every = np.zeros(len(lengths), POSTING)
        every["len"] = lengths
        sizes = np.append(len(lengths), np.bincount(at, minlength=len(words)))
        return _packed(["term"], [pa.array([None, *words], pa.string())], np.concatenate([every, packed]), sizes)

    for batch in batches:
        for doc, part, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            by_length: dict[int, dict[str, int]] = {}
            for text in texts:  # rows of one document and length count as one
                c = t.counted_terms(text)
                n = sum(c.values())
                lengths.append(-1 if text is None else n)
                if n in by_length:
                    c = {w: by_length[n].get(w, 0) + c.get(w, 0) for w in {**by_length[n], **c}}
                by_length[n] = c
            for n, c in by_length.items():
                docs.append((doc, part, n, len(c)))
                ids += [words.setdefault(w, len(words)) for w in c]
                tfs += c.values()
            if len(ids) >= CHUNK:
                yield chunk()
                words, docs, ids, tfs, lengths = {}, [], [], [], []
    if lengths:
        yield chunk()


def _packed(names: list[str], columns: list[pa.Array], postings: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    ends = np.concatenate([[0], np.cumsum(sizes)]) * POSTING.itemsize
    p = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(postings)])
    return pa.RecordBatch.from_arrays([*columns, p], [*names, "p"])


def _unpacked(p: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All postings of packed rows, and how many each has."""
    ends = np.frombuffer(p.buffers()[1], np.int32, len(p) + 1, p.offset * 4)
    return np.frombuffer(p.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(POSTING), np.diff(ends) // POSTING.itemsize


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, part, p): postings of frequent terms cut by their documents' parts."""
    for batch in batches:
        if not len(batch):
            continue
        postings, sizes = _unpacked(batch.column(1))
        row = np.repeat(np.arange(len(batch)), sizes)
        part = postings["hash"].astype(np.int64) & (batch.column(2).to_numpy()[row] - 1)
        order = np.lexsort((part, row))
        row, part = row[order], part[order]
        starts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (part[1:] != part[:-1])]))
        yield _packed(["term", "part"], [batch.column(0).take(pa.array(row[starts])), pa.array(part[starts])], postings[order], np.diff(np.append(starts, len(row))))


def _blocks(mean: float):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(term, part, top, postings) of rows that are sorted by term and part; a block may run over several batches."""
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.concat_batches([*rest, batch])
            term, part = rows.column(0), rows.column(1).to_numpy()
            new = pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)).to_numpy(zero_copy_only=False) | (part[1:] != part[:-1])
            starts = np.concatenate([[0], np.flatnonzero(new) + 1])
            rest = [rows.slice(starts[-1])]
            if len(starts) > 1:
                yield folded(rows.slice(0, starts[-1]), starts[:-1])
        for rows in rest:
            yield folded(rows, np.zeros(1, np.int64))

    def folded(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        p, sizes = _unpacked(rows.column(2))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        first = ends[starts]
        tf = p["tf"].astype(float)
        top = np.maximum.reduceat(tf * (K1 + 1) / (tf + K1 * (1 - B + B * p["len"] / mean)), first)
        fields = [pa.array(np.ascontiguousarray(p[c]), kind) for c, kind in (("doc", pa.int64()), ("tf", pa.int64()), ("len", pa.int32()))]
        postings = pa.ListArray.from_arrays(np.append(first, ends[-1]).astype(np.int32), pa.StructArray.from_arrays(fields, ["doc", "tf", "len"]))
        at = pa.array(starts)
        return pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(1).take(at), pa.array(top), postings], ["term", "part", "top", "postings"])

    return fold


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = _unpacked(batch.column(0))[0]["len"].astype(np.int64)
        known = lengths[lengths >= 0]
        yield pa.RecordBatch.from_arrays([pa.array([len(lengths)]), pa.array([int(known.sum())]), pa.array([len(known)])], ["documents", "total", "known"])


def write_index(docs: DataFrame, doc: str, text: str, path: str) -> None:
    """Builds the index of all documents below ``path``.

    Documents are dealt by the low bits of their hash, lowest first, so that those of a part stand together, and their terms are
    counted and grouped where they are; what is shuffled is a row for each term among some thousands of documents.
    """
    given = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("_x")).where("doc is not null")
    if given.groupBy("doc").count().where("count > 1").limit(1).count():
        texts = given.groupBy("doc").agg(F.collect_list(F.struct("_x")).alias("_x")).withColumn("_x", F.transform("_x", lambda x: x["_x"]))
    else:
        texts = given.withColumn("_x", F.array("_x"))
    near = F.reverse(F.lpad(F.bin(F.xxhash64("doc").bitwiseAND(HASHED)), 31, "0"))
    dealt = texts.repartition(F.substring(near, 1, 12)).sortWithinPartitions(near)
    chunks = materialised(dealt.select("doc", F.xxhash64("doc").bitwiseAND(HASHED).alias("hash"), "_x").mapInArrow(_chunks, "term string, p binary"), "chunks")
    sums = chunks.where("term is null").select("p").mapInArrow(_lengths, "documents bigint, total bigint, known bigint")
    stats = sums.agg(F.coalesce(F.sum("documents"), F.lit(0)).cast("long").alias("documents"), F.try_divide(F.sum("total"), F.sum("known")).cast("double").alias("mean_length"))
    stats.coalesce(1).write.parquet(f"{path}/stats")
    mean = docs.sparkSession.read.parquet(f"{path}/stats").first()["mean_length"] or 1.0
    chunks = chunks.where("term is not null")
    df = chunks.groupBy("term").agg(F.sum(F.length("p") / POSTING.itemsize).cast("long").alias("df"))
    parts = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("df") / BLOCK, F.lit(1.0))))).cast("long")
    terms = materialised(df.withColumn("parts", parts), "terms")
    several = small(terms.where("parts > 1").select("term", "parts"))  # the others are one block
    found = chunks.join(several, "term", "left").select("term", "p", F.coalesce("parts", F.lit(1).cast("long")).alias("parts")).mapInArrow(_parted, "term string, part bigint, p binary")
    ordered = found.repartitionByRange("term", "part").sortWithinPartitions("term", "part")
    ordered.mapInArrow(_blocks(mean), "term string, part bigint, top double, postings array<struct<doc:bigint,tf:bigint,len:int>>").write.parquet(f"{path}/blocks")
    terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")


def read_index(spark: SparkSession, path: str) -> SearchIndex:
    stats = spark.read.parquet(f"{path}/stats").first()
    return SearchIndex(spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/blocks"), stats["documents"], stats["mean_length"] or 1.0)


def _of_terms(table: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of the asked terms: by a filter that reaches the scan while they are few, else by a join."""
    words = [r["term"] for r in asked.select("term").distinct().limit(SMALL_TERMS + 1).collect()]
    return table.where(F.col("term").isin(words)) if len(words) <= SMALL_TERMS else table.join(asked.select("term").distinct(), "term", "left_semi")


def _scored(index: SearchIndex, asked: DataFrame, parts: DataFrame, blocks: DataFrame) -> DataFrame:
    """(qid, doc, score) of the documents in the given parts (qid, finest, fine) of each question."""
    tf, length = F.col("p.tf"), F.col("p.len")
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(index.mean_length)))
    wanted = parts.join(small(asked), "qid").select("qid", "term", "idf", F.col("fine").bitwiseAND(F.col("parts") - 1).alias("part")).distinct()
    opened = wanted.join(blocks, ["term", "part"]).select("qid", "idf", F.explode("postings").alias("p"))
    finest = parts.groupBy("qid").agg(F.first("finest").alias("finest"))
    named = opened.join(small(finest), "qid").select("qid", F.col("p.doc").alias("doc"), part.alias("_s"), _part(F.col("p.doc"), F.col("finest")).alias("fine"))
    return named.join(parts.select("qid", "fine"), ["qid", "fine"], "left_semi").groupBy("qid", "doc").agg(F.sum("_s").alias("score"))


def search(index: SearchIndex, questions: DataFrame, qid: str, question: str, k: int) -> DataFrame:
    """(qid, doc, rank, score): the ``k`` best documents of each question, ties to the smaller document; exact."""
    asked = questions.select(F.col(qid).alias("qid"), F.explode(F.array_distinct(t.terms(F.col(question)))).alias("term"))
    asked = materialised(asked, "questions")
    n = F.lit(index.documents)
    known = _of_terms(index.terms, asked).withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    asked = materialised(asked.join(known, "term"), "asked")
    blocks = _of_terms(index.blocks, asked)
    finest = asked.groupBy("qid").agg(F.max("parts").alias("finest"))
    tops = blocks.select("term", "part", "top").join(small(asked), "term").join(small(finest), "qid")
    # a block of a rarer term covers every finest part that ends in its number
    covered = tops.withColumn("fine", F.explode(F.sequence(F.col("part"), F.col("finest") - 1, F.col("parts"))))
    bounds = materialised(covered.groupBy("qid", "finest", "fine").agg(F.sum(F.col("idf") * F.col("top")).alias("bound")), "bounds")
    first = top_k(bounds, ["qid"], FIRST_PARTS, F.desc("bound"), F.asc("fine")).select("qid", "finest", "fine")
    seen = top_k(_scored(index, asked, first, blocks), ["qid"], k, F.desc("score"))
    least = seen.where(F.col("rank") == k).select("qid", (F.col("score") - SLACK).alias("least"))
    hopeful = bounds.join(small(least), "qid", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least"))).select("qid", "finest", "fine")
    every = _scored(index, asked, materialised(hopeful, "hopeful"), blocks)
    return top_k(every, ["qid"], k, F.desc(F.round("score", 9)), F.asc("doc")).select("qid", "doc", "rank", "score")


def opened_blocks(index: SearchIndex, questions: DataFrame, question: str) -> tuple[int, int]:
    """How many blocks the terms of the questions have, and how many there are."""
    asked = questions.select(F.explode(t.terms(F.col(question))).alias("term"))
    return _of_terms(index.blocks, asked).count(), index.blocks.count()
