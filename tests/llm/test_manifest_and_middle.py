"""Merkle manifest and fill-in-middle against plain Python, on odd tables, with other fanouts and sentinels."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from zonarium.llm import merkle
from zonarium.llm.fill_in_middle import FillInMiddle, fill_in_middle, restored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[f] for f in FIELDS)))


def tree(nodes, fanout):
    """Top of the tree, and for each leaf the (before, after) siblings from the bottom up."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, k in enumerate(at):
            run = nodes[k - k % fanout : k - k % fanout + fanout]
            proofs[leaf].append(("".join(run[: k % fanout]), "".join(run[k % fanout + 1 :])))
            at[leaf] = k // fanout
        nodes = [sha("".join(nodes[k : k + fanout])) for k in range(0, len(nodes), fanout)]
    return nodes[0], proofs


def plain_manifest(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {}
    for g in order:
        members = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        subs[g] = (members, *tree([leaf_of(r) for r in members], fanout))
    root, above = tree([subs[g][1] for g in order], fanout) if order else (None, [])
    return sorted(
        (str(r["doc_id"]), leaf_of(r), top, root, proof + above[k]) for k, g in enumerate(order) for members, top, proofs in [subs[g]] for r, proof in zip(members, proofs, strict=True)
    )


def manifest_rows(df):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in df.collect())


@pytest.fixture(scope="module")
def rows(spark):
    data = [(k, f"text {k}", ["en", "de", "fr"][k % 7 % 3], f"s{k % 4}", k) for k in range(61)]
    data += [(5, None, None, None, None), (None, "", "", "x", 0), (None, "b", "en", "x", 1), (7, "ü漢🙂", "zz", None, 3), (9, "same", "en", "s", 4), (9, "same", "en", "s", 4), (-3, "minus", "é", "s", 5)]
    return spark.createDataFrame([(*d, "q", 1, "h") for d in data], "doc_id long, text string, lang string, source string, n_chars long, h string, idx int, g string")


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_manifest_equals_plain(rows, fanout):
    assert manifest_rows(merkle.merkle_manifest(rows, fanout=fanout)) == plain_manifest(rows.collect(), fanout)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_small_manifests(rows, n):
    some = rows.where("lang = 'en'").orderBy("doc_id").limit(n)
    assert manifest_rows(merkle.merkle_manifest(some)) == plain_manifest(some.collect(), 2)


def test_no_fanout_of_one(rows):
    with pytest.raises(ValueError, match="two children"):
        merkle.merkle_manifest(rows, fanout=1)


def test_manifest_of_odd_tables(spark, odd_docs):
    docs = odd_docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.lit("en")))
    assert manifest_rows(merkle.merkle_manifest(docs)) == plain_manifest(docs.collect(), 2)


def test_every_row_folds_to_the_root_and_no_changed_row_does(rows):
    found = merkle.merkle_manifest(rows, {"claim": F.concat(F.lit("0"), F.substring(merkle.leaf_hash(*(F.col(f) for f in FIELDS)), 2, 63))})
    got = found.select(F.col("leaf").startswith("0").alias("same"), (merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("yes"), (merkle.folded(F.col("claim"), F.col("proof")) == F.col("root")).alias("no")).collect()
    assert len(got) == rows.count() and all(r.yes for r in got) and all(r.no == r.same for r in got)


def test_numbers_are_places_in_the_group(spark):
    n = 4000
    rows = spark.range(n).select(F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 3)).alias("g"), (F.col("id") * 7919 % n).alias("v")).repartition(16)
    got = merkle.numbered(rows, ["v"], "test-numbers").collect()
    groups = {}
    for r in got:
        groups.setdefault(r.g, []).append((r.idx, r.v, r.n))
    assert sum(map(len, groups.values())) == n
    for members in groups.values():
        members.sort()
        assert [i for i, *_ in members] == list(range(len(members))) and [v for _, v, _ in members] == sorted(v for _, v, _ in members) and {m for *_, m in members} == {len(members)}


UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_middle(doc_id, text, how):
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    digest = sha(f"{how.seed}:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in how.marks) or h[2] % 100 >= how.percent:
        return n, "plain", None, None, text
    if h[3] % 100 < how.spm_percent:
        return n, "spm", len(p), len(m), how.suffix + s + how.prefix + p + how.middle + m
    return n, "psm", len(p), len(m), how.prefix + p + how.suffix + s + how.middle + m


@pytest.mark.parametrize("how", [FillInMiddle(), FillInMiddle(percent=100, spm_percent=0), FillInMiddle("<|pre|>", "<|suf|>", "<|mid|>", seed=7, percent=100, spm_percent=50)])
def test_middle_equals_plain(spark, odd_docs, how):
    tricky = ["<", "a <", "x <P y", "has <S> inside", "ends in <P", ">", " \t ", "a b \x1c c", "\x0b\x0cw  ", "🙂 🙂🙂  漢", "P> <", "$1 \\1 %"]
    more = spark.createDataFrame([(100 + k, t) for k, t in enumerate(tricky * 12)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text", "bits").unionByName(more.withColumn("bits", F.lit("output")))
    made = fill_in_middle(docs, how)
    got = sorted(str(tuple(r)) for r in made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect())
    assert got == sorted(str((r.doc_id, *plain_middle(r.doc_id, r.text, how))) for r in docs.collect())
    assert made.where(~restored(F.col("output"), F.col("form"), how).eqNullSafe(F.col("text"))).count() == 0


def test_middle_of_long_texts(spark):
    long = ("word \n" * 200_000, "x" * 2_000_000, " " * 1_000_000, "y " + " " * 500_000)
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    how = FillInMiddle(percent=100)
    made = fill_in_middle(docs, how)
    assert [tuple(r) for r in made.orderBy("doc_id").select("n", "form", "prefix_chars", "middle_chars", "output").collect()] == [plain_middle(k, t, how) for k, t in enumerate(long)]
    assert made.where(restored(F.col("output"), F.col("form"), how) == F.col("text")).count() == len(long)


def test_shares_of_forms(spark):
    forms = dict(fill_in_middle(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"))).groupBy("form").count().collect())
    assert abs(forms["plain"] - 2000) < 150 and abs(forms["spm"] - 1600) < 150


@pytest.mark.parametrize("marks", [("", "<S>", "<M>"), ("<P>", "<P>", "<M>"), ("<P>", "<P>x", "<M>"), ("ab", "bc", "<M>"), ("aba", "<S>", "<M>")])
def test_sentinels_that_overlap_are_refused(marks):
    with pytest.raises(ValueError, match="sentinel"):
        FillInMiddle(*marks)


def test_no_middle_of_no_rows(no_docs):
    assert fill_in_middle(no_docs).count() == 0 and merkle.merkle_manifest(no_docs.withColumn("lang", F.lit("x"))).count() == 0


def test_checksum_of_ids_is_that_of_their_digits(spark):
    got = spark.range(50).select("id", F.crc32(F.col("id").cast("string")).alias("c")).collect()
    assert all(r.c == zlib.crc32(str(r.id).encode()) for r in got)
