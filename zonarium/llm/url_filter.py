"""URL filters: host/path rules first, then an exact membership test by a Bloom filter cascade.

The cascade is built for a *complete* universe of keys, here every host of the table.  Level 1 is a
Bloom filter of the listed keys; level 2 one of the unlisted keys that level 1 lets through; level 3
one of the listed keys that level 2 lets through; and so on until a level lets nothing through.
Walking the levels answers membership exactly for every key of the universe, with no join of the keys: the
levels are constants in the expression.  Everything here is DataFrame functions.

Size: level 1 needs about 10 bits a listed key and each later level fewer than its predecessor, so
the constants depend on the list and not on the corpus.  A list whose first level would exceed ``most_bits``
is dealt by hash into shards with a cascade each, of about ``shard_bits`` a level; a url then meets the
filters of its shard, a row of at most that many bits, by a join on the shard's number (broadcast if all of them are small).
The verdicts are the same.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is
unlisted; repeated urls are judged alike; an empty table or an empty list gives only rule verdicts
and ``allow``; only the id and the url are read.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonarium.llm.simhash_dedup import written

#: Filters of all shards up to so many bits together are broadcast (64 MiB).
SMALL_BITS = 1 << 29
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _first_fitting(host: Column, path: Column, rules: tuple[Rule, ...], value) -> Column:
    """``value`` of the longest rule that fits, else null."""
    out: Column | None = None
    for rule in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(value(rule))) if out is None else out.when(fits, F.lit(value(rule)))
    return out if out is not None else F.lit(None).cast("string")


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its 64-bit words (if they are constants), how many bits, how many probes, and its salt."""

    words: tuple[int, ...]
    bits: int
    probes: int
    salt: int

    def positions(self, key: Column) -> list[Column]:
        first, step = F.xxhash64(key, F.lit(2 * self.salt)), F.xxhash64(key, F.lit(2 * self.salt + 1))
        return [F.pmod(F.xxhash64(first, step, F.lit(i)), F.lit(self.bits)) for i in range(self.probes)]

    def passes(self, key: Column, words: Column | None = None) -> Column:
        """Whether the filter lets a key through; ``words`` stands for the constants if they are in a column."""
        words = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>") if words is None else words
        out = F.lit(True)
        for at in self.positions(key):
            word = F.element_at(words, (F.floor(at / 64) + 1).cast("int"))
            out = out & (F.getbit(word, (at % 64).cast("int")) == 1)
        return out


def _bits(n: float, error: float) -> int:
    """Bits of a filter of ``n`` keys, whole words."""
    return max(64, -(-math.ceil(n * math.log2(1 / error) / math.log(2)) // 64) * 64)


def _level(keys: DataFrame, n: int, error: float, salt: int, most_bits: int) -> Level:
    """A Bloom filter of the ``n`` keys: set bits are combined to words before they are gathered."""
    bits = _bits(n, error)
    if bits > most_bits:
        raise ValueError(f"a filter of {n} keys needs {bits} bits; the bound is {most_bits}")
    empty = Level((), bits, max(1, round(math.log2(1 / error))), salt)
    at = keys.select(F.explode(F.array(*empty.positions(F.col("key")))).alias("at"))
    rows = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("set")).collect()
    words = [0] * (bits // 64)
    for row in rows:
        words[row["word"]] = row["set"]
    return Level(tuple(words), bits, empty.probes, salt)


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(shards))


def build_sharded_cascade(universe: DataFrame, n: int, first_error: float, shard_bits: int, levels: int = 64) -> tuple[list[Level], DataFrame, int]:
    """The levels' shapes, one row a shard with the words of every level (``w0``, ``w1``, ...), and the number of shards.

    Keys still in question are written after each level, so no level is computed twice.
    """
    shards = max(1, -(-_bits(n, first_error) // shard_bits))
    keyed = universe.withColumn("shard", _shard(F.col("key"), shards))
    encode, other = keyed.where("listed"), keyed.where(~F.col("listed"))
    out: list[Level] = []
    table = keyed.sparkSession.range(shards).withColumnRenamed("id", "shard")
    while n:
        if len(out) == levels:
            raise RuntimeError("the cascade does not end")
        error = first_error if not out else 0.5
        level = Level((), _bits(1.3 * n / shards + 8, error), max(1, round(math.log2(1 / error))), len(out))
        at = encode.select("shard", F.explode(F.array(*level.positions(F.col("key")))).alias("at"))
        words = at.groupBy("shard", F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("set"))
        held = words.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("word", "set"))).alias("m"))
        dense = F.transform(F.sequence(F.lit(0), F.lit(level.bits // 64 - 1)), lambda i: F.coalesce(F.element_at("m", i.cast("long")), F.lit(0).cast("long")))
        name = f"w{len(out)}"
        filled = written(held.select("shard", dense.alias(name)), name)
        empty = F.array_repeat(F.lit(0).cast("long"), level.bits // 64)
        table = table.join(filled, "shard", "left").withColumn(name, F.coalesce(name, empty))
        through = written(other.join(filled, "shard").where(level.passes(F.col("key"), F.col(name))).select("key", "shard"), "through")
        out.append(level)
        encode, other = through, encode.select("key", "shard")
        n = encode.count()
    return out, written(table, "cascades"), shards


def build_cascade(universe: DataFrame, first_error: float = 0.01, most_bits: int = 1 << 23, levels: int = 64) -> list[Level]:
    """Cascade for distinct keys (``key``) flagged ``listed``; each level shrinks what is left.

    The keys still in question are filtered from the universe anew for each level, so nothing but
    the filters is gathered.
    """
    out: list[Level] = []
    encode, other = universe.where("listed"), universe.where(~F.col("listed"))
    n = encode.count()
    while n:
        if len(out) == levels:
            raise RuntimeError("the cascade does not end")
        level = _level(encode, n, first_error if not out else 0.5, len(out), most_bits)
        out.append(level)
        through = other.where(level.passes(F.col("key")))
        encode, other = through, encode
        n = encode.count()
    return out


def is_listed(key: Column, cascade: list[Level], words: list[Column] | None = None) -> Column:
    """Exact membership for keys of the universe: stopped by level 2 means listed, by level 3 not, ..."""
    out = F.lit(len(cascade) % 2 == 1)
    for depth in range(len(cascade) - 1, -1, -1):
        out = F.when(cascade[depth].passes(key, words[depth] if words else None), out).otherwise(F.lit(depth % 2 == 1))
    return out


def url_filter(
    pages: DataFrame,
    listed: Column,
    rules: tuple[Rule, ...] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    first_error: float = 0.01,
    most_bits: int = 1 << 23,
    shard_bits: int = 1 << 16,
) -> DataFrame:
    """Host, path, rule and verdict of every page.

    ``listed`` says of a column ``key`` (a host) whether it is on the block list; it is asked once
    for each distinct host, when the cascade is built.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    judged = urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    universe = written(judged.select(F.col("host").alias("key")).distinct().withColumn("listed", F.coalesce(listed, F.lit(False))), "hosts")
    n = universe.where("listed").count()
    host, path = F.col("host"), F.col("path")
    if _bits(n, first_error) <= most_bits:
        member = is_listed(host, build_cascade(universe, first_error, most_bits))
    else:
        levels, table, shards = build_sharded_cascade(universe, n, first_error, shard_bits)
        names = [f"w{k}" for k in range(len(levels))]
        small = shards * sum(level.bits for level in levels) <= SMALL_BITS
        judged = judged.withColumn("shard", _shard(host, shards)).join(F.broadcast(table) if small else table, "shard")
        member = is_listed(host, levels, [F.col(c) for c in names])
    method = F.when(member, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        "page_id",
        "host",
        "path",
        _first_fitting(host, path, rules, lambda r: r.text).alias("rule"),
        F.coalesce(_first_fitting(host, path, rules, lambda r: r.verdict), method).alias("verdict"),
    )
