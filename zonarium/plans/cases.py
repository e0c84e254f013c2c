"""Patterns spread over a given table: every row of the table takes one of the cases, with its own numbers and text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonarium.plans.registry import table
from zonarium.sources.literals import relation, values_sql


@dataclass(frozen=True)
class Cases:
    """A relation with the columns of ``rows`` and a row (or those of one first value) for every row of ``source``.

    Row k of the table, by its key, takes the case whose number is k modulo their number, and k becomes the first
    column.  In texts ``{a}``, ``{b}`` and ``{c}`` are numbers made of k: 3 to 19, 20 to 79, 1 to 9.  The columns in ``whole`` are
    followed by the row's whole ``body``; those in ``vary`` grow by a step with every turn of the cases; those in
    ``each`` get the turn as a suffix, so that every turn is a group of its own.
    """

    rows: list[tuple]
    columns: tuple[str, ...]
    source: str = "orders"
    key: str = "o_orderkey"
    body: str = "text"
    whole: tuple[str, ...] = ()
    vary: dict[str, float] = field(default_factory=dict)
    each: tuple[str, ...] = ()
    turn: int | None = None

    def _numbered(self) -> tuple[list[tuple], tuple[str, ...], int]:
        """The rows with their case's number in front, and how many cases there are."""
        firsts = list(dict.fromkeys(r[0] for r in self.rows))
        return [(firsts.index(r[0]), *r[1:]) for r in self.rows], ("_case", *self.columns[1:]), self.turn or len(firsts)

    def _texts(self) -> set[str]:
        return {c for k, c in enumerate(self.columns) if k and any(isinstance(r[k], str) for r in self.rows)}

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, columns, n = self._numbered()
        k, texts = F.col("_k"), self._texts()
        read = [F.col(self.key).cast("long").alias("_k"), *([F.col(self.body).alias("_body")] if self.whole else [])]
        keyed = table(spark, sf_dir, self.source).select(*read).withColumn("_case", k % n)
        if self.whole:
            keyed = keyed.repartition("_k")  # reading the texts over and over costs more than dealing them out
        joined = keyed.join(F.broadcast(relation(spark, rows, columns)), "_case")  # the cases are literals
        numbers = {"{a}": k * 7 % 17 + 3, "{b}": k * 11 % 60 + 20, "{c}": k % 9 + 1}
        turn = F.floor(k / n)

        def made(c: str) -> Column:
            out = F.col(c)
            if c in texts:
                for mark, number in numbers.items():
                    if any(mark in (r[self.columns.index(c)] or "") for r in self.rows):
                        out = F.replace(out, F.lit(mark), number.cast("string"))
            if c in self.whole:
                out = F.concat(out, F.lit("\n"), "_body")
            if c in self.vary:
                out = out + turn % 5 * F.lit(float(self.vary[c]))
            if c in self.each:
                out = F.concat(out, F.lit("-"), turn.cast("string"))
            return out.alias(c)

        return joined.select(k.alias(self.columns[0]), *(made(c) for c in self.columns[1:]))

    def sql(self, name: str) -> str:
        """The same relation as common table expressions, ``name`` the last of them."""
        rows, columns, n = self._numbered()
        k, texts = f"d.{self.key}::BIGINT", self._texts()
        numbers = {"{a}": f"({k} * 7 % 17 + 3)", "{b}": f"({k} * 11 % 60 + 20)", "{c}": f"({k} % 9 + 1)"}

        def made(c: str) -> str:
            out = f'v."{c}"'
            if c in texts:
                for mark, number in numbers.items():
                    if any(mark in (r[self.columns.index(c)] or "") for r in self.rows):
                        out = f"replace({out}, '{mark}', {number}::VARCHAR)"
            if c in self.whole:
                out = f"({out} || chr(10) || d.{self.body})"
            if c in self.vary:
                out = f"({out} + {k} // {n} % 5 * {float(self.vary[c])!r}::DOUBLE)"
            if c in self.each:
                out = f"({out} || '-' || ({k} // {n})::VARCHAR)"
            return f'{out} AS "{c}"'

        literal = values_sql(f"{name}_cases", rows, tuple(f'"{c}"' for c in columns))
        picked = ", ".join([f'{k} AS "{self.columns[0]}"', *(made(c) for c in self.columns[1:])])
        return f'{literal}, {name} AS (SELECT {picked} FROM {self.source} d JOIN {name}_cases v ON v."_case" = {k} % {n})'
