"""Line and label parsing as Column expressions and small plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonarium.functions.text import fold


def looks_like_header(line: Column, capitals: float = 0.7, longest: int = 80) -> Column:
    """Short, not empty, and with the wanted share of capitals."""
    upper = F.length(F.regexp_replace(line, "[^A-ZÁÉÍÓÚÑÄÖÜ]", ""))
    return (F.length(line) > 0) & (upper >= capitals * F.length(line)) & (F.length(line) <= longest)


def cover_class(label: Column) -> Column:
    s = fold(label)
    return F.when(s.rlike("urban|edific|industr|autop"), "artificial").when(s.rlike("bosque|forest|matorral"), "forestal").when(s.rlike("humed|marisma|agua|rio"), "agua").otherwise("agricola")


def cover_alert(label: Column) -> Column:
    s = fold(label)
    return F.when(s.rlike("bosque|forest"), "incendio").when(s.rlike("humed|marisma"), "humedal").when(s.rlike("autop|carretera"), "infraestructura")


def rule_rows(lines: DataFrame, by: str, order: str, line: str) -> DataFrame:
    """Rule rows of documents given as lines: headings are carried down, values gathered below them."""
    w = W.partitionBy(by).orderBy(order)
    found = lambda pattern: F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))
    m = lines.withColumn("muni", F.last(found("^MUNICIPIO (.*)$"), ignorenulls=True).over(w)).withColumn("_b", F.max(F.when(F.startswith(line, F.lit("MUNICIPIO")), F.col(order))).over(w))
    s = m.withColumn("sub", F.last(found("^Subzona (.*)$"), ignorenulls=True).over(W.partitionBy(by, "_b").orderBy(order)))
    value = lambda name: F.max(F.regexp_extract(line, f"^{name} ([0-9.]+)$", 1).try_cast("double")).alias(name)
    return s.where(F.col(line).rlike("^(altura|ocupacion)")).groupBy(by, "muni", F.coalesce("sub", F.lit("")).alias("sub")).agg(value("altura"), value("ocupacion"))
