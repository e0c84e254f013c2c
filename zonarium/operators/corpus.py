"""From pages to answers: articles of legal texts, chunks with their page, and questions answered from one municipality's chunks.

A document's pages are brought together, so a document must fit in a task; everything else is keyed by document,
article or question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonarium.functions import text as t
from zonarium.operators.lookups import small, top_k
from zonarium.operators.retrieval import K1, B
from zonarium.sources.scratch import materialised

# The headings that begin an article, a provision or an annex, at the start of a line.
ARTICLE = r"(?:art[íi]culo|artigo)\s+\d+(?:\s*(?:bis|ter|quater|quinquies|sexies|septies|octies|nonies|decies))?\d*[\.\s:–—-]"
PROVISION = r"disposici[oó]n\s+(?:adicional|transitoria|derogatoria|final)\s+(?:[a-záéíóúñ]+|\d+[ªº]?)"
ANNEX = r"anexo\s+[ivx0-9]+[\.\s:–—-]"
HEADING = rf"(?m)^\s*(?:{ARTICLE}|{PROVISION}|{ANNEX})"
#: The same heading again within so many characters is no new article; a longer lead is a block of its own.
REPEATED, LEAD = 40, 400


def heading_label(token: Column) -> Column:
    """What a heading is called: ``Art. 12`` for articles, else its own words."""
    number = F.nullif(F.regexp_extract(token, r"(?iu)^\s*(?:art[íi]culo|artigo)\s*(\S+)", 1), F.lit(""))
    own = F.regexp_replace(F.regexp_replace(token, r"^\s+", ""), r"[\s.:–—-]+$", "")
    return F.coalesce(F.concat(F.lit("Art. "), F.regexp_replace(number, r"[.:]+$", "")), own)


def articles(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, ref, start, page, text) of every article: from its heading to the next, with the page it begins on.

    A lead of more than ``LEAD`` characters is ``EXPOSICION_MOTIVOS``; a document without headings is one block, ``DOCUMENTO``.
    """
    sheet = F.struct(F.col(page).alias("page"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = pages.groupBy(F.col(doc).alias("doc")).agg(F.array_sort(F.collect_list(sheet)).alias("_p")).select("doc", "_p", F.array_join(F.col("_p")["text"], "\n").alias("_t"))
    starts = F.aggregate(
        "_p", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,page:bigint>>").alias("out")),
        lambda s, p: F.struct((s["at"] + F.length(p["text"]) + 1).alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("at"), p["page"].cast("long").alias("page")))).alias("out")), lambda s: s["out"],
    )
    marks = F.transform(t.places(F.col("_t"), HEADING), lambda m: F.struct(m["begin"].alias("start"), heading_label(m["token"]).alias("ref")))
    kind = "array<struct<start:int,ref:string>>"
    once = F.aggregate(marks, F.array().cast(kind), lambda kept, m: F.when((F.size(kept) > 0) & (F.element_at(kept, -1)["ref"] == m["ref"]) & (m["start"] - F.element_at(kept, -1)["start"] < REPEATED), kept).otherwise(F.concat(kept, F.array(m))))
    read = materialised(whole.select("doc", "_t", starts.alias("_s"), once.alias("_m")), "articles")
    first = F.get("_m", F.lit(0))["start"]
    lead = F.struct(F.lit(0).alias("start"), F.when(F.size("_m") == 0, "DOCUMENTO").otherwise("EXPOSICION_MOTIVOS").alias("ref"))
    blocks = F.when((F.size("_m") == 0) | (first > LEAD), F.concat(F.array(lead), "_m")).otherwise(F.col("_m"))
    cut = read.withColumn("_b", blocks).select("doc", "_t", "_s", "_b", F.posexplode("_b").alias("_k", "_x"))
    end = F.coalesce(F.get("_b", F.col("_k") + 1)["start"], F.length("_t"))
    begun = F.element_at(F.filter("_s", lambda s: s["at"] <= F.col("_x.start")), -1)["page"]
    return cut.select("doc", F.col("_x.ref").alias("ref"), F.col("_x.start").alias("start"), begun.alias("page"), F.substring("_t", F.col("_x.start") + 1, end - F.col("_x.start")).alias("text"))


def corpus_chunks(found: DataFrame, size: int = 1800, overlap: int = 120) -> DataFrame:
    """(doc, ref, page, chunk, text) of articles cut at sentences; blank chunks are left out but counted."""
    return found.select("doc", "ref", "start", "page", F.posexplode(t.sentence_chunks(F.col("text"), size, overlap)).alias("chunk", "text")).where(F.trim("text") != "")


def bm25_within(chunks: DataFrame, questions: DataFrame, by: str, key: list[str], text: str, qid: str, question: str) -> DataFrame:
    """(qid, key, score) by BM25 with the statistics of the question's own group of chunks."""
    asked = questions.select(qid, by, F.explode(F.array_distinct(t.terms(F.col(question)))).alias("term"))
    tokens = materialised(chunks.select(by, *key, t.terms(F.col(text)).alias("_t")).join(small(questions.select(by).distinct()), by, "left_semi"), "tokens")
    stats = tokens.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("_t")).alias("mean"))
    tf = tokens.select(by, *key, F.size("_t").alias("len"), F.explode("_t").alias("term")).join(small(asked.select("term").distinct()), "term", "left_semi").groupBy(by, *key, "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy(by, "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    scored = tf.join(small(df), [by, "term"]).join(small(stats), by).withColumn("part", part)
    return scored.join(small(asked), [by, "term"]).groupBy(qid, *key).agg(F.sum("part").alias("score"))


def consult(chunks: DataFrame, questions: DataFrame, by: str, key: list[str], text: str, k: int = 6) -> DataFrame:
    """One row per question (``qid``, the group ``by``, ``question``): quality, answer and citations, best first.

    A question whose group has no chunk is ``unavailable`` and says what to do; one whose words no chunk has is official
    without citations; every other answer points to the fragments, each with its score and the words around the first hit.
    """
    hits = top_k(bm25_within(chunks, questions, by, key, text, "qid", "question"), ["qid"], k, F.desc(F.round("score", 9)), *(F.asc(c) for c in key))
    first = F.get(t.terms(F.col("question")), F.lit(0))
    cited = hits.join(questions, "qid").join(chunks.select(by, *key, text), [by, *key]).withColumn("extract", t.snippet(F.col(text), first))
    cite = F.struct("rank", *key, F.round("score", 3).alias("score"), "extract")
    every = cited.groupBy("qid").agg(F.array_sort(F.collect_list(cite)).alias("citations"))
    there = chunks.select(by).distinct().withColumn("_there", F.lit(True))
    out = questions.join(small(there), by, "left").join(every, "qid", "left")
    empty = F.array().cast(dict(every.dtypes)["citations"])
    citations = F.coalesce("citations", empty)
    answer = F.when(F.col("_there") & (F.size(citations) > 0), F.lit("Fragmentos más relevantes de la normativa; revisar las citas completas en el original."))
    todo = F.when(F.col("_there").isNull(), F.lit("Descargar primero los documentos del municipio"))
    return out.select("qid", by, F.when(F.col("_there").isNull(), "unavailable").otherwise("official").alias("data_quality"), answer.alias("answer"), todo.alias("instructions"), citations.alias("citations"))


def documents_by_class(documents: DataFrame, place: str, kind: str, dates: list[str], classes: tuple[int, ...]) -> DataFrame:
    """Documents of the wanted classes, newest first in their place (first date that is not blank), with the number of their class there."""
    date = F.coalesce(*(F.nullif(F.trim(d), F.lit("")) for d in dates), F.lit(""))
    d = documents.where(F.col(kind).isin(*classes)).withColumn("date", date)
    counts = d.groupBy(place, kind).agg(F.count(F.lit(1)).alias("of_class"))
    return d.join(small(counts), [place, kind])


def building_diagnostic(buildings: DataFrame, key: str) -> DataFrame:
    """(key, parametro, edificio, norma, diferencia, cumple, orientativo, verdict, status): a building against its subzone, a row for each limit.

    ``buildings`` has height, levels and footprint, the limits altura_max, ocupacion_max, edificabilidad_max and retranqueo_min, and the
    subzone's status; floors are three metres.  Height and floors are judged, the rest is for information; of a pilot
    subzone the result is a hint; a subzone that is missing, unavailable or ambiguous has one row without a parameter.
    """
    c = F.col
    floors = F.when(c("altura_max").isNotNull(), F.greatest(F.lit(1), F.floor(c("altura_max") / 3.0))).cast("double")
    over = F.round(c("height") - c("altura_max"), 2)
    more = c("levels").cast("double") - floors
    none = F.lit(None)

    def row(when: Column, name: str, seen: Column, limit: Column, gap: Column, holds: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("parametro"), seen.cast("double").alias("edificio"), limit.cast("double").alias("norma"), gap.cast("double").alias("diferencia"), holds.cast("boolean").alias("cumple")))

    rows = F.array_compact(F.array(
        row(c("altura_max").isNotNull(), "altura", c("height"), c("altura_max"), over, over <= 0),
        row(c("altura_max").isNotNull() & c("levels").isNotNull(), "plantas", c("levels"), floors, more, more <= 0),
        row(c("ocupacion_max").isNotNull() & c("footprint").isNotNull(), "ocupacion", c("footprint"), c("ocupacion_max"), none, none),
        row(c("edificabilidad_max").isNotNull(), "edificabilidad", none, c("edificabilidad_max"), none, none),
        row(c("retranqueo_min").isNotNull(), "retranqueo", none, c("retranqueo_min"), none, none),
    ))
    state = F.lower(F.coalesce("status", F.lit("")))
    silent = c("status").isNull() | state.isin("unavailable", "ambiguous")
    pilot = state == "pilot"
    exceeds = F.coalesce(over > 0, F.lit(False)) | F.coalesce(more > 0, F.lit(False))
    verdict = F.when(silent, "sin_dato").when(pilot, F.when(exceeds, "orientativo_supera").otherwise("orientativo_dentro")).when(exceeds, "supera_altura").otherwise("compatible")
    shown = buildings.select(key, verdict.alias("verdict"), F.when(silent, state).when(pilot, "pilot").otherwise("verified").alias("status"), pilot.alias("_pilot"), F.explode_outer(F.when(~silent, rows)).alias("r"))
    hint = F.when(c("_pilot") & c("r.cumple").isNotNull(), F.when(c("r.cumple"), "dentro").otherwise("supera"))
    return shown.select(key, "r.parametro", "r.edificio", "r.norma", "r.diferencia", F.when(~c("_pilot"), c("r.cumple")).alias("cumple"), hint.alias("orientativo"), "verdict", "status")
