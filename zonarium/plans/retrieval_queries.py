"""Queries over documents, benchmark questions and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonarium.functions import text as t
from zonarium.operators import retrieval as r
from zonarium.operators.lookups import top_k
from zonarium.operators.windows import segments
from zonarium.plans.cases import Cases
from zonarium.plans.registry import Registry, table
from zonarium.sources.literals import STOPWORDS, SYNONYMS, TOPICS, relation

R = Registry()
QUESTIONS = [(1, "thonha reesh onha"), (2, "esti thly ingre"), (3, "auen der chlich verheit"), (4, "queeaux mentre eaux")]

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def _terms_sql(column: str) -> str:
    return f"[w for w in regexp_extract_all(strip_accents(lower({column})), '[a-z0-9]+') if len(w) >= 3 and not list_contains({_STOP}, w)]"


def _bm25_sql(questions: str, k: int) -> str:
    return f"""
    WITH q AS ({questions}),
    asked AS (SELECT DISTINCT qid, unnest(list_distinct({_terms_sql("question")})) AS term FROM q),
    d AS (SELECT doc_id, source, {_terms_sql("text")} AS t FROM documents),
    s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
    x AS (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM d),
    tf AS (SELECT doc_id, l, term, count(*) AS tf FROM x WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    sc AS (SELECT qid, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / mean))) AS score
           FROM tf JOIN df USING (term) CROSS JOIN s JOIN asked USING (term) GROUP BY qid, doc_id),
    rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc)
    SELECT qid, doc_id, rank, round(score, 3) AS score FROM rk WHERE rank <= {k}"""


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    return top_k(scored, ["qid"], k, F.desc(F.round("score", 9)), F.asc("doc_id")).select("qid", "doc_id", "rank", F.round("score", 3).alias("score"))


@R.add(_bm25_sql("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS) + ") v(qid, question)", 10))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = relation(spark, QUESTIONS, ("qid", "question"))
    return _ranked(r.bm25(table(spark, sf_dir, "documents"), questions, "doc_id", "text", "qid", "question"), 10)


@R.add(_bm25_sql("SELECT item_id AS qid, text AS question FROM benchmark WHERE item_id % 10 = 0", 5))
def bm25_benchmark_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth benchmark item as a query, which is the stated query set."""
    questions = table(spark, sf_dir, "benchmark").where("item_id % 10 = 0").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return _ranked(r.bm25(table(spark, sf_dir, "documents"), questions, "doc_id", "text", "qid", "question"), 5)


_ASKED = [(1, "altura maxima en mi parcela"), (2, "retranqueo y ocupacion"), (3, "puedo hacer una piscina"), (4, "texto sin nada"), (5, "Cambio de uso de un local")]
_ASKED_AT = Cases(_ASKED, ("qid", "question"), source="documents", key="doc_id", whole=("question",))


def _expand_sql() -> str:
    groups = []
    for key, others in SYNONYMS.items():
        every = [key, *others]
        test = " OR ".join(f"contains(f, strip_accents(lower('{w}')))" for w in every)
        groups.append(f"CASE WHEN {test} THEN [{', '.join(repr(w) for w in every)}] ELSE []::VARCHAR[] END")
    # keeps the first of equal terms in order
    return f"""
    WITH {_ASKED_AT.sql('asked_')}, q AS (SELECT *, strip_accents(lower(question)) AS f FROM asked_),
    l AS (SELECT qid, flatten([[question], {", ".join(groups)}]) AS terms FROM q),
    p AS (SELECT qid, unnest(terms) AS term, generate_subscripts(terms, 1) AS ord FROM l),
    o AS (SELECT qid, term, min(ord) AS ord FROM p GROUP BY qid, term)
    SELECT qid, string_agg(term, ' ' ORDER BY ord) AS expanded FROM o GROUP BY qid"""


@R.add(_expand_sql())
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ASKED_AT.frame(spark, sf_dir).select("qid", t.expanded(F.col("question")).alias("expanded"))


_TOPIC = "altura"


@R.add(
    "WITH b AS (SELECT doc_id, strip_accents(lower(text)) AS f FROM documents) SELECT doc_id, hits, hits * 1.5 AS boost FROM (SELECT doc_id, "
    + " + ".join(f"contains(f, strip_accents('{w}'))::INT" for w in ["ha", "en", "thly", "eaux"])
    + " AS hits FROM b) WHERE hits > 1"
)
def keyword_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic boost with keywords that occur in the driver's texts."""
    body = t.fold(F.col("text"))
    hits = sum((F.contains(body, F.lit(w)).cast("int") for w in ["en", "thly", "eaux"]), F.contains(body, F.lit("ha")).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", hits.alias("hits")).where("hits > 1").withColumn("boost", F.col("hits") * F.lit(1.5).cast("decimal(2,1)"))

_TOPIC_ROWS = [(1, "que altura tengo", "La altura de cornisa y el numero de plantas"), (2, "una piscina", "Ocupación de instalaciones auxiliares"), (3, "nada", "altura"), (4, "cambio de uso y altura", "habitabilidad de la vivienda")]
_TOPIC_AT = Cases(_TOPIC_ROWS, ("qid", "question", "body"), source="documents", key="doc_id", whole=("body",))


def _topic_sql() -> str:
    arms = " ".join(f"WHEN contains(lower(question), '{k}') THEN " + " + ".join(f"contains(f, strip_accents(lower('{w}')))::INT" for w in words) for k, words in TOPICS.items())
    return f"WITH {_TOPIC_AT.sql('rows_')} SELECT qid, CASE {arms} ELSE 0 END AS hits FROM (SELECT *, strip_accents(lower(body)) AS f FROM rows_)"




@R.add(_topic_sql())
def topic_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _TOPIC_AT.frame(spark, sf_dir).select("qid", t.topic_hits(F.col("question"), F.col("body")).alias("hits"))


_PAIR = "sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


def _vector_sql(measure: str, order: str, k: int) -> str:
    return f"""
    WITH q AS (SELECT vec_id AS qid, embedding AS qe FROM embeddings WHERE vec_id % 20 = 0),
    s AS (SELECT qid, vec_id, {measure} AS score FROM q CROSS JOIN embeddings WHERE vec_id <> qid),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) {order}, vec_id) AS rank FROM s)
    SELECT qid, vec_id, rank, round(score, 4) AS score FROM r WHERE rank <= {k}"""


#: The stated query set: every row whose id is divisible by 20.
_QUERY_SET = "vec_id % 20 = 0"


@R.add(_vector_sql("list_inner_product(qe::DOUBLE[], embedding::DOUBLE[])", "DESC", 5))
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = r.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _QUERY_SET, 5)
    return top_k(s, ["qid"], 5, F.desc(F.round("score", 9)), F.asc("vec_id")).select("qid", "vec_id", "rank", F.round("score", 4).alias("score"))


@R.add(
    """WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 20 = 0),
    s AS (SELECT qid, vec_id, label, list_inner_product(qe, qe) + list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) - 2 * list_inner_product(qe, embedding::DOUBLE[]) AS d FROM q CROSS JOIN embeddings WHERE vec_id <> qid),
    f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), vec_id) AS first_rank FROM s),
    w AS (SELECT *, (1 / (1 + d)) * CASE WHEN label % 3 = 0 THEN 1.15 WHEN label % 3 = 1 THEN 0.9 ELSE 1.0 END AS weighted FROM f WHERE first_rank <= 32),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(weighted, 9) DESC, vec_id) AS rank FROM w)
    SELECT qid, vec_id, first_rank, rank, round(weighted, 4) AS weighted FROM r WHERE rank <= 8"""
)
def l2_topk_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 nearest by squared distance, then the best eight by weighted closeness."""
    e = table(spark, sf_dir, "embeddings")
    s = r.nearest(e, "vec_id", "embedding", _QUERY_SET, 32, "l2").withColumnRenamed("score", "d")
    first = top_k(s, ["qid"], 32, F.asc(F.round("d", 9)), F.asc("vec_id")).withColumnRenamed("rank", "first_rank").join(e.select("vec_id", "label"), "vec_id")
    weight = F.when(F.col("label") % 3 == 0, 1.15).when(F.col("label") % 3 == 1, 0.9).otherwise(1.0)
    second = top_k(first.withColumn("weighted", 1 / (1 + F.col("d")) * weight), ["qid"], 8, F.desc(F.round("weighted", 9)), F.asc("vec_id"))
    return second.select("qid", "vec_id", "first_rank", "rank", F.round("weighted", 4).alias("weighted"))


@R.add(
    """WITH q AS (SELECT embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id = 0),
    a AS (SELECT vec_id, row_number() OVER (ORDER BY round(list_inner_product(qe, embedding::DOUBLE[]), 9) DESC, vec_id) AS rank FROM q CROSS JOIN embeddings),
    b AS (SELECT vec_id, row_number() OVER (ORDER BY label, vec_id) AS rank FROM embeddings),
    u AS (SELECT * FROM a WHERE rank <= 50 UNION ALL SELECT * FROM b WHERE rank <= 50)
    SELECT vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 5) AS score, count(*) AS lists FROM u GROUP BY vec_id"""
)
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion of the 50 best by vector and the 50 best by another order."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("qe"))
    near = e.join(F.broadcast(q), F.lit(True)).select("vec_id", F.round(r.dot(F.col("qe"), F.col("embedding")), 9).alias("s")).orderBy(F.desc("s"), "vec_id").limit(50)
    a = near.select("vec_id", F.row_number().over(W.orderBy(F.desc("s"), "vec_id")).alias("rank"))
    other = e.select("vec_id", "label").orderBy("label", "vec_id").limit(50)
    b = other.select("vec_id", F.row_number().over(W.orderBy("label", "vec_id")).alias("rank"))
    n = a.select("vec_id").unionByName(b.select("vec_id")).groupBy("vec_id").agg(F.count(F.lit(1)).alias("lists"))
    return r.reciprocal_ranks([a, b], "vec_id").join(n, "vec_id").select("vec_id", F.round("score", 5).alias("score"), "lists")


@R.add(
    """WITH s AS (SELECT doc_id, n_chars, regexp_replace(lower(trim(text)), '\\s+', ' ', 'g') AS c FROM documents),
    k AS (SELECT doc_id, n_chars, CASE WHEN length(c) > 200 THEN substring(c, 41, 160) ELSE c END AS sig FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY n_chars DESC, doc_id) AS rn FROM k)
    SELECT doc_id, n_chars FROM r WHERE rn = 1 OR sig = ''"""
)
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.best_of_content(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text"), "text", F.col("n_chars"), "doc_id").select("doc_id", "n_chars")


@R.add(
    """WITH p AS (SELECT doc_id, text, strpos(lower(text), 'the') AS hit FROM documents),
    s AS (SELECT *, CASE WHEN hit = 0 THEN 1 ELSE greatest(1, hit - 160) END AS start FROM p)
    SELECT doc_id, concat(CASE WHEN start > 1 THEN '…' ELSE '' END, substring(text, start, 320), CASE WHEN start + 319 < length(text) THEN '…' ELSE '' END) AS snippet FROM s"""
)
def snippet_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.snippet(F.col("text"), "the").alias("snippet"))


@R.add(
    """WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(1, length(text)), 1680)) AS start FROM documents)
    SELECT doc_id, (start // 1680)::BIGINT AS chunk, length(substring(text, start::INT + 1, 1800)) AS n, md5(substring(text, start::INT + 1, 1800)) AS digest FROM c"""
)
def fixed_stride_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(1), F.length("text")) - 1, F.lit(1680))
    c = d.select("doc_id", "text", F.posexplode(starts).alias("chunk", "start")).withColumn("piece", F.substring(F.col("text"), F.col("start") + 1, F.lit(1800)))
    return c.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.length("piece").cast("long").alias("n"), F.md5("piece").alias("digest"))


_CHUNK_END = "CASE WHEN s + 1800 >= n THEN n WHEN regexp_extract(substring(t, s + 901, 900), '(?s)^(.*\\.) ', 1) <> '' THEN s + 900 + length(regexp_extract(substring(t, s + 901, 900), '(?s)^(.*\\.) ', 1)) ELSE s + 1800 END"


@R.add(
    f"""WITH RECURSIVE d AS (SELECT doc_id, text AS t, length(text) AS n FROM documents),
    c AS (SELECT doc_id, t, n, 0::BIGINT AS s, 0::BIGINT AS k, ({_CHUNK_END.replace("s + ", "0 + ")})::BIGINT AS e FROM d WHERE n > 1800
      UNION ALL SELECT doc_id, t, n, s, k, ({_CHUNK_END})::BIGINT FROM (SELECT doc_id, t, n, greatest(e - 120, s + 1) AS s, k + 1 AS k FROM c WHERE e < n)),
    p AS (SELECT doc_id, k, regexp_replace(substring(t, s + 1, e - s), '^\\s+|\\s+$', '', 'g') AS piece FROM c),
    a AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk, piece FROM p WHERE piece <> '')
    SELECT doc_id, chunk, piece FROM a UNION ALL SELECT doc_id, 0, t FROM d WHERE n <= 1800 AND regexp_matches(t, '\\S')"""
)
def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping chunks cut at sentence ends (each start follows from the cut before it)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(t.sentence_chunks(F.col("text"))).alias("chunk", "piece"))


_LINES = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)"""


@R.add(
    f"""WITH {_LINES}, h AS (SELECT *, regexp_matches(line, '^[A-ZÁÉÍÓÚ][^ ]*\\.?$') AS is_header FROM l),
    g AS (SELECT *, sum(is_header::INT) OVER (PARTITION BY doc_id ORDER BY n) AS segment FROM h)
    SELECT doc_id, segment::BIGINT AS segment, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM g GROUP BY doc_id, segment"""
)
def header_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one word as headers: each starts a segment."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    g = segments(lines, ["doc_id"], "n", F.col("line").rlike(r"^[A-ZÁÉÍÓÚ][^ ]*\.?$"))
    return g.groupBy("doc_id", "segment").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


@R.add(
    """WITH b AS (SELECT page_id, regexp_replace(html, '(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g') AS h FROM pages)
    SELECT page_id, md5(trim(regexp_replace(regexp_replace(h, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM b"""
)
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(t.plain_html(F.col("html"))).alias("digest"))


@R.add(
    """WITH x AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS u, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages)
    SELECT page_id, len(u) AS links, u[1] AS first_url, t[1] AS first_title FROM x"""
)
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", t.links(F.col("html")).alias("l"))
    return p.select("page_id", F.size("l").cast("long").alias("links"), F.get("l", F.lit(0))["url"].alias("first_url"), F.get("l", F.lit(0))["title"].alias("first_title"))


@R.add(
    """SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, rtrim(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/') AS path,
    nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS page FROM pages"""
)
def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.lower(F.regexp_extract(u, "^https?://([^/?#]+)", 1)).alias("host"), F.rtrim(F.regexp_extract(u, "^https?://[^/?#]+([^?#]*)", 1), F.lit("/")).alias("path"), F.nullif(F.regexp_extract(u, "[?&]page=([0-9]+)", 1), F.lit("")).alias("page")
    )


def _clean_sql() -> str:
    out = "text"
    for pattern, into in t.CLEANING:
        p = pattern.replace("\\n", "\n").replace("[ \\t]", "[ \t]").replace("'", "''")
        out = f"regexp_replace({out}, '{p}', '{into.replace(chr(36) + '1', chr(92) + '1')}', 'g')"
    return f"SELECT doc_id, md5(trim(regexp_replace({out}, '(?m)^(?:[Pp]age \\d+|\\d+|Licensed under .*)$', '', 'g'))) AS digest FROM documents"


@R.add(_clean_sql())
def ocr_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.without_boilerplate(t.cleaned(F.col("text")))).alias("digest"))


_FUNCTION_ROWS = [
    (1, "Altura maxima: {a},5 m; altura {c} m y ocupacion maxima del {b} %", "1{a}.000,5", "pp 3-b", "U1.2", "012345678905", "¿Qué altura tiene?"),
    (2, "La edificabilidad es de 0,{c} m2/m2. Ocupación: {b},5%", "{c}.0{b}", "PE12", "NR", "12345", "hola buenas"),
    (3, "sin datos", "1,5", "xx 1", "RZ-3", "1234567ABCDEFG", "cambio de uso del local"),
    (4, "Edificabilidade 1.2 m2/m2 y edificabilidad 0.9 m2/m2", "abc", "api.7", "zona", "999999999999", "y ese edificio"),
]
_FUNCTION_COLUMNS = ("id", "body", "num", "area", "sub", "code", "question")
_FUNCTION_AT = Cases(_FUNCTION_ROWS, _FUNCTION_COLUMNS, source="documents", key="doc_id", whole=("body",))


def _functions_sql() -> str:
    return f"""
    WITH {_FUNCTION_AT.sql('rows_')}, v AS (SELECT *, strip_accents(lower(body)) AS f, strip_accents(lower(question)) AS q, upper(trim(area)) AS a FROM rows_),
    x AS (SELECT *, regexp_extract(a, '^(PP|PE|UA|SUD|API|AR)[ .-]*([0-9]+)[ .-]*([A-Z]?)$', 1) AS k1, regexp_extract(a, '^(PP|PE|UA|SUD|API|AR)[ .-]*([0-9]+)[ .-]*([A-Z]?)$', 2) AS k2, regexp_extract(a, '^(PP|PE|UA|SUD|API|AR)[ .-]*([0-9]+)[ .-]*([A-Z]?)$', 3) AS k3 FROM v)
    SELECT id,
      list_max([try_cast(replace(h, ',', '.') AS DOUBLE) for h in regexp_extract_all(f, 'altura (?:maxima |total )?(?:de |: ?)?([0-9]+(?:[.,][0-9]+)?) ?m\\b', 1)]) AS height,
      try_cast(replace(nullif(regexp_extract(f, 'ocupacion[^.%0-9]*([0-9]+(?:[.,][0-9]+)?) ?%', 1), ''), ',', '.') AS DOUBLE) / 100 AS occupancy,
      list_max([try_cast(replace(h, ',', '.') AS DOUBLE) for h in regexp_extract_all(f, 'edificabilidade?[^.0-9]*([0-9]+(?:[.,][0-9]+)?) ?m2/m2', 1)]) AS ratio,
      CASE WHEN regexp_matches(num, '^[0-9]{{1,3}}(\\.[0-9]{{3}})+(,[0-9]+)?$') THEN try_cast(replace(replace(num, '.', ''), ',', '.') AS DOUBLE) ELSE try_cast(replace(num, ',', '.') AS DOUBLE) END AS num,
      CASE WHEN k1 <> '' THEN concat_ws('-', k1, k2, nullif(k3, '')) END AS area,
      regexp_matches(upper(trim(sub)), '^(U[0-9]+(\\.[0-9]+)?|NR[0-9]*|RZ[-0-9]*|[0-9]{{1,2}}(\\.[0-9])?)$') AS is_sub,
      regexp_matches(code, '^[0-9]{{12}}$') AS is_barcode, regexp_matches(code, '^[0-9]{{7}}.{{7}}$') AS is_reference,
      CASE WHEN regexp_matches(q, '^(hola|buenas|hello|hi)\\b') THEN 'saludo' WHEN contains(q, 'piscina') THEN 'piscina' WHEN regexp_matches(q, 'cambio de uso|vivienda') THEN 'cambio_uso'
           WHEN regexp_matches(q, 'altura|ocupacion|edificabilidad|retranqueo|normativa|ordenanza') THEN 'normativa' ELSE 'edificio' END AS intent,
      regexp_matches(q, '\\b(ese|esa|eso|este|esta|esto|mismo|misma|alli|ahi|that|this|it)\\b') AS refers
    FROM x"""


@R.add(_functions_sql())
def text_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters, numbers, codes and intents from phrases in front of whole documents."""
    c = F.col
    return _FUNCTION_AT.frame(spark, sf_dir).select(
        "id", t.extracted_height(c("body")).alias("height"), t.extracted_occupancy(c("body")).alias("occupancy"), t.extracted_ratio(c("body")).alias("ratio"), t.spanish_number(c("num")).alias("num"), t.area_code(c("area")).alias("area"),
        t.is_subzone_code(c("sub")).alias("is_sub"), t.is_barcode(c("code")).alias("is_barcode"), t.is_cadastral_reference(c("code")).alias("is_reference"), t.intent(c("question")).alias("intent"), t.refers_back(c("question")).alias("refers"),
    )


@R.add(
    f"""WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rank, concat('- ', substring(text, 1, 500)) AS piece FROM documents),
    u AS (SELECT *, sum(length(piece)) OVER (PARTITION BY source ORDER BY rank) AS used FROM p)
    SELECT source, doc_id, rank, used::BIGINT AS used FROM u WHERE used <= 1000"""
)
def context_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "text", F.row_number().over(W.partitionBy("source").orderBy("n_chars", "doc_id")).alias("rank"))
    return r.packed(d, "source", "rank", "text").select("source", "doc_id", "rank", "used")


@R.add(_bm25_sql("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS) + ") v(qid, question)", 1 << 30).replace("SELECT qid, doc_id, rank, round(score, 3) AS score FROM rk WHERE rank <= 1073741824", "").rstrip().rstrip(",") + """
    , b AS (SELECT qid, doc_id, round(score, 9) AS score, max(round(score, 9)) OVER (PARTITION BY qid) AS best FROM sc),
    k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM b WHERE score >= round(CASE WHEN best < 3 THEN 0.6 ELSE 0.4 END * best, 9))
    SELECT qid, doc_id, rank FROM k WHERE rank <= CASE WHEN best < 3 THEN 3 ELSE 5 END""")
def relevance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = relation(spark, QUESTIONS, ("qid", "question"))
    return r.relevant(r.bm25(table(spark, sf_dir, "documents"), questions, "doc_id", "text", "qid", "question"), "qid", "doc_id").select("qid", "doc_id", "rank")
