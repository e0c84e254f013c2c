"""Queries over events and conversations: rates, histograms, sessions, turns, citations, offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonarium.functions import text as t
from zonarium.operators import lookups, metrics, quality, windows
from zonarium.plans.cases import Cases
from zonarium.plans.registry import Registry, table
from zonarium.sources.literals import BUCKET_BOUNDS

R = Registry()


@R.add("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def request_rates_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rates(table(spark, sf_dir, "events"), "ts", "5 minutes", ["event_type"])


@R.add(
    """WITH e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k) AS start, event_type FROM events, range(0, 6) r(k))
    SELECT start, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad, round(count(*) FILTER (event_type = 'error') / count(*), 4) AS ratio FROM e GROUP BY start"""
)
def sliding_error_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of errors in six-hour windows that start every hour."""
    return metrics.ratio(table(spark, sf_dir, "events"), "ts", "6 hours", "1 hour", F.col("event_type") == "error")


_BOUNDS = [b / 1000 for b in BUCKET_BOUNDS]
_HISTOGRAM = f"""b AS (SELECT unnest([{", ".join(f"{b}::DOUBLE" for b in _BOUNDS)}]) AS le),
    c AS (SELECT event_type, count(value) AS total FROM events GROUP BY event_type),
    h AS (SELECT event_type, le, (SELECT count(*) FROM events e WHERE e.event_type = c.event_type AND e.value <= le) AS n, total FROM c CROSS JOIN b)"""


@R.add(f"WITH {_HISTOGRAM} SELECT * FROM h")
def histogram_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(table(spark, sf_dir, "events"), ["event_type"], "value", _BOUNDS)


@R.add(
    f"""WITH {_HISTOGRAM},
    w AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY event_type ORDER BY le), 0) AS below, coalesce(lag(le) OVER (PARTITION BY event_type ORDER BY le), 0) AS low, total * 0.95::DOUBLE AS rank FROM h)
    SELECT event_type, round(low + (le - low) * (rank - below) / (n - below), 4) AS quantile FROM w WHERE n >= rank AND below < rank"""
)
def histogram_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = metrics.histogram(table(spark, sf_dir, "events"), ["event_type"], "value", _BOUNDS)
    return metrics.histogram_quantile(h, ["event_type"], 0.95)


@R.add("SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90, round(avg(value), 4) AS mean FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency(table(spark, sf_dir, "events"), ["event_type"], "value")


@R.add("SELECT (json_extract(props, '$.k')::BIGINT % 7) AS k, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY ALL")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"] % 7
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@R.add(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS s FROM events),
    n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS start, max(ts) AS stop FROM n GROUP BY user_id, session"""
)
def session_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = windows.sessions(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id", "ts", 1800, "event_id")
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("start"), F.max("ts").alias("stop"))


@R.add("SELECT event_type, min(event_id) AS first_seen FROM events GROUP BY event_type")
def first_seen_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.first_seen(table(spark, sf_dir, "events"), "event_type", "event_id")


@R.add(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
    SELECT conv_id, turn, role, substring(text, 1, 300) AS memory, back FROM r WHERE back <= 3"""
)
def session_turns_last3(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = windows.last_rows(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", 3)
    return last.select("conv_id", "turn", "role", F.substring("text", 1, 300).alias("memory"), "back")


@R.add(
    """WITH c AS (SELECT conv_id, turn, nullif(regexp_extract(text, '([A-Z][a-z]{6,})', 1), '') AS code FROM conversations),
    f AS (SELECT *, last_value(CASE WHEN code IS NOT NULL THEN {'v': code, 'o': turn} END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS l FROM c)
    SELECT conv_id, turn, code, CASE WHEN turn - l.o <= 2 THEN l.v END AS filled FROM f"""
)
def fill_forward_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.nullif(F.regexp_extract("text", "([A-Z][a-z]{6,})", 1), F.lit("")).alias("code"))
    return windows.fill_forward(c, ["conv_id"], "turn", "code", 2, "filled")


@R.add("SELECT conv_id, turn, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations")
def cumulative_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.offsets(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text").select("conv_id", "turn", "start")


@R.add(
    """WITH n AS (SELECT doc_id, list_distinct([replace(x, ',', '.') for x in regexp_extract_all(text, '([0-9]+(?:[.,][0-9]+)?)', 1)]) AS nums FROM documents),
    k AS (SELECT doc_id, list_sort([x for x in nums if NOT list_contains([""" + ", ".join(f"'{k}'" for k in range(32)) + """], x)]) AS unknown FROM n)
    SELECT doc_id, len(unknown) AS n, unknown[1] AS first_unknown FROM k WHERE len(unknown) > 0"""
)
def number_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a text beyond the ones that never count (0 to 31)."""
    known = F.array(*(F.lit(str(k)) for k in range(32)))
    n = table(spark, sf_dir, "documents").select("doc_id", F.array_sort(F.array_except(t.numbers(F.col("text")), known)).alias("unknown"))
    return n.where(F.size("unknown") > 0).select("doc_id", F.size("unknown").cast("long").alias("n"), F.get("unknown", F.lit(0)).alias("first_unknown"))


@R.add(
    """WITH w AS (SELECT conv_id, turn, role, list_distinct(regexp_extract_all(lower(text), '[a-z]{9,}')) AS ws FROM conversations),
    a AS (SELECT conv_id, turn, unnest(ws) AS w FROM w WHERE role = 'assistant'),
    s AS (SELECT DISTINCT conv_id, unnest(ws) AS w FROM w WHERE role <> 'assistant')
    SELECT conv_id, turn, count(*) AS cited, count(s.w) AS found, (count(*) = count(s.w)) AS ok FROM a LEFT JOIN s USING (conv_id, w) GROUP BY conv_id, turn"""
)
def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long words of an answer as citations: which of them stand in the other turns."""
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{9,})"), F.lit(1))).alias("ws"))
    a = w.where("role = 'assistant'").select("conv_id", "turn", F.explode("ws").alias("w"))
    s = w.where("role <> 'assistant'").select("conv_id", F.explode("ws").alias("w")).distinct().withColumn("hit", F.lit(1))
    g = a.join(s, ["conv_id", "w"], "left").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("cited"), F.count("hit").alias("found"))
    return g.withColumn("ok", F.col("cited") == F.col("found"))


@R.add(
    """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS page FROM lineitem WHERE l_returnflag = 'R'),
    r AS (SELECT l_orderkey AS k, l_linenumber AS opage, min(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
    j AS (SELECT l.k, l.page, r.opage, r.q, row_number() OVER (PARTITION BY l.k, l.page ORDER BY abs(l.page - r.opage) NULLS LAST, r.opage) AS rn FROM l LEFT JOIN r ON l.k = r.k AND abs(l.page - r.opage) <= 2)
    SELECT k, page, opage, q FROM j WHERE rn = 1"""
)
def nearest_page_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each returned line with the nearest accepted line of its order, at most two lines away."""
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("page"), "l_quantity", "l_returnflag")
    left = i.where("l_returnflag = 'R'").select("k", "page").distinct()
    right = i.where("l_returnflag = 'A'").select("k", F.col("page").alias("opage"), "l_quantity").groupBy("k", "opage").agg(F.min("l_quantity").alias("q"))
    return lookups.nearest_key(left, right, "k", "page", "opage", 2).select("k", "page", "nearest.opage", "nearest.q")


@R.add(
    """WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+')) AS gold FROM benchmark),
    d AS (SELECT doc_id, list_distinct(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+')) AS answer FROM documents),
    j AS (SELECT doc_id, item_id, len(list_intersect(answer, gold))::DOUBLE AS hits, len(answer) AS na, len(gold) AS ng FROM d JOIN b ON doc_id % (SELECT count(*) FROM b) = item_id)
    SELECT doc_id, item_id, round(hits / na, 4) AS precision, round(hits / ng, 4) AS recall,
           round(CASE WHEN hits > 0 THEN 2 * (hits / na) * (hits / ng) / (hits / na + hits / ng) ELSE 0 END, 4) AS f1 FROM j"""
)
def token_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored against one benchmark item: the items, numbered from zero, are dealt out in turn."""
    words = lambda c: F.regexp_extract_all(t.fold(F.col(c)), F.lit("([a-z0-9]+)"), F.lit(1))
    b = table(spark, sf_dir, "benchmark").select("item_id", words("text").alias("gold"))
    d = table(spark, sf_dir, "documents").select("doc_id", words("text").alias("answer"), (F.col("doc_id") % b.count()).alias("item_id"))
    j = d.join(b, "item_id")
    return j.select("doc_id", "item_id", *(c.alias(n) for n, c in quality.overlap_scores(F.col("answer"), F.col("gold")).items()))


@R.add(
    """SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS passed, round(count(*) FILTER (quality = 1) / count(*), 4) AS share, round(avg(toxic), 4) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY lang"""
)
def eval_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    n, good = F.count(F.lit(1)), F.count_if(F.col("quality") == 1)
    return j.groupBy("lang").agg(n.alias("n"), good.alias("passed"), F.round(good / n, 4).alias("share"), F.round(F.avg("toxic"), 4).alias("toxic"))


_BOUND_ROWS = [(1, "512, 1024,abc,-5,1024,0,{b}"), (2, ""), (3, "{a},{c}")]
_BOUND_AT = Cases(_BOUND_ROWS, ("id", "s"), source="events", key="event_id")


@R.add(
    f"WITH {_BOUND_AT.sql('rows_')} " + """SELECT id, list_sort(list_distinct([x for x in [try_cast(trim(p) AS BIGINT) for p in string_split(s, ',')] if x > 0])) AS bounds
    FROM rows_"""
)
def bucket_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _BOUND_AT.frame(spark, sf_dir).select("id", metrics.bounds_from_text(F.col("s")).alias("bounds"))


@R.add(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)),
    n AS (SELECT user_id, event_type, k, sum(s) OVER (PARTITION BY user_id ORDER BY k) AS session FROM g),
    l AS (SELECT user_id, list(event_type ORDER BY k) AS events, session, row_number() OVER (PARTITION BY user_id ORDER BY session DESC) AS nth FROM n GROUP BY user_id, session)
    SELECT user_id, len(events)::INT AS turns, events[greatest(1, len(events) - 2):] AS memory FROM l WHERE nth = 1"""
)
def session_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as keyed streaming state over the events, run to the end of the input; the last state of each user."""
    from zonarium.sources.scratch import folder
    from zonarium.streaming.sessions import session_memory

    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "0 seconds")
    out, check = folder(spark, "session-out"), folder(spark, "session-checkpoint")
    state = session_memory(stream.select("user_id", "at", "event_type"), "user_id", "at", "event_type")
    q = state.writeStream.foreachBatch(lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)).outputMode("update").option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    updates = spark.read.schema("user_id bigint, turns int, memory array<string>, batch bigint").parquet(out)
    return updates.groupBy("user_id").agg(F.max_by(F.struct("turns", "memory"), "batch").alias("last")).select("user_id", "last.*")


@R.add(
    """WITH c AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT * FROM c WHERE start + INTERVAL 2 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events)"""
)
def window_counts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by hour and type as a streaming aggregation with a watermark, run to the end of the input."""
    from zonarium.sources.scratch import folder
    from zonarium.streaming.sessions import windowed_counts

    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("at", F.col("ts").cast("timestamp"))
    out, check = folder(spark, "windows-out"), folder(spark, "windows-checkpoint")
    q = windowed_counts(stream, "at", ["event_type"], "1 hour", "1 hour").writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("start timestamp, event_type string, n bigint").parquet(out)
