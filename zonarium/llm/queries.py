"""The queries of the corpus operators and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonarium.llm.decontaminate import contaminated
from zonarium.llm.fill_in_middle import fill_in_middle, restored
from zonarium.llm.html_extract import html_extract
from zonarium.llm.merkle import COLUMNS, folded, leaf_hash, merkle_manifest, siblings
from zonarium.llm.mixing import mix_sources
from zonarium.llm.quality_classifier import quality_scores
from zonarium.llm.quality_rules import quality_rules
from zonarium.llm.secret_scan import secret_scan
from zonarium.llm.simhash_dedup import simhash_dedup
from zonarium.llm.substring_dedup import substring_dedup
from zonarium.llm.suffix_dedup import suffix_dedup
from zonarium.llm.token_counts import token_counts
from zonarium.llm.url_filter import url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(_table(spark, sf_dir, "pages"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed are the hosts of mobile mirrors, which repeat pages of the hosts they mirror."""
    return url_filter(_table(spark, sf_dir, "pages"), F.col("key").startswith("m."))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(_table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, each proof folded from a claimed leaf: for ids whose checksum 7 divides, one with a character more."""
    docs = _table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = {"n_chars": F.col("n_chars") + F.lit(1)}
    claim = F.when(tampered, leaf_hash(*(more.get(c, F.col(c)) for c in COLUMNS)))
    found = merkle_manifest(docs, {"claim": claim})
    found = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), folded(F.coalesce("claim", "leaf"), F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms and cuts, with hashes of what is written and of what is read back from it."""
    made = fill_in_middle(_table(spark, sf_dir, "documents"))
    back = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", restored(F.col("output"), F.col("form")).alias("back"))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("back", 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_html_extract": op2_html_extract,
    "op3_secret_scan": op3_secret_scan,
    "op4_url_filter": op4_url_filter,
    "op5_decontaminate": op5_decontaminate,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_quality_rules": op9_quality_rules,
    "op10_mix_sources": op10_mix_sources,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_fill_in_middle": op13_fill_in_middle,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quality_sql() -> str:
    """The quality rules in SQL: for each length, the words inside n-grams that occurred earlier in the text."""
    lengths = (5, 6, 8, 10)
    parts = [f"d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents)"]
    for n in lengths:
        parts.append(f"""g{n} AS (SELECT r, k, row_number() OVER (PARTITION BY r, g ORDER BY k) AS nth, count(*) OVER (PARTITION BY r, g) AS times FROM
            (SELECT r, k, array_to_string(w[k:k + {n - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {n - 2})) AS k FROM d WHERE len(w) >= {n})))""")
        parts.append(f"""c{n} AS (SELECT r, sum(length(w[i])) AS chars FROM (SELECT DISTINCT r, k + j AS i FROM g{n}, range(0, {n}) t(j) WHERE nth > 1) JOIN d USING (r) GROUP BY r)""")
    parts.append("rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, k + j AS i FROM g8, range(0, 8) t(j) WHERE times > 1) GROUP BY r)")
    parts.append(r"""l AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY i) AS nth FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d))""")
    parts.append(r"""ld AS (SELECT r, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS chars FROM l WHERE nth > 1 AND regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r)""")
    parts.append(
        r"""m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(ld.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(ld.chars, 0)::BIGINT AS dup_line_chars, ["""
        + ", ".join(f"coalesce(c{n}.chars, 0)::BIGINT" for n in lengths)
        + "] AS dup_ngram_chars FROM d LEFT JOIN ld USING (r) LEFT JOIN rep USING (r) "
        + " ".join(f"LEFT JOIN c{n} USING (r)" for n in lengths)
        + ")"
    )
    parts.append("f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)")
    return f"""WITH {", ".join(parts)} SELECT *, NOT base_failed AND n_symbols * 10 <= n_words AND dup_line_chars * 10 <= 3 * word_chars AND list_max(dup_ngram_chars) * 10 <= 3 * word_chars AS kept FROM f"""


ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        s AS (SELECT r, doc_id, k, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
        f AS (SELECT g, min(doc_id) AS first FROM s GROUP BY g),
        c AS (SELECT DISTINCT r, k + j AS i FROM s JOIN f USING (g), range(0, 13) t(j) WHERE first < doc_id),
        l AS (SELECT r, list(i) AS gone FROM c GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
               sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_where(w, [NOT list_contains(gone, i) FOR i IN range(1, len(w) + 1)]) END, ' ')) AS kept_sha256
        FROM d LEFT JOIN l USING (r)
    """,
    # The driver's pages mark their article and use two character references inside it.
    "op2_html_extract": r"""
        WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1), '<[^>]*$', '') AS h FROM pages),
        b AS (SELECT page_id, url, [trim(regexp_replace(regexp_replace(replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&'), '&amp$', '&'), '\s+', ' ', 'g'))
                                    FOR x IN string_split_regex(h, '</?(?:p|h1)>')] AS parts FROM a),
        t AS (SELECT page_id, url, coalesce(array_to_string([x FOR x IN parts IF x <> ''], chr(10)), '') AS text FROM b)
        SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
    """,
    "op9_quality_rules": _quality_sql(),
    "op4_url_filter": """
        WITH parts AS (
            SELECT page_id,
                   coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        rules(verdict, rhost, rpath) AS (VALUES
            ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
            ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        judged AS (
            SELECT page_id, host, path,
                   (SELECT max_by(struct_pack(t := rhost || rpath, v := verdict), length(rhost || rpath)) FROM rules
                    WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS hit
            FROM parts)
        SELECT page_id, host, path, hit.t AS rule,
               coalesce(hit.v, CASE WHEN starts_with(host, 'm.') THEN 'block' ELSE 'allow' END) AS verdict
        FROM judged
    """,
    # crc32 bit by bit: each character is followed by seven zeros, and every element shifts once
    "op12_merkle_manifest": """
        WITH RECURSIVE v AS (
            SELECT doc_id, lang, [strlen(doc_id::VARCHAR) || ':' || doc_id, strlen(source) || ':' || source, strlen(lang) || ':' || lang, strlen(n_chars::VARCHAR) || ':' || n_chars, strlen(text) || ':' || text] AS f,
                   strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) AS more,
                   list_reduce([4294967295::UBIGINT] || flatten([[ascii(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(doc_id::VARCHAR, '')]),
                               lambda a, x: xor(xor(a, x) >> 1, 3988292384::UBIGINT * (xor(a, x) & 1))) AS crc
            FROM documents),
        d AS (SELECT doc_id, coalesce('=' || lang, '') AS g,
                     sha256(coalesce(f[1], '-') || coalesce(f[2], '-') || coalesce(f[3], '-') || coalesce(f[4], '-') || coalesce(f[5], '-')) AS leaf,
                     sha256(coalesce(f[1], '-') || coalesce(f[2], '-') || coalesce(f[3], '-') || coalesce(CASE WHEN xor(crc, 4294967295::UBIGINT) % 7 = 0 THEN more ELSE f[4] END, '-') || coalesce(f[5], '-')) AS claim FROM v),
        leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM d),
        up AS (SELECT g, idx, n, leaf AS h, 0 AS l FROM leaves
               UNION ALL
               SELECT g, idx // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY idx)), any_value(l + 1) FROM up WHERE n > 1 GROUP BY g, idx // 2),
        tops AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
        over_ AS (SELECT idx, n, subroot AS h, 0 AS l FROM tops
                  UNION ALL
                  SELECT idx // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY idx)), any_value(l + 1) FROM over_ WHERE n > 1 GROUP BY idx // 2),
        high AS (SELECT t.g, max(l) + 1 AS levels FROM up t GROUP BY t.g),
        path AS (SELECT p.doc_id, p.leaf, p.claim, p.g, p.idx, u.l AS l, s.h AS sib, (p.idx >> u.l) & 1 AS odd
                 FROM leaves p JOIN up u ON u.g = p.g AND u.idx = p.idx >> u.l AND u.n > 1 LEFT JOIN up s ON s.g = u.g AND s.l = u.l AND s.idx = xor(u.idx, 1)
                 UNION ALL
                 SELECT p.doc_id, p.leaf, p.claim, p.g, p.idx, 1000 + u.l, s.h, (t.idx >> u.l) & 1
                 FROM leaves p JOIN tops t USING (g) JOIN over_ u ON u.idx = t.idx >> u.l AND u.n > 1 LEFT JOIN over_ s ON s.l = u.l AND s.idx = xor(u.idx, 1)),
        proof AS (SELECT g, idx, list({s: coalesce(sib, ''), o: odd} ORDER BY l) AS p FROM path GROUP BY g, idx)
        SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_reduce([''] || [x.s FOR x IN p], lambda a, x: a || x), '')) AS proof_sha256,
               coalesce(list_reduce([{s: claim, o: 0}] || p, lambda a, x: {s: sha256(CASE WHEN x.o = 1 THEN x.s || a.s ELSE a.s || x.s END), o: 0}).s, claim) AS folded_root,
               folded_root = root AS verified
        FROM leaves JOIN tops USING (g) LEFT JOIN proof ON proof.g = leaves.g AND proof.idx = leaves.idx, (SELECT h AS root FROM over_ WHERE n = 1)
    """,
    "op13_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[ 	-
]*[^ 	-
]+|[ 	-
]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
        h AS (SELECT doc_id, text, u, len(u)::BIGINT AS n, [list_reduce([0::BIGINT] || [strpos('0123456789abcdef', c)::BIGINT - 1 FOR c IN string_split(k[8 * j + 1:8 * j + 8], '')], lambda a, x: a * 16 + x) FOR j IN range(0, 4)] AS r FROM d),
        c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
                     CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
        p AS (SELECT *, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS y, array_to_string(u[b + 1:n], '') AS z FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y)::BIGINT END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(text) AS restored_sha256
        FROM p
    """,
}
