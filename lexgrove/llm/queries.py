"""The registered queries op1 to op13: each applies its operator to its whole table and derives the columns that are asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, filter_audit, html_text, licenses, media, minhash, packing, periodic, pieces, simhash, substring, token_counts, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents"))
    sure = F.filter("licences", lambda x: x["confirmed"])
    first = F.get(sure, F.lit(0))
    return out.select(
        "doc_id",
        "n_paragraphs",
        F.size("licences").cast("long").alias("n_named"),
        F.size(sure).cast("long").alias("n_confirmed"),
        F.coalesce(first["family"], F.lit(licenses.UNKNOWN)).alias("licence"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.decode(pieces.encode(table(spark, sf_dir, "documents")))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("text_sha256"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(table(spark, sf_dir, "documents"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op8_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bm25.top_k(docs, docs.where("doc_id % 100 = 0"))


def op9_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op11_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.collapse_runs(periodic.planted(table(spark, sf_dir, "documents")))
    # greatest length / period first: of two fractions the products across decide, so that no rounding does
    power = lambda x, y: x["length"] * y["period"]
    before = lambda x, y: (power(x, y) > power(y, x)) | ((power(x, y) == power(y, x)) & (F.struct(x["start"], x["period"]) < F.struct(y["start"], y["period"])))
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda y, x: F.when(before(x, y), x).otherwise(y))
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = out.withColumn("best", best)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_license_scan": op1_license_scan,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_html_extract": op7_html_extract,
    "op8_bm25_topk": op8_bm25_topk,
    "op9_simhash_neardup": op9_simhash_neardup,
    "op10_media_columns": op10_media_columns,
    "op11_minhash_neardup": op11_minhash_neardup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_filter_audit": op13_filter_audit,
}

_WORD = r"[^\x20\x09-\x0D]+"
ORACLE_SQL: dict[str, str] = {
    "op13_filter_audit": rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
f AS (SELECT doc_id, part,
  CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN least < doc_id THEN 'E' ELSE '' END AS fails FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, left(filter_order, step - 1) AS earlier, left(filter_order, step) AS upto
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step) s),
hit AS (SELECT *, contains(fails, f) AS failing, fails <> '' AND regexp_matches(fails, '[' || earlier || '.]') AS gone, fails = '' OR NOT regexp_matches(fails, '[' || upto || ']') AS stays
  FROM steps, c)
SELECT part, filter_order, step, sum(CASE WHEN stays THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN failing AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails = f THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN failing AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN failing AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
  sum(CASE WHEN failing THEN n * 120 // length(fails) ELSE 0 END)::BIGINT AS shapley
FROM hit GROUP BY part, filter_order, step""",
}
