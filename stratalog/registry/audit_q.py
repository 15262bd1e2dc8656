"""Queries of checks and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.operators import audit as A
from stratalog.registry import base as B
from stratalog.registry.base import query

# The copy lost all system entries and shows the second turn in capitals.


def _copy(s, d):
    return B.raw_entry(s, d).filter("role <> 'system'").withColumn(
        "text", F.when(F.col("time") == "08:05:00", F.upper("text")).otherwise(F.col("text")))


VERIFY = """SELECT date, src_entries, dst_entries, CASE WHEN src_entries <> dst_entries THEN 1 ELSE bad END
  AS discrepancies
FROM (SELECT coalesce(a.date, b.date) AS date, count(a.date) AS src_entries, count(b.date) AS dst_entries,
        count(*) FILTER ((a.time, a.role, a.text) IS DISTINCT FROM (b.time, b.role, b.text)) AS bad
      FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY time, id) AS rn FROM raw_entry) a
      FULL JOIN (SELECT date, time, id, role,
                   CASE WHEN time = '08:05:00' THEN upper(text) ELSE text END AS text,
                   row_number() OVER (PARTITION BY date ORDER BY time, id) AS rn
                 FROM raw_entry WHERE role <> 'system') b ON a.date = b.date AND a.rn = b.rn
      GROUP BY 1)
WHERE CASE WHEN src_entries <> dst_entries THEN 1 ELSE bad END > 0"""

query("verify_entries", VERIFY)(lambda s, d: A.verify_entries(B.raw_entry(s, d), _copy(s, d)))

SUMMARIES = """SELECT level, period_start, CASE WHEN emotional_tone = '1-URGENT' THEN 'missing'
  ELSE 'differs' END AS problem FROM day_unit WHERE emotional_tone IN ('1-URGENT', '5-LOW')"""


def _summary_problems(s, d):
    src = B.day_unit(s, d)
    dst = src.filter("emotional_tone <> '1-URGENT'").withColumn(
        "summary", F.when(F.col("emotional_tone") == "5-LOW", F.lit(None).cast("string"))
        .otherwise(F.col("summary")))
    return A.verify_summaries(src, dst)


query("verify_summaries", SUMMARIES)(_summary_problems)


def _profiles(s, d):
    from stratalog.registry import entity_q
    return entity_q.profiles(s, d).withColumn("knowledge", F.array_repeat(
        F.lit(1), F.col("mention_count").cast("int")))


def _profile_problems(s, d):
    src = _profiles(s, d)
    return A.verify_profiles(src, src.withColumn(
        "display_name", F.when(F.col("mention_count") > 60, "other").otherwise(
            F.col("display_name"))))


PROFILES = """SELECT id, 'differs' AS problem FROM (SELECT DISTINCT id FROM alias)
WHERE id IN (SELECT id FROM fact GROUP BY id HAVING count(*) > 60)"""
query("verify_profiles", PROFILES)(_profile_problems)

query("verify_load", f"""SELECT 'raw_entry' AS "table", CAST(coalesce(sum(discrepancies), 0) AS BIGINT)
  AS discrepancies FROM ({VERIFY})
UNION ALL SELECT 'summary', count(*) FROM ({SUMMARIES})
UNION ALL SELECT 'entity_profile', count(*) FROM ({PROFILES})""")(
    lambda s, d: A.verify_load(A.verify_entries(B.raw_entry(s, d), _copy(s, d)),
                               _summary_problems(s, d), _profile_problems(s, d)))

SIZE = """SELECT units, total_chars, est AS est_tokens, CAST(floor(est / units) AS BIGINT) AS avg_tokens_per_unit
FROM (SELECT count(*) AS units, CAST(sum(length(content)) AS BIGINT) AS total_chars,
        CAST(trunc(sum(length(content)) / CAST(3.5 AS DOUBLE)) AS BIGINT) AS est FROM corpus)"""

query("corpus_size", SIZE)(lambda s, d: A.corpus_size(B.corpus(s, d), "content"))

query("cost_estimate", f"""SELECT total_input_tokens, total_output_tokens, round(ci, 6) AS cost_in,
  round(co, 6) AS cost_out, round(ci + co, 6) AS total_cost, round((ci + co) * 1.2::DOUBLE, 6) AS with_buffer
FROM (SELECT units * avg_tokens_per_unit AS total_input_tokens, units * 800 AS total_output_tokens,
  units * avg_tokens_per_unit / CAST(1000000 AS DOUBLE) * 0.25::DOUBLE AS ci,
  units * 800 / CAST(1000000 AS DOUBLE) * 1.5::DOUBLE AS co FROM ({SIZE}))""")(
    lambda s, d: _rounded(A.cost_estimate(A.corpus_size(B.corpus(s, d), "content"), 0.25, 1.5, 800),
                          "cost_in", "cost_out", "total_cost", "with_buffer"))


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


RATIO = """CASE WHEN char_count > 0 AND actual_input_tokens > 0
  THEN round(char_count / CAST(actual_input_tokens AS DOUBLE), 4) END"""

query("usage_rows", f"""SELECT doc_id, model, char_count, actual_input_tokens, {RATIO} AS empirical_ratio
FROM call_log""")(lambda s, d: A.usage_rows(B.call_log(s, d)))

query("empirical_ratio", f"SELECT doc_id, {RATIO} AS empirical_ratio FROM call_log")(
    lambda s, d: A.usage_rows(B.call_log(s, d)).select("doc_id", "empirical_ratio"))

query("usage_calibration", f"""SELECT model, count({RATIO}) AS calls, round(avg({RATIO}), 6) AS chars_per_token
FROM call_log GROUP BY model""")(
    lambda s, d: _rounded(A.usage_calibration(B.call_log(s, d)), "chars_per_token"))
