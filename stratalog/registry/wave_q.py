"""Runs with a model whose answers later prompts or later runs read."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratalog.functions import periods as P
from stratalog.operators import ingest, periods
from stratalog.plans import hierarchy, models
from stratalog.registry import base as B
from stratalog.registry.base import query
from stratalog.registry.context_q import CTX, RULE, SYSTEM
from stratalog.registry.source_q import _folder

STREAM = ["stream"]


def stream_units(s: SparkSession, d: str) -> DataFrame:
    """Orders as day, week and month units of one stream per priority."""
    below = B.table(s, d, "orders").groupBy(
        F.col("o_orderpriority").alias("stream"), P.date_text(F.col("o_orderdate")).alias("period_start")).agg(
        F.count(F.lit(1)).alias("source_entry_count")).select(
        "stream", F.lit("day").alias("level"), "period_start", F.col("period_start").alias("period_end"),
        F.array("period_start").alias("source_units"), "source_entry_count",
        F.concat(F.col("source_entry_count").cast("string"), F.lit(" orders")).alias("summary"))
    out = [below]
    for level in ("week", "month"):
        below = periods.rollup_level(below, level, STREAM).withColumn("summary", F.concat(
            F.size("source_units").cast("string"), F.lit(" parts, "),
            F.col("source_entry_count").cast("string"), F.lit(" orders")))
        out.append(below.select(*out[0].columns))
    return ingest.union_sources(*out)


B.VIEW_SQL["stream_day"] = """
SELECT o_orderpriority AS stream, strftime(o_orderdate, '%Y-%m-%d') AS period_start,
       strftime(o_orderdate, '%Y-%m-%d') AS period_end, count(*) AS n FROM orders GROUP BY ALL"""
B.VIEW_SQL["stream_week"] = """
SELECT stream, min(period_start) AS period_start, max(period_end) AS period_end, sum(n) AS n,
       count(*) || ' parts, ' || sum(n) || ' orders' AS summary
FROM stream_day GROUP BY stream, strftime(CAST(period_start AS DATE), '%G-W%V')"""
B.VIEW_SQL["stream_month"] = f"""
SELECT stream, substr(u.period_start, 1, 7) AS period_start, max_by(u.period_end, u.period_start) AS period_end,
       count(*) || ' parts, ' || sum(n) || ' orders' AS summary,
       string_agg('[' || u.period_start || ' — ' || u.period_end || E']\\nSummary: ' || u.summary, {RULE}
                  ORDER BY u.period_start) AS entries
FROM stream_week u GROUP BY stream, substr(u.period_start, 1, 7)"""


def quote(system: str, user: str) -> str:
    """A stand-in model whose reply depends on every letter of the prompt."""
    return f"SUMMARY: {hashlib.md5(user.encode()).hexdigest()} of {len(user)}"


# Two months of every six are stored, so the others come in runs of four.
@query("describe_waves", f"""WITH RECURSIVE m AS (SELECT stream, period_start, period_end, summary, entries,
    CAST(period_start[6:7] AS INTEGER) % 6 >= 2 AS asked,
    row_number() OVER (PARTITION BY stream ORDER BY period_start) AS i FROM stream_month),
  chain AS (SELECT stream, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS before, CAST(NULL AS VARCHAR) AS last,
      CAST(NULL AS VARCHAR) AS period_start, CAST(NULL AS VARCHAR) AS told, false AS asked
    FROM (SELECT DISTINCT stream FROM m)
  UNION ALL SELECT stream, i, before, '[' || period_start || ' — ' || period_end || E']\\nSummary: ' || told,
      period_start, told, asked
    FROM (SELECT stream, i, last AS before, period_start, period_end, asked,
        CASE WHEN asked THEN md5(prompt) || ' of ' || length(prompt) ELSE summary END AS told
      FROM (SELECT m.*, c.last, m.period_start || E'\\n' || CASE WHEN c.last IS NULL THEN '(nothing recorded before)'
          WHEN c.before IS NULL THEN c.last ELSE c.before || {RULE} || c.last END || E'\\n>>' || entries AS prompt
        FROM chain c JOIN m ON m.stream = c.stream AND m.i = c.i + 1)))
SELECT stream, period_start, told AS summary FROM chain WHERE asked""")
def _(s, d):
    """Months whose prompts quote the replies of the months before them, stream by stream."""
    units = stream_units(s, d)
    asked = (F.col("level") == "month") & (F.substring("period_start", 6, 2).cast("int") % 6 >= 2)
    describe = hierarchy.describe_with(quote, units.limit(0), {"month_historical": "{date}\n{history}\n>>{entries}"},
                                       SYSTEM, 2, keys=STREAM)
    pending = units.filter(asked).drop("summary")
    return describe("month", pending, units.filter(~asked)).select("stream", "period_start", "summary")


@query("resumed_calls", """SELECT conv_id, turn, CASE WHEN min(conv_id % 2) OVER (PARTITION BY text) = 0
  THEN 'first ' ELSE 'second ' END || md5(text) AS reply FROM conversations WHERE text IS NOT NULL""")
def _(s, d):
    """A run over half of the messages, then one over all: only what has no answer is asked."""
    journal = _folder(s)
    rows = B.table(s, d, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", "text")

    def model(run: str):
        return lambda system, user: f"{run} {hashlib.md5(user.encode()).hexdigest()}"

    half = models.apply_model(rows.filter("conv_id % 2 = 0"), model("first"), SYSTEM, "text", journal=journal)
    half.agg(F.count("reply")).first()
    done = models.apply_model(rows, model("second"), SYSTEM, "text", journal=journal)
    return done.select("conv_id", "turn", "reply")
