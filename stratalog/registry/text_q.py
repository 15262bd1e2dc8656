"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.functions import text as X
from stratalog.registry import base as B
from stratalog.registry.base import query
from stratalog.sources import readers


def _thinking(s, d):
    text = F.concat(F.lit("<think>"), F.col("source"), F.lit("\n?</think>"), F.col("text"),
                    F.lit("<THINK>second</think> "))
    return B.table(s, d, "documents").select("doc_id", text.alias("raw"))


query("strip_thinking", r"""SELECT doc_id, trim(text, E' \n\t\r') AS clean, source || E'\n?' AS trace
FROM documents""")(
    lambda s, d: _thinking(s, d).select("doc_id", X.strip_thinking("raw").alias("clean"),
                                        X.thinking_trace("raw").alias("trace")))

query("strip_reasoning", r"""SELECT doc_id, trim(text, E' \n\t\r') AS clean FROM documents""")(
    lambda s, d: B.table(s, d, "documents").select("doc_id", X.strip_reasoning(F.concat(
        F.lit('<details type="reasoning" done="true">\nhm </details>\n'), F.col("text")))
        .alias("clean")))

query("clean_text", r"""SELECT doc_id, trim(regexp_replace(text, '[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS clean
FROM documents""")(
    lambda s, d: B.table(s, d, "documents").select("doc_id", X.clean_text("text").alias("clean")))

query("html_to_text", r"""SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'),
  '&#39;', ''''), '&quot;', '"'), '[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g') AS text FROM pages""")(
    lambda s, d: B.table(s, d, "pages").select("page_id", X.html_to_text("html").alias("text")))

query("parse_datetime", """SELECT o_orderkey, strftime(o_orderdate + to_seconds(o_custkey), '%Y-%m-%dT%H:%M:%S')
  AS at FROM orders""")(
    lambda s, d: _datetimes(s, d))


def _datetimes(s, d):
    at = F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_custkey").cast("decimal(18,6)"))
    even = F.col("o_orderkey") % 2 == 0
    text = F.when(even, F.concat(F.date_format(at, "MMM d, yyyy, h:mm:ss a"), F.lit(" EET"))
                  ).otherwise(F.date_format(at, "MMMM d, yyyy, H:mm:ss"))
    return B.table(s, d, "orders").select(
        "o_orderkey", X.iso_datetime(X.parse_datetime(text)).alias("at"))


query("estimate_tokens", """SELECT source_id, char_count, estimated_tokens, round(fraction, 6) AS usage_fraction,
  CASE WHEN fraction < 0.5 THEN 'ok' WHEN fraction < 0.8 THEN 'warn' ELSE 'danger' END AS status,
  CASE WHEN fraction < 0.5 THEN '✓ Within budget' WHEN fraction < 0.8 THEN '⚠ Approaching limit'
    ELSE '✗ May exceed context window' END AS status_label
FROM (SELECT *, estimated_tokens / CAST(976 AS DOUBLE) AS fraction FROM (SELECT source_id,
  length(content) AS char_count, CAST(trunc(length(content) / CAST(3.2 AS DOUBLE)) AS BIGINT)
  AS estimated_tokens FROM corpus))""")(
    lambda s, d: B.corpus(s, d).select("source_id", X.token_estimate("content", 2000, 1024)
                                       .alias("_e")).select("source_id", "_e.*").withColumn(
        "usage_fraction", F.round("usage_fraction", 6)))

query("context_size", """SELECT level, period_start, CAST(CASE level WHEN 'day' THEN 65536 WHEN 'week' THEN 262144
  ELSE 32768 END AS BIGINT) AS size FROM unit""")(
    lambda s, d: B.unit(s, d).select("level", "period_start", X.context_size(
        F.when(F.col("level") == "day", "64k").when(F.col("level") == "week", "256k")
        .otherwise(F.col("level"))).alias("size")))

query("safe_label", r"""SELECT DISTINCT url, regexp_replace(url, '[^\p{L}\p{N}_-]', '_', 'g') AS label FROM pages""")(
    lambda s, d: B.table(s, d, "pages").select("url", X.safe_label("url").alias("label")).distinct())

query("left_chars", """SELECT file, msg_index, substr("user", 1, 600) AS u, substr(response, 1, 400) AS r
FROM message""")(
    lambda s, d: B.message(s, d).select("file", "msg_index", X.left_chars("user", 600).alias("u"),
                                        X.left_chars("response", 400).alias("r")))

FOLD = r"'[\s\x{0B}\x{A0}]+', ' ', 'g'"


@query("activity_turns", rf"""SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY msg_index) - 1
    AS INTEGER) AS msg_index, datetime_parsed,
  trim(regexp_replace("user", {FOLD})) AS "user",
  trim(regexp_replace(coalesce(response, ''), {FOLD})) AS response
FROM message""")
def _(s, d):
    """Turns written as activity pages, one per conversation, and read back."""
    shown = F.date_format(F.to_timestamp("datetime_parsed"), "MMM d, yyyy, h:mm:ss a")

    def escape(c):
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"),
                                   F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    cell = F.concat(
        F.lit('<div class="outer-cell"><div class="content-cell">Prompted&nbsp;'),
        escape(F.col("user")), F.lit("<br>"), shown, F.lit(" UTC<p>"),
        escape(F.coalesce("response", F.lit(""))),
        F.lit("</p>This activity was saved to your Google Account</div></div>"))
    pages = B.message(s, d).groupBy("file").agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("msg_index", cell.alias("cell")))), lambda r: r["cell"]), "\n")
        .alias("html"))
    return readers.activity_turns(pages).select("file", "msg_index", "datetime_parsed", "user",
                                                "response")


@query("activity_paragraphs", rf"""WITH m AS (SELECT file, msg_index, datetime_parsed,
    trim(regexp_replace("user", {FOLD})) AS q, trim(regexp_replace(coalesce(response, ''), {FOLD})) AS r FROM message)
SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY msg_index) - 1 AS INTEGER) AS msg_index,
  datetime_parsed, q || '.' AS "user",
  CASE msg_index % 3 WHEN 0 THEN trim(r || ' Head item item inner inner & more')
    WHEN 1 THEN trim(r || ' outside') ELSE trim('aside ' || r) END AS response
FROM m""")
def _(s, d):
    """Turns of chats with a gem: the response is in paragraphs, headings and lists, or only in flat text."""
    shown = F.date_format(F.to_timestamp("datetime_parsed"), "MMM d, yyyy, h:mm:ss a")

    def escape(c):
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"),
                                   F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    told = escape(F.coalesce("response", F.lit("")))
    kind = F.col("msg_index") % 3
    body = (F.when(kind == 0, F.concat(
        F.lit(" UTC<div title='Prompted'>not told<p>"), told, F.lit(
            "</p>nor this<br><h3>Head</h3><ul><li>item</li><li><b>item</b> <p>inner</p></li></ul>"
            "<p>&amp; <i>more</i></p></div>")))
        .when(kind == 1, F.concat(F.lit(" UTC<div>"), told, F.lit(" <b>outside</b></div>")))
        .otherwise(F.concat(F.lit(" UTC<div>aside </div><span>"), told, F.lit("</span><p>"))))
    cell = F.concat(
        F.lit('<div class="outer-cell"><div class="content-cell">Prompted&nbsp;'), escape(F.col("user")),
        F.lit(". My Gem was used in this chat. Manage your Gems.<br>"), shown, body,
        F.lit("<div>This activity was saved to your Google Account</div><p>settings</p></div></div>"))
    pages = B.message(s, d).groupBy("file").agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("msg_index", cell.alias("cell")))), lambda r: r["cell"]), "\n")
        .alias("html"))
    return readers.activity_turns(pages).select("file", "msg_index", "datetime_parsed", "user", "response")
