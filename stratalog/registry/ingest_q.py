"""Queries of the ingest operators."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from stratalog.functions import text as X
from stratalog.operators import ingest as I
from stratalog.registry import base as B
from stratalog.registry.base import query
from stratalog.schema import DEFAULT_CATEGORIES
from stratalog.sources import readers

LINE = ("'[' || time || ' - ' || CASE WHEN role IN ('user', 'assistant') THEN role "
        "ELSE 'user' END || ']: ' || text")
PAGED = f"""SELECT date, time, id, line, coalesce(sum(length(line) + 2) OVER (PARTITION BY date
  ORDER BY time, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 4000000 AS page
FROM (SELECT *, {LINE} AS line FROM raw_entry)"""

query("filter_roles", "SELECT id, date, time, role FROM raw_entry WHERE role IN ('user', 'system')")(
    lambda s, d: I.filter_roles(B.raw_entry(s, d), ["user", "system"]).select(
        "id", "date", "time", "role"))

query("filter_dates", """SELECT id, date FROM raw_entry
WHERE date >= '2024-03-01' AND date <= '2025-02-28'""")(
    lambda s, d: I.filter_dates(B.raw_entry(s, d), "2024-03-01", "2025-02-28").select("id", "date"))

query("filter_nonempty", r"""SELECT page_id, text FROM (SELECT page_id, regexp_replace(
  regexp_extract(html, '<h1>(.*?)</h1>', 1), '^\s+|\s+$', '', 'g') AS text FROM pages)
WHERE text <> ''""")(
    lambda s, d: I.filter_nonempty(B.table(s, d, "pages").select(
        "page_id", F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("text"))))

query("filter_titles", """SELECT DISTINCT source_file AS title, date FROM raw_entry
WHERE source_file IN (SELECT source_file FROM raw_entry WHERE role = 'system')""")(
    lambda s, d: I.filter_titles(
        B.raw_entry(s, d).select(F.col("source_file").alias("title"), "date").distinct(),
        B.raw_entry(s, d).filter("role = 'system'").select("source_file")))


@query("filter_categories", """SELECT file, msg_index, category FROM (SELECT *,
  CASE WHEN label LIKE '%/%' THEN NULL ELSE lower(label) END AS category FROM message)
WHERE coalesce(category, 'other') IN ('other', 'therapy')""")
def _(s, d):
    rows = B.message(s, d).withColumn("category", F.when(
        ~F.contains("label", F.lit("/")), F.lower("label")))
    return I.filter_categories(rows, ["other", "therapy"]).select("file", "msg_index", "category")


query("entry_by_id", """SELECT * FROM raw_entry
WHERE id = (SELECT max(id) FROM raw_entry WHERE role = 'user')""")(
    lambda s, d: I.entry_by_id(B.raw_entry(s, d), _last_user_id(s, d)))


def _last_user_id(s, d):
    return B.raw_entry(s, d).filter("role = 'user'").agg(F.max("id")).first()[0]


@query("apply_defaults", """SELECT event_id, coalesce(json_extract_string(props, '$.time'), '00:00:00') AS time,
  coalesce(CASE WHEN event_type <> 'error' THEN event_type END, 'unknown') AS source,
  '' AS source_file, 'user' AS role, '' AS text FROM events""")
def _(s, d):
    return I.apply_defaults(B.table(s, d, "events").select(
        "event_id", F.get_json_object("props", "$.time").alias("time"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("source")))


query("entry_id", "SELECT id, date, time, source_file FROM raw_entry")(
    lambda s, d: B.raw_entry(s, d).select("id", "date", "time", "source_file"))


@query("turns_to_entries", r"""SELECT substr(datetime_parsed, 1, 10) AS date,
  substr(datetime_parsed, 12) AS time, 'gemini' AS source, file AS source_file, role, text, category
FROM (SELECT datetime_parsed, file, 'user' AS role, trim("user", E' \n\t\r') AS text,
             lower(label) AS category FROM message
      UNION ALL SELECT datetime_parsed, file, 'assistant', trim(response, E' \n\t\r'), lower(label)
      FROM message)
WHERE text <> ''""")
def _(s, d):
    return I.turns_to_entries(B.message(s, d).withColumn("category", F.lower("label")), "gemini",
                              "file")


query("union_sources", """SELECT 'conversation' AS source, id, date, text FROM raw_entry
UNION ALL SELECT 'message', NULL, substr(datetime_parsed, 1, 10), "user" FROM message""")(
    lambda s, d: I.union_sources(
        B.raw_entry(s, d).select("source", "id", "date", "text"),
        B.message(s, d).select(F.lit("message").alias("source"),
                               F.substring("datetime_parsed", 1, 10).alias("date"),
                               F.col("user").alias("text"))))

query("staged_breakdown", """SELECT source, count(*) AS entries FROM (
  SELECT source FROM raw_entry UNION ALL SELECT source FROM documents) GROUP BY source""")(
    lambda s, d: I.staged_breakdown(I.union_sources(
        B.raw_entry(s, d).select("source"), B.table(s, d, "documents").select("source"))))

query("ordered_entries", "SELECT date, time, id, role FROM raw_entry ORDER BY date, time, id")(
    lambda s, d: I.ordered_entries(B.raw_entry(s, d).select("date", "time", "id", "role")))


# --- merge: the user's side is in the store already, all sides are staged --------------


def _store(s, d):
    return B.raw_entry(s, d).filter("role = 'user'")


def _staged(s, d):
    """All entries, the openings of conversations twice."""
    rows = B.raw_entry(s, d)
    return rows.unionByName(rows.filter("time = '08:00:00'")).drop("id")


STAGED = """SELECT * FROM raw_entry UNION ALL SELECT * FROM raw_entry WHERE time = '08:00:00'"""

query("new_entries", f"""SELECT DISTINCT id, date, time, role FROM ({STAGED})
WHERE id NOT IN (SELECT id FROM raw_entry WHERE role = 'user')""")(
    lambda s, d: I.new_entries(I.prepare(_staged(s, d)), _store(s, d)).select(
        "id", "date", "time", "role"))

query("assemble", """SELECT id, date, time, source, source_file, role, text FROM raw_entry
WHERE role = 'user' UNION ALL SELECT DISTINCT id, date, time, source, source_file, role, text
FROM raw_entry WHERE id NOT IN (SELECT id FROM raw_entry WHERE role = 'user')""")(
    lambda s, d: I.assemble(_staged(s, d), _store(s, d)))

query("ingest_stats", f"""WITH staged AS ({STAGED}), known AS (
  SELECT * FROM raw_entry WHERE role = 'user')
SELECT (SELECT count(DISTINCT date) FROM staged WHERE date NOT IN (SELECT date FROM known)) AS new_dates,
       (SELECT count(DISTINCT id) FROM staged WHERE id NOT IN (SELECT id FROM known)) AS appended,
       (SELECT count(*) FROM staged)
         - (SELECT count(DISTINCT id) FROM staged WHERE id NOT IN (SELECT id FROM known))
         AS skipped_duplicates""")(
    lambda s, d: I.ingest_stats(_staged(s, d), _store(s, d)))

query("appended_dates", """SELECT DISTINCT date FROM raw_entry
WHERE id NOT IN (SELECT id FROM raw_entry WHERE role = 'user')""")(
    lambda s, d: I.appended_dates(_staged(s, d), _store(s, d)))


@query("upsert_raw", """SELECT id, date, CASE WHEN role = 'assistant' THEN 'redone' ELSE source END
  AS source, text FROM (SELECT DISTINCT * FROM raw_entry)""")
def _(s, d):
    old = B.raw_entry(s, d)
    return I.upsert_raw(old, old.filter("role = 'assistant'").withColumn(
        "source", F.lit("redone"))).select("id", "date", "source", "text")


@query("upsert_summary", """SELECT level, period_start,
  CASE WHEN emotional_tone = '5-LOW' THEN 'revised' ELSE summary END AS summary FROM day_unit""")
def _(s, d):
    old = B.day_unit(s, d)
    new = old.filter("emotional_tone = '5-LOW'").withColumn("summary", F.lit("revised"))
    return I.upsert_summary(old, new).select("level", "period_start", "summary")


query("dedupe_latest", """SELECT user_id, arg_max(event_type, event_id) AS event_type,
  max(event_id) AS event_id FROM events GROUP BY user_id""")(
    lambda s, d: _latest_event(s, d))


def _latest_event(s, d):
    from stratalog.operators import paging
    rows = B.table(s, d, "events").select("user_id", "event_type", "event_id")
    return paging.latest(rows.withColumn("_at", F.col("event_id")), ["user_id"], "_at").drop("_at")


query("delete_units", "SELECT level, period_start FROM unit WHERE level <> 'week'")(
    lambda s, d: I.delete_units(B.unit(s, d), "week").select("level", "period_start"))


def _doomed(s, d):
    return B.day_unit(s, d).filter("emotional_tone = '5-LOW'").select("level", "period_start")


DOOMED = "SELECT period_start FROM day_unit WHERE emotional_tone = '5-LOW'"

query("invalidate_units", f"""SELECT level, period_start FROM unit
WHERE NOT (level = 'day' AND period_start IN ({DOOMED}))""")(
    lambda s, d: I.invalidate_units(B.unit(s, d), _doomed(s, d)).select("level", "period_start"))

query("invalidated", f"SELECT level, period_start FROM unit WHERE level = 'day' AND period_start IN ({DOOMED})")(
    lambda s, d: I.invalidated(B.unit(s, d), _doomed(s, d)))

query("pending_units", f"""SELECT level, period_start, source_entry_count FROM unit
WHERE NOT (level = 'day' AND period_start IN ({DOOMED}))""")(
    lambda s, d: I.pending_units(B.unit(s, d), _doomed(s, d)).select(
        "level", "period_start", "source_entry_count"))

query("pending_except", f"""SELECT level, period_start FROM unit
EXCEPT SELECT 'day', period_start FROM ({DOOMED})""")(
    lambda s, d: I.pending_except(B.unit(s, d), _doomed(s, d)))


# --- checkpoints -------------------------------------------------------------


@query("changed_files", """SELECT source_file AS path, CAST(max(length(text)) AS DOUBLE) AS mtime
FROM raw_entry GROUP BY 1 HAVING max(length(text)) - coalesce(max(CASE WHEN role = 'user'
  THEN length(text) END), -9) >= 1""")
def _(s, d):
    # A file's mark is its longest text; the manifest was taken when only users had written.
    size = F.max(F.length("text")).cast("double").alias("mtime")
    rows = B.raw_entry(s, d).withColumnRenamed("source_file", "path")
    return I.changed_files(rows.groupBy("path").agg(size),
                           rows.filter("role = 'user'").groupBy("path").agg(size)
                           ).select("path", "mtime")


def _checkpoint(s, d):
    return B.message(s, d).filter("label = 'other'").select("file", "msg_index",
                                                           F.lit("other").alias("category"))


query("unclassified", "SELECT file, msg_index FROM message WHERE label <> 'other'")(
    lambda s, d: I.unclassified(B.message(s, d), _checkpoint(s, d)).select("file", "msg_index"))

query("resume_checkpoint", """SELECT file, msg_index, CASE WHEN label = 'other' THEN 'other'
  ELSE 'new' END AS category FROM message""")(
    lambda s, d: I.resume_checkpoint(_checkpoint(s, d), B.message(s, d).select(
        "file", "msg_index", F.lit("new").alias("category"))))

CATEGORY = """CASE label WHEN 'Coding-Related' THEN 'coding_related' WHEN 'other' THEN 'other'
  WHEN 'therapy' THEN 'self_reflection_psychology_therapy_dating'
  WHEN 'personal' THEN 'other_personal' ELSE 'other' END"""

query("match_category", f"SELECT file, msg_index, {CATEGORY} AS category FROM message")(
    lambda s, d: B.message(s, d).select(
        "file", "msg_index", X.match_category("label", DEFAULT_CATEGORIES).alias("category")))

query("category_counts", f"SELECT {CATEGORY} AS category, count(*) AS messages FROM message GROUP BY 1")(
    lambda s, d: I.category_counts(B.message(s, d).withColumn(
        "category", X.match_category("label", DEFAULT_CATEGORIES))))

query("conversation_stats", """SELECT conv_id, count(*) FILTER (role = 'user') AS message_count,
  strftime(make_timestamp((1700000000 + min(conv_id * 5000 + turn * 60)) * 1000000), '%Y-%m-%d')
  AS date_start FROM conversations GROUP BY conv_id""")(
    lambda s, d: I.conversation_stats(B.table(s, d, "conversations").withColumn(
        "timestamp", F.lit(1_700_000_000) + F.col("conv_id") * 5000 + F.col("turn") * 60),
        ["conv_id"]))


# --- dated lines ---------------------------------------------------------------


def _blocks(s, d):
    from stratalog.plans import models
    lines = readers.split_lines(B.dated_document(s, d), "text")
    return I.forward_fill_dates(models.detect_dates(lines))


query("forward_fill_dates", """SELECT file, CAST(first_line AS INTEGER) AS first_line, datetime_parsed,
  datetime_raw, "user" FROM dated_block""")(lambda s, d: _blocks(s, d).drop("page"))

RESOLVED = """SELECT file, coalesce(datetime_parsed, coalesce(strftime(CAST(f AS DATE) - 1, '%Y-%m-%d'),
    '1970-01-01') || 'T00:00:00') AS datetime_parsed,
  CASE WHEN datetime_parsed IS NULL AND f IS NOT NULL THEN "user" || E'\\n\\n[without a date; filed before '
    || f || ']' ELSE "user" END AS "user"
FROM (SELECT *, min(substr(datetime_parsed, 1, 10)) OVER (PARTITION BY file) AS f FROM dated_block)"""

query("resolve_undated", RESOLVED)(
    lambda s, d: I.resolve_undated(_blocks(s, d)).select("file", "datetime_parsed", "user"))

query("line_dated_entries", f"""SELECT substr(datetime_parsed, 1, 10) AS date, '00:00:00' AS time,
  'old_diary' AS source, 'user' AS role, trim("user", E' \\n\\t\\r') AS text
FROM ({RESOLVED.replace("dated_block", "shelf_block")})""")(
    lambda s, d: _read_lines(s, d))


def _read_lines(s, d):
    """The documents in eight texts, read back by lines; a date holds until the next one.

    A text is a folder of files, written by as many tasks as Spark deals its sorted rows to.
    """
    from stratalog.registry.source_q import _folder
    path = _folder(s)
    shelf = F.pmod(F.col("file").cast("long"), F.lit(8)).alias("shelf")
    (B.dated_document(s, d).select(shelf, F.col("file").cast("long").alias("n"), "text")
     .repartitionByRange("shelf", "n").sortWithinPartitions("shelf", "n").drop("n")
     .write.partitionBy("shelf").text(path))
    return readers.read_line_dated_text(s, path, folders=True).drop("source_file")


query("detect_dates", "SELECT file, CAST(line_no AS INTEGER) AS line_no, anchor FROM dated_line")(
    lambda s, d: _detected(s, d))


def _detected(s, d):
    from stratalog.plans import models
    return models.detect_dates(readers.split_lines(B.dated_document(s, d), "text")).select(
        "file", "line_no", "anchor")


def _dates(system: str, line: str) -> str:
    """A stand-in model that answers with the date a line begins with, or in words."""
    return line[:10] if re.match(r"[0-9]{4}-[0-9]{2}-[0-9]{2}\b", line) else "no date here"


@query("detect_dates_model", "SELECT file, CAST(line_no AS INTEGER) AS line_no, anchor FROM dated_line")
def _(s, d):
    from stratalog.plans import models
    from stratalog.registry.source_q import _folder
    lines = readers.split_lines(B.dated_document(s, d), "text")
    return models.detect_dates(lines, _dates, journal=_folder(s)).select("file", "line_no", "anchor")


@query("apply_date_overrides", """SELECT file, msg_index, CASE label WHEN 'therapy' THEN NULL
  WHEN 'personal' THEN '2022-02-02T00:00:00' ELSE datetime_parsed END AS datetime_parsed FROM message""")
def _(s, d):
    rows = B.message(s, d)
    wanted = (F.when(F.col("label") == "therapy", " none ")
              .when(F.col("label") == "personal", "2022-02-02").when(F.col("label") == "n/a", "soon"))
    fixes = rows.select("file", "msg_index", wanted.alias("new_date")).filter("new_date IS NOT NULL")
    return I.apply_date_overrides(rows, fixes, ["file", "msg_index"]).select(
        "file", "msg_index", "datetime_parsed")


# --- days ----------------------------------------------------------------------

query("day_rollup", f"""SELECT date, count(*) AS entries,
  CAST(sum(length({LINE})) + 2 * (count(*) - 1) AS BIGINT) AS chars,
  string_agg(DISTINCT source, ',') AS sources FROM raw_entry GROUP BY date""")(
    lambda s, d: I.day_rollup(B.raw_entry(s, d)))

query("combined_text", f"""SELECT date, CAST(page AS BIGINT) AS page, count(*) AS n,
  length(string_agg(line, E'\\n\\n' ORDER BY time, id)) AS chars,
  string_agg(line, E'\\n\\n' ORDER BY time, id) AS text FROM ({PAGED}) GROUP BY date, page""")(
    lambda s, d: I.day_text(B.raw_entry(s, d)).drop("start"))

query("load_days", f"""SELECT date, CAST(page AS BIGINT) AS page, count(*) AS n,
  string_agg(time || ' ' || role || ' ' || source_file || ' ' || text, ' / ' ORDER BY time, id) AS entries
FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY date ORDER BY time, id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 4000000 AS page
      FROM raw_entry WHERE role IN ('user', 'assistant')) GROUP BY date, page""")(
    lambda s, d: I.load_days(B.raw_entry(s, d), ["user", "assistant"]).withColumn(
        "entries", F.array_join(F.transform("entries", lambda e: F.concat_ws(
            " ", e["time"], e["role"], e["source_file"], e["text"])), " / ")))

query("export_metadata", """SELECT count(DISTINCT date) AS total_days, count(*) AS total_entries,
  min(date) AS first_date, max(date) AS last_date, '2.0' AS format_version FROM raw_entry""")(
    lambda s, d: _metadata(s, d))


def _metadata(s, d):
    from stratalog.sources import writers
    return writers.merged_metadata(B.raw_entry(s, d))
