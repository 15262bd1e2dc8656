"""Queries that write given tables in a file format and read them back, and whole model runs."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratalog.functions import periods as P, text as X
from stratalog.plans import hierarchy, models, pipeline, prompts
from stratalog.registry import base as B
from stratalog.registry.base import ORACLES, query
from stratalog.registry.context_q import CTX, DAYS, LINE, RULE, SYSTEM
from stratalog.session import shared_folder
from stratalog.sources import readers, writers


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _one_per_file(df: DataFrame, path: str) -> str:
    """A JSON file per row, written by all cores: the files, not the bytes, take the time."""
    n = 4 * df.sparkSession.sparkContext.defaultParallelism
    df.repartition(n).write.option("maxRecordsPerFile", 1).json(path)
    return path


def _days(s, d) -> DataFrame:
    body = F.struct("time", "source", "source_file", "role", "text")
    return B.raw_entry(s, d).groupBy("date").agg(F.collect_list(body).alias("entries"))


ENTRY = "date, time, source, source_file, role, trim(text, E' \\n\\t\\r') AS text"
NOT_BLANK = "trim(text, E' \\n\\t\\r') <> ''"

query("merged_export", f"SELECT {ENTRY} FROM raw_entry WHERE {NOT_BLANK}")(
    lambda s, d: _merged(s, d))


def _merged(s, d):
    path = _folder(s)
    writers.export_merged(B.raw_entry(s, d), path)
    return readers.read_merged_json(s, path, lines=True)


def _one_document(df: DataFrame, path: str, lead: str, tail: str) -> str:
    """Rows of one JSON column as the elements of a single document in a single file."""
    rows = df.select(F.lit(1).alias("o"), F.concat(F.col("value"), F.lit(",")).alias("value"))
    ends = df.sparkSession.createDataFrame([(0, lead), (2, "null" + tail)], "o INT, value STRING")
    ends.unionByName(rows).coalesce(1).sortWithinPartitions("o").select("value").write.text(path)
    return path


query("merged_documents", f"SELECT {ENTRY} FROM raw_entry WHERE {NOT_BLANK}")(
    lambda s, d: readers.read_merged_json(s, _one_document(
        _days(s, d).select(F.to_json(F.struct("date", "entries")).alias("value")), _folder(s),
        '{"version": "1 {", "entries": [', "]}")))

query("split_documents", f"SELECT {ENTRY} FROM raw_entry WHERE {NOT_BLANK}")(
    lambda s, d: readers.read_split_json(s, _one_per_file(_days(s, d), _folder(s))))


@query("csv_documents", """SELECT strftime(DATE '2020-01-01' + CAST(doc_id % 900 AS INTEGER), '%Y-%m-%d') AS date,
  trim(text, E' \\n\\t\\r') AS text FROM documents WHERE trim(text, E' \\n\\t\\r') <> ''""")
def _(s, d):
    path = _folder(s)
    day = P.date_text(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 900).cast("int")))
    (B.table(s, d, "documents").select(day.alias("date"), "text").write.option("header", True)
     .option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return readers.read_dated_csv(s, path).select("date", "text")


def _chats(s, d) -> DataFrame:
    message = F.struct("role", F.col("text").alias("content"),
                       (F.lit(1_700_000_000) + F.col("conv_id") * 86_400 + F.col("turn") * 60)
                       .cast("string").alias("timestamp"))
    return B.table(s, d, "conversations").groupBy("conv_id").agg(
        F.collect_list(message).alias("messages")).select(
            F.concat(F.lit("conversation "), "conv_id").alias("title"),
            F.struct("messages").alias("chat"))


query("chat_documents", """SELECT title, strftime(t, '%Y-%m-%d') AS date, strftime(t, '%H:%M:%S') AS time, role, text
FROM (SELECT 'conversation ' || conv_id AS title, role, trim(text, E' \\n\\t\\r') AS text,
        epoch_ms((1700000000 + conv_id * 86400 + turn * 60) * 1000) AS t FROM conversations
      WHERE role IN ('user', 'assistant')) WHERE text <> ''""")(
    lambda s, d: readers.read_chat_export(s, _one_document(
        _chats(s, d).select(F.to_json(F.struct("title", "chat")).alias("value")), _folder(s), "[", "]")).select(
        "title", "date", "time", "role", "text"))

query("route_sources", """SELECT 'chat' AS kind, count(DISTINCT conv_id) AS files FROM conversations""")(
    lambda s, d: readers.route_sources(s, _one_per_file(_chats(s, d), _folder(s))).groupBy("kind").agg(
        F.count(F.lit(1)).alias("files")))


@query("turn_cache", """SELECT datetime_parsed, trim("user", E' \\n\\t\\r') AS "user" FROM message
WHERE trim("user", E' \\n\\t\\r') <> ''""")
def _(s, d):
    path = _folder(s)
    writers.write_turn_cache(B.message(s, d).withColumn("datetime_raw", F.col("datetime_parsed")), path)
    return readers.read_preparsed_json(s, path, lines=True).select("datetime_parsed", "user")


@query("legacy_tree", """SELECT 'raw_entry' AS "table", count(*) AS rows FROM raw_entry
UNION ALL SELECT 'summary', count(*) FROM day_unit UNION ALL SELECT 'entity_profile', count(*) FROM supplier""")
def _(s, d):
    root = _folder(s)
    _one_per_file(_days(s, d), f"{root}/raw_entries")
    _one_per_file(B.day_unit(s, d).select("period_start", "period_end", "summary"), f"{root}/summaries/day")
    _one_per_file(B.table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"),
                                                   F.col("s_name").alias("display_name")),
                  f"{root}/entity_profiles")
    return readers.legacy_counts(readers.read_legacy_tree(s, root))


@query("alias_map_file", None)
def _(s, d):
    path = _folder(s)
    writers.write_entity_index(B.mention(s, d), path)
    return writers.read_alias_map(s, path).select("alias", "id")


ORACLES["alias_map_file"] = ORACLES["alias_map"]


@query("dossier_file", """SELECT name AS label, d AS period_start, segment AS note FROM (
  SELECT c_name AS name, c_mktsegment AS segment, '2024-01-01' AS d FROM customer) WHERE name LIKE '%7'""")
def _(s, d):
    path = _folder(s)
    rows = B.table(s, d, "customer").select(
        F.concat(F.lit("group "), F.substring("c_name", -1, 1)).alias("label"),
        F.lit("2024-01-01").alias("period_start"), F.col("c_mktsegment").alias("note"), "c_name")
    writers.write_dossiers(rows, path)
    return writers.read_dossier(s, path, "group 7", writers.DOSSIER + ", c_name STRING").select(
        F.col("c_name").alias("label"), "period_start", "note")


@query("profile_table", """SELECT CAST(s_suppkey AS VARCHAR) AS id,
  CASE WHEN s_suppkey % 2 = 0 THEN 'renamed' ELSE s_name END AS display_name FROM supplier""")
def _(s, d):
    """All profiles are written, then every second one again with another name."""
    path = _folder(s)
    rows = B.table(s, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("display_name"),
        F.array("s_name").alias("aliases"))
    writers.write_profiles(rows, path)
    writers.write_profiles(rows.filter(F.col("id").cast("long") % 2 == 0).withColumn(
        "display_name", F.lit("renamed")), path)
    return writers.read_table(s, path).select("id", "display_name")


@query("bucketed_export", "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS display_name FROM supplier")
def _(s, d):
    path = _folder(s)
    writers.export_bucketed(B.table(s, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("display_name")), path, "id")
    return s.read.schema("id STRING, display_name STRING").json(path).select("id", "display_name")


@query("split_export", "SELECT date, time, source, source_file, role, text FROM raw_entry")
def _(s, d):
    """Entries as one folder of JSON per date, read back."""
    path = _folder(s)
    writers.export_split(B.raw_entry(s, d).drop("id"), path, "date")
    body = "date STRING, time STRING, source STRING, source_file STRING, role STRING, text STRING"
    return s.read.text(path).select(F.from_json("value", body).alias("e")).select("e.*")


@query("usage_file", """SELECT model, CAST(char_count AS BIGINT) AS char_count, CASE WHEN char_count > 0 AND actual_input_tokens > 0
  THEN round(char_count / CAST(actual_input_tokens AS DOUBLE), 4) END AS empirical_ratio FROM call_log""")
def _(s, d):
    """The call log appended to CSV files in two runs and read back."""
    path = _folder(s)
    calls = B.call_log(s, d).select(
        F.lit("t").alias("timestamp"), "model", F.lit(0).alias("estimated_input_tokens"),
        F.col("actual_input_tokens").cast("int").alias("actual_input_tokens"),
        F.lit(0).alias("actual_output_tokens"), F.col("char_count").cast("int").alias("char_count"), "doc_id")
    for odd in (0, 1):
        writers.append_usage(calls.filter(F.col("doc_id") % 2 == odd).drop("doc_id"), path)
    return s.read.csv(path, header=True).select(
        "model", F.col("char_count").cast("long").alias("char_count"),
        F.col("empirical_ratio").cast("double").alias("empirical_ratio"))


@query("incremental_run", None)
def _(s, d):
    """Two exports ingested one after the other: the units equal those of one run over everything."""
    root, store = _folder(s), _folder(s)
    day = F.date_add(F.lit("2023-12-25").cast("date"), (F.col("conv_id") * 3 % 730).cast("int"))
    message = F.struct("role", F.col("text").alias("content"), (F.unix_date(day).cast("long") * 86_400 + 8 * 3600
                       + F.col("turn") * 300).cast("string").alias("timestamp"))
    chats = B.table(s, d, "conversations").groupBy("conv_id").agg(
        F.collect_list(message).alias("messages")).select(
            "conv_id", F.concat(F.lit("conversation "), "conv_id").alias("title"), F.struct("messages").alias("chat"))
    units = manifest = None
    for part in (0, 1):
        chats.filter(F.col("conv_id") % 2 == part).drop("conv_id").coalesce(1).write.mode("append").json(root)
        run = pipeline.run_ingest(s, root, store, manifest)
        units, manifest = pipeline.update_units(s, store, units, run.dates), run.manifest
    return units.select("level", "period_start", "period_end", "source_units", "source_entry_count").withColumn(
        "source_units", F.array_join("source_units", ","))


# Messages of users and assistants with text; of equal ones at one time there is one entry.
ORACLES["incremental_run"] = re.sub(
    r"raw_entry AS \(.*?FROM conversations\)\n\)", lambda m: m[0].replace("raw_entry AS (", "every_entry AS (")
    + """, raw_entry AS (SELECT DISTINCT date, time, 'owui' AS source, role, trim(text, E' \\n\\t\\r') AS text
  FROM every_entry WHERE role IN ('user', 'assistant') AND trim(text, E' \\n\\t\\r') <> '')""",
    ORACLES["hierarchy"], flags=re.S)


# --- runs with a model ---------------------------------------------------------------------


@query("paged_day_run", f"SELECT date, text FROM ({DAYS})")
def _(s, d):
    """Days as pages of a small window; the pages of a day hold its whole text."""
    asked = prompts.day_prompts(B.raw_entry(s, d), "{date}\n>>{entries}<<", SYSTEM, 0, 3600, 1024)
    own = F.regexp_replace(F.regexp_extract("prompt", r"(?s)>>(.*)<<$", 1),
                           r"^\(part [0-9]+ of [0-9]+\)\n", "")
    return asked.select("date", "page", own.alias("own")).groupBy("date").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("page", "own"))), lambda p: p["own"]), "\n\n").alias("text"))


ENTRY_HEAD = r"(?m)^\[([0-9:]+) - (user|assistant)\]: "
FIELDS_TEMPLATE, FIELDS_WINDOW = "{date}\n>>{entries}<<", 3600
# Characters a day may have in one prompt; the pages of a longer one start at half of that.
FIELDS_ROOM = (int((FIELDS_WINDOW - 1024 - prompts.DAY_RESERVE) * X.CHARS_PER_TOKEN) - len(SYSTEM) - 1
               - len("\n>><<") - 10 - len("(none)") - len(prompts.PART_NOTE))


def list_entries(system: str, user: str) -> str:
    """A stand-in model: one event per entry of the prompt, and per role a note on its entries there."""
    heads = re.findall(ENTRY_HEAD, user.split(">>", 1)[1])
    times = {role: [t for t, r in heads if r == role] for _, role in heads}
    return ("KEY_EVENTS:\n" + "".join(f"- {t} {role}\n" for t, role in heads) + "ENTITIES:\n"
            + "".join(f"- [{role}]: {len(t)} from {t[0]} to {t[-1]}\n" for role, t in times.items()))


@query("paged_day_fields", f"""WITH l AS (SELECT date, time, id, {LINE} AS line,
    CASE WHEN role = 'assistant' THEN role ELSE 'user' END AS who FROM raw_entry),
  t AS (SELECT *, row_number() OVER w AS k, sum(length(line) + 2) OVER w - length(line) - 2 AS start,
      sum(length(line) + 2) OVER (PARTITION BY date) - 2 AS whole
    FROM l WINDOW w AS (PARTITION BY date ORDER BY time, id ROWS UNBOUNDED PRECEDING)),
  p AS (SELECT *, CASE WHEN whole <= {FIELDS_ROOM} THEN 0 ELSE start // {FIELDS_ROOM // 2} END AS page FROM t),
  e AS (SELECT date, string_agg(event, '|' ORDER BY k) AS events FROM (
      SELECT date, time || ' ' || who AS event, min(k) AS k FROM p GROUP BY ALL) GROUP BY date),
  n AS (SELECT date, who, string_agg(note, E'\n' ORDER BY page) AS note FROM (
      SELECT date, who, note, min(page) AS page FROM (
        SELECT date, who, page, count(*) || ' from ' || min(time) || ' to ' || max(time) AS note
        FROM p GROUP BY date, who, page) GROUP BY ALL) GROUP BY date, who)
SELECT e.date, events, u.note AS of_user, a.note AS of_assistant FROM e
LEFT JOIN n u ON u.date = e.date AND u.who = 'user' LEFT JOIN n a ON a.date = e.date AND a.who = 'assistant'""")
def _(s, d):
    """Days described page by page in a small window: lists and maps hold what every page told."""
    rows = B.raw_entry(s, d)
    describe = hierarchy.describe_with(list_entries, rows, {"day_isolated": FIELDS_TEMPLATE}, SYSTEM, 0,
                                       FIELDS_WINDOW)
    notes = [F.try_element_at("entities", F.lit(who)).alias(f"of_{who}") for who in ("user", "assistant")]
    return hierarchy.run_hierarchy(rows, levels=("day",), describe=describe).select(
        F.col("period_start").alias("date"), F.array_join("key_events", "|").alias("events"), *notes)


ORACLES["describe_run"] = f"SELECT level, period_start, true AS told FROM ({ORACLES['hierarchy']})"


@query("describe_run", None)
def _(s, d):
    """All levels with the stand-in model, grandchildren offered; every unit gets a summary.

    Months and years tell of the months and years before them, which takes a wave each; weeks, of
    which there are a hundred in a row, stand alone here (for their kind see ``describe_waves``).
    """
    rows = B.raw_entry(s, d)
    templates = {"day_historical": "{date}\n{history}\n{entries}",
                 "week_isolated": "{date}\n{entries}\n{grandchild_items}",
                 **{f"{level}_historical": "{date}\n{history}\n{entries}\n{grandchild_items}"
                    for level in ("month", "year")}}
    describe = hierarchy.describe_with(models.stub_model, rows, templates, SYSTEM, 2)
    return hierarchy.run_hierarchy(rows, describe=describe).select(
        "level", "period_start", F.col("summary").isNotNull().alias("told"))


@query("level_prompts_incremental", f"""WITH st AS (SELECT period_start, {CTX} AS ctx FROM month_unit
    WHERE CAST(period_start[6:7] AS INTEGER) % 2 = 0),
  p AS (SELECT m.period_start, st.period_start AS prior, ctx, row_number() OVER (
      PARTITION BY m.period_start ORDER BY st.period_start DESC) AS k
    FROM month_unit m JOIN st ON st.period_start < m.period_start
    WHERE CAST(m.period_start[6:7] AS INTEGER) % 2 = 1)
SELECT period_start, string_agg(ctx, {RULE} ORDER BY prior) AS history FROM p WHERE k <= 2
GROUP BY period_start""")
def _(s, d):
    """Even months are stored, odd ones asked for: their history is the stored ones before."""
    units = B.unit(s, d)
    odd = F.substring("period_start", 6, 2).cast("int") % 2 == 1
    month = F.col("level") == "month"
    stored = units.filter(~month | ~odd)
    told = prompts.level_history(units.filter(month & odd), stored, "month", 2)
    first = stored.filter(month).agg(F.min("period_start")).first()[0]
    return told.filter(F.col("period_start") > first)
