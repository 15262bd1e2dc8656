"""Derived views of the test tables, in Spark and in SQL, and the query registry."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratalog.functions import periods as P
from stratalog.operators import ingest, periods

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- views -------------------------------------------------------------------


def raw_entry(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as entries; dates leave gaps and cross ISO years."""
    c = table(spark, sf, "conversations")
    day = F.date_add(F.lit("2023-12-25").cast("date"), (F.col("conv_id") * 3 % 730).cast("int"))
    at = F.timestamp_seconds(F.lit(8 * 3600) + F.col("turn") * 300)
    return ingest.with_entry_id(c.select(
        P.date_text(day).alias("date"), F.date_format(at, "HH:mm:ss").alias("time"),
        F.lit("conversation").alias("source"),
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit(".json"))
        .alias("source_file"), "role", "text"))


def message(spark: SparkSession, sf: str) -> DataFrame:
    """A user turn with the turn that follows it, dated, with a free-form label."""
    from pyspark.sql import Window
    c = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    day = F.date_add(F.lit("2023-12-25").cast("date"), (F.col("conv_id") * 3 % 730).cast("int"))
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]),
                         ((F.col("conv_id") + F.col("turn")) % len(LABELS) + 1).cast("int"))
    rows = c.withColumn("response", F.lead("text").over(w)).filter("role = 'user'")
    return rows.select(
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit(".json")).alias("file"),
        F.col("turn").alias("msg_index"),
        F.concat(P.date_text(day), F.lit("T09:00:00")).alias("datetime_parsed"),
        F.col("text").alias("user"), "response", label.alias("label"))


LABELS = ("Coding-Related", "other", "therapy", "personal", "self reflection", "n/a")


def day_unit(spark: SparkSession, sf: str) -> DataFrame:
    """One day unit per order date."""
    d = P.date_text(F.col("o_orderdate"))
    g = table(spark, sf, "orders").groupBy(d.alias("period_start")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("c"),
        F.max("o_orderpriority").alias("emotional_tone"),
        F.sum("o_orderkey").alias("k"), F.sum("o_custkey").alias("s"),
        F.array_sort(F.collect_set("o_orderstatus")).alias("key_events"))
    return g.select(
        F.lit("day").alias("level"), "period_start", F.col("period_start").alias("period_end"),
        F.concat(F.lit("orders "), F.col("n").cast("string"), F.lit(" customers "),
                 F.col("c").cast("string")).alias("summary"), "emotional_tone", "key_events",
        F.col("n").alias("source_entry_count"), (F.col("k") % 6).cast("int").alias("energy_level"),
        (F.col("s") % 6).cast("int").alias("social_connectedness"),
        (F.col("n") % 6).cast("int").alias("forward_momentum"),
        F.array("period_start").alias("source_units"))


def unit(spark: SparkSession, sf: str) -> DataFrame:
    """Day units and the three levels above them, with short texts."""
    cols = ["level", "period_start", "period_end", "summary", "source_entry_count", "source_units"]
    below = day_unit(spark, sf)
    out = [below.select(*cols)]
    for level in ("week", "month", "year"):
        below = periods.rollup_level(below, level).withColumn("summary", F.concat(
            F.lit(level + " of "), F.size("source_units").cast("string"), F.lit(" parts and "),
            F.col("source_entry_count").cast("string"), F.lit(" orders")))
        out.append(below.select(*cols))
    return ingest.union_sources(*out)


def mention(spark: SparkSession, sf: str) -> DataFrame:
    """Events as mentions of users; some names share an alias."""
    u = F.col("user_id")
    day = P.date_text(F.col("ts"))
    return table(spark, sf, "events").select(
        F.when(u % 4 == 0, F.concat(F.lit("U"), u.cast("string")))
        .otherwise(F.concat(F.lit("User "), u.cast("string"))).alias("name_as_written"),
        F.when(u % 3 != 0, F.concat(F.lit("user_"), u.cast("string"))).alias("normalized_name"),
        F.when(F.col("event_type").isin("purchase", "signup"), "warm")
        .when(F.col("event_type") == "error", "tense").otherwise("neutral").alias("valence"),
        F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k"))
        .alias("interaction_summary"),
        day.alias("source_date"), day.alias("period_start"), F.col("event_id").alias("seq"))


def mention_day(spark: SparkSession, sf: str) -> DataFrame:
    """Day units of the mention dates: a tone and the kinds of events as key events."""
    day = P.date_text(F.col("ts"))
    return table(spark, sf, "events").groupBy(day.alias("period_start")).agg(
        F.max("event_type").alias("emotional_tone"),
        F.array_sort(F.collect_set("event_type")).alias("key_events"))


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as entries together with the summaries of all units."""
    from stratalog.operators import search
    d = table(spark, sf, "documents").filter(F.trim("text") != "").select(
        F.col("doc_id").cast("string").alias("id"),
        P.date_text(F.date_add(F.lit("2020-01-01").cast("date"),
                               (F.col("doc_id") % 2000).cast("int"))).alias("date"), "text")
    return search.index_corpus(d, unit(spark, sf))


def grown(spark: SparkSession, sf: str) -> DataFrame:
    """The same with more text in two of ten rows."""
    return corpus(spark, sf).withColumn("content", F.when(
        F.right("source_id", F.lit(1)).isin("3", "4"), F.concat("content", F.lit(" Ther quean, more")))
        .otherwise(F.col("content")))


def dated_document(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose every seventh line (from the fourth) opens with a date."""
    lines = F.transform(F.split("text", "\n"), lambda ln, i: F.when(
        i % 7 == 3, F.concat(P.date_text(F.date_add(
            F.lit("2021-03-01").cast("date"), (F.col("doc_id") % 500 + i).cast("int"))),
            F.lit(" "), ln)).otherwise(ln))
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("file"), F.array_join(lines, "\n").alias("text"))


def call_log(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as logged model calls."""
    return table(spark, sf, "documents").select(
        F.col("doc_id"), F.col("source").alias("model"), F.col("n_chars").alias("char_count"),
        F.floor(F.col("n_chars") / 3).alias("actual_input_tokens"))


VIEW_SQL = {
    "raw_entry": """
SELECT substr(sha256(concat_ws('|', date, time, source_file, role, text)), 1, 16) AS id,
       date, time, source, source_file, role, text
FROM (SELECT strftime(DATE '2023-12-25' + CAST(conv_id * 3 % 730 AS INTEGER), '%Y-%m-%d') AS date,
             strftime(TIMESTAMP '2024-01-01 08:00:00' + to_minutes(turn * 5), '%H:%M:%S') AS time,
             'conversation' AS source, 'conv_' || conv_id || '.json' AS source_file, role, text
      FROM conversations)""",
    "message": """
SELECT 'conv_' || conv_id || '.json' AS file, turn AS msg_index,
       strftime(DATE '2023-12-25' + CAST(conv_id * 3 % 730 AS INTEGER), '%Y-%m-%d')
         || 'T09:00:00' AS datetime_parsed,
       text AS "user", response,
       ['Coding-Related', 'other', 'therapy', 'personal', 'self reflection', 'n/a']
         [CAST((conv_id + turn) % 6 + 1 AS INTEGER)] AS label
FROM (SELECT conv_id, turn, role, text,
             lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS response FROM conversations)
WHERE role = 'user'""",
    "day_unit": """
SELECT 'day' AS level, strftime(o_orderdate, '%Y-%m-%d') AS period_start,
       strftime(o_orderdate, '%Y-%m-%d') AS period_end,
       'orders ' || count(*) || ' customers ' || count(DISTINCT o_custkey) AS summary,
       max(o_orderpriority) AS emotional_tone,
       list_sort(list(DISTINCT o_orderstatus)) AS key_events,
       count(*) AS source_entry_count,
       CAST(sum(o_orderkey) % 6 AS INTEGER) AS energy_level,
       CAST(sum(o_custkey) % 6 AS INTEGER) AS social_connectedness,
       CAST(count(*) % 6 AS INTEGER) AS forward_momentum,
       [strftime(o_orderdate, '%Y-%m-%d')] AS source_units
FROM orders GROUP BY o_orderdate""",
    "week_unit": """
SELECT 'week' AS level, min(period_start) AS period_start, max(period_end) AS period_end,
       'week of ' || count(*) || ' parts and ' || sum(source_entry_count) || ' orders' AS summary,
       CAST(sum(source_entry_count) AS BIGINT) AS source_entry_count,
       list(period_start ORDER BY period_start) AS source_units
FROM day_unit GROUP BY strftime(CAST(period_start AS DATE), '%G-W%V')""",
    "month_unit": """
SELECT 'month' AS level, substr(period_start, 1, 7) AS period_start,
       max_by(u.period_end, u.period_start) AS period_end,
       'month of ' || count(*) || ' parts and ' || sum(source_entry_count) || ' orders' AS summary,
       CAST(sum(source_entry_count) AS BIGINT) AS source_entry_count,
       list(u.period_start ORDER BY u.period_start) AS source_units
FROM week_unit u GROUP BY substr(u.period_start, 1, 7)""",
    "year_unit": """
SELECT 'year' AS level, substr(period_start, 1, 4) AS period_start,
       max_by(u.period_end, u.period_start) AS period_end,
       'year of ' || count(*) || ' parts and ' || sum(source_entry_count) || ' orders' AS summary,
       CAST(sum(source_entry_count) AS BIGINT) AS source_entry_count,
       list(u.period_start ORDER BY u.period_start) AS source_units
FROM month_unit u GROUP BY substr(u.period_start, 1, 4)""",
    "unit": """
SELECT level, period_start, period_end, summary, source_entry_count, source_units FROM day_unit
UNION ALL SELECT level, period_start, period_end, summary, source_entry_count, source_units
FROM week_unit
UNION ALL SELECT level, period_start, period_end, summary, source_entry_count, source_units
FROM month_unit
UNION ALL SELECT level, period_start, period_end, summary, source_entry_count, source_units
FROM year_unit""",
    "mention": """
SELECT CASE WHEN user_id % 4 = 0 THEN 'U' || user_id ELSE 'User ' || user_id END AS name_as_written,
       CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'user_' || user_id END AS normalized_name,
       CASE event_type WHEN 'purchase' THEN 'warm' WHEN 'signup' THEN 'warm'
                       WHEN 'error' THEN 'tense' ELSE 'neutral' END AS valence,
       event_type || ' ' || json_extract_string(props, '$.k') AS interaction_summary,
       strftime(ts, '%Y-%m-%d') AS source_date, strftime(ts, '%Y-%m-%d') AS period_start,
       event_id AS seq
FROM events""",
    "named": r"""
SELECT *, lower(name_as_written) AS raw_alias, lower(coalesce(normalized_name, '')) AS norm_alias,
       trim(regexp_replace(lower(coalesce(normalized_name, name_as_written)),
                           '[^a-z0-9]+', '_', 'g'), '_') AS id
FROM mention""",
    "entity": """
SELECT id, arg_min(name_as_written, (period_start, seq)) AS display_name,
       min(source_date) AS first_mentioned, count(*) AS appearances,
       min((period_start, seq)) AS first_seen
FROM named GROUP BY id""",
    "alias_row": """
SELECT DISTINCT id, alias FROM (SELECT id, raw_alias AS alias FROM named
                                UNION ALL SELECT id, norm_alias FROM named)""",
    "alias": """
SELECT alias, arg_max(id, (-appearances, first_seen)) AS id
FROM alias_row JOIN entity USING (id) GROUP BY alias""",
    "fact": """
SELECT coalesce(a.id, b.id, trim(regexp_replace(CASE WHEN norm_alias <> '' THEN norm_alias
         ELSE raw_alias END, '[^a-z0-9]+', '_', 'g'), '_')) AS id,
       source_date AS valid_from, period_start, interaction_summary AS content,
       valence AS emotional_valence, seq
FROM named n LEFT JOIN alias a ON a.alias = n.raw_alias LEFT JOIN alias b ON b.alias = n.norm_alias""",
    "mention_day": """
SELECT strftime(ts, '%Y-%m-%d') AS period_start, max(event_type) AS emotional_tone,
       list_sort(list(DISTINCT event_type)) AS key_events
FROM events GROUP BY 1""",
    "corpus": """
SELECT 'raw' AS source_type, CAST(doc_id AS VARCHAR) AS source_id,
       strftime(DATE '2020-01-01' + CAST(doc_id % 2000 AS INTEGER), '%Y-%m-%d') AS date,
       text AS content FROM documents WHERE trim(text) <> ''
UNION ALL SELECT 'summary_' || level, level || ':' || period_start, period_start, summary FROM unit
WHERE summary <> ''""",
    "posting": r"""
SELECT source_type, source_id, date, len(toks) AS doc_len, token, count(*) AS tf
FROM (SELECT source_type, source_id, date, toks, unnest(toks) AS token
      FROM (SELECT *, regexp_extract_all(strip_accents(lower(content)), '[\p{L}\p{N}]+') AS toks
            FROM corpus))
GROUP BY source_type, source_id, date, len(toks), token""",
    "line": """
SELECT file, line_no,
       CASE WHEN line_no % 7 = 3
            THEN strftime(DATE '2021-03-01' + CAST(doc_id % 500 + line_no AS INTEGER), '%Y-%m-%d')
                 || ' ' || line ELSE line END AS line
FROM (SELECT CAST(doc_id AS VARCHAR) AS file, doc_id,
             unnest(range(len(string_split(text, chr(10))))) AS line_no,
             unnest(string_split(text, chr(10))) AS line FROM documents)""",
    "dated_line": r"""
SELECT *, CASE WHEN regexp_matches(line, '^\s*\d{4}-\d{2}-\d{2}\b')
               THEN regexp_extract(line, '^\s*(\d{4}-\d{2}-\d{2})\b', 1) END AS anchor
FROM line""",
    "dated_block": r"""
SELECT file, first_line, CASE WHEN grp IS NOT NULL THEN anchor || 'T00:00:00' END AS datetime_parsed,
       CASE WHEN grp IS NOT NULL THEN regexp_replace(head, '^\s+|\s+$', '', 'g')
            ELSE 'before any date' END AS datetime_raw, "user"
FROM (SELECT file, grp, max(filled) AS anchor, min(line_no) AS first_line,
             arg_min(line, line_no) AS head,
             regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '^\s+|\s+$', '', 'g') AS "user"
      FROM (SELECT *, last_value(CASE WHEN anchor IS NOT NULL THEN line_no END IGNORE NULLS)
                        OVER (PARTITION BY file ORDER BY line_no) AS grp,
                      last_value(anchor IGNORE NULLS)
                        OVER (PARTITION BY file ORDER BY line_no) AS filled
            FROM dated_line) GROUP BY file, grp)
WHERE grp IS NOT NULL OR "user" <> ''""",
    "shelf_line": """
SELECT CAST(CAST(file AS BIGINT) % 8 AS VARCHAR) AS file, line,
       row_number() OVER (PARTITION BY CAST(file AS BIGINT) % 8 ORDER BY CAST(file AS BIGINT), line_no) AS line_no
FROM line""",
    "call_log": """
SELECT doc_id, source AS model, n_chars AS char_count, n_chars // 3 AS actual_input_tokens
FROM documents""",
}

VIEW_SQL["grown"] = """
SELECT source_type, source_id, date, CASE WHEN right(source_id, 1) IN ('3', '4')
       THEN content || ' Ther quean, more' ELSE content END AS content FROM corpus"""
VIEW_SQL["grown_posting"] = VIEW_SQL["posting"].replace("FROM corpus", "FROM grown")
VIEW_SQL["shelf_dated"] = VIEW_SQL["dated_line"].replace("FROM line", "FROM shelf_line")
VIEW_SQL["shelf_block"] = VIEW_SQL["dated_block"].replace("FROM dated_line", "FROM shelf_dated")


def with_views(body: str) -> str:
    """Put the views a statement names, and those they name, in front of it."""
    order: list[str] = []

    def need(sql: str) -> None:
        for name in VIEW_SQL:
            if name not in order and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
                need(VIEW_SQL[name])
                if name not in order:
                    order.append(name)

    need(body)
    if not order:
        return body.strip()
    views = ",\n".join(f"{name} AS ({VIEW_SQL[name].strip()}\n)" for name in order)
    lead = body.strip()
    if lead.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views},\n{lead[15:]}"
    if lead.upper().startswith("WITH "):
        return f"WITH {views},\n{lead[5:]}"
    return f"WITH {views}\n{lead}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that gives the same rows where there is one."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return add
