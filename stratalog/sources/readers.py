"""Readers: each gives entry rows or turns from one kind of file.

A folder is read by many tasks, and so is one large JSON document (``documents``): its days,
conversations or turns are rows.  An HTML page is one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stratalog.functions import periods as P, text as X
from stratalog.operators import ingest
from stratalog.plans import models
from stratalog.schema import (CHAT_FILE, DAY_FILE, ENTRY_DEFAULTS, LEVELS, PROFILE_BODY,
                              SUMMARY_BODY, TURN_FILE)
from stratalog.session import cut_lineage
from stratalog.sources import documents


def file_name() -> Column:
    return F.col("_metadata.file_name")


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def _default(value: Column, name: str) -> Column:
    return F.coalesce(value, F.lit(ENTRY_DEFAULTS[name]))


def _entries(days: DataFrame, source_file: Column, roles: Iterable[str] | None) -> DataFrame:
    """Explode day blocks; blank texts vanish and with them empty days."""
    rows = days.withColumn("_e", F.explode("entries")).select(
        F.coalesce("date", F.lit("")).alias("date"), _default(F.col("_e.time"), "time").alias("time"),
        _default(F.col("_e.source"), "source").alias("source"),
        F.coalesce(F.col("_e.source_file"), source_file).alias("source_file"),
        _default(F.col("_e.role"), "role").alias("role"), X.strip("_e.text").alias("text"))
    return ingest.filter_roles(rows.filter(F.col("text") != ""), roles)


def read_merged_json(spark: SparkSession, path: str, roles: Iterable[str] | None = None,
                     lines: bool = False) -> DataFrame:
    """``{entries: [{date, entries: [...]}]}`` documents, a day of a document at a time.

    With ``lines`` the folder that ``export_merged`` writes: one day, or page of a day, per line.
    """
    if lines:
        days = spark.read.schema(DAY_FILE).json(f"{path}/entries")
        return _entries(days, F.lit(""), roles)
    days = documents.parsed_records(documents.json_records(spark, path, 2), DAY_FILE)
    return _entries(days, F.lit(""), roles)


def read_split_json(spark: SparkSession, path: str, roles: Iterable[str] | None = None
                    ) -> DataFrame:
    """A folder of one JSON file per day; unreadable files are skipped."""
    docs = spark.read.schema(DAY_FILE).json(path, multiLine=True, pathGlobFilter="*.json")
    named = docs.select(F.coalesce("date", _stem(file_name())).alias("date"), "entries",
                        file_name().alias("_name"))
    return _entries(named, F.col("_name"), roles)


def read_dated_text(spark: SparkSession, path: str, extension: str = "txt",
                    pattern: str = "yyyy-MM-dd") -> DataFrame:
    """Text or Markdown files whose name is a date; other names and empty files are skipped."""
    kind = extension.lower()
    suffix = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in kind)
    docs = spark.read.text(path, wholetext=True, pathGlobFilter=f"*.{suffix}")
    at = F.try_to_timestamp(_stem(file_name()), F.lit(pattern))
    return docs.select(P.date_text(at).alias("date"), F.lit(ENTRY_DEFAULTS["time"]).alias("time"),
                       F.lit(kind).alias("source"), file_name().alias("source_file"),
                       F.lit("user").alias("role"), X.strip("value").alias("text")
                       ).filter(F.col("date").isNotNull() & (F.col("text") != ""))


def read_dated_csv(spark: SparkSession, path: str, date_col: str = "date",
                   text_col: str = "text", pattern: str = "yyyy-MM-dd") -> DataFrame:
    """CSV with a header; rows with a blank text or a date that does not parse are dropped."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    at = F.try_to_timestamp(X.strip(date_col), F.lit(pattern))
    return rows.select(P.date_text(at).alias("date"), F.lit(ENTRY_DEFAULTS["time"]).alias("time"),
                       F.lit("csv").alias("source"), file_name().alias("source_file"),
                       F.lit("user").alias("role"), X.strip(text_col).alias("text")
                       ).filter(F.col("date").isNotNull() & (F.col("text") != ""))


def _messages(spark: SparkSession, path: str) -> DataFrame:
    docs = documents.parsed_records(documents.json_records(spark, path), CHAT_FILE)
    return docs.select(F.col("file_name").alias("source_file"),
                       F.coalesce("title", F.lit("(no title)")).alias("title"),
                       F.posexplode("chat.messages").alias("msg_index", "_m")).select(
        "source_file", "title", "msg_index", F.col("_m.role").alias("role"),
        F.col("_m.content").alias("content"),
        F.col("_m.timestamp").try_cast("double").cast("long").alias("timestamp"))


def read_chat_messages(spark: SparkSession, path: str) -> DataFrame:
    """All messages of a chat export, for ``conversation_stats`` and title lists."""
    return _messages(spark, path)


def read_chat_export(spark: SparkSession, path: str, include_titles: Iterable[str] | None = None,
                     source: str = "owui") -> DataFrame:
    """Chat export: user and assistant messages with text and a timestamp, in UTC.

    Reasoning blocks are removed from assistant messages.
    """
    rows = ingest.filter_titles(_messages(spark, path), include_titles)
    text = F.when(F.col("role") == "assistant", X.strip_reasoning("content")
                  ).otherwise(F.col("content"))
    at = F.timestamp_seconds("timestamp")
    return (rows.filter(F.col("role").isin("user", "assistant")
                        & F.col("timestamp").isNotNull())
            .withColumn("_text", text).filter(F.col("_text") != "")
            .select(P.date_text(at).alias("date"), F.date_format(at, "HH:mm:ss").alias("time"),
                    F.lit(source).alias("source"), "source_file", "role",
                    X.strip("_text").alias("text"), "title"))


# Marks of an activity export.
ACTIVITY_FOOTER = "This activity was saved to your Google Account"
ACTIVITY_START = "Prompted"
ACTIVITY_GEM = r"\s+was used in this chat\.\s+Manage your Gems\.\s*"
ACTIVITY_TIME = (r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2},\s+\d{4},"
                 r"\s+\d{1,2}:\d{2}:\d{2}\s+(?:AM|PM)(?:\s+[A-Z]{2,5})?")


PARAGRAPHS = ("p", "h3", "li")


def activity_turns(pages: DataFrame, html: str = "html") -> DataFrame:
    """Turns of activity pages: the page's other columns, msg_index, datetime_raw,
    datetime_parsed, user, response.

    A page is cut into cells before anything else looks at it.  In a chat with a gem the response
    is the text of the cell's paragraphs, headings and list items after its time stamp, where it
    has any; else, and in plain chats, the flat text after the time stamp.
    """
    rest = [c for c in pages.columns if c != html]
    # The mark counts in text only: pieces begin with a tag, whose end is their first bracket.
    cut = "\u0001"
    tags = F.split(F.translate(F.col(html), cut, ""), "<")
    marked = F.transform(tags, lambda t, i: F.when((i > 0) & F.contains(t, F.lit(">")), F.concat(
        F.substring_index(t, ">", 1), F.lit(">"), F.replace(
            F.substr(t, F.length(F.substring_index(t, ">", 1)) + 2),
            F.lit(ACTIVITY_START), F.lit(cut)))).otherwise(
        F.replace(t, F.lit(ACTIVITY_START), F.lit(cut))))
    cells = F.filter(F.split(F.array_join(marked, "<"), cut), lambda _, i: i > 0)
    rows = (pages.select(*rest, F.posexplode(cells).alias("msg_index", "_cell"))
            .withColumn("_c", X.strip(F.substring_index(X.html_to_text("_cell"), ACTIVITY_FOOTER, 1))))
    gem, c = F.col("_c").rlike(ACTIVITY_GEM), F.col("_c")
    plain = rf"(?s)^(.*?)({ACTIVITY_TIME})(.*)$"
    asked = F.regexp_extract(c, rf"(?s)^(.*?){ACTIVITY_GEM}", 1)
    answered = X.strip(F.regexp_extract(c, rf"(?s)^.*?{ACTIVITY_GEM}(.*)$", 1))
    lead = rf"(?s)^({ACTIVITY_TIME})\s*(.*)$"
    # In a chat with a gem its name follows the question: cut after the last full stop,
    # unless that lies in the first three tenths.
    dot = F.length(asked) - F.locate(" .", F.reverse(asked))
    named = (F.locate(" .", F.reverse(asked)) > 0) & (dot - 1 > F.length(asked) * F.lit(0.3))
    raw = F.when(gem, X.strip(F.regexp_extract(answered, lead, 1))
                 ).otherwise(X.strip(F.regexp_extract(c, plain, 2)))
    user = F.when(gem, F.when(named, F.substring(asked, F.lit(1), dot)).otherwise(asked)
                  ).otherwise(F.regexp_extract(c, plain, 1))
    flat = F.when(gem & answered.rlike(lead), F.regexp_extract(answered, lead, 2)
                  ).when(gem, answered).otherwise(F.regexp_extract(c, plain, 3))
    turns = (rows.filter(gem | c.rlike(ACTIVITY_TIME))
             .select(*rest, "msg_index", raw.alias("datetime_raw"), user.alias("user"),
                     flat.alias("_flat"), F.when(gem, F.col("_cell")).alias("_cell")))
    # What follows the date in the cell as it was written; without a date the whole cell.
    date = F.left("datetime_raw", F.lit(10))
    at = F.call_function("locate", date, F.col("_cell"))
    after = F.when(at > 0, F.substr("_cell", at + F.length(date)))
    told = F.arrow_udf(_paragraphs, "string")(after)
    return turns.select(
        *rest, "msg_index", "datetime_raw",
        X.iso_datetime(X.parse_datetime("datetime_raw")).alias("datetime_parsed"),
        X.clean_text("user").alias("user"),
        X.clean_text(F.coalesce(X.present(told), "_flat")).alias("response"))


def _paragraphs(cells: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in cells:
        yield pa.array([None if c is None else paragraph_text(c) for c in batch.to_pylist()], pa.string())


# Elements that have no end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)[^>]*>|[^<]+|<", re.S)


def paragraph_text(cell: str) -> str:
    """The texts of paragraphs, third headings and list items, in the order in which they open.

    One pass over tags and texts with a stack of open elements: a text belongs to every such
    element that is open, an end tag closes its element and all that opened within it.  What
    holds the footer, and what is still open where it begins, is left out.
    """
    body, footer, _ = cell.partition(ACTIVITY_FOOTER)
    found: list[list[str]] = []
    open_: list[tuple[str, list[str] | None]] = []
    for m in TAG.finditer(body):
        name = (m[2] or "").lower()
        if not name:
            text = " ".join(unescape(m[0]).split()) if m[0][:4] != "<!--" else ""
            if text:
                for _, texts in open_:
                    if texts is not None:
                        texts.append(text)
        elif not m[1]:
            if name not in VOID and not m[0].endswith("/>"):
                texts: list[str] | None = [] if name in PARAGRAPHS else None
                if texts is not None:
                    found.append(texts)
                open_.append((name, texts))
        elif any(name == n for n, _ in open_):
            while open_.pop()[0] != name:
                pass
    cut_off = {id(texts) for _, texts in open_} if footer else set()
    return " ".join(" ".join(texts) for texts in found if texts and id(texts) not in cut_off)


def read_activity_html(spark: SparkSession, path: str) -> DataFrame:
    pages = spark.read.text(path, wholetext=True).select(
        file_name().alias("source_file"), F.col("value").alias("html"))
    return activity_turns(pages)


def read_preparsed_json(spark: SparkSession, path: str, check: bool = True, lines: bool = False
                        ) -> DataFrame:
    """Turns saved earlier; items without date or text are skipped.

    A file is one JSON array, or with ``lines`` one turn per line, as the turn cache is
    written; both are split over tasks.  With ``check`` a path without any valid item
    is an error.
    """
    if lines:
        docs = spark.read.schema(TURN_FILE).json(path).withColumn("file_name", file_name())
    else:
        docs = documents.parsed_records(documents.json_records(spark, path), TURN_FILE)
    parsed = F.coalesce(X.present("datetime_parsed"), X.present("datetime_raw_parsed"))
    user = F.coalesce(X.present("user"), X.present("text"))
    rows = docs.select(F.col("file_name").alias("source_file"), parsed.alias("datetime_parsed"),
                       F.coalesce("datetime_raw", parsed).alias("datetime_raw"),
                       X.strip(user).alias("user"),
                       F.coalesce("response", F.lit("")).alias("response")
                       ).filter(F.col("datetime_parsed").isNotNull() & F.col("user").isNotNull())
    if check and rows.isEmpty():
        raise ValueError(f"no valid entries in {path}: each needs datetime_parsed and user")
    return rows


def split_lines(docs: DataFrame, text: str) -> DataFrame:
    """One row per line with its number, the document's other columns kept."""
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def read_line_dated_text(spark: SparkSession, path: str | list[str], fn: models.ModelFn | None = None,
                         journal: str | None = None, folders: bool = False) -> DataFrame:
    """Long texts with date lines between paragraphs, as entry rows.

    A file is known by its whole path, is read by lines and in as many parts as Spark splits it
    into.  A line's place is the start of its part and its number there; the lines are made
    durable once, so a model is asked about each line once, and with a ``journal`` in no later
    run again.  With ``folders`` a text is a folder, whose files in the order of their names are
    its parts, as Spark writes a sorted table.
    """
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    part = F.struct(F.col("_metadata.file_name").alias("name"), start.alias("start")) if folders else start
    place = F.struct(part.alias("part"), F.monotonically_increasing_id().alias("n"))
    lines = spark.read.option("lineSep", "\n").text(path).select(
        (F.regexp_replace(file, "/[^/]*$", "") if folders else file).alias("file"),
        place.alias("line_no"), F.col("value").alias("line"))
    dated = cut_lineage(models.detect_dates(lines, fn, journal=journal))
    block = F.struct("line_no.part", F.floor(F.col("line_no.n") / 65_536).alias("n"))
    filled = ingest.forward_fill_dates(dated, block=block)
    entries = ingest.dated_entries(ingest.resolve_undated(filled))
    name = F.replace(F.substring_index("source_file", "/", -1), F.lit("+"), F.lit("%2B"))
    return entries.withColumn("source_file", F.url_decode(name))


def route_sources(spark: SparkSession, path: str) -> DataFrame:
    """Files directly under ``path`` with the parser each belongs to."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = (F.when(ext == "json", "chat").when(ext.isin("html", "htm"), "activity")
            .when(ext.isin("txt", "md"), "line_dated"))
    return files.select("path", kind.alias("kind"), F.unix_micros("modificationTime").cast("double")
                        .__truediv__(1_000_000).alias("mtime"), "length"
                        ).filter(F.col("kind").isNotNull())


def read_legacy_tree(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """A tree of raw_entries/, summaries/<level>/ and entity_profiles/ JSON files."""
    raw = spark.read.schema(DAY_FILE).json(f"{root}/raw_entries", multiLine=True,
                                           pathGlobFilter="*.json")
    rows = raw.select("date", "entries", file_name().alias("_name")).filter(
        F.coalesce("date", F.lit("")) != "").withColumn("_e", F.explode("entries"))
    entries = ingest.with_entry_id(rows.select(
        "date", _default(F.col("_e.time"), "time").alias("time"),
        _default(F.col("_e.source"), "source").alias("source"),
        F.coalesce(F.col("_e.source_file"), F.col("_name")).alias("source_file"),
        _default(F.col("_e.role"), "role").alias("role"),
        _default(F.col("_e.text"), "text").alias("text")))
    level = F.regexp_extract("_metadata.file_path", r"/summaries/([^/]+)/[^/]+$", 1)
    told = spark.read.schema(SUMMARY_BODY).json(f"{root}/summaries/*", multiLine=True,
                                                pathGlobFilter="*.json")
    summaries = (told.withColumn("level", level).filter(F.col("level").isin(*LEVELS))
                 .drop("unit"))
    profiles = (spark.read.schema(PROFILE_BODY)
                .json(f"{root}/entity_profiles", multiLine=True, pathGlobFilter="*.json")
                .withColumn("_name", file_name()).filter(F.col("_name") != "_index.json")
                .drop("_name"))
    return {"raw_entry": entries, "summary": summaries, "entity_profile": profiles}


def legacy_counts(tree: dict[str, DataFrame]) -> DataFrame:
    """What a load would bring, without writing anything."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
             for name, df in tree.items()]
    return ingest.union_sources(*parts)


def parse_summaries(stored: DataFrame) -> DataFrame:
    """Rows (level, period_start, period_end, data_json) with the body as typed columns."""
    from stratalog.operators import search
    body = T.StructType([f for f in SUMMARY_BODY.fields if f.name not in (
        "unit", "period_start", "period_end")])
    return search.summaries_from_json(stored, body)


def load_summaries(stored: DataFrame, level: str) -> DataFrame:
    """All summaries of a level; unknown JSON fields are dropped, missing lists are empty."""
    from stratalog.operators import periods
    rows = parse_summaries(periods.filter_level(stored, level))
    lists = ("key_events", "questions_raised", "source_units")
    return rows.withColumns({
        **{c: F.coalesce(c, F.array().cast("array<string>")) for c in lists},
        "source_entry_count": F.coalesce("source_entry_count", F.lit(0).cast("long"))})
