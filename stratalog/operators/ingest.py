"""Ingest: filters, entry identity, dedup against the store, upserts, checkpoints."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratalog.functions import periods as P, text as X
from stratalog.operators import paging
from stratalog.schema import ENTRY_COLUMNS, ENTRY_DEFAULTS, check_level

# --- filters -----------------------------------------------------------------


def filter_roles(df: DataFrame, roles: Iterable[str] | None = None) -> DataFrame:
    return df if roles is None else df.filter(F.col("role").isin(*roles))


def filter_dates(df: DataFrame, start: str | None = None, end: str | None = None,
                 column: str = "date") -> DataFrame:
    """Inclusive on both ends; an absent bound does not restrict."""
    if start:
        df = df.filter(F.col(column) >= start)
    if end:
        df = df.filter(F.col(column) <= end)
    return df


def filter_nonempty(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, X.strip(column)).filter(F.col(column) != "")


def filter_titles(df: DataFrame, titles: Iterable[str] | DataFrame | None = None,
                  column: str = "title") -> DataFrame:
    """Keep named conversations; a large list comes as a DataFrame and is semi-joined."""
    if titles is None:
        return df
    if isinstance(titles, DataFrame):
        return df.join(titles.select(F.col(titles.columns[0]).alias(column)).distinct(),
                       column, "left_semi")
    return df.filter(F.col(column).isin(*titles))


def filter_categories(df: DataFrame, categories: Iterable[str] | None = None) -> DataFrame:
    """A row without a category counts as ``other``; no categories means all."""
    categories = list(categories or ())
    if not categories:
        return df
    return df.filter(F.coalesce("category", F.lit("other")).isin(*categories))


def entry_by_id(df: DataFrame, id_: str) -> DataFrame:
    return df.filter(F.col("id") == id_)


# --- shaping -----------------------------------------------------------------


def apply_defaults(df: DataFrame) -> DataFrame:
    """Fill time, source, source_file, role and text where missing."""
    have = set(df.columns)
    return df.withColumns({
        name: F.coalesce(F.col(name), F.lit(value)) if name in have else F.lit(value)
        for name, value in ENTRY_DEFAULTS.items()})


def with_entry_id(df: DataFrame) -> DataFrame:
    return df.withColumn("id", X.entry_id())


def turns_to_entries(df: DataFrame, source: str, source_file: str | Column = "source_file",
                     categories: Iterable[str] | None = None) -> DataFrame:
    """One turn with user and response text becomes up to two entry rows."""
    if "category" in df.columns or categories:
        if "category" not in df.columns:
            df = df.withColumn("category", F.lit(None).cast("string"))
        df = filter_categories(df.withColumn("category", F.coalesce("category", F.lit("other"))),
                               categories)
    at = F.coalesce(F.try_to_timestamp("datetime_parsed"),
                    P.as_date(F.substring("datetime_parsed", 1, 10)).cast("timestamp"))
    rows = (df.withColumn("_at", at).filter(F.col("_at").isNotNull())
            .withColumn("_turn", F.explode(F.array(
                F.struct(F.lit("user").alias("role"), F.col("user").alias("text")),
                F.struct(F.lit("assistant").alias("role"), F.col("response").alias("text")))))
            .withColumn("_text", X.strip("_turn.text")).filter(F.col("_text") != ""))
    extra = [c for c in ("category",) if c in df.columns]
    return rows.select(P.date_text(F.col("_at")).alias("date"),
                       F.date_format("_at", "HH:mm:ss").alias("time"),
                       F.lit(source).alias("source"), X.col(source_file).alias("source_file"),
                       F.col("_turn.role").alias("role"), F.col("_text").alias("text"), *extra)


def union_sources(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def staged_breakdown(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("entries"))


def ordered_entries(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """By date and time; the id settles ties.  A range-partitioned global sort."""
    return df.orderBy(*keys, "date", "time", "id")


# --- merge against the store -------------------------------------------------


def prepare(staged: DataFrame) -> DataFrame:
    """Rows with a date, defaults filled, id computed."""
    dated = staged.filter(F.coalesce("date", F.lit("")) != "")
    return with_entry_id(apply_defaults(dated))


def new_entries(staged: DataFrame, existing: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Staged entries whose id is new, each once.

    Known ids leave first, so a re-ingest sorts nothing.  Copies of new ones then collapse
    before the shuffle: a text repeated in a third of the rows costs one row per task.
    """
    keys = list(keys)
    rest = [c for c in staged.columns if c not in (*keys, "id")]
    unknown = staged.join(existing.select(*keys, "id").distinct(), [*keys, "id"], "left_anti")
    return (unknown.groupBy(*keys, "id").agg(F.min(F.struct(*rest)).alias("_row"))
            .select(*keys, "id", "_row.*").select(*staged.columns))


def assemble(staged: DataFrame, existing: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The store after appending what is new in ``staged``."""
    cols = [*keys, *ENTRY_COLUMNS]
    fresh = new_entries(prepare(staged).select(*cols), existing, keys)
    return existing.select(*cols).unionByName(fresh)


def ingest_stats(staged: DataFrame, existing: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row: dates not seen before, entries appended, duplicates skipped.

    ``appended`` counts ids, so rows repeated inside the batch count as skipped.
    """
    keys = list(keys)
    rows = prepare(staged).select(*keys, "date", "id")
    ids = rows.groupBy(*keys, "date", "id").agg(F.count(F.lit(1)).alias("copies"))
    known = existing.select(*keys, "id").distinct().withColumn("_known", F.lit(1))
    marked = ids.join(known, [*keys, "id"], "left")
    per_date = marked.groupBy(*keys, "date").agg(
        F.sum("copies").alias("rows"),
        F.count_if(F.col("_known").isNull()).alias("appended"))
    old_dates = existing.select(*keys, "date").distinct().withColumn("_old", F.lit(1))
    return per_date.join(old_dates, [*keys, "date"], "left").agg(
        F.count_if(F.col("_old").isNull()).alias("new_dates"),
        F.coalesce(F.sum("appended"), F.lit(0)).alias("appended"),
        F.coalesce(F.sum(F.col("rows") - F.col("appended")), F.lit(0)).alias("skipped_duplicates"))


def appended_dates(staged: DataFrame, existing: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Dates that really received rows: what a rerun has to look at."""
    return new_entries(prepare(staged), existing, keys).select(*keys, "date").distinct()


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Replace by key; inside ``new`` the highest ``_seq`` wins when that column is given.

    The store is only filtered by an anti join on the new keys: with few of them Spark
    broadcasts those (by its size limit) and the store is not shuffled at all.
    """
    key, cols = list(key), old.columns
    new = (paging.latest(new, key, "_seq") if "_seq" in new.columns
           else new.dropDuplicates(key)).select(*cols)
    return old.join(new.select(*key), key, "left_anti").select(*cols).unionByName(new)


def upsert_raw(old: DataFrame, new: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return upsert(old, new, [*keys, "id"])


def upsert_summary(old: DataFrame, new: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return upsert(old, new, [*keys, "level", "period_start"])


def upsert_profile(old: DataFrame, new: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return upsert(old, new, [*keys, "id"])


def delete_units(units: DataFrame, level: str | None = None) -> DataFrame:
    """The store without one level, or without any unit."""
    return units.filter(F.lit(False)) if level is None else units.filter(
        F.col("level") != check_level(level))


def invalidate_units(units: DataFrame, doomed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The store without the given (level, period_start) units."""
    on = [*keys, "level", "period_start"]
    return units.join(doomed.select(*on).distinct(), on, "left_anti")


def invalidated(units: DataFrame, doomed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Which of the given units existed and so were dropped."""
    on = [*keys, "level", "period_start"]
    return units.select(*on).join(doomed.select(*on).distinct(), on, "left_semi")


def pending_units(candidates: DataFrame, done: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    on = [*keys, "level", "period_start"]
    return candidates.join(done.select(*on), on, "left_anti")


def pending_except(candidates: DataFrame, done: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Candidate unit keys minus completed ones, as a set."""
    on = [*keys, "level", "period_start"]
    return candidates.select(*on).subtract(done.select(*on))


# --- files and checkpoints ---------------------------------------------------


def changed_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are new or whose modification time moved by a second or more.

    Both sides hold ``path`` and ``mtime`` (epoch seconds as double).
    """
    seen = manifest.groupBy("path").agg(F.max("mtime").alias("_seen"))
    return (found.join(seen, "path", "left")
            .filter(F.col("_seen").isNull() | (F.abs(F.col("mtime") - F.col("_seen")) >= 1.0))
            .drop("_seen"))


def unclassified(messages: DataFrame, checkpoint: DataFrame,
                 on: Sequence[str] = ("file", "msg_index")) -> DataFrame:
    return messages.join(checkpoint.select(*on), list(on), "left_anti")


def resume_checkpoint(checkpoint: DataFrame, labelled: DataFrame, force: bool = False,
                      on: Sequence[str] = ("file", "msg_index")) -> DataFrame:
    """Checkpoint after a run: old labels stay, new ones are added; ``force`` starts over."""
    if force:
        return labelled.select(*checkpoint.columns)
    fresh = labelled.join(checkpoint.select(*on), list(on), "left_anti")
    return checkpoint.unionByName(fresh.select(*checkpoint.columns))


def category_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("category").agg(F.count(F.lit(1)).alias("messages"))


def conversation_stats(messages: DataFrame, keys: Sequence[str] = ("title",)) -> DataFrame:
    """Per conversation: user messages and the date of the first stamped message of any role."""
    return messages.groupBy(*keys).agg(
        F.count_if(F.col("role") == "user").alias("message_count"),
        F.coalesce(P.date_text(F.timestamp_seconds(F.min(F.nullif("timestamp", F.lit(0))))),
                   F.lit("")).alias("date_start"))


def apply_date_overrides(entries: DataFrame, fixes: DataFrame, on: Sequence[str]) -> DataFrame:
    """Corrected dates replace ``datetime_parsed``; NONE clears it, other formats are ignored."""
    wanted = F.upper(X.strip("new_date"))
    valid = fixes.withColumn("_to", wanted).filter(
        (F.col("_to") == "NONE") | F.col("_to").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    return (entries.join(valid.select(*on, "_to"), list(on), "left")
            .withColumn("datetime_parsed",
                        F.when(F.col("_to") == "NONE", F.lit(None).cast("string"))
                        .when(F.col("_to").isNotNull(), F.concat("_to", F.lit("T00:00:00")))
                        .otherwise(F.col("datetime_parsed")))
            .drop("_to"))


# --- text split at date lines ------------------------------------------------


def forward_fill_dates(lines: DataFrame, file: Sequence[str] = ("file",), line: str = "line_no",
                       anchor: str = "anchor", text: str = "line", block: Column | None = None,
                       page_chars: int = paging.PAGE_CHARS) -> DataFrame:
    """Lines between two anchors form one entry dated by the upper anchor.

    ``line`` orders the lines of a file and ``block`` cuts that order (65,536 line numbers
    by default), so a file of any size is filled block by block: the last anchor of every
    block is one small row, and a window over those rows carries it into the next blocks.
    Text above the first anchor stays undated.  Entries that end in the block they began in are
    final there; only what touches a block's border is put together afterwards, by lengths first,
    in pages of at most ``page_chars`` and one block, so no entry is collected whole: a huge one
    is several rows with the same ``first_line``, numbered by ``page``.
    """
    file = list(file)
    block = F.floor(F.col(line) / 65_536) if block is None else block
    mark = F.when(F.col(anchor).isNotNull(), F.struct(F.col(line).alias("at"),
                                                      F.col(anchor).alias("date")))
    rows = lines.select(*file, line, text, mark.alias("_m"), block.alias("_b"))
    before = Window.partitionBy(*file).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*file, "_b").agg(F.max("_m").alias("_last")).select(
        *file, "_b", "_last", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    upto = (Window.partitionBy(*file, "_b").orderBy(line)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = rows.join(carried, [*file, "_b"]).withColumn(
        "_own", F.last("_m", ignorenulls=True).over(upto)).select(
        *file, "_b", line, text, F.coalesce("_own", "_carried").alias("_a"),
        (F.col("_own").isNull() | (F.col("_own.at") == F.col("_last.at"))).alias("_border"))
    body = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(line, text))), lambda r: r[text]), "\n")
    pieces = (marked.withColumns({"_at": F.col("_a.at"), "_date": F.col("_a.date")})
              .groupBy(*file, "_b", "_border", "_at", "_date")
              .agg(body.alias("_text"), F.min_by(text, line).alias("_head"),
                   F.min(line).alias("first_line")))
    inner = pieces.filter("NOT _border").select(
        *file, "_at", "_date", X.strip("_text").alias("user"), "_head", "first_line",
        F.lit(0).cast("long").alias("page"))
    # At most two pieces a block touch its borders.
    border = pieces.filter("_border")
    same = Window.partitionBy(*file, "_at").orderBy("_b")
    placed = border.select(*file, "_at", "_b", "first_line", "_head",
                           F.length("_text").alias("_chars")).select(
        *file, "_at", "_b",
        F.floor(F.coalesce(F.sum(F.col("_chars") + 1).over(
            same.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / F.lit(page_chars)).alias("page"),
        F.first("first_line").over(same).alias("_first_line"), F.first("_head").over(same).alias("_first"))
    on = [F.col(f"_x.{c}").eqNullSafe(F.col(f"_y.{c}")) for c in (*file, "_at", "_b")]
    joined = border.alias("_x").join(placed.alias("_y"), on).select(
        *[F.col(f"_x.{c}") for c in (*file, "_b", "_at", "_date", "_text")], "_y.page", "_first_line", "_first")
    pages = joined.groupBy(*file, "_at", "_date", "page", "_first_line", "_first").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_text"))),
                                 lambda r: r["_text"]), "\n").alias("_text"))
    # White space goes at the ends of an entry, not between its pages.
    last = F.max("page").over(Window.partitionBy(*file, "_at"))
    blank = F.lit(" \t\n\r\x0b\x0c")
    left = F.when(F.col("page") == 0, F.ltrim("_text", blank)).otherwise(F.col("_text"))
    outer = pages.withColumn("_text", left).withColumn("_text", F.when(
        F.col("page") == last, F.rtrim("_text", blank)).otherwise(F.col("_text"))).select(
        *file, "_at", "_date", F.when((last == 0), X.strip("_text")).otherwise(F.col("_text")).alias("user"),
        F.col("_first").alias("_head"), F.col("_first_line").alias("first_line"), "page")
    dated = F.col("_at").isNotNull()
    return (inner.unionByName(outer).filter(dated | (F.col("user") != ""))
            .select(*file, "first_line",
                    F.when(dated, F.concat("_date", F.lit("T00:00:00"))).alias("datetime_parsed"),
                    F.when(dated, X.strip("_head"))
                    .otherwise(F.lit("before any date")).alias("datetime_raw"), "user", "page"))


def resolve_undated(entries: DataFrame, file: Sequence[str] = ("file",)) -> DataFrame:
    """Undated text goes to the day before the file's earliest date, with a note.

    Without any dated text it goes to 1970-01-01 and gets no note.  Of text in several pages the
    last one has the note.
    """
    file = list(file)
    if "page" in entries.columns:
        final = (F.col("page") == F.max("page").over(Window.partitionBy(*file))) | (
            F.col("datetime_parsed").isNotNull())
        loose = entries.filter("datetime_parsed IS NULL").withColumn("_final", final)
        entries = entries.filter("datetime_parsed IS NOT NULL").withColumn("_final", F.lit(True)).unionByName(loose)
    else:
        entries = entries.withColumn("_final", F.lit(True))
    earliest = (entries.groupBy(*file)
                .agg(F.min(F.substring("datetime_parsed", 1, 10)).alias("_first")))
    undated = F.col("datetime_parsed").isNull()
    before = P.date_text(F.date_sub(P.as_date("_first"), 1))
    note = F.concat(F.lit("\n\n[without a date; filed before "), F.col("_first"), F.lit("]"))
    return (entries.join(earliest, file)
            .withColumn("user", F.when(undated & F.col("_first").isNotNull() & F.col("_final"),
                                       F.concat("user", note)).otherwise(F.col("user")))
            .withColumn("datetime_parsed", F.coalesce(
                "datetime_parsed", F.concat(F.coalesce(before, F.lit("1970-01-01")),
                                            F.lit("T00:00:00"))))
            .drop("_first", "_final"))


def dated_entries(entries: DataFrame, file: str = "file", source: str = "old_diary") -> DataFrame:
    """Resolved text blocks as entry rows."""
    at = F.try_to_timestamp("datetime_parsed")
    return entries.filter(at.isNotNull()).select(
        P.date_text(at).alias("date"), F.date_format(at, "HH:mm:ss").alias("time"),
        F.lit(source).alias("source"), F.col(file).alias("source_file"),
        F.lit("user").alias("role"), X.strip("user").alias("text"))


# --- days --------------------------------------------------------------------


def load_days(entries: DataFrame, roles: Iterable[str] | None = None, keys: Sequence[str] = (),
              page_chars: int = paging.PAGE_CHARS) -> DataFrame:
    """Entries nested per date, ordered by time: keys, date, page, n, entries."""
    return paging.paged_rows(filter_roles(entries, roles), [*keys, "date"],
                             paging.by_time_and_id(),
                             ["time", "source", "source_file", "role", "text", "id"],
                             "entries", F.length("text"), page_chars)


def day_text(entries: DataFrame, roles: Iterable[str] | None = None, keys: Sequence[str] = (),
             page_chars: int = paging.PAGE_CHARS) -> DataFrame:
    """Labelled text per date: keys, date, page, n, chars, text."""
    return paging.paged_text(filter_roles(entries, roles), [*keys, "date"],
                             paging.by_time_and_id(), X.entry_line(), "\n\n", page_chars)


def day_rollup(entries: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per date: entries, characters of the labelled text, distinct sources."""
    keys = list(keys)
    per_source = entries.groupBy(*keys, "date", "source").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.length(X.entry_line())).alias("_chars"))
    return per_source.groupBy(*keys, "date").agg(
        F.sum("_n").alias("entries"),
        (F.sum("_chars") + 2 * (F.sum("_n") - 1)).alias("chars"),
        F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"))
