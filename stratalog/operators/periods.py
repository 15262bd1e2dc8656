"""Units on the calendar: listing, rollup, lookup, nearest period, trends.

Windows here run on tables with one row per stream and period, which the calendar
bounds; raw entries never enter them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratalog.functions import periods as P
from stratalog.operators import ingest, paging
from stratalog.schema import check_level

SCORES = ("energy_level", "social_connectedness", "forward_momentum")


def filter_level(units: DataFrame, level: str) -> DataFrame:
    return units.filter(F.col("level") == check_level(level))


def list_periods(units: DataFrame, level: str, keys: Sequence[str] = ()) -> DataFrame:
    return filter_level(units, level).select(*keys, "period_start").distinct()


def list_raw_dates(entries: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return entries.select(*keys, "date").distinct()


def period_bounds(units: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First and last period and their number per level, instead of a full list."""
    return units.groupBy(*keys, "level").agg(
        F.min("period_start").alias("first_period"), F.max("period_start").alias("last_period"),
        F.countDistinct("period_start").alias("periods"))


def status_summary(units: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return units.groupBy(*keys, "level").agg(F.count(F.lit(1)).alias("units"))


def group_key(level: str, column: str = "period_start") -> Column:
    """Key under which children of the level below are gathered."""
    return {"week": P.iso_week_key, "month": P.month_key, "year": P.year_key}[level](column)


def rollup_level(children: DataFrame, level: str, keys: Sequence[str] = ()) -> DataFrame:
    """Units of ``level`` from the units one level below.

    A week starts on its first present day; a month takes the weeks that start in it and
    is named by the last of them; a year takes the months.  A group holds at most seven,
    six or twelve children, so the ordered child list stays small.
    """
    if check_level(level) == "day":
        raise ValueError("days come from entries, see day_units")
    g = children.withColumn("_group", group_key(level)).groupBy(*keys, "_group").agg(
        F.min("period_start").alias("_first"), F.max("period_start").alias("_last"),
        F.max_by("period_end", "period_start").alias("period_end"),
        F.sort_array(F.collect_list("period_start")).alias("source_units"),
        F.sum("source_entry_count").alias("source_entry_count"))
    start = {"week": F.col("_first"), "month": P.month_key("_last"),
             "year": P.year_key("_last")}[level]
    return g.select(*keys, F.lit(level).alias("level"), start.alias("period_start"),
                    "period_end", "source_units", "source_entry_count")


def day_units(entries: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Structural day units: one per date with its entry count."""
    d = entries.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("source_entry_count"))
    return d.select(*keys, F.lit("day").alias("level"), F.col("date").alias("period_start"),
                    F.col("date").alias("period_end"), F.array("date").alias("source_units"),
                    "source_entry_count")


def period_tree(units: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Parent unit of every unit: month to year, day to month, week to month or else year."""
    keys = list(keys)
    months = filter_level(units, "month").select(
        *keys, F.col("period_start").alias("_month"), F.lit(1).alias("_has")).distinct()
    rows = units.withColumn("_month", P.month_key("period_start")).join(
        months, [*keys, "_month"], "left")
    year = F.struct(F.lit("year").alias("level"), P.year_key("period_start").alias("key"))
    month = F.struct(F.lit("month").alias("level"), F.col("_month").alias("key"))
    parent = (F.when(F.col("level") == "month", year)
              .when(F.col("level") == "day", month)
              .when((F.col("level") == "week") & F.col("_has").isNotNull(), month)
              .when(F.col("level") == "week", year))
    return rows.select(*keys, "level", "period_start", parent["level"].alias("parent_level"),
                       parent["key"].alias("parent_period"))


# --- lookup ------------------------------------------------------------------


def nearest_periods(requests: DataFrame, available: DataFrame, keys: Sequence[str] = (),
                    period: str = "period") -> DataFrame:
    """Greatest available period before and smallest after each distinct request, strictly.

    Both sides shrink to distinct periods first.  Two one-directional windows in opposite
    order keep each pass linear.
    """
    keys = list(keys)
    have = available.select(*keys, F.col(period).alias("_p"), F.lit(True).alias("_have"),
                            F.lit(False).alias("_ask"))
    ask = requests.select(*keys, F.col(period).alias("_p"), F.lit(False).alias("_have"),
                          F.lit(True).alias("_ask"))
    marks = have.unionByName(ask).groupBy(*keys, "_p").agg(
        F.bool_or("_have").alias("_have"), F.bool_or("_ask").alias("_ask"))
    held = F.when(F.col("_have"), F.col("_p"))
    group = Window.partitionBy(*keys)
    frame = (Window.unboundedPreceding, -1)
    return (marks
            .withColumn("previous", F.last(held, ignorenulls=True).over(
                group.orderBy("_p").rowsBetween(*frame)))
            .withColumn("next", F.last(held, ignorenulls=True).over(
                group.orderBy(F.desc("_p")).rowsBetween(*frame)))
            .filter("_ask")
            .select(*keys, F.col("_p").alias(period), "previous", "next"))


def _hint(subject: Column, noun: str, nothing: str) -> Column:
    near = F.concat(F.lit(f" Nearest {noun}: before "), F.coalesce("previous", F.lit("none")),
                    F.lit(", after "), F.coalesce("next", F.lit("none")))
    some = F.col("previous").isNotNull() | F.col("next").isNotNull()
    return F.concat(subject, F.when(some, near).otherwise(F.lit(nothing)))


def lookup_periods(requests: DataFrame, units: DataFrame, level: str,
                   keys: Sequence[str] = (), period: str = "period") -> DataFrame:
    """Per request the unit with status ``success``, or ``not_found`` with a hint."""
    keys = list(keys)
    at = filter_level(units, level)
    body = [c for c in at.columns if c not in (*keys, "period_start")]
    found = at.withColumnRenamed("period_start", period).withColumn("_hit", F.lit(True))
    near = nearest_periods(requests, found.select(*keys, period), keys, period)
    subject = F.concat(F.lit(f"There is no {level} "), F.col(period), F.lit("."))
    return (requests.join(found, [*keys, period], "left").join(near, [*keys, period])
            .select(*keys, F.col(period).alias("request"),
                    F.when(F.col("_hit"), "success").otherwise("not_found").alias("status"),
                    *[c for c in body if c != "level"],
                    F.when(F.col("_hit").isNull(), _hint(
                        subject, "periods", " Nothing is stored there yet.")).alias("hint")))


def lookup_raw(requests: DataFrame, entries: DataFrame, keys: Sequence[str] = (),
               period: str = "period", page_chars: int = paging.PAGE_CHARS) -> DataFrame:
    """Per request the day's entries (one row per page), or ``not_found`` with a hint."""
    keys = list(keys)
    wanted = requests.select(*keys, F.col(period).alias("date")).distinct()
    days = ingest.load_days(entries.join(wanted, [*keys, "date"], "left_semi"), keys=keys,
                            page_chars=page_chars).withColumnRenamed("date", period)
    dates = list_raw_dates(entries, keys).withColumnRenamed("date", period)
    near = nearest_periods(requests, dates, keys, period)
    subject = F.concat(F.lit("There are no entries of "), F.col(period), F.lit("."))
    return (requests.join(days, [*keys, period], "left").join(near, [*keys, period])
            .select(*keys, F.col(period).alias("request"),
                    F.when(F.col("page").isNotNull(), "success").otherwise("not_found")
                    .alias("status"),
                    "page", "n", "entries",
                    F.when(F.col("page").isNull(), _hint(
                        subject, "dates", " Nothing is stored there yet.")).alias("hint")))


# --- sequences ---------------------------------------------------------------


def prior_units(units: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """The up to ``n`` earlier units of the same level, oldest first."""
    w = (Window.partitionBy(*keys, "level").orderBy("period_start").rowsBetween(-n, -1))
    return units.withColumn("prior", F.collect_list("period_start").over(w))


def lookback_stats(days: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """Days present and entries written in the ``n`` calendar days before each day."""
    w = Window.partitionBy(*keys).orderBy("_day").rangeBetween(-n, -1)
    return (days.withColumn("_day", P.epoch_day("date"))
            .select(*keys, "date", F.count(F.lit(1)).over(w).alias("days_before"),
                    F.coalesce(F.sum("entries").over(w), F.lit(0)).alias("entries_before")))


def trend(units: DataFrame, level: str, keys: Sequence[str] = ()) -> DataFrame:
    """Scores per period in order, missing as 0, all-zero periods left out, with deltas."""
    names = dict(zip(SCORES, ("energy", "social", "momentum")))
    scored = filter_level(units, level).select(
        *keys, F.col("period_start").alias("period"),
        *[F.coalesce(c, F.lit(0)).alias(a) for c, a in names.items()])
    kept = scored.filter(" OR ".join(f"{a} <> 0" for a in names.values()))
    w = Window.partitionBy(*keys).orderBy("period")
    return kept.select("*", *[(F.col(a) - F.lag(a).over(w)).alias(f"{a}_delta")
                              for a in names.values()])


def project_metrics(units: DataFrame, level: str, keys: Sequence[str] = ()) -> DataFrame:
    return filter_level(units, level).select(*keys, "period_start", *SCORES)


def notable_periods(units: DataFrame, level: str, low: int = 3, high: int = 8,
                    keys: Sequence[str] = ()) -> DataFrame:
    """Periods where any score is at most ``low`` or at least ``high``."""
    return (project_metrics(units, level, keys)
            .filter((F.least(*SCORES) <= low) | (F.greatest(*SCORES) >= high)))


def first_events(c: str | Column = "key_events", n: int = 5) -> Column:
    return F.slice(c, 1, n)
