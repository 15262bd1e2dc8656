"""The day, week, month, year hierarchy: full runs, invalidation, staleness."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from stratalog.functions import periods as P, replies as R, text as X
from stratalog.operators import ingest, periods
from stratalog.plans import models, prompts, waves
from stratalog.schema import CHILD_LEVEL, LEVELS, check_level
from stratalog.session import cut_lineage, stored

UNIT = ("level", "period_start", "period_end", "source_units", "source_entry_count")


def cascade_keys(new_days: DataFrame, units: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Units above changed days: keys, level, period_start.

    The week is the stored unit of that ISO week, else its Monday.  Months follow the
    week's start, both the stored one and the one it has with the new days, so a week
    across a month boundary reaches the month that really contains it.
    """
    keys = list(keys)
    changed = new_days.select(*keys, F.col("date").alias("_d")).filter(
        P.as_date("_d").isNotNull()).withColumn("_w", P.iso_week_key("_d"))
    weeks = changed.groupBy(*keys, "_w").agg(F.min("_d").alias("_new"),
                                             F.min(P.week_monday("_d")).alias("_monday"))
    stored = periods.filter_level(units, "week").groupBy(
        *keys, P.iso_week_key("period_start").alias("_w")).agg(
            F.max("period_start").alias("_old"))
    days = periods.filter_level(units, "day").groupBy(
        *keys, P.iso_week_key("period_start").alias("_w")).agg(
            F.min("period_start").alias("_first"))
    hit = (weeks.join(stored, [*keys, "_w"], "left").join(days, [*keys, "_w"], "left")
           .withColumn("_start", F.least("_new", F.coalesce("_first", "_new"))))
    week = F.struct(F.lit("week").alias("level"), F.coalesce("_old", "_monday").alias("key"))
    spans = [F.coalesce("_old", "_start"), F.col("_start")]
    months = [F.struct(F.lit("month").alias("level"), P.month_key(c).alias("key")) for c in spans]
    years = [F.struct(F.lit("year").alias("level"), P.year_key(c).alias("key")) for c in spans]
    return (hit.select(*keys, F.explode(F.array_distinct(F.array(week, *months, *years)))
                       .alias("_u"))
            .select(*keys, F.col("_u.level").alias("level"), F.col("_u.key").alias("period_start"))
            .distinct())


def structural_units(entries: DataFrame, levels: Sequence[str] = LEVELS,
                     keys: Sequence[str] = ()) -> DataFrame:
    """All units of all levels without text: identity, span, children, entry count."""
    below = periods.day_units(entries, keys)
    out = [below]
    for level in LEVELS[1:]:
        below = periods.rollup_level(below, level, keys)
        out.append(below)
    cols = [*keys, *UNIT]
    wanted = [u.select(*cols) for u, name in zip(out, LEVELS) if name in levels]
    return ingest.union_sources(*wanted)


def run_hierarchy(entries: DataFrame, units: DataFrame | None = None,
                  levels: Sequence[str] = LEVELS,
                  target_range: tuple[str, str] | None = None, cascade: bool = True,
                  history_n: int = 3, keys: Sequence[str] = (),
                  describe: Callable[[str, DataFrame, DataFrame], DataFrame] | None = None
                  ) -> DataFrame:
    """Bring a unit store up to date with the entries and return the whole store.

    Days in the range (plus ``history_n`` present days before it) that have no unit yet
    are added; units above new days are dropped; then each level is completed from the
    whole level below.  Finished units are kept.  ``describe(level, pending, store)`` may
    add text columns to the pending units; the new units of a level are made durable before
    the next reads them.
    """
    for level in levels:
        check_level(level)
    keys = list(keys)
    days = periods.day_units(entries, keys)
    if target_range:
        wanted = prompts.target_days(entries, *target_range, history_n, keys)
        days = days.join(wanted.select(*keys, F.col("date").alias("period_start")),
                         [*keys, "period_start"], "left_semi").select(*days.columns)

    def settle(level: str, pending: DataFrame, store: DataFrame | None) -> DataFrame:
        # Only the new units are made durable; the store itself is not written again.
        done = stored(pending if describe is None else describe(level, pending, store), "units")
        return done if store is None else store.unionByName(done, allowMissingColumns=True)

    store = units
    if "day" in levels:
        pending = days if store is None else ingest.pending_units(days, store, keys)
        if store is not None and cascade:
            pending = cut_lineage(pending)
            new = pending.select(*keys, F.col("period_start").alias("date"))
            store = ingest.invalidate_units(store, cascade_keys(new, store, keys), keys)
        store = settle("day", pending, store)
    for level in LEVELS[1:]:
        if level not in levels or store is None:
            continue
        below = periods.filter_level(store, LEVELS[LEVELS.index(level) - 1])
        candidates = periods.rollup_level(below, level, keys)
        store = settle(level, ingest.pending_units(candidates, store, keys), store)
    return store


def describe_with(fn: models.ModelFn, entries: DataFrame, templates: dict[str, str],
                  system: str, n: int = 3, context_window: int = 262_144,
                  output_budget: int = 1024, concurrency: int | None = None,
                  keys: Sequence[str] = (), journal: str | None = None
                  ) -> Callable[[str, DataFrame, DataFrame], DataFrame]:
    """A ``describe`` for ``run_hierarchy``: build prompts, call the model, parse sections.

    Templates are looked up as ``<level>_historical``, then ``<level>_isolated``.  A unit
    whose text needs several prompt pages gets one call per page, and the fields of all
    pages are merged (``merge_pages``).  Above days the summaries two levels down are offered
    as {grandchild_items}, for weeks the days' own entries, and a unit's {history} tells of the
    earlier units that this run describes as well: they are asked in ``waves``.  With a
    ``journal`` answers outlive the run (``models.ask_once``).
    """
    keys = list(keys)
    on = [*keys, "period_start"]

    def template(level: str) -> str:
        found = templates.get(f"{level}_historical") or templates.get(f"{level}_isolated")
        if found is None:
            raise KeyError(f"no template for level {level}")
        return found

    built: dict[str, list] = {}  # columns that every wave needs alike, made once

    def fields_of(asked: DataFrame) -> DataFrame:
        """One row per unit with the fields of its replies; from keys, period_start, page, prompt."""
        replied = models.apply_model(asked.select(*on, "page", "prompt"), fn, system, "prompt",
                                     concurrency, journal=journal).drop("prompt")
        if not built:
            built["stages"] = [{"_clean": X.strip_thinking("reply")}, *R.parse_stages("_clean", "_s")]
            built["totals"] = [
                F.collect_list(F.struct("page", "_s")).alias("_pages"),
                F.min_by(X.thinking_trace("reply"), "page").alias("thinking_trace"),
                F.sum("tokens_in").alias("token_count_input"),
                F.sum("tokens_out").alias("token_count_output"),
                F.sum("seconds").alias("processing_time_seconds")]
            # Maps have no order of their own.
            built["in_order"] = [F.array_sort(
                "_pages", lambda a, b: a["page"].cast("int") - b["page"].cast("int")).alias("_pages")]
        parsed = R.parse_replies(replied, stages=built["stages"])
        if "merged" not in built:
            fields = merge_pages("_pages", parsed.schema["_s"].dataType)
            names = [f.name for f in parsed.schema["_s"].dataType.fields]
            built["merged"] = [X.present(c).alias(n) if n == "summary" else c
                               for n, c in zip(names, fields)]
        rest = ["thinking_trace", "token_count_input", "token_count_output", "processing_time_seconds"]
        return (parsed.groupBy(*on).agg(*built["totals"]).select(*on, *rest, *built["in_order"])
                .select(*on, *built["merged"], *rest))

    def describe(level: str, pending: DataFrame, store: DataFrame) -> DataFrame:
        own = template(level)
        if level == "day":
            asked = prompts.day_prompts(
                entries, own, system, n, context_window, output_budget,
                pending.select(*keys, F.col("period_start").alias("date")), keys
            ).withColumnRenamed("date", "period_start")
            # Replies are stored before anything reads them, so no call is repeated later on.
            return pending.join(stored(fields_of(asked), "described"), on, "left")
        # Units, and with them the plans of the levels below, are read from written tables.
        pending = stored(pending, "pending")
        back = n if "{history}" in own else 0
        below = store.filter(F.col("level").isin(level, CHILD_LEVEL[level]))
        parts = prompts.level_parts(
            store, level, own, system, n, context_window, output_budget,
            _grandchildren(level, store, entries, own, keys), pending, keys)
        ahead = waves.frontier(pending, below, level, back, keys)
        if back:
            known = prompts.earlier_units(pending, below.filter(F.col("level") != level), level, n,
                                          keys).select(*on, "below")
            parts = parts.join(known, on)
        else:
            parts = parts.withColumn("below", prompts._no_texts())
        rows = parts.join(ahead, on).join(pending.select(*on, "period_end"), on)

        def ask(now: DataFrame) -> DataFrame:
            asked = prompts.finish_prompts(now, level, own, system, n, context_window, output_budget, keys)
            told = now.select(*on, "run", "told", "period_end").join(fields_of(asked), on)
            if "context" not in built:
                built["context"] = [X.summary_context(told.columns)]
            return told.withColumn("context", *built["context"]).drop("period_end")

        return pending.join(waves.in_waves(rows, back, ask, keys), on, "left")

    return describe


def _grandchildren(level: str, store: DataFrame, entries: DataFrame, template: str,
                   keys: Sequence[str]) -> DataFrame | None:
    """What lies two levels below: entries of days for a week, else stored summaries."""
    if "{grandchild_items}" not in template:
        return None
    if level == "week":
        return ingest.day_text(entries, keys=keys).select(*keys, F.col("date").alias("item"), "text")
    below = periods.filter_level(store, CHILD_LEVEL[CHILD_LEVEL[level]])
    return prompts.contexts(below, keys).select(
        *keys, F.col("period_start").alias("item"), F.col("context").alias("text"))


def merge_pages(pages: str, fields: T.StructType) -> list[Column]:
    """One column per field from ordered (page, fields) structs.

    Lists are strung together without repeats; texts, and the different values that a key of a
    map has on the pages, are joined by line: of these nothing is lost.  A field of one word or
    number (keywords, tone, scores) comes from the first page that has it.
    """
    one_line = (*R.KEYWORD_FIELDS, "emotional_tone")

    def merged(field: T.StructField) -> Column:
        values = F.filter(F.transform(pages, lambda p: p["_s"][field.name]),
                          lambda v: v.isNotNull())
        if isinstance(field.dataType, T.ArrayType):
            return F.array_distinct(F.flatten(values))
        if isinstance(field.dataType, T.MapType):
            named = F.array_distinct(F.flatten(F.transform(values, F.map_keys)))
            return F.map_from_arrays(named, F.transform(named, lambda k: F.array_join(
                F.array_distinct(F.filter(F.transform(values, lambda m: F.try_element_at(m, k)),
                                          lambda v: v != "")), "\n")))
        if isinstance(field.dataType, T.StringType) and field.name not in one_line:
            told = F.filter(values, lambda v: v != "")
            return F.when(F.size(values) > 0, F.array_join(told, "\n"))
        return F.get(values, 0)

    return [merged(f).alias(f.name) for f in fields]


# --- staleness ---------------------------------------------------------------


def day_hashes(entries: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, date, n, total: the number and the sum of a day's entry ids.

    Both add up, so they combine on the map side, do not depend on order, and those of a batch
    merge with the stored ones (``merge_day_hashes``).
    """
    number = F.conv("id", 16, 10).cast("decimal(20,0)")
    return entries.groupBy(*keys, "date").agg(
        F.count(F.lit(1)).alias("n"), F.sum(number).alias("total"))


def merge_day_hashes(stored: DataFrame | None, batch: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The day hashes of the stored entries and of a batch that is new to them."""
    if stored is None:
        return batch
    return stored.unionByName(batch).groupBy(*keys, "date").agg(
        F.sum("n").alias("n"), F.sum("total").cast("decimal(30,0)").alias("total"))


def fingerprints(entries: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A hash per unit over its inputs, for all levels: keys, level, period_start, fingerprint."""
    return fingerprints_of(day_hashes(entries, keys), keys)


def fingerprints_of(days: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The fingerprints of all levels from day hashes alone; a unit hashes its children's in order."""
    keys = list(keys)
    level_units = days.select(
        *keys, F.lit("day").alias("level"), F.col("date").alias("period_start"),
        F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("total").cast("string")), 256)
        .alias("fingerprint"))
    out = [level_units]
    for level in LEVELS[1:]:
        g = level_units.withColumn("_group", periods.group_key(level)).groupBy(
            *keys, "_group").agg(
                F.min("period_start").alias("_first"),
                F.array_sort(F.collect_list(F.struct("period_start", "fingerprint"))).alias("_c"))
        start = F.col("_first") if level == "week" else F.col("_group")
        level_units = g.select(*keys, F.lit(level).alias("level"), start.alias("period_start"),
                               F.sha2(F.array_join(F.transform("_c", lambda c: c["fingerprint"]),
                                                   "|"), 256).alias("fingerprint"))
        out.append(level_units)
    return ingest.union_sources(*out)


def stale_units(current: DataFrame, stored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Units that are new, changed or gone since the stored fingerprints were taken."""
    on = [*keys, "level", "period_start"]
    both = current.select(*on, F.col("fingerprint").alias("_now")).join(
        stored.select(*on, F.col("fingerprint").alias("_then")), on, "full_outer")
    change = (F.when(F.col("_then").isNull(), "new").when(F.col("_now").isNull(), "gone")
              .when(F.col("_now") != F.col("_then"), "changed"))
    return both.withColumn("change", change).filter(F.col("change").isNotNull()).select(
        *on, "change")
