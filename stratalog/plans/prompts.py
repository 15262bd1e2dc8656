"""Prompt tables: which days to run, and the text each model call gets."""

from __future__ import annotations

from collections.abc import Sequence
from string import Formatter

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratalog.functions import periods as P, text as X
from stratalog.operators import context as C, ingest, periods
from stratalog.schema import CHILD_LEVEL, CHILDREN_PER_UNIT, check_level

RULE = "\n\n---\n\n"
# Tokens kept free besides the output, for days and for higher levels.
DAY_RESERVE, LEVEL_RESERVE = 2000, 5000
NO_HISTORY = "(nothing recorded before)"
BELOW_NOTE = "(No earlier {level} is known; these are the '{child}' summaries before it.)\n\n"
PART_NOTE = "(part {part} of {parts})\n"
LONGEST_TEXT = 2**31 - 1  # a page that no text fills


def target_days(days: DataFrame, start: str | None = None, end: str | None = None,
                history_n: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct dates in the range, plus the ``history_n`` present days before its first.

    A range that starts after all days has no first day; then every day up to ``end`` counts.
    """
    keys = list(keys)
    dates = days.select(*keys, "date").distinct()
    if start is None:
        return ingest.filter_dates(dates, None, end).withColumn("in_range", F.lit(True))
    by_date = Window.partitionBy(*keys).orderBy("date")
    ranked = dates.withColumn("_rn", F.row_number().over(by_date))
    first = F.min(F.when(F.col("date") >= start, F.col("_rn"))).over(Window.partitionBy(*keys))
    wanted = (ranked.withColumn("_first", F.coalesce(first, F.lit(1)))
              .filter(F.col("_rn") >= F.col("_first") - history_n))
    return ingest.filter_dates(wanted, None, end).select(
        *keys, "date", (F.col("date") >= start).alias("in_range"))


def _pieces(template: str, values: dict[str, Column]) -> Column:
    """A template as a concatenation of its literals and the given columns."""
    out: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            out.append(F.lit(literal))
        if name is not None:
            out.append(values[name])
    return F.concat(*out) if out else F.lit("")


def _split_at(template: str, name: str) -> tuple[str, str]:
    mark = "{" + name + "}"
    if template.count(mark) != 1:
        raise ValueError(f"a template needs {mark} exactly once")
    head, tail = template.split(mark)
    return head, tail


def _literal_chars(template: str) -> int:
    return sum(len(literal) for literal, *_ in Formatter().parse(template))


def day_prompts(entries: DataFrame, template: str, system: str, n: int = 3,
                context_window: int = 262_144, output_budget: int = 1024,
                dates: DataFrame | None = None, keys: Sequence[str] = (),
                part_note: str = PART_NOTE, paged: bool = True) -> DataFrame:
    """Prompts per date: keys, date, page, n_history, n_dropped, prompt_chars, prompt.

    The template names {date}, {entries} and, with history, {history} and {n}.  Whole past
    days are dropped, oldest first, until the prompt fits; ``n_dropped`` says how many.  A
    day whose own text does not fit comes as several pages of half a window, each a full
    prompt without history that says which part it is; only a single entry longer than that
    can exceed the window, and stays whole.  Without ``paged`` such a day is one prompt, without
    history and longer than the window.  With ``dates`` only those days and the ``n`` before them
    are read.
    """
    keys = list(keys)
    limit = context_window - (output_budget + DAY_RESERVE)
    with_history = "{history}" in template and n > 0
    head, tail = _split_at(template, "entries")
    if dates is not None:
        dates = dates.select(*keys, "date").distinct()
        back = F.sequence(F.lit(0), F.lit(n if with_history else 0))
        needed = dates.select(*keys, F.explode(F.transform(
            back, lambda k: P.date_text(F.date_sub(P.as_date("date"), k)))).alias("date"))
        needed = needed.unionByName(dates).distinct()
        entries = entries.join(needed, [*keys, "date"], "left_semi")
    fixed = (len(system) + 1 + _literal_chars(template) + 10 * template.count("{date}")
             + len(str(n)) * template.count("{n}"))

    room = int(limit * X.CHARS_PER_TOKEN) - fixed - len("(none)") - len(part_note)
    if room <= 0:
        raise ValueError("the window has no room for a day's text")
    whole = C.day_sizes(entries, keys).withColumnRenamed("chars", "_whole")
    if paged:
        small = entries.join(whole.filter(F.col("_whole") <= room), [*keys, "date"], "left_semi")
        large = entries.join(whole.filter(F.col("_whole") > room), [*keys, "date"], "left_semi")
        pages = ingest.day_text(small, keys=keys, page_chars=room).unionByName(
            ingest.day_text(large, keys=keys, page_chars=max(room // 2, 1)))
    else:
        pages = ingest.day_text(entries, keys=keys, page_chars=LONGEST_TEXT)
    asked = pages if dates is None else pages.join(dates.select(*keys, "date"), [*keys, "date"],
                                                   "left_semi")
    if with_history:
        kept = C.day_history(entries, n, limit, fixed, keys)
        past = pages.select(*keys, F.col("date").alias("past"), F.col("page").alias("_p"),
                            F.when(F.col("page") == 0,
                                   F.concat(F.lit("["), F.col("date"), F.lit("]\n"), F.col("text")))
                            .otherwise(F.col("text")).alias("_block"))
        told = kept.join(past, [*keys, "past"]).groupBy(*keys, "date").agg(
            F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct("past", "_p", "_block"))),
                lambda r: r["_block"]), "\n\n").alias("_history"),
            F.countDistinct("past").alias("_n"))
        offered = C.history_days(whole, n, keys).groupBy(*keys, "date").agg(
            F.count(F.lit(1)).alias("_offered"))
        asked = asked.join(told, [*keys, "date"], "left").join(offered, [*keys, "date"], "left")
        history, n_history = F.coalesce("_history", F.lit("(none)")), F.coalesce("_n", F.lit(0))
        n_dropped = F.coalesce("_offered", F.lit(0)) - n_history
    else:
        history, n_history, n_dropped = F.lit("(none)"), F.lit(0), F.lit(0)
    values = {"date": F.col("date"), "history": history, "n": F.lit(str(n))}
    # Pages are numbered by their offset; a long entry may leave numbers out.
    order = Window.partitionBy(*keys, "date").orderBy("page")
    asked = asked.withColumn("_part", F.row_number().over(order))
    parts = asked.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("_parts"))
    note = F.when(F.col("_parts") > 1, _pieces(part_note, {
        "part": F.col("_part").cast("string"), "parts": F.col("_parts").cast("string")})
        ).otherwise(F.lit(""))
    text = F.concat(_pieces(head, values), note, F.col("text"), _pieces(tail, values))
    return asked.join(parts, [*keys, "date"]).select(
        *keys, "date", (F.col("_part") - 1).cast("long").alias("page"),
        n_history.cast("long").alias("n_history"), n_dropped.cast("long").alias("n_dropped"),
        F.length(text).cast("long").alias("prompt_chars"), text.alias("prompt"))


def contexts(units: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each unit as a short labelled block."""
    return units.select(*keys, "level", "period_start",
                        X.summary_context(units.columns).alias("context"))


def _join_ordered(df: DataFrame, group: Sequence[str], order: str, text: str, separator: str,
                  out: str) -> DataFrame:
    """Concatenate a small ordered group (children, earlier units, budgeted items)."""
    return df.groupBy(*group).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.col(text).alias("_t")))),
        lambda r: r["_t"]), separator).alias(out))


def earlier_units(parents: DataFrame, units: DataFrame, level: str, n: int,
                  keys: Sequence[str] = ()) -> DataFrame:
    """What each parent may be told of before it: keys, period_start, told, below.

    ``told`` has the contexts of its ``n`` earlier units of the level, oldest first, which are
    the stored ones whether or not they are asked for as well; ``below`` those of the child
    units before it, for a parent without any.  Only period names are put in order, in one
    window per stream whose rows the calendar bounds; contexts join afterwards.
    """
    keys = list(keys)
    told = contexts(units, keys)
    group = [*keys, "period_start"]
    child = CHILD_LEVEL[level]
    have = told.filter(F.col("level") == level)
    names = have.select(*group, F.lit(1).alias("_held"))
    both = parents.select(*group, F.lit(1).alias("_asked")).join(names, group, "full")
    before = Window.partitionBy(*keys).orderBy("period_start")
    # Ordinals count the units that are there; a parent looks n of them back.
    ranked = both.withColumn("_n", F.count("_held").over(
        before.rowsBetween(Window.unboundedPreceding, -1)))
    wanted = ranked.filter("_asked = 1 AND _n > 0").select(*group, F.explode(F.sequence(
        F.greatest(F.col("_n") - n, F.lit(0)), F.col("_n") - 1)).alias("_n"))
    prior = ranked.filter("_held = 1").select(*keys, "_n", F.col("period_start").alias("_prior"))
    pairs = wanted.join(prior, [*keys, "_n"]).join(
        have.select(*keys, F.col("period_start").alias("_prior"), "context"), [*keys, "_prior"])
    kids = told.filter(F.col("level") == child).select(
        *keys, F.col("period_start").alias("child"), "context")
    fallback = C.prior_children(parents, units, level, n * CHILDREN_PER_UNIT[level], keys).join(
        kids, [*keys, "child"])
    return (parents.select(*group)
            .join(_listed(pairs, group, "_prior", "context", "told"), group, "left")
            .join(_listed(fallback, group, "child", "context", "below"), group, "left")
            .select(*group, *[F.coalesce(c, _no_texts()).alias(c) for c in ("told", "below")]))


def _no_texts() -> Column:
    return F.array().cast("array<string>")


def _listed(df: DataFrame, group: Sequence[str], order: str, text: str, out: str) -> DataFrame:
    """The texts of a small ordered group as an array."""
    return df.groupBy(*group).agg(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.col(text).alias("_t")))),
        lambda r: r["_t"]).alias(out))


def _history(told: Column, below: Column, level: str, below_note: str) -> Column:
    """Earlier units, else the note and the child units, else that there is nothing."""
    note = F.lit(below_note.format(level=level, child=CHILD_LEVEL[level]))
    return (F.when(F.size(told) > 0, F.array_join(told, RULE))
            .when(F.size(below) > 0, F.concat(note, F.array_join(below, RULE)))
            .otherwise(F.lit(NO_HISTORY)))


def level_history(parents: DataFrame, units: DataFrame, level: str, n: int,
                  keys: Sequence[str] = (), below_note: str = BELOW_NOTE) -> DataFrame:
    """History text per parent: earlier units of its level, else child units before it."""
    return earlier_units(parents, units, level, n, keys).select(
        *keys, "period_start",
        _history(F.col("told"), F.col("below"), level, below_note).alias("history"))


def _newest_that_fit(lengths: Column, overhead: Column, limit: int) -> Column:
    """How many of the newest texts, oldest first in ``lengths``, fit beside the overhead."""
    def add(acc: Column, n: Column) -> Column:
        fits = acc["open"] & (X.tokens(acc["total"] + n + overhead) <= F.lit(limit))
        return F.struct((acc["total"] + n + F.lit(len(RULE))).alias("total"),
                        (acc["kept"] + fits.cast("int")).alias("kept"), fits.alias("open"))

    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("kept"),
                     F.lit(True).alias("open"))
    return F.aggregate(F.reverse(lengths), start, add)["kept"]


def _last(texts: Column, n: Column) -> Column:
    """The last ``n`` texts of an array."""
    return F.slice(texts, F.size(texts) - n + 1, n)


def _lengths(texts: Column) -> Column:
    return F.transform(texts, lambda t: F.length(t).cast("long"))


def _limit(context_window: int, output_budget: int) -> int:
    return context_window - (output_budget + LEVEL_RESERVE)


def _fixed_chars(template: str, system: str, n: int) -> Column:
    """Characters of a prompt besides entries, history and details; from period_start."""
    fixed = len(system) + 1 + _literal_chars(template) + len(str(n)) * template.count("{n}")
    return F.length("period_start") * template.count("{date}") + F.lit(fixed)


def level_parts(units: DataFrame, level: str, template: str, system: str, n: int = 3,
                context_window: int = 262_144, output_budget: int = 1024,
                grandchildren: DataFrame | None = None, parents: DataFrame | None = None,
                keys: Sequence[str] = ()) -> DataFrame:
    """What goes into the prompt of each unit of ``level`` but its earlier units: keys,
    period_start, kids, below, items, n_offered.

    ``kids`` are the children's contexts in order.  ``items`` are the newest grandchildren that
    would fit a prompt without history, so their text is bounded by the window; ``n_offered``
    counts all of them.  Lengths decide, and only the text that is kept moves.
    """
    keys = list(keys)
    child = CHILD_LEVEL[check_level(level)]
    group = [*keys, "period_start"]
    kids = periods.filter_level(units, child)
    if parents is None:
        parents = periods.rollup_level(kids, level, keys)
    told = contexts(kids, keys).select(*keys, F.col("period_start").alias("child"), "context")
    listed = parents.select(*group, F.explode("source_units").alias("child"))
    base = _listed(listed.join(told, [*keys, "child"]), group, "child", "context", "kids")
    if grandchildren is None or "{grandchild_items}" not in template:
        return base.withColumns({"items": _no_texts(), "n_offered": F.lit(0).cast("long")})
    of_kid = kids.select(*keys, F.col("period_start").alias("child"),
                         F.explode("source_units").alias("item"))
    block = F.concat(F.lit("["), F.col("item"), F.lit("]\n"), F.col("text"))
    told_of = grandchildren.filter(F.col("text") != "")
    sizes = told_of.groupBy(*keys, "item").agg(
        (F.sum(F.length(block) + len(RULE)) - len(RULE)).alias("_chars"))
    overhead = (F.length(F.array_join("kids", RULE)) + F.lit(len(NO_HISTORY)) * template.count("{history}")
                + _fixed_chars(template, system, n))
    offered = (listed.join(of_kid, [*keys, "child"]).join(sizes, [*keys, "item"])
               .join(base.select(*group, overhead.alias("_over")), group)
               .withColumn("_at", F.struct("child", "item")))
    kept = C.budget_history(offered, group, "_at", "_chars", F.col("_over"),
                            _limit(context_window, output_budget), separator=len(RULE))
    blocks = _join_ordered(told_of.select(*keys, "item", block.alias("_block"), F.col("text").alias("_t")),
                           [*keys, "item"], "_t", "_block", RULE, "_block")
    items = _listed(kept.join(blocks, [*keys, "item"]), group, "_at", "_block", "items")
    count = offered.groupBy(*group).agg(F.count(F.lit(1)).alias("n_offered"))
    return (base.join(items, group, "left").join(count, group, "left")
            .withColumns({"items": F.coalesce("items", _no_texts()),
                          "n_offered": F.coalesce("n_offered", F.lit(0).cast("long"))}))


def finish_prompts(parts: DataFrame, level: str, template: str, system: str, n: int = 3,
                   context_window: int = 262_144, output_budget: int = 1024,
                   keys: Sequence[str] = (), below_note: str = BELOW_NOTE,
                   part_note: str = PART_NOTE) -> DataFrame:
    """The prompts of rows with the columns of ``level_parts``, told and below.

    A prompt that is too long first loses grandchildren, then earlier units, the oldest first;
    ``n_dropped`` counts both.  A unit whose children alone do not fit comes as several pages of
    half a window, each a full prompt without history that says which part it is; only a single
    child longer than that can exceed the window, and stays whole.
    """
    keys = list(keys)
    limit = _limit(context_window, output_budget)
    with_history = template.count("{history}")
    rows = parts
    if with_history:
        rows = rows.withColumn("_past", F.when(F.size("told") > 0, F.col("told")).otherwise(F.col("below")))
        whole = _history(F.col("told"), F.col("below"), level, below_note)
        note = F.when(F.size("told") == 0, len(below_note.format(level=level, child=CHILD_LEVEL[level]))
                      ).otherwise(0)
    else:
        rows, whole, note = rows.withColumn("_past", _no_texts()), F.lit(""), F.lit(0)
    # Each size is a projection of its own, so that no later one computes it again.
    rows = rows.withColumns({
        "_bare": F.length(F.array_join("kids", RULE)) + _fixed_chars(template, system, n),
        "_whole": F.length(whole) * with_history, "_empty": F.lit(len(NO_HISTORY) * with_history)})
    rows = rows.withColumn("_items", _newest_that_fit(
        _lengths(F.col("items")), F.col("_bare") + F.col("_whole"), limit))
    rows = rows.withColumn("_kept", F.when(
        X.tokens(F.col("_bare") + F.col("_whole")) <= limit, F.size("_past")).otherwise(
        _newest_that_fit(_lengths(F.col("_past")), F.col("_bare") + note, limit)))
    rows = rows.withColumn("_large", X.tokens(F.col("_bare") + F.col("_empty")) > limit)
    # Pages: children by the place where they start in the whole text.
    room = F.greatest(F.lit(int(limit * X.CHARS_PER_TOKEN) - len(part_note)) - F.col("_bare")
                      + F.length(F.array_join("kids", RULE)) - F.col("_empty"), F.lit(2))
    starts = F.transform("kids", lambda k, i: F.length(F.array_join(
        F.slice("kids", F.lit(1), i), RULE)) + F.when(i > 0, len(RULE)).otherwise(0))
    pages = F.transform(starts, lambda at: F.floor(at / F.floor(room / 2)))
    cut = F.transform(F.array_distinct("_pages"), lambda p: F.array_join(
        F.filter("kids", lambda k, i: F.element_at("_pages", i + 1) == p), RULE))
    rows = rows.withColumn("_pages", F.when(F.col("_large"), pages))
    rows = rows.withColumn("_texts", F.when(F.col("_large"), cut).otherwise(
        F.array(F.array_join("kids", RULE)))).withColumn("_parts", F.size("_texts"))
    rows = rows.select("*", F.posexplode("_texts").alias("page", "_entries"))
    several = F.col("_parts") > 1
    mark = F.when(several, _pieces(part_note, {
        "part": (F.col("page") + 1).cast("string"), "parts": F.col("_parts").cast("string")})
        ).otherwise(F.lit(""))
    past = _last(F.col("_past"), F.when(F.col("_large"), 0).otherwise(F.col("_kept")))
    told = F.size("told") > 0
    history = _history(F.when(told, past).otherwise(_no_texts()),
                       F.when(told, _no_texts()).otherwise(past), level, below_note)
    n_items = F.when(F.col("_large"), 0).otherwise(F.col("_items"))
    items = _last(F.col("items"), n_items)
    prompt = _pieces(template, {
        "date": F.col("period_start"), "entries": F.concat(mark, "_entries"), "history": history,
        "n": F.lit(str(n)), "grandchild_items": F.when(F.size(items) > 0, F.array_join(items, RULE))
        .otherwise(F.lit("(none)"))})
    return rows.select(
        *keys, F.lit(level).alias("level"), "period_start", F.col("page").cast("long").alias("page"),
        F.size("kids").cast("long").alias("n_children"), n_items.cast("long").alias("n_grandchildren"),
        F.size(past).cast("long").alias("n_history"),
        (F.col("n_offered") - n_items + F.size("_past") - F.size(past)).cast("long").alias("n_dropped"),
        prompt.alias("prompt")).withColumn("prompt_chars", F.length("prompt").cast("long"))


def level_prompts(units: DataFrame, level: str, template: str, system: str, n: int = 3,
                  context_window: int = 262_144, output_budget: int = 1024,
                  grandchildren: DataFrame | None = None, parents: DataFrame | None = None,
                  keys: Sequence[str] = ()) -> DataFrame:
    """The prompts per unit of ``level``: keys, level, period_start, page, n_children,
    n_grandchildren, n_history, n_dropped, prompt, prompt_chars.

    ``units`` holds the child level and the earlier units of this one, all of them stored; in a
    run where earlier units are only now described see ``waves``.  ``grandchildren`` has
    keys, item and text.  What does not fit the window is said in ``finish_prompts``.
    """
    keys = list(keys)
    if parents is None:
        parents = periods.rollup_level(periods.filter_level(units, CHILD_LEVEL[check_level(level)]),
                                       level, keys)
    parts = level_parts(units, level, template, system, n, context_window, output_budget,
                        grandchildren, parents, keys)
    if "{history}" in template:
        parts = parts.join(earlier_units(parents, units, level, n, keys), [*keys, "period_start"])
    else:
        parts = parts.withColumns({"told": _no_texts(), "below": _no_texts()})
    return finish_prompts(parts, level, template, system, n, context_window, output_budget, keys)
