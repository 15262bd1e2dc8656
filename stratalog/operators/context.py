"""Context around dates and units: calendar windows, histories, budgets, chunks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from stratalog.functions import periods as P, text as X
from stratalog.operators import paging
from stratalog.schema import CHILD_LEVEL, check_level
from stratalog.session import cut_lineage


def context_window(entries: DataFrame, centers: DataFrame, n_before: int, n_after: int,
                   keys: Sequence[str] = (), center: str = "center_date",
                   page_chars: int = paging.PAGE_CHARS) -> DataFrame:
    """All entries from ``n_before`` days before to ``n_after`` days after each center.

    The context depends on the date alone, so it is built once per distinct center and
    not once per mention.  Offsets are exploded onto the centers and equi-joined with day
    blocks; where a block starts inside its context follows from the lengths of the few
    days before it.  Columns: keys, center, page, n, start, chars, text; days without text
    are left out.
    """
    keys = list(keys)
    around = (centers.select(*keys, center).distinct()
              .withColumn("_c", P.as_date(center)).filter(F.col("_c").isNotNull())
              .withColumn("delta", F.explode(F.sequence(F.lit(-n_before), F.lit(n_after))))
              .withColumn("date", P.date_text(F.date_add("_c", F.col("delta")))).drop("_c"))
    near = (entries.join(around.select(*keys, "date").distinct(), [*keys, "date"], "left_semi")
            .filter(X.nonblank("text")))
    body = X.strip("text")
    line = F.when(F.col("time") != "", F.concat(F.lit("  ["), F.col("time"), F.lit("] "), body)
                  ).otherwise(F.concat(F.lit("  "), body))
    blocks = paging.paged_text(near, [*keys, "date"], paging.by_time_and_id(), line, "\n",
                               page_chars)
    sizes = near.groupBy(*keys, "date").agg((F.sum(F.length(line) + 1) - 1).alias("_day_chars"))
    head = F.concat(F.lit("\n\n=== Raw entries: "), F.col("date"), F.lit(" ("),
                    X.day_label("delta"), F.lit(") ===\n"))
    # At most n_before + n_after + 1 rows per center.
    w = (Window.partitionBy(*keys, center).orderBy("delta")
         .rowsBetween(Window.unboundedPreceding, -1))
    placed = (around.join(sizes, [*keys, "date"]).withColumn("_head", head)
              .withColumn("_base", F.coalesce(
                  F.sum(F.length("_head") + F.col("_day_chars")).over(w), F.lit(0))))
    # A block's later pages follow its first on a new line; the blank line in front of a
    # context's first block is cut off at the end.
    first = F.col("_page") == 0
    parts = placed.join(blocks.select(*keys, "date", F.col("page").alias("_page"), "start", "text"),
                        [*keys, "date"]).select(
        *keys, center, "delta", "_page",
        (F.col("_base") + F.when(first, 0).otherwise(F.length("_head") + F.col("start") - 1))
        .alias("_at"),
        F.when(first, F.concat("_head", "text")).otherwise(F.concat(F.lit("\n"), "text"))
        .alias("_text")).withColumn("page", F.floor(F.col("_at") / F.lit(page_chars)))
    joined = paging.concat_pages(parts, [*keys, center], ["delta", "_page"], "")
    opening = F.col("page") == 0
    return joined.select(
        *keys, center, "page", "n",
        F.when(opening, 0).otherwise(F.col("start") - 2).alias("start"),
        F.when(opening, F.col("chars") - 2).otherwise(F.col("chars")).alias("chars"),
        F.when(opening, F.substring("text", F.lit(3), F.length("text")))
        .otherwise(F.col("text")).alias("text"))


def history_days(days: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs (date, past date) of present days with the past in [date - n, date).

    At most ``n`` rows per day, by an equi-join on exploded offsets.
    """
    keys = list(keys)
    wanted = (days.select(*keys, "date")
              .withColumn("back", F.explode(F.sequence(F.lit(1), F.lit(n))))
              .withColumn("past", P.date_text(F.date_sub(P.as_date("date"), F.col("back")))))
    rest = [c for c in days.columns if c not in (*keys, "date")]
    present = days.select(*keys, F.col("date").alias("past"), *rest)
    return wanted.join(present, [*keys, "past"])


def budget_history(items: DataFrame, group: Sequence[str], order: str, chars: str,
                   overhead: Column, limit: int, separator: int = 2) -> DataFrame:
    """Keep the longest run of newest items with which the whole prompt fits ``limit``.

    ``chars`` is an item's length, ``overhead`` the length of everything else.  Items of a
    group are few by construction (days back, children), and only lengths are sorted.
    """
    w = (Window.partitionBy(*group).orderBy(F.desc(order))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum(F.col(chars) + F.lit(separator)).over(w) - F.lit(separator)
    return (items.withColumn("_total", total)
            .filter(X.tokens(F.col("_total") + overhead) <= F.lit(limit)).drop("_total"))


def day_history(entries: DataFrame, n: int, context_tokens: int, overhead_chars: int,
                keys: Sequence[str] = ()) -> DataFrame:
    """Which past days go into each day's prompt: keys, date, past, chars.

    ``overhead_chars`` counts the system prompt, its newline and the template.  Only the
    lengths of days are needed, so no text is moved.
    """
    keys = list(keys)
    days = day_sizes(entries, keys)
    own = days.select(*keys, "date", F.col("chars").alias("_own"))
    pairs = history_days(days, n, keys).withColumn("chars", F.col("chars") + 13)
    kept = budget_history(pairs.join(own, [*keys, "date"]), [*keys, "date"], "past", "chars",
                          F.col("_own") + F.lit(overhead_chars), context_tokens)
    return kept.select(*keys, "date", "past", "chars")


def day_sizes(entries: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Length of each day's labelled text, without building it."""
    return entries.groupBy(*keys, "date").agg(
        (F.sum(F.length(X.entry_line()) + 2) - 2).alias("chars"))


def attach_children(parents: DataFrame, children: DataFrame, keys: Sequence[str] = (),
                    ) -> DataFrame:
    """One row per parent and listed source unit that exists: the child's columns follow."""
    keys = list(keys)
    listed = parents.select(*keys, "level", "period_start",
                            F.explode("source_units").alias("child"))
    body = [c for c in children.columns if c not in (*keys, "level", "period_start")]
    have = children.select(*keys, F.col("period_start").alias("child"),
                           F.col("level").alias("child_level"),
                           *[F.col(c).alias(f"child_{c}") for c in body])
    return listed.join(have, [*keys, "child"])


def prior_children(parents: DataFrame, children: DataFrame, level: str, k: int,
                   keys: Sequence[str] = ()) -> DataFrame:
    """The last ``k`` child units that start before each parent (string order).

    Children get an ordinal; a parent's ordinal is the number of children before it, and
    the ``k`` ordinals below are exploded and equi-joined.
    """
    keys = list(keys)
    child_level = CHILD_LEVEL[check_level(level)]
    kids = children.filter(F.col("level") == child_level).select(*keys, "period_start")
    mums = parents.filter(F.col("level") == level).select(*keys, "period_start")
    # At one string the parent sorts first, so that an equal child does not count as earlier.
    both = (kids.withColumn("_kid", F.lit(1)).unionByName(mums.withColumn("_kid", F.lit(0))))
    w = (Window.partitionBy(*keys).orderBy("period_start", "_kid")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = both.withColumn("_n", F.sum("_kid").over(w))
    kid_rank = ranked.filter("_kid = 1").select(*keys, F.col("period_start").alias("child"),
                                                F.col("_n").alias("_ordinal"))
    asked = (ranked.filter((F.col("_kid") == 0) & (F.col("_n") > 0))
             .withColumn("_ordinal", F.explode(F.sequence(
                 F.greatest(F.col("_n") - F.lit(k - 1), F.lit(1)), F.col("_n")))))
    return (asked.join(kid_rank, [*keys, "_ordinal"])
            .select(*keys, F.lit(level).alias("level"), "period_start",
                    F.lit(child_level).alias("child_level"), "child"))


# --- chunks ------------------------------------------------------------------


def chunk_budget(context_window: int, output_tokens: int, fixed_tokens: int,
                 margin: float = 0.05) -> int:
    """Tokens left for the blocks of one chunk; an error if the window leaves none."""
    left = context_window - output_tokens - fixed_tokens - int(context_window * margin)
    if left <= 0:
        raise ValueError(f"a window of {context_window} tokens has no room for blocks: "
                         f"{output_tokens} for the output and {fixed_tokens} fixed ones")
    return left


def pack_chunks(blocks: DataFrame, group: Sequence[str], order: paging.Order, budget: int,
                overlap: int = 3, tokens: str = "tokens", segment: int = 65_536) -> DataFrame:
    """Greedy packing into chunks of at most ``budget`` tokens, sharing ``overlap`` blocks.

    A chunk closes before the block that would exceed the budget; the next one opens with
    the last ``overlap`` blocks and takes that block whatever its size.  So where a chunk
    that closed at block e is followed by one closing at f(e), f depends on e alone:

        f(e) = max(e + 1, number of blocks whose prefix sum is <= budget + prefix(s)),
        s = max(0, e - overlap)

    f is an as-of lookup in prefix sums, done in windows over ``budget``-wide token buckets.
    The chain 0, f(0), f(f(0)) ... is then walked segment by segment: a task follows it
    through ``segment`` blocks.  Groups longer than a segment first get every block's way
    out of its segment, and the segments a chain enters are found by pointer doubling, in
    log2(segments) rounds of equi-joins.  No task sees more than a segment of a group.
    Returns group, chunk, block and the order columns, one row per block and chunk.
    """
    group = list(group)
    # Only keys and sizes from here on, written once instead of deriving the blocks twice.
    slim = cut_lineage(blocks.select(*group, *order.columns,
                                     F.col(tokens).cast("long").alias("_tok")))
    at = cut_lineage(paging.running_total(slim, group, order,
                                          {"block": F.lit(1), "_before": F.col("_tok")}))
    count = at.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))

    # Prefix sums P(0)..P(n-1) sit at their block; P(n) closes the group.
    ends = at.groupBy(*group).agg(F.count(F.lit(1)).alias("_j"),
                                  F.sum("_tok").alias("_p"))
    prefix = at.select(*group, F.col("block").alias("_j"), F.col("_before").alias("_p")
                       ).unionByName(ends)
    start = at.select(*group, F.col("block").alias("_s"), F.col("_before").alias("_ps"))
    asks = (at.select(*group, F.col("block").alias("_e"))
            .withColumn("_s", F.greatest(F.col("_e") - F.lit(overlap), F.lit(0)))
            .join(start, [*group, "_s"])
            .withColumn("_q", F.col("_ps") + F.lit(budget)))

    def bucket(c: str) -> Column:
        return F.floor(F.col(c) / F.lit(budget))

    none = F.lit(None).cast("long")
    points = prefix.select(*group, bucket("_p").alias("_b"), F.col("_p").alias("_v"),
                           F.lit(0).alias("_ask"), "_j", none.alias("_e"))
    # Every bucket also knows the last block of the bucket below: the lookup's own start
    # lies there, so an answer always exists.
    carried = prefix.groupBy(*group, (bucket("_p") + 1).alias("_b")).agg(
        F.max("_j").alias("_j")).select(*group, "_b", F.lit(-1).cast("long").alias("_v"),
                                        F.lit(0).alias("_ask"), "_j", none.alias("_e"))
    asked = asks.select(*group, bucket("_q").alias("_b"), F.col("_q").alias("_v"),
                        F.lit(1).alias("_ask"), none.alias("_j"), "_e")
    w = (Window.partitionBy(*group, "_b").orderBy("_v", "_ask")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = (points.unionByName(carried).unionByName(asked)
             .withColumn("_hit", F.max("_j").over(w)).filter("_ask = 1"))
    seg = F.floor(F.col("_e") / F.lit(segment))
    step = found.select(*group, seg.alias("_seg"), "_e",
                        F.greatest(F.col("_hit"), F.col("_e") + 1).alias("_f"))
    entry = count.select(*group, F.lit(0).cast("long").alias("_entry"),
                         F.lit(0).cast("long").alias("_chunk"))
    if not count.filter(F.col("_n") > segment).isEmpty():
        step = cut_lineage(step)
        entry = _segment_entries(step, entry, count, group, segment)
    entered = step.join(entry.withColumn("_seg", F.floor(F.col("_entry") / F.lit(segment))),
                        [*group, "_seg"])
    fields = {f.name: f for f in entered.schema.fields}
    out = T.StructType([*[fields[g] for g in group], T.StructField("chunk", T.LongType()),
                        fields["_e"], fields["_f"]])
    closed = entered.groupBy(*group, "_seg").applyInArrow(_follow(group), out)
    spans = closed.select(
        *group, "chunk",
        F.explode(F.sequence(F.greatest(F.col("_e") - F.lit(overlap), F.lit(0)),
                             F.col("_f") - 1)).alias("block"))
    return spans.join(at.select(*group, "block", *order.columns), [*group, "block"])


def _sorted(table: pa.Table) -> pa.Table:
    return table.take(pa.array(np.argsort(table["_e"].to_numpy(), kind="stable")))


def _follow(group: list[str]):
    """Walk one segment from its entry: the chunks that close after e and run to f(e)."""
    def walk(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        first, ends = table["_e"][0].as_py(), table["_f"].to_pylist()
        at, rows = table["_entry"][0].as_py() - first, []
        while at < len(ends):
            rows.append(at)
            at = ends[at] - first
        taken = table.take(pa.array(rows, pa.int64()))
        chunk = pa.array(table["_chunk"][0].as_py() + np.arange(len(rows)), pa.int64())
        return taken.append_column("chunk", chunk).select([*group, "chunk", "_e", "_f"])
    return walk


def _ways_out(group: list[str]):
    """For every block of a segment: where its chain leaves, and after how many chunks."""
    def walk(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        first, ends = table["_e"][0].as_py(), table["_f"].to_pylist()
        leave, hops = list(ends), [1] * len(ends)
        for i in range(len(ends) - 1, -1, -1):
            inner = ends[i] - first
            if inner < len(ends):
                leave[i], hops[i] = leave[inner], hops[inner] + 1
        out = table.select([*group, "_e"])
        return (out.append_column("_f", pa.array(leave, pa.int64()))
                .append_column("_hops", pa.array(hops, pa.int64())))
    return walk


def _segment_entries(step: DataFrame, entry: DataFrame, count: DataFrame, group: list[str],
                     segment: int) -> DataFrame:
    """Block and chunk number at which each group's chain enters each segment it visits."""
    fields = {f.name: f for f in step.schema.fields}
    out = T.StructType([*[fields[g] for g in group], fields["_e"], fields["_f"],
                        T.StructField("_hops", T.LongType())])
    long = step.join(count.filter(F.col("_n") > segment).select(*group), group, "left_semi")
    jump = cut_lineage(long.groupBy(*group, "_seg").applyInArrow(_ways_out(group), out))
    reached = entry
    while True:
        onward = (reached.join(jump.withColumnRenamed("_e", "_entry"), [*group, "_entry"])
                  .join(count, group).filter(F.col("_f") < F.col("_n"))
                  .select(*group, F.col("_f").alias("_entry"),
                          (F.col("_chunk") + F.col("_hops")).alias("_chunk")))
        if onward.isEmpty():
            return reached
        reached = cut_lineage(reached.unionByName(onward))
        far = jump.select(*group, F.col("_e").alias("_f"), F.col("_f").alias("_ff"),
                          F.col("_hops").alias("_more"))
        jump = cut_lineage(jump.join(far, [*group, "_f"]).select(
            *group, "_e", F.col("_ff").alias("_f"),
            (F.col("_hops") + F.col("_more")).alias("_hops")))
