"""Checks and reports: load verification, corpus size, cost, token usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stratalog.functions import text as X
from stratalog.operators import paging


def verify_entries(src: DataFrame, dst: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per source date the number of discrepancies (only dates that have any).

    Different counts are one discrepancy; equal counts are compared position by position
    on time, role and text.
    """
    keys = list(keys)
    on = [*keys, "date"]

    def numbered(df: DataFrame, tag: str) -> DataFrame:
        placed = paging.position(df.select(*on, "time", "id", "role", "text"), on,
                                 paging.by_time_and_id(), "position")
        return placed.select(*on, "position", F.struct("time", "role", "text").alias(tag))

    dates = src.select(*on).distinct()
    there = dst.join(dates, on, "left_semi")
    both = numbered(src, "_src").join(numbered(there, "_dst"), [*on, "position"], "full_outer")
    per_date = both.groupBy(*on).agg(
        F.count("_src").alias("src_entries"), F.count("_dst").alias("dst_entries"),
        F.count_if(~F.col("_src").eqNullSafe(F.col("_dst"))).alias("_differ"))
    found = F.when(F.col("src_entries") != F.col("dst_entries"), F.lit(1).cast("long")
                   ).otherwise(F.col("_differ"))
    return (per_date.withColumn("discrepancies", found).filter("discrepancies > 0")
            .drop("_differ"))


def verify_rows(src: DataFrame, dst: DataFrame, key: Sequence[str], fields: Sequence[Column | str]
                ) -> DataFrame:
    """Source keys that are missing in the store or differ in one of the fields."""
    key = list(key)
    body = F.struct(*fields)
    a = src.select(*key, body.alias("_src"))
    b = dst.select(*key, body.alias("_dst"), F.lit(True).alias("_there"))
    return (a.join(b, key, "left")
            .withColumn("problem", F.when(F.col("_there").isNull(), "missing")
                        .when(~F.col("_src").eqNullSafe(F.col("_dst")), "differs"))
            .filter(F.col("problem").isNotNull()).select(*key, "problem"))


def verify_summaries(src: DataFrame, dst: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return verify_rows(src, dst, [*keys, "level", "period_start"],
                       ["summary", "emotional_tone", "key_events", "energy_level"])


def verify_profiles(src: DataFrame, dst: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return verify_rows(src, dst, [*keys, "id"],
                       ["display_name", "aliases", F.size("knowledge").alias("facts")])


def verify_load(entries: DataFrame, summaries: DataFrame, profiles: DataFrame) -> DataFrame:
    """Discrepancies per table from the three checks; a clean load gives zeros."""
    def total(name: str, df: DataFrame, amount: Column) -> DataFrame:
        return df.agg(F.coalesce(F.sum(amount), F.lit(0)).cast("long").alias("discrepancies")
                      ).select(F.lit(name).alias("table"), "discrepancies")

    return (total("raw_entry", entries, F.col("discrepancies"))
            .unionByName(total("summary", summaries, F.lit(1)))
            .unionByName(total("entity_profile", profiles, F.lit(1))))


def corpus_size(docs: DataFrame, text: str = "text") -> DataFrame:
    """Units, characters, estimated tokens and their average per unit, in one row."""
    sized = docs.agg(F.count(F.lit(1)).alias("units"),
                     F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("total_chars"))
    tok = X.tokens(F.col("total_chars"), X.COST_CHARS_PER_TOKEN)
    return sized.select("units", "total_chars", tok.alias("est_tokens"),
                        F.when(F.col("units") > 0, F.floor(tok / F.col("units")))
                        .otherwise(F.lit(0)).alias("avg_tokens_per_unit"))


def cost_estimate(size: DataFrame, price_in: float, price_out: float, avg_output: int
                  ) -> DataFrame:
    """Cost of one call per unit, prices per million tokens, and with a fifth on top."""
    million = F.lit(1_000_000.0)
    tin = F.col("units") * F.col("avg_tokens_per_unit")
    tout = F.col("units") * F.lit(avg_output)
    costed = size.select(tin.alias("total_input_tokens"), tout.alias("total_output_tokens"),
                         (tin / million * F.lit(price_in)).alias("cost_in"),
                         (tout / million * F.lit(price_out)).alias("cost_out"))
    total = F.col("cost_in") + F.col("cost_out")
    return costed.select("*", total.alias("total_cost"), (total * 1.2).alias("with_buffer"))


def usage_rows(calls: DataFrame) -> DataFrame:
    """Call log with the characters-per-token ratio of each call."""
    return calls.withColumn("empirical_ratio",
                            X.empirical_ratio("char_count", "actual_input_tokens"))


def usage_calibration(calls: DataFrame) -> DataFrame:
    """Mean characters per actual token by model, over calls where it is known."""
    return usage_rows(calls).groupBy("model").agg(
        F.count("empirical_ratio").alias("calls"),
        F.avg("empirical_ratio").alias("chars_per_token"))
