"""Waves: units whose prompts tell of earlier units that the same run describes.

A unit needs its ``n`` earlier units, stored ones and pending ones alike, so pending units of
one stream form runs: a pending unit is the next of a run when fewer than ``n`` stored units
lie between it and the pending unit before.  Wave k holds the k-th unit of every run of every
stream.  Its replies are stored, with the contexts each run has reached, and the next wave's
prompts read them.  There are as many waves as the longest run has units, however many
streams there are, and without history one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from stratalog.plans import prompts
from stratalog.session import shared_folder, stored


def frontier(pending: DataFrame, units: DataFrame, level: str, n: int,
             keys: Sequence[str] = ()) -> DataFrame:
    """keys, period_start, run, wave, between of every pending unit.

    ``run`` numbers the runs of a stream, ``wave`` counts along a run from 1.  ``between`` has the
    contexts, oldest first and at most ``n``, of the stored units between the unit and the pending
    one before it in its run, or before a run's first unit.  Only names are put in order, in
    windows per stream whose rows the calendar bounds.
    """
    keys = list(keys)
    group = [*keys, "period_start"]
    have = prompts.contexts(units.filter(F.col("level") == level), keys).drop("level")
    names = pending.select(*group).distinct().withColumn("_asked", F.lit(1)).unionByName(
        have.select(*group).withColumn("_asked", F.lit(0)))
    order = Window.partitionBy(*keys).orderBy("period_start")
    ranked = names.withColumn("_n", F.coalesce(F.sum(1 - F.col("_asked")).over(
        order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    asked = ranked.filter("_asked = 1").withColumn("_before", F.lag("_n").over(order))
    opens = F.col("_before").isNull() | (F.col("_n") - F.col("_before") >= max(n, 1))
    runs = asked.withColumn("_opens", opens).withColumn(
        "run", F.sum(F.col("_opens").cast("int")).over(
            order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    along = Window.partitionBy(*keys, "run").orderBy("period_start")
    runs = runs.withColumn("wave", F.row_number().over(along) if n else F.lit(1))
    first = F.greatest(F.when(F.col("_opens"), F.lit(0)).otherwise(F.col("_before")), F.col("_n") - n)
    wanted = runs.filter(F.col("_n") > first).select(*group, F.explode(
        F.sequence(first, F.col("_n") - 1)).alias("_n"))
    prior = ranked.filter("_asked = 0").select(*keys, "_n", F.col("period_start").alias("_prior"))
    told = wanted.join(prior, [*keys, "_n"]).join(
        have.select(*keys, F.col("period_start").alias("_prior"), "context"), [*keys, "_prior"])
    between = prompts._listed(told, group, "_prior", "context", "between")
    return runs.select(*group, "run", "wave").join(between, group, "left").withColumn(
        "between", F.coalesce("between", prompts._no_texts()))


def in_waves(rows: DataFrame, n: int, describe: Callable[[DataFrame], DataFrame],
             keys: Sequence[str] = ()) -> DataFrame:
    """Describe rows with the columns of ``frontier`` wave by wave; the described rows.

    ``describe`` gets a wave's rows with ``told``, the contexts of up to ``n`` earlier units,
    and returns them as keys, period_start, fields and ``context``; the fields are stored
    before the next wave begins, so a reply that was stored is never asked for again.
    """
    keys = list(keys)
    spark = rows.sparkSession
    held = stored(rows, "waves", by="wave")
    last = held.agg(F.max("wave")).first()[0] or 0
    path = f"{shared_folder(spark)}/described-{uuid.uuid4().hex}"
    schema = None
    for wave in range(1, max(last, 1) + 1):
        now = held.filter(F.col("wave") == wave).drop("wave")
        told = F.col("between")
        if wave > 1:
            reached = spark.read.schema(schema).parquet(f"{path}/wave={wave - 1}").select(
                *keys, "run", F.col("told").alias("_told"))
            now = now.join(reached, [*keys, "run"], "left")
            told = F.concat(F.coalesce("_told", prompts._no_texts()), "between")
        count = F.least(F.size(told), F.lit(n))
        now = now.withColumn("told", F.slice(told, F.size(told) - count + 1, count)
                             if n else prompts._no_texts()).drop("_told", "between")
        # The row's own context joins what the run has reached.
        done = describe(now)
        kept = F.concat("told", F.array("context"))
        out = done.withColumn("told", F.slice(kept, F.greatest(F.size(kept) - n + 1, F.lit(1)), max(n, 1)))
        out.write.parquet(f"{path}/wave={wave}")
        schema = schema or out.schema
    return spark.read.schema(schema).parquet(*[f"{path}/wave={w}" for w in range(1, max(last, 1) + 1)]
                                             ).drop("run", "told", "context")
