"""Streams: new files become entries, entries are merged, affected units are reported."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from stratalog.functions import periods as P
from stratalog.operators import ingest
from stratalog.plans import hierarchy
from stratalog.schema import ENTRY_COLUMNS, USAGE_COLUMNS
from stratalog.session import cut_lineage
from stratalog.sources import writers

ENTRY_FILE = T.StructType([T.StructField(c, T.StringType())
                           for c in ("date", "time", "source", "source_file", "role", "text")])


def read_stream(spark: SparkSession, path: str, keys: Sequence[str] = (),
                max_files: int | None = None, arrived: str | None = None) -> DataFrame:
    """Entry rows from JSON-lines files as they arrive; known files are not read again.

    ``arrived`` names a column for the time the row's file was written.
    """
    schema = T.StructType([*[T.StructField(k, T.StringType()) for k in keys], *ENTRY_FILE.fields])
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.json(path)
    if arrived:
        rows = rows.withColumn(arrived, F.col("_metadata.file_modification_time"))
    return ingest.prepare(rows).select(*keys, *ENTRY_COLUMNS, *([arrived] if arrived else []))


def ingest_stream(spark: SparkSession, path: str, keys: Sequence[str] = (),
                  within: str | None = None, max_files: int | None = None) -> DataFrame:
    """The stream with each id once.

    ``within`` bounds the state: an id is forgotten that long after its file was written.
    The clock is the arrival of files, never the entries' own dates, so an old entry that
    comes late is not lost.  Without it all ids are remembered; for a long-lived store use
    ``merge_stream``, which keeps no state and compares with the store instead.
    """
    if within is None:
        return read_stream(spark, path, keys, max_files).dropDuplicates([*keys, "id"])
    rows = read_stream(spark, path, keys, max_files, "arrived")
    return (rows.withWatermark("arrived", within)
            .dropDuplicatesWithinWatermark([*keys, "id"]).drop("arrived"))


def merge_batch(batch: DataFrame, store: str, keys: Sequence[str] = (),
                affected: str | None = None, batch_id: int = 0) -> None:
    """Append the batch's new entries to the store, and note which units they touch.

    Running it twice with one batch appends nothing the second time.  The units to redo
    are written first, so a crash in between loses none of them.
    """
    spark = batch.sparkSession
    batch = cut_lineage(batch)  # read three times below, computed once
    existing = writers.read_store(spark, store, keys, touched_months(batch))
    fresh = ingest.new_entries(batch, existing, keys)
    if affected:
        days = fresh.select(*keys, "date").distinct()
        weeks = existing.select(*keys, "date").distinct().select(
            *keys, F.lit("day").alias("level"), F.col("date").alias("period_start"))
        starts = weeks.groupBy(*keys, P.iso_week_key("period_start").alias("_w")).agg(
            F.min("period_start").alias("period_start")).select(
                *keys, F.lit("week").alias("level"), "period_start")
        touched = hierarchy.cascade_keys(days, weeks.unionByName(starts), keys).unionByName(
            days.select(*keys, F.lit("day").alias("level"), F.col("date").alias("period_start")))
        touched.write.mode("overwrite").parquet(f"{affected}/batch={batch_id}")
    writers.write_raw(fresh, store, keys)


def touched_months(batch: DataFrame) -> list[str]:
    """Month partitions the batch's weeks lie in; an id contains its date, so duplicates
    can only be there.  The list is as long as the calendar at most: whatever is no date has one
    partition.
    """
    day = P.as_date("date")
    near = F.array(F.date_sub(day, 6), day, F.date_add(day, 6))
    months = (batch.select(F.explode(F.array_append(
        F.transform(near, lambda d: F.date_format(d, "yyyy-MM")), P.store_month()))
        .alias("month")).distinct())
    return sorted(r.month for r in months.collect() if r.month is not None)


def merge_stream(rows: DataFrame, store: str, checkpoint: str, keys: Sequence[str] = (),
                 affected: str | None = None) -> StreamingQuery:
    """Run ``merge_batch`` on everything available, then stop."""
    def step(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch, store, keys, affected, batch_id)

    return (rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def usage_stream(calls: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append call-log rows, with their ratio, to CSV files."""
    from stratalog.operators import audit
    rows = audit.usage_rows(calls).select(*USAGE_COLUMNS)
    return (rows.writeStream.format("csv").option("header", True).option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())
