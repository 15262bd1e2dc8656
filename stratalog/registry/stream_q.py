"""Queries that run as streams over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratalog.functions import periods as P
from stratalog.operators import ingest
from stratalog.registry import base as B
from stratalog.registry.base import query
from stratalog.session import shared_folder
from stratalog.sources import writers
from stratalog.schema import USAGE_COLUMNS
from stratalog.streaming.ingest import ingest_stream, merge_stream, usage_stream


def _run_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _live_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream, whether it is a file or a folder of files.

    The path is a pattern, since the file source takes a plain path for a folder.
    """
    schema = B.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _live_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The conversation table as a stream of entries."""
    c = _live_table(spark, sf, "conversations")
    day = F.date_add(F.lit("2023-12-25").cast("date"), (F.col("conv_id") * 3 % 730).cast("int"))
    at = F.timestamp_seconds(F.lit(8 * 3600) + F.col("turn") * 300)
    return ingest.with_entry_id(c.select(
        P.date_text(day).alias("date"), F.date_format(at, "HH:mm:ss").alias("time"),
        F.lit("conversation").alias("source"),
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit(".json"))
        .alias("source_file"), "role", "text"))


@query("ingest_stream", "SELECT DISTINCT id, date, role FROM raw_entry")
def _(s, d):
    """The entries arrive twice as JSON lines; the stream passes each id once."""
    return _deduplicated(s, [B.raw_entry(s, d), B.raw_entry(s, d)], None)


def _deduplicated(s, arrivals, within):
    folder = _run_folder(s)
    for rows in arrivals:
        rows.drop("id").write.mode("append").json(f"{folder}/in")
    rows = ingest_stream(s, f"{folder}/in", within=within, max_files=4)
    done = (rows.writeStream.format("parquet").option("path", f"{folder}/out")
            .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    done.awaitTermination()
    return s.read.schema(rows.schema).parquet(f"{folder}/out").select("id", "date", "role")


@query("late_stream", "SELECT DISTINCT id, date, role FROM raw_entry")
def _(s, d):
    """Newest entries come first, old ones later: with bounded state none is lost."""
    rows = B.raw_entry(s, d)
    return _deduplicated(s, [rows.filter("date >= '2025-01-01'"), rows.filter("date < '2025-01-01'")],
                         "10 minutes")


@query("merge_stream", "SELECT DISTINCT id, date, role FROM raw_entry")
def _(s, d):
    """The users' entries are in the store; the stream brings all of them again."""
    folder = _run_folder(s)
    writers.write_raw(B.raw_entry(s, d).filter("role = 'user'").dropDuplicates(["id"]),
                      f"{folder}/store")
    merge_stream(_live_entries(s, d), f"{folder}/store", f"{folder}/checkpoint",
                 affected=f"{folder}/affected").awaitTermination()
    return writers.read_store(s, f"{folder}/store").select("id", "date", "role")


@query("usage_stream", """SELECT source AS model, n_chars AS char_count, CASE WHEN n_chars > 0 AND n_chars // 3 > 0
  THEN round(n_chars / CAST(n_chars // 3 AS DOUBLE), 4) END AS empirical_ratio FROM documents""")
def _(s, d):
    folder = _run_folder(s)
    rows = _live_table(s, d, "documents").select(
        F.lit("2024-01-01T00:00:00").alias("timestamp"), F.col("source").alias("model"),
        F.ceil(F.col("n_chars") / 4).alias("estimated_input_tokens"),
        F.floor(F.col("n_chars") / 3).alias("actual_input_tokens"),
        F.lit(0).alias("actual_output_tokens"), F.col("n_chars").alias("char_count"))
    usage_stream(rows, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    names = ", ".join(f"{c} STRING" for c in USAGE_COLUMNS)
    done = s.read.schema(names).option("header", True).csv(f"{folder}/out")
    return done.select(F.col("model"), F.col("char_count").cast("long").alias("char_count"),
                       F.col("empirical_ratio").cast("double").alias("empirical_ratio"))
