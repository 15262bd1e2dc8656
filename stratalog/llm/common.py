"""Helpers of the operators: written intermediate tables, screens of ids, byte classes."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stratalog.session import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Byte table that lower-cases A-Z and leaves all else alone.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, so that a second run never meets a first."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Files of a thin table at most, per core of the cluster.
FILES_PER_CORE = 4


def written(df: DataFrame, name: str, thin: bool = False) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage, survives executors.

    ``thin`` tables (ids, digests, edges; no texts) are written in a few files per core of
    the cluster instead of one per shuffle partition, which spares the store many tiny files.
    """
    path = new_path(df.sparkSession, name)
    if thin:
        df = df.coalesce(FILES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def others(df: DataFrame, new: Iterable[str]) -> list[str]:
    """Columns of the table but those that a new one replaces (names ignore case, as in Spark)."""
    gone = {n.lower() for n in new}
    return [c for c in df.columns if c.lower() not in gone]


def free(name: str, taken: Iterable[str]) -> str:
    """The name, with underscores before it until no column has it."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name = "_" + name
    return name


def whole_row(df: DataFrame) -> Column:
    """All columns as one, so that working columns beside it clash with nothing."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def spread(df: DataFrame) -> int:
    """Partitions for a keyed step over these rows: the session's own setting."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# A screen is one bitmap of this many bits, in at most 2^20 words, whatever the table's size.
SCREEN_BITS = 26


class Screen:
    """A test "may this be one of these ids" without a shuffle of the tested side.

    The ids are hashed into a bitmap of fixed size, kept as a table of 64-bit words that is
    broadcast; ids of the set always pass, others pass by chance, so an exact join must
    follow.  A set too large for the bitmap only makes more rows pass.  Null is an id like any
    other.
    """

    def __init__(self, ids: DataFrame, column: str = "doc_id", bits: int = SCREEN_BITS):
        self.bits = bits
        word, bit = self._place(F.col(column))
        self.words = ids.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), "bit")).alias("set"))

    def _place(self, c: Column) -> tuple[Column, Column]:
        place = F.pmod(F.xxhash64(c), F.lit(1 << self.bits))
        return F.shiftright(place, 6), place.bitwiseAND(63).cast("int")

    def split(self, df: DataFrame, c: Column, inside: bool = True) -> DataFrame:
        """The rows whose id passes, or those whose id does not."""
        word, bit = self._place(c)
        w, s = free("_word", df.columns), free("_set", df.columns)
        held = F.broadcast(self.words.select(F.col("word").alias(w), F.col("set").alias(s)))
        found = F.call_function("shiftright", F.coalesce(s, F.lit(0).cast("long")), bit)
        kept = [F.col(f"`{n}`") for n in df.columns]
        return df.join(held, word == F.col(w), "left").filter(
            found.bitwiseAND(1) == int(inside)).select(*kept)


def pick(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows whose id is among ``ids``; only rows that pass the screen are shuffled."""
    ids = ids.select(column).distinct()
    return (Screen(ids, column).split(docs, F.col(column)).alias("_d")
            .join(ids.alias("_i"), F.col(f"_d.{column}").eqNullSafe(F.col(f"_i.{column}")),
                  "left_semi"))


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of texts: few rows and few bytes each, so that long texts need no memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
