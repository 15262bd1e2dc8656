"""Records of large JSON documents, read in byte ranges by many tasks.

A JSON document has no line borders, but a closing brace is a place where a reader may cut: Spark's
text reader splits a file into byte ranges at that character, whatever the file system.  A piece
between two braces may lie inside a string or at any depth, so each is scanned for both cases:
how it changes "inside a string" and the depth if it begins outside, and if it begins inside.
Blocks of pieces are small rows whose two cases are composed in file order, which gives every
block, and within it every piece, its true state.  A record is then what lies between the brace
that opens at the wanted depth and its match; only its pieces are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

PIECES_PER_BLOCK = 16_384


def _braces(text: Column) -> Column:
    """Square brackets opened less those closed, in text without strings."""
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c)))
    return count("[") - count("]")


def json_tokens(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """file, block, place, opens, closes, token: the text of JSON files cut at every brace."""
    reader = spark.read.option("lineSep", "}")
    for name, value in options.items():
        reader = reader.option(name, value)
    pieces = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("n"), F.split("value", r"\{").alias("tokens"))
    return pieces.select(
        "file", F.struct("part", F.floor(F.col("n") / PIECES_PER_BLOCK).alias("n")).alias("block"),
        "part", "n", F.size("tokens").alias("size"), F.posexplode("tokens").alias("i", "token")).select(
        "file", "block", F.struct("part", "n", "i").alias("place"), (F.col("i") > 0).alias("opens"),
        (F.col("i") == F.col("size") - 1).alias("closes"), "token")


def with_state(tokens: DataFrame) -> DataFrame:
    """The tokens with ``inside`` (in a string where the token begins), ``depth`` there and ``after`` it."""
    bare = F.regexp_replace("token", r"(?s)\\.", "")
    parity = (F.length(bare) - F.length(F.replace(bare, F.lit('"')))) % 2
    outside = F.regexp_replace(bare, r'"[^"]*("|$)', "")
    inside = F.regexp_replace(F.concat(F.lit('"'), bare), r'"[^"]*("|$)', "")
    opens, closes = F.col("opens").cast("int"), F.col("closes").cast("int")
    scanned = tokens.withColumns({
        "_p": parity.cast("long"), "_a": opens + _braces(outside) - closes * (1 - parity),
        "_b": _braces(inside) - closes * parity})
    along = Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    scanned = scanned.withColumn("_rel", F.coalesce(F.sum("_p").over(along), F.lit(0)) % 2)
    even = F.col("_rel") == 0
    blocks = scanned.groupBy("file", "block").agg(
        (F.sum("_p") % 2).alias("_p"),
        F.sum(F.when(even, F.col("_a")).otherwise(F.col("_b"))).alias("_a"),
        F.sum(F.when(even, F.col("_b")).otherwise(F.col("_a"))).alias("_b"))
    # One small row per block, in file order.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = blocks.withColumn("_in", F.coalesce(F.sum("_p").over(before), F.lit(0)) % 2)
    begun = begun.withColumn("_at", F.coalesce(F.sum(
        F.when(F.col("_in") == 0, F.col("_a")).otherwise(F.col("_b"))).over(before), F.lit(0)))
    known = scanned.join(begun.select("file", "block", "_in", "_at"), ["file", "block"]).withColumn(
        "inside", (F.col("_rel") + F.col("_in")) % 2 == 1)
    delta = F.when(F.col("inside"), F.col("_b")).otherwise(F.col("_a"))
    known = known.withColumn("_delta", delta).withColumn(
        "depth", F.col("_at") + F.coalesce(F.sum("_delta").over(along), F.lit(0)))
    return known.select(*tokens.columns, "inside", "depth", (F.col("depth") + F.col("_delta")).alias("after"))


def json_records(spark: SparkSession, path: str | list[str], depth: int = 0, **options: str) -> DataFrame:
    """file, place, json: every object of JSON files that opens at ``depth``, as text.

    ``depth`` counts from a document that is an object; one that is an array of such documents is
    an array deeper, which its first character tells.  A document that breaks off gives the objects
    that are whole, or lack their last brace only.
    """
    tokens = with_state(json_tokens(spark, path, **options))
    root = tokens.groupBy("file").agg(F.min_by(F.left(F.ltrim(
        F.regexp_replace("token", "^﻿", ""), F.lit(" \t\r\n")), F.lit(1)), "place").alias("_root"))
    tokens = tokens.join(root, "file")
    wanted = F.lit(depth) + (F.col("_root") == "[").cast("int")
    start = F.col("opens") & ~F.col("inside") & (F.col("depth") == wanted)
    marked = tokens.withColumn("_start", F.when(start, F.col("place")))
    upto = Window.partitionBy("file", "block").orderBy("place").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy("file", "block").agg(F.max("_start").alias("_last")).select(
        "file", "block", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    held = marked.join(carried, ["file", "block"]).withColumn("_of", F.coalesce(
        F.last("_start", ignorenulls=True).over(upto), "_carried"))
    # Nothing between records belongs to one, and a string's braces do not count.
    held = held.filter(F.col("_start").isNotNull() | (F.col("depth") > wanted))
    text = F.concat(F.when(F.col("opens"), "{").otherwise(""), "token", F.when(F.col("closes"), "}").otherwise(""))
    return held.groupBy("file", F.col("_of").alias("place")).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("place", text.alias("text")))), lambda r: r["text"]), "")
        .alias("json"), F.min(F.col("after") - wanted).alias("_open")).filter("_open = 0").drop("_open")


def parsed_records(records: DataFrame, schema: T.StructType) -> DataFrame:
    """file_name, place and the fields of each record; a record that is no JSON has null fields."""
    name = F.replace(F.substring_index("file", "/", -1), F.lit("+"), F.lit("%2B"))
    return records.select(F.url_decode(name).alias("file_name"), "place",
                          F.from_json("json", schema).alias("_r")).select("file_name", "place", "_r.*")
