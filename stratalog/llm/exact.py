"""Exact deduplication: fuse filters per immutable snapshot, exact buckets, byte checks.

A batch of documents is published as a snapshot: its distinct digests, each with the size and
the best row of its group, and for every hash bucket of digests one static binary-fuse filter.
Snapshots never change.  The digests of a later batch are first grouped among themselves,
then screened bucket by bucket by the filters of all earlier snapshots: those that no filter
knows are new and touch nothing stored; the positives join the exact digests, which settles
false positives.  Texts with a digest in common are at last compared as whole texts, so a
collision of digests splits a group instead of joining different texts.

Buckets are uniform in the digest and their number follows the snapshot, so filters and the
rows beside them stay small.  A group with a third of all rows is one row per map task after
the first aggregation.  Only texts of groups with several rows move, behind a bitmap of
fixed size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from stratalog.llm import fuse
from stratalog.llm.common import Screen, bounded_batches, pick, spread, whole_row, written

BLANKS = b" \t\n\x0b\x0c\r"  # [\x20\x09-\x0D]
KEYS_PER_FILTER = 1 << 18
_FILTER = "bucket long, seed long, length long, segments long, data binary"


def normal(text: str | None) -> bytes:
    return (text or "").encode().translate(None, BLANKS)


@F.arrow_udf(T.BinaryType())
def sha256(texts: pa.Array) -> pa.Array:
    """SHA-256 of the normalised text."""
    return pa.array([hashlib.sha256(normal(t)).digest() for t in texts.to_pylist()], pa.binary())


@F.arrow_udf(T.BinaryType())
def normal_text(texts: pa.Array) -> pa.Array:
    return pa.array([normal(t) for t in texts.to_pylist()], pa.binary())


@dataclass(frozen=True)
class Snapshot:
    """``digests``: digest, n, points, neg; ``filters``: one filter per bucket."""

    digests: DataFrame
    filters: DataFrame
    buckets: int


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket")


def _keys(digests: pa.ChunkedArray) -> np.ndarray:
    return np.array([int.from_bytes(d[:8].ljust(8, b"\0"), "little") for d in digests.to_pylist()],
                    np.uint64)


def group(prints: DataFrame) -> DataFrame:
    """digest, n, best: rows of a digest and the row that stays (most points, smallest id)."""
    best = F.max(F.struct(F.col("points"), (-F.col("doc_id")).alias("neg")))
    return prints.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), best.alias("best")).select(
        "digest", "n", "best.points", "best.neg")


def publish(groups: DataFrame, buckets: int | None = None) -> Snapshot:
    """Write the groups of a batch as a snapshot with its filters."""
    digests = written(groups, "snapshot", True)
    count = digests.count()
    buckets = buckets or max(spread(digests), math.ceil(count / KEYS_PER_FILTER))

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        seed, length, segments, data = fuse.build(_keys(rows["digest"]))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "seed": [seed],
                         "length": [length], "segments": [segments], "data": [data]})

    filters = (digests.select(_bucket(buckets), "digest").groupBy("bucket")
               .applyInArrow(build, _FILTER))
    return Snapshot(digests, written(filters, "filters", True), buckets)


def known_to(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The groups with ``known``: whether the snapshot's filters may hold their digest."""
    names = groups.columns
    asked = groups.withColumn("bucket", _bucket(snapshot.buckets))
    schema = groups.withColumn("known", F.lit(True)).schema

    def ask(rows: pa.Table, filters: pa.Table) -> pa.Table:
        if filters.num_rows and rows.num_rows:
            f = filters.slice(0, 1).to_pylist()[0]
            known = fuse.contains(_keys(rows["digest"]), f["seed"], f["length"], f["segments"],
                                  f["data"])
        else:
            known = np.zeros(rows.num_rows, bool)
        return rows.select(names).append_column("known", pa.array(known))

    return (asked.groupBy("bucket").cogroup(snapshot.filters.groupBy("bucket"))
            .applyInArrow(ask, schema))


def exact_groups(prints: DataFrame, batches: int) -> DataFrame:
    """Groups over all batches of ``prints`` (digest, points, doc_id, batch), screened in turn."""
    parts: list[DataFrame] = []  # groups whose digests no other part has
    hits: list[DataFrame] = []
    snapshots: list[Snapshot] = []
    for batch in range(batches):
        groups = group(prints.filter(F.col("batch") == batch))
        fresh = groups
        for snapshot in snapshots:
            asked = written(known_to(fresh, snapshot), "asked", True)
            names = groups.columns
            maybe = asked.filter("known").select(names)
            hits.append(maybe.join(snapshot.digests.select("digest"), "digest", "left_semi"))
            missed = maybe.join(snapshot.digests.select("digest"), "digest", "left_anti")
            fresh = asked.filter("NOT known").select(names).unionAll(missed)
        if batch < batches - 1:
            snapshots.append(publish(fresh))
            parts.append(snapshots[-1].digests)
        else:
            parts.append(fresh)
    if not hits:
        return parts[0]
    first, more = _union(parts), _union(hits)
    joined = more.select("digest").distinct()
    met = first.join(joined, "digest", "left_semi").unionAll(more)
    best = F.max(F.struct("points", "neg"))
    merged = met.groupBy("digest").agg(F.sum("n").alias("n"), best.alias("best")).select(
        "digest", "n", "best.points", "best.neg")
    return first.join(joined, "digest", "left_anti").unionAll(merged)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def find_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", batches: int = 2,
                digest: Callable = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest for every row of ``docs``.

    Texts are equal when identical without blanks; null is the empty text.  Of a group the row
    with the most code points in its text stays, then that with the smallest id (a null id
    last).  Of rows repeated with id and text, one is marked kept.  The table is dealt into
    ``batches`` by id, each screened against the snapshots of those before.  An empty table
    gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    points = F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points")
    prints = written(
        rows.select("doc_id", points, digest(F.col("text")).alias("digest"),
                    F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")),
        "digests")
    groups = written(exact_groups(prints, batches), "groups", True)
    several = groups.filter("n > 1").select("digest")

    # Byte checks: rows with a digest in common, compared by their whole normalised texts.
    ids = prints.join(several, "digest", "left_semi")
    texts = pick(rows, ids).select("doc_id", points, digest(F.col("text")).alias("digest"),
                                   normal_text(F.col("text")).alias("normal"))
    classes = texts.groupBy("digest", F.col("normal")).agg(F.count(F.lit(1)).alias("n"))
    clashes = written(classes.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
                      .filter("texts > 1").select("digest"), "clashes", True)

    best = ["n", F.col("points").alias("most"), (-F.col("neg")).alias("keep_id")]
    placed = _placed(prints.groupBy("doc_id", "points", "digest").agg(F.count(F.lit(1)).alias("times")),
                     groups.join(clashes, "digest", "left_anti").select("digest", *best), ["digest"])
    if not clashes.isEmpty():
        apart = texts.join(clashes, "digest", "left_semi")
        split = apart.groupBy("digest", "normal").agg(
            F.count(F.lit(1)).alias("n"),
            F.max(F.struct("points", (-F.col("doc_id")).alias("neg"))).alias("best")).select(
            "digest", "normal", "n", F.col("best.points").alias("most"),
            (-F.col("best.neg")).alias("keep_id"))
        times = apart.groupBy("doc_id", "points", "digest", "normal").agg(
            F.count(F.lit(1)).alias("times"))
        placed = placed.unionAll(_placed(times, split, ["digest", "normal"]))
    return placed


def _placed(times: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per row of the input, with its group."""
    copy = F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))
    kept = (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("most"))
            & (F.col("copy") == 1))
    return (times.join(groups, list(keys)).withColumn("copy", copy)
            .select("doc_id", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"),
                    "points", "digest"))


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", batches: int = 2
                ) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns.

    Rows whose id is in no group with others pass the bitmap screen and never move; the few
    that may be dropped are settled by digest, and one of repeated rows stays.
    """
    found = written(find_copies(docs, text, doc_id, batches), "copies", True)
    loose = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"),
                                        F.min("kept").alias("all_kept"))
    unsure = written(loose.filter("rows > 1 OR NOT all_kept").select("doc_id"), "unsure", True)
    maybe, key = Screen(unsure), F.col(doc_id).cast("long")
    asked = maybe.split(docs, key).select(
        whole_row(docs).alias("row"), key.alias("_id"),
        F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("_points"),
        sha256(F.col(text)).alias("_digest"))
    stay = found.filter("kept").select(F.col("doc_id").alias("_k"), F.col("points").alias("_p"),
                                       F.col("digest").alias("_g")).distinct()
    same = Window.partitionBy("_id", "_points", "_digest").orderBy(F.lit(0))
    settled = (asked.join(stay, F.col("_id").eqNullSafe(F.col("_k"))
                          & (F.col("_points") == F.col("_p"))
                          & (F.col("_digest") == F.col("_g")), "left_semi")
               .withColumn("_nth", F.row_number().over(same)).filter("_nth = 1"))
    return maybe.split(docs, key, False).unionAll(settled.select("row.*"))
