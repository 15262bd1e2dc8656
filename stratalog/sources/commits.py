"""Tables of immutable folders with one atomic commit.

Data is written to folders of its own first.  A commit is then one small file that lists, for
every part of the table, the folder that holds it from now on; it appears by one rename, so a
reader finds the state before it or after it and never between.  Commits are numbered, and a
number that is taken makes a writer begin again upon the newer state.  Two writers that ask
for a number within the moment one small file takes to write may both get it: the smaller
name counts then, and a writer that looks too early does not see that; writers of one table
should take turns.  Folders that no commit names any more stay until they are removed by hand.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

LOG = "n long, writer string, part string, folder string"


@dataclass(frozen=True)
class Snapshot:
    """The newest commit: its number (0: none yet) and the folder of each part."""

    n: int
    folders: dict[str, str]


def _log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).option("recursiveFileLookup", "true").parquet(f"{path}/commits")


def snapshot(spark: SparkSession, path: str) -> Snapshot:
    """The newest state of a table.  A commit lists its parts, which the caller keeps few."""
    try:
        log = _log(spark, path)
        newest = log.groupBy("n").agg(F.min("writer").alias("writer")).orderBy(F.desc("n")).limit(1)
        rows = log.join(F.broadcast(newest), ["n", "writer"]).collect()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    return Snapshot(rows[0].n if rows else 0, {r.part: r.folder for r in rows if r.part is not None})


def commit(spark: SparkSession, path: str, base: Snapshot, change: Callable[[Snapshot], dict[str, str | None]]
           ) -> Snapshot:
    """Make the next commit; ``change`` says which parts have new folders (None: the part is gone).

    When another writer was faster, ``change`` is asked again with that writer's state, so that
    it can refuse or redo what rests on parts that have changed since.
    """
    while True:
        new = {**base.folders, **change(base)}
        writer = uuid.uuid4().hex
        rows = [(base.n + 1, writer, p, f) for p, f in sorted(new.items()) if f is not None]
        rows = rows or [(base.n + 1, writer, None, None)]
        try:
            spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(f"{path}/commits/{base.n + 1:012d}")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_ALREADY_EXISTS":
                raise
        else:
            taken = _log(spark, path).filter(F.col("n") == base.n + 1).agg(F.min("writer")).first()[0]
            if taken == writer:
                return Snapshot(base.n + 1, {p: f for p, f in new.items() if f is not None})
        base = snapshot(spark, path)


def new_folder(path: str) -> str:
    return f"{path}/data/{uuid.uuid4().hex}"


def write_parts(df: DataFrame, path: str, part: str) -> dict[str, str]:
    """Write rows below a folder of their own, a sub-folder per value of ``part``; value -> folder."""
    folder = new_folder(path)
    df.withColumn("_part", F.col(part)).write.partitionBy("_part").parquet(folder)
    found = df.sparkSession.read.parquet(folder).select("_part").distinct().collect()
    return {str(r[0]): f"{folder}/_part={r[0]}" for r in found}


def read_parts(spark: SparkSession, path: str, schema: str | None = None, at: Snapshot | None = None,
               parts: Sequence[str] | None = None) -> DataFrame | None:
    """The rows of a table's newest state, or of some parts; None where there is nothing yet."""
    at = at or snapshot(spark, path)
    folders = [f for p, f in sorted(at.folders.items()) if parts is None or p in parts]
    if not folders:
        return None
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*folders)
