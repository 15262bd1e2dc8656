"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Set on every session: results must not depend on the host's time zone, and a hot
# key must be split at run time even where a later step wants its partitioning.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Rows with long texts go to Python a few at a time.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session made by someone else."""
    for name, value in RUNTIME.items():
        spark.conf.set(name, value)
    return spark


def build_session(app: str = "stratalog", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", shuffle_partitions)
    # Checkpoint files go when nothing refers to them any more; this is read at the start only.
    clean = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true"}
    for name, value in {**RUNTIME, **clean, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``) for checkpoints and stores.

    A folder of our own is only made for a local master without that setting.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="stratalog-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back: unlike a checkpoint it keeps
    sizes, columns can be pruned, and with ``by`` one value's folder can be read alone."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write if by is None else df.write.partitionBy(by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
