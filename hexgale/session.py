"""Session settings the operators rely on."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Runtime SQL settings. All can be changed on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even where the next aggregate then needs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Where it is unset, a local session takes a folder in its warehouse; on a cluster that would be some machine's own
    disk, so there it is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    target = checkpoint_target(
        spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None),
        context.master,
        spark.conf.get("spark.sql.warehouse.dir"),
    )
    context.setCheckpointDir(target)
    return context.getCheckpointDir()


def checkpoint_target(shared: str | None, master: str, warehouse: str) -> str:
    if shared:
        return shared
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    return f"{warehouse}/_checkpoints"


def cut_lineage(df):
    """Reliable checkpoint of a frame that several later steps read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def store(df, prefix: str = "rows"):
    """Write a frame as a compressed table in the shared checkpoint folder and read it again.

    Like a checkpoint it cuts the lineage and survives lost executors, but later steps read only the columns they use and
    filter while they read, and the reads are split anew, however few tasks wrote. The tables are called
    ``<prefix>-<random>`` and may be deleted when the result has been written.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{prefix}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("hexgale")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        # Checkpoints no frame refers to any more are deleted; clusters should start with this too.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
