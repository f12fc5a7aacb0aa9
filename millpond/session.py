"""Session settings, and the one place that decides where intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# UTC keeps zone-less timestamps equal on every executor. AQE sizes the shuffles, so the partition
# number is only an upper bound there. Nothing here depends on the size of the data.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Sessions of a busy key are joined inside each task before they are shuffled.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}
BYTES_PER_SHUFFLE_PARTITION = 256 * 1024 * 1024


def shuffle_partitions(shuffled_bytes: int) -> int:
    """Upper bound of shuffle partitions for a job that shuffles this much; adaptive execution joins small ones."""
    return max(200, -(-shuffled_bytes // BYTES_PER_SHUFFLE_PARTITION))


def build_session(app: str = "millpond", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    A machine-local folder is made up only in local mode, where no setting exists (tests).
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="millpond-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder name below the shared folder; nothing is created yet."""
    return f"{shared_folder(spark)}/millpond/{label}-{uuid.uuid4().hex}"
