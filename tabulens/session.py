"""Session helpers: a sensible session, and the shared folder for written data."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tabulens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tested under."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        # Call sites for error messages cost more than the expressions they describe.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Data one shuffle partition should hold, and the least number of partitions.
SHUFFLE_BYTES = 256 * 1024**2
LEAST_PARTITIONS = 200


def size_shuffles(spark: SparkSession, shuffled_bytes: int) -> int:
    """Start with as many shuffle partitions as the data needs; adaptive execution merges small ones.

    ``shuffled_bytes`` is what the largest shuffle moves: for exact distinct counts and
    quantiles about the size of the columns looked at.
    """
    wanted = max(LEAST_PARTITIONS, -(-shuffled_bytes // SHUFFLE_BYTES))
    spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return wanted


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder is None:
        folder = context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tabulens-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return context.getCheckpointDir() if folder is None else folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Shuffle files go when the query that wrote them has ended, not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# Rows of (keys, value) that a task may hold at once in a hash table or a sort.
TASK_ROWS = 4_000_000
# Bytes up to which adaptive execution merges the shuffle partitions of such rows, and a scan its pieces of files.
MERGED_BYTES = 16 * 1024**2


def partitions_for(rows: int) -> int:
    """Partitions that keep the rows of a task below ``TASK_ROWS``."""
    return max(1, -(-rows // TASK_ROWS))


def cut_lineage(df: DataFrame, partitions: int = 1) -> DataFrame:
    """Reliable checkpoint: later branches read the same rows even after a lost executor.

    The shuffle files behind it are removed at once, so the rounds of an iteration do not pile up on the disks.
    With several ``partitions`` its shuffles have that many at least, of a size that one task can aggregate, and
    the rows are kept as Parquet, which is written and read much faster than a checkpoint.
    """
    spark = df.sparkSession
    shared_folder(spark)
    settings = {CLEANUP: "true"}
    if partitions > 1:
        settings["spark.sql.shuffle.partitions"] = str(max(partitions, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        settings["spark.sql.adaptive.advisoryPartitionSizeInBytes"] = str(MERGED_BYTES)
        settings["spark.sql.files.maxPartitionBytes"] = str(MERGED_BYTES)
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        if partitions == 1:
            return df.checkpoint(eager=True)
        path = fresh_path(spark, "rows")
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.parquet(path)
