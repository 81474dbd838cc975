"""Session settings and the two helpers that look at cluster state: lineage cuts and size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A dictionary or lookup side is broadcast only when its measured payload stays below this many bytes.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def build_session(app: str = "veilframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for (AQE on, skew splitting on, UTC)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Detection expressions have thousands of nodes; recording the call site of each takes most of their building time.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.redaction.regex", "(?i)secret|password|token|access[.]?key|vault")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by the cluster; make a private one only for a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="veilframe-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder, on storage that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


_open_scratch: list[list[str]] = []


@contextmanager
def scratch_tables(spark: SparkSession):
    """Tables that lineage cuts write inside the block are deleted at its end, also when it fails.

    They can hold secrets in clear (findings, vaults, rules), so a masking job writes its results inside the block and
    leaves none of them behind.
    """
    _open_scratch.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for written in _open_scratch.pop():
            path = jvm.org.apache.hadoop.fs.Path(written)
            path.getFileSystem(conf).delete(path, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_given_back(spark: SparkSession):
    """Executions that end inside the block leave no shuffle files: else these stay until the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and go on from there.

    Later reads neither recompute nor depend on executors, are pruned by column, and are planned with the table's real
    size. (A checkpointed frame would also hand its plan's constraints on, which grow without end in a loop.)
    """
    path = shared_folder(df.sparkSession, "table")
    if _open_scratch:
        _open_scratch[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by its keys over several tasks per core. Rows that are dear to work on may come from a few MB of
    compressed columns, which a scan gives to one task; this shuffles the columns that are used, before the work."""
    spark = df.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys)


def broadcast_if_small(
    df: DataFrame, row_bytes: Column, limit: int = BROADCAST_LIMIT_BYTES
) -> tuple[DataFrame, bool]:
    """Measure ``df`` (a materialised table) and hint a broadcast only when it fits under ``limit``."""
    measured = df.agg(F.sum(row_bytes.cast("long") + F.lit(64)).alias("bytes")).first()["bytes"] or 0
    if measured <= limit:
        return F.broadcast(df), True
    return df, False
