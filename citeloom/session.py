"""Session settings, shared work folder, code shipping."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings the jobs rely on; all can be changed by the caller afterwards.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Article texts vary from a few bytes to megabytes: keep Python batches small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}

CHECKPOINT_CONF = "spark.checkpoint.dir"


def tune(spark: SparkSession) -> SparkSession:
    """Settings the jobs rely on, where the caller has not chosen their own, and what is
    needed on the executors."""
    given = {key for key, _ in spark.sparkContext.getConf().getAll()}
    for key, value in RUNTIME_CONF.items():
        if key not in given and spark.conf.get(key) == _default(spark, key):
            spark.conf.set(key, value)
    checkpoint_root(spark)
    ship_package(spark)
    return spark


def _default(spark: SparkSession, key: str) -> str:
    """The value of a setting in a session that has not touched it."""
    known = spark.sparkContext._tune_defaults = getattr(spark.sparkContext, "_tune_defaults", {})
    if key not in known:
        known[key] = spark.newSession().conf.get(key)
    return known[key]


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder of the cluster for staged tables and checkpoints.

    It is the session's ``spark.checkpoint.dir``. Only a local master, where every
    task runs on this machine, gets a temporary folder when the setting is missing.
    """
    sc = spark.sparkContext
    root = sc.getConf().get(CHECKPOINT_CONF) or spark.conf.get(CHECKPOINT_CONF, None)
    current = sc.getCheckpointDir()
    if not root:
        if current:
            return current
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        root = tempfile.mkdtemp(prefix="citeloom-")
    if current is None:
        sc.setCheckpointDir(root)
    return sc.getCheckpointDir() or root


_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    held = _SCRATCH.get()
    if held is not None:
        held.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are deleted at the end: for jobs that have written all they
    return by then. A job inside a job leaves its tables to the outer one."""
    if _SCRATCH.get() is not None:
        yield
        return
    held: list[str] = []
    token = _SCRATCH.set(held)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in held:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def spread(df: DataFrame) -> DataFrame:
    """A table that comes in fewer partitions than there are cores, such as one small
    file, dealt out over all cores. A large table is left where it lies: no shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Broadcast hint for a slim table, after counting it; without the hint when it is
    larger. For tables of one row per file or partition."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts the lineage before costly or repeated work, and survives lost executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application.

    Does what ``spark-submit --py-files`` does, for sessions started without it.
    """
    sc = spark.sparkContext
    if getattr(sc, "_citeloom_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="citeloom-code-"), "citeloom")
    archive = shutil.make_archive(target, "zip", os.path.dirname(package), os.path.basename(package))
    sc.addPyFile(archive)
    sc._citeloom_shipped = True
