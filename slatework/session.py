"""Session helpers.

The library never creates a session on its own inside an operator; these
helpers are for scripts, tests and the bench. On a cluster the session comes
from the platform and only the SQL settings below matter.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on: AQE for runtime re-planning (coalescing,
# skew splits, broadcast conversion from real sizes), UTC so dates and
# timestamps mean the same thing on every executor.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "slatework") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SLATEWORK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in SQL_SETTINGS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir`` (or the one already set
    on the context). Where it is unset, a single-process session (tests, the
    bench) gets a scratch folder; a cluster session raises, since a folder of
    one machine would lose the rows that other executors write."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a remote (Connect) session has no context
        sc = None
    current = sc.getCheckpointDir() if sc is not None else None
    if not current:
        current = (sc.getConf().get("spark.checkpoint.dir", None) if sc is not None
                   else spark.conf.get("spark.checkpoint.dir", None))
        if current and sc is not None:
            sc.setCheckpointDir(current)
    if current:
        return current.rstrip("/")
    if sc is None or not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="slatework-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder. The files stay in a folder named after
    the application until the platform clears the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/slatework-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back, so
    that everything built on it sees the same rows, also after a lost
    executor. ``tidy`` is for jobs that shuffle much before they store: the rows are packed
    with zstd, and Spark drops the shuffle files of this one write when it has ended
    (otherwise they stay until the driver collects garbage)."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if not tidy:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    keep = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if keep is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, keep)
    return spark.read.schema(df.schema).parquet(path)
