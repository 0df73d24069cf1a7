"""S3 ``write_snapshot`` and S4 ``calendar_json``.

Snapshots are immutable versions: every write goes to a new directory, so
a job never overwrites the path it reads, and a failed write leaves the
previous version intact. The root comes from the session's checkpoint
folder (the cluster's shared storage) unless the caller names one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``)."""
    from ..session import ensure_checkpoint_dir
    return ensure_checkpoint_dir(spark)


def write_snapshot(df: DataFrame, root: str, table: str, version: str | None = None,
                   partition_by: str | None = "workspace_id") -> str:
    """Write ``df`` as a new version of ``table`` under ``root`` and return its path.

    Partitioning by ``workspace_id`` lets tenant-scoped reads prune whole
    directories; a rebalance on the same column first keeps the number of
    files per tenant small, while AQE splits a tenant beyond the advisory
    partition size over several tasks and files.
    """
    version = version or uuid.uuid4().hex
    path = f"{root.rstrip('/')}/{table}/v={version}"
    w = df
    if partition_by and partition_by in df.columns:
        w = df.hint("rebalance", partition_by).write.partitionBy(partition_by)
    else:
        w = df.write
    w.mode("errorifexists").parquet(path)
    return path


# What the application fetches single rows by: table -> columns
LOOKUP_COLUMNS = {
    "users": ["id", "email"], "workspaces": ["id"], "memberships": ["user_id", "workspace_id"], "workspace_invites": ["token", "id"],
    "clients": ["id"], "content_items": ["id"], "comments": ["id"], "tasks": ["id"],
}


def write_lookup_snapshot(df: DataFrame, root: str, table: str, version: str | None = None, row_group_bytes: int = 8 << 20) -> str:
    """Write ``df`` as a version of ``table`` that answers point lookups (F7) with little reading.

    Rows are range-partitioned and sorted by the first lookup column, so its
    minima and maxima cut the files and row groups; every lookup column has a
    Parquet Bloom filter per row group, which cuts those of the other columns.
    Row groups are small, since a hit reads a whole one.
    """
    path = f"{root.rstrip('/')}/{table}_lookup/v={version or uuid.uuid4().hex}"
    columns = LOOKUP_COLUMNS[table]
    w = df.repartitionByRange(F.col(columns[0])).sortWithinPartitions(columns[0]).write.option("parquet.block.size", row_group_bytes)
    for c in columns:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    w.mode("errorifexists").parquet(path)
    return path


def lookup_few(spark: SparkSession, path: str, column: str, keys: list) -> DataFrame:
    """The rows of a lookup snapshot whose ``column`` is one of a few ``keys``: the keys go
    into the scan as a filter, which row groups without any of them never pass.
    For a table of keys use ``reads.lookup``, which joins."""
    threshold = int(spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold"))
    if len(keys) > threshold:
        raise ValueError(f"{len(keys)} keys; beyond {threshold} Spark pushes only their range: use reads.lookup")
    return spark.read.parquet(path).filter(F.col(column).isin(keys))


def calendar_json(month_items: DataFrame, day_counts: DataFrame, workspaces: DataFrame | None = None
                  ) -> tuple[DataFrame, DataFrame]:
    """The export shape of the calendar, without gathering a tenant's
    items into one row.

    Returns (items, counts): ``items`` has one JSON object per item
    (``workspace_id``, ``item_json``), written as JSON lines per workspace;
    ``counts`` has one row per workspace with ``counts_by_day`` (map of
    date text -> count, at most 31 entries: one per day of the month) and
    its JSON text. With ``workspaces`` (``id``) every one of them has a counts
    row, {} if it has no items, and then no item lines (items []).
    """
    fields = ["id", "workspace_id", "client_id", "title", "description", "platform", "content_type", "status",
              "scheduled_date", "created_by", "created_at", "updated_at"]
    day = F.date_format("scheduled_date", "yyyy-MM-dd").alias("scheduled_date")
    item = F.struct(*[day if c == "scheduled_date" else F.col(c) for c in fields if c in month_items.columns])
    items = month_items.select("workspace_id", F.to_json(item).alias("item_json"))
    counts = day_counts.groupBy("workspace_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.date_format("scheduled_date", "yyyy-MM-dd"), "day_count")))
        .alias("counts_by_day"))
    if workspaces is not None:
        every = workspaces.select(F.col("id").alias("workspace_id")).distinct()
        counts = every.join(counts, "workspace_id", "left").withColumn(
            "counts_by_day", F.coalesce("counts_by_day", F.create_map().cast("map<string,bigint>")))
    counts = counts.withColumn("counts_json", F.to_json("counts_by_day"))
    return items, counts


def write_calendar_json(month_items: DataFrame, day_counts: DataFrame, root: str, version: str | None = None,
                        workspaces: DataFrame | None = None) -> str:
    """Write the S4 export (item lines and day counts) as a new version."""
    version = version or uuid.uuid4().hex
    items, counts = calendar_json(month_items, day_counts, workspaces)
    base = f"{root.rstrip('/')}/calendar/v={version}"
    items.hint("rebalance", "workspace_id").write.partitionBy("workspace_id").mode("errorifexists").json(f"{base}/items")
    counts.select("workspace_id", "counts_json").write.mode("errorifexists").json(f"{base}/counts")
    return base
