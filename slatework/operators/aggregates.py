"""Aggregations A1-A8.

Counts are plain ``groupBy().agg`` (partial aggregation on the map side,
so only one row per group and task is shuffled, whatever the skew). Zero
filling uses the workspace table as the left side; the status frame is
built with ``explode`` of a fixed five-value array, not with a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import enums as E
from . import reads as R


def _workspace_frame(workspaces: DataFrame, workspace_id=None, live_only: bool = False) -> DataFrame:
    w = workspaces if not live_only else R.live_rows(workspaces)
    w = w if workspace_id is None else w.filter(F.col("id") == F.lit(workspace_id))
    return w.select(F.col("id").alias("workspace_id"))


# A1 ------------------------------------------------------------------------
def status_counts(items: DataFrame, workspaces: DataFrame, workspace_id=None, live_only: bool = False) -> DataFrame:
    """Items per (workspace, status); all five statuses present, zero-filled."""
    counts = (R.tenant_scope(items, workspace_id)
              .groupBy("workspace_id", "status").agg(F.count(F.lit(1)).alias("n")))
    frame = _workspace_frame(workspaces, workspace_id, live_only).select(
        "workspace_id", F.explode(F.array(*[F.lit(s) for s in E.STATUSES])).alias("status"))
    return (frame.join(counts, ["workspace_id", "status"], "left")
            .select("workspace_id", "status", F.coalesce("n", F.lit(0)).cast("bigint").alias("item_count")))


# A2 ------------------------------------------------------------------------
def overdue_counts(tasks: DataFrame, workspaces: DataFrame, as_of, workspace_id=None,
                   live_only: bool = False) -> DataFrame:
    od = (R.tenant_scope(tasks, workspace_id).filter(R.overdue_flag(as_of))
          .groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n")))
    return (_workspace_frame(workspaces, workspace_id, live_only).join(od, "workspace_id", "left")
            .select("workspace_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("overdue_tasks")))


# A3 ------------------------------------------------------------------------
def day_counts(month_items: DataFrame) -> DataFrame:
    """Items per (workspace, day) of already filtered month items."""
    return (month_items.filter(F.col("scheduled_date").isNotNull())
            .groupBy("workspace_id", "scheduled_date").agg(F.count(F.lit(1)).alias("day_count")))


# A4 ------------------------------------------------------------------------
def content_totals(status_counts_df: DataFrame) -> DataFrame:
    return status_counts_df.groupBy("workspace_id").agg(F.sum("item_count").cast("bigint").alias("total_items"))


# A5 ------------------------------------------------------------------------
def dashboard(items: DataFrame, tasks: DataFrame, workspaces: DataFrame, as_of, workspace_id=None,
              recent_n: int = E.RECENT_ITEMS_LIMIT, live_only: bool = False) -> DataFrame:
    """One row per workspace: five status counts, total, overdue tasks and
    the ``recent_n`` latest updated items (array of structs, newest first).

    Status counts come from a single conditional aggregation (one pass, no
    pivot job); the recent list from the WindowGroupLimit top-k of T1.
    """
    it = R.tenant_scope(items, workspace_id)
    aggs = [F.count_if(F.col("status") == s).alias(f"{s}_count") for s in E.STATUSES]
    aggs.append(F.count(F.lit(1)).alias("total_items"))
    counts = it.groupBy("workspace_id").agg(*aggs)
    recent = (R.recent_items(it, recent_n)
              .groupBy("workspace_id")
              .agg(F.array_sort(F.collect_list(F.struct("rank", "id", "title", "status", "updated_at")))
                   .alias("recent_items")))
    frame = _workspace_frame(workspaces, workspace_id, live_only)
    od = overdue_counts(tasks, workspaces, as_of, workspace_id, live_only)
    out = frame.join(counts, "workspace_id", "left").join(od, "workspace_id", "left").join(recent, "workspace_id", "left")
    cols = [F.coalesce(f"{s}_count", F.lit(0)).cast("bigint").alias(f"{s}_count") for s in E.STATUSES]
    return out.select(
        "workspace_id", *cols,
        F.coalesce("total_items", F.lit(0)).cast("bigint").alias("total_items"),
        F.col("overdue_tasks"),
        F.coalesce("recent_items", F.array()).alias("recent_items"))


# A6 ------------------------------------------------------------------------
def calendar(items: DataFrame, month: str, as_of, workspace_id=None, client_id=None,
             platform=None, status=None) -> tuple[DataFrame, DataFrame]:
    """Month items and their per-day counts (counts follow the filters)."""
    mi = R.month_items(items, month, as_of, workspace_id, client_id, platform, status)
    return mi, day_counts(mi)


def calendar_items_with_counts(items: DataFrame, month: str, as_of, **filters) -> DataFrame:
    """Flat form of A6: each month item with the count of its day."""
    mi, dc = calendar(items, month, as_of, **filters)
    return mi.join(dc, ["workspace_id", "scheduled_date"], "left")


# A7 ------------------------------------------------------------------------
def calendar_grid(workspaces: DataFrame, counts: DataFrame, month: str, as_of, today=None,
                  workspace_id=None) -> DataFrame:
    """Every day of the month for each workspace: grid cell (week row and
    weekday column, Sunday first), count (0 if none) and ``is_today``."""
    start, nxt = R.month_bounds(month, as_of)
    days = F.explode(F.sequence(start, F.date_sub(nxt, 1))).alias("day")
    frame = _workspace_frame(workspaces, workspace_id).select("workspace_id", days)
    lead = F.dayofweek(start) - 1  # empty cells before day 1, 0 = Sunday
    pos = lead + F.dayofmonth("day") - 1
    today_col = F.lit(today if today is not None else str(as_of)[:10]).cast("date")
    c = counts.select("workspace_id", F.col("scheduled_date").alias("day"), "day_count")
    return (frame.join(c, ["workspace_id", "day"], "left")
            .select("workspace_id", "day",
                    (pos / 7).cast("int").alias("week_row"),
                    (pos % 7).cast("int").alias("weekday"),
                    F.coalesce("day_count", F.lit(0)).cast("bigint").alias("day_count"),
                    (F.col("day") == today_col).alias("is_today")))


# A8 ------------------------------------------------------------------------
def comment_counts(items: DataFrame, comments: DataFrame, workspace_id=None) -> DataFrame:
    cc = comments.groupBy("content_item_id").agg(F.count(F.lit(1)).alias("n"))
    it = R.tenant_scope(items, workspace_id).select("id", "workspace_id")
    return (it.join(cc, it["id"] == cc["content_item_id"], "left")
            .select("id", "workspace_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("comment_count")))
