"""Reads, filters and joins: F1-F11, J1-J5, J9, T1.

Every operator works for all workspaces at once; ``workspace_id`` narrows
to one tenant (F1) and is pushed into the Parquet scan by Catalyst.
List results come back sorted with ``orderBy`` (a distributed range sort,
which splits a large tenant over many tasks); ``ordered`` in
``operators.scan`` adds an explicit position column where one is needed.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import enums as E


# F1 / F2 -------------------------------------------------------------------
def tenant_scope(df: DataFrame, workspace_id=None, col: str = "workspace_id") -> DataFrame:
    return df if workspace_id is None else df.filter(F.col(col) == F.lit(workspace_id))


def live_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("deleted_at").isNull())


# F10 -----------------------------------------------------------------------
def optional_filter(column: str, value, allowed: Iterable[str] | None = None) -> Column | None:
    """Predicate for an optional list filter.

    null, '' and 'all' mean "no filter" (returns None); a value outside
    ``allowed`` raises ``ValueError`` naming the allowed values.
    """
    if value is None or value == "" or value == "all":
        return None
    if allowed is not None and value not in allowed:
        raise ValueError(f"invalid {column}: {value!r} (allowed: {', '.join(allowed)})")
    return F.col(column) == F.lit(value)


def _and_all(df: DataFrame, preds: Iterable[Column | None]) -> DataFrame:
    for p in preds:
        if p is not None:
            df = df.filter(p)
    return df


# F3 ------------------------------------------------------------------------
def list_content(items: DataFrame, workspace_id=None, status=None, client_id=None) -> DataFrame:
    """Items of each workspace, optional status and client filters,
    newest update first (id breaks ties)."""
    out = _and_all(tenant_scope(items, workspace_id), [
        optional_filter("status", status, E.STATUSES),
        None if client_id in (None, "") else F.col("client_id") == F.lit(client_id),
    ])
    return out.orderBy("workspace_id", F.col("updated_at").desc(), "id")


# F4 ------------------------------------------------------------------------
def month_bounds(month: str, as_of) -> tuple[Column, Column]:
    """X2 on a literal: [first day, next first day) as date columns.

    Raises ``ValueError`` for a month that is not YYYY-MM (checked on the
    driver on the literal itself, so no job runs).
    """
    import datetime as _dt
    import re

    if month == "":
        d = _dt.date.fromisoformat(str(as_of)[:10]).replace(day=1)
    else:
        if not re.fullmatch(r"\d{4}-\d{2}", month or "") or not 1 <= int(month[5:]) <= 12:
            raise ValueError(f"invalid month format: {month} (expected YYYY-MM)")
        d = _dt.date(int(month[:4]), int(month[5:]), 1)
    start = F.lit(d.isoformat()).cast("date")
    return start, F.add_months(start, 1)


def month_items(items: DataFrame, month: str, as_of, workspace_id=None, client_id=None,
                platform=None, status=None) -> DataFrame:
    """Items scheduled in [month start, next month start), optional client,
    platform and status filters; ordered by scheduled_date, created_at, id."""
    start, nxt = month_bounds(month, as_of)
    out = _and_all(tenant_scope(items, workspace_id), [
        F.col("scheduled_date") >= start,
        F.col("scheduled_date") < nxt,
        None if client_id in (None, "", "all") else F.col("client_id") == F.lit(client_id),
        optional_filter("platform", platform, E.PLATFORMS),
        optional_filter("status", status, E.STATUSES),
    ])
    return out.orderBy("workspace_id", "scheduled_date", "created_at", "id")


# F5 / F6 -------------------------------------------------------------------
def list_clients(clients: DataFrame, workspace_id=None) -> DataFrame:
    return live_rows(tenant_scope(clients, workspace_id)).orderBy("workspace_id", "name", "id")


def list_tasks(tasks: DataFrame, workspace_id=None) -> DataFrame:
    return tenant_scope(tasks, workspace_id).orderBy(
        "workspace_id", F.col("due_date").asc_nulls_last(), F.col("created_at").desc(), "id")


# F7 ------------------------------------------------------------------------
def lookup(keys: DataFrame, table: DataFrame, key: str = "id", key_in_keys: str | None = None,
           scope: str | None = "workspace_id", live_only: bool = False,
           columns: Iterable[str] = ()) -> DataFrame:
    """Fetch rows by key for a table of lookup requests.

    Every request row is kept; ``found`` says whether a row with that key
    exists in the request's workspace. A row of another tenant looks
    exactly like a missing one. ``live_only`` also hides soft-deleted rows.
    """
    kk = key_in_keys or key
    right = live_rows(table) if live_only else table
    rcols = [F.col(key).alias("_k")] + ([F.col(scope).alias("_s")] if scope else [])
    right = right.select(*rcols, F.lit(True).alias("found"), *[F.col(c).alias(f"found_{c}") for c in columns])
    cond = F.col(kk) == F.col("_k")
    if scope:
        cond = cond & (F.col(scope) == F.col("_s"))
    out = keys.join(right, cond, "left")
    return out.drop("_k", "_s").withColumn("found", F.coalesce("found", F.lit(False)))


# F8 / F9 / F11 -------------------------------------------------------------
def day_items(items: DataFrame, day, workspace_id=None) -> DataFrame:
    return tenant_scope(items, workspace_id).filter(F.col("scheduled_date") == F.lit(day).cast("date"))


def overdue_flag(as_of) -> Column:
    """Strict: not done, due date present and before ``as_of``."""
    return (~F.col("done")) & F.col("due_date").isNotNull() & (F.col("due_date") < F.lit(as_of).cast("date"))


def overdue_tasks(tasks: DataFrame, as_of, workspace_id=None, only_overdue: bool = False) -> DataFrame:
    out = tenant_scope(tasks, workspace_id).withColumn("overdue", overdue_flag(as_of))
    return out.filter("overdue") if only_overdue else out


def task_links(tasks: DataFrame) -> DataFrame:
    return tasks.withColumns({
        "linked_content": F.col("content_item_id").isNotNull(),
        "linked_client": F.col("client_id").isNotNull(),
        "unlinked": F.col("content_item_id").isNull() & F.col("client_id").isNull(),
    })


# J1 ------------------------------------------------------------------------
def comments_with_author(comments: DataFrame, users: DataFrame, content_item_id=None) -> DataFrame:
    """Comments with author name and email, oldest first. Inner join: a
    comment whose author row is missing is not listed."""
    c = comments if content_item_id is None else comments.filter(F.col("content_item_id") == F.lit(content_item_id))
    u = users.select(F.col("id").alias("_uid"), F.col("name").alias("author_name"), F.col("email").alias("author_email"))
    return (c.join(u, F.col("author_id") == F.col("_uid"), "inner").drop("_uid")
            .orderBy("content_item_id", "created_at", "id"))


# J2 ------------------------------------------------------------------------
def members_with_user(memberships: DataFrame, users: DataFrame, workspace_id=None, nested: bool = False) -> DataFrame:
    u = users.select(F.col("id").alias("_uid"), F.col("email").alias("user_email"),
                     F.col("name").alias("user_name"))
    out = tenant_scope(memberships, workspace_id).join(u, F.col("user_id") == F.col("_uid"), "inner").drop("_uid")
    if nested:
        out = out.withColumn("user", F.struct(F.col("user_id").alias("id"), F.col("user_email").alias("email"),
                                              F.col("user_name").alias("name"))).drop("user_email", "user_name")
    return out.orderBy("workspace_id", "joined_at", "user_id")


# J3 / J4 -------------------------------------------------------------------
def workspaces_of_user(memberships: DataFrame, workspaces: DataFrame, user_id=None) -> DataFrame:
    m = memberships if user_id is None else memberships.filter(F.col("user_id") == F.lit(user_id))
    w = live_rows(workspaces).select(F.col("id").alias("workspace_id"), F.col("name").alias("workspace_name"))
    return m.select("user_id", "workspace_id", "role").join(w, "workspace_id").orderBy(
        "user_id", "workspace_name", "workspace_id")


def default_workspace(users: DataFrame, memberships: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Each user's first live workspace by name (id breaks ties), with role.

    A ``min`` over a struct is a plain aggregate with map-side partial
    aggregation, so a user with very many memberships is cheap.
    """
    firsts = (workspaces_of_user(memberships, workspaces)
              .groupBy("user_id")
              .agg(F.min(F.struct("workspace_name", "workspace_id", "role")).alias("_f")))
    return (users.select(F.col("id").alias("user_id"))
            .join(firsts, "user_id", "left")
            .select("user_id",
                    F.col("_f.workspace_id").alias("workspace_id"),
                    F.col("_f.workspace_name").alias("workspace_name"),
                    F.col("_f.role").alias("role")))


# J5 ------------------------------------------------------------------------
def content_detail(items: DataFrame, comments: DataFrame, users: DataFrame, workspace_id=None,
                   item_ids: Iterable | None = None, nested: bool = False) -> DataFrame:
    """Items with their comments (J1 rows, so with author name/email).

    Flat form (default): one row per (item, comment); an item without
    comments gives one row with null comment columns. Nested form: one row
    per item with ``comments`` as an array, [] when there are none. That is
    the application's detail view (all comments of an item in one row), so
    it needs ``item_ids``: a list, or a frame with an ``id`` column.
    """
    it = tenant_scope(items, workspace_id)
    if isinstance(item_ids, DataFrame):
        # a frame of ids (column ``id``): a semi join, nothing goes through the driver
        it = it.join(item_ids.select("id"), "id", "left_semi")
    elif item_ids is not None:
        it = it.filter(F.col("id").isin(list(item_ids)))
    elif nested:
        raise ValueError("nested content_detail needs item_ids")
    cm = comments_with_author(comments, users).select(
        F.col("content_item_id").alias("_ci"), F.col("id").alias("comment_id"), F.col("author_id"),
        F.col("body"), F.col("created_at").alias("comment_created_at"), "author_name", "author_email")
    # Inner join plus the items without comments, rather than a left join
    # from items: AQE can split a hot item's comments on either side of an
    # inner join, but only the left side of a left outer join.
    with_comments = it.join(cm, it["id"] == cm["_ci"], "inner").drop("_ci")
    without = it.join(cm.select("_ci"), it["id"] == F.col("_ci"), "left_anti")
    without = without.select("*", *[F.lit(None).cast(f.dataType).alias(f.name)
                                    for f in cm.schema.fields if f.name != "_ci"])
    joined = with_comments.unionByName(without)
    if not nested:
        return joined
    comment = F.struct(F.col("comment_created_at").alias("created_at"), F.col("comment_id").alias("id"),
                       "author_id", "body", "author_name", "author_email")
    keep = items.columns
    return (joined.groupBy(*keep)
            .agg(F.array_sort(F.collect_list(F.when(F.col("comment_id").isNotNull(), comment))).alias("comments"))
            .withColumn("comments", F.coalesce("comments", F.array())))


# J9 ------------------------------------------------------------------------
def visible_workspaces(requests: DataFrame, workspaces: DataFrame, memberships: DataFrame) -> DataFrame:
    """(user_id, workspace_id) requests -> 'ok' when the workspace exists,
    is live and the user is a member; otherwise 'not_found'."""
    w = live_rows(workspaces).select(F.col("id").alias("_wid"), F.col("name").alias("workspace_name"))
    m = memberships.select(F.col("workspace_id").alias("_mw"), F.col("user_id").alias("_mu"), F.lit(True).alias("_member"))
    out = (requests.join(w, requests["workspace_id"] == w["_wid"], "left")
           .join(m, (F.col("workspace_id") == F.col("_mw")) & (F.col("user_id") == F.col("_mu")), "left"))
    ok = F.col("_wid").isNotNull() & F.col("_member").isNotNull()
    return out.select(*requests.columns, F.when(ok, "ok").otherwise("not_found").alias("verdict"),
                      F.when(ok, F.col("workspace_name")).alias("workspace_name"))


# T1 ------------------------------------------------------------------------
def recent_items(items: DataFrame, n: int = E.RECENT_ITEMS_LIMIT, workspace_id=None) -> DataFrame:
    """The ``n`` latest updated items per workspace, ``rank`` 1..n.

    ``row_number() <= literal`` plans a WindowGroupLimit: each map task
    keeps at most ``n`` rows per workspace before the shuffle, so a very
    large workspace sends only ``n`` rows per task.
    """
    w = Window.partitionBy("workspace_id").orderBy(F.col("updated_at").desc(), F.col("id"))
    return (tenant_scope(items, workspace_id)
            .withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= n))


# T2 ------------------------------------------------------------------------
# The seven list orders of the application; ``id`` ends each one so that
# ties are resolved the same way every time.
ORDERS = {
    "content": ("workspace_id", ["updated_at", "id"], lambda: [F.col("updated_at").desc(), F.col("id")]),
    "month": ("workspace_id", ["scheduled_date", "created_at", "id"],
              lambda: [F.col("scheduled_date").asc(), F.col("created_at").asc(), F.col("id")]),
    "tasks": ("workspace_id", ["due_date", "created_at", "id"],
              lambda: [F.col("due_date").asc_nulls_last(), F.col("created_at").desc(), F.col("id")]),
    "clients": ("workspace_id", ["name", "id"], lambda: [F.col("name").asc(), F.col("id")]),
    "workspaces": ("user_id", ["workspace_name", "workspace_id"], lambda: [F.col("workspace_name").asc(), F.col("workspace_id")]),
    "members": ("workspace_id", ["joined_at", "user_id"], lambda: [F.col("joined_at").asc(), F.col("user_id")]),
    "comments": ("content_item_id", ["created_at", "id"], lambda: [F.col("created_at").asc(), F.col("id")]),
}


def ordered(df: DataFrame, kind: str) -> DataFrame:
    """Add ``position`` (1-based) in one of the seven list orders, per tenant
    (or per user / per item for the last three).

    Positions come from ``scan.prefix_count``: range partitioning over the
    whole sort key, so a tenant with most of the rows is still spread over
    many tasks, unlike a window partitioned by the tenant.
    """
    from . import scan

    key, uses, order = ORDERS[kind]
    out = scan.prefix_count(df, [key], order(), out="_prior", uses=uses)
    return out.withColumn("position", F.col("_prior") + 1).drop("_prior")
