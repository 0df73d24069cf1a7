"""Registered read, join and aggregate queries (F*, J1-J5, J9, A*, T1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import enums as E
from ..operators import aggregates as A
from ..operators import reads as R
from .registry import AS_OF, MONTH, register

_STATUS_VALUES = ", ".join(f"('{s}')" for s in E.STATUSES)
_MONTH_START = f"date '{MONTH}-01'"
_MONTH_NEXT = f"(date '{MONTH}-01' + interval 1 month)"
_ITEM_COLS = "id, workspace_id, client_id, title, platform, content_type, status, scheduled_date, created_at, updated_at"
_ITEM_COLS_LIST = [c.strip() for c in _ITEM_COLS.split(",")]


@register("status_counts", uses=("workspaces", "content_items"), sql=f"""
select w.id as workspace_id, s.status, coalesce(c.n, 0) as item_count
from workspaces w cross join (values {_STATUS_VALUES}) s(status)
left join (select workspace_id, status, count(*) as n from content_items group by 1, 2) c
  on c.workspace_id = w.id and c.status = s.status""")
def status_counts(fx):
    """A1: items per workspace and status, all five statuses zero-filled."""
    return A.status_counts(fx.content_items, fx.workspaces)


@register("overdue_counts", uses=("workspaces", "tasks"), sql=f"""
select w.id as workspace_id, coalesce(o.n, 0) as overdue_tasks
from workspaces w left join (
  select workspace_id, count(*) as n from tasks
  where not done and due_date is not null and due_date < date '{AS_OF}' group by 1) o on o.workspace_id = w.id""")
def overdue_counts(fx):
    """A2: overdue tasks per workspace (strict), zero if none."""
    return A.overdue_counts(fx.tasks, fx.workspaces, AS_OF)


@register("content_totals", uses=("workspaces", "content_items"), sql="""
select w.id as workspace_id, cast(coalesce(sum(c.n), 0) as bigint) as total_items
from workspaces w left join (select workspace_id, status, count(*) as n from content_items
  where status in ('draft','review','approved','published','archived') group by 1, 2) c on c.workspace_id = w.id
group by w.id""")
def content_totals(fx):
    """A4: total items per workspace as the sum of its status counts."""
    return A.content_totals(A.status_counts(fx.content_items, fx.workspaces))


@register("dashboard", uses=("workspaces", "content_items", "tasks"), sql=f"""
with c as (select workspace_id,
  count(*) filter (where status = 'draft') as draft_count,
  count(*) filter (where status = 'review') as review_count,
  count(*) filter (where status = 'approved') as approved_count,
  count(*) filter (where status = 'published') as published_count,
  count(*) filter (where status = 'archived') as archived_count,
  count(*) as total_items from content_items group by 1),
o as (select workspace_id, count(*) as n from tasks
  where not done and due_date is not null and due_date < date '{AS_OF}' group by 1),
r as (select workspace_id, id, row_number() over (partition by workspace_id order by updated_at desc, id) as rk
  from content_items),
rr as (select workspace_id, count(*) as recent_count, max(case when rk = 1 then id end) as latest_item_id
  from r where rk <= {E.RECENT_ITEMS_LIMIT} group by 1)
select w.id as workspace_id, coalesce(draft_count, 0) as draft_count, coalesce(review_count, 0) as review_count,
  coalesce(approved_count, 0) as approved_count, coalesce(published_count, 0) as published_count,
  coalesce(archived_count, 0) as archived_count, coalesce(total_items, 0) as total_items,
  coalesce(o.n, 0) as overdue_tasks, cast(coalesce(recent_count, 0) as integer) as recent_count, latest_item_id
from workspaces w left join c on c.workspace_id = w.id left join o on o.workspace_id = w.id
left join rr on rr.workspace_id = w.id""")
def dashboard(fx):
    """A5: one row per workspace with status counts, total, overdue tasks and
    the recent items (flattened here to their number and the newest id)."""
    d = A.dashboard(fx.content_items, fx.tasks, fx.workspaces, AS_OF)
    return d.select(*[c for c in d.columns if c != "recent_items"],
                    F.size("recent_items").alias("recent_count"),
                    F.col("recent_items")[0]["id"].alias("latest_item_id"))


@register("recent_items", uses=("content_items",), sql=f"""
select workspace_id, id, title, updated_at, rk as rank from (
  select *, row_number() over (partition by workspace_id order by updated_at desc, id) as rk from content_items)
where rk <= {E.RECENT_ITEMS_LIMIT}""")
def recent_items(fx):
    """Ten latest updated items per workspace with their rank."""
    return R.recent_items(fx.content_items).select(
        "workspace_id", "id", "title", "updated_at", F.col("rank").cast("bigint").alias("rank"))


@register("month_items", uses=("content_items",), sql=f"""
select {_ITEM_COLS} from content_items
where scheduled_date >= {_MONTH_START} and scheduled_date < {_MONTH_NEXT} and platform = 'instagram'""")
def month_items(fx):
    """F4 + F10: items of the month; 'all' status and '' client mean no
    filter, the platform filter is applied."""
    return R.month_items(fx.content_items, MONTH, AS_OF, status="all", client_id="", platform="instagram").select(
        *_ITEM_COLS_LIST)


@register("day_counts", uses=("content_items",), sql=f"""
select workspace_id, scheduled_date, count(*) as day_count from content_items
where scheduled_date >= {_MONTH_START} and scheduled_date < {_MONTH_NEXT} and status = 'review'
group by 1, 2""")
def day_counts(fx):
    """A3: items per day of the month after the (status) filter."""
    mi = R.month_items(fx.content_items, MONTH, AS_OF, status="review")
    return A.day_counts(mi)


@register("calendar", uses=("content_items",), sql=f"""
with m as (select * from content_items where scheduled_date >= {_MONTH_START} and scheduled_date < {_MONTH_NEXT})
select m.id, m.workspace_id, m.title, m.scheduled_date, m.status,
       count(*) over (partition by m.workspace_id, m.scheduled_date) as day_count
from m""")
def calendar(fx):
    """Month items, each with the count of its day."""
    return A.calendar_items_with_counts(fx.content_items, MONTH, AS_OF).select(
        "id", "workspace_id", "title", "scheduled_date", "status", "day_count")


@register("calendar_grid", uses=("workspaces", "content_items"), sql=f"""
with d as (select cast(unnest(generate_series({_MONTH_START}, {_MONTH_NEXT} - interval 1 day, interval 1 day)) as date) as day),
c as (select workspace_id, scheduled_date, count(*) as n from content_items
      where scheduled_date >= {_MONTH_START} and scheduled_date < {_MONTH_NEXT} group by 1, 2),
g as (select w.id as workspace_id, d.day, dayofweek({_MONTH_START}) + day(d.day) - 1 as pos from workspaces w, d)
select g.workspace_id, g.day, cast(g.pos // 7 as integer) as week_row, cast(g.pos % 7 as integer) as weekday,
       coalesce(c.n, 0) as day_count, g.day = date '1997-06-15' as is_today
from g left join c on c.workspace_id = g.workspace_id and c.scheduled_date = g.day""")
def calendar_grid(fx):
    """Every day of the month per workspace with its grid cell and count."""
    mi = R.month_items(fx.content_items, MONTH, AS_OF)
    return A.calendar_grid(fx.workspaces, A.day_counts(mi), MONTH, AS_OF, today="1997-06-15")


@register("comment_counts", uses=("content_items", "comments"), sql="""
select i.id, i.workspace_id, coalesce(c.n, 0) as comment_count
from content_items i left join (select content_item_id, count(*) as n from comments group by 1) c
  on c.content_item_id = i.id""")
def comment_counts(fx):
    """Comments per item, 0 if none."""
    return A.comment_counts(fx.content_items, fx.comments)


@register("tenant_scope", uses=("content_items",), sql=f"select {_ITEM_COLS} from content_items where workspace_id = 7")
def tenant_scope(fx):
    """the rows of one workspace."""
    return R.tenant_scope(fx.content_items, 7).select(*_ITEM_COLS_LIST)


@register("live_rows", uses=("clients",), sql="select id, workspace_id, name from clients where deleted_at is null")
def live_rows(fx):
    """clients that are not soft-deleted."""
    return R.live_rows(fx.clients).select("id", "workspace_id", "name")


@register("list_content", uses=("content_items",), sql=f"""
select {_ITEM_COLS} from content_items where status = 'approved'""")
def list_content(fx):
    """items of every workspace with the status filter, newest update first."""
    return R.list_content(fx.content_items, status="approved").select(*_ITEM_COLS_LIST)


@register("list_clients", uses=("clients",), sql="""
select id, workspace_id, name, active from clients where deleted_at is null""")
def list_clients(fx):
    """live clients by name."""
    return R.list_clients(fx.clients).select("id", "workspace_id", "name", "active")


@register("list_tasks", uses=("tasks",), sql="select id, workspace_id, due_date, created_at, done from tasks")
def list_tasks(fx):
    """tasks by due date (nulls last), then newest created."""
    return R.list_tasks(fx.tasks).select("id", "workspace_id", "due_date", "created_at", "done")


@register("lookup", uses=("comment_requests", "content_items"), sql="""
select r.id, r.workspace_id, r.content_item_id, i.id is not null as found, i.title as found_title
from comment_requests r left join content_items i on i.id = r.content_item_id and i.workspace_id = r.workspace_id""")
def lookup(fx):
    """fetch the content item of each request, within its workspace."""
    keys = fx.comment_requests.select("id", "workspace_id", "content_item_id")
    return R.lookup(keys, fx.content_items, key="id", key_in_keys="content_item_id", columns=["title"])


@register("day_items", uses=("content_items",), sql=f"""
select {_ITEM_COLS} from content_items where scheduled_date = date '1997-06-15'""")
def day_items(fx):
    """F8: the items of one day."""
    return R.day_items(fx.content_items, "1997-06-15").select(*_ITEM_COLS_LIST)


@register("overdue_tasks", uses=("tasks",), sql=f"""
select id, workspace_id, due_date, done,
       (not done and due_date is not null and due_date < date '{AS_OF}') as overdue from tasks""")
def overdue_tasks(fx):
    """every task with its strict overdue flag."""
    return R.overdue_tasks(fx.tasks, AS_OF).select("id", "workspace_id", "due_date", "done", "overdue")


@register("task_links", uses=("tasks",), sql="""
select id, content_item_id is not null as linked_content, client_id is not null as linked_client,
       content_item_id is null and client_id is null as unlinked from tasks""")
def task_links(fx):
    """link flags of each task."""
    return R.task_links(fx.tasks).select("id", "linked_content", "linked_client", "unlinked")


@register("optional_filter", uses=("content_items",), sql="""
select id, workspace_id, status, platform from content_items where platform = 'tiktok'""")
def optional_filter(fx):
    """'' and 'all' add no predicate, a known value adds one."""
    df = fx.content_items
    for col, value, allowed in (("status", "all", E.STATUSES), ("client_id", "", None),
                                ("platform", "tiktok", E.PLATFORMS)):
        p = R.optional_filter(col, value, allowed)
        if p is not None:
            df = df.filter(p)
    return df.select("id", "workspace_id", "status", "platform")


@register("comments_with_author", uses=("comments", "users"), sql="""
select c.id, c.content_item_id, c.author_id, c.body, c.created_at, u.name as author_name, u.email as author_email
from comments c join users u on u.id = c.author_id""")
def comments_with_author(fx):
    """Comments with their author's name and email."""
    return R.comments_with_author(fx.comments, fx.users)


@register("members_with_user", uses=("memberships", "users"), sql="""
select m.workspace_id, m.user_id, m.role, m.joined_at, u.email as user_email, u.name as user_name
from memberships m join users u on u.id = m.user_id""")
def members_with_user(fx):
    """Members of every workspace with their user row."""
    return R.members_with_user(fx.memberships, fx.users)


@register("workspaces_of_user", uses=("memberships", "workspaces"), sql="""
select m.user_id, m.workspace_id, m.role, w.name as workspace_name
from memberships m join workspaces w on w.id = m.workspace_id where w.deleted_at is null""")
def workspaces_of_user(fx):
    """Live workspaces of each user."""
    return R.workspaces_of_user(fx.memberships, fx.workspaces).select("user_id", "workspace_id", "role", "workspace_name")


@register("default_workspace", uses=("users", "memberships", "workspaces"), sql="""
with j as (select m.user_id, m.workspace_id, m.role, w.name as workspace_name,
                  row_number() over (partition by m.user_id order by w.name, m.workspace_id, m.role) as rk
           from memberships m join workspaces w on w.id = m.workspace_id where w.deleted_at is null)
select u.id as user_id, j.workspace_id, j.workspace_name, j.role
from users u left join j on j.user_id = u.id and j.rk = 1""")
def default_workspace(fx):
    """Each user's first live workspace by name with role; null if none."""
    return R.default_workspace(fx.users, fx.memberships, fx.workspaces)


@register("content_detail", uses=("content_items", "comments", "users"), sql="""
with cm as (select c.content_item_id, c.id as comment_id, c.author_id, c.body, c.created_at as comment_created_at,
                   u.name as author_name, u.email as author_email
            from comments c join users u on u.id = c.author_id)
select i.id, i.workspace_id, i.title, i.status, cm.comment_id, cm.author_id, cm.body, cm.comment_created_at,
       cm.author_name
from content_items i left join cm on cm.content_item_id = i.id""")
def content_detail(fx):
    """J5 (flat form): each item with its comments; one empty row if none."""
    return R.content_detail(fx.content_items, fx.comments, fx.users).select(
        "id", "workspace_id", "title", "status", "comment_id", "author_id", "body", "comment_created_at", "author_name")


@register("visible_workspaces", uses=("access_requests", "workspaces", "memberships"), sql="""
select r.id, r.user_id, r.workspace_id,
       case when w.id is not null and m.user_id is not null then 'ok' else 'not_found' end as verdict,
       case when w.id is not null and m.user_id is not null then w.name end as workspace_name
from access_requests r
left join (select * from workspaces where deleted_at is null) w on w.id = r.workspace_id
left join memberships m on m.workspace_id = r.workspace_id and m.user_id = r.user_id""")
def visible_workspaces(fx):
    """Is each (user, workspace) pair visible (live and member)?"""
    req = fx.access_requests.select("id", "user_id", "workspace_id")
    return R.visible_workspaces(req, fx.workspaces, fx.memberships)
