"""Registered tables after a batch (M1, M10, M11, M12, M14, M15, M16): what the verdicts lead to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import enums as E
from ..operators import changes as M
from .check_queries import FULL
from .registry import AS_OF, AS_OF_TS, register
from .sqltext import in_list, strict_date_ok

_LIVE_CLIENTS = "(select distinct id, workspace_id from clients where deleted_at is null)"


@register("create_content_state", uses=("content_drafts", "clients"), sql=f"""
select d.id, d.workspace_id, d.client_id, d.title, '' as description, d.platform, d.content_type, 'draft' as status,
       try_strptime(nullif(d.scheduled_date, ''), '%Y-%m-%d')::date as scheduled_date, d.created_by,
       timestamp '{AS_OF_TS}' as created_at, timestamp '{AS_OF_TS}' as updated_at
from content_drafts d left join {_LIVE_CLIENTS} c on c.id = d.client_id and c.workspace_id = d.workspace_id
where d.title <> '' and d.platform in {in_list(E.PLATFORMS)} and d.content_type in {in_list(E.CONTENT_TYPES)}
  and {strict_date_ok('d.scheduled_date')} and (d.client_id is null or c.id is not null)""")
def create_content_state(fx):
    """M1: the new items, as drafts with parsed dates."""
    _, new = M.create_content(fx.content_drafts, fx.clients, AS_OF)
    return new


@register("soft_delete_state", uses=("delete_requests", "clients"), sql="""
with d as (select cast(target_id as bigint) as client_id, workspace_id, min(requested_at) as at from delete_requests
           where target = 'client' group by 1, 2)
select c.id, c.workspace_id, c.name, coalesce(c.deleted_at, d.at) as deleted_at
from clients c left join d on d.client_id = c.id and d.workspace_id = c.workspace_id""")
def soft_delete_state(fx):
    """The clients after the deletions, marked at the first request's time."""
    req = fx.delete_requests.filter(F.col("target") == "client").select(
        "id", "workspace_id", F.col("target_id").cast("bigint").alias("client_id"), "requested_at")
    _, new = M.soft_delete_clients(fx.clients, req)
    return new.select("id", "workspace_id", "name", "deleted_at")


@register("soft_delete_workspaces_state", uses=("workspace_deletes", "workspaces", "memberships"), sql="""
with d as (select r.workspace_id, min(r.requested_at) as at from workspace_deletes r
           join memberships m on m.workspace_id = r.workspace_id and m.user_id = r.actor_id where m.role = 'admin' group by 1)
select w.id, w.name, coalesce(w.deleted_at, d.at) as deleted_at from workspaces w left join d on d.workspace_id = w.id""")
def soft_delete_workspaces_state(fx):
    """The workspaces after the deletions."""
    _, new = M.soft_delete_workspaces(fx.workspaces, fx.memberships, fx.workspace_deletes)
    return new.select("id", "name", "deleted_at")


@register("hard_delete_state", uses=("delete_requests", "tasks"), sql="""
select id, workspace_id, assignee_id from tasks t where not exists
  (select 1 from delete_requests r where r.target = 'task' and r.target_id = t.id and r.workspace_id = t.workspace_id)""")
def hard_delete_state(fx):
    """The tasks that are left."""
    req = fx.delete_requests.filter(F.col("target") == "task").select("id", "workspace_id", F.col("target_id").alias("task_id"), "requested_at")
    _, new = M.delete_tasks(fx.tasks, req)
    return new.select("id", "workspace_id", "assignee_id")


@register("delete_comments_state", uses=("comment_deletes", "comments", "content_items"), sql="""
select c.id, c.content_item_id, c.author_id from comments c where not exists (
  select 1 from comment_deletes r join content_items i on i.id = c.content_item_id and i.workspace_id = r.workspace_id
  where r.comment_id = c.id and r.author_id = c.author_id)""")
def delete_comments_state(fx):
    """The comments that are left."""
    _, new = M.delete_comments(fx.comments, fx.content_items, fx.comment_deletes)
    return new.select("id", "content_item_id", "author_id")


@register("register_users_state", uses=("registrations", "users", "workspaces", "memberships"), sql=f"""
with ok as (select *, coalesce(nullif(name, ''), email) as shown from registrations
            where email <> '' and email not in (select email from users where email is not null)
            qualify row_number() over (partition by email order by requested_at, id) = 1)
select 'users' as table_name, id, email as a, name as b from users
union all select 'users', new_user_id, email, shown from ok
union all select 'workspaces', id, name, null from workspaces
union all select 'workspaces', new_workspace_id, shown || '''s Workspace', null from ok
union all select 'memberships', workspace_id, cast(user_id as varchar), role from memberships
union all select 'memberships', new_workspace_id, cast(new_user_id as varchar), 'admin' from ok""")
def register_users_state(fx):
    """Users, workspaces and memberships after the registrations."""
    _, t = M.register_users(fx.users, fx.workspaces, fx.memberships, fx.registrations)
    none = F.lit(None).cast("string").alias("b")
    return (t["users"].select(F.lit("users").alias("table_name"), "id", F.col("email").alias("a"), F.col("name").alias("b"))
            .unionByName(t["workspaces"].select(F.lit("workspaces").alias("table_name"), "id", F.col("name").alias("a"), none))
            .unionByName(t["memberships"].select(F.lit("memberships").alias("table_name"), F.col("workspace_id").alias("id"),
                                                 F.col("user_id").cast("string").alias("a"), F.col("role").alias("b"))))


@register("write_workspaces_state", uses=("workspace_requests", "workspaces", "memberships"), sql="""
with ren as (select r.* from workspace_requests r join memberships m on m.workspace_id = r.workspace_id and m.user_id = r.actor_id
             join workspaces w on w.id = r.workspace_id and w.deleted_at is null
             where r.kind = 'rename' and m.role = 'admin' and r.name <> ''
             qualify row_number() over (partition by r.workspace_id order by r.requested_at desc, r.id desc) = 1),
made as (select * from workspace_requests where kind = 'create' and name <> '')
select 'workspaces' as table_name, w.id, coalesce(ren.name, w.name) as a, cast(w.deleted_at as varchar) is not null as b
from workspaces w left join ren on ren.workspace_id = w.id
union all select 'workspaces', workspace_id, name, false from made
union all select 'memberships', workspace_id, user_id || ':' || role, false from memberships
union all select 'memberships', workspace_id, actor_id || ':admin', false from made""")
def write_workspaces_state(fx):
    """Workspaces and memberships after creations and renames."""
    _, t = M.write_workspaces(fx.workspaces, fx.memberships, fx.workspace_requests)
    member = F.concat_ws(":", F.col("user_id").cast("string"), "role")
    return (t["workspaces"].select(F.lit("workspaces").alias("table_name"), "id", F.col("name").alias("a"),
                                   F.col("deleted_at").isNotNull().alias("b"))
            .unionByName(t["memberships"].select(F.lit("memberships").alias("table_name"), F.col("workspace_id").alias("id"),
                                                 member.alias("a"), F.lit(False).alias("b"))))


@register("add_comments_state", uses=("comment_requests", "comments", "content_items"), sql="""
select id, content_item_id, author_id, body, created_at from comments
union all
select r.id, r.content_item_id, r.author_id, r.body, r.requested_at from comment_requests r
where r.body <> '' and exists (select 1 from content_items i where i.id = r.content_item_id and i.workspace_id = r.workspace_id)""")
def add_comments_state(fx):
    """The comments after the batch."""
    _, new = M.add_comments(fx.comments, fx.content_items, fx.comment_requests)
    return new.select("id", "content_item_id", "author_id", "body", "created_at")


# Table by table, written out from the tables' definitions.
@register("cascade_all_state", uses=FULL, sql="""
with gw as (select id from full_workspaces where deleted_at is not null),
gc as (select id from full_clients where deleted_at is not null or workspace_id in (select id from gw)),
gi as (select id from full_content_items where id % 50 = 0 or workspace_id in (select id from gw)),
i as (select * from full_content_items where id not in (select id from gi)),
c as (select * from full_comments where content_item_id is null or content_item_id not in (select id from gi)),
gu as (select id from full_users where id % 3 = 0
       and id not in (select created_by from i where created_by is not null)
       and id not in (select author_id from c where author_id is not null))
select 'workspaces' as table_name, cast(id as varchar) as row_key, '' as refs from full_workspaces where id not in (select id from gw)
union all select 'clients', cast(id as varchar), cast(workspace_id as varchar) from full_clients where id not in (select id from gc)
union all select 'content_items', cast(id as varchar), workspace_id || ',' ||
    coalesce(cast(case when client_id in (select id from gc) then null else client_id end as varchar), '-') from i
union all select 'comments', cast(id as varchar), cast(content_item_id as varchar) from c
union all select 'users', cast(id as varchar), '' from full_users where id not in (select id from gu)
union all select 'memberships', workspace_id || ',' || user_id, role from full_memberships
  where workspace_id not in (select id from gw) and user_id not in (select id from gu)
union all select 'workspace_invites', cast(id as varchar), workspace_id || ',' || coalesce(cast(created_by as varchar), '-') from full_invites
  where workspace_id not in (select id from gw) and (created_by is null or created_by not in (select id from gu))
union all select 'tasks', id, workspace_id
    || ',' || coalesce(cast(case when assignee_id in (select id from gu) then null else assignee_id end as varchar), '-')
    || ',' || coalesce(cast(case when content_item_id in (select id from gi) then null else content_item_id end as varchar), '-')
    || ',' || coalesce(cast(case when client_id in (select id from gc) then null else client_id end as varchar), '-')
  from full_tasks where workspace_id not in (select id from gw)""")
def cascade_all_state(fx):
    """All eight tables after the removal of workspaces, clients, items and users."""
    t = {n.removeprefix("full_").replace("invites", "workspace_invites"): fx[n] for n in FULL}
    out, _ = M.cascade_delete(t, {
        "workspaces": t["workspaces"].filter("deleted_at IS NOT NULL"), "clients": t["clients"].filter("deleted_at IS NOT NULL"),
        "content_items": t["content_items"].filter("id % 50 = 0"), "users": t["users"].filter("id % 3 = 0")})

    def text(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit("-"))

    refs = {"workspaces": [], "users": [], "clients": ["workspace_id"], "content_items": ["workspace_id", "client_id"],
            "comments": ["content_item_id"], "memberships": ["role"], "workspace_invites": ["workspace_id", "created_by"],
            "tasks": ["workspace_id", "assignee_id", "content_item_id", "client_id"]}
    parts = []
    for name, cols in refs.items():
        key = ["workspace_id", "user_id"] if name == "memberships" else ["id"]
        parts.append(out[name].select(F.lit(name).alias("table_name"), F.concat_ws(",", *[F.col(k).cast("string") for k in key]).alias("row_key"),
                                      F.concat_ws(",", *[text(c) for c in cols]).alias("refs") if cols else F.lit("").alias("refs")))
    return reduce(DataFrame.unionByName, parts)
