"""Registered guards, access checks and audits."""

from __future__ import annotations

from ..functions import enums as E
from ..operators import checks as C
from .registry import register
from .sqltext import in_list

ENTITY_FIXTURES = ("users", "workspaces", "memberships", "invites", "clients", "content_items", "comments", "tasks")


_NAME = {"workspace_invites": "invites"}  # read_tables' names -> fixtures


def _tables(fx):
    return {"workspace_invites" if n == "invites" else n: fx[n] for n in ENTITY_FIXTURES}


_LIVE_CLIENT_KEYS = "(select distinct id, workspace_id from clients where deleted_at is null)"


@register("content_ref_check", uses=("content_drafts", "clients"), sql=f"""
select d.id, d.workspace_id, d.client_id, (d.client_id is null or c.id is not null) as client_ok,
       case when not (d.client_id is null or c.id is not null) then 'client_id' end as bad_field
from content_drafts d left join {_LIVE_CLIENT_KEYS} c on c.id = d.client_id and c.workspace_id = d.workspace_id""")
def content_ref_check(fx):
    """Is each draft's client null or a live client of its workspace."""
    return C.content_ref_check(fx.content_drafts.select("id", "workspace_id", "client_id"), fx.clients)


_TASK_REF_SQL = f"""
with g as (select r.id, r.workspace_id, r.client_id, r.content_item_id, r.assignee_id,
  (r.client_id is null or c.id is not null) as client_ok,
  (r.content_item_id is null or i.id is not null) as content_item_ok,
  (r.assignee_id is null or m.user_id is not null) as assignee_ok
  from task_requests r
  left join {_LIVE_CLIENT_KEYS} c on c.id = r.client_id and c.workspace_id = r.workspace_id
  left join (select distinct id, workspace_id from content_items) i on i.id = r.content_item_id and i.workspace_id = r.workspace_id
  left join (select distinct user_id, workspace_id from memberships) m on m.user_id = r.assignee_id and m.workspace_id = r.workspace_id)
select *, case when not client_ok then 'client_id' when not content_item_ok then 'content_item_id'
               when not assignee_ok then 'assignee_id' end as bad_field from g"""


@register("task_ref_check", uses=("task_requests", "clients", "content_items", "memberships"), sql=_TASK_REF_SQL)
def task_ref_check(fx):
    """The three tenant guards of a task write, first bad field in priority order."""
    rows = fx.task_requests.select("id", "workspace_id", "client_id", "content_item_id", "assignee_id")
    return C.task_ref_check(rows, fx.clients, fx.content_items, fx.memberships)


@register("deletable_comments", uses=("comment_deletes", "comments", "content_items"), sql="""
select r.id, r.workspace_id, r.comment_id, r.author_id, r.requested_at,
       case when exists (select 1 from comments c join content_items i on i.id = c.content_item_id
                         where c.id = r.comment_id and c.author_id = r.author_id and i.workspace_id = r.workspace_id)
            then 'accepted' else 'not_found' end as verdict
from comment_deletes r""")
def deletable_comments(fx):
    """Comment deletes that match author and workspace."""
    return C.deletable_comments(fx.comment_deletes, fx.comments, fx.content_items)


@register("access_check", uses=("access_requests", "memberships"), sql="""
select r.id, r.user_id, r.workspace_id, r.action, r.requested_at, m.role,
       case when r.workspace_id is null then 'no_workspace' when m.user_id is null then 'not_found'
            when r.action = 'write' and m.role not in ('cm', 'admin') then 'forbidden' else 'ok' end as verdict
from access_requests r left join memberships m on m.workspace_id = r.workspace_id and m.user_id = r.user_id""")
def access_check(fx):
    """Per request no_workspace / not_found / forbidden / ok."""
    return C.access_check(fx.access_requests, fx.memberships)


@register("dup_clients", uses=("clients",), sql="""
select workspace_id, lower(name) as name_key, count(*) as clients, min(id) as first_id
from clients where deleted_at is null group by 1, 2 having count(*) > 1""")
def dup_clients(fx):
    """Q1: live clients that share (workspace, lower(name))."""
    return C.dup_clients(fx.clients)


def _dup_sql(suffix=""):
    specs = [("users", "id", "id"), ("users", "email", "email"), ("workspaces", "id", "id"), ("clients", "id", "id"),
             ("content_items", "id", "id"), ("comments", "id", "id"), ("tasks", "id", "id"), ("workspace_invites", "id", "id"),
             ("workspace_invites", "token", "token"),
             ("memberships", "workspace_id,user_id", "concat_ws(',', cast(workspace_id as varchar), cast(user_id as varchar))")]
    parts = [f"select '{t}' as table_name, '{k}' as key_name, cast({e} as varchar) as value, count(*) as occurrences "
             f"from {_NAME.get(t, t)}{suffix} group by 3 having count(*) > 1" for t, k, e in specs]
    return "\nunion all\n".join(parts)


@register("dup_keys", uses=ENTITY_FIXTURES, sql=_dup_sql())
def dup_keys(fx):
    """Q2: repeated primary keys, emails, tokens and memberships."""
    return C.dup_keys(_tables(fx))


def _twice(name):
    """Every 97th row of a table once more."""
    key = {"memberships": "user_id", "tasks": "length(id)"}.get(name, "id")
    return f"select * from {name} union all select * from {name} where {key} % {11 if name == 'tasks' else 97} = 0"


_DUP_FOUND = "with " + ",\n".join(f"{n}_twice as ({_twice(n)})" for n in ENTITY_FIXTURES) + "\n" + "\nunion all\n".join(
    p for p in _dup_sql(suffix="_twice").split("\nunion all\n"))


@register("dup_keys_found", uses=ENTITY_FIXTURES, sql=_DUP_FOUND)
def dup_keys_found(fx):
    """Q2 on tables in which some rows stand twice: every repeated key is reported."""
    twice = {}
    for name, df in _tables(fx).items():
        key = {"memberships": "user_id", "tasks": "length(id)"}.get(name, "id")
        twice[name] = df.unionAll(df.filter(f"{key} % {11 if name == 'tasks' else 97} = 0"))
    return C.dup_keys(twice)


_ENUM_SPECS = [("content_items", "status", "status"), ("content_items", "platform", "platform"),
               ("content_items", "content_type", "content_type"), ("memberships", "role", "role"),
               ("transition_requests", "to_status", "status"), ("content_drafts", "platform", "platform"),
               ("content_drafts", "content_type", "content_type")]


def _bad_enum_sql():
    parts = [f"select '{t}' as table_name, '{c}' as column_name, {c} as value, count(*) as occurrences from {t} "
             f"where {c} is null or {c} not in {in_list(E.ENUMS[f])} group by 3" for t, c, f in _ENUM_SPECS]
    return "\nunion all\n".join(parts)


@register("bad_enums", uses=("content_items", "memberships", "transition_requests", "content_drafts"),
          sql=_bad_enum_sql())
def bad_enums(fx):
    """Q3: values outside the four enums, per table and column."""
    return C.bad_enums([(fx[t], t, c, f) for t, c, f in _ENUM_SPECS])


FULL = tuple(f"full_{n}" for n in ENTITY_FIXTURES)


def _full(fx):
    return {"workspace_invites" if n == "invites" else n: fx[f"full_{n}"] for n in ENTITY_FIXTURES}


# Written out from the tables' definitions, not from the operator's own list.
_ORPHAN_SQL = """
select 'memberships' as table_name, 'workspace_id' as column_name, c.workspace_id || ',' || c.user_id as row_key, cast(c.workspace_id as varchar) as missing
  from full_memberships c where c.workspace_id is not null and not exists (select 1 from full_workspaces p where p.id = c.workspace_id)
union all select 'memberships', 'user_id', c.workspace_id || ',' || c.user_id, cast(c.user_id as varchar)
  from full_memberships c where c.user_id is not null and not exists (select 1 from full_users p where p.id = c.user_id)
union all select 'workspace_invites', 'workspace_id', cast(c.id as varchar), cast(c.workspace_id as varchar)
  from full_invites c where c.workspace_id is not null and not exists (select 1 from full_workspaces p where p.id = c.workspace_id)
union all select 'workspace_invites', 'created_by', cast(c.id as varchar), cast(c.created_by as varchar)
  from full_invites c where c.created_by is not null and not exists (select 1 from full_users p where p.id = c.created_by)
union all select 'clients', 'workspace_id', cast(c.id as varchar), cast(c.workspace_id as varchar)
  from full_clients c where c.workspace_id is not null and not exists (select 1 from full_workspaces p where p.id = c.workspace_id)
union all select 'content_items', 'workspace_id', cast(c.id as varchar), cast(c.workspace_id as varchar)
  from full_content_items c where c.workspace_id is not null and not exists (select 1 from full_workspaces p where p.id = c.workspace_id)
union all select 'content_items', 'client_id', cast(c.id as varchar), cast(c.client_id as varchar)
  from full_content_items c where c.client_id is not null and not exists (select 1 from full_clients p where p.id = c.client_id)
union all select 'content_items', 'created_by', cast(c.id as varchar), cast(c.created_by as varchar)
  from full_content_items c where c.created_by is not null and not exists (select 1 from full_users p where p.id = c.created_by)
union all select 'comments', 'content_item_id', cast(c.id as varchar), cast(c.content_item_id as varchar)
  from full_comments c where c.content_item_id is not null and not exists (select 1 from full_content_items p where p.id = c.content_item_id)
union all select 'comments', 'author_id', cast(c.id as varchar), cast(c.author_id as varchar)
  from full_comments c where c.author_id is not null and not exists (select 1 from full_users p where p.id = c.author_id)
union all select 'tasks', 'workspace_id', c.id, cast(c.workspace_id as varchar)
  from full_tasks c where c.workspace_id is not null and not exists (select 1 from full_workspaces p where p.id = c.workspace_id)
union all select 'tasks', 'assignee_id', c.id, cast(c.assignee_id as varchar)
  from full_tasks c where c.assignee_id is not null and not exists (select 1 from full_users p where p.id = c.assignee_id)
union all select 'tasks', 'content_item_id', c.id, cast(c.content_item_id as varchar)
  from full_tasks c where c.content_item_id is not null and not exists (select 1 from full_content_items p where p.id = c.content_item_id)
union all select 'tasks', 'client_id', c.id, cast(c.client_id as varchar)
  from full_tasks c where c.client_id is not null and not exists (select 1 from full_clients p where p.id = c.client_id)"""


@register("orphans", uses=FULL, sql=_ORPHAN_SQL)
def orphans(fx):
    """Q4: references whose parent row is missing, over every reference of the data model."""
    return C.orphans(_full(fx))


@register("cross_tenant_refs", uses=("content_items", "tasks", "clients", "memberships"), sql=f"""
select 'content_items' as table_name, cast(i.id as varchar) as row_key, i.workspace_id, 'client_id' as bad_field
from content_items i left join {_LIVE_CLIENT_KEYS} c on c.id = i.client_id and c.workspace_id = i.workspace_id
where i.client_id is not null and c.id is null
union all
select 'tasks', t.id, t.workspace_id,
  case when not (t.client_id is null or c.id is not null) then 'client_id'
       when not (t.content_item_id is null or i.id is not null) then 'content_item_id' else 'assignee_id' end
from tasks t
left join {_LIVE_CLIENT_KEYS} c on c.id = t.client_id and c.workspace_id = t.workspace_id
left join (select distinct id, workspace_id from content_items) i on i.id = t.content_item_id and i.workspace_id = t.workspace_id
left join (select distinct user_id, workspace_id from memberships) m on m.user_id = t.assignee_id and m.workspace_id = t.workspace_id
where not ((t.client_id is null or c.id is not null) and (t.content_item_id is null or i.id is not null)
           and (t.assignee_id is null or m.user_id is not null))""")
def cross_tenant_refs(fx):
    """Q5: stored items and tasks that break the tenant guards."""
    return C.cross_tenant_refs(fx.content_items, fx.tasks, fx.clients, fx.memberships)


# Per table, written out from the tables' definitions.
_REQUIRED_COLUMNS = [
    ("users", "full_users", "id email name created_at updated_at"),
    ("workspaces", "full_workspaces", "id name created_at updated_at"),
    ("memberships", "full_memberships", "workspace_id user_id role joined_at"),
    ("workspace_invites", "full_invites", "id workspace_id created_by token max_uses use_count expires_at created_at"),
    ("clients", "full_clients", "id workspace_id name social_handles notes active created_at updated_at"),
    ("content_items", "full_content_items",
     "id workspace_id title description platform content_type status created_by created_at updated_at"),
    ("comments", "full_comments", "id content_item_id author_id body created_at"),
    ("tasks", "full_tasks", "id workspace_id title description done created_at updated_at"),
]
_NULL_SQL = "\nunion all\n".join(
    f"select '{t}' as table_name, '{c}' as column_name, count(*) filter (where {c} is null) as nulls from {f}"
    for t, f, cols in _REQUIRED_COLUMNS for c in cols.split())


@register("null_violations", uses=FULL, sql=_NULL_SQL)
def null_violations(fx):
    """Q6: nulls in every NOT NULL column of the data model, per table and column."""
    return C.null_violations(_full(fx))
