"""Registered change jobs (M*): verdict rows per request."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import enums as E
from ..operators import workflow as W
from .registry import register
from .sqltext import in_list, valid_transition

_STATUSES = in_list(E.STATUSES)


_REPLAY_SQL = f"""
with recursive r as (
  select t.id, t.content_item_id, t.to_status, i.status as item_status,
         row_number() over (partition by t.content_item_id order by t.requested_at, t.id) as rn
  from transition_requests t join content_items i on i.id = t.content_item_id
  where t.to_status in {_STATUSES}),
walk as (
  select content_item_id, rn, id, to_status, item_status as state_before,
         case when {valid_transition('item_status', 'to_status')} then to_status else item_status end as state_after
  from r where rn = 1
  union all
  select r.content_item_id, r.rn, r.id, r.to_status, w.state_after as state_before,
         case when {valid_transition('w.state_after', 'r.to_status')} then r.to_status else w.state_after end
  from walk w join r on r.content_item_id = w.content_item_id and r.rn = w.rn + 1)
select id, content_item_id, to_status, state_before as from_status,
       case when state_after <> state_before then 'accepted' else 'invalid_transition' end as verdict
from walk
union all
select t.id, t.content_item_id, t.to_status, cast(null as varchar) as from_status,
       case when t.to_status not in {_STATUSES} then 'invalid_enum' else 'not_found' end as verdict
from transition_requests t left join content_items i on i.id = t.content_item_id
where t.to_status not in {_STATUSES} or i.id is null"""


@register("apply_transitions", uses=("transition_requests", "content_items"), sql=_REPLAY_SQL)
def apply_transitions(fx):
    """M3: all status requests, judged against stored statuses (several for one item: in time order)."""
    verdicts, _ = W.apply_transitions(fx.content_items, fx.transition_requests)
    return verdicts.select("id", "content_item_id", "to_status", "from_status", "verdict")


@register("replay_transitions", uses=("transition_requests", "content_items"), sql=_REPLAY_SQL)
def replay_transitions(fx):
    """M4: the whole request log in time order, each request judged against
    the status left by the requests before it."""
    verdicts, _ = W.replay_transitions(fx.content_items, fx.transition_requests)
    return verdicts.select("id", "content_item_id", "to_status", "from_status", "verdict")


# ---------------------------------------------------------------------------
from ..operators import changes as M  # noqa: E402
from ..operators import invites as I  # noqa: E402
from .registry import AS_OF  # noqa: E402
from .sqltext import strict_date_ok  # noqa: E402

_PLATFORMS = in_list(E.PLATFORMS)
_TYPES = in_list(E.CONTENT_TYPES)
_ROLES = in_list(E.ROLES)
_LIVE_CLIENT_KEYS = "(select distinct id, workspace_id from clients where deleted_at is null)"


def _chain(checks):
    """SQL verdict and field columns of the first failing check."""
    v = "case " + " ".join(f"when {c} then '{code}'" for c, code, _ in checks) + " else 'accepted' end as verdict"
    f = "case " + " ".join(f"when {c} then '{fld}'" for c, _, fld in checks) + " end as field"
    return f"{v}, {f}"


@register("create_content", uses=("content_drafts", "clients"), sql=f"""
select d.id, d.workspace_id, {_chain([
    ("d.title is null or d.title = ''", "required", "title"),
    (f"d.platform is null or d.platform not in {_PLATFORMS}", "invalid_enum", "platform"),
    (f"d.content_type is null or d.content_type not in {_TYPES}", "invalid_enum", "content_type"),
    (f"not {strict_date_ok('d.scheduled_date')}", "invalid_format", "scheduled_date"),
    ("not (d.client_id is null or c.id is not null)", "invalid_reference", "client_id")])},
  case when d.scheduled_date <> '' and d.scheduled_date similar to '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'
       then try_strptime(d.scheduled_date, '%Y-%m-%d')::date end as parsed_date
from content_drafts d left join {_LIVE_CLIENT_KEYS} c on c.id = d.client_id and c.workspace_id = d.workspace_id""")
def create_content(fx):
    """M1: validate drafts in the application's order; accepted ones become draft items."""
    v, _ = M.create_content(fx.content_drafts, fx.clients, AS_OF)
    from ..functions import scalars as X
    return v.select("id", "workspace_id", "verdict", "field",
                    X.parse_strict_date(X.empty_to_null("scheduled_date")).alias("parsed_date"))


_UPDATE_SQL = f"""
with g as (select u.*, (u.client_id is null or c.id is not null) as client_ok, i.id is not null as found
  from content_updates u
  left join {_LIVE_CLIENT_KEYS} c on c.id = u.client_id and c.workspace_id = u.workspace_id
  left join (select distinct id, workspace_id from content_items) i on i.id = u.content_item_id and i.workspace_id = u.workspace_id)
select id, content_item_id, {_chain([
    ("title is null or title = ''", "required", "title"),
    (f"platform is null or platform not in {_PLATFORMS}", "invalid_enum", "platform"),
    (f"content_type is null or content_type not in {_TYPES}", "invalid_enum", "content_type"),
    (f"not {strict_date_ok('scheduled_date')}", "invalid_format", "scheduled_date"),
    ("not found", "not_found", "content_item"),
    ("not client_ok", "invalid_reference", "client_id")])}
from g"""


@register("update_content", uses=("content_updates", "content_items", "clients"), sql=_UPDATE_SQL)
def update_content(fx):
    """M2: judge content updates (title, enums, date, item, client in that order)."""
    v, _ = M.update_content(fx.content_items, fx.content_updates, fx.clients)
    return v.select("id", "content_item_id", "verdict", "field")


_UPDATE_STATE_SQL = _UPDATE_SQL.replace("select id, content_item_id, ", "select *, ", 1)


@register("update_content_state", uses=("content_updates", "content_items", "clients"), sql=f"""
with v as ({_UPDATE_STATE_SQL.strip()}),
last as (select * from (select *, row_number() over (partition by content_item_id, workspace_id
                                                     order by requested_at desc, id desc) as rk
                        from v where verdict = 'accepted') where rk = 1)
select i.id, coalesce(l.title, i.title) as title, case when l.id is null then i.platform else l.platform end as platform,
       case when l.id is null then i.client_id else l.client_id end as client_id,
       case when l.id is null then i.scheduled_date
            else try_strptime(nullif(l.scheduled_date, ''), '%Y-%m-%d')::date end as scheduled_date,
       i.status, coalesce(l.requested_at, i.updated_at) as updated_at
from content_items i left join last l on l.content_item_id = i.id and l.workspace_id = i.workspace_id""")
def update_content_state(fx):
    """M2 state: the last accepted update of each item replaces its fields."""
    _, items = M.update_content(fx.content_items, fx.content_updates, fx.clients)
    return items.select("id", "title", "platform", "client_id", "scheduled_date", "status", "updated_at")


@register("upsert_memberships", uses=("membership_upserts", "memberships"), sql=f"""
with acc as (select * from membership_upserts where role in {_ROLES}),
last as (select * from (select workspace_id, user_id, role,
                               min(requested_at) over (partition by workspace_id, user_id) as first_at,
                               row_number() over (partition by workspace_id, user_id order by requested_at desc, id desc) as rk
                        from acc) where rk = 1)
select coalesce(m.workspace_id, l.workspace_id) as workspace_id, coalesce(m.user_id, l.user_id) as user_id,
       coalesce(l.role, m.role) as role, coalesce(m.joined_at, l.first_at) as joined_at
from memberships m full outer join last l on m.workspace_id = l.workspace_id and m.user_id = l.user_id""")
def upsert_memberships(fx):
    """M5: memberships after the upserts: role replaced, joined_at kept."""
    _, m = M.upsert_memberships(fx.memberships, fx.membership_upserts)
    return m


_CLAIMS_SQL = """
with c as (select cl.*, i.id as invite_id, i.workspace_id, i.max_uses, i.use_count, i.expires_at
           from claims cl left join invites i on i.token = cl.token),
live as (select *, row_number() over (partition by token order by claimed_at, id) - 1 as prior
         from c where invite_id is not null and not (claimed_at > expires_at)),
v as (select id, token, user_id, claimed_at, workspace_id,
             case when use_count + prior < max_uses then 'accepted' else 'unusable' end as verdict from live
      union all
      select id, token, user_id, claimed_at, workspace_id,
             case when invite_id is null then 'not_found' else 'unusable' end from c
      where invite_id is null or claimed_at > expires_at),
vm as (select v.*, m.role as mrole, m.user_id is not null as member from v
       left join memberships m on m.workspace_id = v.workspace_id and m.user_id = v.user_id),
nj as (select id, row_number() over (partition by workspace_id, user_id order by claimed_at, id) as rk
       from vm where verdict = 'accepted' and not member)
select vm.id, vm.token, vm.user_id, vm.workspace_id, vm.verdict,
       case when vm.verdict = 'accepted' then coalesce(vm.mrole, 'viewer') end as role,
       coalesce(nj.rk = 1, false) as new_member
from vm left join nj on nj.id = vm.id"""


@register("claim_invites", uses=("claims", "invites", "memberships"), sql=_CLAIMS_SQL)
def claim_invites(fx):
    """M6: invite claims judged at their own time against expiry and quota."""
    v, _, _ = I.claim_invites(fx.invites, fx.memberships, fx.claims)
    return v.select("id", "token", "user_id", "workspace_id", "verdict", "role", "new_member")


def _members_sql(kinds: str) -> str:
    """One by one: the members of a workspace as a list, stepped by its requests in time order."""
    role = "list_filter(w.st, lambda m: m.u = {})[1].r"
    actor, target = role.format("r.actor_id"), role.format("r.target_user_id")
    checks = _chain([
        ("actor is null", "not_found", "workspace"),
        ("actor <> 'admin'", "forbidden", "role"),
        (f"kind = 'change_role' and (role is null or role not in {_ROLES})", "invalid_enum", "role"),
        ("actor_id = target_user_id", "self", "user_id"),
        ("target is null", "not_found", "membership")])
    return f"""
with recursive r as (select *, row_number() over (partition by workspace_id order by requested_at, id) as rn
                     from member_requests where kind in ({kinds})),
s as (select workspace_id, list(struct_pack(u := user_id, r := role)) as st from memberships group by workspace_id),
walk as (
  select workspace_id, cast(0 as bigint) as rn, cast(null as bigint) as id, cast(null as varchar) as kind,
         cast(null as varchar) as verdict, cast(null as varchar) as field, st
  from s where workspace_id in (select workspace_id from r)
  union all
  select workspace_id, rn, id, kind, verdict, field,
         case when verdict <> 'accepted' then st when kind = 'remove' then list_filter(st, lambda m: m.u <> target_user_id)
              else list_transform(st, lambda m: struct_pack(u := m.u, r := case when m.u = target_user_id then role else m.r end)) end
  from (select *, {checks}
        from (select r.*, w.st, {actor} as actor, {target} as target
              from walk w join r on r.workspace_id = w.workspace_id and r.rn = w.rn + 1))),
done as (select id, kind, verdict, field from walk where rn > 0
         union all select id, kind, 'not_found', 'workspace' from r where workspace_id not in (select workspace_id from s))"""


@register("change_roles", uses=("member_requests", "memberships"), sql=_members_sql("'change_role'") + "\nselect id, verdict, field from done")
def change_roles(fx):
    """M7: admins change other members' roles, one by one in time order."""
    req = fx.member_requests.filter(F.col("kind") == "change_role")
    v, _ = M.change_roles(fx.memberships, req)
    return v.select("id", "verdict", "field")


@register("remove_members", uses=("member_requests", "memberships"), sql=_members_sql("'remove'") + "\nselect id, verdict, field from done")
def remove_members(fx):
    """M8: admins remove other members, one by one in time order."""
    req = fx.member_requests.filter(F.col("kind") == "remove")
    v, _ = M.remove_members(fx.memberships, req)
    return v.select("id", "verdict", "field")


@register("write_members", uses=("member_requests", "memberships"),
          sql=_members_sql("'change_role', 'remove'") + "\nselect id, kind, verdict, field from done")
def write_members(fx):
    """M7, M8: role changes and removals in one time order; rights are those at the time."""
    v, _ = M.write_members(fx.memberships, fx.member_requests)
    return v.select("id", "kind", "verdict", "field")


@register("write_members_state", uses=("member_requests", "memberships"), sql=_members_sql("'change_role', 'remove'") + """,
last as (select workspace_id, st from walk qualify row_number() over (partition by workspace_id order by rn desc) = 1)
select workspace_id, m.u as user_id, m.r as role from (select workspace_id, unnest(st) as m from last)
union all select workspace_id, user_id, role from memberships where workspace_id not in (select workspace_id from r)""")
def write_members_state(fx):
    """M7, M8: the members after the batch."""
    _, out = M.write_members(fx.memberships, fx.member_requests)
    return out.select("workspace_id", "user_id", "role")


# One by one: the live clients of a workspace with their names as a list, stepped by its requests in time order.
_CLIENTS_SQL = """
with recursive r as (select *, row_number() over (partition by workspace_id order by requested_at, id) as rn,
    case when kind = 'update' then 'c:' || client_id else 'n:' || id end as target from client_requests),
s as (select w.workspace_id, coalesce(list(struct_pack(c := 'c:' || c.id, k := lower(c.name))) filter (where c.id is not null), []) as st
      from (select distinct workspace_id from r) w
      left join clients c on c.workspace_id = w.workspace_id and c.deleted_at is null group by w.workspace_id),
walk as (
  select workspace_id, cast(0 as bigint) as rn, cast(null as bigint) as id, cast(null as varchar) as kind,
         cast(null as varchar) as verdict, st from s
  union all
  select workspace_id, rn, id, kind, verdict,
         case when verdict <> 'accepted' then st
              else list_append(list_filter(st, lambda x: x.c <> target), struct_pack(c := target, k := lower(name))) end
  from (select *, case when name is null or name = '' then 'required'
                       when kind = 'update' and len(list_filter(st, lambda x: x.c = target)) = 0 then 'not_found'
                       when len(list_filter(st, lambda x: x.k = lower(name) and x.c <> target)) > 0 then 'conflict'
                       else 'accepted' end as verdict
        from (select r.*, w.st from walk w join r on r.workspace_id = w.workspace_id and r.rn = w.rn + 1)))"""


@register("write_clients", uses=("client_requests", "clients"), sql=_CLIENTS_SQL + """
select id, kind, verdict, case verdict when 'required' then 'name' when 'conflict' then 'name' when 'not_found' then 'client' end as field
from walk where rn > 0""")
def write_clients(fx):
    """M9: create and update clients one by one in time order; names unique per workspace ignoring case."""
    v, _ = M.write_clients(fx.clients, fx.client_requests)
    return v.select("id", "kind", "verdict", "field")


@register("write_clients_state", uses=("client_requests", "clients"), sql=_CLIENTS_SQL + """,
ok as (select r.* from r join walk w on w.workspace_id = r.workspace_id and w.rn = r.rn where w.verdict = 'accepted'),
u as (select * from ok where kind = 'update'
      qualify row_number() over (partition by client_id, workspace_id order by requested_at desc, id desc) = 1)
select c.id, c.workspace_id, coalesce(u.name, c.name) as name, case when u.id is null then c.active else u.active end as active,
       c.deleted_at from clients c left join u on u.client_id = c.id and u.workspace_id = c.workspace_id
union all select id, workspace_id, name, true, null from ok where kind = 'create'""")
def write_clients_state(fx):
    """M9: the clients after the batch."""
    _, out = M.write_clients(fx.clients, fx.client_requests)
    return out.select("id", "workspace_id", "name", "active", "deleted_at")


@register("soft_delete", uses=("delete_requests", "clients"), sql=f"""
with r as (select id, workspace_id, cast(target_id as bigint) as client_id, requested_at from delete_requests
           where target = 'client'),
g as (select r.*, c.id is not null as found from r
      left join {_LIVE_CLIENT_KEYS} c on c.id = r.client_id and c.workspace_id = r.workspace_id),
w as (select id, row_number() over (partition by client_id, workspace_id order by requested_at, id) as rk
      from g where found)
select g.id, g.client_id, case when w.rk = 1 then 'accepted' else 'not_found' end as verdict,
       case when w.rk = 1 then null else 'client' end as field
from g left join w on w.id = g.id""")
def soft_delete(fx):
    """Soft-delete clients; a client is deleted once."""
    req = fx.delete_requests.filter(F.col("target") == "client").select(
        "id", "workspace_id", F.col("target_id").cast("bigint").alias("client_id"), "requested_at")
    v, _ = M.soft_delete_clients(fx.clients, req)
    return v.select("id", "client_id", "verdict", "field")


@register("soft_delete_workspaces", uses=("workspace_deletes", "workspaces", "memberships"), sql=f"""
with g as (select r.*, m.role as actor_role, w.id is not null as live from workspace_deletes r
           left join memberships m on m.workspace_id = r.workspace_id and m.user_id = r.actor_id
           left join (select id from workspaces where deleted_at is null) w on w.id = r.workspace_id),
p as (select *, {_chain([
    ("actor_role is null", "not_found", "workspace"),
    ("actor_role <> 'admin'", "forbidden", "role"),
    ("not live", "not_found", "workspace")])} from g),
w as (select id, row_number() over (partition by workspace_id order by requested_at, id) as rk
      from p where verdict = 'accepted')
select p.id, p.workspace_id, case when p.verdict = 'accepted' and w.rk > 1 then 'not_found' else p.verdict end as verdict,
       case when p.verdict = 'accepted' and w.rk > 1 then 'workspace' else p.field end as field
from p left join w on w.id = p.id""")
def soft_delete_workspaces(fx):
    """Admins soft-delete workspaces; each is deleted once."""
    v, _ = M.soft_delete_workspaces(fx.workspaces, fx.memberships, fx.workspace_deletes)
    return v.select("id", "workspace_id", "verdict", "field")


@register("hard_delete", uses=("delete_requests", "tasks"), sql="""
with r as (select id, workspace_id, target_id as task_id, requested_at from delete_requests where target = 'task'),
g as (select r.*, t.id is not null as found from r
      left join (select distinct id, workspace_id from tasks) t on t.id = r.task_id and t.workspace_id = r.workspace_id),
w as (select id, row_number() over (partition by task_id, workspace_id order by requested_at, id) as rk from g where found)
select g.id, g.task_id, case when w.rk = 1 then 'accepted' else 'not_found' end as verdict,
       case when w.rk = 1 then null else 'task' end as field
from g left join w on w.id = g.id""")
def hard_delete(fx):
    """Hard-delete tasks by key within the workspace; the first request wins."""
    req = fx.delete_requests.filter(F.col("target") == "task").select(
        "id", "workspace_id", F.col("target_id").alias("task_id"), "requested_at")
    v, _ = M.delete_tasks(fx.tasks, req)
    return v.select("id", "task_id", "verdict", "field")


@register("delete_comments", uses=("comment_deletes", "comments", "content_items"), sql="""
with g as (select r.*, exists (select 1 from comments c join content_items i on i.id = c.content_item_id
                               where c.id = r.comment_id and c.author_id = r.author_id
                                 and i.workspace_id = r.workspace_id) as ok from comment_deletes r),
w as (select id, row_number() over (partition by comment_id order by requested_at, id) as rk from g where ok)
select g.id, g.comment_id, case when w.rk = 1 then 'accepted' else 'not_found' end as verdict
from g left join w on w.id = g.id""")
def delete_comments(fx):
    """Authors delete their comments within the workspace."""
    v, _ = M.delete_comments(fx.comments, fx.content_items, fx.comment_deletes)
    return v.select("id", "comment_id", "verdict")


_ALL = ("users", "workspaces", "memberships", "invites", "clients", "content_items", "comments", "tasks")


def _entities(fx):
    return {"workspace_invites" if n == "invites" else n: fx["full_invites" if n == "invites" else n] for n in _ALL}


@register("cascade_delete", uses=_ALL, sql="""
with gw as (select id from workspaces where deleted_at is not null),
gc as (select id from clients where deleted_at is not null
       union select id from clients where workspace_id in (select id from gw)),
gi as (select id from content_items where workspace_id in (select id from gw))
select t.id, t.workspace_id,
       case when t.client_id in (select id from gc) then null else t.client_id end as client_id,
       case when t.content_item_id in (select id from gi) then null else t.content_item_id end as content_item_id,
       t.assignee_id
from tasks t where t.workspace_id not in (select id from gw)""")
def cascade_delete(fx):
    """Purge soft-deleted workspaces and clients; surviving tasks with
    references to removed rows set to null."""
    removed = {"workspaces": fx.workspaces.filter(F.col("deleted_at").isNotNull()).select("id"),
               "clients": fx.clients.filter(F.col("deleted_at").isNotNull()).select("id")}
    out, _ = M.cascade_delete(_entities(fx), removed)
    return out["tasks"].select("id", "workspace_id", "client_id", "content_item_id", "assignee_id")


_GONE_USERS = """
with gone as (select u.id, case when u.id in (select created_by from content_items where created_by is not null)
                or u.id in (select author_id from comments where author_id is not null)
                then 'in_use' else 'accepted' end as verdict
              from (select distinct id from users where id % 3 = 0) u)"""


@register("cascade_users", uses=_ALL, sql=_GONE_USERS + " select * from gone")
def cascade_users(fx):
    """Users who created items or wrote comments cannot be removed."""
    _, verdicts = M.cascade_delete(_entities(fx), {"users": fx.users.filter("id % 3 = 0").select("id")})
    return verdicts


@register("cascade_users_state", uses=_ALL, sql=_GONE_USERS + """
select t.id, case when t.assignee_id in (select id from gone where verdict = 'accepted') then null else t.assignee_id end
  as assignee_id from tasks t""")
def cascade_users_state(fx):
    """Tasks after the removal of users: references to removed ones are null."""
    out, _ = M.cascade_delete(_entities(fx), {"users": fx.users.filter("id % 3 = 0").select("id")})
    return out["tasks"].select("id", "assignee_id")


_TASKS_SQL = f"""
with r as (select q.*, t.id as tid,
             case when q.kind = 'toggle' then t.client_id else q.client_id end as e_client,
             case when q.kind = 'toggle' then t.content_item_id else q.content_item_id end as e_item,
             case when q.kind = 'toggle' then t.assignee_id else q.assignee_id end as e_assignee
           from task_requests q left join tasks t on t.id = q.task_key and t.workspace_id = q.workspace_id),
g as (select r.*, (e_client is null or c.id is not null) as client_ok, (e_item is null or i.id is not null) as item_ok,
             (e_assignee is null or m.user_id is not null) as assignee_ok from r
      left join {_LIVE_CLIENT_KEYS} c on c.id = r.e_client and c.workspace_id = r.workspace_id
      left join (select distinct id, workspace_id from content_items) i on i.id = r.e_item and i.workspace_id = r.workspace_id
      left join (select distinct user_id, workspace_id from memberships) m
        on m.user_id = r.e_assignee and m.workspace_id = r.workspace_id)
select *, {_chain([
    ("kind <> 'toggle' and (title is null or title = '')", "required", "title"),
    (f"kind <> 'toggle' and not {strict_date_ok('due_date')}", "invalid_format", "due_date"),
    ("kind <> 'create' and tid is null", "not_found", "task"),
    ("not client_ok", "invalid_reference", "client_id"),
    ("not item_ok", "invalid_reference", "content_item_id"),
    ("not assignee_ok", "invalid_reference", "assignee_id")])}
from g"""


@register("write_tasks", uses=("task_requests", "tasks", "clients", "content_items", "memberships"),
          sql=f"with v as ({_TASKS_SQL}) select id, kind, verdict, field from v")
def write_tasks(fx):
    """Create, update and toggle tasks with the tenant guards."""
    v, _ = M.write_tasks(fx.tasks, fx.task_requests, fx.clients, fx.content_items, fx.memberships)
    return v.select("id", "kind", "verdict", "field")


@register("write_tasks_state", uses=("task_requests", "tasks", "clients", "content_items", "memberships"), sql=f"""
with v as ({_TASKS_SQL}), ok as (select *, try_strptime(nullif(due_date, ''), '%Y-%m-%d')::date as due from v where verdict = 'accepted')
select t.id, t.workspace_id, case when u.id is not null then u.assignee_id else t.assignee_id end as assignee_id,
  case when u.id is not null then u.due else t.due_date end as due_date,
  case when u.id is not null then u.done when f.id is not null then not t.done else t.done end as done,
  case when u.id is not null then u.content_item_id else t.content_item_id end as content_item_id,
  case when u.id is not null then u.client_id else t.client_id end as client_id
from tasks t left join ok u on u.kind = 'update' and u.task_key = t.id and u.workspace_id = t.workspace_id
  left join ok f on f.kind = 'toggle' and f.task_key = t.id and f.workspace_id = t.workspace_id
union all
select id, workspace_id, assignee_id, due, done, content_item_id, client_id from ok where kind = 'create'""")
def write_tasks_state(fx):
    """The tasks after the batch (these requests name each task once; tests/test_brute_force.py has longer logs)."""
    _, out = M.write_tasks(fx.tasks, fx.task_requests, fx.clients, fx.content_items, fx.memberships, staged=True)
    return out.select("id", "workspace_id", "assignee_id", "due_date", "done", "content_item_id", "client_id")


@register("register_users", uses=("registrations", "users"), sql="""
with g as (select r.*, exists (select 1 from users u where u.email = r.email) as taken from registrations r),
p as (select *, case when email is null or email = '' then 'required' when taken then 'conflict' else 'accepted' end as pre
      from g),
w as (select id, row_number() over (partition by email order by requested_at, id) as rk from p where pre = 'accepted')
select p.id, p.email, case when p.pre = 'accepted' and w.rk > 1 then 'conflict' else p.pre end as verdict,
       case when p.pre = 'required' then 'email' when p.pre = 'conflict' or w.rk > 1 then 'email' end as field,
       case when p.pre = 'accepted' and w.rk = 1 then coalesce(nullif(p.name, ''), p.email) || '''s Workspace' end
         as workspace_name
from p left join w on w.id = p.id""")
def register_users(fx):
    """Register users with a personal workspace; duplicate emails rejected."""
    from ..functions import scalars as X
    v, _ = M.register_users(fx.users, fx.workspaces, fx.memberships, fx.registrations)
    return v.select("id", "email", "verdict", "field",
                    F.when(F.col("verdict") == "accepted",
                           X.personal_workspace_name(X.user_display_name("name", "email"))).alias("workspace_name"))


@register("write_workspaces", uses=("workspace_requests", "workspaces", "memberships"), sql=f"""
with g as (select r.*, m.role as actor_role, w.id is not null as live from workspace_requests r
           left join memberships m on m.workspace_id = r.workspace_id and m.user_id = r.actor_id
           left join (select id from workspaces where deleted_at is null) w on w.id = r.workspace_id)
select id, kind, {_chain([
    ("kind = 'create' and (name is null or name = '')", "required", "name"),
    ("kind <> 'create' and actor_role is null", "not_found", "workspace"),
    ("kind <> 'create' and actor_role <> 'admin'", "forbidden", "role"),
    ("kind <> 'create' and (name is null or name = '')", "required", "name"),
    ("kind <> 'create' and not live", "not_found", "workspace")])}
from g""")
def write_workspaces(fx):
    """Create workspaces and rename live ones (admin only)."""
    v, _ = M.write_workspaces(fx.workspaces, fx.memberships, fx.workspace_requests)
    return v.select("id", "kind", "verdict", "field")


@register("add_comments", uses=("comment_requests", "content_items"), sql=f"""
select r.id, r.content_item_id, {_chain([
    ("r.body is null or r.body = ''", "required", "body"),
    ("i.id is null", "not_found", "content_item")])}
from comment_requests r left join (select distinct id, workspace_id from content_items) i
  on i.id = r.content_item_id and i.workspace_id = r.workspace_id""")
def add_comments(fx):
    """Comments need a body and an item in the workspace."""
    v, _ = M.add_comments(fx.comments, fx.content_items, fx.comment_requests)
    return v.select("id", "content_item_id", "verdict", "field")


_INVITES_SQL = f"""
with j as (
  select r.*, {_chain([
    ("m.role is null", "not_found", "workspace"),
    ("m.role <> 'admin'", "forbidden", "role"),
    ("r.token is null or r.token = ''", "required", "token"),
    ("r.token in (select token from invites where token is not null)", "conflict", "token")])}
  from invite_requests r left join memberships m on m.workspace_id = r.workspace_id and m.user_id = r.actor_id),
k as (select *, verdict = 'accepted' and token is not null
               and row_number() over (partition by token, verdict order by requested_at, id) > 1 as late from j),
v as (select id, workspace_id, actor_id, token, requested_at,
  case when late then 'conflict' else verdict end as verdict, case when late then 'token' else field end as field,
  cast(case when max_uses is null or max_uses <= 0 then {E.DEFAULT_INVITE_MAX_USES} else max_uses end as integer)
    as effective_max_uses,
  requested_at + (case when expires_in_hours is null or expires_in_hours <= 0 then {E.DEFAULT_INVITE_HOURS}
                       else expires_in_hours end) * interval '1 hour' as expires_at
  from k)"""


@register("issue_invites", uses=("invite_requests", "memberships", "invites"), sql=_INVITES_SQL + """
select id, workspace_id, verdict, field, effective_max_uses, expires_at from v""")
def issue_invites(fx):
    """Admins issue invites with default quota and lifetime; tokens stay unique."""
    v, _ = M.issue_invites(fx.invites, fx.memberships, fx.invite_requests)
    return v.select("id", "workspace_id", "verdict", "field", "effective_max_uses", "expires_at")


@register("issue_invites_state", uses=("invite_requests", "memberships", "invites"), sql=_INVITES_SQL + """
select id, workspace_id, token, max_uses, use_count, expires_at from invites
union all select id, workspace_id, token, effective_max_uses, 0, expires_at from v where verdict = 'accepted'""")
def issue_invites_state(fx):
    """The invites after the batch."""
    _, out = M.issue_invites(fx.invites, fx.memberships, fx.invite_requests)
    return out.select("id", "workspace_id", "token", "max_uses", "use_count", "expires_at")


# ---- one key per request kind (SURVEY names) --------------------------------
# Each runs the same job on the requests of one kind only; the oracle is the
# combined one with its request table narrowed the same way.
from .registry import BODIES, ORACLE  # noqa: E402


def _narrowed_sql(base_key: str, table_ref: str, kind: str) -> str:
    sql = ORACLE[base_key]
    assert sql.count(table_ref) == 1, (base_key, table_ref)
    if table_ref.endswith(")"):
        return sql.replace(table_ref, f"{table_ref[:-1]} where kind = '{kind}')")
    alias = table_ref.split()[-1]
    return sql.replace(table_ref, f"from (select * from {table_ref.split()[1]} where kind = '{kind}') {alias}")


def _register_kind(name: str, base_key: str, table_ref: str, kind: str, table: str, doc: str):
    fn, uses = BODIES[base_key]

    def body(fx):
        narrowed = _KindFixtures(fx, table, kind)
        return fn(narrowed)

    body.__doc__ = doc
    register(name, uses=())(body)
    ORACLE[name] = _narrowed_sql(base_key, table_ref, kind)


class _KindFixtures:
    """Fixtures view in which one request table holds only one kind."""

    def __init__(self, fx, table: str, kind: str):
        self._fx, self._table, self._kind = fx, table, kind
        self.spark = fx.spark

    def __getitem__(self, name):
        df = self._fx[name]
        return df.filter(F.col("kind") == self._kind) if name == self._table else df

    def __getattr__(self, name):
        return self[name]


for _name, _base, _ref, _kind, _table, _doc in [
    ("create_clients", "write_clients", "target from client_requests)", "create", "client_requests",
     "M9: create clients (name required, unique per workspace ignoring case, handles normalised)."),
    ("update_clients", "write_clients", "target from client_requests)", "update", "client_requests",
     "M9: update live clients (name required, found, unique per workspace ignoring case)."),
    ("create_tasks", "write_tasks", "from task_requests q", "create", "task_requests",
     "M13: create tasks (title, due date, then the three tenant guards)."),
    ("update_tasks", "write_tasks", "from task_requests q", "update", "task_requests",
     "M13: update tasks (title, due date, found, then the three tenant guards)."),
    ("toggle_done", "write_tasks", "from task_requests q", "toggle", "task_requests",
     "M13: flip done of existing tasks, stored references guarded again."),
    ("create_workspaces", "write_workspaces", "from workspace_requests r", "create", "workspace_requests",
     "M15: create workspaces; the creator becomes admin."),
    ("rename_workspaces", "write_workspaces", "from workspace_requests r", "rename", "workspace_requests",
     "M15: rename live workspaces, admin only."),
]:
    _register_kind(_name, _base, _ref, _kind, _table, _doc)
