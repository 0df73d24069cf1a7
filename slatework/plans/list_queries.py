"""Registered list orders (T2), point lookups (F7) and whole nested results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import enums as E
from ..functions import scalars as X
from ..operators import aggregates as A
from ..operators import reads as R
from ..operators import workflow as W
from ..sources import export as S
from .change_queries import _REPLAY_SQL
from .registry import AS_OF, MONTH, register

_MONTH_START = f"date '{MONTH}-01'"
_MONTH_NEXT = f"(date '{MONTH}-01' + interval 1 month)"


# ---- T2: the lists of F3-F6 and J1-J3 with their positions -----------------
@register("ordered_content", uses=("content_items",), sql="""
select id, workspace_id, title, updated_at, row_number() over (partition by workspace_id order by updated_at desc, id) as position
from content_items where status = 'approved'""")
def ordered_content(fx):
    """The content list of every workspace, newest update first."""
    df = R.list_content(fx.content_items, status="approved").select("id", "workspace_id", "title", "updated_at")
    return R.ordered(df, "content")


@register("ordered_month", uses=("content_items",), sql=f"""
select id, workspace_id, scheduled_date, created_at,
       row_number() over (partition by workspace_id order by scheduled_date, created_at, id) as position
from content_items where scheduled_date >= {_MONTH_START} and scheduled_date < {_MONTH_NEXT}""")
def ordered_month(fx):
    """The items of a month in calendar order."""
    df = R.month_items(fx.content_items, MONTH, AS_OF).select("id", "workspace_id", "scheduled_date", "created_at")
    return R.ordered(df, "month")


@register("ordered_clients", uses=("clients",), sql="""
select id, workspace_id, name, active, row_number() over (partition by workspace_id order by name, id) as position
from clients where deleted_at is null""")
def ordered_clients(fx):
    """Live clients by name."""
    return R.ordered(R.list_clients(fx.clients).select("id", "workspace_id", "name", "active"), "clients")


@register("ordered_workspaces", uses=("memberships", "workspaces"), sql="""
select m.user_id, m.workspace_id, m.role, w.name as workspace_name,
       row_number() over (partition by m.user_id order by w.name, m.workspace_id) as position
from memberships m join workspaces w on w.id = m.workspace_id where w.deleted_at is null""")
def ordered_workspaces(fx):
    """The live workspaces of every user by name."""
    df = R.workspaces_of_user(fx.memberships, fx.workspaces).select("user_id", "workspace_id", "role", "workspace_name")
    return R.ordered(df, "workspaces")


@register("ordered_members", uses=("memberships", "users"), sql="""
select m.workspace_id, m.user_id, m.role, m.joined_at, u.email as user_email, u.name as user_name,
       row_number() over (partition by m.workspace_id order by m.joined_at, m.user_id) as position
from memberships m join users u on u.id = m.user_id""")
def ordered_members(fx):
    """The members of every workspace, earliest first."""
    return R.ordered(R.members_with_user(fx.memberships, fx.users), "members")


@register("ordered_comments", uses=("comments", "users"), sql="""
select c.id, c.content_item_id, c.author_id, c.body, c.created_at, u.name as author_name, u.email as author_email,
       row_number() over (partition by c.content_item_id order by c.created_at, c.id) as position
from comments c join users u on u.id = c.author_id""")
def ordered_comments(fx):
    """The comments of every item, oldest first."""
    return R.ordered(R.comments_with_author(fx.comments, fx.users), "comments")


# ---- F7: the other eight lookups (``lookup`` is that of content items) ------
@register("lookup_task", uses=("delete_requests", "tasks"), sql="""
select r.id, r.workspace_id, r.target_id, t.id is not null as found, t.due_date as found_due_date
from delete_requests r left join tasks t on t.id = r.target_id and t.workspace_id = r.workspace_id""")
def lookup_task(fx):
    """tasks by id within the workspace."""
    return R.lookup(fx.delete_requests.select("id", "workspace_id", "target_id"), fx.tasks, key_in_keys="target_id", columns=["due_date"])


@register("lookup_client", uses=("client_requests", "clients"), sql="""
select r.id, r.workspace_id, r.client_id, c.id is not null as found, c.name as found_name
from client_requests r left join clients c on c.id = r.client_id and c.workspace_id = r.workspace_id and c.deleted_at is null""")
def lookup_client(fx):
    """live clients by id within the workspace."""
    return R.lookup(fx.client_requests.select("id", "workspace_id", "client_id"), fx.clients, key_in_keys="client_id",
                    live_only=True, columns=["name"])


@register("lookup_comment", uses=("comment_deletes", "comments"), sql="""
select r.id, r.comment_id, c.id is not null as found, c.content_item_id as found_content_item_id, c.author_id as found_author_id
from comment_deletes r left join comments c on c.id = r.comment_id""")
def lookup_comment(fx):
    """comments by id; their item tells the workspace."""
    return R.lookup(fx.comment_deletes.select("id", "comment_id"), fx.comments, key_in_keys="comment_id", scope=None,
                    columns=["content_item_id", "author_id"])


@register("lookup_workspace", uses=("access_requests", "workspaces"), sql="""
select r.id, r.workspace_id, w.id is not null as found, w.name as found_name, w.deleted_at as found_deleted_at
from access_requests r left join workspaces w on w.id = r.workspace_id""")
def lookup_workspace(fx):
    """workspaces by id, deleted ones too."""
    return R.lookup(fx.access_requests.select("id", "workspace_id"), fx.workspaces, key_in_keys="workspace_id", scope=None,
                    columns=["name", "deleted_at"])


@register("lookup_membership", uses=("access_requests", "memberships"), sql="""
select r.id, r.workspace_id, r.user_id, m.user_id is not null as found, m.role as found_role
from access_requests r left join memberships m on m.workspace_id = r.workspace_id and m.user_id = r.user_id""")
def lookup_membership(fx):
    """memberships by workspace and user."""
    return R.lookup(fx.access_requests.select("id", "workspace_id", "user_id"), fx.memberships, key="user_id", columns=["role"])


@register("lookup_invite", uses=("claims", "invites"), sql="""
select r.id, r.token, i.id is not null as found, i.workspace_id as found_workspace_id, i.max_uses as found_max_uses
from claims r left join invites i on i.token = r.token""")
def lookup_invite(fx):
    """invites by token."""
    return R.lookup(fx.claims.select("id", "token"), fx.invites, key="token", scope=None, columns=["workspace_id", "max_uses"])


@register("lookup_user_email", uses=("registrations", "users"), sql="""
select r.id, r.email, u.id is not null as found, u.id as found_id, u.name as found_name
from registrations r left join users u on u.email = r.email""")
def lookup_user_email(fx):
    """users by email (exact match)."""
    return R.lookup(fx.registrations.select("id", "email"), fx.users, key="email", scope=None, columns=["id", "name"])


@register("lookup_user", uses=("access_requests", "users"), sql="""
select r.id, r.user_id, u.id is not null as found, u.email as found_email
from access_requests r left join users u on u.id = r.user_id""")
def lookup_user(fx):
    """users by id."""
    return R.lookup(fx.access_requests.select("id", "user_id"), fx.users, key_in_keys="user_id", scope=None, columns=["email"])


@register("lookup_snapshot", uses=("invites",), sql="""
select id, workspace_id, token, max_uses from invites where token in ('tok-1', 'tok-17', 'tok-150', 'missing')""")
def lookup_snapshot(fx):
    """a few tokens out of a sorted snapshot with Bloom filters."""
    path = S.write_lookup_snapshot(fx.invites.select("id", "workspace_id", "token", "max_uses"), S.shared_root(fx.spark) + "/snapshots",
                                   "workspace_invites")
    return S.lookup_few(fx.spark, path, "token", ["tok-1", "tok-17", "tok-150", "missing"])


# ---- nested results, row by row ---------------------------------------------
@register("dashboard_recent", uses=("workspaces", "content_items", "tasks"), sql=f"""
select workspace_id, rk as rank, id, title, status, updated_at from (
  select *, row_number() over (partition by workspace_id order by updated_at desc, id) as rk from content_items
  where workspace_id in (select id from workspaces))
where rk <= {E.RECENT_ITEMS_LIMIT}""")
def dashboard_recent(fx):
    """A5: the recent items inside the dashboard rows."""
    d = A.dashboard(fx.content_items, fx.tasks, fx.workspaces, AS_OF)
    x = d.select("workspace_id", F.inline("recent_items"))
    return x.withColumn("rank", F.col("rank").cast("bigint"))


@register("content_detail_nested", uses=("content_items", "comments", "users"), sql="""
select i.id, i.title, coalesce(string_agg(c.id || '|' || c.author_id || '|' || c.body || '|' || u.name || '|' || u.email, ';'
                                          order by c.created_at, c.id) filter (where u.id is not null), '') as comments
from content_items i left join comments c on c.content_item_id = i.id left join users u on u.id = c.author_id
group by i.id, i.title""")
def content_detail_nested(fx):
    """Every item with its comments nested, oldest first."""
    x = R.content_detail(fx.content_items, fx.comments, fx.users, item_ids=fx.content_items.select("id"), nested=True)
    said = F.transform("comments", lambda c: F.concat_ws("|", c["id"].cast("string"), c["author_id"].cast("string"), c["body"],
                                                         c["author_name"], c["author_email"]))
    return x.select("id", "title", F.array_join(said, ";").alias("comments"))


@register("calendar_json_items", uses=("content_items",), sql=f"""
select workspace_id, id, title, strftime(scheduled_date, '%Y-%m-%d') as scheduled_date, status, platform,
       coalesce(cast(client_id as varchar), 'none') as client
from content_items where scheduled_date >= {_MONTH_START} and scheduled_date < {_MONTH_NEXT}""")
def calendar_json_items(fx):
    """The item lines of the export, read back from their JSON text."""
    mi, dc = A.calendar(fx.content_items, MONTH, AS_OF)
    items, _ = S.calendar_json(mi, dc)

    def field(name: str, kind: str = "string"):
        return F.get_json_object("item_json", f"$.{name}").cast(kind).alias(name)

    return items.select("workspace_id", field("id", "bigint"), field("title"), field("scheduled_date"), field("status"), field("platform"),
                        F.coalesce(F.get_json_object("item_json", "$.client_id"), F.lit("none")).alias("client"))


@register("calendar_json_counts", uses=("workspaces", "content_items"), sql=f"""
select w.id as workspace_id, strftime(i.scheduled_date, '%Y-%m-%d') as day, count(*) as n
from workspaces w join content_items i on i.workspace_id = w.id
where scheduled_date >= {_MONTH_START} and scheduled_date < {_MONTH_NEXT} group by 1, 2
union all
select id, 'none', 0 from workspaces where id not in (select workspace_id from content_items
  where scheduled_date >= {_MONTH_START} and scheduled_date < {_MONTH_NEXT})""")
def calendar_json_counts(fx):
    """The day counts of every workspace, read back from their JSON text ({} for those without items)."""
    mi, dc = A.calendar(fx.content_items, MONTH, AS_OF)
    _, counts = S.calendar_json(mi, dc, fx.workspaces)
    days = F.from_json("counts_json", "map<string,bigint>")
    x = counts.join(fx.workspaces.select(F.col("id").alias("workspace_id")), "workspace_id", "left_semi")
    x = x.select("workspace_id", F.explode_outer(days).alias("day", "n"))
    return x.select("workspace_id", F.coalesce("day", F.lit("none")).alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


# ---- X14 ----------------------------------------------------------------------
def _moves(src: str) -> str:
    return " ".join(f"when '{a}' then '{','.join(b)}'" for a, b in E.TRANSITIONS.items())


@register("transition_errors", uses=("transition_requests", "content_items"), sql=f"""
with v as ({_REPLAY_SQL.replace("with recursive ", "with recursive ", 1).strip()})
select id, verdict as code, case when verdict = 'not_found' then 'content_item' else 'status' end as field, from_status, to_status,
  case verdict when 'invalid_enum' then 'invalid status: "' || to_status || '"' when 'not_found' then 'content_item not found'
       else 'cannot transition from ' || from_status || ' to ' || to_status end as message,
  case verdict when 'invalid_enum' then '{','.join(E.STATUSES)}'
       when 'invalid_transition' then case from_status {_moves('from_status')} end end as allowed
from v where verdict <> 'accepted'""")
def transition_errors(fx):
    """Every rejected status request with from, to and the statuses that would have passed."""
    v, _ = W.replay_transitions(fx.content_items, fx.transition_requests)
    v = v.filter(F.col("verdict") != "accepted")
    return v.select("id", F.col("verdict").alias("code"), "field", "from_status", "to_status",
                    X.error_message("verdict", "field", "to_status", "from_status").alias("message"),
                    F.array_join(X.error_allowed("verdict", "field", "from_status"), ",").alias("allowed"))
