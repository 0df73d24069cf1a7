"""Registered scalar functions (X1-X15), list orders (T2) and sources."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import enums as E
from ..functions import scalars as X
from ..operators import aggregates as A
from ..operators import changes as M
from ..operators import invites as I
from ..operators import reads as R
from ..sources import export as S
from ..sources.tables import conform, fill_defaults as fill
from .registry import AS_OF, MONTH, register
from .sqltext import in_list, strict_date_ok

_DATE_RE = "'[0-9]{4}-[0-9]{2}-[0-9]{2}'"


@register("strict_date", uses=("content_drafts",), sql=f"""
select id, scheduled_date, {strict_date_ok('scheduled_date')} as date_ok,
       case when scheduled_date similar to {_DATE_RE} then try_strptime(scheduled_date, '%Y-%m-%d')::date end
         as parsed_date
from content_drafts""")
def strict_date(fx):
    """Strict YYYY-MM-DD check and parse of the draft dates."""
    d = fx.content_drafts
    return d.select("id", "scheduled_date", X.strict_date_ok("scheduled_date").alias("date_ok"),
                    X.parse_strict_date("scheduled_date").alias("parsed_date"))


_MONTH_SQL = f"""
with p as (select id, month,
  case when month = '' then date_trunc('month', date '{AS_OF}')
       when month similar to '[0-9]{{4}}-[0-9]{{2}}' then try_strptime(month || '-01', '%Y-%m-%d')::date end as month_start
  from month_strings)"""


@register("month_range", uses=("month_strings",), sql=_MONTH_SQL + """
select id, month, cast(month_start as date) as month_start, cast(month_start + interval 1 month as date) as next_start,
       month_start is not null as valid from p""")
def month_range(fx):
    """YYYY-MM -> [first day, next first day); '' -> month of as_of; bad -> invalid."""
    m = fx.month_strings
    start = X.month_start("month", F.lit(AS_OF))
    return m.select("id", "month", start.alias("month_start"), X.next_month_start(start).alias("next_start"),
                    start.isNotNull().alias("valid"))


@register("shift_month", uses=("month_strings",), sql=_MONTH_SQL + """
select id, cast(month_start - interval 1 month as date) as prev_start,
       cast(month_start + interval 1 month as date) as next_start from p where month_start is not null""")
def shift_month(fx):
    """Previous and next month of every valid month, across year ends."""
    start = X.month_start("month", F.lit(AS_OF))
    m = fx.month_strings.select("id", start.alias("s")).filter(F.col("s").isNotNull())
    return m.select("id", X.shift_month("s", -1).alias("prev_start"), X.shift_month("s", 1).alias("next_start"))


@register("enum_check", uses=("content_drafts",), sql=f"""
select id, platform, platform in {in_list(E.PLATFORMS)} as platform_ok,
       content_type in {in_list(E.CONTENT_TYPES)} as content_type_ok,
       case when platform not in {in_list(E.PLATFORMS)} then '{X.allowed_text("platform")}' end as platform_allowed
from content_drafts""")
def enum_check(fx):
    """Enum membership, with the allowed list for a bad value."""
    d = fx.content_drafts
    return d.select("id", "platform", X.enum_ok("platform", "platform").alias("platform_ok"),
                    X.enum_ok("content_type", "content_type").alias("content_type_ok"),
                    F.when(~X.enum_ok("platform", "platform"), F.lit(X.allowed_text("platform")))
                    .alias("platform_allowed"))


@register("empty_to_null", uses=("content_drafts",), sql="""
select id, nullif(title, '') as title, nullif(content_type, '') as content_type,
       nullif(scheduled_date, '') as scheduled_date from content_drafts""")
def empty_to_null(fx):
    """X5: '' becomes null."""
    d = fx.content_drafts
    return d.select("id", *[X.empty_to_null(c).alias(c) for c in ("title", "content_type", "scheduled_date")])


@register("handles", uses=("clients",), sql="""
select c.id, j.key as handle_key, j.value ->> '$' as handle_value,
       case when j.key is not null then j.key || ': ' || (j.value ->> '$') end as handle_label
from clients c left join lateral (select key, value from json_each(c.social_handles)) j on true""")
def handles(fx):
    """Handles JSON -> map (null -> {}), exploded to 'key: value' labels."""
    c = fx.clients.select("id", X.handles_map("social_handles").alias("h"))
    e = c.select("id", F.explode_outer("h").alias("handle_key", "handle_value"))
    return e.withColumn("handle_label", F.concat_ws(": ", "handle_key", "handle_value")) \
        .withColumn("handle_label", F.when(F.col("handle_key").isNotNull(), F.col("handle_label")))


def _allowed_sql(col):
    cases = " ".join(f"when {col} = '{s}' then '{', '.join(d)}'" for s, d in E.TRANSITIONS.items())
    counts = " ".join(f"when {col} = '{s}' then {len(d)}" for s, d in E.TRANSITIONS.items())
    return f"case {cases} end as allowed, case {counts} end as n_allowed"


@register("allowed_transitions", uses=("content_items",), sql=f"""
select id, status, {_allowed_sql('status')} from content_items""")
def allowed_transitions(fx):
    """The next statuses of every item (archived -> none)."""
    a = X.allowed_transitions("status")
    return fx.content_items.select("id", "status", F.array_join(a, ", ").alias("allowed"),
                                   F.size(a).alias("n_allowed"))


@register("is_valid_transition", uses=("transition_requests", "content_items"), sql=f"""
select t.id, i.status as from_status, t.to_status,
       coalesce({__import__('slatework.plans.sqltext', fromlist=['x']).valid_transition('i.status', 't.to_status')}, false)
         as valid
from transition_requests t join content_items i on i.id = t.content_item_id""")
def is_valid_transition(fx):
    """Is each requested (stored status, target) an edge of the machine."""
    t = fx.transition_requests
    i = fx.content_items.select(F.col("id").alias("_iid"), F.col("status").alias("from_status"))
    j = t.join(i, t["content_item_id"] == i["_iid"])
    return j.select("id", "from_status", "to_status", X.is_valid_transition("from_status", "to_status").alias("valid"))


_INVITE_AT = "2024-01-20 00:00:00"


@register("invite_state", uses=("invites",), sql=f"""
select id, token, timestamp '{_INVITE_AT}' > expires_at as expired, use_count >= max_uses as exhausted,
       not (timestamp '{_INVITE_AT}' > expires_at) and not (use_count >= max_uses) as usable from invites""")
def invite_state(fx):
    """Expired (strictly after expires_at), exhausted, usable at one instant."""
    return I.invite_state(fx.invites, _INVITE_AT).select("id", "token", "expired", "exhausted", "usable")


@register("name_default", uses=("registrations",), sql="""
select id, coalesce(nullif(name, ''), email) as display_name,
       coalesce(nullif(name, ''), email) || '''s Workspace' as workspace_name from registrations""")
def name_default(fx):
    """Empty user name -> email; personal workspace name."""
    r = fx.registrations
    n = X.user_display_name("name", "email")
    return r.select("id", n.alias("display_name"), X.personal_workspace_name(n).alias("workspace_name"))


@register("invite_default", uses=("invite_requests",), sql=f"""
select id, cast(case when max_uses is null or max_uses <= 0 then {E.DEFAULT_INVITE_MAX_USES} else max_uses end as integer)
         as max_uses,
       requested_at + (case when expires_in_hours is null or expires_in_hours <= 0 then {E.DEFAULT_INVITE_HOURS}
                            else expires_in_hours end) * interval '1 hour' as expires_at
from invite_requests""")
def invite_default(fx):
    """X11: max_uses <= 0 -> 10, lifetime <= 0 -> 7 days."""
    r = fx.invite_requests
    return r.select("id", X.invite_max_uses("max_uses").alias("max_uses"),
                    X.invite_expires_at("requested_at", "expires_in_hours").alias("expires_at"))


def _label_sql(col, labels):
    return "case " + " ".join(f"when {col} = '{k}' then '{v}'" for k, v in labels.items()) + " end"


@register("labels", uses=("content_items",), sql=f"""
select id, {_label_sql('status', E.DASHBOARD_STATUS_LABELS)} as status_label,
       {_label_sql('status', E.CALENDAR_STATUS_LABELS)} as calendar_status_label,
       {_label_sql('platform', E.PLATFORM_LABELS)} as platform_label,
       upper(substr(status, 1, 1)) || substr(status, 2) as status_capitalised from content_items""")
def labels(fx):
    """Display labels of statuses and platforms."""
    c = fx.content_items
    return c.select("id", X.label_of("status", E.DASHBOARD_STATUS_LABELS).alias("status_label"),
                    X.label_of("status", E.CALENDAR_STATUS_LABELS).alias("calendar_status_label"),
                    X.label_of("platform", E.PLATFORM_LABELS).alias("platform_label"),
                    X.capitalised("status").alias("status_capitalised"))


@register("date_text", uses=("content_items",), sql="""
select id, strftime(scheduled_date, '%Y-%m-%d') as scheduled_text from content_items""")
def date_text(fx):
    """Date -> YYYY-MM-DD text (null stays null)."""
    return fx.content_items.select("id", X.date_text("scheduled_date").alias("scheduled_text"))


@register("author_label", uses=("comments", "users"), sql="""
select c.id, coalesce(nullif(u.name, ''), nullif(u.email, ''), cast(c.author_id as varchar)) as author_label
from comments c left join users u on u.id = c.author_id""")
def author_label(fx):
    """Author name, else email, else id."""
    c, u = fx.comments, fx.users.select(F.col("id").alias("_uid"), "name", "email")
    j = c.join(u, c["author_id"] == u["_uid"], "left")
    return j.select("id", X.author_label("name", "email", "author_id").alias("author_label"))


@register("error_record", uses=("content_drafts", "clients"), sql=f"""
with v as (select d.*, case when d.title is null or d.title = '' then 'required'
      when d.platform not in {in_list(E.PLATFORMS)} then 'invalid_enum'
      when d.content_type is null or d.content_type not in {in_list(E.CONTENT_TYPES)} then 'invalid_enum'
      when not {strict_date_ok('d.scheduled_date')} then 'invalid_format'
      when not (d.client_id is null or c.id is not null) then 'invalid_reference' end as code,
      case when d.title is null or d.title = '' then 'title'
      when d.platform not in {in_list(E.PLATFORMS)} then 'platform'
      when d.content_type is null or d.content_type not in {in_list(E.CONTENT_TYPES)} then 'content_type'
      when not {strict_date_ok('d.scheduled_date')} then 'scheduled_date'
      when not (d.client_id is null or c.id is not null) then 'client_id' end as field
  from content_drafts d left join (select distinct id, workspace_id from clients where deleted_at is null) c
    on c.id = d.client_id and c.workspace_id = d.workspace_id)
select id, code, field,
  case code when 'required' then field || ' is required'
            when 'invalid_enum' then 'invalid ' || field || ': "' || (case field when 'platform' then platform else content_type end) || '"'
            when 'invalid_format' then 'invalid ' || field || ': "' || scheduled_date || '" (expected YYYY-MM-DD)'
            when 'invalid_reference' then 'invalid ' || field || ': does not belong to this workspace' end as message,
  case when code = 'invalid_enum' then case field when 'platform' then 'instagram,facebook,twitter,linkedin,tiktok,youtube,other'
                                                  else 'post,story,reel,video,carousel,other' end end as allowed,
  case when code = 'invalid_format' then 'YYYY-MM-DD' end as expected
from v where code is not null""")
def error_record(fx):
    """Code, field, message and what would have passed, for every rejected draft."""
    v, _ = M.create_content(fx.content_drafts, fx.clients, AS_OF)
    v = v.filter(F.col("verdict") != "accepted")
    value = (F.when(F.col("field") == "platform", F.col("platform"))
             .when(F.col("field") == "content_type", F.col("content_type"))
             .when(F.col("field") == "scheduled_date", F.col("scheduled_date")))
    return v.select("id", F.col("verdict").alias("code"), "field",
                    X.error_message("verdict", "field", value).alias("message"),
                    F.array_join(X.error_allowed("verdict", "field"), ",").alias("allowed"),
                    X.error_expected("verdict").alias("expected"))


@register("ordered", uses=("tasks",), sql="""
select id, workspace_id, row_number() over (partition by workspace_id
                                            order by due_date asc nulls last, created_at desc, id) as position
from tasks""")
def ordered(fx):
    """Position of every task in its workspace's list order."""
    return R.ordered(fx.tasks.select("id", "workspace_id", "due_date", "created_at"), "tasks").select(
        "id", "workspace_id", "position")


@register("tables", uses=("content_items",), sql="""
select id, workspace_id, client_id, title, '' as description, platform, content_type, status, scheduled_date,
       created_by, created_at, updated_at from content_items""")
def tables(fx):
    """A table read onto its declared schema (content items, bigint ids)."""
    return conform(fx.content_items, "content_items", T.LongType())


@register("tables_all", uses=("full_users", "full_workspaces", "full_memberships", "full_invites", "full_clients", "full_content_items",
                              "full_comments", "full_tasks"), sql="""
select 'users' as table_name, cast(id as varchar) as row_key, email as a, coalesce(name, '') as b from full_users
union all select 'workspaces', cast(id as varchar), name, cast(deleted_at is null as varchar) from full_workspaces
union all select 'memberships', workspace_id || ',' || user_id, role, cast(joined_at is null as varchar) from full_memberships
union all select 'workspace_invites', cast(id as varchar), token, cast(max_uses as varchar) from full_invites
union all select 'clients', cast(id as varchar), coalesce(notes, ''), coalesce(json_extract_string(social_handles, '$.instagram'), 'none') from full_clients
union all select 'content_items', cast(id as varchar), coalesce(description, ''), platform from full_content_items
union all select 'comments', cast(id as varchar), body, cast(author_id as varchar) from full_comments
union all select 'tasks', id, title, cast(coalesce(done, false) as varchar) from full_tasks""")
def tables_all(fx):
    """All eight tables read onto their declared schemas with their defaults."""
    from functools import reduce
    shown = {"users": ("email", "name"), "workspaces": ("name", F.col("deleted_at").isNull()), "memberships": ("role", F.col("joined_at").isNull()),
             "workspace_invites": ("token", "max_uses"), "clients": ("notes", F.coalesce(F.col("social_handles")["instagram"], F.lit("none"))),
             "content_items": ("description", "platform"), "comments": ("body", "author_id"), "tasks": ("title", "done")}
    parts = []
    for name, (a, b) in shown.items():
        ids = T.StringType() if name == "tasks" else T.LongType()  # the test tasks have text ids
        t = conform(fx[f"full_{name.replace("workspace_invites", "invites")}"], name, ids)
        key = ["workspace_id", "user_id"] if name == "memberships" else ["id"]
        parts.append((name, t, key, a, b))
    return reduce(lambda x, y: x.unionByName(y), [t.select(
        F.lit(n).alias("table_name"), F.concat_ws(",", *[F.col(k).cast("string") for k in key]).alias("row_key"),
        (F.col(a) if isinstance(a, str) else a).cast("string").alias("a"), (F.col(b) if isinstance(b, str) else b).cast("string").alias("b"))
        for n, t, key, a, b in parts])


@register("fill_defaults", uses=("clients",), sql="""
select id, coalesce(notes, '') as notes, active, coalesce(json_extract_string(social_handles, '$.instagram'), '') as instagram
from (select *, null as notes from clients)""")
def fill_defaults(fx):
    """Column defaults on ingest (notes '', handles {})."""
    c = conform(fx.clients, "clients", T.LongType())
    c = fill(c, "clients")
    return c.select("id", "notes", "active",
                    F.coalesce(F.col("social_handles")["instagram"], F.lit("")).alias("instagram"))


@register("write_snapshot", uses=("content_items",), sql="""
select id, workspace_id, status from content_items""")
def write_snapshot(fx):
    """S3: write the items as a new partitioned snapshot version, read it back."""
    root = S.shared_root(fx.spark) + "/snapshots"
    path = S.write_snapshot(fx.content_items.select("id", "workspace_id", "status"), root, "content_items")
    return fx.spark.read.parquet(path).select("id", F.col("workspace_id").cast("bigint").alias("workspace_id"),
                                              "status")


@register("calendar_json", uses=("content_items",), sql=f"""
with m as (select * from content_items where scheduled_date >= date '{MONTH}-01'
           and scheduled_date < date '{MONTH}-01' + interval 1 month)
select workspace_id, count(*) as n_items, count(distinct scheduled_date) as n_days, count(*) as n_counted from m group by 1""")
def calendar_json(fx):
    """The calendar export (item JSON lines, day-count map per
    workspace), checked through the sizes of both parts."""
    mi, dc = A.calendar(fx.content_items, MONTH, AS_OF)
    items, counts = S.calendar_json(mi, dc)
    n = items.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n_items"))
    d = counts.select("workspace_id", F.size("counts_by_day").cast("bigint").alias("n_days"),
                      F.aggregate(F.map_values("counts_by_day"), F.lit(0).cast("bigint"),
                                  lambda a, x: a + x).alias("n_counted"))
    # the counts of the map must add up to the item lines of the workspace
    return n.join(d, "workspace_id", "full").select("workspace_id", "n_items", "n_days", "n_counted")
