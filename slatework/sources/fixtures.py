"""Test inputs derived from the driver's parquet tables.

Each derivation only maps columns of the given tables onto the schema an
operator expects; none of them does any of an operator's work. The same
texts run in Spark (``{TS}`` = timestamp_ntz) and in DuckDB for the oracle
(``{TS}`` = timestamp), so the oracle sees exactly the same inputs.

The first twelve bodies are the ones of FIXTURES.md section 2; the request
tables after them are further derivations in the same style (section 4 of
FIXTURES.md).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
]

AS_OF_DATE = "1999-01-01"

FIXTURE_SQL: dict[str, str] = {
    "workspaces": """
select cast(n_nationkey as bigint) as id, n_name as name,
       case when n_nationkey % 12 = 11 then cast('2001-01-01' as {TS}) end as deleted_at
from {nation}""",
    "users": """
select s_suppkey as id, concat(lower(s_name), '@example.test') as email, s_name as name from {supplier}""",
    "memberships": """
select cast(s_nationkey as bigint) as workspace_id, s_suppkey as user_id,
       case s_suppkey % 3 when 0 then 'admin' when 1 then 'cm' else 'viewer' end as role,
       cast('1995-01-01' as {TS}) + (s_suppkey % 300) * interval '1' day as joined_at
from {supplier}
union all
select cast((s_nationkey + 1) % 25 as bigint) as workspace_id, s_suppkey as user_id, 'viewer' as role,
       cast('1996-01-01' as {TS}) + (s_suppkey % 300) * interval '1' day as joined_at
from {supplier} where s_suppkey % 2 = 0""",
    "clients": """
select c_custkey as id, cast(c_nationkey as bigint) as workspace_id,
       case when c_custkey % 2 = 0 then lower(concat(c_mktsegment, ' ', cast(c_custkey % 40 as string)))
            else concat(c_mktsegment, ' ', cast(c_custkey % 40 as string)) end as name,
       case when c_custkey % 5 = 0 then null else concat('{{"instagram":"@c', cast(c_custkey as string), '"}}') end as social_handles,
       c_acctbal >= 0 as active,
       case when c_custkey % 10 = 9 then cast('2001-01-01' as {TS}) end as deleted_at
from {customer}""",
    "content_items": """
select o_orderkey as id, cast(c_nationkey as bigint) as workspace_id,
       case when o_orderkey % 13 = 0 then null when o_orderkey % 17 = 0 then o_custkey + 1 else o_custkey end as client_id,
       concat('Item ', cast(o_orderkey as string)) as title,
       case o_orderkey % 7 when 0 then 'instagram' when 1 then 'facebook' when 2 then 'twitter' when 3 then 'linkedin'
            when 4 then 'tiktok' when 5 then 'youtube' else 'other' end as platform,
       case o_orderkey % 6 when 0 then 'post' when 1 then 'story' when 2 then 'reel' when 3 then 'video'
            when 4 then 'carousel' else 'other' end as content_type,
       case o_orderkey % 5 when 0 then 'draft' when 1 then 'review' when 2 then 'approved' when 3 then 'published'
            else 'archived' end as status,
       case when o_orderkey % 11 = 0 then null else cast(o_orderdate as date) end as scheduled_date,
       o_orderkey % 10 as created_by,
       o_orderdate - interval '7' day as created_at,
       o_orderdate + (o_orderkey % 90) * interval '1' day as updated_at
from {orders} join {customer} on c_custkey = o_custkey""",
    "tasks": """
select concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-',
              cast(l_suppkey as string), '-', cast(cast(l_shipdate as date) as string), '-',
              cast(cast(round(l_extendedprice * 100) as bigint) as string)) as id,
       cast(c_nationkey as bigint) as workspace_id,
       case when l_linenumber = 1 then null else l_suppkey end as assignee_id,
       case when l_returnflag = 'N' then null else cast(l_shipdate as date) end as due_date,
       l_linestatus = 'F' as done,
       case when l_partkey % 5 = 0 then null else l_orderkey end as content_item_id,
       o_custkey as client_id, o_orderdate as created_at
from {lineitem} join {orders} on o_orderkey = l_orderkey join {customer} on c_custkey = o_custkey""",
    "comments": """
select event_id as id, cast(floor(event_id / 3.0) as bigint) as content_item_id, user_id as author_id,
       event_type as body, ts as created_at
from {events}""",
    "invites": """
select p_partkey as id, p_partkey % 25 as workspace_id, concat('tok-', cast(p_partkey as string)) as token,
       cast(1 + p_size % 5 as int) as max_uses, cast(least(p_partkey % 3, 1 + p_size % 5) as int) as use_count,
       cast('2024-01-01' as {TS}) + (p_partkey % 40) * interval '1' day as expires_at
from {part}""",
    "claims": """
select event_id as id,
       case when event_id % 50 = 0 then 'missing' else concat('tok-', cast(event_id % 200 as string)) end as token,
       user_id, ts as claimed_at
from {events} where event_type = 'signup'""",
    "transition_requests": """
select event_id as id, user_id as content_item_id,
       case when event_id % 97 = 0 then 'deleted' when event_type = 'view' then 'review'
            when event_type = 'click' then 'approved' when event_type = 'purchase' then 'published'
            when event_type = 'signup' then 'draft' else 'archived' end as to_status,
       ts as requested_at
from {events}""",
    "access_requests": """
select event_id as id, user_id, case when event_id % 40 = 0 then null else event_id % 25 end as workspace_id,
       case when event_type in ('view', 'error') then 'read' else 'write' end as action, ts as requested_at
from {events}""",
    "content_drafts": """
select o_orderkey as id, cast(c_nationkey as bigint) as workspace_id, o_custkey + (o_orderkey % 3) as client_id,
       case when o_orderkey % 19 = 0 then '' else concat('Draft ', cast(o_orderkey as string)) end as title,
       case when o_orderkey % 23 = 0 then 'myspace' else 'instagram' end as platform,
       case when o_orderkey % 29 = 0 then '' else 'post' end as content_type,
       case o_orderkey % 10 when 0 then null when 1 then '' when 2 then '2026-02-30' when 3 then '2026-6-5'
            when 4 then '2026/06/15' when 5 then '2026-06-15T00:00:00Z' when 6 then '2026-13-01'
            when 7 then '2028-02-29' else '2026-06-15' end as scheduled_date,
       o_orderkey % 10 as created_by
from {orders} join {customer} on c_custkey = o_custkey""",
    # ---- request tables beyond FIXTURES.md section 2 (see its section 4) ----
    "content_updates": """
select concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string), '-', cast(cast(l_shipdate as date) as string), '-', cast(cast(round(l_extendedprice * 100) as bigint) as string)) as id, cast(c_nationkey as bigint) as workspace_id,
       case when l_linenumber = 7 then l_orderkey + 1 else l_orderkey end as content_item_id,
       case when l_partkey % 19 = 0 then '' else concat('Edit ', cast(l_orderkey as string), '/', cast(l_linenumber as string)) end as title,
       'edited' as description,
       case when l_partkey % 23 = 0 then 'myspace' when l_linenumber % 2 = 0 then 'linkedin' else 'youtube' end as platform,
       case when l_partkey % 29 = 0 then 'gif' else 'video' end as content_type,
       case when l_suppkey % 4 = 0 then null when l_suppkey % 4 = 1 then o_custkey + 1 else o_custkey end as client_id,
       case l_partkey % 6 when 0 then null when 1 then '' when 2 then '2026-02-30' else '2026-07-01' end as scheduled_date,
       l_shipdate as requested_at
from {lineitem} join {orders} on o_orderkey = l_orderkey join {customer} on c_custkey = o_custkey""",
    "task_requests": """
select concat('req-', concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string), '-', cast(cast(l_shipdate as date) as string), '-', cast(cast(round(l_extendedprice * 100) as bigint) as string))) as id, cast(c_nationkey as bigint) as workspace_id,
       case when l_linenumber <= 2 then 'create' when l_linenumber <= 5 then 'update' else 'toggle' end as kind,
       case when l_linenumber <= 2 then null
            when l_partkey % 13 = 0 then concat('missing-', cast(l_orderkey as string))
            else concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-',
                        cast(l_suppkey as string), '-', cast(cast(l_shipdate as date) as string), '-',
                        cast(cast(round(l_extendedprice * 100) as bigint) as string)) end as task_key,
       case when l_partkey % 17 = 0 then '' else concat('Task ', cast(l_orderkey as string)) end as title,
       'from request' as description,
       case when l_linenumber % 3 = 0 then null else l_suppkey end as assignee_id,
       case l_partkey % 7 when 0 then null when 1 then '' when 2 then '2026-6-5' else cast(cast(l_shipdate as date) as string) end as due_date,
       l_returnflag = 'R' as done,
       case when l_partkey % 4 = 0 then null when l_partkey % 4 = 1 then l_orderkey + 1 else l_orderkey end as content_item_id,
       case when l_suppkey % 5 = 0 then null else o_custkey end as client_id,
       l_shipdate as requested_at
from {lineitem} join {orders} on o_orderkey = l_orderkey join {customer} on c_custkey = o_custkey""",
    "member_requests": """
select e.event_id as id, case when e.event_type in ('view', 'click') then 'change_role' else 'remove' end as kind,
       a.s_suppkey as actor_id,
       case when e.event_id % 7 = 0 then cast((a.s_nationkey + 1) % 25 as bigint) else cast(a.s_nationkey as bigint) end
         as workspace_id,
       case when e.event_id % 13 = 0 then a.s_suppkey else t.s_suppkey end as target_user_id,
       case e.event_id % 4 when 0 then 'admin' when 1 then 'cm' when 2 then 'viewer' else 'owner' end as role,
       e.ts as requested_at
from {events} e join {supplier} a on a.s_suppkey = e.event_id % 10
join {supplier} t on t.s_suppkey = (e.user_id * 7 + e.event_id) % 10""",
    "membership_upserts": """
select p_partkey as id, p_partkey % 25 as workspace_id, (p_partkey % 60) + 1 as user_id,
       case p_size % 3 when 0 then 'admin' when 1 then 'cm' else 'viewer' end as role,
       cast('2024-02-01' as {TS}) + (p_partkey % 500) * interval '1' minute as requested_at
from {part}""",
    "client_requests": """
select o_orderkey as id, cast(c_nationkey as bigint) as workspace_id,
       case when o_orderkey % 4 = 0 then 'update' else 'create' end as kind,
       case when o_orderkey % 4 = 0 then o_custkey else null end as client_id,
       case when o_orderkey % 43 = 0 then '' else concat(upper(c_mktsegment), ' ', cast(o_orderkey % 40 as string)) end as name,
       case o_orderkey % 5 when 0 then null when 1 then 'null' when 2 then '[1,2]'
            else concat('{{"tiktok":"@o', cast(o_orderkey as string), '"}}') end as social_handles,
       concat('note ', o_orderpriority) as notes, o_orderstatus <> 'F' as active,
       o_orderdate + interval '30' day as requested_at
from {orders} join {customer} on c_custkey = o_custkey""",
    "delete_requests": """
select concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string), '-', cast(cast(l_shipdate as date) as string), '-', cast(cast(round(l_extendedprice * 100) as bigint) as string)) as id,
       case when l_partkey % 9 = 0 then (c_nationkey + 3) % 25 else cast(c_nationkey as bigint) end as workspace_id,
       case when l_linenumber <= 3 then 'client' else 'task' end as target,
       case when l_linenumber <= 3 then cast(o_custkey as string)
            else concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-',
                        cast(l_suppkey as string), '-', cast(cast(l_shipdate as date) as string), '-',
                        cast(cast(round(l_extendedprice * 100) as bigint) as string)) end as target_id,
       l_suppkey as actor_id, l_shipdate as requested_at
from {lineitem} join {orders} on o_orderkey = l_orderkey join {customer} on c_custkey = o_custkey""",
    "comment_deletes": """
select e.event_id * 2 + 1 as id,
       case when e.event_id % 4 = 0 then (c_nationkey + 1) % 25 else cast(c_nationkey as bigint) end as workspace_id,
       e.event_id as comment_id,
       case when e.event_id % 5 = 0 then e.user_id + 1 else e.user_id end as author_id,
       e.ts as requested_at
from {events} e left join {orders} on o_orderkey = cast(floor(e.event_id / 3.0) as bigint)
left join {customer} on c_custkey = o_custkey""",
    "workspace_deletes": """
select s_suppkey as id, s_suppkey as actor_id, cast(s_nationkey as bigint) as workspace_id,
       cast('2024-06-01' as {TS}) + (s_suppkey % 500) * interval '1' minute as requested_at
from {supplier}""",
    "month_strings": """
select o_orderkey as id,
       case o_orderkey % 9 when 0 then '' when 1 then concat(cast(year(o_orderdate) as string), '-', cast(month(o_orderdate) as string))
            when 2 then concat(cast(year(o_orderdate) as string), '-13') when 3 then 'not-a-month'
            when 4 then concat(cast(year(o_orderdate) as string), '-12')
            else substr(cast(cast(o_orderdate as date) as string), 1, 7) end as month
from {orders}""",
    "registrations": """
select c_custkey as id,
       case when c_custkey % 9 = 0 and s_name is not null then concat(lower(s_name), '@example.test')
            when c_custkey % 7 = 0 then ''
            else concat(lower(c_name), '@example.test') end as email,
       case when c_custkey % 3 = 0 then '' else c_name end as name,
       cast(c_custkey + 1000000 as bigint) as new_user_id, cast(c_custkey + 2000000 as bigint) as new_workspace_id,
       cast('2024-03-01' as {TS}) + (c_custkey % 1000) * interval '1' second as requested_at
from {customer} left join {supplier} on s_suppkey = (c_custkey % 13) + 1""",
    "workspace_requests": """
select p_partkey as id, case when p_partkey % 3 = 0 then 'create' else 'rename' end as kind,
       (p_partkey % 40) + 1 as actor_id,
       case when p_partkey % 3 = 0 then p_partkey + 5000000 else p_partkey % 25 end as workspace_id,
       case when p_partkey % 11 = 0 then '' else concat(p_brand, ' ', p_type) end as name,
       cast('2024-04-01' as {TS}) + (p_partkey % 777) * interval '1' minute as requested_at
from {part}""",
    "comment_requests": """
select event_id as id, event_id % 25 as workspace_id, (event_id * 7) % 60000 as content_item_id, user_id as author_id,
       case when event_type = 'error' then '' when event_type = 'view' then ' ' else concat('re: ', coalesce(props, '')) end as body,
       ts as requested_at
from {events}""",
    "invite_requests": """
select p_partkey as id, (p_partkey % 40) + 1 as actor_id, p_partkey % 25 as workspace_id,
       case when p_partkey % 9 = 0 then concat('tok-', cast(p_partkey as string))
            else concat('new-', cast(cast(floor(p_partkey / 2.0) as bigint) as string)) end as token,
       cast(p_size % 4 - 1 as int) as max_uses, cast(p_size % 5 * 24 - 24 as int) as expires_in_hours,
       cast('2024-05-01' as {TS}) + (p_partkey % 97) * interval '1' hour as requested_at
from {part}""",
}

# The entity tables with all columns of the data model, for the audits; some
# values are null and some references point nowhere (FIXTURES.md section 5).
_STAMP = "cast('1995-01-01' as {TS}) + (x.id % 300) * interval '1' day"
_FULL = {
    "users": f"x.*, case when x.id % 4 = 0 then null else {_STAMP} end as created_at, {_STAMP} as updated_at",
    "workspaces": f"x.*, {_STAMP} as created_at, case when x.id % 7 = 3 then null else {_STAMP} end as updated_at",
    "memberships": "x.workspace_id, x.user_id, x.role, case when x.user_id % 5 = 0 then null else x.joined_at end as joined_at",
    "invites": f"x.*, case when x.id % 17 = 0 then 900000 + x.id when x.id % 19 = 0 then null else x.id % 10 + 1 end as created_by, {_STAMP} as created_at",
    "clients": f"x.*, case when x.id % 8 = 0 then null else 'noted' end as notes, {_STAMP} as created_at, {_STAMP} as updated_at",
    "content_items": "x.*, case when x.id % 9 = 0 then null else 'described' end as description",
    "comments": "x.*",
    "tasks": "x.*, case when length(x.id) % 11 = 0 then null else 'Task' end as title, '' as description, x.created_at as updated_at",
}
FIXTURE_SQL |= {f"full_{t}": f"\nselect {cols} from ({FIXTURE_SQL[t].strip()}) x" for t, cols in _FULL.items()}

FIXTURE_NAMES = list(FIXTURE_SQL)

# The joins of line items to customers as Spark runs them for these fixtures: orders meet their
# customers first, so the line items, four times as many and wider, are shuffled once.
_SHUFFLED_ONCE = ("tasks", "full_tasks", "task_requests", "delete_requests")
_BY_ORDER = "from {lineitem} join {orders} on o_orderkey = l_orderkey join {customer} on c_custkey = o_custkey"
_BY_ORDER_NARROW = "from {lineitem} join (select * from {orders} join {customer} on c_custkey = o_custkey) on o_orderkey = l_orderkey"

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def _tables_used(body: str) -> list[str]:
    return sorted({m for m in _PLACEHOLDER.findall(body) if m in BASE_TABLES})


def duckdb_body(name: str) -> str:
    body = FIXTURE_SQL[name]
    return body.format(TS="timestamp", **{t: t for t in BASE_TABLES}).strip()


def oracle_with(*names: str) -> str:
    """``WITH`` clause that defines the named fixtures for DuckDB."""
    parts = [f"{n} AS ({duckdb_body(n)})" for n in names]
    return "WITH " + ",\n".join(parts)


class Fixtures:
    """Lazily derived fixture DataFrames over ``sf_dir``.

    Only plans are built here; no action runs. Base tables are plain
    parquet reads, so filters and projections of the operators above push
    into the scans.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, stored: dict[str, str] | None = None):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}
        # fixture name -> path of a stored Parquet copy (read instead of deriving)
        self.stored = dict(stored or {})

    def store(self, root: str, names) -> dict[str, str]:
        """Write the named fixtures once as Parquet under ``root`` (a fresh
        folder) so later reads are plain table scans, as in production."""
        for name in names:
            if name in FIXTURE_SQL and name not in self.stored:
                path = f"{root.rstrip('/')}/{name}"
                self[name].write.mode("errorifexists").parquet(path)
                self.stored[name] = path
                self._cache.pop(f"fx:{name}", None)
        return self.stored

    def base(self, table: str) -> DataFrame:
        if table not in self._cache:
            self._cache[table] = self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")
        return self._cache[table]

    def __getitem__(self, name: str) -> DataFrame:
        key = f"fx:{name}"
        if key not in self._cache and name in self.stored:
            self._cache[key] = self.spark.read.parquet(self.stored[name])
        if key not in self._cache:
            body = FIXTURE_SQL[name]
            frames = {t: self.base(t) for t in _tables_used(body)}
            if name in _SHUFFLED_ONCE:
                body = body.replace(_BY_ORDER, _BY_ORDER_NARROW)
            body = body.replace("{TS}", "timestamp_ntz").strip()
            self._cache[key] = self.spark.sql(body, **frames)
        return self._cache[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name in FIXTURE_SQL:
            return self[name]
        raise AttributeError(name)
