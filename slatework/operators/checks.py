"""Reference guards, access decisions and whole-table audits: J6-J8, J10, Q1-Q6.

Guards never multiply rows: the parent side is reduced to distinct keys
with an aggregate on exactly the join keys, so the aggregate's output
partitioning is reused by the join (no extra shuffle), and a null
reference is valid without touching the parent table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import enums as E
from ..session import stored
from ..sources.schemas import TABLE_NAMES
from . import reads as R


def _exists_flag(rows: DataFrame, parent: DataFrame, pairs: list[tuple[str, str]], flag: str) -> DataFrame:
    """Left join ``rows`` with the distinct keys of ``parent`` and add a
    boolean ``flag``: a parent row matches on all (row col, parent col)."""
    pk = [f"_{flag}_{i}" for i in range(len(pairs))]
    keys = parent.select(*[F.col(p).alias(k) for (_, p), k in zip(pairs, pk)]).groupBy(*pk).agg(
        F.lit(True).alias(flag))
    cond = reduce(lambda a, b: a & b, [F.col(r) == F.col(k) for (r, _), k in zip(pairs, pk)])
    out = rows.join(keys, cond, "left").drop(*pk)
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def client_ok(rows: DataFrame, clients: DataFrame, col: str = "client_id", ws: str = "workspace_id",
              flag: str = "client_ok") -> DataFrame:
    """Reference is null or a live client of the same workspace."""
    live = R.live_rows(clients)
    out = _exists_flag(rows, live, [(col, "id"), (ws, "workspace_id")], "_c")
    return out.withColumn(flag, F.col(col).isNull() | F.col("_c")).drop("_c")


def content_item_ok(rows: DataFrame, items: DataFrame, col: str = "content_item_id", ws: str = "workspace_id",
                    flag: str = "content_item_ok") -> DataFrame:
    out = _exists_flag(rows, items, [(col, "id"), (ws, "workspace_id")], "_i")
    return out.withColumn(flag, F.col(col).isNull() | F.col("_i")).drop("_i")


def assignee_ok(rows: DataFrame, memberships: DataFrame, col: str = "assignee_id", ws: str = "workspace_id",
                flag: str = "assignee_ok") -> DataFrame:
    out = _exists_flag(rows, memberships, [(col, "user_id"), (ws, "workspace_id")], "_m")
    return out.withColumn(flag, F.col(col).isNull() | F.col("_m")).drop("_m")


# J6 ------------------------------------------------------------------------
def content_ref_check(rows: DataFrame, clients: DataFrame) -> DataFrame:
    """Adds ``client_ok`` and ``bad_field`` ('client_id' or null)."""
    out = client_ok(rows, clients)
    return out.withColumn("bad_field", F.when(~F.col("client_ok"), F.lit("client_id")))


# J7 ------------------------------------------------------------------------
def task_ref_check(rows: DataFrame, clients: DataFrame, items: DataFrame, memberships: DataFrame,
                   client_col: str = "client_id", item_col: str = "content_item_id",
                   assignee_col: str = "assignee_id") -> DataFrame:
    """Adds the three flags and ``bad_field``: the first failing reference
    in the order client_id, content_item_id, assignee_id. The reference
    columns may be named differently in ``rows``."""
    out = assignee_ok(content_item_ok(client_ok(rows, clients, col=client_col), items, col=item_col),
                      memberships, col=assignee_col)
    return out.withColumn("bad_field",
                          F.when(~F.col("client_ok"), F.lit("client_id"))
                          .when(~F.col("content_item_ok"), F.lit("content_item_id"))
                          .when(~F.col("assignee_ok"), F.lit("assignee_id")))


# J8 ------------------------------------------------------------------------
def deletable_comments(requests: DataFrame, comments: DataFrame, items: DataFrame) -> DataFrame:
    """Comment delete requests (id, workspace_id, comment_id, author_id):
    'accepted' when the comment exists, was written by that author and its
    item is in that workspace; otherwise 'not_found' (all look the same)."""
    owned = (comments.select(F.col("id").alias("cid"), F.col("author_id").alias("aid"), "content_item_id")
             .join(items.select(F.col("id").alias("content_item_id"), F.col("workspace_id").alias("wid")),
                   "content_item_id"))
    out = _exists_flag(requests, owned, [("comment_id", "cid"), ("author_id", "aid"), ("workspace_id", "wid")],
                       "_ok")
    return out.withColumn("verdict", F.when(F.col("_ok"), "accepted").otherwise("not_found")).drop("_ok")


# J10 -----------------------------------------------------------------------
WRITE_ROLES = ["cm", "admin"]


def access_check(requests: DataFrame, memberships: DataFrame) -> DataFrame:
    """Per request (user_id, workspace_id, action 'read'/'write'):
    no_workspace -> not_found (not a member) -> forbidden (write without
    cm/admin) -> ok, in that order. The role is read fresh from memberships."""
    m = memberships.select(F.col("workspace_id").alias("_w"), F.col("user_id").alias("_u"), F.col("role").alias("_role"))
    j = requests.join(m, (F.col("workspace_id") == F.col("_w")) & (F.col("user_id") == F.col("_u")), "left")
    verdict = (F.when(F.col("workspace_id").isNull(), F.lit("no_workspace"))
               .when(F.col("_w").isNull(), F.lit("not_found"))
               .when((F.col("action") == "write") & ~F.col("_role").isin(*WRITE_ROLES), F.lit("forbidden"))
               .otherwise(F.lit("ok")))
    return j.select(*requests.columns, F.col("_role").alias("role"), verdict.alias("verdict"))


# Q1 ------------------------------------------------------------------------
def dup_clients(clients: DataFrame) -> DataFrame:
    """Live clients sharing (workspace, lower(name)): one row per clash."""
    return (R.live_rows(clients).groupBy("workspace_id", F.lower("name").alias("name_key"))
            .agg(F.count(F.lit(1)).alias("clients"), F.min("id").alias("first_id"))
            .filter(F.col("clients") > 1))


def require(tables: dict[str, DataFrame], names: set[str]) -> None:
    """Raise unless ``tables`` (named as ``read_tables`` names them) holds exactly known names
    and all of ``names``: an audit never skips a table in silence."""
    unknown = set(tables) - set(TABLE_NAMES)
    missing = names - set(tables)
    if unknown or missing:
        raise KeyError(f"tables missing: {sorted(missing)}, unknown: {sorted(unknown)}")


# Q2 ------------------------------------------------------------------------
def dup_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Keys that occur more than once: primary keys, emails, tokens and
    (workspace, user) memberships. Rows: table, key, value, occurrences.

    All key columns are stacked into one (table, key, value) frame and
    counted by a single aggregation: one shuffle for all checks, with
    map-side partial counts.
    """
    specs = [("users", "id", [F.col("id")]), ("users", "email", [F.col("email")]),
             ("workspaces", "id", [F.col("id")]), ("clients", "id", [F.col("id")]),
             ("content_items", "id", [F.col("id")]), ("comments", "id", [F.col("id")]),
             ("tasks", "id", [F.col("id")]), ("workspace_invites", "id", [F.col("id")]),
             ("workspace_invites", "token", [F.col("token")]),
             ("memberships", "workspace_id,user_id", [F.col("workspace_id"), F.col("user_id")])]
    require(tables, {t for t, _, _ in specs})
    parts = []
    for table, key, cols in specs:
        value = F.concat_ws(",", *[c.cast("string") for c in cols])
        parts.append(tables[table].select(F.lit(table).alias("table_name"), F.lit(key).alias("key_name"),
                                          value.alias("value")))
    stacked = reduce(DataFrame.unionByName, parts)
    return (stacked.groupBy("table_name", "key_name", "value").agg(F.count(F.lit(1)).alias("occurrences"))
            .filter(F.col("occurrences") > 1))


# Q3 ------------------------------------------------------------------------
def bad_enums(specs: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Values outside their enum. ``specs``: (frame, table name, column,
    enum name). Rows: table, column, bad value, occurrences. The bad values
    of all specs are stacked and counted by one aggregation."""
    parts = []
    for df, table, col, field in specs:
        parts.append(df.filter(~F.col(col).isin(*E.ENUMS[field]) | F.col(col).isNull())
                     .select(F.lit(table).alias("table_name"), F.lit(col).alias("column_name"),
                             F.col(col).cast("string").alias("value")))
    stacked = reduce(DataFrame.unionByName, parts)
    return stacked.groupBy("table_name", "column_name", "value").agg(F.count(F.lit(1)).alias("occurrences"))


# Q4 ------------------------------------------------------------------------
# child table -> (its row key, {reference column: (parent table, rule when the parent goes)}); a
# reference holds the parent's id. 'cascade': the child goes too; 'null': the reference is
# cleared; 'restrict': the parent stays as long as the child does.
FOREIGN_KEYS: dict[str, tuple[tuple[str, ...], dict[str, tuple[str, str]]]] = {
    "memberships": (("workspace_id", "user_id"), {"workspace_id": ("workspaces", "cascade"), "user_id": ("users", "cascade")}),
    "workspace_invites": (("id",), {"workspace_id": ("workspaces", "cascade"), "created_by": ("users", "cascade")}),
    "clients": (("id",), {"workspace_id": ("workspaces", "cascade")}),
    "content_items": (("id",), {"workspace_id": ("workspaces", "cascade"), "client_id": ("clients", "null"),
                                "created_by": ("users", "restrict")}),
    "comments": (("id",), {"content_item_id": ("content_items", "cascade"), "author_id": ("users", "restrict")}),
    "tasks": (("id",), {"workspace_id": ("workspaces", "cascade"), "assignee_id": ("users", "null"),
                        "content_item_id": ("content_items", "null"), "client_id": ("clients", "null")}),
}


def require_columns(tables: dict[str, DataFrame], columns: dict[str, set[str]]) -> None:
    """Raise unless every table has the columns named: an audit never skips one in silence."""
    missing = {t: sorted(cols - set(tables[t].columns)) for t, cols in columns.items() if cols - set(tables[t].columns)}
    if missing:
        raise KeyError(f"columns missing: {missing}")


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """References whose parent row does not exist (null references are fine).
    Rows: child table, reference column, child row key (comma-joined), missing value.

    All references of all tables are stacked and reduced to their distinct
    (parent table, value) before they are shuffled; one join with all parents'
    ids finds those without a row, and a second one their children. Every table
    is read twice as a child and once as a parent, whatever the number of its
    references.
    """
    parents = {p for _, refs in FOREIGN_KEYS.values() for p, _ in refs.values()}
    require(tables, set(FOREIGN_KEYS) | parents)
    require_columns(tables, {t: {*key, *refs} for t, (key, refs) in FOREIGN_KEYS.items()} | {p: {"id"} for p in parents})
    children = []
    for child, (key, refs) in FOREIGN_KEYS.items():
        row_key = F.concat_ws(",", *[F.col(k).cast("string") for k in key])
        each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(p).alias("_parent"), F.col(c).cast("string").alias("missing"))
                         for c, (p, _) in refs.items()])
        children.append(tables[child].select(F.lit(child).alias("table_name"), row_key.alias("row_key"), F.inline(each)))
    held = reduce(DataFrame.unionByName, [tables[p].select(F.lit(p).alias("_parent"), F.col("id").cast("string").alias("missing"))
                                          for p in sorted(parents)])
    refs = reduce(DataFrame.unionByName, children).filter(F.col("missing").isNotNull())
    # the distinct references are few against the rows, and those without a parent fewer still: stored, they
    # are joined back by broadcast where Spark finds them small (an outer join, since an anti join would be
    # pushed below the union, once per table)
    lost = (refs.select("_parent", "missing").distinct().join(held.withColumn("_held", F.lit(True)), ["_parent", "missing"], "left")
            .filter(F.col("_held").isNull()).select("_parent", "missing"))
    return refs.join(stored(lost, "lost-references"), ["_parent", "missing"]).select("table_name", "column_name", "row_key", "missing")


# Q5 ------------------------------------------------------------------------
def cross_tenant_refs(items: DataFrame, tasks: DataFrame, clients: DataFrame, memberships: DataFrame) -> DataFrame:
    """Stored content items and tasks that break the tenant guards."""
    ci = content_ref_check(items.select("id", "workspace_id", "client_id"), clients)
    ci = ci.filter(F.col("bad_field").isNotNull()).select(
        F.lit("content_items").alias("table_name"), F.col("id").cast("string").alias("row_key"), "workspace_id",
        "bad_field")
    tk = task_ref_check(tasks.select("id", "workspace_id", "client_id", "content_item_id", "assignee_id"),
                        clients, items, memberships)
    tk = tk.filter(F.col("bad_field").isNotNull()).select(
        F.lit("tasks").alias("table_name"), F.col("id").cast("string").alias("row_key"), "workspace_id", "bad_field")
    return ci.unionByName(tk)


# Q6 ------------------------------------------------------------------------
NOT_NULL = {
    "users": ["id", "email", "name", "created_at", "updated_at"],
    "workspaces": ["id", "name", "created_at", "updated_at"],
    "memberships": ["workspace_id", "user_id", "role", "joined_at"],
    "workspace_invites": ["id", "workspace_id", "created_by", "token", "max_uses", "use_count", "expires_at", "created_at"],
    "clients": ["id", "workspace_id", "name", "social_handles", "notes", "active", "created_at", "updated_at"],
    "content_items": ["id", "workspace_id", "title", "description", "platform", "content_type", "status", "created_by",
                      "created_at", "updated_at"],
    "comments": ["id", "content_item_id", "author_id", "body", "created_at"],
    "tasks": ["id", "workspace_id", "title", "description", "done", "created_at", "updated_at"],
}


def null_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Nulls in NOT NULL columns: one aggregate pass per table, then the
    counts unpivoted to (table, column, nulls) rows."""
    require(tables, set(NOT_NULL))
    require_columns(tables, {t: set(cols) for t, cols in NOT_NULL.items()})
    parts = []
    for table, cols in NOT_NULL.items():
        df = tables[table]
        agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
        stack = "stack({n}, {pairs}) as (column_name, nulls)".format(
            n=len(cols), pairs=", ".join(f"'{c}', `{c}`" for c in cols))
        parts.append(agg.selectExpr(stack).select(F.lit(table).alias("table_name"), "column_name", "nulls"))
    return reduce(DataFrame.unionByName, parts)
