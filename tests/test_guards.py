"""Tenant guards and verdict order on hand-made rows (FIXTURES.md section 1)."""

import datetime as dt

from pyspark.sql import functions as F

from slatework.operators import changes as M
from slatework.operators import checks as C

NOW = dt.datetime(2026, 1, 1)


def _clients(spark):
    return spark.createDataFrame(
        [(1, 10, "Acme", None), (2, 20, "Other", None), (3, 10, "Gone", NOW)],
        "id long, workspace_id long, name string, deleted_at timestamp_ntz")


def test_client_guard(spark):
    rows = spark.createDataFrame([(1, 10, None), (2, 10, 1), (3, 10, 2), (4, 10, 3), (5, 10, 99)],
                                 "id long, workspace_id long, client_id long")
    got = {r.id: r.bad_field for r in C.content_ref_check(rows, _clients(spark)).collect()}
    assert got == {1: None, 2: None, 3: "client_id", 4: "client_id", 5: "client_id"}


def test_task_guard_priority(spark):
    items = spark.createDataFrame([(100, 10), (200, 20)], "id long, workspace_id long")
    members = spark.createDataFrame([(10, 7, "cm")], "workspace_id long, user_id long, role string")
    rows = spark.createDataFrame(
        [(1, 10, None, None, None), (2, 10, 2, 200, 8), (3, 10, 1, 200, 8), (4, 10, 1, 100, 8), (5, 10, 1, 100, 7)],
        "id long, workspace_id long, client_id long, content_item_id long, assignee_id long")
    got = {r.id: r.bad_field for r in C.task_ref_check(rows, _clients(spark), items, members).collect()}
    assert got == {1: None, 2: "client_id", 3: "content_item_id", 4: "assignee_id", 5: None}


def test_create_content_order(spark):
    drafts = spark.createDataFrame(
        [(1, 10, 2, "", "myspace", "post", "bad"), (2, 10, 2, "T", "myspace", "", "bad"),
         (3, 10, 2, "T", "instagram", "", "bad"), (4, 10, 2, "T", "instagram", "post", "2026-6-5"),
         (5, 10, 2, "T", "instagram", "post", ""), (6, 10, 1, "T", "instagram", "post", "2026-06-15")],
        "id long, workspace_id long, client_id long, title string, platform string, content_type string, "
        "scheduled_date string")
    drafts = drafts.withColumn("created_by", drafts.id)
    v, items = M.create_content(drafts, _clients(spark), "2026-01-01")
    got = {r.id: (r.verdict, r.field) for r in v.collect()}
    assert got == {1: ("required", "title"), 2: ("invalid_enum", "platform"), 3: ("invalid_enum", "content_type"),
                   4: ("invalid_format", "scheduled_date"), 5: ("invalid_reference", "client_id"),
                   6: ("accepted", None)}
    (row,) = items.collect()
    assert row.status == "draft" and row.scheduled_date == dt.date(2026, 6, 15)


def test_comment_delete_cases(spark):
    items = spark.createDataFrame([(100, 10)], "id long, workspace_id long")
    comments = spark.createDataFrame([(1, 100, 7)], "id long, content_item_id long, author_id long")
    req = spark.createDataFrame([(1, 10, 1, 7, NOW), (2, 20, 1, 7, NOW), (3, 10, 1, 8, NOW), (4, 10, 9, 7, NOW),
                                 (5, 10, 1, 7, NOW + dt.timedelta(seconds=1))],
                                "id long, workspace_id long, comment_id long, author_id long, requested_at timestamp_ntz")
    v, left = M.delete_comments(comments, items, req)
    assert {r.id: r.verdict for r in v.collect()} == {1: "accepted", 2: "not_found", 3: "not_found",
                                                      4: "not_found", 5: "not_found"}
    assert left.count() == 0


def test_role_change_order(spark):
    members = spark.createDataFrame([(10, 1, "admin"), (10, 2, "cm"), (10, 3, "viewer")],
                                    "workspace_id long, user_id long, role string")
    req = spark.createDataFrame(
        [(1, 9, 10, 3, "cm", NOW), (2, 2, 10, 3, "cm", NOW), (3, 1, 10, 3, "owner", NOW), (4, 1, 10, 1, "cm", NOW),
         (5, 1, 10, 8, "cm", NOW), (6, 1, 10, 3, "cm", NOW)],
        "id long, actor_id long, workspace_id long, target_user_id long, role string, requested_at timestamp_ntz")
    v, m = M.change_roles(members, req)
    assert {r.id: r.verdict for r in v.collect()} == {1: "not_found", 2: "forbidden", 3: "invalid_enum",
                                                      4: "self", 5: "not_found", 6: "accepted"}
    assert {r.user_id: r.role for r in m.collect()} == {1: "admin", 2: "cm", 3: "cm"}


def _all_tables(spark, **given):
    """The eight tables with all their columns, empty where not given (missing columns become null)."""
    from pyspark.sql import types as T

    from slatework.sources.schemas import TABLE_NAMES, entity_schema
    out = {}
    for name in TABLE_NAMES:
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in entity_schema(name, T.LongType())])
        out[name] = spark.createDataFrame([], schema)
        if name in given:
            out[name] = out[name].unionByName(given[name], allowMissingColumns=True)
    return out


def test_dup_keys_finds_repeats(spark):
    users = spark.createDataFrame([(1, "a@x"), (2, "a@x"), (2, "b@x")], "id long, email string")
    members = spark.createDataFrame([(10, 1, "cm"), (10, 1, "viewer"), (11, 1, "cm")],
                                    "workspace_id long, user_id long, role string")
    got = {(r.table_name, r.key_name, r.value): r.occurrences
           for r in C.dup_keys(_all_tables(spark, users=users, memberships=members)).collect()}
    assert got == {("users", "id", "2"): 2, ("users", "email", "a@x"): 2,
                   ("memberships", "workspace_id,user_id", "10,1"): 2}


def test_orphans_and_null_refs(spark):
    ws = spark.createDataFrame([(10,)], "id long")
    items = spark.createDataFrame([(1, 10, None), (2, 11, 5)], "id long, workspace_id long, client_id long")
    clients = spark.createDataFrame([(6, 10)], "id long, workspace_id long")
    got = sorted((r.table_name, r.column_name, r.row_key, r.missing) for r in
                 C.orphans(_all_tables(spark, workspaces=ws, content_items=items, clients=clients)).collect())
    assert got == [("content_items", "client_id", "2", "5"), ("content_items", "workspace_id", "2", "11")]


def test_orphans_plan_and_audits_raise(spark):
    import pytest
    tables = _all_tables(spark)
    plan = C.orphans(tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3
    for audit, table, column in ((C.orphans, "workspace_invites", "created_by"), (C.null_violations, "tasks", "title")):
        with pytest.raises(KeyError):
            audit(tables | {table: tables[table].drop(column)})
        with pytest.raises(KeyError):
            audit({k: v for k, v in tables.items() if k != table})


def test_nulls_of_every_required_column(spark):
    from slatework.sources.schemas import TABLE_NAMES
    one = {n: spark.range(1).select(F.lit(None).cast("string").alias("name")) for n in ("users", "workspaces", "clients")}
    got = {(r.table_name, r.column_name): r.nulls for r in C.null_violations(_all_tables(spark, **one)).collect()}
    assert {t for t, _ in got} == set(TABLE_NAMES) and len(got) == 51
    assert {k for k, n in got.items() if n} == {k for k in got if k[0] in one}


def test_task_writes_state(spark):
    T0 = dt.datetime(2026, 1, 1)
    tasks = spark.createDataFrame(
        [("t1", 10, "A", "", None, None, False, None, None, T0, T0),
         ("t2", 10, "B", "", None, None, True, None, None, T0, T0)],
        "id string, workspace_id long, title string, description string, assignee_id long, due_date date, "
        "done boolean, content_item_id long, client_id long, created_at timestamp_ntz, updated_at timestamp_ntz")
    req = spark.createDataFrame(
        [("r1", 10, "update", "t1", "A2", None, None, "2026-02-01", True, None, None, T0 + dt.timedelta(days=1)),
         ("r2", 10, "toggle", "t1", None, None, None, None, None, None, None, T0 + dt.timedelta(days=2)),
         ("r3", 10, "toggle", "t1", None, None, None, None, None, None, None, T0 + dt.timedelta(days=3)),
         ("r4", 10, "toggle", "t2", None, None, None, None, None, None, None, T0 + dt.timedelta(days=1)),
         ("r5", 10, "create", None, "New", None, None, "", False, None, 99, T0),
         ("r6", 10, "update", "t9", "X", None, None, None, False, None, None, T0)],
        "id string, workspace_id long, kind string, task_key string, title string, description string, "
        "assignee_id long, due_date string, done boolean, content_item_id long, client_id long, "
        "requested_at timestamp_ntz")
    clients = spark.createDataFrame([(99, 10, None)], "id long, workspace_id long, deleted_at timestamp_ntz")
    items = spark.createDataFrame([(1, 10)], "id long, workspace_id long")
    members = spark.createDataFrame([(10, 1, "cm")], "workspace_id long, user_id long, role string")
    v, new = M.write_tasks(tasks, req, clients, items, members)
    assert {r.id: r.verdict for r in v.collect()} == {"r1": "accepted", "r2": "accepted", "r3": "accepted",
                                                      "r4": "accepted", "r5": "accepted", "r6": "not_found"}
    state = {r.id: (r.title, r.done, r.due_date) for r in new.collect()}
    assert state == {"t1": ("A2", True, dt.date(2026, 2, 1)), "t2": ("B", False, None), "r5": ("New", False, None)}


def test_client_writes_state(spark):
    T0 = dt.datetime(2026, 1, 1)
    clients = spark.createDataFrame([(1, 10, "Acme", '{"ig":"@a"}', None), (2, 10, "Beta", None, None)],
                                    "id long, workspace_id long, name string, social_handles string, "
                                    "deleted_at timestamp_ntz")
    req = spark.createDataFrame(
        [(11, 10, "create", None, "acme", None, "", True, T0), (12, 10, "create", None, "Gamma", "null", "", True, T0),
         (13, 10, "create", None, "GAMMA", None, "", True, T0 + dt.timedelta(seconds=1)),
         (14, 10, "update", 2, "Beta 2", None, "n", False, T0), (15, 10, "update", 2, "Beta 3", '{"x":"y"}', "m", True,
                                                                  T0 + dt.timedelta(seconds=5))],
        "id long, workspace_id long, kind string, client_id long, name string, social_handles string, notes string, "
        "active boolean, requested_at timestamp_ntz")
    v, new = M.write_clients(clients, req)
    assert {r.id: r.verdict for r in v.collect()} == {11: "conflict", 12: "accepted", 13: "conflict",
                                                      14: "accepted", 15: "accepted"}
    state = {r.id: (r.name, r.social_handles, r.active) for r in new.collect()}
    assert state == {1: ("Acme", {"ig": "@a"}, None), 2: ("Beta 3", {"x": "y"}, True), 12: ("Gamma", {}, True)}
