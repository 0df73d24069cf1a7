"""Work that must stay spread and narrow on larger tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from slatework.operators import changes as M
from slatework.operators.settle import first_wins
from slatework.sources.fixtures import Fixtures

T0 = dt.datetime(2026, 1, 1)


@pytest.fixture
def shuffled_joins(spark):
    """Joins as on large tables: none is small enough to broadcast."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    keep = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


def test_null_references_do_not_meet_in_one_task(spark, shuffled_joins):
    n, none = 4000, F.lit(None).cast("long")
    tasks = spark.range(n).select("id", F.lit(1).cast("long").alias("workspace_id"), none.alias("assignee_id"), none.alias("content_item_id"),
                                  F.when(F.col("id") % 10 == 0, F.col("id") % 3).alias("client_id"))
    clients = spark.range(3).select("id", F.lit(1).cast("long").alias("workspace_id"))
    out, _ = M.cascade_delete({"tasks": tasks, "clients": clients, "content_items": spark.range(1).select(
        "id", F.lit(1).cast("long").alias("workspace_id"), F.lit(2).cast("long").alias("client_id"), none.alias("created_by"))},
        {"clients": spark.range(2)})
    dealt = out["tasks"].groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in dealt) < n / 4
    got = {r.id: r.client_id for r in out["tasks"].collect()}
    assert got == {i: 2 if i % 10 == 0 and i % 3 == 2 else None for i in range(n)}


def test_rows_of_single_keys_do_not_wait_for_a_winner(spark):
    df = spark.createDataFrame([(i, i // 2 if i < 4 else i, T0, "accepted", None) for i in range(50)],
                               "id long, key long, requested_at timestamp_ntz, verdict string, field string")
    v = first_wins(df, ["key"], "conflict", "key")
    assert {r.id for r in v.filter("verdict = 'conflict'").collect()} == {1, 3} and v.count() == 50
    # the winners are two stored rows, not a row for every key
    plan = v._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_line_items_are_shuffled_once(spark, fx, shuffled_joins):
    for name in ("tasks", "full_tasks", "task_requests", "delete_requests"):
        plan = fx[name]._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(o_custkey") == 1 and "Exchange hashpartitioning(l_orderkey" in plan
        assert "l_" not in next(x for x in plan.splitlines() if "Exchange hashpartitioning(o_custkey" in x)
        last = [x for x in plan.splitlines() if "SortMergeJoin" in x][0]
        assert "l_orderkey" in last  # the line items come last


def test_line_item_fixtures_give_the_rows_of_their_sql(spark):
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    three = fx.base("lineitem").join(
        fx.base("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(fx.base("customer"), F.col("c_custkey") == F.col("o_custkey"))
    want = three.select(F.col("c_nationkey").cast("bigint").alias("workspace_id"), F.col("o_custkey").alias("client_id"), F.col("o_orderdate").alias("created_at"))
    got = fx.tasks.select("workspace_id", "client_id", "created_at")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_task_checks_are_stored_narrow(spark):
    """A toggle behind an accepted update passes, one before it does not; the wide rows are stored once."""
    tasks = spark.createDataFrame([("a", 1, 7, T0), ("b", 1, 7, T0)], "id string, workspace_id long, client_id long, updated_at timestamp_ntz")
    schema = ("id string, workspace_id long, kind string, task_key string, title string, description string, assignee_id long, "
              "due_date string, done boolean, content_item_id long, client_id long, requested_at timestamp_ntz")
    rows = [("1", 1, "toggle", "a", None, None, None, None, None, None, None, T0),
            ("2", 1, "update", "a", "x", None, None, None, False, None, None, T0 + dt.timedelta(minutes=1)),
            ("3", 1, "toggle", "a", None, None, None, None, None, None, None, T0 + dt.timedelta(minutes=2)),
            ("4", 1, "toggle", "b", None, None, None, None, None, None, None, T0 + dt.timedelta(minutes=2)),
            ("5", 1, "create", None, "new", None, None, None, None, None, None, T0)]
    empty = spark.createDataFrame([], "id long, workspace_id long, deleted_at timestamp_ntz")
    members = spark.createDataFrame([], "user_id long, workspace_id long")
    v, _ = M.write_tasks(tasks, spark.createDataFrame(rows, schema), empty, empty, members)
    assert {r.id: (r.verdict, r.field) for r in v.collect()} == {
        "1": ("invalid_reference", "client_id"), "2": ("accepted", None), "3": ("accepted", None), "4": ("invalid_reference", "client_id"),
        "5": ("accepted", None)}
    files = [f for f in v.inputFiles() if "task-verdicts" in f]
    assert files and spark.read.parquet(*files).columns == ["_r", "verdict", "field"]


def test_task_state_shuffles_no_requests(spark, shuffled_joins):
    """The new tasks and the changes of others are stored before they meet the tasks."""
    from slatework.plans import catalog
    state = catalog.queries()["write_tasks_state"](spark, "/root/testdata/sf0.001")
    read = {f.split("/")[-2].rsplit("-", 1)[0] for f in state.inputFiles() if "slatework-" in f}
    assert read == {"created-tasks", "task-changes"}
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "kind" not in plan and plan.count("Exchange hashpartitioning(task_key") == 1


@pytest.mark.parametrize("staged", [False, True])
def test_long_task_logs_with_and_without_stages(spark, shuffled_joins, staged):
    """Toggles count behind the last accepted update, which sets every field; other tasks, nulls and repeats keep their own."""
    tasks = spark.createDataFrame([(k, 1, "T", "", 7, None, False, None, c, T0, T0) for k, c in (("a", None), ("b", 9), ("c", None), ("c", None), ("d", None))],
                                  "id string, workspace_id long, title string, description string, assignee_id long, due_date date, done boolean, "
                                  "content_item_id long, client_id long, created_at timestamp_ntz, updated_at timestamp_ntz")
    at = [T0 + dt.timedelta(hours=i) for i in range(9)]
    rows = [("0", "toggle", "a", None, None, at[0]), ("1", "update", "a", "one", None, at[1]), ("2", "toggle", "a", None, None, at[2]),
            ("3", "update", "a", "two", 4, at[3]), ("4", "update", "a", "", None, at[4]), ("5", "toggle", "a", None, None, at[5]),
            ("6", "toggle", "b", None, None, at[1]), ("7", "update", "b", "bee", None, at[2]), ("8", "toggle", "b", None, None, at[3]),
            ("9", "toggle", "b", None, None, at[4]), ("10", "toggle", "c", None, None, at[1]), ("11", "toggle", None, None, None, at[1]),
            ("12", "create", None, "new", None, at[2]), ("13", "create", None, "bad", 5, at[2]), ("14", "update", "e", "none", None, at[2]),
            ("15", None, "d", "kindless", None, at[2]), ("16", "update", "c", "", None, at[3])]
    req = spark.createDataFrame([(i, 1, k, key, title, None, client, None, False, None, when) for i, k, key, title, client, when in rows],
                                "id string, workspace_id long, kind string, task_key string, title string, description string, client_id long, "
                                "due_date string, done boolean, content_item_id long, requested_at timestamp_ntz").withColumn("assignee_id", F.lit(7).cast("long"))
    clients = spark.createDataFrame([(4, 1, None), (9, 1, T0)], "id long, workspace_id long, deleted_at timestamp_ntz")
    members = spark.createDataFrame([(1, 7)], "workspace_id long, user_id long")
    v, new = M.write_tasks(tasks, req, clients, spark.createDataFrame([], "id long, workspace_id long"), members, staged=staged)
    bad = {"4": "required", "16": "required", "6": "invalid_reference", "11": "not_found", "13": "invalid_reference", "14": "not_found"}
    got = sorted((int(r.id), r.verdict) for r in v.collect())
    # a request for a task that is stored twice has two verdicts
    assert got == sorted([(int(i), bad.get(i, "accepted")) for i, *_ in rows] + [(10, "accepted"), (16, "required")])
    assert sorted((r.id, r.title, r.done, r.client_id, r.updated_at) for r in new.collect()) == [
        ("12", "new", False, None, at[2]), ("a", "two", True, 4, at[5]), ("b", "bee", False, None, at[4]),
        ("c", "T", False, None, at[1]), ("c", "T", False, None, at[1]), ("d", "T", False, None, T0)]


def test_tidy_storing_keeps_the_session_as_it_was(spark):
    from slatework.session import _DROP_SHUFFLES, stored
    was = spark.conf.get(_DROP_SHUFFLES, None)
    x = stored(spark.range(10).repartition(3, "id"), "tidy", tidy=True)
    assert x.count() == 10 and spark.conf.get(_DROP_SHUFFLES, None) == was
    assert all(f.endswith(".zstd.parquet") for f in x.inputFiles())
