"""Batches judged as if applied one by one: names (M9), rights (M7, M8), first-wins jobs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from slatework.operators import changes as M
from slatework.operators import invites as I
from slatework.operators.settle import first_wins

T0 = dt.datetime(2026, 1, 1)
CLIENTS = "id long, workspace_id long, name string, social_handles string, notes string, active boolean, deleted_at timestamp_ntz"
REQUESTS = ("id long, workspace_id long, kind string, client_id long, name string, social_handles string, notes string, "
            "active boolean, requested_at timestamp_ntz")
MEMBERS = "workspace_id long, user_id long, role string"
CHANGES = "id long, kind string, actor_id long, workspace_id long, target_user_id long, role string, requested_at timestamp_ntz"


def replay_clients(clients, requests):
    names = {}
    for i, ws, name, *_, gone in clients:
        if gone is None:
            names.setdefault(ws, {})[("c", i)] = name.lower()
    out = []
    for n, (i, ws, kind, client, name, *_ , at) in sorted(enumerate(requests), key=lambda x: (x[1][-1], x[1][0])):
        held = names.setdefault(ws, {})
        target = ("c", client) if kind == "update" else ("n", n)
        if not name:
            v = "required"
        elif kind == "update" and target not in held:
            v = "not_found"
        elif any(k == name.lower() for c, k in held.items() if c != target):
            v = "conflict"
        else:
            v, held[target] = "accepted", name.lower()
        out.append((i, at, kind, client, name, v))
    return sorted(out, key=repr)


def client_rows(spark, rows, most=0):
    """Settled in rounds, unless ``most`` lets a workspace be applied in one task."""
    v, new = M.write_clients(rows[0], rows[1], most=most)
    return sorted(((r.id, r.requested_at, r.kind, r.client_id, r.name, r.verdict) for r in v.collect()), key=repr), new


def frames(spark, clients, requests):
    return spark.createDataFrame(clients, CLIENTS), spark.createDataFrame(requests, REQUESTS)


def request(i, ws, kind, client, name, minute):
    return (i, ws, kind, client, name, None, None, True, T0 + dt.timedelta(minutes=minute))


def test_a_freed_name_can_be_taken(spark):
    clients = [(1, 10, "Acme", None, "", True, None), (2, 10, "Beta", None, "", True, None)]
    reqs = [request(1, 10, "create", None, "ACME", 0), request(2, 10, "update", 1, "Gamma", 1), request(3, 10, "create", None, "acme", 2),
            request(4, 10, "update", 2, "Acme", 3), request(5, 10, "update", 1, "gamma", 4), request(6, 10, "update", 2, "Beta2", 5),
            request(7, 10, "update", 1, "Beta", 6), request(8, 10, "create", None, "Gamma", 7)]
    got, new = client_rows(spark, frames(spark, clients, reqs))
    assert got == replay_clients(clients, reqs)
    assert {r[0]: r[-1] for r in got} == {1: "conflict", 2: "accepted", 3: "accepted", 4: "conflict", 5: "accepted", 6: "accepted",
                                          7: "accepted", 8: "accepted"}
    assert sorted(r.name for r in new.collect()) == ["Beta", "Beta2", "Gamma", "acme"]


def test_two_clients_swap_names(spark):
    clients = [(1, 10, "A", None, "", True, None), (2, 10, "B", None, "", True, None)]
    reqs = [request(1, 10, "update", 1, "tmp", 0), request(2, 10, "update", 2, "A", 1), request(3, 10, "update", 1, "B", 2)]
    got, new = client_rows(spark, frames(spark, clients, reqs))
    assert [r[-1] for r in got] == ["accepted"] * 3
    assert {r.id: r.name for r in new.collect()} == {1: "B", 2: "A"}


@pytest.mark.parametrize("most", [0, 50, 10**6])
@pytest.mark.parametrize("seed", range(3))
def test_clients_equal_a_one_by_one_replay(spark, seed, most):
    rnd = random.Random(seed)
    names = ["Acme", "ACME", "beta", "Gamma", "delta", "", None]
    clients = [(i, i % 2, rnd.choice(names[:5]) + str(i), None, "", True, T0 if i % 5 == 4 else None) for i in range(8)]
    clients += [(i, i % 2, rnd.choice(names[:5]), None, "", True, None) for i in range(8, 11)]
    reqs = [request(rnd.randint(1, 70), rnd.randint(0, 1), kind, rnd.randint(0, 11) if kind == "update" else None, rnd.choice(names), n)
            for n, kind in enumerate(rnd.choices(["update", "create"], [3, 1], k=90))]  # ids repeat
    got, _ = client_rows(spark, frames(spark, clients, reqs), most)
    assert got == replay_clients(clients, reqs)
    assert len({r[-1] for r in got}) == 4


def test_a_long_chain_of_renames_settles(spark):
    clients = [(i, 10, f"n{i}", None, "", True, None) for i in range(12)]
    # client 0 leaves n0; each next client takes the name the one before left, latest first in the other half
    reqs = [request(100, 10, "update", 0, "free", 0)] + [request(100 + i, 10, "update", i, f"n{i - 1}", i) for i in range(1, 12)]
    got, _ = client_rows(spark, frames(spark, clients, reqs))
    assert got == replay_clients(clients, reqs) and {r[-1] for r in got} == {"accepted"}


def replay_members(members, requests):
    role = {(w, u): r for w, u, r in members}
    out = []
    for i, kind, actor, ws, target, new, at in sorted(requests, key=lambda r: (r[-1], r[0])):
        a = role.get((ws, actor))
        if a is None:
            v = "not_found", "workspace"
        elif a != "admin":
            v = "forbidden", "role"
        elif kind == "change_role" and new not in ("admin", "cm", "viewer"):
            v = "invalid_enum", "role"
        elif actor == target:
            v = "self", "user_id"
        elif (ws, target) not in role:
            v = "not_found", "membership"
        else:
            v = "accepted", None
            if kind == "remove":
                del role[ws, target]
            else:
                role[ws, target] = new
        out.append((i, at, *v))
    return sorted(out, key=repr), role


@pytest.mark.parametrize("most", [0, 40, 10**6])
@pytest.mark.parametrize("seed", range(3))
def test_members_equal_a_one_by_one_replay(spark, seed, most):
    rnd = random.Random(seed)
    members = [(w, u, rnd.choice(["admin", "admin", "cm", "viewer"])) for w in range(3) for u in range(7)]
    reqs = [(rnd.randint(1, 60), rnd.choice(["change_role"] * 4 + ["remove"]), rnd.randint(0, 8), rnd.choice([0, 0, 0, 1, 2, 3]),
             rnd.randint(0, 8), rnd.choice(["admin", "admin", "cm", "viewer", "owner", None]), T0 + dt.timedelta(minutes=n)) for n in range(90)]
    v, new = M.write_members(spark.createDataFrame(members, MEMBERS), spark.createDataFrame(reqs, CHANGES), most)
    want, role = replay_members(members, reqs)
    assert sorted(((r.id, r.requested_at, r.verdict, r.field) for r in v.collect()), key=repr) == want
    assert {(r.workspace_id, r.user_id): r.role for r in new.collect()} == role
    assert len({r[2] for r in want}) >= 4


def test_a_demoted_admin_has_no_rights_left(spark):
    members = [(1, 1, "admin"), (1, 2, "admin"), (1, 3, "viewer")]
    reqs = [(1, "change_role", 1, 1, 2, "viewer", T0), (2, "remove", 2, 1, 3, None, T0 + dt.timedelta(minutes=1)),
            (3, "change_role", 1, 1, 3, "admin", T0 + dt.timedelta(minutes=2)), (4, "remove", 3, 1, 1, None, T0 + dt.timedelta(minutes=3)),
            (5, "change_role", 1, 1, 2, "cm", T0 + dt.timedelta(minutes=4))]
    v, new = M.write_members(spark.createDataFrame(members, MEMBERS), spark.createDataFrame(reqs, CHANGES))
    assert {r.id: r.verdict for r in v.collect()} == {1: "accepted", 2: "forbidden", 3: "accepted", 4: "accepted", 5: "not_found"}
    assert {r.user_id: r.role for r in new.collect()} == {2: "viewer", 3: "admin"}
    assert M.write_members(spark.createDataFrame(members, MEMBERS), spark.createDataFrame([], CHANGES))[0].count() == 0


def test_a_hot_name_settles(spark):
    """A third of many requests for one name of one workspace."""
    n = 30_000
    reqs = spark.range(n).select(
        "id", F.lit(10).cast("long").alias("workspace_id"), F.lit("create").alias("kind"), F.lit(None).cast("long").alias("client_id"),
        F.when(F.col("id") % 3 == 0, F.lit("Hot")).otherwise(F.concat(F.lit("n"), F.col("id").cast("string"))).alias("name"),
        F.lit(None).cast("string").alias("social_handles"), F.lit(None).cast("string").alias("notes"), F.lit(True).alias("active"),
        F.lit(T0).alias("requested_at"))
    v, _ = M.write_clients(spark.createDataFrame([], CLIENTS), reqs, most=1000)
    got = v.groupBy("verdict", (F.col("name") == "Hot").alias("hot")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).collect()
    assert {(r.verdict, r.hot): (r.n, r.least) for r in got} == {("accepted", True): (1, 0), ("conflict", True): (n // 3 - 1, 3),
                                                               ("accepted", False): (n - n // 3, 1)}


def test_first_wins_tells_repeated_ids_apart(spark):
    rows = [(1, "a", T0, "accepted", None), (1, "a", T0, "accepted", None), (1, "b", T0, "accepted", None), (2, None, T0, "accepted", None),
            (3, None, T0 + dt.timedelta(hours=1), "accepted", None), (4, "a", T0 - dt.timedelta(hours=1), "required", "name")]
    df = spark.createDataFrame(rows, "id long, key string, requested_at timestamp_ntz, verdict string, field string")
    got = sorted(((r.id, r.key, r.verdict, r.field) for r in first_wins(df, ["key"], "conflict", "key").collect()), key=repr)
    assert got == sorted([(1, "a", "accepted", None), (1, "a", "conflict", "key"), (1, "b", "accepted", None), (2, None, "accepted", None),
                          (3, None, "conflict", "key"), (4, "a", "required", "name")], key=repr)
    assert first_wins(df.limit(0), ["key"], "conflict", "key").count() == 0


def test_deletions_and_registrations_with_repeated_request_ids(spark):
    tasks = spark.createDataFrame([("t1", 1), ("t2", 1)], "id string, workspace_id long")
    req = spark.createDataFrame([(7, 1, "t1", T0), (7, 1, "t1", T0), (7, 1, "t2", T0), (7, 2, "t2", T0)],
                                "id long, workspace_id long, task_id string, requested_at timestamp_ntz")
    v, left = M.delete_tasks(tasks, req)
    assert sorted((r.task_id, r.verdict) for r in v.collect()) == [("t1", "accepted"), ("t1", "not_found"), ("t2", "accepted"), ("t2", "not_found")]
    assert left.count() == 0
    users = spark.createDataFrame([(1, "old@x")], "id long, email string")
    reg = spark.createDataFrame([(5, "a@x", "A", 11, 21, T0), (5, "a@x", "A", 12, 22, T0), (5, "old@x", "", 13, 23, T0), (5, "", "", 14, 24, T0)],
                                "id long, email string, name string, new_user_id long, new_workspace_id long, requested_at timestamp_ntz")
    ws = spark.createDataFrame([], "id long, name string, deleted_at timestamp_ntz")
    v, out = M.register_users(users, ws, spark.createDataFrame([], MEMBERS), reg)
    assert sorted((r.email, r.verdict) for r in v.collect()) == [("", "required"), ("a@x", "accepted"), ("a@x", "conflict"), ("old@x", "conflict")]
    assert out["users"].count() == 2 and out["workspaces"].count() == 1


def test_invites_need_a_token(spark):
    members = spark.createDataFrame([(10, 1, "admin")], MEMBERS)
    invites = spark.createDataFrame([(1, 10, "held")], "id long, workspace_id long, token string")
    req = spark.createDataFrame([(1, 1, 10, None, 1, 1, T0), (2, 1, 10, None, 1, 1, T0), (3, 1, 10, "", 1, 1, T0), (4, 2, 10, None, 1, 1, T0),
                                 (5, 1, 10, "held", 1, 1, T0), (6, 1, 10, "new", 1, 1, T0)],
                                "id long, actor_id long, workspace_id long, token string, max_uses int, expires_in_hours int, requested_at timestamp_ntz")
    v, out = M.issue_invites(invites, members, req)
    assert {r.id: (r.verdict, r.field) for r in v.collect()} == {
        1: ("required", "token"), 2: ("required", "token"), 3: ("required", "token"), 4: ("not_found", "workspace"),
        5: ("conflict", "token"), 6: ("accepted", None)}
    assert sorted(r.token for r in out.collect()) == ["held", "new"]


def test_claims_with_repeated_ids_make_one_member(spark):
    invites = spark.createDataFrame([(1, 10, "tok", 5, 0, T0 + dt.timedelta(days=1))],
                                    "id long, workspace_id long, token string, max_uses int, use_count int, expires_at timestamp_ntz")
    members = spark.createDataFrame([], MEMBERS + ", joined_at timestamp_ntz")
    claims = spark.createDataFrame([(1, "tok", 7, T0), (1, "tok", 7, T0), (1, "tok", 8, T0)], "id long, token string, user_id long, claimed_at timestamp_ntz")
    v, m, inv = I.claim_invites(invites, members, claims)
    assert sorted((r.user_id, r.verdict, r.new_member) for r in v.collect()) == [(7, "accepted", False), (7, "accepted", True), (8, "accepted", True)]
    assert m.count() == 2 and inv.first().use_count == 3


def jobs_of(spark, work):
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        found = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))


def test_requests_of_a_large_workspace_are_replayed_once(spark):
    """A chain as long as the batch takes as many slices as there are, not a round for every link."""
    n = 64
    clients = [(i, 10, f"n{i}", None, "", True, None) for i in range(n)]
    reqs = [request(100, 10, "update", 0, "free", 0)] + [request(100 + i, 10, "update", i, f"n{i - 1}", i) for i in range(1, n)]
    (got, _), jobs = jobs_of(spark, lambda: client_rows(spark, frames(spark, clients, reqs), 20))
    assert got == replay_clients(clients, reqs) and {r[-1] for r in got} == {"accepted"}
    assert jobs < 100
    # every admin makes the next one and then goes
    members = [(1, u, "admin" if u == 0 else "viewer") for u in range(n)]
    log = [(i, "change_role" if i % 2 == 0 else "remove", i // 2 + i % 2, 1, i // 2 + (i + 1) % 2, "admin", T0 + dt.timedelta(minutes=i)) for i in range(2 * n - 2)]
    v, _ = M.write_members(spark.createDataFrame(members, MEMBERS), spark.createDataFrame(log, CHANGES), 40)
    assert sorted(((r.id, r.requested_at, r.verdict, r.field) for r in v.collect()), key=repr) == replay_members(members, log)[0]


def test_outcomes_are_not_sent_through_the_driver(spark):
    log = spark.createDataFrame([(1, "remove", 1, 1, 2, None, T0)], CHANGES)
    members = spark.createDataFrame([(1, 1, "admin"), (1, 2, "viewer")], MEMBERS)
    v, _ = M.change_roles(members, log.drop("kind"))
    assert "BroadcastHashJoin [_row" not in v._jdf.queryExecution().executedPlan().toString()
