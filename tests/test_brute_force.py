"""Change jobs against a one-request-at-a-time replay in plain Python."""

import datetime as dt
import random

from slatework.functions import enums as E
from slatework.operators import changes as M
from slatework.operators import invites as I
from slatework.operators import workflow as W


def test_replay_matches_one_by_one(fx):
    status = {r.id: r.status for r in fx.content_items.select("id", "status").collect()}
    reqs = sorted(fx.transition_requests.collect(), key=lambda r: (r.requested_at, r.id))
    pred = E.predecessor()
    expect = {}
    for r in reqs:
        if r.to_status not in E.STATUSES:
            expect[r.id] = "invalid_enum"
        elif r.content_item_id not in status:
            expect[r.id] = "not_found"
        elif pred.get(r.to_status) == status[r.content_item_id]:
            expect[r.id] = "accepted"
            status[r.content_item_id] = r.to_status
        else:
            expect[r.id] = "invalid_transition"
    verdicts, items = W.replay_transitions(fx.content_items, fx.transition_requests)
    assert {r.id: r.verdict for r in verdicts.collect()} == expect
    assert {r.id: r.status for r in items.select("id", "status").collect()} == status


def test_claims_match_one_by_one(fx):
    inv = {r.token: r.asDict() for r in fx.invites.collect()}
    members = {(r.workspace_id, r.user_id): r.role for r in fx.memberships.collect()}
    expect, new = {}, set()
    for c in sorted(fx.claims.collect(), key=lambda r: (r.claimed_at, r.id)):
        i = inv.get(c.token)
        if i is None:
            expect[c.id] = ("not_found", None)
        elif c.claimed_at > i["expires_at"] or i["use_count"] >= i["max_uses"]:
            expect[c.id] = ("unusable", None)
        else:
            key = (i["workspace_id"], c.user_id)
            if key not in members:
                members[key] = "viewer"
                new.add(c.id)
            i["use_count"] += 1
            expect[c.id] = ("accepted", members[key])
    verdicts, m, invites = I.claim_invites(fx.invites, fx.memberships, fx.claims)
    got = {r.id: (r.verdict, r.role) for r in verdicts.collect()}
    assert got == expect
    assert {r.id for r in verdicts.filter("new_member").collect()} == new
    assert {r.token: r.use_count for r in invites.collect()} == {t: i["use_count"] for t, i in inv.items()}
    assert {(r.workspace_id, r.user_id): r.role for r in m.collect()} == members


T0 = dt.datetime(2026, 1, 1)


def test_several_requests_for_one_item_match_one_by_one(spark):
    items = spark.createDataFrame([(1, 1, "draft", T0), (2, 1, "draft", T0), (3, 1, "approved", T0)],
                                  "id long, workspace_id long, status string, updated_at timestamp_ntz")
    log = [(10, 1, "review"), (11, 1, "review"), (12, 1, "approved"), (13, 2, "review"), (14, 9, "review"), (15, 3, "gone")]
    req = spark.createDataFrame([(*r, T0 + dt.timedelta(hours=i)) for i, r in enumerate(log)],
                                "id long, content_item_id long, to_status string, requested_at timestamp_ntz")
    v, new = W.apply_transitions(items, req)
    assert {r.id: r.verdict for r in v.collect()} == {10: "accepted", 11: "invalid_transition", 12: "accepted", 13: "accepted",
                                                      14: "not_found", 15: "invalid_enum"}
    assert sorted((r.id, r.status) for r in new.collect()) == [(1, "approved"), (2, "review"), (3, "approved")]


def test_task_log_matches_one_by_one(spark):
    rnd = random.Random(3)
    clients = {1: True, 2: False, 3: True}  # live or deleted
    tasks = {f"t{i}": {"client_id": rnd.choice([None, 1, 2]), "done": rnd.random() < 0.5} for i in range(8)}
    log = [(f"r{i:03d}", 1, rnd.choice(["update", "toggle", "toggle"]), rnd.choice([*tasks, "t0", "t0", "none", None]),
            rnd.choice(["Title", "Title", ""]), rnd.choice([None, 1, 2, 3, 4]), rnd.random() < 0.5,
            T0 + dt.timedelta(hours=rnd.randint(0, 40))) for i in range(200)]
    expect, state = {}, {k: dict(v) for k, v in tasks.items()}
    for rid, _, kind, key, title, client, done, _ in sorted(log, key=lambda r: (r[7], r[0])):
        if kind == "update" and not title:
            expect[rid] = "required"
        elif key not in state:
            expect[rid] = "not_found"
        else:
            ref = client if kind == "update" else state[key]["client_id"]
            expect[rid] = "accepted" if ref is None or clients.get(ref) else "invalid_reference"
            if expect[rid] == "accepted":
                state[key] = {"client_id": client, "done": done} if kind == "update" else \
                    {"client_id": ref, "done": not state[key]["done"]}
    t = spark.createDataFrame([(k, 1, "T", None, v["client_id"], v["done"], T0) for k, v in tasks.items()],
                              "id string, workspace_id long, title string, assignee_id long, client_id long, done boolean, updated_at timestamp_ntz")
    t = t.selectExpr("*", "cast(null as long) as content_item_id", "cast(null as date) as due_date", "'' as description")
    req = spark.createDataFrame(log, "id string, workspace_id long, kind string, task_key string, title string, client_id long, "
                                     "done boolean, requested_at timestamp_ntz")
    req = req.selectExpr("*", "cast(null as long) as content_item_id", "cast(null as long) as assignee_id",
                         "cast(null as string) as due_date", "cast(null as string) as description")
    c = spark.createDataFrame([(k, 1, None if live else T0) for k, live in clients.items()],
                              "id long, workspace_id long, deleted_at timestamp_ntz")
    none = spark.createDataFrame([], "id long, workspace_id long, user_id long, role string")
    v, new = M.write_tasks(t, req, c, none, none)
    assert {r.id: r.verdict for r in v.collect()} == expect
    assert {r.id: (r.client_id, r.done) for r in new.collect()} == {k: (s["client_id"], s["done"]) for k, s in state.items()}


def test_invite_tokens_stay_unique(spark):
    inv = spark.createDataFrame([(1, 1, "old")], "id long, workspace_id long, token string")
    members = spark.createDataFrame([(1, 7, "admin"), (1, 8, "viewer")], "workspace_id long, user_id long, role string")
    log = [(10, 8, "a"), (11, 7, "a"), (12, 7, "a"), (13, 7, "old"), (14, 7, "b")]
    req = spark.createDataFrame([(i, u, 1, t, 0, 0, T0) for i, u, t in log],
                                "id long, actor_id long, workspace_id long, token string, max_uses int, expires_in_hours int, requested_at timestamp_ntz")
    v, out = M.issue_invites(inv, members, req)
    assert {r.id: r.verdict for r in v.collect()} == {10: "forbidden", 11: "accepted", 12: "conflict", 13: "conflict", 14: "accepted"}
    assert sorted(r.token for r in out.collect()) == ["a", "b", "old"]


def test_owners_cannot_be_removed_and_audits_need_every_table(spark, tmp_path):
    import pytest
    from pyspark.sql import types as T

    from slatework.operators import checks as C
    from slatework.sources import schemas
    from slatework.sources.tables import read_tables

    at = T0
    rows = {"users": [(1, "a", "A", at, at), (2, "b", "B", at, at), (3, "c", "C", at, at)],
            "workspaces": [(1, "w", at, at, None)], "memberships": [(1, 2, "admin", at), (1, 3, "viewer", at)],
            "workspace_invites": [(1, 1, 3, "tok", 10, 0, at, at), (2, 1, 1, "tok", 10, 0, at, at)], "clients": [],
            "content_items": [(1, 1, None, "t", "", "other", "post", "draft", None, 1, at, at)],
            "comments": [(1, 1, 2, "hi", at)], "tasks": [(1, 1, "t", "", 3, None, False, None, None, at, at)]}
    for name, data in rows.items():
        spark.createDataFrame(data, schemas.entity_schema(name, T.LongType())).write.parquet(f"{tmp_path}/{name}")
    tables = read_tables(spark, str(tmp_path), T.LongType())
    assert [(r.table_name, r.value) for r in C.dup_keys(tables).collect()] == [("workspace_invites", "tok")]
    assert C.orphans(tables).count() == 0 and C.null_violations(tables).count() > 20
    out, verdicts = M.cascade_delete(tables, {"users": tables["users"].select("id")})
    assert {r.id: r.verdict for r in verdicts.collect()} == {1: "in_use", 2: "in_use", 3: "accepted"}
    assert {r.id for r in out["users"].collect()} == {1, 2}
    assert [r.id for r in out["workspace_invites"].collect()] == [2]
    assert [r.assignee_id for r in out["tasks"].collect()] == [None]
    part = {k: v for k, v in tables.items() if k != "workspace_invites"}
    for job in (C.dup_keys, C.orphans, C.null_violations, lambda t: M.cascade_delete(t, {"users": tables["users"].select("id")})):
        with pytest.raises(KeyError):
            job(part)
        with pytest.raises(KeyError):
            job(tables | {"invites": tables["workspace_invites"]})
