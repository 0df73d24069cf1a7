"""Nested result forms and the physical plans the README promises."""

import json

from pyspark.sql import functions as F

from slatework.operators import aggregates as A
from slatework.operators import reads as R
from slatework.sources import export as S


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_content_detail_nested(fx):
    ids = [r.id for r in fx.content_items.select("id").orderBy("id").limit(40).collect()]
    nested = R.content_detail(fx.content_items, fx.comments, fx.users, item_ids=ids, nested=True)
    flat = R.content_detail(fx.content_items, fx.comments, fx.users, item_ids=ids)
    rows = {r.id: r.comments for r in nested.collect()}
    assert set(rows) == set(ids)
    counts = {r.id: r.n for r in flat.groupBy("id").agg(F.count("comment_id").alias("n")).collect()}
    for i, comments in rows.items():
        assert comments is not None  # never null, [] when empty
        assert len(comments) == counts[i]
        times = [c.created_at for c in comments]
        assert times == sorted(times)
    assert any(len(c) == 0 for c in rows.values())


def test_dashboard_recent_items(fx):
    d = A.dashboard(fx.content_items, fx.tasks, fx.workspaces, "1999-01-01").collect()
    top = {(r.workspace_id, r.id): r.rank for r in R.recent_items(fx.content_items).collect()}
    for row in d:
        assert row.total_items == sum(row[f"{s}_count"] for s in ("draft", "review", "approved", "published",
                                                                   "archived"))
        ranks = [it.rank for it in row.recent_items]
        assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) <= 10
        assert all(top[(row.workspace_id, it.id)] == it.rank for it in row.recent_items)


def test_calendar_json_shape(fx):
    mi, dc = A.calendar(fx.content_items, "1997-06", "1999-01-01")
    items, counts = S.calendar_json(mi, dc)
    per_ws = {r.workspace_id: r.n for r in items.groupBy("workspace_id").agg(F.count("*").alias("n")).collect()}
    for r in counts.collect():
        m = json.loads(r.counts_json)
        assert sum(m.values()) == per_ws[r.workspace_id]
        assert all(len(k) == 10 for k in m)
    one = json.loads(items.first().item_json)
    assert {"id", "title", "status", "scheduled_date"} <= set(one)


def test_recent_items_plans_group_limit(fx):
    assert "WindowGroupLimit" in _plan(R.recent_items(fx.content_items))


def test_tenant_filter_reaches_scan(spark, tmp_path):
    path = str(tmp_path / "items")
    spark.range(100).select(F.col("id"), (F.col("id") % 5).alias("workspace_id"),
                            F.lit("draft").alias("status"), F.lit("t").alias("title")).write.parquet(path)
    df = R.tenant_scope(spark.read.parquet(path), 3).select("id")
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(workspace_id), EqualTo(workspace_id,3)]" in plan
    assert "ReadSchema: struct<id:bigint,workspace_id:bigint>" in plan


def test_scan_reads_its_stored_numbering(fx):
    """Both branches of the scan read the stored numbers; no range partitioning is planned again."""
    from slatework.operators import scan
    out = scan.prefix_count(fx.claims, ["token"], ["claimed_at", "id"])
    assert "rangepartitioning" not in _plan(out).lower()
    assert any("/positions-" in f for f in out.inputFiles())


def test_hot_workspace_is_written_by_many_tasks(spark, tmp_path):
    from slatework.sources import export as S
    keep = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        df = spark.range(0, 300_000, 1, 8).select("id", F.lit(1).alias("workspace_id"), F.md5(F.col("id").cast("string")).alias("title"))
        path = S.write_snapshot(df, str(tmp_path), "content_items")
        files = spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().count()
        assert files > 4 and spark.read.parquet(path).count() == 300_000
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", keep)


def test_calendar_json_text_and_empty_workspaces(spark):
    import datetime as dt
    import json

    from slatework.sources import export as S
    day = dt.date(2026, 3, 4)
    items = spark.createDataFrame([(1, 7, "A", "d", day, 9), (2, 7, "B", "", day, None)],
                                  "id long, workspace_id long, title string, description string, scheduled_date date, created_by long")
    counts = spark.createDataFrame([(7, day, 2)], "workspace_id long, scheduled_date date, day_count long")
    lines, by_day = S.calendar_json(items, counts, spark.createDataFrame([(7,), (8,)], "id long"))
    assert sorted((json.loads(r.item_json) for r in lines.collect()), key=lambda x: x["id"]) == [
        {"id": 1, "workspace_id": 7, "title": "A", "description": "d", "scheduled_date": "2026-03-04", "created_by": 9},
        {"id": 2, "workspace_id": 7, "title": "B", "description": "", "scheduled_date": "2026-03-04"}]
    assert {r.workspace_id: json.loads(r.counts_json) for r in by_day.collect()} == {7: {"2026-03-04": 2}, 8: {}}


def test_streams_take_string_ids(spark, tmp_path):
    import datetime as dt

    from slatework.streaming import streams as S
    at = dt.datetime(2026, 1, 1)
    claims = spark.createDataFrame([(f"c{i}", "tok", f"u{i}", at + dt.timedelta(hours=i)) for i in range(5)],
                                   "id string, token string, user_id string, claimed_at timestamp_ntz")
    claims.write.parquet(str(tmp_path / "claims"))
    invites = spark.createDataFrame([("w1", "tok", 3, 1, at + dt.timedelta(days=9))],
                                    "workspace_id string, token string, max_uses int, use_count int, expires_at timestamp_ntz")
    stream = spark.readStream.schema(claims.schema).parquet(str(tmp_path / "claims"))
    members = spark.createDataFrame([("w1", "u1", "cm")], "workspace_id string, user_id string, role string")
    out = S.run_to_table(spark, S.claims_stream(stream, invites, members), str(tmp_path), "c")
    assert sorted((r.id, r.role, r.new_member) for r in out.filter("verdict = 'accepted'").collect()) == [("c0", "viewer", True), ("c1", "cm", False)]
    assert sorted((r.id, r.workspace_id, r.verdict) for r in out.collect()) == [
        ("c0", "w1", "accepted"), ("c1", "w1", "accepted"), ("c2", "w1", "unusable"), ("c3", "w1", "unusable"), ("c4", "w1", "unusable")]
    req = spark.createDataFrame([("r1", "i1", "review", at), ("r2", "i1", "review", at + dt.timedelta(hours=1))],
                                "id string, content_item_id string, to_status string, requested_at timestamp_ntz")
    req.write.parquet(str(tmp_path / "req"))
    stream = spark.readStream.schema(req.schema).parquet(str(tmp_path / "req"))
    items = spark.createDataFrame([("i1", "draft")], "id string, status string")
    out = S.run_to_table(spark, S.transitions_stream(stream, items), str(tmp_path), "t")
    assert sorted((r.id, r.verdict) for r in out.collect()) == [("r1", "accepted"), ("r2", "invalid_transition")]
