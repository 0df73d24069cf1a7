"""Point lookups on snapshots, parallel reads by uuid, narrow ordered work, error details."""

import glob
import os
import uuid

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from slatework.functions import enums as E
from slatework.functions import scalars as X
from slatework.operators import changes as M
from slatework.operators import reads as R
from slatework.operators import scan
from slatework.sources import export as S
from slatework.sources import tables as T


def _scanned(df):
    """Rows that the file scan gave, after running the query."""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return rows, sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


def test_a_few_keys_read_few_rows(spark, tmp_path):
    n = 200_000
    df = spark.range(n).select("id", (F.col("id") % 25).alias("workspace_id"), F.md5(F.col("id").cast("string")).alias("token"),
                               F.sha2(F.col("id").cast("string"), 512).alias("notes"))
    path = S.write_lookup_snapshot(df, str(tmp_path), "workspace_invites", row_group_bytes=1 << 20)
    want = {r.token: r.id for r in df.filter("id in (5, 77777, 199999)").collect()}
    rows, read = _scanned(S.lookup_few(spark, path, "token", [*want, "missing"]))
    assert {r.token: r.id for r in rows} == want
    assert read < n / 4
    rows, by_id = _scanned(S.lookup_few(spark, path, "id", [5, 77777, -1]))  # not the sort column: Bloom filters alone
    assert sorted(r.id for r in rows) == [5, 77777]
    assert by_id < n / 4
    rows, none = _scanned(S.lookup_few(spark, path, "id", [n + 5, n + 9]))
    assert rows == [] and none < n / 10
    with pytest.raises(ValueError):
        S.lookup_few(spark, path, "id", list(range(1000)))


@pytest.mark.parametrize("n", [1, 2, 16, 64])
def test_uuid_ranges_cover_every_uuid_once(spark, n):
    made = [str(uuid.UUID(int=i)) for i in (0, 1, 2**128 - 1, 2**127, 2**127 - 1, 2**124, 15 * 2**124 - 1)]
    made += [str(uuid.uuid4()) for _ in range(300)] + [None]
    df = spark.createDataFrame([(x,) for x in made], "id string")
    predicates = T.uuid_ranges("id", n)
    assert len(predicates) == n
    hits = df.select("id", sum((F.coalesce(F.expr(p), F.lit(False)).cast("int") for p in predicates), F.lit(0)).alias("n")).collect()
    assert all(r.n == 1 for r in hits)
    if n > 1:
        assert df.filter(predicates[-1]).filter("id IS NULL").count() == 1
        sizes = [df.filter(p).count() for p in predicates]
        assert max(sizes) < 10 * len(made) / n + 10
    for bad in (0, 3, 1 << 17):
        with pytest.raises(ValueError):
            T.uuid_ranges("id", bad)


def _stored_bytes(df):
    return sum(os.path.getsize(f.removeprefix("file://").removeprefix("file:")) for f in df.inputFiles() if "/positions-" in f)


def test_positions_store_no_payload(spark):
    base = spark.range(0, 300_000, 1, 8).select(
        "id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("k"), F.xxhash64("id").alias("at"))
    wide = base.withColumns({"title": F.repeat(F.md5(F.col("id").cast("string")), 10), "a.b": F.create_map(F.lit("k"), F.col("id"))})
    narrow_out = scan.prefix_count(base, ["k"], ["at", "id"])
    wide_out = scan.prefix_count(wide, ["k"], ["at", "id"])
    assert wide_out.columns == [*wide.columns, "prior"]
    w = Window.partitionBy("k").orderBy("at", "id")
    want = base.select("id", (F.row_number().over(w) - 1).alias("prior"))
    got = wide_out.filter(F.length("title") == 320).select("id", F.col("prior").cast("int"))
    assert got.exceptAll(want).count() == 0 and got.count() == 300_000
    assert narrow_out.count() == 300_000
    # two hashes a row are all that comes on top
    assert _stored_bytes(wide_out) < _stored_bytes(narrow_out) + 300_000 * 20


def test_positions_of_equal_rows(spark):
    df = spark.createDataFrame([("a", 1, "x")] * 5 + [("a", 2, "y"), (None, 1, "x"), (None, 1, "x")], "k string, at long, note string")
    got = sorted(((r.k or "", r.at, r.note, r.prior) for r in scan.prefix_count(df, ["k"], ["at"]).collect()))
    assert got == [("", 1, "x", 0), ("", 1, "x", 1)] + [("a", 1, "x", i) for i in range(5)] + [("a", 2, "y", 5)]


def test_every_order_adds_positions(spark):
    rows = [(i, i % 3, i % 2, f"n{i % 4}", f"2026-01-0{1 + i % 5}") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, workspace_id long, user_id long, name string, day string")
    day = F.col("day").cast("date")
    df = df.withColumns({"updated_at": day, "scheduled_date": day, "created_at": day, "due_date": day, "joined_at": day,
                         "workspace_name": F.col("name"), "content_item_id": F.col("workspace_id"), "extra": F.lit("x")})
    for kind, (key, _, order) in R.ORDERS.items():
        w = Window.partitionBy(key).orderBy(*order())
        if kind in ("workspaces", "members"):  # their last column is no key of this table
            assert R.ordered(df, kind).count() == 40
            continue
        a = sorted((r.id, r.position) for r in R.ordered(df, kind).collect())
        assert a == sorted((r.id, r.p) for r in df.select("id", F.row_number().over(w).alias("p")).collect()), kind


def test_error_details(spark):
    rows = [("invalid_enum", "platform", "myspace", None), ("invalid_transition", "status", "draft", "approved"),
            ("invalid_transition", "status", "draft", "archived"), ("invalid_format", "due_date", "2026-6-5", None),
            ("required", "title", "", None), ("accepted", None, None, None), ("not_found", "task", None, None)]
    df = spark.createDataFrame(rows, "code string, field string, value string, src string")
    got = df.select(X.error_message("code", "field", "value", "src").alias("m"), X.error_allowed("code", "field", "src").alias("a"),
                    X.error_expected("code").alias("e")).collect()
    assert [tuple(r) for r in got] == [
        ('invalid platform: "myspace"', E.PLATFORMS, None), ("cannot transition from approved to draft", ["published"], None),
        ("cannot transition from archived to draft", [], None), ('invalid due_date: "2026-6-5" (expected YYYY-MM-DD)', None, "YYYY-MM-DD"),
        ("title is required", None, None), (None, None, None), ("task not found", None, None)]


def test_cascade_follows_the_catalogue():
    assert M._touched({"clients"}) == {"clients": {"id"}, "content_items": {"client_id"}, "tasks": {"client_id"}}
    order = M._order(set(M._touched({"workspaces", "users"})))
    assert order.index("workspaces") < order.index("content_items") < order.index("comments") < order.index("users") < order.index("memberships")


def test_snapshot_files_hold_bloom_filters(spark, tmp_path):
    df = spark.range(1000).select("id", F.concat(F.lit("u"), F.col("id").cast("string")).alias("email"))
    path = S.write_lookup_snapshot(df, str(tmp_path), "users")
    import pyarrow.parquet as pq
    assert sum(pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{path}/*.parquet")) == 1000
    assert [r.id for r in S.lookup_few(spark, path, "email", ["u7"]).collect()] == [7]
