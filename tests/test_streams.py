"""The request logs as streams: hot keys inside a micro-batch, several micro-batches, a restart."""

import datetime as dt

from pyspark.sql import functions as F

from slatework.operators import invites as I
from slatework.operators import workflow as W
from slatework.streaming import streams as S

T0 = dt.datetime(2026, 1, 1)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_a_hot_item_in_one_batch_over_many_tasks(spark, tmp_path):
    n = 100_000
    names = F.array(*[F.lit(s) for s in ("review", "approved", "published", "draft", "archived", "deleted")])
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 7919).cast("timestamp_ntz")
    req = spark.range(0, n, 1, 8).select(
        "id", F.when(F.col("id") % 50 == 0, F.col("id") % 40).otherwise(1).alias("content_item_id"),
        F.element_at(names, (F.xxhash64("id") % 3 + 3).cast("int")).alias("to_status"), at.alias("requested_at"))
    items = spark.createDataFrame([(i, ["draft", "review", "odd"][i % 3]) for i in range(1, 30)], "id long, status string")
    req.coalesce(1).write.parquet(str(tmp_path / "req"))
    req = spark.read.parquet(str(tmp_path / "req"))
    stream = spark.readStream.schema(req.schema).parquet(str(tmp_path / "req"))
    out = S.run_to_table(spark, S.transitions_stream(stream, items), str(tmp_path), "t")
    want, _ = W.replay_transitions(items.withColumns({"workspace_id": F.lit(1), "updated_at": F.lit(T0)}), req)
    cols = ("id", "content_item_id", "to_status", "from_status", "verdict")
    assert rows(out, *cols) == rows(want, *cols)
    # the item's rows are dealt to all tasks
    dealt = S._sliced(req.filter("content_item_id = 1"), "content_item_id", "requested_at", S.SLICE_SECONDS).groupBy("_bucket").count().collect()
    assert len(dealt) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in dealt) < n / 2


def test_claims_over_micro_batches_and_a_restart_equal_the_batch(spark, tmp_path):
    claims = spark.range(0, 4000).select(
        "id", F.when(F.col("id") % 61 == 0, "nowhere").when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 17).cast("string"))).alias("token"),
        F.when(F.col("id") % 97 > 0, F.pmod(F.xxhash64("id"), F.lit(300)) + (1 << 60)).alias("user_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7).cast("timestamp_ntz").alias("claimed_at"))
    late = dt.datetime(2023, 11, 15, 3)  # most claims of every fourth token come after it
    invites = spark.createDataFrame(
        [(99, 5, "hot", 1500, 20, dt.datetime(2030, 1, 1))] + [(i, i % 3, f"t{i}", 60, i, late if i % 4 == 0 else dt.datetime(2030, 1, 1)) for i in range(17)],
        "id long, workspace_id long, token string, max_uses int, use_count int, expires_at timestamp_ntz")
    members = spark.createDataFrame([(5, (1 << 60) + u, "cm", T0) for u in range(0, 300, 7)],
                                    "workspace_id long, user_id long, role string, joined_at timestamp_ntz")
    src = str(tmp_path / "claims")

    def arrive(lo, hi):
        claims.filter(F.col("id").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema(claims.schema).option("maxFilesPerTrigger", 1).parquet(src)
        return S.run_to_table(spark, S.claims_stream(stream, invites, members), str(tmp_path), "c", run="log")

    want, want_members, want_invites = I.claim_invites(invites, members, claims)
    cols = ("id", "token", "user_id", "workspace_id", "claimed_at", "verdict", "role", "new_member", "field")
    arrive(0, 900)
    arrive(900, 1000)
    assert run().count() == 1000
    arrive(1000, 3000)
    arrive(3000, 4000)
    out = run()  # resumes: only what came since is judged
    assert rows(out, *cols) == rows(want, *cols)
    assert {r.verdict for r in out.select("verdict").distinct().collect()} == {"accepted", "unusable", "not_found"}
    got_members, got_invites = I.after_claims(out, members, invites)
    assert rows(got_members, *members.columns) == rows(want_members, *members.columns)
    assert rows(got_invites, *invites.columns) == rows(want_invites, *invites.columns)


def test_rows_without_a_time_or_an_item(spark, tmp_path):
    req = spark.createDataFrame([(1, 1, "review", None), (2, 1, "review", T0), (3, None, "review", T0), (4, 9, "draft", T0), (5, 1, None, T0)],
                                "id long, content_item_id long, to_status string, requested_at timestamp_ntz")
    req.write.parquet(str(tmp_path / "req"))
    items = spark.createDataFrame([(1, "draft")], "id long, status string")
    stream = spark.readStream.schema(req.schema).parquet(str(tmp_path / "req"))
    out = S.run_to_table(spark, S.transitions_stream(stream, items), str(tmp_path), "t")
    assert rows(out, "id", "verdict") == [(1, "accepted"), (2, "invalid_transition"), (3, "not_found"), (4, "not_found"), (5, "invalid_enum")]
    assert spark.conf.get(S._STORE) != S._ROCKS


def test_repeated_tables_are_not_broadcast(spark):
    rows = spark.range(5).select("id", F.col("id").alias("token"))
    static = spark.range(3).select(F.col("id").alias("_tok"))
    out = S._salted(rows, static, [("token", "_tok")], "id")
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r._tok) for r in out.collect() if r._tok is not None) == [(i, i) for i in range(3)] and out.count() == 5
