"""Edge cases of the scalar rules (FIXTURES.md sections 1 and 3)."""

import datetime as dt

from pyspark.sql import functions as F

from slatework.functions import enums as E
from slatework.functions import scalars as X


def test_strict_date(spark):
    cases = [(None, True), ("", True), ("2026-06-15", True), ("2028-02-29", True),
             ("not-a-date", False), ("2026/06/15", False), ("2026-6-5", False), ("2026-02-30", False),
             ("2026-13-01", False), ("2026-06-5", False), ("2026-6-05", False), ("2026-06-15T00:00:00Z", False)]
    df = spark.createDataFrame(cases, "v string, ok boolean")
    got = df.select("ok", X.strict_date_ok("v").alias("got")).collect()
    assert all(r.ok == r.got for r in got)


def test_month_start(spark):
    df = spark.createDataFrame([("2026-01",), ("2026-12",), ("",), ("not-a-month",), ("2026-1",), ("2026-13",)],
                               "m string")
    got = [r.s for r in df.select(X.month_start("m", F.lit("2026-06-20")).alias("s")).collect()]
    assert got == [dt.date(2026, 1, 1), dt.date(2026, 12, 1), dt.date(2026, 6, 1), None, None, None]
    nxt = df.limit(2).select(X.next_month_start(X.month_start("m", F.lit("2026-06-20"))).alias("n")).collect()
    assert [r.n for r in nxt] == [dt.date(2026, 2, 1), dt.date(2027, 1, 1)]


def test_transitions(spark):
    valid = {(a, b) for a, bs in E.TRANSITIONS.items() for b in bs}
    pairs = [(a, b) for a in E.STATUSES for b in E.STATUSES]
    df = spark.createDataFrame(pairs, "f string, t string")
    got = df.select("f", "t", X.is_valid_transition("f", "t").alias("ok")).collect()
    assert {(r.f, r.t) for r in got if r.ok} == valid
    assert len(valid) == 5
    al = spark.createDataFrame([("review",), ("archived",), ("bogus",)], "s string").select(
        X.allowed_transitions("s").alias("a")).collect()
    assert [r.a for r in al] == [["draft", "approved"], [], None]


def test_invite_expiry_is_exclusive(spark):
    t = dt.datetime(2026, 1, 1, 12, 0, 0)
    df = spark.createDataFrame([(t, t), (t, t + dt.timedelta(seconds=1)), (t, t - dt.timedelta(seconds=1))],
                               "e timestamp_ntz, at timestamp_ntz")
    got = [r.x for r in df.select(X.invite_expired("e", "at").alias("x")).collect()]
    assert got == [False, True, False]


def test_handles(spark):
    df = spark.createDataFrame([(None,), ("null",), ('{"ig":"@a"}',)], "h string")
    got = [r.m for r in df.select(X.handles_map("h").alias("m")).collect()]
    assert got == [{}, {}, {"ig": "@a"}]


def test_author_label(spark):
    df = spark.createDataFrame([("Ann", "a@x", 1), ("", "b@x", 2), ("", "", 3), (None, None, 4)],
                               "n string, e string, i long")
    got = [r.l for r in df.select(X.author_label("n", "e", "i").alias("l")).collect()]
    assert got == ["Ann", "b@x", "3", "4"]


def test_invite_defaults(spark):
    df = spark.createDataFrame([(0, 0), (-3, 5), (4, -1)], "m int, h int")
    at = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    got = df.select(X.invite_max_uses("m").alias("m"), X.invite_expires_at(at, F.col("h")).alias("e")).collect()
    assert [r.m for r in got] == [10, 10, 4]
    assert [r.e for r in got] == [dt.datetime(2026, 1, 8), dt.datetime(2026, 1, 1, 5), dt.datetime(2026, 1, 8)]
