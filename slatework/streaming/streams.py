"""R1 ``transitions_stream`` and R2 ``claims_stream``: the request logs as streams.

Requests are judged on arrival, as the application judges them; inside one
micro-batch they are in (time, id) order. One key (an item, a token) may hold
most rows of a micro-batch, so no step groups rows by the key alone:

1. *Slices.* A row belongs to the slice (key, time // ``seconds``), and slices
   are dealt to as many buckets as there are shuffle partitions. Each bucket
   reduces its rows to one narrow row per slice: R1 to the function on statuses
   that its requests compose to, R2 to the number of claims that use quota.
2. *State.* The stateful step, grouped by the key, sees only the narrow rows.
   It applies them in order to the key's state (a status, a count) and gives
   the state each slice starts from.
3. *Verdicts.* Rows and starts meet in the slice's bucket again, where each row
   is judged.

R2 has a second stateful step: whether an accepted claim is the first of its
(workspace, user). Each bucket marks its first one; only these rows are grouped
by (workspace, user), all others pass the step spread over the buckets.

Steps 1 and 3 keep nothing between micro-batches. State lives in the RocksDB
state store, and the checkpoint makes a restarted query resume where it
stopped. The slice width should be small against a micro-batch's span of time:
rows of one key and one slice share a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import (ArrayType, BooleanType, IntegerType, LongType, StringType, StructField,
                               StructType)

from ..functions import enums as E
from ..functions import scalars as X
from ..operators.workflow import _N_STATES

SLICE_SECONDS = 60
SALTS = 16
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _sliced(rows: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """Add ``_slice`` (rows without a time come first, as they sort) and ``_bucket``."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.unix_micros(F.col(time).cast("timestamp"))
    rows = rows.withColumn("_slice", F.coalesce(F.floor(at / (seconds * 1_000_000)).cast("long"), F.lit(-(1 << 62))))
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(key, "_slice"), F.lit(n)).cast("int"))


def _salted(rows: DataFrame, static: DataFrame, on: list[tuple[str, str]], salt_by: str) -> DataFrame:
    """Left join with a narrow static table that is repeated ``SALTS`` times, so a hot key is dealt out.

    Spark's size of the table knows nothing of the repeats, so it is told not to broadcast them through the driver."""
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
    right = static.withColumn("_rsalt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cond = F.col("_salt") == F.col("_rsalt")
    for a, b in on:
        cond = cond & (F.col(a) == F.col(b))
    return left.join(right.hint("merge"), cond, "left").drop("_salt", "_rsalt")


def _meet(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows and slice starts (``_start`` not null) in one frame, grouped by bucket."""
    wide = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in starts.schema if f.name not in rows.columns})
    wide = wide.withColumn("_is_start", F.lit(False))
    return wide.unionByName(starts.withColumn("_is_start", F.lit(True)), allowMissingColumns=True)


def _ordered(table: pa.Table, *by: str) -> pa.Table:
    return table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in by], null_placement="at_start"))


def _runs(table: pa.Table, *by: str) -> tuple[list[tuple], np.ndarray]:
    """Of a sorted table: the values of each run of equal ``by``, and where it starts."""
    values = list(zip(*(table.column(c).to_pylist() for c in by), strict=True))
    starts = [i for i, v in enumerate(values) if not i or v != values[i - 1]]
    return [values[i] for i in starts], np.array([*starts, len(values)])


# R1 ------------------------------------------------------------------------
def _compose(targets: list[str], index: dict[str, int], source: dict[str, int]) -> list[int]:
    """Requests as one function: the state after them for each state before."""
    state = list(range(_N_STATES))
    for t in targets:
        p, to = source.get(t), index[t]
        state = [to if s == p else s for s in state]
    return state


def _machine() -> tuple[dict[str, int], dict[str, int]]:
    """Index of each status (0: a stored one outside the enum), and of the one it is reached from."""
    index = {s: i for i, s in enumerate(E.STATUSES, start=1)}
    return index, {s: index[p] for s, p in E.predecessor().items()}


def _functions(table: pa.Table) -> pa.Table:
    """One row per slice of a bucket with the function its requests compose to."""
    index, source = _machine()
    t = _ordered(table.drop_columns(["_bucket"]), "content_item_id", "_slice", "requested_at", "id")
    keys, at = _runs(t, "content_item_id", "_slice")
    targets = t.column("to_status").to_pylist()
    return pa.table([pa.array([k for k, _ in keys], t.schema.field("content_item_id").type), pa.array([s for _, s in keys], pa.int64()),
                     pa.array([_compose(targets[a:b], index, source) for a, b in zip(at, at[1:])], pa.list_(pa.int32()))],
                    names=["content_item_id", "_slice", "_fn"])


class _Status(StatefulProcessor):
    """State of an item: its status. Gives the status each slice starts from."""

    def init(self, handle) -> None:
        self.status = handle.getValueState("status", "status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        index, _ = _machine()
        rows = sorted(rows, key=lambda r: r._slice)
        current = self.status.get()[0] if self.status.exists() else rows[0].status
        for r in rows:
            yield Row(content_item_id=r.content_item_id, _slice=r._slice, _bucket=r._bucket, _start=current)
            to = r._fn[index.get(current, 0)]
            current = E.STATUSES[to - 1] if to else current
        self.status.update((current,))

    def close(self) -> None:
        pass


def _judge_transitions(table: pa.Table) -> pa.Table:
    """Verdicts of a bucket's requests; a slice without a start has no item."""
    index, source = _machine()
    begun = table.filter(table.column("_is_start"))
    begin = dict(zip(zip(begun.column("content_item_id").to_pylist(), begun.column("_slice").to_pylist()), begun.column("_start").to_pylist()))
    found = set(begin)
    rows = _ordered(table.filter(pc.invert(table.column("_is_start"))), "content_item_id", "_slice", "requested_at", "id")
    before, verdicts = [], []
    for key, target in zip(zip(rows.column("content_item_id").to_pylist(), rows.column("_slice").to_pylist()), rows.column("to_status").to_pylist()):
        current = begin.get(key)
        before.append(current)
        if key not in found:
            verdicts.append("not_found")
        elif target in source and source[target] == index.get(current, 0):
            verdicts.append("accepted")
            begin[key] = target
        else:
            verdicts.append("invalid_transition")
    return pa.table([*(rows.column(c) for c in ("id", "content_item_id", "to_status")), pa.array(before, pa.string()),
                     pa.array(verdicts, pa.string()), rows.column("requested_at")],
                    names=["id", "content_item_id", "to_status", "from_status", "verdict", "requested_at"])


def transitions_stream(requests: DataFrame, items: DataFrame, seconds: int = SLICE_SECONDS) -> DataFrame:
    """Streaming M4. ``requests`` is a streaming frame (id, content_item_id,
    to_status, requested_at); ``items`` the static table of current statuses.
    Returns a streaming frame of verdicts: id, content_item_id, to_status,
    from_status, verdict, requested_at."""
    r = requests.select("id", "content_item_id", "to_status", "requested_at")
    kinds = {f.name: f for f in r.schema}
    out = StructType([kinds["id"], kinds["content_item_id"], kinds["to_status"], StructField("from_status", StringType()),
                      StructField("verdict", StringType()), kinds["requested_at"]])
    enum_ok = F.coalesce(X.enum_ok("to_status", "status"), F.lit(False))
    direct = r.filter(~enum_ok).select("id", "content_item_id", "to_status", F.lit(None).cast("string").alias("from_status"),
                                       F.lit("invalid_enum").alias("verdict"), "requested_at")
    rows = _sliced(r.filter(enum_ok), "content_item_id", "requested_at", seconds)
    narrow = rows.groupBy("_bucket").applyInArrow(_functions, StructType([
        kinds["content_item_id"], StructField("_slice", LongType()), StructField("_fn", ArrayType(IntegerType()))]))
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    it = items.select(F.col("id").alias("_iid"), "status")
    known = narrow.join(it, F.col("content_item_id") == F.col("_iid")).drop("_iid")
    known = known.withColumn("_bucket", F.pmod(F.xxhash64("content_item_id", "_slice"), F.lit(n)).cast("int"))
    starts = known.groupBy("content_item_id").transformWithState(_Status(), StructType([
        kinds["content_item_id"], StructField("_slice", LongType()), StructField("_bucket", IntegerType()),
        StructField("_start", StringType())]), "Append", "None")
    return _meet(rows, starts).groupBy("_bucket").applyInArrow(_judge_transitions, out).unionByName(direct)


# R2 ------------------------------------------------------------------------
def _counts(table: pa.Table) -> pa.Table:
    """One row per slice of a bucket with the number of its claims."""
    t = _ordered(table.select(["token", "_slice"]), "token", "_slice")
    keys, at = _runs(t, "token", "_slice")
    return pa.table([pa.array([k for k, _ in keys], t.schema.field("token").type), pa.array([s for _, s in keys], pa.int64()),
                     pa.array(np.diff(at), pa.int64())], names=["token", "_slice", "_n"])


class _Quota(StatefulProcessor):
    """State of a token: the claims so far that were in time. Gives their number before each slice."""

    def init(self, handle) -> None:
        self.used = handle.getValueState("used", "used long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        used = self.used.get()[0] if self.used.exists() else 0
        for r in sorted(rows, key=lambda r: r._slice):
            yield Row(token=r.token, _slice=r._slice, _bucket=r._bucket, _start=used)
            used += r._n
        self.used.update((used,))

    def close(self) -> None:
        pass


_CLAIM = ["id", "token", "user_id", "claimed_at", "workspace_id"]


def _judge_claims(table: pa.Table) -> pa.Table:
    """Verdicts of a bucket's claims that are in time; ``_first`` marks the bucket's first
    accepted one of a (workspace, user)."""
    begun = table.filter(table.column("_is_start"))
    begin = dict(zip(zip(begun.column("token").to_pylist(), begun.column("_slice").to_pylist()), begun.column("_start").to_pylist()))
    rows = _ordered(table.filter(pc.invert(table.column("_is_start"))), "token", "_slice", "claimed_at", "id")
    keys, at = _runs(rows, "token", "_slice")
    sizes = np.diff(at)
    prior = np.arange(len(rows)) - np.repeat(at[:-1], sizes) + np.repeat([begin[k] for k in keys] or [0], sizes if keys else [0])
    fits = rows.column("use_count").to_numpy() + prior < rows.column("max_uses").to_numpy()
    # within a bucket the first of a pair is the one with the least (time, id)
    first: dict[tuple, tuple] = {}
    who = list(zip(rows.column("workspace_id").to_pylist(), rows.column("user_id").to_pylist()))
    times, ids = rows.column("claimed_at").to_pylist(), rows.column("id").to_pylist()
    for i in np.flatnonzero(fits).tolist():
        place = (times[i] is not None, times[i], ids[i], i)
        if who[i] not in first or place[:3] < first[who[i]][:3]:
            first[who[i]] = place
    mark = np.zeros(len(rows), bool)
    mark[[p[3] for p in first.values()]] = True
    return pa.table([*(rows.column(c) for c in _CLAIM), pa.array(np.where(fits, "accepted", "unusable"), pa.string()), pa.array(mark)],
                    names=[*_CLAIM, "verdict", "_first"])


def _joined(row: Row, new_member: bool) -> Row:
    values = row.asDict()
    return Row(**{c: values[c] for c in row.__fields__ if c not in ("_w", "_u", "_spread")}, new_member=new_member)


class _FirstJoin(StatefulProcessor):
    """State of a (workspace, user): whether it has joined. Rows with a ``_spread`` pass."""

    def init(self, handle) -> None:
        self.joined = handle.getValueState("joined", "joined boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[2] is not None:
            for r in rows:
                yield _joined(r, False)
            return
        # at most one row of each bucket
        rows = sorted(rows, key=lambda r: (r.claimed_at is not None, r.claimed_at, r.id))
        new = not self.joined.exists()
        for i, r in enumerate(rows):
            yield _joined(r, new and i == 0)
        self.joined.update((True,))

    def close(self) -> None:
        pass


def claims_stream(claims: DataFrame, invites: DataFrame, memberships: DataFrame, seconds: int = SLICE_SECONDS) -> DataFrame:
    """R2: streaming M6. ``claims`` is a streaming frame (id, token, user_id,
    claimed_at); ``invites`` and ``memberships`` are static. Returns the rows of
    M6: id, token, user_id, claimed_at, workspace_id, verdict, role,
    new_member, field. ``invites.after_claims`` turns them into tables."""
    inv = invites.select(F.col("token").alias("_tok"), "workspace_id", "max_uses", "use_count", "expires_at")
    c = _salted(claims.select("id", "token", "user_id", "claimed_at"), inv, [("token", "_tok")], "id")
    kinds = {f.name: f for f in c.schema}
    known = F.col("_tok").isNotNull()
    late = F.coalesce(X.invite_expired("expires_at", "claimed_at"), F.lit(False))
    direct = c.filter(~known | late).select(
        *_CLAIM, F.when(~known, "not_found").otherwise("unusable").alias("verdict"), F.lit(False).alias("_first"))
    rows = _sliced(c.filter(known & ~late).select(*_CLAIM, "max_uses", "use_count"), "token", "claimed_at", seconds)
    n = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = rows.groupBy("_bucket").applyInArrow(_counts, StructType([
        kinds["token"], StructField("_slice", LongType()), StructField("_n", LongType())]))
    narrow = narrow.withColumn("_bucket", F.pmod(F.xxhash64("token", "_slice"), F.lit(n)).cast("int"))
    starts = narrow.groupBy("token").transformWithState(_Quota(), StructType([
        kinds["token"], StructField("_slice", LongType()), StructField("_bucket", IntegerType()),
        StructField("_start", LongType())]), "Append", "None")
    judged = _meet(rows, starts).groupBy("_bucket").applyInArrow(_judge_claims, StructType([
        *[kinds[x] for x in _CLAIM], StructField("verdict", StringType()), StructField("_first", BooleanType())]))
    m = memberships.select(F.col("workspace_id").alias("_mw"), F.col("user_id").alias("_mu"), F.col("role").alias("_role"))
    v = _salted(judged.unionByName(direct), m, [("workspace_id", "_mw"), ("user_id", "_mu")], "id")
    accepted = F.col("verdict") == "accepted"
    joins = F.col("_first") & F.col("_mw").isNull()
    v = v.select(*_CLAIM, "verdict", F.when(accepted, F.coalesce("_role", F.lit(E.DEFAULT_ROLE))).alias("role"),
                 F.when(~accepted, F.lit("token")).alias("field"),
                 F.when(joins, F.col("workspace_id")).alias("_w"), F.when(joins, F.col("user_id")).alias("_u"),
                 F.when(~joins, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).alias("_spread"))
    out = StructType([*v.schema.fields[:-3], StructField("new_member", BooleanType())])
    return v.groupBy("_w", "_u", "_spread").transformWithState(_FirstJoin(), out, "Append", "None")


def run_to_table(spark: SparkSession, stream: DataFrame, root: str, name: str, run: str | None = None) -> DataFrame:
    """Run ``stream`` over all data available now into a Parquet table under
    ``root`` (shared storage, with its checkpoint beside it) and return the
    table as a batch DataFrame. A call with the ``run`` of an earlier one
    resumes it: only what came since is judged, and the table grows.

    The stateful steps need the RocksDB state store; the query is started
    with it, and the session's setting is put back.
    """
    base = f"{root.rstrip('/')}/streams/{name}/{run or uuid.uuid4().hex}"
    keep = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        q = (stream.writeStream.format("parquet").outputMode("append")
             .option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
             .trigger(availableNow=True).start())
    finally:
        spark.conf.set(_STORE, keep)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
