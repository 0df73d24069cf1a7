"""Content status workflow: M3 ``apply_transitions`` and M4 ``replay_transitions``.

Verdict order for a status request: status enum -> item not found ->
transition allowed from the status the item has at that moment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import enums as E
from ..functions import scalars as X
from . import scan

# State index: 0 = a stored status outside the enum (no way out), 1.. = STATUSES.
_N_STATES = len(E.STATUSES) + 1


def status_index(col: Column) -> Column:
    expr = F.lit(0)
    for i, s in enumerate(E.STATUSES, start=1):
        expr = F.when(col == s, F.lit(i)).otherwise(expr)
    return expr


def status_name(idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in E.STATUSES]), idx)


def _pred_index(target_idx: Column) -> Column:
    """Index of the only status a target may be reached from (-1 if none)."""
    pred = E.predecessor()
    arr = [F.lit(E.STATUSES.index(pred[s]) + 1 if s in pred else -1) for s in E.STATUSES]
    return F.element_at(F.array(*arr), target_idx)


def _step(target_idx: Column) -> Column:
    """A request as a function on states: go to the target from its source."""
    p = _pred_index(target_idx)
    return F.transform(F.sequence(F.lit(0), F.lit(_N_STATES - 1)),
                       lambda s: F.when(s == p, target_idx).otherwise(s))


def _attach_items(requests: DataFrame, items: DataFrame, scoped: bool) -> DataFrame:
    it = items.select(F.col("id").alias("_iid"), F.col("workspace_id").alias("_iws"),
                      F.col("status").alias("current_status"))
    cond = F.col("content_item_id") == F.col("_iid")
    if scoped:
        cond = cond & (F.col("workspace_id") == F.col("_iws"))
    return requests.join(it, cond, "left").withColumn("_found", F.col("_iid").isNotNull())


def _verdict_columns(enum_ok: Column, found: Column, allowed: Column) -> Column:
    return (F.when(~enum_ok, F.lit("invalid_enum"))
            .when(~found, F.lit("not_found"))
            .when(allowed, F.lit("accepted"))
            .otherwise(F.lit("invalid_transition")))


def apply_transitions(items: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M3: status requests, judged against the stored status of their item.

    ``requests``: id, content_item_id, to_status, requested_at and optional
    workspace_id (then an item of another workspace is not found). Returns
    (verdicts, new items). Several requests for one item are in time order, each
    sees the status that the one before it left: that is ``replay_transitions``,
    which reads requests and items once whatever the number per item.
    """
    return replay_transitions(items, requests)


def replay_transitions(items: DataFrame, requests: DataFrame, block: int = scan.DEFAULT_BLOCK
                       ) -> tuple[DataFrame, DataFrame]:
    """M4: a log of status requests, many per item, in (requested_at, id)
    order; each is judged against the status left by the ones before it.

    Every request runs through ``scan.state_scan`` as a function on the six
    states (a request with a bad status or an unknown item is the identity
    and is judged by its flags), composed per block, per block group and
    per item, so an item with a huge log is spread over many tasks. One
    pass over the requests, no second copy of the item join.
    Returns (verdicts, new items with status and updated_at of the last
    accepted request).
    """
    scoped = "workspace_id" in requests.columns
    r = _attach_items(requests, items, scoped)
    enum_ok = X.enum_ok("to_status", "status")
    # One pass: a request with an unknown status or item is a no-op step
    # (the identity function); its verdict comes from the flags below.
    t = status_index(F.col("to_status"))
    live = (r.withColumn("_ok", enum_ok & F.col("_found"))
            .withColumn("_t", F.when(F.col("_ok"), t).otherwise(F.lit(0)))
            .withColumn("_start", status_index(F.col("current_status"))))
    identity = F.sequence(F.lit(0), F.lit(_N_STATES - 1))
    step = F.when(F.col("_ok"), _step(F.col("_t"))).otherwise(identity)
    keys = ["content_item_id"] + (["workspace_id"] if scoped else [])
    payload = list(dict.fromkeys([*requests.columns, "current_status", "_t", "_ok", "_found"]))
    # the stored status came with the item join; it is the start state of the key
    rows, finals = scan.state_scan(live, keys, ["requested_at", "id"], step, _N_STATES,
                                   "_start", payload, block=block)
    sb = F.col("state_before")
    ok_enum = X.enum_ok("to_status", "status")
    judged = rows.select(
        *requests.columns,
        F.when(F.col("_ok"), F.when(sb == 0, F.col("current_status")).otherwise(status_name(sb)))
        .alias("from_status"),
        F.when(~ok_enum, F.lit("invalid_enum"))
        .when(~F.col("_found"), F.lit("not_found"))
        .when(sb == _pred_index(F.col("_t")), F.lit("accepted"))
        .otherwise(F.lit("invalid_transition")).alias("verdict"))
    verdicts = judged.withColumn("field", F.when(F.col("verdict").isin("invalid_enum", "invalid_transition"),
                                                   F.lit("status")).when(F.col("verdict") == "not_found",
                                                                         F.lit("content_item")))
    last = (judged.filter(F.col("verdict") == "accepted")
            .groupBy(*keys).agg(F.max("requested_at").alias("_at")))
    fin = finals.join(last, keys, "left").select(
        F.col("content_item_id").alias("_cid"), *([F.col("workspace_id").alias("_cws")] if scoped else []),
        F.when(F.col("final_state") > 0, status_name(F.col("final_state"))).alias("_new"), "_at")
    cond = items["id"] == fin["_cid"]
    if scoped:
        cond = cond & (items["workspace_id"] == fin["_cws"])
    new_items = (items.join(fin, cond, "left")
                 .withColumn("status", F.coalesce("_new", "status"))
                 .withColumn("updated_at", F.coalesce("_at", "updated_at"))
                 .drop(*[c for c in ("_cid", "_cws", "_new", "_at") if c in fin.columns]))
    return verdicts, new_items
