"""Registered streaming jobs (R1, R2), run to completion over the request logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.export import shared_root
from ..sources.fixtures import FIXTURE_SQL
from ..streaming import streams as S
from .change_queries import _CLAIMS_SQL, _REPLAY_SQL
from .registry import register


def _event_stream(fx):
    """The events table read as a stream (one file per trigger)."""
    schema = fx.base("events").schema
    return (fx.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .option("pathGlobFilter", "events.parquet").parquet(fx.sf_dir))


def _derive(fx, name, events):
    body = FIXTURE_SQL[name].replace("{TS}", "timestamp_ntz").strip()
    return fx.spark.sql(body, events=events)


@register("transitions_stream", uses=("transition_requests", "content_items"), sql=_REPLAY_SQL)
def transitions_stream(fx):
    """The status request log as a stream, judged against the statuses
    left by earlier requests (state per item)."""
    req = _derive(fx, "transition_requests", _event_stream(fx))
    out = S.run_to_table(fx.spark, S.transitions_stream(req, fx.content_items), shared_root(fx.spark), "transitions")
    return out.select("id", "content_item_id", "to_status", "from_status", "verdict")


@register("claims_stream", uses=("claims", "invites", "memberships"), sql=_CLAIMS_SQL)
def claims_stream(fx):
    """R2: invite claims as a stream, judged against expiry, the quota used so
    far (state per token) and the joins so far (state per workspace and user)."""
    claims = _derive(fx, "claims", _event_stream(fx))
    out = S.run_to_table(fx.spark, S.claims_stream(claims, fx.invites, fx.memberships), shared_root(fx.spark), "claims")
    return out.select("id", "token", "user_id", F.col("workspace_id").cast("bigint").alias("workspace_id"), "verdict",
                      "role", "new_member")
