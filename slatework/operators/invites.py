"""Invite claims (M6) and invite state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import enums as E
from ..functions import scalars as X
from . import scan
from .settle import ACCEPTED, first_wins


def invite_state(invites: DataFrame, as_of) -> DataFrame:
    """Expired / exhausted / usable at ``as_of``."""
    at = F.lit(as_of).cast("timestamp_ntz")
    return invites.withColumns({
        "expired": X.invite_expired("expires_at", at),
        "exhausted": X.invite_exhausted("use_count", "max_uses"),
    }).withColumn("usable", ~F.col("expired") & ~F.col("exhausted"))


def claim_invites(invites: DataFrame, memberships: DataFrame, claims: DataFrame
                  ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Judge invite claims in (claimed_at, id) order.

    claims: id, token, user_id, claimed_at. Each claim is judged at its own
    time: unknown token -> 'not_found'; expired at claimed_at (strictly
    after expires_at) -> 'unusable', using no quota; otherwise accepted
    while use_count + earlier non-expired claims of that token < max_uses,
    else 'unusable'. Claims by existing members use quota too and keep
    their role; a new member joins as viewer at the first accepted claim.

    The number of earlier claims per token is ``scan.prefix_count``: exact
    and spread over many tasks even if one token gets most of the claims.
    Returns (verdicts, memberships, invites).
    """
    inv = invites.select(F.col("token").alias("_tok"), F.col("id").alias("invite_id"), "workspace_id",
                         "max_uses", "use_count", "expires_at")
    c = claims.join(inv, claims["token"] == inv["_tok"], "left").drop("_tok")
    known = F.col("invite_id").isNotNull()
    expired = X.invite_expired("expires_at", "claimed_at")
    direct = c.filter(~known | expired).select(
        *claims.columns, "workspace_id",
        F.when(~known, "not_found").otherwise("unusable").alias("verdict"))
    live = c.filter(known & ~expired)
    ranked = scan.prefix_count(live, ["token"], ["claimed_at", "id"], out="_prior")
    judged = ranked.select(
        *claims.columns, "workspace_id",
        F.when(F.col("use_count") + F.col("_prior") < F.col("max_uses"), ACCEPTED).otherwise("unusable")
        .alias("verdict"))
    v = judged.unionByName(direct)
    m = memberships.select(F.col("workspace_id").alias("_mw"), F.col("user_id").alias("_mu"),
                           F.col("role").alias("_role"))
    v = v.join(m, (F.col("workspace_id") == F.col("_mw")) & (F.col("user_id") == F.col("_mu")), "left")
    acc = F.col("verdict") == ACCEPTED
    joins = acc & F.col("_mw").isNull()
    # the first join of a (workspace, user) by (claimed_at, id) makes the member; the marking never joins on the claim's id
    v = v.select(*claims.columns, "workspace_id", F.col("verdict").alias("_verdict"),
                 F.when(acc, F.coalesce("_role", F.lit(E.DEFAULT_ROLE))).alias("role"),
                 F.when(joins, ACCEPTED).alias("verdict"), F.lit(None).cast("string").alias("field"))
    v = first_wins(v, ["workspace_id", "user_id"], "later", "later", order=("claimed_at", "id"))
    verdicts = v.select(*claims.columns, "workspace_id", F.col("_verdict").alias("verdict"), "role",
                        F.coalesce(F.col("verdict") == ACCEPTED, F.lit(False)).alias("new_member"),
                        F.when(F.col("_verdict") != ACCEPTED, F.lit("token")).alias("field"))
    return verdicts, *after_claims(verdicts, memberships, invites)


def after_claims(verdicts: DataFrame, memberships: DataFrame, invites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memberships, invites) after claims with these verdicts, of a batch or a stream."""
    accepted = verdicts.filter(F.col("verdict") == ACCEPTED)
    new_members = accepted.filter("new_member").select("workspace_id", "user_id", F.lit(E.DEFAULT_ROLE).alias("role"),
                                                       F.col("claimed_at").alias("joined_at"))
    used = accepted.groupBy("token").agg(F.count(F.lit(1)).alias("_used"))
    new_invites = (invites.join(used, "token", "left")
                   .withColumn("use_count", (F.col("use_count") + F.coalesce("_used", F.lit(0))).cast("int"))
                   .select(invites.columns))
    return memberships.unionByName(new_members, allowMissingColumns=True), new_invites
