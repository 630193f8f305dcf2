"""Projections and predicates over runs, and what a log keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULT_POLICY, OVERLAP_POLICIES, PERSISTED_KINDS, RUN_STATUSES, TERMINAL, TIMER


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def can_claim(owner: Column, expires_at: Column, claimant: str, now: int) -> Column:
    """No lease, one's own, or one that has expired (at its very end too)."""
    return F.coalesce(owner.isNull() | (owner == claimant) | (expires_at <= now), F.lit(True))


def waits_for_signal(wait_name: Column, wait_step: Column, name: Column, step: Column) -> Column:
    """Names are equal, and so are steps where both sides name one."""
    return F.coalesce(wait_name == name, F.lit(False)) & F.coalesce(wait_step == step, F.lit(True))


def waits_for_approval(pending: Column, approval_id: Column) -> Column:
    return F.coalesce(pending == approval_id, F.lit(False))


def checked_status(status: Column) -> Column:
    """The status; an unknown one is an error."""
    return F.when(status.isin(*RUN_STATUSES), status).otherwise(F.raise_error(F.concat(F.lit("unknown status: "), F.coalesce(status, F.lit("null")))))


def checked_policy(policy: Column) -> Column:
    """The overlap policy of a schedule, by default to skip; an unknown one is an error."""
    named = F.coalesce(policy, F.lit(DEFAULT_POLICY))
    return F.when(named.isin(*OVERLAP_POLICIES), named).otherwise(F.raise_error(F.concat(F.lit("unknown overlap policy: "), named)))


def classify(runs: DataFrame) -> DataFrame:
    """run_id, kind: what a caller is told of each run (status null: no such run; then event_count decides)."""
    s = F.col("status")
    kind = (
        F.when(s == "finished", "completed").when(s == "paused", "paused").when(s.isin("errored", "aborted"), "errored").when(s.isin("running", "queued"), "running")
        .otherwise(F.when(F.col("event_count") > 0, "running").otherwise("not_found"))
    )
    return runs.select("run_id", kind.alias("kind"))


def summaries(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", "workflow_id", "workflow_version", "status", "created_at", "updated_at")


def outcomes(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", "status", F.when(F.col("status") == "paused", F.col("wait_name")).alias("wait_name"), F.when(F.col("status") == "paused", F.col("wake_at")).alias("wake_at"))


def executions(states: DataFrame) -> DataFrame:
    """States as execution rows: wake_at is the deadline of those that wait for the timer."""
    return states.select("run_id", checked_status(F.col("status")).alias("status"), F.when(F.col("wait_name") == TIMER, F.col("deadline")).alias("wake_at"))


def select_version(runs: DataFrame, versions: DataFrame) -> DataFrame:
    """run_id, routed_version, verdict. versions: workflow_id, version, is_current. No version asked for: the current one;
    one that exists: that; else none, never another."""
    current = versions.where("is_current").select("workflow_id", F.col("version").alias("current"))
    exact = versions.select("workflow_id", F.col("version").alias("workflow_version"), F.col("version").alias("exact"))
    both = runs.join(current, "workflow_id", "left").join(exact, ["workflow_id", "workflow_version"], "left")
    routed = F.when(F.col("workflow_version").isNull(), F.col("current")).otherwise(F.col("exact"))
    return both.select("run_id", routed.alias("routed_version"), F.when(routed.isNull(), "mismatch").otherwise("routed").alias("verdict"))


def persisted(events: DataFrame) -> DataFrame:
    """The events that a log keeps; the others are only observed."""
    return events.where(F.col("event_type").isin(*PERSISTED_KINDS))


def envelope(raw: DataFrame) -> DataFrame:
    """run_id, event_index, event_type, step_id, created_at from JSON events (run_id, event_index, event)."""
    v = F.try_parse_json("event")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    return raw.select("run_id", "event_index", get("$.type", "string").alias("event_type"), get("$.step_id", "string").alias("step_id"), get("$.ts", "long").alias("created_at"))
