"""State machines over keyed tables: each takes a table and commands, and gives verdicts and changed rows, set-wise.

A command meets its row by an equi-join, and verdicts follow one precedence. Deliveries carry an arrival, distinct within a
run: a batch is judged as if they came one by one, so the first that a run waits for is taken and the run, queued
again, waits for nothing more. Other batches take at most one command per key. Nothing reads a clock: `now` is always given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DEFAULT_LEASE_MS, TIMER
from .projections import can_claim, is_terminal, waits_for_approval, waits_for_signal


def create_runs(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """run_id, verdict, status: created as queued, or existing and unchanged."""
    both = wanted.select("run_id").distinct().join(runs.select("run_id", "status"), "run_id", "left")
    return both.select("run_id", F.when(F.col("status").isNull(), "created").otherwise("existing").alias("verdict"), F.coalesce("status", F.lit("queued")).alias("status"))


def mark(runs: DataFrame, ids: DataFrame, status: str, wait_name: str | None = None, wake_at: int | None = None) -> DataFrame:
    """The rows of ids after they are paused, finished or errored: waits are set or cleared, and leases cleared."""
    waits = (F.lit(wait_name).cast("string"), F.lit(wake_at).cast("long")) if status == "paused" else (F.lit(None).cast("string"), F.lit(None).cast("long"))
    hit = runs.join(ids.select("run_id").distinct(), "run_id", "left_semi")
    return hit.select("run_id", F.lit(status).alias("status"), waits[0].alias("wait_name"), waits[1].alias("wake_at"), F.lit(None).cast("string").alias("lease_owner"), F.lit(None).cast("long").alias("lease_expires_at"))


def claim_verdicts(runs: DataFrame, wanted: DataFrame, owner: str, now: int, lease_ms: int = DEFAULT_LEASE_MS) -> DataFrame:
    """run_id, verdict, new_expires_at: not found; not claimable when ended or under another's live lease; else claimed."""
    if lease_ms <= 0:
        raise ValueError("a lease must last")
    both = wanted.select("run_id").distinct().join(runs, "run_id", "left")
    free = ~is_terminal(F.col("status")) & can_claim(F.col("lease_owner"), F.col("lease_expires_at"), owner, now)
    verdict = F.when(F.col("status").isNull(), "not_found").when(free, "claimed").otherwise("not_claimable")
    return both.select("run_id", verdict.alias("verdict"), F.when(verdict == "claimed", F.lit(now + lease_ms).cast("long")).alias("new_expires_at"))


def heartbeat(runs: DataFrame, owner: str, now: int, lease_ms: int = DEFAULT_LEASE_MS) -> DataFrame:
    """run_id, lease_expires_at, updated_at of the runs whose lease the owner holds, expired or not."""
    return runs.where(F.col("lease_owner") == owner).select("run_id", F.lit(now + lease_ms).cast("long").alias("lease_expires_at"), F.lit(now).cast("long").alias("updated_at"))


def release(runs: DataFrame, owner: str) -> DataFrame:
    """run_id, status of the runs whose lease the owner gives back."""
    return runs.where(F.col("lease_owner") == owner).select("run_id", "status")


def claim_stale(runs: DataFrame, owner: str, now: int, limit: int = 25, lease_ms: int = DEFAULT_LEASE_MS) -> DataFrame:
    """run_id, new_lease_owner, new_expires_at, updated_at of running runs with an expired lease, longest untouched first."""
    stale = runs.where((F.col("status") == "running") & F.col("lease_owner").isNotNull() & (F.col("lease_expires_at") <= now))
    return stale.orderBy("updated_at", "run_id").limit(limit).select("run_id", *_lease(owner, now, lease_ms), F.lit(now).cast("long").alias("updated_at"))


def _lease(owner: str, now: int, lease_ms: int) -> list[Column]:
    return [F.lit(owner).alias("new_lease_owner"), F.lit(now + lease_ms).cast("long").alias("new_expires_at")]


def cancel_verdicts(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """run_id, verdict, status: missing is an error, ended a no-op, else aborted with waits cleared."""
    both = wanted.select("run_id").distinct().join(runs.select("run_id", "status"), "run_id", "left")
    verdict = F.when(F.col("status").isNull(), "not_found").when(is_terminal(F.col("status")), "no_op").otherwise("aborted")
    return both.select("run_id", verdict.alias("verdict"), F.when(verdict == "aborted", "aborted").otherwise(F.col("status")).alias("status"))


def project_waits(runs: DataFrame, waits: DataFrame) -> DataFrame:
    """run_id, status, wait_name, wake_at after waits (run_id, name, deadline): runs that have not ended are paused."""
    both = runs.join(waits.select("run_id", "name", "deadline"), "run_id")
    ended = is_terminal(F.col("status"))
    return both.select("run_id", F.when(ended, F.col("status")).otherwise("paused").alias("status"), F.when(~ended, F.col("name")).alias("wait_name"), F.when(~ended & (F.col("name") == TIMER), F.col("deadline")).alias("wake_at"))


def resume(runs: DataFrame) -> DataFrame:
    """run_id, status, wait_name: paused runs set to running, with all waits cleared."""
    return runs.where("status = 'paused'").select("run_id", F.lit("running").alias("status"), F.lit(None).cast("string").alias("wait_name"))


def lease_ms(configured: Column | None, asked: Column | None) -> Column:
    """Asked for, else configured, else the default."""
    return F.coalesce(*[c for c in (asked, configured) if c is not None], F.lit(DEFAULT_LEASE_MS))


def schedule_timers(timers: DataFrame, new: DataFrame) -> DataFrame:
    """timers (run_id, signal_id, wake_at, lease_owner, lease_expires_at) after an upsert; a replaced timer loses its lease."""
    kept = timers.join(new.select("run_id", "signal_id"), ["run_id", "signal_id"], "left_anti")
    fresh = new.select("run_id", "signal_id", "wake_at", F.lit(None).cast("string").alias("lease_owner"), F.lit(None).cast("long").alias("lease_expires_at"))
    return kept.unionByName(fresh)


def due_timers(timers: DataFrame, owner: str, now: int, limit: int = 25, lease_ms: int = DEFAULT_LEASE_MS) -> DataFrame:
    """run_id, signal_id, wake_at and the new lease of the timers that are due and can be claimed, earliest first.
    A claim leaves the timer where it is; its delivery removes it."""
    due = timers.where((F.col("wake_at") <= now) & can_claim(F.col("lease_owner"), F.col("lease_expires_at"), owner, now))
    return due.orderBy("wake_at", "run_id", "signal_id").limit(limit).select("run_id", "signal_id", "wake_at", *_lease(owner, now, lease_ms))


def timers_from_runs(runs: DataFrame) -> DataFrame:
    """The timers that paused runs ask for: run_id, signal_id, wake_at."""
    parked = runs.where((F.col("status") == "paused") & (F.col("wait_name") == TIMER) & F.col("wake_at").isNotNull())
    return parked.select("run_id", F.concat_ws(":", F.lit("timer"), "run_id", F.lit(TIMER), F.col("wake_at").cast("string")).alias("signal_id"), "wake_at")


def _one_by_one(rows: DataFrame, per: list[str], key: str, could: Column, done: str, prior: Column) -> DataFrame:
    """rows with a verdict. Of the rows of one `per` that could be accepted, the first is `done`; later ones with its
    key are duplicates, as are those for which `prior` holds; all others are not_waiting.

    The first is found by a grouped minimum, so a run may have any share of the rows.
    """
    first = rows.where(could & ~prior).groupBy(*per).agg(F.min(F.struct("arrival", F.col(key).alias("key"))).alias("first"))
    both = rows.join(first, per, "left")
    same = F.coalesce(F.col("first.key") == F.col(key), F.lit(False))
    verdict = (
        F.when(F.col("status").isNull(), "not_found").when(prior, "duplicate").when(same & (F.col("arrival") == F.col("first.arrival")), done)
        .when(same & (F.col("arrival") > F.col("first.arrival")), "duplicate").otherwise("not_waiting")
    )
    return both.withColumn("verdict", verdict)


def deliver_signals(runs: DataFrame, deliveries: DataFrame) -> DataFrame:
    """run_id, signal_id, arrival, verdict of deliveries (run_id, signal_id, name, arrival, already_delivered), in this
    order: not_found, duplicate, not_waiting, delivered. The first delivery that a paused run waits for queues it."""
    both = deliveries.join(runs.select("run_id", "status", "wait_name"), "run_id", "left")
    could = (F.col("status") == "paused") & waits_for_signal(F.col("wait_name"), F.lit(None).cast("string"), F.col("name"), F.lit(None).cast("string"))
    return _one_by_one(both, ["run_id"], "signal_id", could, "delivered", F.col("already_delivered")).select("run_id", "signal_id", "arrival", "verdict")


def deliver_approvals(runs: DataFrame, approvals: DataFrame) -> DataFrame:
    """run_id, key, arrival, verdict of approvals (run_id, approval_id, arrival, already_delivered), judged like signals; keys are approval:{id}."""
    both = approvals.join(runs.select("run_id", "status", "wait_name"), "run_id", "left").withColumn("key", F.concat(F.lit("approval:"), "approval_id"))
    could = (F.col("status") == "paused") & waits_for_approval(F.col("wait_name"), F.col("approval_id"))
    return _one_by_one(both, ["run_id"], "key", could, "delivered", F.col("already_delivered")).select("run_id", "key", "arrival", "verdict")


def buffer_signals(runs: DataFrame, deliveries: DataFrame, inbox: DataFrame | None = None) -> DataFrame:
    """run_id, signal_id, arrival, verdict: a signal that may come early is boxed once, unless the run has ended or it is
    a timer's. One that was delivered, or that the inbox (run_id, signal_id) or an earlier row has boxed, is a duplicate."""
    both = deliveries.join(runs.select("run_id", "status"), "run_id", "left")
    prior = F.col("already_delivered")
    if inbox is not None:
        both = both.join(inbox.select("run_id", "signal_id", F.lit(True).alias("boxed")).distinct(), ["run_id", "signal_id"], "left")
        prior = prior | F.coalesce("boxed", F.lit(False))
    could = F.col("status").isNotNull() & ~is_terminal(F.col("status")) & (F.col("name") != TIMER)
    return _one_by_one(both, ["run_id", "signal_id"], "signal_id", could, "buffered", prior).select("run_id", "signal_id", "arrival", "verdict")


def inbox_heads(inbox: DataFrame) -> DataFrame:
    """run_id, name, signal_id of the oldest boxed signal of each name, by sequence."""
    return inbox.groupBy("run_id", "name").agg(F.min_by("signal_id", "sequence").alias("signal_id"))


def signal_verdicts(events: DataFrame, signals: DataFrame) -> DataFrame:
    """run_id, name, step_id, verdict of signals (run_id, name): resolved for the step that awaits last, else lost."""
    awaits = events.where("event_type = 'SIGNAL_AWAITED'").groupBy("run_id", "name").agg(F.max_by("step_id", "event_index").alias("step_id"))
    both = signals.join(awaits, ["run_id", "name"], "left")
    return both.select("run_id", "name", "step_id", F.when(F.col("step_id").isNull(), "lost").otherwise("resolved").alias("verdict"))


def step_signal_verdicts(events: DataFrame, signals: DataFrame) -> DataFrame:
    """run_id, step_id, name, verdict of signals (run_id, step_id): resolved under the name that the step awaited last."""
    awaits = events.where("event_type = 'SIGNAL_AWAITED'").groupBy("run_id", "step_id").agg(F.max_by("name", "event_index").alias("name"))
    both = signals.join(awaits, ["run_id", "step_id"], "left")
    return both.select("run_id", "step_id", "name", F.when(F.col("name").isNull(), "lost").otherwise("resolved").alias("verdict"))


def approval_verdicts(events: DataFrame, approvals: DataFrame) -> DataFrame:
    """run_id, name, verdict of approvals (run_id, name): lost where none was requested."""
    asked = events.where("event_type = 'APPROVAL_REQUESTED'").select("run_id", "name", F.lit(True).alias("asked")).distinct()
    both = approvals.join(asked, ["run_id", "name"], "left")
    return both.select("run_id", "name", F.when(F.col("asked"), "resolved").otherwise("lost").alias("verdict"))


def upsert_schedules(schedules: DataFrame, new: DataFrame) -> DataFrame:
    return schedules.join(new.select("schedule_id"), "schedule_id", "left_anti").unionByName(new.select(schedules.columns))


def due_buckets(due: DataFrame, buckets: DataFrame | None, owner: str, now: int, limit: int | None = None, lease_ms: int = DEFAULT_LEASE_MS) -> DataFrame:
    """schedule_id, bucket_id, run_id, fire_at and the new lease of due fires (schedule_id, workflow_id, fire_at) that none has started
    or leases; what is taken is dropped before any limit."""
    made = due.where(F.col("fire_at") <= now).select("schedule_id", F.col("fire_at").cast("string").alias("bucket_id"), F.concat_ws(":", "workflow_id", "schedule_id", F.col("fire_at").cast("string")).alias("run_id"), "fire_at")
    if buckets is not None:
        taken = buckets.where((F.col("status") == "started") | ~can_claim(F.col("lease_owner"), F.col("lease_expires_at"), owner, now))
        made = made.join(taken.select("schedule_id", "bucket_id"), ["schedule_id", "bucket_id"], "left_anti")
    made = made if limit is None else made.orderBy("fire_at", "schedule_id").limit(limit)
    return made.select("*", *_lease(owner, now, lease_ms))


def start_buckets(buckets: DataFrame, started: DataFrame) -> DataFrame:
    """buckets with those in started (schedule_id, bucket_id, run_id) marked."""
    hit = started.select("schedule_id", "bucket_id", F.col("run_id").alias("by"))
    both = buckets.join(hit, ["schedule_id", "bucket_id"], "left")
    return both.withColumn("status", F.when(F.col("by").isNotNull(), "started").otherwise(F.col("status"))).withColumn("run_id", F.coalesce("by", "run_id")).drop("by")


def dense_index(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("event_index", F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long") - 1)
