"""Folds of an event log: one aggregation per question, ordered by event_index, never by time.

Events have run_id, event_index, event_type, step_id, name, deadline, body, ts. Every fold is a grouped
aggregation with filters, so tasks combine their rows before anything is shuffled, and a run of any length is safe.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AWAITS = ("SIGNAL_AWAITED", "APPROVAL_REQUESTED")
RESOLVES = ("SIGNAL_RESOLVED", "APPROVAL_RESOLVED")
HARD = ("STEP_STARTED", "STEP_FINISHED", "STEP_FAILED")
FOLDED = HARD + AWAITS + RESOLVES


def _is(*kinds: str) -> Column:
    return F.col("event_type").isin(*kinds)


def _last(value: Column | str, where: Column) -> Column:
    return F.max_by(value, F.when(where, F.col("event_index")))


def _first(value: Column | str, where: Column) -> Column:
    return F.min_by(value, F.when(where, F.col("event_index")))


def decision(body: Column) -> Column:
    """What an approval's resolution leaves as a result: the JSON of whether it was approved, and the feedback."""
    v = F.try_parse_json(body)
    both = F.struct(F.try_variant_get(v, "$.approved", "boolean").alias("approved"), F.try_variant_get(v, "$.feedback", "string").alias("feedback"))
    return F.to_json(both, {"ignoreNullFields": "false"})


def fold_step_states(events: DataFrame) -> DataFrame:
    """The state of each step: run_id, step_id, status, result, error, started_at, finished_at.

    The last hard event decides between running, success and failed; an await after the last start pauses a
    step that has neither finished nor failed. A resolve gives a result and changes no status: a signal's payload, or the
    decision of an approval. A deadline
    sets finished_at whatever the status. Kinds that do not touch steps make no row.
    """
    idx = F.col("event_index")
    started, timed = _is("STEP_STARTED"), _is(*AWAITS) & F.col("deadline").isNotNull() & _is("SIGNAL_AWAITED")
    ends = _is("STEP_FINISHED", "STEP_FAILED") | timed
    steps = events.where(_is(*FOLDED)).groupBy("run_id", "step_id").agg(
        _last("event_type", _is(*HARD)).alias("hard"),
        F.max(F.when(started, idx)).alias("started"),
        F.max(F.when(_is(*AWAITS), idx)).alias("awaited"),
        _last(F.when(_is("APPROVAL_RESOLVED"), decision(F.col("body"))).otherwise(F.col("body")), _is("STEP_FINISHED", *RESOLVES)).alias("result"),
        _last(F.when(_is("STEP_FAILED"), F.col("body")), _is("STEP_FINISHED", "STEP_FAILED")).alias("error"),
        F.coalesce(_last("ts", started), _first("ts", _is(*AWAITS))).alias("started_at"),
        _last(F.when(_is(*AWAITS), F.col("deadline")).otherwise(F.col("ts")), ends).alias("finished_at"),
    )
    status = (
        F.when(F.col("hard") == "STEP_FINISHED", "success")
        .when(F.col("hard") == "STEP_FAILED", "failed")
        .when(F.col("awaited") > F.coalesce("started", F.lit(-1)), "paused")
        .when(F.col("started").isNotNull(), "running")
        .otherwise("pending")
    )
    return steps.select("run_id", "step_id", status.alias("status"), "result", "error", "started_at", "finished_at")


def pending_retries(events: DataFrame) -> DataFrame:
    """The last scheduled retry of each step; a later finish does not clear it."""
    return events.where(_is("STEP_RETRY_SCHEDULED")).groupBy("run_id", "step_id").agg(F.max("event_index").alias("event_index"), F.max_by("ts", "event_index").alias("ts"))


def finished_steps(events: DataFrame) -> DataFrame:
    return events.where(_is("STEP_FINISHED")).select("run_id", "step_id").distinct()


def goals_done(events: DataFrame, goals: list[str]) -> DataFrame:
    """run_id, done: whether every goal's status is success; false for an empty list of goals."""
    state = fold_step_states(events).where(F.col("step_id").isin(*goals) & (F.col("status") == "success"))
    done = state.groupBy("run_id").agg(F.count("*").alias("n"))
    runs = events.select("run_id").distinct().join(done, "run_id", "left")
    return runs.select("run_id", (F.coalesce("n", F.lit(0)) == len(set(goals)) if goals else F.lit(False)).alias("done"))


def load_results(events: DataFrame) -> DataFrame:
    """The last result of each finished step, of those that have one."""
    return events.where(_is("STEP_FINISHED") & F.col("body").isNotNull()).groupBy("run_id", "step_id").agg(F.max_by("body", "event_index").alias("result"))


def first_resume(events: DataFrame) -> DataFrame:
    """The first resolve of each step, which replay serves (a fold serves the last)."""
    first = F.min_by(F.struct("event_type", "body"), "event_index").alias("r")
    return events.where(_is(*RESOLVES)).groupBy("run_id", "step_id").agg(first).select("run_id", "step_id", "r.event_type", "r.body")


def last_await_by_name(events: DataFrame) -> DataFrame:
    """The step of the last await of each signal name, resolved or not."""
    return events.where(_is("SIGNAL_AWAITED")).groupBy("run_id", "name").agg(F.max_by("step_id", "event_index").alias("step_id"))


def last_await_by_step(events: DataFrame) -> DataFrame:
    return events.where(_is("SIGNAL_AWAITED")).groupBy("run_id", "step_id").agg(F.max_by("name", "event_index").alias("name"))


def parked_approvals(events: DataFrame) -> DataFrame:
    """(run_id, name) of every approval requested."""
    return events.where(_is("APPROVAL_REQUESTED")).select("run_id", "name").distinct()


def already_paused(events: DataFrame) -> DataFrame:
    return events.where(_is(*AWAITS)).select("run_id", "step_id").distinct()


def recorded_values(events: DataFrame) -> DataFrame:
    """The first value recorded under each positional id of now and uuid."""
    return events.where(_is("NOW_RECORDED", "UUID_RECORDED")).groupBy("run_id", "step_id").agg(F.min_by("body", "event_index").alias("value"))


def compensations(events: DataFrame, kind: str) -> DataFrame:
    """(run_id, name) of compensations of one kind: COMPENSATION_REGISTERED, COMPENSATION_COMPLETED."""
    return events.where(_is(kind)).select("run_id", "name").distinct()


def compensation_plan(events: DataFrame) -> DataFrame:
    """run_id, position, name: registered compensations that are not completed, latest first."""
    first = events.where(_is("COMPENSATION_REGISTERED")).groupBy("run_id", "name").agg(F.min("event_index").alias("at"))
    left = first.join(compensations(events, "COMPENSATION_COMPLETED"), ["run_id", "name"], "left_anti")
    return left.select("run_id", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("at"))).cast("long").alias("position"), "name")


def log_length(events: DataFrame) -> DataFrame:
    """run_id, next_index: where the next event goes."""
    return events.groupBy("run_id").agg(F.count("*").alias("next_index"))


def count_kinds(rows: DataFrame, kind: str = "kind") -> DataFrame:
    return rows.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"))


def sweep_counts(phases: dict[str, DataFrame]) -> DataFrame:
    """phase, runs, event_count, returned_event_count over results (event_count, returned) of the phases of a sweep."""
    named = [df.select(F.lit(p).alias("phase"), "event_count", "returned") for p, df in phases.items()]
    both = reduce(DataFrame.unionByName, named)
    return both.groupBy("phase").agg(F.count("*").alias("runs"), F.sum("event_count").alias("event_count"), F.sum("returned").alias("returned_event_count"))
