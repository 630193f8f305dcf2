"""Reading and appending event logs and run tables: filters that reach the scan, and set-wise verdicts for writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.projections import outcomes
from ..schema import EVENTS, TERMINAL


def read_jsonl(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    """One event a line; blank lines are skipped; a broken line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(events: DataFrame, path: str) -> None:
    events.write.option("ignoreNullFields", "false").mode("append").json(path)


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_events(events: DataFrame, run_id: str, from_index: int = 0) -> DataFrame:
    """A run's log from an index on, in order; both conditions reach the scan."""
    return events.where((F.col("run_id") == run_id) & (F.col("event_index") >= from_index)).orderBy("event_index")


def append_verdicts(events: DataFrame, appends: DataFrame) -> DataFrame:
    """run_id, expected, actual, verdict of appends (run_id, expected): appended only where the log has that length."""
    actual = events.join(appends.select("run_id").distinct(), "run_id", "left_semi").groupBy("run_id").agg(F.count("*").alias("actual"))
    both = appends.join(actual, "run_id", "left").withColumn("actual", F.coalesce("actual", F.lit(0)).cast("long"))
    return both.select("run_id", "expected", "actual", F.when(F.col("expected") == F.col("actual"), "appended").otherwise("conflict").alias("verdict"))


def append_events(events: DataFrame, appends: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows to add: those of batch (run_id, position and the columns of events but event_index) whose run's
    append is accepted, with dense indices from the expected one; all rows of a run or none."""
    accepted = append_verdicts(events, appends).where("verdict = 'appended'").select("run_id", "expected")
    at = F.row_number().over(Window.partitionBy("run_id").orderBy("position")) - 1
    numbered = batch.join(accepted, "run_id").withColumn("event_index", (F.col("expected") + at).cast("long"))
    return numbered.drop("position", "expected")


def load_run(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.where(F.col("run_id") == run_id)


def save_states(runs: DataFrame, states: DataFrame) -> DataFrame:
    """The runs table after an upsert of states (run_id, workflow_id, workflow_version, status, wait_name, wake_at,
    created_at, updated_at): an existing lease is kept, new runs have none."""
    kept = runs.select("run_id", "lease_owner", "lease_expires_at", F.lit(1).alias("old"))
    saved = states.join(kept.drop("old"), "run_id", "left")
    untouched = runs.join(states.select("run_id"), "run_id", "left_anti")
    return untouched.unionByName(saved.select(untouched.columns))


def delete_runs(table: DataFrame, run_ids: DataFrame) -> DataFrame:
    """A table without the rows of the runs given; apply to runs, events, timers and deliveries (an inbox keeps its rows)."""
    return table.join(run_ids.select("run_id").distinct(), "run_id", "left_anti")


def load_executions(runs: DataFrame, events: DataFrame, run_ids: list[str] | None = None) -> DataFrame:
    """run_id, status, timeline: the runs asked for, or all, with their events in order. A timeline is one array, as its
    reader gets it: for runs of millions of events take read_events."""
    asked = F.lit(True) if run_ids is None else F.col("run_id").isin(*run_ids)
    line = F.array_sort(F.collect_list(F.struct("event_index", "event_type", "step_id")))
    timeline = events.where(asked).groupBy("run_id").agg(line.alias("timeline"))
    return runs.where(asked).select("run_id", "status").join(timeline, "run_id", "left")


def list_runs(runs: DataFrame, workflow_id: str | None = None, status: str | None = None, limit: int = 50, after: tuple[int, str] | None = None, offset: int = 0) -> DataFrame:
    """A page of runs, latest update first, ties by run_id; `after` is the (updated_at, run_id) of the last row seen."""
    rows = runs
    if workflow_id is not None:
        rows = rows.where(F.col("workflow_id") == workflow_id)
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if after is not None:
        at, run_id = after
        rows = rows.where((F.col("updated_at") < at) | ((F.col("updated_at") == at) & (F.col("run_id") > run_id)))
    return rows.orderBy(F.desc("updated_at"), "run_id").offset(offset).limit(limit)


def attach(runs: DataFrame, events: DataFrame) -> DataFrame:
    """run_id, position, event_type of what a late reader is shown: a start, the log, and an end where the status
    has ended but the log shows none. Runs without a log have position 0 and perhaps the end."""
    length = events.groupBy("run_id").agg(F.count("*").alias("n"), F.bool_or(F.col("event_type").isin("RUN_FINISHED", "RUN_ERRORED")).alias("ended"))
    start = runs.select("run_id", F.lit(0).cast("long").alias("position"), F.lit("RUN_STARTED").alias("event_type"))
    log = events.join(runs.select("run_id"), "run_id", "left_semi").select("run_id", (F.col("event_index") + 1).alias("position"), "event_type")
    open_ended = runs.where(F.col("status").isin(*TERMINAL)).join(length, "run_id", "left").where(~F.coalesce("ended", F.lit(False)))
    kind = F.when(F.col("status") == "finished", "RUN_FINISHED").otherwise("RUN_ERRORED")
    end = open_ended.select("run_id", (F.coalesce("n", F.lit(0)) + 1).cast("long").alias("position"), kind.alias("event_type"))
    return start.unionByName(log).unionByName(end)


def drained(runs: DataFrame, events: DataFrame, from_index: DataFrame) -> DataFrame:
    """run_id, n_events, status, wait_name: how many events each run of from_index (run_id, from_index) wrote from there on,
    and what became of it. The outcome is the run's state, never the last event: a run may be driven again without writing."""
    new = events.join(from_index, "run_id").where(F.col("event_index") >= F.col("from_index")).groupBy("run_id").agg(F.count("*").alias("n_events"))
    both = from_index.select("run_id").join(new, "run_id", "left").join(outcomes(runs), "run_id", "left")
    return both.select("run_id", F.coalesce("n_events", F.lit(0)).cast("long").alias("n_events"), "status", "wait_name")
