"""Following logs with Structured Streaming.

Folds are aggregations that do not depend on the order of arrival, so the batch functions run on streams as they
are: state is kept per step, and every micro-batch brings it up to date.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.jsonfn import diff_state
from ..operators.fold import fold_step_states
from ..operators.transitions import due_timers
from ..schema import EVENTS, OBSERVED_KINDS

Sink = Callable[[DataFrame, int], None]


def tail(spark: SparkSession, path: str, run_id: str | None = None, from_index: int = 0, files_per_batch: int = 100) -> DataFrame:
    """A stream of a log's Parquet files: what is there, then what comes; both conditions are pushed to the files."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    rows = rows.where(F.col("event_index") >= from_index)
    return rows if run_id is None else rows.where(F.col("run_id") == run_id)


class Failures(list):
    """What sinks failed with: (batch, error), in order."""

    def raise_any(self) -> None:
        if self:
            raise RuntimeError(f"a sink failed on batch {self[0][0]}") from self[0][1]


def publish(stream: DataFrame, sinks: list[Sink], checkpoint: str, mode: str = "append", failures: Failures | None = None, every: str | None = None) -> StreamingQuery:
    """Sends every micro-batch to each sink once, however often it is listed; a sink that fails stops no other, and what it
    failed with is added to failures, or else raised once the other sinks have had the batch.

    A batch is written beside the checkpoint once, and sinks read that, so none of them runs the stream's plan again.
    every: an interval like "10 seconds", to follow the log until the query is stopped; else it ends with what is there.
    """
    distinct = list({id(s): s for s in sinks}.values())

    def each(batch: DataFrame, number: int) -> None:
        path = f"{checkpoint}-batches/{number % 2}"
        batch.write.mode("overwrite").parquet(path)
        written = batch.sparkSession.read.schema(batch.schema).parquet(path)
        failed = Failures() if failures is None else failures
        for sink in distinct:
            try:
                sink(written, number)
            except Exception as e:  # noqa: BLE001  a subscriber must not stop the others
                failed.append((number, e))
        if failures is None:
            failed.raise_any()

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def emitted(rows: DataFrame, kind: str = "CUSTOM") -> DataFrame:
    """Events of rows (run_id, name, body, ts, and step_id for progress) that are shown and not kept: CUSTOM, STEP_PROGRESS or
    STATE_DELTA. They have no index, as the log does not hold them."""
    if kind not in OBSERVED_KINDS:
        raise ValueError(f"{kind} is no kind that is only observed")
    step = F.col("step_id") if "step_id" in rows.columns else F.lit(None).cast("string")
    return rows.select("run_id", F.lit(None).cast("long").alias("event_index"), F.lit(kind).alias("event_type"), step.alias("step_id"), "name", F.lit(None).cast("long").alias("deadline"), "body", "ts")


def step_states(stream: DataFrame) -> DataFrame:
    """The live state of each step; write it in complete or update mode."""
    return fold_step_states(stream)


def first_deliveries(stream: DataFrame) -> DataFrame:
    """Each signal id of a run once. Keys are never forgotten: a redelivery may come at any time."""
    return stream.dropDuplicates(["run_id", "signal_id"])


def state_deltas(states: DataFrame) -> DataFrame:
    """run_id, event_index, delta between consecutive states (run_id, event_index, state JSON); the first has none."""
    before = F.lag("state").over(Window.partitionBy("run_id").orderBy("event_index"))
    both = states.withColumn("before", before).where("before is not null")
    return both.select("run_id", "event_index", diff_state("before", "state").alias("delta")).where(F.size("delta") > 0)


def sweep_timers(timers: Callable[[], DataFrame], owner: str, limit: int = 25) -> Callable[[int], DataFrame]:
    """A function of the time that gives the timers due then; timers are read anew each time."""
    return lambda now: due_timers(timers(), owner, now, limit)


def replay_step_states(events: DataFrame, folder: str, batches: int = 3) -> DataFrame:
    """events written as files, of which each batch of a stream folds a share; the last state of each step."""
    spark = events.sparkSession
    files = max(batches, int(spark.conf.get("spark.sql.shuffle.partitions")))
    events.repartition(files).write.mode("overwrite").parquet(f"{folder}/log")
    columns = [c.split(" ")[0] for c in EVENTS.split(", ")]
    assert set(columns) <= set(events.columns)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/states-{number % 2}")
        spark.createDataFrame([(number,)], "n long").write.mode("overwrite").parquet(f"{folder}/last")

    publish(step_states(tail(spark, f"{folder}/log", files_per_batch=-(-files // batches))), [keep], f"{folder}/checkpoint", "complete").awaitTermination()
    last = spark.read.parquet(f"{folder}/last").first().n
    return spark.read.parquet(f"{folder}/states-{last % 2}")
