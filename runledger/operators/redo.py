"""Plans for redoing part of a run: what a failure invalidates, what can be imported, where to park."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import fold, graph

#: Steps of a shape that is not named by workflow.
MOST_STEPS = 10_000


def shape_faults(steps: DataFrame, deps: DataFrame) -> DataFrame:
    """step_id, fault of a shape: steps (step_id), deps (step_id, needs). Duplicates, needs that are no step, loops."""
    twice = steps.groupBy("step_id").agg(F.count("*").alias("n")).where("n > 1").select("step_id", F.lit("duplicate_step").alias("fault"))
    unknown = deps.join(steps.select(F.col("step_id").alias("needs")), "needs", "left_anti").select("step_id", F.lit("unknown_step").alias("fault"))
    loops = deps.where("step_id = needs").select("step_id", F.lit("self_loop").alias("fault"))
    return twice.union(unknown).union(loops).distinct()


def shape_edges(deps: DataFrame) -> DataFrame:
    """src, dst from deps (step_id, needs): a step comes after what it needs."""
    return deps.select(F.col("needs").alias("src"), F.col("step_id").alias("dst"))


def invalidation_set(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The seeds and all that depends on them. Raises ValueError for a seed that is no step."""
    unknown = seeds.join(graph.nodes_of(edges), "node", "left_anti")
    if not unknown.isEmpty():
        raise ValueError("a seed is no step of the shape")
    return graph.reachable(edges, seeds)


def reseed_plan(events: DataFrame, edges: DataFrame, runs: DataFrame | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """run_id, step_id to redo in each run: the steps that never finished, and all that depends on them.

    Edges with a column workflow_id hold a shape per workflow, and runs must name theirs; without it, all runs share one
    shape. seeds (step_id, and run_id where runs differ) take the place of the unfinished steps; one that is no step of
    its run's shape is an error. The closure starts from each run's own seeds.
    """
    runs = (runs if runs is not None else events).select(*(["run_id", "workflow_id"] if "workflow_id" in edges.columns else ["run_id"])).distinct()
    each = steps_of_runs(runs, edges)
    if seeds is None:
        chosen = each.join(fold.finished_steps(events), ["run_id", "step_id"], "left_anti")
    else:
        on = [c for c in ("run_id", "step_id") if c in seeds.columns]
        chosen = each.join(seeds.select(*on).distinct(), on, "left_semi")
        if not seeds.join(each, on, "left_anti").isEmpty():
            raise ValueError("a seed is no step of the shape")
    return graph.reachable(edges, chosen.withColumnRenamed("step_id", "node")).select("run_id", F.col("node").alias("step_id"))


def steps_of_runs(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """The columns of runs with each step_id of the run's shape: an equi-join on workflow_id, or one array of a shape
    that all runs share, which may have MOST_STEPS steps."""
    if "workflow_id" in edges.columns:
        ends = edges.select("workflow_id", F.explode(F.array("src", "dst")).alias("step_id")).distinct()
        return runs.join(ends, "workflow_id")
    steps = graph.nodes_of(edges).limit(MOST_STEPS + 1).collect()
    if len(steps) > MOST_STEPS:
        raise ValueError(f"a shared shape has at most {MOST_STEPS} steps; name workflows instead")
    return runs.withColumn("step_id", F.explode(F.array(*sorted((F.lit(r.node) for r in steps), key=str))) if steps else F.explode(F.array().cast("array<string>")))


def reseed_import(events: DataFrame, source: str, redo: list[str]) -> DataFrame:
    """new_index, step_id, source_index, ts: the source's finished steps outside the redo set, densely numbered."""
    kept = events.where((F.col("run_id") == source) & (F.col("event_type") == "STEP_FINISHED") & ~F.col("step_id").isin(*redo))
    new_index = F.row_number().over(Window.partitionBy("run_id").orderBy("event_index")) - 1
    return kept.select(new_index.cast("long").alias("new_index"), "step_id", F.col("event_index").alias("source_index"), "ts")


def reseed_verdicts(asked: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, source, verdict of asked (run_id, source)."""
    known = runs.select(F.col("run_id").alias("source"), F.lit(True).alias("known"))
    verdict = F.when(F.col("run_id") == F.col("source"), "validation_error").when(F.col("known").isNull(), "run_lost").otherwise("ok")
    return asked.join(known, "source", "left").select("run_id", "source", verdict.alias("verdict"))


def step_actions(events: DataFrame, source: str, redo: list[str]) -> DataFrame:
    """step_id, action for every step of the source: skip those outside the redo set that have a result, run the others."""
    results = fold.load_results(events.where(F.col("run_id") == source)).select("step_id", F.lit(True).alias("has"))
    steps = events.where(F.col("run_id") == source).select("step_id").distinct().join(results, "step_id", "left")
    return steps.select("step_id", F.when(~F.col("step_id").isin(*redo) & F.col("has"), "skip").otherwise("run").alias("action"))


def policy_plan(events: DataFrame, edges: DataFrame, source: str, redo: list[str]) -> DataFrame:
    """step_id, action, result for every step of the shape: run what the source never finished, what is asked for,
    and all that depends on either; skip the rest with the source's results."""
    own = events.where(F.col("run_id") == source)
    steps = graph.nodes_of(edges).select(F.col("node").alias("step_id"))
    finished = fold.finished_steps(own).select("step_id")
    from_here = steps.join(finished, "step_id", "left_anti").union(steps.where(F.col("step_id").isin(*redo)))
    again = graph.reachable(edges, from_here.select(F.col("step_id").alias("node"))).select(F.col("node").alias("step_id"), F.lit(True).alias("again"))
    both = steps.join(again, "step_id", "left").join(fold.load_results(own).select("step_id", "result"), "step_id", "left")
    skip = F.col("again").isNull() & F.col("result").isNotNull()
    return both.select("step_id", F.when(skip, "skip").otherwise("run").alias("action"), F.when(skip, F.col("result")).alias("result"))


def goal_boundaries(events: DataFrame, goals: list[str]) -> DataFrame:
    """run_id, done_index, park_index: the event that completes the last goal, and the first start after it (null if none).

    A run that never finishes every goal has no row.
    """
    first = events.where((F.col("event_type") == "STEP_FINISHED") & F.col("step_id").isin(*goals)).groupBy("run_id", "step_id").agg(F.min("event_index").alias("i"))
    done = first.groupBy("run_id").agg(F.count("*").alias("n"), F.max("i").alias("done_index")).where(F.col("n") == len(set(goals))).drop("n")
    starts = events.where(F.col("event_type") == "STEP_STARTED").select("run_id", "event_index")
    after = done.join(starts, "run_id", "left")
    return after.groupBy("run_id", "done_index").agg(F.min(F.when(F.col("event_index") > F.col("done_index"), F.col("event_index"))).alias("park_index"))


def goal_statuses(events: DataFrame, goals: list[str]) -> DataFrame:
    """run_id, step_id, done for the goals that a run has touched: whether a drive that starts now finds them finished,
    and so parks before it starts anything else."""
    rows = events.where(F.col("step_id").isin(*goals))
    return rows.groupBy("run_id", "step_id").agg(F.bool_or(F.col("event_type") == "STEP_FINISHED").alias("done"))


def stale_dependents(edges: DataFrame, redo: DataFrame) -> DataFrame:
    """Steps that depend on the redo set but are not in it."""
    return graph.descendants_from(edges, redo)
