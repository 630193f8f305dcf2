"""The queries of the library, by name, over views of the given tables, and the same in SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixtures
from ..functions import jsonfn, schedule
from ..lineage import shared_dir
from ..operators import fold, graph, projections, redo, transitions
from ..schema import TIMER
from ..sources import log
from ..streaming import live

Query = Callable[[SparkSession, str], DataFrame]

#: Instants: one at which schedules fire, and one at which leases of runs have partly expired.
FIRE, NOW = 1_771_234_567_890, 912_470_400_000
OWNER = "worker-3"
GOALS = ["step-1", "step-2"]

_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}


def add(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers f(*views) under a name; views are also the first CTEs of the SQL."""

    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _queries[name] = lambda spark, sf_dir: f(*([fixtures.view(spark, sf_dir, v) for v in views] or [spark]))
        if sql:
            ctes = fixtures.duckdb_ctes(*views)
            text = sql.strip()
            _oracle[name] = text if not ctes else f"with recursive {ctes}, {text[5:]}" if text.startswith("with ") else f"with recursive {ctes} {text}"
        return f

    return put


EV, SAGA, ED, RU, DE, SC, AR, ST, DP = "wf_events", "wf_saga", "wf_edges", "wf_runs", "wf_deliveries", "wf_schedules", "wf_arrivals", "wf_steps", "wf_deps"

# --- sources -----------------------------------------------------------------------------------------------------

add("S01_get_events", "select run_id, event_index, event_type from wf_events where run_id = 'u1'", (EV,))(lambda e: log.read_events(e, "u1").select("run_id", "event_index", "event_type"))
add("S02_read_from_index", "select run_id, event_index, event_type from wf_events where event_index >= 20", (EV,))(lambda e: e.where("event_index >= 20").select("run_id", "event_index", "event_type"))
APPENDS = [("u1", 0), ("u2", 5), ("u3", 10_000), ("nobody", 0), ("nowhere", 3)]
_APPENDS_SQL = "a(run_id, expected) as (values " + ", ".join(f"('{r}', {n}::bigint)" for r, n in APPENDS) + ")"


def _appends(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame(APPENDS, "run_id string, expected long")


add("S03_cas_verdict", f"""with {_APPENDS_SQL}, n as (select run_id, count(*) as n from wf_events group by 1)
select a.run_id, expected, coalesce(n, 0)::bigint as actual, case when expected = coalesce(n, 0) then 'appended' else 'conflict' end as verdict
from a left join n using (run_id)""", (EV,))(lambda e: log.append_verdicts(e, _appends(e)))  # fmt: skip


@add("S04_append_batch", """with b as (select run_id, step_id, event_index as position from wf_events where event_type = 'STEP_FAILED'),
n as (select run_id, count(*) as n from wf_events group by 1)
select b.run_id, step_id, (n + row_number() over (partition by b.run_id order by position) - 1)::bigint as event_index from b join n using (run_id) where b.run_id not like '%2'""", (EV,))  # fmt: skip
def _append_batch(e: DataFrame) -> DataFrame:
    """Appends copies of each run's failures: at a wrong place for runs whose number ends in 2, else at the right one."""
    batch = e.where("event_type = 'STEP_FAILED'").select("run_id", "step_id", F.col("event_index").alias("position"))
    asked = fold.log_length(e).select("run_id", (F.col("next_index") + F.when(F.col("run_id").endswith("2"), 1).otherwise(0)).alias("expected"))
    return log.append_events(e, asked, batch)


add("S05_load_run", "select run_id, status, wait_name from wf_runs where run_id = 'o7'", (RU,))(lambda r: log.load_run(r, "o7").select("run_id", "status", "wait_name"))


add("S08_load_run", "select * from wf_runs where run_id = 'o34'", (RU,))(lambda r: log.load_run(r, "o34"))


@add("S06_save_states", """select run_id, case when status = 'queued' then 'running' else status end as status, lease_owner,
case when status = 'queued' then 'sig-0' else wait_name end as wait_name from wf_runs""", (RU,))  # fmt: skip
def _save(r: DataFrame) -> DataFrame:
    states = r.where("status = 'queued'").select("run_id", "workflow_id", "workflow_version", F.lit("running").alias("status"), F.lit("sig-0").alias("wait_name"), "wake_at", "created_at", "updated_at")
    return log.save_states(r, states).select("run_id", "status", "lease_owner", "wait_name")


add("S07_delete_runs", "select run_id, signal_id from wf_deliveries where run_id not in (select run_id from wf_runs where status = 'aborted')", (DE, RU))(lambda d, r: log.delete_runs(d, r.where("status = 'aborted'")).select("run_id", "signal_id"))


@add("S09_load_execution", """select run_id, count(*) as n, string_agg(event_type, ',' order by event_index) as kinds from wf_events group by run_id""", (EV,))
def _execution(e: DataFrame) -> DataFrame:
    runs = e.select("run_id").distinct().withColumn("status", F.lit("running"))
    done = log.load_executions(runs, e)
    return done.select("run_id", F.size("timeline").cast("long").alias("n"), F.array_join("timeline.event_type", ",").alias("kinds"))


add("S10_run_timeline", "select event_index, event_type, step_id from wf_events where run_id = 'u7'", (EV,))(lambda e: log.load_executions(e.where("run_id = 'u7'").select("run_id", F.lit("running").alias("status")).distinct(), e, ["u7"]).select(F.inline("timeline")))
add("S11_list_runs", "select run_id, workflow_id, status, updated_at from wf_runs where status = 'paused' order by updated_at desc, run_id limit 50", (RU,))(lambda r: log.list_runs(r, status="paused").select("run_id", "workflow_id", "status", "updated_at"))
add("S11_list_runs_after", """select run_id, updated_at from wf_runs where workflow_id = 'wf-1' and (updated_at < 900000000000 or updated_at = 900000000000 and run_id > 'o5')
order by updated_at desc, run_id limit 20 offset 5""", (RU,))(lambda r: log.list_runs(r, "wf-1", limit=20, after=(900_000_000_000, "o5"), offset=5).select("run_id", "updated_at"))  # fmt: skip
add("S12_summaries", "select run_id, workflow_id, workflow_version, status, created_at, updated_at from wf_runs", (RU,))(projections.summaries)

# --- projections -------------------------------------------------------------------------------------------------


@add("P01_envelope", "select run_id, event_index, event_type, step_id, ts as created_at from wf_events", (EV,))
def _envelope(e: DataFrame) -> DataFrame:
    return projections.envelope(e.select("run_id", "event_index", F.to_json(F.struct(F.col("event_type").alias("type"), "step_id", "ts")).alias("event")))


add("P02_terminal", "select run_id, status in ('finished', 'errored', 'aborted') as terminal from wf_runs", (RU,))(lambda r: r.select("run_id", projections.is_terminal(F.col("status")).alias("terminal")))
add("P03_can_claim", f"select run_id, coalesce(lease_owner is null or lease_owner = '{OWNER}' or lease_expires_at <= {NOW}, true) as free from wf_runs", (RU,))(lambda r: r.select("run_id", projections.can_claim(F.col("lease_owner"), F.col("lease_expires_at"), OWNER, NOW).alias("free")))
add("P04_waits_for_signal", "select run_id, coalesce(wait_name = 'sig-1', false) as waits from wf_runs", (RU,))(lambda r: r.select("run_id", projections.waits_for_signal(F.col("wait_name"), F.lit(None).cast("string"), F.lit("sig-1"), F.lit("step-1")).alias("waits")))
add("P05_waits_for_approval", "select run_id, coalesce(wait_name = 'sig-2', false) as waits from wf_runs", (RU,))(lambda r: r.select("run_id", projections.waits_for_approval(F.col("wait_name"), F.lit("sig-2")).alias("waits")))
add("P06_checked_status", "select status, count(*) as n from wf_runs group by 1", (RU,))(lambda r: r.groupBy(projections.checked_status(F.col("status")).alias("status")).agg(F.count("*").alias("n")))
add("C13_checked_policy", "select schedule_id, case right(schedule_id, 1) when '1' then 'allow' when '2' then 'buffer-one' when '3' then 'cancel-previous' when '4' then 'terminate-previous' else 'skip' end as policy from wf_schedules", (SC,))(
    lambda s: s.select("schedule_id", projections.checked_policy(F.get(F.array(*map(F.lit, ("allow", "buffer-one", "cancel-previous", "terminate-previous"))), F.substring("schedule_id", -1, 1).cast("int") - 1)).alias("policy"))
)
add("P08_executions", f"select run_id, status, case when wait_name = '{TIMER}' then updated_at end as wake_at from wf_runs", (RU,))(lambda r: projections.executions(r.withColumn("deadline", F.col("updated_at"))))
VERSIONS = [("wf-0", "v1", True), ("wf-0", "v2", False), ("wf-1", "v2", True), ("wf-2", "v9", True), ("wf-3", "v1", False), ("wf-3", "v2", True)]
add("P07_widened_status", "select run_id, status from wf_runs", (RU,))(lambda r: r.select("run_id", projections.checked_status(F.col("status")).alias("status")))
add("P09_typed_body", "select run_id, event_index, cast(json_extract_string(body, '$.k') as bigint) as k from wf_events where body is not null", (EV,))(lambda e: e.where("body is not null").select("run_id", "event_index", jsonfn.typed(F.col("body"), "k bigint")["k"].alias("k")))
add("P10_select_version", "with v(workflow_id, version, is_current) as (values " + ", ".join(f"('{w}', '{v}', {str(c).lower()})" for w, v, c in VERSIONS) + """),
r as (select run_id, case when r.workflow_version is null then c.version else x.version end as routed_version from wf_runs r
  left join v c on c.workflow_id = r.workflow_id and c.is_current left join v x on x.workflow_id = r.workflow_id and x.version = r.workflow_version)
select run_id, routed_version, case when routed_version is null then 'mismatch' else 'routed' end as verdict from r""", (RU,))(lambda r: projections.select_version(r, r.sparkSession.createDataFrame(VERSIONS, "workflow_id string, version string, is_current boolean")))  # fmt: skip
add("P11_persisted", "select run_id, event_index from wf_events where event_type <> 'STEP_STARTED'", (EV,))(lambda e: projections.persisted(e).select("run_id", "event_index"))
add("P12_classify", """select run_id, case status when 'finished' then 'completed' when 'paused' then 'paused' when 'queued' then 'running' when 'running' then 'running' else 'errored' end as kind from wf_runs""", (RU,))(lambda r: projections.classify(r.withColumn("event_count", F.lit(0))))
add("P13_outcomes", "select run_id, status, case when status = 'paused' then wait_name end as wait_name, case when status = 'paused' then wake_at end as wake_at from wf_runs", (RU,))(projections.outcomes)

# --- folds -------------------------------------------------------------------------------------------------------

_DECISION = """case when event_type = 'APPROVAL_RESOLVED' then '{"approved":' || coalesce(json_extract(body, '$.approved')::varchar, 'null') || ',"feedback":' || coalesce(json_extract(body, '$.feedback')::varchar, 'null') || '}' else body end"""
_STATES = f"""with f as (select run_id, step_id,
    max(event_index) filter (event_type in ('STEP_STARTED', 'STEP_FINISHED', 'STEP_FAILED')) as hard_at,
    arg_max_null(event_type, event_index) filter (event_type in ('STEP_STARTED', 'STEP_FINISHED', 'STEP_FAILED')) as hard,
    max(event_index) filter (event_type = 'STEP_STARTED') as started, max(event_index) filter (event_type in ('SIGNAL_AWAITED', 'APPROVAL_REQUESTED')) as awaited,
    arg_max_null({_DECISION}, event_index) filter (event_type in ('STEP_FINISHED', 'SIGNAL_RESOLVED', 'APPROVAL_RESOLVED')) as result,
    arg_max_null(case when event_type = 'STEP_FAILED' then body end, event_index) filter (event_type in ('STEP_FINISHED', 'STEP_FAILED')) as error,
    coalesce(arg_max_null(ts, event_index) filter (event_type = 'STEP_STARTED'), arg_min_null(ts, event_index) filter (event_type in ('SIGNAL_AWAITED', 'APPROVAL_REQUESTED'))) as started_at,
    arg_max_null(case when event_type = 'SIGNAL_AWAITED' then deadline else ts end, event_index)
      filter (event_type in ('STEP_FINISHED', 'STEP_FAILED') or event_type = 'SIGNAL_AWAITED' and deadline is not null) as finished_at
  from wf_events where event_type <> 'STEP_RETRY_SCHEDULED' group by 1, 2),
s as (select run_id, step_id, case when hard = 'STEP_FINISHED' then 'success' when hard = 'STEP_FAILED' then 'failed' when awaited > coalesce(started, -1) then 'paused'
  when started is not null then 'running' else 'pending' end as status, result, error, started_at, finished_at from f)
"""
add("F01_fold_step_states", _STATES + "select * from s", (EV,))(fold.fold_step_states)
add("F02_pending_retries", "select run_id, step_id, max(event_index) as event_index, arg_max(ts, event_index) as ts from wf_events where event_type = 'STEP_RETRY_SCHEDULED' group by 1, 2", (EV,))(fold.pending_retries)
add("F03_finished_steps", "select distinct run_id, step_id from wf_events where event_type = 'STEP_FINISHED'", (EV,))(fold.finished_steps)
add("F04_goals_done", _STATES + "select run_id, count(*) filter (status = 'success' and step_id in ('step-1', 'step-2')) = 2 as done from s group by 1", (EV,))(lambda e: fold.goals_done(e, GOALS))
add("F05_load_results", "select run_id, step_id, arg_max(body, event_index) as result from wf_events where event_type = 'STEP_FINISHED' and body is not null group by 1, 2", (EV,))(fold.load_results)
add("F06_first_resume", """select run_id, step_id, event_type, body from (select *, row_number() over (partition by run_id, step_id order by event_index) as n from wf_events
where event_type in ('SIGNAL_RESOLVED', 'APPROVAL_RESOLVED')) where n = 1""", (EV,))(fold.first_resume)  # fmt: skip
add("F07_last_await_by_name", "select run_id, name, arg_max(step_id, event_index) as step_id from wf_events where event_type = 'SIGNAL_AWAITED' group by 1, 2", (EV,))(fold.last_await_by_name)
add("F08_last_await_by_step", "select run_id, step_id, arg_max(name, event_index) as name from wf_events where event_type = 'SIGNAL_AWAITED' group by 1, 2", (EV,))(fold.last_await_by_step)
add("F09_parked_approvals", "select distinct run_id, name from wf_events where event_type = 'APPROVAL_REQUESTED'", (EV,))(fold.parked_approvals)
add("F10_already_paused", "select distinct run_id, step_id from wf_events where event_type in ('SIGNAL_AWAITED', 'APPROVAL_REQUESTED')", (EV,))(fold.already_paused)
add("F11_recorded_values", "select run_id, step_id, arg_min_null(body, event_index) as value from wf_saga where event_type in ('NOW_RECORDED', 'UUID_RECORDED') group by 1, 2", (SAGA,))(fold.recorded_values)
add("F12_completed_compensations", "select distinct run_id, name from wf_saga where event_type = 'COMPENSATION_COMPLETED'", (SAGA,))(lambda e: fold.compensations(e, "COMPENSATION_COMPLETED"))
add("F13_registered_compensations", "select distinct run_id, name from wf_saga where event_type = 'COMPENSATION_REGISTERED'", (SAGA,))(lambda e: fold.compensations(e, "COMPENSATION_REGISTERED"))
add("F14_log_length", "select run_id, count(*) as next_index from wf_events group by 1", (EV,))(fold.log_length)
add("F15_kind_counts", """select case status when 'finished' then 'completed' when 'paused' then 'paused' when 'queued' then 'running' when 'running' then 'running' else 'errored' end as kind, count(*) as n from wf_runs group by 1""", (RU,))(lambda r: fold.count_kinds(projections.classify(r.withColumn("event_count", F.lit(0)))))


@add("F16_sweep_counts", """with n as (select run_id, count(*) as n from wf_events group by 1), p as (select 'stale' as phase, n, least(n, 3) as r from n where n % 3 = 0
union all select 'due', n, least(n, 3) from n where n % 3 = 1) select phase, count(*) as runs, sum(n)::bigint as event_count, sum(r)::bigint as returned_event_count from p group by 1""", (EV,))  # fmt: skip
def _sweep_counts(e: DataFrame) -> DataFrame:
    n = fold.log_length(e).select(F.col("next_index").alias("event_count"), F.least("next_index", F.lit(3)).alias("returned"))
    return fold.sweep_counts({"stale": n.where("event_count % 3 = 0"), "due": n.where("event_count % 3 = 1")})


add("F17_materialized_count", "select count(*) as n from wf_schedules where enabled and every_ms > 0", (SC,))(lambda s: schedule.materialize(s.drop("cron"), FIRE).agg(F.count_if(F.col("verdict") == "materialized").alias("n")))
add("U12_compensation_plan", """with r as (select run_id, name, min(event_index) as first_at from wf_saga where event_type = 'COMPENSATION_REGISTERED' group by 1, 2)
select run_id, row_number() over (partition by run_id order by first_at desc) as position, name from r
where not exists (from wf_saga c where c.event_type = 'COMPENSATION_COMPLETED' and c.run_id = r.run_id and c.name = r.name)""", (SAGA,))(fold.compensation_plan)  # fmt: skip

# --- graphs ------------------------------------------------------------------------------------------------------

_REACH = "r(node) as (select unnest([{seeds}])::bigint union select {to} from wf_edges e join r on e.{by} = r.node)"


def _nodes(like: DataFrame, *ids: int) -> DataFrame:
    return like.sparkSession.createDataFrame([(i,) for i in ids], "node long")


add("G02_edge_faults", """with n as (select dst as node from wf_edges where dst % 2 = 1), e as (select src, dst from wf_edges union all select 3, 3)
select src, dst, case when src not in (from n) or dst not in (from n) then 'node_not_found' else 'self_loop' end as fault from e where src not in (from n) or dst not in (from n) or src = dst""", (ED,))(lambda e: graph.edge_faults(e.where("dst % 2 = 1").select(F.col("dst").alias("node")), e.union(e.sparkSession.createDataFrame([(3, 3)], "src long, dst long"))))  # fmt: skip
add("G01_nodes", "select src as node from wf_edges union select dst from wf_edges union select -substr(schedule_id, 2)::bigint from wf_schedules", (ED, SC))(
    lambda e, s: graph.nodes_of(e, s.select((-F.substring("schedule_id", 2, 20).cast("long")).alias("node")))
)
add("G03_counts", "select (select count(*) from (select src from wf_edges union select dst from wf_edges)) as nodes, (select count(*) from wf_edges) as edges", (ED,))(lambda e: graph.degrees(e).agg(F.count("*").alias("nodes"), F.sum("out_degree").alias("edges")))
add("G04_topo_level", """with l(node, level) as (select distinct src, 0 from wf_edges where src not in (select dst from wf_edges)
union select e.dst, l.level + 1 from wf_edges e join l on e.src = l.node) select node, max(level) as level from l group by 1""", (ED,))(graph.topological_levels)  # fmt: skip
add("G05_renumbered", """with l(node, level) as (select distinct src, 0 from wf_edges where src not in (select dst from wf_edges)
union select e.dst, l.level + 1 from wf_edges e join l on e.src = l.node), m as (select node, max(level) as level from l group by 1)
select node, row_number() over (order by level, node) - 1 as new_node from m""", (ED,))(lambda e: graph.renumbered(graph.topological_levels(e)))  # fmt: skip
add("G06_adjacency", """with n as (select src as node from wf_edges union select dst from wf_edges), d as (select node, count(src) as degree from n left join wf_edges on src = node group by 1)
select node, coalesce(sum(degree) over (order by node rows between unbounded preceding and 1 preceding), 0)::bigint as first, degree from d""", (ED,))(graph.adjacency)  # fmt: skip
add("G09_successors", "select dst as node from wf_edges where src = 5", (ED,))(lambda e: graph.successors(e, 5))
add("G11_predecessors", "select src as node from wf_edges where dst = 100", (ED,))(lambda e: graph.predecessors(e, 100))
add("G10_degrees", """with n as (select src as node from wf_edges union select dst from wf_edges)
select node, (select count(*) from wf_edges where src = node) as out_degree, (select count(*) from wf_edges where dst = node) as in_degree from n""", (ED,))(graph.degrees)  # fmt: skip
add("G12_descendants", f"with {_REACH.format(seeds='5', to='dst', by='src')} select node from r where node <> 5", (ED,))(lambda e: graph.descendants_from(e, _nodes(e, 5)))
add("G13_descendants_from", f"with {_REACH.format(seeds='5, 7', to='dst', by='src')} select node from r where node not in (5, 7)", (ED,))(lambda e: graph.descendants_from(e, _nodes(e, 5, 7)))
add("G14_ancestors_to", f"with {_REACH.format(seeds='199', to='src', by='dst')} select node from r where node <> 199", (ED,))(lambda e: graph.ancestors_to(e, _nodes(e, 199)))
_SUB = f"{_REACH.format(seeds='5', to='dst', by='src')}, {_REACH.format(seeds='180', to='src', by='dst').replace('r(node)', 'q(node)').replace('join r', 'join q').replace('r.node', 'q.node')}, k as (select node, row_number() over (order by node) - 1 as id from r join q using (node))"
add("G15_sub_dag_nodes", f"with {_SUB} select node from k", (ED,))(lambda e: graph.sub_dag_nodes(e, _nodes(e, 5), _nodes(e, 180)))
add("G16_sub_dag_edges", f"with {_SUB} select src, dst, a.id as new_src, b.id as new_dst from wf_edges join k a on a.node = src join k b on b.node = dst", (ED,))(lambda e: graph.sub_dag_edges(e, graph.sub_dag_nodes(e, _nodes(e, 5), _nodes(e, 180))))

add("G07_reverse_adjacency", """with n as (select src as node from wf_edges union select dst from wf_edges), d as (select node, count(dst) as degree from n left join wf_edges on dst = node group by 1)
select node, coalesce(sum(degree) over (order by node rows between unbounded preceding and 1 preceding), 0)::bigint as first, degree from d""", (ED,))(lambda e: graph.adjacency(graph.reversed_edges(e)))  # fmt: skip
add("G08_contains_node", "select node from (values (5::bigint), (100), (99999999)) x(node) where node in (select src from wf_edges union select dst from wf_edges)", (ED,))(lambda e: graph.contained(graph.nodes_of(e), _nodes(e, 5, 100, 99999999)))

# --- redo --------------------------------------------------------------------------------------------------------

CHAIN = [(f"step-{i}", f"step-{i + 1}") for i in range(7)]
#: Shapes of three workflows: a chain, a star and a diamond with a tail.
SHAPES = [("wf-0", *e) for e in CHAIN] + [("wf-1", "step-0", f"step-{i}") for i in range(1, 8)] + [("wf-2", a, b) for a, b in (("step-1", "step-2"), ("step-1", "step-3"), ("step-2", "step-5"), ("step-3", "step-5"), ("step-5", "step-7"))]
_SHAPES_SQL = "sh(workflow_id, src, dst) as (values " + ", ".join(f"('{w}', '{a}', '{b}')" for w, a, b in SHAPES) + """),
ru as (select distinct run_id, 'wf-' || (substr(run_id, 2)::bigint % 3) as workflow_id from wf_events), ss as (select workflow_id, src as step_id from sh union select workflow_id, dst from sh)"""
_REDO_SQL = "r(run_id, workflow_id, step_id) as (select * from {seeds} union select r.run_id, r.workflow_id, sh.dst from r join sh on sh.workflow_id = r.workflow_id and sh.src = r.step_id) select run_id, step_id from r"


def _chain(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame(CHAIN, "src string, dst string")


def _shapes(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame(SHAPES, "workflow_id string, src string, dst string")


def _named_runs(e: DataFrame) -> DataFrame:
    return e.select("run_id", F.concat(F.lit("wf-"), F.substring("run_id", 2, 20).cast("long") % 3).alias("workflow_id")).distinct()


def _good_edges(d: DataFrame) -> DataFrame:
    return redo.shape_edges(d.where("needs <> step_id and needs not like 'x%'"))


_GOOD = "ge as (select needs as src, step_id as dst from wf_deps where needs <> step_id and needs not like 'x%')"
_BELOW = "r(node) as (select * from {seeds} union select ge.dst from ge join r on ge.src = r.node)"


def _steps_like(d: DataFrame, ending: str) -> DataFrame:
    return d.where(F.col("step_id").endswith(ending)).select(F.col("step_id").alias("node")).distinct()


add("D01_shape_faults", """select step_id, 'duplicate_step' as fault from wf_steps group by 1 having count(*) > 1 union select step_id, 'self_loop' from wf_deps where step_id = needs
union select step_id, 'unknown_step' from wf_deps where needs not in (select step_id from wf_steps)""", (ST, DP))(redo.shape_faults)  # fmt: skip
add("D02_contains_step", f"with {_GOOD} select distinct 's' || 3 * substr(step_id, 2)::bigint as node from wf_steps where 's' || 3 * substr(step_id, 2)::bigint in (select src from ge union select dst from ge)", (ST, DP))(
    lambda s, d: graph.contained(graph.nodes_of(_good_edges(d)), s.select(F.concat(F.lit("s"), F.substring("step_id", 2, 20).cast("long") * 3).alias("node")).distinct())
)
add("D03_invalidation_set", f"with {_GOOD}, s as (select distinct step_id as node from wf_deps where step_id like '%37'), {_BELOW.format(seeds='s')} select node from r", (DP,))(lambda d: redo.invalidation_set(_good_edges(d), _steps_like(d, "37")))
add("D04_reseed_plan", f"""with {_SHAPES_SQL}, fi as (select distinct run_id, step_id from wf_events where event_type = 'STEP_FINISHED'),
un as (select run_id, workflow_id, step_id from ru join ss using (workflow_id) anti join fi using (run_id, step_id)), {_REDO_SQL.format(seeds="un")}""", (EV,))(lambda e: redo.reseed_plan(e, _shapes(e), _named_runs(e)))  # fmt: skip
add("D04_reseed_from_seeds", f"""with {_SHAPES_SQL}, un as (select run_id, workflow_id, step_id from ru join ss using (workflow_id) where step_id = 'step-5'), {_REDO_SQL.format(seeds="un")}""", (EV,))(
    lambda e: redo.reseed_plan(e, _shapes(e), _named_runs(e), e.sparkSession.createDataFrame([("step-5",)], "step_id string"))
)
add("D04_reseed_shared_shape", """with n as (select run_id, min(i) as first from (select distinct run_id from wf_events) u cross join range(8) x(i)
where not exists (from wf_events e where e.run_id = u.run_id and e.step_id = 'step-' || i and e.event_type = 'STEP_FINISHED') group by 1)
select run_id, 'step-' || i as step_id from n cross join range(8) x(i) where i >= first""", (EV,))(lambda e: redo.reseed_plan(e, _chain(e)))  # fmt: skip
add("D05_reseed_import", """select row_number() over (order by event_index) - 1 as new_index, step_id, event_index as source_index, ts from wf_events
where run_id = 'u1' and event_type = 'STEP_FINISHED' and step_id <> 'step-3'""", (EV,))(lambda e: redo.reseed_import(e, "u1", ["step-3"]))  # fmt: skip
_ASKED = "a as (select run_id, case when length(run_id) % 3 = 0 then run_id else replace(run_id, 'o', 'o1') end as source from wf_deliveries where signal_id = 's1')"
add("D06_reseed_verdicts", f"with {_ASKED} select run_id, source, case when run_id = source then 'validation_error' when source not in (select run_id from wf_runs) then 'run_lost' else 'ok' end as verdict from a", (RU, DE))(
    lambda r, d: redo.reseed_verdicts(_wanted(d).select("run_id", F.when(F.length("run_id") % 3 == 0, F.col("run_id")).otherwise(F.replace("run_id", F.lit("o"), F.lit("o1"))).alias("source")), r)
)
add("D07_step_actions", """with h as (select distinct step_id from wf_events where run_id = 'u1' and event_type = 'STEP_FINISHED' and body is not null)
select distinct step_id, case when step_id not in ('step-3', 'step-4') and step_id in (from h) then 'skip' else 'run' end as action from wf_events where run_id = 'u1'""", (EV,))(lambda e: redo.step_actions(e, "u1", ["step-3", "step-4"]))  # fmt: skip
add("D08_policy_plan", """with s as (select 'step-' || i as step_id, i from range(8) x(i)), h as (select step_id, arg_max(body, event_index) as result from wf_events where run_id = 'u1' and event_type = 'STEP_FINISHED' and body is not null group by 1),
f as (select least(4, coalesce(min(i), 8)) as first from s where step_id not in (select step_id from wf_events where run_id = 'u1' and event_type = 'STEP_FINISHED'))
select s.step_id, case when i < first and result is not null then 'skip' else 'run' end as action, case when i < first then result end as result from s cross join f left join h using (step_id)""", (EV,))(lambda e: redo.policy_plan(e, _chain(e), "u1", ["step-4"]))  # fmt: skip
add("D09_goal_boundary", """with f as (select run_id, step_id, min(event_index) as i from wf_events where event_type = 'STEP_FINISHED' and step_id in ('step-1', 'step-2') group by 1, 2),
d as (select run_id, max(i) as done_index from f group by 1 having count(*) = 2)
select run_id, done_index, (select min(event_index) from wf_events e where e.run_id = d.run_id and e.event_type = 'STEP_STARTED' and e.event_index > done_index) as park_index from d""", (EV,))(lambda e: redo.goal_boundaries(e, GOALS))  # fmt: skip
add("D10_goal_statuses", """select run_id, step_id, max(event_type = 'STEP_FINISHED')::boolean as done from wf_events where step_id in ('step-1', 'step-2') group by 1, 2""", (EV,))(lambda e: redo.goal_statuses(e, GOALS))
add("D11_stale_dependents", f"with {_GOOD}, s as (select distinct step_id as node from wf_deps where step_id like '%3'), {_BELOW.format(seeds='s')} select node from r where node not in (from s)", (DP,))(lambda d: redo.stale_dependents(_good_edges(d), _steps_like(d, "3")))

# --- leases, timers, signals -------------------------------------------------------------------------------------

_WANTED = "w as (select run_id from wf_deliveries where signal_id = 's1')"


def _wanted(d: DataFrame) -> DataFrame:
    return d.where("signal_id = 's1'").select("run_id")


_FREE = f"status not in ('finished', 'errored', 'aborted') and coalesce(lease_owner is null or lease_owner = '{OWNER}' or lease_expires_at <= {NOW}, true)"
add("L01_create_runs", f"with {_WANTED} select w.run_id, case when status is null then 'created' else 'existing' end as verdict, coalesce(status, 'queued') as status from w left join wf_runs using (run_id)", (RU, DE))(lambda r, d: transitions.create_runs(r, _wanted(d)))
add("L02_mark_paused", f"select run_id, 'paused' as status, '{TIMER}' as wait_name, {NOW}::bigint as wake_at, null::varchar as lease_owner, null::bigint as lease_expires_at from wf_runs where status = 'running'", (RU,))(lambda r: transitions.mark(r, r.where("status = 'running'"), "paused", TIMER, NOW))
add("L03_mark_finished", "select run_id, 'finished' as status, null::varchar as wait_name, null::bigint as wake_at, null::varchar as lease_owner, null::bigint as lease_expires_at from wf_runs where status = 'paused'", (RU,))(lambda r: transitions.mark(r, r.where("status = 'paused'"), "finished"))
add("L04_mark_errored", "select run_id, 'errored' as status, null::varchar as wait_name, null::bigint as wake_at, null::varchar as lease_owner, null::bigint as lease_expires_at from wf_runs where status = 'queued'", (RU,))(lambda r: transitions.mark(r, r.where("status = 'queued'"), "errored"))
add("L10_is_cancelled", "select run_id, status = 'aborted' as cancelled from wf_runs", (RU,))(lambda r: r.select("run_id", (F.col("status") == "aborted").alias("cancelled")))
add("L05_claim_verdict", f"select run_id, case when {_FREE} then 'claimed' else 'not_claimable' end as verdict, case when {_FREE} then {NOW + 30_000}::bigint end as new_expires_at from wf_runs", (RU,))(lambda r: transitions.claim_verdicts(r, r, OWNER, NOW))
add("L06_heartbeat", f"select run_id, {NOW + 30_000}::bigint as lease_expires_at, {NOW}::bigint as updated_at from wf_runs where lease_owner = '{OWNER}'", (RU,))(lambda r: transitions.heartbeat(r, OWNER, NOW))
add("L07_release", f"select run_id, status from wf_runs where lease_owner = '{OWNER}'", (RU,))(lambda r: transitions.release(r, OWNER))
add("L08_stale_top_k", f"""select run_id, '{OWNER}' as new_lease_owner, {NOW + 30_000}::bigint as new_expires_at, {NOW}::bigint as updated_at from wf_runs where status = 'running' and lease_expires_at <= {NOW}
order by wf_runs.updated_at, run_id limit 25""", (RU,))(lambda r: transitions.claim_stale(r, OWNER, NOW))  # fmt: skip
add("L09_cancel_verdict", f"""with {_WANTED} select w.run_id, case when status is null then 'not_found' when status in ('finished', 'errored', 'aborted') then 'no_op' else 'aborted' end as verdict,
case when status in ('queued', 'running', 'paused') then 'aborted' else status end as status from w left join wf_runs using (run_id)""", (RU, DE))(lambda r, d: transitions.cancel_verdicts(r, _wanted(d)))  # fmt: skip
add("L11_project_waits", f"""select run_id, case when status in ('finished', 'errored', 'aborted') then status else 'paused' end as status,
case when status not in ('finished', 'errored', 'aborted') then '{TIMER}' end as wait_name, case when status not in ('finished', 'errored', 'aborted') then updated_at + 5 end as wake_at from wf_runs""", (RU,))(lambda r: transitions.project_waits(r, r.select("run_id", F.lit(TIMER).alias("name"), (F.col("updated_at") + 5).alias("deadline"))))  # fmt: skip
add("L12_resume", "select run_id, 'running' as status, null::varchar as wait_name from wf_runs where status = 'paused'", (RU,))(transitions.resume)
add("L14_lease_ms", "select run_id, coalesce(wake_at % 1000, lease_expires_at % 1000, 30000) as lease_ms from wf_runs", (RU,))(lambda r: r.select("run_id", transitions.lease_ms(F.col("lease_expires_at") % 1000, F.col("wake_at") % 1000).cast("long").alias("lease_ms")))
_TIMERS = "t as (select run_id, 't' as signal_id, wake_at, null::varchar as lease_owner, null::bigint as lease_expires_at from wf_runs where wake_at is not null)"


def _timers(r: DataFrame) -> DataFrame:
    return r.where("wake_at is not null").select("run_id", F.lit("t").alias("signal_id"), "wake_at", F.lit(None).cast("string").alias("lease_owner"), F.lit(None).cast("long").alias("lease_expires_at"))


add("T01_schedule_timers", f"with {_TIMERS} select run_id, signal_id, case when wake_at % 2000 = 0 then 1 else wake_at end::bigint as wake_at, lease_owner, lease_expires_at from t", (RU,))(lambda r: transitions.schedule_timers(_timers(r), _timers(r).where("wake_at % 2000 = 0").withColumn("wake_at", F.lit(1).cast("long"))))
add("T02_due_timers", f"with {_TIMERS} select run_id, signal_id, wake_at, '{OWNER}' as new_lease_owner, {NOW + 30_000}::bigint as new_expires_at from t where wake_at <= {NOW} order by wake_at, run_id limit 25", (RU,))(lambda r: transitions.due_timers(_timers(r), OWNER, NOW))


def _sequential(key: str, per: str, could: str, done: str, rows: str = "wf_arrivals", prior: str = "already_delivered") -> str:
    """Deliveries one by one: the state changes with the first that is accepted."""
    return f"""with d as (select d.*, r.status, r.wait_name, {key} as key, coalesce({prior}, false) as prior from {rows} d left join wf_runs r using (run_id)),
o as (select *, count(*) filter (status is not null and not prior and coalesce({could}, false)) over (partition by {per} order by arrival rows unbounded preceding) as taken,
  status is not null and not prior and coalesce({could}, false) as fits from d),
f as (select {per}, key as first_key, arrival as first_at from o where fits and taken = 1)
select o.run_id, o.key, o.arrival, case when status is null then 'not_found' when prior then 'duplicate' when arrival = first_at then '{done}'
  when arrival > first_at and o.key = first_key then 'duplicate' else 'not_waiting' end as verdict from o left join f using ({per})"""


_PAUSED_FOR = "status = 'paused' and wait_name = name"
add("T03_deliver_verdict", _sequential("signal_id", "run_id", _PAUSED_FOR, "delivered").replace("o.key,", "o.key as signal_id,", 1), (AR, RU))(lambda d, r: transitions.deliver_signals(r, d))
add("T04_deliver_approval", _sequential("'approval:' || name", "run_id", _PAUSED_FOR, "delivered"), (AR, RU))(lambda d, r: transitions.deliver_approvals(r, d.select("run_id", F.col("name").alias("approval_id"), "arrival", "already_delivered")))
_BOXED = "(select *, run_id in (select run_id from wf_runs where workflow_id = 'wf-2') and signal_id = 's2' as boxed from wf_arrivals)"
add("T05_buffer_verdict", _sequential("signal_id", "run_id, signal_id", f"status not in ('finished', 'errored', 'aborted') and name <> '{TIMER}'", "buffered", _BOXED, "already_delivered or boxed").replace("o.key,", "o.signal_id,", 1), (AR, RU))(
    lambda d, r: transitions.buffer_signals(r, d, r.where("workflow_id = 'wf-2'").select("run_id", F.lit("s2").alias("signal_id")))
)
add("W03_first_deliveries", "select distinct run_id, signal_id from wf_arrivals", (AR,))(lambda d: live.first_deliveries(d).select("run_id", "signal_id"))
add("T06_inbox_head", """select run_id, name, arg_min(signal_id, signal_id) as signal_id from wf_deliveries group by 1, 2""", (DE,))(lambda d: transitions.inbox_heads(d.withColumn("sequence", F.col("signal_id"))))
add("T07_step_signal_verdict", """with a as (select run_id, step_id, arg_max(name, event_index) as name from wf_events where event_type = 'SIGNAL_AWAITED' group by 1, 2), s as (select distinct run_id, step_id from wf_events)
select s.run_id, s.step_id, name, case when name is null then 'lost' else 'resolved' end as verdict from s left join a using (run_id, step_id)""", (EV,))(lambda e: transitions.step_signal_verdicts(e, e.select("run_id", "step_id").distinct()))  # fmt: skip
add("T09_approval_verdict", """with s as (select distinct run_id, name from wf_events) select run_id, name, case when exists (from wf_events e where e.run_id = s.run_id and e.name = s.name and e.event_type = 'APPROVAL_REQUESTED')
then 'resolved' else 'lost' end as verdict from s""", (EV,))(lambda e: transitions.approval_verdicts(e, e.select("run_id", "name").distinct()))  # fmt: skip
add("T08_signal_verdict", """with a as (select run_id, name, arg_max(step_id, event_index) as step_id from wf_events where event_type = 'SIGNAL_AWAITED' group by 1, 2),
s as (select distinct run_id, 'sig-' || i as name from wf_events cross join range(4) x(i)) select s.run_id, s.name, step_id, case when step_id is null then 'lost' else 'resolved' end as verdict
from s left join a using (run_id, name)""", (EV,))(lambda e: transitions.signal_verdicts(e, e.select("run_id").distinct().withColumn("name", F.explode(F.array(*[F.lit(f"sig-{i}") for i in range(4)])))))  # fmt: skip
add("T10_timers_from_runs", f"select run_id, 'timer:' || run_id || ':{TIMER}:' || wake_at as signal_id, wake_at from wf_runs where status = 'paused' and wait_name = '{TIMER}' and wake_at is not null", (RU,))(transitions.timers_from_runs)

# --- schedules ---------------------------------------------------------------------------------------------------


#: The fields of wf_schedules.cron, worked out from the number of a schedule as that view writes them.
_CRON_SQL = """p as (select *, substr(schedule_id, 2)::bigint as p from wf_schedules where cron is not null),
v as (select schedule_id, p % 5 as kind, case p % 5 when 0 then [p % 6 * 10] when 1 then [0, 15, 30, 45] when 2 then [p % 6 * 10] when 3 then [0] end as mi,
  case p % 5 when 1 then range(9, 18) when 2 then [p % 4 * 5] when 3 then [p % 24] else range(24) end as ho,
  case p % 5 when 2 then [p % 7 * 4 + 1] when 3 then [p % 31 + 1] else range(1, 32) end as da, case p % 5 when 3 then [p % 12 + 1] else range(1, 13) end as mo,
  case p % 5 when 1 then range(1, 6) when 2 then [p % 8 % 7] else range(7) end as wd from p),
u as (select *, [kind, list_sum(mi), list_sum(ho), len(da) * 100 + da[1], len(mo) * 100 + mo[1], len(wd) * 100 + wd[1]] as id from v where mi is not null),
m as (select epoch_ms(t) as ms, minute(t) as mi, hour(t) as ho, day(t) as da, month(t) as mo, dayofweek(t) as wd from (select make_timestamp({top}000::bigint - i * 60000000) as t from range({n}) x(i))),
e as (select any_value(kind) as kind, any_value(mi) as mi, any_value(ho) as ho, any_value(da) as da, any_value(mo) as mo, any_value(wd) as wd, id from u group by id),
f as (select e.id, max(ms) as fire_at from e join m on list_contains(e.mi, m.mi) and list_contains(e.ho, m.ho) and list_contains(e.mo, m.mo)
  and case when e.kind = 2 then list_contains(e.da, m.da) or list_contains(e.wd, m.wd) else list_contains(e.da, m.da) and list_contains(e.wd, m.wd) end group by 1),
c as (select p.schedule_id, p.enabled, u.id is not null as valid, f.fire_at from p left join u using (schedule_id) left join f using (id))
""".replace("{top}", str(FIRE - FIRE % 60_000)).replace("{n}", str(schedule.LOOKBACK_MS // 60_000 + 1))


def _cron(s: DataFrame) -> DataFrame:
    return s.where("cron is not null").select("schedule_id", "enabled", schedule.cron_fields(F.col("cron")).alias("c"))


_WORK_HOURS = "*/20 8-18/2 * * 1-5,0"
add("C02_valid_expressions", "select schedule_id, substr(schedule_id, 2)::bigint % 5 <> 4 as valid from wf_schedules where cron is not null", (SC,))(lambda s: _cron(s).select("schedule_id", F.col("c").isNotNull().alias("valid")))
add("C03_field_values", f"with {_CRON_SQL} select schedule_id, unnest(mi)::int as minute from u", (SC,))(lambda s: _cron(s).select("schedule_id", F.explode("c.minute").alias("minute")))
add("C04_cron_match", "with t as (select run_id, event_index, make_timestamp(ts * 1000) as t from wf_events) select run_id, event_index, minute(t) % 20 = 0 and hour(t) between 8 and 18 and hour(t) % 2 = 0 and dayofweek(t) <> 6 as hit from t", (EV,))(
    lambda e: e.select("run_id", "event_index", schedule.cron_matches(F.col("ts"), schedule.cron_fields(_WORK_HOURS)).alias("hit"))
)
add("C05_interval_fire", f"select schedule_id, case when every_ms > 0 then {FIRE}::bigint - {FIRE}::bigint % every_ms end as fire_at from wf_schedules", (SC,))(lambda s: s.select("schedule_id", schedule.interval_fire(F.lit(FIRE).cast("long"), F.col("every_ms")).alias("fire_at")))
add("C06_previous_fire", f"with {_CRON_SQL} select schedule_id, fire_at from c", (SC,))(lambda s: _cron(s).select("schedule_id", schedule.previous_cron_fire(F.lit(FIRE).cast("long"), F.col("c")).alias("fire_at")))
add("C07_floor_to_minute", "select run_id, event_index, (ts - ts % 60000)::bigint as m from wf_events", (EV,))(lambda e: e.select("run_id", "event_index", schedule.floor_to_minute(F.col("ts")).alias("m")))
add("C08_utc_parts", """with t as (select run_id, event_index, make_timestamp(ts * 1000) as t from wf_events)
select run_id, event_index, year(t)::int as year, month(t)::int as month, day(t)::int as day, hour(t)::int as hour, minute(t)::int as minute, dayofweek(t)::int as weekday from t""", (EV,))(lambda e: e.select("run_id", "event_index", *[c.alias(n) for n, c in schedule.utc_parts(F.col("ts")).items()]))  # fmt: skip
add("C09_materialize", f"""with {_CRON_SQL}, b as (select schedule_id, enabled, every_ms > 0 as valid, case when every_ms > 0 then {FIRE}::bigint - {FIRE}::bigint % every_ms end as fire_at from wf_schedules where every_ms is not null
union all select schedule_id, enabled, valid, fire_at from c), w as (select *, case when not enabled then 'disabled' when not valid then 'error' when fire_at is null then 'not_due' else 'materialized' end as verdict from b)
select schedule_id, verdict, case when verdict = 'materialized' then fire_at end as fire_at from w""", (SC,))(lambda s: schedule.materialize(s, FIRE))  # fmt: skip
_DUE = f"d as (select schedule_id, workflow_id, ({FIRE}::bigint - {FIRE}::bigint % every_ms) as fire_at from wf_schedules where enabled and every_ms > 0)"


def _due(s: DataFrame) -> DataFrame:
    return s.where("enabled and every_ms > 0").select("schedule_id", "workflow_id", schedule.interval_fire(F.lit(FIRE).cast("long"), F.col("every_ms")).alias("fire_at"))


add("C10_upsert_schedules", "select schedule_id, case when schedule_id like 's1%' then 'wf-new' else workflow_id end as workflow_id, every_ms, cron, enabled from wf_schedules", (SC,))(lambda s: transitions.upsert_schedules(s, s.where("schedule_id like 's1%'").withColumn("workflow_id", F.lit("wf-new"))))
add("C11_due_buckets", f"with {_DUE} select schedule_id, fire_at::varchar as bucket_id, workflow_id || ':' || schedule_id || ':' || fire_at as run_id, fire_at, '{OWNER}' as new_lease_owner, {FIRE + 30_000}::bigint as new_expires_at from d", (SC,))(lambda s: transitions.due_buckets(_due(s), None, OWNER, FIRE))


@add("C12_started_buckets", f"with {_DUE} select schedule_id, fire_at::varchar as bucket_id, workflow_id || ':' || schedule_id || ':' || fire_at as run_id, fire_at, '{OWNER}' as new_lease_owner, {FIRE + 30_000}::bigint as new_expires_at from d where schedule_id not like 's2%' order by fire_at, schedule_id limit 30", (SC,))
def _started(s: DataFrame) -> DataFrame:
    """Started buckets are dropped before the limit."""
    made = transitions.due_buckets(_due(s), None, OWNER, FIRE)
    open_buckets = made.select("schedule_id", "bucket_id", "run_id", F.lit("open").alias("status"), F.lit(None).cast("string").alias("lease_owner"), F.lit(None).cast("long").alias("lease_expires_at"))
    buckets = transitions.start_buckets(open_buckets, made.where("schedule_id like 's2%'"))
    return transitions.due_buckets(_due(s), buckets, OWNER, FIRE, 30)


# --- functions ---------------------------------------------------------------------------------------------------

_PAIR = "b as (select run_id, event_index, body as new, lag(body) over (partition by run_id order by event_index) as old from wf_events where body is not null)"


def _changed(key: str) -> str:
    o, n = f"json_extract(old, '$.{key}')::varchar", f"json_extract(new, '$.{key}')::varchar"
    return f"case when {o} is null and {n} is not null then 'add /{key} ' || {n} when {n} is null and {o} is not null then 'remove /{key}' when {o} <> {n} then 'replace /{key} ' || {n} end"


_DELTA = f"array_to_string(list_filter([{_changed('approved')}, {_changed('feedback')}, {_changed('k')}], lambda x: x is not null), ' ')"


def _shown(delta: str) -> Column:
    return F.array_join(F.transform(delta, lambda o: F.concat_ws(" ", o["op"], o["path"], o["value"])), " ")


@add("J01_flat_diff", f"with {_PAIR} select run_id, event_index, {_DELTA} as delta from b where old is not null", (EV,))
def _diffs(e: DataFrame) -> DataFrame:
    before = F.lag("body").over(Window.partitionBy("run_id").orderBy("event_index"))
    both = e.where("body is not null").withColumn("old", before).where("old is not null")
    return both.withColumn("d", jsonfn.diff_state("old", "body")).select("run_id", "event_index", _shown("d").alias("delta"))


add("J02_escape_pointer", r"select segment, replace(replace(segment, '~', '~0'), '/', '~1') as escaped from (values ('a/b'), ('~'), ('~1/'), (''), ('é//~~')) x(segment)")(lambda s: s.createDataFrame([("a/b",), ("~",), ("~1/",), ("",), ("é//~~",)], "segment string").select("segment", jsonfn.escape_pointer(F.col("segment")).alias("escaped")))
@add("J04_merged", """select run_id, k, v from (select run_id, unnest(['status', 'workflow', 'wait']) as k, unnest([status, case when wait_name is not null then 'parked' else workflow_id end, wait_name]) as v from wf_runs) where v is not null""", (RU,))
def _merged(r: DataFrame) -> DataFrame:
    ours = F.create_map(F.lit("status"), "status", F.lit("workflow"), "workflow_id")
    theirs = F.when(F.col("wait_name").isNotNull(), F.create_map(F.lit("workflow"), F.lit("parked"), F.lit("wait"), "wait_name")).otherwise(F.expr("cast(map() as map<string, string>)"))
    return r.select("run_id", F.explode(jsonfn.merged(ours, theirs)).alias("k", "v"))


add("J05_field", "select run_id, event_index, cast(json_extract_string(body, '$.k') as bigint) as k from wf_events", (EV,))(lambda e: e.select("run_id", "event_index", jsonfn.field(F.col("body"), "$.k", "long").alias("k")))
add("J06_json_null", """select run_id, event_index, case when coalesce(step_id, '') in ('step-1', 'step-2') then step_id = 'step-1' end as present_null from wf_events""", (EV,))(
    lambda e: e.withColumn("t", F.when(F.col("step_id") == "step-1", '{"b":null}').when(F.col("step_id") == "step-2", '{"b":1}').otherwise("{}"))
    .select("run_id", "event_index", F.when(F.variant_get(F.parse_json("t"), "$.b", "variant").isNotNull(), jsonfn.is_json_null(F.col("t"), "$.b")).alias("present_null"))
)
_SHAPE = {"k": ("integer", True), "approved": ("boolean", False), "feedback": ("string", True)}
_FAULTS = """case when body is null then 'not_json' else array_to_string(list_filter([case when json_extract(body, '$.k') is null then 'missing:k' end, case when json_extract(body, '$.feedback') is null then 'missing:feedback' end], lambda x: x is not null), ' ') end"""
add("J07_payload_faults", f"select run_id, event_index, {_FAULTS} as faults from wf_events", (EV,))(lambda e: e.select("run_id", "event_index", F.array_join(jsonfn.payload_faults(F.col("body"), _SHAPE), " ").alias("faults")))
add("J08_stage_verdicts", """select run_id, event_index, case when body is null then 'input:not_json' when json_extract(body, '$.approved') is null then 'state:missing:approved' when json_extract(body, '$.feedback')::varchar is not null then 'output:type:feedback' end as fault from wf_events""", (EV,))(
    lambda e: e.select("run_id", "event_index", jsonfn.first_fault({"input": jsonfn.payload_faults(F.col("body"), {"k": ("integer", True)}), "state": jsonfn.payload_faults(F.col("body"), {"approved": ("boolean", True)}), "output": jsonfn.payload_faults(F.col("body"), {"feedback": ("number", False)})}).alias("fault"))
)
add("J09_backoff", "select i as attempt, least(100::hugeint * (2::hugeint ** least(i - 1, 62))::hugeint, 9223372036854775807::hugeint)::bigint as delay_ms from range(1, 71) x(i)")(lambda s: s.range(1, 71).select(F.col("id").alias("attempt"), jsonfn.backoff_ms(F.col("id"), 100).alias("delay_ms")))
add("J10_keys", "select run_id || ':' || signal_id as key, 'approval:' || name as approval from wf_deliveries", (DE,))(lambda d: d.select(jsonfn.key(F.col("run_id"), F.col("signal_id")).alias("key"), jsonfn.key("approval", F.col("name")).alias("approval")))
PAIRS = [(10, 5, 3), (None, 5, 3), (7, None, 3), (None, None, 1), (1, 5, None)]
add("J11_deadline", "with x(a, b, m) as (values (10, 5, 3), (null, 5, 3), (7, null, 3), (null, null, 1), (1, 5, null)) select a, b, m, least(a, b + m) as deadline from x")(lambda s: s.createDataFrame(PAIRS, "a int, b int, m int").select("a", "b", "m", jsonfn.deadline(F.col("a"), F.col("b"), F.col("m")).alias("deadline")))
add("J12_stop_and_yield", f"select run_id, coalesce(wake_at - {NOW} <= 1000, false) as stop, coalesce(wake_at - {NOW} < 1000, false) as yields from wf_runs", (RU,))(lambda r: r.select("run_id", jsonfn.should_stop(F.col("wake_at"), F.lit(NOW)).alias("stop"), jsonfn.should_yield(F.col("wake_at"), F.lit(NOW)).alias("yields")))
add("J13_events_truncated", "select run_id, case when count(*) > 20 then true end as truncated from wf_events group by 1", (EV,))(lambda e: fold.log_length(e).select("run_id", jsonfn.events_truncated(F.col("next_index"), F.lit(20)).alias("truncated")))
add("J14_kept_events", "select run_id, event_index from wf_events where event_index < 7", (EV,))(lambda e: e.where(jsonfn.kept_events(F.col("event_index"), 7)).select("run_id", "event_index"))

# --- live --------------------------------------------------------------------------------------------------------


_STATUSED = "r as (select distinct run_id, case substr(run_id, 2)::bigint % 3 when 0 then 'finished' when 1 then 'errored' else 'running' end as status from wf_events)"


def _statused(e: DataFrame) -> DataFrame:
    number = F.substring("run_id", 2, 20).cast("long") % 3
    return e.select("run_id", F.when(number == 0, "finished").when(number == 1, "errored").otherwise("running").alias("status")).distinct()


@add("W05_drained", f"with {_STATUSED} select run_id, greatest(count(*) - 10, 0)::bigint as n_events, any_value(status) as status, null::varchar as wait_name from wf_events join r using (run_id) group by 1", (EV,))
def _drained(e: DataFrame) -> DataFrame:
    runs = _statused(e).withColumn("wait_name", F.lit(None).cast("string")).withColumn("wake_at", F.lit(None).cast("long"))
    return log.drained(runs, e, runs.select("run_id", F.lit(10).cast("long").alias("from_index")))


@add("W06_attach", f"""with {_STATUSED}, n as (select run_id, count(*) as n from wf_events group by 1)
select run_id, 0::bigint as position, 'RUN_STARTED' as event_type from r union all select run_id, event_index + 1, event_type from wf_events
union all select run_id, n + 1, case status when 'finished' then 'RUN_FINISHED' else 'RUN_ERRORED' end from r join n using (run_id) where status <> 'running'""", (EV,))  # fmt: skip
def _attach(e: DataFrame) -> DataFrame:
    return log.attach(_statused(e), e)


@add("W07_state_deltas", f"with {_PAIR} select run_id, event_index, {_DELTA} as delta from b where old is not null and old <> new", (EV,))
def _deltas(e: DataFrame) -> DataFrame:
    states = e.where("body is not null").select("run_id", "event_index", F.col("body").alias("state"))
    return live.state_deltas(states).select("run_id", "event_index", _shown("delta").alias("delta"))


@add("W08_emitted", "select run_id, 'STEP_PROGRESS' as event_type, step_id, name, body, ts from wf_events where event_type = 'STEP_STARTED'", (EV,))
def _emitted(e: DataFrame) -> DataFrame:
    shown = live.emitted(e.where("event_type = 'STEP_STARTED'"), "STEP_PROGRESS")
    return shown.where("event_index is null").select("run_id", "event_type", "step_id", "name", "body", "ts")


@add("W09_live_step_states", _STATES + "select * from s", (EV,))
def _live(e: DataFrame) -> DataFrame:
    return live.replay_step_states(e, f"{shared_dir(e.sparkSession)}/live-{uuid.uuid4().hex}")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracle)
