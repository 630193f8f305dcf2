"""Log tables derived from the star-schema tables: one template a view, rendered for Spark and for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = {
    "wf_events": "events", "wf_saga": "events", "wf_edges": "part", "wf_runs": "orders", "wf_deliveries": "lineitem", "wf_arrivals": "lineitem", "wf_schedules": "part",
    "wf_steps": "part", "wf_deps": "part",
}

TEMPLATES = {
    "wf_events": """
select 'u' || cast(user_id as string) as run_id,
  cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as event_index,
  case when event_type = 'signup' then case when k % 4 = 3 then 'APPROVAL_REQUESTED' else 'SIGNAL_AWAITED' end
       when event_type = 'view' then case when k % 10 = 9 then 'STEP_RETRY_SCHEDULED' else 'STEP_STARTED' end
       when event_type = 'click' then 'STEP_FINISHED'
       when event_type = 'error' then 'STEP_FAILED'
       else case when k % 4 = 3 then 'APPROVAL_RESOLVED' else 'SIGNAL_RESOLVED' end end as event_type,
  'step-' || cast(k % 8 as string) as step_id, 'sig-' || cast(k % 3 as string) as name,
  case when k % 2 = 0 then ms + k * 60000 end as deadline,
  case when k % 5 = 0 then null
       when event_type not in ('signup', 'view', 'click', 'error') and k % 4 = 3
         then '{"k":' || cast(k as string) || ',"approved":' || case when k % 8 = 3 then 'true' else 'false' end || ',"feedback":"f' || cast(k % 3 as string) || '"}'
       else props end as body, ms as ts
from (select e.*, {K} as k, {MS:ts} as ms from events e) x""",
    "wf_saga": """
select 'u' || cast(user_id as string) as run_id,
  cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as event_index,
  case k % 6 when 0 then 'NOW_RECORDED' when 1 then 'UUID_RECORDED' when 2 then 'COMPENSATION_REGISTERED'
       when 3 then 'COMPENSATION_COMPLETED' when 4 then 'COMPENSATION_REGISTERED' else 'CUSTOM' end as event_type,
  case k % 6 when 0 then '__now-' || cast(k % 4 as string) when 1 then '__uuid-' || cast(k % 4 as string) end as step_id,
  case when k % 6 in (2, 3, 4) then 'undo-' || cast(k % 7 as string) end as name, cast(null as bigint) as deadline, props as body, ms as ts
from (select e.*, {K} as k, {MS:ts} as ms from events e) x""",
    "wf_edges": """
select {DIV:p_partkey,2} as src, p_partkey as dst from part where p_partkey >= 2
union select {DIV:p_partkey,3} as src, p_partkey as dst from part where p_partkey >= 3""",
    "wf_runs": """
select 'o' || cast(o_orderkey as string) as run_id, 'wf-' || cast(o_custkey % 5 as string) as workflow_id,
  case o_custkey % 3 when 1 then 'v1' when 2 then 'v2' end as workflow_version,
  case o_orderkey % 6 when 0 then 'queued' when 1 then 'running' when 2 then 'paused' when 3 then 'finished' when 4 then 'errored' else 'aborted' end as status,
  case when o_orderkey % 6 = 2 then case when o_orderkey % 4 = 2 then '__timer' else 'sig-' || cast(o_custkey % 3 as string) end end as wait_name,
  case when o_orderkey % 6 = 2 and o_orderkey % 4 = 2 then ms + (o_custkey % 1000) * 1000 end as wake_at,
  case when o_orderkey % 6 = 1 and o_custkey % 10 <> 0 then 'worker-' || cast(o_custkey % 7 as string) end as lease_owner,
  case when o_orderkey % 6 = 1 and o_custkey % 10 <> 0 then ms + (o_custkey % 100) * 1000 end as lease_expires_at,
  ms as created_at, ms + o_orderkey as updated_at
from (select o.*, {MS:o_orderdate} as ms from orders o) x""",
    "wf_deliveries": """
select case when l_orderkey % 11 = 0 then 'missing-' else 'o' end || cast(l_orderkey as string) as run_id,
  's' || cast(l_linenumber as string) as signal_id, 'sig-' || cast(l_linenumber % 3 as string) as name,
  l_linenumber = 1 and l_orderkey % 5 = 0 as already_delivered
from (select distinct l_orderkey, l_linenumber from lineitem) x""",
    "wf_arrivals": """
select case when l_orderkey % 11 = 0 then 'missing-' else 'o' end || cast(l_orderkey as string) as run_id,
  's' || cast(l_linenumber as string) as signal_id, case when l_linenumber = 4 then '__timer' else 'sig-' || cast(l_linenumber % 3 as string) end as name,
  cast(again * 10 + (l_linenumber * 5 + l_orderkey) % 7 as bigint) as arrival, l_linenumber = 1 and l_orderkey % 5 = 0 as already_delivered
from (select distinct l_orderkey, l_linenumber from lineitem) x cross join (select 0 as again union all select 1) y where again = 0 or l_linenumber % 3 <> 2""",
    "wf_schedules": """
select 's' || cast(p_partkey as string) as schedule_id, 'wf-' || cast(p_partkey % 5 as string) as workflow_id,
  case when p_partkey % 2 = 0 then cast(p_size as bigint) * 60000 * (case when p_partkey % 46 = 0 then -1 else 1 end) end as every_ms,
  case when p_partkey % 2 = 1 then case p_partkey % 5
    when 0 then cast(p_partkey % 6 * 10 as string) || ' * * * *'
    when 1 then '*/15 9-17 * * 1-5'
    when 2 then cast(p_partkey % 6 * 10 as string) || ' ' || cast(p_partkey % 4 * 5 as string) || ' ' || cast(p_partkey % 7 * 4 + 1 as string) || ' * ' || cast(p_partkey % 8 as string)
    when 3 then '0 ' || cast(p_partkey % 24 as string) || ' ' || cast(p_partkey % 31 + 1 as string) || ' ' || cast(p_partkey % 12 + 1 as string) || ' *'
    else '61 * * * *' end end as cron,
  p_partkey % 7 <> 0 as enabled from part where p_size > 0""",
    "wf_steps": """
select 's' || cast(p_partkey as string) as step_id from part union all select 's' || cast(p_partkey as string) from part where p_partkey % 97 = 0""",
    "wf_deps": """
select 's' || cast(p_partkey as string) as step_id, 's' || cast({DIV:p_partkey,2} as string) as needs from part where p_partkey >= 2
union all select 's' || cast(p_partkey as string), 's' || cast(p_partkey as string) from part where p_partkey % 89 = 0
union all select 's' || cast(p_partkey as string), 'x' || cast(p_partkey as string) from part where p_partkey % 83 = 0""",
}

_DIALECTS = {
    "spark": {"MS": "unix_millis(cast({0} as timestamp))", "DIV": "({0} div {1})", "K": "cast(get_json_object(props, '$.k') as bigint)"},
    "duckdb": {"MS": "(epoch_us({0}) // 1000)", "DIV": "({0} // {1})", "K": "cast(json_extract_string(props, '$.k') as bigint)"},
}


def render(name: str, dialect: str) -> str:
    put = _DIALECTS[dialect]
    return re.sub(r"\{(MS|DIV|K):?([^}]*)\}", lambda m: put[m[1]].format(*m[2].split(",")), TEMPLATES[name])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base = BASE[name]
    rows = spark.read.parquet(f"{sf_dir}/{base}.parquet")
    text = render(name, "spark").replace("{", "{{").replace("}", "}}")  # braces of JSON
    return spark.sql(re.sub(rf"\bfrom {base}\b", "from {rows}", text), rows=rows)


def duckdb_ctes(*names: str) -> str:
    return ", ".join(f"{n} as ({render(n, 'duckdb')})" for n in names)
