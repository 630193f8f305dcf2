import json

import pytest
from pyspark.sql import functions as F
from runledger.functions import jsonfn, schedule
from runledger.operators import fold, graph, projections, redo, transitions
from runledger.sources import log
from runledger.streaming import live

#: A Thursday, 2025-10-09 14:22:05 UTC.
THURSDAY = 1_760_019_725_000
E = "run_id string, event_index long, event_type string, step_id string, name string, deadline long, body string, ts long"


def sequential(rows):
    """The fold, event by event."""
    out = {}
    for run, _, kind, step, _, deadline, body, ts in sorted(rows, key=lambda r: (r[0], r[1])):
        if kind not in fold.FOLDED:
            continue
        s = out.setdefault((run, step), {"status": "pending", "result": None, "error": None, "start": None, "end": None})
        if kind == "STEP_STARTED":
            s.update(status="running", start=ts)
        elif kind == "STEP_FINISHED":
            s.update(status="success", result=body, error=None, end=ts)
        elif kind == "STEP_FAILED":
            s.update(status="failed", error=body, end=ts)
        elif kind in fold.AWAITS:
            if s["status"] not in ("success", "failed"):
                s["status"] = "paused"
            s["start"] = ts if s["start"] is None else s["start"]
            if kind == "SIGNAL_AWAITED" and deadline is not None:
                s["end"] = deadline
        elif kind == "APPROVAL_RESOLVED":
            got = json.loads(body) if body and body.startswith("{") else {}
            s["result"] = json.dumps({"approved": got.get("approved"), "feedback": got.get("feedback")}, separators=(",", ":"))
        else:
            s["result"] = body
    return {k: tuple(s.values()) for k, s in out.items()}


def test_fold_equals_sequential_on_random_logs(spark):
    import random

    rng = random.Random(1)
    kinds = [*fold.FOLDED, "CUSTOM", "STEP_RETRY_SCHEDULED"]
    rows = [(f"r{r}", i, rng.choice(kinds), f"s{rng.randrange(3)}", "n", rng.choice([None, 5000 + i]), rng.choice([None, f"b{i}", '{"approved":true,"feedback":"f"}', '{"approved":false}']), 100 + i) for r in range(150) for i in range(rng.randint(0, 12))]
    rows.append(("lonely", 0, "CUSTOM", "s0", None, None, None, 1))
    got = {(r.run_id, r.step_id): tuple(r)[2:] for r in fold.fold_step_states(spark.createDataFrame(rows, E)).collect()}
    assert got == sequential(rows)


def test_levels_closures_and_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (1, 2)], "src long, dst long")
    assert {r.node: r.level for r in graph.topological_levels(edges).collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3}
    seeds = spark.createDataFrame([(1,), (4,)], "node long")
    assert {r.node for r in graph.descendants_from(edges, seeds).collect()} == {2, 3, 5}
    assert {r.node for r in graph.ancestors_to(edges, spark.createDataFrame([(4,)], "node long")).collect()} == {1, 2, 3}
    with pytest.raises(graph.CycleError):
        graph.topological_levels(spark.createDataFrame([(1, 2), (2, 3), (3, 2)], "src long, dst long")).collect()
    assert {r.new_node for r in graph.renumbered(graph.topological_levels(edges)).collect()} == set(range(5))


def test_redo_of_a_build(spark):
    needs = [("link", "compile"), ("link", "fetch"), ("pack", "link"), ("notes", "fetch"), ("ship", "pack"), ("ship", "notes")]
    edges = redo.shape_edges(spark.createDataFrame(needs, "step_id string, needs string"))
    events = spark.createDataFrame([("r", i, "STEP_FINISHED", s, None, None, "x", i) for i, s in enumerate(("fetch", "compile", "notes", "link"))] + [("r", 9, "STEP_FAILED", "pack", None, None, "e", 9)], E)
    assert sorted(r.step_id for r in redo.reseed_plan(events, edges).collect()) == ["pack", "ship"]
    seeds = spark.createDataFrame([("r", "notes")], "run_id string, step_id string")
    assert sorted(r.step_id for r in redo.reseed_plan(events, edges, seeds=seeds).collect()) == ["notes", "ship"]
    named = edges.withColumn("workflow_id", F.lit("w")).union(spark.createDataFrame([("fetch", "other", "v")], "src string, dst string, workflow_id string"))
    runs = spark.createDataFrame([("r", "w"), ("q", "v")], "run_id string, workflow_id string")
    got = sorted((r.run_id, r.step_id) for r in redo.reseed_plan(events, named, runs).collect())
    assert got == [("q", "fetch"), ("q", "other"), ("r", "pack"), ("r", "ship")]
    for bad in (lambda: redo.invalidation_set(edges, spark.createDataFrame([("nope",)], "node string")), lambda: redo.reseed_plan(events, edges, seeds=spark.createDataFrame([("nope",)], "step_id string"))):
        with pytest.raises(ValueError):
            bad()


def test_graphs_with_isolated_nodes_and_depth(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(25)], "src long, dst long")
    alone = spark.createDataFrame([(100,), (3,)], "node long")
    levels = {r.node: r.level for r in graph.topological_levels(edges, alone).collect()}
    assert levels == {i: i for i in range(26)} | {100: 0}
    assert {(r.node, r.out_degree, r.in_degree) for r in graph.degrees(edges, alone).where("node in (100, 3)").collect()} == {(100, 0, 0), (3, 1, 1)}
    assert graph.nodes_of(edges, alone).count() == 27
    assert {r.node for r in graph.reachable(edges, alone).collect()} == {100, *range(3, 26)}
    numbers = {r.node: r.new_node for r in graph.renumbered(graph.topological_levels(edges, alone), block=4).collect()}
    assert numbers == {n: i for i, (_, n) in enumerate(sorted((v, k) for k, v in levels.items()))}
    assert graph.topological_levels(edges.limit(0)).count() == 0 and graph.reachable(edges, alone.limit(0)).count() == 0


def test_levels_read_edges_in_few_tasks(spark):
    edges = spark.createDataFrame([(n // k, n) for n in range(2, 40) for k in (2, 3) if n >= k], "src long, dst long")
    seeds, track = spark.createDataFrame([(5,)], "node long"), spark.sparkContext.statusTracker()
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        for name, run in (("levels", lambda: graph.topological_levels(edges.distinct())), ("reached", lambda: graph.reachable(edges.distinct(), seeds))):
            spark.sparkContext.setJobGroup(name, name)
            run()
            stages = {s for j in track.getJobIdsForGroup(name) for s in track.getJobInfo(j).stageIds}
            widest = [i.numTasks for s in stages if (i := track.getStageInfo(s)) and i.numCompletedTasks]
            assert widest and max(widest) < 100, (name, sorted(widest))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.sparkContext._jsc.clearJobGroup()


def _runs(spark, *rows):
    names = "run_id string, workflow_id string, workflow_version string, status string, wait_name string, wake_at long, lease_owner string, lease_expires_at long, created_at long, updated_at long"
    return spark.createDataFrame([(r, "w", None, s, n, w, o, x, 0, u) for r, s, n, w, o, x, u in rows], names)


def test_leases_over_explicit_time(spark):
    def verdict(owner, now, lease):
        held = [("a", "running", None, None, *lease, 1)]
        return tuple(transitions.claim_verdicts(_runs(spark, *held), spark.createDataFrame([("a",)], "run_id string"), owner, now, 100).first())[1:]

    assert verdict("a", 10, (None, None)) == ("claimed", 110)
    assert verdict("b", 20, ("a", 110)) == ("not_claimable", None)
    assert verdict("b", 110, ("a", 110)) == ("claimed", 210) and verdict("a", 20, ("a", 110)) == ("claimed", 120)
    stale = _runs(spark, ("a", "running", None, None, "x", 100, 1))
    assert transitions.claim_stale(stale, "b", 99).count() == 0
    assert transitions.claim_stale(stale, "b", 101, lease_ms=100).first().new_expires_at == 201
    with pytest.raises(ValueError):
        transitions.claim_verdicts(stale, stale, "a", 0, 0)


def test_timers_and_buckets(spark):
    t = "run_id string, signal_id string, wake_at long, lease_owner string, lease_expires_at long"
    for owner, now, lease, n in (("a", 99, (None, None), 0), ("a", 100, (None, None), 1), ("b", 110, ("a", 150), 0), ("b", 151, ("a", 150), 1)):
        due = transitions.due_timers(spark.createDataFrame([("r", "s", 100, *lease)], t), owner, now, lease_ms=50)
        assert [tuple(r) for r in due.collect()] == [("r", "s", 100, owner, now + 50)] * n
    due = spark.createDataFrame([("nightly", "sweep", 720_000)], "schedule_id string, workflow_id string, fire_at long")
    row = transitions.due_buckets(due, None, "a", 720_000).first()
    assert (row.bucket_id, row.run_id) == ("720000", "sweep:nightly:720000")
    taken = spark.createDataFrame([("nightly", "720000", "x", "open", "a", 720_300)], "schedule_id string, bucket_id string, run_id string, status string, lease_owner string, lease_expires_at long")
    assert transitions.due_buckets(due, taken, "b", 720_050).count() == 0 and transitions.due_buckets(due, taken, "b", 720_300).count() == 1
    started = transitions.start_buckets(taken, due.select("schedule_id", F.lit("720000").alias("bucket_id"), F.lit("y").alias("run_id")))
    assert transitions.due_buckets(due, started, "a", 750_000).count() == 0


def test_delivery_precedence(spark):
    runs = _runs(spark, ("p", "paused", "sig", None, None, None, 1), ("f", "finished", None, None, None, None, 1))
    rows = [("p", "2", "sig", 0, True), ("p", "3", "other", 1, False), ("p", "1", "sig", 2, False), ("gone", "4", "sig", 0, True), ("f", "5", "sig", 0, False), ("p", "6", "sig", 3, False), ("p", "1", "sig", 4, False), ("p", "3", "other", 5, False)]
    got = {(r.signal_id, r.arrival): r.verdict for r in transitions.deliver_signals(runs, spark.createDataFrame(rows, "run_id string, signal_id string, name string, arrival long, already_delivered boolean")).collect()}
    assert got == {("2", 0): "duplicate", ("3", 1): "not_waiting", ("1", 2): "delivered", ("4", 0): "not_found", ("5", 0): "not_waiting", ("6", 3): "not_waiting", ("1", 4): "duplicate", ("3", 5): "not_waiting"}


def one_by_one(runs, rows, boxed):
    """Deliveries and buffering in a loop over one state."""
    state = {r[0]: [r[1], r[2]] for r in runs}
    taken, inbox = {(r[0], r[1]) for r in rows if r[4]}, set(boxed)
    before, out, out_box = set(taken), {}, {}
    for run, key, name, at, _ in sorted(rows, key=lambda r: r[3]):
        if run not in state:
            out[run, at] = out_box[run, at] = "not_found"
            continue
        status, wait = state[run]
        if (run, key) in taken:
            out[run, at] = "duplicate"
        elif status == "paused" and wait == name:
            out[run, at] = "delivered"
            taken.add((run, key))
            state[run] = ["queued", None]
        else:
            out[run, at] = "not_waiting"
    for run, key, name, at, _ in sorted(rows, key=lambda r: r[3]):
        status = next((r[1] for r in runs if r[0] == run), None)
        if status is None:
            continue
        if (run, key) in before or (run, key) in inbox:
            out_box[run, at] = "duplicate"
        elif status == "finished" or name == "__timer":
            out_box[run, at] = "not_waiting"
        else:
            out_box[run, at] = "buffered"
            inbox.add((run, key))
    return out, out_box


def test_batches_are_judged_one_by_one(spark):
    import random

    rng = random.Random(4)
    runs = [(f"r{i}", rng.choice(["paused", "paused", "queued", "finished"]), rng.choice(["a", "b"])) for i in range(80)]
    delivered = {(f"r{i}", "k0") for i in range(0, 90, 4)}
    rows = []
    for i in range(90):
        for at in rng.sample(range(100), rng.randint(1, 9)):
            key = f"k{rng.randrange(4)}"
            rows.append((f"r{i}", key, rng.choice(["a", "b", "__timer"]), at, (f"r{i}", key) in delivered))
    boxed = {(f"r{i}", "k1") for i in range(0, 90, 3)}
    want, want_box = one_by_one(runs, rows, boxed)
    table = _runs(spark, *[(r, s, w, None, None, None, 1) for r, s, w in runs])
    arrivals = spark.createDataFrame(rows, "run_id string, signal_id string, name string, arrival long, already_delivered boolean")
    got = transitions.deliver_signals(table, arrivals)
    assert {(r.run_id, r.arrival): r.verdict for r in got.collect()} == want
    inbox = spark.createDataFrame(sorted(boxed), "run_id string, signal_id string")
    assert {(r.run_id, r.arrival): r.verdict for r in transitions.buffer_signals(table, arrivals, inbox).collect()} == want_box
    asked = arrivals.withColumnRenamed("name", "approval_id").drop("signal_id").withColumn("already_delivered", F.lit(False))
    by_name, _ = one_by_one(runs, [(r, n, n, at, False) for r, _, n, at, _ in rows], ())
    assert {(r.run_id, r.arrival): r.verdict for r in transitions.deliver_approvals(table, asked).collect()} == by_name


@pytest.mark.parametrize("bad", ["* * * *", "* * * * * *", "60 * * * *", "* * * * 8", "5-1 * * * *", "*/0 * * * *", "a * * * *"])
def test_cron_rejects(bad):
    with pytest.raises(ValueError):
        schedule.parse_cron(bad)


def brute_fire(expression, now, back):
    """Minute by minute, by the parsed fields."""
    import datetime as dt

    c = schedule.parse_cron(expression)
    top = now - now % 60_000
    for ms in range(top, top - back - 1, -60_000):
        t = dt.datetime.fromtimestamp(ms / 1000, dt.UTC)
        day, weekday = t.day in c["day"].values, t.isoweekday() % 7 in c["weekday"].values
        hit = day or weekday if not c["day"].any and not c["weekday"].any else day and weekday
        if t.minute in c["minute"].values and t.hour in c["hour"].values and t.month in c["month"].values and hit:
            return ms
    return None


def test_cron_and_intervals(spark):
    import random

    assert schedule.parse_cron("*/15 9-11 1,3 * 7")["minute"] == schedule.Field((0, 15, 30, 45), False)
    assert schedule.parse_cron("* * * * 0-7")["weekday"].values == tuple(range(7)) and schedule.parse_cron("7/5 * * * *")["minute"].values == (7,)
    rng = random.Random(3)

    def text(low, high):
        a, b = sorted(rng.sample(range(low, high + 1), 2))
        return rng.choice(["*", "*", "*", f"*/{rng.randint(2, 9)}", f"{a}", f"{a}-{b}", f"{a}-{b}/{rng.randint(1, 5)},{b}", f"{a}/3", f"{a},{b}"])

    expressions = [" ".join(text(low, high) for _, low, high in schedule.FIELDS) for _ in range(60)] + ["22 14 * * *", "23 14 * * *", "22 14 9 10 *", "0 0 1 * *", "5 4 31 2 *", "* * * * 4", " 0  0 * * 7 "]
    bad = ["60 * * * *", "* * * *", "a * * * *", "*/0 * * * *", "5-1 * * * *", "1, * * * *", "", None, "* * * * * *", "99999999999 * * * *", "-1 * * * *"]
    df = spark.createDataFrame([(e,) for e in expressions + bad], "e string").withColumn("c", schedule.cron_fields(F.col("e")))
    for now, back in ((THURSDAY, schedule.LOOKBACK_MS), (THURSDAY - THURSDAY % 86_400_000, 36 * 3_600_000), (THURSDAY, 0), (1_709_251_199_999, 3 * 86_400_000 + 60_000)):
        got = {r.e: r.f for r in df.select("e", schedule.previous_cron_fire(F.lit(now), F.col("c"), back).alias("f")).collect()}
        assert got == {e: brute_fire(e, now, back) for e in expressions} | dict.fromkeys(bad), (now, back)
    parsed = {r.e: r.c for r in df.collect()}
    assert all(parsed[e] is None for e in bad)
    for e in expressions:
        c = schedule.parse_cron(e)
        assert all(sorted(parsed[e][n]) == list(c[n].values) for n in c) and (parsed[e].any_day, parsed[e].any_weekday) == (c["day"].any, c["weekday"].any)
    with pytest.raises(ValueError):
        schedule.previous_cron_fire(F.lit(0), F.col("c"), -1)
    every = spark.range(1).select(schedule.interval_fire(F.lit(THURSDAY), F.lit(420_000)).alias("a"), schedule.interval_fire(F.lit(-1), F.lit(1000)).alias("b")).first()
    assert tuple(every) == (THURSDAY - THURSDAY % 420_000, -1000)
    assert schedule.every(3) == 180_000 and schedule.every(2, "hours") == 7_200_000
    with pytest.raises(ValueError):
        schedule.every(0)


def test_expressions_are_read_once_a_row(spark):
    text = str(schedule.cron_fields(F.col("e")))
    assert text.count("regexp_extract") == 4 * len(schedule.FIELDS) and text.count("split") == 1 + len(schedule.FIELDS), text


def test_days_are_tried_without_reading_the_fields_again(spark):
    tried = str(schedule.previous_cron_fire(F.lit(THURSDAY), F.col("c"))).partition("sequence(0")[2]
    assert tried and "array_max" not in tried and "filter" not in tried, tried


def test_an_expression_as_text(spark):
    texts = ["*/20 8-18/2 * * 1-5,0", "5 0 1,15 * *", "* * * * 7", "61 * * * *", "* *", "1/0 * * * *", "-1 * * * *", "* * * * */"]
    df = spark.createDataFrame([(e,) for e in texts], "e string").withColumn("c", schedule.cron_fields(F.col("e")))
    in_order = lambda c: c and {k: sorted(v) if isinstance(v, list) else v for k, v in c.asDict().items()}
    assert {e: in_order(spark.range(1).select(schedule.cron_fields(e).alias("c")).first().c) for e in texts} == {r.e: in_order(r.c) for r in df.collect()}
    hits = df.select("e", schedule.cron_matches(F.lit(THURSDAY), F.col("c")).alias("h")).collect()
    assert {r.e: r.h for r in hits} == {e: spark.range(1).select(schedule.cron_matches(F.lit(THURSDAY), schedule.cron_fields(e)).alias("h")).first().h for e in texts}


def test_payloads(spark):
    shape = {"n": ("integer", True), "x": ("number", True), "s": ("string", False), "a": ("array", False), "o": ("object", False), "b": ("boolean", False)}
    rows = {
        '{"n":1,"x":1.5,"s":"q","a":[],"o":{},"b":true,"more":0}': [], '{"n":1,"x":2,"s":null}': [], '{"n":1.5,"x":"2","b":0}': ["type:n", "type:x", "type:b"],
        "{}": ["missing:n", "missing:x"], '{"n":null,"x":1}': ["type:n"], "[1]": ["not_object"], "{": ["not_json"], '{"n":"1","x":1,"a":{},"o":[],"s":1}': ["type:n", "type:s", "type:a", "type:o"],
    }
    df = spark.createDataFrame([(t,) for t in rows] + [(None,)], "t string")
    assert {r.t: r.f for r in df.select("t", jsonfn.payload_faults(F.col("t"), shape).alias("f")).collect()} == rows | {None: ["not_json"]}


def test_json_diff_and_backoff(spark):
    pairs = [
        ('{"a":1,"b":{"c":2},"gone":3}', '{"a":1,"b":{"c":3},"new":4}', [("replace", "/b/c", "3"), ("remove", "/gone", None), ("add", "/new", "4")]),
        ("[1,2,3]", "[1,2]", [("replace", "", "[1, 2]")]), ("1", "2", [("replace", "", "2")]), ("[1,2]", "[1,3]", [("replace", "/1", "3")]),
        ('{"a":1}', '{"a":true}', [("replace", "/a", "true")]), (None, "null", []), ("{", "1", None), ('{"a":{}}', '{"a":[]}', [("replace", "/a", "[]")]),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.d and [tuple(o) for o in r.d] if r.d != [] else [] for r in df.select("i", jsonfn.diff_state("a", "b").alias("d")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(pairs)}
    delays = [r[0] for r in spark.range(1, 100).select(jsonfn.backoff_ms(F.col("id"), 3, 1000)).collect()]
    assert delays[:4] == [3, 6, 12, 24] and delays[-1] == 1000


def test_versions_and_status(spark):
    runs = spark.createDataFrame([("1", "w", None), ("2", "w", "v1"), ("3", "w", "v9")], "run_id string, workflow_id string, workflow_version string")
    versions = spark.createDataFrame([("w", "v1", False), ("w", "v2", True)], "workflow_id string, version string, is_current boolean")
    assert {r.run_id: r.routed_version for r in projections.select_version(runs, versions).collect()} == {"1": "v2", "2": "v1", "3": None}
    with pytest.raises(Exception, match="unknown status"):
        spark.createDataFrame([("odd",)], "s string").select(projections.checked_status(F.col("s"))).collect()


def test_logs_on_disk(spark, tmp_path):
    rows = [("r", 0, "STEP_STARTED", "s", None, None, None, 1), ("r", 1, "STEP_FINISHED", "s", None, None, "null", 2)]
    log.write_jsonl(spark.createDataFrame(rows, E), str(tmp_path / "log"))
    back = log.read_jsonl(spark, str(tmp_path / "log"))
    assert sorted(tuple(r) for r in back.collect()) == rows
    assert [r.event_index for r in log.read_events(back, "r", 1).collect()] == [1]


def test_stream_equals_batch_and_survives_restart(spark, tmp_path):
    rows = [(f"r{i % 5}", i // 5, ("STEP_STARTED", "SIGNAL_AWAITED", "STEP_FINISHED")[i % 3], f"s{i % 2}", "n", None, str(i), i) for i in range(60)]
    path, seen, failed = str(tmp_path / "log"), [], live.Failures()

    def keep(batch, number):
        seen.append({(r.run_id, r.step_id): tuple(r) for r in batch.collect()})

    def broken(batch, number):
        raise RuntimeError("down")

    for part in (rows[40:], rows[:20], rows[20:40]):  # files arrive out of order
        spark.createDataFrame(part, E).coalesce(1).write.mode("append").parquet(path)
        live.publish(live.step_states(live.tail(spark, path)), [broken, keep, keep], str(tmp_path / "checkpoint"), "complete", failed).awaitTermination()
    assert len(seen) == 3 and len(failed) == 3
    with pytest.raises(RuntimeError, match="a sink failed"):
        failed.raise_any()
    assert seen[-1] == {(r.run_id, r.step_id): tuple(r) for r in fold.fold_step_states(spark.createDataFrame(rows, E)).collect()}


def test_json_documents(spark, tmp_path):
    (tmp_path / "doc.json").write_text('{\n "run_id": "r",\n "status": "paused"\n}')
    assert [tuple(r) for r in log.read_json_document(spark, str(tmp_path / "doc.json"), "run_id string, status string").collect()] == [("r", "paused")]


def test_sweeping_timers(spark):
    t = "run_id string, signal_id string, wake_at long, lease_owner string, lease_expires_at long"
    rows = [("r", "s", 100, None, None)]
    sweep = live.sweep_timers(lambda: spark.createDataFrame(rows, t), "a")
    assert sweep(99).count() == 0 and sweep(100).count() == 1
    rows.append(("q", "s", 50, None, None))
    assert [r.run_id for r in sweep(100).collect()] == ["q", "r"]


def test_emitted_events_are_not_kept(spark):
    rows = spark.createDataFrame([("r", "note", "{}", 5)], "run_id string, name string, body string, ts long")
    shown = live.emitted(rows)
    assert shown.first().event_type == "CUSTOM" and projections.persisted(shown).count() == 0
    with pytest.raises(ValueError):
        live.emitted(rows, "STEP_FINISHED")


def test_state_deltas(spark):
    states = spark.createDataFrame([("r", 0, '{"a":1}'), ("r", 1, '{"a":1}'), ("r", 2, '{"a":2}')], "run_id string, event_index long, state string")
    got = live.state_deltas(states).collect()
    assert [(r.event_index, [tuple(o) for o in r.delta]) for r in got] == [(2, [("replace", "/a", "2")])]
