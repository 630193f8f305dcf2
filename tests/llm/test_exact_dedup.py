import hashlib
import re

from runledger.llm import exact_dedup as ed


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out = []
    for plain, own in groups.items():
        keep = min(own, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0]
        out += [(i, keep, len(own), i == keep, hashlib.sha256(plain.encode()).hexdigest()) for i, _ in own]
    return sorted(out, key=str)


ROWS = [(i, f"text {i % 40}" + " " * (i % 5)) for i in range(400)] + [(1000, None), (1001, ""), (1002, " \n\t\x0b\x0c\r"), (1003, " "), (1004, "x" * 100000), (1005, "x" * 50000 + " \n" + "x" * 50000), (None, "text 1      "), (None, "alone"), (5, "text 5"), (5, "other")]


def test_against_brute_force_with_and_without_collisions(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("key", ed.F.lit("clash")).withColumn("link", ed.F.lit(1))
    for capacity, bits in ((100_000, 64), (4, 64), (4, 3), (100, 1)):
        got = sorted((tuple(r) for r in ed.deduplicate(docs, capacity, bits).collect()), key=str)
        assert got == brute(ROWS), (capacity, bits)
    assert ed.deduplicate(docs.limit(0)).count() == 0


def stays(rows):
    """The one row of each group that stays."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i, t))
    return sorted(((min(g)[3], min(g)[4]) for g in ({r[:3]: r for r in g}.values() for g in groups.values())), key=str)


def test_keep_first_with_shared_and_null_ids(spark):
    # id 7 has a text of its own and one that another row wins; 8 is there twice
    more = [(7000, "A B"), (7000, "c"), (1, "text 9       x"), (8000, "twice"), (8000, "twice"), (None, "lone"), (None, "lone"), (None, " A  B  ")]
    for rows in (ROWS + more, [(i, f"t {i % 7}" + " " * (i % 3)) for i in range(40)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("d", ed.F.lit("clash")).withColumn("_id", ed.F.lit(1))
        kept = ed.keep_first(docs)
        assert kept.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == stays(rows)
    assert ed.keep_first(docs.limit(0)).count() == 0


def test_more_keys_than_are_broadcast(spark):
    rows = spark.range(3000).select((ed.F.col("id") * 7919 % 4001).alias("key"), ed.F.col("id").cast("string").alias("text"))
    for n in (1, 3, 500):
        keys = spark.range(n).select((ed.F.col("id") * 2).alias("key"))
        want = sorted(r.text for r in rows.join(keys, "key", "left_semi").collect())
        assert sorted(r.text for r in ed.shared.among(rows, "key", keys, most=0).collect()) == want
        assert sorted(r.text for r in ed.shared.among(rows, "key", keys).collect()) == want


def test_directory_splits_to_the_fixed_point(spark):
    keys = [(k * 0x9E3779B97F4A7C15 + 77) % 2**64 for k in range(3000)] + [(5 << 45) + k for k in range(90)]
    df = spark.createDataFrame([(k - 2**64 if k >= 2**63 else k,) for k in keys], "key long")
    capacity = 64
    counts, bits = ed.slot_counts(df, capacity)
    assert bits > 50  # the ninety share their top bits, so the directory doubles far beyond the others' depth
    got = {r.slot: (r.depth, r.bucket) for r in ed.directory(counts, bits, capacity).collect()}
    # split one bucket at a time
    buckets, whole = {}, [(0, 0, [k >> (64 - bits) for k in keys])]
    while whole:
        depth, start, slots = whole.pop()
        if len(slots) <= capacity or depth == bits:
            buckets |= {s: (depth, start) for s in slots}
            continue
        half = start + (1 << (bits - depth - 1))
        whole += [(depth + 1, start, [s for s in slots if s < half]), (depth + 1, half, [s for s in slots if s >= half])]
    assert got == buckets


def test_index_files_hold_key_ranges_and_chains(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    for key_bits in (64, 4):
        _, index = ed.build_index(docs, ed.shared.Workspace(spark, "index-test"), capacity=10, key_bits=key_bits)
        rows, spans = index.collect(), {}
        for r in rows:
            spans.setdefault((r.bucket, r.depth), {}).setdefault(r.key % 2**64, []).append(r.link)
        assert max(map(len, spans.values())) <= 10
        assert all(sorted(links) == list(range(len(links))) for keys in spans.values() for links in keys.values())
        assert key_bits == 4 or len(spans) > 3
        assert key_bits == 64 or max(len(links) for keys in spans.values() for links in keys.values()) > 1
        # ranges of buckets do not overlap
        ends = sorted((min(keys), max(keys)) for keys in spans.values())
        assert all(x[1] < y[0] for x, y in zip(ends, ends[1:]))


def test_owners_are_dealt_once_by_bucket(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    plans = []
    save = ed.shared.Workspace.save

    def seen(self, df, name, partition_by=None):
        if name == "index":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(self, df, name, partition_by)

    ed.shared.Workspace.save = seen
    try:
        ed.build_index(docs, ed.shared.Workspace(spark, "index-plan"), capacity=10)
    finally:
        ed.shared.Workspace.save = save
    (plan,) = plans
    assert plan.count("REPARTITION_BY_NUM") == 1
    # above the deal there are aggregates, sorts and the chain's window, and no further exchange
    assert "Exchange hash" not in plan[: plan.index("REPARTITION_BY_NUM")].rpartition("Exchange hash")[0]
