import itertools
import random

from runledger.llm import near_dedup as nd
from runledger.llm import queries


def shingles(text, k):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())


def brute(rows, k, threshold=80):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for n, (_, s) in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(n)
    seen = {p for ns in where.values() for p in itertools.combinations(ns, 2)}
    for m, n in seen:
        (i, x), (j, y) = sets[m], sets[n]
        if 100 * len(x & y) >= threshold * len(x | y):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return {i: (len(s), root(i), root(i) == i) for i, s in sets}


def test_whole_table_against_brute_force(spark):
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        got = {r[0]: tuple(r)[1:4] for r in queries.queries()["op1_minhash_near_dedup"](spark, folder).collect()}
        rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
        want = brute(rows, 4)
        assert {i: v for i, v in got.items() if v != want[i]} == {} and len(got) == len(want)


def test_chains_groups_and_edges(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocab) for _ in range(120)]
    rows, i = [], 0
    for step in range(40):  # a chain: neighbours are alike, ends are not
        base[3 * step] = f"new{step}"
        rows.append((i, " ".join(base)))
        i += 1
    for _ in range(60):  # near copies of one text, and copies
        t = rows[5][1].split()
        t[rng.randrange(120)] = f"x{i}"
        rows += [(i, " ".join(t)), (i + 1, " ".join(t).upper())]
        i += 2
    rows += [(1000, "one two"), (1001, "ONE  two"), (1002, "one two three"), (1003, ""), (1004, " \n"), (1005, None), (1006, "a " * 30000), (1007, "a " * 20000 + "\x1fb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", nd.F.lit(7)).withColumn("key", nd.F.lit("k"))
    for k in (4, 5):
        got = {r[0]: tuple(r)[1:] for r in nd.near_duplicates(docs, k).collect()}
        assert got == brute(rows, k)
    kept = nd.keep_one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, v in brute(rows, 5).items() if v[2]}
    assert nd.near_duplicates(docs.limit(0)).count() == 0


def test_many_copies_around_the_threshold(spark):
    """Edits of one base, some linked, many apart, with families that share a passage; the leader is an edit itself."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(150)]
    passage = [f"p{i}" for i in range(20)]
    rows = []
    for i in range(250):
        t = list(base)
        for _ in range(rng.choice([2, 4, 6, 8, 10])):
            t[rng.randrange(150)] = f"e{rng.randrange(10**6) if rng.random() < 0.7 else rng.randrange(30)}"
        if i % 3 == 0:
            at = rng.randrange(130)
            t[at : at + rng.choice([5, 20])] = passage
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in nd.near_duplicates(docs, 4).collect()}
    assert got == brute(rows, 4)


def test_repeats_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u"), (2, "x")], "doc_id long, text string")
    got = sorted((tuple(r) for r in nd.near_duplicates(docs, 4).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (None, 3, 1, False), (None, 2, None, True), (2, 1, 2, True)], key=str)


def test_keep_one_with_shared_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other text of one"), (2, "A b c d e f"), (None, "q r s"), (None, "q r s"), (None, "z"), (3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_id", nd.F.lit(0)).withColumn("d", nd.F.lit(0))
    kept = nd.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([rows[0], rows[2], rows[4], rows[6], rows[7]], key=str)


def test_hot_leaders_keys_and_shingles_are_split(spark, monkeypatch):
    """With a low mark of what is hot, broadcasts, salts and bitmaps take over; the result is the same."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(160):
        t = list(base)
        for _ in range(rng.choice([2, 5, 8])):
            t[rng.randrange(120)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(nd.shared, "HOT", 4)
    monkeypatch.setattr(nd.shared, "BROADCAST_KEYS", 60)
    assert {r[0]: tuple(r)[1:] for r in nd.near_duplicates(docs, 4).collect()} == brute(rows, 4)


def test_pruning_bounds_follow_the_posterior():
    for m, k in nd.least_matches(0.8):
        grid = [(j + 0.5) / 20000 for j in range(20000)]

        def above(matches):
            like = [s**matches * (1 - s) ** (m - matches) for s in grid]
            return sum(v for s, v in zip(grid, like, strict=True) if s >= 0.8) / sum(like)

        assert above(k) >= nd.MISS and (k == 0 or above(k - 1) < nd.MISS)
