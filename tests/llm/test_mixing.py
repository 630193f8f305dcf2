import hashlib
import re

from runledger.llm import mixing


def brute_plan(rows):
    """{doc_id: (size, source_size, target, taken)} straight from the contract: shares, then excess reshared until none is left."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, _, t in rows}
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    total = {s: sum(size[i] for i, x, _ in rows if x == s) for s in sources}
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(sources)}
    target, free, left = {}, set(sources), 1.5 * sum(total.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        free -= over
    out = {}
    for s in sources:
        own = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i, x, _ in rows if x == s)
        end, at = int(target[s] + 0.5), 0
        for _, i in own:
            taken = sum(max(0, min(size[i], end - at - total[s] * p)) for p in range(2))
            out[i] = (size[i], total[s], target[s], taken)
            at += size[i]
    return out


def test_plan_against_brute_force(spark):
    rows = [(i, f"s{i % 7}" if i % 11 else None, "w " * (i * 37 % 101)) for i in range(300)]
    rows += [(1000 + i, "hot", "x y\tz\n" * (i % 50)) for i in range(400)]
    rows += [(2000, "none", None), (2001, "none", " \n"), (2002, "S", "a" * 50000), (2003, "", "b c")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("k", mixing.F.lit("clash")).withColumn("size", mixing.F.lit(1))
    got = {r.doc_id: r for r in mixing.plan(docs).collect()}
    want = brute_plan(rows)
    assert got.keys() == want.keys()
    for i, (size, source_size, target, taken) in want.items():
        r = got[i]
        assert (r.size, r.source_size, r.taken) == (size, source_size, taken) and abs(r.target - target) <= 1e-9 * max(1, target)
    assert sum(r.taken for r in got.values()) == round(1.5 * sum(r.size for r in got.values())) or abs(sum(r.taken for r in got.values()) - 1.5 * sum(r.size for r in got.values())) <= 10
    # cumulative demand: positions invert the integral of the source's rate
    tilts = {s: mixing.TILTS[n % 3] / 100 for n, s in enumerate(sorted({r[1] for r in rows}, key=lambda s: (s is None, s or "")))}
    offset = {}
    for _, s, i in sorted((hashlib.md5(str(i).encode()).hexdigest(), s, i) for i, s, _ in rows):
        at = offset.get(s, 0)
        offset[s] = at + want[i][0]
        if (p := got[i].position) is not None:
            u = p / 1e6
            k = tilts[s]
            assert abs((k * u * u + (1 - k) * u) * want[i][2] - at) <= 1e-6 * 3 * want[i][2] + 1e-6


def test_mixed_rows_and_edges(spark):
    rows = [(1, "a", "x y"), (1, "a", "x y"), (None, "a", "z"), (2, None, None), (3, "b", "q " * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("_pass", mixing.F.lit(9))
    planned = mixing.plan(docs)
    assert planned.count() == len(rows) and planned.where("taken > 2 * size").count() == 0
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} <= {1, None, 3}
    assert sorted(map(str, planned.collect())) == sorted(map(str, mixing.plan(docs).collect()))
    assert mixing.plan(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, "a", None), (2, "b", "")], "doc_id long, source string, text string")
    assert [(r.target, r.taken) for r in mixing.plan(empty).collect()] == [(0.0, 0)] * 2
    assert mixing.range_sorted(planned).count() == len(rows)


def test_mixed_order_against_brute_merge(spark):
    """Every pass enters at its own position: the mix is a merge of all passes of all sources."""
    rows = [(i, f"s{i % 5}", "w " * (1 + i * 37 % 101)) for i in range(400)]
    plan = brute_plan(rows)
    source, entries, offset = {i: s for i, s, _ in rows}, [], {}
    for _, i in sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i in source):
        size, total, target, _ = plan[i]
        k, at = mixing.TILTS[int(source[i][1:]) % 3] / 100, offset.get(source[i], 0)
        for done in range(mixing.REPEATS):
            if at + done * total < int(target + 0.5):
                y = (at + done * total) / target
                u = y if not k else (((1 - k) * (1 - k) + 4 * k * y) ** 0.5 - (1 - k)) / (2 * k)
                entries.append((int(u * 1_000_000), i, done))
        offset[source[i]] = at + size
    assert {done for _, _, done in entries} == {0, 1}
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert [r.doc_id for r in mixing.mixed(docs).collect()] == [i for _, i, _ in sorted(entries)]
    got = {r.doc_id: r.positions for r in mixing.plan(docs).collect()}
    assert all(got[i][done] == at for at, i, done in entries)
    assert sum(p is not None for ps in got.values() for p in ps) == len(entries)


def test_shares_follow_the_curriculum_over_time(spark):
    """In each tenth of training time, each source has the words that its integrated rate demands; three passes as well."""
    rows = [(i, f"s{i % 3}", "w " * (1 + i * 37 % 41)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for repeats in (2, 3):
        got = mixing.plan(docs, repeats).collect()
        assert {len(r.positions) for r in got} == {repeats}
        target = {r.source: r.target for r in got}
        words = {}
        for r in got:
            for p in r.positions:
                if p is not None:
                    words[r.source, min(9, p // 100_000)] = words.get((r.source, min(9, p // 100_000)), 0) + r.size
        for n, source in enumerate(sorted(target)):
            k = mixing.TILTS[n] / 100
            for tenth in range(10):
                u, v = tenth / 10, (tenth + 1) / 10
                due = target[source] * (k * (v * v - u * u) + (1 - k) * (v - u))
                assert abs(words.get((source, tenth), 0) - due) <= 90, (source, tenth)
    out = mixing.mixed(docs, 3)
    assert out.count() == sum(p is not None for r in mixing.plan(docs, 3).collect() for p in r.positions)
