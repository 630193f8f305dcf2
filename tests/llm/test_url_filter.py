import math

import numpy as np
from runledger.llm import url_filter as uf

URLS = [
    (0, "http://A.Example.ORG/es/1?x#y"), (1, "https://org/x"), (2, "http://example.org/en/12"), (3, "http://example.org/en/2"), (4, "http://org"), (5, "x.COM/fr/1"),
    (6, "http://myexample.org/es/1"), (7, "http://a.com/fr/"), (8, "http://a.com/de/"), (9, "http://a.net?q=/fr/"), (10, None), (11, ""), (12, "://#"), (13, "ftp://É.Com/de/a://b"), (14, "http://a.co.uk/x"), (None, "http://z.net/"), (7, "http://a.com/fr/"),
]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string").withColumn("host", uf.F.lit("clash"))
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.judge(pages, none).collect()}
    assert uf.judge(pages, none).count() == len(URLS)
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1] == ("org", "/x", "org/", "allow")
    assert got[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[3] == ("example.org", "/en/2", "org/", "allow")
    assert got[4] == ("org", "", None, "allow")
    assert got[5] == got[10] == got[11] == ("", "", None, "allow")
    assert got[6] == ("myexample.org", "/es/1", "org/", "allow")
    assert got[7][2:] == ("com/fr/", "allow") and got[8][2:] == ("com/de/", "block")
    assert got[9] == ("a.net", "", None, "allow") and got[12] == ("", "", None, "allow")
    assert got[13] == ("É.com", "/de/a://b", "com/de/", "block")
    assert uf.judge(pages.limit(0), none).count() == 0


def test_domains(spark):
    want = {
        "a.b.example.com": ("example.com", "com"), "example.com": ("example.com", "com"), "com": ("com", "com"), "": ("", ""), "x.y.co.uk": ("y.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"),
        "y.co.uk": ("y.co.uk", "co.uk"), "me:pw@a.b.com:80": ("b.com", "com"), "a.b.com.": ("b.com", "com"), "10.0.0.7:80": ("10.0.0.7", ""), "..": ("", ""), "a..com": (".com", "com"),
    }
    named = uf.with_domains(spark.createDataFrame([(h,) for h in want], "host string"))
    assert {r.host: (r.domain, r.suffix) for r in named.collect()} == want
    deep = uf.with_domains(spark.createDataFrame([("x.y.a.b.c.d",)], "host string"), ("b.c.d",)).first()
    assert (deep.domain, deep.suffix) == ("a.b.c.d", "b.c.d")


def brute(hosts):
    """Posterior rates straight from the definition, in Python. hosts: {host: (domain, suffix, bad, n)}"""

    def strength(groups):
        rows = [(b, n, p) for b, n, p in groups if n]
        room = sum((n - 1) * p * (1 - p) for _, n, p in rows)
        spread = sum((b - n * p) ** 2 / n - p * (1 - p) for b, n, p in rows) / room if room else 0.001
        return 1 / min(max(spread, 0.001), 0.5) - 1

    def total(key):
        out = {}
        for v in hosts.values():
            b, n = out.get(key(v), (0, 0))
            out[key(v)] = b + v[2], n + v[3]
        return out

    def level(sums, prior):
        k = strength([(*sums[g], prior[g]) for g in sums])
        return {g: (b + k * prior[g]) / (n + k) for g, (b, n) in sums.items()}, k

    bad, n = sum(v[2] for v in hosts.values()), sum(v[3] for v in hosts.values())
    suffixes = total(lambda v: v[1])
    s, _ = level(suffixes, dict.fromkeys(suffixes, (bad + 0.5) / (n + 1)))
    domains = total(lambda v: v[0])
    d, _ = level(domains, {v[0]: s[v[1]] for v in hosts.values()})
    h, k = level({x: v[2:] for x, v in hosts.items()}, {x: d[v[0]] for x, v in hosts.items()})
    return {x: (r, hosts[x][3] + k) for x, r in h.items()}


def below(rate, weight, limit, steps=1_000_000):
    """P(rate <= limit) by adding up the density over log odds."""
    a, b = rate * weight, (1 - rate) * weight
    top = math.log(limit / (1 - limit))
    width = max(60, 60 / a)
    z = top - width * (np.arange(steps) + 0.5) / steps
    log_norm = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return float(np.exp(-a * np.logaddexp(0, -z) - b * np.logaddexp(0, z) + log_norm).sum() * width / steps)


def test_beta_cdf(spark):
    points = [(0.3, 4.0), (2.0, 2.0), (30.0, 70.0), (26.0, 74.0), (0.02, 0.98), (800.0, 3000.0), (5.5, 0.5), (400.0, 1000.0)]
    df = spark.createDataFrame(points, "a double, b double")
    for r in df.select("a", "b", uf.beta_cdf(df.a, df.b, 0.25).alias("p"), uf.beta_cdf(df.a, df.b, 0.7).alias("q")).collect():
        for got, x in ((r.p, 0.25), (r.q, 0.7)):
            assert abs(got - below(r.a / (r.a + r.b), r.a + r.b, x)) < 1e-6, (r, x)
    big = spark.createDataFrame([(2.5e5, 7.5e5), (2.51e5, 7.49e5)], "a double, b double")
    near = [r[0] for r in big.select(uf.beta_cdf(big.a, big.b, 0.25)).collect()]
    assert abs(near[0] - 0.5) < 1e-3 and abs(near[1] - 0.5 * math.erfc(0.001 / math.sqrt(2 * 0.251 * 0.749 / 1e6))) < 1e-3


def test_reputation_and_block(spark):
    counts = {"a.x.com": (9, 10), "b.x.com": (30, 40), "a.y.com": (1, 50), "y.com": (0, 3), "q.net": (0, 0), "r.net": (2, 5)}
    hosts = {h: (".".join(h.split(".")[-2:]), h.split(".")[-1], *c) for h, c in counts.items()}
    df = spark.createDataFrame([(h, *c) for h, c in counts.items()], "host string, bad long, n long")
    got = {r.host: (r.rate, r.weight) for r in uf.reputation(df).collect()}
    want = brute(hosts)
    assert all(abs(x - y) < 1e-9 for h in want for x, y in zip(got[h], want[h], strict=True))
    pages, bad, i = [], [], 0
    for h, (b, n) in counts.items():
        for j in range(max(n, 1)):
            pages.append((i, f"http://{h}/p"))
            if n:
                bad.append((i, int(j < b)))
            i += 1
    judged = uf.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(bad + bad[:3], "page_id long, bad int"))
    verdicts = {r.host: r.verdict for r in judged.collect()}
    assert verdicts == {h: "block" if below(*want[h], uf.LIMIT) < uf.RISK else "allow" for h in counts}
    assert verdicts["b.x.com"] == "block" and verdicts["a.y.com"] == "allow"


def test_hosts_without_labels_follow_their_domain(spark):
    """Only labels of other hosts of its domain speak about new.bad.com and new.good.com; very long urls and hosts are read whole."""
    long_host = ".".join(["x" * 60] * 2000) + ".bad.com"
    pages, bad, i = [], [], 0
    for domain, share in (("bad.com", 95), ("good.com", 2), *((f"d{j}.com", 5 + j % 7) for j in range(30))):
        for h in range(4):
            for j in range(100):
                pages.append((i, f"https://h{h}.{domain}:8080/p{j}?q"))
                bad.append((i, int(j < share)))
                i += 1
    asked = {"new.bad.com": "block", "new.good.com": "allow", "user@new.bad.com.:99": "block", long_host: "block", "unheard.of": "allow"}
    pages += [(i + n, f"https://{h}/{'y' * 500_000}") for n, h in enumerate(asked)]
    got = {r.host: r.verdict for r in uf.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad int")).collect()}
    assert {h: got[h] for h in asked} == asked
    assert got["h1.bad.com:8080"] == "block" and got["h1.good.com:8080"] == "allow"
