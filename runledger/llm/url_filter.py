"""URL filtering by rules and, where none fits, by empirical-Bayes reputation of hosts; SQL functions only.

Labelled page outcomes (bad or not) are counted per host. The rate of a suffix is shrunk towards the rate of
all, that of a registered domain towards its suffix's, and that of a host towards its domain's, each through
a beta prior whose strength is fitted to the spread between the groups of that level (beta-binomial moments).
A host is blocked when its posterior leaves a rate of LIMIT or less a probability below RISK. A host without labelled
pages has its domain's rate and the prior's weight, so it can be blocked too.

The posterior probability is the regularized incomplete beta function, by its continued fraction; the terms it takes
grow with the square root of a host's outcomes.

Registered domains are cut from the host without user name, port and trailing dots, after the longest suffix
known; suffixes are a parameter, and an unknown one is the last label. A host of digits and dots is its own domain.

Defined results: a null url or one without `://` has an empty host and path, which is a host like any other;
an outcome is bad if any row of that page says so; pages without outcome count nowhere but get verdicts;
without any outcome every host is allowed; repeated rows each get a verdict; only page_id and url are read;
urls and hosts have any length.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: A host is blocked when the probability that its bad rate is at most LIMIT is below RISK.
LIMIT, RISK = 0.25, 0.05
#: Overdispersion is held between these, so prior strengths lie between 1 and 999 outcomes.
LEAST_SPREAD, MOST_SPREAD = 0.001, 0.5
#: Suffixes of several labels under which domains are registered; pass a fuller list where it matters.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
#: Rows of suffixes or hosts (some 50 bytes each) that are broadcast; more are joined by shuffles.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def with_domains(hosts: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """hosts (host) with suffix, the longest known one, else the last label, and domain, the suffix and the label
    before it, else the whole host. A host of digits and dots is its own domain under an empty suffix."""
    bare = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r"\.*(:[0-9]*)?$", "")
    rows = hosts.withColumn("_bare", bare).withColumn("_labels", F.split("_bare", r"\."))

    def tail(n: int | Column) -> Column:
        n = F.lit(n) if isinstance(n, int) else n
        return F.array_join(F.slice("_labels", -n, n), ".")

    n_suffix = F.lit(1)
    for n in sorted({s.count(".") + 1 for s in suffixes}):
        known = (F.size("_labels") >= n) & tail(n).isin(*[s for s in suffixes if s.count(".") + 1 == n])
        n_suffix = F.when(known, n).otherwise(n_suffix)
    numeric = F.col("_bare").rlike(r"^[0-9.]+$")
    rows = rows.withColumn("_n", n_suffix)
    rows = rows.withColumn("suffix", F.when(numeric, "").otherwise(tail(F.col("_n"))))
    domain = F.when(numeric | (F.size("_labels") <= F.col("_n")), F.col("_bare")).otherwise(tail(F.col("_n") + 1))
    return rows.withColumn("domain", domain).drop("_bare", "_labels", "_n")


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of the longest rule that fits and its verdict, or null."""
    found = F.lit(None).cast("struct<rule string, verdict string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _strength(groups: DataFrame) -> float:
    """The prior strength fitted to groups (bad, n, prior): 1 / overdispersion - 1."""
    binomial = F.col("prior") * (1 - F.col("prior"))
    deviation = F.col("bad") - F.col("n") * F.col("prior")
    seen = groups.where("n > 0")
    excess, room = seen.agg(F.sum(deviation * deviation / F.col("n") - binomial), F.sum((F.col("n") - 1) * binomial)).first()
    spread = excess / room if room else LEAST_SPREAD
    return 1 / min(max(spread, LEAST_SPREAD), MOST_SPREAD) - 1


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, and down again."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - 1 / (1680 * z * z * z * z * z * z * z)
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def _beta_tail(a: Column, b: Column, x: Column) -> Column:
    """The incomplete beta function up to x <= (a + 1) / (a + b + 2), as a continued fraction from its last term."""
    terms = (F.sqrt(F.greatest(a, b)) * 4).cast("int") + 40

    def step(below: Column, m: Column) -> Column:
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return even / (1 + odd / (1 + below))

    below = F.aggregate(F.sequence(terms, F.lit(1), F.lit(-1)), F.lit(0.0), lambda f, m: step(f, m.cast("double")))
    first = -(a + b) * x / (a + 1)
    front = F.exp(a * F.log(x) + b * F.log(1 - x) + _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b))
    return front / (a * (1 + first / (1 + below)))


def beta_cdf(a: Column, b: Column, x: float) -> Column:
    """P(rate <= x) under a beta distribution."""
    low = F.lit(x) <= (a + 1) / (a + b + 2)
    return F.when(low, _beta_tail(a, b, F.lit(x))).otherwise(1 - _beta_tail(b, a, F.lit(1 - x)))


def reputation(hosts: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """hosts (host, bad, n) -> host, bad, n, rate, weight of the posterior, whose parameters are rate * weight and
    (1 - rate) * weight. One row per host throughout."""
    work = shared.Workspace(hosts.sparkSession, "reputation")
    hosts = work.save(with_domains(hosts, suffixes), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    by_suffix = domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    bad, n = hosts.agg(F.sum("bad"), F.sum("n")).first()
    start = ((bad or 0) + 0.5) / ((n or 0) + 1.0)

    def posterior(groups: DataFrame) -> DataFrame:
        k = F.lit(_strength(groups))
        return groups.withColumn("weight", F.col("n") + k).withColumn("rate", (F.col("bad") + k * F.col("prior")) / (F.col("n") + k))

    by_suffix = posterior(by_suffix.withColumn("prior", F.lit(start))).select("suffix", F.col("rate").alias("prior"))
    domains = posterior(domains.join(shared.small(by_suffix, BROADCAST_ROWS), "suffix")).select("domain", "suffix", F.col("rate").alias("prior"))
    return posterior(hosts.join(shared.small(domains, BROADCAST_ROWS), ["domain", "suffix"])).select("host", "bad", "n", "rate", "weight")


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, limit: float = LIMIT, risk: float = RISK, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """One row per row of pages (page_id, url): page_id, host, path, rule, verdict, rate (the host's posterior bad rate).

    outcomes: (page_id, bad), bad 0 or 1.
    """
    work = shared.Workspace(pages.sparkSession, "url-filter")
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = outcomes.where("bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    counted = urls.select("page_id", "host").join(known, "page_id", "left")
    hosts = counted.groupBy("host").agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("bad").alias("n"))
    judged = reputation(hosts, suffixes)
    silent = judged.where("n > 0").isEmpty()
    below = F.lit(1.0) if silent else beta_cdf(F.col("rate") * F.col("weight"), (1 - F.col("rate")) * F.col("weight"), limit)
    judged = work.save(judged.select("host", "rate", F.when(below < risk, "block").otherwise("allow").alias("earned")), "verdicts")
    out = urls.join(shared.small(judged, BROADCAST_ROWS), "host").withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", "earned").alias("verdict"), "rate")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the quality labels: a page is bad where the label of its number is 0."""
    labels = shared.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return judge(shared.table(spark, sf_dir, "pages"), labels).drop("rate")


_KNOWN = ", ".join(f"'{x}'" for x in SUFFIXES)
def _strength_sql(groups: str) -> str:
    return f"""(select 1 / least(greatest(coalesce(sum((bad - n * prior) * (bad - n * prior) / n - prior * (1 - prior)) / nullif(sum((n - 1) * prior * (1 - prior)), 0),
      {LEAST_SPREAD}::double), {LEAST_SPREAD}::double), {MOST_SPREAD}::double) - 1 from {groups} where n > 0)"""


_STEP = "m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) / (1 - (a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)) / (1 + f))"

SQL = rf"""
with u as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') as host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages),
l as (select doc_id as page_id, max(1 - quality) as bad from labels where quality is not null group by 1),
h0 as (select host, coalesce(sum(bad), 0)::double as bad, count(bad)::double as n from u left join l using (page_id) group by host),
h1 as (select *, regexp_replace(regexp_replace(host, '^.*@', ''), '\.*(:[0-9]*)?$', '') as bare from h0),
h2 as (select host, bad, n, bare, regexp_extract(bare, '[^.]*\.[^.]*$') as two, regexp_extract(bare, '([^.]*\.)?[^.]*\.[^.]*$') as three, regexp_extract(bare, '[^.]*$') as one, regexp_matches(bare, '^[0-9.]+$') as numeric from h1),
h3 as (select host, bad, n, case when numeric then bare when two in ({_KNOWN}) then three when two <> '' then two else bare end as domain, case when numeric then '' when two in ({_KNOWN}) then two else one end as suffix from h2),
d0 as (select domain, suffix, sum(bad) as bad, sum(n) as n from h3 group by all),
s0 as (select suffix, sum(bad) as bad, sum(n) as n, (select (sum(bad) + 0.5::double) / (sum(n) + 1.0::double) from h3) as prior from d0 group by suffix),
s1 as (select *, {_strength_sql("s0")} as k from s0),
d1 as (select d0.*, (s1.bad + k * prior) / (s1.n + k) as prior from d0 join s1 using (suffix)),
d2 as (select *, {_strength_sql("d1")} as k from d1),
g1 as (select h3.*, (d2.bad + k * prior) / (d2.n + k) as prior from h3 join d2 using (domain, suffix)),
g2 as (select *, {_strength_sql("g1")} as k from g1),
g3 as (select host, (n + k) as w, (bad + k * prior) / (n + k) as rate, (select sum(n) from h3) as seen from g2),
-- the beta posterior: the side of the continued fraction that converges, then its terms from the last
p1 as (select host, seen, {LIMIT}::double <= (rate * w + 1) / (w + 2) as low, rate * w as p, (1 - rate) * w as q from g3),
p2 as (select host, seen, low, case when low then p else q end as a, case when low then q else p end as b, case when low then {LIMIT}::double else {1 - LIMIT}::double end as x from p1),
p3 as (select *, list_reduce(list_prepend(0::double, list_reverse(range(1, (sqrt(greatest(a, b)) * 4 + 60)::bigint))::double[]), lambda f, m: {_STEP}) as below from p2),
p4 as (select host, seen, low, exp(a * ln(x) + b * ln(1 - x) + lgamma(a + b) - lgamma(a) - lgamma(b)) / (a * (1 - (a + b) * x / (a + 1) / (1 + below))) as tail from p3),
j as (select host, case when seen > 0 and (case when low then tail else 1 - tail end) < {RISK}::double then 'block' else 'allow' end as earned from p4),
r as (select * from (values {", ".join(f"('{r.text}', '{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)}) x(rule, ruled, rule_host, rule_path)),
m as (select u.*, (select struct_pack(rule := rule, ruled := ruled) from r
             where (u.host = rule_host or ends_with(u.host, '.' || rule_host)) and starts_with(u.path, rule_path) order by length(rule) desc limit 1) as f from u)
select m.page_id, m.host, m.path, f.rule as rule, coalesce(f.ruled, j.earned) as verdict from m join j using (host)
"""
