"""Near-duplicates by MinHash bands and sequential Bayesian verification.

Texts are sets of word shingles. Two documents are linked if their sets' intersection is at least THRESHOLD
percent of the union; components of links are groups of near-duplicates.

1. Each document gets its set's digest, BANDS band keys of ROWS MinHash values each, and a further signature
   for verification. Documents with equal sets form one class, represented by its least id.
2. Classes that share a band key are candidates. First each is compared with the least id under its key, the
   leader, which joins large groups of near copies without listing their pairs; linked classes are united.
3. Classes that share a leader but are still apart are narrowed without listing their pairs and without
   losing a link. Of their shingles outside the leader's set, those that at most RARE of them hold list the
   few pairs that share one. Any other pair shares only shingles of the leader or frequent ones, so the lesser
   count of these bounds its intersection; pairs within that bound are listed too. Before, each class is
   compared with the one that has most of these shingles, as a second leader.
4. Candidates are compared by batches of their signatures. After each batch, those whose posterior
   probability of reaching the threshold (uniform prior) is below MISS are pruned.
5. Survivors are verified on their full sets.

A pair at the threshold shares no band with probability (1 - 0.8^5)^32 = 3e-6, less above it.

Defined results: a text without words (null, empty) has an empty set and is linked with nothing; a text with
fewer words than a shingle has one, the whole sequence; rows with the same doc_id are one document with the
links of all of them; a row with a null doc_id is kept only if no row with an id has its set (its
component_id is null then); only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .components import components

BANDS, ROWS = 32, 5
#: Values of the verification signature, how many are compared at a time, and the chosen miss probability.
CHECKED, BATCH, MISS = 64, 16, 1e-9
THRESHOLD = 80
#: A shingle outside the leader's set that at most this many classes of a leader hold lists their pairs.
RARE = 8
#: Distinct words whose hashes a task keeps.
WORD_LIMIT = 400_000

_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingle hashes: A-Z lower-cased, words between ASCII white space."""

    def __init__(self, words: int) -> None:
        self.k, self.known = words, _WordHashes()

    def set_of(self, text: str | None) -> np.ndarray:
        ws = (text or "").encode().lower().split()
        if not ws:
            return np.empty(0, np.uint64)
        if len(self.known) > WORD_LIMIT:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, ws), np.uint64, len(ws))
        k = min(self.k, len(h))
        s = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            s = _mix(s * _C[j % len(_C)] + h[j : len(h) - k + 1 + j])
        return np.unique(s)


def _coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


_A, _B = _coefficients(BANDS * ROWS + CHECKED, 20)


def minhash(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        y = np.multiply.outer(_A, x[i : i + 1024])
        y += _B[:, None]
        np.minimum(least, y.min(axis=1), out=least)
    return least


def band_keys(sig: np.ndarray) -> np.ndarray:
    v = sig[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = _mix(key * _C[0] + v[:, j])
    return key.view(np.int64)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, band keys, verification signature; the last three null for empty sets."""

    @F.pandas_udf("n_shingles long, digest binary, bands array<long>, signature binary")
    @shared.lean
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for texts in batches:
            out = []
            for text in texts:
                s = shingler.set_of(text)
                if not len(s):
                    out.append((0, None, None, None))
                    continue
                sig = minhash(s)
                out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), band_keys(sig), sig[BANDS * ROWS :].astype(np.uint16).tobytes()))
            yield pd.DataFrame(out, columns=["n_shingles", "digest", "bands", "signature"])

    return docs.select("doc_id", sketch(docs["text"]).alias("s")).select("doc_id", "s.*")


def least_matches(threshold: float, miss: float = MISS) -> list[tuple[int, int]]:
    """For each number m of values compared: the fewest matches that keep a pair.

    Under a uniform prior, P(similarity >= t | k of m match) = P(Binomial(m + 1, t) <= k).
    """
    out = []
    for m in range(BATCH, CHECKED + 1, BATCH):
        tail, k = 0.0, -1
        while tail < miss:
            k += 1
            tail += math.comb(m + 1, k) * threshold**k * (1 - threshold) ** (m + 1 - k)
        out.append((m, k))
    return out


def survivors(pairs: DataFrame, signatures: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that signature batches do not rule out."""
    limits = least_matches(threshold / 100)

    @shared.lean
    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            x, y = (np.frombuffer(b"".join(rows[c]), np.uint16).reshape(-1, CHECKED) for c in ("sig_a", "sig_b"))
            alive, matches, done = np.arange(len(rows)), np.zeros(len(rows), np.int64), 0
            for m, least in limits:
                matches += (x[alive, done:m] == y[alive, done:m]).sum(axis=1)
                keep = matches >= least
                alive, matches, done = alive[keep], matches[keep], m
            yield rows[["a", "b"]].iloc[alive]

    sig_a = signatures.select(F.col("id").alias("a"), F.col("signature").alias("sig_a"))
    sig_b = signatures.select(F.col("id").alias("b"), F.col("signature").alias("sig_b"))
    return pairs.join(sig_b, "b").join(sig_a, "a").select("a", "b", "sig_a", "sig_b").mapInPandas(prune, "a long, b long")


def with_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, text_a, text_b); pairs of one a follow each other within a task. The pairs of an a that has more than
    shared.HOT of them are spread over salts, and its text is repeated for each."""
    work = shared.Workspace(pairs.sparkSession, "pair-texts")
    ids = work.save(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    texts = shared.among(docs.select("doc_id", "text"), "doc_id", ids)
    hot = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > shared.HOT).select("a", F.lit(True).alias("hot"))
    hot = shared.small(hot, shared.BROADCAST_KEYS)
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("b"), F.lit(shared.SALTS))).otherwise(F.lit(0).cast("long"))
    salted = pairs.join(hot, "a", "left").select("a", "b", salt.alias("salt"))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(shared.SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    text_a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).join(hot, "a", "left").select("a", "text_a", F.explode(salts).alias("salt"))
    text_b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return salted.join(text_b, "b").join(text_a, ["a", "salt"]).select("a", "b", "text_a", "text_b")


def _sets(rows: pd.DataFrame, shingler: Shingler, last: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for text_a, text_b in zip(rows.text_a, rows.text_b, strict=True):
        if last[0] != text_a:
            last[:] = text_a, shingler.set_of(text_a)
        yield last[1], shingler.set_of(text_b)


def verified(pairs: DataFrame, docs: DataFrame, words: int, threshold: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""

    @shared.lean
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, last = Shingler(words), [None, None]
        for rows in batches:
            keep = []
            for x, y in _sets(rows, shingler, last):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= threshold * (len(x) + len(y) - both))
            yield rows.loc[np.array(keep, bool), ["a", "b"]]

    return with_texts(pairs, docs).mapInPandas(verify, "a long, b long")


def outside_leader(members: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(lo, id) -> lo, id, common (shingles that id shares with lo), others (those it has besides)."""

    @shared.lean
    def differ(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, last = Shingler(words), [None, None]
        for rows in batches:
            others = [np.setdiff1d(y, x, assume_unique=True) for x, y in _sets(rows, shingler, last)]
            sizes = [len(shingler.set_of(t)) for t in rows.text_b]
            yield pd.DataFrame({"lo": rows.a, "id": rows.b, "common": [n - len(o) for n, o in zip(sizes, others, strict=True)], "others": [o.view(np.int64) for o in others]})

    pairs = members.select(F.col("lo").alias("a"), F.col("id").alias("b"))
    return with_texts(pairs, docs).mapInPandas(differ, "lo long, id long, common long, others array<long>")


def similar_sizes(x: str, y: str, threshold: int) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * threshold


def second_leaders(profile: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b): for each leader the class with the largest share of known shingles, and those apart from it."""
    best = F.max_by(F.struct("id", "n", "component"), F.struct(F.col("inside") / F.col("n"), -F.col("id")))
    leaders = profile.groupBy("lo").agg(best.alias("best")).select("lo", F.col("best.id").alias("a"), F.col("best.n").alias("n_a"), F.col("best.component").alias("c_a"))
    both = profile.join(shared.small(leaders, shared.BROADCAST_KEYS), "lo").where((F.col("component") != F.col("c_a")) & similar_sizes("n", "n_a", threshold))
    return both.select("a", F.col("id").alias("b"))


def narrowed(profile: DataFrame, rare: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) that share a leader, lie in different components and may be linked.

    profile: lo, id, n, inside (shingles of the leader or frequent), n_rare, component. rare: lo, shingle, id.
    """
    need = F.lit(threshold) * (F.col("n_a") + F.col("n_b"))  # (100 + threshold) * intersection reaches it in linked pairs

    def sides(df: DataFrame) -> list[DataFrame]:
        common = [c for c in df.columns if c in ("lo", "shingle")]
        return [df.select(*common, F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("inside").alias(f"in_{x}"), F.col("n_rare").alias(f"rare_{x}"), F.col("component").alias(f"c_{x}")) for x in "ab"]

    apart = (F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & similar_sizes("n_a", "n_b", threshold)
    most = F.least("in_a", "in_b") + F.least("rare_a", "rare_b")
    a, b = sides(rare.join(profile, ["lo", "id"]))
    by_rare = a.join(b, ["lo", "shingle"]).where(apart & (most * (100 + threshold) >= need)).select("a", "b")

    # what holds for both sides of such a pair: enough shingles inside, also for the smallest partner there is
    able = profile.where(F.col("inside") * 100 >= F.col("n") * threshold)
    smallest = able.groupBy("lo").agg(F.min("n").alias("least_n"))
    able = able.join(shared.small(smallest, shared.BROADCAST_KEYS), "lo").where(F.col("inside") * (100 + threshold) >= (F.col("n") + F.col("least_n")) * threshold)
    several = able.groupBy("lo").agg((F.min("component") != F.max("component")).alias("several")).where("several").select("lo")
    a, b = sides(able.join(shared.small(several, shared.BROADCAST_KEYS), "lo", "left_semi"))
    by_bound = a.join(b, "lo").where(apart & (F.least("in_a", "in_b") * (100 + threshold) >= need)).select("a", "b")
    return by_rare.union(by_bound).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    shared.small_batches(docs.sparkSession)
    result = shared.Workspace(docs.sparkSession, "near-duplicates")
    with shared.temporary():
        return result.save(_decided(docs, words, threshold), "result")


def _decided(docs: DataFrame, words: int, threshold: int) -> DataFrame:
    spark = docs.sparkSession
    work = shared.Workspace(spark, "near-dedup")
    sketched = work.save(sketches(docs, words), "sketches")
    classes = sketched.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"))
    classes = work.save(classes, "classes")
    of_class = sketched.join(classes.withColumnRenamed("id", "doc_id"), ["digest", "doc_id"], "left_semi").select(F.col("doc_id").alias("id"), "n_shingles", "bands", "signature")
    of_class = work.save(of_class, "class-sketches")
    signatures = of_class.select("id", "signature")

    rows = of_class.select(F.explode("bands").alias("key"), "id", "n_shingles")
    crowded = work.save(rows.groupBy("key").agg(F.count("*").alias("n"), F.min_by("n_shingles", "id").alias("n_lo"), F.min("id").alias("lo")).where("n > 1"), "crowded")
    members = work.save(shared.join_counted(rows, crowded, ["key"]), "members")

    def links_of(pairs: DataFrame, name: str) -> DataFrame:
        left = work.save(survivors(pairs.distinct(), signatures, threshold), f"{name}-survivors")
        return work.save(verified(left, docs, words, threshold), f"{name}-links")

    def labelled(df: DataFrame, groups: DataFrame) -> DataFrame:
        return df.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))

    star = members.where((F.col("id") != F.col("lo")) & similar_sizes("n_shingles", "n_lo", threshold)).select(F.col("lo").alias("a"), F.col("id").alias("b"))
    links = links_of(star, "star")
    groups = work.save(components(links, work, "star-components"), "star-groups")

    # leaders with classes under one key that are still apart
    of_key = work.save(labelled(members.where("id != lo").select("key", "lo", "id", F.col("n_shingles").alias("n")), groups), "labelled")
    mixed = of_key.groupBy("key").agg((F.min("component") != F.max("component")).alias("mixed")).where("mixed").select("key")
    apart = work.save(of_key.join(shared.small(mixed, shared.BROADCAST_KEYS), "key", "left_semi").select("lo", "id", "n").distinct(), "apart")
    outside = work.save(outside_leader(apart, docs, words), "outside")
    each = outside.select("lo", "id", F.explode("others").alias("shingle"))
    holders = each.groupBy("lo", "shingle").agg(F.count("*").alias("n")).where("n > 1")
    holders = work.save(holders.withColumn("holders", F.col("n")), "holders")
    held = work.save(shared.join_counted(each, holders, ["lo", "shingle"]), "held")
    known = held.groupBy("lo", "id").agg(F.count_if(F.col("holders") > RARE).alias("frequent"), F.count_if(F.col("holders") <= RARE).alias("n_rare"))
    profile = apart.join(outside.drop("others"), ["lo", "id"]).join(known, ["lo", "id"], "left").fillna(0, ["frequent", "n_rare"])
    profile = work.save(profile.withColumn("inside", F.col("common") + F.col("frequent")).drop("common", "frequent"), "profile")

    links = links_of(second_leaders(labelled(profile, groups), threshold), "second")
    groups = work.save(components(links, work, "second-components", groups), "second-groups")
    rest = narrowed(labelled(profile, groups), held.where(F.col("holders") <= RARE).drop("holders"), threshold)
    groups = work.save(components(links_of(rest, "rest"), work, "components", groups), "groups")
    found = sketched.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left").join(groups, "id", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "id", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.table(spark, sf_dir, "documents"), words=4)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near-duplicates, all its texts included; rows that repeat an id and its
    text leave one. No decision names rows of a null doc_id: of these, one stays for each text."""
    found = near_duplicates(docs)
    dropped = found.where("not kept and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    whole = docs.select(F.struct("*").alias("d"))
    kept = whole.join(dropped, F.col("d.doc_id") == F.col("_id"), "left_anti")
    several = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("_id"))
    if several.isEmpty():
        return kept.select("d.*")
    own = F.col("d.doc_id").eqNullSafe(F.col("_id"))
    once = kept.join(several, own, "left_semi").select("d", F.col("d.doc_id").alias("i"), F.col("d.text").alias("t")).dropDuplicates(["i", "t"])
    return kept.join(several, own, "left_anti").union(once.select("d")).select("d.*")


SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
  else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) end) as shingle from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r(doc_id, root) as (select doc_id, doc_id from documents union select e.b, r.root from r join e on e.a = r.doc_id where r.root < e.b),
m as (select doc_id, min(root) as component_id from r group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id, d.doc_id = m.component_id as kept
from documents d left join n using (doc_id) join m using (doc_id)
"""
