"""Exact deduplication by an extendible-hash index on shared files, with SQL functions only.

Keys are 64-bit hashes of texts without white space. A first pass writes one narrow posting per document to
the shared folder. A directory maps the top bits of a key to a bucket: starting from one bucket, every
bucket with more keys than fit splits on its next bit, and the directory doubles when a bucket is split
that uses all its bits. The end of these splits is found at once, from key counts per prefix, with as many bits as
no bucket needs more. Buckets are contiguous key ranges.

Postings are collapsed per key, digest and salt, so that no group of copies is dealt row by row, and are then dealt by bucket.
The owner of a bucket merges what it is dealt, compares the bytes of the texts under every key that occurs more
than once, chains the different texts of a key, chooses which document stays, and writes the bucket's file. All
answers are read from these files. Texts that were compared are one link of a chain only if their least and
greatest bytes are the same; the digest that names a link in the files is checked by that comparison.

Defined results: a null text counts as empty; rows that repeat a doc_id with an equal text all count in
group_size and share one decision; a null doc_id loses ties, and stays only where no other row has as many
code points; `kept` compares ids null-safely; only doc_id and text are read, so other columns cannot clash.
keep_first leaves one row of each group, also where ids are null or shared by several texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: Keys a bucket holds before it splits, and the salts that a group of copies is collapsed by before it is dealt.
BUCKET_KEYS, SALTS = 32_768, 4
#: Slots of the directory that are broadcast (24 bytes each); a larger directory is joined by shuffles.
BROADCAST_SLOTS = 1 << 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def key_of(text: Column, key_bits: int = 64) -> Column:
    """The hash; fewer bits than 64 (its top ones) make collisions for tests."""
    h = F.xxhash64(text)
    return h if key_bits == 64 else F.shiftleft(F.shiftrightunsigned(h, 64 - key_bits), 64 - key_bits)


def slot(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def slot_counts(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """(slot, n) at the fewest bits, in steps of two, at which no slot overflows; and these bits.

    keys (key) are distinct, so at 63 bits a slot has two at most.
    """
    bits = max(0, math.ceil(math.log2(max(1, keys.count() / capacity)))) + 2
    while True:
        counts = keys.groupBy(slot(F.col("key"), bits).alias("slot")).agg(F.count("*").alias("n"))
        fullest = counts.agg(F.max("n")).first()[0] or 0
        if fullest <= max(capacity, 2) or bits >= 63:
            return counts, bits
        bits = min(63, bits + 2)


def directory(counts: DataFrame, bits: int, capacity: int = BUCKET_KEYS) -> DataFrame:
    """(slot, depth, bucket) for each slot in use: bucket is the first slot of its key range, depth its bits.

    A bucket of depth d holds the keys that share d top bits; it is the shallowest that fits, as each split
    adds a bit.
    """
    at_depth = counts.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    at_depth = at_depth.withColumn("bucket", F.expr(f"shiftleft(shiftright(slot, {bits} - depth), {bits} - depth)"))
    sizes = at_depth.groupBy("depth", "bucket").agg(F.sum("n").alias("size"))
    fits = sizes.where((F.col("size") <= capacity) | (F.col("depth") == bits)).select("depth", "bucket")
    found = at_depth.join(shared.small(fits, BROADCAST_SLOTS), ["depth", "bucket"])
    return found.groupBy("slot").agg(F.min("depth").alias("depth"), F.min_by("bucket", "depth").alias("bucket"))


def postings_of(docs: DataFrame, key_bits: int = 64) -> DataFrame:
    """Narrow rows: doc_id, key, code_points, text_sha256."""
    rows = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("code_points"), normalised(F.col("text")).alias("plain"))
    return rows.select("doc_id", key_of(F.col("plain"), key_bits).alias("key"), "code_points", F.sha2("plain", 256).alias("text_sha256"))


def build_index(docs: DataFrame, work: shared.Workspace, capacity: int = BUCKET_KEYS, key_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Postings, and the index (bucket, depth, key, link, text_sha256, keep_id, keep_points, group_size)."""
    postings = work.save(postings_of(docs, key_bits), "postings")
    keys = work.save(postings.groupBy("key").agg(F.count("*").alias("n")), "keys")
    counts, bits = slot_counts(keys.select("key"), capacity)
    slots = work.save(directory(work.save(counts, "counts"), bits, capacity), "directory")

    # the texts under keys that occur more than once, to be compared
    texts = docs.select("doc_id", normalised(F.col("text")).alias("plain")).withColumn("key", key_of(F.col("plain"), key_bits))
    texts = shared.among(texts, "key", keys.where("n > 1").select("key"))
    rank = F.struct(F.col("code_points"), F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("low"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")
    rows = postings.select("key", "text_sha256", salt, F.lit(1).alias("n"), rank.alias("best"), F.lit(None).cast("string").alias("plain"))
    rows = rows.union(texts.select("key", F.sha2("plain", 256), salt, F.lit(0), F.lit(None).cast(rows.schema["best"].dataType), "plain"))
    merged = [F.sum("n").alias("n"), F.max("best").alias("best")]
    collapsed = rows.groupBy("key", "text_sha256", "salt").agg(*merged, F.min("plain").alias("least"), F.max("plain").alias("most"))
    collapsed = collapsed.withColumn("most", F.when(F.col("most") != F.col("least"), F.col("most")))  # one text is dealt once

    # the deal: every row goes to the owner of its bucket
    owners = max(1, slots.select("bucket").distinct().count())
    dealt = collapsed.withColumn("slot", slot(F.col("key"), bits)).join(shared.small(slots, BROADCAST_SLOTS), "slot").repartition(owners, "bucket")
    # what an owner does; neither step moves rows again
    links = dealt.groupBy("bucket", "depth", "key", "text_sha256").agg(*merged, F.min("least").alias("least"), F.max(F.greatest("least", "most")).alias("most"))
    same = F.when(F.col("least").eqNullSafe(F.col("most")), F.col("text_sha256")).otherwise(F.raise_error(F.lit("different bytes under one digest")))
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("text_sha256")) - 1
    index = links.select("bucket", "depth", "key", chain.alias("link"), same.alias("text_sha256"), (-F.col("best.low")).alias("keep_id"), F.col("best.code_points").alias("keep_points"), F.col("n").alias("group_size"))
    index = work.save(index, "index", partition_by="bucket")
    work.drop("keys", "counts", "directory")
    return postings, index


def decisions(docs: DataFrame, work: shared.Workspace, capacity: int = BUCKET_KEYS, key_bits: int = 64) -> DataFrame:
    """One row per row of docs: its posting with the keep_id, keep_points and group_size of its link in the index."""
    postings, index = build_index(docs, work, capacity, key_bits)
    return postings.join(index.select("key", "text_sha256", "keep_id", "keep_points", "group_size"), ["key", "text_sha256"])


def deduplicate(docs: DataFrame, capacity: int = BUCKET_KEYS, key_bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    found = decisions(docs, shared.Workspace(docs.sparkSession, "exact-dedup"), capacity, key_bits)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(shared.table(spark, sf_dir, "documents"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row of each group. Rows whose id is null or occurs more than once are told apart by their texts;
    all others are dropped by id alone."""
    work = shared.Workspace(docs.sparkSession, "exact-kept")
    found = work.save(decisions(docs, work).select("doc_id", "text_sha256", "code_points", "keep_id", "keep_points"), "decisions")
    shared_ids = work.save(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("_id")), "shared-ids")
    dropped = found.where("not doc_id <=> keep_id and doc_id is not null").select(F.col("doc_id").alias("_id"))
    whole = docs.select(F.struct("*").alias("d"))
    if shared_ids.isEmpty():
        return whole.join(dropped, F.col("d.doc_id") == F.col("_id"), "left_anti").select("d.*")
    own = F.col("d.doc_id").eqNullSafe(F.col("_id"))
    alone = whole.join(shared_ids.union(dropped), own, "left_anti")
    several = whole.join(shared_ids, own, "left_semi").withColumn("_sha", F.sha2(normalised(F.col("d.text")), 256)).withColumn("_points", F.length(F.coalesce("d.text", F.lit(""))))
    stays = found.where("doc_id <=> keep_id and code_points = keep_points").select("doc_id", "text_sha256", "code_points").distinct()
    same = F.col("d.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("_sha") == F.col("text_sha256")) & (F.col("_points") == F.col("code_points"))
    return alone.union(several.join(stays, same, "left_semi").dropDuplicates(["_sha"]).select("d")).select("d.*")


SQL = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as code_points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as plain
  from documents),
g as (
  select plain, arg_min(doc_id, (-code_points, doc_id)) as keep_id, count(*) as group_size from t group by plain)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.plain) as text_sha256
from t join g on t.plain = g.plain
"""
