"""Mixing sources to target weights along a curriculum that varies over training time, with SQL functions only.

Weights give each source a share of the mix's words; no source gives more than REPEATS times its size, and
what it cannot give goes to the others by weight. A source's rate over training time u in [0, 1] is a line
1 + tilt * (2u - 1), times its target; the integral up to u is its cumulative demand,
target * (tilt * u^2 + (1 - tilt) * u). A source offers its documents in the order of a digest of their ids,
pass after pass; the document that starts at offset c of the offered words enters where cumulative demand
reaches c, found by inverting the integral, and enters again a source's size later in each further pass.
The mix is range-sorted by the positions of all passes together.

Offsets are prefix sums. The order is cut into SLICES by the digest's first digits, so that no task sums
more than a slice of one source: sizes per source and slice first, their prefix sums next, and then running
sums inside each slice.

The last document that a source gives is entered up to the end of the demand, so `taken` meets targets to a
word; every other document is taken whole, as many times as passes reach it.

Defined results: a null text has size 0 and takes 0; sources sort by code point with null last; sources
without words have target 0; an empty table gives no rows; rows that repeat an id follow each other by size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: Weights of sources in order, repeating; their tilts likewise; the share of all words that a mix has; the most passes.
WEIGHTS, TILTS, SHARE_PERCENT, REPEATS = (5, 2, 1), (-50, 0, 50), 150, 2
#: Hexadecimal digits of the digest that name a slice (4,096 slices).
SLICE_DIGITS = 3


def _cycle(values: tuple[int, ...], rank: str) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(rank) % len(values) + 1).cast("int"))


def sizes(docs: DataFrame) -> DataFrame:
    """Narrow rows: doc_id, source, its key without null, the digest that orders documents, and size in words."""
    return docs.select(
        "doc_id",
        "source",
        F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source"))).alias("k"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("digest"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
    )


def targets(source_sizes: DataFrame, weights=WEIGHTS, tilts=TILTS, share_percent: int = SHARE_PERCENT, repeats: int = REPEATS) -> DataFrame:
    """(k, source_size) -> k, source_size, target, tilt. One row per source; the windows run over these rows only.

    Sources reach their limit in the order of limit over weight. The first that does not is where the rest of
    the words, shared by the rest of the weights, no longer exceeds the limit; all after it share likewise.
    """
    ranked = source_sizes.withColumn("rank", F.row_number().over(Window.orderBy("k")) - 1)
    ranked = ranked.withColumn("weight", _cycle(weights, "rank").cast("long")).withColumn("tilt", _cycle(tilts, "rank"))
    ranked = ranked.withColumn("limit", F.col("source_size") * repeats)
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "k")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    all_words = F.sum("source_size").over(Window.partitionBy())
    left = all_words * share_percent - F.coalesce(F.sum("limit").over(before), F.lit(0)) * 100
    ranked = ranked.withColumn("left", left).withColumn("left_weight", F.sum("weight").over(onward))
    ranked = ranked.withColumn("at_limit", F.col("left") * F.col("weight") >= F.col("limit") * 100 * F.col("left_weight"))
    first_free = F.min(F.when(~F.col("at_limit"), F.struct((F.col("limit") / F.col("weight")).alias("ratio"), "k", "left", "left_weight"))).over(Window.partitionBy())
    ranked = ranked.withColumn("free", first_free)
    shared_out = F.col("weight") * F.col("free.left") / (F.lit(100.0) * F.col("free.left_weight"))
    return ranked.select("k", "source_size", F.when(F.col("at_limit"), F.col("limit").cast("double")).otherwise(shared_out).alias("target"), "tilt")


def plan(docs: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, position, positions.

    position is the training time at which the document first enters, in millionths of a word's share (null if it never does);
    positions holds that of each of the passes (`repeats` of them at most), null for passes that do not reach the document.
    """
    spark = docs.sparkSession
    work = shared.Workspace(spark, "mixing")
    rows = work.save(sizes(docs), "sizes").withColumn("slice", F.substring("digest", 1, SLICE_DIGITS))
    cells = work.save(rows.groupBy("k", "slice").agg(F.sum("size").alias("cell")), "cells")
    goal = targets(cells.groupBy("k").agg(F.sum("cell").alias("source_size")), repeats=repeats)
    prior = F.coalesce(F.sum("cell").over(Window.partitionBy("k").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = work.save(cells.withColumn("prior", prior).join(goal, "k").drop("cell"), "offsets")
    inside = Window.partitionBy("k", "slice").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(cells, ["k", "slice"]).withColumn("offset", F.col("prior") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return placed.select("doc_id", "source", "size", "source_size", "target", *_entries(repeats))


def _entries(repeats: int) -> list[F.Column]:
    end = F.floor(F.col("target") + 0.5)
    taken = F.lit(0).cast("long")
    for done in range(repeats):
        # of this pass, the words from offset on that lie before the end
        taken = taken + F.greatest(F.lit(0), F.least(F.col("size"), end - F.col("offset") - F.col("source_size") * done))
    k = F.col("tilt") / 100.0

    def position(done: int) -> F.Column:
        offset = F.col("offset") + F.col("source_size") * done
        y = offset / F.col("target")
        u = F.when(F.col("tilt") == 0, y).otherwise((F.sqrt((1 - k) * (1 - k) + 4 * k * y) - (1 - k)) / (2 * k))
        return F.when((F.col("target") > 0) & (offset < end), F.floor(u * 1_000_000).cast("long"))

    return [taken.cast("long").alias("taken"), position(0).alias("position"), F.array(*map(position, range(repeats))).alias("positions")]


def range_sorted(planned: DataFrame) -> DataFrame:
    """By training position; documents that never enter come last."""
    parts = int(planned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("position").asc_nulls_last(), "doc_id"]
    return planned.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = shared.Workspace(spark, "mix-query")
    planned = work.save(plan(shared.table(spark, sf_dir, "documents")).withColumn("second_position", F.get("positions", F.lit(1))).drop("positions"), "plan")
    return range_sorted(planned).select("doc_id", "size", "source_size", "target", "taken", "position", "second_position")


def mixed(docs: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """docs as the mix has them: a row for each pass that reaches the document (whole, also where the demand
    ends inside it), none for documents that are not reached, range-sorted by the positions of all passes; the columns of docs."""
    work = shared.Workspace(docs.sparkSession, "mix")
    first_of_id = F.array(*(F.min(F.get("positions", F.lit(done))) for done in range(repeats)))
    entered = work.save(plan(docs, repeats).where("taken > 0").groupBy("doc_id").agg(first_of_id.alias("_positions")), "entered").withColumnRenamed("doc_id", "_doc_id")
    rows = docs.select(F.struct("*").alias("d")).join(entered, F.col("d.doc_id").eqNullSafe(F.col("_doc_id")))
    rows = rows.select("d", "_doc_id", F.posexplode("_positions").alias("_pass", "_position")).where("_position is not null")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["_position", "_doc_id", "_pass"]
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("d.*")


SQL = r"""
with d as (
  select doc_id, case when source is null then '1' else '0' || source end as k, md5(coalesce(cast(doc_id as varchar), '')) as digest,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
s as (select k, sum(size)::bigint as source_size from d group by k),
r as (select *, (row_number() over (order by k) - 1) as rnk from s),
w as (select k, source_size, 2 * source_size as lim, case rnk % 3 when 0 then 5 when 1 then 2 else 1 end as weight,
             case rnk % 3 when 0 then -50 when 1 then 0 else 50 end as tilt from r),
x as (select *, ((sum(source_size) over ()) * 150
             - 100 * coalesce(sum(lim) over (order by lim / weight, k rows between unbounded preceding and 1 preceding), 0))::bigint as lft,
             (sum(weight) over (order by lim / weight, k rows between current row and unbounded following))::bigint as left_weight from w),
f as (select *, lft * weight >= lim * 100 * left_weight as at_limit from x),
g as (select lft, left_weight from f where not at_limit order by lim / weight, k limit 1),
t as (select f.k, f.source_size, f.tilt,
             case when at_limit then lim::double else (weight * (select lft from g))::double / (100.0::double * (select left_weight from g)) end as target from f),
o as (select d.doc_id, d.size, t.source_size, t.target, t.tilt, floor(t.target + 0.5)::bigint as fin,
             coalesce(sum(d.size) over (partition by d.k order by d.digest, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as pos
      from d join t on d.k = t.k),
y as (select *, tilt::double / 100.0::double as a, pos::double / target as b, (pos + source_size)::double / target as c from o)
select doc_id, size, source_size, target,
       greatest(0, least(size, fin - pos)) + greatest(0, least(size, fin - pos - source_size)) as taken,
       case when target > 0 and pos < fin then floor((case when tilt = 0 then b else (sqrt((1 - a) * (1 - a) + 4 * a * b) - (1 - a)) / (2 * a) end) * 1000000)::bigint end as position,
       case when target > 0 and pos + source_size < fin then floor((case when tilt = 0 then c else (sqrt((1 - a) * (1 - a) + 4 * a * c) - (1 - a)) / (2 * a) end) * 1000000)::bigint end as second_position
from y
"""
