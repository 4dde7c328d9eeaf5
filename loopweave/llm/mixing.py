"""Operator 8: mixing sources to target weights by a low-discrepancy slot schedule.

The mix is a row of about SLOTS slots of equally many words. Slot i has the golden-ratio point frac((i + 1) * phi),
which the cumulative shares of the targets map to a source, so any stretch of the schedule holds each source with
nearly its share. The slots of a source are ranked, and the slot of rank r reads the r-th block of the source's line:
its documents in a shuffled order, end to end, read round as often as the target asks. At every size one rule holds:
the words of a source's rounded target lie in equal blocks, one for each of its slots, block r of n from word
r * words div n on; a source too small for a slot of its own puts its one block into the slot that its name picks.

A document's words in the mix follow from its place in the line and from how far the line is read; its first slot
comes from a join of blocks with ranks. Places and ranks are prefix sums in two levels, within bins and over bins, so
a source with a third of all rows is spread over many tasks. The schedule has the same size for any corpus.

Defined results
* very long texts are counted whole; rows without a doc_id are mixed like any other, at the place of the empty id;
* null text: size 0; documents of size 0: taken 0, no slot; an empty table gives an empty result;
* null source is a source of its own, the last; a source without words has target 0;
* repeated rows count each for itself; ties in the shuffled order go by size, and then are interchangeable;
* extra columns are kept by `mix` (those named like its results are replaced) and ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, SPACE_RUN, cut, few

#: Weights of the sources in order, repeating, and the cap on a source's target.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
#: Slots of a schedule; its points in units of 2**-32, and phi's fraction in them.
SLOTS = 1 << 18
POINTS, GOLDEN = 1 << 32, 2_654_435_769
#: Documents in a bin of a line on average, and slots in a bin of the schedule.
BIN_ROWS, BIN_SLOTS = 2048, 1 << 12
SEED = "mix"
#: Sources whose table is broadcast, some 60 bytes each.
BROADCAST_SOURCES = 50_000

_ALL = (Window.unboundedPreceding, Window.unboundedFollowing)
_BEFORE = (Window.unboundedPreceding, -1)
RESULTS = ("size", "source_size", "target", "taken", "first_slot")


def n_words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(ASCII_SPACE))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE_RUN))).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weighted shares of all words under the caps.

    Resharing the excess until none is above its cap ends where each source has the smaller of its cap and one level
    times its weight. In order of cap / weight the capped ones come first, so running sums give the level. The table
    has a row for each source, a manifest's size, however large the corpus.
    """
    name = [F.col("source").isNull(), F.col("source")]
    at = (F.row_number().over(Window.orderBy(*name)) - 1) % len(weights)
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), at + 1))
    line = Window.orderBy(F.col("source_size") / F.col("weight"), *name)
    rest = F.sum("source_size").over(Window.rowsBetween(*_ALL)) - cap * F.coalesce(F.sum("source_size").over(line.rowsBetween(*_BEFORE)), F.lit(0))
    level = rest / F.sum("weight").over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    weighed = weighed.withColumn("level", level)
    # a level holds if all sources before it in the line are capped; the first that isn't sets it for the rest
    capped = (cap * F.col("source_size") <= F.col("level") * F.col("weight")).cast("int")
    weighed = weighed.withColumn("full", F.min(capped).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 1)
    top = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(line.rowsBetween(*_ALL))
    target = F.when(F.col("full"), (cap * F.col("source_size")).cast("double")).otherwise(top * F.col("weight"))
    return weighed.select("source", "source_size", target.alias("target"))


def slot_words(total: int, slots: int = SLOTS) -> int:
    """Words of a slot: the same for all slots, so that a mix of `total` words has about `slots` of them."""
    return max(1, -(-total // slots))


def schedule(spark, mixed: DataFrame, total: int, slots: int = SLOTS) -> DataFrame:
    """(slot, source, rank) of all slots of a mix of `total` words; mixed has (source, target) of each source."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    share = F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("target").over(Window.rowsBetween(*_ALL))
    ends = mixed.filter("target > 0").select("source", F.least(F.floor(share * POINTS), F.lit(POINTS)).cast("long").alias("end"))
    ends = ends.withColumn("begin", F.coalesce(F.lag("end").over(order), F.lit(0).cast("long"))).filter("begin < end")
    # points meet sources by an equi-join on 1024 stripes of the unit interval
    ends = ends.withColumn("stripe", F.explode(F.sequence(F.shiftright("begin", 22), F.shiftright(F.col("end") - 1, 22))))
    points = spark.range(-(-total // slot_words(total, slots))).withColumn("point", ((F.col("id") + 1) * GOLDEN) % POINTS)
    placed = (
        points.withColumn("stripe", F.shiftright("point", 22))
        .join(ends, "stripe")
        .filter("point >= begin and point < end")
        .select(F.col("id").alias("slot"), F.floor(F.col("id") / BIN_SLOTS).alias("bin"), "source")
    )
    ahead = F.sum("n").over(Window.partitionBy("source").orderBy("bin").rowsBetween(*_BEFORE))
    counts = placed.groupBy("source", "bin").agg(F.count("*").alias("n"))
    counts = counts.select(F.col("source").alias("s"), F.col("bin").alias("b"), F.coalesce(ahead, F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("source", "bin").orderBy("slot")) - 1
    return (
        placed.withColumn("inside", inside)
        .join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
        .select("slot", "source", (F.col("ahead") + F.col("inside")).alias("rank"))
    )


def _key(source: Column) -> Column:
    """The source as a text that is never null, so that windows and joins by it can share an exchange."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def lay_out(df: DataFrame, n_rows: int, seed: str = SEED) -> DataFrame:
    """df (doc_id, source, size, ...) with `_source`, its key, and `place`: the words ahead of a document in its line.

    Rows move once: windows and the join with what lies ahead of a bin are by the same columns.
    """
    bins = max(1, -(-n_rows // BIN_ROWS))
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":" + seed)).cast("binary"))
    keyed = df.withColumn("_source", _key(F.col("source"))).withColumn("_order", order)
    keyed = keyed.withColumn("_bin", F.floor(F.conv(F.substr("_order", F.lit(1), F.lit(8)), 16, 10).cast("long") * bins / POINTS))
    sums = keyed.groupBy("_source", "_bin").agg(F.sum("size").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("_source").orderBy("_bin").rowsBetween(*_BEFORE))
    sums = sums.select("_source", "_bin", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    inside = F.sum("size").over(Window.partitionBy("_source", "_bin").orderBy("_order", "size").rowsBetween(*_BEFORE))
    placed = keyed.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(sums, ["_source", "_bin"])
    return placed.withColumn("place", F.col("_ahead") + F.col("_inside")).drop("_order", "_bin", "_ahead", "_inside")


def _measured(df: DataFrame, slots: int, seed: str) -> tuple[DataFrame, DataFrame, int]:
    """df with source_size, target, taken, its place in its line and how the line is read; the schedule; its number of slots."""
    spark = df.sparkSession
    own = df.drop(*[c for c in RESULTS if c != "size"])
    sources = cut(own.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    n_sources, total, n_docs = sources.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    mixed = targets(sources)
    plan = cut(schedule(spark, mixed, total, slots))
    held = plan.groupBy(_key(F.col("source")).alias("_source")).agg(F.count("*").alias("_slots"))
    # the line is read so far; as often as the cap allows at most
    mixed = mixed.withColumn("_source", _key(F.col("source"))).join(held, "_source", "left")
    mixed = mixed.withColumn("_slots", F.coalesce("_slots", F.lit(0))).withColumn("target", F.coalesce("target", F.lit(0.0)))
    mixed = mixed.select("_source", "source_size", "target", "_slots", F.least(F.round("target").cast("long"), MAX_REPEAT * F.col("source_size")).alias("_read"))
    # a row for each source: counted above, and shuffled if a manifest should be that long
    mixed = F.broadcast(mixed) if n_sources <= BROADCAST_SOURCES else mixed
    laid = lay_out(own, n_docs, seed).join(mixed, "_source")
    rounds = F.floor(F.col("_read") / F.greatest("source_size", F.lit(1)))
    rest = F.col("_read") - rounds * F.col("source_size")
    laid = laid.withColumn("taken", (rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("place")))).cast("long"))
    return laid, plan, max(1, -(-total // slot_words(total, slots)))


def _with_slot(laid: DataFrame, plan: DataFrame, n_slots: int, word: str, name: str) -> DataFrame:
    """laid with the slot of the block in which a word of its line lies, null for documents of which nothing is taken."""
    # the last block that begins at or before the word
    laid = laid.withColumn("_rank", F.when(F.col("taken") > 0, F.expr(f"(({word} + 1) * _slots - 1) div _read")))
    at = plan.select(_key(F.col("source")).alias("_source"), F.col("rank").alias("_rank"), F.col("slot").alias(name))
    picked = F.conv(F.substr(F.md5(F.col("_source").cast("binary")), F.lit(1), F.lit(8)), 16, 10).cast("long") % n_slots
    shared = F.when((F.col("taken") > 0) & (F.col("_slots") == 0), picked)
    # the schedule has SLOTS rows at most, so rows need not move to meet it
    return laid.join(few(at), ["_source", "_rank"], "left").withColumn(name, F.coalesce(name, shared)).drop("_rank")


def mix(df: DataFrame, slots: int = SLOTS, seed: str = SEED, with_slot: bool = True) -> DataFrame:
    """df (doc_id, source, size, ...) with source_size, target, taken (words in the mix) and, if asked, first_slot."""
    laid, plan, n_slots = _measured(df, slots, seed)
    if with_slot:
        laid = _with_slot(laid, plan, n_slots, "place", "first_slot")
    return laid.drop("_read", "_slots", "place", "_source")


def op8_mixing(df: DataFrame) -> DataFrame:
    """The contract's digest: one row for each document."""
    sized = cut(df.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents as often as the mix takes them, in the order of the schedule.

    A document stays once for each time that at least half of its words are taken, so texts are never cut; a document
    without words stays once, as the mix has nothing to take of it. Each time has a slot of its own, that of its first
    word in that round of the line (without words: one picked by its id). Partitions are stretches of the schedule, so
    what is packed together holds each source with nearly its share.
    """
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.struct("*").alias("row"))
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))))
    laid, plan, n_slots = _measured(sized, SLOTS, SEED)
    laid = laid.withColumn("_copies", copies.cast("int")).filter("_copies > 0")
    laid = laid.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).withColumn("_word", F.col("place") + F.col("_copy") * F.col("source_size"))
    placed = _with_slot(laid, plan, n_slots, "_word", "_slot")
    placed = placed.select("row", "_word", F.coalesce("_slot", F.pmod(F.xxhash64("doc_id"), F.lit(n_slots))).alias("_slot"))
    return placed.repartitionByRange("_slot").sortWithinPartitions("_slot", "_word").select("row.*")


def oracle() -> str:
    """DuckDB SQL for `op8_mixing`."""
    weights = ", ".join(map(str, WEIGHTS))
    by_name = "source is null, source"
    return rf"""
with d as (select row_number() over () as rid, doc_id, source,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [{weights}][(row_number() over (order by {by_name}) - 1) % {len(WEIGHTS)} + 1]::double as weight from s),
l as (select *, (sum(source_size) over () - {MAX_REPEAT} * coalesce(sum(source_size) over (
                 order by source_size / weight, {by_name} rows between unbounded preceding and 1 preceding), 0))::double
                / sum(weight) over (order by source_size / weight, {by_name} rows between current row and unbounded following) as level from w),
f as (select *, min(({MAX_REPEAT} * source_size <= level * weight)::int) over (order by source_size / weight, {by_name}
                 rows between unbounded preceding and current row) = 1 as full_up from l),
t as (select source, source_size, case when full_up then ({MAX_REPEAT} * source_size)::double
             else (select min_by(level, (source_size / weight, source is null, source)) from f where not full_up) * weight end as target from f),
c as (select greatest(1, cast(ceil(sum(source_size) / {SLOTS}.0) as bigint)) as block, sum(source_size)::bigint as total from s),
e as (select source, least(floor(sum(target) over (order by {by_name} rows between unbounded preceding and current row)
             / sum(target) over () * {POINTS}), {POINTS})::bigint as stop from t where target > 0),
g as (select source, coalesce(lag(stop) over (order by {by_name}), 0) as start, stop from e),
p as (select slot, ((slot + 1) * {GOLDEN}) % {POINTS} as point from c, range(cast(ceil(total / block::double) as bigint)) r(slot)),
k as (select slot, source, row_number() over (partition by source order by slot) - 1 as rank from p join g on point >= start and point < stop),
r as (select source, count(*) as slots from k group by source),
m as (select t.source, source_size, target, coalesce(slots, 0) as slots,
             least(round(target)::bigint, {MAX_REPEAT} * source_size)::bigint as readw
      from t left join r on t.source is not distinct from r.source),
o as (select *, coalesce(sum(size) over (partition by source order by md5(coalesce(doc_id::varchar, '') || ':{SEED}'), size
             rows between unbounded preceding and 1 preceding), 0)::bigint as place from d),
x as (select doc_id, size, o.source, source_size, target, slots,
             case when readw > 0 and slots > 0 then ((place + 1) * slots - 1) // readw end as rank,
             (readw // greatest(source_size, 1)) * size
             + greatest(0, least(size, readw % greatest(source_size, 1) - place)) as taken from o join m on o.source is not distinct from m.source),
n as (select *, ('0x' || substr(md5(coalesce('=' || source, '')), 1, 8))::bigint % greatest(1, (select cast(ceil(total / block::double) as bigint) from c)) as picked from x)
select doc_id, size, source_size, target, taken::bigint as taken,
       coalesce(slot, case when taken > 0 and slots = 0 then picked end) as first_slot
from n left join k on taken > 0 and n.source is not distinct from k.source and k.rank = n.rank
"""
