"""Views of the driver's tables in the shape of sequence data, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def seconds(ts: str) -> Column:
    """Seconds since 1970 of a timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def days(ts: str) -> Column:
    return F.floor(seconds(ts) / 86400)


def dna(spark: SparkSession, d: str) -> DataFrame:
    # whole runs of other characters go at once; what is left is plain letters, which upper() turns quickly
    seq = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^ACGTacgt]+", ""))
    return table(spark, d, "documents").select("doc_id", seq.alias("seq"))


def pair(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("seq")
    rep = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    return dna(spark, d).filter("seq <> ''").select("doc_id", rep(s, "CAT", "C-T").alias("seq_text"), rep(rep(s, "GG", "Gc"), "TG", "T-").alias("motif_text"))


def iv(spark: SparkSession, d: str) -> DataFrame:
    start = seconds("ts")
    end = start + F.greatest(F.lit(1), F.floor("value")) * 600
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("seq"), start.alias("start"), end.alias("end"), F.col("event_type").alias("motif"))


def observed(spark: SparkSession, d: str) -> DataFrame:
    start = days("l_shipdate")
    return table(spark, d, "lineitem").select((F.col("l_orderkey") % 100).cast("string").alias("seq"), start.alias("start"), (start + 2).alias("end"))


def truth_raw(spark: SparkSession, d: str) -> DataFrame:
    start = days("o_orderdate")
    return table(spark, d, "orders").select((F.col("o_orderkey") % 100).cast("string").alias("seq"), start.alias("start"), (start + 3).alias("end"))


def lengths(spark: SparkSession, d: str) -> DataFrame:
    return dna(spark, d).select("doc_id", F.length("seq").alias("length"))


def alignments(spark: SparkSession, d: str) -> DataFrame:
    """Summary-like rows made from line items: counts of events and a place on a sequence."""
    start = (F.col("l_orderkey") * 97 + F.col("l_linenumber") * 13) % 100_000
    m, mm = (F.col("l_quantity") * 20).cast("int"), F.col("l_linenumber")
    i, dd = (F.col("l_discount") * 300).cast("int"), (F.col("l_tax") * 300).cast("int")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("seq_ordinal"), F.col("l_linenumber").alias("emit_ordinal"), F.concat(F.lit("read_"), F.col("l_suppkey").cast("string")).alias("name"),
        F.col("l_returnflag").alias("motif"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"), F.lit(100_000).alias("seq_len"),
        start.alias("start"), (start + m + mm + i).alias("end"), (m + mm + dd).alias("motif_bases"), m.alias("m"), mm.alias("mm"), i.alias("i"), dd.alias("d"),
    )


DNA = "dna as (select doc_id, regexp_replace(translate(coalesce(text, ''), 'acgt', 'ACGT'), '[^ACGT]', '', 'g') as seq from documents)"
PAIR = DNA + """,
pair as (select doc_id, replace(seq, 'CAT', 'C-T') as seq_text,
         replace(replace(seq, 'GG', 'Gc'), 'TG', 'T-') as motif_text from dna where seq <> '')"""
KINDS = PAIR + """,
kinds as (select doc_id, seq_text, motif_text, list_aggregate(list_transform(range(1, length(seq_text) + 1), lambda k:
          case when motif_text[k] = '-' then 'i' when seq_text[k] = '-' then 'd' when motif_text[k] = seq_text[k] then '=' else 'x' end),
          'string_agg', '') as kinds from pair),
ev as (select *, length(replace(kinds, '=', '')) as bad from kinds),
counts as (select doc_id, seq_text, motif_text, kinds,
          (length(kinds) - bad)::bigint as m, (length(kinds) - length(replace(kinds, 'x', '')))::bigint as mm,
          len(regexp_extract_all(kinds, 'i+'))::bigint as io,
          (length(kinds) - length(replace(kinds, 'i', '')) - len(regexp_extract_all(kinds, 'i+')))::bigint as ix,
          len(regexp_extract_all(kinds, 'd+'))::bigint as "do",
          (length(kinds) - length(replace(kinds, 'd', '')) - len(regexp_extract_all(kinds, 'd+')))::bigint as dx from ev)"""
IV = """iv as (select user_id::varchar as seq, epoch_us(ts) // 1000000 as "start",
        epoch_us(ts) // 1000000 + greatest(1, cast(floor(value) as bigint)) * 600 as "end", event_type as motif from events)"""
OBSERVED = """observed as (select (l_orderkey % 100)::varchar as seq, epoch_us(l_shipdate) // 86400000000 as "start",
        epoch_us(l_shipdate) // 86400000000 + 2 as "end" from lineitem)"""
TRUTH = """truth_raw as (select (o_orderkey % 100)::varchar as seq, epoch_us(o_orderdate) // 86400000000 as "start",
        epoch_us(o_orderdate) // 86400000000 + 3 as "end" from orders)"""
ALIGNMENTS = """alignments as (select l_orderkey as seq_ordinal, l_linenumber as emit_ordinal, 'read_' || l_suppkey as name, l_returnflag as motif,
        case when l_linestatus = 'O' then '+' else '-' end as strand, 100000 as seq_len, (l_orderkey * 97 + l_linenumber * 13) % 100000 as "start",
        (l_orderkey * 97 + l_linenumber * 13) % 100000 + trunc(l_quantity * 20)::int + l_linenumber + trunc(l_discount * 300)::int as "end",
        trunc(l_quantity * 20)::int + l_linenumber + trunc(l_tax * 300)::int as motif_bases,
        trunc(l_quantity * 20)::int as m, l_linenumber as mm, trunc(l_discount * 300)::int as i, trunc(l_tax * 300)::int as d from lineitem)"""


def islands(source: str, name: str, touching: bool) -> str:
    """CTEs that give the rows of source (seq, start, end, ...) the number `island` of their group, and `reach`."""
    op = ">" if touching else ">="
    return f"""{name}_r as (select *, max("end") over (partition by seq order by "start", "end" rows between unbounded preceding and 1 preceding) as reach from {source}),
{name}_o as (select *, case when reach is null or "start" {op} reach then 1 else 0 end as opens from {name}_r),
{name} as (select *, sum(opens) over (partition by seq order by "start", "end", opens desc rows between unbounded preceding and current row) as island from {name}_o)"""


def merged(source: str, name: str) -> str:
    return islands(source, f"{name}_i", True) + f""",
{name} as (select seq, min("start") as "start", max("end") as "end" from {name}_i group by seq, island)"""
