"""Writers: formats as column expressions, and functions that write them with Spark's text writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dna

#: Field widths of a block's name, sequence length, base counts and range, and the marker's default text.
WIDTHS = {"name": 1, "length": 1, "count": 1, "range": 1}
MARKER = "# repeats end-of-file"


def _padded(text: Column, width: Column) -> Column:
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(width - F.length(text), F.lit(0)).cast("int")))


def block_text(
    name: Column, seq_len: Column, start: Column, end: Column, seq_bases: Column, motif_name: Column, strand: Column, motif_bases: Column, score: Column,
    seq_text: Column, motif_text: Column, counts: tuple[Column, Column, Column, Column], stats: bool = False, widths: dict[str, int] = WIDTHS,
) -> Column:
    """An alignment as a block of two lines, three with statistics, with its fields aligned."""
    length = F.coalesce(seq_len.cast("string"), F.lit("?"))
    own, motif = name, F.concat(motif_name, strand)
    seq_count, motif_count = F.concat(seq_bases.cast("string"), F.lit("bp")), F.concat(motif_bases.cast("string"), F.lit("bp"))
    place, points = F.concat_ws("-", start.cast("string"), end.cast("string")), F.concat(F.lit("score="), score.cast("string"))
    m, mm, i, d = counts
    ratio = dna.percent_text(m / (m + mm + i + d))
    text = F.format_string("# score=%d querybp=%d mRatio=%s m=%d mm=%d i=%d d=%d", score, motif_bases, ratio, m, mm, i, d)
    length_w = F.greatest(F.lit(widths["length"]), F.length(length))
    count_w = F.greatest(F.lit(widths["count"]), F.length(seq_count), F.length(motif_count))
    range_w = F.greatest(F.lit(widths["range"]), F.length(place), F.length(points))
    name_w = F.greatest(F.lit(widths["name"]), F.length(own), F.length(motif))
    if stats:
        name_w = F.greatest(name_w, F.length(text) - (length_w + count_w + range_w + 3))
    line = lambda *cells: F.concat_ws(" ", *cells)
    rows = [
        line(_padded(own, name_w), _padded(length, length_w), _padded(seq_count, count_w), _padded(place, range_w), seq_text),
        line(_padded(motif, name_w), _padded(F.lit(""), length_w), _padded(motif_count, count_w), _padded(points, range_w), motif_text),
    ]
    if stats:
        rows.insert(0, line(_padded(text, name_w + length_w + count_w + range_w + 3), dna.match_mask(seq_text, motif_text)))
    return F.concat_ws("\n", *rows)


def blocks(alignments: DataFrame, stats: bool = False) -> DataFrame:
    """alignments with `block`, their text."""
    c = F.col
    text = block_text(
        c("name"), c("seq_len"), c("start"), c("end"), c("seq_bases"), c("motif_name"), c("strand"), c("motif_bases"), c("score"), c("seq_text"), c("motif_text"),
        (c("m"), c("mm"), c("i"), c("d")), stats,
    )
    return alignments.withColumn("block", text)


def position_lines(positional: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lines): the lines of positional events of each alignment, in order of position."""
    total = F.col("m") + F.col("mm") + F.col("i") + F.col("d")
    text = F.format_string(
        "# position %d [%s] mRatio=%s m=%d mm=%d i=%d d=%d mmA=%d mmC=%d mmG=%d mmT=%d x=%d",
        "pos", "nuc", F.when(total > 0, dna.percent_text(F.col("m") / total)).otherwise("0.0%"), "m", "mm", "i", "d", "mm_a", "mm_c", "mm_g", "mm_t", total - F.col("m"),
    )
    return positional.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", text.alias("t")))), lambda x: x["t"]).alias("lines"))


def show_forward(alignments: DataFrame) -> DataFrame:
    """Alignments on the reverse strand turned to the sequence's forward strand, their start and end swapped."""
    back = F.col("strand") == "-"
    turned = {x: F.when(back, dna.reverse_complement(F.col(x))).otherwise(F.col(x)) for x in ("seq_text", "motif_text")}
    return alignments.withColumns(turned | {"start": F.when(back, F.col("end")).otherwise(F.col("start")), "end": F.when(back, F.col("start")).otherwise(F.col("end"))})


def write_blocks(alignments: DataFrame, path: str, order: list, stats: bool = False, marker: str = MARKER) -> None:
    """Blocks in order with blank lines between them, in files that sort by name; the marker is the last file's last line.

    Files sorted by name and joined are one file of blocks. To read them each on its own, `read_blocks` takes them
    with require_end=False; with require_end it takes the folder's files as one file (whole=True).
    """
    spark = alignments.sparkSession
    ordered = blocks(alignments, stats).orderBy(*order).select(F.concat("block", F.lit("\n")).alias("value"))
    # a row after all others: a union keeps the sorted partitions, and adds the marker's as the last
    last = spark.createDataFrame([(marker,)], "value string").coalesce(1)
    ordered.unionByName(last).write.mode("append").text(path)


def summary_with_consensus(summaries: DataFrame) -> DataFrame:
    """Summary columns with the consensus in place of the last five; (missing) where there is none."""
    return summaries.select("motif", "seq", "start", "end", "strand", "seq_len", "query_bp", F.coalesce("consensus", F.lit("(missing)")).alias("consensus"))


def tsv_value(columns: list[Column], missing: str = "NA") -> Column:
    return F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit(missing)) for c in columns])


def tsv(df: DataFrame, missing: str = "NA") -> DataFrame:
    """(value): the columns parted by tabs, nulls as `missing`."""
    return df.select(tsv_value([F.col(f"`{c}`") for c in df.columns], missing).alias("value"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("nullValue", "NA").option("header", "true").csv(path)


def write_by_motif(resolved: DataFrame, path: str) -> None:
    """Rows (value, motif, singleton) into a folder for each motif, and those of mixed groups into `overlaps`."""
    where = F.when(F.col("singleton"), F.col("motif")).otherwise("overlaps")
    resolved.select("value", where.alias("group")).write.mode("overwrite").partitionBy("group").text(path)


def fasta(name: Column, nt: Column, wrap: int | None = 100) -> Column:
    """A FASTA record; wrap None writes one line."""
    body = nt if wrap is None else F.btrim(F.regexp_replace(nt, f"(.{{{wrap}}})", "$1\n"), F.lit("\n"))
    return F.concat(F.lit(">"), name, F.lit("\n"), body)


def fastq(name: Column, nt: Column, quality: str = "I") -> Column:
    return F.concat(F.lit("@"), name, F.lit("\n"), nt, F.lit("\n+\n"), F.repeat(F.lit(quality), F.length(nt)))


def sam_header(chromosomes: DataFrame) -> DataFrame:
    """(value) of chromosomes (name, length)."""
    return chromosomes.select(F.format_string("@SQ\tSN:%s\tLN:%d", "name", "length").alias("value"))


def sam_row(read: Column, seq: Column, strand: Column, start: Column, cigar: Column, nt: Column, quality: str = "I") -> Column:
    flag = F.when(strand == "-", "16").otherwise("0")
    text = F.when(strand == "-", dna.reverse_complement(nt)).otherwise(nt)
    return F.concat_ws("\t", read, flag, seq, (start + 1).cast("string"), F.lit("255"), cigar, F.lit("*"), F.lit("0"), F.lit("0"), text, F.repeat(F.lit(quality), F.length(nt)))


def cigar_row(read: Column, seq: Column, strand: Column, start: Column, end: Column, cigar: Column) -> Column:
    return F.concat_ws(" ", read, F.concat(seq, strand), start.cast("string"), end.cast("string"), cigar)


def catalog_rows(catalog: DataFrame, errors: bool = False) -> DataFrame:
    """Catalog columns as text would have them: 7, or 12 with the events and their match ratio."""
    base = ["seq", "start", "end", "motif", "rpt_len", "len", "fill"]
    if not errors:
        return catalog.select(*base)
    total = F.col("m") + F.col("mm") + F.col("i") + F.col("d")
    return catalog.select(*base, F.when(total > 0, dna.percent_text(F.col("m") / total)).alias("m_ratio"), "m", "mm", "i", "d")


def excised(alignments: DataFrame) -> DataFrame:
    """The clumps that debridging cut out, of alignments made with excised=True."""
    return alignments.filter("excised")


