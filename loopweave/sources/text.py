"""Readers of text formats, through Spark's own text source, and their parsers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dna
from ..operators.durable import few

#: IUPAC codes that become N, and how the marker line at the end of a file of alignment blocks looks.
IUPAC_TO_N = ("SWRYMKBDHVswrymkbdhv", "NNNNNNNNNNnnnnnnnnnn")
END_MARKER = r"^# \S+ end-of-file\s*$"


def read_fasta(
    spark: SparkSession, path: str | list[str], upper: bool = True, strict: bool = True, full_name: bool = False,
    names: list[str] | None = None, skip: int | None = None, head: int | None = None,
) -> DataFrame:
    """(file, seq_ordinal, name, nt) of FASTA files, whose records Spark splits at '\\n>', a large file in many tasks.

    The name is the header's first word, or with full_name the whole header, (no_name) if it is empty; bases before any
    header are a sequence named after its ordinal. IUPAC codes become N; with strict any other character, also a space,
    a carriage return or a > inside a line, is an error, and so is a header that the file ends in. Ordinals count in a
    file from 1 in the order of records.

    names, skip, head: records of these names, from the ordinal skip on, up to the ordinal head. They are told by
    header and ordinal, so the bases of others are neither checked nor decoded.

    Two passes: the first counts the records of each split of each file, the second gives each record its split's
    offset, so bases are never moved or sorted. The table of splits is broadcast if it is measured to be small.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split")]
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", *place, F.monotonically_increasing_id().alias("_id"))
    splits = raw.groupBy("file", "_split").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    line = Window.partitionBy("file").orderBy("_split")
    ahead = F.coalesce(F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select(F.col("file").alias("_f"), F.col("_split").alias("_s"), "_first", ahead.alias("_ahead"), F.sum("_n").over(Window.partitionBy("file")).alias("_of"))
    rows = raw.join(few(splits), (F.col("file") == F.col("_f")) & (F.col("_split") == F.col("_s")))
    rows = rows.select("file", "value", "_of", (F.col("_ahead") + F.col("_id") - F.col("_first") + 1).alias("seq_ordinal"))
    value = F.col("value")
    marked = value.startswith(">")
    unnamed = (F.col("seq_ordinal") == 1) & ~marked
    headed = F.when(marked, F.substr(value, F.lit(2))).otherwise(value)
    header = F.when(unnamed, F.lit("")).otherwise(F.substring_index(headed, "\n", 1))
    name = F.btrim(header) if full_name else F.regexp_extract(header, r"^\s*(\S+)", 1)
    unknown = F.lit("(no_name)") if full_name else F.concat(F.lit("sequence"), F.col("seq_ordinal").cast("string"))
    rows = rows.filter(F.length("value") > 0).withColumn("name", F.when(name == "", unknown).otherwise(name))
    if names is not None:
        rows = rows.filter(F.col("name").isin(names))
    if skip is not None:
        rows = rows.filter(F.col("seq_ordinal") >= skip)
    if head is not None:
        rows = rows.filter(F.col("seq_ordinal") <= head)
    body = F.when(unnamed, value).otherwise(F.when(F.instr(headed, "\n") > 0, F.substr(headed, F.instr(headed, "\n") + 1)).otherwise(""))
    nt = F.translate(F.regexp_replace(body, "\n", ""), *IUPAC_TO_N)
    if strict:
        nt = F.when(nt.rlike("[^ACGTNacgtn]"), F.raise_error(F.concat(F.lit("bad character in sequence of "), F.col("file")))).otherwise(nt)
        cut_off = (F.col("seq_ordinal") == F.col("_of")) & ~unnamed & (F.instr(headed, "\n") == 0)
        nt = F.when(cut_off, F.raise_error(F.concat(F.lit("the file ends in a header: "), F.col("file")))).otherwise(nt)
    return rows.select("file", "seq_ordinal", "name", (F.upper(nt) if upper else nt).alias("nt"))


def write_fasta(sequences: DataFrame, folder: str, wrap: int = 60) -> None:
    """Sequences (name, nt) as FASTA files of a folder, one for each task."""
    from .sinks import fasta

    sequences.select(fasta(F.col("name"), F.col("nt"), wrap).alias("value")).write.text(folder)


def fasta_lengths(sequences: DataFrame) -> DataFrame:
    return sequences.select("name", F.length("nt").alias("length"))


def both_strands(sequences: DataFrame, strands: str = "both") -> DataFrame:
    """Sequences with `strand`: as they are, reverse-complemented, or both one after the other."""
    forward = F.struct(F.lit("+").alias("strand"), F.col("nt").alias("nt"))
    reverse = F.struct(F.lit("-").alias("strand"), dna.reverse_complement(F.col("nt")).alias("nt"))
    wanted = {"forward": [forward], "reverse": [reverse], "both": [forward, reverse]}[strands]
    return sequences.withColumn("_s", F.explode(F.array(*wanted))).withColumn("nt", F.col("_s.nt")).withColumn("strand", F.col("_s.strand")).drop("_s")


def named(sequences: DataFrame, names: list[str]) -> DataFrame:
    return sequences.filter(F.col("name").isin(names))


def positional_stats(blocks: DataFrame) -> DataFrame:
    """blocks with `positional`: array of struct(pos, nuc, stats map) from their position lines; a gap in positions is an error."""
    lines = F.filter("extra_lines", lambda x: x.rlike(r"^# position \d+"))
    parsed = F.transform(
        lines,
        lambda x: F.struct(
            F.regexp_extract(x, r"^# position (\d+)", 1).cast("int").alias("pos"),
            F.regexp_extract(x, r"\[(\w)\]", 1).alias("nuc"),
            F.transform_values(
                F.map_from_entries(F.transform(F.regexp_extract_all(x, F.lit(r"(\S+=\S+)"), F.lit(1)), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.substring_index(p, "=", -1).alias("v")))),
                lambda _, v: F.regexp_replace(v, "%$", "").cast("double"),
            ).alias("stats"),
        ),
    )
    broken = F.exists(F.transform(parsed, lambda p, k: p["pos"] != k), lambda b: b)
    return blocks.withColumn("positional", F.when(broken, F.raise_error(F.lit("positions out of order")).cast("array<struct<pos:int,nuc:string,stats:map<string,double>>>")).otherwise(parsed))


def concat_check(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, markers): how many end markers each file has."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").rlike(END_MARKER).cast("int").alias("marker"))
    return lines.groupBy("file").agg(F.sum("marker").cast("long").alias("markers"))


def concatenate(spark: SparkSession, paths: list[str], marker: str, tolerant: bool = False) -> DataFrame:
    """(value): the lines of several files of blocks one file after the other, without their markers, and one at the end.

    Each file, plain or compressed, must end with a marker; tolerant takes one without. Text after a marker is an
    error. Lines keep their order within a file, files that of `paths`.
    """
    def one(number: int, path: str) -> DataFrame:
        lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
        return lines.select("value", F.lit(number).alias("number"), "at", F.col("value").rlike(END_MARKER).alias("mark"))

    lines = reduce(DataFrame.unionByName, [one(k, p) for k, p in enumerate(paths)])
    text_at = F.max(F.when(~F.col("mark") & (F.trim("value") != ""), F.col("at")))
    ends = lines.groupBy("number").agg(F.min(F.when(F.col("mark"), F.col("at"))).alias("end"), text_at.alias("text"))
    wrong = F.when(F.col("end") < F.col("text"), F.raise_error(F.lit("text after the end marker")).cast("boolean"))
    missing = F.when(F.col("end").isNull() & ~F.lit(tolerant), F.raise_error(F.lit("the end marker is missing")).cast("boolean"))
    checked = ends.select(F.col("number").alias("_n"), F.coalesce(wrong, missing, F.lit(True)).alias("ok"))
    # a row for each file
    kept = lines.join(F.broadcast(checked), F.col("number") == F.col("_n")).filter("ok and not mark")
    last = spark.createDataFrame([(marker, len(paths), 0)], "value string, number int, at long")
    return kept.select("value", "number", "at").unionByName(last).orderBy("number", "at").select("value")


def fields_of(lines: DataFrame) -> DataFrame:
    """Lines (value) that are not blank nor comments, with `f`, their fields between white space."""
    return lines.filter(~F.col("value").rlike(r"^\s*(#|$)")).withColumn("f", F.split(F.trim("value"), r"\s+"))


def _field(k: int, kind: str = "string") -> Column:
    return F.get("f", k).cast(kind)


def parse_summary(lines: DataFrame) -> DataFrame:
    """(motif, seq, start, end, value) of summary lines: five columns or more; an end before its start is an error."""
    out = fields_of(lines).filter("lower(f[0]) <> 'line'")
    short = F.when(F.size("f") < 5, F.raise_error(F.concat(F.lit("short line: "), F.col("value"))))
    start, end = _field(3, "long"), _field(4, "long")
    checked = F.when(end < start, F.raise_error(F.concat(F.lit("end before start: "), F.col("value"))).cast("long")).otherwise(end)
    return out.select(F.coalesce(short, _field(1)).alias("motif"), _field(2).alias("seq"), start.alias("start"), checked.alias("end"), "value")


def read_summary(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_summary(spark.read.text(path))


def parse_summary_table(lines: DataFrame, motif: str | None = None) -> DataFrame:
    """All 13 columns of summary lines, m_ratio as a ratio, of one motif if given."""
    names = ("line", "motif", "seq", "start", "end", "strand", "seq_len", "query_bp", "m_ratio", "m", "mm", "i", "d")
    out = fields_of(lines).filter("lower(f[0]) <> 'line'")
    text = {"motif", "seq", "strand"}
    cell = lambda k, n: _field(k) if n in text else dna.percent_value(_field(k)) if n == "m_ratio" else F.when(_field(k) != "NA", _field(k)).cast("long")
    out = out.select(*[cell(k, n).alias(n) for k, n in enumerate(names)])
    return out if motif is None else out.filter(F.col("motif") == motif)


def parse_intervals(lines: DataFrame, columns: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """(seq, start, end, tags[, width]) by column numbers of name, start and end; further columns are tags."""
    own = list(columns)
    rest = F.transform(F.filter(F.transform("f", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: ~p["i"].isin(own)), lambda p: p["x"])
    return fields_of(lines).select(_field(own[0]).alias("seq"), _field(own[1], "long").alias("start"), _field(own[2], "long").alias("end"), rest.alias("tags"), F.size("f").alias("width"))


def same_width(intervals: DataFrame) -> DataFrame:
    """One row (ok): whether all lines have equally many columns."""
    return intervals.agg((F.coalesce(F.min("width") == F.max("width"), F.lit(True))).alias("ok"))


def parse_cigars(lines: DataFrame) -> DataFrame:
    """(read, seq, strand, g_start, g_end, cigar) of lines read, chrom[+-], start, end, cigar; blanks in cigars go.

    A cigar with other operations than M, I and D, or with a count of 0, is an error.
    """
    cigar = F.array_join(F.slice("f", 5, F.greatest(F.size("f") - 4, F.lit(0))), "")
    parts = dna.stranded_motif(_field(1))
    checked = F.when(dna.is_cigar(cigar), cigar).otherwise(F.raise_error(F.concat(F.lit("bad cigar: "), F.col("value"))))
    return fields_of(lines).select(_field(0).alias("read"), parts["motif"].alias("seq"), parts["strand"].alias("strand"), _field(2, "long").alias("g_start"), _field(3, "long").alias("g_end"), checked.alias("cigar"))


def parse_sam(lines: DataFrame, min_quality: int = 0) -> DataFrame:
    """(read, ref, quality, cigar, md) of mapped SAM lines of at least a mapping quality; exactly one MD tag is required."""
    out = lines.filter(~F.col("value").startswith("@") & (F.length(F.trim("value")) > 0)).withColumn("f", F.split("value", "\t"))
    # every line passes the check of its width before any of its fields is looked at
    short = F.raise_error(F.concat(F.lit("short line: "), F.col("value"))).cast("boolean")
    out = out.filter(F.when(F.size("f") < 11, short).otherwise((F.get("f", 2) != "*") & (_field(4, "int") >= min_quality)))
    tags = F.filter("f", lambda x: x.startswith("MD:"))
    md = F.when(F.size(tags) != 1, F.raise_error(F.concat(F.lit("not one MD tag: "), F.col("value")))).otherwise(F.substring_index(F.get(tags, 0), ":", -1))
    return out.select(_field(0).alias("read"), _field(2).alias("ref"), _field(4, "int").alias("quality"), _field(5).alias("cigar"), md.alias("md"))


#: The first twelve columns of a PAF line.
PAF = ("query", "query_len", "query_start", "query_end", "strand", "target", "target_len", "target_start", "target_end", "matches", "block_len", "quality")


def parse_paf(lines: DataFrame, min_quality: int = 0) -> DataFrame:
    """The columns of PAF, and `tags` from tag to value; fewer than 12 columns or a tag twice is an error."""
    out = lines.filter(F.length(F.trim("value")) > 0).withColumn("f", F.split("value", "\t"))
    entries = F.transform(F.slice("f", 13, F.greatest(F.size("f") - 12, F.lit(0))), lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), F.regexp_extract(x, "^[^:]*:[^:]*:(.*)$", 1).alias("v")))
    bad = (F.size("f") < 12) | (F.size(F.array_distinct(F.transform(entries, lambda e: e["k"]))) != F.size(entries))
    tags = F.when(bad, F.raise_error(F.concat(F.lit("bad line: "), F.col("value"))).cast("map<string,string>")).otherwise(F.map_from_entries(entries))
    text = {"query", "strand", "target"}
    cells = [_field(k, "string" if n in text else "long").alias(n) for k, n in enumerate(PAF)]
    return out.select(*cells, tags.alias("tags")).filter(F.col("quality") >= min_quality)


def parse_distribution(lines: DataFrame) -> DataFrame:
    """(lo, hi, n) of lines interval and count; an interval is a number or two joined by a dash."""
    return fields_of(lines).select(*_interval(_field(0)), _field(1, "long").alias("n"))


def parse_spec(lines: DataFrame) -> DataFrame:
    """(lo, hi, out_count, in_count) of a distribution's specification; wanting more than there are is an error."""
    out, there = _field(1, "long"), _field(2, "long")
    checked = F.when(out > there, F.raise_error(F.concat(F.lit("more wanted than there are: "), F.col("value"))).cast("long")).otherwise(out)
    return fields_of(lines).select(*_interval(_field(0)), checked.alias("out_count"), there.alias("in_count"))


def _interval(text: Column) -> list[Column]:
    return [F.substring_index(text, "-", 1).cast("long").alias("lo"), F.substring_index(text, "-", -1).cast("long").alias("hi")]


def parse_arrays(lines: DataFrame) -> DataFrame:
    """(length, motif, strand) of lines length and motif, which may end with its strand."""
    parts = dna.stranded_motif(_field(1))
    return fields_of(lines).select(_field(0, "long").alias("length"), parts["motif"].alias("motif"), parts["strand"].alias("strand"))


def parse_integers(lines: DataFrame) -> DataFrame:
    return fields_of(lines).select(_field(0, "long").alias("n"))
