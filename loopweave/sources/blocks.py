"""Reader of alignment blocks: files are read in splits, and blocks that lie across splits are put together again."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.durable import few, settle
from .text import END_MARKER, concat_check

BLOCK_SCHEMA = (
    "file string, line_number bigint, name string, seq_len int, seq_bases int, start int, end int, seq_text string, motif string, strand string, motif_bases int, "
    "score int, motif_text string, m int, mm int, i int, d int, m_ratio_text string, error_text string, extra_lines array<string>"
)
_PIECE = "file string, split bigint, first bigint, lines array<string>, head boolean, tail boolean"
_FACTS = "file string, split bigint, n bigint, beginning array<string>, open boolean, solid boolean, marker bigint, after bigint, text bigint"
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


class _Split:
    """One split of a file while its lines go by; lines count from 1 in it.

    A piece is a run of lines that are not blank and no marker. The first is the head if it starts with the split, the
    last the tail if it ends with it: the block may go on in the split before or after.
    """

    def __init__(self, file: str, split: int):
        self.file, self.split, self.n = file, split, 0
        self.block: list[str] = []
        self.first = 0
        self.beginning: list[str] | None = None
        self.solid = False
        self.marker = self.after = self.text = None

    def take(self, line: str) -> tuple | None:
        """A piece that this line ends, if it ends one."""
        self.n += 1
        if not line.strip():
            return self.piece(False)
        self.text = self.text or self.n
        if self.marker:
            self.after = self.after or self.n
        if re.match(END_MARKER, line):
            self.marker = self.marker or self.n
            return self.piece(False)
        self.first = self.first if self.block else self.n
        self.block.append(line)
        return None

    def piece(self, tail: bool) -> tuple | None:
        if not self.block:
            return None
        block, self.block = self.block, []
        head = self.first == 1
        if head:
            self.beginning, self.solid = block, tail
        return (self.file, self.split, self.first, block, head, tail)

    def facts(self, last: tuple | None) -> tuple:
        return (self.file, self.split, self.n, self.beginning, last is not None, self.solid, self.marker, self.after, self.text)


def _scanned(raw: DataFrame, facts: bool) -> DataFrame:
    """The pieces of each split, or with facts a row for each split. raw: (file, split, value) in the order of files."""
    schema = _FACTS if facts else _PIECE
    fields = [f.split() for f in schema.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(list(c), _ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: _Split | None = None

        def ended() -> list[tuple]:
            last = at.piece(True)
            return [at.facts(last)] if facts else [last] if last else []

        for b in batches:
            rows: list[tuple] = []
            for file, split, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at is None or (file, split) != (at.file, at.split):
                    rows += ended() if at else []
                    at = _Split(file, split)
                done = at.take(line)
                if done and not facts:
                    rows.append(done)
            yield batch(rows)
        if at:
            yield batch(ended())

    return raw.mapInArrow(run, schema)


def read_blocks(spark: SparkSession, path: str | list[str], require_end: bool = True, whole: bool = False) -> DataFrame:
    """Alignment blocks (BLOCK_SCHEMA) of files, plain or compressed, a large plain file in many tasks.

    A block is an optional line of statistics, a sequence and a motif line; other lines that start with # stay with
    it; blank lines part blocks. Text after the end marker, a missing marker where it is required, or a short block is an
    error; Spark passes over files without a byte. whole: the files of a folder, as `write_blocks` leaves them, are parts of one:
    the marker must be the last line of the last file and of no other.

    Two passes, no exchange of the text. The first notes for each split how many lines it has, where markers are, and
    the lines before its first blank line. From this table follow the lines ahead of each split, and for a block that
    goes beyond its split the lines that it has in the next ones. The second pass makes the blocks.
    """
    if whole:
        marks = concat_check(spark, path).agg(F.sum("markers").alias("n"), F.max_by("markers", "file").alias("last")).first()
        if require_end and (marks["n"], marks["last"]) != (1, 1):
            raise ValueError(f"{path}: the end marker is missing, or not in the last file alone")
        require_end = False
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")]
    raw = spark.read.option("lineSep", "\n").text(path).select(*place, "value")
    facts = _numbered(settle(_scanned(raw, True)))
    _check_markers(facts, require_end)
    pieces = _scanned(raw, False).join(few(_places(facts)), (F.col("file") == F.col("_f")) & (F.col("split") == F.col("_s")))
    pieces = pieces.filter(~(F.col("head") & F.col("carried")))
    lines = F.when(F.col("tail") & F.col("more").isNotNull(), F.concat("lines", "more")).otherwise(F.col("lines"))
    return parsed(pieces.select("file", (F.col("ahead") + F.col("first")).alias("line_number"), lines.alias("lines")))


def _numbered(facts: DataFrame) -> DataFrame:
    """facts with `ahead`, the lines of the file before the split."""
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return facts.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))


def _check_markers(facts: DataFrame, require_end: bool) -> None:
    """ValueError for the first file with text after its marker, or without a marker if one is required."""
    marked = F.min(F.col("ahead") + F.col("marker")).over(Window.partitionBy("file"))
    late = F.when(F.col("ahead") >= F.col("marked"), F.col("ahead") + F.col("text")).when(F.col("ahead") + F.col("n") >= F.col("marked"), F.col("ahead") + F.col("after"))
    files = facts.withColumn("marked", marked).withColumn("late", late).groupBy("file").agg(F.min("late").alias("late"), F.max("marked").alias("marked"))
    wrong = files.filter("late is not null").orderBy("file").first()
    if wrong:
        raise ValueError(f"{wrong['file']}: text after the end marker, in line {wrong['late']}")
    bare = files.filter("marked is null").orderBy("file").first() if require_end else None
    if bare:
        raise ValueError(f"{bare['file']}: the end marker is missing")


def _places(facts: DataFrame) -> DataFrame:
    """(_f, _s, ahead, carried, more): whether a split's head belongs to a block of the split before, and the lines that
    its tail has in the next splits."""
    line = Window.partitionBy("file").orderBy("split")
    carried = F.col("beginning").isNotNull() & F.coalesce(F.lag("open").over(line), F.lit(False))
    at = facts.withColumn("carried", carried)
    owner = F.when(~(F.col("carried") & F.col("solid")), F.col("split"))
    at = at.withColumn("owner", F.last(owner, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)))
    parts = F.array_sort(F.collect_list(F.struct("split", "beginning")))
    more = at.filter("carried").groupBy(F.col("file").alias("_mf"), F.col("owner").alias("_ms")).agg(F.flatten(F.transform(parts, lambda x: x["beginning"])).alias("more"))
    joined = at.join(more, (F.col("file") == F.col("_mf")) & (F.col("split") == F.col("_ms")), "left")
    return joined.select(F.col("file").alias("_f"), F.col("split").alias("_s"), "ahead", "carried", "more")


def parsed(blocks: DataFrame) -> DataFrame:
    """(file, line_number, lines) of blocks as BLOCK_SCHEMA, by built-in expressions; a malformed one is an error."""
    words = lambda x: F.regexp_extract_all(x, F.lit(r"(\S+)"), F.lit(1))
    opening = F.get("lines", F.lit(0))
    stats = F.when(opening.startswith("#") & opening.contains("score="), opening).otherwise("")
    texts = F.filter("lines", lambda x: ~x.startswith("#"))
    rows = blocks.select(
        "file", "line_number", stats.alias("_stats"), F.size(texts).alias("_n"), words(F.get(texts, F.lit(0))).alias("_seq"), words(F.get(texts, F.lit(1))).alias("_motif"),
        F.filter("lines", lambda x, k: x.startswith("#") & ((k > 0) | (stats == ""))).alias("extra_lines"),
    )
    fault = lambda kind: F.raise_error(F.concat("file", F.lit(f": {kind} block at line "), F.col("line_number").cast("string"))).cast("boolean")
    whole = (F.size("_seq") == 5) & (F.size("_motif") == 4)
    rows = rows.filter(F.when(F.col("_n") < 2, fault("short")).when(~whole, fault("bad")).otherwise(F.lit(True)))
    seq, motif = (lambda k: F.get("_seq", F.lit(k))), (lambda k: F.get("_motif", F.lit(k)))
    found = lambda pattern: F.nullif(F.regexp_extract("_stats", pattern, 1), F.lit(""))
    bases = lambda c: F.regexp_replace(c, "bp$", "")
    sign = F.nullif(F.regexp_extract(motif(0), "([+-]?)$", 1), F.lit(""))
    columns: dict[str, Column] = {
        "name": seq(0), "seq_len": F.nullif(seq(1), F.lit("?")), "seq_bases": bases(seq(2)), "start": F.substring_index(seq(3), "-", 1),
        "end": F.substring_index(seq(3), "-", -1), "seq_text": seq(4), "motif": F.regexp_replace(motif(0), "[+-]$", ""), "strand": F.coalesce(sign, F.lit("+")),
        "motif_bases": bases(motif(1)), "score": F.regexp_replace(motif(2), "^score=", ""), "motif_text": motif(3), **{k: found(rf"(?<!\S){k}=(\d+)") for k in ("m", "mm", "i", "d")},
        "m_ratio_text": found(r"mRatio=(\S+%)"), "error_text": F.when(F.col("_stats") != "", F.element_at(words(F.col("_stats")), -1)),
    }
    kinds = dict(f.split() for f in BLOCK_SCHEMA.split(", "))
    return rows.select("file", "line_number", *[c.cast(kinds[k]).alias(k) for k, c in columns.items()], "extra_lines")
