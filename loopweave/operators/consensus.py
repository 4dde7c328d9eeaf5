"""Consensus motifs of alignments, filters on them, word counts and reports: each alignment is worked on in its own row."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from .align import motif_phase
from .durable import few

#: Share of a position's tokens that a winner needs, and motif copies below which a slice is too short.
WINNER, LEAST_COPIES = 0.5, 10


def motif_forward(alignments: DataFrame) -> DataFrame:
    """Alignments with both texts turned so that the sequence runs along the motif's strand.

    Rows printed along the sequence's forward strand have start > end if they are reversed; only these are turned.
    """
    return alignments.withColumns({"seq_text": _forward("seq_text"), "motif_text": _forward("motif_text"), "start": F.least("start", "end"), "end": F.greatest("start", "end")})


def _forward(text: str) -> Column:
    return F.when(F.col("start") > F.col("end"), dna.reverse_complement(F.col(text))).otherwise(F.col(text))


def _cells(motif: Column, seq_text: Column, motif_text: Column) -> Column:
    """array of struct(pos, chunk, token) of one alignment: see `tokens`."""
    known = F.coalesce(motif_phase(motif, motif_text), F.struct(F.lit(0).alias("position"), F.lit("+").alias("direction")))
    # one token for each motif base: columns are split before every motif base, so insertions stay with the base before
    pairs = F.zip_with(F.split(motif_text, ""), F.split(seq_text, ""), lambda q, s: F.when(q == "-", s).otherwise(F.concat(F.lit("|"), s)))
    split = F.split(F.array_join(pairs, ""), r"\|")
    parts = F.filter(F.slice(split, 2, F.greatest(F.size(split) - 1, F.lit(0))), lambda x: x != "")
    n = F.length(motif)

    def placed(phase: Column, found: Column) -> Column:
        first, reverse = phase["position"], phase["direction"] == "-"

        def cell(k: Column) -> Column:
            text = F.coalesce(F.when(k >= first, F.get(found, k - first)), F.lit(""))
            at = (k % n).cast("int")
            return F.struct(
                F.when(reverse, n - 1 - at).otherwise(at).alias("pos"), F.floor(k / n).alias("chunk"), F.when(reverse, dna.reverse_complement(text)).otherwise(text).alias("token")
            )

        last = F.greatest(F.ceil((first + F.size(found)) / n).cast("int") * n - 1, F.lit(0))
        return F.when(F.size(found) == 0, F.array().cast(CELLS)).otherwise(F.transform(F.sequence(F.lit(0), last), cell))

    return dna.let(known, lambda phase: dna.let(parts, lambda found: placed(phase, found)))


CELLS = "array<struct<pos:int,chunk:bigint,token:string>>"


_TURN = str.maketrans(dna.NUCS, dna.PAIRS)


def copies_of(motif: str, seq_text: str, motif_text: str) -> list[list[str]]:
    """The cells of `tokens` copy by copy: for each copy of the motif the token of each position; one pass over the columns."""
    n, found = len(motif), []
    for s, q in zip(seq_text, motif_text, strict=True):
        if q != "-":
            found.append([s])
        elif found:
            found[-1].append(s)
    if not found:
        return []
    start = motif_text.replace("-", "").upper()[:n]
    turned = motif[::-1].translate(_TURN)
    first, reverse = (motif + motif).find(start), False
    if not 0 <= first < n:
        first, reverse = (turned + turned).find(start), True
    if not 0 <= first < n:
        first, reverse = 0, False
    texts = ["".join(x) for x in found]
    if reverse:
        texts = [x[::-1].translate(_TURN) for x in texts]
    cells = [""] * first + texts
    cells += [""] * (-len(cells) % n)
    step = -1 if reverse else 1
    return [cells[k : k + n][::step] for k in range(0, len(cells), n)]


def consensus_text(motif: str | None, seq_text: str | None, motif_text: str | None, winner: float = WINNER) -> str | None:
    """The consensus of one alignment, None if a position has no clear winner; of equally frequent tokens the larger text wins."""
    if motif is None or seq_text is None or motif_text is None:
        return None
    copies = copies_of(motif, seq_text, motif_text)
    top = [max((count, token) for token, count in Counter(x).items()) for x in zip(*copies, strict=True)]
    if not top or any(count < winner * len(copies) for count, _ in top):
        return None
    return "".join("" if token == "-" else token for _, token in top)


def word_counts(motif: str | None, seq_text: str | None, motif_text: str | None, ratio: float) -> list[tuple[int, int, str]] | None:
    """(n, off, word) of the words of one alignment, see `words`, in their order."""
    if motif is None or seq_text is None or motif_text is None:
        return None
    texts = ("".join(x).replace("-", "") for x in copies_of(motif, seq_text, motif_text) if "" not in x)
    counts = Counter(x if x == motif else x.lower() for x in texts)
    own = ratio * counts.get(motif, 0)
    return sorted(((n, abs(len(x) - len(motif)), x) for x, n in counts.items() if n >= own), reverse=True)


def _each(function, kind: pa.DataType, schema: str, motif: Column, seq_text: Column, motif_text: Column) -> Column:
    """function of each row's values, in Arrow batches."""

    def run(m: pa.Array, s: pa.Array, q: pa.Array) -> pa.Array:
        return pa.array([function(*x) for x in zip(m.to_pylist(), s.to_pylist(), q.to_pylist(), strict=True)], kind)

    return F.arrow_udf(run, schema)(motif, seq_text, motif_text)


def consensus_of(motif: Column, seq_text: Column, motif_text: Column, winner: float = WINNER) -> Column:
    """The consensus of an alignment that runs along its motif, null if it has none; see `consensus`."""
    return _each(lambda m, s, q: consensus_text(m, s, q, winner), pa.string(), "string", motif, seq_text, motif_text)


def tokens(alignments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunk, pos, token): the sequence cut into copies of the motif, a token for each motif position.

    A token is the base at a motif base with the inserted bases that follow it; '-' stands for a deletion. Positions
    of the first and last copy that the alignment does not reach have the token ''. Texts that follow the reverse
    complement are turned back.
    """
    cells = _cells(F.col("motif"), F.col("seq_text"), F.col("motif_text"))
    return alignments.select(*keys, F.inline(cells)).select(*keys, "chunk", "pos", "token")


def consensus(alignments: DataFrame, keys: list[str], winner: float = WINNER) -> DataFrame:
    """(keys, consensus) of the alignments that have one: at every position a token with the share `winner`.

    Of equally frequent tokens the larger text wins; a winning deletion adds nothing. Each alignment is judged in its
    own row, in one pass over its columns.
    """
    found = consensus_of(F.col("motif"), F.col("seq_text"), F.col("motif_text"), winner)
    return alignments.select(*keys, found.alias("consensus")).filter("consensus is not null")


def consensus_filter(alignments: DataFrame, keys: list[str], mode: str = "keep") -> DataFrame:
    """Alignments with their `consensus`: those whose consensus is their motif (keep), the others (invert), or all (annotate)."""
    out = alignments.withColumn("consensus", consensus_of(F.col("motif"), _forward("seq_text"), _forward("motif_text")))
    same = F.coalesce(F.col("consensus") == F.col("motif"), F.lit(False))
    return {"keep": out.filter(same), "invert": out.filter(~same), "annotate": out}[mode]


def _sliced(width: int, step: int) -> Column:
    """The consensus of each window of `width` columns every `step`, 'none' for those without one, under ten copies left out."""

    def windows(motif: str | None, seq: str | None, text: str | None) -> list[str] | None:
        if motif is None or seq is None or text is None:
            return None
        starts = [k for k in range(0, max(len(seq), 1), step) if min(len(seq) - k, width) >= LEAST_COPIES * len(motif)]
        return ["none" if x is None else x for x in (consensus_text(motif, seq[k : k + width], text[k : k + width]) for k in starts)]

    return _each(windows, pa.list_(pa.string()), "array<string>", F.col("motif"), _forward("seq_text"), _forward("motif_text"))


def sliced_consensus(alignments: DataFrame, keys: list[str], width: int, step: int) -> DataFrame:
    """(keys, slices, consensuses): the consensus of each window in order; alignments without a window are left out."""
    out = alignments.select(*keys, _sliced(width, step).alias("consensuses")).filter("size(consensuses) > 0")
    return out.select(*keys, F.size("consensuses").alias("slices"), "consensuses")


def sliced_consensus_filter(alignments: DataFrame, keys: list[str], width: int, step: int) -> DataFrame:
    """Alignments of which some window's consensus is the motif."""
    return alignments.filter(F.array_contains(_sliced(width, step), F.col("motif")))


def msa_report(alignments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunk, row): the copies one under the other, tokens padded to their position's width, = for the motif's base.

    Each alignment's report is made in its own row.
    """
    shown = lambda c: F.when(c["token"] == F.substr("motif", c["pos"] + 1, F.lit(1)), "=").otherwise(c["token"])

    def lines(cells: Column) -> Column:
        widths = F.transform(
            F.sequence(F.lit(0), F.length("motif") - 1), lambda p: F.array_max(F.transform(F.filter(cells, lambda c: c["pos"] == p), lambda c: F.length(c["token"])))
        )

        def line(chunk: Column, width: Column) -> Column:
            own = F.array_sort(F.filter(cells, lambda c: c["chunk"] == chunk))
            padded = lambda c: dna.let(shown(c), lambda t: F.concat(t, F.repeat(F.lit(" "), F.get(width, c["pos"]) - F.length(t))))
            return F.struct(chunk.alias("chunk"), F.array_join(F.transform(own, padded), "").alias("row"))

        chunks = F.array_distinct(F.transform(cells, lambda c: c["chunk"]))
        return dna.let(widths, lambda w: F.transform(chunks, lambda k: line(k, w)))

    cells = _cells(F.col("motif"), F.col("seq_text"), F.col("motif_text"))
    return alignments.select(*keys, F.inline(dna.let(cells, lines)))


def words(alignments: DataFrame, keys: list[str], ratio: float = 0.1) -> DataFrame:
    """(keys, word, n, rank): copies of the motif as written in the sequence, the motif itself in capitals, others small.

    Kept if they are as frequent as ratio times the motif; by count, length difference and text, descending. Counted
    in each alignment's own row.
    """
    kind = pa.list_(pa.struct([("n", pa.int32()), ("off", pa.int32()), ("word", pa.string())]))

    def counted(motif: str | None, seq_text: str | None, motif_text: str | None) -> list[dict] | None:
        found = word_counts(motif, seq_text, motif_text, ratio)
        return found and [{"n": n, "off": off, "word": word} for n, off, word in found]

    found = _each(counted, kind, "array<struct<n:int,off:int,word:string>>", F.col("motif"), F.col("seq_text"), F.col("motif_text"))
    rows = alignments.select(*keys, F.posexplode(found).alias("rank", "x"))
    return rows.select(*keys, F.col("x.word").alias("word"), F.col("x.n").cast("long").alias("n"), (F.col("rank") + 1).alias("rank"))


def wanted_motifs(alignments: DataFrame, motifs: DataFrame) -> DataFrame:
    """Alignments whose motif, given by name or bases, is in motifs (name, forward); named ones get their bases.

    A motif that is neither a known name nor bases is an error.
    """
    by_name = motifs.select(F.col("name").alias("_name"), F.col("forward").alias("_bases")).distinct()
    out = alignments.join(by_name, F.col("motif") == F.col("_name"), "left").withColumn("motif", F.coalesce("_bases", "motif")).drop("_name", "_bases")
    checked = F.when(F.col("motif").rlike("^[ACGT]+$"), F.col("motif")).otherwise(F.raise_error(F.concat(F.lit("not a motif: "), F.col("motif"))))
    return out.withColumn("motif", checked).join(motifs.select(F.col("forward").alias("motif")).distinct(), "motif", "left_semi")


def canonical_filter(alignments: DataFrame, motifs: DataFrame) -> DataFrame:
    """Alignments whose motif is in the class of one of motifs (forward): that motif replaces it, strands follow.

    Of several motifs of one class the smallest text stands for it.
    """
    cls = dna.canonical_motif(F.col("motif"))
    own = motifs.select(F.col("forward").alias("_motif"), dna.canonical_motif(F.col("forward")).alias("_class"))
    own = own.groupBy(F.col("_class.motif").alias("_of")).agg(F.min(F.struct("_motif", "_class")).alias("_x")).select("_x.*")
    joined = alignments.withColumn("_c", cls).join(own, F.col("_c.motif") == F.col("_class.motif"))
    flipped = F.col("_c.strand") != F.col("_class.strand")
    strand = F.when(flipped, F.when(F.col("strand") == "+", "-").otherwise("+")).otherwise(F.col("strand"))
    return joined.withColumn("motif", F.col("_motif")).withColumn("strand", strand).drop("_c", "_class", "_motif")


def canonical_motifs(df: DataFrame, motif: str = "motif") -> DataFrame:
    """df with `canonical` and `strand`: the smallest rotation of a motif or of its reverse complement, ties forward.

    Each distinct motif is turned once, however often it occurs; the table of these goes back by a join, broadcast if
    it is measured to be small, and a null motif has null for both.
    """
    turned = df.select(F.col(motif).alias("_m")).distinct().filter("_m is not null").withColumn("_c", dna.canonical_motif(F.col("_m")))
    table = few(turned.select("_m", F.col("_c.motif").alias("canonical"), F.col("_c.strand").alias("strand")))
    return df.drop("canonical", "strand").join(table, F.col(motif) == F.col("_m"), "left").drop("_m")
