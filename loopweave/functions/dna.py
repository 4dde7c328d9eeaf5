"""Column functions on DNA, alignment texts, cigars and tags; all of them built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .config import Scoring

#: Bases and IUPAC codes, and what each pairs with.
NUCS = "ACGTSWRYMKBDHVNacgtswrymkbdhvn"
PAIRS = "TGCASWYRKMVHDBNtgcaswyrkmvhdbn"


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def reverse_complement(nucs: Column) -> Column:
    """Case-preserving, with IUPAC codes; other characters, such as gaps, are kept."""
    return F.reverse(F.translate(nucs, NUCS, PAIRS))


def is_nucleotides(text: Column) -> Column:
    return text.rlike("^[ACGTacgt]+$")


def rotations(motif: Column) -> Column:
    """All rotations of a motif, from the one that starts at its first base."""
    n = F.length(motif)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substr(motif, i, n), F.substr(motif, F.lit(1), i - 1)))


def canonical_motif(motif: Column) -> Column:
    """struct(motif, strand): the smallest rotation of the motif or its reverse complement; ties are forward."""

    def side(m: Column, strand: str) -> Column:
        return F.transform(rotations(m), lambda r: F.struct(r.alias("motif"), F.lit(strand).alias("strand")))

    return F.array_min(F.concat(side(motif, "+"), side(reverse_complement(motif), "-")))


def kmers(nucs: Column, k: int) -> Column:
    n = F.length(nucs)
    return F.when(n < k, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substr(nucs, i, F.lit(k)))
    )


def motif_neighbors(motif: Column) -> Column:
    """Every sequence at one substitution, insertion or deletion from a motif, repeats included."""
    n = F.length(motif)
    base = F.split(F.lit("A,C,G,T"), ",")
    head = lambda i: F.substr(motif, F.lit(1), i)
    tail = lambda i: F.substr(motif, i + 1, n)
    at = F.sequence(F.lit(0), n - 1)
    subs = F.flatten(F.transform(at, lambda i: F.transform(F.filter(base, lambda b: b != F.substr(motif, i + 1, F.lit(1))), lambda b: F.concat(head(i), b, tail(i + 1)))))
    ins = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.transform(base, lambda b: F.concat(head(i), b, tail(i)))))
    dels = F.transform(at, lambda i: F.concat(head(i), tail(i + 1)))
    return F.concat(subs, ins, dels)


def column_kinds(seq_text: Column, motif_text: Column) -> Column:
    """A character for each column of an alignment: = match, x mismatch, i insertion, d deletion."""
    pairs = F.zip_with(
        F.split(seq_text, ""), F.split(motif_text, ""),
        lambda s, q: F.when(q == "-", "i").when(s == "-", "d").when(s == q, "=").otherwise("x"),
    )
    return F.array_join(pairs, "")


def match_mask(seq_text: Column, motif_text: Column) -> Column:
    """= for columns that agree, x for the others."""
    return F.translate(column_kinds(seq_text, motif_text), "id", "xx")


def _count(kinds: Column, pattern: str) -> Column:
    return F.regexp_count(kinds, F.lit(pattern)).cast("long")


def event_counts(kinds: Column) -> Column:
    """struct(m, mm, io, ix, do, dx) from column kinds: gaps count their first column as opened, others as extended."""
    return F.struct(
        _count(kinds, "=").alias("m"),
        _count(kinds, "x").alias("mm"),
        _count(kinds, "i+").alias("io"),
        (_count(kinds, "i") - _count(kinds, "i+")).alias("ix"),
        _count(kinds, "d+").alias("do"),
        (_count(kinds, "d") - _count(kinds, "d+")).alias("dx"),
    )


def rescore(kinds: Column, s: Scoring) -> Column:
    """An alignment's score from its column kinds."""
    return let(
        event_counts(kinds),
        lambda e: e["m"] * s.match - e["mm"] * s.mismatch - e["io"] * s.insert_open - e["ix"] * s.insert_extend - e["do"] * s.delete_open - e["dx"] * s.delete_extend,
    )


def error_positions(mask: Column) -> Column:
    """Relative positions (0 to 1) of the x columns of a match mask; a mask of one column has them at 0."""

    def placed(cells: Column) -> Column:
        last = F.greatest(F.size(cells) - 1, F.lit(1))
        return F.filter(F.transform(cells, lambda x, i: F.when(x == "x", i.cast("double") / last)), lambda p: p.isNotNull())

    return let(F.split(mask, ""), placed)


def cigar_ops(cigar: Column, ops: str = "MID") -> Column:
    """array of struct(n, op) of a cigar, which may have blanks."""
    tight = F.regexp_replace(cigar, r"\s+", "")
    return F.transform(
        F.regexp_extract_all(tight, F.lit(rf"[0-9]+[{ops}]"), F.lit(0)),
        lambda x: F.struct(F.regexp_extract(x, "^([0-9]+)", 1).cast("int").alias("n"), F.substr(x, F.length(x), F.lit(1)).alias("op")),
    )


def is_cigar(cigar: Column, ops: str = "MID") -> Column:
    """Whether a cigar is well-formed: only known operations, none of count 0."""
    return F.regexp_replace(cigar, r"\s+", "").rlike(rf"^(0*[1-9][0-9]*[{ops}])+$")


def cigar_total(ops: Column, kinds: str) -> Column:
    """Sum of counts of the given operations."""
    return F.aggregate(F.filter(ops, lambda x: x["op"].isin(*kinds)), F.lit(0).cast("long"), lambda a, x: a + x["n"])


def _lengths(texts: Column, skip: int) -> Column:
    return F.aggregate(texts, F.lit(0).cast("long"), lambda a, x: a + F.length(x) - skip)


def cs_events(cs: Column) -> Column:
    """struct(m, mm, io, ix, do, dx) of a difference string: :n matches, *ab mismatch, +seq insertion, -seq deletion."""
    part = lambda p: F.regexp_extract_all(cs, F.lit(p), F.lit(0))
    ins, dels = part(r"\+[a-zA-Z]+"), part(r"-[a-zA-Z]+")
    return F.struct(
        F.aggregate(part(":[0-9]+"), F.lit(0).cast("long"), lambda a, x: a + F.substr(x, F.lit(2), F.length(x)).cast("long")).alias("m"),
        F.size(part(r"\*[a-zA-Z]{2}")).cast("long").alias("mm"),
        F.size(ins).cast("long").alias("io"),
        (_lengths(ins, 1) - F.size(ins)).alias("ix"),
        F.size(dels).cast("long").alias("do"),
        (_lengths(dels, 1) - F.size(dels)).alias("dx"),
    )


def natural_key(name: Column) -> Column:
    """A string by which names sort with their numbers by value, numbers before words.

    A number is written as how many digits it has without leading zeros, and these digits, however many they are.
    """
    parts = F.regexp_extract_all(name, F.lit("([0-9]+|[A-Za-z]+|[^0-9A-Za-z]+)"), F.lit(0))

    def number(x: Column) -> Column:
        return let(F.ltrim(x, F.lit("0")), lambda d: F.concat(F.lit("0"), F.lpad(F.length(d).cast("string"), 10, "0"), d))

    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), number(x)).otherwise(F.concat(F.lit("1"), x))), "\u0001")


def percent_text(ratio: Column, digits: int = 1) -> Column:
    """A ratio as a percentage with fixed decimals, such as 90.1%, rounded as C does: exactly, and ties to even.

    Java's formatter rounds the shortest decimal form, and ties up. So the product with the power of ten is taken
    with its rounding error (by splitting the factor in halves), and that decides where the product ends in .5.
    """
    scale = float(10**digits)

    def rounded(v: Column) -> Column:
        big = v * 134217729.0
        high = big - (big - v)
        low = v - high
        product = v * scale
        error = (high * scale - product) + low * scale
        whole = F.floor(product).cast("double")
        half = product - whole
        up = (half > 0.5) | ((half == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
        return F.format_string(f"%.{digits}f%%", (whole + up.cast("double")) / scale)

    return let(100 * ratio.cast("double"), rounded)


def percent_value(text: Column) -> Column:
    """The ratio that a percentage text stands for."""
    return F.regexp_replace(text, "%$", "").cast("double") / 100


def commatize(n: Column) -> Column:
    return F.format_number(n, 0)


def stranded_motif(text: Column) -> Column:
    """struct(motif, strand) of a motif with an optional strand at its end; + without one."""
    last = F.substr(text, F.length(text), F.lit(1))
    has = last.isin("+", "-")
    return F.struct(F.when(has, F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text).alias("motif"), F.when(has, last).otherwise("+").alias("strand"))


def flip_strand(tag: Column) -> Column:
    """A tag whose last character, if + or -, is turned round."""
    parts = stranded_motif(tag)
    return F.when(tag.rlike(r"[+-]$"), F.concat(parts["motif"], F.when(parts["strand"] == "+", "-").otherwise("+"))).otherwise(tag)
