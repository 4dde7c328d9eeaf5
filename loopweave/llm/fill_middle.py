"""Operator 11: fill-in-the-middle over succinct line boundaries.

A text is cut into lines, a prefix, a middle and a suffix are picked by a hash of its id, and the parts are put in
another order behind marks. What the cuts need of a text is a bitvector with a one at the last byte of each line:

1. the vectors of many texts lie packed in 64-bit words, each from the start of a block of WORDS words of its own, and
   a directory counts the ones ahead of each block;
2. the ones in a text's blocks give its number of lines n;
3. select on two ranks gives the byte cuts: the directory finds the block, popcounts the word, halving the bit;
4. a second vector with a one at the first byte of each code point gives lengths in code points, by rank.

One pass over the scan without exchange; forms, digests and the restored text are built-in expressions.

Defined results
* null or empty text: n 0, form plain, empty output, prefix_chars and middle_chars null;
* a text with a mark in it is plain, and so is any whose hash says so (none at rate 100): its output is the text;
* null doc_id: cut by the hash of an empty id; repeated rows, also of one doc_id, are cut alike, as the hash is the id's;
* ties (two equal cuts) give an empty middle; very long texts are cut whole, a batch of texts goes through at a time;
* extra columns are ignored, also such as are named like results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: The marks of prefix, suffix and middle, and what goes before the id in the hash.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "7"
#: Words of 64 bits in a block of the directory.
WORDS = 8
#: Bytes and rows of texts that go through at a time; a longer text goes alone.
SLICE_BYTES, SLICE_ROWS = 1 << 22, 1024

_ONE = np.uint64(1)


class Bits:
    """A bitvector in 64-bit words, with the number of ones ahead of each block of WORDS words."""

    def __init__(self, words: np.ndarray):
        rest = -len(words) % WORDS
        self.words = np.concatenate([words, np.zeros(rest + WORDS, np.uint64)])  # a block of zeros ends it
        self.counts = np.bitwise_count(self.words).reshape(-1, WORDS)
        self.ahead = np.concatenate([[0], np.cumsum(self.counts.sum(axis=1, dtype=np.int64))])

    @classmethod
    def at(cls, places: np.ndarray, length: int) -> Bits:
        """Ones at the places given, of `length` bits."""
        words = np.zeros(-(-length // 64), np.uint64)
        np.bitwise_or.at(words, places >> 6, _ONE << (places & 63).astype(np.uint64))
        return cls(words)

    @classmethod
    def of(cls, flags: np.ndarray) -> Bits:
        """The bits of an array of booleans."""
        packed = np.packbits(flags, bitorder="little")
        return cls(np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view("<u8"))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Ones ahead of each place."""
        word = places >> 6
        block, inside = word // WORDS, word % WORDS
        before = np.where(np.arange(WORDS) < inside[:, None], self.counts[block], 0).sum(axis=1, dtype=np.int64)
        low = self.words[word] & ((_ONE << (places & 63).astype(np.uint64)) - _ONE)
        return self.ahead[block] + before + np.bitwise_count(low)

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """Places of the ones of these ranks, from 0."""
        block = np.searchsorted(self.ahead, ranks, side="right") - 1
        rest = ranks - self.ahead[block]
        upto = np.cumsum(self.counts[block], axis=1, dtype=np.int64)
        inside = (upto <= rest[:, None]).sum(axis=1)
        rest = rest - np.where(inside > 0, upto[np.arange(len(rest)), np.maximum(inside - 1, 0)], 0)
        word = self.words[block * WORDS + inside]
        bit = np.zeros(len(rest), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(word & ((_ONE << np.uint64(width)) - _ONE)).astype(np.int64)
            up = rest >= low
            rest = rest - np.where(up, low, 0)
            word = np.where(up, word >> np.uint64(width), word)
            bit += np.where(up, width, 0)
        return (block * WORDS + inside) * 64 + bit


def line_ends(data: np.ndarray, at: np.ndarray) -> tuple[Bits, np.ndarray]:
    """Ones at the last bytes of lines of the texts data[at[k]:at[k + 1]], and the block at which each text's bits start."""
    starts, ends = at[:-1], at[1:]
    first = np.concatenate([[0], np.cumsum(-(-(ends - starts) // (64 * WORDS)))])
    places = np.flatnonzero(data == ord("\n")) + at[0]
    last = ends[ends > starts] - 1
    places = np.concatenate([places, last[data[last - at[0]] != ord("\n")]])
    text = np.searchsorted(at, places, side="right") - 1
    return Bits.at(places - starts[text] + first[text] * 64 * WORDS, int(first[-1]) * 64 * WORDS), first


def cuts(data: np.ndarray, at: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, byte cuts, code points ahead of the cuts) of the texts data[at[k]:at[k + 1]].

    draws: two numbers for each text; modulo the number of lines and one they say after how many lines it is cut.
    """
    bits, first = line_ends(data, at)
    ones = bits.ahead[first]
    n = np.diff(ones)
    lines = np.sort(draws % (n + 1)[:, None], axis=1)
    wanted = np.minimum(ones[:-1, None] + np.maximum(lines, 1) - 1, max(int(ones[-1]) - 1, 0))
    found = bits.select(wanted.ravel()).reshape(lines.shape) - first[:-1, None] * 64 * WORDS + 1
    cut = np.where(lines > 0, found, 0)
    points = Bits.of((data & 0xC0) != 0x80)
    starts = (at[:-1] - at[0])[:, None]
    ahead = points.rank((starts + cut).ravel()).reshape(cut.shape) - points.rank(starts.ravel())[:, None]
    return n, cut, ahead


def _sliced(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of stretches of texts of a bounded size."""
    _, ends, data = texts.cast(pa.large_binary()).buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(ends, ends[row] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, row + 1), row + SLICE_ROWS, len(texts))
        yield row, end, data[ends[row] : ends[end]], ends[row : end + 1]
        row = end


def fill_in_middle(df: DataFrame, rate: int = 100, spm: int = 50, seed: str = SEED, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each document (doc_id, text).

    rate: percent of texts that are not left plain; spm: percent of these that put the suffix first.
    """
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    number = lambda k: F.conv(F.substr("_digest", F.lit(8 * k + 1), F.lit(8)), 16, 10).cast("long")
    plain = (F.col("_text") == "") | (number(2) % 100 >= rate)
    for m in marks:
        plain = plain | F.contains("_text", F.lit(m))
    form = F.when(plain, "plain").when(number(3) % 100 < spm, "spm").otherwise("psm")
    given = df.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"), digest.alias("_digest"))
    given = given.select("doc_id", "_text", form.alias("form"), number(0).alias("h1"), number(1).alias("h2"))
    p, s, m = (x.encode() for x in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = np.stack([batch.column(3).to_numpy(), batch.column(4).to_numpy()], axis=1)
            for row, end, data, at in _sliced(batch.column(1)):
                n, cut, ahead = cuts(data, at, draws[row:end])
                forms = batch.column(2).slice(row, end - row)
                whole, out = data.tobytes(), []
                for k, (form, (a, b)) in enumerate(zip(forms.to_pylist(), cut.tolist(), strict=True)):
                    text = whole[at[k] - at[0] : at[k + 1] - at[0]]
                    if form == "plain":
                        out.append(text)
                    elif form == "psm":
                        out.append(b"".join((p, text[:a], s, text[b:], m, text[a:b])))
                    else:
                        out.append(b"".join((s, text[b:], p, text[:a], m, text[a:b])))
                none = np.array([f == "plain" for f in forms.to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, end - row), pa.array(n), forms, pa.array(ahead[:, 0], mask=none), pa.array(ahead[:, 1] - ahead[:, 0], mask=none),
                        pa.array(out, pa.string()),
                    ],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    kind = df.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(form: Column, output: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The exact text, rebuilt from output and form: unless it is plain, a text has no mark of its own."""
    parts = F.split(output, "|".join(map(re.escape, marks)))
    whole = let(parts, lambda x: F.when(form == "psm", F.concat(x[1], x[3], x[2])).otherwise(F.concat(x[2], x[3], x[1])))
    return F.when(form == "plain", output).otherwise(whole)


def op11_fill_in_middle(df: DataFrame) -> DataFrame:
    """The contract's digest: one row for each document."""
    out = fill_in_middle(df)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )


def oracle() -> str:
    """DuckDB SQL for `op11_fill_in_middle`; texts that are not rebuilt are their own."""
    h = lambda k: f"('0x' || substr(d, {8 * k + 1}, 8))::bigint"
    has = " or ".join(f"contains(t, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    return rf"""
with a as (select doc_id, coalesce(text, '') as t, sha256('{SEED}:' || coalesce(doc_id::varchar, '')) as d from documents),
b as (select doc_id, t, d, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as units from a),
c as (select *, len(units) as n, {h(0)} % (len(units) + 1) as x, {h(1)} % (len(units) + 1) as y,
             case when t = '' or {has} or {h(2)} % 100 >= 100 then 'plain' when {h(3)} % 100 < 50 then 'spm' else 'psm' end as form from b),
p as (select doc_id, t, n, form, array_to_string(units[1:least(x, y)], '') as p, array_to_string(units[least(x, y) + 1:greatest(x, y)], '') as m,
             array_to_string(units[greatest(x, y) + 1:n], '') as s from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p)::bigint end as prefix_chars, case when form <> 'plain' then length(m)::bigint end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
              else '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m end) as output_sha256,
       sha256(t) as restored_sha256 from p
"""
