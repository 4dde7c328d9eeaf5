"""Operator 5: quality rules as one Spark projection, compiled from a threshold table.

Every measure is a built-in Spark expression over the whole text, so the operator is a map over the scan: no
exchange, no state, no group that could be hot, and a lost executor costs only its own tasks.

Defined results
* null or empty text, or white space alone: all counts 0, base_failed true, kept false;
* no doc_id: the row is judged like any other and keeps its null id;
* repeated rows: one result row for each input row;
* extra columns of the input are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, let, words

WINDOW = 8
#: Fixed values of the base verdict: least words, and the largest percentage of words in repeated windows.
BASE_MIN_WORDS, BASE_MAX_REPEAT_PERCENT = 20, 30

#: Frequent function words of the four languages; running prose has some of them whatever its subject.
STOP_WORDS = (
    "the of and to in is it that for was on are as with be by this an or at from a not have "
    "der die das und in den von zu mit sich des auf für ist im nicht ein eine als auch "
    "le la les de des et en un une du que qui dans pour par sur au est pas avec il elle "
    "el los las que y del se por con una para su al lo como más no es"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails if the measure (an expression over the facts) lies outside [low, high]."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Measures are SQL over the struct f of facts made by `facts`.
RULES = (
    Rule("mean_word_length", "f.word_chars / f.n_words", 2.0, 14.0),
    Rule("symbols_per_word", "f.n_symbols / f.n_words", None, 0.25),
    Rule("exclamations_per_word", "f.n_exclaims / f.n_words", None, 0.3),
    Rule("upper_case_share", "f.n_upper / f.word_chars", None, 0.45),
    Rule("digit_share", "f.n_digits / f.word_chars", None, 0.3),
    Rule("stop_word_share", "f.n_stop_words / f.n_words", 0.02, None),
    Rule("echoed_word_share", "f.n_echoes / f.n_words", None, 0.3),
    Rule("duplicate_line_share", "f.n_dup_lines / greatest(f.n_lines, 1)", None, 0.5),
    Rule("words_per_line", "f.n_words / greatest(f.n_lines, 1)", 1.5, None),
)


def _repeat_words(tokens: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in the text, first occurrence included.

    Windows are compared by 64-bit hashes. Texts without a repeated window, most of them, end at a hash set; else
    the (hash, start) pairs are sorted, starts with an equal neighbour are kept, and each adds the words up to the
    next such start, at most a window.
    """

    def spread(pairs: Column) -> Column:
        n = F.size(pairs)

        def twice(k: Column) -> Column:
            same = lambda a, b: F.get(pairs, a)["h"] == F.get(pairs, b)["h"]
            return ((k > 0) & same(k, F.greatest(k - 1, F.lit(0)))) | (
                (k < n - 1) & same(k, F.least(k + 1, n - 1))
            )

        starts = F.sort_array(
            F.transform(F.filter(F.sequence(F.lit(0), n - 1), twice), lambda k: F.get(pairs, k)["i"])
        )
        return let(
            starts,
            lambda s: F.aggregate(
                F.transform(
                    F.sequence(F.lit(0), F.size(s) - 1),
                    lambda k: F.least(
                        F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - F.get(s, k), F.lit(WINDOW))
                    ),
                ),
                F.lit(0),
                lambda a, x: a + x,
            ),
        )

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), spread)
        )

    windows = F.transform(
        F.sequence(F.lit(1), F.size(tokens) - WINDOW + 1), lambda i: F.xxhash64(F.slice(tokens, i, WINDOW))
    )
    return F.when(F.size(tokens) <= WINDOW, F.lit(0)).otherwise(let(windows, counted))


def facts(text: Column) -> Column:
    """A struct of all counts over one text, evaluated once."""
    whole = F.coalesce(text, F.lit(""))

    def only(pattern: str) -> Column:
        return F.length(F.regexp_replace(whole, pattern, "")).cast("long")

    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.length(F.regexp_replace(x, SPACE_RUN, "")) > 0)
    def counts(tokens: Column) -> Column:
        return let(
            lines,
            lambda kept: F.struct(
                F.size(tokens).cast("long").alias("n_words"),
                F.length(F.array_join(tokens, "")).cast("long").alias("word_chars"),
                only("[^#*$%&|<>]+").alias("n_symbols"),
                (F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("n_dup_lines"),
                _repeat_words(tokens).cast("long").alias("n_repeat_words"),
                F.size(kept).cast("long").alias("n_lines"),
                only("[^!]+").alias("n_exclaims"),
                only(r"[^\p{Lu}]+").alias("n_upper"),
                only("[^0-9]+").alias("n_digits"),
                F.size(F.filter(tokens, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
                F.size(F.filter(tokens, lambda w, i: (i > 0) & (w == F.get(tokens, F.greatest(i - 1, F.lit(0))))))
                .cast("long")
                .alias("n_echoes"),
            ),
        )

    return let(words(text), counts)


def compiled(rules: tuple[Rule, ...] = RULES) -> str:
    """SQL over the facts f: the names of the rules that they break; a text without words breaks none (the base fails it)."""
    broken = []
    for r in rules:
        tests = [f"({r.measure}) < {r.low}" if r.low is not None else "", f"({r.measure}) > {r.high}" if r.high is not None else ""]
        broken.append(f"case when f.n_words > 0 and ({' or '.join(filter(None, tests))}) then '{r.name}' end")
    return f"array_compact(array({', '.join(broken)}))"


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with the struct `verdict`: facts, base_failed, the array failed_rules, and kept. A column verdict is replaced.

    It is one expression in which the facts are bound to a variable, so a filter on it counts a text once.
    """
    base = f"f.n_words < {BASE_MIN_WORDS} or 100 * f.n_repeat_words > {BASE_MAX_REPEAT_PERCENT} * f.n_words"
    first = f"named_struct('facts', f, 'base_failed', {base}, 'failed_rules', {compiled(rules)})"
    last = "named_struct('facts', v.facts, 'base_failed', v.base_failed, 'failed_rules', v.failed_rules, 'kept', not v.base_failed and size(v.failed_rules) = 0)"
    own = df.drop("verdict") if text != "verdict" else df
    return own.withColumn("verdict", facts(F.col(text))).withColumn("verdict", F.expr(f"transform(transform(array(verdict), f -> {first}), v -> {last})[0]"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that no rule rejects, with their columns whatever these are named."""
    return judge(docs.select(F.struct("*").alias("row"), "text")).filter("verdict.kept").select("row.*")


def op5_quality_rules(df: DataFrame) -> DataFrame:
    """The contract's digest: one row for each document."""
    judged = judge(df.select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(
        "doc_id", *[F.col(f"verdict.facts.{n}").alias(n) for n in names], "verdict.base_failed", "verdict.kept", F.array_join("verdict.failed_rules", ",").alias("failed_rules")
    )


def oracle() -> str:
    """DuckDB SQL for `op5_quality_rules`."""
    fails = []
    for r in RULES:
        m = r.measure.replace("f.", "")
        tests = [f"({m}) < {r.low}" if r.low is not None else "", f"({m}) > {r.high}" if r.high is not None else ""]
        fails.append(f"case when n_words > 0 and ({' or '.join(filter(None, tests))}) then '{r.name}' end")
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
win as (select rid, i, w[i:i + {WINDOW - 1}] as g from (select rid, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from w)),
dup as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from win) where c > 1),
cov as (select rid, count(distinct i + k) as n from dup, range({WINDOW}) as r(k) group by rid),
f as (select w.rid, doc_id, len(w) as n_words,
             list_sum(list_transform(w, lambda x: length(x))) as chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
             len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n, 0) as n_repeat_words, len(l) as n_lines,
             length(regexp_replace(t, '[^!]+', '', 'g')) as n_exclaims,
             length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) as n_upper,
             length(regexp_replace(t, '[^0-9]+', '', 'g')) as n_digits,
             len(list_filter(w, lambda x: lower(x) in ({stop}))) as n_stop_words,
             len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as n_echoes
      from w left join cov on w.rid = cov.rid),
j as (select *, n_words < {BASE_MIN_WORDS} or 100 * n_repeat_words > {BASE_MAX_REPEAT_PERCENT} * n_words as base_failed,
             list_filter([{", ".join(fails)}], lambda x: x is not null) as failed
      from (select * replace (coalesce(n_repeat_words, 0) as n_repeat_words), cast(coalesce(chars, 0) as bigint) as word_chars from f))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and len(failed) = 0 as kept, array_to_string(failed, ',') as failed_rules from j
"""
