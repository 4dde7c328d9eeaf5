"""The aligner as a table function of Spark SQL."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, SelectedColumn

from ..functions.config import PRESETS, Motif, Scoring, Thresholds, parse_motif, thresholds
from . import align as A

_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "float": T.FloatType(), "boolean": T.BooleanType()}
#: Columns that the table must have, and the types that they may have.
NEEDED = {"seq_ordinal": (T.LongType, T.IntegerType), "name": (T.StringType,), "nt": (T.StringType,)}


@dataclass
class _Search(AnalyzeResult):
    """What the arguments say, handed from `analyze` to the tasks."""

    motifs: list[Motif] = field(default_factory=list)
    scoring: Scoring | None = None
    limits: Thresholds | None = None
    strands: str = "both"


def _constant(name: str, arg: AnalyzeArgument | None, default: object = None) -> object:
    if arg is None:
        return default
    if arg.isTable or not arg.isConstantExpression:
        raise ValueError(f"{name} must be a constant")
    return arg.value


class AlignRepeats:
    """align_repeats(TABLE(sequences), motifs => array(..), preset, min_length, min_ratio, strands).

    The rows are those of `align.align_repeats`. The table has seq_ordinal, name and nt; other columns are
    not read. Its rows stay in their partitions. Whole sequences of a partition are searched together, up to
    `align.TOGETHER` bases. A null sequence counts as empty; wrong columns or arguments are errors of analysis.
    """

    def __init__(self, search: _Search):
        self.search = search
        self.rows: list[tuple] = []
        self.size = 0

    @staticmethod
    def analyze(
        sequences: AnalyzeArgument, motifs: AnalyzeArgument, preset: AnalyzeArgument | None = None, min_length: AnalyzeArgument | None = None,
        min_ratio: AnalyzeArgument | None = None, strands: AnalyzeArgument | None = None,
    ) -> _Search:
        if not sequences.isTable:
            raise ValueError("the first argument must be a table: TABLE(...)")
        given = {f.name.lower(): f.dataType for f in sequences.dataType.fields}
        for name, kinds in NEEDED.items():
            if not isinstance(given.get(name), kinds):
                raise ValueError(f"the table needs a column {name} of type {' or '.join(k.typeName() for k in kinds)}")
        wanted, scoring, sides = _constant("motifs", motifs), _constant("preset", preset, "default"), _constant("strands", strands, "both")
        if not wanted:
            raise ValueError("motifs must be an array of motifs")
        if scoring not in PRESETS:
            raise ValueError(f"unknown preset {scoring!r}; there are {', '.join(PRESETS)}")
        if sides not in ("both", "forward", "reverse"):
            raise ValueError("strands must be both, forward or reverse")
        ratio = _constant("min_ratio", min_ratio)
        limits = thresholds(_constant("min_length", min_length, 500), None if ratio is None else float(ratio))
        schema = T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in A.ALIGNMENT.split(", "))])
        parsed = [parse_motif(m) for m in wanted]
        return _Search(schema, select=[SelectedColumn(c) for c in NEEDED], motifs=parsed, scoring=PRESETS[scoring], limits=limits, strands=sides)

    def eval(self, sequences: Row, motifs: list, preset: str = "default", min_length: int = 500, min_ratio: float | None = None, strands: str = "both") -> Iterator[tuple]:
        self.rows.append((sequences["seq_ordinal"], sequences["name"], sequences["nt"], None))
        self.size += len(sequences["nt"] or "")
        if self.size >= A.TOGETHER:
            yield from self.terminate()

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            found = A._aligned(self.rows, self.search.motifs, self.search.scoring, self.search.limits, self.search.strands, False)
            self.rows, self.size = [], 0
            yield from zip(*(c.to_pylist() for c in found.columns), strict=True)


def register(spark: SparkSession, name: str = "align_repeats") -> None:
    """Makes the aligner known to the session's SQL under a name."""
    spark.udtf.register(name, udtf(AlignRepeats))
