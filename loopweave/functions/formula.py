"""Formulas over named values, as column expressions: arithmetic, comparisons and a fixed list of functions, nothing else."""

from __future__ import annotations

import ast
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The constants and functions that formulas may use.
CONSTANTS = {"e": math.e, "pi": math.pi}
FUNCTIONS = {
    "abs": F.abs,
    "ceil": lambda x: F.ceil(x).cast("long"),
    "exp": F.exp,
    "float": lambda x: x.cast("double"),
    "floor": lambda x: F.floor(x).cast("long"),
    "int": lambda x: x.cast("long"),
    "log": F.log,
    "log10": F.log10,
    "log2": F.log2,
    "max": lambda *x: F.greatest(*x) if len(x) > 1 else x[0],
    "min": lambda *x: F.least(*x) if len(x) > 1 else x[0],
    "pow": F.pow,
    "round": lambda x: F.round(x).cast("long"),
    "sin": F.sin,
    "sqrt": F.sqrt,
}
_BINARY = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: a / b,
    ast.FloorDiv: lambda a, b: F.floor(a / b),
    ast.Mod: lambda a, b: F.pmod(a, b),
    ast.Pow: F.pow,
}
_COMPARE = {
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
}


def names_in(text: str) -> set[str]:
    """The names of values, neither constants nor functions, in a formula."""
    return {n.id for n in ast.walk(ast.parse(text, mode="eval")) if isinstance(n, ast.Name)} - CONSTANTS.keys() - FUNCTIONS.keys()


def formula(text: str, values: dict[str, Column]) -> Column:
    """A formula such as floor(sqrt(pos)) as a column, its names replaced by the columns of values.

    A name, function or construct that isn't known is a ValueError, so no text reaches Spark's SQL.
    """
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"not a formula: {text!r}") from e

    def column(n: ast.expr) -> Column:
        if isinstance(n, ast.Constant) and type(n.value) in (int, float):
            return F.lit(n.value)
        if isinstance(n, ast.Name) and n.id in values:
            return values[n.id]
        if isinstance(n, ast.Name) and n.id in CONSTANTS:
            return F.lit(CONSTANTS[n.id])
        if isinstance(n, ast.BinOp) and type(n.op) in _BINARY:
            return _BINARY[type(n.op)](column(n.left), column(n.right))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.UAdd, ast.Not)):
            x = column(n.operand)
            return -x if isinstance(n.op, ast.USub) else ~x if isinstance(n.op, ast.Not) else x
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in FUNCTIONS and n.args and not n.keywords:
            return FUNCTIONS[n.func.id](*map(column, n.args))
        if isinstance(n, ast.Compare) and all(type(o) in _COMPARE for o in n.ops):
            sides = [column(x) for x in (n.left, *n.comparators)]
            out = F.lit(True)
            for op, a, b in zip(n.ops, sides, sides[1:], strict=False):
                out = out & _COMPARE[type(op)](a, b)
            return out
        if isinstance(n, ast.BoolOp):
            out = column(n.values[0])
            for x in n.values[1:]:
                out = out & column(x) if isinstance(n.op, ast.And) else out | column(x)
            return out
        raise ValueError(f"not allowed in a formula: {ast.unparse(n)!r} in {text!r}")

    return column(tree)
