"""The formula language of algebraic conversions: one variable X, arithmetic, common functions; as numpy or as a Column."""

from __future__ import annotations

import ast
import math
from functools import lru_cache

import numpy as np

_CONST = {"pi": math.pi, "e": math.e}
_ONE = {
    "sqrt": np.sqrt, "exp": np.exp, "ln": np.log, "abs": np.abs, "sin": np.sin, "cos": np.cos, "tan": np.tan, "asin": np.arcsin, "acos": np.arccos, "atan": np.arctan,
    "sinh": np.sinh, "cosh": np.cosh, "tanh": np.tanh, "asinh": np.arcsinh, "acosh": np.arccosh, "atanh": np.arctanh, "floor": np.floor, "ceil": np.ceil,
    "round": lambda x: np.trunc(x + np.copysign(0.5, x)), "signum": lambda x: np.copysign(1.0, x),
}


@lru_cache(maxsize=1024)
def parse(formula: str) -> ast.expr | None:
    """The tree of a formula; None if it holds anything else."""
    try:
        tree = ast.parse(formula.strip().replace("^", "**"), mode="eval").body
    except (SyntaxError, ValueError, RecursionError):
        return None

    def fine(n) -> bool:
        match n:
            case ast.Constant(value=int() | float()):
                return not isinstance(n.value, bool)
            case ast.Name():
                return n.id == "X" or n.id in _CONST
            case ast.UnaryOp(op=ast.USub() | ast.UAdd()):
                return fine(n.operand)
            case ast.BinOp(op=ast.Add() | ast.Sub() | ast.Mult() | ast.Div() | ast.Mod() | ast.Pow()):
                return fine(n.left) and fine(n.right)
            case ast.Call(func=ast.Name(id=f), args=[a], keywords=[]):
                return f in _ONE and fine(a)
        return False

    return tree if fine(tree) else None


def evaluate(formula: str, x: np.ndarray) -> np.ndarray:
    """IEEE values of the formula; one that can't be read leaves x as it is."""
    tree = parse(formula)
    if tree is None:
        return x

    def value(n):
        match n:
            case ast.Constant():
                return np.float64(n.value)
            case ast.Name():
                return x if n.id == "X" else np.float64(_CONST[n.id])
            case ast.UnaryOp():
                return -value(n.operand) if isinstance(n.op, ast.USub) else value(n.operand)
            case ast.Call():
                return _ONE[n.func.id](value(n.args[0]))
        a, b = value(n.left), value(n.right)
        match n.op:
            case ast.Add():
                return a + b
            case ast.Sub():
                return a - b
            case ast.Mult():
                return a * b
            case ast.Div():
                return np.divide(a, b)
            case ast.Mod():
                return np.fmod(a, b)
        return np.power(a, b)

    with np.errstate(all="ignore"):
        return np.broadcast_to(np.asarray(value(tree), np.float64), x.shape).copy()
