"""Raw-to-physical conversions as Catalyst expressions, with IEEE arithmetic where Spark would give NULL or raise."""

from __future__ import annotations

import ast
import math
import struct
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions.formula import parse

EPS = 2.220446049250313e-16
NAN = float("nan")
INF = float("inf")
Text = str | Column | None


def _num(v: float) -> Column:
    return F.lit(float(v))


def _nan(x: Column) -> Column:
    """Whether x is NaN; Spark orders and equates NaN, IEEE comparisons are false for it."""
    return F.isnan(x.cast("double"))


def identity(x: Column) -> Column:
    return x


def linear(x: Column, v: Sequence[float]) -> Column:
    return x.cast("double") if len(v) < 2 else _num(v[0]) + _num(v[1]) * x


def divided(a: Column, b: Column) -> Column:
    """IEEE division: zero divisors give infinities by both signs, or NaN."""
    below = F.atan2(b, _num(-1.0)) < 0  # tells -0.0 from 0.0
    whole = F.when((a == 0) | F.isnan(a), _num(NAN)).when((a > 0) != below, _num(INF)).otherwise(_num(-INF))
    return F.when(b != 0, F.try_divide(a, b)).when(b == 0, whole)


def logarithm(x: Column) -> Column:
    return F.when(F.isnan(x), x).when(x > 0, F.ln(x)).when(x == 0, _num(-INF)).when(x < 0, _num(NAN))


def rational(x: Column, p: Sequence[float]) -> Column:
    x = x.cast("double")
    if len(p) < 6:
        return x
    p = [_num(v) for v in p]
    below = p[3] * x * x + p[4] * x + p[5]
    return F.when(~F.isnan(below) & (F.abs(below) > EPS), F.try_divide(p[0] * x * x + p[1] * x + p[2], below)).otherwise(x)


def _whole(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Rounding that keeps what is whole, infinite or NaN as it is."""
    return lambda x: F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(f(x).cast("double"))


_ONE: dict[str, Callable[[Column], Column]] = {n: getattr(F, n) for n in ("sqrt", "exp", "abs", "sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh")} | {
    "ln": logarithm, "floor": _whole(F.floor), "ceil": _whole(F.ceil),
    "round": _whole(lambda x: F.when(x < 0, -F.floor(-x + 0.5)).otherwise(F.floor(x + 0.5))),
    "signum": lambda x: F.when(F.isnan(x), x).when(F.atan2(x, _num(-1.0)) < 0, _num(-1.0)).otherwise(_num(1.0)),
}


def algebraic(x: Column, formula: str | None) -> Column:
    """The formula over X; one that can't be read leaves the value as it is."""
    if not formula:
        return x
    tree, x = parse(formula), x.cast("double")
    if tree is None:
        return x

    def build(n) -> Column:
        match n:
            case ast.Constant():
                return _num(n.value)
            case ast.Name():
                return x if n.id == "X" else _num({"pi": math.pi, "e": math.e}[n.id])
            case ast.UnaryOp():
                return -build(n.operand) if isinstance(n.op, ast.USub) else build(n.operand)
            case ast.Call():
                return _ONE[n.func.id](build(n.args[0]))
        a, b = build(n.left), build(n.right)
        match n.op:
            case ast.Add():
                return a + b
            case ast.Sub():
                return a - b
            case ast.Mult():
                return a * b
            case ast.Div():
                return divided(a, b)
            case ast.Mod():
                return F.when(b == 0, _num(NAN)).otherwise(F.try_mod(a, b))
        return F.pow(a, b)

    return build(tree)


def table(x: Column, pairs: Sequence[tuple[float, float]], interpolate: bool = True) -> Column:
    """Lookup between knots, clamped at both ends; without interpolation the nearer knot, the lower on a tie. NaN stays NaN."""
    x = x.cast("double")
    if len(pairs) < 2:
        return x
    (k0, v0), (kn, vn) = pairs[0], pairs[-1]
    out = F.when(F.isnan(x), x).when(x <= float(k0), _num(v0)).when(x >= float(kn), _num(vn))
    for (a, va), (b, vb) in zip(pairs, pairs[1:]):
        if interpolate:
            part = _num(va) + (_num(vb) - _num(va)) * ((x - _num(a)) / _num(b - a)) if b != a else _num(va)
        else:
            part = F.when(_num(b) - x < x - _num(a), _num(vb)).otherwise(_num(va))
        out = out.when((x >= float(a)) & (x <= float(b)), part)
    return out.otherwise(x)


def _within(x: Column, low: float, high: float, whole: bool) -> Column:
    held = (x >= _num(low)) & ((x <= _num(high)) if whole else (x < _num(high)))
    return held if whole else held & ~_nan(x)


def _first(cases: Sequence[tuple[Column, Column]], rest: Column) -> Column:
    out = F
    for when, then in cases:
        out = out.when(when, then)
    return out.otherwise(rest) if cases else rest


def _text(v: Text) -> Column:
    """A text, or a nested conversion of the same value."""
    return v.cast("string") if isinstance(v, Column) else F.lit(v).cast("string")


def range_value(x: Column, ranges: Sequence[tuple[float, float, float]], default: float, whole: bool) -> Column:
    """Value of the first range that holds x; its upper bound counts for integers only."""
    return _first([(_within(x, a, b, whole), _num(v)) for a, b, v in ranges], _num(default))


def range_text(x: Column, ranges: Sequence[tuple[float, float, Text]], default: Text, whole: bool) -> Column:
    """Text of the first range that holds x; every text may be a nested conversion."""
    return _first([(_within(x, a, b, whole), _text(v)) for a, b, v in ranges], _text(default))


def value_text(x: Column, pairs: Sequence[tuple[float, Text]], default: Text) -> Column:
    """Text of the first equal key; every text may be a nested conversion of the same value. NaN equals no key."""
    return _first([((x == k) & ~_nan(x), _text(v)) for k, v in pairs if k == k], _text(default))


def text_value(x: Column, pairs: Sequence[tuple[str, float]], default: float | None) -> Column:
    return _first([(x == k, _num(v)) for k, v in pairs], F.lit(default).cast("double"))


def text_text(x: Column, pairs: Sequence[tuple[str, str | None]], default: str | None) -> Column:
    """The text of the first equal key, or the text itself if it has none; of other texts the default, or the text itself."""
    return _first([(x == k, x if v is None else F.lit(v)) for k, v in pairs], x if default is None else F.lit(default))


def mask_bits(value: float) -> int:
    """The mask that a conversion's number stands for: its bit pattern, as a signed 64-bit integer."""
    return struct.unpack("<q", struct.pack("<d", value))[0]


def bitfield_text(x: Column, parts: Sequence[tuple[int | float, str | None, Sequence[tuple[float, Text]] | Callable[[Column], Column]]]) -> Column:
    """The texts of masked values, `name = text` if named, joined with |; parts without a text are left out.

    A mask that is a float stands for its bit pattern. A part's texts are pairs of
    value and text, or any conversion of the masked value to text.
    """
    texts = []
    for mask, name, inner in parts:
        masked = x.bitwiseAND(F.lit(mask_bits(mask) if isinstance(mask, float) else mask))
        t = inner(masked) if callable(inner) else value_text(masked, inner, None)
        texts.append(F.concat(F.lit(f"{name} = "), t) if name else t)
    return F.concat_ws("|", *texts)


def bits_unsigned(x: Column, offset: int, count: int) -> Column:
    shifted = F.shiftrightunsigned(x, offset) if offset else x
    return shifted if count >= 64 else shifted.bitwiseAND(F.lit((1 << count) - 1))


def bits_signed(x: Column, offset: int, count: int) -> Column:
    if count >= 64:
        return x
    sign = F.lit(1 << (count - 1))
    return bits_unsigned(x, offset, count).bitwiseXOR(sign) - sign


def floats(x: Column) -> Column:
    """A value as a float, NaN where it is null: for the edge of an API only."""
    return F.coalesce(x.cast("double"), _num(NAN))


def valid(flags: Column, invalid_bits: Column, position: int) -> Column:
    """False if the record is flagged, or bits are in use and this one is set."""
    return ~((flags.bitwiseAND(1) != 0) | ((flags.bitwiseAND(2) != 0) & (F.shiftright(invalid_bits, position).bitwiseAND(1) != 0)))


def text_decode(raw: Column, charset: str) -> Column:
    """Text of bytes without the zeros at its end; bad UTF-8 is a fixed text, an odd number of UTF-16 bytes no text."""
    if charset == "UTF-8":
        out = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.lit("<Invalid UTF8>"))
        out = F.when(raw.isNotNull(), out)
    else:
        out = F.decode(raw, charset)
        if charset.startswith("UTF-16"):
            out = F.when(F.octet_length(raw) % 2 == 0, out)
    return F.regexp_replace(out, "\\x00+$", "")
