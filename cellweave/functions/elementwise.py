"""Null-safe column builders. A NaN is turned into NULL where it may arise."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")
Kind = str  # "bool", "int", "float" or "other"


def kind_of(dtype: T.DataType) -> Kind:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.IntegralType):
        return "int"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    return "other"


def kind_of_value(value: object) -> Kind:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    return "float" if isinstance(value, float) else "other"


def no_nan(c: Column) -> Column:
    """NaN becomes NULL; infinities stay."""
    return F.when(~F.isnan(c), c)


def as_column(value: object) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, float) and math.isnan(value):
        return F.lit(None).cast("double")
    return F.lit(value)


def _num(c: Column, kind: Kind) -> Column:
    return c.cast("long") if kind == "bool" else c


def both(a: Kind, b: Kind) -> Kind:
    """The kind of a sum of values of two kinds."""
    return "float" if "float" in (a, b) else "int" if "int" in (a, b) or (a, b) == ("bool", "bool") else a


def divide(a: Column, b: Column) -> Column:
    """Floating division: by zero gives a signed infinity, 0 / 0 is missing."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, no_nan(F.try_divide(a, b))).when((b == 0) & (a > 0), F.lit(INF)).when((b == 0) & (a < 0), F.lit(-INF))


def ieee_divide(a: Column, b: Column) -> Column:
    """As divide, but 0 / 0 is NaN."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, a * INF).otherwise(F.try_divide(a, b))


def floor_divide(a: Column, b: Column, kind: Kind) -> Column:
    """Rounds towards minus infinity; integers by zero give 0, as arrays do."""
    if kind == "float":
        x, y = a.cast("double"), b.cast("double")
        q = F.try_divide(x, y)
        floored = F.when(F.abs(q) < 2.0**52, F.floor(F.when(F.abs(q) < 2.0**52, q)).cast("double")).otherwise(no_nan(q))
        return F.when(y != 0, floored).when((y == 0) & (x > 0), F.lit(INF)).when((y == 0) & (x < 0), F.lit(-INF))
    a, b = a.cast("long"), b.cast("long")
    safe = F.when(b != 0, b)
    rest = a % safe
    quotient = F.call_function("div", a, safe)
    lower = F.when((rest != 0) & ((rest < 0) != (safe < 0)), 1).otherwise(0)
    return F.when(b == 0, F.lit(0).cast("long")).otherwise(quotient - lower)


def modulo(a: Column, b: Column, kind: Kind) -> Column:
    """The remainder has the divisor's sign; by zero it is 0 for integers and missing for floats."""
    if kind == "float":
        x, y = a.cast("double"), b.cast("double")
        safe = F.when(y != 0, y)
        rest = x % safe
        return no_nan(F.when((rest != 0) & ((rest < 0) != (safe < 0)), rest + safe).otherwise(rest))
    a, b = a.cast("long"), b.cast("long")
    safe = F.when(b != 0, b)
    rest = a % safe
    return F.when(b == 0, F.lit(0).cast("long")).otherwise(F.when((rest != 0) & ((rest < 0) != (safe < 0)), rest + safe).otherwise(rest))


def power(a: Column, b: Column, kind: Kind) -> Column:
    p = no_nan(F.pow(a.cast("double"), b.cast("double")))
    return p.cast("long") if kind == "int" else p


def _logic(op: str, a: Column, b: Column, ka: Kind, kb: Kind) -> Column:
    if ka == "bool" and kb == "bool":
        return {"&": a & b, "|": a | b, "^": a != b}[op]
    a, b = a.cast("long"), b.cast("long")
    return {"&": a.bitwiseAND, "|": a.bitwiseOR, "^": a.bitwiseXOR}[op](b)


def binary(op: str, a: Column, b: Column, ka: Kind, kb: Kind) -> tuple[Column, Kind]:
    """Column and kind of `a op b` for Python's operator symbols."""
    kind = both(ka, kb)
    if op in ("<", "<=", ">", ">=", "==", "!="):
        told = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op]
        return F.coalesce(told, F.lit(op == "!=")), "bool"
    if op in ("&", "|", "^"):
        return _logic(op, a, b, ka, kb), "bool" if ka == kb == "bool" else "int"
    x, y = _num(a, ka), _num(b, kb)
    if op in "+-*":
        out = {"+": x + y, "-": x - y, "*": x * y}[op]
        return (no_nan(out) if kind == "float" else out), kind
    if op == "/":
        return divide(x, y), "float"
    if op == "//":
        return floor_divide(x, y, kind), kind
    if op == "%":
        return modulo(x, y, kind), kind
    if op == "**":
        return power(x, y, kind), kind
    if op == "<<":
        return F.call_function("shiftleft", x.cast("long"), y.cast("int")), "int"
    if op == ">>":
        return F.call_function("shiftright", x.cast("long"), y.cast("int")), "int"
    raise ValueError(f"unknown operator {op!r}")


def unary(op: str, a: Column, kind: Kind) -> tuple[Column, Kind]:
    if op == "-":
        return -_num(a, kind), both(kind, kind)
    if op == "+":
        return a, kind
    if op == "abs":
        return (a if kind == "bool" else F.abs(a)), kind
    if op == "~":
        return (~a, "bool") if kind == "bool" else (F.bitwise_not(a.cast("long")), "int")
    raise ValueError(f"unknown operator {op!r}")


def rounded(a: Column, digits: int = 0) -> Column:
    """Half to even, as arrays round."""
    return F.bround(a, digits)


def rounded_away(a: Column, digits: int) -> Column:
    """Half away from zero, as SQL rounds; what is below zero rounds to -0.0 at most, where F.round gives 0.0."""
    return F.abs(F.round(a, digits)) * F.signum(a)


def clip(a: Column, lo: object = None, hi: object = None) -> Column:
    out = a
    if lo is not None:
        out = F.greatest(out, as_column(lo))
    if hi is not None:
        out = F.least(out, as_column(hi))
    return F.when(a.isNotNull(), out)


def _f(fn: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda a: no_nan(fn(a.cast("double")))


def _propagating(fn: Callable) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.when(a.isNotNull() & b.isNotNull(), fn(a, b))


def _truth(c: Column) -> Column:
    """Truth of a value; a missing one is true, like NaN."""
    return F.coalesce(c.cast("double") != 0, F.lit(True))


#: Functions of one argument by their array names; results are floats unless listed below.
UNARY: dict[str, Callable[[Column], Column]] = {
    "exp": _f(F.exp), "exp2": _f(lambda a: F.pow(F.lit(2.0), a)), "expm1": _f(F.expm1), "log": _f(lambda a: F.when(a == 0, F.lit(-INF)).otherwise(F.log(a))), "log2": _f(lambda a: F.when(a == 0, F.lit(-INF)).otherwise(F.log2(a))),
    "log10": _f(lambda a: F.when(a == 0, F.lit(-INF)).otherwise(F.log10(a))), "log1p": _f(lambda a: F.when(a == -1, F.lit(-INF)).otherwise(F.log1p(a))), "sqrt": _f(F.sqrt), "cbrt": _f(F.cbrt), "square": lambda a: a * a, "reciprocal": lambda a: divide(F.lit(1.0), a),
    "sin": _f(F.sin), "cos": _f(F.cos), "tan": _f(F.tan), "arcsin": _f(F.asin), "arccos": _f(F.acos), "arctan": _f(F.atan), "sinh": _f(F.sinh), "cosh": _f(F.cosh), "tanh": _f(F.tanh), "arcsinh": _f(F.asinh), "arccosh": _f(F.acosh), "arctanh": _f(F.atanh),
    "deg2rad": _f(F.radians), "radians": _f(F.radians), "rad2deg": _f(F.degrees), "degrees": _f(F.degrees), "floor": _f(lambda a: F.floor(a).cast("double")), "ceil": _f(lambda a: F.ceil(a).cast("double")), "trunc": _f(lambda a: F.when(a < 0, F.ceil(a)).otherwise(F.floor(a)).cast("double")),
    "rint": _f(F.rint), "fabs": _f(F.abs), "absolute": F.abs, "abs": F.abs, "sign": _f(F.signum), "negative": lambda a: -a, "positive": lambda a: a, "isnan": lambda a: a.isNull(), "isfinite": lambda a: F.coalesce(F.abs(a.cast("double")) < INF, F.lit(False)),
    "isinf": lambda a: F.coalesce(F.abs(a.cast("double")) == INF, F.lit(False)), "logical_not": lambda a: ~_truth(a), "bitwise_not": lambda a: F.bitwise_not(a), "invert": lambda a: F.bitwise_not(a),
}
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "maximum": _propagating(F.greatest), "minimum": _propagating(F.least), "fmax": F.greatest, "fmin": F.least, "hypot": lambda a, b: no_nan(F.hypot(a, b)), "arctan2": lambda a, b: no_nan(F.atan2(a, b)),
    "copysign": lambda a, b: F.when(b < 0, -F.abs(a)).otherwise(F.when(b.isNotNull(), F.abs(a))), "heaviside": lambda a, b: F.when(a < 0, F.lit(0.0)).when(a > 0, F.lit(1.0)).when(a == 0, b.cast("double")),
    "logical_and": lambda a, b: _truth(a) & _truth(b), "logical_or": lambda a, b: _truth(a) | _truth(b), "logical_xor": lambda a, b: _truth(a) != _truth(b),
}
#: Array names of the operators.
BY_OPERATOR = {
    "add": "+", "subtract": "-", "multiply": "*", "divide": "/", "true_divide": "/", "floor_divide": "//", "mod": "%", "remainder": "%", "power": "**", "less": "<", "less_equal": "<=", "greater": ">", "greater_equal": ">=", "equal": "==", "not_equal": "!=",
    "bitwise_and": "&", "bitwise_or": "|", "bitwise_xor": "^", "left_shift": "<<", "right_shift": ">>",
}
BOOLEAN = frozenset("isnan isfinite isinf logical_not logical_and logical_or logical_xor".split())
KEEPS_KIND = frozenset("square absolute abs negative positive bitwise_not invert maximum minimum fmax fmin".split())


def call(name: str, args: list[Column], kinds: list[Kind]) -> tuple[Column, Kind]:
    """An elementwise function by its array name."""
    if name in BY_OPERATOR:
        return binary(BY_OPERATOR[name], *args, *kinds)
    table = UNARY if len(args) == 1 else BINARY
    if name not in table:
        raise NotImplementedError(f"no elementwise function {name!r} of {len(args)} arguments; apply() takes any column function")
    if name == "invert" and kinds == ["bool"]:
        return ~args[0], "bool"
    args = [_num(a, k) for a, k in zip(args, kinds, strict=True)]
    kind = "bool" if name in BOOLEAN else (both(kinds[0], kinds[-1]) if name in KEEPS_KIND else "float")
    return table[name](*args), kind
