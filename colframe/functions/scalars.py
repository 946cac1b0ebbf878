"""Element-wise functions: expressions over columns that give the same results whether ANSI mode is on or off."""

from __future__ import annotations

from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dtypes import INTEGER_BITS, is_float, is_integer, to_spark

NAN, INF = float("nan"), float("inf")


def col(x: Any) -> Column:
    """A column as it is, a name as that column, anything else as a literal."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def operand(x: Any) -> Column:
    """Operands are columns or scalars; a plain string is a scalar here."""
    return x if isinstance(x, Column) else F.lit(x)


def wrapped(x: Column, bits: int) -> Column:
    """A whole number as a two's complement integer of so many bits: beyond the range it wraps around."""
    wide, half = x.cast("decimal(38,0)"), F.lit(Decimal(1 << (bits - 1))).cast("decimal(38,0)")
    return F.pmod(wide + half, F.lit(Decimal(1 << bits)).cast("decimal(38,0)")) - half


def narrowed(x: Column, bits: int) -> Column:
    """A bigint wrapped around at fewer bits: the sign is that of the highest bit that stays."""
    return F.shiftright(F.shiftleft(x, 64 - bits), 64 - bits)


# ---- casts and rounding


def cast(x: Any, kind: Any, source: Any = None) -> Column:
    """Unsafe cast: narrowing wraps, floats are truncated towards zero, NaN becomes 0.

    ``source`` is the column's type; given, casts that can't overflow are plain ones."""
    x, to = col(x), to_spark(kind)
    if source is not None:
        source = to_spark(source)
        if not is_integer(to) or (is_integer(source) and INTEGER_BITS[type(source)] <= INTEGER_BITS[type(to)]):
            return x.cast(to)
        if isinstance(source, (T.BooleanType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            return x.cast(to)
        if isinstance(source, T.DayTimeIntervalType):
            return (F.extract(F.lit("DAY"), x) * 86_400_000_000 + F.extract(F.lit("HOUR"), x) * 3_600_000_000 + F.extract(F.lit("MINUTE"), x) * 60_000_000 + F.extract(F.lit("SECOND"), x) * 1_000_000).cast(to)
        if is_float(source):
            finite = F.when(F.isnan(x) | (F.abs(x) >= 1e37), F.lit(0.0)).otherwise(x)
            whole = (finite - finite % 1).cast("decimal(38,0)")
            return F.when(x.isNotNull(), wrapped(whole, INTEGER_BITS[type(to)]).cast(to))
        return (narrowed(x.cast("long"), INTEGER_BITS[type(to)]) if is_integer(source) else wrapped(x, INTEGER_BITS[type(to)])).cast(to)
    return x.cast(to)


def round_(x: Any, digits: int = 0, mode: str = "half_to_even") -> Column:
    """``half_to_even`` or ``half_away_from_zero``; digits may be negative."""
    if mode == "half_to_even":
        return F.bround(col(x), digits)
    if mode == "half_away_from_zero":
        return F.round(col(x), digits)
    raise ValueError(f"unknown rounding mode {mode!r}")


def rounded(x: Any, digits: int = 0) -> Column:
    """Doubles as DuckDB rounds them: times a power of ten, half away from zero, divided again. The product is a double too, so a
    value just below a tie may be rounded up, unlike by Spark's ``round``, which goes by the decimals of the value."""
    x = col(x).cast("double")
    scale = 10.0 ** abs(digits)
    out = F.round(x * scale) / scale if digits >= 0 else F.round(x / scale) * scale
    # a product beyond the doubles leaves the value as it is
    return F.when(F.abs(out) < INF, out).otherwise(x)


# ---- binary operations


def _either_nan(a: Column, b: Column) -> Column:
    return F.isnan(a) | F.isnan(b)


def plain_nan(x: Column) -> Column:
    """Doubles with one NaN: processors set the sign of the NaN that an operation makes, which shows in bits and in text (``-nan``)."""
    return F.when(F.isnan(x), F.lit(NAN)).otherwise(x)


def divide(a: Any, b: Any) -> Column:
    """IEEE division of doubles: by zero it gives infinities or NaN, also of negative zero."""
    a, b = operand(a).cast("double"), operand(b).cast("double")
    return plain_nan(F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / F.when(b != 0, b)))


def ln(x: Any) -> Column:
    """Natural logarithm: NaN below zero, minus infinity at zero."""
    x = operand(x).cast("double")
    return F.when(x < 0, F.lit(NAN)).when(x == 0, F.lit(-INF)).otherwise(F.ln(x))


def _compared(op: str, a: Column, b: Column, floats: bool) -> Column:
    out = {"equal": a == b, "not_equal": a != b, "less": a < b, "less_equal": a <= b, "greater": a > b, "greater_equal": a >= b}[op]
    if not floats:
        return out
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(_either_nan(a, b), F.lit(op == "not_equal")).otherwise(out)


COMPARISONS = ("equal", "not_equal", "less", "less_equal", "greater", "greater_equal")
LOGICAL = ("and", "or", "and_kleene", "or_kleene", "xor")
BITWISE = ("bit_wise_and", "bit_wise_or", "bit_wise_xor", "shift_left", "shift_right")
ARITHMETIC = ("add", "subtract", "multiply", "divide", "true_divide", "power", "logb", "atan2", "floor_divide", "mod")
ELEMENT_WISE = ("max_element_wise", "min_element_wise")


def is_nan(x: Column) -> Column:
    """Whether a value is NaN, of a column of any type: Spark folds the test away where it isn't of floats."""
    return F.typeof(x).isin("float", "double") & (x == F.lit("NaN"))


def binary(lhs: Any, rhs: Any, op: str, output_type: Any = None, floats: bool = False) -> Column:
    """An operation of two columns or scalars, cast to ``output_type``. The result is null if an operand is, but for the
    Kleene operations, which follow three-valued logic, and the element-wise maximum and minimum, which leave out null,
    and NaN too if another value is there.

    Arithmetic of an integer output type wraps around on overflow, and its division truncates, by zero giving
    null; of other types it is that of doubles. ``floats`` says that compared values may be NaN, which equals nothing."""
    a, b = operand(lhs), operand(rhs)
    to = to_spark(output_type) if output_type is not None else None
    if op in COMPARISONS:
        out = _compared(op, a, b, floats)
    elif op in LOGICAL:
        a, b = a.cast("boolean"), b.cast("boolean")
        if op == "and_kleene":
            out = a & b
        elif op == "or_kleene":
            out = a | b
        else:
            out = F.when(a.isNotNull() & b.isNotNull(), a & b if op == "and" else a | b if op == "or" else a != b)
    elif op in ELEMENT_WISE:
        x, y = (F.when(~F.coalesce(is_nan(v), F.lit(False)), v) for v in (a, b))
        out = F.coalesce((F.greatest if op == "max_element_wise" else F.least)(x, y), a, b)
    elif op in BITWISE:
        out = {
            "bit_wise_and": lambda: a.bitwiseAND(b), "bit_wise_or": lambda: a.bitwiseOR(b), "bit_wise_xor": lambda: a.bitwiseXOR(b),
            "shift_left": lambda: F.call_function("shiftleft", a, b.cast("int")), "shift_right": lambda: F.call_function("shiftright", a, b.cast("int")),
        }[op]()
    elif op in ("add", "subtract", "multiply") and to is not None and is_integer(to):
        x, y = a.cast("decimal(38,0)") if op == "multiply" else a.cast("decimal(20,0)"), b.cast("decimal(38,0)") if op == "multiply" else b.cast("decimal(20,0)")
        plain = {"add": F.try_add, "subtract": F.try_subtract, "multiply": F.try_multiply}[op](a.cast("long"), b.cast("long"))
        exact = x + y if op == "add" else x - y if op == "subtract" else x * y
        bits = INTEGER_BITS[type(to)]
        # within 64 bits nothing wide is evaluated
        out = F.coalesce(plain, wrapped(exact, 64).cast("long"))
        out = out if bits == 64 else narrowed(out, bits)
    elif op == "divide" and to is not None and is_integer(to):
        a, b = a.cast("long"), b.cast("long")
        # the least number has no negative: it stays as it is
        out = F.when(b == -1, F.coalesce(F.try_subtract(F.lit(0).cast("long"), a), a)).otherwise(F.call_function("div", a, F.when((b != 0) & (b != -1), b)))
    elif op in ("add", "subtract", "multiply"):
        out = a + b if op == "add" else a - b if op == "subtract" else a * b
    elif op in ("divide", "true_divide"):
        out = divide(a, b)
    elif op == "power":
        out = plain_nan(F.pow(a.cast("double"), b.cast("double")))
    elif op == "logb":
        out = divide(ln(a), ln(b))
    elif op == "atan2":
        out = plain_nan(F.atan2(a.cast("double"), b.cast("double")))
    elif op == "floor_divide":
        out = F.floor(a / F.when(b != 0, b))
    elif op == "mod":
        out = F.pmod(a, F.when(b != 0, b))
    else:
        raise ValueError(f"unknown binary operation {op!r}")
    return out if to is None else out.cast(to)


def is_between(x: Any, low: Any, high: Any, closed: str = "both") -> Column:
    """``closed``: both, left, right or none of the bounds belong to the range. Three-valued logic."""
    if closed not in ("both", "left", "right", "none"):
        raise ValueError(f"unknown closed side {closed!r}")
    x, low, high = col(x), operand(low), operand(high)
    above = x >= low if closed in ("both", "left") else x > low
    return above & (x <= high if closed in ("both", "right") else x < high)


# ---- unary operations

_DOUBLE = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh, "arcsinh": F.asinh, "arccosh": F.acosh, "arctanh": F.atanh,
    "exp": F.exp, "sqrt": F.sqrt, "ln": ln, "log": ln, "cbrt": F.cbrt,
}
UNARY = (*_DOUBLE, "ceil", "floor", "abs", "negate", "round", "bit_wise_not", "invert", "is_nan", "is_null", "is_valid", "sign")


def unary(x: Any, op: str, kind: Any = None) -> Column:
    """An operation on one column. The result has the column's type ``kind`` if that is given, but for the tests
    (is_nan, is_null, is_valid, invert), which are boolean. ``round`` is half to even."""
    x = col(x)
    if op in _DOUBLE:
        out = plain_nan(_DOUBLE[op](x.cast("double")))
    elif op in ("ceil", "floor", "abs", "sign"):
        out = {"ceil": F.ceil, "floor": F.floor, "abs": F.abs, "sign": F.signum}[op](x)
        if op in ("ceil", "floor") and (kind is None or is_float(to_spark(kind))):
            # beyond 2^53, and for NaN and infinities, a double is whole already
            out = F.when(F.isnan(x) | (F.abs(x) >= 2.0**53), x.cast("double")).otherwise(out.cast("double"))
    elif op == "negate":
        out = -x
    elif op == "round":
        out = F.rint(x.cast("double"))
    elif op == "bit_wise_not":
        out = F.bitwise_not(x)
    elif op == "invert":
        return ~x
    elif op == "is_nan":
        return F.when(x.isNotNull(), F.isnan(x))
    elif op == "is_null":
        return x.isNull()
    elif op == "is_valid":
        return x.isNotNull()
    else:
        raise ValueError(f"unknown unary operation {op!r}")
    return out if kind is None else out.cast(to_spark(kind))


# ---- choices and nulls


def if_else(cond: Any, lhs: Any, rhs: Any) -> Column:
    """``lhs`` where the condition is true, else ``rhs``; a null condition chooses ``rhs``."""
    return F.when(col(cond), operand(lhs)).otherwise(operand(rhs))


def fill_null(x: Any, value: Any, kind: Any = None) -> Column:
    """Nulls replaced by a scalar; a null scalar replaces nothing."""
    value = operand(value)
    return F.coalesce(col(x), value if kind is None else value.cast(to_spark(kind)))


def mask_nans(x: Any) -> Column:
    """NaN as null."""
    x = col(x)
    return F.when(~F.isnan(x), x)


def is_in(x: Any, values: list) -> Column:
    """Whether the value is one of the list's; nulls of the list match nothing, and a null value gives null."""
    x, known = col(x), [v for v in values if v is not None]
    return F.when(x.isNotNull(), x.isin(known) if known else F.lit(False))
