"""Cell-level rules: emptiness, numeric parsing, tolerant equality.

Everything is a plain ``Column -> Column`` function, so a comparison over
thousands of columns stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

REL_TOL = 0.001
ZERO_EPS = 1e-10

# Characters that do not count when cells are compared.
WHITESPACE = " \t\n\r\x0b\x0c"
MONEY_MARKS = ",$€¥"

_DIGITS = r"[0-9]+(?:_[0-9]+)*"
NUMBER_RE = (
    rf"(?i)^[+-]?(?:(?:{_DIGITS}[.]?(?:{_DIGITS})?|[.]{_DIGITS})(?:e[+-]?{_DIGITS})?|inf|infinity|nan)$"
)


def strip(c: Column) -> Column:
    """Trim every kind of blank, not only spaces."""
    return F.trim(c, F.lit(WHITESPACE))


def clean_number(c: Column) -> Column:
    """Trimmed text without thousand separators and currency signs."""
    return F.translate(strip(c), MONEY_MARKS, "")


def try_numeric(text: Column) -> Column:
    """Number held in a text cell, or null.

    ``try_cast`` alone also takes Java suffixes (``1d``), hence the guard.
    """
    literal = F.regexp_extract(strip(text), NUMBER_RE, 0)
    return F.translate(literal, "_", "").try_cast("double")


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def is_float_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DoubleType, T.FloatType))


def nan_to_null(c: Column, dt: T.DataType) -> Column:
    return F.when(~F.isnan(c), c) if is_float_type(dt) else c


def canonical_text(c: Column, dt: T.DataType) -> Column:
    """Text form of a typed cell; integral floats look like integers, NaN is null."""
    if isinstance(dt, T.StringType):
        return c
    if is_float_type(dt):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(whole, c.cast("bigint").cast("string")).when(~F.isnan(c), c.cast("string"))
    if isinstance(dt, T.DecimalType):
        d = c.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
        return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def is_empty(c: Column, dt: T.DataType | None = None) -> Column:
    """Null, NaN or blank text."""
    if dt is None or isinstance(dt, T.StringType):
        return c.isNull() | (strip(c) == "")
    if is_float_type(dt):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def close_numbers(x: Column, y: Column, tol: float = REL_TOL) -> Column:
    """Relative closeness; false when either side is no number."""
    near = F.abs(x - y) / F.greatest(F.abs(x), F.abs(y)) < F.lit(tol)
    return F.coalesce(F.when(F.abs(x) < ZERO_EPS, F.abs(y) < ZERO_EPS).otherwise(near), F.lit(False))


def as_number(c: Column, dt: T.DataType) -> Column:
    return c.cast("double") if is_numeric_type(dt) else try_numeric(clean_number(canonical_text(c, dt)))


def quick_match(a: Column, b: Column, a_type: T.DataType, b_type: T.DataType) -> Column:
    """Verdict that needs no number parsing: true, false, or null when still open."""
    if is_numeric_type(a_type) and is_numeric_type(b_type):
        equal = a == b
    elif is_numeric_type(a_type) or is_numeric_type(b_type):
        equal = F.lit(False)
    elif isinstance(a_type, T.StringType) or isinstance(b_type, T.StringType):
        s, t = canonical_text(a, a_type), canonical_text(b, b_type)
        equal = (strip(s) == strip(t)) | (clean_number(s) == clean_number(t))
    else:
        return a.eqNullSafe(b)
    return (
        F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).when(equal, True)
    )


def values_match(
    a: Column,
    b: Column,
    a_type: T.DataType | None = None,
    b_type: T.DataType | None = None,
    rel_tol: float = REL_TOL,
) -> Column:
    """Tolerant equality of two cells; never null.

    Both missing is a match, one missing is not.  Texts match when they are
    equal after trimming, equal without money marks, or numerically within
    ``rel_tol``.  For many columns use :func:`match_codes`, which names the
    intermediate values instead of repeating them.
    """
    a_type, b_type = a_type or T.StringType(), b_type or T.StringType()
    a, b = nan_to_null(a, a_type), nan_to_null(b, b_type)
    return F.coalesce(
        quick_match(a, b, a_type, b_type), close_numbers(as_number(a, a_type), as_number(b, b_type), rel_tol)
    )


def is_fill(a: Column, b: Column, a_type: T.DataType | None = None, b_type: T.DataType | None = None) -> Column:
    """Source cell empty, generated cell not: expected completion when the two do not match."""
    return is_empty(a, a_type) & ~is_empty(b, b_type)


MATCH, FILL, DIFF = 0, 1, 2


def match_codes(df: DataFrame, pairs: list[tuple], keep: list[str]) -> DataFrame:
    """Compare column pairs: ``c{i}`` is MATCH, FILL or DIFF; ``s{i}``/``g{i}`` the texts shown.

    Each pair is (source column, type, generated column, type, tolerance).  The
    steps are separate projections, so every intermediate value is computed once
    and numbers are parsed only for cells that plain equality leaves open.
    """
    n = range(len(pairs))
    vals = [(f"a{i}", nan_to_null(p[0], p[1])) for i, p in enumerate(pairs)]
    vals += [(f"b{i}", nan_to_null(p[2], p[3])) for i, p in enumerate(pairs)]
    df = df.select(*keep, *[v.alias(k) for k, v in vals])
    quick = [quick_match(F.col(f"a{i}"), F.col(f"b{i}"), pairs[i][1], pairs[i][3]).alias(f"q{i}") for i in n]
    df = df.select("*", *quick)
    open_ = [F.col(f"q{i}").isNull() for i in n]
    nums = [F.when(open_[i], as_number(F.col(f"a{i}"), pairs[i][1])).alias(f"x{i}") for i in n]
    nums += [F.when(open_[i], as_number(F.col(f"b{i}"), pairs[i][3])).alias(f"y{i}") for i in n]
    df = df.select("*", *nums)
    codes, shown = [], []
    for i in n:
        a, b = F.col(f"a{i}"), F.col(f"b{i}")
        same = F.coalesce(F.col(f"q{i}"), close_numbers(F.col(f"x{i}"), F.col(f"y{i}"), pairs[i][4]))
        fill = is_fill(a, b, pairs[i][1], pairs[i][3])
        codes.append(F.when(same, MATCH).when(fill, FILL).otherwise(DIFF).alias(f"c{i}"))
        shown += [canonical_text(a, pairs[i][1]).alias(f"s{i}"), canonical_text(b, pairs[i][3]).alias(f"g{i}")]
    return df.select(*keep, *codes, *shown)


def key_text(c: Column, dt: T.DataType) -> Column:
    """Join form of a key cell.  Missing keys join each other under a marker no text cell holds."""
    return F.coalesce(canonical_text(c, dt), F.lit("\x00null"))
