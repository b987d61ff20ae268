"""Cell values as a reader sees them under a number format."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Format tokens that show a time of day.
TIME_TOKENS = ["h:", "hh:", "ss", "am/pm"]
MAX_DECIMALS = 10
GENERAL_DIGITS = 10


def decimals_of(fmt: Column) -> Column:
    """Decimal places a format asks for: digits after the last point, first section only."""
    tail = F.substring_index(F.substring_index(fmt, ".", -1), ";", 1)
    places = F.least(F.length(F.rtrim(tail, F.lit(")%"))), F.lit(MAX_DECIMALS))
    return F.when(F.contains(fmt, F.lit(".")), places).otherwise(F.lit(0))


def _percent_decimals(fmt: Column) -> Column:
    tail = F.rtrim(F.substring_index(fmt, ".", -1), F.lit("%"))
    return F.when(F.contains(fmt, F.lit(".")), F.length(tail)).otherwise(F.lit(0))


def fixed(x: Column, places: Column, thousands: Column) -> Column:
    """Fixed-point text, halves to even; a small negative number keeps its sign except as a whole number."""
    text = F.call_function("format_number", x, places.cast("int"))
    whole = F.when(text == "-0", "0").otherwise(text)
    signed = F.when((x < 0) & ~F.startswith(text, F.lit("-")), F.concat(F.lit("-"), text)).otherwise(text)
    text = F.when(places == 0, whole).otherwise(signed)
    return F.when(thousands, text).otherwise(F.replace(text, F.lit(","), F.lit("")))


def _without_zeros(text: Column) -> Column:
    """Drops zeros at the end of a fraction, and a point that nothing follows; a whole number stays as it is."""
    return F.when(F.contains(text, F.lit(".")), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)


def general(x: Column) -> Column:
    """Natural form: integers plain, otherwise ten significant digits without trailing zeros.

    The exponent is that of the rounded number, so 9.99999999999e-05 is 0.0001.
    """
    rounded = F.split(F.format_string(f"%.{GENERAL_DIGITS - 1}e", x), "e")
    e = rounded[1].cast("int")
    plain = _without_zeros(fixed(x, F.greatest(F.lit(0), F.lit(GENERAL_DIGITS - 1) - e), F.lit(False)))
    exponent = F.concat(F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
    scientific = F.concat(_without_zeros(rounded[0]), F.lit("e"), exponent)
    whole = x.cast("decimal(38,0)").cast("string")
    return F.when(x == F.floor(x), whole).when((e < -4) | (e >= GENERAL_DIGITS), scientific).otherwise(plain)


def display_number(x: Column, fmt: Column) -> Column:
    fmt = F.coalesce(fmt, F.lit("General"))
    thousands = F.contains(fmt, F.lit(","))
    percent = F.concat(fixed(x * 100, _percent_decimals(fmt), F.lit(False)), F.lit("%"))
    return (
        F.when(x.isNull(), "")
        .when(F.contains(fmt, F.lit("%")), percent)
        .when(fmt == "General", general(x))
        .otherwise(fixed(x, decimals_of(fmt), thousands))
    )


def display_time(ts: Column, fmt: Column) -> Column:
    low = F.lower(F.coalesce(fmt, F.lit("General")))
    timed = F.greatest(*[F.contains(low, F.lit(t)).cast("int") for t in TIME_TOKENS]) == 1
    return F.when(ts.isNull(), "").when(timed, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise(
        F.date_format(ts, "yyyy-MM-dd")
    )
