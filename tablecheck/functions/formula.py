"""Formula texts: display form, references, function prefixes, defined names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Functions that files must store with a compatibility prefix.
PREFIXED_FUNCTIONS = [
    "SORT", "SORTBY", "UNIQUE", "FILTER", "SEQUENCE", "RANDARRAY", "XLOOKUP", "XMATCH", "LET", "LAMBDA", "MAP",
    "REDUCE", "SCAN", "MAKEARRAY", "BYROW", "BYCOL", "ISOMITTED", "CHOOSECOLS", "CHOOSEROWS", "DROP", "TAKE",
    "EXPAND", "WRAPCOLS", "WRAPROWS", "TOCOL", "TOROW", "VSTACK", "HSTACK", "TEXTSPLIT", "TEXTBEFORE",
    "TEXTAFTER", "VALUETOTEXT", "ARRAYTOTEXT", "CONCAT", "IFS", "SWITCH", "MINIFS", "MAXIFS", "TEXTJOIN",
]
PREFIX = "_xlfn."

_REF_RE = r"'((?:[^']|'')+)'!|(?<![\p{L}\p{N}_.'])([\p{L}\p{N}_.]+)!"


def shown_formula(kind: Column, text: Column, r1: Column, r2: Column) -> Column:
    """Formula as listed: arrays in braces, data tables by their inputs, null for plain values."""
    return (
        F.when(kind == "array", F.concat(F.lit("{"), text, F.lit("}")))
        .when(kind == "table", F.concat(F.lit("{TABLE: r1="), r1, F.lit(", r2="), r2, F.lit("}")))
        .when(F.startswith(text, F.lit("=")), text)
    )


def is_error_value(computed: Column) -> Column:
    return F.coalesce(F.startswith(computed, F.lit("#")), F.lit(False))


def add_prefix(formula: Column) -> Column:
    """Prefix before every call of such a function: its name before a bracket, not preceded by a word character or a point."""
    names = "|".join(PREFIXED_FUNCTIONS)
    return F.regexp_replace(formula, rf"(?i)(?<![\w.])({names})\(", PREFIX + "$1(")


def uses_indirect(formula: Column) -> Column:
    return F.contains(F.upper(formula), F.lit("INDIRECT("))


def sheet_refs(formula: Column) -> Column:
    """Distinct sheet names a formula names, quoted or not, with doubled quotes undone.

    Reading the names out of the text turns "mentions another sheet" into an
    equality join instead of a containment test against every sheet.
    """
    quoted = F.regexp_extract_all(formula, F.lit(_REF_RE), F.lit(1))
    bare = F.regexp_extract_all(formula, F.lit(_REF_RE), F.lit(2))
    names = F.concat(F.transform(quoted, lambda x: F.replace(x, F.lit("''"), F.lit("'"))), bare)
    return F.array_distinct(F.filter(names, lambda x: x != ""))


def name_scope(destinations: Column, attr_text: Column) -> Column:
    """Defined name: over several sheets, bound to one, or local."""
    return F.when(destinations > 1, "spans sheets").when(
        (destinations == 1) & F.contains(attr_text, F.lit("!")), "cross-sheet"
    ).otherwise("local")


def name_broken(attr_text: Column) -> Column:
    return F.contains(attr_text, F.lit("#REF!"))


_CELL = r"\$?([A-Za-z]{1,3})\$?(\d+)"
_AREA_RE = rf"(?:'((?:[^']|'')+)'|(?<![#\p{{L}}\p{{N}}_.'])([\p{{L}}\p{{N}}_.]+))!{_CELL}(?::{_CELL})?"


def column_number(letters: Column) -> Column:
    """1 for A, 27 for AA."""
    digits = F.transform(F.split(F.upper(letters), ""), lambda c: F.ascii(c) - 64)
    return F.aggregate(digits, F.lit(0), lambda n, d: n * 26 + d)


def areas(attr_text: Column) -> Column:
    """Rectangles that a defined name stands for: structs of sheet, top, left, bottom, right (rows and columns from 1).

    Areas without a sheet and broken ones are left out; a rectangle may be written from any of its corners.
    """
    part = lambda n: F.regexp_extract_all(attr_text, F.lit(_AREA_RE), F.lit(n))
    found = F.arrays_zip(*[part(n).alias(k) for n, k in enumerate(("quoted", "bare", "c1", "r1", "c2", "r2"), 1)])

    def area(x: Column) -> Column:
        c1, r1 = column_number(x["c1"]), x["r1"].cast("int")
        single = x["c2"] == ""
        c2, r2 = F.when(single, c1).otherwise(column_number(x["c2"])), F.when(single, r1).otherwise(x["r2"].try_cast("int"))
        sheet = F.when(x["quoted"] != "", F.replace(x["quoted"], F.lit("''"), F.lit("'"))).otherwise(x["bare"])
        return F.struct(sheet.alias("sheet"), F.least(r1, r2).alias("top"), F.least(c1, c2).alias("left"), F.greatest(r1, r2).alias("bottom"), F.greatest(c1, c2).alias("right"))

    return F.transform(found, area)
