import math

import pytest
from pyspark.sql import functions as F, types as T

from tablecheck.functions import cells, display, replies as rp
from tablecheck.operators.profile import dtype_of
from tablecheck.operators.reconcile import error_band, low_match_note, row_ratio_note
from tablecheck.operators.workbook import border_coverage

TEXT_CASES = [
    (None, None, True), (None, "", False), ("", " ", True), ("1,000", "1000", True), ("$5", "5.0", True),
    ("0", "0.0", True), ("1e-11", "0", True), ("1000", "1000.9", True), ("1000", "1001.1", False), ("1d", "1", False),
    ("nan", "nan", True), ("inf", "-inf", False), ("-5", "5", False), ("1_000", "1000", True), (" a ", "a", True),
    ("a", "b", False), ("nan", "1", False), ("inf", "5", False), ("€1.5", "¥1.5", True), ("\t7\n", "7", True),
]


def test_text_match(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(TEXT_CASES)], "i int, a string, b string")
    got = {r.i: r.m for r in df.select("i", cells.values_match(F.col("a"), F.col("b")).alias("m")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(TEXT_CASES)}


def test_number_match(spark):
    rows = [(float("nan"), None, True), (float("nan"), float("nan"), True), (1e-11, 0.0, True), (0.0, 1e-11, True),
            (1000.0, 1000.9, True), (1000.0, 1001.1, False), (float("inf"), float("inf"), True), (None, 1.0, False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "i int, a double, b double")
    d = T.DoubleType()
    got = {r.i: r.m for r in df.select("i", cells.values_match(F.col("a"), F.col("b"), d, d).alias("m")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(rows)}


def test_match_codes_agree_with_values_match(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(TEXT_CASES)], "i int, a string, b string")
    s = T.StringType()
    coded = cells.match_codes(df, [(F.col("a"), s, F.col("b"), s, 0.001)], ["i"])
    got = {r.i: r.c0 == cells.MATCH for r in coded.collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(TEXT_CASES)}
    fills = {r.i for r in coded.where(F.col("c0") == cells.FILL).collect()}
    assert fills == set()
    one = spark.createDataFrame([(1, " ", "x"), (2, None, "x"), (3, "x", None)], "i int, a string, b string")
    codes = {r.i: r.c0 for r in cells.match_codes(one, [(F.col("a"), s, F.col("b"), s, 0.001)], ["i"]).collect()}
    assert codes == {1: cells.FILL, 2: cells.FILL, 3: cells.DIFF}


@pytest.mark.parametrize("text,want", [("12", 12.0), (" 12 ", 12.0), ("1d", None), ("1f", None), ("1_0", 10.0), ("_1", None),
                                       ("1e5", 1e5), (".5", 0.5), ("5.", 5.0), ("", None), ("-inf", -math.inf), ("0x1", None)])
def test_numeric_parse(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(cells.try_numeric(F.col("t")).alias("x")).first()
    assert row.x == want


def test_dtype_boundaries(spark):
    rows = [(100, 20, "mixed"), (100, 80, "mixed"), (100, 81, "numeric"), (100, 19, "string"), (0, 0, "empty")]
    df = spark.createDataFrame(rows, "n int, k int, want string")
    assert all(r.d == r.want for r in df.withColumn("d", dtype_of(F.col("n"), F.col("k"))).collect())


def test_notes(spark):
    rows = [(100, 29, "filtered subset"), (100, 30, None), (100, 300, None), (100, 301, "expanded")]
    df = spark.createDataFrame(rows, "source_rows int, generated_rows int, want string")
    assert all(r.n == r.want for r in df.withColumn("n", row_ratio_note()).collect())
    low = spark.createDataFrame([(49.9, 5, "positional"), (50.0, 5, "positional"), (49.9, 5, "key_based"), (1.0, 0, "positional")],
                                "match_pct double, comparable_rows int, match_method string")
    assert [r.n for r in low.select(low_match_note().alias("n")).collect()] == [
        "low match, row order may differ", None, "low match, values differ", None]
    band = spark.createDataFrame([(0.16,), (0.15,), (0.05,), (0.04,), (0.0,)], "x double")
    assert [r.b for r in band.select(error_band(F.col("x")).alias("b")).collect()] == [0, 1, 1, 2, 3]


@pytest.mark.parametrize("bordered,want", [(80, "some"), (81, "all"), (20, "few"), (21, "some"), (0, "none")])
def test_border_levels(spark, bordered, want):
    rows = [("c", False, 1, "thin" if i < bordered else None) for i in range(100)]
    df = spark.createDataFrame(rows, "case_id string, hidden boolean, row_idx int, border_style string")
    assert border_coverage(df).first().coverage == want


def test_score_band_and_pct(spark):
    rows = [(None, "na", 0.0), (0.0, "red", 0.0), (1.0, "red", 25.0), (1.5, "orange", 37.5), (2.5, "orange", 62.5),
            (3.5, "dark-green", 87.5), (4.0, "dark-green", 100.0), (5.0, "dark-green", 100.0)]
    df = spark.createDataFrame(rows, "s double, band string, pct double")
    for r in df.select("*", rp.score_band(F.col("s")).alias("b"), rp.score_pct(F.col("s")).alias("p")).collect():
        assert (r.b, r.p) == (r.band, r.pct)


#: Worked out by hand: value, format, what is shown.
SHOWN = [
    (0.0, "General", "0"), (-1.0, "General", "-1"), (3.14, "General", "3.14"), (5923912.0, "General", "5923912"),
    (1234567890.4, "General", "1234567890"), (1000000000.5, "General", "1000000000"), (12345678901.25, "General", "1.23456789e+10"),
    (0.5, "General", "0.5"), (0.00001234567, "General", "1.234567e-05"), (9.99999999999e-05, "General", "0.0001"), (9.99999999999, "General", "10"),
    (0.125, "0%", "12%"), (0.125, "0.00%", "12.50%"), (1.0, "0%", "100%"),
    (5923912.0, "#,##0", "5,923,912"), (1234567.891, "#,##0.00", "1,234,567.89"), (1234567.891, "#,##0.0;(#,##0.0)", "1,234,567.9"),
    (3.14, "0.000", "3.140"), (2.5, "0", "2"), (3.5, "0", "4"), (-0.3, "0", "0"), (-0.001, "0.00", "-0.00"), (12345678901.25, "0.0", "12345678901.2"),
]


def test_display_numbers(spark):
    df = spark.createDataFrame(SHOWN, "x double, f string, shown string")
    for r in df.select("*", display.display_number(F.col("x"), F.col("f")).alias("d")).collect():
        assert r.d == r.shown, (r.x, r.f)


REPLIES = [
    ("a", "a"), ("  {1} \n", "{1}"), ("```json\n{1}\n```", "{1}"), ("say ```\n{1}``` and ```two```", "{1}"), ("``` open", "``` open"), ("```json{1}```", "{1}"),
]


def test_fences(spark):
    df = spark.createDataFrame(REPLIES, "t string, want string")
    assert all(r.got == r.want for r in df.select("*", rp.strip_fences(F.col("t")).alias("got")).collect())


NUMBERED = [
    ("(1) a (2) b", ["a", "b"]), ("x (1) a", ["x", "a"]), ("1. a\n2) b", ["a", "b"]), ("only 1. a", []), ("1.5 is\n2.5 too", []), ("", []),
    ("  1. a\n\n 12. b\nc", ["a", "b\nc"]),
]


def test_numbered_parts(spark):
    df = spark.createDataFrame(NUMBERED, "t string, want array<string>")
    for r in df.select("*", rp.split_numbered(F.col("t")).alias("got")).collect():
        assert r.got == r.want, r.t
