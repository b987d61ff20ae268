"""Workbook facts keep their lists beside the counts."""

from tablecheck.operators import workbook as wb

STYLES = "case_id string, hidden boolean, font_name string, font_scheme string, font_color string, fill_color string"


def test_error_lines_are_listed_in_cell_order(spark):
    rows = [("a", 1, "S", 3, 1, "A3", "=B", "#REF!", True), ("a", 0, "R", 9, 2, "B9", "=C", "#N/A", True), ("a", 0, "R", 1, 1, "A1", "=D", "4", False)]
    found = spark.createDataFrame(
        rows, "case_id string, sheet_idx int, sheet string, row_idx long, col_idx int, coord string, shown string, computed_value string, has_error boolean"
    )
    got = wb.formula_stats(found, spark.createDataFrame([("a",), ("b",)], "case_id string")).orderBy("case_id").collect()
    assert [tuple(r) for r in got] == [("a", 3, 2, "R!B9: =C → #N/A\nS!A3: =B → #REF!"), ("b", 0, 0, "")]


def test_formatting_lists_everything(spark):
    rows = [("a", False, "X", None, "FF", "AA"), ("a", False, "W", None, "00000000", None), ("a", False, "T", "minor", None, None), ("b", False, "T", "minor", None, None), ("c", True, "X", None, "FF", None)]
    layout = spark.createDataFrame([("a", "S", "rule", "B9", 9), ("a", "S", "rule", "B1", 1), ("a", "R", "merged", "A1:B2", 5)], "case_id string, sheet string, kind string, item string, ord int")
    got = {r.case_id: r for r in wb.formatting(spark.createDataFrame(rows, STYLES), layout).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].fonts, got["a"].colors, got["a"].rules, got["a"].merged, got["a"].frozen) == ("W,X", "AA,FF", "S!B1,S!B9", "R!A1:B2", None)
    assert (got["a"].font_count, got["a"].color_count, got["a"].rule_count, got["a"].merged_count, got["a"].frozen_count) == (2, 2, 2, 1, 0)
    assert (got["b"].fonts, got["b"].colors, got["b"].rules) == ("T", None, None)
