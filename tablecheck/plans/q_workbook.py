"""Queries over cells, formulas, styles and charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecheck.functions import display as dp, formula as fm
from tablecheck.operators import workbook as wb
from tablecheck.plans.fixtures import fixture, fixture_sql, with_fixtures
from tablecheck.plans.registry import query, table

SHOWN_SQL = """CASE WHEN formula_kind = 'array' THEN '{' || formula || '}' WHEN formula_kind = 'table' THEN '{TABLE: r1=' || r1 || ', r2=' || r2 || '}'
WHEN starts_with(formula, '=') THEN formula END"""
_F6 = with_fixtures("f6") + f"""
, fo AS (SELECT * FROM (SELECT *, {SHOWN_SQL} AS shown, starts_with(computed_value, '#') AS has_error FROM f6) t WHERE shown IS NOT NULL)
"""


def _formulas(spark, sf):
    return wb.formulas(fixture(spark, sf, "f6"))


@query("p_has_formula", _F6 + "SELECT case_id, sheet, coord, shown FROM fo")
def p_has_formula(spark, sf):
    return _formulas(spark, sf).select("case_id", "sheet", "coord", "shown")


@query("p_formula_error", _F6 + "SELECT case_id, sheet, coord, computed_value FROM fo WHERE has_error")
def p_formula_error(spark, sf):
    return _formulas(spark, sf).where("has_error").select("case_id", "sheet", "coord", "computed_value")


@query("j_formula_value", with_fixtures("f6") + """
SELECT a.case_id, a.sheet, a.coord, a.formula, b.computed_value FROM f6 a LEFT JOIN (SELECT * FROM f6 WHERE row_idx % 7 <> 0) b USING (case_id, sheet, coord)
WHERE starts_with(a.formula, '=')""")
def j_formula_value(spark, sf):
    """Formula texts joined with computed values, which some cells lack."""
    cells = fixture(spark, sf, "f6")
    texts = cells.where(F.startswith("formula", F.lit("="))).select("case_id", "sheet", "coord", "formula")
    return wb.join_values(texts, cells.where("row_idx % 7 <> 0")).select("case_id", "sheet", "coord", "formula", "computed_value")


@query("agg_formula_stats", _F6 + """
SELECT case_id, coalesce(total_formulas, 0) AS total_formulas, coalesce(formula_errors, 0) AS formula_errors, coalesce(error_details, '') AS error_details
FROM (SELECT DISTINCT case_id FROM f6) every LEFT JOIN (SELECT case_id, count(*) AS total_formulas, count(*) FILTER (WHERE has_error) AS formula_errors FROM fo GROUP BY case_id) a USING (case_id) LEFT JOIN (
  SELECT case_id, string_agg(sheet || '!' || coord || ': ' || shown || ' → ' || computed_value, chr(10) ORDER BY sheet_idx, row_idx, col_idx) AS error_details
  FROM (SELECT * FROM fo WHERE has_error) t GROUP BY case_id) b USING (case_id)""")
def agg_formula_stats(spark, sf):
    """Formula and error counts with all error lines, for every case."""
    return wb.formula_stats(_formulas(spark, sf), fixture(spark, sf, "f6"))


@query("formula_error_lines", _F6 + """
SELECT case_id, sheet_idx, row_idx, col_idx, sheet || '!' || coord || ': ' || shown || ' → ' || computed_value AS line FROM fo WHERE has_error""")
def formula_error_lines(spark, sf):
    """Every formula error as a line."""
    return wb.error_lines(_formulas(spark, sf))


REFS_SQL = """
, names(target, quoted, bare) AS (VALUES ('Sheet 1', '''Sheet 1''!', NULL), ('Data', '''Data''!', '(^|[^A-Za-z0-9_.''])Data!'), ('It''s', '''It''''s''!', NULL))
, hit AS (SELECT fo.*, target FROM fo JOIN names ON (contains(formula, quoted) OR coalesce(regexp_matches(formula, bare), false)) AND target <> sheet WHERE starts_with(formula, '=')
          QUALIFY row_number() OVER (PARTITION BY case_id, sheet, target ORDER BY row_idx, col_idx) = 1)
"""


_AREA = r"""(?:''((?:[^'']|'''')+)''|([\p{L}\p{N}_.]+))!\$?([A-Za-z]{1,3})\$?(\d+)(?::\$?([A-Za-z]{1,3})\$?(\d+))?"""
_COLUMN = "list_reduce(list_prepend(0, list_transform(string_split(upper({0}), ''), lambda c: ascii(c) - 64)), lambda n, d: n * 26 + d)"
_AREAS = f"""
, an0 AS (SELECT case_id, name, attr_text, replace(attr_text, '#REF!', '#') AS t FROM f6_names)
, an1 AS (SELECT case_id, name, attr_text, unnest(list_zip({', '.join(f"regexp_extract_all(t, '{_AREA}', {n})" for n in range(1, 7))})) AS x FROM an0)
, an2 AS (SELECT case_id, name, attr_text, CASE WHEN x[1] <> '' THEN replace(x[1], '''''', '''') ELSE x[2] END AS sheet, CAST(x[4] AS INT) AS r1, {_COLUMN.format('x[3]')} AS c1,
          CASE WHEN x[5] = '' THEN CAST(x[4] AS INT) ELSE CAST(x[6] AS INT) END AS r2, CASE WHEN x[5] = '' THEN {_COLUMN.format('x[3]')} ELSE {_COLUMN.format('x[5]')} END AS c2 FROM an1)
, ar AS (SELECT case_id, name, attr_text, sheet, least(r1, r2) AS top, least(c1, c2) AS "left", greatest(r1, r2) AS bottom, greatest(c1, c2) AS "right" FROM an2)
"""
_NAMED = _F6 + f", f6_names AS ({fixture_sql('f6_names')})" + _AREAS


@query("j_cross_sheet", _NAMED + REFS_SQL + """
SELECT case_id, sheet, target, coord FROM hit
UNION ALL SELECT case_id, 'name ' || name, sheet, 'R' || top || 'C' || "left" || ':R' || bottom || 'C' || "right" FROM ar
QUALIFY row_number() OVER (PARTITION BY case_id, name, sheet ORDER BY top, "left", bottom, "right") = 1""")
def j_cross_sheet(spark, sf):
    """Sheet pairs linked by a formula, and sheets linked by defined names."""
    refs = wb.cross_sheet_refs(_formulas(spark, sf), fixture(spark, sf, "f6").select("case_id", "sheet"))
    return refs.unionByName(wb.named_refs(fixture(spark, sf, "f6_names"))).select("case_id", "sheet", "target", "coord")


@query("j_named_range_cells", _NAMED + """
SELECT ar.case_id, name, ar.sheet, top, count(*) AS formulas, count(*) FILTER (has_error) AS errors
FROM ar JOIN fo ON fo.case_id = ar.case_id AND fo.sheet = ar.sheet AND row_idx BETWEEN top AND bottom AND col_idx BETWEEN "left" AND "right" GROUP BY ALL""")
def j_named_range_cells(spark, sf):
    """Formula cells inside every area of a defined name."""
    found = wb.cells_in_areas(_formulas(spark, sf), wb.named_areas(fixture(spark, sf, "f6_names")))
    return found.groupBy("case_id", "name", "sheet", "top").agg(F.count(F.lit(1)).alias("formulas"), F.count_if("has_error").alias("errors"))


@query("w_first_crossref", _F6 + REFS_SQL + """
SELECT case_id, sheet, target, coord, formula AS example FROM hit
UNION ALL SELECT case_id, sheet, 'INDIRECT' AS target, coord, formula FROM fo WHERE starts_with(formula, '=') AND contains(upper(formula), 'INDIRECT(')
QUALIFY row_number() OVER (PARTITION BY case_id, sheet ORDER BY row_idx, col_idx) = 1""")
def w_first_crossref(spark, sf):
    """First example per sheet pair, and the first indirect reference of every sheet."""
    found = _formulas(spark, sf)
    refs = wb.cross_sheet_refs(found, fixture(spark, sf, "f6").select("case_id", "sheet"))
    return refs.unionByName(wb.first_indirect(found).withColumn("target", F.lit("INDIRECT")))


@query("f_uses_indirect", _F6 + "SELECT case_id, sheet, coord, contains(upper(shown), 'INDIRECT(') AS indirect FROM fo")
def f_uses_indirect(spark, sf):
    return _formulas(spark, sf).select("case_id", "sheet", "coord", fm.uses_indirect(F.col("shown")).alias("indirect"))


@query("f_xlfn_prefix", _F6 + rf"""
SELECT case_id, sheet, coord, regexp_replace(shown, '(?i)(^|[^\w.])({'|'.join(fm.PREFIXED_FUNCTIONS)})\(', '\1_xlfn.\2(', 'g') AS stored FROM fo""")
def f_xlfn_prefix(spark, sf):
    """Newer functions with their storage prefix."""
    return _formulas(spark, sf).select("case_id", "sheet", "coord", fm.add_prefix(F.col("shown")).alias("stored"))


@query("f_named_range", with_fixtures("names") + """
SELECT name, CASE WHEN destinations > 1 THEN 'spans sheets' WHEN contains(attr_text, '!') THEN 'cross-sheet' ELSE 'local' END AS scope,
       contains(attr_text, '#REF!') AS broken FROM names""")
def f_named_range(spark, sf):
    n = fixture(spark, sf, "names")
    return n.select("name", fm.name_scope(F.col("destinations"), F.col("attr_text")).alias("scope"), fm.name_broken(F.col("attr_text")).alias("broken"))


_VISIBLE = with_fixtures("f7", "f7_layout") + ", v AS (SELECT * FROM f7 WHERE NOT hidden)\n"


LOOK_SQL = """
, fi AS (
  SELECT DISTINCT case_id, 'font' AS kind, '' AS sheet, 0::BIGINT AS ord, CASE WHEN any_own THEN CASE WHEN font_scheme IS NULL THEN font_name END ELSE theme END AS item
  FROM (SELECT *, bool_or(font_scheme IS NULL) OVER (PARTITION BY case_id) AS any_own, min(font_name) OVER (PARTITION BY case_id) AS theme FROM v WHERE font_name IS NOT NULL) a
  UNION ALL SELECT DISTINCT case_id, 'color', '', 0, color FROM (SELECT case_id, font_color AS color FROM v UNION ALL SELECT case_id, fill_color FROM v) b WHERE color <> '00000000'
  UNION ALL SELECT case_id, kind, sheet, ord, item FROM f7_layout)
, items AS (SELECT * FROM fi WHERE item IS NOT NULL)
"""


@query("agg_formatting", _VISIBLE + LOOK_SQL + """
, fo AS (SELECT case_id, coalesce(string_agg(DISTINCT font_name, ',' ORDER BY font_name) FILTER (WHERE font_scheme IS NULL), min(font_name), '') AS fonts FROM v GROUP BY case_id)
, co AS (SELECT case_id, string_agg(color, ',' ORDER BY color) AS colors FROM (
    SELECT DISTINCT case_id, color FROM (SELECT case_id, font_color AS color FROM v UNION ALL SELECT case_id, fill_color FROM v) a
    WHERE color IS NOT NULL AND color <> '00000000') b GROUP BY case_id)
, li AS (SELECT case_id, kind, count(*) AS n, string_agg(sheet || '!' || item, ',' ORDER BY sheet, ord) AS l FROM f7_layout GROUP BY ALL)
, ct AS (SELECT case_id, count(*) FILTER (kind = 'font') AS font_count, count(*) FILTER (kind = 'color') AS color_count FROM items GROUP BY case_id)
SELECT fo.case_id, fonts, colors, coalesce(max(font_count), 0) AS font_count, coalesce(max(color_count), 0) AS color_count,
       coalesce(max(n) FILTER (WHERE kind = 'rule'), 0) AS rule_count, coalesce(max(n) FILTER (WHERE kind = 'merged'), 0) AS merged_count,
       coalesce(max(n) FILTER (WHERE kind = 'freeze'), 0) AS frozen_count, max(l) FILTER (WHERE kind = 'rule') AS rules, max(l) FILTER (WHERE kind = 'merged') AS merged,
       max(l) FILTER (WHERE kind = 'freeze') AS frozen
FROM fo LEFT JOIN co USING (case_id) LEFT JOIN ct USING (case_id) LEFT JOIN li USING (case_id) GROUP BY ALL""")
def agg_formatting(spark, sf):
    """Fonts, colours, rules, merged ranges and frozen panes of every workbook, counted and listed."""
    return wb.formatting(fixture(spark, sf, "f7"), fixture(spark, sf, "f7_layout"))


@query("format_items", _VISIBLE + LOOK_SQL + "SELECT * FROM items")
def format_items(spark, sf):
    """Fonts, colours, rules, merged ranges and frozen panes of every workbook, whole."""
    return wb.format_items(fixture(spark, sf, "f7"), fixture(spark, sf, "f7_layout"))


@query("agg_bold_header", with_fixtures("f7") + "SELECT case_id, bool_or(bold AND row_idx <= 3) AS has_bold_headers FROM f7 WHERE NOT hidden GROUP BY case_id")
def agg_bold_header(spark, sf):
    return wb.bold_header(fixture(spark, sf, "f7"))


@query("agg_border_coverage", _VISIBLE + """
SELECT *, CASE WHEN border_pct > 80 THEN 'all' WHEN border_pct > 20 THEN 'some' WHEN border_pct > 0 THEN 'few' ELSE 'none' END AS coverage FROM (
  SELECT case_id, count(*) AS total_cells, count(border_style) AS bordered_cells, coalesce(string_agg(DISTINCT border_style, ', ' ORDER BY border_style), '') AS border_styles,
         round(count(border_style) * 100.0 / count(*), 6) AS border_pct FROM v GROUP BY case_id) t""")
def agg_border_coverage(spark, sf):
    return wb.border_coverage(fixture(spark, sf, "f7")).withColumn("border_pct", F.round("border_pct", 6))


@query("agg_charts", with_fixtures("charts") + """
SELECT case_id, chart_type, count(*) AS charts, count(*) FILTER (WHERE has_legend) AS with_legend, bool_or(x_title IS NOT NULL OR y_title IS NOT NULL) AS has_axis_labels
FROM charts GROUP BY ALL""")
def agg_charts(spark, sf):
    return wb.chart_counts(fixture(spark, sf, "charts"))


_F7 = f"f7 AS ({fixture_sql('f7')}), f7_layout AS ({fixture_sql('f7_layout')}), v AS (SELECT * FROM f7 WHERE NOT hidden), "


@query("set_distinct", (_F6 + REFS_SQL).replace("WITH ", "WITH " + _F7, 1) + LOOK_SQL + """
SELECT case_id, kind, item FROM items WHERE kind IN ('font', 'color')
UNION ALL SELECT DISTINCT case_id, 'border', border_style FROM v WHERE border_style IS NOT NULL
UNION ALL SELECT case_id, 'reference', sheet || ' → ' || target FROM hit""")
def set_distinct(spark, sf):
    """Distinct fonts, colours, border styles and referenced sheets of every workbook."""
    styles = fixture(spark, sf, "f7")
    kind = lambda df, name, item: df.select("case_id", F.lit(name).alias("kind"), item.alias("item"))
    refs = wb.cross_sheet_refs(_formulas(spark, sf), fixture(spark, sf, "f6").select("case_id", "sheet"))
    borders = wb.visible_styles(styles).where("border_style IS NOT NULL").select("case_id", "border_style").distinct()
    return (
        kind(wb.fonts_used(styles), "font", F.col("item"))
        .unionByName(kind(wb.color_palette(styles), "color", F.col("item")))
        .unionByName(kind(borders, "border", F.col("border_style")))
        .unionByName(kind(refs, "reference", F.concat("sheet", F.lit(" → "), "target")))
    )


_FMT = """CASE o_orderkey % 9 WHEN 0 THEN 'General' WHEN 1 THEN '0%' WHEN 2 THEN '0.00%' WHEN 3 THEN '#,##0' WHEN 4 THEN '#,##0.00'
WHEN 5 THEN '0.000' WHEN 6 THEN '#,##0.0;(#,##0.0)' WHEN 7 THEN '0' END"""
_NUM = "CASE WHEN o_orderkey % 50 = 49 THEN NULL WHEN o_orderkey % 5 = 0 THEN o_custkey * 1.0e0 WHEN o_orderkey % 5 = 1 THEN 0 - o_totalprice ELSE o_totalprice / 7 END"


def _numbers(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.expr(_FMT).alias("fmt"), F.expr(_NUM).alias("x"))


@query("f_display_value", f"""
SELECT o_orderkey, CASE WHEN x IS NULL THEN '' WHEN fmt = '0%' THEN format('{{:.0f}}', x * 100) || '%' WHEN fmt = '0.00%' THEN format('{{:.2f}}', x * 100) || '%'
   WHEN fmt = '#,##0' THEN format('{{:,.0f}}', x) WHEN fmt = '#,##0.00' THEN format('{{:,.2f}}', x) WHEN fmt = '0.000' THEN format('{{:.3f}}', x)
   WHEN fmt = '#,##0.0;(#,##0.0)' THEN format('{{:,.1f}}', x) WHEN fmt = '0' THEN format('{{:.0f}}', x)
   WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE format('{{:.10g}}', x) END AS shown
FROM (SELECT o_orderkey, {_FMT} AS fmt, CAST({_NUM} AS DOUBLE) AS x FROM orders) t""")
def f_display_value(spark, sf):
    """Numbers under their number formats."""
    return _numbers(spark, sf).select("o_orderkey", dp.display_number(F.col("x"), F.col("fmt")).alias("shown"))


@query("f_display_time", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d') END AS shown FROM events""")
def f_display_time(spark, sf):
    """Dates and times under their formats."""
    fmt = F.when(F.col("event_id") % 3 == 0, "yyyy-mm-dd hh:mm").otherwise("yyyy-mm-dd")
    return table(spark, sf, "events").select("event_id", dp.display_time(F.col("ts"), fmt).alias("shown"))


@query("f_decimals", f"""
SELECT fmt, count(*) AS cells, CASE fmt WHEN '0.00%' THEN 2 WHEN '#,##0.00' THEN 2 WHEN '0.000' THEN 3 WHEN '#,##0.0;(#,##0.0)' THEN 1 WHEN 'General' THEN 0 ELSE 0 END AS decimals
FROM (SELECT {_FMT} AS fmt FROM orders) t WHERE fmt IS NOT NULL GROUP BY fmt""")
def f_decimals(spark, sf):
    """Decimal places per number format."""
    by = _numbers(spark, sf).where("fmt IS NOT NULL").groupBy("fmt").agg(F.count(F.lit(1)).alias("cells"))
    # Sections are split at the last point of the whole format, so a second section may carry the point.
    return by.withColumn("decimals", dp.decimals_of(F.col("fmt")))
