"""Reconciliation inputs derived from the driver tables.

Each fixture is one SELECT in SQL both engines read.  ``{each:a,b}`` stands for
"one row per integer from a to b" and is the only engine-specific piece.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tablecheck.plans.registry import table

# Names, in reporting order.
DIMENSIONS = [
    "data_accuracy",
    "completeness",
    "formula_logic",
    "relevance",
    "sheet_organization",
    "table_structure",
    "chart_appropriateness",
    "professional_formatting",
]
SCENARIOS = [
    "reporting_analysis",
    "data_processing",
    "template_form",
    "planning_tracking",
    "financial_modeling",
    "comparison_evaluation",
    "general",
]


def _pick(expr: str, names: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    return f"(CASE {expr} {arms} END)"


def idiv(a: str, b: int) -> str:
    return f"CAST(FLOOR(({a}) / {b}) AS BIGINT)"


def cents(c: str) -> str:
    return f"CAST(ROUND({c} * 100, 0) AS BIGINT)"


def money(c: str) -> str:
    """Whole cents to text with two decimals."""
    return f"CONCAT(CAST({idiv(c, 100)} AS VARCHAR(20)), '.', LPAD(CAST(({c}) % 100 AS VARCHAR(20)), 2, '0'))"


_K = "o_orderkey"
_C = cents("o_totalprice")

_FIXTURES: dict[str, str] = {}

# orders and a damaged copy, keyed.
_FIXTURES["f1_src"] = f"""
SELECT {_K} AS row_idx, {_K}, o_custkey, o_orderstatus, o_totalprice,
       CASE WHEN {_K} % 17 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM orders"""

_GEN_ROW = f"""
SELECT o_orderkey, cust, status, prio,
       CASE WHEN o_orderkey % 23 <> 0 THEN plain
            WHEN LENGTH(plain) <= 6 THEN CONCAT('$', plain)
            ELSE CONCAT('$', SUBSTR(plain, 1, CAST(LENGTH(plain) - 6 AS INT)), ',', RIGHT(plain, 6)) END AS price
FROM (
  SELECT o_orderkey, cust, status, prio, {money('newc')} AS plain
  FROM (
    SELECT o_orderkey, cust, status, prio,
           CASE WHEN o_orderkey % 7 = 0 THEN c + {idiv('c', 2000)} WHEN o_orderkey % 11 = 0 THEN c + {idiv('c', 50)} ELSE c END AS newc
    FROM (
      SELECT o_orderkey, o_custkey AS cust, o_orderpriority AS prio, {_C} AS c,
             CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN '' ELSE o_orderstatus END AS status
      FROM orders WHERE o_orderkey % 10 <> 0
    ) q1
  ) q2
) q3"""

_FIXTURES["f1_gen"] = f"""
SELECT CAST(2000000000 - 2 * {_K} AS BIGINT) AS row_idx, {_K} AS g_key, cust AS g_cust,
       status AS g_status, price AS g_price, prio AS g_prio FROM ({_GEN_ROW}) g
UNION ALL
SELECT CAST(2000000000 - 2 * {_K} + 1 AS BIGINT), {_K}, cust, status, '1.00', prio FROM ({_GEN_ROW}) h
WHERE {_K} % 29 = 0"""

# events by position, with empty rows in the source and a short copy.
_FIXTURES["f2_src"] = """
SELECT event_id * 2 AS row_idx, user_id, event_type, value, props FROM events
UNION ALL
SELECT event_id * 2 + 1, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR(20)), CAST(NULL AS DOUBLE), '  ' FROM events
WHERE event_id % 1000 = 999"""
_FIXTURES["f2_gen"] = """
SELECT event_id * 2 AS row_idx, user_id, event_type,
       CASE WHEN event_id % 20 = 0 THEN value + 1 ELSE value END AS value, props
FROM events WHERE event_id % 20 <> 19 OR event_id % 3 <> 0"""

# a corpus of workbooks, one cell per row.
def _grid(case_key: str, tab: str, side: str, sheet: str, cols: list[tuple[str, str]]) -> str:
    row = f"{case_key} % 1000"
    value = " ".join(f"WHEN {i + 1} THEN {e}" for i, (_, e) in enumerate(cols))
    name = " ".join(f"WHEN {i + 1} THEN '{n}'" for i, (n, _) in enumerate(cols))
    return f"""
SELECT CONCAT('case_', LPAD(CAST({idiv(case_key, 1000)} AS VARCHAR(20)), 6, '0')) AS case_id, '{side}' AS side,
       '{sheet}' AS sheet, CAST({row} AS BIGINT) AS row_idx, CAST(col_idx AS INT) AS col_idx,
       CASE col_idx {name} END AS col_name,
       CASE WHEN {row} % 50 = 49 THEN NULL WHEN ({case_key} + col_idx) % 17 = 0 THEN NULL
            WHEN ({case_key} + col_idx) % 23 = 0 THEN ' ' ELSE (CASE col_idx {value} END) END AS value
FROM (SELECT *, {{each:1,{len(cols)}}} AS col_idx FROM {tab}) x"""


def _txt(c: str) -> str:
    return f"CAST({c} AS VARCHAR(40))"


def _signed_money(c: str) -> str:
    return f"CONCAT(CASE WHEN {c} < 0 THEN '-' ELSE '' END, {money('ABS(' + cents(c) + ')')})"


_CUST = [("Name", "c_name"), ("Nation", _txt("c_nationkey")), ("Balance", _signed_money("c_acctbal")), ("Segment", "c_mktsegment")]
_CUST_SRC = [("name", "c_name"), ("nation", _txt("c_nationkey")), ("balance", _signed_money("c_acctbal + 1")), ("segment", "c_mktsegment")]
_PART = [("Part", "p_name"), ("Brand", "p_brand"), ("Size", _txt("p_size")), ("Price", _signed_money("p_retailprice"))]
_PART_SRC = [("p_name", "p_name"), ("brand", "p_brand"), ("dims", _txt("p_size")), ("retail price", _signed_money("p_retailprice"))]
_SEG = [("Nation", _txt("c_nationkey")), ("Segment", "c_mktsegment")]

_FIXTURES["f3"] = "\nUNION ALL\n".join([
    _grid("c_custkey", "customer", "generated", "Customers", _CUST),
    _grid("p_partkey", "part", "generated", "Parts List", _PART),
    _grid("c_custkey", "customer", "generated", "Segments", _SEG),
    _grid("c_custkey", "customer", "source", "customer", _CUST_SRC),
    _grid("p_partkey", "part", "source", "part list", _PART_SRC),
])
_FIXTURES["f3_visibility"] = """
SELECT DISTINCT case_id, sheet,
       (sheet = 'Segments' AND CAST(RIGHT(case_id, 6) AS INT) % 2 = 0) AS hidden
FROM ({f3}) f WHERE side = 'generated'"""

# The same corpus where every other case has lost its unique columns, so that its rows can only be compared by position.
_FIXTURES["f3_mixed"] = """
SELECT * FROM ({f3}) f WHERE NOT (CAST(RIGHT(case_id, 6) AS INT) % 2 = 1 AND col_idx IN (1, 4))"""

# part and a copy under other names.
_FIXTURES["f4_src"] = "SELECT p_partkey AS row_idx, p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part"
_FIXTURES["f4_gen"] = """
SELECT p_partkey AS row_idx, p_partkey AS P_PartKey, p_name AS Part_Name, p_brand AS P_BRAND, p_type AS P_Type,
       p_size AS dims, p_retailprice AS Retail_Price FROM part"""

# orders as cases, 8 dimensions, 3 runs.
_FIXTURES["f5"] = f"""
SELECT case_id, run, dim_idx, dimension, status,
       CASE WHEN status = 'success' AND (k + dim_idx + run) % 13 <> 0
            THEN CAST((k * 7 + dim_idx * 3 + run * 5) % 5 AS INT) END AS score,
       CONCAT('feedback ', CAST(k AS VARCHAR(20)), '/', CAST(run AS VARCHAR(20))) AS feedback,
       1000 + (k * 13 + dim_idx * 7 + run) % 4000 AS input_tokens,
       100 + (k + dim_idx * 11) % 900 AS output_tokens,
       500 + (k * 17 + dim_idx * 5 + run * 3) % 9000 AS latency_ms
FROM (
  SELECT CONCAT('c', LPAD(CAST(k AS VARCHAR(20)), 12, '0')) AS case_id, k, run, dim_idx, {_pick('dim_idx', DIMENSIONS)} AS dimension,
         CASE WHEN (k + dim_idx) % 31 = 0 THEN 'skipped' WHEN (k * 3 + dim_idx) % 29 = 0 THEN 'error'
              WHEN (k + dim_idx) % 9 = 0 THEN 'na' ELSE 'success' END AS status
  FROM (SELECT k, run, {{each:0,7}} AS dim_idx FROM (SELECT o_orderkey AS k, {{each:1,3}} AS run FROM orders) a) b
) c"""
_FIXTURES["f5_cases"] = f"""
SELECT CONCAT('c', LPAD(CAST(k AS VARCHAR(20)), 12, '0')) AS case_id, CONCAT('task ', CAST(k % 500 AS VARCHAR(20))) AS task_id, k, {_pick('k % 7', SCENARIOS)} AS scenario,
       CASE WHEN k % 3 = 0 THEN {_pick('k % 7', SCENARIOS)} END AS blend1,
       CASE WHEN k % 3 = 0 THEN CASE WHEN k % 31 = 0 THEN 'mystery' ELSE {_pick('(k + 2) % 7', SCENARIOS)} END END AS blend2,
       CASE k % 4 WHEN 0 THEN 'Claude-Sonnet-4-x' WHEN 1 THEN 'claude-3-haiku-y' WHEN 2 THEN 'other' ELSE 'claude-opus-4' END AS model,
       CASE k % 5 WHEN 0 THEN 'sector a' WHEN 1 THEN 'sector b' ELSE 'sector c' END AS sector,
       CAST(k % 3 AS INT) AS n_screens,
       1000 + (k * 31) % 7000 AS wall_ms
FROM (SELECT o_orderkey AS k FROM orders) o"""

# cells with formulas and number formats.
_FIXTURES["f6"] = f"""
SELECT case_id, sheet_idx, sheet, row_idx, col_idx, CONCAT(SUBSTR('ABCD', col_idx, 1), CAST(row_idx AS VARCHAR(20))) AS coord,
       CASE WHEN r = 6 THEN 'array' WHEN r = 7 THEN 'table' ELSE 'plain' END AS formula_kind,
       CASE r WHEN 0 THEN '=SUM(B2:B4)' WHEN 1 THEN '=''Sheet 1''!A1' WHEN 2 THEN '=INDIRECT("A1")'
              WHEN 3 THEN '=XLOOKUP(A1,B1:B9,C1:C9)' WHEN 4 THEN '=Data!B2+1' WHEN 5 THEN '=''It''''s''!C3'
              WHEN 6 THEN '=sort(A1:A9)' WHEN 7 THEN '' WHEN 8 THEN '=RawData!B2' END AS formula,
       'A1' AS r1, 'B1' AS r2,
       CASE WHEN (k * 5 + col_idx) % 11 = 0 THEN '#REF!' WHEN (k * 5 + col_idx) % 13 = 0 THEN '#DIV/0!'
            ELSE CAST(k AS VARCHAR(20)) END AS computed_value
FROM (
  SELECT k, CONCAT('case_', LPAD(CAST({idiv('k', 600)} AS VARCHAR(20)), 6, '0')) AS case_id, CAST(k % 3 AS INT) AS sheet_idx,
         CASE k % 3 WHEN 0 THEN 'Sheet 1' WHEN 1 THEN 'Data' ELSE 'It''s' END AS sheet,
         {idiv('k % 600', 3)} + 1 AS row_idx, CAST(col_idx AS INT) AS col_idx, (k + col_idx) % 12 AS r
  FROM (SELECT o_orderkey AS k, {{each:1,4}} AS col_idx FROM orders) a
) b"""

# cell styles.
_FIXTURES["f7"] = f"""
SELECT case_id, sheet, hidden, row_idx, col_idx,
       (row_idx = 1 AND case_no % 2 = 0) OR (row_idx > 3 AND k % 5 = 0) AS bold,
       CASE WHEN case_no % 4 = 3 THEN 'Calibri' WHEN k % 3 = 0 THEN 'Arial' WHEN k % 3 = 1 THEN 'Calibri' ELSE 'Courier' END AS font_name,
       CASE WHEN case_no % 4 = 3 OR k % 3 = 1 THEN 'minor' END AS font_scheme,
       CASE WHEN k % 2 = 0 THEN '00000000' ELSE CONCAT('FF0000', LPAD(CAST((k * 7 + col_idx) % 40 AS VARCHAR(20)), 2, '0')) END AS font_color,
       CASE WHEN k % 5 = 0 THEN CONCAT('FFAA00', LPAD(CAST(k % 30 AS VARCHAR(20)), 2, '0')) END AS fill_color,
       CASE WHEN (k * 3 + col_idx) % 10 < (CASE case_no % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 5 ELSE 9 END)
            THEN CASE WHEN k % 2 = 0 THEN 'thin' ELSE 'medium' END END AS border_style
FROM (
  SELECT k, col_idx, {idiv('k', 400)} AS case_no, CONCAT('case_', LPAD(CAST({idiv('k', 400)} AS VARCHAR(20)), 6, '0')) AS case_id,
         CASE k % 2 WHEN 0 THEN 'Main' ELSE 'Aux' END AS sheet, (k % 2 = 1 AND {idiv('k', 400)} % 3 = 2) AS hidden,
         {idiv('k % 400', 2)} + 1 AS row_idx
  FROM (SELECT o_orderkey AS k, {{each:1,4}} AS col_idx FROM orders) a
) b"""

# Layout items, defined names and charts.
_FIXTURES["f7_layout"] = f"""
SELECT case_id, sheet, kind, ord, item FROM (
  SELECT CONCAT('case_', LPAD(CAST({idiv('k', 400)} AS VARCHAR(20)), 6, '0')) AS case_id, CASE k % 2 WHEN 0 THEN 'Main' ELSE 'Aux' END AS sheet,
         CASE WHEN k % 400 < 2 THEN 'freeze' WHEN k % 5 = 0 THEN 'merged' WHEN k % 7 = 0 THEN 'rule' END AS kind, k AS ord,
         CASE WHEN k % 400 < 2 THEN 'A2' WHEN k % 5 = 0 THEN CONCAT('A', CAST(k AS VARCHAR(20)), ':B', CAST(k AS VARCHAR(20))) ELSE CONCAT('B', CAST(k AS VARCHAR(20))) END AS item
  FROM (SELECT o_orderkey AS k FROM orders) a) b
WHERE kind IS NOT NULL"""
_FIXTURES["names"] = """
SELECT CONCAT('rng_', CAST(p_partkey AS VARCHAR(20))) AS name, CAST(CASE p_partkey % 4 WHEN 3 THEN 2 ELSE 1 END AS INT) AS destinations,
       CASE p_partkey % 4 WHEN 0 THEN 'Data!$A$1' WHEN 1 THEN '$A$1' WHEN 2 THEN '#REF!$A$1' ELSE 'Data!$A$1,Other!$B$2' END AS attr_text
FROM part"""
# Defined names of the formula workbooks: a rectangle of one sheet, a local cell, a broken name, rectangles of two sheets.
_FIXTURES["f6_names"] = f"""
SELECT CONCAT('case_', LPAD(CAST(p_partkey % 25 AS VARCHAR(20)), 6, '0')) AS case_id, CONCAT('rng_', CAST(p_partkey AS VARCHAR(20))) AS name,
       CASE p_partkey % 4 WHEN 0 THEN CONCAT('Data!$A$', CAST(p_size AS VARCHAR(20)), ':$C$', CAST(p_size + p_partkey % 700 AS VARCHAR(20)))
         WHEN 1 THEN CONCAT('$B$', CAST(p_size AS VARCHAR(20))) WHEN 2 THEN '#REF!$A$1'
         ELSE CONCAT('''Sheet 1''!$A$1:$B$', CAST(p_size AS VARCHAR(20)), ',Data!$AB$2:$B$', CAST(p_size AS VARCHAR(20))) END AS attr_text
FROM part"""
_FIXTURES["charts"] = f"""
SELECT CONCAT('case_', LPAD(CAST({idiv('p_partkey', 1000)} AS VARCHAR(20)), 6, '0')) AS case_id, 'Customers' AS sheet, p_partkey AS chart_idx,
       CASE p_partkey % 7 WHEN 0 THEN 'bar' WHEN 1 THEN 'line' WHEN 2 THEN 'pie' WHEN 3 THEN 'area' WHEN 4 THEN 'scatter' ELSE 'unknown' END AS chart_type,
       CASE WHEN p_partkey % 3 > 0 THEN p_name END AS title, p_partkey % 2 = 0 AS has_legend,
       CASE WHEN p_partkey % 70 = 0 THEN 'x' END AS x_title, CASE WHEN p_partkey % 71 = 1 THEN 'y' END AS y_title
FROM part"""

# F8: reviewer replies, one per case and dimension.
_TICKS = "```"
_FIXTURES["f8"] = f"""
SELECT case_id, dim_idx, dimension, k,
       CASE WHEN (k + dim_idx) % 19 = 0 THEN 'max_tokens' ELSE 'end_turn' END AS stop_reason,
       CASE (k + dim_idx) % 9
         WHEN 0 THEN CONCAT('{_TICKS}json', CHR(10), body, CHR(10), '{_TICKS}')
         WHEN 1 THEN CONCAT('Here it is:', CHR(10), '{_TICKS}', CHR(10), body, CHR(10), '{_TICKS}', CHR(10), 'done')
         WHEN 2 THEN CONCAT('{{"score": 7, "feedback": "', fb, '", "evidence": []}}')
         WHEN 3 THEN SUBSTR(body, 1, LENGTH(body) - 5)
         WHEN 4 THEN CONCAT('{{"score": null, "feedback": "', fb, '", "evidence": []}}')
         WHEN 5 THEN CONCAT('{{"score": ', CAST(sc AS VARCHAR(20)), ', "feedback": "', fb, '", "evidence": "+VERIFIED: single"}}')
         ELSE body END AS reply
FROM (
  SELECT case_id, dim_idx, dimension, k, sc, fb,
         CONCAT('{{"score": ', CAST(sc AS VARCHAR(20)), ', "feedback": "', fb, '", "evidence": [',
                '"+VERIFIED: total ', CAST(k AS VARCHAR(20)), '", "-Verified: gap", "+INFERRED: trend", "-INFERRED: verified later", "plain note"]}}') AS body
  FROM (
    SELECT CONCAT('c', LPAD(CAST(k AS VARCHAR(20)), 12, '0')) AS case_id, dim_idx, {_pick('dim_idx', DIMENSIONS)} AS dimension, k,
           (k * 7 + dim_idx * 3) % 5 AS sc,
           CASE (k + dim_idx) % 4 WHEN 0 THEN 'Too short.'
             WHEN 1 THEN CONCAT(REPEAT('The totals agree with the source rows and ', 3), CAST(k AS VARCHAR(20)), ' cells were read.')
             WHEN 2 THEN CONCAT(REPEAT('The totals agree with the source rows and ', 3), 'then it stops in the mid')
             ELSE CONCAT(REPEAT('(1) Clear and consistent layout (2) missing totals ', 3), '!') END AS fb
    FROM (SELECT o_orderkey AS k, {{each:0,7}} AS dim_idx FROM orders) a
  ) b
) c"""

# Scenario replies, one per case.
_FIXTURES["f8_scenario"] = f"""
SELECT case_id, k, scenario AS override_src, prompt,
       CASE WHEN k % 23 = 0 THEN 'not json' ELSE
       CONCAT('{_TICKS}json', CHR(10), '{{"scenario": "', CASE WHEN k % 31 = 0 THEN 'mystery' ELSE scenario END,
              '", "confidence": ', CASE WHEN k % 5 = 0 THEN '0.5' WHEN k % 5 = 1 THEN '0.7' ELSE '0.9' END,
              ', "reasoning": "r', CAST(k AS VARCHAR(20)), '"',
              CASE WHEN k % 3 = 0 THEN CONCAT(', "blend": {{"', scenario, '": 0.6, "', blend_other, '": 0.2}}') ELSE '' END,
              ', "applicable_dimensions": {{"chart_appropriateness": ', CASE WHEN k % 4 = 0 THEN 'false' ELSE 'true' END, '}}',
              ', "dimension_reasoning": {{"chart_appropriateness": "no charts needed"}}}}', CHR(10), '{_TICKS}') END AS reply
FROM (
  SELECT CONCAT('c', LPAD(CAST(k AS VARCHAR(20)), 12, '0')) AS case_id, k, {_pick('k % 7', SCENARIOS)} AS scenario,
         CASE WHEN k % 2 = 0 THEN 'mystery' ELSE {_pick('(k + 2) % 7', SCENARIOS)} END AS blend_other,
         CASE k % 6 WHEN 0 THEN 'Write a VBA macro to sort' WHEN 1 THEN 'Macro and a SUMIF formula' WHEN 2 THEN 'Add totals' ELSE 'Build the Macro' END AS prompt
  FROM (SELECT o_orderkey AS k FROM orders) a
) b"""

# Verification verdicts for F8 evidence.
_FIXTURES["f8_verdicts"] = f"""
SELECT CONCAT('c', LPAD(CAST(k AS VARCHAR(20)), 12, '0')) AS case_id, {_pick('dim_idx', DIMENSIONS)} AS dimension,
       CASE WHEN k % 2 = 0 THEN CONCAT('{{"results": ', body, '}}') ELSE body END AS reply
FROM (SELECT k, dim_idx, CONCAT('[{{"index": 1, "confirmed": ', CASE WHEN (k + dim_idx) % 4 = 0 THEN 'false' ELSE 'true' END,
      ', "reason": "x"}}, {{"index": 2, "confirmed": ', CASE WHEN (k + dim_idx) % 6 = 0 THEN 'false' ELSE 'true' END,
      ', "reason": "y"}}, {{"index": 9, "confirmed": false, "reason": "z"}}]') AS body
      FROM (SELECT o_orderkey AS k, {{each:0,7}} AS dim_idx FROM orders) a) b"""

# documents as sheets, blank lines put in by residue.
_FIXTURES["f9"] = """
SELECT doc_id, source, lang,
       CASE doc_id % 4 WHEN 0 THEN text
         WHEN 1 THEN REPLACE(text, '. ', CONCAT('.', CHR(10), CHR(10)))
         WHEN 2 THEN REPLACE(text, '. ', CONCAT('.', CHR(10), ', ,""', CHR(10), ' ', CHR(10)))
         ELSE REPLACE(text, ', ', CONCAT(',', CHR(10), CHR(10), CHR(10), CHR(10), '12.5,-3', CHR(10))) END AS text
FROM documents"""


# Documents as the sheets of one case per source, with the texts a review of it would carry.
_FIXTURES["f9_cases"] = """
SELECT source AS case_id, CASE WHEN no % 5 = 0 THEN '' ELSE CONCAT('scan of ', source, ' ', REPEAT('x', CAST(no * 40 AS INT))) END AS scan_text,
       CASE no % 4 WHEN 0 THEN '' WHEN 1 THEN base WHEN 2 THEN REPEAT(base, 400) ELSE REPEAT(base, 2000) END AS grounding,
       n * 7 % 150 AS expected_fills, CONCAT('Check ', source) AS prompt, 'general' AS scenario
FROM (SELECT source, CAST(SUBSTR(source, 4) AS INT) AS no, COUNT(*) AS n, SUBSTR(MAX_BY(text, doc_id), 1, 600) AS base FROM documents GROUP BY source) s"""
_FIXTURES["f9_sheets"] = f"""
SELECT source AS case_id, CONCAT('doc ', CAST(doc_id AS VARCHAR(20))) AS sheet, text AS csv_text, doc_id,
       LENGTH(text) - LENGTH(REPLACE(text, CHR(10), '')) + 1 AS row_count, doc_id % 7 + 1 AS col_count, doc_id % 11 = 0 AS hidden
FROM ({{f9}}) f"""


def _expand(text: str, engine: str) -> str:
    for name in re.findall(r"\{(f\d\w*|names|charts)\}", text):
        text = text.replace("{" + name + "}", _expand(_FIXTURES[name], engine))
    each = r"\{each:(\d+),(\d+)\}"
    if engine == "spark":
        return re.sub(each, r"explode(sequence(\1, \2))", text)
    return re.sub(each, r"unnest(generate_series(\1, \2))", text)


TABLES = ["orders", "events", "customer", "part", "supplier", "nation", "lineitem", "documents", "conversations", "labels", "pages"]


def source_text(spark: SparkSession, sf_dir: str, name: str) -> str:
    """FROM item for a driver table, spread because the fixtures multiply its rows."""
    return f"(SELECT /*+ REPARTITION({spark.conf.get('spark.sql.shuffle.partitions')}) */ * FROM parquet.`{sf_dir}/{name}.parquet`)"


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture as a Spark DataFrame."""
    text = _expand(_FIXTURES[name], "spark")
    for t in TABLES:
        if re.search(rf"\bFROM {t}\b", text):
            text = re.sub(rf"\bFROM {t}\b", f"FROM {source_text(spark, sf_dir, t)}", text)
    return spark.sql(text)


def fixture_sql(name: str) -> str:
    """The fixture as SQL text for the checking engine."""
    return _expand(_FIXTURES[name], "duckdb")


def with_fixtures(*names: str) -> str:
    """``WITH`` clause naming the given fixtures."""
    return "WITH " + ",\n".join(f"{n} AS ({fixture_sql(n)})" for n in names) + "\n"
