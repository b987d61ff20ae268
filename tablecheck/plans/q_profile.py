"""Queries of profiling, matching and sheet shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecheck.functions import naming
from tablecheck.functions.cells import is_empty, try_numeric
from tablecheck.operators import matching as mt, profile as pf, sheets as sh
from tablecheck.operators.rownum import dedupe_names
from tablecheck.plans import sqltext as q
from tablecheck.plans.fixtures import fixture, with_fixtures
from tablecheck.plans.registry import query, table
from tablecheck.session import cut_lineage

SHEET = ["case_id", "side", "sheet"]
STATS = ["num_min", "num_max", "num_mean", "num_sum"]


def _rounded(df):
    return df.select(*[F.round(c, 2).alias(c) if c in STATS else F.col(c) for c in df.columns])


_DTYPE = """CASE WHEN non_null = 0 THEN 'empty' WHEN numeric_count > non_null * 0.8 THEN 'numeric'
            WHEN numeric_count < non_null * 0.2 THEN 'string' ELSE 'mixed' END"""
_PROFILE_TAIL = f"""dtype, non_null, null_count, unique_count,
       CASE WHEN dtype = 'numeric' THEN round(mn, 2) END AS num_min, CASE WHEN dtype = 'numeric' THEN round(mx, 2) END AS num_max,
       CASE WHEN dtype = 'numeric' THEN round(sm / numeric_count, 2) END AS num_mean,
       CASE WHEN dtype = 'numeric' THEN round(sm, 2) END AS num_sum,
       CASE WHEN dtype = 'string' THEN t0 END AS text_min, CASE WHEN dtype = 'string' THEN t1 END AS text_max"""


def _profile_sql(inner: str, keys: str) -> str:
    return f"SELECT {keys}, {_PROFILE_TAIL} FROM (SELECT *, {_DTYPE} AS dtype FROM ({inner}) a) b"


_LINE_COLS = {
    "l_orderkey": "n", "l_partkey": "n", "l_suppkey": "n", "l_linenumber": "n", "l_quantity": "n", "l_extendedprice": "n",
    "l_discount": "n", "l_tax": "n", "l_returnflag": "s", "l_linestatus": "s", "l_shipdate": "s",
}
_LINE = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS col, count({c}) AS non_null, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count,
    {f'count({c})' if k == 'n' else '0'} AS numeric_count, {f'CAST(min({c}) AS DOUBLE)' if k == 'n' else 'CAST(NULL AS DOUBLE)'} AS mn,
    {f'CAST(max({c}) AS DOUBLE)' if k == 'n' else 'CAST(NULL AS DOUBLE)'} AS mx,
    {f'CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)' if k == 'n' else 'CAST(NULL AS DOUBLE)'} AS sm,
    CAST(min({c}) AS VARCHAR) AS t0, CAST(max({c}) AS VARCHAR) AS t1 FROM lineitem"""
    for c, k in _LINE_COLS.items()
)
_CORPUS_PROFILE = f"""SELECT case_id, side, sheet, col_name, count(value) AS non_null, count(*) - count(value) AS null_count,
    count(DISTINCT value) AS unique_count, count(x) AS numeric_count, min(x) AS mn, max(x) AS mx,
    CAST(sum(CAST(x AS DECIMAL(18,2))) AS DOUBLE) AS sm, min(value) AS t0, max(value) AS t1
    FROM (SELECT *, {q.number('value')} AS x FROM f3) f GROUP BY ALL"""


@query("agg_column_profile", _profile_sql(_LINE, "col"))
def agg_column_profile(spark, sf):
    """Profile of every lineitem column in one job."""
    return _rounded(pf.profile_table(table(spark, sf, "lineitem")))


@query("agg_column_profile_corpus", with_fixtures("f3") + _profile_sql(_CORPUS_PROFILE, "case_id, side, sheet, col_name"))
def agg_column_profile_corpus(spark, sf):
    """Column profiles of every sheet of a corpus."""
    return _rounded(pf.column_profile(fixture(spark, sf, "f3"), [*SHEET, "col_name"]))


@query("agg_column_profile_approx", with_fixtures("f3") + f"""
SELECT side, sheet, col_name, count(value) AS non_null, count(DISTINCT value) AS unique_count, true AS distinct_ok,
       CASE WHEN count({q.number('value')}) > 0 THEN true END AS median_ok FROM f3 GROUP BY ALL""")
def agg_column_profile_approx(spark, sf):
    """Column sketches of every sheet merged over all cases, beside exact counts: distinct counts within 5 %, the median's rank within 3 %."""
    cells = fixture(spark, sf, "f3")
    merged = pf.merge_sketches(cut_lineage(pf.column_sketches(cells, [*SHEET, "col_name"]), "sketches"), ["side", "sheet", "col_name"])
    est = pf.sketch_profile(merged, ["side", "sheet", "col_name"])
    keys = ["side", "sheet", "col_name"]
    exact = cells.groupBy(*keys).agg(F.count_distinct("value").alias("unique_count"))
    x = pf.finite_number(F.col("value"))
    ranked = cells.select(*keys, x.alias("x")).where("x IS NOT NULL").join(est.select(*keys, "median"), keys)
    share = ranked.groupBy(*keys).agg((F.count_if(F.col("x") < F.col("median")) / F.count(F.lit(1))).alias("below"), (F.count_if(F.col("x") <= F.col("median")) / F.count(F.lit(1))).alias("upto"))
    both = est.join(exact, keys).join(share, keys, "left")
    near = F.abs(F.col("approx_unique") - F.col("unique_count")) <= 0.05 * F.col("unique_count")
    middle = (F.col("below") <= 0.53) & (F.col("upto") >= 0.47)
    return both.select(*keys, "non_null", "unique_count", near.alias("distinct_ok"), F.when(F.col("upto").isNotNull(), middle).alias("median_ok"))


@query("agg_sheet_profile", with_fixtures("f2_src") + f"""
, d AS (SELECT user_id, event_type, value, props, count(*) AS n FROM f2_src GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS row_count, 4 AS col_count,
       CAST(coalesce(sum(n) FILTER (WHERE user_id IS NULL AND {q.empty('event_type')} AND value IS NULL AND {q.empty('props')}), 0) AS BIGINT) AS empty_rows,
       CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM d""")
def agg_sheet_profile(spark, sf):
    """Row, column, empty-row and duplicate counts of one table."""
    return pf.sheet_profile(fixture(spark, sf, "f2_src"), "row_idx")


_ROWSIG = f"""
, r AS (SELECT case_id, side, sheet, row_idx, string_agg(coalesce('v' || value, 'n'), chr(1) ORDER BY col_idx) AS sig,
        bool_and({q.empty('value')}) AS e, max(col_idx) AS nc FROM f3 GROUP BY ALL)
"""


@query("agg_corpus_profile", with_fixtures("f3") + _ROWSIG + """
SELECT case_id, side, sheet, count(*) AS row_count, CAST(max(nc) AS BIGINT) AS col_count,
       count(*) FILTER (WHERE e) AS empty_rows, count(*) - count(DISTINCT sig) AS duplicate_rows FROM r GROUP BY ALL""")
def agg_corpus_profile(spark, sf):
    """Sheet profiles of a whole corpus."""
    return pf.corpus_profile(fixture(spark, sf, "f3"), SHEET)


@query("w_first_n_values", with_fixtures("f3") + """
SELECT case_id, side, sheet, col_name, row_idx, value, row_number() OVER w AS rn FROM f3 WHERE value IS NOT NULL
WINDOW w AS (PARTITION BY case_id, side, sheet, col_name ORDER BY row_idx) QUALIFY row_number() OVER w <= 5""")
def w_first_n_values(spark, sf):
    """First five values of every column."""
    out = pf.sample_values(fixture(spark, sf, "f3"), [*SHEET, "col_name"], "row_idx")
    return out.select(*SHEET, "col_name", "row_idx", "value", "rn")


def _tables(spark, sf):
    cols = mt.table_columns(fixture(spark, sf, "f3"), SHEET)
    order = F.when(F.col("sheet").isin("customer", "Customers"), 0).when(F.col("sheet").isin("part list", "Parts List"), 1).otherwise(2)
    return cols.withColumn("sheet_idx", order)


@query("f_match_type", """
SELECT o_orderkey, CASE WHEN (o_custkey % 101) / 100.0 > 0.5 THEN 'fuzzy_name' ELSE 'value_overlap' END AS match_type,
       (o_custkey % 101) / 100.0 >= 0.3 AS accepted, (o_custkey % 101) / 100.0 >= 0.5 AS compared FROM orders""")
def f_match_type(spark, sf):
    """Label and acceptance of a candidate from its score."""
    score = (F.col("o_custkey") % 101) / F.lit(100.0)
    return table(spark, sf, "orders").select(
        "o_orderkey", naming.match_type(score).alias("match_type"),
        (score >= mt.COLUMN_MIN_SCORE).alias("accepted"), (score >= 0.5).alias("compared"))


def _column_sets(spark, sf):
    t = _tables(spark, sf)
    low = F.transform("columns", lambda c: F.lower(c))
    s = t.where("side = 'source'").select("case_id", "sheet_idx", low.alias("a"))
    g = t.where("side = 'generated'").select("case_id", "sheet_idx", low.alias("b"))
    return s.join(g, ["case_id", "sheet_idx"])


_COLSETS = """
, a AS (SELECT DISTINCT case_id, CASE sheet WHEN 'customer' THEN 0 ELSE 1 END AS sheet_idx, lower(col_name) AS c FROM f3 WHERE side = 'source')
, b AS (SELECT DISTINCT case_id, CASE sheet WHEN 'Customers' THEN 0 WHEN 'Parts List' THEN 1 ELSE 2 END AS sheet_idx, lower(col_name) AS c FROM f3 WHERE side = 'generated')
, k AS (SELECT DISTINCT case_id, sheet_idx FROM a INTERSECT SELECT DISTINCT case_id, sheet_idx FROM b)
"""


@query("set_intersect_cols", with_fixtures("f3") + _COLSETS + """
SELECT case_id, sheet_idx, string_agg(c, ',' ORDER BY c) FILTER (WHERE n = 2) AS common, round(count(*) FILTER (WHERE n = 2) * 1.0 / count(*), 9) AS jaccard
FROM (SELECT case_id, sheet_idx, c, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) u JOIN k USING (case_id, sheet_idx) GROUP BY ALL) t GROUP BY ALL""")
def set_intersect_cols(spark, sf):
    """Common column names of paired tables."""
    return _column_sets(spark, sf).select(
        "case_id", "sheet_idx", F.expr("nullif(array_join(array_sort(array_intersect(a, b)), ','), '')").alias("common"),
        F.round(naming.jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"))


@query("set_except_cols", with_fixtures("f3") + _COLSETS + """
SELECT case_id, sheet_idx, coalesce(string_agg(c, ',' ORDER BY c) FILTER (WHERE n = 1 AND s = 'a'), '') AS missing,
       coalesce(string_agg(c, ',' ORDER BY c) FILTER (WHERE n = 1 AND s = 'b'), '') AS added
FROM (SELECT case_id, sheet_idx, c, count(*) AS n, min(s) AS s FROM (SELECT *, 'a' AS s FROM a UNION ALL SELECT *, 'b' FROM b) u
      JOIN k USING (case_id, sheet_idx) GROUP BY ALL) t GROUP BY ALL""")
def set_except_cols(spark, sf):
    """Columns present on one side only."""
    return _column_sets(spark, sf).select(
        "case_id", "sheet_idx", F.array_join(F.array_sort(F.array_except("a", "b")), ",").alias("missing"),
        F.array_join(F.array_sort(F.array_except("b", "a")), ",").alias("added"))


PART_BYTES = 1 << 14
# The generated sheets and one per case that has a header and no rows.
NAMED_SQL = """
SELECT case_id, sheet, row_idx, col_idx, col_name, value FROM f3 WHERE side = 'generated'
UNION ALL SELECT DISTINCT case_id, 'Notes', CAST(NULL AS BIGINT), col_idx, CONCAT('Note, ', CAST(col_idx AS VARCHAR(20))), CAST(NULL AS VARCHAR(40)) FROM f3 WHERE side = 'generated' AND sheet = 'Segments'"""


def named_cells(spark, sf):
    return spark.sql(NAMED_SQL.replace("FROM f3", "FROM {f3}"), f3=fixture(spark, sf, "f3"))


@query("p_visible", with_fixtures("f3", "f3_visibility") + """
SELECT case_id, sheet, count(*) AS cells FROM f3 JOIN f3_visibility v USING (case_id, sheet) WHERE side = 'generated' AND NOT hidden GROUP BY ALL""")
def p_visible(spark, sf):
    """Cells of visible sheets only."""
    cells = fixture(spark, sf, "f3").where("side = 'generated'")
    shown = sh.visible(cells, fixture(spark, sf, "f3_visibility"))
    return shown.groupBy("case_id", "sheet").agg(F.count(F.lit(1)).alias("cells"))


@query("p_nonempty_tables", with_fixtures("f3") + f"""
SELECT case_id, side, sheet, count(*) AS cells FROM f3 GROUP BY ALL HAVING count(*) FILTER (WHERE NOT {q.empty('value')}) > 0""")
def p_nonempty_tables(spark, sf):
    """Tables that hold any value."""
    filled = F.count_if(~is_empty(F.col("value")))
    out = fixture(spark, sf, "f3").groupBy(*SHEET).agg(F.count(F.lit(1)).alias("cells"), filled.alias("filled"))
    return out.where("filled > 0").drop("filled")


@query("p_tables_with_rows", with_fixtures("f3") + f"""
, n AS ({NAMED_SQL}) SELECT case_id, sheet, count(*) AS cells FROM n GROUP BY ALL HAVING count(row_idx) > 0""")
def p_tables_with_rows(spark, sf):
    """Tables that have rows."""
    kept = sh.nonempty(named_cells(spark, sf), ["case_id", "sheet"])
    return kept.groupBy("case_id", "sheet").agg(F.count(F.lit(1)).alias("cells"))


_SPARSE = "SELECT case_id, side, sheet, row_idx, col_idx, CASE WHEN col_idx >= 3 AND right(case_id, 1) IN ('0', '2', '4', '6', '8') THEN ' ' ELSE value END AS value FROM f3"


@query("w_trim_columns", with_fixtures("f3") + f"""
, s AS ({_SPARSE}), l AS (SELECT case_id, side, sheet, max(col_idx) FILTER (WHERE NOT {q.empty('value')}) AS last_col FROM s GROUP BY ALL)
SELECT case_id, side, sheet, max(col_idx) AS kept_columns, count(*) AS cells FROM s JOIN l USING (case_id, side, sheet)
WHERE col_idx <= coalesce(last_col, 1) GROUP BY ALL""")
def w_trim_columns(spark, sf):
    """Trailing empty columns dropped."""
    sparse = spark.sql(_SPARSE.replace("FROM f3", "FROM {f3}"), f3=fixture(spark, sf, "f3"))
    kept = sh.trim_columns(sparse, SHEET)
    return kept.groupBy(*SHEET).agg(F.max("col_idx").alias("kept_columns"), F.count(F.lit(1)).alias("cells"))


_RAW_HEADERS = """
SELECT o_custkey AS table_id, o_orderkey AS col_idx,
       CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS name FROM orders"""


@query("w_header_dedupe", f"""
SELECT table_id, col_idx, CASE WHEN n = 1 THEN b ELSE b || '_' || CAST(n - 1 AS VARCHAR) END AS header
FROM (SELECT *, row_number() OVER (PARTITION BY table_id, b ORDER BY col_idx) AS n
      FROM (SELECT *, CASE WHEN coalesce(name, '') = '' THEN 'Column_' || CAST(col_idx AS VARCHAR) ELSE name END AS b FROM ({_RAW_HEADERS}) r) s) t""")
def w_header_dedupe(spark, sf):
    """Blank and repeated header names made unique."""
    raw = spark.sql(_RAW_HEADERS.replace("FROM orders", f"FROM parquet.`{sf}/orders.parquet`"))
    return dedupe_names(raw, ["table_id"], "col_idx", "name").select("table_id", "col_idx", "header")


_TYPED = """
SELECT CONCAT(CAST(o_custkey AS VARCHAR(20)), '-', o_orderstatus, '-', o_orderpriority) AS table_id, o_orderkey AS row_idx, CAST(col_idx AS INT) AS col_idx,
       CASE WHEN col_idx = 1 THEN o_orderpriority WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR(20)) ELSE 'n/a' END AS value
FROM (SELECT *, {each} AS col_idx FROM orders) x"""


@query("w_lone_header", "WITH c AS (" + _TYPED.format(each="unnest([1, 2])") + f""")
SELECT table_id, count(DISTINCT row_idx) = 1 AS single_row, bool_or({q.number('value')} IS NOT NULL) AS has_typed_cell,
       count(DISTINCT row_idx) = 1 AND bool_or({q.number('value')} IS NOT NULL) AS first_row_is_data FROM c GROUP BY ALL""")
def w_lone_header(spark, sf):
    """A lone first row with a non-text cell is data, not a header; cell types are read off the values."""
    cells = spark.sql(_TYPED.format(each="explode(array(1, 2))").replace("FROM orders", f"FROM parquet.`{sf}/orders.parquet`"))
    kind = F.when(try_numeric(F.col("value")).isNotNull(), "number").otherwise("text")
    return sh.lone_headers(cells.withColumn("kind", kind), ["table_id"])


_TRUNC = with_fixtures("f3") + _ROWSIG + """
, k AS (SELECT *, row_number() OVER (PARTITION BY case_id, side, sheet ORDER BY row_idx) - 1 AS pos,
        count(*) OVER (PARTITION BY case_id, side, sheet) AS n_rows FROM r WHERE NOT e)
, t AS (SELECT case_id, side, sheet, pos, n_rows, 'row' AS kind, 0 AS omitted, row_idx FROM k WHERE n_rows <= 500 OR pos < 100 OR pos >= n_rows - 50
        UNION ALL SELECT DISTINCT case_id, side, sheet, 100, n_rows, 'marker', n_rows - 150, CAST(NULL AS BIGINT) FROM k WHERE n_rows > 500)
"""


@query("w_truncate_head_tail", _TRUNC + "SELECT * FROM t")
def w_truncate_head_tail(spark, sf):
    """First 100 rows, a marker and the last 50 rows of tables above 500 rows."""
    rows = sh.truncate_rows(fixture(spark, sf, "f3"), SHEET)
    return rows.select(*SHEET, "pos", "n_rows", "kind", "omitted", "row_idx")


@query("set_union_all", _TRUNC + "SELECT case_id, side, sheet, kind, count(*) AS n FROM t GROUP BY ALL")
def set_union_all(spark, sf):
    """Kept rows and markers in one table."""
    rows = sh.truncate_rows(fixture(spark, sf, "f3"), SHEET)
    return rows.groupBy(*SHEET, "kind").agg(F.count(F.lit(1)).alias("n"))


@query("set_union_last_wins", """
SELECT c_name AS sheet, max(c_custkey) AS file_idx FROM (SELECT c_mktsegment AS c_name, c_custkey FROM customer
UNION ALL SELECT o_orderpriority, o_orderkey FROM orders) t GROUP BY ALL""")
def set_union_last_wins(spark, sf):
    """Sheets of many inputs merged; the later file wins on equal names."""
    a = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("sheet"), F.col("c_custkey").alias("file_idx"))
    b = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("sheet"), F.col("o_orderkey").alias("file_idx"))
    return a.unionByName(b).groupBy("sheet").agg(F.max("file_idx").alias("file_idx"))


def sheet_views(spark, sf):
    """CSV view of every generated sheet with its visibility."""
    texts = sh.sheet_views(named_cells(spark, sf), ["case_id", "sheet"])
    shown = texts.join(fixture(spark, sf, "f3_visibility"), ["case_id", "sheet"], "left")
    return shown.withColumn("hidden", F.coalesce("hidden", F.lit(False)))


_CSV_FIELD = """CASE WHEN regexp_matches({0}, '[,"\\n\\r]') THEN '"' || replace({0}, '"', '""') || '"' ELSE coalesce({0}, '') END"""
_SHEET_LINES = f"""
, gen AS ({NAMED_SQL})
, hdr AS (SELECT case_id, sheet, string_agg({_CSV_FIELD.format('col_name')}, ',' ORDER BY col_idx) AS header, count(*) AS col_count
          FROM (SELECT DISTINCT case_id, sheet, col_idx, col_name FROM gen) d GROUP BY ALL)
, rw AS (SELECT case_id, sheet, row_idx, string_agg({_CSV_FIELD.format('value')}, ',' ORDER BY col_idx) AS line FROM gen WHERE row_idx IS NOT NULL
         GROUP BY ALL HAVING NOT bool_and({q.empty('value')}))
"""
SHEETS_SQL = _SHEET_LINES + """
, rn AS (SELECT *, row_number() OVER (PARTITION BY case_id, sheet ORDER BY row_idx) - 1 AS pos, count(*) OVER (PARTITION BY case_id, sheet) AS n FROM rw)
, kept AS (SELECT case_id, sheet, pos, line, n FROM rn WHERE n <= 500 OR pos < 100 OR pos >= n - 50
           UNION ALL SELECT DISTINCT rn.case_id, rn.sheet, 100, '[... ' || CAST(n - 150 AS VARCHAR) || ' rows truncated ...]'
                     || repeat(',[... ' || CAST(n - 150 AS VARCHAR) || ' rows truncated ...]', hdr.col_count - 1), n
           FROM rn JOIN hdr ON rn.case_id = hdr.case_id AND rn.sheet = hdr.sheet WHERE n > 500)
, sheets AS (SELECT hdr.case_id, hdr.sheet, any_value(header) || chr(10) || coalesce(string_agg(line, chr(10) ORDER BY pos) || chr(10), '') AS csv_text,
             coalesce(max(n), 0) AS row_count, any_value(col_count) AS col_count, coalesce(max(n), 0) > 500 AS truncated, coalesce(any_value(hidden), false) AS hidden
             FROM hdr LEFT JOIN kept k ON k.case_id = hdr.case_id AND k.sheet = hdr.sheet
             LEFT JOIN f3_visibility v ON hdr.case_id = v.case_id AND hdr.sheet = v.sheet GROUP BY ALL)
"""
_PARTS_SQL = with_fixtures("f3") + _SHEET_LINES + f"""
, al AS (SELECT case_id, sheet, -1 AS row_idx, header AS line FROM hdr UNION ALL SELECT * FROM rw)
, st AS (SELECT *, strlen(line) + 1 AS n_bytes, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY case_id, sheet ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM al)
, pt AS (SELECT *, 2 * (s // {PART_BYTES}) + CASE WHEN s // {PART_BYTES} = (s + n_bytes - 1) // {PART_BYTES} THEN 0 ELSE 1 END AS part FROM st)
"""


@query("src_sheet_csv", _PARTS_SQL + """
SELECT case_id, sheet, part, string_agg(line, chr(10) ORDER BY row_idx) || chr(10) AS csv_text, count(*) AS n_lines FROM pt GROUP BY ALL""")
def src_sheet_csv(spark, sf):
    """Whole CSV text of every sheet in parts of at most 16 KiB."""
    return sh.sheet_texts(named_cells(spark, sf), ["case_id", "sheet"], PART_BYTES)


@query("w_sheet_view", with_fixtures("f3", "f3_visibility") + SHEETS_SQL + "SELECT * FROM sheets")
def w_sheet_view(spark, sf):
    """CSV text of every sheet as a review shows it, long ones by head and tail."""
    return sheet_views(spark, sf)


@query("s_largest_table", _PARTS_SQL + """
SELECT case_id, arg_max(sheet, (n, sheet)) AS sheet, max(n) AS n_bytes FROM (SELECT case_id, sheet, sum(n_bytes)::BIGINT AS n FROM pt GROUP BY ALL) t GROUP BY ALL""")
def s_largest_table(spark, sf):
    """Sheet with the longest whole text per case, from byte sums."""
    sizes = sh.sheet_sizes(sh.sheet_lines(named_cells(spark, sf), ["case_id", "sheet"]), ["case_id", "sheet"])
    return sizes.groupBy("case_id").agg(F.max_by("sheet", F.struct("n_bytes", "sheet")).alias("sheet"), F.max("n_bytes").alias("n_bytes"))
