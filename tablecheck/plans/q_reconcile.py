"""Queries of the reconciliation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecheck.functions.cells import FILL, MATCH, clean_number, is_empty, try_numeric, values_match
from tablecheck.operators import reconcile as rc
from tablecheck.operators.rownum import first_per_key, positions, report_row
from tablecheck.plans import sqltext as q
from tablecheck.plans.fixtures import fixture, with_fixtures
from tablecheck.plans.registry import query, table

F1_KEY = rc.Pair("o_orderkey", "g_key")
F1_PAIRS = [
    F1_KEY,
    rc.Pair("o_custkey", "g_cust"),
    rc.Pair("o_orderstatus", "g_status"),
    rc.Pair("o_totalprice", "g_price"),
    rc.Pair("o_orderpriority", "g_prio"),
]
F2_PAIRS = [rc.Pair(c, c) for c in ("user_id", "event_type", "value", "props")]


def f1_compared(spark, sf):
    """F1 has no empty rows and a dense row index, so no renumbering is needed."""
    src, gen = fixture(spark, sf, "f1_src"), fixture(spark, sf, "f1_gen")
    joined = rc.pair_rows_by_key(src, gen, F1_KEY)
    return src, gen, rc.compare_rows(joined, src, gen, F1_PAIRS, report_row(F.col("row_idx")))


def f2_compared(spark, sf):
    src, gen = (rc.drop_empty_rows(fixture(spark, sf, n), "row_idx") for n in ("f2_src", "f2_gen"))
    joined = rc.pair_rows_by_position(src, gen)
    return src, gen, rc.compare_rows(joined, src, gen, F2_PAIRS, report_row(F.col("pos")))


def _flags(a_b: list[tuple[str, str, str]]) -> str:
    out = []
    for i, (m, a, b) in enumerate(a_b):
        out.append(f"{m} AS m{i}, (NOT {m} AND {a} AND NOT {b}) AS f{i}")
    return ", ".join(out)


_F1_FLAGS = _flags([
    (q.match_numbers("s.o_orderkey", "g.g_key"), "(s.o_orderkey IS NULL)", "(g.g_key IS NULL)"),
    (q.match_numbers("s.o_custkey", "g.g_cust"), "(s.o_custkey IS NULL)", "(g.g_cust IS NULL)"),
    (q.match_text("s.o_orderstatus", "g.g_status"), q.empty("s.o_orderstatus"), q.empty("g.g_status")),
    (q.match_number("s.o_totalprice", "g.g_price"), "(s.o_totalprice IS NULL)", q.empty("g.g_price")),
    (q.match_text("s.o_orderpriority", "g.g_prio"), q.empty("s.o_orderpriority"), q.empty("g.g_prio")),
])
_F1_SHOWN = (
    "CAST(s.o_orderkey AS VARCHAR) AS s0, CAST(g.g_key AS VARCHAR) AS g0, CAST(s.o_custkey AS VARCHAR) AS s1, "
    "CAST(g.g_cust AS VARCHAR) AS g1, s.o_orderstatus AS s2, g.g_status AS g2, "
    "CASE WHEN s.o_totalprice = floor(s.o_totalprice) THEN CAST(CAST(s.o_totalprice AS BIGINT) AS VARCHAR) "
    "ELSE CAST(s.o_totalprice AS VARCHAR) END AS s3, g.g_price AS g3, s.o_orderpriority AS s4, g.g_prio AS g4"
)
F1_CMP = with_fixtures("f1_src", "f1_gen") + f"""
, g AS (SELECT * FROM f1_gen QUALIFY row_number() OVER (PARTITION BY g_key ORDER BY row_idx) = 1)
, cmp AS (SELECT s.row_idx + 2 AS row_index, {_F1_FLAGS}, {_F1_SHOWN}
          FROM f1_src s JOIN g ON s.o_orderkey IS NOT DISTINCT FROM g.g_key)
"""
_F2_FLAGS = _flags([
    (q.match_numbers("s.user_id", "g.user_id"), "(s.user_id IS NULL)", "(g.user_id IS NULL)"),
    (q.match_text("s.event_type", "g.event_type"), q.empty("s.event_type"), q.empty("g.event_type")),
    (q.match_numbers("s.value", "g.value"), "(s.value IS NULL)", "(g.value IS NULL)"),
    (q.match_text("s.props", "g.props"), q.empty("s.props"), q.empty("g.props")),
])
F2_SIDES = with_fixtures("f2_src", "f2_gen") + f"""
, s AS (SELECT *, row_number() OVER (ORDER BY row_idx) - 1 AS pos FROM f2_src
        WHERE NOT (user_id IS NULL AND {q.empty('event_type')} AND value IS NULL AND {q.empty('props')}))
, g AS (SELECT *, row_number() OVER (ORDER BY row_idx) - 1 AS pos FROM f2_gen)
, cmp AS (SELECT s.pos + 2 AS row_index, {_F2_FLAGS} FROM s JOIN g ON s.pos = g.pos)
"""


def _ok(n: int) -> str:
    return " AND ".join(f"(m{i} OR f{i})" for i in range(n))


def _fills(n: int) -> str:
    return " + ".join(f"CAST(f{i} AS BIGINT)" for i in range(n))


def _totals(n: int, src: str, gen: str, method: str, key: str) -> str:
    return f"""
SELECT (SELECT count(*) FROM {src}) AS source_rows, (SELECT count(*) FROM {gen}) AS generated_rows,
       count(*) AS comparable_rows, count(*) FILTER (WHERE {_ok(n)}) AS matched_rows,
       CAST(coalesce(sum({_fills(n)}), 0) AS BIGINT) AS expected_fill_cells,
       round(count(*) FILTER (WHERE {_ok(n)}) * 100.0 / count(*), 6) AS match_pct,
       '{method}' AS match_method, {key} AS key_column
FROM cmp"""


def _round_pct(df):
    return df.withColumn("match_pct", F.round("match_pct", 6))


@query("j_keyed_diff", F1_CMP + f"""
SELECT row_index, {_ok(5)} AS row_matched, {_fills(5)} AS fill_cells,
       {' + '.join(f'CAST(NOT m{i} AS BIGINT)' for i in range(5))} AS unequal_cells FROM cmp""")
def j_keyed_diff(spark, sf):
    """One row per source row whose key occurs in the generated table."""
    _, _, cmp = f1_compared(spark, sf)
    return cmp.select(
        "row_index",
        rc.row_matched(5).alias("row_matched"),
        rc.cells_with(5, FILL).alias("fill_cells"),
        (5 - rc.cells_with(5, MATCH)).alias("unequal_cells"),
    )


@query("j_positional_diff", F2_SIDES + f"""
SELECT row_index, m0, m1, m2, m3, {_ok(4)} AS row_matched FROM cmp""")
def j_positional_diff(spark, sf):
    """Row i against row i after empty rows are gone."""
    _, _, cmp = f2_compared(spark, sf)
    return cmp.select(
        "row_index", *[(F.col(f"c{i}") == MATCH).alias(f"m{i}") for i in range(4)], rc.row_matched(4).alias("row_matched"))


@query("agg_compare", F1_CMP + _totals(5, "f1_src", "f1_gen", "key_based", "'o_orderkey'"))
def agg_compare(spark, sf):
    src, gen, cmp = f1_compared(spark, sf)
    return _round_pct(rc.comparison(cmp, src, gen, F1_PAIRS, "key_based", "o_orderkey"))


@query("agg_compare_positional", F2_SIDES + _totals(4, "s", "g", "positional", "CAST(NULL AS VARCHAR)"))
def agg_compare_positional(spark, sf):
    src, gen, cmp = f2_compared(spark, sf)
    return _round_pct(rc.comparison(cmp, src, gen, F2_PAIRS, "positional"))


_COLS_SQL = "\nUNION ALL\n".join(
    f"SELECT {i} AS col_order, '{p.source}' AS source_col, '{p.generated}' AS generated_col, "
    f"count(*) FILTER (WHERE m{i}) AS matching_cells, round(count(*) FILTER (WHERE m{i}) * 100.0 / count(*), 6) AS value_match_pct FROM cmp"
    for i, p in enumerate(F1_PAIRS)
)


@query("agg_column_match_pct", F1_CMP + _COLS_SQL)
def agg_column_match_pct(spark, sf):
    _, _, cmp = f1_compared(spark, sf)
    out = rc.column_match(cmp, F1_PAIRS).drop("match_type", "confidence")
    return out.withColumn("value_match_pct", F.round("value_match_pct", 6))


def _diff_union(n: int, names: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT row_index, {i} AS col_order, '{names[i]}' AS \"column\", s{i} AS source_value, g{i} AS generated_value, "
        f"CASE WHEN f{i} THEN 'expected_fill' ELSE 'diff' END AS kind FROM cmp WHERE NOT m{i}"
        for i in range(n)
    )


@query("row_diff", F1_CMP + f", d AS ({_diff_union(5, [p.source for p in F1_PAIRS])}) SELECT * FROM d")
def row_diff(spark, sf):
    """Every differing cell, uncapped."""
    _, _, cmp = f1_compared(spark, sf)
    return rc.cell_diffs(cmp, F1_PAIRS)


@query("w_cap_diffs", F1_CMP + f", d AS ({_diff_union(5, [p.source for p in F1_PAIRS])})" + """
SELECT row_index, "column", left(source_value, 100) AS source_value, left(generated_value, 100) AS generated_value, kind
FROM d QUALIFY row_number() OVER (PARTITION BY kind ORDER BY row_index, col_order) <= CASE kind WHEN 'diff' THEN 50 ELSE 10 END""")
def w_cap_diffs(spark, sf):
    """First 50 differences and 10 fills."""
    _, _, cmp = f1_compared(spark, sf)
    return rc.capped_diffs(rc.cell_diffs(cmp, F1_PAIRS))


@query("agg_error_band", F1_CMP + "\nUNION ALL\n".join(
    f"SELECT '{p.source}' AS source_col, CASE WHEN x > 0.15 THEN 0 WHEN x >= 0.05 THEN 1 WHEN x > 0 THEN 2 ELSE 3 END AS band "
    f"FROM (SELECT 1 - count(*) FILTER (WHERE m{i}) * 1.0 / count(*) AS x FROM cmp) t" for i, p in enumerate(F1_PAIRS)))
def agg_error_band(spark, sf):
    """Severity band of every column from its share of wrong cells."""
    _, _, cmp = f1_compared(spark, sf)
    cols = rc.column_match(cmp, F1_PAIRS)
    return cols.select("source_col", rc.error_band(1 - F.col("value_match_pct") / 100).alias("band"))


@query("p_row_ratio_note", with_fixtures("f1_src", "f1_gen", "f2_gen") + """
SELECT pair, source_rows, generated_rows,
       CASE WHEN generated_rows = 0 THEN NULL WHEN generated_rows * 1.0 / source_rows < 0.3 THEN 'filtered subset'
            WHEN generated_rows * 1.0 / source_rows > 3 THEN 'expanded' END AS note
FROM (SELECT 'all' AS pair, (SELECT count(*) FROM f1_src) AS source_rows, (SELECT count(*) FROM f1_gen) AS generated_rows
      UNION ALL SELECT 'urgent', (SELECT count(*) FROM f1_src), (SELECT count(*) FROM f1_gen WHERE g_prio = '1-URGENT')
      UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), (SELECT count(*) FROM f1_gen)) t""")
def p_row_ratio_note(spark, sf):
    """Hint when one side is much larger than the other."""
    src, gen, cust = fixture(spark, sf, "f1_src"), fixture(spark, sf, "f1_gen"), table(spark, sf, "customer")
    count = lambda df, pair, col: df.agg(F.lit(pair).alias("pair"), F.count(F.lit(1)).alias(col))
    urgent = gen.where(F.col("g_prio") == "1-URGENT")
    sides = [(src, gen, "all"), (src, urgent, "urgent"), (cust, gen, "customer")]
    parts = [count(s, p, "source_rows").unionByName(count(g, p, "generated_rows"), allowMissingColumns=True) for s, g, p in sides]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    both = both.groupBy("pair").agg(F.max("source_rows").alias("source_rows"), F.max("generated_rows").alias("generated_rows"))
    return both.withColumn("note", rc.row_ratio_note())


@query("p_low_match_note", F2_SIDES + f"""
SELECT match_pct, CASE WHEN match_pct < 50 AND n > 0 THEN 'low match, row order may differ' END AS note
FROM (SELECT count(*) AS n, round(count(*) FILTER (WHERE {_ok(4)}) * 100.0 / count(*), 6) AS match_pct FROM cmp) t""")
def p_low_match_note(spark, sf):
    """Warning for a poor match rate, worded by matching method."""
    src, gen, cmp = f2_compared(spark, sf)
    out = rc.comparison(cmp, src, gen, F2_PAIRS, "positional")
    return _round_pct(out.select("match_pct", rc.low_match_note().alias("note")))


@query("j_unmatched_keys", with_fixtures("f1_src", "f1_gen") + "SELECT row_idx, o_orderkey FROM f1_src WHERE o_orderkey NOT IN (SELECT g_key FROM f1_gen)")
def j_unmatched_keys(spark, sf):
    """Source rows without a generated row."""
    src, gen = fixture(spark, sf, "f1_src"), fixture(spark, sf, "f1_gen")
    return rc.unmatched(src, gen, "o_orderkey", "g_key").select("row_idx", "o_orderkey")


@query("j_extra_keys", with_fixtures("f1_src", "f1_gen") + """
SELECT row_idx, g_key FROM f1_gen WHERE g_key NOT IN (SELECT o_orderkey FROM f1_src WHERE o_orderpriority IS NOT NULL)""")
def j_extra_keys(spark, sf):
    """Generated rows unknown to the source (here: to its prioritised rows)."""
    src, gen = fixture(spark, sf, "f1_src"), fixture(spark, sf, "f1_gen")
    return rc.unmatched(gen, src.where("o_orderpriority IS NOT NULL"), "g_key", "o_orderkey").select("row_idx", "g_key")


def _stat_sql(i: int, s: str, g: str) -> str:
    return f"""
SELECT {i} AS pair, round((SELECT count(DISTINCT {s}) * 1.0 / nullif(count({s}), 0) FROM f1_src), 9) AS src_unique,
       round((SELECT count(DISTINCT {g}) * 1.0 / nullif(count({g}), 0) FROM f1_gen), 9) AS gen_unique,
       round((SELECT count(*) * 1.0 FROM (SELECT DISTINCT CAST({g} AS VARCHAR) v FROM f1_gen WHERE {g} IS NOT NULL
              INTERSECT SELECT DISTINCT CAST({s} AS VARCHAR) FROM f1_src) t)
             / (SELECT nullif(count(DISTINCT {g}), 0) FROM f1_gen), 9) AS gen_in_src"""


_KEY_SQL = with_fixtures("f1_src", "f1_gen") + ", st AS (" + "\nUNION ALL\n".join(
    _stat_sql(i, s, g) for i, (s, g) in enumerate([
        ("o_orderstatus", "g_status"), ("o_custkey", "g_cust"), ("o_orderkey", "g_key"), ("o_orderpriority", "g_prio")])
) + ")"
_KEY_PAIRS = [rc.Pair("o_orderstatus", "g_status"), rc.Pair("o_custkey", "g_cust"), F1_KEY, rc.Pair("o_orderpriority", "g_prio")]


@query("agg_key_candidates", _KEY_SQL + """
SELECT *, coalesce(src_unique >= 0.9 AND gen_unique >= 0.9 AND gen_in_src >= 0.5, false) AS is_key FROM st""")
def agg_key_candidates(spark, sf):
    """Uniqueness and containment of every candidate key in one pass."""
    stats = rc.is_key(rc.key_statistics(fixture(spark, sf, "f1_src"), fixture(spark, sf, "f1_gen"), _KEY_PAIRS))
    return stats.select("pair", *[F.round(c, 9).alias(c) for c in ("src_unique", "gen_unique", "gen_in_src")], "is_key")


@query("j_key_containment", _KEY_SQL + " SELECT pair, gen_in_src FROM st")
def j_key_containment(spark, sf):
    """Share of distinct generated keys found in the source."""
    stats = rc.key_statistics(fixture(spark, sf, "f1_src"), fixture(spark, sf, "f1_gen"), _KEY_PAIRS)
    return stats.select("pair", F.round("gen_in_src", 9).alias("gen_in_src"))


@query("set_intersect_values", with_fixtures("f1_src", "f1_gen") + """
SELECT count(*) AS shared_values FROM (SELECT o_custkey FROM f1_src INTERSECT SELECT g_cust FROM f1_gen) t""")
def set_intersect_values(spark, sf):
    """Key values both sides share."""
    src, gen = fixture(spark, sf, "f1_src"), fixture(spark, sf, "f1_gen")
    return src.select("o_custkey").intersect(gen.select("g_cust")).agg(F.count(F.lit(1)).alias("shared_values"))


@query("w_first_per_key", with_fixtures("f1_gen") + """
SELECT row_idx, g_key, g_price FROM f1_gen QUALIFY row_number() OVER (PARTITION BY g_key ORDER BY row_idx) = 1""")
def w_first_per_key(spark, sf):
    return first_per_key(fixture(spark, sf, "f1_gen"), ["g_key"], ["row_idx"]).select("row_idx", "g_key", "g_price")


@query("w_row_index", with_fixtures("f2_src") + """
SELECT row_idx, row_number() OVER (ORDER BY row_idx) - 1 AS pos, row_number() OVER (ORDER BY row_idx) + 1 AS row_index FROM f2_src""")
def w_row_index(spark, sf):
    """0-based position and reported row number of every row."""
    src = positions(fixture(spark, sf, "f2_src"), "row_idx")
    return src.select("row_idx", "pos", report_row(F.col("pos")).alias("row_index"))


@query("p_empty", with_fixtures("f3") + f"""
SELECT side, sheet, col_name, count(*) AS cells, count(*) FILTER (WHERE {q.empty('value')}) AS empty_cells
FROM f3 GROUP BY ALL""")
def p_empty(spark, sf):
    return fixture(spark, sf, "f3").groupBy("side", "sheet", "col_name").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(is_empty(F.col("value"))).alias("empty_cells"))


@query("p_drop_empty_rows", with_fixtures("f2_src", "f2_gen") + "\nUNION ALL\n".join(f"""
SELECT '{side}' AS side, count(*) AS total_rows, count(*) FILTER (WHERE user_id IS NULL AND {q.empty('event_type')}
       AND value IS NULL AND {q.empty('props')}) AS empty_rows FROM f2_{t}""" for side, t in (("source", "src"), ("generated", "gen"))))
def p_drop_empty_rows(spark, sf):
    """Rows dropped per side before a comparison."""
    sides = {"source": fixture(spark, sf, "f2_src"), "generated": fixture(spark, sf, "f2_gen")}
    return rc.empty_row_counts(sides, "row_idx")


_MATCH_IN = """
SELECT o_orderkey AS k,
       CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN CONCAT(CAST(o_custkey AS VARCHAR), 'd')
            WHEN 3 THEN 'nan' WHEN 4 THEN CONCAT('$', CAST(o_custkey AS VARCHAR), '.0') WHEN 5 THEN '1,000'
            WHEN 6 THEN CAST(o_orderkey AS VARCHAR) WHEN 7 THEN 'inf' ELSE o_orderpriority END AS a,
       CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN CAST(o_custkey AS VARCHAR) WHEN 3 THEN 'nan'
            WHEN 4 THEN CAST(o_orderkey + 1 AS VARCHAR) WHEN 5 THEN '1_000' ELSE o_orderpriority END AS b
FROM orders"""


def _match_in(spark, sf):
    return spark.sql(_MATCH_IN.replace("AS VARCHAR", "AS STRING").replace("FROM orders", f"FROM parquet.`{sf}/orders.parquet`"))


@query("p_values_match", f"WITH t AS ({_MATCH_IN}) SELECT k, {q.match_text('a', 'b')} AS is_match, "
       f"(NOT {q.match_text('a', 'b')} AND {q.empty('a')} AND NOT {q.empty('b')}) AS is_fill FROM t")
def p_values_match(spark, sf):
    """Tolerant equality and expected fill of two text columns."""
    m = values_match(F.col("a"), F.col("b"))
    out = _match_in(spark, sf).select("k", m.alias("is_match"), (is_empty(F.col("a")) & ~is_empty(F.col("b"))).alias("e"))
    return out.select("k", "is_match", (~F.col("is_match") & F.col("e")).alias("is_fill"))


@query("f_clean_number", with_fixtures("f1_gen") + f"SELECT row_idx, {q.clean('g_price')} AS cleaned FROM f1_gen")
def f_clean_number(spark, sf):
    return fixture(spark, sf, "f1_gen").select("row_idx", clean_number(F.col("g_price")).alias("cleaned"))


@query("f_try_numeric", f"WITH t AS ({_MATCH_IN}) SELECT k, CASE WHEN isnan({q.number('a')}) THEN -1 WHEN isinf({q.number('a')}) THEN -2 "
       f"ELSE {q.number('a')} END AS x FROM t")
def f_try_numeric(spark, sf):
    x = try_numeric(F.col("a"))
    return _match_in(spark, sf).select("k", F.when(F.isnan(x), -1.0).when(F.abs(x) == float("inf"), -2.0).otherwise(x).alias("x"))
