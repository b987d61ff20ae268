"""Queries over a whole corpus: table pairs, column mappings, keys, row comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecheck.functions import naming
from tablecheck.operators import corpus as co, matching as mt, report as rpt, workbook as wb
from tablecheck.plans import sqltext as q
from tablecheck.plans.fixtures import fixture, fixture_sql
from tablecheck.plans.q_context import LINES_TAIL
from tablecheck.plans.registry import query, table
from tablecheck.session import cut_lineage

PAIR = co.PAIR


def similarity_sql(pairs: str) -> str:
    """CTEs that give ``sim`` (a, b, ratio) for ``pairs`` (a, b; distinct lower-case names).

    The ratio is twice the characters in matching blocks over all characters: the longest common block (leftmost in ``a``, then in
    ``b``), and the same again on both sides of it.  ``lcs`` holds how long the names agree from every pair of places.
    """
    best = (
        "list_sort(list_transform(list_filter(m, lambda c: c.i >= al AND c.i < ah AND c.j >= bl AND c.j < bh), "
        "lambda c: {'k': least(c.k, ah - c.i, bh - c.j), 'ni': -c.i, 'nj': -c.j}), 'DESC')[1]"
    )
    return f"""
lcs AS (
  SELECT a, b, list({{'k': k, 'i': i, 'j': j}}) FILTER (WHERE k > 0) AS m
  FROM (SELECT a, b, i, j, len(list_filter(range(1, least(length(a) - i, length(b) - j) + 1), lambda k: substr(a, i + 1, k) = substr(b, j + 1, k))) AS k
        FROM (SELECT a, b, i, unnest(range(0, length(b))) AS j FROM (SELECT a, b, unnest(range(0, length(a))) AS i FROM {pairs}) x) y) z GROUP BY a, b),
blk(a, b, m, al, ah, bl, bh) AS (
  SELECT a, b, m, 0::BIGINT, length(a), 0::BIGINT, length(b) FROM lcs WHERE m IS NOT NULL
  UNION ALL
  SELECT a, b, m, w.al, w.ah, w.bl, w.bh
  FROM (SELECT a, b, m, unnest([{{'al': al, 'ah': -z.ni, 'bl': bl, 'bh': -z.nj}}, {{'al': z.k - z.ni, 'ah': ah, 'bl': z.k - z.nj, 'bh': bh}}]) AS w
        FROM (SELECT *, {best} AS z FROM blk) u WHERE z IS NOT NULL) v
  WHERE w.al < w.ah AND w.bl < w.bh),
sim AS (
  SELECT p.a, p.b, CASE WHEN length(p.a) + length(p.b) = 0 THEN 1.0 ELSE 2.0 * coalesce(s.k, 0) / (length(p.a) + length(p.b)) END::DOUBLE AS ratio
  FROM {pairs} p LEFT JOIN (SELECT a, b, sum(({best}).k) AS k FROM blk GROUP BY a, b) s ON s.a = p.a AND s.b = p.b)"""


def greedy_sql(name: str, candidates: str, accept: float) -> str:
    """CTEs that give every source ``sn`` of a unit ``u``, in order, the best unused target ``gn`` (earlier ones win ties), null below ``accept``."""
    return f"""
{name}_c AS (SELECT u, list({{'sn': sn, 'gn': gn, 'score': score}}) AS c, max(sn) AS last FROM {candidates} GROUP BY u),
{name}(u, c, last, sn, used, gn, score) AS (
  SELECT u, c, last, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::DOUBLE FROM {name}_c
  UNION ALL
  SELECT u, c, last, sn + 1, CASE WHEN ok THEN list_append(used, -z.neg) ELSE used END, CASE WHEN ok THEN -z.neg END, CASE WHEN ok THEN z.score END
  FROM (SELECT *, coalesce(z.score >= {accept}, false) AS ok FROM (
    SELECT *, list_sort(list_transform(list_filter(c, lambda x: x.sn = sn + 1 AND x.score > 0 AND NOT list_contains(used, x.gn)),
                                       lambda x: {{'score': x.score, 'neg': -x.gn}}), 'DESC')[1] AS z
    FROM {name} WHERE sn < last) o) r)"""


def _with(cells: str, *more: str) -> str:
    """The corpus ``cells`` under the name f3, its visibility and ``more`` fixtures."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({fixture_sql(f)})" for n, f in [("f3", cells), *((m, m) for m in ("f3_visibility", *more))])


_PAIRS_TAIL = f"""
, t AS (SELECT case_id, side, sheet, list(DISTINCT col_name) AS cols FROM f3
        WHERE side = 'source' OR (case_id, sheet) NOT IN (SELECT (case_id, sheet) FROM f3_visibility WHERE hidden) GROUP BY ALL)
, c3 AS (SELECT DISTINCT case_id, side, sheet, col_idx, col_name FROM f3)
, np AS (SELECT DISTINCT lower(s.sheet) AS a, lower(g.sheet) AS b FROM t s JOIN t g ON s.side = 'source' AND g.side = 'generated' AND s.case_id = g.case_id
         UNION SELECT DISTINCT lower(s.col_name), lower(g.col_name) FROM c3 s JOIN c3 g ON s.side = 'source' AND g.side = 'generated' AND s.case_id = g.case_id)
, {similarity_sql('np')}
, tn AS (SELECT *, row_number() OVER (PARTITION BY case_id, side ORDER BY sheet) AS n FROM t)
, tc AS (SELECT s.case_id AS u, s.n AS sn, g.n AS gn, 0.3 * ratio + 0.7 * (len(list_intersect(s.cols, g.cols)) / len(list_distinct(list_concat(s.cols, g.cols)))) AS score
         FROM tn s JOIN tn g ON s.case_id = g.case_id AND s.side = 'source' AND g.side = 'generated' JOIN sim ON sim.a = lower(s.sheet) AND sim.b = lower(g.sheet))
, {greedy_sql('tg', 'tc', 0.2)}
, p AS (SELECT s.case_id, s.sheet AS source_sheet, g.sheet AS generated_sheet, score, tg.sn = min(tg.sn) OVER (PARTITION BY tg.u) AS is_first,
               s.case_id || chr(1) || s.sheet || chr(1) || g.sheet AS pid
        FROM tg JOIN tn s ON s.case_id = tg.u AND s.side = 'source' AND s.n = tg.sn JOIN tn g ON g.case_id = tg.u AND g.side = 'generated' AND g.n = tg.gn
        WHERE tg.gn IS NOT NULL)
"""
_OVERLAP = """
, hv AS (SELECT DISTINCT case_id, side, sheet, col_idx, value FROM f3 WHERE value IS NOT NULL AND (case_id, side, sheet) IN (SELECT (case_id, side, sheet) FROM t))
, hn AS (SELECT case_id, side, sheet, col_idx, count(*) AS n FROM hv GROUP BY ALL)
, ov AS (SELECT x.*, a.n AS source_values, b.n AS generated_values, shared / (a.n + b.n - shared) AS overlap
         FROM (SELECT s.case_id, s.sheet AS source_sheet, s.col_idx AS s_idx, g.sheet AS generated_sheet, g.col_idx AS g_idx, count(*) AS shared
               FROM hv s JOIN hv g ON s.case_id = g.case_id AND s.value = g.value AND s.side = 'source' AND g.side = 'generated' GROUP BY ALL) x
         JOIN hn a ON a.case_id = x.case_id AND a.side = 'source' AND a.sheet = x.source_sheet AND a.col_idx = x.s_idx
         JOIN hn b ON b.case_id = x.case_id AND b.side = 'generated' AND b.sheet = x.generated_sheet AND b.col_idx = x.g_idx)
"""
_COLUMNS_TAIL = _OVERLAP + f"""
, cs AS (SELECT pid, col_idx, col_name FROM p JOIN c3 ON c3.case_id = p.case_id AND c3.side = 'source' AND c3.sheet = p.source_sheet)
, cg AS (SELECT pid, col_idx, col_name FROM p JOIN c3 ON c3.case_id = p.case_id AND c3.side = 'generated' AND c3.sheet = p.generated_sheet)
, ex AS (SELECT s.pid, s.col_idx AS si, s.col_name AS sc, g.col_idx AS gi, g.col_name AS gc
         FROM (SELECT pid, lower(col_name) AS low, min(col_idx) AS col_idx, arg_min(col_name, col_idx) AS col_name FROM cs GROUP BY ALL) s
         JOIN (SELECT pid, lower(col_name) AS low, max(col_idx) AS col_idx, arg_max(col_name, col_idx) AS col_name FROM cg GROUP BY ALL) g USING (pid, low))
, rs AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY col_idx) AS n FROM cs WHERE (pid, col_idx) NOT IN (SELECT (pid, si) FROM ex))
, rg AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY col_idx) AS n FROM cg WHERE (pid, col_idx) NOT IN (SELECT (pid, gi) FROM ex))
, cc AS (SELECT s.pid AS u, s.n AS sn, g.n AS gn, ratio, 0.6 * ratio + 0.4 * coalesce(overlap, 0) AS score, s.col_idx AS si, s.col_name AS sc, g.col_idx AS gi, g.col_name AS gc
         FROM rs s JOIN rg g USING (pid) JOIN p USING (pid) JOIN sim ON sim.a = lower(s.col_name) AND sim.b = lower(g.col_name)
         LEFT JOIN ov ON ov.case_id = p.case_id AND ov.source_sheet = p.source_sheet AND ov.generated_sheet = p.generated_sheet AND s_idx = s.col_idx AND g_idx = g.col_idx)
, {greedy_sql('cgr', 'cc', 0.3)}
, mp AS (SELECT pid, si, sc, gi, gc, 'exact_name' AS match_type, 1.0::DOUBLE AS confidence, 0 AS phase FROM ex
         UNION ALL SELECT cc.u, si, sc, gi, gc, CASE WHEN ratio > 0.5 THEN 'fuzzy_name' ELSE 'value_overlap' END, cc.score, 1
         FROM cgr JOIN cc ON cc.u = cgr.u AND cc.sn = cgr.sn AND cc.gn = cgr.gn)
, mo AS (SELECT *, row_number() OVER w - 1 AS ord, CASE WHEN confidence >= 0.5 THEN sum(CASE WHEN confidence >= 0.5 THEN 1 ELSE 0 END) OVER w - 1 END AS cmp
         FROM mp WINDOW w AS (PARTITION BY pid ORDER BY phase, si))
"""
_ROWS_TAIL = f"""
, pc AS (SELECT pid, f3.side, row_idx, col_idx, value FROM f3 JOIN p ON p.case_id = f3.case_id
         AND f3.sheet = CASE f3.side WHEN 'source' THEN p.source_sheet ELSE p.generated_sheet END)
, rf AS (SELECT pid, side, row_idx, NOT bool_and({q.empty('value')}) AS filled FROM pc GROUP BY ALL)
, ps AS (SELECT *, row_number() OVER (PARTITION BY pid, side ORDER BY row_idx) - 1 AS pos FROM rf WHERE filled)
, cv AS (SELECT pid, side, row_idx, pos, cmp, sc, value FROM ps JOIN pc USING (pid, side, row_idx) JOIN mo USING (pid)
         WHERE cmp IS NOT NULL AND col_idx = CASE side WHEN 'source' THEN si ELSE gi END)
, st AS (SELECT pid, cmp, count(*) FILTER (ns > 0) / sum(ns) AS su, count(*) FILTER (ng > 0) / sum(ng) AS gu, count(*) FILTER (ns > 0 AND ng > 0) / count(*) FILTER (ng > 0) AS gs
         FROM (SELECT pid, cmp, value, count(*) FILTER (side = 'source') AS ns, count(*) FILTER (side = 'generated') AS ng FROM cv WHERE value IS NOT NULL GROUP BY ALL) x GROUP BY ALL)
, ky AS (SELECT pid, min(cmp) AS cmp FROM st WHERE su >= 0.9 AND gu >= 0.9 AND gs >= 0.5 GROUP BY ALL)
, kv AS (SELECT pid, side, row_idx, pos, value FROM cv JOIN ky USING (pid, cmp))
, jr AS (SELECT s.pid, s.row_idx AS sr, s.pos, g.row_idx AS gr FROM kv s
         JOIN (SELECT * FROM kv WHERE side = 'generated' QUALIFY row_number() OVER (PARTITION BY pid, value ORDER BY row_idx) = 1) g
         ON s.pid = g.pid AND s.value IS NOT DISTINCT FROM g.value WHERE s.side = 'source'
         UNION ALL SELECT s.pid, s.row_idx, s.pos, g.row_idx FROM ps s JOIN ps g ON s.pid = g.pid AND s.pos = g.pos AND s.side = 'source' AND g.side = 'generated'
         WHERE s.pid NOT IN (SELECT pid FROM ky) AND s.pid IN (SELECT pid FROM mo WHERE cmp IS NOT NULL))
, cm AS (SELECT *, NOT ok AND {q.empty('sv')} AND NOT {q.empty('gv')} AS fill
         FROM (SELECT jr.pid, jr.pos + 2 AS row_index, a.cmp, a.sc, a.value AS sv, b.value AS gv, {q.match_text('a.value', 'b.value')} AS ok
               FROM jr JOIN cv a ON a.pid = jr.pid AND a.side = 'source' AND a.row_idx = jr.sr
               JOIN cv b ON b.pid = jr.pid AND b.side = 'generated' AND b.row_idx = jr.gr AND b.cmp = a.cmp) x)
"""


_TOTALS_TAIL = """
, sz AS (SELECT pid, count(*) FILTER (side = 'source' AND filled) AS source_rows, count(*) FILTER (side = 'generated' AND filled) AS generated_rows,
                count(*) FILTER (NOT filled) AS empty_rows_dropped FROM rf GROUP BY ALL)
, mc AS (SELECT pid, count(*) AS mapped_columns, count(cmp) AS compared_columns FROM mo GROUP BY ALL)
, rw AS (SELECT pid, row_index, bool_and(ok OR fill) AS m, count(*) FILTER (fill) AS f, count(*) FILTER (NOT ok AND NOT fill) AS d FROM cm GROUP BY ALL)
, ct AS (SELECT pid, count(*) AS n, count(*) FILTER (m) AS matched, sum(f)::BIGINT AS f, sum(d)::BIGINT AS d FROM rw GROUP BY ALL)
, tt AS (
  SELECT p.pid, case_id, source_sheet, generated_sheet, is_first, coalesce(source_rows, 0) AS source_rows, coalesce(generated_rows, 0) AS generated_rows,
         coalesce(empty_rows_dropped, 0) AS empty_rows_dropped, coalesce(mapped_columns, 0) AS mapped_columns, coalesce(compared_columns, 0) AS compared_columns,
         coalesce(n, 0) AS comparable_rows, coalesce(matched, 0) AS matched_rows, coalesce(f, 0) AS expected_fill_cells, coalesce(d, 0) AS diff_cells,
         CASE WHEN ky.cmp IS NOT NULL THEN 'key_based' WHEN compared_columns > 0 THEN 'positional' END AS match_method, mo.sc AS key_column,
         CASE WHEN n > 0 THEN matched * 100.0 / n ELSE 0 END AS match_pct
  FROM p LEFT JOIN sz USING (pid) LEFT JOIN mc USING (pid) LEFT JOIN ct USING (pid) LEFT JOIN ky USING (pid) LEFT JOIN mo ON mo.pid = p.pid AND mo.cmp = ky.cmp)
, cl AS (SELECT p.pid, case_id, source_sheet, generated_sheet, ord, mo.sc AS source_col, gc AS generated_col, match_type, confidence, n AS matching_cells,
                CASE WHEN mo.cmp IS NOT NULL THEN coalesce(n * 100.0 / total, 0) END AS value_match_pct
         FROM mo JOIN p USING (pid) LEFT JOIN (SELECT pid, cmp, count(*) FILTER (ok) AS n, count(*) AS total FROM cm GROUP BY ALL) x ON x.pid = mo.pid AND x.cmp = mo.cmp)
, df AS (SELECT p.pid, case_id, source_sheet, generated_sheet, row_index, cmp AS col_order, sc AS "column", sv AS source_value, gv AS generated_value,
                CASE WHEN fill THEN 'expected_fill' ELSE 'diff' END AS kind, row_number() OVER (PARTITION BY pid, fill ORDER BY row_index, cmp) AS rn
         FROM cm JOIN p USING (pid) WHERE NOT ok)
"""
_PAIRS = _with("f3") + _PAIRS_TAIL
_COLUMNS = _PAIRS + _COLUMNS_TAIL
_ROWS = _with("f3_mixed") + _PAIRS_TAIL + _COLUMNS_TAIL + _ROWS_TAIL + _TOTALS_TAIL


def corpus_cells(spark, sf, name="f3"):
    """Cells (written once, as deriving them costs more than reading them) and visibility of the corpus."""
    return cut_lineage(fixture(spark, sf, name), "cells"), fixture(spark, sf, "f3_visibility")


def _pairs(spark, sf):
    cells, hidden = corpus_cells(spark, sf)
    return cells, mt.match_tables(co.visible_tables(cells, hidden))


def reconciled(spark, sf) -> co.CorpusReconciliation:
    """All pairs of the mixed corpus: half of its cases have a key, the others are compared by position."""
    return co.reconcile_corpus(*corpus_cells(spark, sf, "f3_mixed"))


@query("j_sheet_pairs", _PAIRS + "SELECT case_id, source_sheet, generated_sheet, round(score, 9) AS score, is_first FROM p")
def j_sheet_pairs(spark, sf):
    """Table pairing of every case, hidden sheets left out; all pairs are kept, the first is marked."""
    _, pairs = _pairs(spark, sf)
    return pairs.withColumn("score", F.round("score", 9))


@query("s_best_match", _PAIRS + "SELECT case_id, arg_max(generated_sheet, score) AS best_sheet, round(max(score), 9) AS score FROM p GROUP BY ALL")
def s_best_match(spark, sf):
    """Best-scoring generated sheet of every case."""
    _, pairs = _pairs(spark, sf)
    return pairs.groupBy("case_id").agg(F.max_by("generated_sheet", "score").alias("best_sheet"), F.round(F.max("score"), 9).alias("score"))


@query("agg_value_overlap", _PAIRS + _OVERLAP + """
SELECT case_id, source_sheet, s_idx, generated_sheet, g_idx, shared, source_values, generated_values, round(overlap, 9) AS overlap FROM ov""")
def agg_value_overlap(spark, sf):
    """Overlap of all values of every source and generated column of a case that share any."""
    cells, hidden = corpus_cells(spark, sf)
    seen = cells.join(co.visible_tables(cells, hidden).select("case_id", "side", "sheet"), ["case_id", "side", "sheet"], "left_semi")
    out = mt.value_overlaps(seen, ["case_id"], ["sheet", "col_idx"])
    return out.select("case_id", F.col("s_sheet").alias("source_sheet"), F.col("s_col_idx").alias("s_idx"), F.col("g_sheet").alias("generated_sheet"),
                      F.col("g_col_idx").alias("g_idx"), "shared", "source_values", "generated_values", F.round("overlap", 9).alias("overlap"))


@query("j_column_pairs", _COLUMNS + """
SELECT case_id, source_sheet, generated_sheet, ord, sc AS source_col, gc AS generated_col, match_type, round(confidence, 9) AS confidence FROM mo JOIN p USING (pid)""")
def j_column_pairs(spark, sf):
    """Column mapping of every table pair: equal names, then greedy by name and all values."""
    cells, pairs = _pairs(spark, sf)
    out = co.map_corpus(cells, pairs)
    return out.select(*PAIR, "ord", "source_col", "generated_col", "match_type", F.round("confidence", 9).alias("confidence"))


@query("f_match_columns_exact", _COLUMNS + """
SELECT case_id, source_sheet, generated_sheet, si AS col_order, sc AS source_col, gc AS generated_col, 'exact_name' AS match_type, CAST(1.0 AS DOUBLE) AS confidence
FROM ex JOIN p USING (pid)""")
def f_match_columns_exact(spark, sf):
    """Case-insensitive equal names of every table pair."""
    cells, pairs = _pairs(spark, sf)
    columns = co.column_table(cells, pairs)
    return mt.match_exact(columns.where("side = 'source'"), columns.where("side = 'generated'"), PAIR)


@query("corpus_compare", _ROWS + "SELECT * EXCLUDE (pid) REPLACE (round(match_pct, 6) AS match_pct) FROM tt")
def corpus_compare(spark, sf):
    """Totals of every table pair of the corpus, by key where a column is fit for one, else by position."""
    return reconciled(spark, sf).summary().withColumn("match_pct", F.round("match_pct", 6))


@query("corpus_column_match", _ROWS + "SELECT * EXCLUDE (pid) REPLACE (round(confidence, 9) AS confidence, round(value_match_pct, 6) AS value_match_pct) FROM cl")
def corpus_column_match(spark, sf):
    """Column mappings of the corpus with the share of matching cells of each compared column."""
    out = reconciled(spark, sf).columns()
    return out.withColumn("confidence", F.round("confidence", 9)).withColumn("value_match_pct", F.round("value_match_pct", 6))


@query("corpus_row_diff", _ROWS + "SELECT * EXCLUDE (pid, rn) FROM df")
def corpus_row_diff(spark, sf):
    """Every differing cell of the corpus, uncapped."""
    return reconciled(spark, sf).diffs()


@query("corpus_first_diffs", _ROWS + """
SELECT case_id, source_sheet, generated_sheet, row_index, "column", left(source_value, 100) AS source_value, left(generated_value, 100) AS generated_value, kind
FROM df WHERE rn <= CASE kind WHEN 'diff' THEN 50 ELSE 10 END""")
def corpus_first_diffs(spark, sf):
    """First 50 differences and 10 fills of every pair."""
    return reconciled(spark, sf).first_diffs()


_SHARE = "format('{{:.1f}}%', round({0}, 1))"
_REPORT = _with("f3_mixed", "f6") + _PAIRS_TAIL + _COLUMNS_TAIL + _ROWS_TAIL + _TOTALS_TAIL + LINES_TAIL + f"""
, co AS (
  SELECT pid, 0 AS ord, '- Source rows: ' || source_rows || ', generated rows: ' || generated_rows AS line FROM tt
  UNION ALL SELECT pid, 1, '- Empty rows left out: ' || empty_rows_dropped FROM tt WHERE empty_rows_dropped > 0
  UNION ALL SELECT pid, 2, CASE match_method WHEN 'key_based' THEN '- Rows joined by key `' || key_column || '`; their order does not matter.'
    WHEN 'positional' THEN '- Rows compared by position; another order shows as differences.' ELSE '- No columns could be compared.' END FROM tt
  UNION ALL SELECT pid, 3, '- Note: ' || CASE WHEN generated_rows < 0.3 * source_rows THEN 'filtered subset' ELSE 'expanded' END || ' (' || generated_rows || ' of ' || source_rows || ' rows)'
    FROM tt WHERE source_rows > 0 AND generated_rows > 0 AND (generated_rows < 0.3 * source_rows OR generated_rows > 3 * source_rows)
  UNION ALL SELECT pid, 4, '- Comparable rows: ' || comparable_rows || ', matched: ' || matched_rows || ' (' || {_SHARE.format('match_pct')} || ')' FROM tt
  UNION ALL SELECT pid, 5, '- Expected fills: ' || expected_fill_cells || ' cells' FROM tt WHERE expected_fill_cells > 0
  UNION ALL SELECT pid, 6, '- Warning: low match, ' || CASE match_method WHEN 'positional' THEN 'row order may differ' ELSE 'values differ' END FROM tt WHERE match_pct < 50 AND comparable_rows > 0
  UNION ALL SELECT pid, 100 + ord, '  - `' || source_col || '` → `' || generated_col || '` (' || match_type || ', conf=' || CAST(round(confidence * 100) AS INT) || '%)'
    || coalesce(' value_match=' || {_SHARE.format('value_match_pct')}, '') FROM cl
  UNION ALL SELECT pid, 100000 + rn, '  - Row ' || row_index || ', `' || "column" || '`: source=`' || coalesce(left(source_value, 100), '') || '` vs generated=`' || coalesce(left(generated_value, 100), '') || '`' FROM df WHERE kind = 'diff' AND rn <= 30
  UNION ALL SELECT pid, 200000 + rn, '  - Row ' || row_index || ', `' || "column" || '`: empty → `' || left(generated_value, 100) || '`' FROM df WHERE kind = 'expected_fill' AND rn <= 10
  UNION ALL SELECT pid, 300000, '- Summary: ' || CASE WHEN match_method = 'key_based' THEN 'Key-based matching on `' || key_column || '`: ' ELSE '' END || matched_rows || '/' || comparable_rows || ' rows match (' || {_SHARE.format('match_pct')} || ').'
    || CASE WHEN expected_fill_cells > 0 THEN ' ' || expected_fill_cells || ' cells were empty in source and filled in output.' ELSE '' END
    || CASE WHEN match_method = 'key_based' AND source_rows > comparable_rows THEN ' ' || (source_rows - comparable_rows) || ' source rows had no matching key.' ELSE '' END FROM tt)
"""


@query("rep_scan_text", _REPORT + """
SELECT * FROM sc
UNION ALL SELECT case_id, 3, source_sheet || ' → ' || generated_sheet, ord, line FROM co JOIN p USING (pid)""")
def rep_scan_text(spark, sf):
    """Scan report lines of every case: sheet profiles, formulas with their errors, the comparison of every table pair."""
    recon = reconciled(spark, sf)
    generated = fixture(spark, sf, "f3_mixed").where("side = 'generated'")
    return rpt.scan_lines(generated, wb.formulas(fixture(spark, sf, "f6")), recon)


_NAME_PAIRS = """WITH RECURSIVE np0 AS (SELECT DISTINCT a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON a.p_partkey = b.p_partkey + 1)
, np AS (SELECT DISTINCT lower(x) AS a, lower(y) AS b FROM np0)
, """ + similarity_sql("np")


def _name_pairs(spark, sf):
    """Neighbouring part names, distinct."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("a"))
    b = table(spark, sf, "part").select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("b"))
    return p.join(b, "p_partkey").select("a", "b").distinct()


@query("f_name_similarity", _NAME_PAIRS + " SELECT x AS a, y AS b, round(ratio, 9) AS similarity FROM np0 JOIN sim ON sim.a = lower(x) AND sim.b = lower(y)")
def f_name_similarity(spark, sf):
    """Name similarity of distinct pairs of neighbouring part names."""
    return _name_pairs(spark, sf).withColumn("similarity", F.round(naming.name_similarity("a", "b"), 9))


@query("f_pair_score", _NAME_PAIRS + """
, j AS (SELECT x, y, ratio, len(list_intersect(string_split(x, ' '), string_split(y, ' '))) / len(list_distinct(list_concat(string_split(x, ' '), string_split(y, ' ')))) AS w
        FROM np0 JOIN sim ON sim.a = lower(x) AND sim.b = lower(y))
SELECT x AS a, y AS b, round(ratio * 0.6 + w * 0.4, 9) AS column_score, round(ratio * 0.3 + w * 0.7, 9) AS table_score FROM j""")
def f_pair_score(spark, sf):
    """Column and table pair scores over distinct name pairs."""
    pairs = _name_pairs(spark, sf).withColumn("name", naming.name_similarity("a", "b"))
    words = naming.jaccard(F.split("a", " "), F.split("b", " "))
    return pairs.select("a", "b", F.round(naming.column_pair_score(F.col("name"), words), 9).alias("column_score"),
                        F.round(naming.table_pair_score(F.col("name"), words), 9).alias("table_score"))
