"""Queries that prepare review requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecheck.functions import naming
from tablecheck.operators import context as cx, report as rpt, sheets as sh, workbook as wb
from tablecheck.operators.rownum import capped
from tablecheck.plans.fixtures import fixture, fixture_sql, with_fixtures
from tablecheck.plans.q_profile import SHEETS_SQL, named_cells, sheet_views
from tablecheck.plans.q_workbook import LOOK_SQL, REFS_SQL, SHOWN_SQL
from tablecheck.plans.registry import query, table
from tablecheck.plans.sqltext import empty, number
from tablecheck.session import cut_lineage

_LINES = "string_split({0}, chr(10))"
_TOK = "CAST(floor(length({0}) / 4) AS BIGINT)"


class Facts(dict):
    """Fact tables by name, each written once when first asked for."""

    def __init__(self, makers):
        super().__init__()
        self.makers = makers

    def __missing__(self, name):
        self[name] = cut_lineage(self.makers[name](), name)
        return self[name]


def _sheets(spark, sf):
    return fixture(spark, sf, "f9_sheets")


def _visible(spark, sf):
    return _sheets(spark, sf).where("NOT hidden")


@query("f_estimate_tokens", "SELECT doc_id, " + _TOK.format("text") + " AS tokens FROM documents")
def f_estimate_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", cx.estimate_tokens(F.col("text")).alias("tokens"))


@query("f_sheet_header", with_fixtures("f9_sheets") + """
SELECT case_id, sheet, '### Sheet: ' || sheet || CASE WHEN hidden THEN ' [HIDDEN SHEET]' ELSE '' END || ' (' || row_count || ' rows × ' || col_count || ' cols)' AS header FROM f9_sheets""")
def f_sheet_header(spark, sf):
    h = cx.sheet_header(F.col("sheet"), F.col("hidden"), F.col("row_count"), F.col("col_count"))
    return _sheets(spark, sf).select("case_id", "sheet", h.alias("header"))


def _pre(n):
    return f"array_to_string({_LINES.format('csv_text')}[1:{n}], chr(10))"


@query("w_preview", with_fixtures("f9_sheets") + f"""
SELECT doc_id, {_pre(30)} AS p30, {_pre(20)} AS p20, {_pre(15)} AS p15, {_pre(11)} AS p11,
       CASE WHEN length({_pre(5)}) > 500 THEN left({_pre(5)}, 500) || '…' ELSE {_pre(5)} END AS p5 FROM f9_sheets""")
def w_preview(spark, sf):
    """First lines of every sheet at the sizes the dimensions use."""
    t = F.col("csv_text")
    return _sheets(spark, sf).select("doc_id", *[cx.preview(t, n).alias(f"p{n}") for n in (30, 20, 15, 11)], cx.preview(t, 5, 500).alias("p5"))


def _sample_sql(text, head, tail, unit):
    return f"""(SELECT (CASE WHEN h > 0 THEN array_to_string(l[1:h], chr(10)) || chr(10) ELSE '' END) || '[... ' || (n - h - t) || ' {unit} omitted ...]'
      || (CASE WHEN t > 0 THEN chr(10) || array_to_string(l[n - t + 1:n], chr(10)) ELSE '' END)
      FROM (SELECT l, len(l) AS n, least({head}, len(l) // 3) AS h, least({tail}, len(l) // 4) AS t FROM (SELECT {_LINES.format(text)} AS l) a) b)"""


_TOTALS = with_fixtures("f9_sheets", "f9_cases") + f"""
, vis AS (SELECT *, {_TOK.format('csv_text')} AS tok FROM f9_sheets WHERE NOT hidden)
, tt AS (SELECT c.*, coalesce(g, 0) AS generated_tokens, coalesce(n, 0) AS n_sheets, {_TOK.format('scan_text')} AS scan_tokens, {_TOK.format('grounding')} AS source_tokens
         FROM f9_cases c LEFT JOIN (SELECT case_id, CAST(sum(tok) AS BIGINT) AS g, count(*) AS n FROM vis GROUP BY case_id) v USING (case_id))
, tb AS (SELECT *, CAST(floor((80000 - scan_tokens) / 2) AS BIGINT) AS source_budget FROM tt)
, tg AS (SELECT *, 80000 - scan_tokens - source_budget AS generated_budget FROM tb)
, totals AS (SELECT *, CAST(floor(generated_budget / greatest(n_sheets, 1)) AS BIGINT) AS sheet_budget,
   CASE WHEN grounding = '' THEN 'none' WHEN source_tokens <= source_budget THEN 'full' ELSE 'sampled' END AS source_mode,
   CASE WHEN generated_tokens <= generated_budget THEN 'full' ELSE 'sampled' END AS generated_mode,
   scan_text <> '' AND grounding <> '' AND source_tokens + generated_tokens >= 50000 AND expected_fills <= 100 AND source_tokens > 0 AND generated_tokens > 0
   AND greatest(source_tokens, generated_tokens) * 1.0 / greatest(least(source_tokens, generated_tokens), 1) < 3.0 AS diff_mode FROM tg)
"""


def totals(spark, sf):
    return cx.budget_totals(_visible(spark, sf), fixture(spark, sf, "f9_cases"))


@query("f_budget_split", _TOTALS + "SELECT case_id, scan_tokens, source_tokens, generated_tokens, n_sheets, source_budget, generated_budget, sheet_budget, source_mode, generated_mode FROM totals")
def f_budget_split(spark, sf):
    """Token budget of every case, split over source and sheets."""
    return totals(spark, sf).select("case_id", "scan_tokens", "source_tokens", "generated_tokens", "n_sheets", "source_budget",
                                    "generated_budget", "sheet_budget", "source_mode", "generated_mode")


@query("p_diff_mode", _TOTALS + "SELECT case_id, expected_fills, diff_mode FROM totals")
def p_diff_mode(spark, sf):
    """Cases whose differences alone are enough context."""
    return totals(spark, sf).select("case_id", "expected_fills", "diff_mode")


@query("f_coverage_note", _TOTALS + """
SELECT case_id, 'Coverage: source data = ' || source_mode || ', generated data = ' || generated_mode || '. ' ||
  CASE WHEN scan_text <> '' THEN 'The scan report compares all rows.' ELSE 'There is no scan report; judge the visible data only.' END AS note FROM totals""")
def f_coverage_note(spark, sf):
    return totals(spark, sf).select("case_id", cx.coverage_note().alias("note"))


_DATA_SQL = _TOTALS + f"""
, sb AS (SELECT *, CASE source_mode WHEN 'full' THEN '## Source data (full, ' || source_tokens || ' tokens)' || chr(10) || grounding
         WHEN 'sampled' THEN '## Source data (sampled from ' || source_tokens || ' tokens)' || chr(10) || {_sample_sql('grounding', 60, 30, 'lines')} END AS source_block FROM totals)
, al AS (SELECT case_id, 'accuracy' AS rule, generated_budget AS left_over FROM sb UNION ALL SELECT case_id, 'completeness', 80000 - scan_tokens - coalesce({_TOK.format('source_block')}, 0) FROM sb)
, sv AS (SELECT vis.*, rule, diff_mode, generated_tokens <= left_over AS all_fit, CAST(floor(left_over / greatest(n_sheets, 1)) AS BIGINT) AS per_sheet,
         '### Sheet: ' || sheet || ' (' || row_count || ' rows × ' || col_count || ' cols)' AS header FROM vis JOIN sb USING (case_id) JOIN al USING (case_id))
, tx AS (SELECT rule, case_id, 9 AS part, sheet AS name, CASE WHEN diff_mode THEN header || chr(10) || {_pre(11)} WHEN all_fit THEN header || chr(10) || csv_text
         WHEN tok <= per_sheet THEN header || ' [full]' || chr(10) || csv_text
         ELSE header || ' [sampled]' || chr(10) || CASE rule WHEN 'accuracy' THEN {_sample_sql('csv_text', 30, 15, 'rows')} ELSE {_sample_sql('csv_text', 25, 10, 'rows')} END END AS block FROM sv)
, dt AS (SELECT rule, case_id, 1 AS part, '' AS name, scan_text AS block FROM sb JOIN al USING (case_id) WHERE scan_text <> ''
         UNION ALL SELECT rule, case_id, 2, '', source_block FROM sb JOIN al USING (case_id) WHERE source_mode <> 'none' AND NOT diff_mode
         UNION ALL SELECT rule, case_id, 2, '', '{cx.DIFF_NOTE}' FROM sb JOIN al USING (case_id) WHERE diff_mode UNION ALL SELECT * FROM tx
         UNION ALL SELECT 'whole', case_id, 9, sheet, CASE WHEN diff_mode THEN header || chr(10) || {_pre(11)} ELSE header || chr(10) || csv_text END FROM sv WHERE rule = 'accuracy'
         UNION ALL SELECT 'whole', case_id, 1, '', scan_text FROM sb WHERE diff_mode AND scan_text <> '' UNION ALL SELECT 'whole', case_id, 2, '', '{cx.DIFF_NOTE}' FROM sb WHERE diff_mode)
"""


def document_facts(spark, sf):
    """Documents as the sheets of cases: the facts that the data blocks need."""
    cases = fixture(spark, sf, "f9_cases")
    scan = cases.where("scan_text <> ''").select("case_id", F.lit("").alias("name"), F.lit(0).cast("bigint").alias("ord"), F.col("scan_text").alias("line"))
    return Facts({"cases": lambda: cases, "sheets": lambda: _visible(spark, sf), "totals": lambda: totals(spark, sf), "scan": lambda: scan})


@query("w_sample_budget", _DATA_SQL + "SELECT rule, case_id, part, name, md5(block) AS digest FROM dt")
def w_sample_budget(spark, sf):
    """Scan report, source and sheets of every case under each budget rule, whole, sampled or as differences only."""
    f = document_facts(spark, sf)
    sets = [("accuracy", cx.data_blocks(f, "accuracy")), ("completeness", cx.data_blocks(f, "completeness")), ("whole", cx.whole_blocks(f))]
    return cx.stacked(*[df.select(F.lit(rule).alias("rule"), "case_id", "part", "name", F.md5("block").alias("digest")) for rule, df in sets])


def _verify_sql(text, rule, unit):
    limit, head, tail, less = rule
    ls = _LINES.format(text)
    return f"""CASE WHEN len({ls}) > {limit} THEN array_to_string({ls}[1:{head}], chr(10)) || chr(10) || '[... ' || (len({ls}) - {less}) || ' {unit} omitted ...]' || chr(10)
      || array_to_string({ls}[len({ls}) - {tail} + 1:len({ls})], chr(10)) ELSE {text} END"""


@query("w_verify_sample", with_fixtures("f9_sheets") + f"""
SELECT doc_id, md5({_verify_sql('csv_text', cx.VERIFY_SOURCE, 'lines')}) AS source_digest, md5({_verify_sql('csv_text', cx.VERIFY_SHEET, 'rows')}) AS sheet_digest FROM f9_sheets""")
def w_verify_sample(spark, sf):
    """Shorter samples a verification request carries."""
    t = F.col("csv_text")
    return _sheets(spark, sf).select("doc_id", F.md5(cx.verify_sample(t, cx.VERIFY_SOURCE, "lines")).alias("source_digest"),
                                     F.md5(cx.verify_sample(t, cx.VERIFY_SHEET)).alias("sheet_digest"))


@query("w_sections", with_fixtures("f9") + r"""
, l0 AS (SELECT doc_id, string_split(trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10)) AS l FROM f9)
, l1 AS (SELECT doc_id, len(l) AS n, unnest(l) AS line, unnest(generate_series(1, len(l))) AS i FROM l0 WHERE len(l) >= 3)
, l2 AS (SELECT *, list_transform(string_split(line, ','), lambda c: trim(c, ' ' || chr(9) || chr(13))) AS cells FROM l1)
, l3 AS (SELECT *, i > 1 AND len(list_filter(cells, lambda c: c <> '' AND c <> '""')) = 0 AS blank,
         len(list_filter(cells, lambda c: c <> '' AND NOT regexp_full_match(replace(replace(c, '.', ''), '-', ''), '[0-9]+'))) > len(cells) * 0.6 AS header_like FROM l2)
, l4 AS (SELECT *, blank AND (i - max(CASE WHEN NOT blank THEN i END) OVER (PARTITION BY doc_id ORDER BY i)) % 2 = 1 AS closes FROM l3)
, l5 AS (SELECT *, coalesce(max(CASE WHEN closes THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS s FROM l4)
, e AS (SELECT doc_id, s, CASE WHEN closes THEN i - 1 ELSE n END AS e FROM l5 WHERE closes OR (i = n AND s < n))
SELECT e.doc_id, e.s AS "start", e.e AS "end", CASE WHEN e.s > 1 AND NOT o.blank AND o.header_like AND trim(trim(o.cells[1]), '"') <> ''
       THEN left(trim(trim(o.cells[1]), '"'), 50) ELSE 'Data block' END AS label
FROM e JOIN l4 o ON e.doc_id = o.doc_id AND e.s = o.i""")
def w_sections(spark, sf):
    """Blocks between blank lines of every text."""
    return cx.sections(fixture(spark, sf, "f9"), "doc_id", "text")


_CAPPED = [("formulas", "fo", "sheet || '!' || coord", "sheet_idx, row_idx, col_idx", 200), ("errors", "(SELECT * FROM fo WHERE has_error)", "sheet || '!' || coord", "sheet_idx, row_idx, col_idx", 20),
           ("cross_refs", "hit", "sheet || ' → ' || target", "sheet, target", 50)] + [
    (kind, f"(SELECT * FROM items WHERE kind = '{kind}')", "item", "sheet, ord, item", n) for kind, n in (("font", 20), ("color", 20), ("rule", 20), ("merged", 30), ("freeze", 30))]


@query("s_caps", with_fixtures("f6", "f7", "f7_layout") + f", fo AS (SELECT * FROM (SELECT *, {SHOWN_SQL} AS shown, starts_with(computed_value, '#') AS has_error FROM f6) t WHERE shown IS NOT NULL)"
       + REFS_SQL + ", v AS (SELECT * FROM f7 WHERE NOT hidden)" + LOOK_SQL + "\nUNION ALL\n".join(f"""
SELECT case_id, '{name}' AS list, item, rn, greatest(total - {n}, 0) AS more
FROM (SELECT case_id, {item} AS item, row_number() OVER (PARTITION BY case_id ORDER BY {order}) AS rn, count(*) OVER (PARTITION BY case_id) AS total FROM {found} a) b WHERE rn <= {n}"""
    for name, found, item, order, n in _CAPPED))
def s_caps(spark, sf):
    """The first entries of every list a review shows, and how many more there are."""
    found = wb.formulas(fixture(spark, sf, "f6"))
    refs = wb.cross_sheet_refs(found, fixture(spark, sf, "f6").select("case_id", "sheet"))
    items = cut_lineage(wb.format_items(fixture(spark, sf, "f7"), fixture(spark, sf, "f7_layout")), "items")
    cell, place = F.concat("sheet", F.lit("!"), "coord"), ["sheet_idx", "row_idx", "col_idx"]
    lists = [("formulas", found, cell, place, cx.SHOWN["formulas"]), ("errors", found.where("has_error"), cell, place, rpt.SHOWN_ERRORS),
             ("cross_refs", refs, F.concat("sheet", F.lit(" → "), "target"), ["sheet", "target"], cx.SHOWN["cross_refs"])]
    for kind in ("font", "color", "rule", "merged", "freeze"):
        most = cx.SHOWN["merged"] if kind in ("merged", "freeze") else cx.SHOWN["formatting"]
        lists.append((kind, items.where(F.col("kind") == kind), F.col("item"), ["sheet", "ord", "item"], most))
    return cx.stacked(*[capped(df, ["case_id"], order, n).select("case_id", F.lit(name).alias("list"), item.alias("item"), "rn", "more") for name, df, item, order, n in lists])


@query("f_safe_filename", "SELECT page_id, regexp_replace(url, '[<>:\"/\\\\|?*]', '_', 'g') AS name FROM pages")
def f_safe_filename(spark, sf):
    return table(spark, sf, "pages").select("page_id", naming.safe_filename(F.col("url")).alias("name"))


@query("f_slugify", "SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
def f_slugify(spark, sf):
    return table(spark, sf, "pages").select("page_id", naming.slugify(F.col("url")).alias("slug"))


_NUM = number("value")
LINES_TAIL = f"""
, g AS (SELECT *, {_NUM} AS x FROM f3 WHERE side = 'generated')
, pr AS (SELECT case_id, sheet, col_idx, col_name, count(value) AS nn, count(*) - count(value) AS nl, count(DISTINCT value) AS nu, count(x) AS nx,
         CAST(sum(CAST(x AS DECIMAL(18,2))) AS DOUBLE) AS sm FROM g GROUP BY ALL)
, sa AS (SELECT case_id, sheet, col_idx, string_agg(value, ', ' ORDER BY row_idx) AS samples FROM (
         SELECT * FROM g WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY case_id, sheet, col_idx ORDER BY row_idx) <= 3) t GROUP BY ALL)
, li AS (SELECT pr.case_id, pr.sheet, pr.col_idx, format('  - `{{}}` ({{}}): {{}} non-null, {{}} null, {{}} unique', col_name,
           CASE WHEN nn = 0 THEN 'empty' WHEN nx > nn * 0.8 THEN 'numeric' WHEN nx < nn * 0.2 THEN 'string' ELSE 'mixed' END, nn, nl, nu)
         || CASE WHEN nx > nn * 0.8 THEN format(', mean={{:.2f}}, sum={{:.2f}}', sm / nx, sm) ELSE '' END
         || CASE WHEN coalesce(samples, '') <> '' THEN ', samples=[' || samples || ']' ELSE '' END AS line
         FROM pr LEFT JOIN sa USING (case_id, sheet, col_idx))
, rsig AS (SELECT case_id, sheet, row_idx, string_agg(coalesce('v' || value, 'n'), chr(1) ORDER BY col_idx) AS sig, bool_and({empty("value")}) AS e, max(col_idx) AS nc
         FROM g GROUP BY ALL)
, sl AS (SELECT case_id, sheet, format('**{{}}**: {{}} rows × {{}} cols ({{}} empty rows, {{}} duplicate rows)', sheet, count(*), max(nc),
         count(*) FILTER (WHERE e), count(*) - count(DISTINCT sig)) AS line FROM rsig GROUP BY case_id, sheet)
, fl AS (SELECT case_id, format('- Total formulas: {{}}, formula errors: {{}}', count(*), count(*) FILTER (WHERE starts_with(computed_value, '#'))) AS line
         FROM f6 WHERE formula_kind <> 'plain' OR starts_with(formula, '=') GROUP BY case_id)
, fo AS (SELECT * FROM (SELECT *, {SHOWN_SQL} AS shown, starts_with(computed_value, '#') AS has_error FROM f6) x WHERE shown IS NOT NULL)
, er AS (SELECT case_id, '  - ' || sheet || '!' || coord || ': ' || shown || ' → ' || computed_value AS line, row_number() OVER (PARTITION BY case_id ORDER BY sheet_idx, row_idx, col_idx) AS rn
         FROM fo WHERE has_error)
, sc AS (SELECT case_id, 1 AS part, sheet AS name, CAST(col_idx AS BIGINT) AS ord, line FROM li UNION ALL SELECT case_id, 1, sheet, 0, line FROM sl
         UNION ALL SELECT case_id, 2, '', 0, line FROM fl UNION ALL SELECT case_id, 2, '', rn, line FROM er WHERE rn <= 20)
"""


@query("f_scan_line", with_fixtures("f3", "f6") + LINES_TAIL + "SELECT * FROM li")
def f_scan_line(spark, sf):
    """One profile line per column."""
    return rpt.profile_lines(fixture(spark, sf, "f3").where("side = 'generated'"))


def corpus_facts(spark, sf):
    """Fact tables of the corpus; a dimension causes only its own to be computed."""
    found = lambda: wb.formulas(fixture(spark, sf, "f6"))

    def cases():
        names = out["sheets"].select("case_id").distinct()
        tokens = out["scan"].groupBy("case_id").agg(F.floor(F.sum(F.length("line") + 1) / 4).alias("scan_tokens"))
        lines = F.when(F.right("case_id", F.lit(6)).cast("int") % 2 == 0, 500).otherwise(60000)
        return names.join(tokens, "case_id", "left").select(
            "case_id", F.coalesce("scan_tokens", F.lit(0)).alias("scan_tokens"), F.repeat(F.lit("a,b,c\n"), lines).alias("grounding"),
            F.lit(3).alias("expected_fills"), F.lit("general").alias("scenario"), F.concat(F.lit("Check "), "case_id").alias("prompt"))

    def scan():
        lines = rpt.scan_lines(fixture(spark, sf, "f3").where("side = 'generated'"), found())
        return lines.select("case_id", F.concat(F.col("part").cast("string"), F.lit(" "), "name").alias("name"), "ord", "line")

    def sections():
        texts = out["sheets"].select(F.struct("case_id", "sheet").alias("id"), "csv_text")
        return cx.sections(texts, "id", "csv_text").select("id.case_id", "id.sheet", "start", "end", "label")

    out = Facts({
        "sheets": lambda: sheet_views(spark, sf).where("NOT hidden"),
        "cases": cases,
        "scan": scan,
        "totals": lambda: cx.budget_totals(out["sheets"], out["cases"]),
        "formulas": found,
        "cross_refs": lambda: wb.cross_sheet_refs(found(), fixture(spark, sf, "f6").select("case_id", "sheet")),
        "sections": sections,
        "look": lambda: wb.bold_header(fixture(spark, sf, "f7")).join(wb.border_coverage(fixture(spark, sf, "f7")), "case_id", "full"),
        "items": lambda: wb.format_items(fixture(spark, sf, "f7"), fixture(spark, sf, "f7_layout")),
        "charts": lambda: fixture(spark, sf, "charts"),
    })
    return out


def _listed_sql(dimension, part, found, line, order, most, none):
    return f"""SELECT case_id, '{dimension}' AS dimension, {part} AS part, rn AS ord, '' AS name, {line} AS block FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {order}) AS rn FROM {found}) x WHERE rn <= {most}
UNION ALL SELECT case_id, '{dimension}', {part}, {most + 1}, '', '(and ' || (count(*) - {most}) || ' more)' FROM {found} x GROUP BY case_id HAVING count(*) > {most}
UNION ALL SELECT case_id, '{dimension}', {part}, 0, '', '{none}' FROM ca WHERE case_id NOT IN (SELECT case_id FROM {found} x)"""


def _items_sql(dimension, part, kind, title, most, none="none"):
    line = f"'{title}: ' || CASE WHEN sheet <> '' THEN sheet || '!' ELSE '' END || item"
    return _listed_sql(dimension, part, f"(SELECT * FROM items WHERE kind = '{kind}')", line, "sheet, ord, item", most, f"{title}: {none}")


def _previews_sql(dimension, lines):
    text = "csv_text" if lines is None else _pre(lines)
    return f"SELECT case_id, '{dimension}', 9, 0, sheet, header || chr(10) || {text} FROM sh"


def _data_rows_sql(dimension, rule, sample):
    return f"""SELECT case_id, '{dimension}' AS dimension, 1 AS part, ord, part || ' ' || name AS name, line AS block FROM sc
UNION ALL SELECT case_id, '{dimension}', 2, 0, '', source_block FROM cb WHERE source_mode <> 'none'
UNION ALL SELECT case_id, '{dimension}', 9, 0, sheet, CASE WHEN g <= left_over THEN header || chr(10) || csv_text WHEN tok <= floor(left_over / n) THEN header || ' [full]' || chr(10) || csv_text
  ELSE header || ' [sampled]' || chr(10) || {sample} END
FROM sh JOIN (SELECT case_id, g, n, {rule} AS left_over FROM cb) c USING (case_id)"""


_CONTEXT_SQL = with_fixtures("f3", "f3_visibility", "f6", "f7", "f7_layout", "charts") + SHEETS_SQL + LINES_TAIL + REFS_SQL + ", v AS (SELECT * FROM f7 WHERE NOT hidden)" + LOOK_SQL + f"""
, sh AS (SELECT *, {_TOK.format('csv_text')} AS tok, '### Sheet: ' || sheet || ' (' || row_count || ' rows × ' || col_count || ' cols)' AS header FROM sheets WHERE NOT hidden)
, ca AS (SELECT case_id, CAST(sum(tok) AS BIGINT) AS g, count(*) AS n, repeat('a,b,c' || chr(10), CASE WHEN CAST(right(case_id, 6) AS INT) % 2 = 0 THEN 500 ELSE 60000 END) AS grounding FROM sh GROUP BY case_id)
, cb0 AS (SELECT ca.*, {_TOK.format('grounding')} AS st, coalesce(scan_tokens, 0) AS scan_tokens
          FROM ca LEFT JOIN (SELECT case_id, CAST(floor(sum(length(line) + 1) / 4) AS BIGINT) AS scan_tokens FROM sc GROUP BY case_id) x USING (case_id))
, cb1 AS (SELECT *, CASE WHEN st <= floor((80000 - scan_tokens) / 2) THEN 'full' ELSE 'sampled' END AS source_mode, 80000 - scan_tokens - CAST(floor((80000 - scan_tokens) / 2) AS BIGINT) AS gb FROM cb0)
, cb AS (SELECT *, CASE source_mode WHEN 'full' THEN '## Source data (full, ' || st || ' tokens)' || chr(10) || grounding
         ELSE '## Source data (sampled from ' || st || ' tokens)' || chr(10) || {_sample_sql('grounding', 60, 30, 'lines')} END AS source_block FROM cb1)
"""
_CONTEXTS = {
    "data_accuracy": [
        _data_rows_sql("data_accuracy", "gb", _sample_sql("csv_text", 30, 15, "rows")),
        """SELECT case_id, 'data_accuracy', 10, 0, '', 'Coverage: source data = ' || source_mode || ', generated data = ' || CASE WHEN g <= gb THEN 'full' ELSE 'sampled' END || '. '
           || CASE WHEN scan_tokens > 0 THEN 'The scan report compares all rows.' ELSE 'There is no scan report; judge the visible data only.' END FROM cb""",
    ],
    "completeness": [
        _data_rows_sql("completeness", f"80000 - scan_tokens - {_TOK.format('source_block')}", _sample_sql("csv_text", 25, 10, "rows")),
        "SELECT case_id, 'completeness', 3, 0, sheet, '- ' || sheet FROM sh",
        "SELECT case_id, 'completeness', 10, chart_idx, '', '- ' || chart_type || ' chart on sheet ''' || sheet || ''': ' || coalesce(title, '(untitled)') FROM charts",
    ],
    "formula_logic": [
        "SELECT case_id, 'formula_logic', 1, 0, '', 'Formulas: ' || count(*) || ', with errors: ' || count(*) FILTER (has_error) FROM fo GROUP BY case_id",
        _listed_sql("formula_logic", 2, "fo", "'- `' || sheet || '!' || coord || '`: `' || shown || '` → ' || computed_value || CASE WHEN has_error THEN ' ERROR' ELSE '' END", "sheet_idx, row_idx, col_idx", 200, "No formulas found."),
        "SELECT case_id, 'formula_logic', 3, ord, part || ' ' || name, '! ' || trim(line) FROM sc WHERE contains(line, '#REF!') OR contains(lower(line), 'named range') OR contains(lower(line), 'defined name')",
        _previews_sql("formula_logic", 30),
    ],
    "relevance": [_previews_sql("relevance", None)],
    "sheet_organization": [
        "SELECT case_id, 'sheet_organization', 1, 0, sheet, '**' || sheet || '**: ' || row_count || ' rows × ' || col_count || ' cols' FROM sh",
        _listed_sql("sheet_organization", 3, "hit", "'- ' || sheet || ' → ' || target || ' (e.g. ' || coord || ')'", "sheet, target", 50, "No cross-sheet references found."),
    ],
    "table_structure": [
        _previews_sql("table_structure", None), _items_sql("table_structure", 10, "merged", "Merged", 30), _items_sql("table_structure", 11, "freeze", "Frozen panes", 30),
    ],
    "chart_appropriateness": [
        """SELECT case_id, 'chart_appropriateness', 1, chart_idx, '', 'Chart on ' || sheet || ': type ' || chart_type || ', title ' || coalesce(title, '(none)') || ', legend ' || has_legend
           || ', axis labels ' || (x_title IS NOT NULL OR y_title IS NOT NULL) FROM charts""",
        "SELECT case_id, 'chart_appropriateness', 1, 0, '', 'No charts found.' FROM ca WHERE case_id NOT IN (SELECT case_id FROM charts)",
        _previews_sql("chart_appropriateness", 20),
    ],
    "professional_formatting": [
        _items_sql("professional_formatting", 1, "font", "Font", 20, "default only"),
        "SELECT case_id, 'professional_formatting', 2, 0, '', 'Header bold: ' || CASE WHEN coalesce(bold, false) THEN 'yes' ELSE 'no' END FROM ca LEFT JOIN (SELECT case_id, bool_or(bold AND row_idx <= 3) AS bold FROM v GROUP BY case_id) x USING (case_id)",
        """SELECT case_id, 'professional_formatting', 3, 0, '', CASE WHEN coalesce(b, 0) > 0 THEN 'Borders: ' || CASE WHEN pct > 80 THEN 'all' WHEN pct > 20 THEN 'some' ELSE 'few' END || ' cells bordered (' || CAST(round(pct) AS INT) || '%; ' || styles || ')'
             ELSE 'Borders: none' END FROM ca LEFT JOIN (SELECT case_id, count(border_style) AS b, count(border_style) * 100.0 / count(*) AS pct, string_agg(DISTINCT border_style, ', ' ORDER BY border_style) AS styles FROM v GROUP BY case_id) x USING (case_id)""",
        _items_sql("professional_formatting", 4, "color", "Colour", 20), _items_sql("professional_formatting", 5, "rule", "Conditional rule", 20),
        _items_sql("professional_formatting", 6, "merged", "Merged", 20), _items_sql("professional_formatting", 7, "freeze", "Frozen panes", 20),
        _previews_sql("professional_formatting", 15),
    ],
}
_ALL_BLOCKS = "\nUNION ALL ".join(x for parts in _CONTEXTS.values() for x in parts)
BLOCKS_SQL = _CONTEXT_SQL + f", bl(case_id, dimension, part, ord, name, block) AS (SELECT * FROM ({_ALL_BLOCKS}) z WHERE case_id IN (SELECT case_id FROM ca))\n"


@query("p_context_columns", BLOCKS_SQL + "SELECT case_id, dimension, part, ord, name, md5(block) AS digest FROM bl")
def p_context_columns(spark, sf):
    """Blocks that every dimension sees of every case, by digest."""
    return cx.build_contexts(corpus_facts(spark, sf)).withColumn("digest", F.md5("block")).drop("block")


_TEMPLATE = "Score {} from 0 to 4 and give evidence."


@query("f_build_prompt", BLOCKS_SQL + """
SELECT case_id, dimension, part, ord, name, md5(block) AS digest FROM bl
UNION ALL SELECT case_id, dimension, -2, 0, '', md5('Score ' || dimension || ' from 0 to 4 and give evidence.') FROM (SELECT DISTINCT case_id, dimension FROM bl) x
UNION ALL SELECT case_id, dimension, -1, 0, '', md5('## Scenario' || chr(10) || '- **Type**: general' || chr(10) || '- **User prompt**: Check ' || case_id || chr(10)) FROM (SELECT DISTINCT case_id, dimension FROM bl) x""")
def f_build_prompt(spark, sf):
    """Review requests of all dimensions: template, scenario and context as ordered blocks."""
    f = corpus_facts(spark, sf)
    templates = spark.createDataFrame([(d, _TEMPLATE.format(d)) for d in cx.CONTEXTS], "dimension string, template string")
    out = cx.build_requests(cut_lineage(cx.build_contexts(f), "contexts"), f["cases"], templates)
    return out.withColumn("digest", F.md5("block")).drop("block")


@query("f_scenario_prompt", _CONTEXT_SQL + f"""
SELECT case_id, 1 AS part, 0 AS ord, '' AS name, '## User prompt' || chr(10) || 'Check ' || case_id AS block FROM ca
UNION ALL SELECT case_id, 2, 0, sheet, '- ' || sheet FROM sh
UNION ALL SELECT case_id, 3, 0, sheet, header || chr(10) || CASE WHEN length({_pre(5)}) > 500 THEN left({_pre(5)}, 500) || '…' ELSE {_pre(5)} END FROM sh
UNION ALL SELECT case_id, 4, 0, '', 'Formulas: ' || count(*) FROM fo WHERE case_id IN (SELECT case_id FROM ca) GROUP BY case_id
UNION ALL SELECT case_id, 5, 0, chart_type, 'Charts: ' || count(*) || ' of type ' || chart_type FROM charts WHERE case_id IN (SELECT case_id FROM ca) GROUP BY case_id, chart_type""")
def f_scenario_prompt(spark, sf):
    """Request that asks for the scenario of every case."""
    return cx.scenario_requests(corpus_facts(spark, sf))


# Reviews of every source: claims to check beside items that are none.
_REVIEWS = """
SELECT f.case_id, d.dimension, {0}'+VERIFIED: total ' || d.k, '-INFERRED: trend', CASE WHEN d.dim_idx % 2 = 0 THEN '-Verified: gap' ELSE 'plain note' END, '+VERIFIED: last', 'INFERRED, then verified'{1} AS evidence
FROM (SELECT DISTINCT source AS case_id, CAST(SUBSTR(source, 4) AS INT) AS no FROM documents) f JOIN (SELECT DISTINCT k, dimension, dim_idx FROM f8) d ON d.k = f.no"""


@query("f_verify_prompt", _DATA_SQL.replace("WITH ", f"WITH f8 AS ({fixture_sql('f8')}), ", 1) + f"""
, rv AS ({_REVIEWS.format('[', ']')})
, cl AS (SELECT case_id, dimension, list_filter(evidence, lambda x: contains(upper(x), 'VERIFIED') AND NOT contains(upper(x), 'INFERRED')) AS c FROM rv)
, qs AS (SELECT case_id, dimension FROM cl WHERE len(c) > 0)
, db AS (SELECT case_id, 1 AS part, 0 AS ord, '' AS name, scan_text AS block FROM totals WHERE scan_text <> ''
         UNION ALL SELECT case_id, 2, 0, '', '## Source data' || chr(10) || {_verify_sql('grounding', cx.VERIFY_SOURCE, 'lines')} FROM totals WHERE source_mode <> 'none'
         UNION ALL SELECT case_id, 9, 0, sheet, '### Sheet: ' || sheet || ' (' || row_count || ' rows × ' || col_count || ' cols)' || chr(10) || {_verify_sql('csv_text', cx.VERIFY_SHEET, 'rows')} FROM vis)
SELECT case_id, dimension, part, ord, name, md5(block) AS digest FROM db JOIN qs USING (case_id)
UNION ALL SELECT case_id, dimension, 20, i, '', md5(i || '. ' || c[i]) FROM (SELECT case_id, dimension, c, unnest(generate_series(1, len(c))) AS i FROM cl) x""")
def f_verify_prompt(spark, sf):
    """Requests that check the claims of every review against the sampled data of its case."""
    text = _REVIEWS.format("ARRAY(", ")").replace("FROM documents", "FROM {docs}").replace("FROM f8", "FROM {f8}")
    reviews = spark.sql(text, docs=table(spark, sf, "documents"), f8=fixture(spark, sf, "f8"))
    out = cx.verification_requests(reviews, document_facts(spark, sf))
    return out.withColumn("digest", F.md5("block")).drop("block")


@query("rep_debug_meta", with_fixtures("f3", "f3_visibility", "f6", "f7", "f7_layout", "charts") + SHEETS_SQL + ", fo AS (SELECT *, starts_with(computed_value, '#') AS has_error FROM f6 WHERE formula_kind <> 'plain' OR starts_with(formula, '='))" + REFS_SQL + ", v AS (SELECT * FROM f7 WHERE NOT hidden)" + LOOK_SQL + """
SELECT case_id, 'sheet ' || sheet AS item, row_count || 'x' || col_count || CASE WHEN truncated THEN ' truncated' ELSE '' END AS value FROM sheets
UNION ALL SELECT case_id, 'formulas', CAST(count(*) AS VARCHAR) FROM fo GROUP BY case_id UNION ALL SELECT case_id, 'formula errors', CAST(count(*) FILTER (has_error) AS VARCHAR) FROM fo GROUP BY case_id
UNION ALL SELECT case_id, 'chart ' || chart_idx, sheet || ': ' || chart_type || coalesce(' ' || title, '') FROM charts
UNION ALL SELECT case_id, 'reference ' || sheet || ' → ' || target, coord FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY sheet, target) AS rn FROM hit) x WHERE rn <= 20
UNION ALL SELECT case_id, kind || ' ' || rn, item FROM (SELECT *, row_number() OVER (PARTITION BY case_id, kind ORDER BY sheet, ord, item) AS rn FROM items WHERE kind IN ('font', 'color', 'freeze')) y WHERE rn <= 10
UNION ALL SELECT case_id, 'conditional rules', CAST(count(*) AS VARCHAR) FROM items WHERE kind = 'rule' GROUP BY case_id
UNION ALL SELECT case_id, 'merged ranges', CAST(count(*) AS VARCHAR) FROM items WHERE kind = 'merged' GROUP BY case_id""")
def rep_debug_meta(spark, sf):
    """Metadata of every case as rows: sheet sizes, formulas, charts, references and look."""
    cells = named_cells(spark, sf)
    sizes = sh.sheet_sizes(sh.sheet_lines(cells, ["case_id", "sheet"]), ["case_id", "sheet"])
    found = wb.formulas(fixture(spark, sf, "f6"))
    refs = wb.cross_sheet_refs(found, fixture(spark, sf, "f6").select("case_id", "sheet"))
    items = wb.format_items(fixture(spark, sf, "f7"), fixture(spark, sf, "f7_layout"))
    return rpt.debug_meta(sizes.withColumn("truncated", F.col("row_count") > sh.MAX_ROWS_FULL), found, fixture(spark, sf, "charts"), refs, items)
