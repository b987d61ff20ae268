"""Review requests: previews, token budgets, samples and prompt texts.

Sheet texts come from :mod:`tablecheck.operators.sheets` and are bounded, so a
sheet is one value.  A case may hold any number of sheets: totals are
aggregated and joined back, and requests stay in blocks ordered inside a case
instead of one text per case.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablecheck.operators.evidence import claim_numbers
from tablecheck.operators.rownum import first_n, running_max
from tablecheck.session import cut_lineage

CHARS_PER_TOKEN = 4
DATA_TOKENS = 80_000
DIFF_MIN_TOKENS = 50_000
DIFF_MAX_RATIO = 3.0
DIFF_MAX_FILLS = 100
LABEL_CHARS = 50
# Lines of a sheet shown in diff mode, and lines and characters shown to find the scenario.
DIFF_LINES, SCENARIO_LINES, SCENARIO_CHARS = 11, 5, 500
# Fixed values: (head, tail) lines kept when a text exceeds its budget.
SAMPLE_LINES = {"accuracy": (30, 15), "completeness": (25, 10), "source": (60, 30)}
# Fixed values: (limit, head, tail, number subtracted in the marker) of verification samples.
VERIFY_SOURCE = (100, 50, 30, 80)
VERIFY_SHEET = (60, 30, 15, 45)


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / CHARS_PER_TOKEN)


def sheet_header(name: Column, hidden: Column, rows: Column, cols: Column) -> Column:
    mark = F.when(hidden, " [HIDDEN SHEET]").otherwise("")
    return F.format_string("### Sheet: %s%s (%d rows × %d cols)", name, mark, rows, cols)


def preview(text: Column, lines: int, max_chars: int | None = None) -> Column:
    """First lines of a text, cut to ``max_chars`` with an ellipsis."""
    head = F.substring_index(text, "\n", lines)
    if max_chars is None:
        return head
    return F.when(F.length(head) > max_chars, F.concat(F.left(head, F.lit(max_chars)), F.lit("…"))).otherwise(head)


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def sample_lines(text: Column, head: int, tail: int, unit: str = "rows") -> Column:
    """First third and last quarter of the lines, at most ``head`` and ``tail``, around a marker."""
    n = line_count(text)
    h = F.least(F.lit(head), F.floor(n / 3)).cast("int")
    t = F.least(F.lit(tail), F.floor(n / 4)).cast("int")
    marker = F.format_string(f"[... %d {unit} omitted ...]", n - h - t)
    first = F.when(h > 0, F.concat(F.call_function("substring_index", text, F.lit("\n"), h), F.lit("\n"))).otherwise("")
    last = F.when(t > 0, F.concat(F.lit("\n"), F.call_function("substring_index", text, F.lit("\n"), -t))).otherwise("")
    return F.concat(first, marker, last)


def verify_sample(text: Column, rule: tuple[int, int, int, int], unit: str = "rows") -> Column:
    limit, head, tail, less = rule
    n = line_count(text)
    marker = F.format_string(f"\n[... %d {unit} omitted ...]\n", n - less)
    short = F.concat(F.substring_index(text, "\n", head), marker, F.substring_index(text, "\n", -tail))
    return F.when(n > limit, short).otherwise(text)


def budget_totals(sheets: DataFrame, cases: DataFrame) -> DataFrame:
    """Token budgets of every case.

    ``sheets``: visible sheets (case_id, csv_text).  ``cases``: case_id, scan_text (or scan_tokens, where the report is kept as
    lines), grounding, expected_fills.
    """
    sums = sheets.groupBy("case_id").agg(
        F.sum(estimate_tokens(F.col("csv_text"))).alias("generated_tokens"), F.count(F.lit(1)).alias("n_sheets")
    )
    out = cases.join(sums, "case_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    out = out.withColumn("generated_tokens", zero("generated_tokens")).withColumn("n_sheets", zero("n_sheets"))
    if "scan_tokens" not in cases.columns:
        out = out.withColumn("scan_tokens", F.coalesce(estimate_tokens(F.col("scan_text")), F.lit(0)))
    elif "scan_text" not in cases.columns:
        out = out.withColumn("scan_text", F.when(F.col("scan_tokens") > 0, "lines"))
    out = out.withColumn("source_tokens", F.coalesce(estimate_tokens(F.col("grounding")), F.lit(0)))
    remaining = F.lit(DATA_TOKENS) - F.col("scan_tokens")
    out = out.withColumn("source_budget", F.floor(remaining / 2))
    out = out.withColumn("generated_budget", remaining - F.col("source_budget"))
    out = out.withColumn("sheet_budget", F.floor(F.col("generated_budget") / F.greatest("n_sheets", F.lit(1))))
    missing = F.coalesce(F.col("grounding"), F.lit("")) == ""
    out = out.withColumn(
        "source_mode",
        F.when(missing, "none").when(F.col("source_tokens") <= F.col("source_budget"), "full").otherwise("sampled"),
    )
    full = F.col("generated_tokens") <= F.col("generated_budget")
    return out.withColumn("generated_mode", F.when(full, "full").otherwise("sampled")).withColumn("diff_mode", diff_mode())


def diff_mode() -> Column:
    """Large, alike in size, and few fills: differences alone are enough context."""
    s, g = F.col("source_tokens"), F.col("generated_tokens")
    has = (F.coalesce("scan_text", F.lit("")) != "") & (F.coalesce("grounding", F.lit("")) != "")
    alike = F.when((s > 0) & (g > 0), F.greatest(s, g) / F.least(s, g) < DIFF_MAX_RATIO).otherwise(F.lit(False))
    few = F.coalesce("expected_fills", F.lit(0)) <= DIFF_MAX_FILLS
    return has & (s + g >= DIFF_MIN_TOKENS) & alike & few


def coverage_note() -> Column:
    rely = F.when(
        F.coalesce("scan_text", F.lit("")) != "", "The scan report compares all rows."
    ).otherwise("There is no scan report; judge the visible data only.")
    return F.format_string("Coverage: source data = %s, generated data = %s. %s", "source_mode", "generated_mode", rely)


def source_block() -> Column:
    """Source text of a case within its budget; null where there is none."""
    head, tail = SAMPLE_LINES["source"]
    full = F.format_string("## Source data (full, %d tokens)\n%s", "source_tokens", "grounding")
    part = F.format_string("## Source data (sampled from %d tokens)\n%s", "source_tokens", sample_lines(F.col("grounding"), head, tail, "lines"))
    return F.when(F.col("source_mode") == "full", full).when(F.col("source_mode") == "sampled", part)


def sheet_allowance(totals: DataFrame, rule: str) -> DataFrame:
    """case_id, diff_mode, all_fit and per_sheet (tokens) under a rule.

    ``accuracy`` shares half of what the scan report leaves; ``completeness`` shares what the source block, as shown, leaves of it.
    """
    left = F.col("generated_budget")
    if rule == "completeness":
        left = F.lit(DATA_TOKENS) - F.col("scan_tokens") - F.coalesce(estimate_tokens(source_block()), F.lit(0))
    share = F.floor(left / F.greatest("n_sheets", F.lit(1)))
    return totals.select("case_id", "diff_mode", (F.col("generated_tokens") <= left).alias("all_fit"), share.alias("per_sheet"))


def plain_header() -> Column:
    return sheet_header(F.col("sheet"), F.lit(False), F.col("row_count"), F.col("col_count"))


def sheet_blocks(sheets: DataFrame, totals: DataFrame, rule: str = "accuracy") -> DataFrame:
    """Text block of every visible sheet: whole, or sampled to fit the allowance of its case; the first lines only in diff mode.

    ``totals`` has one row per case; pass a written table, so that a case with very many sheets can be split.
    """
    head, tail = SAMPLE_LINES[rule]
    both = sheets.join(sheet_allowance(totals, rule), "case_id")
    text = F.col("csv_text")
    whole = F.col("all_fit") | (estimate_tokens(text) <= F.col("per_sheet"))
    mark = F.when(F.col("all_fit"), "").when(whole, " [full]").otherwise(" [sampled]")
    body = F.when(whole, text).otherwise(sample_lines(text, head, tail))
    block = F.when(F.col("diff_mode"), diff_sample()).otherwise(F.concat(plain_header(), mark, F.lit("\n"), body))
    return both.withColumn("block", block).drop("all_fit", "per_sheet", "diff_mode")


def diff_sample() -> Column:
    """Header and first lines of a sheet, all that diff mode shows of it."""
    return F.concat(plain_header(), F.lit("\n"), preview(F.col("csv_text"), DIFF_LINES))


def scenario_header(scenario: Column, prompt: Column) -> Column:
    return F.format_string("## Scenario\n- **Type**: %s\n- **User prompt**: %s\n", scenario, F.coalesce(prompt, F.lit("")))


BLOCK = ["case_id", "part", "ord", "name", "block"]


def rows(df: DataFrame, part: int, block: Column, name: Column | None = None, ord_: Column | None = None) -> DataFrame:
    """Blocks of one part of a context; inside a part they follow ``name``, then ``ord``."""
    name, ord_ = F.lit("") if name is None else name, F.lit(0) if ord_ is None else ord_
    return df.select("case_id", F.lit(part).alias("part"), ord_.cast("bigint").alias("ord"), name.alias("name"), block.alias("block"))


def stacked(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# Lines of every sheet a dimension sees next to its own facts; None is the whole text.
PREVIEW_LINES = {
    "relevance": None,
    "table_structure": None,
    "formula_logic": 30,
    "chart_appropriateness": 20,
    "professional_formatting": 15,
}
# How much of each list a dimension sees.
SHOWN = {"formulas": 200, "cross_refs": 50, "merged": 30, "formatting": 20, "sections": 1}
DIFF_NOTE = "Context mode: differences only. Source and generated data are large and alike; rely on the scan report."

ContextFn = Callable[[dict[str, DataFrame]], DataFrame]
CONTEXTS: dict[str, ContextFn] = {}


def context(dimension: str) -> Callable[[ContextFn], ContextFn]:
    """Register the function that builds the blocks of one dimension.

    It receives the fact tables by name and returns the columns ``BLOCK``; adding a dimension means registering one more function.
    """

    def add(fn: ContextFn) -> ContextFn:
        CONTEXTS[dimension] = fn
        return fn

    return add


def build_contexts(facts: dict[str, DataFrame], dimensions: list[str] | None = None) -> DataFrame:
    """Context blocks of the chosen dimensions for the cases of ``facts["cases"]``; unused facts are never read.

    Facts (all but ``cases`` about any cases): ``cases`` (case_id, scenario, prompt), ``sheets`` (visible: case_id, sheet, csv_text, row_count,
    col_count), ``totals`` (see :func:`budget_totals`), ``scan`` (case_id, name, ord, line), ``formulas``, ``cross_refs``, ``sections`` (case_id, sheet, start, end,
    label), ``look`` (has_bold_headers, border_pct, coverage, border_styles), ``items`` (case_id, kind, sheet, ord, item), ``charts``.
    """
    parts = [
        fn(facts).select("case_id", F.lit(name).alias("dimension"), *BLOCK[1:])
        for name, fn in CONTEXTS.items()
        if dimensions is None or name in dimensions
    ]
    return stacked(*parts).join(facts["cases"].select("case_id"), "case_id", "left_semi")


def build_requests(contexts: DataFrame, cases: DataFrame, templates: DataFrame) -> DataFrame:
    """Review requests as ordered blocks: the dimension's template, the scenario, then the context.

    ``templates``: dimension, template.
    """
    every = contexts.select("case_id", "dimension").distinct()
    asked = every.join(templates, "dimension").join(cases, "case_id")
    first = asked.select("case_id", "dimension", F.lit(-2).alias("part"), F.lit(0).cast("bigint").alias("ord"), F.lit("").alias("name"), F.col("template").alias("block"))
    header = scenario_header(F.col("scenario"), F.col("prompt"))
    second = asked.select("case_id", "dimension", F.lit(-1).alias("part"), F.lit(0).cast("bigint").alias("ord"), F.lit("").alias("name"), header.alias("block"))
    return stacked(first, second, contexts.join(templates.select("dimension"), "dimension", "left_semi").select(*first.columns))


def scenario_requests(facts: dict[str, DataFrame]) -> DataFrame:
    """Blocks of the request that asks for the scenario of every case: prompt, sheet names, short previews, counts of formulas and charts."""
    s = facts["sheets"]
    prompt = rows(facts["cases"].where(F.coalesce("prompt", F.lit("")) != ""), 1, F.concat(F.lit("## User prompt\n"), "prompt"))
    names = rows(s, 2, F.concat(F.lit("- "), "sheet"), F.col("sheet"))
    short = F.concat(plain_header(), F.lit("\n"), preview(F.col("csv_text"), SCENARIO_LINES, SCENARIO_CHARS))
    formulas = facts["formulas"].groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    types = facts["charts"].groupBy("case_id", "chart_type").agg(F.count(F.lit(1)).alias("n"))
    out = stacked(
        prompt, names, rows(s, 3, short, F.col("sheet")), rows(formulas, 4, F.format_string("Formulas: %d", "n")),
        rows(types, 5, F.format_string("Charts: %d of type %s", "n", "chart_type"), F.col("chart_type")),
    )
    return out.join(facts["cases"].select("case_id"), "case_id", "left_semi")


def verification_requests(reviews: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """Blocks of the request that checks the claims of every review: case_id, dimension and ``BLOCK`` columns.

    ``reviews``: case_id, dimension, evidence.  The data of a case is sampled by fixed rules and repeated for each of its reviews
    that has a claim to check; claims follow it, numbered as verdicts refer to them.
    """
    claims = reviews.select("case_id", "dimension", F.explode(claim_numbers(F.col("evidence"))).alias("c")).where("c.claim_no IS NOT NULL")
    text = F.concat(F.col("c.claim_no").cast("string"), F.lit(". "), "c.text")
    claims = claims.select("case_id", "dimension", F.lit(20).alias("part"), F.col("c.claim_no").cast("bigint").alias("ord"), F.lit("").alias("name"), text.alias("block"))
    told = facts["totals"].where("source_mode <> 'none'")
    source = rows(told, 2, F.concat(F.lit("## Source data\n"), verify_sample(F.col("grounding"), VERIFY_SOURCE, "lines")))
    sheet = F.concat(plain_header(), F.lit("\n"), verify_sample(F.col("csv_text"), VERIFY_SHEET))
    data = stacked(_scan(facts), source, rows(facts["sheets"], 9, sheet, F.col("sheet")))
    asked = claims.select("case_id", "dimension").distinct()
    return data.join(asked, "case_id").select(*claims.columns).unionByName(claims)


def _scan(facts: dict[str, DataFrame]) -> DataFrame:
    return rows(facts["scan"], 1, F.col("line"), F.col("name"), F.col("ord"))


def _sheet_parts(facts: dict[str, DataFrame], lines: int | None) -> DataFrame:
    text = F.col("csv_text") if lines is None else preview(F.col("csv_text"), lines)
    return rows(facts["sheets"], 9, F.concat(plain_header(), F.lit("\n"), text), F.col("sheet"))


def whole_blocks(facts: dict[str, DataFrame]) -> DataFrame:
    """Whole sheets, or in diff mode the scan report, a note and the first lines."""
    t = facts["totals"]
    marked = facts["sheets"].join(t.select("case_id", "diff_mode"), "case_id")
    block = F.when(F.col("diff_mode"), diff_sample()).otherwise(F.concat(plain_header(), F.lit("\n"), "csv_text"))
    in_diff = t.where("diff_mode").select("case_id")
    return stacked(rows(marked, 9, block, F.col("sheet")), _scan(facts).join(in_diff, "case_id", "left_semi"), rows(in_diff, 2, F.lit(DIFF_NOTE)))


def data_blocks(facts: dict[str, DataFrame], rule: str) -> DataFrame:
    """Scan report, source and sheets under a budget rule."""
    t = facts["totals"]
    source = rows(t.where("source_mode <> 'none' AND NOT diff_mode"), 2, source_block())
    blocks = sheet_blocks(facts["sheets"], t, rule)
    return stacked(_scan(facts), source, rows(t.where("diff_mode"), 2, F.lit(DIFF_NOTE)), rows(blocks, 9, F.col("block"), F.col("sheet")))


def _listed(facts: dict[str, DataFrame], found: DataFrame, part: int, line: Column, order: list, most: int, none: str) -> DataFrame:
    """The first ``most`` lines of a list of every case, how many more there are, or that there are none."""
    top = first_n(found, ["case_id"], order, most)
    total = found.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    more = rows(total.where(F.col("n") > most), part, F.format_string("(and %d more)", F.col("n") - most), ord_=F.lit(most + 1))
    without = facts["cases"].select("case_id").join(total, "case_id", "left_anti")
    return stacked(rows(top, part, line, ord_=F.col("rn")), more, rows(without, part, F.lit(none)))


@context("data_accuracy")
def _accuracy(facts):
    note = rows(facts["totals"].where("NOT diff_mode"), 10, coverage_note())
    return stacked(data_blocks(facts, "accuracy"), note)


@context("completeness")
def _completeness(facts):
    names = rows(facts["sheets"].join(facts["totals"].where("NOT diff_mode").select("case_id"), "case_id", "left_semi"), 3, F.concat(F.lit("- "), "sheet"), F.col("sheet"))
    line = F.format_string("- %s chart on sheet '%s': %s", "chart_type", "sheet", F.coalesce("title", F.lit("(untitled)")))
    return stacked(data_blocks(facts, "completeness"), names, rows(facts["charts"], 10, line, ord_=F.col("chart_idx")))


@context("formula_logic")
def _formula_logic(facts):
    found = facts["formulas"]
    counts = found.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("has_error").alias("bad"))
    line = F.concat(F.format_string("- `%s!%s`: `%s` → %s", "sheet", "coord", "shown", "computed_value"), F.when(F.col("has_error"), " ERROR").otherwise(""))
    listed = _listed(facts, found, 2, line, ["sheet_idx", "row_idx", "col_idx"], SHOWN["formulas"], "No formulas found.")
    low = F.lower("line")
    named = facts["scan"].where(F.contains("line", F.lit("#REF!")) | F.contains(low, F.lit("named range")) | F.contains(low, F.lit("defined name")))
    return stacked(
        rows(counts, 1, F.format_string("Formulas: %d, with errors: %d", "n", "bad")), listed,
        rows(named, 3, F.concat(F.lit("! "), F.trim("line")), F.col("name"), F.col("ord")), _sheet_parts(facts, PREVIEW_LINES["formula_logic"]),
    )


@context("relevance")
def _relevance(facts):
    return whole_blocks(facts)


@context("sheet_organization")
def _organization(facts):
    line = F.format_string("**%s**: %d rows × %d cols", "sheet", "row_count", "col_count")
    found = facts["sections"]
    several = found.groupBy("case_id", "sheet").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHOWN["sections"]).select("case_id", "sheet")
    found = found.join(several, ["case_id", "sheet"], "left_semi")
    refs = F.format_string("- %s → %s (e.g. %s)", "sheet", "target", "coord")
    return stacked(
        rows(facts["sheets"], 1, line, F.col("sheet")),
        rows(found, 2, F.format_string("Rows %d-%d: %s", "start", "end", "label"), F.col("sheet"), F.col("start")),
        _listed(facts, facts["cross_refs"], 3, refs, ["sheet", "target"], SHOWN["cross_refs"], "No cross-sheet references found."),
    )


def _items(facts: dict[str, DataFrame], part: int, kind: str, title: str, most: int, none: str = "none") -> DataFrame:
    found = facts["items"].where(F.col("kind") == kind)
    place = F.when(F.col("sheet") != "", F.concat("sheet", F.lit("!"))).otherwise("")
    return _listed(facts, found, part, F.concat(F.lit(f"{title}: "), place, "item"), ["sheet", "ord", "item"], most, f"{title}: {none}")


@context("table_structure")
def _table_structure(facts):
    most = SHOWN["merged"]
    return stacked(whole_blocks(facts), _items(facts, 10, "merged", "Merged", most), _items(facts, 11, "freeze", "Frozen panes", most))


@context("chart_appropriateness")
def _charts(facts):
    line = F.format_string(
        "Chart on %s: type %s, title %s, legend %s, axis labels %s", "sheet", "chart_type", F.coalesce("title", F.lit("(none)")),
        F.col("has_legend").cast("string"), (F.col("x_title").isNotNull() | F.col("y_title").isNotNull()).cast("string"),
    )
    without = facts["cases"].select("case_id").join(facts["charts"].select("case_id"), "case_id", "left_anti")
    return stacked(
        rows(facts["charts"], 1, line, ord_=F.col("chart_idx")), rows(without, 1, F.lit("No charts found.")),
        _sheet_parts(facts, PREVIEW_LINES["chart_appropriateness"]),
    )


@context("professional_formatting")
def _formatting(facts):
    look = facts["cases"].select("case_id").join(facts["look"], "case_id", "left")
    most = SHOWN["formatting"]
    borders = F.when(
        F.coalesce("border_pct", F.lit(0.0)) > 0, F.format_string("Borders: %s cells bordered (%.0f%%; %s)", "coverage", F.round("border_pct"), "border_styles")
    ).otherwise("Borders: none")
    return stacked(
        _items(facts, 1, "font", "Font", most, "default only"),
        rows(look, 2, F.when(F.coalesce("has_bold_headers", F.lit(False)), "Header bold: yes").otherwise("Header bold: no")),
        rows(look, 3, borders),
        _items(facts, 4, "color", "Colour", most),
        _items(facts, 5, "rule", "Conditional rule", most),
        _items(facts, 6, "merged", "Merged", most),
        _items(facts, 7, "freeze", "Frozen panes", most),
        _sheet_parts(facts, PREVIEW_LINES["professional_formatting"]),
    )


def judge(requests: DataFrame, reply_fn: Callable, schema: str) -> DataFrame:
    """Replies from a user function over batches of requests (pandas frames in, pandas frames out)."""
    return requests.mapInPandas(reply_fn, schema)


def sections(texts: DataFrame, id_col: str, text_col: str, label_chars: int = LABEL_CHARS) -> DataFrame:
    """Blocks of a sheet text separated by blank lines, with a header-like label of at most ``label_chars`` characters.

    In a run of blank lines the first, third, ... close a block, which is what
    a reader walking the lines and restarting after each closing line sees.  What a line must know of the lines before it (the last
    line with text, the last closing line) is a running maximum over slices, so a long document is not one task.
    """
    lines = F.split(F.btrim(F.col(text_col), F.lit(" \t\n\r")), "\n")
    df = texts.select(id_col, lines.alias("l")).where(F.size("l") >= 3)
    df = df.select(id_col, F.size("l").alias("n"), F.posexplode("l").alias("p", "line")).withColumn("i", F.col("p") + 1)
    cells = F.transform(F.split("line", ","), lambda c: F.btrim(c, F.lit(" \t\r")))
    df = df.withColumn("cells", cells)
    blank = F.forall("cells", lambda c: (c == "") | (c == '""')) & (F.col("i") > 1)
    digits = lambda c: F.translate(c, ".-", "").rlike("^[0-9]+$")
    wordy = F.size(F.filter("cells", lambda c: (c != "") & ~digits(c)))
    df = df.withColumn("blank", blank).withColumn("header_like", wordy > F.size("cells") * 0.6)
    label = F.when(
        ~F.col("blank") & F.col("header_like"),
        F.left(F.btrim(F.btrim(F.element_at("cells", 1)), F.lit('"')), F.lit(label_chars)),
    )
    df = df.select(id_col, "n", "i", "blank", label.alias("label"), F.when(~F.col("blank"), F.col("i")).alias("text_at"))
    df = running_max(cut_lineage(df, "lines"), [id_col], "i", "text_at", "last_text")
    df = df.withColumn("closes", F.col("blank") & ((F.col("i") - F.col("last_text")) % 2 == 1))
    df = df.withColumn("close_at", F.when(F.col("closes"), F.col("i"))).drop("text_at", "last_text", "blank")
    df = cut_lineage(running_max(cut_lineage(df, "closing"), [id_col], "i", "close_at", "prev", last=-1), "sections")
    ends = df.where(F.col("closes") | (F.col("i") == F.col("n"))).withColumn("start", F.coalesce("prev", F.lit(0)) + 1)
    end = F.when(F.col("closes"), F.col("i") - 1).otherwise(F.col("n"))
    ends = ends.select(id_col, "start", end.alias("end"), "closes", "n").where(F.col("closes") | (F.col("start") < F.col("n")))
    # the line that opens a block names it; the first block has no name
    named = df.where((F.col("i") > 1) & (F.coalesce("label", F.lit("")) != "")).select(id_col, F.col("i").alias("start"), "label")
    out = ends.join(named, [id_col, "start"], "left")
    return out.select(id_col, "start", "end", F.coalesce("label", F.lit("Data block")).alias("label"))
