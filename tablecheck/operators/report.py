"""Text reports and metadata summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablecheck.operators.corpus import PAIR, CorpusReconciliation
from tablecheck.operators.profile import column_profile, corpus_profile, sample_values
from tablecheck.operators.reconcile import TEXT_CAP, low_match_note, row_ratio_note
from tablecheck.operators.rownum import first_n

# How much of each list a report shows.
SHOWN_SAMPLES, SHOWN_ERRORS, SHOWN_DIFFS, SHOWN_FILLS, SHOWN_REFS, SHOWN_LOOK = 3, 20, 30, 10, 20, 10
# Places of the lines on a table pair: column mappings, differences, fills, summary.
FIRST_COLUMN, FIRST_DIFF, FIRST_FILL, LAST_LINE = 100, 100_000, 200_000, 300_000


def profile_line() -> Column:
    base = F.format_string(
        "  - `%s` (%s): %d non-null, %d null, %d unique", "col_name", "dtype", "non_null", "null_count", "unique_count"
    )
    stats = F.format_string(", mean=%.2f, sum=%.2f", "num_mean", "num_sum")
    samples = F.concat(F.lit(", samples=["), "samples", F.lit("]"))
    return F.concat(
        base,
        F.when(F.col("num_mean").isNotNull(), stats).otherwise(""),
        F.when(F.coalesce("samples", F.lit("")) != "", samples).otherwise(""),
    )


def profile_lines(cells: DataFrame, table: list[str] = ["case_id", "sheet"]) -> DataFrame:
    """One report line per column, with its first values."""
    keys = [*table, "col_idx", "col_name"]
    heads = sample_values(cells, keys, "row_idx", SHOWN_SAMPLES).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rn", "value"))).alias("h")
    )
    heads = heads.select(*keys, F.array_join(F.transform("h", lambda x: x["value"]), ", ").alias("samples"))
    both = column_profile(cells, keys).join(heads, keys, "left")
    return both.select(*table, "col_idx", profile_line().alias("line"))


def scan_lines(cells: DataFrame, formulas: DataFrame, recon: CorpusReconciliation | None = None, errors: int = SHOWN_ERRORS) -> DataFrame:
    """Scan report as ordered lines: case_id, part, name, ord, line.

    Part 1 has the sheet profiles, part 2 the formulas with their first ``errors`` errors, part 3 the comparison of every table
    pair.  Written out in this order the lines are the report; keeping them as rows
    means no case has to fit in one value.
    """
    table = ["case_id", "sheet"]
    size = F.format_string(
        "**%s**: %d rows × %d cols (%d empty rows, %d duplicate rows)",
        "sheet", "row_count", "col_count", "empty_rows", "duplicate_rows",
    )
    line = lambda df, part, name, ord_, text: df.select("case_id", F.lit(part).alias("part"), name.alias("name"), ord_.cast("bigint").alias("ord"), text.alias("line"))
    sheets = line(corpus_profile(cells, table), 1, F.col("sheet"), F.lit(0), size)
    cols = line(profile_lines(cells, table), 1, F.col("sheet"), F.col("col_idx"), F.col("line"))
    total = formulas.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("has_error").alias("bad"))
    total = line(total, 2, F.lit(""), F.lit(0), F.format_string("- Total formulas: %d, formula errors: %d", "n", "bad"))
    wrong = first_n(formulas.where("has_error"), ["case_id"], ["sheet_idx", "row_idx", "col_idx"], errors)
    shown = F.concat(F.lit("  - "), "sheet", F.lit("!"), "coord", F.lit(": "), "shown", F.lit(" → "), "computed_value")
    out = sheets.unionByName(cols).unionByName(total).unionByName(line(wrong, 2, F.lit(""), F.col("rn"), shown))
    if recon is not None:
        name = F.concat("source_sheet", F.lit(" → "), "generated_sheet")
        out = out.unionByName(line(comparison_lines(recon), 3, name, F.col("ord"), F.col("line")))
    return out


def comparison_lines(recon: CorpusReconciliation, diffs: int = SHOWN_DIFFS, fills: int = SHOWN_FILLS) -> DataFrame:
    """Ordered lines on every table pair: totals, notes, column mappings, first differences and fills, summary."""
    col, when = F.col, F.when
    method = (
        when(col("match_method") == "key_based", F.format_string("- Rows joined by key `%s`; their order does not matter.", "key_column"))
        .when(col("match_method") == "positional", "- Rows compared by position; another order shows as differences.")
        .otherwise("- No columns could be compared.")
    )
    some = (col("source_rows") > 0) & (col("generated_rows") > 0)
    lines = [
        F.format_string("- Source rows: %d, generated rows: %d", "source_rows", "generated_rows"),
        when(col("empty_rows_dropped") > 0, F.format_string("- Empty rows left out: %d", "empty_rows_dropped")),
        method,
        when(some & row_ratio_note().isNotNull(), F.format_string("- Note: %s (%d of %d rows)", row_ratio_note(), "generated_rows", "source_rows")),
        F.format_string("- Comparable rows: %d, matched: %d (%.1f%%)", "comparable_rows", "matched_rows", F.round("match_pct", 1)),
        when(col("expected_fill_cells") > 0, F.format_string("- Expected fills: %d cells", "expected_fill_cells")),
        when(low_match_note().isNotNull(), F.concat(F.lit("- Warning: "), low_match_note())),
    ]
    totals = recon.summary()
    facts = totals.select(*PAIR, F.posexplode(F.array(*lines)).alias("ord", "line")).where("line IS NOT NULL")
    summary = totals.withColumn("match_pct", F.round("match_pct", 1)).select(
        *PAIR, F.lit(LAST_LINE).alias("ord"), F.concat(F.lit("- Summary: "), comparison_sentence()).alias("line")
    )
    share = when(col("value_match_pct").isNotNull(), F.format_string(" value_match=%.1f%%", F.round("value_match_pct", 1))).otherwise("")
    mapped = F.format_string("  - `%s` → `%s` (%s, conf=%.0f%%)%s", "source_col", "generated_col", "match_type", F.round(col("confidence") * 100), share)
    columns = recon.columns().select(*PAIR, (FIRST_COLUMN + col("ord")).alias("ord"), mapped.alias("line"))
    top = first_n(recon.diffs(), [*PAIR, "kind"], ["row_index", "col_order"], max(diffs, fills))
    short = lambda c: F.coalesce(F.substring(c, 1, TEXT_CAP), F.lit(""))
    differs = F.format_string("  - Row %d, `%s`: source=`%s` vs generated=`%s`", "row_index", "column", short("source_value"), short("generated_value"))
    filled = F.format_string("  - Row %d, `%s`: empty → `%s`", "row_index", "column", short("generated_value"))
    is_diff = col("kind") == "diff"
    top = top.where((col("rn") <= F.when(is_diff, diffs).otherwise(fills))).select(
        *PAIR, (F.when(is_diff, FIRST_DIFF).otherwise(FIRST_FILL) + col("rn")).alias("ord"), F.when(is_diff, differs).otherwise(filled).alias("line")
    )
    return facts.unionByName(summary).unionByName(columns).unionByName(top)


def comparison_sentence() -> Column:
    """Summary of one comparison row."""
    head = F.when(
        F.col("match_method") == "key_based",
        F.format_string("Key-based matching on `%s`: %d/%d rows match (%.1f%%).", "key_column", "matched_rows", "comparable_rows", "match_pct"),
    ).otherwise(F.format_string("%d/%d rows match (%.1f%%).", "matched_rows", "comparable_rows", "match_pct"))
    fills = F.when(
        F.col("expected_fill_cells") > 0,
        F.format_string(" %d cells were empty in source and filled in output.", "expected_fill_cells"),
    ).otherwise("")
    missing = F.col("source_rows") - F.col("comparable_rows")
    lost = F.when(
        (F.col("match_method") == "key_based") & (missing > 0),
        F.format_string(" %d source rows had no matching key.", missing),
    ).otherwise("")
    return F.concat(head, fills, lost)


def debug_meta(sheets: DataFrame, formulas: DataFrame, charts: DataFrame, refs: DataFrame, items: DataFrame) -> DataFrame:
    """Metadata of every case as rows (case_id, item, value): sheet sizes, formula counts, charts, the first cross references, fonts,
    colours and frozen panes, numbers of conditional rules and merged ranges.
    """
    size = F.concat(
        F.col("row_count").cast("string"), F.lit("x"), F.col("col_count").cast("string"),
        F.when(F.col("truncated"), " truncated").otherwise(""),
    )
    line = lambda df, item, value: df.select("case_id", item.alias("item"), value.cast("string").alias("value"))
    counts = formulas.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("has_error").alias("bad"))
    chart = F.concat("sheet", F.lit(": "), "chart_type", F.coalesce(F.concat(F.lit(" "), "title"), F.lit("")))
    first_refs = first_n(refs, ["case_id"], ["sheet", "target"], SHOWN_REFS)
    look = first_n(items.where(F.col("kind").isin("font", "color", "freeze")), ["case_id", "kind"], ["sheet", "ord", "item"], SHOWN_LOOK)
    total = lambda kind: items.where(F.col("kind") == kind).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        line(sheets, F.concat(F.lit("sheet "), "sheet"), size),
        line(counts, F.lit("formulas"), F.col("n")),
        line(counts, F.lit("formula errors"), F.col("bad")),
        line(charts, F.concat(F.lit("chart "), F.col("chart_idx").cast("string")), chart),
        line(first_refs, F.concat(F.lit("reference "), "sheet", F.lit(" → "), "target"), F.col("coord")),
        line(look, F.concat("kind", F.lit(" "), F.col("rn").cast("string")), F.col("item")),
        line(total("rule"), F.lit("conditional rules"), F.col("n")),
        line(total("merged"), F.lit("merged ranges"), F.col("n")),
    ]
    return reduce(DataFrame.unionByName, parts)
