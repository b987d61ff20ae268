"""Facts about workbooks from cell, style, layout and chart tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablecheck.functions.formula import areas, is_error_value, sheet_refs, shown_formula, uses_indirect
from tablecheck.operators.rownum import first_per_key

NO_COLOR = "00000000"


def formulas(cells: DataFrame) -> DataFrame:
    """Cells that hold a formula, with shown text and error flag."""
    shown = shown_formula(F.col("formula_kind"), F.col("formula"), F.col("r1"), F.col("r2"))
    out = cells.withColumn("shown", shown).where("shown IS NOT NULL")
    return out.withColumn("has_error", is_error_value(F.col("computed_value")))


def join_values(texts: DataFrame, values: DataFrame) -> DataFrame:
    """Formula texts beside the values computed for the same cells."""
    on = ["case_id", "sheet", "coord"]
    return texts.join(values.select(*on, "computed_value"), on, "left")


def formula_stats(found: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Per case: number of formulas and of formula errors, and all error lines in sheet and cell order.

    ``cases`` (case_id) names cases that may have no formula; they come with zeros and no line.
    """
    line = F.concat("sheet", F.lit("!"), "coord", F.lit(": "), "shown", F.lit(" → "), "computed_value")
    error = F.when(F.col("has_error"), F.struct("sheet_idx", "row_idx", "col_idx", line.alias("line")))
    out = found.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("total_formulas"), F.count_if("has_error").alias("formula_errors"), F.sort_array(F.collect_list(error)).alias("e")
    )
    if cases is not None:
        out = cases.select("case_id").distinct().join(out, "case_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    text = F.array_join(F.transform("e", lambda x: x["line"]), "\n")
    return out.select("case_id", none("total_formulas"), none("formula_errors"), F.coalesce(text, F.lit("")).alias("error_details"))


def error_lines(found: DataFrame) -> DataFrame:
    """One row per formula error: case_id, sheet_idx, row_idx, col_idx, line."""
    line = F.concat("sheet", F.lit("!"), "coord", F.lit(": "), "shown", F.lit(" → "), "computed_value")
    return found.where("has_error").select("case_id", "sheet_idx", "row_idx", "col_idx", line.alias("line"))


def cross_sheet_refs(found: DataFrame, sheets: DataFrame) -> DataFrame:
    """First formula of every sheet that names another sheet of the workbook.

    ``found`` holds plain formulas; ``sheets`` the sheet names (case_id, sheet).
    """
    named = found.where(F.startswith("formula", F.lit("=")))
    named = named.select(
        "case_id", "sheet", "row_idx", "col_idx", "coord", "formula", F.explode(sheet_refs(F.col("formula"))).alias("target")
    ).where("target <> sheet")
    first = first_per_key(named, ["case_id", "sheet", "target"], ["row_idx", "col_idx"])
    known = sheets.select("case_id", F.col("sheet").alias("target")).distinct()
    first = first.join(known, ["case_id", "target"], "left_semi")
    return first.select("case_id", "sheet", "target", "coord", F.col("formula").alias("example"))


def named_areas(names: DataFrame) -> DataFrame:
    """Rectangles of defined names (case_id, name, attr_text), one row each: case_id, name, sheet, top, left, bottom, right."""
    return names.select("case_id", "name", F.explode(areas(F.col("attr_text"))).alias("a")).select("case_id", "name", "a.*")


def named_refs(names: DataFrame) -> DataFrame:
    """Defined names as cross references: case_id, sheet (``name`` and the name), target, coord, example; local and broken names are none."""
    first = first_per_key(named_areas(names), ["case_id", "name", "sheet"], ["top", "left", "bottom", "right"])
    coord = F.format_string("R%dC%d:R%dC%d", "top", "left", "bottom", "right")
    texts = names.select("case_id", "name", F.col("attr_text").alias("example")).distinct()
    return first.join(texts, ["case_id", "name"]).select("case_id", F.concat(F.lit("name "), "name").alias("sheet"), F.col("sheet").alias("target"), coord.alias("coord"), "example")


#: Rows of the stretches a sheet is cut into, from fine to coarse.
STRETCHES = tuple(64 * 8**k for k in range(6))


def cells_in_areas(cells: DataFrame, found: DataFrame) -> DataFrame:
    """``cells`` (case_id, sheet, row_idx, col_idx, ...) beside the named areas they lie in.

    An area is filed under the finest stretches of rows that cover it with two at most; a cell looks into one stretch of each size
    that is in use.  So a tall area costs two rows, and no cell is compared with areas far away.
    """
    height = F.col("bottom") - F.col("top") + 1
    level = F.lit(len(STRETCHES) - 1)
    for k in reversed(range(len(STRETCHES) - 1)):
        level = F.when(height <= STRETCHES[k], k).otherwise(level)
    size = F.element_at(F.array(*[F.lit(s) for s in STRETCHES]), F.col("level") + 1)
    filed = found.withColumn("level", level)
    filed = filed.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("top") / size), F.floor(F.col("bottom") / size))))
    used = [r.level for r in filed.select("level").distinct().collect()]  # six at most
    if not used:
        used = [0]
    looks = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("row_idx") / STRETCHES[k]).alias("stretch")) for k in sorted(used)])
    probing = cells.withColumn("_look", F.explode(looks)).select("*", "_look.level", "_look.stretch").drop("_look")
    inside = F.col("row_idx").between(F.col("top"), F.col("bottom")) & F.col("col_idx").between(F.col("left"), F.col("right"))
    return probing.join(filed, ["case_id", "sheet", "level", "stretch"]).where(inside).drop("level", "stretch")


def first_indirect(found: DataFrame) -> DataFrame:
    hits = found.where(F.startswith("formula", F.lit("=")) & uses_indirect(F.col("formula")))
    first = first_per_key(hits, ["case_id", "sheet"], ["row_idx", "col_idx"])
    return first.select("case_id", "sheet", "coord", F.col("formula").alias("example"))


def visible_styles(styles: DataFrame) -> DataFrame:
    return styles.where(~F.col("hidden"))


def fonts_used(styles: DataFrame) -> DataFrame:
    """Explicit fonts of every workbook, one row each, or the theme font of a workbook that sets none: case_id, item."""
    seen = visible_styles(styles).where(F.col("font_name").isNotNull())
    names = seen.select("case_id", F.col("font_scheme").isNull().alias("own"), "font_name").distinct()
    about = names.groupBy("case_id").agg(F.bool_or("own").alias("any_own"), F.min("font_name").alias("theme"))
    both = names.join(about, "case_id")
    chosen = F.when(F.col("any_own"), F.when(F.col("own"), F.col("font_name"))).otherwise(F.col("theme"))
    return both.select("case_id", chosen.alias("item")).where("item IS NOT NULL").distinct()


def color_palette(styles: DataFrame) -> DataFrame:
    """All colours of every workbook but transparent black, one row each: case_id, item."""
    colors = visible_styles(styles).select("case_id", F.explode(F.array("font_color", "fill_color")).alias("item"))
    return colors.where(F.col("item").isNotNull() & (F.col("item") != NO_COLOR)).distinct()


def format_items(styles: DataFrame, layout: DataFrame) -> DataFrame:
    """Everything about the look of a workbook as rows: case_id, kind (font, color, rule, merged, freeze), sheet, ord, item."""
    plain = lambda df, kind: df.select("case_id", F.lit(kind).alias("kind"), F.lit("").alias("sheet"), F.lit(0).cast("bigint").alias("ord"), "item")
    own = layout.select("case_id", "kind", "sheet", F.col("ord").cast("bigint").alias("ord"), "item")
    return plain(fonts_used(styles), "font").unionByName(plain(color_palette(styles), "color")).unionByName(own)


def formatting(styles: DataFrame, layout: DataFrame) -> DataFrame:
    """Fonts, colours and layout items of every workbook of ``styles``, counted and listed whole; as rows they are :func:`format_items`."""
    kind = F.col("kind")
    count = lambda k, name: F.count_if(kind == k).alias(name)
    plain = lambda k, name: F.array_join(F.array_sort(F.collect_set(F.when(kind == k, F.col("item")))), ",").alias(name)
    placed = F.struct("sheet", "ord", F.concat("sheet", F.lit("!"), "item").alias("name"))
    listed = lambda k: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(kind == k, placed))), lambda x: x["name"]), ",")
    found = format_items(styles, layout).groupBy("case_id").agg(
        count("font", "font_count"), count("color", "color_count"), count("rule", "rule_count"), count("merged", "merged_count"), count("freeze", "frozen_count"),
        plain("font", "fonts"), plain("color", "colors"), *[listed(k).alias(name) for k, name in (("rule", "rules"), ("merged", "merged"), ("freeze", "frozen"))],
    )
    out = visible_styles(styles).select("case_id").distinct().join(found, "case_id", "left")
    out = out.na.fill(0, [c for c in found.columns if c.endswith("_count")]).na.fill("", ["fonts"])
    return out.withColumns({c: F.nullif(c, F.lit("")) for c in ("colors", "rules", "merged", "frozen")})


def bold_header(styles: DataFrame) -> DataFrame:
    return styles.where("NOT hidden").groupBy("case_id").agg(
        F.bool_or(F.col("bold") & (F.col("row_idx") <= 3)).alias("has_bold_headers")
    )


def border_coverage(styles: DataFrame) -> DataFrame:
    """Bordered share of the visible cells and its label."""
    out = visible_styles(styles).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("total_cells"),
        F.count("border_style").alias("bordered_cells"),
        F.array_join(F.array_sort(F.collect_set("border_style")), ", ").alias("border_styles"),
    )
    pct = F.col("bordered_cells") / F.col("total_cells") * 100
    label = F.when(pct > 80, "all").when(pct > 20, "some").when(pct > 0, "few").otherwise("none")
    return out.withColumn("border_pct", pct).withColumn("coverage", label)


def chart_counts(charts: DataFrame) -> DataFrame:
    labelled = F.col("x_title").isNotNull() | F.col("y_title").isNotNull()
    return charts.groupBy("case_id", "chart_type").agg(
        F.count(F.lit(1)).alias("charts"),
        F.count_if("has_legend").alias("with_legend"),
        F.bool_or(labelled).alias("has_axis_labels"),
    )
