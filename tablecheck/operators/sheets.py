"""Sheet shaping over the long cell form: headers, trimming, truncation, text export.

A cell row with a null ``row_idx`` only names a column; a sheet that has nothing else is a sheet with a header and no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablecheck.functions.cells import is_empty
from tablecheck.operators.rownum import first_n, part_number, positions, running_sum
from tablecheck.session import cut_lineage

MAX_ROWS_FULL = 500
HEAD_ROWS = 100
TAIL_ROWS = 50
#: Bytes of a part of a sheet's whole text.
PART_BYTES = 1 << 20


def trim_columns(cells: DataFrame, table: list[str]) -> DataFrame:
    """Drop trailing columns without any value; inner empty columns stay."""
    last = cells.groupBy(*table).agg(F.max(F.when(~is_empty(F.col("value")), F.col("col_idx"))).alias("last_col"))
    # written, so that its side of the join is dealt anew and a heavy table can be split
    out = cells.join(cut_lineage(last, "last-columns"), table)
    return out.where(F.col("col_idx") <= F.coalesce("last_col", F.lit(1))).drop("last_col")


def visible(cells: DataFrame, hidden: DataFrame) -> DataFrame:
    """Cells of sheets that are not hidden; ``hidden``: case_id, sheet, hidden."""
    gone = hidden.where("hidden").select("case_id", "sheet").distinct()
    return cells.join(gone, ["case_id", "sheet"], "left_anti")


def nonempty(cells: DataFrame, table: list[str]) -> DataFrame:
    """Cells of tables that have at least one row."""
    some = cells.groupBy(*table).agg(F.count("row_idx").alias("_rows")).where("_rows > 0").select(*table)
    return cells.join(cut_lineage(some, "nonempty"), table, "left_semi")


def lone_headers(cells: DataFrame, table: list[str]) -> DataFrame:
    """Whether a table's only row is data: it is when any of its cells is no text.

    ``cells``: table, row_idx, kind (``text`` or the type of another value).  One aggregate; a table has one row if its least and greatest
    row index agree.
    """
    out = cells.groupBy(*table).agg(
        (F.min("row_idx") == F.max("row_idx")).alias("single_row"), F.bool_or(F.col("kind") != "text").alias("has_typed_cell")
    )
    return out.withColumn("first_row_is_data", F.col("single_row") & F.col("has_typed_cell"))


def csv_field(c: Column) -> Column:
    """Quote a field only when it needs quoting."""
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.rlike('[,"\n\r]'), quoted).otherwise(F.coalesce(c, F.lit("")))


def filled_rows(cells: DataFrame, table: list[str]) -> DataFrame:
    """Row indexes of the rows that have a value, of every table."""
    rows = cells.where(F.col("row_idx").isNotNull()).groupBy(*table, "row_idx").agg(F.bool_or(~is_empty(F.col("value"))).alias("filled"))
    return rows.where("filled").select(*table, "row_idx")


def row_bounds(rows: DataFrame, table: list[str], head: int, tail: int) -> DataFrame:
    """Number of rows of every table and the row indexes where its head ends and its tail begins.

    ``rows`` is read several times: pass a written table.  Each boundary keeps only ``head`` or
    ``tail`` rows per task before the shuffle.
    """
    n = rows.groupBy(*table).agg(F.count(F.lit(1)).alias("n_rows"))
    first = first_n(rows, table, ["row_idx"], head).groupBy(*table).agg(F.max("row_idx").alias("head_max"))
    last = first_n(rows, table, [F.desc("row_idx")], tail).groupBy(*table).agg(F.min("row_idx").alias("tail_min"))
    return n.join(first, table).join(last, table)


def truncate_rows(
    cells: DataFrame, table: list[str], max_full: int = MAX_ROWS_FULL, head: int = HEAD_ROWS, tail: int = TAIL_ROWS
) -> DataFrame:
    """Non-empty rows; long tables keep their first and last rows and one marker row.

    Cells between the boundaries are dropped before rows are put together, so
    the values of a long table are never shuffled.  Returns ``pos`` (0-based
    place among the rows), ``n_rows``, ``kind`` (row / marker), ``omitted``,
    ``row_idx`` and ``row_values``.
    """
    bounds = cut_lineage(row_bounds(cut_lineage(filled_rows(cells, table), "filled-rows"), table, head, tail), "row-bounds")
    near = cells.where(F.col("row_idx").isNotNull()).join(bounds, table)
    short = F.col("n_rows") <= max_full
    near = near.where(short | (F.col("row_idx") <= F.col("head_max")) | (F.col("row_idx") >= F.col("tail_min")))
    rows = near.groupBy(*table, "row_idx").agg(
        F.array_sort(F.collect_list(F.struct("col_idx", "value"))).alias("sig"),
        F.bool_or(~is_empty(F.col("value"))).alias("filled"),
        F.max("n_rows").alias("n_rows"),
    )
    rows = rows.where("filled").withColumn("_k", F.row_number().over(Window.partitionBy(*table).orderBy("row_idx")) - 1)
    beyond = (F.col("n_rows") > max_full) & (F.col("_k") >= head)
    kept = rows.select(
        *table,
        F.when(beyond, F.col("n_rows") - tail - head + F.col("_k")).otherwise(F.col("_k")).alias("pos"),
        "n_rows",
        F.lit("row").alias("kind"),
        F.lit(0).cast("bigint").alias("omitted"),
        "row_idx",
        F.transform("sig", lambda c: c["value"]).alias("row_values"),
    )
    marker = bounds.where(~short).select(
        *table,
        F.lit(head).cast("bigint").alias("pos"),
        "n_rows",
        F.lit("marker").alias("kind"),
        (F.col("n_rows") - head - tail).alias("omitted"),
    )
    return kept.unionByName(marker, allowMissingColumns=True)


def headers(cells: DataFrame, table: list[str]) -> DataFrame:
    """Column names of every table in order (``names``), also of tables without rows."""
    found = F.array_sort(F.collect_set(F.struct("col_idx", "col_name")))
    return cells.groupBy(*table).agg(F.transform(found, lambda c: c["col_name"]).alias("names"))


def csv_line(values: Column) -> Column:
    return F.array_join(F.transform(values, csv_field), ",")


def sheet_lines(cells: DataFrame, table: list[str]) -> DataFrame:
    """The text of every sheet as lines: table, row_idx (null for the header), line, n_bytes with the line end, n_cols."""
    rows = cells.where(F.col("row_idx").isNotNull()).groupBy(*table, "row_idx").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "value"))), lambda c: c["value"]).alias("vals"),
        F.bool_or(~is_empty(F.col("value"))).alias("filled"),
    )
    rows = rows.where("filled").select(*table, "row_idx", csv_line(F.col("vals")).alias("line"), F.size("vals").cast("bigint").alias("n_cols"))
    top = headers(cells, table).select(
        *table, F.lit(None).cast("bigint").alias("row_idx"), csv_line(F.col("names")).alias("line"), F.size("names").cast("bigint").alias("n_cols")
    )
    return rows.unionByName(top).withColumn("n_bytes", F.octet_length("line").cast("bigint") + 1)


def sheet_sizes(lines: DataFrame, table: list[str]) -> DataFrame:
    """row_count, col_count and n_bytes of the text of every sheet, from its lines."""
    return lines.groupBy(*table).agg(
        F.count("row_idx").alias("row_count"),
        F.max(F.when(F.col("row_idx").isNull(), F.col("n_cols"))).alias("col_count"),
        F.sum("n_bytes").alias("n_bytes"),
    )


def sheet_texts(cells: DataFrame, table: list[str], part_bytes: int = PART_BYTES) -> DataFrame:
    """Whole CSV text of every sheet in parts of at most ``part_bytes`` bytes: table, part, csv_text, n_lines.

    The parts of a sheet joined in order are its text: the header line and every row that has a value.  Parts are cut by running
    byte sums, so no task and no value holds a long sheet.
    """
    lines = sheet_lines(cells, table).withColumn("_at", F.coalesce("row_idx", F.lit(-(1 << 62))))
    placed = running_sum(positions(lines, "_at", table), table, "pos", "n_bytes", "start")
    part = part_number(F.col("start"), F.col("n_bytes"), part_bytes)
    texts = placed.withColumn("part", part).groupBy(*table, "part").agg(
        F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"), F.count(F.lit(1)).alias("n_lines")
    )
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return texts.select(*table, "part", F.concat(body, F.lit("\n")).alias("csv_text"), "n_lines")


def sheet_views(
    cells: DataFrame, table: list[str], max_full: int = MAX_ROWS_FULL, head: int = HEAD_ROWS, tail: int = TAIL_ROWS
) -> DataFrame:
    """One CSV text per sheet as a review shows it: header line and all rows up to ``max_full``, else head, marker and tail rows.

    A sheet without rows shows its header.  row_count counts all rows.
    """
    names = headers(cells, table)
    rows = truncate_rows(cells, table, max_full, head, tail).join(names, table)
    mark = F.format_string("[... %d rows truncated ...]", "omitted")
    shown = F.when(F.col("kind") == "row", F.col("row_values")).otherwise(F.array_repeat(mark, F.size("names")))
    texts = rows.withColumn("line", csv_line(shown)).groupBy(*table).agg(
        F.array_sort(F.collect_list(F.struct("pos", F.col("kind").alias("k"), "line"))).alias("lines"), F.max("n_rows").alias("n_rows")
    )
    texts = names.join(texts, table, "left")
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    count = F.coalesce("n_rows", F.lit(0).cast("bigint"))
    return texts.select(
        *table,
        F.concat(csv_line(F.col("names")), F.lit("\n"), F.coalesce(F.concat(body, F.lit("\n")), F.lit(""))).alias("csv_text"),
        count.alias("row_count"),
        F.size("names").cast("bigint").alias("col_count"),
        (count > max_full).alias("truncated"),
    )
