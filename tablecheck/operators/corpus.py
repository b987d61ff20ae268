"""Reconciliation of a whole corpus of workbooks in one plan.

Tables are paired per case, columns mapped per table pair, a key elected per pair, rows joined by that key or else by
position, and cells compared: all pairs at once, none by itself.  Cells become rows of mapped values early (one shuffle by
pair and row), so everything after it moves whole rows, spread by pair and row or by pair and key.  A workbook that
holds a large share of all cells is therefore spread like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablecheck.functions.cells import DIFF, FILL, MATCH, REL_TOL, is_empty, is_fill, values_match
from tablecheck.operators import matching, reconcile as rc
from tablecheck.operators.rownum import first_per_key, positions, report_row
from tablecheck.operators.skew import composite_key, spread_join
from tablecheck.session import cut_lineage

PAIR = ["case_id", "source_sheet", "generated_sheet"]
NO_KEY = "\x00null"


def visible_tables(cells: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """Tables that have rows and are not hidden: case_id, side, sheet, sheet_idx, columns.

    ``cells``: case_id, side, sheet, row_idx, col_idx, col_name, value; a null row_idx only names a column.  ``hidden`` (case_id,
    sheet, hidden) is about generated sheets.  Sheets are in order of ``sheet_idx`` where cells carry it, else of their names.
    """
    order = F.min("sheet_idx") if "sheet_idx" in cells.columns else F.lit(0)
    found = cells.groupBy("case_id", "side", "sheet").agg(
        F.array_sort(F.collect_set("col_name")).alias("columns"), F.count("row_idx").alias("_rows"), order.alias("sheet_idx")
    ).where("_rows > 0").drop("_rows")
    if hidden is None:
        return found
    gone = hidden.where("hidden").select("case_id", "sheet", F.lit("generated").alias("side")).distinct()
    return found.join(gone, ["case_id", "side", "sheet"], "left_anti")


def column_table(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """Columns of paired tables: PAIR, side, sheet, col_idx, col_name."""
    columns = cells.groupBy("case_id", "side", "sheet", "col_idx").agg(F.min("col_name").alias("col_name"))
    sides = [
        pairs.select(*PAIR, F.lit(side).alias("side"), F.col(f"{side}_sheet").alias("sheet")) for side in ("source", "generated")
    ]
    return columns.join(sides[0].unionByName(sides[1]), ["case_id", "side", "sheet"])


def column_overlaps(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """PAIR, s_idx, g_idx, overlap of the values of paired tables' columns."""
    found = matching.value_overlaps(cells, ["case_id"], ["sheet", "col_idx"])
    found = found.select("case_id", F.col("s_sheet").alias("source_sheet"), F.col("g_sheet").alias("generated_sheet"),
                         F.col("s_col_idx").alias("s_idx"), F.col("g_col_idx").alias("g_idx"), "overlap")
    return found.join(pairs.select(*PAIR), PAIR, "left_semi")


def map_corpus(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """Column mapping of every pair: PAIR, ord, s_idx, source_col, g_idx, generated_col, match_type, confidence, cmp.

    ``cmp`` numbers the columns that are sure enough to be compared, in mapping order.
    """
    mapped = matching.match_columns(column_table(cells, pairs), column_overlaps(cells, pairs), PAIR)
    sure = F.col("confidence") >= rc.PAIR_MIN_CONFIDENCE
    place = F.sum(sure.cast("int")).over(Window.partitionBy(*PAIR).orderBy("ord")) - 1
    return mapped.withColumn("cmp", F.when(sure, place.cast("int")))


def mapped_rows(cells: DataFrame, columns: DataFrame, mapped: DataFrame) -> DataFrame:
    """PAIR, side, row_idx, filled, vals (compared column number to value) of every row of the paired tables.

    A row without its cell of a column has no value there.
    """
    numbered = [
        mapped.select(*PAIR, F.lit(side).alias("side"), F.col(idx).alias("col_idx"), "cmp")
        for side, idx in (("source", "s_idx"), ("generated", "g_idx"))
    ]
    places = columns.drop("col_name").join(numbered[0].unionByName(numbered[1]), [*PAIR, "side", "col_idx"], "left")
    found = cells.where(F.col("row_idx").isNotNull()).select("case_id", "side", "sheet", "row_idx", "col_idx", "value")
    found = found.join(places, ["case_id", "side", "sheet", "col_idx"])
    cell = F.when(F.col("cmp").isNotNull(), F.struct("cmp", "value"))
    return found.groupBy(*PAIR, "side", "row_idx").agg(
        F.bool_or(~is_empty(F.col("value"))).alias("filled"), F.map_from_entries(F.collect_list(cell)).alias("vals")
    )


def elect_keys(rows: DataFrame) -> DataFrame:
    """PAIR, key: the first compared column of each pair that is fit to join on; pairs without one are absent.

    Values of all candidate columns are counted once, by pair, column and value; uniqueness on both sides and containment
    of generated values are sums over these counts.
    """
    each = rows.select(*PAIR, "side", F.explode("vals").alias("cmp", "value")).where(F.col("value").isNotNull())
    is_src = F.col("side") == "source"
    per_value = each.groupBy(*PAIR, "cmp", "value").agg(F.count_if(is_src).alias("ns"), F.count_if(~is_src).alias("ng"))
    in_s, in_g = F.col("ns") > 0, F.col("ng") > 0
    stats = per_value.groupBy(*PAIR, "cmp").agg(
        (F.count_if(in_s) / F.expr("nullif(sum(ns), 0)")).alias("src_unique"),
        (F.count_if(in_g) / F.expr("nullif(sum(ng), 0)")).alias("gen_unique"),
        (F.count_if(in_s & in_g) / F.expr("nullif(count_if(ng > 0), 0)")).alias("gen_in_src"),
    )
    return rc.is_key(stats).where("is_key").groupBy(*PAIR).agg(F.min("cmp").alias("key"))


def join_rows(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """PAIR, row_index, key, s, g: filled source rows beside their generated rows (values by compared column).

    By key: the first generated row with the same key value, missing keys meeting each other; without key: the row at
    the same position among the filled rows.
    """
    filled = rows.where("filled").drop("filled")
    src = positions(filled.where("side = 'source'").drop("side"), "row_idx", PAIR)
    src, gen = src.join(keys, PAIR, "left"), filled.where("side = 'generated'").drop("side").join(keys, PAIR, "left")
    keyed = F.col("key").isNotNull()
    value = F.coalesce(F.col("vals")[F.col("key")], F.lit(NO_KEY))
    travel = composite_key(*[F.col(c) for c in PAIR], value).alias("_key")
    left = src.where(keyed).select("*", travel)
    right = first_per_key(gen.where(keyed).select(travel, "row_idx", "vals"), ["_key"], ["row_idx"])
    by_key = spread_join(left, right.select("_key", "vals"), "_key", F.xxhash64(*PAIR, "row_idx"))
    by_key = by_key.select(*PAIR, "pos", "key", F.col("vals").alias("s"), F.col("other.vals").alias("g"))
    at = positions(gen.where(~keyed).drop("key"), "row_idx", PAIR).select(*PAIR, "pos", F.col("vals").alias("g"))
    by_place = src.where(~keyed).join(at, [*PAIR, "pos"]).select(*PAIR, "pos", "key", F.col("vals").alias("s"), "g")
    return by_key.unionByName(by_place).select(*PAIR, report_row(F.col("pos")).alias("row_index"), "key", "s", "g")


def cell_codes(n: Column, rel_tol: float) -> Column:
    """Match code of every compared column of a row that has ``s`` and ``g``."""

    def code(i: Column) -> Column:
        a, b = F.col("s")[i], F.col("g")[i]
        return F.when(values_match(a, b, rel_tol=rel_tol), MATCH).when(is_fill(a, b), FILL).otherwise(DIFF)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), code)).otherwise(F.array().cast("array<int>"))


@dataclass
class CorpusReconciliation:
    """Result tables of a corpus; ``rows`` and ``compared`` are written once, the rest is lazy over them."""

    pairs: DataFrame
    mapped: DataFrame
    keys: DataFrame
    rows: DataFrame
    compared: DataFrame

    def summary(self) -> DataFrame:
        """One row per table pair, also where nothing could be compared (``match_method`` is null there)."""
        of = lambda side: F.col("side") == side
        sizes = self.rows.groupBy(*PAIR).agg(
            F.count_if(of("source") & F.col("filled")).alias("source_rows"),
            F.count_if(of("generated") & F.col("filled")).alias("generated_rows"),
            F.count_if(~F.col("filled")).alias("empty_rows_dropped"),
        )
        with_code = lambda code: F.size(F.filter("codes", lambda c: c == code))
        fills, diffs = with_code(FILL), with_code(DIFF)
        counts = self.compared.select(*PAIR, fills.alias("f"), diffs.alias("d")).groupBy(*PAIR).agg(
            F.count(F.lit(1)).alias("comparable_rows"),
            F.count_if(F.col("d") == 0).alias("matched_rows"),
            F.sum("f").alias("expected_fill_cells"),
            F.sum("d").alias("diff_cells"),
        )
        columns = self.mapped.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("mapped_columns"), F.count("cmp").alias("compared_columns"))
        named = self.keys.join(self.mapped.select(*PAIR, F.col("cmp").alias("key"), F.col("source_col").alias("key_column")), [*PAIR, "key"])
        out = self.pairs
        for part in (sizes, columns, counts, named.drop("key")):
            out = out.join(part, PAIR, "left")
        none = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
        method = F.when(F.col("key_column").isNotNull(), "key_based").when(F.coalesce("compared_columns", F.lit(0)) > 0, "positional")
        out = out.select(
            *PAIR, "is_first", *[none(c) for c in ("source_rows", "generated_rows", "empty_rows_dropped", "mapped_columns", "compared_columns",
                                                   "comparable_rows", "matched_rows", "expected_fill_cells", "diff_cells")],
            method.alias("match_method"), "key_column",
        )
        return out.withColumn("match_pct", rc.percent(F.col("matched_rows"), F.col("comparable_rows")))

    def columns(self) -> DataFrame:
        """The mapping with the share of matching cells of each compared column (null for the others)."""
        cells = self.compared.select(*PAIR, F.posexplode("codes").alias("cmp", "code"))
        shares = cells.groupBy(*PAIR, "cmp").agg(
            F.count_if(F.col("code") == MATCH).alias("matching_cells"), F.count(F.lit(1)).alias("compared_cells")
        )
        out = self.mapped.join(shares, [*PAIR, "cmp"], "left")
        share = F.when(F.col("cmp").isNotNull(), rc.percent(F.coalesce("matching_cells", F.lit(0)), F.coalesce("compared_cells", F.lit(0))))
        return out.select(*PAIR, "ord", "source_col", "generated_col", "match_type", "confidence", "matching_cells", share.alias("value_match_pct"))

    def diffs(self) -> DataFrame:
        """Every mismatching cell of the corpus, whole; ``kind`` is ``diff`` or ``expected_fill``."""
        cells = self.compared.select(*PAIR, "row_index", "s", "g", F.posexplode("codes").alias("cmp", "code")).where(F.col("code") > MATCH)
        cells = cells.select(*PAIR, "row_index", "cmp", F.col("s")[F.col("cmp")].alias("source_value"), F.col("g")[F.col("cmp")].alias("generated_value"),
                             F.when(F.col("code") == FILL, "expected_fill").otherwise("diff").alias("kind"))
        names = self.mapped.where(F.col("cmp").isNotNull()).select(*PAIR, "cmp", F.col("source_col").alias("column"))
        out = cells.join(names, [*PAIR, "cmp"])
        return out.select(*PAIR, "row_index", F.col("cmp").alias("col_order"), "column", "source_value", "generated_value", "kind")

    def first_diffs(self, diffs: int = rc.MAX_DIFFS, fills: int = rc.MAX_FILLS) -> DataFrame:
        """Report form: the first differences and fills of each pair."""
        return rc.capped_diffs(self.diffs(), PAIR, diffs, fills)


def reconcile_corpus(cells: DataFrame, hidden: DataFrame | None = None, rel_tol: float = REL_TOL) -> CorpusReconciliation:
    """Pair, map, key, join and compare all tables of ``cells`` (case_id, side, sheet, row_idx, col_idx, col_name, value).

    Hidden and empty tables take no part.  Cases with one side only give no pair.
    """
    tables = visible_tables(cells, hidden)
    pairs = cut_lineage(matching.match_tables(tables), "corpus-pairs")
    seen = cells.join(tables.select("case_id", "side", "sheet"), ["case_id", "side", "sheet"], "left_semi")
    mapped = cut_lineage(map_corpus(seen, pairs), "corpus-columns")
    rows = cut_lineage(mapped_rows(seen, column_table(seen, pairs), mapped), "corpus-rows")
    keys = cut_lineage(elect_keys(rows.where("filled")), "corpus-keys")
    width = mapped.groupBy(*PAIR).agg(F.count("cmp").cast("int").alias("width")).where("width > 0")
    joined = join_rows(rows.join(width.select(*PAIR), PAIR, "left_semi"), keys).join(width, PAIR)
    compared = joined.select(*PAIR, "row_index", "key", "s", "g", cell_codes(F.col("width"), rel_tol).alias("codes"))
    return CorpusReconciliation(pairs, mapped, keys, rows, cut_lineage(compared, "corpus-compared"))
