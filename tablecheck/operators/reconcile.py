"""Row reconciliation of a source and a generated table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablecheck.functions.cells import (
    DIFF,
    FILL,
    MATCH,
    REL_TOL,
    canonical_text,
    is_fill,
    key_text,
    match_codes,
    values_match,
)
from tablecheck.operators.profile import all_empty
from tablecheck.operators.rownum import first_n, first_per_key, positions, report_row
from tablecheck.operators.skew import spread_join

MAX_DIFFS = 50
MAX_FILLS = 10
TEXT_CAP = 100
PAIR_MIN_CONFIDENCE = 0.5
KEY_MIN_UNIQUE = 0.9
KEY_MIN_CONTAINED = 0.5


@dataclass(frozen=True)
class Pair:
    """A source column and the generated column compared with it."""

    source: str
    generated: str
    match_type: str = "exact_name"
    confidence: float = 1.0


def drop_empty_rows(df: DataFrame, row: str) -> DataFrame:
    return df.where(~all_empty(df, {row}))


def empty_row_counts(sides: dict[str, DataFrame], row: str) -> DataFrame:
    """Total and empty rows of each named side."""
    parts = [
        df.agg(
            F.lit(side).alias("side"),
            F.count(F.lit(1)).alias("total_rows"),
            F.count_if(all_empty(df, {row})).alias("empty_rows"),
        )
        for side, df in sides.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _types(df: DataFrame) -> dict:
    return {f.name: f.dataType for f in df.schema.fields}


def pair_rows_by_key(
    src: DataFrame,
    gen: DataFrame,
    key: Pair,
    row: str = "row_idx",
    how: str = "inner",
    keys_from: DataFrame | None = None,
) -> DataFrame:
    """Source rows with the first generated row of the same key in ``other``."""
    keyed = lambda df: df.withColumn("_key", key_text(F.col(key.source), _types(src)[key.source]))
    left = keyed(src)
    right = gen.withColumn("_key", key_text(F.col(key.generated), _types(gen)[key.generated]))
    right = first_per_key(right, ["_key"], [row])
    hot_from = None if keys_from is None else keyed(keys_from)
    return spread_join(left, right, "_key", F.col(row), how, keys_from=hot_from).drop("_key")


def pair_rows_by_position(src: DataFrame, gen: DataFrame, row: str = "row_idx", dense: bool = False) -> DataFrame:
    """Row i with row i, after renumbering each side."""
    if dense:
        left, right = src.withColumn("pos", F.col(row)), gen.withColumn("pos", F.col(row))
    else:
        left, right = positions(src, row), positions(gen, row)
    right = right.select("pos", F.struct(*gen.columns).alias("other"))
    return left.join(right, "pos")


def compare_rows(
    joined: DataFrame,
    src: DataFrame,
    gen: DataFrame,
    pairs: list[Pair],
    row_index: Column,
    rel_tol: float = REL_TOL,
    col_tol: dict[str, float] | None = None,
) -> DataFrame:
    """Row number plus, per compared column i, a match code ``c{i}`` and the texts ``s{i}``, ``g{i}``."""
    st, gt, col_tol = _types(src), _types(gen), col_tol or {}
    cells = [
        (
            F.col(p.source),
            st[p.source],
            F.col("other")[p.generated],
            gt[p.generated],
            col_tol.get(p.source, rel_tol),
        )
        for p in pairs
    ]
    return match_codes(joined.withColumn("row_index", row_index.cast("bigint")), cells, ["row_index"])


def row_matched(n: int) -> Column:
    """No column differs except by expected fills."""
    return F.greatest(*[F.col(f"c{i}") for i in range(n)], F.lit(MATCH)) < DIFF


def cells_with(n: int, code: int) -> Column:
    """Number of cells of a row that carry ``code``."""
    return reduce(lambda a, b: a + b, [(F.col(f"c{i}") == code).cast("bigint") for i in range(n)])


def _counts(compared: DataFrame, n: int) -> DataFrame:
    return compared.agg(
        F.count(F.lit(1)).alias("comparable_rows"),
        F.count_if(row_matched(n)).alias("matched_rows"),
        F.coalesce(F.sum(cells_with(n, FILL)), F.lit(0)).alias("expected_fill_cells"),
        *[F.count_if(F.col(f"c{i}") == MATCH).alias(f"n{i}") for i in range(n)],
    )


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def comparison(
    compared: DataFrame, src: DataFrame, gen: DataFrame, pairs: list[Pair], method: str, key: str | None = None
) -> DataFrame:
    """One row with the totals of a comparison."""
    parts = [
        _counts(compared, len(pairs)).select("comparable_rows", "matched_rows", "expected_fill_cells"),
        src.agg(F.count(F.lit(1)).alias("source_rows")),
        gen.agg(F.count(F.lit(1)).alias("generated_rows")),
    ]
    names = ["source_rows", "generated_rows", "comparable_rows", "matched_rows", "expected_fill_cells"]
    one = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    one = one.agg(*[F.max(c).alias(c) for c in names])
    return one.select(
        *names,
        percent(F.col("matched_rows"), F.col("comparable_rows")).alias("match_pct"),
        F.lit(method).alias("match_method"),
        F.lit(key).cast("string").alias("key_column"),
    )


def column_match(compared: DataFrame, pairs: list[Pair]) -> DataFrame:
    """Matching share of every compared column, from the same single aggregate."""
    counts = _counts(compared, len(pairs))
    rows = [
        F.struct(
            F.lit(i).alias("col_order"),
            F.lit(p.source).alias("source_col"),
            F.lit(p.generated).alias("generated_col"),
            F.lit(p.match_type).alias("match_type"),
            F.lit(float(p.confidence)).alias("confidence"),
            F.col(f"n{i}").alias("matching_cells"),
            percent(F.col(f"n{i}"), F.col("comparable_rows")).alias("value_match_pct"),
        )
        for i, p in enumerate(pairs)
    ]
    return counts.select(F.inline(F.array(*rows)))


def cell_diffs(compared: DataFrame, pairs: list[Pair]) -> DataFrame:
    """Every mismatching cell, whole: ``kind`` is ``diff`` or ``expected_fill``."""
    cells = []
    for i, p in enumerate(pairs):
        cells += [F.lit(i), F.lit(p.source), F.col(f"s{i}"), F.col(f"g{i}"), F.col(f"c{i}")]
    # The filter follows the stack: one predicate over all columns would make the
    # optimizer derive exponentially many constraints.
    long = compared.select(
        "row_index",
        F.stack(F.lit(len(pairs)), *cells).alias("col_order", "column", "source_value", "generated_value", "code"),
    )
    kind = F.when(F.col("code") == FILL, "expected_fill").otherwise("diff")
    return long.where(F.col("code") > MATCH).withColumn("kind", kind).drop("code")


def capped_diffs(
    diffs: DataFrame, keys: list[str] | None = None, max_diffs: int = MAX_DIFFS, max_fills: int = MAX_FILLS
) -> DataFrame:
    """Report form: the first differences and fills in row, then column order, texts shortened."""
    by = [*(keys or []), "kind"]
    top = first_n(diffs, by, ["row_index", "col_order"], max(max_diffs, max_fills))
    top = top.where((F.col("kind") == "diff") & (F.col("rn") <= max_diffs)
                    | (F.col("kind") == "expected_fill") & (F.col("rn") <= max_fills))
    short = [F.substring(c, 1, TEXT_CAP).alias(c) for c in ("source_value", "generated_value")]
    return top.select(*(keys or []), "row_index", "column", *short, "kind")


def unmatched(left: DataFrame, right: DataFrame, left_key: str, right_key: str, row: str = "row_idx") -> DataFrame:
    """Rows of ``left`` whose key never occurs on the right."""
    keys = right.select(key_text(F.col(right_key), _types(right)[right_key]).alias("_key")).distinct()
    l = left.withColumn("_key", key_text(F.col(left_key), _types(left)[left_key]))
    return spread_join(l, keys.withColumn("_hit", F.lit(True)), "_key", F.col(row), "left_anti").drop("_key")


def key_statistics(src: DataFrame, gen: DataFrame, pairs: list[Pair]) -> DataFrame:
    """Uniqueness on both sides and containment of generated keys, for every pair in one pass.

    Both sides are stacked to (pair, value) and counted once; containment is then
    a grouping of equal values, not a join per column.
    """
    st, gt = _types(src), _types(gen)

    def stack(df, cols, types, side):
        cells = F.array(*[
            F.struct(F.lit(i).alias("pair"), canonical_text(F.col(c), types[c]).alias("v"))
            for i, c in enumerate(cols)
        ])
        cells = F.filter(cells, lambda x: x["v"].isNotNull())
        return df.select(F.inline(cells), F.lit(side == "s").alias("is_src"))

    both = stack(src, [p.source for p in pairs], st, "s").unionByName(
        stack(gen, [p.generated for p in pairs], gt, "g")
    )
    per_value = both.groupBy("pair", "v").agg(
        F.count_if("is_src").alias("ns"), F.count_if(~F.col("is_src")).alias("ng")
    )
    in_s, in_g = F.col("ns") > 0, F.col("ng") > 0
    return per_value.groupBy("pair").agg(
        (F.count_if(in_s) / F.expr("nullif(sum(ns), 0)")).alias("src_unique"),
        (F.count_if(in_g) / F.expr("nullif(sum(ng), 0)")).alias("gen_unique"),
        (F.count_if(in_s & in_g) / F.expr("nullif(count_if(ng > 0), 0)")).alias("gen_in_src"),
        F.count_if(in_s & in_g).alias("shared_values"),
    )


def is_key(stats: DataFrame) -> DataFrame:
    ok = (
        (F.col("src_unique") >= KEY_MIN_UNIQUE)
        & (F.col("gen_unique") >= KEY_MIN_UNIQUE)
        & (F.col("gen_in_src") >= KEY_MIN_CONTAINED)
    )
    return stats.withColumn("is_key", F.coalesce(ok, F.lit(False)))


def find_key(src: DataFrame, gen: DataFrame, pairs: list[Pair]) -> Pair | None:
    """First pair, in mapping order, fit to join on.  Reads back one row per column pair."""
    usable = [p for p in pairs if p.confidence >= PAIR_MIN_CONFIDENCE]
    if not usable:
        return None
    best = is_key(key_statistics(src, gen, usable)).where("is_key").agg(F.min("pair")).first()[0]
    return None if best is None else usable[best]


@dataclass
class Reconciliation:
    """Result tables of one comparison, all lazy."""

    pairs: list[Pair]
    key: Pair | None
    compared: DataFrame
    summary: DataFrame
    columns: DataFrame
    diffs: DataFrame


def reconcile(
    src: DataFrame,
    gen: DataFrame,
    pairs: list[Pair],
    key: Pair | None = None,
    row: str = "row_idx",
    rel_tol: float = REL_TOL,
    col_tol: dict[str, float] | None = None,
) -> Reconciliation:
    """Compare two tables by ``key``, or by position without one, ignoring empty rows."""
    pairs = [p for p in pairs if p.confidence >= PAIR_MIN_CONFIDENCE]
    s, g = drop_empty_rows(src, row), drop_empty_rows(gen, row)
    if key is None:
        joined = pair_rows_by_position(s, g, row)
    else:
        joined = pair_rows_by_key(positions(s, row), g, key, row, keys_from=s)
    compared = compare_rows(joined, s, g, pairs, report_row(F.col("pos")), rel_tol, col_tol)
    method = "positional" if key is None else "key_based"
    return Reconciliation(
        pairs,
        key,
        compared,
        comparison(compared, s, g, pairs, method, key and key.source),
        column_match(compared, pairs),
        cell_diffs(compared, pairs),
    )


def row_ratio_note() -> Column:
    """Reading hint on a comparison row whose sides differ much in size."""
    ratio = F.col("generated_rows") / F.expr("nullif(source_rows, 0)")
    return (
        F.when(F.col("generated_rows") == 0, F.lit(None))
        .when(ratio < 0.3, "filtered subset")
        .when(ratio > 3, "expanded")
    )


def low_match_note() -> Column:
    low = (F.col("match_pct") < 50) & (F.col("comparable_rows") > 0)
    return F.when(low & (F.col("match_method") == "positional"), "low match, row order may differ").when(
        low, "low match, values differ"
    )


def error_band(mismatch_share: Column) -> Column:
    """Indicator from the share of wrong cells: 0 above 15 %, 1 from 5 %, 2 below, 3 when none."""
    return (
        F.when(mismatch_share > 0.15, 0).when(mismatch_share >= 0.05, 1).when(mismatch_share > 0, 2).otherwise(3)
    )


def compare_corpus(src: DataFrame, gen: DataFrame, rel_tol: float = REL_TOL) -> DataFrame:
    """Positional comparison of many table pairs at once, one row per pair.

    Both sides are long: (pair_id, pos, col, value), ``col`` already mapped to
    a common name.  Rows present on one side only are not compared.
    """
    on = ["pair_id", "pos", "col"]
    cells = src.select(*on, F.col("value").alias("a")).join(gen.select(*on, F.col("value").alias("b")), on)
    m = values_match(F.col("a"), F.col("b"), rel_tol=rel_tol)
    cells = cells.select(*on, m.alias("m"), (~m & is_fill(F.col("a"), F.col("b"))).alias("f"))
    rows = cells.groupBy("pair_id", "pos").agg(
        F.bool_and(F.col("m") | F.col("f")).alias("ok"), F.count_if("f").alias("fills"), F.count_if(~F.col("m")).alias("bad")
    )
    return rows.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("comparable_rows"),
        F.count_if("ok").alias("matched_rows"),
        F.sum("fills").alias("expected_fill_cells"),
        (F.sum("bad") - F.sum("fills")).alias("diff_cells"),
    )
