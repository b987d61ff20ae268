"""Row positions, running sums, first-per-key, head/tail selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablecheck.session import cut_lineage

#: Rows of a slice, and slices of a block of slices, of a running sum.
SLICE, FAN = 4096, 4096


def positions(df: DataFrame, order: str, keys: list[str] | None = None, out: str = "pos") -> DataFrame:
    """0-based position of every row in ``order`` within ``keys``.

    Rows are dealt by range of keys and order, sorted inside a range and written once with their number in it; what lies
    before a range is the sum of the sizes of earlier ranges (one number per range).  No window runs over the rows, and a
    key with most of the rows is dealt over many ranges.  Rows without an order value come last, dealt by a hash of the
    row; rows that tie have any order among themselves.
    """
    keys = list(keys or [])
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    by = [F.col(k) for k in keys] + [F.col(order).asc_nulls_last(), F.when(F.col(order).isNull(), F.xxhash64(*plain))]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = cut_lineage(placed.withColumn("_id", F.monotonically_increasing_id()), "positions")
    sizes = sorted(rows.groupBy(F.shiftright("_id", 33).cast("int").alias("range")).count().collect())
    before, starts = 0, []
    for r in sizes:
        starts.append((r["range"], before - (r["range"] << 33)))
        before += r["count"]
    shift = df.sparkSession.createDataFrame(starts, "_range int, _shift bigint")
    ranged = rows.withColumn("_range", F.shiftright("_id", 33).cast("int")).join(F.broadcast(shift), "_range")
    found = ranged.withColumn(out, F.col("_id") + F.col("_shift")).drop("_id", "_range", "_shift")
    if not keys:
        return found.select(*df.columns, out)
    first = found.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.min(out).alias("_first"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return found.join(cut_lineage(first, "first-positions"), same).withColumn(out, F.col(out) - F.col("_first")).select(*df.columns, out)


def _running(df: DataFrame, keys: list[str], pos: str, measure: str, out: str, fold, merge, last: int) -> DataFrame:
    """``fold`` of ``measure`` over the rows up to ``last`` places from each row of its key (-1: before it, 0: with it).

    Slices of ``SLICE`` rows are folded first, then what lies before a slice over the slices of a block of ``FAN`` and over blocks, so
    no window frame grows with the rows of a key; ``fold`` must be associative.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(pos) / SLICE))
    before = lambda *by: Window.partitionBy(*keys, *by).rowsBetween(Window.unboundedPreceding, -1)
    sums = sliced.groupBy(*keys, "_slice").agg(fold(measure).alias("_sum")).withColumn("_block", F.floor(F.col("_slice") / FAN))
    blocks = sums.groupBy(*keys, "_block").agg(fold("_sum").alias("_all"))
    blocks = blocks.select(*keys, "_block", fold("_all").over(before().orderBy("_block")).alias("_base"))
    sums = sums.withColumn("_base2", fold("_sum").over(before("_block").orderBy("_slice"))).join(blocks, [*keys, "_block"])
    sums = cut_lineage(sums.select(*keys, "_slice", merge(F.col("_base"), F.col("_base2")).alias("_start")), "running")
    inside = Window.partitionBy(*keys, "_slice").orderBy(pos).rowsBetween(Window.unboundedPreceding, last)
    summed = sliced.withColumn("_inner", fold(measure).over(inside)).join(sums, [*keys, "_slice"])
    return summed.withColumn(out, merge(F.col("_start"), F.col("_inner"))).select(*df.columns, out)


def running_sum(df: DataFrame, keys: list[str], pos: str, measure: str, out: str) -> DataFrame:
    """Sum of ``measure`` over the rows before each row of its key, in the order of ``pos`` (dense positions)."""
    none = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return _running(df, keys, pos, measure, out, F.sum, lambda a, b: none(a) + none(b), -1)


def running_max(df: DataFrame, keys: list[str], pos: str, measure: str, out: str, last: int = 0) -> DataFrame:
    """Greatest ``measure`` so far, null where there is none; with (place, value) structs that is the last value so far."""
    return _running(df, keys, pos, measure, out, F.max, lambda a, b: F.greatest(a, b), last)


def part_number(start: Column, size: Column, part: int) -> Column:
    """Number of the part of at most ``part`` bytes that a value of ``size`` bytes starting at ``start`` goes to.

    Values inside one stretch of ``part`` bytes share a part; one that crosses into the next stretch has a part of its own between both.
    Numbers ascend in the order of the values and may leave gaps; only a value longer than ``part`` makes a longer part.
    """
    first, last = F.floor(start / part), F.floor((start + F.greatest(size, F.lit(1)) - 1) / part)
    return 2 * first + F.when(first == last, 0).otherwise(1)


def report_row(pos: Column) -> Column:
    """Row number as a reader sees it: 1-based plus the header line."""
    return pos + 2


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of each key; the limit is applied before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_n(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rn") -> DataFrame:
    """First ``n`` rows of each key with their 1-based rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def capped(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """First ``n`` rows of each key with their rank ``rn`` and how many ``more`` the key has."""
    more = df.groupBy(*keys).agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("more"))
    return first_n(df, keys, order, n).join(more, keys)


def head_tail(
    df: DataFrame, keys: list[str], pos: str, total: str, head: Column, tail: Column
) -> DataFrame:
    """Rows of the first ``head`` and last ``tail`` positions.  ``pos`` is 0-based, ``total`` the group size."""
    p, n = F.col(pos), F.col(total)
    return df.where((p < head) | (p >= n - tail))


def dedupe_names(df: DataFrame, keys: list[str], idx: str, name: str, out: str = "header") -> DataFrame:
    """Header names: blanks become ``Column_i``, the n-th repeat gets ``_n``."""
    base = F.when(F.coalesce(F.col(name), F.lit("")) == "", F.concat(F.lit("Column_"), F.col(idx).cast("string")))
    named = df.withColumn("_base", base.otherwise(F.col(name)))
    w = Window.partitionBy(*keys, "_base").orderBy(idx)
    seen = F.row_number().over(w) - 1
    return (
        named.withColumn("_seen", seen)
        .withColumn(
            out,
            F.when(F.col("_seen") == 0, F.col("_base")).otherwise(
                F.concat("_base", F.lit("_"), F.col("_seen").cast("string"))
            ),
        )
        .drop("_base", "_seen")
    )
