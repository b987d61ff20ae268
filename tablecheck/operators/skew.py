"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HOT_SAMPLE = 1024
HOT_SEEN = 1024
HOT_KEYS = 4096
SALTS = 64


def hot_keys(left: DataFrame, key: str, row_id: Column, sample: int = HOT_SAMPLE, seen: int = HOT_SEEN) -> DataFrame:
    """The heaviest keys, of those that very likely hold more than ``sample * seen`` rows.

    A deterministic one-in-``sample`` subset is counted. At most ``HOT_KEYS`` keys come back, so the list can be
    broadcast whatever the input; a key beyond them holds less than one row in ``HOT_KEYS``. The outcome decides only
    how rows travel, never what the join returns.
    """
    picked = left.where(F.pmod(F.xxhash64(row_id), F.lit(sample)) == 0)
    counts = picked.groupBy(key).count().where(F.col("count") >= seen)
    return counts.orderBy(F.desc("count"), key).limit(HOT_KEYS).select(key)


def spread_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    row_id: Column,
    how: str = "inner",
    sample: int = HOT_SAMPLE,
    seen: int = HOT_SEEN,
    keys_from: DataFrame | None = None,
) -> DataFrame:
    """Join ``left`` with ``right``, which has at most one row per ``key`` (a non-null string column).

    Left rows of a hot key travel under one of ``SALTS`` salts, whether the key has a partner or not; its right row is
    repeated once per salt. Each side is read once, besides the keys of ``left``. Returns the left columns plus the
    right columns in a struct named ``other`` (null when unmatched).
    ``keys_from`` may name a cheaper frame with the keys and row ids of ``left``.
    """
    value = F.struct(*[F.col(c) for c in right.columns if c != key])
    found = hot_keys(left if keys_from is None else keys_from, key, row_id, sample, seen)
    hot = F.broadcast(found.select(F.col(key).alias("_spread_hot")))
    is_hot = F.col("_spread_hot").isNotNull()
    salted = lambda k, salt: F.concat(k, F.lit("\x01"), salt.cast("string"))
    travel = F.when(is_hot, salted(F.col(key), F.pmod(F.xxhash64(row_id), F.lit(SALTS)))).otherwise(F.col(key))
    marked = left.join(hot, F.col(key) == F.col("_spread_hot"), "left").withColumn("_spread_travel", travel).drop("_spread_hot")
    salts = F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda n: salted(F.col(key), n))
    copies = F.broadcast(found.select(F.col(key).alias("_spread_hot"), F.explode(salts).alias("_spread_copy")))
    packed = right.select(F.col(key).alias("_spread_key"), value.alias("other"))
    packed = packed.join(copies, F.col("_spread_key") == F.col("_spread_hot"), "left")
    packed = packed.select("_spread_key", "other", F.coalesce("_spread_copy", "_spread_key").alias("_spread_right"))
    same = (F.col("_spread_travel") == F.col("_spread_right")) & (F.col(key) == F.col("_spread_key"))
    if how == "left_anti":
        return marked.join(packed.drop("other"), same, "left_anti").select(*left.columns)
    return marked.join(packed, same, how).select(*left.columns, "other")


def composite_key(*cols: Column) -> Column:
    """One string key from several columns; nulls keep a marker of their own."""
    parts = [F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]
    return F.concat_ws("\x02", *parts)


def key_join(left: DataFrame, right: DataFrame, keys: list[str], row_id: Column, how: str = "left") -> DataFrame:
    """Attach a per-key table to detail rows of which one key may have very many.

    Where a key has few detail rows by construction, a plain join is cheaper:
    this one reads the keys of ``left`` an extra time.
    """
    r = right.withColumn("_jk", composite_key(*[F.col(k) for k in keys])).drop(*keys)
    l = left.withColumn("_jk", composite_key(*[F.col(k) for k in keys]))
    out = spread_join(l, r, "_jk", row_id, how)
    if how == "left_anti":
        return out.drop("_jk")
    extra = [F.col("other")[c].alias(c) for c in r.columns if c != "_jk"]
    return out.select(*left.columns, *extra)
