"""Pairing of columns and of tables by name and content."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tablecheck.functions.naming import similarity
from tablecheck.operators.profile import unpivot_cells
from tablecheck.session import ship_by_value

ship_by_value(__name__)

COLUMN_MIN_SCORE = 0.3
TABLE_MIN_SCORE = 0.2
MAPPING = [
    ("ord", "int"), ("s_idx", "int"), ("source_col", "string"), ("g_idx", "int"),
    ("generated_col", "string"), ("match_type", "string"), ("confidence", "double"),
]


def value_overlaps(cells: DataFrame, ids: list[str], column: list[str]) -> DataFrame:
    """Jaccard overlap of the distinct values of every source and generated column of a unit that share any.

    ``cells``: ids, side, column (one or more fields that name a column of the unit), value.  An inverted index gives each
    value the columns that hold it; values held by the same columns are counted together before any pair is formed, so
    a value that stands everywhere costs no more than a rare one.  All values count; pairs without a common one are absent.
    Values meet by 64-bit hash.
    """
    held = cells.where(F.col("value").isNotNull()).select(
        *ids, (F.col("side") == "source").alias("is_src"), F.struct(*column).alias("c"), F.xxhash64("value").alias("v")
    ).distinct()
    size = held.groupBy(*ids, "is_src", "c").agg(F.count(F.lit(1)).alias("size"))
    of = lambda flag: F.array_sort(F.collect_list(F.when(flag, F.col("c"))))
    places = held.groupBy(*ids, "v").agg(of(F.col("is_src")).alias("s"), of(~F.col("is_src")).alias("g"))
    places = places.where((F.size("s") > 0) & (F.size("g") > 0)).groupBy(*ids, "s", "g").agg(F.count(F.lit(1)).alias("n"))
    pairs = places.select(*ids, F.explode("s").alias("s"), "g", "n").select(*ids, "s", F.explode("g").alias("g"), "n")
    pairs = pairs.groupBy(*ids, "s", "g").agg(F.sum("n").alias("shared"))
    side = lambda flag, c, n: size.where(F.col("is_src") == flag).select(*ids, F.col("c").alias(c), F.col("size").alias(n))
    pairs = pairs.join(side(True, "s", "source_values"), [*ids, "s"]).join(side(False, "g", "generated_values"), [*ids, "g"])
    overlap = F.col("shared") / (F.col("source_values") + F.col("generated_values") - F.col("shared"))
    named = [F.col(x)[c].alias(f"{x}_{c}") for x in ("s", "g") for c in column]
    return pairs.select(*ids, *named, "shared", "source_values", "generated_values", overlap.alias("overlap"))


def match_exact(src: DataFrame, gen: DataFrame, ids: list[str]) -> DataFrame:
    """Case-insensitive equal names: the last generated spelling wins, the first source column takes it."""
    s = src.groupBy(*ids, F.lower("col_name").alias("low")).agg(
        F.min_by("col_name", "col_idx").alias("source_col"), F.min("col_idx").alias("col_order")
    )
    g = gen.groupBy(*ids, F.lower("col_name").alias("low")).agg(F.max_by("col_name", "col_idx").alias("generated_col"))
    return s.join(g, [*ids, "low"]).select(
        *ids, "col_order", "source_col", "generated_col", F.lit("exact_name").alias("match_type"), F.lit(1.0).alias("confidence")
    )


def _greedy(sources: list, targets: list, label, share, accept: float, name_w: float, set_w: float):
    """Give every source, in order, the best unused target; earlier targets win ties.

    ``share(source, target)`` is the overlap of contents.  Targets that cannot beat the best score so far are
    skipped by upper bounds, which never changes the outcome.
    """
    used: set[int] = set()
    for one in sources:
        best, best_at, best_name = 0.0, -1, 0.0
        for at, other in enumerate(targets):
            if at in used:
                continue
            shared = share(one, other)
            floor = (best - set_w * shared) / name_w - 1e-9
            name = similarity(label(one), label(other), floor)
            score = name_w * name + set_w * shared
            if score > best:
                best, best_at, best_name = score, at, name
        if best_at >= 0 and best >= accept:
            used.add(best_at)
            yield one, targets[best_at], best, best_name


def pair_columns(sources: list[tuple], targets: list[tuple], overlaps: dict[tuple, float]) -> list[tuple]:
    """Mapping of one header in order: equal names first, then name and value similarity.  Columns are (index, name)."""
    sources, targets = sorted(sources), sorted(targets)
    spelling = {name.lower(): (at, name) for at, name in targets}
    rows, taken, done = [], set(), set()
    for at, name in sources:
        hit = spelling.get(name.lower())
        if hit is not None and hit not in taken:
            taken.add(hit)
            done.add(at)
            rows.append((at, name, *hit, "exact_name", 1.0))
    rest = [s for s in sources if s[0] not in done]
    free = [g for g in targets if g not in taken]
    share = lambda s, g: overlaps.get((s[0], g[0]), 0.0)
    for s, g, score, name in _greedy(rest, free, lambda c: c[1], share, COLUMN_MIN_SCORE, 0.6, 0.4):
        rows.append((*s, *g, "fuzzy_name" if name > 0.5 else "value_overlap", score))
    return [(n, *row) for n, row in enumerate(rows)]


def match_columns(columns: DataFrame, overlaps: DataFrame, ids: list[str]) -> DataFrame:
    """Column mapping of every table pair (``ids``), in mapping order.

    ``columns``: ids, side, col_idx, col_name; ``overlaps``: ids, s_idx, g_idx, overlap of their values.  A row of the Python
    step is the header of one table pair, never its cells; its size is bounded by the width of a sheet.
    """
    head = columns.groupBy(*ids).agg(F.collect_list(F.struct("side", "col_idx", "col_name")).alias("cols"))
    near = overlaps.groupBy(*ids).agg(F.collect_list(F.struct("s_idx", "g_idx", "overlap")).alias("near"))
    both = head.join(near, ids, "left")
    kinds = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    schema = ", ".join([*(f"{i} {kinds[i]}" for i in ids), *(f"{n} {t}" for n, t in MAPPING)])

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.to_dict("records"):
                pick = lambda side, r=r: [(int(c["col_idx"]), c["col_name"]) for c in r["cols"] if c["side"] == side]
                share = {(int(o["s_idx"]), int(o["g_idx"])): o["overlap"] for o in (r["near"] if r["near"] is not None else [])}
                rows += [(*[r[i] for i in ids], *m) for m in pair_columns(pick("source"), pick("generated"), share)]
            yield pd.DataFrame(rows, columns=[*ids, *(n for n, _ in MAPPING)])

    return both.mapInPandas(run, schema)


def match_tables(tables: DataFrame, case: str = "case_id") -> DataFrame:
    """Table pairing of every case: one row per table with its name, order and column names.

    ``tables``: case, side, sheet_idx, sheet, columns.  A group is the table list
    of one workbook, never its rows.
    """

    def share(one, other):
        both = len(one[1] | other[1])
        return len(one[1] & other[1]) / both if both else 0.0

    def pair_up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sheet_idx", "sheet"])
        side = lambda name: [(r["sheet"], set(r["columns"])) for r in pdf[pdf.side == name].to_dict("records")]
        found = list(_greedy(side("source"), side("generated"), lambda t: t[0], share, TABLE_MIN_SCORE, 0.3, 0.7))
        rows = [[pdf[case].iloc[0], s[0], g[0], score, i == 0] for i, (s, g, score, _) in enumerate(found)]
        return pd.DataFrame(rows, columns=[case, "source_sheet", "generated_sheet", "score", "is_first"])

    schema = f"{case} string, source_sheet string, generated_sheet string, score double, is_first boolean"
    return tables.groupBy(case).applyInPandas(pair_up, schema)


def map_columns(src: DataFrame, gen: DataFrame, row: str = "row_idx") -> DataFrame:
    """Column mapping of two wide tables, over all their values."""
    parts, headers = [], []
    for side, df in (("source", src), ("generated", gen)):
        names = [c for c in df.columns if c != row]
        order = F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(c), F.lit(i))])
        cells = unpivot_cells(df, [row]).withColumnRenamed("col", "col_name")
        parts.append(cells.select(F.lit("pair").alias("pair_id"), F.lit(side).alias("side"), order[F.col("col_name")].alias("col_idx"), "value"))
        headers += [("pair", side, i, c) for i, c in enumerate(names)]
    columns = src.sparkSession.createDataFrame(headers, "pair_id string, side string, col_idx int, col_name string")
    near = value_overlaps(parts[0].unionByName(parts[1]), ["pair_id"], ["col_idx"])
    near = near.select("pair_id", F.col("s_col_idx").alias("s_idx"), F.col("g_col_idx").alias("g_idx"), "overlap")
    found = match_columns(columns, near, ["pair_id"])
    return found.orderBy("ord").select("source_col", "generated_col", "match_type", "confidence")


def table_columns(cells: DataFrame, ids: list[str]) -> DataFrame:
    """Column names of every table of a long corpus."""
    return cells.select(*ids, "col_name").distinct().groupBy(*ids).agg(F.array_sort(F.collect_list("col_name")).alias("columns"))
