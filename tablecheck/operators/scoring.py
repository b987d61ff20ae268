"""From single reviews to case summaries: medians, caps, weights, averages, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablecheck.functions.replies import MAX_SCORE, NO_SCREEN_CAP

# Dimensions by block.
CONTENT_DIMS = ["data_accuracy", "completeness", "formula_logic", "relevance"]
STRUCTURE_DIMS = ["sheet_organization", "table_structure", "chart_appropriateness", "professional_formatting"]
DIMENSIONS = CONTENT_DIMS + STRUCTURE_DIMS
# Dimensions judged with screenshots; the first two are not judged without any.
VISUAL_REQUIRED = ["professional_formatting", "chart_appropriateness"]
VISUAL_WANTED = ["professional_formatting", "chart_appropriateness", "completeness"]
# Weight of each dimension (order as DIMENSIONS) per scenario.
WEIGHTS = {
    "reporting_analysis": [1.2, 1.2, 1.0, 1.0, 1.0, 1.0, 1.0, 0.6],
    "data_processing": [1.3, 1.0, 0.8, 1.0, 1.0, 1.2, 0.5, 0.5],
    "template_form": [1.0, 1.0, 1.2, 1.0, 1.0, 1.3, 0.5, 0.8],
    "planning_tracking": [1.0, 1.0, 1.0, 1.0, 1.0, 1.2, 0.5, 0.6],
    "financial_modeling": [1.3, 1.2, 1.3, 1.0, 1.0, 1.0, 0.5, 0.5],
    "comparison_evaluation": [1.0, 1.2, 0.8, 1.0, 1.0, 1.2, 0.8, 0.6],
    "general": [1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.6],
}
# USD per input and output token; the first name contained in the model name counts.
MODEL_PRICES = [
    ("claude-sonnet-4", 3.0e-6, 15.0e-6),
    ("claude-3-7-sonnet", 3.0e-6, 15.0e-6),
    ("claude-3-5-sonnet", 3.0e-6, 15.0e-6),
    ("claude-3-5-haiku", 0.8e-6, 4.0e-6),
    ("claude-3-haiku", 0.25e-6, 1.25e-6),
    ("claude-3-opus", 15.0e-6, 75.0e-6),
    ("claude-opus-4", 15.0e-6, 75.0e-6),
]
DEFAULT_PRICE = (3.0e-6, 15.0e-6)


def weights_table(spark: SparkSession) -> DataFrame:
    """The 56 default weights; callers may pass a table of their own instead."""
    rows = [(s, d, w) for s, ws in WEIGHTS.items() for d, w in zip(DIMENSIONS, ws)]
    return spark.createDataFrame(rows, "scenario string, dimension string, weight double")


def join_weights(df: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Weight of (scenario, dimension), 1.0 when unknown.

    The default table has 56 rows and is broadcast; a table given by the caller
    is joined as Spark sees fit.
    """
    w = F.broadcast(weights_table(df.sparkSession)) if weights is None else weights
    return df.join(w, ["scenario", "dimension"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def blended_weights(blends: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Weight per case and dimension.  ``blends``: case_id, detected, blend map.

    A blend replaces the detected scenario; its unknown scenarios add nothing.
    """
    shares = F.when(F.coalesce(F.size("blend"), F.lit(0)) > 0, F.col("blend")).otherwise(
        F.create_map(F.col("detected"), F.lit(1.0))
    )
    long = blends.select("case_id", F.explode(shares).alias("scenario", "share"))
    w = F.broadcast(weights_table(blends.sparkSession)) if weights is None else weights
    parts = long.join(w, "scenario").groupBy("case_id", "dimension")
    known = parts.agg(F.sum(F.col("weight") * F.col("share")).alias("weight"))
    return known


def blend_weight(dimension: Column, detected: Column, blend: Column, weights: dict[str, list[float]] = WEIGHTS) -> Column:
    """Blended weight of one dimension, without a join; ``weights`` lists a weight per dimension for each scenario."""
    table = F.create_map(*[
        F.lit(x) for s, ws in weights.items() for d, w in zip(DIMENSIONS, ws) for x in (f"{s}/{d}", w)
    ])
    weight = lambda scenario: F.element_at(table, F.concat(scenario, F.lit("/"), dimension))
    mixed = F.aggregate(
        F.map_entries(blend), F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(weight(e["key"]), F.lit(0.0))
    )
    return F.when(F.coalesce(F.size(blend), F.lit(0)) > 0, mixed).otherwise(F.coalesce(weight(detected), F.lit(1.0)))


def status_of(
    dimension: Column, skip: Column, applicable: Column, n_screens: Column, evaluated: Column
) -> Column:
    """Review status before any score: skipped, na, error for missing screenshots, else ``evaluated``."""
    return (
        F.when(F.array_contains(skip, dimension), "skipped")
        .when(F.coalesce(F.element_at(applicable, dimension) == False, F.lit(False)), "na")  # noqa: E712
        .when(dimension.isin(*VISUAL_REQUIRED) & (n_screens == 0), "error")
        .otherwise(evaluated)
    )


def visual_cap(dimension: Column, n_screens: Column, score: Column) -> Column:
    capped = dimension.isin(*VISUAL_WANTED) & (n_screens == 0) & (score > NO_SCREEN_CAP)
    return F.when(capped, NO_SCREEN_CAP).otherwise(score)


def model_price(model: Column) -> Column:
    """(input, output) price of a model name."""
    low = F.lower(model)
    price = lambda p: F.struct(F.lit(p[0]).alias("in_cost"), F.lit(p[1]).alias("out_cost"))
    out = F.when(F.contains(low, F.lit(MODEL_PRICES[0][0])), price(MODEL_PRICES[0][1:]))
    for name, *p in MODEL_PRICES[1:]:
        out = out.when(F.contains(low, F.lit(name)), price(p))
    return out.otherwise(price(DEFAULT_PRICE))


def cost_of(price: Column, tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in * price["in_cost"] + tokens_out * price["out_cost"]


SCORES = range(MAX_SCORE + 1)
RUN_COLS = ["status", "feedback", "input_tokens", "output_tokens", "latency_ms"]


def _packs(runs: DataFrame, present: list[str]) -> bool:
    """Whether a run and the columns of one byte beside it fit into one long."""
    kinds = dict(runs.dtypes)
    return kinds["run"] in ("tinyint", "smallint", "int") and len(present) <= 3 and all(kinds[c] == "tinyint" for c in present)


def _packed(present: list[str]) -> Column:
    """The run and its columns as one long that sorts like their struct, nulls first."""
    out = F.coalesce(F.col("run").cast("long"), F.lit(-(1 << 31) - 1))
    for c in present:
        out = F.shiftleft(out, 9) + F.coalesce(F.col(c).cast("long") + 129, F.lit(0))
    return out


def _unpacked(packed: Column, present: list[str]) -> Column:
    """The struct that was packed."""
    parts = []
    for c in reversed(present):
        part = packed.bitwiseAND(511)
        parts.append(F.when(part > 0, part - 129).cast("tinyint").alias(c))
        packed = F.shiftright(packed, 9)
    run = F.when(packed >= -(1 << 31), packed).cast("int").alias("run")
    return F.struct(run, *reversed(parts))


def merge_runs(runs: DataFrame, keys: list[str] = ["case_id", "dimension"], keep: list[str] = RUN_COLS) -> DataFrame:
    """Median over repeated runs with the representative run's other columns.

    Scores are 0-4, so five counts and the earliest run of each score are all an
    aggregate needs: the state of a review is bounded, combines before the
    shuffle, and gives the median, the nearest run and the list in the note.
    A score outside 0-4 is no score, and its run's status is ``error``.
    ``status_class`` may be kept instead of the status.  Where only the run or columns of one byte are kept, the state is
    numbers alone and is hashed; else runs are sorted.
    """
    valid = F.col("score").between(0, MAX_SCORE)
    if "status" in runs.columns:
        runs = runs.withColumn("status", F.when(F.col("score").isNotNull() & ~valid, "error").otherwise(F.col("status")))
    if "status_class" in keep and "status" in runs.columns:
        runs = runs.withColumn("status_class", status_class(F.col("status")))
    runs = runs.withColumn("score", F.when(valid, F.col("score")))
    present = [c for c in keep if c in runs.columns]
    packs = _packs(runs, present)
    one = _packed(present) if packs else F.struct("run", *present)
    counted = runs.groupBy(*keys).agg(
        *[F.count_if(F.col("score") == s).alias(f"_n{s}") for s in SCORES],
        *[F.min(F.when(F.col("score") == s, one)).alias(f"_p{s}") for s in SCORES],
        F.min(F.when(F.col("score").isNull(), one)).alias("_none"),
    )
    if packs:
        picks = [f"_p{s}" for s in SCORES] + ["_none"]
        counted = counted.withColumns({c: F.when(F.col(c).isNotNull(), _unpacked(F.col(c), present)) for c in picks})
    upto, seen = [], F.lit(0)
    for s in SCORES:
        seen = seen + F.col(f"_n{s}")
        upto.append(seen.alias(f"_u{s}"))
    counted = counted.select("*", *upto)
    total = F.col(f"_u{MAX_SCORE}")

    def at_rank(r: Column) -> Column:
        out = F.when(F.col("_u0") >= r, 0)
        for s in list(SCORES)[1:]:
            out = out.when(F.col(f"_u{s}") >= r, s)
        return out

    low, high = F.floor((total + 1) / 2), F.floor(total / 2) + 1
    counted = counted.withColumns({"_low": at_rank(low), "_high": at_rank(high)})
    median = F.when(total > 0, F.floor((F.col("_low") + F.col("_high")) / 2)).cast("int")
    counted = counted.withColumn("median", median)
    candidates = F.array(*[
        F.when(
            F.col(f"_n{s}") > 0,
            F.struct(
                F.abs(F.lit(s) - F.col("median")).alias("gap"), F.col(f"_p{s}.run").alias("run"), F.lit(s).alias("score"),
                F.col(f"_p{s}").alias("pick"),
            ),
        )
        for s in SCORES
    ])
    counted = counted.withColumn("best", F.array_min(candidates))
    counted = counted.withColumn("pick", F.coalesce("best.pick", "_none"))
    listed = F.array_join(F.flatten(F.array(*[F.array_repeat(F.lit(str(s)), F.col(f"_n{s}").cast("int")) for s in SCORES])), ", ")
    note = F.when(
        F.col("best.score") != F.col("median"),
        F.format_string(" [Median of %d runs: scores were [%s], median=%d]", total, listed, "median"),
    )
    values = {c: F.col("pick")[c] for c in present}
    if "feedback" in present:
        values["feedback"] = F.concat(F.coalesce(values["feedback"], F.lit("")), F.coalesce(note, F.lit("")))
    return counted.select(
        *keys,
        F.col("median").alias("score"),
        F.col("pick.run").alias("representative_run"),
        *[v.alias(c) for c, v in values.items()],
    )


def run_stability(runs: DataFrame, keys: list[str] = ["case_id", "dimension"]) -> DataFrame:
    return runs.groupBy(*keys).agg(
        F.count("score").alias("scored_runs"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
        (F.max("score") - F.min("score")).alias("swing"),
        F.stddev_pop("score").alias("spread"),
    )


def consistency_caps(dims: DataFrame, case: str = "case_id") -> DataFrame:
    """Completeness is at most 2 when data accuracy is 0, then data accuracy when formula logic is 0; a note says so at the end of the feedback.

    The window covers the eight reviews of one case.
    """
    w = Window.partitionBy(case)
    score_in = lambda d: F.max(F.when(F.col("dimension") == d, F.col("score"))).over(w)
    df = dims.withColumn("_da", score_in("data_accuracy")).withColumn("_fl", score_in("formula_logic"))
    cap_c = (F.col("dimension") == "completeness") & (F.col("_da") == 0) & (F.col("score") > 2)
    cap_d = (F.col("dimension") == "data_accuracy") & (F.col("_fl") == 0) & (F.col("score") > 2)
    reason = F.when(cap_c, "data accuracy is 0").when(cap_d, "formula logic is 0")
    note = F.format_string(" [Consistency adjustment: capped from %d to 2 because %s]", "score", reason)
    df = df.withColumn("cap_note", F.when(reason.isNotNull(), note))
    if "feedback" in df.columns:
        noted = F.concat(F.coalesce("feedback", F.lit("")), "cap_note")
        df = df.withColumn("feedback", F.when(F.col("cap_note").isNotNull(), noted).otherwise(F.col("feedback")))
    return (
        df
        .withColumn("score", F.when(F.col("cap_note").isNotNull(), 2).otherwise(F.col("score")))
        .drop("_da", "_fl")
    )


def _average(score: Column, weight: Column, keep: Column) -> Column:
    w = F.sum(F.when(keep, weight))
    return F.sum(F.when(keep, score * weight)) / F.nullif(w, F.lit(0.0))


def summarise(dims: DataFrame, case: list[str] = ["case_id"], score_columns: bool = False) -> DataFrame:
    """Weighted averages and status lists per case; ``dims`` carries score, status and weight.

    With ``score_columns`` every dimension's score is a column as well, from the same aggregate.
    """
    counted = F.col("score").isNotNull() & ~F.col("status").isin("skipped", "error")
    na = (F.col("status") != "skipped") & ~counted
    listed = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("dimension")))), ",")
    s, w, d = F.col("score"), F.col("weight"), F.col("dimension")
    wide = [F.max(F.when(d == x, s)).alias(x) for x in DIMENSIONS] if score_columns else []
    return dims.groupBy(*case).agg(
        *wide,
        _average(s, w, counted & d.isin(*CONTENT_DIMS)).alias("data_content_avg"),
        _average(s, w, counted & d.isin(*STRUCTURE_DIMS)).alias("structure_usability_avg"),
        _average(s, w, counted).alias("overall_weighted_avg"),
        F.count_if(counted).alias("dimensions_evaluated"),
        listed(na).alias("na_dimensions"),
        listed(d.isNotNull() & (F.col("status") == "skipped")).alias("skipped_dimensions"),
    )


#: Classes of statuses that a summary tells apart, numbered in the order of the names; any other status (even numbers) counts as evaluated.
ERROR, SKIPPED = 1, 3


def status_class(status: Column) -> Column:
    """Number of a status's class; sorts as the names do."""
    number = F.when(status < "error", 0).when(status == "error", ERROR).when(status < "skipped", 2).when(status == "skipped", SKIPPED)
    return number.when(status.isNotNull(), 4).cast("tinyint")


def case_weights(blends: DataFrame, weights: dict[str, list[float]] = WEIGHTS) -> DataFrame:
    """Blended weights of all dimensions per case, one row each with columns ``_w0`` to ``_w7``; ``_rows`` counts the rows of a case, whose weights add up."""
    table = F.create_map(*[x for s, ws in weights.items() for x in (F.lit(s), F.array(*[F.lit(w) for w in ws]))])
    of = lambda scenario, none: F.coalesce(F.element_at(table, scenario), F.array(*[F.lit(none)] * len(DIMENSIONS)))
    mixed = F.aggregate(
        F.map_entries("blend"), F.array(*[F.lit(0.0)] * len(DIMENSIONS)),
        lambda acc, e: F.zip_with(acc, of(e["key"], 0.0), lambda a, w: a + e["value"] * w),
    )
    one = F.when(F.coalesce(F.size("blend"), F.lit(0)) > 0, mixed).otherwise(of(F.col("detected"), 1.0))
    rows = blends.select("case_id", F.posexplode(F.array(one)).alias("_at", "_w"))  # evaluated once
    return rows.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(F.get("_w", F.lit(i))).alias(f"_w{i}") for i in range(len(DIMENSIONS))]
    )


def summarise_cases(reviews: DataFrame, blends: DataFrame) -> DataFrame:
    """:func:`summarise` of capped and weighted reviews, with a score column per dimension, from one row of numbers per case.

    ``reviews``: case_id, dim_idx (place in DIMENSIONS), score 0-4, status_class; one row per case and dimension.  ``blends`` as in
    :func:`case_weights`; a case without one has weights of 1.  A review travels as one small number, and neither a sort nor a window is needed.
    """
    places = range(len(DIMENSIONS))
    mark = F.coalesce(F.col("status_class").cast("int"), F.lit(5)) * 8 + F.coalesce("score", F.lit(7))
    wide = reviews.groupBy("case_id").agg(*[F.max(F.when(F.col("dim_idx") == i, mark)).alias(f"_m{i}") for i in places])
    both = wide.join(case_weights(blends).hint("merge"), "case_id", "left")
    both = both.select(
        "case_id", F.coalesce("_rows", F.lit(1)).alias("_rows"),
        *[F.nullif(F.col(f"_m{i}") % 8, F.lit(7)).alias(f"_s{i}") for i in places],
        *[F.shiftright(f"_m{i}", 3).alias(f"_c{i}") for i in places],
        *[F.when(F.col("_rows").isNull(), 1.0).otherwise(F.col(f"_w{i}")).alias(f"_w{i}") for i in places],
    )
    raw = {d: F.col(f"_s{i}") for i, d in enumerate(DIMENSIONS)}
    capped = raw | {
        "completeness": F.when((raw["data_accuracy"] == 0) & (raw["completeness"] > 2), 2).otherwise(raw["completeness"]),
        "data_accuracy": F.when((raw["formula_logic"] == 0) & (raw["data_accuracy"] > 2), 2).otherwise(raw["data_accuracy"]),
    }
    both = both.select("case_id", "_rows", *[c.alias(d) for d, c in capped.items()], *[f"_{x}{i}" for x in "cw" for i in places])
    kind = {d: F.col(f"_c{i}") for i, d in enumerate(DIMENSIONS)}
    weight = {d: F.col(f"_w{i}") for i, d in enumerate(DIMENSIONS)}
    evaluated = {d: kind[d].isin(0, 2, 4) for d in DIMENSIONS}
    counted = {d: F.col(d).isNotNull() & evaluated[d] for d in DIMENSIONS}
    total = lambda dims, value: sum((F.coalesce(F.when(counted[d], value(d)), F.lit(0.0)) for d in dims), F.lit(0.0))
    average = lambda dims: total(dims, lambda d: F.col(d) * weight[d]) / F.nullif(total(dims, lambda d: weight[d]), F.lit(0.0))
    listed = lambda cond: F.concat_ws(",", *[F.when(cond(d), d) for d in sorted(DIMENSIONS)])
    return both.select(
        "case_id", *DIMENSIONS,
        average(CONTENT_DIMS).alias("data_content_avg"),
        average(STRUCTURE_DIMS).alias("structure_usability_avg"),
        average(DIMENSIONS).alias("overall_weighted_avg"),
        (F.col("_rows") * sum((F.when(counted[d], 1).otherwise(0) for d in DIMENSIONS), F.lit(0))).alias("dimensions_evaluated"),
        listed(lambda d: (kind[d] == ERROR) | (evaluated[d] & F.col(d).isNull())).alias("na_dimensions"),
        listed(lambda d: kind[d] == SKIPPED).alias("skipped_dimensions"),
    )


def cost_summary(dims: DataFrame, case: list[str] = ["case_id"]) -> DataFrame:
    return dims.groupBy(*case).agg(
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
        F.max("latency_ms").alias("total_latency_ms"),
        F.sum("cost").alias("total_cost"),
    )


def cost_report(dims: DataFrame, case: list[str] = ["case_id"]) -> DataFrame:
    """Tokens, latency and cost of every dimension and, as dimension ``total``, of the case (its highest latency)."""
    parts = dims.select(*case, "dimension", "input_tokens", "output_tokens", "latency_ms", "cost")
    total = cost_summary(dims, case).select(
        *case, F.lit("total").alias("dimension"), F.col("total_input_tokens").alias("input_tokens"), F.col("total_output_tokens").alias("output_tokens"),
        F.col("total_latency_ms").alias("latency_ms"), F.col("total_cost").alias("cost"),
    )
    return parts.unionByName(total)


def applicability(dimension: Column, applicable: Column, reasons: Column) -> Column:
    """Whether a dimension applies to a case and, if not, why: struct of is_applicable and reason.  What is not mentioned applies."""
    applies = F.coalesce(F.element_at(applicable, dimension), F.lit(True))
    reason = F.when(~applies, F.coalesce(F.element_at(reasons, dimension), F.lit("")))
    return F.struct(applies.alias("is_applicable"), reason.alias("reason"))


def expected_check(score: Column, lo: Column, hi: Column, must_be_na: Column) -> Column:
    """Regression verdict of one dimension."""
    return (
        F.when(must_be_na & score.isNull(), "ok")
        .when(must_be_na, "expected N/A")
        .when(score.isNull(), "missing score")
        .when((score < lo) | (score > hi), "out of range")
        .otherwise("ok")
    )


def check_expected(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Actual scores beside expected ranges (case_id, dimension, lo, hi, is_na); neither side is broadcast."""
    out = expected.join(actual.select("case_id", "dimension", "score").hint("merge"), ["case_id", "dimension"], "left")
    verdict = expected_check(F.col("score"), F.col("lo"), F.col("hi"), F.col("is_na"))
    return out.withColumn("verdict", verdict)
