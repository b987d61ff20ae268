"""Case summaries from one row of numbers per case, and repeated runs merged without a sort."""

import itertools

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tablecheck.operators import scoring as so

SF_DIR = "/root/testdata/sf0.001"
RUNS = "case_id string, dim_idx int, run int, score int, status string"
BLENDS = "case_id string, detected string, blend map<string,double>"


def rows():
    """All pairs of a score and a status over the dimensions of a few cases; odd scores, runs without a number, repeated rows."""
    kinds = list(itertools.product([0, 1, 2, 3, 4, 7, None], ["success", "na", "error", "skipped", None]))
    out = [(f"c{i % 9}", (i * 3 + i // 9) % 8, (i % 4) or None, *kinds[(i * 11 + i // 35) % len(kinds)]) for i in range(400)]
    return out + [("zero", d, 1, s, "success") for d, s in enumerate([3, 4, 0, 1, 2, 2, 4, None])] + out[:40]


def cases():
    plain = [(f"c{i}", "general" if i % 2 else "unheard of", None) for i in range(7)]
    return [*plain, ("zero", "data_processing", {"template_form": 0.6, "mystery": 0.4}), ("zero", "financial_modeling", {"general": 1.0})]


def named(df):
    return df.withColumn("dimension", F.get(F.array(*[F.lit(d) for d in so.DIMENSIONS]), F.col("dim_idx")))


def test_wide_summary_equals_the_summary_of_reviews(spark):
    runs, blends = spark.createDataFrame(rows(), RUNS), spark.createDataFrame(cases(), BLENDS)
    dims = so.consistency_caps(so.merge_runs(named(runs), keep=["status"])).join(blends, "case_id", "left")
    dims = dims.withColumn("weight", so.blend_weight(F.col("dimension"), F.col("detected"), F.col("blend")))
    want = so.summarise(dims, score_columns=True)
    got = so.summarise_cases(so.merge_runs(runs, ["case_id", "dim_idx"], ["status_class"]), blends)
    plain = lambda df: sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*want.columns).collect()])
    assert plain(got) == plain(want)
    assert len(plain(got)) == 10 and max(r[12] for r in plain(got)) > 8  # "zero" has two rows of weights


def test_packed_runs_sort_like_structs(spark):
    rows = [(r, a, b) for r in (None, -(1 << 31), -1, 0, (1 << 31) - 1) for a in (None, -128, 0, 127) for b in (None, -1, 2)]
    df = spark.createDataFrame(rows, "run int, a tinyint, b tinyint").withColumn("packed", so._packed(["a", "b"]))
    by_pack = df.orderBy("packed").select("run", "a", "b", so._unpacked(F.col("packed"), ["a", "b"]).alias("back")).collect()
    assert [tuple(r)[:3] for r in by_pack] == [tuple(r)[:3] for r in df.orderBy(F.struct("run", "a", "b")).collect()]
    assert all(tuple(r.back) == tuple(r)[:3] for r in by_pack)


@pytest.mark.parametrize("name", ["agg_weighted_avg", "agg_status_lists", "s_batch_rank", "agg_regression_overall", "rep_summary", "agg_median_runs", "j_expected"])
def test_runs_are_hashed_not_sorted(spark, name):
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("SortAggregate", "Window", "BroadcastExchange"))
