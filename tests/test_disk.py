"""What queries leave on disk and how their rows are dealt."""

from pathlib import Path

import __spark_entry__ as entry
from tablecheck.session import scratch_root


def orders(spark, folder):
    spark.range(1, 41).selectExpr("id AS o_orderkey").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_replies_wait_compressed(spark, tmp_path):
    got = entry.queries()["stream_results"](spark, orders(spark, tmp_path))
    assert got.count() == 40 * 8 == got.select("case_id", "dimension").distinct().count()
    inbox = max(Path(scratch_root(spark).removeprefix("file:")).glob("stream-*/in"), key=lambda p: p.stat().st_mtime)
    files = [p.name for p in inbox.glob("part-*")]
    assert files and all(name.endswith(".json.gz") for name in files)


def test_runs_meet_their_cases_unsorted(spark, tmp_path):
    df = entry.queries()["p_visual_cap"](spark, orders(spark, tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort " not in plan and "Broadcast" not in plan
    assert df.count() == 40 * 24
