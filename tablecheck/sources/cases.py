"""Case descriptions, stored results, corpus indexes and result sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablecheck.session import ship_by_value

ship_by_value(__name__)

FILE_TYPE = "array<struct<path:string,description:string>>"
CASE_SCHEMA = (
    f"path string, id string, description string, prompt string, input_files {FILE_TYPE}, output_files {FILE_TYPE}, "
    "metadata map<string,string>, skip_dimensions array<string>, scenario string, error string"
)
COLUMNS = ["path", "id", "description", "prompt", "input_files", "output_files", "metadata", "skip_dimensions", "scenario", "error"]
SPREADSHEET_RE = r"\.(xlsx|xls|xlsm)$"


def _load(text: str) -> dict:
    import yaml

    return yaml.safe_load(text) or {}


def _files(raw) -> list[dict]:
    return [{"path": f.get("path"), "description": f.get("description") or ""} for f in raw or []]


def _case(path: str, text: str) -> dict:
    out = {**dict.fromkeys(COLUMNS), "path": path}
    try:
        raw = _load(text)
        out.update(
            id=str(raw["id"]),
            description=raw.get("description") or "",
            prompt=raw["prompt"],
            input_files=_files(raw.get("input_files")),
            output_files=_files(raw.get("output_files")),
            metadata={k: v if isinstance(v, str) else json.dumps(v) for k, v in (raw.get("metadata") or {}).items()},
            skip_dimensions=list(raw.get("skip_dimensions") or []),
            scenario=raw.get("scenario"),
        )
    except Exception as exc:
        out["error"] = f"{type(exc).__name__}: {exc}"
    return out


def load_cases(spark: SparkSession, root: str, pattern: str = "case.yaml") -> DataFrame:
    """All case descriptions below ``root`` in path order; unreadable ones carry an ``error``."""
    import yaml  # noqa: F401  # missing here, not in every case

    texts = spark.read.text(root, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
    texts = texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([_case(p, t) for p, t in zip(pdf.path, pdf.text)], columns=COLUMNS, dtype=object)

    return texts.orderBy("path").mapInPandas(parse, CASE_SCHEMA)  # the sort reads its input twice, so nothing is parsed before it


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored results; files or lines that are no valid JSON are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def remaining_cases(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Cases without a stored result."""
    return cases.join(results.select("case_id").distinct(), "case_id", "left_anti")


def write_results(df: DataFrame, path: str) -> None:
    """Append results as JSON, one object per case."""
    df.write.mode("append").json(path)


def json_report(df: DataFrame, out: str = "json") -> DataFrame:
    """One JSON object per row."""
    return df.select(F.to_json(F.struct("*")).alias(out))


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Report tables as JSON lines, CSV or parquet."""
    if fmt == "json":
        json_report(df).write.text(path)
    elif fmt == "csv":
        df.write.option("header", True).csv(path)
    else:
        df.write.parquet(path)


def has_spreadsheet(files: Column) -> Column:
    return F.exists(files, lambda f: F.lower(f).rlike(SPREADSHEET_RE))


def spreadsheet_files(files: Column, urls: Column) -> Column:
    """Spreadsheet deliverables with their addresses."""
    pairs = F.arrays_zip(files.alias("file"), urls.alias("url"))
    return F.filter(pairs, lambda p: F.lower(p["file"]).rlike(SPREADSHEET_RE))


def pair_files(listing: DataFrame) -> DataFrame:
    """Input and golden file of every task; incomplete tasks are left out.

    ``listing``: task, name.  The first file in name order counts, found by an
    aggregate instead of a self-join.
    """
    first = lambda end: F.min(F.when(F.endswith("name", F.lit(end)), F.col("name")))
    out = listing.groupBy("task").agg(first("_input.xlsx").alias("input_file"), first("_golden.xlsx").alias("golden_file"))
    out = out.where("input_file IS NOT NULL AND golden_file IS NOT NULL")
    stem = F.regexp_replace("input_file", r"_input\.xlsx$", "")
    return out.withColumn("error_type", F.regexp_replace(stem, r"^\d+_\d+_", ""))


def pair_steps(listing: DataFrame) -> DataFrame:
    """Steps of a project with their prompt; all steps share the project's golden file."""
    golden = listing.where(F.endswith("name", F.lit("_golden.xlsx"))).groupBy("task").agg(F.min("name").alias("golden_file"))
    stem = lambda end: F.regexp_replace("name", end + "$", "")
    inputs = listing.where(F.endswith("name", F.lit("_input.xlsx"))).withColumn("stem", stem(r"_input\.xlsx"))
    prompts = listing.where(F.endswith("name", F.lit("_prompt.txt"))).select("task", stem(r"_prompt\.txt").alias("stem"))
    totals = inputs.groupBy("task").agg(F.count(F.lit(1)).alias("total_steps"))
    step = F.regexp_extract("stem", r"^\d+_(\d+)_", 1).try_cast("int")
    company = F.regexp_replace(F.regexp_replace("golden_file", r"_golden\.xlsx$", ""), r"^[^_]*_", "")
    out = inputs.join(prompts.distinct(), ["task", "stem"]).join(golden, "task").join(totals, "task")
    out = out.select("task", F.col("name").alias("input_file"), "golden_file", step.alias("step"), company.alias("company"), "total_steps")
    return out.where("step IS NOT NULL")
