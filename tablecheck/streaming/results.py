"""Incremental scoring of replies that arrive as files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablecheck.functions.replies import parse_replies
from tablecheck.operators.rownum import first_per_key

REPLY_FILE_SCHEMA = "case_id string, dimension string, arrived timestamp, reply string"
KEYS = ["case_id", "dimension"]
#: Folders the stored reviews of a batch are spread over; a batch reads only those its own reviews fall into.
BUCKETS = 64


def reply_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(REPLY_FILE_SCHEMA).json(path)


def scored(replies: DataFrame) -> DataFrame:
    """Scored rows of replies (keys, reply, bucket)."""
    return parse_replies(replies).select(*KEYS, "ok", "score", "feedback", F.array_join("evidence", "\n").alias("evidence"), "bucket")


def _stored_keys(spark: SparkSession, out_dir: str, batch_id: int, buckets: list[int]) -> DataFrame | None:
    """Reviews that earlier batches have stored in these folders; none before the first batch."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(out_dir)
    if batch_id == 0 or not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    kept = spark.read.schema("case_id string, dimension string, batch bigint, bucket int").parquet(out_dir)
    return kept.where((F.col("batch") < batch_id) & F.col("bucket").isin(buckets)).select(*KEYS)


def run_available(replies: DataFrame, out_dir: str, checkpoint: str) -> list[dict]:
    """Score and store the replies that have arrived, each review once, and stop; a later call goes on where this one ended.

    Of the replies to one review the first to arrive counts (of those that arrive together, the smallest text).  What has been scored is
    known from the store itself: a batch is joined against the stored reviews of its own folders, so the stream keeps no state, however
    long it runs.  Every batch owns one folder and overwrites it when it is repeated, so a restart never doubles
    rows.  Returns the progress reports.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*KEYS), F.lit(BUCKETS)).cast("int"))
        buckets = [] if batch_id == 0 else [r.bucket for r in rows.select("bucket").distinct().collect()]  # BUCKETS at most
        known = _stored_keys(spark, out_dir, batch_id, buckets)
        fresh = rows if known is None else rows.join(known, KEYS, "left_anti")
        # dealt by folder once, with the texts alone: the first of a review is found, read and written where it lies
        first = first_per_key(fresh.repartition("bucket"), ["bucket", *KEYS], ["arrived", "reply"])
        scored(first).write.mode("overwrite").partitionBy("bucket").parquet(f"{out_dir}/batch={batch_id}")

    query = (
        replies.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return [dict(p) if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress]


def stored(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(out_dir).drop("batch", "bucket")
