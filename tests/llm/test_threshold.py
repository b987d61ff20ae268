"""The threshold of the quality model is read off every labelled document."""

import random

from pyspark.sql import functions as F

from tablecheck.llm import quality


def plain(scored):
    scored = sorted(scored)
    good, bad = sum(g for _, g in scored), sum(not g for _, g in scored)
    least, cut, lost, let_in = 1.0, scored[0][0], 0, bad
    for (here, kind), (after, _) in zip(scored, scored[1:], strict=False):
        lost, let_in = lost + kind, let_in - (not kind)
        if after > here and lost / good + let_in / bad < least:
            least, cut = lost / good + let_in / bad, (here + after) / 2
    return cut


def test_threshold_of_all_labels(spark):
    rnd = random.Random(7)
    rows = [(i, " ".join(rnd.choice("abcdefgh" if i % 3 else "efghijkl") for _ in range(60))) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    kinds = [(i, int((i % 3 > 0) ^ (rnd.random() < 0.2)), 0) for i in range(6000)]
    weights = [rnd.uniform(-1, 1) for _ in range(64)]
    scores = {r.doc_id: r.s for r in df.select("doc_id", quality.words(F.col("text")).alias("w")).select("doc_id", quality.score("w", weights).alias("s")).collect()}
    labels = spark.createDataFrame(kinds, "doc_id bigint, quality int, toxic int")
    assert quality.threshold(df, labels, weights) == plain([(scores[i], bool(q)) for i, q, _ in kinds])


def test_all_trusted_ids_count(spark):
    labels = spark.range(20_500).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert quality.trusted_ids(labels).count() == 20_500
