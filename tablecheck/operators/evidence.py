"""Evidence items of reviews: numbering, verification, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablecheck.functions.replies import downgrade, let, needs_verification, parse_verdicts, sentiment_tag, verification_tag


def claim_numbers(evidence: Column) -> Column:
    """Items with their place and, for claims to verify, a number 1..k inside the review; every item is looked at once."""
    places = F.filter(F.transform(evidence, lambda x, i: F.when(needs_verification(x), i)), F.isnotnull)
    return let(
        F.struct(evidence.alias("items"), places.alias("claims")),
        lambda r: F.transform(
            r["items"],
            lambda x, i: F.struct(
                i.alias("pos"), x.alias("text"), F.nullif(F.array_position(r["claims"], i), F.lit(0)).cast("int").alias("claim_no")
            ),
        ),
    )


def verify(reviews: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Reviews with refuted claims downgraded.

    ``reviews``: keys, evidence.  ``verdicts``: keys, reply, one reply per
    review; both sides have one row per key, so a plain join cannot be skewed.  Neither side is broadcast: a size guessed before rows are multiplied
    would send every review through the driver.  Verdicts on numbers no claim carries are ignored; a claim without a
    verdict stays.
    """
    parsed = verdicts.select(*keys, parse_verdicts(F.col("reply")).alias("v"))
    refuted = F.transform(F.filter("v", lambda r: r["confirmed"] == F.lit(False)), lambda r: r["index"])
    parsed = parsed.select(*keys, refuted.alias("refuted"))
    both = reviews.join(parsed.hint("merge"), keys, "left")
    checked = F.transform(
        claim_numbers(F.col("evidence")),
        lambda x: F.when(
            F.coalesce(F.array_contains(F.col("refuted"), x["claim_no"]), F.lit(False)), downgrade(x["text"])
        ).otherwise(x["text"]),
    )
    return both.withColumn("evidence", checked).drop("refuted")


def evidence_stats(reviews: DataFrame) -> DataFrame:
    """Items by tone and verification tag."""
    items = reviews.select(F.explode_outer("evidence").alias("text")).where("text IS NOT NULL")
    return items.groupBy(
        sentiment_tag(F.col("text")).alias("sentiment"), verification_tag(F.col("text")).alias("verification")
    ).agg(F.count(F.lit(1)).alias("items"))


def downgrade_rate(reviews: DataFrame) -> DataFrame:
    """Share of claims that verification refuted."""
    items = reviews.select(F.explode_outer("evidence").alias("text")).select(verification_tag(F.col("text")).alias("tag"))
    refuted = F.count_if(F.col("tag") == "UNCONFIRMED")
    claims = F.count_if(F.col("tag").isin("UNCONFIRMED", "VERIFIED"))
    return items.agg(claims.alias("claims"), refuted.alias("downgraded"), (refuted / F.nullif(claims, F.lit(0))).alias("rate"))
