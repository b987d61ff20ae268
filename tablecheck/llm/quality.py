"""Quality by hashed n-gram log-likelihood ratio, with simple count rules before it; DataFrame functions only.

Words and pairs of neighbouring words are hashed into ``buckets`` classes. Two multinomials are counted: over the raw corpus
(all documents, whole texts) and over all trusted documents (labelled quality 1 and not toxic). The trusted one is smoothed towards the raw one: its prior holds as many n-grams as were
counted in it, dealt like the raw corpus. So a bucket's log ratio depends on shares alone, not on the
sizes of the two tables, and never falls below log(1/2). A document's score is the mean over its n-grams, so texts of any
length compare; it is kept when the score reaches the threshold, which ``threshold`` reads off all labelled documents
that the model has not been fitted on. The counts are sums per bucket, combined before the shuffle; the model is
one array of ``buckets`` doubles, whatever the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.llm.common import words
from tablecheck.operators.rownum import positions, running_sum
from tablecheck.session import cut_lineage

BUCKETS = 1 << 14
#: The threshold where labelled documents of both kinds are missing.
THRESHOLD = -0.25
#: Ids up to which a list of them is sent to every task; a longer one is joined by shuffle, with the same rows.
SENT = 1_000_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Repeated windows up to which a list is searched instead of sorted.
SOUGHT = 64
SYMBOLS = "[#*$%&|<>]"


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Distinct ids labelled quality 1 and not toxic."""
    return labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("trusted_id")).distinct()


def sent(ids: DataFrame) -> DataFrame:
    """``ids`` marked for a broadcast if it is short."""
    return F.broadcast(ids) if ids.limit(SENT + 1).count() <= SENT else ids


def grams(listed: str, buckets: int) -> Column:
    """Buckets of the words and of the pairs of neighbouring words in the array column ``listed``."""
    pairs = F.slice(listed, 1, F.greatest(F.lit(0), F.size(listed) - 1))
    bucket = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    return F.concat(F.transform(listed, lambda w: bucket(F.xxhash64(w))), F.transform(pairs, lambda w, i: bucket(F.xxhash64(w, F.get(listed, i + 1)))))


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """Log ratio by bucket; all zero where no trusted document has a word, zero where the corpus has nothing. ``buckets`` numbers reach the driver.

    Null and empty texts add nothing; a document labelled twice counts once, repeated rows count each; null ids are never trusted.
    """
    ids = sent(trusted_ids(labels))
    marked = docs.select("doc_id", words(F.col("text")).alias("words")).join(ids, F.col("doc_id") == F.col("trusted_id"), "left")
    rows = marked.select(F.col("trusted_id").isNotNull().cast("long").alias("trusted"), F.explode(grams("words", buckets)).alias("bucket"))
    counted = {r.bucket: (r.raw, r.target) for r in rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("trusted").alias("target")).collect()}
    raw, target = (sum(c[k] for c in counted.values()) for k in (0, 1))
    if not target:
        return [0.0] * buckets
    return [math.log((counted[b][1] / target * raw / counted[b][0] + 1) / 2) if b in counted else 0.0 for b in range(buckets)]


def threshold(docs: DataFrame, labels: DataFrame, weights: list[float]) -> float:
    """The score that parts all labelled documents (quality 1 and 0) with the fewest errors, both kinds weighing the same; of several the lowest.

    ``THRESHOLD`` if one kind is missing. An id with both labels counts as both. Documents are tallied by score and the tallies summed in
    the order of scores by slices, so no task and no driver holds them all.
    """
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").alias("judged_id"), (F.col("quality") == 1).alias("good")).distinct()
    rows = docs.select("doc_id", words(F.col("text")).alias("words")).filter(F.size("words") >= MIN_WORDS).join(sent(known), F.col("doc_id") == F.col("judged_id"))
    scored = rows.select("good", score("words", weights).alias("score"))
    tally = cut_lineage(scored.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")), "scores")
    total = tally.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.min("score").alias("least"), F.max("score").alias("most")).first()
    if not total.good or not total.bad:
        return THRESHOLD
    placed = running_sum(running_sum(positions(tally, "score"), [], "pos", "good", "lost"), [], "pos", "bad", "cast_out")
    errors = (F.col("lost") + F.col("good")) / F.lit(float(total.good)) + (total.bad - F.col("cast_out") - F.col("bad")) / F.lit(float(total.bad))
    here = placed.filter(F.col("score") < total.most).select("score", errors.alias("errors")).filter("errors < 1").orderBy("errors", "score").first()
    if here is None:
        return total.least
    return (here.score + tally.filter(F.col("score") > here.score).agg(F.min("score").alias("after")).first().after) / 2


def covered(places: Column) -> Column:
    """Words that 3-word windows at these ascending places (a column) cover."""
    reach = lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3)))
    return F.aggregate(F.transform(places, reach), F.lit(0).cast("long"), lambda n, k: n + k)


def measures(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; others are ignored): doc_id, words, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed. A null text is an empty one; repeated rows give repeated rows."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", "text", words(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    whole = F.slice("words", 1, F.greatest(F.lit(0), F.size("words") - 2))
    window = lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))
    rows = rows.select(
        "doc_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform(whole, window).alias("grams"),
    )
    ranked = rows.withColumn("ranked", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array("grams")))
    doubles = F.array_distinct(F.filter("ranked", lambda g, i: F.coalesce(g == F.get("ranked", i + 1), F.lit(False))))
    found = ranked.withColumn("twice", doubles)
    # places of the windows whose hash is in ``twice``, ascending: sought one by one, or by sorting where that list is long.
    # What a lambda looks into is a column of an earlier step, or it would be made again for every element.
    sorting = F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    found = found.withColumn("sorted", F.when(F.size("twice") > SOUGHT, sorting))
    same = lambda r, j: (r["g"] == F.get("sorted", j + 1)["g"]) | (r["g"] == F.get("sorted", j - 1)["g"])
    many = F.sort_array(F.transform(F.filter("sorted", lambda r, j: F.coalesce(same(r, j), F.lit(False))), lambda r: r["i"]))
    few = F.filter(F.sequence(F.lit(0), F.size("grams") - 1), lambda i: F.array_contains("twice", F.get("grams", i)))
    places = F.when(F.col("sorted").isNotNull(), many).when(F.size("twice") > 0, few)
    found = found.withColumn("places", places)
    rows = found.select(
        "doc_id",
        "words",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered(F.col("places")), F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def score(listed: str, weights: list[float]) -> Column:
    """Mean log ratio of the n-grams of an array of words; 0 where there are none."""
    # a literal array after constant folding
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    total = F.aggregate(grams(listed, len(weights)), F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    return F.when(F.size(listed) > 0, total / (2 * F.size(listed) - 1)).otherwise(0.0)


def judge(docs: DataFrame, weights: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """``measures`` with ``score`` (mean log ratio; 0 for a text without words) and ``kept`` (ties with the threshold are kept)."""
    rows = measures(docs).withColumn("score", score("words", weights))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).drop("words")
