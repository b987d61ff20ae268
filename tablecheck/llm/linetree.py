"""Line dedup by a log-template tree, with DataFrame functions only.

A line is parsed at fixed depth: its token count, then its first ``DEPTH`` tokens, then the rest in two halves. Tokens
with a digit are variable fields (``<*>``) from the start; below the leading tokens one half may differ as well. So a
line has two templates, each with one half left open (lines of ``DEPTH`` tokens or fewer have one), and lines that
agree in count, leading tokens and either half share a template.

A template recurs when lines of it stand in at least ``MIN_DOCS`` documents with different text of their own (lines of no frequent
template), more for lines shorter than ``DEPTH``, in proportion: a short line recurs by chance. Of the rest of such a document less than
``MAX_SHARED`` may be lines of frequent templates, so a page that is mostly boilerplate counts, and one with equal
own text counts once. Copies of a document, which share more, do not turn its lines into templates; they are left to near-duplicate
removal. Lines of recurring templates are dropped from every document.

Only hashes travel. The counts are combined before the shuffle; lines of frequent templates are the only ones that are
joined, against a written table which Spark broadcasts when it is small and AQE balances when not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.llm.common import WORD_SEPARATOR
from tablecheck.session import cut_lineage

DEPTH, MIN_TOKENS, MIN_DOCS, MAX_SHARED = 8, 1, 3, 0.75
VARIABLE = "[^ \\t-\\r]*[0-9][^ \\t-\\r]*"


def templates(tokens: Column, depth: int = DEPTH, min_tokens: int = MIN_TOKENS) -> Column:
    """Template hashes of one line's masked tokens: none, one or two."""
    n = F.size(tokens)
    half = F.ceil((n - depth) / 2).cast("int")
    lead = F.slice(tokens, 1, depth)
    front = F.slice(tokens, depth + 1, F.greatest(F.lit(0), half))
    back = F.slice(tokens, F.lit(depth + 1) + F.greatest(F.lit(0), half), F.greatest(F.lit(0), n - depth - half))
    none = F.array().cast("array<bigint>")
    return (
        F.when(n < min_tokens, none)
        .when(n <= depth, F.array(F.xxhash64(n, lead)))
        .otherwise(F.array(F.xxhash64(n, lead, F.lit(1), front), F.xxhash64(n, lead, F.lit(2), back)))
    )


def masked_lines(text: Column) -> Column:
    """Tokens of every line of a text (split at line feeds), tokens with a digit as ``<*>``."""
    masked = F.regexp_replace(F.coalesce(text, F.lit("")), VARIABLE, "<*>")
    return F.transform(F.split(masked, "\n"), lambda line: F.array_remove(F.split(line, WORD_SEPARATOR), ""))


def parsed(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """doc_id, text_hash, size (tokens), lines (distinct templates with the tokens of their line), mark (of all lines with a token)."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), masked_lines(F.col("text")).alias("lines"))
    line = lambda tokens: F.struct(templates(tokens, depth, min_tokens).alias("keys"), F.size(tokens).alias("size"))
    return rows.select("doc_id", "text_hash", F.array_distinct(F.transform("lines", line)).alias("lines")).withColumn(
        "size", F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + x["size"])
    ).withColumn("mark", _mark(F.filter("lines", lambda x: x["size"] > 0), lambda x: F.xxhash64(x["keys"])))


def _mark(lines: Column, hashed) -> Column:
    """One number for a set of lines: what is left when a part of them is taken out by the same operation marks the others."""
    return F.aggregate(lines, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(hashed(x)))


def recurring(docs: DataFrame, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, max_shared: float = MAX_SHARED) -> tuple[DataFrame, DataFrame]:
    """The recurring templates (template, documents), and doc_id, text_hash, dropped (array of templates) of the documents that have any.

    Null and empty texts and blank lines have no template. Ties do not matter: a template recurs or not. An empty table gives two empty ones.
    """
    rows = cut_lineage(parsed(docs, depth, min_tokens), "line-parsed")  # texts are parsed once; hashes are small
    every = rows.select(F.explode(F.array_distinct(F.flatten("lines.keys"))).alias("template"))
    frequent = cut_lineage(every.groupBy("template").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).select("template"), "line-frequent")
    apart = rows.select("doc_id", "text_hash", "size", "mark", F.posexplode("lines").alias("line", "at")).select(
        "doc_id", "text_hash", "size", "mark", F.col("at.size").alias("tokens"), F.xxhash64("at.keys").alias("line"), F.explode("at.keys").alias("template")
    )
    # a document's frequent lines: bounded by the document itself
    marked = apart.join(frequent, "template").groupBy("doc_id", "text_hash", "size", "mark").agg(
        F.collect_set(F.struct("line", "tokens")).alias("shared"), F.collect_set(F.struct("line", "tokens", "template")).alias("at")
    )
    own = F.col("mark").bitwiseXOR(_mark(F.col("shared"), lambda x: x["line"]))
    marked = marked.withColumn("own", own).withColumn("shared", F.aggregate("shared", F.lit(0).cast("long"), lambda n, x: n + x["tokens"])).drop("mark")
    marked = cut_lineage(marked, "line-marked")
    uses = marked.select("own", "size", "shared", F.explode("at").alias("at")).select("own", "at.template", "at.tokens", "size", "shared")
    alone = (F.col("size") > F.col("tokens")) & (F.col("shared") - F.col("tokens") < max_shared * (F.col("size") - F.col("tokens")))
    apart = uses.filter(alone).select("template", "tokens", "own").distinct()
    needed = min_docs * F.ceil(F.lit(depth) / F.least("tokens", F.lit(depth)))
    counts = apart.groupBy("template", "tokens").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") >= needed).drop("tokens")
    found = cut_lineage(counts, "line-templates")
    hits = marked.select("doc_id", "text_hash", F.explode("at.template").alias("template")).join(found.select("template"), "template")
    return found, hits.groupBy("doc_id", "text_hash").agg(F.collect_set("template").alias("dropped"))


def drop_recurring(docs: DataFrame, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, max_shared: float = MAX_SHARED) -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, text, any others) as ``row``, with ``kept`` (the text without lines of recurring templates),
    ``n_lines`` and ``n_dropped``.

    A null text stays null and has no lines; an empty text has one empty line. Lines of fewer than
    ``min_tokens`` tokens are never dropped. Repeated rows count as often as they stand when frequent templates are sought, and once after that; they
    get the same result. A null doc_id is an id like any other. Line feeds between kept lines stay.
    """
    _, hits = recurring(docs, depth, min_tokens, min_docs, max_shared)
    hits = hits.withColumnRenamed("doc_id", "hit_id").withColumnRenamed("text_hash", "hit_hash")
    rows = docs.select(F.struct("*").alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("row.text") == F.col("hit_hash"))
    joined = rows.join(hits, same, "left").select("row", "dropped")
    lines = F.split("row.text", "\n")
    keys = F.transform(masked_lines(F.col("row.text")), lambda tokens: templates(tokens, depth, min_tokens))
    joined = joined.withColumn("lines", F.when(F.col("dropped").isNotNull(), F.arrays_zip(lines.alias("line"), keys.alias("keys"))))
    left = F.filter("lines", lambda x: ~F.arrays_overlap(x["keys"], F.col("dropped")))
    joined = joined.withColumn("left", left)
    return joined.select(
        "row",
        F.when(F.col("dropped").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform("left", lambda x: x["line"]), "\n")).alias("kept"),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("left"), F.lit(0)).cast("long").alias("n_dropped"),
    )
