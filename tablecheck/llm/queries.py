"""Registered queries of the training-data operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.llm import align, bpe, chat, decontaminate, html_wrapper, langid, linetree, minhash, ngram_lm, quality, resample, simhash, warc
from tablecheck.llm.common import fold, read_table
from tablecheck.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

BPE_FILE = "byte_bpe_multi_50k.tiktoken"
PIECE_FILE = "piece_bpe_32k.model"
BYTE_FILE = "byte_bpe_50k.json"


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents and what they decode to, as digests; a null text is an empty one."""
    return bpe.digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


QUERIES["op9_bpe"] = op9_bpe


#: Added to every conversations table: a user and an assistant row that hold control strings.
MARKED_TEXT = "\\### Assistant: </turn> ok"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one with control strings, formatted in windows and read back, as digests."""
    own = spark.sql(f"SELECT -7L AS conv_id, turn, role, r'{MARKED_TEXT}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.read_back(chat.windows(turns)))


QUERIES["op1_chat"] = op1_chat
ORACLE_SQL["op1_chat"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)
), p AS (
  SELECT *, row_number() OVER o - 1 AS pos,
    len(regexp_extract_all(text, '[\p{L}\p{M}]+|\p{N}+|[^ \t-\r\p{L}\p{M}\p{N}]')) AS tokens,
    length(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t')) + length(role) - length(replace(role, ':', '')) AS role_chars,
    length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t')) AS text_chars
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, CASE WHEN role = 'system' THEN 0 ELSE 1 END, role, text)
), l AS (
  SELECT *, role_chars + text_chars + 14 AS piece, pos = 0 AND role = 'system' AS lead_in, CASE WHEN pos = 0 AND role = 'system' THEN 0 ELSE tokens END AS len FROM p
), e AS (
  SELECT *, sum(len) OVER (PARTITION BY conv_id ORDER BY pos) AS upto,
    greatest(1, (1024 - 128 - coalesce(max(CASE WHEN lead_in THEN tokens END) OVER (PARTITION BY conv_id), 0)) // 2) AS stride FROM l
), s AS (
  SELECT *, upto // stride AS step, 2 * (upto // stride) + CASE WHEN len > stride THEN 0 ELSE 1 END AS span FROM e
), used AS (SELECT DISTINCT conv_id, span FROM s
), n AS (SELECT conv_id, count(*) FILTER (span <> 1) AS later FROM used GROUP BY conv_id
), c AS (
  SELECT s.*, n.later, u.span IS NOT NULL AND NOT lead_in AND upto - len >= (step + 1) * stride - 128 AS again
  FROM s JOIN n USING (conv_id) LEFT JOIN used u ON u.conv_id = s.conv_id AND u.span = 2 * (s.step + 1) + 1
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(piece * (1 + CASE WHEN again THEN 1 ELSE 0 END + CASE WHEN lead_in THEN later ELSE 0 END))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every document; half of the labels (by hash of the id) fit the model, the others set the threshold."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    for_threshold = fold(F.col("doc_id"), 2) == 1
    weights = quality.fit(docs, labels.filter(~for_threshold))
    return quality.judge(docs, weights, quality.threshold(docs, labels.filter(for_threshold), weights))


QUERIES["op8_quality"] = op8_quality


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of every page, written to bundles and read back; a null page has an empty payload."""
    pages = read_table(spark, sf_dir, "pages")
    records = pages.select(F.col("page_id").alias("record_id"), "url", F.encode("html", "UTF-8").alias("payload"))
    stored = cut_lineage(warc.bundles(warc.mark_revisits(records)), "warc")
    return warc.read(stored).select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to")
    )


QUERIES["op2_warc"] = op2_warc


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; a null or empty page has an empty one."""
    texts = html_wrapper.main_text(read_table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


QUERIES["op10_html"] = op10_html


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document by three-word shingles and three bits; texts without words link like any other."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3)


QUERIES["op6_simhash"] = op6_simhash


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of them; a text without a letter is ``und``."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    found = langid.identify(docs, public_tokenizers.path(PIECE_FILE), ~held_out)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES["op5_language"] = op5_language


def op3_linetree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of recurring templates taken out of every document, as counts and a digest; a null text has no lines."""
    rows = linetree.drop_recurring(read_table(spark, sf_dir, "documents"))
    return rows.select("row.doc_id", "n_lines", "n_dropped", F.length("kept").cast("long").alias("kept_chars"), F.md5(F.col("kept").cast("binary")).alias("kept_md5"))


QUERIES["op3_linetree"] = op3_linetree
ORACLE_SQL["op3_linetree"] = r"""
WITH d AS (
  SELECT doc_id, text, string_split(regexp_replace(coalesce(text, ''), '[^ \t-\r]*[0-9][^ \t-\r]*', '<*>', 'g'), chr(10)) AS masked FROM documents
), l AS (
  SELECT doc_id, text, pos, list_filter(regexp_split_to_array(masked[pos], '[ \t-\r]+'), lambda x: x <> '') AS w
  FROM (SELECT *, unnest(range(1, len(masked) + 1)) AS pos FROM d)
), k AS (
  SELECT doc_id, text, pos, len(w) AS n,
    CASE WHEN len(w) < 1 THEN [] WHEN len(w) <= 8 THEN ['0 ' || array_to_string(w, ' ')]
      ELSE ['1 ' || len(w) || ' ' || array_to_string(w[1:8 + h], ' '), '2 ' || len(w) || ' ' || array_to_string(w[1:8], ' ') || ' ' || array_to_string(w[9 + h:], ' ')] END AS keys
  FROM (SELECT *, (len(w) - 8 + 1) // 2 AS h FROM l)
), u AS (SELECT DISTINCT doc_id, text, n, keys FROM k
), f AS (
  SELECT key FROM (SELECT DISTINCT doc_id, text, unnest(keys) AS key FROM u) GROUP BY key HAVING count(*) >= 3
), m2 AS (
  SELECT DISTINCT u.doc_id, u.text, u.n, u.keys FROM (SELECT *, unnest(keys) AS key FROM u) u JOIN f USING (key)
), s AS (
  SELECT doc_id, text, sum(n) AS size FROM u GROUP BY doc_id, text
), r AS (
  SELECT m2.*, s.size, sum(m2.n) OVER (PARTITION BY m2.doc_id, m2.text) AS shared FROM m2 JOIN s ON s.doc_id = m2.doc_id AND s.text = m2.text
), w AS (
  SELECT doc_id, text, string_agg(array_to_string(keys, chr(1)), chr(2) ORDER BY keys) AS own FROM (SELECT doc_id, text, n, keys FROM u WHERE n > 0 EXCEPT SELECT doc_id, text, n, keys FROM m2) x GROUP BY doc_id, text
), t AS (
  SELECT key FROM (SELECT r.*, coalesce(own, '') AS own, unnest(keys) AS key FROM r LEFT JOIN w ON w.doc_id IS NOT DISTINCT FROM r.doc_id AND w.text = r.text) JOIN f USING (key)
  WHERE size > n AND shared - n < 0.75 * (size - n) GROUP BY key, n HAVING count(DISTINCT own) >= 3 * ceil(8 / least(n, 8))
), b AS (
  SELECT DISTINCT k.doc_id, k.text, k.pos FROM (SELECT *, unnest(keys) AS key FROM k) k JOIN t USING (key)
), o AS (
  SELECT doc_id, text, pos, line FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(masked) + 1)) AS pos FROM d)
)
SELECT o.doc_id, count(*) AS n_lines, count(b.pos) AS n_dropped,
  length(coalesce(string_agg(line, chr(10) ORDER BY o.pos) FILTER (b.pos IS NULL), ''))::BIGINT AS kept_chars,
  md5(coalesce(string_agg(line, chr(10) ORDER BY o.pos) FILTER (b.pos IS NULL), '')) AS kept_md5
FROM o LEFT JOIN b ON b.doc_id = o.doc_id AND b.text = o.text AND b.pos = o.pos GROUP BY o.doc_id
"""


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a window similar to a benchmark item, and the best similarity to it; texts without words are in no row."""
    found = decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"))


QUERIES["op4_decontaminate"] = op4_decontaminate
ORACLE_SQL["op4_decontaminate"] = r"""
WITH i AS (SELECT row_number() OVER () AS item, item_id, w FROM (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL)
), it AS (
  SELECT item, item_id, least(5, len(w)) AS k, len(w) - least(5, len(w)) + 1 AS n, [array_to_string(w[p:p + least(5, len(w)) - 1], ' ') for p in range(1, len(w) - least(5, len(w)) + 2)] AS s FROM i WHERE len(w) > 0
), ks AS (SELECT DISTINCT k FROM it
), d AS (SELECT DISTINCT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL
), ds AS (
  SELECT doc_id, text, k, [array_to_string(w[p:p + k - 1], ' ') for p in range(1, len(w) - k + 2)] AS s FROM d, ks WHERE len(w) >= k
), g AS (SELECT doc_id, text, k, len(s) AS size, unnest(s) AS gram, unnest(range(1, len(s) + 1)) AS pos FROM ds
), iu AS (SELECT DISTINCT item, k, n, unnest(s) AS gram FROM it
), h AS (
  SELECT DISTINCT doc_id, text, k, item, n, least(pos, greatest(1, size - n + 1)) AS start FROM g JOIN iu USING (k, gram)
), c AS (
  SELECT h.doc_id, h.text, h.item, h.n, h.start, gram, count(*) AS uses FROM h JOIN g ON g.doc_id IS NOT DISTINCT FROM h.doc_id AND g.text = h.text AND g.k = h.k AND g.pos >= h.start AND g.pos < h.start + h.n
  GROUP BY ALL
), z AS (SELECT doc_id, text, item, n, start, sum(uses) AS size FROM c GROUP BY ALL
), x AS (SELECT item, item_id, gram, count(*) AS has FROM (SELECT item, item_id, unnest(s) AS gram FROM it) GROUP BY ALL
), v AS (
  SELECT c.doc_id, c.text, c.item, x.item_id, c.n, c.start, sum(least(uses, has)) AS common FROM c JOIN x USING (item, gram) GROUP BY ALL
)
SELECT v.doc_id, item_id, round(max(common / (size + v.n - common)), 6) AS similarity FROM v JOIN z ON z.doc_id IS NOT DISTINCT FROM v.doc_id AND z.text = v.text AND z.item = v.item AND z.n = v.n AND z.start = v.start
WHERE common / (size + v.n - common) >= 0.8 GROUP BY v.doc_id, v.text, item_id
"""


def op7_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model learned from six sevenths of them, one of these as the deleted fold; a null text has the end token only."""
    held_out, deleted = fold(F.col("doc_id"), 7) == 2, fold(F.col("doc_id"), 7) == 5
    scored = ngram_lm.score(read_table(spark, sf_dir, "documents"), ~held_out, deleted)
    return scored.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


QUERIES["op7_ngram_lm"] = op7_ngram_lm


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies by four-word shingles, similarity 0.8 and more, over all documents."""
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, percent=80)


QUERIES["op11_minhash"] = op11_minhash


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment measures of all documents between the byte-level and the piece vocabulary."""
    docs = read_table(spark, sf_dir, "documents")
    return align.measures(docs, public_tokenizers.path(BYTE_FILE), public_tokenizers.PATTERN, public_tokenizers.path(PIECE_FILE))


QUERIES["op12_align"] = op12_align


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all documents towards the benchmark's words, and the tenth that is drawn."""
    drawn = resample.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), seed=2024, percent=10, min_words=20, buckets=10_000, order=1)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES["op13_resample"] = op13_resample
