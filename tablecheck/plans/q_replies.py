"""Queries over reviewer replies and their evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecheck.functions import replies as rp, scenario as sc
from tablecheck.operators import evidence as ev
from tablecheck.plans.fixtures import SCENARIOS, fixture, with_fixtures
from tablecheck.plans.registry import query, table

KEYS = ["case_id", "dimension"]
_WS = "' ' || chr(9) || chr(10) || chr(13)"
_FENCE = r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```"
_STRIP = f"trim(CASE WHEN regexp_matches(reply, '{_FENCE}') THEN regexp_extract(reply, '{_FENCE}', 1) ELSE reply END, {_WS})"
_KNOWN = "(" + ", ".join(f"'{s}'" for s in SCENARIOS) + ")"
_P = with_fixtures("f8") + f"""
, t AS (SELECT *, {_STRIP} AS body FROM f8)
, j AS (SELECT *, CASE WHEN json_valid(body) THEN body END AS js FROM t)
, s AS (SELECT *, json_extract_string(js, '$.score') AS raw, try_cast(json_extract_string(js, '$.score') AS INT) AS sc FROM j)
, parsed AS (SELECT case_id, dimension, dim_idx, k, stop_reason, reply, ok, CASE WHEN ok THEN sc END AS score,
      CASE WHEN ok THEN coalesce(json_extract_string(js, '$.feedback'), '') END AS feedback,
      CASE WHEN ok THEN CASE WHEN json_type(js, '$.evidence') = 'ARRAY' THEN CAST(json_extract(js, '$.evidence') AS VARCHAR[])
           WHEN json_extract_string(js, '$.evidence') IS NOT NULL THEN [json_extract_string(js, '$.evidence')] ELSE [] END END AS evidence
      FROM (SELECT *, js IS NOT NULL AND (raw IS NULL OR coalesce(sc BETWEEN 0 AND 4, false)) AS ok FROM s) x)
, items AS (SELECT case_id, dimension, pos - 1 AS pos, evidence[pos] AS text FROM (
      SELECT case_id, dimension, evidence, unnest(generate_series(1, len(evidence))) AS pos FROM parsed) y)
, claims AS (SELECT *, CASE WHEN is_claim THEN CAST(sum(CAST(is_claim AS INT)) OVER (PARTITION BY case_id, dimension ORDER BY pos) AS INT) END AS claim_no
      FROM (SELECT *, contains(upper(text), 'VERIFIED') AND NOT contains(upper(text), 'INFERRED') AS is_claim FROM items) z)
"""
_V = ", f8_verdicts AS (" + with_fixtures("f8_verdicts").split("AS (", 1)[1].rstrip()[:-1] + ")"
_VERIFIED = _P + _V + """
, vj AS (SELECT case_id, dimension, CAST(CASE WHEN starts_with(reply, '[') THEN reply ELSE json_extract(reply, '$.results') END AS JSON) AS arr FROM f8_verdicts)
, refuted AS (SELECT case_id, dimension, CAST(json_extract(arr, '$[' || i || '].index') AS INT) AS claim_no
      FROM (SELECT *, unnest(generate_series(0, CAST(json_array_length(arr) AS BIGINT) - 1)) AS i FROM vj) q
      WHERE CAST(json_extract(arr, '$[' || i || '].confirmed') AS BOOLEAN) = false)
, verified AS (SELECT c.case_id, c.dimension, c.pos, CASE WHEN r.claim_no IS NULL THEN c.text ELSE regexp_replace(c.text, '(?i)VERIFIED', 'UNCONFIRMED', 'g') END AS text
      FROM claims c LEFT JOIN refuted r USING (case_id, dimension, claim_no))
"""


def parsed(spark, sf):
    return rp.parse_replies(fixture(spark, sf, "f8"))


def sound(spark, sf):
    return rp.sound_replies(fixture(spark, sf, "f8"))


def items(reviews):
    """Evidence items with their place.  The outer form spares a second evaluation as a filter."""
    long = reviews.select(*KEYS, F.posexplode_outer("evidence").alias("pos", "text"))
    return long.where("pos IS NOT NULL")


def verified(spark, sf):
    reviews = parsed(spark, sf).select(*KEYS, "evidence")
    return ev.verify(reviews, fixture(spark, sf, "f8_verdicts"), KEYS)


@query("f_strip_fences", with_fixtures("f8") + f"SELECT case_id, dimension, {_STRIP} AS body FROM f8")
def f_strip_fences(spark, sf):
    return fixture(spark, sf, "f8").select(*KEYS, rp.strip_fences(F.col("reply")).alias("body"))


@query("f_parse_reply", _P + "SELECT case_id, dimension, ok, score, feedback, array_to_string(evidence, '|') AS evidence FROM parsed")
def f_parse_reply(spark, sf):
    """Score, feedback and evidence of every reply."""
    return parsed(spark, sf).select(*KEYS, "ok", "score", "feedback", F.array_join("evidence", "|").alias("evidence"))


@query("p_score_valid", _P + "SELECT case_id, dimension, CASE WHEN ok THEN 'success' ELSE 'error' END AS status FROM parsed")
def p_score_valid(spark, sf):
    return parsed(spark, sf).select(*KEYS, F.when(F.col("ok"), "success").otherwise("error").alias("status"))


@query("p_truncated_reply", with_fixtures("f8") + "SELECT case_id, dimension FROM f8 WHERE stop_reason = 'max_tokens' AND NOT json_valid(reply)")
def p_truncated_reply(spark, sf):
    return fixture(spark, sf, "f8").where(rp.truncated_reply(F.col("stop_reason"), F.col("reply"))).select(*KEYS)


@query("p_feedback_incomplete", _P + """
SELECT case_id, dimension, score IS NOT NULL AND stop_reason <> 'max_tokens' AND (length(feedback) < 100
       OR NOT regexp_matches(rtrim(feedback), '[。！？.!?）)」】》}\\]"'']$')) AS incomplete FROM parsed WHERE ok""")
def p_feedback_incomplete(spark, sf):
    flag = rp.feedback_incomplete(F.col("score"), F.col("feedback"), F.col("stop_reason"))
    return sound(spark, sf).select(*KEYS, flag.alias("incomplete"))


_S = with_fixtures("f8_scenario") + f"""
, t AS (SELECT *, {_STRIP} AS body FROM f8_scenario)
, j AS (SELECT *, CASE WHEN json_valid(body) THEN body END AS js FROM t)
, r AS (SELECT case_id, k, prompt, override_src, js, json_extract_string(js, '$.scenario') AS sc, CAST(json_extract_string(js, '$.confidence') AS DOUBLE) AS cf,
        json_extract_string(js, '$.reasoning') AS reasoning, lower(prompt) AS lp,
        CAST(json_extract(js, '$.applicable_dimensions.chart_appropriateness') AS BOOLEAN) AS chart_ok FROM j)
, f AS (SELECT *, CASE WHEN coalesce(sc IN {_KNOWN}, false) THEN coalesce(cf, 0) ELSE 0 END AS confidence,
        CASE WHEN coalesce(sc IN {_KNOWN}, false) AND cf >= 0.7 THEN sc ELSE 'general' END AS detected,
        regexp_matches(lp, 'macro|vba') AND NOT regexp_matches(lp, 'formula|sumif|vlookup|index|match|countif|sumproduct|xlookup|filter\\(|=if\\(') AS macro_only FROM r)
"""


def _raw(spark, sf):
    return fixture(spark, sf, "f8_scenario").withColumn("raw", sc.parse_scenario(F.col("reply")))


@query("f_parse_scenario", _S + "SELECT case_id, sc AS scenario, confidence, reasoning, chart_ok FROM f")
def f_parse_scenario(spark, sf):
    raw = F.col("raw")
    return _raw(spark, sf).select("case_id", raw["scenario"].alias("scenario"), sc.confidence_of(raw).alias("confidence"),
                                  raw["reasoning"].alias("reasoning"), F.element_at(raw["applicable_dimensions"], "chart_appropriateness").alias("chart_ok"))


@query("f_confidence_fallback", _S + "SELECT case_id, detected FROM f")
def f_confidence_fallback(spark, sf):
    """Unknown or uncertain scenarios become general."""
    return _raw(spark, sf).select("case_id", sc.detected_of(F.col("raw")).alias("detected"))


@query("f_blend_normalise", _S + f"""
, b AS (SELECT case_id, key, CAST(json_extract(js, '$.blend."' || key || '"') AS DOUBLE) AS v
        FROM (SELECT case_id, js, unnest(json_keys(js, '$.blend')) AS key FROM f WHERE json_type(js, '$.blend') = 'OBJECT') x)
, n AS (SELECT case_id, string_agg(key || '=' || CAST(CAST(round(v / tot * 1000) AS INT) AS VARCHAR), ',' ORDER BY key) FILTER (WHERE key IN {_KNOWN}) AS shares
        FROM (SELECT *, sum(v) OVER (PARTITION BY case_id) AS tot FROM b) y GROUP BY case_id)
SELECT case_id, coalesce(shares, detected || '=1000') AS shares FROM f LEFT JOIN n USING (case_id)""")
def f_blend_normalise(spark, sf):
    """Blend shares in thousandths; without a usable blend the detected scenario counts fully."""
    blend = sc.normalise_blend(F.col("raw")["blend"], sc.detected_of(F.col("raw")))
    part = F.transform(F.map_entries("blend"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 1000).cast("int").cast("string")))
    return _raw(spark, sf).select("case_id", blend.alias("blend")).select("case_id", F.array_join(F.array_sort(part), ",").alias("shares"))


@query("p_vba_override", _S + "SELECT case_id, macro_only AS switched_off, CASE WHEN macro_only THEN false END AS formula_logic FROM f WHERE js IS NOT NULL")
def p_vba_override(spark, sf):
    """Macro-only prompts switch formula_logic off."""
    app = sc.applicable_of(F.col("raw"), F.col("prompt"))
    df = _raw(spark, sf).where("raw.scenario IS NOT NULL")
    return df.select("case_id", rp.macro_only(F.col("prompt")).alias("switched_off"), F.element_at(app, "formula_logic").alias("formula_logic"))


@query("f_manual_scenario", _S + f"""
SELECT case_id, CASE WHEN ov IN {_KNOWN} THEN ov ELSE detected END AS scenario, CASE WHEN ov IN {_KNOWN} THEN 1.0 ELSE confidence END AS confidence
FROM (SELECT *, CASE k % 3 WHEN 0 THEN override_src WHEN 1 THEN 'bogus' END AS ov FROM f) x""")
def f_manual_scenario(spark, sf):
    """A valid manual scenario wins, an unknown one is ignored."""
    df = _raw(spark, sf).withColumn("ov", F.when(F.col("k") % 3 == 0, F.col("override_src")).when(F.col("k") % 3 == 1, "bogus"))
    scen, conf = sc.apply_override(F.col("ov"), sc.detected_of(F.col("raw")), sc.confidence_of(F.col("raw")))
    return df.select("case_id", scen.alias("scenario"), conf.alias("confidence"))


@query("f_parse_verify", with_fixtures("f8_verdicts") + """
, vj AS (SELECT case_id, dimension, CAST(CASE WHEN starts_with(reply, '[') THEN reply ELSE json_extract(reply, '$.results') END AS JSON) AS arr FROM f8_verdicts)
SELECT case_id, dimension, CAST(json_extract(arr, '$[' || i || '].index') AS INT) AS idx, CAST(json_extract(arr, '$[' || i || '].confirmed') AS BOOLEAN) AS confirmed,
       json_extract_string(arr, '$[' || i || '].reason') AS reason
FROM (SELECT *, unnest(generate_series(0, CAST(json_array_length(arr) AS BIGINT) - 1)) AS i FROM vj) q""")
def f_parse_verify(spark, sf):
    """Verdicts from wrapped or bare lists."""
    v = fixture(spark, sf, "f8_verdicts").select(*KEYS, F.inline(rp.parse_verdicts(F.col("reply"))))
    return v.withColumnRenamed("index", "idx")


@query("w_evidence_renumber", _P + "SELECT case_id, dimension, pos, text, claim_no FROM claims")
def w_evidence_renumber(spark, sf):
    """Claims to verify numbered 1..k inside their review."""
    claims = parsed(spark, sf).select(*KEYS, F.inline_outer(ev.claim_numbers(F.col("evidence"))))
    return claims.where("pos IS NOT NULL")


@query("j_verify", _VERIFIED + "SELECT case_id, dimension, pos, text FROM verified")
def j_verify(spark, sf):
    """Evidence after verification, item by item."""
    return items(verified(spark, sf))


@query("f_downgrade", _P + "SELECT case_id, dimension, pos, regexp_replace(text, '(?i)VERIFIED', 'UNCONFIRMED', 'g') AS text FROM claims WHERE is_claim")
def f_downgrade(spark, sf):
    """Wording of a refuted claim."""
    return items(parsed(spark, sf)).where(rp.needs_verification(F.col("text"))).withColumn("text", rp.downgrade(F.col("text")))


_TAGS = """CASE WHEN starts_with(trim(text), '+') THEN 'good' WHEN starts_with(trim(text), '-') THEN 'bad' ELSE 'neutral' END AS sentiment,
CASE WHEN contains(upper(text), 'UNCONFIRMED') THEN 'UNCONFIRMED' WHEN contains(upper(text), 'INFERRED') THEN 'INFERRED'
     WHEN contains(upper(text), 'VERIFIED') THEN 'VERIFIED' ELSE 'NONE' END AS verification"""


@query("agg_evidence_stats", _VERIFIED + f"SELECT sentiment, verification, count(*) AS items FROM (SELECT {_TAGS} FROM verified) t GROUP BY ALL")
def agg_evidence_stats(spark, sf):
    return ev.evidence_stats(verified(spark, sf))


@query("agg_downgrade_rate", _VERIFIED + f"""
SELECT count(*) FILTER (WHERE verification IN ('UNCONFIRMED', 'VERIFIED')) AS claims, count(*) FILTER (WHERE verification = 'UNCONFIRMED') AS downgraded,
       round(count(*) FILTER (WHERE verification = 'UNCONFIRMED') * 1.0 / nullif(count(*) FILTER (WHERE verification IN ('UNCONFIRMED', 'VERIFIED')), 0), 6) AS rate
FROM (SELECT {_TAGS} FROM verified) t""")
def agg_downgrade_rate(spark, sf):
    return ev.downgrade_rate(verified(spark, sf)).withColumn("rate", F.round("rate", 6))


@query("f_sentiment_tag", _P + f"SELECT case_id, dimension, pos, sentiment FROM (SELECT *, {_TAGS} FROM items) t")
def f_sentiment_tag(spark, sf):
    return items(parsed(spark, sf)).select(*KEYS, "pos", rp.sentiment_tag(F.col("text")).alias("sentiment"))


@query("f_verification_tag", _P + f"SELECT case_id, dimension, pos, verification FROM (SELECT *, {_TAGS} FROM items) t")
def f_verification_tag(spark, sf):
    return items(parsed(spark, sf)).select(*KEYS, "pos", rp.verification_tag(F.col("text")).alias("verification"))


_WORDS = lambda ws: r"(?i)\b(" + "|".join(ws) + r")\b"


@query("f_sentiment_words", _P + f"""
SELECT case_id, dimension, CASE WHEN b > g THEN 'bad' WHEN g > b THEN 'good' ELSE 'neutral' END AS tone
FROM (SELECT case_id, dimension, len(regexp_extract_all(feedback, '{_WORDS(rp.GOOD_WORDS)}')) AS g,
      len(regexp_extract_all(feedback, '{_WORDS(rp.BAD_WORDS)}')) AS b FROM parsed WHERE ok) t""")
def f_sentiment_words(spark, sf):
    """Tone of feedback by counting words."""
    return sound(spark, sf).select(*KEYS, rp.sentiment_words(F.col("feedback")).alias("tone"))


_TXT = """SELECT case_id, dimension, CASE WHEN k % 2 = 0 THEN feedback ELSE '1. first part' || chr(10) || '2) second ' || k || chr(10) || ' 3. ' || feedback END AS text FROM parsed WHERE ok"""


@query("f_split_numbered", _P + f"""
SELECT case_id, dimension, len(parts) AS n_parts, array_to_string(parts, '|') AS parts FROM (
  SELECT case_id, dimension, CASE WHEN len(a) > 1 THEN a WHEN len(b) > 1 THEN b ELSE [] END AS parts FROM (
    SELECT case_id, dimension,
      list_filter(list_transform(string_split_regex(trim(text, {_WS}), '\\s*\\(\\d+\\)\\s*'), lambda x: trim(x, {_WS})), lambda x: x <> '') AS a,
      list_filter(list_transform(string_split_regex(trim(text, {_WS}), '(?:^|\\n)\\s*\\d+[).]\\s+'), lambda x: trim(x, {_WS})), lambda x: x <> '') AS b
    FROM ({_TXT}) t) u) v""")
def f_split_numbered(spark, sf):
    """Numbered findings split into parts."""
    odd = F.concat(F.lit("1. first part\n2) second "), F.col("k").cast("string"), F.lit("\n 3. "), F.col("feedback"))
    df = sound(spark, sf).withColumn("text", F.when(F.col("k") % 2 == 0, F.col("feedback")).otherwise(odd))
    df = df.withColumn("parts", rp.split_numbered(F.col("text")))
    return df.select(*KEYS, F.size("parts").alias("n_parts"), F.array_join("parts", "|").alias("parts"))


@query("f_score_band", """
SELECT o_orderkey, CASE WHEN s IS NULL THEN 'na' WHEN round_even(s, 0) <= 1 THEN 'red' WHEN round_even(s, 0) = 2 THEN 'orange'
       WHEN round_even(s, 0) = 3 THEN 'green' ELSE 'dark-green' END AS band
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 9 THEN (o_orderkey % 10) / 2.0 END AS s FROM orders) t""")
def f_score_band(spark, sf):
    """Colour band of a score; halves round to even."""
    s = F.when(F.col("o_orderkey") % 10 != 9, (F.col("o_orderkey") % 10) / F.lit(2.0))
    return table(spark, sf, "orders").select("o_orderkey", rp.score_band(s).alias("band"))


@query("f_score_pct", """
SELECT o_orderkey, CASE WHEN s IS NULL THEN 0 ELSE greatest(0, least(100, s / 4.0 * 100)) END AS pct
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 9 THEN (o_orderkey % 10) - 2.0 END AS s FROM orders) t""")
def f_score_pct(spark, sf):
    s = F.when(F.col("o_orderkey") % 10 != 9, (F.col("o_orderkey") % 10) - F.lit(2.0))
    return table(spark, sf, "orders").select("o_orderkey", rp.score_pct(s).alias("pct"))


@query("rep_details", _VERIFIED + """
SELECT p.case_id, p.dimension, coalesce(CAST(p.score AS VARCHAR), 'N/A') AS score, CASE WHEN p.ok THEN 'success' ELSE 'error' END AS status,
       p.feedback, coalesce(e.evidence, '') AS evidence
FROM parsed p LEFT JOIN (SELECT case_id, dimension, string_agg(text, chr(10) ORDER BY pos) AS evidence FROM verified GROUP BY ALL) e USING (case_id, dimension)""")
def rep_details(spark, sf):
    """One report row per review with its evidence as lines."""
    reviews = parsed(spark, sf).select(*KEYS, "ok", "score", "feedback", "evidence")
    df = ev.verify(reviews, fixture(spark, sf, "f8_verdicts"), KEYS)
    return df.select(*KEYS, F.coalesce(F.col("score").cast("string"), F.lit("N/A")).alias("score"),
                     F.when(F.col("ok"), "success").otherwise("error").alias("status"), "feedback",
                     F.coalesce(F.array_join("evidence", "\n"), F.lit("")).alias("evidence"))
