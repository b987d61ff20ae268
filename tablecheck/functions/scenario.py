"""Scenario replies: fallback, blend shares, applicability."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tablecheck.functions.replies import macro_only, strip_fences

# Known scenarios.
SCENARIOS = [
    "reporting_analysis",
    "data_processing",
    "template_form",
    "planning_tracking",
    "financial_modeling",
    "comparison_evaluation",
    "general",
]
MIN_CONFIDENCE = 0.7
REPLY_TYPE = (
    "struct<scenario:string,confidence:double,reasoning:string,blend:map<string,double>,"
    "applicable_dimensions:map<string,boolean>,dimension_reasoning:map<string,string>>"
)
MACRO_REASON = "Only a macro is requested; worksheet formulas are not part of the task."


def known(scenario: Column) -> Column:
    return F.coalesce(scenario.isin(*SCENARIOS), F.lit(False))


def parse_scenario(reply: Column) -> Column:
    """Raw fields of a scenario reply; null when it is no JSON object."""
    return F.from_json(strip_fences(reply), REPLY_TYPE)


def confidence_of(raw: Column) -> Column:
    return F.when(known(raw["scenario"]), F.coalesce(raw["confidence"], F.lit(0.0))).otherwise(F.lit(0.0))


def detected_of(raw: Column) -> Column:
    """Named scenario, or ``general`` when unknown or not confident enough."""
    return F.when(known(raw["scenario"]) & (raw["confidence"] >= MIN_CONFIDENCE), raw["scenario"]).otherwise("general")


def normalise_blend(blend: Column, detected: Column) -> Column:
    """Shares over the sum of all given shares; unknown scenarios count in the sum only."""
    total = F.aggregate(F.map_values(blend), F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))
    shares = F.transform_values(
        F.map_filter(blend, lambda k, v: k.isin(*SCENARIOS) & v.isNotNull()),
        lambda k, v: F.when(total > 0, v / total).otherwise(F.lit(0.0)),
    )
    return F.when(F.size(shares) > 0, shares).otherwise(F.create_map(detected, F.lit(1.0)))


def applicable_of(raw: Column, prompt: Column) -> Column:
    """Applicability by dimension; a macro-only prompt switches formula_logic off."""
    given = F.map_filter(F.coalesce(raw["applicable_dimensions"], F.create_map().cast("map<string,boolean>")),
                         lambda k, v: v.isNotNull())
    open_ = F.coalesce(F.element_at(given, "formula_logic"), F.lit(True))
    others = F.map_filter(given, lambda k, v: k != "formula_logic")
    off = F.map_concat(others, F.create_map(F.lit("formula_logic"), F.lit(False)))
    return F.when(open_ & macro_only(prompt), off).otherwise(given)


def apply_override(override: Column, detected: Column, confidence: Column) -> tuple[Column, Column]:
    """A valid manual scenario wins with full confidence; an invalid one is ignored."""
    valid = known(override)
    return F.when(valid, override).otherwise(detected), F.when(valid, F.lit(1.0)).otherwise(confidence)
